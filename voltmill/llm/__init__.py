"""Operations of a training-data pipeline: joins, dedup, scoring, mixing, formatting.

Nothing outside this subpackage imports it.  Functions that Spark ships to executors are
pickled by value, so a cluster needs no installed copy of this package.
"""

from importlib import import_module

from pyspark import cloudpickle

for _name in ("kernels", "quality_rules", "exact_dedup", "ngram_join", "piece_codec", "license_scan", "quality_model", "chat_format"):
    cloudpickle.register_pickle_by_value(import_module(f"{__name__}.{_name}"))
