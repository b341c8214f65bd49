"""Relational helpers that Spark has no single operator for."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .graph import checkpointed


#: Fixed value: equal states before a change that counts as sudden.
STABLE_RUN = 10


def latest_by(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in the given order; order must be total for a defined result."""
    w = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn")


def latest_values(df: DataFrame, keys: list[str], order: list[Column], values: list[str]) -> DataFrame:
    """The values of the greatest row of each key, as an aggregate: partial sums shrink the shuffle."""
    top = F.max_by(F.struct(*values), F.struct(*order))
    return df.groupBy(*keys).agg(top.alias("__top")).select(*keys, "__top.*")


def valid_at(events: DataFrame, versions: DataFrame, key: str, at: str) -> DataFrame:
    """Point-in-time join: the version of each event's key with from <= at < to, the latest such one.

    Version periods overlap at most where two start together, so an event meets few of them.
    """
    e, v = events.alias("e"), versions.alias("v")
    hit = (F.col(f"e.{key}") == F.col(f"v.{key}")) & (F.col("v.effective_from") <= F.col(f"e.{at}")) & (F.col("v.effective_to").isNull() | (F.col("v.effective_to") > F.col(f"e.{at}")))
    return e.join(v, hit, "left").select("e.*", "v.version_key", "v.effective_from")


def asof_last(events: DataFrame, versions: DataFrame, key: str, at: str, value: str, since: str) -> DataFrame:
    """The last value at or before each event: one union and one window, no range join, so long histories stay linear."""
    left = events.select(F.col(key), F.col(at).alias("__t"), F.lit(1).alias("__kind"), F.lit(None).cast(versions.schema[value].dataType).alias("__v"), F.struct(*[events[c] for c in events.columns]).alias("__row"))
    right = versions.select(F.col(key), F.col(since).alias("__t"), F.lit(0).alias("__kind"), F.col(value).alias("__v"), F.lit(None).cast(left.schema["__row"].dataType).alias("__row"))
    w = W.partitionBy(key).orderBy("__t", "__kind", F.col("__v").asc_nulls_last()).rowsBetween(W.unboundedPreceding, W.currentRow)
    both = left.unionByName(right).withColumn("__last", F.last("__v", ignorenulls=True).over(w))
    return both.where("__kind = 1").select("__row.*", F.col("__last").alias(value))


def append_absent(target: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Insert-if-absent by business key; of new rows of equal key one is taken."""
    return target.unionByName(new.dropDuplicates(keys).join(target.select(*keys), keys, "left_anti"))


def upsert(target: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Replace rows of equal key by the new ones and add the rest; of new rows of equal key one is taken."""
    return target.join(new.select(*keys), keys, "left_anti").unionByName(new.dropDuplicates(keys))


def state_changes(df: DataFrame, keys: list[str], order: list[Column], state: str, stable: int = STABLE_RUN) -> DataFrame:
    """Changes of state after a run of at least `stable` equal states: keys, idx (place of the change, from 0), from_state, to_state, stable_run."""
    n = F.row_number().over(W.partitionBy(*keys).orderBy(*order)) - 1
    per = islands(df, keys, order, state).withColumn("__i", n).groupBy(*keys, "run").agg(F.count("*").alias("len"), F.first(state).alias("st"), F.min("__i").alias("idx"))
    w = W.partitionBy(*keys).orderBy("run")
    found = per.select(*keys, F.col("idx").cast("long").alias("idx"), F.lag("st").over(w).alias("from_state"), F.col("st").alias("to_state"), F.lag("len").over(w).alias("stable_run"))
    return found.where(F.col("stable_run") >= stable)


def islands(df: DataFrame, keys: list[str], order: list[Column], state: str) -> DataFrame:
    """Number the runs of equal state in order: adds change and run, and each row's place in its run."""
    w = W.partitionBy(*keys).orderBy(*order)
    changed = ~F.col(state).eqNullSafe(F.lag(state).over(w)) & (F.row_number().over(w) > 1)
    out = df.withColumn("change", changed).withColumn("run", F.sum(F.col("change").cast("int")).over(w.rowsBetween(W.unboundedPreceding, W.currentRow)))
    return out.withColumn("in_run", F.row_number().over(W.partitionBy(*keys, "run").orderBy(*order)))


def numbered(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """Number the rows from 0 in the given order, which must be total for a defined result.

    The rows are sorted in ranges and cut once together with their range and place in it, so that counting and
    numbering read the same ranges; each range is then shifted by the rows of earlier ones.  No task holds all rows.
    """
    ranged = checkpointed(df.orderBy(*order).withColumn("__at", F.monotonically_increasing_id()))
    counts = ranged.groupBy(F.shiftright("__at", 33).alias("__p")).agg(F.count("*").alias("__n"))
    before = W.orderBy("__p").rowsBetween(W.unboundedPreceding, -1)  # one row a range
    shift = counts.select("__p", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    placed = ranged.join(F.broadcast(shift), F.shiftright("__at", 33) == F.col("__p"))
    return placed.withColumn(name, F.col("__before") + F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))).drop("__p", "__before", "__at")


def chronological_split(df: DataFrame, order: list[Column], shares: tuple[float, ...], names: tuple[str, ...]) -> DataFrame:
    """Cut an ordered set at floor(n * cumulative share)."""
    placed = numbered(df, order, "__i")
    total = placed.agg(F.count("*").alias("__total"))
    label, total_share, cuts = F.lit(names[-1]), 0.0, []
    for s, n in zip(shares[:-1], names[:-1], strict=False):
        total_share += s
        cuts.append((F.floor(F.col("__total") * F.lit(round(total_share, 6))), n))
    for limit, n in reversed(cuts):
        label = F.when(F.col("__i") < limit, F.lit(n)).otherwise(label)
    return placed.crossJoin(F.broadcast(total)).withColumn("split", label).drop("__total", "__i")


def first_seen_keys(df: DataFrame, value: str, order: Column, name: str) -> DataFrame:
    """Surrogate keys from 1 in order of first appearance, then of value; one row per distinct value."""
    first = df.groupBy(value).agg(F.min(order).alias("__first"))
    return numbered(first, [F.col("__first"), F.col(value)], "__i").select(value, (F.col("__i") + 1).alias(name))


def one_row(*frames: DataFrame) -> DataFrame:
    """Single-row aggregates side by side."""
    return reduce(lambda a, b: a.crossJoin(b), frames)
