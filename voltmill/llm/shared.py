"""Spark helpers of the training-data operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.types import StructType

from voltmill.session import shared_folder

#: Most groups of rows that are handled as hot ones, and most buckets of a dense numbering.
HOT, BUCKETS = 4096, 1 << 15
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def files_for(rows: int, each: int = 50_000) -> int:
    """Files for a table of short rows, so that a small one isn't strewn over as many files as there are partitions."""
    return max(1, -(-rows // each))


def cut(df: DataFrame, files: int | None = None) -> DataFrame:
    """Write df to the cluster's shared checkpoint folder, in at most so many files, and go on from there."""
    if files is not None:
        df = df.coalesce(files)
    shared_folder(df.sparkSession)
    return df.checkpoint()


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names for helper columns that no column of df has, whatever its case."""
    taken, out = {c.lower() for c in df.columns}, []
    for n in names:
        while n.lower() in taken:
            n = f"_{n}"
        taken.add(n.lower())
        out.append(n)
    return out


def named(column: str) -> Column:
    """A column by its whole name, dots and backquotes included."""
    return F.col("`" + column.replace("`", "``") + "`")


def fields(schema: StructType) -> str:
    """The fields of a schema as DDL text with quoted names."""
    return ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in schema.fields)


def parts(df: DataFrame) -> int:
    """The session's number of shuffle partitions."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def unit(*cols: Column | str) -> Column:
    """A keyed uniform number in [0, 1): equal for equal values, whatever the partitioning."""
    return F.pmod(F.xxhash64(*cols), F.lit(1 << 52)) / F.lit(float(1 << 52))


def join_groups(rows: DataFrame, groups: DataFrame, key: str, count: str, values: list[str], spread: Column, total: int) -> DataFrame:
    """Left join of rows with the values of their group (one row a key, with its number of rows).

    Groups of at least total / HOT rows are at most HOT; they are broadcast, and their rows, like those without a
    key, are dealt by spread, so that no task gathers a hot group.
    """
    hot = groups.where(F.col(count) * HOT >= total).select(key, *values).limit(HOT)
    marked = rows.join(F.broadcast(hot.select(F.col(key).alias("__k"), F.struct(*values).alias("__hot"))), F.col(key) == F.col("__k"), "left").drop("__k")
    dealt = marked.withColumn("__by", F.when(F.col("__hot").isNotNull() | F.col(key).isNull(), F.xxhash64(spread)).otherwise(F.col(key)))
    rest = groups.where(F.col(count) * HOT < total).select(F.col(key).alias("__k"), F.struct(*values).alias("__rest"))
    found = dealt.join(rest, (F.col("__by") == F.col("__k")) & (F.col(key) == F.col("__k")), "left")
    return found.select(*rows.columns, *[F.coalesce(F.col("__hot"), F.col("__rest"))[v].alias(v) for v in values])


def running_sums(df: DataFrame, order: list[Column], sums: dict[str, str], place: str | None = None) -> DataFrame:
    """Add for each name the sum of a column over all earlier rows in a total order, and the place from 0 where named.

    Rows are sorted in ranges and cut once with their place in the range; ranges are shifted by the sums of
    earlier ones, so no task holds all rows.
    """
    ranged = cut(df.orderBy(*order).withColumn("__at", F.monotonically_increasing_id())).withColumn("__p", F.shiftright("__at", 33))
    wanted = {name: F.col(c) for name, c in sums.items()} | ({place: F.lit(1).cast("long")} if place else {})
    per = ranged.groupBy("__p").agg(*[F.sum(x).alias(f"__t_{n}") for n, x in wanted.items()])
    earlier = W.orderBy("__p").rowsBetween(W.unboundedPreceding, -1)  # one row a range
    shift = per.select(F.col("__p").alias("__q"), *[F.coalesce(F.sum(f"__t_{n}").over(earlier), F.lit(0)).alias(f"__s_{n}") for n in wanted])
    inside = W.partitionBy("__p").orderBy("__at").rowsBetween(W.unboundedPreceding, -1)
    out = ranged.join(F.broadcast(shift), F.col("__p") == F.col("__q"))
    out = out.withColumns({n: F.col(f"__s_{n}") + F.coalesce(F.sum(x).over(inside), F.lit(0)) for n, x in wanted.items()})
    return out.select(*df.columns, *wanted)


def dense_index(df: DataFrame, within: list[str], order: list[Column], name: str, rows_per_bucket: int = 2_500) -> DataFrame:
    """Number the rows from 0 without gaps in each group of the columns within.

    Rows are dealt by hash into buckets, at most BUCKETS, numbered there, and shifted by the rows of earlier
    buckets, so a group of any size is spread over many tasks.  Equal rows may swap numbers.
    """
    total = df.count()
    n = min(BUCKETS, max(1, -(-total // rows_per_bucket)))
    cols = df.columns
    dealt = df.withColumn("__b", F.pmod(F.xxhash64(F.lit(17), *order), F.lit(n)).cast("int"))
    keys = [*within, "__b"]
    counts = dealt.groupBy(*keys).agg(F.count("*").alias("__n"))
    before = W.partitionBy(*within).orderBy("__b").rowsBetween(W.unboundedPreceding, -1)
    shift = counts.select(*[F.col(c).alias(f"__s{i}") for i, c in enumerate(keys)], F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    at = F.row_number().over(W.partitionBy(*keys).orderBy(*order)) - 1
    numbered = dealt.withColumn("__at", at)
    same = None
    for i, c in enumerate(keys):
        x = F.col(c).eqNullSafe(F.col(f"__s{i}"))
        same = x if same is None else same & x
    return numbered.join(shift, same).select(*cols, (F.col("__before") + F.col("__at")).cast("long").alias(name))
