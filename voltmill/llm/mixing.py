"""Mixing sources to target weights (7): pivotal dependent rounding, in DataFrame operations only.

Every document of a source has the same expected number of copies, its source's target over its source's
size.  The whole part is taken as it is; the fractions are rounded by the pivotal method weighted by size:
two open documents pass words to each other until one of them is settled, in a random direction whose odds
keep each document's expectation.  Groups of about FAN_IN documents are folded at once and leave at most one
open document each; the open ones of FAN_IN groups make a group of the next level, so a source of any size
is a tree of small tasks, and at its root one last document is rounded to the nearest.  Random
numbers are keyed by document and level: reruns agree, whatever the partitioning.

Defined results: a null or empty text has size 0, is taken 0 times and doesn't move the mix; a null source is
a source, the last in order; rows of equal id, source and size share their copies evenly; with no words at
all every target is 0; an empty table gives no rows; extra columns pass through, whatever their names.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import WORD, cut, files_for, fresh, named, running_sums, unit

WEIGHTS = (5.0, 2.0, 1.0)
#: Copies of a document, and so of a source's words, at most.
MOST = 3
FAN_IN = 32
SEED = 20260


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text.cast("string"), F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """Source, source_size, n and target of rows (source, size).

    A source gets weight * level, at most its bound of most times its size.  The level at which the
    targets add up to all words: sources in the order in which they reach their bounds; the first k are at
    their bounds for the least k that leaves the next one below its own.  Orders and sums over sources are
    taken in ranges, so there may be as many sources as hosts.
    """
    s = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    s = running_sums(s, [F.col("source").asc_nulls_last()], {}, place="place")
    s = s.withColumn("w", F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod("place", F.lit(len(weights))) + 1).cast("int")))
    s = s.withColumn("bound", F.col("source_size") * F.lit(float(most))).withColumn("reach", F.col("bound") / F.col("w"))
    # Sums of whole numbers: the same in any order.
    s = running_sums(s, [F.col("reach"), F.col("place")], {"full": "bound", "light": "w"}, place="nth")
    every = s.agg(F.sum("w").alias("all_w"), F.sum("source_size").cast("double").alias("words"))
    s = s.crossJoin(F.broadcast(every)).withColumn("at", (F.col("words") - F.col("full")) / (F.col("all_w") - F.col("light")))
    level = s.where("at <= reach").agg(F.min_by("at", "nth").alias("level"))
    target = F.when(F.col("words") == 0, F.lit(0.0)).otherwise(F.least("bound", F.col("w") * F.coalesce("level", "reach")))
    return s.crossJoin(F.broadcast(level)).select("source", "source_size", "n", target.alias("target"))


_OPEN = "id: bigint, size: bigint, m: bigint, f: double, u: double, b: bigint"
_DONE = "id: bigint, size: bigint, m: bigint, up: int"


def _fold(items: Column) -> Column:
    """Fold an array of open documents: struct(open, done), done with f set to 0 or 1."""
    nobody = F.lit(None).cast(f"struct<{_OPEN}>")
    start = F.struct(nobody.alias("open"), F.array().cast(f"array<struct<{_DONE}>>").alias("done"))

    def settled(x: Column, up: int) -> Column:
        return F.array(F.struct(x["id"].alias("id"), x["size"].alias("size"), x["m"].alias("m"), F.lit(up).alias("up")))

    def reopened(x: Column, f: Column) -> Column:
        return F.struct(x["id"].alias("id"), x["size"].alias("size"), x["m"].alias("m"), f.alias("f"), x["u"].alias("u"), x["b"].alias("b"))

    def step(acc: Column, x: Column) -> Column:
        o, done = acc["open"], acc["done"]
        a, b = o["size"].cast("double"), x["size"].cast("double")
        give, take = (F.lit(1.0) - o["f"]) * a, x["f"] * b  # words that o lacks, that x has
        have, lack = o["f"] * a, (F.lit(1.0) - x["f"]) * b
        up, down = F.least(give, take), F.least(have, lack)
        rises = x["u"] * (up + down) < down
        # o rises by up words, x falls; or o falls by down words, x rises.
        when_up = F.when(
            give < take, F.struct(reopened(x, x["f"] - give / b).alias("open"), F.concat(done, settled(o, 1)).alias("done"))
        ).when(
            give > take, F.struct(reopened(o, o["f"] + take / a).alias("open"), F.concat(done, settled(x, 0)).alias("done"))
        ).otherwise(F.struct(nobody.alias("open"), F.concat(done, settled(o, 1), settled(x, 0)).alias("done")))
        when_down = F.when(
            have < lack, F.struct(reopened(x, x["f"] + have / b).alias("open"), F.concat(done, settled(o, 0)).alias("done"))
        ).when(
            have > lack, F.struct(reopened(o, o["f"] - lack / a).alias("open"), F.concat(done, settled(x, 1)).alias("done"))
        ).otherwise(F.struct(nobody.alias("open"), F.concat(done, settled(o, 0), settled(x, 1)).alias("done")))
        return F.when(o.isNull(), F.struct(x.alias("open"), done.alias("done"))).when(rises, when_up).otherwise(when_down)

    return F.aggregate(items, start, step)


def copies(rows: DataFrame, seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """Targets of sources, and (doc_id, source, size, rows, copies): copies that rows of equal id, source and size get together."""
    targets = cut(source_targets(rows))
    files = files_for(rows.count())
    entry = rows.where("size > 0").groupBy("source", "doc_id", "size").agg(F.count("*").alias("m"))
    t = targets.select(F.col("source").alias("__s"), "source_size", "target", "n")
    entry = entry.join(t, F.col("source").eqNullSafe(F.col("__s"))).drop("__s")
    each = F.col("target") / F.col("source_size")
    whole = F.floor(each * F.col("m"))
    key = F.xxhash64(F.lit(seed), "source", "doc_id", "size")
    groups = F.ceil(F.col("n") / F.lit(FAN_IN))
    entry = cut(entry.select("source", "doc_id", "size", "m", whole.cast("long").alias("whole"), (each * F.col("m") - whole).alias("f"), F.pmod(key, groups).alias("b"), key.alias("key")), files)
    largest = targets.agg(F.max("n")).first()[0] or 0
    level, n, settled = 0, -(-largest // FAN_IN), []
    open_rows = entry.where("f > 0").select("source", F.col("doc_id").alias("id"), "size", "m", "f", "b", "key")
    while True:
        # Large documents settle among each other first, so that a small one is open in the end.
        u = unit(F.lit(seed), F.lit(level), "key")
        item = F.struct((-F.col("size")).alias("order"), "key", F.struct("id", "size", "m", "f", u.alias("u"), "b").alias("x"))
        listed = F.transform(F.array_sort(F.collect_list(item)), lambda e: e["x"])
        folded = open_rows.groupBy("source", "b").agg(listed.alias("items")).select("source", "b", _fold(F.col("items")).alias("r"))
        folded = cut(folded, files)
        done = folded.select("source", F.inline("r.done")).select("source", "id", "size", "m", "up")
        settled.append(done)
        rest = folded.where("r.open IS NOT NULL").select("source", F.col("b").alias("g"), "r.open.*").drop("b")
        if n <= 1:
            settled.append(rest.select("source", "id", "size", "m", (F.col("f") >= 0.5).cast("int").alias("up")))
            break
        open_rows = rest.select("source", "id", "size", "m", "f", F.expr(f"g div {FAN_IN}").alias("b"), F.xxhash64(F.lit(seed), "source", "id", "size").alias("key"))
        level, n = level + 1, -(-n // FAN_IN)
    up = reduce(DataFrame.union, settled).where("up = 1").select(F.col("source").alias("__s"), F.col("id").alias("__id"), F.col("size").alias("__size"), "up")
    same = F.col("source").eqNullSafe(F.col("__s")) & F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("size") == F.col("__size"))
    taken = entry.join(up, same, "left").select("doc_id", "source", "size", F.col("m").alias("rows"), (F.col("whole") + F.coalesce("up", F.lit(0))).alias("copies"))
    return targets, taken


def _shares(rows: Column, copies: Column) -> Column:
    """Copies of each of some equal rows: as even as can be."""
    return F.transform(F.sequence(F.lit(1).cast("long"), rows), lambda i: F.floor(copies / rows) + F.when(i <= copies % rows, 1).otherwise(0))


def mix(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken (words, repeats counted)."""
    rows = cut(docs.select("doc_id", "source", word_count(F.col("text")).alias("size")))
    targets, taken = copies(rows)
    empty = rows.where("size = 0").select("doc_id", "source", "size", F.lit(0).cast("long").alias("taken"))
    full = taken.select("doc_id", "source", "size", F.explode(_shares(F.col("rows"), F.col("copies"))).alias("k")).select("doc_id", "source", "size", (F.col("k") * F.col("size")).alias("taken"))
    t = targets.select(F.col("source").alias("__s"), "source_size", "target")
    out = full.union(empty).join(t, F.col("source").eqNullSafe(F.col("__s")))
    return out.select("doc_id", "size", F.col("source_size").cast("long").alias("source_size"), "target", F.col("taken").cast("long").alias("taken"))


def repeat_rows(docs: DataFrame, copy: str | None = None) -> DataFrame:
    """The mix itself: each row as many times as it is taken, with all columns; rows taken 0 times are left out.

    Where named, column copy is added, in place of one of that name: a number from 1 that differs among the rows
    of one id, source and size.
    """
    size, id_, src, z, of, n, nth, k, x = fresh(docs, "own_size", "m_id", "m_source", "m_size", "m_rows", "m_copies", "m_nth", "m_k", "m_copy")
    tagged = docs.withColumn(size, word_count(F.col("text")))
    rows = cut(tagged.select("doc_id", "source", F.col(size).alias("size")))
    _, taken = copies(rows)
    some = taken.where("copies > 0").select(F.col("doc_id").alias(id_), F.col("source").alias(src), F.col("size").alias(z), F.col("rows").alias(of), F.col("copies").alias(n))
    same = F.col("doc_id").eqNullSafe(F.col(id_)) & F.col("source").eqNullSafe(F.col(src)) & (F.col(size) == F.col(z))
    joined = tagged.join(some, same)
    place = F.row_number().over(W.partitionBy(id_, src, z).orderBy(F.xxhash64("text")))
    lone = joined.where(F.col(of) == 1).withColumn(k, F.col(n)).withColumn(nth, F.lit(1))
    several = joined.where(F.col(of) > 1).withColumn(nth, place).withColumn(k, F.floor(F.col(n) / F.col(of)) + F.when(F.col(nth) <= F.col(n) % F.col(of), 1).otherwise(0))
    out = lone.unionByName(several).where(F.col(k) > 0)
    number = [] if copy is None else [((F.col(nth) - 1) * MOST + F.col(x)).cast("int").alias(copy)]
    kept = [named(c) for c in docs.columns if c != copy]
    return out.withColumn(x, F.explode(F.sequence(F.lit(1), F.col(k)))).select(*kept, *number)
