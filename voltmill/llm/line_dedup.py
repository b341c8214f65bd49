"""Line dedup (3): deletion-neighbourhood join within one edit, in DataFrame operations only.

Lines are parts of texts between line feeds that have a character other than a space.  A line is dropped
where an earlier line, by document id, text hash and line number, is equal or at most one edit (insertion,
deletion, replacement of a code point) away.

Two lines one edit apart agree outside any stretch that holds the edit.  So neighbourhoods are emitted from
coarse to fine, and only what shares a hashed key goes on: each line without one of its two halves, then
without one of BLOCKS blocks, then without one code point inside such a block.  Blocks of a line of fewer code
points are empty or one code point wide, so lines of any length go the same way.  Of the last keys, lines of
equal length that lack the same place are one replacement apart, and a line that equals a longer one without
a code point is one insertion apart, so each group needs its earliest lines only and no pairs.  The edit
distance of a line to the earliest line found is verified.

Defined results: null and empty texts have no lines; rows of equal id and text are one document; rows of equal
id and other texts are documents of their own, in order of a hash of their text; a null id comes before all
others; texts are read whole; an empty table gives no rows; extra columns pass through, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import cut, files_for, fresh, named

BLOCKS = 16


def _mark(text: Column) -> Column:
    """Tells rows of equal id and different text apart."""
    return F.xxhash64(text.cast("string"))


def split_lines(docs: DataFrame) -> DataFrame:
    """doc_id, mark (hash of the text), line_no (from 0, all parts counted) and line."""
    parts = docs.select("doc_id", _mark(F.col("text")).alias("mark"), F.posexplode(F.split(F.col("text").cast("string"), "\n")).alias("line_no", "line"))
    return parts.where(F.length(F.trim("line")) > 0)


def _id(line: Column) -> Column:
    return F.unhex(F.md5(line.cast("binary")))


def _half_keys() -> Column:
    """Hashes of the halves that a line shares with one that is an edit away in the other half."""
    n = F.length("line")
    sizes = [F.floor(n / 2), F.floor((n - 1) / 2)]
    left = [F.xxhash64(F.lit(0), F.expr("line").substr(F.lit(1), x.cast("int"))) for x in sizes]
    right = [F.xxhash64(F.lit(1), F.expr("line").substr((x + 1).cast("int"), n)) for x in sizes]
    shorter = [F.xxhash64(F.lit(1), F.expr("line").substr((x + 2).cast("int"), n)) for x in sizes]
    return F.array_distinct(F.array(left[0], left[1], right[0], shorter[1]))


def _block_keys() -> Column:
    """For lines as the shorter or equal (m = n) and as the longer one (m = n - 1): each block's bounds and the hash of the rest."""
    n = F.col("n")

    def of(m: Column) -> Column:
        def block(i: Column) -> Column:
            a, e = F.floor(i * m / BLOCKS).cast("int"), F.floor((i + 1) * m / BLOCKS).cast("int")
            skip = n - m + e  # where the part after the block begins
            key = F.xxhash64(m, i, F.expr("line").substr(F.lit(1), a), F.expr("line").substr(skip + 1, n))
            return F.struct(key.alias("key"), m.alias("m"), a.alias("a"), (skip - a).alias("w"))

        return F.transform(F.sequence(F.lit(0), F.lit(BLOCKS - 1)), block)

    return F.concat(of(n), of(n - 1))


def _shared(rows: DataFrame, key: str, what: str, files: int) -> DataFrame:
    """Keys that two or more different values of what have; cut, so that joins with them can be split where a key is common."""
    return cut(rows.groupBy(key).agg(F.min(what).alias("lo"), F.max(what).alias("hi")).where("lo < hi").select(key), files)


def _variants() -> Column:
    """Hashed keys of a block without one code point, and of a whole block for longer lines to match."""
    mid = F.expr("line").substr(F.col("a") + 1, F.col("w"))

    def without(p: Column) -> Column:
        return F.concat(mid.substr(F.lit(1), p), mid.substr(p + 2, F.col("w")))

    places = F.when(F.col("w") > 0, F.sequence(F.lit(0), F.col("w") - 1)).otherwise(F.array().cast("array<int>"))
    kind = lambda k, key: F.struct(F.lit(k).alias("kind"), key.alias("v"))
    same = F.concat(
        F.transform(places, lambda p: kind("same", F.xxhash64(F.lit("same"), "key", p, without(p)))),
        F.array(kind("short", F.xxhash64(F.lit("one"), "key", mid))),
    )
    longer = F.array_distinct(F.transform(places, lambda p: kind("long", F.xxhash64(F.lit("one"), "key", without(p)))))
    return F.when(F.col("m") == F.col("n"), same).otherwise(longer)


def near_lines(docs: DataFrame, first: DataFrame, files: int) -> DataFrame:
    """(id, keep): lines with an earlier one an edit away, and the earliest such place.  first has id and place."""
    lines = split_lines(docs)
    keys = lines.select(F.xxhash64("line").alias("h"), F.explode(_half_keys()).alias("k"))
    live = cut(keys.join(_shared(keys, "k", "h", files), "k", "left_semi").select("h").distinct(), files)
    texts = lines.select("line", F.xxhash64("line").alias("h")).join(live.hint("shuffle_hash"), "h", "left_semi").select("line").distinct()
    texts = cut(texts.select(_id(F.col("line")).alias("id"), "line", F.length("line").alias("n")).join(first, "id"))
    blocks = cut(texts.select("id", F.inline(_block_keys())))
    some = blocks.join(_shared(blocks, "key", "id", files), "key", "left_semi")
    emitted = some.join(texts, "id").select("id", "place", F.inline(_variants()))
    emitted = cut(emitted.distinct(), 8 * files)  # several keys a line
    me = F.struct("place", "id")
    least = cut(emitted.groupBy("v").agg(
        F.min(F.when(F.col("kind") == "same", me)).alias("same"),
        F.min(F.when(F.col("kind") == "short", me)).alias("short"),
        F.min(F.when(F.col("kind") == "long", me)).alias("long"),
    ), files)
    found = F.when(F.col("kind") == "same", F.col("same")).when(F.col("kind") == "short", F.col("long")).otherwise(F.col("short"))
    earlier = emitted.join(least, "v").withColumn("keep", found).where(F.col("keep.place") < F.col("place"))
    earlier = earlier.groupBy("id").agg(F.min("keep").alias("keep"))
    own = texts.select("id", F.col("line").alias("own"))
    other = texts.select(F.col("id").alias("other_id"), F.col("line").alias("other"))
    pairs = earlier.select("id", F.col("keep.place").alias("keep"), F.col("keep.id").alias("other_id")).join(own, "id").join(other, "other_id")
    return pairs.where(F.levenshtein("own", "other", 1) == 1).select("id", "keep")


def dropped_lines(docs: DataFrame) -> DataFrame:
    """A row for each dropped line: doc_id, mark, line_no, keep_doc_id, keep_mark, keep_line_no, distance (0 or 1)."""
    docs = docs.select("doc_id", "text")
    place = F.struct("doc_id", "mark", "line_no").alias("place")
    every = cut(split_lines(docs).select(place, _id(F.col("line")).alias("id")))
    files = files_for(every.count())
    first = cut(every.groupBy("id").agg(F.min("place").alias("place"), F.count("*").alias("n")), files)
    near = near_lines(docs, first.select("id", "place"), files)
    marks = cut(first.join(near, "id", "left").where("n > 1 OR keep IS NOT NULL").select("id", F.col("place").alias("own"), "keep"), files)  # cut, so that the join with a very common line can be split
    hit = every.join(marks, "id").where(F.col("keep").isNotNull() | (F.col("place") > F.col("own")))
    keep = F.when(F.col("place") > F.col("own"), F.struct(F.col("own").alias("p"), F.lit(0).alias("d"))).otherwise(F.struct(F.col("keep").alias("p"), F.lit(1).alias("d")))
    out = hit.select("place.*", keep.alias("k")).distinct()
    return out.select("doc_id", "mark", "line_no", F.col("k.p.doc_id").alias("keep_doc_id"), F.col("k.p.mark").alias("keep_mark"), F.col("k.p.line_no").alias("keep_line_no"), F.col("k.d").alias("distance"))


def report(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_lines, n_dropped, dropped (line numbers, ascending)."""
    drops = dropped_lines(docs).groupBy(F.col("doc_id").alias("id"), F.col("mark").alias("of")).agg(F.array_sort(F.collect_list("line_no")).alias("dropped"))
    lines = F.coalesce(F.size(F.filter(F.split(F.col("text").cast("string"), "\n"), lambda x: F.length(F.trim(x)) > 0)), F.lit(0))
    counted = docs.select("doc_id", _mark(F.col("text")).alias("mark"), F.when(F.col("text").isNull(), 0).otherwise(lines).cast("long").alias("n_lines"))
    out = counted.join(drops, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("mark") == F.col("of")), "left")
    empty = F.array().cast("array<int>")
    dropped = F.coalesce("dropped", empty)
    return out.select("doc_id", "n_lines", F.size(dropped).cast("long").alias("n_dropped"), dropped.alias("dropped"))


def strip_lines(docs: DataFrame, drops: DataFrame) -> DataFrame:
    """The documents without the dropped lines, with all columns."""
    own, id_, of, gone = fresh(docs, "own_mark", "drop_id", "drop_mark", "gone")
    d = drops.groupBy(F.col("doc_id").alias(id_), F.col("mark").alias(of)).agg(F.collect_set("line_no").alias(gone))
    keep = F.filter(F.split(F.col("text").cast("string"), "\n"), lambda x, i: ~F.array_contains(gone, i))
    text = F.when(F.col(gone).isNull(), F.col("text")).otherwise(F.array_join(keep, "\n"))
    joined = docs.withColumn(own, _mark(F.col("text"))).join(d, F.col("doc_id").eqNullSafe(F.col(id_)) & (F.col(own) == F.col(of)), "left")
    return joined.select(*[text.alias(c) if c == "text" else named(c) for c in docs.columns])
