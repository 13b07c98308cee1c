"""Mixing sources to target weights by weighted fair queueing, in DataFrame operations only.

Each source's documents stand in a shuffled order (by a hash key), once for each copy that may be taken. An entry's
virtual finish time is its source's words up to it divided by the source's target. Taking entries in the order of finish
times until the total budget is used gives each source its share. Running sums over hot sources are taken in two levels:
totals of key ranges first, then within each range; the global order likewise is a range partition of finish times whose
totals show in which range the budget ends, and only that range is sorted. What comes out is a cut per source and copy,
a key up to which documents are taken, so texts are never shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, materialize, numbered, small

#: The budget in percent of all words, the copies of a document that may be taken, and the weights in the sources' order.
BUDGET_PERCENT = 150
COPIES = 2
WEIGHTS = (5, 2, 1)
SEED = 20_011


def words_of(text: Column | str) -> Column:
    """Number of words; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)).cast("long"), F.lit(0).cast("long"))


def _ranges(n: int) -> int:
    """About the square root of the number of rows, as a power of two: so many ranges of so many rows."""
    return 1 << max(3, (max(n, 1).bit_length() + 1) // 2)


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, budget_percent: int = BUDGET_PERCENT, copies: int = COPIES) -> DataFrame:
    """source, weight, source_size, target: the budget shared by weight, no target above copies x source_size.

    Sources stand in code point order, null last, and take the weights in turn. What a full source cannot take is shared among
    the others by weight: with sources sorted by source_size / weight, those before the first that would not be full are.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    ordered = Window.orderBy(F.col("source").asc_nulls_last())  # one row per source
    turn = (F.row_number().over(ordered) - 1) % len(weights)
    totals = totals.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (turn + 1).cast("int")))
    room = F.col("source_size") * copies
    by_level = Window.orderBy(room / F.col("weight"), F.col("source").asc_nulls_last())
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    after = by_level.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.partitionBy(F.lit(1))
    total = F.sum("source_size").over(everything) * (budget_percent / 100)
    level = (total - F.coalesce(F.sum(room).over(before), F.lit(0))) / F.sum("weight").over(after)
    first = F.struct((room / F.col("weight")).alias("ratio"), level.alias("level"))
    totals = totals.withColumn("first", F.when(level * F.col("weight") < room, first))
    level = F.min("first").over(everything)["level"]
    return totals.select("source", "weight", "source_size", F.coalesce(F.least(room.cast("double"), level * F.col("weight")), room.cast("double")).alias("target"))


def _key(doc_id: Column, digest: Column) -> Column:
    """The shuffled order: by a hash of the id, then the id and the text's hash; only equal documents tie."""
    return F.struct(F.xxhash64(F.lit(SEED), doc_id, digest).alias("h"), doc_id.alias("i"), digest.alias("d"))


def cuts(sizes: DataFrame, copies: int = COPIES, **shares) -> DataFrame:
    """source, weight, source_size, target and cut, an array with the last key taken of each copy (null: none).

    sizes: rows (source, size, key). Equal documents (same id, text and source) have the same key and are taken or left together.
    """
    shared = materialize(targets(sizes, copies=copies, **shares), "mixing-targets")
    n = _ranges(sizes.count())
    shift = 64 - (n.bit_length() - 1)
    rows = sizes.filter("size > 0").withColumn("range", F.shiftrightunsigned(F.col("key.h").bitwiseXOR(F.lit(-(1 << 63))), shift))
    sums = rows.groupBy("source", "range").agg(F.sum("size").alias("words"))
    earlier = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(F.col("source").alias("s"), F.col("range").alias("r"), F.coalesce(F.sum("words").over(earlier), F.lit(0)).alias("base"))
    upto = Window.partitionBy("source", "range").orderBy("key").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("upto", F.sum("size").over(upto))
    rows = rows.join(sums, F.col("source").eqNullSafe(F.col("s")) & (F.col("range") == F.col("r"))).withColumn("upto", F.col("upto") + F.col("base"))
    share = small(shared.select(F.col("source").alias("t"), "source_size", "target"))
    entries = rows.join(share, F.col("source").eqNullSafe(F.col("t"))).select("source", "key", "size", "upto", "source_size", "target", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))).alias("copy"))
    entries = entries.filter("target > 0").select("source", "key", "copy", "size", ((F.col("upto") + F.col("copy") * F.col("source_size")) / F.col("target")).alias("finish"))
    # target words are reached near finish 1; times beyond 2 share the last range
    entries = materialize(entries.withColumn("range", F.least(F.floor(F.col("finish") * n), F.lit(2 * n))), "mixing-entries")

    budget = shared.agg(F.sum("target")).first()[0] or 0.0
    totals = entries.groupBy("range").agg(F.sum("size").alias("words"))
    totals = totals.withColumn("upto", F.sum("words").over(Window.orderBy("range")))  # about 2 x the square root of the rows
    last = totals.filter(F.col("upto") <= budget).agg(F.max("range").alias("range"), F.max("upto").alias("upto")).first()
    full, used = (last["range"], last["upto"]) if last["range"] is not None else (-1, 0)
    following = totals.filter(F.col("range") > full).agg(F.min("range")).first()[0]
    taken = entries.filter(F.col("range") <= full).select("source", "copy", "key")
    if following is not None:
        order = Window.orderBy("finish", F.col("source").asc_nulls_last(), "copy", "key")
        edge = entries.filter(F.col("range") == following).withColumn("upto", F.sum("size").over(order) + used)
        taken = taken.unionByName(edge.filter(F.col("upto") <= budget).select("source", "copy", "key"))
    ends = taken.groupBy("source", "copy").agg(F.max("key").alias("key"))
    by_copy = ends.groupBy("source").agg(*[F.max(F.when(F.col("copy") == c, F.col("key"))).alias(f"cut{c}") for c in range(copies)])
    by_copy = by_copy.withColumnRenamed("source", "t")
    out = shared.join(by_copy, F.col("source").eqNullSafe(F.col("t")), "left")
    return materialize(out.select("source", "weight", "source_size", "target", F.array(*[f"cut{c}" for c in range(copies)]).alias("cut")), "mixing-cuts")


def _taken(key: Column, cut: Column) -> Column:
    return F.size(F.filter(cut, lambda c: c.isNotNull() & (key <= c)))


def mixture(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", source: str = "source", **shares) -> DataFrame:
    """doc_id, size, source_size, target, copies (how often the mix takes the document) and taken (words, repeats counted).

    The words of each source come near its target, the total stays within the budget. Size is a text's words (null: 0);
    documents without words are not taken. A null source is a source of its own. The order depends on the ids and
    texts alone, so that reruns agree; an empty table gives no rows.
    """
    docs, (text, doc_id, source) = numbered(docs, text, doc_id, source)
    key = _key(F.col("doc_id"), F.xxhash64("text"))
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.col(source).alias("source"))
    rows = materialize(rows.select("doc_id", "source", words_of("text").alias("size"), key.alias("key")), "mixing-sizes")
    ends = cuts(rows.select("source", "size", "key"), **shares).withColumnRenamed("source", "t")
    joined = rows.join(small(ends), F.col("source").eqNullSafe(F.col("t")))
    copies = F.when(F.col("size") > 0, _taken(F.col("key"), F.col("cut"))).otherwise(0)
    return joined.select("doc_id", "size", "source_size", "target", copies.alias("copies"), (F.col("size") * copies).alias("taken"), "source", "weight")


def mixed_documents(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", source: str = "source", **shares) -> DataFrame:
    """The mix itself: the columns of docs, a row for each time that a document is taken. Nothing but the cuts is joined to the texts.

    Nulls, empty texts, repeated rows and an empty table are as in mixture().
    """
    names = docs.columns
    docs, (text, doc_id, source) = numbered(docs, text, doc_id, source)
    columns, key = docs.columns, _key(F.col(doc_id), F.xxhash64(text))
    sizes = materialize(docs.select(F.col(source).alias("source"), words_of(text).alias("size"), key.alias("key")), "mixing-sizes")
    ends = small(cuts(sizes, **shares).select(F.col("source").alias("t"), "cut"))
    keyed = docs.withColumn("key", key).join(ends, F.col(source).eqNullSafe(F.col("t")))
    times = F.when(F.length(F.regexp_extract(text, f"({WORD})", 1)) > 0, _taken(F.col("key"), F.col("cut"))).otherwise(0)
    return keyed.withColumn("again", F.explode(F.array_repeat(F.lit(1), times))).select(*columns).toDF(*names)
