"""How filters interact: what each filter removes after which others, per part, in every order of the filters.

The failure flags are counted once per (part, flags), so at most 2^filters rows a part go on. A SQL CUBE over the flags and the part gives a row
for each choice of flags: a grouping-set row whose selected flags are all false counts the survivors of that subset of filters.
A filter's step behind others is then the difference of two subsets, before and after, joined by (part, subset); the orders
only look these steps up. Nothing after the first count grows with the documents.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD, materialize, numbered, small

FILTERS = ("A", "B", "C", "D", "E")
MIN_WORDS = 100
#: Percent of words that must be different, and of code points that may be capitals.
MIN_DISTINCT, MAX_CAPITALS = 80, 10
#: Orders are listed in full, so no more filters than this.
MOST_FILTERS = 7


def failures(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", lang: str = "lang") -> DataFrame:
    """doc_id, part (lang, null: empty string) and the booleans A to E of every row.

    A: under 100 words; B: under 80 % of the words are different; C: over 10 % of the code points are A-Z; D: holds any of #$%&*|; E: a smaller
    doc_id has the same text. A null text counts as empty (it fails A, and E behind another). A null doc_id is neither smaller nor larger than
    any, so it never fails E; rows of one doc_id and text do not fail E by each other. An empty table gives no rows.
    """
    docs, (text, doc_id, lang) = numbered(docs, text, doc_id, lang)
    words = F.regexp_extract_all("text", F.lit(WORD), F.lit(0))
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(lang, F.lit("")).alias("part"), F.coalesce(text, F.lit("")).alias("text"))
    rows = rows.select(
        "doc_id",
        "part",
        F.unhex(F.sha2("text", 256)).alias("digest"),
        (F.size(words) < MIN_WORDS).alias("A"),
        (100 * F.size(F.array_distinct(words)) < MIN_DISTINCT * F.size(words)).alias("B"),
        (100 * F.regexp_count("text", F.lit("[A-Z]")).cast("long") > MAX_CAPITALS * F.length("text").cast("long")).alias("C"),
        F.col("text").rlike("[#$%&*|]").alias("D"),
    )
    rows = materialize(rows, "audit-rows")
    # only texts that occur again are joined; a crowded digest is one side of a join, which may be split or broadcast
    firsts = rows.groupBy("digest").agg(F.count("*").alias("n"), F.min("doc_id").alias("first")).filter("n > 1").drop("n")
    firsts = materialize(firsts, "audit-firsts")
    later = F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False))
    return rows.join(small(firsts), "digest", "left").select("doc_id", "part", "A", "B", "C", "D", later.alias("E"))


def survivors(flags: DataFrame, filters: tuple[str, ...] = FILTERS, marks: tuple[str, ...] = ()) -> DataFrame:
    """part, subset (bit i: filter i applies), kept and a sum for each mark, over the rows that fail none of the subset; zeros included.

    flags: part, a boolean for each filter, a number for each mark.
    """
    counted = flags.groupBy("part", *filters).agg(F.count("*").alias("kept"), *[F.sum(m).alias(m) for m in marks])
    counted = materialize(counted, "audit-counts")
    chosen = sum(((1 - F.grouping(f).cast("int")) * (1 << i) for i, f in enumerate(filters)), F.lit(0))
    sums = [F.sum(c).alias(c) for c in ("kept", *marks)]
    cubed = counted.cube("part", *filters).agg(*sums, chosen.alias("subset"), F.grouping("part").alias("all_parts"))
    passed = F.lit(True)
    for f in filters:
        passed = passed & ~F.coalesce(F.col(f), F.lit(False))  # null: not selected
    cubed = cubed.filter((F.col("all_parts") == 0) & passed).select("part", "subset", "kept", *marks)
    grid = counted.select("part").distinct().withColumn("subset", F.explode(F.sequence(F.lit(0), F.lit((1 << len(filters)) - 1))))
    full = grid.join(cubed, ["part", "subset"], "left")
    return materialize(full.select("part", "subset", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("kept", *marks)]), "audit-subsets")


def steps(subsets: DataFrame, filters: tuple[str, ...] = FILTERS, marks: tuple[str, ...] = ()) -> DataFrame:
    """part, filter, before (the subset applied earlier), kept, removed and for each mark its sum over the removed, for each filter and subset without it."""
    bits = F.array(*[F.struct(F.lit(f).alias("filter"), F.lit(1 << i).alias("bit")) for i, f in enumerate(filters)])
    earlier = subsets.withColumn("by", F.explode(bits)).filter(F.col("subset").bitwiseAND(F.col("by.bit")) == 0)
    earlier = earlier.select("part", "by.filter", F.col("subset").alias("before"), F.col("subset").bitwiseOR(F.col("by.bit")).alias("subset"), *[F.col(c).alias(f"before_{c}") for c in ("kept", *marks)])
    both = earlier.join(subsets, ["part", "subset"])
    return both.select("part", "filter", "before", "kept", (F.col("before_kept") - F.col("kept")).alias("removed"), *[(F.col(f"before_{m}") - F.col(m)).alias(m) for m in marks])


def audit(flags: DataFrame, filters: tuple[str, ...] = FILTERS, marks: tuple[str, ...] = ()) -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, a sum for each mark and shapley: a row per part, order of all filters and step.

    redundant: rows that fail the step's filter and were removed earlier; unique_fails: rows that fail only it; shapley: what the filter removes, summed over
    all orders. Filters are named by one letter each. Parts without rows do not occur; steps that remove nothing do.
    """
    if not 0 < len(filters) <= MOST_FILTERS:
        raise ValueError(f"between 1 and {MOST_FILTERS} filters, as every order of them is listed")
    n, spark = len(filters), flags.sparkSession
    by_step = materialize(steps(survivors(flags, filters, marks), filters, marks), "audit-steps")
    others = F.lit((1 << n) - 1) - F.element_at(F.create_map(*[x for i, f in enumerate(filters) for x in (F.lit(f), F.lit(1 << i))]), F.col("filter"))
    times = F.element_at(F.array(*[F.lit(factorial(k) * factorial(n - 1 - k)).cast("long") for k in range(n)]), F.bit_count("before") + 1)
    total = by_step.groupBy("part", "filter").agg(
        F.sum(F.when(F.col("before") == 0, F.col("removed"))).alias("fails"),
        F.sum(F.when(F.col("before") == others, F.col("removed"))).alias("unique_fails"),
        F.sum(F.col("removed") * times).alias("shapley"),
    )
    listed = [("".join(order), k + 1, f, sum(1 << filters.index(e) for e in order[:k])) for order in permutations(filters) for k, f in enumerate(order)]
    orders = spark.createDataFrame(listed, "filter_order string, step int, filter string, before int")
    out = by_step.join(total, ["part", "filter"]).join(F.broadcast(orders), ["filter", "before"])
    return out.select("part", "filter_order", "step", "kept", "removed", (F.col("fails") - F.col("removed")).alias("redundant"), "unique_fails", *marks, "shapley")


def labelled(flags: DataFrame, labels: DataFrame) -> DataFrame:
    """flags with good_lost and toxic_lost: 1 where any label of the doc_id says quality 1, toxic 1; else 0."""
    said = lambda c: F.max(F.when(F.col(c) == 1, 1).otherwise(0))
    marks = labels.groupBy(F.col("doc_id").alias("labelled_id")).agg(said("quality").alias("good_lost"), said("toxic").alias("toxic_lost"))
    out = flags.join(marks, F.col("doc_id") == F.col("labelled_id"), "left").drop("labelled_id")
    return out.fillna(0, ["good_lost", "toxic_lost"])


def audit_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The audit of the five filters of failures() over docs, with good_lost and toxic_lost by labels. Nulls and repeats are as in failures()."""
    return audit(labelled(failures(docs), labels), FILTERS, ("good_lost", "toxic_lost"))


#: DuckDB: every document walks through every order.
SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), f AS (
  SELECT doc_id, part, len(w) < 100 AS a, 100 * len(list_distinct(w)) < 80 * len(w) AS b,
    100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t) AS c, regexp_matches(t, '[#$%&*|]') AS d,
    coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false) AS e FROM d
), l AS (
  SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id
), g AS (
  SELECT part, a, b, c, d, e, a::INT + b::INT + c::INT + d::INT + e::INT AS fails, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic FROM f LEFT JOIN l USING (doc_id)
), x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f), o AS (
  SELECT p.f || q.f || r.f || s.f || t.f AS filter_order FROM x p, x q, x r, x s, x t
  WHERE len(list_distinct([p.f, q.f, r.f, s.f, t.f])) = 5
), fail AS (
  SELECT g.*, filter_order, list_filter([if(a, instr(filter_order, 'A'), 9), if(b, instr(filter_order, 'B'), 9), if(c, instr(filter_order, 'C'), 9),
    if(d, instr(filter_order, 'D'), 9), if(e, instr(filter_order, 'E'), 9)], lambda k: k < 9) AS spots FROM g, o
), s AS (
  SELECT part, filter_order, step, count(*) FILTER (WHERE coalesce(list_min(spots), 9) > step) AS kept, count(*) FILTER (WHERE list_min(spots) = step) AS removed,
    count(*) FILTER (WHERE list_contains(spots, step) AND list_min(spots) < step) AS redundant, count(*) FILTER (WHERE list_contains(spots, step) AND fails = 1) AS unique_fails,
    coalesce(sum(good) FILTER (WHERE list_min(spots) = step), 0) AS good_lost, coalesce(sum(toxic) FILTER (WHERE list_min(spots) = step), 0) AS toxic_lost
  FROM fail, (SELECT unnest([1, 2, 3, 4, 5]) AS step) GROUP BY ALL
)
SELECT part, filter_order, step::INT AS step, kept, removed, redundant, unique_fails, good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost,
  (sum(removed) OVER (PARTITION BY part, substr(filter_order, step, 1)))::BIGINT AS shapley
FROM s
"""
