"""Completion scores and cost estimates: weights and rates are small dimension tables, the rest is grouped arithmetic."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docketspark.functions import rules
from docketspark.functions.exprs import half_up
from docketspark.schema import (
    BUFFER, DAYS_PER_MONTH, EMBEDDED, EMBEDDED_TYPE, GATE, OPTIONS, PM_PRICE, PM_RATIO, POSTING_PARTS, QA_PRICE, QA_RATIO, RATES, RND_PRICE, RND_TYPE, SECTIONS,
)

CORE = ("purpose", "features", "platform")


def sections(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, s, *v) for i, (s, v) in enumerate(SECTIONS.items())], "position int, section string, weight int, required boolean, na_allowed boolean, guess_allowed boolean")


def rates(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(p, level, float(md), float(price)) for (p, level), (md, price) in RATES.items()], "part string, level string, md double, price double")


def _weighted(scores: DataFrame) -> DataFrame:
    return scores.join(F.broadcast(sections(scores.sparkSession)), "section")


def _total():
    used = F.when(F.col("applicable"), F.col("weight"))
    return half_up(F.sum(used * F.col("confidence")) / F.sum(used))


def assembled(answers: DataFrame, sources: DataFrame, key: str) -> DataFrame:
    """key, section, confidence, applicable and guesses of all sections from a model's answers.

    answers: key, section, confidence, applicable, evidence, guess (array); sources: key and source, the input text. A section without an answer is applicable with
    confidence 0; an inapplicable one counts only with its evidence in the source; confidence is rounded and held within 0 and 100.
    """
    dim = F.broadcast(sections(answers.sparkSession))
    given = answers.groupBy(key).agg(F.collect_list(F.struct("section", "confidence", "applicable", "evidence", "guess")).alias("answers"))
    # a text meets all answers of its key at once and goes no further: its rows per section carry no text
    judged = sources.select(key, "source").join(given, key, "left").select(key, rules.with_grounds(F.col("answers"), F.col("source")).alias("answers"))
    own = F.filter("answers", lambda a: a["section"] == F.col("section"))
    rows = judged.crossJoin(dim).withColumn("own", own).drop("answers").withColumn("a", F.explode_outer("own"))  # twelve sections
    out = rows.withColumn("applies", ~rules.inapplicable(F.col("na_allowed"), F.col("a.applicable"), F.col("a.grounded")))
    sure = F.greatest(F.lit(0), F.least(F.lit(100), half_up(F.coalesce("a.confidence", F.lit(0)))))
    guesses = rules.accepted_guesses(F.col("guess_allowed"), F.col("applies"), sure, F.col("a.guess"))
    return out.select(key, "section", sure.alias("confidence"), F.col("applies").alias("applicable"), guesses.alias("guesses"))


def options(answers: DataFrame, key: str) -> DataFrame:
    """The four fixed options of every key: option, name, period and kind; an option without an answer has defaults. answers: key, option, kind, period."""
    fixed = answers.sparkSession.createDataFrame(OPTIONS, "option string, name string")
    keys = answers.groupBy(key).agg(F.max("kind").alias("kind")).crossJoin(F.broadcast(fixed))  # four options
    own = answers.filter(F.col("option").isNotNull()).select(key, "option", "period")
    return keys.join(own, [key, "option"], "left").select(key, "option", "name", rules.period(F.col("period")).alias("period"), rules.project_type(F.col("kind")).alias("kind"))


def totals(scores: DataFrame, key: str) -> DataFrame:
    """Weighted mean of the applicable sections' confidence, rounded; scores: key, section, confidence, applicable."""
    return _weighted(scores).groupBy(key).agg(_total().alias("total"))


def gate(scores: DataFrame, key: str, least: int = GATE) -> DataFrame:
    """Whether no required applicable section is below the threshold, and which are."""
    low = F.col("required") & F.col("applicable") & (F.col("confidence") < least)
    blocking = F.array_join(F.sort_array(F.collect_list(F.when(low, F.col("section")))), ",")
    return _weighted(scores).groupBy(key).agg((F.count_if(low) == 0).alias("passes"), blocking.alias("blocking"))


def grades(scores: DataFrame, key: str) -> DataFrame:
    """Four grades of the total, and whether a consultation may end: total at least 70 and each core section at least 50."""
    out = _weighted(scores).groupBy(key).agg(_total().alias("total"), F.min(F.when(F.col("section").isin(*CORE), F.col("confidence"))).alias("core"))
    grade = F.when(F.col("total") < 40, "초기").when(F.col("total") < 70, "진행 중").when(F.col("total") < 85, "등록 가능").otherwise("완성")
    return out.select(key, grade.alias("grade"), ((F.col("total") >= 70) & (F.col("core") >= 50)).alias("closable"))


def priorities(scores: DataFrame, key: str, top: int = 3, skip: int = 80) -> DataFrame:
    """The sections to ask about first: weight times what is missing, those nearly complete left out."""
    rows = _weighted(scores).filter(F.col("confidence") < skip).withColumn("p", F.col("weight") * (100 - F.col("confidence")))
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("p"), "section"))).filter(F.col("rank") <= top)
    return ranked.select(key, "section", F.round(F.col("p") / 100, 2).alias("priority"), "rank")


def posting_parts(scores: DataFrame, key: str) -> DataFrame:
    dim = scores.sparkSession.createDataFrame([(p, s, w) for p, own in POSTING_PARTS.items() for s, w in own.items()], "part string, section string, share double")
    rows = scores.join(F.broadcast(dim), "section")
    return rows.groupBy(key, "part").agg(F.round(F.sum(F.col("share") * F.col("confidence")) / F.sum("share"), 2).alias("score"))


def estimate(rows: DataFrame) -> DataFrame:
    """Cost per id in 10,000 won from rows (id, kind, part, level, md, price, qty, rnd_low, rnd_high); quantities are rounded, negative or missing ones count as 0."""
    embedded = F.when((F.col("part") == "dev") & (F.col("kind") == EMBEDDED_TYPE), EMBEDDED).otherwise(1.0)
    md = F.col("md") * rules.quantity(F.col("qty")) * embedded
    out = rows.groupBy("id").agg(
        F.first("kind").alias("kind"), F.first("rnd_low").alias("low"), F.first("rnd_high").alias("high"), F.sum(md).alias("md"), F.sum(md * F.col("price") / DAYS_PER_MONTH).alias("cost"), F.sum(F.when(F.col("part") == "dev", md)).alias("dev_md"),
    )
    qa = F.col("dev_md") / DAYS_PER_MONTH * QA_RATIO
    pm = (F.col("md") / DAYS_PER_MONTH + qa) * PM_RATIO
    out = out.withColumn("subtotal", F.col("cost") + qa * QA_PRICE + pm * PM_PRICE)
    extra = lambda n: F.when(F.col("kind") == RND_TYPE, F.greatest(F.coalesce(n, F.lit(0.0)), F.lit(0.0)) * RND_PRICE).otherwise(0.0)
    return out.select("id", "dev_md", "subtotal", (F.col("subtotal") * BUFFER + extra("low")).alias("total_low"), (F.col("subtotal") * BUFFER + extra("high")).alias("total_high"))
