"""Outcome reports over live cases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docketspark.functions import exprs as e
from docketspark.operators.selection import medians
from docketspark.schema import BUDGET_BANDS, CONTRACT_BANDS, MANAGERS, MIN_SAMPLE, PROPOSAL_BANDS, REPORT_MONTHS, RISK_TOP_N, SUPPLY_MIN_SAMPLE
from docketspark.sources.snapshots import keep


def window(projects: DataFrame, as_of: Column, days: int | None) -> DataFrame:
    """Cases whose recruiting began within the last `days` days; no or no positive number: all."""
    return projects.filter(F.col("recruit_started_at") >= as_of - F.expr(f"INTERVAL '{days}' DAY")) if days and days > 0 else projects


def totals(projects: DataFrame) -> DataFrame:
    paid = F.when(F.col("contract_amount") > 0, F.col("contract_amount"))
    live = projects.filter(e.live())
    out = live.agg(
        F.count("*").alias("total"), F.count_if(e.won()).alias("won"), F.count_if(e.cancelled()).alias("cancelled"), F.count_if(e.pending()).alias("pending"),
        F.round(F.avg(paid), 2).alias("mean_amount"), F.min(paid).alias("min_amount"), F.max(paid).alias("max_amount"),
    )
    return out.crossJoin(F.broadcast(medians(live, [], {"median_amount": paid})))  # one row each


def win_rates(projects: DataFrame, label: Column, min_decided: int = MIN_SAMPLE, by: Column | None = None) -> DataFrame:
    """label, decided, rate and sort_key (least `by`) of groups with enough decided cases."""
    out = projects.filter(e.live()).groupBy(label.alias("label")).agg(F.count_if(e.decided()).alias("decided"), e.rate().alias("rate"), *([F.min(by).alias("sort_key")] if by is not None else []))
    return out.filter(F.col("decided") >= min_decided)


def composition(rows: DataFrame, label: Column) -> DataFrame:
    """label, n and share in percent of all rows; the window runs over one row per label."""
    groups = rows.groupBy(label.alias("label")).agg(F.count("*").alias("n"))
    return groups.withColumn("rate", e.percent(F.col("n"), F.sum("n").over(Window.partitionBy(F.lit(1)))))


def tag_ranking(projects: DataFrame, insights: DataFrame, tags: str, top: int | None = None) -> DataFrame:
    """label, decided, rate, pool: how often each tag occurs, in percent of the live cases that have any tag."""
    tagged = projects.filter(e.live()).join(insights.filter(F.size(tags) > 0), F.col("id") == F.col("project_id"))
    pool = tagged.agg(F.count("*").alias("pool"))
    ranked = tagged.select(F.explode(tags).alias("label")).groupBy("label").agg(F.count("*").alias("decided"))
    ranked = ranked.crossJoin(F.broadcast(pool)).withColumn("rate", e.percent(F.col("decided"), F.col("pool")))  # one row
    return ranked.orderBy(F.desc("decided"), "label").limit(top) if top else ranked


def tag_lift(projects: DataFrame, insights: DataFrame, tags: str, min_sample: int) -> DataFrame:
    """label, decided, rate: per tag the cases and the percentage with few proposals, among decided live cases."""
    rows = projects.filter(e.live() & e.decided()).join(insights, F.col("id") == F.col("project_id")).select("proposal_count", F.explode(tags).alias("label"))
    out = rows.groupBy("label").agg(F.count("*").alias("decided"), e.percent(F.count_if(e.low_supply()), F.count("*")).alias("rate"))
    return out.filter(F.col("decided") >= min_sample)


def tag_baseline(projects: DataFrame, insights: DataFrame, tags: str) -> DataFrame:
    """The same rate for cases that were tagged with nothing (an empty list, not null)."""
    rows = projects.filter(e.live() & e.decided()).join(insights.filter(F.size(tags) == 0), F.col("id") == F.col("project_id"))
    return rows.agg(F.count("*").alias("decided"), e.percent(F.count_if(e.low_supply()), F.count("*")).alias("rate"))


def by_month(projects: DataFrame, months: int = REPORT_MONTHS) -> DataFrame:
    """Rates of the latest months in local time, oldest first."""
    out = projects.filter(e.live() & F.col("recruit_started_at").isNotNull()).groupBy(F.date_format(e.kst(F.col("recruit_started_at")), "yyyy-MM").alias("label"))
    return out.agg(F.count_if(e.decided()).alias("decided"), e.rate().alias("rate")).orderBy(F.desc("label")).limit(months).orderBy("label")


def stage_days(projects: DataFrame) -> DataFrame:
    """Median days of each stage; one row."""
    days = lambda a, b: e.whole_days(F.col(a), F.col(b))
    return medians(projects.filter(e.live()), [], {
        "inspection": days("submitted_at", "recruit_started_at"), "recruiting": days("recruit_started_at", "progress_started_at"),
        "progress": days("progress_started_at", "completed_at"), "cancelled": days("recruit_started_at", "cancelled_at"),
    })


def budget_delta(rows: DataFrame) -> DataFrame:
    a, b = F.col("contract_amount"), F.col("budget")
    return rows.filter(a.isNotNull() & (b > 0)).agg(F.count_if((a > b) & (a > 0)).alias("increased"), F.count_if((a == b) & (a > 0)).alias("same"), F.count_if((a < b) & (a > 0)).alias("decreased"), F.count_if(a == 0).alias("zero_excluded"))


def managers(projects: DataFrame, names: dict[str, str] = MANAGERS) -> DataFrame:
    """Per manager, after names are resolved: counts, rates, medians and a flag for few decided cases."""
    account = F.col("inspection_manager")
    lookup = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
    named = projects.filter(e.live() & account.isNotNull()).withColumn("manager", F.coalesce(lookup[account], account))
    out = named.groupBy("manager").agg(
        F.count("*").alias("total"), F.count_if(e.decided()).alias("decided"), F.count_if(e.won()).alias("won"), F.count_if(e.cancelled()).alias("cancelled"), F.count_if(e.pending()).alias("pending"),
    )
    spans = {"contract_median": F.when(F.col("contract_amount") > 0, F.col("contract_amount")), "days": e.whole_days(F.col("recruit_started_at"), F.col("progress_started_at"))}
    out = out.join(medians(named, ["manager"], spans), "manager", "left")
    share = lambda n: F.when(F.col("decided") > 0, e.half_up(F.col(n) / F.col("decided") * 1000) / 10).otherwise(0.0)
    return out.select("manager", "total", "decided", share("won").alias("contract_rate"), share("cancelled").alias("cancel_rate"), "contract_median", e.half_up(F.col("days")).alias("recruiting_days"), "pending", (F.col("decided") < MIN_SAMPLE).alias("low_sample"))


def spread(groups: DataFrame, soft: int) -> DataFrame:
    """The best and the worst label among groups with a sound sample, and how far they are apart."""
    sound = groups.filter((F.col("decided") >= soft) & F.col("rate").isNotNull())
    best, worst = F.max(F.struct("rate", "label")), F.min(F.struct("rate", "label"))
    return sound.agg(best["label"].alias("best"), best["rate"].alias("best_rate"), worst["label"].alias("worst"), worst["rate"].alias("worst_rate"), F.round(best["rate"] - worst["rate"], 1).alias("spread"))


def top_share(groups: DataFrame, top: int = 3) -> DataFrame:
    """The first labels by count with their rank."""
    order = Window.orderBy(F.desc("n"), "label")  # one row per label
    return groups.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)


#: The parts of the report: by which label cases are grouped, for which cases.
SECTIONS = ("totals", "budget", "scope", "proposals", "low_proposals", "contract", "month", "cancel_stage", "risk", "risk_pool", "cancel", "cancel_pool", "supply", "supply_baseline")


def counted_sections(projects: DataFrame, insights: DataFrame) -> DataFrame:
    """section, label and the counts of live cases (n, won, decided, cancelled, pending, low: decided ones with few proposals), amounts and the least sort key.

    One pass: every case is read once with its tags, stands under each label that it has, and all groups are counted together before the shuffle. So all
    parts of a report are of the same rows. The table has a row per section and label.
    """
    col, tagged = F.col, lambda c: F.coalesce(c, F.array().cast("array<string>"))
    one = lambda section, label, when=None, key=None: F.when(F.lit(True) if when is None else when, F.struct(F.lit(section).alias("section"), label.cast("string").alias("label"), (key if key is not None else F.lit(None)).cast("long").alias("key")))
    single = F.array(
        one("totals", F.lit("")),
        one("budget", e.band(col("budget"), BUDGET_BANDS), col("budget").isNotNull() & ~col("budget_monthly"), col("budget")),
        one("scope", col("dev_scope"), col("dev_scope").isNotNull()),
        one("proposals", e.band(col("proposal_count"), PROPOSAL_BANDS), col("proposal_count").isNotNull(), col("proposal_count")),
        one("low_proposals", F.concat(col("proposal_count").cast("string"), F.lit("건")), e.low_supply()),
        one("contract", e.band(col("contract_amount"), CONTRACT_BANDS), col("contract_amount") > 0),
        one("month", F.date_format(e.kst(col("recruit_started_at")), "yyyy-MM"), col("recruit_started_at").isNotNull()),
        one("cancel_stage", col("cancel_stage"), col("cancel_stage").isNotNull()),
        one("risk_pool", F.lit(""), F.size(tagged("risk_tags")) > 0),
        one("cancel_pool", F.lit(""), F.size(tagged("cancel_tags")) > 0),
        one("supply_baseline", F.lit(""), col("supply_tags").isNotNull() & (F.size("supply_tags") == 0) & e.decided()),
    )
    by_tag = lambda kind: F.transform(tagged(f"{kind}_tags"), lambda t: F.struct(F.lit(kind).alias("section"), t.alias("label"), F.lit(None).cast("long").alias("key")))
    many = [by_tag("risk"), by_tag("cancel")]
    supply = F.when(e.decided(), by_tag("supply"))
    rows = projects.filter(e.live()).join(insights.select(col("project_id").alias("tagged_id"), "risk_tags", "cancel_tags", "supply_tags"), col("id") == col("tagged_id"), "left")
    paid = F.when(col("contract_amount") > 0, col("contract_amount"))
    flags = {"won": e.won(), "decided": e.decided(), "cancelled": e.cancelled(), "pending": e.pending(), "low": e.decided() & e.low_supply()}
    rows = rows.select(*[f.alias(n) for n, f in flags.items()], paid.alias("paid"), F.inline(F.concat(F.array_compact(single), *many, F.coalesce(supply, F.array().cast("array<struct<section:string,label:string,key:bigint>>")))))
    out = rows.groupBy("section", "label").agg(F.count("*").alias("n"), *[F.count_if(f).alias(f) for f in flags], F.count("paid").alias("paid"), F.sum("paid").alias("amount"), F.min("paid").alias("least"), F.max("paid").alias("most"), F.min("key").alias("sort_key"))
    return keep(out, "report-sections")


def section(counted: DataFrame, name: str) -> DataFrame:
    """label, decided, rate (and pool, where a share of a pool is meant) of one part of the report, with that part's least sample and order."""
    rows, label = counted.filter(F.col("section") == name), F.col("label")
    won = e.percent(F.col("won"), F.col("decided"))
    if name in ("budget", "proposals", "scope"):
        rows = rows.filter(F.col("decided") >= MIN_SAMPLE).select("label", "decided", won.alias("rate"), "sort_key")
        return rows.orderBy(*([F.col("rate").desc_nulls_first(), "label"] if name == "scope" else ["sort_key"])).drop("sort_key")
    if name == "low_proposals":
        return rows.select("label", "decided", won.alias("rate"))
    if name == "month":
        return rows.select("label", "decided", won.alias("rate")).orderBy(F.desc("label")).limit(REPORT_MONTHS).orderBy("label")
    if name in ("contract", "cancel_stage"):
        return rows.select("label", "n", e.percent(F.col("n"), F.sum("n").over(Window.partitionBy(F.lit(1)))).alias("rate"))  # one row per label
    if name == "supply":
        return rows.filter(F.col("n") >= SUPPLY_MIN_SAMPLE).select("label", F.col("n").alias("decided"), e.percent(F.col("low"), F.col("n")).alias("rate"))
    if name == "supply_baseline":
        return rows.select(F.col("n").alias("decided"), e.percent(F.col("low"), F.col("n")).alias("rate"))
    if name in ("risk", "cancel"):
        pool = counted.filter(F.col("section") == f"{name}_pool").select(F.col("n").alias("pool"))
        ranked = rows.select("label", F.col("n").alias("decided")).join(F.broadcast(pool)).withColumn("rate", e.percent(F.col("decided"), F.col("pool")))  # one row
        return ranked.orderBy(F.desc("decided"), "label").limit(RISK_TOP_N) if name == "risk" else ranked
    raise ValueError(f"no part of the report: {name}")
