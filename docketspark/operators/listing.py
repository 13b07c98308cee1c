"""Filtered, ranked and paged case lists, the board, and case details."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docketspark.functions import exprs as e
from docketspark.schema import ALL, BOARD, BOARD_SIZE, MANAGERS, MEETING, PAGE_SIZE, RECRUIT


@dataclass(frozen=True)
class CaseQuery:
    """What a list shows. starred: None is no filter, an empty list no rows. manager: a name, or "other" for everyone unnamed."""

    text: str | None = None
    status: str | None = None
    manager: str | None = None
    recent_days: int | None = None
    starred: tuple[int, ...] | None = None
    page: int = 1
    size: int = PAGE_SIZE


#: Fields of a search and their weights; the body weighs least.
WEIGHTS = (("title", 10), (("category", "tech"), 5), ("client_name", 3))
BODY_WEIGHT = 1
SEARCHED = tuple(f for fields, _ in WEIGHTS for f in ((fields,) if isinstance(fields, str) else fields))
#: Sessions that a list shows.
SESSIONS, PREVIEW = 100, 160
LIST_COLUMNS = ("id", "title", "client_name", "category", "status", "stage", "budget", "budget_monthly", "contract_amount", "proposal_count", "inspection_manager", "recruit_started_at")


def meeting_ids(timeline: DataFrame) -> DataFrame:
    return timeline.filter("source = 'meeting'").select(F.col("project_id").alias("meeting_id")).distinct()


def manager_filter(manager: str, names: dict[str, str] = MANAGERS) -> Column:
    account = F.col("inspection_manager")
    if manager == "other":
        return account.isNull() | ~account.isin(*names)
    accounts = [a for a, n in names.items() if n == manager]
    return account.isin(*accounts) if accounts else F.lit(False)


def status_filter(rows: DataFrame, timeline: DataFrame, status: str | None) -> DataFrame:
    """Recruiting cases split by whether a meeting has begun; any other state by equality."""
    if not status or status == ALL:
        return rows
    if status in (MEETING, RECRUIT):
        how = "left_semi" if status == MEETING else "left_anti"
        return rows.filter(F.col("status") == RECRUIT).join(meeting_ids(timeline), F.col("id") == F.col("meeting_id"), how)
    return rows.filter(F.col("status") == status)


def with_body_hits(rows: DataFrame, links: DataFrame, texts: DataFrame, tokens: list[str]) -> DataFrame:
    """rows with `body_hits`, for each search word whether the case's body holds it; null without a body.

    The words are looked for where the texts are read, once a text; only the flags move. links: project_id, text_id; texts: text_id, posting_raw.
    """
    hits = F.array(*[e.matches([F.col("posting_raw")], t) for t in tokens])
    found = links.join(texts.select("text_id", hits.alias("body_hits")), "text_id").select(F.col("project_id").alias("body_id"), "body_hits")
    return rows.join(found, F.col("id") == F.col("body_id"), "left").drop("body_id")


def filtered(projects: DataFrame, timeline: DataFrame, bodies: tuple[DataFrame, DataFrame], q: CaseQuery, as_of: Column, include_status: bool = True) -> DataFrame:
    """Live cases that q describes, with `score` (0 without search words). bodies: links and texts, as with_body_hits() takes them."""
    tokens = e.tokens_of(q.text)
    conditions = [e.live()]
    if q.manager:
        conditions.append(manager_filter(q.manager))
    if q.recent_days:
        conditions.append(F.col("recruit_started_at") > as_of - F.expr(f"INTERVAL '{q.recent_days + 1}' DAY"))
    if q.starred is not None:
        conditions.append(F.col("id").isin(*q.starred) if q.starred else F.lit(False))
    rows = projects.filter(reduce(lambda a, b: a & b, conditions))
    rows = status_filter(rows, timeline, q.status) if include_status else rows
    if not tokens:
        return rows.withColumn("score", F.lit(0))
    rows = with_body_hits(rows, *bodies, tokens)
    body = [F.coalesce(F.col("body_hits")[i], F.lit(False)) for i in range(len(tokens))]
    fields = [F.col("id").cast("string"), *[F.col(f) for f in SEARCHED]]
    hit = reduce(lambda a, b: a & b, [e.matches(fields, t) | b for t, b in zip(tokens, body, strict=True)])
    in_body = reduce(lambda a, b: a + b, [F.when(b, BODY_WEIGHT).otherwise(0) for b in body])
    score = e.relevance([(F.col(f) if isinstance(f, str) else F.concat_ws("\n", *f), w) for f, w in WEIGHTS], tokens)
    return rows.filter(hit).withColumn("score", score + in_body).drop("body_hits")


def ordering() -> list[Column]:
    return [F.desc("score"), F.col("recruit_started_at").desc_nulls_last(), F.desc("id")]


def page(rows: DataFrame, number: int = 1, size: int = PAGE_SIZE) -> DataFrame:
    """One page in order, with the true total in each row; the total is a count of its own, not a window in one task."""
    total = rows.agg(F.count("*").alias("total"))
    cut = rows.orderBy(*ordering()).offset((max(number, 1) - 1) * size).limit(size)
    return cut.crossJoin(F.broadcast(total))  # a page and one row


def low_supply_page(projects: DataFrame, insights: DataFrame, number: int = 1, size: int = PAGE_SIZE) -> DataFrame:
    """Decided live cases with few proposals, by page, with total and page; an empty page still is one row with the total."""
    rows = projects.filter(e.live() & e.decided() & e.low_supply()).withColumn("score", F.lit(0))
    total = rows.agg(F.count("*").alias("total"))
    cut = rows.orderBy(*ordering()).offset((number - 1) * size).limit(size).join(insights.select("project_id", "supply_tags"), F.col("id") == F.col("project_id"), "left")
    return F.broadcast(total).join(cut, F.lit(True), "left").select("id", "title", "proposal_count", F.array_join("supply_tags", ",").alias("tags"), "total", F.lit(number).alias("page"))


def board_status(rows: DataFrame, timeline: DataFrame) -> DataFrame:
    """Rows with board_status: recruiting cases whose meetings have begun stand apart."""
    flagged = rows.join(meeting_ids(timeline), F.col("id") == F.col("meeting_id"), "left")
    return flagged.withColumn("board_status", F.when((F.col("status") == RECRUIT) & F.col("meeting_id").isNotNull(), MEETING).otherwise(F.col("status"))).drop("meeting_id")


def board(rows: DataFrame, timeline: DataFrame, top: int = BOARD_SIZE) -> DataFrame:
    """The first cases of each board column; ranking alone, so that each task keeps only the first of its rows."""
    own = Window.partitionBy("board_status").orderBy(*ordering())
    return board_status(rows, timeline).withColumn("rank", F.row_number().over(own)).filter(F.col("rank") <= top)


def board_columns(rows: DataFrame, timeline: DataFrame) -> DataFrame:
    """Every board column in its fixed order with its total, empty ones too."""
    spark = rows.sparkSession
    names = spark.createDataFrame([(i, s) for i, s in enumerate(BOARD)], "position int, board_status string")
    totals = board_status(rows, timeline).groupBy("board_status").agg(F.count("*").alias("n"))
    return names.join(F.broadcast(totals), "board_status", "left").select("position", "board_status", F.coalesce("n", F.lit(0)).alias("total"))  # seven rows


def detail(projects: DataFrame, case_id: str) -> DataFrame:
    """The live case of an id given as text; no rows if it is no number."""
    return projects.filter(e.live() & (F.col("id") == int(case_id))) if case_id.isascii() and case_id.isdigit() else projects.limit(0)


def milestones(projects: DataFrame) -> DataFrame:
    """id, at, stage, title of the dates that a case has reached."""
    return projects.select("id", F.expr("stack(4, recruit_started_at, '모집', '모집 시작', progress_started_at, '진행', '진행 착수', completed_at, '완료', '완료', cancelled_at, '완료(취소)', '취소') AS (at, stage, title)")).filter("at is not null")


def merged_timeline(projects: DataFrame, timeline: DataFrame) -> DataFrame:
    """Milestones and events (but for state changes, which the milestones show) in order of time within each case."""
    events = timeline.filter("source <> 'status'").select(F.col("project_id").alias("id"), F.col("event_at").alias("at"), F.col("source").alias("stage"), F.coalesce("title", F.lit("")).alias("title"))
    both = milestones(projects).unionByName(events)
    return both.withColumn("position", F.row_number().over(Window.partitionBy("id").orderBy(F.col("at").asc_nulls_last(), "stage", "title")))


def nested_events(timeline: DataFrame) -> DataFrame:
    """Per case its events as an ordered list of (event_at, source, title), missing times last."""
    one = F.struct(F.col("event_at").isNull().alias("missing"), "event_at", "id", "source", "title")
    return timeline.groupBy("project_id").agg(F.sort_array(F.collect_list(one)).alias("events"))


def sessions_of(sessions: DataFrame, owner: str, top: int = SESSIONS) -> DataFrame:
    """An owner's latest sessions: id, title, times, calls, whether there is a draft, and the source's first characters."""
    own = sessions.filter(F.col("owner") == owner).orderBy(F.desc("updated_at"), F.desc("id")).limit(top)
    calls = F.coalesce(F.array_size("call_ids"), F.lit(0))
    return own.select("id", "title", "updated_at", "created_at", calls.alias("call_count"), F.col("draft").isNotNull().alias("has_draft"), F.left("source_text", F.lit(PREVIEW)).alias("preview"))


def session_of(sessions: DataFrame, owner: str, session_id: int) -> DataFrame:
    """One session by id, for its owner only."""
    return sessions.filter((F.col("id") == session_id) & (F.col("owner") == owner)).select("id", "title", "updated_at", "source_text", "draft")
