"""Incremental ingestion: mapping, admission, differences, snapshots and cursors. Everything is DataFrame to DataFrame."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docketspark.functions import exprs as e
from docketspark.schema import CANCELLED, CONTRACT, DIFF_FIELDS, POST_CONTRACT, PRE_CONTRACT, PROGRESS, RECRUIT, REVIEW, SUCCESS

STAGE = {REVIEW: 1, RECRUIT: 2, CONTRACT: 3, PROGRESS: 4, SUCCESS: 5, CANCELLED: 5}


def mapped_status() -> Column:
    """The case state of a raw row by the first rule that holds; null for states that are not synchronised."""
    agreed = e.truthy(F.col("has_valid_agreement"))
    done = e.non_empty(F.col("agreement_date_completed"))
    status = F.col("status")
    stopped = e.truthy(F.col("is_cancelled")) | e.truthy(F.col("is_rejected")) | e.non_empty(F.col("date_cancelled")) | e.non_empty(F.col("date_rejected"))
    return (
        F.when(stopped, CANCELLED)
        .when((status == "completed") | (agreed & done), SUCCESS)
        .when(agreed & e.non_empty(F.col("agreement_date_start_progress")) & ~done, PROGRESS)
        .when((status == "contracted") | agreed, CONTRACT)
        .when(status.isin("recruiting", "close_recruiting"), RECRUIT)
        .when(status == "submitted", REVIEW)
    )


def mapped(raw: DataFrame) -> DataFrame:
    """Raw rows as cases; rows whose state is not synchronised go. A zero initial budget means that none was recorded."""
    rows = raw.withColumn("state", mapped_status()).filter("state is not null")
    stages = F.create_map(*[F.lit(v) for kv in STAGE.items() for v in kv])
    reached = F.when(e.truthy(F.col("has_valid_agreement")), CONTRACT).when(e.non_empty(F.col("date_start_recruitment")), RECRUIT).otherwise(REVIEW)
    number = lambda n: F.nullif(F.trim(n), F.lit("")).try_cast("double")
    return rows.select(
        "id", F.col("state").alias("status"), stages[F.col("state")].alias("stage"), F.when(F.col("state") == CANCELLED, reached).alias("cancel_stage"),
        F.nullif(number("initial_budget"), F.lit(0.0)).cast("long").alias("initial_budget"), number("term").cast("int").alias("term_days"), (F.coalesce("term_type", F.lit("")) == "month").alias("budget_monthly"),
        (F.col("is_turnkey") == 1).alias("is_turnkey"),
    )


def last_wins(rows: DataFrame, keys: list[str], ordinal: str) -> DataFrame:
    """One row per key, the latest of the batch; of rows with the same ordinal always the same one."""
    order = Window.partitionBy(*keys).orderBy(F.desc(ordinal), F.xxhash64(*rows.columns))
    return rows.withColumn("__n", F.row_number().over(order)).filter("__n = 1").drop("__n")


def split_known(rows: DataFrame, key: str, known: DataFrame, known_key: str) -> tuple[DataFrame, DataFrame]:
    """Rows whose key is known, and the others."""
    ids = known.select(F.col(known_key).alias(key)).distinct()
    return rows.join(ids, key, "left_semi"), rows.join(ids, key, "left_anti")


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """The next snapshot: old rows without those that new replaces, and the new rows; of new rows with the same keys one (last_wins() chooses which)."""
    return old.join(new.select(*keys), keys, "left_anti").unionByName(new.dropDuplicates(keys), allowMissingColumns=True)


def insert_ignore(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    return old.unionByName(new.dropDuplicates(keys).join(old.select(*keys), keys, "left_anti"), allowMissingColumns=True)


def changed_only(old: DataFrame, new: DataFrame, key: str, value: str) -> DataFrame:
    """Known keys whose value differs (null counts as a value): key, before, after."""
    both = old.select(key, F.col(value).alias("before")).join(new.select(key, F.col(value).alias("after")), key)
    return both.filter(~F.col("before").eqNullSafe(F.col("after")))


def delete(old: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    return old.join(gone.select(*keys).distinct(), keys, "left_anti")


def upsert_owned(old: DataFrame, new: DataFrame, key: str, owner: str) -> DataFrame:
    """Rows replace those of the same id and owner; rows of a foreign id are inserted under new ids after the greatest one, in their order.

    New ids come from counts of key ranges and ranks within a range, so no task sees all rows.
    """
    mine = new.join(old.select(key, owner), [key, owner], "left_semi")
    other = new.join(old.select(key, owner), [key, owner], "left_anti")
    span = F.floor(F.col(key) / 65_536)
    sums = other.groupBy(span.alias("__range")).agg(F.count("*").alias("__n"))
    sums = sums.select("__range", F.coalesce(F.sum("__n").over(Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))  # a row per range
    top = old.agg(F.coalesce(F.max(key), F.lit(0)).alias("__top"))
    rank = F.row_number().over(Window.partitionBy("__range").orderBy(key, owner))
    placed = other.withColumn("__range", span).withColumn("__rank", rank).join(sums, "__range").crossJoin(F.broadcast(top))  # one row
    fresh = placed.withColumn(key, F.col("__top") + F.col("__before") + F.col("__rank")).select(*new.columns)
    return upsert(old, mine, [key, owner]).unionByName(fresh)


def update_counts(old: DataFrame, batches: DataFrame, key: str = "id", field: str = "proposal_count", ids: str = "ids", counts: str = "counts") -> DataFrame:
    """Rows of old whose count differs from that in a batch's parallel arrays, with the new count; of a repeated id the greatest count. No row is added."""
    pairs = batches.select(F.explode(F.arrays_zip(F.col(ids).alias("k"), F.col(counts).alias("v"))).alias("p")).select(F.col("p.k").alias(key), F.col("p.v").alias("new"))
    pairs = pairs.filter(F.col(key).isNotNull()).groupBy(key).agg(F.max("new").alias("new"))
    both = old.join(pairs, key)
    return both.filter(~F.col(field).eqNullSafe(F.col("new"))).withColumn(field, F.col("new")).select(*old.columns)


def rescan(rows: DataFrame, at: str, as_of: Column, days: int = 60) -> DataFrame:
    """Rows of the last days, all of them whatever the cursor says; the sink's keys make a repeated scan harmless."""
    return rows.filter(F.col(at) >= as_of - F.expr(f"INTERVAL '{days}' DAY"))


def differences(before: DataFrame, after: DataFrame, fields: dict[str, str] = DIFF_FIELDS) -> DataFrame:
    """id, field, before, after (as text) of the fields that differ in rows that both snapshots have."""
    used = {f: n for f, n in fields.items() if f in before.columns and f in after.columns}
    both = before.select("id", *[F.col(f).alias(f"b_{f}") for f in used]).join(after.select("id", *[F.col(f).alias(f"a_{f}") for f in used]), "id")
    one = lambda f, n: F.when(~F.col(f"b_{f}").eqNullSafe(F.col(f"a_{f}")), F.struct(F.lit(n).alias("field"), F.col(f"b_{f}").cast("string").alias("before"), F.col(f"a_{f}").cast("string").alias("after")))
    return both.select("id", F.inline(F.array_compact(F.array(*[one(f, n) for f, n in used.items()]))))


def change_events(diff: DataFrame, modified: Column) -> DataFrame:
    """Timeline events of differences; the source id makes a repeated batch harmless."""
    source = F.when(F.col("field") == "status", "status").otherwise("change")
    return diff.select(F.col("id").alias("project_id"), source.alias("source"), F.concat_ws(":", F.col("id").cast("string"), "field", modified).alias("source_id"), "field", "before", "after")


def contract_signed(diff: DataFrame) -> DataFrame:
    """State changes from before a contract to after one."""
    return diff.filter((F.col("field") == "status") & F.col("before").isin(*PRE_CONTRACT) & F.col("after").isin(*POST_CONTRACT))


def invalidate_embeddings(old: DataFrame, new: DataFrame) -> DataFrame:
    """new (id, content_hash) with the old embedding where the content is the same, else null."""
    before = old.select("id", F.col("content_hash").alias("old_hash"), "embedding")
    return new.join(before, "id", "left").withColumn("embedding", F.when(F.col("old_hash").eqNullSafe(F.col("content_hash")), F.col("embedding"))).drop("old_hash")


def admitted_calls(rows: DataFrame, known: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Calls to store; those rejected for good (low confidence); those to try again (unknown case)."""
    good = rows.filter(F.coalesce(F.col("confidence") != "low", F.lit(True)))
    ready, waiting = split_known(good, "project_id", known, "id")
    return ready, rows.filter("confidence = 'low'"), waiting


def valid_counts(rows: DataFrame, column: str) -> DataFrame:
    """Rows whose text is a whole number of at least 0; null and blank are none."""
    n = F.nullif(F.trim(column), F.lit("")).try_cast("double")
    return rows.withColumn("count", n).filter((n >= 0) & (n == F.floor(n))).withColumn("count", F.col("count").cast("long"))


def timeline_batch_error(sources: list[str | None], server_only: tuple[str, ...] = ("status", "change")) -> str | None:
    """Why a batch of these sources is refused: a source that only the server writes, none, or more than one."""
    distinct = set(sources)
    if not distinct or None in distinct:
        return "source missing"
    if distinct & set(server_only):
        return "source is written by the server"
    return "one source per batch" if len(distinct) > 1 else None


def keyset_page(rows: DataFrame, ts: str, key: str, after: tuple | None, limit: int) -> DataFrame:
    """The next rows behind a (time, id) cursor; from the start without one."""
    rows = rows.filter((F.col(ts) > F.lit(after[0])) | ((F.col(ts) == F.lit(after[0])) & (F.col(key) > after[1]))) if after else rows
    return rows.orderBy(F.col(ts).asc_nulls_last(), key).limit(limit)


def settled(rows: DataFrame, ts: str, as_of: Column, minutes: int = 2) -> DataFrame:
    """Rows older than the newest minutes, which may still change; they come with a later call."""
    return rows.filter(F.col(ts) < as_of - F.expr(f"INTERVAL '{minutes}' MINUTE"))


def cursor_text(ts: Column, key: Column) -> Column:
    return F.concat_ws("|", ts.cast("string"), key.cast("string"))


def cursor_parts(text: Column) -> Column:
    """(ts, id) of a cursor text, parted at the last bar."""
    key = F.substring_index(text, "|", -1)
    return F.struct(F.left(text, F.length(text) - F.length(key) - 1).alias("ts"), key.try_cast("long").alias("id"))


def greatest_cursor(rows: DataFrame, ts: str, key: str) -> DataFrame:
    """The cursor text of the latest row; ids compare as numbers."""
    top = F.max(F.struct(F.col(ts).alias("ts"), F.col(key).cast("long").alias("id")))
    return rows.agg(cursor_text(top["ts"], top["id"]).alias("cursor"))


def next_cursor(policy: str, current: str | None, reached: str | None, waiting: int = 0, given: str | None = None) -> str | None:
    """The cursor to store: "always" moves on, "complete" only if no row waits, "given" takes the caller's even for an empty batch, "never" stays."""
    if policy == "never" or (policy == "complete" and waiting):
        return current
    if policy == "given" and given is not None:
        return given
    return reached if reached is not None else current
