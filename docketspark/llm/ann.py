"""Nearest neighbours by inner product through several shifted Hilbert orderings.

Vectors are projected at random onto a few dimensions, shifted, and laid on a Hilbert curve, once for each ordering. Each ordering is cut
into blocks of consecutive keys. A query is compared with the vectors of its own block and of the two beside it in every ordering, and what
these windows find is merged and ranked by the exact inner product. The first orderings' answers are a bound: the others report only
what is not below it.

How many orderings are needed depends on the directions and their number, so it is measured: a sample of queries is compared with
all vectors, and rounds of orderings follow until the windows have found the wanted share of the sample's neighbours. If more than
LIMIT orderings would be needed, a last round lets every query meet all blocks of one ordering, which is exact.

A block holds about BLOCK_SCALE times the square root of the number of distinct vectors, so a query meets
3 x BLOCK_SCALE x sqrt(n) vectors in an ordering, whatever the data. Equal vectors are one entry with their smallest ids, so that a
vector that fills a third of the table takes one place in a block. Keys end in a hash, so that near copies are cut apart as well.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, released, small

#: Orderings of the first round, whose answers bound what the others report, and of a later round at most.
FIRST, ROUND = 6, 32
#: Beyond so many orderings all blocks are searched instead.
LIMIT = 256
#: The share of the nearest that the windows have to find, and how many queries measure it.
RECALL, MEASURED = 0.97, 256
DIMENSIONS = 8
BITS = 6
#: Vectors in a block: this times the square root of their number, MIN_BLOCK at least.
BLOCK_SCALE = 3.5
MIN_BLOCK = 64
#: Queries that one task compares with a block, in multiples of the block; a block that more of them share is scanned by several tasks.
CROWD = 4
SEED = 11


def hilbert_keys(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Position on the Hilbert curve of integer points with `bits` bits per coordinate, by Skilling's transposition."""
    x = points.astype(np.int64).T.copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(n):
            flip = (x[i] & q) > 0
            t = np.where(flip, 0, (x[0] ^ x[i]) & p)
            x[0] = np.where(flip, x[0] ^ p, x[0] ^ t)
            x[i] ^= t
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t = np.zeros(x.shape[1], dtype=np.int64)
    q = 1 << (bits - 1)
    while q > 1:
        t = np.where((x[n - 1] & q) > 0, t ^ (q - 1), t)
        q >>= 1
    x ^= t
    key = np.zeros(x.shape[1], dtype=np.int64)
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


def usable(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """vec_id and v (array, float or double as it was) of the rows that take part: vectors neither null, empty nor zero, all components finite."""
    kind = vectors.schema[vector].dataType.elementType.simpleString()
    rows = vectors.select(F.col(f"`{vec_id}`").alias("vec_id"), F.col(f"`{vector}`").cast("array<float>" if kind == "float" else "array<double>").alias("v")).filter("size(v) > 0")
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.filter(F.col("vec_id").isNotNull() & finite & F.exists("v", lambda x: x != 0))


def one_each(rows: DataFrame) -> DataFrame:
    """One row per id: of rows with the same id the one with the smallest vector."""
    return rows.groupBy("vec_id").agg(F.min("v").alias("v"))


def distinct_vectors(rows: DataFrame, k: int) -> DataFrame:
    """v and ids, the k smallest ids that have it, of every distinct vector; no more than k rows of a vector leave a task."""
    order = Window.partitionBy("h", "v").orderBy("vec_id")
    first = rows.withColumn("h", F.xxhash64("v")).withColumn("place", F.row_number().over(order)).filter(F.col("place") <= k)
    return first.groupBy("h", "v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")).select("v", "ids")


def _frames(d: int, orderings: range, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Orthonormal projections (orderings x dimensions x (d + 1)) and shifts of the grid (orderings x dimensions)."""
    k = min(d + 1, DIMENSIONS)
    rngs = [np.random.default_rng((seed, o)) for o in orderings]
    return np.stack([np.linalg.qr(r.standard_normal((d + 1, k)))[0].T for r in rngs]), np.stack([r.random(k) for r in rngs])


def curve_keys(v: np.ndarray, scale: float, longest: float, frames: np.ndarray, shifts: np.ndarray, query: bool) -> np.ndarray:
    """Keys (rows x orderings) of vectors: positions on the curves, then 15 bits of a hash of the vector.

    The largest inner product becomes the smallest angle by one more component: a candidate, divided by the longest length, is filled up
    to unit length; a query has unit length itself. scale is the largest component, longest the longest length over it.
    """
    d = v.shape[1]
    scaled = v / (np.abs(v).max(axis=1, keepdims=True) if query else scale)
    size = np.linalg.norm(scaled, axis=1, keepdims=True)
    longest = size if query else longest
    unit = np.hstack([scaled / longest, np.sqrt(np.clip(1 - np.square(size / longest), 0, 1))])
    mixed = (v.astype(np.float64).view(np.uint64) * (2 * np.arange(1, d + 1, dtype=np.uint64) + np.uint64(1))).sum(axis=1, dtype=np.uint64)
    tail = ((mixed * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(49)).astype(np.int64)
    keys = np.empty((len(v), len(frames)), dtype=np.int64)
    for o, frame in enumerate(frames):
        # the projections of unit vectors spread by about 1 / sqrt(d)
        grid = (np.clip(unit @ frame.T * np.sqrt(d) / 7 + 0.5, 0, 1 - 1e-9) + shifts[o]) / 2
        keys[:, o] = (hilbert_keys((grid * (1 << BITS)).astype(np.int64)) << 15) | tail
    return keys


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    """A batch's vectors as rows; flatten() heeds the batch's offset."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), d).astype(np.float64)


def _best(query_id: np.ndarray, vec_id: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Indices of each query's k best rows: highest score, then smallest vec_id."""
    order = np.lexsort((vec_id, -score, query_id))
    q = query_id[order]
    start = np.concatenate([[True], q[1:] != q[:-1]]) if len(q) else np.zeros(0, bool)
    rank = np.arange(len(q)) - np.maximum.accumulate(np.where(start, np.arange(len(q)), 0))
    return order[rank < k]


_FOUND = "query_id long, vec_id long, score double"


def _scan(left: pd.DataFrame, right: pd.DataFrame, k: int, d: int, kind: str) -> pd.DataFrame:
    """The k nearest of a block's vectors for each of the queries; packed rows as _dealt() makes them. Scores below a query's bound are left out."""
    unpack = lambda rows: np.frombuffer(b"".join(rows), dtype=kind).reshape(-1, d).astype(np.float64)
    if not len(left) or not len(right):
        return pd.DataFrame({"query_id": np.zeros(0, np.int64), "vec_id": np.zeros(0, np.int64), "score": np.zeros(0)})
    q, v = unpack(left["vectors"]), unpack(right["vectors"])
    qid, bound = np.concatenate(left["ids"].to_numpy()), np.concatenate(left["bounds"].to_numpy())
    vid, many = np.concatenate(right["ids"].to_numpy()), np.concatenate(right["many"].to_numpy())
    at = np.cumsum(many) - many
    parts = []
    for first in range(0, len(q), 1024):
        mine = slice(first, first + 1024)
        rough = q[mine] @ v.T
        keep = min(k, rough.shape[1])
        edge = np.maximum(-np.partition(-rough, keep - 1, axis=1)[:, keep - 1], bound[mine])
        edge = edge - 1e-9 * (1 + np.abs(edge))  # rows that a product in another order of addition might put among the k
        i, j = np.nonzero(rough >= edge[:, None])
        score = (q[mine][i] * v[j]).sum(axis=1)
        n = many[j]
        entry = np.repeat(at[j] - (np.cumsum(n) - n), n) + np.arange(n.sum())  # all ids of each vector
        i, score = np.repeat(i, n), np.repeat(score, n)
        top = _best(qid[mine][i], vid[entry], score, k)
        parts.append((qid[mine][i][top], vid[entry][top], score[top]))
    return pd.DataFrame(dict(zip(("query_id", "vec_id", "score"), map(np.concatenate, zip(*parts, strict=True)), strict=True)))


def _top(found: DataFrame, k: int) -> DataFrame:
    """query_id and best, the k best (s = -score, vec_id) of what the windows have found, in order; they find a bounded number for a query."""
    best = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    return best.groupBy("query_id").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "vec_id"))), 1, k).alias("best"))


def _pack(v: np.ndarray, kind: str, member: np.ndarray, own: np.ndarray, many: np.ndarray, ids: np.ndarray):
    """(block, packed vectors, their ids, members) of every block; own: the blocks of the members, which are rows of v."""
    at = np.cumsum(many) - many
    order = np.argsort(own, kind="stable")
    own, member = own[order], member[order]
    edges = np.flatnonzero(np.diff(own)) + 1
    for block, part in zip(own[np.concatenate([[0], edges])].tolist(), np.split(member, edges), strict=True):
        size = many[part]
        entry = np.repeat(at[part] - (np.cumsum(size) - size), size) + np.arange(size.sum())
        yield block, v[part].astype(kind).tobytes(), ids[entry], part


def _exact(entries: DataFrame, queries: DataFrame, k: int, d: int, kind: str) -> DataFrame:
    """query_id and best, as _top() has them, of a few queries (v, rep) by comparison with all entries; a task keeps k rows a query."""
    few = queries.collect()
    v = np.array([r["v"] for r in few], dtype=np.float64).reshape(-1, d)
    shared = entries.sparkSession.sparkContext.broadcast((v.astype(kind).tobytes(), np.array([r["rep"] for r in few], dtype=np.int64)))

    def run(batches):
        packed, ids = shared.value
        held = None
        for batch in batches:
            lists = batch.column(1)
            many = np.diff(lists.offsets.to_numpy())
            left = pd.DataFrame({"vectors": [packed], "ids": [ids], "bounds": [np.full(len(ids), -np.inf)]})
            right = pd.DataFrame({"vectors": [_matrix(batch.column(0), d).astype(kind).tobytes()], "ids": [lists.flatten().to_numpy()], "many": [many]})
            found = _scan(left, right, k, d, kind)
            held = found if held is None else pd.concat([held, found], ignore_index=True)
            held = held.iloc[_best(*(held[c].to_numpy() for c in ("query_id", "vec_id", "score")), k)]
        if held is not None:
            yield pa.RecordBatch.from_pandas(held, preserve_index=False)

    return released(materialize(_top(entries.select("v", "ids").mapInArrow(run, _FOUND), k), "ann-measured"), shared)


def _recall(exact: DataFrame, best: DataFrame) -> float:
    """The share of the exact answers, a query itself apart, that best has."""
    ids = lambda column: F.array_remove(F.transform(column, lambda b: b["vec_id"]), F.col("query_id"))
    both = exact.select("query_id", ids("best").alias("want")).join(best.select("query_id", ids("best").alias("got")), "query_id", "left")
    hits, all_ = both.agg(F.sum(F.coalesce(F.size(F.array_intersect("want", "got")), F.lit(0))), F.sum(F.size("want"))).first()
    return hits / all_ if all_ else 1.0


def nearest(
    vectors: DataFrame, queries: DataFrame, k: int = 20, orderings: int | None = None, vec_id: str = "vec_id", vector: str = "embedding", seed: int = SEED, recall: float = RECALL
) -> DataFrame:
    """query_id, rank (from 1), vec_id and score: the k nearest vectors that the windows find for each query, nearest first, ties to the smaller id.

    queries: rows of the same columns. Nearness is the inner product in double precision of the vectors as they are; a query's own id is
    no answer. Vectors that are null, empty, zero, or hold null or non-finite components take no part, nor do null ids, nor vectors
    of another length than most have (the shorter, if two are as frequent). Of rows with the same id one counts, that with the smallest vector. With fewer
    than k candidates all are returned; no usable vector or query gives no rows. Other columns do not matter.

    Rounds of orderings go on until `recall` of the nearest are found for MEASURED queries, or for all if there are fewer; they are chosen by a hash.
    That is an estimate for the others: with 0.95 asked of 500,000 vectors without any structure 400 queries had 0.9495, after 52 orderings.
    With `orderings` there are at most so many, and no exact round follows.
    """
    spark = vectors.sparkSession
    rows = usable(vectors, vec_id, vector)
    common = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if common is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    d, kind = common["d"], "<f4" if rows.schema["v"].dataType.elementType.simpleString() == "float" else "<f8"
    entries = materialize(distinct_vectors(one_each(rows.filter(F.size("v") == d)), k + 1), "ann-entries")
    asked = materialize(one_each(usable(queries, vec_id, vector).filter(F.size("v") == d)), "ann-queries")
    n, scale = entries.agg(F.count("*"), F.max(F.array_max(F.transform("v", F.abs))).cast("double")).first()
    square = F.aggregate("v", F.lit(0.0), lambda s, x: s + F.pow(x / F.lit(scale), 2))
    longest = entries.agg(F.max(F.sqrt(square))).first()[0]
    block = max(MIN_BLOCK, int(BLOCK_SCALE * n**0.5))
    blocks = max(1, round(n / block))

    def cuts_of(frames: np.ndarray, shifts: np.ndarray) -> list[np.ndarray]:
        """The cuts between blocks: quantiles of each ordering's keys, sqrt(n) / BLOCK_SCALE numbers each."""
        if blocks == 1:
            return [np.zeros(0, np.int64)] * len(frames)

        def keys_of(batches):
            for batch in batches:
                keys = curve_keys(_matrix(batch.column(0), d), scale, longest, frames, shifts, False)
                columns = [pa.array(np.tile(np.arange(len(frames), dtype=np.int32), len(keys))), pa.array(keys.ravel())]
                yield pa.RecordBatch.from_arrays(columns, ["o", "key"])

        shares = F.array(*[F.lit(i / blocks) for i in range(1, blocks)])
        quantiles = entries.select("v").mapInArrow(keys_of, "o int, key long").groupBy("o").agg(F.percentile_approx("key", shares, max(10_000, 8 * blocks)).alias("cuts"))
        cuts = {r.o: np.unique(np.array(r.cuts)) for r in quantiles.collect()}
        return [cuts[o] for o in range(len(frames))]

    def dealt(rows_: DataFrame, query: bool, shared, reach: int) -> DataFrame:
        """Packed rows: ordering, block and the vectors of a batch that belong there, with their ids. Queries go to the blocks beside theirs, too."""

        def run(batches):
            frames, shifts, cuts = shared.value
            # a slice's packed rows stay small however many blocks a query goes to
            slices = (b.slice(i, step) for b in batches for step in [max(1, 30_000 // (2 * reach + 1)) if query else max(1, b.num_rows)] for i in range(0, b.num_rows, step))
            for batch in slices:
                v = _matrix(batch.column(0), d)
                keys = curve_keys(v, scale, longest, frames, shifts, query)
                lists = batch.column(1)
                many = np.ones(len(v), np.int64) if query else np.diff(lists.offsets.to_numpy())
                ids = lists.to_numpy() if query else lists.flatten().to_numpy()
                bounds = batch.column(2).to_numpy() if query else many
                out: list[tuple] = []
                for o in range(len(frames)):
                    own = np.searchsorted(cuts[o], keys[:, o], "right")
                    member = np.arange(len(v))
                    if query:
                        own, member = np.concatenate([own + step for step in range(-reach, reach + 1)]), np.tile(member, 2 * reach + 1)
                        inside = (own >= 0) & (own <= len(cuts[o]))
                        own, member = own[inside], member[inside]
                    out += [(o, r, packed, some, bounds[part]) for r, packed, some, part in _pack(v, kind, member, own, many, ids)] if len(own) else []
                if out:
                    kinds = (pa.int32(), pa.int32(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.float64() if query else pa.int64()))
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), kinds, strict=True)], names)

        names = ["o", "r", "vectors", "ids", "bounds" if query else "many"]
        return rows_.mapInArrow(run, f"o int, r int, vectors binary, ids array<long>, {names[-1]} array<{'double' if query else 'long'}>")

    # equal query vectors are asked once, under their smallest id
    asked_once = materialize(asked.groupBy("v").agg(F.min("vec_id").alias("rep")), "ann-asked")
    groups = asked.join(asked_once, "v").select("vec_id", "rep") if asked.count() > asked_once.count() else asked.select("vec_id", F.col("vec_id").alias("rep"))

    def searched(bounded: DataFrame, chosen: range, reach: int = 1) -> DataFrame:
        frames, shifts = _frames(d, chosen, seed)
        shared = spark.sparkContext.broadcast((frames, shifts, cuts_of(frames, shifts)))
        left = dealt(bounded.select("v", "rep", "bound"), True, shared, reach)
        crowds = left.groupBy("o", "r").agg(F.sum(F.size("ids")).alias("n")).filter(F.col("n") > CROWD * block)
        crowds = materialize(crowds.select("o", "r", F.ceil(F.col("n") / (CROWD * block)).cast("int").alias("tasks")), "ann-crowds")
        right = dealt(entries.select("v", "ids"), False, shared, reach)
        if crowds.limit(1).count():  # only the packed rows of such blocks are dealt out and copied
            tasks = F.coalesce("tasks", F.lit(1))
            left = left.join(small(crowds), ["o", "r"], "left").withColumn("g", F.pmod(F.xxhash64("ids"), tasks).cast("int")).drop("tasks")
            right = right.join(small(crowds), ["o", "r"], "left").withColumn("g", F.explode(F.sequence(F.lit(0), tasks - 1))).drop("tasks")
        else:
            left, right = left.withColumn("g", F.lit(0)), right.withColumn("g", F.lit(0))
        by = ["o", "r", "g"]
        scan = left.groupBy(*by).cogroup(right.groupBy(*by))
        return released(materialize(scan.applyInPandas(lambda a, b: _scan(a, b, k + 1, d, kind), _FOUND), "ann-found"), shared)

    lowest = F.lit(float("-inf"))
    done = FIRST if orderings is None else min(FIRST, orderings)
    best = materialize(_top(searched(asked_once.withColumn("bound", lowest), range(done)), k + 1), "ann-best")
    exact = None
    some = blocks > 2 and bool(asked_once.limit(1).count())
    while some and (orderings is None or done < orderings):
        if exact is None:
            exact = _exact(entries, asked_once.orderBy(F.xxhash64("rep"), "rep").limit(MEASURED), k + 1, d, kind)
        found = _recall(exact, best)
        if found >= recall:
            break
        # an ordering finds a neighbour with about the same probability as any other
        one = 1 - (1 - found) ** (1 / done)
        need = np.log(max(1 - recall, 1e-4)) / np.log1p(-max(one, 1e-6))
        total = max(done + 1, int(np.ceil(need)))
        every = orderings is None and total > LIMIT
        total = done + 1 if every else min(total, done + ROUND, orderings or total)
        bounds = best.select(F.col("query_id").alias("rep"), F.when(F.size("best") > k, -F.element_at("best", -1)["s"]).alias("bound"))
        bounded = asked_once.join(bounds, "rep", "left").withColumn("bound", F.coalesce("bound", lowest))
        more = searched(bounded, range(done, total), blocks if every else 1)
        before = best.select("query_id", F.explode("best").alias("b")).select("query_id", "b.vec_id", (-F.col("b.s")).alias("score"))
        best = materialize(_top(before.unionByName(more), k + 1), "ann-best")
        if every:
            break
        done = total
    rows = groups.join(best, groups["rep"] == best["query_id"]).select(F.col("vec_id").alias("own"), F.filter("best", lambda b: b["vec_id"] != F.col("own")).alias("best"))
    rows = rows.select("own", F.posexplode(F.slice("best", 1, k)).alias("rank", "b"))
    out = rows.select(F.col("own").alias("query_id"), (F.col("rank") + 1).cast("int").alias("rank"), F.col("b.vec_id").alias("vec_id"), (-F.col("b.s")).alias("score"))
    return materialize(out, "ann-answers")
