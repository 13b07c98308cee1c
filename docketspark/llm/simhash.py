"""Near-duplicate groups of documents by SimHash fingerprints.

Close fingerprints are found through pigeonhole blocks: the 64 bits are cut into `blocks` blocks; two fingerprints that
differ in at most `distance` bits agree in at least blocks - distance whole blocks, so they meet under one of the
keys made of that many blocks. Under a key everything is first compared with one member, the fingerprint that most
documents have. Only members too far from it ("apart") still have to be compared with the others, so a large
group of near copies costs a row per member and not a row per pair. Crowded keys are dealt over several tasks.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, numbered, rows_of, small, whole_runs

DISTANCE = 4
SHINGLE = 4
SEED = 42
#: Members of a key that are compared with each other at a time; the pairs of such parts are dealt over tasks.
CHUNK = 2048


def fingerprint_bytes(texts: list[bytes], shingle: int = SHINGLE, seed: int = SEED) -> np.ndarray:
    """SimHash of each text: bit i is set if it is set in over half of the hashes of the text's word shingles."""
    out = np.zeros(len(texts), dtype=np.uint64)
    hashes: list[int] = []
    owner_sizes: list[int] = []
    digest = xxhash.xxh64_intdigest
    for text in texts:
        words = text.lower().split()
        if len(words) <= shingle:
            found = [digest(b" ".join(words), seed)] if words else []
        else:
            joined = b" ".join(words)
            length = np.fromiter(map(len, words), np.int64, len(words))
            end = np.cumsum(length + 1) - 1
            begin = (end - length)[: len(words) - shingle + 1]
            found = [digest(joined[i:j], seed) for i, j in zip(begin.tolist(), end[shingle - 1 :].tolist(), strict=True)]
        hashes += found
        owner_sizes.append(len(found))
    if not hashes:
        return out
    values, sizes = np.array(hashes, dtype=np.uint64), np.array(owner_sizes)
    filled = np.flatnonzero(sizes)
    starts = (np.cumsum(sizes) - sizes)[filled]
    for bit in range(64):
        ones = np.add.reduceat((values >> np.uint64(bit)) & np.uint64(1), starts)
        out[filled] |= (2 * ones > sizes[filled].astype(np.uint64)).astype(np.uint64) << np.uint64(bit)
    return out


_spread = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").view(np.uint64).ravel()


def majority_bits(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """For each run of 64-bit hashes, none empty, the bits that are set in over half of them."""
    sizes = np.diff(np.append(starts, len(values)))
    # a byte counts to 255, so runs are counted in pieces of that length
    parts = -(-sizes // 255)
    first = np.cumsum(parts) - parts
    at = np.repeat(starts, parts) + 255 * (np.arange(int(parts.sum())) - np.repeat(first, parts))
    out = np.zeros(len(starts), dtype=np.uint64)
    for byte in range(8):
        counts = np.add.reduceat(_spread[(values >> np.uint64(8 * byte)) & np.uint64(255)], at).view(np.uint8).reshape(-1, 8)
        ones = np.add.reduceat(counts.astype(np.int64), first, axis=0)
        out |= np.packbits(2 * ones > sizes[:, None], axis=1, bitorder="little").ravel().astype(np.uint64) << np.uint64(8 * byte)
    return out


def fingerprints(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), shingle: int = SHINGLE, seed: int = SEED, out: str = "fp") -> DataFrame:
    """The columns `keep` and `out`, the fingerprint's 64 bits as a long. Null text counts as empty; no words: 0.

    Letters A-Z are lower-cased, words are runs without ASCII white space, whole texts are read; a text with fewer words
    than a shingle has is one shingle.
    """

    kept = list(keep)
    docs, (text, *columns) = numbered(docs, text, *kept)

    def run(batches):
        for part, texts in rows_of(batches, "text"):
            yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(len(columns))), pa.array(fingerprint_bytes(texts, shingle, seed).view(np.int64))], [*columns, "fp"])

    source = docs.select(*columns, F.col(text).cast("binary").alias("text"))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in source.schema.fields[:-1])
    return source.mapInArrow(run, f"{schema}, fp long").toDF(*kept, out)


def block_masks(blocks: int, distance: int = DISTANCE) -> list[int]:
    """Bit masks of the pigeonhole keys: every choice of blocks - distance whole blocks out of `blocks`."""
    edges = [round(64 * i / blocks) for i in range(blocks + 1)]
    part = [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:], strict=False)]
    return [sum(part[i] for i in chosen) for chosen in combinations(range(blocks), blocks - distance)]


def blocks_for(n: int, distance: int = DISTANCE) -> int:
    """The fewest blocks whose keys have at least log2(n) - 1 bits, so that unrelated fingerprints rarely share a key."""
    blocks = distance + 1
    while blocks < distance + 5 and 64 * (blocks - distance) / blocks < np.log2(max(n, 2)) - 1:
        blocks += 1
    return blocks


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _near(a: Column | str, b: Column | str, distance: int) -> Column:
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    return F.bit_count(a.bitwiseXOR(b)) <= distance


def _close_in_key(values: np.ndarray, core: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """Links that join the members of one key as all close pairs would; those in the core are joined already."""
    links: list[tuple[int, int]] = []
    apart = np.unique(values[~core])
    rest = np.unique(values[core])
    while len(apart):
        stack, apart = [apart[0]], apart[1:]
        while stack:
            x = stack.pop()
            near = np.bitwise_count(apart ^ x) <= distance
            for y in apart[near]:
                links.append((int(x), int(y)))
                stack.append(y)
            apart = apart[~near]
            if len(hit := np.flatnonzero(np.bitwise_count(rest ^ x) <= distance)):
                links.append((int(x), int(rest[hit[0]])))
    return links


def in_tiles(members: DataFrame, by: list[str], member: str, chunk: int, weight: Column | None = None) -> DataFrame:
    """members (with a boolean `core`) of the groups that have any outside the core, dealt into tiles: with x and y, the tile's name in its group.

    Parts of about `chunk` members, or of members of that weight together: each part of those apart meets each part of the core, and each other part of those apart; so no tile holds
    more than two parts, and every pair but those within the core meets in one.
    """
    total = lambda c: F.sum(F.when(c, F.lit(1) if weight is None else weight).otherwise(0))
    crowd = members.groupBy(*by).agg(total(F.col("core")).alias("n_core"), total(~F.col("core")).alias("n_apart"), F.count("*").alias("n_all")).filter("n_apart > 0 and n_all > 1").drop("n_all")
    parts = lambda c: F.ceil(F.col(c) / chunk).cast("int")
    own = lambda c: F.pmod(F.xxhash64(member), parts(c)).cast("int")
    upto = lambda c: F.when(parts(c) > 0, F.sequence(F.lit(0), parts(c) - 1)).otherwise(F.array().cast("array<int>"))
    tile = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    with_core = F.transform(upto("n_core"), lambda c: tile(c, own("n_apart")))
    with_apart = F.transform(upto("n_apart"), lambda a: tile(-1 - F.least(a, own("n_apart")), F.greatest(a, own("n_apart"))))
    tiles = F.when(F.col("core"), F.transform(upto("n_apart"), lambda a: tile(own("n_core"), a))).otherwise(F.concat(with_core, with_apart))
    return members.join(crowd, by).withColumn("tile", F.explode(tiles)).select(*members.columns, "tile.x", "tile.y")


def close_links(fps: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """Links (a, b) between distinct fingerprints with the same connected groups as all pairs at most `distance` apart.

    fps: one row per distinct fingerprint, with columns fp and n, its number of documents.
    """
    masks = block_masks(blocks_for(fps.count(), distance), distance)
    keys = F.array(*[F.struct(F.lit(i).alias("t"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key")) for i, m in enumerate(masks)])
    dealt = fps.select("fp", "n", F.inline(keys))
    centers = dealt.groupBy("t", "key").agg(F.count("*").alias("members"), F.max(F.struct("n", "fp")).alias("top")).filter("members > 1")
    centers = centers.select("t", "key", F.col("top.fp").alias("center"))
    members = materialize(dealt.select("t", "key", "fp").join(centers, ["t", "key"]), "simhash-members")
    core = _near("fp", "center", distance)
    star = members.filter(core & (F.col("fp") != F.col("center"))).select(F.col("fp").alias("a"), F.col("center").alias("b"))

    tasks = in_tiles(members.withColumn("core", core), ["t", "key"], "fp", CHUNK).select("t", "key", "x", "y", "fp", "core")

    def run(batches):
        for rows in whole_runs(batches, 4, 16 * CHUNK):
            by = [rows.column(i).to_numpy() for i in range(4)]
            fp, inner = rows.column(4).to_numpy().view(np.uint64), rows.column(5).to_numpy().astype(bool)
            cut = np.flatnonzero(np.any([c[1:] != c[:-1] for c in by], axis=0)) + 1
            links: list[tuple[int, int]] = []
            for first, end in zip([0, *cut.tolist()], [*cut.tolist(), len(fp)], strict=True):
                links += _close_in_key(fp[first:end], inner[first:end], distance)
            found = np.array(sorted(set(links)), dtype=np.uint64).reshape(-1, 2).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], ["a", "b"])

    by = ["t", "key", "x", "y"]
    more = tasks.repartition(*by).sortWithinPartitions(*by).mapInArrow(run, "a long, b long")
    return materialize(star.unionByName(more).distinct(), "simhash-links")


def groups_of_links(links: DataFrame) -> DataFrame:
    """Connected components of links (a, b): rows (node, root), root the smallest node; nodes without links are absent.

    Alternates the large-star and small-star steps: each node's neighbours are linked to the smallest node in reach, until
    nothing changes. Every step is a grouped minimum and a join; no neighbourhood is gathered.
    """
    edges = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct()
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        large = materialize(large, "components-large")
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        joined = large.join(least, "a")
        step = joined.filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
        edges = materialize(step.filter("a <> b").distinct(), "components-small")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    top = edges.select("b").distinct().select(F.col("b").alias("node"), F.col("b").alias("root"))
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(top)


def near_duplicate_groups(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", distance: int = DISTANCE, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, fp (long) and component_id, the smallest doc_id among all documents reachable through close fingerprints.

    Null and empty texts have fingerprint 0 and are one group. A null doc_id gets its group's component_id (null if the
    group has no other id); repeated rows stay. An empty table gives no rows.
    """
    docs, (text, doc_id) = numbered(docs, text, doc_id)
    rows = materialize(fingerprints(docs, text, (doc_id,), shingle).withColumnRenamed(doc_id, "doc_id"), "simhash-rows")
    return _with_components(rows, distance)


def _with_components(rows: DataFrame, distance: int) -> DataFrame:
    fps = materialize(rows.groupBy("fp").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id")), "simhash-distinct")
    roots = groups_of_links(close_links(fps.select("fp", "n"), distance))
    rooted = fps.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root"))
    rooted = materialize(rooted, "simhash-rooted")
    smallest = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    by_fp = rooted.select("fp", "root").join(smallest, "root").select("fp", "component_id")
    return rows.join(small(by_fp), "fp").select("doc_id", "fp", "component_id")


def keep_one_per_group(docs: DataFrame, distance: int = DISTANCE, shingle: int = SHINGLE, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The documents without near duplicates: of each group the one with the smallest doc_id stays (nulls last).

    All columns come back unchanged. Rows with the same doc_id are told apart by their fingerprint; of rows
    that agree in both, one stays.
    """
    names = docs.columns
    docs, (text, doc_id) = numbered(docs, text, doc_id)
    columns = docs.columns
    rows = fingerprints(docs, text, (doc_id,), shingle).withColumnRenamed(doc_id, "doc_id")
    rows = materialize(rows.groupBy("doc_id", "fp").agg(F.count("*").alias("copies")), "simhash-rows")
    groups = materialize(_with_components(rows, distance).join(rows.select(F.col("doc_id").alias("d"), F.col("fp").alias("f"), "copies"), F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("fp") == F.col("f"))), "simhash-groups")
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "fp", "copies")
    stay = groups.groupBy("component_id", F.when(F.col("component_id").isNull(), F.col("fp")).alias("alone")).agg(F.min(order).alias("keep"))
    stay = materialize(stay.select(F.col("keep.doc_id").alias("same_id"), F.col("keep.fp").alias("same_fp"), "keep.copies"), "simhash-kept")
    many = bool(stay.filter("copies > 1").limit(1).count())
    out = fingerprints(docs, text, tuple(columns), shingle, out="mark").join(stay, F.col(doc_id).eqNullSafe(F.col("same_id")) & (F.col("mark") == F.col("same_fp")))
    return (out.dropDuplicates([doc_id, "mark"]) if many else out).select(*columns).toDF(*names)
