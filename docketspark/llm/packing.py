"""Packing tokenized documents into as few sequences as possible.

Only the histogram of piece lengths (one number per length up to the capacity) reaches the driver. There the configuration
linear program (use each configuration, a multiset of lengths that fits a sequence, x times, cover every length, least
sum of x) is solved by multiplicative weights. Each round prices a length by its share of a sequence times a weight that falls exponentially
as its demand is covered; a knapsack dynamic program finds the greatest price of a configuration, overall (which makes the prices a
bound from the dual program) and with any given length in it. For each length, longest first, configurations within a tolerance of the best
that holds it are used, as many as the round's share of each demand allows. The tolerance widens only when nothing is within it. A use is a whole sequence at least, so that the solution needs hardly any rounding:
what is left below a whole use is rounded down. The shortest pieces, SMALL of all tokens, stay out of the program; they and the
residue of the rounding are put by best fit into the room that the configurations leave.

The plan is again a small table (length, first and last rank, sequence), and each piece finds its place from its rank among the
pieces of its length.
"""

from __future__ import annotations

import zlib
from collections import Counter
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import encoder, materialize, numbered, rows_of

CAPACITY = 2048
#: A round covers at most this share of a length's demand (one piece at least).
STEP = 0.15
#: How strongly a length's price rises while its demand is less covered than others'.
TILT = 1.5
#: A configuration is used if its price is within this share of the greatest that holds its longest length; up to WIDEST.
TOLERANCE, WIDEST = 1e-3, 0.1
#: The tolerance widens after a round that covers no more than this share of what was left.
SLOW = 0.01
#: The program ends when no more than this share of the bound is uncovered.
GAP = 1e-3
#: The shortest pieces with this share of all tokens, none longer than the second share of the capacity, are put in by best fit.
SMALL, SHORT = 0.01, 1 / 16
#: Rows of equal length that are ranked in one task, about.
RANKED = 5_000


def pieces_of(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = 0, text: str = "text", doc_id: str = "doc_id", with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids, if asked for) of each document's pieces.

    A document is its token ids and end_id; null text counts as empty, which is one piece of length 1. Documents longer than
    the capacity are cut into full pieces; the first takes the remainder.
    """

    def run(batches):
        for part, texts in rows_of(batches, "text"):
            owner, number, start, length, crc, ids = [], [], [], [], [], []
            for i, data in enumerate(encoder(tokenizer).encode(texts)):
                data += end_id.to_bytes(4, "little")
                n = len(data) // 4
                cuts = [0, *range(n % capacity or capacity, n + 1, capacity)] if n > capacity else [0, n]
                for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
                    owner.append(i)
                    number.append(k)
                    start.append(a)
                    length.append(b - a)
                    crc.append(zlib.crc32(data[4 * a : 4 * b]))
                    if with_ids:
                        ids.append(np.frombuffer(data[4 * a : 4 * b], dtype="<u4").astype(np.int32))
            columns = [part.column(0).take(pa.array(owner, pa.int64())), pa.array(number, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
            columns += [pa.array(ids, pa.list_(pa.int32()))] if with_ids else []
            yield pa.RecordBatch.from_arrays(columns, names)

    docs, (text, doc_id) = numbered(docs, text, doc_id)
    source = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    names = ["doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * with_ids]
    schema = f"doc_id {source.schema['doc_id'].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    return source.mapInArrow(run, schema)


class Solution(NamedTuple):
    """Uses of configurations (pairs of length and number), the bound below which no solution can be, and what is not covered."""

    uses: dict[tuple[tuple[int, int], ...], int]
    bound: float
    left: dict[int, int]


def best_prices(price: np.ndarray, capacity: int) -> np.ndarray:
    """The greatest total price of a multiset of lengths within each capacity; price[l] is that of length l."""
    best = np.zeros(capacity + 1)
    for c in range(1, capacity + 1):
        best[c] = (price[1 : c + 1] + best[c - 1 :: -1][:c]).max()
    return best


def _priced(first: int, price: np.ndarray, best: np.ndarray, least: float, budget: np.ndarray) -> Counter[int]:
    """A configuration with the length `first` and a price of `least` or more within the budgets, which it lowers; empty if there is none."""
    config, room, value = Counter({first: 1}), len(best) - 1 - first, price[first]
    budget[first] -= 1
    while room > 0:
        gain = np.where(budget[1 : room + 1] >= 1, price[1 : room + 1] + best[room - 1 :: -1][:room], -1.0)
        k = int(gain.argmax()) + 1
        if gain[k - 1] < 0 or price[k] <= 0 or value + gain[k - 1] < least:
            break
        config[k] += 1
        budget[k] -= 1
        value += price[k]
        room -= k
    if value >= least:
        return config
    for x, k in config.items():
        budget[x] += k
    return Counter()


def solve(demand: dict[int, int], capacity: int, gap: float = GAP) -> Solution:
    """An approximate solution of the configuration linear program that covers all but a share `gap` of the demand (counted in full sequences)."""
    lengths = np.array(sorted(demand))
    need = np.zeros(capacity + 1)
    need[lengths] = [demand[x] for x in lengths.tolist()]
    share = np.arange(capacity + 1) / capacity
    bound = float(share @ need)
    covered = np.zeros(capacity + 1)
    uses: Counter[tuple[tuple[int, int], ...]] = Counter()
    tolerance = TOLERANCE
    while share @ (left := need - covered) > gap * bound and tolerance <= WIDEST:
        short = left / np.maximum(need, 1)
        price = np.where(left >= 1, share * np.exp(TILT * (short - short.max())), 0.0)
        best = best_prices(price, capacity)
        bound = max(bound, float(price @ need) / best[capacity])
        budget = np.minimum(np.maximum(STEP * need, 1), left)
        before = share @ covered
        for x in lengths[::-1].tolist():
            least = (price[x] + best[capacity - x]) * (1 - tolerance)
            while budget[x] >= 1 and (config := _priced(x, price, best, least, budget)):
                more = min(int(budget[y] // k) for y, k in config.items())
                for y, k in config.items():
                    budget[y] -= k * more
                    covered[y] += k * (more + 1)
                uses[tuple(sorted(config.items()))] += more + 1
        if share @ covered - before <= SLOW * (share @ left):
            tolerance *= 2
    left = need - covered
    return Solution(dict(uses), bound, {x: round(left[x]) for x in lengths.tolist() if left[x] >= 0.5})


def best_fit(demand: dict[int, int], capacity: int, used: list[tuple[dict[int, int], int]]) -> list[tuple[dict[int, int], int]]:
    """Add the demanded lengths, longest first, each to the fullest sequence with room; equal sequences stay together as runs."""
    rooms: dict[int, list[tuple[dict[int, int], int]]] = {}
    for config, times in used:
        rooms.setdefault(capacity - sum(x * k for x, k in config.items()), []).append((config, times))
    for length in sorted(demand, reverse=True):
        left = demand[length]
        for room in sorted(r for r in rooms if r >= length):
            while left and rooms.get(room):
                config, times = rooms[room].pop()
                fit = room // length
                full = min(times, left // fit)
                for many, k in ((full, fit), (1 if full < times and left - full * fit else 0, left - full * fit)):
                    if many and k:
                        grown = config | {length: config.get(length, 0) + k}
                        rooms.setdefault(room - k * length, []).append((grown, many))
                        left -= many * k
                        times -= many
                if times:
                    rooms[room].append((config, times))
            if not left:
                break
        if left:
            fit = capacity // length
            if left >= fit:
                rooms.setdefault(capacity - fit * length, []).append(({length: fit}, left // fit))
            if left % fit:
                rooms.setdefault(capacity - left % fit * length, []).append(({length: left % fit}, 1))
    return [x for runs in rooms.values() for x in runs]


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[dict[int, int], int]]:
    """Configurations with whole numbers of uses that hold exactly the lengths of the histogram."""
    demand = {x: n for x, n in histogram.items() if 0 < x < capacity and n}
    spare, rest = {}, SMALL * sum(x * n for x, n in demand.items())
    for x in sorted(x for x in demand if x <= SHORT * capacity):
        if (held := min(demand[x], int(rest // x))) <= 0:
            break
        spare[x] = held
        rest -= x * held
    program = {x: n - spare.get(x, 0) for x, n in demand.items() if n > spare.get(x, 0)}
    solution = solve(program, capacity) if program else Solution({}, 0.0, {})
    rest_of = Counter(solution.left) + Counter(spare)
    whole = [({capacity: 1}, histogram[capacity])] if histogram.get(capacity) else []
    return whole + best_fit(dict(rest_of), capacity, [(dict(config), times) for config, times in solution.uses.items()])


def place_table(configurations: list[tuple[dict[int, int], int]]) -> dict[int, tuple[np.ndarray, ...]]:
    """For each length the first ranks of its runs, and the runs' first sequence, pieces per sequence and offset."""
    rows: dict[int, list[tuple[int, int, int, int]]] = {}
    ranks: Counter[int] = Counter()
    sequence = 0
    for config, times in configurations:
        offset = 0
        for length in sorted(config, reverse=True):
            k = config[length]
            rows.setdefault(length, []).append((ranks[length], sequence, k, offset))
            ranks[length] += k * times
            offset += k * length
        sequence += times
    return {length: tuple(np.array(x, dtype=np.int64) for x in zip(*r, strict=True)) for length, r in rows.items()}


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """The pieces (columns doc_id, piece, length and others) with sequence_id and offset.

    Each sequence holds at most `capacity` tokens, offsets leave no gap. Equal rows are placed like any others. An empty
    table gives no rows.
    """
    pieces = materialize(pieces, "packing-pieces")
    counted = pieces.groupBy("length").agg(F.count("*").alias("n")).collect()  # one row per length, up to the capacity
    histogram = {r.length: r.n for r in counted}
    if not histogram:
        return pieces.withColumns({"sequence_id": F.lit(None).cast("long"), "offset": F.lit(None).cast("long")})
    table = place_table(plan(histogram, capacity))
    places = pieces.sparkSession.sparkContext.broadcast(table)  # bounded by the program's rounds and the capacity, not by the documents

    salts = max(1, round((sum(histogram.values()) / RANKED) ** 0.5) * 4)
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "start", "ids_crc32"), F.lit(salts)))
    sums = salted.groupBy("length", "salt").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("length", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    own = Window.partitionBy("length", "salt").orderBy("doc_id", "piece")
    ranked = salted.withColumn("rank", F.row_number().over(own) - 1).join(sums, ["length", "salt"]).withColumn("rank", F.col("rank") + F.col("base"))
    ranked = ranked.select(*pieces.columns, "rank")
    names = [*pieces.columns, "sequence_id", "offset"]

    def run(batches):
        for batch in batches:
            length = batch.column(batch.schema.get_field_index("length")).to_numpy()
            rank = batch.column(batch.schema.get_field_index("rank")).to_numpy()
            sequence, offset = np.empty(len(rank), np.int64), np.empty(len(rank), np.int64)
            for x in np.unique(length):
                mine = np.flatnonzero(length == x)
                first, base, per, at = places.value[int(x)]
                run_ = np.searchsorted(first, rank[mine], "right") - 1
                within = rank[mine] - first[run_]
                sequence[mine] = base[run_] + within // per[run_]
                offset[mine] = at[run_] + within % per[run_] * x
            columns = [batch.column(i) for i in range(len(names) - 2)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(sequence), pa.array(offset)], names)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema.fields)
    return ranked.mapInArrow(run, f"{schema}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, text: str = "text", doc_id: str = "doc_id", with_ids: bool = False) -> DataFrame:
    """The packed pieces of all documents: pieces_of, then pack. Null ids and repeated documents are packed like others."""
    return pack(pieces_of(docs, tokenizer, capacity, 0, text, doc_id, with_ids), capacity)
