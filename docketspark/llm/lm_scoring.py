"""Language-model scores of texts: prediction by partial matching over the bytes of running text.

A text is coded as its words, each with one space behind it, and one end sign. The longest context that has been seen predicts;
where it fails, an escape is paid and the next shorter one takes over:

1. adaptive: the two words before, as they occurred earlier in the same text, predict what followed them then;
2. pretrained trie: every other byte in contexts of up to ORDER bytes of the text before it, across word ends, down to order 0.

The trie is counted from all training texts: each task counts its grams of ORDER context bytes and a byte, and the counts are summed by
gram. The contexts are split among tasks by their last three bytes (orders 0 to 2 are small tables of bytes), each distinct gram is
coded once, with escapes and symbol exclusion, and the code lengths go back to the texts. A fixed number of frequent grams (and
words, for the unigram score) is broadcast, so that the joins carry rare ones only.
"""

from __future__ import annotations

import math
from collections import Counter
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold, materialize, mix64, numbered, released, rows_of, whole_runs

ORDER = 5
#: Orders up to this one are tables of all contexts, on every executor: 2^24 numbers at most, some 100,000 in UTF-8 text.
LOW = 2
FOLDS = 10
#: Words that are broadcast, the most frequent ones; all others are joined.
HOT_WORDS = 150_000
#: Distinct words that a task counts before it passes them on.
PARTIAL_WORDS = 300_000
#: The same for grams: those that are broadcast, and those that a task counts before it passes them on.
HOT_GRAMS = 2_000_000
PARTIAL_GRAMS = 2_000_000
#: Bytes whose grams are worked through at a time.
GRAM_BYTES = 1 << 21
#: Grams that are coded at a time, about: whole contexts of LOW + 1 bytes.
CODED_ROWS = 400_000
#: The end of a text, as a word and as a byte; no word holds it.
END = b"\n"


def word_table(docs: DataFrame) -> DataFrame:
    """word (binary), c (occurrences in training texts) and n (in all), END among them. docs: text (binary), learn."""

    def run(batches):
        train: Counter[bytes] = Counter()
        every: Counter[bytes] = Counter()

        def partial():
            words = list(every)
            out = pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), pa.array([train[w] for w in words], pa.int64()), pa.array(list(every.values()), pa.int64())], ["word", "c", "n"])
            train.clear()
            every.clear()
            return out

        for part, texts in rows_of(batches):
            for learn, text in zip(part.column(1).to_pylist(), texts, strict=True):
                words = text.lower().split()
                words.append(END)
                every.update(words)
                if learn:
                    train.update(words)
            if len(every) > PARTIAL_WORDS:
                yield partial()
        yield partial()

    counted = docs.select("text", "learn").mapInArrow(run, "word binary, c long, n long")
    return materialize(counted.groupBy("word").agg(F.sum("c").alias("c"), F.sum("n").alias("n")), "lm-words")


def running_grams(texts: list[list[bytes]], order: int = ORDER):
    """(gram, index of its text, index of its word) of every coded byte of texts given as words: `order` bytes of context and the byte, lowest.

    The context is what stands before the byte, across word ends; before a text stand NUL bytes and a space. Words are numbered
    through all texts, a word's own end belongs to it. Yields arrays for about GRAM_BYTES at a time.
    """
    head = bytes(order) + b" "
    coded = [head + b" ".join(words) for words in texts]
    sizes = np.fromiter(map(len, coded), np.int64, len(coded))
    data = np.frombuffer(bytes(8) + b"".join(coded), dtype=np.uint8)
    # the eight bytes up to each place as one number, the last one lowest
    ending = np.ndarray((len(data) - 7,), dtype=">u8", buffer=data, strides=(1,))[1:]
    data = data[8:]
    owner = np.repeat(np.arange(len(coded), dtype=np.int32), sizes)
    space = data == 32
    word = np.cumsum(space, dtype=np.int32) - space - 1
    keep = np.ones(len(data), dtype=bool)
    keep[((np.cumsum(sizes) - sizes)[:, None] + np.arange(order + 1)).ravel()] = False
    mask = np.uint64((1 << (8 * (order + 1))) - 1)
    for first in range(0, len(data), GRAM_BYTES):
        here = slice(first, first + GRAM_BYTES)
        mine = keep[here]
        yield (ending[here].astype(np.uint64) & mask).view(np.int64)[mine], owner[here][mine], word[here][mine]


def _sum_by(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    unique, inverse = np.unique(keys, return_inverse=True)
    return unique, np.bincount(inverse, weights=values, minlength=len(unique))


def _look_up(table: tuple[np.ndarray, ...], keys: np.ndarray) -> list[np.ndarray]:
    """Values of the keys in a table (sorted keys, values...), 0 where absent."""
    sorted_keys, *values = table
    if not len(sorted_keys):
        return [np.zeros(len(keys)) for _ in values]
    i = np.minimum(np.searchsorted(sorted_keys, keys), len(sorted_keys) - 1)
    hit = sorted_keys[i] == keys
    return [np.where(hit, v[i], 0.0) for v in values]


def _suffixes(grams: np.ndarray, j: int) -> np.ndarray:
    """The grams cut to j context bytes."""
    return grams & ((1 << (8 * (j + 1))) - 1)


def _level(gram: np.ndarray, count: np.ndarray) -> tuple[tuple, tuple]:
    """Of the grams of one order: (gram, count) of those that occur, and (context, occurrences, distinct bytes)."""
    gram, count = gram[count > 0], count[count > 0]
    context, n = _sum_by(gram >> 8, count) if len(gram) else (gram, count)
    return (gram, count), (context, n, np.bincount(np.searchsorted(context, gram >> 8), minlength=len(context)).astype(float))


def low_levels(gram: np.ndarray, count: np.ndarray, order: int = LOW) -> list[tuple[tuple, tuple]]:
    """The levels of the orders 0 to `order` from the sorted grams of the highest and their counts in training."""
    return [_level(*_sum_by(_suffixes(gram, j), count)) for j in range(order)] + [_level(gram, count)]


def code_lengths(grams: np.ndarray, counts: np.ndarray, low: list[tuple[tuple, tuple]], order: int = ORDER) -> np.ndarray:
    """log10 probability of each gram's byte in its context. counts: of the grams in training; low: the levels of the low orders.

    grams must hold all grams that share as many last context bytes as low has levels. From the longest context seen in training downwards, a
    byte seen there is coded by its count less a half; else half the number of distinct bytes is the weight of the
    escape, and the bytes seen so far are excluded below. Contexts that offer no new byte cost nothing.
    """
    levels = low[: order + 1] + [_level(*_sum_by(_suffixes(grams, j), counts)) for j in range(len(low), order + 1)]
    log_p = np.zeros(len(grams))
    open_ = np.ones(len(grams), dtype=bool)
    for j in range(order, -1, -1):
        at = _suffixes(grams, j)
        (c,) = _look_up(levels[j][0], at)
        n, d = _look_up(levels[j][1], at >> 8)
        if j < order:  # bytes that the next longer context has seen are excluded
            (longer, _), (context, _, longer_d) = levels[j + 1]
            (short,) = _look_up(levels[j][0], _suffixes(longer, j))
            gone = _sum_by(longer >> 8, short) if len(longer) else (longer, short)
            above = _suffixes(grams, j + 1) >> 8
            (gone_n,) = _look_up(gone, above)
            (gone_d,) = _look_up((context, longer_d), above)
            n, d = n - gone_n, d - gone_d
        usable = open_ & (d > 0)
        hit = usable & (c > 0)
        log_p[hit] += np.log10((c[hit] - 0.5) / n[hit])
        miss = usable & ~hit
        log_p[miss] += np.log10(0.5 * d[miss] / n[miss])
        open_ &= ~hit
    left = 256 - len(levels[0][0][0])
    log_p[open_] -= math.log10(max(left, 1))
    return log_p


def gram_table(docs: DataFrame, order: int = ORDER) -> DataFrame:
    """gram and n (occurrences in training texts, may be 0) of all grams of all whole texts. docs: text (binary), learn."""

    def run(batches):
        parts: list[tuple[np.ndarray, np.ndarray]] = []

        def merged():
            return _sum_by(*(np.concatenate(x) for x in zip(*parts, strict=True)))

        def rows(table):
            return pa.RecordBatch.from_arrays([pa.array(table[0]), pa.array(table[1].astype(np.int64))], ["gram", "n"])

        for part, texts in rows_of(batches):
            learn = np.array(part.column(1).to_pylist(), dtype=bool)
            for gram, owner, _ in running_grams([[*t.lower().split(), END] for t in texts], order):
                known = learn[owner]
                unique, n = np.unique(gram[known], return_counts=True)
                other = np.unique(gram[~known])
                parts += [(unique, n.astype(float)), (other, np.zeros(len(other)))]
            if sum(len(g) for g, _ in parts) > 2 * PARTIAL_GRAMS:
                parts = [merged()]
                if len(parts[0][0]) > PARTIAL_GRAMS:
                    yield rows(parts[0])
                    parts = []
        if parts:
            yield rows(merged())

    counted = docs.select("text", "learn").mapInArrow(run, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    return materialize(counted, "lm-grams")


def gram_codes(counted: DataFrame, order: int = ORDER) -> DataFrame:
    """gram, n and log_p of all rows of gram_table(); the trie is that of the training counts."""
    low_order = min(LOW, order)
    cut = F.col("gram").bitwiseAND((1 << (8 * (low_order + 1))) - 1)
    sums = counted.filter("n > 0").groupBy(cut.alias("g")).agg(F.sum("n").alias("n")).orderBy("g").toArrow()
    low = low_levels(sums.column(0).to_numpy(), sums.column(1).to_numpy().astype(float), low_order)
    shared = counted.sparkSession.sparkContext.broadcast(low)

    def run(batches):
        for rows in whole_runs(batches, 1, CODED_ROWS):
            codes = code_lengths(rows.column(1).to_numpy(), rows.column(2).to_numpy().astype(float), shared.value, order)
            yield from pa.table([rows.column(1), rows.column(2), pa.array(codes)], ["gram", "n", "log_p"]).to_batches()

    suffix = F.shiftright("gram", 8).bitwiseAND((1 << (8 * (low_order + 1))) - 1)
    dealt = counted.select(suffix.alias("suffix"), "gram", "n").repartition("suffix").sortWithinPartitions("suffix")
    return released(materialize(dealt.mapInArrow(run, "gram long, n long, log_p double"), "lm-codes"), shared)


def word_codes(words: DataFrame) -> tuple[DataFrame, int]:
    """(word, c, n, base) of every word, base its smoothed unigram log10 probability; then the number of training tokens."""
    total, kinds = (x or 0 for x in words.agg(F.sum("c"), F.count_if(F.col("c") > 0)).first())
    floor = total + 0.1 * (kinds + 1)
    return words.select("word", "c", "n", F.log10((F.col("c") + 0.1) / F.lit(float(floor))).alias("base")), total


def most_frequent(rows: DataFrame, limit: int) -> DataFrame:
    """The rows of the largest n, down to the class of counts with which they would be more than `limit`."""
    frequency = F.floor(F.log2("n") * 16)
    sizes = rows.filter("n > 0").groupBy(frequency.alias("class")).agg(F.count("*").alias("rows")).collect()  # 16 rows for each doubling of a count
    least, used = None, 0
    for row in sorted(sizes, key=lambda r: -r["class"]):
        used += row["rows"]
        if used > limit:
            break
        least = row["class"]
    return rows.filter((F.col("n") > 0) & (frequency >= least) if least is not None else F.lit(False))


def repeats(number: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of all words of some texts, whether the two words before predict it as what followed them last in the same text; and each text's predictions that held and failed.

    number: the texts' words as numbers, one text behind the other; sizes: words of each text.
    """
    owner = np.repeat(np.arange(len(sizes)), sizes)
    at = np.flatnonzero(owner[2:] == owner[:-2]) + 2 if len(number) > 2 else np.zeros(0, np.int64)
    pair = number[at - 2].astype(np.uint64) << np.uint64(32) | number[at - 1].astype(np.uint64)
    key = mix64(pair) ^ mix64(owner[at].astype(np.uint64) + np.uint64(1))
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    now, last = at[order[1:]][same], at[order[:-1]][same]
    right = number[now] == number[last]
    predicted = np.zeros(len(number), dtype=bool)
    predicted[now[right]] = True
    count = lambda places: np.bincount(owner[places], minlength=len(sizes))
    return predicted, count(now[right]), count(now[~right])


class GramTable:
    """Open addressing of grams and values in two arrays of a power of two."""

    def __init__(self, slots: np.ndarray, values: np.ndarray):
        self.slots, self.values, self.mask = slots, values, np.uint64(len(slots) - 1)

    @classmethod
    def of(cls, grams: np.ndarray, values: np.ndarray) -> GramTable:
        size = 1 << max(10, (2 * len(grams)).bit_length())
        table = cls(np.full(size, -1, dtype=np.int64), np.zeros(size))
        todo, at = np.arange(len(grams)), table._place(grams)
        while len(todo):
            free = table.slots[at] == -1
            table.slots[at[free]] = grams[todo[free]]
            placed = table.slots[at] == grams[todo]
            table.values[at[placed]] = values[todo[placed]]
            todo, at = todo[~placed], (at[~placed] + 1) & int(table.mask)
        return table

    def _place(self, grams: np.ndarray) -> np.ndarray:
        return (mix64(grams.view(np.uint64)) & self.mask).view(np.int64)

    def get(self, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether each gram is in the table, and its value (0 if not)."""
        at = self._place(grams)
        slot = self.slots[at]
        hit = slot == grams
        values = np.where(hit, self.values[at], 0.0)
        todo = np.flatnonzero(~hit & (slot != -1))
        at = at[todo]
        while len(todo):
            at = (at + 1) & int(self.mask)
            slot = self.slots[at]
            found = slot == grams[todo]
            hit[todo[found]] = True
            values[todo[found]] = self.values[at[found]]
            more = ~found & (slot != -1)
            todo, at = todo[more], at[more]
        return hit, values


def adaptive_cost(hits: int, missed: int) -> float:
    """log10 probability of so many successes and failures in any order, each estimated from those before (half a count each)."""
    log = math.lgamma(hits + 0.5) + math.lgamma(missed + 0.5) - math.lgamma(hits + missed + 1) - math.log(math.pi)
    return log / math.log(10)


def score_texts(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", folds: int = FOLDS, order: int = ORDER) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every whole text.

    Learns from the texts whose crc32 of the id modulo `folds` is not 0. Letters A-Z are lower-cased; a text's tokens are its words
    and one end, so that null and empty texts have one token. base_score is the smoothed unigram log10 probability,
    score that of the byte model. Repeated rows count and are scored each; with no training text the byte model is uniform.
    """
    docs, (text, doc_id) = numbered(docs, text, doc_id)
    held_out = fold("doc_id", folds) == 0
    source = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("binary").alias("text"))
    taught = source.select("text", (~held_out).alias("learn"))
    words, total = word_codes(word_table(taught))
    codes = gram_codes(gram_table(taught, order), order)
    hot = most_frequent(words, HOT_WORDS).select("word", "c", "base").toPandas()  # HOT_WORDS rows at most
    table = {bytes(w): (c > 0, b) for w, c, b in zip(hot["word"], hot["c"], hot["base"], strict=True)}
    hot = most_frequent(codes, HOT_GRAMS).select("gram", "log_p").toArrow()  # HOT_GRAMS rows at most
    grams = GramTable.of(*(hot.column(i).to_numpy() for i in range(2)))
    shared = docs.sparkSession.sparkContext.broadcast((table, grams.slots, grams.values))
    del hot, table, grams

    def run(batches):
        known, hot_grams = shared.value[0], GramTable(*shared.value[1:])
        for part, texts in rows_of(batches):
            split = [[*t.lower().split(), END] for t in texts]
            sizes = np.fromiter(map(len, split), np.int64, len(split))
            numbers: dict[bytes, int] = {}
            number = np.fromiter((numbers.setdefault(w, len(numbers)) for w in chain.from_iterable(split)), np.int64, int(sizes.sum()))
            owner = np.repeat(np.arange(len(split)), sizes)
            found = [known.get(w) for w in numbers]
            rare = np.fromiter((f is None for f in found), bool, len(found))
            k, b = (np.fromiter((f[i] if f else 0 for f in found), float, len(found)) for i in (0, 1))
            per_text = lambda x: np.bincount(owner, weights=x[number], minlength=len(split))
            n_known, base = per_text(k).astype(np.int64), per_text(b)
            entry, times = np.unique((owner * len(found) + number)[rare[number]], return_counts=True)  # a text's rare words, once each
            rare_ends = np.concatenate([[0], np.cumsum(np.bincount(entry // max(len(found), 1), minlength=len(split)))]).astype(np.int32)
            spelt = list(numbers)
            rare_words = pa.array([spelt[i] for i in (entry % max(len(found), 1)).tolist()], pa.binary())

            predicted, held, failed = repeats(number, sizes)
            score = np.array([adaptive_cost(h, f) for h, f in zip(held.tolist(), failed.tolist(), strict=True)])
            open_grams, open_owners = [], []
            for gram, text_, word in running_grams(split, order):
                asked = ~predicted[word]
                gram, text_ = gram[asked], text_[asked]
                hit, codes_ = hot_grams.get(gram)
                score += np.bincount(text_, weights=codes_, minlength=len(split))
                open_grams.append(gram[~hit])
                open_owners.append(text_[~hit])
            # owners come in order, so a text's open grams stand together
            ends = np.concatenate([[0], np.cumsum(np.bincount(np.concatenate(open_owners), minlength=len(split)))]).astype(np.int32)
            lists = pa.ListArray.from_arrays
            columns = [pa.array(sizes), pa.array(n_known), pa.array(base), pa.array(score), lists(pa.array(rare_ends), rare_words), lists(pa.array(rare_ends), pa.array(times)), lists(pa.array(ends), pa.array(np.concatenate(open_grams)))]
            yield pa.RecordBatch.from_arrays([part.column(0), *columns], names)

    names = ["doc_id", "n_tokens", "n_known", "base_score", "score", "rare", "times", "grams"]
    kind = source.schema["doc_id"].dataType.simpleString()
    begun = source.mapInArrow(run, f"doc_id {kind}, n_tokens long, n_known long, base_score double, score double, rare array<binary>, times array<long>, grams array<long>")
    begun = released(materialize(begun.withColumn("row", F.monotonically_increasing_id()), "lm-texts"), shared)
    rest = begun.select("row", F.explode(F.arrays_zip("rare", "times")).alias("r")).select("row", F.col("r.rare").alias("word"), "r.times")
    rest = rest.join(words.select("word", "c", "base"), "word").groupBy("row").agg(F.sum(F.when(F.col("c") > 0, F.col("times")).otherwise(0)).alias("k"), F.sum(F.col("times") * F.col("base")).alias("b"))
    bytes_ = begun.select("row", F.explode("grams").alias("gram")).join(codes.select("gram", "log_p"), "gram").groupBy("row").agg(F.sum("log_p").alias("p"))
    plus = lambda a, b: F.col(a) + F.coalesce(F.col(b), F.lit(0))
    out = begun.drop("rare", "times", "grams").join(rest, "row", "left").join(bytes_, "row", "left")
    return out.select("doc_id", held_out.alias("held_out"), "n_tokens", plus("n_known", "k").alias("n_known"), F.lit(total).cast("long").alias("train_tokens"), plus("base_score", "b").alias("base_score"), plus("score", "p").alias("score"))
