"""Quality scores by compression: how much better a text compresses with a dictionary of good texts than with one of bad.

Two zstandard dictionaries are trained on a bounded sample of whole labelled texts. A text is cut into blocks, each is
compressed on its own with either dictionary, and the difference of the total sizes, normalised by the text's size and by
the compressed size, goes through a logistic curve fitted on other labelled texts of the sample; these also choose, by cross-validation
among themselves, what is added to short texts' sizes. Only the sample reaches the driver.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import fold, materialize, numbered, rows_of

#: Labelled texts of each class that are read at most, in the order of a hash of the id; half train the dictionaries, half fit the curve.
SAMPLE_ROWS = 3000
#: They end with the text that brings their bytes to this number.
SAMPLE_BYTES = 16 << 20
#: A dictionary holds an eighth of the bytes it is trained on, within these bounds; fewer bytes than 8 times the lower one are repeated.
DICTIONARY_BYTES = (1 << 10, 256 << 10)
BLOCK = 512
#: Added to a text's size, so that a few bytes say little about a very short text. The training takes another of these than the first only if
#: cross-validation among the curve's texts shows it to be better by more than two standard errors; the first is best among the training rows of 10,000 documents.
PRIORS = (64, 16, 256, 1024)
#: Fewer texts than these choose nothing.
LEAST_TEXTS = 1000
#: Parts of the curve's texts in the cross-validation.
PARTS = 5
TERMS = 2
LEVEL = 3
FOLDS = 5
THRESHOLD = 0.3


class Model(NamedTuple):
    """Two dictionaries, the bytes added to sizes, and the curve: its terms' ranges in the sample, means and spreads, then the weights of 1 and the terms."""

    good: bytes
    bad: bytes
    prior: int
    low: tuple[float, ...]
    high: tuple[float, ...]
    mean: tuple[float, ...]
    spread: tuple[float, ...]
    weights: tuple[float, ...]


def blocks_of(text: bytes, size: int = BLOCK) -> list[bytes]:
    return [text[i : i + size] for i in range(0, len(text), size)]


class Measure:
    """Compressed sizes of texts under a model's dictionaries."""

    def __init__(self, good: bytes, bad: bytes):
        self.with_dict = []
        for data in (good, bad):
            d = zstandard.ZstdCompressionDict(data)
            d.precompute_compress(level=LEVEL)
            self.with_dict.append(zstandard.ZstdCompressor(dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False))

    def sizes(self, texts: list[bytes]) -> np.ndarray:
        """Per text its size and those with the good and the bad dictionary; nan for empty texts."""
        out = np.full((len(texts), 3), np.nan)
        good, bad = (c.compress for c in self.with_dict)
        for i, text in enumerate(texts):
            if parts := blocks_of(text):
                out[i] = len(text), *(sum(len(f(p)) for p in parts) for f in (good, bad))
        return out

    def terms(self, texts: list[bytes], prior: int) -> np.ndarray:
        return normalised(self.sizes(texts), prior)


def normalised(sizes: np.ndarray, prior: int) -> np.ndarray:
    """Per text the two normalised differences (bad - good)."""
    n, good, bad = sizes.T
    return np.column_stack([(bad - good) / (n + prior), (bad - good) / (bad + good)])


def _curve(x: np.ndarray, y: np.ndarray) -> tuple[float, ...]:
    """Logistic regression of y on x by Newton's method, with a little shrinkage."""
    a = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(a.shape[1])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -35, 35)))
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + 1e-2 * np.eye(len(w)), a.T @ (y - p) - 1e-2 * w)
        w = w + np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-9:
            break
    return tuple(w.tolist())


def _curve_of(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, tuple[float, ...]]:
    mean, spread = x.mean(axis=0), x.std(axis=0) + 1e-9
    return mean, spread, _curve((x - mean) / spread, y)


def losses(sizes: np.ndarray, y: np.ndarray, prior: int, parts: int = PARTS) -> np.ndarray:
    """Each text's log loss under the curve that is fitted on the other parts of the texts."""
    part, x, out = np.arange(len(y)) % parts, normalised(sizes, prior), np.zeros(len(y))
    for k in range(parts):
        here = part == k
        if here.any() and not here.all():
            mean, spread, w = _curve_of(x[~here], y[~here])
            z = np.clip(w[0] + (x[here] - mean) / spread @ np.array(w[1:]), -35, 35)
            out[here] = np.logaddexp(0, np.where(y[here] == 1, -z, z))
    return out


def chosen_prior(sizes: np.ndarray, y: np.ndarray, priors: tuple[int, ...] = PRIORS) -> int:
    """The prior with the least loss, if it is less than the first one's by more than two standard errors of their difference; else, or of few texts, the first."""
    if len(y) < LEAST_TEXTS:
        return priors[0]
    all_losses = [losses(sizes, y, prior) for prior in priors]
    best = int(np.argmin([x.sum() for x in all_losses]))
    gain = all_losses[0] - all_losses[best]
    return priors[best] if gain.sum() > 2 * gain.std() * len(y) ** 0.5 else priors[0]


def train(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", label: str = "quality", sample_rows: int = SAMPLE_ROWS) -> Model:
    """A model from labelled texts (labels: doc_id and a 0/1 label) outside the held-out fold.

    At most sample_rows documents per class are read, those with the smallest hash of their id, each whole. Ids with both labels and null
    labels or ids are left out; of rows with the same id the smallest text counts. If a class has no text, every score is the share of
    label 1 in the sample (0.5 if none).
    """
    docs, (text, doc_id_) = numbered(docs, text, doc_id)
    labels, (label, label_id) = numbered(labels, label, doc_id)
    known = labels.select(F.col(label_id).alias("i"), F.col(label).cast("int").alias("y")).filter("i is not null and y in (0, 1)").filter(fold("i", FOLDS) != 0)
    known = known.groupBy("i").agg(F.min("y").alias("y"), F.max("y").alias("top")).filter("y = top").select("i", "y", F.xxhash64("i", F.lit(7)).alias("h"))
    chosen = known.filter("y = 0").orderBy("h", "i").limit(sample_rows).unionByName(known.filter("y = 1").orderBy("h", "i").limit(sample_rows))
    chosen = F.broadcast(chosen)  # 2 x sample_rows rows at most
    body = F.coalesce(F.col(text), F.lit("")).cast("binary")
    sample = docs.select(F.col(doc_id_).alias("i"), body.alias("text")).join(chosen, "i").groupBy("i", "y", "h").agg(F.min("text").alias("text"))
    sample = materialize(sample, "quality-sample")
    # of each class, the texts up to the bound of bytes; 2 x sample_rows rows in all
    before = Window.partitionBy("y").orderBy("h", "i").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sample.select("i", "y", "h", F.coalesce(F.sum(F.octet_length("text")).over(before), F.lit(0)).alias("before"))
    used = sizes.filter(F.col("before") < SAMPLE_BYTES).select("i")
    rows = sample.join(F.broadcast(used), "i").orderBy("h", "i").collect()
    texts = {0: [], 1: []}
    for r in rows:
        texts[r.y].append(bytes(r.text))
    if not texts[0] or not texts[1]:
        share = float(np.mean([r.y for r in rows])) if rows else 0.5
        share = min(max(share, 0.01), 0.99)
        return Model(b"", b"", PRIORS[0], *((0.0,) * TERMS,) * 3, (1.0,) * TERMS, (float(np.log(share / (1 - share))), *(0.0,) * TERMS))
    dictionaries = {y: _dictionary(own[::2]) for y, own in texts.items()}
    measure = Measure(dictionaries[1], dictionaries[0])
    held = [(t, y) for y, own in texts.items() for t in (own[1::2] or own)]
    sizes = measure.sizes([t for t, _ in held])
    filled = ~np.isnan(sizes[:, 0])
    sizes, y = sizes[filled], np.array([y for _, y in held], dtype=float)[filled]
    prior = chosen_prior(sizes, y)
    x = normalised(sizes, prior) if len(sizes) else np.zeros((1, TERMS))
    y = y if len(y) else np.array([0.5])
    mean, spread, weights = _curve_of(x, y)
    ranges = (tuple(v.tolist()) for v in (x.min(axis=0), x.max(axis=0), mean, spread))
    return Model(dictionaries[1], dictionaries[0], prior, *ranges, weights)


def _dictionary(texts: list[bytes]) -> bytes:
    """A dictionary trained on the texts' blocks."""
    samples = [p for t in texts for p in blocks_of(t)] or [b" "]
    least, most = DICTIONARY_BYTES
    size = sum(map(len, samples))
    samples *= -(-8 * least // size)
    return zstandard.train_dictionary(min(max(size // 8, least), most), samples, level=LEVEL).as_bytes()


def scored(docs: DataFrame, model: Model, text: str = "text", keep: tuple[str, ...] = ("doc_id",), out: str = "score") -> DataFrame:
    """The columns `keep` and the score of each whole text, 0 to 1, higher for likelier label 1.

    Null counts as empty; empty texts stand at the means of the sample's terms. Repeated rows stay.
    """
    holder = docs.sparkSession.sparkContext.broadcast(model)  # two dictionaries of bounded size
    kept = list(keep)
    docs, (text, *columns) = numbered(docs, text, *kept)

    def run(batches):
        m = holder.value
        measure = Measure(m.good, m.bad) if m.good else None
        for part, texts in rows_of(batches):
            x = measure.terms(texts, m.prior) if measure else np.full((len(texts), TERMS), np.nan)
            x = np.clip(x, m.low, m.high)  # the curve says nothing beyond the sample, e.g. on copies of the dictionaries' texts
            x = np.nan_to_num((x - m.mean) / m.spread)  # an empty text stands at the means
            score = 1 / (1 + np.exp(-np.clip(m.weights[0] + x @ np.array(m.weights[1:]), -35, 35)))
            yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(len(columns))), pa.array(score)], [*columns, "score"])

    source = docs.select(*columns, F.col(text).cast("binary").alias("text"))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in source.schema.fields[:-1])
    return source.mapInArrow(run, f"{schema}, score double").toDF(*kept, out)


def accepted(docs: DataFrame, model: Model, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs, with all their columns, whose text scores `threshold` or more."""
    names = docs.columns
    docs, (text,) = numbered(docs, text)
    return scored(docs, model, text, tuple(docs.columns)).filter(F.col("score") >= threshold).drop("score").toDF(*names)
