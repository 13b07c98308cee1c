"""Quality rules: counts per text, and robust outliers among them within each language and source.

Each text gives a vector of transformed statistics. For every group (language and source), every language and the whole table the minimum
covariance determinant estimate of mean and covariance comes from concentration steps: distances under the present estimate
are counted into bins with the moments of each bin, the bins of the smallest distances that hold a share H of the
group's rows give the next estimate. Each group has several starts, which run until nothing changes; the one of the least determinant
counts. A step is one grouped aggregation over narrow rows with partial sums, and a solve per group over at most a few hundred bins, so a
group of any size costs one pass. A group's estimate is then drawn towards its language's, and that towards the whole table's, as
PRIOR_ROWS rows would draw it; so a small group is judged by much the same estimate as its language, and no group's size switches anything.
Rows whose distance is beyond the cut-off are rejected.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SpanHasher, materialize, mix64, numbered, rows_of, small, word_spans

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
MORE = ("n_upper", "n_digits", "n_lines", "n_stutter")
WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
#: The features, and the least spread that counts for each: below it a difference says nothing about quality.
FEATURES = ("word_length", "symbols", "upper", "digits", "dup_lines", "repeated", "stutter")
LEAST_SPREAD = (0.12, 0.06, 0.10, 0.08, 0.12, 0.16, 0.12)
#: Share of a group's rows that the estimate rests on.
H = 0.75
#: Concentration steps at most; they end when no estimate's determinant falls by more than this share.
STEPS = 20
SETTLED = 1e-3
#: The language's estimate counts as so many rows in a group's, the whole table's likewise in a language's.
PRIOR_ROWS = 64
#: Names of the starts: medians with absolute deviations, plain moments, moments of squashed values.
STARTS = ("medians", "moments", "squashed")
#: Rejection beyond the chi-square quantile of this probability.
CUTOFF = 0.99999
BINS_PER_OCTAVE = 6


def _lut(chars: bytes) -> np.ndarray:
    table = np.zeros(256, dtype=bool)
    table[list(chars)] = True
    return table


_SYMBOLS = _lut(b"#*$%&|<>")
_UPPER = _lut(bytes(range(65, 91)))
_DIGITS = _lut(bytes(range(48, 58)))


def text_counts(texts: list[bytes]) -> dict[str, np.ndarray]:
    """The statistics of each UTF-8 text, all texts at once.

    n_stutter counts words equal to the one before; n_dup_lines counts lines with a word that equal an earlier line; n_repeat_words counts the words inside 8-word windows
    that occur at least twice in the text. Equality is that of 64-bit hashes.
    """
    n = len(texts)
    data = np.frombuffer(b"\n".join(texts) + b"\n", dtype=np.uint8)
    size = np.fromiter(map(len, texts), np.int64, n) + 1
    first = np.cumsum(size) - size
    per_text = lambda flags: np.add.reduceat(flags.astype(np.int64), first)
    begin, end = word_spans(data)
    owner = np.searchsorted(first, begin, "right") - 1
    hasher = SpanHasher(data)
    glyph = (data & 0xC0) != 0x80
    inside = ~np.isin(data, [9, 10, 11, 12, 13, 32])
    out = {
        "n_words": np.bincount(owner, minlength=n),
        "word_chars": per_text(inside & glyph),
        "n_symbols": per_text(_SYMBOLS[data]),
        "n_upper": per_text(_UPPER[data]),
        "n_digits": per_text(_DIGITS[data]),
    }

    own_salt = mix64(np.arange(1, n + 1, dtype=np.uint64))
    line_end = np.flatnonzero(data == 10)
    line_begin = np.concatenate([[0], line_end[:-1] + 1])
    words_before = np.concatenate([[0], np.cumsum(inside)])
    filled = words_before[line_end] > words_before[line_begin]
    line_begin, line_end = line_begin[filled], line_end[filled]
    line_owner = np.searchsorted(first, line_begin, "right") - 1
    key = hasher.spans(line_begin, line_end) ^ own_salt[line_owner]
    order = np.argsort(key)
    again = np.flatnonzero(key[order][1:] == key[order][:-1])
    out["n_lines"] = np.bincount(line_owner, minlength=n)
    out["n_dup_lines"] = np.bincount(line_owner[order][again], minlength=n)

    word = hasher.spans(begin, end)
    stutter = (word[1:] == word[:-1]) & (owner[1:] == owner[:-1])
    out["n_stutter"] = np.bincount(owner[1:][stutter], minlength=n)
    repeated = np.zeros(len(begin), dtype=bool)
    windows = len(begin) - WINDOW + 1
    if windows > 0:
        key = np.zeros(windows, dtype=np.uint64)
        for k in range(WINDOW):
            key = key * np.uint64(0x9E3779B97F4A7C15) + word[k : k + windows]
        at = np.flatnonzero(owner[:windows] == owner[WINDOW - 1 :])
        key = mix64(key[at]) ^ own_salt[owner[at]]
        order = np.argsort(key)
        same = key[order][1:] == key[order][:-1]
        twice = np.zeros(len(at), dtype=bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        for k in range(WINDOW):
            repeated[at[twice] + k] = True
    out["n_repeat_words"] = np.bincount(owner[repeated], minlength=n)
    return out


def count_texts(docs: DataFrame, keep: tuple[str, ...], text: str = "text") -> DataFrame:
    """The columns `keep` and the statistics of each text (long); null text counts as empty."""
    names, kept = [*COUNTS, *MORE], list(keep)
    docs, (text, *columns) = numbered(docs, text, *kept)

    def run(batches):
        for part, texts in rows_of(batches):
            counts = text_counts(texts)
            yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(len(columns))), *(pa.array(counts[c].astype(np.int64)) for c in names)], [*columns, *names])

    source = docs.select(*columns, F.col(text).cast("binary").alias("text"))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in source.schema.fields[:-1])
    return source.mapInArrow(run, schema + "".join(f", {c} long" for c in names)).toDF(*kept, *names)


def _features() -> list[Column]:
    c = {k: F.col(k).cast("double") for k in (*COUNTS, *MORE)}
    share = lambda a, b: F.sqrt(a / F.greatest(b, F.lit(1.0)))
    return [
        F.log1p(c["word_chars"] / F.greatest(c["n_words"], F.lit(1.0))),
        share(c["n_symbols"], c["n_words"]),
        share(c["n_upper"], c["word_chars"]),
        share(c["n_digits"], c["word_chars"]),
        share(c["n_dup_lines"], c["n_lines"]),
        share(c["n_repeat_words"], c["n_words"]),
        share(c["n_stutter"], c["n_words"]),
    ]


def chi_square_quantile(p: float, d: int) -> float:
    """The quantile by Wilson and Hilferty's approximation."""
    from statistics import NormalDist

    return d * (1 - 2 / (9 * d) + NormalDist().inv_cdf(p) * (2 / (9 * d)) ** 0.5) ** 3


def _distance(d: int, mean: str = "mean", inverse: str = "inverse") -> Column:
    """Squared Mahalanobis distance of columns x0.. under the arrays of a joined estimate."""
    diff = [F.col(f"x{i}") - F.col(mean)[i] for i in range(d)]
    terms = [diff[i] * diff[j] * F.col(inverse)[i * d + j] * (1 if i == j else 2) for i in range(d) for j in range(i, d)]
    return sum(terms[1:], terms[0])


def _estimate(count: float, sums: np.ndarray, products: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mean and covariance from the moments (products: upper triangle), LEAST_SPREAD squared added to the diagonal."""
    d = len(sums)
    mean = sums / count
    cov = np.zeros((d, d))
    cov[np.triu_indices(d)] = products / count
    cov = np.triu(cov) + np.triu(cov, 1).T - np.outer(mean, mean)
    return mean, (cov + cov.T) / 2 + np.diag(np.square(LEAST_SPREAD[:d]))


def _row(key: tuple, mean: np.ndarray, cov: np.ndarray) -> tuple:
    return (*key, mean.tolist(), np.linalg.inv(cov).ravel().tolist(), float(np.linalg.slogdet(cov)[1]))


_FITTED = "group string, start string, mean array<double>, inverse array<double>, log_det double"
_NAMES = ["group", "start", "mean", "inverse", "log_det"]


def _moments(d: int) -> list[str]:
    return [f"s{i}" for i in range(d)] + [f"p{i}_{j}" for i in range(d) for j in range(i, d)]


def _solve(pdf: pd.DataFrame, d: int, share: float) -> pd.DataFrame:
    """The estimate from a group's bins: those of the smallest distances that hold the share, and a row at least."""
    pdf = pdf.sort_values("bin")
    n = pdf["n"].to_numpy(float)
    take = np.searchsorted(np.cumsum(n), share * n.sum() - 1e-9) + 1
    sums = pdf[_moments(d)].to_numpy(float)[:take].sum(axis=0)
    return pd.DataFrame([_row((pdf["group"].iloc[0], pdf["start"].iloc[0]), *_estimate(n[:take].sum(), sums[:d], sums[d:]))], columns=_NAMES)


def _begin(pdf: pd.DataFrame, d: int) -> pd.DataFrame:
    """The starts of each group from its medians, deviations, plain moments and squashed moments."""
    out = []
    for r in pdf.to_dict("records"):
        middle, spread = (np.array([r[f"{k}_x{i}"] for i in range(d)], dtype=float) for k in "ma")
        floor = np.square(LEAST_SPREAD[:d])
        out.append(_row((r["group"], STARTS[0]), middle, np.diag(np.square(1.4826 * spread) + floor)))
        sums = np.array([r[c] for c in _moments(d)], dtype=float)
        out.append(_row((r["group"], STARTS[1]), *_estimate(r["n"], sums[:d], sums[d:])))
        squashed = np.array([r[f"z{c}"] for c in _moments(d)], dtype=float)
        scale = np.sqrt(np.square(1.4826 * spread) + floor)
        _, cov = _estimate(r["n"], squashed[:d], squashed[d:])
        cov = cov - np.diag(floor) + np.diag(np.full(d, 1e-3))
        root = np.sqrt(np.diag(cov))
        out.append(_row((r["group"], STARTS[2]), middle, cov / np.outer(root, root) * np.outer(scale, scale)))
    return pd.DataFrame(out, columns=_NAMES)


def _sums(x: list[Column], prefix: str = "") -> list[Column]:
    d = len(x)
    return [F.sum(c).alias(f"{prefix}s{i}") for i, c in enumerate(x)] + [F.sum(x[i] * x[j]).alias(f"{prefix}p{i}_{j}") for i in range(d) for j in range(i, d)]


def robust_estimates(rows: DataFrame, d: int, steps: int = STEPS, share: float = H) -> DataFrame:
    """group, mean, inverse (flat matrix), scale and rows of each group of rows (group, x0, x1, ...).

    From each start, concentration steps until the determinants settle, `steps` at most; then the start of the least determinant. The
    covariance includes LEAST_SPREAD squared on its diagonal, so a constant feature is no singularity. scale: what the median
    distance exceeds the expected by.
    """
    x = [f"x{i}" for i in range(d)]
    center = materialize(rows.groupBy("group").agg(*[F.percentile_approx(c, 0.5, 1000).alias(f"m_{c}") for c in x]), "rules-medians")
    near = rows.join(small(center), "group")
    squashed = [F.tanh((F.col(c) - F.col(f"m_{c}")) / (3 * LEAST_SPREAD[i])) for i, c in enumerate(x)]
    spreads = [F.percentile_approx(F.abs(F.col(c) - F.col(f"m_{c}")), 0.5, 1000).alias(f"a_{c}") for c in x]
    begun = near.groupBy("group").agg(F.count("*").alias("n"), *[F.first(f"m_{c}").alias(f"m_{c}") for c in x], *spreads, *_sums([F.col(c) for c in x]), *_sums(squashed, "z"))
    estimate = materialize(begun.mapInPandas(lambda parts: (_begin(pdf, d) for pdf in parts if len(pdf)), _FITTED), "rules-estimate")
    at = F.floor(F.log2(F.greatest(F.col("d2"), F.lit(1e-6))) * BINS_PER_OCTAVE).cast("int")
    before = None
    for _ in range(steps):
        placed = rows.join(small(estimate), "group").select("group", "start", *x, _distance(d).alias("d2"))
        bins = placed.groupBy("group", "start", at.alias("bin")).agg(F.count("*").alias("n"), *_sums([F.col(c) for c in x]))
        estimate = materialize(bins.groupBy("group", "start").applyInPandas(lambda pdf: _solve(pdf, d, share), _FITTED), "rules-estimate")
        now = estimate.agg(F.sum("log_det"), F.count("*")).first()
        if before is not None and now[0] is not None and abs(now[0] - before) <= SETTLED * now[1]:
            break
        before = now[0]
    best = estimate.groupBy("group").agg(F.min(F.struct("log_det", "start", "mean", "inverse")).alias("b")).select("group", "b.mean", "b.inverse")
    middle = rows.join(small(best), "group").groupBy("group").agg(F.count("*").alias("rows"), F.percentile_approx(_distance(d), 0.5, 1000).alias("middle"))
    scale = F.greatest(F.lit(1.0), F.col("middle") / chi_square_quantile(0.5, d))
    return materialize(best.join(middle, "group").select("group", "mean", "inverse", "rows", scale.alias("scale")), "rules-estimate")


def _drawn(pdf: pd.DataFrame, d: int) -> pd.DataFrame:
    """Of a language's estimates (and the whole table's), those of its groups, each drawn towards the wider one as by PRIOR_ROWS rows."""
    level = {r["group"]: (r["mean"], np.linalg.inv(np.array(r["inverse"]).reshape(d, d)) * r["scale"], r["rows"]) for r in pdf.to_dict("records")}

    def toward(own, wider):
        mean, cov, n = np.array(own[0], dtype=float), own[1], own[2]
        weight = n / (n + PRIOR_ROWS)
        gap = mean - wider[0]
        return wider[0] + weight * gap, weight * cov + (1 - weight) * (wider[1] + weight * np.outer(gap, gap)), n

    whole = level[_WHOLE]
    whole = np.array(whole[0], dtype=float), whole[1], whole[2]
    groups = pdf[pdf["level"] == 2]
    language = {r["group"]: toward(level[r["group"]], whole) for r in pdf[pdf["level"] == 1].to_dict("records")}
    out = []
    for r in groups.to_dict("records"):
        mean, cov, _ = toward(level[r["group"]], language[r["parent"]])
        out.append((r["group"], mean.tolist(), np.linalg.inv(cov).ravel().tolist()))
    return pd.DataFrame(out, columns=["group", "mean", "inverse"])


_WHOLE = "[]"


def group_name(*columns: str) -> Column:
    """One text for the values of some columns, nulls apart from all others."""
    return F.to_json(F.array(*[F.coalesce(F.concat(F.lit("="), F.col(c)), F.lit("")) for c in columns]))


def group_estimates(rows: DataFrame, d: int) -> DataFrame:
    """group, mean and inverse of every group of rows (lang, source, x0, ...), drawn towards wider ones."""
    level = lambda k, group, parent: F.struct(F.lit(k).alias("level"), group.alias("group"), parent.alias("parent"))
    levels = F.array(level(0, F.lit(_WHOLE), F.lit(_WHOLE)), level(1, group_name("lang"), F.lit(_WHOLE)), level(2, group_name("lang", "source"), group_name("lang")))
    x = [f"x{i}" for i in range(d)]
    dealt = rows.select(F.inline(levels), *x)
    estimates = robust_estimates(dealt.select("group", *x), d)
    kinds = materialize(dealt.select("level", "group", "parent").distinct(), "rules-groups")
    known = estimates.join(kinds, "group")
    # per language: its own estimate, those of its groups, and the whole table's
    family = F.when(F.col("level") == 2, F.col("parent")).otherwise(F.col("group"))
    own = known.filter("level > 0").withColumn("family", family)
    shared = own.select("family").distinct().crossJoin(F.broadcast(known.filter("level = 0")))  # one row
    out = own.unionByName(shared).groupBy("family").applyInPandas(lambda pdf: _drawn(pdf, d), "group string, mean array<double>, inverse array<double>")
    return materialize(out, "rules-drawn")


def judge(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", lang: str = "lang", source: str = "source") -> DataFrame:
    """doc_id, the counts, base_failed, distance (squared) and kept of every document.

    base_failed: fewer than 20 words, or over 30 % of them in repeated windows; such rows are not kept and no part of an
    estimate. Others are kept unless their distance is beyond the cut-off. Null text has no words; null languages and sources are
    values of their own. Repeated rows count each; an empty table gives no rows.
    """
    docs, (text, doc_id, lang, source) = numbered(docs, text, doc_id, lang, source)
    named = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.col(lang).cast("string").alias("lang"), F.col(source).cast("string").alias("source"))
    counts = count_texts(named, ("doc_id", "lang", "source"))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    x = _features()
    rows = materialize(counts.select("doc_id", "lang", "source", *COUNTS, failed.alias("base_failed"), *[c.alias(f"x{i}") for i, c in enumerate(x)]), "rules-rows")
    d = len(x)
    good = rows.filter("not base_failed").withColumn("group", group_name("lang", "source"))
    estimates = group_estimates(good.select("lang", "source", *[f"x{i}" for i in range(d)]), d)
    judged = good.join(small(estimates), "group").withColumn("distance", _distance(d))
    out = ["doc_id", *COUNTS, "base_failed"]
    kept = F.col("distance") <= chi_square_quantile(CUTOFF, d)
    return judged.select(*out, "distance", kept.alias("kept")).unionByName(rows.filter("base_failed").select(*out, F.lit(None).cast("double").alias("distance"), F.lit(False).alias("kept")))
