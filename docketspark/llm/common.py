"""Helpers shared by the corpus operators: shared work tables, row batches, byte-level word splitting, word-wise tokenizing."""

from __future__ import annotations

import json
import os
import re
import uuid
import weakref
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docketspark.sources.snapshots import shared_root

#: Words are runs of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
#: A side with at most this many (narrow) rows may be broadcast; it is counted first.
BROADCAST_ROWS = 20_000
#: Python works through a batch of rows in pieces of about this many bytes of text.
PIECE_BYTES = 2 << 20

def work_root(spark: SparkSession) -> str:
    """The shared folder for intermediate tables: spark.checkpoint.dir, or a temporary folder in local mode."""
    return shared_root(spark)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df as a table in the shared folder and read it back: cuts the lineage, survives lost executors."""
    path = f"{work_root(df.sparkSession)}/docketspark/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    _paths[out] = path
    return out


#: Where materialize() has put a table.
_paths: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def discard(*written: DataFrame) -> None:
    """Delete tables that materialize() made, once all that was derived from them is written itself."""
    for df in written:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(_paths.pop(df))
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def released(written: DataFrame, *shared: Broadcast) -> DataFrame:
    """written, a table that materialize() made; the broadcast variables that its rows needed are given back, on the driver as well."""
    for variable in shared:
        variable.destroy()
    return written


def numbered(docs: DataFrame, *names: str | None) -> tuple[DataFrame, list[str | None]]:
    """docs with its columns called c0, c1, ... and what the named ones are called now: the one of exactly that name, else regardless of case.

    So no column of the input, whatever its name, can clash with an operator's own; toDF(*docs.columns) gives the names back.
    """
    have = docs.columns
    lower = [c.lower() for c in have]
    places = [None if n is None else have.index(n) if n in have else lower.index(n.lower()) for n in names]
    return docs.toDF(*[f"c{i}" for i in range(len(have))]), [None if p is None else f"c{p}" for p in places]


def small(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if a count proves that it has at most `limit` rows; else df, for a shuffled join."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names that df does not have, whatever the letter case."""
    have, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in have:
            name = f"_{name}"
        have.add(name.lower())
        out.append(name)
    return out


def fold(doc_id: str | Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; a null id counts as the empty text."""
    col = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(col.cast("string"), F.lit("")).cast("binary")) % F.lit(n)


def pieces(sizes: Iterable[int], limit: int = PIECE_BYTES) -> Iterator[tuple[int, int]]:
    """(first, end) of consecutive rows that hold about `limit` bytes together, one row at least."""
    first, total, end = 0, 0, 0
    for end, size in enumerate(sizes):
        if total and total + size > limit:
            yield first, end
            first, total = end, 0
        total += size + 1
    if total:
        yield first, end + 1


def rows_of(batches: Iterator[pa.RecordBatch], text: str = "text") -> Iterator[tuple[pa.RecordBatch, list]]:
    """Slices of the batches with their texts (None becomes empty), a few MB of text at a time."""
    for batch in batches:
        column = batch.column(batch.schema.get_field_index(text))
        sizes = pc.binary_length(column).fill_null(0).to_pylist()
        for first, end in pieces(sizes):
            part = batch.slice(first, end - first)
            values = part.column(part.schema.get_field_index(text)).to_pylist()
            empty = b"" if pa.types.is_binary(column.type) else ""
            yield part, [empty if v is None else v for v in values]


def whole_runs(batches: Iterator[pa.RecordBatch], keys: int, rows: int) -> Iterator[pa.Table]:
    """Tables of about `rows` rows of sorted batches, cut only where the first `keys` columns change; so no more than a run and a batch are held."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) < rows:
            continue
        table = pa.Table.from_batches(held).combine_chunks()
        changes = [np.flatnonzero(c[1:] != c[:-1]) for c in (table.column(i).to_numpy() for i in range(keys))]
        last = max((int(c[-1]) + 1 for c in changes if len(c)), default=0)
        if last:
            yield table.slice(0, last)
        held = table.slice(last).to_batches()
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


SPACE = np.zeros(256, dtype=bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True


def mix64(h: np.ndarray) -> np.ndarray:
    """A bijective scrambling of unsigned 64-bit numbers (the finalizer of splitmix64)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base modulo 2^64, and of its inverse, up to n at least."""
    size = 1 << max(22, int(n).bit_length())
    if size not in _powers:
        base = 0x9E3779B97F4A7C15
        tables = []
        for b in (base, pow(base, -1, 1 << 64)):
            steps = np.full(size, b, dtype=np.uint64)
            steps[0] = 1
            tables.append(np.cumprod(steps, dtype=np.uint64))
        if size > 1 << 22:
            return tables[0], tables[1]  # for one huge text only; not kept
        _powers[size] = (tables[0], tables[1])
    return _powers[size]


_byte_values = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


class SpanHasher:
    """64-bit hashes of any span of a byte buffer from one prefix sum."""

    def __init__(self, data: np.ndarray):
        power, self.inverse = _power_tables(len(data) + 1)
        self.prefix = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum(_byte_values[data] * power[: len(data)], out=self.prefix[1:], dtype=np.uint64)

    def spans(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix64((self.prefix[end] - self.prefix[start]) * self.inverse[start] + (end - start).astype(np.uint64))


def word_spans(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words in a buffer that ends with white space."""
    space = SPACE[data]
    change = np.flatnonzero(space[1:] != space[:-1]) + 1
    if len(space) and not space[0]:
        change = np.concatenate([[0], change])
    return change[0::2], change[1::2]


def _byte_symbols() -> dict[str, int]:
    """The printable stand-ins for bytes in byte-level vocabularies: a printable Latin-1 byte is itself, the others follow from U+0100."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}


def _rank_encoding(spec: dict):
    """A faster encoder of the same ids for a plain byte-level BPE whose merges are in the order of the ids; else None."""
    import tiktoken

    model, before = spec["model"], spec.get("pre_tokenizer") or {}
    plain = before.get("type") == "ByteLevel" and before.get("use_regex") and not before.get("add_prefix_space") and not spec.get("normalizer")
    if not plain or model.get("type") != "BPE" or any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")):
        return None
    symbols, vocab = _byte_symbols(), model["vocab"]
    merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    special = {t["content"] for t in spec.get("added_tokens", [])}
    if [vocab.get(a + b) for a, b in merges] != list(range(256, 256 + len(merges))) or not all(c in vocab for c in symbols):
        return None
    ranks = {bytes(symbols[c] for c in token): i for token, i in vocab.items() if token not in special}
    # fixed value: how a byte-level BPE of this kind splits a text
    pattern = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    return tiktoken.Encoding("byte-level", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


class WordEncoder:
    """Token ids of texts by a tokenizers file; frequent words, each with the white space before it, are encoded once.

    A byte-level or word BPE never joins the end of a word with the white space behind it, so a text's ids are those of its
    words, each with the white space before it. Texts for which that is not certain (white space other than
    ASCII, or a special token's string) are encoded whole. Words of letters up to U+024F, on which all versions of
    Unicode agree, may go through _rank_encoding.
    """

    _chunks = re.compile(r"\s*\S+|\s+")
    _exotic = re.compile(r"[^\S\x09-\x0d\x20]")

    def __init__(self, path: str, memo_words: int = 200_000):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        spec = json.loads(self.tokenizer.to_str())
        #: Only such tokenizers end a token wherever white space begins.
        self.by_words = '"ByteLevel"' in json.dumps(spec.get("pre_tokenizer"))
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.rank = _rank_encoding(spec)
        self.memo: dict[str, bytes] = {}
        self.memo_words = memo_words

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, dtype="<u4").tobytes() for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]

    def _words(self, words: list[str]) -> list[bytes]:
        if self.rank is None:
            return self._whole(words)
        encode = self.rank.encode_ordinary
        out = [array("I", encode(w)).tobytes() if max(w) < "\u0250" else b"" for w in words]
        other = [i for i, w in enumerate(words) if max(w) >= "\u0250"]
        for i, ids in zip(other, self._whole([words[i] for i in other]), strict=True):
            out[i] = ids
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        """Each text's ids as little-endian unsigned 32-bit numbers."""
        memo, split, whole = self.memo, [], []
        for i, text in enumerate(texts):
            if not self.by_words or self._exotic.search(text) or any(s in text for s in self.special):
                whole.append(i)
                split.append(())
            else:
                split.append(self._chunks.findall(text))
        new = list({w for words in split for w in words if w not in memo})
        found = dict(zip(new, self._words(new), strict=True))
        memo.update(found)
        out = [b"".join(map(memo.__getitem__, words)) for words in split]
        if len(memo) > self.memo_words:  # the words that came first stay: they are mostly the frequent ones
            for word in new:
                del memo[word]
        for i in whole:
            out[i] = self._whole([texts[i]])[0]
        return out


class PieceEncoder:
    """Token ids of texts by a sentencepiece model."""

    def __init__(self, path: str):
        import sentencepiece

        self.processor = sentencepiece.SentencePieceProcessor(model_file=path)

    def encode(self, texts: list[str]) -> list[bytes]:
        return [np.array(ids, dtype="<u4").tobytes() for ids in self.processor.encode(texts, num_threads=1)]


_encoders: dict[str, WordEncoder | PieceEncoder] = {}


def encoder(path: str) -> WordEncoder | PieceEncoder:
    """This worker's encoder for a tokenizer file; kept between tasks."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    if path not in _encoders:
        _encoders[path] = PieceEncoder(path) if path.endswith(".model") else WordEncoder(path)
    return _encoders[path]
