"""Token counts against the libraries, and the cache's effect."""

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from docketspark.llm import token_counts
from docketspark.llm.queries import op8_token_counts

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = [None, "", "   ", "a\n\tb", "A  b", "É Ñ ß Ω ΑΣ", "é x", "x y z", "<|endoftext|> a<|startoftext|>", "<|ENDOFTEXT|>", "don't we'll", "1234 5,6", "中文 \U0001f600", "a\x1cb \x1c c", "word " * 20000]


def test_query_equals_library(spark, sf_dir):
    tokenizer = Tokenizer.from_file(PATH)
    want = {(r.doc_id, len((r.text or "").encode()), n := len(tokenizer.encode(r.text or "", add_special_tokens=False).ids), n > 2048) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    assert {tuple(r) for r in op8_token_counts(spark, sf_dir).collect()} == want


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json", "piece_bpe_32k.model"])
def test_odd_texts(spark, name):
    path = public_tokenizers.path(name)
    if name.endswith(".model"):
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        count = lambda t: len(model.encode(t))
    else:
        tokenizer = Tokenizer.from_file(path)
        count = lambda t: len(tokenizer.encode(t, add_special_tokens=False).ids)
    docs = spark.createDataFrame([(i if i else None, t, "x", 7) for i, t in enumerate(ODD + ODD[:3])], "doc_id long, text string, digest string, N_Tokens int")
    out = token_counts.count_tokens(docs, path, collapse=name.startswith("word"))
    assert out.columns == ["doc_id", "text", "digest", "n_bytes", "n_tokens"]
    got = {(r.doc_id, r.text, r.n_bytes, r.n_tokens) for r in out.collect()}
    assert out.count() == len(ODD) + 3
    assert got == {(i if i else None, t, len((t or "").encode()), count(t or "")) for i, t in enumerate(ODD + ODD[:3])}


def test_cache_is_read_and_appended(spark, tmp_path):
    cache = str(tmp_path / "cache")
    first = spark.createDataFrame([(1, "a b"), (2, "a  b "), (3, "c")], "doc_id long, text string")
    token_counts.count_tokens(first, PATH, cache)
    stored = spark.read.parquet(cache)
    assert stored.count() == 2
    # a stored count is believed: only what is missing is encoded
    spark.createDataFrame([(r.digest, r.version, 99) for r in stored.collect()], token_counts.CACHE).write.mode("append").parquet(cache)
    again = token_counts.count_tokens(first.unionByName(spark.createDataFrame([(4, "d e")], first.schema)), PATH, cache)
    assert {(r.doc_id, r.n_tokens) for r in again.collect()} == {(1, 99), (2, 99), (3, 99), (4, 2)}
    other = token_counts.count_tokens(first, public_tokenizers.path("byte_bpe_50k.json"), cache, collapse=False)
    assert {(r.doc_id, r.n_tokens) for r in other.collect()} == {(1, 2), (2, 4), (3, 1)}
    assert token_counts.count_tokens(first.limit(0), PATH, cache).count() == 0
