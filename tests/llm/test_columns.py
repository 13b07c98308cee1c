"""Extra columns with clashing names change nothing: dots, internal-looking names, other letter case."""

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from docketspark.llm import lm_scoring, mixing, near_copies, packing, pii, quality_classifier, quality_rules, secrets, simhash, token_counts


@pytest.fixture(scope="module")
def both(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").filter("doc_id < 60").cache()
    names = [*docs.columns, "a.b", "__text", "Doc_Id", "score", "fp", "key", "c0"]
    odd = docs.select("*", F.lit(1), F.lit("x"), F.lit(-1), F.lit(2), F.lit(3), F.lit(4), F.lit(5)).toDF(*names)
    return docs, odd


def rows(frame):
    return sorted((tuple(map(str, r)) for r in frame.collect()), key=str)


@pytest.mark.parametrize(
    "run",
    [
        lambda d: mixing.mixture(d).select("doc_id", "size", "taken"),
        lambda d: quality_rules.judge(d).select("doc_id", "n_words", "kept"),
        lambda d: packing.pack_documents(d, public_tokenizers.path("byte_bpe_50k.json")).select("doc_id", "piece", "length"),
        lambda d: lm_scoring.score_texts(d).select("doc_id", "n_known", F.round("score", 6)),
        lambda d: pii.personal_data(d).select("doc_id", F.size("spans")),
        lambda d: simhash.near_duplicate_groups(d),
    ],
)
def test_results_do_not_depend_on_other_columns(both, run):
    assert rows(run(both[0])) == rows(run(both[1]))


def test_rows_come_back_with_all_columns(spark, both):
    docs, odd = both
    model = quality_classifier.train(odd, spark.read.parquet("/root/testdata/sf0.001/labels.parquet"))
    forest = secrets.train(secrets.example_findings(spark, 200).withColumn("coverage", F.lit(0.0)), trees=3)
    outs = {
        "accepted": quality_classifier.accepted(odd, model), "one": simhash.keep_one_per_group(odd), "near": near_copies.keep_one_per_group(odd), "mix": mixing.mixed_documents(odd), "redact": secrets.redact(odd, forest),
    }
    for name, out in outs.items():
        assert out.columns == odd.columns and out.count() > 0, name
    counted = token_counts.count_tokens(odd, public_tokenizers.path("word_bpe_49k.json"))
    assert counted.columns == [*odd.columns, "n_bytes", "n_tokens"] and counted.count() == odd.count()
