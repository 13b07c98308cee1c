"""Secret scans: patterns propose candidates, a random forest removes the false positives. DataFrame operations and MLlib only.

A text is split at the candidates, so that each has its place and its neighbouring words without any Python. A candidate is
described by its length, the transitions between kinds of characters, how much of it words of the corpus' dictionary
cover, its path and the words around it. The forest is trained on labelled findings, of which there may be a bounded number.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.ml import PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.pipeline import Pipeline
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, materialize, numbered, small

#: Labelled findings that the forest is trained on, at most.
TRAINING_ROWS = 20_000
TREES = 40
DEPTH = 8
THRESHOLD = 0.5
SEED = 17
#: Characters before and after a candidate that count as its neighbourhood.
BEFORE, AFTER = 64, 32
#: A word is in the dictionary if so many documents have it.
DICTIONARY_DOCS = 3
#: Words that the examples' phrases are made of.
WORDS = 12
PLAIN_WORDS = ("river", "report", "season", "garden", "window", "budget", "market", "signal", "letter", "summer", "planet", "object")
MARK = "[secret]"

# fixed values: words that name a secret, and words that name other things of the same look
NAMES = "password|passwd|pwd|secret|token|api[_-]?key|access[_-]?key|auth[_-]?key|private[_-]?key|credential"
GOOD_WORDS = NAMES + "|bearer|authorization|authentication|login"
OTHER_WORDS = "commit|revision|checksum|digest|sha1|sha256|md5|hash|uuid|guid|example|sample|placeholder|dummy|version|build|order|invoice|isbn|card|iban|phone|doi|http|www"
TEST_PATH = "test|example|sample|mock|fixture|docs?/|readme|\\.md$|\\.lock$|\\.min\\."
CODE_PATH = "\\.env|config|settings|deploy|secret|\\.ya?ml$|\\.tf$|\\.properties$|\\.pem$|\\.key$"

_BLOCK = "-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----[A-Za-z0-9+/=\\s]++(?:-----END [A-Z ]{0,20}PRIVATE KEY-----)?"
_NAMED = f"(?i:{NAMES})[\"']?\\s{{0,3}}(?:=>|:=|[:=])\\s{{0,3}}[\"']?[^\\s\"'<>]{{8,}}+"
_ASSIGNED = "(?<=[A-Za-z0-9_-]=)(?=[^\\s\"'<>&;,0-9]*+[0-9])[^\\s\"'<>&;,]{8,}+"
_RUN = "(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*+[0-9])[A-Za-z0-9+/_-]{16,}+={0,2}"
CANDIDATE = f"{_BLOCK}|{_NAMED}|{_ASSIGNED}|{_RUN}"
#: Within a candidate, what names the value and what stands between.
_PREFIX = f"^(?i:{NAMES})[\"']?\\s{{0,3}}(?:=>|:=|[:=])\\s{{0,3}}[\"']?"
#: Lower-case text before a value: a name of secrets, maybe with a number or the like behind it, and the assignment.
_UNDER_NAME = f"({NAMES}|(?<![a-z])(pass|pat|sig|signature))([_-][a-z0-9]{{1,8}}){{0,2}}[\"']?\\s*(=>|:=|[:=])\\s*[\"']?$"

FEATURES = (
    "length", "log_length", "digits", "upper", "lower", "hex", "other", "switches", "letter_digit", "case_switches",
    "longest_letters", "distinct", "vowels", "repeats", "coverage", "named", "assigned", "quoted", "good_words", "other_words", "own_words",
    "known_form", "test_path", "code_path",
)


def may_hold(text: Column) -> Column:
    """Whether a text has a candidate; three cheap conditions, of which each candidate meets one, come before the pattern."""
    cheap = text.contains("=") | text.contains(":") | text.contains("-----BEGIN") | text.rlike("[A-Za-z0-9+/_-]{16}")
    return F.coalesce(cheap & text.rlike(CANDIDATE), F.lit(False))


def _text(column: Column | str) -> Column:
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def candidates(docs: DataFrame, text: str, keys: list[str], path: str | None = None) -> DataFrame:
    """keys, place (from 0 in each text), start, end (code points, end exclusive), value, before, after and path of every candidate in the whole texts.

    A candidate is a private key block, a value of at least 8 characters assigned to a name such as token, the same with a digit right behind
    any name and =, or an unbroken run of at least 16 letters, digits and +/_- with a digit. Null and empty texts have none; rows of equal
    keys and text count once, with the smallest path. Starts are running sums over a text's gaps and candidates, so that time grows
    in proportion to the candidates, however many a text has.
    """
    t = _text(text)
    found = docs.filter(may_hold(F.col(text))).select(
        *keys, F.xxhash64(text).alias("__h"), (_text(path) if path else F.lit("")).alias("path"), F.split(t, CANDIDATE, -1).alias("gaps"), F.regexp_extract_all(t, F.lit(CANDIDATE), F.lit(0)).alias("hits")
    )
    last = F.expr("concat(array(''), slice(hits, 1, size(hits) - 1))")
    parts = F.arrays_zip(F.expr("slice(gaps, 1, size(hits))").alias("gap"), F.expr("slice(gaps, 2, size(hits))").alias("next"), F.col("hits").alias("hit"), last.alias("last"))
    rows = found.select(*keys, "__h", "path", F.posexplode(parts).alias("place", "c"))
    behind = F.when(F.col("c.gap") == "", F.col("c.last")).otherwise(F.col("c.gap"))
    rows = rows.select(
        *keys, "__h", "path", "place", F.length("c.gap").alias("skip"), F.col("c.hit").alias("hit"), F.right(behind, F.lit(BEFORE)).alias("before"), F.left("c.next", F.lit(AFTER)).alias("after")
    )
    rows = rows.groupBy(*keys, "__h", "place", "skip", "hit", "before", "after").agg(F.min("path").alias("path"))
    so_far = Window.partitionBy(*keys, "__h").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    prefix = F.regexp_extract("hit", _PREFIX, 0)
    rows = rows.withColumns({"end": F.sum(F.col("skip") + F.length("hit")).over(so_far), "prefix": prefix})
    value = F.substring(F.col("hit"), F.length("prefix") + 1, F.length("hit"))
    return rows.select(*keys, "place", (F.col("end") - F.length(value)).alias("start"), "end", value.alias("value"), F.concat("before", "prefix").alias("before"), "after", "path")


def letter_runs(rows: DataFrame) -> DataFrame:
    """word: the distinct runs of 4 to 16 letters in the values, in lower case."""
    return rows.select(F.explode(F.regexp_extract_all(F.lower("value"), F.lit("[a-z]{4,16}"), F.lit(0))).alias("word")).distinct()


def dictionary(docs: DataFrame, text: str = "text", min_docs: int = DICTIONARY_DOCS, only: DataFrame | None = None) -> DataFrame:
    """The corpus' words (lower case, 4 to 16 letters, standing alone) that at least min_docs documents have; counted over all documents.

    only: rows of words to which the count is confined before anything is shuffled.
    """
    words = F.array_distinct(F.split(F.lower(_text(text)), "[\\s.,;:!?()\"'|$%&#*-]+"))
    words = docs.select(F.explode(F.filter(words, lambda w: F.length(w).between(4, 16) & w.rlike("^[a-z]+$"))).alias("word"))
    if only is not None:
        words = words.join(small(only), "word", "left_semi")
    return words.groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= min_docs).select("word")


def with_coverage(rows: DataFrame, words: DataFrame) -> DataFrame:
    """rows with `coverage`: the share of the value's characters in letter runs (4 or more) that are dictionary words."""
    values = materialize(rows.select("value").distinct().select("value", F.regexp_extract_all(F.lower("value"), F.lit("[a-z]{4,16}"), F.lit(0)).alias("runs")), "secrets-values")
    runs = values.select("value", F.explode("runs").alias("word"))
    sums = runs.join(small(words), "word", "left_semi").groupBy("value").agg(F.sum(F.length("word")).alias("covered"))
    sums = materialize(sums, "secrets-coverage")
    return rows.join(small(sums), "value", "left").withColumn("coverage", F.coalesce(F.col("covered"), F.lit(0)) / F.length("value")).drop("covered")


def with_features(rows: DataFrame) -> DataFrame:
    """rows (value, before, after, path, coverage) with the columns FEATURES."""
    v, n = F.col("value"), F.greatest(F.length("value"), F.lit(1))
    share = lambda pattern: F.regexp_count(v, F.lit(pattern)) / n
    runs = F.regexp_extract_all(v, F.lit("[A-Za-z]+"), F.lit(0))
    longest = F.aggregate(F.transform(runs, F.length), F.lit(0), lambda a, b: F.greatest(a, b))
    before, after, path = F.lower("before"), F.lower("after"), F.lower("path")
    known = v.rlike("^(AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{20,}|xox[abprs]-|sk_(live|test)_|eyJ[A-Za-z0-9_-]{10,}|-----BEGIN)")
    columns = {
        "length": F.least(n, F.lit(400)), "log_length": F.log2(n), "digits": share("[0-9]"), "upper": share("[A-Z]"), "lower": share("[a-z]"), "hex": share("[0-9a-fA-F]"), "other": share("[^0-9A-Za-z]"),
        "switches": share("(?<=[0-9])[^0-9]|(?<=[^0-9])[0-9]"), "letter_digit": share("(?<=[A-Za-z])[0-9]"), "case_switches": share("(?<=[a-z])[A-Z]|(?<=[A-Z])[a-z]"),
        "longest_letters": F.least(longest, F.lit(100)), "distinct": F.size(F.array_distinct(F.split(v, ""))) / F.least(n, F.lit(64)), "vowels": share("[aeiouAEIOU]"), "repeats": share("(.)(?=\\1)"),
        "coverage": F.col("coverage"), "named": before.rlike(_UNDER_NAME).cast("int"), "assigned": before.rlike("(=|:)\\s*[\"']?$").cast("int"), "quoted": (before.rlike("[\"']$") & after.rlike("^[\"']")).cast("int"),
        "good_words": F.regexp_count(before, F.lit(GOOD_WORDS)), "other_words": F.regexp_count(F.concat(before, F.lit(" "), after), F.lit(OTHER_WORDS)), "own_words": F.regexp_count(F.lower(v), F.lit("example|sample|test|dummy|your|change|here|xxxx|0000|1234|abcd")),
        "known_form": known.cast("int"), "test_path": path.rlike(TEST_PATH).cast("int"), "code_path": path.rlike(CODE_PATH).cast("int"),
    }
    return rows.withColumns({k: F.coalesce(columns[k].cast("double"), F.lit(0.0)) for k in FEATURES})


def example_words(found: DataFrame) -> list[str]:
    """WORDS words of 5 to 9 letters that stand near the most candidates, for the examples' phrases; filled up with fixed ones."""
    words = F.array_distinct(F.split(F.lower(F.concat_ws(" ", "before", "after")), "[^a-z]+"))
    counted = found.select(F.explode(F.filter(words, lambda w: F.length(w).between(5, 9))).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    usual = [w for w in counted.orderBy(F.desc("n"), "word").limit(4 * WORDS).toPandas()["word"] if not re.search(f"{GOOD_WORDS}|{OTHER_WORDS}", w)]
    return [*usual, *(w for w in PLAIN_WORDS if w not in usual)][:WORDS]


def example_findings(spark: SparkSession, n: int = 6000, words: Sequence[str] = PLAIN_WORDS) -> DataFrame:
    """Labelled findings (value, before, after, path, label, form) of common forms, for use where no reviewed ones are at hand.

    Half are secrets: digests and base-64 texts under names that secrets have, tokens of well-known forms, passwords. The others are what
    looks similar: commit ids, checksums, UUIDs, long numbers, placeholders, paths and phrases of the given words. A digest in plain prose
    occurs under both labels, three times as often as no secret. All follow from the row's number.
    """
    i = F.col("id")
    pick = lambda salt, *options: F.element_at(F.array(*[F.lit(o) for o in options]), (F.pmod(F.xxhash64(F.lit(salt), i), F.lit(len(options))) + 1).cast("int"))
    number = lambda salt, below: F.pmod(F.xxhash64(F.lit(salt), i), F.lit(below)).cast("int")
    h = F.sha2(F.concat(F.lit("finding"), i.cast("string")), 256)
    # each step uses the columns of the one before, so that no expression is repeated within another
    rows = spark.range(n).select("id", h.alias("h"), (F.pmod(i, F.lit(2)) == 0).alias("good"), *[pick(k, *words).alias(f"w{k}") for k in "abcdef"])
    rows = rows.withColumns({
        "both": F.concat("h", F.sha1("h")), "year": (number("year", 60) + 1970).cast("string"), "size": number("size", 40) + 20,
        "name": pick("name", "token", "api_key", "secret", "password", "access_key", "auth_key", "client_secret", "TOKEN", "API-KEY", "private_key"),
        "phrase": F.concat("wa", pick("s1", "-", "_", "/", ""), "wb", pick("s2", "-", "_", "/"), "wc"),
        "harmless_kind": number("kind", 15), "secret_kind": number("kind", 15), "prose": number("prose", 8),
    })
    rows = rows.withColumns({"mixed": F.regexp_replace(F.base64(F.unhex("both")), "[+/=]", ""), "digits": F.regexp_replace("both", "[a-f]", "")})
    left = lambda c, k: F.left(F.col(c), F.lit(k))
    hex40 = left("h", 40)
    secret = (
        ("hex", hex40), ("hex", hex40), ("hex", left("h", 32)), ("upper_hex", F.upper(hex40)), ("hex", F.col("h")), ("base62", F.left("mixed", F.col("size"))), ("base62", F.left("mixed", F.col("size"))),
        ("base64", F.left(F.base64(F.unhex("h")), F.col("size"))), ("aws", F.concat(F.lit("AKIA"), F.upper(left("h", 16)))), ("github", F.concat(pick("gh", "ghp_", "gho_", "ghs_"), left("mixed", 36))),
        ("slack", F.concat(F.lit("xoxb-"), left("digits", 12), F.lit("-"), left("mixed", 24))), ("stripe", F.concat(F.lit("sk_live_"), left("mixed", 24))),
        ("jwt", F.concat(F.lit("eyJ"), left("mixed", 40), F.lit(".eyJ"), F.right("mixed", F.lit(20)))), ("password", F.concat(left("mixed", 6), pick("p", "!", "#", "%", "?"), F.right("mixed", F.lit(6)))),
        ("key_block", F.concat(F.lit("-----BEGIN RSA PRIVATE KEY-----\n"), F.repeat("mixed", 6), F.lit("\n-----END RSA PRIVATE KEY-----"))),
    )
    harmless = (
        ("digest", hex40), ("digest", left("h", 32)), ("digest", F.col("h")), ("uuid", F.regexp_replace(left("h", 32), "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")), ("number", left("digits", 16)), ("number", left("digits", 16)), ("number", left("digits", 20)),
        ("phrase", F.concat("phrase", F.lit("-"), "year")), ("path", F.concat("phrase", "year", F.lit("/"), "we")), ("account", F.concat(F.lit("DE"), left("digits", 20))), ("phrase", F.concat("phrase", F.lit("_"), left("digits", 3))),
        ("placeholder", F.concat(pick("ph", "your_", "my_", "example_", "dummy_"), "phrase", F.lit("_here1"))), ("filler", F.concat(F.repeat(pick("x", "x", "X", "0", "a"), F.lit(16)), left("digits", 4))), ("filler", F.lit("0123456789abcdef0123456789abcdef")), ("placeholder", F.concat(F.lit("EXAMPLEKEY"), left("digits", 8))),
    )
    chosen = lambda forms, kind, part: F.coalesce(*[F.when(F.col(kind) == k, F.lit(f[0]) if part == 0 else f[1]) for k, f in enumerate(forms)])
    in_prose = (F.col("prose") == 0) & F.when(F.col("good"), number("one", 3) == 0).otherwise(F.lit(True))
    rows = rows.withColumns({
        "form": F.when(in_prose, F.lit("hex_in_prose")).when(F.col("good"), chosen(secret, "secret_kind", 0)).otherwise(chosen(harmless, "harmless_kind", 0)),
        "value": F.when(in_prose, hex40).when(F.col("good"), chosen(secret, "secret_kind", 1)).otherwise(chosen(harmless, "harmless_kind", 1)),
        "named": F.concat("wd", F.lit(" "), "name", pick("op", ' = "', "=", ": ", ": '", ' := "', '="')),
        "bare": pick("lead", "Authorization: Bearer ", "login with ", "credentials are "),
        "line": F.concat(F.lit("\n"), pick("line", "AWS_ACCESS_KEY_ID", "token_v2", "DB_PASS", "export GITHUB_PAT", "api_key_1", "https://www.host.org/get?sig", "client_secret_id", "STRIPE_TOKEN_LIVE"), F.lit("=")),
        "plain": pick("at", "commit ", "sha256:", "checksum ", "md5 ", "id=", "uuid: ", "revision ", "order ", "card ", "see http://www.host.org/", 'digest = "', "version ", "example: "),
        "running": F.concat("wd", F.lit(" "), "wf", pick("end", " ", ", ", ". ", " | ", "\n", "!! ", "$$$ ")),
    })
    # a placeholder, number or phrase is harmless under any name
    open_ = ~F.col("form").isin("digest", "uuid", "hex_in_prose")
    good_before = F.when(number("bare", 5) == 0, F.col("bare")).when(number("env", 5) == 0, F.col("line")).otherwise(F.col("named"))
    other_before = F.when(open_ & (number("under", 4) == 0), F.col("named")).when(open_ & (number("pr", 4) > 0), F.col("running")).otherwise(F.col("plain"))
    rows = rows.withColumn("before", F.when(F.col("form") == "hex_in_prose", F.col("running")).when(F.col("good"), good_before).otherwise(other_before))
    quote = F.regexp_extract("before", "[\"']$", 0)
    paths = F.when(number("typical", 4) > 0, pick("path", "", "", "src0", "src7", "app/settings.py", "deploy/values.yaml", "lib/main.py")).when(F.col("good"), pick("gp", ".env", "config/prod.yml")).otherwise(pick("op", "docs/readme.md", "tests/fixtures/data.json"))
    return rows.select("value", "before", F.concat(quote, pick("tail", " ", " and ", ".", "\n", "")).alias("after"), paths.alias("path"), F.col("good").cast("int").alias("label"), "form")


def train(findings: DataFrame, rows: int = TRAINING_ROWS, trees: int = TREES, depth: int = DEPTH) -> PipelineModel:
    """A random forest from labelled findings (value, before, after, path, coverage, label 0/1), the first `rows` by a hash of their content.

    Findings with a null value or label are left out. Both labels must occur.
    """
    used = findings.filter("value is not null and label in (0, 1)")
    used = used.orderBy(F.xxhash64("value", "before", "after", "path", "label"), "value", "label").limit(rows)
    used = materialize(with_features(used).select(*FEATURES, F.col("label").cast("double").alias("label")), "secrets-training")
    forest = RandomForestClassifier(featuresCol="features", labelCol="label", numTrees=trees, maxDepth=depth, seed=SEED, featureSubsetStrategy="sqrt")
    return Pipeline(stages=[VectorAssembler(inputCols=list(FEATURES), outputCol="features"), forest]).fit(used)


def scan(docs: DataFrame, model: PipelineModel | None = None, text: str = "text", doc_id: str = "doc_id", path: str | None = "source", threshold: float = THRESHOLD) -> DataFrame:
    """Candidates with verdicts: doc_id, text_hash (xxhash64 of the text), place, start, end, value, before, after, path, score and secret.

    Each distinct (doc_id, text) counts once, so repeated rows share their candidates. A null doc_id stays null. Without a model one is
    trained on example_findings with phrases of the corpus' own words, whose coverage comes from the same dictionary. A document without candidates, a null or empty text and an empty table give no rows.
    """
    docs, (text, doc_id, path) = numbered(docs, text, doc_id, path)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.xxhash64(text).alias("text_hash"), (F.col(path) if path else F.lit("")).cast("string").alias("path"))
    found = materialize(candidates(rows, "text", ["doc_id", "text_hash"], "path"), "secrets-candidates")
    runs = letter_runs(found)
    if model is None:
        examples = materialize(example_findings(docs.sparkSession, words=example_words(found)), "secrets-examples")
        runs = runs.unionByName(letter_runs(examples)).distinct()
    words = materialize(dictionary(rows, only=materialize(runs, "secrets-runs")), "secrets-words")
    rows = materialize(with_coverage(found, words), "secrets-covered")
    model = model or train(with_coverage(examples, words))
    scored = model.transform(with_features(rows)).withColumn("score", vector_to_array("probability")[1])
    scored = scored.select("doc_id", "text_hash", "place", "start", "end", "value", "before", "after", "path", "score", (F.col("score") >= threshold).alias("secret"))
    return materialize(scored, "secrets-scored")


def spans(found: DataFrame) -> DataFrame:
    """doc_id, text_hash, n_candidates, n_secrets and secrets, an array of (start, end, score) in the order of the text, from scan()."""
    one = F.struct("start", "end", "score")
    listed = F.sort_array(F.collect_list(F.when(F.col("secret"), one)))
    return found.groupBy("doc_id", "text_hash").agg(F.count("*").alias("n_candidates"), F.count_if("secret").alias("n_secrets"), listed.alias("secrets"))


def report(docs: DataFrame, model: PipelineModel | None = None, text: str = "text", doc_id: str = "doc_id", path: str | None = "source") -> DataFrame:
    """Per row of docs: doc_id, n_candidates, n_secrets (long) and secrets (array of start, end, score; empty if none)."""
    found = spans(scan(docs, model, text, doc_id, path)).withColumnRenamed("doc_id", "found_id").withColumnRenamed("text_hash", "found_hash")
    docs, (text, doc_id) = numbered(docs, text, doc_id)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(text).alias("text_hash"))
    joined = rows.join(small(found), F.col("doc_id").eqNullSafe(F.col("found_id")) & (F.col("text_hash") == F.col("found_hash")), "left")
    none = F.array().cast("array<struct<start:bigint,end:bigint,score:double>>")
    return joined.select("doc_id", F.coalesce("n_candidates", F.lit(0)).cast("long").alias("n_candidates"), F.coalesce("n_secrets", F.lit(0)).cast("long").alias("n_secrets"), F.coalesce("secrets", none).alias("secrets"))


def redact(docs: DataFrame, model: PipelineModel | None = None, text: str = "text", doc_id: str = "doc_id", path: str | None = "source", mark: str = MARK) -> DataFrame:
    """docs with every confirmed secret in the text replaced by `mark`; all rows and columns stay, other texts unchanged.

    Few documents' verdicts are broadcast; of many, only documents with candidates are joined with them, the others pass by without a shuffle.
    """
    names = docs.columns
    listed = F.sort_array(F.collect_list(F.struct("place", "secret")))
    found = scan(docs, model, text, doc_id, path).groupBy("doc_id", "text_hash").agg(F.count_if("secret").alias("n"), listed.alias("listed")).filter("n > 0")
    found = materialize(found.select(F.col("doc_id").alias("known"), F.col("text_hash").alias("known_hash"), F.col("listed.secret").alias("flags")), "secrets-flags")
    docs, (text, doc_id) = numbered(docs, text, doc_id)
    columns = docs.columns
    few = found.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    rows = (docs if few else docs.filter(may_hold(F.col(text)))).withColumn("hash", F.xxhash64(text))
    rows = rows.join(F.broadcast(found) if few else found, F.col(doc_id).eqNullSafe(F.col("known")) & (F.col("hash") == F.col("known_hash")), "left")
    # the text's gaps and candidates are put together again, in one pass
    hits = F.regexp_extract_all(F.col(text), F.lit(CANDIDATE), F.lit(0))
    marked = F.zip_with(hits, "flags", lambda hit, secret: F.when(secret, F.concat(F.regexp_extract(hit, _PREFIX, 0), F.lit(mark))).otherwise(hit))
    joined = F.array_join(F.zip_with(F.split(text, CANDIDATE, -1), marked, lambda gap, hit: F.concat(gap, F.coalesce(hit, F.lit("")))), "")
    clean = rows.withColumn(text, F.when(F.col("flags").isNotNull(), joined).otherwise(F.col(text))).select(*columns)
    return (clean if few else docs.filter(~may_hold(F.col(text))).unionByName(clean)).toDF(*names)
