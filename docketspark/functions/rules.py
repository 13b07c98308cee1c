"""Rules over answers of models and over cases' fields: what is accepted, defaults, labels and chips."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from docketspark.functions import exprs as e
from docketspark.functions import text as x
from docketspark.schema import GATE, GUESS_EXAMPLES, GUESS_SHAPE, MIN_FREQUENCY, NO_PERIOD, PLANNING_LABELS, PROJECT_TYPES, PURPOSES, TURNKEY


def filled(text: Column) -> Column:
    """The trimmed text; null if nothing is left."""
    return F.nullif(e.spaces_trimmed(text), F.lit(""))


def accepts_inapplicable(na_allowed: Column, applicable: Column, evidence: Column, source: Column) -> Column:
    """Whether a section may count as inapplicable: it can be, the answer says so, and its evidence of 6 characters or more stands in the source."""
    return inapplicable(na_allowed, applicable, x.grounded(F.coalesce(evidence, F.lit("")), source))


def inapplicable(na_allowed: Column, applicable: Column, grounded: Column) -> Column:
    """accepts_inapplicable() where it is known whether the evidence stands in the source."""
    return F.coalesce(na_allowed & ~F.coalesce(applicable, F.lit(True)) & grounded, F.lit(False))


def with_grounds(answers: Column, source: Column) -> Column:
    """A list of answers (section, confidence, applicable, evidence, guess) with `grounded` in place of the evidence; the source is prepared once for all."""
    names = ("section", "confidence", "applicable", "guess")
    claimed = lambda a, said: F.when(~a["applicable"], x.stands_in(F.coalesce(a["evidence"], F.lit("")), said)).otherwise(False)
    return e.once(e.squash(source), lambda said: F.transform(answers, lambda a: F.struct(*[a[n].alias(n) for n in names], claimed(a, said).alias("grounded"))))


def accepted_guesses(guess_allowed: Column, applicable: Column, confidence: Column, guesses: Column, top: int = 3) -> Column:
    """The first guesses of a section that may be guessed, applies and is below the gate, without blank ones and those that say nothing."""
    samples = [e.squash(F.lit(g)) for g in GUESS_EXAMPLES]
    shapes = [e.squash(F.lit(g)) for g in GUESS_SHAPE]

    def says_something(guess: Column) -> Column:
        s = e.squash(guess)
        empty = [s == g for g in shapes] + [F.contains(s, g) | F.contains(g, s) for g in samples]
        return F.coalesce(guess != "", F.lit(False)) & ~reduce(lambda a, b: a | b, empty)

    kept = F.slice(F.filter(F.transform(guesses, lambda g: e.spaces_trimmed(g)), says_something), 1, top)
    return F.when(guess_allowed & applicable & (confidence < GATE) & guesses.isNotNull(), kept).otherwise(F.array().cast("array<string>"))


#: Names of features with this word only repeat what the source says.
FEATURE = "기능"


def quantity(x: Column) -> Column:
    """A whole number of pieces: rounded half up, missing or negative ones are 0."""
    return F.greatest(F.floor(F.coalesce(x.cast("double"), F.lit(0.0)) + 0.5), F.lit(0)).cast("long")


def project_type(kind: Column) -> Column:
    return F.when(kind.isin(*PROJECT_TYPES), kind).otherwise(PROJECT_TYPES[0])


def period(text: Column) -> Column:
    return F.coalesce(filled(text), F.lit(NO_PERIOD))


def question_purpose(purpose: Column) -> Column:
    return F.when(purpose.isin(*PURPOSES), purpose).otherwise(PURPOSES[0])


def shown_frequency(freq: Column, least: int = MIN_FREQUENCY) -> Column:
    """A tip's frequency, null below what is worth a badge."""
    return F.when(freq >= least, freq)


def _explained(pairs: Column) -> Column:
    """The (term, plain) of a list, trimmed, where neither is blank; an empty list for none."""
    trimmed = F.transform(pairs, lambda p: F.struct(e.spaces_trimmed(F.coalesce(p["term"], F.lit(""))).alias("term"), e.spaces_trimmed(F.coalesce(p["plain"], F.lit(""))).alias("plain")))
    return F.filter(F.coalesce(trimmed, F.array().cast("array<struct<term:string,plain:string>>")), lambda p: (p["term"] != "") & (p["plain"] != ""))


def brief_terms(pairs: Column, source: Column) -> Column:
    """Explanations of words that the source has, but for names of features; compared without white space and marks."""
    keep = lambda said: F.filter(_explained(pairs), lambda p: F.contains(said, e.squash(p["term"])) & ~F.contains(p["term"], F.lit(FEATURE)))
    return e.once(e.squash(F.coalesce(source, F.lit(""))), keep)


def brief_concepts(pairs: Column, source: Column) -> Column:
    """Explanations of what the source does not mention."""
    keep = lambda said: F.filter(_explained(pairs), lambda p: ~F.contains(said, e.squash(p["term"])))
    return e.once(e.squash(F.coalesce(source, F.lit(""))), keep)


def tips(items: Column, least: int = MIN_FREQUENCY) -> Column:
    """The (text, freq) of a list whose text is not blank, trimmed, rare ones without their frequency; an empty list for none."""
    some = F.filter(F.coalesce(items, F.array().cast("array<struct<text:string,freq:int>>")), lambda x: F.coalesce(e.spaces_trimmed(x["text"]) != "", F.lit(False)))
    return F.transform(some, lambda x: F.struct(e.spaces_trimmed(x["text"]).alias("text"), shown_frequency(x["freq"], least).alias("freq")))


def keywords(items: Column) -> Column:
    """The (term, count) of a list whose term is not blank, trimmed; a missing count is 1; an empty list for none."""
    some = F.filter(F.coalesce(items, F.array().cast("array<struct<term:string,count:int>>")), lambda x: F.coalesce(e.spaces_trimmed(x["term"]) != "", F.lit(False)))
    return F.transform(some, lambda x: F.struct(e.spaces_trimmed(x["term"]).alias("term"), F.coalesce(x["count"], F.lit(1)).alias("count")))


def whitelisted(tags: Column, allowed: Sequence[str]) -> Column:
    """The distinct tags of a list that a vocabulary has, in the list's order; null for no list."""
    return F.array_distinct(F.filter(tags, lambda t: t.isin(*allowed)))


def has_tag(tags: Column, tag: str) -> Column:
    """Whether a list holds a tag; a missing list holds none."""
    return F.coalesce(F.array_contains(tags, tag), F.lit(False))


def has_any_tag(tags: Column, wanted: Sequence[str]) -> Column:
    return F.coalesce(F.arrays_overlap(tags, F.array(*[F.lit(w) for w in wanted])), F.lit(False))


def scope_list(text: Column) -> Column:
    """The parts of a comma-separated text that are not empty; an empty list for none."""
    return F.coalesce(F.filter(F.split(text, ","), lambda p: p != ""), F.array().cast("array<string>"))


def utc_iso(at: Column) -> Column:
    """A UTC time stamp as 2001-02-03T04:05:06Z; the session's zone is UTC."""
    return F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def full_name(last: Column, first: Column, account: Column) -> Column:
    """Family name and given name without a gap; the account's name if both are missing or blank."""
    return F.coalesce(filled(F.concat(F.coalesce(last, F.lit("")), F.coalesce(first, F.lit("")))), account)


def chips(scope: Column, turnkey: Column, planning: Column, proposals: Column) -> Column:
    """The line below a case's title: its scope, turnkey, planning and proposals, each if known."""
    label = reduce(lambda out, kv: F.when(planning == kv[0], kv[1]).otherwise(out), PLANNING_LABELS.items(), planning)
    more = F.array(F.when(turnkey, TURNKEY), F.when(planning != "", label), F.when(proposals.isNotNull(), F.concat(F.lit("지원 "), proposals.cast("string"), F.lit("건"))))
    return F.concat(scope_list(scope), F.array_compact(more))


def duration_chips(inspection: Column, recruiting: Column, progress: Column, total: Column, cancelled: Column) -> Column:
    """label and days of the spans of more than 0 days."""
    spans = (("검수", inspection), ("모집·계약", recruiting), ("진행", progress), (F.when(cancelled, "취소까지").otherwise("총 기간"), total))
    rows = F.array(*[F.struct((F.lit(n) if isinstance(n, str) else n).alias("label"), d.alias("days")) for n, d in spans])
    return F.filter(rows, lambda r: F.coalesce(r["days"] > 0, F.lit(False)))
