"""Column helpers with the semantics that case queries share."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from docketspark.schema import CANCELLED, LOW_SUPPLY_MAX, MAX_TOKENS, QUOTE_MARKS, WHITE_SPACE

c = F.col


def live() -> Column:
    return c("deleted_at").isNull() & ~c("hidden")


def won() -> Column:
    return (c("stage") >= 3) & (c("status") != CANCELLED)


def cancelled() -> Column:
    return c("status") == CANCELLED


def decided() -> Column:
    return won() | cancelled()


def pending() -> Column:
    return (c("stage") < 3) & (c("status") != CANCELLED)


def low_supply() -> Column:
    return c("proposal_count").between(1, LOW_SUPPLY_MAX)


def half_up(x: Column) -> Column:
    """Rounds halves towards plus infinity, as the screens do (-2.5 becomes -2)."""
    return F.floor(x + 0.5)


def percent(part: Column, whole: Column, digits: int = 1) -> Column:
    """100 * part / whole as a rounded double; null for an empty whole."""
    return F.round(100.0 * part.cast("double") / F.nullif(whole, F.lit(0)).cast("double"), digits)


def rate(digits: int = 1) -> Column:
    return percent(F.count_if(won()), F.count_if(decided()), digits)


def band(value: Column, bands: tuple) -> Column:
    """The label of the first band whose upper bound exceeds the value; the last band is open. Null falls in the last: guard before."""
    out = reduce(lambda w, b: w.when(value < b[0], b[1]), bands[1:-1], F.when(value < bands[0][0], bands[0][1]))
    return out.otherwise(bands[-1][1])


def whole_days(a: Column, b: Column) -> Column:
    """Whole days from a to b, towards zero; may be negative."""
    return F.extract(F.lit("DAY"), b - a).cast("long")


def days_between(a: Column, b: Column) -> Column:
    """Whole days from a to b; null if either is missing or b is earlier."""
    d = F.floor((F.unix_timestamp(b.cast("timestamp")) - F.unix_timestamp(a.cast("timestamp"))) / 86400)
    return F.when(d >= 0, d)


def days_since(a: Column, as_of: Column) -> Column:
    """Whole days up to as_of, at least 0; 0 if missing."""
    return F.coalesce(F.greatest(F.lit(0), F.floor((F.unix_timestamp(as_of.cast("timestamp")) - F.unix_timestamp(a.cast("timestamp"))) / 86400)), F.lit(0))


def format_won(v: Column) -> Column:
    """Won as ten thousands with separators, e.g. 4,500만원."""
    return F.concat(F.format_number(half_up(v / 10000), 0), F.lit("만원"))


def format_money(v: Column, monthly: Column) -> Column:
    return F.when(monthly, F.concat(F.lit("월 "), format_won(v))).otherwise(format_won(v))


def kst(ts: Column) -> Column:
    return F.from_utc_timestamp(ts.cast("timestamp"), "Asia/Seoul")


def format_kst(ts: Column, pattern: str = "yyyy.MM.dd") -> Column:
    return F.date_format(kst(ts), pattern)


def like_escape(token: str) -> str:
    return token.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")


def tokens_of(q: str | None) -> list[str]:
    return (q or "").split()[:MAX_TOKENS]


def matches(fields: list[Column], token: str) -> Column:
    """Whether any field holds the token, whatever the letter case."""
    return reduce(lambda a, b: a | b, [F.coalesce(f.ilike(f"%{like_escape(token)}%"), F.lit(False)) for f in fields])


def relevance(weighted: list[tuple[Column, int]], tokens: list[str]) -> Column:
    """Sum over tokens of the weights of the fields that hold them."""
    parts = [F.when(matches([f] if isinstance(f, Column) else f, t), w).otherwise(0) for t in tokens for f, w in weighted]
    return reduce(lambda a, b: a + b, parts, F.lit(0))


# fixed values: personal numbers before phones; an ASCII word end, as Java's \b takes Hangul for word characters
END = "(?![A-Za-z0-9_])"
RRN = r"[0-9]{6}[-\s]?[1-4][0-9]{6}" + END
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
PHONE = r"(?:\+82[-\s.]?0?|0)[0-9]{1,2}[-\s.)]?[0-9]{3,4}[-\s.]?[0-9]{4}" + END
REDACTIONS = ((RRN, "[주민번호 제거]"), (EMAIL, "[이메일 제거]"), (PHONE, "[전화번호 제거]"))


def scrub_pii(text: Column) -> Column:
    """text without NUL, resident numbers, e-mail addresses and phone numbers."""
    out = F.replace(text, F.lit("\0"), F.lit(""))
    for pattern, mark in REDACTIONS:
        out = F.regexp_replace(out, pattern, mark)
    return out


def phone_digits(text: Column) -> Column:
    d = F.regexp_replace(text, "[^0-9]", "")
    return F.when(d.startswith("8210"), F.concat(F.lit("0"), F.substring(d, F.lit(3), F.length(d)))).when(d.startswith("82"), F.concat(F.lit("0"), F.substring(d, F.lit(3), F.length(d)))).otherwise(d)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity of two arrays in double precision; null for a zero vector."""
    add = lambda s, x: s + x
    zero = F.lit(0.0)
    da, db = a.cast("array<double>"), b.cast("array<double>")
    dot = F.aggregate(F.zip_with(da, db, lambda x, y: x * y), zero, add)
    norm = lambda v: F.sqrt(F.aggregate(F.transform(v, lambda x: x * x), zero, add))
    return F.try_divide(dot, norm(da) * norm(db))


def content_hash(*fields: Column) -> Column:
    return F.sha2(F.concat_ws("\n", *[F.coalesce(f, F.lit("")) for f in fields]), 256)


def unwrap_json(text: Column) -> Column:
    """JSON text with one level of double encoding removed; null for blank or invalid text."""
    inner = F.when(text.startswith('"') & text.endswith('"'), F.get_json_object(F.concat(F.lit('{"v":'), text, F.lit("}")), "$.v")).otherwise(text)
    return F.when(F.try_parse_json(inner).isNotNull() & (F.trim(inner) != ""), inner)


def once(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), where value is computed once a row, however often then() and the lambdas in it use it."""
    return F.element_at(F.transform(F.array(value), lambda v: then(v)), 1)


def squash(text: Column) -> Column:
    """Lower case without white space and the punctuation of QUOTE_MARKS, for comparing quotes."""
    return F.lower(F.regexp_replace(text, f"[{WHITE_SPACE}{QUOTE_MARKS}]", ""))


#: Unicode's space separators, which trim() of the oracle removes (Spark's own removes U+0020 only).
SPACES = " \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"
#: The characters of WHITE_SPACE.
BLANKS = "\t\n\x0b\f\r\u2028\u2029\ufeff" + SPACES


def trimmed(text: Column) -> Column:
    """text without white space of any kind at its ends."""
    return F.trim(text, F.lit(BLANKS))


def spaces_trimmed(text: Column) -> Column:
    """text without space separators at its ends; line ends and tabs stay."""
    return F.trim(text, F.lit(SPACES))


def null_if_blank_number(text: Column) -> Column:
    """Number of a text; null if missing, blank or no number."""
    return F.nullif(F.trim(text), F.lit("")).try_cast("double")


def truthy(x: Column) -> Column:
    return F.coalesce(x.cast("int") == 1, F.lit(False))


def non_empty(x: Column) -> Column:
    return F.coalesce(x != "", F.lit(False))
