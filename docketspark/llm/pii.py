"""Personal data in texts: patterns propose spans, validators confirm them, nearby words move the score.

The four base kinds stand whatever their score. Further kinds (IBAN, social security and resident numbers, telephone
numbers without a country code) are reported from a score of THRESHOLD on, and only where no base span lies.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import numbered, rows_of

THRESHOLD = 0.5
#: Characters before and behind a span in which context words count.
CONTEXT = 48


def luhn(digits: str) -> bool:
    """Luhn's checksum, as on payment cards."""
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = int(d) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def mod97(iban: str) -> bool:
    """The ISO 7064 check of an IBAN without spaces: its letters as numbers, rearranged, leave 1 modulo 97."""
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1


def resident_number(digits: str) -> bool:
    """The weighted check digit of a 13-digit resident registration number."""
    weights = (2, 3, 4, 5, 6, 7, 8, 9, 2, 3, 4, 5)
    return (11 - sum(w * int(d) for w, d in zip(weights, digits, strict=False)) % 11) % 10 == int(digits[12])


def _digits(text: str) -> str:
    return re.sub("[^0-9]", "", text)


class Kind(NamedTuple):
    name: str
    pattern: re.Pattern
    valid: Callable[[str], bool]
    base: bool
    score: float
    words: re.Pattern
    #: A text without this character class or string has no such span.
    needs: str


def _words(*words: str) -> re.Pattern:
    return re.compile(r"(?<![a-z])(?:" + "|".join(words) + r")(?![a-z])", re.IGNORECASE)


#: Words near a span that speak against personal data.
_AGAINST = _words("order", "invoice", "part", "isbn", "version", "build", "serial", "item", "sku", "ticket")

KINDS = (
    Kind("email", re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"), lambda s: True, True, 0.9, _words("mail", "e-mail", "email", "contact", "write"), "@"),
    Kind("ip", re.compile(r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+"), lambda s: all(int(p) <= 255 for p in s.split(".")), True, 0.7, _words("ip", "address", "host", "server"), "."),
    Kind("card", re.compile(r"[0-9](?:[\x20-]?[0-9])+"), lambda s: 13 <= len(_digits(s)) <= 19 and luhn(_digits(s)), True, 0.7, _words("card", "visa", "mastercard", "credit", "payment", "pay"), "0"),
    Kind("phone", re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"), lambda s: 9 <= len(_digits(s)) <= 15, True, 0.7, _words("phone", "tel", "call", "mobile", "fax", "telephone"), "+"),
    Kind("iban", re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"), lambda s: 15 <= len(s.replace(" ", "")) <= 34 and mod97(s.replace(" ", "")), False, 0.8, _words("iban", "account", "bank", "konto", "compte", "cuenta"), "0"),
    Kind("ssn", re.compile(r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])"), lambda s: True, False, 0.4, _words("ssn", "social", "security", "taxpayer"), "-"),
    Kind("rrn", re.compile(r"(?<![0-9-])[0-9]{2}(?:0[1-9]|1[0-2])(?:0[1-9]|[12][0-9]|3[01])-[1-8][0-9]{6}(?![0-9-])"), lambda s: resident_number(_digits(s)), False, 0.6, _words("resident", "registration", "rrn"), "-"),
    Kind("local_phone", re.compile(r"(?<![0-9+(-])\(?[0-9]{3}\)?[\x20.-][0-9]{3,4}[.-][0-9]{4}(?![0-9-])"), lambda s: True, False, 0.3, _words("phone", "tel", "call", "mobile", "fax", "telephone", "cell"), "0"),
)

_DIGIT = re.compile("[0-9]")


def find_spans(text: str) -> list[tuple]:
    """(kind, start, end, score, base, text) of every span of a text, by kind as listed, then by start."""
    out: list[tuple] = []
    digits = _DIGIT.search(text) is not None
    for kind in KINDS:
        if kind.needs != "0" and kind.needs not in text or kind.name != "email" and not digits:
            continue
        if kind.name == "email":
            matches = _emails(kind.pattern, text)
        else:
            matches = kind.pattern.finditer(text)
        for m in matches:
            if not kind.valid(m.group()):
                continue
            start, end = m.span()
            near = text[max(0, start - CONTEXT) : start] + " " + text[end : end + CONTEXT]
            score = kind.score + 0.3 * bool(kind.words.search(near)) - 0.3 * bool(_AGAINST.search(near))
            if kind.base or score >= THRESHOLD and not any(b and s < end and start < e for _, s, e, _, b, _ in out):
                out.append((kind.name, start, end, round(min(1.0, score), 3), kind.base, m.group()))
    return out


def _emails(pattern: re.Pattern, text: str):
    """finditer, but started only where an @ is: the run of name characters before it is where a match can begin."""
    at = done = 0
    while (at := text.find("@", at)) >= 0:
        begin = at
        while begin > done and text[begin - 1] in _NAME:
            begin -= 1
        m = pattern.match(text, begin) if begin < at else None
        if m:
            yield m
            done = at = m.end()
        else:
            at += 1


_NAME = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")


def personal_data(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns `keep` and `spans`, an array of structs (kind, start, end, score, base, text).

    start and end count code points, end is exclusive. Null and empty texts have no spans. Repeated rows stay.
    """
    fields = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64()), ("base", pa.bool_()), ("text", pa.string())]))
    names = [f.name for f in fields.value_type]

    kept = list(keep)
    docs, (text, *columns) = numbered(docs, text, *kept)

    def run(batches):
        for part, texts in rows_of(batches):
            found = pa.array([[dict(zip(names, s, strict=True)) for s in find_spans(t)] for t in texts], fields)
            yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(len(columns))), found], [*columns, "spans"])

    source = docs.select(*columns, F.col(text).alias("text"))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in source.schema.fields[:-1])
    return source.mapInArrow(run, f"{schema}, spans array<struct<kind:string,start:int,end:int,score:double,base:boolean,text:string>>").toDF(*kept, "spans")


def joined(spans: Column) -> Column:
    """kind:start:end of the spans, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
