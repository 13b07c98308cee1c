"""Readers of outside systems: JSON batches, a relational source, paged web interfaces, office files."""

from __future__ import annotations

import io
import json
import re
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

MAX_ROWS, MAX_FILES, MAX_BYTES = 500, 10, 4 << 20
TEXT_KINDS = {"docx": "word/document.xml", "pptx": "ppt/slides/slide", "xlsx": "xl/worksheets/sheet"}
REFUSED = ("hwp", "doc", "ppt", "xls")


def batch_rows(body: str, key: str | None, expected: str) -> tuple[int, list[dict]]:
    """(HTTP status, rows) of a posted batch {"rows": [...]}: 401 for a wrong key, 400 for bad or too many rows, 200."""
    if key != expected:
        return 401, []
    try:
        rows = json.loads(body)["rows"]
    except (ValueError, KeyError, TypeError):
        return 400, []
    return (200, rows) if isinstance(rows, list) and len(rows) <= MAX_ROWS else (400, [])


def read_changed(spark: SparkSession, url: str, table: str, ts: str, key: str, cursor: tuple[str, int] | None, partitions: int = 8, **options) -> DataFrame:
    """Rows of a relational table behind a (time, id) cursor; the predicate is pushed to the source, partitions split by id."""
    where = f"({ts} > '{cursor[0]}' OR ({ts} = '{cursor[0]}' AND {key} > {int(cursor[1])}))" if cursor else "1 = 1"
    predicates = [f"{where} AND MOD({key}, {partitions}) = {i}" for i in range(partitions)]
    return spark.read.jdbc(url, table, predicates=predicates, properties=options)


class CursorSource(DataSource):
    """A stream of a changing table: format("cursor"), whose offset is the (time, id) cursor of the last row; given rows and newest by cursor_source().

    A batch holds the rows behind the cursor up to the newest one that has settled, so every row comes once, in whatever batch, also
    those of equal times, and again only with a new time. The predicate goes to the source with each partition's share of the ids.
    """

    rows: Callable[[tuple[str, int], tuple[str, int], int, int], Iterator[tuple]] | None = None
    newest: Callable[[], tuple[str, int] | None] | None = None
    columns = ""

    @classmethod
    def name(cls) -> str:
        return "cursor"

    def schema(self) -> str:
        return type(self).columns

    def streamReader(self, schema):
        kind = type(self)
        return CursorReader(kind.rows, kind.newest, int(self.options.get("partitions", "4")), self.options.get("cursor", "|0"))


class CursorReader(DataSourceStreamReader):
    def __init__(self, rows, newest, parts: int, cursor: str):
        self.rows, self.newest, self.parts, self.cursor = rows, newest, parts, cursor

    def initialOffset(self) -> dict:
        ts, _, key = self.cursor.rpartition("|")
        return {"ts": ts, "id": int(key)}

    def latestOffset(self) -> dict:
        last = self.newest()
        return {"ts": last[0], "id": int(last[1])} if last else self.initialOffset()

    def partitions(self, start: dict, end: dict):
        ends = [(o["ts"], o["id"]) for o in (start, end)]
        return [InputPartition((*ends, i, self.parts)) for i in range(self.parts)] if ends[0] < ends[1] else []

    def read(self, partition):
        yield from self.rows(*partition.value)


def cursor_source(columns: str, rows: Callable[[tuple[str, int], tuple[str, int], int, int], Iterator[tuple]], newest: Callable[[], tuple[str, int] | None]) -> type[CursorSource]:
    """A source to register: rows(after, upto, part, parts) gives those with after < (time, id) <= upto whose id modulo parts is part, newest() the greatest
    settled (time, id) or None. Both run anew for each batch and must be picklable; keyset_sql() is their predicate.
    """
    return type("Cursor", (CursorSource,), {"rows": staticmethod(rows), "newest": staticmethod(newest), "columns": columns})


def keyset_sql(ts: str, key: str, mark: str = "?") -> str:
    """The predicate of a batch with its eight parameters: after's time, time, id; upto's time, time, id; parts, part."""
    return f"({ts} > {mark} OR ({ts} = {mark} AND {key} > {mark})) AND ({ts} < {mark} OR ({ts} = {mark} AND {key} <= {mark})) AND {key} % {mark} = {mark}"


class PagedSource(DataSource):
    """Rows of a web interface that lists pages: format("paged"), with option pages and a fetch(page) -> list of (id, text) given to paged_source()."""

    fetch: Callable[[int], list[tuple[int, str]]] | None = None

    @classmethod
    def name(cls) -> str:
        return "paged"

    def schema(self) -> str:
        return "id long, text string"

    def reader(self, schema):
        return PagedReader(int(self.options["pages"]), type(self).fetch)


class PagedReader(DataSourceReader):
    def __init__(self, pages: int, fetch):
        self.pages, self.fetch = pages, fetch

    def partitions(self):
        return [InputPartition(i) for i in range(1, self.pages + 1)]

    def read(self, partition):
        yield from self.fetch(partition.value)


def paged_source(fetch: Callable[[int], list[tuple[int, str]]]) -> type[PagedSource]:
    """A source class to register with spark.dataSource.register; each page is a partition."""
    return type("PagedSource", (PagedSource,), {"fetch": staticmethod(fetch)})


def _cells(xml: bytes, shared: list[str]) -> str:
    lines = []
    for row in ElementTree.fromstring(xml).iter():
        if row.tag.endswith("}row"):
            cells = []
            for cell in row:
                value = next((v.text or "" for v in cell.iter() if v.tag.endswith(("}v", "}t"))), "")
                cells.append(shared[int(value)] if cell.get("t") == "s" and value.isdigit() else value)
            lines.append("\t".join(cells))
    return "\n".join(lines)


def _paragraphs(xml: bytes) -> str:
    return "\n".join("".join(t.text or "" for t in p.iter() if t.tag.endswith("}t")) for p in ElementTree.fromstring(xml).iter() if p.tag.endswith("}p"))


def file_text(name: str, data: bytes, pdf: Callable[[bytes], str] | None = None) -> tuple[str, str | None]:
    """(text, error) of an office or PDF file; spreadsheets come sheet by sheet, cells joined by tabs. PDF needs a parser."""
    kind = name.rsplit(".", 1)[-1].lower()
    if len(data) > MAX_BYTES:
        return "", "file too large"
    if kind in REFUSED:
        return "", f"{kind} is not supported"
    try:
        if kind in ("txt", "md", "csv"):
            return data.decode("utf-8", "replace"), None
        if kind == "pdf":
            return (pdf(data), None) if pdf else ("", "no PDF parser")
        if kind not in TEXT_KINDS:
            return "", "unknown kind of file"
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            parts = sorted((n for n in z.namelist() if n.startswith(TEXT_KINDS[kind]) and n.endswith(".xml")), key=lambda n: [int(x) for x in re.findall(r"\d+", n)])
            shared = []
            if "xl/sharedStrings.xml" in z.namelist():
                shared = ["".join(t.text or "" for t in si.iter() if t.tag.endswith("}t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml"))]
            return "\n".join(_cells(z.read(n), shared) if kind == "xlsx" else _paragraphs(z.read(n)) for n in parts), None
    except Exception as ex:  # noqa: BLE001 - a broken file is a row with its error
        return "", str(ex)[:200]


def read_files(spark: SparkSession, folder: str, pdf: Callable[[bytes], str] | None = None) -> DataFrame:
    """filename, text, error of the files in a folder."""

    def run(batches):
        for pdf_ in batches:
            out = [(p.rsplit("/", 1)[-1], *file_text(p, bytes(c), pdf)) for p, c in zip(pdf_["path"], pdf_["content"], strict=True)]
            yield pd.DataFrame(out, columns=["filename", "text", "error"])

    return spark.read.format("binaryFile").load(folder).select(F.col("path"), F.col("content")).mapInPandas(run, "filename string, text string, error string")
