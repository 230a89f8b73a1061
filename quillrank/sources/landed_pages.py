"""Landed API pages as a Spark data source: `spark.read.format("landed_pages").option("path", ...).load()`.

A source's pages lie in a folder of its name, one JSON file a page in the shape in which its API gives them, and `_pages.json` beside them tells of each page how many items it has, which
statuses, and the first and last posting date. Planning reads that list alone: it leaves out sources and pages that the pushed filters rule out and deals the rest in ranges of pages. A source
that is paged by cursor is read by one task, which follows the cursors. Filters on source, page, status and posted are applied while a page is parsed; the others are left to Spark. The option
`fields` keeps only some of an item's top-level fields in the payload, as APIs do that let the caller list them.

Rows: source, page, item (its place in the page), posted, status, payload (JSON), landed_at. Any place that pyarrow's file systems reach will do. A page that isn't readable JSON fails the read;
one without items gives no rows.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from datetime import datetime

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual

#: Where a page's items are, where the fields for status and posting date are, and for a cursor source where the next page's cursor is.
SHAPES: dict[str, dict] = {
    "simpler_grants": {"items": ("data",), "status": ("opportunity_status",), "posted": ("summary", "post_date")},
    "grants_gov": {"items": ("oppHits",), "status": ("oppStatus",), "posted": ("openDate",)},
    "sam_gov": {"items": ("opportunitiesData",), "status": ("active",), "posted": ("postedDate",)},
    "sbir": {"items": (), "status": (), "posted": ("open_date",)},
    "threesixtygiving": {"items": (), "status": (), "posted": ("Award Date",)},
    "california_grants": {"items": (), "status": ("status",), "posted": ("published_date",)},
    "world_bank": {"items": ("projects",), "status": ("status",), "posted": ("boardapprovaldate",)},
    "ted_eu": {"items": ("notices",), "status": (), "posted": ("publicationDate",)},
    "usaspending": {"items": ("results",), "status": (), "posted": ("Start Date",), "cursor": ("page_metadata", "last_record_unique_id")},
    "nih_reporter": {"items": ("results",), "status": (), "posted": ("project_start_date",)},
    "nsf_awards": {"items": ("response", "award"), "status": (), "posted": ("startDate",)},
}
SCHEMA = pa.schema([("source", pa.string()), ("page", pa.int64()), ("item", pa.int64()), ("posted", pa.string()), ("status", pa.string()), ("payload", pa.string()), ("landed_at", pa.timestamp("us", "UTC"))])
DDL = "source string, page long, item long, posted string, status string, payload string, landed_at timestamp"
_TESTS: dict[type, Callable] = {
    EqualTo: lambda x, y: x == y, GreaterThan: lambda x, y: x > y, GreaterThanOrEqual: lambda x, y: x >= y, LessThan: lambda x, y: x < y, LessThanOrEqual: lambda x, y: x <= y, In: lambda x, y: x in y, IsNotNull: lambda x, _: True,
}


def at(value: object, path: tuple[str, ...]) -> object:
    for key in path:
        value = value.get(key) if isinstance(value, dict) else None
    return value


def items_of(source: str, page: object) -> list[dict]:
    """A page's items. A page may be the list itself; items by number in an object come without its entries that are no items or hold a total."""
    found = page if isinstance(page, list) else at(page, SHAPES[source]["items"] or ("data",))
    if isinstance(found, dict):
        found = [v for v in found.values() if isinstance(v, dict) and not v.get("total")]
    return [x for x in found or [] if isinstance(x, dict)]


def _text(value: object) -> str | None:
    return value if value is None or isinstance(value, str) else json.dumps(value)


class Pages(InputPartition):
    def __init__(self, source: str, names: list[tuple[int, str]], by_cursor: bool) -> None:
        self.source, self.names, self.by_cursor = source, names, by_cursor


class LandedReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path, self.fields = options["path"], [f for f in options.get("fields", "").split(",") if f]
        self.pages = int(options.get("pages", 16))
        self.tests: list[tuple[str, type, object]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        for f in filters:
            if type(f) in _TESTS and len(f.attribute) == 1 and f.attribute[0] in ("source", "page", "status", "posted"):
                self.tests.append((f.attribute[0], type(f), getattr(f, "value", None)))
            else:
                yield f

    def _passes(self, column: str, value: object) -> bool:
        return all(value is not None and _TESTS[kind](value, bound) for name, kind, bound in self.tests if name == column)

    def _may_hold(self, page: dict) -> bool:
        """Whether a listed page can have a row that passes."""
        if not page["n"] or not self._passes("page", page["page"]):
            return False
        if any(name == "status" for name, *_ in self.tests) and not any(self._passes("status", s) for s in page["statuses"]):
            return False
        first, last = page["first"], page["last"]
        for name, kind, bound in self.tests:
            if name == "posted" and (first is None or kind is EqualTo and not first <= bound <= last or kind is In and not any(first <= b <= last for b in bound) or kind in (GreaterThan, GreaterThanOrEqual) and not _TESTS[kind](last, bound) or kind in (LessThan, LessThanOrEqual) and not _TESTS[kind](first, bound)):
                return False
        return True

    def partitions(self) -> list[Pages]:
        store, top = pyarrow.fs.FileSystem.from_uri(self.path)
        out = []
        for folder in sorted(store.get_file_info(pyarrow.fs.FileSelector(top)), key=lambda f: f.base_name):
            source = folder.base_name
            if folder.type != pyarrow.fs.FileType.Directory or source not in SHAPES or not self._passes("source", source):
                continue
            with store.open_input_stream(f"{top}/{source}/_pages.json") as file:
                listed = sorted(json.loads(file.read()), key=lambda p: p["page"])
            if "cursor" in SHAPES[source]:
                out.append(Pages(source, [(p["page"], p["file"]) for p in listed[:1]], True))
                continue
            names = [(p["page"], p["file"]) for p in listed if self._may_hold(p)]
            out += [Pages(source, names[i : i + self.pages], False) for i in range(0, len(names), self.pages)]
        return out

    def read(self, partition: Pages) -> Iterator[pa.RecordBatch]:
        if partition is None:
            return
        store, top = pyarrow.fs.FileSystem.from_uri(self.path)
        shape, waiting = SHAPES[partition.source], list(partition.names)
        while waiting:
            number, name = waiting.pop(0)
            with store.open_input_stream(f"{top}/{partition.source}/{name}") as file:
                page = json.loads(file.read())
            items = items_of(partition.source, page)
            following = at(page, shape["cursor"]) if partition.by_cursor and items else None
            following = f"after-{following}.json" if following is not None else ""
            if following and store.get_file_info(f"{top}/{partition.source}/{following}").type == pyarrow.fs.FileType.File:  # else it hasn't landed yet
                waiting.append((number + 1, following))
            landed = at(page, ("landed_at",))
            landed = datetime.fromisoformat(landed) if landed else None
            rows = []
            for i, item in enumerate(items):
                posted, status = _text(at(item, shape["posted"])), _text(at(item, shape["status"]) if shape["status"] else None)
                if self._passes("page", number) and self._passes("posted", posted) and self._passes("status", status):
                    kept = {k: item[k] for k in self.fields if k in item} if self.fields else item
                    rows.append((partition.source, number, i, posted, status, json.dumps(kept, ensure_ascii=False), landed))
            if rows:
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), SCHEMA.types, strict=True)], schema=SCHEMA)


class LandedPages(DataSource):
    @classmethod
    def name(cls) -> str:
        return "landed_pages"

    def schema(self) -> str:
        return DDL

    def reader(self, schema) -> LandedReader:  # noqa: ANN001
        return LandedReader(dict(self.options))


def register(spark: SparkSession) -> None:
    """Makes the format known to a session, and lets Spark hand it filters."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(LandedPages)


def read_pages(spark: SparkSession, path: str, fields: tuple[str, ...] = (), pages: int = 16) -> DataFrame:
    register(spark)
    return spark.read.format("landed_pages").option("path", path).option("fields", ",".join(fields)).option("pages", pages).load()


def land_pages(items: DataFrame, path: str, landed_at: str | None = None) -> DataFrame:
    """Writes items (source, page, payload) as pages under `path` and lists them; returns the list (source, page, file, n, statuses, first, last).

    A page's items are in order of their text. Pages of a cursor source must be numbered without gaps. Each page is written by one task under a name that its content doesn't change, so a repeated task writes the same file.
    """

    def write(key: tuple, rows: pa.Table) -> pa.Table:
        source, page = key[0].as_py(), key[1].as_py()
        found = [json.loads(p) for p in sorted(rows.column("payload").to_pylist())]
        shape, name = SHAPES[source], f"page-{page:08d}.json"
        body: dict | list = found if source != "world_bank" else {str(i): x for i, x in enumerate(found)} | {"total": str(len(found))}
        for k in reversed(shape["items"]):
            body = {k: body}
        if "cursor" in shape:
            name = f"after-{page - 1}.json"
            body["page_metadata"] = {"last_record_unique_id": page}
        if landed_at and isinstance(body, dict):
            body["landed_at"] = landed_at
        store, top = pyarrow.fs.FileSystem.from_uri(path)
        store.create_dir(f"{top}/{source}", recursive=True)
        with store.open_output_stream(f"{top}/{source}/{name}") as out:
            out.write(json.dumps(body).encode())
        posted = sorted(x for x in (_text(at(i, shape["posted"])) for i in found) if x is not None)
        statuses = sorted({x for x in (_text(at(i, shape["status"])) for i in found) if x is not None}) if shape["status"] else []
        values = ([source], [page], [name], [len(found)], [statuses], [posted[0] if posted else None], [posted[-1] if posted else None])
        kinds = (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.list_(pa.string()), pa.string(), pa.string())
        return pa.table([pa.array(v, t) for v, t in zip(values, kinds, strict=True)], names=["source", "page", "file", "n", "statuses", "first", "last"])

    return items.select("source", "page", "payload").groupBy("source", "page").applyInArrow(write, "source string, page long, file string, n long, statuses array<string>, first string, last string")


def list_pages(spark: SparkSession, listed: DataFrame, path: str) -> None:
    """Writes `_pages.json` of each source from what land_pages returned: a line of text for each page passes through one task per source."""

    def write(key: tuple, rows: pa.Table) -> pa.Table:
        store, top = pyarrow.fs.FileSystem.from_uri(path)
        with store.open_output_stream(f"{top}/{key[0].as_py()}/_pages.json") as out:
            out.write(json.dumps(rows.drop_columns(["source"]).to_pylist()).encode())
        return rows.select(["source"]).slice(0, 1)

    listed.groupBy("source").applyInArrow(write, "source string").write.format("noop").mode("overwrite").save()
