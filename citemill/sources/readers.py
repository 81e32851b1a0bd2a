"""Requests to bibliographic indexes and their payloads: as captured files, through an injected getter, or as a data source.

Nothing here opens a connection itself: a getter is a function `get(url, params) -> (status, headers, body)`.
"""

from __future__ import annotations

import importlib
import json
import time
from collections.abc import Callable, Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from citemill.functions import text as fx
from citemill.operators.boundary import category_of
from citemill.runtime import materialize

Getter = Callable[[str, dict], tuple[int, dict, str]]
S2 = "https://api.semanticscholar.org/graph/v1"
OPENALEX = "https://api.openalex.org"
#: Fields that are asked of an index that lets one choose.
S2_FIELDS = "title,year,abstract,venue,url,citationCount,authors,externalIds,openAccessPdf,fieldsOfStudy,references"
#: source, what is asked, address, parameter of the query, parameter of the limit, most a page holds, further parameters.
ENDPOINTS = (
    ("semantic_scholar", "search", f"{S2}/paper/search", "query", "limit", 100, {"fields": S2_FIELDS}),
    ("semantic_scholar", "references", f"{S2}/paper/{{}}/references", "", "limit", 100, {"fields": S2_FIELDS}),
    ("semantic_scholar", "citations", f"{S2}/paper/{{}}/citations", "", "limit", 100, {"fields": S2_FIELDS}),
    ("openalex", "search", f"{OPENALEX}/works", "search", "per-page", 50, {}),
    ("openalex", "references", f"{OPENALEX}/works", "filter", "per-page", 50, {"filter": "cited_by:{}"}),
    ("openalex", "citations", f"{OPENALEX}/works", "filter", "per-page", 50, {"filter": "cites:{}"}),
    ("arxiv", "search", "https://export.arxiv.org/api/query", "search_query", "max_results", 50, {"search_query": "all:{}"}),
    ("dblp", "search", "https://dblp.org/search/publ/api", "q", "h", 50, {"format": "json"}),
    ("crossref", "search", "https://api.crossref.org/works", "query.bibliographic", "rows", 50, {}),
    ("serpapi", "search", "https://serpapi.com/search.json", "q", "num", 20, {"engine": "google_scholar"}),
)
#: Seconds that a server may ask to wait for; records wanted of a query; queries of a title.
LONGEST_WAIT, PER_QUERY, QUERIES = 60.0, 20, 4
_FETCHED = "key string, body string, reason string, attempts int"


def request(source: str, kind: str, value: str, limit: int = PER_QUERY, key: str = "") -> tuple[str, dict[str, str]] | None:
    """(url, parameters) of a search, or of the references or citations of a work; None where a source has no such thing."""
    for name, what, url, asked, many, most, more in ENDPOINTS:
        if (name, what) == (source, kind):
            given = {asked: value} if asked else {}
            given |= {k: v.format(value) for k, v in more.items()}
            given[many] = str(min(limit, most))
            if source == "serpapi":
                given["api_key"] = key
            return url.format(quote(value, safe=":/")), given
    return None


def requests(spark: SparkSession, sources: list[str], queries: list[str], kind: str = "search", limit: int = PER_QUERY, key: str = "") -> DataFrame:
    """source, source_ord, query_ord, direction, key, url, params of every source with every query."""
    rows = []
    for i, source in enumerate(sources):
        for j, query in enumerate(queries):
            made = request(source, kind, query, limit, key)
            if made:
                rows.append((source, i, j, kind, made[0], made[1]))
    df = spark.createDataFrame(rows, "source string, source_ord int, query_ord int, direction string, url string, params map<string,string>")
    secret = F.map_filter("params", lambda k, _: k != "api_key")  # a credential is no part of what is asked
    return df.withColumn("key", fx.request_key(F.lit("http"), F.col("url"), secret))


def expanded(title: str, call: Callable[[str], str] | None = None, count: int = QUERIES) -> list[str]:
    """Queries for a title from an injected model that answers {"queries": [...]}: distinct, at most `count`; the title
    itself without a model, or when it fails."""
    found: list[str] = []
    if call is not None:
        try:
            found = [q.strip() for q in json.loads(call(title)).get("queries", []) if isinstance(q, str) and q.strip()]
        except Exception:  # noqa: BLE001
            found = []
    return list(dict.fromkeys(found))[:count] or [title]


def got(get: Getter, url: str, params: dict, retries: int, sleep: Callable[[float], None]) -> tuple[str | None, str | None, int]:
    """(body, reason, attempts) of one request.

    Throttling and server errors are tried again, after the time that the server names or a doubling one of at
    most 30 seconds; a server that names more than `LONGEST_WAIT` is given up at once, as are other errors.
    """
    reason = "no attempt"
    for attempt in range(retries):
        asked = None
        try:
            status, headers, body = get(url, params)
        except Exception as e:  # noqa: BLE001
            reason = f"{category_of(e)}: {e}"
        else:
            if status < 400:
                return body, None, attempt + 1
            reason = f"status {status}"
            named = {k.lower(): v for k, v in headers.items()}.get("retry-after", "")
            asked = float(named) if named.replace(".", "", 1).isdigit() else None
            if status != 429 and status < 500:
                return None, reason, attempt + 1
            if status == 429 and asked is not None and asked > LONGEST_WAIT:
                return None, f"rate limited for {int(asked)} s", attempt + 1
        if attempt + 1 < retries:
            sleep(max(min(2.0**attempt, 30.0), min(asked or 0.0, LONGEST_WAIT)))
    return None, reason, retries


def fetched(asked: DataFrame, get: Getter, cache: DataFrame | None = None, retries: int = 4, gaps: dict[str, float] | None = None) -> DataFrame:
    """Payloads (source, source_ord, query_ord, direction, key, body, reason, attempts, cached) of `requests`.

    Bodies that `cache` (key, body) holds are taken from it, the others fetched once a key. All requests of a source go
    through one task, which keeps the source's least gap between them (`gaps`, seconds). The result is written, so that
    nothing is fetched again when it is read again.
    """
    held = cache.select("key", F.col("body")) if cache is not None else asked.limit(0).select("key", F.lit("").alias("body"))
    known = asked.join(held, "key").withColumns({"reason": F.lit(None).cast("string"), "attempts": F.lit(0), "cached": F.lit(True)})
    todo = materialize(asked.join(held.select("key"), "key", "left_anti"), "requests")
    spaced = gaps or {}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: dict[str, float] = {}
        for batch in batches:
            out = []
            for key, source, url, params in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                wait = last.get(source, 0.0) + spaced.get(source, 0.0) - time.monotonic()
                time.sleep(max(0.0, wait)) if source in last else None
                out.append((key, *got(get, url, dict(params), retries, time.sleep)))
                last[source] = time.monotonic()
            columns = list(zip(*out, strict=True)) if out else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.string(), pa.string(), pa.int32()), strict=True)], names=["key", "body", "reason", "attempts"])

    once = todo.select("key", "source", "url", "params").groupBy("key").agg(*[F.first(c).alias(c) for c in ("source", "url", "params")])
    answers = materialize(once.repartition("source").mapInArrow(run, _FETCHED), "payloads")
    columns = ["source", "source_ord", "query_ord", "direction", "key", "body", "reason", "attempts", "cached"]
    return todo.join(answers, "key").withColumn("cached", F.lit(False)).select(*columns).unionByName(known.select(*columns))


def captured(spark: SparkSession, path: str) -> DataFrame:
    """(source, query_ord, body) of captured files `<path>/<source>/<query_ord>.json` or `.xml`, one payload a file."""
    files = spark.read.option("recursiveFileLookup", "true").text(path, wholetext=True)
    name = F.input_file_name()
    found = files.select(F.regexp_extract(name, r"/([a-z_0-9]+)/[0-9]+\.[a-z]+$", 1).alias("source"), F.regexp_extract(name, r"/([0-9]+)\.[a-z]+$", 1).cast("int").alias("query_ord"), F.col("value").alias("body"))
    return found.where("source <> ''")


class IndexSource(DataSource):
    """`spark.read.format("citemill_index")`: payloads of one index, a partition a query.

    Options: source, queries (a JSON list), kind (search, references or citations), limit, key, and getter, the
    `module:function` that fetches.
    """

    @classmethod
    def name(cls) -> str:
        return "citemill_index"

    def schema(self) -> str:
        return "source string, query_ord int, direction string, body string, reason string"

    def reader(self, schema) -> DataSourceReader:
        return _IndexReader(dict(self.options))


class _IndexReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.options = options

    def partitions(self) -> list[InputPartition]:
        return [InputPartition((i, q)) for i, q in enumerate(json.loads(self.options["queries"]))]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        number, query = partition.value
        o = self.options
        module, _, function = o["getter"].partition(":")
        get = getattr(importlib.import_module(module), function)
        made = request(o["source"], o.get("kind", "search"), query, int(o.get("limit", PER_QUERY)), o.get("key", ""))
        body, reason, _ = (None, "the source has no such request", 0) if made is None else got(get, *made, int(o.get("retries", 4)), time.sleep)
        yield o["source"], number, o.get("kind", "search"), body, reason
