"""The operations of the search service as a function from request to reply. Nothing here opens a port."""

from __future__ import annotations

import json
import time
from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import DEFAULT, EngineConfig
from .functions.analyzer import simple
from .functions.text import query_hash
from .operators import federation, results
from .operators.index import Index
from .operators.ranking import search
from .operators.retrieval import Request
from .operators.suggest import suggest
from .operators.upserts import record_searches, upsert_clicks

VERSION = 1
#: What each operation takes and gives; a mark shows what must be there.
MANIFEST = {
    "v": VERSION,
    "ops": {
        "search": {"in": {"q": "string!", "limit": "int", "offset": "int", "type": "string"}, "out": {"res": "list", "total": "int", "offset": "int", "limit": "int", "suggestion": "string"}},
        "click": {"in": {"url": "string!", "q": "string"}, "out": {}},
    },
    "query": 'words must all occur, "words" in a row, or gives alternatives, -word excludes',
}


def ok(request: dict, **values) -> dict:
    return {"v": VERSION, "ok": True, **({"id": request["id"]} if "id" in request else {}), **values}


def error(request: dict, code: str, message: str | None = None) -> dict:
    return {"v": VERSION, "ok": False, "err": code, **({"msg": message} if message else {}), **({"id": request["id"]} if "id" in request else {})}


def _whole(value, default: int) -> int:
    try:
        return int(value if value is not None else default)
    except (TypeError, ValueError):
        return default


class Bucket:
    """Tokens of each link: one a request, refilled at ``rate`` a second up to ``burst``. Of more than ``many`` links those idle for long are forgotten."""

    def __init__(self, config: EngineConfig, clock: Callable[[], float], many: int = 512):
        self.config, self.clock, self.many = config, clock, many
        self.held: dict[str | None, tuple[float, float]] = {}

    def allow(self, link: str | None) -> bool:
        c, now = self.config, self.clock()
        tokens, last = self.held.get(link, (c.rate_burst, now))
        tokens = min(c.rate_burst, tokens + (now - last) * c.rate_per_second)
        self.held[link] = (tokens - 1 if tokens >= 1 else tokens, now)
        if len(self.held) > self.many:
            self.held = {k: v for k, v in self.held.items() if now - v[1] <= c.idle_seconds}
        return tokens >= 1


@dataclass
class Service:
    """Answers requests over snapshots. ``embed`` gives a query's vector or none; ``federate`` the hits of another service; ``log`` takes
    a table's name and the rows that it gets: appended, or for ``clicks`` put in place of the url's row. Clicks since the snapshot count in
    later searches; whoever takes a new snapshot makes a new service."""

    spark: SparkSession
    tables: dict[str, DataFrame]
    as_of: datetime
    config: EngineConfig = DEFAULT
    embed: Callable[[str], tuple[float, ...] | None] = lambda q: None
    federate: Callable[[str, int], DataFrame | None] = lambda q, n: None
    log: Callable[[str, DataFrame], None] = lambda table, rows: None
    clock: Callable[[], float] = time.monotonic
    index: Index | None = None  # of the pages
    clicked: list[tuple] = field(default_factory=list)

    def __post_init__(self) -> None:
        self.bucket = Bucket(self.config, self.clock)

    def handle(self, raw: str | bytes | dict, link: str | None = None) -> dict:
        """The reply to a request that came over a link; links that ask too often are refused."""
        try:
            request = raw if isinstance(raw, dict) else json.loads(raw)
            if not isinstance(request, dict):
                raise ValueError
        except ValueError:
            return error({}, "bad_encoding")
        if not self.bucket.allow(link):
            return error(request, "rate_limited")
        op = request.get("op")
        if op == "__manifest__":
            return ok(request, manifest=MANIFEST)
        if request.get("v") != VERSION:
            return error(request, "bad_version")
        if op not in ("search", "click"):
            return error(request, "bad_op")
        needed = "q" if op == "search" else "url"
        if not str(request.get(needed) or "").strip():
            return error(request, "missing_field", needed)
        try:
            return self._search(request) if op == "search" else self._click(request)
        except Exception as problem:  # the reply must not carry a trace
            return error(request, "backend_error", type(problem).__name__)

    def _click(self, request: dict) -> dict:
        url = str(request["url"])
        row = self.spark.createDataFrame([(self.as_of, str(request.get("q") or ""), url)], "ts timestamp, q string, url string")
        self.log("click_events", row.select("ts", query_hash(F.col("q")).alias("query_hash"), "url"))
        self.clicked.append((self.as_of, url))
        self.log("clicks", self._clicks().where(F.col("url") == url))
        return ok(request)

    def _clicks(self) -> DataFrame:
        """The counts of the snapshot with the clicks since then."""
        known = self.tables["clicks"]
        return upsert_clicks(known, self.spark.createDataFrame(self.clicked, "ts timestamp, url string")) if self.clicked else known

    def _search(self, request: dict) -> dict:
        c, t, q = self.config, self.tables, str(request["q"])
        size, offset = min(max(_whole(request.get("limit"), c.page_size), 1), c.page_size_max), max(_whole(request.get("offset"), 0), 0)
        kind = request.get("type") or None
        clicks = self._clicks()
        found = search(t["pages"], t["nodes"], t["links"], clicks, [Request(1, q, kind, size, offset, self.embed(q))], self.as_of, c, self.index.lexeme if self.index else simple, index=self.index)
        if kind in (None, "wiki") and (hits := self.federate(q, c.federated_cap)) is not None:
            found = federation.merged(found, federation.federated(hits), t["links"], clicks)
        placed = results.node_crowding(results.folded(found), c.node_cap, size)
        rows = placed.orderBy("pos").collect()  # some dozens at most
        total = len(rows)
        page = results.page_of(self.spark.createDataFrame(rows, placed.schema), offset, size, c).orderBy("pos").collect() if rows else []
        suggestion = None
        if total < 3 and offset == 0:
            other = suggest(self.spark.createDataFrame([(1, q)], "qid bigint, q string"), t["lexicon"], c).first()
            suggestion = other["suggestion"] if other and other["suggestion"].strip().lower() != q.strip().lower() else None
        shown = [{k: v for k, v in r.asDict().items() if k not in ("qid", "rank", "pos", "total")} for r in page]
        if offset == 0:
            row = self.spark.createDataFrame([(self.as_of, q, total, suggestion is not None, [r["url"] for r in shown])], "ts timestamp, q string, results int, suggested boolean, shown_urls array<string>")
            self.log("searches", record_searches(row))
        return ok(request, res=shown, total=total, offset=offset, limit=size, **({"suggestion": suggestion} if suggestion else {}))


def known_page(pages: DataFrame, url: str) -> bool:
    """Whether a url may be redirected to: only those of good pages may."""
    return bool(pages.where(F.col("ok") & (F.col("url") == url)).limit(1).count())
