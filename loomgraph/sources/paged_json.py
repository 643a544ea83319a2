"""A paged JSON API as a Spark data source, batch and streaming.

Options: urlTemplate with {page}, method, currentPage, maxPages (an absolute page
number), headers (JSON), bodyTemplate, dataPath (dotted, required),
totalPagesPath, mode (all or current). Pages may be http(s) addresses or files.
A page that fails is a row with its error and no item; it is skipped and never
tried again. Without totalPagesPath an empty page ends the run.
"""

from __future__ import annotations

import json
import math
import urllib.request
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition, SimpleDataSourceStreamReader

from ..functions.json_paths import as_list, get

TIMEOUT = 30  # seconds for a page
SCHEMA = "page int, position int, item string, error string"


def header_map(text: str) -> dict[str, str]:
    """Headers from a JSON object or `key: value` lines."""
    text = (text or "").strip()
    if not text:
        return {}
    if text.startswith("{"):
        found = json.loads(text)
        if not isinstance(found, dict):
            raise ValueError("headers must be an object")
        return {str(k): str(v) for k, v in found.items()}
    out = {}
    for line in filter(str.strip, text.splitlines()):
        key, colon, value = line.partition(":")
        if not colon or not key.strip():
            raise ValueError(f"header line without a key: {line!r}")
        out[key.strip()] = value.strip()
    return out


@dataclass(frozen=True)
class Config:
    url: str
    data_path: str
    method: str = "GET"
    first: int = 1
    last: int = 200
    headers: tuple = ()
    body: str = ""
    total_path: str = ""
    current_only: bool = False

    @classmethod
    def of(cls, o: dict) -> Config:
        o = {k.lower(): v for k, v in o.items()}
        if not o.get("urltemplate") or not o.get("datapath"):
            raise ValueError("urlTemplate and dataPath are required")
        return cls(
            o["urltemplate"], o["datapath"], o.get("method", "GET").upper(), int(o.get("currentpage", 1)), int(o.get("maxpages", 200)),
            tuple(header_map(o.get("headers", "")).items()), o.get("bodytemplate", ""), o.get("totalpagespath", ""), o.get("mode", "all") == "current",
        )

    def fetch(self, page: int) -> str:
        fill = lambda s: s.replace("{page}", str(page))
        url = fill(self.url)
        if "://" not in url:
            url = f"file://{url}"
        body = None if self.method in ("GET", "HEAD") or not self.body else fill(self.body).encode()
        with urllib.request.urlopen(urllib.request.Request(url, body, dict(self.headers), method=self.method), timeout=TIMEOUT) as r:  # noqa: S310
            return r.read().decode()

    def page(self, page: int) -> tuple[list[Any] | None, float | None, str | None]:
        """Items, total pages if the payload has it, error."""
        try:
            payload = json.loads(self.fetch(page))
        except Exception as e:  # noqa: BLE001  a page's failure is data
            return None, None, f"{type(e).__name__}: {e}"
        total = None
        if self.total_path:
            try:
                n = float(get(payload, self.total_path))
                total = n if math.isfinite(n) and n > 0 else None
            except (TypeError, ValueError):
                pass
        return as_list(get(payload, self.data_path)), total, None

    def rows(self, page: int, items: list | None, error: str | None) -> Iterator[tuple]:
        if error is not None:
            yield page, None, None, error
        for k, x in enumerate(items or []):
            yield page, k, json.dumps(x, ensure_ascii=False, separators=(",", ":")), None

    def ends_after(self, page: int, items: list | None, total: float | None, error: str | None) -> bool:
        return self.current_only or page + 1 > self.last or (total is not None and page + 1 > total) or (not self.total_path and error is None and not items)


@dataclass
class _Pages(InputPartition):
    page: int


class _Batch(DataSourceReader):
    """With a known total one partition a page; else one task walks until the run ends."""

    def __init__(self, config: Config):
        self.config = config

    def partitions(self):
        c = self.config
        if c.current_only:
            return [_Pages(c.first)]
        if c.total_path:
            _, total, _ = c.page(c.first)
            if total is not None:
                return [_Pages(p) for p in range(c.first, min(c.last, int(total)) + 1)] or [_Pages(c.first)]
        return [_Pages(-1)]

    def read(self, partition):
        c = self.config
        if partition.page >= 0:
            items, _, error = c.page(partition.page)
            yield from c.rows(partition.page, items, error)
            return
        page, known = c.first, None
        while page <= c.last and (known is None or page <= known):
            items, total, error = c.page(page)
            known = known if known is not None else total
            yield from c.rows(page, items, error)
            if c.ends_after(page, items, known, error):
                return
            page += 1


class _Stream(SimpleDataSourceStreamReader):
    """A page a micro-batch; the offset holds the next page, the total once known, and whether the run is over."""

    def __init__(self, config: Config):
        self.config = config

    def initialOffset(self):
        return {"page": self.config.first, "total": None, "over": False}

    def read(self, start):
        if start["over"] or start["page"] > self.config.last:
            return iter([]), start
        items, total, error = self.config.page(start["page"])
        total = start["total"] if start["total"] is not None else total
        over = self.config.ends_after(start["page"], items, total, error)
        return iter(list(self.config.rows(start["page"], items, error))), {"page": start["page"] + 1, "total": total, "over": over}

    def readBetweenOffsets(self, start, end):
        for page in range(start["page"], end["page"]):
            items, _, error = self.config.page(page)
            yield from self.config.rows(page, items, error)


class PagedJson(DataSource):
    @classmethod
    def name(cls) -> str:
        return "paged_json"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema):
        return _Batch(Config.of(dict(self.options)))

    def simpleStreamReader(self, schema):
        return _Stream(Config.of(dict(self.options)))


def register(spark) -> None:
    """Makes format("paged_json") known, and sends this package to the workers that read it."""
    from ..functions.shipping import ship

    ship(spark)
    spark.dataSource.register(PagedJson)
