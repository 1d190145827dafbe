"""Fetching daily bars over HTTP as a Spark data source: one task per symbol, retries with a linear back-off."""

from __future__ import annotations

import csv
import io
import time
import urllib.request
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "symbol string, Date string, Open double, High double, Low double, Close double, `Adj Close` double, Volume double"
COLUMNS = ("Open", "High", "Low", "Close", "Adj Close", "Volume")


class FetchError(RuntimeError):
    """A symbol that no attempt could fetch."""


def number(text: str | None) -> float | None:
    try:
        return float(text) if text not in (None, "") else None
    except ValueError:
        return None


def parse(symbol: str, body: str) -> list[tuple]:
    """Rows of a CSV body.  Without ``Date`` or rows it is an error; without ``Adj Close`` that is ``Close``."""
    rows = list(csv.DictReader(io.StringIO(body)))
    if not rows or "Date" not in rows[0]:
        raise FetchError(f"no daily bars for {symbol}")
    return [(symbol, r["Date"], *(number(r.get(c) if c != "Adj Close" else r.get(c, r.get("Close"))) for c in COLUMNS)) for r in rows]


def fetch(symbol: str, url: str, retries: int, backoff: float) -> list[tuple]:
    """Try ``retries`` times at least once, waiting ``backoff`` seconds more after each failure."""
    last: Exception | None = None
    for attempt in range(max(1, retries)):
        if attempt:
            time.sleep(backoff * attempt)
        try:
            with urllib.request.urlopen(url, timeout=30) as reply:
                return parse(symbol, reply.read().decode("utf-8", "replace"))
        except (OSError, FetchError) as error:
            last = error
    raise FetchError(f"{symbol}: {last}")


class BarsReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.symbols = [s for s in options["symbols"].split(",") if s]
        self.url, self.date = options["url"], options.get("date", "")
        self.retries, self.backoff = int(options.get("retries", "3")), float(options.get("backoff", "2"))

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(s) for s in self.symbols]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        symbol = partition.value
        yield from fetch(symbol, self.url.format(symbol=symbol, date=self.date, compact_date=self.date.replace("-", "")), self.retries, self.backoff)


class BarsSource(DataSource):
    """``spark.read.format("daily_bars")`` with options ``url`` (a template of symbol, date and compact_date),
    ``symbols``, ``date``, ``retries`` and ``backoff``."""

    @classmethod
    def name(cls) -> str:
        return "daily_bars"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> BarsReader:
        return BarsReader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(BarsSource)
