"""Live quotes as a streaming source: blocks of symbols asked in parallel, with retries and smaller questions where a block fails.

``spark.readStream.format("live_quotes")`` asks once a round; a round is a step of the clock of ``interval`` seconds, so the
checkpoint's offset goes on after a restart and no round is asked twice.  Each partition has one block of symbols and asks, in this order:
the whole block up to ``retries`` times; if that gave nothing, chunks of ``chunk`` symbols, each as often; then every symbol of
``must_have`` that is still missing alone, once.  What answers at any step is kept; what never answers is left out.

``fetch`` is an importable function ``package.module:name`` of a list of symbols; it returns rows as dicts with ``symbol, price``
and, where known, ``previousClose`` and ``timestamp`` (seconds), or raises.  The library itself opens no network.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from datetime import datetime, timezone

from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition


def positive(x: object) -> float | None:
    return float(x) if isinstance(x, (int, float)) and not isinstance(x, bool) and x > 0 else None


def asked(symbols: list[str], must_have: list[str], fetch: Callable[[list[str]], list[dict]], retries: int = 2, chunk: int = 5, pause: float = 1.0) -> dict[str, dict]:
    """The rows that some question gave, by symbol: one with a positive price, else a positive previous close."""
    found: dict[str, dict] = {}

    def ask(some: list[str]) -> None:
        rows = fetch(some)
        by_symbol = {r.get("symbol"): r for r in (rows if isinstance(rows, list) else []) if isinstance(r, dict)}
        for s in some:
            row = by_symbol.get(s, {})
            price = positive(row.get("price")) or positive(row.get("previousClose"))
            if price:
                found[s] = row | {"price": price}

    def often(some: list[str], until: Callable[[], bool]) -> None:
        for k in range(max(1, retries)):
            try:
                ask(some)
                if until():
                    return
            except Exception:  # whatever the vendor raises: the next question is smaller
                time.sleep(min(pause * (k + 1), 2 * pause))

    often(symbols, lambda: bool(found))
    if not found:
        for i in range(0, len(symbols), chunk):
            often(symbols[i : i + chunk], lambda: True)
    for s in dict.fromkeys(must_have):
        if s in symbols and s not in found:
            try:
                ask([s])
            except Exception:
                continue
    return found


@dataclass
class _Block(InputPartition):
    round: int
    symbols: tuple[str, ...]


class QuoteSource(DataSource):
    """Options: ``symbols`` and ``must_have`` (with commas), ``fetch``, ``interval`` (60 s), ``retries`` (2), ``chunk`` (5), ``block`` (500), ``pause`` (1 s)."""

    @classmethod
    def name(cls) -> str:
        return "live_quotes"

    def schema(self) -> str:
        return "round long, symbol string, ts timestamp, price double, prev_close double"

    def streamReader(self, schema: T.StructType) -> DataSourceStreamReader:
        return _QuoteReader(dict(self.options))


class _QuoteReader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.options = options

    def _listed(self, name: str) -> list[str]:
        return [s for s in self.options.get(name, "").split(",") if s]

    def initialOffset(self) -> dict:
        return {"round": 0}

    def latestOffset(self) -> dict:
        return {"round": int(time.time() // float(self.options.get("interval", 60)))}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        """A block of symbols each, for the last round only: a vendor has no quotes of rounds gone by."""
        symbols, size = self._listed("symbols"), int(self.options.get("block", 500))
        return [_Block(end["round"], tuple(symbols[i : i + size])) for i in range(0, len(symbols), size)]

    def read(self, partition: _Block) -> Iterator[tuple]:
        from importlib import import_module

        module, _, attribute = self.options["fetch"].partition(":")
        o = self.options
        rows = asked(list(partition.symbols), self._listed("must_have"), getattr(import_module(module), attribute), int(o.get("retries", 2)), int(o.get("chunk", 5)), float(o.get("pause", 1)))
        for symbol, row in rows.items():
            ts = row.get("timestamp")
            at = datetime.fromtimestamp(ts if isinstance(ts, (int, float)) else time.time(), timezone.utc)
            before = row.get("previousClose")
            yield partition.round, symbol, at, row["price"], float(before) if isinstance(before, (int, float)) else None
