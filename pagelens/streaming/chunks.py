"""Live chunk feeds: each chunk is inspected as it comes, and what it completes goes out in the same batch.

A probe's state is kept apart by how it changes: what is not yet complete of its document is one value, and every chunk that
came before its turn is an entry of its own, written once and deleted when its turn comes.
"""

from __future__ import annotations

import base64
import json
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from pagelens.operators.inspector import Page

CHUNKS = "probe_id string, seq bigint, at_ms double, bytes binary, charset string, last boolean"
RECORDS = """probe_id string, record string, kind string, ord int, property string, audience string, value string, location string,
 at_ms double, observed_by_byte bigint, valid boolean, types array<string>, bytes bigint, limit string, error string,
 completion string, bytes_read bigint"""
_NAMES = [f.split()[0] for f in RECORDS.split(",")]
_STATE = "page string, following bigint, size bigint, held bigint, closed boolean"
_CHUNK = "data binary, at_ms double, charset string, last boolean"
# Fixed value: the state store that keeps values, entries and timers of their own.
_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def _dump(value: object) -> str:
    return json.dumps(value, default=lambda b: {"b64": base64.b64encode(bytes(b)).decode()})


def _load(text: str) -> Any:
    return json.loads(text, object_hook=lambda d: base64.b64decode(d["b64"]) if d.keys() == {"b64"} else d)


class _Inspection(StatefulProcessor):
    """One probe's chunks in order of their numbers, whatever the order in which they come."""

    def __init__(self, max_bytes: int, timeout_ms: int):
        self.max_bytes, self.timeout_ms = max_bytes, timeout_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", _STATE)
        self.waiting = handle.getMapState("waiting", "seq bigint", _CHUNK)

    def close(self) -> None:
        pass

    def _rows(self, key: tuple, page: Page, ends: list[dict]) -> pd.DataFrame:
        rows = ends + [{"record": "signal", **x} for x in page.signals] + [{"record": "json_ld", **x} for x in page.blocks]
        return pd.DataFrame([{"probe_id": key[0], **r} for r in rows], columns=_NAMES).astype(object).where(lambda f: f.notna(), None)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        saved, following, size, held, closed = self.state.get() if self.state.exists() else ("{}", 0, 0, 0, False)
        page, now, ends = Page(**_load(saved)), {}, []
        late = lambda data, at: ends.append({"record": "late", "completion": "late", "bytes_read": len(data), "at_ms": at})
        for batch in rows:
            for r in batch.sort_values("seq").itertuples():
                if closed or r.seq < following or r.seq in now or (held and self.waiting.containsKey((r.seq,))):
                    late(r.bytes, r.at_ms)
                else:
                    now[r.seq] = (bytes(r.bytes), None if r.at_ms != r.at_ms else r.at_ms, r.charset, bool(r.last))
        while not closed:
            if (chunk := now.pop(following, None)) is None:
                if not held or not self.waiting.containsKey((following,)):
                    break
                chunk, held = self.waiting.getValue((following,)), held - 1
                self.waiting.removeKey((following,))
            data, at, charset, last = chunk
            following += 1
            if charset and page.decoder.charset is None:
                page.decoder.charset = charset
            room = self.max_bytes - size
            if data[:room]:
                page.feed(bytes(data[:room]), at)
            closed = len(data) > room or last
            if closed:
                page.feed(b"", at or 0.0, last=True)
                ends.append({"record": "probe", "completion": "max-bytes-exceeded" if len(data) > room else "complete", "bytes_read": page.read, "at_ms": at or 0.0})
            size = min(size + len(data), self.max_bytes)
        if closed:
            for data, at, *_ in now.values():
                late(data, at)
            if held:
                for _, (data, at, *_) in self.waiting.iterator():
                    late(data, at)
                self.waiting.clear()
                held = 0
        else:
            for seq, chunk in now.items():
                self.waiting.updateValue((seq,), chunk)
            held += len(now)
        # the end of a probe is kept until its timer, to tell late chunks
        self.state.update(("{}" if closed else _dump(page.state()), following, size, held, closed))
        for timer in self.handle.listTimers():
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.timeout_ms)
        yield self._rows(key, page, ends)

    def handleExpiredTimer(self, key: tuple, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        saved, _, _, held, closed = self.state.get()
        page, ends = Page(**_load(saved)), []
        if not closed:
            page.feed(b"", 0.0, last=True)
            ends.append({"record": "probe", "completion": "timeout", "bytes_read": page.read, "at_ms": 0.0})
        self.state.clear()
        if held:
            self.waiting.clear()
        yield self._rows(key, page, ends)


def inspected_stream(chunks: DataFrame, max_bytes: int = 10 << 20, timeout_ms: int = 15_000) -> DataFrame:
    """Rows of a streaming chunk frame: signals and json_ld as chunks complete them, then one row probe an end.

    Chunks of a probe are numbered by seq from 0; one that comes early waits for those before it. A probe ends with its
    last chunk, at max_bytes, or after timeout_ms without a chunk; chunks that come after its end, or again, are
    rows late. The state of a probe is what is not yet complete of its document, not its body, and the chunks that wait. The
    session's state store must be one with timers, as start() sees to.
    """
    return chunks.groupBy("probe_id").transformWithStateInPandas(
        statefulProcessor=_Inspection(max_bytes, timeout_ms), outputStructType=RECORDS, outputMode="append", timeMode="ProcessingTime"
    )


_TABLES = {
    "signals": ("signal", ["probe_id", "kind", "ord", "property", "audience", "value", "location", "at_ms", "observed_by_byte"]),
    "json_ld": ("json_ld", ["probe_id", "ord", "valid", "types", "bytes", "limit", "error", "location", "at_ms", "observed_by_byte"]),
    "probes": ("probe", ["probe_id", "completion", "bytes_read"]),
    "late": ("late", ["probe_id", "at_ms", "bytes_read"]),
}


def start(chunks: DataFrame, path: str, checkpoint: str, max_bytes: int = 10 << 20, timeout_ms: int = 15_000, every: str = "1 second") -> StreamingQuery:
    """Writes the tables of inspected_stream under `path`, one folder a batch, so that a batch done again replaces itself.

    Timeouts make a batch `every` so often even without chunks, hence such a stream is never idle: wait for its
    progress, not for processAllAvailable. Batches without rows write nothing.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch.persist()
        if not batch.isEmpty():
            for name, (record, columns) in _TABLES.items():
                batch.where(F.col("record") == record).select(*columns).write.mode("overwrite").parquet(f"{path}/{name}/batch={number}")
        batch.unpersist()

    spark = chunks.sparkSession
    before = spark.conf.get(_STORE[0], None)
    spark.conf.set(*_STORE)
    try:
        return inspected_stream(chunks, max_bytes, timeout_ms).writeStream.foreachBatch(write).trigger(processingTime=every).option("checkpointLocation", checkpoint).start()
    finally:
        # a query keeps the settings that it began with
        if before is None:
            spark.conf.unset(_STORE[0])
        else:
            spark.conf.set(_STORE[0], before)
