"""Keyed state of the streams: result spools, presence of nodes, owners of addresses.

State lives in Spark's RocksDB store, a row for each key; a batch touches the keys it holds and those
whose timer is due, whatever came before.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def with_state(spark: SparkSession) -> None:
    """Streams with keyed state need the RocksDB store."""
    if spark.conf.get(PROVIDER, "") != ROCKSDB:
        spark.conf.set(PROVIDER, ROCKSDB)


def with_timers(rows: DataFrame, keys: list[str], processor: StatefulProcessor, out: str) -> DataFrame:
    with_state(rows.sparkSession)
    return rows.groupBy(*keys).transformWithState(processor, out, "Append", "EventTime")


class Spool(StatefulProcessor):
    """Hits of a query: every ``period`` the best unsent ones go, ``expected`` in all; the spool lives ``life`` (milliseconds).

    A spool opens with its first hit. Hits wait until the watermark has passed the next sending time, so
    what goes does not depend on how the stream was cut into batches. A document is sent once in a
    spool. Hits from the end of its life on open another spool.
    """

    OUT = "query_id string, document_id string, relevance double, record_ms long, sent_ms long"

    def __init__(self, expected: int, period: int, life: int) -> None:
        self.expected, self.period, self.life = expected, period, life

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "document_id string, relevance double, ms long")
        self.spool = handle.getValueState("spool", "opened long, sent array<string>")

    def due(self, opened: int, ms: int) -> int:
        """When a hit of a spool is sent."""
        return opened + self.period * ((max(ms, opened) - opened) // self.period + 1)

    def wake(self, at: int) -> None:
        if at not in set(self.handle.listTimers()):
            self.handle.registerTimer(at)

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        new = [(r["document_id"], r["relevance"], r["ms"]) for r in rows]
        self.waiting.appendList(new)
        first = min(ms for *_, ms in new)
        opened = self.spool.get()[0] if self.spool.exists() else first
        self.wake(self.due(first if first >= opened + self.life else opened, first))
        return iter(())

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        now = timerValues.getCurrentWatermarkInMs()
        opened, sent = (self.spool.get()[0], list(self.spool.get()[1])) if self.spool.exists() else (None, [])
        rows = sorted(((r[0], r[1], r[2]) for r in self.waiting.get()), key=lambda r: (r[2], r[0] or "")) if self.waiting.exists() else []
        while rows:
            if opened is None or rows[0][2] >= opened + self.life:
                opened, sent = rows[0][2], []
            at = self.due(opened, rows[0][2])
            if at > now:
                break
            lot: dict[str, tuple] = {}
            while rows and rows[0][2] < min(at, opened + self.life):
                hit = rows.pop(0)
                if hit[0] not in sent:
                    lot.setdefault(hit[0], hit)
            best = sorted(lot.values(), key=lambda r: (r[1] is None, -(r[1] or 0.0), r[0] or ""))[: self.expected - len(sent)]
            for document_id, relevance, ms in best:
                sent.append(document_id)
                yield Row(query_id=key[0], document_id=document_id, relevance=relevance, record_ms=ms, sent_ms=at)
        self.waiting.clear()
        if rows:
            self.waiting.put(rows)
            self.wake(self.due(opened, rows[0][2]))
        if not rows and (opened is None or now >= opened + self.life):
            self.spool.clear()
            return
        self.spool.update((opened, sent))
        if not rows:
            self.wake(opened + self.life)

    def close(self) -> None:
        pass


class NodePresence(StatefulProcessor):
    """Where a node is: a notify joins an address and leaves the one before, a logout (which names none) or silence leaves it.

    Rows older than the node's newest are ignored; a node is silent after ``life`` milliseconds.
    """

    OUT = "node_id string, change string, ip string, port int, us long, event_id long"

    def __init__(self, life: int) -> None:
        self.life = life

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.node = handle.getValueState("node", "us long, event_id long, ip string, port int")

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        known = tuple(self.node.get()) if self.node.exists() else None
        for r in sorted(rows, key=lambda r: (r["us"], r["event_id"])):
            us, event_id = r["us"], r["event_id"]
            if known is not None and (us, event_id) <= known[:2]:
                continue
            here = (r["ip"], r["port"]) if r["action"] == "notify" else (None, None)
            if r["action"] not in ("notify", "logout") or r["action"] == "notify" and None in here:
                continue
            if known is not None and known[2] is not None and known[2:] != here:
                yield Row(node_id=key[0], change="leave", ip=known[2], port=known[3], us=us, event_id=event_id)
            if here[0] is not None:
                yield Row(node_id=key[0], change="join", ip=here[0], port=here[1], us=us, event_id=event_id)
            known = (us, event_id, *here)
        if known is not None:
            self.node.update(known)
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(max(known[0] // 1000 + self.life, timerValues.getCurrentWatermarkInMs() + 1))

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        if self.node.exists():
            us, event_id, ip, port = self.node.get()
            self.node.clear()
            if ip is not None:
                yield Row(node_id=key[0], change="leave", ip=ip, port=port, us=us + self.life * 1000, event_id=event_id)

    def close(self) -> None:
        pass


class AddressOwner(StatefulProcessor):
    """The node that joined an address last; it stays the owner until it leaves or another one joins.

    ``nth`` counts an address's changes of owner; a null node_id says that nobody is left.
    """

    OUT = "ip string, port int, nth long, node_id string, us long"

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.owner = handle.getValueState("owner", "us long, event_id long, node_id string, nth long")

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        us, event_id, node_id, nth = tuple(self.owner.get()) if self.owner.exists() else (-(1 << 62), 0, None, 0)
        before = nth, us
        for r in sorted(rows, key=lambda r: (r["us"], r["event_id"], r["change"] == "join")):
            if r["change"] == "join" and (r["us"], r["event_id"]) > (us, event_id):
                us, event_id, node_id, nth = r["us"], r["event_id"], r["node_id"], nth + 1
            elif r["change"] == "leave" and node_id == r["node_id"] and r["us"] >= us:
                node_id, nth = None, nth + 1
        self.owner.update((us, event_id, node_id, nth))
        if (nth, us) != before:
            yield Row(ip=key[0], port=key[1], nth=nth, node_id=node_id, us=us)

    def close(self) -> None:
        pass
