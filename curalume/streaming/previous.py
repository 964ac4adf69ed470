"""The previous message of a channel in a stream, whatever order messages arrive in."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from curalume.operators.messages import take_previous

_LINK = ["tweet_url", "username", "author", "text"]
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: About so many bytes of waiting rows go into one entry of the state store.
_BLOCK = 4 << 20


def _packed(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def _unpacked(block: bytes) -> pd.DataFrame:
    return pa.ipc.open_stream(bytes(block)).read_all().to_pandas()


def _ms(rows: pd.DataFrame) -> np.ndarray:
    return rows["ts"].to_numpy("datetime64[ns]").astype("int64") // 1_000_000


def _lengths(lists: pd.Series) -> np.ndarray:
    return np.array([0 if x is None else len(x) for x in lists], dtype="int64")


class PreviousMessage(StatefulProcessor):
    """Keeps messages until the watermark has passed them, those of many channels (a shard) in blocks of rows.

    A message that needs no previous one is passed on at once; what later ones may take from it waits with the others.
    One that needs it waits itself. When the watermark passes, messages up to it are gone through by channel and id,
    and the last one of each channel is kept for `ttl` of event time, or up to a 30th more. A frame's rows are one entry
    of the state store, or several if they are large, named by their earliest time: adding one reads no other, and one
    timer, at the earliest that waits, releases those that have come due. So calls of the state store grow with frames
    and channels, not with messages.
    """

    def __init__(self, columns: list[str], ttl_ms: int):
        self.columns, self.ttl = columns, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        link = ", ".join(f"{c} string" for c in _LINK)
        self.handle = handle
        self.last = handle.getMapState("last", "channel_id long", f"ts long, {link}")
        self.waiting = handle.getMapState("waiting", "least long, number long", "block binary")
        self.clock = handle.getValueState("clock", "due long, sweep long, number long")  # the earliest that waits, when to forget, and the next block's number

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        watermark = timerValues.getCurrentWatermarkInMs()
        before, sweep, number = self._clock()
        due = before
        for frame in rows:
            if frame.empty:
                continue
            frame = frame[self.columns].reset_index(drop=True)
            linked = (frame["tweet_url"].notna() & (frame["tweet_url"] != "")).to_numpy(bool)
            needs = ~linked & (_lengths(frame["images"]) + _lengths(frame["videos"]) > 0)
            if not needs.all():
                yield self._frame(frame[~needs])
            least, number = self._kept(self._slim(frame, needs, linked), number)
            due = least if due is None else min(due, least)
        if due is not None:
            self.clock.update((due, sweep, number))
            if due != before and due > watermark:
                self.handle.registerTimer(due)
            if due <= watermark:
                yield from self._released(watermark)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = max(timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs())
        yield from self._released(now)
        self._swept(now)

    def _clock(self) -> tuple[int | None, int | None, int]:
        return tuple(self.clock.get()) if self.clock.exists() else (None, None, 0)

    def _slim(self, frame: pd.DataFrame, needs: np.ndarray, linked: np.ndarray) -> pd.DataFrame:
        """The rows as they wait: of one that doesn't wait itself only what another can take from it, which is nothing without a link."""
        out = {}
        for c in self.columns:
            column = frame[c]
            if column.dtype == object:
                column = column.where(needs | linked if c in _LINK else needs, None)
            out[c] = column
        return pd.DataFrame(out | {"_needs": needs})

    def _kept(self, rows: pd.DataFrame, number: int) -> tuple[int, int]:
        """Put rows into the state in blocks; their earliest time and the next number."""
        ms = _ms(rows)
        table = pa.Table.from_pandas(rows, preserve_index=False).replace_schema_metadata(None)
        step = max(1, len(rows) * _BLOCK // max(_BLOCK, table.nbytes))
        for at in range(0, len(rows), step):
            self.waiting.updateValue((int(ms[at : at + step].min()), number), (_packed(table.slice(at, step)),))
            number += 1
        return int(ms.min()), number

    def _due(self, now: int, number: int) -> tuple[pd.DataFrame, int | None, int]:
        """Take the rows up to `now` out of the state: them, the earliest time of those that stay, and the next number."""
        ready, left = [], []
        for least, n in sorted(map(tuple, self.waiting.keys()), key=lambda k: k[1]):
            if least > now:
                left.append(least)
                continue
            rows = _unpacked(self.waiting.getValue((least, n))[0])
            self.waiting.removeKey((least, n))
            passed = _ms(rows) <= now
            ready.append(rows[passed])
            if not passed.all():
                least, number = self._kept(rows[~passed], number)
                left.append(least)
        return pd.concat(ready).sort_values(["channel_id", "message_id"], kind="stable", ignore_index=True), min(left, default=None), number

    def _released(self, now: int) -> Iterator[pd.DataFrame]:
        due, sweep, number = self._clock()
        if due is None or due > now:
            return
        ready, due, number = self._due(now, number)
        ms, channels, needs = _ms(ready), ready["channel_id"].to_numpy("int64"), ready["_needs"].to_numpy(bool)
        links = {c: np.array([x if isinstance(x, str) else None for x in ready[c]], dtype=object) for c in _LINK}
        first = np.append(True, channels[1:] != channels[:-1])
        taken = {c: np.append(None, x[:-1]) for c, x in links.items()}
        for i in np.flatnonzero(first & needs):
            known = self.last.getValue((int(channels[i]),)) or (0, None, None, None, None)
            for c, x in zip(_LINK, known[1:], strict=True):
                taken[c][i] = x
        for i in np.flatnonzero(np.append(first[1:], True)):
            link = (links[c][i] for c in _LINK) if links["tweet_url"][i] else (None,) * len(_LINK)
            self.last.updateValue((int(channels[i]),), (int(ms[i]), *link))
        if due is not None:
            self.handle.registerTimer(due)
        if sweep is None:
            sweep = max(now + 1, int(ms.min()) + self.ttl)
            self.handle.registerTimer(sweep)
        self.clock.update((due, sweep, number))
        if needs.any():
            yield self._frame(ready[needs], {c: x[needs] for c, x in taken.items()})

    def _swept(self, now: int) -> None:
        """Forget the last messages of channels that were silent for `ttl`."""
        due, sweep, number = self._clock()
        if sweep is None or sweep > now:
            return
        kept = {k[0]: v[0] for k, v in self.last.iterator()}
        for channel, ts in kept.items():
            if ts + self.ttl <= now:
                self.last.removeKey((channel,))
        left = [ts for ts in kept.values() if ts + self.ttl > now]
        sweep = max(min(left) + self.ttl, now + max(1, self.ttl // 30)) if left else None
        if left:
            self.handle.registerTimer(sweep)
        self.clock.update((due, sweep, number))

    def _frame(self, rows: pd.DataFrame, previous: dict[str, np.ndarray] | None = None) -> pd.DataFrame:
        """Rows with what the previous one has."""
        out = rows[self.columns].reset_index(drop=True).astype({"message_id": "int64", "channel_id": "int64", "ts": "datetime64[ns]"})
        for c in _LINK:
            out[f"_{c}"] = pd.Series(previous[c] if previous else [None] * len(out), dtype=object)
        return out

    def close(self) -> None:
        pass


def with_previous_message_stream(enriched: DataFrame, ttl_days: int = 30, shards: int = 256) -> DataFrame:
    """take_previous in a stream with a watermark on ts: messages of a channel that come in any order within the watermark give the batch result.

    A message with media but no link waits until the watermark passes it, so a stream's last ones come with later
    traffic: a heartbeat message of a channel of its own moves the watermark on where there is none. Ids of a channel
    ascend with time. A channel that is silent for `ttl_days` forgets its last message. Channels are dealt to `shards` by
    their hash; a task holds what waits of one shard. The state needs the RocksDB store, which is set for the session.
    """
    enriched.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", _ROCKSDB)
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in enriched.schema.fields)
    more = ", ".join(f"_{c} string" for c in _LINK)
    dealt = enriched.withColumn("_shard", F.pmod(F.xxhash64("channel_id"), F.lit(shards)))
    found = dealt.groupBy("_shard").transformWithStateInPandas(PreviousMessage(enriched.columns, ttl_days * 86_400_000), f"{kinds}, {more}", "append", "EventTime")
    packed = F.struct(*(F.col(f"_{c}").alias(c) for c in _LINK))
    return take_previous(found.withColumn("_previous", packed).drop(*(f"_{c}" for c in _LINK)))
