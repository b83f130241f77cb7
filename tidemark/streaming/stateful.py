"""Keyed state with timers and expiry: edges and coherence of live sessions, and a bounded reorder buffer."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tidemark.operators.canonical import CHANNELS

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"


@contextmanager
def rocksdb(spark: SparkSession) -> Iterator[None]:
    """Streams started inside keep their state in RocksDB, which these operators need."""
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.unset(_PROVIDER) if before is None else spark.conf.set(_PROVIDER, before)


COHERENT = "session_id string, frame long, kind string, coherence_active boolean"


class Coherence(StatefulProcessor):
    """State of a session: its last frame, the frame of its last event and its timer; gone `ttl_ms` of event time after its latest frame."""

    def __init__(self, ttl_ms: int, strict: bool):
        self.ttl_ms, self.strict = ttl_ms, strict

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getValueState("seen", "last long, event long, timer long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        last, event, timer = self.seen.get() or (-1, None, -1)
        if 0 <= timer <= timerValues.getCurrentWatermarkInMs():  # timers of a batch fire after its rows
            self.handle.deleteTimer(timer)
            last, event, timer = -1, None, -1
            yield self._forgotten(key)
        batch = pd.concat(list(rows)).sort_values("frame", kind="stable")
        late = (batch["frame"] <= last) | batch["frame"].duplicated()
        fresh = batch[~late]
        # The last event up to each frame, with what the state remembers in front.
        events = fresh["frame"].where(fresh["is_event"]).ffill().fillna(event if event is not None else float("nan"))
        since = fresh["frame"] - events
        active = (since < fresh["window"]) if self.strict else (since <= fresh["window"])
        if len(fresh):
            until = max(timer, int(fresh["ms"].max()) + self.ttl_ms)
            if timer >= 0 and timer != until:
                self.handle.deleteTimer(timer)
            if timer != until:
                self.handle.registerTimer(until)
            self.seen.update((int(fresh["frame"].iloc[-1]), None if pd.isna(events.iloc[-1]) else int(events.iloc[-1]), until))
        marked = active.reindex(batch.index) if len(fresh) else pd.Series([None] * len(batch), index=batch.index)
        yield pd.DataFrame({"session_id": key[0], "frame": batch["frame"].astype("int64"), "kind": late.map({True: "LATE", False: "FRAME"}), "coherence_active": marked.astype(object).where(~late, None)})

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        self.seen.clear()
        yield self._forgotten(key)

    @staticmethod
    def _forgotten(key: tuple) -> pd.DataFrame:
        return pd.DataFrame({"session_id": [key[0]], "frame": [None], "kind": ["FORGOTTEN"], "coherence_active": [None]}).astype({"frame": "Int64"})

    def close(self) -> None:
        pass


def live_coherence(frames: DataFrame, delay: str = "1 minute", ttl_ms: int = 86_400_000, strict: bool = False) -> DataFrame:
    """Whether each frame (session_id, frame, ts, is_event, window) of a stream lies within its window after an event.

    Equal to the batch form however the frames are cut into batches, as long as they come in order between batches;
    frames of one batch are put in order.  A frame at or before the last one seen, or repeated, is LATE and changes
    nothing.  A session's state goes when the watermark, `delay` behind the latest time, is `ttl_ms` past its latest
    frame, which a FORGOTTEN row reports; a frame that comes after that starts anew.
    """
    timed = frames.withWatermark("ts", delay)
    rows = timed.selectExpr("cast(session_id as string) session_id", "cast(frame as long) frame", "ts", "unix_millis(ts) ms", "coalesce(is_event, false) is_event", "cast(window as long) window")
    return rows.groupBy("session_id").transformWithStateInPandas(Coherence(ttl_ms, strict), COHERENT, "Append", "EventTime")


LIVE_EDGES = "session_id string, frame long, kind string, edge string, confidence double"


class Edges(StatefulProcessor):
    """State of a session: the rows that windows still reach, the edges' confidences, its last frame and its timer."""

    def __init__(self, window: int, threshold: float, least: float, ttl_ms: int):
        self.window, self.threshold, self.least, self.ttl_ms = window, threshold, least, ttl_ms
        self.pairs = [(i, j) for i in range(len(CHANNELS)) for j in range(i + 1, len(CHANNELS))]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getValueState("seen", "last long, timer long, held binary, edges binary")

    def _found(self, rows: np.ndarray, n: int) -> np.ndarray:
        """|r| of each pair at each of the last n rows where its window is full and r is above the threshold, else 0."""
        out = np.zeros((n, len(self.pairs)))
        if len(rows) < self.window:
            return out
        w = np.lib.stride_tricks.sliding_window_view(rows, self.window, axis=0)  # end of window, channel, row
        centred = w - w.mean(axis=2, keepdims=True)
        spread = np.sqrt((centred**2).mean(axis=2))
        for k, (i, j) in enumerate(self.pairs):
            both = spread[:, i] * spread[:, j]
            r = np.abs((centred[:, i] * centred[:, j]).mean(axis=1)) / np.where(both > 0, both, 1.0)
            r = np.where((both > 0) & (r > self.threshold), r, 0.0)
            out[max(0, n - len(r)) :, k] = r[-n:]
        return out

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        last, timer, held, edges = self.seen.get() or (-1, -1, b"", b"")
        if 0 <= timer <= timerValues.getCurrentWatermarkInMs():  # timers of a batch fire after its rows
            self.handle.deleteTimer(timer)
            last, timer, held, edges = -1, -1, b"", b""
        batch = pd.concat(list(rows)).sort_values("frame", kind="stable")
        late = (batch["frame"] <= last) | batch["frame"].duplicated()
        fresh, out = batch[~late], [(key[0], int(f), "LATE", "", 0.0) for f in batch["frame"][late]]
        if len(fresh):
            frames = fresh["frame"].to_numpy()
            every = np.vstack([np.frombuffer(held).reshape(-1, len(CHANNELS)), fresh[list(CHANNELS)].to_numpy(float)])
            carry = np.frombuffer(edges) if edges else np.zeros(len(self.pairs))
            with np.errstate(divide="ignore"):
                rate = np.log(fresh["decay"].to_numpy(float))[:, None]
                total = np.cumsum(rate, axis=0)
                peak = np.maximum.accumulate(np.log(self._found(every, len(fresh))) - total + rate, axis=0)
                state = np.exp(total + np.maximum(peak, np.log(carry)))
            state[state < self.least] = 0.0
            for t, k in zip(*np.nonzero(state), strict=True):
                i, j = self.pairs[k]
                out.append((key[0], int(frames[t]), "EDGE", f"{CHANNELS[i]}->{CHANNELS[j]}", float(state[t, k])))
            until = max(timer, int(fresh["ms"].max()) + self.ttl_ms)
            if timer >= 0 and timer != until:
                self.handle.deleteTimer(timer)
            if timer != until:
                self.handle.registerTimer(until)
            keep = every[-(self.window - 1) :] if self.window > 1 else every[:0]
            self.seen.update((int(frames[-1]), until, np.ascontiguousarray(keep).tobytes(), np.ascontiguousarray(state[-1]).tobytes()))
        yield pd.DataFrame(out, columns=["session_id", "frame", "kind", "edge", "confidence"])

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        self.seen.clear()
        yield pd.DataFrame({"session_id": pd.Series(dtype=str), "frame": pd.Series(dtype="int64"), "kind": pd.Series(dtype=str), "edge": pd.Series(dtype=str), "confidence": pd.Series(dtype=float)})

    def close(self) -> None:
        pass


def live_edges(frames: DataFrame, window: int = 50, threshold: float = 0.32, decay: float | str = 0.995, least: float = 0.05, delay: str = "1 minute", ttl_ms: int = 86_400_000) -> DataFrame:
    """Edges of each frame (session_id, frame, ts and the channels) of a stream: trailing correlation, decay and eviction.

    decay is a number, or the column that holds the decay of each frame.  Equal to the batch form under the same terms
    as `live_coherence`, whose rules for late frames and for sessions that stay away hold here, too; a frame without an
    edge has no row.
    """
    timed = frames.withWatermark("ts", delay)
    rate = F.col(decay) if isinstance(decay, str) else F.lit(decay)
    rows = timed.select(F.col("session_id").cast("string").alias("session_id"), F.col("frame").cast("long").alias("frame"), "ts", F.unix_millis("ts").alias("ms"), rate.cast("double").alias("decay"), *[F.col(c).cast("double").alias(c) for c in CHANNELS])
    return rows.groupBy("session_id").transformWithStateInPandas(Edges(window, threshold, least, ttl_ms), LIVE_EDGES, "Append", "EventTime")


ORDERED = "stream_id string, kind string, sequence long, ts timestamp, payload string, last_sequence long, n long"


class Reorder(StatefulProcessor):
    """State of a stream: buffered rows and the time that the last released one had."""

    def __init__(self, capacity: int):
        self.capacity = capacity

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.buffer = handle.getListState("buffer", "ts long, sequence long, payload string")
        self.about = handle.getValueState("about", "held long, released long, timer long")

    def _release(self, key: tuple, now: int) -> tuple[list[tuple], int, int, int]:
        """Rows whose time the watermark has passed, and the state without them: held, released, timer."""
        held, released, timer = self.about.get() or (0, -1, -1)
        if timer < 0 or timer > now:
            return [], held, released, timer
        rows = sorted(self.buffer.get(), key=lambda r: r[:2])
        ready, rest = [r for r in rows if r[0] <= now], [r for r in rows if r[0] > now]
        if rest:
            self.buffer.put(rest)
            self.handle.registerTimer(rest[0][0])
        else:
            self.buffer.clear()
        state = len(rest), max([released, *(r[0] for r in ready)]), rest[0][0] if rest else -1
        self.about.update(state)
        return [(key[0], "ROW", s, t, p, s, 1) for t, s, p in ready], *state

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        batch = pd.concat(list(rows)).sort_values(["ms", "sequence"], kind="stable")
        _, _, before = self.about.get() or (0, -1, -1)
        out, held, released, timer = self._release(key, timerValues.getCurrentWatermarkInMs())  # timers of a batch fire after its rows
        if out:
            self.handle.deleteTimer(before)
        late = batch["ms"] <= released
        fresh = batch[~late]
        kept, lost = fresh.iloc[: max(0, self.capacity - held)], fresh.iloc[max(0, self.capacity - held) :]
        if len(kept):
            new = [(int(t), int(s), p) for t, s, p in zip(kept["ms"], kept["sequence"], kept["payload"], strict=True)]
            self.buffer.appendList(new)
            first = new[0][0]
            if timer < 0 or first < timer:
                if timer >= 0:
                    self.handle.deleteTimer(timer)
                self.handle.registerTimer(first)
                timer = first
            self.about.update((held + len(kept), released, timer))
        out += [(key[0], "LATE", int(s), int(t), p, int(s), 1) for t, s, p in zip(batch["ms"][late], batch["sequence"][late], batch["payload"][late], strict=True)]
        if len(lost):
            out.append((key[0], "OVERFLOW", int(lost["sequence"].min()), int(lost["ms"].min()), None, int(lost["sequence"].max()), len(lost)))
        yield self._rows(out)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        yield self._rows(self._release(key, timerValues.getCurrentWatermarkInMs())[0])

    @staticmethod
    def _rows(rows: list[tuple]) -> pd.DataFrame:
        df = pd.DataFrame(rows, columns=["stream_id", "kind", "sequence", "ts", "payload", "last_sequence", "n"])
        df["ts"] = pd.to_datetime(df["ts"], unit="ms")
        return df

    def close(self) -> None:
        pass


def reordered(samples: DataFrame, delay: str = "1 minute", capacity: int = 12_000) -> DataFrame:
    """Samples (stream_id, sequence, ts, payload) of a stream in the order of their times.

    A stream keeps at most `capacity` samples until the watermark, `delay` behind the latest time, has passed theirs;
    an event-time timer at the earliest releases them in the order of (ts, sequence) as kind ROW.  What does not fit is
    lost and reported, once for each batch, as kind OVERFLOW with the range of sequences, their number n and the earliest
    time; a sample that is not after the last one released is LATE.
    """
    timed = samples.withWatermark("ts", delay).selectExpr("cast(stream_id as string) stream_id", "cast(sequence as long) sequence", "ts", "unix_millis(ts) ms", "cast(payload as string) payload")
    return timed.groupBy("stream_id").transformWithStateInPandas(Reorder(capacity), ORDERED, "Append", "EventTime")
