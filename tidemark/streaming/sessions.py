"""Per-session state over streams: decaying edges, sequence continuity, and a trailing correlation.  Coherence is in `stateful`."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidemark.operators.canonical import CHANNELS

PAIRS = [(i, j) for i in range(4) for j in range(i + 1, 4)]
EDGES = "session_id string, frame long, kind string, edge string, confidence double"


def live_edges(frames: DataFrame, window: int = 50, threshold: float = 0.32, decay: float = 0.995, least: float = 0.05) -> DataFrame:
    """Edges of each frame as they arrive: trailing correlation, decay and eviction, one state per session.

    State is the last `window` rows of four channels, at most six edge confidences and the last frame.  Frames of a
    batch are put in order; a frame at or before the last one already seen is reported as LATE and changes nothing.
    """

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, flat, held = state.get if state.exists else (-1, [], [])
        rows = np.array(flat, float).reshape(-1, 4)
        edges = np.array(held, float) if len(held) else np.zeros(6)
        out = []
        batch = pd.concat(list(parts)).sort_values("frame", kind="stable")
        for r in batch[["frame", *CHANNELS]].itertuples(index=False):
            if r[0] <= last:
                out.append((key[0], int(r[0]), "LATE", "", 0.0))
                continue
            last = int(r[0])
            rows = np.vstack([rows, np.array(r[1:], float)])[-window:]
            if len(rows) == window:
                spread = rows.std(axis=0)
                for k, (i, j) in enumerate(PAIRS):
                    if spread[i] * spread[j] > 0:
                        c = abs(((rows[:, i] - rows[:, i].mean()) * (rows[:, j] - rows[:, j].mean())).mean() / (spread[i] * spread[j]))
                        edges[k] = max(edges[k], c) if c > threshold else edges[k]
            edges = edges * decay
            edges[edges < least] = 0.0
            out += [(key[0], last, "EDGE", f"{CHANNELS[i]}->{CHANNELS[j]}", float(edges[k])) for k, (i, j) in enumerate(PAIRS) if edges[k] > 0]
        state.update((last, rows.ravel().tolist(), edges.tolist()))
        yield pd.DataFrame(out, columns=["session_id", "frame", "kind", "edge", "confidence"])

    return frames.groupBy("session_id").applyInPandasWithState(step, EDGES, "last long, rows array<double>, edges array<double>", "append", GroupStateTimeout.NoTimeout)


GAPS = "stream_id string, first_missing long, last_missing long"


def sequence_gaps(samples: DataFrame) -> DataFrame:
    """Missing sequence ranges of each stream (stream_id, sequence), across batches; late repeats open no gap."""

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        out = []
        for s in sorted(set(pd.concat(list(parts))["sequence"].tolist())):
            if last is not None and s > last + 1:
                out.append((key[0], last + 1, s - 1))
            last = s if last is None else max(last, s)
        state.update((last,))
        yield pd.DataFrame(out, columns=["stream_id", "first_missing", "last_missing"])

    return samples.groupBy("stream_id").applyInPandasWithState(step, GAPS, "last long", "append", GroupStateTimeout.NoTimeout)


def windowed_counts(events: DataFrame, size: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Event counts and mean values by type over event-time windows, late events dropped by watermark."""
    kept = events.withWatermark("ts", late)
    return kept.groupBy(F.window("ts", size), "event_type").agg(F.count("*").alias("n"), F.avg("value").alias("mean"))
