"""Live forms: trackers, the burst gate, trails and detection counts on streams.

State is keyed by video. The frames of a batch are stepped in order; a frame
that comes after a later one of its video was stepped is late and is dropped, as
a tracker cannot go back. Detections must therefore come in order up to what one
batch holds. Points of a new track may be two frames older than the batch."""

from __future__ import annotations

import math
import pickle
from collections import deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from flightloom.operators import dense
from flightloom.operators.tracking import NAMES, POINT_DDL, make_tracker, walk
from flightloom.operators.windows import Gate

#: State of a track or pixel that nothing has come for in so long is dropped.
IDLE_MS = 3_600_000
#: Side of a tile of trail weights.
SIDE = 64


def track_stream(detections: DataFrame, kind: str = "kalman", **options) -> DataFrame:
    """Points of the tracks on a stream of detections; the same as in a batch,
    however the stream is cut between frames."""

    def step(key: tuple, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        tracker, last = pickle.loads(state.get[0]) if state.exists else (make_tracker(kind, **options), None)
        pdf = pd.concat(list(pdfs), ignore_index=True)
        pdf = pdf[pdf.frame > last] if last is not None else pdf
        if len(pdf):
            first = int(pdf.frame.min()) if last is None else last + 1
            rows = walk(tracker, key[0], pdf, range(first, int(pdf.frame.max()) + 1))
            state.update((pickle.dumps((tracker, int(pdf.frame.max()))),))
            yield pd.DataFrame(rows, columns=NAMES)

    return detections.groupBy("video_id").applyInPandasWithState(step, POINT_DDL, "state binary", "append", GroupStateTimeout.NoTimeout)


def _timeout(idle_ms: int | None) -> str:
    return GroupStateTimeout.ProcessingTimeTimeout if idle_ms else GroupStateTimeout.NoTimeout


def gate_stream(counts: DataFrame, min_detections: int, window: int, trigger: int, cooldown: int) -> DataFrame:
    """The burst gate on a stream of (video_id, frame, n): video_id, frame, keep. Late frames are dropped."""

    def step(key: tuple, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        gate, last = pickle.loads(state.get[0]) if state.exists else (Gate(min_detections, window, trigger, cooldown), -1)
        pdf = pd.concat(list(pdfs)).sort_values("frame")
        pdf = pdf[pdf.frame > last]
        out = [(key[0], int(r.frame), gate.step(int(r.frame), int(r.n))) for r in pdf.itertuples()]
        state.update((pickle.dumps((gate, max([last, *(o[1] for o in out)]))),))
        yield pd.DataFrame(out, columns=["video_id", "frame", "keep"])

    return counts.groupBy("video_id").applyInPandasWithState(step, "video_id string, frame long, keep boolean", "state binary", "append", GroupStateTimeout.NoTimeout)


def coherent(history: deque, min_points: int = 3, min_path: float = 14.0, min_displacement: float = 10.0, min_straightness: float = 0.2, radius: float = 14.0, min_segment: float = 4.0) -> bool:
    """Whether the points (x, y) look like flight; as ``windows.coherent_trails`` has it."""
    xy = list(history)
    steps = [math.dist(a, b) for a, b in zip(xy, xy[1:])]
    path, away = sum(steps), math.dist(xy[0], xy[-1])
    span = math.hypot(*(max(v) - min(v) for v in zip(*xy)))
    straight = away / path if path > 1e-6 else 1.0
    return len(xy) >= min_points and path >= min_path and away >= min_displacement and straight >= min_straightness and span >= radius and max(steps, default=0.0) >= min_segment


def trail_stream(points: DataFrame, history: int = 12, max_gap: int = 2, idle_ms: int | None = IDLE_MS, **limits) -> DataFrame:
    """video_id, track_id, frame, coherent on a stream of track points. A track's
    state is its last ``history`` points since a gap of over ``max_gap`` frames; it is
    evicted when nothing comes for ``idle_ms`` (None: never, for a run that ends
    with its input, as a query with timeouts goes on)."""

    def step(key: tuple, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last, kept = pickle.loads(state.get[0]) if state.exists else (None, deque(maxlen=history))
        out = []
        for r in pd.concat(list(pdfs)).sort_values("frame").itertuples():
            if last is not None and r.frame <= last:  # late
                continue
            if last is not None and r.frame - last > max_gap:
                kept.clear()
            kept.append((float(r.x), float(r.y)))
            last = int(r.frame)
            out.append((*key, last, coherent(kept, **limits)))
        state.update((pickle.dumps((last, kept)),))
        if idle_ms:
            state.setTimeoutDuration(idle_ms)
        yield pd.DataFrame(out, columns=["video_id", "track_id", "frame", "coherent"])

    return points.groupBy("video_id", "track_id").applyInPandasWithState(step, "video_id string, track_id long, frame long, coherent boolean", "state binary", "append", _timeout(idle_ms))


def trail_energy_stream(points: DataFrame, decay: float = 0.9, idle_ms: int | None = IDLE_MS, side: int = SIDE) -> DataFrame:
    """Decayed weight of each pixel a track point fell on: video_id, x, y, frame,
    energy of the pixels met, at each batch. The state of a tile of ``side`` x ``side`` pixels is an array of their
    weights and of the frames they hold for; late points count by how old they are. A tile that nothing meets for
    ``idle_ms`` is forgotten: its weights have decayed."""

    def step(key: tuple, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        energy, last = (np.frombuffer(b, k).copy() for b, k in zip(state.get, ("<f8", "<i8"))) if state.exists else (np.zeros(side * side), np.full(side * side, -1, np.int64))
        pdf = pd.concat(list(pdfs))
        pdf = pdf.assign(at=(pdf.y - key[2] * side) * side + pdf.x - key[1] * side).sort_values("frame", kind="stable")
        for i, f in zip(pdf["at"].to_numpy(), pdf.frame.to_numpy()):
            if last[i] < 0 or f >= last[i]:
                energy[i] = 1.0 + (energy[i] * decay ** (f - last[i]) if last[i] >= 0 else 0.0)
                last[i] = f
            else:
                energy[i] += decay ** (last[i] - f)
        state.update((energy.tobytes(), last.tobytes()))
        if idle_ms:
            state.setTimeoutDuration(idle_ms)
        met = np.unique(pdf["at"].to_numpy())
        yield pd.DataFrame({"video_id": key[0], "x": (met % side + key[1] * side).astype(np.int32), "y": (met // side + key[2] * side).astype(np.int32), "frame": last[met], "energy": energy[met]})

    px = points.select("video_id", F.rint("x").cast("int").alias("x"), F.rint("y").cast("int").alias("y"), "frame")
    px = px.withColumns({"_tx": F.floor(F.col("x") / side).cast("int"), "_ty": F.floor(F.col("y") / side).cast("int")})
    return px.groupBy("video_id", "_tx", "_ty").applyInPandasWithState(step, "video_id string, x int, y int, frame long, energy double", "energy binary, last binary", "update", _timeout(idle_ms))


def motion_heat_tile_stream(frames: DataFrame, threshold: float = 0.0, tile: int = dense.TILE) -> DataFrame:
    """Sum of each pixel's changes above a threshold on a stream of dense frames: video_id, tile, h, w, frame (the last),
    energy (doubles of the tile's pixels), at each batch. The state of a tile of a video is its last pixels and their sums,
    so a frame is as many rows as it has tiles; late frames are dropped. ``whole_heat`` puts tiles together."""

    def step(key: tuple, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        frame, before, energy = state.get if state.exists else (-1, None, None)
        before, energy = before and np.frombuffer(before, np.uint8), energy and np.frombuffer(energy, "<f8").copy()
        pdf = pd.concat(list(pdfs)).sort_values("frame")
        for f, px in zip(pdf.frame, pdf.px):
            if f <= frame:
                continue
            now = np.frombuffer(px, np.uint8)
            if before is None:
                energy = np.zeros(len(now))
            else:
                change = np.abs(now.astype(np.float64) - before)
                energy += np.where(change > threshold, change, 0.0)
            frame, before = int(f), now
        state.update((frame, before.tobytes(), energy.tobytes()))
        yield pd.DataFrame({"video_id": [key[0]], "tile": [key[1]], "h": [pdf.h.iloc[0]], "w": [pdf.w.iloc[0]], "frame": [frame], "energy": [energy.tobytes()]})

    return dense.tiles(frames, tile).groupBy("video_id", "tile").applyInPandasWithState(step, "video_id string, tile int, h int, w int, frame long, energy binary", "frame long, last binary, energy binary", "update", GroupStateTimeout.NoTimeout)


def whole_heat(tiles: DataFrame) -> DataFrame:
    """Images (video_id, h, w, energy) of the last state of each tile that a stream gave."""
    last = tiles.groupBy("video_id", "tile").agg(F.max_by(F.struct("h", "w", "energy"), "frame").alias("t"))
    parts = last.groupBy("video_id").agg(F.sort_array(F.collect_list(F.struct("tile", "t"))).alias("p"))
    joined = F.unhex(F.array_join(F.transform("p", lambda p: F.hex(p["t"]["energy"])), ""))  # one image of a video
    return parts.select("video_id", F.col("p")[0]["t"]["h"].alias("h"), F.col("p")[0]["t"]["w"].alias("w"), joined.alias("energy"))


def motion_heat_stream(frames: DataFrame, threshold: float = 0.0) -> DataFrame:
    """Sum of each pixel's changes above a threshold on a stream of (video_id, frame,
    x, y, v): video_id, x, y, frame (the last), energy, at each batch. The state of a
    pixel is its last value and its sum; late frames are dropped."""

    def step(key: tuple, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, value, energy = state.get if state.exists else (-1, None, 0.0)
        pdf = pd.concat(list(pdfs)).sort_values("frame")
        for f, v in zip(pdf.frame, pdf.v):
            if f <= last:
                continue
            change = abs(v - value) if value is not None else 0.0
            energy += change if change > threshold else 0.0
            last, value = int(f), float(v)
        state.update((last, value, float(energy)))
        yield pd.DataFrame([(*key, last, float(energy))], columns=["video_id", "x", "y", "frame", "energy"])

    return frames.groupBy("video_id", "x", "y").applyInPandasWithState(step, "video_id string, x int, y int, frame long, energy double", "frame long, v double, energy double", "update", GroupStateTimeout.NoTimeout)


class Progress(StreamingQueryListener):
    """Listener that keeps, for each batch of any query, its rows and times by phase."""

    def __init__(self):
        self.batches: list[dict] = []

    def onQueryStarted(self, event) -> None:  # noqa: N802
        pass

    def onQueryProgress(self, event) -> None:  # noqa: N802
        p = event.progress
        self.batches.append({"name": p.name, "batch": p.batchId, "rows": p.numInputRows, **{f"{k}_ms": v for k, v in p.durationMs.items()}})

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        pass


def counts_stream(events: DataFrame, delay: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Events (ts, event_type) by tumbling window and type; ts without zone is taken as UTC."""
    e = events.withColumn("ts", F.col("ts").cast("timestamp"))
    return e.withWatermark("ts", delay).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"))
