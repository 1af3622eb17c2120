"""Operators along time on streams, with state: interpolation with a bounded delay, and smoothing with a fixed lag.

Rows of a key may come late and out of order. They are held until the watermark has passed them
and then taken in order of frames, so results don't depend on how rows are cut into batches, nor on
restarts. State is what is held, and a bounded number of frames beyond it; a key without
rows for `idle` goes, and what it still owes comes out then.
"""

import json
from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from herdframe.operators.permutations import all_permutations
from herdframe.operators.tree import step_scores
from herdframe.schemas import SERIES


class Steps(Protocol):
    """What a key's rows go through, in order. Its memory is plain lists and numbers, as it is kept as JSON."""

    def begin(self) -> dict: ...

    def take(self, memory: dict, row: list) -> list[tuple]:
        """Output rows once this row [frame, ...] is known."""
        ...

    def end(self, memory: dict) -> list[tuple]:
        """What is still owed when no row comes any more."""
        ...


def in_order(rows: DataFrame, keys: list[str], columns: list[str], steps: Steps, output: str, time: str = "ts", late: str = "10 seconds", idle: int = 60_000) -> DataFrame:
    """(keys, output) of a stream whose rows have a timestamp; the first of the columns numbers a key's rows. Rows later than the watermark are left out.

    `late` is the watermark's delay, `idle` the milliseconds of event time after which a key ends.
    """
    schema = ", ".join(f"{k} {rows.schema[k].dataType.simpleString()}" for k in keys)
    names = [c.strip().split()[0] for c in output.split(",")]

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held, memory, last = json.loads(state.get[0]) if state.exists else ([], steps.begin(), 0)
        if not state.hasTimedOut:
            for batch in batches:
                times = (batch[time].astype("int64") // 10**6 if batch[time].dtype == "datetime64[ns]" else batch[time].astype("datetime64[ms]").astype("int64")).tolist()
                held += [[t, *map(_plain, r)] for t, r in zip(times, batch[columns].itertuples(index=False), strict=True)]
        mark = state.getCurrentWatermarkMs()
        ready = sorted((r for r in held if r[0] <= mark), key=lambda r: r[1])
        held = [r for r in held if r[0] > mark]
        out = [o for r in ready for o in steps.take(memory, r[1:])]
        last = max([last, *(r[0] for r in ready)])
        if state.hasTimedOut and not held and last + idle <= mark:
            out += steps.end(memory)
            state.remove()
        else:
            state.update((json.dumps([held, memory, last]),))
            state.setTimeoutTimestamp(max(mark + 1, min((r[0] for r in held), default=last + idle)))
        if out:
            yield pd.DataFrame([(*key, *o) for o in out], columns=[*keys, *names])

    stamped = rows.withWatermark(time, late).select(*keys, *columns, time)
    return stamped.groupBy(*keys).applyInPandasWithState(run, f"{schema}, {output}", "state string", "append", GroupStateTimeout.EventTimeTimeout)


def _plain(v):  # noqa: ANN001, ANN202
    if isinstance(v, np.ndarray):
        return v.tolist()
    return None if v is None or v != v else v.item() if hasattr(v, "item") else v


class Filling:
    """Linear interpolation between the points around a gap. A gap of over `most` frames isn't waited for: its frames stay where the last point was; before a first point they are NULL."""

    def __init__(self, most: int = 1000):
        self.most = most

    def begin(self) -> dict:
        return {"last": None, "open": []}

    def take(self, memory: dict, row: list) -> list[tuple]:
        frame, x, y = row
        last, open_ = memory["last"], memory["open"]
        if x is None or y is None:
            open_.append(frame)
            return [self._still(last, open_.pop(0))] if len(open_) > self.most else []
        out = []
        for f in open_:
            share = (f - last[0]) / (frame - last[0]) if last else 1.0
            a = last or (frame, x, y)
            out.append((f, *(float(p + (q - p) * share) for p, q in zip(a[1:], (x, y), strict=True))))
        memory["last"], memory["open"] = [frame, x, y], []
        return [*out, (frame, float(x), float(y))]

    @staticmethod
    def _still(last: list | None, frame: int) -> tuple:
        return (frame, *(map(float, last[1:]) if last else (None, None)))

    def end(self, memory: dict) -> list[tuple]:
        return [self._still(memory["last"], f) for f in memory["open"]]


def interpolate_stream(detections: DataFrame, most: int = 1000, time: str = "ts", late: str = "10 seconds", idle: int = 60_000) -> DataFrame:
    """(series, frame, x, y) of a stream of detections: what transforms.interpolate gives, as soon as the point after a gap is there."""
    return in_order(detections, SERIES, ["frame", "x", "y"], Filling(most), "frame long, x double, y double", time, late, idle)


class Smoothing:
    """Viterbi with a fixed lag: a frame's permutation is read off once `lag` more frames are there, along the path that is best by then."""

    def __init__(self, n: int, eta: float, lag: int):
        self.n, self.eta, self.lag, self.states = n, eta, lag, len(all_permutations(n))

    def begin(self) -> dict:
        return {"trellis": [0.0] * self.states, "frames": [], "back": []}

    def take(self, memory: dict, row: list) -> list[tuple]:
        frame, score, moves = row
        step = step_scores(np.array([score], float), np.array([moves or [0.0] * self.n**2], float), self.n, self.eta)[0]
        total = np.array(memory["trellis"])[:, None] + step
        memory["back"].append(total.argmax(0).tolist())
        memory["frames"].append(frame)
        best = total.max(0)
        memory["trellis"] = (best - best.max()).tolist()  # differences only, so numbers stay small
        if len(memory["frames"]) <= self.lag:
            return []
        out = (memory["frames"][0], self._path(memory)[0])
        memory["frames"], memory["back"] = memory["frames"][1:], memory["back"][1:]
        return [out]

    def _path(self, memory: dict) -> list[int]:
        state = int(np.argmax(memory["trellis"]))
        path = [state]
        for back in reversed(memory["back"][1:]):
            state = back[state]
            path.append(state)
        return path[::-1]

    def end(self, memory: dict) -> list[tuple]:
        return list(zip(memory["frames"], self._path(memory), strict=True)) if memory["frames"] else []


def smooth_stream(frames: DataFrame, n: int, eta: float = 10.0, lag: int = 100, time: str = "ts", late: str = "10 seconds", idle: int = 60_000) -> DataFrame:
    """(recording, camera, frame, p): permutations of a stream of frames (recording, camera, frame, score, moves), as tree.smooth_permutations finds them wherever the best paths have met within `lag` frames.

    score has a number for each permutation, moves the squared moves from each animal (row) to each one of the frame before, or NULL.
    """
    return in_order(frames, ["recording", "camera"], ["frame", "score", "moves"], Smoothing(n, eta, lag), "frame long, p long", time, late, idle)
