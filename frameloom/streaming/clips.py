"""Clips of a fixed number of frames, live sessions and live tracking with Structured Streaming."""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from frameloom.config import TrackerConfig
from frameloom.operators.tracking import Tracker

CLIP_FRAMES = 150


def chunked(df: DataFrame, key: str, order: Sequence[str], size: int = CLIP_FRAMES) -> DataFrame:
    """Rows of whole clips: each key's rows in order, so many a clip; a rest that fills none is dropped."""
    w = Window.partitionBy(key)
    rows = df.withColumn("seq", F.row_number().over(w.orderBy(*order)) - 1).withColumn("_n", F.count("*").over(w))
    size_ = F.lit(size)
    return rows.withColumn("clip", F.floor(F.col("seq") / size_)).where(F.col("clip") < F.floor(F.col("_n") / size_)).drop("_n")


def live_presence(obs: DataFrame, gap: str, late: str) -> DataFrame:
    """Runs of a stream of observations (track_id, ts), as sessions that end after a gap; late rows beyond the watermark
    are not counted."""
    sessions = obs.withWatermark("ts", late).groupBy("track_id", F.session_window("ts", gap).alias("s"))
    return sessions.agg(F.count("*").alias("n")).select("track_id", F.col("s.start").alias("started"), F.col("s.end").alias("ended"), "n")


def _pack(t: Tracker) -> str:
    return json.dumps({"frames": int(t.frames[0]), "made": int(t.made[0])} | {name: getattr(t, name).tolist() for name in t.FIELDS})


def _unpack(text: str, config: TrackerConfig) -> Tracker:
    held, t = json.loads(text), Tracker(config)
    t.frames, t.made = np.array([held["frames"]]), np.array([held["made"]])
    # a stream's state is of one video, which older states don't name
    held.setdefault("video", [0] * len(held["number"]))
    for name in t.FIELDS:
        own = getattr(t, name)
        setattr(t, name, np.array(held[name], own.dtype).reshape(-1, *own.shape[1:]))
    return t


def live_tracks(detections: DataFrame, config: TrackerConfig | None = None) -> DataFrame:
    """camera_id, frame_idx, pos and track_id of a stream of detections (camera_id, frame_idx, pos, x1..y2, confidence).

    The state of a camera is its tracks. Frames within a batch are put in order; a frame at or before the last one is
    late and gets no tracks, as time can't be turned back. A row with a null pos feeds a frame without detections.
    """
    config = config or TrackerConfig()

    def run(key: tuple[Any, ...], parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(parts), ignore_index=True)
        last, text = state.get if state.exists else (-1, None)
        tracker = _unpack(text, config) if text else Tracker(config)
        for frame, group in rows[rows["frame_idx"] > last].sort_values(["frame_idx", "pos"]).groupby("frame_idx", sort=True):
            real = group[group["pos"].notna()]
            ids = tracker.frame(real[["x1", "y1", "x2", "y2"]].to_numpy(float).reshape(-1, 4), real["confidence"].fillna(1.0).to_numpy(float))
            last = int(frame)
            yield pd.DataFrame({"camera_id": key[0], "frame_idx": last, "pos": real["pos"].astype("int64").to_numpy(), "track_id": ids})
        state.update((last, _pack(tracker)))

    return detections.groupBy("camera_id").applyInPandasWithState(run, "camera_id long, frame_idx long, pos long, track_id long", "last long, tracker string", "append", GroupStateTimeout.NoTimeout)
