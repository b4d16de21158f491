"""Streams with a state for each key: clips of a number of frames, galleries of people, backgrounds of cameras.

The states are Spark's (list and value state in its RocksDB store): they are part of the checkpoint, so a stream that is
started again goes on where it was, and no row is counted twice or lost. `prepared` sets the store for a session. Rows of
a micro-batch are put in order; a row that comes after later ones have been used counts when it comes.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from frameloom.operators.background import Mixture, MixtureConfig, share_of
from frameloom.operators.identity import Prototypes

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Frames a second where a camera says 0.
USUAL_FPS = 30


def prepared(spark: SparkSession) -> SparkSession:
    """The session with the state store that these streams need."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    return spark


def clip_size(seconds: float, fps: float) -> int:
    return int(seconds * (fps or USUAL_FPS))


class Clips(StatefulProcessor):
    """Holds a key's rows until they fill a clip; never more than a clip less one between batches."""

    def __init__(self, schema: StructType, order: Sequence[str], size: int):
        self.schema, self.order, self.size = schema, list(order), size

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.waiting = handle.getListState("waiting", self.schema)
        self.next = handle.getValueState("next", "clip long")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        names = self.schema.fieldNames()
        held = pd.DataFrame(list(self.waiting.get()), columns=names)
        new = pd.concat([r[names] for r in rows], ignore_index=True).sort_values(self.order, kind="stable")
        every = pd.concat([held, new], ignore_index=True) if len(held) else new.reset_index(drop=True)
        clip = self.next.get()[0] if self.next.exists() else 0
        full = len(every) // self.size
        if full:
            out = every.iloc[: full * self.size].copy()
            place = np.arange(len(out))
            yield out.assign(clip=clip + place // self.size, seq=clip * self.size + place)
            self.next.update((clip + full,))
        rest = every.iloc[full * self.size :]
        if len(rest):
            self.waiting.put([tuple(r) for r in rest.astype(object).where(rest.notna(), None).itertuples(index=False)])
        else:
            self.waiting.clear()

    def close(self) -> None:
        pass


def live_clips(frames: DataFrame, key: str, order: Sequence[str], size: int) -> DataFrame:
    """A stream's rows of whole clips, with clip and seq: each key's rows in order, `size` a clip. What fills no clip waits
    for more, however many batches that takes."""
    schema = StructType(list(frames.schema.fields))
    out = StructType(list(schema.fields)).add("clip", "long").add("seq", "long")
    prepared(frames.sparkSession)
    return frames.groupBy(key).transformWithStateInPandas(Clips(schema, order, size), out, "append", "none")


class Gallery(StatefulProcessor):
    """A gallery's prototypes in the order in which they were added."""

    PROTOTYPE = "person_id long, is_active boolean, v array<double>"

    def __init__(self, key: str, rules: dict[str, Any]):
        self.key, self.rules = key, rules

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.prototypes = handle.getListState("prototypes", self.PROTOTYPE)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        new = pd.concat(list(rows), ignore_index=True).sort_values("id", kind="stable")
        known = pd.DataFrame(list(self.prototypes.get()), columns=["person_id", "is_active", "v"])
        known["index_row"] = np.arange(len(known))
        held = Prototypes(known, len(new["v"].iloc[0]))
        before, out = held.used, []
        for i, v in zip(new["id"], new["v"]):
            out.append((key[0], i, *held.identified(np.asarray(v, float), **self.rules)))
        added = [(held.people[i], held.active[i], held.store[i].tolist()) for i in range(before, held.used)]
        if added:
            self.prototypes.appendList(added)
        yield pd.DataFrame(out, columns=[self.key, "id", "person_id", "outcome", "best_sim"]).astype({"person_id": "Int64", "best_sim": "Float64"})

    def close(self) -> None:
        pass


def live_people(vectors: DataFrame, *, t_accept: float, t_reject: float, gray_creates: bool, min_sim_add: float, most: int, key: str = "gallery_id", k: int = 10) -> DataFrame:
    """person_id and outcome of each vector of a stream (gallery_id, id, v), as identity.fold gives them: people that were
    made in earlier batches are known in later ones."""
    rules = {"t_accept": t_accept, "t_reject": t_reject, "gray_creates": gray_creates, "min_sim_add": min_sim_add, "most": most, "k": k}
    prepared(vectors.sparkSession)
    return vectors.select(key, "id", "v").groupBy(key).transformWithStateInPandas(Gallery(key, rules), f"{key} long, id long, person_id long, outcome string, best_sim double", "append", "none")


class Background(StatefulProcessor):
    """The model of a clip's or camera's background."""

    def __init__(self, config: MixtureConfig | None):
        self.config = config

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.model = handle.getValueState("model", "model binary")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        frames = pd.concat(list(rows), ignore_index=True).sort_values("frame_idx", kind="stable")
        held = Mixture.unpacked(self.model.get()[0], self.config) if self.model.exists() else None
        shares = []
        for values in frames["pixels"]:
            held, share = share_of(held, values, self.config)
            shares.append(share)
        if held is not None:
            self.model.update((held.packed(),))
        yield pd.DataFrame({"clip": key[0], "frame_idx": frames["frame_idx"], "share": pd.array(shares, "Float64")})

    def close(self) -> None:
        pass


def live_foreground(frames: DataFrame, config: MixtureConfig | None = None) -> DataFrame:
    """share of foreground of each frame of a stream (clip, frame_idx, pixels), as background.foreground gives it."""
    prepared(frames.sparkSession)
    return frames.select("clip", "frame_idx", "pixels").groupBy("clip").transformWithStateInPandas(Background(config), "clip long, frame_idx long, share double", "append", "none")
