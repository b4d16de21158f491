"""The background of a fixed camera, as weighted Gaussians of each pixel's grey value that are born, fade and die online.

After the adaptive mixture of Zivkovic and van der Heijden (2006): a value that is near one of a pixel's components moves
it; else it makes a new one in the place of the weakest. What the heaviest components cover, up to a share of the
weight, is background; a darker shade of one of these is shadow and no foreground. So a background that flickers between
values is learned as several components. A frame has any number of pixels, the same in all frames of a clip; one of another
size begins anew. Null frames leave the model as it is and have a null share.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from frameloom.operators.tiles import column


@dataclass(frozen=True)
class MixtureConfig:
    """The method's usual settings."""

    components: int = 5
    history: int = 500
    near: float = 16.0
    near_new: float = 9.0
    share: float = 0.9
    first_variance: float = 15.0
    variances: tuple[float, float] = (4.0, 75.0)
    prior: float = 0.05
    darkest: float = 0.5


class Mixture:
    """Components of all pixels, the heaviest first: weights (0 where there is none), means and variances."""

    def __init__(self, pixels: int, config: MixtureConfig | None = None):
        self.config = config or MixtureConfig()
        self.frames = 0
        self.w, self.m, self.v = (np.zeros((self.config.components, pixels)) for _ in range(3))

    def packed(self) -> bytes:
        return np.concatenate([[self.frames], self.w.ravel(), self.m.ravel(), self.v.ravel()]).tobytes()

    @classmethod
    def unpacked(cls, blob: bytes, config: MixtureConfig | None = None) -> Mixture:
        flat = np.frombuffer(blob)
        out = cls((len(flat) - 1) // (3 * (config or MixtureConfig()).components), config)
        out.frames = int(flat[0])
        out.w, out.m, out.v = (part.reshape(out.w.shape).copy() for part in np.split(flat[1:], 3))
        return out

    def _sort(self) -> None:
        order = np.argsort(-self.w, axis=0, kind="stable")
        self.w, self.m, self.v = (np.take_along_axis(a, order, axis=0) for a in (self.w, self.m, self.v))

    def foreground(self, x: np.ndarray) -> np.ndarray:
        """Which pixels of the next frame are foreground; the model learns from it."""
        c = self.config
        self.frames += 1
        rate = 1 / min(2 * self.frames, c.history)
        there = self.w > 0
        far = (x - self.m) ** 2
        ahead = np.cumsum(self.w, axis=0) - self.w
        back = there & (ahead < c.share)
        known = (back & (far < c.near * self.v)).any(axis=0)
        shade = self._shaded(x, back)
        fits = there & (far < c.near_new * self.v)
        first = fits & (np.cumsum(fits, axis=0) == 1)
        # all fade, and the one that fits is fed; what has faded below what it owes to the prior dies
        self.w = np.where(there, (1 - rate) * self.w - rate * c.prior, 0) + np.where(first, rate, 0)
        dead = there & ~first & (self.w < rate * c.prior)
        self.w = np.where(dead, 0, self.w)
        step = np.where(first, rate / np.where(first, self.w, 1), 0)
        off = x - self.m
        self.m = self.m + step * off
        self.v = np.where(first, np.clip(self.v + step * (far - self.v), *c.variances), self.v)
        total = self.w.sum(axis=0)
        self.w = np.where(total > 0, self.w / np.where(total > 0, total, 1), 0)
        self._sort()
        # a value that fits none begins a component in the last place
        new = ~fits.any(axis=0)
        alone = new & (self.w[0] == 0)
        self.w[:, new] *= 1 - rate
        at = np.where(alone, 0, np.minimum((self.w > 0).sum(axis=0), c.components - 1))
        self.w[at[new], np.flatnonzero(new)] = np.where(alone[new], 1, rate)
        self.m[at[new], np.flatnonzero(new)] = x[new]
        self.v[at[new], np.flatnonzero(new)] = c.first_variance
        total = self.w.sum(axis=0)
        self.w = self.w / np.where(total > 0, total, 1)
        self._sort()
        return ~known & ~shade

    def _shaded(self, x: np.ndarray, back: np.ndarray) -> np.ndarray:
        """Pixels that are a background component made darker by a factor."""
        factor = x / np.where(self.m > 0, self.m, 1)
        fit = (factor <= 1) & (factor >= self.config.darkest) & ((factor * self.m - x) ** 2 < self.config.near * self.v * factor**2)
        return (back & (self.m > 0) & fit).any(axis=0)


def share_of(held: Mixture | None, pixels: np.ndarray | None, config: MixtureConfig | None = None) -> tuple[Mixture | None, float | None]:
    """The model after a frame, and the share of its pixels that are foreground."""
    if pixels is None:
        return held, None
    if held is None or held.w.shape[1] != len(pixels):
        held = Mixture(len(pixels), config)
    return held, round(float(held.foreground(np.asarray(pixels, float)).mean()), 4) if len(pixels) else 0.0


def foreground(df: DataFrame, pixels: str, config: MixtureConfig | None = None) -> DataFrame:
    """clip, frame_idx and share of pixels (an array of grey values) that are foreground, frame by frame in order. Clips are
    dealt by hash; a task holds one model and the frames of a batch at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        clip, held = None, None
        for batch in batches:
            shares = []
            for c, values in zip(column(batch, "clip").to_pylist(), column(batch, "pixels")):
                held = held if c == clip else None
                clip = c
                held, share = share_of(held, values.values.to_numpy(zero_copy_only=False) if values.is_valid else None, config)
                shares.append(share)
            yield pa.RecordBatch.from_arrays([column(batch, "clip"), column(batch, "frame_idx"), pa.array(shares, pa.float64())], names=["clip", "frame_idx", "share"])

    rows = df.select("clip", "frame_idx", F.col(pixels).cast("array<double>").alias("pixels")).dropna(subset=["clip", "frame_idx"])
    return rows.repartition("clip").sortWithinPartitions("clip", "frame_idx").mapInArrow(run, "clip long, frame_idx long, share double")
