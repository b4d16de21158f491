"""Tracking by detection: a constant-velocity Kalman filter and two rounds of optimal IoU assignment.

A video is sequential: in batch a task takes its videos' frames side by side, the next of each at a time, and a stream
has a state for each. Frames without detections must be fed too, as tracks age by frame. Null scores count as 1. Of assignments that cost the same, the solver's first is taken.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from frameloom.config import TrackerConfig
from frameloom.operators.groups import changes
from frameloom.operators.tiles import column

KEYS = ["video_id", "frame_idx"]


def overlaps(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Intersection over union of boxes, each with the one in its place."""
    both = np.maximum(np.minimum(a[..., 2], b[..., 2]) - np.maximum(a[..., 0], b[..., 0]), 0) * np.maximum(np.minimum(a[..., 3], b[..., 3]) - np.maximum(a[..., 1], b[..., 1]), 0)
    size = lambda x: (x[..., 2] - x[..., 0]) * (x[..., 3] - x[..., 1])
    return np.where(both > 0, both / (size(a) + size(b) - both + 1e-12), 0.0)


def pairwise_iou(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return overlaps(a[:, None], b[None, :])


def assignment(cost: np.ndarray) -> list[tuple[int, int]]:
    """Pairs of rows and columns of least total cost, by shortest augmenting paths."""
    if not cost.size:
        return []
    turned = cost.shape[0] > cost.shape[1]
    c = cost.T if turned else cost
    owner = _owners(c) if c.size > SMALL else _few_owners(c.tolist())
    pairs = [(int(r), k) for k, r in enumerate(owner) if r >= 0]
    return sorted((k, r) if turned else (r, k) for r, k in pairs)


#: Costs up to which arrays take longer than lists.
SMALL = 512


def _few_owners(c: list[list[float]]) -> list[int]:
    """_owners of few costs: the same steps on lists."""
    n, m = len(c), len(c[0])
    row_price, col_price = [0.0] * n, [0.0] * m
    owner = [-1] * m
    for start in range(n):
        reach, via = [np.inf] * m, [-1] * m
        left, done = list(range(m)), []
        row, base, last = start, 0.0, -1
        while True:
            own, price, best, col = c[row], row_price[row], np.inf, left[0]
            for x in left:
                step = base + own[x] - price - col_price[x]
                if step < reach[x] - 1e-15:
                    reach[x], via[x] = step, last
                if reach[x] < best:
                    best, col = reach[x], x
            base, last = reach[col], col
            if owner[col] < 0:
                break
            left.remove(col)
            done.append(col)
            row = owner[col]
        for col in done:
            row_price[owner[col]] += base - reach[col]
            col_price[col] -= base - reach[col]
        row_price[start] += base
        col = last
        while col >= 0:
            owner[col] = start if via[col] < 0 else owner[via[col]]
            col = via[col]
    return owner


def _owners(c: np.ndarray) -> np.ndarray:
    """The row of each column, or -1; there are at least as many columns."""
    n, m = c.shape
    row_price, col_price = np.zeros(n), np.zeros(m)
    owner = np.full(m, -1)
    for start in range(n):
        reach, via = np.full(m, np.inf), np.full(m, -1)
        done = np.zeros(m, bool)
        row, base, last = start, 0.0, -1
        while True:
            step = base + c[row] - row_price[row] - col_price
            better = ~done & (step < reach - 1e-15)
            reach[better], via[better] = step[better], last
            col = int(np.where(done, np.inf, reach).argmin())
            base, done[col] = float(reach[col]), True
            last = col
            if owner[col] < 0:
                break
            row = int(owner[col])
        for col in np.flatnonzero(done).tolist():
            if col != last:
                row_price[owner[col]] += base - reach[col]
            col_price[col] -= base - reach[col]
        row_price[start] += base
        col = last
        while col >= 0:
            owner[col] = start if via[col] < 0 else owner[via[col]]
            col = int(via[col])
    return owner


def places(label: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The place of each x among the different ones of its label, in order, and how many each label has; an x has one label."""
    own = np.full(x.max() + 1, -1)
    own[x] = label
    values = np.flatnonzero(own >= 0)
    values = values[np.argsort(own[values], kind="stable")]
    sizes = np.bincount(own[values])
    place = np.empty(len(own), np.int64)
    place[values] = np.arange(len(values)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    return place[x], sizes


def matched(rows: np.ndarray, cols: np.ndarray, share: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of the assignment with the greatest total overlap, of pairs (row, column, overlap) that overlap by
    `least`. What doesn't overlap at all adds nothing, so only pairs that do are given, and groups of boxes that overlap one
    another are solved on their own."""
    if not len(rows):
        return rows, cols
    alone = (np.bincount(rows)[rows] == 1) & (np.bincount(cols)[cols] == 1)
    good = alone & (1 - share <= 1 - least)
    found = [(rows[good], cols[good])]
    rows, cols, share = rows[~alone], cols[~alone], share[~alone]
    if len(rows):
        near = np.arange(cols.max() + 1)
        while True:
            by_row = np.full(rows.max() + 1, len(near))
            np.minimum.at(by_row, rows, near[cols])
            after = near.copy()
            np.minimum.at(after, cols, by_row[rows])
            if (after == near).all():
                break
            near = after
        there = np.zeros(len(near), np.int64)
        there[near[cols]] = 1
        group = (np.cumsum(there) - 1)[near[cols]]
        (i, n), (j, m) = places(group, rows), places(group, cols)
        turned = n > m
        i, j = np.where(turned[group], j, i), np.where(turned[group], i, j)
        n, m = np.minimum(n, m), np.maximum(n, m)
        # where the first of the least costs of each row is another row's nowhere, a solver takes these
        cost = 1 - share
        key = group * n.max() + i
        order = np.lexsort((j, cost, key))
        first = order[np.append(True, np.diff(key[order]) != 0)]
        spot = group[first] * m.max() + j[first]
        clash = np.bincount(spot)[spot] > 1
        hard = np.zeros(len(n), bool)
        hard[group[first[clash]]] = True
        won = [first[~hard[group[first]]]]
        at = np.argsort(group, kind="stable")
        edge = np.append(0, np.cumsum(np.bincount(group)))
        for g in np.flatnonzero(hard).tolist():
            p = at[edge[g] : edge[g + 1]]
            square = np.ones((n[g], m[g]))
            square[i[p], j[p]] = cost[p]
            pick = np.full(n[g], -1)
            for r, c in assignment(square):
                pick[r] = c
            won.append(p[pick[i[p]] == j[p]])
        won = np.concatenate(won)
        won = won[cost[won] <= 1 - least]
        found.append((rows[won], cols[won]))
    return tuple(map(np.concatenate, zip(*found)))


#: Variances of what is seen (middle, area, shape), of new tracks, and of what a frame adds; speeds' after places'.
SEEN, NEW, MOVED = np.array([1.0, 1, 10, 10]), (10.0, 10_000.0), (np.ones(4), np.array([0.01, 0.01, 0.0001]))


class Tracker:
    """State of one video, or of several that are numbered from 0: their tracks as arrays, a row each.

    A track's middle, area and shape (place) are filtered on their own, the first three with a speed, as neither motion nor
    noise couples them: for each a variance of place and speed and their covariance. Frames and tracks made are counted by
    video.
    """

    FIELDS = ("place", "speed", "place_var", "cov", "speed_var", "number", "hits", "unseen", "confirmed", "video")

    def __init__(self, config: TrackerConfig, videos: int = 1):
        self.config, self.frames, self.made = config, np.zeros(videos, np.int64), np.zeros(videos, np.int64)
        self.place, self.place_var = np.zeros((0, 4)), np.zeros((0, 4))
        self.speed, self.cov, self.speed_var = (np.zeros((0, 3)) for _ in range(3))
        self.number, self.hits, self.unseen, self.video = (np.zeros(0, np.int64) for _ in range(4))
        self.confirmed = np.zeros(0, bool)

    def more(self, videos: int) -> None:
        """Makes room for so many videos in all."""
        new = np.zeros(max(0, videos - len(self.frames)), np.int64)
        self.frames, self.made = np.append(self.frames, new), np.append(self.made, new)

    def boxes(self) -> np.ndarray:
        area, shape = np.maximum(self.place[:, 2], 1e-6), np.maximum(self.place[:, 3], 1e-6)
        half = np.column_stack([w := np.sqrt(area * shape), area / w]) / 2
        return np.hstack([self.place[:, :2] - half, self.place[:, :2] + half])

    def predict(self, t: np.ndarray | slice) -> None:
        speed, var = self.speed[t], self.speed_var[t]
        speed[self.place[t, 2] + speed[:, 2] <= 0, 2] = 0.0
        self.speed[t] = speed
        self.place[t, :3] += speed
        self.place_var[t, :3] += 2 * self.cov[t] + var
        self.place_var[t] += MOVED[0]
        self.cov[t] += var
        self.speed_var[t] += MOVED[1]
        self.hits[t] = np.where(self.unseen[t] > 0, 0, self.hits[t])
        self.unseen[t] += 1

    def see(self, t: np.ndarray, boxes: np.ndarray) -> None:
        """Corrects tracks by the boxes that they have now."""
        gain = self.place_var[t] / (self.place_var[t] + SEEN)
        pull = self.cov[t] / (self.place_var[t] + SEEN)[:, :3]
        off = measured(boxes) - self.place[t]
        self.place[t] += gain * off
        self.speed[t] += pull * off[:, :3]
        self.speed_var[t] -= pull * self.cov[t]
        self.cov[t] *= 1 - gain[:, :3]
        self.place_var[t] *= 1 - gain
        self.unseen[t], self.hits[t] = 0, self.hits[t] + 1

    def add(self, boxes: np.ndarray, video: np.ndarray) -> None:
        n = len(boxes)
        if not n:
            return
        # boxes come by video
        nth = np.arange(n) - np.searchsorted(video, video)
        new = (measured(boxes), np.zeros((n, 3)), np.full((n, 4), NEW[0]), np.zeros((n, 3)), np.full((n, 3), NEW[1]), self.made[video] + 1 + nth, np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, bool), video)
        for name, rows in zip(self.FIELDS, new):
            setattr(self, name, np.concatenate((getattr(self, name), rows)))
        self.made += np.bincount(video, minlength=len(self.made))

    def frame(self, boxes: np.ndarray, scores: np.ndarray, video: np.ndarray | None = None, fed: np.ndarray | None = None) -> np.ndarray:
        """Track of each detection, or -1, of the next frame: of one video, or of each of those that are fed (a boolean by
        video), with detections in their order. Sure detections choose first, unsure ones among the tracks that are left;
        sure ones without a track begin one."""
        c = self.config
        video = np.zeros(len(boxes), np.int64) if video is None else video
        every = fed is None or fed.all()
        self.frames[slice(None) if every else fed] += 1
        self.predict(slice(None) if every else np.flatnonzero(fed[self.video]))
        known = self.boxes()
        owner = np.full(len(boxes), -1)
        left = np.ones(len(known), bool)
        for part in (np.flatnonzero(scores >= c.high), np.flatnonzero((scores >= c.low) & (scores < c.high))):
            tracks = np.flatnonzero(left)
            if len(part) and len(tracks):
                tracks = tracks[np.argsort(self.video[tracks], kind="stable")]
                begin, end = (np.searchsorted(self.video[tracks], video[part], where) for where in ("left", "right"))
                n = end - begin
                d = np.repeat(part, n)
                t = tracks[np.arange(len(d)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(begin, n)]
                share = overlaps(known[t], boxes[d])
                near = share > 0
                t, d = matched(t[near], d[near], share[near], c.match)
                owner[d], left[t] = t, False
        fresh = np.flatnonzero((scores >= c.high) & (owner < 0))
        owner[fresh] = len(known) + np.arange(len(fresh))
        self.add(boxes[fresh], video[fresh])
        seen = np.flatnonzero(owner >= 0)
        at = owner[seen]
        self.see(at, boxes[seen])
        self.confirmed[at] |= (self.hits[at] >= c.min_hits) | (self.frames[video[seen]] <= c.min_hits)
        out = np.full(len(boxes), -1, np.int64)
        out[seen] = np.where(self.confirmed[at], self.number[at], -1)
        keep = self.unseen <= c.max_age
        if not keep.all():
            for name in self.FIELDS:
                setattr(self, name, getattr(self, name)[keep])
        return out


def measured(b: np.ndarray) -> np.ndarray:
    """Middle, area and shape of boxes."""
    w, h = b[:, 2] - b[:, 0], b[:, 3] - b[:, 1]
    return np.column_stack([b[:, 0] + w / 2, b[:, 1] + h / 2, w * h, np.where(h <= 1e-9, 0.0, w / np.where(h <= 1e-9, 1.0, h))])


def track(detections: DataFrame, frames: DataFrame, config: TrackerConfig | None = None) -> DataFrame:
    """video_id, frame_idx, pos and track_id of detections (video_id, frame_idx, pos, x1..y2, confidence); frames
    (video_id, frame_idx) lists all frames, with detections or not. Frames stream by, in order, and what is held are
    tracks."""
    config = config or TrackerConfig()

    def work(held: Tracker, slots: dict[int, int], table: pa.Table) -> pa.RecordBatch:
        """Tracks of whole frames: of each video the first, then the second of each, and so on."""
        numbers = lambda c: column(table, c).to_numpy(zero_copy_only=False)
        begin = np.append(0, changes(table, KEYS))
        group = np.repeat(np.arange(len(begin)), np.diff(np.append(begin, len(table))))
        slot = np.array([slots.setdefault(v, len(slots)) for v in column(table, "video_id").take(pa.array(begin)).to_pylist()], np.int64)
        held.more(len(slots))
        order = np.argsort(slot, kind="stable")
        turn = np.empty(len(slot), np.int64)
        turn[order] = np.arange(len(slot)) - np.searchsorted(slot[order], slot[order])
        boxes, scores = np.column_stack([numbers(c) for c in ("x1", "y1", "x2", "y2")]).astype(float), numbers("confidence").astype(float)
        scores = np.where(np.isnan(scores), 1.0, scores)
        real, ids = column(table, "pos").is_valid().to_numpy(zero_copy_only=False), np.full(len(table), -1, np.int64)
        rows = np.lexsort((slot[group], turn[group]))
        for r in np.split(rows, np.flatnonzero(np.diff(turn[group[rows]])) + 1):
            fed = np.zeros(len(held.frames), bool)
            fed[slot[group[r]]] = True
            r = r[real[r]]
            ids[r] = held.frame(boxes[r], scores[r], slot[group[r]], fed)
        out = table.select(["video_id", "frame_idx", "pos"]).append_column("track_id", pa.array(ids)).filter(pa.array(real))
        return out.cast(pa.schema([(c, pa.int64()) for c in out.column_names])).combine_chunks()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, slots, rest = Tracker(config, 0), {}, None
        for batch in batches:
            table = pa.Table.from_batches([batch] if rest is None else [*rest.to_batches(), batch])
            # the last frame may go on in the next batch
            last = int(np.append(0, changes(table, KEYS))[-1])
            if last:
                yield from work(held, slots, table.slice(0, last)).to_batches()
            rest = table.slice(last)
        if rest is not None and len(rest):
            yield from work(held, slots, rest).to_batches()

    rows = frames.select(*KEYS).distinct().dropna().join(detections, KEYS, "left").select(*KEYS, "pos", "x1", "y1", "x2", "y2", "confidence")
    # videos side by side in a task cost much less than one after the other, so there are no more parts than tasks at a time
    parts = rows.repartition(rows.sparkSession.sparkContext.defaultParallelism, "video_id").sortWithinPartitions("frame_idx", "video_id", "pos")
    return parts.mapInArrow(run, "video_id long, frame_idx long, pos long, track_id long")
