"""An approximate index of vectors: navigable graphs over parts of the rows, searched by beams.

Rows are dealt by a hash of their ids into graphs of a bounded size, each built in one task: vectors are put in one after
the other, and each is linked both ways to the nearest of those before it, so early links are long and late ones short.
Every row is in exactly one graph. A search passes all queries by each graph, whose vertices are opened from the entry on
in the order of their nearness until none of a beam's best has links left to follow; the best of all graphs are merged.
The index is a table of one row a graph, written and read like others.

Rows without a vector take no part (see vectors.unit_vectors); an empty base makes an index without graphs, in which
nothing is found.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from frameloom.operators.tiles import column, meet
from frameloom.operators.vectors import HITS, best_hits, dealt, hits_of, joined, matrix, to_all

#: Vectors of a graph, links that a vector is put in with, and links that it keeps at most.
GRAPH, LINKS, KEPT = 8192, 24, 64
INDEX = "tile long, n int, ids binary, vectors binary, links binary"


def linked(v: np.ndarray, links: int = LINKS, kept: int = KEPT) -> np.ndarray:
    """For each vector the places of those that it is linked to, -1 where there are fewer than `kept`.

    A vector that has more links than it may keep drops the farthest, but never its own to what was there before it, so
    all stay within reach of later ones.
    """
    n = len(v)
    ahead = np.full((n, min(links, kept)), -1, np.int32)
    sims = np.full(ahead.shape, -np.inf)
    step = max(1, (1 << 22) // max(1, n))
    for a in range(0, n, step):
        b = min(n, a + step)
        block = v[a:b] @ v[:b].T
        block[np.arange(b)[None, :] >= np.arange(a, b)[:, None]] = -np.inf
        some = min(ahead.shape[1], b)
        best = np.argpartition(-block, some - 1, axis=1)[:, :some]
        scores = np.take_along_axis(block, best, axis=1)
        ahead[a:b, :some], sims[a:b, :some] = np.where(np.isfinite(scores), best, -1), scores
    out = np.full((n, kept), -1, np.int32)
    out[:, : ahead.shape[1]] = ahead
    # links back, the nearest first, as long as there is room
    i, place = np.nonzero(ahead >= 0)
    to, near = ahead[i, place], sims[i, place]
    order = np.lexsort((i, -near, to))
    to, back = to[order], i[order]
    nth = np.arange(len(to)) - np.searchsorted(to, to)
    used = (ahead >= 0).sum(axis=1)
    fits = used[to] + nth < kept
    # own links fill the first places, in the order of the table
    packed = np.take_along_axis(out, np.argsort(out < 0, axis=1, kind="stable"), axis=1)
    packed[to[fits], used[to[fits]] + nth[fits]] = back[fits]
    return packed


def beam_search(v: np.ndarray, links: np.ndarray, q: np.ndarray, beam: int, at_once: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """Places and cosines of the beam's vectors for each query, the best first; -1 where a graph has fewer. All queries
    open so many vertices at a time, and compare only with what they have not seen."""
    m, n = len(q), len(v)
    width = min(beam, n)
    some = min(at_once, width)
    seen = np.zeros((m, n + 1), bool)
    # entries: the first vector, from where links are long, and a few more
    entry = np.unique(np.linspace(0, n - 1, min(8, width)).astype(int))
    at = np.full((m, width), -1)
    sims = np.full((m, width), -np.inf)
    at[:, : len(entry)], sims[:, : len(entry)] = entry, q @ v[entry].T
    seen[:, entry] = seen[:, n] = True
    opened = np.zeros((m, width), bool)
    mark = np.empty((m, n), np.int32)
    live = np.arange(m)
    while len(live):
        open_sims = np.where(opened[live] | (at[live] < 0), -np.inf, sims[live])
        best = np.argpartition(-open_sims, some - 1, axis=1)[:, :some]
        real = np.isfinite(np.take_along_axis(open_sims, best, axis=1))
        left = real.any(axis=1)
        live, best, real = live[left], best[left], real[left]
        if not len(live):
            break
        rows = live[:, None]
        opened[rows, best] |= real
        near = links[np.maximum(at[rows, best], 0)]
        near = np.where((near < 0) | ~real[:, :, None], n, near).reshape(len(live), -1)
        i, j = np.nonzero(~seen[rows, near])
        to = near[i, j]
        # one of what several vertices are linked to
        mark[live[i], to] = np.arange(len(i))
        pick = mark[live[i], to] == np.arange(len(i))
        i, to = i[pick], to[pick]
        seen[live[i], to] = True
        # new ones side by side, as many places as the query with the most needs
        nth = np.arange(len(i)) - np.searchsorted(i, i)
        room = int(nth.max()) + 1 if len(i) else 0
        places = np.full((len(live), room), -1)
        places[i, nth] = to
        found = np.where(places >= 0, np.matmul(v[places], q[live, :, None])[:, :, 0], -np.inf)
        all_sims = np.concatenate([sims[live], found], axis=1)
        keep = np.argpartition(-all_sims, width - 1, axis=1)[:, :width]
        all_at, all_open = np.concatenate([at[live], places], axis=1), np.concatenate([opened[live], np.zeros(found.shape, bool)], axis=1)
        sims[live] = np.take_along_axis(all_sims, keep, axis=1)
        at[live] = np.where(np.isfinite(sims[live]), np.take_along_axis(all_at, keep, axis=1), -1)
        opened[live] = np.take_along_axis(all_open, keep, axis=1)
    order = np.argsort(-sims, axis=1, kind="stable")
    return np.take_along_axis(at, order, axis=1), np.take_along_axis(sims, order, axis=1)


def build(base: DataFrame, size: int = GRAPH, links: int = LINKS, kept: int = KEPT) -> DataFrame:
    """The index of base (id, v): one row a graph, of about `size` vectors."""
    own, _ = dealt(base.select("id", "v"), size)

    def graph(table: pa.Table) -> pa.Table:
        ids, v = column(table, "id").to_numpy(), matrix(table.column("v"))
        return pa.table({"tile": table.column("tile").slice(0, 1), "n": pa.array([len(ids)], pa.int32()), "ids": [ids.tobytes()], "vectors": [v.tobytes()], "links": [linked(v, links, kept).tobytes()]})

    return own.groupBy("tile").applyInArrow(graph, INDEX)


def write(index: DataFrame, path: str) -> None:
    index.write.mode("overwrite").parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(INDEX).parquet(path)


def search(index: DataFrame, queries: DataFrame, k: int, beam: int = 128, exclude_self: bool = True) -> DataFrame:
    """query_id, id, sim and rank of the k nearest that are found for each query (id, v), by default but for itself."""

    def load(table: pa.Table) -> tuple:
        n = column(table, "n")[0].as_py()
        whole = lambda name, kind: np.frombuffer(column(table, name)[0].as_py(), kind).reshape(n, -1)
        return (whole("ids", np.int64)[:, 0], whole("vectors", np.float64), whole("links", np.int32)), None

    def answer(state: tuple, batch: pa.RecordBatch) -> pa.RecordBatch:
        ids, v, links = state
        parts = []
        q_ids, q = column(batch, "id").to_numpy(), matrix(column(batch, "v"))
        for a in range(0, len(q), 256):
            at, sims = beam_search(v, links, q[a : a + 256], max(beam, k + 1))
            found = np.where(at >= 0, ids[at], -1)
            if exclude_self:
                sims = np.where(found == q_ids[a : a + 256, None], -np.inf, sims)
            order = np.lexsort((found, -sims), axis=1)[:, :k]
            parts.append(hits_of(q_ids[a : a + 256], np.take_along_axis(found, order, axis=1), np.take_along_axis(sims, order, axis=1)))
        return joined(parts)

    tiles = index.agg(F.coalesce(F.max("tile") + 1, F.lit(0))).first()[0]
    if not tiles:
        return index.sparkSession.createDataFrame([], f"{HITS}, rank int")
    return best_hits(meet(index, to_all(queries.select("id", "v"), int(tiles)), load, answer, HITS), k)
