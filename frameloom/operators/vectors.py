"""Search, neighbours, centroids and clusters of vectors.

Rows whose vector is null, of another size than the first of its table, or of no length take no part. Ids name vectors;
a repeated id counts as another vector. All scores are cosines of normalised vectors in double precision.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from frameloom.functions.vectors import norm, normalized
from frameloom.operators.tables import components, materialize
from frameloom.operators.tiles import column, meet

#: Vectors of a tile, and of the sample that a partition by pivots is planned on.
TILE, SAMPLE = 8192, 8192


def unit_vectors(df: DataFrame, key: str, column: str) -> DataFrame:
    return df.where(F.col(column).isNotNull() & (norm(F.col(column)) > 1e-9)).select(F.col(key).cast("long").alias("id"), normalized(F.col(column)).alias("v"))


def matrix(values: pa.Array) -> np.ndarray:
    values = values.combine_chunks() if isinstance(values, pa.ChunkedArray) else values
    flat = values.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(values), -1) if len(values) else np.zeros((0, 0))


def dealt(base: DataFrame, size: int) -> tuple[DataFrame, int]:
    """base in tiles of about so many rows by a hash of their ids, and how many tiles there are."""
    tiles = max(1, -(-base.count() // size))
    return base.withColumn("tile", F.pmod(F.xxhash64("id"), F.lit(tiles))), tiles


def to_all(rows: DataFrame, tiles: int) -> DataFrame:
    return rows.withColumn("tile", F.explode(F.sequence(F.lit(0), F.lit(tiles - 1)).cast("array<bigint>")))


HITS = "query_id long, id long, sim double"


def hits_of(q_ids: np.ndarray, ids: np.ndarray, sims: np.ndarray) -> pa.RecordBatch:
    """Rows of hits but for those without a finite score; ids and sims have a row for each query."""
    real = np.isfinite(sims)
    return pa.RecordBatch.from_arrays([pa.array(np.repeat(q_ids, real.sum(axis=1))), pa.array(ids[real]), pa.array(sims[real])], names=["query_id", "id", "sim"])


def best_places(sims: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of the k best of each row, in order; ties go by the columns' ids."""
    k = min(k, sims.shape[1])
    bar = np.partition(sims, sims.shape[1] - k, axis=1)[:, sims.shape[1] - k]
    i, j = np.nonzero(sims >= bar[:, None])
    order = np.lexsort((ids[j], -sims[i, j], i))
    i, j = i[order], j[order]
    first = np.arange(len(i)) - np.searchsorted(i, i) < k
    return i[first], j[first]


def joined(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
    """One batch of several of one kind."""
    full = [p for p in parts if p.num_rows]
    return pa.Table.from_batches(full).combine_chunks().to_batches()[0] if full else parts[0]


def best_hits(hits: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("sim"), "id")
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def knn(queries: DataFrame, base: DataFrame, k: int, exclude_self: bool = True) -> DataFrame:
    """query_id, id, sim and rank of the k nearest of base (id, v) for each query (id, v), by default but for itself; exact.

    Base is dealt into tiles of TILE vectors, each of which all queries pass; every tile keeps its k best of a query, and
    the best of these count. Ties go by id.
    """
    own, tiles = dealt(base, TILE)

    def load(table: pa.Table) -> tuple:
        return (column(table, "id").to_numpy(), matrix(table.column("v"))), None

    def answer(state: tuple, batch: pa.RecordBatch) -> pa.RecordBatch:
        ids, v = state
        q_ids, parts = column(batch, "id").to_numpy(), []
        q = matrix(column(batch, "v"))
        step = max(1, (1 << 22) // max(1, len(ids)))
        for a in range(0, len(q), step):
            sims = q[a : a + step] @ v.T
            if exclude_self:
                sims[q_ids[a : a + step, None] == ids[None, :]] = -np.inf
            i, j = best_places(sims, ids, k)
            real = np.isfinite(sims[i, j])
            parts.append(pa.RecordBatch.from_arrays([pa.array(q_ids[a + i[real]]), pa.array(ids[j[real]]), pa.array(sims[i[real], j[real]])], names=["query_id", "id", "sim"]))
        return joined(parts)

    return best_hits(meet(own.select("tile", "id", "v"), to_all(queries.select("id", "v"), tiles), load, answer, HITS), k)


@dataclass(frozen=True)
class Pivots:
    """Cells about pivots on the sphere: a vector is at home with the nearest pivot; lowest: the least cosine that a cell's
    vectors have with its pivot.

    What is within an angle of a vector and in another cell lies beyond the plane between the cells' pivots, so the vector
    is within that angle of the plane; and it is no farther from the other pivot than that angle and the cell's widest
    one. A vector is therefore a guest of the cells for which both hold, and of two such cells the one of the smaller
    number compares the two.
    """

    v: np.ndarray
    least: float
    lowest: np.ndarray | None = None

    def homes(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sims = v @ self.v.T
        home = sims.argmax(axis=1)
        return home, sims[np.arange(len(v)), home]

    def guests(self, v: np.ndarray, home: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of vectors, and cells of a smaller number than their own that may hold what is near them."""
        sims = v @ self.v.T
        angle = np.arccos(np.clip(self.least, -1, 1))
        apart = np.sqrt(np.maximum(2 - 2 * self.v @ self.v.T, 0))[home]
        ahead = sims[np.arange(len(v)), home][:, None] - sims
        # the sine of the angle to the plane; rounding must not part what is on the edge
        near = ahead <= apart * np.sin(min(angle, np.pi / 2)) + 1e-9
        near &= sims >= np.cos(np.minimum(angle + np.arccos(np.clip(self.lowest, -1, 1)), np.pi)) - 1e-9
        near &= np.arange(len(self.v))[None, :] < home[:, None]
        return np.nonzero(near)

    def within(self, v: np.ndarray) -> Pivots:
        """With the cells' widths as these vectors have them."""
        home, sims = self.homes(v)
        lowest = np.ones(len(self.v))
        np.minimum.at(lowest, home, sims)
        return replace(self, lowest=lowest)

    def cost(self, sample: np.ndarray, n: int, tile: int) -> float:
        """Rows to be dealt out for n vectors like the sample: homes, guests, and copies for cells of several tiles."""
        home = self.homes(sample)[0]
        guest = np.bincount(self.within(sample).guests(sample, home)[1], minlength=len(self.v))
        scale = n / len(sample)
        own = np.bincount(home, minlength=len(self.v)) * scale
        splits = np.maximum(1, np.ceil(own / tile))
        return float((own * (1 + (splits - 1) / 2) + guest * scale * splits).sum())


def planned(base: DataFrame, least: float, tile: int) -> Pivots:
    """The number of pivots that deals out the fewest rows, by a sample: many where vectors lie in dense places, one where
    all are as far apart as `least` reaches. Any number gives the same pairs. Only the sample, of SAMPLE vectors at most,
    and a number for each pivot reach the driver."""
    n = base.count()
    rows = [r["v"] for r in base.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).collect()]
    sample = np.array(rows) if rows else np.zeros((1, 1))
    # each next pivot is the vector of the sample that is farthest from those before, so all dense places have one
    order, near = [0], sample @ sample[0]
    most = min(len(sample) // 2, 16 * n // tile)
    while len(order) < most:
        order.append(int(np.argmin(near)))
        near = np.maximum(near, sample @ sample[order[-1]])
    options = [Pivots(sample[order[:p]], least) for p in sorted({min(len(order), 1 << i) for i in range(13)})]
    best = min(options, key=lambda o: o.cost(sample, n, tile))
    if len(best.v) == 1:
        return replace(best, lowest=np.array([-1.0]))

    def widths(batches):
        for batch in batches:
            home, sims = best.homes(matrix(column(batch, "v"))) if batch.num_rows else (np.zeros(0, np.int64), np.zeros(0))
            yield pa.RecordBatch.from_arrays([pa.array(home), pa.array(sims)], names=["cell", "sim"])

    lowest = np.ones(len(best.v))
    for r in base.select("v").mapInArrow(widths, "cell long, sim double").groupBy("cell").agg(F.min("sim").alias("sim")).collect():
        lowest[r["cell"]] = r["sim"]
    return replace(best, lowest=lowest)


PAIRS = "a long, b long, sim double"


def _pairs(a: np.ndarray, b: np.ndarray, sims: np.ndarray, use: np.ndarray) -> pa.RecordBatch:
    i, j = np.nonzero(use)
    return pa.RecordBatch.from_arrays([pa.array(np.minimum(a[i], b[j])), pa.array(np.maximum(a[i], b[j])), pa.array(sims[i, j])], names=["a", "b", "sim"])


def celled(base: DataFrame, least: float, tile: int) -> tuple[DataFrame, DataFrame]:
    """Rows (tile, id, v) that belong to tiles, and those that pass them.

    Vectors are dealt into cells about pivots, and only those near a border into others too. A cell of more than `tile`
    vectors is split by hash into tiles that its vectors pass in turn.
    """
    shared = base.sparkSession.sparkContext.broadcast(planned(base, least, tile))
    ids = "cell long, guest boolean, id long, v array<double>"

    def place(batches):
        pivots = shared.value
        for batch in batches:
            v = matrix(column(batch, "v"))
            if not len(v):
                continue
            home, _ = pivots.homes(v)
            rows, cells = pivots.guests(v, home)
            take = batch.take(pa.array(np.append(np.arange(len(v)), rows)))
            guest = np.arange(len(take)) >= len(v)
            yield pa.RecordBatch.from_arrays([pa.array(np.append(home, cells)), pa.array(guest), column(take, "id"), column(take, "v")], names=["cell", "guest", "id", "v"])

    placed = base.select("id", "v").mapInArrow(place, ids)
    # as many rows as pivots
    splits = placed.where("NOT guest").groupBy("cell").count().select("cell", F.ceil(F.col("count") / tile).alias("splits"))
    placed = placed.join(F.broadcast(splits), "cell").withColumn("split", F.pmod(F.xxhash64("id", F.lit(7)), "splits"))
    at = lambda split: (F.col("cell") * F.lit(1 << 31) + split).alias("tile")
    own = placed.where("NOT guest").select(at(F.col("split")), "id", "v")
    last = F.when(F.col("guest"), F.col("splits")).otherwise(F.col("split"))
    passing = placed.withColumn("s", F.explode(F.when(last > 0, F.sequence(F.lit(0).cast("long"), last - 1)))).select(at(F.col("s")), "id", "v")
    return own, passing


def similar_pairs(base: DataFrame, least: float, tile: int = TILE) -> DataFrame:
    """a < b and sim of all pairs of base (id, v) with a cosine of at least `least`, exactly; only those are written out."""
    own, passing = celled(base, least, tile)

    def load(table: pa.Table) -> tuple:
        own_ids, v = column(table, "id").to_numpy(), matrix(table.column("v"))
        step, parts = max(1, (1 << 22) // max(1, len(v))), []
        for a in range(0, len(v), step):
            sims = v[a : a + step] @ v.T
            later = np.arange(len(v))[None, :] > np.arange(a, a + len(sims))[:, None]
            parts.append(_pairs(own_ids[a : a + step], own_ids, sims, (sims >= least) & later & (own_ids[a : a + step, None] != own_ids[None, :])))
        return (own_ids, v), joined(parts)

    def answer(state: tuple, batch: pa.RecordBatch) -> pa.RecordBatch:
        own_ids, v = state
        q_ids, q = column(batch, "id").to_numpy(), matrix(column(batch, "v"))
        step, parts = max(1, (1 << 22) // max(1, len(v))), []
        for a in range(0, len(q), step):
            sims = q[a : a + step] @ v.T
            parts.append(_pairs(q_ids[a : a + step], own_ids, sims, (sims >= least) & (q_ids[a : a + step, None] != own_ids[None, :])))
        return joined(parts)

    return meet(own, passing, load, answer, PAIRS)


def centroids(df: DataFrame, key: str) -> DataFrame:
    """Mean of each key's unit vectors v, normalised; sums by place are partial before the shuffle."""
    flat = df.select(key, F.posexplode("v").alias("place", "value"))
    means = flat.groupBy(key, "place").agg(F.avg("value").alias("m")).groupBy(key).agg(F.array_sort(F.collect_list(F.struct("place", "m"))).alias("s"))
    return means.select(key, normalized(F.transform("s", lambda x: x["m"])).alias("v"))


def dbscan(base: DataFrame, eps: float, min_samples: int) -> DataFrame:
    """id, core and cluster of base (id, v): core vectors within a cosine distance of eps join up, named by the smallest
    id of their core; a border vector joins the first cluster that it touches; -1 is noise."""
    pairs = materialize(similar_pairs(base, 1 - eps).select("a", "b"), "pairs")
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    degree = both.groupBy("a").count()
    core = degree.where(F.col("count") + 1 >= min_samples).select(F.col("a").alias("id"))
    core = core if min_samples > 1 else base.select("id")
    core = materialize(core, "core")
    links = pairs.join(core.withColumnRenamed("id", "a"), "a").join(core.withColumnRenamed("id", "b"), "b").select("a", "b")
    roots = core.join(components(links), F.col("id") == F.col("node"), "left").select("id", F.coalesce("root", "id").alias("root"))
    border = both.join(roots, F.col("b") == F.col("id")).groupBy("a").agg(F.min("root").alias("touched"))
    labelled = base.select("id").join(roots, "id", "left").join(border, F.col("id") == F.col("a"), "left")
    return labelled.select("id", F.col("root").isNotNull().alias("core"), F.coalesce("root", "touched", F.lit(-1)).alias("cluster"))
