"""Nearest neighbours by cosine: learned binary codes, found by their parts, then compared as vectors.

A rotation is learned (iterative quantisation) on a sample of at most SAMPLE rows, those of the least hashes of their
ids; the signs of rotated vectors are the code, of 128 bits in four parts. Every row is indexed once by each part: rows
are dealt into tiles by a part's first bits, and a full prefix is split into tiles of a bounded number of rows. Of codes
within a distance of r of a query's at least one part is within its share of r + 1 less one, so a query asks the tiles
that may hold such parts, and each code within r is met in one tile: the one of the first part that is near enough. Those
are compared as vectors, and a tile answers with its best.

How far a query looks follows from what it has found: the angle of the k-th best so far is the widest that a better one
may have, and codes at an angle of p half turns differ in bits * p bits, give or take. First bounds are the sample's rows
(compared with all queries) and codes that share a whole part; then one search goes as far as these bounds ask. A query
without a bound looks at all codes. So queries in dense places look at little and others at much, and how many rows there
are changes nothing in it. A neighbour is missed only if its code lies `slack` deviations beyond its angle; recall is
measured in the tests.

Rows without id take no part, nor vectors that are null, empty, of no length, with null or non-finite components, or of
another size than most (of sizes that tie the smallest counts). Of rows with one id the least vector stands for all.
Scores are dot products over products of lengths in double precision, summed alike for each pair, so equal vectors tie,
and ties go by id. Empty tables give no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from frameloom.llm.common import column, materialize

#: Rows that the rotation is learned on, and that every query is compared with.
SAMPLE = 4096
PARTS, PART_BITS = 4, 32
BITS = PARTS * PART_BITS
#: Bits of a part that tiles are made by, and rows of a tile at most.
PREFIX, TILE = 10, 16_384
#: Pairs of codes, and of vectors, that are compared at a time.
CODES_AT_ONCE, PAIRS_AT_ONCE = 1 << 20, 1 << 15
HIT = "query_id long, vec_id long, score double"


def vectors(df: DataFrame, key: str, column_: str) -> DataFrame:
    """id and v of the rows that take part, one for each id."""
    v = F.transform(F.col(column_), lambda x: x.cast("double"))
    whole = df.select(F.col(key).cast("long").alias("id"), v.alias("v")).where("id IS NOT NULL AND size(v) > 0")
    fine = whole.where(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < math.inf)) & F.exists("v", lambda x: x != 0))
    sizes = fine.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    return fine.where(F.size("v") == (sizes["d"] if sizes else 0)).groupBy("id").agg(F.min("v").alias("v"))


def matrix(values: pa.Array) -> np.ndarray:
    return values.flatten().to_numpy(zero_copy_only=False).reshape(len(values), -1)


def scaled(x: np.ndarray) -> np.ndarray:
    """Vectors over powers of two, so that no square overflows; cosines stay as they are, to the last bit."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True))[1]) if len(x) else x


def row_sums(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Dot products row by row, each summed in one order wherever it stands."""
    return np.ascontiguousarray(a * b).sum(axis=1)


def lengths(x: np.ndarray) -> np.ndarray:
    return np.sqrt(row_sums(x, x))


def rotation(x: np.ndarray, bits: int = BITS, rounds: int = 30) -> np.ndarray:
    """Directions, one for each bit, whose signs are as near to the unit vectors x as rotations make them.

    With more dimensions than bits the first principal ones are rotated; with fewer, several rotations are learned, each
    from another start."""
    d = x.shape[1]
    base = np.eye(d) if d <= bits else np.linalg.svd(x, full_matrices=False)[2][:bits].T
    if base.shape[1] < min(d, bits):
        base = np.eye(d)[:, :bits]
    y = x @ base
    rng, out = np.random.default_rng(12), []
    while sum(r.shape[1] for r in out) < bits:
        r = np.linalg.qr(rng.normal(size=(y.shape[1], y.shape[1])))[0]
        for _ in range(rounds):
            u, _, vt = np.linalg.svd(np.where(y @ r >= 0, 1.0, -1.0).T @ y)
            r = (u @ vt).T
        out.append(base @ r)
    return np.column_stack(out)[:, :bits]


def codes_of(x: np.ndarray, directions: np.ndarray) -> np.ndarray:
    """Signs as words of a part each."""
    bits = np.packbits(x @ directions >= 0, axis=1)
    return np.ascontiguousarray(bits).view(">u4").astype(np.uint32).reshape(len(x), PARTS)


def radius_of(least: np.ndarray, slack: float) -> np.ndarray:
    """How far codes may be from a query's if their cosine is `least` or more; all bits without such a bound."""
    p = np.arccos(np.clip(least, -1, 1)) / np.pi
    return np.where(least < -1, BITS, np.minimum(BITS, np.ceil(BITS * p + slack * np.sqrt(BITS * p * (1 - p))))).astype(np.int64)


def shares(radius: np.ndarray) -> np.ndarray:
    """For each part how far it may be: of codes within the radius one part at least is; -1 asks nothing of a part."""
    each, more = np.divmod(radius + 1, PARTS)
    return each[:, None] - 1 + (np.arange(PARTS)[None, :] < more[:, None])


class Tiles:
    """Where parts of codes lie: prefixes of a part side by side up to TILE rows, or one prefix in several tiles."""

    def __init__(self, counts: dict[tuple[int, int], int]):
        self.first = np.zeros((PARTS, 1 << PREFIX), np.int64)
        self.split = np.ones((PARTS, 1 << PREFIX), np.int64)
        at = 0
        for part in range(PARTS):
            held = 0
            for prefix in range(1 << PREFIX):
                n = counts.get((part, prefix), 0)
                if held and held + n > TILE:
                    at, held = at + int(self.split[part, prefix - 1]), 0
                self.first[part, prefix], self.split[part, prefix] = at, max(1, -(-n // TILE))
                held += n
            at += int(self.split[part, -1])
        self.number = at

    def of_rows(self, ids: np.ndarray, codes: np.ndarray, part: int) -> np.ndarray:
        prefix = codes[:, part] >> np.uint32(PART_BITS - PREFIX)
        salt = ((ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)).astype(np.int64)
        return self.first[part, prefix] + salt % self.split[part, prefix]

    def of_query(self, code: np.ndarray, share: np.ndarray) -> np.ndarray:
        out = []
        every = np.arange(1 << PREFIX, dtype=np.uint32)
        for part in range(PARTS):
            if share[part] >= 0:
                near = np.bitwise_count(every ^ (code[part] >> np.uint32(PART_BITS - PREFIX))) <= share[part]
                first, split = self.first[part, near], self.split[part, near]
                ends = np.cumsum(split)
                out.append(np.repeat(first - ends + split, split) + np.arange(ends[-1] if len(ends) else 0))
        return np.unique(np.concatenate(out)) if out else np.zeros(0, np.int64)


def nearest(q_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, v: np.ndarray, pairs: Iterable[tuple[np.ndarray, np.ndarray]], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best of pairs (places of queries and of rows) for each query, as query ids, ids and scores."""
    held = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
    q, v = scaled(q), scaled(v)
    q_length, v_length = lengths(q), lengths(v)
    for i, j in pairs:
        for a in range(0, len(i), PAIRS_AT_ONCE):
            x, y = i[a : a + PAIRS_AT_ONCE], j[a : a + PAIRS_AT_ONCE]
            scores = row_sums(q[x], v[y]) / (q_length[x] * v_length[y])
            x, found, scores = (np.concatenate(both) for both in zip(held, (x, ids[y], scores)))
            order = np.lexsort((found, -scores, x))
            first = np.searchsorted(x[order], x[order])
            held = tuple(part[order][np.arange(len(order)) - first < k] for part in (x, found, scores))
    return q_ids[held[0]], held[1], held[2]


def _hits(found: tuple[np.ndarray, np.ndarray, np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x) for x in found], names=["query_id", "vec_id", "score"])


def _with_sample(batches: Iterable[pa.RecordBatch], shared, k: int) -> Iterator[pa.RecordBatch]:
    """The best of the sample for each query."""
    ids, v = shared.value
    for batch in batches:
        q_ids, q = column(batch, "id").to_numpy(), matrix(column(batch, "v"))
        rows = max(1, PAIRS_AT_ONCE // max(1, len(ids)))
        every = ((np.repeat(np.arange(a, min(a + rows, len(q))), len(ids)), np.tile(np.arange(len(ids)), min(a + rows, len(q)) - a)) for a in range(0, len(q), rows))
        yield _hits(nearest(q_ids, q, ids, v, ((i[q_ids[i] != ids[j]], j[q_ids[i] != ids[j]]) for i, j in every), k))


def _coded(batches: Iterable[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x = matrix(column(batch, "v")) if batch.num_rows else np.zeros((0, 1))
        if batch.num_rows:
            codes = codes_of(scaled(x), shared.value)
            yield pa.RecordBatch.from_arrays([column(batch, "id"), pa.array([r.tobytes() for r in x], pa.binary()), pa.array([c.tobytes() for c in codes], pa.binary())], names=["id", "v", "code"])


def _unpacked(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    whole = lambda name, kind: np.frombuffer(b"".join(column(batch, name).to_pylist()), kind).reshape(batch.num_rows, -1)
    return column(batch, "id").to_numpy(), whole("v", np.float64), whole("code", np.uint32)


def _prefixes(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    n = np.zeros((PARTS, 1 << PREFIX), np.int64)
    for batch in batches:
        codes = _unpacked(batch)[2]
        for part in range(PARTS):
            n[part] += np.bincount(codes[:, part] >> np.uint32(PART_BITS - PREFIX), minlength=1 << PREFIX)
    part, prefix = np.nonzero(n)
    yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(prefix), pa.array(n[part, prefix])], names=["part", "prefix", "n"])


TILED = "tile long, part int, radius long, id long, v binary, code binary"


def _tiled(batch: pa.RecordBatch, rows: np.ndarray, tile: np.ndarray, part: np.ndarray | int, radius: np.ndarray | None) -> pa.RecordBatch:
    take = batch.take(pa.array(rows))
    none = pa.nulls(len(rows), pa.int64())
    parts = np.broadcast_to(np.asarray(part, np.int32), len(rows))
    return pa.RecordBatch.from_arrays([pa.array(tile), pa.array(parts), none if radius is None else pa.array(radius), *(column(take, c) for c in ("id", "v", "code"))], names=["tile", "part", "radius", "id", "v", "code"])


def _index(batches: Iterable[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    """Each row in a tile for each part."""
    for batch in batches:
        ids, _, codes = _unpacked(batch)
        for part in range(PARTS):
            yield _tiled(batch, np.arange(len(ids)), shared.value.of_rows(ids, codes, part), part, None)


def _ask(batches: Iterable[pa.RecordBatch], shared, slack: float, widest: int) -> Iterator[pa.RecordBatch]:
    """Each query in all tiles that may hold what is within its radius; rows have the bound that is known."""
    for batch in batches:
        _, _, codes = _unpacked(batch)
        least = column(batch, "least").to_numpy(zero_copy_only=False).astype(float)
        radius = np.minimum(radius_of(np.where(np.isnan(least), -2.0, least), slack), widest)
        share = shares(radius)
        for i in range(batch.num_rows):
            tiles = shared.value.of_query(codes[i], share[i])
            yield _tiled(batch, np.full(len(tiles), i), tiles, -1, np.full(len(tiles), radius[i]))


class Tile:
    """Rows of one tile as they come, and what is near to a query among them."""

    def __init__(self, part: int):
        self.part = part
        self.rows: list[tuple[np.ndarray, ...]] = []

    def whole(self) -> tuple[np.ndarray, ...]:
        if len(self.rows) > 1:
            self.rows = [tuple(np.concatenate(x) for x in zip(*self.rows))]
        return self.rows[0]

    def near(self, codes: np.ndarray, radius: np.ndarray, q_ids: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Places of queries and of rows within the radius, of which this part is the first that is near enough."""
        ids, _, own = self.whole()
        share = shares(radius)
        step = max(1, CODES_AT_ONCE // max(1, len(ids)))
        for a in range(0, len(codes), step):
            some = slice(a, a + step)
            far = [np.bitwise_count(codes[some, p, None] ^ own[None, :, p]) for p in range(PARTS)]
            fit = far[self.part] <= share[some, self.part, None]
            for p in range(self.part):
                fit &= far[p] > share[some, p, None]
            fit &= sum(x.astype(np.int16) for x in far) <= radius[some, None]
            fit &= q_ids[some, None] != ids[None, :]
            i, j = np.nonzero(fit)
            yield i + a, j


def _search(batches: Iterable[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """A tile's best for each query; rows come by tile, its own before those of queries, which are never held."""
    tile, held = None, Tile(0)
    for batch in batches:
        tiles = column(batch, "tile").to_numpy()
        own = np.asarray(column(batch, "radius").is_null())
        edges = [0, *(np.flatnonzero((np.diff(tiles) != 0) | (np.diff(own.astype(int)) != 0)) + 1).tolist(), len(tiles)]
        for a, b in zip(edges, edges[1:]):
            part = batch.slice(a, b - a)
            if b > a and tile != tiles[a]:
                tile, held = tiles[a], Tile(int(column(part, "part")[0].as_py()))
            if b > a and own[a]:
                held.rows.append(_unpacked(part))
            elif b > a and held.rows:
                q_ids, q, codes = _unpacked(part)
                ids, v, _ = held.whole()
                yield _hits(nearest(q_ids, q, ids, v, held.near(codes, column(part, "radius").to_numpy(), q_ids), k))


def best(hits: DataFrame, k: int) -> DataFrame:
    """The k best different hits of each query, with ranks."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    once = hits.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    return once.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def search(base: DataFrame, queries: DataFrame, k: int, slack: float = 2.0) -> DataFrame:
    """query_id, rank, vec_id and score of the k nearest rows of base (id, v) that are found for each query (id, v), but
    for rows with the query's id; both as `vectors` gives them."""
    spark = base.sparkSession
    sample = base.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).collect()
    if not sample:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    ids, v = np.array([r["id"] for r in sample], np.int64), np.array([r["v"] for r in sample])
    shared = spark.sparkContext.broadcast((ids, v))
    x = scaled(v)
    turned = spark.sparkContext.broadcast(rotation(x / lengths(x)[:, None]))
    coded = lambda df: df.mapInArrow(lambda batches: _coded(batches, turned), "id long, v binary, code binary")
    rows, asked = materialize(coded(base), "codes"), materialize(coded(queries), "queries")
    counts = rows.mapInArrow(_prefixes, "part long, prefix long, n long").groupBy("part", "prefix").agg(F.sum("n").alias("n")).collect()
    tiles = spark.sparkContext.broadcast(Tiles({(r["part"], r["prefix"]): r["n"] for r in counts}))

    def found(bounds: DataFrame, widest: int) -> DataFrame:
        index = rows.mapInArrow(lambda batches: _index(batches, tiles), TILED)
        bounded = asked.join(bounds, asked["id"] == bounds["query_id"], "left").select("id", "v", "code", "least")
        ask = bounded.mapInArrow(lambda batches: _ask(batches, tiles, slack, widest), TILED)
        dealt = index.unionByName(ask).repartition("tile").sortWithinPartitions("tile", F.col("radius").isNotNull())
        return dealt.mapInArrow(lambda batches: _search(batches, k), HIT)

    def bounds(hits: DataFrame) -> DataFrame:
        return best(hits, k).groupBy("query_id").agg(F.when(F.count("*") == k, F.min("score")).alias("least"))

    hits = materialize(queries.mapInArrow(lambda batches: _with_sample(batches, shared, k), HIT), "hits")
    close = materialize(found(bounds(hits), PARTS - 1), "hits")
    hits = hits.unionByName(close)
    return best(hits.unionByName(found(bounds(hits), BITS)), k)


def embedding_search(embeddings: DataFrame, every: int = 50, k: int = 5) -> DataFrame:
    """The k nearest of all other rows for each row whose vec_id is divisible by `every`."""
    rows = materialize(vectors(embeddings, "vec_id", "embedding"), "vectors")
    return search(rows, rows.where(F.col("id") % every == 0), k)
