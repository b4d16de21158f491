"""Two tables met tile by tile: a tile's own rows are held, what is put to them streams past."""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator, Mapping, Sequence
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def column(batch: pa.RecordBatch | pa.Table, name: str) -> pa.Array:
    out = batch.column(batch.schema.get_field_index(name))
    return out.combine_chunks() if isinstance(out, pa.ChunkedArray) else out


def spread(sizes: Mapping[int, int], parts: int) -> dict[int, int]:
    """A part for each tile, so that all parts have about as much: the largest tile first, to the part with the least."""
    heap = [(0, p) for p in range(min(parts, len(sizes)))]
    out = {}
    for tile, n in sorted(sizes.items(), key=lambda x: (-x[1], x[0])):
        held, p = heap[0]
        heapq.heapreplace(heap, (held + n, p))
        out[tile] = p
    return out


def meet(own: DataFrame, probes: DataFrame, load: Callable[[pa.Table], tuple[Any, pa.RecordBatch | None]], answer: Callable[[Any, pa.RecordBatch], pa.RecordBatch | None], schema: str, order: Sequence[str] = (), alone: bool = False, parts: Mapping[int, int] | None = None) -> DataFrame:
    """What load and answer give for the rows of each tile; both tables have a column tile.

    load gets a tile's own rows at once, of which there must be a bounded number, and gives a state and rows that they
    make among themselves; answer gets the state and some of the tile's probes at a time, so there may be any number of
    them, in an order if one is given. Tiles are dealt by hash, or to the parts that are named for some; probes of a tile
    without own rows get nothing, or with `alone` are put to what load makes of no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile, held, state = None, [], None
        for batch in batches:
            tiles, probing = column(batch, "tile").to_numpy(), column(batch, "_probe").to_numpy(zero_copy_only=False)
            edges = [0, *(np.flatnonzero((np.diff(tiles) != 0) | (np.diff(probing.astype(int)) != 0)) + 1).tolist(), len(tiles)]
            for a, b in zip(edges, edges[1:]):
                if a == b:
                    continue
                if tile != tiles[a]:
                    if held and state is None and (made := load(pa.Table.from_batches(held))[1]) is not None:
                        yield made
                    tile, held, state = tiles[a], [], None
                if not probing[a]:
                    held.append(batch.slice(a, b - a))
                elif held or alone:
                    if state is None:
                        state, made = load(pa.Table.from_batches(held, schema=batch.schema))
                        if made is not None:
                            yield made
                    if (made := answer(state, batch.slice(a, b - a))) is not None:
                        yield made
        if held and state is None and (made := load(pa.Table.from_batches(held))[1]) is not None:
            yield made

    both = own.withColumn("_probe", F.lit(False)).unionByName(probes.withColumn("_probe", F.lit(True)), allowMissingColumns=True)
    if parts:
        n = max(parts.values()) + 1
        named = both.sparkSession.createDataFrame(list(parts.items()), "tile long, _part int")
        place = F.coalesce("_part", F.pmod(F.xxhash64("tile"), F.lit(n)).cast("int"))
        dealt = both.join(F.broadcast(named), "tile", "left").repartitionById(n, place).drop("_part")
    else:
        dealt = both.repartition("tile")
    return dealt.sortWithinPartitions("tile", "_probe", *order).mapInArrow(run, schema)
