"""N-gram Jaccard join: all links between texts whose shingle sets have a Jaccard similarity of 0.75 or more.

1. Shingles that several texts share are counted, so that they come last in the global order of shingles.
2. Each text gets its set's size and hash, a bitmap signature and its prefix: the first shingles of its set in the global
   order, of which two linked sets share at least one.
3. Prefixes meet by shingle, dealt out by ranges of hashes. A shingle that several sets have makes them a run; runs with
   the same smallest set are merged, as those of one group of copies mostly have it in common.
4. Sets of a run are compared by their bitmaps: the popcount of the XOR of two parity bitmaps is at most the sets'
   difference, which bounds their overlap from above. Sets that may link come into one group, so that no link leaves it.
5. Each set of a group becomes the sorted array of what it and the group's pivot, one of its sets, don't share. Copies have
   short ones, and the difference of two sets is that of their arrays.
6. All sets of a group are compared in tiles banded by size, each pair in one tile: bitmaps first, then the exact
   intersection of the sorted arrays. A tile returns how many rows each set links with and what joins its sets, never its
   pairs, whose number grows with the square of a group of near copies.
7. Components of all links.

Runs and groups beyond a size are split into blocks, and all pairs of blocks are dealt out.

Sets are told apart by 64-bit hashes of shingles and of sets. A null text, or one without words, has an empty set and
links with nothing; fewer words than a shingle make one shingle. Rows with the same identifier are one node, linked or
not by their texts; a row without identifier can link others and takes the smallest identifier of its component, or
null. A row's number of links is that of other rows whose texts link with its own, copies among them. Ties in order are
broken by hash; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from frameloom.llm.common import Words, column, materialize, slices
from frameloom.llm.components import components

WORDS = 5
#: Links need PART * intersection >= WHOLE * union.
PART, WHOLE = 100, 75
#: Shingles found by as many texts of one chunk, and of all, come last in the order; at most HOT_MOST of them, as the
#: order is one for all and so serves any choice.
HOT_CHUNK, HOT_ALL, HOT_MOST = 2, 8, 1_000_000
CHUNK = 2_000_000
#: Prefix shingles that meet in one task, and those of one shingle in one of its blocks.
BUCKET, HOT_BLOCK = 400_000, 100_000
#: Sets of one run in a block, and of all runs in a task.
RUN_BLOCK, RUN_TASK = 8_000, 40_000
#: Shingles of a group's sets that are held against its pivot in one task.
PIVOT_SHINGLES = 4_000_000
#: Sets, and shingles of their arrays, in a cell of a group.
CELL_SETS, CELL_SHINGLES = 1_024, 500_000
#: Sizes of linked sets differ by one such band at most: the base exceeds PART / WHOLE.
BAND_BASE = 1.34
#: Identifiers that are broadcast; more are joined by a shuffle.
BROADCAST_ROWS = 1_000_000
PAIRS_AT_ONCE = 1_000_000
MIN_BITS = 512
_MIX = np.uint64(0xFF51AFD7ED558CCD)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * _MIX
    return h ^ (h >> np.uint64(29))


def shingle_sets(texts: pa.Array) -> list[np.ndarray]:
    """The sorted hashes of each text's set."""
    words = Words(texts)
    digest = xxhash.xxh3_64_intdigest
    own = np.fromiter((digest(w.encode().lower()) for w in words.distinct), np.uint64, len(words.distinct))
    seq = own[words.codes]
    n = len(seq)
    h = np.zeros(max(n - WORDS + 1, 0), np.uint64)
    for i in range(WORDS):
        h = _mixed(h + seq[i : n - WORDS + 1 + i] * np.uint64(2 * i + 3)) if n >= WORDS else h
    out = []
    for a, b in zip(words.starts[:-1].tolist(), words.starts[1:].tolist()):
        if b - a >= WORDS:
            out.append(np.unique(h[a : b - WORDS + 1]))
        elif b > a:
            out.append(np.array([digest(seq[a:b].tobytes(), seed=b - a)], np.uint64))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def set_id(s: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(s.tobytes()) - 2**63


def bits_of(n: int) -> int:
    """A bitmap's width, by the set's size."""
    return max(MIN_BITS, 1 << (n - 1).bit_length())


def bitmap(s: np.ndarray, width: int | None = None) -> bytes:
    """Parity of the set's hashes in each cell."""
    width = width or bits_of(len(s))
    cells = np.bincount((_mixed(s) & np.uint64(width - 1)).astype(np.int64), minlength=width) & 1
    return np.packbits(cells.astype(np.uint8), bitorder="little").tobytes()


def prefix(s: np.ndarray, hot: np.ndarray) -> np.ndarray:
    n = len(s)
    length = n - -(-WHOLE * n // PART) + 1
    if len(hot):
        at = np.minimum(np.searchsorted(hot, s), len(hot) - 1)
        late = hot[at] == s
        if late.any():
            return np.sort(np.concatenate((s[~late], s[late]))[:length])
    return s[:length]


def _hot(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, size, seen = [], 0, set()

    def flush() -> Iterator[pa.RecordBatch]:
        if held:
            h, n = np.unique(np.concatenate(held), return_counts=True)
            h, n = h[n >= HOT_CHUNK], n[n >= HOT_CHUNK]
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n.astype(np.int64))], names=["h", "n"])

    for batch in slices(batches):
        for s in shingle_sets(column(batch, "text")):
            if len(s) and (k := set_id(s)) not in seen:
                seen.add(k)
                held.append(s)
                size += len(s)
        if size >= CHUNK:
            yield from flush()
            held, size, seen = [], 0, set()
    yield from flush()


def _describe(batches: Iterable[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    """Each row's set; its bitmap and prefix come with the first row of a set in a slice."""
    hot, _ = shared.value
    for batch in slices(batches):
        sid, n, maps, prefixes, seen = [], [], [], [], set()
        for s in shingle_sets(column(batch, "text")):
            n.append(len(s))
            sid.append(set_id(s) if len(s) else None)
            fresh = len(s) > 0 and sid[-1] not in seen
            seen.add(sid[-1])
            maps.append(bitmap(s) if fresh else None)
            prefixes.append(prefix(s, hot).tobytes() if fresh else None)
        yield pa.RecordBatch.from_arrays(
            [column(batch, "doc_id"), column(batch, "row"), pa.array(n, pa.int64()), pa.array(sid, pa.int64()), pa.array(maps, pa.binary()), pa.array(prefixes, pa.binary())],
            names=["doc_id", "row", "n", "sid", "bitmap", "prefix"],
        )


def _deal(batches: Iterable[pa.RecordBatch], shared, power: int) -> Iterator[pa.RecordBatch]:
    """Packs prefixes by ranges of hashes, one row a range and batch. Entries of a shingle with many sets are dealt out to
    each pair of the shingle's blocks that has theirs, in buckets below 0."""
    hot, counts = shared.value
    for batch in batches:
        sid = column(batch, "sid").to_numpy(zero_copy_only=False)
        _, first = np.unique(sid, return_index=True)
        blobs = column(batch, "prefix")
        parts = [np.frombuffer(blobs[i].as_buffer(), np.uint64) for i in first.tolist()]
        if not parts:
            continue
        h = np.concatenate(parts)
        owner = sid[np.repeat(first, [len(p) for p in parts])]
        bucket = (h >> np.uint64(64 - power)).astype(np.int64)
        at = np.minimum(np.searchsorted(hot, h), max(len(hot) - 1, 0))
        blocks = np.where(hot[at] == h, -(-counts[at] // HOT_BLOCK), 1) if len(hot) else np.ones(len(h), np.int64)
        if (split := np.flatnonzero(blocks > 1)).size:
            k = np.repeat(split, blocks[split])
            other = np.arange(len(k)) - np.repeat(np.cumsum(blocks[split]) - blocks[split], blocks[split])
            own = (_mixed(owner[k].view(np.uint64)) % blocks[k].astype(np.uint64)).astype(np.int64)
            pair = np.minimum(own, other) * np.int64(1 << 31) + np.maximum(own, other)
            away = _mixed(_mixed(h[k]) + pair.view(np.uint64)).view(np.int64) | np.int64(-(2**63))
            rest = np.flatnonzero(blocks <= 1)
            h, owner, bucket = np.concatenate((h[rest], h[k])), np.concatenate((owner[rest], owner[k])), np.concatenate((bucket[rest], away))
        order = np.argsort(bucket, kind="stable")
        h, owner, bucket = h[order], owner[order], bucket[order]
        edges = [0, *(np.flatnonzero(np.diff(bucket)) + 1).tolist(), len(h)]
        rows = [(int(bucket[a]), h[a:b].tobytes(), owner[a:b].tobytes()) for a, b in zip(edges, edges[1:]) if b > a]
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), (pa.int64(), pa.binary(), pa.binary()))], names=["bucket", "h", "sid"])


def _runs(table: pa.Table) -> pa.Table:
    """The sets of each shingle of a bucket that several sets have, packed under the smallest of them, in parts where they
    are many. A shingle all of whose sets another smallest set has together already is left out."""
    h, sid = (np.frombuffer(b"".join(table.column(c).to_pylist()), t) for c, t in (("h", np.uint64), ("sid", np.int64)))
    order = np.lexsort((sid, h))
    h, sid = h[order], sid[order]
    fresh = np.concatenate(([True], (h[1:] != h[:-1]) | (sid[1:] != sid[:-1])))
    h, sid = h[fresh], sid[fresh]
    starts = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
    size = np.diff(np.append(starts, len(h)))
    least, sid, size = sid[starts][size > 1], sid[np.repeat(size > 1, size)], size[size > 1]
    if len(sid):
        # the smallest set that each set comes under: a run whose sets agree on one is part of what that one has
        _, which = np.unique(sid, return_inverse=True)
        first = np.full(which.max() + 1, np.iinfo(np.int64).max)
        np.minimum.at(first, which, np.repeat(least, size))
        starts = np.cumsum(size) - size
        low, high = (f.reduceat(first[which], starts) for f in (np.minimum, np.maximum))
        stays = (low != high) | (low == least)
        least, sid = np.repeat(least[stays], size[stays]), sid[np.repeat(stays, size)]
    else:
        least = sid
    order = np.lexsort((sid, least))
    least, sid = least[order], sid[order]
    fresh = np.concatenate(([True], (least[1:] != least[:-1]) | (sid[1:] != sid[:-1])))[: len(sid)]
    least, sid = least[fresh], sid[fresh]
    rows = []
    for a, b in _edges(least):
        parts = -(-(b - a) // RUN_BLOCK)
        part = (_mixed(sid[a:b].view(np.uint64)) % np.uint64(parts)).astype(np.int64)
        rows += [(int(least[a]), k, sid[a:b][part == k].tobytes()) for k in range(parts)]
    leasts, parts, blobs = zip(*rows) if rows else ((), (), ())
    return pa.table({"least": pa.array(leasts, pa.int64()), "part": pa.array(parts, pa.int64()), "sids": pa.array(blobs, pa.binary())})


def _merged(table: pa.Table) -> pa.Table:
    """The distinct sets under each smallest one, from what several buckets have of them."""
    blobs = table.column("sids").to_pylist()
    sid = np.frombuffer(b"".join(blobs), np.int64)
    least = np.repeat(table.column("least").to_numpy(), [len(x) // 8 for x in blobs])
    order = np.lexsort((sid, least))
    least, sid = least[order], sid[order]
    fresh = np.concatenate(([True], (least[1:] != least[:-1]) | (sid[1:] != sid[:-1])))[: len(sid)]
    return pa.table({"least": least[fresh], "sid": sid[fresh]})


def _folded(maps: np.ndarray, width: int) -> np.ndarray:
    while maps.shape[1] * 64 > width:
        half = maps.shape[1] // 2
        maps = maps[:, :half] ^ maps[:, half:]
    return maps


class Bitmaps:
    """Bitmaps of sets of sizes n, as arrays by width."""

    def __init__(self, maps: list[bytes], n: np.ndarray):
        self.n = n.astype(np.int64)
        self.widths = np.array([8 * len(m) for m in maps])
        self.place = np.zeros(len(maps), np.int64)
        self.by_width: dict[int, np.ndarray] = {}
        for w in np.unique(self.widths).tolist():
            mine = np.flatnonzero(self.widths == w)
            self.place[mine] = np.arange(len(mine))
            self.by_width[w] = np.frombuffer(b"".join(maps[k] for k in mine.tolist()), np.uint64).reshape(len(mine), -1)

    def may_link(self, p: np.ndarray, q: np.ndarray) -> np.ndarray:
        """Which of the pairs, of sizes that allow a link, can link by the bound that their bitmaps give."""
        out = np.zeros(len(p), bool)
        for w in np.unique(self.widths[p]).tolist():
            for v in np.unique(self.widths[q][self.widths[p] == w]).tolist():
                part = np.flatnonzero((self.widths[p] == w) & (self.widths[q] == v))
                low = min(w, v)
                left, right = _folded(self.by_width[w], low), _folded(self.by_width[v], low)
                step = max(1, 2**22 // low)
                for at in range(0, len(part), step):
                    k = part[at : at + step]
                    differ = np.bitwise_count(left[self.place[p[k]]] ^ right[self.place[q[k]]]).sum(axis=1, dtype=np.int64)
                    # linked sets differ in (PART - WHOLE) / (PART + WHOLE) of their sizes' sum at most
                    out[k] = (PART + WHOLE) * differ <= (PART - WHOLE) * (self.n[p[k]] + self.n[q[k]])
        return out


def fitting_pairs(runs: list[tuple[int, int]], n: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows of a run, which is sorted by size, whose sizes allow a link; in lists of a bounded length."""
    left, right, held = [], [], 0
    for a, b in runs:
        size = n[a:b]
        top = np.searchsorted(size, size * PART // WHOLE, side="right")
        for x in range(0, b - a, 2048):
            rows = np.arange(x, min(x + 2048, b - a))
            width = int((top[rows] - rows - 1).clip(0).max(initial=0))
            for y in range(0, width, max(1, PAIRS_AT_ONCE // 2048)):
                k = np.arange(y, min(width, y + max(1, PAIRS_AT_ONCE // 2048)))
                j = rows[:, None] + 1 + k[None, :]
                i = np.broadcast_to(rows[:, None], j.shape)
                fits = j < top[rows][:, None]
                left.append(i[fits] + a)
                right.append(j[fits] + a)
                held += len(left[-1])
                if held >= PAIRS_AT_ONCE:
                    yield np.concatenate(left), np.concatenate(right)
                    left, right, held = [], [], 0
    if held:
        yield np.concatenate(left), np.concatenate(right)


def unite(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """label, in which each row has the smallest row of its class, after pairs (i, j) are joined."""
    while True:
        a, b = label[i], label[j]
        apart = a != b
        if not apart.any():
            return label
        i, j = i[apart], j[apart]
        label[np.maximum(a, b)[apart]] = np.minimum(a, b)[apart]
        while not np.array_equal(label[label], label):
            label = label[label]


def _edges(key: np.ndarray) -> list[tuple[int, int]]:
    starts = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))).tolist() if len(key) else []
    return list(zip(starts, [*starts[1:], len(key)]))


def _tentative(table: pa.Table) -> pa.Table:
    """What joins the sets of runs that may link by their bitmaps: at most one row a set and run."""
    run, sid, n = (table.column(c).to_numpy() for c in ("run", "sid", "n"))
    order = np.lexsort((n, run))
    run, sid, n = run[order], sid[order], n[order]
    _, first, which = np.unique(sid, return_index=True, return_inverse=True)
    blobs = table.column("bitmap").to_pylist()
    maps = Bitmaps([blobs[k] for k in order[first].tolist()], n[first])
    runs = _edges(run)
    label = np.arange(len(first))
    # the set of middle size joins most of a group of copies
    middle = np.concatenate([np.full(b - a, (a + b) // 2) for a, b in runs])
    fits = PART * np.minimum(n, n[middle]) >= WHOLE * np.maximum(n, n[middle])
    p, q = which[fits], which[middle[fits]]
    ok = maps.may_link(p, q)
    label = unite(label, p[ok], q[ok])
    for i, j in fitting_pairs(runs, n):
        p, q = which[i], which[j]
        apart = label[p] != label[q]
        p, q = p[apart], q[apart]
        ok = maps.may_link(p, q)
        label = unite(label, p[ok], q[ok])
    moved = np.flatnonzero(label != np.arange(len(label)))
    return pa.table({"a": sid[first[moved]], "b": sid[first[label[moved]]]})


def _deltas(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What each set and its group's pivot don't share. Rows come sorted: of a part of a group first the pivot."""
    root, part, pivot = None, None, None
    for batch in slices(batches):
        out = []
        keys = (column(batch, c).to_pylist() for c in ("root", "part", "place", "sid", "n", "copies"))
        for r, p, place, sid, n, copies, s in zip(*keys, shingle_sets(column(batch, "text"))):
            if not place:
                root, part, pivot = r, p, s
            elif (r, p) != (root, part):
                raise ValueError("a part of a group came without its pivot")
            else:
                delta = np.setxor1d(pivot, s, assume_unique=True)
                out.append((r, sid, n, copies, len(delta), delta.tobytes()))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (*[pa.int64()] * 5, pa.binary()))], names=["root", "sid", "n", "copies", "size", "delta"])


def _linked(i: np.ndarray, j: np.ndarray, n: np.ndarray, ids: np.ndarray, starts: np.ndarray, mark: np.ndarray) -> np.ndarray:
    """Which pairs (i, j) of sets of n shingles link, exactly; sorted by i. A set's array is the sorted numbers of its shingles
    in the tile; one array at a time is intersected with all it is paired with."""
    out = np.zeros(len(i), bool)
    size = np.diff(starts)
    for a, b in _edges(i):
        own, others = int(i[a]), j[a:b]
        mark[ids[starts[own] : starts[own + 1]]] = True
        low, high = int(others.min()), int(others.max()) + 1
        if 4 * (b - a) >= high - low:
            sums = np.concatenate(([0], np.cumsum(mark[ids[starts[low] : starts[high]]])))
            shared = (sums[starts[low + 1 : high + 1] - starts[low]] - sums[starts[low:high] - starts[low]])[others - low]
        else:
            shared = np.array([np.count_nonzero(mark[ids[starts[k] : starts[k + 1]]]) for k in others.tolist()], np.int64)
        mark[ids[starts[own] : starts[own + 1]]] = False
        differ = size[own] + size[others] - 2 * shared
        both = (n[own] + n[others] - differ) // 2
        out[a:b] = PART * both >= WHOLE * (n[own] + n[others] - both)
    return out


def _tile(table: pa.Table, every: bool) -> pa.Table:
    """For the sets of each run of a tile the number of rows that they link with (links), and what joins them (b): all their
    links, or one row a set. Sets of a run's side 0 meet those of side 1, or each other where there is no other side."""
    run, sid, n, copies, side = (table.column(c).to_numpy() for c in ("run", "sid", "n", "copies", "side"))
    order = np.lexsort((n, run))
    run, sid, n, copies, side = run[order], sid[order], n[order], copies[order], side[order]
    blobs = table.column("delta").to_pylist()
    sets = [np.frombuffer(blobs[k], np.uint64) for k in order.tolist()]
    # the XOR of two sets' bitmaps is that of their arrays'
    maps = Bitmaps([bitmap(s, bits_of(k)) for s, k in zip(sets, n.tolist())], n)
    starts = np.concatenate(([0], np.cumsum([len(s) for s in sets])))
    distinct, ids = np.unique(np.concatenate(sets), return_inverse=True)
    del sets
    mark, label = np.zeros(len(distinct), bool), np.arange(len(run))
    links, found = np.zeros(len(run), np.int64), []
    for i, j in fitting_pairs(_edges(run), n):
        meet = (side[i] != side[j]) | (side[i] == 2)
        i, j = i[meet], j[meet]
        ok = maps.may_link(i, j)
        i, j = i[ok], j[ok]
        order = np.argsort(i, kind="stable")
        i, j = i[order], j[order]
        ok = _linked(i, j, n, ids, starts, mark)
        i, j = i[ok], j[ok]
        np.add.at(links, i, copies[j])
        np.add.at(links, j, copies[i])
        if every:
            found.append((sid[i], sid[j]))
        else:
            label = unite(label, i, j)
    counted = np.flatnonzero(links)
    moved = np.flatnonzero(label != np.arange(len(label)))
    found.append((sid[moved], sid[label[moved]]))
    a, b = (np.concatenate(x) for x in zip(*found))
    a, b = np.minimum(a, b), np.maximum(a, b)
    none, some = pa.nulls(len(counted), pa.int64()), pa.nulls(len(a), pa.int64())
    return pa.table({"a": np.concatenate((sid[counted], a)), "b": pa.concat_arrays([none, pa.array(b)]), "links": pa.concat_arrays([pa.array(links[counted]), some])})


def tentative_groups(seen: DataFrame, shared) -> DataFrame:
    """node and root of all sets that share a prefix shingle with another and may link by sizes and bitmaps."""
    total = seen.agg(F.sum(F.octet_length("prefix"))).first()[0] or 0
    power = max(4, int(total // 8 // BUCKET).bit_length())
    sets = seen.where("prefix is not null")
    dealt = sets.select("sid", "prefix").mapInArrow(lambda it: _deal(it, shared, power), "bucket long, h binary, sid binary")
    packed = dealt.groupBy("bucket").applyInArrow(_runs, "least long, part long, sids binary")
    packed = packed.withColumn("task", F.pmod(F.xxhash64("least", "part"), F.lit(1 << power)))
    # a part of one bucket can be another's whole
    runs = materialize(packed.groupBy("task").applyInArrow(_merged, "least long, sid long").distinct(), "runs")
    maps = sets.join(runs.select("sid").distinct(), "sid", "left_semi").dropDuplicates(["sid"]).select("sid", "n", "bitmap")
    large = runs.groupBy("least").count().where(F.col("count") > 2 * RUN_BLOCK).select("least", F.ceil(F.col("count") / RUN_BLOCK).cast("long").alias("blocks"))
    blocks = F.coalesce("blocks", F.lit(1).cast("long"))
    dealt = runs.join(large, "least", "left").select("least", "sid", F.pmod(F.xxhash64("sid"), blocks).alias("own"), F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)).alias("other"))
    run = F.xxhash64("least", F.least("own", "other"), F.greatest("own", "other"))
    tasks = max(1, -(-runs.count() // RUN_TASK))
    dealt = dealt.select("sid", run.alias("run")).join(maps, "sid").withColumn("task", F.pmod("run", F.lit(tasks)))
    return components(dealt.groupBy("task").applyInArrow(_tentative, "a long, b long"))


def tiled(sets: DataFrame) -> DataFrame:
    """sid, run and side for each tile that has a set (root, sid, n, size: of its array)."""
    sizes = sets.groupBy("root").agg(F.count("*").alias("sets"), F.sum("size").alias("total"))
    large = sizes.where((F.col("sets") > CELL_SETS) | (F.col("total") > CELL_SHINGLES)).select("root")
    whole = sets.join(large, "root", "left_anti").select("sid", F.xxhash64("root").alias("run"), F.lit(2).alias("side"))
    band = F.floor(F.log("n") / math.log(BAND_BASE)).cast("long")
    split = sets.join(large, "root", "left_semi").withColumn("band", band)
    cells = split.groupBy("root", "band").agg(F.greatest(F.ceil(F.count("*") / CELL_SETS), F.ceil(F.sum("size") / CELL_SHINGLES)).cast("long").alias("cells"))
    own = split.join(cells, ["root", "band"]).select("root", "sid", F.struct("band", F.pmod(F.xxhash64("sid"), "cells").alias("cell")).alias("own"))
    near = cells.select(F.col("root").alias("of"), "band", F.explode(F.sequence(F.lit(0).cast("long"), F.col("cells") - 1)).alias("cell")).select("of", F.struct("band", "cell").alias("other"))
    # first the tiles of a cell, then its sets
    pairs = near.withColumnRenamed("other", "cell").join(near, "of").where("abs(cell.band - other.band) <= 1")
    pairs = pairs.select("of", "cell", F.xxhash64("of", F.least("cell", "other"), F.greatest("cell", "other")).alias("run"), F.when(F.expr("cell = other"), 2).when(F.expr("cell < other"), 0).otherwise(1).alias("side"))
    split = own.join(pairs, (F.col("root") == F.col("of")) & (F.col("own") == F.col("cell"))).select("sid", "run", "side")
    return whole.unionByName(split)


def deltas(docs: DataFrame, seen: DataFrame, groups: DataFrame) -> DataFrame:
    """root, sid, n, copies, size and delta of each set of the groups (node, root), whose pivot is the set named root. A
    group's texts go to parts of a bounded size, each with the pivot's."""
    rows = seen.join(groups, F.col("sid") == F.col("node")).groupBy("root", "sid")
    rows = rows.agg(F.max("n").alias("n"), F.count("*").alias("copies"), F.min(F.struct("doc_id", "row")).alias("at"))
    rows = materialize(rows.select("root", "sid", "n", "copies", F.col("at.doc_id").alias("of"), F.col("at.row").alias("at")), "groups")
    parts = rows.groupBy("root").agg(F.ceil(F.sum("n") / PIVOT_SHINGLES).cast("long").alias("parts"))
    dealt = rows.join(parts, "root").withColumns({"part": F.pmod(F.xxhash64("sid"), "parts"), "place": F.lit(1)})
    pivots = rows.where("sid = root").join(parts, "root").withColumns({"part": F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)), "place": F.lit(0)})
    dealt = materialize(dealt.unionByName(pivots).drop("parts"), "parts")
    texts = docs.join(F.broadcast(dealt) if dealt.count() <= BROADCAST_ROWS else dealt, (docs["row"] == F.col("at")) & docs["doc_id"].eqNullSafe(F.col("of")))
    texts = texts.select("root", "part", "place", "sid", "n", "copies", "text")
    if not seen.groupBy("doc_id", "row").count().where("count > 1").isEmpty():
        # equal rows of a table are one text
        texts = texts.dropDuplicates(["root", "part", "place", "sid"])
    texts = texts.repartition("root", "part").sortWithinPartitions("root", "part", "place")
    return materialize(texts.mapInArrow(_deltas, "root long, sid long, n long, copies long, size long, delta binary"), "deltas")


def group_links(sets: DataFrame, every: bool) -> DataFrame:
    """Rows (a, b, links) of all tiles of the sets (root, sid, n, copies, size, delta)."""
    tiles = materialize(tiled(sets.select("root", "sid", "n", "size")), "tiles")
    weight = sets.join(tiles, "sid").agg(F.sum(F.col("size") + 64)).first()[0]
    tasks = max(1, -(-(weight or 0) // CELL_SHINGLES))
    dealt = sets.drop("root", "size").join(tiles, "sid").withColumn("task", F.pmod("run", F.lit(tasks)))
    return materialize(dealt.groupBy("task").applyInArrow(lambda t: _tile(t, every), "a long, b long, links long"), "links")


def same_rows(seen: DataFrame) -> DataFrame:
    """What joins different sets that come under one identifier."""
    ids = seen.where("sid is not null and doc_id is not null").select("doc_id", "sid")
    several = ids.groupBy("doc_id").agg(F.min("sid").alias("a"), F.max("sid").alias("most")).where("a < most")
    return ids.join(several, "doc_id").where("sid != a").select("a", F.col("sid").alias("b")).distinct()


def _joined(docs: DataFrame, every: bool) -> tuple[DataFrame, DataFrame]:
    spark = docs.sparkSession
    docs = docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.xxhash64("text").alias("row"), "text")
    hot = docs.select("text").mapInArrow(_hot, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).where(F.col("n") >= HOT_ALL)
    hot = hot.orderBy(F.desc("n"), "h").limit(HOT_MOST).toArrow()
    key, count = hot.column("h").to_numpy().astype(np.int64).view(np.uint64), hot.column("n").to_numpy().astype(np.int64)
    shared = spark.sparkContext.broadcast((key[order := np.argsort(key)], count[order]))
    seen = docs.mapInArrow(lambda it: _describe(it, shared), "doc_id long, row long, n long, sid long, bitmap binary, prefix binary")
    seen = materialize(seen, "sets")
    found = group_links(deltas(docs, seen, tentative_groups(seen, shared)), every)
    links = found.where("b is not null").select("a", "b")
    counts = found.where("b is null").groupBy("a").agg(F.sum("links").alias("others"))
    roots = components(links.unionByName(same_rows(seen)))
    rows = seen.select("doc_id", "n", "sid").join(roots, F.col("sid") == F.col("node"), "left").select("doc_id", "n", "sid", F.coalesce("root", "sid").alias("root"))
    least = rows.where("root is not null").groupBy("root").agg(F.min("doc_id").alias("least"))
    copies = seen.where("sid is not null").groupBy("sid").agg(F.count("*").alias("copies"))
    n_links = copies.join(counts, F.col("sid") == F.col("a"), "left").select("sid", (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"))
    members = rows.join(least, "root", "left").join(n_links.where("n_links > 0"), "sid", "left")
    return links, members.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("least", "doc_id").alias("component_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), "sid")


def jaccard_links(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All links (a, b) of distinct sets of docs (doc_id, text), written out; and doc_id, n_shingles, component_id, n_links and
    sid, its set, of every row. A set's rows link with each other and with all rows of the sets that link with theirs.

    The links of a large group of near copies are many; jaccard_join gives groups and numbers of links without them."""
    return _joined(docs, True)


def jaccard_join(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, the smallest doc_id that links reach, and n_links of every row of docs (doc_id,
    text)."""
    return _joined(docs, False)[1].drop("sid")


def jaccard_components(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles and component_id of every row of docs (doc_id, text)."""
    return jaccard_join(docs).drop("n_links")


def deduplicated(docs: DataFrame) -> DataFrame:
    """The rows of docs, with all their columns, but those of a component other than its smallest identifier; of rows with
    one identifier, one. Rows without identifier stay, as none can be told from others."""
    found = materialize(jaccard_join(docs), "components")
    gone = found.where("doc_id != component_id").select("doc_id").distinct()
    n_rows, n_ids = found.where("doc_id is not null").agg(F.count("*"), F.countDistinct("doc_id")).first()
    few = gone.count() <= BROADCAST_ROWS
    kept = docs.join(F.broadcast(gone) if few else gone, docs["doc_id"].cast("long") == gone["doc_id"], "left_anti")
    if n_rows != n_ids:
        named = kept.where("doc_id is not null").dropDuplicates(["doc_id"])
        kept = named.unionByName(kept.where("doc_id is null"))
    return kept
