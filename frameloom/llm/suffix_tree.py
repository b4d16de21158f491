"""LM scoring with a probabilistic suffix tree.

Symbols are tokens: words, the end of a text, and one symbol for all tokens that training has not seen. A context is the
one to `depth` tokens before a token. It is a candidate where training has it at least `least` times, at any size of the
corpus; its next-symbol counts are those of all training texts, of `entry_least` or more. It is retained where they diverge
from those of the suffix one shorter: the likelihood ratio statistic must exceed the number of counts times the logarithm
of the context's count. The root's distribution is each token's share, with the share of tokens seen once for the unseen
symbol. A retained context's counts are smoothed by the next shorter retained one, which gets what the counts leave over:

    P(t | context) = (n(context, t) + (rest + STRENGTH) P(t | shorter)) / (n(context) + STRENGTH)

and the longest retained suffix gives the probability.

A sequence of tokens has a key, made of those of the sequence without its last token (its context) and of the one without
its first (its suffix). Texts are coded once, as hashes of their tokens, in slices dealt out to blocks of a bounded size.
Counts of sequences of up to depth + 1 tokens are gathered in four passes over the slices: tokens, pairs, triples, and
longer ones, whose triples must all reach the bars. Workers pack partial counts by ranges of contexts' keys; those of a
context with very many occurrences are dealt out over several. For the tests, sequences meet the counts of their suffixes
by ranges of keys, and sums meet by ranges of contexts. Bitmaps of a bounded size, which are broadcast, only leave out
sequences that can't reach the bars.

Some blocks at a time, each then asks for its distinct sequences by ranges of keys, where they meet the counts and the
retained contexts, and gets numbers back in the order of its keys.

Null and empty texts are the end alone. Without any training text every token is unseen, with probability 1: N and V are
0. A null identifier counts as the empty text in the choice of training rows. Repeated rows are counted and scored each;
other columns are ignored; an empty table gives no rows. Tokens and sequences are told apart by 64-bit hashes.
"""

from __future__ import annotations

import contextlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from frameloom.llm.common import Words, column, materialize, release, segment_sums, slices

#: Strength of the shorter suffix in a smoothed distribution, in occurrences.
STRENGTH = 4.0
BLOCK_BYTES = 16_000_000
#: Sequences counted at once in a worker, and those of a bucket.
CHUNK, BUCKET = 1_500_000, 500_000
#: Bytes of text a token, roughly, by which buckets are sized.
TOKEN_BYTES = 6
#: A context of so many occurrences is dealt out over several buckets, or of that share of all, so that few are told apart.
SPLIT, SPLIT_SHARE = 500_000, 1_000_000
#: Bits of a bitmap, as powers of two; it has eight for each key, within these.
BITS = (20, 27)
#: Bits of one of its pieces, likewise.
PIECE = 20
#: In so many rounds blocks of texts ask and are scored, as questions and answers take several times the disk of the texts.
ROUNDS = 3
#: This operator's workers keep freed memory up to so many bytes, and take larger arrays than so many from the system each
#: time: pages that the system clears again and again are half of the CPU time otherwise.
WORKER_MEMORY = {"MALLOC_TRIM_THRESHOLD_": str(16 << 20), "MALLOC_MMAP_THRESHOLD_": str(8 << 20)}
_MIX = np.uint64(0xD6E8FEB86659FD93)
_NONE = np.zeros(0, np.uint64)


def _mixed(h: np.ndarray) -> np.ndarray:
    out = h >> np.uint64(32)
    out ^= h
    out *= _MIX
    out ^= out >> np.uint64(29)
    return out


def joint(context: np.ndarray, up: np.ndarray) -> np.ndarray:
    """The key of the sequence with this context and this suffix."""
    out = _mixed(context + np.uint64(11))
    out += up
    out += up
    return _mixed(out)


def token_hashes(words: pa.Array) -> np.ndarray:
    """Hashes of words with A-Z in lower case, eight bytes at a time of all words at once."""
    n = len(words)
    ends = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + n + 1].astype(np.int64)
    data = words.buffers()[2]
    flat = np.zeros(int(ends[-1] - ends[0]) + 8, np.uint8)
    if data is not None:
        flat[:-8] = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]]
    flat += ((flat >= 65) & (flat <= 90)).astype(np.uint8) * np.uint8(32)
    # the eight bytes from each place on
    eight = np.ndarray((len(flat) - 7,), "<u8", flat, strides=(1,))
    at, left = ends[:-1] - ends[0], np.diff(ends)
    out = _mixed(left.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    rest = np.flatnonzero(left > 0)
    while len(rest):
        some = np.minimum(left[rest], 8).astype(np.uint64)
        bits = eight[at[rest]] & (np.uint64(2**64 - 1) >> (np.uint64(64) - some * np.uint64(8)))
        out[rest] = _mixed(out[rest] * np.uint64(0x9FB21C651E98DF25) + _mixed(bits))
        at[rest] += 8
        left[rest] -= 8
        rest = rest[left[rest] > 0]
    return out


#: The end of a text as a token; no word is empty.
END = token_hashes(pa.array([""]))


def sorting(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A stable order that sorts keys, and the keys in it: numbers of places stand in for the keys' last bits while these are
    sorted, which takes less than half as long as argsort(), and few rows need another look."""
    bits = np.uint64(max(1, len(keys) - 1).bit_length())
    mixed = keys >> bits
    mixed <<= bits
    mixed |= np.arange(len(keys), dtype=np.uint64)
    mixed.sort()
    mixed &= (np.uint64(1) << bits) - np.uint64(1)
    order = mixed.view(np.int64)
    out = keys[order]
    if (out[1:] < out[:-1]).any():
        again = np.argsort(out, kind="stable")
        order, out = order[again], out[again]
    return order, out


def first_places(values: np.ndarray) -> np.ndarray:
    """Where runs of equal values start."""
    return np.flatnonzero(np.concatenate(([True], values[1:] != values[:-1]))) if len(values) else np.zeros(0, np.int64)


def grouped(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order that sorts keys, and where in it each distinct key starts."""
    order, keys = sorting(keys)
    return order, first_places(keys)


def distinct_keys(keys: np.ndarray) -> np.ndarray:
    """The sorted distinct keys, by a plain sort, which takes far less time and memory than numpy's unique()."""
    keys = np.sort(keys)
    return keys[np.concatenate(([True], keys[1:] != keys[:-1]))] if len(keys) else keys


def places(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Where sorted keys have, or would have, the wanted ones, which are looked up in order."""
    order, wanted = sorting(wanted)
    out = np.empty(len(wanted), np.int64)
    out[order] = np.searchsorted(keys, wanted)
    return out


def distinct_places(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct keys, and the place among them of each key."""
    order, keys = sorting(keys)
    new = np.concatenate(([True], keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, bool)
    out = np.empty(len(keys), np.int32)
    out[order] = np.cumsum(new, dtype=np.int32) - np.int32(1)
    return keys[new], out


def _give_back() -> None:
    """Freed memory goes back to the system, and not only what lies at the heap's end."""
    pa.default_memory_pool().release_unused()


def squeezed(blob: bytes) -> bytes:
    return len(blob).to_bytes(8, "little") + pa.compress(blob, codec="zstd", asbytes=True)


def unsqueezed(blob: bytes) -> bytes:
    return pa.decompress(blob[8:], decompressed_size=int.from_bytes(blob[:8], "little"), codec="zstd", asbytes=True)


class Sequences:
    """Tokens of texts with their ends, one text after the other: hashes of the distinct ones, and their places."""

    def __init__(self, texts: pa.Array):
        words = Words(texts)
        self.distinct = np.append(token_hashes(words.dictionary), END)
        n = words.counts()
        self.starts = words.starts + np.arange(len(words.starts))
        self.codes = np.full(int(self.starts[-1]), len(self.distinct) - 1, np.int32)
        inner = np.ones(len(self.codes), bool)
        inner[self.starts[1:] - 1] = False
        self.codes[inner] = words.codes
        self.lengths = n + 1

    def packed(self) -> tuple[bytes, bytes, bytes]:
        """Lengths, hashes and places, compressed; they take far less than texts."""
        return squeezed(self.lengths.astype(np.int32).tobytes()), self.distinct.tobytes(), squeezed(planes(self.codes))

    @classmethod
    def unpacked(cls, lengths: bytes, distinct: bytes, codes: bytes) -> Sequences:
        seq = cls.__new__(cls)
        seq.lengths, seq.distinct = np.frombuffer(unsqueezed(lengths), np.int32).astype(np.int64), np.frombuffer(distinct, np.uint64)
        seq.codes = from_planes(unsqueezed(codes), np.int32)
        seq.starts = np.concatenate(([0], np.cumsum(seq.lengths)))
        return seq

    def where(self, some: np.ndarray) -> Sequences:
        """Those of some texts only."""
        seq = Sequences.__new__(Sequences)
        seq.lengths, seq.distinct, seq.codes = self.lengths[some], self.distinct, self.codes[np.repeat(some, self.lengths)]
        seq.starts = np.concatenate(([0], np.cumsum(seq.lengths)))
        return seq

    def levels(self, depth: int, goes_on: Callable[[int, np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """For each context length from 1: places of tokens in order, their contexts' keys and those of their suffixes with
        them. goes_on(length, places, key) says which sequences can be the contexts, and which the suffixes, of longer ones."""
        inner = np.ones(len(self.codes), bool)
        inner[self.starts[:-1]] = False
        at = np.flatnonzero(inner).astype(np.int32)
        keys = self.distinct[self.codes]
        context, up = keys[at - 1], keys[at]
        for k in range(1, depth + 1):
            yield at, context, up
            if k == depth:
                return
            key = joint(context, up)
            before, own = goes_on(k, at, key)
            # a longer sequence has this one and the one a place before, which a text's start keeps apart
            j = np.flatnonzero(own[1:] & before[:-1] & (np.diff(at) == 1))
            at, context, up = at[j + 1], key[j], key[j + 1]


def bucket_of(key: np.ndarray, buckets: int) -> np.ndarray:
    """The range of keys, in order, that a key is in."""
    return (((key >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)).astype(np.int64)


def _edges(values: np.ndarray) -> list[tuple[int, int]]:
    starts = first_places(values).tolist()
    return list(zip(starts, [*starts[1:], len(values)]))


def _arrays(table: pa.Table, name: str, kind: type) -> np.ndarray:
    return np.frombuffer(b"".join(table.column(name).to_pylist()), kind)


def _batch(rows: list[tuple], schema: dict[str, pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.values())], names=list(schema))


def planes(values: np.ndarray) -> bytes:
    """The bytes of whole numbers by significance, which shuffles compress well, as many as the largest number needs, after
    how many these are."""
    n = len(values)
    if not n:
        return b""
    values = values.astype(np.int64, copy=False).view(np.uint64)
    width = max(1, -(-int(values.max()).bit_length() // 8))
    out = np.empty(1 + width * n, np.uint8)
    out[0] = width
    each = np.ascontiguousarray(values).view(np.uint8)
    for k in range(width):
        out[1 + k * n : 1 + (k + 1) * n] = each[k::8]
    return out.tobytes()


def n_planes(blob: bytes) -> int:
    """How many numbers there are."""
    return (len(blob) - 1) // blob[0] if blob else 0


def from_planes(blob: bytes, kind: type = np.int64) -> np.ndarray:
    n = n_planes(blob)
    out, flat = np.zeros(n, kind), np.frombuffer(blob, np.uint8)
    if n:
        each = out.view(np.uint8)
        for k in range(blob[0]):
            each[k :: out.itemsize] = flat[1 + k * n : 1 + (k + 1) * n]
    return out


def packed_keys(keys: np.ndarray) -> bytes:
    """Keys as the first and their differences: those of sorted ones are small. Any order is kept."""
    return keys[:1].tobytes() + planes(np.diff(keys, prepend=keys[:1]).view(np.int64))


def from_packed_keys(blobs: Iterable[bytes]) -> np.ndarray:
    found = [_NONE]
    for x in blobs:
        if len(x):
            keys = from_planes(x[8:]).view(np.uint64)
            keys[0] = int.from_bytes(x[:8], "little")
            found.append(np.cumsum(keys, dtype=np.uint64))
    return np.concatenate(found) if len(found) != 2 else found[1]


def gathered(parts: Iterable[tuple[np.ndarray, ...]], size: int = CHUNK) -> Iterator[tuple[np.ndarray, ...]]:
    """Arrays of one length each, put together until there is so much that packing by ranges pays."""
    held, n = [], 0
    for x in parts:
        held.append(x)
        n += len(x[0])
        if n >= size:
            out = tuple(np.concatenate(c) for c in zip(*held))
            held, n = [], 0
            yield out
    if n:
        yield tuple(np.concatenate(c) for c in zip(*held))


def _coded(batches: Iterable[pa.RecordBatch], n_blocks: int) -> Iterator[pa.RecordBatch]:
    """Slices of texts as sequences, dealt out to blocks in turn."""
    turn = TaskContext.get().partitionId() * 7919
    for batch in slices(batches):
        ids = column(batch, "doc_id")
        blobs = (column(batch, "train").to_numpy(zero_copy_only=False).tobytes(), *Sequences(column(batch, "text")).packed())
        listed = pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)
        yield pa.RecordBatch.from_arrays([pa.array([turn % n_blocks]), listed, *(pa.array([x], pa.binary()) for x in blobs)], names=["block", "doc_ids", "train", "lengths", "distinct", "codes"])
        turn += 1
    _give_back()


def _parts(table: pa.Table | pa.RecordBatch) -> list[Sequences]:
    return [Sequences.unpacked(*x) for x in zip(*(table.column(c).to_pylist() for c in ("lengths", "distinct", "codes")))]


def _trained(batches: Iterable[pa.RecordBatch]) -> Iterator[Sequences]:
    """The training texts of slices that have some."""
    for batch in batches:
        for flags, seq in zip(column(batch, "train").to_pylist(), _parts(batch)):
            some = np.frombuffer(flags, bool)
            if some.any():
                yield seq.where(some)


def _token_counts(batches: Iterable[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    """Partial counts of training tokens, packed by buckets."""

    def counts() -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for seq in _trained(batches):
            n = np.bincount(seq.codes, minlength=len(seq.distinct))
            yield seq.distinct[n > 0], n[n > 0]

    for keys, n in gathered(counts()):
        order, starts = grouped(keys)
        keys, n = keys[order[starts]], np.add.reduceat(n[order], starts)
        at = bucket_of(keys, buckets)
        rows = [(int(at[x]), packed_keys(keys[x:y]), planes(n[x:y])) for x, y in _edges(at)]
        yield _batch(rows, {"bucket": pa.int64(), "keys": pa.binary(), "n": pa.binary()})


def _tokens(table: pa.Table, least: int, entry_least: int) -> pa.Table:
    """A bucket's counts, and how many of them there are in all, reach the bars, or are one."""
    keys, n = from_packed_keys(table.column("keys").to_pylist()), _numbers(table, "n")
    order, starts = grouped(keys)
    keys, n = keys[order[starts]], np.add.reduceat(n[order], starts)
    found = {"keys": packed_keys(keys), "n": planes(n), "often": (n >= least).sum(), "kinds": (n >= entry_least).sum(), "total": n.sum(), "distinct": len(n), "once": (n == 1).sum()}
    return pa.table({k: [x if isinstance(x, bytes) else int(x)] for k, x in found.items()})


def _numbers(table: pa.Table, name: str) -> np.ndarray:
    return np.concatenate([np.zeros(0, np.int64), *(from_planes(x) for x in table.column(name).to_pylist())])


def _pairs(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Contexts, suffixes and counts of packed sequences."""
    for batch in batches:
        for contexts, sizes, ups, n in zip(*(column(batch, c).to_pylist() for c in ("contexts", "sizes", "ups", "n"))):
            yield np.repeat(from_packed_keys([contexts]), from_planes(sizes)), np.frombuffer(ups, np.uint64), from_planes(n)


def _counted(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Keys and counts of packed tokens or sequences."""
    for batch in batches:
        if "keys" in batch.schema.names:
            yield from ((from_packed_keys([keys]), from_planes(n)) for keys, n in zip(column(batch, "keys").to_pylist(), column(batch, "n").to_pylist()))
        else:
            yield from ((joint(context, up), n) for context, up, n in _pairs([batch]))


def _cells(batches: Iterable[pa.RecordBatch], bar: int, power: int) -> Iterator[pa.RecordBatch]:
    """Places of the bits of keys with counts from the bar on, packed by pieces of the bitmap."""
    for key, n in gathered(_counted(batches)):
        cells = np.sort((key[n >= bar] & np.uint64((1 << power) - 1)).astype(np.uint32))
        piece = cells >> np.uint32(PIECE)
        rows = [(int(piece[a]), packed_keys(cells[a:b].astype(np.uint64))) for a, b in _edges(piece)]
        if rows:
            yield _batch(rows, {"piece": pa.int64(), "cells": pa.binary()})


def _piece(table: pa.Table) -> pa.Table:
    bits = np.zeros(1 << PIECE, np.uint8)
    bits[from_packed_keys(table.column("cells").to_pylist()).view(np.int64) & (1 << PIECE) - 1] = 1
    return pa.table({"piece": table.column("piece").slice(0, 1), "bits": pa.array([np.packbits(bits, bitorder="little").tobytes()], pa.binary())})


def bitmap(counts: DataFrame, bar: int, number: int) -> np.ndarray:
    """Bits at the cells of keys with counts from the bar on, of which there is this number: 2 ** BITS[1] bits at most."""
    power = min(max((8 * number).bit_length(), BITS[0]), BITS[1])
    cells = counts.mapInArrow(lambda it: _cells(it, bar, power), "piece long, cells binary")
    out = np.zeros((1 << power - PIECE, 1 << PIECE - 3), np.uint8)
    for r in cells.groupBy("piece").applyInArrow(_piece, "piece long, bits binary").toLocalIterator():
        out[r["piece"]] = np.frombuffer(r["bits"], np.uint8)
    return out.reshape(-1)


def may_hold(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    cell = keys & np.uint64(8 * len(bits) - 1)
    cell >>= np.uint64(3)
    out = bits[cell.view(np.int64)]
    out >>= keys.astype(np.uint8) & np.uint8(7)
    out &= np.uint8(1)
    return out.view(bool)


def both_hold(first: np.ndarray, second: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which keys the first bitmap may hold, and which the second, whose keys the first one has too."""
    one = may_hold(first, keys)
    two = np.zeros(len(keys), bool)
    two[one] = may_hold(second, keys[one])
    return one, two


def spread(key: np.ndarray, other: np.ndarray, hot: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """By what rows are dealt out: a key, and where it is very frequent, a part of its rows too."""
    if not len(hot[0]):
        return key
    k = _parts_of(key, hot).astype(np.uint64)
    return np.where(k > 1, _mixed(key + _mixed(other) % k), key)


def _parts_of(key: np.ndarray, hot: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    at = np.minimum(np.searchsorted(hot[0], key), len(hot[0]) - 1)
    return np.where(hot[0][at] == key, hot[1][at], 1)


def _sequence_counts(batches: Iterable[pa.RecordBatch], shared, lengths: range, buckets: int) -> Iterator[pa.RecordBatch]:
    """Partial counts of training sequences whose contexts have these lengths, packed by buckets of contexts. The bitmaps
    have the sequences one shorter than the first of them that may stand in a context, and those that may end a sequence."""
    inner, last, hot = shared.value
    held, size = [], 0

    def pairs() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        # tokens have small numbers in the order of their hashes, and so have pairs of them
        tokens = distinct_keys(np.concatenate([x for x, _, _ in held]))
        numbers = []
        for own, context, up in held:
            rank = places(tokens, own)
            numbers.append(rank[context] * len(tokens) + rank[up])
        numbers = np.sort(np.concatenate(numbers))
        starts = first_places(numbers)
        context, up = np.divmod(numbers[starts], len(tokens))
        return tokens[context], tokens[up], np.diff(np.append(starts, len(numbers)))

    def longer() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        context, up = (np.concatenate(c) for c in zip(*held))
        order, starts = grouped(joint(context, up))
        n, first = np.diff(np.append(starts, len(order))), order[starts]
        order, context = sorting(context[first])
        return context, up[first[order]], n[order]

    def flush() -> pa.RecordBatch:
        context, up, n = pairs() if lengths[0] == 1 else longer()
        held.clear()
        at = bucket_of(spread(context, up, hot), buckets)
        if len(hot[0]):
            order = np.argsort(at.astype(np.uint16) if buckets <= 1 << 16 else at, kind="stable")
            context, up, n, at = context[order], up[order], n[order], at[order]
        rows = []
        for x, y in _edges(at):
            starts = first_places(context[x:y])
            rows.append((int(at[x]), packed_keys(context[x:y][starts]), planes(np.diff(np.append(starts, y - x))), up[x:y].tobytes(), planes(n[x:y])))
        return _batch(rows, {"bucket": pa.int64(), "contexts": pa.binary(), "sizes": pa.binary(), "ups": pa.binary(), "n": pa.binary()})

    for seq in _trained(batches):
        if lengths[0] == 1:
            ends = np.zeros(len(seq.codes), bool)
            ends[seq.starts[1:] - 1] = True
            at = np.flatnonzero(may_hold(inner, seq.distinct)[seq.codes[:-1]] & may_hold(last, seq.distinct)[seq.codes[1:]] & ~ends[:-1])
            held.append((seq.distinct, seq.codes[at], seq.codes[at + 1]))
            size += len(at)
        often = np.zeros(len(seq.codes), bool)

        def goes_on(k: int, at: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            # of what a sequence is made of, all but the last stand in its context
            if k < lengths[0] - 1:
                return np.ones(len(at), bool), np.ones(len(at), bool)
            if k == lengths[0] - 1:
                ending, often[at] = both_hold(last, inner, key)  # noqa: B023
                return often[at], ending  # noqa: B023
            return often[at], np.ones(len(at), bool)  # noqa: B023

        for k, (_, context, up) in enumerate(seq.levels(lengths[-1], goes_on) if lengths[-1] > 1 else (), 1):
            if k in lengths:
                held.append((context, up))
                size += len(context)
        if size >= CHUNK:
            yield flush()
            size = 0
    if size:
        yield flush()
    _give_back()


def _sequences(table: pa.Table, least: int, entry_least: int) -> pa.Table:
    """The sequences of a bucket with entry_least occurrences or more, and how many reach the bars."""
    context, up = from_packed_keys(table.column("contexts").to_pylist()), _arrays(table, "ups", np.uint64)
    n = _numbers(table, "n")
    context = np.repeat(context, _numbers(table, "sizes"))
    order, starts = grouped(joint(context, up))
    first, n = order[starts], np.add.reduceat(n[order], starts)
    first, n = first[n >= entry_least], n[n >= entry_least]
    order, context = sorting(context[first])
    up, n = up[first[order]], n[order]
    at = first_places(context)
    found = {"contexts": packed_keys(context[at]), "sizes": planes(np.diff(np.append(at, len(n)))), "ups": up.tobytes(), "n": planes(n), "often": int((n >= least).sum()), "kinds": len(n)}
    return pa.table({k: [x] for k, x in found.items()})


def _above(batches: Iterable[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    for key, n in _counted(batches):
        yield pa.RecordBatch.from_arrays([pa.array(key[n > most].view(np.int64)), pa.array(n[n > most])], names=["key", "n"])


def _hot(counts: DataFrame, total: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted keys of very frequent contexts and over how many buckets each goes: at most SPLIT_SHARE of them."""
    most = max(SPLIT, total // SPLIT_SHARE)
    found = counts.mapInArrow(lambda it: _above(it, most), "key long, n long").toArrow()
    key, n = found.column("key").to_numpy().astype(np.int64).view(np.uint64), found.column("n").to_numpy().astype(np.int64)
    order = np.argsort(key)
    return key[order], -(-n[order] // most)


def count_sequences(blocks: DataFrame, tokens: DataFrame, total: int, buckets: int, depth: int, least: int, entry_least: int) -> tuple[DataFrame, int, tuple[np.ndarray, np.ndarray]]:
    """All sequences of 2 to depth + 1 tokens of the blocks' training texts that have entry_least occurrences and may have a
    context of `least`, packed (contexts, sizes, ups, n); their number; and the very frequent ones and tokens."""
    spark = blocks.sparkSession
    schema = "bucket long, contexts binary, sizes binary, ups binary, n binary"
    out, counts, number = None, tokens, 0
    often, kinds = (x or 0 for x in counts.agg(F.sum("often"), F.sum("kinds")).first())
    hot = [_hot(counts, total)]
    for lengths in (range(1, 2), range(2, 3), range(3, depth + 1)):
        if not len(lengths) or lengths[0] > depth:
            break
        shared = spark.sparkContext.broadcast((bitmap(counts, least, often), bitmap(counts, entry_least, kinds), hot[-1]))
        rows = blocks.select("train", "lengths", "distinct", "codes").mapInArrow(lambda it, s=shared, k=lengths: _sequence_counts(it, s, k, buckets), schema)
        found = rows.groupBy("bucket").applyInArrow(lambda t: _sequences(t, least, entry_least), "contexts binary, sizes binary, ups binary, n binary, often long, kinds long")
        counts = materialize(found, "sequences")
        out = counts if out is None else out.unionByName(counts)
        often, kinds = (x or 0 for x in counts.agg(F.sum("often"), F.sum("kinds")).first())
        number += kinds
        hot.append(_hot(counts, total))
        shared.destroy()
        release(spark)
    keys, parts = (np.concatenate(x) for x in zip(*hot))
    order = np.argsort(keys)
    return out, number, (keys[order], parts[order])


def _tell_counts(batches: Iterable[pa.RecordBatch], shared, buckets: int) -> Iterator[pa.RecordBatch]:
    """Counts by buckets of their keys; those of very frequent ones go to each part."""
    for key, n in gathered(_counted(batches)):
        dealt = key
        if len(shared.value[0]):
            k = _parts_of(key, shared.value)
            copy = np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k)
            key, n, k = np.repeat(key, k), np.repeat(n, k), np.repeat(k, k)
            dealt = np.where(k > 1, _mixed(key + copy.astype(np.uint64)), key)
        order, dealt = sorting(dealt)
        key, n, at = key[order], n[order], bucket_of(dealt, buckets)
        yield _batch([(int(at[x]), 1, packed_keys(key[x:y]), b"", planes(n[x:y])) for x, y in _edges(at)], TOLD)


def _ask_suffixes(batches: Iterable[pa.RecordBatch], shared, buckets: int) -> Iterator[pa.RecordBatch]:
    """Sequences by buckets of their suffixes."""
    for context, up, n in gathered(_pairs(batches)):
        dealt = spread(up, context, shared.value)
        order, dealt = sorting(dealt)
        context, up, n, at = context[order], up[order], n[order], bucket_of(dealt, buckets)
        yield _batch([(int(at[x]), 0, packed_keys(up[x:y]), context[x:y].tobytes(), planes(n[x:y])) for x, y in _edges(at)], TOLD)


TOLD = {"bucket": pa.int64(), "kind": pa.int32(), "keys": pa.binary(), "contexts": pa.binary(), "n": pa.binary()}
SUMS = {"bucket": pa.int64(), "kind": pa.int32(), "keys": pa.binary(), "n": pa.binary(), "outer": pa.binary(), "kinds": pa.binary(), "gain": pa.binary()}


def _sums(table: pa.Table, buckets: int, least: int) -> pa.Table:
    """Of a bucket's sequences, sums by contexts (kind 0): counts, those of the suffixes, their number, and the likelihood
    ratio's part; and the frequent ones as contexts themselves (kind 1): count, and that of the suffix."""
    known, asked = (table.filter(pa.array(table.column("kind").to_numpy() == k)) for k in (1, 0))
    keys, m = from_packed_keys(known.column("keys").to_pylist()), _numbers(known, "n")
    order, keys = sorting(keys)
    m = m[order]
    up, context, n = from_packed_keys(asked.column("keys").to_pylist()), _arrays(asked, "contexts", np.uint64), _numbers(asked, "n")
    rows = []
    if len(keys) and len(up):
        at = np.minimum(places(keys, up), len(keys) - 1)
        some = keys[at] == up
        context, up, n, m = context[some], up[some], n[some], m[at[some]]
        order, starts = grouped(context)
        if len(order):
            gain = n * (np.log(n) - np.log(m))
            held, outer, gain = (np.add.reduceat(x[order], starts) for x in (n, m, gain))
            kinds, own = np.diff(np.append(starts, len(order))), context[order[starts]]
            at = bucket_of(own, buckets)
            rows += [(int(at[x]), 0, packed_keys(own[x:y]), planes(held[x:y]), planes(outer[x:y]), planes(kinds[x:y]), gain[x:y].tobytes()) for x, y in _edges(at)]
        often = n >= least
        rows += _sizes(joint(context[often], up[often]), n[often], m[often], buckets)
    return pa.Table.from_batches([_batch(rows, SUMS)]) if rows else pa.table({c: pa.array([], t) for c, t in SUMS.items()})


def _sizes(key: np.ndarray, n: np.ndarray, outer: np.ndarray, buckets: int) -> list[tuple]:
    order, key = sorting(key)
    n, outer = n[order], outer[order]
    at = bucket_of(key, buckets)
    return [(int(at[x]), 1, packed_keys(key[x:y]), planes(n[x:y]), planes(outer[x:y]), b"", b"") for x, y in _edges(at)]


def _token_sizes(batches: Iterable[pa.RecordBatch], buckets: int, least: int, total: int) -> Iterator[pa.RecordBatch]:
    for key, n in gathered(_counted(batches)):
        rows = _sizes(key[n >= least], n[n >= least], np.full((n >= least).sum(), total), buckets)
        if rows:
            yield _batch(rows, SUMS)


def _tested(table: pa.Table, strict: float) -> pa.Table:
    """The contexts of a bucket that pass the divergence test."""
    sizes, sums = (table.filter(pa.array(table.column("kind").to_numpy() == k)) for k in (1, 0))
    keys, size, outer = from_packed_keys(sizes.column("keys").to_pylist()), _numbers(sizes, "n"), _numbers(sizes, "outer")
    order, keys = sorting(keys)
    size, outer = size[order], outer[order]
    context = from_packed_keys(sums.column("keys").to_pylist())
    found = _NONE, np.zeros(0, np.int64)
    if len(keys) and len(context):
        order, starts = grouped(context)
        context = context[order[starts]]
        held, shorter, kinds, gain = (np.add.reduceat(x[order], starts) for x in (*(_numbers(sums, c) for c in ("n", "outer", "kinds")), _arrays(sums, "gain", np.float64)))
        at = np.minimum(places(keys, context), len(keys) - 1)
        some = keys[at] == context
        at, context, held, shorter, kinds, gain = at[some], context[some], held[some], shorter[some], kinds[some], gain[some]
        size, outer = size[at], outer[at]
        rest = size - held
        # likelihood ratio statistic of the counts, and what they leave over, against the suffix's shares
        gain = gain + held * (np.log(outer) - np.log(size))
        left = np.where(rest > 0, rest * np.log(np.maximum(rest, 1) / size / np.maximum(1 - shorter / outer, 1e-9)), 0.0)
        passed = 2 * (gain + left) > strict * (kinds + 1) * np.log(size)
        found = context[passed], rest[passed]
    return pa.table({"keys": [packed_keys(found[0])], "n": [planes(found[1])], "kinds": [len(found[0])]})


def retained(tokens: DataFrame, sequences: DataFrame, hot: tuple[np.ndarray, np.ndarray], total: int, buckets: int, least: int, strict: float) -> DataFrame:
    """keys, and as n what the counts of their next symbols leave over, of the contexts that the divergence test retains;
    packed, with their number (kinds)."""
    shared = tokens.sparkSession.sparkContext.broadcast(hot)
    # the rows between two rounds of buckets go with the square of their number
    some = -(-buckets // 8)
    told = "bucket long, kind int, keys binary, contexts binary, n binary"
    rows = tokens.mapInArrow(lambda it: _tell_counts(it, shared, some), told).unionByName(sequences.mapInArrow(lambda it: _tell_counts(it, shared, some), told))
    rows = rows.unionByName(sequences.mapInArrow(lambda it: _ask_suffixes(it, shared, some), told))
    schema = "bucket long, kind int, keys binary, n binary, outer binary, kinds binary, gain binary"
    sums = rows.groupBy("bucket").applyInArrow(lambda t: _sums(t, some, least), schema)
    sums = sums.unionByName(tokens.mapInArrow(lambda it: _token_sizes(it, some, least, total), schema))
    return sums.groupBy("bucket").applyInArrow(lambda t: _tested(t, strict), "keys binary, n binary, kinds long")


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 7 == 2


def asked_places(seq: Sequences, bits: tuple[np.ndarray, np.ndarray], depth: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each context length: places of tokens and keys of their sequences, where the bitmaps of counted sequences and of
    retained contexts let them pass."""
    counted, kept = bits
    found = []

    def asks(at: np.ndarray, context: np.ndarray, key: np.ndarray, may: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at, context, key = at[may], context[may], key[may]
        may = may_hold(kept, context)
        rest = np.flatnonzero(~may)
        may[rest] = may_hold(kept, key[rest])
        return at[may], key[may]

    def goes_on(k: int, at: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        may = may_hold(counted, key)
        found.append((key, may))
        return may, may

    before = None
    for at, context, up in seq.levels(depth, goes_on):
        if before:
            yield asks(*before, *found.pop())
        before = at, context
    if before:
        key = joint(context, up)
        yield asks(*before, key, may_hold(counted, key))


def asked_keys(seq: Sequences, levels: Iterable[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The sorted keys that a part asks for, by its asked_places."""
    return distinct_keys(np.concatenate([seq.distinct, *(key for _, key in levels)]))


def check_sum(keys: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(keys.tobytes()) - 2**63


def _ask(batches: Iterable[pa.RecordBatch], shared, buckets: int, depth: int) -> Iterator[pa.RecordBatch]:
    """The keys of each block of a partition, by buckets; blocks come sorted."""
    block, found = None, []

    def tell() -> pa.RecordBatch:
        keys = distinct_keys(np.concatenate(found))
        at = bucket_of(keys, buckets)
        rows = [(block, int(at[x]), packed_keys(keys[x:y])) for x, y in _edges(at)]
        return _batch(rows, {"block": pa.int64(), "bucket": pa.int64(), "keys": pa.binary()})

    for batch in batches:
        for b, seq in zip(column(batch, "block").to_pylist(), _parts(batch)):
            if b != block:
                if found:
                    yield tell()
                block, found = b, []
            found.append(asked_keys(seq, asked_places(seq, shared.value, depth)))
    if found:
        yield tell()
    found.clear()
    _give_back()


def _pack(batches: Iterable[pa.RecordBatch], kind: int, buckets: int) -> Iterator[pa.RecordBatch]:
    """Keys and values by buckets."""
    for key, value in gathered(_counted(batches)):
        order, key = sorting(key)
        value, at = value[order], bucket_of(key, buckets)
        rows = [(int(at[x]), kind, packed_keys(key[x:y]), planes(value[x:y])) for x, y in _edges(at)]
        yield _batch(rows, {"bucket": pa.int64(), "kind": pa.int32(), "keys": pa.binary(), "values": pa.binary()})


def _known(table: pa.Table) -> pa.Table:
    """A bucket's sorted keys, their counts, and one more than what retained contexts' counts leave over, 0 for others."""
    kind = table.column("kind").to_numpy()
    counts, kept = (table.filter(pa.array(kind == k)) for k in (0, 1))
    order, keys = sorting(from_packed_keys(counts.column("keys").to_pylist()))
    rest = np.zeros(len(keys), np.int64)
    # a retained context is counted itself
    rest[np.searchsorted(keys, from_packed_keys(kept.column("keys").to_pylist()))] = _numbers(kept, "values") + 1
    return pa.table({"bucket": table.column("bucket").slice(0, 1), "keys": [packed_keys(keys)], "n": [planes(_numbers(counts, "values")[order])], "rest": [planes(rest)]})


def _answers(asked: pa.Table, known: pa.Table) -> pa.Table:
    """What is known of a bucket's keys: counts, and one more than what retained contexts' counts leave over, 0 for others."""
    keys = from_packed_keys(known.column("keys").to_pylist())
    tables = [_numbers(known, c) for c in ("n", "rest")]
    out = []
    for block, bucket, blob in zip(*(asked.column(c).to_pylist() for c in ("block", "bucket", "keys"))):
        wanted = from_packed_keys([blob])
        found = [np.zeros(len(wanted), np.int64) for _ in tables]
        if len(keys):
            at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
            same = keys[at] == wanted
            found = [np.where(same, values[at], 0) for values in tables]
        out.append((block, bucket, check_sum(wanted), *(planes(x) for x in found)))
    schema = {"block": pa.int64(), "bucket": pa.int64(), "sum": pa.int64(), "n": pa.binary(), "rest": pa.binary()}
    return pa.Table.from_batches([_batch(out, schema)]) if out else pa.table({c: pa.array([], t) for c, t in schema.items()})


class Tree:
    """What the tree says of a block's sequences, by the places of their sorted keys: counts, and for retained contexts what
    the counts of their next symbols leave over, else -1; with training's number of tokens, all and those seen once."""

    def __init__(self, n: np.ndarray, rest: np.ndarray, total: int, once: int):
        self.n, self.rest, self.total = n, rest, total
        self.unseen = (once + 1) / (total + 2) if total else 1.0

    def probabilities(self, seq: Sequences, tokens: np.ndarray, levels: Iterable[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """Those of a part's tokens, by the places of its distinct ones among the keys; levels: for each context length, the
        asked_places with the keys' places."""
        n = self.n[tokens]
        p = np.where(n > 0, n / max(self.total, 1) * (1 - self.unseen), self.unseen)[seq.codes]
        first = np.ones(len(p) + 1, bool)
        first[:-1] = False
        first[seq.starts] = True
        # where sequences of the current length end that are retained contexts, and their places
        end = np.flatnonzero((self.rest[tokens] >= 0)[seq.codes] & ~first[1:])
        own = tokens[seq.codes[end]]
        for at, place in levels:
            seen = np.zeros(len(p))
            seen[at] = self.n[place]
            i = end + 1
            p[i] = (seen[i] + (self.rest[own] + STRENGTH) * p[i]) / (self.n[own] + STRENGTH)
            some = np.flatnonzero((self.rest[place] >= 0) & ~first[1:][at])
            end, own = at[some], place[some]
        return p


def _scores(docs: pa.Table, known: pa.Table, total: int, distinct: int, once: int, shared, depth: int) -> pa.Table:
    _give_back()
    ids, parts = [x.values for x in docs.column("doc_ids").combine_chunks()], _parts(docs)
    del docs
    asked, own = [], []
    for seq in parts:
        levels = list(asked_places(seq, shared.value, depth))
        at, ends = [x for x, _ in levels], np.cumsum([len(seq.distinct), *(len(x) for x, _ in levels)])
        keys = np.concatenate([seq.distinct, *(key for _, key in levels)])
        del levels
        keys, place = distinct_places(keys)
        own.append(keys)
        asked.append((place, ends, at))
    keys = distinct_keys(np.concatenate(own))
    known = known.sort_by("bucket")
    ends = np.cumsum([0, *(n_planes(x) for x in known.column("n").to_pylist())])
    if ends[-1] != len(keys) or [check_sum(keys[a:b]) for a, b in zip(ends[:-1], ends[1:])] != known.column("sum").to_pylist():
        raise RuntimeError("answers are not those to the keys that were asked for")
    for k, (place, ends, at) in enumerate(asked):
        asked[k], own[k] = (np.searchsorted(keys, own[k]).astype(np.int32)[place], ends, at), None
    del keys, place
    tree = Tree(_numbers(known, "n").astype(np.float64), (_numbers(known, "rest") - 1).astype(np.float64), total, once)
    del known
    out = []
    while parts:
        seq, (place, ends, at) = parts.pop(), asked.pop()
        tokens, *levels = np.split(place, ends[:-1])
        count = tree.n[tokens]
        base = np.log10(count + 1.0) - np.log10(total + distinct + 1.0)
        p = tree.probabilities(seq, tokens, zip(at, levels))
        sums = (segment_sums((count > 0).astype(np.int64)[seq.codes], seq.starts), np.add.reduceat(base[seq.codes], seq.starts[:-1]), np.add.reduceat(np.log10(p), seq.starts[:-1]))
        out.append(pa.table({"doc_id": ids.pop(), "n_tokens": np.diff(seq.starts), "n_known": sums[0], "base_score": sums[1], "score": sums[2]}))
    del seq, place, at, levels, p, tree
    _give_back()
    return pa.concat_tables(out)


@contextlib.contextmanager
def _workers_of_its_own(spark: SparkSession) -> Iterator[None]:
    """Python functions made meanwhile run in workers with WORKER_MEMORY; others keep theirs."""
    env = spark.sparkContext.environment
    before = dict(env)
    env.update(WORKER_MEMORY)
    try:
        yield
    finally:
        env.clear()
        env.update(before)


def lm_scores(docs: DataFrame, depth: int = 5, least: int = 8, entry_least: int = 2, strict: float = 1.0) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row of docs (doc_id, text)."""
    with _workers_of_its_own(docs.sparkSession):
        return _lm_scores(docs, depth, least, entry_least, strict)


def _lm_scores(docs: DataFrame, depth: int, least: int, entry_least: int, strict: float) -> DataFrame:
    spark = docs.sparkSession
    docs = docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text")
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets, n_blocks = max(1, -(-size // (TOKEN_BYTES * BUCKET))), max(1, -(-size // BLOCK_BYTES))
    marked = docs.withColumn("train", ~held_out(docs["doc_id"]))
    blocks = materialize(marked.mapInArrow(lambda it: _coded(it, n_blocks), "block long, doc_ids array<long>, train binary, lengths binary, distinct binary, codes binary"), "blocks")
    tokens = blocks.select("train", "lengths", "distinct", "codes").mapInArrow(lambda it: _token_counts(it, buckets), "bucket long, keys binary, n binary")
    tokens = tokens.groupBy("bucket").applyInArrow(lambda t: _tokens(t, least, entry_least), "keys binary, n binary, often long, kinds long, total long, distinct long, once long")
    tokens = materialize(tokens, "tokens")
    release(spark)
    total, distinct, once = (x or 0 for x in tokens.agg(F.sum("total"), F.sum("distinct"), F.sum("once")).first())
    sequences, number, hot = count_sequences(blocks, tokens, total, buckets, depth, least, entry_least)
    kept = materialize(retained(tokens, sequences, hot, total, buckets, least, strict), "contexts")
    # Spark holds on to the last job's shuffle files until another one has run
    contexts = kept.agg(F.sum("kinds")).first()[0] or 0
    release(spark)
    bits = bitmap(sequences, 0, number), bitmap(kept, 0, contexts)
    shared = spark.sparkContext.broadcast(bits)
    packed = "bucket long, kind int, keys binary, values binary"
    known = tokens.mapInArrow(lambda it: _pack(it, 0, buckets), packed).unionByName(sequences.mapInArrow(lambda it: _pack(it, 0, buckets), packed))
    known = known.unionByName(kept.mapInArrow(lambda it: _pack(it, 1, buckets), packed))
    known = known.groupBy("bucket").applyInArrow(_known, "bucket long, keys binary, n binary, rest binary")
    known = materialize(known, "known")
    known.count()
    release(spark)
    schema = "doc_id long, n_tokens long, n_known long, base_score double, score double"
    rounds, out = min(ROUNDS, n_blocks), None
    for r in range(rounds):
        some = blocks.where(F.col("block") % rounds == r).repartition(max(-(-n_blocks // rounds), spark.sparkContext.defaultParallelism), "block")
        asked = some.sortWithinPartitions("block").mapInArrow(lambda it: _ask(it, shared, buckets, depth), "block long, bucket long, keys binary")
        answers = asked.groupBy("bucket").cogroup(known.groupBy("bucket")).applyInArrow(_answers, "block long, bucket long, sum long, n binary, rest binary")
        scores = some.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(lambda d, k: _scores(d, k, total, distinct, once, shared, depth), schema)
        scores = materialize(scores, "scores")
        out = scores if out is None else out.unionByName(scores)
        scores.count()
        release(spark)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score")
