"""Benchmark decontamination.

Seeds are three words of the test items, side by side or with one word left out between, that chance would seldom put
together: the product of the words' shares of all documents' words is low, whatever their number. A seed is not rare or
common by how often it is itself found, so an item that has leaked into thousands of documents keeps its seeds. Passages
with a seed are then aligned with the item by Smith-Waterman over words, which scores copies with words changed, put in or
left out.

Words are lower-cased and lose marks at their ends; words of marks alone are skipped. The items are taken in blocks of a
checked size, each against all documents; no text is shuffled. An item without words, and a null or empty text or item,
matches nothing; an item of one or two words is not long enough to tell a leak from chance and matches nothing.
Repeated documents and repeated items match each; of equal passages the first is reported; other columns are ignored.
"""

from __future__ import annotations

import string
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from frameloom.llm.common import Words, column, slices

SEED = 3
#: Places of a seed's words: a copy with every third word changed keeps some with a word left out.
SHAPES = ((0, 1, 2), (0, 1, 3), (0, 2, 3))
#: Marks that words lose at their ends.
MARKS = string.punctuation + "«»“”„‘’…–—¡¿"
MATCH, MISMATCH, GAP = 2, -1, -1
RESULT = "doc_id long, item_id long, score double, first_word long, last_word long"


def plain(word: str) -> str:
    return word.lower().strip(MARKS)


class Items:
    """A block of test items as word numbers, with their seeds."""

    def __init__(self, rows: list[tuple[int, str | None]]):
        self.vocab: dict[str, int] = {}
        self.ids, self.words = [], []
        for item_id, text in rows:
            ws = [p for w in (text or "").encode().split() if (p := plain(w.decode()))]
            if len(ws) >= SEED:
                self.ids.append(item_id)
                self.words.append(np.array([self.vocab.setdefault(w, len(self.vocab)) for w in ws], np.int64))
        self.keys = np.zeros(0, np.uint64)
        self.where: list[list[tuple[int, int]]] = []
        self.gate = np.zeros(len(self.vocab) + 1, bool)

    def seed(self, counts: np.ndarray, total: int, chance: float, least: int) -> Items:
        """Chooses seeds: those of which a place has the words by chance at most at a rate of `chance`, and the `least` rarest
        of each item and shape in any case."""
        share = np.log(np.maximum(counts, 1)) - np.log(max(total, 1))
        found: dict[int, list[tuple[int, int]]] = {}
        for k, w in enumerate(self.words):
            for number, shape in enumerate(SHAPES):
                keys = seed_keys(w, number)
                rate = sum(share[w[o : o + len(keys)]] for o in shape)
                rare = np.argsort(rate, kind="stable")[:least]
                for i in sorted({*np.flatnonzero(rate <= np.log(chance)).tolist(), *rare.tolist()}):
                    found.setdefault(int(keys[i]), []).append((k, i))
                    self.gate[w[i]] = True
        self.keys = np.array(sorted(found), np.uint64)
        self.where = [found[k] for k in self.keys.tolist()]
        return self


def seed_keys(words: np.ndarray, number: int) -> np.ndarray:
    """A number for each seed of a shape; alignment checks what two share by chance."""
    n = max(len(words) - SHAPES[number][-1], 0)
    return mixed(*(words[o : o + n] for o in SHAPES[number]), number)


def mixed(a: np.ndarray, b: np.ndarray, c: np.ndarray, number: int) -> np.ndarray:
    mix = np.uint64(0x9E3779B97F4A7C15)
    a, b, c = (x.astype(np.uint64) + np.uint64(1) for x in (a, b, c))
    return (((a * mix ^ b) * mix ^ c) * mix ^ np.uint64(number)) * mix


def align(item: np.ndarray, passage: np.ndarray) -> tuple[int, int, int]:
    """Best local alignment: its score, and the passage's first and last word in it. Of equals the first end counts."""
    n, at = len(passage), np.arange(len(passage), dtype=np.int64)
    score, begin = np.zeros(n, np.int64), at.copy()
    best = (0, 0, 0)
    for w in item.tolist():
        step = np.where(passage == w, MATCH, MISMATCH)
        diagonal, diagonal_begin = np.empty(n, np.int64), np.empty(n, np.int64)
        diagonal[0], diagonal_begin[0] = step[0], 0
        diagonal[1:] = score[:-1] + step[1:]
        diagonal_begin[1:] = np.where(score[:-1] > 0, begin[:-1], at[1:])
        up = score + GAP
        new = np.maximum(diagonal, up)
        new_begin = np.where(diagonal >= up, diagonal_begin, begin)
        # gaps in the item: the best of all cells to the left less the words between
        lifted = new - GAP * at
        top = np.maximum.accumulate(lifted)
        source = np.maximum.accumulate(np.where(lifted == top, at, 0))
        along = top + GAP * at
        begin = np.where(along > new, new_begin[source], new_begin)
        score = np.maximum(np.maximum(new, along), 0)
        k = int(score.argmax())
        if score[k] > best[0]:
            best = (int(score[k]), int(begin[k]), k)
    return best


def _tally(batches: Iterable[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    items: Items = shared.value
    counts, total = np.zeros(len(items.vocab) + 1, np.int64), 0
    for batch in slices(batches):
        words = Words(column(batch, "text"))
        numbers = np.array([items.vocab.get(plain(w), len(items.vocab)) for w in words.distinct], np.int64)
        counts += np.bincount(numbers[words.codes], minlength=len(counts)) if len(words.codes) else 0
        total += len(words.codes)
    seen = np.flatnonzero(counts[:-1])
    yield pa.RecordBatch.from_arrays([pa.array(np.append(seen, -1)), pa.array(np.append(counts[seen], total))], names=["word", "n"])


def hits(texts: pa.Array, items: Items, threshold: float, passage: int) -> Iterator[tuple[int, int, float, int, int]]:
    """Row, item, score and first and last word of each text's best passage for each item that it matches."""
    none, skip = len(items.vocab), -1
    words = Words(texts)
    numbers = np.fromiter((items.vocab.get(p, none) if (p := plain(w)) else skip for w in words.distinct), np.int64, len(words.distinct))
    seq = numbers[words.codes]
    real = np.flatnonzero(seq != skip)
    starts = np.searchsorted(real, words.starts)
    seq = seq[real]
    if len(seq) < SEED or not len(items.keys):
        return
    heads = np.flatnonzero(items.gate[seq])
    places: dict[tuple[int, int], list[int]] = {}
    for number, shape in enumerate(SHAPES):
        at = heads[heads < len(seq) - shape[-1]]
        at = at[(seq[at + shape[1]] != none) & (seq[at + shape[2]] != none)]
        keys = mixed(*(seq[at + o] for o in shape), number)
        slot = np.minimum(np.searchsorted(items.keys, keys), len(items.keys) - 1)
        hit = items.keys[slot] == keys
        at, slot = at[hit], slot[hit]
        doc = np.searchsorted(starts, at, side="right") - 1
        inside = at + shape[-1] < starts[doc + 1]
        for p, s, d in zip(at[inside].tolist(), slot[inside].tolist(), doc[inside].tolist()):
            for k, i in items.where[s]:
                places.setdefault((d, k), []).append(p - i)
    for (d, k), begins in places.items():
        item, low, high = items.words[k], int(starts[d]), int(starts[d + 1])
        best = (0, 0, 0)
        for first, last in clusters(sorted(begins), len(item)):
            a, b = max(low, first - len(item) // 2), min(high, last + len(item) * 3 // 2)
            score, x, y = align(item, seq[a:b])
            if score > best[0]:
                best = (score, a + x, a + y)
        if best[0] >= MATCH * min(threshold * len(item), passage):
            yield d, items.ids[k], best[0] / (MATCH * len(item)), int(real[best[1]] - words.starts[d]), int(real[best[2]] - words.starts[d])


def _search(batches: Iterable[pa.RecordBatch], shared, threshold: float, passage: int) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        found = list(hits(column(batch, "text"), shared.value, threshold, passage))
        if found:
            rows, *rest = zip(*found)
            yield pa.RecordBatch.from_arrays([column(batch, "doc_id").take(pa.array(rows)), *(pa.array(x, t) for x, t in zip(rest, (pa.int64(), pa.float64(), pa.int64(), pa.int64())))], names=["doc_id", "item_id", "score", "first_word", "last_word"])


def _clean(batches: Iterable[pa.RecordBatch], shared, threshold: float, passage: int) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        keep = np.ones(batch.num_rows, bool)
        keep[[h[0] for h in hits(column(batch, "text"), shared.value, threshold, passage)]] = False
        yield batch.filter(pa.array(keep))


def clusters(begins: list[int], reach: int) -> Iterator[tuple[int, int]]:
    """Runs of begins of which each follows the one before within reach."""
    first = last = begins[0]
    for b in begins[1:]:
        if b - last > reach:
            yield first, last
            first = b
        last = b
    yield first, last


def blocks(benchmark: DataFrame, block_chars: int) -> Iterator[list[tuple[int, str]]]:
    """The items in the order of their ids, in lists of about block_chars characters, none of them cut."""
    rows, size = [], 0
    for r in benchmark.select(benchmark["item_id"].cast("long").alias("item_id"), "text").orderBy("item_id", "text").toLocalIterator():
        rows.append((r["item_id"], r["text"]))
        size += len(r["text"] or "")
        if size >= block_chars:
            yield rows
            rows, size = [], 0
    if rows:
        yield rows


def prepared(docs: DataFrame, benchmark: DataFrame, chance: float, least: int, block_chars: int) -> Iterator:
    """Blocks of items with their seeds, broadcast one at a time."""
    spark, texts = docs.sparkSession, docs.select("text")
    for rows in blocks(benchmark, block_chars):
        items = Items(rows)
        if not items.ids:
            continue
        first = spark.sparkContext.broadcast(items)
        tallied = texts.mapInArrow(lambda it, b=first: _tally(it, b), "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
        counts, total = np.zeros(len(items.vocab), np.int64), 0
        for r in tallied:
            if r["word"] < 0:
                total = r["n"]
            else:
                counts[r["word"]] = r["n"]
        yield spark.sparkContext.broadcast(items.seed(counts, total, chance, least))


def contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.5, passage: int = 15, chance: float = 1e-8, least: int = 4, block_chars: int = 8_000_000) -> DataFrame:
    """doc_id, item_id, score (1: every word of the item in order), first_word and last_word of the passage, for each
    document (doc_id, text) with a passage that scores at least `threshold` against an item (item_id, text), or as much as
    `passage` words of it in order."""
    texts = docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text")
    found = docs.sparkSession.createDataFrame([], RESULT)
    for shared in prepared(docs, benchmark, chance, least, block_chars):
        found = found.unionByName(texts.mapInArrow(lambda it, b=shared: _search(it, b, threshold, passage), RESULT))
    return found


def clean(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.5, passage: int = 15, chance: float = 1e-8, least: int = 4, block_chars: int = 8_000_000) -> DataFrame:
    """The rows of docs, with all their columns, that contaminated() doesn't find."""
    out = docs
    for shared in prepared(docs, benchmark, chance, least, block_chars):
        out = out.mapInArrow(lambda it, b=shared: _clean(it, b, threshold, passage), docs.schema)
    return out
