"""Phrases whose words go together: counted by a count-min sketch first, exactly where the sketch leaves a chance.

Texts become blocks of tokens of one language, cut at a fixed size whatever the length of a text, and written once. For
each of two rounds (words and pairs; then three to five words, of which every pair may be frequent) a block sends the
cells of its distinct phrases with their counts, in pieces by range of cells. A range's pieces are merged by adding them
up, and each piece gets back which of its cells reach the bar. A sketch never counts too little, so a phrase with a cell
below the bar in either row is not frequent, and none that is gets lost. Blocks then count the survivors word by word,
and these counts are added up exactly. Cells follow the number of words, so the sketch doesn't fill up as data grows; it
lies in ranges of a fixed size and is never held, sent or broadcast as a whole, and phrases in a third of all rows
arrive as one count a block.

Null texts count as empty and null languages as `und`; empty texts, or none, give no phrases; repeated rows count each;
columns other than text and lang are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from frameloom.llm.common import column, materialize, slices
from frameloom.llm.suffix_tree import token_hashes

#: White space between words, and what ends a piece.
BLANKS, ENDS = b" \t", b".,;:!?\n\x0b\x0c\r"
KIND = np.zeros(256, np.uint8)
KIND[list(BLANKS)], KIND[list(ENDS)] = 1, 2
LONGEST = 5
#: Sizes of phrases that a round sketches.
ROUNDS = ((1, 2), (3, 4, 5))
#: Bytes of text of one language that make a block, tokens of one at most, and bytes that a task gathers over all languages.
BLOCK_BYTES, BLOCK_TOKENS, HELD_BYTES = 4 << 20, 1 << 20, 24 << 20
#: Words for each cell of a row of the sketch, and cells of a range, as a power of two.
LOAD, RANGE = 16, 18
#: Words for each part of the exact counts, as a power of two.
PART = 20
ROWS = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))
BLOCK = "block long, lang string, n long, words binary, codes binary"


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


def tokenized(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Distinct words of texts, and the places of all words among them in order, with a -1 before each piece."""
    texts = pc.ascii_lower(pc.fill_null(texts, ""))
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = texts.buffers()[2]
    kind = KIND[np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]]] if data is not None else np.zeros(0, np.uint8)
    flat = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else kind
    begins = offsets[:-1] - offsets[0]
    first = np.zeros(len(kind), bool)
    first[begins[begins < len(kind)]] = True
    word = kind == 0
    start = word & first
    start[1:] |= word[1:] & ~word[:-1]
    at = np.flatnonzero(start)
    # without what parts them words lie side by side
    before = np.cumsum(word, dtype=np.int32)
    ends = np.append(before[at] - 1, before[-1:]).astype(np.int32)
    if not len(at):
        return pa.array([], pa.string()), np.zeros(0, np.int32)
    encoded = pa.Array.from_buffers(pa.string(), len(at), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(flat[word].tobytes())]).dictionary_encode()
    piece = np.cumsum((kind == 2) | first, dtype=np.int32)[at]
    codes = encoded.indices.to_numpy(zero_copy_only=False).astype(np.int32)
    breaks = np.flatnonzero(np.append(True, piece[1:] != piece[:-1]))
    return encoded.dictionary, np.insert(codes, breaks, np.int32(-1))


def _blocks(batches: Iterable[pa.RecordBatch], tokens: int) -> Iterator[pa.RecordBatch]:
    """Blocks of tokens; one that cuts a piece ends with the tokens that its last phrases reach into."""
    held: dict[str, list[pa.Array]] = {}
    sizes: dict[str, int] = {}
    made = TaskContext.get().partitionId() << 32

    def packed(lang: str) -> Iterator[pa.RecordBatch]:
        nonlocal made
        words, codes = tokenized(pa.concat_arrays(held.pop(lang)))
        del sizes[lang]
        for a in range(0, len(codes), tokens):
            own, part = codes[a : a + tokens], codes[a : a + tokens + LONGEST - 1]
            # of this part's words alone
            used, places = np.unique(part, return_inverse=True)
            inner = used[used >= 0]
            block = pa.array([b" ".join(words.take(pa.array(inner)).cast(pa.binary()).to_pylist())], pa.binary())
            places = (places - (len(used) - len(inner))).astype(np.int32)
            n = int((own >= 0).sum())
            yield pa.RecordBatch.from_arrays([pa.array([made]), pa.array([lang]), pa.array([n]), block, pa.array([np.append(np.int32(len(own)), places).tobytes()], pa.binary())], names=["block", "lang", "n", "words", "codes"])
            made += 1

    for batch in batches:
        for part in slices([batch], size=BLOCK_BYTES):
            langs = pc.fill_null(column(part, "lang"), "und")
            for lang in pc.unique(langs).to_pylist():
                texts = column(part, "text").filter(pc.equal(langs, lang))
                held.setdefault(lang, []).append(texts)
                sizes[lang] = sizes.get(lang, 0) + int(pc.sum(pc.binary_length(texts)).as_py() or 0) + 1
                if sizes[lang] >= BLOCK_BYTES:
                    yield from packed(lang)
            while sum(sizes.values()) >= HELD_BYTES:
                yield from packed(max(sizes, key=sizes.__getitem__))
    for lang in list(held):
        yield from packed(lang)


class Phrases:
    """Distinct phrases of a block, of one number of words each: keys, counts, and where each is first."""

    def __init__(self, lang: str, words: bytes, codes: bytes):
        self.words = words.split(b" ") if words else []
        every = np.frombuffer(codes, np.int32)
        self.own, self.codes = int(every[0]), every[1:]
        seed = token_hashes(pa.array([lang]))
        self.hashes = _mixed(token_hashes(pa.array(self.words, pa.binary()).cast(pa.string())) ^ seed) if self.words else np.zeros(0, np.uint64)
        self._held: dict[int, tuple] = {}

    def starts(self, size: int, pairs: np.ndarray | None) -> np.ndarray:
        """Places where a phrase of so many words stands within a piece, all pairs in which may be frequent."""
        n = min(self.own, len(self.codes) - size + 1)
        if n <= 0:
            return np.zeros(0, np.int64)
        fit = np.ones(n, bool)
        for i in range(size):
            fit &= self.codes[i : i + n] >= 0
        for i in range(size - 1) if pairs is not None and size > 1 else ():
            fit &= pairs[i : i + n]
        return np.flatnonzero(fit)

    def counted(self, size: int, pairs: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Keys, first places, counts, and of all starts the place among these, with the starts' own order kept apart."""
        if size in self._held:
            return self._held[size]
        at = self.starts(size, pairs)
        keys = self.hashes[self.codes[at]]
        for i in range(1, size):
            keys = _mixed(keys * np.uint64(0x9FB21C651E98DF25) + self.hashes[self.codes[at + i]])
        distinct, first, which, counts = np.unique(keys, return_index=True, return_inverse=True, return_counts=True)
        same = at[first][which]
        if any((self.codes[at + i] != self.codes[same + i]).any() for i in range(size)):
            # two phrases with one hash: told apart by their words, both with that key
            _, first, which, counts = np.unique(np.column_stack([self.codes[at + i] for i in range(size)]), axis=0, return_index=True, return_inverse=True, return_counts=True)
            distinct, which = keys[first], which.ravel()
        self._held[size] = distinct, at[first], counts, (at, which)
        return self._held[size]

    def pair_places(self, frequent: np.ndarray) -> np.ndarray:
        """For each token whether a pair that may be frequent starts there; frequent: of the distinct pairs."""
        _, _, _, (at, which) = self.counted(2)
        out = np.zeros(len(self.codes) + LONGEST, bool)
        out[at] = frequent[which]
        # pairs of what a block only reaches into are judged by the block that they start in
        out[self.own :] = True
        return out

    def text(self, place: int, size: int) -> str:
        return b" ".join(self.words[c] for c in self.codes[place : place + size]).decode()


def cells_of(keys: np.ndarray, bits: int) -> list[np.ndarray]:
    """A cell of each row of the sketch for each key; rows lie one after the other."""
    return [(_mixed(keys * row) >> np.uint64(64 - bits)).astype(np.int64) + (i << bits) for i, row in enumerate(ROWS)]


def added(cells: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct cells in order, with sums of counts."""
    order = np.argsort(cells, kind="stable")
    cells, counts = cells[order], counts[order]
    edges = np.flatnonzero(np.append(True, cells[1:] != cells[:-1])) if len(cells) else np.zeros(0, np.int64)
    return cells[edges], np.add.reduceat(counts, edges) if len(edges) else counts


def small(values: np.ndarray) -> bytes:
    """Numbers in as few bytes as the greatest takes, and how many that are."""
    kind = np.min_scalar_type(int(values.max())) if len(values) else np.dtype(np.uint8)
    return bytes([kind.itemsize]) + values.astype(kind).tobytes()


def from_small(blob: bytes) -> np.ndarray:
    return np.frombuffer(blob, f"<u{blob[0]}", offset=1).astype(np.int64)


def ranges(cells: np.ndarray) -> list[tuple[int, int, int]]:
    """Ranges of cells that sorted cells lie in, and from where to where."""
    which = cells >> RANGE
    edges = [0, *(np.flatnonzero(np.diff(which)) + 1).tolist(), len(cells)]
    return [(int(which[a]), a, b) for a, b in zip(edges, edges[1:]) if b > a]


def sketch_entries(phrases: Phrases, sizes: tuple[int, ...], bits: int, pairs: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """A block's own sketch: cells that are not 0, and what they hold."""
    found = [phrases.counted(size, pairs) for size in sizes]
    return added(np.concatenate([c for keys, *_ in found for c in cells_of(keys, bits)]), np.concatenate([n for _, _, n, _ in found for _ in ROWS]))


class Replies:
    """Which cells of a block's sketch reach the bar once all sketches are merged."""

    def __init__(self, cells: np.ndarray, replies: list[tuple[int, bytes]]):
        said = dict(replies)
        self.cells, self.full = cells, np.zeros(len(cells), bool)
        for at, a, b in ranges(cells):
            if at in said:
                self.full[a:b] = np.unpackbits(np.frombuffer(said[at], np.uint8), count=b - a).astype(bool)

    def frequent(self, keys: np.ndarray, bits: int) -> np.ndarray:
        """Whether the least of a key's cells reaches the bar."""
        return np.logical_and.reduce([self.full[np.searchsorted(self.cells, c)] for c in cells_of(keys, bits)])


def judged(phrases: Phrases, replies: list[list[tuple[int, bytes]]], bits: int) -> tuple[dict[int, np.ndarray], np.ndarray | None]:
    """Of each round with replies, which distinct phrases may be frequent, and the pairs' places."""
    out: dict[int, np.ndarray] = {}
    pairs = None
    for sizes, said in zip(ROUNDS, replies):
        full = Replies(sketch_entries(phrases, sizes, bits, pairs)[0], said)
        out |= {size: full.frequent(phrases.counted(size, pairs)[0], bits) for size in sizes}
        pairs = phrases.pair_places(out[2]) if pairs is None else pairs
    return out, pairs


def _rows(batch: pa.RecordBatch, rounds: int) -> Iterator[tuple[int, Phrases, list[list[tuple[int, bytes]]]]]:
    cols = [column(batch, c) for c in ("block", "lang", "words", "codes")]
    said = column(batch, "replies") if rounds else None
    for i in range(batch.num_rows):
        block, lang, words, codes = (c[i].as_py() for c in cols)
        rows = (said[i].as_py() or []) if rounds else []
        yield block, Phrases(lang, words, codes), [[(r["range"], r["full"]) for r in rows if r["round"] == k] for k in range(rounds)]


def _sketches(batches: Iterable[pa.RecordBatch], k: int, bits: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for block, phrases, replies in _rows(batch, k):
            _, pairs = judged(phrases, replies, bits)
            cells, counts = sketch_entries(phrases, ROUNDS[k], bits, pairs)
            parts = [(at, small(np.diff(cells[a:b], prepend=at << RANGE)), small(counts[a:b])) for at, a, b in ranges(cells)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([k] * len(parts), pa.int32()), pa.array([p[0] for p in parts], pa.int64()), pa.array([block] * len(parts), pa.int64()), pa.array([p[1] for p in parts], pa.binary()), pa.array([p[2] for p in parts], pa.binary())],
                names=["round", "range", "block", "gaps", "counts"],
            )


def _merged(table: pa.Table, least: int) -> pa.Table:
    """One range: the sum of its pieces, and for each piece which of its cells reach the bar."""
    total, pieces = np.zeros(1 << RANGE, np.int64), []
    at = table.column("range")[0].as_py() << RANGE
    gaps, counts = table.column("gaps"), table.column("counts")
    for i in range(table.num_rows):
        cells = np.cumsum(from_small(gaps[i].as_py()))
        total[cells] += from_small(counts[i].as_py())
    full = total >= least
    for i in range(table.num_rows):
        mine = full[np.cumsum(from_small(gaps[i].as_py()))]
        pieces.append(np.packbits(mine).tobytes() if mine.any() else None)
    out = pa.table([table.column("round"), table.column("range"), table.column("block"), pa.array(pieces, pa.binary())], names=["round", "range", "block", "full"])
    return out.filter(pc.is_valid(out.column("full")))


def _survivors(batches: Iterable[pa.RecordBatch], bits: int, parts: int) -> Iterator[pa.RecordBatch]:
    """Counts of a block's phrases that may be frequent, as lists by part of all phrases."""
    for batch in batches:
        langs = column(batch, "lang")
        for i, (_, phrases, replies) in enumerate(_rows(batch, len(ROUNDS))):
            held, pairs = judged(phrases, replies, bits)
            texts, part, counts = [], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for size, frequent in held.items():
                keys, first, n, _ = phrases.counted(size, pairs)
                texts += [phrases.text(p, size) for p in first[frequent].tolist()]
                part.append((keys[frequent] % np.uint64(parts)).astype(np.int64))
                counts.append(n[frequent].astype(np.int64))
            part, counts = np.concatenate(part), np.concatenate(counts)
            order = np.argsort(part, kind="stable")
            at, starts = np.unique(part[order], return_index=True)
            edges = pa.array(np.append(starts, len(part)), pa.int32())
            lists = [pa.ListArray.from_arrays(edges, x) for x in (pa.array(texts, pa.string()).take(pa.array(order)), pa.array(counts[order]))]
            yield pa.RecordBatch.from_arrays([pa.array([langs[i].as_py()] * len(at), pa.string()), pa.array(at), *lists], names=["lang", "part", "phrases", "counts"])


def _summed(table: pa.Table, least: int) -> pa.Table:
    """Exact counts of one part of a language's phrases, of those that are frequent."""
    flat = lambda name: pc.list_flatten(table.column(name))
    sums = pa.table({"phrase": flat("phrases"), "n": flat("counts")}).group_by("phrase").aggregate([("n", "sum")])
    sums = sums.filter(pc.greater_equal(sums.column("n_sum"), least))
    size = pc.add(pc.count_substring(sums.column("phrase"), " "), 1).cast(pa.int32())
    return pa.table({"lang": pa.array([table.column("lang")[0].as_py()] * sums.num_rows, pa.string()), "phrase": sums.column("phrase"), "size": size, "a": sums.column("n_sum")})


def blocks(docs: DataFrame, tokens: int = BLOCK_TOKENS) -> DataFrame:
    """The texts' tokens in blocks of one language each, written to the shared folder."""
    return materialize(docs.select("text", "lang").mapInArrow(lambda batches: _blocks(batches, tokens), BLOCK), "blocks")


def frequent(held: DataFrame, least: int) -> DataFrame:
    """lang, phrase, size and a, its occurrences, of all phrases of one to five words with at least so many."""
    spark = held.sparkSession
    words = held.agg(F.sum("n")).first()[0] or 0
    bits = max(10, (words // LOAD).bit_length())
    replies = None
    for k in range(len(ROUNDS)):
        asked = with_replies(held, replies).mapInArrow(lambda batches, k=k: _sketches(batches, k, bits), "round int, range long, block long, gaps binary, counts binary")
        said = materialize(asked.groupBy("range").applyInArrow(lambda table: _merged(table, least), "round int, range long, block long, full binary"), "replies")
        replies = said if replies is None else replies.unionByName(said)
    parts = 1 + (words >> PART)
    counts = with_replies(held, replies).mapInArrow(lambda batches: _survivors(batches, bits, parts), "lang string, part long, phrases array<string>, counts array<long>")
    return counts.groupBy("lang", "part").applyInArrow(lambda table: _summed(table, least), "lang string, phrase string, size int, a long")


def with_replies(held: DataFrame, replies: DataFrame | None) -> DataFrame:
    """Blocks with what came back for them."""
    if replies is None:
        return held
    said = replies.groupBy("block").agg(F.collect_list(F.struct("round", "range", "full")).alias("replies"))
    return held.join(said, "block", "left")


def scored(counts: DataFrame, totals: DataFrame) -> DataFrame:
    """Phrases of two words and more with l, r, n and score at their worst cut; counts has their parts too.

    Products are decimals of 38 digits, enough for 10^13 occurrences of 10^14 words."""
    words = F.split("phrase", " ")
    cuts = counts.where("size > 1").withColumn("words", words).withColumn("cut", F.explode(F.sequence(F.lit(1), F.col("size") - 1)))
    cuts = cuts.withColumns({"left": F.array_join(F.slice("words", F.lit(1), F.col("cut")), " "), "right": F.array_join(F.slice("words", F.col("cut") + 1, F.col("size") - F.col("cut")), " ")}).drop("words")
    part = lambda name, count: counts.select("lang", F.col("phrase").alias(name), F.col("a").alias(count))
    cuts = cuts.join(part("left", "l"), ["lang", "left"]).join(part("right", "r"), ["lang", "right"]).join(totals, "lang")
    score = F.expr("cast(cast(1000 as decimal(4,0)) * cast(a as decimal(14,0)) * cast(n as decimal(16,0)) as decimal(38,0)) div cast(cast(l as decimal(18,0)) * cast(r as decimal(18,0)) as decimal(38,0))")
    worst = cuts.groupBy("lang", "phrase", "size", "a", "n").agg(F.min(F.struct(score.alias("score"), "cut", "l", "r")).alias("m"))
    return worst.select("lang", "phrase", "size", "a", "m.l", "m.r", "n", "m.score")


def subsumed(phrases: DataFrame, share: int) -> DataFrame:
    """phrases without those inside a longer one that has at least `share` per cent of their occurrences.

    A longer one has no more occurrences than any part, so the ones longer by one word and above suffice at 100 per cent;
    for a smaller share the parts of all lengths are looked at."""
    words = F.split("phrase", " ")
    spans = F.flatten(F.transform(F.sequence(F.lit(2), F.col("size") - 1), lambda n: F.transform(F.sequence(F.lit(1), F.col("size") - n + 1), lambda i: F.array_join(F.slice("words", i, n), " "))))
    whole = F.when(F.lit(share) >= 100, F.array(F.array_join(F.slice("words", F.lit(1), F.col("size") - 1), " "), F.array_join(F.slice("words", F.lit(2), F.col("size") - 1), " "))).otherwise(spans)
    inner = phrases.where("size > 2").withColumn("words", words).select("lang", F.explode(F.array_distinct(whole)).alias("phrase"), F.col("a").alias("longer"))
    most = inner.groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    return phrases.join(most, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (F.col("longer") * 100 < F.col("a") * share)).drop("longer")


def best(phrases: DataFrame, most: int, salts: int = 64) -> DataFrame:
    """Each language's first phrases by score, ranked; parts of a language first, so no task ranks all of one."""
    order = [F.desc("score"), F.desc("a"), "phrase"]
    parts = phrases.withColumn("_salt", F.pmod(F.xxhash64("phrase"), F.lit(salts)))
    few = parts.withColumn("_rank", F.row_number().over(Window.partitionBy("lang", "_salt").orderBy(*order))).where(F.col("_rank") <= most)
    return few.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= most).drop("_salt", "_rank")


def collocations(docs: DataFrame, least: int = 100, share: int = 100, most: int = 2000, tokens: int = BLOCK_TOKENS) -> DataFrame:
    """lang, rank, phrase, a, l, r, n and score of the first phrases of each language that are frequent and not inside a
    longer one with that share, in per cent, of their occurrences; tokens: how many make a block."""
    held = blocks(docs, tokens)
    counts = materialize(frequent(held, least), "phrases")
    totals = held.groupBy("lang").agg(F.sum("n").alias("n"))
    left = subsumed(scored(counts, totals), share)
    return best(left, most).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


ORACLE = """WITH d AS (SELECT coalesce(lang, 'und') AS lang, doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
    p AS (SELECT lang, unnest(regexp_split_to_array(text, '[.,;:!?\\x0A-\\x0D]')) AS piece FROM d),
    w AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[ \\t]+'), lambda x: x <> '') AS words FROM p),
    t AS (SELECT lang, sum(len(words))::BIGINT AS n FROM w GROUP BY lang),
    s AS (SELECT unnest([1, 2, 3, 4, 5]) AS size),
    g AS (SELECT lang, size, unnest(list_transform(range(1, len(words) - size + 2), lambda i: array_to_string(words[i:i + size - 1], ' '))) AS phrase FROM w, s WHERE len(words) >= size),
    f AS (SELECT lang, size, phrase, count(*) AS a FROM g GROUP BY ALL HAVING count(*) >= 100),
    c AS (SELECT *, string_split(phrase, ' ') AS words FROM f WHERE size > 1),
    k AS (SELECT c.lang, c.phrase, c.size, c.a, cut, l.a AS l, r.a AS r, t.n, ((1000::HUGEINT * c.a * t.n) // (l.a::HUGEINT * r.a))::BIGINT AS score
        FROM (SELECT *, unnest(range(1, size)) AS cut FROM c) c JOIN f l ON l.lang = c.lang AND l.phrase = array_to_string(c.words[1:cut], ' ') JOIN f r ON r.lang = c.lang AND r.phrase = array_to_string(c.words[cut + 1:c.size], ' ') JOIN t ON t.lang = c.lang),
    m AS (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
    i AS (SELECT lang, array_to_string(words[b:e], ' ') AS phrase, max(a) AS longer FROM (SELECT *, unnest(range(b + 1, size + 1)) AS e FROM (SELECT *, unnest(range(1, size)) AS b FROM c WHERE size > 2)) WHERE e - b + 1 < size GROUP BY 1, 2)
    SELECT lang, rank, phrase, a, l, r, n, score FROM (SELECT m.*, row_number() OVER (PARTITION BY m.lang ORDER BY score DESC, a DESC, encode(m.phrase)) AS rank FROM m LEFT JOIN i USING (lang, phrase) WHERE longer IS NULL OR 100 * longer < 100 * a)
    WHERE rank <= 2000"""
