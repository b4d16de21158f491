"""SentencePiece encoding and decoding as a max-plus parallel scan.

The ids of a text are its best segmentation: the pieces whose scores have the greatest sum (Viterbi over the model's
pieces and scores, as the library has it for models of unigram type). That is a product of matrices in the max-plus
semiring, so giant texts are cut into chunks anywhere. A boundary has as many states as the longest piece has symbols:
how far a piece that began before reaches past it. Each chunk yields the matrix of best scores from an entry to an exit
state; the matrices of a text are combined by an associative scan, which gives the best score of every state at every
boundary; with those every chunk is traced back on its own, from each of its exit states to the entry state that leads
there, and the text takes of each chunk what its last one leads back to. Texts of up to `chunk` symbols are one chunk and
need no scan.

Within a chunk, no piece reaches over a space that follows something else, so segments between are solved once and kept
in a bounded memo. Scores are whole numbers, or the model is refused, and sums exact. Of segmentations that score the same,
the one with the longest last piece is taken, then with the longest before it, and so on: at any size of chunks, as a state
that a piece from an earlier chunk leads to goes before others of its score.

Symbols without a piece become their UTF-8 bytes' pieces. Null and empty texts have no ids. Decoding gives back every
text but for U+2581, which the model has for a space. Repeated rows are encoded each; other columns are ignored; an empty
table gives no rows.
"""

from __future__ import annotations

import functools
import re
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from frameloom.llm.common import column, materialize, slices, strings

#: Fixed value: the symbol that stands for a space in pieces.
SPACE = "▁"
CUTS = re.compile(f"\\n|(?<!{SPACE}){SPACE}")
MEMO, SCORES = 350_000, 50_000
CHUNK = 32_768
LOWEST = -(2**60)
DIGEST = "doc_id long, n_tokens long, ids_crc32 long, text_crc32 long, decoded_crc32 long"


class Model:
    """Pieces and scores of a model file."""

    def __init__(self, path: str):
        import sentencepiece

        p = sentencepiece.SentencePieceProcessor(model_file=path)
        n = p.get_piece_size()
        self.pieces, self.bytes_of, self.bytes_id = {}, [], {}
        for i in range(n):
            piece = p.id_to_piece(i)
            if p.is_byte(i):
                self.bytes_id[int(piece[3:5], 16)] = i
                self.bytes_of.append(bytes([int(piece[3:5], 16)]))
            elif p.is_control(i) or p.is_unknown(i) or p.is_unused(i):
                self.bytes_of.append(b"")
            else:
                if p.get_score(i) != round(p.get_score(i)):
                    raise ValueError(f"{path}: scores are not whole numbers")
                self.pieces[piece] = (i, round(p.get_score(i)))
                self.bytes_of.append(piece.replace(SPACE, " ").encode())
        self.reach = max(map(len, self.pieces))
        #: Ten below the lowest score, for a symbol without a piece, as the library has it.
        self.unknown = min(s for _, s in self.pieces.values()) - 10
        for piece in self.pieces:
            if SPACE in piece[1:] and piece.strip(SPACE):
                raise ValueError(f"{path}: a piece reaches over a space")
        if "\n" in "".join(self.pieces):
            raise ValueError(f"{path}: a piece has a line end")
        self.starts = {piece[:k] for piece in self.pieces for k in range(1, len(piece) + 1)}
        self.width = 2 if n <= 2**16 else 4
        self.dtype = np.dtype(f"<u{self.width}")
        self.memo: dict[str, bytes] = {}
        self.scores: dict[str, int] = {}

    def matches(self, s: str, i: int) -> Iterator[tuple[int, int]]:
        """Ends and scores of pieces that begin at a place; the place's own symbol counts in any case."""
        pieces, starts, end = self.pieces, self.starts, i + 1
        if s[i] not in pieces:
            yield end, self.unknown
        while end <= len(s) and (sub := s[i:end]) in starts:
            if sub in pieces:
                yield end, pieces[sub][1]
            end += 1

    def ids_between(self, s: str, cuts: list[int]) -> bytes:
        out = []
        for a, b in zip(cuts, cuts[1:]):
            found = self.pieces.get(s[a:b])
            out.extend([found[0]] if found else [self.bytes_id[x] for x in s[a:b].encode("utf-8", "surrogatepass")])
        return np.array(out, self.dtype).tobytes()

    def best(self, s: str) -> tuple[list[int], int]:
        """Cuts of the best way through a segment, and its score."""
        n, starts, find, unknown = len(s), self.starts, self.pieces.get, self.unknown
        score, back = [LOWEST] * (n + 1), [0] * (n + 1)
        score[0] = 0
        for i in range(n):
            here, end = score[i], i + 1
            sub = s[i]
            if sub not in self.pieces and here + unknown > score[end]:
                score[end], back[end] = here + unknown, i
            while sub in starts:
                found = find(sub)
                if found and here + found[1] > score[end]:
                    score[end], back[end] = here + found[1], i
                end += 1
                if end > n:
                    break
                sub = s[i:end]
        cuts = [n]
        while cuts[-1]:
            cuts.append(back[cuts[-1]])
        return cuts[::-1], score[n]

    def unit(self, u: str) -> bytes:
        """Ids of a segment that no piece reaches out of."""
        found = self.memo.get(u)
        if found is None:
            found = self.ids_between(u, self.best(u)[0])
            # once full it stays: common segments come early
            if len(self.memo) < MEMO and len(u) < 64:
                self.memo[u] = found
        return found

    def score(self, u: str) -> int:
        """Score of such a segment; only giant texts ask for it."""
        found = self.scores.get(u)
        if found is None:
            found = self.best(u)[1]
            if len(self.scores) < SCORES and len(u) < 64:
                self.scores[u] = found
        return found

    @staticmethod
    def cuts(s: str, n: int) -> list[int]:
        """Places before n over which no piece reaches: at line ends, and where spaces begin."""
        return [m.start() for m in CUTS.finditer(s, 1, n)]

    def segments(self, text: str) -> bytes:
        """Ids of any text, a segment at a time."""
        s = symbols(text)
        at = [0, *self.cuts(s, len(s)), len(s)]
        return b"".join(self.unit(s[a:b]) for a, b in zip(at, at[1:]))

    def texts(self, texts: pa.Array) -> list[np.ndarray]:
        """Ids of each text of an array in one chunk; null: none."""
        texts = pc.fill_null(texts, "")
        lists = pc.split_pattern(pc.replace_substring(texts, "\n", " \n"), " ")
        starts = lists.offsets.to_numpy().astype(np.int64)
        starts -= starts[0]
        encoded = lists.flatten().dictionary_encode()
        codes, distinct = encoded.indices.to_numpy(zero_copy_only=False), strings(encoded.dictionary)
        flat = [self.unit(w if w[:1] == "\n" else SPACE + w) for w in distinct]
        ids = np.frombuffer(b"".join(flat), self.dtype)
        lengths = np.fromiter(map(len, flat), np.int64, len(flat)) // self.width
        first = np.concatenate(([0], np.cumsum(lengths)))[:-1]
        n = lengths[codes]
        ends = np.concatenate(([0], np.cumsum(n)))
        every = ids[np.repeat(first[codes] - ends[:-1], n) + np.arange(ends[-1])]
        empty = pc.equal(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).tolist()
        bounds = ends[starts].tolist()
        out = [every[:0] if e else every[a:b] for e, a, b in zip(empty, bounds, bounds[1:])]
        # spaces side by side can be one piece
        for i in np.flatnonzero(pc.match_substring_regex(texts, "^ |  ").to_numpy(zero_copy_only=False)).tolist():
            out[i] = np.frombuffer(self.segments(texts[i].as_py()), self.dtype)
        return out

    def decode(self, ids: np.ndarray) -> bytes:
        """The text's bytes; the space before a text is the model's own."""
        return b"".join(map(self.bytes_of.__getitem__, ids.tolist()))[1:]

    def parts(self, s: str, n: int) -> tuple[int, list[str], int]:
        """Of a chunk of n symbols with what follows: the first cut, the segments between cuts, and the last cut."""
        cuts = self.cuts(s, n)
        return (cuts[0], [s[a:b] for a, b in zip(cuts, cuts[1:])], cuts[-1]) if cuts else (-1, [], -1)

    def reachable(self, s: str, begins: list[int], n: int, end: int) -> np.ndarray:
        """Best scores from each begin to each place from n to end; pieces begin before n."""
        low = min(begins)
        table = np.full((len(begins), end + 1 - low), LOWEST, np.int64)
        for r, b in enumerate(begins):
            if b <= end:
                table[r, b - low] = 0
        for i in range(low, n):
            here = table[:, i - low]
            if here.max() > LOWEST // 2:
                for e, gain in self.matches(s, i):
                    if e <= end:
                        np.maximum(table[:, e - low], here + gain, out=table[:, e - low])
        return np.maximum(table[:, n - low :], LOWEST)

    def matrix(self, s: str, n: int) -> np.ndarray:
        """Best scores of a chunk from each entry to each exit state."""
        out = np.full((self.reach, self.reach), LOWEST, np.int64)
        first, middle, last = self.parts(s, n)
        begins = [e for e in range(self.reach) if e <= n]
        if first < 0:
            found = self.reachable(s, begins, n, min(len(s), n + self.reach - 1))
        else:
            # a segment's end is a single state, so the matrix is a column times a row
            head = np.full((len(begins), 1), LOWEST, np.int64)
            head[: first + 1] = self.reachable(s[:first], [e for e in begins if e <= first], first, first)[:, :1]
            tail = self.reachable(s[last:], [0], n - last, min(len(s), n + self.reach - 1) - last)
            found = np.maximum(head + (tail + sum(map(self.score, middle))), LOWEST)
        out[: found.shape[0], : found.shape[1]] = found
        return out

    def traced(self, s: str, n: int, before: np.ndarray) -> tuple[bytes, list[tuple[int, bytes]]]:
        """Ids of a chunk that do not hang on its exit, and for each exit state the entry state and the ids that do; before: the
        best score of each entry state. Exits that nothing leads to have the entry -1."""
        entries = [(e, int(x)) for e, x in enumerate(before.tolist()) if x > LOWEST and e <= n]
        first, middle, last = self.parts(s, n)
        reach = range(n, min(len(s), n + self.reach - 1) + 1)
        if first < 0:
            return b"", self.ways(s, entries, n, reach)
        # all ways lead through the cuts
        [(entry, head)] = self.ways(s[:first], [(e, x) for e, x in entries if e <= first], first, [first])
        tails = self.ways(s[last:], [(0, 0)], n - last, [e - last for e in reach])
        return head + b"".join(map(self.unit, middle)), [(entry if way == 0 else -1, ids) for way, ids in tails]

    def ways(self, s: str, entries: list[tuple[int, int]], n: int, ends: Iterable[int]) -> list[tuple[int, bytes]]:
        """For each end the entry of the best way there and its ids; pieces begin before n."""
        ends = list(ends)
        score, back = [LOWEST] * (max(ends) + 1), [-1] * (max(ends) + 1)
        for e, x in entries:
            score[e] = x
        for i in range(n):
            if score[i] > LOWEST:
                for e, gain in self.matches(s, i):
                    if e < len(score) and score[i] + gain > score[e]:
                        score[e], back[e] = score[i] + gain, i
        out = []
        for end in ends:
            if score[end] == LOWEST:
                out.append((-1, b""))
                continue
            cuts = [end]
            while back[cuts[-1]] >= 0:
                cuts.append(back[cuts[-1]])
            out.append((cuts[-1], self.ids_between(s, cuts[::-1])))
        return out


@functools.lru_cache(maxsize=2)
def model(path: str) -> Model:
    return Model(path)


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Max-plus products of two stacks of matrices."""
    return np.maximum((a[:, :, :, None] + b[:, None, :, :]).max(axis=2), LOWEST)


def scan(matrices: np.ndarray) -> np.ndarray:
    """All prefix products, by doubling: each round combines what is twice as far apart."""
    out, step = matrices.copy(), 1
    while step < len(out):
        for at in range(len(out) - 1, step - 1, -4096):
            low = max(step, at - 4095)
            out[low : at + 1] = product(out[low - step : at + 1 - step].copy(), out[low : at + 1])
        step *= 2
    return out


def boundary_scores(matrices: np.ndarray) -> np.ndarray:
    """The best score of each state before each chunk, from state 0 of the first."""
    before = np.full((len(matrices), matrices.shape[1]), LOWEST, np.int64)
    before[0, 0] = 0
    before[1:] = scan(matrices)[:-1, 0]
    return before


def joined(parts: list[tuple[bytes, list[tuple[int, bytes]]]]) -> bytes:
    """Ids of a text from what its chunks give, by the states that the last one's exit 0 leads back to."""
    out, leave = [], 0
    for ids, exits in reversed(parts):
        leave, tail = exits[leave]
        out.append(ids + tail)
    return b"".join(reversed(out))


def symbols(text: str) -> str:
    return SPACE + text.replace(" ", SPACE)


def chunks(text: str, size: int, reach: int) -> Iterator[tuple[str, int]]:
    """Chunks of a text's symbols, with as many more as a piece can reach, and their own lengths."""
    s = symbols(text)
    size = max(size, reach)
    for at in range(0, len(s), size):
        yield s[at : at + size + reach - 1], min(size, len(s) - at)


def _encode(batches: Iterable[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        m, texts = model(path), column(batch, "text")
        ids = m.texts(texts)
        yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), texts, pa.array([x.tobytes() for x in ids], pa.binary())], names=["doc_id", "text", "ids"])


def _digest(batches: Iterable[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    m = model(path)
    for batch in batches:
        rows = []
        for text, data in zip(strings(column(batch, "text")), column(batch, "ids").to_pylist()):
            ids = np.frombuffer(data, m.dtype)
            rows.append((len(ids), zlib.crc32(ids.astype("<u4").tobytes()), zlib.crc32((text or "").encode()), zlib.crc32(m.decode(ids))))
        yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), *(pa.array(c, pa.int64()) for c in zip(*rows))], names=["doc_id", "n_tokens", "ids_crc32", "text_crc32", "decoded_crc32"])


def _cut(batches: Iterable[pa.RecordBatch], path: str, size: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for key, text in zip(column(batch, "row").to_pylist(), strings(column(batch, "text"))):
            for k, (s, n) in enumerate(chunks(text, size, model(path).reach)):
                yield pa.RecordBatch.from_pydict({"row": [key], "k": [k], "part": [s], "n": [n]})


def _matrices(batches: Iterable[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [model(path).matrix(s, n).tobytes() for s, n in zip(strings(column(batch, "part")), column(batch, "n").to_pylist())]
        yield pa.RecordBatch.from_arrays([column(batch, "row"), column(batch, "k"), pa.array(found, pa.binary())], names=["row", "k", "matrix"])


def _combine(table: pa.Table) -> pa.Table:
    table = table.sort_by("k")
    flat = [np.frombuffer(x, np.int64) for x in table.column("matrix").to_pylist()]
    side = int(len(flat[0]) ** 0.5)
    scores = boundary_scores(np.stack(flat).reshape(-1, side, side))
    return pa.table({"row": table.column("row"), "k": table.column("k"), "before": pa.array([x.tobytes() for x in scores], pa.binary())})


def _trace(batches: Iterable[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        args = zip(strings(column(batch, "part")), column(batch, "n").to_pylist(), column(batch, "before").to_pylist())
        found = [model(path).traced(s, n, np.frombuffer(x, np.int64)) for s, n, x in args]
        ids, exits = zip(*found) if found else ((), ())
        entries, tails = ([[x[i] for x in row] for row in exits] for i in (0, 1))
        yield pa.RecordBatch.from_arrays([column(batch, "row"), column(batch, "k"), pa.array(ids, pa.binary()), pa.array(entries, pa.list_(pa.int32())), pa.array(tails, pa.list_(pa.binary()))], names=["row", "k", "ids", "entries", "tails"])


def _gather(table: pa.Table) -> pa.Table:
    ids, entries, tails = (table.sort_by("k").column(c).to_pylist() for c in ("ids", "entries", "tails"))
    whole = joined([(a, list(zip(b, c))) for a, b, c in zip(ids, entries, tails)])
    return pa.table({"row": table.column("row").slice(0, 1), "ids": pa.array([whole], pa.binary())})


def encoded(docs: DataFrame, path: str, chunk: int = CHUNK) -> DataFrame:
    """doc_id, text and ids (little-endian, two bytes each, four where the model has more than 65,536 pieces) of docs
    (doc_id, text)."""
    docs = docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text")
    giant = F.length("text") >= chunk
    short = docs.where(~F.coalesce(giant, F.lit(False))).mapInArrow(lambda it: _encode(it, path), "doc_id long, text string, ids binary")
    texts = docs.where(giant).withColumn("row", F.xxhash64("text"))
    parts = texts.dropDuplicates(["row"]).select("row", "text").mapInArrow(lambda it: _cut(it, path, chunk), "row long, k long, part string, n long")
    parts = materialize(parts.repartition("row", "k"), "chunks")
    states = parts.mapInArrow(lambda it: _matrices(it, path), "row long, k long, matrix binary")
    states = states.groupBy("row").applyInArrow(_combine, "row long, k long, before binary")
    traced = parts.join(states, ["row", "k"]).mapInArrow(lambda it: _trace(it, path), "row long, k long, ids binary, entries array<int>, tails array<binary>")
    gathered = traced.groupBy("row").applyInArrow(_gather, "row long, ids binary")
    return short.unionByName(texts.join(gathered, "row").select("doc_id", "text", "ids"))


def decoded(ids: DataFrame, path: str) -> DataFrame:
    """doc_id and text of ids (doc_id, ids) as encoded() gives them."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = model(path)
            texts = [m.decode(np.frombuffer(x, m.dtype)).decode("utf-8", "replace") for x in column(batch, "ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return ids.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def round_trips(docs: DataFrame, path: str, chunk: int = CHUNK) -> DataFrame:
    """doc_id, n_tokens, ids_crc32 (of the ids as little-endian unsigned 32-bit integers) and round_trip: the text comes
    back from its ids; of every row of docs (doc_id, text)."""
    out = encoded(docs, path, chunk).mapInArrow(lambda it: _digest(it, path), DIGEST)
    return out.select("doc_id", "n_tokens", "ids_crc32", (F.col("text_crc32") == F.col("decoded_crc32")).alias("round_trip"))


def token_lists(docs: DataFrame, path: str, chunk: int = CHUNK) -> DataFrame:
    """doc_id, n_tokens and ids, an array of int, of every row of docs (doc_id, text)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dtype = model(path).dtype
        for batch in batches:
            ids = [np.frombuffer(x, dtype) for x in column(batch, "ids").to_pylist()]
            n = np.fromiter(map(len, ids), np.int64, len(ids))
            flat = np.concatenate(ids).astype(np.int32) if ids else np.zeros(0, np.int32)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(n))).astype(np.int32)), pa.array(flat))
            yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), pa.array(n), lists], names=["doc_id", "n_tokens", "ids"])

    return encoded(docs, path, chunk).mapInArrow(run, "doc_id long, n_tokens long, ids array<int>")
