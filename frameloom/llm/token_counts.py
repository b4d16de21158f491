"""Token counts by heap-and-linked-list byte-pair merging.

The count of a pre-token is its initial symbols minus the merges made; no identifiers are emitted. Texts are cut where
the vocabulary's pre-tokenizer can't look across, equal pieces of an Arrow batch are counted once, and what a worker has
counted stays in a bounded memo.

Null and empty texts have no tokens. A special string inside a text counts one token, as the library has it by default.
Repeated rows are counted each; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import functools
import heapq
import json
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from frameloom.llm.common import column, segment_sums, strings

#: The pre-tokenization pattern of byte-level vocabularies.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Texts in which white space is other than single spaces and single line ends between other characters.
IRREGULAR = r"[\x00\t\r\x0b\x0c\x1c-\x1f\x{85}\x{a0}\x{1680}\x{180e}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]|[ \n][ \n]|^[ \n]|[ \n]$"
#: Entries a worker's memo holds.
MEMO = 600_000
#: Marks that make one pre-token after letters; without the apostrophe, with which contractions begin.
MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"

SCHEMA = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("n_bytes", T.LongType()),
        T.StructField("n_tokens", T.LongType()),
    ]
)


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in set(plain) else chr(next(rest)) for b in range(256)]


def merged_count(symbols: list[int], merges: dict[int, tuple[int, int]], wide: int) -> int:
    """Symbols left of a list after all merges, lowest rank first and leftmost among equals.

    merges: (rank, new symbol) by left * wide + right.
    """
    n = len(symbols)
    if n < 2:
        return n
    heap = []
    for i in range(n - 1):
        if m := merges.get(symbols[i] * wide + symbols[i + 1]):
            heap.append((m[0], i, symbols[i], symbols[i + 1], m[1]))
    if not heap:
        return n
    heapq.heapify(heap)
    after = [*range(1, n), -1]
    before = [*range(-1, n - 1)]
    left = n
    while heap:
        _, i, a, b, new = heapq.heappop(heap)
        j = after[i]
        if j < 0 or symbols[i] != a or symbols[j] != b:
            continue
        symbols[i], symbols[j] = new, -1
        left -= 1
        after[i] = k = after[j]
        after[j] = -1
        if k >= 0:
            before[k] = i
            if m := merges.get(new * wide + symbols[k]):
                heapq.heappush(heap, (m[0], i, new, symbols[k], m[1]))
        h = before[i]
        if h >= 0 and (m := merges.get(symbols[h] * wide + new)):
            heapq.heappush(heap, (m[0], h, symbols[h], new, m[1]))
    return left


class Counter:
    """Counts tokens of texts under a byte-level vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, kind = spec["model"], spec["pre_tokenizer"]
        if model["type"] != "BPE" or kind["type"] != "ByteLevel" or spec["normalizer"] or kind["add_prefix_space"] or model.get("ignore_merges"):
            raise ValueError(f"{path}: not a plain byte-level BPE vocabulary")
        vocab = model["vocab"]
        self.wide = max(vocab.values()) + 1
        self.merges = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.merges[vocab[a] * self.wide + vocab[b]] = (rank, vocab[a + b])
        self.first = [vocab[c] for c in byte_alphabet()]
        specials = sorted((x["content"] for x in spec["added_tokens"]), key=len, reverse=True)
        if any(x["lstrip"] or x["rstrip"] or x["single_word"] or x["normalized"] for x in spec["added_tokens"]):
            raise ValueError(f"{path}: added tokens that take in their surroundings are not supported")
        self.special = regex.compile("|".join(map(regex.escape, specials))) if specials else None
        self.special_re2 = "|".join(map(regex.escape, specials)) if specials else None
        self.pieces = regex.compile(PATTERN).findall
        self.of_pretoken: dict[str, int] = {}

    def pretoken(self, piece: str) -> int:
        n = self.of_pretoken.get(piece)
        if n is None:
            first = self.first
            n = merged_count([first[b] for b in piece.encode()], self.merges, self.wide)
            # once full it stays: common pieces come early
            if len(self.of_pretoken) < MEMO and len(piece) < 64:
                self.of_pretoken[piece] = n
        return n

    def plain(self, text: str) -> int:
        return sum(map(self.pretoken, self.pieces(text)))

    def text(self, text: str) -> int:
        """Tokens of any text."""
        if not self.special:
            return self.plain(text)
        parts = self.special.split(text)
        return len(parts) - 1 + sum(map(self.plain, parts))

    def unit(self, part: str) -> int:
        """Tokens of what stands after a space; a part that begins with \\0 stands after a line end."""
        if part[:1] == "\0":
            return self.pretoken("\n") + self.core("", part[1:])
        return self.core(" ", part)

    def core(self, lead: str, part: str) -> int:
        """Tokens of a space or nothing and a part without white space; letters with marks behind need no pattern."""
        stem = part.rstrip(MARKS)
        if not stem.isalpha():
            return self.plain(lead + part)
        n = self.pretoken(lead + stem)
        return n + self.pretoken(part[len(stem) :]) if len(stem) < len(part) else n

    def texts(self, texts: pa.Array) -> np.ndarray:
        """Tokens of each text of an array; null: none.

        Regular texts are split at single spaces and line ends, before which no pre-token goes on; a first part has
        a space too few, which is put right on its own.
        """
        texts = pc.fill_null(texts, "")
        odd = pc.match_substring_regex(texts, IRREGULAR if not self.special_re2 else f"{IRREGULAR}|{self.special_re2}")
        odd = odd.to_numpy(zero_copy_only=False) | (pc.binary_length(texts).to_numpy() == 0)
        out = np.zeros(len(texts), np.int64)
        for i in np.flatnonzero(odd).tolist():
            out[i] = self.text(texts[i].as_py())
        even = np.flatnonzero(~odd)
        if not len(even):
            return out
        lists = pc.split_pattern(pc.replace_substring(texts.take(pa.array(even)), "\n", " \0"), " ")
        starts = lists.offsets.to_numpy().astype(np.int64)
        starts -= starts[0]
        encoded = lists.flatten().dictionary_encode()
        codes, distinct = encoded.indices.to_numpy(zero_copy_only=False), strings(encoded.dictionary)
        unit = self.unit
        n = np.fromiter((unit(x) for x in distinct), np.int64, len(distinct))
        sums = segment_sums(n[codes], starts)
        for k, c in enumerate(codes[starts[:-1]].tolist()):
            sums[k] += self.plain(distinct[c]) - n[c]
        out[even] = sums
        return out


@functools.lru_cache(maxsize=2)
def counter(path: str) -> Counter:
    return Counter(path)


def _count(batches: Iterable[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    count = counter(path)
    for batch in batches:
        texts = column(batch, "text")
        n_bytes = pc.cast(pc.fill_null(pc.binary_length(texts), 0), pa.int64())
        yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), n_bytes, pa.array(count.texts(texts))], names=["doc_id", "n_bytes", "n_tokens"])


def token_counts(docs: DataFrame, tokenizer: str, limit: int = 512) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit (n_tokens > limit) of each row of docs (doc_id, text). No shuffle."""
    out = docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text").mapInArrow(lambda it: _count(it, tokenizer), SCHEMA)
    return out.withColumn("over_limit", out["n_tokens"] > limit)
