"""Token-ID output as sorted-string-table shards.

A shard holds documents by identifier in prefix-compressed blocks, then a sparse block index, a Bloom filter and a
footer; a lookup is one Bloom probe, one binary search of the index and one block.

    shard   := block* index bloom footer
    block   := zstd(entry*) crc32(u32)
    entry   := shared(varint) unshared(varint) length(varint) key[shared:] value
    index   := (key length(varint) last key offset(varint) size(varint))*
    bloom   := bits, probes in the footer
    footer  := 6 x u64 (index offset, index size, bloom offset, bloom size, documents, ids), u32 id width, u32 probes, magic

A key is 0x00 for a null identifier, else 0x01 and the identifier plus 2**63 in eight big-endian bytes, so keys sort as
identifiers with nulls first. A value is the ids, little-endian, in the footer's width. Repeated identifiers stay side by
side, in the order of their texts. Null and empty texts hold the end id alone. Writers put shards under names of their
own attempt in the shared folder, and only shards that a finished task names are read, so lost or repeated tasks do no harm.
"""

from __future__ import annotations

import functools
import itertools
import struct
import uuid
import zlib
from bisect import bisect_left
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from frameloom.llm.common import Words, column, local_parallelism, scratch_path

MAGIC = b"FLSSTAB1"
FOOTER = struct.Struct("<6QII8s")
BLOCK_BYTES = 128 * 1024
BLOOM_BITS, BLOOM_PROBES = 10, 7
MEMO = 600_000
#: Marks that make one pre-token after letters; without the apostrophe, with which contractions begin.
MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"


def key_of(doc_id: int | None) -> bytes:
    return b"\0" if doc_id is None else b"\1" + struct.pack(">Q", doc_id + 2**63)


def id_of(key: bytes) -> int | None:
    return None if key == b"\0" else struct.unpack(">Q", key[1:])[0] - 2**63


def _varint(n: int, out: bytearray) -> None:
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)


def _read_varint(data: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        b = data[at]
        at += 1
        n |= (b & 127) << shift
        if b < 128:
            return n, at
        shift += 7


def _probes(key: bytes, bits: int, probes: int) -> list[int]:
    h = xxhash.xxh3_128_intdigest(key)
    a, b = h & (2**64 - 1), h >> 64 | 1
    return [(a + i * b) % bits for i in range(probes)]


class Writer:
    """Writes entries, which come in the order of their keys, to a binary file."""

    def __init__(self, out, id_width: int = 4):
        self.out, self.width, self.at = out, id_width, 0
        self.block, self.last, self.index, self.keys = bytearray(), b"", bytearray(), []
        self.n_ids = 0
        self.zip = zstandard.ZstdCompressor(level=1)

    def add(self, key: bytes, ids: bytes) -> None:
        if self.keys and key < self.keys[-1]:
            raise ValueError("keys must not descend")
        shared = 0
        if self.block:
            top = min(len(key), len(self.last))
            while shared < top and key[shared] == self.last[shared]:
                shared += 1
        for n in (shared, len(key) - shared, len(ids)):
            _varint(n, self.block)
        self.block += key[shared:]
        self.block += ids
        self.last = key
        self.keys.append(key)
        self.n_ids += len(ids) // self.width
        if len(self.block) >= BLOCK_BYTES:
            self._flush()

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def _flush(self) -> None:
        if not self.block:
            return
        data = self.zip.compress(bytes(self.block))
        for n in (len(self.last),):
            _varint(n, self.index)
        self.index += self.last
        for n in (self.at, len(data) + 4):
            _varint(n, self.index)
        self._put(data + struct.pack("<I", zlib.crc32(data)))
        self.block = bytearray()

    def close(self) -> tuple[int, int]:
        """Documents and ids written."""
        self._flush()
        index_at = self.at
        self._put(bytes(self.index))
        bloom_at, bits = self.at, max(64, (len(self.keys) * BLOOM_BITS + 7) // 8 * 8)
        bloom = bytearray(bits // 8)
        for key in self.keys:
            for p in _probes(key, bits, BLOOM_PROBES):
                bloom[p >> 3] |= 1 << (p & 7)
        self._put(bytes(bloom))
        self._put(FOOTER.pack(index_at, bloom_at - index_at, bloom_at, len(bloom), len(self.keys), self.n_ids, self.width, BLOOM_PROBES, MAGIC))
        return len(self.keys), self.n_ids


class Reader:
    """Reads a shard from a seekable binary file."""

    def __init__(self, source):
        self.source = source
        source.seek(0, 2)
        end = source.tell()
        source.seek(end - FOOTER.size)
        index_at, index_size, bloom_at, bloom_size, self.n_docs, self.n_ids, self.width, self.probes, magic = FOOTER.unpack(source.read(FOOTER.size))
        if magic != MAGIC:
            raise ValueError("not a shard")
        source.seek(bloom_at)
        self.bloom = source.read(bloom_size)
        source.seek(index_at)
        data, at, self.last_keys, self.blocks = source.read(index_size), 0, [], []
        while at < len(data):
            n, at = _read_varint(data, at)
            self.last_keys.append(data[at : at + n])
            offset, at = _read_varint(data, at + n)
            size, at = _read_varint(data, at)
            self.blocks.append((offset, size))
        self.unzip = zstandard.ZstdDecompressor()
        self.dtype = np.dtype(f"<u{self.width}")

    def _block(self, k: int) -> Iterator[tuple[bytes, bytes]]:
        offset, size = self.blocks[k]
        self.source.seek(offset)
        data = self.source.read(size)
        if struct.unpack("<I", data[-4:])[0] != zlib.crc32(data[:-4]):
            raise ValueError("a block is damaged")
        data, at, key = self.unzip.decompress(data[:-4]), 0, b""
        while at < len(data):
            shared, at = _read_varint(data, at)
            rest, at = _read_varint(data, at)
            length, at = _read_varint(data, at)
            key = key[:shared] + data[at : at + rest]
            at += rest
            yield key, data[at : at + length]
            at += length

    def scan(self) -> Iterator[tuple[int | None, np.ndarray]]:
        for k in range(len(self.blocks)):
            for key, value in self._block(k):
                yield id_of(key), np.frombuffer(value, self.dtype)

    def get(self, doc_id: int | None) -> list[np.ndarray]:
        """The ids of every document with this identifier."""
        key, bits = key_of(doc_id), len(self.bloom) * 8
        if any(not self.bloom[p >> 3] >> (p & 7) & 1 for p in _probes(key, bits, self.probes)):
            return []
        found = []
        for k in range(bisect_left(self.last_keys, key), len(self.blocks)):
            for other, value in self._block(k):
                if other == key:
                    found.append(np.frombuffer(value, self.dtype))
                elif other > key:
                    return found
        return found


class Encoder:
    """Ids of texts under a tokenizers file whose pre-tokenizer never crosses white space; words are encoded once."""

    def __init__(self, path: str):
        local_parallelism()
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.special = [x.content for x in self.library.get_added_tokens_decoder().values()]
        self.width = 2 if self.library.get_vocab_size() <= 2**16 else 4
        self.dtype = np.dtype(f"<u{self.width}")
        self.ends = np.zeros(self.library.get_vocab_size(), bool)
        self.ends[[i for w, i in self.library.get_vocab().items() if w.endswith("</w>")]] = True
        self.memo: dict[str, bytes] = {}

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, self.dtype)

    def _learn(self, words: list[str]) -> None:
        """Encodes words that are new; those of plain letters some at a time, and cut after each end of a word."""
        plain = [w for w in words if self._letters(w)]
        other = [w for w in words if not self._letters(w)]
        for i in range(0, len(other), 20_000):
            part = other[i : i + 20_000]
            for w, e in zip(part, self.library.encode_batch_fast(part, add_special_tokens=False), strict=True):
                self.memo[w] = np.array(e.ids, self.dtype).tobytes()
        groups = [plain[i : i + 20] for i in range(0, len(plain), 20)]
        for i in range(0, len(groups), 1000):
            part = groups[i : i + 1000]
            for ws, e in zip(part, self.library.encode_batch_fast([" ".join(ws) for ws in part], add_special_tokens=False), strict=True):
                ids = np.array(e.ids, self.dtype)
                ends = np.flatnonzero(self.ends[ids]) + 1
                data, at = ids.tobytes(), 0
                for w, end in zip(ws, (ends * self.width).tolist(), strict=True):
                    self.memo[w] = data[at:end]
                    at = end

    @staticmethod
    def _letters(word: str) -> bool:
        """Letters whose case folds one by one and that no normalisation changes."""
        return word.isalpha() and (word.isascii() or max(word) <= "\xff")

    def texts(self, texts: pa.Array) -> list[np.ndarray]:
        """Ids of each text; a text with a special string is encoded in one go, the others word by word."""
        words = Words(texts)
        memo = self.memo
        if len(memo) > MEMO:
            memo.clear()
        # letters and the marks behind them are split by the pre-tokenizer in any case
        keys: list[tuple[str, str]] = []
        for w in words.distinct:
            stem = w.rstrip(MARKS)
            keys.append((stem.lower(), w[len(stem) :]) if self._letters(stem) else (w, ""))
        self._learn(list({k for pair in keys for k in pair if k and k not in memo}))
        memo[""] = b""
        flat = [memo[a] + memo[b] if b else memo[a] for a, b in keys]
        ids = np.frombuffer(b"".join(flat), self.dtype)
        lengths = np.fromiter(map(len, flat), np.int64, len(flat)) // self.width
        first = np.concatenate(([0], np.cumsum(lengths)))[:-1] if len(flat) else np.zeros(0, np.int64)
        n = lengths[words.codes]
        ends = np.concatenate(([0], np.cumsum(n)))
        out_ids = ids[np.repeat(first[words.codes] - ends[:-1], n) + np.arange(ends[-1])]
        bounds = ends[words.starts].tolist()
        out = [out_ids[a:b] for a, b in zip(bounds, bounds[1:])]
        odd = np.zeros(len(texts), bool)
        for s in self.special:
            odd |= pa.compute.fill_null(pa.compute.match_substring(texts, s), False).to_numpy(zero_copy_only=False)
        for i in np.flatnonzero(odd).tolist():
            out[i] = self.whole(texts[i].as_py())
        return out


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def _write(batches: Iterable[pa.RecordBatch], folder: str, tokenizer: str, end_id: int) -> Iterator[pa.RecordBatch]:
    part, store, base = TaskContext.get().partitionId(), *pafs.FileSystem.from_uri(folder)
    path, out, writer = f"{base}/shard-{part:06d}-{uuid.uuid4().hex}.sst", None, None
    for batch in batches:
        if not batch.num_rows:
            continue
        encode = encoder(tokenizer)
        if writer is None:
            store.create_dir(base, recursive=True)
            out = store.open_output_stream(path)
            writer = Writer(out, encode.width)
        end = np.array([end_id], encode.dtype).tobytes()
        for doc_id, ids in zip(column(batch, "doc_id").to_pylist(), encode.texts(column(batch, "text"))):
            writer.add(key_of(doc_id), ids.tobytes() + end)
    if writer is not None:
        n_docs, n_ids = writer.close()
        out.close()
        yield pa.RecordBatch.from_pydict({"part": [part], "path": [path], "n_docs": [n_docs], "n_ids": [n_ids]})


def _read(batches: Iterable[pa.RecordBatch], folder: str) -> Iterator[pa.RecordBatch]:
    store, _ = pafs.FileSystem.from_uri(folder)
    for batch in batches:
        for path, start in zip(column(batch, "path").to_pylist(), column(batch, "start").to_pylist()):
            with store.open_input_file(path) as f:
                found = Reader(f).scan()
                while True:
                    rows = []
                    for doc_id, ids in itertools.islice(found, 10_000):
                        rows.append((doc_id, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                        start += len(ids)
                    if not rows:
                        break
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows)], names=["doc_id", "start", "n_tokens", "ids_crc32"])


def as_uri(path: str) -> str:
    return path if "://" in path else "file://" + path.removeprefix("file:")


def write_shards(docs: DataFrame, tokenizer: str, end_id: int, folder: str) -> list:
    """Writes the ids of docs (doc_id, text) in ascending doc_id order under folder; returns the shards' rows (part,
    path, n_docs, n_ids), of which there are as many as shuffle partitions at most. Rows of one identifier, or of none, can
    go on in the next shard, in the order of their texts."""
    parts = docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text")
    parts = parts.repartitionByRange(F.col("doc_id").asc_nulls_first(), F.substring("text", 1, 64).asc_nulls_first())
    parts = parts.sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.col("text").asc_nulls_first())
    return sorted(parts.mapInArrow(lambda it: _write(it, folder, tokenizer, end_id), "part long, path string, n_docs long, n_ids long").collect())


def read_shards(spark: SparkSession, shards: list, folder: str) -> DataFrame:
    """doc_id, start (ids of all documents before), n_tokens and ids_crc32 of every document in the shards."""
    rows, start = [], 0
    for s in shards:
        rows.append((s["path"], start))
        start += s["n_ids"]
    if not rows:
        return spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids_crc32 long")
    paths = spark.createDataFrame(rows, "path string, start long").repartition(len(rows))
    return paths.mapInArrow(lambda it: _read(it, folder), "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_shards(docs: DataFrame, tokenizer: str, end_id: int = 2, folder: str | None = None) -> DataFrame:
    """Writes shards of docs and reads them back; see write_shards() and read_shards()."""
    spark = docs.sparkSession
    folder = as_uri(folder or scratch_path(spark, "sstable"))
    return read_shards(spark, write_shards(docs, tokenizer, end_id, folder), folder)
