"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

    logit = bias + sum w_i x_i + sum over pairs i < j of <v_i, v_j> x_i x_j

Pairs are scored in linear time: half the squared sum less the sum of squares, for each of the low rank's columns. Every
word of a text is a feature of weight 1 / words, found by its hash; the statistics are standardised. Labels, language,
source and identifier are no inputs.

It learns from at most `max_rows` labelled rows, taken by a hash of their identifier: a bound on what reaches the driver,
with at most `BUCKETS` counts a row. Without rows of both labels every score is the share of label 1, or 0.5.
Null and empty texts are scored by their statistics, which are zeros. Labels that are null, or without a document, are
left out. Repeated rows are scored each; a score of exactly 0.5 predicts 1; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from frameloom.llm.common import Words, column, slices
from frameloom.llm.stats import text_stats

BUCKETS = 2**13
RANK = 8
STATS = 16


def structure(texts: pa.Array, words: Words, n_chars: pa.Array) -> np.ndarray:
    """Rows of structure statistics and metadata."""
    s = {k: v.astype(np.float64) for k, v in text_stats(texts, words).items()}
    n, chars = np.maximum(s["n_words"], 1), np.maximum(s["word_chars"], 1)
    length = pc.fill_null(pc.utf8_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.float64)
    meta = pc.fill_null(pc.cast(n_chars, pa.float64()), 0).to_numpy(zero_copy_only=False)
    doc = np.repeat(np.arange(len(n)), words.counts())
    pairs = np.unique(doc * np.int64(len(words.distinct) + 1) + words.codes)
    types = np.bincount(pairs // (len(words.distinct) + 1), minlength=len(n)) if len(pairs) else np.zeros(len(n))
    return np.column_stack(
        [
            np.log1p(s["n_words"]),
            s["word_chars"] / n,
            s["n_symbols"] / chars,
            s["n_upper"] / n,
            s["n_shouts"] / n,
            s["n_marked"] / n,
            s["n_bare"] / n,
            s["n_digits"] / chars,
            s["n_ends"] / n,
            s["n_stutters"] / n,
            s["n_repeat_words"] / n,
            s["n_dup_lines"] / np.maximum(s["n_lines"], 1),
            np.log1p(s["n_lines"]),
            types / n,
            (length - s["word_chars"]) / np.maximum(length, 1),
            np.log1p(np.maximum(meta, 0)),
        ]
    )


def buckets(words: list[str]) -> np.ndarray:
    digest = xxhash.xxh3_64_intdigest
    return np.fromiter((digest(w) % BUCKETS for w in words), np.int64, len(words))


class Machine:
    """The model: bias, weights and factors, first of the words' buckets and then of the statistics."""

    def __init__(self, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.bias = 0.0
        self.w = np.zeros(BUCKETS + STATS, np.float32)
        self.v = rng.normal(0, 0.05, (BUCKETS + STATS, RANK)).astype(np.float32)
        self.mean, self.scale = np.zeros(STATS), np.ones(STATS)
        self.constant: float | None = None

    def standard(self, stats: np.ndarray) -> np.ndarray:
        return np.clip((stats - self.mean) / self.scale, -6, 6).astype(np.float32)

    def logits(self, words: Words, stats: np.ndarray) -> np.ndarray:
        x = self.standard(stats)
        own = buckets(words.distinct)
        n = np.maximum(words.counts(), 1).astype(np.float64)
        token = np.column_stack([self.w[own], self.v[own], (self.v[own] ** 2).sum(axis=1)]).astype(np.float64)
        summed = np.empty((len(n), token.shape[1]))
        for i in range(token.shape[1]):
            total = np.concatenate(([0.0], np.cumsum(token[words.codes, i])))
            summed[:, i] = total[words.starts[1:]] - total[words.starts[:-1]]
        linear = summed[:, 0] / n + x @ self.w[BUCKETS:]
        sums = summed[:, 1 : 1 + RANK] / n[:, None] + x @ self.v[BUCKETS:]
        squares = summed[:, -1] / n**2 + x**2 @ (self.v[BUCKETS:] ** 2).sum(axis=1)
        return self.bias + linear + 0.5 * ((sums**2).sum(axis=1) - squares)

    @staticmethod
    def fit(rows: list[tuple[bytes, bytes, bytes, int]], epochs: int = 40, batch: int = 256, rate: float = 0.02, decay: float = 1e-4) -> Machine:
        """rows: buckets (int16), their counts (float32), statistics (float64) and the label. Adam over logistic loss."""
        m = Machine()
        y = np.array([r[3] for r in rows], np.float32)
        if len(set(y.tolist())) < 2:
            m.constant = float(y.mean()) if len(y) else 0.5
            return m
        stats = np.array([np.frombuffer(r[2], np.float64) for r in rows])
        m.mean, m.scale = stats.mean(axis=0), stats.std(axis=0) + 1e-6
        x = m.standard(stats)
        cells = [(np.frombuffer(r[0], np.int16).astype(np.int64), np.frombuffer(r[1], np.float32)) for r in rows]
        cells = [(i, c / max(c.sum(), 1)) for i, c in cells]
        # a bucket's repeats pair with one another: squares go by occurrences, as in logits()
        n = np.array([max(np.frombuffer(r[1], np.float32).sum(), 1) for r in rows], np.float32)
        rng, step = np.random.default_rng(7), 0
        params = [np.zeros(1, np.float32), m.w, m.v]
        first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
        for epoch in range(epochs):
            order = rng.permutation(len(y))
            for at in range(0, len(y), batch):
                part = order[at : at + batch]
                dense = np.zeros((len(part), BUCKETS + STATS), np.float32)
                for k, j in enumerate(part.tolist()):
                    dense[k, cells[j][0]] = cells[j][1]
                square = dense / n[part, None]
                dense[:, BUCKETS:] = x[part]
                square[:, BUCKETS:] = x[part] ** 2
                sums = dense @ m.v
                z = params[0][0] + dense @ m.w + 0.5 * ((sums**2).sum(axis=1) - square @ (m.v**2).sum(axis=1))
                g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[part]) / len(part)
                grads = [np.array([g.sum()]), dense.T @ g + decay * m.w, dense.T @ (g[:, None] * sums) - m.v * (square.T @ g)[:, None] + decay * m.v]
                step += 1
                pace = rate * (0.1 + 0.9 * (1 - epoch / epochs))
                for p, d, a, b in zip(params, grads, first, second):
                    a += 0.1 * (d - a)
                    b += 0.001 * (d * d - b)
                    p -= (pace * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
        m.bias = float(params[0][0])
        return m


def _examples(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        texts = column(batch, "text")
        words = Words(texts)
        stats = structure(texts, words, column(batch, "n_chars"))
        own, ids, counts = buckets(words.distinct), [], []
        for span in words.spans():
            i, c = np.unique(own[span], return_counts=True)
            ids.append(i.astype(np.int16).tobytes())
            counts.append(c.astype(np.float32).tobytes())
        yield pa.RecordBatch.from_pydict({"ids": pa.array(ids, pa.binary()), "counts": pa.array(counts, pa.binary()), "stats": pa.array([x.tobytes() for x in stats], pa.binary()), "label": column(batch, "label"), "doc_id": column(batch, "doc_id")})


def _score(batches: Iterable[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    model: Machine = shared.value
    for batch in slices(batches):
        scores = _scores(model, column(batch, "text"), column(batch, "n_chars"))
        keep = {f: column(batch, f) for f in batch.schema.names if f not in ("text", "n_chars")}
        yield pa.RecordBatch.from_pydict(keep | {"score": pa.array(scores, pa.float64())})


def _scores(model: Machine, texts: pa.Array, n_chars: pa.Array) -> np.ndarray:
    if model.constant is not None:
        return np.full(len(texts), model.constant)
    words = Words(texts)
    return 1 / (1 + np.exp(-np.clip(model.logits(words, structure(texts, words, n_chars)), -700, 700)))


def _accept(batches: Iterable[pa.RecordBatch], shared, least: float) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        texts = column(batch, "text")
        n_chars = column(batch, "n_chars") if "n_chars" in batch.schema.names else pc.utf8_length(texts)
        yield batch.filter(pa.array(_scores(shared.value, texts, n_chars) >= least))


def held_out(doc_id: Column) -> Column:
    """Rows never learned from; a null identifier counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 3 == 1


def examples(docs: DataFrame, labels: DataFrame, max_rows: int) -> DataFrame:
    """What is learned from: of each labelled identifier one row, the least by what the machine sees, and no more than max_rows
    in all, those of the least hashes."""
    labels = labels.select(labels["doc_id"].cast("long").alias("doc_id"), F.col("quality").cast("int").alias("label"))
    taken = labels.where(F.col("label").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).distinct().orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(max_rows)
    found = _plain(docs).join(F.broadcast(taken), "doc_id").select("doc_id", "text", "n_chars", "label")
    seen = found.mapInArrow(_examples, "ids binary, counts binary, stats binary, label int, doc_id long")
    least = seen.groupBy("doc_id", "label").agg(F.min(F.struct("ids", "counts", "stats")).alias("x"))
    return least.select("doc_id", "label", "x.ids", "x.counts", "x.stats")


def fit_classifier(docs: DataFrame, labels: DataFrame, max_rows: int = 4000) -> Machine:
    """Learns from docs (doc_id, text, n_chars) and labels (doc_id, quality), but for held-out identifiers."""
    rows = examples(docs, labels, max_rows).collect()
    rows.sort(key=lambda r: (r["doc_id"], r["label"]))
    return Machine.fit([(bytes(r["ids"]), bytes(r["counts"]), bytes(r["stats"]), r["label"]) for r in rows])


def _plain(docs: DataFrame) -> DataFrame:
    n_chars = F.col("n_chars").cast("double") if "n_chars" in docs.columns else F.length("text").cast("double")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", n_chars.alias("n_chars"))


def quality_scores(docs: DataFrame, labels: DataFrame, max_rows: int = 4000, model: Machine | None = None) -> DataFrame:
    """doc_id, held_out, score and predicted of every row of docs."""
    shared = docs.sparkSession.sparkContext.broadcast(model or fit_classifier(docs, labels, max_rows))
    out = _plain(docs).mapInArrow(lambda it: _score(it, shared), "doc_id long, score double")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def accepted(docs: DataFrame, labels: DataFrame, max_rows: int = 4000, least: float = 0.5) -> DataFrame:
    """The rows of docs, with all their columns, that score at least `least`. No shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(fit_classifier(docs, labels, max_rows))
    return docs.mapInArrow(lambda it: _accept(it, shared, least), docs.schema)
