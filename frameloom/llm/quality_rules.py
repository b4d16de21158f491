"""Quality rules as weak supervision.

Every rule votes good, votes bad or abstains. Expectation-maximisation over the counts of vote patterns of all documents
estimates how each rule votes on good and on bad documents, and the posterior probability of good replaces a filter that
all rules must pass. There are at most 3 ** rules patterns, which bounds what reaches the driver; votes are kept
as columns, and the posterior is an expression on them.

Null and empty texts have no words and so fail the base rules. Repeated rows are judged each; equal posteriors are no
matter, as nothing is ranked; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from frameloom.llm.common import column, materialize, slices
from frameloom.llm.stats import text_stats

Stats = dict[str, np.ndarray]
#: Counts that the result carries.
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def share(s: Stats, part: str, whole: str) -> np.ndarray:
    return s[part] / np.maximum(s[whole], 1)


def votes(bad: np.ndarray, good: np.ndarray) -> np.ndarray:
    return np.where(bad, -1, np.where(good, 1, 0)).astype(np.int8)


def _length(s: Stats) -> np.ndarray:
    return votes(s["n_words"] < 10, s["n_words"] >= 30)


def _repeats(s: Stats) -> np.ndarray:
    return votes(share(s, "n_repeat_words", "n_words") > 0.2, share(s, "n_repeat_words", "n_words") <= 0.05)


def _symbols(s: Stats) -> np.ndarray:
    return votes(share(s, "n_marked", "n_words") > 0.3, share(s, "n_symbols", "word_chars") < 0.02)


def _lines(s: Stats) -> np.ndarray:
    return votes(share(s, "n_dup_lines", "n_lines") > 0.3, s["n_dup_lines"] == 0)


def _shouting(s: Stats) -> np.ndarray:
    return votes(share(s, "n_upper", "n_words") > 0.4, share(s, "n_upper", "n_words") < 0.1)


def _exclaiming(s: Stats) -> np.ndarray:
    return votes(share(s, "n_shouts", "n_words") > 0.3, share(s, "n_shouts", "n_words") < 0.05)


def _bare(s: Stats) -> np.ndarray:
    return votes(share(s, "n_bare", "n_words") > 0.25, share(s, "n_bare", "n_words") < 0.05)


def _stutters(s: Stats) -> np.ndarray:
    return votes(share(s, "n_stutters", "n_words") > 0.2, share(s, "n_stutters", "n_words") < 0.05)


def _word_length(s: Stats) -> np.ndarray:
    mean = share(s, "word_chars", "n_words")
    return votes((mean < 2.5) | (mean > 14), (mean >= 3.5) & (mean <= 11))


def _letters(s: Stats) -> np.ndarray:
    part = share(s, "n_letters", "word_chars")
    return votes(part < 0.85, part > 0.94)


def _plain_words(s: Stats) -> np.ndarray:
    part = share(s, "n_plain", "n_words")
    return votes(part < 0.7, part > 0.9)


RULES: dict[str, Callable[[Stats], np.ndarray]] = {
    "length": _length,
    "repeats": _repeats,
    "symbols": _symbols,
    "lines": _lines,
    "shouting": _shouting,
    "exclaiming": _exclaiming,
    "bare": _bare,
    "stutters": _stutters,
    "word_length": _word_length,
    "letters": _letters,
    "plain_words": _plain_words,
}


def _features(batches: Iterable[pa.RecordBatch], rules: dict) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        s = text_stats(column(batch, "text"))
        cols = {"doc_id": column(batch, "doc_id")} | {k: pa.array(s[k]) for k in BASE} | {f"v_{k}": pa.array(f(s)) for k, f in rules.items()}
        yield pa.RecordBatch.from_pydict(cols)


class Votes:
    """Probabilities of each rule's votes (bad, abstain, good) on bad and good documents, and the share of good ones."""

    def __init__(self, share_good: float, given: np.ndarray):
        self.share_good, self.given = share_good, given  # given: class x rule x vote

    def log_odds(self) -> tuple[float, np.ndarray]:
        return float(np.log(self.share_good / (1 - self.share_good))), np.log(self.given[1]) - np.log(self.given[0])

    @staticmethod
    def fit(patterns: np.ndarray, counts: np.ndarray, rounds: int = 100, prior: float = 0.01) -> Votes:
        """EM from the start that one bad vote makes a document bad with probability 0.98.

        patterns: rows of votes; counts: documents with each. The prior, as a share of all documents, holds that good
        documents seldom get bad votes; it keeps the classes from swapping or splitting on something else.
        """
        n, k = float(counts.sum()), patterns.shape[1]
        onehot = np.stack([patterns == v for v in (-1, 0, 1)], axis=-1).astype(float)
        good = np.where((patterns == -1).any(axis=1), 0.02, 0.95)
        pull = np.array([[0.1, 0.2, 0.7], [0.005, 0.195, 0.8]])
        for _ in range(rounds):
            given = []
            for weight, toward in ((counts * (1 - good), pull[0]), (counts * good, pull[1])):
                c = np.einsum("p,pkv->kv", weight, onehot) + prior * n * toward + 1e-6
                given.append(c / c.sum(axis=1, keepdims=True))
            p = (float(counts @ good) + 1) / (n + 2)
            model = Votes(p, np.array(given))
            bias, table = model.log_odds()
            new = 1 / (1 + np.exp(-np.clip(bias + np.einsum("kv,pkv->p", table, onehot), -50, 50)))
            moved, good = np.abs(new - good).max(initial=0), new
            if moved < 1e-9:
                break
        return model

    def posterior(self, columns: list[str]) -> Column:
        bias, table = self.log_odds()
        z = F.lit(bias)
        for name, row in zip(columns, table.tolist()):
            z = z + F.when(F.col(name) == -1, row[0]).when(F.col(name) == 0, row[1]).otherwise(row[2])
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def quality_rules(docs: DataFrame, rules: dict[str, Callable[[Stats], np.ndarray]] | None = None, threshold: float = 0.5) -> DataFrame:
    """doc_id, the base counts, base_failed, quality (posterior), kept and the votes v_<rule> of every row of docs (doc_id, text)."""
    rules = rules or RULES
    names = [f"v_{k}" for k in rules]
    schema = ", ".join(["doc_id long", *(f"{k} long" for k in BASE), *(f"{k} tinyint" for k in names)])
    seen = materialize(docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text").mapInArrow(lambda it: _features(it, rules), schema), "rules")
    rows = sorted(tuple(r) for r in seen.groupBy(*names).count().collect())
    patterns = np.array([r[:-1] for r in rows], np.int8).reshape(-1, len(names))
    model = Votes.fit(patterns, np.array([r[-1] for r in rows], float))
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    out = seen.withColumn("base_failed", failed).withColumn("quality", model.posterior(names))
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= threshold)).select("doc_id", *BASE, "base_failed", "kept", "quality", *names)
