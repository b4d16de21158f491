"""The methods behind the results against plain models, and the pipeline's stages on edge cases."""

import math

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from frameloom.llm import jaccard_join, quality_classifier, quality_rules, secret_scan
from tests.llm.test_operators import LEAK, ROWS, SCHEMA, key


@pytest.fixture(scope="module")
def sample(spark, sf_dir):
    return spark.read.parquet(sf_dir.replace("sf0.01", "sf0.001") + "/documents.parquet")


def plain_em(votes, rounds=100, prior=0.01):
    """The share of good documents and each rule's vote probabilities, a document at a time."""
    n, k = len(votes), len(votes[0])
    good = [0.02 if -1 in v else 0.95 for v in votes]
    pull = [{-1: 0.1, 0: 0.2, 1: 0.7}, {-1: 0.005, 0: 0.195, 1: 0.8}]
    for _ in range(rounds):
        given = []
        for c in (0, 1):
            rules = []
            for r in range(k):
                count = {x: prior * n * pull[c][x] + 1e-6 for x in (-1, 0, 1)}
                for v, g in zip(votes, good):
                    count[v[r]] += g if c else 1 - g
                total = sum(count.values())
                rules.append({x: y / total for x, y in count.items()})
            given.append(rules)
        share = (sum(good) + 1) / (n + 2)
        new = []
        for v in votes:
            a, b = math.log(share), math.log(1 - share)
            for r, x in enumerate(v):
                a, b = a + math.log(given[1][r][x]), b + math.log(given[0][r][x])
            new.append(1 / (1 + math.exp(b - a)))
        moved, good = max(abs(x - y) for x, y in zip(new, good)), new
        if moved < 1e-9:
            break
    return good


def test_posteriors_are_those_of_plain_em(sample):
    rows = quality_rules.quality_rules(sample).collect()
    names = [c for c in rows[0].asDict() if c.startswith("v_")]
    for r, p in zip(rows, plain_em([[r[c] for c in names] for r in rows])):
        assert abs(r["quality"] - p) < 1e-6
        failed = r["n_words"] < 10 or 100 * r["n_repeat_words"] > 20 * r["n_words"]
        assert r["base_failed"] == failed and r["kept"] == (not failed and r["quality"] >= 0.5)
    assert {r["kept"] for r in rows} == {True, False}


def plain_battery(s):
    """Encoding, length and probability of a candidate by the tests as they are described."""
    w = s.rstrip("=")
    if w.isdigit():
        return None, len(w), None
    if all(c in "0123456789abcdef" for c in w) or all(c in "0123456789ABCDEF" for c in w):
        kind, u = "hex", w.lower()
    elif all(c in secret_scan.ALPHABETS["base32"] for c in w) and any(c in "234567" for c in w):
        kind, u = "base32", w
    else:
        kind, u = "base64", w.replace("-", "+").replace("_", "/")
    alphabet = secret_scan.ALPHABETS[kind]
    x, width = [alphabet.index(c) for c in u], len(alphabet)
    n = len(x)
    tail = lambda z: 0.5 * math.erfc(z / math.sqrt(2))
    c = sum((sum(i * 8 // width == b for i in x) - n / 8) ** 2 / (n / 8) for b in range(8))
    p_chi = tail(((c / 7) ** (1 / 3) - (1 - 2 / 63)) / math.sqrt(2 / 63))
    up = [2 * i >= width for i in x]
    h, runs = sum(up), 1 + sum(a != b for a, b in zip(up, up[1:]))
    mid = 2 * h * (n - h) / n + 1
    z = 99 if h in (0, n) else (runs - mid) / math.sqrt(max((mid - 1) * (mid - 2) / (n - 1), 1e-9))
    p_runs = 2 * tail(abs(z))
    mu = sum(x) / n
    spread = sum((i - mu) ** 2 for i in x)
    z = 99 if not spread else sum((a - mu) * (b - mu) for a, b in zip(x, x[1:])) / spread * math.sqrt(n)
    f = -sum(math.log(max(p, 1e-100)) for p in (p_chi, p_runs, 2 * tail(abs(z))))
    return kind, n, math.exp(-f) * (1 + f + f * f / 2)


def test_battery_is_the_plain_one(spark):
    rng = np.random.default_rng(4)
    texts = ["".join(rng.choice(list(a), n)) for a in (*secret_scan.ALPHABETS.values(), "ABCDEF0123456789", "ab", "0123456789", "etaoinshrdlu", "-_aZ9") for n in (20, 31, 40, 64, 200)]
    texts += ["a" * 30, "A" * 20 + "2", "abc" * 12 + "==", "verylongordinarywordthatpeoplewrite"]
    df = spark.createDataFrame([(t,) for t in texts], "s string")
    for r in df.selectExpr("s", f"{secret_scan.battery('s')} AS q").collect():
        kind, n, p = plain_battery(r["s"])
        assert (r["q"]["encoding"], r["q"]["length"]) == (kind, n), r["s"]
        assert (r["q"]["p"] is None) == (p is None) and (p is None or abs(r["q"]["p"] - p) < 1e-5), (r["s"], r["q"]["p"], p)


def folder(spark, path, items, labels):
    """Tables of a corpus, as the pipeline reads them."""
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path)


@pytest.mark.parametrize("known", [True, False])
def test_stages_on_edge_cases(spark, tmp_path, known):
    """Nulls in any column, empty and repeated rows, columns with clashing names, and empty tables of labels and benchmark."""
    items = [(1, LEAK), (2, None), (None, ""), (1, LEAK)] if known else []
    labels = [(1, 1, 0), (13, 0, 0), (None, 1, 0), (2, None, None), (99, 1, 0), (1, 1, 0)] if known else []
    path = folder(spark, tmp_path / "tables", items, labels)
    docs = spark.createDataFrame([(i, t, None, None, None, None, k, None, None, None, None, None, None) for k, (i, t) in enumerate([*ROWS, ROWS[0], (14, "x")])], SCHEMA)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, path)
        rows = out.collect()
        assert name == "encode" or out.columns == docs.columns
        ids = {r["doc_id"] for r in rows}
        if name == "near_duplicates":
            assert ids == {None, 1, 4, 5, 6, 7, 8, 9, 10, 11, 12, 13, 14} and len(rows) == len(ids)
        elif name == "decontaminate":
            assert len(rows) == docs.count() - known and (10 in ids) != known
        elif name in ("secrets", "encode"):
            assert key((r["doc_id"],) for r in rows) == key((r["doc_id"],) for r in docs.select("doc_id").collect())
        assert stage(spark, docs.where("false"), path).count() == 0


def test_classifier_without_labels(spark, sample, tmp_path):
    """Nothing is known, so all score the same; with one label only, all score that."""
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    scores = {r["score"] for r in quality_classifier.quality_scores(sample, none).collect()}
    assert len(scores) == 1 and 0 <= scores.pop() <= 1
    ones = sample.selectExpr("doc_id", "1 AS quality", "0 AS toxic")
    assert min(r["score"] for r in quality_classifier.quality_scores(sample, ones).collect()) >= 0.5


def near_copies():
    """Two groups of near copies, one much longer, with rows repeated, and what no one links with."""
    rng = np.random.default_rng(8)
    rows, number = [], 0
    for size, words in ((40, 60), (25, 400)):
        base = [f"w{size}x{k}" for k in range(words)]
        for _ in range(size):
            copy = list(base)
            for at in rng.choice(words, max(1, words // 60), replace=False):
                copy[at] = f"new{rng.integers(10**6)}"
            rows += [(number, " ".join(copy))] * int(rng.integers(1, 3))
            number += 1
    rows += [(1000 + k, " ".join(f"lone{k}x{j}" for j in range(30))) for k in range(20)]
    return [(i, t) for i, (_, t) in enumerate(rows)]


def plain_links(rows):
    """Set size, smallest linked identifier and number of links of each row, from all pairs."""
    sets = [frozenset(tuple(w[k : k + 5]) for k in range(max(len(w) - 4, 1))) for w in (t.split() for _, t in rows)]
    links = [[b for b, y in enumerate(sets) if b != a and 100 * len(x & y) >= 75 * len(x | y)] for a, x in enumerate(sets)]
    root = list(range(len(rows)))
    while True:
        new = [min([root[a], *(root[b] for b in links[a])]) for a in range(len(rows))]
        if new == root:
            break
        root = new
    return sorted((i, len(sets[a]), rows[root[a]][0], len(links[a])) for a, (i, _) in enumerate(rows))


@pytest.mark.parametrize("small", [True, False])
def test_large_groups_are_split_without_loss(spark, monkeypatch, small):
    """Groups and runs beyond the sizes that one task takes give the same links as in one piece."""
    if small:
        for name, value in (("CELL_SETS", 6), ("CELL_SHINGLES", 400), ("PIVOT_SHINGLES", 500), ("RUN_BLOCK", 4), ("RUN_TASK", 50), ("BROADCAST_ROWS", 3)):
            monkeypatch.setattr(jaccard_join, name, value)
    rows = near_copies()
    found = jaccard_join.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = plain_links(rows)
    assert sorted(tuple(r) for r in found) == want and max(w[3] for w in want) > 30


def test_hot_shingles_are_dealt_out_to_all_pairs_of_blocks(monkeypatch):
    """All sets that share a shingle meet in some bucket, and none has all of them."""
    monkeypatch.setattr(jaccard_join, "HOT_BLOCK", 10)

    class Shared:
        value = (np.array([5, 2**63], np.uint64), np.array([3, 60], np.int64))

    sids = np.arange(-30, 30, dtype=np.int64)
    prefixes = pa.array([np.array([5, 2**63, 2**63 + 7 + k], np.uint64).tobytes() for k in range(60)], pa.binary())
    batches = [pa.RecordBatch.from_arrays([pa.array(sids[a : a + 20]), prefixes.slice(a, 20)], names=["sid", "prefix"]) for a in (0, 20, 40)]
    rows = [r for b in jaccard_join._deal(batches, Shared, 4) for r in b.to_pylist()]
    met, sizes = set(), []
    for bucket in {r["bucket"] for r in rows}:
        table = pa.Table.from_pylist([r for r in rows if r["bucket"] == bucket])
        held = [np.frombuffer(x, np.int64).tolist() for x in jaccard_join._runs(table).column("sids").to_pylist()]
        sizes += [len(x) for x in held if bucket < 0]
        met |= {(a, b) for x in held for a in x for b in x if a < b}
    assert len(met) == 60 * 59 // 2 and max(sizes) < 40
