"""Search, index and pairs of vectors against plain products of matrices."""

import numpy as np
import pytest

from frameloom.operators import vector_index, vectors


def frame(spark, x):
    x = x / np.linalg.norm(x, axis=1)[:, None]
    return spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "id long, v array<double>"), x


def crowded(n, seed=1, size=100, dims=16, spread=0.06):
    """Dense places of about `size` vectors each."""
    rng = np.random.default_rng(seed)
    middles = rng.normal(size=(max(1, n // size), dims))
    return middles[rng.integers(0, len(middles), n)] + rng.normal(size=(n, dims)) * spread


def pairs_of(x, least):
    return {(int(a), int(b)) for a, b in zip(*np.nonzero(x @ x.T >= least)) if a < b}


def best_of(x, queries, k):
    sims = x[queries] @ x.T
    sims[np.arange(len(queries)), queries] = -9
    return {(q, int(j)) for q, row in zip(queries, sims) for j in np.lexsort((np.arange(len(x)), -row))[:k]}


def test_exact_search_in_many_tiles(spark, monkeypatch):
    monkeypatch.setattr(vectors, "TILE", 64)
    df, x = frame(spark, np.random.default_rng(3).normal(size=(500, 8)))
    found = vectors.knn(df.where("id % 7 = 0"), df, 6).collect()
    assert {(r["query_id"], r["id"]) for r in found} == best_of(x, list(range(0, 500, 7)), 6)
    assert all(abs(r["sim"] - x[r["query_id"]] @ x[r["id"]]) < 1e-12 for r in found)
    own = vectors.knn(df.where("id = 3"), df, 1, exclude_self=False).first()
    assert (own["id"], own["rank"]) == (3, 1)
    assert vectors.knn(df.where("id < 0"), df, 3).count() == vectors.knn(df, df.where("id < 0"), 3).count() == 0


@pytest.mark.parametrize("least", [0.9, 0.5, 0.0, -0.2])
def test_pairs_do_not_depend_on_cells(spark, monkeypatch, least):
    df, x = frame(spark, crowded(600, size=40))
    want = pairs_of(x, least)
    for tile in (40, 1000):
        got = [(r["a"], r["b"]) for r in vectors.similar_pairs(df, least, tile).collect()]
        assert len(got) == len(set(got)) and set(got) == want
    # many pivots whatever they cost
    monkeypatch.setattr(vectors.Pivots, "cost", lambda self, *_: -len(self.v))
    got = [(r["a"], r["b"]) for r in vectors.similar_pairs(df, least, 40).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_ties_repeated_ids_and_few_vectors(spark):
    same = spark.createDataFrame([(i, [0.6, 0.8]) for i in (1, 2, 3, 3)], "id long, v array<double>")
    got = sorted((r["a"], r["b"]) for r in vectors.similar_pairs(same, 0.99, tile=2).collect())
    assert got == [(1, 2), (1, 3), (1, 3), (2, 3), (2, 3)]
    assert vectors.similar_pairs(same.where("id = 1"), 0.5).count() == vectors.similar_pairs(same.where("id = 9"), 0.5).count() == 0


def test_rows_dealt_out_grow_with_the_vectors(spark):
    dealt = {}
    for n in (2000, 20000):
        df, _ = frame(spark, crowded(n, dims=32))
        own, passing = vectors.celled(df, 0.9, tile=256)
        dealt[n] = own.count() + passing.count()
        assert own.count() == n
    assert dealt[20000] < 15 * dealt[2000]


def test_index_finds_nearly_all(spark, sf_dir, tmp_path):
    """Every row is in one graph; recall of ten on the driver's vectors, which are nearly random, and in dense places."""
    table = spark.read.parquet(sf_dir.replace("sf0.01", "sf0.1") + "/embeddings.parquet")
    hard = vectors.unit_vectors(table, "vec_id", "embedding")
    easy, _ = frame(spark, crowded(3000))
    for i, base in enumerate((hard, easy)):
        index = vector_index.build(base, size=700)
        vector_index.write(index, f"{tmp_path}/{i}")
        index = vector_index.read(spark, f"{tmp_path}/{i}")
        ids = [int(x) for r in index.collect() for x in np.frombuffer(r["ids"], np.int64)]
        assert sorted(ids) == sorted(r["id"] for r in base.select("id").collect()) and index.count() > 1
        queries = base.where("id % 10 = 0")
        want = {(r["query_id"], r["id"]) for r in vectors.knn(queries, base, 10).collect()}
        found = vector_index.search(index, queries, 10).collect()
        assert len(found) == len(want) and len({(r["query_id"], r["id"]) for r in found} & want) >= 0.9 * len(want)


def test_index_of_few_vectors(spark):
    df, x = frame(spark, np.random.default_rng(5).normal(size=(7, 4)))
    found = vector_index.search(vector_index.build(df), df, 10).collect()
    assert {(r["query_id"], r["id"]) for r in found} == {(a, b) for a in range(7) for b in range(7) if a != b}
    assert vector_index.search(vector_index.build(df.where("id < 0")), df, 3).count() == 0
    one = vector_index.search(vector_index.build(df.where("id = 2")), df, 3, exclude_self=False).collect()
    assert len(one) == 7 and all(r["id"] == 2 for r in one)


def test_graphs_link_all_vectors():
    x = crowded(900, dims=8)
    x /= np.linalg.norm(x, axis=1)[:, None]
    links = vector_index.linked(x, 6, 12)
    assert links.shape == (900, 12) and (links < 900).all()
    for i, row in enumerate(links):
        own = row[row >= 0]
        assert len(set(own)) == len(own) and i not in own
        # what was there before comes first: the nearest of it
        before = np.argsort(-(x[i] @ x[:i].T), kind="stable")[:6]
        assert set(before) <= set(own)


def test_several_vertices_are_opened_at_a_time():
    """However many are opened at once, near all of the nearest are found, each once, with their cosines."""
    rng = np.random.default_rng(21)
    v = rng.normal(size=(3000, 24))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    links, q = vector_index.linked(v), v[::30]
    best = np.argsort(-(q @ v.T), axis=1)[:, :10]
    for at_once in (1, 4, 500):
        at, sims = vector_index.beam_search(v, links, q, 128, at_once)
        assert all(len(set(a)) == 128 for a in at.tolist()) and np.allclose(sims, np.einsum("md,mkd->mk", q, v[at]))
        assert np.mean([len(set(a[:10]) & set(b)) / 10 for a, b in zip(at.tolist(), best.tolist())]) >= 0.97
    few = vector_index.beam_search(v[:3], vector_index.linked(v[:3]), q, 128)
    assert few[0].shape == (len(q), 3) and (np.sort(few[0], axis=1) == np.arange(3)).all()
