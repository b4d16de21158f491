"""Collocations, nearest neighbours by codes and repair of conversations against plain models."""

import collections
import hashlib
import heapq
import random
import re
import zlib

import numpy as np
import pytest

from frameloom.llm import collocations, conversation_repair, hamming_index

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_phrases(rows, least, share, most):
    """Collocations of (text, lang) by plain dictionaries and whole numbers."""
    count, total = collections.defaultdict(collections.Counter), collections.Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\\x0A-\\x0D]", (text or "").translate(FOLD)):
            words = re.findall("[^\\x20\\x09]+", piece)
            total[lang] += len(words)
            for size in range(1, 6):
                count[lang].update(tuple(words[i : i + size]) for i in range(len(words) - size + 1))
    out = []
    for lang, f in count.items():
        found = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        covered = collections.defaultdict(int)
        for p, a in found.items():
            for size in range(2, len(p)):
                for i in range(len(p) - size + 1):
                    covered[p[i : i + size]] = max(covered[p[i : i + size]], a)
        ranked = []
        for p, a in found.items():
            if p in covered and 100 * covered[p] >= share * a:
                continue
            score, _, left, right = min((1000 * a * total[lang] // (f[p[:k]] * f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
            ranked.append((-score, -a, " ".join(p).encode(), left, right))
        for rank, (score, a, p, left, right) in enumerate(sorted(ranked)[:most], 1):
            out.append((lang, rank, p.decode(), -a, left, right, total[lang], -score))
    return sorted(out)


TEXTS = [
    ("The quick, quick fox; the QUICK fox! the quick fox\\nthe quick fox jumps over", "en"),
    ("a a a a a a a a a a a a", "en"),
    (None, "en"),
    ("", "de"),
    ("  \t \n ...", None),
    ("\u00c4rger \u00e4rger \u00c4rger \u00c4rger\tK\u00c4SE \u00c4rger \u00c4rger", None),
    ("tab\tand space and space and space\x0band space", "en"),
    ("\U0001f600 \u65e5\u672c \U0001f600 \u65e5\u672c \U0001f600 \u65e5\u672c", "ja"),
    ("x y " * 400, "en"),
]


def texts(spark, rows):
    return spark.createDataFrame([(i, t, lang, "s", 1, 2, "p", 0) for i, (t, lang) in enumerate(rows)], "doc_id long, text string, lang string, source string, n long, block long, phrase string, size int")


def listed(df):
    return sorted(tuple(r) for r in df.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


@pytest.mark.parametrize("least,share,most", [(2, 100, 1000), (3, 60, 5), (2, 30, 1000)])
def test_collocations(spark, least, share, most):
    rows = [(t.encode().decode("unicode_escape").encode("latin-1").decode() if t and "\\\\" in t else t, lang) for t, lang in TEXTS * 2]
    got = listed(collocations.collocations(texts(spark, rows).repartition(3), least, share, most))
    assert got and got == plain_phrases(rows, least, share, most)


def test_blocks_cut_no_phrase(spark, sf_dir):
    """Blocks of 37 tokens, so most pieces and many phrases are cut, give what one block gives; whole texts of the driver."""
    docs = spark.read.parquet(sf_dir.replace("sf0.01", "sf0.001") + "/documents.parquet")
    rows = [(r["text"], r["lang"]) for r in docs.select("text", "lang").collect()]
    want = plain_phrases(rows, 12, 100, 300)
    assert len(want) > 50 and listed(collocations.collocations(docs, 12, most=300)) == want
    few = docs.where("length(text) < 900")
    assert listed(collocations.collocations(few, 4, most=300, tokens=37)) == plain_phrases([(r["text"], r["lang"]) for r in few.select("text", "lang").collect()], 4, 100, 300)


def test_collocations_of_nothing(spark):
    assert collocations.collocations(texts(spark, [])).count() == collocations.collocations(texts(spark, [(None, None), ("", "en"), ("only once", "en")])).count() == 0


def test_scores_are_exact(spark):
    """Counts whose products need more than 64 bits."""
    n, a, left, right = 10**13, 3 * 10**9 + 7, 7 * 10**9 + 1, 5 * 10**9 + 3
    counts = spark.createDataFrame([("en", "x y", 2, a), ("en", "x", 1, left), ("en", "y", 1, right)], "lang string, phrase string, size int, a long")
    got = collocations.scored(counts, spark.createDataFrame([("en", n)], "lang string, n long")).first()
    assert got["score"] == 1000 * a * n // (left * right) and (got["l"], got["r"]) == (left, right)


def test_sketches_never_count_too_little():
    rng = np.random.default_rng(1)
    keys = np.unique(rng.integers(0, 2**63, 5000).astype(np.uint64))
    counts = rng.integers(1, 30, len(keys))
    for bits in (8, 12, 16):
        cells, sums = collocations.added(np.concatenate(collocations.cells_of(keys, bits)), np.tile(counts, len(collocations.ROWS)))
        least = np.min([sums[np.searchsorted(cells, c)] for c in collocations.cells_of(keys, bits)], axis=0)
        assert (least >= counts).all() and (bits < 16 or (least == counts).mean() > 0.9)


# nearest neighbours


def plain_nearest(rows, every, k):
    ids = np.array([i for i, _ in rows])
    x = np.array([v for _, v in rows], float)
    sims = (x @ x.T) / np.sqrt((x * x).sum(1))[:, None] / np.sqrt((x * x).sum(1))[None, :]
    out = {}
    for q in np.flatnonzero(ids % every == 0):
        sims[q, q] = -9
        out[int(ids[q])] = [int(ids[j]) for j in np.lexsort((ids, -np.round(sims[q], 12)))[: min(k, len(ids) - 1)]]
    return out


def found(df):
    out = collections.defaultdict(list)
    for r in df.orderBy("query_id", "rank").collect():
        out[r["query_id"]].append(r["vec_id"])
        assert r["rank"] == len(out[r["query_id"]])
    return dict(out)


def recall(got, want):
    assert got.keys() == want.keys() and all(len(got[q]) == len(want[q]) for q in want)
    return sum(len(set(got[q]) & set(want[q])) for q in want) / sum(map(len, want.values()))


@pytest.mark.parametrize("sf", ["0.01", "0.1"])
def test_recall_on_the_drivers_vectors(spark, sf_dir, sf):
    table = spark.read.parquet(sf_dir.replace("sf0.01", f"sf{sf}") + "/embeddings.parquet")
    want = plain_nearest([(r["vec_id"], r["embedding"]) for r in table.select("vec_id", "embedding").collect()], 50, 5)
    assert recall(found(hamming_index.embedding_search(table)), want) >= 0.95


@pytest.mark.parametrize("dims", [3, 24, 200])
def test_recall_in_dense_places(spark, dims):
    """Fewer and more dimensions than bits, a third of all rows in one place, and equal vectors among them."""
    rng = np.random.default_rng(dims)
    middles = rng.normal(size=(40, dims))
    place = np.where(rng.random(3000) < 0.33, 0, rng.integers(0, 40, 3000))
    x = middles[place] + rng.normal(size=(3000, dims)) * 0.05
    x[5::50] = x[5]
    x[::400] = x[0] * 3
    rows = [(i, r.tolist()) for i, r in enumerate(x)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5)
    got, want = found(hamming_index.embedding_search(df)), plain_nearest(rows, 50, 5)
    assert recall(got, want) >= 0.95
    assert got[0] == want[0], "ties go to the smaller id"


def test_odd_vectors(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(0, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [0.0, 0.0]), (3, None), (4, []), (5, [1.0, None]), (6, [1.0, nan]), (7, [inf, 1.0]), (8, [1.0, 2.0, 3.0]), (None, [1.0, 0.0]), (50, [1e300, 1e300]), (51, [1e-300, 0.0]), (51, [1e-300, 0.0])]
    df = spark.createDataFrame([(i, v, 9, "x", 0.5) for i, v in rows], "vec_id long, embedding array<double>, id long, tile string, score double")
    got = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in hamming_index.embedding_search(df).collect()}
    half = 1 / np.sqrt(2)
    assert got == {(0, 1): (1, 1.0), (0, 2): (51, 1.0), (0, 3): (50, pytest.approx(half)), (50, 1): (0, pytest.approx(half)), (50, 2): (1, pytest.approx(half)), (50, 3): (51, pytest.approx(half))}
    assert hamming_index.embedding_search(df.where("vec_id = 0")).count() == hamming_index.embedding_search(df.where("vec_id < 0")).count() == 0


@pytest.mark.parametrize("radius", [0, 2, 3, 17, 40, 64, 128])
def test_every_code_within_the_radius_is_met_once(monkeypatch, radius):
    """Pigeonhole over parts, and tiles that are split or hold many prefixes, against all distances."""
    monkeypatch.setattr(hamming_index, "TILE", 50)
    rng = np.random.default_rng(radius)
    base = rng.integers(0, 2**32, (30, 4), np.uint64).astype(np.uint32)
    flips = (rng.random((900, 4, 32)) < rng.choice([0.0, 0.02, 0.2], (900, 1, 1)))
    codes = base[rng.integers(0, 30, 900)] ^ np.packbits(flips, axis=2).view(">u4")[..., 0].astype(np.uint32)
    ids = np.arange(900)
    counts = collections.Counter((p, int(c[p]) >> (32 - hamming_index.PREFIX)) for c in codes for p in range(4))
    tiles = hamming_index.Tiles(counts)
    queries = codes[::30]
    held = collections.defaultdict(lambda: collections.defaultdict(list))
    for part in range(4):
        for i, t in zip(ids, tiles.of_rows(ids, codes, part)):
            held[int(t)][part].append(i)
    assert all(len(parts) == 1 for parts in held.values()) and len(held) > 20
    share = hamming_index.shares(np.full(len(queries), radius))
    met = collections.Counter()
    for q, code in enumerate(queries):
        for t in tiles.of_query(code, share[q]):
            for part, rows in held[int(t)].items():
                tile = hamming_index.Tile(part)
                tile.rows = [(ids[rows], None, codes[rows])]
                for i, j in tile.near(code[None], np.array([radius]), np.array([-1])):
                    met.update((q, rows[x]) for x in j)
    far = np.bitwise_count(queries[:, None] ^ codes[None]).sum(axis=2)
    assert set(met) == {(int(q), int(i)) for q, i in zip(*np.nonzero(far <= radius))} and set(met.values()) <= {1}


def test_rotations_are_learned():
    """Codes after learning are nearer to the vectors than those of the first rotation."""
    x = np.random.default_rng(2).normal(size=(500, 20)) * np.linspace(3, 0.2, 20)
    x /= np.linalg.norm(x, axis=1)[:, None]
    loss = lambda r: float(((np.where(x @ r >= 0, 1, -1) / np.sqrt(20) - x @ r) ** 2).sum())
    assert loss(hamming_index.rotation(x, 20)) < 0.95 * loss(hamming_index.rotation(x, 20, rounds=0))


# conversations


def damaged(rows):
    by = {}
    for conv, turn, role, text in rows:
        by.setdefault(conv, [])
        fault = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if fault:
            text = "" if fault == 1 else re.sub("[.!?]", "", text) if fault == 2 else text
            by[conv] += [(turn, "user" if fault == 4 else role, text)] * (2 if fault == 3 else 1)
    for rs in by.values():
        rs.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
    return by


def plain_repair(rows):
    """The shortest way over pairs of rows taken and state, by cost and then by audit."""
    out = []
    after = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
    for conv, rs in damaged(rows).items():
        turns = {r[0] for r in rs if r[0] is not None}
        seen, faults = set(), []
        for _, role, text in rs:
            bare = text.rstrip(" \t\n\x0b\x0c\r")
            faults.append("b" if not bare else "d" if (role, text) in seen else "t" if bare[-1] not in ".!?" else "")
            seen.add((role, text))
        first = [r[1][:1] for r in rs]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(first, first[1:]))
        heap, done = [(0, "", 0, "", ())], set()
        while True:
            cost, audit, i, state, kept = heapq.heappop(heap)
            if (i, state) in done:
                continue
            done.add((i, state))
            if i == len(rs) and state in ("", "a"):
                break
            for role in ("user", "assistant"):
                if (state, role[0]) in after:
                    heapq.heappush(heap, (cost + 5, audit + "I", i, role[0], (*kept, role + ":")))
            if i < len(rs):
                heapq.heappush(heap, (cost + 2, audit + "D", i + 1, state, kept))
                more = 5 if faults[i] == "t" else 0
                for letter, role, edit in () if faults[i] in ("b", "d") else (("K", rs[i][1], 0), ("R", "user", 1), ("R", "assistant", 1)):
                    if to := after.get((state, role[:1])):
                        heapq.heappush(heap, (cost + edit + more, audit + letter, i + 1, to, (*kept, f"{role}:{rs[i][2]}")))
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        digest = hashlib.sha256("\n".join(kept).encode()).hexdigest()
        out.append((conv, gaps, faults.count("b"), faults.count("d"), faults.count("t"), illegal, cost, audit, digest))
    return sorted(out, key=str)


COLUMNS = ("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
TALK = "conv_id long, turn long, role string, text string, seg long, conv string, copies int, cost long"


def talk(spark, rows):
    return spark.createDataFrame([(*r, 1, "x", 7, 5) for r in rows], TALK)


def repairs(df):
    return sorted((tuple(r) for r in conversation_repair.repairs(df).select(*COLUMNS).collect()), key=str)


def random_talk(seed, conversations=60):
    rng = random.Random(seed)
    roles = ["user", "assistant", "system", "tool", "", None, "ubot", "User"]
    words = ["Yes.", "no", "why?", "", "  ", None, "a\nb.", "end. \n\t", "\u00e4!", "x" * 3000 + "."]
    rows = []
    for conv in range(conversations):
        for turn in range(rng.randint(1, 12)):
            role = rng.choices(["user", "assistant"][turn % 2 :: 1] + roles, [30] + [3] * (len(roles) + 1 - turn % 2))[0]
            rows += [(conv if conv else None, rng.choice([turn, turn, turn, None, turn + 3, -turn]), role, rng.choice(words + [f"{turn}."] * 8))] * rng.choice([1, 1, 1, 2])
    return rows


@pytest.mark.parametrize("seed", range(3))
def test_repairs(spark, seed):
    rows = random_talk(seed)
    assert repairs(talk(spark, rows).repartition(4)) == plain_repair(rows)


def test_repairs_of_the_drivers_conversations(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    assert repairs(table) == plain_repair([tuple(r) for r in table.select("conv_id", "turn", "role", "text").collect()])


def test_long_conversations_and_many_copies(spark):
    """Several segments a conversation, turns far apart, and thousands of copies of one row."""
    rng = random.Random(8)
    rows = [(1, t, rng.choice(["user", "assistant"]), rng.choice(["fine.", "cut off", f"row {t}.", f"what {t}?"])) for t in range(1300)]
    rows += [(2, t * 1000, "user" if t % 2 == 0 else "assistant", f"say {t}.") for t in range(40)] + [(3, 1, "user", "again.")] * 3000 + [(3, 2, "assistant", "so it is.")]
    assert repairs(talk(spark, rows)) == plain_repair(rows)


def test_conversations_without_rows(spark):
    lost = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    assert repairs(talk(spark, [(lost, 0, "user", "x.")])) == [(lost, 0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())]
    assert repairs(talk(spark, [])) == []


def test_repaired_rows_and_other_costs(spark):
    """Rows come out in order; with dear deletions the missing answer is put in instead."""
    rows = talk(spark, [(1, 0, "system", "s."), (1, 1, "user", "q?"), (2, 5, "assistant", "hi."), (2, 6, "assistant", "there.")])
    costs = conversation_repair.Costs(delete=9, rerole=9, insert=1)
    found, ordered = conversation_repair.repaired(rows.withColumn("copies", rows["copies"] * 0 + 1), costs)
    assert {r["conv"]: (r["cost"], r["audit"]) for r in found.collect()} == {"1": (1, "KKI"), "2": (2, "IKIK")}
    got = sorted(tuple(r) for r in conversation_repair.repaired_rows(ordered).collect())
    assert got == [(1, 0, "system", "s."), (1, 1, "user", "q?"), (1, 2, "assistant", ""), (2, 0, "user", ""), (2, 1, "assistant", "hi."), (2, 2, "user", ""), (2, 3, "assistant", "there.")]
