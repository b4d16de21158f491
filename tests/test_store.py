"""Commits that land once, ids, galleries, attribute trees of any depth and files found by parts of their names."""

import json
import os
import random
import threading

import pytest
from pyspark.sql import functions as F

from frameloom.operators import document, records
from frameloom.sources import store
from frameloom.sources.ledger import Conflict, Ledger


def classes(spark, names):
    return spark.createDataFrame([(n,) for n in names], "name string")


def held(spark, folder, name="object_class"):
    return sorted(tuple(r) for r in store.read(spark, folder, name).collect())


def test_a_batch_that_is_run_again_is_there_once(spark, tmp_path):
    folder = str(tmp_path)
    store.create(spark, folder)
    first = store.insert(classes(spark, "cab"), folder, "object_class", ["name"], batch="b1")
    assert sorted((r["name"], r["id"]) for r in first.collect()) == [("a", 1), ("b", 2), ("c", 3)]
    store.insert(classes(spark, "zy"), folder, "object_class", ["name"], batch="b2")
    again = store.insert(classes(spark, "cab"), folder, "object_class", ["name"], batch="b1")
    assert sorted((r["name"], r["id"]) for r in again.collect()) == [("a", 1), ("b", 2), ("c", 3)]
    store.append(spark.createDataFrame([(77, "own")], "id long, name string"), folder, "object_class", batch="b3")
    store.append(spark.createDataFrame([(77, "own")], "id long, name string"), folder, "object_class", batch="b3")
    assert held(spark, folder) == [(1, "a"), (2, "b"), (3, "c"), (4, "y"), (5, "z"), (77, "own")]
    store.insert(classes(spark, []), folder, "object_class", ["name"])
    assert len(held(spark, folder)) == 6
    more = store.insert(classes(spark, "q"), folder, "object_class", ["name"]).first()["id"]
    assert more not in {1, 2, 3, 4, 5}


def test_what_is_not_committed_does_not_count(spark, tmp_path):
    folder = str(tmp_path)
    store.create(spark, folder)
    ledger = Ledger(spark, f"{folder}/object_class")

    def fails(part):
        classes(spark, ["lost"]).withColumn("id", F.lit(9).cast("long")).withColumn("nth", F.lit(1).cast("long")).write.parquet(part)
        raise RuntimeError("the writer died")

    with pytest.raises(RuntimeError, match="died"):
        ledger.commit(fails, "b1")
    assert held(spark, folder) == [] and ledger.last() is None
    store.insert(classes(spark, ["kept"]), folder, "object_class", ["name"], batch="b1")
    assert held(spark, folder) == [(1, "kept")]


def test_writers_that_race(spark, tmp_path):
    """Six writers at once, two of them with one batch: each batch lands once, and no id is given twice."""
    folder = str(tmp_path)
    store.create(spark, folder)
    found, gate = {}, threading.Barrier(6)

    def write(k):
        gate.wait()
        names = [f"w{min(k, 4)}-{i}" for i in range(5)]
        found[k] = sorted((r["name"], r["id"]) for r in store.insert(classes(spark, names), folder, "object_class", ["name"], batch=f"b{min(k, 4)}").collect())

    threads = [threading.Thread(target=write, args=(k,)) for k in range(6)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    rows = held(spark, folder)
    assert len(rows) == 25 and sorted(i for i, _ in rows) == list(range(1, 26)) and {n for _, n in rows} == {f"w{k}-{i}" for k in range(5) for i in range(5)}
    assert found[4] == found[5] and all([i for _, i in part] == list(range(part[0][1], part[0][1] + 5)) for part in found.values())
    assert [c.number for c in Ledger(spark, f"{folder}/object_class").commits()] == list(range(5))
    assert not os.listdir(f"{folder}/object_class/waiting")


PROTOTYPES = "index_row long, person_id long, is_active boolean, v array<double>"


def test_galleries_of_two_writers(spark, tmp_path):
    folder = f"{tmp_path}/gallery"
    one = spark.createDataFrame([(0, 5, True, [1.0, 0.0])], PROTOTYPES)
    assert store.save_gallery(one, folder, expected=0) == 1
    two = one.unionByName(spark.createDataFrame([(1, 6, True, [0.0, 1.0])], PROTOTYPES))
    assert store.save_gallery(two, folder, expected=1, batch="r1") == 2
    with pytest.raises(Conflict):
        store.save_gallery(one, folder, expected=1)
    assert store.save_gallery(two, folder, expected=1, batch="r1") == 2 and store.versions(spark, folder) == [1, 2]
    assert store.load_gallery(spark, folder, 2).count() == 2


def test_galleries_are_repaired(spark):
    rows = [(0, 5, [1.0, 0.0]), (1, 6, [0.0, 1.0]), (2, None, [0.0, 1.0]), (3, 7, [1.0, 0.0]), (4, 8, None)]
    torn = spark.createDataFrame(rows, "index_row long, person_id long, v array<double>")
    assert sorted(r["index_row"] for r in store.repaired(torn, 2).collect()) == [0, 1]
    assert store.next_index(store.repaired(torn, 2)) == 2 and store.next_index(torn.where("false")) == 0
    assert store.repaired(torn, 3).count() == 0, "of another model"
    assert store.repaired(torn.where("index_row < 2"), 2).count() == 2 and store.repaired(torn.where("false"), 2).count() == 0


def tree(rng, depth):
    node = {"name": f"n{rng.randint(0, 99)}", "data_type": rng.choice(["string", "object", "number"]), "value": rng.choice([None, "x", "a \"quoted\" \u00e9", ""])}
    if depth and rng.random() < 0.8:
        node["children"] = [tree(rng, depth - 1) for _ in range(rng.randint(0, 3))]
    return node


def walked(objects, start):
    """ids by a plain walk: a node before its children."""
    out, number = [], [start]

    def visit(o, node, parent):
        own, number[0] = number[0], number[0] + 1
        out.append((own, o, parent, node["name"], node["data_type"], node["value"]))
        for child in node.get("children", []):
            visit(o, child, own)

    for o, nodes in objects:
        for node in nodes:
            visit(o, node, None)
    return out


def test_trees_of_any_depth(spark):
    rng = random.Random(3)
    objects = [(o, [tree(rng, 8) for _ in range(rng.randint(0, 3))]) for o in range(40)]
    # more children than four digits count, and a chain of sixty nodes
    chain = {"name": "end", "data_type": "string", "value": "v"}
    for k in range(60):
        chain = {"name": f"c{k}", "data_type": "object", "value": None, "children": [chain]}
    objects += [(40, [{"name": "wide", "data_type": "object", "value": None, "children": [{"name": f"k{i}", "data_type": "number", "value": str(i)} for i in range(10_050)]}]), (41, [chain])]
    df = spark.createDataFrame([(o, json.dumps(nodes)) for o, nodes in objects] + [(50, None), (51, "no json"), (52, "[]")], "object_id long, metadata string")
    got = sorted(tuple(r) for r in records.metadata_rows(document.shred(df), 7).collect())
    assert got == walked(objects, 7)
    with pytest.raises(ValueError, match="deeper"):
        document.shred(df.where("object_id = 41"), deepest=20)
    assert document.shred(df.where("object_id > 49")).count() == 0


def test_files_of_one_folder_are_found_without_all_pairs(spark):
    """A hundred thousand names in one folder: what is compared in full stays near the number of frames."""
    names = spark.range(100_000).select(F.lit(1).alias("folder"), F.concat(F.lit("img_"), F.format_string("%06d", F.col("id") * 7919 % 999_983), F.lit("_x")).alias("stem"))
    words = spark.range(0, 100_000, 40).select(F.lit(1).alias("folder"), F.format_string("%06d", F.col("id") * 7919 % 999_983).alias("word"))
    found = records.containing(words, names)
    assert found.count() == words.count() == found.where("stem = concat('img_', word, '_x')").count()


def test_files_as_a_plain_search_finds_them(spark):
    rng = random.Random(5)
    files = [(rng.randint(1, 3), "".join(rng.choices("ab1", k=rng.randint(0, 9))) + rng.choice([".jpg", ".png", ".webp", ".txt", ""])) for _ in range(300)]
    frames = [(rng.randint(1, 4), "".join(rng.choices("ab1", k=rng.randint(0, 7)))) for _ in range(200)]
    endings = (".jpg", ".png", ".jpeg", ".bmp", ".webp")
    split = lambda n: (endings.index("." + n.rpartition(".")[2]), n, n.rpartition(".")[0])
    want = set()
    for folder, frame in frames:
        known = sorted(split(n) for f, n in files if f == folder and "." in n and "." + n.rpartition(".")[2] in endings)
        hit = next((n for _, n, stem in known if stem == frame), None) or next((n for _, n, stem in known if frame in stem), None)
        want.add((folder, frame, hit))
    got = records.image_paths(spark.createDataFrame(frames, "folder int, frame string"), spark.createDataFrame(files, "folder int, name string"))
    assert {tuple(r) for r in got.collect()} == want


def test_parts_of_names_are_not_broadcast(spark):
    """Names taken apart are many times what sizes are estimated by, so no join with them may go by that."""
    frames = spark.createDataFrame([(1, str(i)) for i in range(20)], "folder int, frame string")
    files = spark.createDataFrame([(1, f"img_{i}.png") for i in range(20)], "folder int, name string")
    out = records.image_paths(frames, files)
    assert "Broadcast" not in out._jdf.queryExecution().executedPlan().toString()
    assert {r["frame"]: r["path"] for r in out.collect()}["7"] == "img_17.png"
