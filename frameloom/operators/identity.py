"""Persistent identities: decisions against a gallery, the gallery's growth, and enrollment.

Gallery: index_row, person_id, is_active, v (unit vector). The nearest k prototypes are ranked first and inactive ones
dropped after, as they take up places among the k. Decisions read a snapshot of the gallery and run in parallel; growth,
which hangs on what was created before, folds over the rest in the order of their ids, one gallery a task.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from frameloom.functions.vectors import dot, normalized
from frameloom.operators.tables import materialize, numbered
from frameloom.operators.tiles import column, meet, spread
from frameloom.operators.vectors import centroids, knn


def hits(probes: DataFrame, gallery: DataFrame, k: int, exclude_self: bool = False) -> DataFrame:
    """query_id, index_row, person_id, sim and rank of each probe's (id, v) hits among the nearest k that are active.

    exclude_self: probes are rows of the gallery, by index_row, and no hits of their own.
    """
    found = knn(probes.select("id", "v"), gallery.select(F.col("index_row").alias("id"), "v"), k, exclude_self)
    named = gallery.select(F.col("index_row").alias("id"), "person_id", "is_active")
    joined = found.join(named, "id").where(F.coalesce("is_active", F.lit(True)))
    return joined.select("query_id", F.col("id").alias("index_row"), "person_id", "sim", "rank")


def decision(sim: Column, *, t_accept: float, t_reject: float) -> Column:
    """match, create or gray by the best similarity; none creates."""
    return F.when(sim >= t_accept, "match").when(sim.isNull() | (sim <= t_reject), "create").otherwise("gray")


def decide(probes: DataFrame, gallery: DataFrame, *, t_accept: float, t_reject: float, k: int, exclude_self: bool = False) -> DataFrame:
    """query_id, outcome, person_id (of a match) and best_sim of each probe."""
    best = hits(probes, gallery, k, exclude_self).withColumn("first", F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))).where("first = 1")
    out = probes.select(F.col("id").alias("query_id")).join(best.select("query_id", "person_id", "sim"), "query_id", "left")
    kind = decision(F.col("sim"), t_accept=t_accept, t_reject=t_reject)
    return out.select("query_id", kind.alias("outcome"), F.when(kind == "match", F.col("person_id")).alias("person_id"), F.col("sim").alias("best_sim"))


def evidence(found: DataFrame, n: int = 3) -> DataFrame:
    """The first n hits of each probe, in order."""
    return found.where(F.col("rank") <= n).groupBy("query_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "person_id", "sim"))), lambda x: x["person_id"]).alias("people"))


def active_counts(gallery: DataFrame) -> DataFrame:
    return gallery.groupBy("person_id").agg(F.count_if(F.coalesce("is_active", F.lit(True))).alias("n_active"))


def support(probes: DataFrame, gallery: DataFrame, *, min_sim_add: float, most: int, k: int, exclude_self: bool = False) -> DataFrame:
    """Probes (id, v, person_id) that may join their person's prototypes: the nearest is that person's and close enough,
    and there is room."""
    top = hits(probes, gallery, k, exclude_self).where("rank = 1").select("query_id", F.col("person_id").alias("hit"), "sim")
    joined = probes.join(top, F.col("id") == F.col("query_id")).join(active_counts(gallery), "person_id", "left")
    return joined.where((F.col("hit") == F.col("person_id")) & (F.col("sim") >= min_sim_add) & (F.coalesce("n_active", F.lit(0)) < most)).select("id", "person_id", "sim")


def consolidate(gallery: DataFrame, keep_k: int) -> DataFrame:
    """index_row and is_active after each person's active prototypes but the keep_k nearest their centroid are dropped."""
    active = gallery.where("is_active")
    middle = centroids(active, "person_id").withColumnRenamed("v", "m")
    far = active.join(middle, "person_id").withColumn("far", 1 - dot(F.col("v"), F.col("m")))
    order = Window.partitionBy("person_id").orderBy("far", "index_row")
    kept = far.withColumn("place", F.row_number().over(order)).where(F.col("place") <= max(keep_k, 1)).select("index_row", F.lit(True).alias("kept"))
    return gallery.join(kept, "index_row", "left").select("index_row", "person_id", F.coalesce("kept", F.lit(False)).alias("is_active"))


def consolidated(gallery: DataFrame, keep_k: int, *, add_centroid: bool = True, deactivate: bool = True) -> DataFrame:
    """gallery (index_row, person_id, is_active, v) with each person's active prototypes brought together: their centroid is
    added as one more, active, numbered on by person, and those but the keep_k nearest it are dropped. proto_type is centroid
    for what was added, and n is how many it is the middle of. People without active prototypes stay as they are."""
    out = gallery
    if deactivate:
        out = gallery.drop("is_active").join(consolidate(gallery, keep_k).select("index_row", "is_active"), "index_row")
    out = out.select("index_row", "person_id", "is_active", "v").withColumns({"proto_type": F.lit(None).cast("string"), "n": F.lit(None).cast("long")})
    if not add_centroid:
        return out
    active = gallery.where("is_active")
    sizes = active.groupBy("person_id").agg(F.count("*").alias("n"))
    top = gallery.agg(F.coalesce(F.max("index_row"), F.lit(-1))).first()[0]
    made = numbered(centroids(active, "person_id").join(sizes, "person_id"), ["person_id"], int(top) + 1, "index_row")
    new = made.select(F.col("index_row").cast("long").alias("index_row"), "person_id", F.lit(True).alias("is_active"), "v", F.lit("centroid").alias("proto_type"), "n")
    return out.unionByName(new)


class Prototypes:
    """A gallery's prototypes in memory, in the order in which they came."""

    def __init__(self, rows: pd.DataFrame, size: int):
        rows = rows.sort_values("index_row") if len(rows) else rows
        vectors = [np.asarray(v, float) for v in rows["v"]] if len(rows) else []
        self.used = len(vectors)
        self.store = np.zeros((max(16, 2 * self.used), size))
        if vectors:
            self.store[: self.used] = np.stack(vectors)
        self.people = [int(p) for p in rows["person_id"]] if len(rows) else []
        self.active = [bool(x) for x in rows["is_active"]] if len(rows) else []
        self.n_active = Counter(p for p, a in zip(self.people, self.active) if a)
        self.next_person = max(self.people, default=0) + 1

    def search(self, v: np.ndarray, k: int) -> list[tuple[int, float]]:
        """(person, similarity) of the active ones among the k nearest, the earlier first of equals."""
        sims = self.store[: self.used] @ v
        if 0 < k < self.used:
            bar = np.partition(sims, self.used - k)[self.used - k]
            near = np.flatnonzero(sims >= bar)
        else:
            near = np.arange(self.used)
        order = near[np.argsort(-sims[near], kind="stable")][:k]
        return [(self.people[i], float(sims[i])) for i in order.tolist() if self.active[i]]

    def add(self, person: int, v: np.ndarray) -> None:
        if self.used == len(self.store):
            self.store = np.vstack([self.store, np.zeros_like(self.store)])
        self.store[self.used] = v
        self.used += 1
        self.people.append(person)
        self.active.append(True)
        self.n_active[person] += 1

    def create(self, v: np.ndarray) -> int:
        person, self.next_person = self.next_person, self.next_person + 1
        self.add(person, v)
        return person

    def identified(self, v: np.ndarray, *, t_accept: float, t_reject: float, gray_creates: bool, min_sim_add: float, most: int, k: int) -> tuple[int | None, str, float | None]:
        """Person, outcome and best similarity of a vector, which may be added."""
        near = self.search(v, k)
        person, sim = next(iter(near), (None, None))
        if sim is not None and sim >= t_accept:
            self.support(person, v, near, min_sim_add, most)
            return person, "matched", sim
        if sim is None or sim <= t_reject or gray_creates:
            return self.create(v), "created" if sim is None or sim <= t_reject else "created_gray", sim
        return None, "gray", sim

    def support(self, person: int, v: np.ndarray, near: list[tuple[int, float]], min_sim_add: float, most: int) -> None:
        """Adds v if the first of what is near is that person's and close enough, and there is room."""
        if near and near[0][0] == person and near[0][1] >= min_sim_add and self.n_active[person] < most:
            self.add(person, v)


PROTOTYPES = "index_row long, person_id long, is_active boolean, v array<double>"


def _beside(rows: DataFrame, gallery: DataFrame | None, key: str):
    """Rows and the gallery, if any, grouped by the gallery's key."""
    if gallery is None:
        gallery = rows.sparkSession.createDataFrame([], f"{key} long, {PROTOTYPES}")
    return rows.groupBy(key).cogroup(gallery.select(key, "index_row", "person_id", "is_active", "v").groupBy(key))


def fold(vectors: DataFrame, *, t_accept: float, t_reject: float, gray_creates: bool, min_sim_add: float, most: int, key: str = "gallery_id", gallery: DataFrame | None = None, k: int = 10) -> DataFrame:
    """person_id and outcome of each vector (gallery_id, id, v), taken in order against the people known so far: those of a
    gallery (gallery_id, index_row, person_id, is_active, v) and those made before.

    Outcomes: matched, created, gray (no person), or created_gray where gray creates. A matched vector becomes a
    prototype if close enough and there is room. A gallery is one task, with prototypes in memory.
    """

    def run(pdf: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        rows = []
        if len(pdf):
            pdf = pdf.sort_values("id", ignore_index=True)
            held = Prototypes(known, len(pdf["v"].iloc[0]))
            for i, v in zip(pdf["id"], pdf["v"]):
                rows.append((pdf[key].iloc[0], i, *held.identified(np.asarray(v, float), t_accept=t_accept, t_reject=t_reject, gray_creates=gray_creates, min_sim_add=min_sim_add, most=most, k=k)))
        return pd.DataFrame(rows, columns=[key, "id", "person_id", "outcome", "best_sim"]).astype({"person_id": "Int64"})

    return _beside(vectors, gallery, key).applyInPandas(run, f"{key} long, id long, person_id long, outcome string, best_sim double")


#: Prototypes that a vector is compared with at a time, vectors that ask together, and vectors whose nearest are kept.
BLOCK, ASKING, NEAREST = 2048, 1024, 1 << 17
#: Galleries beyond which they are dealt by hash.
DEALT = 4096


def named(v: np.ndarray) -> bytes:
    return hashlib.blake2b(np.ascontiguousarray(v), digest_size=16).digest()


class Nearest(Prototypes):
    """Prototypes of which equal ones share a place, and the k nearest places of vectors, which are kept: when a vector comes
    again, only what was added since is compared with it.

    Vectors that ask together pass the places in blocks. Products in single precision say which can be among the k nearest,
    by the most that such a product can be off; only their cosines are computed, each in the same way wherever they lie.
    What has no finite cosine is near nobody.
    """

    def __init__(self, rows: pd.DataFrame, size: int, k: int):
        super().__init__(rows.iloc[:0], size)
        self.k, self.off, self.longest, self.finite = k, (size + 4) * 2.0**-22, 0.0, True
        self.short, self.places, self.equal = np.zeros(self.store.shape, np.float32), {}, []
        self._forget(64)
        rows = rows.sort_values("index_row")
        for person, active, v in zip(rows["person_id"], rows["is_active"], rows["v"]):
            self._put(int(person), bool(active), np.asarray(v, float))
        self.next_person = max(self.people, default=0) + 1

    def _forget(self, room: int) -> None:
        self.at: dict[bytes, int] = {}
        self.place, self.sim = np.full((room, self.k), -1), np.full((room, self.k), -np.inf)
        self.seen = np.zeros(room, np.int64)

    def _put(self, person: int, active: bool, v: np.ndarray) -> None:
        place = self.places.setdefault(named(v), self.used)
        if place == self.used:
            if self.used == len(self.store):
                self.store, self.short = (np.vstack([x, np.zeros_like(x)]) for x in (self.store, self.short))
            self.store[place], self.short[place] = v, v
            length = float(np.sqrt(v @ v))
            if np.isfinite(length):
                self.longest = max(self.longest, length)
            else:
                self.finite = False
            self.equal.append([])
            self.used += 1
        self.equal[place].append(len(self.people))
        self.people.append(person)
        self.active.append(active)
        self.n_active[person] += active

    def add(self, person: int, v: np.ndarray) -> None:
        self._put(person, True, v)

    def _slot(self, name: bytes) -> int:
        i = self.at.setdefault(name, len(self.at))
        if i == len(self.seen):
            self.place, self.sim = (np.vstack([a, np.full_like(a, x)]) for a, x in ((self.place, -1), (self.sim, -np.inf)))
            self.seen = np.concatenate([self.seen, np.zeros_like(self.seen)])
        return i

    def ask(self, names: list[bytes], vectors: np.ndarray) -> None:
        """Brings what is kept of different vectors up to date."""
        if len(self.at) + len(names) > max(NEAREST, len(names)):
            self._forget(len(names))
        slots = np.array([self._slot(n) for n in names], np.int64)
        late = np.flatnonzero(self.seen[slots] < self.used)
        if not len(late):
            return
        late = late[np.argsort(self.seen[slots[late]], kind="stable")]
        slots, vectors, since = slots[late], vectors[late], self.seen[slots[late]]
        short, off = vectors.astype(np.float32), self.off * self.longest * np.sqrt((vectors * vectors).sum(axis=1))
        for a in range(int(since[0]), self.used, BLOCK):
            b = min(a + BLOCK, self.used)
            n = int(np.searchsorted(since, b))
            own = slots[:n]
            sims = short[:n] @ self.short[a:b].T
            if not self.finite:
                sims[~np.isfinite(sims)] = -np.inf
            bar = self.sim[own, -1]
            new = np.flatnonzero(bar == -np.inf)
            if len(new) and b - a > self.k:
                bar[new] = np.partition(sims[new], b - a - self.k, axis=1)[:, b - a - self.k] - off[new]
            i, j = np.divmod(np.flatnonzero(sims >= (bar - off[:n])[:, None]), b - a)
            fresh = j + a >= since[i]
            self._merge(own, i[fresh], j[fresh] + a, vectors)
        self.seen[slots] = self.used

    def _merge(self, slots: np.ndarray, i: np.ndarray, j: np.ndarray, vectors: np.ndarray) -> None:
        """Puts places j, which come after those kept, among the nearest of the i-th of slots and vectors."""
        sims = np.empty(len(i))
        for a in range(0, len(i), 4096):
            sims[a : a + 4096] = (self.store[j[a : a + 4096]] * vectors[i[a : a + 4096]]).sum(axis=1)
        real = np.isfinite(sims)
        rows, at = np.unique(i[real], return_inverse=True)
        if not len(rows):
            return
        own = slots[rows]
        row = np.concatenate([np.repeat(np.arange(len(rows)), self.k), at])
        place, sim = np.concatenate([self.place[own].ravel(), j[real]]), np.concatenate([self.sim[own].ravel(), sims[real]])
        order = np.lexsort((place, -sim, row))
        first = np.searchsorted(row[order], np.arange(len(rows)))
        best = order[first[:, None] + np.arange(self.k)]
        self.place[own], self.sim[own] = place[best], sim[best]

    def near(self, name: bytes, v: np.ndarray) -> list[tuple[int, float]]:
        """(person, similarity) of the active ones among the k nearest, the earlier first of equals."""
        i = self.at.get(name)
        if i is None:
            self.ask([name], v[None])
            i = self.at[name]
        elif (since := int(self.seen[i])) < self.used:
            off = self.off * self.longest * float(np.sqrt(v @ v))
            added = self.short[since : self.used] @ v.astype(np.float32)
            if len(found := np.flatnonzero(added >= self.sim[i, -1] - off)):
                self._merge(np.array([i]), np.zeros(len(found), np.int64), found + since, v[None])
            self.seen[i] = self.used
        out, last = [], None
        for p, sim in zip(self.place[i].tolist(), self.sim[i].tolist()):
            if p < 0 or len(out) >= self.k and sim < last:
                break
            out += [(-sim, x) for x in self.equal[p][: self.k]]
            last = sim
        out.sort()
        return [(self.people[x], -sim) for sim, x in out[: self.k] if self.active[x]]


class Duplicates:
    """What a gallery has seen of its frames: its prototypes, and who is taken in the group that is being resolved."""

    def __init__(self, known: pd.DataFrame, *, t_accept: float, t_reject: float, min_sim_add: float, most: int, k: int):
        self.known, self.held = known, None
        self.t_accept, self.t_reject, self.min_sim_add, self.most, self.k = t_accept, t_reject, min_sim_add, most, k
        self.group, self.taken = None, set()

    def free(self, hits: Iterable[tuple[int, float]]) -> tuple[int, float] | None:
        return next(((p, s) for p, s in hits if p >= 0 and p not in self.taken and s >= self.t_accept), None)

    def hold(self, size: int) -> Nearest:
        if self.held is None:
            self.held, self.known = Nearest(self.known, size, self.k), None
        return self.held

    def asks(self, own: int, offered: Iterable[tuple[int, float]]) -> bool:
        """Whether a detection needs the gallery whoever is taken."""
        return not any(p >= 0 and p != own and s >= self.t_accept for p, s in offered)

    def resolved(self, group: tuple[int, int], offered: Iterable[tuple[int, float]], name: bytes, v: np.ndarray | None) -> tuple[int | None, str, float | None]:
        """Person, outcome and best similarity of a group's (frame, person) next detection, with the name of its vector."""
        if group != self.group:
            self.group, self.taken = group, {group[1]}
        if hit := self.free(offered):
            out = hit[0], "reassigned", hit[1]
        elif v is None:
            return None, "none", None
        else:
            near = self.hold(len(v)).near(name, v)
            if hit := self.free(near):
                out = hit[0], "found", hit[1]
                self.held.support(hit[0], v, near, self.min_sim_add, self.most)
            else:
                best = near[0][1] if near else 0.0
                out = self.held.create(v), "dup_created" if not near or best <= self.t_reject else "dup_created_gray", best
        self.taken.add(out[0])
        return out


def _lists(values: pa.Array) -> tuple[pa.Array, list[int]]:
    """The items of all lists, and where each list begins and the last ends; null lists have none."""
    lengths = values.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    return values.flatten(), [0, *np.cumsum(lengths).tolist()]


def resolve_duplicates(df: DataFrame, gallery: DataFrame | None = None, *, t_accept: float, t_reject: float, min_sim_add: float, most: int, k: int = 10, key: str = "gallery_id", vectors: DataFrame | None = None) -> DataFrame:
    """person_id, outcome and best_sim of detections (gallery_id, frame, pos, person_id, score, v, candidates: array of
    (person_id, sim)), so that no person has two in a frame. With vectors (id, v), detections have a vector_id in place
    of v, and only those that need a vector get it.

    Of a person's detections in a frame the best score stays (kept). The others, from the best score down, take in turn:
    the first candidate that is close enough and not taken in this group (reassigned); the first such person among the
    gallery's nearest (found), which v then may support; a person of their own (dup_created, or dup_created_gray where
    the nearest is not far off). Without a vector they get nobody (none). People that are made are found by later frames,
    so those others of a gallery stream through one task in order, which holds its prototypes; ties of score go by pos. Rows
    are ranked once and written, and up to DEALT galleries are dealt to tasks by their numbers of rows.
    """
    held = "v" if vectors is None else "vector_id"
    score = F.coalesce(F.when(~F.isnan("score"), F.col("score")), F.lit(float("-inf")))
    group = Window.partitionBy(key, "frame", "person_id")
    # groups of a frame come by the first pos of each
    placed = df.select(key, "frame", "pos", "person_id", held, "candidates", F.row_number().over(group.orderBy(score.desc(), "pos")).alias("place"), F.min("pos").over(group).alias("lead"))
    # nobody, or in no frame, is no double
    first = F.col("person_id").isNull() | F.col("frame").isNull() | (F.col("place") == 1)
    needed = (F.when(~first, F.col(c)).alias(c) for c in (held, "candidates", "place", "lead"))
    placed = materialize(placed.select(key, "frame", "pos", "person_id", first.alias("first"), *needed), "placed")
    kept = placed.where("first").select(key, "frame", "pos", "person_id", F.lit("kept").alias("outcome"), F.lit(None).cast("double").alias("best_sim"))
    others = placed.where("!first")
    if vectors is not None:
        others = others.join(vectors.select(F.col("id").alias("vector_id"), "v"), "vector_id", "left")
    tile = F.coalesce(F.col(key), F.lit(-(1 << 63))).cast("long").alias("tile")
    candidates = F.transform("candidates", lambda c: F.struct(c["person_id"].cast("long").alias("person_id"), c["sim"].cast("double").alias("sim")))
    others = others.select(tile, key, "frame", "lead", "place", "pos", F.col("person_id").alias("own"), F.col("v").cast("array<double>").alias("v"), candidates.alias("candidates"))
    spark = df.sparkSession
    if gallery is None:
        gallery = spark.createDataFrame([], f"{key} long, {PROTOTYPES}")
    known = gallery.select(tile, "index_row", "person_id", "is_active", F.col("v").cast("array<double>").alias("v"))

    def load(table: pa.Table) -> tuple:
        rows = table.select(["index_row", "person_id", "is_active", "v"]).to_pandas()
        return Duplicates(rows, t_accept=t_accept, t_reject=t_reject, min_sim_add=min_sim_add, most=most, k=k), None

    def answer(state: Duplicates, batch: pa.RecordBatch) -> pa.RecordBatch:
        frame, own = column(batch, "frame").to_pylist(), column(batch, "own").to_pylist()
        options, at = _lists(column(batch, "candidates"))
        people, sims = (options.field(i).to_pylist() for i in (0, 1))
        values, begin = _lists(column(batch, "v"))
        values, real = values.to_numpy(zero_copy_only=False), column(batch, "v").is_valid().to_pylist()
        names = [named(values[begin[i] : begin[i + 1]]) if real[i] else b"" for i in range(len(frame))]
        offered = lambda i: zip(people[at[i] : at[i + 1]], sims[at[i] : at[i + 1]])
        vector = lambda i: values[begin[i] : begin[i + 1]] if real[i] else None
        rows = []
        for a in range(0, len(frame), ASKING):
            some = range(a, min(a + ASKING, len(frame)))
            asking = {names[i]: vector(i) for i in some if real[i] and state.asks(own[i], offered(i))}
            if asking:
                vectors = np.stack(list(asking.values()))
                state.hold(vectors.shape[1]).ask(list(asking), vectors)
            rows += [state.resolved((frame[i], own[i]), offered(i), names[i], vector(i)) for i in some]
        person, outcome, best = zip(*rows)
        arrays = [column(batch, key), column(batch, "frame"), column(batch, "pos"), pa.array(person, pa.int64()), pa.array(outcome), pa.array(best, pa.float64())]
        return pa.RecordBatch.from_arrays(arrays, names=[key, "frame", "pos", "person_id", "outcome", "best_sim"])

    schema = f"{key} long, frame long, pos long, person_id long, outcome string, best_sim double"
    sizes = {r["tile"]: r["count"] for r in placed.where("!first").groupBy(tile).count().limit(DEALT + 1).collect()}
    parts = spread(sizes, max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))) if len(sizes) <= DEALT else None
    done = meet(known, others.withColumns({c: F.col(c).cast("long") for c in (key, "frame", "pos")}), load, answer, schema, ["frame", "lead", "place"], alone=True, parts=parts)
    return kept.withColumns({c: F.col(c).cast("long") for c in (key, "frame", "pos", "person_id")}).unionByName(done)


def add_prototypes(gallery: DataFrame, rows: DataFrame, size: int) -> DataFrame:
    """gallery with rows (person_id, proto_id, modality, v) added: of one length, active, numbered on from the greatest index
    by person and prototype; the modality is the body's where it is null. A vector of another size than the gallery's is an
    error."""
    top = gallery.agg(F.coalesce(F.max("index_row"), F.lit(-1))).first()[0]
    wrong = F.concat(F.lit(f"a prototype needs {size} numbers and has "), F.size("v").cast("string"))
    held = rows.withColumn("v", F.when(F.size("v") == size, normalized(F.col("v"))).otherwise(F.raise_error(wrong)))
    new = numbered(held.select("person_id", "proto_id", F.coalesce("modality", F.lit("body")).alias("modality"), F.lit(True).alias("is_active"), "v"), ["person_id", "proto_id"], int(top) + 1, "index_row")
    return gallery.unionByName(new.withColumn("index_row", F.col("index_row").cast("long")), allowMissingColumns=True)


def create_people(gallery: DataFrame, rows: DataFrame, size: int) -> tuple[DataFrame, DataFrame]:
    """The people made of rows (name, proto_id, modality, v), as (name, person_id) numbered on from the greatest, and the
    gallery with their prototypes."""
    top = gallery.agg(F.coalesce(F.max("person_id"), F.lit(0))).first()[0]
    people = numbered(rows.select("name").distinct(), ["name"], int(top) + 1, "person_id").withColumn("person_id", F.col("person_id").cast("long"))
    return people, add_prototypes(gallery, rows.join(people, "name").drop("name"), size)


def labelled(detections: DataFrame, labels: DataFrame) -> DataFrame:
    """Detections (video_id, kind, rid) with their cluster's label (video_id, rid, label) as track: -1 for an embedded person
    without one, and null for others."""
    named = labels.select("video_id", "rid", F.col("label").alias("_label"))
    joined = detections.join(named, ["video_id", "rid"], "left")
    track = F.when((F.col("kind") == "person") & F.col("rid").isNotNull(), F.coalesce("_label", F.lit(-1)))
    return joined.withColumn("track_id", track.cast("long")).drop("_label")


def assigned(detections: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Detections (video_id, track_id) with what was decided on their label (video_id, label, person_id, evidence): person and
    user where there is a person, and the evidence in any case."""
    found = outcomes.select("video_id", F.col("label").alias("track_id"), F.col("person_id").alias("person_global_id"), "evidence")
    return detections.join(found, ["video_id", "track_id"], "left").withColumn("user_id", F.coalesce("person_global_id", F.col("rid") if "rid" in detections.columns else F.lit(None)))


def enroll(images: DataFrame, gallery: DataFrame, *, t_accept: float, t_reject: float, k: int) -> DataFrame:
    """Outcome of enrolling each name from its usable images (name, v: unit vectors): match, create, or an error in the gray
    zone or for vectors that cancel out; nothing is written here, so an error leaves no half-enrolled person."""
    flat = images.select("name", F.posexplode("v").alias("place", "value")).groupBy("name", "place").agg(F.avg("value").alias("m"))
    lengths = flat.groupBy("name").agg(F.sqrt(F.sum(F.col("m") * F.col("m"))).alias("length"))
    middle = centroids(images, "name").join(lengths, "name")
    keyed = middle.withColumn("id", F.abs(F.xxhash64("name")))
    out = decide(keyed.where("length >= 1e-9").select("id", "v"), gallery, t_accept=t_accept, t_reject=t_reject, k=k)
    named = keyed.select("name", F.col("id").alias("query_id")).join(out, "query_id", "left")
    return named.select("name", F.when(F.col("outcome").isNull() | (F.col("outcome") == "gray"), "error").otherwise(F.col("outcome")).alias("outcome"), "person_id", "best_sim")
