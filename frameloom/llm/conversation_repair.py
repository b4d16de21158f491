"""Repair of conversations: the cheapest edits that make roles alternate, and what was wrong.

Rows of a conversation and 256 consecutive turns make a segment. Segments are dealt out by hash, and a task hands many
at a time to DuckDB, whose recursive query advances by one row in all of them at once: for each state of the grammar in
which a segment may begin, and each in which it may stand, it keeps the least cost and, of equal ones, the least audit.
So a segment becomes a small table of passages from state to state; those of a conversation are put together in order,
and however long one is, no task holds its rows. Hashes of repaired texts are taken row by row from sorted rows.

Of two audits of equal cost over the same rows neither begins with the other (what is longer has more insertions, and
costs more), so the lesser one stays the lesser whatever is put after both; that is why a state needs one audit.

Roles `(s?(ua)+)?` by their first letters are right: an optional system row, then user and assistant in turn. Rows are
taken by turn, nulls first; rows of one turn by role and text. Nulls of other columns count as one space: a row without
an identifier belongs to a conversation whose conv_id is null. Repeated rows are faults, not copies to leave out; they
come together as one row with a number. Empty tables give no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import dataclasses
import hashlib
from collections.abc import Iterable, Iterator

import duckdb
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from frameloom.llm.common import column, materialize

#: White space, and what ends a sentence.
BLANKS, ENDS = " \t\n\x0b\x0c\r", ".!?"
#: Turns of a segment, and rows that DuckDB gets at a time if no segment has more.
SEGMENT, BATCH_ROWS = 256, 20_000
START, SYSTEM, USER, ASSISTANT = range(4)
#: The role that may come next after each state, apart from a system row at the start.
NEXT = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
ROLE = {USER: "user", ASSISTANT: "assistant"}
#: The states that a conversation may end in.
ENDING = (START, ASSISTANT)


@dataclasses.dataclass(frozen=True)
class Costs:
    keep: int = 0
    rerole: int = 1
    delete: int = 2
    insert: int = 5
    truncated: int = 5


def inserted(state: int, costs: Costs) -> list[tuple[int, int, str]]:
    """States that insertions lead to, with costs and letters; more than two come back to a state."""
    out = [(state, 0, "")]
    for n in (1, 2):
        state = NEXT[state]
        if state not in [s for s, _, _ in out]:
            out.append((state, n * costs.insert, "I" * n))
    return out


def moves(costs: Costs) -> pa.Table:
    """What a row may do: from a state, by its kind (the first letter of its role, x for others, f for a row that must
    go), to a state, with cost, letters, and whether the row stays."""
    rows = []
    for begin in NEXT:
        for state, cost, letters in inserted(begin, costs):
            legal = {"u" if NEXT[state] == USER else "a": NEXT[state]} | ({"s": SYSTEM} if state == START else {})
            for kind in "suaxf":
                rows.append((begin, kind, state, cost + costs.delete, letters + "D", 0))
                if kind != "f":
                    rows.append((begin, kind, NEXT[state], cost + costs.rerole, letters + "R", 1))
                if kind in legal:
                    rows.append((begin, kind, legal[kind], cost + costs.keep, letters + "K", 1))
    return pa.table({name: list(values) for name, values in zip(("a", "kind", "b", "cost", "letters", "kept"), zip(*rows))})


RECURSION = """WITH RECURSIVE best(c, entry, state, n, cost, audit) USING KEY (c, entry, state) AS (
    SELECT c, e, e, 0::BIGINT, 0::BIGINT, '' FROM (SELECT DISTINCT c FROM rows), unnest([0, 1, 2, 3]) AS t(e)
    UNION
    SELECT c, entry, state, n, m.cost, m.audit FROM (
        SELECT b.c, b.entry, m.b AS state, b.n + 1 AS n, min(struct_pack(cost := (b.cost + m.cost + m.kept * r.cut * {truncated} + r.extra * {delete})::BIGINT, audit := b.audit || m.letters || repeat('D', r.extra))) AS m
        FROM best b JOIN rows r ON r.c = b.c AND r.n = b.n + 1 JOIN moves m ON m.a = b.state AND m.kind = r.kind GROUP BY b.c, b.entry, m.b, b.n))
    SELECT c, list(struct_pack(entry := entry, state := state, cost := cost, audit := audit)) AS paths FROM best JOIN (SELECT c, max(n) AS n FROM rows GROUP BY c) USING (c, n) GROUP BY c"""
PATHS = "array<struct<entry:int,state:int,cost:bigint,audit:string>>"
COUNTS = ("blank", "duplicate", "truncated", "illegal")


def damaged(rows: DataFrame) -> DataFrame:
    """The rows with faults put in by a checksum of conversation and turn; repeated ones have copies."""
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fault = F.crc32(F.concat(name("conv_id"), F.lit(":"), name("turn"))) % 20
    told = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), name("role").alias("role"), name("text").alias("text"), fault.alias("fault")).where("fault != 0")
    text = F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    return told.select("conv_id", "turn", F.when(F.col("fault") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.when(F.col("fault") == 3, 2).otherwise(1).alias("copies"))


def _place() -> Column:
    """A turn's place in order, nulls first."""
    return F.struct(F.col("turn").isNotNull().alias("known"), F.coalesce("turn", F.lit(0)).alias("turn"))


def judged(rows: DataFrame) -> DataFrame:
    """Distinct rows (conv, seg, turn, role, text) in segments, with extra copies and the first fault of each."""
    whole = rows.withColumns({"text": F.coalesce("text", F.lit(" ")), "role": F.coalesce("role", F.lit(" ")), "conv": F.coalesce(F.col("conv_id").cast("string"), F.lit(" "))})
    whole = whole.groupBy("conv", "turn", "role", "text").agg(F.sum("copies").alias("copies"))
    said = F.sha2(F.concat_ws(":", F.length("role").cast("string"), "role", "text"), 256)
    whole = whole.withColumns({"said": said, "place": _place()})
    first = whole.groupBy("conv", "said").agg(F.min("place").alias("first"))
    whole = whole.join(first, ["conv", "said"])
    whole = whole.withColumn("ended", F.rtrim("text", F.lit(BLANKS)))
    blank, again = F.col("ended") == "", F.col("place") > F.col("first")
    # the first copy may have any fault; further ones are blank where it is, else duplicates
    fault = F.when(blank, "blank").when(again, "duplicate").when(~F.right("ended", F.lit(1)).isin(*ENDS), "truncated")
    initial = F.substring("role", 1, 1)
    return whole.select(
        "conv", F.coalesce(F.floor(F.col("turn") / SEGMENT), F.lit(-(2**62))).alias("seg"), "turn", "role", "text", (F.col("copies") - 1).alias("extra"), fault.alias("fault"), F.when(initial.isin("s", "u", "a"), initial).otherwise("x").alias("initial")
    )


#: Of rows in a segment; nulls come first.
ORDER = ("conv", "seg", "turn", "role", "text")


def _grouped(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows of whole segments, many at a time."""
    held: list[pa.RecordBatch] = []
    n = 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n < BATCH_ROWS:
            continue
        table = pa.Table.from_batches(held).combine_chunks()
        conv, seg = table.column("conv").to_pylist(), table.column("seg").to_pylist()
        at = n - 1
        while at > 0 and (conv[at - 1], seg[at - 1]) == (conv[-1], seg[-1]):
            at -= 1
        if at:
            yield table.slice(0, at)
        held = table.slice(at).to_batches()
        n -= at
    if n:
        yield pa.Table.from_batches(held).combine_chunks()


def _passages(batches: Iterable[pa.RecordBatch], costs: Costs) -> Iterator[pa.RecordBatch]:
    """For each segment what is wrong in it, and its passages from state to state."""
    with duckdb.connect(config={"threads": 1, "memory_limit": "600MB", "temp_directory": ""}) as con:
        con.register("moves", moves(costs))
        for table in _grouped(batches):
            con.register("given", table)
            con.execute(
                """CREATE OR REPLACE TEMP TABLE rows AS SELECT dense_rank() OVER (ORDER BY conv, seg) AS c, row_number() OVER (PARTITION BY conv, seg ORDER BY turn NULLS FIRST, role, text) AS n, conv, seg, turn, initial, fault, extra,
                CASE WHEN fault IN ('blank', 'duplicate') THEN 'f' ELSE initial END AS kind, (coalesce(fault, '') = 'truncated')::INT AS cut FROM given"""
            )
            told = con.sql("""SELECT c, any_value(conv) AS conv, any_value(seg) AS seg, sum(fault IS NOT DISTINCT FROM 'blank')::BIGINT + sum(CASE WHEN fault IS NOT DISTINCT FROM 'blank' THEN extra ELSE 0 END)::BIGINT AS blank,
                sum(fault IS NOT DISTINCT FROM 'duplicate')::BIGINT + sum(CASE WHEN fault IS DISTINCT FROM 'blank' THEN extra ELSE 0 END)::BIGINT AS duplicate, sum(cut)::BIGINT AS truncated,
                sum(extra + (before IS NOT NULL AND before || initial NOT IN ('su', 'ua', 'au'))::INT)::BIGINT AS illegal, arg_min(initial, n) AS first, arg_max(initial, n) AS last, min(turn) AS low, max(turn) AS high, count(DISTINCT turn) AS turns
                FROM (SELECT *, lag(initial) OVER (PARTITION BY c ORDER BY n) AS before FROM rows) GROUP BY c""")  # noqa: F841
            out = con.sql(f"SELECT conv, seg, blank, duplicate, truncated, illegal, first, last, low, high, turns, paths FROM told JOIN ({RECURSION.format(**dataclasses.asdict(costs))}) USING (c)").to_arrow_table()
            yield from out.combine_chunks().to_batches()
            con.unregister("given")


SEGMENTS = f"conv string, seg long, blank long, duplicate long, truncated long, illegal long, first string, last string, low long, high long, turns long, paths {PATHS}"
RESULT = "conv string, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, parts array<struct<seg:bigint,entry:int,audit:string>>"


def put_together(segments: list[dict], costs: Costs) -> tuple[int, list[tuple[int, int, str]]]:
    """The least cost of a conversation, and for each segment in order the state that it begins in and its audit."""
    best: dict[int, tuple[int, str, list]] = {START: (0, "", [])}
    for s in segments:
        after: dict[int, tuple[int, str, list]] = {}
        for p in s["paths"]:
            if p["entry"] in best:
                cost, audit, parts = best[p["entry"]]
                new = (cost + p["cost"], audit + p["audit"], [*parts, (s["seg"], p["entry"], p["audit"])])
                if p["state"] not in after or new[:2] < after[p["state"]][:2]:
                    after[p["state"]] = new
        best = after
    ends = [(cost + more, audit + letters, parts, letters) for state, (cost, audit, parts) in best.items() for to, more, letters in inserted(state, costs) if to in ENDING]
    cost, _, parts, letters = min(ends, key=lambda x: x[:2])
    return cost, [*parts[:-1], (*parts[-1][:2], parts[-1][2] + letters)]


def _conversations(batches: Iterable[pa.RecordBatch], costs: Costs) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("conv", pa.string()), *((c, pa.int64()) for c in ("gaps", *COUNTS, "cost")), ("audit", pa.string()), ("parts", pa.list_(pa.struct([("seg", pa.int64()), ("entry", pa.int32()), ("audit", pa.string())])))])
    for batch in batches:
        out = []
        for row in batch.to_pylist():
            segments = sorted(row["segments"], key=lambda s: s["seg"])
            cost, parts = put_together(segments, costs)
            seams = sum(a["last"] + b["first"] not in ("su", "ua", "au") for a, b in zip(segments, segments[1:]))
            known = [s for s in segments if s["low"] is not None]
            gaps = max(s["high"] for s in known) - min(s["low"] for s in known) + 1 - sum(s["turns"] for s in known) if known else 0
            sums = {c: sum(s[c] for s in segments) for c in COUNTS}
            sums["illegal"] += seams
            out.append({"conv": row["conv"], "gaps": gaps, "cost": cost, "audit": "".join(p[2] for p in parts), "parts": [dict(zip(("seg", "entry", "audit"), p)) for p in parts]} | sums)
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=schema)


class Repair:
    """Repaired rows of a segment, one by one: a row at a time, and at the end what is inserted after the last."""

    def __init__(self, state: int, audit: str):
        self.state, self.audit, self.at = state, audit, 0

    def insertions(self) -> Iterator[tuple[str, str]]:
        while self.audit[self.at : self.at + 1] == "I":
            self.at += 1
            self.state = NEXT[self.state]
            yield ROLE[self.state], ""

    def row(self, role: str, text: str, extra: int) -> Iterator[tuple[str, str]]:
        yield from self.insertions()
        letter = self.audit[self.at]
        self.at += 1 + extra
        if letter == "K":
            self.state = SYSTEM if self.state == START and role[:1] == "s" else NEXT[self.state]
            yield role, text
        elif letter == "R":
            self.state = NEXT[self.state]
            yield ROLE[self.state], text


def _repaired(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[str, str, str]]:
    """conv, role and text of repaired rows, from rows in order with each segment's audit ahead of it."""
    conv, repair = None, None
    for batch in batches:
        for c, audit, entry, role, text, extra in zip(*(column(batch, k).to_pylist() for k in ("conv", "audit", "entry", "role", "text", "extra"))):
            if audit is not None:
                if repair:
                    yield from ((conv, *x) for x in repair.insertions())
                conv, repair = c, Repair(entry, audit)
            else:
                yield from ((c, *x) for x in repair.row(role, text, extra))
    if repair:
        yield from ((conv, *x) for x in repair.insertions())


def _hashes(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One hash for each conversation with repaired rows, fed row by row."""
    out: list[tuple[str, str]] = []
    conv, held = None, None
    batch = lambda: pa.RecordBatch.from_arrays([pa.array([c for c, _ in out], pa.string()), pa.array([h for _, h in out], pa.string())], names=["conv", "repaired_sha256"])
    for c, role, text in _repaired(batches):
        if c != conv:
            if held:
                out.append((conv, held.hexdigest()))
            if len(out) >= 10_000:
                yield batch()
                out.clear()
            conv, held = c, hashlib.sha256()
        else:
            held.update(b"\n")
        held.update(f"{role}:{text}".encode())
    if held:
        out.append((conv, held.hexdigest()))
    yield batch()


def _rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Repaired rows with their numbers from 0."""
    conv, n, out = None, 0, []
    schema = pa.schema([("conv", pa.string()), ("n", pa.int64()), ("role", pa.string()), ("text", pa.string())])
    for c, role, text in _repaired(batches):
        conv, n = c, n + 1 if c == conv else 0
        out.append({"conv": c, "n": n, "role": role, "text": text})
        if len(out) >= 1000:
            yield pa.RecordBatch.from_pylist(out, schema=schema)
            out = []
    yield pa.RecordBatch.from_pylist(out, schema=schema)


def repaired(rows: DataFrame, costs: Costs | None = None) -> tuple[DataFrame, DataFrame]:
    """Of rows (conv_id, turn, role, text, copies): for each conversation (conv) gaps, the counts, cost, audit and its parts;
    and the rows in order with the parts' audits, as `digests` and `repaired_rows` take them."""
    costs = costs or Costs()
    held = materialize(judged(rows), "turns")
    dealt = held.repartition("conv", "seg").sortWithinPartitions(*ORDER)
    segments = dealt.mapInArrow(lambda batches: _passages(batches, costs), SEGMENTS)
    whole = segments.groupBy("conv").agg(F.collect_list(F.struct("seg", *COUNTS, "first", "last", "low", "high", "turns", "paths")).alias("segments"))
    found = materialize(whole.mapInArrow(lambda batches: _conversations(batches, costs), RESULT), "conversations")
    parts = found.select("conv", F.explode("parts").alias("p")).select("conv", "p.seg", "p.entry", "p.audit")
    ordered = held.select("conv", "seg", "turn", "role", "text", "extra").unionByName(parts, allowMissingColumns=True)
    ordered = ordered.repartition("conv").sortWithinPartitions("conv", "seg", F.col("audit").isNull(), "turn", "role", "text")
    return found, ordered


def digests(ordered: DataFrame) -> DataFrame:
    """conv and the hash of each conversation that has repaired rows."""
    return ordered.mapInArrow(_hashes, "conv string, repaired_sha256 string")


def repaired_rows(ordered: DataFrame) -> DataFrame:
    """conv_id, n, role and text of the repaired conversations."""
    return ordered.mapInArrow(_rows, "conv string, n long, role string, text string").select(_conv_id(), "n", "role", "text")


def _conv_id() -> Column:
    return F.nullif("conv", F.lit(" ")).cast("long").alias("conv_id")


def repairs(conversations: DataFrame, costs: Costs | None = None) -> DataFrame:
    """What is wrong in each damaged conversation, and its repair. A conversation of which no row is left has zeros, an
    empty audit, and the hash of nothing."""
    every = conversations.select(F.coalesce(F.col("conv_id").cast("long").cast("string"), F.lit(" ")).alias("conv")).distinct()
    found, ordered = repaired(damaged(conversations), costs)
    out = every.join(found.drop("parts"), "conv", "left").join(digests(ordered), "conv", "left")
    numbers = ("gaps", *COUNTS, "cost")
    return out.select(_conv_id(), *(F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in numbers), F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"))
