"""Secret scans, in DataFrame functions alone.

Base spans are the matches of three patterns. The method adds strings that look random: a candidate's encoding is
inferred (hexadecimal, base 32 or base 64), and a battery tests it as a uniform draw from that alphabet: chi-squared
over eight equal parts of the alphabet, runs above and below its middle, and serial correlation of neighbours, joined by
Fisher's method. Ordinary strings get probabilities near zero, random ones are spread evenly. For each encoding and
class of length, the counts of distinct strings by probability over all documents give the share of ordinary ones among
those above a bar, as what is more there than an even spread has; the lowest bar with a share of at most `rate` holds.
Short strings, on which the tests have little power, so get a higher bar. A class with fewer than LEAST strings in its
even half, or without a bar, takes that of the nearest class of its encoding, the longer one first; without any, FIXED.

Null texts count as empty and have no spans. Spans of one kind don't overlap; a random span that overlaps a base one is
left out. Positions are code points, the end exclusive; ties of start go by kind as listed. Repeated rows are scanned
each; other columns are ignored; an empty table gives no rows. Positions within a text are summed in blocks of matches,
so that time stays near linear in their number.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from frameloom.llm.common import materialize

#: The base patterns, in the order of kinds, and the least length of what must be long enough.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
ASSIGN_LEAST, ACCESS_LEAST, HEX_LEAST = 8, 16, 32
#: The same matches after short ones are dropped, for patterns that are one run of characters.
ACCESS_LONG, HEX_LONG = r"AKIA[A-Z0-9]{12,}", r"[0-9a-f]{32,}"
CANDIDATE = r"[A-Za-z0-9+/_-]{20,}={0,2}"
#: Alphabets of encodings, in the order of their digits.
ALPHABETS = {
    "hex": "0123456789abcdef",
    "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
}
KINDS = ("assign", "access", "hex", "random")
BLOCK = 256
BINS = 50
#: Distinct strings that the half of a class with high probabilities must have for a bar of its own; and the bar where
#: no class of an encoding has as many: what a random string falls below in one of twenty cases.
LEAST, FIXED = 10, 0.05
SIZES = 4


def with_spans(df: DataFrame, name: str, pattern: str, condition: Column) -> DataFrame:
    """Adds name: array of (start, end, match) of the pattern in `text`, where the condition holds; else empty."""
    m, gaps, ends = f"_{name}_m", f"_{name}_g", f"_{name}_e"
    quoted = F.lit(pattern)
    df = df.withColumn(m, F.when(condition, F.regexp_extract_all("text", quoted, F.lit(0))).otherwise(F.array().cast("array<string>")))
    df = df.withColumn(gaps, F.when(F.size(m) > 0, F.transform(F.zip_with(F.split("text", pattern, -1), F.col(m), lambda g, x: F.length(g) + F.coalesce(F.length(x), F.lit(0))), lambda x: x.cast("long"))))
    blocks = f"transform(sequence(0, (size({m}) - 1) div {BLOCK}), b -> aggregate(slice({gaps}, b * {BLOCK} + 1, {BLOCK}), 0L, (a, x) -> a + x))"
    df = df.withColumn(ends, F.expr(f"CASE WHEN size({m}) > 0 THEN {blocks} END"))
    df = df.withColumn(ends, F.expr(f"transform(sequence(0, size({ends}) - 1), b -> aggregate(slice({ends}, 1, b), 0L, (a, x) -> a + x))"))
    at = f"{ends}[i div {BLOCK}] + aggregate(slice({gaps}, (i div {BLOCK}) * {BLOCK} + 1, i % {BLOCK} + 1), 0L, (a, x) -> a + x)"
    spans = f"transform({m}, (x, i) -> named_struct('start', {at} - length(x), 'end', {at}, 'match', x))"
    empty = "CAST(array() AS array<struct<start:bigint,end:bigint,match:string>>)"
    return df.withColumn(name, F.expr(f"CASE WHEN size({m}) > 0 THEN {spans} ELSE {empty} END")).drop(m, gaps, ends)


def _let(value: str, name: str, body: str) -> str:
    return f"transform(array({value}), {name} -> {body})[0]"


def _tail(z: str) -> str:
    """Upper tail of the normal distribution, by a rational approximation of the error function (1.5e-7)."""
    t = f"(1 / (1 + 0.3275911 * abs({z}) / sqrt(2D)))"
    half = f"(0.5 * (((((1.061405429 * {t} - 1.453152027) * {t}) + 1.421413741) * {t} - 0.284496736) * {t} + 0.254829592) * {t} * exp(-{z} * {z} / 2))"
    return f"CASE WHEN {z} >= 0 THEN {half} ELSE 1 - {half} END"


def battery(s: str) -> str:
    """SQL: (encoding, length, p) of a string column or lambda variable of candidate characters; p is null without an
    encoding."""
    a = ALPHABETS
    body = f"rtrim('=', {s})"
    kind = (
        "CASE WHEN w RLIKE '^[0-9]+$' THEN NULL WHEN w RLIKE '^([0-9a-f]+|[0-9A-F]+)$' THEN 'hex'"
        " WHEN w RLIKE '^[A-Z2-7]*[2-7][A-Z2-7]*$' THEN 'base32' ELSE 'base64' END"
    )
    alphabet = f"CASE k WHEN 'hex' THEN '{a['hex']}' WHEN 'base32' THEN '{a['base32']}' ELSE '{a['base64']}' END"
    plain = "CASE k WHEN 'hex' THEN lower(w) WHEN 'base32' THEN w ELSE translate(w, '-_', '+/') END"
    digits = "transform(sequence(1, length(u)), i -> instr(al, substring(u, i, 1)) - 1)"
    n, width = "size(ix)", "length(al)"
    chi = f"aggregate(sequence(0, 7), 0D, (acc, b) -> acc + pow(size(filter(ix, x -> (x * 8) div {width} = b)) - {n} / 8D, 2) / ({n} / 8D))"
    z_chi = "(pow(c / 7D, 1 / 3D) - (1 - 2 / 63D)) / sqrt(2 / 63D)"
    high = f"size(filter(ix, x -> x * 2 >= {width}))"
    runs = f"1 + size(filter(sequence(1, {n} - 1), i -> (ix[i] * 2 >= {width}) <> (ix[i - 1] * 2 >= {width})))"
    mid = f"(2D * h * ({n} - h) / {n} + 1)"
    z_runs = f"CASE WHEN h = 0 OR h = {n} THEN 99D ELSE (r - {mid}) / sqrt(greatest(({mid} - 1) * ({mid} - 2) / ({n} - 1), 1e-9D)) END"
    mean = f"aggregate(ix, 0D, (acc, x) -> acc + x) / {n}"
    spread = "aggregate(ix, 0D, (acc, x) -> acc + (x - mu) * (x - mu))"
    serial = f"aggregate(sequence(1, {n} - 1), 0D, (acc, i) -> acc + (ix[i] - mu) * (ix[i - 1] - mu))"
    z_serial = _let(spread, "sp", f"CASE WHEN sp = 0 THEN 99D ELSE {serial} / sp * sqrt(CAST({n} AS double)) END")
    p_chi = _let(chi, "c", _let(z_chi, "z", _tail("z")))
    p_runs = _let(high, "h", _let(runs, "r", _let(z_runs, "z", f"2 * ({_tail('abs(z)')})")))
    p_serial = _let(mean, "mu", _let(z_serial, "z", f"2 * ({_tail('abs(z)')})"))
    fisher = f"-ln(greatest({p_chi}, 1e-100D)) - ln(greatest({p_runs}, 1e-100D)) - ln(greatest({p_serial}, 1e-100D))"
    p = _let(fisher, "f", "exp(-f) * (1 + f + f * f / 2)")
    tested = _let(plain, "u", _let(alphabet, "al", _let(digits, "ix", p)))
    return _let(body, "w", _let(kind, "k", f"named_struct('encoding', k, 'length', length(w), 'p', CASE WHEN k IS NOT NULL THEN {tested} END)"))


def length_class(n: Column) -> Column:
    return F.when(n < 32, 0).when(n < 48, 1).when(n < 80, 2).otherwise(3)


def bars(tested: DataFrame, rate: float) -> list[tuple[str, int, float]]:
    """For each encoding and class of length the lowest bar on p; from counts of distinct strings by p, at most BINS a
    class."""
    part = F.least(F.floor(F.col("c.p") * BINS), F.lit(BINS - 1)).cast("int")
    strings = tested.select(F.explode("candidates").alias("c")).where("c.p is not null")
    strings = strings.select(F.xxhash64("c.match").alias("string"), F.col("c.encoding").alias("encoding"), length_class(F.col("c.length")).alias("size"), part.alias("bin")).distinct()
    by: dict[tuple[str, int], dict[int, int]] = {}
    for r in strings.groupBy("encoding", "size", "bin").count().collect():
        by.setdefault((r["encoding"], r["size"]), {})[r["bin"]] = r["count"]
    own = {}
    for key, bins in by.items():
        high = sum(n for b, n in bins.items() if b >= BINS // 2)
        even = 2 * high / BINS
        for low in range(1, BINS) if high >= LEAST else ():
            above = sum(n for b, n in bins.items() if b >= low)
            if above and (above - even * (BINS - low)) / above <= rate:
                own[key] = low / BINS
                break
    out = []
    for encoding, size in sorted(by):
        near = sorted(range(SIZES), key=lambda x: (abs(x - size), -x))
        out.append((encoding, size, next((own[encoding, x] for x in near if (encoding, x) in own), FIXED)))
    return out


def _listed(spans: list[Column]) -> Column:
    """All spans in order as start, number of the kind, end."""

    def marked(k: int, s: Column) -> Column:
        return F.transform(s, lambda x: F.struct(x["start"].alias("start"), F.lit(k).alias("kind"), x["end"].alias("end")))

    return F.sort_array(F.concat(*(marked(k, s) for k, s in enumerate(spans))))


def _joined(rows: Column) -> Column:
    name = F.create_map(*[F.lit(x) for pair in enumerate(KINDS) for x in pair])
    return F.array_join(F.transform(rows, lambda x: F.concat_ws(":", name[x["kind"]], x["start"].cast("string"), x["end"].cast("string"))), ",")


def scan(docs: DataFrame, rate: float = 0.05, keep: tuple[str, ...] = ()) -> DataFrame:
    """The spans of docs (doc_id, text): columns doc_id, assign, access, hex, random, each an array of (start, end,
    match), and the columns to keep."""
    df = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), *keep)
    df = with_spans(df, "assign", ASSIGN, F.col("text").rlike("(?i)passw|secret|token|api_?key"))
    df = with_spans(df, "access", ACCESS_LONG, F.col("text").contains("AKIA"))
    df = with_spans(df, "hex", HEX_LONG, F.lit(True))
    df = with_spans(df, "long", CANDIDATE, F.lit(True))
    df = df.withColumn("assign", F.filter("assign", lambda x: F.length(F.regexp_extract(x["match"], ASSIGN, 1)) >= ASSIGN_LEAST))
    df = df.withColumn("base", F.concat("assign", "access", "hex"))
    free = "filter(long, x -> NOT exists(base, y -> x.start < y.end AND y.start < x.end))"
    tested = _let(battery("x.match"), "q", "named_struct('start', x.start, 'end', x.end, 'match', x.match, 'encoding', q.encoding, 'length', q.length, 'p', q.p)")
    df = df.withColumn("candidates", F.expr(f"transform({free}, x -> {tested})"))
    seen = materialize(df.select("doc_id", "assign", "access", "hex", "candidates", *keep), "secrets")
    bar = F.lit(None).cast("double")
    test = lambda c: F.lit(False)
    found = bars(seen, rate)
    if found:

        def test(c: Column) -> Column:
            chain = bar
            for encoding, size, low in found:
                chain = F.when((c["encoding"] == encoding) & (length_class(c["length"]) == size), low).otherwise(chain)
            return F.coalesce(c["p"] >= chain, F.lit(False))

    random = F.transform(F.filter("candidates", test), lambda c: F.struct(c["start"].alias("start"), c["end"].alias("end"), c["match"].alias("match")))
    return seen.withColumn("random", random).drop("candidates")


def secret_spans(docs: DataFrame, rate: float = 0.05) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans and n_random of every row of docs (doc_id, text)."""
    found = scan(docs, rate)
    base = _listed([F.col(k) for k in KINDS[:3]])
    every = _listed([F.col(k) for k in KINDS])
    return found.select(
        "doc_id",
        *(F.size(k).cast("long").alias(f"n_{k}") for k in KINDS[:3]),
        F.sha2(_joined(base).cast("binary"), 256).alias("base_sha256"),
        _joined(every).alias("spans"),
        F.size("random").cast("long").alias("n_random"),
    )


def redacted(docs: DataFrame, mark: str = "[SECRET]", rate: float = 0.05) -> DataFrame:
    """docs with each run of overlapping spans replaced by a mark, and n_chars, where there is one, counted anew."""
    columns = docs.columns
    packed = docs.select("doc_id", "text", F.struct(*columns).alias("_row"))
    found = scan(packed, rate, keep=("_row",))
    spans = found.withColumn("_spans", F.expr("array_sort(transform(concat(assign, access, hex, random), x -> named_struct('start', x.start, 'end', x.end)))"))
    # a span that begins before the end of an earlier one is part of its run
    merged = "aggregate(_spans, CAST(array() AS array<struct<start:bigint,end:bigint>>), (acc, x) -> CASE WHEN size(acc) > 0 AND element_at(acc, -1).end > x.start THEN concat(slice(acc, 1, size(acc) - 1), array(named_struct('start', element_at(acc, -1).start, 'end', greatest(element_at(acc, -1).end, x.end)))) ELSE concat(acc, array(x)) END)"
    runs = spans.withColumn("_runs", F.expr(f"CASE WHEN size(_spans) > 0 THEN {merged} END"))
    piece = "substring(_row.text, CAST(CASE WHEN i = 0 THEN 1 ELSE _runs[i - 1].end + 1 END AS int), CAST(x.start - CASE WHEN i = 0 THEN 0 ELSE _runs[i - 1].end END AS int))"
    text = f"concat(array_join(transform(_runs, (x, i) -> concat({piece}, '{mark}')), ''), substring(_row.text, CAST(element_at(_runs, -1).end + 1 AS int)))"
    runs = runs.withColumn("_text", F.when(F.size("_runs") > 0, F.expr(text)).otherwise(F.col("_row.text")))
    out = {"text": F.col("_text"), "n_chars": F.when(F.size("_runs") > 0, F.length("_text")).otherwise(F.col("_row.n_chars") if "n_chars" in columns else F.lit(None)).cast("long")}
    return runs.select(*(out[c].alias(c) if c in out else F.col(f"_row.{c}").alias(c) for c in columns))
