"""License scans, in DataFrame functions alone: an exact set-similarity join of text blocks with license templates.

A block is a window: as many words in a row as a template has, and the share of other words that the threshold allows,
whatever lines they stand on. Block and template are sets of words, lower-cased. A template is found where the share of
its words that a block holds is at least `threshold`. All words of templates are put in one order by their frequency over
all documents, rarest first; then, for a template of n words of which `need` must be found,

    prefix    a text must hold one of the template's first n - need + 1 words;
    length    it must hold at least `need` words of the templates' vocabulary;
    position  from the first shared word on, both must have `need` words left;

and in what passes the template's words are listed with their places, and the windows that end at them counted exactly.
Templates are few and a parameter, so they stand in the plan as literals and the join needs no shuffle; only
frequencies, one for each template word, are aggregated.

Null and empty texts have no words and no labels. A phrase or template found more than once gives its label once.
Repeated rows are scanned each; ties in frequency go by the word; other columns are ignored; an empty table gives no
rows. The score is the best share of a template found, 1 where a base phrase stands, else 0.
"""

from __future__ import annotations

import re
from math import ceil

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What words are made of and what stands between them, before case is folded; phrases with their labels.
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Notices by which licenses are commonly stated.
TEMPLATES = (
    ("apache", "Licensed under the Apache License, Version 2.0"),
    ("apache", "you may not use this file except in compliance with the License"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl", "it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
)


def words_of(text: str) -> list[str]:
    """Distinct words in the order of their first places."""
    return list(dict.fromkeys(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.translate(str.maketrans(UPPER, LOWER)))))


def _words(text: Column) -> Column:
    """Words in order, with an empty text before the first or after the last where the text doesn't begin or end with one;
    splitting is far cheaper than finding each word."""
    return F.split(F.translate(text, UPPER, LOWER), GAP + "+", -1)


def _number(words: Column) -> Column:
    """How many words there are."""
    ends = (F.element_at(words, 1) == "").cast("int") + ((F.size(words) > 1) & (F.element_at(words, -1) == "")).cast("int")
    return (F.size(words) - ends).cast("long")


def _whole(alternatives: list[str]) -> str:
    """A pattern of any of these word sequences, in either case."""
    return f"(?<!{WORD})(?i:{'|'.join((GAP + '+').join(map(re.escape, a.split(' '))) for a in alternatives)})(?!{WORD})"


def frequencies(docs: DataFrame, vocabulary: list[str]) -> dict[str, int]:
    """How often each word of the templates stands in all texts."""
    if not vocabulary:
        return {}
    rows = docs.select(F.explode(_words(F.col("text"))).alias("word")).where(F.col("word").isin(vocabulary)).groupBy("word").count()
    return {r["word"]: r["count"] for r in rows.collect()}


def _strings(values: list[str]) -> Column:
    return F.array(*map(F.lit, values)).cast("array<string>")


def licenses(docs: DataFrame, templates: tuple[tuple[str, str], ...] = TEMPLATES, threshold: float = 0.8) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels and score of every row of docs (doc_id, text)."""
    df = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    sets = [(label, words_of(text)) for label, text in templates]
    vocabulary = sorted({w for _, ws in sets for w in ws})
    count = frequencies(df, vocabulary)
    order = sorted(vocabulary, key=lambda w: (count.get(w, 0), w))
    rank = {w: i for i, w in enumerate(order)}
    df = df.withColumn("_words", _words(F.col("text")))
    df = df.withColumn("n_words", _number(F.col("_words"))).withColumn("_some", F.arrays_overlap("_words", _strings(sorted({p.split(" ")[-2] for p in PHRASES}))))
    firsts, lasts, counts, held = [], [], [], []
    for i, (phrase, label) in enumerate(PHRASES.items()):
        pattern, size = _whole([phrase]), len(phrase.split(" "))
        gaps = f"_gaps{i}"
        df = df.withColumn(gaps, F.when(F.col("_some") & F.col("text").rlike(pattern), F.split("text", pattern, -1)))
        n = F.coalesce(F.size(gaps) - 1, F.lit(0))
        found = F.col(gaps).isNotNull()
        first = F.regexp_count(F.element_at(gaps, 1), F.lit(WORD + "+"))
        last = F.col("n_words") - F.regexp_count(F.element_at(gaps, -1), F.lit(WORD + "+")) - size
        counts.append(F.when(found, n).otherwise(0))
        firsts.append(F.when(found, first.cast("long")))
        lasts.append(F.when(found, last.cast("long")))
        held.append(F.when(found, F.lit(label)))
    prefixes, rows = set(), []
    for (label, ws), (_, text) in zip(sets, templates):
        span = ceil(len(re.findall(WORD + "+", text)) / threshold)
        ws = sorted(ws, key=rank.__getitem__)
        need = ceil(threshold * len(ws) - 1e-9)
        first = ws[: len(ws) - need + 1]
        prefixes.update(first)
        rows.append(F.struct(F.lit(label).alias("label"), _strings(ws).alias("words"), _strings(first).alias("prefix"), F.lit(need).alias("need"), F.lit(span).alias("span")))
    some = F.arrays_overlap("_words", _strings(sorted(prefixes)))
    if not rows:
        df = df.withColumn("_met", F.array().cast("array<struct<label:string,share:double>>"))
    else:
        known, table = _strings(order), F.array(*rows)

        def passing(block: Column) -> Column:
            def passes(t: Column) -> Column:
                shared = F.array_intersect(t["words"], block)
                start = F.element_at(shared, 1)
                left = F.least(F.size(t["words"]) - F.array_position(t["words"], start), F.size(block) - F.array_position(block, start)) + 1
                return F.arrays_overlap(t["prefix"], block) & (F.size(block) >= t["need"]) & (left >= t["need"]) & (F.size(shared) >= t["need"])

            return F.filter(table, passes)

        def most(t: Column, placed: Column) -> Column:
            """The most of a template's words in a window; placed: a text's words with their places."""
            listed = F.filter(placed, lambda x: F.array_contains(t["words"], x["word"]))

            def window(own: Column, x: Column, k: Column) -> Column:
                # as each has a place of its own, no more than a window's words end with this one
                near = F.filter(F.slice(own, F.greatest(F.lit(1), k + 2 - t["span"]), F.least(t["span"], k + 1)), lambda y: y["place"] > x["place"] - t["span"])
                return F.when(F.size(near) >= t["need"], F.size(F.array_distinct(F.transform(near, lambda y: y["word"]))))

            return F.element_at(F.transform(F.array(listed), lambda own: F.array_max(F.transform(own, lambda x, k: window(own, x, k)))), 1)

        def met(words: Column) -> Column:
            placed = F.transform(words, lambda w, i: F.struct(i.alias("place"), w.alias("word")))
            shares = F.transform(passing(F.array_intersect(known, words)), lambda t: F.struct(t["label"].alias("label"), t["need"].alias("need"), F.size(t["words"]).alias("n"), most(t, placed).alias("most")))
            return F.transform(F.filter(shares, lambda x: F.coalesce(x["most"] >= x["need"], F.lit(False))), lambda x: F.struct(x["label"].alias("label"), (x["most"] / x["n"]).alias("share")))

        empty = F.array().cast("array<struct<label:string,share:double>>")
        df = df.withColumn("_met", F.when(some, met(F.col("_words"))).otherwise(empty))
    base = F.array_sort(F.array_distinct(F.array_compact(F.array(*held))))
    every = F.array_sort(F.array_union(base, F.transform("_met", lambda x: x["label"])))
    n_base = sum(counts[1:], counts[0]).cast("long")
    best = F.coalesce(F.array_max(F.transform("_met", lambda x: x["share"])), F.lit(0.0))
    return df.select(
        "doc_id",
        "n_words",
        n_base.alias("n_base"),
        F.least(*firsts).alias("first_word"),
        F.greatest(*lasts).alias("last_word"),
        F.array_join(base, ",").alias("base_labels"),
        F.array_join(every, ",").alias("labels"),
        F.when(n_base > 0, 1.0).otherwise(best).alias("score"),
    )


def oracle_sql(templates: tuple[tuple[str, str], ...] = TEMPLATES, threshold: float = 0.8) -> str:
    """The same rows in DuckDB SQL, over every window and template of texts that hold enough of the template's words."""
    word = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

    def listed(values: list[str]) -> str:
        return "[" + ", ".join(f"'{v}'" for v in values) + "]"

    places = [f"list_filter(range(1, len(ws) - {len(p.split(' ')) - 2}), lambda i: ws[i:i + {len(p.split(' ')) - 1}] = {listed(p.split(' '))})" for p in PHRASES]
    shares = []
    for label, text in templates:
        ws, span = words_of(text), ceil(len(re.findall(WORD + "+", text)) / threshold)
        need = ceil(threshold * len(ws) - 1e-9)
        most = f"CASE WHEN len(list_intersect(kinds, {listed(ws)})) >= {need} THEN list_max(list_transform(range(1, len(ws) + 1), lambda i: len(list_intersect(ws[i:i + {span - 1}], {listed(ws)})))) END"
        shares.append(f"{{'label': '{label}', 'need': {need}, 'n': {float(len(ws))}, 'most': {most}}}")
    labels = ", ".join(f"CASE WHEN len(p{i}) > 0 THEN '{label}' END" for i, label in enumerate(PHRASES.values()))
    return f"""
        WITH d AS (SELECT doc_id, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS t FROM documents),
        w AS (SELECT *, list_distinct(ws) AS kinds FROM (SELECT doc_id, regexp_extract_all(t, '{word}') AS ws FROM d)),
        p AS (SELECT doc_id, ws, {', '.join(f'{x} AS p{i}' for i, x in enumerate(places))},
                list_transform(list_filter([{', '.join(shares)}], lambda x: coalesce(x.most >= x.need, FALSE)), lambda x: {{'label': x.label, 'share': x.most / x.n}}) AS met
              FROM w),
        q AS (SELECT *, list_filter([{labels}], lambda x: x IS NOT NULL) AS base FROM p)
        SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words,
            CAST({' + '.join(f'len(p{i})' for i in range(len(places)))} AS BIGINT) AS n_base,
            CAST(list_min(flatten([{', '.join(f'p{i}' for i in range(len(places)))}])) - 1 AS BIGINT) AS first_word,
            CAST(list_max(flatten([{', '.join(f'p{i}' for i in range(len(places)))}])) - 1 AS BIGINT) AS last_word,
            coalesce(array_to_string(list_sort(list_distinct(base)), ','), '') AS base_labels,
            coalesce(array_to_string(list_sort(list_distinct(list_concat(base, [x.label FOR x IN met]))), ','), '') AS labels,
            CASE WHEN len(base) > 0 THEN 1.0::DOUBLE ELSE coalesce(list_max([x.share FOR x IN met]), 0)::DOUBLE END AS score
        FROM q"""
