"""License scan by diagonal voting.

Every rolling word 2-gram of a document is joined with the positions of the same 2-gram in the templates. A hit votes
for the diagonal (document position minus template position). Neighbouring diagonals merge, since a few inserted or
lost words move a copy to the next ones. A merged span that holds enough of a template's 2-grams is verified: its hits
are aligned with the template, in word order and over a bounded length, and where alignments with several templates
share a stretch of text, the best covering one keeps it.
Base phrases count only where one diagonal holds all their 2-grams, that is, where their words stand consecutively.
"""
from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .common import chunks, text_of
from .words import rolling, word_hashes

K = 2
DRIFT = 4  # diagonals at most so far apart are one copy
COVER = 0.6  # share of a template's 2-grams an alignment needs
LENGTH = 2  # an alignment is at most so many times as long as its template
# The base phrases and their labels.
BASE = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))
TEMPLATES = (
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "mit"),
    ("licensed under the apache license version 2 0 you may not use this file except in compliance with the license", "apache-2.0"),
    ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "bsd"),
    ("this source code form is subject to the terms of the mozilla public license v 2 0", "mpl-2.0"),
    ("under the terms of the gnu general public license as published by the free software foundation", "gpl-notice"),
    ("under the terms of the gnu lesser general public license as published by the free software foundation", "lgpl-notice"),
    ("this work is licensed under a creative commons attribution 4 0 international license", "cc-by-4.0"),
    ("to the extent possible under law the author has waived all copyright and related rights", "cc0-1.0"),
    ("this is free and unencumbered software released into the public domain", "unlicense"),
    ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "isc"),
)

_GAP = bytes(b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32 for b in bytes(range(256)).lower())


def words_of(text: str) -> list[bytes]:
    """A-Z in lower case; words are runs of digits, a-z and all characters above 127."""
    return text.encode("utf-8", "replace").translate(_GAP).split()


def key_of(doc_id, text: str) -> int:
    h = xxhash.xxh3_64(text.encode("utf-8", "replace"))
    h.update(repr(doc_id).encode())
    return h.intdigest()


def template_grams(spark: SparkSession, base=BASE, templates=TEMPLATES) -> DataFrame:
    """(gram, template, tpos) of the given templates: a table as long as their words, whatever the corpus."""
    rows = []
    for i, (phrase, _) in enumerate([*base, *templates]):
        for j, g in enumerate(rolling(word_hashes(words_of(phrase)), K).astype(np.int64).tolist()):
            rows.append((g, i, j))
    return spark.createDataFrame(rows, "gram long, template int, tpos int")


def grams(docs: DataFrame) -> DataFrame:
    """A row per document (pos -1, with its id and number of words) and one per rolling 2-gram; `key` names the row's
    id and text, so equal rows share it."""
    rows = docs.select("doc_id", text_of().alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            texts, ids = batch.column("text").to_pylist(), batch.column("doc_id")
            names = ids.to_pylist()
            for a, b in chunks(texts):
                words = [words_of(t) for t in texts[a:b]]
                sizes = np.fromiter(map(len, words), np.int64, len(words))
                keys = np.array([key_of(i, t) for i, t in zip(names[a:b], texts[a:b])], np.uint64).astype(np.int64)
                m = b - a
                yield pa.record_batch({"key": pa.array(keys, pa.int64()), "pos": pa.array(np.full(m, -1), pa.int32()),
                                       "gram": pa.nulls(m, pa.int64()), "doc_id": ids.slice(a, m), "n_words": pa.array(sizes, pa.int64())})
                flat = word_hashes([w for ws in words for w in ws])
                ends = np.cumsum(sizes)
                owner = np.repeat(np.arange(m), sizes)
                pos = np.arange(len(flat)) - np.repeat(ends - sizes, sizes)
                inner = np.flatnonzero(owner[:-1] == owner[1:]) if len(owner) > 1 else np.empty(0, np.int64)
                g = rolling(flat, K)[inner].astype(np.int64)
                for s in range(0, len(inner), 1 << 16):
                    e = inner[s:s + (1 << 16)]
                    yield pa.record_batch({"key": pa.array(keys[owner[e]], pa.int64()), "pos": pa.array(pos[e], pa.int32()),
                                           "gram": pa.array(g[s:s + (1 << 16)], pa.int64()), "doc_id": pa.nulls(len(e), ids.type),
                                           "n_words": pa.nulls(len(e), pa.int64())})

    return rows.mapInArrow(run, f"key long, pos int, gram long, doc_id {kind}, n_words long")


def alignments(hits: list[tuple[int, int]], need: int) -> list[list[int]]:
    """Positions of the aligned 2-grams of each copy of a template of `need` 2-grams, from left to right.

    Along an alignment both positions rise, the diagonal moves by DRIFT at most from hit to hit, and it ends within
    LENGTH * need words. Of the alignments that start in one another, the longest is a copy, then the tightest.
    """
    hits, least, out = sorted(set(hits)), COVER * need, []
    best, i, stop = [], 0, -1
    while i < len(hits) or best:
        if best and (i == len(hits) or hits[i][0] > stop):  # no later start lies in the best one
            out.append(best)
            while i < len(hits) and hits[i][0] <= best[-1]:
                i += 1
            best = []
            continue
        p, t = hits[i]
        i += 1
        if need - t < max(least, len(best)):
            continue
        window = [(p, t)]
        for j in range(i, len(hits)):
            q, u = hits[j]
            if q >= p + LENGTH * need:
                break
            if q > p and u > t:
                window.append((q, u))
        if len({u for _, u in window}) < max(least, len(best)):
            continue
        length, before = [1] + [0] * (len(window) - 1), [-1] * len(window)
        for b, (q, u) in enumerate(window):
            for a in range(b):
                r, v = window[a]
                if length[a] and length[a] >= length[b] and r < q and v < u and abs((q - u) - (r - v)) <= DRIFT:
                    length[b], before[b] = length[a] + 1, a
        b = max(range(len(window)), key=lambda x: (length[x], -window[x][0]))
        if length[b] < least:
            continue
        found = []
        while b >= 0:
            found.append(window[b][0])
            b = before[b]
        found.reverse()
        if not best or (len(found), -(found[-1] - found[0])) > (len(best), -(best[-1] - best[0])):
            if not best:
                stop = found[-1]
            best = found
        if len(best) == need:
            i = next((j for j in range(i, len(hits)) if hits[j][0] > best[-1]), len(hits))
    return out


def verified(spans, need: list[int]) -> dict[int, float]:
    """Best cover of each template that keeps a stretch of the text; spans: (template, [(diagonal, template positions)])."""
    copies = []
    for template, lines in spans:
        n = need[template]
        copies += [(-len(found) / n, -len(found), template, found)
                   for found in alignments([(d + t, t) for d, held in lines for t in held], n)]
    taken, out = [], {}
    for _, _, template, found in sorted(copies):
        left = [p for p in found if not any(a <= p <= b for a, b in taken)]
        if len(left) >= COVER * need[template]:
            taken.append((found[0], found[-1]))
            out[template] = max(out.get(template, 0.0), len(left) / need[template])
    return out


def with_verified(rows: DataFrame, need: list[int]) -> DataFrame:
    """Each row's `spans` replaced by `kept` (templates) and `cover` (the best cover)."""
    @F.pandas_udf("kept array<int>, cover double")
    def check(spans: pd.Series) -> pd.DataFrame:
        kept, cover = [], []
        for own in spans:
            got = verified([(s["template"], [(x["diagonal"], x["held"]) for x in s["lines"]]) for s in own], need) if len(own) else {}
            kept.append(sorted(got))
            cover.append(max(got.values(), default=None))
        return pd.DataFrame({"kept": kept, "cover": pd.Series(cover, dtype="float64")})

    return rows.withColumn("v", check("spans")).select("*", "v.kept", "v.cover").drop("v", "spans")


def scan(docs: DataFrame, base=BASE, templates=TEMPLATES) -> DataFrame:
    """One row per row of `docs`: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score."""
    spark = docs.sparkSession
    phrases = [*base, *templates]
    labels = F.array(*[F.lit(l) for _, l in phrases])
    sizes = [max(1, len(words_of(p)) - K + 1) for p, _ in phrases]
    need = F.array(*[F.lit(n) for n in sizes])
    known = F.broadcast(template_grams(spark, base, templates))  # as many rows as the templates have words
    votes = (grams(docs).join(known, "gram", "left").filter("template is not null or pos < 0")
             .withColumn("diagonal", F.col("pos") - F.col("tpos")))
    # From here on everything is by document: one exchange, of hits and one row per document.
    votes = votes.repartition("key")
    lines = (votes.groupBy("key", "template", "diagonal")
             .agg(F.collect_set("tpos").alias("held"), F.first("doc_id", True).alias("doc_id"), F.max("n_words").alias("n_words"),
                  F.count(F.lit(1)).alias("rows")))
    order = Window.partitionBy("key", "template").orderBy("diagonal")
    lines = (lines.withColumn("new", (F.col("diagonal") - F.lag("diagonal").over(order) > DRIFT).cast("int"))
             .withColumn("span", F.sum(F.coalesce("new", F.lit(0))).over(order)))
    is_base = F.col("template") < len(base)
    whole = is_base & (F.size("held") == F.get(need, F.col("template")))
    spans = (lines.groupBy("key", "template", "span")
             .agg(F.count(F.when(whole, 1)).alias("places"), F.min(F.when(whole, F.col("diagonal"))).alias("first"),
                  F.max(F.when(whole, F.col("diagonal"))).alias("last"),
                  F.size(F.array_distinct(F.flatten(F.collect_list("held")))).alias("held"),
                  F.collect_list(F.when(~is_base, F.struct("diagonal", "held"))).alias("lines"),
                  F.first("doc_id", True).alias("doc_id"), F.max("n_words").alias("n_words"),
                  F.sum(F.when(F.col("template").isNull(), F.col("rows"))).alias("copies")))
    enough = ~is_base & (F.col("held") >= COVER * F.get(need, F.col("template")))
    good = is_base & (F.col("places") > 0)
    label = F.get(labels, F.col("template"))
    out = (spans.groupBy("key")
           .agg(F.first("doc_id", True).alias("doc_id"), F.max("n_words").alias("n_words"), F.max("copies").alias("copies"),
                F.sum("places").alias("n_base"), F.min("first").cast("long").alias("first_word"), F.max("last").cast("long").alias("last_word"),
                F.collect_set(F.when(good, label)).alias("b"), F.max(F.when(good, F.lit(1.0))).alias("whole"),
                F.collect_list(F.when(enough, F.struct("template", "lines"))).alias("spans")))
    out = with_verified(out, sizes).withColumn("score", F.greatest("whole", "cover"))
    out = out.withColumn("l", F.array_union("b", F.transform("kept", lambda t: F.get(labels, t))))
    joined = lambda c: F.array_join(F.array_sort(c), ",")
    return (out.withColumn("_", F.explode(F.sequence(F.lit(1).cast("long"), "copies")))
            .select("doc_id", "n_words", "n_base", "first_word", "last_word", joined("b").alias("base_labels"),
                    joined("l").alias("labels"), F.coalesce("score", F.lit(0.0)).alias("score")))


def op9_license_scan(docs: DataFrame) -> DataFrame:
    """License labels of every whole text.

    Null text is empty and has no words. Equal rows give equal rows, one for each. No rows give no rows.
    """
    return scan(docs)
