"""I-Match fingerprints over randomised lexicon subsets; DataFrame functions only.

A term is a lower-cased run of letters and digits, named by its 64-bit hash. The lexicon keeps the terms whose
document frequency lies in an inverse-document-frequency band. Frequencies are counted term by term over all documents;
the lexicon is a table, joined with the terms of the texts. Each subset keeps a random share of the lexicon, chosen by
bits of the term's hash; a fingerprint has one hash of the sorted distinct terms for each subset.
"""
from __future__ import annotations

import math
import random
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import stored, text_of

LOW_BITS = 18  # bits of a term's hash that no subset looks at
BAND = (0.25, 0.95)  # idf as a share of ln(number of documents)
SHARES = (5, 6, 7, 9)  # a subset keeps 1 / 2^x of the lexicon
PER_SHARE = 4
WORD_GAP = r"[^\p{L}\p{N}]+"
MOST_RANGES = 2000
ROWS_PER_RANGE = 500


def terms(text: Column) -> Column:
    """Distinct 64-bit hashes of a text's terms that some subset looks at, unsorted; the others never reach a fingerprint."""
    words = F.array_remove(F.split(F.lower(text), WORD_GAP), "")
    seen = lambda t: reduce(Column.__or__, [t.bitwiseAND(F.lit(m).cast("bigint")) == 0 for m in subset_masks()])
    return F.array_distinct(F.filter(F.transform(words, lambda w: F.xxhash64(w)), seen))


def lexicon(docs: DataFrame, band: tuple[float, float] = BAND) -> DataFrame:
    """(t, common): each term inside the band, and as `common` each term above it. Terms below it are left out.

    At most N^band[0] times the mean number of terms of a text are common.
    """
    total = docs.count()
    scale = math.log(max(total, 2))
    least, most = total * math.exp(-band[1] * scale), total * math.exp(-band[0] * scale)
    return (docs.select(F.explode(terms(text_of())).alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("df"))
            .filter(F.col("df") >= least).select("t", (F.col("df") > most).alias("common")))


def subset_masks(shares: tuple[int, ...] = SHARES, each: int = PER_SHARE, seed: int = 7) -> list[int]:
    """A term is in a subset if its hash has zeros under the subset's mask; the low bits are not used."""
    rng = random.Random(seed)
    masks = []
    for share in shares:
        for _ in range(each):
            masks.append(sum(1 << b for b in rng.sample(range(LOW_BITS, 63), share)))
    return masks


def fingerprint(used: Column) -> Column:
    """Array of subset hashes of a text's terms, null where a subset has none of them."""
    masks = F.array(*[F.lit(m).cast("bigint") for m in subset_masks()])
    subsets = F.transform(F.array(F.sort_array(used)), lambda u: F.transform(masks, lambda m: F.filter(u, lambda t: t.bitwiseAND(m) == 0)))[0]
    return F.transform(subsets, lambda s: F.when(F.size(s) > 0, F.xxhash64(s)))


def kept_prints(rows: DataFrame, known: DataFrame) -> DataFrame:
    """(key, fp, edited_fp) of the lexicon terms of `text` and `edited`; null for one without a lexicon term."""
    of = lambda c, a, b: F.transform(c, lambda t: F.struct(t.alias("t"), F.lit(a).alias("in_a"), F.lit(b).alias("in_b")))
    parts = [of(F.array_intersect("a", "b"), True, True), of(F.array_except("a", "b"), True, False), of(F.array_except("b", "a"), False, True)]
    pairs = (rows.select("key", terms(F.col("text")).alias("a"), terms(F.col("edited")).alias("b"))
             .select("key", F.explode(F.concat(*parts)).alias("p")).select("key", "p.*"))
    pairs = pairs.join(F.broadcast(known.filter("common").select("t")), "t", "left_anti")
    inside = pairs.join(known.filter("not common").select("t"), "t", "left_semi")
    sets = inside.groupBy("key").agg(*[F.collect_set(F.when(F.col(f"in_{x}"), F.col("t"))).alias(x) for x in "ab"])
    return sets.select("key", *[F.when(F.size(x) > 0, fingerprint(F.col(x))).alias(n) for x, n in (("a", "fp"), ("b", "edited_fp"))])


def likeness(a: Column, b: Column) -> Column:
    """Share of equal hashes among the subsets that hold a term of either text; two texts without terms are alike."""
    pairs = F.zip_with(a, b, lambda x, y: F.struct(x.alias("x"), y.alias("y")))
    used = F.size(F.filter(pairs, lambda p: p["x"].isNotNull() | p["y"].isNotNull()))
    same = F.size(F.filter(pairs, lambda p: p["x"] == p["y"]))
    return F.when(used == 0, F.lit(1.0)).otherwise(same / F.greatest(used, F.lit(1)))


def as_text(fp: Column) -> Column:
    return F.array_join(F.transform(fp, lambda h: F.coalesce(F.lpad(F.lower(F.hex(h)), 16, "0"), F.lit("-"))), ".")


def with_next(rows: DataFrame, columns: list[str], order: str = "doc_id", tie: str | None = None) -> DataFrame:
    """Each row with `next_<column>` of the row that follows in descending `order`; the first follows the last.

    Rows are cut into ranges of the order at quantiles. The top row of each range also visits the range above it,
    so every range finds its successors alone. Null orders come last; equal orders follow the hash of their values, or `tie`.
    """
    low = -(1 << 63)
    rows = rows.withColumn("_o", F.coalesce(F.col(order).cast("bigint"), F.lit(low)))
    n = rows.count()
    if n == 0:
        return rows.drop("_o").select("*", *[F.col(c).alias(f"next_{c}") for c in columns])
    k = max(1, min(MOST_RANGES, n // ROWS_PER_RANGE))
    cuts = sorted(set(rows.select(F.percentile_approx("_o", [i / k for i in range(1, k)] or [0.5], 20 * k)).head()[0]))
    # The last cut below an order names its range.
    place = F.size(F.filter(F.array(*[F.lit(c).cast("bigint") for c in cuts]), lambda c: c < F.col("_o")))
    placed = rows.withColumn("_r", place)
    tops = {r["_r"]: r["m"] for r in placed.groupBy("_r").agg(F.max("_o").alias("m")).collect()}
    used = sorted(tops)
    above = {r: used[(i + 1) % len(used)] for i, r in enumerate(used)}
    spots = range(len(cuts) + 1)
    top_of = F.get(F.array(*[F.lit(tops.get(r, low)).cast("bigint") for r in spots]), F.col("_r"))
    above_of = F.get(F.array(*[F.lit(above.get(r, r)) for r in spots]), F.col("_r"))
    visits = F.when(F.col("_o") == top_of, F.array(F.struct(F.lit(0).alias("g"), F.col("_r").alias("r")),
                                                  F.struct(F.lit(1).alias("g"), above_of.alias("r"))))
    visits = F.coalesce(visits, F.array(F.struct(F.lit(0).alias("g"), F.col("_r").alias("r"))))
    moved = placed.withColumn("_v", F.explode(visits)).withColumn("_h", F.col(tie) if tie else F.xxhash64(*columns))
    w = Window.partitionBy("_v.r").orderBy(F.col("_v.g"), F.col("_o").desc(), "_h")
    return (moved.select("*", *[F.lead(c).over(w).alias(f"next_{c}") for c in columns])
            .filter(F.col("_v.g") == 0).drop("_o", "_r", "_v", "_h"))


def op8_document_fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edited text; equal texts have equal fingerprints.

    Null text is empty. One document follows itself. Repeated rows are rows of their own. No rows give no rows.
    A text without a lexicon term that a subset looks at is described by all its terms; one without any has only nulls.
    """
    rows = docs.select("doc_id", text_of().alias("text"))
    known = stored(lexicon(rows), "lexicon")
    rows = with_next(rows, ["text"])
    n = F.length("text")
    third = F.floor(n / 3).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - third), F.substring("next_text", F.lit(1), third))
    rows = rows.withColumn("edited", edited).withColumn("key", F.xxhash64("text", "edited"))
    prints = stored(kept_prints(rows, known), "prints")
    own = rows.select("doc_id", "key", n.cast("bigint").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), F.xxhash64("text").alias("tie"),
                      fingerprint(terms(F.col("text"))).alias("every"), fingerprint(terms(F.col("edited"))).alias("edited_every"))
    described = own.join(prints, "key", "left").select("doc_id", "n_chars", "edited_sha256", "tie", F.coalesce("fp", "every").alias("fp"),
                                                       F.coalesce("edited_fp", "edited_every").alias("edited_fp"))
    rows = with_next(stored(described, "described"), ["fp"], tie="tie")
    return rows.select("doc_id", "n_chars", "edited_sha256", as_text(F.col("fp")).alias("fingerprint"),
                       as_text(F.col("edited_fp")).alias("edited_fingerprint"), likeness(F.col("fp"), F.col("edited_fp")).alias("near_edited"),
                       likeness(F.col("fp"), F.col("next_fp")).alias("near_next"))
