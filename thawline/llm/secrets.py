"""Secret scan with an incremental blob ledger; DataFrame functions only.

A path is any row with an id and a text. Equal texts are one blob, named by the SHA-256 of the text. The ledger
holds the (blob, rule, version) triples that were scanned and the findings they gave. A run scans only the triples
the ledger lacks, so a new rule version touches every blob once and an unchanged blob never again.
"""
from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from .common import text_of

SALTS = 16


@dataclass(frozen=True)
class Rule:
    """`head` is what stands before the measured value of a match; `least` is the value's least length."""
    kind: str
    version: int
    pattern: str
    least: int
    head: str = ""


ASSIGN_HEAD = r"""(?i)(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?"""
BASE_RULES = (
    Rule("assign", 1, ASSIGN_HEAD + "[A-Za-z0-9+/_.=-]+", 12, "^" + ASSIGN_HEAD),
    Rule("access", 1, "AKIA[A-Z0-9]+", 18),
    Rule("hex", 1, "[0-9a-f]{16,}", 16),  # a run of the class is one match, so the least length may stand in the pattern
)
MORE_RULES = (
    Rule("github", 1, "gh[pousr]_[A-Za-z0-9]{36,}", 40),
    Rule("slack", 1, "xox[abprs]-[A-Za-z0-9-]{10,}", 15),
    Rule("jwt", 1, r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 28),
    Rule("pem", 1, "-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----", 20),
)
RULES = BASE_RULES + MORE_RULES
LEDGER = "blob binary, kind string, version int, start bigint, stop bigint"


def blob_of(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def blobs(paths: DataFrame, path: str = "doc_id") -> DataFrame:
    """One row per distinct text: blob, text, copies, first_path. Copies fold in each task before the shuffle."""
    rows = paths.select(F.col(path).alias("path"), text_of().alias("text"))
    return (rows.groupBy(blob_of(F.col("text")).alias("blob"))
            .agg(F.any_value("text").alias("text"), F.count(F.lit(1)).alias("copies"), F.min("path").alias("first_path")))


def _matches(rule: Rule) -> Column:
    """(before, length, value) per match: characters since the last match, of the match, of its value."""
    found = F.regexp_extract_all("text", F.lit(rule.pattern), F.lit(0))
    value = (lambda m: F.length(F.regexp_replace(m, F.lit(rule.head), F.lit("")))) if rule.head else F.length
    rows = F.zip_with(F.slice(F.split("text", rule.pattern, -1), F.lit(1), F.size(found)), found,
                      lambda gap, m: F.struct(F.lit(rule.kind).alias("kind"), F.lit(rule.version).alias("version"),
                                              F.lit(rule.least).alias("least"), F.length(gap).alias("before"),
                                              F.length(m).alias("length"), value(m).alias("value")))
    due = F.array_contains("due", rule.kind) & F.col("text").rlike(rule.pattern)
    return F.when(due, F.transform(rows, lambda r, i: F.struct(i.alias("i"), r.alias("m")))).otherwise(F.array())


def scan(paths: DataFrame, rules: tuple[Rule, ...] = RULES, ledger: DataFrame | None = None,
         path: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """(distinct blobs, ledger rows new in this run).

    A triple that was scanned and has no finding is a ledger row with null start and stop. Matches of one kind are
    leftmost and do not overlap; positions are code points, end exclusive. No rows give no rows; a null text is empty.
    """
    kinds = F.array(*[F.lit(r.kind) for r in rules])
    found = blobs(paths, path)
    if ledger is None:
        todo = found.withColumn("due", kinds)
    else:
        wanted = {r.kind: r.version for r in rules}
        current = F.create_map(*[x for k, v in wanted.items() for x in (F.lit(k), F.lit(v))])
        done = (ledger.filter(F.col("version") == current[F.col("kind")])
                .groupBy("blob").agg(F.collect_set("kind").alias("done")))  # at most one entry per rule
        todo = (found.join(done, "blob", "left")
                .withColumn("due", F.array_except(kinds, F.coalesce("done", F.array().cast("array<string>"))))
                .filter(F.size("due") > 0).drop("done"))
    rows = todo.select("blob", "due", F.explode_outer(F.concat(*[_matches(r) for r in rules])).alias("x"))
    # Positions come from running lengths, so a text with very many matches costs a sort, not a square.
    spans = (rows.select("blob", "due", "x.i", "x.m.*")
             .withColumn("stop", F.expr("sum(cast(before + length as bigint)) over (partition by blob, kind order by i)"))
             .withColumn("start", F.col("stop") - F.col("length"))
             .withColumn("good", F.coalesce(F.col("value") >= F.col("least"), F.lit(False))))
    hits = spans.filter("good").select("blob", "kind", "version", "start", "stop")
    return found, hits


def scanned(found: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Ledger rows that say these blobs were scanned with these rules."""
    done = F.array(*[F.struct(F.lit(r.kind).alias("kind"), F.lit(r.version).alias("version")) for r in rules])
    return found.select("blob", F.inline(done)).select("blob", "kind", "version", F.lit(None).cast("bigint").alias("start"),
                                                       F.lit(None).cast("bigint").alias("stop"))


def findings_by_path(paths: DataFrame, found: DataFrame, hits: DataFrame, rules: tuple[Rule, ...] = RULES,
                     path: str = "doc_id") -> DataFrame:
    """One row per path row: path, array of (start, place of the rule, kind, stop) in text order.

    A blob with many paths has its findings under every salt; a blob with one path under that path's salt.
    """
    place = F.array_position(F.array(*[F.lit(r.kind) for r in rules]), F.col("kind")).cast("int")
    per_blob = (hits.withColumn("place", place).groupBy("blob")
                .agg(F.sort_array(F.collect_list(F.struct("start", "place", "kind", "stop"))).alias("spans")))
    salt_of = lambda c: F.pmod(F.xxhash64(c), F.lit(SALTS)).cast("int")
    salts = F.when(F.col("copies") > 1, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(salt_of(F.col("first_path"))))
    keyed = (found.select("blob", "copies", "first_path").join(per_blob, "blob")
             .select("blob", "spans", F.explode(salts).alias("salt")))
    rows = paths.select(F.col(path), blob_of(text_of()).alias("blob"), salt_of(F.col(path)).alias("salt"))
    empty = F.array().cast("array<struct<start:bigint,place:int,kind:string,stop:bigint>>")
    return rows.join(keyed, ["blob", "salt"], "left").select(path, F.coalesce("spans", empty).alias("spans"))


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"),
                                                                 s["stop"].cast("string"))), ",")


def op3_secret_scan(docs: DataFrame) -> DataFrame:
    """Secrets of every whole text, one row per row of `docs`.

    Null text is empty and has none. Repeated rows are rows of their own. No rows give no rows.
    """
    found, hits = scan(docs)
    rows = findings_by_path(docs, found, hits)
    base = F.filter("spans", lambda s: s["place"] <= len(BASE_RULES))
    kinds = F.transform("spans", lambda s: s["kind"])
    counts = [(F.size("spans") - F.size(F.array_remove(kinds, r.kind))).cast("bigint").alias(f"n_{r.kind}") for r in BASE_RULES]
    return rows.select("doc_id", *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
