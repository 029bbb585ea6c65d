"""Personal data: overlapping candidate spans, boosted trees over format and context, calibrated thresholds.

Base spans follow fixed rules and are always kept. Generators propose further spans with high recall, overlapping
each other and the base. Boosted trees learn from the candidates of all distinct texts and see format and context,
never the outcome of a rule. Positives are base spans and the same spans disguised in their place (written signs, other
separators, a missing plus), which the rules no longer find; negatives are all other candidates. On the half of the
texts that was not fitted, each kind gets the lowest threshold at which the candidates beyond the base keep its
precision; a kind that never reaches it adds nothing.
"""
from __future__ import annotations

import re
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .boost import BoostedTrees
from .common import dropping_exchanges, giving_back, stored, text_of

KINDS = ("email", "ip", "card", "phone")
AT_ONCE = 4096  # spans of a text whose features are taken at once
PRECISION = 0.98
LEAST_CALIBRATION = 20  # disguised positives a kind needs on the calibration part
DISGUISES = 3  # at most so many of each base span
AROUND = 64  # characters of context on both sides of a disguised span

_LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
# Wider rules of the generators.
_WIDE_AT = re.compile(r" ?(?:@|\(at\)|\[at\]) ?")
_WIDE_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?: ?(?:\.|\(dot\)|\[dot\]) ?[A-Za-z0-9-]+)+")
_TIGHT_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:(?:\.| ?\(dot\) ?| ?\[dot\] ?)[A-Za-z0-9-]+)+")
_QUAD = re.compile(r"(?<![0-9])[0-9]{1,3}(?: ?[.,:] ?[0-9]{1,3}){3}(?![0-9])")
_GROUPS = re.compile(r"(?:\+|\(|00)?[0-9](?:[ ()./_-]{0,2}[0-9])+")
_WORDS = {"email": ("mail", "contact", "write"), "ip": ("ip", "host", "server", "addr"),
          "card": ("card", "visa", "credit", "pay"), "phone": ("phone", "call", "tel", "mobile", "fax")}


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def small(digits: str) -> bool:
    """At most 255, whatever the number of leading zeros."""
    rest = digits.lstrip("0")
    return len(rest) < 4 and int(rest or "0") < 256


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end), leftmost and not overlapping within a kind; failing matches are dropped."""
    out = []
    at, done = text.find("@"), 0
    while at >= 0:
        start = at
        while start > done and _LOCAL.match(text, start - 1):
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((0, start, m.end()))
            done = m.end()
        else:
            done = at + 1
        at = text.find("@", done)
    if _DIGIT.search(text):
        out += [(1, m.start(), m.end()) for m in _IP.finditer(text) if all(small(x) for x in m[0].split("."))]
        for m in _CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                out.append((2, m.start(), m.end()))
        for m in _PHONE.finditer(text):
            if 8 <= sum(c.isdigit() for c in m[0]) <= 15:
                out.append((3, m.start(), m.end()))
    return out


def wide_mails(text: str) -> list[tuple[int, int, int]]:
    """Addresses with written or spaced signs; from each sign leftwards to the end of the last one, so every character is met once."""
    out, done = [], 0
    for sign in _WIDE_AT.finditer(text):
        start = sign.start()
        while start > done and _LOCAL.match(text, start - 1):
            start -= 1
        m = _WIDE_DOMAIN.match(text, sign.end()) if done <= start < sign.start() else None
        done = max(done, m.end() if m else sign.end())
        if m:
            out.append((0, start, m.end()))
            tight = _TIGHT_DOMAIN.match(text, sign.end())
            if tight and tight.end() != m.end():
                out.append((0, start, tight.end()))
    return out


# How a disguise changes a span of each kind: (what, by what) once, or every one of it.
_FOUR = re.compile(r"(?<=[0-9])[ -]?(?=(?:[0-9][ -]?){4}$|(?:[0-9][ -]?){8}$|(?:[0-9][ -]?){12}$)")
_PLUS = re.compile(r"^\+")
_GAP = re.compile(r"[ ().-]+(?=[0-9])")
_MANNERS = (
    tuple((("@", at), (".", dot)) for at in (" (at) ", "(at)", "[at]", " [at] ", " @ ") for dot in (".", " (dot) ", "(dot)", "[dot]")),
    tuple(((".", dot),) for dot in (" . ", ". ", " .", ":")),
    tuple(((_FOUR, gap),) for gap in (".", "/", "_", ". ", "--")),
    tuple(((_PLUS, sign), (_GAP, gap)) for sign in ("", "00", "+") for gap in ("/", "_", "-", " ", ". ")))


def disguised(kind: int, span: str) -> list[str]:
    """Up to DISGUISES ways to write a base span, the same for the same span."""
    out = []
    h = zlib.crc32(span.encode("utf-8", "replace"))
    for i in range(DISGUISES):
        new = span
        for what, by in _MANNERS[kind][(h + 7 * i) % len(_MANNERS[kind])]:
            if isinstance(what, str):
                head, sign, tail = new.rpartition("@") if what == "." and "@" in new else ("", "", new)
                written = re.search(r"\((?:at)\)|\[at\]| @ ", tail) if kind == 0 and what == "." else None
                cut = written.end() if written else 0  # dots of the name stay
                new = head + sign + tail[:cut] + tail[cut:].replace(what, by)
            else:
                new = what.sub(by, new)
        if new != span and new not in out:
            out.append(new)
    return out


def training_rows(text: str):
    """Pieces (features, positive, beyond the base) of all candidates of a text and of its base spans in disguise."""
    base = list(dict.fromkeys(base_spans(text)))
    known = set(base)
    others = [s for s in dict.fromkeys(candidates(text)) if s not in known]
    for spans, plain in ((base, True), (others, False)):
        for i in range(0, len(spans), AT_ONCE):
            own = spans[i:i + AT_ONCE]
            yield features(text, own), [plain] * len(own), [not plain] * len(own)
    for kind, a, b in base:
        left, right = text[max(0, a - AROUND):a], text[b:b + AROUND]
        for new in disguised(kind, text[a:b]):
            near, start, end = left + new + right, len(left), len(left) + len(new)
            rules = set(base_spans(near))
            spans = [s for s in dict.fromkeys(candidates(near)) if s not in rules and s[1] < end and start < s[2]]
            if spans:
                yield features(near, spans), [s == (kind, start, end) for s in spans], [True] * len(spans)


def candidates(text: str) -> list[tuple[int, int, int]]:
    """Wide spans of every kind, overlapping; base spans are not repeated here."""
    out = wide_mails(text)
    if _DIGIT.search(text):
        out += [(1, m.start(), m.end()) for m in _QUAD.finditer(text)]
        for m in _GROUPS.finditer(text):
            n = sum(c.isdigit() for c in m[0])
            if 12 <= n <= 19:
                out.append((2, m.start(), m.end()))
            if 7 <= n <= 15:
                out.append((3, m.start(), m.end()))
    return out


def features(text: str, spans: list[tuple[int, int, int]]) -> np.ndarray:
    rows = np.zeros((len(spans), 34))
    for r, (kind, a, b) in zip(rows, spans):
        s = text[a:b]
        before, after = text[max(0, a - 24):a].lower(), text[b:b + 1]
        groups = re.findall("[0-9]+", s)
        r[kind] = 1
        r[4] = len(s)
        r[5] = sum(map(len, groups))
        r[6] = len(groups)
        if groups:
            r[7], r[8], r[9] = len(groups[0]), len(groups[-1]), max(map(len, groups))
            r[10] = len(set("".join(groups)))
        for j, c in enumerate("+(.-/ @"):
            r[11 + j] = s.count(c)
        r[18] = s[0] == "+"
        r[19] = sum(c.isalpha() for c in s)
        r[20] = bool(before) and (before[-1].isalnum() or before[-1] in "_.-/")
        r[21] = after.isalnum() or after in ("_", "/", "-", "%")
        r[22] = before[-1:] == " "
        for j, k in enumerate(KINDS):
            r[23 + j] = any(w in before for w in _WORDS[k])
        r[27] = sum(c.isdigit() for c in before)
        for j, c in enumerate("[,:_@"):
            r[28 + j] = s.count(c) if c != "@" else s.count("dot") + s.count("at)") + s.count("at]")
        r[33] = len(set(map(len, groups)))
    return rows


@dataclass(frozen=True)
class PiiModel:
    trees: BoostedTrees | None = None
    thresholds: tuple[float, ...] = field(default=(2.0,) * len(KINDS))  # above 1: the kind adds nothing


def hash_of_text():
    return F.shiftrightunsigned(F.xxhash64(text_of(), F.lit("pii")), 1)


def sampled(docs: DataFrame, sample_docs: int) -> DataFrame:
    """(_h, text): at most `sample_docs` distinct texts, those first in hash order, to look at. Nothing is learned from it."""
    rows = docs.select(hash_of_text().alias("_h"), text_of().alias("text"))
    return rows.dropDuplicates(["_h"]).orderBy("_h").limit(sample_docs)


def training_table(docs: DataFrame) -> DataFrame:
    """(x, y, beyond, fold, n): the training rows of all distinct texts, equal ones counted; a text lies in one fold.

    Copies of a text are folded in each task, where it remembers them, and then by the text's hash; no text is exchanged.
    """
    width = features("", []).shape[1]

    def counted(batches):
        met: set = set()
        for batch in batches:
            for text, h in zip(batch.column("text").to_pylist(), batch.column("_h").to_pylist()):
                if h in met:
                    continue
                if len(met) > 200_000:
                    met.clear()
                met.add(h)
                got = [np.column_stack([x, y, far]).astype(np.int32) for x, y, far in training_rows(text)]
                if got:
                    yield h, *np.unique(np.concatenate(got), axis=0, return_counts=True)

    def run(batches):
        kept, size = [], 0

        def taken():
            rows = np.concatenate([r for _, r, _ in kept])
            x = pa.FixedSizeListArray.from_arrays(pa.array(rows[:, :width].ravel()), width).cast(pa.list_(pa.int32()))
            return pa.record_batch({"_h": pa.array(np.repeat([h for h, _, _ in kept], [len(r) for _, r, _ in kept]), pa.int64()), "x": x,
                                    "y": pa.array(rows[:, width] == 1), "beyond": pa.array(rows[:, width + 1] == 1),
                                    "n": pa.array(np.concatenate([n for _, _, n in kept]), pa.int64())})

        for one in counted(batches):
            kept.append(one)
            size += len(one[1])
            if size >= AT_ONCE:
                yield taken()
                kept, size = [], 0
        if kept:
            yield taken()

    rows = (docs.select(hash_of_text().alias("_h"), text_of().alias("text"))
            .mapInArrow(giving_back(run), "_h long, x array<int>, y boolean, beyond boolean, n long"))
    once = rows.groupBy("_h", "x", "y", "beyond").agg(F.max("n").alias("n"))
    return once.groupBy("x", "y", "beyond", (F.col("_h") % 2).cast("int").alias("fold")).agg(F.sum("n").alias("n"))


def learn(docs: DataFrame) -> PiiModel:
    """Trees from one half of all distinct texts, thresholds from the other."""
    width = features("", []).shape[1]
    table = stored(training_table(docs), "pii-training")
    fit = table.filter("fold = 0")
    seen = fit.agg(F.sum(F.when(~(F.col("beyond") & F.col("y")), F.col("n"))).alias("n"), F.count_distinct("y").alias("answers")).first()
    if (seen["n"] or 0) < 20 or seen["answers"] < 2:
        return PiiModel()
    trees = BoostedTrees().fit(fit, width)

    def score(batches):
        for batch in batches:
            x = batch.column("x").flatten().to_numpy().reshape(-1, width)
            hits = np.where(batch.column("y").to_numpy(zero_copy_only=False), batch.column("n").to_numpy(), 0)
            yield pa.record_batch({"kind": pa.array(x[:, :len(KINDS)].argmax(1), pa.int32()), "p": pa.array(trees.probability(x)),
                                   "n": batch.column("n"), "hits": pa.array(hits, pa.int64())})

    scored = table.filter("fold = 1 and beyond").mapInArrow(giving_back(score), "kind int, p double, n long, hits long")
    with dropping_exchanges(docs.sparkSession):
        got = {r["kind"]: r["p"] for r in calibrated(scored).collect()}
    return PiiModel(trees, tuple(got.get(k, 2.0) for k in range(len(KINDS))))


def calibrated(scored: DataFrame, precision: float = PRECISION) -> DataFrame:
    """(kind, p): the lowest threshold from which on at least `precision` of a kind's candidates are positives.

    Candidates (kind, p, n, hits) are counted by their score; running sums go over ranges of scores, then within each.
    A kind that never reaches the precision, or with fewer positives than LEAST_CALIBRATION, has no row.
    """
    part = F.floor(32 * (F.log(F.col("p") + 1e-12) - F.log(1 - F.col("p") + 1e-12))).alias("part")
    sums = [F.sum("n").alias("n"), F.sum("hits").alias("hits")]
    scores = scored.groupBy("kind", "p").agg(*sums).select("kind", "p", part, "n", "hits")
    above = Window.partitionBy("kind").orderBy(F.desc("part")).rowsBetween(Window.unboundedPreceding, -1)
    parts = scores.groupBy("kind", "part").agg(*sums).select(
        "kind", "part", *[F.coalesce(F.sum(c).over(above), F.lit(0)).alias(f"{c}_above") for c in ("n", "hits")])
    within = Window.partitionBy("kind", "part").orderBy(F.desc("p")).rowsBetween(Window.unboundedPreceding, 0)
    upto = scores.join(parts, ["kind", "part"]).select(
        "kind", "p", *[(F.col(f"{c}_above") + F.sum(c).over(within)).alias(c) for c in ("n", "hits")])
    return upto.filter((F.col("hits") / F.col("n") >= precision) & (F.col("hits") >= LEAST_CALIBRATION)).groupBy("kind").agg(F.min("p").alias("p"))


def all_spans(model: PiiModel, text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """(base spans, base and added spans), each by kind and start. An added span overlaps no other span."""
    base = sorted(base_spans(text))
    extra = []
    if model.trees is not None:
        have = set(base)
        spans = [s for s in dict.fromkeys(candidates(text)) if s not in have]
        if spans:
            p = model.trees.probability(features(text, spans))
            good = sorted((-q, s) for q, s in zip(p, spans) if q >= model.thresholds[s[0]])
            taken = sorted((a, b) for _, a, b in base)
            for _, s in good:
                if not overlaps(taken, s[1], s[2]):
                    extra.append(s)
                    taken.insert(np.searchsorted([t[0] for t in taken], s[1]) if taken else 0, (s[1], s[2]))
    return base, sorted(base + extra)


def overlaps(taken: list[tuple[int, int]], a: int, b: int) -> bool:
    return any(s < b and a < e for s, e in taken)


def redact(text: str, spans: list[tuple[int, int, int]]) -> str:
    """Each run of overlapping spans becomes the name of its first kind."""
    out, at = [], 0
    for a, b, kind in merged(spans):
        out += [text[at:a], f"<{KINDS[kind].upper()}>"]
        at = b
    return "".join(out) + text[at:]


def merged(spans):
    run = None
    for kind, a, b in sorted(spans, key=lambda s: (s[1], s[0], s[2])):
        if run and a < run[1]:
            run = (run[0], max(run[1], b), run[2])
        else:
            if run:
                yield run
            run = (a, b, kind)
    if run:
        yield run


def joined(spans) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in spans)


def op1_pii_spans(docs: DataFrame) -> DataFrame:
    """Spans of personal data in every whole text; one row per row of `docs`.

    Null text is empty and has no spans. Repeated rows are rows of their own. No rows give no rows.
    """
    model = learn(docs)

    def run(batches):
        import hashlib
        for batch in batches:
            found = [all_spans(model, t) for t in batch.column("text").to_pylist()]
            counts = [[sum(k == i for k, _, _ in base) for base, _ in found] for i in range(len(KINDS))]
            yield pa.record_batch({"doc_id": batch.column("doc_id")} | {
                f"n_{k}": pa.array(c, pa.int64()) for k, c in zip(KINDS, counts)} | {
                "base_sha256": pa.array([hashlib.sha256(joined(b).encode()).hexdigest() for b, _ in found], pa.string()),
                "spans": pa.array([joined(s) for _, s in found], pa.string())})

    rows = docs.select("doc_id", text_of().alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    counts = ", ".join(f"n_{k} long" for k in KINDS)
    return rows.mapInArrow(run, f"doc_id {kind}, {counts}, base_sha256 string, spans string")


def redacted(docs: DataFrame, model: PiiModel) -> DataFrame:
    """The rows of `docs` with all spans replaced in `text` and `n_chars` counted anew; null text stays null."""
    names = docs.columns
    schema = docs.schema

    def run(batches):
        for batch in batches:
            texts = [None if t is None else redact(t, all_spans(model, t)[1]) for t in batch.column("text").to_pylist()]
            cols = {n: batch.column(n) for n in names}
            cols["text"] = pa.array(texts, pa.string())
            if "n_chars" in cols:
                cols["n_chars"] = pa.array([None if t is None else len(t) for t in texts], cols["n_chars"].type)
            yield pa.record_batch(cols)

    return docs.mapInArrow(giving_back(run), schema)
