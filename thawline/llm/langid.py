"""Language identification as a mixture of languages.

Each language is a distribution of byte trigrams, learned from labelled documents. A document is a mixture: each of
its words was drawn from one language with the document's proportions. Expectation-maximisation estimates the
proportions; the set of languages grows while the penalised likelihood does.
"""
from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import chunks, give_back, text_of, worker_memory

BUCKETS = 1 << 15
DOCS_PER_LANGUAGE = 4000  # bound of the labelled sample, per language
PENALTY = 6.0  # log-likelihood that a further language has to add, besides half the log of the words
ROUNDS = 10
LEAST_SHARE = 0.02  # languages below this share of the full mixture are not tried
UNKNOWN = "und"

_LETTER = np.zeros(256, bool)
_LETTER[[*range(97, 123), *range(128, 256)]] = True


def has_letter(text: str) -> bool:
    return text.isalpha() or any(map(str.isalpha, text))


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bucket per letter byte, first position of each word, words of each text): trigrams of lower-cased UTF-8,
    each around a letter byte; letters are a-z and all bytes of other scripts."""
    parts = [t.lower().encode("utf-8", "replace") for t in texts]
    raw = np.frombuffer(b" " + b" ".join(parts) + b" ", np.uint8)
    letter = _LETTER[raw]
    c = np.where(letter, raw, 32).astype(np.uint32)
    at = np.flatnonzero(letter)
    code = (c[at - 1] << 16 | c[at] << 8 | c[at + 1]) * np.uint32(2654435761) >> np.uint32(32 - 15)
    begins = np.flatnonzero(~letter[at - 1])  # places in `at` where a word starts
    ends = 1 + np.cumsum([len(p) + 1 for p in parts])
    words = np.diff(np.concatenate([[0], np.searchsorted(at[begins], ends)])) if len(parts) else np.empty(0, np.int64)
    return code, begins, words


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    logs: np.ndarray  # buckets x languages, float32


def _mix(p: np.ndarray, owner: np.ndarray, starts: np.ndarray, n: np.ndarray, allowed: np.ndarray):
    """(proportions, log-likelihood) per document by expectation-maximisation over its allowed languages."""
    w = allowed / allowed.sum(1, keepdims=True)
    s = None
    for turn in range(ROUNDS + 1):
        r = p * w[owner]
        s = r.sum(1) + 1e-30
        if turn < ROUNDS:
            w = np.add.reduceat(r / s[:, None], starts, axis=0) / n[:, None]
    return w, np.add.reduceat(np.log(s), starts)


def predict(model: Model, texts: list[str]) -> tuple[list[str], np.ndarray, list[str]]:
    """(language, its proportion, selected languages) of each text; `und` where there is no letter or no model."""
    k, n_docs = len(model.languages), len(texts)
    lang, score, chosen = [UNKNOWN] * n_docs, np.zeros(n_docs), [""] * n_docs
    if not k or not n_docs:
        return lang, score, chosen
    code, begins, words = grams(texts)
    live = np.flatnonzero((words > 0) & np.fromiter(map(has_letter, texts), bool, n_docs))
    if not len(begins) or not len(live):
        return lang, score, chosen
    ll = np.add.reduceat(model.logs[code], begins, axis=0)
    p_all = np.exp(np.maximum(ll - ll.max(1, keepdims=True), -60.0))
    offsets = np.concatenate([[0], np.cumsum(words)])

    def part(docs):
        n = words[docs]
        starts = np.concatenate([[0], np.cumsum(n)[:-1]])
        owner = np.repeat(np.arange(len(docs)), n)
        rows = np.repeat(offsets[docs] - starts, n) + np.arange(n.sum())
        return p_all[rows], owner, starts, n

    p, owner, starts, n = part(live)
    full, _ = _mix(p, owner, starts, n, np.ones((len(live), k)))
    order = np.argsort(-full, axis=1, kind="stable")
    weights = np.zeros((len(live), k))
    weights[np.arange(len(live)), order[:, 0]] = 1.0
    best = np.add.reduceat(np.log(p[np.arange(len(owner)), order[owner, 0]]), starts).astype(float)
    open_ = np.arange(len(live))
    for size in range(2, k + 1):
        open_ = open_[full[open_, order[open_, size - 1]] >= LEAST_SHARE]
        if not len(open_):
            break
        p2, owner2, starts2, n2 = part(live[open_])
        allowed = np.zeros((len(open_), k))
        np.put_along_axis(allowed, order[open_, :size], 1.0, axis=1)
        w, got = _mix(p2, owner2, starts2, n2, allowed)
        got = got - (size - 1) * (PENALTY + 0.5 * np.log(n2))
        better = got > best[open_]
        weights[open_[better]] = w[better]
        best[open_[better]] = got[better]
        open_ = open_[better]
    for j, i in enumerate(live):
        top = int(np.argmax(weights[j]))
        lang[i], score[i] = model.languages[top], min(1.0, float(weights[j, top]))
        chosen[i] = ",".join(model.languages[x] for x in np.flatnonzero(weights[j] > 0))
    return lang, score, chosen


def piece_limit(model: Model) -> int:
    """Characters predicted at once: the tables made for them stay at some 50 MB whatever the number of languages."""
    return max(1 << 14, min(1 << 18, (1 << 20) // max(1, len(model.languages))))


def held_out(doc_id: Column) -> Column:
    """crc32 of the id as text, mod 4, is 2; a null id is not held out."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def learn(labelled: DataFrame, bound: int = DOCS_PER_LANGUAGE) -> Model:
    """Trigram distributions from (doc_id, text, lang); about `bound` documents of each language, chosen by id hash.

    The driver gets one row per language and non-empty bucket.
    """
    rows = labelled.filter(F.col("lang").isNotNull())
    counts = {r.lang: r["count"] for r in rows.groupBy("lang").count().collect()}
    if not counts:
        return Model((), np.zeros((BUCKETS, 0), np.float32))
    languages = tuple(sorted(counts))
    share = F.create_map(*[x for l in languages for x in (F.lit(l), F.lit(min(1.0, bound / counts[l]) * 1e6))])
    sample = rows.filter(F.pmod(F.xxhash64(F.col("doc_id"), F.lit("langid")), F.lit(1_000_000)) < share[F.col("lang")])
    place = {l: i for i, l in enumerate(languages)}

    def count(batches):
        tally = np.zeros((len(place), BUCKETS), np.int64)
        for batch in batches:
            texts, langs = batch.column("text").to_pylist(), batch.column("lang").to_pylist()
            for a, b in chunks(texts):
                for l in set(langs[a:b]):
                    tally[place[l]] += np.bincount(grams([t for t, x in zip(texts[a:b], langs[a:b]) if x == l])[0], minlength=BUCKETS)
        l, g = np.nonzero(tally)
        yield pa.record_batch({"l": pa.array(l, pa.int32()), "g": pa.array(g, pa.int32()), "n": pa.array(tally[l, g], pa.int64())})

    got = (sample.select(text_of().alias("text"), "lang").mapInArrow(count, "l int, g int, n long")
           .groupBy("l", "g").agg(F.sum("n").alias("n")).toArrow())
    table = np.full((BUCKETS, len(languages)), 0.5)
    table[got["g"].to_numpy(), got["l"].to_numpy()] += got["n"].to_numpy()
    return Model(languages, np.log(table / table.sum(0)).astype(np.float32))


def with_language(docs: DataFrame, model: Model, columns: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """`columns` of each row and lang_pred, score, langs (the selected set), predicted from the text alone."""
    rows = docs.select(*columns, text_of().alias("_text"))
    limit = piece_limit(model)

    def run(batches):
        worker_memory("languages")
        for batch in batches:
            texts = batch.column("_text").to_pylist()
            kept = batch.select(list(columns))
            for a, b in chunks(texts, limit):
                lang, score, chosen = predict(model, texts[a:b])
                part = kept.slice(a, b - a)
                yield pa.record_batch(part.columns + [pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(chosen, pa.string())],
                                      names=[*columns, "lang_pred", "score", "langs"])

    schema = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in columns)
    return rows.mapInArrow(run, f"{schema}, lang_pred string, score double, langs string")


def train_on_open(docs: DataFrame) -> Model:
    """A model from the rows that are not held out."""
    return learn(docs.filter(~held_out(F.col("doc_id"))).select("doc_id", "text", "lang"))


def op4_language_mixture(docs: DataFrame) -> DataFrame:
    """Language of every document, learned from those that are not held out.

    Null text or one without a letter is `und` with score 0, as is every text if no row has a language. Repeated rows
    are rows of their own. No rows give no rows.
    """
    model = train_on_open(docs)
    rows = docs.select("doc_id", "text").withColumn("held_out", held_out(F.col("doc_id")))
    return with_language(rows, model, ("doc_id", "held_out"))


def in_known_language(docs: DataFrame, model: Model, least: float) -> DataFrame:
    """The rows of `docs`, all columns, whose text has a known language with at least the share `least`."""
    limit = piece_limit(model)

    @F.pandas_udf("boolean")
    def known(texts: pd.Series) -> pd.Series:
        worker_memory("languages")
        own, good = texts.tolist(), []
        for a, b in chunks(own, limit):
            lang, score, _ = predict(model, own[a:b])
            good += [l != UNKNOWN and s >= least for l, s in zip(lang, score)]
        give_back()
        return pd.Series(good, dtype=bool)

    return docs.filter(known(text_of()))  # only the texts go to Python, the rows stay where they are
