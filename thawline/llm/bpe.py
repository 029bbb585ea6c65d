"""Byte-pair encoding by a pair occurrence index, and decoding.

The distinct pieces of a block are laid out as one row of symbols. An index maps the rank of every adjacent pair to
all its positions. Active ranks are applied in ascending order; a merge removes a symbol and lists the pairs it makes
with its neighbours under their ranks. A merge's parts stem from earlier merges, so new pairs always rank later.
"""
from __future__ import annotations

import heapq
import json
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import chunks, text_of
from .tokens import encoder, flat, vocabulary_path


def byte_letters() -> list[str]:
    """The letter that stands for each byte: itself if it prints, else the next free one from 256 on."""
    prints = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, spare = [], 256
    for b in range(256):
        if b in prints:
            out.append(chr(b))
        else:
            out.append(chr(spare))
            spare += 1
    return out


class PairIndex:
    """Ids of pieces by merges of a vocabulary file; `.lower`, `.table`, `.whole` as the piece encoder wants them."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, vocab = spec["model"], spec["model"]["vocab"]
        self.lower = "Lowercase" in json.dumps(spec["normalizer"])
        self.end = model.get("end_of_word_suffix") or ""
        letters = byte_letters()
        self.inner = [vocab[c] for c in letters]
        self.last = [vocab[c + self.end] for c in letters]
        self.letter_byte = {c: b for b, c in enumerate(letters)}
        self.rank: dict[int, int] = {}
        self.left, self.right, self.made = [], [], []
        born: dict[int, int] = {}
        for r, m in enumerate(model["merges"]):
            a, b = m if isinstance(m, list) else m.split(" ")
            left, right, made = vocab[a], vocab[b], vocab[a + b]
            if max(born.get(left, -1), born.get(right, -1)) >= r:
                raise ValueError("a merge precedes the merges that make its parts")
            born.setdefault(made, r)
            self.rank.setdefault(left << 32 | right, r)
            self.left.append(left), self.right.append(right), self.made.append(made)
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.special_re = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.path, self._library = path, None
        self.byte_level = (spec.get("decoder") or {}).get("type") == "ByteLevel"
        self.token = [""] * (1 + max([*vocab.values(), *self.special.values()]))
        for t, i in [*vocab.items(), *self.special.items()]:
            self.token[i] = t

    def table(self, pieces: list[str]):
        return pieces, *flat(self.merge([p.encode() for p in pieces]))

    def merge(self, words: list[bytes]) -> list[list[int]]:
        sym, stops, inner, last = [], [], self.inner, self.last
        for w in words:
            if w:
                sym += [inner[b] for b in w[:-1]]
                sym.append(last[w[-1]])
            stops.append(len(sym))
        n = len(sym)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        for s in stops:
            if 0 < s:
                after[s - 1] = -1
            if s < n:
                before[s] = -1
        rank, places = self.rank, {}
        for i in range(n - 1):
            if after[i] >= 0:
                r = rank.get(sym[i] << 32 | sym[i + 1])
                if r is not None:
                    if r in places:
                        places[r].append(i)
                    else:
                        places[r] = [i]
        active = list(places)
        heapq.heapify(active)
        while active:
            r = heapq.heappop(active)
            a, b, made = self.left[r], self.right[r], self.made[r]
            for i in sorted(places.pop(r)):
                j = after[i]
                if sym[i] != a or j < 0 or sym[j] != b:
                    continue  # one of its symbols went into an earlier merge
                k, p = after[j], before[i]
                sym[i], sym[j], after[i] = made, -1, k
                if k >= 0:
                    before[k] = i
                    q = rank.get(made << 32 | sym[k])
                    if q is not None:
                        if q in places:
                            places[q].append(i)
                        else:
                            places[q] = [i]
                            heapq.heappush(active, q)
                if p >= 0:
                    q = rank.get(sym[p] << 32 | made)
                    if q is not None:
                        if q in places:
                            places[q].append(p)
                        else:
                            places[q] = [p]
                            heapq.heappush(active, q)
        out, s = [], 0
        for e in stops:
            out.append([x for x in sym[s:e] if x >= 0])
            s = e
        return out

    def whole(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Texts beyond the plain alphabet: special tokens first, then the library's normalizer and cutter."""
        if self._library is None:
            from tokenizers import Tokenizer
            self._library = Tokenizer.from_file(self.path)
        normal, cutter = self._library.normalizer, self._library.pre_tokenizer
        out = []
        for text in texts:
            ids: list[int] = []
            for part in self.special_re.split(text) if self.special_re else [text]:
                if part in self.special:
                    ids.append(self.special[part])
                elif part:
                    part = normal.normalize_str(part) if normal else part
                    words = [bytes(map(self.letter_byte.__getitem__, w)) for w, _ in cutter.pre_tokenize_str(part)]
                    known = dict.fromkeys(words)
                    for w, x in zip(known, self.merge(list(known))):
                        known[w] = x
                    for w in words:
                        ids += known[w]
            out.append(ids)
        return flat(out)

    def decode(self, ids: list[int]) -> str:
        """Byte-level vocabularies give their bytes; one without a decoder gives its tokens with blanks between."""
        tokens = map(self.token.__getitem__, ids)
        if self.byte_level:
            return bytes(map(self.letter_byte.__getitem__, "".join(tokens))).decode("utf-8", "replace")
        return " ".join(tokens)


def op6_bpe_round_trip(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Encode and decode every whole text; one row per row of `docs`.

    Null text is empty and has no ids. Repeated rows are rows of their own. No rows give no rows.
    """
    path = path or vocabulary_path("word_bpe_49k.json")

    def run(batches):
        import hashlib
        enc = encoder(path, PairIndex)
        decode = enc.source.decode
        for batch in batches:
            texts = batch.column("text").to_pylist()
            keys = batch.column("doc_id")
            for a, b in chunks(texts):
                ids, stops = enc.encode(texts[a:b])
                sizes = np.diff(stops)
                own = [ids[s:e] for s, e in zip(stops[:-1], stops[1:])]
                yield pa.record_batch({
                    "doc_id": keys.slice(a, b - a), "n_tokens": pa.array(sizes, pa.int64()),
                    "ids_sha256": [hashlib.sha256(x.astype("<u4").tobytes()).hexdigest() for x in own],
                    "decoded_sha256": [hashlib.sha256(decode(x.tolist()).encode()).hexdigest() for x in own]})

    rows = docs.select("doc_id", text_of().alias("text"))
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string")
