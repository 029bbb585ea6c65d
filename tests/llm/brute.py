"""Brute-force versions of the operators, for small tables."""
from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np


class Sets:
    """Union of linked keys, named by the smallest."""

    def __init__(self):
        self.up = {}

    def find(self, x):
        while self.up.setdefault(x, x) != x:
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = sorted((self.find(a), self.find(b)))
        self.up[b] = a


def shingles(text, k=4):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return set()
    k = min(k, len(words))
    return {tuple(words[i:i + k]) for i in range(len(words) - k + 1)}


def jaccard_components(rows, k=4, percent=85):
    """{doc_id: (size, component)} of (doc_id, text) rows by comparing all pairs."""
    own = {i: shingles(t, k) for i, t in rows}
    u, ids = Sets(), sorted(own)
    for x, a in enumerate(ids):
        for b in ids[x + 1:]:
            if own[a] and own[b] and 100 * min(len(own[a]), len(own[b])) >= percent * max(len(own[a]), len(own[b])):
                n = len(own[a] & own[b])
                if 100 * n >= percent * (len(own[a]) + len(own[b]) - n):
                    u.join(a, b)
    return {i: (len(own[i]), u.find(i)) for i in ids}


def cosine_components(rows, least=0.9):
    """{vec_id: (links, component)} by all cosines in double precision."""
    good = {i: np.array(v, float) for i, v in rows
            if v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    ids, u = sorted(good), Sets()
    x = np.stack([good[i] / np.linalg.norm(good[i]) for i in ids])
    close = x @ x.T >= least
    np.fill_diagonal(close, False)
    for a, b in zip(*np.nonzero(close)):
        u.join(ids[a], ids[b])
    links = dict(zip(ids, close.sum(1).tolist()))
    return {i: (links.get(i, 0), u.find(i)) for i, _ in rows}


PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}


def license_base(text):
    """(n_words, n_base, first, last, labels)."""
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    places, labels = [], set()
    for phrase, label in PHRASES.items():
        p = phrase.split()
        for i in range(len(words) - len(p) + 1):
            if words[i:i + len(p)] == p:
                places.append(i)
                labels.add(label)
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def pii_base(text):
    """kind:start:end of the base spans."""
    rules = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
             "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+",
             "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
    out = []
    for kind, rule in rules.items():
        for m in re.finditer(rule, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            if (kind == "email" or kind == "ip" and all(int(x) <= 255 for x in m[0].split("."))
                    or kind == "card" and 16 <= len(digits) <= 19 and luhn(digits) or kind == "phone" and 8 <= len(digits) <= 15):
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


def secret_base(text):
    """kind:start:end of the base spans, by start, then kind."""
    text, kinds = text or "", ("assign", "access", "hex")
    either = lambda w: "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in w)
    words = "|".join([either("password"), either("passwd"), either("secret"), either("token"), either("api") + "_?" + either("key")])
    out = [(m.start(), 0, m.end()) for m in re.finditer(rf"""({words})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text) if len(m[2]) >= 12]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
    return [f"{kinds[k]}:{a}:{b}" for a, k, b in sorted(out)]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def _levels(nodes):
    out = [list(nodes)]
    while len(out[-1]) > 1:
        last = out[-1]
        out.append([sha("".join(last[i:i + 3])) for i in range(0, len(last), 3)])
    return out


def _siblings(levels, pos):
    for level in levels[:-1]:
        run = pos // 3 * 3
        yield "".join(level[run:pos]), "".join(level[pos + 1:run + 3])
        pos //= 3


def manifest(rows):
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) of (doc_id, source, lang, n_chars, text) rows."""
    def leaf(row):
        return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))

    by = {}
    for row in rows:
        by.setdefault(row[1], []).append((row[0] is not None, row[0] or 0, leaf(row), row))
    order = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: _levels([x[2] for x in sorted(by[s], key=lambda x: x[:3])]) for s in order}
    top = _levels([trees[s][-1][0] for s in order])
    out = []
    for place, s in enumerate(order):
        for pos, (_, _, h, row) in enumerate(sorted(by[s], key=lambda x: x[:3])):
            path = [*_siblings(trees[s], pos), *_siblings(top, place)]
            folded = h
            if row[0] is not None and zlib.crc32(str(row[0]).encode()) % 2 == 0 and row[4] is not None:
                folded = leaf((*row[:4], row[4].replace("\n", "")))
            for a, b in path:
                folded = sha(a + folded + b)
            out.append((row[0], h, trees[s][-1][0], top[-1][0], sha("".join(a + b for a, b in path)), folded, folded == top[-1][0]))
    return out


def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def ranked(docs, items, keep=10):
    """(item_id, rank, doc_id, score) of each item by scoring every document."""
    counts = [(i, Counter(terms(t))) for i, t in docs]
    counts = [(i, c) for i, c in counts if c]
    n_docs, n_terms = len(counts), sum(sum(c.values()) for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    out = []
    for item, text in items:
        scores = []
        for i, c in counts:
            m = 10 + 90 * sum(c.values()) * n_docs // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1000000000 * c[t] // (1000 * c[t] + 8 * m))
                        for t in set(terms(text)) if c[t])
            if score:
                scores.append((-score, i is None, i))
        out += [(item, r, i, -s) for r, (s, _, i) in enumerate(sorted(scores)[:keep], 1)]
    return out


def without_repeats(rows, length=50):
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) by a table of all strings of `length` bytes."""
    data, least = [((i is None, i or 0), i, (t or "").encode()) for i, t in rows], {}
    for key, _, b in data:
        for k in range(len(b) - length + 1):
            w = b[k:k + length]
            least[w] = min(least.get(w, key), key)
    out = []
    for key, i, b in data:
        gone = bytearray(len(b))
        for k in range(len(b) - length + 1):
            if least[b[k:k + length]] < key:
                gone[k:k + length] = b"\1" * length
        spans = sum(1 for k in range(len(b)) if gone[k] and not (k and gone[k - 1]))
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(bytes(c for c, g in zip(b, gone) if not g)).hexdigest()))
    return out
