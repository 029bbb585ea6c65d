"""Token ids of whole texts, by pieces.

A tokenizer cuts a text into pieces and encodes each piece alone, so a worker encodes each distinct piece once and
then only looks it up. Pieces are cut here for plain texts (ASCII and Latin letters, where the rules below equal
the tokenizer's own); any other text goes to the library whole.
"""
from __future__ import annotations

import json
import re

import numpy as np

from .common import worker_memory

LETTERS = "A-Za-zÀ-ÖØ-öø-įı-ſ"
NOT_PLAIN = re.compile(f"[^\t\n\r -~{LETTERS}]")
ENDINGS = "'s|'t|'re|'ve|'m|'ll|'d"
BYTE_PIECES = re.compile(f" ?[{LETTERS}]+|{ENDINGS}| ?[0-9]+| ?[^ \t\n\r0-9{LETTERS}]+|[ \t\n\r]+(?![^ \t\n\r])|[ \t\n\r]+")
WORD_PIECES = re.compile(f"[{LETTERS}]+|{ENDINGS}|[0-9]|[^ \t\n\r0-9{LETTERS}]+")
MOST_PIECES = 400_000  # distinct pieces a worker remembers before it starts anew


def is_plain(text: str) -> bool:
    return "<|" not in text and (text.isascii() and text.replace("\n", " ").isprintable() or not NOT_PLAIN.search(text))


def vocabulary_path(name: str) -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


def flat(rows: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """(all ids in a row, number of each row)."""
    sizes = np.fromiter(map(len, rows), np.int64, len(rows))
    return np.fromiter((i for r in rows for i in r), np.uint32, int(sizes.sum())), sizes


class Library:
    """Ids of pieces and of whole texts by the tokenizers library."""

    TOGETHER = 2000  # words encoded as one text

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.lower = "Lowercase" in json.dumps(spec["normalizer"])
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.size = self.tokenizer.get_vocab_size()
        end = spec["model"].get("end_of_word_suffix") or ""
        vocab = self.tokenizer.get_vocab(with_added_tokens=False)
        self.width = np.zeros(max(vocab.values()) + 1, np.int64)  # bytes of each id: a token has a letter for each
        for t, i in vocab.items():
            self.width[i] = len(t) - (len(end) if end and t.endswith(end) else 0)

    def whole(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        return flat([e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)])

    def table(self, pieces: list[str]):
        """(pieces in the order of the result, ids, number of ids of each). Words go as running text, which the
        tokenizer cuts at the same places; where a word ends in the ids follows from the bytes."""
        words = [p for p in pieces if (p.isalpha() if self.lower else p[0] == " " and p[1:].isalpha())]
        rest = list(set(pieces).difference(words))
        ids, sizes = [], []
        for a in range(0, len(words), self.TOGETHER):
            own = words[a:a + self.TOGETHER]
            text = (" " if self.lower else "").join(own)  # a piece of the other kind holds the blank before its word
            got = np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)
            reach = np.cumsum(self.width[got])
            ends = np.cumsum(list(map(len, own)) if text.isascii() else [len(p.encode()) for p in own])
            stops = np.searchsorted(reach, ends) + 1
            if stops[-1] != len(got) or (reach[stops - 1] != ends).any():
                raise ValueError("words and ids do not end together")
            ids.append(got)
            sizes.append(np.diff(stops, prepend=0))
        got, n = self.whole(rest)
        return words + rest, np.concatenate([*ids, got]), np.concatenate([*sizes, n])


class PieceEncoder:
    """`source` gives .lower, .table(pieces) and .whole(texts)."""

    def __init__(self, source):
        self.source = source
        self.cutter = WORD_PIECES if source.lower else BYTE_PIECES
        self._clear()

    def _clear(self):
        self.known: dict = {}
        self.flat = np.empty(0, np.uint32)
        self.first = np.zeros(1, np.int64)  # piece i has flat[first[i]:first[i + 1]]

    def _learn(self, new: list):
        whole = [x[0] for x in new if type(x) is tuple]
        short, ids, sizes = self.source.table([x for x in new if type(x) is not tuple])
        more, n = self.source.whole(whole)
        for i, p in enumerate([*short, *[(t,) for t in whole]], len(self.first) - 1):
            self.known[p] = i
        self.flat = np.concatenate([self.flat, ids, more])
        self.first = np.concatenate([self.first, self.first[-1] + np.cumsum(np.concatenate([sizes, n]))])

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in a row, first id of each text and the end)."""
        if len(self.known) > MOST_PIECES:
            self._clear()
        pieces, ends, find, lower = [], np.zeros(len(texts) + 1, np.int64), self.cutter.findall, self.source.lower
        odd = []
        for i, t in enumerate(texts):
            if is_plain(t):
                pieces += find(t.lower() if lower else t)
            else:
                odd.append((t,))
                pieces.append((t,))
            ends[i + 1] = len(pieces)
        new = set(pieces).difference(self.known)
        if new:
            self._learn(list(new))
        at = np.fromiter(map(self.known.__getitem__, pieces), np.int64, len(pieces))
        for p in odd:
            self.known.pop(p, None)
        starts = self.first[at]
        sizes = self.first[at + 1] - starts
        stops = np.concatenate([[0], np.cumsum(sizes)])
        ids = self.flat[np.repeat(starts - stops[:-1], sizes) + np.arange(stops[-1])]
        return ids, stops[ends]


def encoder(path: str, kind=Library) -> PieceEncoder:
    """One encoder per worker process and vocabulary."""
    kept, key = worker_memory("tokens"), (path, kind.__name__)
    if key not in kept:
        kept[key] = PieceEncoder(kind(path))
    return kept[key]
