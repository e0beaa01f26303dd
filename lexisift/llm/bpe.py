"""Exact byte-level BPE by dynamic programming over prefixes.

For every prefix of a piece there is exactly one token that ends the prefix's encoding. It is found among the tokens that are
suffixes of the prefix (all matches of a suffix automaton over the vocabulary, longest first): the right one is the token that
is compatible with the last token of the shorter prefix before it. Two tokens are compatible if encoding their joined bytes
gives the two tokens again; that is decided by undoing merges from the younger token. Back-pointers give the ids.
"""

from __future__ import annotations

import functools
import json
import os
from array import array

import ahocorasick
import regex

# Fixed value: the published pre-tokenisation pattern of this vocabulary.
PIECE_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
CACHE_PIECES = 200_000
CACHE_PIECE_BYTES = 400


def default_vocabulary() -> str:
    """Path of the public vocabulary; the environment or a parameter may name another."""
    try:
        import public_tokenizers

        return public_tokenizers.path("byte_bpe_50k.json")
    except ImportError:
        return os.environ.get("LEXISIFT_BPE", "/opt/tokenizers/byte_bpe_50k.json")


def _printable_bytes() -> dict[str, str]:
    """Inverse of the byte-to-printable mapping used in the vocabulary file, to latin-1 characters."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): chr(b) for b in shown} | {chr(256 + i): chr(b) for i, b in enumerate(hidden)}


class PrefixEncoder:
    """Encoder over one vocabulary file (merges in rank order). Pieces repeat, so their ids are cached within a bound."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        back = _printable_bytes()
        latin = {t: "".join(back[c] for c in t) for t in model["vocab"] if all(c in back for c in t)}
        vocab = model["vocab"]
        self.merged: dict[tuple[int, int], int] = {}
        self.rank: dict[int, int] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        for rank, m in enumerate(model["merges"]):
            a, b = m.split(" ") if isinstance(m, str) else m
            if a + b in vocab:
                ia, ib, ic = vocab[a], vocab[b], vocab[a + b]
                self.merged[ia, ib] = ic
                if ic not in self.parts:
                    self.parts[ic], self.rank[ic] = (ia, ib), rank + 1
        self.length, self.whole = {}, {}
        self.automaton = ahocorasick.Automaton()
        for t, i in vocab.items():
            if t in latin and (i in self.parts or len(latin[t]) == 1):
                self.automaton.add_word(latin[t], i)
                self.length[i] = len(latin[t])
                self.whole[latin[t]] = i
        self.automaton.make_automaton()
        self.pairs: dict[tuple[int, int], bool] = {}
        self.cache: dict[str, array] = {}
        self.findall = regex.compile(PIECE_PATTERN).findall

    def compatible(self, left: int, right: int) -> bool:
        """Whether BPE of left's and right's bytes joined is [left, right]: no merge across the seam may come before one inside."""
        key = (left, right)
        known = self.pairs.get(key)
        if known is not None:
            return known
        rank, parts = self.rank, self.parts
        a, b = left, right
        bound = float("inf")  # merges across the seam must rank below this to happen first
        while True:
            c = self.merged.get((a, b))
            if c is not None and rank[c] < bound:
                ok = False
                break
            ra, rb = rank.get(a, 0), rank.get(b, 0)
            if not ra and not rb:
                ok = True
                break
            # undo the younger merge; of equal ranks the leftmost happens first, so a seam merge also beats an equal one on its right
            if ra > rb:
                bound, a = ra, parts[a][1]
            else:
                bound, b = rb + 0.5, parts[b][0]
        if len(self.pairs) > 1_000_000:
            self.pairs.clear()
        self.pairs[key] = ok
        return ok

    def piece(self, s: str) -> array:
        """Ids of one pre-token given as latin-1 characters of its bytes."""
        one = self.whole.get(s)
        if one is not None:
            return array("i", (one,))
        n = len(s)
        last = [-1] * (n + 1)
        length, compatible = self.length, self.compatible
        for end, tok in self.automaton.iter(s):
            if last[end + 1] < 0:
                start = end + 1 - length[tok]
                if start == 0 or (last[start] >= 0 and compatible(last[start], tok)):
                    last[end + 1] = tok
        out = array("i")
        while n:
            out.append(last[n])
            n -= length[last[n]]
        out.reverse()
        return out

    def encode(self, text: str | None) -> array:
        """Ids without special tokens; empty for null and for the empty text."""
        out = array("i")
        if not text:
            return out
        cache = self.cache
        for p in self.findall(text):
            ids = cache.get(p)
            if ids is None:
                ids = self.piece(p.encode("utf-8", "surrogatepass").decode("latin-1"))
                if len(p) <= CACHE_PIECE_BYTES:
                    if len(cache) >= CACHE_PIECES:
                        cache.clear()
                    cache[p] = ids
            out.extend(ids)
        return out


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> PrefixEncoder:
    return PrefixEncoder(path)
