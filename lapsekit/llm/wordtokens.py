"""Token ids of whole texts, word by word.

Where a tokenizer drops white space, never joins across it and lower-cases, a text's ids are those of its words in
order. That is tried on ``PROBE`` when the tokenizer is loaded; any other tokenizer encodes whole texts. Each distinct word is looked up in a
bounded table, and the words of a slice of texts that are not in it are encoded together: trailing ASCII punctuation is a word of its own when it
follows an ASCII letter or digit, so ``word`` and ``word,`` share an entry, and so do ASCII cases; words of letters alone go to the library in one text, as they
are one word to it, others one by one. A text that may hold a special token is encoded whole.
"""

from __future__ import annotations

import os
import re
import struct

import numpy as np

KNOWN = 1_000_000                     #: entries of the table, about 200 bytes each
SLICE = 1 << 21                       #: characters of text handled at once
TOGETHER = 2000                       #: pieces in a text
PROBE = "Hello hELLO  world\n\tit's WE'RE 12,345 x1y2 foo-bar... end. Àé ß ŒUVRE naïve, 北京 a_b $5.00! (z)\x0b\x0c~"
#: ASCII punctuation behind an ASCII letter or digit, at the end of a word
_TAIL = re.compile(rb"(?<=[a-z0-9])([!-/:-@\[-`{-~]+)(?=\s|\Z)")


class WordTokenizer:
    """``pack(texts)``: the ids of each text as little-endian unsigned 32-bit integers."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")      # tasks are what runs in parallel
        self.tokenizer = Tokenizer.from_file(path)
        self.known: dict[bytes, bytes] = {}
        self.by_word = self._by_word([PROBE]) == self._whole([PROBE])

    def pack(self, texts: list[str]) -> list[bytes]:
        out, i = [], 0
        while i < len(texts):
            j, size = i, 0
            while j < len(texts) and (j == i or size + len(texts[j]) <= SLICE):
                size += len(texts[j])
                j += 1
            out += (self._by_word if self.by_word else self._whole)(texts[i:j])
            i = j
        return out

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [struct.pack(f"<{len(e.ids)}I", *e.ids) for t in texts for e in self.tokenizer.encode_batch_fast([t], add_special_tokens=False)]

    def _by_word(self, texts: list[str]) -> list[bytes]:
        # a special token is case-sensitive: a text that may hold one is encoded whole
        split = [_TAIL.sub(rb" \1", t.encode().lower()).split() if "<|" not in t else [] for t in texts]
        known = self.known
        self._learn(set().union(*split) - known.keys())
        out = [b"".join(map(known.__getitem__, words)) for words in split]
        for i, t in enumerate(texts):
            if "<|" in t:
                out[i], = self._whole([t])
        if len(known) > KNOWN:
            known.clear()
        return out

    def _learn(self, new: set[bytes]) -> None:
        letters = [s for s in (p.decode() for p in new) if s.isalpha()]
        for i in range(0, len(letters), TOGETHER):
            part = letters[i:i + TOGETHER]
            got = self.tokenizer.encode(" ".join(part), add_special_tokens=False)
            ids, word = np.array(got.ids, "<u4"), np.array([-1 if w is None else w for w in got.word_ids])
            cuts = np.append(np.flatnonzero(np.diff(word, prepend=-1)), len(ids)).tolist()
            if len(cuts) == len(part) + 1:                            # each piece is one word to the library
                data = ids.tobytes()
                self.known.update((s.encode(), data[4 * a:4 * b]) for s, a, b in zip(part, cuts, cuts[1:]))
        left = [p for p in new if p not in self.known]
        self.known.update(zip(left, self._whole([p.decode() for p in left])))


_LOADED: dict[str, WordTokenizer] = {}


def word_tokenizer(path: str) -> WordTokenizer:
    """One per worker process and file."""
    if path not in _LOADED:
        _LOADED[path] = WordTokenizer(path)
    return _LOADED[path]
