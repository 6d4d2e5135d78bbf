"""Token ids of whole texts, as little-endian unsigned 32-bit bytes, equal to those of the tokenizers library.

Byte-level vocabularies: the same merges by the tiktoken library, which is
several times faster. Vocabularies of words: no token reaches over white
space, so a text's ids are those of its words in sequence; words recur, their
ids are kept in a bounded table, and new words are encoded together. Texts
with unusual characters or control strings go through tokenizers as a whole.
"""

from __future__ import annotations

import json
import os
import re
from functools import cache

import numpy as np

KEPT = 1_500_000
#: White space on which Python and the libraries differ, letters beyond the Latin ones, openings of control strings.
_ODD = re.compile("[\x1c-\x1f\x85 ɐ-\U0010ffff]|<\\|")
#: A run of letters or digits, then one of punctuation: no token reaches from one to the other.
_PLAIN = re.compile(r"([^\W_]+)([^\w\s]+)")
_MARK = "|"


def _load(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


class ByteEncoder:
    """For byte-level vocabularies."""

    def __init__(self, path: str):
        import public_tokenizers
        import tiktoken

        self._whole = _load(path)
        with open(path, encoding="utf-8") as f:
            vocab = json.load(f)["model"]["vocab"]
        # byte-level files write a byte as itself where it is printable, the others by code points from 256 on
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte_of = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in shown)}
        ranks = {bytes(byte_of[c] for c in t): i for t, i in vocab.items() if all(c in byte_of for c in t)}
        special = {t.content for t in self._whole.get_added_tokens_decoder().values()}
        ranks = {t: i for t, i in ranks.items() if t.decode("utf-8", "replace") not in special}
        self._fast = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str) -> bytes:
        """The ids without any special ones added."""
        ids = self._whole.encode(text, add_special_tokens=False).ids if _ODD.search(text) else self._fast.encode_ordinary(text)
        return np.array(ids, "<u4").tobytes()


class WordEncoder:
    """For vocabularies that drop white space and case."""

    def __init__(self, path: str):
        self._whole = _load(path)
        (self._mark,) = self._whole.encode(_MARK, add_special_tokens=False).ids
        self._known: dict[str, bytes] = {}

    def _ids(self, text: str) -> bytes:
        return np.array(self._whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _learn(self, words: list[str]) -> None:
        """Encodes words in one text, divided by a mark of which none has a part."""
        plain = [w for w in words if _MARK not in w]
        if plain:
            ids = np.array(self._whole.encode(f" {_MARK} ".join(plain), add_special_tokens=False).ids, "<u4")
            data, marks = ids.tobytes(), (4 * np.flatnonzero(ids == self._mark)).tolist()
            self._known.update((w, data[a:b]) for w, a, b in zip(plain, [0, *[m + 4 for m in marks]], [*marks, len(data)], strict=True))
        self._known.update((w, self._ids(w)) for w in words if _MARK in w)

    def encode(self, text: str) -> bytes:
        """The ids without any special ones added."""
        if _ODD.search(text):
            return self._ids(text)
        known, words = self._known, text.lower().split()
        ids = list(map(known.get, words))
        if None in ids:
            if len(known) > KEPT:
                known.clear()
            ended = {w: _PLAIN.fullmatch(w) for w in {w for w in words if w not in known}}
            self._learn([x for x in {x for w, m in ended.items() for x in (m.groups() if m else (w,))} if x not in known])
            for w, m in ended.items():
                if m:
                    known[w] = known[m[1]] + known[m[2]]
            ids = list(map(known.get, words))
        return b"".join(ids)


@cache
def byte_encoder(path: str) -> ByteEncoder:
    """One for each worker process, whatever tasks it runs."""
    return ByteEncoder(path)


@cache
def word_encoder(path: str) -> WordEncoder:
    return WordEncoder(path)
