"""Byte-level BPE ids of whole texts by the tokenizers library, one call a distinct word.

A byte-level pre-token never crosses from a non-space to a space, so a text can
be cut before every white-space run without changing its ids. Each such segment
is encoded once and kept in a bounded table of the Python worker; a segment
outside the table is encoded again when it comes again, so the bound costs time
and never rows.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np

#: Segments and letter runs that a worker keeps; a hundred bytes each.
KEPT_SEGMENTS = 300_000
KEPT_WORDS = 400_000

# --- fixed values: Unicode white space, as the tokenizer's pattern counts it ---
WHITE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
_SEGMENT = re.compile(f"[{WHITE}]*[^{WHITE}]+|[{WHITE}]+")
_ODD_SPACE = re.compile("[\\t\\x0b-\\r\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]")
#: A word of Latin letters with its plain punctuation: two pre-tokens at most.
PLAIN = re.compile("( ?[A-Za-zÀ-ÖØ-öø-ÿ]+)([.,;:!?|%$&*#]*)")
_CUT = "\x00"


def segments(text: str) -> list[str]:
    """Cuts before each white-space run; joined they are the text."""
    if (
        "  " in text or " \n" in text or "\n " in text or "\n\n" in text or _CUT in text
        or _ODD_SPACE.search(text)
    ):
        return _SEGMENT.findall(text)
    cut = text.replace(" ", _CUT + " ").replace("\n", _CUT + "\n").split(_CUT)
    return cut if cut[0] else cut[1:]


def byte_letters() -> list[str]:
    """The letter that stands for each byte: printable ones themselves, others from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return [chr(b) if b in set(plain) else chr(256 + rest.index(b)) for b in range(256)]


class Encoder:
    """Text to little-endian uint32 ids, as bytes."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        self.letters = dict(enumerate(byte_letters()))
        self.kept: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}

    def _whole(self, segment: str) -> bytes:
        ids = self.tokenizer.encode(segment, add_special_tokens=False).ids
        return np.array(ids, "<u4").tobytes()

    def _word(self, word: str) -> bytes:
        found = self.words.get(word)
        if found is None:
            spelt = word.encode().decode("latin-1").translate(self.letters)
            tokens = self.tokenizer.model.tokenize(spelt)
            found = np.array([t.id for t in tokens], "<u4").tobytes()
            if len(self.words) < KEPT_WORDS:
                self.words[word] = found
        return found

    def segment(self, segment: str) -> bytes:
        plain = PLAIN.fullmatch(segment)
        if plain is None:
            out = self._whole(segment)
        elif plain[2]:
            out = self._word(plain[1]) + self._word(plain[2])
        else:
            out = self._word(plain[1])
        if len(self.kept) < KEPT_SEGMENTS:
            self.kept[segment] = out
        return out

    def encode(self, text: str) -> bytes:
        parts = segments(text)
        found = list(map(self.kept.get, parts))
        if None in found:
            one = self.segment
            found = [one(p) if f is None else f for p, f in zip(parts, found, strict=True)]
        return b"".join(found)


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One encoder a worker process and vocabulary file; tasks of the worker share it."""
    return Encoder(path)
