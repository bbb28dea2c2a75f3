"""Cuts a text into pieces that byte-level BPE encodes independently of each other.

The pre-tokenizer of byte-level BPE always starts a new piece at a space that a non-white character
follows. Cutting there, and around special tokens, leaves short units whose encodings concatenate to
that of the whole text; the same units recur, so their encodings can be kept.
"""

from __future__ import annotations

import re

import numpy as np

#: The pattern of the byte-level pre-tokenizer.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: A space after which no cut is made: white space or the end of the text follows.
_WHITE = rb"[ \t-\r\x1c-\x1f]|\xc2[\x85\xa0]|\xe1\x9a\x80|\xe1\xa0\x8e|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80|\Z"
_CUT = re.compile(rb" (?!" + _WHITE + rb")")
#: Bytes that can start what _WHITE matches.
_DOUBT = np.zeros(256, bool)
_DOUBT[[32, *range(9, 14), *range(28, 32), 0xC2, 0xE1, 0xE2, 0xE3]] = True


def doubtful(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether each text has a space that perhaps is no place to cut."""
    out = np.zeros(len(at) - 1, bool)
    if len(data):
        hits = np.flatnonzero((data[:-1] == 32) & _DOUBT[data[1:]])
        out[np.searchsorted(at, hits, side="right") - 1] = True
        full = at[1:] > at[:-1]
        out[full] |= data[at[1:][full] - 1] == 32
    return out


def cut(raw: bytes, doubt: bool) -> list[bytes]:
    """The units of one text without special tokens. All but the first begin with a space, which is left out here."""
    return _CUT.split(raw) if doubt else raw.split(b" ")
