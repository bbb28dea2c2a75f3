"""Tables of a byte-level BPE vocabulary file, and what they say about pairs of tokens."""

from __future__ import annotations

import json
import re
from functools import lru_cache

from .units import PATTERN


def _byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in byte-level vocabularies: printable Latin-1 for itself, the rest from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


class ByteBPE:
    """Tokens, merges and special tokens of a ``tokenizers`` JSON file with a byte-level BPE model.

    ``left``/``right`` are the parts a token was merged from (-1 for single bytes), ``rank`` its
    merge's place. The encoders here rest on three properties that are checked on loading: each merge
    makes its own token, from parts made earlier, and every byte has a token.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, pre = spec["model"], spec["pre_tokenizer"]
        if model["type"] != "BPE" or spec["normalizer"] or pre["type"] != "ByteLevel" or pre["add_prefix_space"] or not pre["use_regex"] or model["dropout"] or model["ignore_merges"]:
            raise ValueError(f"{path}: not a plain byte-level BPE")
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] for t in spec["added_tokens"]):
            raise ValueError(f"{path}: special tokens with options")
        letters, vocab = _byte_letters(), model["vocab"]
        self.special = {t["content"].encode(): t["id"] for t in spec["added_tokens"]}
        size = 1 + max([*vocab.values(), *self.special.values()])
        self.tokens: list[bytes] = [b""] * size
        for word, i in vocab.items():
            self.tokens[i] = bytes(letters[c] for c in word)
        for content, i in self.special.items():
            self.tokens[i] = content
        self.byte_id = [-1] * 256
        self.left, self.right, self.rank = [-1] * size, [-1] * size, [-1] * size
        self.merges: dict[tuple[int, int], int] = {}
        special = set(self.special.values())
        self.plain = [i for i in vocab.values() if i not in special]
        for i in self.plain:
            if len(self.tokens[i]) == 1:
                self.byte_id[self.tokens[i][0]] = i
        for n, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            x, y, z = vocab[a], vocab[b], vocab[a + b]
            if self.rank[z] >= 0 or max(self.rank[x], self.rank[y]) >= n:
                raise ValueError(f"{path}: merge {n} is out of order")
            self.left[z], self.right[z], self.rank[z], self.merges[x, y] = x, y, n, n
        if min(self.byte_id) < 0 or any(self.rank[i] < 0 and len(self.tokens[i]) > 1 for i in self.plain):
            raise ValueError(f"{path}: tokens without merges")
        self._pairs: dict[tuple[int, int], bool] = {}

    def _spine(self, token: int, child: list[int]) -> list[tuple[int, int]]:
        """The tokens at one edge while ``token`` is built, each with the rank of the merge that absorbs it."""
        out, until = [], 1 << 60
        while token >= 0:
            out.append((token, until))
            until, token = self.rank[token], child[token]
        return out

    def fits(self, a: int, b: int) -> bool:
        """Whether ``a`` then ``b`` is how BPE encodes their joined bytes.

        It is not if some merge joins the right edge of ``a`` with the left edge of ``b`` before both
        edges are absorbed. Of equal merges the leftmost comes first.
        """
        known = self._pairs.get((a, b))
        if known is None:
            left = self._spine(b, self.left)
            known = all((n := self.merges.get((x, y))) is None or n >= x_until or n > y_until for x, x_until in self._spine(a, self.right) for y, y_until in left)
            if len(self._pairs) >= 1 << 20:
                self._pairs.clear()
            self._pairs[a, b] = known
        return known


@lru_cache(maxsize=2)
def load(path: str) -> ByteBPE:
    """The tables of a file, kept for the life of the worker."""
    return ByteBPE(path)


def special_pattern(table: ByteBPE) -> re.Pattern[bytes] | None:
    """Finds special tokens, leftmost and of those the longest, as one group; None if there are none."""
    names = sorted(filter(None, table.special), key=len, reverse=True)
    return re.compile(b"(" + b"|".join(map(re.escape, names)) + b")") if names else None


@lru_cache(maxsize=1)
def pre_tokenizer():
    """``findall`` of the pre-tokenizer's pattern."""
    import regex

    return regex.compile(PATTERN).findall


def vocabulary_path(name: str = "byte_bpe_50k.json") -> str:
    """Place of a file of the installed public vocabularies."""
    import public_tokenizers

    return public_tokenizers.path(name)
