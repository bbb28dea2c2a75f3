"""The units that token files keep, against the tokenizers library."""

import random

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from attestor.llm import token_files
from attestor.llm.byte_bpe import vocabulary_path
from attestor.llm.common import utf8

PATH = vocabulary_path()


@pytest.mark.parametrize(("kept", "kept_long", "long"), [(2_000_000, 100_000, 4 << 20), (300, 50, 4 << 20), (2_000_000, 100_000, 20)])
def test_encoder_equals_the_library(monkeypatch, kept, kept_long, long):
    monkeypatch.setattr(token_files, "KEPT", kept)
    monkeypatch.setattr(token_files, "KEPT_LONG", kept_long)
    monkeypatch.setattr(token_files, "LONG", long)
    rng = random.Random(1)
    parts = ["a", "b", "the", "don't", "'s", " ", "  ", "\n", "\t", "é", "日本語", ".", "123", "\x00", "x" * 15, "y" * 16, "z" * 14, "é" * 7 + "q", "é" * 8, " word", "　", " a b c d ", "<|endoftext|>"]
    texts = [None, "", " ", "a", " a", "a ", *("".join(rng.choice(parts) + rng.choice(["", "", " "]) for _ in range(rng.randint(0, 30))) for _ in range(1500))]
    texts += [" ".join(f"w{rng.randint(0, 900)}" for _ in range(40)) for _ in range(300)]
    encoder, got = token_files.LibraryEncoder(PATH, 2), []
    for k in range(0, len(texts), 200):
        got += encoder.encode(*utf8(pa.array(texts[k : k + 200], pa.string())))
    want = Tokenizer.from_file(PATH).encode_batch_fast([t or "" for t in texts], add_special_tokens=False)
    assert got == [np.array(w.ids, "<u2").tobytes() for w in want]


def test_kept_units_take_little_memory():
    encoder = token_files.LibraryEncoder(PATH, 2)
    encoder.encode(*utf8(pa.array(["x " + " ".join(f"u{i}" for i in range(50_000))])))
    short = encoder.short
    assert short.size == 50_000 and not encoder.tails
    arrays = (short.slots, short.low, short.high, short.start, short.length, short.ids)
    assert sum(a.nbytes for a in arrays) < 60 * short.size
