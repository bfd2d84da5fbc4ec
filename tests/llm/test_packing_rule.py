"""Packing: the layout rule against a plain version of it; ids under a small memory against the tokenizer."""

import random

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from msgscreen.llm import packing

from .test_exact import passage


def plain_layout(lengths, capacity):
    """{(document, start): (length, sequence load before it)} of whole remainders, placed one by one."""
    rest = sorted(((n % capacity, d) for d, n in enumerate(lengths) if n % capacity), key=lambda r: (-r[0], r[1]))
    room = [capacity] * (sum(n for n, _ in rest) // capacity)
    load, placed = [0.0] * len(room), {}
    for n, d in rest:
        fits = [s for s in range(len(room)) if room[s] >= n]
        if fits:
            s = min(fits, key=lambda s: (load[s], s))
            placed[d, lengths[d] - n] = (n, s, capacity - room[s])
            room[s] -= n
            load[s] += n + n * n / 2048
    return placed, len(room)


def test_layout_rule():
    rng = random.Random(3)
    for _ in range(60):
        capacity = rng.choice([8, 64, 2048])
        lengths = [rng.choice([1, rng.randint(1, capacity), rng.randint(1, 3 * capacity)]) for _ in range(rng.randint(1, 60))]
        pieces = packing.pack(lengths, capacity)
        full = sum(n // capacity for n in lengths)
        placed, room = plain_layout(lengths, capacity)
        got = {(d, start): (length, s - full, offset) for d, start, length, s, offset in pieces if full <= s < full + room}
        assert {k: v for k, v in got.items() if k in placed} == placed
        covered, held = {}, {}
        for d, start, length, s, offset in sorted(pieces, key=lambda p: (p[3], p[4])):
            assert length > 0 and offset == held.get(s, 0)
            held[s] = offset + length
            covered.setdefault(d, []).append((start, length))
        for d, n in enumerate(lengths):
            at = 0
            for start, length in sorted(covered[d]):
                assert start == at
                at += length
            assert at == n
        # All but a tail of powers of two is full: no padding.
        sizes = [held[s] for s in sorted(held)]
        assert all(x == capacity or x & (x - 1) == 0 for x in sizes) and sorted(held) == list(range(len(held)))


def test_ids_under_a_small_memory(monkeypatch):
    path = public_tokenizers.path("byte_bpe_50k.json")
    texts = [passage(i, 60) + f" It's {i} (x2) don't\n\n\tTab  two" for i in range(40)] + ["", " ", "<|endoftext|> a", "ünï 漢字 words", "É" * 30, " a" * 50]
    monkeypatch.setattr(packing, "MEMORY_PIECES", 60)
    monkeypatch.setattr(packing, "JOINED_PIECES", 7)
    tokens, whole = packing.Tokens(path, added_tokens=True), Tokenizer.from_file(path)
    for a in range(0, len(texts), 5):
        for text, ids in zip(texts[a : a + 5], tokens.ids(texts[a : a + 5])):
            assert ids.tolist() == whole.encode(text, add_special_tokens=False).ids
    assert packing.worker_tokens(path, True) is packing.worker_tokens(path, True)
    assert np.array_equal(tokens.ids(texts)[0], tokens.ids(texts)[0])
