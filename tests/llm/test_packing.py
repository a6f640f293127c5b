import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from quarry.llm import packing
from tests.llm.cases import ROWS, documents, empty, odd

BYTES = str(public_tokenizers.path("byte_bpe_50k.json"))


def wanted(rows, capacity):
    own, out = Tokenizer.from_file(BYTES), []
    for doc_id, text in rows:
        ids = np.array(own.encode(text or "", add_special_tokens=False).ids + [0], dtype="<u4")
        first = len(ids) % capacity or capacity
        cuts = [0, *range(first, len(ids), capacity), len(ids)]
        out += [(doc_id, i, a, b - a, zlib.crc32(ids[a:b].tobytes())) for i, (a, b) in enumerate(zip(cuts, cuts[1:]))]
    return out


def gapless(rows, capacity):
    sequences = defaultdict(list)
    for r in rows:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(sequences)


@pytest.mark.parametrize("capacity", [2048, 100])
def test_every_piece_is_packed(spark, sf, capacity):
    docs = documents(spark, sf)
    want = wanted([(r["doc_id"], r["text"]) for r in docs.collect()], capacity)
    got = packing.pack(docs, BYTES, capacity).collect()
    assert sorted(tuple(r)[:5] for r in got) == sorted(want)
    least = -(-sum(p[3] for p in want) // capacity)
    assert gapless(got, capacity) <= least * 1.01 + 1


def test_odd_rows(spark):
    got = packing.pack(odd(spark), BYTES, 512).collect()
    assert Counter(tuple(r)[:5] for r in got) == Counter(wanted([r[:2] for r in ROWS], 512))
    gapless(got, 512)
    assert packing.pack(empty(spark), BYTES).count() == 0


def test_plan_uses_the_histogram_exactly():
    rng = np.random.default_rng(1)
    for size, most in ((50, 3), (400, 2000), (2048, 500)):
        counts = np.append(0, rng.integers(0, most, size))
        used = np.zeros(size + 1, dtype=np.int64)
        n = 0
        for row, times in packing.plan(counts, size):
            assert sum(row) <= size and times > 0
            n += times
            for v in row:
                used[v] += times
        assert (used == counts).all()
        # No plan has fewer than the tokens fill, nor than the pieces over half a sequence.
        least = max(-(-int((counts * np.arange(size + 1)).sum()) // size), int(counts[size // 2 + 1:].sum()))
        assert n <= least * 1.02 + 1


def test_least_squares_repeats_fit():
    patterns = np.array([[3, 1, 0], [2, 2, 0], [2, 1, 1]])
    counts = np.array([0, 7, 6, 3])
    x = packing.repeat_counts(patterns, counts, rounds=3000)
    error = np.bincount(patterns.ravel(), weights=np.repeat(x, 3), minlength=4) - counts
    grad = np.array([sum(v * error[v] for v in row) for row in patterns])  # errors weigh as lengths
    assert (x >= 0).all() and np.abs(grad[x > 1e-3]).max() < 1e-2 and (grad > -1e-2).all()


def test_patterns_follow_lengths_not_numbers():
    """The pattern list of a histogram stays when its counts are multiplied."""
    rng = np.random.default_rng(5)
    counts = np.append(0, rng.integers(0, 3, 600))
    counts[-1] = 0
    some = packing.enumerate_patterns(counts, 600, 200)
    assert (some == packing.enumerate_patterns(counts * 1_000_000, 600, 200)).all()
    assert (some.sum(axis=1) == 600).all()
    stock = set(np.flatnonzero(counts))
    every = {(x, y, 600 - x - y) for x in stock for y in stock if x >= 200 and x >= y >= 600 - x - y and 600 - x - y in stock}
    assert {tuple(r) for r in some.tolist() if r[2]} == every
