import hashlib
import random
import sys
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import sentencepiece
from tokenizers import Tokenizer

from quarry.llm import token_align
from tests.llm.cases import ROWS, documents, empty, odd
from tests.llm.test_tokens import ODD

BYTES = str(public_tokenizers.path("byte_bpe_50k.json"))
MODEL = str(public_tokenizers.path("piece_bpe_32k.model"))


def alphabet():
    """The visible character of every byte, as byte-level files write them."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


def wanted(rows):
    """Every row by the rule as stated: ends as sets, links as pairs."""
    left, right, byte = Tokenizer.from_file(BYTES), sentencepiece.SentencePieceProcessor(model_file=MODEL), alphabet()
    left.encode_special_tokens = True
    out, counts = [], Counter()
    for doc_id, text in rows:
        raw = (" " + (text or "")).encode()
        a = left.encode(" " + text, add_special_tokens=False).ids if text else []
        b = right.encode(text) if text else []
        spell_a = [bytes(byte[c] for c in left.id_to_token(i)) for i in a]
        spell_b = [bytes([int(p[3:-1], 16)]) if right.is_byte(i) else p.replace("▁", " ").encode()
                   for i, p in ((i, right.id_to_piece(i)) for i in b)]
        if b"".join(spell_a) != raw or b"".join(spell_b) != raw:
            a, b, spell_a, spell_b = [], [], [], []
        ends = []
        for spell in (spell_a, spell_b):
            at, own = 0, {}
            for k, t in enumerate(spell):
                at += len(t)
                own[at] = k
            ends.append(own)
        both = sorted(set(ends[0]) & set(ends[1]))
        cuts, i, j = [], 0, 0
        for e in both:
            x, y = ends[0][e] + 1, ends[1][e] + 1
            cuts.append(",".join(map(str, a[i:x])) + "|" + ",".join(map(str, b[j:y])))
            i, j = x, y
        links = [(a[ends[0][e]], b[ends[1][e]]) for e in both]
        counts.update(links)
        sha = hashlib.sha256(";".join(cuts).encode()).hexdigest() if a else ""
        out.append((doc_id, len(a), len(b), len(both), links, sha))
    most = defaultdict(int)
    for (_, b), n in counts.items():
        most[b] = max(most[b], n)
    return Counter((d, na, nb, g, len(links), sum(counts[p] == most[p[1]] for p in links),
                    sum(counts[p] for p in links), sha) for d, na, nb, g, links, sha in out)


def test_common_ends_of_random_arrays():
    r = random.Random(4)
    for _ in range(2000):
        size = r.randint(1, 60)
        p, q = r.choice([0.05, 0.5, 0.95]), r.choice([0.05, 0.5, 0.95])
        a = [i for i in range(1, size) if r.random() < p] + [size]
        b = [x for x in a if r.random() < q or x == size] if r.random() < 0.5 else \
            [i for i in range(1, size) if r.random() < q] + [size]
        at_a, at_b = token_align.common_ends(a, b)
        assert [a[i] for i in at_a] == [b[j] for j in at_b] == sorted(set(a) & set(b))
    assert token_align.common_ends([], []) == ([], [])
    long = list(range(1, 5000))  # one end missing far inside: the shift changes by one
    at_a, at_b = token_align.common_ends(long, long[:2000] + long[2001:])
    assert at_b == list(range(4998)) and at_a == [*range(2000), *range(2001, 4999)]


def test_common_ends_take_no_step_for_each_token():
    r = random.Random(5)
    a = np.cumsum([r.randint(1, 4) for _ in range(60_000)])
    b = np.cumsum([r.randint(1, 4) for _ in range(60_000)])
    end = int(max(a[-1], b[-1])) + 1
    a, b = np.append(a, end).astype(np.int64), np.append(b, end).astype(np.int64)
    steps = 0

    def count(frame, event, arg):
        nonlocal steps
        steps += event == "line"
        return count
    sys.settrace(count)
    try:
        at_a, at_b = token_align.common_ends(a.tolist(), b.tolist())
    finally:
        sys.settrace(None)
    assert steps < 100
    assert a[at_a].tolist() == b[at_b].tolist() == sorted(set(a.tolist()) & set(b.tolist()))


def test_alignment_equals_brute_force(spark, sf):
    docs = documents(spark, sf)
    want = wanted([(r["doc_id"], r["text"]) for r in docs.collect()])
    for share in (1e-6, 1e-2):  # nearly all pairs sent ahead; nearly all met by a join
        assert Counter(tuple(r) for r in token_align.align(docs, BYTES, MODEL, share=share).collect()) == want


def test_odd_rows(spark):
    r = random.Random(6)
    odd_texts = ["".join(r.choice([*ODD, "<|endoftext|>", "aaa", " "]) for _ in range(r.randint(0, 14))) for _ in range(300)]
    rows = [(i % 50, t) for i, t in enumerate(odd_texts)] + [(None, None), (1, "a▁b"), (1, "x" * 30_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert Counter(tuple(x) for x in token_align.align(docs, BYTES, MODEL).collect()) == wanted(rows)
    got = Counter(tuple(x) for x in token_align.align(odd(spark), BYTES, MODEL).collect())
    assert got == wanted([x[:2] for x in ROWS])
    assert token_align.align(empty(spark), BYTES, MODEL).count() == 0
