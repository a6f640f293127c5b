import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from quarry.llm import order_packing as own
from tests.llm.cases import ROWS, documents, empty, odd

BYTES = str(public_tokenizers.path("byte_bpe_50k.json"))


def padding(length, capacity):
    return 0 if length & (length - 1) == 0 else capacity - length


def least_cost(at, penalty, capacity):
    """Over all predecessors of every cut: (tokens, windows)."""
    cost = [(0, 0)]
    for j in range(1, len(at)):
        cost.append(min((cost[i][0] + padding(int(at[j] - at[i]), capacity) + int(penalty[j]), cost[i][1] + 1)
                        for i in range(j) if at[j] - at[i] <= capacity))
    return cost[-1]


@pytest.mark.parametrize("capacity", [32, 100, 1024])
def test_cuts_are_the_cheapest(capacity):
    rng = np.random.default_rng(capacity)
    for _ in range(25):
        docs = []
        for _ in range(rng.integers(1, 9)):
            length = int(rng.integers(1, 3 * capacity if rng.random() < 0.2 else 40))
            inner = np.flatnonzero(rng.random(length - 1) < rng.choice([0, 0.1, 0.5])) + 1
            docs.append((length, inner.astype(np.int64)))
        at, penalty = own.cut_points(docs, stride=32)
        assert (np.diff(at) > 0).all() and np.diff(at).max() <= 32 and at[-1] == sum(n for n, _ in docs)
        cuts = own.best_cuts(at, penalty, capacity)
        toll = dict(zip(at.tolist(), penalty.tolist()))
        lengths = np.diff(cuts, prepend=0)
        assert lengths.max() <= capacity
        got = sum(padding(int(n), capacity) for n in lengths) + sum(toll[c] for c in cuts)
        assert (got, len(cuts)) == least_cost(at, penalty, capacity)


def check(rows, texts, capacity, end=0):
    """Every id of every row in one piece, sequences gapless, in the rows' order."""
    tok, sequences, pieces = Tokenizer.from_file(BYTES), defaultdict(list), Counter()
    for r in rows:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
        pieces[r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]] += 1
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at and length > 0
            at += length
        assert at <= capacity
    for doc_id, text in texts:
        ids = np.array(tok.encode(text or "", add_special_tokens=False).ids + [end], dtype="<u4")
        at = 0
        while at < len(ids):  # repeated rows may be cut in different ways
            found = next(k for k, n in pieces.items() if n and k[0] == doc_id and k[1] == at and k[4] == len(ids)
                         and k[3] == zlib.crc32(ids[at:at + k[2]].tobytes()))
            pieces[found] -= 1
            at += found[2]
    assert not +pieces
    tokens = sum(n for s in sequences.values() for _, n in s)
    return sum(padding(sum(n for _, n in s), capacity) for s in sequences.values()) / tokens


def test_documents_are_packed_with_little_padding(spark, sf):
    docs = documents(spark, sf).coalesce(2)
    texts = [(r["doc_id"], r["text"]) for r in docs.collect()]
    got = own.pack(docs, BYTES, 1024).collect()
    assert check(got, texts, 1024) < 0.02
    by_id = own.pack(docs.repartition(5), BYTES, 1024, order="doc_id").collect()
    check(by_id, texts, 1024)
    places = sorted((r["sequence_id"], r["offset"], r["doc_id"], r["start"]) for r in by_id)
    assert [p[2:] for p in places] == sorted(p[2:] for p in places)


def test_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(own, "STRETCH", 500)
    got = own.pack(odd(spark), BYTES, 512).collect()
    check(got, [r[:2] for r in ROWS], 512)
    assert own.pack(empty(spark), BYTES).count() == 0
    with pytest.raises(ValueError):
        own.pack(odd(spark), BYTES, 16)


def test_sentences():
    enc, tables = own.encoder(BYTES), own.sentence_tables(BYTES)
    text = 'One two. He said "no!" Then 3.14 went?\nNew line\nand U.S. end.'
    ids = np.array(enc.ids(text))
    ends = own.sentence_ends(ids, tables)
    pieces = [enc.own.decode(list(p)) for p in np.split(ids, ends)]
    assert "".join(pieces) == text
    assert pieces[:3] == ["One two.", ' He said "no!"', " Then 3.14 went?"]
    assert not any("3." in p and "14" not in p for p in pieces) and len(pieces) >= 6
