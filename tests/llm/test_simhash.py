import random
import re

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quarry.llm import simhash_dedup as S
from quarry.llm.common import connected_components
from tests.llm.cases import ROWS, documents, empty, odd


def plain_fingerprint(text, size=3):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    if not words:
        return 0
    grams = [" ".join(words[i:i + size]) for i in range(max(1, len(words) - size + 1))]
    hashes = [xxhash.xxh64(g.encode(), seed=42).intdigest() for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints, max_bits):
    """Root index of each fingerprint, by comparing all pairs."""
    a, root = np.array(prints, dtype="u8"), list(range(len(prints)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for i in range(len(a)):
        for j in np.nonzero(np.bitwise_count(a[i] ^ a[i + 1:]) <= max_bits)[0]:
            x, y = find(i), find(i + 1 + int(j))
            root[max(x, y)] = min(x, y)
    return [find(i) for i in range(len(a))]


@given(st.text(max_size=60))
@settings(max_examples=200, deadline=None)
def test_fingerprint_equals_plain(text):
    assert S.fingerprint(text) == plain_fingerprint(text)


@pytest.mark.parametrize("max_bits,segments", [(2, 5), (1, 3), (3, 7), (2, 3)])
@pytest.mark.parametrize("bucket_limit", [0, 64])
def test_links_equal_all_pairs(spark, max_bits, segments, bucket_limit):
    """Chains alone, and dense buckets alone, give the same components."""
    r = random.Random(max_bits)
    prints = set()
    for _ in range(40):
        x = r.getrandbits(64)
        for _ in range(6):
            prints.add(x)
            x ^= sum(1 << b for b in r.sample(range(64), r.randint(0, max_bits + 2)))
    prints = sorted(prints)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    df = spark.createDataFrame([(p,) for p in signed], "fp long")
    edges = S.links(df, max_bits, segments, bucket_limit)
    pairs = {(r["a"], r["b"]) for r in edges.collect()}
    mask = (1 << 64) - 1
    assert all(bin((a ^ b) & mask).count("1") <= max_bits for a, b in pairs)
    roots = {r["node"]: r["root"] for r in connected_components(edges, "a", "b").collect()}
    got, want = {}, {}
    for p, s, w in zip(prints, signed, plain_components(prints, max_bits)):
        got.setdefault(roots.get(s, s), set()).add(p)
        want.setdefault(w, set()).add(p)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def test_components_of_paths_and_stars(spark):
    """Long paths, a star, loops, repeated edges and nulls."""
    r = random.Random(3)
    edges = [(i, i + 1) for i in range(300)] + [(1000, 1000 + i) for i in range(1, 200)] + [(5, 5), (7, 8), (None, 9)]
    r.shuffle(edges)
    found = connected_components(spark.createDataFrame(edges, "a long, b long"), "a", "b")
    got = {x["node"]: x["root"] for x in found.collect()}
    assert got == {i: 0 for i in range(1, 301)} | {1000 + i: 1000 for i in range(1, 200)}


def test_components_of_random_graphs(spark):
    r = random.Random(9)
    edges = [(r.randrange(400), r.randrange(400)) for _ in range(260)]
    root = list(range(400))
    for _ in range(400):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    found = connected_components(spark.createDataFrame(edges, "a long, b long"), "a", "b")
    assert {x["node"]: x["root"] for x in found.collect()} == {i: v for i, v in enumerate(root) if i != v}


def test_whole_table_equals_brute_force(spark, sf):
    docs = documents(spark, sf)
    rows = docs.select("doc_id", "text").collect()
    prints = [plain_fingerprint(r["text"]) for r in rows]
    roots = plain_components(prints, 2)
    first = {}
    for r, root in zip(rows, roots):
        first[root] = min(first.get(root, r["doc_id"]), r["doc_id"])
    want = {(r["doc_id"], f"{p:016x}", first[root]) for r, p, root in zip(rows, prints, roots)}
    got = S.near_duplicates(docs).select("doc_id", S.hex_fingerprint().alias("f"), "component_id").collect()
    assert {tuple(r) for r in got} == want
    kept = S.keep_one(docs)
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(first.values()) and kept.columns == docs.columns


def test_odd_rows(spark):
    got = [tuple(r) for r in S.near_duplicates(odd(spark)).collect()]
    assert len(got) == len(ROWS)
    by = {}
    for doc_id, fp, component in got:
        by.setdefault(doc_id, set()).add((fp, component))
    assert by[2] == by[3] == by[6] == {(0, 2)}
    assert {c for _, c in by[1] | by[4]} == {1} and {c for _, c in by[8] | by[9]} == {8}
    assert {c for _, c in by[None]} == {None}
    kept = S.keep_one(odd(spark).select("doc_id", "text", "lang", "source", "n_chars")).collect()
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in kept) == [
        (False, 1), (False, 2), (False, 5), (False, 7), (False, 8), (True, 0)]
    assert S.near_duplicates(empty(spark)).count() == 0 and S.keep_one(empty(spark)).count() == 0
    many = spark.range(300).select(F.lit(5).cast("long").alias("doc_id"), F.lit("same text here").alias("text"))
    assert S.keep_one(many).count() == 1
