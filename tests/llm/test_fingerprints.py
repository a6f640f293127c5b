import hashlib
import random

import numpy as np
from pyspark.sql import functions as F

from quarry.llm import fingerprints as P
from tests.llm.cases import PROSE, ROWS, documents, empty, odd


def plain_edit(text, after):
    half = len(text) // 2
    return "".join([c for i, c in enumerate(text) if i < len(text) - half] + [c for i, c in enumerate(after) if i < half])


def test_rows_equal_brute_force(spark, sf):
    rows = documents(spark, sf).select("doc_id", "text").orderBy("doc_id").collect()
    got = {r["doc_id"]: r for r in P.document_fingerprints(documents(spark, sf)).collect()}
    assert len(got) == len(rows)
    for i, r in enumerate(rows):
        after, g = rows[(i + 1) % len(rows)]["text"], got[r["doc_id"]]
        changed = plain_edit(r["text"], after)
        assert g["n_chars"] == len(r["text"])
        assert g["edited_sha256"] == hashlib.sha256(changed.encode()).hexdigest()
        prints = [P.fingerprint(t) for t in (r["text"], changed, after)]
        assert g["fingerprint"] == prints[0].tobytes().hex() and g["edited_fingerprint"] == prints[1].tobytes().hex()
        assert g["near_edited"] == P.likeness(prints[0], prints[1]) and g["near_next"] == P.likeness(prints[0], prints[2])
    near = np.array([(g["near_edited"], g["near_next"]) for g in got.values()])
    assert near.min() >= 0 and near.max() <= 1 and (near[:, 0] > near[:, 1]).mean() > 0.95


def test_odd_rows(spark):
    got = P.document_fingerprints(odd(spark)).collect()
    assert len(got) == len(ROWS)
    by = {(r["doc_id"], r["n_chars"]): r for r in got}
    assert (2, 0) in by and (3, 0) in by and by[(2, 0)]["fingerprint"] == "0" * 32
    assert by[(1, 300)]["fingerprint"] == by[(4, 300)]["fingerprint"]
    last = by[(None, 33)]  # nulls stand last; what follows is the first row
    assert last["edited_sha256"] == hashlib.sha256((
        "Lonely text without any id at all"[:17] + (PROSE * 3)[:16]).encode()).hexdigest()
    assert P.document_fingerprints(empty(spark)).count() == 0
    one = P.document_fingerprints(odd(spark, ROWS[:1])).collect()
    assert one[0]["near_next"] == 1.0


def test_block_tables_find_all_within_radius(spark):
    r = random.Random(4)
    prints = set()
    for _ in range(60):
        x = r.getrandbits(128)
        for _ in range(5):
            prints.add(f"{x:032x}")
            x ^= sum(1 << b for b in r.sample(range(128), r.randint(0, 6)))
    prints = sorted(prints)
    index = spark.createDataFrame([(p,) for p in prints] + [(prints[0],), (None,)], "fingerprint string")
    queries = index.where(F.col("fingerprint").isin(prints[::3]))
    for radius, blocks in ((3, 4), (3, 6), (0, 1), (8, 9)):
        want = {(a, b, n) for a in prints[::3] for b in prints
                if (n := bin(int(a, 16) ^ int(b, 16)).count("1")) <= radius}
        got = {tuple(x) for x in P.within_radius(index, queries, radius, blocks).collect()}
        assert got == want
