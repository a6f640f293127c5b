import hashlib
import re
from collections import Counter

import corpus_pipeline as C
import __spark_entry__ as E
from quarry.llm import mixing, simhash_dedup
from quarry.llm.queries import QUERIES
from tests.llm.cases import documents, empty, odd
from tests.llm.test_pii import base
from tests.llm.test_packing import gapless
from tests.llm.test_simhash import plain_components, plain_fingerprint


def test_registered():
    names = set(E.queries())
    assert "pipeline" in names and set(QUERIES) <= names
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES if n.startswith("op")) == list(range(1, 14))
    assert [n for n, _ in C.STAGES] == ["language_id", "near_dedup", "personal_data", "mixing", "packing"]


def test_stages_over_documents(spark, sf):
    docs = documents(spark, sf)
    start = {r["doc_id"]: r["text"] for r in docs.collect()}
    kept = C.language_stage(spark, docs, sf)
    assert kept.columns == C.COLUMNS
    texts = {r["doc_id"]: r["text"] for r in kept.collect()}
    assert texts == {k: t for k, t in start.items() if any(c.isalpha() for c in t)}
    single = C.near_dedup_stage(spark, kept, sf)
    ids = sorted(texts)
    roots = plain_components([plain_fingerprint(texts[i]) for i in ids], 2)
    assert sorted(r["doc_id"] for r in single.collect()) == sorted({ids[r] for r in roots})
    clean = C.personal_data_stage(spark, single, sf)
    rows = clean.collect()
    assert len(rows) == single.count() and all(not base(r["text"]) and r["n_chars"] == len(r["text"]) for r in rows)
    assert all(r["text"] == texts[r["doc_id"]] for r in rows if not base(texts[r["doc_id"]]))
    mixed = C.mixing_stage(spark, clean, sf)
    assert mixed.columns == C.COLUMNS
    taken = Counter(r["doc_id"] for r in mixed.collect())
    assert max(taken.values()) <= 2 and set(taken) <= {r["doc_id"] for r in rows}
    packed = C.packing_stage(spark, mixed, sf).collect()
    assert Counter(r["doc_id"] for r in packed if r["piece"] == 0) == taken
    gapless(packed, 2048)


def test_odd_and_empty_tables(spark, sf):
    for start in (odd(spark), empty(spark)):
        docs, n = start, []
        for name, step in C.STAGES:
            docs = step(spark, docs, sf)
            n.append(docs.count())
            if name != "packing":
                assert docs.columns == C.COLUMNS
        assert n[0] == (len([1, 4, 4, None, 5, 7, 8, 9]) if start.count() else 0)
        assert start.count() or not any(n)


def test_whole_run(spark, sf):
    assert C.run(spark, sf).count() > 0


def _moves(df, column, capsys):
    """Exchanges of a plan that carry ``column``."""
    capsys.readouterr()
    df.explain("formatted")
    blocks = capsys.readouterr().out.split("\n\n")
    return sum(bool(re.search(r"^\(\d+\) Exchange", b.strip()) and re.search(rf"\b{column}#", b)) for b in blocks)


def test_texts_move_once(spark, capsys):
    """Near-duplicates and the mix each shuffle the texts one time; repeated
    rows, null ids and null sources keep their results."""
    rows = [(i % 250 if i % 9 else None, hashlib.sha512(str(i % 280).encode()).hexdigest() * 8 + f" w{i % 280} x y", "en",
             [None, "a", "b"][i % 3], 1) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    held = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        kept = simhash_dedup.keep_one(docs)
        assert _moves(kept, "text", capsys) == 1
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "20480")  # over what the three sources take
        mixed = mixing.mix(docs, [5, 2, 1], carry=["text"])
        assert _moves(mixed, "in_text", capsys) == 1
        assert kept.count() == len({r[1] for r in rows}) and mixed.count() == 300
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", held)
