import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quarry.llm import gru, lang_id, lm_score
from quarry.llm.common import words_of
from tests.llm.cases import ROWS, documents, empty, odd


def tokens(text):
    low = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", low) + [None]


def held(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 5 == 1


def base(rows):
    c = Counter()
    for i, t in rows:
        if not held(i):
            c.update(tokens(t))
    n, v = sum(c.values()), len(c)
    return [(i, held(i), len(tokens(t)), sum(c[x] > 0 for x in tokens(t)), n,
             sum(math.log10((c[x] + 0.5) / (n + 0.5 * (v + 1))) for x in tokens(t))) for i, t in rows]


@pytest.mark.parametrize("share", [1e-6, 1e-3])
def test_base_equals_brute_force_and_the_model_beats_it(spark, sf, share, monkeypatch):
    monkeypatch.setattr(lm_score, "SHARE", share)
    docs = documents(spark, sf)
    want = {w[0]: w for w in base([(r["doc_id"], r["text"]) for r in docs.collect()])}
    got = lm_score.score(docs, lang_id.remainder(5) == 1, warm_docs=100).collect()
    assert len(got) == len(want)
    for g in got:
        assert tuple(g)[:5] == want[g["doc_id"]][:5]
        assert g["base_score"] == pytest.approx(want[g["doc_id"]][5], rel=1e-9)
    unseen = [g for g in got if g["held_out"]]
    assert sum(g["score"] for g in unseen) > sum(g["base_score"] for g in unseen)


def test_odd_rows(spark):
    want = Counter((str(w[0]), *w[1:5], round(w[5], 6)) for w in base([r[:2] for r in ROWS]))
    got = lm_score.score(odd(spark), lang_id.remainder(5) == 1, warm_docs=3).collect()
    assert Counter((str(g["doc_id"]), *tuple(g)[1:5], round(g["base_score"], 6)) for g in got) == want
    assert all(math.isfinite(g["score"]) and g["score"] < 0 for g in got)
    assert lm_score.score(empty(spark), lang_id.remainder(5) == 1).count() == 0


def test_probabilities_sum_to_one():
    p = gru.fresh(np.arange(gru.WORDS)[::-1].copy())
    h = np.random.default_rng(1).uniform(-1, 1, (1, gru.HIDDEN)).astype(np.float32)
    ll = gru.log_likelihood(p, np.repeat(h, gru.WORDS, 0), np.arange(gru.WORDS))
    assert np.exp(ll.astype(float)).sum() == pytest.approx(1, abs=1e-3)


def test_state_goes_from_window_to_window():
    rng = np.random.default_rng(2)
    p = gru.fresh(np.ones(gru.WORDS))
    docs = [np.append(rng.integers(1, gru.WORDS, n), gru.END).astype(np.int32) for n in (0, 1, 7, 50, 200, 33)]
    whole = gru.score(p, docs, lanes=8, window=1000)
    assert np.allclose(whole, gru.score(p, docs, lanes=2, window=3), rtol=1e-4)
    assert np.allclose(whole[::-1], gru.score(p, docs[::-1], lanes=3, window=32), rtol=1e-4)


def test_gradients_equal_differences():
    """One window: the step's gradients against finite differences of the loss."""
    rng = np.random.default_rng(3)
    p = {k: v.astype(np.float64) for k, v in gru.fresh(np.ones(gru.WORDS)).items()}
    ids, targets = rng.integers(0, 40, (4, 3)), rng.integers(0, 200, (4, 3))

    def loss(q):
        hs = gru.states(q, ids, np.zeros((3, gru.HIDDEN)))
        return -gru.log_likelihood(q, hs.reshape(-1, gru.HIDDEN).astype(np.float64), targets.ravel()).sum()

    seen = {}
    start = {k: v.copy() for k, v in p.items()}
    stream = np.concatenate([np.concatenate([ids[:, b], targets[-1:, b]]) for b in range(3)])
    targets = np.stack([np.append(ids[1:, b], targets[-1, b]) for b in range(3)], axis=1)
    gru.train(p, stream, batch=3, window=4, rate=1.0)
    for k in gru.NAMES:
        step = (start[k] - p[k]).ravel()  # Adagrad's first step: g / sqrt(1e-3 + g * g), g a mean over the batch
        at = int(np.abs(step).argmax())
        g = step[at] * math.sqrt(1e-3 / max(1e-12, 1 - step[at] ** 2)) * 3
        up, down = {q: v.copy() for q, v in start.items()}, {q: v.copy() for q, v in start.items()}
        up[k].ravel()[at] += 1e-3
        down[k].ravel()[at] -= 1e-3
        seen[k] = (g, (loss(up) - loss(down)) / 2e-3)
    for k, (g, d) in seen.items():
        assert abs(g) > 3 or g == pytest.approx(d, rel=0.05, abs=1e-3), (k, g, d)


def test_every_training_document_teaches(spark):
    rng = np.random.default_rng(7)
    texts = [" ".join(f"w{j}" for j in rng.zipf(1.5, 150) % 200) for _ in range(40)]

    def scores(changed):
        rows = [(i, " ".join(reversed(t.split())) if i == changed else t) for i, t in enumerate(texts)]
        got = lm_score.score(spark.createDataFrame(rows, "doc_id long, text string"), F.lit(False), warm_docs=1).collect()
        return {r["doc_id"]: (r["base_score"], r["score"]) for r in got}

    before = scores(None)
    for changed in (11, 23):  # the same counts in another order: only the recurrent model can tell
        after = scores(changed)
        others = [i for i in before if i != changed]
        assert all(before[i][0] == pytest.approx(after[i][0], rel=1e-12) for i in others)
        assert sum(before[i][1] != after[i][1] for i in others) > 30


ODD_TEXTS = [None, "", " \n\t\r\x0b\x0c ", "  A b C ", "a", "\u00dcn\u00ef \u6f22\u5b57 \U0001f642 \u0130 x", "x\x1cy\x85w\xa0v \x00",
             "rare a a a rare once " * 50 + "B the the"]


def test_words_of_a_batch_equal_words_of_each_text():
    words, n = lm_score.words_in(pa.array(ODD_TEXTS, pa.string()))
    assert n.tolist() == [len(words_of(t)) for t in ODD_TEXTS]
    assert words.cast(pa.binary()).to_pylist() == [w for t in ODD_TEXTS for w in words_of(t)]


def test_counts_merge_and_flush(monkeypatch):
    monkeypatch.setattr(lm_score, "FLUSH", 100)
    batches = [pa.record_batch([pa.array(ODD_TEXTS[i:i + 2], pa.string())], ["text"]) for i in range(0, len(ODD_TEXTS), 2)]
    got = Counter()
    parts = list(lm_score._count(iter(batches * 3)))
    for part in parts:
        for r in part.to_pylist():
            got[r["word"].encode()] += r["n"]
    want = Counter(w for t in ODD_TEXTS for w in words_of(t))
    want[b""] = len(ODD_TEXTS)
    assert got == {w: 3 * n for w, n in want.items()} and len(parts) > 1


def test_a_batch_looks_up_each_word_once():
    asked = []

    class Index(dict):
        def get(self, word, other=None):
            asked.append(word)
            return super().get(word, other)

    counts = np.arange(gru.WORDS + 10, 0, -1.0)
    index = Index({f"w{i}".encode(): i for i in range(len(counts))} | {b"a": 1, b"the": gru.WORDS + 3})
    v = lm_score.Vocabulary(index, np.log10(counts + 0.5), 0.25, True)
    n = len(ODD_TEXTS)
    batch = pa.record_batch([pa.array(range(n)), pa.array(range(n)), pa.array([False] * n), pa.array(range(n)),
                             pa.array(ODD_TEXTS, pa.string())], ["uid", "doc_id", "held_out", "draw", "text"])
    got = lm_score._coded(batch, v)
    assert len(asked) == len(set(asked)) == len({w for t in ODD_TEXTS for w in words_of(t)})
    got.validate(full=True)
    for r, text in zip(got.to_pylist(), ODD_TEXTS, strict=True):
        k = [index.get(w, -1) for w in words_of(text)]
        own = [0 <= i < gru.WORDS - 2 for i in k]
        assert np.frombuffer(r["ids"], np.uint16).tolist() == [i + 2 if o else gru.RARE for i, o in zip(k, own)] + [gru.END]
        assert (r["n_tokens"], r["n_frequent"], r["n_rare"]) == (len(k) + 1, sum(i >= 0 for i in k) + 1, own.count(False))
        assert r["frequent"] == pytest.approx(sum(v.log_counts[i] for i in k if i >= 0) + 0.25, rel=1e-12)
        assert r["rare"] == pytest.approx(sum(v.log_counts[i] for i, o in zip(k, own) if i >= 0 and not o), rel=1e-12)
        tail = Counter(w.decode() for w, i in zip(words_of(text), k) if i < 0)
        assert list(zip(r["tail"], r["tail_n"])) == list(tail.items())


def test_a_step_changes_only_what_it_owns():
    """Training works in place: neither the stream nor earlier weights change, and runs repeat."""
    p = gru.fresh(np.ones(gru.WORDS))
    stream = np.random.default_rng(4).integers(0, 300, 3000).astype(np.int32)
    kept, runs = stream.copy(), []
    for _ in range(2):
        q = {k: w.copy() for k, w in p.items()}
        gru.train(q, stream, batch=16, window=8)
        runs.append(q)
    assert (stream == kept).all()
    assert all((p[k] == w).all() for k, w in gru.fresh(np.ones(gru.WORDS)).items())
    assert all((runs[0][k] == runs[1][k]).all() for k in gru.NAMES) and any((runs[0][k] != p[k]).any() for k in gru.NAMES)
