"""Near-duplicate detection (J1, J2, J3, J4) with exact scores.

Duplicate rule (per ordered pair new -> existing)::

    title >= t  OR  statement >= t  OR  0.4*title + 0.5*statement + 0.1*tags >= t

Plan, all lossless:

1. **Distinct first.** Records are normalised once; exact copies share a
   signature (sha-256 of the normalised content). Identical records never
   become pairs: groups are reduced with ``min`` aggregations.
2. **Candidate pairs of distinct strings** (``similar_pairs``) by prefix
   filtering on character-multiset tokens ``(char, k-th occurrence)``:
   Ratcliff-Obershelp matches are a sub-multiset of the common characters,
   so ``ratio >= m`` forces a bag overlap of at least ``m/(2-m)*len`` and
   hence a shared token among each string's first ``len - overlap + 1``
   tokens of any common order (AllPairs prefix principle). Over short strings
   of few words most pairs share such a token whatever the key is, so pairs are
   judged inside the join: each row carries a *profile* of its string, bitmaps
   and bucket counts of its characters and bigrams, whose overlap bounds the
   common ones from above in a few instructions. A token that too many strings
   share is dealt over a grid of keys. Where the existing side is small, every
   task holds it and bounds its strings against all of it: nothing is
   exploded or joined.
3. **Exact scores** in Arrow batches on surviving distinct pairs only.
4. **Branches instead of record pairs.** A title pair at ``>= t`` makes
   every record pair of those titles a duplicate, so the title branch is
   answered per *title* (earliest record per title, ``min`` over similar
   titles); the same for statements. Only the weighted branch
   (``title >= 0.8125`` and ``statement >= 0.82`` at ``t = 0.85``, floors
   derived from the weights) needs signature pairs.
"""

from __future__ import annotations

import functools
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from quarry.functions.similarity import (EPS, THRESHOLD, W_STATEMENT, W_TAGS, W_TITLE,
                                         branch_floors, length_floor, ratio_at_least, ratio_udf)
from quarry.functions.text import normalize_tags, normalize_text
from quarry.operators.components import components
from quarry.session import ensure_checkpoint_dir, scratch_dir


_ROW = "_row"  # a candidate row's own number: ids may repeat
_CONTENT = "_content"  # a candidate row's title, statement and tags as they came, hashed


def _h(c):
    return F.unhex(F.sha2(c, 256))


def _normalised(df: DataFrame, id="id", seq="seq", title="title", statement="statement",
                tags="tags") -> DataFrame:
    return df.select(F.col(id).alias("id"), F.col(seq).alias("seq"),
                     normalize_text(F.col(title)).alias("nt"), normalize_text(F.col(statement)).alias("ns"),
                     normalize_tags(F.col(tags)).alias("tg"), *[c for c in ("_grp", _ROW, _CONTENT) if c in df.columns])


def _keyed(f: DataFrame) -> DataFrame:
    f = f.withColumns({"kt": _h(F.col("nt")), "ks": _h(F.col("ns"))})
    return f.withColumn("sig", _h(F.to_json(F.struct("kt", "ks", "tg"))))


def features(df: DataFrame, **cols) -> DataFrame:
    """Normalised content plus keys: ``kt`` title, ``ks`` statement, ``sig`` all."""
    return _keyed(_normalised(df, **cols))


# ------------------------------------------------------------ known keys

#: So many keys (32 bytes each) go to every task; more are joined.
KEYS = 100_000


def _known(keys: DataFrame) -> DataFrame:
    """Distinct keys, found once."""
    keys = keys.distinct().checkpoint()
    return F.broadcast(keys) if keys.count() <= KEYS else keys


def _among(df: DataFrame, keys: DataFrame, on: str) -> DataFrame:
    return df.join(keys, on, "left_semi")


def _lacking(df: DataFrame, keys: DataFrame, on: str) -> DataFrame:
    return df.join(keys, on, "left_anti")


# ------------------------------------------------------------ candidate pairs

#: Characters and bigrams are counted in so many buckets of a profile.
CHARS, BIGRAMS = 37, 61
#: Tokens of a string (an n-gram and its k-th occurrence) stand for one bit each of so many words of a bitmap.
MAP_WORDS = 4
#: Strings up to this length are bounded by bitmaps alone.
SHORT = 64
#: Counts are two bytes wide; longer strings are not bounded by their profiles.
WIDEST = 32767
#: A token that would join more pairs than this meets in a grid of keys, each
#: side copied once a column or row, at most so many times.
CELL, GRID = 4_000_000, 16
#: Buckets of the token order: characters, and doublings of the occurrence.
ORDER, DOUBLINGS = 1024, 32


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.int64)


def _bitmap(grams: np.ndarray) -> tuple[list[int], int]:
    """Bits of the tokens ``(gram, k-th occurrence)``, and how many tokens
    found their bit taken."""
    ordered = np.sort(grams)
    first = np.flatnonzero(np.diff(ordered, prepend=-1))
    occ = np.arange(len(ordered)) - np.repeat(first, np.diff(first, append=len(ordered)))
    hashed = (ordered.astype(np.uint64) * np.uint64(1 << 16) + occ.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
    bits = np.zeros(64 * MAP_WORDS, dtype=bool)
    bits[(hashed >> np.uint64(40)) % np.uint64(64 * MAP_WORDS)] = True
    return np.packbits(bits).view("<i8").tolist(), len(grams) - int(bits.sum())


_PROFILE = ("k binary, n int, cm array<bigint>, cr int, gm array<bigint>, gr int, h array<smallint>, "
            "g array<smallint>")
_COLUMNS = [c.split()[0] for c in _PROFILE.split(", ")]


def _profiles(strings: DataFrame) -> DataFrame:
    """Per distinct string ``k, n``, bitmaps of its characters (``cm``, those
    without a bit of their own: ``cr``) and bigrams (``gm, gr``), their counts
    folded into buckets (``h, g``), and its ``bag``: every character with its
    number. Texts stay behind."""
    def profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column("s").to_pylist():
                x = _points(text)
                pairs = x[:-1] * (1 << 21) + x[1:]
                chars, n = np.unique(x, return_counts=True)
                rows.append((len(x), *_bitmap(x), *_bitmap(pairs),
                             np.minimum(np.bincount(x % CHARS, minlength=CHARS), WIDEST).tolist(),
                             np.minimum(np.bincount(pairs % BIGRAMS, minlength=BIGRAMS), WIDEST).tolist(),
                             ((chars << 32) + n).tolist()))
            words, short = pa.list_(pa.int64()), pa.list_(pa.int16())
            kinds = [pa.int32(), words, pa.int32(), words, pa.int32(), short, short, words]
            yield pa.RecordBatch.from_arrays(
                [batch.column("k"), *[pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)]], [*_COLUMNS, "bag"])

    return strings.select("k", "s").mapInArrow(profile, _PROFILE + ", bag array<bigint>")


def _common_bits(what: str) -> Column:
    """At most so many tokens are common: those whose bits meet, and of the
    tokens without a bit of their own the smaller number."""
    a, b = F.col(f"{what}ma"), F.col(f"{what}mb")
    return functools.reduce(lambda x, y: x + y, [F.bit_count(a[i].bitwiseAND(b[i])) for i in range(MAP_WORDS)],
                            F.least(f"{what}ra", f"{what}rb"))


def _common_counts(what: str) -> Column:
    """At most so many n-grams are common: the smaller count of each bucket."""
    return F.aggregate(F.zip_with(f"{what}a", f"{what}b", lambda x, y: F.least(x, y).cast("int")), F.lit(0), lambda x, y: x + y)


def _within_bounds(m: float) -> Column:
    """Whether a pair of profiles (columns ending in ``a`` and ``b``) can reach
    ``m``: lengths, then common characters, then common bigrams.

    Matched characters form M = m/2 * total pairs in blocks. Between two blocks
    lies at least one unmatched character, so there are at most total - 2M + 1
    blocks, and M less the blocks, or more, adjacent pairs are common bigrams.
    """
    na, nb = F.col("na"), F.col("nb")
    total, longest = na + nb, F.greatest("na", "nb")
    chars = total * F.lit(m / 2) - F.lit(EPS)
    grams = total * F.lit(max(0.0, 1.5 * m - 1)) - F.lit(1 + EPS)
    counts = (longest <= SHORT) | (longest > WIDEST)  # bits suffice; counts are cut
    return ((F.least("na", "nb") >= longest * F.lit(length_floor(m)) - F.lit(EPS))
            & (_common_bits("c") >= chars) & (_common_bits("g") >= grams)
            & (counts | ((_common_counts("h") >= chars) & (_common_counts("g") >= grams))))


def _token_weights(profiles: DataFrame) -> np.ndarray:
    """About how many strings hold a token of each bucket; a fixed number of
    sums, whatever the characters and lengths."""
    found = (profiles.select(F.explode("bag").alias("x"))
             .select(F.shiftright("x", 32).alias("char"), F.col("x").bitwiseAND((1 << 32) - 1).alias("c"))
             .select("char", F.explode(F.sequence(F.lit(0), F.floor(F.log2("c")).cast("int"))).alias("d"))
             .groupBy((F.pmod("char", F.lit(ORDER)) * DOUBLINGS + F.col("d")).cast("int").alias("bucket"))
             .agg(F.count(F.lit(1)).alias("n")).collect())
    out = np.zeros(ORDER * DOUBLINGS)
    for r in found:
        out[r["bucket"]] = r["n"]
    return out


def _prefixes(profiles: DataFrame, weights: np.ndarray, lf: float, side: str) -> DataFrame:
    """One row for each of a string's first tokens ``(char, k-th occurrence)``
    in the common order: those that join least come first. ``weights`` says
    about how many pairs a token joins; frequent ones are dealt over a grid."""
    grid = np.clip(np.ceil(np.sqrt(weights / CELL)), 1, GRID).astype(np.int64)
    shared = profiles.sparkSession.sparkContext.broadcast((weights, grid))

    def dealt(token: np.ndarray, size: np.ndarray, own: int) -> np.ndarray:
        """Keys of the tokens: a row of the grid for ``a``, a column for ``b``."""
        copy = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        token, size = np.repeat(token, size), np.repeat(size, size)
        cell = own % size * size + copy if side == "a" else copy * size + own % size
        return token * (GRID * GRID) + cell

    def prefix(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, g = shared.value
        for batch in batches:
            out = []
            for k, n, bag in zip(*(batch.column(c).to_pylist() for c in ("k", "n", "bag"))):
                x = np.array(bag, dtype=np.int64)
                chars, counts = x >> 32, x & 0xFFFFFFFF
                char = np.repeat(chars, counts)
                occ = np.arange(1, n + 1) - np.repeat(np.cumsum(counts) - counts, counts)
                token = (char << 32) + occ
                at = (char % ORDER) * DOUBLINGS + np.log2(occ).astype(np.int64)
                keep = n - int(np.ceil(n * lf - EPS)) + 1
                first = np.lexsort((token, w[at]))[:keep]
                out.append(dealt(token[first], g[at[first]], zlib.crc32(k)).tolist() if n else [])
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in _COLUMNS], pa.array(out, pa.list_(pa.int64()))],
                                             [*_COLUMNS, "tokens"])

    rows = profiles.mapInArrow(prefix, _PROFILE + ", tokens array<bigint>")
    return rows.select(*[F.col(c).alias(c + side) for c in _COLUMNS], F.explode("tokens").alias("token"))


def _floor(m: float) -> float:
    if m <= EPS:
        raise ValueError("pairs that share no character would be missed: the threshold is too low")
    return length_floor(m)


def _extent(df: DataFrame, text: str) -> Row:
    """``n`` strings, copies counted, of ``chars`` in all, the shortest and longest."""
    size = F.length(text)
    return df.agg(F.count(size).alias("n"), F.sum(size).alias("chars"), F.min(size).alias("shortest"),
                  F.max(size).alias("longest")).first()


def _reaches(text: str, other: Row, m: float) -> Column:
    """Whether a string's length lets it reach ``m`` with any of the others: a
    string can only pair with lengths in [lf*n, n/lf]."""
    lf, size = _floor(m), F.length(text)
    if not other["n"]:
        return F.lit(False)
    return (size == 0) | ((size >= F.lit(other["shortest"] * lf - EPS)) & (size <= F.lit(other["longest"] / lf + EPS)))


_PAIRS = "ka binary, kb binary, ratio double"

#: Up to so many existing strings and characters of them are held by every task.
FEW, FEW_CHARS = 5_000, 4_000_000
#: Buckets of bigrams there.
FINE = 509


def _pairs_with_few(left: DataFrame, few: list[tuple[bytes, str]], m: float) -> DataFrame:
    """``similar_pairs`` of distinct strings with ``few``: each meets those of a
    fitting length, by the bounds of ``_within_bounds`` over exact counts."""
    lf = _floor(m)
    shared = left.sparkSession.sparkContext.broadcast(sorted(few, key=lambda x: len(x[1])))

    def counts(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return np.bincount(x % CHARS, minlength=CHARS), np.bincount((x[:-1] * (1 << 21) + x[1:]) % FINE, minlength=FINE)

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        old = shared.value
        sizes = np.array([len(s) for _, s in old], dtype=np.int64)
        chars, grams = (np.array(x, dtype=np.int32).reshape(len(old), -1)
                        for x in zip(*(counts(_points(s)) for _, s in old)))
        for batch in batches:
            out = []
            for k, s in zip(batch.column("k").to_pylist(), batch.column("s").to_pylist()):
                n = len(s)
                begin, end = np.searchsorted(sizes, n * lf - 1), np.searchsorted(sizes, n / lf + 1, "right")
                if begin == end:
                    continue
                own, own_grams = counts(_points(s))
                total = n + sizes[begin:end]
                near = begin + np.flatnonzero(np.minimum(chars[begin:end], own).sum(1) >= total * (m / 2) - EPS)
                if len(near):
                    needed = (n + sizes[near]) * max(0.0, 1.5 * m - 1) - (1 + EPS)
                    near = near[np.minimum(grams[near], own_grams).sum(1) >= needed]
                for i in near.tolist():
                    r = ratio_at_least(s, old[i][1], m)
                    if r is not None:
                        out.append((k, old[i][0], r))
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], kind) for i, kind in enumerate(
                (pa.binary(), pa.binary(), pa.float64()))], ["ka", "kb", "ratio"])

    return spread(left.select("k", "s"), 1).mapInArrow(match, _PAIRS)


def similar_pairs(left: DataFrame, right: DataFrame | None, m: float) -> DataFrame:
    """All ``(ka, kb, ratio)`` with ``ratio(left s as new, right s as existing) >= m``.

    ``left``/``right`` hold strings ``(k, s)``, of which copies count once;
    ``right=None`` means the same set (pairs of a string with itself included,
    ratio 1.0).
    """
    same = right is None
    lf = _floor(m)
    if same:
        left = right = left.dropDuplicates(["k"])
    else:
        # Only strings that can reach the other side's lengths are dealt out.
        others = _extent(right, "s")
        left = left.where(_reaches("s", others, m)).dropDuplicates(["k"])
        if not others["n"]:
            return left.sparkSession.createDataFrame([], _PAIRS)
        if others["n"] <= FEW and others["chars"] <= FEW_CHARS:
            few = {bytes(r["k"]): r["s"] for r in right.where("s IS NOT NULL").select("k", "s").collect()}
            return _pairs_with_few(left, list(few.items()), m)
        right = right.where(_reaches("s", _extent(left, "s"), m)).dropDuplicates(["k"])
    lp = _profiles(spread(left, 1)).checkpoint()
    rp = lp if same else _profiles(spread(right, 1)).checkpoint()
    # Any fixed order of the tokens keeps the prefix principle. Those of one
    # side only have no weight: they fill prefixes but never pair.
    lw = _token_weights(lp)
    weights = lw * (lw if same else _token_weights(rp))
    joined = _prefixes(lp, weights, lf, "a").join(_prefixes(rp, weights, lf, "b"), "token")
    if same:
        # every bound below is symmetric: build each unordered pair once
        joined = joined.where(F.col("ka") < F.col("kb"))
    # The bounds hold inside the join: of the pairs that share a token only
    # those go on that can reach m.
    cand = joined.where(_within_bounds(m)).select("ka", "kb").distinct()
    if same:
        # both directions (the ratio is asymmetric) and each string with
        # itself (scored too: autojunk can keep ratio(x, x) below 1.0)
        cand = (cand.unionByName(cand.select(F.col("kb").alias("ka"), F.col("ka").alias("kb")))
                .unionByName(left.where(F.length("s") > 0).select(F.col("k").alias("ka"), F.col("k").alias("kb"))))
    ls = left.select(F.col("k").alias("ka"), F.col("s").alias("sa"))
    rs = right.select(F.col("k").alias("kb"), F.col("s").alias("sb"))
    scored = _scored(cand.join(ls, "ka").join(rs, "kb"), m)
    # empty strings have no tokens: '' vs '' scores 1.0
    e = (left.where(F.length("s") == 0).select(F.col("k").alias("ka")).distinct()
         .join(right.where(F.length("s") == 0).select(F.col("k").alias("kb")).distinct(),
               F.col("ka") == F.col("kb"))
         .select("ka", "kb", F.lit(1.0).alias("ratio")))
    return scored.unionByName(e)


def _scored(pairs: DataFrame, m: float) -> DataFrame:
    """``ka, kb, ratio`` of the pairs of texts ``sa, sb`` that reach ``m``.

    Not a UDF with a filter: the optimizer would push that filter, and the UDF
    with it, below the exchange that spreads the pairs.
    """
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            r = pa.array([ratio_at_least(x, y, m) for x, y in zip(batch.column("sa").to_pylist(),
                                                                  batch.column("sb").to_pylist())], pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column("ka"), batch.column("kb"), r],
                                             ["ka", "kb", "ratio"]).filter(r.is_valid())

    return spread(pairs.select("ka", "kb", "sa", "sb")).mapInArrow(score, _PAIRS)


def spread(df: DataFrame, factor: int = 2) -> DataFrame:
    """Round-robin rows over enough partitions for a Python UDF stage: AQE
    sizes partitions by bytes, but UDF cost is per row."""
    spark = df.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism) * factor
    return df.repartition(n)


def _strings(f: DataFrame, key: str, text: str) -> DataFrame:
    return f.select(F.col(key).alias("k"), F.col(text).alias("s"))


def jaccard_sets(a, b):
    """A2 on already-normalised tag sets."""
    na, nb = F.size(a), F.size(b)
    r = F.size(F.array_intersect(a, b)).cast("double") / F.size(F.array_union(a, b))
    return F.when((na == 0) & (nb == 0), F.lit(1.0)).when((na == 0) | (nb == 0), F.lit(0.0)).otherwise(r)


def _weighted(t, s, g):
    return t * W_TITLE + s * W_STATEMENT + g * W_TAGS


class _Branches:
    """Shared candidate tables for one (new, existing) comparison.

    ``TP``: distinct title pairs with ``title >= t`` (title branch). ``SP``:
    distinct statement pairs with ``statement >= t`` (statement branch).
    The weighted branch is only reachable for *different* titles with
    ``low_t <= title < t`` and statements ``>= low_s``; its title pairs are
    searched only among records whose statement lengths can reach ``low_s``
    against the other side, and its statement pairs come from those title
    pairs (no all-pairs pass over statements at the lower floor).
    """

    def __init__(self, new_f: DataFrame, ex_f: DataFrame | None, t: float):
        self.t = t
        self.low_t, self.low_s = branch_floors(t)
        self.same = ex_f is None
        self.new_f, self.ex_f = new_f, (new_f if self.same else ex_f)
        self.TP = similar_pairs(_strings(new_f, "kt", "nt"),
                                None if self.same else _strings(self.ex_f, "kt", "nt"), t)
        self.SP = similar_pairs(_strings(new_f, "ks", "ns"),
                                None if self.same else _strings(self.ex_f, "ks", "ns"), t)

    @classmethod
    def for_weighted(cls, t: float) -> _Branches:
        """Only the weighted branch, new against existing."""
        br = cls.__new__(cls)
        br.t, br.same = t, False
        br.low_t, br.low_s = branch_floors(t)
        return br

    def _gray_titles(self, new_sig: DataFrame, ex_sig: DataFrame) -> DataFrame:
        tp = similar_pairs(_strings(new_sig, "kt", "nt"), None if self.same else _strings(ex_sig, "kt", "nt"), self.low_t)
        return tp.where(F.col("ratio") < self.t).select(F.col("ka").alias("kta"), F.col("kb").alias("ktb"),
                                                        F.col("ratio").alias("T"))

    def weighted_pairs(self, new_sig: DataFrame, ex_sig: DataFrame) -> DataFrame:
        """Signature pairs duplicated through the weighted score alone.

        ``new_sig``/``ex_sig`` carry ``sig, kt, ks, nt, ns, tg`` (plus ``m``
        on the existing side when present); copies count once."""
        t, low_s = self.t, self.low_s
        if not self.same:
            new_sig = new_sig.where(_reaches("ns", _extent(ex_sig, "ns"), low_s))
            ex_sig = ex_sig.where(_reaches("ns", _extent(new_sig, "ns"), low_s))
        gray = self._gray_titles(new_sig, ex_sig).checkpoint()
        new_sig = _among(new_sig, _known(gray.select(F.col("kta").alias("kt"))), "kt")
        ex_sig = _among(ex_sig, _known(gray.select(F.col("ktb").alias("kt"))), "kt")
        lf = length_floor(low_s)

        def keys(sig: DataFrame, side: str) -> DataFrame:
            return sig.select(F.col("kt").alias(f"kt{side}"), F.col("ks").alias(f"k{side}"),
                              F.length("ns").alias(f"n{side}")).distinct()

        def strings(sig: DataFrame, side: str) -> DataFrame:
            return sig.select(F.col("ks").alias(f"k{side}"), F.col("ns").alias(f"s{side}")).dropDuplicates([f"k{side}"])

        # Statement pairs from keys and profiles alone; texts come last.
        def profiles(sig: DataFrame, side: str) -> DataFrame:
            p = _profiles(spread(sig.select(F.col("ks").alias("k"), F.col("ns").alias("s")).dropDuplicates(["k"]), 1))
            return p.select(*[F.col(c).alias(c + side) for c in _COLUMNS])
        need = (gray.join(keys(new_sig, "a"), "kta").join(keys(ex_sig, "b"), "ktb")
                .where(F.least("na", "nb") >= F.greatest("na", "nb") * F.lit(lf) - F.lit(EPS))
                .select("ka", "kb").distinct()
                .join(profiles(new_sig, "a"), "ka").join(profiles(ex_sig, "b"), "kb").where(_within_bounds(low_s)))
        scored = _scored(need.select("ka", "kb").join(strings(new_sig, "a"), "ka").join(strings(ex_sig, "b"), "kb"),
                         low_s).withColumnRenamed("ratio", "S")
        a = new_sig.select(F.col("sig").alias("sa"), F.col("kt").alias("kta"), F.col("ks").alias("ka"),
                           F.col("tg").alias("tga")).dropDuplicates(["sa"])
        b = ex_sig.select(F.col("sig").alias("sb"), F.col("kt").alias("ktb"), F.col("ks").alias("kb"),
                          F.col("tg").alias("tgb"), *[c for c in ex_sig.columns if c == "m"]).dropDuplicates(["sb"])
        j = scored.join(a, "ka").join(b, "kb").join(gray, ["kta", "ktb"])
        g = jaccard_sets(F.col("tga"), F.col("tgb"))
        return j.withColumn("G", g).where(_weighted(F.col("T"), F.col("S"), F.col("G")) >= t)


def _earliest(f: DataFrame, key: str) -> DataFrame:
    return f.groupBy(key).agg(F.min(F.struct("seq", "id")).alias("m"))


def _statement_and_weighted(nf: DataFrame, ef: DataFrame, t: float) -> DataFrame:
    """(sig, ks, m): earliest match of each content of ``nf`` in ``ef`` by the
    statement branch and by the weighted one."""
    SP = similar_pairs(_strings(nf, "ks", "ns"), _strings(ef, "ks", "ns"), t)
    bs = (SP.join(_earliest(ef, "ks").withColumnRenamed("ks", "kb"), "kb")
          .groupBy("ka").agg(F.min("m").alias("m")).withColumnRenamed("ka", "ks"))
    new_sig = nf.dropDuplicates(["sig"]).select("sig", "kt", "ks", "nt", "ns", "tg")
    ex_sig = ef.groupBy("sig").agg(F.min(F.struct("seq", "id")).alias("m"), F.first("kt").alias("kt"),
                                   F.first("ks").alias("ks"), F.first("nt").alias("nt"),
                                   F.first("ns").alias("ns"), F.first("tg").alias("tg"))
    bw = _Branches.for_weighted(t).weighted_pairs(new_sig, ex_sig).select(F.col("sa").alias("sig"), "m")
    return (new_sig.select("sig", "ks").join(bs, "ks").select("sig", "ks", "m")
            .unionByName(bw.join(new_sig.select("sig", "ks"), "sig").select("sig", "ks", "m")))


def first_duplicate(new: DataFrame, existing: DataFrame | None = None, t: float = THRESHOLD,
                    **cols) -> DataFrame:
    """Per new record, the first duplicate in store order with its scores.

    ``existing=None`` compares each record with the *earlier* records of the
    same frame (by ``seq``). Output: ``id, dup_id, dup_seq, title_similarity,
    statement_similarity, tag_similarity, weighted_similarity`` for records
    that have a duplicate.
    """
    ensure_checkpoint_dir(new.sparkSession)
    # normalised once; every branch reads the checkpoint instead of re-running
    # the scan and the regexes (and a lost executor does not replay them)
    nf = features(new, **cols).checkpoint()
    ef = nf if existing is None else features(existing, **cols).checkpoint()
    TP = similar_pairs(_strings(nf, "kt", "nt"), None if existing is None else _strings(ef, "kt", "nt"), t)
    bt = (TP.join(_earliest(ef, "kt").withColumnRenamed("kt", "kb"), "kb")
          .groupBy("ka").agg(F.min("m").alias("mt")).withColumnRenamed("ka", "kt")).checkpoint()
    # A record whose title has a match only asks statements for earlier ones:
    # no later than the latest of all such matches. Others ask all.
    titled = nf.join(bt, "kt", "left_semi").checkpoint()
    if existing is None:  # each title matches itself: a match counts if it is earlier
        titled = (nf.join(bt, "kt").where(F.col("mt") < F.struct("seq", "id")).drop("mt")).checkpoint()
    open_ = nf.join(titled.select("seq", "id"), ["seq", "id"], "left_anti").checkpoint()
    last = bt.join(titled.select("kt").distinct(), "kt", "left_semi").agg(F.max("mt").alias("m")).first()["m"]
    found = []
    for rows, old in ((titled, None if last is None else ef.where(
            F.struct("seq", "id") < F.struct(*[F.lit(v).cast(ef.schema[c].dataType)
                                               for c, v in (("seq", last["seq"]), ("id", last["id"]))]))), (open_, ef)):
        if old is not None:
            found.append(_statement_and_weighted(rows, old, t))
    later = found[0] if len(found) == 1 else found[0].unionByName(found[1])
    later = later.groupBy("sig", "ks").agg(F.min("m").alias("ms")).checkpoint()
    j = nf.join(bt, "kt", "left").join(later.select("sig", "ms"), "sig", "left")
    first = F.least("mt", "ms")
    j = j.withColumn("first", first).where(F.col("first").isNotNull())
    if existing is None:
        j = j.where(F.col("first") < F.struct("seq", "id"))
    e = ef.select(F.col("id").alias("dup_id"), F.col("seq").alias("dup_seq"), F.col("kt").alias("kt_b"),
                  F.col("ks").alias("ks_b"), F.col("tg").alias("tg_b"))
    # ids may repeat: a record is its id and place
    e = e.dropDuplicates(["dup_id", "dup_seq"])
    out = (j.select("id", "kt", "ks", "tg", F.col("first.id").alias("dup_id"), F.col("first.seq").alias("dup_seq"))
           .join(e, ["dup_id", "dup_seq"])).checkpoint()
    for name, key, text in (("title_similarity", "kt", "nt"), ("statement_similarity", "ks", "ns")):
        # each pair of distinct strings is scored once
        a_text = nf.select(key, F.col(text).alias("_a")).dropDuplicates([key])
        b_text = ef.select(F.col(key).alias(f"{key}_b"), F.col(text).alias("_b")).dropDuplicates([f"{key}_b"])
        pairs = spread(out.select(key, f"{key}_b").distinct().join(a_text, key).join(b_text, f"{key}_b"))
        out = out.join(pairs.select(key, f"{key}_b", ratio_udf("_a", "_b").alias(name)), [key, f"{key}_b"])
    out = out.withColumn("tag_similarity", jaccard_sets(F.col("tg"), F.col("tg_b")))
    return out.select("id", "dup_id", "dup_seq", "title_similarity", "statement_similarity", "tag_similarity",
                      _weighted(F.col("title_similarity"), F.col("statement_similarity"),
                                F.col("tag_similarity")).alias("weighted_similarity"))


def _sides(f: DataFrame, key: str, who: str) -> DataFrame:
    """Per distinct string: its earliest record and how many records have it."""
    return f.groupBy(F.col(key).alias(f"k_{who}")).agg(
        F.min(F.struct("seq", "id"))["id"].alias(f"{who}_id"), F.count(F.lit(1)).alias(f"n_{who}"))


def near_dup_pairs(new: DataFrame, existing: DataFrame, t: float = THRESHOLD, **cols) -> DataFrame:
    """Duplicate pairs, new against existing, as pairs of distinct strings.

    One row for each pair of titles at or above ``t`` (``branch`` title): it
    stands for all its records, whose numbers it gives. Then the statement
    pairs at or above ``t`` that have records under titles not already paired,
    and the pairs of distinct contents that only the weighted score makes
    duplicates. Rows grow with distinct strings, never with copies; scores
    that a row's branch does not decide are null.
    """
    ensure_checkpoint_dir(new.sparkSession)
    nf, ef = features(new, **cols).checkpoint(), features(existing, **cols).checkpoint()
    br = _Branches(nf, ef, t)
    tp, sp = br.TP.checkpoint(), br.SP.checkpoint()
    out_cols = ["branch", "new_id", "existing_id", "n_new", "n_existing", "title_similarity",
                "statement_similarity", "tag_similarity", "weighted_similarity"]

    def rows(pairs: DataFrame, key: str, branch: str, **scores) -> DataFrame:
        j = (pairs.join(_sides(nf, key, "new"), F.col("a") == F.col("k_new"))
             .join(_sides(ef, key, "existing"), F.col("b") == F.col("k_existing")))
        values = {c: scores.get(c, F.lit(None).cast("double")) for c in out_cols[-4:]}
        return j.withColumns({"branch": F.lit(branch), **values}).select(*out_cols)

    titles = tp.select(F.col("ka").alias("a"), F.col("kb").alias("b"), "ratio")
    under_a = nf.select(F.col("ks").alias("a"), F.col("kt").alias("kta")).distinct()
    under_b = ef.select(F.col("ks").alias("b"), F.col("kt").alias("ktb")).distinct()
    statements = sp.select(F.col("ka").alias("a"), F.col("kb").alias("b"), "ratio")
    uncovered = (statements.join(under_a, "a").join(under_b, "b")
                 .join(tp.select(F.col("ka").alias("kta"), F.col("kb").alias("ktb")), ["kta", "ktb"], "left_anti")
                 .select("a", "b", "ratio").distinct())

    def contents(f: DataFrame) -> DataFrame:
        return f.dropDuplicates(["sig"]).select("sig", "kt", "ks", "nt", "ns", "tg")
    weighted = br.weighted_pairs(contents(nf), contents(ef)).where((F.col("S") < t) & (F.col("T") < t)).select(
        F.col("sa").alias("a"), F.col("sb").alias("b"), "T", "S", "G")
    return (rows(titles, "kt", "title", title_similarity=F.col("ratio"))
            .unionByName(rows(uncovered, "ks", "statement", statement_similarity=F.col("ratio")))
            .unionByName(rows(weighted, "sig", "weighted", title_similarity=F.col("T"), statement_similarity=F.col("S"),
                              tag_similarity=F.col("G"),
                              weighted_similarity=_weighted(F.col("T"), F.col("S"), F.col("G")))))


def _duplicated(nf: DataFrame, ef: DataFrame, t: float) -> dict[str, DataFrame]:
    """Keys of what duplicates one of ``ef`` in ``nf``: verdicts only.

    Each branch looks at what the one before has left, and no pair is scored
    beyond what its verdict needs. Nothing but keys is kept of a branch.
    """
    titles = _known(similar_pairs(_strings(nf, "kt", "nt"), _strings(ef, "kt", "nt"), t).select(F.col("ka").alias("kt")))
    left = _lacking(nf, titles, "kt")
    statements = _known(similar_pairs(_strings(left, "ks", "ns"), _strings(ef, "ks", "ns"), t)
                        .select(F.col("ka").alias("ks")))
    left = _lacking(left, statements, "ks")
    low_t, low_s = branch_floors(t)
    left = left.where(_reaches("nt", _extent(ef, "nt"), low_t) & _reaches("ns", _extent(ef, "ns"), low_s))
    weighted = _Branches.for_weighted(t).weighted_pairs(left, ef)
    return {"kt": titles, "ks": statements, "sig": _known(weighted.select(F.col("sa").alias("sig")))}


def _without_duplicates(nf: DataFrame, ef: DataFrame, t: float) -> DataFrame:
    """Feature rows of ``nf`` that duplicate none of ``ef``."""
    for key, found in _duplicated(nf, ef, t).items():
        nf = _lacking(nf, found, key)
    return nf


def _stored(df: DataFrame) -> DataFrame:
    """``df`` from compressed files of its own, of which each reader takes its
    columns; a checkpoint is neither."""
    path = scratch_dir(df.sparkSession, "features")
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dedupe_gate(new: DataFrame, existing: DataFrame, t: float = THRESHOLD, id: str = "id", **cols) -> DataFrame:
    """New records without any duplicate in the store.

    A verdict holds for a content, so ``new`` is not kept but read twice: for
    the texts whose length can reach the store's, which are all that is
    written, and for the records without the contents found to be duplicates.
    """
    ensure_checkpoint_dir(new.sparkSession)
    ef = _stored(features(existing, **{"id": id, **cols}).drop("id", "seq"))
    raw = [_h(F.col(cols.get(c, c)).cast("string")).alias(c) for c in ("title", "statement")]
    rows = new.withColumn(_CONTENT, _h(F.to_json(F.struct(*raw, F.col(cols.get("tags", "tags")).alias("tags")))))
    low_t, low_s = branch_floors(t)
    nf = _normalised(rows, id=id, **cols).drop("id", "seq").withColumns({
        c: F.when(_reaches(c, _extent(ef, c), min(t, low)), F.col(c)) for c, low in (("nt", low_t), ("ns", low_s))})
    nf = _stored(_keyed(nf))
    gone = [_among(nf, found, key).select(_CONTENT) for key, found in _duplicated(nf, ef, t).items()]
    return _lacking(rows, _known(functools.reduce(DataFrame.unionByName, gone)), _CONTENT).drop(_CONTENT)


# ------------------------------------------------------------------ greedy

UNDECIDED, ACCEPTED, REJECTED = 0, 1, 2


PREFIX = 512  # records of the first prefix; each following one is four times as long
#: A piece of undecided records is settled in one task up to so many records and links.
PIECE = 100_000
#: Rounds before pieces are looked for; about twice as many before the next time.
FIRST_ROUNDS = 2


def _keep_first(cf: DataFrame, t: float) -> DataFrame:
    """Feature rows of ``cf`` that keep-first accepts among themselves.

    Rounds decide most records: the copies and neighbours of what is accepted
    first. What stays undecided hangs together in chains, whose rounds would
    be as many as their links; connected pieces of it that fit a task are
    settled there in order, larger ones go on in rounds.
    Neighbourhoods are evaluated per title / statement group and per weighted
    signature pair, never as record pairs. Each round's state is checkpointed.
    """
    # exact copies collapse per (signature, key): a copy under another key
    # stays a node, since its key's earlier success may have stopped the first
    reps = cf.groupBy("sig", "_grp").agg(F.min(F.struct("at", "kt", "ks", "nt", "ns", "tg")).alias("r"))
    nodes = reps.select("sig", "_grp", "r.*").withColumn("state", F.lit(UNDECIDED)).checkpoint()
    br = _Branches(nodes, None, t)
    sig_view = nodes.select("sig", "kt", "ks", "nt", "ns", "tg").dropDuplicates(["sig"])
    links = {"kt": br.TP.where(F.col("ratio") >= t).select("ka", "kb").checkpoint(),
             "ks": br.SP.where(F.col("ratio") >= t).select("ka", "kb").checkpoint(),
             "sig": br.weighted_pairs(sig_view, sig_view).select(F.col("sa").alias("ka"), F.col("sb").alias("kb")).checkpoint()}
    nodes = nodes.select("sig", "_grp", "at", "kt", "ks", "state").checkpoint()
    rounds, look = 0, FIRST_ROUNDS
    while not nodes.where(F.col("state") == UNDECIDED).isEmpty():
        if rounds == look:
            nodes, look = _settle_pieces(nodes, links), 2 * look + 1
        else:
            nodes, rounds = _round(nodes, links), rounds + 1
    return cf.join(nodes.where(F.col("state") == ACCEPTED).select("at"), "at", "left_semi")


def _neighbour_min(nodes: DataFrame, links: dict[str, DataFrame], which: list[int]) -> DataFrame:
    """``nodes`` with ``_m``: the earliest place of neighbours (any branch) having state in which."""
    live = nodes.where(F.col("state").isin(which))
    places = []
    for i, (key, pairs) in enumerate(links.items()):
        first = live.groupBy(F.col(key).alias("kb")).agg(F.min("at").alias("x"))
        nodes = nodes.join(pairs.join(first, "kb").groupBy(F.col("ka").alias(key)).agg(F.min("x").alias(f"_m{i}")),
                           key, "left")
        places.append(f"_m{i}")
    ended = live.where(F.col("_grp").isNotNull()).groupBy("_grp").agg(F.min("at").alias("_mg"))
    return (nodes.join(ended, "_grp", "left").withColumn("_m", F.least(*places, "_mg")).drop(*places, "_mg"))


def _round(nodes: DataFrame, links: dict[str, DataFrame]) -> DataFrame:
    """One round (Blelloch-Fineman-Shun style): reject nodes with an accepted
    earlier neighbour; accept nodes whose earlier neighbours are all rejected.
    The earliest undecided node is always decided, so the rounds end."""
    undecided = F.col("state") == UNDECIDED
    x = _neighbour_min(nodes, links, [ACCEPTED])
    x = x.withColumn("state", F.when(undecided & (F.col("_m") < F.col("at")), F.lit(REJECTED))
                     .otherwise(F.col("state"))).drop("_m").checkpoint()
    y = _neighbour_min(x, links, [UNDECIDED, ACCEPTED])
    return y.withColumn("state", F.when(undecided & (F.coalesce(F.col("_m"), F.col("at")) >= F.col("at")), F.lit(ACCEPTED))
                        .otherwise(F.col("state"))).drop("_m").checkpoint()


def _settle_pieces(nodes: DataFrame, links: dict[str, DataFrame]) -> DataFrame:
    """``nodes`` with all connected pieces of at most ``PIECE`` rows decided.

    Once accepted nodes have rejected their later neighbours, only undecided
    nodes can decide undecided ones. Pieces are components of keys (titles,
    statements, contents, groups), known by their hash: two keys of one hash
    only make a piece larger.
    """
    def spot(key: str, c: str) -> Column:
        return F.xxhash64(F.lit(key), F.col(c))

    # A rejection by what the last round accepted is still due.
    x = _neighbour_min(nodes, links, [ACCEPTED])
    nodes = x.withColumn("state", F.when((F.col("state") == UNDECIDED) & (F.col("_m") < F.col("at")), F.lit(REJECTED))
                         .otherwise(F.col("state"))).drop("_m").checkpoint()
    live = nodes.where(F.col("state") == UNDECIDED).select("sig", "_grp", "at", "kt", "ks")
    rows = None
    for key, pairs in links.items():
        held = live.select(F.col(key).alias("k")).distinct()
        own = (pairs.join(held.withColumnRenamed("k", "ka"), "ka", "left_semi")
               .join(held.withColumnRenamed("k", "kb"), "kb", "left_semi")
               .select(F.lit(key).alias("key"), "ka", "kb", spot(key, "ka").alias("u"), spot(key, "kb").alias("v")))
        rows = own if rows is None else rows.unionByName(own)
    rows = rows.checkpoint()
    inner = [live.select(spot("kt", "kt").alias("u"), spot(c, c).alias("v")).where(F.col(c).isNotNull())
             for c in ("ks", "sig", "_grp")]
    edges = functools.reduce(DataFrame.unionByName, inner, rows.select("u", "v"))
    found = components(edges, "u", "v")

    def rooted(df: DataFrame, c: str) -> DataFrame:
        return (df.join(found.withColumnRenamed("node", c), c, "left")
                .withColumn("root", F.coalesce("root", c)).drop("u", "v"))
    members = rooted(live.withColumn("u", spot("kt", "kt")), "u").checkpoint()
    pairs = rooted(rows, "u")
    small = (members.select("root").unionByName(pairs.select("root")).groupBy("root").agg(F.count(F.lit(1)).alias("n"))
             .where(F.col("n") <= PIECE).select("root")).checkpoint()
    order = Window.partitionBy("root").orderBy("at")  # of small pieces only
    members = (members.join(small, "root", "left_semi")
               .select("root", F.col(f"at.{_ROW}").alias("row"), F.row_number().over(order).alias("place"),
                       "kt", "ks", "sig", "_grp"))
    settled = (members.groupBy("root").cogroup(pairs.join(small, "root", "left_semi").groupBy("root"))
               .applyInPandas(_in_order, "row long, decided int"))
    return (nodes.withColumn("row", F.col(f"at.{_ROW}")).join(settled, "row", "left")
            .withColumn("state", F.coalesce("decided", "state")).drop("row", "decided").checkpoint())


def _in_order(members: pd.DataFrame, pairs: pd.DataFrame) -> pd.DataFrame:
    """Keep-first over one piece: an accepted record rules out whatever is
    linked to one of its keys, and the rest of its group."""
    linked: dict[tuple, list] = {}
    for key, new, old in zip(pairs["key"], pairs["ka"], pairs["kb"]):
        linked.setdefault((key, bytes(old)), []).append((key, bytes(new)))
    members = members.sort_values("place")
    out, ruled_out = [], set()
    for kt, ks, sig, group in zip(members["kt"], members["ks"], members["sig"], members["_grp"]):
        own = [("kt", bytes(kt)), ("ks", bytes(ks)), ("sig", bytes(sig))]
        ends = [("_grp", group)] if group is not None else []
        if ruled_out.isdisjoint(own + ends):
            out.append(ACCEPTED)
            ruled_out.update(ends, *(linked.get(k, ()) for k in own))
        else:
            out.append(REJECTED)
    return pd.DataFrame({"row": members["row"], "decided": out})


def greedy_dedupe(cands: DataFrame, store: DataFrame | None = None, t: float = THRESHOLD,
                  limit: int | None = None, group: str | None = None, **cols) -> DataFrame:
    """Order-dependent keep-first. A record is accepted iff it has no
    duplicate among the records accepted before it (store records count as
    accepted and come first). Output: the candidate rows plus ``accepted``.

    The order is (seq, id), equal ones by row. Candidates that duplicate a
    store record leave first, by verdicts of candidates against the store
    (store records are never compared with one another). The rest are decided
    in prefixes of growing length (``_keep_first``); after each, whatever its
    accepted records rule out leaves by the same verdicts. Checkpoints are
    reliable ones in ``spark.checkpoint.dir``.

    ``group``: attempts of one metadata key; an accepted attempt ends its key,
    so later attempts of that key never count. ``limit``: only the first so
    many accepted ones stay accepted.
    """
    spark = cands.sparkSession
    ensure_checkpoint_dir(spark)
    rows = (cands.withColumn("_grp", F.col(group).cast("string") if group else F.lit(None).cast("string"))
            .withColumn(_ROW, F.monotonically_increasing_id()).checkpoint())
    cf = features(rows, **cols).checkpoint()
    if store is not None:
        cf = _without_duplicates(cf, features(store, **{**cols, "seq": cols.get("id", "id")}).checkpoint(), t).checkpoint()
    cf = cf.withColumn("at", F.struct("seq", "id", _ROW)).checkpoint()
    # In order, a prefix at a time: what its accepted ones rule out never meets
    # the rest. Where much repeats, few records ever meet one another.
    rest, size, parts, n_accepted = cf, PREFIX, [], 0
    while (n := rest.count()) and (limit is None or n_accepted < limit):
        if n > size:
            bound = rest.agg(F.percentile_approx("seq", size / n, 10000)).first()[0]
            # Null places come first, as in ``at``.
            head, tail = rest.where(F.col("seq").isNull() | (F.col("seq") <= bound)), rest.where(F.col("seq") > bound)
        else:
            head, tail = rest, None
        done = _keep_first(head, t).checkpoint()
        parts.append(done)
        n_accepted += done.count()
        if tail is None:
            break
        ended = done.where("_grp IS NOT NULL").select("_grp").distinct()
        rest = _without_duplicates(tail.join(ended, "_grp", "left_anti"), done, t).checkpoint()
        size *= 4
    accepted = functools.reduce(DataFrame.unionByName, parts) if parts else cf.where("false")
    if limit is not None:
        accepted = accepted.orderBy("at").limit(limit)
    kept = accepted.select(F.col(f"at.{_ROW}").alias(_ROW), F.lit(True).alias("accepted"))
    return (rows.join(kept, _ROW, "left").withColumn("accepted", F.coalesce("accepted", F.lit(False)))
            .drop(_ROW, "_grp"))
