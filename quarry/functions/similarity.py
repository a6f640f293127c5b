"""Similarity scores (F5, F6, F7) and lossless bounds.

``sequence_ratio`` is Ratcliff-Obershelp ``2M/T`` with the values that Python's
``difflib.SequenceMatcher(None, new, existing).ratio()`` gives (popular
characters start no match, asymmetric). No JVM built-in computes it, so it runs
as an Arrow-batched pandas UDF - only ever on *distinct* string pairs that
survived the native candidate filters.

The matcher here is our own. The longest common block of two ranges is found by
substring search: the block so far, one character longer, is looked up from
each place, so a place that cannot win costs one search. While a pair is taken
apart, an upper bound of the matched characters is kept (what is matched, plus
the common characters of every range still open); a pair that can no longer
reach its threshold is given up, which for unlike texts is after one or two
blocks.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.functions.text import normalize_text

# Weights and default threshold.
W_TITLE, W_STATEMENT, W_TAGS = 0.4, 0.5, 0.1
THRESHOLD = 0.85
EPS = 1e-9


# In strings this long, characters with a share above this start no match.
POPULAR_FROM, POPULAR_SHARE = 200, 100


def _unpopular(a: str, b: str) -> tuple[str, str, str]:
    """Both strings with the popular characters of ``b`` replaced by one that
    the other does not have, so that they match nothing, and that of ``a``."""
    if len(b) < POPULAR_FROM:
        return a, b, ""
    most = len(b) // POPULAR_SHARE + 1
    popular = [c for c in set(b) if b.count(c) > most]
    if not popular:
        return a, b, ""
    used = set(a) | set(b)
    free = (chr(i) for i in range(0xE000, 0x110000) if chr(i) not in used)
    x, y = next(free), next(free)
    return a.translate({ord(c): x for c in popular}), b.translate({ord(c): y for c in popular}), x


def _common_characters(x: str, y: str) -> int:
    if len(x) > len(y):
        x, y = y, x
    return sum(min(x.count(c), y.count(c)) for c in set(x))


def _longest_block(a: str, b: str, sa: str, sb: str, popular: str) -> tuple[int, int, int]:
    """(place in ``a``, place in ``b``, size) of the longest common block, the
    earliest in ``a``, then in ``b``. It starts from the searchable forms
    ``sa, sb`` and then grows over any equal characters around it."""
    i = j = size = 0
    last, top = len(a), len(b)
    begin = 0
    for part in sa.split(popular) if popular else (sa,):
        at, end = begin, begin + len(part)
        while at + size < end:
            while at + size < end and (found := sb.find(sa[at:at + size + 1])) >= 0:
                i, j, size = at, found, size + 1
            at += 1
        begin = end + 1
    while i and j and a[i - 1] == b[j - 1]:
        i, j, size = i - 1, j - 1, size + 1
    while i + size < last and j + size < top and a[i + size] == b[j + size]:
        size += 1
    return i, j, size


def _matched(a: str, b: str, least: float) -> int | None:
    """Matched characters, or None once they cannot reach ``least``."""
    sa, sb, popular = _unpopular(a, b)
    bounded = least > 0
    bound = _common_characters(a, b) if bounded else 0
    if bound < least:
        return None
    total, open_ = 0, [(a, b, sa, sb, bound)]
    while open_:
        a, b, sa, sb, most = open_.pop()
        i, j, size = _longest_block(a, b, sa, sb, popular)
        bound -= most
        if not size:
            if bounded and bound < least:
                return None
            continue
        total += size
        bound += size
        for cut_a, cut_b in ((slice(0, i), slice(0, j)), (slice(i + size, None), slice(j + size, None))):
            x, y = a[cut_a], b[cut_b]
            if x and y:
                most = _common_characters(x, y) if bounded else 0
                bound += most
                open_.append((x, y, sa[cut_a], sb[cut_b], most))
        if bounded and bound < least:
            return None
    return total


def _ratio(a: str, b: str) -> float:
    if not a or not b:
        return 1.0 if a == b else 0.0
    return 2.0 * _matched(a, b, 0) / (len(a) + len(b))


def ratio_at_least(a: str, b: str, m: float):
    """Exact ratio if it reaches ``m``, else None."""
    if not a or not b:
        r = 1.0 if a == b else 0.0
        return r if r >= m else None
    total = len(a) + len(b)
    # Whole characters: a tenth of one is far above any rounding of m.
    found = _matched(a, b, max(0.0, (m - EPS) * total / 2 - 0.1))
    if found is None:
        return None
    r = 2.0 * found / total
    return r if r >= m - EPS else None


@F.pandas_udf(T.DoubleType())
def ratio_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([_ratio(x or "", y or "") for x, y in zip(a, b)], dtype="float64")


def sequence_ratio(new, existing) -> Column:
    """F5 on raw text: normalise both, then the exact ratio (new vs existing)."""
    return ratio_udf(normalize_text(new), normalize_text(existing))


def weighted_similarity(title_sim, statement_sim, tag_sim) -> Column:
    """evaluated left to right like the record rule (bit-identical doubles)."""
    c = (lambda x: F.col(x) if isinstance(x, str) else x)
    return c(title_sim) * W_TITLE + c(statement_sim) * W_STATEMENT + c(tag_sim) * W_TAGS


def is_duplicate(title_sim, statement_sim, weighted, t: float = THRESHOLD) -> Column:
    """any of the three scores at or above the threshold."""
    c = (lambda x: F.col(x) if isinstance(x, str) else x)
    return (c(title_sim) >= t) | (c(statement_sim) >= t) | (c(weighted) >= t)


def branch_floors(t: float = THRESHOLD) -> tuple[float, float]:
    """Lowest title / statement score that can still make a pair a duplicate
    through the weighted score when the other two tests fail (tags <= 1)."""
    low_t = (t - W_STATEMENT * t - W_TAGS) / W_TITLE
    low_s = (t - W_TITLE * t - W_TAGS) / W_STATEMENT
    return max(0.0, low_t - EPS), max(0.0, low_s - EPS)


def length_floor(m: float) -> float:
    """ratio >= m implies min(len)/max(len) >= m / (2 - m)."""
    return m / (2.0 - m)
