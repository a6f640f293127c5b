"""Text normalisation as native Column expressions (whole-stage codegen).

Python's ``str.strip``/``\\s``/``\\w`` differ from Java's defaults, so every
class is spelled out explicitly. The classes below match the Unicode rules the
record model relies on: whitespace is the 29 code points Python treats as
blank, word characters are letters, numbers and underscore.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Character classes (Java regex syntax, used inside [...]).
WS_BODY = r"\t-\r\x1c-\x20\x85\p{Z}"
WORD_BODY = r"\p{L}\p{N}_"
WS = f"[{WS_BODY}]"
# Line separators of Python's str.splitlines.
LINE_SEP = r"\r\n|[\n\x0b\x0c\r\x1c-\x1e\x85\u2028\u2029]"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ustrip(c) -> Column:
    """Remove leading and trailing Unicode whitespace."""
    c = _c(c)
    return F.regexp_replace(F.regexp_replace(c, rf"\A{WS}+", ""), rf"{WS}+\z", "")


def normalize_text(c) -> Column:
    """null/empty -> ''; lower; strip; drop everything but word chars and blanks.

    The strip runs before the removal, so ``"a !"`` becomes ``"a "``.
    """
    s = ustrip(F.lower(F.coalesce(_c(c), F.lit(""))))
    return F.regexp_replace(s, f"[^{WORD_BODY}{WS_BODY}]", "")


def normalize_word(c) -> Column:
    """lower and keep only word characters (inner blanks disappear)."""
    return F.regexp_replace(F.lower(F.coalesce(_c(c), F.lit(""))), f"[^{WORD_BODY}]", "")


def split_words(c) -> Column:
    """Whitespace tokenisation like ``str.split()``; '' gives an empty array."""
    s = ustrip(F.coalesce(_c(c), F.lit("")))
    return F.when(s == "", F.array().cast("array<string>")).otherwise(F.split(s, f"{WS}+"))


def normalize_tags(c) -> Column:
    """drop null/empty items, lower+strip the rest, distinct, sorted.

    A blank-only tag becomes ``""`` and stays in the set.
    """
    arr = F.coalesce(_c(c), F.array().cast("array<string>"))
    kept = F.filter(arr, lambda x: x.isNotNull() & (x != ""))
    return F.array_sort(F.array_distinct(F.transform(kept, lambda x: ustrip(F.lower(x)))))


def tag_jaccard(a, b) -> Column:
    """A2: |A & B| / |A | B| of normalised tag sets; both empty 1.0, one empty 0.0."""
    sa, sb = normalize_tags(a), normalize_tags(b)
    na, nb = F.size(sa), F.size(sb)
    ratio = F.size(F.array_intersect(sa, sb)).cast("double") / F.size(F.array_union(sa, sb))
    return (F.when((na == 0) & (nb == 0), F.lit(1.0))
            .when((na == 0) | (nb == 0), F.lit(0.0))
            .otherwise(ratio))


def clean_llm_json(c) -> Column:
    """strip; a fenced reply loses its first line and a closing fence line.

    Unfenced text is only stripped. Text after a closing fence is kept when the
    fence is not the last line. Null stays null (a failed call). For large
    texts prefer ``with_clean_llm_json`` (each stage computed once).
    """
    t = ustrip(_c(c))
    lines = F.split(t, LINE_SEP, -1)
    rest = F.filter(lines, lambda x, i: i >= 1)
    n = F.size(rest)
    body = F.when((n > 0) & (ustrip(F.element_at(rest, -1)) == "```"),
                  F.filter(rest, lambda x, i: i < n - 1)).otherwise(rest)
    return F.when(t.startswith("```"), ustrip(F.array_join(body, "\n"))).otherwise(t)


def with_clean_llm_json(df, src: str, out: str):
    """F15 as staged columns: the strip, the line split (fenced replies only)
    and the body are separate projections, so no stage is evaluated twice."""
    t, rest = f"_{out}_t", f"_{out}_rest"
    df = df.withColumn(t, ustrip(F.col(src)))
    df = df.withColumn(rest, F.when(F.col(t).startswith("```"),
                                    F.filter(F.split(F.col(t), LINE_SEP, -1), lambda x, i: i >= 1)))
    r, n = F.col(rest), F.size(F.col(rest))
    body = F.when((n > 0) & (ustrip(F.element_at(r, -1)) == "```"),
                  F.filter(r, lambda x, i: i < n - 1)).otherwise(r)
    df = df.withColumn(out, F.when(F.col(rest).isNotNull(), ustrip(F.array_join(body, "\n")))
                       .otherwise(F.col(t)))
    return df.drop(t, rest)


def trimmed_equal(a, b) -> Column:
    """Equality after Unicode strip of both sides."""
    return ustrip(F.coalesce(_c(a), F.lit(""))) == ustrip(F.coalesce(_c(b), F.lit("")))
