"""Personal data: overlapping candidates judged by gradient boosted trees.

Base patterns find emails, ip addresses, card and phone numbers with their
checks; these spans always stay. Generators of high recall propose more spans,
which may overlap. Features of format and context describe each candidate by a
few small numbers; the outcome of a kind's check (digit counts, Luhn sum, parts
of an address) is not among them. Candidates that are a base span teach as
positives; those that fail their check, or lie over a base span of another kind,
as negatives. ``SEEDS``, a few plain phrases, teach what a word before a number
says of it. The trees then judge the candidates that no base span settles; those
that fail their check are dropped afterwards.

Rows with equal features teach alike, so learning needs only their counts: one
row for each feature vector seen (at most 259,200, twice the product of the
feature ranges, whatever the input). Boosted trees are grown on these counts, a
logistic fit on held-back documents calibrates them, and each kind's threshold
is the lowest probability that keeps ``precision`` there. The trees then become
one SQL expression: finding, judging and redacting are DataFrame expressions
within a row.

Spans of one kind and generator are in order and apart, so what a span meets is
found by bisection: work grows with the spans of a text, times a logarithm. Texts
of any length are taken whole.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import stage

KINDS = ["email", "ip", "card", "phone"]
TAGS = ["<EMAIL>", "<IP>", "<CARD>", "<PHONE>"]

# The base patterns of the contract. Where a run of characters can only match
# from its first one (or where the match before it ended), the lookbehind says
# so, and possessive repeats forbid useless returns: time stays linear and the
# matches are the same.
EMAIL = (r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
IP = r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
BASE = [(EMAIL, 0, "@"), (IP, 1, "."), (CARD, 2, None), (PHONE, 3, "+")]

# Generators: (pattern, kind, a character every match holds).
GENERATORS = [
    (EMAIL, 0, "@"),
    (r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++ ?(?:\(at\)|\[at\]) ?[A-Za-z0-9-]++"
     r"(?: ?(?:\.|\(dot\)|\[dot\]) ?[A-Za-z0-9-]++)++", 0, "at"),
    (r"(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9])(?!\.[0-9])", 1, "."),
    (r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])", 1, ":"),
    (r"(?<![0-9A-Za-z])(?:[0-9]{12,19}|[0-9]{4}(?:[ .-][0-9]{4}){3}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5})(?![0-9A-Za-z])",
     2, None),
    (r"(?<![0-9A-Za-z+])(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{2,4}\)|[0-9]{3})[ .-]?[0-9]{3}[ .-][0-9]{4}(?![0-9A-Za-z])",
     3, None),
    (r"(?<![0-9])[0-9]{7,19}(?![0-9])", 3, None),
]
FEATURES = ["kind", "digits", "groups", "paren", "sep", "lead", "varied", "prev", "next", "cue"]
#: Words that announce a kind, and words that announce some other number.
CUES = [r"e?mail|write|reach|contact", r"ip|address|server|host|node|gateway",
        r"card|visa|mastercard|amex|credit|debit|paid|pay", r"phone|tel|call|fax|mobile|cell|dial|sms|contact"]
OTHER_CUE = r"isbn|order|invoice|serial|part|ref|version|ticket|case|sku|page|tracking|id|no|total|build"
#: Phrases that teach how a cue weighs: (what, forms); each form counts as a
#: positive behind the first words, as a negative behind the second.
SEEDS = [
    (0, ["ann(at)mail.org", "bo.li [at] example [dot] com"], ["mail", "contact"], ["version", "part"]),
    (1, ["10.20.30.40", "2001:db8:0:0:0:0:0:1"], ["server", "address"], ["version", "build"]),
    (2, ["4111.1111.1111.1111", "4111 1111 1111 1111", "4111111111111111"], ["card", "visa"], ["isbn", "order"]),
    (3, ["5551234567", "555-123-4567", "(555) 123-4567", "555 123 4567"], ["phone", "call"], ["order", "ticket"]),
]
SEED_WEIGHT = 20.0
BLOCK = 256


# ------------------------------------------------------------ finding spans

def _ends(lengths: Column) -> Column:
    """Running sums of an array in blocks: work grows as n * (n/256 + 256)."""
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(lengths) - 1) / BLOCK).cast("int")),
                         lambda b: F.slice(lengths, b * BLOCK + 1, F.lit(BLOCK)))

    def add(a: Column, x: Column) -> Column:
        return a + x

    def within(block: Column, b: Column) -> Column:
        return F.transform(block, lambda x, k: F.aggregate(F.slice(lengths, F.lit(1), b * BLOCK), F.lit(0), add)
                           + F.aggregate(F.slice(block, F.lit(1), k + 1), F.lit(0), add))
    return F.when(F.size(lengths) > 0, F.flatten(F.transform(blocks, within))).otherwise(F.array().cast("array<int>"))


def with_matches(df: DataFrame, text: str, patterns: list[tuple], name: str) -> DataFrame:
    """Adds ``{name}{i}``: array of (s, e, x, before, after) of each pattern's
    matches: code points, end exclusive, with the text beside them.

    What lies between the matches gives their places, so the text is searched
    by the same pattern twice and each array is computed once a row.
    """
    keep = [c for c in df.columns]
    none = F.array().cast("array<string>")
    digit = F.col(text).rlike("[0-9]")
    found = []
    for i, (pattern, _, holds) in enumerate(patterns):
        may = F.col(text).contains(holds) if holds else digit
        found += [F.when(may, F.regexp_extract_all(text, F.lit(pattern), 0)).otherwise(none).alias(f"_m{i}"),
                  F.when(may, F.split(text, pattern, -1)).otherwise(none).alias(f"_p{i}")]
    df = df.select(*keep, *found)
    sums = [F.zip_with(f"_m{i}", F.slice(f"_p{i}", F.lit(1), F.size(f"_m{i}")),
                       lambda a, b: F.length(a) + F.length(b)).alias(f"_l{i}") for i in range(len(patterns))]
    both = [c for i in range(len(patterns)) for c in (f"_m{i}", f"_p{i}")]
    df = df.select(*keep, *both, *sums)
    df = df.select(*keep, *both, *[_ends(F.col(f"_l{i}")).alias(f"_e{i}") for i in range(len(patterns))])

    def spans(i: int) -> Column:
        return F.transform(f"_m{i}", lambda x, k: F.struct(
            (F.get(f"_e{i}", k) - F.length(x)).alias("s"), F.get(f"_e{i}", k).alias("e"), x.alias("x"),
            F.right(F.get(f"_p{i}", k), F.lit(24)).alias("before"),
            F.left(F.get(f"_p{i}", k + 1), F.lit(1)).alias("after")))
    return df.select(*keep, *[spans(i).alias(f"{name}{i}") for i in range(len(patterns))])


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Digits from the right, every second one doubled, 9 taken off above 9."""
    at = F.sequence(F.lit(1), F.length(digits))

    def add(total: Column, i: Column) -> Column:
        d = F.ascii(F.substring(digits, F.length(digits) - i + 1, F.lit(1))) - 48
        d = F.when(i % 2 == 0, 2 * d - F.when(d > 4, 9).otherwise(0)).otherwise(d)
        return total + d.cast("int")
    return F.aggregate(at, F.lit(0), add) % 10 == 0


def check(kind: int, x: Column) -> Column:
    """Whether a span of a kind holds what its numbers must."""
    if kind == 0:
        return F.lit(True)
    if kind == 1:
        def fits(part: Column) -> Column:
            part = F.regexp_replace(part, "^0+", "")
            return (F.length(part) <= 3) & (F.coalesce(part.try_cast("int"), F.lit(0)) <= 255)
        return x.contains(":") | F.forall(F.split(x, r"\."), fits)
    n = F.length(_digits(x))
    return (n >= 12) & (n <= 19) & _luhn(_digits(x)) if kind == 2 else (n >= 9) & (n <= 15)


def sound(kind: int, x: Column) -> Column:
    """The check a candidate must pass; an email's last label has letters only."""
    return x.rlike("[A-Za-z]{2,}$") if kind == 0 else check(kind, x)


def _class(c: Column) -> Column:
    return (F.when((c == "") | c.isNull() | c.rlike(r"[\x20\x09-\x0D]"), 0).when(c.rlike(r"[\p{L}0-9]"), 1).otherwise(2))


def _features(kind: int, m: Column) -> list[Column]:
    """A plus sign is no feature: only with it can a phone number be a base span."""
    x = m["x"]
    digits = _digits(x)
    n = F.length(digits)
    groups = F.size(F.filter(F.split(x, "[^0-9A-Za-z]+"), lambda g: g != ""))
    kinds_of_sep = [x.contains(c).cast("int") for c in (" ", "-", ".")]
    sep = (F.when(sum(kinds_of_sep[1:], kinds_of_sep[0]) > 1, 4).when(x.contains(" "), 1).when(x.contains("-"), 2)
           .when(x.contains("."), 3).otherwise(0))
    first = F.regexp_extract(x, "[0-9A-Za-z]", 0)
    distinct = F.size(F.array_distinct(F.split(digits, "")))
    nearest = rf"(?is)^.*(?<![\p{{L}}0-9])(?:({CUES[kind]})|({OTHER_CUE}))(?![\p{{L}}0-9])"
    values = [F.lit(kind),
              F.when(n < 7, 0).when(n < 9, 1).when(n < 12, 2).when(n < 16, 3).otherwise(4),
              F.when(groups < 2, 0).when(groups < 4, 1).when(groups < 6, 2).otherwise(3),
              x.contains("("), sep, F.when(first.rlike("[01]"), 0).when(first.rlike("[2-9]"), 1).otherwise(2),
              distinct > 3, _class(F.right(m["before"], F.lit(1))), _class(m["after"]),
              F.when(F.regexp_extract(m["before"], nearest, 1) != "", 1)
              .when(F.regexp_extract(m["before"], nearest, 2) != "", 2).otherwise(0)]
    return [v.cast("int").alias(f) for v, f in zip(values, FEATURES)]


STEPS = ", ".join(str(1 << i) for i in range(24, -1, -1))


def _below(spans: str, key: str, bound: str) -> str:
    """SQL: how many spans, in order of ``key``, have it under ``bound``, by bisection."""
    fits = f"at + w <= size({spans}) AND get({spans}, at + w - 1).{key} < {bound}"
    return f"if(size({spans}) > 0, aggregate(array({STEPS}), 0, (at, w) -> if({fits}, at + w, at)), 0)"


def _where(spans: str, field_name: str, value: int) -> Column:
    return F.filter(spans, lambda x: x[field_name] == value)


def with_candidates(df: DataFrame, text: str) -> DataFrame:
    """Adds ``base``: array of (s, kind, e), and ``cands``: array of (s, e, g,
    f, label, open). ``g`` numbers the generator, ``f`` holds the features;
    label 1: a base span, 0: unsound or over another kind's base span, else
    null; open: sound and over no base span."""
    keep = list(df.columns)
    df = with_matches(df, text, BASE, "_b")

    def accepted(i: int, kind: int) -> Column:
        return F.transform(F.filter(f"_b{i}", lambda m: check(kind, m["x"])),
                           lambda m: F.struct(m["s"].alias("s"), m["e"].alias("e"))).alias(f"_a{kind}")
    df = df.select(*keep, *[accepted(i, kind) for i, (_, kind, _) in enumerate(BASE)])
    own = [f"_a{kind}" for kind in range(len(KINDS))]
    df = with_matches(df, text, GENERATORS, "_g")

    def described(i: int, kind: int) -> Column:
        return F.transform(f"_g{i}", lambda m: F.struct(
            m["s"].alias("s"), m["e"].alias("e"), F.lit(i).alias("g"), F.struct(*_features(kind, m)).alias("f"),
            sound(kind, m["x"]).alias("sound")))

    def named(kind: int) -> Column:
        return F.transform(f"_a{kind}", lambda x: F.struct(x["s"].alias("s"), F.lit(kind).alias("kind"), x["e"].alias("e")))
    df = df.select(*keep, *own, F.concat(*[described(i, k) for i, (_, k, _) in enumerate(GENERATORS)]).alias("_c"))
    # The last base span of each kind that begins before a candidate's end.
    near = ", ".join(f"get({a}, {_below(a, 's', 'c.e')} - 1)" for a in own)
    df = df.select(*keep, *own, F.expr(f"transform(_c, c -> struct(c, array({near}) AS near))").alias("_c"))
    df = df.select(*keep, F.concat(*[named(kind) for kind in range(len(KINDS))]).alias("base"), "_c")

    def labelled(x: Column) -> Column:
        c, same = x["c"], F.get(x["near"], x["c"]["f"]["kind"])
        hit = (same["s"] == c["s"]) & (same["e"] == c["e"])
        over = F.size(F.filter(x["near"], lambda b: b["e"] > c["s"]))
        foreign = over > F.coalesce(same["e"] > c["s"], F.lit(False)).cast("int")
        label = F.when(hit, 1).when(~c["sound"] | foreign, 0)
        return F.struct(c["s"].alias("s"), c["e"].alias("e"), c["g"].alias("g"), c["f"].alias("f"),
                        label.alias("label"), (c["sound"] & (over == 0)).alias("open"))
    return df.select(*keep, "base", F.transform("_c", labelled).alias("cands"))


# ----------------------------------------------------------- boosted trees

@dataclass
class Trees:
    """Log-odds ``start`` plus trees; a tree is a leaf value or (feature, value,
    tree if the feature is at most the value, tree otherwise)."""

    start: float = 0.0
    trees: list = field(default_factory=list)
    slope: float = 1.0
    shift: float = 0.0
    thresholds: list[float] = field(default_factory=lambda: [0.5] * len(KINDS))

    def raw(self, x: np.ndarray) -> np.ndarray:
        def value(tree, rows):
            if not isinstance(tree, tuple):
                return np.full(len(rows), tree)
            f, v, low, high = tree
            return np.where(rows[:, f] <= v, value(low, rows), value(high, rows))
        return self.start + sum((value(t, x) for t in self.trees), np.zeros(len(x)))

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.slope * self.raw(x) + self.shift)))

    def sql(self, row: str) -> str:
        """Calibrated log-odds of the feature struct ``row``."""
        def case(tree) -> str:
            if not isinstance(tree, tuple):
                return f"{tree:.10g}D"
            f, v, low, high = tree
            return f"if({row}.{FEATURES[f]} <= {v}, {case(low)}, {case(high)})"
        raw = " + ".join([f"{self.start:.10g}D", *[case(t) for t in self.trees]])
        return f"{self.slope:.10g}D * ({raw}) + {self.shift:.10g}D"


def _grow(x: np.ndarray, g: np.ndarray, h: np.ndarray, depth: int, rate: float, ridge: float):
    leaf = rate * float(g.sum() / (h.sum() + ridge))
    best, split = 1e-6, None
    if depth:
        whole = g.sum() ** 2 / (h.sum() + ridge)
        for f in range(x.shape[1]):
            for v in np.unique(x[:, f])[:-1]:
                low = x[:, f] <= v
                gain = (g[low].sum() ** 2 / (h[low].sum() + ridge)
                        + g[~low].sum() ** 2 / (h[~low].sum() + ridge) - whole)
                if gain > best:
                    best, split = gain, (f, int(v), low)
    if split is None:
        return leaf
    f, v, low = split
    return (f, v, _grow(x[low], g[low], h[low], depth - 1, rate, ridge),
            _grow(x[~low], g[~low], h[~low], depth - 1, rate, ridge))


def boost(x: np.ndarray, positive: np.ndarray, negative: np.ndarray, rounds: int = 30, depth: int = 3,
          rate: float = 0.3, ridge: float = 1.0) -> Trees:
    """Logistic boosting over distinct rows with their class counts."""
    n = positive + negative
    model = Trees(start=float(np.log((positive.sum() + 0.5) / (negative.sum() + 0.5))))
    score = model.raw(x)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-score))
        tree = _grow(x, positive - n * p, n * p * (1 - p), depth, rate, ridge)
        model.trees.append(tree)
        score = model.raw(x)
    return model


def calibrate(model: Trees, x: np.ndarray, positive: np.ndarray, negative: np.ndarray, precision: float) -> None:
    """Logistic fit of scores to held-back classes, then each kind's threshold."""
    raw, n = model.raw(x), positive + negative
    if positive.sum() and negative.sum():
        a, b = 1.0, 0.0
        for _ in range(50):  # Newton, with a pull towards slope 1 and shift 0
            p = 1 / (1 + np.exp(-np.clip(a * raw + b, -30, 30)))
            r, w = positive - n * p, n * p * (1 - p)
            grad = np.array([(r * raw).sum() - (a - 1), r.sum() - b])
            hess = np.array([[(w * raw * raw).sum() + 1, (w * raw).sum()], [(w * raw).sum(), w.sum() + 1]])
            a, b = np.array([a, b]) + np.linalg.solve(hess, grad)
        model.slope, model.shift = float(max(a, 0.05)), float(b)
    p = model.probability(x)
    for kind in range(len(KINDS)):
        own = x[:, 0] == kind
        for t in sorted({0.5, *(float(v) for v in p[own] if v > 0.5)}):
            took = own & (p >= t)
            if positive[took].sum() >= precision * n[took].sum():
                model.thresholds[kind] = t
                break
        else:
            model.thresholds[kind] = 1.0


def _counts(found: DataFrame, label: Column, *by: Column) -> list:
    """Each feature vector with its labelled candidates: values, positives, all."""
    rows = found.select(*by, F.explode_outer("cands").alias("c")).withColumn("_y", label).where("_y IS NOT NULL")
    names = [c for c in rows.columns if c not in ("c", "_y")]
    return rows.groupBy(*names, *[F.col(f"c.f.{f}").alias(f) for f in FEATURES]).agg(
        F.sum("_y").alias("positive"), F.count(F.lit(1)).alias("n")).collect()


@lru_cache(maxsize=1)
def _seed_rows(spark: SparkSession) -> tuple[tuple, ...]:
    phrases = [(kind, positive, f"{cue} {form}") for kind, forms, good, bad in SEEDS
               for positive, cues in ((1, good), (0, bad)) for cue in cues for form in forms]
    found = with_candidates(spark.createDataFrame(phrases, "seed int, positive int, t string"), "t")
    rows = _counts(found, F.when(F.col("seed") == F.col("c.f.kind"), F.col("positive")), F.col("seed"), F.col("positive"))
    return tuple((*r[2:-2], SEED_WEIGHT * r[-2], SEED_WEIGHT * r[-1]) for r in rows)


def _held(text: str) -> Column:
    return F.pmod(F.xxhash64(text), F.lit(5)) == 0


def learn(found: DataFrame, precision: float) -> Trees:
    """Trees from rows of (``held``, ``cands``); held rows calibrate."""
    seen = _counts(found, F.col("c.label"), F.col("held"))
    rows = [(False, *r) for r in _seed_rows(found.sparkSession)] + [tuple(r) for r in seen]
    x = np.array([r[1:-2] for r in rows], dtype=np.int64)
    positive = np.array([r[-2] for r in rows], dtype=float)
    negative = np.array([r[-1] for r in rows], dtype=float) - positive
    held = np.array([r[0] for r in rows], dtype=bool)
    model = boost(x[~held], positive[~held], negative[~held])
    calibrate(model, x[held], positive[held], negative[held], precision)
    return model


def train(docs: DataFrame, precision: float = 0.95, text: str = "text") -> Trees:
    """Learn from all rows of ``docs``. Every fifth document (by a hash of its
    text) calibrates."""
    base = docs.select(F.coalesce(F.col(text), F.lit("")).alias("_t"))
    # explode() would test the whole array once more before it, from the text on.
    return learn(with_candidates(base, "_t").select(_held("_t").alias("held"), "cands"), precision)


# ---------------------------------------------------------------- applying

def judged(found: DataFrame, model: Trees, keep: list[str]) -> DataFrame:
    """Columns ``keep`` of rows with ``base`` and ``cands``, then ``base`` and
    ``spans`` in order."""
    odds = [float(np.log(t / (1 - t))) if t < 1 else 1e9 for t in model.thresholds]
    least = f"element_at(array({', '.join(f'{o:.10g}D' for o in odds)}), c.f.kind + 1)"
    scored = F.expr("transform(filter(cands, c -> c.open), c -> named_struct('s', c.s, 'kind', c.f.kind, 'e', c.e, "
                    f"'g', c.g, 'odds', {model.sql('c.f')}, 'least', {least}))")
    df = found.select(*keep, "base", scored.alias("_j"))
    passed = F.filter("_j", lambda c: c["odds"] >= c["least"] - 1e-6)
    df = df.select(*keep, "base", passed.alias("_j"))
    df = df.select(*keep, "base", *[_where("_j", "g", i).alias(f"_k{i}") for i in range(len(GENERATORS))])

    better = "struct(d.odds, d.e - d.s, -d.s) > struct(c.odds, c.e - c.s, -c.s)"

    def chosen(i: int, kind: int) -> Column:
        lost = ["false"]
        for j, (_, other, _) in enumerate(GENERATORS):
            if other == kind and j != i:
                first = _below(f"_k{j}", "e", "c.s + 1")
                met = f"slice(_k{j}, {first} + 1, greatest({_below(f'_k{j}', 's', 'c.e')} - {first}, 0))"
                lost.append(f"exists({met}, d -> {better})")
        return F.expr(f"transform(filter(_k{i}, c -> NOT ({' OR '.join(lost)})), "
                      "c -> struct(c.s AS s, c.kind AS kind, c.e AS e))")

    picked = [chosen(i, kind) for i, (_, kind, _) in enumerate(GENERATORS)]
    return df.select(*keep, F.sort_array("base").alias("base"),
                     F.sort_array(F.array_distinct(F.concat("base", *picked))).alias("spans"))


def with_spans(docs: DataFrame, model: Trees, text: str = "text") -> DataFrame:
    """Adds ``base`` and ``spans`` to every row: arrays of (s, kind, e) in order.

    ``spans`` holds the base spans, and the candidates at or above their kind's
    threshold that pass their check and overlap no base span; of two of a kind
    that overlap, the likelier (then the longer, then the earlier).
    """
    names = list(docs.columns)
    df = docs.select(*names, F.coalesce(F.col(text), F.lit("")).alias("_text"))
    return judged(with_candidates(df, "_text"), model, names)


def span_text(spans: str) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(
        ":", F.element_at(names, x["kind"] + 1), x["s"].cast("string"), x["e"].cast("string"))), ",")


def count_kind(spans: str, kind: int) -> Column:
    return F.size(F.filter(spans, lambda x: x["kind"] == kind)).cast("long")


def find(docs: DataFrame, precision: float = 0.95) -> DataFrame:
    """Train on ``docs`` and give ``doc_id, base, spans`` of every row.

    Null and empty texts have no spans; repeated rows get the same ones; an
    empty table gives no rows; only ``doc_id`` and ``text`` are read. Texts are
    searched once: their candidates are written below the shared folder, and
    both learning and judging read them there.
    """
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("_t"))
    found = stage(with_candidates(texts, "_t").select("doc_id", _held("_t").alias("held"), "base", "cands"), "pii")
    return judged(found, learn(found, precision), ["doc_id"])


def redact(docs: DataFrame, model: Trees, text: str = "text") -> DataFrame:
    """``docs`` with every span of its text replaced by its kind's tag; spans
    that overlap become one, with the tag of the first.

    Spans of a kind lie apart, so how far the spans before one reach is the
    farthest end of the last one of each kind; where that is not beyond its
    start, a new piece begins.
    """
    names = list(docs.columns)
    df = with_spans(docs, model, text)
    tags = F.array(*[F.lit(t) for t in TAGS])
    kinds = [f"_r{k}" for k in range(len(KINDS))]
    df = df.select(*names, "spans", *[_where("spans", "kind", k).alias(c) for k, c in enumerate(kinds)])

    ends = ", ".join(f"get({c}, {_below(c, 's', f'x.s + int(x.kind > {k})')} - 1).e" for k, c in enumerate(kinds))
    df = df.select(*names, *kinds, F.expr(
        f"transform(spans, x -> struct(x.s AS s, x.kind AS kind, coalesce(greatest({ends}), 0) AS reach))").alias("_m"))
    last = F.greatest(*[F.get(F.col(c), F.size(c) - 1)["e"] for c in kinds])
    df = df.select(*names, F.filter("_m", lambda x: x["s"] >= x["reach"]).alias("_m"), last.alias("_last"))
    # What a piece's successor is reached by is where the piece ends.
    pieces = F.transform("_m", lambda x, i: F.concat(
        F.substring(text, F.when(i == 0, 0).otherwise(x["reach"]) + 1, x["s"] - F.when(i == 0, 0).otherwise(x["reach"])),
        F.element_at(tags, x["kind"] + 1)))
    rest = F.substring(text, F.col("_last") + 1, F.length(text))
    out = F.when(F.size("_m") > 0, F.concat(F.array_join(pieces, ""), rest)).otherwise(F.col(text))
    return df.select(*[out.alias(c) if c == text else F.col(c) for c in names])
