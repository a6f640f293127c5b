"""Offline replies (F17, F18): deterministic problem and component values
built from literals and native ``concat``; no Python runs per row.

Prose is our own; values that feed scoring or the index (constraint bounds,
complexity strings, the mock-path defaults) are fixed values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Mock-path defaults for missing metadata.
MOCK_DEFAULTS = {"topic": "Sliding Window", "concept": "Variable Window", "difficulty": "Medium",
                 "tags": ["Array"], "learning_objective": "Optimize range analysis"}
# Mock constraints and editorial complexities (they drive scoring and terms).
MOCK_CONSTRAINTS = ["1 <= N <= 10^5", "1 <= coordinates[i] <= 1000"]
MOCK_TIME = "Brute Force: O(N^2), Optimal: O(N)"
MOCK_SPACE = "Brute Force: O(1), Optimal: O(K) where K is the alphabet size or window element range."

# An exercise of our own: how many different marks a ferry passes.
TITLE_FMT = "Ferry Log: %s"
STATEMENT_FMT = ("A ferry notes the number of each buoy it passes, N notes in all, some buoys many times. "
                 "How many different buoys did it meet? Practises %s; level %s.")
INPUT_FORMAT = "N on a line of its own, then the N notes on the next."
OUTPUT_FORMAT = "The number of different buoys."
EXAMPLE = ("6\n8 3 8 8 5 3", "3", "The notes name the buoys 3, 5 and 8.")


def _log(n: int, buoys: int) -> tuple[str, str]:
    """A log of ``n`` notes over at most ``buoys`` buoys, and its answer."""
    notes = [1 + i * i % buoys for i in range(n)]
    return f"{n}\n{' '.join(map(str, notes))}", str(len(set(notes)))


# Three public cases, ten hidden ones of these kinds.
PUBLIC_CASES = [_log(n, 5) for n in (2, 6, 9)]
HIDDEN_CASES = [(*_log(n, n + 2), "edge" if n < 3 else "random" if n < 40 else "large")
                for n in (1, 2, 4, 7, 11, 16, 29, 46, 75, 120)]
HINTS = ["Would sorting the notes bring equal ones together?",
         "Which collection ignores what it already holds?",
         "One note can only raise the answer by one: by when?"]
EDITORIAL = {
    "brute_force": "Compare each note with all earlier notes; count it if none of them is the same.",
    "optimal": "Put every note into a hash set while reading; the answer is the size of the set.",
    "time_complexity": MOCK_TIME,
    "space_complexity": MOCK_SPACE,
    "common_mistakes": ["Counting N itself as a note.", "Comparing notes as text, so that 07 and 7 differ.",
                        "Reading only the first line."],
}
STARTER = {
    "python": "def solve(n: int, values: list[int]) -> int:\n    # your code here\n    return 0\n",
    "java": "public class Solution {\n    public static int solve(int n, int[] values) {\n        return 0;\n    }\n}\n",
    "c": "int solve(int n, int values[]) {\n    return 0;\n}\n",
    "cpp": "#include <vector>\nint solve(int n, std::vector<int>& values) {\n    return 0;\n}\n",
    "javascript": "function solve(n, values) {\n    return 0;\n}\n",
}

CASE_T = "struct<input:string,output:string>"
HIDDEN_T = "struct<input:string,output:string,type:string>"


def _arr(values) -> Column:
    return F.array(*[F.lit(v) for v in values])


def _cases() -> Column:
    pub = F.array(*[F.struct(F.lit(i).alias("input"), F.lit(o).alias("output")) for i, o in PUBLIC_CASES])
    hid = F.array(*[F.struct(F.lit(i).alias("input"), F.lit(o).alias("output"), F.lit(t).alias("type"))
                    for i, o, t in HIDDEN_CASES])
    return F.struct(pub.alias("public"), hid.alias("hidden"))


def mock_problem(df: DataFrame) -> DataFrame:
    """one generated problem per metadata row (mock path defaults)."""
    def g(name):
        d = MOCK_DEFAULTS[name]
        if name not in df.columns:
            return _arr(d) if isinstance(d, list) else F.lit(d)
        return F.coalesce(F.col(name), _arr(d) if isinstance(d, list) else F.lit(d))
    topic, concept, diff = g("topic"), g("concept"), g("difficulty")
    ex = F.array(F.struct(F.lit(EXAMPLE[0]).alias("input"), F.lit(EXAMPLE[1]).alias("output"),
                          F.lit(EXAMPLE[2]).alias("explanation")))
    return df.withColumns({
        "title": F.format_string(TITLE_FMT, topic),
        "statement": F.format_string(STATEMENT_FMT, concept, diff),
        "constraints": _arr(MOCK_CONSTRAINTS),
        "input_format": F.lit(INPUT_FORMAT),
        "output_format": F.lit(OUTPUT_FORMAT),
        "examples": ex,
        "topic": topic, "concept": concept, "difficulty": diff, "tags": g("tags"),
        "learning_objective": g("learning_objective"),
    })


def mock_components(df: DataFrame) -> DataFrame:
    """constant starter code, test cases, editorial and hints per row."""
    ed = F.struct(*[(_arr(v) if isinstance(v, list) else F.lit(v)).alias(k) for k, v in EDITORIAL.items()])
    starter = F.create_map(*[x for k, v in STARTER.items() for x in (F.lit(k), F.lit(v))])
    return df.withColumns({
        "starter_code": starter,
        "test_cases": _cases(),
        "editorial": ed,
        "hints": _arr(HINTS),
    })
