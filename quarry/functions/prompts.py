"""Prompt templates (S9) and one-pass rendering.

A template is split once on the driver into literal parts and ``{slot}``
parts (``{{``/``}}`` are literal braces); rendering is a single native
``concat`` so slot text that itself contains ``{x}`` is never re-expanded.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Own wording. Slots per template follow the record model.
TEMPLATES = {
    "problem": (
        "You write original programming exercises for a course.\n"
        "Design one new exercise for this syllabus entry.\n"
        "Topic: {topic}\nLevel: {difficulty}\nTags: {tags}\nIdea: {concept}\n"
        "Reply with a single JSON object and nothing else, shaped like\n"
        '{{"title": "...", "statement": "...", "constraints": ["..."], '
        '"input_format": "...", "output_format": "...", '
        '"examples": [{{"input": "...", "output": "...", "explanation": "..."}}]}}\n'),
    "testcase": (
        "Write test data for the exercise below.\n"
        "Title: {title}\nTask: {statement}\nLimits: {constraints}\n"
        "Input: {input_format}\nOutput: {output_format}\n"
        'Reply with JSON only: {{"public": [{{"input": "...", "output": "..."}}], '
        '"hidden": [{{"input": "...", "output": "...", "type": "edge|random|large"}}]}}\n'),
    "hints": (
        "Give three hints, each more revealing than the last, for this exercise.\n"
        "Title: {title}\nTask: {statement}\nLimits: {constraints}\n"
        'Reply with JSON only: {{"hints": ["...", "...", "..."]}}\n'),
    "editorial": (
        "Explain how to solve the exercise below.\n"
        "Title: {title}\nTask: {statement}\nLimits: {constraints}\n"
        'Reply with JSON only: {{"brute_force": "...", "optimal": "...", "time_complexity": "...", '
        '"space_complexity": "...", "common_mistakes": ["..."]}}\n'),
    "starter": (
        "Write empty solution stubs for the exercise below.\n"
        "Title: {title}\nTask: {statement}\nInput: {input_format}\nOutput: {output_format}\n"
        "Limits: {constraints}\n"
        'Reply with JSON only: {{"python": "...", "java": "...", "c": "...", "cpp": "...", '
        '"javascript": "..."}}\n'),
}

# Defaults of the problem prompt for missing metadata.
PROBLEM_DEFAULTS = {"topic": "Coding", "difficulty": "Medium", "concept": "General"}
LIST_SLOTS = {"tags", "constraints"}


def template_parts(template: str) -> list[tuple[str, str | None]]:
    """[(literal, slot or None)] in order; braces already unescaped."""
    out = []
    for lit, field, _spec, _conv in string.Formatter().parse(template):
        out.append((lit, field))
    return out


def slot_value(df_cols, name: str, defaults: dict | None = None) -> Column:
    defaults = defaults or {}
    d = defaults.get(name, "")
    if name not in df_cols:
        return F.lit(d)
    c = F.col(name)
    if name in LIST_SLOTS:
        return F.array_join(F.coalesce(c, F.array().cast("array<string>")), ", ")
    return F.coalesce(c.cast("string"), F.lit(d))


def render(df: DataFrame, template: str, defaults: dict | None = None) -> Column:
    parts = []
    for lit, field in template_parts(template):
        if lit:
            parts.append(F.lit(lit))
        if field is not None:
            parts.append(slot_value(df.columns, field, defaults))
    return F.concat(*parts) if parts else F.lit("")


def render_prompts(df: DataFrame, names=None) -> DataFrame:
    """Add one ``prompt_<name>`` column per template."""
    names = names or list(TEMPLATES)
    cols = {f"prompt_{n}": render(df, TEMPLATES[n], PROBLEM_DEFAULTS if n == "problem" else None)
            for n in names}
    return df.withColumns(cols)


def templates_table(spark: SparkSession) -> DataFrame:
    """The templates as data ``(name, text)``."""
    return spark.createDataFrame(list(TEMPLATES.items()), "name string, text string")
