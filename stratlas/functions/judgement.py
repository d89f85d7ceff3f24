"""Judgements written by a model: finding the JSON in its answer and checking it."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: What a judgement scores.
DIMENSIONS = ("maintenance", "production_readiness", "specificity", "learning_value", "onboarding_ease", "canonicity")
#: Words that give a project's popularity away.
POPULARITY = frozenset("star stars stargazers fork forks watchers criticality rank pagerank trending popularity dependents".split())
THINKING = re.compile(r"<think>.*?(?:</think>|\Z)", re.S)
RESULT = ", ".join(f"{d} double" for d in DIMENSIONS) + ", summary string, flags array<string>"


def last_object(text: str) -> dict | None:
    """The last balanced ``{…}`` of an answer that is a JSON object; thinking is left out."""
    text = THINKING.sub("", text)
    found, depth, start, quoted, escaped = None, 0, 0, False, False
    for i, c in enumerate(text):
        if quoted:
            quoted, escaped = not (c == '"' and not escaped), c == "\\" and not escaped
            continue
        if c == '"' and depth:
            quoted = True
        elif c == "{":
            start = i if depth == 0 else start
            depth += 1
        elif c == "}" and depth:
            depth -= 1
            if depth == 0:
                try:
                    value = json.loads(text[start : i + 1])
                except ValueError:
                    continue
                found = value if isinstance(value, dict) else found
    return found


def parse(answer: str | None) -> dict | None:
    """All six dimensions as 0…100, a summary of up to 300 characters and up to eight flags of 40; else None."""
    value = last_object(answer or "")
    if value is None:
        return None
    out: dict = {}
    for d in DIMENSIONS:
        x = value.get(d)
        if isinstance(x, bool) or not isinstance(x, int | float) or x != x:
            return None
        out[d] = float(min(100, max(0, x)))
    out["summary"] = str(value.get("summary") or "").strip()[:300]
    flags = value.get("flags")
    out["flags"] = [str(f).strip()[:40] for f in flags if str(f).strip()][:8] if isinstance(flags, list) else []
    return out


def parsed(answer: Column) -> Column:
    """``parse`` over Arrow batches; null where there is no valid judgement."""

    @F.pandas_udf(RESULT)
    def run(s: pd.Series) -> pd.DataFrame:
        empty = dict.fromkeys([*DIMENSIONS, "summary", "flags"])
        return pd.DataFrame([parse(a) or empty for a in s], columns=[*DIMENSIONS, "summary", "flags"])

    return run(answer)


def prompt(full_name: Column, description: Column, text: Column) -> Column:
    """What the model is asked; the project's counts never stand in it."""
    return F.concat_ws("\n", F.concat(F.lit("Project: "), full_name), F.concat(F.lit("Description: "), F.coalesce(description, F.lit(""))), F.lit("Documentation:"), text)


def gives_popularity_away(names: list[str]) -> list[str]:
    """The feature names with a word of popularity in them."""
    return [n for n in names if set(n.lower().split("_")) & POPULARITY]
