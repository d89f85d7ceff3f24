"""The Python functions under SQL names."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from stratlas.functions import judgement, text


def register(spark: SparkSession) -> list[str]:
    """Register ``clean_readme``, ``parse_judgement``, ``heading_key`` and the table function ``pairs``."""

    @F.pandas_udf(text.CLEANED)
    def clean_readme(raw: pd.Series, description: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([text.clean_readme(r, d) for r, d in zip(raw, description)], columns=text.Cleaned._fields)

    @F.pandas_udf(judgement.RESULT)
    def parse_judgement(answer: pd.Series) -> pd.DataFrame:
        empty = dict.fromkeys([*judgement.DIMENSIONS, "summary", "flags"])
        return pd.DataFrame([judgement.parse(a) or empty for a in answer], columns=[*judgement.DIMENSIONS, "summary", "flags"])

    @F.pandas_udf("string")
    def heading_key(title: pd.Series) -> pd.Series:
        return title.map(lambda t: None if t is None else text.heading_key(t))

    @F.udtf(returnType="a string, b string")
    class Pairs:
        def eval(self, basket: list):
            items = sorted({x for x in basket or [] if x is not None})
            for i, a in enumerate(items):
                for b in items[i + 1 :]:
                    yield a, b

    for name, f in (("clean_readme", clean_readme), ("parse_judgement", parse_judgement), ("heading_key", heading_key)):
        spark.udf.register(name, f)
    spark.udtf.register("pairs", Pairs)
    return ["clean_readme", "parse_judgement", "heading_key", "pairs"]
