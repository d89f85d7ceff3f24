"""Hybrid search: full text, exact names and vectors, fused by reciprocal ranks."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

#: Words too common to search for.
STOP_WORDS = tuple("a an and are as at be but by for from has have if in into is it its not of on or such that the their then there these they this to was we were will with you your".split())

def query_terms(text: str) -> list[str]:
    """The distinct terms of a query: letters and digits, lower case, stemmed, without stop words."""
    words = re.sub(r"[^\w\s]|_", " ", text.lower()).split()
    return list(dict.fromkeys(stem_word(w) for w in words if w not in STOP_WORDS))


def stem_word(word: str) -> str:
    """A light English stem: plural, past and -ing endings. Longer endings stay: it is an approximation."""
    if len(word) > 4 and word.endswith("ies"):
        word = word[:-3] + "y"
    elif len(word) > 3 and word.endswith("s") and word[-2] not in "su":
        word = word[:-1]
    if len(word) > 5 and word.endswith("ing"):
        word = word[:-3]
    elif len(word) > 4 and word.endswith("ed"):
        word = word[:-2]
    return word


def stems(words: Column) -> Column:
    """``stem_word`` over an array of words, in the JVM."""

    first = F.transform(words, lambda w: F.when((F.length(w) > 4) & w.endswith("ies"), F.concat(F.substring(w, F.lit(1), F.length(w) - 3), F.lit("y"))).when((F.length(w) > 3) & w.endswith("s") & ~F.substring(w, F.length(w) - 1, F.lit(1)).isin("s", "u"), F.substring(w, F.lit(1), F.length(w) - 1)).otherwise(w))
    return F.transform(first, lambda w: F.when((F.length(w) > 5) & w.endswith("ing"), F.substring(w, F.lit(1), F.length(w) - 3)).when((F.length(w) > 4) & w.endswith("ed"), F.substring(w, F.lit(1), F.length(w) - 2)).otherwise(w))


def terms(*columns: Column) -> Column:
    """The stemmed terms of texts, in their order."""
    text = F.lower(F.concat_ws(" ", *columns))
    words = F.filter(F.split(F.regexp_replace(text, r"[^\p{L}\p{N}\s]", " "), r"\s+"), lambda w: (w != "") & ~w.isin(*STOP_WORDS))
    return stems(words)


def equals(word: str):
    return lambda x: x == F.lit(word)


def lexical(rows: DataFrame, query: str, k: int, id_col: str = "id") -> DataFrame:
    """``(id, score, r)`` of rows with any of the query's terms.

    Each term adds the sum of 1/i² over its occurrences, over π²/6 and the number of terms; ties go to more stars, then
    the smaller id. Rows need ``full_name``, ``description`` and ``stars``.
    """
    wanted = query_terms(query)
    if not wanted:
        return rows.select(F.col(id_col).alias("id"), F.lit(0.0).alias("score"), F.lit(0).alias("r")).where("false")
    found = rows.withColumn("__t", terms(F.regexp_replace("full_name", "/", " "), F.col("description"))).where(F.arrays_overlap("__t", F.array(*map(F.lit, wanted))))
    hits = [F.size(F.filter("__t", equals(w))) for w in wanted]
    parts = [F.aggregate(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), F.lit(0.0), lambda s, i: s + 1 / (i * i)) * F.when(n > 0, 1).otherwise(0) for n in hits]
    score = reduce(lambda a, b: a + b, parts) / 1.64493406685 / len(wanted)
    top = found.select(F.col(id_col).alias("id"), F.round(score, 9).alias("score"), F.coalesce("stars", F.lit(0)).alias("stars")).orderBy(F.desc("score"), F.desc("stars"), "id").limit(k)
    return top.withColumn("r", F.row_number().over(W.orderBy(F.desc("score"), F.desc("stars"), "id"))).select("id", "score", "r")


def exact_name(rows: DataFrame, query: str, k: int, id_col: str = "id") -> DataFrame:
    """``(id, score, r)`` of rows whose name or full name is the query, in any case; queries of several words find none."""
    q = query.strip().lower()
    hit = F.lit(bool(q) and len(q.split()) == 1) & ((F.lower(F.split_part("full_name", F.lit("/"), F.lit(2))) == q) | (F.lower("full_name") == q))
    top = rows.where(hit).select(F.col(id_col).alias("id"), F.coalesce("stars", F.lit(0)).alias("stars")).orderBy(F.desc("stars"), "id").limit(k)
    return top.withColumn("r", F.row_number().over(W.orderBy(F.desc("stars"), "id"))).select("id", F.lit(1.0).alias("score"), "r")


def reranked(dense: DataFrame, stars: DataFrame, alpha: float = 0.10) -> DataFrame:
    """``(id, score, r)``: cosine plus ``alpha``·log10(1 + stars). The arm holds its top k only."""
    rows = dense.join(stars.select("id", F.coalesce("stars", F.lit(0)).alias("stars")), "id")
    rows = rows.withColumn("score", F.round(F.col("score") + alpha * F.log10(1 + F.col("stars")), 9))
    return rows.withColumn("r", F.row_number().over(W.orderBy(F.desc("score"), "id"))).select("id", "score", "r")


def fuse(arms: list[tuple[DataFrame, float]], k: int = 60) -> DataFrame:
    """``(id, score)``: Σ weight / (k + position) over the arms; ties go to the smaller id. Arms are top-k lists."""
    parts = [arm.select("id", (F.lit(float(w)) / (k + F.col("r"))).alias("s")) for arm, w in arms]
    rows = reduce(lambda a, b: a.unionByName(b), parts)
    return rows.groupBy("id").agg(F.round(F.sum("s"), 12).alias("score"))


def hybrid(rows: DataFrame, query: str, dense: DataFrame | None, k: int = 50, allowed: DataFrame | None = None) -> DataFrame:
    """``(id, score)`` of the ``k`` best over the dense (weight 2), exact-name (2) and full-text (1) arms.

    ``dense`` is a top-k of ``(id, score)``, or None where no vectors are at hand; ``allowed`` restricts the result. Queries
    under two characters raise.
    """
    if len(query.strip()) < 2:
        raise ValueError("a query needs two characters")
    arms = [(exact_name(rows, query, 100), 2.0), (lexical(rows, query, 100), 1.0)]
    if dense is not None:
        arms.insert(0, (reranked(dense, rows.select("id", "stars")), 2.0))
    fused = fuse(arms)
    if allowed is not None:
        fused = fused.join(allowed.select("id"), "id", "left_semi")
    return fused.orderBy(F.desc("score"), "id").limit(k)
