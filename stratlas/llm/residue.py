"""Template residue, filler, error pages and script notices in place of content (problem 5).

One pass reads every text and masks names, numbers, addresses and dates; texts that are more than an opening sentence
and possible messages have content of their own. The masked messages of the others are grouped by exact hash over all
sources: one that recurs over several sources is classified by phrase rules or by weaker hints, one that doesn't is no
message, unless the text says it in two of the known wordings. Placeholders and filler need no group.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratlas.llm.residue_rules import HINTED, UNFILLED, WORDED, read_text
from stratlas.session import materialise, read

RECURS, HINT_RECURS, SHARE = 3, 10, 1e-5  # a message recurs in so many texts (one of weaker hints: of these), or in this share of those that may be residue
PARTS = "array<struct<body string, kind int, line int, content boolean, follows boolean>>"
ARROW_PARTS = pa.list_(pa.struct([("body", pa.string()), ("kind", pa.int32()), ("line", pa.int32()), ("content", pa.bool_()), ("follows", pa.bool_())]))
SIGNATURE = f"origin string, row_id long, source string, parts {PARTS}"


def texts_of(repo: DataFrame | None, documents: DataFrame | None, columns: tuple[str, ...] = ("clean_text", "documents")) -> DataFrame:
    """``(origin, row_id, name, source, text)`` of the named text columns; null and blank texts are left out.

    ``name`` is the project's own name, the part of ``full_name`` after the slash; rows without an id are left out.
    """
    parts = []
    for origin in columns:
        table, key, field = (documents, "doc_id", "text") if origin == "documents" else (repo, "id", origin)
        source = F.lower(F.trim("source")) if origin == "documents" else F.lower(F.trim("host"))
        parts.append(
            table.select(
                F.lit(origin).alias("origin"), F.col(key).cast("long").alias("row_id"),
                F.coalesce(F.element_at(F.split("full_name", "/"), -1), F.lit("")).alias("name"),
                F.coalesce(source, F.lit("")).alias("source"), F.col(field).cast("string").alias("text"),
            )
        )
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    return rows.where(F.col("row_id").isNotNull() & (F.length(F.trim("text")) > 0))


def signature(text: str, name: str) -> list[dict] | None:
    """The parts of a text that may be residue, None for one with content of its own."""
    parts = read_text(text, name)
    return [p._asdict() for p in parts] if parts else None


def signatures(texts: DataFrame) -> DataFrame:
    """The signature of every text that may be residue."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            origin, ids, name, source, text = (batch.column(i) for i in range(5))
            found = [signature(t, n) for t, n in zip(text.to_pylist(), name.to_pylist())]
            at = pa.array([i for i, s in enumerate(found) if s], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [origin.take(at), ids.take(at), source.take(at), pa.array([s for s in found if s], ARROW_PARTS)], names=["origin", "row_id", "source", "parts"]
            )

    return texts.select("origin", "row_id", "name", "source", "text").mapInArrow(run, SIGNATURE)


def grouped(marked: DataFrame) -> DataFrame:
    """``(key, n_rows, a, b, kind, residue, body)`` of each masked message, by exact hash over all origins and sources.

    A message is residue if it recurs over two sources (``a`` and ``b`` are the first and the last) in a ``SHARE`` of all
    texts that come here, and at least in ``RECURS`` where it is worded like a message, in ``HINT_RECURS`` where it bears a weaker hint. Counts combine on the map
    side, so a message that very many rows bear costs each task one row.
    """
    share = int(SHARE * marked.count())
    least = F.when(F.col("kind") == WORDED, F.lit(max(RECURS, share))).otherwise(F.lit(max(HINT_RECURS, share)))
    parts = marked.select("origin", "row_id", "source", F.inline("parts")).where(F.col("kind").isin(HINTED, WORDED))
    parts = parts.select("origin", "row_id", "source", "kind", "body").distinct()  # a repeated row counts once
    groups = parts.groupBy(F.unhex(F.md5("body")).alias("key")).agg(
        F.count(F.lit(1)).alias("n_rows"), F.min("source").alias("a"), F.max("source").alias("b"), F.max("kind").alias("kind"), F.min("body").alias("body")
    )
    return groups.withColumn("residue", (F.col("n_rows") >= least) & (F.col("a") != F.col("b")))


def residue_of(marked: DataFrame) -> DataFrame:
    """``(origin, row_id)`` of the signatures that are residue, each once.

    A text is residue if it has a placeholder line, filler or a message that is residue, and besides these at most one
    sentence, which opens it; short sentences after a message in its line belong to it. A message that doesn't recur
    counts where the text has another worded one or a placeholder line beside it. Parts go back to their group by the
    hash alone; adaptive execution splits a hash that very many rows share.
    """
    keys = grouped(marked).where("residue").select("key", F.lit(True).alias("recurs"))
    rows = marked.select("origin", "row_id", F.posexplode("parts").alias("i", "p")).select("origin", "row_id", "i", "p.*")
    rows = rows.withColumn("key", F.when(F.col("kind").isin(HINTED, WORDED), F.unhex(F.md5("body"))))
    alone = F.col("key").isNull()
    known = rows.where(~alone).join(keys, "key", "left").unionByName(rows.where(alone).withColumn("recurs", F.lit(None).cast("boolean")))
    sure = (F.col("kind") >= UNFILLED) | F.coalesce("recurs", F.lit(False))
    part = F.struct("i", "line", sure.alias("sure"), (F.col("kind") == WORDED).alias("worded"), "content", "follows")
    said = F.when(F.col("kind") == WORDED, F.col("body"))
    two = F.coalesce(F.min(said) != F.max(said), F.lit(False)) | F.max(F.col("kind") == UNFILLED)  # an aggregate, for else it is worked out anew for each part
    texts = known.groupBy("origin", "row_id").agg(F.array_sort(F.collect_set(part)).alias("parts"), two.alias("two"))  # the parts of one text
    fold = """aggregate(parts, named_struct('r', 0, 'c', 0, 'late', 0, 'line', -1), (a, x) ->
        if(x.sure or (two and x.worded), named_struct('r', a.r + 1, 'c', a.c, 'late', a.late, 'line', x.line),
        if(not x.content or (x.follows and a.line = x.line), a, named_struct('r', a.r, 'c', a.c + 1, 'late', if(a.r > 0, 1, a.late), 'line', a.line))),
        f -> f.r > 0 and (f.c = 0 or (f.c = 1 and f.late = 0)))"""
    return texts.where(F.expr(fold)).select("origin", "row_id")


def residue_groups(marked: DataFrame) -> DataFrame:
    """``(body, n_rows, several_sources, residue)``: what recurs, how widely, and the verdict."""
    return grouped(marked).select("body", "n_rows", (F.col("a") != F.col("b")).alias("several_sources"), "residue")


def found(spark: SparkSession, sf: str) -> DataFrame:
    """``(origin, row_id)`` of ``clean_text`` and document texts that are residue."""
    marked = signatures(texts_of(read(spark, sf, "repo"), read(spark, sf, "documents")))
    return residue_of(materialise(marked, "residue-signatures"))  # few rows, used three times


def kept(texts: DataFrame) -> DataFrame:
    """The texts without those that are residue."""
    waste = residue_of(materialise(signatures(texts), "residue-signatures"))
    return texts.join(waste, ["origin", "row_id"], "left_anti")
