"""Long exact spans shared between records (problem 10).

Candidate passages come from winnowing: of every ``MIN`` characters at least one ``PHRASE``-character passage is
chosen by its content alone, so two records that share a span of ``MIN`` characters have chosen a common passage.
Passages that recur in different texts are confirmed by their characters and compiled into sharded Aho-Corasick
automata, and the stretches of all records around recurring passages, ``SIDE`` characters either side, are streamed through
to locate every occurrence; each pair of occurrences is then extended character by character. A whole text is read where it
lies and shuffled once at most, to cut its stretches.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratlas.session import materialise

MIN, PHRASE = 200, 100
SIDE = MIN - PHRASE  # characters of context that decide whether an occurrence belongs to a span
SHARD_PHRASES, SHARD_ROWS, BLOCK = 10_000, 50_000, 1_000
BASE = 0x9E3779B97F4A7C15


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE^i and BASE^-i modulo 2^64."""
    up, down = np.full(n, BASE, np.uint64), np.full(n, pow(BASE, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up), np.cumprod(down)


def sliding(values: np.ndarray, width: int, pick) -> np.ndarray:
    """Minimum or maximum of every ``width`` neighbours, by doubling."""
    have, out = 1, values
    while have * 2 <= width:
        out = pick(out[:-have], out[have:])
        have *= 2
    return pick(out[: len(out) - (width - have)], out[width - have :]) if have < width else out


class Winnower:
    """Chosen passages of many texts at once, over one array of their code points."""

    def __init__(self, least: int = MIN, phrase: int = PHRASE):
        self.least, self.phrase, self.window = least, phrase, least - phrase + 1
        self.up, self.down = powers(1 << 16)

    def chosen(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``(text number, hash, position)`` of the chosen passages of each text, wherever they were chosen."""
        codes = [np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32) for t in texts]
        sizes = np.array([len(c) for c in codes], np.int64)
        flat = np.concatenate(codes).astype(np.uint64) + np.uint64(1)
        n, k, w = len(flat), self.phrase, self.window
        none = np.empty(0, np.int64)
        if n < self.least:
            return none, none, none
        if n >= len(self.up):
            self.up, self.down = powers(2 * n)
        sums = np.r_[np.uint64(0), np.cumsum(flat * self.up[:n])]
        value = (sums[k:] - sums[:-k]) * self.down[: n - k + 1]
        value ^= value >> np.uint64(32)
        value *= np.uint64(0xD6E8FEB86659FD93)
        value ^= value >> np.uint64(32)
        value[value == 0] = 1  # 0 stands for windows that choose nothing
        ends = np.cumsum(sizes)
        left = np.repeat(ends, sizes) - np.arange(n)  # characters from here to the text's end
        lows = sliding(value, w, np.minimum)
        lows[left[: len(lows)] < self.least] = 0  # windows that leave their text choose nothing
        inside = left[: len(value)] >= k
        padded = np.concatenate([np.zeros(w - 1, np.uint64), lows, np.zeros(w - 1, np.uint64)])
        tops = sliding(padded, w, np.maximum)
        at = np.flatnonzero((tops == value) & (value != 0) & inside)
        text = np.searchsorted(ends, at, side="right")
        return text, value[at].view(np.int64), at - (ends - sizes)[text]


def passages(docs: DataFrame) -> DataFrame:
    """``(hash, doc_id, pos)`` of the chosen passages of every text of at least ``MIN`` characters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        winnow = Winnower()
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            size, start, rows = 0, 0, texts.to_pylist()
            for end in range(1, len(rows) + 1):
                size += len(rows[end - 1])
                if size > 300_000 or end == len(rows):
                    number, value, pos = winnow.chosen(rows[start:end])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(value, pa.int64()), ids.take(pa.array(number + start, pa.int64())), pa.array(pos, pa.int32())],
                        names=["hash", "doc_id", "pos"],
                    )
                    size, start = 0, end

    return docs.mapInArrow(run, "hash long, doc_id long, pos int")


def long_texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(doc_id, text)`` of records with an id and at least ``MIN`` characters; shorter ones share no such span."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.where(F.col("doc_id").isNotNull() & (F.length("text") >= MIN))


def copies(texts: DataFrame) -> DataFrame:
    """``(doc_id, rep, copied)``: each record with the smallest id of the records whose whole text is the same.

    A repeated id has the text of smallest hash, here and below.
    """
    keys = texts.groupBy("doc_id").agg(F.min(F.unhex(F.md5("text"))).alias("key"))
    reps = keys.groupBy("key").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("n"))
    alone = reps.where("n = 1").select(F.col("rep").alias("doc_id"), "rep", F.lit(False).alias("copied"))
    many = keys.join(reps.where("n > 1"), "key").select("doc_id", "rep", F.lit(True).alias("copied"))
    return alone.unionByName(many)


def candidates(texts: DataFrame, members: DataFrame) -> DataFrame:
    """``(owner, doc_id, start, stretch, size)``: what surrounds each passage that other records chose too, in one text of each kind.

    ``owner`` is a record that all which chose a passage know, ``size`` the text's length. Stretches that overlap and
    have one owner are not merged here, but where they meet again.
    """
    chosen = materialise(passages(texts), "span-passages")
    seen = chosen.groupBy("hash").agg(F.min("doc_id").alias("owner"), F.max("doc_id").alias("last"))
    again = chosen.join(seen.where("owner <> last").select("hash", "owner"), "hash")
    again = again.join(members.select(F.col("rep").alias("doc_id")).distinct(), "doc_id", "left_semi")
    lists = again.groupBy("doc_id").agg(F.collect_set(F.struct("pos", "owner")).alias("at"))  # at most a text's length
    lists = materialise(lists, "span-lists")
    # only the texts that are cut are shuffled, and none where the list of their ids is small enough to travel
    one = texts.join(lists.select("doc_id"), "doc_id", "left_semi").groupBy("doc_id").agg(F.min_by("text", F.unhex(F.md5("text"))).alias("text"))
    start = F.greatest(F.col("p.pos") - SIDE, F.lit(0))
    cut = one.join(lists, "doc_id").select("doc_id", "text", F.length("text").alias("size"), F.explode("at").alias("p"))
    cut = cut.where(F.col("p.pos") + PHRASE <= F.col("size"))
    cut = cut.select("p.owner", "doc_id", "p.pos", start.alias("start"), F.substring("text", start + 1, F.col("p.pos") + PHRASE + SIDE - start).alias("stretch"), "size")
    return materialise(cut, "span-candidates")


def occurrences(held: DataFrame) -> DataFrame:
    """``(phrase_id, doc_id, pos, left, right, more)``: every occurrence of the confirmed passages, with ``SIDE`` characters of either side.

    A passage is confirmed when its very characters were chosen in two records. Automata hold at most about
    ``SHARD_PHRASES`` passages; a stretch goes through the automaton of the passage it was cut for, and a shard that
    has more than ``SHARD_ROWS`` stretches is run in as many slices. Occurrences of a passage in one record whose
    surroundings agree are one row, at their first place, with the further places in ``more``.
    """
    phrase = F.substring("stretch", F.col("pos") - F.col("start") + 1, F.lit(PHRASE))
    confirmed = held.groupBy(phrase.alias("phrase")).agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b"), F.min("owner").alias("owner")).where("a <> b")
    confirmed = materialise(confirmed.select("phrase", "owner"), "span-phrases")
    shards = max(1, math.ceil(confirmed.count() / SHARD_PHRASES))
    shard = F.pmod(F.xxhash64("owner"), F.lit(shards)).cast("int")
    rows = held.withColumn("shard", shard)
    large = materialise(rows.groupBy("shard").agg(F.ceil(F.count(F.lit(1)) / SHARD_ROWS).cast("int").alias("slices")).where("slices > 1"), "span-shards")
    if large.count() <= 100_000:  # two numbers each; a table of more is joined like any other
        large = F.broadcast(large)
    slices = F.coalesce("slices", F.lit(1))
    phrases = confirmed.withColumn("shard", shard).join(large, "shard", "left")
    phrases = phrases.select("shard", "phrase", F.explode(F.sequence(F.lit(0), slices - 1)).alias("slice"))
    docs = rows.join(large, "shard", "left").select("shard", F.pmod(F.xxhash64("doc_id"), slices).cast("int").alias("slice"), "doc_id", "start", "stretch", "size")

    def locate(phrases: pd.DataFrame, docs: pd.DataFrame) -> pd.DataFrame:
        import ahocorasick

        machine = ahocorasick.Automaton()
        for phrase in phrases["phrase"]:
            machine.add_word(phrase, phrase)
        rows = []
        if len(machine) and len(docs):
            machine.make_automaton()
            docs = docs.sort_values(["doc_id", "start"], kind="stable")
            doc, seen = None, {}
            for one, start, text, size in merged(zip(docs["doc_id"], docs["start"], docs["stretch"], docs["size"])):
                if one != doc:
                    doc, seen = one, {}
                last = start + len(text) == size
                for end, phrase in machine.iter(text):
                    at = end - PHRASE + 1
                    if (at < SIDE and start) or (len(text) - end - 1 < SIDE and not last):
                        continue  # not all that decides lies in this stretch: if it was chosen, another has it whole
                    row = (phrase, text[max(0, at - SIDE) : at], text[end + 1 : end + 1 + SIDE])
                    if row in seen:
                        seen[row].append(start + at)
                    else:
                        seen[row] = []
                        rows.append((phrase, doc, start + at, row[1], row[2], seen[row]))
        return pd.DataFrame(rows, columns=["phrase", "doc_id", "pos", "left", "right", "more"]).astype({"doc_id": "int64", "pos": "int32"})

    found = phrases.groupBy("shard", "slice").cogroup(docs.groupBy("shard", "slice")).applyInPandas(
        locate, "phrase string, doc_id long, pos int, left string, right string, more array<int>"
    )
    found = found.select(F.unhex(F.md5("phrase")).alias("phrase_id"), "doc_id", "pos", "left", "right", "more")
    return materialise(found, "span-occurrences")


def merged(rows: Iterator[tuple]) -> Iterator[tuple]:
    """``(doc, start, text, size)`` rows, sorted, with the overlapping stretches of a record made one."""
    doc = start = text = size = None
    for one, begin, stretch, length in rows:
        if one == doc and begin <= start + len(text):
            text += stretch[start + len(text) - begin :]
        else:
            if text is not None:
                yield doc, start, text, size
            doc, start, text, size = one, begin, stretch, length
    if text is not None:
        yield doc, start, text, size


def common_end(a: str, b: str) -> int:
    return common_start(a[::-1], b[::-1])


def common_start(a: str, b: str) -> int:
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    lo, hi = 0, n  # a[:lo] agrees, a[:hi] doesn't
    while hi - lo > 1:
        mid = (lo + hi) // 2
        lo, hi = (mid, hi) if a[lo:mid] == b[lo:mid] else (lo, mid)
    return lo


def matches(found: DataFrame) -> DataFrame:
    """``(doc_a, doc_b, pos_a, pos_b, before, after)`` of occurrences whose agreement reaches ``MIN`` characters.

    A passage with very many occurrences is split into blocks of about ``BLOCK``, and each pair of blocks is a group
    of its own. ``before`` and ``after`` are the agreeing characters either side of the passage, at most
    ``MIN - PHRASE``; the passages chosen along a longer span cover it.
    """
    counts = found.groupBy("phrase_id").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    rows = found.join(counts, "phrase_id").withColumn("own", F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("phrase_id", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "doc_id", "pos", "left", "right")
    keys = ["phrase_id", "i", "j"]
    rows = rows.repartition(*keys).sortWithinPartitions(*keys)
    names = ["doc_a", "doc_b", "pos_a", "pos_b", "before", "after"]

    def compare(group: list[tuple], out: list[tuple]) -> None:
        apart = group[0][1] != group[0][2]  # of two blocks: those of one block meet elsewhere
        alike: dict[tuple[str, str], list[tuple[int, int, int]]] = {}
        for _, _, _, own, doc, pos, left, right in group:
            alike.setdefault((left, right), []).append((own, doc, pos))
        kinds = list(alike)  # surroundings that agree are compared once, however many occurrences have them
        for x, (left_x, right_x) in enumerate(kinds):
            for y in range(x, len(kinds)):
                left_y, right_y = kinds[y]
                before, after = (len(left_x), len(right_x)) if x == y else (common_end(left_x, left_y), common_start(right_x, right_y))
                if before + PHRASE + after < MIN:
                    continue
                some, others = alike[kinds[x]], alike[kinds[y]]
                for n, (own_x, doc_x, pos_x) in enumerate(some):
                    for own_y, doc_y, pos_y in others[n + 1 :] if x == y else others:
                        if doc_x == doc_y or (apart and own_x == own_y):
                            continue
                        if (doc_x, pos_x) < (doc_y, pos_y):
                            out.append((doc_x, doc_y, pos_x, pos_y, before, after))
                        else:
                            out.append((doc_y, doc_x, pos_y, pos_x, before, after))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group: list[tuple] = []
        out: list[tuple] = []

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            kinds = [pa.int64(), pa.int64()] + [pa.int32()] * 4
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

        for batch in batches:
            for row in zip(*[batch.column(c).to_pylist() for c in range(batch.num_columns)]):
                if group and group[0][:3] != row[:3]:
                    compare(group, out)
                    group = []
                    if len(out) > 20_000:
                        yield batch_of(out)
                        out.clear()
                group.append(row)
        if group:
            compare(group, out)
        if out:
            yield batch_of(out)

    return rows.mapInArrow(run, "doc_a long, doc_b long, pos_a int, pos_b int, before int, after int")


def shared_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """``members`` (``doc_id, rep, copied``) and ``links`` between representatives with the places of their spans.

    A link also has the further places of its passages in both records, ``more_a`` and ``more_b``, null where there is none.
    """
    texts = long_texts(docs, id_col, text_col)
    members = materialise(copies(texts), "span-members")
    found = occurrences(candidates(texts, members))
    links = materialise(matches(found), "span-links")
    again = found.where(F.size("more") > 0)
    for side in "ab":
        places = again.select(F.col("doc_id").alias(f"doc_{side}"), F.col("pos").alias(f"pos_{side}"), F.col("more").alias(f"more_{side}"))
        links = links.join(places, [f"doc_{side}", f"pos_{side}"], "left")  # a place of a record has one passage
    return members, links


def span_pairs(members: DataFrame, links: DataFrame) -> DataFrame:
    """``(doc_a, doc_b)``, the smaller id first, once for each two records that share a span of ``MIN`` characters."""
    reps = links.select("doc_a", "doc_b").distinct()
    a = members.select(F.col("rep").alias("doc_a"), F.col("doc_id").alias("a"))
    b = members.select(F.col("rep").alias("doc_b"), F.col("doc_id").alias("b"))
    between = reps.join(a, "doc_a").join(b, "doc_b").select("a", "b")
    same = members.where("copied").select("rep", F.col("doc_id").alias("a"))
    within = same.join(same.withColumnRenamed("a", "b"), "rep").where("a < b").select("a", "b")
    both = between.unionByName(within)
    return both.select(F.least("a", "b").alias("doc_a"), F.greatest("a", "b").alias("doc_b")).where("doc_a <> doc_b").distinct()


def shared_report(docs: DataFrame, members: DataFrame, links: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_chars, shared_chars, share, n_links, copies_of)``: how much of each record stands elsewhere too.

    ``n_links`` counts the different texts it shares spans with, ``copies_of`` is the class of whole-text copies.
    Every record with an id has a row; texts under ``MIN`` characters, null ones among them, share nothing.
    """
    ends = [("a", "b"), ("b", "a")]
    sides = [links.select(F.col(f"doc_{d}").alias("rep"), F.col(f"doc_{o}").alias("other"), F.col(f"pos_{d}").alias("pos"), F.col(f"more_{d}").alias("more"), "before", "after") for d, o in ends]
    sides = sides[0].unionByName(sides[1])
    counts = sides.groupBy("rep").agg(F.count_distinct("other").alias("n_links"))
    spans = sides.groupBy("rep", "pos").agg(F.max("before").alias("before"), F.max("after").alias("after"), F.first("more").alias("more"))  # at most one span per place of a text from here on
    places = F.explode(F.concat(F.array("pos"), F.coalesce("more", F.array().cast("array<int>"))))
    spans = spans.select("rep", "before", "after", places.alias("pos")).select("rep", (F.col("pos") - F.col("before")).alias("s"), (F.col("pos") + PHRASE + F.col("after")).alias("e"))
    ordered = spans.groupBy("rep").agg(F.array_sort(F.collect_list(F.struct("s", "e"))).alias("spans"))
    merged = F.aggregate(
        "spans",
        F.struct(F.lit(0).alias("n"), F.lit(0).alias("to")),
        lambda acc, x: F.struct(
            (acc["n"] + F.greatest(x["e"] - F.greatest(x["s"], acc["to"]), F.lit(0))).alias("n"), F.greatest(acc["to"], x["e"]).alias("to")
        ),
    )
    covered = ordered.select("rep", merged["n"].alias("covered")).join(counts, "rep")
    rows = docs.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("doc_id")).agg(F.max(F.length(text_col)).alias("n_chars"))
    rows = rows.join(members, "doc_id", "left").join(covered, "rep", "left")
    chars = F.when(F.col("copied"), F.col("n_chars")).otherwise(F.coalesce("covered", F.lit(0)))
    return rows.select(
        "doc_id", F.coalesce("n_chars", F.lit(0)).alias("n_chars"), chars.alias("shared_chars"),
        F.coalesce(chars / F.nullif(F.col("n_chars"), F.lit(0)), F.lit(0.0)).alias("share"),
        F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("rep", "doc_id").alias("copies_of"),
    )
