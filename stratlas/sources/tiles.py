"""Binary tiles and graphs, their JSON sidecars, and decoders that check what they read."""

from __future__ import annotations

import json
import struct

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratlas.operators import sphere
from stratlas.session import materialise

#: Magic words, layout versions, bytes a point, headers and the order of the arrays.
TILE, GRAPH, TILE_VERSION, GRAPH_VERSION, POINT = 0x47475431, 0x47474731, 1, 2, 12
TILE_HEAD, GRAPH_HEAD = "<IIHHI", "<IIIIH6x"
TILE_TYPE = np.dtype([("theta", "<i2"), ("phi", "<u2"), ("id", "<u4"), ("size", "<u2"), ("domain", "u1"), ("flags", "u1")])


PART = 1 << 20  # positions in a part of a band


class BadFile(ValueError):
    """A binary file isn't what it should be."""


def flags(low_signal, archived, fork):
    """The flag bits: low signal 1, archived 2, fork 4."""
    bit = lambda c, n: F.when(F.coalesce(c, F.lit(False)), n).otherwise(0)
    return bit(low_signal, 1).bitwiseOR(bit(archived, 2)).bitwiseOR(bit(fork, 4))


def tile_rows(world: DataFrame, sizes: DataFrame) -> DataFrame:
    """``(band, position, theta, phi, size, domain, flags, id)`` as the tile's integers; sizes has id, band, position, size."""
    rows = world.where("theta is not null and phi is not null").join(sizes.withColumnRenamed("id", "repo_id"), "repo_id")
    t, p, s = sphere.quantised(F.col("theta"), F.col("phi"), F.col("size"))
    return rows.select("band", "position", t.alias("theta"), p.alias("phi"), s.alias("size"), F.coalesce("domain", F.lit(0)).alias("domain"), flags(F.col("low_signal"), F.col("is_archived"), F.col("is_fork")).alias("flags"), F.col("position").alias("id"))


def encode_tile(rows: list, band: int = 0) -> bytes:
    """A 16-byte header (magic, points, version, band), then each attribute's array, in order of position; id 0 is reserved."""
    data = np.zeros(len(rows), TILE_TYPE)
    for name in TILE_TYPE.names:  # a table's columns are taken as they are
        data[name] = rows[name].to_numpy() if hasattr(rows, "columns") else [r[name] for r in rows]
    if len(rows) and not data["id"].min():
        raise BadFile("id 0 stands for no point")
    return struct.pack(TILE_HEAD, TILE, len(rows), TILE_VERSION, band, 0) + b"".join(data[n].tobytes() for n in TILE_TYPE.names)


def decode_tile(raw: bytes) -> np.ndarray:
    if len(raw) < 16:
        raise BadFile("no tile")
    magic, n, version, _, _ = struct.unpack(TILE_HEAD, raw[:16])
    if magic != TILE or version != TILE_VERSION or len(raw) != 16 + n * POINT:
        raise BadFile(f"magic {magic:x}, version {version}, {len(raw)} bytes for {n} points")
    out, at = np.zeros(n, TILE_TYPE), 16
    for name in TILE_TYPE.names:
        kind = TILE_TYPE[name]
        out[name] = np.frombuffer(raw, kind, n, at)
        at += n * kind.itemsize
    return out


def part_of(position):
    return F.floor((position - 1) / F.lit(PART)).cast("int")


def write_tiles(rows: DataFrame, path: str) -> DataFrame:
    """One tile a band as rows of ``(band, tile, points)``, written as Parquet; a band's rows meet in one task, for a file is one.

    Bands are cut into parts of ``PART`` positions, so that no task holds more than those.
    """
    part = part_of(F.col("position"))

    def build(key, group):
        import pandas as pd

        group = group.sort_values("position")
        return pd.DataFrame([{"band": key[0], "part": key[1], "tile": encode_tile(group, key[0]), "points": len(group)}])

    rows.withColumn("part", part).groupBy("band", "part").applyInPandas(build, "band int, part int, tile binary, points long").write.mode("overwrite").parquet(path)
    return rows.sparkSession.read.parquet(path)


def encode_graph(rank: np.ndarray, offsets: np.ndarray, targets: np.ndarray, ambient: np.ndarray, weights: np.ndarray) -> bytes:
    """A 24-byte header, then ranks, row offsets, targets, backbone ends and packed weights."""
    head = struct.pack(GRAPH_HEAD, GRAPH, len(rank), len(targets), len(ambient) // 2, GRAPH_VERSION)
    return b"".join([head, *[np.ascontiguousarray(x, kind) for x, kind in ((rank, "<f4"), (offsets, "<u4"), (targets, "<u4"), (ambient, "<u4"), (weights, "<u2"))]])


def decode_graph(raw: bytes) -> dict[str, np.ndarray]:
    if len(raw) < 24:
        raise BadFile("no graph")
    magic, n, e, a, version = struct.unpack(GRAPH_HEAD, raw[:24])
    shape = [("rank", "<f4", n), ("offsets", "<u4", n + 1), ("targets", "<u4", e), ("ambient", "<u4", 2 * a), ("weights", "<u2", e)]
    if magic != GRAPH or version != GRAPH_VERSION or len(raw) != 24 + sum(np.dtype(k).itemsize * c for _, k, c in shape):
        raise BadFile(f"version {version}, {len(raw)} bytes")
    out, at = {}, 24
    for name, kind, count in shape:
        out[name] = np.frombuffer(raw, kind, count, at)
        at += count * np.dtype(kind).itemsize
    return out


def check_graph(g: dict[str, np.ndarray]) -> list[str]:
    """What is wrong with a decoded graph: ranges, order, sums, symmetry."""
    bad = []
    n = len(g["rank"])
    if n and abs(float(g["rank"].astype(float).sum()) - 1) > 1e-3:
        bad.append("ranks don't sum to 1")
    if n > 1 and (np.diff(g["rank"]) > 1e-9).any():
        bad.append("ranks rise")
    if g["offsets"][0] or g["offsets"][-1] != len(g["targets"]) or (np.diff(g["offsets"].astype(np.int64)) < 0).any():
        bad.append("offsets")
    if len(g["targets"]) and g["targets"].max() >= n or len(g["ambient"]) and g["ambient"].max() >= n:
        bad.append("targets out of range")
        return bad
    rows = np.repeat(np.arange(n), np.diff(g["offsets"].astype(np.int64)))
    there = sorted(zip(rows.tolist(), g["targets"].tolist()))
    back = sorted(zip(g["targets"].tolist(), rows.tolist()))
    if there != back:
        bad.append("not symmetric")
    if (rows == g["targets"]).any():
        bad.append("loops")
    return bad


BLOCK = 1 << 20  # entries that a check holds at once, or those of one node


def _entry_facts(at: np.ndarray, targets: np.ndarray, packed: np.ndarray) -> tuple[bool, bool, bool]:
    """Whether each entry has its mirror, none is a loop, and none stands twice; a block of rows at a time.

    The entries of a block's rows are set against the mirrors of all entries that lead there.
    """
    n, mirrored, straight, single = len(at) - 1, True, True, True
    if (np.diff(at) < 0).any() or at[0] or at[-1] != len(targets):
        return False, False, False  # no entry has a row
    low = 0
    while low < n:
        high = min(n, max(low + 1, int(np.searchsorted(at, at[low] + BLOCK, "right")) - 1))
        rows, own = np.repeat(np.arange(low, high), np.diff(at[low : high + 1])).astype(np.uint64), targets[at[low] : at[high]]
        there = np.flatnonzero((targets >= low) & (targets < high))
        back = (np.searchsorted(at, there, "right") - 1).astype(np.uint64)
        keys, bits = _sorted_entries(rows << 32 | own, packed[at[low] : at[high]])
        mirrors, mirror_bits = _sorted_entries(targets[there].astype(np.uint64) << 32 | back, packed[there] ^ 32768)
        mirrored &= np.array_equal(keys, mirrors) and np.array_equal(bits, mirror_bits)
        straight &= not (rows == own).any()
        single &= not ((keys[1:] == keys[:-1]) & (bits[1:] == bits[:-1])).any()
        low = high
    return mirrored, straight, single


def _sorted_entries(keys: np.ndarray, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((bits, keys))
    return keys[order], bits[order]


def graph_facts(g: dict[str, np.ndarray], most_arcs: int = 900, per_node: int = 4) -> dict[str, bool]:
    """What should hold of a decoded graph, each by its name; beside the graph, only blocks of its entries are held."""
    n, rank, at = len(g["rank"]), g["rank"].astype(float), g["offsets"].astype(np.int64)
    targets, packed = g["targets"], g["weights"]
    ends = g["ambient"].astype(np.int64).reshape(-1, 2)
    inside = (targets < n).all() and (ends < n).all()
    mirrored, straight, single = _entry_facts(at, targets, packed)
    pairs = np.sort(ends, axis=1)
    return {
        "ranks are positive": bool((rank > 0).all()), "ranks sum to 1": not n or abs(rank.sum() - 1) <= 1e-3, "ranks don't rise": n < 2 or not (np.diff(g["rank"]) > 1e-9).any(),
        "ranks spread": n < 100 or rank.max() > 10 * rank.min(), "offsets begin at 0": at[0] == 0, "offsets don't fall": bool((np.diff(at) >= 0).all()), "offsets end with the targets": at[-1] == len(targets),
        "ends are nodes": bool(inside), "each entry has its mirror": mirrored, "no loops": straight, "no entry twice": single,
        "kinds are known": bool(((packed >> 13 & 3) <= 2).all()), "as many in as out": int((packed >> 15).sum()) * 2 == len(packed), "arcs are few": len(ends) <= most_arcs, "no arc twice": len(np.unique(pairs, axis=0)) == len(pairs),
        "arcs spread over nodes": not len(ends) or int(np.bincount(ends.ravel(), minlength=1).max()) <= per_node, "arcs join strong nodes": not len(ends) or not inside or rank[ends.ravel()].mean() >= rank.mean(),
    }


def tile_checks(rows: DataFrame) -> DataFrame:
    """``(check, ok)`` of tile rows: ranges, unique ids, positions without gaps, bands in order and of their sizes; one pass and no join."""
    one = rows.agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("id").alias("ids"), F.min("position").alias("first"), F.max("position").alias("last"), F.count_distinct("position").alias("positions"),
        F.min("theta").alias("t0"), F.max("theta").alias("t1"), F.min("phi").alias("p0"), F.max("phi").alias("p1"), F.min("size").alias("s0"), F.max("size").alias("s1"), F.min("domain").alias("d0"), F.max("domain").alias("d1"), F.min("flags").alias("f0"), F.max("flags").alias("f1"),
        *[f(F.when(F.col("band") == b, F.col(c))).alias(f"{n}{b}_{c}") for b in range(3) for c in ("position", "size") for n, f in (("lo", F.min), ("hi", F.max))], *[F.count_if(F.col("band") == b).alias(f"n{b}") for b in range(3)],
    )
    c = F.col
    checks = {
        "ids are unique": c("ids") == c("n"), "positions have no gap": (c("first") == 1) & (c("last") == c("n")) & (c("positions") == c("n")), "theta in range": c("t0").between(0, 32767) & c("t1").between(0, 32767),
        "phi in range": c("p0").between(0, 65535) & c("p1").between(0, 65535), "size in range": c("s0").between(0, 65535) & c("s1").between(0, 65535), "domain fits": c("d0").between(0, 255) & c("d1").between(0, 255), "flags fit": c("f0").between(0, 7) & c("f1").between(0, 7),
        "bands follow one another": (c("hi0_position") < c("lo1_position")) & (c("hi1_position") < c("lo2_position")), "sizes fall by band": (c("lo0_size") >= c("hi1_size")) & (c("lo1_size") >= c("hi2_size")),
        "first band is a fiftieth": c("n0") == F.rint(c("n") * 0.02), "second band is 18 of 100": c("n1") == F.rint(c("n") * 0.18), "bands are all": c("n0") + c("n1") + c("n2") == c("n"),
    }
    return one.select(F.inline(F.array(*[F.struct(F.lit(k).alias("check"), F.coalesce(v, F.lit(False)).alias("ok")) for k, v in checks.items()])))


def read_binary(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", "content", "length")


def sidecars(rows: DataFrame) -> DataFrame:
    """``(band, part, json)``: column-oriented names and scores of each part of a band in order of position; unknown scores are null, not 0."""
    ordered = F.array_sort(F.collect_list(F.struct("position", "full_name", "score")))
    return rows.groupBy("band", part_of(F.col("position")).alias("part")).agg(ordered.alias("s")).select("band", "part", F.to_json(F.struct(F.transform("s", lambda x: x["full_name"]).alias("names"), F.transform("s", lambda x: x["score"]).alias("scores")), {"ignoreNullFields": "false"}).alias("json"))


def manifest_json(points: list[int], clusters: list[dict], extra: dict | None = None) -> str:
    return json.dumps({"version": TILE_VERSION, "bands": [{"file": f"points-{i}.bin", "points": n} for i, n in enumerate(points)], "clusters": clusters, **(extra or {})}, sort_keys=True)


class TooLarge(ValueError):
    """A client's file would not fit one."""


def _row_parts(batches):
    """Rows' numbers and ranks as bytes."""
    import pyarrow as pa

    for b in batches:
        row, rank = b.column("row").to_numpy(), b.column("rank").to_numpy(zero_copy_only=False)
        yield pa.RecordBatch.from_pydict({"row": pa.array([row.astype("<u4").tobytes()], pa.binary()), "rank": pa.array([rank.astype("<f4").tobytes()], pa.binary())})


def _entry_parts(batches):
    """Sorted entries as bytes, with the first of their rows, a number within the task, and how many entries each row has here."""
    import pyarrow as pa

    for number, b in enumerate(batches):
        if b.num_rows:
            rows, many = np.unique(b.column("row").to_numpy(), return_counts=True)
            raw = (rows.astype("<u4"), many.astype("<u4"), b.column("target").to_numpy().astype("<u4"), b.column("packed").to_numpy().astype("<u2"))
            head = {"first": pa.array([int(rows[0])], pa.int64()), "number": pa.array([number], pa.int32()), "size": pa.array([b.num_rows], pa.int64())}
            yield pa.RecordBatch.from_pydict(head | {name: pa.array([x.tobytes()], pa.binary()) for name, x in zip(("rows", "many", "targets", "packed"), raw)})


def graph_file(ordered: DataFrame, edges: DataFrame, arcs: DataFrame, most_nodes: int = 2_000_000, most_entries: int = 20_000_000) -> bytes:
    """The binary graph of ``(id, rank, position)`` nodes, weighted kinds of edges, and backbone arcs.

    One file for a client, so it is put together in one place; graphs over the bounds raise. Ids become row numbers by joins,
    entries are sorted and encoded by ranges of rows in the tasks, and the driver gets those bytes part by part.
    """
    from stratlas.operators.graph import packed_entries

    rows = materialise(ordered.select("id", "rank", (F.col("position") - 1).alias("row")), "graph-rows")
    names = rows.select("id", "row")
    a, b = names.select(F.col("id").alias("src"), F.col("row").alias("s")), names.select(F.col("id").alias("dst"), F.col("row").alias("d"))
    inside = edges.join(a, "src").join(b, "dst").where("s <> d").select(F.col("s").alias("src"), F.col("d").alias("dst"), F.coalesce("kind", F.lit(3)).alias("kind"), "weight")  # 3 is no kind
    entries = materialise(packed_entries(inside), "graph-entries")
    n, e = rows.count(), entries.count()
    if n > most_nodes or e > most_entries:
        raise TooLarge(f"{n} nodes and {e} entries")
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = entries.repartitionByRange(tasks, "row").sortWithinPartitions("row", "target", "packed")
    parts = materialise(ranged.mapInArrow(_entry_parts, "first long, number int, size long, rows binary, many binary, targets binary, packed binary"), "graph-parts")
    starts, at = {}, 0
    for p in sorted(parts.select("first", "number", "size").collect()):  # a row's entries lie in one task, so these are in the file's order
        starts[p["first"], p["number"]] = at
        at += p["size"]
    degrees, targets, packed = np.zeros(n, np.int64), np.zeros(e, "<u4"), np.zeros(e, "<u2")
    for p in parts.toLocalIterator():
        place = slice(starts[p["first"], p["number"]], starts[p["first"], p["number"]] + p["size"])
        targets[place], packed[place] = np.frombuffer(p["targets"], "<u4"), np.frombuffer(p["packed"], "<u2")
        degrees[np.frombuffer(p["rows"], "<u4")] += np.frombuffer(p["many"], "<u4")
    ranks = np.zeros(n, "<f4")
    for p in rows.mapInArrow(_row_parts, "row binary, rank binary").toLocalIterator():
        ranks[np.frombuffer(p["row"], "<u4")] = np.frombuffer(p["rank"], "<f4")
    ends = np.array([(r["s"], r["d"]) for r in arcs.join(a, "src").join(b, "dst").orderBy(F.desc("score"), "s", "d").select("s", "d").collect()], np.int64).ravel()
    return encode_graph(ranks, np.r_[0, np.cumsum(degrees)], targets, ends, packed)
