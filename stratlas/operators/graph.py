"""Graph operators as joins and aggregations; iterative ones write each step, so lineage stays short and survives losses."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from stratlas.operators import moving
from stratlas.session import materialise, release


# -- edge layers ------------------------------------------------------------------------------------------


def normalised_layers(edges: DataFrame, scales: dict[int, float]) -> DataFrame:
    """Edges of the named kinds, each layer's weights divided by their mean and scaled; null weights count as 1."""
    scale = None
    for kind, factor in scales.items():
        scale = (F.when if scale is None else scale.when)(F.col("kind") == kind, F.lit(float(factor)))
    rows = edges.where(F.col("kind").isin(*scales)).withColumn("weight", F.coalesce("weight", F.lit(1.0)))
    means = rows.groupBy("kind").agg(F.avg("weight").alias("mean"))
    return rows.join(F.broadcast(means), "kind").select("src", "dst", "kind", (F.col("weight") / F.col("mean") * scale).alias("weight"))


def unit_weights(edges: DataFrame) -> DataFrame:
    """Weights moved to 0…1 over all edges; 0.5 where all are equal."""
    ends = edges.agg(F.min("weight").alias("lo"), F.max("weight").alias("hi"))
    rows = edges.join(F.broadcast(ends), F.lit(True))
    span = F.col("hi") - F.col("lo")
    return rows.withColumn("weight", F.when(span == 0, F.lit(0.5)).otherwise((F.col("weight") - F.col("lo")) / span)).drop("lo", "hi")


def symmetric(edges: DataFrame) -> DataFrame:
    """Each edge in both directions, self-loops dropped, parallel edges kept."""
    rows = edges.where("src <> dst").select("src", "dst", "weight")
    return rows.unionByName(rows.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"))


# -- co-occurrence ----------------------------------------------------------------------------------------


def baskets(events: DataFrame, actor: str, item: str, least: int = 2, most: int = 400) -> DataFrame:
    """``(actor, item, w)`` of actors with ``least``…``most`` distinct items; w = 1/ln(size + 1). Null ends don't count."""
    one = events.where(F.col(actor).isNotNull() & F.col(item).isNotNull()).select(F.col(actor).alias("actor"), F.col(item).alias("item")).distinct()
    sizes = one.groupBy("actor").agg(F.count(F.lit(1)).alias("n")).where(F.col("n").between(least, most))
    return one.join(sizes, "actor").select("actor", "item", (1 / F.log(F.col("n") + 1)).alias("w"))


def pair_weights(basket: DataFrame) -> DataFrame:
    """``(a, b, w)`` with a < b: summed weights of the baskets that hold both. Baskets have a bounded size, so their pairs do."""
    left, right = basket.select("actor", F.col("item").alias("a"), "w"), basket.select("actor", F.col("item").alias("b"))
    return left.join(right, "actor").where("a < b").groupBy("a", "b").agg(F.sum("w").alias("w"))


def ppmi(basket: DataFrame, least: float = 3.0, smoothing: float = 0.75) -> DataFrame:
    """``(a, b, ppmi, observations)``: positive pointwise mutual information of pairs whose weighted count reaches ``least``.

    Only the second (larger) item's share is smoothed; observations is the weighted count cut to an integer.
    """
    pairs = pair_weights(basket)
    items = basket.groupBy("item").agg(F.sum("w").alias("w"))
    whole = basket.groupBy("actor").agg(F.first("w").alias("w")).agg(F.sum("w").alias("total"))
    rows = pairs.where(F.col("w") >= least)
    rows = rows.join(items.select(F.col("item").alias("a"), F.col("w").alias("wa")), "a").join(items.select(F.col("item").alias("b"), F.col("w").alias("wb")), "b")
    rows = rows.join(F.broadcast(whole), F.lit(True))
    score = F.log((F.col("w") / F.col("total")) / ((F.col("wa") / F.col("total")) * F.pow(F.col("wb") / F.col("total"), F.lit(smoothing))))
    return rows.select("a", "b", score.alias("ppmi"), F.col("w").cast("int").alias("observations")).where("ppmi > 0")


def ranked_ends(pairs: DataFrame, score: str, k: int) -> DataFrame:
    """``(item, other, score)``: for each item its ``k`` best pairs, at whichever end it stands; ties by the other item.

    The literal bound on row_number is applied before the shuffle, so an item with very many pairs sends few.
    """
    ends = pairs.select(F.col("a").alias("item"), F.col("b").alias("other"), score).unionByName(pairs.select(F.col("b").alias("item"), F.col("a").alias("other"), score))
    order = W.partitionBy("item").orderBy(F.desc(score), "other")
    return ends.withColumn("r", F.row_number().over(order)).where(F.col("r") <= k)


def mutual_top_k(pairs: DataFrame, score: str, k: int) -> DataFrame:
    """``(a, b, score)`` of pairs among the ``k`` best of both their ends."""
    ends = ranked_ends(pairs, score, k).select(F.least("item", "other").alias("a"), F.greatest("item", "other").alias("b"), score)
    return ends.groupBy("a", "b").agg(F.max(score).alias(score), F.count(F.lit(1)).alias("n")).where("n = 2").drop("n")


# -- ranks ------------------------------------------------------------------------------------------------


def pagerank(nodes: DataFrame, edges: DataFrame, damping: float = 0.85, tolerance: float = 1e-10, most: int = 200) -> DataFrame:
    """``(id, rank)``: weighted PageRank with dangling mass spread evenly before each push; ranks sum to 1.

    Edges with an unknown end, a null or zero weight drop out; a negative weight raises. Edges are joined with their
    out-strength once and written by source; each round is one join and one partially aggregated sum by target.
    It stops after ``most`` rounds or when the L1 change is at most ``tolerance``.
    """
    nodes = nodes.select("id").where("id is not null").distinct()
    known = edges.join(nodes.select(F.col("id").alias("src")), "src", "left_semi").join(nodes.select(F.col("id").alias("dst")), "dst", "left_semi")
    known = known.where("weight is not null and weight <> 0").select("src", "dst", "weight")
    checked = known.withColumn("weight", F.when(F.col("weight") < 0, F.raise_error(F.lit("negative edge weight"))).otherwise(F.col("weight").cast("double")))
    out = checked.groupBy("src").agg(F.sum("weight").alias("strength"))
    pushes = checked.groupBy("src", "dst").agg(F.sum("weight").alias("weight")).join(out, "src")
    pushes = materialise(pushes.select("src", "dst", (F.col("weight") / F.col("strength")).alias("share")), "pagerank-edges")
    n = nodes.count()
    if n == 0:
        return nodes.select("id", F.lit(0.0).alias("rank"))
    base = nodes.join(out.select(F.col("src").alias("id"), F.lit(True).alias("pushing")), "id", "left")
    base = materialise(base.select("id", F.coalesce("pushing", F.lit(False)).alias("pushing")), "pagerank-nodes")
    ranks = base.select("id", "pushing", F.lit(1.0 / n).alias("rank"))
    dangling = base.agg(F.sum(F.when(F.col("pushing"), 0.0).otherwise(1.0 / n))).first()[0]
    last = None
    for _ in range(most):
        got = ranks.join(pushes, F.col("id") == F.col("src")).groupBy("dst").agg(F.sum(F.col("rank") * F.col("share")).alias("got"))
        fresh = ranks.join(got, F.col("id") == F.col("dst"), "left").select(
            "id", "pushing", ((1 - damping) / n + damping * (F.coalesce("got", F.lit(0.0)) + dangling / n)).alias("rank"), F.col("rank").alias("old")
        )
        fresh = materialise(fresh, "pagerank-step")
        step = fresh.agg(F.sum(F.abs(F.col("rank") - F.col("old"))), F.sum(F.when(F.col("pushing"), 0.0).otherwise(F.col("rank")))).first()
        if last is not None:
            release(last)  # its successor is written
        ranks, dangling, last = fresh.drop("old"), step[1], fresh
        if step[0] <= tolerance:
            break
    return ranks.select("id", "rank")


def importance_order(ranks: DataFrame, stars: DataFrame) -> DataFrame:
    """``(id, rank, tiebreak, position)``: by rank, then ln(1 + stars), then id, without a global sort in one task."""
    from stratlas.operators.ordering import global_positions

    rows = ranks.join(stars.select("id", F.log1p(F.greatest(F.coalesce("stars", F.lit(0)), F.lit(0)).cast("double")).alias("tiebreak")), "id", "left")
    rows = rows.select("id", "rank", F.coalesce("tiebreak", F.lit(0.0)).alias("tiebreak"))
    return global_positions(rows, "rank", -F.col("tiebreak"), F.col("id"))


# -- components, communities ------------------------------------------------------------------------------


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``(id, component)``: the smallest id connected with each node; isolated nodes are their own.

    Each round takes the smallest label around and then jumps to that label's own label, so long chains halve. Labels
    only fall, so the rounds end: when none has moved.
    """
    nodes = nodes.select("id").where("id is not null").distinct()
    links = edges.where("src <> dst").select("src", "dst")
    links = links.unionByName(links.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()
    links = links.join(nodes.select(F.col("id").alias("src")), "src", "left_semi").join(nodes.select(F.col("id").alias("dst")), "dst", "left_semi")
    links = materialise(links, "component-links")
    labels = materialise(nodes.select("id", F.col("id").alias("component")), "component-labels")
    last = labels
    while True:
        near = labels.join(links, F.col("id") == F.col("src")).groupBy("dst").agg(F.min("component").alias("near"))
        step = labels.join(near, F.col("id") == F.col("dst"), "left").select("id", "component", F.least("component", F.coalesce("near", "component")).alias("low"))
        jump = step.select(F.col("id").alias("j"), F.col("low").alias("jumped"))
        step = step.join(jump, F.col("low") == F.col("j"), "left").select("id", "component", F.least("low", F.coalesce("jumped", "low")).alias("low"))
        step = materialise(step, "component-step")
        moved = step.where("low <> component").limit(1).count()
        release(last)  # its successor is written
        labels, last = step.select("id", F.col("low").alias("component")), step
        if not moved:
            return labels


def component_summary(labels: DataFrame) -> DataFrame:
    """How many components there are, the largest one's size, and how many nodes stand alone."""
    sizes = labels.groupBy("component").agg(F.count(F.lit(1)).alias("n"))
    return sizes.agg(F.count(F.lit(1)).alias("components"), F.max("n").alias("largest"), F.count_if(F.col("n") == 1).alias("isolated"))


def modularity(edges: DataFrame, labels: DataFrame, resolution: float = 1.0) -> DataFrame:
    """``(modularity)`` of a labelling of undirected weighted edges: inner share less the share expected by degree."""
    both = symmetric(edges.withColumn("weight", F.coalesce("weight", F.lit(1.0))))
    rows = both.join(labels.select(F.col("id").alias("src"), F.col("label").alias("a")), "src").join(labels.select(F.col("id").alias("dst"), F.col("label").alias("b")), "dst")
    per = rows.groupBy(F.col("a").alias("label")).agg(F.sum("weight").alias("degree"), F.sum(F.when(F.col("a") == F.col("b"), F.col("weight")).otherwise(0.0)).alias("inner"))
    whole = per.agg(F.sum("inner").alias("inner"), F.sum("degree").alias("m2"), F.sum(F.col("degree") * F.col("degree")).alias("squares"))
    return whole.select((F.col("inner") / F.col("m2") - resolution * F.col("squares") / (F.col("m2") * F.col("m2"))).alias("modularity"))


def disconnected_communities(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """Labels whose members don't all hang together by edges inside the community."""
    inner = edges.join(labels.select(F.col("id").alias("src"), F.col("label").alias("a")), "src").join(labels.select(F.col("id").alias("dst"), F.col("label").alias("b")), "dst").where("a = b")
    parts = components(labels.select("id"), inner.select("src", "dst"))
    return parts.join(labels, "id").groupBy("label").agg(F.count_distinct("component").alias("parts"), F.count(F.lit(1)).alias("size")).where("parts > 1")


def communities(nodes: DataFrame, edges: DataFrame, resolution: float = 1.0, levels: int = 10, passes: int | None = None, seed: int = 5) -> DataFrame:
    """``(id, label)``: communities by modularity, all nodes moving in parallel.

    In each pass a hashed half of the nodes may move to the neighbouring community of largest gain (ties to the smaller
    label); halves alternate, so two nodes don't swap for ever. Passes end when modularity stops rising (or after
    ``passes``), then communities become nodes (with their inner weight as self-loops) and the next level begins. Every
    step is joins and aggregations; the labels are the smallest ids of their members.
    """
    return many_communities(nodes, edges.withColumn("run", F.lit(0)), {0: resolution}, levels, passes, seed).select("id", "label")


#: Pairs of a graph whose passes one task runs as arrays (some 130 bytes a pair); larger ones pass by joins until their levels are that small.
IN_TASK = 1 << 22


def many_communities(nodes: DataFrame, edges: DataFrame, resolutions: dict[int, float], levels: int = 10, passes: int | None = None, seed: int = 5, in_task: int = IN_TASK) -> DataFrame:
    """``(run, id, label)``: ``communities`` of several runs in the same passes; ``edges`` have a ``run``, each with its resolution.

    A run rests as soon as its own modularity stops rising, and keeps its own best state of each level. A level's graph of
    ``in_task`` pairs or fewer, and the levels after it, are left to one task a run, which makes the same moves.
    """
    runs = F.explode(F.array(*[F.lit(r) for r in resolutions]))
    mapping = nodes.select("id").distinct().select(runs.alias("run"), "id", F.col("id").alias("label"))
    pairs = _turned(_pairs(edges, "run"), seed)
    sizes = {r["run"]: r for r in pairs.groupBy("run").agg(F.sum("weight").alias("m"), F.count(F.lit(1)).alias("n")).collect() if r["m"]}
    m2 = {r: 2 * x["m"] for r, x in sizes.items()}
    few = {r for r, x in sizes.items() if x["n"] <= in_task}
    if few:
        mapping = _named(mapping, _labels_in_tasks(pairs, {r: (r, resolutions[r], m2[r], None) for r in few}, levels, passes))
    active, best = set(m2) - few, {}
    if not active:
        return mapping
    mapping = materialise(mapping, "community-map")
    penalty = F.element_at(F.create_map(*[F.lit(x) for r, m in m2.items() for x in (r, resolutions[r] / m)]), F.col("run"))
    rows = pairs.where(F.col("run").isin(*active))
    graph = materialise(rows.select("run", F.col("a").alias("src"), F.col("b").alias("dst"), "weight").unionByName(rows.select("run", F.col("b").alias("src"), F.col("a").alias("dst"), "weight")), "community-graph")
    for level in range(levels):
        if level:
            small = {r["run"] for r in graph.groupBy("run").agg(F.count_if(F.col("src") <= F.col("dst")).alias("n")).collect() if r["n"] <= in_task}
            if small:
                rows = _turned(graph.where(F.col("run").isin(*small) & (F.col("src") <= F.col("dst"))).select("run", F.col("src").alias("a"), F.col("dst").alias("b"), "weight"), seed)
                mapping = materialise(_named(mapping, _labels_in_tasks(rows, {r: (r, resolutions[r], m2[r], best[r]) for r in small}, levels - level, passes)), "community-map")
                active -= small
            if not active:
                break
        graph = graph.where(F.col("run").isin(*active))
        state = materialise(graph.groupBy("run", F.col("src").alias("id")).agg(F.sum("weight").alias("k")).select("run", "id", "k", F.col("id").alias("label")), "community-degree")
        score = _level_scores(graph, state, m2, resolutions)
        kept, written = dict.fromkeys(active, state), state
        going, turn = set(active), 0
        while going and turn != passes:
            state = state.where(F.col("run").isin(*going))
            totals = state.groupBy("run", "label").agg(F.sum("k").alias("total"))
            near = state.select("run", F.col("id").alias("dst"), "label")
            around = graph.where(F.col("run").isin(*going) & (F.col("src") != F.col("dst"))).join(near, ["run", "dst"]).groupBy("run", F.col("src").alias("id"), "label").agg(F.sum("weight").alias("w"))
            own = state.select("run", "id", "k", F.col("label").alias("own"))
            options = around.join(own, ["run", "id"]).join(totals, ["run", "label"])
            rest = F.when(F.col("label") == F.col("own"), F.col("total") - F.col("k")).otherwise(F.col("total"))
            options = options.withColumn("gain", F.col("w") - penalty * F.col("k") * rest)
            chosen = options.groupBy("run", "id").agg(F.max_by("label", F.struct(F.round("gain", 9), -F.col("label"))).alias("to"), F.max("gain").alias("gain"), F.max(F.when(F.col("label") == F.col("own"), F.col("gain"))).alias("stay"))
            moved = state.join(chosen, ["run", "id"], "left").join(totals.withColumnRenamed("total", "own_total"), ["run", "label"])
            stay = F.coalesce("stay", -penalty * F.col("k") * (F.col("own_total") - F.col("k")))
            turn_of = F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(2)) == turn % 2
            label = F.when(turn_of & (F.col("gain") > stay + 1e-7), F.col("to")).otherwise(F.col("label"))
            before, written = written, materialise(moved.select("run", "id", "k", label.alias("label")), "community-pass")
            state = written
            if not any(before is s for s in kept.values()):
                release(before)  # its successor is written
            for r, now in _level_scores(graph, state, m2, resolutions).items():
                if now > score[r] + 1e-7:
                    score[r], kept[r] = now, state
                elif turn % 2:
                    going.discard(r)
            turn += 1
        whole = None
        for one in {id(df): df for df in kept.values()}.values():
            part = one.where(F.col("run").isin(*[r for r in kept if kept[r] is one])).select("run", "id", "label")
            whole = part if whole is None else whole.unionByName(part)
        low = whole.groupBy("run", "label").agg(F.min("id").alias("name"))
        named = materialise(whole.join(low, ["run", "label"]).select("run", F.col("id").alias("was"), F.col("name").alias("now")), "community-names")
        mapping = materialise(_named(mapping, named), "community-map")
        active = {r for r in active if r not in best or score[r] > best[r] + 1e-7}
        if not active:
            break
        best = score
        a, b = named.select("run", F.col("was").alias("src"), F.col("now").alias("a")), named.select("run", F.col("was").alias("dst"), F.col("now").alias("b"))
        folded = graph.where(F.col("run").isin(*active)).join(a, ["run", "src"]).join(b, ["run", "dst"]).groupBy("run", F.col("a").alias("src"), F.col("b").alias("dst")).agg(F.sum("weight").alias("weight"))
        graph = materialise(folded, "community-graph")
    return mapping


def _pairs(edges: DataFrame, *by: str) -> DataFrame:
    """``(*by, a, b, weight)``, a < b: the weight between two nodes, in whichever direction; null weights count as 1."""
    rows = edges.where("src <> dst").select(*by, F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"), F.coalesce("weight", F.lit(1.0)).cast("double").alias("weight"))
    return rows.groupBy(*by, "a", "b").agg(F.sum("weight").alias("weight"))


def _turned(pairs: DataFrame, seed: int) -> DataFrame:
    """Written, with the ends' turns as ``bits``."""
    turn = lambda end: F.pmod(F.xxhash64(end, F.lit(seed)), F.lit(2)).cast("int")
    return materialise(pairs.withColumn("bits", turn("a").bitwiseOR(F.shiftleft(turn("b"), 1))), "community-pairs")


def _named(mapping: DataFrame, named: DataFrame) -> DataFrame:
    """``mapping`` with the labels that ``(run, was, now)`` renames."""
    return mapping.join(named.withColumnRenamed("was", "label"), ["run", "label"], "left").select("run", "id", F.coalesce("now", "label").alias("label"))


def _in_tasks(pairs: DataFrame, layer: str, runs: dict, each, schema: str) -> DataFrame:
    """What ``each(run, graph)`` yields (record batches) of every run's graph, each in a task of its own.

    ``pairs`` have ``a, b, weight, bits`` and a ``layer``; ``runs`` are ``(layer, ...)`` by run. Pairs travel as compressed
    blocks, so that many runs can share a layer.
    """

    def blocks(batches):
        import pyarrow as pa

        for batch in batches:
            of, columns = batch.column(layer).to_numpy(), {name: batch.column(name).to_numpy() for name, _ in moving.PAIR}
            for one in dict.fromkeys(of.tolist()):
                at = of == one
                yield pa.RecordBatch.from_pydict({"layer": pa.array([one], pa.int32()), "block": pa.array([moving.pack({k: v[at] for k, v in columns.items()})], pa.binary())})

    def settle(batches):
        got: dict[int, list[bytes]] = {}
        for batch in batches:
            for run, block in zip(batch.column("run").to_pylist(), batch.column("block").to_pylist()):
                got.setdefault(run, []).append(block)
        for run in sorted(got):
            yield from each(run, moving.Graph(got.pop(run)))

    spark = pairs.sparkSession
    wanted = F.broadcast(spark.createDataFrame([(i, r, x[0]) for i, (r, x) in enumerate(runs.items())], "task int, run int, layer int"))
    packed = materialise(pairs.select(F.col(layer).cast("int").alias(layer), *[name for name, _ in moving.PAIR]).mapInArrow(blocks, "layer int, block binary"), "community-blocks")
    dealt = packed.join(wanted, "layer").repartitionById(len(runs), F.col("task")).select("run", "block")
    return dealt.mapInArrow(settle, schema)


def _labels_in_tasks(pairs: DataFrame, runs: dict, levels: int, passes: int | None) -> DataFrame:
    """``(run, was, now)``: the names that the nodes of runs ``(layer, resolution, m2, best so far)`` get, one task a run."""

    def each(run, g):
        import pyarrow as pa

        _, resolution, m2, best = runs[run]
        label = moving.communities(g, m2, resolution, levels, passes, best)
        for i in range(0, len(label), 1 << 16):
            was, now = g.ids[i : i + (1 << 16)], g.ids[label[i : i + (1 << 16)]]
            yield pa.RecordBatch.from_pydict({"run": pa.array(np.full(len(was), run, np.int32)), "was": pa.array(was), "now": pa.array(now)})

    return materialise(_in_tasks(pairs, "run", runs, each, "run int, was long, now long"), "community-names")


def _level_scores(graph: DataFrame, state: DataFrame, m2: dict[int, float], resolutions: dict[int, float]) -> dict[int, float]:
    """Modularity of each run that ``state`` has."""
    a, b = state.select("run", F.col("id").alias("src"), F.col("label").alias("a")), state.select("run", F.col("id").alias("dst"), F.col("label").alias("b"))
    inner = graph.join(a, ["run", "src"]).join(b, ["run", "dst"]).where("a = b").groupBy("run").agg(F.sum("weight").alias("inner"), F.lit(0.0).alias("squares"))
    squares = state.groupBy("run", "label").agg(F.sum("k").alias("t")).groupBy("run").agg(F.lit(0.0).alias("inner"), F.sum(F.col("t") * F.col("t")).alias("squares"))
    rows = inner.unionByName(squares).groupBy("run").agg(F.sum("inner").alias("inner"), F.sum("squares").alias("squares")).collect()
    return {r["run"]: r["inner"] / m2[r["run"]] - resolutions[r["run"]] * r["squares"] / m2[r["run"]] ** 2 for r in rows}


def stability(edges: DataFrame, labels: DataFrame, time: float, terms: int = 12) -> float:
    """Markov stability of a labelling at one time: the chance to be in one's community then, less that at random.

    exp(t(P - I)) is applied to the communities' indicator columns by a Taylor series in steps of at most 2, as sparse
    (node, community) rows; a truncated term is written, so lineage stays short.
    """
    both = symmetric(edges.withColumn("weight", F.coalesce("weight", F.lit(1.0)).cast("double"))).groupBy("src", "dst").agg(F.sum("weight").alias("w"))
    out = both.groupBy("src").agg(F.sum("w").alias("k"))
    walk = materialise(both.join(out, "src").select("src", "dst", (F.col("w") / F.col("k")).alias("p"), "k"), "stability-walk")
    whole = walk.select("src", "k").distinct().agg(F.sum("k")).first()[0]
    start = walk.select(F.col("src").alias("id"), "k").distinct().join(labels.select("id", "label"), "id")
    pi = start.select("id", "label", (F.col("k") / whole).alias("pi"))
    state = materialise(start.select("id", F.col("label").alias("c"), F.lit(1.0).alias("x")), "stability-state")
    steps = max(1, int(-(-time // 2)))
    dt = time / steps
    for _ in range(steps):
        term, total = state, state
        for n in range(1, terms + 1):
            pushed = walk.join(term.select(F.col("id").alias("dst"), "c", "x"), "dst").groupBy(F.col("src").alias("id"), "c").agg(F.sum(F.col("p") * F.col("x")).alias("x"))
            less = term.select("id", "c", (-F.col("x")).alias("x"))
            term = materialise(pushed.unionByName(less).groupBy("id", "c").agg((F.sum("x") * dt / n).alias("x")), "stability-term")
            total = total.unionByName(term)
        state = materialise(total.groupBy("id", "c").agg(F.sum("x").alias("x")), "stability-state")
    kept = state.join(pi, "id").where("c = label").agg(F.sum(F.col("pi") * F.col("x"))).first()[0] or 0.0
    chance = pi.groupBy("label").agg(F.sum("pi").alias("s")).agg(F.sum(F.col("s") * F.col("s"))).first()[0] or 0.0
    return kept - chance


# -- rows for the binary graph ----------------------------------------------------------------------------


def packed_entries(edges: DataFrame) -> DataFrame:
    """``(row, target, packed)`` of the undirected adjacency: both ends get a row, the source's with the outgoing bit.

    ``packed`` holds 13 bits of weight (0…1, cut), two of kind, and the direction in the top bit.
    """
    level = F.least(F.greatest((F.col("weight") * 8191).cast("int"), F.lit(0)), F.lit(8191))
    bits = level.bitwiseOR(F.shiftleft(F.col("kind").cast("int"), 13))
    out = edges.select(F.col("src").alias("row"), F.col("dst").alias("target"), bits.bitwiseOR(F.lit(32768)).alias("packed"))
    return out.unionByName(edges.select(F.col("dst").alias("row"), F.col("src").alias("target"), bits.alias("packed")))


def decoded_entries(entries: DataFrame) -> DataFrame:
    """Direction, kind and weight of packed entries."""
    p = F.col("packed")
    return entries.select("row", "target", (F.shiftright(p, 15) == 1).alias("outgoing"), F.shiftright(p, 13).bitwiseAND(F.lit(3)).alias("kind"), (p.bitwiseAND(F.lit(8191)) / 8191).alias("weight"))


def backbone(edges: DataFrame, ranks: DataFrame, most: int = 900, per_node: int = 4) -> DataFrame:
    """The strongest arcs (weight × √(rank·rank)), at most ``per_node`` at a node, taken greedily until ``most``.

    Greedy choice is sequential: the driver gets the ``64·most`` strongest arcs in order, then as many of those that are
    left once arcs of full nodes and further arcs of taken pairs are dropped, until ``most`` are taken or none is left.
    Whatever a batch passed over stays excluded, so the choice is that of one pass over all arcs.
    """
    spark = edges.sparkSession
    a, b = ranks.select(F.col("id").alias("src"), F.col("rank").alias("ra")), ranks.select(F.col("id").alias("dst"), F.col("rank").alias("rb"))
    scored = edges.where("src <> dst").join(a, "src").join(b, "dst").withColumn("score", F.coalesce("weight", F.lit(0.0)) * F.sqrt(F.col("ra") * F.col("rb")))
    scored = materialise(scored.select("src", "dst", "score"), "backbone-arcs")
    used: dict[int, int] = {}
    taken: set[tuple[int, int]] = set()
    rows: list[tuple[int, int, float]] = []
    rest, size = scored, 64 * most
    while len(rows) < most:
        top = rest.orderBy(F.desc("score"), "src", "dst").limit(size).collect()
        for r in top:
            pair = (min(r["src"], r["dst"]), max(r["src"], r["dst"]))
            if pair in taken or used.get(r["src"], 0) >= per_node or used.get(r["dst"], 0) >= per_node:
                continue
            taken.add(pair)
            for end in pair:
                used[end] = used.get(end, 0) + 1
            rows.append((r["src"], r["dst"], r["score"]))
            if len(rows) == most:
                break
        if len(top) < size or not rows:
            break
        full = F.broadcast(spark.createDataFrame([(i,) for i, n in used.items() if n >= per_node], "id long"))  # at most 2·most / per_node
        pairs = F.broadcast(spark.createDataFrame(sorted(taken), "a long, b long"))
        rest = scored.join(full, F.col("src") == F.col("id"), "left_anti").join(full, F.col("dst") == F.col("id"), "left_anti")
        rest = rest.join(pairs, (F.least("src", "dst") == F.col("a")) & (F.greatest("src", "dst") == F.col("b")), "left_anti")
    return spark.createDataFrame(rows, "src long, dst long, score double")


def sweep(nodes: DataFrame, sources: dict[str, DataFrame], resolutions: tuple[float, ...], levels: int = 10, passes: int | None = None, seed: int = 5, in_task: int = IN_TASK) -> DataFrame:
    """``(source, resolution, communities, largest, modularity)`` over edge sources and resolutions, modularity at that resolution.

    Sources of ``in_task`` pairs or fewer are packed once for all resolutions, and each run's task counts its own communities.
    """
    names = sorted(sources)
    runs = {i: (names.index(name), float(r)) for i, (name, r) in enumerate((name, r) for name in names for r in resolutions)}
    layers = None
    for i, name in enumerate(names):
        layer = sources[name].select(F.lit(i).alias("layer"), "src", "dst", "weight")
        layers = layer if layers is None else layers.unionByName(layer)
    ids = materialise(nodes.select("id").distinct(), "sweep-nodes")
    many = ids.count()
    pairs = _pairs(layers, "layer")
    for end, bit in (("a", 4), ("b", 8)):  # an end that isn't a node takes part, but isn't counted
        there = ids.select(F.col("id").alias(end), F.lit(bit).alias(f"node_{end}"))
        pairs = pairs.join(there, end, "left")
    pairs = _turned(pairs, seed).withColumn("bits", F.col("bits").bitwiseOR(F.coalesce("node_a", F.lit(0))).bitwiseOR(F.coalesce("node_b", F.lit(0))))
    sizes = {r["layer"]: r for r in pairs.groupBy("layer").agg(F.sum("weight").alias("m"), F.count(F.lit(1)).alias("n")).collect()}
    found: dict[int, tuple] = {i: (many, min(many, 1), None) for i, (layer, _) in runs.items() if layer not in sizes or not sizes[layer]["m"]}  # nothing moves
    few = {i: (layer, r, 2 * sizes[layer]["m"]) for i, (layer, r) in runs.items() if i not in found and sizes[layer]["n"] <= in_task}

    def each(run, g):
        import pyarrow as pa

        _, resolution, m2 = few[run]
        got = moving.tally(g, moving.communities(g, m2, resolution, levels, passes), m2, resolution)
        yield pa.RecordBatch.from_pylist([{"run": run, **got}], pa.schema([("run", pa.int32()), ("nodes", pa.int64()), ("many", pa.int64()), ("largest", pa.int64()), ("modularity", pa.float64())]))

    if few:
        for r in _in_tasks(pairs, "layer", few, each, "run int, nodes long, many long, largest long, modularity double").collect():
            alone = many - r["nodes"]
            found[r["run"]] = (r["many"] + alone, max(r["largest"], min(alone, 1)), r["modularity"])
    large = {i: x for i, x in runs.items() if i not in found}
    if large:
        own = F.explode(F.element_at(F.create_map(*[x for layer in {layer for layer, _ in large.values()} for x in (F.lit(layer), F.array(*[F.lit(i) for i, y in large.items() if y[0] == layer]))]), F.col("layer")))
        rows = layers.where(F.col("layer").isin(*{layer for layer, _ in large.values()})).select(own.alias("run"), "src", "dst", "weight")
        labels = materialise(many_communities(ids, rows, {i: r for i, (_, r) in large.items()}, levels, passes, seed, in_task), "sweep-labels")
        counted = {r["run"]: r for r in labels.groupBy("run", "label").agg(F.count(F.lit(1)).alias("n")).groupBy("run").agg(F.count(F.lit(1)).alias("many"), F.max("n").alias("largest")).collect()}
        for i, (layer, r) in large.items():
            score = modularity(sources[names[layer]], labels.where(F.col("run") == i).select("id", "label"), r).first()[0]
            found[i] = (counted[i]["many"], counted[i]["largest"], score) if i in counted else (0, 0, None)
    rows = [(names[layer], r, found[i][0], found[i][1], None if found[i][2] is None else round(float(found[i][2]), 6)) for i, (layer, r) in runs.items()]
    return nodes.sparkSession.createDataFrame(rows, "source string, resolution double, communities long, largest long, modularity double")
