"""Near-duplicate vectors by NN-descent (Dong, Moses and Li, 2011).

Equal vectors are one node. Every node keeps a list of its K most similar nodes
so far. Lists begin with the neighbours in a few orders of the vectors by the
signs of random projections, and are refined by local joins: a node introduces
its neighbours, in both directions, to each other. When all of a node's
neighbours pass the threshold its list is saturated and may miss links; the lists
of its component are then enlarged to all components with such lists, block by
block, where blocks that lie so close (or so far apart) that all (or none) of their
pairs pass are counted without comparing, and components with links between them
become one. A bounded audit compares some nodes, and some of each component, with
all others; as long as it finds too few of their links, the search is repeated with
longer lists, and in the end all blocks are compared with all others.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pathsieve.llm.common import connected_components, durable, groups_of, release, table

#: Neighbours a node keeps, orders the lists begin with, and rows of an order compared together.
NEIGHBOURS, ORDERS, CHUNK = 10, 4, 128
#: Local joins at most, and the share of entries below whose change the search ends.
ROUNDS, SETTLED = 8, 0.002
#: Vectors of a component compared together, and nodes of the audit.
BLOCK, AUDITED = 1024, 256
#: Outlines of blocks compared together.
TILE = 1024
#: Share of the audited nodes' links that must be found, and longer searches at most.
RECALL, REPEATS = 0.95, 2


def _matrix(raw: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(raw), np.float64).reshape(len(raw), -1)


def _unit(x: np.ndarray) -> np.ndarray:
    """Rows at length 1. The largest component goes out first, so that squares neither over- nor underflow."""
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def nodes_of(df: DataFrame, id_col: str, vector: str) -> DataFrame:
    """(id, v, w): one node for equal vectors, with the least id and the number of rows; v is in double precision."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, out = [], []
            for i, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if i is None or x is None or any(c is None for c in x):
                    continue
                v = np.array(x, np.float64) + 0.0  # no negative zeros
                if len(v) and np.isfinite(v).all() and v.any():
                    ids.append(i)
                    out.append(v.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(out, pa.binary())], ["id", "v"])

    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v")).mapInArrow(run, "id long, v binary")
    return rows.groupBy("v").agg(F.min("id").alias("id"), F.count("*").alias("w"))


def _pairs(found: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    a, b, s = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
    return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(s)], ["a", "b", "s"])


def _best(sims: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of the k highest similarities of each row."""
    k = min(k, sims.shape[1])
    columns = np.argpartition(-sims, k - 1, axis=1)[:, :k] if k < sims.shape[1] else np.tile(np.arange(k), (len(sims), 1))
    return np.repeat(np.arange(len(sims)), k), columns.reshape(-1)


def _first_lists(nodes: DataFrame, k: int, seed: int) -> DataFrame:
    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, raw = batch.column(0), batch.column(1).to_pylist()
            # vectors of another length are ordered with their like
            sizes = np.array([len(x) for x in raw])
            for size in np.unique(sizes).tolist():
                at = np.flatnonzero(sizes == size)
                unit = _unit(_matrix([raw[i] for i in at]))
                for order in range(ORDERS):
                    planes = np.random.default_rng((seed, order, size)).standard_normal((unit.shape[1], 24))
                    codes = ((unit @ planes > 0) * (1 << np.arange(24))).sum(1).astype(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), order * (1 << 40) + size, np.int64)), pa.array(codes), ids.take(pa.array(at)), pa.array([raw[i] for i in at], pa.binary())], ["o", "code", "id", "v"])

    def near(ids: list[int], raw: list[bytes]) -> pa.RecordBatch:
        ids, unit = np.array(ids, np.int64), _unit(_matrix(raw))
        sims = unit @ unit.T
        np.fill_diagonal(sims, -2)
        r, c = _best(sims, k)
        keep = r != c
        return _pairs([(ids[r[keep]], ids[c[keep]], sims[r[keep], c[keep]])])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """``CHUNK`` rows of an order at a time; chunks overlap by half, and no more is held."""
        order, ids, raw, new = None, [], [], 0
        for batch in batches:
            for o, i, v in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                if o != order:
                    if new and len(ids) > 1:
                        yield near(ids, raw)
                    order, ids, raw, new = o, [], [], 0
                ids.append(i)
                raw.append(v)
                new += 1
                if len(ids) == CHUNK:
                    yield near(ids, raw)
                    ids, raw, new = ids[CHUNK // 2:], raw[CHUNK // 2:], 0
        if new and len(ids) > 1:
            yield near(ids, raw)

    coded = nodes.select("id", "v").mapInArrow(code, "o long, code long, id long, v binary")
    return coded.repartitionByRange("o", "code", "id").sortWithinPartitions("o", "code", "id").mapInArrow(compare, "a long, b long, s double")


def _top(pairs: DataFrame, k: int) -> DataFrame:
    """The k best of each a; pairs come repeatedly."""
    best = pairs.groupBy("a", "b").agg(F.max("s").alias("s"))
    return best.withColumn("r", F.row_number().over(Window.partitionBy("a").orderBy(F.desc("s"), "b"))).where(F.col("r") <= k).drop("r")


def _local_join(nodes: DataFrame, lists: DataFrame, k: int) -> DataFrame:
    """Pairs of nodes with a common neighbour, where one improves the other's list."""
    worst = lists.groupBy("a").agg(F.when(F.count("*") >= k, F.min("s")).otherwise(F.lit(-2.0)).alias("worst"))
    back = lists.select(F.col("b").alias("a"), F.col("a").alias("b"), "s")
    back = back.withColumn("r", F.row_number().over(Window.partitionBy("a").orderBy(F.desc("s"), "b"))).where(F.col("r") <= k).drop("r")
    members = lists.select("a", "b").unionByName(back.select("a", "b")).distinct()
    members = members.unionByName(nodes.select(F.col("id").alias("a"), F.col("id").alias("b")))
    known = nodes.join(worst, nodes.id == worst.a, "left").select(F.col("id").alias("b"), "v", F.coalesce("worst", F.lit(-2.0)).alias("worst"))
    rows = members.join(known, "b").select(F.col("a").alias("center"), F.col("b").alias("id"), "v", "worst")

    def introduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, size = [], 0
        for _, (ids, raw, worst_) in groups_of(batches, 1):
            if len(ids) < 2 or len({len(x) for x in raw}) > 1:
                continue
            ids, unit, least = np.array(ids, np.int64), _unit(_matrix(raw)), np.array(worst_)
            sims = unit @ unit.T
            np.fill_diagonal(sims, -3)
            r, c = np.nonzero(sims > least[:, None])
            out.append((ids[r], ids[c], sims[r, c]))
            size += len(r)
            if size > 100_000:
                yield _pairs(out)
                out, size = [], 0
        if out:
            yield _pairs(out)

    return rows.repartition("center").sortWithinPartitions("center").mapInArrow(introduce, "a long, b long, s double")


def search(nodes: DataFrame, k: int, seed: int) -> DataFrame:
    """(a, b, s): the k most similar nodes found for each node."""
    lists, n = durable(_top(_first_lists(nodes, k, seed), k)), nodes.count()
    for _ in range(ROUNDS):
        better = durable(_top(lists.unionByName(_local_join(nodes, lists, k)), k))
        changed = better.join(lists, ["a", "b"], "left_anti").count()
        lists = better
        release(nodes.sparkSession)
        if changed <= SETTLED * n * k:
            break
    return lists


def _enlarged(nodes: DataFrame, groups: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """((id, links), (list, list2)) of ``groups`` (id, list): links of every node within all groups, with multiplicity, and groups that a link joins."""
    size = groups.groupBy("list").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    rows = groups.join(size, "list").join(nodes, "id")
    rows = durable(rows.select("list", F.pmod(F.xxhash64("id"), "blocks").cast("int").alias("block"), "id", "v", "w", "blocks"))
    width = np.arccos(threshold)

    def outline(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (group, block), (_, raw, weights) in groups_of(batches, 2):
            unit = _unit(_matrix(raw))
            center = unit.sum(0)
            length = np.sqrt(center @ center)
            center = center / length if length > 1e-9 else unit[0]
            radius = float(np.arccos(np.clip(unit @ center, -1, 1)).max())
            yield pa.RecordBatch.from_arrays([pa.array([group], pa.int64()), pa.array([block], pa.int32()), pa.array([center.tobytes()], pa.binary()), pa.array([radius]), pa.array([sum(weights)], pa.int64())], ["list", "block", "center", "radius", "weight"])

    outlines = rows.select("list", "block", "id", "v", "w").repartition("list", "block").sortWithinPartitions("list", "block").mapInArrow(outline, "list long, block int, center binary, radius double, weight long")
    outlines = durable(outlines)
    # every outline meets every other, tile by tile: groups that the lists hold apart may have links between them
    tiles = max(1, -(-outlines.count() // TILE))
    tile = F.pmod(F.xxhash64("list", "block"), F.lit(tiles)).cast("int")
    dealt = outlines.withColumn("tile", tile).withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(tiles - 1))))
    dealt = dealt.select(F.length("center").alias("bytes"), F.least("tile", "other").alias("t"), F.greatest("tile", "other").alias("t2"), "tile", "list", "block", "center", "radius", "weight")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """verdict 1: all pairs of two blocks pass, 0: compare; where none does, there is no row. A margin keeps rounding out of it."""
        for (_, t, t2), (own, group, block, center, radius, weight) in groups_of(batches, 3):
            own, group, block, radius, weight, unit = np.array(own), np.array(group, np.int64), np.array(block, np.int32), np.array(radius), np.array(weight, np.int64), _matrix(center)
            a, b = np.flatnonzero(own == t), np.flatnonzero(own == t2)
            angle = np.arccos(np.clip(unit[a] @ unit[b].T, -1, 1))
            reach = radius[a][:, None] + radius[b][None, :]
            i, j = np.nonzero(angle - reach <= width + 1e-7)
            sure = (angle + reach < width - 1e-7)[i, j]
            i, j = a[i], b[j]
            late = (group[i] > group[j]) | ((group[i] == group[j]) & (block[i] > block[j]))
            if t == t2:
                i, j, sure = i[~late], j[~late], sure[~late]
            else:
                i, j = np.where(late, j, i), np.where(late, i, j)
            raw = pa.array(center, pa.binary())
            for at in range(0, len(i), TILE):  # few at a time, since a pair carries both centers
                p, q = i[at: at + TILE], j[at: at + TILE]
                yield pa.RecordBatch.from_arrays([
                    *(x for k in (p, q) for x in (pa.array(group[k]), pa.array(block[k]), raw.take(pa.array(k)), pa.array(radius[k]), pa.array(weight[k]))), pa.array(sure[at: at + TILE].astype(np.int32))
                ], [*(f"{c}{k}" for k in ("", "2") for c in ("list", "block", "center", "radius", "weight")), "verdict"])

    keys = ["bytes", "t", "t2"]
    schema = ", ".join(f"list{k} long, block{k} int, center{k} binary, radius{k} double, weight{k} long" for k in ("", "2")) + ", verdict int"
    pairs = durable(dealt.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(meet, schema))
    itself = (F.col("list") == F.col("list2")) & (F.col("block") == F.col("block2"))
    sure = pairs.where("verdict = 1")
    sure = sure.select("list", "block", F.col("weight2").alias("links")).unionByName(sure.where(~itself).select(F.col("list2").alias("list"), F.col("block2").alias("block"), F.col("weight").alias("links")))
    sure = rows.join(sure.groupBy("list", "block").agg(F.sum("links").alias("links")), ["list", "block"]).select("id", "links", "w")
    # a node's own block holds the node itself, once for each of its rows; that is taken off at the end
    keys = ["list", "block", "list2", "block2"]
    open_pairs = pairs.where("verdict = 0")
    sides = open_pairs.select(*keys, F.lit(1).alias("side"), F.col("list").alias("own"), F.col("block").alias("part"), F.col("center2").alias("center"), F.col("radius2").alias("radius"))
    sides = sides.unionByName(open_pairs.where(~itself).select(*keys, F.lit(2).alias("side"), F.col("list2").alias("own"), F.col("block2").alias("part"), "center", "radius"))
    shipped = sides.join(rows.select(F.col("list").alias("own"), F.col("block").alias("part"), "id", "v", "w"), ["own", "part"]).select(*keys, "side", "id", "v", "w", "center", "radius")

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The rows that may reach the other block."""
        for batch in batches:
            if batch.num_rows:
                raw, centers = batch.column("v").to_pylist(), batch.column("center").to_pylist()
                lengths = np.array([len(x) for x in raw])
                keep = np.zeros(len(raw), bool)
                for n in np.unique(lengths).tolist():
                    at = np.flatnonzero(lengths == n)
                    cosine = (_unit(_matrix([raw[i] for i in at])) * _matrix([centers[i] for i in at])).sum(1)
                    keep[at] = np.arccos(np.clip(cosine, -1, 1)) <= width + batch.column("radius").to_numpy()[at] + 1e-7
                yield batch.select([*keys, "side", "id", "v", "w"]).filter(pa.array(keep))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (group, block, group2, block2), (side, ids, raw, weights) in groups_of(batches, 4):
            side, ids, unit, weights = np.array(side), np.array(ids, np.int64), _unit(_matrix(raw)), np.array(weights, np.int64)
            same = (group, block) == (group2, block2)
            a = np.flatnonzero(side == 1)
            b = a if same else np.flatnonzero(side == 2)
            passed = unit[a] @ unit[b].T >= threshold
            links = [(ids[a], passed @ weights[b])] + ([] if same else [(ids[b], weights[a] @ passed)])
            joined = group != group2 and passed.any()
            for i, n in links:
                yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(n.astype(np.int64)), pa.nulls(len(i), pa.int64()), pa.nulls(len(i), pa.int64())], ["id", "links", "list", "list2"])
            if joined:
                yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.array([group], pa.int64()), pa.array([group2], pa.int64())], ["id", "links", "list", "list2"])

    shipped = shipped.mapInArrow(near, "list long, block int, list2 long, block2 int, side int, id long, v binary, w long")
    compared = durable(shipped.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(compare, "id long, links long, list long, list2 long"))
    total = sure.select("id", "links").unionByName(compared.where("id is not null").select("id", "links")).groupBy("id").agg(F.sum("links").alias("links"))
    bridges = compared.where("id is null").select("list", "list2").unionByName(pairs.where("verdict = 1 and list <> list2").select("list", "list2")).distinct()
    return total.join(nodes.select("id", "w"), "id").select("id", (F.col("links") - F.col("w")).alias("links")), bridges


def _links(nodes: DataFrame, lists: DataFrame, k: int, threshold: float, exact: bool = False) -> tuple[DataFrame, DataFrame]:
    """((id, links to other nodes with multiplicity), (id, root)) of the nodes that are linked; if ``exact``, every component and every single node is compared with all others."""
    edges = durable(lists.where(F.col("s") >= threshold))
    roots = durable(connected_components(edges.select("a", "b")).select(F.col("node").alias("id"), "root"))
    full = edges.groupBy("a").count().where(F.col("count") >= k).select(F.col("a").alias("id"))
    saturated = full.join(roots, "id").select(F.col("root").alias("list")).distinct()
    groups = roots.withColumnRenamed("root", "list").join(saturated, "list").select("id", "list")
    if exact:
        roots = durable(nodes.select("id").join(roots, "id", "left").select("id", F.coalesce("root", "id").alias("root")))
        groups = roots.withColumnRenamed("root", "list")
    enlarged, bridges = _enlarged(nodes, groups, threshold)
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    plain = both.join(groups.select(F.col("id").alias("a")), "a", "left_anti").join(nodes.select(F.col("id").alias("b"), "w"), "b").groupBy(F.col("a").alias("id")).agg(F.sum("w").alias("links"))
    links = durable(enlarged.select("id", "links").unionByName(plain))
    bridges = durable(bridges)
    if not bridges.isEmpty():
        merged = connected_components(bridges, "list", "list2").select(F.col("node").alias("root"), F.col("root").alias("least"))
        roots = durable(roots.join(merged, "root", "left").select("id", F.coalesce("least", "root").alias("root")))
    return links, roots


def audit(nodes: DataFrame, links: DataFrame, roots: DataFrame, threshold: float) -> float:
    """Share of their links that was found of some nodes that are compared with every node.

    ``AUDITED`` nodes are drawn from all, and as many components have one node
    drawn from each. The least of three shares counts: of all links of the first,
    the mean by node of the first, and the mean by node of the second, where a
    large group weighs no more than a small one.
    """
    drawn = F.xxhash64("id", F.lit(9))
    some = nodes.orderBy(drawn, "id").limit(AUDITED).select("id")
    each = roots.groupBy("root").agg(F.min_by("id", F.struct(drawn.alias("h"), F.col("id"))).alias("id")).orderBy(drawn, "id").limit(AUDITED).select("id")
    chosen = some.withColumn("of_all", F.lit(True)).unionByName(each.withColumn("of_all", F.lit(False))).groupBy("id").agg(F.bool_or("of_all").alias("of_all"), F.bool_or(~F.col("of_all")).alias("of_each"))
    chosen = durable(chosen)
    asked = nodes.join(chosen, "id").select("id", "v").collect()
    if not asked:
        return 1.0
    ids, raw = [r.id for r in asked], [bytes(r.v) for r in asked]
    by_size = {n: ([i for i, x in zip(ids, raw, strict=True) if len(x) == n], _unit(_matrix([x for x in raw if len(x) == n]))) for n in {len(x) for x in raw}}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, weight, have = batch.column(0).to_pylist(), np.array(batch.column(2).to_pylist(), np.int64), np.array(batch.column(1).to_pylist(), object)
            for n, (asked_ids, unit) in by_size.items():
                at = [i for i, x in enumerate(have) if len(x) == n]
                if at:
                    passed = unit @ _unit(_matrix([have[i] for i in at])).T >= threshold
                    same = np.array(asked_ids)[:, None] == np.array([own[i] for i in at])[None, :]
                    yield pa.RecordBatch.from_arrays([pa.array(asked_ids, pa.int64()), pa.array(((passed & ~same) @ weight[at]).astype(np.int64))], ["id", "n"])

    true = nodes.select("id", "v", "w").mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    found = true.where("n > 0").join(chosen, "id").join(links, "id", "left").select("n", "of_all", "of_each", F.least(F.coalesce("links", F.lit(0)), F.col("n")).alias("found"))
    share = F.col("found") / F.col("n")
    shares = found.agg(F.sum(F.when(F.col("of_all"), F.col("found"))) / F.sum(F.when(F.col("of_all"), F.col("n"))), F.avg(F.when(F.col("of_all"), share)), F.avg(F.when(F.col("of_each"), share))).first()
    return min((x for x in shares if x is not None), default=1.0)


def near_duplicates(df: DataFrame, id_col: str = "vec_id", vector: str = "embedding", threshold: float = 0.9) -> DataFrame:
    """(id, n_links, component_id, kept, recall) of every row of ``df``; links are found pairs with cosine >= threshold.

    Ids are whole numbers or strings of them; others are an error. Vectors that are null, empty, zero, or hold null or non-finite components,
    and rows with a null id, link with nothing; so do vectors of different
    lengths. n_links counts other rows; equal vectors are linked. component_id
    is the least id reachable and kept says that it is the row's own. recall is
    what the audit found, the same in every row.
    """
    nodes = durable(nodes_of(df, id_col, vector))
    k = NEIGHBOURS
    for attempt in range(REPEATS + 1):
        links, roots = _links(nodes, search(nodes, k, attempt), k, threshold)
        recall = audit(nodes, links, roots, threshold)
        if recall >= RECALL:
            break
        k *= 2
    else:
        # the lists miss too much: their components are only where a comparison of all blocks begins
        links, roots = _links(nodes, search(nodes, k, attempt), k, threshold, exact=True)
        recall = audit(nodes, links, roots, threshold)
    of_node = nodes.join(links, "id", "left").join(roots, "id", "left").select(
        "v", (F.coalesce("links", F.lit(0)) + F.col("w") - 1).alias("n"), F.coalesce("root", "id").alias("component")
    )

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = [None if x is None or any(c is None for c in x) else (np.array(x, np.float64) + 0.0).tobytes() for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(raw, pa.binary())], ["id", "v"])

    rows = df.select(F.col(id_col).alias("id"), F.col(vector).cast("array<double>").alias("v")).mapInArrow(keyed, f"id {df.schema[id_col].dataType.simpleString()}, v binary")
    found = rows.join(of_node, (rows.v == of_node.v) & rows.id.isNotNull(), "left").select("id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "id").cast("long").alias("component_id"))
    return found.select(F.col("id").alias(id_col), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"), F.lit(recall).alias("recall"))


def op1_nn_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all ``embeddings`` at cosine 0.9."""
    return near_duplicates(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
