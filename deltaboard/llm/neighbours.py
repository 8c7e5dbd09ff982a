"""Nearest neighbours by inner product: NN-descent builds a graph, greedy search walks it.

Nodes are the distinct vectors, so a vector that many rows share is one node. A
further component makes all nodes equally long (the largest inner product is then
the least distance), and 8-bit copies of the nodes serve the graph and the walk;
what the walk finds is scored again with the vectors themselves.

NN-descent starts from neighbours in a few random orders and then joins, round by
round, the neighbours of each node with one another: two neighbours of a node,
one of them new, are offered to each other. All lists are short: ``degree``
neighbours, and at most ``reverse`` new and old nodes that name a node as theirs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from deltaboard.session import Staging

#: Neighbours of a node, nodes that name it (new and old each), offers that a node takes from one other.
DEGREE, REVERSE, OFFERS = 36, 16, 4
#: Random orders at the start, nodes in a block of one, sign bits of an order.
ORDERS, BLOCK, BITS = 4, 256, 10
#: Rounds end when so small a share of all neighbours is new, or after so many.
ENOUGH, ROUNDS = 0.05, 12
#: Nodes that a walk remembers, those it looks beyond in one step, and nodes (a bounded sample) where every walk starts.
BEAM, AHEAD, PIVOTS = 240, 48, 256

_EDGE = "u bigint, v bigint, sim float, fresh boolean"


def _usable(vector: str) -> str:
    fine = f"forall({vector}, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('infinity'))"
    return f"{vector} IS NOT NULL AND {fine} AND exists({vector}, x -> x <> 0)"


def usable_vectors(rows: DataFrame, key: str, vector: str) -> DataFrame:
    """``(key, vector)`` of the rows that take part.

    Vectors that are null, empty or zero or hold null or non-finite components
    are left out, and those whose length is not the most common one (the smaller
    of two equally common).
    """
    fit = rows.select(F.col(key).alias("key"), F.col(vector).alias("vector")).where(F.expr(_usable("vector")))
    lengths = fit.groupBy(F.size("vector").alias("length")).count().orderBy(F.desc("count"), "length").limit(1)
    found = lengths.head()
    return fit.where(F.size("vector") == (found["length"] if found else 0))


def _matrix(column: pa.ChunkedArray | pa.Array, width: int) -> np.ndarray:
    """Vectors or 8-bit copies of a column as the rows of a matrix."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if pa.types.is_binary(column.type):
        return np.frombuffer(b"".join(column.to_pylist()), np.int8).reshape(-1, width)
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _copies(vectors: np.ndarray, longest: float) -> tuple[np.ndarray, np.ndarray]:
    """8-bit copies with the component that makes up for the length, and their scales."""
    vectors = vectors.astype(np.float64)
    rest = np.sqrt(np.maximum(longest - np.einsum("ij,ij->i", vectors, vectors), 0.0)) if longest else np.zeros(len(vectors))
    whole = np.column_stack([vectors, rest])
    scale = np.abs(whole).max(axis=1) / 127
    return np.rint(whole / scale[:, None]).astype(np.int8), scale


def _packed(batches: Iterator[pa.RecordBatch], width: int, longest: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            codes, scale = _copies(_matrix(batch.column("vector"), width), longest)
            cells = [batch.column(0), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(scale.astype(np.float32))]
            yield pa.RecordBatch.from_arrays(cells, names=[batch.schema.names[0], "code", "scale"])


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Batches sorted by their first column, cut anew so that no group of it is divided."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(0).to_numpy()
        if held and keys[-1] == held[-1].column(0)[-1].as_py():
            held.append(batch)
            continue
        start = int(np.searchsorted(keys, keys[-1]))
        if held or start:
            yield pa.Table.from_batches([*held, batch.slice(0, start)])
        held = [batch.slice(start)]
    if held:
        yield pa.Table.from_batches(held)


def _edges(u: list, v: list, sim: list) -> pa.RecordBatch:
    u, v, sim = (np.concatenate(x) if x else np.array([], t) for x, t in ((u, np.int64), (v, np.int64), (sim, np.float32)))
    cells = [pa.array(u, pa.int64()), pa.array(v, pa.int64()), pa.array(sim, pa.float32()), pa.array(np.ones(len(u), bool))]
    return pa.RecordBatch.from_arrays(cells, names=["u", "v", "sim", "fresh"])


def _best(sims: np.ndarray, k: int) -> np.ndarray:
    """Mask of the ``k`` largest finite values of each row (more where they are equal)."""
    if sims.shape[1] > k:
        least = np.partition(sims, -k, axis=1)[:, -k]
        return (sims >= least[:, None]) & np.isfinite(sims)
    return np.isfinite(sims)


def _block_neighbours(batches: Iterator[pa.RecordBatch], width: int, block: int, degree: int) -> Iterator[pa.RecordBatch]:
    """The nearest in each run of ``block`` nodes; the last run of a partition is longer by a rest."""
    rows = [b for b in batches if b.num_rows]
    if not rows:
        return
    table = pa.Table.from_batches(rows)
    nodes = table["node"].to_numpy()
    for start in range(0, len(nodes), block):
        stop = min(start + block, len(nodes))
        start = max(0, min(start, stop - block))
        part = table.slice(start, stop - start)
        ids = nodes[start:stop]
        x = _matrix(part["code"], width) * part["scale"].to_numpy()[:, None].astype(np.float32)
        sims = x @ x.T
        np.fill_diagonal(sims, -np.inf)
        i, j = np.nonzero(_best(sims, degree))
        yield _edges([ids[i]], [ids[j]], [sims[i, j]])


def _offers(batches: Iterator[pa.RecordBatch], width: int, offers: int) -> Iterator[pa.RecordBatch]:
    """Neighbours of one node, offered to one another where that may help."""
    for table in _groups(batches):
        hubs, ids = table["hub"].to_numpy(), table["member"].to_numpy()
        fresh, worst = table["fresh"].to_numpy(zero_copy_only=False), table["worst"].to_numpy()
        x = _matrix(table["code"], width) * table["scale"].to_numpy()[:, None].astype(np.float32)
        ends = np.append(np.flatnonzero(np.diff(hubs)) + 1, len(hubs))
        u, v, sim, start = [], [], [], 0
        for end in ends:
            if fresh[start:end].any():
                own, new = ids[start:end], fresh[start:end]
                sims = x[start:end] @ x[start:end].T
                no = ~(new[:, None] | new[None, :]) | (own[:, None] == own[None, :]) | (sims <= worst[start:end, None])
                sims[no] = -np.inf
                i, j = np.nonzero(_best(sims, offers))
                u.append(own[i])
                v.append(own[j])
                sim.append(sims[i, j])
            start = end
        yield _edges(u, v, sim)


def _nearest(edges: DataFrame, degree: int) -> DataFrame:
    """The ``degree`` nearest per node; an edge that was there already is not fresh."""
    once = edges.repartition("u").groupBy("u", "v").agg(F.max("sim").alias("sim"), F.min("fresh").alias("fresh"))
    place = F.row_number().over(Window.partitionBy("u").orderBy(F.col("sim").desc(), "v"))
    return once.withColumn("_place", place).where(F.col("_place") <= degree).drop("_place")


class Graph:
    """Nodes (node, vector, members), their 8-bit copies, and edges (u, v, sim)."""

    def __init__(self, nodes: DataFrame, codes: DataFrame, edges: DataFrame, width: int, longest: float, rounds: int):
        self.nodes, self.codes, self.edges, self.width, self.longest, self.rounds = nodes, codes, edges, width, longest, rounds


def build_graph(
    vectors: DataFrame, stage: Staging, *, members: int, degree: int = DEGREE, reverse: int = REVERSE, offers: int = OFFERS,
    orders: int = ORDERS, block: int = BLOCK, rounds: int = ROUNDS, enough: float = ENOUGH,
) -> Graph:
    """NN-descent over ``usable_vectors``.

    ``members`` is the number of smallest keys that a node keeps of the rows that
    share its vector; nulls come last. More can never be among that many nearest.
    """
    first = F.row_number().over(Window.partitionBy("vector").orderBy(F.col("key").asc_nulls_last()))
    few = vectors.withColumn("_place", first).where(F.col("_place") <= members)
    key = F.struct(F.col("key").isNull().alias("none"), F.col("key").alias("key"))
    grouped = few.groupBy("vector").agg(F.array_sort(F.collect_list(key)).alias("members"))
    nodes = stage(grouped.select(F.monotonically_increasing_id().alias("node"), "vector", "members"), "nodes")
    length = F.aggregate("vector", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    n, longest, width = nodes.agg(F.count("*"), F.max(length), F.max(F.size("vector"))).first()
    longest, width = longest or 0.0, (width or 0) + 1
    codes = stage(
        nodes.select("node", "vector").mapInArrow(lambda b: _packed(b, width - 1, longest), "node bigint, code binary, scale float"),
        "codes",
    )
    starts = []
    for turn in range(orders):
        spin = np.random.default_rng(turn).standard_normal((BITS + 1, width)).astype(np.float32)

        def keyed(batches: Iterator[pa.RecordBatch], spin: np.ndarray = spin) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    p = _matrix(batch.column("code"), width).astype(np.float32) @ spin.T
                    side = (p[:, :-1] > 0) @ (1 << np.arange(BITS))
                    cells = [*batch.columns, pa.array(side, pa.int64()), pa.array(p[:, -1] * batch.column("scale").to_numpy())]
                    yield pa.RecordBatch.from_arrays(cells, names=["node", "code", "scale", "side", "along"])

        laid = codes.mapInArrow(keyed, "node bigint, code binary, scale float, side bigint, along float")
        laid = laid.repartitionByRange("side", "along", "node").sortWithinPartitions("side", "along", "node")
        laid = laid.select("node", "code", "scale")
        starts.append(laid.mapInArrow(lambda b: _block_neighbours(b, width, block, degree), _EDGE))
    edges = starts[0]
    for more in starts[1:]:
        edges = edges.unionByName(more)
    edges, turn = stage(_nearest(edges, degree), "edges0"), 0
    for turn in range(1, rounds + 1):
        if edges.where("fresh").count() <= enough * n * degree:
            break
        back = edges.select(F.col("v").alias("hub"), F.col("u").alias("member"), "fresh")
        mixed = F.row_number().over(Window.partitionBy("hub", "fresh").orderBy(F.xxhash64("member", F.lit(turn)), "member"))
        back = back.withColumn("_place", mixed).where(F.col("_place") <= reverse).drop("_place")
        lists = edges.select(F.col("u").alias("hub"), F.col("v").alias("member"), "fresh").unionByName(back)
        worst = edges.groupBy(F.col("u").alias("node")).agg(F.count("*").alias("_n"), F.min("sim").alias("worst"))
        worst = worst.select("node", F.when(F.col("_n") >= degree, F.col("worst")).alias("worst"))
        known = codes.join(worst, "node", "left").withColumn("worst", F.coalesce("worst", F.lit(float("-inf")).cast("float")))
        told = lists.join(known.withColumnRenamed("node", "member"), "member").select("hub", "member", "fresh", "worst", "code", "scale")
        found = told.repartition("hub").sortWithinPartitions("hub").mapInArrow(lambda b: _offers(b, width, offers), _EDGE)
        old = edges.withColumn("fresh", F.lit(False))
        edges = stage(_nearest(old.unionByName(found), degree), f"edges{turn}")
    return Graph(nodes, codes, edges.select("u", "v", "sim"), width, longest, turn)


def _scored(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            x, y = (_matrix(batch.column(c), width).astype(np.float32) for c in ("code", "q_code"))
            sim = np.einsum("ij,ij->i", x, y) * batch.column("scale").to_numpy() * batch.column("q_scale").to_numpy()
            cells = [batch.column("q"), batch.column("node"), pa.array(sim.astype(np.float32))]
            yield pa.RecordBatch.from_arrays(cells, names=["q", "node", "sim"])


def _beams(met: DataFrame, beam: int) -> DataFrame:
    """The best ``beam`` nodes per walk; ``done`` once the walk has looked beyond them."""
    once = met.repartition("q").groupBy("q", "node").agg(F.max("sim").alias("sim"), F.max("done").alias("done"))
    place = F.row_number().over(Window.partitionBy("q").orderBy(F.col("sim").desc(), "node"))
    return once.withColumn("place", place).where(F.col("place") <= beam)


def greedy_search(
    graph: Graph, queries: DataFrame, stage: Staging, *, beam: int = BEAM, ahead: int = AHEAD, pivots: int = PIVOTS,
) -> DataFrame:
    """``(q, node)`` of the nodes that the walk of each query ``(q, vector)`` ends with.

    A walk begins with the best of ``pivots`` nodes, and with the query's own
    node if its vector is in the graph: queries from elsewhere need a wider
    ``beam`` for the same recall. Each step looks at the
    neighbours of the best ``ahead`` nodes not looked at so far, and remembers
    the ``beam`` best of all it met; the walk ends when none is left to look at.
    """
    width, codes = graph.width, graph.codes
    asked = queries.select("q", "vector").mapInArrow(lambda b: _packed(b, width - 1, 0.0), "q bigint, code binary, scale float")
    asked = stage(asked.toDF("q", "q_code", "q_scale"), "queries")
    named = graph.edges.select(F.col("v").alias("u"), F.col("u").alias("v"), "sim")
    place = F.row_number().over(Window.partitionBy("u").orderBy(F.col("sim").desc(), "v"))
    named = named.withColumn("_place", place).where(F.col("_place") <= DEGREE).select("u", "v")
    both = graph.edges.select("u", "v").unionByName(named)
    ways = stage(both.groupBy("u").agg(F.collect_set("v").alias("next")), "ways")

    sample = codes.orderBy(F.xxhash64("node"), "node").limit(pivots).collect()
    ids = np.array([r["node"] for r in sample], np.int64)
    at = np.array([np.frombuffer(r["code"], np.int8) * np.float32(r["scale"]) for r in sample], np.float32).reshape(-1, width)

    def begin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows and len(ids):
                sims = (_matrix(batch.column("q_code"), width) * batch.column("q_scale").to_numpy()[:, None]).astype(np.float32) @ at.T
                i, j = np.nonzero(_best(sims, beam))
                cells = [batch.column("q").take(pa.array(i)), pa.array(ids[j]), pa.array(sims[i, j])]
                yield pa.RecordBatch.from_arrays(cells, names=["q", "node", "sim"])

    home = queries.select("q", "vector").join(graph.nodes.select("node", "vector"), "vector").select("q", "node")
    home = home.select("q", "node", F.lit(float("inf")).cast("float").alias("sim"))
    start = asked.mapInArrow(begin, "q bigint, node bigint, sim float").unionByName(home).withColumn("done", F.lit(False))
    met, step = stage(_beams(start, beam), "walk0"), 0
    while True:
        step += 1
        # The best nodes that are still to look beyond; all walks take the same step.
        order = Window.partitionBy("q").orderBy("place")
        todo = met.where(~F.col("done")).withColumn("_next", F.row_number().over(order)).where(F.col("_next") <= ahead)
        todo = stage(todo.select("q", "node"), f"todo{step}")
        if todo.isEmpty():
            return met.select("q", "node")
        ahead_of = todo.join(ways, todo["node"] == ways["u"]).select("q", F.explode("next").alias("node")).distinct()
        new = ahead_of.join(met.select("q", "node"), ["q", "node"], "left_anti")
        shown = new.join(codes, "node").join(asked, "q").select("q", "node", "code", "scale", "q_code", "q_scale")
        scored = shown.mapInArrow(lambda b: _scored(b, width), "q bigint, node bigint, sim float")
        looked = todo.select("q", "node", F.lit(True).alias("looked"))
        old = met.join(looked, ["q", "node"], "left").select("q", "node", "sim", (F.col("done") | F.coalesce("looked", F.lit(False))).alias("done"))
        met = stage(_beams(old.unionByName(scored.withColumn("done", F.lit(False))), beam), f"walk{step}")


def _products(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """The exact inner product of ``vector`` and ``q_vector`` in double precision."""
    for batch in batches:
        if batch.num_rows:
            x, y = (_matrix(batch.column(c), width).astype(np.float64) for c in ("vector", "q_vector"))
            names = [n for n in batch.schema.names if n not in ("vector", "q_vector")]
            cells = [batch.column(n) for n in names] + [pa.array(np.einsum("ij,ij->i", x, y))]
            yield pa.RecordBatch.from_arrays(cells, names=[*names, "score"])


def nearest_rows(
    rows: DataFrame, stage: Staging, *, top: int = 20, every: int = 20, key: str = "vec_id", vector: str = "embedding",
) -> DataFrame:
    """The ``top`` rows of largest inner product for each row whose key is divisible by ``every``.

    query_id, rank, vec_id, score; nearest first, ties to the smaller key, null
    keys last. A row is not its own neighbour, but one that repeats it is; a
    repeated query row is answered as often as it comes. Other columns are not
    read, and tables without usable vectors give no rows. See ``usable_vectors``
    for the rows that take no part.
    """
    usable = stage(usable_vectors(rows, key, vector), "vectors")
    graph = build_graph(usable, stage, members=top + 1)
    length = graph.width - 1
    asked = usable.where(F.pmod("key", F.lit(every)) == 0)
    queries = stage(asked.select(F.monotonically_increasing_id().alias("q"), F.col("key").alias("query_id"), "vector"), "asked")
    found = greedy_search(graph, queries, stage)
    pairs = found.join(graph.nodes, "node").join(queries.withColumnRenamed("vector", "q_vector"), "q")
    own = F.col("vector") == F.col("q_vector")
    drop = F.when(own, F.array_position(F.transform("members", lambda m: m["key"]), F.col("query_id")) - 1)
    ready = pairs.select("q", "query_id", "members.key", "vector", "q_vector", F.coalesce(drop, F.lit(-1)).cast("bigint").alias("own"))
    scored = ready.mapInArrow(
        lambda b: _products(b, length), "q bigint, query_id bigint, key array<bigint>, own bigint, score double"
    )
    each = scored.select("q", "query_id", "score", "own", F.posexplode("key").alias("_pos", "vec_id")).where("_pos <> own")
    place = F.row_number().over(Window.partitionBy("q").orderBy(F.col("score").desc(), F.col("vec_id").asc_nulls_last()))
    return each.withColumn("rank", place).where(F.col("rank") <= top).select("query_id", "rank", "vec_id", "score")
