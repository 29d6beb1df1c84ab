"""Near-duplicate embeddings by NN-descent.

Equal vectors count as one node. A first neighbour graph comes from the leaves of a few random
hyperplane trees; rounds of joins through neighbours of neighbours then improve it: at every
node its neighbours and the nodes that name it are compared with each other, and a pair enters
a list where it beats that list's last. Vectors travel to these joins as bytes; links are
verified in double precision.

Threshold edges of the graph give components. Where a list is saturated, all its entries being
links, it may lack some, in its own component and outwards. Outwards, nodes with saturated lists
get a second graph whose lists hold members of other components alone; its links merge
components, and this is repeated until there are none. Inwards, every list is enlarged to all
members of its component, which are counted and not listed: rings by the angle from one member
settle what lies close together or far apart, the rest is compared in blocks. A link joins
members of one component, so link counts are exact once the graph connects what belongs together.

An audit compares random nodes and nodes with close pairs with every vector; while the mean
recall of their links is below the target, the graph is built again with longer lists and more
trees. If the last attempt is below it too, all nodes are compared with each other but for those
that their rings keep apart, so no result goes out below the target.
"""

from __future__ import annotations

from itertools import count as count_from

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import discard, hash_split, materialize, whole_groups
from tidemark.llm.components import connected_components

LISTS = 10
TREES = 10
ROUNDS = 5
#: Share of new entries in a round's lists at which the descent ends.
SETTLED = 0.01
#: Nodes of a tree's leaf that are compared at once, about, and at most.
LEAF, LEAF_MOST = 96, 256
#: Nodes of a larger leaf that are in each of its blocks, about.
SHARED = 16
#: Members of a component that are compared as one block.
BLOCK = 1024
#: Rings to the threshold's angle in which members of larger components stand, and what angles
#: in radians are taken to be off by.
RINGS, ANGLE_SLACK = 8, 1e-6
#: Nodes of each kind compared with all others by the audit, at least and at most, and the share
#: of a node's links that must be found, on average.
AUDITED_MOST = 1024
AUDITED, RECALL, ATTEMPTS = 128, 0.99, 3
#: Edges this far below the threshold by bytes are still verified.
SLACK = 0.03


def _matrix(column, width: int) -> np.ndarray:
    """Rows of a list column as doubles; shorter vectors end in zeros."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    n = pc.list_value_length(column).to_numpy(zero_copy_only=False)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if (n == width).all():
        return flat.reshape(len(n), width)
    out = np.zeros((len(n), width))
    for i, (a, m) in enumerate(zip(np.r_[0, np.cumsum(n)[:-1]], n)):
        out[i, :m] = flat[a : a + m]
    return out


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)  # keeps squares in range
    return x / np.sqrt((x**2).sum(axis=1, keepdims=True))


def _bytes(u: np.ndarray) -> np.ndarray:
    return np.rint(u * (127 / np.abs(u).max(axis=1, keepdims=True))).astype(np.int8)


def _rows(column, width: int) -> np.ndarray:
    """Unit vectors of a binary column of bytes, as float32."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    x = np.frombuffer(b"".join(column.to_pylist()), dtype=np.int8).reshape(-1, width).astype(np.float32)
    return x / np.sqrt((x**2).sum(axis=1, keepdims=True))


_NO_NODE = np.iinfo(np.int64).max
_EDGES = "v long, u long, sim float"


def _edges(v, u, sim) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(v, pa.int64()), pa.array(u, pa.int64()), pa.array(sim, pa.float32())], names=["v", "u", "sim"])


def _best(edges: DataFrame, k: int) -> DataFrame:
    """The k best of each list; ``new`` marks what no earlier graph had."""
    order = Window.partitionBy("v").orderBy(F.desc("sim"), "u")
    once = edges.groupBy("v", "u").agg(F.max("sim").alias("sim"), F.min("new").alias("new"))
    return once.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= k).drop("r")


def leaves(nodes: DataFrame, width: int, n: int, trees: int, k: int, apart: bool = False, seed: int = 91) -> DataFrame:
    """First neighbours: the best within leaves of ``trees`` random hyperplane trees, those of
    another ``component`` alone if ``apart``."""
    label = ["component"] if apart else []
    depth = max(0, min(30, int(np.ceil(np.log2(max(1, n / LEAF))))))

    def place(batches):
        rng = np.random.default_rng(seed)
        planes = rng.normal(size=(trees, depth, width)).astype(np.float32)
        weights = 1 << np.arange(depth, dtype=np.int64)
        for b in batches:
            x = _rows(b.column("q"), width)
            for t in range(trees):
                leaf = ((x @ planes[t].T > 0) * weights).sum(axis=1).astype(np.int64) + (t << 32)
                yield pa.RecordBatch.from_arrays([pa.array(leaf), *[b.column(c) for c in ["v", "q", *label]]], names=["leaf", "v", "q", *label])

    dealt = nodes.select("v", "q", *label).mapInArrow(place, "leaf long, v long, q binary" + (", component long" if apart else ""))
    # blocks of a leaf differ from tree to tree, and a few of its nodes are in all of them
    large = dealt.groupBy("leaf").agg(F.count("*").alias("n")).filter(F.col("n") > LEAF_MOST)
    large = materialize(large.select("leaf", F.ceil(F.col("n") / LEAF_MOST).alias("blocks"), F.ceil(F.col("n") / SHARED).alias("share")), "large-leaves")
    shared = F.pmod(F.xxhash64("v", "leaf", F.lit(1)), F.col("share")) == 0
    block = F.when(F.col("blocks").isNull(), F.array(F.lit(0).cast("long"))).when(shared, F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).otherwise(F.array(F.pmod(F.xxhash64("v", "leaf"), F.col("blocks"))))
    placed = dealt.join(large, "leaf", "left").select("leaf", F.explode(block).alias("block"), "v", "q", *label)
    ready = hash_split(placed.select(F.xxhash64("leaf", "block").alias("key"), "v", "q", *label), "key").sortWithinPartitions("key")

    def compare(batches):
        for table, cuts in whole_groups(batches, "key"):
            ids, x = table.column("v").to_numpy(), _rows(table.column("q"), width)
            out = [[], [], []]
            for a, b in zip(cuts[:-1], cuts[1:]):
                if b - a < 2:
                    continue
                sims = x[a:b] @ x[a:b].T
                np.fill_diagonal(sims, -2)
                if apart:
                    own = table.column("component").to_numpy()[a:b]
                    sims[own[:, None] == own[None, :]] = -2
                m = min(k, b - a - 1)
                best = np.argpartition(-sims, m - 1, axis=1)[:, :m]
                sim = np.take_along_axis(sims, best, axis=1).ravel()
                some = sim > -2
                out[0].append(np.repeat(ids[a:b], m)[some])
                out[1].append(ids[a:b][best].ravel()[some])
                out[2].append(sim[some])
            if out[0]:
                yield _edges(*[np.concatenate(c) for c in out])

    return ready.mapInArrow(compare, _EDGES).withColumn("new", F.lit(1))


def descend(nodes: DataFrame, graph: DataFrame, width: int, k: int, turn: int, own: DataFrame | None = None) -> DataFrame:
    """One round: neighbours of neighbours through every node.

    With ``own``, a graph within components, pairs of different components alone are taken; they
    meet at a node through its neighbours in both graphs.
    """
    apart = own is not None
    label = ["component"] if apart else []
    named = graph.select(F.col("u").alias("p"), F.col("v").alias("m"), "new")
    some = Window.partitionBy("p").orderBy(F.desc("new"), F.xxhash64("m", F.lit(turn)))
    back = named.withColumn("r", F.row_number().over(some)).filter(F.col("r") <= k).drop("r")
    around = graph.select(F.col("v").alias("p"), F.col("u").alias("m"), "new").unionByName(back)
    if apart:
        around = around.unionByName(own.select(F.col("v").alias("p"), F.col("u").alias("m"), F.lit(0).alias("new")))
    around = around.groupBy("p", "m").agg(F.max("new").alias("new"))
    last = graph.groupBy("v").agg(F.when(F.count("*") >= k, F.min("sim")).otherwise(F.lit(-2.0)).cast("float").alias("last"))
    known = nodes.select("v", "q", *label).join(last, "v", "left" if apart else "inner").select(F.col("v").alias("m"), "q", *label, F.coalesce("last", F.lit(-2.0).cast("float")).alias("last"))
    ready = hash_split(around.join(known, "m").select("p", "m", "new", "q", "last", *label), "p").sortWithinPartitions("p")

    def join(batches):
        for table, cuts in whole_groups(batches, "p"):
            ids, new, last = (table.column(c).to_numpy() for c in ("m", "new", "last"))
            group = table.column("component").to_numpy() if apart else None
            x, sizes = _rows(table.column("q"), width), np.diff(cuts)
            out = [[], [], []]
            for size in np.unique(sizes[sizes > 1]):  # groups of one size together
                begins = cuts[:-1][sizes == size]
                for part in np.array_split(begins, max(1, len(begins) * size * size // 2_000_000)):
                    at = part[:, None] + np.arange(size)[None, :]
                    sims = x[at] @ x[at].transpose(0, 2, 1)
                    fresh = new[at].astype(bool)
                    use = (fresh[:, :, None] | fresh[:, None, :]) & (sims > last[at][:, :, None])
                    if apart:
                        use &= group[at][:, :, None] != group[at][:, None, :]
                    use[:, np.arange(size), np.arange(size)] = False
                    g, i, j = np.nonzero(use)
                    out[0].append(ids[at[g, i]])
                    out[1].append(ids[at[g, j]])
                    out[2].append(sims[g, i, j])
            if out[0]:
                yield _edges(*[np.concatenate(c) for c in out])

    found = ready.mapInArrow(join, _EDGES).filter("v <> u").withColumn("new", F.lit(1))
    return _best(graph.withColumn("new", F.lit(0)).unionByName(found), k)


def neighbour_graph(nodes: DataFrame, width: int, n: int, k: int, trees: int, rounds: int = ROUNDS, own: DataFrame | None = None, seed: int = 91) -> DataFrame:
    """``v``, ``u``, ``sim``, ``new``: lists of up to ``k`` near neighbours, with ``own`` of other
    components alone."""
    graph = materialize(_best(leaves(nodes, width, n, trees, k, own is not None, seed), k), "graph")
    for turn in range(rounds):
        last, graph = graph, materialize(descend(nodes, graph, width, k, turn, own), "graph")
        discard(last)
        if (graph.agg(F.sum("new")).first()[0] or 0) <= SETTLED * k * n:
            break
    return graph


def verified(nodes: DataFrame, pairs: DataFrame, width: int, threshold: float) -> DataFrame:
    """Pairs ``a``, ``b`` whose cosine in double precision reaches the threshold."""
    one = nodes.select(F.col("v").alias("a"), F.col("x").alias("xa"))
    two = nodes.select(F.col("v").alias("b"), F.col("x").alias("xb"))

    def check(batches):
        for b in batches:
            near = (_unit(_matrix(b.column("xa"), width)) * _unit(_matrix(b.column("xb"), width))).sum(axis=1) >= threshold
            yield pa.RecordBatch.from_arrays([b.column(c).filter(pa.array(near)) for c in ("a", "b")], names=["a", "b"])

    return pairs.join(one, "a").join(two, "b").select("a", "b", "xa", "xb").mapInArrow(check, "a long, b long")


def _close(graph: DataFrame, threshold: float) -> DataFrame:
    return graph.filter(F.col("sim") >= threshold - SLACK).select(F.least("v", "u").alias("a"), F.greatest("v", "u").alias("b")).distinct()


def linked_members(nodes: DataFrame, graph: DataFrame, width: int, threshold: float, k: int, trees: int) -> DataFrame:
    """``node``, ``component`` of all nodes with a link.

    A link that is in neither of its nodes' lists is between two saturated ones, so these alone
    are searched for links to other components. Every turn but the last merges components.
    """
    members = materialize(connected_components(verified(nodes, _close(graph, threshold), width, threshold)), "members")
    lists = graph.groupBy("v").agg(F.count("*").alias("n"), F.min("sim").alias("last"))
    full = materialize(lists.filter((F.col("n") >= k) & (F.col("last") >= threshold - SLACK)).select("v"), "saturated")
    own = graph.join(full, "v", "left_semi").join(full.select(F.col("v").alias("u")), "u", "left_semi").select("v", "u")
    for turn in count_from(1):
        labels = members.select(F.col("node").alias("v"), "component")
        some = materialize(nodes.join(full, "v", "left_semi").join(labels, "v", "left").select("v", "q", F.coalesce("component", "v").alias("component")), "saturated")
        n, groups = some.agg(F.count("*"), F.count_distinct("component")).first()
        if groups < 2:
            break
        outwards = neighbour_graph(some, width, n, k, trees, own=own, seed=91 + turn)
        found = materialize(verified(nodes, _close(outwards, threshold), width, threshold), "outward-links")
        if found.isEmpty():
            break
        members = materialize(connected_components(found.unionByName(members.select(F.col("node").alias("a"), F.col("component").alias("b")))), "members")
    return members


def link_counts(nodes: DataFrame, members: DataFrame, width: int, threshold: float) -> DataFrame:
    """``v``, ``links``: vectors within the threshold among each node's component."""
    return compared(nodes, members, width, threshold).groupBy("v").agg(F.sum("links").alias("links"))


_COUNTED = "v long, links long, root long"


def _count_near(table: pa.Table, cuts: np.ndarray, width: int, threshold: float, roots: bool) -> pa.RecordBatch:
    """Links of each row of groups of rows; ``side`` 0 meets side 1, side 2 meets itself."""
    ids, times, side = (table.column(c).to_numpy() for c in ("node", "times", "side"))
    u = _unit(_matrix(table.column("x"), width))
    links, root = np.zeros(len(ids), dtype=np.int64), ids.copy()
    for a, b in zip(cuts[:-1], cuts[1:]):
        if side[a] == 2:
            near = u[a:b] @ u[a:b].T >= threshold
            np.fill_diagonal(near, False)
            links[a:b] = near @ times[a:b]
            i = j = np.arange(a, b)
        else:
            i, j = a + np.flatnonzero(side[a:b] == 0), a + np.flatnonzero(side[a:b] == 1)
            near = u[i] @ u[j].T >= threshold
            links[i], links[j] = near @ times[j], near.T @ times[i]
        while roots and near.any():  # the smallest node reachable
            was = root[a:b].copy()
            root[i] = np.minimum(root[i], np.where(near, root[j][None, :], _NO_NODE).min(axis=1))
            root[j] = np.minimum(root[j], np.where(near, root[i][:, None], _NO_NODE).min(axis=0))
            if (root[a:b] == was).all():
                break
    return pa.RecordBatch.from_arrays([pa.array(ids), pa.array(links), pa.array(root)], names=["v", "links", "root"])


def compared(nodes: DataFrame, members: DataFrame, width: int, threshold: float, roots: bool = False) -> DataFrame:
    """``v``, ``links``, ``root``: for each node its linked vectors, in one or several rows.

    ``members`` has ``node`` and ``component``. A component of up to ``BLOCK`` nodes is compared
    at once. A larger one is cut into rings by the angle from its smallest node. By the triangle
    inequality, nodes of two rings are all linked if their largest angles together stay within
    the threshold's, and none is if the rings are further apart than that; both are settled by
    a sum over rings. What is left is compared in pairs of blocks, which emit counts and never
    a pair of nodes: a component all of whose members are close to one costs in proportion to
    its size, a loose one with its square. ``root`` is a node reachable in the group compared,
    the same for all that reach it, if ``roots``.
    """
    sized = materialize(members.groupBy("component").agg(F.count("*").alias("n"), F.min("node").alias("pivot")), "components")
    rows = members.join(sized, "component").join(nodes.select(F.col("v").alias("node"), "x", "times"), "node")

    def count(batches):
        for table, cuts in whole_groups(batches, "key"):
            yield _count_near(table, cuts, width, threshold, roots)

    columns = ["key", "side", "node", "x", "times"]

    def grouped(dealt: DataFrame) -> DataFrame:
        return hash_split(dealt.select(*columns), "key").sortWithinPartitions("key").mapInArrow(count, _COUNTED)

    small = grouped(rows.filter(F.col("n") <= BLOCK).select(F.col("component").alias("key"), F.lit(2).alias("side"), "node", "x", "times"))
    large = sized.filter(F.col("n") > BLOCK)
    if large.isEmpty():
        return small
    most = float(np.arccos(threshold))
    pivots = materialize(large.join(nodes.select(F.col("v").alias("pivot"), F.col("x").alias("px")), "pivot").select("component", "px"), "pivots")

    def measure(batches):
        for b in batches:
            near = (_unit(_matrix(b.column("x"), width)) * _unit(_matrix(b.column("px"), width))).sum(axis=1)
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in ("component", "pivot", "node", "x", "times")], pa.array(np.arccos(np.clip(near, -1, 1)))], names=["component", "pivot", "node", "x", "times", "angle"])

    turned = (
        rows.filter(F.col("n") > BLOCK).join(pivots, "component").select("component", "pivot", "node", "x", "times", "px").mapInArrow(measure, "component long, pivot long, node long, x array<double>, times long, angle double")
    )
    turned = materialize(turned.withColumn("ring", F.floor(F.col("angle") / most * RINGS).cast("int")), "turned")
    rings = materialize(turned.groupBy("component", "ring").agg(F.count("*").alias("n"), F.sum("times").alias("times"), F.min("angle").alias("lo"), F.max("angle").alias("hi")), "rings")
    rings = rings.withColumn("parts", F.ceil(F.col("n") / BLOCK))
    one = rings.select("component", *[F.col(c).alias("a_" + c) for c in ("ring", "parts", "times", "lo", "hi")])
    two = rings.select("component", *[F.col(c).alias("b_" + c) for c in ("ring", "parts", "times", "lo", "hi")])
    pairs = materialize(one.join(two, "component").withColumn("all", F.col("a_hi") + F.col("b_hi") <= most - ANGLE_SLACK), "ring-pairs")  # a row for two rings of a component
    sure = pairs.filter("all").groupBy("component", F.col("a_ring").alias("ring")).agg(F.sum("b_times").alias("links"), F.max((F.col("a_ring") == F.col("b_ring")).cast("int")).alias("own"))
    settled = turned.join(sure, ["component", "ring"]).select(F.col("node").alias("v"), (F.col("links") - F.col("own") * F.col("times")).alias("links"), F.col("pivot").alias("root"))
    apart = F.greatest(F.col("a_lo") - F.col("b_hi"), F.col("b_lo") - F.col("a_hi")) > most + ANGLE_SLACK
    upto = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    left = pairs.filter(~F.col("all") & ~apart & (F.col("a_ring") <= F.col("b_ring"))).withColumn("a_part", upto("a_parts")).withColumn("b_part", upto("b_parts"))
    left = left.filter((F.col("a_ring") < F.col("b_ring")) | (F.col("a_part") <= F.col("b_part")))
    itself = (F.col("a_ring") == F.col("b_ring")) & (F.col("a_part") == F.col("b_part"))
    tasks = materialize(left.select("component", "a_ring", "a_part", "b_ring", "b_part", itself.alias("itself"), F.monotonically_increasing_id().alias("key")), "block-pairs")
    dealt = turned.join(rings.select("component", "ring", "parts"), ["component", "ring"]).withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")))
    block = ["component", "ring", "part"]
    firsts = tasks.select("component", F.col("a_ring").alias("ring"), F.col("a_part").alias("part"), "key", F.when(F.col("itself"), 2).otherwise(0).alias("side"))
    seconds = tasks.filter("NOT itself").select("component", F.col("b_ring").alias("ring"), F.col("b_part").alias("part"), "key", F.lit(1).alias("side"))
    open_ = grouped(dealt.join(firsts.unionByName(seconds), block))
    return small.unionByName(settled).unionByName(open_)


def all_compared(nodes: DataFrame, width: int, threshold: float) -> tuple[DataFrame, DataFrame]:
    """Members and link counts from rings of all nodes: exact, and quadratic but for what the
    angles from one node leave out."""
    one = nodes.select(F.col("v").alias("node"), F.lit(0).cast("long").alias("component"))
    found = materialize(compared(nodes, one, width, threshold, roots=True).filter("links > 0"), "all-compared")
    members = materialize(connected_components(found.select(F.col("v").alias("a"), F.col("root").alias("b"))), "members")
    return members, found.groupBy("v").agg(F.sum("links").alias("links"))


def audit(nodes: DataFrame, counts: DataFrame, width: int, threshold: float, close: DataFrame | None = None, sample: int = AUDITED) -> float:
    """Mean share of a node's links, found by comparing it with every node, that are counted.

    Takes random nodes and as many of those in ``close``, a table of pairs ``a``, ``b``. Of
    nodes without a link there is nothing to find.
    """
    chosen = nodes.orderBy(F.xxhash64("v"), "v").limit(sample).select("v")
    if close is not None:
        ends = close.select(F.explode(F.array("a", "b")).alias("v")).distinct()
        chosen = chosen.unionByName(ends.orderBy(F.xxhash64("v"), "v").limit(sample)).distinct()
    chosen = nodes.join(F.broadcast(chosen), "v", "left_semi").select("v", "x").toArrow()
    ids = chosen.column("v").to_numpy()
    if not len(ids):
        return 1.0
    u = _unit(_matrix(chosen.column("x"), width))

    def scan(batches):
        total = np.zeros(len(ids), dtype=np.int64)
        for b in (b.slice(at, 2048) for b in batches for at in range(0, b.num_rows, 2048)):
            near = u @ _unit(_matrix(b.column("x"), width)).T >= threshold
            near &= ids[:, None] != b.column("v").to_numpy(zero_copy_only=False)[None, :]
            total += near @ b.column("times").to_numpy(zero_copy_only=False)
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(total)], names=["v", "links"])

    true = nodes.select("v", "x", "times").mapInArrow(scan, "v long, links long").groupBy("v").agg(F.sum("links").alias("all"))
    share = true.filter(F.col("all") > 0).join(counts, "v", "left").agg(F.avg(F.coalesce("links", F.lit(0)) / F.col("all"))).first()[0]
    return 1.0 if share is None else share


def near_duplicates(vectors: DataFrame, threshold: float = 0.95, vec_id: str = "vec_id", embedding: str = "embedding", k: int = LISTS, trees: int = TREES, recall: float = RECALL) -> DataFrame:
    """``vec_id``, ``n_links``, ``component_id``, ``kept`` for each vector.

    Vectors link at a cosine of ``threshold`` or more, in double precision. ``n_links`` counts
    the other vectors linked directly, ``component_id`` is the smallest vec_id reachable, and
    ``kept`` says whether that is the vector's own. Vectors that are null or empty, zero, or
    hold null or non-finite components link with nothing and are kept; so does a row with a
    null vec_id, which has no component and isn't kept. Wholly repeated rows are one vector and
    are returned once; a vec_id with two different vectors has a row for each. A shorter vector
    counts as ending in zeros. Other columns aren't read; an empty table gives an empty result.
    """
    e = F.col("x")
    usable = e.isNotNull() & F.col("vec_id").isNotNull() & F.forall(e, lambda y: y.isNotNull() & ~F.isnan(y) & (F.abs(y) < float("inf"))) & F.exists(e, lambda y: y != 0)
    rows = materialize(
        vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.transform(F.col(embedding), lambda y: y.cast("double") + 0.0).alias("x"))
        .distinct()
        .withColumns({"ok": F.coalesce(usable, F.lit(False)), "h": F.xxhash64("x")}),  # sorts fast where x is joined on
        "vectors",
    )
    good = rows.filter("ok")
    n, width = good.agg(F.count("*"), F.max(F.size("x"))).first()
    alone = rows.filter("NOT ok").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.col("vec_id").isNotNull().alias("kept"))
    if not n:
        return alone

    def quantise(batches):
        for b in batches:
            q = _bytes(_unit(_matrix(b.column("x"), width)))
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in ("v", "h", "x", "least_id", "times")], pa.array([r.tobytes() for r in q], pa.binary())], names=["v", "h", "x", "least_id", "times", "q"])

    # equal vectors are one node, numbered by its smallest id; where two vectors have one id, by
    # a hash of the vector
    classes = good.groupBy("h", "x").agg(F.min("vec_id").alias("least_id"), F.count("*").alias("times"))
    for number in (F.col("least_id"), F.xxhash64("x"), F.xxhash64("x", F.lit(1))):
        numbered = classes.select(number.alias("v"), "h", "x", "least_id", "times")
        nodes = materialize(numbered.mapInArrow(quantise, "v long, h long, x array<double>, least_id long, times long, q binary"), "nodes")
        size, numbers = nodes.agg(F.count("*"), F.count_distinct("v")).first()
        if size == numbers:
            break
    else:
        raise ValueError("vectors share ids and hashes")
    deeper = max(0, int(np.ceil(np.log2(size / 2**16))))  # deeper trees miss more, so there are more of them
    trees += deeper
    sample = max(AUDITED, min(AUDITED_MOST, int(np.sqrt(size))))
    for _ in range(ATTEMPTS):
        graph = neighbour_graph(nodes, width, size, k, trees, ROUNDS + deeper)
        members = linked_members(nodes, graph, width, threshold, k, trees)
        counts = materialize(link_counts(nodes, members, width, threshold), "link-counts")
        if audit(nodes, counts, width, threshold, _close(graph, threshold), sample) >= recall:
            break
        k, trees = 2 * k, 2 * trees
    else:
        members, counts = all_compared(nodes, width, threshold)
    placed = nodes.select("v", "h", "x", "least_id", "times").join(members, F.col("v") == F.col("node"), "left").withColumn("label", F.coalesce("component", "v"))
    names = materialize(placed.groupBy("label").agg(F.min("least_id").alias("component_id")), "names")
    known = placed.join(names, "label").join(counts, "v", "left").select("h", "x", "component_id", (F.coalesce("links", F.lit(0)) + F.col("times") - 1).alias("n_links"))
    known = materialize(known, "known")
    linked = good.join(known, ["h", "x"]).select("vec_id", "n_links", "component_id", (F.col("vec_id") == F.col("component_id")).alias("kept"))
    return linked.unionByName(alone)
