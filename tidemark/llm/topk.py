"""Exact top-k search by inner product over a pivot-distance index.

Equal vectors are one class, which carries its smallest ids; queries with equal vectors ask
once. Classes fall into levels by their largest component, a factor of 2**10 each, so that a
few huge vectors don't blur the index of the others. In a level, vectors are lifted by one
coordinate so that all have the largest norm of the level; inner products then rank as
Euclidean distances do. Every vector is keyed by its nearest pivot and by the annulus around
that pivot its distance falls in, and annuli are cut by distance into blocks. A query, brought
to the norm of a level, first visits the blocks nearest to its own distances, which gives a
lower bound of its k-th score; then, by the triangle inequality,
|d(q, p) - d(x, p)| <= d(q, x), all blocks whose best possible score is below the bound are
passed over and the rest are visited. The result is exact.

Sizes: pivots are fitted on at most ``SAMPLE`` vectors of level 0 and ``SAMPLE // 8`` of each
other level; the annuli, at most ``SAMPLE // 8`` a level, are described on the driver by a row
each. Blocks are a table: their number grows with the vectors, and a task compares a block of
about ``BLOCK`` vectors with a block of queries.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import materialize

#: Vectors the pivots are fitted on, those with the smallest hash.
SAMPLE = 4096
PIVOTS = 32
#: Vectors of a block, and queries, that are compared at once, about.
BLOCK = 2048
QUERY_BLOCK = 512
#: Bits between the largest components of one level and the next.
LEVEL_BITS = 10
#: Scores from here on don't fit a long.
_LONG = 2**63 - 1


@dataclass
class Index:
    """Pivots and annuli of one level; vectors are in units of the level."""

    pivots: np.ndarray  # lifted, one a row
    edges: list[np.ndarray]  # inner borders of the annuli of each pivot
    first: np.ndarray  # number of the first annulus of each pivot
    top: float  # largest squared norm
    unit: float

    def lifted(self, x: np.ndarray) -> np.ndarray:
        return np.hstack([x, np.sqrt(np.maximum(self.top - (x**2).sum(1), 0))[:, None]])

    def distances(self, lifted: np.ndarray) -> np.ndarray:
        d = (lifted**2).sum(1)[:, None] + (self.pivots**2).sum(1)[None, :] - 2 * lifted @ self.pivots.T
        return np.sqrt(np.maximum(d, 0))

    def place(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Annulus and distance from its pivot of each vector."""
        d = self.distances(self.lifted(x))
        near = d.argmin(1)
        dist = d[np.arange(len(x)), near]
        ring = np.empty(len(x), dtype=np.int64)
        for p in np.unique(near):
            at = near == p
            ring[at] = self.first[p] + np.searchsorted(self.edges[p], dist[at], "right")
        return ring, dist

    @property
    def rings(self) -> int:
        return sum(len(e) + 1 for e in self.edges)


def _fit(sample: np.ndarray, top: float, unit: float, rows: int, block: int, begin: int) -> Index:
    """Pivots by farthest-first choice and two rounds of means; borders by sample quantiles."""
    index = Index(np.zeros((0, 0)), [], np.zeros(0, int), top, unit)
    x = index.lifted(sample)
    chosen, far = [0], np.full(len(x), np.inf)
    while len(chosen) < min(PIVOTS, len(x)):
        far = np.minimum(far, ((x - x[chosen[-1]]) ** 2).sum(1))
        if far.max() <= 0:
            break
        chosen.append(int(far.argmax()))
    pivots = x[chosen]
    for _ in range(2):
        near = (((pivots**2).sum(1)[None, :]) - 2 * x @ pivots.T).argmin(1)
        pivots = np.stack([x[near == p].mean(0) if (near == p).any() else pivots[p] for p in range(len(pivots))])
    index.pivots = pivots
    d = index.distances(x)
    near, wanted = d.argmin(1), max(1, rows // block)
    counts = []
    for p in range(len(pivots)):
        own = d[near == p, p]
        n = int(max(1, min(len(own) // 8, round(wanted * len(own) / len(x)))))
        index.edges.append(np.unique(np.quantile(own, np.arange(1, n) / n)) if n > 1 else np.zeros(0))
        counts.append(len(index.edges[-1]) + 1)
    index.first = begin + np.r_[0, np.cumsum(counts)[:-1]]
    return index


def _matrix(values: pa.Array, width: int) -> np.ndarray:
    """Rows of a list column as one matrix of doubles; shorter vectors end in zeros."""
    flat, lengths = values.flatten().to_numpy(zero_copy_only=False).astype(np.float64), pc.list_value_length(values).to_numpy(zero_copy_only=False)
    if (lengths == width).all():
        return flat.reshape(len(lengths), width)
    out = np.zeros((len(lengths), width))
    out[np.repeat(np.arange(len(lengths)), lengths), np.concatenate([np.arange(n) for n in lengths] or [[]]).astype(int)] = flat
    return out


def _steps(x: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) as doubles, which are exact; infinite where that is beyond them."""
    with np.errstate(over="ignore"):
        return np.floor(x * scale)


def _whole(x: float, scale: int) -> int:
    """floor(scale * x) as an integer of any size."""
    return int(x) * scale if abs(x) >= 2**53 else math.floor(x * scale)


def _in_units(x: np.ndarray, scale: int, unit: float) -> np.ndarray:
    return np.where(np.abs(x) < 2**40, _steps(x, scale) / scale, x) / unit


def _sortable(n: int) -> bytes:
    """Bytes that compare as the integers do."""
    m = abs(n).to_bytes((abs(n).bit_length() + 7) // 8, "big")
    m = len(m).to_bytes(4, "big") + m
    return b"\x01" + m if n >= 0 else b"\x00" + bytes(255 - c for c in m)


def _float(n: int) -> float:
    try:
        return float(n)
    except OverflowError:
        return math.inf if n > 0 else -math.inf


_SCORED = "score long, big binary, approx double"


def _best(q: np.ndarray, x: np.ndarray, least: np.ndarray, k: int, scale: int) -> tuple[list[np.ndarray], list[pa.Array]]:
    """Of each query's k best classes of a block (ties to the smaller least id): query, class,
    and the columns of ``_SCORED``."""
    y, z = _steps(q, scale), _steps(x, scale)
    width, peak = max(1, q.shape[1]), float(np.abs(y).max(initial=0)) * float(np.abs(z).max(initial=0))
    fits = width * peak < 2**62
    if fits:
        kind = np.float64 if width * peak < 2**53 else np.int64
        scores, slack = (y.astype(kind) @ z.astype(kind).T).astype(np.int64), 0
    else:  # doubles find what can be among the best, integers of any size decide
        a, b = np.abs(q).max(initial=0) or 1.0, np.abs(x).max(initial=0) or 1.0
        scores = (_in_units(q, scale, 1.0) / a) @ (_in_units(x, scale, 1.0) / b).T
        slack = width * 2.0**-48
        left, right = ([[_whole(c, scale) for c in r] for r in m] for m in (q.tolist(), x.tolist()))
    rows, classes, exact = [], [], []
    for i in range(len(q)):
        s = scores[i]
        cand = np.arange(len(s)) if len(s) <= k else np.flatnonzero(s >= np.partition(s, len(s) - k)[len(s) - k] - slack)
        if fits:
            cand = cand[np.lexsort((least[cand], -s[cand]))][:k]
            exact.append(s[cand])
        else:
            found = sorted((-sum(map(int.__mul__, left[i], right[j])), int(least[j]), int(j)) for j in cand)[:k]
            cand = np.array([j for _, _, j in found], dtype=np.int64)
            exact += [-s for s, _, _ in found]
        rows.append(np.full(len(cand), i))
        classes.append(cand)
    where = [np.concatenate(rows), np.concatenate(classes)]
    if fits:
        score = np.concatenate(exact)
        return where, [pa.array(score), pa.nulls(len(score), pa.binary()), pa.array(score.astype(np.float64))]
    far = [abs(s) >= _LONG for s in exact]
    kept = [s if not f else _LONG if s > 0 else -_LONG - 1 for s, f in zip(exact, far)]
    return where, [pa.array(kept, pa.int64()), pa.array([_sortable(s) if f else None for s, f in zip(exact, far)], pa.binary()), pa.array([_float(s) for s in exact], pa.float64())]


def usable_vectors(vectors: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    """``vec_id`` and ``v`` of the rows that take part, components as they are or as doubles."""
    e = F.col(embedding)
    finite = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    element = vectors.schema[embedding].dataType.elementType.simpleString()
    return vectors.filter(F.col(vec_id).isNotNull() & e.isNotNull() & finite).select(
        F.col(vec_id).cast("long").alias("vec_id"), F.transform(e, lambda x: x.cast("float" if element == "float" else "double") + F.lit(0).cast("byte")).alias("v")
    )


def top_k(vectors: DataFrame, is_query: Column | None = None, k: int = 10, vec_id: str = "vec_id", embedding: str = "embedding", scale: int = 1024) -> DataFrame:
    """``query_id``, ``rank``, ``vec_id``, ``score``: each query's k best other vectors.

    ``is_query`` is a condition on the column ``vec_id``; by default ids divisible by 100. Score
    is the integer inner product of floor(scale * x), exact whatever its size; one beyond a long
    is ranked as it is and returned as the nearest long. Equal scores rank by smaller vec_id; a
    query with fewer than k others gets all. Rows with a null id or vector, or null or
    non-finite components, take no part. Repeated rows count each time, as candidates and as
    queries, whose answers are ranked together; a query never meets rows of its own id. A
    shorter vector counts as ending in zeros. An empty table gives an empty result.
    """
    spark = vectors.sparkSession
    rows = materialize(usable_vectors(vectors, vec_id, embedding).groupBy("v", "vec_id").agg(F.count("*").alias("n")), "vectors")
    asking = rows.filter(F.col("vec_id") % 100 == 0 if is_query is None else is_query)
    # of k + most entries of a list, at most ``most`` are a query's own
    most = asking.groupBy("vec_id").agg(F.count("*").alias("m")).agg(F.max("m")).first()[0]
    if not most:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    long = k + most
    smallest = F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))
    peak = F.array_max(F.transform("v", lambda x: F.abs(x.cast("double"))))
    level = F.when(peak > 1, F.least(F.ceil(F.log2(peak) / LEVEL_BITS), F.lit(1020 // LEVEL_BITS))).otherwise(0).cast("int")  # units are doubles
    classes = materialize(
        rows.withColumn("r", smallest)
        .filter(F.col("r") <= long)
        .groupBy("v")
        .agg(F.sort_array(F.collect_list(F.struct("vec_id", F.least("n", F.lit(k)).alias("n")))).alias("ids"))  # at most ``long``
        .withColumn("level", level),
        "classes",
    )
    unit = F.pow(F.lit(2.0), LEVEL_BITS * F.col("level"))
    square = F.aggregate("v", F.lit(0.0), lambda a, x: a + F.pow((F.abs(x.cast("double")) + 1 / scale) / unit, 2))
    sizes = classes.groupBy("level").agg(F.count("*").alias("rows"), F.max(F.size("v")).alias("width"), F.max(square).alias("top")).orderBy("level").collect()  # 205 at most
    width = max(s.width for s in sizes)
    chance = Window.partitionBy("level").orderBy(F.xxhash64("v"), "v")
    sample = classes.select("level", "v", F.row_number().over(chance).alias("r")).filter(F.col("r") <= SAMPLE).filter((F.col("level") == 0) | (F.col("r") <= SAMPLE // 8)).toArrow()
    sample_level = sample.column("level").to_numpy()
    indexes: dict[int, Index] = {}
    for s in sizes:
        one = _matrix(sample.column("v").combine_chunks().filter(pa.array(sample_level == s.level)), width)
        step = 2.0 ** (LEVEL_BITS * s.level)
        indexes[s.level] = _fit(_in_units(one, scale, step), s.top, step, s.rows, BLOCK, sum(i.rings for i in indexes.values()))

    def place(batches):
        for b in batches:
            levels, x = b.column("level").to_numpy(), _matrix(b.column("v"), width)
            ring, dist = np.zeros(len(x), np.int64), np.zeros(len(x))
            for n in np.unique(levels):
                at = levels == n
                ring[at], dist[at] = indexes[n].place(_in_units(x[at], scale, indexes[n].unit))
            yield pa.RecordBatch.from_arrays([b.column("v"), b.column("ids"), pa.array(ring), pa.array(dist)], names=["v", "ids", "ring", "dist"])

    vtype = classes.schema["v"].dataType.simpleString()
    placed = materialize(classes.mapInArrow(place, f"v {vtype}, ids array<struct<vec_id:long,n:long>>, ring long, dist double"), "placed")
    annuli = placed.groupBy("ring").agg(F.count("*").alias("n"), F.min("dist").alias("lo"), F.max("dist").alias("hi"))
    stats = annuli.orderBy("ring").toPandas()  # SAMPLE // 8 a level at most
    level_of = np.concatenate([np.full(i.rings, n) for n, i in indexes.items()])[stats["ring"]]
    ring_ids, ring_n, lo, hi = (stats[c].to_numpy() for c in ("ring", "n", "lo", "hi"))
    # a block is a part of an annulus by distance, and where distances crowd by chance
    frame = spark.createDataFrame(pd.DataFrame({"ring": ring_ids, "lo": lo, "step": np.maximum(hi - lo, 1e-300), "cuts": -(-ring_n // BLOCK)}))
    cut = F.least(F.floor((F.col("dist") - F.col("lo")) / F.col("step") * F.col("cuts")), F.col("cuts") - 1)
    dealt = placed.join(F.broadcast(frame), "ring").select("ring", cut.alias("cut"), "v", "ids", "dist")
    cuts = materialize(dealt.groupBy("ring", "cut").agg(F.count("*").alias("n"), F.min("dist").alias("lo"), F.max("dist").alias("hi")).withColumn("parts", F.ceil(F.col("n") / BLOCK)), "cuts")
    place_of = ["ring", "cut", "part"]
    packed = (
        dealt.join(cuts.select("ring", "cut", "parts"), ["ring", "cut"])
        .groupBy("ring", "cut", F.pmod(F.xxhash64("v"), F.col("parts")).alias("part"))
        .agg(F.collect_list(F.struct("v", "ids")).alias("m"))
        .select(*place_of, F.col("m.v").alias("vs"), F.col("m.ids").alias("ids"))
    )
    packed = materialize(packed, "blocks")
    blocks = cuts.select("ring", "cut", "lo", "hi", (F.col("n") / F.col("parts")).alias("n"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"))
    asked = materialize(asking.select("v").distinct().withColumn("level", level).withColumn("query", F.monotonically_increasing_id()), "queries")
    n_query_blocks = max(1, -(-asked.count() // QUERY_BLOCK))

    def reach(b):
        """For each query (row) and annulus (column): distance from the pivot, the best possible
        score next to it, and what that falls by with the square of the gap."""
        raw, levels = _matrix(b.column("v"), width), b.column("level").to_numpy(zero_copy_only=False)
        own = 2.0 ** (LEVEL_BITS * levels.astype(np.float64))
        q = _in_units(raw, scale, 1.0) / own[:, None]
        norm = np.sqrt((q**2).sum(1))
        d, half, factor = (np.empty((len(q), len(ring_ids))) for _ in range(3))
        for n, index in indexes.items():
            at = level_of == n
            grow = np.where(norm > 0, np.sqrt(index.top) / np.where(norm > 0, norm, 1), 1.0)
            x = q * grow[:, None]
            pivot = np.searchsorted(index.first, ring_ids[at], "right") - 1
            d[:, at] = index.distances(np.hstack([x, np.zeros((len(x), 1))]))[:, pivot]
            half[:, at] = ((index.top + (x**2).sum(1)) / 2 + 1e-6 * (index.top + 1))[:, None]
            factor[:, at] = (float(scale) ** 2 * own * index.unit / grow)[:, None]
        return d, half, factor

    def bounds(d, half, factor):
        gap = np.maximum(0, np.maximum(d - hi[None, :], lo[None, :] - d))
        with np.errstate(over="ignore", invalid="ignore"):
            return np.nan_to_num((half - gap**2 / 2) * factor, nan=np.inf, posinf=np.inf, neginf=-np.inf)

    need = max(4 * long, BLOCK)
    visit = "query long, ring long, d double, half double, factor double"

    def emit(b, take, *columns):
        i, j = np.nonzero(take)
        return pa.RecordBatch.from_arrays([b.column("query").take(pa.array(i)), pa.array(ring_ids[j], pa.int64()), *[pa.array(c[i, j]) for c in columns]], names=["query", "ring", "d", "half", "factor"])

    def first(batches):
        """The most promising annuli until enough vectors are met."""
        for b in batches:
            known = reach(b)
            order = np.argsort(-bounds(*known), axis=1, kind="stable")
            met = np.cumsum(ring_n[order], axis=1)
            take = np.zeros(order.shape, dtype=bool)
            np.put_along_axis(take, order, (met - ring_n[order]) < need, axis=1)
            yield emit(b, take, *known)

    def later(batches):
        for b in batches:
            known = reach(b)
            bar = b.column("bar").to_numpy(zero_copy_only=False).astype(np.float64)
            yield emit(b, bounds(*known) >= np.where(np.isnan(bar), -np.inf, bar)[:, None], *known)

    gap = F.greatest(F.lit(0.0), F.col("d") - F.col("hi"), F.col("lo") - F.col("d"))
    best = (F.col("half") - gap * gap / 2) * F.col("factor")
    best = F.when(F.isnan(best), float("inf")).otherwise(best).alias("best")

    def scored(visits: DataFrame) -> DataFrame:
        queries = (
            visits.join(asked.select("query", "v"), "query")
            .groupBy(*place_of, F.pmod(F.xxhash64("query"), F.lit(n_query_blocks)).alias("qb"))
            .agg(F.collect_list(F.struct("query", "v")).alias("q"))
            .select(*place_of, F.col("q.query").alias("queries"), F.col("q.v").alias("qs"))
        )

        def compare(batches):
            for b in batches:
                for i in range(b.num_rows):
                    qids, ids = b.column("queries")[i].values, b.column("ids")[i].values
                    q, x = (_matrix(b.column(c)[i].values, width) for c in ("qs", "vs"))
                    firsts = ids.flatten().field("vec_id").to_numpy()[ids.offsets.to_numpy()[:-1] - ids.offsets[0].as_py()]
                    (row, at), columns = _best(q, x, firsts, long, scale)
                    yield pa.RecordBatch.from_arrays([qids.take(pa.array(row)), ids.take(pa.array(at)), *columns], names=["query", "ids", "score", "big", "approx"])

        found = queries.join(packed, place_of).select("queries", "qs", "vs", "ids").mapInArrow(compare, f"query long, ids array<struct<vec_id:long,n:long>>, {_SCORED}")
        return found.select("query", F.inline("ids"), "score", "big", "approx")

    order = [F.desc("score"), F.desc("big"), F.asc("vec_id")]
    best_of = Window.partitionBy("query").orderBy(*order)

    def shortlist(found: DataFrame) -> DataFrame:
        return found.withColumn("r", F.row_number().over(best_of)).filter(F.col("r") <= long)

    nearest = Window.partitionBy("query").orderBy(F.desc("best"), *place_of)
    started = materialize(
        asked.mapInArrow(first, visit)
        .join(blocks, "ring")
        .select("query", *place_of, "n", best)
        .withColumn("met", F.sum("n").over(nearest.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("n"))
        .filter(F.col("met") < need)
        .select("query", *place_of),
        "first-visits",
    )
    near = materialize(shortlist(scored(started)), "first-found")
    bars = near.filter(F.col("r") == long).select("query", F.col("approx").alias("bar"))
    rest = (
        asked.join(bars, "query", "left")
        .mapInArrow(later, visit)
        .join(blocks, "ring")
        .join(bars, "query", "left")
        .filter(best >= F.coalesce("bar", F.lit(float("-inf"))))
        .select("query", *place_of)
        .join(started, ["query", *place_of], "left_anti")
    )
    lists = materialize(shortlist(near.drop("r").unionByName(scored(rest))), "found")
    who = asking.join(asked, "v").select("query", F.col("vec_id").alias("query_id"), F.col("n").alias("times"))
    answers = (
        who.join(lists, "query")
        .filter("vec_id <> query_id")
        .withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.least(F.col("n") * F.col("times"), F.lit(k).cast("long")))))
        .withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order)))
    )
    return answers.filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
