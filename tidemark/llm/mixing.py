"""Mixing sources to target weights by Pfair scheduling, in DataFrame and SQL functions only.

Every source is cut into blocks of documents. With whole-number weights that sum to H, block k
(from 0) of a source of weight a is released at slot floor(k H / a) and due by slot
ceil((k + 1) H / a). Earliest-deadline-first over these windows gives one period of H slots in
which, after every slot t, each source has had more than t a / H - 1 and fewer than
t a / H + 1 blocks; the period then repeats. Once a source has no block left its slots are
passed over and the others go on in the same order, so all documents keep a place.

The place of a block follows from its period, its slot and how many blocks each source has, so
there is no global sort and no window over a source's documents: ranks within a source are
counted in buckets of bounded size and joined by prefix sums of their counts, a row for each
bucket. A period is worked out in one task, in time that grows with the square of its slots.
"""

from __future__ import annotations

from functools import reduce
from math import gcd

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import materialize, shuffle_partitions

#: Documents of a block.
BLOCK = 32
#: Slots of a period, where weights are derived from counts.
PERIOD = 1000
#: Documents of a bucket in which ranks are counted, about; a source has as many as it needs.
BUCKET = 2_000
#: Documents of a partition of the ordered result, at most about.
PART = 20_000
#: Numbers of a period's table up to which it is sent to every executor (8 bytes each).
BROADCAST_NUMBERS = 2_000_000
#: Files up to which their sizes are sent to every executor.
BROADCAST_FILES = 200_000


def _weights_from_counts(counts: DataFrame, period: int, power: float) -> DataFrame:
    share = F.pow(F.col("n").cast("double"), power)
    total = F.sum(share).over(Window.partitionBy())  # a row for each source
    return counts.withColumn("a", F.greatest(F.lit(1), F.round(period * share / total)).cast("int"))


def _given(weights: dict[str, int]) -> Column:
    if any(int(w) != w or w < 1 for w in weights.values()):
        raise ValueError("weights are whole numbers of at least 1")
    d = reduce(gcd, map(int, weights.values()))
    pairs = [x for k, w in sorted(weights.items()) for x in (F.lit(k), F.lit(int(w) // d))]
    return F.create_map(*pairs)


def schedule(table: DataFrame) -> DataFrame:
    """``i``, ``k``, ``before``: one period for the single row of weights in ``table.a``.

    ``k`` numbers the blocks of source ``i`` within the period from 0; ``before`` tells how
    many blocks each source had before that slot.
    """

    def step(s: Column, t: Column) -> Column:
        due = F.transform(
            F.arrays_zip(s["c"].alias("c"), F.col("a")),
            lambda x, i: F.when(
                (x["c"] < x["a"]) & (F.floor(x["c"].cast("long") * F.col("h") / x["a"]) <= t),
                F.struct(F.ceil((x["c"] + 1).cast("long") * F.col("h") / x["a"]).alias("d"), i.alias("i")),
            ),
        )
        pick = F.array_min(due)["i"]  # the earliest deadline; ties go to the first source
        return F.transform(
            F.array(pick),
            lambda p: F.struct(
                F.transform(s["c"], lambda c, i: F.when(i == p, c + 1).otherwise(c)).alias("c"),
                F.concat(s["o"], F.array(F.struct(p.alias("i"), s["c"].alias("before")))).alias("o"),
            ),
        )[0]

    start = F.struct(F.transform("a", lambda x: F.lit(0)).alias("c"), F.array().cast("array<struct<i:int,before:array<int>>>").alias("o"))
    timed = table.withColumn("h", F.aggregate("a", F.lit(0), lambda s, x: s + x))
    slots = timed.select(F.explode(F.aggregate(F.sequence(F.lit(0), F.col("h") - 1), start, step)["o"]).alias("x"))
    return slots.select("x.i", F.element_at("x.before", F.col("x.i") + 1).alias("k"), "x.before")


def mix(docs: DataFrame, weights: dict[str, int] | None = None, doc_id: str = "doc_id", source: str = "source", block: int = BLOCK, period: int = PERIOD, power: float = 0.5, position: str = "mix_position") -> DataFrame:
    """``docs`` with ``position``, each row's place in the mixed order, from 0 without gaps.

    ``weights`` are whole numbers by source, common divisors taken out; a source without one
    has weight 1. Without weights a source's is in proportion to its number of documents to
    the ``power``, in ``period`` parts, at least one. Within a source documents come in the
    order of a hash of their id. A null source is a source of its own; null ids, repeated rows
    and null or empty texts keep a place of their own; an empty table gives an empty result; a
    column already named ``position`` is replaced.
    """
    base = docs.drop(position)
    total = base.select(doc_id).count()
    if not total:
        return base.withColumn(position, F.lit(0).cast("long"))
    key = F.coalesce(F.concat(F.lit("="), F.col(source).cast("string")), F.lit(""))
    hashed = F.xxhash64(F.col(doc_id))
    counts = base.groupBy(key.alias("s")).agg(F.count("*").alias("n"))
    if weights:
        weighted = counts.withColumn("a", F.coalesce(F.try_element_at(_given(weights), F.substring("s", 2, 1 << 30)), F.lit(1)))
    else:
        weighted = _weights_from_counts(counts, period, power)
    weighted = weighted.withColumn("buckets", F.ceil(F.col("n") / BUCKET))
    one = weighted.agg(F.sort_array(F.collect_list(F.struct("s", "n", "a"))).alias("x")).select(F.col("x.s").alias("names"), F.col("x.n").alias("sizes"), F.col("x.a").alias("a"))
    numbers = one.select(F.size("a").cast("long") * F.aggregate("a", F.lit(0), lambda s, x: s + x)).first()[0]
    sent = F.broadcast if numbers <= BROADCAST_NUMBERS else (lambda df: df)
    places = sent(
        schedule(one)
        .withColumn("one", F.lit(1))
        .join(one.select(F.lit(1).alias("one"), "names", "sizes", "a"), "one")
        .select(F.element_at("names", F.col("i") + 1).alias("s"), "k", "before", "sizes", "a")
    )
    few = sent(weighted.select("s", F.col("a").alias("own"), "buckets"))
    bucket = F.pmod(F.shiftright("h", 16), F.col("buckets"))
    row = F.struct(*[F.col(f"`{c}`") for c in base.columns]).alias("row")
    dealt = base.select(key.alias("s"), hashed.alias("h"), row).join(few, "s").withColumn("b", bucket)
    # sizes of buckets read the id and the source alone
    sizes = base.select(key.alias("s"), hashed.alias("h")).join(few, "s").groupBy("s", bucket.alias("b")).agg(F.count("*").alias("n"))
    before_bucket = Window.partitionBy("s").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    skips = sizes.withColumn("skip", F.coalesce(F.sum("n").over(before_bucket), F.lit(0))).select("s", "b", "skip")
    rank = F.row_number().over(Window.partitionBy("s", "b").orderBy("h", F.col(f"row.`{doc_id}`"))) - 1
    at = F.col("rank") % block
    ranked = (
        dealt.withColumn("rank", rank)
        .join(skips, ["s", "b"])
        .withColumn("rank", F.col("rank") + F.col("skip"))
        .withColumn("blk", F.floor(F.col("rank") / block))
        .withColumn("period", F.floor(F.col("blk") / F.col("own")))
        .withColumn("k", (F.col("blk") - F.col("period") * F.col("own")).cast("int"))
    )
    given = F.zip_with("a", "before", lambda a, b: (F.col("period") * a + b) * block)
    ahead = F.aggregate(F.zip_with("sizes", given, lambda n, x: F.least(n, x)), F.lit(0).cast("long"), lambda s, x: s + x)
    return ranked.join(places, ["s", "k"]).select("row.*", (ahead + at).cast("long").alias(position))


def mixed_order(docs: DataFrame, weights: dict[str, int] | None = None, doc_id: str = "doc_id", source: str = "source") -> DataFrame:
    """``docs`` dealt out in the mixed order: partition after partition, sorted within each.

    Rows that repeat, and those with null ids, sources or texts, keep a place each; an empty
    table gives an empty result. Columns are those of ``docs``.
    """
    names, position = docs.columns, "mix_position"
    while position in names:
        position += "_"
    total = docs.select(doc_id).count()
    parts = max(1, min(total, max(shuffle_partitions(docs.sparkSession), -(-total // PART))))
    placed = mix(docs, weights, doc_id, source, position=position)
    part = F.least(F.floor(F.col(position) * parts / max(1, total)), F.lit(parts - 1)).cast("int")
    return placed.repartitionById(parts, part).sortWithinPartitions(position).select(*[F.col(f"`{c}`") for c in names])


def place_in_files(docs: DataFrame, position: str = "mix_position") -> DataFrame:
    """``docs``, read from Parquet files, with each row's place in them, from 0 without gaps:
    files by the number of the partition that wrote them, rows as they lie.

    So what :func:`mixed_order` gave is found again after it was written, though files are read
    in any order. Rows are counted by file, and no row moves. A column already named
    ``position`` is replaced; an empty table gives an empty result; a table that isn't read
    from files has no such order and raises.
    """
    file, names = F.col("_metadata.file_path"), [c for c in docs.columns if c != position]
    lying = docs.select(*[F.col(f"`{c}`") for c in names], file.alias("__file"), F.col("_metadata.row_index").alias("__row"))
    number = F.regexp_extract("__file", "part-([0-9]+)[^/]*$", 1).try_cast("long")
    before = Window.orderBy(number, "__file").rowsBetween(Window.unboundedPreceding, -1)  # a row for each file
    sizes = lying.groupBy("__file").agg(F.count("*").alias("n"))
    skips = materialize(sizes.select("__file", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__skip")), "files")
    sent = F.broadcast(skips) if skips.count() <= BROADCAST_FILES else skips
    return lying.join(sent, "__file").select(*[F.col(f"`{c}`") for c in names], (F.col("__skip") + F.col("__row")).alias(position))
