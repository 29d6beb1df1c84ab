import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tidemark.llm import mixing


def simulate(weights):
    """Earliest deadline first, slot by slot."""
    h, c, out = sum(weights), [0] * len(weights), []
    for t in range(h):
        due = [(math.ceil((c[i] + 1) * h / a), i) for i, a in enumerate(weights) if c[i] < a and c[i] * h // a <= t]
        i = min(due)[1]
        out.append((i, c[i], list(c)))
        c[i] += 1
    return out


@pytest.mark.parametrize("weights", [[1], [3, 1], [7, 2, 1], [50, 30, 15, 4, 1], [13, 11, 7, 5, 3, 3, 2, 1, 1]])
def test_schedule(spark, weights):
    got = [(r.i, r.k, r.before) for r in mixing.schedule(spark.createDataFrame([(weights,)], "a array<int>")).collect()]
    assert got == simulate(weights)
    h = sum(weights)
    for t, (_, _, before) in enumerate(got):
        assert all(abs(c - t * a / h) < 1 for c, a in zip(before, weights))


def rows(spark, n=3000):
    rng = random.Random(1)
    data = [(i, "t" * rng.randint(0, 5), rng.choice(["a", "a", "a", "b", "c", None]), 1, 2) for i in range(n)]
    data += [(None, None, "b", 1, 2), (7, "x", "a", 1, 2), (7, "x", "a", 1, 2)]
    return spark.createDataFrame(data, "doc_id long, text string, source string, rank int, s int")


@pytest.mark.parametrize("weights", [None, {"a": 10, "b": 30, "c": 20}])
def test_mix(spark, monkeypatch, weights):
    monkeypatch.setattr(mixing, "BUCKET", 100)
    docs = rows(spark)
    got = mixing.mix(docs, weights, block=4).orderBy("mix_position").collect()
    assert [r.mix_position for r in got] == list(range(docs.count()))
    assert Counter(map(tuple, docs.collect())) == Counter(tuple(r)[:-1] for r in got)
    again = mixing.mix(docs.repartition(5), weights, block=4).orderBy("mix_position").collect()
    assert [r.doc_id for r in got] == [r.doc_id for r in again]
    # until the first source runs out, no source is a block away from its share
    sizes = Counter(r.source for r in got)
    if weights is None:
        raw = {s: n**0.5 for s, n in sizes.items()}
        ints = {s: max(1, round(1000 * x / sum(raw.values()))) for s, x in raw.items()}
    else:
        ints = {"a": 1, "b": 3, "c": 2, None: 1}
    total, have = sum(ints.values()), Counter()
    for p in range(0, len(got), 4):
        for r in got[p : p + 4]:
            have[r.source] += 1
        if any(sizes[s] - have[s] < 4 for s in sizes):
            break
        t = p // 4 + 1
        assert all(abs(have[s] / 4 - t * a / total) < 1 for s, a in ints.items())
    assert p > 400


def test_order_and_empty(spark):
    docs = rows(spark)
    want = [r.doc_id for r in mixing.mix(docs).orderBy("mix_position").collect()]
    ordered = mixing.mixed_order(docs)
    assert ordered.columns == docs.columns and [r.doc_id for r in ordered.collect()] == want
    assert mixing.mix(docs.limit(0)).count() == 0 and mixing.mixed_order(docs.limit(0)).count() == 0


def test_place_in_files(spark, tmp_path):
    docs = rows(spark)
    places = lambda df: sorted((r.mix_position, r.doc_id or -1) for r in df.collect())
    path = str(tmp_path / "ordered")
    mixing.mixed_order(docs, {"b": 5}).write.parquet(path)
    found = mixing.place_in_files(spark.read.parquet(path))
    assert places(found) == places(mixing.mix(docs, {"b": 5})) != places(mixing.mix(docs)) and found.columns == [*docs.columns, "mix_position"]
    # the number of a file counts, not its name; one file is read in pieces
    (tmp_path / "files").mkdir()
    spark.range(0, 1000, 1, 1).write.parquet(str(tmp_path / "a"))
    spark.range(1000, 1010, 1, 1).write.parquet(str(tmp_path / "b"))
    for folder, name in (("a", "part-99999-x.parquet"), ("b", "part-100000-x.parquet")):
        next((tmp_path / folder).glob("part-*")).rename(tmp_path / "files" / name)
    assert all(r.id == r.mix_position for r in mixing.place_in_files(spark.read.parquet(str(tmp_path / "files"))).collect())
    docs.limit(0).write.parquet(str(tmp_path / "none"))
    assert mixing.place_in_files(spark.read.parquet(str(tmp_path / "none"))).count() == 0


def test_native(spark):
    plan = mixing.mix(rows(spark).withColumn("z", F.lit(1)))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan
