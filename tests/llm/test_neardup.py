import math

import numpy as np
import pytest

from tidemark.llm import neardup


def brute(rows, threshold=0.95):
    rows = list({(i, None if v is None else tuple(v)): (i, v) for i, v in rows}.values())
    ok = [k for k, (i, v) in enumerate(rows) if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    width = max([len(rows[k][1]) for k in ok], default=0)
    x = np.zeros((len(ok), width))
    for r, k in enumerate(ok):
        x[r, : len(rows[k][1])] = rows[k][1]
    u = x / np.linalg.norm(x, axis=1, keepdims=True) if len(ok) else x
    near = u @ u.T >= threshold
    np.fill_diagonal(near, False)
    ids = np.array([rows[k][0] for k in ok])
    comp = ids.copy()
    while True:
        low = np.array([min([comp[r], *comp[near[r]]]) for r in range(len(ok))]) if len(ok) else comp
        if (low == comp).all():
            break
        comp = low
    out = [(int(ids[r]), int(near[r].sum()), int(comp[r]), bool(comp[r] == ids[r])) for r in range(len(ok))]
    out += [(i, 0, i, i is not None) for k, (i, v) in enumerate(rows) if k not in set(ok)]
    return sorted(out, key=str)


def run(spark, rows, **kw):
    df = spark.createDataFrame([(i, v, 3, 4) for i, v in rows], "vec_id long, embedding array<float>, n_links int, x int")
    return sorted((tuple(r) for r in neardup.near_duplicates(df, **kw).collect()), key=str)


def f32(v):
    return [float(x) for x in np.asarray(v, dtype=np.float32)]


def test_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK", 16)
    monkeypatch.setattr(neardup, "LEAF", 32)
    monkeypatch.setattr(neardup, "LEAF_MOST", 64)
    rng = np.random.default_rng(4)
    rows = [(i, f32(rng.normal(size=24))) for i in range(600)]
    n = 600
    for size, spread in [(120, 0.05), (40, 0.05), (9, 0.04), (2, 0.1), (2, 0.02), (30, 0.12)]:
        base = rng.normal(size=24)
        for _ in range(size):
            rows.append((n, f32(base + spread * rng.normal(size=24))))
            n += 1
    step, base = rng.normal(size=24), rng.normal(size=24)  # a chain: reachable, not linked directly
    for i in range(25):
        rows.append((n, f32(np.cos(i * 0.25) * base / np.linalg.norm(base) + np.sin(i * 0.25) * step / np.linalg.norm(step))))
        n += 1
    rows += [(n + i, rows[7][1]) for i in range(50)]  # equal vectors
    rows += [(5000, f32(3 * np.array(rows[8][1]))), (None, rows[0][1]), (6001, None), (6002, []), (6003, [0.0] * 24), (6004, [None] * 24), (6005, [float("nan")] * 24), rows[3], (3, rows[4][1]), (6006, rows[9][1][:20])]
    assert run(spark, rows) == brute(rows)


def clumps(rng):
    """Two tight clumps whose members are all linked to each other, with far vectors around."""
    a, b = np.eye(64)[:2]
    b = 0.972 * a + np.sqrt(1 - 0.972**2) * b
    near = lambda c: c + 0.0055 * rng.normal(size=64)
    return [(i, f32(near(a if i % 2 else b))) for i in range(120)] + [(i, f32(rng.normal(size=64))) for i in range(120, 1500)]


def test_tight_clumps_linked_only_to_each_other(spark):
    rows = clumps(np.random.default_rng(6))
    u = np.array([v for _, v in rows[:120]])
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    sims = u @ u.T
    assert sims[::2, 1::2].min() >= 0.95 and sims[::2, ::2].min() > sims[::2, 1::2].max() < sims[1::2, 1::2].min()
    assert run(spark, rows) == brute(rows)


def test_blocks_of_a_large_leaf_meet(spark, monkeypatch):
    """Nodes of a leaf meet other nodes in other trees, and blocks share nodes in each."""
    from pyspark.sql import functions as F

    from tidemark.llm.components import connected_components

    rng = np.random.default_rng(8)
    base = rng.normal(size=16)
    q = [neardup._bytes(neardup._unit((base * s + 1e-3 * rng.normal(size=16))[None, :]))[0].tobytes() for s in rng.uniform(1, 9, 1100)]
    nodes = spark.createDataFrame([(i, bytearray(x)) for i, x in enumerate(q)], "v long, q binary")
    monkeypatch.setattr(neardup, "LEAF", 1100)  # one leaf a tree
    for trees, k in [(1, 1100), (6, 1100)]:
        met = neardup.leaves(nodes, 16, 1100, trees, k).select("v", "u").distinct().cache()
        members = connected_components(met, "v", "u").agg(F.count("*"), F.count_distinct("component")).first()
        assert tuple(members) == (1100, 1)
    assert met.groupBy("v").count().agg(F.min("count")).first()[0] > 2 * neardup.LEAF_MOST


def test_scaled_copies(spark):
    rng = np.random.default_rng(9)
    base = rng.normal(size=16)
    rows = [(i, f32(base * s)) for i, s in enumerate(rng.uniform(1, 9, 1100))] + [(i, f32(rng.normal(size=16))) for i in range(1100, 2000)]
    assert run(spark, rows) == brute(rows)


@pytest.mark.parametrize("spread", [0.012, 0.09])  # tight and loose
def test_large_components(spark, monkeypatch, spread):
    """Rings settle what is close together; the rest is compared in blocks."""
    monkeypatch.setattr(neardup, "BLOCK", 64)
    rng = np.random.default_rng(12)
    base = rng.normal(size=12)
    rows = [(i, f32((base + spread * rng.normal(size=12)) * rng.uniform(1, 5))) for i in range(700)]
    rows += [(i, f32(rng.normal(size=12))) for i in range(700, 900)] + [(900 + i, rows[i][1]) for i in range(40)]
    assert run(spark, rows) == brute(rows)


def test_tight_component_sends_no_vectors_to_pairs_of_blocks(spark, monkeypatch):
    from pyspark.sql import functions as F

    monkeypatch.setattr(neardup, "BLOCK", 64)
    rng = np.random.default_rng(13)
    base = rng.normal(size=12)
    nodes = spark.createDataFrame([(i, [float(x) for x in base + 1e-3 * rng.normal(size=12)], 1) for i in range(5000)], "v long, x array<double>, times long")
    seen = []
    keep = neardup.materialize
    monkeypatch.setattr(neardup, "materialize", lambda df, name: (seen.append((name, keep(df, name))), seen[-1][1])[1])
    got = neardup.link_counts(nodes, nodes.select(F.col("v").alias("node"), F.lit(0).cast("long").alias("component")), 12, 0.95)
    assert {r.links for r in got.collect()} == {4999}
    assert dict(seen)["block-pairs"].count() == 0


def test_all_are_compared_when_attempts_fail(spark, monkeypatch):
    """A hot component that is found doesn't hide pairs that are lost."""
    monkeypatch.setattr(neardup, "BLOCK", 64)
    monkeypatch.setattr(neardup, "ATTEMPTS", 1)
    rng = np.random.default_rng(10)
    hot = rng.normal(size=32)
    rows = [(i, f32(hot + 0.05 * rng.normal(size=32))) for i in range(100)]
    for i in range(100, 160, 2):
        base = rng.normal(size=32)
        rows += [(i + j, f32(base + 0.05 * rng.normal(size=32))) for j in range(2)]
    whole = neardup.linked_members
    monkeypatch.setattr(neardup, "linked_members", lambda *a: whole(*a).filter("node < 100"))
    assert run(spark, rows) == brute(rows)


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, [1.0, 0.0])], [(2, [1.0, 0.0]), (1, [2.0, 0.0]), (3, [0.0, 1.0])]])
def test_small(spark, rows):
    assert run(spark, rows) == brute(rows)
