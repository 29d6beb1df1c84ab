import math
import random

import pytest

from tidemark.llm import topk

SCHEMA = "vec_id long, embedding array<float>, label int, score long, rank string"


def whole(x):
    return int(x) * 1024 if abs(x) >= 2**53 else math.floor(1024 * x)


def brute(rows, k=10, every=100):
    ok = [(i, [whole(x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    found = {}
    for q, qv in ok:
        if q % every == 0:
            found.setdefault(q, []).extend((-sum(a * b for a, b in zip(qv, v)), i) for i, v in ok if i != q)
    clip = lambda n: max(-(2**63), min(2**63 - 1, n))
    return sorted((q, r + 1, i, clip(-n)) for q, s in found.items() for r, (n, i) in enumerate(sorted(s)[:k]))


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 0, 1, "r") for i, v in rows], SCHEMA)


def f32(x):
    import numpy as np

    return float(np.float32(x))


@pytest.mark.parametrize("n,dim", [(700, 5), (3000, 16)])
def test_against_brute_force(spark, monkeypatch, n, dim):
    monkeypatch.setattr(topk, "BLOCK", 64)
    monkeypatch.setattr(topk, "QUERY_BLOCK", 4)
    rng = random.Random(n)
    centres = [[rng.gauss(0, 1) for _ in range(dim)] for _ in range(8)]
    rows = []
    for i in range(n):
        c = rng.choice(centres)
        rows.append((i, [f32(x + rng.gauss(0, 0.2)) for x in c]))
    rows += [(n + i, list(rows[0][1])) for i in range(200)]  # ties
    rows += [(None, rows[0][1]), (9001, None), (9002, [None] * dim), (9003, [float("nan")] * dim), (9100, [float("inf")] * dim), rows[5], rows[100], (9200, [0.0] * dim)]
    got = sorted(tuple(r) for r in topk.top_k(frame(spark, rows)).collect())
    assert got == brute(rows)


@pytest.mark.parametrize("element", ["float", "double"])
def test_large_components(spark, monkeypatch, element):
    monkeypatch.setattr(topk, "BLOCK", 32)
    rng = random.Random(3)
    rows = [(i, [f32(rng.gauss(0, 1)) for _ in range(4)]) for i in range(300)]
    sizes = [3e5, 1e12, 1e30, 1e37] + ([1e200, 1.7e308] if element == "double" else [])
    for n, size in enumerate(sizes):
        rows += [(1000 + 50 * n + i, [f32(rng.gauss(0, 0.3)) * size if size < 1e38 else rng.uniform(-1, 1) * size for _ in range(4)]) for i in range(20)]
        rows.append((1000 + 50 * n + 30, [size, 0.0, 0.0, -0.0]))
    rows = [(i, [f32(x) for x in v] if element == "float" else v) for i, v in rows]
    df = spark.createDataFrame(rows, f"vec_id long, embedding array<{element}>")
    assert sorted(tuple(r) for r in topk.top_k(df).collect()) == brute(rows)
    assert topk.top_k(spark.createDataFrame([(100, [1.0, 2.0]), (1, [3e5, 1.0]), (2, [0.5, 0.5])], "vec_id long, embedding array<float>")).orderBy("rank").first().vec_id == 1


def test_repeated_rows_ids_with_several_vectors_and_a_hot_vector(spark, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK", 32)
    rng = random.Random(4)
    rows = [(i, [f32(rng.gauss(0, 1)) for _ in range(3)]) for i in range(400)]
    rows += [(i, [1.0, 1.0, 1.0]) for i in range(1000, 1400)] + [(i, [0.0, 0.0, 0.0]) for i in range(2000, 2300)]
    rows += [rows[7], rows[7], rows[200], (200, [0.5, 0.5, 0.5]), (1100, [2.0, 0.0, 0.0]), (1100, [4.0, 4.0, 4.0]), (9, [1.0, 1.0, 1.0]), (3000, [1.0]), (3100, [])]
    assert sorted(tuple(r) for r in topk.top_k(frame(spark, rows)).collect()) == brute(rows)


def test_few_rows_and_empty(spark):
    rows = [(0, [1.0, 2.0]), (3, [0.5, -1.0]), (100, [0.0, 0.25])]
    assert sorted(tuple(r) for r in topk.top_k(frame(spark, rows)).collect()) == brute(rows)
    assert topk.top_k(frame(spark, [])).count() == 0
    assert topk.top_k(frame(spark, [(1, [1.0])])).count() == 0
