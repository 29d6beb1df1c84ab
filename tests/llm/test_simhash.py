import random

import numpy as np
import pytest
import xxhash

from tidemark.llm import simhash

SCHEMA = "doc_id long, text string, fp string, component_id string"


def brute_fingerprint(text):
    words = [w for w in __import__("re").split("[\x20\x09-\x0d]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")) if w]
    if not words:
        return 0
    sh = [" ".join(words)] if len(words) < 3 else [" ".join(words[i : i + 3]) for i in range(len(words) - 2)]
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(rows):
    fps = [brute_fingerprint(t) for _, t in rows]
    n = len(rows)
    root = list(range(n))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(n):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= 3:
                root[find(i)] = find(j)
    least = {}
    for i in range(n):
        ids = least.setdefault(find(i), [])
        ids.append(rows[i][0])
    return sorted(
        ((rows[i][0], f"{fps[i]:016x}", min((x for x in least[find(i)] if x is not None), default=None)) for i in range(n)),
        key=str,
    )


def test_against_brute_force(spark):
    rng = random.Random(5)
    vocab = [f"w{i}" for i in range(300)]
    rows = [(0, None), (1, ""), (2, " \t\n"), (3, "One"), (4, "one two"), (5, "A b\tC"), (None, "a b c"), (7, "é É ẞ")]
    for i in range(60):
        words = [rng.choice(vocab) for _ in range(rng.randint(40, 400))]
        for c in range(rng.randint(1, 5)):
            copy = list(words)
            for _ in range(c):
                copy[rng.randrange(len(copy))] = rng.choice(vocab)
            rows.append((100 + len(rows), " ".join(copy)))
    rows += [(50, "same text here"), (50, "same text here"), (90, "long " * 70000)]
    df = spark.createDataFrame([(a, b, "x", "y") for a, b in rows], SCHEMA)
    got = sorted((tuple(r) for r in simhash.simhash_components(df).collect()), key=str)
    assert got == brute_components(rows)
    kept = simhash.keep_one_per_group(df)
    assert kept.columns == df.columns
    want = {a for a, _, c in brute_components([r for r in rows if r[0] is not None]) if a == c}
    assert {r.doc_id for r in kept.collect()} == want | {None}


def test_empty(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert simhash.simhash_components(df).count() == 0


def test_shared_segments():
    assert [simhash.shared_segments(n) for n in (0, 10**5, 10**7, 10**9, 10**10)] == [2, 2, 2, 3, 4]


@pytest.mark.parametrize("block,shared", [(8, 2), (2048, 2), (64, 3), (2048, 4)])
def test_dense_group_over_blocks(spark, block, shared):
    base = 0x0123456789ABCDEF
    rng = random.Random(1)
    fps = {base} | {base ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for _ in range(400)} | {rng.getrandbits(64) for _ in range(400)}
    signed = np.array(sorted(fps), dtype=np.uint64).view(np.int64)
    df = spark.createDataFrame([(int(x),) for x in signed], "fp long")
    links = simhash.fingerprint_links(df, block=block, shared=shared)
    pairs = {(r.a, r.b) for r in links.collect()}
    near = lambda a, b: bin((a ^ b) & (2**64 - 1)).count("1") <= 3
    assert all(near(a, b) for a, b in pairs)
    from tidemark.llm.components import connected_components

    got = {r.node: r.component for r in connected_components(links).collect()}
    ids = [int(x) for x in signed]
    comp = {i: i for i in ids}
    changed = True
    adj = {i: [j for j in ids if j != i and near(i, j)] for i in ids}
    while changed:
        changed = False
        for i in ids:
            low = min([comp[i], *(comp[j] for j in adj[i])])
            if low < comp[i]:
                comp[i], changed = low, True
    assert got == {i: c for i, c in comp.items() if adj[i]}


def test_components(spark):
    from tidemark.llm.components import connected_components

    chain = [(i, i + 1) for i in range(200)] + [(1000, 500), (1000, 1000), (None, 4), (3, None), (500, 1000)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(201)}, 500: 500, 1000: 500}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_a_hub_is_split(spark):
    """Both joins of a round are between shuffles of their own, so the skew rule applies."""
    from tidemark.llm import components

    settings = {
        "spark.sql.shuffle.partitions": "16", "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "32k",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "32k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5", "spark.sql.files.maxPartitionBytes": "64k",
    }
    before = {k: spark.conf.get(k, None) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        star = spark.range(1, 100_001).selectExpr("50L AS u", "id + 100 AS v").unionByName(spark.range(200_000, 220_000).selectExpr("id AS u", "id + 1 AS v"))
        star = components.materialize(star, "star")
        lows = components._minima(star)
        joined = star.join(lows, star.u == lows.mu).select("v", "m")
        assert joined.toArrow().num_rows == 120_000
        assert "skew=true" in joined._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
