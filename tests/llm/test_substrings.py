import random
import re

import pytest

from tidemark.llm import substrings as sub


def brute(rows, window):
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    least = {}
    for (i, _), w in zip(rows, words):
        if i is not None:
            for k in range(len(w) - window + 1):
                g = tuple(w[k : k + window])
                least[g] = min(i, least.get(g, i))
    out = []
    for (i, _), w in zip(rows, words):
        gone = set()
        if i is not None:
            for k in range(len(w) - window + 1):
                if least[tuple(w[k : k + window])] < i:
                    gone.update(range(k, k + window))
        out.append((i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return sorted(out, key=str)


def corpus(seed, n=120):
    rng = random.Random(seed)
    vocab = [f"w{i}é" for i in range(40)]
    shared = [[rng.choice(vocab) for _ in range(rng.randint(5, 40))] for _ in range(12)]
    rows = []
    for i in range(n):
        w = []
        for _ in range(rng.randint(0, 6)):
            w += rng.choice(shared) if rng.random() < 0.6 else [rng.choice(vocab) for _ in range(rng.randint(1, 30))]
        rows.append((rng.randrange(10**6), (" ", "\n", "\t ")[i % 3].join(w)))
    rows += [(rng.randrange(10**6), rows[k][1]) for k in range(0, 40, 2)]  # whole copies
    rows += [(5, "der " * 300), (6, "der " * 200 + "die " * 50), (7, None), (8, ""), (9, " \n"), (None, rows[0][1]), (None, None)]
    rows += [rows[1], rows[1], (rows[2][0], rows[3][1])]  # repeated rows, one id with two texts
    rng.shuffle(rows)
    return rows


def run(spark, rows, **kw):
    df = spark.createDataFrame([(i, t, 1, "k") for i, t in rows], "doc_id long, text string, n_words int, key string")
    return sorted((tuple(r) for r in sub.dedup_substrings(df, **kw).collect()), key=str)


@pytest.mark.parametrize("window,gram", [(13, 6), (5, 2), (3, 3)])
def test_against_brute_force(spark, monkeypatch, window, gram):
    monkeypatch.setattr(sub, "CHUNK_BYTES", 3000)
    rows = corpus(window)
    assert run(spark, rows, window=window, gram=gram) == brute(rows, window)


@pytest.mark.parametrize("group", [1, 3, 20, 4000])
def test_lengthened_prefixes(spark, monkeypatch, group):
    monkeypatch.setattr(sub, "GROUP", group)
    monkeypatch.setattr(sub, "CHUNK_BYTES", 5000)
    rows = corpus(77)
    assert run(spark, rows) == brute(rows, 13)


def test_empty_and_digest(spark):
    import hashlib

    df = spark.createDataFrame([(1, "a  b"), (2, None)], "doc_id long, text string")
    got = {r.doc_id: r.kept_sha256 for r in sub.dedup_substrings(df, outputs=("kept_sha256",)).collect()}
    assert got == {1: hashlib.sha256(b"a b").hexdigest(), 2: hashlib.sha256(b"").hexdigest()}
    assert sub.dedup_substrings(df.limit(0)).count() == 0


def naive_nodes(texts, window):
    """Sets of words at least ``window`` long in which suffixes branch, with their places."""
    words = [t.split(b" ") for t in texts]
    places = {}
    for t, w in enumerate(words):
        for i in range(len(w) - window + 1):
            for j in range(i + window, len(w) + 1):
                places.setdefault(tuple(w[i:j]), []).append((t, i))
    nodes = {}
    for seq, at in places.items():
        nexts = [words[t][i + len(seq)] if i + len(seq) < len(words[t]) else (t, i) for t, i in at]
        if len(at) > 1 and len(set(nexts)) > 1:
            nodes[seq] = sorted(at)
    return words, nodes


@pytest.mark.parametrize("seed", range(6))
def test_subtree(seed):
    rng = random.Random(seed)
    texts = list({b" ".join(rng.choice([b"a", b"b", b"b\x01", b"bb"]) for _ in range(rng.randint(1, 12))) for _ in range(8)})
    tree = sub.Subtree(texts, 3)
    words, nodes = naive_nodes(texts, 3)
    got = {tuple(words[tree.leaves[a][0]][tree.leaves[a][1] : tree.leaves[a][1] + d]): sorted(tree.leaves[a:b]) for d, a, b in tree.nodes()}
    assert got == nodes
    groups = {}
    for t, w in enumerate(words):
        for i in range(len(w) - 2):
            groups.setdefault(tuple(w[i : i + 3]), []).append((t, i))
    assert sorted(sorted(n) for n in tree.repeats()) == sorted(sorted(g) for g in groups.values() if len(g) > 1)
    maximal = {s: at for s, at in nodes.items() if len({words[t][i - 1] if i else (t,) for t, i in at}) > 1}
    assert {tuple(s.split(b" ")): sorted(at) for s, at in tree.maximal_repeats()} == maximal


def test_a_run_is_counted_once_a_chunk(spark, monkeypatch):
    """A passage in all documents sends a row for each chunk."""
    monkeypatch.setattr(sub, "CHUNK_BYTES", 4000)
    passage = " ".join(f"p{i}" for i in range(30))
    df = spark.createDataFrame([(i, f"start {i} {passage} end {i}") for i in range(400)], "doc_id long, text string").repartition(4)
    folder, table = sub.write_chunks(df.selectExpr("doc_id", "CAST(text AS BINARY) AS text"))
    chunks = table.filter("file IS NOT NULL").selectExpr("chunk", "file", "CAST(NULL AS array<int>) AS copies")
    counts = sub.prefix_counts(folder, chunks, chunks.count(), 13, 6).toPandas()
    hot = counts.groupby("key").docs.agg(["sum", "count"])
    assert hot["sum"].max() == 400 and hot["count"].max() == chunks.count() >= 8
