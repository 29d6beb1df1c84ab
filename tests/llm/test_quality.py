import math
import re
import zlib

import numpy as np
import pytest

from tidemark.llm import quality

DOCS = "doc_id long, text string, score string, quality string"


def test_fit_orders_pairs_and_threshold():
    rng = np.random.default_rng(3)
    y = (rng.random(2000) > 0.2).astype(int)
    x = rng.normal(size=(2000, 3)) + np.outer(y, [2.0, -1.0, 0.0])
    model = quality.fit(x, y, (y == 0).mean())
    s = model.score(x)
    assert abs((s < quality.CUT).mean() - (y == 0).mean()) < 0.01  # the quantile asked for
    good, bad = s[y == 1], s[y == 0]
    assert (good[:, None] > bad[None, :]).mean() > 0.9
    assert quality.fit(x, np.ones(2000, int), 0.0) is None


def pair_loss(w, z, better, worse, penalty=1e-3):
    return np.logaddexp(0, -(z[better] - z[worse]) @ w).mean() + penalty / 2 * w @ w


def descend(z, better, worse, steps=3000):
    """The weights by accelerated gradient descent."""
    d = z[better] - z[worse]
    rate = 1 / (np.linalg.norm(d, 2) ** 2 / len(d) / 4 + 1e-3)
    w = last = np.zeros(z.shape[1])
    for i in range(steps):
        v = w + i / (i + 3) * (w - last)
        w, last = v - rate * (-(d / (1 + np.exp(d @ v))[:, None]).mean(0) + 1e-3 * v), w
    return w


def test_weights_minimise_the_loss():
    rng = np.random.default_rng(5)
    y = (rng.random(800) > 0.3).astype(int)
    x = rng.normal(size=(800, 4)) + np.outer(y, [0.6, -0.4, 0.0, 0.1])
    model = quality.fit(x, y, (y == 0).mean(), pairs=5000)
    better, worse = quality.preferences(y, 5000)
    assert (y[better] == 1).all() and (y[worse] == 0).all() and len(better) == 5000
    z = (x - x.mean(0)) / x.std(0)
    for i in range(4):  # no slope, by finite differences
        step = 1e-4 * np.eye(4)[i]
        assert abs(pair_loss(model.weights + step, z, better, worse) - pair_loss(model.weights - step, z, better, worse)) / 2e-4 < 1e-6
    assert np.abs(descend(z, better, worse) - model.weights).max() < 1e-4


def test_all_pairs_count(spark):
    rng = np.random.default_rng(8)
    y = (rng.random(900) > 0.4).astype(int)
    x = rng.normal(size=(900, 4)) + np.outer(y, [0.6, -0.4, 0.0, 0.1])
    model = quality.fit(x, y, (y == 0).mean())
    better, worse = (a.ravel() for a in np.meshgrid(np.flatnonzero(y == 1), np.flatnonzero(y == 0)))
    assert len(better) > 150_000  # more than were drawn before
    z = (x - x.mean(0)) / x.std(0)
    for i in range(4):
        step = 1e-4 * np.eye(4)[i]
        assert abs(pair_loss(model.weights + step, z, better, worse) - pair_loss(model.weights - step, z, better, worse)) / 2e-4 < 1e-6
    table = spark.createDataFrame([(r.tolist(), int(k)) for r, k in zip(x, y)], "x array<double>, y int").repartition(7)
    again = quality.fit_table(table, (y == 0).mean(), 4)
    assert np.abs(again.weights - model.weights).max() < 1e-9 and abs(again.threshold - model.threshold) < 1e-9


@pytest.mark.parametrize("looked_up", [1, 100_000])
def test_threshold_is_the_quantile(monkeypatch, looked_up):
    monkeypatch.setattr(quality, "LOOKED_UP", looked_up)
    rng = np.random.default_rng(4)
    for i in range(60):
        y = np.r_[0, 1, rng.random(rng.integers(0, 50)) > 0.5].astype(int)
        s = rng.integers(-3, 4, len(y)) * 1.0 if i % 2 else rng.normal(size=len(y))
        share = rng.random()
        got = quality._threshold(quality._Memory(s[:, None], y), lambda x: x[:, 0], 8.0, np.bincount(y), share)
        order = np.lexsort((y, s))
        below = np.cumsum(np.where(y == 1, (1 - share) / (y == 1).sum(), share / (y == 0).sum())[order])
        at = np.clip((below <= share * (1 + 1e-9)).sum(), 1, len(y) - 1)
        assert got == (s[order[at - 1]] + s[order[at]]) / 2


def test_all_labelled_rows_are_learnt_from(spark, monkeypatch):
    n, seen = 24_000, {}  # about 9,600 of each label that aren't held out
    docs = spark.range(n).selectExpr("id AS doc_id", "concat(if(id % 2 = 0, 'fine ', '### '), 'w', id % 7) AS text")
    labels = spark.range(n).selectExpr("id AS doc_id", "cast(1 - id % 2 AS int) AS quality")
    counted, fitted = quality._lexicon, quality.fit_table
    monkeypatch.setattr(quality, "_lexicon", lambda d: seen.setdefault("lexicon", counted(d)))
    monkeypatch.setattr(quality, "fit_table", lambda d, *a: (seen.setdefault("rows", d.count()), fitted(d, *a))[1])
    quality.fit_scorer(docs, labels)
    taught = [i % 2 for i in range(n) if zlib.crc32(str(i).encode()) % 5]
    assert list(seen["lexicon"].documents) == [sum(taught), len(taught) - sum(taught)] and min(seen["lexicon"].documents) > 8_000
    assert seen["rows"] == len(taught)


def naive_features(text, docs, own):
    """The features of a text by plain counting; ``docs`` are (set of buckets, label) learnt from."""
    raw = (text or "").encode()
    words = [w for w in re.split(rb"[ \t-\r]", raw) if w]
    if not words:
        return [0.0] * len(quality.FEATURES)
    n, ink = len(words), sum(map(len, words))
    share = lambda test: sum(1 for b in raw if test(b)) / ink
    symbol = lambda b: 33 <= b < 127 and chr(b) not in ".,;:?'\"-()" and not chr(b).isalnum()
    symbols = [b for b in raw if symbol(b)]
    lines = [x for x in raw.split(b"\n") if x.strip()]
    quads = [tuple(words[i : i + 4]) for i in range(n - 3)]
    hashes = [zlib.crc32(w) for w in words]
    kinds = [[h % quality.BUCKETS for h in hashes], [quality.BUCKETS + (a * 31 + b) % quality.BUCKETS for a, b in zip(hashes, hashes[1:])]]
    size = [sum(1 for _, y in docs if y == k) - (own == k) for k in (0, 1)]
    speak = []
    for buckets in kinds:
        total = 0.0
        for b in buckets:
            rate = []
            for k in (0, 1):
                seen = sum(1 for s, y in docs if y == k and b in s) - (own == k)
                rate.append((seen + quality.PRIOR * size[k] / sum(size)) / (size[k] + quality.PRIOR))
            total += math.log(rate[1]) - math.log(rate[0])
        speak.append(total / len(buckets) if buckets else 0.0)
    return [
        math.log(1 + n), ink / n, share(lambda b: 65 <= b <= 90), share(lambda b: 48 <= b <= 57), share(lambda b: b > 127), share(lambda b: chr(b) in ".,;:?'\"-()"), len(symbols) / ink, max((symbols.count(b) for b in symbols), default=0) / ink,
        len(lines) / n, 1 - len(set(lines)) / max(1, len(lines)),
        len(set(words)) / n, max(map(words.count, set(words))) / n, sum(a == b for a, b in zip(words, words[1:])) / n, sum(symbol(w[-1]) for w in words) / n, sum(len(w) <= 2 and symbol(w[0]) for w in words) / n,
        sum(len(w) > 12 for w in words) / n, sum(len(w) <= 3 for w in words) / n, len(set(quads)) / max(1, n - 3), float(len(symbols) > 0.02 * len(raw)), sum(65 <= w[0] <= 90 for w in words) / n,
        *speak,
    ]


def brute_scores(docs, marks):
    """(doc_id, text) and {doc_id: label} to scores."""
    taught = {i: y for i, y in marks.items() if zlib.crc32(str(i).encode()) % 5}
    buckets = {}
    for i, t in docs:
        if i in taught:
            h = [zlib.crc32(w) for w in (t or "").encode().split()]
            buckets[i] = ({x % quality.BUCKETS for x in h} | {quality.BUCKETS + (a * 31 + b) % quality.BUCKETS for a, b in zip(h, h[1:])}, taught[i])
    known = list(buckets.values())
    rows = sorted((i, naive_features(t, known, taught[i]), taught[i]) for i, t in docs if i in taught)
    x, y = np.array([r[1] for r in rows]), np.array([r[2] for r in rows])
    mean, scale = x.mean(0), x.std(0)
    scale[scale < 1e-9] = 1
    z = lambda x: np.clip((x - mean) / scale, -8, 8)
    w = descend(z(x), *quality.preferences(y), steps=6000)
    worth, bad = z(x) @ w, (y == 0).mean()
    order = np.argsort(worth)
    weight, at = 0.0, 0
    while at < len(y) and weight + (bad / (y == 0).sum() if y[order[at]] == 0 else (1 - bad) / (y == 1).sum()) <= bad * (1 + 1e-9):
        weight += bad / (y == 0).sum() if y[order[at]] == 0 else (1 - bad) / (y == 1).sum()
        at += 1
    cut = (worth[order[at - 1]] + worth[order[at]]) / 2
    return {i: 1 / (1 + math.exp(-(z(np.array(naive_features(t, known, None))) @ w - cut + math.log(0.3 / 0.7)))) for i, t in docs}


def test_against_brute_force(spark):
    rng = np.random.default_rng(2)
    fine, junk = "a river runs under old stone bridges near the mill.".split(), "### BUY!! now $$$ free ### click 99 xx".split()
    docs, marks = [], {}
    for i in range(90):
        share = rng.beta(2, 2)
        docs.append((i, " ".join(rng.choice(junk if rng.random() < share else fine) for _ in range(rng.integers(3, 40))) + "\n" * int(rng.integers(2))))
        if i % 3:
            marks[i] = int(rng.random() > share)
    docs += [(90, None), (91, ""), (92, "one"), (93, "ÀÉ ö")]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    got = {r.doc_id: r for r in quality.quality_scores(df, spark.createDataFrame(list(marks.items()), "doc_id long, quality int")).collect()}
    want = brute_scores(docs, marks)
    assert set(got) == set(want)
    for i, s in want.items():
        assert abs(got[i].score - s) < 1e-3 and got[i].predicted == int(got[i].score >= 0.3)
        assert got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0)


def test_held_out_accuracy(spark, testdata):
    docs, labels = (spark.read.parquet(f"{testdata}/{t}.parquet") for t in ("documents", "labels"))
    got = quality.quality_scores(docs, labels).join(labels, "doc_id").toPandas()
    assert (got.held_out == [zlib.crc32(str(i).encode()) % 5 == 0 for i in got.doc_id]).all()
    held = got[got.held_out]
    assert (held.predicted == held.quality).mean() > 0.95
    assert got.score.between(0, 1).all() and ((got.score >= 0.3) == (got.predicted == 1)).all()
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns and kept.count() < docs.count()


@pytest.mark.parametrize("marks", [[], [(1, 1), (2, None)], [(1, 0), (1, 1), (None, 0)], [(1, 1), (2, 0), (3, 1), (4, 0)]])
def test_odd_tables(spark, marks):
    docs = spark.createDataFrame([(1, "fine words here", "s", "q"), (2, "### $$$ %%%", "s", "q"), (3, None, None, None), (4, "", "", ""), (None, "x", "", ""), (1, "fine words here", "s", "q"), (5, "very long " * 60000, "", "")], DOCS)
    labels = spark.createDataFrame(marks, "doc_id long, quality int")
    got = quality.quality_scores(docs, labels).collect()
    assert len(got) == 7 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    assert quality.quality_scores(docs.limit(0), labels).count() == 0
