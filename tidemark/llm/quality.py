"""Quality scores by Bradley-Terry pairwise ranking.

A document's worth is linear in features of its text: shares and lengths, and how much its words
and pairs of words speak for good or for bad documents. The latter are log-odds of hashed words,
learnt from the same labelled rows; for a row that is learnt from, its own words don't count.
Preference pairs, one document marked
good and one marked bad, say which of two is worth more; the weights maximise the Bradley-Terry
likelihood, that is, they minimise logistic loss on differences of features. Worths become
scores from 0 to 1 around a threshold that is the quantile of worths below which, among the
labelled rows learnt from, the share of bad documents lies.

Fitted on every labelled row that isn't held out and on every pair of a good and a bad one of
them, with ``BUCKETS`` hash values for words and as many for pairs of words. The loss of a pair
depends on the difference of two worths alone, so sums over all pairs follow from sums over
rows: each row's share in the Chebyshev nodes around its worth, by label, and the loss between
nodes (exact to about 1e-10). A Newton step costs two passes over narrow rows; the threshold is
the exact quantile, by histograms that narrow down. Every document is scored from its whole
text.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass
from functools import cached_property
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import discard, materialize

BUCKETS = 1 << 15
#: Documents a word is taken to have been seen in before any was, in the proportion of all.
PRIOR = 4.0
#: A score at or above this is predicted good.
CUT = 0.3
FOLDS = 5
#: Features are cut off at so many deviations from the mean.
REACH = 8.0
#: Worths are dealt into panels of this width, with so many nodes each.
PANEL, NODES = 3.0, 16
#: Bins of a histogram of worths, and rows among which the threshold is looked up at once.
BINS, LOOKED_UP = 1 << 16, 100_000

_UPPER = bytes(range(65, 91))
_LOWER = bytes(range(97, 123))
_DIGIT = bytes(range(48, 58))
_HIGH = bytes(range(128, 256))
_BLANK = bytes([32, *range(9, 14)])
_STOPS = b".,;:?'\"-()"
_SYMBOLS = bytes(b for b in range(33, 127) if bytes([b]) not in {bytes([x]) for x in _UPPER + _LOWER + _DIGIT + _STOPS})
FEATURES = (
    "log_words", "word_length", "upper", "digits", "high", "stops", "symbols", "top_symbol", "lines", "line_repeats",
    "words_distinct", "top_word", "next_same", "ends_symbol", "bare_symbol", "long_words", "short_words", "fourgrams_distinct", "any_symbol", "capitalised",
    "words_speak", "pairs_speak",
)


def _raw(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def word_buckets(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the words of a text, and of its pairs of neighbouring words."""
    h = np.fromiter(map(crc32, words), dtype=np.int64, count=len(words))
    return h % BUCKETS, BUCKETS + (h[:-1] * 31 + h[1:]) % BUCKETS


@dataclass
class Lexicon:
    """In how many good and bad documents of those learnt from each bucket occurs."""

    counts: np.ndarray  # bad and good, a row each
    documents: np.ndarray

    @cached_property
    def tables(self) -> dict[int | None, np.ndarray]:
        return {own: self._odds(np.arange(2 * BUCKETS), own) for own in (None, 0, 1)}

    def odds(self, buckets: np.ndarray, own: int | None = None) -> np.ndarray:
        """Log-odds of buckets; ``own`` is the label of the document they are taken from, if it
        was learnt from."""
        return self.tables[own][buckets]

    def _odds(self, buckets: np.ndarray, own: int | None = None) -> np.ndarray:
        seen = self.counts[:, buckets].astype(float)
        documents = self.documents.astype(float)
        if own is not None:
            seen[own] -= 1
            documents[own] -= 1
        prior = PRIOR * documents / max(1.0, documents.sum())
        rate = (seen + prior[:, None]) / (documents + PRIOR)[:, None]
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.nan_to_num(np.log(rate[1]) - np.log(rate[0]), nan=0.0, posinf=0.0, neginf=0.0)


def features(text: str | None, lexicon: Lexicon | None = None, own: int | None = None) -> list[float]:
    """Shares and lengths of one whole text, and what its words speak for; zeros for an empty one."""
    raw = _raw(text)
    words = raw.split()
    n, size = len(words), len(raw)
    if not n:
        return [0.0] * len(FEATURES)
    speak = [float(lexicon.odds(b, own).mean()) if lexicon and len(b) else 0.0 for b in word_buckets(words)]
    ink = len(raw.translate(None, _BLANK))
    count = lambda chars: len(raw) - len(raw.translate(None, chars))
    symbols = [raw.count(bytes([b])) for b in _SYMBOLS]
    lines = [x for x in raw.split(b"\n") if x.strip()]
    tally = Counter(words)
    ends = sum(1 for w in words if w[-1] in _SYMBOLS)
    bare = sum(1 for w in words if len(w) <= 2 and w[0] in _SYMBOLS)
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=n)
    quads = set(zip(words, words[1:], words[2:], words[3:]))
    return [
        np.log1p(n), ink / n, count(_UPPER) / ink, count(_DIGIT) / ink, count(_HIGH) / ink, count(_STOPS) / ink, sum(symbols) / ink, max(symbols) / ink,
        len(lines) / n, 1 - len(set(lines)) / max(1, len(lines)),
        len(tally) / n, tally.most_common(1)[0][1] / n, sum(map(bytes.__eq__, words, words[1:])) / n, ends / n, bare / n,
        float((lengths > 12).mean()), float((lengths <= 3).mean()), len(quads) / max(1, n - 3), float(sum(symbols) > 0.02 * size), sum(1 for w in words if 65 <= w[0] <= 90) / n,
        *speak,
    ]


@dataclass
class Ranking:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    threshold: float

    def worth(self, x: np.ndarray) -> np.ndarray:
        return self.standard(x) @ self.weights

    def standard(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -REACH, REACH)

    def score(self, x: np.ndarray) -> np.ndarray:
        z = self.worth(x) - self.threshold + np.log(CUT / (1 - CUT))
        return np.where(z >= np.log(CUT / (1 - CUT)), np.maximum(CUT, 1 / (1 + np.exp(-z))), 1 / (1 + np.exp(-np.minimum(z, 700))))


def preferences(y: np.ndarray, pairs: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Rows of pairs, the better first: all of them, or ``pairs`` drawn with replacement."""
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    if pairs is None:
        return np.repeat(good, len(bad)), np.tile(bad, len(good))
    rng = np.random.default_rng(17)
    return good[rng.integers(len(good), size=pairs)], bad[rng.integers(len(bad), size=pairs)]


class _Memory:
    """Rows in arrays."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        self.x, self.y = x, y

    def sums(self, part, size: int) -> np.ndarray:
        """``part(x, y)``, an array of ``size`` numbers, summed over all rows."""
        return part(self.x, self.y)

    def values(self, part) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct (number, label) of ``part(x, y)`` in order, and how often they occur."""
        return _counted(*part(self.x, self.y), 1)


class _Table:
    """Rows of a table of ``x`` and ``y``; arrays are summed where the rows are, then by place."""

    def __init__(self, rows: DataFrame, width: int):
        self.rows, self.width = rows, width

    def _parts(self, batches, part):
        for b in batches:
            x = b.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, self.width)
            yield part(x, b.column("y").to_numpy(zero_copy_only=False))

    def sums(self, part, size: int) -> np.ndarray:
        parts = _Table(None, self.width)._parts

        def work(batches):
            total = np.zeros(size)
            for found in parts(batches, part):
                total += found
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["j", "v"])

        met = self.rows.mapInArrow(work, "j long, v double").groupBy("j").agg(F.sum("v").alias("v")).toArrow()
        out = np.zeros(size)
        out[met.column("j").to_numpy()] = met.column("v").to_numpy()
        return out

    def values(self, part) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        parts = _Table(None, self.width)._parts

        def work(batches):
            for s, y in parts(batches, part):
                yield pa.RecordBatch.from_arrays([pa.array(s), pa.array(y.astype(np.int32))], names=["s", "y"])

        met = self.rows.mapInArrow(work, "s double, y int").groupBy("s", "y").count().toArrow()
        return _counted(*(met.column(c).to_numpy() for c in ("s", "y", "count")))


def _counted(s: np.ndarray, y: np.ndarray, n) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    order = np.lexsort((y, s))
    return s[order], y[order], np.broadcast_to(n, len(s))[order]


_COS = np.cos((2 * np.arange(NODES) + 1) * np.pi / (2 * NODES))
_TO_NODES = np.cos(np.arange(NODES)[:, None] * np.arccos(_COS)) * np.where(np.arange(NODES) > 0, 2, 1)[:, None] / NODES


def _shares(s: np.ndarray, first: int) -> tuple[np.ndarray, np.ndarray]:
    """The panel of each worth, counted from ``first``, and its share in each of that panel's
    nodes: a smooth function's value at the worth is the sum of shares times values at nodes."""
    panel = np.floor(s / PANEL)
    at = np.clip(2 * (s / PANEL - panel) - 1, -1, 1)
    return (panel - first).astype(np.int64), np.cos(np.arccos(at)[:, None] * np.arange(NODES)) @ _TO_NODES


class _AllPairs:
    """Loss over all pairs of a good and a bad row, and its derivatives."""

    def __init__(self, rows, to_standard, pairs: float, penalty: float):
        self.rows, self.standard, self.pairs, self.penalty = rows, to_standard, pairs, penalty

    def measure(self, w: np.ndarray) -> tuple[float, np.ndarray]:
        reach = REACH * np.abs(w).sum() / PANEL
        first, panels, width = int(np.floor(-reach)) - 1, 2 * int(np.ceil(reach)) + 4, len(w) + 1
        standard = self.standard

        def moments(x, y):
            z = standard(x)
            panel, shares = _shares(z @ w, first)
            own, out = y * panels + panel, np.zeros((2 * panels, NODES, width))
            for k in np.unique(own):
                out[k] = shares[own == k].T @ np.column_stack([np.ones((own == k).sum()), z[own == k]])
            return out.ravel()

        found = self.rows.sums(moments, 2 * panels * NODES * width).reshape(2, panels, NODES, width)
        used = np.flatnonzero(found.any(axis=(0, 2, 3)))
        bad, good = found[:, used].reshape(2, -1, width)
        at = ((first + used)[:, None] + (_COS + 1) / 2).ravel() * PANEL
        gap = at[:, None] - at
        p = 1 / (1 + np.exp(np.clip(gap, -500, 500)))
        self.kept = first, panels, used, bad, good, p * (1 - p)
        slope = (p.T @ good[:, 0]) @ bad[:, 1:] - (p @ bad[:, 0]) @ good[:, 1:]
        return good[:, 0] @ np.logaddexp(0, -gap) @ bad[:, 0] / self.pairs + self.penalty / 2 * w @ w, slope / self.pairs + self.penalty * w

    def curve(self, w: np.ndarray) -> np.ndarray:
        """At the weights measured last."""
        first, panels, used, bad, good, bend = self.kept
        standard, size = self.standard, len(w)
        weight = np.zeros((2, panels, NODES))
        weight[0, used] = (bend.T @ good[:, 0]).reshape(-1, NODES)
        weight[1, used] = (bend @ bad[:, 0]).reshape(-1, NODES)

        def squares(x, y):
            z = standard(x)
            panel, shares = _shares(z @ w, first)
            return (z.T @ (z * (shares * weight[y, panel]).sum(1)[:, None])).ravel()

        crossed = good[:, 1:].T @ bend @ bad[:, 1:]
        return (self.rows.sums(squares, size * size).reshape(size, size) - crossed - crossed.T) / self.pairs + self.penalty * np.eye(size)


class _SomePairs:
    """The same over given differences of rows."""

    def __init__(self, d: np.ndarray, penalty: float):
        self.d, self.penalty = d, penalty

    def measure(self, w: np.ndarray) -> tuple[float, np.ndarray]:
        gap = self.d @ w
        p = 1 / (1 + np.exp(np.clip(gap, -500, 500)))
        return np.logaddexp(0, -gap).mean() + self.penalty / 2 * w @ w, -(self.d * p[:, None]).mean(0) + self.penalty * w

    def curve(self, w: np.ndarray) -> np.ndarray:
        p = 1 / (1 + np.exp(np.clip(self.d @ w, -500, 500)))
        return (self.d * (p * (1 - p))[:, None]).T @ self.d / len(self.d) + self.penalty * np.eye(len(w))


def _minimise(problem, size: int) -> np.ndarray:
    w = np.zeros(size)
    loss, slope = problem.measure(w)
    for _ in range(50):
        if np.abs(slope).max() < 1e-8:
            break
        step, part = np.linalg.solve(problem.curve(w), slope), 1.0
        found = problem.measure(w - step)
        while part > 1e-6 and found[0] > loss + 1e-12:
            part /= 2
            found = problem.measure(w - part * step)
        w, (loss, slope) = w - part * step, found
    return w


def _threshold(rows, worth, reach: float, counts: np.ndarray, bad_share: float) -> float:
    """Between the last worth up to which the weight of rows comes to ``bad_share`` and the next."""
    weight, most = np.array([bad_share, 1 - bad_share]) / counts, bad_share * (1 + 1e-9)
    weigh = lambda c: c[0] * weight[0] + c[1] * weight[1]
    below, cuts = np.zeros(2), []
    low, high = -reach, reach
    binned = lambda s, low, high: np.clip((s - low) * (BINS / max(high - low, 1e-300)), 0, BINS - 1).astype(np.int64)

    def inside(x, y, cuts):
        s, y = worth(x), np.asarray(y)
        for lo, hi, a, b in cuts:
            held = (binned(s, lo, hi) >= a) & (binned(s, lo, hi) <= b)
            s, y = s[held], y[held]
        return s, y

    for _ in range(4):

        def histogram(x, y, low=low, high=high, cuts=tuple(cuts)):
            s, y = inside(x, y, cuts)
            return np.bincount(y * BINS + binned(s, low, high), minlength=2 * BINS).astype(float)

        n = rows.sums(histogram, 2 * BINS).reshape(2, BINS)
        full, past = np.flatnonzero(n.sum(0)), np.flatnonzero(weigh(below[:, None] + np.cumsum(n, 1)) > most)
        at = min(np.searchsorted(full, past[0]) if len(past) else len(full), len(full) - 1)
        a, b = full[max(0, at - 1)], full[at if at else min(1, len(full) - 1)]
        below = below + n[:, :a].sum(1)
        cuts.append((low, high, a, b))
        width = (high - low) / BINS
        low, high = low + a * width, low + (b + 1) * width
        if n[:, a : b + 1].sum() <= LOOKED_UP:
            break
    s, y, n = rows.values(lambda x, y, cuts=tuple(cuts): inside(x, y, cuts))
    upto = below[:, None] + np.cumsum(np.where(y == np.array([[0], [1]]), n, 0), 1)
    past = np.flatnonzero(weigh(upto) > most)
    if len(past):
        k = past[0]
        before = upto[:, k] - np.where(np.arange(2) == y[k], n[k], 0)
        place = before.sum() + min(n[k] - 1, max(0, np.floor((most - weigh(before)) / weight[y[k]])))
    else:
        place = upto[:, -1].sum()
    place = np.clip(place, 1, counts.sum() - 1)
    ends = upto.sum(0)
    return float((s[np.searchsorted(ends, place - 1, "right")] + s[np.searchsorted(ends, place, "right")]) / 2)


def _fit(rows, width: int, bad_share: float, penalty: float, pairs: int | None = None) -> Ranking | None:
    first = rows.sums(lambda x, y: np.r_[np.bincount(y, minlength=2), x.sum(0)], 2 + width)
    counts, n = first[:2], first[:2].sum()
    if not counts.all():
        return None
    mean = first[2:] / n
    scale = np.sqrt(rows.sums(lambda x, y: ((x - mean) ** 2).sum(0), width) / n)
    scale[scale < 1e-9] = 1.0
    found = Ranking(mean, scale, np.zeros(width), 0.0)
    if pairs is None:
        problem = _AllPairs(rows, found.standard, counts[0] * counts[1], penalty)
    else:
        better, worse = preferences(rows.y, pairs)
        z = found.standard(rows.x)
        problem = _SomePairs(z[better] - z[worse], penalty)
    found = Ranking(mean, scale, _minimise(problem, width), 0.0)
    found.threshold = _threshold(rows, found.worth, REACH * np.abs(found.weights).sum() or 1.0, counts, bad_share)
    return found


def fit(x: np.ndarray, y: np.ndarray, bad_share: float, pairs: int | None = None, penalty: float = 1e-3) -> Ranking | None:
    """Weights by Newton steps on all pairs, or on ``pairs`` drawn ones; None without a pair to
    learn from."""
    return _fit(_Memory(x, y), x.shape[1], bad_share, penalty, pairs)


def fit_table(rows: DataFrame, bad_share: float, width: int = len(FEATURES), penalty: float = 1e-3) -> Ranking | None:
    """The same for a table of ``x``, arrays of ``width`` numbers, and ``y``: all rows and pairs."""
    return _fit(_Table(rows, width), width, bad_share, penalty)


def _lexicon(sample: DataFrame) -> Lexicon:
    """Counted where the sample is; a number for each bucket and label comes back."""

    def buckets(batches):
        for b in batches:
            found = np.zeros((2, 2 * BUCKETS), dtype=np.int64)
            for t, y in zip(b.column("text").to_pylist(), b.column("y").to_pylist()):
                found[y, np.unique(np.concatenate(word_buckets(_raw(t).split())))] += 1
            y, k = np.nonzero(found)
            yield pa.RecordBatch.from_arrays([pa.array(y.astype(np.int32)), pa.array(k.astype(np.int32)), pa.array(found[y, k])], names=["y", "k", "n"])

    met = sample.select("text", "y").mapInArrow(buckets, "y int, k int, n long").groupBy("y", "k").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros((2, 2 * BUCKETS), dtype=np.int64)
    counts[met.column("y").to_numpy(), met.column("k").to_numpy()] = met.column("n").to_numpy()
    seen = {r["y"]: r["count"] for r in sample.groupBy("y").count().collect()}
    return Lexicon(counts, np.array([seen.get(0, 0), seen.get(1, 0)]))


def held_out(doc_id: str):
    """Rows never learnt from: crc32 of the id as text leaves no remainder."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def fit_scorer(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", quality: str = "quality"):
    """A column function from text to score, fitted on all labelled rows that aren't held out.

    Documents marked both good and bad, null labels and null ids teach nothing. Without a good
    and a bad document every score is 0.5. Sums of doubles are taken in any order, so scores of
    two runs may differ by rounding.
    """
    marked = (
        labels.filter(F.col(quality).isin(0, 1) & F.col(doc_id).isNotNull())
        .groupBy(F.col(doc_id).alias("doc_id"))
        .agg(F.min(quality).cast("int").alias("y"), F.max(quality).cast("int").alias("z"))
        .filter(F.col("y") == F.col("z"))
        .filter(~held_out("doc_id"))
        .select("doc_id", "y")
    )
    marks = materialize(marked, "marks")  # its size decides how it is joined
    shares = {r["y"]: r["count"] for r in marks.groupBy("y").count().collect()}  # two rows
    model = lexicon = None
    if shares.get(0) and shares.get(1):
        kept = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).filter(~held_out("doc_id"))
        sample = materialize(kept.join(marks, "doc_id").select("text", "y"), "labelled")
        lexicon = _lexicon(sample)
        own = F.pandas_udf(lambda s, y: pd.Series([features(t, lexicon, int(k)) for t, k in zip(s, y)]), "array<double>")
        rows = materialize(sample.select("y", own("text", "y").alias("x")), "features")
        discard(sample)
        model = fit_table(rows, shares[0] / (shares[0] + shares[1]))
        discard(rows)
    discard(marks)

    def scored(texts: pd.Series) -> pd.Series:
        if model is None:
            return pd.Series(np.full(len(texts), 0.5))
        return pd.Series(model.score(np.array([features(t, lexicon) for t in texts], dtype=float).reshape(-1, len(FEATURES))))

    return F.pandas_udf(scored, "double")


def quality_scores(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", quality: str = "quality") -> DataFrame:
    """``doc_id``, ``held_out``, ``score``, ``predicted`` for every row of ``docs``.

    Null, empty and blank texts are scored from features that are all zero. Repeated rows stay;
    a null doc_id is returned and not held out; an empty table gives an empty result. Other
    columns are not read. See :func:`fit_scorer` for what is learnt from.
    """
    score = fit_scorer(docs, labels, doc_id, text, quality)
    out = docs.select(F.col(doc_id).alias("doc_id"), score(F.col(text)).alias("score"))
    return out.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", quality: str = "quality") -> DataFrame:
    """Rows of ``docs`` that are predicted good, with all their columns.

    Repeated rows and those with null ids are judged each by itself, null and empty texts by
    features that are all zero; an empty table gives an empty result.
    """
    score = fit_scorer(docs, labels, doc_id, text, quality)
    return docs.filter(score(F.col(text)) >= CUT)
