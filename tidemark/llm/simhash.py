"""SimHash near-duplicates found with pivot distance tables.

Each distinct fingerprint gets a row of Hamming distances to reference fingerprints. Distances
to one reference differ by at most the distance of the two fingerprints, so a pair whose largest
coordinate difference exceeds the limit is discarded; the others are verified exactly.

The table has two parts. Distances within a segment of the word, to several references each,
decide who is compared at all: of limit + s segments, two fingerprints within the limit differ
in at most ``limit``, and in the s others no coordinate may differ. So rows of the table that
agree in all coordinates of s segments meet under a key, over as many keys as there are choices
of s (ten for a limit of 3 and s = 2); all other pairs are discarded without being looked at.
Those that meet are discarded by their distances over the whole word, sorted by the first of
them. ``s`` grows with the number of fingerprints so that chance seldom puts two of them under
one key; the result is the same.

Keys shared by many fingerprints are dealt out as pairs of bounded blocks. Within a group only
links of a spanning forest are emitted, as many as members at most: they give the same
components as all pairs would.
"""

from __future__ import annotations

from itertools import combinations, repeat

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import ASCII_LOWER, hash_split, materialize
from tidemark.llm.components import connected_components

SHINGLE_WORDS = 3
SEED = 42
LIMIT = 3
#: References whose distances within a segment are its signature.
SEGMENT_REFERENCES = 8
#: Members of a key's group that one task compares at once.
BLOCK = 2048
#: Groups up to this size are compared by shifting, larger ones by a frontier search.
SMALL = 16


def _references(n: int = 16) -> np.ndarray:
    """Reference fingerprints: XXH64 of their numbers."""
    return np.array([xxhash.xxh64_intdigest(str(i).encode(), SEED) for i in range(n)], dtype=np.uint64)


def fingerprint(text: str | None, words_per_shingle: int = SHINGLE_WORDS, seed: int = SEED) -> int:
    """Unsigned 64-bit fingerprint; 0 for a text without words."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(ASCII_LOWER).split()
    if not words:
        return 0
    k = words_per_shingle
    if len(words) < k:
        shingles = [b" ".join(words)]
    else:
        shingles = list(map(b" ".join, zip(*(words[i:] for i in range(k)))))
    n = len(shingles)
    votes = np.zeros(64, dtype=np.int64)
    for at in range(0, n, 1 << 16):  # long texts: a bounded bit matrix
        part = shingles[at : at + (1 << 16)]
        hashes = np.fromiter(map(xxhash.xxh64_intdigest, part, repeat(seed)), dtype="<u8", count=len(part))
        votes += np.unpackbits(hashes.view(np.uint8), bitorder="little").reshape(-1, 64).sum(axis=0, dtype=np.int32)
    return int(np.packbits(2 * votes > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with a column ``fp``, the fingerprint as a signed long."""

    @F.pandas_udf("long")
    def simhash(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint(t) for t in texts], dtype=np.uint64).view(np.int64))

    return docs.withColumn("fp", simhash(F.col(text)))


def shared_segments(n: int, limit: int = LIMIT) -> int:
    """Segments in a key, so that keys have at least two bits more than ``n`` fingerprints ask for."""
    s = 2
    while s < 6 and 64 * s / (limit + s) < np.log2(max(1, n)) + 2:
        s += 1
    return s


def segment_distances(fp: str, limit: int = LIMIT, shared: int = 2):
    """Array of one signature for each of limit + shared segments: its row of distances to
    ``SEGMENT_REFERENCES`` references within the segment."""
    n = limit + shared
    cuts = [round(i * 64 / n) for i in range(n + 1)]
    found = []
    for low, high in zip(cuts, cuts[1:]):
        mask = ((1 << high) - 1) ^ ((1 << low) - 1)
        signed = [x - (1 << 64) if x >> 63 else x for x in (int(r) & mask for r in _references(SEGMENT_REFERENCES))]
        inside = F.col(fp).bitwiseAND(F.lit(mask - (1 << 64) if mask >> 63 else mask))
        found.append(F.xxhash64(*[F.bit_count(inside.bitwiseXOR(F.lit(r))) for r in signed]))
    return F.array(*found)


def segment_keys(signatures: str, limit: int = LIMIT, shared: int = 2):
    """Array of (tab, key): a key for each choice of ``shared`` of limit + shared segments.

    Keys are hashes of distances: two that clash bring together pairs that are then discarded.
    """
    s = F.col(signatures)
    keys = [F.struct(F.lit(t).alias("tab"), F.xxhash64(*[s[i] for i in chosen]).alias("key")) for t, chosen in enumerate(combinations(range(limit + shared), shared))]
    return F.array(*keys)


def _near(x: np.ndarray, y: np.ndarray, tx: np.ndarray, ty: np.ndarray, limit: int) -> np.ndarray:
    """Indices of pairs (x[i], y[i]) within the limit: coordinates first, then exact distance."""
    left = np.arange(len(x))
    for c in range(tx.shape[1]):
        if not len(left):
            return left
        left = left[np.abs(tx[left, c] - ty[left, c]) <= limit]
    return left[np.bitwise_count(x[left] ^ y[left]) <= limit]


def _forest(fp: np.ndarray, table: np.ndarray, limit: int):
    """Links of a spanning forest of one group, by frontier search over what isn't reached yet."""
    order = np.argsort(table[:, 0], kind="stable")
    fp, table = fp[order], table[order]
    rest = np.arange(len(fp))  # unreached, ordered by the first coordinate
    out = []
    while len(rest):
        stack, rest = [rest[0]], rest[1:]
        while stack and len(rest):
            x = stack.pop()
            first = table[rest, 0]
            lo, hi = np.searchsorted(first, table[x, 0] - limit, "left"), np.searchsorted(first, table[x, 0] + limit, "right")
            window = rest[lo:hi]
            if not len(window):
                continue
            hit = _near(np.broadcast_to(fp[x], len(window)), fp[window], np.broadcast_to(table[x], (len(window), table.shape[1])), table[window], limit)
            if len(hit):
                reached = window[hit]
                out.append(np.stack([np.full(len(reached), x), reached], axis=1))
                rest = np.delete(rest, lo + hit)
                stack.extend(reached.tolist())
    found = np.concatenate(out) if out else np.zeros((0, 2), dtype=int)
    return order[found[:, 0]], order[found[:, 1]]


def group_links(fp: np.ndarray, group: np.ndarray, limit: int = LIMIT):
    """Index pairs that link fingerprints within each run of equal ``group``."""
    pivots = _references()
    fp = fp.view(np.uint64)
    table = np.bitwise_count(fp[:, None] ^ pivots[None, :]).astype(np.int16)
    starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]]) if len(group) else np.zeros(0, int)
    sizes = np.diff(np.r_[starts, len(group)])
    left, right = [], []
    small = np.repeat(sizes <= SMALL, sizes)
    for shift in range(1, int(min(SMALL, sizes.max(initial=1)))):
        i = np.flatnonzero((group[:-shift] == group[shift:]) & small[:-shift])
        if not len(i):
            break
        hit = i[_near(fp[i], fp[i + shift], table[i], table[i + shift], limit)]
        left.append(hit)
        right.append(hit + shift)
    for s, n in zip(starts[sizes > SMALL], sizes[sizes > SMALL]):
        a, b = _forest(fp[s : s + n], table[s : s + n], limit)
        left.append(s + a)
        right.append(s + b)
    empty = np.zeros(0, dtype=int)
    return np.concatenate(left or [empty]), np.concatenate(right or [empty])


def _group_ids(pdf: pd.DataFrame) -> np.ndarray:
    keys = pdf[["tab", "key", "bi", "bj"]].to_numpy()
    return np.cumsum(np.r_[0, (keys[1:] != keys[:-1]).any(axis=1)]) if len(keys) else np.zeros(0, int)


def fingerprint_links(distinct: DataFrame, limit: int = LIMIT, block: int = BLOCK, shared: int = 2) -> DataFrame:
    """Links ``a``, ``b`` whose components are those of all pairs within ``limit`` bits.

    ``distinct`` has one row per fingerprint in ``fp``.
    """
    table = materialize(distinct.select("fp", segment_distances("fp", limit, shared).alias("signatures")), "distances")
    keyed = table.select("fp", F.explode(segment_keys("signatures", limit, shared)).alias("k")).select("fp", "k.tab", "k.key")
    hot = (
        keyed.groupBy("tab", "key")
        .count()
        .filter(F.col("count") > block)
        .select("tab", "key", F.ceil(F.col("count") / block).cast("int").alias("blocks"))
    )
    hot = materialize(hot, "hot-keys")  # at most a row for each ``block`` keys
    own = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    plain = keyed.join(hot, ["tab", "key"], "left_anti").select("tab", "key", F.lit(0).alias("bi"), F.lit(0).alias("bj"), "fp")
    dealt = (
        keyed.join(hot, ["tab", "key"])
        .withColumn("own", own)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("tab", "key", F.least("own", "other").alias("bi"), F.greatest("own", "other").alias("bj"), "fp")
    )
    groups = ["tab", "key", "bi", "bj"]
    ready = hash_split(plain.unionByName(dealt), *groups).sortWithinPartitions(*groups)

    def compare(batches):
        carried = None
        for pdf in batches:
            pdf = pdf if carried is None else pd.concat([carried, pdf], ignore_index=True)
            ids = _group_ids(pdf)
            whole = int(np.searchsorted(ids, ids[-1], "left")) if len(ids) else 0
            carried = pdf.iloc[whole:].reset_index(drop=True)  # the last group may go on
            if whole:
                yield links(pdf.iloc[:whole], ids[:whole])
        if carried is not None and len(carried):
            yield links(carried, _group_ids(carried))

    def links(pdf, ids):
        fp = pdf["fp"].to_numpy()
        a, b = group_links(fp, ids, limit)
        return pd.DataFrame({"a": fp[a], "b": fp[b]})

    return ready.mapInPandas(compare, "a long, b long")


def simhash_components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", limit: int = LIMIT) -> DataFrame:
    """``doc_id``, ``fingerprint``, ``component_id`` for each row of ``docs``.

    Fingerprints link at ``limit`` or fewer differing bits; ``component_id`` is the smallest
    doc_id reachable. A null, empty or blank text has fingerprint zero and links like any
    other. A row whose doc_id is null keeps its fingerprint and counts as a member, but never
    names a component (null only if all members are null). Repeated rows stay. An empty table
    gives an empty result. Other columns of ``docs`` are not read.
    """
    marked = materialize(fingerprints(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))).select("doc_id", "fp"), "fingerprints")
    nodes = materialize(marked.groupBy("fp").agg(F.min("doc_id").alias("least_id")), "fingerprint-classes")
    parts = connected_components(fingerprint_links(nodes.select("fp"), limit, shared=shared_segments(nodes.count(), limit)))
    labelled = nodes.join(parts, nodes.fp == parts.node, "left").select("fp", "least_id", F.coalesce("component", "fp").alias("label"))
    names = materialize(labelled.groupBy("label").agg(F.min("least_id").alias("component_id")), "names")
    by_fp = materialize(labelled.join(names, "label").select("fp", "component_id"), "named")  # a shuffle apart from the sums: it may be split
    return marked.join(by_fp, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one_per_group(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", limit: int = LIMIT) -> DataFrame:
    """Rows of ``docs`` whose doc_id names their component: one document of each group stays.

    Rows with a null doc_id stay as they are: nothing says which of them is the same document.
    Rows that repeat the id that stays all stay. Null, empty and blank texts are one group; an
    empty table gives an empty result.
    """
    known = docs.filter(F.col(doc_id).isNotNull())
    found = simhash_components(known, doc_id, text, limit)
    named = found.filter("doc_id = component_id").select(F.col("doc_id").alias(doc_id)).distinct()
    return known.join(named, doc_id, "left_semi").select(docs.columns).unionByName(docs.filter(F.col(doc_id).isNull()))
