"""Substring dedup by suffix trees over groups of suffixes with common prefixes.

A suffix starts at a word and matters up to ``WINDOW`` words. Its prefix, by which suffixes are
split into groups, has variable length: it ends with the run of ``GRAM`` words whose hash is the
smallest in those words, so it has ``GRAM`` to ``WINDOW`` words. Prefixes that end in the same run
stay together; neighbouring suffixes mostly do, and travel as one stretch of text, about once per
repeated passage and not once per suffix. A run found in one document alone can't belong to a
repeat, and its suffixes go no further.

Every group is made a suffix tree in compact form: its suffixes in order, the depth in words
each shares with the next, and internal nodes read off these depths with a stack. Internal nodes
at least ``WINDOW`` words deep hold the repeats, the smallest doc_id below one owns it, and those
that differ in the word before are the maximal repeats.

A group of more than ``GROUP`` documents, too large for a task, has its prefixes lengthened to
all ``WINDOW`` words. Each such prefix is an internal node by itself, and what is asked of it,
the smallest doc_id, is an aggregate: a chunk sends a row for each distinct prefix in it and
gets the owners back. So no group is unbounded, and a passage that a third of all documents
share costs a row for each chunk.

Texts are written once, as compressed chunks in the shared folder; later passes read a chunk
at a time, and only keys, stretches and ranges of removed words are shuffled. Wholly equal
texts are settled by a digest before that.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import hash_split, materialize, run_per_file, scratch_path, shared_file_system, whole_groups

WINDOW = 13
#: Words of the runs that end prefixes.
GRAM = 6
#: Bytes of text in a chunk.
CHUNK_BYTES = 8 << 20
CHUNK_DOCS = 1 << 16
#: Documents of a group up to which one task builds its tree.
GROUP = 4_000

_BLANK = np.zeros(256, dtype=bool)
_BLANK[[32, *range(9, 14)]] = True
_rng = np.random.default_rng(20)
_BYTES = _rng.integers(1, 2**63, size=256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTES[_BLANK] = 0
_STEP = np.uint64(0x9E3779B97F4A7C15)
_STRIDE = np.uint64(0xD1342543DE82EF95)
_MIX = np.uint64(0xBF58476D1CE4E5B9)
_POWERS = np.cumprod(np.r_[np.uint64(1), np.full(4095, _STEP, dtype=np.uint64)], dtype=np.uint64)
#: Words whose bytes are hashed at once.
_SLICE = 100_000


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _MIX
    return x ^ (x >> np.uint64(29))


class Words:
    """Words of several texts at once: hashes, and which suffixes are long enough."""

    def __init__(self, texts: list[bytes], window: int = WINDOW, gram: int = GRAM):
        self.window = window
        data = np.frombuffer(b" ".join([*texts, b""]), dtype=np.uint8)
        ink = ~_BLANK[data]
        self.starts = np.flatnonzero(ink & np.r_[True, ~ink[:-1]][: len(ink)])
        n = len(self.starts)
        lengths = np.array([len(t) for t in texts], dtype=np.int64)
        begins = np.r_[0, np.cumsum(lengths + 1)]
        # first word of each text, and the text of each word
        self.first = np.searchsorted(self.starts, begins)
        self.keys = np.zeros(0, dtype=np.uint64)
        self.owner = np.repeat(np.arange(len(texts)), np.diff(self.first))
        if n < window:
            self.valid = np.zeros(0, dtype=bool)
            return
        hashes = np.empty(n, dtype=np.uint64)
        for i in range(0, n, _SLICE):  # a slice at a time: eight bytes for each byte of text, several times over
            j = min(n, i + _SLICE)
            begin, end = self.starts[i], self.starts[j] if j < n else len(data)
            own = self.starts[i:j] - begin
            place = np.arange(end - begin) - np.repeat(own, np.diff(np.r_[own, end - begin]))
            hashes[i:j] = np.add.reduceat(_BYTES[data[begin:end]] * _POWERS[place % len(_POWERS)], own)
        words = self.words = _mixed(hashes)
        grams = np.zeros(n - gram + 1, dtype=np.uint64)
        for j in range(gram):
            grams = grams * _STEP + words[j : n - gram + 1 + j]
        grams = _mixed(grams)
        # smallest of the window - gram + 1 runs from each word on
        left, size, low = window - gram + 1, 1, grams
        while size < left:
            hop = min(size, left - size)
            low = np.minimum(low[:-hop], low[hop:])
            size += hop
        self.keys = low
        self.valid = self.owner[: n - window + 1] == self.owner[window - 1 :]

    def stretches(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Runs of suffixes of one text with one key: text, key, first suffix and number."""
        k, o, ok = self.keys, self.owner[: len(self.keys)], self.valid
        if not len(k):
            none = np.zeros(0, dtype=np.int64)
            return none, none.astype(np.uint64), none, none
        new = np.r_[True, (k[1:] != k[:-1]) | (o[1:] != o[:-1]) | (ok[1:] != ok[:-1])]
        at = np.flatnonzero(new)
        count = np.diff(np.r_[at, len(k)])
        use = ok[at]
        at, count = at[use], count[use]
        return o[at], k[at], at - self.first[o[at]], count

    def marks(self) -> np.ndarray:
        """A digest of the window from each word on."""
        n = len(self.words) - self.window + 1
        out = np.zeros(n, dtype=np.uint64)
        for j in range(self.window):
            out = out * _STRIDE + self.words[j : n + j]
        return _mixed(out)


# ---- chunks of text

_CHUNK = pa.schema([("doc_id", pa.int64()), ("text", pa.binary())])
#: Suffixes with lengthened prefixes: number of the text, first word, run, digest of the words.
_SIDE = pa.schema([("idx", pa.int32()), ("at", pa.int32()), ("key", pa.int64()), ("mark", pa.int64())])


def _write(folder: str, table: pa.RecordBatch) -> str:
    """A file of its own for every attempt of a task; it counts once it has been reported."""
    fs, path = shared_file_system(folder)
    name = f"{uuid.uuid4().hex}.arrow"
    with fs.open_output_stream(f"{path}/{name}", compression=None) as out:
        with pa.ipc.new_stream(out, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
            w.write_batch(table)
    return name


def _read(folder: str, name: str) -> pa.Table:
    fs, path = shared_file_system(folder)
    with fs.open_input_stream(f"{path}/{name}", compression=None) as f:
        return pa.ipc.open_stream(f).read_all()


def _read_chunk(folder: str, name: str) -> tuple[list, list]:
    t = _read(folder, name)
    return t.column("doc_id").to_pylist(), t.column("text").to_pylist()


def write_chunks(docs: DataFrame) -> tuple[str, DataFrame]:
    """Texts as chunk files; a table with a row for each text, and one with a ``file`` for each chunk."""
    spark = docs.sparkSession
    folder = scratch_path(spark, "chunks")
    fs, path = shared_file_system(folder)
    fs.create_dir(path, recursive=True)
    schema = pa.schema([("chunk", pa.int64()), ("idx", pa.int32()), ("doc_id", pa.int64()), ("digest", pa.binary()), ("file", pa.string())])

    def write(batches):
        base, seq = TaskContext.get().partitionId() << 20, 0
        ids, texts, size = [], [], 0

        def close():
            name = _write(folder, pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(texts, pa.binary())], schema=_CHUNK))
            n = len(ids)
            marks = [hashlib.blake2b(t, digest_size=16).digest() for t in texts]
            columns = [[base + seq] * (n + 1), [*range(n), None], [*ids, None], [*marks, None], [None] * n + [name]]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, schema.types)], schema=schema)

        for b in batches:
            for i, t in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist()):
                ids.append(i)
                texts.append(t or b"")
                size += len(texts[-1])
                if size >= CHUNK_BYTES or len(ids) >= CHUNK_DOCS:
                    yield close()
                    ids, texts, size, seq = [], [], 0, seq + 1
        if ids:
            yield close()

    return folder, materialize(docs.mapInArrow(write, "chunk long, idx int, doc_id long, digest binary, file string"), "chunks")


# ---- keys and stretches

_REF = 20  # bits of a text's number within its chunk


def _taking_part(ids: list, texts: list[bytes], copies: list[int] | None) -> list[bytes]:
    """Texts with those left empty that have no suffixes of their own."""
    skip = set(copies or ())
    return [b"" if i is None or n in skip else t for n, (i, t) in enumerate(zip(ids, texts))]


def prefix_counts(folder: str, chunks: DataFrame, files: int, window: int, gram: int) -> DataFrame:
    """``chunk``, ``key``, ``docs``: the runs that end prefixes in a chunk, and in how many of its
    documents."""
    schema = pa.schema([("chunk", pa.int64()), ("key", pa.int64()), ("docs", pa.int32())])

    def keys(batches):
        for b in batches:
            for chunk, name, copies in zip(*(b.column(c).to_pylist() for c in ("chunk", "file", "copies"))):
                ids, texts = _read_chunk(folder, name)
                owner, key, _, _ = Words(_taking_part(ids, texts, copies), window, gram).stretches()
                order = np.lexsort((owner, key))
                key, owner = key[order], owner[order]
                once = np.r_[True, (key[1:] != key[:-1]) | (owner[1:] != owner[:-1])][: len(key)]
                found, docs = np.unique(key[once], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found), chunk)), pa.array(found.view(np.int64)), pa.array(docs.astype(np.int32))], schema=schema)

    return run_per_file(chunks, keys, "chunk long, key long, docs int", files)


_ROWS = {"key": pa.int64(), "doc_id": pa.int64(), "ref": pa.int64(), "at": pa.int32(), "n": pa.int32(), "text": pa.binary(), "mark": pa.int64(), "most": pa.int64(), "side": pa.string()}


def stretches(folder: str, chunks: DataFrame, files: int, window: int, gram: int) -> DataFrame:
    """Suffixes whose run occurs in several documents, in rows of three kinds.

    Stretches for trees: ``key``, ``doc_id``, ``ref``, ``at`` (first word), ``n`` (suffixes) and
    ``text``. Lengthened prefixes, one row for each distinct one in a chunk: ``key``, ``mark``,
    and the smallest and largest doc_id as ``doc_id`` and ``most``. For a chunk that has any of
    these, ``side``: the file that says where.
    """
    schema = pa.schema(list(_ROWS.items()))

    def rows(size: int, **columns):
        return pa.RecordBatch.from_arrays([pa.array(columns[c], t) if c in columns else pa.nulls(size, t) for c, t in _ROWS.items()], schema=schema)

    def gather(batches):
        for b in batches:
            for i in range(b.num_rows):
                chunk, name, copies = (b.column(c)[i].as_py() for c in ("chunk", "file", "copies"))
                found = b.column("found")[i].values
                if found is None or not len(found):
                    continue
                wanted, big = (np.asarray(found.field(f).to_numpy(zero_copy_only=False)) for f in ("key", "big"))
                order = np.argsort(wanted)
                wanted, big = wanted[order], big[order].astype(bool)
                ids, texts = _read_chunk(folder, name)
                texts = _taking_part(ids, texts, copies)
                words = Words(texts, window, gram)
                owner, key, at, n = words.stretches()
                key = key.view(np.int64)
                spot = np.minimum(np.searchsorted(wanted, key), len(wanted) - 1)
                hit = wanted[spot] == key
                large = hit & big[spot]
                out: list[list] = [[] for _ in range(6)]
                last, split = -1, []
                for j in np.flatnonzero(hit & ~large).tolist():
                    o = int(owner[j])
                    if o != last:
                        last, split = o, texts[o].split()
                    a, m = int(at[j]), int(n[j])
                    for c, v in zip(out, (int(key[j]), ids[o], (chunk << _REF) + o, a, m, b" ".join(split[a : a + m + window - 1]))):
                        c.append(v)
                if out[0]:
                    yield rows(len(out[0]), **dict(zip(("key", "doc_id", "ref", "at", "n", "text"), out)))
                if large.any():
                    times = n[large]
                    o, k = np.repeat(owner[large], times), np.repeat(key[large], times)
                    place = np.repeat(at[large], times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
                    mark = words.marks()[words.first[o] + place].view(np.int64)
                    side = _write(folder, pa.RecordBatch.from_arrays([pa.array(o, pa.int32()), pa.array(place, pa.int32()), pa.array(k), pa.array(mark)], schema=_SIDE))
                    doc = np.array([-1 if x is None else x for x in ids], dtype=np.int64)[o]
                    order = np.lexsort((doc, mark, k))
                    k, mark, doc = k[order], mark[order], doc[order]
                    first = np.flatnonzero(np.r_[True, (k[1:] != k[:-1]) | (mark[1:] != mark[:-1])])
                    final = np.r_[first[1:], len(k)] - 1
                    yield rows(len(first), key=k[first], mark=mark[first], doc_id=doc[first], most=doc[final], ref=np.full(len(first), chunk << _REF))
                    yield rows(1, ref=[chunk << _REF], side=[side])

    return run_per_file(chunks, gather, "key long, doc_id long, ref long, at int, n int, text binary, mark long, most long, side string", files)


# ---- trees


class Subtree:
    """Suffix tree of one group in compact form: suffixes in order, and common depths.

    ``texts`` are the group's distinct stretches, words joined by one blank. ``leaves`` are
    (stretch, suffix) in the order of their words; ``depth[i]`` is the number of words leaf i
    shares with leaf i - 1. A run of leaves whose depths stay above those around it is an
    internal node.
    """

    def __init__(self, texts: list[bytes], window: int = WINDOW):
        self.window = window
        self.words = [t.split(b" ") for t in texts]
        # a blank at the end: leaves with common words are neighbours whatever bytes words hold
        order = sorted((b" ".join([*words[i:], b""]), t, i) for t, words in enumerate(self.words) for i in range(len(words) - window + 1))
        self.leaves = [(t, i) for _, t, i in order]
        self.depth = [0] * len(order)
        for x in range(1, len(order)):
            (t, i), (s, j) = self.leaves[x - 1], self.leaves[x]
            if order[x - 1][0] == order[x][0]:
                self.depth[x] = len(self.words[t]) - i
                continue
            n = 0
            for a, b in zip(self.words[t][i:], self.words[s][j:]):
                if a != b:
                    break
                n += 1
            self.depth[x] = n

    def nodes(self) -> Iterator[tuple[int, int, int]]:
        """Internal nodes at least ``window`` words deep: depth, first leaf, end of leaves.

        A node comes after all nodes below it.
        """
        stack: list[tuple[int, int]] = []  # depth and first leaf of the nodes still open
        for x in range(1, len(self.leaves) + 1):
            d, begin = self.depth[x] if x < len(self.leaves) else 0, x - 1
            while stack and stack[-1][0] > d:
                deep, begin = stack.pop()
                yield deep, begin, x
            if d >= self.window and (not stack or stack[-1][0] < d):
                stack.append((d, begin))

    def repeats(self) -> Iterator[list[tuple[int, int]]]:
        """Places (stretch, suffix) below each of the uppermost of these nodes."""
        top: list[tuple[int, int]] = []
        for _, a, b in self.nodes():
            while top and top[-1][0] >= a:  # nodes below this one
                top.pop()
            top.append((a, b))
        for a, b in top:
            yield self.leaves[a:b]

    def maximal_repeats(self) -> Iterator[tuple[bytes, list[tuple[int, int]]]]:
        """Text and places of the repeats that no word before or after extends everywhere."""
        for d, a, b in self.nodes():
            places = self.leaves[a:b]
            if len({self.words[t][i - 1] if i else (t,) for t, i in places}) > 1:
                t, i = places[0]
                yield b" ".join(self.words[t][i : i + d]), places


def owned_elsewhere(texts: list[bytes], docs: list[int], counts: list[int], window: int = WINDOW) -> Iterator[tuple[int, int, int]]:
    """Ranges (row, first suffix, last suffix) that start in a document with a smaller id."""
    if min(docs) == max(docs):
        return
    least: dict[bytes, int] = {}
    for t, d in zip(texts, docs):
        least[t] = min(d, least.get(t, d))
    distinct = list(least)
    owners: dict[bytes, list[int]] = {t: [least[t]] for t in distinct}
    if len(distinct) > 1:
        owners = {t: [least[t]] * n for t, n in zip(texts, counts)}
        for node in Subtree(distinct, window).repeats():
            low = min(least[distinct[t]] for t, _ in node)
            for t, i in node:
                owners[distinct[t]][i] = low
    for row, (t, d, n) in enumerate(zip(texts, docs, counts)):
        own = owners[t]
        if len(distinct) == 1:
            if own[0] < d:
                yield row, 0, n - 1
            continue
        begin = None
        for i in range(n):
            if own[i] < d:
                begin = i if begin is None else begin
            elif begin is not None:
                yield row, begin, i - 1
                begin = None
        if begin is not None:
            yield row, begin, n - 1


def _tree_ranges(rows: DataFrame, window: int) -> DataFrame:
    """``ref``, ``first``, ``last``: suffixes owned elsewhere, from the groups that get trees."""
    ready = hash_split(rows.select("key", "doc_id", "ref", "at", "n", "text"), "key").sortWithinPartitions("key")
    schema = pa.schema([("ref", pa.int64()), ("first", pa.int32()), ("last", pa.int32())])

    def trees(batches):
        for table, cuts in whole_groups(batches, "key"):
            doc, ref, at, n, text = (table.column(c).to_pylist() for c in ("doc_id", "ref", "at", "n", "text"))
            out: list[list] = [[], [], []]
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                for r, i, j in owned_elsewhere(text[a:b], doc[a:b], n[a:b], window):
                    for c, v in zip(out, (ref[a + r], at[a + r] + i, at[a + r] + j)):
                        c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, schema.types)], schema=schema)

    return ready.mapInArrow(trees, "ref long, first int, last int")


# ---- the operator

OUTPUTS = {"n_words": pa.int64(), "n_removed": pa.int64(), "kept": pa.string(), "kept_sha256": pa.string()}


def dedup_substrings(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, doc_id: str = "doc_id", text: str = "text", outputs: tuple[str, ...] = ("n_words", "n_removed", "kept")) -> DataFrame:
    """``doc_id`` and ``outputs`` for each row of ``docs``.

    Words are maximal runs of anything but the six ASCII blanks. A word goes if it is covered
    by ``window`` consecutive words that also start in a document with a smaller doc_id, judged
    on the input; ``kept`` has the other words joined by one blank, ``kept_sha256`` its digest.

    Null, empty and blank texts have no words; fewer than ``window`` words lose none. Of wholly
    equal texts the smallest doc_id keeps its words. Rows that repeat a doc_id are one document:
    they take nothing from each other. A row with a null doc_id takes no part and keeps all. An
    empty table gives an empty result; other columns aren't read.
    """
    if not 1 <= gram <= window:
        raise ValueError("gram is from 1 to window")
    folder, table = write_chunks(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("binary").alias("text")))
    texts = table.filter("file IS NULL AND doc_id IS NOT NULL").select("chunk", "idx", "doc_id", "digest")
    firsts = materialize(texts.groupBy("digest").agg(F.min("doc_id").alias("least"), F.count("*").alias("times")).filter("times > 1").drop("times"), "first-copies")
    copies = texts.join(firsts, "digest").filter("doc_id > least").groupBy("chunk").agg(F.collect_list("idx").alias("copies"))
    chunks = materialize(table.filter("file IS NOT NULL").select("chunk", "file").join(copies, "chunk", "left"), "chunk-files")
    files = chunks.count()

    # one row for each chunk that has a run, however many of its documents do
    counted = materialize(prefix_counts(folder, chunks, files, window, gram), "prefixes")
    known = hash_split(counted, "key")
    sizes = known.groupBy("key").agg(F.sum("docs").alias("all")).filter(F.col("all") > 1).select(F.col("key").alias("run"), (F.col("all") > GROUP).alias("big"))
    several = known.join(sizes.hint("merge"), F.col("key") == F.col("run")).groupBy("chunk").agg(F.collect_list(F.struct("key", "big")).alias("found"))
    # what is found is far larger than the list of files it comes from, all that Spark can go by:
    # without the hint it would be broadcast
    rows = materialize(stretches(folder, chunks.join(several.hint("merge"), "chunk", "left"), files, window, gram), "stretches")
    ranges = _tree_ranges(rows.filter("text IS NOT NULL"), window)
    chunk_of = F.shiftright("ref", _REF).alias("chunk")
    by_chunk = ranges.groupBy(chunk_of).agg(F.collect_list(F.struct(F.col("ref").bitwiseAND((1 << _REF) - 1).alias("idx"), "first", "last")).alias("ranges"))
    marks = rows.filter("mark IS NOT NULL").select(chunk_of, "key", "mark", "doc_id", "most")
    owners = materialize(marks.groupBy("key", "mark").agg(F.min("doc_id").alias("owner"), F.max("most").alias("last")).filter("owner < last").drop("last"), "owners")
    owned = marks.join(owners, ["key", "mark"]).filter("owner < most").groupBy("chunk").agg(F.collect_list(F.struct("key", "mark", "owner")).alias("owned"))
    sides = rows.filter("side IS NOT NULL").select(chunk_of, "side")
    all_known = chunks.join(by_chunk.hint("merge"), "chunk", "left").join(owned.hint("merge"), "chunk", "left").join(sides, "chunk", "left")
    done = pa.schema([("doc_id", pa.int64()), *[(c, OUTPUTS[c]) for c in outputs]])

    def lengthened(b, i, ids):
        """Text and first word of the suffixes whose lengthened prefix is owned elsewhere."""
        owned = b.column("owned")[i].values
        if owned is None or not len(owned):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        pair = np.dtype([("key", np.int64), ("mark", np.int64)])
        own, side = np.zeros(len(owned), pair), _read(folder, b.column("side")[i].as_py())
        mine = np.zeros(side.num_rows, pair)
        for c in pair.names:
            own[c], mine[c] = owned.field(c).to_numpy(), side.column(c).to_numpy()
        order = np.argsort(own, order=pair.names)
        own, low = own[order], owned.field("owner").to_numpy()[order]
        spot = np.minimum(np.searchsorted(own, mine), len(own) - 1)
        idx, at = side.column("idx").to_numpy(), side.column("at").to_numpy()
        doc = np.array([-1 if x is None else x for x in ids], dtype=np.int64)
        gone = (own[spot] == mine) & (low[spot] < doc[idx])
        return idx[gone], at[gone]

    def finish(batches):
        for b in batches:
            for i in range(b.num_rows):
                name, copies = b.column("file")[i].as_py(), set(b.column("copies")[i].as_py() or ())
                found = b.column("ranges")[i].values
                idx, first, last = (np.asarray(found.field(f)) if found is not None else np.zeros(0, np.int64) for f in ("idx", "first", "last"))
                ids, texts = _read_chunk(folder, name)
                more, at = lengthened(b, i, ids)
                idx, first, last = np.r_[idx, more], np.r_[first, at], np.r_[last, at]
                order = np.argsort(idx, kind="stable")
                idx, first, last = idx[order], first[order], last[order]
                edges = np.searchsorted(idx, np.arange(len(ids) + 1))
                values: dict[str, list] = {c: [] for c in outputs}
                for d, t in enumerate(texts):
                    words = t.split()
                    n, kept = len(words), words
                    if d in copies:
                        kept = words if n < window else []
                    elif edges[d] < edges[d + 1]:
                        cover = np.zeros(n + 1, dtype=np.int64)
                        np.add.at(cover, first[edges[d] : edges[d + 1]], 1)
                        np.add.at(cover, last[edges[d] : edges[d + 1]] + window, -1)
                        kept = [words[w] for w in np.flatnonzero(np.cumsum(cover[:-1]) == 0)]
                    joined = b" ".join(kept)
                    for c, v in (("n_words", n), ("n_removed", n - len(kept)), ("kept", joined), ("kept_sha256", joined)):
                        if c in values:
                            values[c].append(hashlib.sha256(v).hexdigest() if c == "kept_sha256" else v)
                yield pa.RecordBatch.from_pydict({"doc_id": ids, **values}, schema=done)

    types = {"n_words": "long", "n_removed": "long", "kept": "string", "kept_sha256": "string"}
    return run_per_file(all_known, finish, ", ".join(["doc_id long", *[f"{c} {types[c]}" for c in outputs]]), files)
