"""Token counts of documents in flat, unindexed token files.

A flat file is nothing but token ids of a fixed width; a document ends with the
end-of-document id. The scan cuts every file into blocks of equal size, finds the separators
of a block with one vectorised comparison, and stitches documents that run over block borders
with a prefix scan: the place of the last separator and the number of separators before a
block are running aggregates over a file's block summaries, a few numbers each.
"""

from __future__ import annotations

import base64
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import materialize, scratch_path, shared_file_system, shuffle_partitions

#: Bytes of a block; a multiple of every item width.
BLOCK_BYTES = 16 << 20
#: Bytes at which the writer begins another file.
FILE_BYTES = 256 << 20
#: Characters of a text that are encoded at once.
PIECE = 1_000_000

_ENCODINGS: dict[int, object] = {}


def _encoding(ranks_file: str):
    """Encoding of a rank file's content; one for a worker."""
    import public_tokenizers
    import tiktoken

    key = hash(ranks_file)
    if key not in _ENCODINGS:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in ranks_file.splitlines() if line)}
        _ENCODINGS.clear()
        _ENCODINGS[key] = tiktoken.Encoding("flat", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _ENCODINGS[key]


def _token_ids(encoding, text: str) -> np.ndarray:
    at, parts = 0, []
    while len(text) - at > PIECE:  # a piece ends between a character and a blank, where no token goes on
        cut = text.find(" ", at + PIECE)
        while cut > 0 and text[cut - 1].isspace():
            cut = text.find(" ", cut + 1)
        if cut < 0:
            break
        parts.append(encoding.encode_ordinary(text[at:cut]))
        at = cut
    parts.append(encoding.encode_ordinary(text[at:]))
    return np.concatenate([np.asarray(p, dtype=np.uint32) for p in parts])


def write_token_files(docs: DataFrame, ranks_path: str, eod: int, dtype: str = "<u2", doc_id: str = "doc_id", text: str = "text") -> tuple[str, DataFrame]:
    """Encodes documents into flat files in the shared folder.

    Gives the folder and a table ``file``, ``ordinal``, ``doc_id``, ``bytes``: a row for each
    document in the order of its file, and for each file a row with ``ordinal`` -1 and its
    size. Null and empty texts are documents without tokens. Files of attempts that did not
    finish aren't in the table.
    """
    if eod > np.iinfo(np.dtype(dtype)).max:
        raise ValueError(f"{eod} needs a wider type than {dtype}")
    spark = docs.sparkSession
    folder = scratch_path(spark, "tokens")
    fs, inner = shared_file_system(folder)
    fs.create_dir(inner, recursive=True)
    with open(ranks_path, encoding="ascii") as f:
        ranks = spark.sparkContext.broadcast(f.read())  # the vocabulary file, below a megabyte
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    schema = pa.schema([("file", pa.string()), ("ordinal", pa.int64()), ("doc_id", pa.int64()), ("bytes", pa.int64())])

    def write(batches):
        encoding, end = _encoding(ranks.value), np.array([eod], dtype=dtype).tobytes()
        fs, inner = shared_file_system(folder)
        out, name, size, ids = None, None, 0, []

        def closed():
            out.close()
            n = len(ids)
            return pa.RecordBatch.from_pydict({"file": [name] * (n + 1), "ordinal": [*range(n), -1], "doc_id": [*ids, None], "bytes": [None] * n + [size]}, schema=schema)

        for b in batches:
            for i, t in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist()):
                if out is None:
                    name, size, ids = f"{uuid.uuid4().hex}.bin", 0, []
                    out = fs.open_output_stream(f"{inner}/{name}", compression=None)
                data = _token_ids(encoding, t or "").astype(dtype).tobytes() + end
                out.write(data)
                size += len(data)
                ids.append(i)
                if size >= FILE_BYTES:
                    yield closed()
                    out = None
        if out is not None:
            yield closed()

    return folder, materialize(rows.mapInArrow(write, "file string, ordinal long, doc_id long, bytes long"), "token-files")


def list_token_files(spark, folder: str) -> DataFrame:
    """``file``, ``bytes`` of all files directly in a shared folder, each once; none of an empty one."""
    from pyarrow.fs import FileSelector, FileType

    fs, inner = shared_file_system(folder)
    found = [(f.base_name, f.size) for f in fs.get_file_info(FileSelector(inner)) if f.type == FileType.File]
    return spark.createDataFrame(found, "file string, bytes long")


def scan_token_files(folder: str, files: DataFrame, eod: int, dtype: str = "<u2", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``file``, ``ordinal``, ``start``, ``n_tokens``, ``closed`` for each document of the files.

    ``start`` is the place of the first token, ``n_tokens`` leaves the separator out. Two
    separators in a row enclose a document without tokens. Tokens after the last separator
    are a document that is not ``closed``. Empty files have no documents. Size of the files
    and block borders don't matter for the result. A file whose size isn't a multiple of the
    item width is an error.
    """
    width = np.dtype(dtype).itemsize
    if block_bytes % width:
        raise ValueError("blocks hold whole items")
    spark = files.sparkSession
    known = files.filter("bytes > 0").select("file", F.col("bytes").cast("long").alias("bytes"))
    blocks = known.select("file", "bytes", F.posexplode(F.sequence(F.lit(0).cast("long"), F.col("bytes") - 1, F.lit(block_bytes).cast("long"))).alias("block", "at"))
    schema = pa.schema([("file", pa.string()), ("block", pa.int32()), ("ends", pa.list_(pa.int64())), ("tokens", pa.int64())])

    def scan(batches):
        fs, inner = shared_file_system(folder)
        for b in batches:
            for name, size, block, at in zip(*(b.column(c).to_pylist() for c in ("file", "bytes", "block", "at"))):
                if size % width:
                    raise ValueError(f"{name}: {size} bytes aren't whole items of {width}")
                with fs.open_input_file(f"{inner}/{name}") as f:
                    items = np.frombuffer(f.read_at(min(block_bytes, size - at), at), dtype=dtype)
                ends = np.flatnonzero(items == eod) + at // width
                yield pa.RecordBatch.from_pydict({"file": [name], "block": [block], "ends": [ends], "tokens": [len(items)]}, schema=schema)

    n = max(1, min(blocks.count(), 32 * shuffle_partitions(spark)))
    found = materialize(blocks.repartition(n).mapInArrow(scan, "file string, block int, ends array<long>, tokens long"), "separators")
    order = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    summary = found.select("file", "block", F.size("ends").cast("long").alias("n"), F.try_element_at("ends", F.lit(-1)).alias("last"))
    carried = summary.select("file", "block", F.coalesce(F.sum("n").over(order), F.lit(0)).alias("ahead"), F.coalesce(F.max("last").over(order), F.lit(-1)).alias("carry"))
    documents = (
        found.select("file", "block", "ends")
        .join(carried, ["file", "block"])
        .select("file", "ahead", F.posexplode(F.zip_with(F.concat(F.array("carry"), F.slice("ends", 1, F.greatest(F.size("ends") - 1, F.lit(0)))), "ends", lambda a, e: F.when(e.isNotNull(), F.struct(a.alias("a"), e.alias("e"))))).alias("i", "x"))
        .filter("x IS NOT NULL")
        .select("file", (F.col("ahead") + F.col("i")).alias("ordinal"), (F.col("x.a") + 1).alias("start"), (F.col("x.e") - F.col("x.a") - 1).alias("n_tokens"), F.lit(True).alias("closed"))
    )
    rest = (
        found.groupBy("file")
        .agg(F.sum(F.size("ends").cast("long")).alias("n"), F.coalesce(F.max(F.try_element_at("ends", F.lit(-1))), F.lit(-1)).alias("last"), F.sum("tokens").alias("tokens"))
        .filter(F.col("tokens") > F.col("last") + 1)
        .select("file", F.col("n").alias("ordinal"), (F.col("last") + 1).alias("start"), (F.col("tokens") - F.col("last") - 1).alias("n_tokens"), F.lit(False).alias("closed"))
    )
    return documents.unionByName(rest)


def document_token_counts(docs: DataFrame, ranks_path: str, eod: int, dtype: str = "<u2", doc_id: str = "doc_id", text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``doc_id``, ``n_tokens`` for each row of ``docs``, by way of flat token files.

    A null or empty text has 0 tokens; null ids and repeated rows have a row each; an empty
    table gives an empty result; other columns aren't read.
    """
    folder, manifest = write_token_files(docs, ranks_path, eod, dtype, doc_id, text)
    files = manifest.filter("ordinal = -1").select("file", "bytes")
    counts = scan_token_files(folder, files, eod, dtype, block_bytes)
    return manifest.filter("ordinal >= 0").select("file", "ordinal", "doc_id").join(counts, ["file", "ordinal"]).select("doc_id", "n_tokens")
