import base64
import random

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken

from tidemark.llm import tokencount as tc

RANKS = P.path("byte_bpe_multi_50k.tiktoken")
EOD = 50256


def split(items, eod):
    out, at = [], 0
    for i, x in enumerate(items):
        if x == eod:
            out.append((at, i - at, True))
            at = i + 1
    if at < len(items):
        out.append((at, len(items) - at, False))
    return out


@pytest.mark.parametrize("dtype", ["<u2", "<u4"])
@pytest.mark.parametrize("block", [4, 8, 64, 1 << 20])
def test_scan(spark, tmp_path, dtype, block):
    rng = random.Random(block)
    files = {"empty": [], "none": [1, 2, 3], "only": [9, 9, 9], "one": [9], "ends": [1, 9], "head": [9, 1, 1, 1, 1, 1, 1, 1, 1, 1]}
    files["mixed"] = [9 if rng.random() < 0.2 else rng.randrange(9) for _ in range(500)]
    files["long"] = [1] * 300 + [9] + [2] * 77
    for n, x in files.items():
        (tmp_path / n).write_bytes(np.array(x, dtype=dtype).tobytes())
    folder = f"file://{tmp_path}"
    got = tc.scan_token_files(folder, tc.list_token_files(spark, folder), 9, dtype, block).collect()
    want = {(n, i, *d) for n, x in files.items() for i, d in enumerate(split(x, 9))}
    assert {tuple(r) for r in got} == want and len(got) == len(want)


def test_broken_file(spark, tmp_path):
    (tmp_path / "x").write_bytes(b"abc")
    folder = f"file://{tmp_path}"
    with pytest.raises(Exception, match="whole items"):
        tc.scan_token_files(folder, tc.list_token_files(spark, folder), 9).collect()


def test_documents(spark, monkeypatch):
    enc = tiktoken.Encoding("t", pat_str=P.PATTERN, mergeable_ranks={base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}, special_tokens={})
    rows = [(i, f"text number {i} " * (i % 40)) for i in range(200)] + [(900, None), (None, "a b c"), (901, ""), (7, "twice"), (7, "twice"), (902, "long words " * 150000)]
    df = spark.createDataFrame([(*r, "f", 3) for r in rows], "doc_id long, text string, file string, ordinal int")
    got = sorted(((r.doc_id, r.n_tokens) for r in tc.document_token_counts(df, RANKS, EOD, block_bytes=64).collect()), key=str)
    assert got == sorted(((i, len(enc.encode_ordinary(t or ""))) for i, t in rows), key=str)
    assert tc.document_token_counts(df.limit(0), RANKS, EOD).count() == 0


@pytest.mark.parametrize("text", ["one two  three   four \n five\t six", "  lead and trail  ", "a" * 50 + "  " + "b" * 50, " " * 40, "x  " * 30])
def test_pieces_meet_where_no_token_goes_on(monkeypatch, text):
    with open(P.path("byte_bpe_multi_50k.tiktoken"), encoding="ascii") as f:
        encoding = tc._encoding(f.read())
    whole = encoding.encode_ordinary(text * 5)
    for piece in range(1, 12):
        monkeypatch.setattr(tc, "PIECE", piece)
        assert tc._token_ids(encoding, text * 5).tolist() == whole
