import hashlib
import random

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tidemark.llm import bpe

PATH = public_tokenizers.path("word_bpe_49k.json")
REF = Tokenizer.from_file(PATH)
ENC = bpe.Encoder(bpe.Vocabulary(open(PATH, encoding="utf-8").read()), remembered=500)


def ours(text):
    ids, toks = [], []
    for _, a, b, _ in ENC.encode([text]):
        if a:
            ids.append(a)
            toks.append(b)
    return " ".join(ids), " ".join(toks)


def theirs(text):
    ids = REF.encode(text, add_special_tokens=False).ids
    return " ".join(map(str, ids)), REF.decode(ids, skip_special_tokens=False)


CASES = ["", " ", "Hello,  wörld! it's 123 don't", "aaaaaaaaaaaaaaaaaaaaaaaaaaa", "<|endoftext|>x<|startoftext|> <|endoftext", "ΑΣ ΣΑΣ σς", "İstanbul ẞ ǅ", "é é ẛ̣", "a\x1cb\x85c　d​e", "'S 'LL 're''s", "你好，世界 ١٢٣ ½ Ⅷ", "😀😀 👩‍👩‍👧", "\u0000\u0001", "ﬁ ﬀ", ":\U00018d80", "a\u1c89b \U0001fae9 x"]


@pytest.mark.parametrize("text", CASES)
def test_cases(text):
    assert ours(text) == theirs(text)


@settings(max_examples=400, deadline=None)
@given(st.one_of(st.text(max_size=60), st.text(alphabet="aeinorst' ", max_size=80), st.text(alphabet="<|endofxstar>! ", max_size=60)))
def test_any_text(text):
    text = text.encode("utf-8", "ignore").decode()
    assert ours(text) == theirs(text)


def test_every_character():
    import unicodedata

    old = unicodedata.ucd_3_2_0
    known = [chr(c) for c in range(0x20000) if not 0xD800 <= c < 0xE000 and old.category(chr(c)) != "Cn"]
    texts = [" ".join(f"a{c}1 {c}:{c}e" for c in known[i : i + 64]) for i in range(0, len(known), 64)]
    bad = [t for t in texts if ours(t) != theirs(t)]
    singles = [c for t in bad for c in {w[1] for w in t.split(" ")[::2] if len(w) > 1} if ours(f"a{c}1 {c}:{c}e") != theirs(f"a{c}1 {c}:{c}e")]
    assert not bad, (len(bad), [hex(ord(c)) for c in singles][:50])


def test_real_words_and_pieces(monkeypatch):
    rng = random.Random(2)
    tokens = [t.replace("</w>", "") for t in REF.get_vocab() if t.isascii()]
    text = " ".join("".join(rng.choice(tokens) for _ in range(rng.randint(1, 4))) for _ in range(20000))
    want = theirs(text)
    assert ours(text) == want
    monkeypatch.setattr(bpe.pieces, "__defaults__", (5000,))
    assert ours(text) == want


def test_operator(spark):
    rows = [(1, "Hello there", "x"), (2, None, "y"), (None, "a b", "z"), (4, "", None), (1, "Hello there", "x"), (5, "long words " * 50000, "n")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    out = ("n_tokens", "ids", "decoded", "ids_sha256", "decoded_sha256")
    got = bpe.encode_documents(df, PATH, outputs=out).collect()
    assert len(got) == len(rows)
    by = {(r.doc_id): r for r in got}
    for i, t, _ in rows:
        ids = REF.encode(t or "", add_special_tokens=False).ids
        dec = REF.decode(ids, skip_special_tokens=False)
        r = by[i]
        assert (r.n_tokens, r.ids, r.decoded) == (len(ids), ids, dec)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(dec.encode()).hexdigest()
    assert bpe.encode_documents(df.limit(0), PATH).count() == 0
