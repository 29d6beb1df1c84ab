import hashlib
import re

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tidemark.llm import mixing, pii, quality
from tidemark.llm.common import materialize

pipeline = pytest.importorskip("corpus_pipeline")
SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def outputs(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    out = [docs.toPandas()]
    for _, f in pipeline.STAGES:
        docs = materialize(f(spark, docs, SMALL), "t")
        out.append(docs.toPandas())
    return out


def test_columns(outputs):
    assert len(pipeline.STAGES) == 5
    assert all(list(o.columns) == pipeline.COLUMNS for o in outputs[:-1])


def test_quality(spark, outputs):
    docs, kept = outputs[:2]
    labels = spark.read.parquet(f"{SMALL}/labels.parquet").toPandas()
    from test_quality import brute_scores

    known = docs[docs.text.str.len() < 3000]
    taught = labels[labels.doc_id.isin(known.doc_id)]
    some = spark.createDataFrame(known)
    got = quality.keep_good(some, spark.createDataFrame(taught)).toPandas()
    scores = brute_scores(list(zip(known.doc_id, known.text)), dict(zip(taught.doc_id, taught.quality)))
    sure = {i for i, x in scores.items() if abs(x - quality.CUT) > 1e-3}
    assert set(got.doc_id) & sure == {i for i in sure if scores[i] >= quality.CUT} and len(sure) > 100
    # the stage: all rows that the same ranking, fitted on all of them, doesn't reject
    scored = quality.quality_scores(spark.createDataFrame(docs), spark.createDataFrame(labels)).toPandas()
    assert set(kept.doc_id) == set(scored.doc_id[scored.predicted == 1])


def test_near_duplicates(outputs):
    from test_simhash import brute_components

    before, after = outputs[1:3]
    want = {i for i, _, c in brute_components(list(zip(before.doc_id, before.text))) if i == c}
    assert set(after.doc_id) == want


def test_pii(spark, outputs):
    before, after = outputs[2:4]
    make, was = pii.Surrogates(pii.session_key(spark)), dict(zip(before.doc_id, before.text))
    assert len(before) == len(after)
    for r in after.itertuples():
        assert r.text == pii.replace(make, was[r.doc_id])[0] and r.n_chars == len(r.text)
    leaks = re.compile(r"\S+@mail\d\.example\.com|\+1 \(\d{3}\) 555-\d{4}")
    assert not any(leaks.search(t) and leaks.search(t)[0] in was[i] for i, t in zip(after.doc_id, after.text))


def test_mixing_keeps_all_rows(outputs):
    before, after = outputs[3:5]
    key = lambda o: o.sort_values("doc_id").reset_index(drop=True)
    assert key(before).equals(key(after))


def test_prefixes_of_the_result_meet_the_weights(spark, outputs):
    docs, last = outputs[4], outputs[5]
    assert sorted(last.mix_position) == list(range(len(docs)))
    order = docs.set_index("doc_id").source[last.sort_values("mix_position").doc_id].reset_index(drop=True)
    n = docs.source.value_counts()
    a = (1000 * n**0.5 / (n**0.5).sum()).round()
    first = len(docs)  # until a source runs out
    for s in n.index:
        first = min(first, order[order == s].index.max() + 1)
    met = 0
    for t in range(1, first + 1):
        have = order[:t].value_counts().reindex(n.index, fill_value=0)
        assert ((have - t * a / a.sum()).abs() <= 2 * mixing.BLOCK).all()
        met += 1
    assert met
    want = mixing.mix(spark.createDataFrame(docs[["doc_id", "source"]])).toPandas().set_index("doc_id").mix_position
    assert all(want[r.doc_id] == r.mix_position for r in last.itertuples())


def test_encoding_follows_the_mixing_stage(spark, outputs, monkeypatch):
    docs = spark.createDataFrame(outputs[3])
    order = mixing.mixed_order  # weights other than those of the stage
    monkeypatch.setattr(mixing, "mixed_order", lambda d: order(d, {sorted(outputs[3].source)[0]: 40}))
    written = materialize(pipeline.mix_sources(spark, docs, SMALL), "other")
    last = pipeline.encode(spark, written, SMALL).toPandas()
    want = mixing.mix(docs, {sorted(outputs[3].source)[0]: 40}).toPandas()
    assert dict(zip(last.doc_id, last.mix_position)) == dict(zip(want.doc_id, want.mix_position))
    assert dict(zip(last.doc_id, last.mix_position)) != dict(zip(outputs[5].doc_id, outputs[5].mix_position))


def test_encoding(spark, outputs):
    docs, last = outputs[4:]
    ref = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    got = last.set_index("doc_id")
    assert len(last) == len(docs)
    for r in docs.itertuples():
        ids = ref.encode(r.text, add_special_tokens=False).ids
        x = got.loc[r.doc_id]
        assert list(x.ids) == ids and x.n_tokens == len(ids)
        assert x.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert x.decoded_sha256 == hashlib.sha256(ref.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    whole = pipeline.run(spark, SMALL).toPandas()
    assert dict(zip(whole.doc_id, whole.ids_sha256)) == dict(zip(last.doc_id, last.ids_sha256))


def test_odd_rows(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long, score double, fp string, row int"
    rows = [(1, None, None, None, None, 1.0, "a", 1), (2, "", "en", "a", 0, 1.0, "b", 2), (None, "no id a@b.org", "en", "b", 3, 1.0, "c", 3), (4, "long words " * 80000, "en", None, 9, None, None, None), (5, "one two three four", "en", "a", 4, 1.0, "d", 5), (5, "one two three four", "en", "a", 4, 1.0, "d", 5)]
    for data in (rows, []):
        docs = spark.createDataFrame(data, schema)
        for i, (_, stage) in enumerate(pipeline.STAGES):
            docs = materialize(stage(spark, docs, SMALL), "odd")
            if i < 4:
                assert docs.columns == pipeline.COLUMNS
        assert docs.count() <= len(data)
