from collections import Counter
from pathlib import Path

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from ledgerloom.llm import mixing, toxicity
from tests.llm.test_exact_and_mixing import brute as brute_copies
from tests.llm.test_similarity import brute_components

DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not Path(DATA).exists(), reason="no test tables here")
def test_stages_against_brute_force(spark, tmp_path):
    tokenizers = pytest.importorskip("tokenizers")
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    schema, read = docs.schema, docs
    outs = {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, read, DATA).write.parquet(str(tmp_path / name))
        read = spark.read.parquet(str(tmp_path / name))
        outs[name] = read.collect()
        if name != "BPE":
            assert read.schema.names == schema.names
    model = toxicity.train(docs, spark.read.parquet(f"{DATA}/labels.parquet"))
    rows = docs.collect()
    kept = [r for r in rows if toxicity.scorer(model).scores([r.text or ""])[0] < 0.3]
    assert Counter(kept) == Counter(outs["toxicity"])
    stay = {i for i, _, _, keep, _ in brute_copies([(r.doc_id, r.text, r.source) for r in kept]) if keep}
    kept = [r for r in kept if r.doc_id in stay]
    assert Counter(kept) == Counter(outs["exact dedup"])
    part = {i: c for i, _, c in brute_components([(r.doc_id, r.text) for r in kept])}
    kept = [r for r in kept if part[r.doc_id] == r.doc_id]
    assert Counter(kept) == Counter(outs["n-gram Jaccard join"])
    times = {r.doc_id: round(r.taken / r.size) for r in mixing.mix(spark.createDataFrame(kept, schema)).collect() if r.size}
    want = Counter({r: times.get(r.doc_id, 0) for r in kept if times.get(r.doc_id, 0)})
    assert want == Counter(outs["mixing"])
    from ledgerloom.llm.queries import tokenizer

    lib = tokenizers.Tokenizer.from_file(tokenizer("byte_bpe_50k.json"))
    text = {r.doc_id: r.text for r in kept}
    assert len(outs["BPE"]) == sum(want.values())
    for r in outs["BPE"]:
        assert list(r.ids) == lib.encode(text[r.doc_id], add_special_tokens=False).ids and r.round_trip


CLASHES = ("__id", "__row", "__n", "__digest", "digest", "place", "row", "of", "sha", "each", "epoch", "__times", "size", "key")


def test_stages_on_odd_rows(spark):
    """Null ids and texts, repeated rows, shared ids, a very long text and columns of clashing names; and empty tables."""
    rows = [(1, "one two three four five six", "en", "a"), (1, "one two three four five six", "en", "a"), (1, "another text under the same id", "en", "b"), (2, None, "en", "a"), (None, "no id at all here now", None, None),
            (3, "", "en", "b"), (4, "word " * 200_000, "en", "a"), (5, "one  two three four five six", "en", "c"), (None, "no id at all here now", None, None)]
    docs = spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars long").withColumns({c: F.lit("q") for c in CLASHES})
    out = {}
    for name, stage in corpus_pipeline.STAGES[1:]:
        got = stage(spark, docs, DATA)
        out[name] = got.collect()
        assert got.columns == docs.columns or name == "BPE"
        assert stage(spark, docs.limit(0), DATA).count() == 0
    ids = lambda name: Counter((r.doc_id, len((r.text or "").split())) for r in out[name])
    assert ids("exact dedup") == Counter({(1, 6): 0, (5, 6): 1, (2, 0): 1, (None, 6): 1, (1, 6): 1, (4, 200_000): 1})
    assert ids("n-gram Jaccard join") == Counter((r[0], len((r[1] or "").split())) for r in rows if r[0] != 5)
    assert ids("mixing")[None, 6] == 6 and (2, 0) not in ids("mixing")
    assert len(out["BPE"]) == len(rows) and all(r.round_trip for r in out["BPE"])


@pytest.mark.skipif(not Path(DATA).exists(), reason="no test tables here")
@pytest.mark.parametrize("name", ["op2_toxicity", "op3_ngram_jaccard", "op5_substring_dedup", "op8_bpe", "op9_token_binary"])
def test_queries_give_a_row_a_document(spark, name):
    """The registered queries over a whole table: one row for each document, ids as they are there."""
    from ledgerloom.llm import queries

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    got = queries.QUERIES[name](spark, DATA).select("doc_id").collect()
    assert sorted(r[0] for r in got) == sorted(r[0] for r in docs.select("doc_id").collect())


@pytest.mark.skipif(not Path(DATA).exists(), reason="no test tables here")
def test_run(spark):
    assert corpus_pipeline.run(spark, DATA).count() > 0
