import re

import corpus_pipeline as cp
from memlake.llm.simhash import simhash_groups
from tests.llm.test_pii_urls import brute
from tests.llm.test_simhash import brute as fingerprint
from tests.llm.test_simhash import groups, tokens

SF = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    docs = docs.union(spark.createDataFrame([(-1, None, "en", "src1", 0), (-2, "", "en", None, 0), (-3, "12 34", None, "src1", 5)], docs.schema))
    before = {r.doc_id: r for r in docs.collect()}
    kept = cp.staged(cp.keep_identified(spark, docs, SF), "t")
    ids = {r.doc_id for r in kept.collect()}
    assert kept.columns == list(cp.COLUMNS) and not ids & {-1, -2, -3} and len(ids) >= 0.97 * (len(before) - 3)
    one = cp.staged(cp.keep_one_of_each_group(spark, kept, SF), "t")
    want = {c for c in groups([(i, fingerprint(before[i].text)) for i in sorted(ids)]).values()}
    assert {r.doc_id for r in one.collect()} == want and one.count() == len(want)
    clean = cp.staged(cp.redact_personal_data(spark, one, SF), "t")
    for r in clean.collect():
        old = before[r.doc_id].text
        assert (r.text == old) == (not brute(old)) or re.search(r"\[(EMAIL|IP|CARD|PHONE)\]", r.text)
        assert not brute(r.text) and r.n_chars == len(r.text)
    mixed = cp.staged(cp.mix_sources(spark, clean, SF), "t")
    words = {r.doc_id: len(tokens(r.text)) for r in clean.collect()}
    rows = mixed.collect()
    assert {r.doc_id for r in rows} <= set(words) and abs(sum(words[r.doc_id] for r in rows) - sum(words.values())) <= 0.002 * sum(words.values())
    packed = cp.pack_sequences(spark, mixed, SF).collect()
    assert len({(r.sequence_id, r.offset) for r in packed}) == len(packed) >= len(rows)


def test_run_and_empty(spark):
    got = cp.run(spark, SF)
    assert {"doc_id", "piece", "sequence_id", "offset"} <= set(got.columns) and got.count() > 0
    empty = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in cp.STAGES:
        out = stage(spark, empty, SF)
        assert out.count() == 0
