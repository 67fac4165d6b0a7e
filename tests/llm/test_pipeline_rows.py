import corpus_pipeline as cp
from memlake.llm.langid import identify

SF = "/root/testdata/sf0.001"


def test_rows_without_doc_id_go_through_every_stage(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    first = docs.orderBy("doc_id").first()
    odd = [" ".join(f"{w}{k}" for w in first.text.split()[:60]) for k in "abc"]
    rows = [(None, odd[0], "en", "src1", 9), (None, odd[1], "en", "src2", 9), (None, odd[1], "en", "src2", 9), (None, odd[2], "en", "src1", 9), (7_000_000, odd[2], "en", "src1", 9), (None, "12 34", "en", "src1", 5), (None, None, "en", "src1", 0)]
    docs = docs.union(spark.createDataFrame(rows, docs.schema))
    kept = cp.staged(cp.keep_identified(spark, docs, SF), "t")
    bare = lambda df: sorted(r.text for r in df.where("doc_id is null").collect())
    assert bare(kept) == sorted([odd[0], odd[1], odd[1], odd[2]])  # neither without letters nor null
    one = cp.staged(cp.keep_one_of_each_group(spark, kept, SF), "t")
    assert bare(one) == sorted(odd[:2]) and one.where("doc_id = 7000000").count() == 1
    same = one.union(one.where("doc_id is null"))
    words = {t: len(t.split()) for t in odd}
    mixed = cp.staged(cp.mix_sources(spark, same, SF), "t")
    want = cp.mix(same).where("doc_id is null").groupBy("source").sum("copies").collect()
    assert len(want) == 2 and len(bare(mixed)) == sum(r["sum(copies)"] for r in want) > 0 and set(bare(mixed)) <= set(words)
    packed = cp.pack_sequences(spark, mixed, SF)
    assert packed.where("doc_id is null").count() == len(bare(mixed))


def test_documents_of_close_languages_are_kept(spark):
    rows = [(i, f"na to je {'ab'[i % 2]}", f"x{i % 6}", "s", 9) for i in range(240)] + [(240, "12", "x1", "s", 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    best = {r.doc_id: r.score for r in identify(docs).collect()}
    assert max(best.values()) < 0.6 and sum(x < 0.4 for x in best.values()) > 100
    assert {r.doc_id for r in cp.keep_identified(spark, docs, SF).collect()} == set(range(240))
