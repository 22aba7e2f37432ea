import corpus_pipeline
from verbatlas.llm import common, jaccard_join, line_dedup, mixing, sentencepiece_bpe, toxicity

DIR = "/root/testdata/sf0.001"


def test_stages_and_their_rows(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "jaccard_join", "mixing", "encoding"]
    docs = common.read(spark, DIR, "documents")
    columns, before = docs.columns, docs
    for name, stage in corpus_pipeline.STAGES:
        after = common.stored(stage(spark, before, DIR), "test")
        left = {r.doc_id: r for r in after.collect()}
        had = {r.doc_id: r for r in before.collect()}
        assert set(left) <= set(had) and left
        if name == "toxicity":
            model = toxicity.learn(before, common.read(spark, DIR, "labels"), held_out=False)
            want = {r.doc_id for r in toxicity.scored(before, model).where("predicted = 0").collect()}
            assert set(left) == want and all(left[i] == had[i] for i in left)
        if name == "line_dedup":
            kept = {r.doc_id: r.kept for r in line_dedup.dedup_lines(before).collect()}
            assert all(left[i].text == kept[i] and left[i].n_chars == len(kept[i]) for i in left)
            assert all(not kept[i].strip() for i in set(had) - set(left))
        if name == "jaccard_join":
            classes = {r.doc_id: r.class_id for r in jaccard_join.jaccard_links(before).collect()}
            assert set(left) == {i for i, c in classes.items() if i == c}
        if name == "mixing":
            assert set(left) == {r.doc_id for r in mixing.mixed(before).where("kept").collect()}
        if name == "encoding":
            v = sentencepiece_bpe.vocabulary(sentencepiece_bpe.model_path())
            assert set(left) == set(had) and all(v.decode(__import__("numpy").array(r.ids)) == had[i].text for i, r in left.items())
        else:
            assert after.columns == columns
        before = after


def test_odd_tables(spark, odd, none, tmp_path):
    spark.createDataFrame([(k, 1, k % 2) for k in range(10)], "doc_id bigint, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    for docs in (odd, none):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, str(tmp_path))
            assert out.columns == docs.columns
            assert out.count() <= docs.count()
