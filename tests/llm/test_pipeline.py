import corpus_pipeline
from tabsight.llm.mixing import mix_plan
from tabsight.llm.simhash_trie import simhash_components
from tabsight.session import read_table

SF = "/root/testdata/sf0.001"


def test_stages_follow_one_another(spark, tmp_path):
    docs = read_table(spark, SF, "documents")
    columns, seen = docs.columns, []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        out.write.parquet(f"{tmp_path}/{k}")
        done = spark.read.parquet(f"{tmp_path}/{k}")
        seen.append((name, docs, done))
        if k + 1 < len(corpus_pipeline.STAGES):
            assert done.columns == columns
        docs = done
    (_, whole, good), (_, _, lines), (_, _, near), (_, _, mixed), (_, _, tokens) = seen
    labels = {r.doc_id: r.quality for r in read_table(spark, SF, "labels").collect()}
    kept = {r.doc_id for r in good.collect()}
    clean = [i for i, q in labels.items() if q == 1]
    assert sum(i in kept for i in clean) >= 0.95 * len(clean)
    assert lines.count() == good.count()
    components = {r.doc_id: r.component_id for r in simhash_components(lines).collect()}
    assert {r.doc_id for r in near.collect()} == set(components.values())
    copies = {r.doc_id: r.copies for r in mix_plan(near).collect()}
    assert mixed.count() == sum(copies.values()) == tokens.count()
    assert whole.count() == 200


def test_run_equals_the_stages_with_their_rows_written(spark):
    assert corpus_pipeline.run(spark, SF).count() > 0
