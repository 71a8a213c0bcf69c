from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.test_operators import alike, brute_components, brute_overlap, brute_repeats, brute_shingles, odd_frame


def test_stages(spark, tmp_path):
    sf_dir = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, seen = docs.columns, [docs.collect()]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        assert k == len(corpus_pipeline.STAGES) - 1 or docs.columns == columns
        seen.append(docs.collect())
    ids = [{r.doc_id for r in rows} for rows in seen]
    assert len(ids[1]) < len(ids[0])
    sets = {r.doc_id: brute_shingles(r.text, 5) for r in seen[1]}
    roots = brute_components(sets, lambda a, b: alike(sets[a], sets[b]))
    assert ids[2] == set(roots.values())
    cut = brute_repeats([(r.doc_id, r.text) for r in seen[2]], 50)
    text = {r.doc_id: r.text for r in seen[3]}
    for r in seen[2]:
        gone = cut.get(r.doc_id, (set(), set()))[1]
        words = r.text.encode().split()
        left = [w for i, w in enumerate(words) if i not in gone]
        assert text.get(r.doc_id, "").encode().split() == left and (r.doc_id in text) == bool(left or not words)
    items = [r.text for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    for i in sorted(ids[3])[:40]:
        assert (i in ids[4]) != any(brute_overlap(text[i], t) for t in items)
    assert ids[5] == ids[4] and len(seen[5]) == len(seen[4])


def test_run(spark, sf_dir):
    out = corpus_pipeline.run(spark, sf_dir)
    assert {"doc_id", "n_tokens", "ids_sha256"} <= set(out.columns) and out.count() > 0


def test_odd_rows(spark, sf_dir):
    docs = odd_frame(spark)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, sf_dir).columns == docs.columns
        assert stage(spark, docs.limit(0), sf_dir).count() == 0
    assert corpus_pipeline.tokens(spark, docs.withColumn("extra", F.lit(1)), sf_dir).count() == docs.count()
