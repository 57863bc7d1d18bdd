"""The pipeline's stages over a small table."""

import corpus_pipeline
from .test_operators import labelled


def test_stages_keep_the_columns_and_take_effect(spark, tmp_path):
    docs, labels = labelled(spark, 300)
    docs = docs.selectExpr("doc_id", "text", "'en' AS lang", "concat('src', doc_id % 3) AS source", "length(text) AS n_chars")
    mail = spark.createDataFrame([(1000 + i, f"write to person{i}@example.org about number {i} of the morning river", "en", "src9", 0) for i in range(30)], docs.schema)
    docs.union(mail).write.parquet(str(tmp_path / "documents.parquet"))
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    now = spark.read.parquet(str(tmp_path / "documents.parquet"))
    columns, counts = now.columns, [now.count()]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, now, str(tmp_path)).write.parquet(str(tmp_path / name))
        now = spark.read.parquet(str(tmp_path / name))
        counts.append(now.count())
        if name != "pack":
            assert now.columns == columns
        if name == "quality":
            assert not any((r.text or "").endswith("!!") for r in now.collect())
        if name == "near_duplicates":
            ids = [r.doc_id for r in now.collect() if r.doc_id is not None]
            assert len(ids) == len(set(ids))
        if name == "personal_data":
            assert not any("@example.org" in (r.text or "") for r in now.collect())
    assert counts[1] < counts[0]
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == counts[-1]
