"""The corpus pipeline on an awkward table: each stage, written and read again, and the run as a whole."""

from __future__ import annotations

import corpus_pipeline

PASSAGE = " ".join(f"pass{i}" for i in range(60))
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size int, extra array<int>"


def _rows():
    plain = [(i, " ".join(f"word{(i * 131 + k * 17) % 997}" for k in range(40)) + f"\nfoot\n{i} end", "en", f"s{i % 12}", 10, 1, [i]) for i in range(60)]
    odd = [(100, None, None, None, None, 1, None), (101, "", "en", None, 0, 1, []), (102, "too few words", "fr", "s1", 13, 1, [1]), (103, PASSAGE, None, None, 5, 2, None), (104, PASSAGE + " more", None, "s2", 5, 2, None), (104, PASSAGE + " more", None, "s2", 5, 2, None)]
    return plain + odd


def test_stages_and_run(spark, tmp_path):
    spark.createDataFrame(_rows(), SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, 1, 0), (None, None, 0), (999, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    columns, ids = docs.columns, []
    for at, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        stage(spark, docs, str(tmp_path)).write.parquet(str(tmp_path / f"{at}-{name}"))
        docs = spark.read.parquet(str(tmp_path / f"{at}-{name}"))
        assert docs.columns == columns
        ids.append({r["doc_id"] for r in docs.select("doc_id").collect()})
    assert ids[0] == set(range(60)) | {103, 104}
    assert ids[1] == ids[0] and ids[2] == ids[0] - {104}
    assert docs.where("text like '%foot%'").select("doc_id").distinct().count() <= 1  # the line on twelve sources stays once
    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert rows and all(r["offset"] + r["length"] <= 2048 for r in rows)


def test_empty_tables(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
