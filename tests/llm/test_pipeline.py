from __future__ import annotations

from collections import Counter

import corpus_pipeline
from foliospark.llm import registry


def test_stages(spark, rows, docs, tmp_path):
    frame, counts = docs, []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = frame
        frame = stage(spark, frame, "unused")
        assert frame.columns == docs.columns and frame.schema.simpleString() == docs.schema.simpleString(), name
        path = str(tmp_path / name)
        frame.write.parquet(path)
        frame = spark.read.parquet(path)
        counts.append((name, before.count(), frame.count()))
    by = {name: (a, b) for name, a, b in counts}
    letters = [t for _, t, *_ in rows if t and any(c.isalpha() for c in t)]
    assert by["language_id"][1] == len(letters)
    assert by["exact_dedup"][1] == len({"".join(c.lower() if "A" <= c <= "Z" else c for c in t) for t in letters})
    assert by["near_dedup"][1] < by["near_dedup"][0]
    assert by["substring_dedup"][0] == by["substring_dedup"][1]
    assert frame.filter("length(text) <> n_chars").count() == 0
    packed = corpus_pipeline.STAGES[-1][1](spark, frame, "unused").collect()
    assert {r.doc_id for r in packed} == {r.doc_id for r in frame.collect()}


def test_run_and_names(spark, docs, tmp_path):
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.count() > 0 and {"doc_id", "sequence_id", "offset", "length"} <= set(out.columns)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "exact_dedup", "near_dedup", "substring_dedup", "packing"]
    names = Counter(q.split("_")[0] for q in registry.queries())
    assert names == Counter(f"op{n}" for n in range(1, 11))


def test_empty_and_odd_tables(spark, odd, empty, tmp_path):
    for k, table in enumerate((empty, odd)):
        frame = table
        for name, stage in corpus_pipeline.STAGES[:-1]:
            path = str(tmp_path / f"{k}-{name}")
            stage(spark, frame, "unused").write.parquet(path)
            frame = spark.read.parquet(path)
            assert frame.columns == table.columns
        assert corpus_pipeline.STAGES[-1][1](spark, frame, "unused").count() == (0 if table is empty else 2)  # doc_id 1 and 3; a copy without doc_id and the letterless rows go
