"""The pipeline's stages on a given table, each against plain Python on its own input."""

from __future__ import annotations

import helpers as H

import corpus_pipeline


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r.text for r in docs.collect()}
        docs = corpus_pipeline.stored(stage(spark, docs, sf_dir), name)
        seen[name] = before, docs.collect()
        if name != "bpe_encoding":
            assert docs.columns == columns
    before, after = seen["quality_classifier"]
    assert 0 < len(after) <= len(before)
    before, after = seen["line_dedup"]
    assert len(after) == len(before) and all(set((r.text or "").split("\n")) <= {"", *(before[r.doc_id] or "").split("\n")} and r.n_chars == len(r.text) for r in after)
    before, after = seen["ngram_jaccard_join"]
    parts = {}
    for d, _, c in H.components(list(before.items())):
        parts.setdefault(c, []).append(int(d))
    blank = {d for d, t in before.items() if not H.shingles(t)}
    want = {min(ds) for ds in parts.values()} | blank
    assert {r.doc_id for r in after} == want
    before, after = seen["benchmark_decontamination"]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    assert {r.doc_id for r in after} == {int(d) for d, _, n, _ in H.hits(list(before.items()), items) if not n}
    before, after = seen["bpe_encoding"]
    assert {r.doc_id for r in after} == set(before) and all(len(r.ids) == 4 * r.n_tokens for r in after)


def test_awkward_rows_through_all_stages(spark, sf_dir):
    docs = H.awkward(spark).select("doc_id", "text", "lang", "source", "n_chars")
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.stored(stage(spark, docs, sf_dir), name)
    rows = docs.collect()
    assert {r.doc_id for r in rows} <= {d for d, _ in H.ROWS} and all(len(r.ids) == 4 * r.n_tokens for r in rows)
