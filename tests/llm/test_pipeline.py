"""The pipeline: its stages by the operators' own results, each on what the stage before kept."""

from __future__ import annotations

from collections import Counter

import corpus_pipeline
from tests.llm.conftest import SF
from tidewatch.llm import decontaminate, jaccard_join, toxicity


def without_passages(texts, window, words):
    """Every window of bytes counted; runs of repeated ones that have enough words go."""
    texts = {d: t.encode() for d, t in texts.items()}
    count = Counter(t[i : i + window] for t in texts.values() for i in range(len(t) - window + 1))
    out = {}
    for d, t in texts.items():
        runs = []
        for i in range(len(t) - window + 1):
            if count[t[i : i + window]] > 1:
                if runs and i <= runs[-1][1]:
                    runs[-1][1] = i + window
                else:
                    runs.append([i, i + window])
        kept, at = b"", 0
        for a, b in runs:
            if len(t[a:b].split()) >= words:
                kept, at = kept + t[at:a], b
        out[d] = (kept + t[at:]).decode("utf-8", "ignore")
    return out


def test_stages(spark, tmp_path):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "jaccard_join", "suffix_dedup", "decontamination", "sentencepiece"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, tables = docs.dtypes, [docs]
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, tables[-1], SF)
        out.write.parquet(f"{tmp_path}/{name}")
        tables.append(spark.read.parquet(f"{tmp_path}/{name}"))
        assert name == names[-1] or tables[-1].dtypes == columns
    first, clean, single, cut, kept, last = tables
    ids = lambda t: {r["doc_id"] for r in t.select("doc_id").collect()}
    model = toxicity.fit(first, spark.read.parquet(f"{SF}/labels.parquet"))
    assert ids(clean) == {r["doc_id"] for r in toxicity.score(first, model).collect() if r["score"] < 0.5}
    assert ids(single) == {r["doc_id"] for r in jaccard_join.join(clean).collect() if r["doc_id"] == r["component_id"]}
    before, after = ({r["doc_id"]: r["text"] for r in t.collect()} for t in (single, cut))
    assert after == without_passages(before, corpus_pipeline.PASSAGE_BYTES, corpus_pipeline.PASSAGE_WORDS)
    found = decontaminate.scan(cut, spark.read.parquet(f"{SF}/benchmark.parquet"))
    assert ids(kept) == {r["doc_id"] for r in found.collect() if not r["contaminated"]}
    assert ids(last) == ids(kept)
    assert {tuple(r) for r in corpus_pipeline.run(spark, SF).collect()} == {tuple(r) for r in last.collect()}
