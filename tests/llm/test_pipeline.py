"""The pipeline's stages, each held against what it was given."""

import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))
sys.path.insert(0, str(Path(__file__).parent))
import corpus_pipeline as pipeline
from test_operators import components, personal, verdicts

from tilewright.llm import mixing
from tilewright.llm.common import durable


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    seen = [docs]
    for name, stage in pipeline.STAGES:
        seen.append(durable(stage(spark, seen[-1], sf), "stage"))
    for table in seen[1:-1]:
        assert table.columns == docs.columns
    given, clean, single, private, mixed, packed = [t.collect() for t in seen]
    kept, _ = verdicts([(r.source, r.text) for r in given])
    assert {r.doc_id for r in clean} == {r.doc_id for r, k in zip(given, kept, strict=True) if k}
    want = components([(r.doc_id, r.text) for r in clean], 80)
    assert {r.doc_id for r in single} == {d for d, (c, _) in want.items() if d == c}
    assert len(private) == len(single)
    texts = {r.doc_id: r.text for r in single}
    for r in private:
        if sum(personal(texts[r.doc_id])[:4]) == 0 and "[" not in r.text:
            assert r.text == texts[r.doc_id]
        assert sum(personal(r.text)[:4]) == 0 and r.n_chars == len(r.text)
    chosen = {r.doc_id for r in mixing.mixed(mixing.measured(seen[3])).where("sampled").collect()}
    assert {r.doc_id for r in mixed} == chosen
    assert {r.doc_id for r in packed} == chosen
    assert pipeline.run(spark, sf).count() == len(packed)
