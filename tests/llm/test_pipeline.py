"""The pipeline and the registered queries on the smallest tables."""

import corpus_pipeline
import pytest
from inodeatlas.llm.common import stored, table
from inodeatlas.llm.queries import REGISTRY
from test_operators import jaccard_classes, repeated, words

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = table(spark, SF, "documents")
    columns, rows, kept = docs.columns, {}, {}
    for name, stage in corpus_pipeline.STAGES:
        rows[name] = [tuple(r) for r in docs.collect()]
        docs = stored(stage(spark, docs, SF), "stage")
        kept[name] = docs.collect()
        if name != "packing":
            assert docs.columns == columns
    assert len(kept["language"]) == len(rows["language"])  # all of these are in learnt languages
    assert all(len(words(r.text)) >= 50 for r in kept["quality"])
    assert {r.doc_id for r in kept["near copies"]} == set(jaccard_classes(rows["near copies"]))
    _, later = repeated(rows["repeats"])
    texts = {r[0]: r[1] for r in rows["repeats"]}
    for r in kept["repeats"]:
        assert words(r.text) == [w for k, w in enumerate(words(texts[r.doc_id])) if k not in later.get(r.doc_id, ())]
        assert r.n_chars == len(r.text)
    assert {r.doc_id for r in kept["packing"]} == {r.doc_id for r in kept["repeats"]}


@pytest.mark.parametrize("name", sorted(REGISTRY))
def test_query(spark, name):
    fn, _ = REGISTRY[name]
    first = [tuple(r) for r in fn(spark, SF).collect()]
    assert first and len(first) == len(set(first))
