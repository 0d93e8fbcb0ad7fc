"""The pipeline's stages on the small tables: columns, decisions, order."""

import os
from collections import Counter

import pytest

import corpus_pipeline as p
from tablewright.llm import curriculum_mix, exact_merge, quality_classifier
from tablewright.llm.common import write_table
from test_overlap import brute_kept

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables not present")


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, tables = docs.columns, [docs]
    for name, stage in p.STAGES[:-1]:
        tables.append(write_table(stage(spark, tables[-1], SF)))
        assert tables[-1].columns == columns, name
    good, once, far, mixed = [t.collect() for t in tables[1:]]
    predicted = quality_classifier.classify(docs, spark.read.parquet(f"{SF}/labels.parquet")).where("predicted = 1")
    assert {r.doc_id for r in good} == {r.doc_id for r in predicted.collect()}
    assert Counter(r.doc_id for r in once) == Counter(r.doc_id for r in exact_merge.exact_groups(tables[1]).where("kept").collect())
    # One document of each group that links of brute-force similarity connect.
    assert sorted(r.doc_id for r in far) == brute_kept([(r.doc_id, r.text) for r in once])
    whole = {r.doc_id: r for r in far}
    assert mixed and all(whole[r.doc_id] == r for r in mixed)
    taken = {r.doc_id: r.full_copies + (r.part_words > 0) for r in curriculum_mix.mix(tables[3]).collect() if r.size}
    assert Counter(r.doc_id for r in mixed) == Counter({d: n for d, n in taken.items() if n})
    packed = p.STAGES[-1][1](spark, tables[-1], SF).collect()
    assert sum(r.piece == 0 for r in packed) == len(mixed)
    assert len(p.run(spark, SF).collect()) == len(packed)
