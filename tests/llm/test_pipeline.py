"""The pipeline's stages against their operators' own results, and planted cases."""

from __future__ import annotations

from collections import Counter

import pytest

import corpus_pipeline as P
from cellgrid.llm import mixing, quality_gam, template_decon
from cellgrid.llm.common import table, written

from test_near_duplicates import brute_force

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def stages(spark):
    out, docs = [], table(spark, SF, "documents")
    for name, f in P.STAGES:
        out.append((name, docs, after := written(f(spark, docs, SF), "test-stage")))
        docs = after
    return {name: (before, after) for name, before, after in out}


def ids(df):
    return {r.doc_id for r in df.select("doc_id").collect()}


def test_order_and_columns(stages):
    assert list(stages) == ["quality", "near duplicates", "decontamination", "mixture", "shards"]
    for name, (before, after) in stages.items():
        if name != "shards":
            assert after.dtypes == before.dtypes


def test_quality_keeps_good_documents(spark, stages):
    before, after = stages["quality"]
    labels = {r.doc_id: r.quality for r in table(spark, SF, "labels").collect()}
    kept = ids(after)
    good, bad = [d for d in ids(before) if labels.get(d) == 1], [d for d in ids(before) if labels.get(d) == 0]
    assert sum(d in kept for d in good) >= 0.98 * len(good) and sum(d in kept for d in bad) <= 0.1 * len(bad)


def test_one_of_each_group_stays(stages):
    before, after = stages["near duplicates"]
    rows = [(r.doc_id, r.text) for r in before.collect()]
    assert ids(after) == {int(c) for _, _, c in brute_force(rows, P.NEAR)}


def test_items_are_gone(spark, stages):
    before, after = stages["decontamination"]
    items = [" ".join(r.text.split()) for r in table(spark, SF, "benchmark").collect()]
    assert not any(x in " ".join(r.text.split()) for r in after.collect() for x in items)
    assert ids(before) - ids(after) == {r.doc_id for r in template_decon.leaks(before, table(spark, SF, "benchmark")).collect()}


def test_mixture(stages):
    before, after = stages["mixture"]
    rows = {r.doc_id: r.taken for r in mixing.mix_documents(before, P.MIX).collect()}
    assert ids(after) == set(rows) and 0 < len(rows) < before.count()


def test_shards_hold_all(stages):
    before, after = stages["shards"]
    rows = after.collect()
    counts = Counter(r["shard"] for r in rows)
    assert len(rows) == before.count() and max(counts.values()) - min(counts[s] for s in range(P.SHARDS)) <= 1


def test_stages_write_few_files(spark, stages):
    """However many parts their input has."""
    most = 4 * spark.sparkContext.defaultParallelism
    for name, f in P.STAGES:
        assert f(spark, stages[name][0].repartition(most + 4), SF).rdd.getNumPartitions() <= most


def test_edges_and_nothing(spark, edges, nothing, labels, tmp_path):
    table(spark, SF, "benchmark").write.parquet(str(tmp_path / "benchmark.parquet"))
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    plain = ["doc_id", "text", "lang", "source", "n_chars"]
    for docs in (edges.select(*plain), nothing.select(*plain)):
        docs.write.mode("overwrite").parquet(str(tmp_path / "documents.parquet"))
        got = P.run(spark, str(tmp_path))
        assert got.count() <= docs.count() and {"doc_id", "shard", "slot"} <= set(got.columns)
    assert quality_gam.FEATURES
