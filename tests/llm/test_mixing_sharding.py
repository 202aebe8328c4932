"""Mixing (1) and sharding (3)."""

from __future__ import annotations

from collections import Counter, defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from cellgrid.llm import mixing as M
from cellgrid.llm import ring_shards as R
from cellgrid.llm.common import table


def exact_fill(budget, caps, weights):
    """Whole tokens one after another would be slow; shares by exact fractions until nobody is full."""
    from fractions import Fraction

    got, active, left = {}, set(caps), Fraction(budget)
    while active:
        total = sum(weights[k] for k in active)
        full = {k for k in active if caps[k] * total <= left * weights[k]}
        if not full:
            return {**got, **{k: left * weights[k] / total for k in active}}
        k = min(full, key=lambda x: (Fraction(caps[x], weights[x]), x))
        got[k] = Fraction(caps[k])
        left -= caps[k]
        active.discard(k)
    return got


@settings(max_examples=12, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 50), st.integers(1, 9)), min_size=1, max_size=6), st.integers(0, 100))
def test_water_fill(spark, nodes, share):
    caps, weights = {f"n{k}": c for k, (c, _) in enumerate(nodes)}, {f"n{k}": w for k, (_, w) in enumerate(nodes)}
    budget = sum(caps.values()) * share // 100
    df = spark.createDataFrame([(k, caps[k], weights[k], budget) for k in caps], "name string, cap bigint, w bigint, budget bigint")
    got = {r.name: r.out for r in M.water_fill(df, [], "budget", "cap", "w", "name", "out").collect()}
    want = exact_fill(budget, caps, weights)
    assert sum(got.values()) == budget and all(0 <= got[k] <= caps[k] and abs(got[k] - want[k]) <= 1 for k in caps)


@pytest.mark.parametrize("percent,epochs", [(100, 4), (30, 1), (250, 3), (90, 1)])
def test_leaves_take_exactly_their_budget(spark, small, percent, epochs):
    docs = table(spark, small, "documents")
    mix = M.Mixture(budget_percent=percent, max_epochs=epochs)
    rows = M.mix_documents(docs, mix).collect()
    words = {r.doc_id: len(r.text.split()) for r in docs.collect()}
    taken = defaultdict(int)
    budgets = {}
    for r in rows:
        assert r.tokens == words[r.doc_id] and r.taken == r.full_epochs * r.tokens + r.last_take and 0 <= r.last_take <= r.tokens and r.full_epochs <= epochs
        taken[r.domain, r.lang, r.source] += r.taken
        budgets[r.domain, r.lang, r.source] = r.leaf_budget
    assert taken == budgets
    assert sum(budgets.values()) == min(sum(words.values()) * percent // 100, sum(words.values()) * epochs)
    partial = Counter((r.domain, r.lang, r.source) for r in rows if 0 < r.last_take < r.tokens)
    assert max(partial.values(), default=0) <= 1


def test_seed_changes_the_prefix(spark, small):
    docs = table(spark, small, "documents")
    ids = [{r.doc_id for r in M.mix_documents(docs, M.Mixture(budget_percent=30, max_epochs=1, seed=s)).collect()} for s in ("a", "b", "a")]
    assert ids[0] == ids[2] != ids[1]


def test_mixing_edges(edges, nothing):
    rows = M.mix_documents(edges, M.Mixture(budget_percent=400)).collect()
    assert {r.doc_id for r in rows} == {0, 4, 5, 6, 7, 8, None, 9} and len(rows) == 10
    assert M.mix_documents(nothing).count() == 0
    kept = M.drawn(edges, M.Mixture(budget_percent=400))
    assert kept.columns == edges.columns and kept.count() == 10 and kept.first().domain == "domain!"


def test_rows_are_drawn_one_by_one(spark):
    docs = spark.createDataFrame([(None if k % 3 else 7, "some words of a text " * (1 + k % 4), "en", "src1") for k in range(300)], "doc_id bigint, text string, lang string, source string").repartition(5)
    mix = M.Mixture(budget_percent=50, max_epochs=1)
    taken = M.mix_documents(docs, mix).collect()
    assert sum(r.taken for r in taken) == sum(5 * (1 + k % 4) for k in range(300)) // 2
    assert M.drawn(docs, mix).count() == len(taken) < 300


def by_hand(counts, nodes, room):
    """The walk key by key."""
    out, room = defaultdict(list), list(room)
    order = [s for _, s in nodes]
    for slot in sorted(counts):
        at = next((k for k, (p, _) in enumerate(nodes) if p >= slot), 0)
        for rank in range(counts[slot]):
            k = at
            while room[order[k % len(order)]] == 0:
                k += 1
            room[order[k % len(order)]] -= 1
            out[slot].append(order[k % len(order)])
    return out


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(0, 40), st.integers(1, 9), max_size=12), st.integers(1, 5), st.integers(0, 99))
def test_walk_equals_key_by_key(counts, shards, seed):
    import random

    rnd = random.Random(seed)
    nodes = sorted((rnd.randrange(40), s) for s in range(shards) for _ in range(3))
    room = R.capacities(sum(counts.values()), shards)
    want, got = by_hand(counts, nodes, room), defaultdict(list)
    for slot, a, b, shard, _ in R.walk(counts, nodes, list(room)):
        assert len(got[slot]) == a
        got[slot] += [shard] * (b - a)
    assert got == want


def test_shards_are_even_and_gapless(spark, small, edges, nothing):
    for docs, shards in ((table(spark, small, "documents"), 24), (edges, 5), (edges, 24), (nothing, 24)):
        rows = R.documents_to_shards(docs, shards).collect()
        assert len(rows) == docs.count()
        slots = defaultdict(list)
        for r in rows:
            slots[r["shard"]].append(r.slot)
            assert r["law"] == "rows" and r.grown_shard is None
        assert all(sorted(v) == list(range(len(v))) for v in slots.values())
        counts = [len(slots[s]) for s in range(shards)]
        assert max(counts) - min(counts) <= 1


def test_movement_is_limited(spark):
    keys = spark.range(4000).selectExpr("0 as row", "id as key", "8L as size", "0L as text_crc32")
    a, b = ({r.key: r["shard"] for r in R.shard_rows(keys, n, slack=0.2).collect()} for n in (10, 11))
    assert sum(a[k] != b[k] for k in a) < 0.45 * len(a)


def test_a_hot_key_is_ranked_in_chunks(spark):
    docs = spark.createDataFrame([(None if k % 3 else k, "the same text" if k % 2 else f"text {k}") for k in range(900)], "doc_id bigint, text string").repartition(6)
    for x in (R.documents_to_shards(docs, 7), R.with_shards(docs, 7)):
        slots = defaultdict(list)
        for r in x.collect():
            slots[r["shard"]].append(r.slot)
        assert sum(map(len, slots.values())) == 900 and all(sorted(v) == list(range(len(v))) and len(v) in (128, 129) for v in slots.values())


def test_columns_of_the_input_stay(edges):
    got = R.with_shards(edges, 3)
    assert sorted(got.columns) == sorted({*edges.columns, "size", "text_crc32", "shard", "slot"}) and len(set(got.columns)) == len(got.columns)
    row = got.where("doc_id = 0").first()
    assert row["ring_slot"] == "ring_slot!" and row["base"] == "base!" and row["size"] == 8 + len(row["text"]) and 0 <= row["shard"] < 3
