"""The Jaccard join (5) against all pairs."""

from __future__ import annotations

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from cellgrid.llm import jaccard_join as J
from cellgrid.llm.common import table


def brute_force(rows, rule):
    """(doc_id, set size, component) by all pairs that share a shingle."""
    sets, index = [], defaultdict(list)
    for k, (_, text) in enumerate(rows):
        w = (text or "").encode().lower().split()
        s = {tuple(w[i : i + rule.words]) for i in range(len(w) - rule.words + 1)} or ({tuple(w)} if w else set())
        sets.append(s)
        for g in s:
            index[g].append(k)
    root = list(range(len(rows)))

    def find(a):
        while root[a] != a:
            root[a] = root[root[a]]
            a = root[a]
        return a

    shared = Counter((a, b) for members in index.values() for i, a in enumerate(members) for b in members[i + 1 :])
    for (a, b), n in shared.items():
        if rule.den * n >= rule.num * (len(sets[a]) + len(sets[b]) - n):
            root[find(b)] = find(a)
    ids = defaultdict(list)
    for k, (doc_id, _) in enumerate(rows):
        ids[find(k)].append(doc_id)
    least = {r: min((i for i in v if i is not None), default=None) for r, v in ids.items()}
    return sorted((str(d), len(sets[k]), str(least[find(k)])) for k, (d, _) in enumerate(rows))


def check(docs, rule):
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    got = sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in J.near_duplicates(docs, rule).collect())
    assert got == brute_force(rows, rule)


@pytest.mark.parametrize("rule,short", [(J.Jaccard(), 24), (J.Jaccard(5, 80, 100), 24), (J.Jaccard(), 1), (J.Jaccard(5, 80, 100), 2)])
def test_documents(spark, small, monkeypatch, rule, short):
    monkeypatch.setattr(J, "SHORT_LIST", short)
    check(table(spark, small, "documents"), rule)


@pytest.mark.parametrize("seed,rule", [*((k, J.Jaccard(4, 85, 100)) for k in range(4)), *((k, J.Jaccard(5, 80, 100)) for k in (4, 5))])
def test_families_around_the_threshold(spark, monkeypatch, seed, rule):
    """Copies of a few texts with up to a fifth of their words changed, passages in common, tiny texts: most pairs are near the threshold."""
    monkeypatch.setattr(J, "SHORT_LIST", 3)
    monkeypatch.setattr(J, "CENTRE_SETS", 7)
    rnd, rows = random.Random(seed), []
    words = [f"w{k}" for k in range(300)]
    passage = [rnd.choice(words) for _ in range(30)]
    for family in range(5):
        origin = [rnd.choice(words) for _ in range(rnd.choice([6, 25, 80, 120]))]
        for _ in range(24):
            w = list(origin)
            for _ in range(rnd.randrange(0, 1 + len(w) // 12)):
                w[rnd.randrange(len(w))] = rnd.choice(words)
            if rnd.random() < 0.2:
                w = w[: len(w) - rnd.randrange(0, 1 + len(w) // 6)]
            if family % 2 and rnd.random() < 0.5:
                w += passage[: rnd.randrange(30)]
            rows.append((len(rows), " ".join(w)))
    rows += [(len(rows) + k, " ".join([rnd.choice(words) for _ in range(20)] + passage)) for k in range(30)]
    rnd.shuffle(rows)
    check(spark.createDataFrame(rows, "doc_id bigint, text string"), rule)


def test_edges(edges, nothing):
    check(edges, J.Jaccard())
    assert J.near_duplicates(nothing).count() == 0
    kept = J.one_of_each(edges, J.Jaccard(5, 80, 100))
    assert kept.columns == edges.columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter([0, 1, 2, 3, 4, 5, 7, 8, None, 9, 9])


def test_rows_of_one_id_answer_for_their_own_groups(spark):
    text = lambda k: " ".join(f"{k}word{i}" for i in range(40))
    rows = [
        (3, text("a")), (9, text("a") + " more"), (9, text("b")), (10, text("b") + " more"), (None, text("a") + " other"), (None, text("c")),
        (None, text("d")), (None, text("d")), (None, text("d") + " more"), (None, ""), (None, None), (11, text("e")), (11, text("e") + " more"), (12, text("f")), (12, text("f")), (12, text("f")), (12, None), (12, None),
    ]
    kept = [(r.doc_id, r.text) for r in J.one_of_each(spark.createDataFrame(rows, "doc_id bigint, text string"), J.Jaccard(5, 80, 100)).collect()]
    d = [t for _, t in kept if t and t.startswith("d")]
    e = [(i, t) for i, t in kept if t and t.startswith("e")]
    assert len(d) == 1 and len(e) == 1 and e[0] in rows
    assert Counter(k for k in kept if not (k[1] or "")[:1] in ("d", "e")) == Counter([(3, text("a")), (9, text("b")), (None, text("c")), (None, ""), (None, None), (12, text("f")), (12, None), (12, None)])


def test_components_of_a_chain(spark):
    chain = spark.createDataFrame([(k, k + 1) for k in range(70)] + [(100, 101)], "a bigint, b bigint")
    assert {(r.cls, r.label) for r in J.components(chain).collect()} == {(k, 0) for k in range(71)} | {(100, 100), (101, 100)}


@pytest.mark.parametrize("rule", [J.Jaccard(), J.Jaccard(5, 80, 100)])
def test_blocks_are_skipped_by_size_and_place(spark, rule):
    """Entries meet exactly where sizes and places leave a link open, and blocks keep most other pairs of a list from being formed."""
    rnd = random.Random(1)
    entries = []
    for h in range(40):
        for cls in rnd.sample(range(1000), 12):
            n = rnd.randrange(5, 400)
            entries.append((h, cls, n, rnd.randrange(rule.prefix(n))))
    got = {(r["h"], *sorted((r["a"], r["b"]))) for r in J.meetings(spark.createDataFrame(entries, "h bigint, cls bigint, n bigint, place int"), rule).selectExpr("x.h", "x.cls a", "y.cls b").collect()}
    want, blocked, all_pairs = set(), 0, 0
    block = lambda n: math.floor(math.log(n) * 2 / math.log(rule.den / rule.num))
    for k, (h, a, n, p) in enumerate(entries):
        for g, b, m, q in entries[k + 1 :]:
            if g != h:
                continue
            all_pairs += 1
            need = -(-rule.num * (n + m) // (rule.den + rule.num))
            if min(n - p, m - q) >= need and rule.num * max(n, m) <= rule.den * min(n, m):
                want.add((h, *sorted((a, b))))
            (n1, p1), (m1, _) = sorted([(n, p), (m, q)])
            largest = min((n1 - p1) * (rule.den + rule.num) // rule.num - n1, n1 * rule.den // rule.num)
            blocked += largest >= n1 and block(n1) <= block(m1) <= block(largest)
    assert got == want and len(want) <= blocked < all_pairs / 4


@pytest.mark.parametrize("words", [1, 4])
def test_sets_of_parts_equal_those_of_words_one_by_one(words):
    pick, tool = random.Random(7), J.Shingler(words)
    texts = [None, "", " \n", "a", " a\tB\x0bc\x0c d\r\n e ", "a a a a a a a", "\x1c x \x85 y É é z"]
    texts += ["".join(pick.choices("aBcé \t\n\x0b\x0c\r\x1c\x1f", k=pick.randint(0, 60))) for _ in range(500)]
    column = pa.array(texts, pa.string())
    got = [s for at in range(0, len(texts), 100) for s in tool.sets(column.slice(at, 100))]
    for text, s in zip(texts, got, strict=True):
        w = [xxhash.xxh64_intdigest(x) for x in (text or "").encode().lower().split()]
        k = min(words, len(w))
        assert s.dtype == np.uint64 and s.tolist() == sorted({int(h) for i in range(len(w) - k + 1) for h in J.window_hashes(np.array(w[i : i + k], np.uint64), k)} if w else [])
    assert vars(tool) == {"words": words}  # a worker's memory doesn't grow with the words that it has met


def test_tables_between_steps_are_few_files(spark, small, monkeypatch):
    """Of many small parts: a table of every step is a few files, and the rows are the same."""
    most, files, plain = 4 * spark.sparkContext.defaultParallelism, {}, J.written

    def counted(df, name, **options):
        out = plain(df, name, **options)
        files[name] = max(files.get(name, 0), len(out.inputFiles()))
        return out

    monkeypatch.setattr(J, "written", counted)
    monkeypatch.setattr(J, "SHORT_LIST", 2)
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", str(most + 4))
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        check(table(spark, small, "documents").repartition(most + 4), J.Jaccard())
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert {"signatures", "lists", "near", "labels"} <= set(files) and max(files.values()) <= most
