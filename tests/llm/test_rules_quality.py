"""Quality rules (8) and the quality classifier (6)."""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections import Counter

import numpy as np
import pytest

from cellgrid.llm import decision_list as D
from cellgrid.llm import quality_gam as Q
from cellgrid.llm.common import table


def base(text):
    """The base statistics, word by word."""
    t = text or ""
    w = re.findall("[^\x20\x09-\x0d]+", t)
    grams = Counter(zip(w, w[1:], w[2:]))
    repeated = {k for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for k in (i, i + 1, i + 2)}
    seen, dup = set(), 0
    for line in t.split("\n"):
        if re.search("[^\x20\x09-\x0d]", line):
            dup += line in seen
            seen.add(line)
    failed = len(w) < 50 or 100 * len(repeated) > 50 * len(w)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), dup, len(repeated), failed


def test_statistics_equal_brute_force(spark, small, edges, nothing, labels):
    for docs, marks in ((table(spark, small, "documents"), table(spark, small, "labels")), (edges, labels)):
        got = sorted((str(r.doc_id), r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in D.judge_documents(docs, marks).collect())
        assert got == sorted((str(r.doc_id), *base(r.text)) for r in docs.collect())
    assert D.judge_documents(nothing, labels).count() == 0


def test_kept_needs_the_base(spark, small):
    for r in D.judge_documents(table(spark, small, "documents"), table(spark, small, "labels")).collect():
        assert r.kept == (not r.base_failed and r.rule is None)


def test_rules_find_what_separates():
    rng = np.random.default_rng(0)
    x = rng.random((3000, len(D.FEATURES)))
    bad = (x[:, 0] > 0.9) | ((x[:, 1] < 0.1) & (x[:, 2] > 0.5))
    rules = D.learn_rules(x, bad, list(D.FEATURES))
    hit = np.zeros(len(x), bool)
    for rule in rules:
        m = np.ones(len(x), bool)
        for c in rule:
            m &= c.rows(x, list(D.FEATURES))
        hit |= m
    assert (hit == bad).mean() > 0.97 and all(len(r) <= D.MAX_CONDITIONS for r in rules)
    assert D.learn_rules(np.empty((0, len(D.FEATURES))), np.empty(0, bool), list(D.FEATURES)) == []


def test_rules_keep_good_documents(spark):
    sf = "/root/testdata/sf0.01"
    x = D.judge_documents(table(spark, sf, "documents"), table(spark, sf, "labels")).join(table(spark, sf, "labels"), "doc_id").where("not base_failed").collect()
    good, bad = [r.kept for r in x if r.quality == 1], [r.kept for r in x if r.quality == 0]
    assert np.mean(good) > 0.97 and np.mean(bad) < 0.25


def test_trees_and_pairs():
    g, h = np.array([3.0, 3, -3, -3, 5]), np.ones(5)
    tree = Q.shallow_tree(g, h, leaves=3, ridge=0.0)
    assert np.allclose(tree, [3, 3, -3, -3, 5])
    table_, gain = Q.pair_tree(np.array([[1.0, -1], [-1, 1]]), np.ones((2, 2)), ridge=0.0)
    assert np.allclose(table_, [[1, -1], [-1, 1]]) and gain > 0


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    docs, marks = table(spark, sf, "documents"), table(spark, sf, "labels")
    few = docs.join(marks.select("doc_id"), "doc_id", "left_semi")
    x = Q.score_documents(few, Q.learn(docs, marks)).join(marks, "doc_id").where("held_out").collect()
    assert len(x) > 500 and np.mean([r.predicted == r.quality for r in x]) > 0.97
    assert np.mean([r.predicted for r in x if r.quality == 1]) > 0.98


def test_model_with_one_kind_or_nothing():
    none = Q.fit(np.empty((0, len(Q.FEATURES))), np.empty(0))
    assert np.allclose(none.scores(np.zeros((2, len(Q.FEATURES)))), 0.5)
    ones = Q.fit(np.random.default_rng(1).random((50, len(Q.FEATURES))), np.ones(50))
    assert (ones.scores(np.zeros((1, len(Q.FEATURES)))) > 0.9).all()


def test_quality_edges(edges, nothing, labels):
    model = Q.learn(edges, labels)
    rows = Q.score_documents(edges, model).collect()
    assert len(rows) == edges.count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in rows)
    kept = Q.keep_good(edges, model, 0.0)
    assert kept.columns == edges.columns and kept.count() == edges.count()
    assert Q.score_documents(nothing, Q.learn(nothing, labels)).count() == 0


def rules_by_hand(x, bad, names):
    """Sequential covering over plain lists: of equal gains the first in the order of features, thresholds and directions."""
    rows = [(list(r), bool(b), k % 3 != 2) for k, (r, b) in enumerate(zip(x.tolist(), bad))]
    cuts = [sorted({float(v) for v in np.quantile([r[k] for r, _, _ in rows], np.linspace(0, 1, 49)[1:-1])}) for k in range(len(names))] if rows else []
    holds = lambda rule, r: all((r[k] >= t) == above for k, above, t in rule)
    left, found = list(rows), []

    def precision(rule, among):
        hit = [b for r, b, _ in among if holds(rule, r)]
        return (sum(hit) + 1) / (len(hit) + 2), sum(hit)

    while len(found) < D.MAX_RULES and any(b for _, b, g in left if g):
        inside, rule = [(r, b) for r, b, g in left if g], []
        while len(rule) < D.MAX_CONDITIONS and not all(b for _, b in inside):
            p0, n0 = sum(b for _, b in inside), len(inside)
            best, choice = 0.0, None
            for k in range(len(names)):
                for t in cuts[k]:
                    for above in (True, False):
                        hit = [b for r, b in inside if (r[k] >= t) == above]
                        p, n = sum(hit), len(hit)
                        if p >= D.MIN_COVER and n < n0 and p0:
                            gain = p * (math.log2(p / n) - math.log2(p0 / n0))
                            if gain > best + 1e-12:
                                best, choice = gain, (k, above, t)
            if choice is None:
                break
            rule.append(choice)
            inside = [(r, b) for r, b in inside if holds([choice], r)]
        held = [row for row in left if not row[2]]
        while len(rule) > 1 and precision(rule[:-1], held)[0] >= precision(rule, held)[0]:
            rule = rule[:-1]
        if not rule or precision(rule, left)[0] < D.MIN_PRECISION or precision(rule, left)[1] < D.MIN_COVER:
            break
        found.append(rule)
        left = [row for row in left if not holds(rule, row[0])]
    return found


@pytest.mark.parametrize("seed", range(4))
def test_learner_equals_plain_loops(seed):
    rng = np.random.default_rng(seed)
    x = np.round(rng.random((240, 4)) * rng.choice([1, 10], 4), 2)
    bad = ((x[:, 0] > np.quantile(x[:, 0], 0.8)) & (x[:, 1] < np.median(x[:, 1]))) | (x[:, 2] > np.quantile(x[:, 2], 0.9)) | (rng.random(240) < 0.02)
    names = list(D.FEATURES)[:4]
    got = [[(names.index(c.feature), c.above, c.threshold) for c in rule] for rule in D.learn_rules(x, bad, names)]
    assert got == rules_by_hand(x, bad, names) and got


def features_by_hand(text):
    n, chars, symbols, dup, repeated, _ = base(text)
    if not n:
        return [0.0] * len(D.FEATURES)
    w = re.findall("[^\x20\x09-\x0d]+", text)
    upper, bangs, digits = len(__import__("regex").findall(r"\p{Lu}", text)), text.count("!"), len(re.findall("[0-9]", text))
    return [symbols / n, symbols / chars, chars / n, repeated / n, dup / n, upper / chars, bangs / n, digits / chars, len(set(w)) / n]


def test_verdict_equals_rules_by_hand(spark, small):
    """The whole method by plain Python: features of the labelled texts, the learner, and each document's verdict."""
    docs, marks = table(spark, small, "documents"), table(spark, small, "labels")
    quality = {}
    for r in marks.collect():
        if r.doc_id is not None and r.quality is not None:
            quality[r.doc_id] = min(r.quality, quality.get(r.doc_id, r.quality))
    texts = {r.doc_id: r.text for r in docs.collect()}
    known = sorted(d for d in quality if d in texts)
    rules = rules_by_hand(np.array([features_by_hand(texts[d]) for d in known]), np.array([quality[d] == 0 for d in known]), list(D.FEATURES))
    for r in D.judge_documents(docs, marks).collect():
        x = features_by_hand(texts[r.doc_id])
        hit = next((k for k, rule in enumerate(rules, 1) if all((x[f] >= t) == above for f, above, t in rule)), None)
        assert r.rule == hit and r.kept == (not base(texts[r.doc_id])[-1] and hit is None)


@pytest.mark.parametrize("seed", range(5))
def test_trees_equal_plain_loops(seed):
    rng = np.random.default_rng(seed)
    g, h = rng.normal(size=9), rng.random(9) + 0.1
    worth = lambda a, b: sum(g[a:b]) ** 2 / (sum(h[a:b]) + 1)
    parts = [(0, 9)]
    for _ in range(2):  # the cut that gains most, twice
        gains = {(a, k, b): worth(a, k) + worth(k, b) - worth(a, b) for a, b in parts for k in range(a + 1, b)}
        a, k, b = max(gains, key=gains.get)
        if gains[a, k, b] <= 1e-9:
            break
        parts.remove((a, b))
        parts += [(a, k), (k, b)]
    want = [next(sum(g[a:b]) / (sum(h[a:b]) + 1) for a, b in parts if a <= i < b) for i in range(9)]
    assert np.allclose(Q.shallow_tree(g, h), want)
    g, h = rng.normal(size=(4, 5)), rng.random((4, 5)) + 0.1
    quarters = lambda i, j: [(slice(a, b), slice(c, d)) for a, b in ((0, i), (i, 4)) for c, d in ((0, j), (j, 5))]
    total = lambda i, j: sum(g[q].sum() ** 2 / (h[q].sum() + 1) for q in quarters(i, j))
    i, j = max(((i, j) for i in range(1, 4) for j in range(1, 5)), key=lambda c: total(*c))
    want = np.zeros((4, 5))
    for q in quarters(i, j):
        want[q] = g[q].sum() / (h[q].sum() + 1)
    table_, gain = Q.pair_tree(g, h)
    assert np.allclose(table_, want) and abs(gain - (total(i, j) - g.sum() ** 2 / (h.sum() + 1))) < 1e-9


def test_scores_equal_single_lookups():
    rng = np.random.default_rng(2)
    x = rng.random((300, len(Q.FEATURES)))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    model = Q.fit(x, y)
    for row, score in zip(x[:60].tolist(), model.scores(x[:60]).tolist()):
        z = model.start + sum(t[bisect_right(e.tolist(), v)] for v, e, t in zip(row, model.edges, model.tables))
        z += sum(t[bisect_right(model.pair_edges[a].tolist(), row[a])][bisect_right(model.pair_edges[b].tolist(), row[b])] for (a, b), t in zip(model.pairs, model.pair_tables))
        assert abs(score - 1 / (1 + math.exp(-z))) < 1e-9
    assert ((model.scores(x) > 0.5) == (y > 0)).mean() > 0.9  # only a pair of features tells the labels apart
