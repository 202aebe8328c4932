"""Class-based scoring (10)."""

from __future__ import annotations

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from cellgrid.llm import brown_lm as B
from cellgrid.llm.common import table


def fold(doc_id):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % 7 == 2


def check(docs, brown=None):
    rows = docs.select("doc_id", "text").collect()
    words = lambda t: [*(t or "").encode().lower().split(), None]
    counts = Counter(w for r in rows if not fold(r.doc_id) for w in words(r.text))
    n, v = sum(counts.values()), len(counts)
    want = sorted((str(r.doc_id), fold(r.doc_id), len(words(r.text)), sum(counts[w] > 0 for w in words(r.text)), n, round(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in words(r.text)), 6)) for r in rows)
    scored = B.score_documents(docs, brown).collect()
    got = sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in scored)
    assert [g[:5] for g in got] == [w[:5] for w in want] and np.allclose([g[5] for g in got], [w[5] for w in want], atol=1e-5)
    assert all(r.score < 0 and math.isfinite(r.score) for r in scored)
    return scored


@pytest.mark.parametrize("known", [1 << 17, 64])
def test_documents(spark, small, known):
    scored = check(table(spark, small, "documents"), B.Brown(known=known, types=min(1 << 13, known // 2)))
    held = [r for r in scored if r.held_out]
    if known > 64:  # word order is worth something on texts that were not learned
        assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_edges(edges, nothing):
    check(edges)
    check(edges, B.Brown(known=3, types=2, shapes=4))
    assert B.score_documents(nothing).count() == 0


def by_hand(rows, m):
    """Scores by loops over single words: types, sweeps, one exchange of every other word, transitions."""
    words = {k: (text or "").encode().lower().split() for k, text in rows}
    train = [w for k, w in words.items() if not fold(k)]
    count = Counter(x for w in train for x in w)
    own = sorted(count, key=lambda x: (-count[x], B.word_hash(x)))[: m.types]
    kind = {x: m.end + 1 + k for k, x in enumerate(own)}
    type_of = lambda x: kind.get(x, m.shape(x))
    texts = [[m.end, *map(type_of, w), m.end] for w in train]

    def met(classes):
        before, after = Counter(), Counter()
        for t in texts:
            for a, b in zip(t, t[1:]):
                before[b, classes[a]] += 1
                after[a, classes[b]] += 1
        return before, after

    def told(pairs):
        n = sum(pairs[a, b] + m.alpha for a in range(m.classes) for b in range(m.classes))
        first = [sum(pairs[a, b] + m.alpha for b in range(m.classes)) for a in range(m.classes)]
        second = [sum(pairs[a, b] + m.alpha for a in range(m.classes)) for b in range(m.classes)]
        return {(a, b): math.log((pairs[a, b] + m.alpha) * n / first[a] / second[b]) for a in range(m.classes) for b in range(m.classes)}

    def pairs_of(classes):
        return Counter((classes[a], classes[b]) for t in texts for a, b in zip(t, t[1:]))

    def inform(pairs):
        n, first, second = sum(pairs.values()), Counter(), Counter()
        for (a, b), c in pairs.items():
            first[a] += c
            second[b] += c
        return sum(c / n * math.log(c * n / first[a] / second[b]) for (a, b), c in pairs.items())

    def gains(before, after, info, t):
        return [sum(before[t, c] * info[c, k] + after[t, c] * info[k, c] for c in range(m.classes)) for k in range(m.classes - 1)]

    best = lambda g: max(range(len(g)), key=lambda k: (round(g[k], 9), -k))
    classes = {t: t % (m.classes - 1) for t in range(m.size)} | {m.end: m.classes - 1}
    used = {t for text in texts for t in text}
    while True:
        moved = dict(classes)
        for turn in range(2):
            before, after = met(moved)
            info = told(pairs_of(moved))
            moved |= {t: best(gains(before, after, info, t)) for t in used if t % 2 == turn and t != m.end}
        gain = inform(pairs_of(moved)) - inform(pairs_of(classes))
        if gain > 0:
            classes = moved
        if gain < m.least_gain:
            break
    before, after = met(classes)
    info = told(pairs_of(classes))
    of_word = {x: classes[kind[x]] for x in own}
    rare_before, rare_after = Counter(), Counter()
    for w, t in zip(train, texts):
        for k, x in enumerate(w):
            rare_before[x, classes[t[k]]] += 1
            rare_after[x, classes[t[k + 2]]] += 1
    for x in set(count) - set(own):
        s = m.shape(x)
        shapes = sum(before[s, c] for c in range(m.classes))
        lean = [m.prior * g / shapes for g in gains(before, after, info, s)]
        of_word[x] = best([a + b for a, b in zip(gains(rare_before, rare_after, info, x), lean)])
    class_of = lambda x: of_word.get(x, classes[m.shape(x)])
    steps, totals = Counter(), Counter()
    for w in train:
        c = [m.classes - 1, *map(class_of, w), m.classes - 1]
        steps.update(zip(c, c[1:]))
    for x, n in count.items():
        totals[class_of(x)] += n + 1
    totals[m.classes - 1] += len(train) + 1
    out = {}
    for k, w in words.items():
        c = [m.classes - 1, *map(class_of, w), m.classes - 1]
        p = sum(math.log10((steps[a, b] + m.alpha) / (sum(steps[a, d] for d in range(m.classes)) + m.alpha * m.classes)) for a, b in zip(c, c[1:]))
        out[k] = p + sum(math.log10((n + 1) / (totals[d] + 1)) for n, d in zip([*(count[x] for x in w), len(train)], c[1:]))
    return out


@pytest.mark.parametrize("seed,known,types", [(1, 40, 12), (2, 15, 6), (3, 6, 6), (4, 1 << 17, 30)])
def test_scores_equal_single_words(spark, seed, known, types):
    rng = random.Random(seed)
    nouns, verbs = [f"{a}{b}" for a in "bcdf" for b in ("at", "og", "ill")], [f"{a}{b}ed" for a in "lmnp" for b in ("a", "i", "ook")]
    text = lambda: " ".join(f"the {rng.choice(nouns)} {rng.choice(verbs)} {rng.choice(('a', 'one', 'no'))} {rng.choice(nouns)}" for _ in range(rng.randrange(1, 5)))
    rows = [(k, text()) for k in range(60)] + [(60, None), (61, "words that no other text has")]
    brown = B.Brown(classes=6, types=types, shapes=8, known=known, prior=0.3)
    got = {r.doc_id: r.score for r in B.score_documents(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3), brown).collect()}
    want = by_hand(rows, brown)
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-6 for k in want)


def test_probabilities_of_a_class_add_up(spark):
    docs = spark.createDataFrame([(k, "the cat sat on the mat " * 3 + f"word{k}") for k in range(30)], "doc_id bigint, text string")
    brown = B.Brown(types=4, known=6)
    counts = B.count_words(B._texts(docs).where("not held_out"))
    vocabulary = B.frequent_words(counts, brown)
    read = B.written(B.read_documents(docs, vocabulary, brown, 5), "read")
    classes, neighbours = B.learned_classes(lambda c: B.neighbour_counts(read, brown, c), brown)
    others = B.written(B.best_classes(read, vocabulary, brown, classes, neighbours), "others")
    own = vocabulary.types >= 0
    rest = {r.h: r.c for r in counts.where(f"h != {B.END}").collect()}
    assert {r.h: r.c for r in others.collect()} == {h: c for h, c in rest.items() if h not in set(vocabulary.hashes[own].tolist())}
    classed = B.with_classes(read, others, vocabulary, brown, classes, B.known_classes(others, vocabulary))
    model = B.class_model(B.transitions(classed, brown), others, vocabulary, brown, classes, 5)
    assert np.allclose((10**model.transitions).sum(1), 1)
    total = np.zeros(brown.classes)
    for c, n in [*((r["class"], r.c) for r in others.collect()), *zip(classes[vocabulary.types[own]], vocabulary.counts[own])]:
        total[c] += (n + 1) / 10 ** model.class_totals[c]
    assert (total <= 1 + 1e-9).all()


def _alternating(brown):
    """Types of two sorts that follow each other, and their neighbours' counts under some classes."""
    rng = np.random.default_rng(3)
    a, b = np.arange(brown.end + 1, brown.end + 31), np.arange(brown.end + 31, brown.end + 61)
    seq = np.empty(20_000, np.int64)
    seq[0::2], seq[1::2] = rng.choice(a, 10_000), rng.choice(b, 10_000)

    def count(classes):
        out, c = np.zeros((brown.size, 2 * brown.classes), np.int64), classes[seq]
        np.add.at(out, (seq[1:], c[:-1]), 1)
        np.add.at(out, (seq[:-1], brown.classes + c[1:]), 1)
        return out

    return a, b, count


def test_sweeps_go_on_until_little_is_gained():
    brown = B.Brown(types=60)
    a, b, count = _alternating(brown)
    classes, counts = B.learned_classes(count, brown)
    assert B.information(count(B.first_classes(brown)), B.first_classes(brown)) < B.information(counts, classes)
    assert not set(classes[a]) & set(classes[b]) and (counts == count(classes)).all() and classes[brown.end] == brown.classes - 1
    again = classes
    for turn in range(2):
        again = B.exchange(count(again), again, turn, brown)
    assert B.information(count(again), again) - B.information(counts, classes) < brown.least_gain
    assert B.learned_classes(lambda c: np.zeros((brown.size, 2 * brown.classes), np.int64), brown)[1].sum() == 0
