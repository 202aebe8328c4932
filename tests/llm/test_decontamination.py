"""Benchmark decontamination (7)."""

from __future__ import annotations

import random
import re
from collections import defaultdict

import pytest

from cellgrid.llm import template_decon as D
from cellgrid.llm.common import table

ITEM = "A train leaves the old station at 9 and travels 120 km in 3 hours while Alice waits with 14 apples for the answer to this question."


@pytest.fixture(scope="module")
def benchmark(spark):
    return spark.createDataFrame([(1, ITEM), (2, "short item of six words here"), (3, None), (4, ""), (5, "what is it")], "item_id bigint, text string")


def found(spark, benchmark, *texts):
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id bigint, text string")
    return {(r.doc_id, r.item_id): r for r in D.leaks(docs, benchmark).collect()}


def test_passages_and_other_numbers(spark, benchmark):
    noise = "some words before it that mean nothing at all, "
    new = ITEM.replace("120", "250").replace(" 3 ", " 5 ").replace("Alice", "Bertha").replace("14", "77").replace("at 9", "at 8")
    mixed = "A train leaves the old station at 9 and travels 9 km in 9 hours while Alice waits with 9 apples for the answer to this question."
    twice = ITEM.replace("120", "14")  # two values of the item stand for one; in capitals the name is a word, and the rest of the item is enough
    got = found(spark, benchmark, noise + ITEM + " and after", noise + new, "unrelated text about the weather and the sea " * 5, mixed, twice, ITEM.upper(), None, "")
    assert set(got) == {(0, 1), (1, 1), (5, 1)} and got[0, 1].changed_slots == 0 and got[1, 1].changed_slots >= 4


def test_short_items_need_nearly_all_words(spark, benchmark):
    got = found(spark, benchmark, "here is a short item of six words here today", "a short item of six", "so what is it now", "it is what")
    assert {k for k in got} == {(0, 2), (2, 5)}


def test_documents_with_whole_items(spark, small):
    docs, items = table(spark, small, "documents"), table(spark, small, "benchmark")
    got = {(r.doc_id, r.item_id) for r in D.leaks(docs, items).collect()}
    clean = lambda t: " ".join((t or "").split())
    texts, wanted = {r.doc_id: clean(r.text) for r in docs.collect()}, {r.item_id: clean(r.text) for r in items.collect()}
    whole = {(d, i) for d, t in texts.items() for i, x in wanted.items() if x in t and len(x.split()) >= 8}
    assert whole <= got
    for d, i in got:  # whatever is found shares a run of words
        w = wanted[i].split()
        assert any(" ".join(w[k : k + 6]) in texts[d] for k in range(max(1, len(w) - 5)))


def test_copies_with_words_put_in_or_left_out(spark):
    words = [f"item{k}" for k in range(24)]
    long = [f"long{k}" for k in range(90)]
    items = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(long))], "item_id bigint, text string")
    put_in = " ".join([*words[:12], "extra", *words[12:]])
    left_out = " ".join(words[:10] + words[11:])
    every_12 = " ".join(w + " extra" * (k % 12 == 11) for k, w in enumerate(long))
    far = " ".join([*words[:12], *["other"] * 60, *words[12:]])
    turned = " ".join(words[12:] + words[:12])
    got = found(spark, items, "before " + put_in + " after", left_out, every_12, far, turned, " ".join(words[:12]))
    assert {k: r.covered_words for k, r in got.items()} == {(0, 1): 24, (1, 1): 23, (2, 2): 90}  # the six words at the end are less than a window, but hold seeds
    halves = spark.createDataFrame([(None, " ".join(words[:12])), (None, "extra " * 13 + " ".join(words[12:]))], "doc_id bigint, text string")
    assert D.leaks(halves, items).count() == 0


def test_word_for_word_copies_count_whatever_their_slots_are(spark):
    series = "values " + " ".join(str(k * k) for k in range(3, 33))
    title = "The Old Man And The Sea Beside The Long River Of Northern Wales Under Grey Winter Skies"
    items = spark.createDataFrame([(1, series), (2, title), (3, "7 8 9 10 11 12")], "item_id bigint, text string")
    other = " ".join(str(k * k + 1) for k in range(3, 33))
    got = found(spark, items, "so " + series + " end", "he read " + title + " twice", "so values " + other, "Some Other Title That Has Many Words In Capitals And Goes On Like This For Long", "1 7 8 9 10 11 12 13", "1 2 3 4 5 6")
    assert {k: r.covered_words for k, r in got.items()} == {(0, 1): 31, (1, 2): len(title.split()), (4, 3): 6}


def test_edges(edges, nothing, spark, benchmark):
    assert D.leaks(edges, benchmark).count() == 0 and D.leaks(nothing, benchmark).count() == 0
    assert D.leaks(edges, benchmark.limit(0)).count() == 0
    kept = D.without_leaks(edges, benchmark)
    assert kept.columns == edges.columns and kept.count() == edges.count()
    assert kept.first().place == "place!"


def test_rows_are_judged_one_by_one(spark, benchmark):
    docs = spark.createDataFrame([(None, ITEM), (None, "a clean text"), (4, "another clean text"), (4, ITEM), (5, None)], "doc_id bigint, text string")
    assert sorted(map(str, ((r.doc_id, r.text) for r in D.without_leaks(docs, benchmark).collect()))) == sorted(map(str, [(None, "a clean text"), (4, "another clean text"), (5, None)]))


def canonical(text):
    """(template, value) of every word: value is the word where a slot stands for it."""
    out, before, fresh = [], None, True
    for w in text.split():
        core = re.sub(r"^[^\w$€£+-]+|[^\w%]+$", "", w)
        number = re.fullmatch(r"[+-]?[$€£]?\d[\d.,:/]*(st|nd|rd|th|%)?", core)
        kind = "number" if number else "unit" if core.lower() in D.UNITS else "name" if core[:1].isupper() and not core.isupper() else None
        slot = kind if kind == "number" or (kind == "unit" and before == "number") or (kind == "name" and not fresh) else None
        out.append((f"<{slot}>" if slot else core.lower(), core.lower() if slot else None))
        before, fresh = kind, w[-1] in ".!?:;|" or not core
    return out


def longest_match(doc, item):
    """The most words of an item that a diagonal or a chain of pieces covers, by comparing every window with every window and trying every chain; None if too few."""
    d, i = canonical(doc), canonical(item)
    if not i:
        return None
    size = min(8, len(i))
    lines = defaultdict(list)
    for a in range(len(d) - size + 1):
        for b in range(len(i) - size + 1):
            x, y = d[a : a + size], i[b : b + size]
            enough = sum(v is None for _, v in y) >= min(4, size)
            same = [t for t, _ in x] == [t for t, _ in y] if enough else [v or t for t, v in x] == [v or t for t, v in y] and [v is None for _, v in x].count(True) < min(4, size)
            if same:
                lines[a - b].append((b, enough, {(q, p) for (_, p), (_, q) in zip(x, y) if q and enough}))
    agree, places, broken = {}, defaultdict(set), set()
    need, best, pieces = min(13, max(1, len(i) - (len(i) > 3))), 0, []
    one_to_one = lambda m: len({q for q, _ in m}) == len(m) == len({p for _, p in m})
    for line, hits in lines.items():
        pairs = set().union(*(m for _, _, m in hits))
        if not one_to_one(pairs):
            hits, pairs = [h for h in hits if not h[1]], set()
            broken.add(line)
        agree[line], places[line] = pairs, {(b, size) for b, _, _ in hits}
        covered = {b + k for b, _, _ in hits for k in range(size)}
        if len(covered) >= need:
            best = max(best, len(covered))
    seeds = defaultdict(set)
    for a in range(len(d) - 3 if len(i) > 8 else 0):
        for b in range(len(i) - 3):
            if [v or t for t, v in d[a : a + 4]] == [v or t for t, v in i[b : b + 4]] and a - b not in broken:
                seeds[a - b].add((b, 4))
    for line in {*places, *seeds}:
        for windows in (places[line], places[line] | seeds[line]):
            runs = []
            for b, n in sorted(windows):
                if runs and b <= runs[-1][1]:
                    runs[-1][1:] = max(runs[-1][1], b + n), runs[-1][2] or n == size
                else:
                    runs.append([b, b + n, n == size])
            pieces += [(line + a, a, z, agree.get(line, set()), full) for a, z, full in runs]

    def chain(last, covered, pairs):
        nonlocal best
        if covered >= need:
            best = max(best, covered)
        for p in pieces:
            gap = 16 if last[4] and p[4] else 4
            if last[0] < p[0] and last[1] < p[1] and last[2] < p[2] and p[0] - (last[0] + last[2] - last[1]) <= gap and p[1] - last[2] <= gap and one_to_one(pairs | p[3]):
                chain(p, covered + p[2] - max(p[1], last[2]), pairs | p[3])

    for p in pieces:
        chain(p, p[2] - p[1], p[3])
    return best or None


@pytest.mark.parametrize("seed", range(3))
def test_equals_all_windows_and_chains(spark, seed):
    """Copies with words changed, put in, left out and other numbers, around the least length."""
    rnd = random.Random(seed)
    plain = [f"w{k}" for k in "abcdefghijklmnopqrstuvwx"]
    word = lambda: rnd.choice([*plain, *plain, "Anna", "Boris", "12", "7", "km", "99"])
    items = [" ".join(word() for _ in range(rnd.choice([3, 6, 10, 14, 20, 30]))) for _ in range(14)]
    docs = []
    for k in range(250):
        w = rnd.choice(items).split()
        a = rnd.randrange(0, 1 + len(w) // 3)
        w = w[a : a + rnd.randrange(5, 31)]
        for _ in range(rnd.choice([0, 0, 1, 1, 2, 3])):
            at = rnd.randrange(len(w) or 1)
            w[at : at + rnd.randrange(2)] = [word() for _ in range(rnd.randrange(3))]
        swap = {"12": "31", "7": "12" if rnd.random() < 0.5 else "8", "Anna": "Clara"} if rnd.random() < 0.4 else {}
        docs.append((k, " ".join([word() for _ in range(rnd.randrange(4))] + [swap.get(x, x) for x in w] + [word() for _ in range(rnd.randrange(4))])))
    got = {(r.doc_id, r.item_id): r.covered_words for r in D.leaks(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(list(enumerate(items)), "item_id bigint, text string")).collect()}
    want = {(k, i): n for k, text in docs for i, item in enumerate(items) if (n := longest_match(text, item))}
    assert got == want and len(want) > 30


def test_densely_changed_copies(spark, small):
    """Every benchmark item with one word in so many replaced: nearly all are found, with no wrong pair."""
    items = table(spark, small, "benchmark").where("text is not null")
    rows = [(r.item_id, r.text.split()) for r in items.collect()]
    docs, of = [], {}
    for every in (5, 6, 7, 9, 12):
        for item, w in rows:
            of[len(docs)] = (every, item)
            docs.append((len(docs), " ".join(["before"] * 30 + ["other" if k % every == every - 1 else x for k, x in enumerate(w)] + ["after"] * 30)))
    got = {(r.doc_id, r.item_id) for r in D.leaks(spark.createDataFrame(docs, "doc_id bigint, text string"), items).collect()}
    right = {(d, i) for d, i in got if of[d][1] == i}
    assert got == right
    share = {every: sum(of[d][0] == every for d, _ in right) / len(rows) for every in (5, 6, 7, 9, 12)}
    print(share)
    assert min(share.values()) >= 0.85 and share[7] >= 0.9
