"""Collocations against SQL and single phrases, periodic runs against every interval, languages against plain rankings."""

from __future__ import annotations

import hashlib
import math
import random
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest

from cellgrid.llm import periodic_runs, phrase_tries, rank_profiles
from cellgrid.llm.periodic_runs import Repeats
from cellgrid.llm.phrase_tries import Mining
from cellgrid.llm.rank_profiles import Profiles


def docs_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string")


# Collocations


def plain_collocations(rows, mining):
    """Every phrase at every place, in plain loops."""
    import re

    f, n = Counter(), Counter()
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    for _, text, lang in rows:
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", (text or "").translate(lower)):
            w = [x for x in re.split("[ \t]+", piece) if x]
            n[lang or "und"] += len(w)
            for m in range(1, mining.longest + 1):
                f.update((lang or "und", tuple(w[i : i + m])) for i in range(len(w) - m + 1))
    frequent = {p for p in f if f[p] >= mining.least}
    out = []
    for lang in n:
        rows = []
        for _, p in (x for x in frequent if x[0] == lang and len(x[1]) > 1):
            a = f[lang, p]
            around = [q for g, q in frequent if g == lang and len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q)))]
            if any(100 * f[lang, q] >= mining.percent * a for q in around):
                continue
            score, k = min((mining.scale * a // (f[lang, p[:k]] + f[lang, p[k:]]), k) for k in range(1, len(p)))
            rows.append((-score, -a, " ".join(p).encode(), f[lang, p[:k]], f[lang, p[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(rows)[: mining.top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, n[lang], -score))
    return sorted(out)


def found_collocations(docs, mining):
    return sorted(map(tuple, phrase_tries.collocations(docs, mining).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()))


def test_collocations_equal_plain_counts(spark):
    rng, words = random.Random(3), "a b c d The the É é x\x01 a\x01 \x00 日本".split(" ")
    rows = []
    for k in range(120):
        text = "".join(rng.choice(words) + rng.choice([" ", " ", "  ", "\t", ". ", ",", "\n", "! "]) for _ in range(rng.randrange(60)))
        rows.append((k, text, rng.choice(["en", "de", None, "und"])))
    rows += [(None, None, None), (1, "", "fr"), (2, " . ,", "it"), (3, "a a a a a a a a", "xx")]
    for mining in (Mining(least=2, gathered=64), Mining(longest=2, least=3, top=7), Mining(longest=5, least=2, percent=60, gathered=500)):
        assert found_collocations(docs_of(spark, rows), mining) == plain_collocations(rows, mining)


def test_left_parts_before_a_range(spark):
    """One word begins nearly all phrases, so that ranges start among them and lack what stands before."""
    rows = [(k, " ".join(f"the w{(k + j) % 40}" for j in range(12)), "en") for k in range(200)]
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        assert found_collocations(docs_of(spark, rows), Mining(least=5)) == plain_collocations(rows, Mining(least=5))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_texts_in_parts(spark, monkeypatch):
    """A text longer than a part is cut between pieces only."""
    text = (" ".join(f"w{k % 7}" for k in range(50)) + ". ") * 3 + " ".join("ab"[k % 2] for k in range(200))
    whole = phrase_tries._parts(text.encode())
    assert b"".join(whole) == text.encode()
    monkeypatch.setattr(phrase_tries, "PART", 100)
    parts = list(phrase_tries._parts(text.encode()))
    assert len(parts) > 3 and b"".join(parts) == text.encode() and all(p.endswith(b".") for p in parts[:-1])


def test_large_counts_stay_exact(spark):
    from pyspark.sql import functions as F

    big = 6_000_000_000_000
    every = spark.createDataFrame([("en", "a", big, 1, None), ("en", "b", big + 1, 1, None), ("en", "a b", big - 1, 2, big)], "lang string, phrase string, f bigint, m int, l1 bigint")
    cut = phrase_tries.with_right_parts(every, 2).select(F.expr("CAST(2000000 AS DECIMAL(10,0)) * CAST(f AS DECIMAL(20,0)) div (CAST(l[0] AS DECIMAL(20,0)) + CAST(r[0] AS DECIMAL(20,0)))").alias("score"))
    assert cut.first().score == 2_000_000 * (big - 1) // (2 * big + 1)


def test_collocations_equal_sql(spark, small):
    from cellgrid.llm.registry import oracle_sql, queries

    con = duckdb.connect()
    con.execute(f"create view documents as from '{small}/documents.parquet'")
    want = con.execute(oracle_sql()["op11_phrase_collocations"]).df()
    got = queries()["op11_phrase_collocations"](spark, small).toPandas()[list(want.columns)]
    assert len(want) and sorted(map(tuple, got.values.tolist())) == sorted(map(tuple, want.values.tolist()))


def test_collocations_of_edges(spark, edges, nothing):
    assert phrase_tries.collocations(nothing).count() == 0
    found = phrase_tries.collocations(edges, Mining(least=2))
    assert {r.lang for r in found.collect()} >= {"en", "es"} and found.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


# Periodic runs


def plain_runs(w, repeats):
    """Every interval that no neighbour extends, with its smallest period, word by word."""
    found = {}
    for q in range(1, len(w) // repeats.times + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            length = j - i + q
            if j > i and length >= max(repeats.least, repeats.times * q):
                found.setdefault((i, length), q)
            i = max(j, i + 1)
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2]))


def plain_row(doc_id, text, repeats):
    w = (text or "").encode().split()
    runs = plain_runs(w, repeats)
    best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=(None, None, None))
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    lines = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
    kept = b" ".join(x for i, x in enumerate(w) if i not in gone)
    milli = math.floor(1000 * best[1] / best[2]) if runs else None
    return (doc_id, len(runs), *best, milli, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept).hexdigest())


def repeating(rng):
    w = []
    for _ in range(rng.randrange(1, 6)):
        unit = [f"w{rng.randrange(6)}" for _ in range(rng.randrange(1, 15))]
        w += [f"x{rng.randrange(9)}" for _ in range(rng.randrange(20))] + (unit * rng.randrange(1, 40))[: rng.randrange(1, 150)]
    return " ".join(w)


def smallest_period(w):
    return next(q for q in range(1, len(w) + 1) if w[q:] == w[: len(w) - q])


def test_runs_are_maximal_and_of_smallest_period():
    rng = random.Random(7)
    for _ in range(60):
        w = repeating(rng).split()
        for repeats in (Repeats(), Repeats(least=6, times=2), Repeats(least=25, times=4, block=100)):
            ids = periodic_runs.numbered(w)
            runs = periodic_runs.distinct_runs(periodic_runs.scan(ids, 1, len(w), repeats))
            assert runs == plain_runs(w, repeats)
            for s, n, q in runs:
                assert smallest_period(w[s : s + n]) == q
                assert s == 0 or w[s - 1] != w[s - 1 + q]
                assert s + n == len(w) or w[s + n] != w[s + n - q]


def test_ranges_of_lags_find_the_same(spark, edges):
    rng = random.Random(5)
    docs = docs_of(spark, [(k, repeating(rng), "en") for k in range(25)] + [(None, repeating(rng), "en"), (3, repeating(rng), "en")]).select("doc_id", "text").unionByName(edges.select("doc_id", "text"))
    docs, long = docs.where("text IS NULL OR length(text) < 100000"), docs.where("length(text) >= 100000")
    key = lambda r: tuple((x is None, x) for x in r)
    want = sorted((plain_row(r.doc_id, r.text, Repeats()) for r in docs.collect()), key=key)
    for repeats in (Repeats(), Repeats(long_bytes=40, work=500)):
        assert sorted(map(tuple, periodic_runs.periodic_runs(docs, repeats).collect()), key=key) == want
    whole, ranges = (periodic_runs.periodic_runs(long, Repeats(long_bytes=n)).collect() for n in (1 << 30, 1 << 16))
    assert whole == ranges and len(whole) == 1  # too long for plain loops


def test_runs_of_nothing(spark, nothing):
    assert periodic_runs.periodic_runs(nothing).count() == 0 and periodic_runs.looped(nothing).count() == 0


def looped_words(doc_id, text):
    w = (text or "").encode().split()
    h, n = zlib.crc32(str(doc_id).encode()), len(w)
    g = h // 10
    if doc_id is None or h % 10 or not n:
        return w
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]


def test_planted_repeats(spark, edges):
    rng = random.Random(2)
    docs = docs_of(spark, [(k, " \n ".join(f"u{rng.randrange(99)}é" for _ in range(rng.randrange(90))), "en") for k in range(200)]).select("doc_id", "text").unionByName(edges.select("doc_id", "text"))
    got = sorted((-1 if r.doc_id is None else r.doc_id, (r.text or "").encode().split()) for r in periodic_runs.looped(docs).collect())
    assert got == sorted((-1 if r.doc_id is None else r.doc_id, looped_words(r.doc_id, r.text)) for r in docs.collect())


def test_runs_of_the_documents(spark, small):
    from cellgrid.llm.registry import queries

    got = {r.doc_id: tuple(r) for r in queries()["op12_periodic_runs"](spark, small).collect()}
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()
    assert len(got) == len(docs) and sum(r[1] > 0 for r in got.values()) > 10
    for r in docs[::7]:
        text = b" ".join(looped_words(r.doc_id, r.text)).decode()
        assert got[r.doc_id] == plain_row(r.doc_id, text, Repeats())


# Languages


def mixed(gram):
    h = 0
    for c in gram:
        h = (h ^ ord(c)) * 0x9E3779B97F4A7C15 % 2**64
        h ^= h >> 29
    return h


def grams(text, profiles):
    """Ranked n-grams of a text, as strings."""
    seen, words, word = Counter(), [], ""
    for c in text.lower() + " ":
        if c.isalpha():
            word += c
        elif word:
            words.append(word)
            word = ""
    for w in words:
        seen.update(f" {w} "[i : i + k] for k in range(1, profiles.longest + 1) for i in range(len(w) + 3 - k))
    seen.pop(" ", None)
    return [g for g, _ in sorted(seen.items(), key=lambda x: (-x[1], mixed(x[0])))][: profiles.ranks]


def test_languages_equal_plain_rankings(spark, small):
    profiles, docs = Profiles(ranks=150), spark.read.parquet(f"{small}/documents.parquet")
    rows = [r for r in docs.collect() if r.doc_id < 60]
    model = rank_profiles.learn(docs.where("doc_id < 60"), profiles)
    texts = {}
    for r in rows:
        texts[r.lang] = texts.get(r.lang, "") + " " + (r.text or "")
    places = {lang: {g: k for k, g in enumerate(grams(t, profiles))} for lang, t in texts.items()}
    got = {r.doc_id: (r.lang_pred, r.score) for r in rank_profiles.predict(docs.where("doc_id < 90"), model, profiles).collect()}
    assert len(got) == 90
    for r in docs.where("doc_id < 90").collect():
        own = grams(r.text or "", profiles)
        far = {lang: sum(abs(p[g] - k) if g in p else profiles.ranks for k, g in enumerate(own)) for lang, p in places.items()}
        lang = min(far, key=lambda x: (far[x], x))
        want = (lang, 1 - far[lang] / (profiles.ranks * len(own))) if own else ("und", 0.0)
        assert got[r.doc_id][0] == want[0] and abs(got[r.doc_id][1] - want[1]) < 1e-12


def test_held_out_accuracy(spark, small):
    from cellgrid.llm.registry import queries

    got = queries()["op13_language_id"](spark, small).toPandas()
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "lang", "text").toPandas()
    both = got.merge(docs, on="doc_id")
    assert len(got) == len(docs) and (both.held_out == [zlib.crc32(str(i).encode()) % 4 == 2 for i in both.doc_id]).all()
    told = both[both.held_out & both.text.str.contains("[a-z]", na=False)]
    assert (told.lang_pred == told.lang).mean() >= 0.97 and both.score.between(0, 1).all()


def test_learning_looks_at_the_fold_only(spark):
    rows = [(k, "der die das und nicht" if zlib.crc32(str(k).encode()) % 4 == 2 else "the of and not with", "xx" if zlib.crc32(str(k).encode()) % 4 == 2 else "en") for k in range(40)]
    docs = docs_of(spark, rows)
    assert rank_profiles.learn(docs.where(~rank_profiles.held_out())).langs == ["en"]


@pytest.mark.parametrize("text", [None, "", " 12 ½ ² _ !? \n", "１２٣"])
def test_texts_without_letters(spark, text):
    docs = docs_of(spark, [(1, "the of", "en"), (2, text, "en"), (None, "the", None)])
    model = rank_profiles.learn(docs)
    got = {r.doc_id: r for r in rank_profiles.predict(docs, model).collect()}
    assert got[2].lang_pred == "und" and got[2].score == 0 and got[1].lang_pred == got[None].lang_pred == "en"


def test_languages_of_edges(spark, edges, nothing):
    model = rank_profiles.learn(edges)
    assert rank_profiles.predict(nothing, model).count() == 0 and rank_profiles.predict(edges, model).count() == edges.count()
    none = rank_profiles.learn(nothing)
    assert none.langs == [] and {r.lang_pred for r in rank_profiles.predict(edges, none).collect()} == {"und"}
    with pytest.raises(ValueError):
        rank_profiles.learn(edges, Profiles(languages=1))


def test_partial_counts_do_not_matter(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    a, b = rank_profiles.learn(docs), rank_profiles.learn(docs, Profiles(flush=50))
    assert a.langs == b.langs and all(np.array_equal(getattr(a, k), getattr(b, k)) for k in ("hashes", "starts", "owners", "places"))
