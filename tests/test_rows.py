"""Row changes against a dict, and which files they touch; refreshed roll-ups against rebuilt ones."""

from __future__ import annotations

import random
from pathlib import Path

import pytest

from cellgrid.sources import rows as R
from cellgrid.streaming import cells as S

KIND = "id string, tid bigint, value_num double, note string"


def files_of(path):
    return {str(f): f.stat().st_mtime_ns for f in Path(path).rglob("*.parquet")}


def held(table):
    return {(r.id, r.tid): (r.value_num, r.note) for r in table.read().collect()}


def test_changes_equal_a_dict(spark, tmp_path):
    rng = random.Random(3)
    want = {(f"k{k}", k % 5): (float(k), None if k % 7 == 0 else f"n{k}") for k in range(300)}
    frame = lambda d: spark.createDataFrame([(*k, *v) for k, v in d.items()], KIND)
    table = R.Rows(spark, str(tmp_path / "t"), ("id", "tid"), parts=8).create(frame(want))
    with pytest.raises(ValueError):
        table.create(frame(want))
    for turn in range(4):
        new = {(f"k{rng.randrange(360)}", rng.randrange(5)): (float(rng.randrange(99)), None) for _ in range(12)}
        table.put(frame(new).select("note", "value_num", "tid", "id"))
        want |= new
        gone = rng.sample(sorted(want), 9)
        table.remove(spark.createDataFrame([*gone, gone[0], ("none", 1)], "id string, tid bigint"))
        for k in gone:
            del want[k]
        some = rng.choice(sorted(want))
        table.update(some, {"note": f"turn {turn}"})
        want[some] = (want[some][0], f"turn {turn}")
        assert held(table) == want
        row = table.get(some).collect()
        assert len(row) == 1 and row[0].note == f"turn {turn}" and table.get(gone[0]).count() == 0
    table.update(("none", 1), {"note": "x"})
    empty = R.Rows(spark, str(tmp_path / "e"), ("id", "tid"))
    with pytest.raises(ValueError):
        empty.read()
    assert held(empty.create(frame(want).limit(0))) == {} and empty.get(some).count() == 0
    empty.put(frame({("a", 1): (2.0, None)}))
    assert held(empty) == {("a", 1): (2.0, None)}
    with pytest.raises(ValueError):
        table.update(some, {"tid": 3})
    before = S.current(spark, table.path)[1]
    done = table.compact(most=3)
    after = S.current(spark, table.path)[1]
    assert held(table) == want and done and all(len(f) <= 4 for f in after.values()) and all(after[p] == before[p] for p in before if p not in done)
    S.remove_old(spark, table.path)
    assert held(table) == want and len(list(Path(table.path, "versions").glob("*.json"))) == 1


def test_an_update_touches_one_part(spark, tmp_path):
    table = R.Rows(spark, str(tmp_path / "t"), ("id", "tid"), parts=16).create(spark.range(400).selectExpr("cast(id as string) id", "id % 3 tid", "cast(id as double) value_num", "'' note"))
    old = files_of(table.path)
    table.update(("77", 2), {"value_num": -1})
    new = files_of(table.path)
    assert {f: new[f] for f in old} == old and len(new) == len(old) + 1
    read = table.get(("77", 2)).inputFiles()
    assert len(read) == 2 and len({f.split("_part=")[1].split("/")[0] for f in read}) == 1


def test_a_writer_that_dies_changes_nothing(spark, tmp_path, monkeypatch):
    table = R.Rows(spark, str(tmp_path / "t"), ("id", "tid"), parts=4).create(spark.createDataFrame([("a", 1, 1.0, "x")], KIND))

    def dies(*_):
        raise OSError("gone")

    with monkeypatch.context() as m:
        m.setattr(R, "name_version", dies)
        with pytest.raises(OSError):
            table.put(spark.createDataFrame([("a", 1, 2.0, "y"), ("b", 1, 2.0, "y")], KIND))
    assert held(table) == {("a", 1): (1.0, "x")}
    for k in range(S.VERSIONS + 3):
        S.name_version(spark, table.path, 100 + k, S.current(spark, table.path)[1])
    assert len(list(Path(table.path, "versions").glob("*.json"))) == S.VERSIONS and held(table) == {("a", 1): (1.0, "x")}


def test_refreshed_summaries_equal_rebuilt_ones(spark, tmp_path):
    rng = random.Random(8)
    frame = lambda d: spark.createDataFrame([(f"g{c % 12}", "k", c, v) for c, v in d.items()], "dggid string, attr_key string, cell bigint, value_num double")
    have = {c: float(rng.randrange(20)) for c in range(120)}
    groups = ("dggid", "attr_key")
    copy = R.Rows(spark, str(tmp_path / "c"), groups, parts=4).create(R.summary(frame(have), groups))
    for turn in range(3):
        old = {c: have[c] for c in rng.sample(sorted(have), 25)} | ({c: have[c] for c in have if c % 12 == 4} if turn == 1 else {})
        new = {c: float(rng.randrange(-5, 25)) for c in rng.sample(sorted(old), 8)} | {1000 * (turn + 1) + k: float(k) for k in range(6)} | {5000 + turn: None}
        have = {c: v for c, v in have.items() if c not in old} | new
        R.refresh(copy, frame(old), frame(new), frame(have))
        key = lambda r: (r.dggid, r.attr_key, r.n, r.total, r.least, r.most)
        assert sorted(map(key, copy.read().collect())) == sorted(map(key, R.summary(frame(have), groups).collect()))
