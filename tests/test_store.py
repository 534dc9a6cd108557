"""Copy-on-write upserts: what is merged, which files stay, and what readers see."""

import glob
import os

import pytest

from ledgerloom.operators import masking
from ledgerloom.sources.store import Store

SCHEMA = "id long, name string, n int"


def frame(spark, rows, schema=SCHEMA):
    return spark.createDataFrame(rows, schema)


def files(path):
    return set(glob.glob(f"{path}/data/*/*/*.parquet"))


def read(store):
    return {r.id: tuple(r)[1:] for r in store.read().collect()}


def test_merges_by_key(spark, tmp_path):
    s = Store(spark, str(tmp_path / "s"))
    with pytest.raises(ValueError):
        s.read()
    s.create(frame(spark, [(i, f"a{i}", i) for i in range(20)]), buckets=8)
    with pytest.raises(ValueError):
        s.create(frame(spark, []))
    before = s.read()
    assert s.upsert(frame(spark, [(3, "x", None), (40, None, 7)])) in (1, 2)
    want = {i: (f"a{i}", i) for i in range(20)} | {3: ("x", 3), 40: (None, 7)}
    assert read(s) == want
    assert {r.id: tuple(r)[1:] for r in before.collect()} == {i: (f"a{i}", i) for i in range(20)}  # an earlier reader still has its files
    s.upsert(frame(spark, [(50,)], "id long"), {"name": "new", "n": -1})
    assert read(s)[50] == ("new", -1)


def test_only_touched_buckets_are_rewritten(spark, tmp_path):
    path = str(tmp_path / "s")
    s = Store(spark, path)
    s.create(frame(spark, [(i, "a", i) for i in range(200)]), buckets=16)
    old = files(path)
    seen = {f: os.stat(f).st_mtime_ns for f in old}
    assert s.upsert(frame(spark, [(5, "b", None)])) == 1
    new = files(path) - old
    assert len(new) == 1 and {f: os.stat(f).st_mtime_ns for f in old} == seen
    assert s.upsert(frame(spark, [(5, "b", 5), (6, None, 6)])) == 0 and files(path) == old | new  # changes nothing
    assert s.upsert(frame(spark, [(5, "c", 5), (6, None, 6)])) == 1
    assert read(s) == {i: ("a", i) for i in range(200)} | {5: ("c", 5)}


def test_readers_see_a_commit_whole_or_not_at_all(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "s")
    s = Store(spark, path)
    s.create(frame(spark, [(i, "a", i) for i in range(50)]), buckets=4)
    last = s._last()
    s._commit(frame(spark, [(i, "b", i) for i in range(50)]), last, "id", 4, [0, 1, 2, 3])
    with pytest.raises(RuntimeError, match="another writer"):
        monkeypatch.setattr(s, "_last", lambda: type(last)(9, 4, "id", {}, {}))
        s._commit(frame(spark, [(i, "c", i) for i in range(50)]), Store(spark, path)._last(), "id", 4, [0, 1, 2, 3])
    assert {v[0] for v in read(Store(spark, path)).values()} == {"b"}  # files were written, the log row was not


def test_odd_tables(spark, tmp_path):
    s = Store(spark, str(tmp_path / "s"))
    s.create(frame(spark, []))
    assert s.read().collect() == [] if s._last().files else True
    assert s.upsert(frame(spark, [(1, "a", 1)])) == 1 and read(s) == {1: ("a", 1)}
    assert s.upsert(frame(spark, [])) == 0
    for bad in ([(2, "a", 1), (2, "b", 1)], [(None, "a", 1)]):
        with pytest.raises(Exception, match="null or stands twice"):
            s.upsert(frame(spark, bad))
    with pytest.raises(ValueError):
        Store(spark, str(tmp_path / "t")).create(frame(spark, [(1, 2)], "id long, bucket int"))


def test_flags_and_labels_are_written_back(spark, tmp_path):
    s = Store(spark, str(tmp_path / "s"))
    s.create(frame(spark, [(1,), (2,), (3,)], "id long"))
    masked = frame(spark, [(1, 1), (2, 0), (9, 1)], "id long, pu_label int")
    masking.write_back(s, masked, frame(spark, [(1, 0), (2, 1), (9, 2)], "id long, split int"))
    assert {r.id: (r.is_train, r.is_val, r.is_test, r.pu_label) for r in s.read().collect()} == {1: (1, 0, 0, 1), 2: (0, 1, 0, 0), 3: (0, 0, 0, 0), 9: (0, 0, 1, 1)}
