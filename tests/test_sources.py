"""File trees as a source, hashing dealt out by size, and versions of sidecar state."""

import hashlib
import random
import time

import pytest
from pyspark.sql import functions as F

from photolake.functions import hashing
from photolake.operators.ranks import running_sum
from photolake.sources import state
from photolake.sources.tree import folders, register_tree

NAMES = {"_DSC0001.jpg": 3, "a/b/x.HEIC": 5, ".h/x.jpg": 1, "a/.x.jpg": 1, "n.txt": 1, "a/b/c/d/deep.mov": 7, "a/.b/x.jpg": 1}
SEEN = {"_DSC0001.jpg": 3, "a/b/x.HEIC": 5, "a/b/c/d/deep.mov": 7}


def _write(root, names):
    for name, size in names.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_bytes(b"x" * size)


@pytest.mark.parametrize("depth", [0, 1, 2, 9])
def test_tree_is_listed(spark, tmp_path, depth):
    _write(tmp_path, NAMES)
    register_tree(spark)
    rows = spark.read.format("media_tree").option("root_id", 4).option("depth", depth).load(str(tmp_path)).collect()
    assert {r.relative_path: r.file_size for r in rows} == SEEN and len(rows) == len(SEEN)
    assert {r.root_id for r in rows} == {4} and all(abs(r.file_mtime - (tmp_path / r.relative_path).stat().st_mtime) < 1e-6 for r in rows)
    parts = folders(str(tmp_path), depth)
    assert len({(p.relative, p.below) for p in parts}) == len(parts) and not any(".h" in p.relative for p in parts)


def test_tree_streams_changes(spark, tmp_path):
    root, base = tmp_path / "root", tmp_path / "out"
    register_tree(spark)
    _write(root, NAMES)

    def run():
        stream = spark.readStream.format("media_tree").option("settle_ms", 0).load(str(root))
        step = lambda rows, n: rows.write.mode("overwrite").parquet(f"{base}/batch={n}")
        stream.writeStream.foreachBatch(step).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start().awaitTermination()
        return spark.read.option("basePath", str(base)).parquet(str(base)).groupBy("batch").agg(F.sort_array(F.collect_list("relative_path")).alias("p")).orderBy("batch").collect()

    assert [r.p for r in run()] == [sorted(SEEN)]
    time.sleep(0.05)
    _write(root, {"late.jpg": 2, "a/b/x.HEIC": 6, "skip.txt": 1})
    assert [r.p for r in run()][1:] == [["a/b/x.HEIC", "late.jpg"]]


def test_hashes_by_size(spark, tmp_path):
    r = random.Random(3)
    sizes = [r.randint(0, 300) for _ in range(300)] + [9000, 8000, 100_000]
    _write(tmp_path, {f"{i % 7}/f{i}.jpg": n for i, n in enumerate(sizes)})
    rows = [(str(tmp_path / f"{i % 7}/f{i}.jpg"), n) for i, n in enumerate(sizes)]
    paths = spark.createDataFrame([*rows, (str(tmp_path / "gone.jpg"), 5)], "abs_path string, file_size long").repartition(4)
    got = {x.abs_path: (x.sha256, x.error) for x in hashing.hash_by_size(paths, 6, chunk=64).collect()}
    assert got == {p: (hashlib.sha256(b"x" * n).hexdigest(), None) for p, n in rows} | {str(tmp_path / "gone.jpg"): (None, "FileNotFoundError")}


@pytest.mark.parametrize("sizes", [[10] * 1000, [1] * 50 + [900, 800, 700, 650, 600, 20, 20], [5], [0, 0, 0], list(range(400))])
def test_tasks_get_like_shares(spark, sizes):
    """No task has more than 1.5 times the mean, unless one file alone has."""
    tasks = 6
    paths = spark.createDataFrame([(f"p{i}", n) for i, n in enumerate(sizes)], "abs_path string, file_size long")
    rows = hashing.share_out(paths, tasks).collect()
    assert sorted(x.abs_path for x in rows) == sorted(f"p{i}" for i in range(len(sizes))) and all(0 <= x.task < tasks for x in rows)
    load = [0] * tasks
    for x in rows:
        load[x.task] += x.file_size
    assert max(load) <= max(1.5 * sum(load) / tasks, max(max(sizes), 1)) + 1


def test_running_sum(spark):
    rows = [(i, (i * 7) % 5) for i in range(200)]
    got = {x.i: x.s for x in running_sum(spark.createDataFrame(rows, "i int, v long").repartition(5), ["i"], "v", "s").collect()}
    assert got == {i: sum(v for _, v in rows[:i]) for i, _ in rows}


def _docs(spark, n, most=3):
    states = spark.createDataFrame([("k", None), ("l", None)], "account string, cursor timestamp")
    named = spark.createDataFrame([("k", f"r{i}", "rejected") for i in range(n)], "account string, remote_id string, status string")
    got = spark.createDataFrame([("k", f"d{i}", f"selected/{i}.jpg") for i in range(2)], "account string, remote_id string, relative_path string")
    return state.account_documents(states, named, got, most)


def test_versions_switch_at_once(spark, tmp_path, monkeypatch):
    base = str(tmp_path / "states")
    entries = lambda: state.read_account_states(spark, base)[1].count()
    state.write_states(_docs(spark, 10), base)
    assert entries() == 10
    old = state.read_account_states(spark, base)[1]
    with monkeypatch.context() as m:
        m.setattr(state, "switch", lambda *a: 1 / 0)
        with pytest.raises(ZeroDivisionError):  # written, but broken off before the switch
            state.write_states(_docs(spark, 20), base)
    assert entries() == 10
    state.write_states(_docs(spark, 20), base)
    assert entries() == 20 and old.count() == 10  # who reads the old version still can
    state.drop_versions(spark, base)
    assert entries() == 20 and len(list((tmp_path / "states").glob("version-*"))) == 1


def test_large_accounts_are_several_documents(spark, tmp_path):
    docs = _docs(spark, 10).collect()
    assert sorted((r.account, len(r.decisions), len(r.downloaded)) for r in docs) == [("k", 1, 0), ("k", 3, 0), ("k", 3, 0), ("k", 3, 2), ("l", 0, 0)]
    base = state.write_states(_docs(spark, 10), str(tmp_path / "s"))
    states, named, got, bad = state.read_account_states(spark, base)
    assert sorted(r.account for r in states.collect()) == ["k", "l"] and named.count() == 10 and got.count() == 2 and bad.count() == 0


def test_quarantine_is_kept_with_its_version(spark, tmp_path):
    plain = tmp_path / "plain"
    plain.mkdir()
    (plain / "bad.json").write_text("{broken")
    (plain / "good.json").write_text('{\n "account": "k",\n "decisions": {"r1": "rejected"}\n}\n')
    states, named, got, bad = state.read_account_states(spark, str(plain))
    base = state.write_states(state.account_documents(states, named, got), str(tmp_path / "out"), bad)
    kept = state.read_quarantine(spark, base).collect()
    assert [r._corrupt for r in kept] == ["{broken"] and kept[0].version == state.current(spark, base).rpartition("/")[2]
    assert state.read_account_states(spark, base)[1].count() == 1 and state.read_quarantine(spark, str(plain)).count() == 0
