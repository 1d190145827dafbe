"""Shared helpers."""

import os
from types import SimpleNamespace

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.llm import common


def test_stored_tables_stand_in_the_shared_folder(spark):
    shared = spark.conf.get("spark.checkpoint.dir")
    rows = common.stored(spark.range(3).withColumn("a", F.array("id")))
    files = [f.removeprefix("file:").replace("///", "/") for f in rows.inputFiles()]
    assert all(f.startswith(f"{shared}/tessera/{spark.sparkContext.applicationId}/") for f in files) and rows.count() == 3
    assert common.stored(spark.range(0)).count() == 0
    kept = common.stored(spark.range(2))
    common.discard(rows)
    assert not any(map(os.path.exists, files)) and kept.count() == 2


def test_an_unset_folder_is_an_error_but_on_a_local_master():
    session = lambda master: SimpleNamespace(conf={}, sparkContext=SimpleNamespace(master=master, applicationId=f"id {master}"))
    for master in ("yarn", "spark://host:7077", "k8s://host", "local-cluster[2,1,1024]"):
        with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
            common.shared_dir(session(master))
    for master in ("local", "local[4]", "local[*]"):
        assert os.path.isdir(common.shared_dir(session(master))) and common.shared_dir(session(master)) == common.shared_dir(session(master))


def test_pieces_hold_all_rows_in_order_and_few_bytes(monkeypatch):
    monkeypatch.setattr(common, "PIECE_BYTES", 100)
    texts = ["a" * n for n in (0, 30, 60, 20, 500, 0, 0, 99, 1, 1)] + [None]
    batch = pa.RecordBatch.from_pydict({"k": list(range(11)), "text": pa.array(texts, pa.string())})
    found = list(common.pieces(iter([batch, batch.slice(0, 0), batch.slice(3, 2)])))
    assert [x for b in found for x in b.column("k").to_pylist()] == [*range(11), 3, 4]
    assert all(b.num_rows == 1 or sum(len(t or "") for t in b.column("text").to_pylist()) <= 100 for b in found) and len(found) == 7


def test_no_setting_of_the_session_is_changed(spark):
    before = {r[0]: r[1] for r in spark.sql("SET").collect()}
    common.map_arrow(spark.range(3), lambda batches: batches, "id long").count()
    assert {r[0]: r[1] for r in spark.sql("SET").collect()} == before


def test_pick_is_the_same_either_way(spark, monkeypatch):
    texts = spark.createDataFrame([(1, "a"), (2, "b"), (None, "c")], "id int, text string")
    ids = common.stored(spark.createDataFrame([(1,)], "id int"))
    for limit in (10, 0):
        monkeypatch.setattr(common, "BROADCAST_IDS", limit)
        assert [r.text for r in common.pick(texts, ids, ["id"], "left_semi").collect()] == ["a"]
        assert sorted(r.text for r in common.pick(texts, ids, ["id"], "left_anti").collect()) == ["b", "c"]


def test_keep_rows(spark):
    rows = spark.createDataFrame([(1, "a", [1]), (2, None, None), (3, "b", [])], "k int, text string, extra array<int>")
    kept = common.keep_rows(rows, lambda: lambda texts: [t != "a" for t in texts])
    assert kept.schema == rows.schema and sorted(r.k for r in kept.collect()) == [2, 3]
