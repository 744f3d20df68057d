"""Recording files: how many tasks read them, and what is written."""

import pytest
from pyspark.sql import functions as F

from eventloom.plans.recordings import header, sample_file, write_files
from eventloom.sources import edf


def rows_of(reader):
    return [tuple(x) for p in reader.partitions() for b in reader.read(p) for x in zip(b["rec_id"].to_pylist(), b["chan"].to_pylist(), b["block"].to_pylist())]


def test_small_files_share_tasks_and_are_not_opened_to_plan(tmp_path, monkeypatch):
    data = sample_file(["A1", "A2"], [[[k] * 4, [0] * 4] for k in range(30)], 4)
    for k in range(200):
        (tmp_path / f"r{k:03}.edf").write_bytes(data)
    reader = edf.FilteringReader({"path": str(tmp_path), "records": "7"})
    with monkeypatch.context() as m:
        m.setattr(edf, "read_header", lambda f: pytest.fail("a small file was opened to plan"))
        assert len(reader.partitions()) == 4  # 64 files each
    assert sorted(rows_of(reader)) == [(f"r{k:03}", c, b) for k in range(200) for c in (0, 1) for b in range(30)]
    assert list(reader.pushFilters([edf.GreaterThanOrEqual(("block",), 6), edf.LessThan(("block",), 9), edf.EqualTo(("chan",), 1)])) == []
    assert sorted(rows_of(reader)) == [(f"r{k:03}", 1, b) for k in range(200) for b in (6, 7, 8)]


def test_large_files_are_parted_by_records(tmp_path, monkeypatch):
    (tmp_path / "one.edf").write_bytes(sample_file(["A1"], [[[k] * 4] for k in range(30)], 4))
    (tmp_path / "two.edf").write_bytes(sample_file(["A1"], [[[k] * 4] for k in range(3)], 4))
    monkeypatch.setattr(edf, "PART_BYTES", len((tmp_path / "two.edf").read_bytes()))
    reader = edf.FilteringReader({"path": str(tmp_path), "records": "7"})
    assert sorted(len(list(reader.read(p))) and len(p.pieces) for p in reader.partitions()) == [1] * 6
    assert sorted(rows_of(reader)) == [("one", 0, b) for b in range(30)] + [("two", 0, b) for b in range(3)]
    assert list(reader.pushFilters([edf.In(("block",), (1, 29))])) == []
    assert sorted(rows_of(reader)) == [("one", 0, 1), ("one", 0, 29), ("two", 0, 1)]


def test_written_files_equal_packed_ones(spark, tmp_path):
    records = [[[k, -32768, 32767], [7 * k, 0, 1]] for k in range(5)]
    df = spark.createDataFrame([("a", ["x", "y"], records), ("b", ["z"], [[[1, 2, 3]]]), ("c", ["z"], [])], "rec_id string, names array<string>, records array<array<array<int>>>")
    sizes = {r.rec_id: r.bytes for r in write_files(df, str(tmp_path / "out"), 3).collect()}
    want = {"a": sample_file(["x", "y"], records, 3), "b": sample_file(["z"], [[[1, 2, 3]]], 3), "c": header(["z"], 0, 3)}
    assert {k: (tmp_path / "out" / f"{k}.edf").read_bytes() for k in want} == want and sizes == {k: len(v) for k, v in want.items()}
    with pytest.raises(Exception, match="beyond 16 bits"):
        write_files(df.withColumn("records", F.transform("records", lambda r: F.transform(r, lambda c: F.transform(c, lambda v: v + 1)))), str(tmp_path / "no"), 3).collect()
