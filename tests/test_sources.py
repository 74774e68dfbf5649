"""Readers and writers: character sets by file, the order of appended lines, versions of a table."""

import pytest

from tidemark.sources import tables as tb


def test_character_set_of_each_file(spark, tmp_path):
    folder = tmp_path / "mixed folder"
    folder.mkdir()
    (folder / "a.csv").write_bytes("id,name\n1,의자\n2,\"책상, 큰\"\n".encode())
    (folder / "b.csv").write_bytes("id,name\n3,의자\n4,책상\n".encode("cp949"))
    (folder / "c.csv").write_bytes(b"id,name\n5,chair\n")
    (folder / "d.csv").write_bytes("﻿id,name\n6,é\n".encode())
    got = {r["id"]: r["name"] for r in tb.read_csv(spark, str(folder), "id int, name string").collect()}
    assert got == {1: "의자", 2: "책상, 큰", 3: "의자", 4: "책상", 5: "chair", 6: "é"}
    for name, want in (("b.csv", {3: "의자", 4: "책상"}), ("c.csv", {5: "chair"})):
        assert {r["id"]: r["name"] for r in tb.read_csv(spark, str(folder / name), "id int, name string").collect()} == want
    (tmp_path / "empty.csv").write_bytes(b"")
    assert tb.read_csv(spark, str(tmp_path / "empty.csv"), "id int").count() == 0


def test_last_line_of_one_append_wins(spark, tmp_path):
    path, schema = str(tmp_path / "lines"), "id string, v int, note string"
    assert tb.append_jsonl(spark.createDataFrame([("a", 9, "x"), ("b", 1, None), ("a", 2, None)], schema).coalesce(1), path) == 1
    got = lambda: {r["id"]: (r["v"], r["note"]) for r in tb.reload_jsonl(spark, path, schema, "id").collect()}
    assert got() == {"a": (2, None), "b": (1, None)}  # smaller, but later
    assert tb.append_jsonl(spark.createDataFrame([(5, "b", 7, "y"), (4, "b", 8, "z")], "o int, " + schema), path, ["o"]) == 2
    assert got()["b"] == (7, "y")
    assert tb.compact_jsonl(spark, path, schema, "id") == 2
    assert got() == {"a": (2, None), "b": (7, "y")} and spark.read.text(path).count() == 2
    assert tb.append_jsonl(spark.createDataFrame([("a", 0, "")], schema), path) == 4 and got()["a"] == (0, "")


def test_failure_before_publishing(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    assert tb.publish_table(spark.range(3), path) == 3
    monkeypatch.setattr(tb, "_publish", lambda *a: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError):
        tb.publish_table(spark.range(7), path)
    monkeypatch.undo()
    assert tb.read_table(spark, path).count() == 3
    with pytest.raises(ValueError):
        tb.publish_table(spark.range(0), path)
    assert tb.publish_table(spark.range(5), path) == 5 and tb.read_table(spark, path).count() == 5


def test_two_writers_and_a_reader(spark, tmp_path, monkeypatch):
    """Both see the same version before; the table is one of theirs, whole, and a reader of the version before can go on."""
    path = str(tmp_path / "t")
    tb.publish_table(spark.range(3), path)
    reader, versions = tb.read_table(spark, path), tb._versions
    before = versions(spark, path)
    monkeypatch.setattr(tb, "_versions", lambda *a: before)
    tb.publish_table(spark.range(10), path)
    tb.publish_table(spark.range(20), path)
    monkeypatch.undo()
    assert tb.read_table(spark, path).count() in (10, 20) and reader.count() == 3
    tb.publish_table(spark.range(30), path)
    assert tb.read_table(spark, path).count() == 30
    with pytest.raises(FileNotFoundError):
        tb.read_table(spark, str(tmp_path / "none"))
