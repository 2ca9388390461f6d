import hashlib
import os

import pytest

from scrub.sources.files import list_files, read_content
from scrub.sources.sinks import write_tree

SCHEMA = "path string, content binary"


def test_a_tree_is_written_whole_and_read_back(spark, tmp_path):
    rows = [("a/b.txt", b"x"), ("a/.env", b"k=1"), ("c\\d.bin", bytes(3_000_000)), ("empty", b"")]
    root = str(tmp_path / "tree")
    said = {r.path: r for r in write_tree(spark.createDataFrame(rows, SCHEMA).repartition(3), root).collect()}
    assert {p: (r.size, r.sha256, r.problem) for p, r in said.items()} == {p: (len(c), hashlib.sha256(c).hexdigest(), None) for p, c in rows}
    listed = list_files(spark, "file:" + root)
    assert {(r.path, r.size) for r in listed.collect()} == {(p.replace("\\", "/"), len(c)) for p, c in rows}
    hashes = {r.path: r.sha256 for r in read_content(listed, root).collect()}
    assert hashes["a/.env"] is None and hashes["c/d.bin"] == hashlib.sha256(rows[2][1]).hexdigest()
    assert os.listdir(tmp_path) == ["tree"]  # nothing of the parts is left


def test_paths_that_leave_the_tree_and_missing_contents(spark, tmp_path):
    rows = [("../x", b"1"), ("/etc/x", b"2"), ("C:\\x", b"3"), ("a/../../x", b"4"), ("a//b", b"5"), (None, b"6"), ("", b"7"), ("ok", None), ("./y", b"8"), ("n\0", b"9"), ("fine", b"10")]
    said = write_tree(spark.createDataFrame(rows, SCHEMA), str(tmp_path / "a" / "tree")).collect()
    assert [r.path for r in said if r.problem is None] == ["fine"] and len(said) == len(rows)
    assert all(r.size is None and r.sha256 is None for r in said if r.problem)
    assert {f for _, _, names in os.walk(tmp_path) for f in names} == {"fine"}


def test_a_tree_overwrites_nothing(spark, tmp_path):
    one = spark.createDataFrame([("x", b"1")], SCHEMA)
    write_tree(one, str(tmp_path / "t"))
    with pytest.raises(FileExistsError):
        write_tree(one, str(tmp_path / "t"))
    with pytest.raises(ValueError):
        write_tree(spark.createDataFrame([("a\\x", b"1"), ("a/x", b"2")], SCHEMA), str(tmp_path / "u"))
    assert not (tmp_path / "u").exists()
    empty = write_tree(one.limit(0), str(tmp_path / "e"))
    assert empty.count() == 0


def test_a_file_where_another_needs_a_folder(spark, tmp_path):
    rows = spark.createDataFrame([("x", b"1"), ("x/y", b"2")], SCHEMA).coalesce(1)
    said = {r.path: r.problem for r in write_tree(rows, str(tmp_path / "t")).collect()}
    assert said["x"] is None and said["x/y"]


def test_every_query_with_its_sql():
    from scrub import source_queries

    assert set(source_queries.queries()) == set(source_queries.oracle_sql())
