import os
import struct
import zlib

import pytest
from pyspark.sql import functions as F

from scrub.operators import content, media, paths, snapshots
from scrub.operators.redaction import clean_notebook
from scrub.plans import workflows
from scrub.sources import files, lists, sinks

MAIL = "ana@" + "corp.net"


def test_name_rules(spark):
    cases = {
        ".env": "EXCLUDE", ".env.local": "EXCLUDE", "a/prod.env": "EXCLUDE", ".env.example": None, "x/id_rsa": "EXCLUDE", "client_secret_1.json": "EXCLUDE", "secrets.yaml": "EXCLUDE", "~$a.txt": "EXCLUDE", "b.py~": "EXCLUDE",
        "k.PEM": "EXCLUDE", "a.tar.gz": "EXCLUDE", "a.png": "REVIEW", "q.sql": "REVIEW", "Data/x.py": "REVIEW", "src/my_token.py": "REVIEW", "src/sessão.py": "REVIEW", "src/a.py": None, "dir\\Uploads\\a.py": "REVIEW", "noext": None, "trailing.": None,
    }
    rows = spark.createDataFrame([(p,) for p in cases], "p string").select("p", paths.classify_name(F.col("p"))["status"].alias("s")).collect()
    assert {r.p: r.s for r in rows} == cases


def test_extensions(spark):
    cases = {".env": "", "a.tar.gz": ".gz", "x.": "", "A.PY": ".py", "d.x/b": ""}
    rows = spark.createDataFrame([(p,) for p in cases], "p string").select("p", paths.path_parts(F.col("p"))["ext"].alias("e")).collect()
    assert {r.p: r.e for r in rows} == cases


def test_topmost_ignored_dir(spark):
    kept, dirs = paths.prune_ignored_dirs(spark.createDataFrame([("a/Node_Modules/x/.git/b",), ("a/c",), ("build",)], "path string"))
    assert sorted(r.path for r in kept.collect()) == ["a/c", "build"] and [(r.dir, r.files) for r in dirs.collect()] == [("a/Node_Modules", 1)]


def test_inventory(spark):
    rows = [
        ("src/a.py", b"x = 1"), ("src/b.py", f"m = {MAIL}".encode()), ("k.pem", b"zz"), ("n.ipynb", b"{}"), ("big.txt", b"a" * 160_000), ("bin.dat", b"a\0b"), ("huge.py", b"a" * ((2 << 20) + 1)),
        ("p.txt", "\n".join([MAIL] * 5).encode()), ("gone.py", None), ("bad.py", b"\xff\xfe"), ("q.sql", MAIL.encode()), ("empty.py", b""),
    ]
    plan = {r.path: r for r in content.inventory(spark.createDataFrame([(p, None if c is None else bytearray(c)) for p, c in rows], "path string, content binary")).collect()}
    assert {p: r.status for p, r in plan.items()} == {
        "src/a.py": "COPY", "src/b.py": "SANITIZE", "k.pem": "EXCLUDE", "n.ipynb": "SANITIZE", "big.txt": "REVIEW", "bin.dat": "REVIEW", "huge.py": "REVIEW", "p.txt": "REVIEW", "gone.py": "REVIEW", "bad.py": "COPY", "q.sql": "REVIEW", "empty.py": "COPY",
    }
    assert plan["k.pem"].sha256 is None and plan["k.pem"].total_findings is None and plan["bin.dat"].total_findings is None and plan["q.sql"].total_findings == 1 and plan["src/a.py"].total_findings == 0


def test_tree_with_hidden_files_and_links(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / ".git").mkdir()
    (tmp_path / "src/_a.py").write_text("x")
    (tmp_path / ".env").write_text("y")
    (tmp_path / ".git/config").write_text("z")
    os.symlink(tmp_path / ".env", tmp_path / "src/link")
    listed = {r.path: r for r in files.list_files(spark, str(tmp_path)).collect()}
    assert set(listed) == {"src/_a.py", ".env", ".git/config", "src/link"} and listed["src/link"].is_symlink
    tree, dirs = files.read_tree(spark, str(tmp_path))
    got = {r.path: r.content for r in tree.collect()}
    assert got[".env"] is None and bytes(got["src/_a.py"]) == b"x" and got["src/link"] is None
    assert [r.dir for r in dirs.collect()] == [".git"]
    assert {r.path: r.status for r in content.inventory(tree).collect()} == {"src/_a.py": "COPY", ".env": "EXCLUDE", "src/link": "EXCLUDE"}


def test_list_files_readers(spark, tmp_path):
    (tmp_path / "t.txt").write_text("# c\n Ana \nAna\n\n # d\nb\n")
    assert sorted(r.term for r in lists.read_terms(spark, str(tmp_path / "t.txt")).collect()) == ["Ana", "b"]
    assert sorted(r.name for r in lists.read_names_text(spark, str(tmp_path / "t.txt")).collect()) == ["# d", "Ana", "Ana", "b"]
    assert sorted(r.sequence for r in lists.read_allowlist(spark, str(tmp_path / "t.txt")).collect()) == ["ANA", "B"]
    (tmp_path / "r.json").write_text('{"records": [{"cellValuesByFieldId": {"f": " Acme "}}, {"cellValuesByFieldId": {}, "fields": {"f": "Beta"}}, {"fields": {"f": 7}}, {"fields": {"g": "x"}}]}')
    assert sorted(r.name for r in lists.read_names_records(spark, str(tmp_path / "r.json"), "f").collect()) == ["Acme", "Beta"]
    (tmp_path / "s.json").write_text('{"a\\\\b": "1", "c": "2"}')
    assert sorted(tuple(r) for r in lists.read_synthetic_registry(spark, str(tmp_path / "s.json")).collect()) == [("a/b", "1"), ("c", "2")]


def test_sinks_refuse(spark, tmp_path):
    one = spark.range(1)
    with pytest.raises(ValueError):
        sinks.write_plan(one, one, one, str(tmp_path / "a/b"), str(tmp_path))
    for a, b in (("/x", "/x"), ("/x/y", "/x"), ("/x", "/x/y/../z")):
        with pytest.raises(ValueError):
            sinks.refuse_overlap(a, b)
    sinks.refuse_overlap("/x", "/xy")
    out = str(tmp_path / "out")
    assert sinks.next_free_version(spark, out) == out
    sinks.write_plan(one, one, one, out, "/elsewhere")
    assert sinks.next_free_version(spark, out) == out + "-v2"
    with pytest.raises(Exception, match="(?i)exist"):
        sinks.write_plan(one, one, one, out, "/elsewhere")


def test_encryption_is_bound_to_list_key_and_bytes(spark):
    store = spark.createDataFrame([("people", "Ana")], "list string, value string")
    key, other = F.lit(b"k" * 32), F.lit(b"z" * 32)
    sealed = sinks.encrypt_terms(store, key)
    assert sinks.decrypt_terms(sealed, key).first().value == "Ana"
    assert sinks.decrypt_terms(sealed, other).first().value is None
    assert sinks.decrypt_terms(sealed.withColumn("list", F.lit("firms")), key).first().value is None
    tampered = sealed.withColumn("value", F.concat(F.expr("substring(value, 1, length(value) - 1)"), F.lit(b"\0")))
    assert sinks.decrypt_terms(tampered, key).first().value in (None,) or sealed.first().value[-1] == 0


def png(*chunks):
    def chunk(kind, body):
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    return media.PNG + b"".join(chunk(k, b) for k, b in [(b"IHDR", b"\0" * 13), *chunks, (b"IDAT", b"pixels"), (b"IEND", b"")])


def test_images(spark):
    jpeg = b"\xff\xd8" + b"\xff\xe1\x00\x0cExif\0\0abcd" + b"\xff\xee\x00\x04ad" + b"\xff\xdb\x00\x04qq" + b"\xff\xda\x00\x02scan\xff\xd9"
    rows = [("t.png", png((b"tEXt", b"Author\0" + MAIL.encode()))), ("z.png", png((b"zTXt", b"Note\0\0" + zlib.compress(MAIL.encode())))), ("c.png", png()), ("j.jpg", jpeg), ("b.bmp", b"BM"), ("g.gif", b"GIF89a"), ("n.png", None)]
    df = spark.createDataFrame([(p, None if c is None else bytearray(c)) for p, c in rows], "path string, content binary")
    kinds = {r.path: r.kinds for r in media.image_metadata(df).collect()}
    assert kinds == {"t.png": ["tEXt"], "z.png": ["zTXt"], "c.png": [], "j.jpg": ["APP1"], "b.bmp": ["not verifiable"], "g.gif": ["not verifiable"], "n.png": ["not verifiable"]}
    found = {r.path: [f.category for f in r.findings] for r in media.scan_image_metadata(df).collect()}
    assert found["t.png"] == ["image_metadata", "email"] == found["z.png"] and found["b.bmp"] == [] and found["c.png"] == []
    clean = {r.path: r for r in media.strip_image_metadata(df).collect()}
    assert bytes(clean["t.png"].content) == png() == bytes(clean["z.png"].content) and bytes(clean["j.jpg"].content) == jpeg[:2] + jpeg[16:] and not clean["g.gif"].supported
    ocr = spark.createDataFrame([(None,), (f" {MAIL} ",)], "t string").select(media.scan_ocr_text(F.col("t")).alias("o")).select("o.*").collect()
    assert ocr[0].reason and ocr[0].ocr_chars is None and ocr[1].ocr_chars == len(MAIL) and len(ocr[1].findings) == 1


def test_notebook(spark):
    book = '{"cells": [{"cell_type": "code", "outputs": [1], "execution_count": 2, "metadata": {"execution": 1, "a": 2}}, {"cell_type": "markdown"}]}'
    rows = spark.createDataFrame([(book,), ("not json",), (None,), ("[1]",)], "t string").select(clean_notebook("t").alias("t")).collect()
    assert '"outputs": [], "execution_count": null, "metadata": {"a": 2}' in rows[0].t and rows[1].t == "not json" and rows[2].t is None and rows[3].t == "[1]"


def test_copy_plan_and_release(spark):
    plan = spark.createDataFrame([("a", "COPY", 0), ("b", "SANITIZE", 2), ("c", "REVIEW", 1), ("d", "REVIEW", None), ("e", "EXCLUDE", None)], "path string, status string, total_findings int")
    path = lambda *p: spark.createDataFrame([(x,) for x in p], "path string")
    got = {r.path: (r.decision, r.to_sanitize) for r in snapshots.copy_plan(plan, path("c"), path("a")).collect()}
    assert got == {"a": ("leave", False), "b": ("copy", True), "c": ("copy", True), "d": ("leave", False), "e": ("leave", False)}
    with pytest.raises(ValueError):
        snapshots.copy_plan(plan, path("e"), path("a"))
    rel = plan.select("path", snapshots.is_releasable(F.col("status"), F.col("total_findings"), F.lit(True), F.lit("h"), F.lit(".py"), F.lit(None)).alias("r")).collect()
    assert {r.path: r.r for r in rel} == {"a": True, "b": False, "c": False, "d": True, "e": False}


def test_snapshots_name_new_files_only_if_asked(spark):
    a = spark.createDataFrame([("x", 1, 1), ("y", 1, 1), ("z", 1, None)], "path string, size long, mtime_ns long")
    b = spark.createDataFrame([("y", 1, 2), ("n", 1, 1)], "path string, size long, mtime_ns long")
    assert sorted(tuple(r) for r in snapshots.diff_snapshot(a, b).collect()) == [("x", "missing"), ("y", "changed")]
    assert ("n", "new") in {tuple(r) for r in snapshots.diff_snapshot(a, b, report_new=True).collect()}


def test_redact_and_verify(spark):
    df = spark.createDataFrame([("a.py", f"m = '{MAIL}'"), ("k.pem", "x")], "path string, text string")
    got = {r.path: (r.total_findings, r.releasable) for r in workflows.redact_and_verify(df, df.limit(0)).collect()}
    assert got == {"a.py": (0, True), "k.pem": (None, False)}
