"""One plan: terms, protected names, images, registered synthetic files and files that changed since the scan."""

import struct
import zlib

import pytest
from pyspark.sql import functions as F

from scrub.operators import content, names
from scrub.plans import workflows

KEY = b"k" * 16
FILES = "path string, content binary, size long, mtime_ns long, ocr_text string"


def png(comment):
    def chunk(kind, body):
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 1, 1, 8, 0, 0, 0, 0)) + chunk(b"tEXt", b"Comment\0" + comment) + chunk(b"IEND", b"")


def test_one_plan(spark):
    mail = "ana@" + "corp.net"
    big = (1 << 60) + 1
    rows = [
        ("a/term.py", b"x = 1\nsee Projeto \xc3\x81gua", 25, big, None), ("a/name.py", b"by Joana Prado Lima", 19, 2, None), ("a/clean.py", b"x = 1", 5, 3, None), ("a/.env", b"secret", 6, 4, None),
        ("a/pic.png", png(mail.encode()), 99, 5, "call " + mail), ("data/fake.txt", b"made up", 7, 6, None), ("a/late.py", b"y", 1, 7, None), ("a/gone.py", None, None, 8, None),
    ]
    files = spark.createDataFrame(rows, FILES)
    terms = spark.createDataFrame([("projeto agua", "sensitive_term")], "term string, category string")
    hashes, _ = names.build_protected(spark.createDataFrame([("Joana Prado Lima", "person")], "name string, kind string"), KEY)
    registry = files.filter("path = 'data/fake.txt'").select("path", F.sha2("content", 256).alias("sha256"))
    now = files.select("path", "size", F.when(F.col("path") == "a/late.py", 70).otherwise(F.col("mtime_ns")).alias("mtime_ns"))
    out = workflows.inventory(files, terms=terms, hashes=hashes, key=KEY, registry=registry, now=now)
    plan = {r.path: r for r in out["plan"].collect()}
    assert (plan["a/term.py"].status, plan["a/term.py"].total_findings, plan["a/term.py"].mtime_ns) == ("SANITIZE", 1, big)
    assert [(f.line, f.category, f.source) for f in plan["a/term.py"].findings] == [(2, "sensitive_term", "term")]
    assert plan["a/name.py"].status == "SANITIZE" and [f.category for f in plan["a/name.py"].findings] == ["protected_name"]
    assert plan["a/clean.py"].status == "COPY" and plan["a/clean.py"].total_findings == 0
    assert (plan["a/.env"].status, plan["a/.env"].size, plan["a/.env"].total_findings, plan["a/.env"].sha256) == ("EXCLUDE", 6, None, None)
    pic = plan["a/pic.png"]
    assert (pic.status, pic.review_kind, pic.ocr_chars) == ("REVIEW", "extension", 17) and {(f.category, f.source) for f in pic.findings} == {("email", "ocr"), ("email", "metadata"), ("image_metadata", "metadata")}
    assert (plan["data/fake.txt"].status, plan["data/fake.txt"].synthetic) == ("COPY", True) and plan["a/gone.py"].status == "REVIEW"
    copies = {r.path: (r.decision, r.reason) for r in out["copies"].collect()}
    assert copies["a/late.py"] == ("leave", "since the scan: changed") and copies["a/clean.py"] == ("copy", None)
    with pytest.raises(ValueError):
        workflows.extra_findings(files, hashes=hashes)


def test_company_endings_of_letters(spark):
    firms = spark.createDataFrame([("Acme Foguetes Transportes S.A.", "company"), ("Acme Beta MEI", "company")], "name string, kind string")
    assert {r.variant for r in names.build_variants(firms).collect()} == {"ACME FOGUETES TRANSPORTES", "ACME FOGUETES", "ACME BETA MEI", "ACME BETA"}
    assert "ACME FOGUETES TRANSPORTES" not in {r.variant for r in names.build_variants(firms, suffixes=("MEI",)).collect()}


def test_findings_count_for_all_rows_of_their_path(spark):
    mail, link = "ana@" + "corp.net", [False] * 8
    link[6] = True
    rows = [("x/.gitignore", b"clean"), ("x/.gitignore", mail.encode()), ("x/.gitignore", f"{mail}\n{mail}".encode()), ("y/.gitignore", b"clean"), ("y/.gitignore", b"clean too"), ("x/.gitignore", b"\0"), ("x/.gitignore", b"l"), (None, mail.encode())]
    files = spark.createDataFrame([(*r, s) for r, s in zip(rows, link, strict=True)], "path string, content binary, is_symlink boolean").repartition(3)
    plan = content.inventory(files)
    assert sorted((r.path or "", r.status, r.total_findings, r.personal_findings, len(r.findings)) for r in plan.collect() if r.status != "EXCLUDE") == [
        ("", "SANITIZE", 1, 1, 1), ("x/.gitignore", "REVIEW", 3, 3, 0), ("x/.gitignore", "SANITIZE", 3, 3, 0), ("x/.gitignore", "SANITIZE", 3, 3, 1), ("x/.gitignore", "SANITIZE", 3, 3, 2),
        ("y/.gitignore", "COPY", 0, 0, 0), ("y/.gitignore", "COPY", 0, 0, 0),
    ]
    assert [r.total_findings for r in plan.filter("status = 'EXCLUDE'").collect()] == [None]
    extra = spark.createDataFrame([("x/.gitignore", 1, "term", "s", "term")], "path string, line int, category string, snippet string, source string")
    more = content.inventory(files, extra=extra).filter("path = 'x/.gitignore' and status <> 'EXCLUDE'")
    assert {(r.total_findings, r.personal_findings) for r in more.collect()} == {(4, 3)}
    # Five personal values in one data file, though no row of it has as many.
    data = content.inventory(spark.createDataFrame([("d.txt", f"{mail}\n{mail}".encode()), ("d.txt", f"{mail}\n{mail}\n{mail}".encode())], "path string, content binary"))
    assert {(r.status, r.personal_findings) for r in data.collect()} == {("REVIEW", 5)}
