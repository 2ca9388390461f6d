"""What plans must not show, and what must stay bounded: keys, terms, bounded groups, one pass over texts, long files, deep folders, streams."""

import contextlib
import hashlib
import hmac
import io
import os
import random
import re
import tracemalloc
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from scrub.functions.masking import hmac_sha256_20
from scrub.operators import audits, bounded, content, names, snapshots, terms
from scrub.plans import workflows
from scrub.sources import files, sinks
from scrub.streaming import scan as streams

KEY = bytes(range(100, 132))
MAIL = "ana@" + "corp.net"


def plan_of(df):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain(True)
    return out.getvalue()


def test_neither_keys_nor_terms_are_in_plans(spark):
    df = spark.createDataFrame([(1, "see Projeto Ágata and Joana Prado Lima"), (2, None)], "id int, text string").repartition(2)
    people = spark.createDataFrame([("Joana Prado Lima", "person")], "name string, kind string")
    listed = spark.createDataFrame([("projeto agata", "sensitive_term")], "term string, category string")
    hashes, _ = names.build_protected(people, KEY)
    hashed = df.select(hmac_sha256_20(F.col("text"), KEY).alias("h"))
    assert {r.h for r in hashed.collect()} == {hmac.new(KEY, b"see Projeto \xc3\x81gata and Joana Prado Lima", hashlib.sha256).hexdigest()[:20], None}
    pads = [bytes(b ^ x for b in KEY.ljust(64, b"\0")) for x in (0, 0x36, 0x5C)]
    plans = "".join(map(plan_of, (hashed, hashes, names.scan_protected(df, hashes, KEY), names.scan_protected(df, hashes, KEY, spark.createDataFrame([("A B",)], "sequence string")), terms.scan_terms(df, listed, key=KEY)))).lower()
    for secret in (KEY, *pads):
        assert not any(secret[i : i + 6].hex() in plans or repr(secret[i : i + 6])[2:-1].lower() in plans for i in range(0, 26))
    assert "agata" not in plans and "ágata" not in plans
    assert [(r.line, r.category) for r in terms.scan_terms(df, listed, key=KEY).collect()] == [(1, "sensitive_term")]
    with pytest.raises(ValueError):
        hmac_sha256_20(F.col("text"), b"")
    with pytest.raises(ValueError):
        hmac_sha256_20(F.col("text"), b"x" * 65)


def plain_terms(texts, listed):
    """(id, line, term) by an expression for each term on each folded line."""
    out = []
    for i, text in texts:
        lines = re.split(r"\r\n|[\n\x0b\x0c\r\x1c\x1d\x1e\x85  ]", text or "")
        for n, line in enumerate(lines, 1):
            folded = terms.fold(line[:5000])
            out += [(i, n, t) for t in listed if re.search(rf"(?i)(?<![A-Za-z0-9]){re.escape(terms.fold(t))}(?![A-Za-z0-9])", folded)]
    return sorted(out)


@pytest.mark.parametrize("at_once", [terms.TERMS_AT_ONCE, 7])
def test_terms_equal_an_expression_for_each(spark, monkeypatch, at_once):
    monkeypatch.setattr(terms, "TERMS_AT_ONCE", at_once)
    rng = random.Random(8)
    letters = "aábBcç_1. -ﬁ"
    listed = sorted({"".join(rng.choices(letters, k=rng.randint(1, 4))).strip() for _ in range(90)} - {""}) + ["ab", "abc", "c++", "\\E", "Ж"]
    listed = sorted(set(listed))
    texts = [(i, "".join(rng.choices(letters + "\n Жж\\E+", k=rng.randint(0, 120)))) for i in range(60)] + [(100, None), (101, ""), (102, "x" * 4999 + " ab"), (103, "x" * 4996 + " ab c")]
    df = spark.createDataFrame(texts, "id int, text string").repartition(3)
    by_hash = {hmac.new(KEY, t.encode(), hashlib.sha256).hexdigest()[:20]: t for t in listed}
    found = terms.scan_terms(df, spark.createDataFrame([(t, "sensitive_term") for t in listed], "term string, category string"), key=KEY)
    assert sorted((r.id, r.line, by_hash[r.term_key]) for r in found.collect()) == plain_terms(texts, listed)
    assert "hashpartitioning" not in plan_of(found)


def test_automatic_terms(spark):
    got = sorted(tuple(r) for r in terms.automatic_terms(spark, ("joana", "pc", " host-1 ", "joana")).collect())
    assert got == [("host-1", "sensitive_term"), ("joana", "sensitive_term")]
    assert terms.automatic_terms(spark).columns == ["term", "category"]
    store = spark.createDataFrame([("people", "Ana"), ("people", "ana"), ("firms", "Acme")], "list string, value string")
    assert [tuple(r) for r in terms.removed_count(store, spark.createDataFrame([("people", "ANA")], "list string, value string")).collect()] == [("people", 2)]


def plain_names(texts, variants):
    out = []
    for i, text in texts:
        for n, line in enumerate(re.split(r"\r\n|[\n\x0b\x0c\r\x1c\x1d\x1e\x85  ]", text or ""), 1):
            w, at = re.findall("[A-Z0-9]+", terms.fold(line[:5000]).upper()), 0
            while at < len(w):
                k = next((k for k in range(8, 1, -1) if at + k <= len(w) and " ".join(w[at : at + k]) in variants), 1)
                if k > 1:
                    out.append((i, n, at, k))
                at += k
    return sorted(out)


@pytest.mark.parametrize("dropped", [(), ("first",), ("pair", "first")])
def test_names_equal_a_scan_word_by_word(spark, dropped):
    rng = random.Random(9)
    words = ["ANA", "LIMA", "DA", "E", "Prado", "Ção", "X", "SAO", "PAULO", "7", "Joana", "Souza"]
    people = spark.createDataFrame([(" ".join(rng.choices(words, k=rng.randint(1, 5))), "person") for _ in range(60)], "name string, kind string")
    variants = {r.variant for r in names.build_variants(people).collect()}
    texts = [(i, "".join(rng.choice(words) + rng.choice([" ", ", ", "\n"]) for _ in range(rng.randint(0, 60)))) for i in range(50)] + [(90, None), (91, "")]
    hashes, _ = names.build_protected(people, KEY)
    found = names.scan_protected(spark.createDataFrame(texts, "id int, text string").repartition(3), hashes.drop(*dropped), KEY)
    assert sorted((r.id, r.line, r.start, r.words) for r in found.collect()) == plain_names(texts, variants)


def test_only_sequences_that_may_be_stored_leave_the_pass(spark):
    stored = [f"{a}NA {b}MA {c}ZA" for a, b, c in zip("ABCDEFGH", "HGFEDCBA", "STUVWXYZ", strict=True)] + ["ANA DE SOUZA LIMA PRADO"]
    hashes, _ = names.build_protected(spark.createDataFrame([(n, "person") for n in stored], "name string, kind string"), KEY)
    variants = {r.variant for r in names.build_variants(spark.createDataFrame([(n, "person") for n in stored], "name string, kind string")).collect()}
    scanner = names.NameScanner(KEY, names.pair_filter(hashes), ())
    text = "\n".join(f"{n} and seven more words are here now" for n in stored)
    found = [" ".join(stored[line - 1].split()[at >> 4 : (at >> 4) + (at & 15)]) for _, *columns in scanner.find([None, text]) for line, at in zip(*(c.tolist() for c in columns[:2]), strict=True)]
    assert {f for f in found if f in variants} >= {"ANA DE SOUZA LIMA PRADO", "ANA HMA SZA", "ANA HMA"}
    assert len(found) <= 2 * len(stored) + 2 and len(found) - sum(f in variants for f in found) <= 1


@pytest.mark.parametrize("at_once", [1, 40])
def test_names_are_found_wherever_texts_are_parted(spark, monkeypatch, at_once):
    monkeypatch.setattr(names, "WORDS_AT_ONCE", at_once)
    monkeypatch.setattr(names, "REMEMBERED", 3)
    stored = ["ANA DE SOUZA LIMA PRADO", "JOANA PRADO LIMA"]
    hashes, _ = names.build_protected(spark.createDataFrame([(n, "person") for n in stored], "name string, kind string"), KEY)
    scanner = names.NameScanner(KEY, names.pair_filter(hashes), names.GENERIC, ("pair", "first", "hash", "third"))
    texts = ["x joana prado lima\nana", None, "", "ana de souza lima prado\n\nz ana prado", "joana\nprado"] * 5
    found = sorted((row, line, at >> 4, at & 15) for table in scanner.find(texts) for row, line, at in zip(*(c.tolist() for c in table[:3]), strict=True))
    assert found == sorted(x for k in range(0, 25, 5) for x in [(k, 1, 1, 2), (k, 1, 1, 3), (k + 3, 1, 0, 5), (k + 3, 3, 1, 2)])


def test_pair_filter_lets_stored_pairs_pass_and_few_others(spark):
    pairs = [hmac.new(KEY, str(i).encode(), hashlib.sha256).hexdigest()[:20] for i in range(3000)]
    words = names.pair_filter(spark.createDataFrame([(p,) for p in [*pairs, *pairs[:5]]], "pair string").repartition(4))
    assert len(words) * 64 == 1 << 16
    scanner = names.NameScanner(KEY, words, ())
    assert all(scanner.passes(str(i)) for i in range(3000))
    assert sum(scanner.passes(f"x{i}") for i in range(5000)) < 100
    assert len(names.pair_filter(spark.createDataFrame([], "pair string"))) * 64 == names.FEWEST_BITS


def test_a_row_of_null_path_keeps_its_findings(spark):
    rows = [(None, b"acme corp"), (None, b"x"), ("a.py", b"acme corp"), ("b.py", b"x")]
    found = workflows.inventory(spark.createDataFrame(rows, "path string, content binary"), terms=spark.createDataFrame([("acme corp", "sensitive_term")], "term string, category string"))["plan"].collect()
    assert {r.status for r in found if r.path is None} == {"SANITIZE"}
    assert {r.path: r.status for r in found if r.path} == {"a.py": "SANITIZE", "b.py": "COPY"}


def test_extra_findings_of_one_file_are_bounded(spark):
    many = spark.createDataFrame([("a.py", i, "email", "s", "x") for i in range(500)] + [(None, 1, "cpf", "s", "x")], "path string, line int, category string, snippet string, source string").repartition(4)
    plan = content.inventory(spark.createDataFrame([("a.py", bytearray(b"x")), (None, bytearray(b"y"))], "path string, content binary"), extra=many)
    got = {r.path: r for r in plan.collect()}
    assert (got["a.py"].total_findings, len(got["a.py"].findings), got["a.py"].findings[-1].line) == (500, 40, 39) and got[None].total_findings == got[None].personal_findings == 1 and got["a.py"].personal_findings == 500


def test_top_of_groups_is_cut_before_the_shuffle(spark):
    plan = spark.createDataFrame([(f"F{i:03}", "COPY" if i % 3 else None) for i in range(300)] + [("f001", "COPY")], "path string, status string").repartition(4)
    top = content.top_k_per_status(plan, 5)
    assert {r.remaining for r in top.filter("status is null").collect()} == {95}
    assert [(r.path, r["rank"], r.remaining) for r in top.filter("status is not null").orderBy("rank").collect()] == [("F001", 1, 196), ("f001", 2, 196), ("F002", 3, 196), ("F004", 4, 196), ("F005", 5, 196)]
    assert plan_of(top).split("== Physical Plan ==")[1].count("Scan ExistingRDD") == 1  # the plan is read once
    found = spark.createDataFrame([(None, 1 + i % 20, 0, i, "email") for i in range(50)] + [("a", 2, 0, 0, "cpf")], "id string, line int, pattern_no int, match_no int, category string")
    counts = {(r.id, r.category): (r.findings, list(r.lines)) for r in content.file_category_counts(found).collect()}
    assert counts == {(None, "email"): (50, list(range(1, 16))), ("a", "cpf"): (1, [2])}
    assert sorted((str(r.id), r["rank"], r.total_findings) for r in content.cap_findings(found, 2).collect()) == [("None", 1, 50), ("None", 2, 50), ("a", 1, 1)]


@pytest.mark.parametrize("held", [1, 50_000])
def test_first_rows_and_totals_of_groups(spark, monkeypatch, held):
    monkeypatch.setattr(bounded, "HELD_ROWS", held)
    rng = random.Random(12)
    rows = [(rng.choice(["a", "b", None, "hot", "hot", "hot"]), rng.choice([1, None, (1 << 60) + 1]), rng.choice([None, 3, (1 << 60) + rng.randint(0, 50)]), rng.choice(["é", "z", "", None]), [1]) for _ in range(900)]
    df = spark.createDataFrame(rows, "g string, h long, o long, p string, more array<int>").repartition(5)
    groups = {}
    for r in rows:
        groups.setdefault(r[:2], []).append(r[2:4])
    want = sorted((str(g), n, str(v), len(vs)) for g, vs in groups.items() for n, v in enumerate(sorted(vs, key=lambda v: (v[0] is not None, v[0] or 0, v[1] is not None, v[1] or "")), 1) if n <= 7)
    rows_a_batch = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(rows_a_batch)
    spark.conf.set(rows_a_batch, "40")
    got = bounded.first_with_total(df.withColumn("sure", F.lit("s")), ["g", "h"], ["o", "p"], 7).collect()
    spark.conf.set(rows_a_batch, before)
    assert sorted((str((r.g, r.h)), r["rank"], str((r.o, r.p)), r.total) for r in got) == want and all(r.more == [1] for r in got)
    assert bounded.first_with_total(df, ["g"], ["o"], 0).count() == 0 == bounded.first_with_total(df.limit(0), ["g"], ["o"], 3).count()


def test_alert_limits(spark):
    rows = [("history", f"h{i:02}") for i in range(40)] * 2 + [("source", "s1"), ("folder", "b"), ("folder", "a"), ("pending", "p")]
    alerts = spark.createDataFrame(rows, "kind string, alert string").repartition(3)
    got = sorted(((r.kind, r.alert, r["rank"], r.remaining) for r in audits.first_alerts(alerts, {"history": 3, "source": 10, "pending": 0}).collect()), key=str)
    assert got == sorted([("folder", "a", None, 0), ("folder", "b", None, 0), ("history", "h00", 1, 37), ("history", "h01", 2, 37), ("history", "h02", 3, 37), ("source", "s1", 1, 0)], key=str)
    assert audits.first_alerts(alerts.limit(0), {"history": 3}).count() == 0


def test_verification_of_another_folder_or_unclean(spark):
    a = spark.createDataFrame([("x", "1"), ("y", "2")], "path string, sha256 string")
    b = spark.createDataFrame([("x", "9"), ("z", "3")], "path string, sha256 string")
    assert sorted(tuple(r) for r in snapshots.verified_problems(a, b, True, True).collect()) == [("x", "changed"), ("y", "vanished"), ("z", "unverified")]
    assert {r.problem for r in snapshots.verified_problems(a, a, False, False).collect()} == {"verification isn't clean", "verification is of another folder"}


def test_images_in_the_history_are_looked_into(spark):
    from tests.test_files import png

    blobs = spark.createDataFrame([("s1", bytearray(png((b"tEXt", b"Author\0" + MAIL.encode())))), ("s2", bytearray(png())), ("s3", bytearray(b"\0\1")), ("s4", bytearray(MAIL.encode()))], "sha string, content binary")
    where = spark.createDataFrame([("r", s, p) for s, p in (("s1", "b.png"), ("s1", "a.bin"), ("s2", "c.png"), ("s3", "d"), ("s4", "e"))], "repo_id string, sha string, path string")
    assert {(r.path, r.category) for r in audits.scan_blobs(blobs, where).collect()} == {("a.bin", "email"), ("a.bin", "image_metadata"), ("e", "email")}


def test_deep_and_wide_tree(spark, tmp_path):
    want = set()
    for folder in ["", "deep/1/2/3/4/.5", *(f"top/{i}" for i in range(12))]:
        (tmp_path / folder).mkdir(parents=True, exist_ok=True)
        for name in ("_a", ".b"):
            (tmp_path / folder / name).write_text(folder)
            want.add(f"{folder}/{name}".lstrip("/"))
    os.symlink(tmp_path / "top", tmp_path / "deep/loop")
    for root in (str(tmp_path), f"file://{tmp_path}/"):
        listed = {r.path: r for r in files.list_files(spark, root).collect()}
        assert set(listed) == want | {"deep/loop"} and listed["deep/loop"].is_symlink and listed["_a"].size == 0 and listed["top/3/_a"].mtime_ns > 1 << 60
    with pytest.raises(OSError, match="can't be listed"):
        files.list_files(spark, str(tmp_path / "none"))
    assert files.list_files(spark, str(tmp_path / "top/3")).count() == 2


def test_tree_by_uri(tmp_path):
    """The way that URIs of other stores take, here through pyarrow's local file system."""
    (tmp_path / "a/.b").mkdir(parents=True)
    (tmp_path / "a/.b/_c.txt").write_text("x")
    tree = files.Folder(str(tmp_path))
    from pyarrow import fs

    tree.fs = fs.LocalFileSystem()
    assert [(n, d) for n, _, _, _, d, _ in tree.list("a")] == [(".b", True)]
    assert [(n, s, d) for n, s, _, _, d, _ in tree.list("a/.b")] == [("_c.txt", 1, False)]
    with tree.open("a/.b/_c.txt") as x:
        assert files.read_file(x) == (b"x", hashlib.sha256(b"x").hexdigest())
    with pytest.raises(OSError):
        list(tree.list("none"))


class Zeros(io.RawIOBase):
    """A file of so many zero bytes that is never held whole."""

    def __init__(self, size):
        self.left = size

    def read(self, n=-1):
        n = min(n, self.left)
        self.left -= n
        return bytes(n)


def test_long_files_cost_a_few_megabytes(spark, tmp_path):
    tracemalloc.start()
    head, digest = files.read_file(Zeros(1 << 30))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(head) == content.MAX_TEXT + 1 and peak < 8 << 20
    whole = hashlib.sha256()
    for _ in range(1 << 10):
        whole.update(bytes(1 << 20))
    assert digest == whole.hexdigest()
    (tmp_path / "big.py").write_bytes(b"a" * (content.MAX_TEXT + 500))
    (tmp_path / "small.py").write_text("x")
    tree, _ = files.read_tree(spark, str(tmp_path))
    plan = {r.path: r for r in content.inventory(tree).collect()}
    assert (plan["big.py"].status, plan["big.py"].size, plan["big.py"].sha256) == ("REVIEW", content.MAX_TEXT + 500, hashlib.sha256(b"a" * (content.MAX_TEXT + 500)).hexdigest())
    assert (plan["small.py"].status, plan["small.py"].sha256) == ("COPY", hashlib.sha256(b"x").hexdigest())


def test_order_of_files_outlives_the_write(spark, tmp_path):
    paths = [f"{'aBcD'[i % 4]}{i % 37}/{i}" for i in range(400)] + ["same", "Same", None]
    df = spark.createDataFrame([(p,) for p in paths], "path string").repartition(5)
    content.order_files(df, 4).write.parquet(str(tmp_path / "out"))
    parts = sorted(p for p in os.listdir(tmp_path / "out") if p.endswith(".parquet"))
    assert len(parts) == 4
    read = [r.path for p in parts for r in spark.read.parquet(str(tmp_path / "out" / p)).collect()]
    assert read == sorted(paths, key=lambda p: (p is not None, (p or "").lower(), p or ""))


def test_run_record(spark, tmp_path):
    run = sinks.run_record(spark, "/some/root", "verify", clean=False, term_sources=("a.txt",), accepted=("x",))
    sinks.write_plan(spark.range(1), spark.range(1), run, str(tmp_path / "plan"), "/some/root")
    row = spark.read.parquet(str(tmp_path / "plan/run")).first()
    assert (row.root, row.mode, row.clean, row.term_sources, row.accepted) == ("/some/root", "verify", False, ["a.txt"], ["x"])
    assert abs((row["at"] - datetime.now()).total_seconds()) < 86_400


def test_small_tables_are_dealt_out_and_large_ones_left(spark):
    one = spark.range(10).coalesce(1)
    assert files.spread(one, 3).rdd.getNumPartitions() == 3
    many = spark.range(0, 10, 1, 6)
    assert files.spread(many, 3).rdd.getNumPartitions() == 6
    corpus = files.corpus_from_table(one.withColumn("t", F.lit("x")), "id", "t", partitions=2)
    assert corpus.columns == ["id", "text", "path"] and corpus.rdd.getNumPartitions() == 2 and files.corpus_from_table(one, "id", "id", "id").rdd.getNumPartitions() == 1


def test_blobs_of_a_stream_are_scanned_once(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    schema = "sha string, text string, ts timestamp"

    def arrive(name, *rows):
        spark.createDataFrame(rows, "sha string, text string, at long").select("sha", "text", F.timestamp_seconds("at").alias("ts")).coalesce(1).write.parquet(f"{source}/{name}")

    arrive("b=1", ("s1", f"x\n{MAIL}", 1000), ("s1", f"x\n{MAIL}", 1000), ("s2", "projeto agata", 1010), ("s3", "Joana Prado Lima", 1020))
    listed = spark.createDataFrame([("projeto ágata", "sensitive_term")], "term string, category string")
    hashes, _ = names.build_protected(spark.createDataFrame([("Joana Prado Lima", "person")], "name string, kind string"), KEY)
    stream = lambda: spark.readStream.schema(schema).parquet(f"{source}/*")
    run = lambda: streams.start_scan(stream(), "ts", out, str(tmp_path / "cp"), lambda: listed, lambda: hashes, KEY, trigger={"availableNow": True}).awaitTermination()
    run()
    want = [("s1", 2, "email"), ("s2", 1, "sensitive_term"), ("s3", 1, "protected_name")]
    assert sorted(tuple(r) for r in spark.read.parquet(out).select("id", "line", "category").collect()) == want
    arrive("b=2", ("s1", f"x\n{MAIL}", 1500), ("s4", MAIL, 9000), ("s5", MAIL, 2))  # a repeat, a new one, and one that comes late
    run()
    found = sorted(tuple(r) for r in spark.read.parquet(out).select("id", "line", "category").collect())
    assert found == sorted([*want, ("s4", 1, "email")] + ([("s5", 1, "email")] if ("s5", 1, "email") in found else []))
    arrive("b=3", ("s6", MAIL, 100), ("s7", "clean", 9100))  # far behind the watermark
    run()
    assert "s6" not in {r.id for r in spark.read.parquet(out).collect()}
    with pytest.raises(ValueError, match="key"):
        streams.start_scan(stream(), "ts", out, str(tmp_path / "cp2"), hashes=lambda: hashes)
    q = streams.scan_terms_stream(stream(), listed, "sha", "text").writeStream.format("memory").queryName("terms_found").trigger(availableNow=True).start()
    q.awaitTermination()
    assert [(r.id, r.line) for r in spark.table("terms_found").collect()] == [("s2", 1)]
