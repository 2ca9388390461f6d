import pytest
from pyspark.sql import functions as F

from scrub.operators import audits, names, terms
from scrub.plans import workflows
from scrub.streaming.scan import findings_per_window, scan_stream

KEY = b"0123456789abcdef"
MAIL = "ana@" + "corp.net"


def people(spark, *rows):
    return spark.createDataFrame(list(rows), "name string, kind string")


def test_variants(spark):
    df = people(spark, ("Joana da Silva Prado", "person"), ("JOANA DA SILVA PRADO", "person"), ("Maria E Souza", "person"), ("Padaria Estrela Azul Ltda ME", "company"), ("Grupo Brasil SA", "company"), ("Solo", "person"), ("", "person"), (None, "person"))
    got = {r.variant for r in names.build_variants(df).collect()}
    assert got == {"JOANA DA SILVA PRADO", "JOANA PRADO", "JOANA SILVA", "MARIA SOUZA", "PADARIA ESTRELA AZUL LTDA ME", "PADARIA ESTRELA AZUL", "PADARIA ESTRELA", "GRUPO BRASIL SA"}


def test_scan_protected(spark):
    hashes, counts = names.build_protected(people(spark, ("Joana da Silva Prado", "person"), ("Silva Prado Lopes", "person")), KEY)
    assert [(r.names, r.variants) for r in counts.collect()] == [(2, 6)]
    text = "x joana DA Sílva prado lopes, silva prado\nJoana, Silva.\nJOANA\n" + "joana prado " * 3
    df = spark.createDataFrame([(1, text), (2, None), (3, "")], "id int, text string")
    want = [(1, 1, 1, 4), (1, 1, 6, 2), (1, 2, 0, 2), (1, 4, 0, 2), (1, 4, 2, 2), (1, 4, 4, 2)]
    assert sorted(tuple(r) for r in names.scan_protected(df, hashes, KEY).collect()) == want
    assert sorted(tuple(r) for r in names.scan_protected(df, hashes.drop("pair"), KEY).collect()) == want
    allow = spark.createDataFrame([("JOANA DA SILVA PRADO",)], "sequence string")
    assert (1, 1, 3, 3) in {tuple(r) for r in names.scan_protected(df, hashes, KEY, allow).collect()}
    assert {r.name: r.protected for r in names.lookup_names(people(spark, ("joana prado", "p"), ("ana", "p")), hashes, KEY).collect()} == {"joana prado": True, "ana": False}
    with pytest.raises(ValueError):
        names.scan_protected(df, hashes, None)
    assert workflows.protect_and_find(people(spark, ("Ana Lima", "person")), df, KEY).count() == 0


@pytest.mark.parametrize("many", [False, True])
def test_scan_terms(spark, many):
    listed = [("Ação", "sensitive_term"), ("projeto x.1", "internal_term"), (" ", "sensitive_term")] + [(f"filler{i}", "sensitive_term") for i in range(100 * many)]
    df = spark.createDataFrame([(1, "a ACAO_b reacao\nProjeto X.1\nprojeto xa1 acão"), (2, None)], "id int, text string")
    got = sorted((r.id, r.line, r.category) for r in terms.scan_terms(df, spark.createDataFrame(listed, "term string, category string")).collect())
    assert got == [(1, 1, "sensitive_term"), (1, 2, "internal_term"), (1, 3, "sensitive_term")]
    assert terms.scan_terms(df, spark.createDataFrame([], "term string, category string")).count() == 0


def test_term_store(spark):
    store = spark.createDataFrame([("people", "Ana Lima")], "list string, value string")
    new = spark.createDataFrame([("people", " ana  LÍMA "), ("people", "Bia"), ("people", "BIA"), ("other", "x"), ("people", " ")], "list string, value string")
    added = terms.add_terms(store, new, ("people",))
    assert sorted(r.value for r in added.collect()) == ["Ana Lima", "BIA"]
    assert [r.value for r in terms.remove_terms(added, new.limit(1)).collect()] == ["BIA"]
    assert terms.contains_terms(new.limit(1), store).count() == 1
    assert [tuple(r) for r in terms.merge_backup(store, new, ("people",))[1].collect()] == [("people", 1)]
    assert terms.migrate_lists(store, new, ("people",)).count() == 2
    assert {r.list: r.terms for r in terms.store_counts(store, ("people", "firms")).collect()} == {"people": 1, "firms": 0}
    named = lambda v: spark.createDataFrame([("keys", "a", v)], "list string, name string, value string")
    with pytest.raises(ValueError):
        terms.merge_backup(named("1"), named("2"), ("keys",))


def test_noreply(spark):
    ok = "12+a-b@" + "users.noreply.github.com"
    cases = {ok: True, MAIL: False, ok[3:]: False, ok + ".evil.net": False, "x" + ok: False, None: False}
    rows = spark.createDataFrame([(c,) for c in cases], "e string").select("e", audits.is_noreply_email(F.col("e")).alias("ok")).collect()
    assert {r.e: r.ok for r in rows} == cases


def test_visibility(spark):
    rows = [(True, True, True, True, 200, "PRIVATE"), (True, True, True, False, 200, "PUBLIC"), (True, True, False, None, 404, "UNCONFIRMED"), (True, True, True, None, 404, "MISSING"), (False, True, True, True, 200, "NOT SET"), (True, False, True, True, 200, "UNKNOWN"), (True, True, False, True, 200, "UNKNOWN")]
    df = spark.createDataFrame(rows, "r boolean, g boolean, a boolean, p boolean, h int, want string")
    assert df.filter(audits.visibility(F.col("r"), F.col("g"), F.col("a"), F.col("p"), F.col("h")) != F.col("want")).isEmpty()


def test_history(spark):
    commits = spark.createDataFrame([("r", "abcdef123", "a", MAIL, "c", "1+c@" + "users.noreply.github.com", "see " + MAIL)], "repo_id string, commit string, author_name string, author_email string, committer_name string, committer_email string, message string")
    blobs = spark.createDataFrame([("r", "s1", bytearray(MAIL.encode())), ("q", "s1", bytearray(MAIL.encode())), ("r", "s2", bytearray(b"\0" + MAIL.encode()))], "repo_id string, sha string, content binary")
    where = spark.createDataFrame([("r", "s1", "b.py"), ("r", "s1", "a.py"), ("q", "s1", "z.py"), ("r", "s2", "old.pem")], "repo_id string, sha string, path string")
    alerts = {tuple(r) for r in workflows.audit_history(commits, blobs, where).collect()}
    assert alerts == {("r", "commit abcdef1 author e-mail is no no-reply address"), ("r", "commit abcdef1 message holds email"), ("r", "history has excluded file old.pem"), ("r", "history: a.py holds email"), ("q", "history: z.py holds email")}


def test_messages_and_policy(spark):
    df = spark.createDataFrame([(1, "ok"), (2, " "), (3, "x\nCo-Authored-By: y"), (4, "mail " + MAIL), (5, None)], "id int, message string")
    assert {r.id: r.ok for r in audits.check_message(df).collect()} == {1: True, 2: False, 3: False, 4: False, 5: False}
    good = [("g", "README.md", "dados fictícios sanitizados\n## Uso\nlinha"), ("g", ".gitignore", "\n".join(audits.IGNORE_ENTRIES)), ("g", "x/LICENSE", "")]
    files = spark.createDataFrame(good + [("b", "LICENSE", ""), ("b", "README.md", None)], "repo_id string, path string, text string")
    problems = {}
    for r in audits.audit_policy(files, ("linha",)).collect():
        problems.setdefault(r.repo_id, []).append(r.problem)
    assert "g" not in problems and len(problems["b"]) == 5


def test_streams(spark, tmp_path):
    rows = spark.createDataFrame([(i, f"x {MAIL}" if i % 2 else "y") for i in range(10)], "id int, text string")
    rows.withColumn("ts", F.timestamp_seconds(F.col("id") * 3600)).write.parquet(str(tmp_path / "in"))
    schema = "id int, text string, ts timestamp"
    q = scan_stream(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), "id", "text").writeStream.format("memory").queryName("found").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("found").count() == 5
    q = findings_per_window(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), "ts", "text").writeStream.outputMode("append").format("memory").queryName("win").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert 0 < spark.table("win").count() <= 5
