import hashlib
import hmac
import unicodedata

from pyspark.sql import functions as F

from scrub.functions.masking import hmac_sha256_20, mask_value
from scrub.functions.text import cut_line, fold_accents, norm_key, normalize_words, slugify, split_lines, to_text


def test_split_lines_is_python_splitlines(spark):
    texts = ["", "a", "a\n", "a\n\n", "\n", "a\r\nb\rc\x0bd\x0ce\x1cf\x1dg\x1eh\x85i j k", "a\r\n\r\nb", None]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", split_lines(F.col("t")).alias("l")).collect()
    assert {r.i: r.l for r in rows} == {i: (t or "").splitlines() for i, t in enumerate(texts)}


def test_to_text_replaces_bad_bytes(spark):
    data = [b"ok", b"a\xffb", "é".encode(), b""]
    rows = spark.createDataFrame([(bytearray(d),) for d in data], "b binary").select(to_text(F.col("b")).alias("t")).collect()
    assert [r.t for r in rows] == [d.decode("utf-8", "replace") for d in data]


def test_fold_accents_on_all_of_the_basic_plane(spark):
    chars = [chr(i) for i in range(1, 0x10000) if not 0xD800 <= i < 0xE000]
    rows = spark.createDataFrame([(c,) for c in chars], "c string").select("c", fold_accents("c").alias("f")).collect()
    assert all(r.f == "".join(x for x in unicodedata.normalize("NFKD", r.c) if not unicodedata.combining(x)) for r in rows)


def test_words_keys_and_slugs(spark):
    row = spark.createDataFrame([(" Ação_x 12, Straße ", None)], "t string, n string").select(
        normalize_words(F.col("t")).alias("w"), norm_key("t").alias("k"), slugify(F.col("t")).alias("s"), fold_accents("n").alias("n")).first()
    assert row.w == ["ACAO", "X", "12", "STRASSE"] and row.k == "acao_x 12, strasse" and row.s == "acao-x-12-strasse" and row.n is None


def test_cut_line(spark):
    assert len(spark.range(1).select(cut_line(F.repeat(F.lit("é"), 6000)).alias("c")).first().c) == 5000


def test_hmac_equals_pythons(spark):
    key = bytes(range(16))
    words = ["", "ANA LIMA", "é" * 100]
    rows = spark.createDataFrame([(w,) for w in words], "w string").select("w", hmac_sha256_20(F.col("w"), key).alias("h")).collect()
    assert all(r.h == hmac.new(key, r.w.encode(), hashlib.sha256).hexdigest()[:20] for r in rows)


def test_masks_show_no_three_letters_of_hidden_values(spark):
    hidden = ["sensitive_term", "internal_term", "litigation_party", "address", "email", "local_path"]
    rows = spark.createDataFrame([(c, "Xyzzy Quux 77") for c in hidden], "c string, v string").select("c", "v", mask_value(F.col("c"), F.col("v")).alias("m")).collect()
    assert not [r for r in rows if any(r.v[i : i + 3] in r.m for i in range(len(r.v) - 2))]
    short = spark.createDataFrame([("aws_key", v) for v in ("", "a", "abcdefgh", "abcdefghi", "a" * 60)], "c string, v string").select("v", mask_value(F.col("c"), F.col("v")).alias("m")).collect()
    assert {r.v: r.m for r in short} == {"": "", "a": "a", "abcdefgh": "a*******", "abcdefghi": "abcd***hi", "a" * 60: "aaaa" + "*" * 20 + "aa"}
