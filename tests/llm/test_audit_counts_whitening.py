"""Filter audit, prefix counts and whitening, each against a plain version."""

import itertools
import math
import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from scrub.llm import filter_audit, prefix_counts, whitening

P = pytest.importorskip("public_tokenizers")
MODEL = "piece_bpe_32k.model"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


# 11 filter audit


def fails(text):
    words = WORD.findall(text)
    return [len(words) < 100, 100 * len(set(words)) < 80 * len(words), 100 * len(re.findall("[A-Z]", text)) > 10 * len(text), bool(re.search(r"[#$%&*|]", text))]


def plain_audit(docs, labels):
    """docs: (id, text, lang)."""
    good, toxic = {i for i, q, _ in labels if i is not None and q == 1}, {i for i, _, t in labels if i is not None and t == 1}
    least = {}
    for i, t, _ in docs:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    rows, out = [], {}
    for i, t, part in docs:
        rows.append((part or "", [*fails(t or ""), i is not None and i > least[t or ""]], i in good, i in toxic))
    for part in {r[0] for r in rows}:
        mine, gone_by = [r for r in rows if r[0] == part], dict.fromkeys("ABCDE", 0)
        for order in itertools.permutations("ABCDE"):
            left = mine
            for step, name in enumerate(order, 1):
                k = "ABCDE".index(name)
                removed = [r for r in left if r[1][k]]
                left = [r for r in left if not r[1][k]]
                gone_by[name] += len(removed)
                failing = [r for r in mine if r[1][k]]
                out[part, "".join(order), step] = [name, len(left), len(removed), len(failing) - len(removed), sum(sum(r[1]) == 1 for r in failing), sum(r[2] for r in removed), sum(r[3] for r in removed)]
        for key, row in out.items():
            if key[0] == part:
                row.append(gone_by[row[0]])
    return {k: tuple(v) for k, v in out.items()}


def result(df):
    return {(r["part"], r["filter_order"], r["step"]): tuple(r[c] for c in ("filter", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")) for r in df.collect()}


def test_audit_equals_plain_counts(spark):
    rng = random.Random(2)
    words = ["a", "b|", "CD", "é", "f\x1cg", "漢 字", "#", "x y", "W"]
    texts = [None, "", " \t\n", "A" * 50, "hot text $", " ".join(f"w{i}" for i in range(100)), " ".join(f"w{i}" for i in range(99)), "long " * 30_000]
    texts += [" ".join(rng.choices([*words, *map(str, range(200))], k=rng.randint(80, 140))) for _ in range(30)]
    docs = [(i, rng.choice(texts), rng.choice(["en", "de", None, ""])) for i in range(120)]
    docs += [(500 + i, "hot text $", "en") for i in range(80)]  # a third of rows alike
    docs += [(7, docs[7][1], "en")] * 3 + [(None, "hot text $", "de")] * 4 + [(None, None, None)]  # repeats and null ids
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1])) for i in range(0, 150, 2)] + [(4, 1, 0), (4, 0, 1), (None, 1, 1)]
    frame = spark.createDataFrame([(*d, 1, "x", 2) for d in docs], "doc_id long, text string, lang string, label int, fails string, part int").repartition(3)
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    assert result(filter_audit.audit(frame, marks)) == plain_audit(docs, labels)
    assert filter_audit.audit(frame.limit(0), marks).count() == 0
    assert result(filter_audit.audit(frame, marks.limit(0))) == plain_audit(docs, [])


@given(st.lists(st.integers(0, (1 << 32) - 1), max_size=200))
@settings(max_examples=60, deadline=None)
def test_positional_counts(words):
    found = filter_audit.positional_counts(np.array(words, np.uint32))
    assert found.tolist() == [sum(w >> b & 1 for w in words) for b in range(32)]


def test_truth_words_hold_the_subsets_survived():
    for f, word in enumerate(filter_audit.truth_words().tolist()):
        assert [word >> s & 1 for s in range(32)] == [int(s & f == 0) for s in range(32)]


# 12 prefix counts


@pytest.fixture(scope="module")
def known():
    return prefix_counts.prefixes(P.path(MODEL))


def library_counts(known, text):
    return [len(known.model.encode(text[:i])) for i in range(1, len(text) + 1)]


def test_counts_of_all_prefixes_equal_the_library(known):
    rng = random.Random(4)
    letters = list("abcdefgh  the ing ▁.,'ß漢字😀\n\t\x00​é1234<>ÄÖ   İ²½_{}́") + ["<s>", "</s>", "<unk>", "<0x41>", "international"]
    pieces = list(known.ids)
    texts = ["".join(rng.choices(letters, k=rng.randint(0, 40))) for _ in range(300)]
    texts += ["".join(rng.choices(pieces, k=rng.randint(0, 8))).replace("▁", rng.choice([" ", "▁"])) for _ in range(300)]
    for text, steps in zip(texts, known.of(texts), strict=True):
        assert np.cumsum(steps, dtype=np.int64).tolist() == library_counts(known, text)


@given(st.lists(st.text(max_size=30), max_size=5))
@settings(max_examples=80, deadline=None)
def test_counts_of_any_text_equal_the_library(texts):
    known = prefix_counts.prefixes(P.path(MODEL))
    texts = [t.encode("utf-8", "ignore").decode() for t in texts]
    assert [int(s.sum(dtype=np.int64)) for s in known.of(texts)] == [len(known.model.encode(t)) for t in texts]


def test_coarse_units_give_the_same_counts(known):
    other = prefix_counts.Prefixes(P.path(MODEL))
    other.unit = re.compile(prefix_counts.COARSE)
    texts = ["a.b,c_{d}  e2f ½x ", " ", "▁▁", "word " * 50]
    for a, b in zip(known.of(texts), other.of(texts), strict=True):
        assert a.tolist() == b.tolist()


def test_steps_of_more_than_a_byte():
    steps = np.array([1, 200, -3, 1 << 20])
    packed, width = prefix_counts.pack_steps(steps)
    starts, lows = prefix_counts.blocks_of(steps)
    assert width == 8
    assert [prefix_counts.tokens_at(packed, width, starts.tolist(), n) for n in range(6)] == [0, 1, 201, 198, 198 + (1 << 20), 198 + (1 << 20)]
    assert prefix_counts.longest_within(packed, width, starts.tolist(), lows.tolist(), 200) == 3


def test_index_answers_budgets(spark, known):
    rng = random.Random(6)
    texts = [None, "", " ", "one", "漢字" * 900, "international relations " * 400, "x" * 5_000, "same", "same", *("".join(rng.choices("ab c.é\n", k=rng.randint(1, 3000))) for _ in range(12))]
    rows = [(None if i == 3 else i // 2, t, i, "y") for i, t in enumerate(texts)]  # ids repeat
    docs = spark.createDataFrame(rows, "doc_id long, text string, id int, steps string").repartition(3)
    index = prefix_counts.prefix_index(docs.withColumn("key", F.col("id")), P.path(MODEL), "key")
    asked = [0, 1, 7, 1023, 1024, 1025, 2049, 10**6, None]
    at = F.array(*(prefix_counts.prefix_tokens(F.lit(n)) for n in asked))
    budgets = [0, 1, 5, 300, 4096]
    cut = F.array(*(prefix_counts.prefix_within(F.lit(b)) for b in budgets))
    found = {r["id"]: r for r in index.select("*", at.alias("at"), cut.alias("cut")).collect()}
    assert len(found) == len(texts)
    for i, t in enumerate(texts):
        counts = [0, *np.cumsum(next(known.of([t or ""])), dtype=np.int64).tolist()]
        assert counts[-1] == len(known.model.encode(t or "")) == found[i]["n_tokens"]
        assert (found[i]["n_bytes"], found[i]["n_chars"]) == (len((t or "").encode()), len(t or ""))
        assert list(found[i]["at"]) == [None if n is None else counts[min(n, len(t or ""))] for n in asked]
        assert list(found[i]["cut"]) == [max(k for k, c in enumerate(counts) if c <= b) for b in budgets]
    report = prefix_counts.token_budget(docs, P.path(MODEL), 300)
    want = sorted((str(r[0]), len(known.model.encode(r[1] or "")), len(known.model.encode(r[1] or "")) > 300) for r in rows)
    assert sorted((str(r["doc_id"]), r["n_tokens"], r["over_limit"]) for r in report.collect()) == want
    assert prefix_counts.token_budget(docs.limit(0), P.path(MODEL), 300).count() == 0


# 13 whitening


def vectors_of(n, d, seed):
    rng = np.random.default_rng(seed)
    return (rng.normal(size=(n, d)) @ rng.normal(size=(d, d)) * 0.2).astype(np.float32)


def as_rows(vectors):
    return [(i, [float(v) for v in row]) for i, row in enumerate(vectors)]


def check(rows, found, components):
    """found against a plain computation over the rows (id, vector) that are kept."""
    x = np.array([[math.floor(1024 * c) + 100_000 for c in v] for _, v in rows], object)
    n, sums = len(x), x.sum(0)
    centred = ((x * n - sums) / n).astype(float)
    values, axes = np.linalg.eigh(centred.T @ centred / n)
    values, axes = values[::-1], axes[:, ::-1]
    by = {}
    for r in found:
        by.setdefault((r["vec_id"], r["component"]), []).append(r)
    assert len(found) == n * components
    for k in range(components):
        want = centred @ axes[:, k] / math.sqrt(values[k])
        got = np.array([by[i, k + 1][0]["whitened"] for i, _ in rows])
        assert np.allclose(got, want, rtol=1e-7, atol=1e-8) or np.allclose(got, -want, rtol=1e-7, atol=1e-8)
    for (i, _), deviation in zip(rows, ((x * n - sums) ** 2).sum(1), strict=True):
        for r in by[i, 1]:
            assert (r["n"], r["deviation"]) == (n, deviation) and r["identity_error"] < 1e-9
            assert math.isclose(r["explained"], values[0] / values.sum(), rel_tol=1e-9)


def whitened(spark, rows, components=8, kind="float", **more):
    df = spark.createDataFrame([(*r, "a", 1) for r in rows], f"vec_id long, embedding array<{kind}>, x string, copies int").repartition(3)
    return whitening.components_of(*whitening.whiten(df, components, **more)).collect()


def test_whitening_equals_plain_algebra(spark):
    base = vectors_of(90, 12, 1)
    hot = [(1000 + i, [float(v) for v in base[3]]) for i in range(60)]  # a third of rows alike
    good = as_rows(base) + hot
    nan, inf = float("nan"), float("inf")
    bad = [(5000, None), (5001, [None] + [0.0] * 11), (5002, [nan] + [0.0] * 11), (5003, [-inf] + [0.0] * 11), (5004, [1.0, 2.0]), (5005, [])]
    check(good, whitened(spark, good + bad), 8)


def test_whitening_of_few_and_flat_vectors(spark):
    assert whitened(spark, []) == []
    assert whitened(spark, [(1, [1.0, 2.0])]) == []
    assert whitened(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0]), (None, None)]) == []
    rows = [(i, [float(i), 2.0 * i, 3.0]) for i in range(7)]  # one direction only
    found = whitened(spark, rows)
    assert {r["component"] for r in found} == {1}
    assert math.isclose(np.var([r["whitened"] for r in found]), 1.0, rel_tol=1e-9)
    repeated = whitened(spark, [(None, [1.0, 0.0]), (None, [0.0, 1.0]), (3, [5.0, 5.0]), (3, [5.0, 5.0])])
    assert len(repeated) == 8 and sum(r["vec_id"] is None for r in repeated) == 4


def test_whitening_weights_of_one_and_huge_entries(spark):
    base = vectors_of(40, 4, 2)
    rows = as_rows(base)
    once = whitened(spark, rows, 4)
    more = whitened(spark, rows + [(100 + i, rows[0][1]) for i in range(30)], 4, weights="one")
    first = {(r["vec_id"], r["component"]): r for r in more}
    for r in once:
        other = first[r["vec_id"], r["component"]]
        assert math.isclose(abs(r["whitened"]), abs(other["whitened"]), rel_tol=1e-6, abs_tol=1e-8) and r["deviation"] == other["deviation"]
    far = whitened(spark, [(1, [1e300, 0.0]), (2, [-1e300, 1.0]), (3, [0.0, 2.0])], 2, "double")
    assert {r["vec_id"] for r in far} == {1, 2, 3} and all(math.isfinite(r["whitened"]) for r in far)
    assert all(r["deviation"] is None for r in far if r["vec_id"] != 3)
    with pytest.raises(ValueError, match="weights"):
        whitened(spark, rows, 4, weights="some")
