"""Each operator against a plain version, on small tables with nulls, empty and long texts, ties, repeats and extra columns."""

import hashlib
import itertools
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from scrub.llm import common, components, mixing, near_dups, packing, prefix_links, pseudo_lm, quality, revisits, sharding, simhash, token_files, tokens, toxicity, winnow

P = pytest.importorskip("public_tokenizers")
WORD = re.compile(rb"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, chunk int, fp string, part int"


@pytest.fixture(scope="module")
def tokenizer():
    return P.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    words = ["the", "ação", "x1", "Über", "don't", "end.", "a,b", "#", "漢字", "İ", "J̌", "<|endoftext|>", "naïve", "émile."]
    texts = [None, "", " \n ", "one", "one two", "same text here again and again", "same text here again and again", "é" * 60, "word " * 9000, "a\x1cb\x85c d e"]
    texts += [" ".join(rng.choices(words, k=rng.randint(1, 80))) for _ in range(40)]
    return [(i * 3, t, rng.choice(["en", "de", None]), rng.choice(["hot", "hot", "s1", None]), 0, 7, "x", 1) for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def reference_ids(tokenizer, texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer)
    return [t.encode(x or "", add_special_tokens=False).ids + [1] for x in texts]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


# 1 token files


def test_encoder_equals_the_tokenizer(tokenizer):
    rng = random.Random(1)
    alphabet = list("ab'sS tÉé́ßJǰ\n\t\x0b\x0c\r\x1c\x85\xa0 　ΑΣσς0１٣!.ﬁİı漢😀\u0000,;Ĳĳſªµ") + ["<|endoftext|>", "<|startoftext|>", "'re", "'LL", "word.", "Ünd,", "éa."]
    known = tokens.pieces(tokenizer)
    for round_ in range(60):
        texts = ["".join(rng.choices(alphabet, k=rng.randint(0, 30))) for _ in range(40)] + [None, "", "x" * 200]
        if round_ % 2:
            texts = [t and t.replace("<|", "").replace("́", "").replace("̌", "") for t in texts]
        got = []
        for batch in tokens.slices(iter([pa.RecordBatch.from_pydict({"t": pa.array(texts, pa.string())})]), "t"):
            ids, at = tokens.encode_slice(batch.column(0), known)
            got += [ids[a:b].tolist() for a, b in itertools.pairwise(at)]
        assert got == reference_ids(tokenizer, texts)


@pytest.mark.parametrize("bits", [1, 5, 8, 13, 16, 17, 20, 31])
def test_bit_packing_round_trip(bits):
    rng = np.random.default_rng(bits)
    for n in (0, 1, 63, 64, 65, 1000):
        ids = rng.integers(0, 1 << bits, n).astype(np.uint32)
        data = token_files.pack(ids, bits)
        assert len(data) == -(-n // 64) * bits * 8 and (token_files.unpack(data, bits, n) == ids).all()
    with pytest.raises(ValueError):
        token_files.pack(np.array([1 << bits], np.uint64), bits)


def test_fewest_bits():
    assert [token_files.bits_for(v) for v in (1, 2, 3, 49_408, 65_536, 65_537)] == [1, 1, 2, 16, 16, 17]


def test_token_file_random_access(tmp_path):
    rng = np.random.default_rng(0)
    lens = [0, 1, token_files.BLOCK - 1, 5, 3 * token_files.BLOCK, 7]
    parts = [rng.integers(0, 49_408, n).astype(np.uint32) for n in lens]
    w = token_files.TokenFileWriter(f"{tmp_path}/a/x.idb", 16)
    for i, p in enumerate(parts):
        w.add([i or None], p, np.array([len(p)]))
    w.close()
    f = token_files.TokenFile(f"file://{tmp_path}/a/x.idb")
    every = np.concatenate(parts)
    assert all((f.document(i) == p).all() for i, p in enumerate(parts)) and [d for d, _, _ in f.documents(10)] == [None, 1, 2, 3, 4, 5]
    for a, b in ((0, 0), (0, 1), (5, token_files.BLOCK + 9), (len(every) - 3, len(every))):
        assert (f.ids(a, b) == every[a:b]).all()


def test_files_hold_all_documents_in_order(spark, docs, rows, tokenizer, tmp_path):
    files = token_files.write_token_files(docs, f"{tmp_path}/out", tokenizer, 49_408, rows_per_file=7).cache()
    assert files.count() >= 5
    got = sorted(tuple(r) for r in token_files.read_token_files(files).collect())
    start, want = 0, []
    for r, ids in zip(rows, reference_ids(tokenizer, [r[1] for r in rows]), strict=True):
        want.append((r[0], start, len(ids), crc(ids)))
        start += len(ids)
    assert got == want
    assert token_files.encode_to_files(docs.limit(0), tokenizer, 49_408).count() == 0
    null = spark.createDataFrame([(None, "b"), (2, "a"), (2, "a")], "doc_id long, text string")
    assert sorted((r.start, r.doc_id) for r in token_files.encode_to_files(null, tokenizer, 49_408).collect()) == [(0, None), (2, 2), (4, 2)]


# 2 revisits


def plain_canonical(url):
    m = re.match(r"(?i)^https?://([^/?]+)([^?]*)(\?.*)?$", re.sub("#.*$", "", url.strip()))
    if not m:
        return url.strip()
    host = re.sub(r"^(www|m)\.|:(80|443)$", "", m[1].lower())
    kept = sorted(p for p in (m[3] or "?")[1:].split("&") if p and not re.match(r"(?i)^(utm_[a-z]+|ref|fbclid|gclid|sessionid)(=|$)", p))
    return "https://" + host + m[2].rstrip("/") + ("?" + "&".join(kept) if kept else "")


def test_canonical_urls(spark):
    urls = ["HTTP://WWW.A.com:80/X/?b=2&a=1&utm_source=q#f", "https://a.com", "https://a.com/", "https://m.a.com/x?ref=1", "ftp://x/y", "http://a.com?z", None, " https://a.com/p//  ", "https://a.com/?refer=1"]
    got = spark.createDataFrame([(u,) for u in urls], "u string").select("u", revisits.canonical_url(F.col("u")).alias("c")).collect()
    assert {r.u: r.c for r in got} == {u: None if u is None else plain_canonical(u) for u in urls}


def test_resolve_against_plain_search(spark):
    rng = random.Random(2)
    schema = "record_id string, type string, uri string, date timestamp, status int, headers map<string,string>, payload_digest string, canonical_url string, verdict int"
    import datetime as dt

    t0 = dt.datetime(2024, 1, 1)
    recs = []
    for i in range(400):
        kind = rng.choice(["response", "revisit", "revisit", "request"])
        headers = {k: v for k, v in (("ETag", rng.choice(['"a"', 'W/"a"', '"b"', None])), ("last-modified", rng.choice(["d1", "d2", None])), ("Cache-Control", str(i)), ("X", str(i))) if v is not None}
        uri = rng.choice(["http://a.com/p", "https://www.a.com/p/", "http://a.com/p?utm_x=1", "http://b.com", None])
        date = None if rng.random() < 0.03 else t0 + dt.timedelta(hours=rng.randint(0, 200))
        recs.append((f"r{i:04d}", kind, uri, date, rng.choice([200, 200, 404]) if kind == "response" else 304, rng.choice([headers, headers, headers, None]), f"p{i}" if kind == "response" else None, "x", 1))
    df = spark.createDataFrame([*recs, next(r for r in recs if r[1] == "revisit")], schema)
    got = {r.record_id: r for r in revisits.resolve(df).collect()}
    assert revisits.resolve(df).count() == 1 + sum(r[1] == "revisit" for r in recs) and revisits.resolve(df.limit(0)).count() == 0
    for r in (r for r in recs if r[1] == "revisit"):
        before = [x for x in recs if x[1] == "response" and x[4] == 200 and r[2] and x[2] and plain_canonical(x[2]) == plain_canonical(r[2]) and r[3] and x[3] and x[3] < r[3]]
        m = max(before, key=lambda x: (x[3], x[0]), default=None)
        low = lambda h: {k.lower(): v for k, v in (h or {}).items()}
        if m is None:
            want = "missing"
        else:
            a, b = low(r[5]), low(m[5])
            tag = [re.sub("^W/", "", x["etag"]) if "etag" in x else None for x in (a, b)]
            day = [x.get("last-modified") for x in (a, b)]
            want = ("etag" if tag[0] == tag[1] else "changed") if all(tag) else ("last-modified" if day[0] == day[1] else "changed") if all(day) else "unchecked"
        g = got[r[0]]
        assert (g.verdict, g.match_id) == (want, m and m[0])
        if want in ("etag", "last-modified", "unchecked"):
            assert g.payload_digest == m[6] and g.headers == low(m[5]) | {k: v for k, v in low(r[5]).items() if k in revisits.PERMITTED}
        else:
            assert g.payload_digest is None and g.headers is None


def test_headers_profiles_and_odd_columns(spark):
    import datetime as dt

    t = [dt.datetime(2024, 1, 1) + dt.timedelta(minutes=i) for i in range(9)]
    p = "http://netpreserve.org/warc/1.0/revisit/"
    rows = [
        ("a", "response", "http://x.com", t[0], 200, {"Set-Cookie": "1", "set-cookie": "2", "ETag": "q", "X": None}, "d", None, 1),
        ("b", "revisit", "http://x.com/", t[1], 304, {"etag": "q", "ETag": "q", "Cache-Control": "b", "cache-control": "a"}, None, p + "server-not-modified", 1),
        ("c", "revisit", "http://x.com/", t[2], 200, {"A": "1"}, "own", p + "identical-payload-digest", 1),
        ("d", "revisit", "http://x.com/", t[3], 200, None, "own2", None, 1),
        ("e", "revisit", "http://x.com/", t[4], None, None, None, None, 1),
    ]
    df = spark.createDataFrame(rows, "record_id string, type string, uri string, date timestamp, status int, headers map<string,string>, payload_digest string, profile string, url int")
    got = {r.record_id: r for r in revisits.resolve(df).collect()}
    assert got["b"].verdict == "etag" and got["b"].headers == {"set-cookie": "1, 2", "etag": "q", "cache-control": "b, a"}
    assert (got["c"].verdict, got["c"].match_id, got["c"].payload_digest, got["c"].headers) == ("other", None, "own", {"a": "1"})
    assert (got["d"].verdict, got["d"].payload_digest) == ("other", "own2") and (got["e"].verdict, got["e"].match_id) == ("unchecked", "a")


# 3 mixing


def test_rake_meets_marginals():
    rng = np.random.default_rng(1)
    n = rng.integers(1, 1000, 60).astype(float)
    groups = [np.repeat(np.arange(5), 12), np.tile(np.repeat(np.arange(4), 3), 5), np.tile(np.arange(3), 20)]
    targets = [rng.dirichlet(np.ones(k)) for k in (5, 4, 3)]
    w, residual = mixing.rake(n, groups, targets)
    for g, t in zip(groups, targets, strict=True):
        assert np.allclose(np.bincount(g, w * n) / n.sum(), t, atol=1e-6)
    assert residual < 1e-6 and np.allclose(w, plain_rake(n, groups, targets), rtol=1e-5)
    w, residual = mixing.rake(n, groups, targets, most=1.5)
    assert w.max() <= 1.5 and residual > 1e-3 and (mixing.rake(np.zeros(3), [np.arange(3)], [np.ones(3) / 3])[0] == 1).all()


def plain_rake(tokens, groups, targets):
    w = [1.0] * len(tokens)
    for _ in range(500):
        for g, t in zip(groups, targets, strict=True):
            now = [sum(w[c] * tokens[c] for c in range(len(w)) if g[c] == k) for k in range(len(t))]
            w = [x * t[g[c]] * sum(tokens) / now[g[c]] for c, x in enumerate(w)]
    return w


def test_mix_with_clashing_names(spark):
    rows = [(i, "a b", "s", 1, 2, 3, 4.0) for i in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, mix_weight int, mix_source int, _mix_source int, mix_copies double")
    out = mixing.mix(df, {"source": {"s": 1.0}}, 0.5)
    assert len(set(out.columns)) == len(out.columns) and {r.mix_weight for r in out.collect()} == {0.5} and {r._mix_source for r in out.collect()} == {3}
    kept = mixing.mix(df, {"source": {"s": 1.0}}, 0.5, prefix="zz_").collect()
    assert {(r.mix_weight, r.mix_copies, r.zz_weight) for r in kept} == {(1, 4.0, 0.5)}


def test_mix(spark, docs, rows):
    targets = {"source": 0.5, "lang": {"en": 0.7, "de": 0.3}, "topic": {"prose": 1.0}}
    out = mixing.mix(docs, targets, budget=0.6).collect()
    assert len(out) == len(rows)
    total = sum(r.mix_tokens for r in out)
    assert total == sum(len(WORD.findall((r[1] or "").encode())) for r in rows)
    en = sum(r.mix_tokens * r.mix_weight for r in out if r.lang == "en")
    de = sum(r.mix_tokens * r.mix_weight for r in out if r.lang == "de")
    assert abs(en / (en + de) - 0.7) < 1e-6 and abs((en + de) / total - 0.6) < 1e-6
    assert all(r.mix_copies in (int(r.mix_weight), int(r.mix_weight) + 1) for r in out)
    assert max(r.mix_weight for r in mixing.mix(docs, targets, 0.9, repeat=False).collect()) <= 1 + 1e-9
    assert mixing.mix(docs.limit(0), targets).count() == 0


def test_draws_follow_the_weights(spark):
    big = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit("a b c").alias("text"), F.when(F.col("id") % 3 == 0, "hot").otherwise("s").alias("source"))
    out = mixing.mix(big, {"source": {"hot": 0.8, "s": 0.2}}, budget=1.0).groupBy("source").agg(F.avg("mix_copies").alias("c"), F.avg("mix_weight").alias("w")).collect()
    assert all(abs(r.c - r.w) < 0.02 for r in out)


# 4 packing


@pytest.mark.parametrize("seed", range(6))
def test_plan_uses_all_and_fills(seed):
    rng = np.random.default_rng(seed)
    size = 256
    lengths = [rng.integers(1, 257, 600), rng.geometric(0.02, 3000).clip(1, 256), np.full(50, 200), np.full(9, 1), np.r_[np.full(30, 130), np.full(30, 126)], rng.integers(1, 20, 4000)][seed]
    patterns = packing.plan(np.bincount(lengths, minlength=size + 1), size)
    used = np.zeros(size + 1, int)
    for parts, times in patterns:
        assert sum(length * k for length, k in parts) <= size and times > 0
        for length, k in parts:
            used[length] += k * times
    assert (used == np.bincount(lengths, minlength=size + 1)).all()
    bound = max(-(-int(lengths.sum()) // size), int((lengths * 2 > size).sum()))
    assert sum(t for _, t in patterns) <= bound * 1.02 + 1


def test_pack_documents(docs, rows, tokenizer):
    out = packing.pack_documents(docs, tokenizer, 64).collect()
    by_doc = {r[0]: ids for r, ids in zip(rows, reference_ids(tokenizer, [r[1] for r in rows]), strict=True)}
    assert sorted((r.doc_id, r.piece) for r in out) == sorted((d, p) for d, ids in by_doc.items() for p in range(-(-len(ids) // 64)))
    places = {}
    for r in out:
        ids = by_doc[r.doc_id][r.start : r.start + r.length]
        assert r.start == 64 * r.piece and len(ids) == r.length and crc(ids) == r.ids_crc32
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for p in places.values():
        assert [o for o, _ in sorted(p)] == [0, *itertools.accumulate(n for _, n in sorted(p))][:-1] and sum(n for _, n in p) <= 64
    assert packing.pack_documents(docs.limit(0), tokenizer, 64).count() == 0


def test_pack_pieces_of_odd_tables(spark, monkeypatch):
    monkeypatch.setattr(packing, "ROWS_PER_PART", 40)
    rows = [(None, 3, "x", 5, 1)] * 100 + [(i, 1 + i % 7, None, i, 2) for i in range(90)]
    out = packing.pack_pieces(spark.createDataFrame(rows, "doc_id long, length long, _rank string, _part int, sequence_id long"), 10)
    assert out.columns == ["doc_id", "length", "_rank", "_part", "sequence_id", "offset"]
    found = out.collect()
    assert sorted(str(tuple(r)[:4]) for r in found) == sorted(str(r[:4]) for r in rows)
    assert len({(r.sequence_id, r.offset) for r in found}) == len(rows) and max(r.offset + r.length for r in found) <= 10


def test_complements_are_found_while_they_last():
    rng = np.random.default_rng(8)
    for _ in range(60):
        counts = (rng.random(31) < 0.3) * rng.integers(1, 3, 31)
        counts[0] = 0
        index = packing.ComplementIndex(counts)
        bag = [n for n in range(31) for _ in range(counts[n])]
        sums = {k: {sum(c) for c in itertools.combinations(bag, k)} for k in (1, 2, 3)}
        for gap in range(1, 31):
            for _ in range(2):
                assert (index.pair(gap) is not None) == (gap in sums[2]) and (index.triple(gap) is not None) == (gap in sums[3])
                found = index.exact(gap)
                assert (found is not None) == any(gap in s for s in sums.values()) and (found is None or sum(found) == gap)


# 5 near-duplicates


def plain_simhash(text):
    words = WORD.findall((text or "").encode().lower())
    grams = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    import xxhash

    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << i for i in range(64) if 2 * sum(h >> i & 1 for h in hashes) > len(hashes))


def plain_components(fps, most=3):
    label = list(range(len(fps)))
    changed = True
    while changed:
        changed = False
        for i, j in itertools.combinations(range(len(fps)), 2):
            if (fps[i] ^ fps[j]).bit_count() <= most and label[i] != label[j]:
                label[i] = label[j] = min(label[i], label[j])
                changed = True
    return label


def planted(seed, n=300):
    rng = random.Random(seed)
    fps = [rng.getrandbits(64) for _ in range(n // 3)]
    while len(fps) < n:
        f = rng.choice(fps)
        for b in rng.sample(range(64), rng.randint(1, 4)):
            f ^= 1 << b
        fps.append(f)
    return sorted(set(fps))


@pytest.mark.parametrize("seed", range(3))
def test_leaf_links_are_all_pairs(seed):
    fps = np.array(planted(seed), np.uint64)
    got = {tuple(sorted(p)) for p in simhash.leaf_links(fps, 3).tolist()}
    assert got == {(i, j) for i, j in itertools.combinations(range(len(fps)), 2) if int(np.bitwise_count(fps[i] ^ fps[j])) <= 3}


@pytest.mark.parametrize("leaf", [2, 8, 4096])
def test_link_edges_connect_what_links_connect(spark, leaf):
    fps = planted(9)
    df = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f, i) for i, f in enumerate(fps)], "fp long, id long")
    named = {r.node: r.component for r in components.components(simhash.link_edges(df, 3, leaf)).collect()}
    assert [named.get(i, i) for i in range(len(fps))] == plain_components(fps)


def test_near_duplicates(spark, docs, rows):
    got = sorted(tuple(r) for r in simhash.near_duplicates(docs).collect())
    fps = [plain_simhash(r[1]) for r in rows]
    assert got == [(r[0], f"{f:016x}", rows[c][0]) for r, f, c in zip(rows, fps, plain_components(fps), strict=True)]
    assert simhash.near_duplicates(docs.limit(0)).count() == 0
    repeat = spark.createDataFrame([(1, "a"), (1, "a"), (None, "a"), (None, "zz yy"), (2, "A")], "doc_id long, text string")
    assert sorted((r.doc_id or 0, r.component_id or 0) for r in simhash.near_duplicates(repeat).collect()) == [(0, 0), (0, 1), (1, 1), (1, 1), (2, 1)]


def plain_groups(rows):
    """Smallest id of each text's group (None if it has none), by comparing all shingle sets."""
    def shingles(text):
        w = [x.lower() for x in WORD.findall((text or "").encode())]
        k = min(5, len(w))
        return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set()

    texts = list(dict.fromkeys(t for _, t in rows))
    sets, label = [shingles(t) for t in texts], list(range(len(texts)))
    for i, j in itertools.combinations(range(len(texts)), 2):
        both = len(sets[i] & sets[j])
        if 5 * both >= 4 * (len(sets[i]) + len(sets[j]) - both):
            a, b = label[i], label[j]
            label = [a if x == b else x for x in label]
    least = {}
    for doc, text in rows:
        g = label[texts.index(text)]
        least[g] = min((x for x in (least.get(g), doc) if x is not None), default=None)
    return {t: least[label[i]] for i, t in enumerate(texts)}


def test_keep_one(spark, docs, rows):
    kept = near_dups.keep_one(docs)
    groups = plain_groups([r[:2] for r in rows])
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [r[0] for r in rows if groups[r[1]] == r[0]]
    assert near_dups.keep_one(docs.limit(0)).count() == 0
    clash = docs.withColumns({"node": F.lit(1), "least": F.lit(2), "fp": F.lit("x"), "u": F.lit(1)})
    assert near_dups.keep_one(clash).count() == kept.count()
    twice = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (1, "x y z"), (2, "A b  c d e f"), (3, "x y z")], "doc_id long, text string")
    assert sorted(tuple(r) for r in near_dups.keep_one(twice).collect()) == [(1, "a b c d e f"), (1, "a b c d e f"), (1, "x y z")]


def test_near_copies_of_all_similarities(spark):
    rng = random.Random(12)
    word = lambda: "".join(rng.choices("abcdefghij", k=5))
    rows = []
    for i in range(240):
        base = [word() for _ in range(rng.choice([80, 200, 500]))]
        rows.append((10 * i, " ".join(base)))
        for k in range(1, rng.choice([2, 2, 6])):
            copy = list(base)
            for at in rng.sample(range(len(base)), max(1, int(len(base) * rng.choice([0.002, 0.01, 0.02, 0.04])))):
                copy[at] = word()
            rows.append((10 * i + k, " ".join(copy)))
    groups = plain_groups(rows)
    want = {d for d, t in rows if groups[t] != d}
    gone = {d for d, _ in rows} - {r.doc_id for r in near_dups.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert gone <= want and len(gone) >= 0.95 * len(want) and len(want) > 100


def edited(words, at, word):
    return [word() if i in at else w for i, w in enumerate(words)]


def test_no_link_of_a_dense_group_is_lost(spark):
    """Each text of an odd id is linked to the one before it alone, among hundreds of nearly as near ones."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choices("abcdefghij", k=5))
    base, rows = [word() for _ in range(400)], []
    for i in range(220):
        at = rng.sample(range(8, 392, 5), 15)
        first = edited(base, at[:7], word)
        rows += [(2 * i, " ".join(first)), (2 * i + 1, " ".join(edited(first, at[7:], word)))]
    groups = plain_groups(rows)
    assert all(groups[t] == d - d % 2 for d, t in rows)
    kept = near_dups.keep_one(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(r.doc_id for r in kept.collect()) == [2 * i for i in range(220)]


def test_links_that_the_index_has_not_met_are_found(spark, rows):
    """With an index of equal fingerprints alone groups are those of brute force: short texts, copies, texts without words, and near copies of all sizes."""
    rng = random.Random(6)
    word = lambda: "".join(rng.choices("abcdefghij", k=4))
    passage = " ".join(word() for _ in range(30))
    table = [(r[0], r[1]) for r in rows] + [(70_000 + i, t) for i, t in enumerate(["", " ", "\t \n", "one", "ONE", "one two", "One  two"])]
    for i in range(90):
        words = [word() for _ in range(rng.choice([8, 30, 120, 400]))] + passage.split()
        share = rng.choice([0.0, 0.02, 0.04])
        copy = [w for w in edited(words, set(rng.sample(range(len(words)), int(share * len(words)))), word)] + [word() for _ in range(rng.randint(0, len(words) // 5))]
        table += [(80_000 + 2 * i, " ".join(words)), (80_001 + 2 * i, " ".join(copy))]
    groups = plain_groups(table)
    kept = near_dups.keep_one(spark.createDataFrame(table, "doc_id long, text string"), most=0)
    got, want = sorted(r.doc_id for r in kept.collect() if r.doc_id is not None), sorted(d for d, t in table if d is not None and groups[t] == d)
    assert got == want and len(want) < len(table) - 50


def rows_made(spark, since, pattern):
    """Output rows of all nodes of the plans run since then (a number of executions) whose name or description matches."""
    store, total = spark._jsparkSession.sharedState().statusStore(), 0
    runs = store.executionsList()
    for e in (runs.apply(k).executionId() for k in range(since, runs.size())):
        values, nodes = store.executionMetrics(e), store.planGraph(e).allNodes()
        for node in (nodes.apply(k) for k in range(nodes.size())):
            if re.search(pattern, f"{node.name()} {node.desc()}"):
                metrics = [node.metrics().apply(k) for k in range(node.metrics().size())]
                found = [values.get(m.accumulatorId()) for m in metrics if m.name() == "number of output rows"]
                total += sum(int(v.get().replace(",", "")) for v in found if v.isDefined())
    return total


def near_rows(n, edits):
    """n texts of 400 words, each one text with some words of its own: any two have a similarity of about (396 - 10 edits) / (396 + 10 edits)."""
    rng = random.Random(8)
    word = lambda: "".join(rng.choices("abcdefghij", k=5))
    base = [word() for _ in range(400)]
    return [(i, " ".join(edited(base, rng.sample(range(8, 392), edits), word))) for i in range(n)]


def test_texts_too_little_alike_meet_once_a_pair_at_most(spark):
    rows = near_rows(60, 6)
    since = spark._jsparkSession.sharedState().statusStore().executionsList().size()
    kept = near_dups.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).count()
    assert kept == len({least for least in plain_groups(rows).values()}) > 40
    assert 0 < rows_made(spark, since, r"^MapInArrow.*\bmeet\(") <= 60 * 59 // 2


def test_no_row_is_made_for_each_end_of_each_candidate(spark):
    rows = near_rows(120, 3)
    since = spark._jsparkSession.sharedState().statusStore().executionsList().size()
    assert near_dups.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).count() == 1
    assert rows_made(spark, since, "^MapInArrow.*search") > 120 and rows_made(spark, since, "^Generate") <= 120


def test_parities_rule_out_no_similar_pair():
    """Sets differ in as many shingles as their parities in bits, or more, whatever their sizes."""
    rng = np.random.default_rng(2)
    for n in (1, 2, 5, 31, 32, 33, 120, 900):
        a = rng.integers(-(1 << 63), 1 << 63, n)
        b = np.concatenate([a[n // 8 :], rng.integers(-(1 << 63), 1 << 63, n // 6)])
        x, y = (np.frombuffer(prefix_links.parity(s), np.uint64) for s in (a, b))
        assert prefix_links._apart(x, x) == 0 and prefix_links._apart(x, y) == prefix_links._apart(y, x) <= len(set(a.tolist()) ^ set(b.tolist()))
    far = [np.frombuffer(prefix_links.parity(rng.integers(-(1 << 63), 1 << 63, 900)), np.uint64) for _ in "ab"]
    assert prefix_links._apart(*far) > 400


def test_minimum_forest_connects_at_every_weight():
    rng = np.random.default_rng(4)
    pairs = np.array(list(itertools.combinations(range(40), 2)))[rng.permutation(780)[:300]]
    weights = rng.integers(0, 15, 300)
    forest = near_dups.minimum_forest(40, pairs, weights)
    assert len(forest) == len(set(forest.tolist())) < 40
    for most in range(15):
        every, few = (simhash._forest(40, pairs[sel][weights[sel] <= most]) for sel in (np.arange(300), forest))
        assert (every == few).all()
    assert near_dups.chosen_pairs(40, pairs[:20], weights[:20]).tolist() == pairs[:20].tolist() and len(near_dups.chosen_pairs(40, pairs, weights)) <= 120


def test_null_ids_are_decided_one_by_one(spark):
    words = lambda seed: " ".join(random.Random(seed).choices("abcdefghijklmnop", k=300))
    far = "alone under a null id"
    rows = [(1, words(1)), (None, words(1)), (None, words(2)), (None, far), (2, words(3))]
    kept = [(r.doc_id, r.text) for r in near_dups.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert sorted(kept, key=str) == sorted([rows[0], rows[2], rows[3], rows[4]], key=str)
    # a fingerprint that only a null id has links like any other: 7 - null - 9, two bits each time
    prints = spark.createDataFrame([(7, 0), (None, 0b11 << 20), (9, 0b1111 << 20), (None, -1), (None, -2)], "doc_id long, fp long")
    assert {r.fp: r.component_id for r in simhash._groups(prints, 3, 2048).collect()} == {0: 7, 3 << 20: 7, 15 << 20: 7, -1: None, -2: None}


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 100), (7, 3), (3, 7), (200, 201), (None, 5)] + [(500, i) for i in range(501, 700)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**dict.fromkeys(range(41), 0), 200: 200, 201: 200, **dict.fromkeys(range(500, 700), 500)}
    assert components.components(spark.createDataFrame([], "u long, v long")).count() == 0


# 6 winnowing


def plain_winnow(text, k, w):
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    k = min(k, len(points)) if len(points) else k
    h = [int(winnow.gram_hashes(points[i : i + k], k)[0]) for i in range(len(points) - k + 1)] if len(points) else []
    w = min(w, len(h))
    return sorted({max(range(i, i + w), key=lambda j: (-h[j], j)) for i in range(len(h) - w + 1)}) if h else []


def test_winnowing_is_plain_winnowing():
    rng = random.Random(3)
    for n in (0, 1, 5, 15, 99, 100, 140, 400):
        text = "".join(rng.choices("ab é", k=n))
        assert winnow.fingerprint(text)[1].tolist() == plain_winnow(text, winnow.K, winnow.WINDOW)


def test_long_texts_in_blocks(monkeypatch):
    text = "".join(random.Random(4).choices("abcdef ", k=5000))
    whole = winnow.fingerprint(text)
    monkeypatch.setattr(winnow, "BLOCK", 700)
    parts = winnow.fingerprint(text)
    assert all((a == b).all() for a, b in zip(whole, parts, strict=True))


def test_shared_passage_is_always_found():
    rng = random.Random(6)
    for _ in range(30):
        shared = "".join(rng.choices("abcdefgh", k=winnow.WINDOW + winnow.K - 1))
        a, b = ("".join(rng.choices("xyz", k=rng.randint(90, 200))) + shared + "".join(rng.choices("uvw", k=rng.randint(0, 90))) for _ in range(2))
        assert len(np.intersect1d(winnow.fingerprint(a)[0], winnow.fingerprint(b)[0]))


def test_likeness_across_lengths(spark):
    rng = random.Random(8)
    text = "".join(rng.choices("abcdefgh ", k=140))
    for n in (60, 95, 99, 100, 105):  # a beginning and the text, on either side of 100 code points
        assert winnow.likeness(winnow.hash_set(text[:n]), winnow.hash_set(text[: n + 6])) > 0.4
    rows = [(1, text[:120]), (2, "short"), (3, text[:99]), (4, text[:101])]
    got = {r.doc_id: r for r in winnow.compare_edited(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1].near_edited > 0.4 and got[3].near_next > 0.4  # the edited text of 1 has 95 code points


@pytest.mark.parametrize("per_chunk", [1, 7, 1000])
def test_compare_edited(spark, docs, rows, per_chunk):
    got = {r.doc_id: r for r in winnow.compare_edited(docs, per_chunk).collect()}
    assert len(got) == len(rows)
    texts = [r[1] or "" for r in rows]
    for i, r in enumerate(rows):
        n = len(texts[i]) // 4
        edited = texts[i][: len(texts[i]) - n] + texts[(i + 1) % len(rows)][:n]
        g = got[r[0]]
        assert (g.n_chars, g.edited_sha256) == (len(texts[i]), hashlib.sha256(edited.encode()).hexdigest())
        sets = [set(winnow.hash_set(t).tolist()) for t in (texts[i], edited, texts[(i + 1) % len(rows)])]
        like = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
        points = [ord(c) for c in texts[i]]
        hashes = [int(g.fingerprint[8 * j : 8 * j + 8], 16) for j in range(g.n_hashes)]
        grams = winnow.gram_hashes(np.array(points, np.uint32))
        assert g.positions is not None and [int(grams[p]) >> 32 for p in g.positions] == hashes
        assert abs(g.near_edited - like(sets[0], sets[1])) < 1e-12 and abs(g.near_next - like(sets[0], sets[2])) < 1e-12
    assert winnow.compare_edited(docs.limit(0)).count() == 0
    odd = spark.createDataFrame([(None, "b"), (None, "a"), (1, "c"), (1, "c")], "doc_id long, text string")
    assert winnow.compare_edited(odd, per_chunk).count() == 4


def test_an_id_of_many_rows_is_split(spark, tokenizer):
    rows = [(None if i % 3 else 7, f"text {i} " + "x" * (i % 50)) for i in range(300)] + [(i, f"other {i}") for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    chunks = common.id_chunks(docs, 20)
    at = chunks.of(pa.array([r[0] for r in rows], pa.int64()), np.array([r.h for r in docs.select(F.xxhash64("text").alias("h")).collect()], np.int64))
    assert len(chunks) >= 10 and np.bincount(at).max() <= 60
    assert sorted(r.start for r in token_files.read_token_files(token_files.write_token_files(docs, common.scratch_path(spark, "t"), tokenizer, 49_408, 20)).collect())[0] == 0
    got = winnow.compare_edited(docs, 20).collect()
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    assert sorted(str(r.doc_id) for r in got) == sorted(str(r[0]) for r in order)
    hashes = {r.text: r.h for r in docs.select("text", F.xxhash64("text").alias("h")).collect()}
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, hashes[r[1]]))
    shas = []
    for (_, own), (_, after) in zip(order, order[1:] + order[:1], strict=True):
        n = len(own) // 4
        shas.append(hashlib.sha256((own[: len(own) - n] + after[:n]).encode()).hexdigest())
    assert sorted(r.edited_sha256 for r in got) == sorted(shas)


# 7 quality


def plain_stats(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    covered = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(3)}
    lines, seen = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)], set()
    dup = sum(x in seen or seen.add(x) is not None for x in lines)
    return [len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered)]


def test_rule_statistics(rows):
    for text in [r[1] for r in rows if r[1] != "word " * 9000] + ["a b c a b c x\nq\nq\n\n \nq #$", "a b a b a b"]:
        want = plain_stats(text)
        if not want[0]:
            want = [0] * 5
        assert quality.text_stats(text)[0] == want


def test_forest_and_threshold(spark):
    rng = np.random.default_rng(0)
    good, bad = rng.normal(0, 1, (3000, 4)), rng.normal(8, 1, (60, 4))
    good[:, 3] = 0.0  # constant in good rows
    x = np.vstack([good, bad])
    forest = quality.fit_forest(good, np.stack([x.min(0), x.max(0)]))
    s = forest.score(x)
    most = quality.threshold_for(s, np.arange(len(x)) < 3000)
    assert (s[:3000] > most).mean() <= 0.006 and (s[3000:] > most).all()


def test_quality_query(spark, docs):
    rng = random.Random(8)
    good = [(1000 + i, " ".join("".join(rng.choices("abcde", k=rng.randint(2, 8))) for _ in range(90)) + ".") for i in range(300)]
    bad = [(2000 + i, " ".join("".join(rng.choices("abc", k=4)) + "###$$$" for _ in range(90))) for i in range(40)]
    table = docs.select("doc_id", "text").union(spark.createDataFrame(good + bad, "doc_id long, text string"))
    labels = spark.createDataFrame([(i, 1) for i, _ in good[:200]] + [(i, 0) for i, _ in bad[:20]] + [(None, 1), (99999, 0), (1000, None)], "doc_id long, quality int")
    got = {r.doc_id: r for r in quality.quality(table, labels).collect()}
    assert got[0].base_failed and not got[0].kept and got[0].n_words == 0
    assert sum(got[i].kept for i, _ in good) >= 290 and not any(got[i].kept for i, _ in bad)
    kept = quality.keep_good(table.withColumn("extra", F.lit(1)), labels)
    assert {r.doc_id for r in kept.collect()} == {i for i, r in got.items() if r.kept} and kept.columns == ["doc_id", "text", "extra"]
    none = quality.quality(table, labels.limit(0))
    assert none.filter("kept = base_failed").count() == 0 and quality.quality(table.limit(0), labels).count() == 0


def test_every_labelled_row_counts_in_the_fit(spark):
    """Forest, threshold and verdicts equal those of all 24,000 labelled rows at once."""
    rng = np.random.default_rng(3)
    x = np.round(rng.gamma(2.0, 1.0, (24_000, len(quality.FEATURES))), 3)
    good = rng.random(24_000) < 0.9
    x[~good] += rng.gamma(2.0, 1.5, (int((~good).sum()), len(quality.FEATURES)))
    rows = [(i, 90, 400, 0, 0, 0, f) for i, f in enumerate(x.tolist())]
    counted = spark.createDataFrame(rows, "doc_id long, " + ", ".join(f"{c} long" for c in quality.BASE) + ", features array<double>").repartition(6)
    labels = spark.createDataFrame([(i, int(g)) for i, g in enumerate(good.tolist())], "doc_id long, quality int")
    forest = quality.fit_forest(x[good], np.stack([x.min(0), x.max(0)]))
    scores = forest.score(x)
    most = quality.threshold_for(scores, good)
    got = sorted((r.doc_id, r.score, r.kept) for r in quality.judge(counted, labels).select("doc_id", "score", "kept").collect())
    assert [r[1] for r in got] == scores.tolist() and [r[2] for r in got] == (scores <= most).tolist()
    # leaves hold all rows, and inner nodes more than one in PARTS of them
    at = forest.count(x[good])
    assert at[forest.feature < 0].sum() == quality.TREES * good.sum() and not at[forest.feature >= 0].any()
    held = at.copy()
    for node in range(len(held) - 1, -1, -1):
        if forest.feature[node] >= 0:
            held[node] = held[forest.left[node]] + held[forest.right[node]]
    assert (held[forest.roots] == good.sum()).all() and (held[forest.feature >= 0] * quality.PARTS > good.sum()).all()


# 8 sharding


def plain_jump(key, n):
    key &= (1 << 64) - 1
    b, j = -1, 0
    while j < n:
        b = j
        key = (key * 2862933555777941757 + 1) & ((1 << 64) - 1)
        j = int((b + 1) * ((1 << 31) / ((key >> 33) + 1)))
    return b


@pytest.mark.parametrize("n", [1, 2, 8, 33, 1000])
def test_jump_hash(spark, n):
    keys = [0, 1, -1, 2**63 - 1, -(2**63), *(random.Random(n + i).randint(-(2**63), 2**63 - 1) for i in range(300))]
    got = spark.createDataFrame([(k,) for k in keys], "k long").select("k", sharding.jump_hash(F.col("k"), n).alias("s")).collect()
    assert all(r.s == plain_jump(r.k, n) for r in got)


def test_assign_shards(spark, docs, rows):
    odd = docs.unionByName(docs.filter("doc_id = 15")).unionByName(docs.filter("doc_id = 3").withColumn("doc_id", F.lit(None).cast("long")))
    out = sharding.assign_shards(odd).collect()
    assert len(out) == len(rows) + 2
    for s in range(8):
        mine = sorted((r.slot, -1 if r.doc_id is None else r.doc_id) for r in out if r.shard == s)
        assert [x for x, _ in mine] == list(range(len(mine))) and [d for _, d in mine] == sorted(d for _, d in mine)
    text = {r[0]: r[1] for r in rows}
    for r in out:
        assert r.grown_shard in (r.shard, 8)
        if r.doc_id is not None:
            raw = (text[r.doc_id] or "").encode()
            assert (r.size, r.text_crc32) == (len(raw) + 1, zlib.crc32(raw))
    assert sharding.assign_shards(docs.limit(0)).count() == 0


# 9 language model


def test_codes_and_gradient_free_start():
    codes, counts = pseudo_lm.encode_words(pa.array([None, "", " a b ", "A"]))
    assert counts.tolist() == [0, 0, 2, 1] and len(codes) == 3 and codes[0] == codes[2]
    column = pa.array([b"", b"", codes[:2].tobytes(), codes[2:].tobytes()])
    for part, want in ((column, [0, 0, 2, 1]), (column.slice(2), [2, 1]), (column.slice(0, 2), [0, 0])):
        out, n = pseudo_lm.padded(part)
        assert n.tolist() == want and len(out) == sum(want) + 2 * (len(want) + 1) and (out[out != pseudo_lm.PAD] == codes[: sum(want)]).all()
    p = pseudo_lm.start(np.bincount(codes, minlength=pseudo_lm.CODES))
    assert (pseudo_lm.flatten(pseudo_lm.restore(pseudo_lm.flatten(p))) == pseudo_lm.flatten(p)).all()


def test_probabilities_sum_to_one():
    p = pseudo_lm.start(np.ones(pseudo_lm.CODES))
    around = np.array([5, 6, 0, 7, 8], np.int32)
    total = 0.0
    for c in range(0, pseudo_lm.CODES):
        around[2] = c
        total += float(np.exp(pseudo_lm.log_probabilities(p, around, np.array([2]))[0])) if c % 64 == 0 else 0.0
    assert 0 < total < 1
    every = np.array([np.r_[5, 6, c, 7, 8] for c in range(pseudo_lm.CODES)], np.int32).ravel()
    logs = pseudo_lm.log_probabilities(p, np.r_[every, 9, 9].astype(np.int32), np.arange(pseudo_lm.CODES) * 5 + 2)
    assert abs(np.exp(logs.astype(float)).sum() - 1) < 1e-3


def test_model_learns_both_sides(spark):
    rng = random.Random(7)
    pairs = {c: c.upper() * 2 + "z" for c in "abcdefghij"}
    text = lambda: " ".join(w for c in rng.choices("abcdefghij", k=40) for w in (c, pairs[c] + "mid", c + "end"))
    rows = [(i, text()) for i in range(1500)] + [(9000, " ".join(rng.sample(text().split(), 120))), (9001, None), (9002, "")]
    got = {r.doc_id: r for r in pseudo_lm.pseudo_likelihood(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    good = np.mean([got[i].mean_log_prob for i in range(1500)])
    assert len(got) == 1503 and got[9000].mean_log_prob < good - 0.5 and good > -2.6  # frequencies alone give about -3.4
    assert got[9001].n_words == 0 and got[9001].pll == 0 and got[9002].mean_log_prob is None
    assert pseudo_lm.pseudo_likelihood(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def plain_log_probability(p, codes, i):
    """Of the code at place i from its four neighbours, by plain sums."""
    h = [sum(p["embed"][codes[i + d]][k] * p["place"][j][k] for j, d in enumerate(pseudo_lm.WINDOW)) + p["hidden"][k] for k in range(pseudo_lm.HIDDEN)]
    h = [math.tanh(x) for x in h]
    c, m = divmod(int(codes[i]), pseudo_lm.MEMBERS)

    def log_share(w, b, chosen):
        z = [sum(h[k] * w[k][j] for k in range(len(h))) + b[j] for j in range(len(b))]
        return z[chosen] - math.log(sum(math.exp(x) for x in z))

    return log_share(p["class"], p["class0"], c) + log_share(p["member"][c], p["member0"][c], m)


def test_scores_are_plain_pseudo_likelihoods(spark):
    texts = ["one two three", "two two one three one", "solo", None, "", "one two three"]
    rows = [(i if i != 5 else None, t, 1.0, "x") for i, t in enumerate(texts)]
    docs = pseudo_lm.encoded(spark.createDataFrame(rows, "doc_id long, text string, pll double, codes string").select("doc_id", "text"))
    rng = np.random.default_rng(0)
    p = {k: (v + rng.normal(0, 0.2, v.shape)).astype(np.float32) for k, v in pseudo_lm.start(np.ones(pseudo_lm.CODES)).items()}
    got = {r.doc_id: r for r in pseudo_lm.score(docs, p).collect()}
    for doc, text, *_ in rows:
        codes = [zlib.crc32(w) % pseudo_lm.CODES for w in WORD.findall((text or "").lower().encode())]
        around = [pseudo_lm.PAD] * 2 + codes + [pseudo_lm.PAD] * 2
        want = sum(plain_log_probability(p, around, i + 2) for i in range(len(codes)))
        assert got[doc].n_words == len(codes) and abs(got[doc].pll - want) < 1e-3 and (not codes or abs(got[doc].mean_log_prob - want / len(codes)) < 1e-3)


def test_steps_follow_the_gradient(monkeypatch):
    rng = np.random.default_rng(3)
    codes = np.r_[pseudo_lm.PAD, pseudo_lm.PAD, rng.integers(0, 300, 40), pseudo_lm.PAD, pseudo_lm.PAD].astype(np.int32)
    at = np.flatnonzero(codes != pseudo_lm.PAD)
    p = {k: (v + rng.normal(0, 0.2, v.shape)) for k, v in pseudo_lm.start(np.ones(pseudo_lm.CODES)).items()}
    grads = {k: np.zeros_like(v) for k, v in p.items()}

    def keep(self, name, grad, rows=slice(None)):
        grads[name][rows] += grad

    monkeypatch.setattr(pseudo_lm.Trainer, "_update", keep)
    pseudo_lm.Trainer(p).step(codes, at)
    loss = lambda: -sum(plain_log_probability(p, codes, i) for i in at) / len(at)
    for name, scale in (("embed", pseudo_lm.CLASSES), ("place", 1), ("hidden", 1), ("class", 1), ("class0", 1), ("member", pseudo_lm.CLASSES), ("member0", pseudo_lm.CLASSES)):
        for place in np.argsort(-np.abs(grads[name]).ravel())[:2]:
            where = np.unravel_index(place, p[name].shape)
            was = p[name][where]
            p[name][where] = was + 1e-4
            up = loss()
            p[name][where] = was - 1e-4
            slope = (up - loss()) / 2e-4
            p[name][where] = was
            assert abs(slope * scale - grads[name][where]) < 1e-3 + 0.02 * abs(slope * scale), name


def test_every_word_is_a_target_once(monkeypatch):
    rng = np.random.default_rng(2)
    codes = np.where(rng.random(5000) < 0.1, pseudo_lm.PAD, rng.integers(0, pseudo_lm.CODES, 5000)).astype(np.int32)
    targets = []
    monkeypatch.setattr(pseudo_lm.Trainer, "step", lambda self, codes, at: targets.extend(at.tolist()))
    trainer = pseudo_lm.Trainer(pseudo_lm.start(np.ones(pseudo_lm.CODES)))
    for turn in range(pseudo_lm.ROUNDS):
        before = len(targets)
        trainer.learn(codes, turn)
        assert len(targets) > before
    assert sorted(targets) == np.flatnonzero(codes != pseudo_lm.PAD).tolist()


# 10 toxicity


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
            if i > 1 and j > 1 and a[i - 2] == y and b[j - 2] == x:
                new[-1] = min(new[-1], last[j - 2] + 1)
        last, row = row, new
    return row[-1]


def test_automaton_finds_all_within_one_edit():
    words = {"idiot": 5.0, "moron": 5.0, "scum": 4.0, "mormon": 3.0}
    rng = random.Random(1)
    automaton = toxicity.Automaton(toxicity.Lexicon(words=words, stems={"trash": 2.0}))
    for _ in range(3000):
        w = list(rng.choice(list(words)))
        for _ in range(rng.randint(0, 2)):
            k = rng.randrange(len(w) + 1)
            if rng.random() < 0.3:
                w[k : k + 2] = w[k : k + 2][::-1]
            else:
                w[k : k + rng.randint(0, 1)] = rng.choice(["", "x", "o", "m"])
        w = "".join(w)
        near = [t for t in words if distance(w, t) <= (1 if len(t) >= toxicity.FUZZY else 0)]
        hit = automaton.find(w)
        assert (hit is not None) == bool(near) and (w not in words or hit[:2] == ("word", w))
    for w, near in (("tarshing", True), ("trahsy", True), ("trxshed", True), ("trshing", True), ("txxshed", False), ("trasq", False), ("tras", False)):
        assert (automaton.find(w) is not None) == near, w
    assert automaton.find("tarshing")[:2] == ("fuzzy", "trash")
    assert automaton.find("trash") is None and automaton.find("trashy")[0] == "stem" and automaton.find("") is None


def test_quotation_counts_apart():
    automaton = toxicity.Automaton(toxicity.Lexicon(words={"idiot": 5.0}))
    plain, quoted, told = (toxicity.features(t, automaton) for t in ("you are an idiot today", 'he used "idiot" there', "she said idiot there"))
    assert plain[0] > 0 and plain[3] == 0 and quoted[0] == told[0] == 0 and quoted[3] > 0 and told[3] > 0
    assert toxicity.features(None, automaton) == toxicity.features("", automaton) == [0.0] * len(toxicity.FEATURES)


def test_toxicity(spark):
    rng = random.Random(3)
    clean = lambda: " ".join("".join(rng.choices("abcdeou", k=5)) for _ in range(60))
    rows = [(i, clean() + (" you worthless cretin " + clean() if i % 5 == 0 else "")) for i in range(600)] + [(5000, None), (5001, ""), (None, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(600)] + [(None, 1)], "doc_id long, toxic int")
    got = toxicity.toxicity(docs, labels).collect()
    assert len(got) == 603 and all(0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.held_out]
    assert {r.doc_id for r in held} == {i for i, _ in rows if i is not None and zlib.crc32(str(i).encode()) % 4 == 2}
    assert np.mean([r.predicted == (r.doc_id % 5 == 0) for r in held if r.doc_id < 600]) > 0.97
    flipped = labels.withColumn("toxic", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert sorted((r.doc_id or -1, r.score) for r in toxicity.toxicity(docs, flipped).collect()) == sorted((r.doc_id or -1, r.score) for r in got)
    assert all(r.score < 0.3 for r in toxicity.toxicity(docs, labels.filter("toxic = 0")).collect()) and toxicity.toxicity(docs.limit(0), labels).count() == 0


def test_scratch_follows_the_session(spark, monkeypatch):
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        assert common.scratch_path(spark, "x").startswith(named)
    monkeypatch.setattr(type(spark.conf), "get", lambda self, key, default=None: default)
    assert common.scratch_root(spark).startswith("file:///") and common.scratch_root(spark) == common.scratch_root(spark)
