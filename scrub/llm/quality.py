"""Quality rules: statistics of each text, and an isolation forest over them.

A document fails at once by two plain rules (too short, too repetitive). The others are judged by how
few random splits separate their statistics from those of other documents; the path length at which
a document counts as an anomaly is set on labelled rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, releasing, sieve, sifted

#: Fixed values of the base rules.
MIN_WORDS, MOST_REPEATED_PERCENT = 50, 50
SYMBOLS = b"#*$%&|<>"
#: Trees, and the share of the good rows, one in so many, beyond which a node is split: trees stay as small whatever the number of rows.
TREES, PARTS = 128, 512
#: Levels that trees grow by between two counts of rows.
LEVELS = 3
#: Scores are multiples of one in so many, so that rows of a score can be counted.
GRID = 1 << 17
#: Share of good labelled rows that may fall beyond the threshold.
GOOD_LOST = 0.005

#: What the forest splits on; each is a ratio, or a logarithm, so that texts of all lengths compare.
FEATURES = ("word_chars_mean", "symbol_ratio", "dup_line_ratio", "repeat_ratio", "upper_ratio", "digit_ratio", "distinct_ratio", "end_mark_ratio", "long_word_ratio", "top_word_ratio", "line_words_log", "other_mark_ratio")
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")

_DELETE_CONTINUATION = bytes(range(0x80, 0xC0))
_NOT_UPPER = bytes(b for b in range(256) if not 65 <= b <= 90)
_NOT_DIGIT = bytes(b for b in range(256) if not 48 <= b <= 57)
_NOT_SYMBOL = bytes(b for b in range(256) if b not in SYMBOLS)
_NOT_MARK = bytes(b for b in range(256) if chr(b) not in "!?|/\\{}[]()=+~^_@;:\"'`-")


def text_stats(text: str | None) -> tuple[list[int], list[float]]:
    """(BASE counts, FEATURES) of one text; all zero for null, empty and blank texts."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()  # ASCII white space, exactly [\\x20\\x09-\\x0D]
    if not words:
        return [0] * len(BASE), [0.0] * len(FEATURES)
    n = len(words)
    joined = b"".join(words)
    chars = len(joined.translate(None, _DELETE_CONTINUATION))
    symbols = len(raw.translate(None, _NOT_SYMBOL))
    seen: set[bytes] = set()
    lines = dup = 0
    for line in raw.split(b"\n"):
        if line.strip():  # ASCII white space
            lines += 1
            dup += line in seen
            seen.add(line)
    repeated = 0
    if n >= 3:
        windows = list(zip(words, words[1:], words[2:], strict=False))
        if len(set(windows)) < len(windows):
            counts = Counter(windows)
            covered = np.zeros(n, bool)
            at = np.flatnonzero(np.fromiter((counts[w] > 1 for w in windows), bool, len(windows)))
            for k in range(3):
                covered[at + k] = True
            repeated = int(covered.sum())
    counts = Counter(words)
    top = counts.most_common(1)[0][1]
    ends = sum(w.endswith((b".", b",")) for w in words)
    long = sum(len(w) > 30 for w in words)
    size = max(1, chars)
    features = [
        chars / n, symbols / size, dup / max(1, lines), repeated / n, len(raw.translate(None, _NOT_UPPER)) / size, len(raw.translate(None, _NOT_DIGIT)) / size,
        len(counts) / n**0.8, ends / n, long / n, top / n, float(np.log1p(n / max(1, lines))), len(raw.translate(None, _NOT_MARK)) / size,
    ]
    return [n, chars, symbols, dup, repeated], features


def stats(docs: DataFrame, keep: list[str] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each document: doc_id, BASE counts (long) and an array of FEATURES. No shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [text_stats(x.as_py()) for x in batch.column(1)]
            base = np.array([f[0] for f in found], np.int64).reshape(-1, len(BASE))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(base[:, i]) for i in range(len(BASE))), pa.array([f[1] for f in found], pa.list_(pa.float64()))], ["doc_id", *BASE, "features"])

    schema = ", ".join(["doc_id long", *(f"{c} long" for c in BASE), "features array<double>"])
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


@dataclass
class Forest:
    """Trees in arrays; a leaf has feature -1 and in ``value`` its depth with the expected depth below it."""

    feature: np.ndarray
    value: np.ndarray
    left: np.ndarray
    right: np.ndarray
    roots: np.ndarray
    usual: float

    def leaves(self, x: np.ndarray) -> Iterator[np.ndarray]:
        """For each tree the leaf of each row."""
        rows = np.arange(len(x))
        for root in self.roots.tolist():
            node = np.full(len(x), root)
            while True:
                f = self.feature[node]
                inner = f >= 0
                if not inner.any():
                    break
                less = x[rows, np.maximum(f, 0)] < self.value[node]
                node = np.where(inner, np.where(less, self.left[node], self.right[node]), node)
            yield node

    def score(self, x: np.ndarray) -> np.ndarray:
        """Anomaly score of each row, 0 to 1: 2 ** -(mean path length / usual path length), a multiple of 1 / GRID."""
        total = np.zeros(len(x))
        for node in self.leaves(x):
            total += self.value[node]
        return np.round(2.0 ** (-total / len(self.roots) / self.usual) * GRID) / GRID

    def count(self, x: np.ndarray) -> np.ndarray:
        """Rows of x in each leaf."""
        return np.bincount(np.concatenate(list(self.leaves(x))), minlength=len(self.feature))


def _expected(n: np.ndarray | float) -> np.ndarray:
    """Mean path length of a search that fails in a random tree of n rows, PARTS at most; between whole numbers on a line."""
    k = np.arange(1, PARTS + 1)
    return np.interp(n, k, 2.0 * np.concatenate([[0.0], np.cumsum(1.0 / k[:-1])]) - 2.0 * (k - 1) / k)


def grow_forest(count: Callable[[Forest], np.ndarray], n: int, box: np.ndarray, trees: int = TREES, parts: int = PARTS, seed: int = 7) -> Forest:
    """Isolation forest (Liu, Ting and Zhou, 2008) over n rows, all in every tree; ``count`` gives the rows in each leaf of a forest.

    Splits are drawn from a node's part of ``box`` (lowest and highest value of each feature), not from
    the range of its rows: where good rows all have one value, as with symbols, a row beyond it still
    gets parted from them. So rows are needed for their number alone. A node of more than one in ``parts`` of them
    (of more than one, if they are fewer) is split; below it, rows in such parts are taken for one.
    """
    rng = np.random.default_rng(seed)
    parts = max(1, min(parts, n))
    part = n / parts
    limit = int(np.ceil(np.log2(max(2, parts)))) + 6
    usual = max(float(_expected(parts)), 1e-9)
    feature, value, left = np.full(trees, -1), np.zeros(trees), np.arange(trees)
    right, depth, held = left.copy(), np.zeros(trees, int), np.full(trees, n, np.int64)
    at, low, high = np.arange(trees), np.repeat(box[:1], trees, 0), np.repeat(box[1:], trees, 0)  # nodes to split, and their boxes
    if n <= 1:
        at, low, high = at[:0], low[:0], high[:0]
    while len(at):
        old, levels = len(feature), []
        for _ in range(min(LEVELS, limit - int(depth[at[0]]))):
            can = high > low
            some = can.any(1)
            at, low, high, can = at[some], low[some], high[some], can[some]
            m, here = len(at), np.arange(len(at))
            f = np.argmax(np.where(can, rng.random(can.shape), -1.0), 1)
            cut = low[here, f] + (high[here, f] - low[here, f]) * rng.random(m)
            kids = len(feature) + np.arange(2 * m)
            feature[at], value[at], left[at], right[at] = f, cut, kids[:m], kids[m:]
            levels.append(at)
            feature, value, held = np.append(feature, np.full(2 * m, -1)), np.append(value, np.zeros(2 * m)), np.append(held, np.zeros(2 * m, np.int64))
            left, right, depth = np.append(left, kids), np.append(right, kids), np.append(depth, np.tile(depth[at] + 1, 2))
            below, above = high.copy(), low.copy()
            below[here, f] = above[here, f] = cut
            at, low, high = kids, np.concatenate([low, above]), np.concatenate([below, high])
        counted = count(Forest(feature, value, left, right, np.arange(trees), usual))
        held[old:] = counted[old:]
        for nodes in levels[::-1]:
            held[nodes] = held[left[nodes]] + held[right[nodes]]
        few = np.concatenate(levels)[held[np.concatenate(levels)] <= part]  # nodes that are leaves after all
        keep = np.ones(len(feature), bool)
        feature[few] = -1
        for nodes in levels:
            keep[left[nodes]] = keep[right[nodes]] = keep[nodes] & (feature[nodes] >= 0)
        left[few] = right[few] = few
        more = (held[at] > part) & keep[at] & (depth[at] < limit)
        place = np.cumsum(keep) - 1
        at, low, high = place[at[more]], low[more], high[more]
        feature, value, left, right, depth, held = feature[keep], value[keep], place[left[keep]], place[right[keep]], depth[keep], held[keep]
    value = np.where(feature < 0, depth + _expected(held / part), value)
    return Forest(feature.astype(np.int8), value, left.astype(np.int32), right.astype(np.int32), np.arange(trees), usual)


def fit_forest(x: np.ndarray, box: np.ndarray, trees: int = TREES, parts: int = PARTS, seed: int = 7) -> Forest:
    """``grow_forest`` over the rows of x."""
    return grow_forest(lambda forest: forest.count(x), len(x), box, trees, parts, seed)


def threshold_of(values: np.ndarray, good: np.ndarray, bad: np.ndarray, lost: float = GOOD_LOST) -> float:
    """Score beyond which a row is rejected, by the numbers of good and bad rows of each score (ascending): of those that reject
    at most ``lost`` of the good labelled rows, one that rejects most bad rows less good ones, each as a share; of a range of such
    scores the middle."""
    goods, bads = np.cumsum(good), np.cumsum(bad)
    if not bads[-1]:
        return float(values[-1])
    first = int(np.searchsorted(goods, np.ceil((goods[-1] - 1) * (1 - lost)), "right"))
    tries = values[first:]
    gain = (1 - bads[first:] / bads[-1]) - (1 - goods[first:] / goods[-1])
    best = int(np.argmax(gain))
    after = tries[best + 1] if best + 1 < len(tries) else tries[best]
    return float((tries[best] + after) / 2)


def threshold_for(scores: np.ndarray, good: np.ndarray, lost: float = GOOD_LOST) -> float:
    """``threshold_of`` the scores of rows."""
    values, at = np.unique(scores, return_inverse=True)
    return threshold_of(values, np.bincount(at[good], minlength=len(values)), np.bincount(at[~good], minlength=len(values)), lost)


def base_rule() -> Column:
    """Whether a row of ``stats`` fails the base rules."""
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED_PERCENT * F.col("n_words"))


def known_labels(labels: DataFrame) -> DataFrame:
    """(doc_id, good) of the labelled rows to fit on: all that have an id and a quality."""
    known = labels.filter("doc_id is not null and quality is not null")
    return known.select(F.col("doc_id").cast("long").alias("doc_id"), (F.col("quality") == 1).alias("good"))


def fit(counted: DataFrame, known: DataFrame) -> tuple[Forest, float] | None:
    """Forest and threshold from all rows of a table of ``stats`` with base_failed that ``known`` has labels for; None without good rows.

    Rows stay in Spark. What comes to the driver is the range of each feature, at most PARTS x 2 ** LEVELS numbers a tree
    for each round of growth, and one row for each score, GRID at most.
    """
    rows = materialize(counted.filter(~F.col("base_failed")).join(known, "doc_id").select("features", "good"), "labelled")
    ends = [f(F.get("features", F.lit(i))) for f in (F.min, F.max) for i in range(len(FEATURES))]
    n, *box = rows.agg(F.count_if("good"), *ends).first()
    if not n:
        return None
    good = rows.filter("good").select("features")

    def count(forest: Forest) -> np.ndarray:
        @releasing
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(len(forest.feature), np.int64)
            for batch in batches:
                if len(batch):
                    total += forest.count(np.array(batch.column(0).flatten()).reshape(-1, len(FEATURES)))
            leaf = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(leaf), pa.array(total[leaf])], ["leaf", "n"])

        found = good.mapInArrow(run, "leaf long, n long").groupBy("leaf").agg(F.sum("n").alias("n")).toArrow()
        total = np.zeros(len(forest.feature), np.int64)
        total[found.column("leaf").to_numpy()] = found.column("n").to_numpy()
        return total

    forest = grow_forest(count, n, np.array(box, float).reshape(2, -1))

    @releasing
    def scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array(batch.column(0).flatten()).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([pa.array(forest.score(x), pa.float64()), batch.column(1)], ["score", "good"])

    each = rows.mapInArrow(scores, "score double, good boolean").groupBy("score").agg(F.count_if("good").alias("good"), F.count_if(~F.col("good")).alias("bad"))
    found = each.toArrow().sort_by("score")
    return forest, threshold_of(*(found.column(c).to_numpy() for c in ("score", "good", "bad")))


def judge(counted: DataFrame, labels: DataFrame) -> DataFrame:
    """Add base_failed, score and kept to the table of ``stats``.

    Of the labelled rows that pass the base rules the forest is fitted on all
    good ones, within the range of all, and the scores of all set the threshold. With no such rows nothing but the base rules rejects
    (score null). Documents without a label are judged like the others; rows of ``labels`` with
    a null id or quality, or whose document isn't there, are ignored.
    """
    counted = counted.withColumn("base_failed", base_rule())
    model = fit(counted, known_labels(labels))
    if model is None:
        return counted.select("*", F.lit(None).cast("double").alias("score"), (~F.col("base_failed")).alias("kept"))
    forest, most = model
    names = counted.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = np.array(batch.column("features").flatten()).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(forest.score(rows), pa.float64())], [*names, "score"])

    schema = ", ".join(f"`{n}` {t}" for n, t in counted.dtypes)
    return counted.mapInArrow(run, f"{schema}, score double").withColumn("kept", ~F.col("base_failed") & (F.col("score") <= most))


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, BASE counts, base_failed, score and kept of each document; repeated rows each come back.

    Texts are read once; the table of statistics is written, since fitting and judging both need it.
    """
    return judge(materialize(stats(docs), "stats"), labels).drop("features")


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows of ``docs`` that are kept, all columns as they are. No shuffle of texts.

    Only labelled documents, found by a sieve of bounded size, are counted to fit; then every text is judged where it is read.
    """
    known = known_labels(labels)
    key = F.xxhash64(F.col("doc_id").cast("long"))
    labelled = sifted(docs, key, sieve(known, key), inside=True)  # and a few others, which the join in fit drops
    model = fit(materialize(stats(labelled).withColumn("base_failed", base_rule()), "stats"), known)

    @F.pandas_udf("boolean")
    @releasing
    def good(frames: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in frames:
            found = [text_stats(t) for t in texts]
            base = np.array([f[0] for f in found], np.int64).reshape(-1, len(BASE))
            ok = (base[:, 0] >= MIN_WORDS) & (100 * base[:, 4] <= MOST_REPEATED_PERCENT * base[:, 0])
            if model is not None:
                ok &= model[0].score(np.array([f[1] for f in found]).reshape(-1, len(FEATURES))) <= model[1]
            yield pd.Series(ok)

    return docs.filter(good(F.col("text")))
