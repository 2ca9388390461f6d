"""Toxicity of whole texts: a learned lexicon, found through spelling errors, weighed by context.

The lexicon comes from labelled documents: words, and stems that words begin with, which occur in
toxic documents far more often than in others. It is kept as a trie. A Levenshtein automaton reads a
word and walks the trie at the same time, so that all entries within one edit (a letter left out, put in or
replaced, or two neighbours swapped) are found in one pass over the word's letters, stems at the beginning of a word too; the sets of places in the trie that a walk can be at are remembered as
states, hence each letter costs one look-up. What a hit counts for depends on the words around it:
in quotation marks, or close after a word of saying, it is taken for quotation, not abuse.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, releasing

#: Labelled documents that are learned from, at most, of each label: those of the smallest hashes of their ids.
FIT_TOXIC, FIT_CLEAN = 4_000, 8_000
#: Evidence an entry needs: lower bound of its log odds (3 standard errors).
LEAST_ODDS = 1.2
#: Letters of a stem, and of a word or stem from which on one edit is allowed.
STEM, LONGEST_STEM, FUZZY = 3, 16, 5
#: Words on either side that make up a hit's context.
CONTEXT = 8
#: Words of saying that mark a quotation when they come shortly before a hit. A parameter; fixed values.
SAYING = frozenset("said says wrote writes called quoted quote quoting term word words slur dit écrit citation sagte schrieb zitat wort dijo escribió cita palabra".split())
REMEMBERED = 500_000

WORD = re.compile(r"[^\W_]+")
OPEN_QUOTE, CLOSE_QUOTE = "\"“”«»„‟", "\"“”«»„‟"


@dataclass
class Lexicon:
    """Entries with their weights. ``words`` must match whole, ``stems`` the beginning of a longer word; ``known`` are words that are found by a stem or an edit and were seen in training, with their own weight."""

    words: dict[str, float] = field(default_factory=dict)
    stems: dict[str, float] = field(default_factory=dict)
    known: dict[str, float] = field(default_factory=dict)


class Automaton:
    """Levenshtein automaton of at most one edit, intersected with the lexicon's trie, made state by state as words need it."""

    def __init__(self, lexicon: Lexicon):
        self.lexicon = lexicon
        self.kids: list[dict[str, int]] = [{}]
        self.word_at: dict[int, str] = {}
        self.stem_at: dict[int, str] = {}
        for entries, at in ((lexicon.words, self.word_at), (lexicon.stems, self.stem_at)):
            for entry in entries:
                node = 0
                for c in entry:
                    if c not in self.kids[node]:
                        self.kids[node][c] = len(self.kids)
                        self.kids.append({})
                    node = self.kids[node][c]
                at[node] = entry
        self.states: dict[frozenset, int] = {}
        self.members: list[frozenset] = []
        self.accepts: list[tuple[str, int] | None] = []
        self.stemmed: list[tuple[str, int] | None] = []
        self.moves: list[dict[str, int]] = []
        self.dead = self._state(frozenset())
        self.start = self._state(self._skips({(0, 0, "")}))
        self.seen: dict[str, tuple[str, str, float] | None] = {}

    # A place is (node, edits so far, letter that must come next or ""): the letter is the first of two that were swapped.

    def _skips(self, places: set[tuple[int, int, str]]) -> frozenset:
        """With the places that a left-out letter leads to."""
        return frozenset(places | {(k, 1, "") for node, e, _ in places if e == 0 for k in self.kids[node].values()})

    def _state(self, places: frozenset) -> int:
        if places in self.states:
            return self.states[places]
        n = self.states[places] = len(self.members)
        self.members.append(places)
        self.moves.append({})
        ends = [(e, self.word_at[node]) for node, e, due in places if not due and node in self.word_at and (e == 0 or len(self.word_at[node]) >= FUZZY)]
        self.accepts.append(min(ends)[::-1] if ends else None)
        stems = [(-e, len(self.stem_at[node]), self.stem_at[node]) for node, e, due in places if not due and node in self.stem_at and (e == 0 or len(self.stem_at[node]) >= FUZZY)]
        self.stemmed.append((max(stems)[2], -max(stems)[0]) if stems else None)
        return n

    def _move(self, state: int, c: str) -> int:
        new = set()
        for node, e, due in self.members[state]:
            if due:
                if c == due:
                    new.add((node, 1, ""))
                continue
            if c in self.kids[node]:
                new.add((self.kids[node][c], e, ""))
            if e == 0:
                new.add((node, 1, ""))  # a letter too many
                new.update((k, 1, "") for k in self.kids[node].values())  # another letter
                new.update((self.kids[k][c], 1, first) for first, k in self.kids[node].items() if first != c and c in self.kids[k])  # swapped
        to = self.moves[state][c] = self._state(self._skips(new))
        return to

    def find(self, word: str) -> tuple[str, str, float] | None:
        """(kind, entry, weight) of the best entry for a lower-case word; kind is word, stem, or fuzzy for either with an edit."""
        if word in self.seen:
            return self.seen[word]
        state, stem, near, dead = self.start, None, None, self.dead
        for c in word:
            if found := self.stemmed[state]:  # only of words that go on
                stem, near = (stem, found[0]) if found[1] else (found[0], near)
            state = self.moves[state].get(c) or self._move(state, c)
            if state == dead:
                break
        hit = self.accepts[state]
        near = near if near and len(word) > len(near) else None
        best: tuple[str, str, float] | None = None
        if hit and hit[1] == 0:
            best = ("word", hit[0], self.lexicon.words[hit[0]])
        elif stem or hit or near:
            kind, entry, weight = ("stem", stem, self.lexicon.stems[stem]) if stem else ("fuzzy", hit[0], self.lexicon.words[hit[0]]) if hit else ("fuzzy", near, self.lexicon.stems[near])
            weight = self.lexicon.known.get(word, weight)
            best = (kind, entry, weight) if weight > LEAST_ODDS else None
        if len(self.seen) >= REMEMBERED:
            self.seen.clear()
        self.seen[word] = best
        return best


def terms_of(text: str) -> set[str]:
    """Distinct terms of a text: ``=word``, and ``^stem`` for the first STEM .. LONGEST_STEM letters of each longer word."""
    words = set(WORD.findall(text.lower()))
    out = {"=" + w for w in words}
    for w in words:
        out.update("^" + w[:k] for k in range(STEM, min(len(w) - 1, LONGEST_STEM) + 1))
    return out


def count_terms(labelled: DataFrame) -> DataFrame:
    """(term, toxic, clean): labelled documents that hold each term. Counted by batch before the shuffle."""

    def run(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            counts: tuple[Counter, Counter] = (Counter(), Counter())
            for text, toxic in zip(frame["text"], frame["toxic"], strict=True):
                counts[int(toxic)].update(terms_of(text or ""))
            terms = list(counts[0].keys() | counts[1].keys())
            yield pd.DataFrame({"term": terms, "toxic": [counts[1][t] for t in terms], "clean": [counts[0][t] for t in terms]})

    return labelled.select("text", "toxic").mapInPandas(run, "term string, toxic long, clean long").groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def odds(toxic: float, clean: float, n_toxic: int, n_clean: int) -> tuple[float, float]:
    """Log odds ratio of a term and its lower bound at 3 standard errors."""
    ratio = math.log((toxic + 0.5) / (n_toxic + 1) / ((clean + 0.5) / (n_clean + 1)))
    return ratio, ratio - 3 * math.sqrt(1 / (toxic + 0.5) + 1 / (clean + 0.5))


def choose_entries(rows: list[tuple[str, int, int]], n_toxic: int, n_clean: int) -> Lexicon:
    """Lexicon of the terms that speak for toxicity; ``rows`` are (term, toxic, clean)."""
    counts = {t: (a, b) for t, a, b in rows}
    weights = {t: odds(a, b, n_toxic, n_clean) for t, (a, b) in counts.items()}
    longer: dict[str, str] = {}
    for t, (a, _) in counts.items():  # a stem gives way to the longer one, or the word, that nearly all its toxic documents have
        stem = "^" + t[1:-1]
        if a >= 0.97 * counts.get(stem, (10**9, 0))[0] and (t[0] == "=" or longer.get(stem, "=")[0] == "="):
            longer[stem] = t
    lexicon, taken = Lexicon(), set()
    strong = sorted((t for t, w in weights.items() if w[1] >= LEAST_ODDS), key=lambda t: (len(t), t))
    for t in strong:
        while t in longer:
            t = longer[t]
        above = next(("^" + t[1:k] for k in range(STEM + 1, len(t)) if "^" + t[1:k] in taken), None)
        if t[0] == "^" and any(d.startswith("=" + t[1:]) and 2 * counts[d][0] >= counts[t][0] and weights[d][0] > weights[t][0] for d in strong):
            continue  # what speaks for the stem is one word
        if t in taken or above and weights[t][0] < weights[above][0] + 1:
            continue
        taken.add(t)
        (lexicon.words if t[0] == "=" else lexicon.stems)[t[1:]] = weights[t][0]
    return lexicon


#: What a document's score is made of.
FEATURES = ("words_weight", "stems_weight", "fuzzy_weight", "quoted", "strongest", "density", "kinds")


def features(text: str | None, automaton: Automaton) -> list[float]:
    """FEATURES of one text; all zero where nothing is found, as in null and empty texts."""
    text = (text or "").lower()
    found = {w: hit for w in set(WORD.findall(text)) if (hit := automaton.find(w))}
    if not found:
        return [0.0] * len(FEATURES)
    spans = [m for m in WORD.finditer(text)]
    sums, quoted, strongest, entries = Counter(), 0.0, 0.0, set()
    for i, m in enumerate(spans):
        hit = found.get(m.group())
        if not hit:
            continue
        kind, entry, weight = hit
        left = text[spans[max(0, i - CONTEXT)].start() : m.start()]
        right = text[m.end() : spans[min(len(spans) - 1, i + CONTEXT)].end()]
        inside = sum(left.count(q) for q in OPEN_QUOTE) % 2 == 1 and any(q in right for q in CLOSE_QUOTE)
        told = any(s.group() in SAYING for s in spans[max(0, i - 3) : i])
        if inside or told:
            quoted += weight
            continue
        sums[kind] += weight
        strongest = max(strongest, weight)
        entries.add(entry)
    total = sum(sums.values())
    return [math.log1p(sums["word"]), math.log1p(sums["stem"]), math.log1p(sums["fuzzy"]), math.log1p(quoted), strongest, math.log1p(100 * total / len(spans)), math.log1p(len(entries))]


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Coefficients, the constant last, by Newton's method."""
    x = np.hstack([x, np.ones((len(x), 1))])
    beta, penalty = np.zeros(x.shape[1]), np.diag([ridge] * (x.shape[1] - 1) + [1e-3])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        step = np.linalg.solve((x.T * (p * (1 - p))) @ x + penalty, x.T @ (y - p) - penalty @ beta)
        beta += step
        if np.abs(step).max() < 1e-6:
            break
    return beta


@dataclass
class Model:
    lexicon: Lexicon
    beta: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(x @ self.beta[:-1] + self.beta[-1], -30, 30)))


def held_out_id(doc_id: int | None) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 4 == 2


def fit(docs: DataFrame, labels: DataFrame, fit_toxic: int = FIT_TOXIC, fit_clean: int = FIT_CLEAN) -> Model:
    """Learn lexicon and weights from labelled documents that aren't held out.

    At most about ``fit_toxic`` and ``fit_clean`` documents are used, chosen by the hash of their ids;
    their texts stay on the executors. Without toxic or without clean ones the lexicon is empty and
    every score is the share of toxic ones (0 if there are no labels).
    """
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    known = labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), "toxic").filter(~held)
    total = dict(known.groupBy("toxic").count().collect())
    share = {1: fit_toxic / max(1, total.get(1, 0)), 0: fit_clean / max(1, total.get(0, 0))}
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) / (1 << 20)
    chosen = known.filter(draw < F.when(F.col("toxic") == 1, F.lit(share[1])).otherwise(F.lit(share[0])))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id")  # its size is bounded by fit_toxic + fit_clean
    rows = materialize(rows.select("text", "toxic"), "labelled")
    sizes = dict(rows.groupBy("toxic").count().collect())
    n_toxic, n_clean = sizes.get(1, 0), sizes.get(0, 0)
    if not n_toxic or not n_clean:
        return Model(Lexicon(), np.array([0.0] * len(FEATURES) + [30.0 if n_toxic else -30.0]))
    counts = materialize(count_terms(rows), "terms")
    least = max(4, n_toxic // 500)
    candidates = counts.filter((F.col("toxic") >= least) & (F.col("toxic") / n_toxic > 3 * F.col("clean") / n_clean))
    # The fitted documents bound the number of terms, each of which at least four of them hold.
    lexicon = choose_entries([tuple(r) for r in candidates.orderBy("term").collect()], n_toxic, n_clean)
    near = near_words(counts.filter((F.col("toxic") + F.col("clean") >= 2) & F.col("term").startswith("=")), lexicon)
    lexicon.known = {t[1:]: odds(a, b, n_toxic, n_clean)[0] for t, a, b in near.collect()}

    def run(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        automaton = Automaton(lexicon)
        for frame in frames:
            yield pd.DataFrame({"x": [features(t, automaton) for t in frame["text"]], "y": frame["toxic"].astype("int64")})

    seen = rows.select("text", "toxic").mapInPandas(run, "x array<double>, y long").collect()  # a few numbers a document
    x, y = np.array([r.x for r in seen]), np.array([r.y for r in seen], float)
    return Model(lexicon, fit_logistic(x, y))


def near_words(counts: DataFrame, lexicon: Lexicon) -> DataFrame:
    """Rows of (term, toxic, clean) whose word is found in the lexicon, but not as an entry itself."""

    def run(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        automaton = Automaton(lexicon)
        for frame in frames:
            hits = [automaton.find(t[1:]) for t in frame["term"]]
            yield frame[[h is not None and h[0] != "word" for h in hits]]

    return counts.select("term", "toxic", "clean").mapInPandas(run, "term string, toxic long, clean long")


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted of each document. No shuffle; repeated rows each come back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = Automaton(model.lexicon)
        for batch in batches:
            x = np.array([features(t.as_py(), automaton) for t in batch.column(1)]).reshape(-1, len(FEATURES))
            s = model.score(x)
            held = [held_out_id(i) for i in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(held), pa.array(s), pa.array((s >= 0.3).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Fit on the labelled documents, score all. Null ids are never held out; null and empty texts have the score of a text without
    hits; repeated rows each come back, with one score; texts of any length are read whole; other columns are
    ignored. An empty table gives no rows."""
    return score(docs, fit(docs, labels))


def keep_clean(docs: DataFrame, model: Model) -> DataFrame:
    """Rows of ``docs`` whose text isn't predicted as toxic, all columns as they are. No shuffle."""

    @F.pandas_udf("boolean")
    @releasing
    def clean(frames: Iterator[pd.Series]) -> Iterator[pd.Series]:
        automaton = Automaton(model.lexicon)
        for texts in frames:
            x = np.array([features(t, automaton) for t in texts]).reshape(-1, len(FEATURES))
            yield pd.Series(model.score(x) < 0.3)

    return docs.filter(clean(F.col("text")))
