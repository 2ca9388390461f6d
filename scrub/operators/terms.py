"""Confidential terms: find them in text whatever their accents and case, and keep them in a table."""

from __future__ import annotations

import getpass
import socket
import string
import unicodedata
import uuid
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.masking import LABELS, Hmac20
from ..functions.text import LINE_LIMIT, LINES, norm_key

#: Terms of one automaton, some 100 MB for a worker.
TERMS_AT_ONCE = 500_000
#: Characters that can't stand beside a term: letters and digits of A-Z; ``_`` is an edge.
EDGES = frozenset(string.ascii_letters + string.digits)


def fold(term: str) -> str:
    return term if term.isascii() else "".join(c for c in unicodedata.normalize("NFKD", term) if not unicodedata.combining(c))


def merge_terms(*tables: DataFrame) -> DataFrame:
    """Distinct (term, category) of all tables; a term in several categories counts as sensitive."""
    out = tables[0].select("term", "category")
    for t in tables[1:]:
        out = out.union(t.select("term", "category"))
    rank = F.when(F.col("category") == "sensitive_term", 0).otherwise(1)
    return out.filter("trim(term) <> ''").groupBy(F.trim("term").alias("term")).agg(F.min_by("category", rank).alias("category"))


def _label(category: Column) -> Column:
    return F.when(category == "internal_term", LABELS["internal_term"]).otherwise(LABELS["sensitive_term"])


def automatic_terms(spark: SparkSession, names: tuple[str, ...] | None = None, least: int = 3) -> DataFrame:
    """(term, category) of names that shouldn't leave a machine: this user's and host's, or those given. Short ones are left out."""
    names = (getpass.getuser(), socket.gethostname()) if names is None else names
    return spark.createDataFrame(sorted({(n.strip(), "sensitive_term") for n in names if len(n.strip()) >= least}), "term string, category string")


class TermMatcher:
    """An automaton of folded lower-case terms, each with what is said of it."""

    def __init__(self, entries: dict[str, list[tuple[str | None, str]]]):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for term, said in entries.items():
            self.automaton.add_word(term, (len(term), said))
        if entries:
            self.automaton.make_automaton()

    def find(self, text: str) -> Iterator[tuple[int, str | None, str]]:
        """(line from 1, key, category) of each term and line that holds it, in the order of lines."""
        for number, line in enumerate(LINES.split(text), 1):
            line = fold(line[:LINE_LIMIT]).lower()
            seen = set()
            for end, (size, said) in self.automaton.iter(line):
                at = end + 1 - size
                term = line[at : end + 1]
                if term in seen:
                    continue
                if (at and line[at - 1] in EDGES) or (end + 1 < len(line) and line[end + 1] in EDGES):
                    continue
                seen.add(term)
                for key, category in said:
                    yield number, key, category


@lru_cache(2)
def _matcher(name: str, held: Broadcast) -> TermMatcher:
    """One for each worker and list; ``name`` tells lists apart."""
    return TermMatcher(held.value)


def _keyed(rows: list, key: bytes | None) -> dict[str, list[tuple[str | None, str]]]:
    of = Hmac20(key) if key else lambda term: None
    entries: dict[str, list[tuple[str | None, str]]] = {}
    for term, category in rows:
        entries.setdefault(fold(term).lower(), []).append((of(term), category))
    return entries


def scan_terms(df: DataFrame, terms: DataFrame, id_col: str = "id", text: str = "text", key: bytes | None = None) -> DataFrame:
    """(id, line, term_key, category, snippet): one row for each line and term that it holds; the snippet hides the term.

    term_key is the keyed hash of the term (null without a key, as an unkeyed one could be looked up in a word list). The terms
    are one automaton, broadcast, that passes over each text once; neither they nor the key are in the plan. Of longer
    lists each TERMS_AT_ONCE terms are one automaton and one pass. No shuffle.
    """
    spark = df.sparkSession
    listed = terms.select("term", "category").filter("trim(term) <> ''")
    parts = max(1, -(-listed.count() // TERMS_AT_ONCE))
    numbered = listed.withColumn("part", F.pmod(F.xxhash64("term"), F.lit(parts)))
    texts, out = df.select(F.col(id_col).alias("id"), F.col(text).cast("string").alias("text")), None
    for part in range(parts):
        entries = _keyed([(r["term"], r["category"]) for r in numbered.filter(F.col("part") == part).collect()], key)
        entries.pop("", None)
        found = texts.select("id", F.explode(_matches(spark, entries)(F.col("text"))).alias("t")).select("id", "t.line", "t.term_key", "t.category")
        out = found if out is None else out.unionByName(found)
    return out.select("id", "line", "term_key", "category", _label(F.col("category")).alias("snippet"))


def _matches(spark: SparkSession, entries: dict[str, list[tuple[str | None, str]]]) -> Callable[[Column], Column]:
    name, held = uuid.uuid4().hex, spark.sparkContext.broadcast(entries)

    @F.arrow_udf("array<struct<line:int,term_key:string,category:string>>")
    def terms_in(texts: pa.Array) -> pa.Array:
        matcher = _matcher(name, held)
        rows = [[{"line": n, "term_key": k, "category": c} for n, k, c in matcher.find(t)] if t and len(matcher.automaton) else [] for t in texts.to_pylist()]
        return pa.array(rows, pa.list_(pa.struct([("line", pa.int32()), ("term_key", pa.string()), ("category", pa.string())])))

    return terms_in


# The term store: a table (list, value), one row for each term.


def add_terms(store: DataFrame, new: DataFrame, lists: tuple[str, ...]) -> DataFrame:
    """Store with the new rows that have a known list, a value that isn't blank, and no equal in the list. Of equal new ones the least stays."""
    clean = new.select("list", F.trim("value").alias("value")).filter(F.col("list").isin(*lists) & (F.col("value") != "")).withColumn("_key", norm_key("value"))
    clean = clean.groupBy("list", "_key").agg(F.min("value").alias("value"))
    fresh = clean.join(store.select("list", norm_key("value").alias("_key")), ["list", "_key"], "left_anti")
    return store.select("list", "value").unionByName(fresh.select("list", "value"))


def remove_terms(store: DataFrame, gone: DataFrame) -> DataFrame:
    """Store without rows that equal one of ``gone`` in its list."""
    return store.withColumn("_key", norm_key("value")).join(gone.select("list", norm_key("value").alias("_key")).distinct(), ["list", "_key"], "left_anti").select("list", "value")


def removed_count(store: DataFrame, gone: DataFrame) -> DataFrame:
    """(list, removed): rows of the store that ``remove_terms`` takes out."""
    hit = store.withColumn("_key", norm_key("value")).join(gone.select("list", norm_key("value").alias("_key")).distinct(), ["list", "_key"], "left_semi")
    return hit.groupBy("list").agg(F.count("*").alias("removed"))


def contains_terms(asked: DataFrame, store: DataFrame) -> DataFrame:
    """``asked`` (list, value) rows that the store has."""
    return asked.withColumn("_key", norm_key("value")).join(store.select("list", norm_key("value").alias("_key")), ["list", "_key"], "left_semi").select("list", "value")


def merge_backup(store: DataFrame, backup: DataFrame, lists: tuple[str, ...]) -> tuple[DataFrame, DataFrame]:
    """(merged store, new rows by list). Named secrets (optional column ``name``) that have two values abort the merge."""
    if "name" in store.columns and "name" in backup.columns:
        clash = store.alias("a").join(backup.alias("b"), (F.col("a.list") == F.col("b.list")) & (F.col("a.name") == F.col("b.name")) & (F.col("a.value") != F.col("b.value")))
        if not clash.isEmpty():
            raise ValueError("a secret of one name has two values")
    merged = add_terms(store, backup, lists)
    added = merged.exceptAll(store.select("list", "value")).groupBy("list").agg(F.count("*").alias("added"))
    return merged, added


def migrate_lists(store: DataFrame, sources: DataFrame, lists: tuple[str, ...]) -> DataFrame:
    """Store with all values of ``sources``; fails if one of a known list didn't arrive, so that nothing is cleared too early."""
    merged = add_terms(store, sources, lists)
    asked = sources.filter(F.col("list").isin(*lists) & (F.trim("value") != "")).select("list", "value")
    if asked.distinct().count() != contains_terms(asked.distinct(), merged).count():
        raise ValueError("not all terms arrived")
    return merged


def store_counts(store: DataFrame, lists: tuple[str, ...]) -> DataFrame:
    """Rows of each list, zero for empty ones."""
    names = store.sparkSession.createDataFrame([(x,) for x in lists], "list string")
    return names.join(store, "list", "left").groupBy("list").agg(F.count("value").alias("terms"))
