"""Mix sources to target weights: rake token weights to marginals, then sample documents by them.

Documents fall into cells (source, language, topic). Iterative proportional fitting scales the tokens
of the cells until the shares of each source, language and topic are the targets; a cell's scale
times the budget is the expected number of times that each of its documents is used.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Cells are worked on by the driver; more than this (16 bytes each and their names) are refused.
MOST_CELLS = 1_000_000
OTHER = "(other)"


def topic_of(text: Column) -> Column:
    """A coarse topic by what a text holds; the first that applies. Null and blank texts are ``empty``."""
    return (
        F.when(F.trim(F.coalesce(text, F.lit(""))) == "", "empty")
        .when(text.contains("Licensed under") | text.contains("Copyright"), "legal")
        .when(text.contains("@") & text.rlike(r"\w@[\w-]+\.\w"), "contact")
        .when(text.contains(" | "), "table")
        .when(text.contains("token = ") | text.contains("{") | text.contains("();"), "code")
        .otherwise("prose")
    )


def words_of(text: Column) -> Column:
    """Tokens for weighting: runs of what isn't ASCII white space."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def rake(tokens: np.ndarray, groups: list[np.ndarray], targets: list[np.ndarray], most: float | None = None, tolerance: float = 1e-9, rounds: int = 2_000) -> tuple[np.ndarray, float]:
    """Weights of cells: iterative proportional fitting (Deming and Stephan, 1940).

    ``groups[d][c]`` is the category of cell c in dimension d, ``targets[d]`` the shares of its
    categories. Categories without tokens drop out and the others' shares are scaled up. With ``most``,
    no weight passes it: each round clips weights there and goes on with the others, so that targets
    are met as far as the cells reach. Returns the weights, and the residual: the largest gap between a
    category's share of the weighted tokens and its target, near 0 where all targets are met.
    """
    total = float(tokens.sum())
    weights = np.ones(len(tokens))
    if not total:
        return weights, 0.0
    wanted = []
    for g, t in zip(groups, targets, strict=True):
        there = np.bincount(g, tokens, len(t)) > 0
        share = np.where(there, t, 0.0)
        wanted.append(total * share / share.sum() if share.sum() else np.bincount(g, tokens, len(t)))
    for _ in range(rounds):
        before = weights.copy()
        for g, want in zip(groups, wanted, strict=True):
            now = np.bincount(g, weights * tokens, len(want))
            weights *= np.where(now > 0, want / np.where(now > 0, now, 1), 0.0)[g]
        if most is not None:
            weights = np.minimum(weights, most)
        if np.abs(weights - before).max() <= tolerance * max(1e-300, weights.max()):
            break
    gaps = [np.abs(np.bincount(g, weights * tokens, len(want)) - want).max() for g, want in zip(groups, wanted, strict=True)]
    return weights, float(max(gaps) / total)


def probabilities(cells: list[tuple], dims: int, targets: list[dict[str, float] | float], budget: float, repeat: bool) -> tuple[list[float], float]:
    """Expected uses of a document for each cell (category, ..., tokens), and the residual; ``targets`` as in ``mix``."""
    tokens = np.array([c[dims] for c in cells], float)
    groups, shares = [], []
    for d, target in enumerate(targets):
        names = sorted({c[d] for c in cells})
        at = {n: i for i, n in enumerate(names)}
        g = np.array([at[c[d]] for c in cells], np.int64)
        if isinstance(target, dict):
            rest = max(0.0, 1.0 - sum(target.values()))
            share = np.array([target.get(n, rest if n == OTHER else 0.0) for n in names])
        else:
            share = np.bincount(g, tokens, len(names)) ** target
            share = share / max(share.sum(), 1e-300)
        groups.append(g)
        shares.append(share)
    weights, residual = rake(tokens, groups, shares, None if repeat else 1.0 / budget)
    return (budget * weights).tolist(), residual


def mix(docs: DataFrame, targets: dict[str, dict[str, float] | float], budget: float = 0.5, repeat: bool = True, seed: int = 11, text_col: str = "text", id_col: str = "doc_id", tokens_col: str | None = None, prefix: str = "mix_") -> DataFrame:
    """Add tokens, weight (expected uses of the document), copies (drawn uses), residual (of ``rake``, alike in all rows) and each dimension's class.

    The new columns' names begin with ``prefix``; columns that have such a name already are replaced.

    ``targets``: for each dimension (a column, or ``topic``, made from the text) either a share for
    each value, all others and nulls taking what is left as one class, or an exponent that its
    observed shares are raised to. ``budget`` is the tokens wanted, as a share of those there are. With
    ``repeat``, weights may pass 1 (such a document is used several times); without, they are
    clipped at 1. Draws depend on id and seed alone, so repeated rows are drawn alike; a null id is
    drawn like any other value. Texts without a word have no tokens and weight of their cell (0 if the cell
    has none), texts of any length are counted whole. An empty table gives no rows. With ``tokens_col`` that
    column's numbers are the tokens.

    Two scans, no shuffle of rows: cells are counted by partial aggregation, and come back as a
    broadcast of as many rows as there are cells, which is checked against MOST_CELLS.
    """
    spark = docs.sparkSession
    names = list(targets)
    parts, inner = {}, "_" + "_" * max(map(len, docs.columns))  # begins no column's name
    for n in names:
        value = topic_of(F.col(text_col)) if n == "topic" and n not in docs.columns else F.coalesce(F.col(n).cast("string"), F.lit(OTHER))
        if isinstance(targets[n], dict):
            value = F.when(value.isin(list(targets[n])), value).otherwise(OTHER)
        parts[f"{inner}{n}"] = value
    tokens = F.col(tokens_col) if tokens_col else words_of(F.col(text_col))
    marked = docs.withColumns(parts | {f"{inner}tokens": tokens})
    keys = list(parts)
    counted = marked.groupBy(*keys).agg(F.sum(f"{inner}tokens").alias("tokens"))
    cells = [tuple(r) for r in counted.limit(MOST_CELLS + 1).collect()]
    if len(cells) > MOST_CELLS:
        raise ValueError(f"over {MOST_CELLS} cells: give shares for fewer values")
    weights, residual = probabilities(cells, len(keys), [targets[n] for n in names], budget, repeat)
    schema = T.StructType([T.StructField(k, T.StringType()) for k in keys] + [T.StructField(f"{inner}weight", T.DoubleType())])
    table = spark.createDataFrame([(*c[: len(keys)], w) for c, w in zip(cells, weights, strict=True)], schema)
    draw = F.pmod(F.xxhash64(F.col(id_col), F.lit(seed)), F.lit(1 << 52)) / float(1 << 52)
    weight = F.col(f"{inner}weight")
    whole = F.floor(weight)
    copies = (whole + F.when(draw < weight - whole, 1).otherwise(0)).cast("int")
    out = marked.join(F.broadcast(table), keys).withColumns({f"{inner}copies": copies, f"{inner}residual": F.lit(residual)})
    made = {f"{inner}{n}": f"{prefix}{n}" for n in ("tokens", "weight", "copies", "residual", *names)}
    return out.select(*(c for c in docs.columns if c not in made.values()), *made).withColumnsRenamed(made)
