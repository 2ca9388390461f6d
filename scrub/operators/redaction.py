"""Replace found values by placeholders that a later scan recognises as such."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .patterns import PATTERNS, Pattern, candidate_lines, find_spans, scan_patterns
from .prefilter import patterns_to_try
from .terms import fold

#: Category -> what stands in its place; a parameter of the functions below.
PLACEHOLDERS = {
    **dict.fromkeys(("airtable_token", "airtable_legacy_key", "anthropic_key", "openai_key", "github_token", "google_api_key", "google_oauth", "aws_key", "slack_token", "stripe_key", "jwt"), "YOUR_API_KEY"),
    "private_key": "YOUR_PRIVATE_KEY", "bearer": "YOUR_API_KEY", "assigned_secret": "YOUR_API_KEY", "airtable_id": "YOUR_BASE_ID", "google_doc_url": "YOUR_SPREADSHEET_ID",
    "private_url": "https://example.com/", "credential_url": "https://example.com/", "url_token": "?key=YOUR_API_KEY", "private_ip": "YOUR_HOST", "local_path": "YOUR_PATH",
    "cpf": "000.000.000-00", "cnpj": "00.000.000/0000-00", "court_case": "0000000-00.0000.0.00.0000", "court_case_bare": "0" * 20,
    "email": "usuario@example.com", "phone": "(00) 00000-0000", "cep": "00000-000", "address": "Rua Exemplo, 000", "litigation_party": "EXEMPLO_PESSOA", "bar_number": "OAB/UF NNNNNN",
}


def _placeholder(placeholders: dict[str, str], category: Column) -> Column:
    by = F.create_map(*(F.lit(x) for pair in placeholders.items() for x in pair))
    return F.coalesce(by[category], F.lit("YOUR_VALUE"))


def _replace_line(line: Column, tries: Column, placeholders: dict[str, str], patterns: list[Pattern]) -> Column:
    """The whole line with its values replaced where they stand. The cut of long lines is for scans only."""
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("text"))
    rest = lambda s: F.substr(line, s["at"] + 1, F.length(line) - s["at"])
    step = lambda s, x: F.struct(x["end"].alias("at"), F.concat(s["text"], F.substr(line, s["at"] + 1, x["start"] - s["at"]), _placeholder(placeholders, x["category"])).alias("text"))
    return F.aggregate(find_spans(line, tries, patterns), start, step, lambda s: F.concat(s["text"], rest(s)))


def redact(df: DataFrame, text: str = "text", placeholders: dict[str, str] | None = None, patterns: list[Pattern] | None = None) -> DataFrame:
    """The table with found values in ``text`` replaced, line ends and all else unchanged. Null stays null. No shuffle.

    A value is replaced where it was found and nowhere else: ``password = "password"`` keeps its name. Only the patterns that
    may match in a text are tried on its lines; texts without any pass as they are.
    """
    places, patterns = placeholders or PLACEHOLDERS, patterns or PATTERNS
    # Line ends are kept as elements of their own.
    own = "_tries" + "_" * max(map(len, df.columns))  # no column of df
    col, tries = F.col(text), F.col(own)
    ends = "[\\n\\r\\u000B\\f\\u001C\\u001D\\u001E\\u0085\\u2028\\u2029]"
    lines = F.split(col, f"(?<={ends})|(?={ends})")
    replaced = F.array_join(F.transform(lines, lambda x: _replace_line(x, tries, places, patterns)), "")
    return df.withColumn(own, patterns_to_try(patterns)(col)).withColumn(text, F.when(F.size(tries) > 0, replaced).otherwise(col)).drop(own)


def redaction_log(df: DataFrame, id_col: str = "id", text: str = "text", placeholders: dict[str, str] | None = None, patterns: list[Pattern] | None = None) -> DataFrame:
    """(id, category, replaced, placeholder): how many places were replaced by what; never the value. A place that several
    patterns match counts once."""
    patterns = patterns or PATTERNS
    rows = candidate_lines(df, id_col, text, patterns, cut=False)
    counts = rows.select("id", F.explode(find_spans(F.col("line_text"), F.col("tries"), patterns)).alias("s")).groupBy("id", F.col("s.category").alias("category")).agg(F.count("*").alias("replaced"))
    return counts.withColumn("placeholder", _placeholder(placeholders or PLACEHOLDERS, F.col("category")))


def redaction_residual(df: DataFrame, id_col: str = "id", text: str = "text") -> DataFrame:
    """Findings left anywhere in the redacted texts, long lines included; a good set of placeholders leaves none."""
    return scan_patterns(redact(df, text), id_col, text, cut=False)


def redact_terms(df: DataFrame, terms: list[str], text: str = "text", placeholder: str = "EXEMPLO_TERMO") -> DataFrame:
    """Replace terms in the original text whatever their accents and case; longest terms first."""

    def letter(c: str) -> str:
        accented = {"a": "aàáâãäå", "c": "cç", "e": "eèéêë", "i": "iìíîï", "n": "nñ", "o": "oòóôõö", "u": "uùúûü", "y": "yýÿ"}
        return (f"[{accented[c]}]" if c in accented else re.escape(c)) + r"\p{M}*"

    out = F.col(text)
    for term in sorted(terms, key=len, reverse=True):
        body = "".join(letter(c) for c in fold(term).lower())
        out = F.regexp_replace(out, f"(?iu)(?<![A-Za-z0-9]){body}(?![A-Za-z0-9])", placeholder)
    return df.withColumn(text, out)


@F.pandas_udf(StringType())
def clean_notebook(text: pd.Series) -> pd.Series:
    """Notebook JSON without outputs, execution counts and execution metadata; other text comes back unchanged."""

    def clean(raw: str | None) -> str | None:
        try:
            book = json.loads(raw)
            cells = book["cells"]
        except (TypeError, ValueError, KeyError):
            return raw
        for cell in cells:
            if cell.get("cell_type") == "code":
                cell["outputs"], cell["execution_count"] = [], None
            cell.get("metadata", {}).pop("execution", None)
        return json.dumps(book, ensure_ascii=False)

    return text.map(clean)
