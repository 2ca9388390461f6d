"""What models say of rows that they weren't fitted on."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from scrub.llm import pseudo_lm, quality
from scrub.llm.common import materialize

DATA = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet").repartition(4).cache()


def every(n):
    """Whether a document is one in n, by its id."""
    return F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(n)) == n - 1


def test_quality_of_held_out_rows(spark, docs):
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    judged = quality.judge(materialize(quality.stats(docs), "held"), labels.filter(~every(2)))
    rows = judged.join(labels.filter(every(2)), "doc_id").filter("not base_failed").select("quality", "kept").collect()
    bad, good = [r.kept for r in rows if r.quality == 0], [r.kept for r in rows if r.quality == 1]
    assert len(bad) > 5 and sum(bad) <= 0.1 * len(bad)
    assert len(good) > 50 and sum(good) >= 0.95 * len(good)


def test_words_of_held_out_texts_are_likelier_than_by_their_frequency(docs):
    encoded = materialize(pseudo_lm.encoded(docs.select("doc_id", "text")), "held")
    train = encoded.filter(~every(8))
    # copies of training texts would flatter
    test = encoded.filter(every(8)).join(train.select("codes").distinct(), "codes", "left_anti").select(*encoded.columns)
    scored = pseudo_lm.score(test, pseudo_lm.train(train)).agg(F.sum("pll").alias("pll"), F.sum("n_words").alias("words")).first()
    counts = pseudo_lm.code_counts(train).astype(float) + 1
    frequency = np.log(counts / counts.sum())
    codes = np.concatenate([c[c != pseudo_lm.PAD] for b in test.toArrow().to_batches() for c in [pseudo_lm.padded(b.column("codes"))[0]]])
    assert len(codes) == scored.words > 10_000
    assert scored.pll / scored.words > frequency[codes].mean()
