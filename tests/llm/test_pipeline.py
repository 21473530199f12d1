"""The pipeline against a plain version of its stages, over the smallest tables."""

import hashlib
import re

import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")
import corpus_pipeline  # noqa: E402
from cellweave.llm import bpe, quality, secrets  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from .test_operators import own_encoding, plain_components, plain_scan, plain_sets  # noqa: E402

SMALL = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    left = {r.doc_id: r.text for r in docs.collect()}
    model = quality.fit(docs, labels, "quality", quality.fold(F.col("doc_id"), 4) != 2)
    scores = {r.doc_id: r.score for r in quality.score(docs, model).collect()}
    good = {i for i in left if scores[i] >= corpus_pipeline.LEAST_QUALITY}
    wrong = [r.doc_id for r in labels.collect() if (r.doc_id in good) != (r.quality == 1)]
    assert len(wrong) <= 0.1 * labels.count()
    left = {i: t for i, t in left.items() if i in good}
    root = plain_components(plain_sets(left.items(), corpus_pipeline.SHINGLE_WORDS), corpus_pipeline.PERCENT)
    left = {i: t for i, t in left.items() if root[i] == i}
    items = [" " + " ".join(re.findall(r"\w+", r.text.lower())) + " " for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    left = {i: t for i, t in left.items() if not any(x in " " + " ".join(re.findall(r"\w+", t.lower())) + " " for x in items)}

    def redacted(text):
        out, at = "", 0
        for a, _, b in plain_scan(text):
            if a >= at:
                out += text[at:a] + "[SECRET]"
            at = max(at, b)
        return out + text[at:]

    encoding = own_encoding()
    truth = {}
    for i, t in left.items():
        t = redacted(t)
        ids = encoding.encode_ordinary(t)
        truth[i] = (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest())
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in corpus_pipeline.run(spark, SMALL).collect()}
    assert got == truth


def test_stages_keep_columns(spark):
    docs = spark.createDataFrame([(1, None, "en", "s", 0), (2, "", None, "s", 0), (3, "some plain words here", "en", None, 21)], "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SMALL)
        if name != "bpe":
            assert out.columns == docs.columns
        assert stage(spark, docs.limit(0), SMALL).count() == 0


def test_stages_on_odd_rows(spark):
    """Repeated rows, null ids, a very long text, and columns whose names clash with those that stages work with."""
    long = " ".join(f"word{k % 977} of{k}" for k in range(60_000))
    rows = [(1, long, "x", 1), (1, long, "x", 1), (2, long + " end", "y", 2), (None, long, None, 3), (None, None, "z", 4), (3, "", "", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string, item_id int").withColumns({c: F.lit(7) for c in ("label", "component_id", "block", "a", "token", "n_tokens")})
    kept = {"near_duplicates": [1, 1, 3, 4, 5], "decontamination": [1, 1, 2, 3, 4, 5], "secrets": [1, 1, 2, 3, 4, 5]}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SMALL)
        if name in kept:
            assert sorted(r.item_id for r in out.collect()) == kept[name] and out.columns == docs.columns
        elif name == "bpe":
            assert sorted(r.n_tokens > 0 for r in out.collect()) == [False] * 2 + [True] * 4
        else:
            assert out.columns == docs.columns and out.count() <= 6
