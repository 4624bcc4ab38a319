"""The pipeline against its operators' own brute-force versions, stage by stage."""

import re

import corpus_pipeline
import numpy as np
from pyspark.sql import functions as F

from tests.llm.test_dedup import brute_alike
from tests.llm.test_packing import check
from tessera.llm import language, toxicity


def test_stages_and_run(spark):
    sf_dir = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.trained(docs, labels)
    rows = {r.doc_id: r.text for r in docs.collect()}
    kept = {i: x for (i, x), s in zip(rows.items(), model.scores(list(rows.values())), strict=True) if s < toxicity.THRESHOLD}
    assert 0 < len(kept) < len(rows)
    known = language.learned_from(docs)
    far = {i: language.profile(x) for i, x in kept.items()}
    kept = {i: x for i, x in kept.items() if far[i] is not None and max(float(p @ far[i]) for p in known.values()) >= language.CHANCE * np.linalg.norm(far[i])}
    first = {}
    for i, x in sorted(kept.items(), key=lambda p: (-len(p[1]), p[0])):
        first.setdefault(re.sub(r"[\x20\x09-\x0D]", "", x), i)
    kept = {i: kept[i] for i in first.values()}
    low = brute_alike(kept)  # five words and a similarity of 0.8, as stages on word shingles take
    kept = {i: x for i, x in kept.items() if low[i] == i}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf_dir)
        assert set(docs.columns) == {"doc_id", "text", "lang", "source", "n_chars"}, name
    out = corpus_pipeline.run(spark, sf_dir).collect()
    assert {r.doc_id for r in out} == set(kept)
    used, least = check(out, list(kept.items()))
    assert used <= least + 1


def test_odd_documents(spark, sf_dir):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (3, "12 34", "en", "s", 5), (4, "some words here", None, None, 1), (4, "some words here", None, None, 1), (5, "SOME words  here", "en", "s", 1), (6, "a long text of words " * 20_000, "en", "s", 0)]
    clashing = ["_toxicity", "_language", "_digest", "_chars", "_n", "_mixed", "size", "key"]
    docs = spark.createDataFrame(rows, schema).select("*", *[F.lit(name).alias(name) for name in clashing])
    columns = docs.columns
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf_dir)
        assert docs.columns == columns
    assert all(r[name] == name for r in docs.collect() for name in clashing)
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).collect()
    assert sorted({r.doc_id for r in packed}) in ([4, 6], [5, 6])
    assert sum(r.length for r in packed if r.doc_id == 6) > 100_000 and len({(r.doc_id, r.piece) for r in packed}) == len(packed)
    empty = spark.createDataFrame([], schema)
    for _, stage in corpus_pipeline.STAGES:
        empty = stage(spark, empty, sf_dir)
    assert empty.collect() == []
    assert len(language.learned_from(spark.createDataFrame([], schema))) == 0
