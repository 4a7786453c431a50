"""Every stage on what the stage before it kept, against the plain versions."""

import uuid
from collections import defaultdict

import pyarrow.parquet as pq
import pytest
from ldspark.llm import decontam

from .test_ops import brute_classes, brute_leaks, brute_lines, brute_pack, line_set

corpus_pipeline = pytest.importorskip("corpus_pipeline")
SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, kept = docs.columns, []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        out.write.parquet(path := f"{tmp_path}/{uuid.uuid4().hex}")
        docs = spark.read.parquet(path)
        kept.append(docs.collect())
        assert k == 4 or docs.columns == columns
    start = pq.read_table(f"{SF}/documents.parquet").to_pylist()
    assert {r["doc_id"] for r in kept[0]} >= {r["doc_id"] for r in start if r["lang"] and len(r["text"]) > 100}
    removed = brute_lines([(r["doc_id"], r["text"]) for r in kept[0]])
    want = {}
    for r in kept[0]:
        rest = [x for i, x in enumerate(r["text"].split("\n")) if i not in removed[r["doc_id"]]]
        if any(line_set(x) for x in rest):
            want[r["doc_id"]] = "\n".join(rest)
    assert {r["doc_id"]: r["text"] for r in kept[1]} == want
    assert {r["doc_id"] for r in kept[2]} == set(brute_classes([(r["doc_id"], r["text"]) for r in kept[1]]).values())
    items = [(r["item_id"], r["text"]) for r in pq.read_table(f"{SF}/benchmark.parquet").to_pylist()]
    parts = {i: set(decontam.shingles(decontam.words_of(t))) for i, t in items}
    leaky = set()
    for r in kept[2]:
        own = set(decontam.shingles(decontam.words_of(r["text"])))
        if brute_leaks(r["text"], [(i, t) for i, t in items if parts[i] & own]):
            leaky.add(r["doc_id"])
    assert {r["doc_id"] for r in kept[3]} == {r["doc_id"] for r in kept[2]} - leaky
    bins = defaultdict(int)
    for r in kept[4]:
        bins[r["sequence_id"]] += r["length"]
    assert max(bins.values()) <= 2048 and len(bins) == len(brute_pack([r["length"] for r in kept[4]], 2048))
    assert {r["doc_id"] for r in kept[4]} == {r["doc_id"] for r in kept[3]}


def test_run_on_an_empty_table(spark, tmp_path):
    for name in ("documents", "benchmark"):
        spark.read.parquet(f"{SF}/{name}.parquet").filter("false").write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
