from __future__ import annotations

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

from tidemark.operators.fields import text_plan
from tidemark.plans import catalog
from tidemark.sources import parquet, shards
from tidemark.streaming import totals


def test_cost_counts_only_the_leaves_and_the_gate_refuses(spark, tmp_path):
    df = spark.range(2000).select(F.col("id"), F.array(F.struct(F.repeat(F.lit("x"), 50).alias("content"), F.lit("user").alias("role"), F.sha2(F.col("id").cast("string"), 256).alias("extra"))).alias("messages"))
    df.coalesce(2).write.parquet(str(tmp_path / "t"))
    foot = parquet.footers(spark, str(tmp_path / "t"))
    cost = parquet.scan_cost(foot, text_plan(df.schema).leaves)
    row = cost.first()
    assert row.rows == 2000 and 0 < row.bytes < foot.agg(F.sum("compressed_bytes")).first()[0] / 2
    assert parquet.guard(cost, 5.0) == row.bytes
    with pytest.raises(parquet.ScanTooLarge):
        parquet.guard(cost, 1e-9)
    assert parquet.guard(cost, 1e-9, agreed=True) == row.bytes


def test_numbering_is_dense(spark):
    n = parquet.numbered(spark.range(500).select((F.col("id") * 3).alias("k")).repartition(5), "k")
    assert [r.row_number for r in n.orderBy("k").collect()] == list(range(500))
    assert [r.k for r in parquet.row_page(n, "row_number", 10, 3).orderBy("k").collect()] == [30, 33, 36]


def test_shard_heads_leave_out_the_cut_line(spark, tmp_path):
    lines = b"".join(b'{"n": %d, "pad": "%s"}\n' % (i, b"p" * 40) for i in range(50))
    (tmp_path / "a.jsonl").write_bytes(lines)
    (tmp_path / "b.jsonl.zst").write_bytes(zstandard.compress(lines))
    got = shards.shard_heads(spark, str(tmp_path), read_bytes=1000).groupBy(F.element_at(F.split("file", "/"), -1).alias("f")).count().collect()
    counts = {r.f: r["count"] for r in got}
    assert counts["a.jsonl"] == 1000 // len(b'{"n": 0, "pad": "' + b"p" * 40 + b'"}\n')
    assert counts["b.jsonl.zst"] > counts["a.jsonl"]


def test_names_tell_source_and_topic(spark):
    rules = shards.NameRules(sources=[("crawl", "web"), ("crawl_pdf", "pdf")], aliases={"crime_law": "crime_and_law"})
    df = spark.createDataFrame([("crawl-high-quality_19_crime_law-0003",), ("crawl_pdf-science-12",), ("ingredient2-plain",)], "d string")
    got = [tuple(r.g) for r in df.select(rules.split(F.col("d")).alias("g")).collect()]
    assert got == [("web", "crime_and_law"), ("pdf", "science"), ("plain", "")]


def test_step_layout_and_reading(spark, tmp_path):
    ids = np.arange(6 * 4 * 5, dtype="<u2")
    raw = ids.tobytes()
    cut = [100, len(raw) - 100]
    (tmp_path / "0.bin").write_bytes(raw[:100])
    (tmp_path / "1.bin").write_bytes(raw[100:])
    layout = shards.StreamLayout(6, 4, 5, cut)
    assert layout.step_bytes == 40 and layout.segments(2) == [(0, 80, 20), (1, 0, 20)]
    got = shards.read_steps(spark, [f"file://{tmp_path}/{k}.bin" for k in range(2)], layout, [2, 5]).orderBy("step", "sequence").collect()
    assert [list(r.ids) for r in got[:4]] == ids[40:60].reshape(4, 5).tolist() and len(got) == 8
    with pytest.raises(ValueError):
        shards.StreamLayout(7, 4, 5, cut).check()
    long = shards.StreamLayout(143_000, 1024, 2049, [600_078_336_000])
    long.check()
    assert long.step_bytes == 4_196_352


def test_markdown_table(spark):
    lines = spark.createDataFrame(list(enumerate(["| name | a | b |", "|---|---|---|", "| x | 1 | 2 |", "text"])), "line int, value string")
    got = {(r.name, r.cell) for r in shards.markdown_table(lines).collect()}
    assert got == {("name", "x"), ("a", "1"), ("b", "2")}


def test_catalog_and_results(spark, tmp_path):
    c = catalog.catalog(spark, [{"target": "t", "stage": "s", "kind": "sft", "table": "sft_rows", "source_columns": ["source"]}])
    assert c.first().source_columns == ["source"]
    with pytest.raises(ValueError):
        catalog.catalog(spark, [{"target": "t", "stage": "s", "kind": "odd", "table": "x"}])
    catalog.save(spark.range(3), str(tmp_path), "t", "s", "grep", "x")
    catalog.save(spark.range(4), str(tmp_path), "t", "s", "roles", "x")
    assert catalog.find(spark, str(tmp_path), layer="grep").count() == 3
    v = spark.createDataFrame([(1.2345678901234567,), (0.0,), (None,)], "v double").select(catalog.significant("v", 5).alias("v")).collect()
    assert [r.v for r in v] == [1.2346, 0.0, None]


def test_stream_equals_batch(spark, tmp_path):
    df = spark.createDataFrame([(i, "abc" if i % 3 else None, "s" if i % 2 else "t") for i in range(60)], "id long, text string, source string")
    df.repartition(6).write.parquet(str(tmp_path / "docs.parquet"))
    s = totals.parquet_stream(spark, str(tmp_path / "docs.parquet"))
    got = {tuple(r) for r in totals.drain(totals.stream_totals(s, F.col("source"), F.col("text"), lambda t: F.contains(t, F.lit("b")))).collect()}
    want = {tuple(r) for r in df.groupBy("source").agg(F.count("*"), F.count_if(F.coalesce(F.contains("text", F.lit("b")), F.lit(False)))).collect()}
    assert got == want
