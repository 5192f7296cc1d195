import collections

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quarry.llm import mixing, simhash

SMALL = "/root/testdata/sf0.01"


def test_stages_in_order_keep_columns(spark, tmp_path):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    counts = [docs.count()]
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SMALL)
        if i < 4:
            assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        counts.append(docs.count())
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "near_duplicates", "source_mix", "packing"]
    assert counts[1] > 0.97 * counts[0] and counts[2] <= counts[1] and counts[3] < counts[2]
    lines = spark.read.parquet(str(tmp_path / "line_dedup"))
    kept = spark.read.parquet(str(tmp_path / "near_duplicates"))
    assert kept.count() == simhash.near_duplicates(lines).select("component_id").distinct().count() == kept.select("doc_id").distinct().count()
    packed = collections.Counter(r["doc_id"] for r in docs.where("start = 0").collect())
    mixed = spark.read.parquet(str(tmp_path / "source_mix"))
    assert packed == collections.Counter(r["doc_id"] for r in mixed.collect()) and max(packed.values()) <= 3


def test_run_matches_stages_and_odd_rows(spark, odd, none):
    assert corpus_pipeline.run(spark, "/root/testdata/sf0.001").count() > 0
    for df in (odd, none):
        docs = df
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, "")
            assert docs.columns == df.columns
        assert corpus_pipeline.STAGES[-1][1](spark, docs, "").count() >= 0


def test_repeated_rows_leave_one(spark):
    rows = [(1, "a b c d e", "x"), (1, "a b c d e", "x"), (2, "a b c d e", "y"), (None, "q r s t u v w", "z"), (None, "q r s t u v w", "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = [tuple(r) for r in corpus_pipeline.near_duplicates(spark, df, "").collect()]
    assert sorted(got, key=str) == [(1, "a b c d e", "x"), (None, "q r s t u v w", "z")]


@pytest.mark.parametrize("times", [1, 40])
def test_mix_copies(spark, times):
    df = spark.createDataFrame([(i, "w " * 50, f"s{i % 3}") for i in range(30 * times)], "doc_id long, text string, source string")
    n = corpus_pipeline.source_mix(spark, df, "").groupBy("source").agg(F.count("*").alias("n")).collect()
    got = {r["source"]: r["n"] / (30 * times) for r in n}
    assert got["s0"] == pytest.approx(5 / 8, abs=0.05) and got["s1"] == pytest.approx(2 / 8, abs=0.05)


def test_mix_comes_in_slot_order(spark):
    """Any leading part of the mix holds its sources in the ratio of their targets, to a block or two."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    sizes = mixing.word_count(F.col("text"))
    out = [(r["source"], r["n"]) for r in corpus_pipeline.source_mix(spark, docs, "").select("source", sizes.alias("n")).collect()]
    targets = {r["source"]: r["target"] for r in mixing.mix(docs)[0].select("source", "target").distinct().collect()}
    total = sum(n for _, n in out)
    assert total == pytest.approx(sum(targets.values()), rel=0.01)
    for part in (0.25, 0.5, 0.75, 1):
        got, seen = collections.Counter(), 0
        for source, n in out:
            if seen >= part * total:
                break
            got[source] += n
            seen += n
        for source, t in targets.items():
            assert abs(got[source] - part * t) < max(0.05 * t, 24 * mixing.BLOCK), (part, source)


def test_line_dedup_keeps_what_it_does_not_change(spark):
    rows = [(i, t, 99) for i, t in enumerate([None, "", " \n", "a line that three documents share\nown", "a line that three documents share", "a line that three documents share"])]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_chars long")
    got = {tuple(r) for r in corpus_pipeline.line_dedup(spark, df, "").collect()}
    assert got == {(0, None, 99), (1, "", 99), (2, " \n", 99), (3, "own", 3), (5, "a line that three documents share", 99)}


def test_language_stage_acts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    foreign = spark.createDataFrame([(10**9 + i, "xq zvk wjq kzx " * 100, None, "s", 1500) for i in range(20)], docs.schema)
    left = corpus_pipeline.known_language(spark, docs.unionByName(foreign), "")
    assert left.where("doc_id >= 1000000000").count() == 0 and left.count() > 0.99 * docs.count()
