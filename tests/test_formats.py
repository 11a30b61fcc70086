"""Scores in lines of text, digit by digit as C's printf writes them."""

import random

from quillspark.sources import records


def test_scores_halfway_between_two_decimals_are_rounded_as_printf_does(spark):
    r = random.Random(1)
    values = [k / 1e6 for k in range(-1_000_000, 1_000_001, 50)] + [0.0, -0.0, -0.00001, 0.03125, 0.09375, 12.5, 0.999950, 0.99995000001]
    values += [r.uniform(-2, 2) for _ in range(2_000)]
    got = spark.createDataFrame([(v,) for v in values], "x double").select("x", records.fixed(records.F.col("x")).alias("s")).collect()
    assert [x.s for x in got] == [f"{x.x:.4f}" for x in got]


def test_report_lines_of_a_score_that_is_a_little_below_its_decimals(spark):
    scores = spark.createDataFrame([(1, 1, 7, 0.97145), (1, 2, 8, 0.03125)], "query_id long, rank long, doc_id long, score double")
    names = spark.createDataFrame([(7, "seven")], "doc_id long, title string")
    assert [r.line for r in records.report(scores, names).orderBy("rank").collect()] == [f"1. [Score: {0.97145:.4f}] seven (ID: 7)", "2. [Score: 0.0312] Title not found. (ID: 8)"]
