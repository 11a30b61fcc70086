"""Stems as columns: equal to the expression, and small enough to be compiled."""

from quillspark.functions import text as T


def test_steps_are_columns_and_give_the_stems(spark):
    words = ["classes", "ponies", "cats", "running", "sing", "hopped", "bed", "falling", "as", "ing", "s", "", "eed", "needed", "misses", "pass", "übersetzungen", "buzzing", None]
    rows = spark.createDataFrame([(i, w) for i, w in enumerate(words)], "i int, word string")
    stems = T.with_stems(rows)
    assert stems.columns == ["i", "word", "term"]
    got = stems.withColumn("whole", T.stem(T.F.col("word"))).collect()
    assert [r.term for r in got] == [r.whole for r in got]
    plan = spark._jvm.org.apache.spark.sql.execution.debug.package.codegenStringSeq(T.with_stems(spark.range(99).selectExpr("cast(id as string) as word"))._jdf.queryExecution().executedPlan())
    assert 0 < len(plan.apply(0)._2()) < 150_000
