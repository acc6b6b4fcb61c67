"""What shows on tables larger than the smallest: groups after unions, numbers over several partitions, silence that lasts."""

import pyarrow as pa
from pyspark.sql import functions as F

from spanloom import plans
from spanloom.operators import store
from spanloom.operators.deal import dealt, united
from spanloom.streaming import segments as S


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_sessions_are_dealt_out_after_a_union(spark):
    """Both sides are dealt out by the key already, but each may be read in partitions of its own."""
    rows = spark.range(4000).select((F.col("id") % 500).alias("k"), "id")
    many, few = (rows.groupBy("k").agg(f("id").alias("x")) for f in (F.max, F.min))
    assert "Exchange" in plan(united(many, few).repartition("k")).split("Union")[0]


def test_new_records_are_numbered_as_they_were_written(spark):
    """The partitions that are counted are those that the numbers are given in."""
    drafts = spark.range(0, 2000, numPartitions=7).select(F.format_string("%06d", "id").alias("id"), F.lit("x").alias("text"), F.timestamp_seconds(F.lit(0)).alias("at"))
    found = store.save(spark.createDataFrame([], store.RECORD), drafts, ["id"])
    assert "rangepartitioning" not in plan(found)
    assert found.where("display_sequence = cast(id as long) + 1").count() == 2000


def test_the_background_stays_at_silence(spark, tmp_path):
    rows = [(1, 1, 9.0), (2, 1, 0.0), (3, 1, 7.0), (4, 2, 3.0), (5, 2, 8.0)]
    spark.createDataFrame(rows, "event_id long, user_id long, value double").write.parquet(f"{tmp_path}/events.parquet")
    found = plans.queries()["baseline_follower"](spark, str(tmp_path)).collect()
    assert {(r["event_id"], r["baseline"]) for r in found} == {(1, 0.008), (2, 0.0), (3, 0.0), (4, 0.003), (5, 0.00306)}


def test_a_chunk_without_a_level_leaves_the_rise_alone():
    s = S.Follower()
    assert [S.follow_step(s, {"event_id": 1, "rms": x})[0][1] for x in (None, float("nan"), 0.001)] == [0.008, 0.008 * 1.02, 0.001]


def test_words_are_split_once_a_verse(spark):
    """Not for each of its words, inside of what is made of them."""
    made = plans.queries()["timed_reconcile"](spark, "/root/testdata/sf0.001")
    assert made._jdf.queryExecution().optimizedPlan().toString().count("regexp_replace") == 2  # marks and spaces, once each


def test_a_fold_holds_the_results_of_few_rows_at_once():
    import pandas as pd
    from pyspark.sql.types import LongType, StructField, StructType

    from spanloom.streaming import folds

    class Rows:
        schema = StructType([StructField("k", LongType())])
        repartition = sortWithinPartitions = lambda self, *c: self
        mapInPandas = lambda self, run, kind: list(run(iter([pd.DataFrame({"k": [1] * 700 + [2] * 500, "n": range(1200)}), pd.DataFrame({"k": [], "n": []})])))  # noqa: E731, N815

    found = folds.run_batch(Rows(), "k", "n", dict, lambda s, x: [(x["n"],)] * 10, "n long", lambda s: [(-1,)])
    assert max(map(len, found)) <= 10 * folds.ROWS + 1
    every = pd.concat(found)
    assert len(every) == 12_002 and every["n"].eq(-1).sum() == 2


def test_tuning_works_its_five_out_once(spark):
    """What recalls the passages of a document isn't part of the plan that reads them twice."""
    from spanloom.plans import relations

    for query in (relations.tuning_rates, relations.tuning_report):
        assert "MapInArrow" not in query(spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()


def test_rows_dealt_out_by_the_keys_of_a_step_before_go_to_all_tasks(spark):
    """Spark leaves out a deal by keys that rows are dealt by already, and merges small partitions of the step before."""
    rows = spark.range(64).select((F.col("id") % 50).alias("id")).distinct()
    full = lambda batches: (b for b in [pa.RecordBatch.from_pydict({"n": [sum(b.num_rows for b in batches)]})] if b["n"][0].as_py())
    assert dealt(rows, "id").mapInArrow(full, "n long").count() > 1
