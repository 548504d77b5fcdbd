"""Work that a small table stands for is dealt over tasks."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphloom.bindings import code, scalar

SF = "/root/testdata/sf0.001"


def test_sources_of_a_small_file_of_parts_are_parsed_in_several_tasks(spark, monkeypatch):
    for files in (code.chain, code.library):
        assert files(spark, SF).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism > 1
    monkeypatch.setattr(code, "PARTS_PER_TASK", 10)
    n = code.chain(spark, SF).count()
    assert code.chain(spark, SF).rdd.getNumPartitions() == -(-n // 10)


def test_cluster_prompts_are_made_in_several_tasks_of_lines_made_once(spark):
    plan = scalar.QUERIES["f27_cluster_prompt"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" not in plan and "transform" not in plan and str(scalar.DEAL_TASKS) in plan


def test_roots_that_read_alike_are_digested_once(spark, tmp_path):
    """Ten times the roots of a file make its prompt longer, not more of them to be digested."""
    part = spark.read.parquet(f"{SF}/part.parquet")
    part = part.crossJoin(spark.range(10).withColumnRenamed("id", "copy")).withColumn("p_partkey", F.col("p_partkey") + F.col("copy") * 10_000).drop("copy")
    part.write.parquet(str(tmp_path / "part.parquet"))
    out = scalar.QUERIES["f27_cluster_prompt"](spark, str(tmp_path))
    assert out.select("p_partkey").distinct().count() == out.count() == part.count()
    plan = out._jdf.queryExecution().optimizedPlan().toString().splitlines()
    dealt = [i for i, line in enumerate(plan) if f", {scalar.DEAL_TASKS}" in line and "RepartitionByExpression" in line]
    kinds = [i for i, line in enumerate(plan) if "Aggregate [p_brand" in line]
    assert len(kinds) == 1 and dealt[0] < kinds[0]  # told apart before they meet the lines


def test_prompts_go_to_workers_in_bounded_batches(spark):
    """A prompt is several KB; a batch of 10,000 of them is not held by a worker."""
    for name in ("maxRecordsPerBatch", "maxBytesPerBatch"):
        spark.conf.unset(f"spark.sql.execution.arrow.{name}")
    code.QUERIES["x4_two_stages"](spark, "/root/testdata/sf0.001")
    assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= 512
    assert int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch").removesuffix("b")) <= 8 << 20
