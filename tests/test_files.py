import json
import os

import pytest
from pyspark.sql import functions as F

from conftest import rows
from loadscope.functions.names import result_keys
from loadscope.operators import ordered, traces
from loadscope.session import shared_path
from loadscope.sources import corpora, files, logs


@pytest.fixture
def folder(spark):
    return shared_path(spark, "files")


def entries(spark, n=5):
    base = spark.range(n).select(
        F.col("id").alias("ordinal"), F.concat(F.lit('p"\n'), F.col("id").cast("string")).alias("prompt"), F.lit("r s").alias("response")
    )
    return traces.with_lengths(base).withColumn("arrival_time", F.col("ordinal") / 2)


def test_trace_folder(spark, folder):
    e = entries(spark).repartition(3)
    meta = traces.metadata(e, "poisson", 1.0)
    files.write_trace(e, meta, folder)
    assert sorted(rows(files.read_trace(spark, folder, 3))) == [(i, f'p"\n{i}', 2, 2) for i in range(3)]
    lines = [json.loads(r[0]) for r in spark.read.text(f"{folder}/entries").collect()]
    assert sorted(x["arrival_time"] for x in lines) == [0.0, 0.5, 1.0, 1.5, 2.0]
    assert spark.read.json(f"{folder}/metadata").first()["total_tokens"] == 20
    assert files.read_trace(spark, folder).count() == 5


def test_text_round_trip(spark, folder):
    texts = spark.createDataFrame([("a\nb",), ('"q"',), ("",)], "text string")
    files.write_texts(texts, folder)
    assert sorted(rows(files.read_texts(spark, folder))) == sorted(rows(texts))


def test_record_without_bulky_fields(spark, folder):
    record = spark.range(1).select(F.lit(1).alias("completed"), F.array(F.lit(0.5)).alias("ttfts"))
    files.write_record(record, folder)
    assert spark.read.json(folder).columns == ["completed"]


def test_equal_steps_have_ids_of_their_own(spark, tmp_path):
    """Three files of equal rows at one time stamp, cut into many splits: unique ids, the same in every scan."""
    columns = "timestamp,run_idx,is_warmup_step,num_decoding_tokens,num_prefilling_tokens,num_finetuning_fwd_tokens,num_finetuning_bwd_tokens,num_bwd_layers"
    for k in range(3):
        (tmp_path / f"{k}.csv").write_text(columns + "\n" + "5,1,0,256,0,0,0,0\n" * 2000)
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "5000")
    try:
        log = logs.read_step_log(spark, str(tmp_path))
        assert log.rdd.getNumPartitions() > 6
        ids = {r.step_id for r in log.select("step_id").collect()}
        assert len(ids) == 6000 and ids == {r.step_id for r in log.where("run_idx = 1").collect()}
        sizes = ordered.sorted_runs(log, ["timestamp_us", "step_id"], 8).groupBy("_run").count().toPandas()["count"]
        assert sizes.max() < 6000 / 4
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)


def test_logs_by_name(spark, tmp_path):
    name = (
        "inference_request_profiling_overhead_test_org_m_tensor_parallelism_2_max_requests_per_batch_8"
        "_max_tokens_per_batch_64_num_kv_cache_slots_100_qps_0.000000_num_warmup_requests_3.csv"
    )
    (tmp_path / name).write_text(
        "timestamp,extra,request_guid,decoding_step_idx,is_warmup_request\n5,x,1,-2,0\n6,y,,0,1\n"
    )
    log = logs.read_request_log(spark, str(tmp_path), ["m", "org_m"])
    out = log.select("request_guid", "decoding_step_idx", "timestamp_us", "dataset", "model", "max_batch_size", "tp_degree")
    assert sorted(rows(out), key=str) == [(1, -2, 5, "overhead_test", "org_m", 8, 2), (None, 0, 6, "overhead_test", "org_m", 8, 2)]
    plan = log.select("request_guid")._jdf.queryExecution().executedPlan().toString()
    assert "extra" not in plan.split("ReadSchema")[1]
    (tmp_path / name.replace("per_batch_64", "per_batch_32")).write_text(
        "request_guid,timestamp,extra,decoding_step_idx,is_warmup_request\n5,1,x,-2,0\n"
    )
    with pytest.raises(Exception, match="CSV header does not conform"):
        logs.read_request_log(spark, str(tmp_path), ["org_m"]).collect()
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad" / "x.csv").write_text("a,b\n1,2\n")
    with pytest.raises(ValueError):
        logs.read_request_log(spark, str(tmp_path / "bad"))


def test_step_arrival_and_burst_logs(spark, tmp_path):
    (tmp_path / "step.csv").write_text(
        "run_idx,is_warmup_step,timestamp,num_decoding_tokens,num_prefilling_tokens,num_finetuning_fwd_tokens,"
        "num_finetuning_bwd_tokens,num_bwd_layers\n1,0,10,2,3,4,5,6\n1,0,11,2,3,4,5,6\n"
    )
    step = logs.read_step_log(spark, str(tmp_path / "step.csv"))
    assert step.select("step_id").distinct().count() == 2 and step.first().num_bwd_layers == 6
    (tmp_path / "arrivals.csv").write_text("TIMESTAMP,n\n2023-11-16 18:15:46.6805900,1\n2023-11-16 18:15:47.0000000,2\n")
    assert sorted(r.t_us for r in logs.read_arrival_log(spark, str(tmp_path / "arrivals.csv")).collect()) == [0, 319_410]
    (tmp_path / "burst.csv").write_text(
        "Timestamp,Model,Request tokens,Response tokens,Total tokens,Log Type\n5,ChatGPT,1,2,3,a\n7.5,GPT-4,1,2,3,a\n"
    )
    assert rows(logs.read_burst_log(spark, str(tmp_path / "burst.csv"))) == [(5.0,)]


def test_conversations(spark, tmp_path, folder):
    talks = [{"id": "x", "conversations": [{"from": "human", "value": "a"}, {"from": "gpt", "value": "b"}]}]
    (tmp_path / "one.json").write_text(json.dumps(talks, indent=2))
    corpus = corpora.read_conversations(spark, str(tmp_path / "one.json"), single_document=True)
    assert rows(traces.first_exchange(corpus)) == [("a", "b")]
    corpora.to_lines(corpus, folder)
    assert rows(traces.first_exchange(corpora.read_conversations(spark, folder))) == [("a", "b")]


def test_results(spark, tmp_path):
    (tmp_path / "results_sharegpt_eager_v1_org_m.json").write_text('{"mean_tpot_ms": 1.5,\n "output_throughput": 9.0, "x": []}')
    got = files.read_results(spark, str(tmp_path), ["org_m"]).first().asDict()
    assert got == {"mean_tpot_ms": 1.5, "output_throughput": 9.0, "dataset": "sharegpt", "eager": True, "v1": 1, "model": "org_m"}


def test_named_files_hold_all_rows(spark, folder):
    """Several tasks and several files for one name, and names that differ only in rows."""
    df = spark.range(0, 1000, 1, 7).select(F.when(F.col("id") % 3 == 0, "results_b_org_m.json").otherwise("results_a_org_m.json").alias("file"), F.col("id").cast("double").alias("mean_tpot_ms"))
    spark.conf.set("spark.sql.files.maxRecordsPerFile", 100)
    try:
        files.write_named(df, "file", folder, "json")
    finally:
        spark.conf.unset("spark.sql.files.maxRecordsPerFile")
    got = spark.read.json(f"{folder}/results_*.json").select("*", F.col("_metadata.file_path").alias("path"))
    got = got.select("mean_tpot_ms", result_keys(F.col("path"), ["org_m"])["dataset"].alias("dataset"))
    assert sorted((r.dataset, r.mean_tpot_ms) for r in got.collect()) == sorted(("b" if k % 3 == 0 else "a", float(k)) for k in range(1000))
    names = os.listdir(folder)
    assert "results_a_org_m.json" in names and "results_a_org_m_part_1.json" in names and "_staged" not in names


def test_a_failed_rename_raises(spark, folder):
    os.makedirs(folder)
    df = spark.createDataFrame([("y.json", 1)], "file string, n int")
    with open(f"{folder}/y.json", "w") as f:
        f.write("taken")
    with pytest.raises(Exception, match="y.json"):
        files.write_named(df, "file", folder, "json")
