import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from conftest import rows
from loadscope.functions import names
from loadscope.operators import serving, sweeps
from loadscope.plans.client_job import serving_report
from loadscope.plans.profile_job import profile_report

MODELS = ["meta-llama_llama-3.1-70b", "meta-llama_llama-3.1-70b-instruct"]


def one(spark, cols, text):
    return spark.createDataFrame([(text,)], "path string").select(
        *[c.alias(k) for k, c in cols(F.col("path"), MODELS).items()]
    ).first().asDict()


def test_profile_names(spark):
    new = (
        "/x/step_profiling_overhead_test_meta-llama_llama-3.1-70b-instruct_tensor_parallelism_1_max_requests_per_batch_256"
        "_max_tokens_per_batch_4352_num_kv_cache_slots_40000_qps_0.500000_num_warmup_requests_10.csv"
    )
    assert one(spark, names.profile_keys, new) == {
        "kind": "step_profiling", "dataset": "overhead_test", "model": MODELS[1], "tp_degree": 1, "max_batch_size": 256,
        "max_tokens_per_batch": 4352, "num_kv_cache_slots": 40000, "rate": 0.5, "num_warmup_requests": 10,
    }
    old = (
        "inference_request_profiling_sharegpt_meta-llama_llama-3.1-70b_tensor_parallelism_4_max_requests_per_batch_8"
        "_max_tokens_per_batch_128_arrival_rate_0.200000_num_warmup_requests_10.csv"
    )
    got = one(spark, names.profile_keys, old)
    assert (got["model"], got["rate"], got["num_kv_cache_slots"], got["max_batch_size"]) == (MODELS[0], 0.2, None, 8)
    assert one(spark, names.profile_keys, "other.csv")["model"] is None


@pytest.mark.parametrize("eager", [True, False])
@pytest.mark.parametrize("v1", [0, 1])
@pytest.mark.parametrize("suffix", ["", "_bz_256_max_num_batched_tokens_256"])
def test_result_names_round_trip(spark, eager, v1, suffix):
    cell = spark.createDataFrame([("my_set", eager, v1, "meta-llama/Llama-3.1-70B-Instruct")], "d string, e boolean, v int, m string")
    name = cell.select(names.result_name(F.col("d"), F.col("e"), F.col("v"), F.col("m"))).first()[0]
    assert one(spark, names.result_keys, "/a/" + name.replace(".json", suffix + ".json")) == {
        "dataset": "my_set", "eager": eager, "v1": v1, "model": MODELS[1]
    }


def test_model_family(spark):
    df = spark.createDataFrame(
        [("a/Mistral-70B",), ("Q/Qwen2-Instruct",), ("Q/Qwen2-70b",), ("Q/Qwen2",), ("L/Llama-70B",)], "m string"
    )
    got = [r[0] for r in df.select(names.model_family(F.col("m"))).collect()]
    assert got == ["mistral", "qwen_instruct", "70B", "8B", "70B"]


def test_grid_feasible_missing(spark):
    cells = sweeps.grid(spark, {"max_batch_size": [64, 256], "max_tokens_per_batch": [128, 256]})
    assert cells.count() == 4
    assert sorted(rows(sweeps.feasible(cells))) == [(64, 128), (64, 256), (256, 256)]
    seen = spark.createDataFrame([(64, 128), (64, 128), (256, 256)], "max_batch_size int, max_tokens_per_batch int")
    assert sorted(rows(sweeps.missing_cells(cells, seen, cells.columns))) == [(64, 256), (256, 128)]
    assert sorted(rows(sweeps.observed_grid(seen, seen.columns))) == [(64, 128), (64, 256), (256, 128), (256, 256)]


def test_task_index_and_zip(spark):
    axes = {"i": 2, "k": 7, "j": 5}
    got = rows(spark.range(70).select(*[c.alias(a) for a, c in sweeps.task_index(F.col("id"), axes).items()]).orderBy("i", "k", "j"))
    assert got == [(i, k, j) for i in range(2) for k in range(7) for j in range(5)]
    zipped = sweeps.zip_config(spark, {"model": ["a", "b"], "tp": [1, 2], "layers": [[4, 16], [8, 40]]}, explode="layers")
    assert sorted(rows(zipped)) == [("a", 1, 4), ("a", 1, 16), ("b", 2, 8), ("b", 2, 40)]
    with pytest.raises(ValueError):
        sweeps.zip_config(spark, {"a": [1], "b": [1, 2]})


RESULTS = "model string, dataset string, v1 int, eager boolean, mean_tpot_ms double, output_throughput double"


def test_lookup(spark):
    results = spark.createDataFrame([("m", "d", 0, True, 5.0, 7.0), ("m", "d", 1, True, 6.0, 8.0)], RESULTS)
    expected = results.select(*sweeps.RESULT_KEY)
    assert sweeps.lookup(results, expected).count() == 2
    twice = results.unionByName(results.limit(1))
    assert sweeps.duplicate_keys(twice).count() == 1
    with pytest.raises(PySparkException):
        sweeps.lookup(twice, expected).collect()
    with pytest.raises(PySparkException):
        sweeps.lookup(results.where("v1 = 0"), expected).collect()
    assert sweeps.lookup(results.where("v1 = 0"), expected, strict=False).where("mean_tpot_ms is null").count() == 1


@pytest.fixture(scope="module")
def log(spark):
    entries = []
    for batch in (64, 256):
        for tokens in (1024, 128):
            for guid in range(3):
                for step, t in ((-2, 0), (-1, 1), (0, 2), (1, 3 + guid), (2, 5 + tokens // 128 + guid)):
                    entries.append(("d", "m", batch, tokens, guid, 0, step, (t + guid) * 1_000_000))
    return spark.createDataFrame(
        entries,
        "dataset string, model string, max_batch_size int, max_tokens_per_batch int, request_guid bigint, "
        "is_warmup_request int, decoding_step_idx int, timestamp_us bigint",
    )


def test_same_request_id_in_two_configurations(log):
    marks = serving.request_marks(log, sweeps.CONFIG)
    both = {tuple(r)[:4]: tuple(r)[4:] for r in sweeps.tpot_and_throughput(marks).collect()}
    tpot = {tuple(r)[:4]: r.mean_tpot_ms for r in sweeps.mean_tpot(marks).collect()}
    thr = {tuple(r)[:4]: r.throughput for r in sweeps.throughput(marks).collect()}
    assert len(both) == 4
    for key, (t, r) in both.items():
        assert t == pytest.approx(tpot[key]) and r == pytest.approx(thr[key])
        last = 5 + key[3] // 128
        assert r == pytest.approx(9 / (last + 4 - 2))


def test_versus_baseline_skips_absent(spark, log):
    results = spark.createDataFrame([("m", "d", 1, True, 5.0, 7.0), ("x", "d", 0, False, 1.0, 1.0)], RESULTS)
    out = sweeps.versus_baseline(serving.request_marks(log, sweeps.CONFIG), results)
    got = sorted((r.series, r.position, r.max_tokens_per_batch) for r in out.collect() if r.series != "baseline v1 (eager)")
    assert got == [("batch 256", 1, 128), ("batch 256", 2, 1024), ("batch 64", 1, 128), ("batch 64", 2, 1024)]
    points = [r for r in out.collect() if r.series.startswith("baseline")]
    assert [(p.series, p.mean_tpot_ms, p.throughput) for p in points] == [("baseline v1 (eager)", 5.0, 7.0)]


def test_report_and_curve(spark, log):
    report = profile_report(log, spark.createDataFrame([], RESULTS))
    assert report["latencies"].count() == 12
    assert report["versus_baseline"].count() == 4
    curve = report["tpot_curve"].orderBy("position").collect()
    assert [r.position for r in curve] == [1, 2, 3, 4]
    assert [r.throughput for r in curve] == sorted(r.throughput for r in curve)


def test_serving_report(spark):
    records = spark.createDataFrame(
        [(1, True, 3, 5, 0.1, 0.5, "x")],
        "request_id int, success boolean, prompt_len int, output_tokens int, ttft_s double, latency_s double, generated_text string",
    )
    gaps = spark.createDataFrame([(1, True, 0.1)], "request_id int, success boolean, itl_s double")
    record, metrics = serving_report(records, 2.0, token_gaps=gaps, slo=["ttft:200"], config={"backend": "b"}, metadata=["k=v"])
    row = record.first()
    assert (row.backend, row.request_goodput, row.mean_itl_ms, row.metadata) == ("b", 0.5, 100.0, {"k": "v"})
    assert metrics.count() == 12 and metrics.where("value[0] is null").count() == 0
