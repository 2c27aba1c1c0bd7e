import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from pageloom.operators import store
from pageloom.operators.ranking import first_per_group, ordered_rank
from pageloom.plans.config import RetryConfig
from pageloom.plans.fetch import fetch_schedule
from pageloom.plans.retry import is_retryable, retry_plan
from pageloom.session import bucket_count, buckets_for, cut_lineage, estimated_bytes

T0 = datetime(2024, 1, 1)


def at(seconds):
    return T0 + timedelta(seconds=seconds)


def test_rank_with_one_hot_group(spark):
    rng = random.Random(3)
    rows = [("hot" if rng.random() < 0.5 else f"g{rng.randint(0, 40)}", i) for i in range(3000)]
    rng.shuffle(rows)
    frame = spark.createDataFrame(rows, "g string, n int").repartition(7)
    ranked = ordered_rank(frame, ["g"], ["n"])
    seen = {}
    for g, n in sorted(rows):
        seen.setdefault(g, []).append(n)
    want = {(g, n): i + 1 for g, ns in seen.items() for i, n in enumerate(ns)}
    assert {(r.g, r.n): r["rank"] for r in ranked.collect()} == want
    firsts = {(r.g, r.n) for r in first_per_group(frame, ["g"], ["n"], 20_000).collect()}
    assert firsts == set(want)
    few = {(r.g, r.n) for r in first_per_group(frame, ["g"], ["n"], 3).collect()}
    assert few == {key for key, rank in want.items() if rank <= 3}


def test_small_limit_is_applied_before_the_shuffle(spark):
    frame = spark.range(1000).selectExpr("id % 3 AS g", "id AS n")
    plan = first_per_group(frame, ["g"], ["n"], 5)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2


def test_fetch_schedule(spark):
    urls = spark.createDataFrame([("a", i) for i in range(5)] + [("b", 9)], "host string, n int")
    rows = {(r.host, r.n): r.start_seconds for r in fetch_schedule(urls, ["n"], 2.5, 500).collect()}
    assert rows == {("a", 0): 0.5, ("a", 1): 0.5, ("a", 2): 0.9, ("a", 3): 1.3, ("a", 4): 1.7, ("b", 9): 0.5}
    slow = fetch_schedule(urls, ["n"], 0.5, 0).where("host = 'a'").orderBy("n").collect()
    assert [r.start_seconds for r in slow] == [0.0, 2.0, 4.0, 6.0, 8.0]
    free = fetch_schedule(urls, ["n"], 0, 250).collect()
    assert {r.start_seconds for r in free} == {0.25}


def test_retry_plan(spark):
    t = "i/o timeout"
    attempts = [("x", at(i), i, t) for i in range(6)]
    attempts += [("ok", at(0), 0, t), ("ok", at(1), 1, None), ("ok", at(2), 2, t)]
    attempts += [("bad", at(0), 0, "HTTP 404"), ("bad", at(1), 1, t)]
    frame = spark.createDataFrame(attempts, "key string, ts timestamp, seq int, error string")
    rows = retry_plan(frame).orderBy("key", "attempt").collect()
    assert [(r.key, r.attempt, r.status) for r in rows] == [
        ("bad", 1, "fatal"),
        ("ok", 1, "retry"),
        ("ok", 2, "done"),
        ("x", 1, "retry"),
        ("x", 2, "retry"),
        ("x", 3, "retry"),
        ("x", 4, "exhausted"),
    ]
    waits = [(r.retry_at - r.ts).total_seconds() for r in rows if r.key == "x" and r.retry_at]
    assert waits == [1, 2, 4]
    long = RetryConfig(max_retries=5)
    waits = [(r.retry_at - r.ts).total_seconds() for r in retry_plan(frame, long).collect() if r.key == "x" and r.retry_at]
    assert sorted(waits) == [1, 2, 4, 8, 10]


def test_retryable(spark):
    cases = {"Read TIMEOUT": True, "connection refused": True, "Network down": True,
             "temporary failure": True, "context canceled": True, "context deadline exceeded": True,
             "HTTP 500": False, "": False, None: False}
    frame = spark.createDataFrame([(m,) for m in cases], "m string")
    rows = frame.select("m", is_retryable(F.col("m")).alias("r")).collect()
    assert {r.m: r.r for r in rows} == cases


def test_store(spark):
    def put(*writes):
        frame = spark.createDataFrame(writes, "key string, value string, ts timestamp")
        return store.entries(frame, F.col("ts"), ttl_hours=1)

    def get(table, *keys, now=60):
        frame = spark.createDataFrame([(k,) for k in keys], "key string")
        rows = store.lookup(frame, table, F.lit(at(now))).collect()
        return {r.key: (r.value, r.found) for r in rows}

    table = put(("test-key", "v1", at(0)), ("other", "w", at(0)), ("test-key", "v2", at(10)))
    assert get(table, "test-key", "non-existent") == {"test-key": ("v2", True), "non-existent": (None, False)}
    assert get(table, "test-key", now=3609) == {"test-key": ("v2", True)}
    assert get(table, "test-key", now=3610) == {"test-key": (None, False)}
    gone = store.delete(table, spark.createDataFrame([("test-key",)], "key string"))
    assert get(gone, "test-key", "other") == {"test-key": (None, False), "other": ("w", True)}
    assert tuple(store.item_count(table, F.lit(at(3605))).first()) == (1, 1)
    assert tuple(store.item_count(store.clear(table), F.lit(at(0))).first()) == (0, 0)


def test_store_files(spark, tmp_path):
    path = str(tmp_path / "store")
    for i in range(2):
        frame = spark.createDataFrame([("k", f"v{i}", at(i))], "key string, value string, ts timestamp")
        store.append(store.entries(frame, F.col("ts")), path)
    store.compact(spark.read.parquet(path), F.lit(at(5)), str(tmp_path / "clean"))
    assert [r.value for r in spark.read.parquet(str(tmp_path / "clean")).collect()] == ["v1"]


def test_schedule_keeps_rows_without_host(spark):
    from pageloom.plans.fetch import fetch_schedule

    rows = [("h", 1), ("h", 2), (None, 3), (None, 4)]
    plan = fetch_schedule(spark.createDataFrame(rows, "host string, id int"), ["id"], 1.0, 0)
    assert sorted((r["id"], r["rank"]) for r in plan.collect()) == [(1, 1), (2, 2), (3, 1), (4, 2)]


def test_buckets_stay_legal_at_any_size(spark):
    most = int(spark.conf.get("spark.sql.sources.bucketing.maxBuckets"))
    assert buckets_for(100 * 10**12, 8, most) == most
    assert buckets_for(1 << 30, 2, most) == 4
    assert buckets_for(1, 8, most) == 8


def test_buckets_follow_files_not_checkpoints(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    ids = pages.select("page_id")
    reached = cut_lineage(ids.join(ids.withColumnRenamed("page_id", "other"), F.col("page_id") <= F.col("other")))
    joined = pages.join(reached, "page_id", "left_semi")
    assert 0 < estimated_bytes(joined) <= 2 * estimated_bytes(pages)
    assert bucket_count(joined) == spark.sparkContext.defaultParallelism


def _entries(spark, *rows):
    frame = spark.createDataFrame([(k, v, at(s)) for k, v, s in rows], "key string, value string, ts timestamp")
    return store.entries(frame, F.col("ts"), ttl_hours=1)


def test_store_of_runs(spark, tmp_path):
    path = str(tmp_path / "runs")
    runs = store.RunStore.create(spark, path, 4, "TIMESTAMP")

    def get(held, second, *keys):
        found = held.get(spark.createDataFrame([(k,) for k in keys], "key string"), F.lit(at(second)))
        return {r.key: r.value for r in found.collect()}

    assert get(runs, 0, "a") == {"a": None}
    runs.put(_entries(spark, ("a", "late", 20), ("b", "x", 0), ("a", "older", 5), (None, "lost", 0)))
    runs.put(_entries(spark, ("a", "early", 10), ("c", "y", 0)))
    again = store.RunStore.open(spark, path)
    assert again.buckets == 4 and again.rows().count() == 4  # of a run the newest entry of each key
    assert get(again, 30, "a", "b", "c", "d", "a") == {"a": "late", "b": "x", "c": "y", "d": None}
    again.delete(spark.createDataFrame([("b",)], "key string"), F.lit(at(40)))
    assert get(again, 50, "a", "b", "c") == {"a": "late", "b": None, "c": "y"}
    assert tuple(again.item_count(F.lit(at(50))).first()) == (2, 1)
    clean = again.compact(F.lit(at(3610)), str(tmp_path / "clean"))  # only "a" lives
    assert [r.key for r in clean.rows().collect()] == ["a"]


def test_stored_values_are_not_moved(spark, tmp_path):
    runs = store.RunStore.create(spark, str(tmp_path / "runs"), 4, "TIMESTAMP")
    for value in ("v1", "v2"):
        runs.put(_entries(spark, *((f"k{i}", value, i) for i in range(20))))
    plan = runs.newest()._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Bucketed: true" in plan
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        keys = spark.range(5).selectExpr("concat('k', id) AS key")
        plan = runs.get(keys, F.lit(at(5)))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    # Both are those of the keys asked for: made distinct, then dealt to the buckets.
    assert plan.count("Exchange") == 2 and "Exchange" not in plan[plan.index("AS _found") :]
