"""Model training / scoring / store / retrain, and the hourly streaming jobs."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from sparkmend.plans.features import feature_table
from sparkmend.plans.master import master_from_standins
from sparkmend.plans import model as M
from sparkmend.session import scratch_path
from sparkmend.sources import standins as S
from sparkmend.streaming import hourly as H


@pytest.fixture(scope="module")
def trained(spark):
    feats = feature_table(master_from_standins(spark, SF_SMALL))
    result, scored = M.train(feats, max_iter=5)
    return feats, result, scored


def test_time_split_has_no_overlap(spark, trained):
    feats, result, _ = trained
    tr, te = M.time_split(M.prepare(feats), result.cutoff)
    assert tr.agg(F.max("datetime")).first()[0] < result.cutoff - dt.timedelta(hours=23)
    assert te.agg(F.min("datetime")).first()[0] >= result.cutoff
    assert "label_24h" not in result.feature_columns and "machineID" not in result.feature_columns


def test_train_evaluate_save_load_score(spark, trained, tmp_path):
    feats, result, scored = trained
    assert set(result.metrics) == {"areaUnderROC", "areaUnderPR", "test_rows"}
    path = str(tmp_path / "model")
    M.save_model(result.model, path)
    preds = M.score(M.load_model(path), feats)
    assert preds.columns == ["machineID", "datetime", "failure_probability", "predicted_failure"]
    assert preds.count() == feats.count()
    p = preds.agg(F.min("failure_probability"), F.max("failure_probability")).first()
    assert 0.0 <= p[0] <= p[1] <= 1.0


def test_latest_health_one_row_per_machine(spark, trained):
    feats, result, _ = trained
    latest = M.latest_health(result.model, result.features)
    n_machines = feats.select("machineID").distinct().count()
    assert latest.count() == n_machines
    newest = feats.groupBy("machineID").agg(F.max("datetime").alias("m"))
    assert latest.join(newest, "machineID").where(F.col("datetime") != F.col("m")).count() == 0


def test_prediction_store_is_idempotent_per_day(spark, trained, tmp_path):
    feats, result, _ = trained
    preds = M.score(result.model, feats)
    store = str(tmp_path / "store")
    M.store_predictions(preds, store)
    n = spark.read.parquet(store).count()
    day = preds.where(F.to_date("datetime") == F.lit("2024-01-05").cast("date"))
    M.store_predictions(day, store)  # re-scoring one day replaces only that day
    assert spark.read.parquet(store).count() == n


def test_weekly_retrain_saves_by_date(spark, tmp_path):
    master = master_from_standins(spark, SF_SMALL)
    res = M.retrain(master, dt.datetime(2024, 1, 22), train_days=14, model_root=str(tmp_path / "m"),
                    max_iter=3)
    assert os.path.isdir(tmp_path / "m" / "as_of=2024-01-22")
    assert res.metrics["held_out_test_rows"] > 0  # rows that the evaluated model has not seen


def test_hourly_stream_emits_closed_hours(spark):
    out, ck = scratch_path(spark, "t-hourly"), scratch_path(spark, "t-hourly-ck")
    q = H.run_hourly_telemetry(spark, SF_SMALL, out, ck, file_glob="events.parquet")
    q.awaitTermination()
    got = spark.read.parquet(out)
    batch = S.telemetry(spark, SF_SMALL)
    max_ts = S.table(spark, SF_SMALL, "events").agg(F.max("ts")).first()[0]
    closed = batch.where(F.col("datetime") + F.expr("INTERVAL 2 HOURS") <= F.lit(max_ts))
    assert sorted(got.collect()) == sorted(closed.collect())
    assert got.count() < batch.count()  # the open hours are still waiting for the watermark


def test_hourly_scoring_stream_writes_predictions(spark, trained):
    _, result, _ = trained
    model_path = scratch_path(spark, "t-model")
    M.save_model(result.model, model_path)
    store, hist, ck = (scratch_path(spark, "t-store"), scratch_path(spark, "t-hist"),
                       scratch_path(spark, "t-score-ck"))
    q = H.run_hourly_scoring(spark, SF_SMALL, hist, model_path, store, ck, S.machines(spark, SF_SMALL),
                             file_glob="events.parquet")
    q.awaitTermination()
    preds = spark.read.parquet(store)
    closed = spark.read.parquet(hist).count()
    assert preds.count() == closed > 0
    assert preds.select("machineID", "datetime").distinct().count() == closed


def test_watermark_late_data_and_restart(spark, tmp_path):
    src, out, ck = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "ck")

    def events(rows, name):
        df = spark.createDataFrame(
            [(i, dt.datetime(2024, 1, 1, h, m), 1, "view", v, "{}") for i, (h, m, v) in enumerate(rows)],
            H.EVENT_SCHEMA)
        df.coalesce(1).write.mode("overwrite").parquet(f"{src}/{name}")

    def run():
        q = H.run_hourly_telemetry(spark, f"{src}/*", out, ck, delay="1 hour")
        q.awaitTermination()
        return {(r.datetime.hour, r.pressure) for r in spark.read.parquet(out).collect()}

    events([(0, 10, 1.0), (1, 10, 2.0), (2, 10, 3.0), (3, 10, 4.0)], "a")
    # watermark = 03:10 - 1 h = 02:10: the hours ending by then are final
    assert run() == {(0, 1.0), (1, 1.0)}
    # 01:30 is behind the watermark (its hour was emitted): dropped, nothing rewritten;
    # 02:40 is late but within the delay: counted in the still-open hour 2;
    # 06:00 moves the watermark to 05:00
    events([(1, 30, 9.0), (2, 40, 5.0), (6, 0, 6.0)], "b")
    assert run() == {(0, 1.0), (1, 1.0), (2, 2.0), (3, 1.0)}


def test_streamed_scores_equal_batch_scores(spark, trained, tmp_path):
    """Events arriving day by day (one micro-batch per file) score exactly like a batch run."""
    _, result, _ = trained
    model_path = str(tmp_path / "model")
    M.save_model(result.model, model_path)
    ev = S.table(spark, SF_SMALL, "events")
    src = tmp_path / "incoming"
    days = sorted({r.d for r in ev.select(F.to_date("ts").alias("d")).distinct().collect()})[:8]
    for d in days:  # a few days, one file each, written in time order
        ev.where(F.to_date("ts") == F.lit(d)).coalesce(1).write.parquet(str(src / f"day={d}"))
    store, hist, ck = str(tmp_path / "store"), str(tmp_path / "hist"), str(tmp_path / "ck")
    machines = S.machines(spark, SF_SMALL)
    q = H.run_hourly_scoring(spark, str(src / "*"), hist, model_path, store, ck, machines,
                             max_files_per_trigger=1)
    q.awaitTermination()
    streamed = spark.read.parquet(store).select("machineID", "datetime", "failure_probability")
    assert spark.read.parquet(store).select("batch").distinct().count() > 3  # several batches
    # batch run over the same events: master over all of them, features over all history
    events = spark.read.parquet(*[str(src / f"day={d}") for d in days])
    master = H.hourly_master(events, machines, delay="1 hour")
    batch = M.score(result.model, feature_table(master)).select("machineID", "datetime",
                                                                "failure_probability")
    closed = streamed.select("machineID", "datetime")
    expected = batch.join(closed, ["machineID", "datetime"], "left_semi")
    assert streamed.count() == expected.count() > 0
    diff = streamed.exceptAll(expected).count() + expected.exceptAll(streamed).count()
    assert diff == 0


def test_training_tasks_follow_the_feature_values(spark, monkeypatch):
    """Rows that lie in one file part are dealt to tasks by their number of feature values, none with much more than its share."""
    from pyspark.sql import functions as F

    from sparkmend.plans import model as M

    seen = []

    class Estimator:
        def fit(self, rows):
            seen.extend(r.n for r in rows.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect())

    monkeypatch.setattr(M, "VALUES_PER_TASK", 2_000, raising=False)
    monkeypatch.setattr(M, "estimator_for", lambda *a, **k: Estimator())
    monkeypatch.setattr(M, "evaluate", lambda scored: {})
    rows = spark.range(4_000).coalesce(1).select(
        F.lit(7).cast("long").alias("machineID"), (F.lit("2024-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.col("id").cast("int"))).alias("datetime"),
        F.lit("m").alias("model"), F.rand(1).alias("volt"), (F.col("id") % 5 == 0).cast("double").alias(M.LABEL))
    data = rows.where("volt is not null")
    import pytest
    with pytest.raises(AttributeError):  # the stand-in gives no model
        M.train(data)
    assert sum(seen) > 3_000 and max(seen) <= 1_500 and len(seen) >= 3


def test_store_computes_the_predictions_once(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    def look(parts):
        for p in parts:
            seen.add(len(p))
            yield p

    rows = spark.range(1000).withColumnRenamed("id", "machineID").mapInPandas(look, "machineID long").select(
        "machineID", F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, machineID % 48)").alias("datetime"),
        F.lit(0.5).alias("failure_probability"), F.lit(0.0).alias("predicted_failure"))
    M.store_predictions(rows, str(tmp_path / "store"))
    assert seen.value == 1000
    assert M.read_predictions(spark, str(tmp_path / "store")).count() == 1000


def test_event_quarters_hold_every_event_once(spark):
    events = S.table(spark, SF_SMALL, "events")
    at, n = F.unix_micros(F.col("ts").cast("timestamp")), events.count()
    spans = H.event_quarters(events)
    assert len(spans) == 4
    held = [events.where((F.lit(True) if a is None else at >= a) & (F.lit(True) if b is None else at < b)).count() for a, b in spans]
    assert sum(held) == n and all(abs(h - n / 4) <= 2 for h in held)


def _odd_rows(spark):
    rows = [(i % 9 if i % 13 else None, dt.datetime(2024, 1, 1) + dt.timedelta(hours=i % 600), ["a", "b", None, "zz"][i % 4], float(i % 50 > 20 and i % 4 == 1),
             None if i % 17 == 0 else float("nan") if i % 19 == 0 else float(i % 50), i % 23) for i in range(900)]
    return spark.createDataFrame(rows, "machineID long, datetime timestamp_ntz, model string, label_24h double, volt double, age long")


def test_scores_equal_the_transform_without_row_functions(spark):
    """NULL, NaN, unseen and NULL machine models, NULL keys: the trees walked in batches give what ``transform`` gives."""
    from pyspark.ml.functions import vector_to_array
    df = _odd_rows(spark)
    seen = M.prepare(df.where("model != 'zz' or model is null"))
    model = M.fitted(seen, ["volt", "age"], max_iter=6)
    new = M.score(model, df)
    plan = new._jdf.queryExecution().executedPlan().toString()
    assert "UDF(" not in plan  # four functions of single rows before
    old = model.transform(M.prepare(df)).select(*M.KEYS, vector_to_array("probability")[1].alias("p"), "prediction")
    a, b = ([tuple(r) for r in d.orderBy(F.col("machineID").asc_nulls_first(), "datetime", d.columns[2]).collect()] for d in (new, old))
    assert len(a) == len(b) == 900 and len({r[2] for r in a}) > 3
    for x, y in zip(a, b):
        assert x[:2] == y[:2] and abs(x[2] - y[2]) < 1e-12 and x[3] == y[3]
    assert M.evaluate(M.with_score(model, seen, [M.LABEL])) == pytest.approx(M.evaluate(model.transform(seen)))


def test_training_computes_its_rows_five_times(spark):
    """Number of machine models, their index, class weights, number of rows, one shuffle: ``fit`` shuffled the rows twice."""
    looked = spark.sparkContext.accumulator(0)

    def look(parts):
        for p in parts:
            looked.add(len(p))
            yield p

    df = M.prepare(_odd_rows(spark))
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    M.fitted(df.mapInPandas(look, df.schema), ["volt", "age"], max_iter=2)
    assert looked.value <= 5 * 900
    assert spark.conf.get("spark.sql.adaptive.enabled") == adaptive


def test_features_since_equal_the_whole_table(spark):
    """NULL machines, rows of one key twice, a machine without late rows, a first hour inside a bucket."""
    from sparkmend.contracts import MASTER_COLUMNS
    from sparkmend.plans.states import features_since
    rows = []
    for i in range(1500):
        m = None if i % 11 == 0 else i % 7
        t = dt.datetime(2024, 1, 1) + dt.timedelta(hours=(i * 37) % 700 if m != 3 else (i * 37) % 300)
        event = [float(i % k == 0) for k in range(3, 17)]
        rows.append((t, m, float(i % 31), float(i % 13), 1.0 + i % 3, float(i % 5), f"m{i % 3}", i % 40, *event))
    rows += rows[:40]
    types = ["timestamp_ntz", "long", *["double"] * 4, "string", "long", *["double"] * 14]
    master = spark.createDataFrame(rows, ", ".join(f"{c} {t}" for c, t in zip(MASTER_COLUMNS, types)))
    first = dt.datetime(2024, 1, 24, 5)
    whole = feature_table(master).where(F.col("datetime") >= F.lit(first.isoformat()).cast("timestamp_ntz"))
    part = features_since(master, first)
    assert whole.columns == part.columns
    # of rows with one key the running features depend on their order: the largest of each column stands for them
    agg = [F.max(F.coalesce(F.round(F.col(c).cast("double"), 9), F.lit(-1e9))).alias(c) for c in whole.columns if c not in ("machineID", "datetime", "model")]
    a, b = (sorted(map(str, d.groupBy("machineID", "datetime").agg(F.count("*"), *agg).collect())) for d in (whole, part))
    assert len(a) > 100 and a == b
