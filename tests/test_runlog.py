import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from shardloom import append_metrics, learning_rate, read_metrics, sync_metrics
from shardloom.functions.schedule import tokens_seen
from shardloom.operators import runlog
from shardloom.sources import metrics
from shardloom.sources.files import DriverFiles

RECORDS = "run_id string, step bigint, tokens bigint, train_loss double, val_loss double, learning_rate double, gradient_norm double"


def record(step, **more):
    return {"step": step, "tokens": step * 2048, "train_loss": 1.0, "val_loss": None, "learning_rate": 1e-4, "gradient_norm": 1.0, **more}


def write_log(folder, lines):
    folder.mkdir(parents=True)
    (folder / "metrics.jsonl").write_text("".join(f"{line}\n" for line in lines))


def log(spark, runs):
    """runs: run -> list of (step, train_loss, val_loss)."""
    rows = [(run, s, s, t, v, None, None) for run, steps in runs.items() for s, t, v in steps]
    return spark.createDataFrame(rows, RECORDS)


def test_read_all_runs_and_skip_blank_lines(spark, tmp_path):
    write_log(tmp_path / "runs" / "a", [json.dumps(record(1)), "", json.dumps(record(2, val_loss=2.5)), "   "])
    write_log(tmp_path / "runs" / "b", [json.dumps(record(1))])
    # A run's folder also holds its config, which is JSON of another shape.
    (tmp_path / "runs" / "b" / "config.json").write_text(json.dumps({"seed": 10, "batch_size": 4}, indent=2))
    (tmp_path / "runs" / "b" / "notes.txt").write_text("not a log")
    rows = sorted(read_metrics(spark, str(tmp_path / "runs")).collect())
    assert [(r.run_id, r.step, r.val_loss) for r in rows] == [("a", 1, None), ("a", 2, 2.5), ("b", 1, None)]


def test_torn_last_line_fails_the_read(spark, tmp_path):
    write_log(tmp_path / "runs" / "a", [json.dumps(record(1)), json.dumps(record(2))[:20]])
    with pytest.raises(Exception, match="Malformed|MALFORMED"):
        read_metrics(spark, str(tmp_path / "runs")).collect()


def test_append_and_sync(spark, tmp_path):
    path = str(tmp_path / "log")
    assert sync_metrics(spark, path, spark.createDataFrame([("a", 0)], "run_id string, saved_step bigint")) is None
    append_metrics(log(spark, {"run a+%/1": [(s, 1.0, None) for s in (1, 2, 3)], "b": [(1, 5.0, 2.0)]}), path)
    append_metrics(log(spark, {"run a+%/1": [(4, 1.0, 3.0)], "gone": [(1, 1.0, None)]}), path)
    assert read_metrics(spark, path).count() == 6
    assert '"val_loss":null' in "".join(p.read_text() for p in (tmp_path / "log").rglob("*.json"))
    saved = spark.createDataFrame([("run a+%/1", 2), ("gone", 0), ("absent", 7)], "run_id string, saved_step bigint")
    kept = sync_metrics(spark, path, saved)
    left = sorted((r.run_id, r.step) for r in read_metrics(spark, path).collect())
    assert left == [("b", 1), ("run a+%/1", 1), ("run a+%/1", 2)]
    assert read_metrics(spark, kept).count() == 3  # the old path now leads to the new version
    append_metrics(log(spark, {"b": [(2, 4.0, None)]}), path)
    again = sync_metrics(spark, path, spark.createDataFrame([("b", 1)], "run_id string, saved_step bigint"))
    assert sorted((r.run_id, r.step) for r in read_metrics(spark, path).collect()) == left
    assert again != path and read_metrics(spark, again).count() == 4


@pytest.mark.parametrize("stop", ["before writing", "while writing", "before the switch", "after the switch"])
def test_a_trim_may_stop_anywhere(spark, tmp_path, monkeypatch, stop):
    path, saved = str(tmp_path / "log"), spark.createDataFrame([("a", 2)], "run_id string, saved_step bigint")
    append_metrics(log(spark, {"a": [(s, 1.0, None) for s in range(1, 6)]}), path)
    append, publish = metrics.append_metrics, DriverFiles.publish

    def torn(records, target):
        if stop == "while writing":
            append(records.limit(1), target)
        raise KeyboardInterrupt

    def halted(self, name, text):
        if stop == "after the switch":
            publish(self, name, text)
        raise KeyboardInterrupt

    with monkeypatch.context() as patched:
        if stop.endswith("writing"):
            patched.setattr(metrics, "append_metrics", torn)
        else:
            patched.setattr(DriverFiles, "publish", halted)
        with pytest.raises(KeyboardInterrupt):
            sync_metrics(spark, path, saved)
    steps = sorted(r.step for r in read_metrics(spark, path).collect())
    assert steps == ([1, 2] if stop == "after the switch" else [1, 2, 3, 4, 5])
    sync_metrics(spark, path, saved)
    assert sorted(r.step for r in read_metrics(spark, path).collect()) == [1, 2]


@pytest.mark.parametrize("saved, left", [(0, 0), (5, 5), (99, 8)])
def test_trim(spark, saved, left):
    records = log(spark, {"a": [(s, 1.0, None) for s in range(1, 9)]})
    assert runlog.trim(records, spark.createDataFrame([("a", saved)], "run_id string, saved_step bigint")).count() == left


def random_runs():
    rng = np.random.default_rng(4)
    runs = {}
    for run, steps in (("hot", 400), ("b", 57), ("late", 30)):
        first = 41 if run == "late" else 1
        runs[run] = [
            (s, float(rng.integers(1, 100)) / 8, float(rng.integers(1, 9)) if rng.random() < 0.03 else None)
            for s in range(first, first + steps)
        ]
    return runs


@pytest.mark.parametrize("block", [1, 3, 1 << 12])
def test_latest_losses_and_interval_means(spark, monkeypatch, block):
    monkeypatch.setattr(runlog, "BLOCK_INTERVALS", block)
    runs = random_runs()
    metrics = log(spark, runs)
    means, expected = {}, {}
    for run, steps in runs.items():
        mean = val = None
        losses = {s: t for s, t, _ in steps}
        for s, _, v in steps:
            if s % 10 == 0 and all(i in losses for i in range(s - 9, s + 1)):
                mean = sum(losses[i] for i in range(s - 9, s + 1)) / 10
                means[run, s] = mean
            val = v if v is not None else val
            expected[run, s] = (mean, val)
    got = runlog.latest_losses(metrics, 10).collect()
    assert {(r.run_id, r.step): (r.latest_avg_loss, r.latest_val_loss) for r in got} == expected
    assert {(r.run_id, r.end_step): r.mean_loss for r in runlog.interval_loss(metrics, 10).collect()} == means
    with pytest.raises(ValueError, match="interval"):
        runlog.interval_loss(metrics, 0)


def test_bounds_and_validation_curve(spark):
    runs = random_runs()
    metrics = log(spark, runs)
    for r in runlog.run_bounds(metrics).collect():
        first, last = runs[r.run_id][0], runs[r.run_id][-1]
        assert (r.first_step, r.first_train_loss, r.first_val_loss) == first
        assert (r.last_step, r.last_train_loss, r.last_val_loss) == last
    curve = {(r.run_id, r.step, r.val_loss) for r in runlog.validation_curve(metrics).collect()}
    assert curve == {(run, s, v) for run, steps in runs.items() for s, _, v in steps if v is not None}


def test_means_over_batches(spark):
    rows = spark.createDataFrame([("a", i, float(i)) for i in range(10)], "run_id string, ordinal bigint, loss double")
    assert runlog.eval_mean(rows, 5).first().mean_loss == 2.0
    means = {r.update_step: r.mean_loss for r in runlog.update_loss_mean(rows, 4).collect()}
    assert means == {1: 1.5, 2: 5.5}


def test_schedule(spark):
    low, high, warmup, total = 2e-5, 4e-4, 60, 560
    rate = learning_rate(F.col("id"), max_lr=high, min_lr=low, warmup_steps=warmup, total_steps=total)
    rates = [r.rate for r in spark.range(0, 700).select("id", rate.alias("rate")).orderBy("id").collect()]
    assert rates[0] == 0 and rates[warmup] == pytest.approx(high) and all(r == low for r in rates[total:])
    assert np.allclose(np.diff(rates[: warmup + 1]), high / warmup)  # linear warmup
    fall = np.array(rates[warmup : total + 1])
    assert (np.diff(fall) < 0).all() and fall[len(fall) // 2] == pytest.approx((low + high) / 2)
    assert np.allclose(fall + fall[::-1], low + high)  # the cosine is odd about its middle
    assert max(abs(np.diff(rates))) < high / warmup * 1.01  # no jump anywhere
    # Rates a real run logged at some of its last steps.
    logged = {1111: 3.0051863328339198e-05, 1115: 3.0016007908759617e-05, 1119: 3.000064032849907e-05, 1120: 3e-05}
    rows = spark.range(1111, 1121).select("id", learning_rate(F.col("id")).alias("rate")).collect()
    assert all(r.rate == pytest.approx(logged[r.id], rel=1e-14) for r in rows if r.id in logged)
    assert spark.range(3, 4).select(tokens_seen(F.col("id"), 4, 4, 128)).first()[0] == 6144


def test_every_record_is_aligned_with_its_plan(spark):
    rows = [("a", s, s * 64, 1.0, None, rate, None) for s, rate in ((1, 1e-3), (2, None), (5000, 3e-5))]
    found = {r.step: r for r in runlog.align_schedule(spark.createDataFrame(rows, RECORDS), 2, 4, 8).collect()}
    assert {s: r.token_drift for s, r in found.items()} == {1: 0, 2: 0, 5000: 0}
    assert found[1].rate_drift == pytest.approx(1e-3 - 3e-6) and found[2].rate_drift is None and found[5000].rate_drift == 0


@pytest.mark.parametrize("options", [{"min_lr": 0}, {"min_lr": 1.0}, {"warmup_steps": 0}, {"warmup_steps": 1120}])
def test_schedule_rules(options):
    with pytest.raises(ValueError):
        learning_rate(F.lit(1), **options)


def test_records_are_aligned_with_the_updates_planned(spark):
    """A plan of other updates than the schedule's formula: records follow it, and those beyond it stay."""
    rows = [("a", s, s * 64, 1.0, None, 1e-4, None) for s in (1, 2, 3)]
    plan = spark.createDataFrame([(1, 60, 2, 2e-4), (2, 124, 1, 1e-4)], "update_step bigint, tokens bigint, micro_steps bigint, learning_rate double")
    found = {r.step: r for r in runlog.align_schedule(spark.createDataFrame(rows, RECORDS), 2, 4, 8, plan).collect()}
    assert {s: (r.token_drift, r.micro_steps) for s, r in found.items()} == {1: (4, 2), 2: (4, 1), 3: (0, None)}
    assert found[1].rate_drift == pytest.approx(-1e-4) and found[2].rate_drift == 0 and found[3].planned_rate == pytest.approx(9e-6)


def test_files_of_a_log_do_not_grow_with_its_runs(spark, tmp_path):
    path, old = str(tmp_path / "log"), tmp_path / "log" / "run_id=old%2F1"
    names = [f"run {i}" for i in range(300)]
    append_metrics(log(spark, {name: [(s, 1.0, None) for s in (1, 2)] for name in names}), path)
    old.mkdir()  # as written before records named their run
    (old / "part-0.json").write_text(json.dumps(record(1)) + "\n")
    sync_metrics(spark, path, spark.createDataFrame([(name, 1) for name in names], "run_id string, saved_step bigint"))
    assert sorted(r.run_id for r in read_metrics(spark, path).collect()) == sorted([*names, "old/1"])
    assert len(list((tmp_path / "log").rglob("*.json"))) < 100
