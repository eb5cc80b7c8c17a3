import numpy as np
import pytest
from pyspark.sql import functions as F

from sensorloom.functions import text as tx
from sensorloom.operators import candidates as cd
from sensorloom.operators import clean, metrics, reduce, split, windows
from sensorloom.plans import config
from sensorloom.sources import sensor


def rec(spark, ts, v=None):
    rows = [(1, 1, "walking", float(t), i, "f", None if v is None else v[i]) for i, t in enumerate(ts)]
    return spark.createDataFrame(rows, "subject_id int, activity_id int, activity_name string, timestamp double, event_id int, source_file string, x double")


def test_interpolate(spark):
    out = clean.interpolate(rec(spark, range(8), [None, 1.0, None, None, 4.0, None, None, None]), ["x"], ["timestamp"]).orderBy("event_id")
    assert [r.x for r in out.collect()] == [1, 1, 2, 3, 4, 4, 4, 4]


def test_gap_runs(spark):
    out = clean.assign_runs(rec(spark, [0.00, 0.01, 0.02, 0.10, 0.11, 0.11, 0.12]), ["timestamp", "event_id"]).orderBy("event_id")
    assert [r.run_id for r in out.collect()] == [1, 1, 1, 2, 2, 3, 3]
    assert clean.assign_runs(rec(spark, [5.0]), ["timestamp"]).first().run_id == 1


def test_windows(spark):
    runs = rec(spark, range(10), [float(i) for i in range(10)]).withColumn("run_id", F.lit(1))
    out = windows.sliding_windows(runs, ["x"], 4, 2, ["timestamp"]).orderBy("window_id").collect()
    assert [r.start_index for r in out] == [0, 2, 4, 6] and [r.window_id for r in out] == [0, 1, 2, 3] and out[1].w == [[2, 3, 4, 5]]
    assert windows.sliding_windows(runs.limit(3), ["x"], 4, 2, ["timestamp"]).count() == 0


def test_row_validity(spark):
    cols = [f"c{i}" for i in range(18)]
    rows = [tuple(1.0 if i < n else float("nan") for i in range(18)) for n in (14, 15)]
    assert clean.valid_rows(spark.createDataFrame(rows, ", ".join(f"{c} double" for c in cols)), cols, 0.8).count() == 1


def test_subject_split(spark):
    out = split.subject_split(spark.createDataFrame([(i,) for i in (1, 2, 3, 4)], "subject_id int")).orderBy("subject_id")
    assert [r.split for r in out.collect()] == ["train", "train", "val", "test"]
    with pytest.raises(ValueError):
        split.split_windows(out, "session")


def test_candidate_reasons(spark):
    c = spark.createDataFrame([(0, "3"), (1, "3"), (2, None), (3, "bad"), (4, "11"), (5, "-4"), (6, "10")], "candidate_id int, value_0 string")
    ref = spark.createDataFrame([(float(i),) for i in range(1, 6)], "value_0 double")
    out = cd.filter_candidates(c, ref, ["value_0"]).orderBy("candidate_id")
    assert [r.filter_reason for r in out.collect()] == ["kept", "duplicate", "missing_fields", "missing_fields", "norm_filter", "kept", "kept"]
    empty = cd.filter_candidates(c, ref.limit(0), ["value_0"])
    assert empty.where("filter_reason = 'norm_filter'").count() == 0


def test_top_fraction(spark):
    for n, f, kept in ((106, 0.7, 75), (188, 0.35, 66), (1, 0.25, 1)):
        rows = spark.range(n).select(F.col("id").alias("candidate_id"), F.lit("A").alias("activity_name"), F.rand(1).alias("stats_score"), F.lit(0.0).alias("max_channel_stats_score"))
        assert cd.top_fraction(rows, f).count() == kept


def test_stats_score(spark):
    row = lambda i, m, s, a, b: (i, i, "w", m, s, a, b)
    schema = "candidate_id int, window_id int, activity_name string, stat_c_mean double, stat_c_std double, stat_c_min double, stat_c_max double"
    out = cd.stats_scores(spark.createDataFrame([row(1, 0.5, 1.5, -1.0, 2.0)], schema), spark.createDataFrame([row(1, 0.0, 1.0, -1.0, 1.0)], schema), ["c"]).first()
    assert out.stats_score == pytest.approx(0.5)


def test_text(spark):
    one = lambda t: spark.createDataFrame([(t,)], "t string")
    assert one("Target: 1 [sep] Target: 2").select(tx.target_tail(F.col("t"))).first()[0] == " 2"
    got = tx.parse(one("value_1 = -1.5; value_0 is 2e-3"), "t", ["value_0", "value_1"]).first()
    assert (got.value_0, got.value_1, got.parse_mode) == (0.002, -1.5, "named")
    got = tx.parse(one("Target: 0.1 [answer] value_7 -2 [answer]"), "t", ["value_0", "value_1", "value_2"]).first()
    assert (got.value_0, got.value_1, got.missing_columns) == (0.1, -2.0, ["value_2"])
    assert tx.parse(one("Target: 1 -"), "t", ["value_0"]).first().tail_truncation_hint
    assert spark.range(1).select(tx.format_number(F.lit(0.125), 2, exact=True)).first()[0] == "0.12"


def test_dtw_and_shapelets():
    assert metrics.dtw(np.array([0, 1, 2]), np.array([0, 2])) == 1
    rng = np.random.default_rng(0)
    a, b = rng.normal(size=(9, 2)), rng.normal(size=(7, 2))
    table = np.full((10, 8), np.inf)
    table[0, 0] = 0
    for i in range(1, 10):
        for j in range(1, 8):
            if abs(i - j) <= 3:
                table[i, j] = np.linalg.norm(a[i - 1] - b[j - 1]) + min(table[i - 1, j], table[i, j - 1], table[i - 1, j - 1])
    assert metrics.dtw(a, b, 3) == pytest.approx(table[9, 7]) and metrics.dtw(a, a) == 0
    base = np.sin(np.linspace(0, 6, 16))
    real = np.stack([base * s for s in (1, 2, 3, 4)])[:, :, None]
    assert metrics.shapelet_error(real, real, count=4, rounds=30) < 0.2 * (real**2).sum() / 2 / 4


def test_reducer_round_trip(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [rng.normal(size=6).tolist(), rng.normal(size=6).tolist()]) for i in range(40)]
    w = spark.createDataFrame(rows, "window_id long, w array<array<double>>")
    for method in ("pca", "fastica"):
        model = reduce.fit(w, ["a", "b"], method, 6, "per_channel_train")
        back = {r.window_id: r.w for r in reduce.inverse(reduce.transform(w, model), model).collect()}
        assert all(np.allclose(back[i], x, atol=1e-6) for i, x in rows)
    with pytest.raises(ValueError):
        reduce.fit(w, ["a", "b"], "pca", 2, "other")


def test_skewness_convention(spark):
    x = np.array([1.0, 2.0, 2.5, 9.0])
    w = lambda v, g: spark.createDataFrame([(i, "a", [[float(y)]]) for i, y in enumerate(v)], "window_id long, activity_name string, w array<array<double>>")
    got = metrics.skewness_difference(w(x, 0), w(-x, 1)).first().SD
    assert got == pytest.approx(2 * ((x - x.mean()) ** 3).mean() / x.std(ddof=1) ** 3)


def test_scan_and_config(spark, tmp_path):
    line = "  ".join(["1.5", "4", "NaN", *(str(i) for i in range(51))])
    (tmp_path / "subject101.dat").write_text(line + "\n\n")
    (tmp_path / "subject102.dat").write_text(line + "\n")
    out = sensor.read_recordings(spark, str(tmp_path), [101]).collect()
    assert len(out) == 1 and out[0].subject_id == 101 and out[0].heart_rate is None and out[0].activity_id == 4 and out[0].hand_acc_16g_x == 1.0
    (tmp_path / "m.txt").write_text("a\n\n b \n")
    assert sensor.manifest_entry(spark, str(tmp_path / "m.txt"), 1) == "b"
    with pytest.raises(IndexError):
        sensor.manifest_entry(spark, str(tmp_path / "m.txt"), 2)
    (tmp_path / "c.yaml").write_text("data:\n  preprocessed_dir: x\n  output_dir: y\n  train_subjects:\n    - 1\n    - 2\nembedding:\n  n_components: 5\n")
    c = config.load_config(str(tmp_path / "c.yaml"))
    assert c.data.train_subjects == [1, 2] and c.embedding.n_components == 5
    with pytest.raises(TypeError):
        config.from_dict({"data": {"preprocessed_dir": "x", "output_dir": "y", "no": 1}})


def test_channel_choice():
    names = ["hand_x", "chest_x", "hand_y"]
    assert clean.resolve_channels(names, None, ["hand"]) == ["hand_x", "hand_y"] and clean.resolve_channels(names) == names
    with pytest.raises(ValueError):
        clean.resolve_channels(names, ["none"])
    assert clean.resolve_activities(["Walking", "5", "vacuum cleaning"]) == [4, 5, 16]


def test_stream_runs(spark, tmp_path):
    from sensorloom.streaming import runs

    schema = "event_id long, ts timestamp, user_id long, event_type string, value double"
    rows = spark.range(20).selectExpr("id as event_id", "timestamp_seconds(1700000000 + id * if(id < 10, 1, 100)) as ts", "1L as user_id", "'a' as event_type", "cast(id as double) as value")
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = runs.read_events(spark, str(tmp_path / "in"), spark.createDataFrame([], schema).schema)
    q = runs.stream_windows(stream, 4, 2, 10.0).writeStream.format("memory").queryName("w").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert [r["mean"] for r in spark.sql("select mean from w order by start_ts").collect()] == [1.5, 3.5, 5.5, 7.5]


def test_run_file_keys(tmp_path):
    """Every section and key of a run file loads; unknown keys raise, or are kept apart when asked."""
    lines = []
    for name, keys in config.KEYS.items():
        lines.append(f"{name}:")
        for key, default in keys.items():
            value = "x" if default is config.REQUIRED else default
            if key == "peft":
                lines += ["  peft:", "    enabled: true", "    target_modules:", "      - q_proj", "      - v_proj"]
            elif isinstance(value, list):
                lines += [f"  {key}:", *(f"    - {v}" for v in value)]
            else:
                lines.append(f"  {key}: {'null' if value is None else str(value).lower() if isinstance(value, bool) else value}")
    (tmp_path / "run.yaml").write_text("\n".join([*lines, "smoke:", "  train_samples: 4"]) + "\n")
    c = config.load_config(str(tmp_path / "run.yaml"))
    assert c.embedding.window_stats == ["mean", "std", "min", "max"] and c.training.learning_rate == 8e-5 and c.training.peft["target_modules"] == ["q_proj", "v_proj"]
    config.save_config(c, str(tmp_path / "out" / "run.json"))
    assert config.load_config(str(tmp_path / "out" / "run.json")) == c
    older = config.from_dict({"data": {"preprocessed_dir": "x", "output_dir": "y", "older": 1}}, strict=False)
    assert older.unread == {"data.older": 1}


def test_reducers_below_full_rank(spark):
    """Components equal those of numpy's decomposition of all windows, kept below the width."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(60, 6)) @ np.diag([5, 3, 2, 1, 0.5, 0.1]) @ np.linalg.qr(rng.normal(size=(6, 6)))[0] + 3
    w = spark.createDataFrame([(i, [v[:3].tolist(), v[3:].tolist()]) for i, v in enumerate(x)], "window_id long, w array<array<double>>").repartition(5)
    got = {r.window_id: r["values"] for r in reduce.compact_pca(w, 2).collect()}
    u, s, vt = np.linalg.svd(x - x.mean(axis=0), full_matrices=False)
    vt = vt[:2] * np.sign(vt[np.arange(2), np.abs(vt[:2]).argmax(axis=1)])[:, None]
    assert np.allclose([got[i] for i in range(60)], (x - x.mean(axis=0)) @ vt.T)
    model = reduce.fit(w, ["a", "b"], "pca", 2, "per_channel_train").orderBy("channel_index").collect()
    y = (x[:, :3] - x[:, :3].mean()) / x[:, :3].std()
    y = (y - y.mean(axis=0)) / y.std(axis=0)
    s = np.linalg.svd(y, compute_uv=False) ** 2
    assert np.allclose(model[0].explained_variance_ratio, s[:2] / s.sum()) and len(model[0].components) == 2
    mixed = rng.laplace(size=(400, 2)) @ rng.normal(size=(2, 6))
    w = spark.createDataFrame([(i, [v.tolist()]) for i, v in enumerate(mixed)], "window_id long, w array<array<double>>")
    z = np.array([r["values"] for r in reduce.compact(w, 2, "fastica").orderBy("window_id").collect()])
    assert np.allclose(np.cov(z.T, bias=True), np.eye(2), atol=1e-3) and reduce.compact(w.limit(0)).count() == 0 and reduce.compact_pca(w.limit(0)).count() == 0


def test_spearman_ties(spark):
    from sensorloom.operators import classify

    rng = np.random.default_rng(3)
    x, y = rng.integers(0, 40, 500), rng.normal(size=500).round(1)
    rank = lambda v: np.array([(v < e).sum() + ((v == e).sum() + 1) / 2 for e in v])
    df = spark.createDataFrame(list(zip(x.tolist(), y.tolist(), strict=True)), "x long, y double")
    assert classify.spearman(df, "x", "y", buckets=7).first().spearman == pytest.approx(np.corrcoef(rank(x), rank(y))[0, 1])


def test_shapelets_find_planted_shapes():
    rng = np.random.default_rng(8)
    shape = np.array([0, 3.0, -2.0, 1.0])
    made = lambda n: np.stack([np.concatenate([np.zeros(k), g * shape, np.zeros(12 - k)]) for k, g in zip(rng.integers(0, 13, n), rng.uniform(1, 2, n), strict=True)])[:, :, None]
    real, near, noise = made(30), made(20), rng.normal(0, 2, (20, 16, 1))
    assert metrics.shapelet_error(real, near, count=4, rounds=100) < 0.1 * metrics.shapelet_error(real, noise, count=4, rounds=100)
    assert np.isnan(metrics.shapelet_error(real, near[:0])) and metrics.shapelet_error(real, near, count=2, rounds=5, mode="per_channel") >= 0


def test_command_line(spark, tmp_path):
    """Recordings to windows, windows to a split dataset, scores to selections, through the sinks and scans."""
    from sensorloom import __main__ as cli

    rng = np.random.default_rng(0)
    channels = ["hand_acc_16g_x", "hand_acc_16g_y"]
    for subject in (101, 102, 103):
        lines = []
        for i in range(60):
            lines.append("  ".join([f"{i / 100:.2f}", "4" if i < 40 else "0", "NaN", *(f"{v:.4f}" for v in rng.normal(size=51))]))
        (tmp_path / "in").mkdir(exist_ok=True)
        (tmp_path / "in" / f"subject{subject}.dat").write_text("\n".join(lines) + "\n")
    out = str(tmp_path / "pre")
    cli.main(["preprocess", "--input-dir", str(tmp_path / "in"), "--output-dir", out, "--channels", *channels, "--activities", "walking", "--window-size", "8", "--stride", "4", "--compact-components", "2"])
    windows, features, summary = sensor.load_preprocessed(spark, out)
    assert windows.count() == 3 * 9 == summary.first().num_windows == features.count() and spark.read.parquet(f"{out}/compact_embeddings").count() == 27
    assert [tuple(r) for r in spark.read.json(f"{out}/label_map").collect()] == [(4, "walking")]
    (tmp_path / "run.yaml").write_text(f"data:\n  preprocessed_dir: {out}\n  output_dir: {tmp_path}/set\nembedding:\n  method: pca\n  n_components: 2\n  permute_columns: false\n")
    cli.main(["dataset", "--config", str(tmp_path / "run.yaml"), "--channels", *channels])
    texts = sensor.read_json_lines(spark, f"{tmp_path}/set/text")
    assert {r.split for r in texts.select("split").distinct().collect()} == {"train", "val", "test"} and texts.where("text like 'Condition: %Target: %'").count() == 27
    assert sensor.load_model(spark, f"{tmp_path}/set/reducer").count() == 2 and spark.read.json(f"{tmp_path}/set/split_manifest").count() == 3
    spark.range(10).selectExpr("id as candidate_id", "'A' as activity_name", "id / 10D as stats_score", "0D as max_channel_stats_score").write.parquet(str(tmp_path / "scores"))
    cli.main(["filter", "--scores", str(tmp_path / "scores"), "--output-dir", str(tmp_path / "kept"), "--filters", "half:0.5"])
    assert [r.candidate_id for r in spark.read.parquet(str(tmp_path / "kept")).orderBy("candidate_id").collect()] == [0, 1, 2, 3, 4]


def test_sinks_and_reports(spark, tmp_path):
    from sensorloom.plans import reports
    from sensorloom.sources import sinks

    df = spark.createDataFrame([("a", 1.5, None), ("b", 0.5, float("nan"))], "run_name string, ED double, DTW double")
    text = sinks.markdown_report(df, "run_name", {"ED": "min"}, 2)
    assert text.startswith("- Best ED: b (0.50)\n") and "| a | 1.50 |  |" in text and "| b | 0.50 |  |" in text
    for n in (1, 2):
        sinks.write_metrics(df.limit(n), str(tmp_path / "m"), str(tmp_path / "backup"))
    sinks.write_metrics(df, str(tmp_path / "m"), str(tmp_path / "backup"))
    assert spark.read.parquet(str(tmp_path / "m")).count() == 2 and spark.read.parquet(str(tmp_path / "backup")).count() == 1
    sinks.save_table(df, str(tmp_path / "csv"))
    assert sensor.read_csv(spark, str(tmp_path / "csv"), df.schema).where("run_name = 'a'").first().ED == 1.5
    sinks.write_json(df.limit(1), str(tmp_path / "json"))
    assert sensor.read_json(spark, str(tmp_path / "json")).first().run_name == "a"
    missing = reports.or_missing(df, spark.createDataFrame([("a",), ("c",)], "run_name string"), "run_name", ["ED"]).orderBy("run_name").collect()
    assert missing[0].ED == 1.5 and np.isnan(missing[1].ED)
    named = spark.createDataFrame([(None, "x", "y"), ("n", "x", "y")], "n string, a string, b string").select(reports.run_name("n", "a", "b")).collect()
    assert [r[0] for r in named] == ["x_y", "n"]
    assert cd.parse_triples(["a:b:c"]) == [("a", "b", "c")]
    with pytest.raises(ValueError):
        cd.parse_triples(["a:b"])
    w = spark.createDataFrame([(0, "a", [[1.0, 2.0]]), (1, "a", [[3.0, 6.0]])], "window_id long, activity_name string, w array<array<double>>")
    assert metrics.prototypes(w).first().w == [[2.0, 4.0]]
    got = reports.real_reference(w).first()
    assert got.ED_ref == pytest.approx(np.sqrt(4 + 16)) and got.DTW_ref > 0


def test_training_log(spark, tmp_path):
    (tmp_path / "state.json").write_text('{"log_history": [{"step": 1, "loss": 0.5}, {"step": 2, "eval_loss": 0.7}]}')
    log = sensor.read_training_log(spark, str(tmp_path / "none.csv"), str(tmp_path / "state.json"))
    train, held = sensor.split_log(log)
    assert [r.loss for r in train.collect()] == [0.5] and [r.eval_loss for r in held.collect()] == [0.7]
    (tmp_path / "log.csv").write_text("step,loss\n3,0.25\n")
    assert [tuple(r) for r in sensor.read_training_log(spark, str(tmp_path / "log.csv"), str(tmp_path / "state.json")).collect()] == [(3, 0.25, None)]
    assert sensor.read_training_log(spark, str(tmp_path / "a"), str(tmp_path / "b")).count() == 0
