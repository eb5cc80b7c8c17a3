import json
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from sensorloom.functions import text as tx
from sensorloom.operators import candidates, clean, metrics, reduce, scans, split, windows
from sensorloom.plans import config, evaluate, preprocess, reports
from sensorloom.sources import sensor, sinks

W = "window_id long, subject_id int, activity_id int, activity_name string, w array<array<double>>"


def cut(spark, n=60, steps=6, seed=0, first=0):
    r = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        a = i % 2
        base = np.sin(np.arange(steps) * (a + 1)) * 3
        rows.append((first + i, 101 + i % 3, 4 + a, ("walking", "running")[a], [(base + r.normal(size=steps) * 0.3 + c).tolist() for c in range(2)]))
    return spark.createDataFrame(rows, W).cache()


def settings(**sections):
    data = {"preprocessed_dir": "p", "output_dir": "o", "train_subjects": [101], "val_subjects": [102], "test_subjects": [103]}
    return config.from_dict({"data": data | sections.pop("data", {}), **sections})


RUNS = [
    {"method": "pca", "n_components": 2, "standardization": "per_channel_train", "text_template": "structured_v2"},
    {"method": "fastica", "n_components": 2, "standardization": "per_channel_train", "text_template": "compact_values_v2", "input_tokens_precision": 3},
    {"method": "pca", "n_components": 3, "text_template": "base_template"},
    {"method": "pca", "n_components": 2, "standardization": "none", "text_template": "fim_template"},
    {"method": "pca", "n_components": 2, "permute_columns": False},
]


@pytest.mark.parametrize("embedding", RUNS)
def test_run_files_run(spark, embedding):
    """Values equal numpy's, and records have the template's form, with permutation as the default."""
    c = settings(embedding=embedding)
    rows = cut(spark)
    made = preprocess.build_dataset(rows, ["x", "y"], c)
    data = rows.collect()
    got = {r.window_id: r.asDict() for r in made.texts.collect()}
    k, digits = embedding["n_components"], embedding.get("input_tokens_precision", 4)
    assert {r["split"] for r in got.values()} == {"train", "val", "test"}
    for ch in range(2):
        x = np.array([r.w[ch] for r in data])
        train = np.array([r.subject_id == 101 for r in data])
        if embedding.get("standardization") == "per_channel_train":
            x = (x - x[train].mean()) / x[train].std()
        x = (x - x[train].mean(axis=0)) / x[train].std(axis=0)
        mine = np.array([[got[r.window_id][f"value_{ch * k + j}"] for j in range(k)] for r in data])
        if embedding["method"] == "pca":
            vt = np.linalg.svd(x[train], full_matrices=False)[2][:k]
            vt = vt * np.sign(vt[np.arange(k), np.abs(vt).argmax(axis=1)])[:, None]
            assert np.allclose(mine, x @ vt.T, atol=1e-5)
        else:
            assert np.allclose(np.cov(mine[train].T, bias=True), np.eye(k), atol=1e-3)
    template = embedding.get("text_template", "fim_template_textual_encoding")
    values = [f"value_{i}" for i in range(2 * k)]
    for r in got.values():
        number = {v: f"{r[v]:.{digits}f}" for v in values}
        shown = {c: str(r[c]) for c in ("window_id", "subject_id", "activity_id", "activity_name")} | number
        text = r["text"]
        assert text.endswith(tx.EOS)
        if template == "structured_v2":
            assert text.startswith(f"Condition:\nactivity_name = {r['activity_name']}\n")
            assert text.split("Target:\n")[1] == "; ".join(f"{v} = {number[v]}" for v in values) + f"; [end]{tx.EOS}"
        elif template == "compact_values_v2":
            assert text.split("Target values:\n")[1] == ", ".join(number.values()) + f" [end]{tx.EOS}"
        elif template == "base_template":
            assert dict(p.split(" is ") for p in text.removesuffix(tx.EOS).split(", ")) == shown
        elif template == "fim_template":
            names = re.findall(r"(\w+) is \[blank\]", text)
            assert sorted(names) == sorted(shown) and text.split("Target: ")[1] == " ".join(f"{shown[n]} [answer]" for n in names) + tx.EOS
        else:
            assert text == f"Condition: {', '.join(f'{n} is {shown[n]}' for n in ('window_id', 'subject_id', 'activity_id', 'activity_name'))} [sep] Input: {', '.join(f'{v} is [blank]' for v in values)} [sep] Target: {' '.join(f'{number[v]} [answer]' for v in values)}{tx.EOS}"
    assert tx.token_budget(2 * k, 10, 1000, 50) == (max(10, 16 * k), 12 * k) and tx.token_budget(4, 64, 20, 30)[0] == 1
    made.model.unpersist()


def test_generated_text_to_windows(spark):
    """Text written from embeddings is parsed, filtered and decoded to the windows it came from."""
    c = settings(embedding={"method": "pca", "n_components": 6, "permute_columns": False, "input_tokens_precision": 9}, generation={"max_prompts": 5, "norm_filter_iqr_factor": 50.0})
    rows = cut(spark)
    made = preprocess.build_dataset(rows, ["x", "y"], c)
    said = preprocess.prompts(made.embeddings, c)
    assert [r.window_id for r in said.collect()] == [2, 5, 8, 11, 14] and all(r.prompt.endswith("Target: ") for r in said.collect())
    reference = made.embeddings.where("split = 'train'")
    train = made.texts.where("split = 'train'").select(F.col("window_id").alias("candidate_id"), "window_id", "subject_id", "activity_id", "activity_name", F.col("text").alias("generated_text"))
    repeat = train.where("candidate_id = 0").withColumn("candidate_id", F.lit(900).cast("long"))
    broken = train.where("candidate_id = 3").withColumns({"candidate_id": F.lit(901).cast("long"), "generated_text": F.lit("Target: 1.0 [answer] 2")})
    far = train.where("candidate_id = 6").withColumns({"candidate_id": F.lit(902).cast("long"), "generated_text": F.lit("Target: " + "9999 [answer] " * 12)})
    out = preprocess.generated_to_windows(train.unionByName(repeat).unionByName(broken).unionByName(far), reference, made.model, c)
    why = {r.candidate_id: r.filter_reason for r in out.debug.collect()}
    assert {why.pop(900), why.pop(901), why.pop(902)} == {"duplicate", "missing_fields", "norm_filter"} and set(why.values()) == {"kept"}
    assert (why[0], out.kept.count(), out.summary.first().raw) == ("kept", 20, 23)
    truth = {r.window_id: r.w for r in rows.collect()}
    for r in out.windows.collect():
        assert np.allclose(r.w, truth[r.window_id], atol=1e-4)
    labelled = candidates.reasons_for(train.unionByName(repeat), out.debug.where("candidate_id < 900")).select("candidate_id", "filter_reason").collect()
    assert {r.filter_reason for r in labelled if r.candidate_id == 900} == {"unknown"}
    plain = tx.parse_values(train, "generated_text", [f"value_{i}" for i in range(12)])
    assert plain.columns == [*train.columns, *[f"value_{i}" for i in range(12)]] and plain.where("value_11 IS NULL").count() == 0
    made.model.unpersist()


def test_evaluation_by_settings(spark, tmp_path):
    from sensorloom import __main__ as cli

    real, made, test = cut(spark, 40), cut(spark, 30, seed=1, first=1000), cut(spark, 20, seed=2, first=2000)
    raw = {"data": {"preprocessed_dir": "p", "output_dir": "o"}, "similarity": {"max_lag": 3, "max_samples_per_activity": 10, "mdd_bins": 7}, "utility": {"n_estimators": 5, "max_depth": 4}}
    report = {r.activity_name: r for r in evaluate.similarity_report(real, made, config.from_dict(raw)).collect()}
    assert set(report) == {"walking", "running", "overall_mean"} and report["walking"].num_real == 10 and report["walking"].SHR is None and report["overall_mean"].ED > 0
    use = {r.setting: r.accuracy for r in evaluate.utility_report(real, test, made, config.from_dict(raw)).collect()}
    assert set(use) == {"real_only", "synthetic_only", "real_plus_synthetic"} and min(use.values()) > 0.7
    with pytest.raises(ValueError):
        evaluate.utility_report(real, test, made, config.from_dict(raw | {"utility": {"classifier": "other"}}))
    for name, df in (("real", real), ("made", made), ("test", test)):
        df.write.parquet(f"{tmp_path}/{name}")
    (tmp_path / "run.json").write_text(json.dumps(raw))
    cli.main(["evaluate-similarity", "--config", f"{tmp_path}/run.json", "--real-windows", f"{tmp_path}/real", "--synthetic-windows", f"{tmp_path}/made", "--output-dir", f"{tmp_path}/out"])
    cli.main(["evaluate-utility", "--config", f"{tmp_path}/run.json", "--real-train-windows", f"{tmp_path}/real", "--real-test-windows", f"{tmp_path}/test", "--synthetic-windows", f"{tmp_path}/made", "--output-dir", f"{tmp_path}/out"])
    assert sinks.committed_table(spark, f"{tmp_path}/out/similarity_metrics").count() == 3 and sinks.committed_table(spark, f"{tmp_path}/out/utility_metrics").count() == 3
    assert spark.read.option("header", True).csv(f"{tmp_path}/out/utility_metrics_csv").count() == 3
    assert config.from_dict(json.loads(spark.read.text(f"{tmp_path}/out/similarity_metrics_config").first()[0])).similarity.max_lag == 3


def test_preprocessing_in_segments(spark):
    r = random.Random(1)
    rows = [(i, 101, 4, "walking", i * 0.01 + (5 if i > 300 else 0), r.choice([None, r.random()]), float(i), "f") for i in range(500)]
    df = spark.createDataFrame(rows, "event_id long, subject_id int, activity_id int, activity_name string, timestamp double, x double, y double, source_file string")
    plain, long = (preprocess.preprocess(df, ["x", "y"], 8, 4, ratio=0.5, normalization="zscore", segment_rows=s) for s in (None, 40))
    for a, b in ((plain.windows, long.windows), (plain.normalized, long.normalized)):
        want, got = ({r.window_id: r for r in x.collect()} for x in (a, b))
        assert want.keys() == got.keys() and len(want) == 122
        assert all(np.allclose(want[i].w, got[i].w) and want[i].run_id == got[i].run_id and want[i].start_index == got[i].start_index for i in want)
    with pytest.raises(ValueError):
        preprocess.preprocess(df, ["x"], normalization="other")


def test_rotation_equals_numpy(spark):
    """The distributed iteration ends where the same one on one matrix ends."""
    r = np.random.default_rng(5)
    mixed = r.laplace(size=(600, 3)) @ r.normal(size=(3, 8))
    w = spark.createDataFrame([(i, [v[:4].tolist(), v[4:].tolist()]) for i, v in enumerate(mixed)], "window_id long, w array<array<double>>").repartition(5)
    model = reduce.fit(w, ["a", "b"], "fastica", 3, "none").orderBy("channel_index").collect()
    for ch in range(2):
        x = mixed[:, 4 * ch : 4 * ch + 4]
        x = (x - x.mean(axis=0)) / x.std(axis=0)
        white = reduce.whitening(np.cov(x.T, bias=True), 3)
        z, turn = white @ x.T, reduce._orthogonal(np.random.default_rng(42).normal(size=(3, 3)))
        for _ in range(1000):
            g = np.tanh(turn @ z)
            fresh = reduce._orthogonal(g @ z.T / len(x) - (1 - g**2).mean(axis=1)[:, None] * turn)
            moved, turn = np.abs(np.abs((fresh * turn).sum(axis=1)) - 1).max(), fresh
            if moved < 1e-4:
                break
        assert np.allclose(np.array(model[ch].components), turn @ white, atol=1e-6)


def test_rotation_that_goes_to_and_fro_comes_to_rest(spark):
    r = np.random.default_rng(0)
    z = np.linalg.qr(r.normal(size=(120, 3)) - 0)[0]
    z = (z - z.mean(axis=0)) @ np.linalg.inv(np.linalg.cholesky(np.cov(z.T, bias=True))).T
    blocks = spark.createDataFrame([(0, bytearray(z[i : i + 50].tobytes())) for i in range(0, 120, 50)], "channel_index int, z binary")
    turn = reduce.rotations(blocks, {0: (120, 3)}, max_iter=120)[0]
    g = np.tanh(z @ turn.T)
    fresh = reduce._orthogonal(g.T @ z / 120 - (1 - g**2).mean(axis=0)[:, None] * turn)
    assert np.abs(np.abs((fresh * turn).sum(axis=1)) - 1).max() < 1e-3


def test_resampling(spark):
    r = random.Random(2)
    rows, want = [], []
    for g in (1, 2, None):
        t = sorted(round(r.random() * 50, 2) for _ in range(120))
        v = [r.random() for _ in t]
        rows += [(g, a, b) for a, b in zip(t, v, strict=True)]
        k = 0
        while t[0] + k * 0.25 <= t[-1]:
            at = t[0] + k * 0.25
            i = max(j for j in range(len(t)) if t[j] <= at)
            if t[i] == at:
                same = [v[j] for j in range(len(t)) if t[j] == at]
                want.append((str(g), at, max(same)))
            else:
                i = max((j for j in range(len(t)) if t[j] <= at), key=lambda j: (t[j], v[j]))
                n = min((j for j in range(len(t)) if t[j] > at), key=lambda j: (t[j], v[j]))
                want.append((str(g), at, v[i] + (v[n] - v[i]) * (at - t[i]) / (t[n] - t[i])))
            k += 1
    df = spark.createDataFrame([*rows, (1, None, 5.0), (2, float("nan"), 1.0), (7, 3.0, 4.0)], "subject_id int, timestamp double, x double")
    for size in (10**6, 15):
        got = sorted((str(r.subject_id), r.timestamp, r.x) for r in scans.resample(df, ["subject_id"], "timestamp", ["x"], 0.25, size).collect())
        assert [g[:2] for g in got] == sorted([*[x[:2] for x in want], ("7", 3.0)]) and np.allclose([g[2] for g in got], [x[2] for x in sorted([*want, ("7", 3.0, 4.0)])])
    far = spark.createDataFrame([(1, 0.0, 0.0), (1, 30_000.0, 30_000.0)], "subject_id int, timestamp double, x double")
    assert scans.resample(far, ["subject_id"], "timestamp", ["x"], 1.0).where("abs(x - timestamp) < 1e-6").count() == 30_001
    assert scans.resample(df.limit(0), ["subject_id"], "timestamp", ["x"], 1.0).count() == 0


def test_versions_and_crashes(spark, tmp_path):
    """A write that fails half-way, and a job that dies between two renames, lose nothing."""
    here, backup = f"{tmp_path}/m", f"{tmp_path}/b"
    good, fails = spark.range(3), spark.range(0, 8, 1, 4).select(F.when(F.col("id") < 6, F.col("id")).otherwise(F.raise_error(F.lit("cut off"))).cast("long").alias("id"))
    sinks.write_metrics(good, here, backup)
    with pytest.raises(Exception, match="cut off"):
        sinks.write_metrics(fails, here, backup)
    assert spark.read.parquet(here).count() == 3
    sinks.recover(spark, here, backup)
    assert spark.read.parquet(here).count() == 3 and not (tmp_path / "m.next").exists()
    spark.range(5).write.parquet(f"{here}.next")  # as if the job had died before its renames
    sinks.recover(spark, here, backup)
    assert spark.read.parquet(here).count() == 5 and spark.read.parquet(backup).count() == 3
    spark.range(6).write.parquet(f"{here}.next")
    (tmp_path / "m").rename(tmp_path / "gone")  # or between them
    sinks.recover(spark, here, backup)
    assert spark.read.parquet(here).count() == 6
    table = f"{tmp_path}/t"
    with pytest.raises(FileNotFoundError):
        sinks.committed_table(spark, table)
    assert [sinks.commit_table(spark.range(n), table) for n in (1, 2)] == [1, 2]
    with pytest.raises(Exception, match="cut off"):
        sinks.commit_table(fails, table)
    assert sinks.committed_table(spark, table).count() == 2 and sinks.committed_table(spark, table, 1).count() == 1
    assert sinks.commit_table(spark.range(4), table) == 3 and sinks.committed_table(spark, table).count() == 4


def test_other_subjects_files_are_not_opened(spark, tmp_path):
    line = "  ".join(["1.5", "4", "70", *(str(i) for i in range(51))]) + "\n"
    for s in (101, 102, 103, 104):
        (tmp_path / f"subject{s}.dat").write_text(line * 5 if s == 102 else "this is no recording\n" * 5)
    df = sensor.read_recordings(spark, str(tmp_path), [102])
    assert df.count() == 5
    plan = df._jdf.queryExecution()
    df._jdf.collectToPython()
    nodes, files = [plan.executedPlan()], 0
    while nodes:
        node = nodes.pop()
        if node.metrics().contains("numFiles"):
            files += node.metrics().apply("numFiles").value()
        nodes += [node.children().apply(i) for i in range(node.children().size())]
    assert files == 1
    with pytest.raises(Exception, match="expected 54 columns"):
        sensor.read_recordings(spark, str(tmp_path)).collect()


def test_manifest_of_real_files(spark, tmp_path):
    """The five states come from the files themselves; a corrupt one marks its own run only."""
    head = "activity_name,num_real,num_synthetic,MDD,ACD,SD,KD,ED,DTW,SHR\n"
    files = {
        "ok": (head + "walking,3,4,1,1,1,1,1,1,1\noverall_mean,5,6,0.5,1,2,3,4,5,6\n").encode(), "last": (head + "walking,3,4,1,1,1,1,1,1,1\nrunning,,4,2,2,2,2,2,2,\n").encode(), "empty": head.encode(),
        "lacking": b"activity_name,ED\nwalking,7\n", "corrupt": b"\xff\xfe\x00garbage\x80", "ragged": b"a,b\n1,2,3\n", "blank": b"", "absent": None, "nofolder": None,
    }
    for name, content in files.items():
        if name != "nofolder":
            (tmp_path / name).mkdir()
        if content is not None:
            (tmp_path / name / "similarity_metrics.csv").write_bytes(content)
            (tmp_path / name / "weights.csv").write_bytes(b"\xff" * 100)
    names = list(files)
    for k, part in enumerate((names[:4], names[4:])):
        (tmp_path / f"m{k}.txt").write_text("".join(f"{tmp_path}/{n}/resolved_config.yaml\n\n" for n in part))
    got = {r.run_name: r for r in reports.summarize_manifests(spark, [f"{tmp_path}/m0.txt", f"{tmp_path}/m1.txt"]).collect()}
    assert {n: r.status for n, r in got.items()} == {"ok": "ok", "last": "ok", "empty": "empty", "lacking": "missing_metrics", "corrupt": "read_error", "ragged": "read_error", "blank": "read_error", "absent": "missing", "nofolder": "missing"}
    assert (got["ok"].MDD, got["ok"].num_real, got["ok"].num_activity_rows) == (0.5, 5, 1) and (got["last"].MDD, got["last"].num_real, got["last"].num_activity_rows, got["last"].SHR) == (2.0, None, 2, None)
    assert got["lacking"].missing_metrics == "MDD,ACD,SD,KD,DTW,SHR" and got["lacking"].ED == 7.0 and got["corrupt"].error and got["ok"].error is None
    assert (got["corrupt"].manifest, got["corrupt"].manifest_index) == ("m1.txt", 0)


def test_small_helpers(spark):
    rows = cut(spark, 12)
    ids = spark.createDataFrame([(3,), (3,), (5,), (99,)], "window_id long")
    assert sorted(r.window_id for r in windows.by_window_ids(rows, ids).collect()) == [3, 5]
    long = windows.to_long(rows.where("window_id = 1"), ["x", "y"], ["window_id"]).collect()
    truth = rows.where("window_id = 1").first().w
    assert len(long) == 12 and all(r.v == truth[r.channel_index][r.t] and r.channel == "xy"[r.channel_index] for r in long)
    assert sorted(r.window_id for r in split.first_per_activity(rows, 2, ["window_id"]).collect()) == [0, 1, 2, 3]
    sample = [r.window_id for r in split.sample_rows(rows, 5, "window_id").collect()]
    assert len(set(sample)) == 5 and sample == [r.window_id for r in split.sample_rows(rows.repartition(3), 5, "window_id").collect()] and split.sample_rows(rows, 50, "window_id").count() == 12
    last = spark.createDataFrame([(1, 1, "a"), (1, 3, "b"), (2, 2, "c")], "k int, o int, v string")
    assert sorted(r.v for r in candidates.last_by_key(last, "k", "o").collect()) == ["b", "c"]
    assert clean.select_channels(["a", "b", "c"], ["c", "a"], ["b"]) == ["c", "a"] and clean.select_channels(["a", "b"], None, ["b"]) == ["b"]
    with pytest.raises(ValueError):
        clean.select_channels(["a"], ["z"], [])
    assert sorted(["value_10", "value_2", "x", "value_1"], key=tx.numeric_key) == ["value_1", "value_2", "value_10", "x"]
    per = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", 5.0)], "activity_name string, m double")
    assert {r.activity_name: r.m for r in metrics.channel_means(per, "m").collect()} == {"a": 2.0, "b": 5.0}
    assert json.loads(sinks.as_json(last.where("o = 3")).first().json) == {"k": 1, "o": 3, "v": "b"} and json.loads(sinks.as_json(last.where("o = 3"), "v").first().json) == {"v": "b"}


def test_generation_sink(spark, tmp_path):
    sinks.write_generation(spark.range(2), spark.range(3), spark.range(1), str(tmp_path))
    assert spark.read.parquet(f"{tmp_path}/generated_embeddings").count() == 2 and spark.read.parquet(f"{tmp_path}/filter_debug").count() == 3 and spark.read.json(f"{tmp_path}/summary").count() == 1


def test_language_model_records(spark):
    meta = spark.createDataFrame([(1, 101, 4, "walking", 6, 0.0, 2.5), (2, 101, 5, "running", 6, 1.0, 3.5)], "window_id long, subject_id int, activity_id int, activity_name string, window_length int, start_timestamp double, end_timestamp double")
    from sensorloom.operators import features

    found = features.window_features(cut(spark, 3), ["x", "y"], ["window_id"])
    got = {r.window_id: r for r in tx.llm_records(meta, found, ["x", "y"]).collect()}
    assert got[1].condition_text == "Activity: walking. Subject: 101. Window length: 6. Channels: x, y." and got[2].embedding_placeholder is None
    want = {r.window_id: r.asDict() for r in found.collect()}
    assert got[2].stats_placeholder == {c: want[2][c] for c in ("x__mean", "x__std", "y__mean", "y__std")} and "{stats_placeholder}" in got[1].input_template_stats_to_text
