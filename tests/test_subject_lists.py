from sensorloom.operators import split


def test_subjects_stay_out_of_the_plan(spark):
    """With 3000 subjects the split's plan is as long as with three, and the split the same."""
    plans = {}
    for n in (3, 3000):
        out = split.subject_split(spark.range(n).selectExpr("cast(id as int) AS subject_id", "id AS window_id"))
        plans[n] = len(out._jdf.queryExecution().toString())
        assert {r.split: r["count"] for r in out.groupBy("split").count().collect()} == {"train": n - 2, "val": 1, "test": 1}
        assert {r.subject_id: r.split for r in out.where("split <> 'train'").collect()} == {n - 1: "test", n - 2: "val"}
    assert plans[3000] < plans[3] + 500


def test_subjects_of_given_lists_and_few_rows(spark):
    rows = lambda *ids: spark.createDataFrame([(i,) for i in ids], "subject_id int")
    said = lambda df: {r.subject_id: r.split for r in df.collect()}
    assert said(split.subject_split(rows(5, None))) == {5: "test"} and said(split.subject_split(rows(None))) == {}
    assert said(split.subject_split(rows(1, 2))) == {1: "val", 2: "test"}
    assert said(split.subject_split(rows(1, 2, 3, 4), val=[1])) == {1: "train", 2: "train", 4: "test"}
    assert said(split.subject_split(rows(1, 2, 3, 4), train=[4], val=[2], test=[9])) == {4: "train", 2: "val"}
