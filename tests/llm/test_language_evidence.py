import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from sensorloom.llm import language_id

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
UNSEEN = [
    "Всички хора се раждат свободни и равни по достойнство и права. Те са надарени с разум и съвест и следва да се отнасят помежду си в дух на братство.",
    "すべての人間は、生まれながらにして自由であり、かつ、尊厳と権利とについて平等である。人間は、理性と良心とを授けられている。",
    "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw. Są oni obdarzeni rozumem i sumieniem.",
    "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan. Heille on annettu järki ja omatunto.",
    "Minden emberi lény szabadon születik és egyenlő méltósága és joga van.",
    "xq zzkf wpp qqrt bvgx kkjz wqqx pzzt xxvw qjjk zzwp gkqx",
]


@pytest.fixture(scope="module")
def table(spark):
    if not os.path.isdir(SF):
        pytest.skip("no test tables")
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def model(table):
    return language_id.fit(table, usable=language_id.fold(F.col("doc_id"), 5) != 0)


def test_unseen_languages_are_rejected_and_others_kept(table, model):
    for text in UNSEEN:
        lang, score, accepted = model.predict(text)
        assert lang in model.languages and score < 0.8 and not accepted, text
    got = language_id.identify(table.where(language_id.fold(F.col("doc_id"), 5) == 0), model).where("lang IS NOT NULL AND text RLIKE '[A-Za-z]{2}'").collect()
    assert len(got) > 20 and np.mean([r.lang_pred == r.lang for r in got]) >= 0.95
    assert np.mean([r.lang_accepted for r in got]) >= 0.95


def test_scores_are_no_certainties(table, model):
    """The temperature lies inside its grid, so that scores tell texts apart."""
    assert 0.001 < model.temperature < 100
    scores = [r.lang_score for r in language_id.identify(table, model).where("lang_pred <> 'und'").collect()]
    assert max(scores) < 1 - 1e-4 and len(set(scores)) > len(scores) / 2


def test_evidence_of_short_and_empty_texts(model):
    known = np.zeros(language_id.KNOWN, bool)
    assert language_id.evidence(np.zeros(0, np.int64), known) == 1.0
    few, many = language_id.subwords(b"z"), language_id.subwords(b"zz qq xx vv kk jj ww " * 20)
    assert language_id.evidence(few, known) > 1 - language_id.UNKNOWN > language_id.evidence(many, known)
    assert model.predict("12 34 !?") == ("und", 0.0, False) and model.predict(None) == ("und", 0.0, False)


def test_ties_repeats_and_long_texts(spark):
    rows = [(i, t, lang) for i, (t, lang) in enumerate([("aba bab", "a"), ("aba bab", "b")] * 30)] + [(99, "aba bab " * 200_000, None), (99, "aba bab", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.fit(df)
    got = language_id.identify(df, model, ["doc_id"]).collect()
    assert len(got) == len(rows) and all(0 <= r.lang_score <= 1 and r.lang_pred in ("a", "b") for r in got)
    assert {round(r.lang_score, 3) for r in got if r.doc_id != 99} == {round(got[0].lang_score, 3)}
    flat = language_id.Model(["a", "b"], np.zeros((language_id.BUCKETS, 2)), np.zeros(2), np.ones(language_id.KNOWN, bool))
    assert flat.predict("any text")[0] == "a"
