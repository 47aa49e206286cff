"""The kept classifier, loading corpora, result tables, the run of everything."""

import os

import pytest
from pyspark.sql import functions as F

from tallyflow.functions import metrics
from tallyflow.operators import models, reports, splits, tuning
from tallyflow.operators.classifier import Classifier
from tallyflow.operators.models import Config
from tallyflow.plans import experiments
from tallyflow.plans.oracle import SQL
from tallyflow.sources import corpus, csvfiles, shared
from test_models import emails
from test_queries import QUICK

ROWS = [(f"win money now {i} " if i % 3 else f"meeting at noon {i % 4} ", int(i % 3 > 0)) for i in range(30)]


def test_every_quick_query_has_sql():
    assert not [n for n in QUICK if n not in SQL]


@pytest.mark.parametrize("config", [Config("FH", 2, 8), Config("CM", 2, 6, 3)])
def test_kept_classifier_is_the_model_of_a_split(spark, tmp_path, config):
    e = emails(spark, ROWS)
    both = e.withColumns({"trains": F.col("seq") < 20, "slot": F.lit(0).cast("long")})
    want = {r.doc_id: r.score for r in models.score(both, [config], "split", hash_mode="xxhash").collect()}
    start = Classifier.empty(spark, config)
    assert {r.score for r in start.predict(e).collect()} == {0.5} and start.num_examples_processed == 0
    some = start.update(e.where("seq < 7"))
    some.save(f"{tmp_path}/kept")
    whole = Classifier.load(spark, f"{tmp_path}/kept").update(e.where("seq BETWEEN 7 AND 19"))
    got = whole.classify(e.where("seq >= 20")).collect()
    assert {r.doc_id: r.score for r in got} == want and all(r.is_spam == (r.score > 0.5) for r in got)
    assert (whole.num_examples_processed, some.num_examples_processed, whole.config) == (20, 7, config)
    empty = whole.predict(spark.createDataFrame([(1, ""), (2, None)], "doc_id long, body string")).collect()
    assert len(empty) == 2 and empty[0].score == empty[1].score


def test_load_numbers_and_shuffles_all_corpora(spark, tmp_path, capsys):
    (tmp_path / "a.txt").write_text("EMAIL> label=1 a\nx\ny\n\nEMAIL> label=0 b\nz\n\nleft over\n")
    (tmp_path / "b.txt").write_text("EMAIL> label=0 c\r\n\nEMAIL> label=1 d\nno end")
    got = corpus.load(spark, [f"{tmp_path}/a.txt", f"{tmp_path}/none.txt", f"{tmp_path}/b.txt"], 3).collect()
    assert sorted((r.doc_id, r.header[-1], r.body, r.spam) for r in got) == [(0, "a", "xy", 1), (1, "b", "z", 0), (2, "\r", "", 0)]
    assert sorted(r.seq for r in got) == [0, 1, 2]
    said = capsys.readouterr().out
    assert "none.txt doesn't exist" in said and said.count("emails of") == 3
    assert corpus.load(spark, [f"{tmp_path}/none.txt"]).count() == 0


def test_published_names_of_classifiers(spark, tmp_path):
    (tmp_path / "t.csv").write_text("classifier,ngram,log_buckets,num_hashes,total_time_s,time_per_email_ms\nFeatureHashing,1,10,0,2.852,0.0111902\nCountMin,2,12,3,3.5,0.02\n")
    rows = reports.config_label(csvfiles.read_csv(spark, f"{tmp_path}/t.csv", "timing_results")).orderBy("ngram").collect()
    assert [(r.classifier, r.label) for r in rows] == [("FH", "FH n=1 b=2^10"), ("CM", "CM n=2 b=2^12 d=3")]
    assert csvfiles.read_csv(spark, f"{tmp_path}/none.csv", "timing_results") is None


def test_all_experiments_write_their_tables(spark, tmp_path):
    e = emails(spark, ROWS)
    tested = experiments.run(e, str(tmp_path), models.grid([1], [6], [2]), [Config("FH", 1, 6)], [10])
    assert tested.count() == 12  # two classifiers by six metrics
    rows = {t: csvfiles.read_csv(spark, f"{tmp_path}/{t}.csv", t) for t in csvfiles.SCHEMAS}
    assert {t: r.columns for t, r in rows.items()} == {t: [f.split()[0] for f in s.split(", ")] for t, s in csvfiles.SCHEMAS.items()}
    assert {t: r.count() for t, r in rows.items() if t not in ("pr_curve", "roc_curve")} == {"cv_results": 10, "final_configs": 12, "evaluation_results": 12, "learning_curves": 36, "timing_results": 1, "parameter_sweep": 2, "brier_scores": 12}
    assert rows["pr_curve"].count() == rows["roc_curve"].count() > 12 and rows["roc_curve"].where("tpr IS NULL OR fpr IS NULL OR optimized_for IS NULL").count() == 0
    assert rows["learning_curves"].where("threshold IS NULL OR num_examples IS NULL").count() == 0


def test_grid_of_the_search():
    assert len(experiments.SEARCH) == 90 and len(experiments.TIMED) == 48 and len(set(experiments.SEARCH)) == 90


def test_whole_grid_is_each_configuration_alone(spark):
    """90 configurations in one plan score as each does by itself."""
    e = splits.windows(emails(spark, ROWS[:12]), 3)
    many = models.score(e, experiments.SEARCH, hash_mode="xxhash")
    assert many.count() == 12 * 90
    for c in (experiments.SEARCH[0], experiments.SEARCH[17], experiments.SEARCH[18], experiments.SEARCH[-1]):
        own = many.where(" AND ".join(f"{k} = '{getattr(c, k)}'" for k in tuning.KEYS))
        assert {r.doc_id: r.score for r in own.collect()} == {r.doc_id: r.score for r in models.score(e, [c], hash_mode="xxhash").collect()}


def test_held_out_confusion_and_curve_slice(spark):
    e = emails(spark, ROWS).withColumn("trains", F.col("seq") < 20)
    c = tuning.held_out(e, [Config("FH", 1, 8)]).first()
    preds = models.score(e.withColumn("slot", F.lit(0).cast("long")), [Config("FH", 1, 8)], "split").collect()
    assert (c.tp, c.fp) == tuple(sum(p.score > 0.5 and p.spam == s for p in preds) for s in (1, 0)) and c.tp + c.fp + c.tn + c.fn == 10
    curves = spark.createDataFrame([("FH", 1, 8, 0, w, n) for w in (10, 20) for n in (30, 10, 20)] + [("CM", 1, 8, 2, 10, 5)], "classifier string, ngram int, log_buckets int, num_hashes int, window int, num_examples long")
    some = reports.learning_curve_slice(curves, curves.where("classifier = 'FH'"), 10).collect()
    assert [r.num_examples for r in some] == [10, 20, 30]
    assert reports.baseline_precision(emails(spark, ROWS)).first()[0] == pytest.approx(2 / 3)


def test_tables_are_deleted_on_request(spark):
    df = shared.written(spark.range(3).toDF("x"), "test")
    at = df._written_at.removeprefix("file:")
    assert os.path.isdir(at) and df.count() == 3
    shared.discard(df)
    assert not os.path.exists(at)
    shared.discard(df)
    more = shared.written(spark.range(3).toDF("x"), "test")
    shared.clear(spark)
    assert not os.path.exists(more._written_at.removeprefix("file:"))


def test_metrics_of_a_threshold_for_each_row(spark):
    df = spark.createDataFrame([(1, 0.6, 0.7), (1, 0.8, 0.7), (0, 0.9, 0.95)], "spam long, score double, threshold double")
    r = metrics.rates(df.agg(*metrics.confusion(F.col("spam"), metrics.predicted(F.col("score"), F.col("threshold"))))).first()
    assert (r.tp, r.fp, r.tn, r.fn) == (1, 0, 1, 1)
