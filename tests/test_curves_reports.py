import pytest
from pyspark.sql import functions as F

from tallyflow.operators import curves, reports
from tallyflow.sources import corpus, csvfiles

PREDS = [(0.9, 1), (0.8, 1), (0.705, 0), (0.6, 1), (0.4, 0), (0.2, 0)]


def preds(spark, rows=PREDS):
    return spark.createDataFrame([(i, *r, "c") for i, r in enumerate(rows)], "doc_id long, score double, spam long, cfg string")


def test_roc_metrics(spark):
    r = curves.cv_metrics(preds(spark), ["cfg"]).first()
    assert r.auc == pytest.approx(0.888888889, abs=1e-9) and r.brier_score == pytest.approx(0.151170833, abs=1e-9)
    assert [r.recall_at_fpr_001, r.recall_at_fpr_0001, r.recall_at_prec_99, r.recall_at_prec_95] == pytest.approx([2 / 3] * 4)


def test_one_class_and_no_predictions(spark):
    r = curves.cv_metrics(preds(spark, [(0.9, 1), (0.4, 1)]), ["cfg"]).first()
    assert (r.auc, r.recall_at_fpr_001, r.recall_at_prec_95) == (0, 0, 0) and r.brier_score == pytest.approx(0.185)
    assert curves.cv_metrics(preds(spark, []), ["cfg"]).count() == 0
    assert curves.curve_points(preds(spark, [(0.9, 1)]), ["cfg"]).count() == 0


def test_ties_go_by_id_across_spans(spark):
    p = preds(spark, [(0.5, i % 2) for i in range(20)])
    from tallyflow.operators.running import ranked_running

    got = ranked_running(p, ["cfg"], "score", "doc_id", ["spam"], span=3).orderBy("doc_id").collect()
    assert [r.rn for r in got] == list(range(1, 21)) and [r.cum_spam for r in got] == [(i + 1) // 2 for i in range(20)]
    assert curves.cv_metrics(p, ["cfg"], "group").first().auc == pytest.approx(0.5)


def test_best_threshold_and_grid(spark):
    assert len(curves.THRESHOLDS) == 80 and curves.THRESHOLDS[0] == 0.1 and curves.THRESHOLDS[-1] == 0.89
    b = curves.best_threshold(preds(spark), ["cfg"]).first()
    assert b.threshold == 0.71 and b.f05 == pytest.approx(0.909090909) and b.precision == 1 and b.recall == pytest.approx(2 / 3)


def test_curve_points_are_where_the_class_changes(spark):
    rows = curves.curve_points(preds(spark), ["cfg"]).orderBy("rn").collect()
    assert [r.rn for r in rows] == [1, 2, 3, 4, 6] and (rows[-1].tp, rows[-1].fp, rows[-1].tn, rows[-1].fn) == (3, 3, 0, 0)


MAIL = {
    "plain": (["A", "x", "y", ""], [("A", "xy")]),
    "no end": (["A", "x"], []),
    "spill": (["x", "", "A", "y", ""], [("A", "xy")]),
    "last header": (["A", "x", "B", "y", ""], [("B", "xy")]),
    "empty body": (["", "", "A", ""], [("A", "")]),
    "two": (["A", "x", "", "B", "y", ""], [("A", "x"), ("B", "y")]),
    "return": (["A", "x", "\r", "", "z"], [("A", "x\r")]),
}
HEAD = {"A": "EMAIL> label=1 a", "B": "EMAIL> label=0 b"}


def test_corpus_files(spark, tmp_path):
    for name, (lines, _) in MAIL.items():
        (tmp_path / f"{name.replace(' ', '_')}.txt").write_bytes("".join(f"{HEAD.get(x, x)}\n" for x in lines).encode())
    got: dict = {}
    for r in corpus.read_emails(spark, f"{tmp_path}/*.txt", f"{tmp_path}/absent.txt").orderBy("source", "email_no").collect():
        got.setdefault(r.source.rsplit("/", 1)[1][:-4].replace("_", " "), []).append((r.header, r.body))
        assert r.is_spam == (r.header == HEAD["A"])
    assert got == {k: [(HEAD[h], b) for h, b in want] for k, (_, want) in MAIL.items() if want}
    assert corpus.read_emails(spark, f"{tmp_path}/absent").count() == 0


def test_csv_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("FH", 1, 10, 0, 0.5)], "classifier string, ngram int, log_buckets int, num_hashes int, precision double")
    csvfiles.write_csv(df, f"{tmp_path}/s", "parameter_sweep")
    r = csvfiles.read_csv(spark, f"{tmp_path}/s", "parameter_sweep").first()
    assert r.precision == 0.5 and r.recall is None and csvfiles.read_csv(spark, f"{tmp_path}/none", "parameter_sweep") is None


def test_reports(spark):
    rows = [(c, n, b, d, n + b / 10 + d) for c, ds in (("FH", [0]), ("CM", [2, 3])) for n in (1, 2) for b in (10, 12) for d in ds]
    df = spark.createDataFrame(rows, "classifier string, ngram int, log_buckets int, num_hashes int, accuracy double")
    p = {(r.classifier, r.ngram): (r.b10, r.b12) for r in reports.pivot_by_buckets(df, "accuracy", [10, 12]).collect()}
    assert p["FH", 1] == (2.0, 2.2) and p["CM", 2] == (5.5, 5.7)
    d = {(r.dimension, r.classifier, r.level): r for r in reports.by_dimension(df, ["accuracy"]).collect()}
    assert d["ngram", "FH", 1].n == 2 and d["num_hashes", "CM", 3].mean_accuracy == pytest.approx(5.6) and len(d) == 11
    assert {r.kind: r.accuracy for r in reports.best_and_worst(df, "accuracy").collect()} == {"best": 6.2, "worst": 2.0}
    assert reports.only_configs(df, df.where("num_hashes = 2")).count() == 4
    assert reports.config_label(df).where("label = 'CM n=2 b=2^12 d=3'").count() == 1
    assert reports.space_usage(spark).where("classifier = 'CM' AND num_hashes = 5 AND log_buckets = 10").first().bytes == 81920
    assert reports.sizes(df).agg(F.max("dimension")).first()[0] == 3 * 4096
