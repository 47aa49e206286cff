"""Registered queries against their SQL on the smallest tables, and the stream against the window query."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
from tallyflow.operators.models import Config
from tallyflow.plans import queries as q
from tallyflow.plans.oracle import SQL
from tallyflow.streaming.prequential import StreamingModel

SF = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
#: Those that run in a few seconds; the driver compares all of them.
QUICK = ["corpus_profile", "parsed_corpus", "shuffle_order", "tokenize", "ngram_length_stats", "nb_fh_train", "nb_cm_prequential", "nb_fh_folds", "nb_warm_split", "confusion", "stratified_split", "threshold_sweep", "parameter_sweep", "space_usage"]


def rows(pdf):
    pdf = pdf[sorted(pdf.columns)]
    return list(pdf.columns), sorted(map(str, pdf.astype(object).where(pdf.notna(), None).values.tolist()))


@needs_data
@pytest.mark.parametrize("name", [*QUICK, "corpus_load", "murmur_buckets", "kept_classifier", "held_out_confusion", "shuffled_split", "learning_curve_slice"])
def test_query_is_its_sql(spark, name):
    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    assert rows(q.QUERIES[name](spark, SF).toPandas()) == rows(con.execute(SQL[name]).df())


@needs_data
def test_entry(spark):
    assert entry.entry(spark).columns == ["doc_id", "spam", "slot", "score"]
    assert set(entry.oracle_sql()) <= set(entry.queries())


@needs_data
def test_stream_is_the_window_query_and_retries_are_harmless(spark, tmp_path):
    want = {r.doc_id: r.score for r in q.streaming_prequential(spark, SF, 10).collect()}
    from tallyflow.operators import models, splits
    from tallyflow.plans.inputs import emails

    e = splits.windows(emails(spark, SF), 10)
    assert want == {r.doc_id: r.score for r in models.score(e, [q.CM]).collect()}
    for compact in (3, 50):
        m = StreamingModel(spark, Config("CM", 1, 12, 3), f"{tmp_path}/{compact}", "md5", compact)
        for b in range(9):
            for _ in range(2 if b == 4 else 1):  # batch 4 is run again
                m.process(e.where(f"slot = {b}").select("doc_id", "body", "spam"), b)
        assert want == {r.doc_id: r.score for r in m.scores().collect()}


@needs_data
def test_live_stream(spark, tmp_path):
    from tallyflow.plans.inputs import emails

    for i in range(3):
        emails(spark, SF).where(f"seq % 3 = {i}").select("doc_id", "body", "spam").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    live = spark.readStream.schema("doc_id long, body string, spam long").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    m = StreamingModel(spark, Config("FH", 1, 10), f"{tmp_path}/model")
    m.start(live).awaitTermination(120)
    got = m.scores()
    assert got.count() == 87 and got.where("batch = 0").select("score").distinct().collect()[0][0] == 0.5 and got.where("score <> 0.5").count() > 0
