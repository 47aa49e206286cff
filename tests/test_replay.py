"""Scores by chunks of the stream against the joins: every mode and hash, chunks of one email and of many, odd bodies."""

import pytest
from pyspark.sql import functions as F

from tallyflow.functions import metrics
from tallyflow.operators import models, replay, splits, tuning

CONFIGS = models.grid([1, 2, 3], [4, 7], [2, 4])
BODIES = ["", "a", " ", "\n\n", "free money now ", "free\nmoney now", "x y\nx y\nx y ", "é 日本 𝒳 end", "a" * 3000, None]


@pytest.fixture(scope="module")
def emails(spark):
    rows = [(i, i, BODIES[i % len(BODIES)] if i % 3 else f"word{i % 7} free {i % 5}\nmoney {i} ", int(i % 4 == 0)) for i in range(60)]
    return spark.createDataFrame(rows, "doc_id long, seq long, body string, spam long")


def _rows(df):
    return sorted(tuple(r) for r in df.select(*models.CONFIG, "doc_id", "seq", "spam", "slot", "score").collect())


@pytest.mark.parametrize("mode, size, chunk, hash_mode", [("prequential", 1, 7, "md5"), ("prequential", 1, 1, "xxhash"), ("prequential", 10, 3, "murmur"), ("prequential", 6, 13, "md5"), ("folds", 1, 4, "md5"), ("in_sample", 1, 9, "xxhash"), ("split", 1, 8, "md5")])
def test_chunks_score_as_joins_do(emails, monkeypatch, mode, size, chunk, hash_mode):
    e = splits.folds(emails) if mode == "folds" else splits.windows(emails, size) if mode == "prequential" else emails.withColumn("slot", F.lit(0).cast("long"))
    if mode == "split":
        e = e.withColumn("trains", F.col("seq") % 5 != 1)
    monkeypatch.setattr(replay, "CHUNK", chunk)
    monkeypatch.setattr(replay, "OPEN", 2)
    found = _rows(models.score(e, CONFIGS, mode, hash_mode=hash_mode))
    monkeypatch.setattr(replay, "fits", lambda *_: False)
    want = _rows(models.score(e, CONFIGS, mode, hash_mode=hash_mode))
    assert [r[:-1] for r in found] == [r[:-1] for r in want] and len(found) == len(CONFIGS) * (12 if mode == "split" else 60)
    assert all(a[-1] == pytest.approx(b[-1], abs=2e-6) for a, b in zip(found, want))


def test_tables_that_begin_anew_lose_nothing(emails, monkeypatch):
    e = splits.windows(emails, 1)
    want = _rows(models.score(e, CONFIGS))
    of = _rows(models.score(replay.in_order(e), CONFIGS, stored=True))
    monkeypatch.setattr(replay, "KEPT_GRAMS", 3)
    layout = replay.Layout(CONFIGS)
    grams = replay._Grams(layout, "md5")
    monkeypatch.undo()
    assert of == want and not grams.full()
    grams.of("one two three four ", True)
    monkeypatch.setattr(replay, "KEPT_GRAMS", 3)
    assert grams.full()
    grams.learn()
    found = grams.of("one two three four ", True)[1]
    before = [grams.cells[k][ids].tolist() for k, (ids, _) in enumerate(found)]
    grams.clear()
    found = grams.of("one two three four ", True)[1]
    grams.learn()
    assert [grams.cells[k][ids].tolist() for k, (ids, _) in enumerate(found)] == before


def test_no_shuffle_of_n_grams(emails):
    """What grew with n-grams times counters: rows that meet in a shuffle are emails and blocks of counters now."""
    rows = replay.parts(splits.windows(emails, 1).withColumn("trains", F.lit(True)), replay.Layout(CONFIGS), "prequential", "md5")
    assert rows.count() == 60 and {len(r.ll) for r in rows.collect()} == {len(CONFIGS)}


def test_no_emails(emails):
    assert models.score(splits.windows(emails.where("seq < 0"), 1), CONFIGS).count() == 0
    assert models.score(splits.windows(emails.where("seq < 0"), 1).withColumn("trains", F.lit(True)), CONFIGS, "split").count() == 0


def test_md5_of_many_keys():
    import hashlib

    from tallyflow.functions.hashing import md5_first

    keys = ["", "a", "0:x", "é 日本", *("k" * n for n in range(40, 130)), "é" * 30, *(str(i) for i in range(5000))]
    want = [[int(hashlib.md5(p + k.encode()).hexdigest()[:8], 16) for k in keys] for p in (b"", b"0:", b"11:")]
    assert md5_first(keys, [b"", b"0:", b"11:"]).tolist() == want


def test_micro_batches_of_many_windows(emails, tmp_path):
    """Each window is scored on all before it, of its own micro-batch too; a micro-batch that runs twice changes nothing."""
    from tallyflow.streaming.prequential import StreamingModel

    c = models.Config("CM", 2, 6, 3)
    e = splits.windows(emails.where("body IS NOT NULL"), 4)
    want = {(r.doc_id, r.slot): r.score for r in models.score(e, [c]).collect()}
    model = StreamingModel(emails.sparkSession, c, f"file://{tmp_path}/m", "md5", compact=2)
    for b in (0, 1, 1, 2):
        model.process(e.where(F.floor(F.col("slot") / 5) == b).select("doc_id", "body", "spam", "slot"), b)
    assert {(r.doc_id, r.slot): r.score for r in model.windows().collect()} == pytest.approx(want, abs=2e-6)


def test_experiments_score_each_stream_once(emails, tmp_path, monkeypatch):
    """Threshold tuning and curves share the in-sample scores, sweep and calibration those of the stream."""
    from tallyflow.plans import experiments

    modes, score = [], models.score
    monkeypatch.setattr(models, "score", lambda e, configs, mode="prequential", *a, **b: modes.append(mode) or score(e, configs, mode, *a, **b))
    experiments.run(emails.where("body IS NOT NULL"), f"file://{tmp_path}/x", models.grid([1], [5], [2]), None, [20], "md5")
    assert sorted(modes) == ["folds", "in_sample", "prequential", "prequential", "prequential"]


def test_folds_and_in_sample_in_one_pass(emails, monkeypatch):
    """The emails' n-grams are taken twice for both scores (to count and to score), and both are as each alone."""
    monkeypatch.setattr(replay, "CHUNK", 7)
    e = splits.folds(emails)
    alone = _rows(models.score(e, CONFIGS, "folds")), _rows(models.score(e.withColumn("slot", F.lit(0).cast("long")), CONFIGS, "in_sample"))
    calls, parts = [], replay.parts
    monkeypatch.setattr(replay, "parts", lambda *a, **b: calls.append(1) or parts(*a, **b))
    both = models.score_folds_and_in_sample(e, CONFIGS)
    assert tuple(map(_rows, both)) == alone and len(calls) == 1
    monkeypatch.setattr(replay, "fits", lambda *_: False)
    assert [[r[:-1] for r in _rows(x)] for x in models.score_folds_and_in_sample(e, CONFIGS)] == [[r[:-1] for r in x] for x in alone]


def test_parameter_search_takes_two_scorings(spark, emails, monkeypatch):
    """Cross-validation and threshold tuning share one, the evaluation has its own."""
    from tallyflow.plans import queries

    calls, parts = [], replay.parts
    monkeypatch.setattr(replay, "parts", lambda *a, **b: calls.append(1) or parts(*a, **b))
    monkeypatch.setattr(queries, "emails", lambda *_: emails.where("body IS NOT NULL"))
    monkeypatch.setattr(queries, "GRID", models.grid([1], [5], [2]))
    assert queries.parameter_search(spark, "").count() == 12 and len(calls) == 2


@pytest.mark.parametrize("sizes, chunk, hash_mode", [([1, 4, 6], 1, "md5"), ([5, 20], 7, "xxhash"), ([3, 200], 1, "md5")])
def test_window_sizes_share_one_pass(emails, monkeypatch, sizes, chunk, hash_mode):
    """Every size as it is by itself, chunks that begin inside of windows too; the texts aren't dealt once for each."""
    want = {w: _rows(models.score(splits.windows(emails, w), CONFIGS, hash_mode=hash_mode)) for w in sizes}
    monkeypatch.setattr(replay, "CHUNK", chunk)
    monkeypatch.setattr(replay, "OPEN", 2)
    monkeypatch.setattr(replay, "parts", None)
    found = models.score_windows(replay.in_order(emails), CONFIGS, sizes, hash_mode)
    for w in sizes:
        rows = _rows(found[w])
        assert [r[:-1] for r in rows] == [r[:-1] for r in want[w]] and len(rows) == 60 * len(CONFIGS)
        assert all(a[-1] == pytest.approx(b[-1], abs=2e-6) for a, b in zip(rows, want[w]))


def test_learning_curves_deal_texts_once(emails, monkeypatch):
    few = [CONFIGS[0], CONFIGS[-1]]
    monkeypatch.setattr(replay, "parts", None)
    found = {tuple(r) for r in tuning.learning_curves(emails, few, [7, 20]).collect()}
    monkeypatch.undo()
    want = {(w, *r) for w in (7, 20) for r in map(tuple, tuning.cumulative(models.score(splits.windows(emails, w), few), tuning.KEYS).select(*tuning.KEYS, F.col("slot").alias("step"), "num_examples", *metrics.RATES).collect())}
    assert found == want


def test_window_sizes_over_gaps(emails):
    gaps = emails.where("seq % 10 <> 3")
    found = models.score_windows(replay.in_order(gaps), CONFIGS[:2], [10], "md5")[10]
    assert _rows(found) == _rows(models.score(splits.windows(gaps, 10), CONFIGS[:2]))


@pytest.mark.parametrize("name", ["config_report", "stream_curves", "calibration", "csv_round_trip", "sweep_mean_std", "best_config", "grid_search_f05", "pivot_sweep"])
def test_stream_queries_make_no_table_of_n_grams(spark, emails, monkeypatch, name):
    """What filled the disk: rows of n-grams times counters. Each query deals the texts once, and rows that meet are emails."""
    from tallyflow.plans import queries

    calls, parts = [], replay.parts
    monkeypatch.setattr(replay, "parts", lambda *a, **b: calls.append(1) or parts(*a, **b))
    monkeypatch.setattr(models, "occurrences", None)
    monkeypatch.setattr(queries, "emails", lambda *_: emails.where("body IS NOT NULL"))
    assert queries.QUERIES[name](spark, "").count() > 0 and len(calls) == 1
