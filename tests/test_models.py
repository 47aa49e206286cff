import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tallyflow.functions import hashing
from tallyflow.operators import models, running, splits
from tallyflow.operators.models import Config
from test_functions import model_tokens

STREAM = [("win money now ", 1), ("meeting at noon ", 0), ("win a free prize now ", 1), ("lunch meeting now ", 0)]


def emails(spark, rows):
    return spark.createDataFrame([(i, b, s, i) for i, (b, s) in enumerate(rows)], "doc_id long, body string, spam long, seq long")


@pytest.mark.parametrize(
    "config, size, want",
    [
        (Config("FH", 1, 10), 1, [0.5, 0.664713553, 0.8, 0.689195314]),
        (Config("FH", 2, 10), 1, [0.5, 0.661232734, 0.8, 0.68295572]),
        (Config("FH", 3, 4), 1, [0.5, 0.542080015, 0.923076923, 0.05217381]),
        (Config("CM", 1, 10, 3), 1, [0.5, 0.664713553, 0.8, 0.689195314]),
        (Config("CM", 2, 4, 2), 1, [0.5, 0.339276195, 0.666666667, 0.274393529]),
        (Config("FH", 1, 10), 2, [0.5, 0.5, 0.8, 0.5]),
    ],
)
def test_prequential_scores_of_a_small_stream(spark, config, size, want):
    got = models.score(splits.windows(emails(spark, STREAM), size), [config], hash_mode="murmur", digits=9).orderBy("seq").collect()
    assert [r.score for r in got] == pytest.approx(want, abs=1e-9)


def sequential(rows, config, size):
    """Test-then-train, one email after the other, with hash tables."""
    d, size_b = max(1, config.num_hashes), 1 << config.log_buckets
    seeds = [hashing.row_seed(i) for i in range(d)] if config.num_hashes else [hashing.FEATURE_SEED]
    spam, ham, n, t = [Counter() for _ in range(d)], [Counter() for _ in range(d)], [0, 0], [0, 0]
    cells = lambda g: [int(hashing.murmur([g.encode()], s)[0]) & (size_b - 1) for s in seeds]
    out = []
    for start in range(0, len(rows), size):
        window = rows[start : start + size]
        for body, _ in window:
            if not sum(n):
                out.append(0.5)
                continue
            x = math.log(n[0] + 1) - math.log(n[1] + 1)
            for g in model_tokens(body, config.ngram):
                c = cells(g)
                x += math.log((min(h[b] for h, b in zip(ham, c)) + 1) / (t[0] + size_b)) - math.log((min(s[b] for s, b in zip(spam, c)) + 1) / (t[1] + size_b))
            out.append(1 / (1 + math.exp(max(-50, min(50, x)))))
        for body, label in window:
            n[label] += 1
            for g in model_tokens(body, config.ngram):
                t[label] += 1
                for table, b in zip(spam if label else ham, cells(g)):
                    table[b] += 1
    return out


@pytest.mark.parametrize("size", [1, 7])
@pytest.mark.parametrize("config", [Config("FH", 2, 6), Config("CM", 2, 5, 2)])
def test_window_function_is_the_sequential_loop(spark, config, size):
    rows = [(" ".join(f"w{(i * j) % 11}" for j in range(i % 6)), (i * 7) % 3 % 2) for i in range(40)]
    got = models.score(splits.windows(emails(spark, rows), size), [config], hash_mode="murmur", digits=None).orderBy("seq").collect()
    assert [r.score for r in got] == pytest.approx(sequential(rows, config, size), abs=1e-9)


def test_segments_do_not_change_running_sums(spark):
    df = spark.range(200).select((F.col("id") % 3).alias("k"), F.col("id").alias("slot"), (F.col("id") * 7 % 5).alias("v"))
    a = running.before_slot(df, ["k"], "slot", ["v"], slots=200, segment=1000).collect()
    b = running.before_slot(df, ["k"], "slot", ["v"], segment=9).select("k", "slot", "v").collect()
    assert sorted(a) == sorted(b)


def test_sequence_follows_the_order(spark):
    df = spark.createDataFrame([(i * 37 % 101,) for i in range(101)], "doc_id long").repartition(5)
    assert all(r.doc_id == r.seq for r in running.with_sequence(df, "doc_id").collect())


def test_grid_is_scored_as_its_parts(spark):
    e = splits.windows(emails(spark, STREAM * 5), 3)
    grid = models.grid([1, 2], [4, 6], [2, 3])
    whole = {tuple(r[:5]): r.score for r in models.score(e, grid).select(*models.CONFIG, "doc_id", "score").collect()}
    assert len(whole) == len(grid) * 20
    for c in grid:
        for r in models.score(e, [c]).select(*models.CONFIG, "doc_id", "score").collect():
            assert whole[tuple(r[:5])] == r.score


def test_one_window_scores_all_half(spark):
    assert {r.score for r in models.score(splits.windows(emails(spark, STREAM), 100), [Config("CM", 1, 8, 2)]).collect()} == {0.5}


def test_empty_bodies_stay_and_empty_tables_work(spark):
    got = models.score(splits.windows(emails(spark, [("", 1), ("", 0), ("a b ", 1)]), 1), [Config("FH", 1, 4)]).orderBy("seq").collect()
    assert len(got) == 3 and got[1].score == pytest.approx(2 / 3, abs=1e-6)
    assert models.score(splits.windows(emails(spark, []), 1), [Config("FH", 1, 4)]).count() == 0


def test_sketch_never_underestimates(spark):
    r = models.cm_estimates(emails(spark, STREAM * 3), 2, 3, 2).collect()
    assert r and all(x.spam_est >= x.spam_true and x.ham_est >= x.ham_true for x in r)


def test_stratified_split_is_disjoint_and_whole(spark):
    e = emails(spark, [("x ", i % 4 == 0 and 1 or 0) for i in range(43)])
    s = splits.stratified(e)
    n = {(r.spam, r.split): r["count"] for r in s.groupBy("spam", "split").count().collect()}
    assert n[1, "dev"] == math.floor(0.8 * 11) and n[0, "dev"] == math.floor(0.8 * 32) and sum(n.values()) == 43
    assert s.where("split = 'dev'").select("doc_id").intersect(s.where("split = 'test'").select("doc_id")).count() == 0
    assert max(r.seq for r in s.where("split = 'dev' AND spam = 1").collect()) < min(r.seq for r in s.where("split = 'test' AND spam = 1").collect())


def test_timing_has_a_row_for_each_configuration(spark):
    from tallyflow.operators import tuning

    rows = tuning.timing(emails(spark, STREAM), [Config("FH", 1, 4), Config("CM", 1, 4, 2)]).collect()
    assert [r.classifier for r in rows] == ["FH", "CM"] and all(r.total_time_s > 0 and r.time_per_email_ms == pytest.approx(250 * r.total_time_s) for r in rows)
