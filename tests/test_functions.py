import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyflow.functions import hashing, metrics, tokens


def model_tokens(body, n):
    """The documented rules, in plain Python."""
    if not body:
        return []
    ends, out = [i for i, c in enumerate(body[:-1]) if c in " \n"] + [len(body) - 1], []
    starts = [0] + [e + 1 for e in ends[:-1]]
    for k in range(1, min(n, len(starts)) + 1):
        out += [body[starts[i] : ends[i + k - 1]] for i in range(len(starts) - k + 1)]
    return out


CASES = {
    "": [],
    "a": [""],
    " ": [""],
    "a b": ["a", "", "a "],
    "a b ": ["a", "b", "a b"],
    "hello world": ["hello", "worl", "hello worl"],
    "a  b ": ["a", "", "b", "a ", " b", "a  b"],
    "x\ny z ": ["x", "y", "z", "x\ny", "y z", "x\ny z"],
}


def spark_ngrams(spark, bodies, n):
    df = spark.createDataFrame(list(enumerate(bodies)), "doc_id int, body string")
    got = {}
    for r in tokens.ngrams(df, n).collect():
        got.setdefault(r.doc_id, []).append(r.ng)
    return [sorted(got.get(i, [])) for i in range(len(bodies))]


def test_ngrams_of_documented_cases(spark):
    assert all(model_tokens(b, 3) == want for b, want in CASES.items())
    assert spark_ngrams(spark, list(CASES), 3) == [sorted(w) for w in CASES.values()]


def test_ngrams_of_random_bodies(spark):
    rnd = random.Random(4)
    bodies = ["".join(rnd.choices("ab \né\t", k=rnd.randint(0, 12))) for _ in range(300)]
    assert spark_ngrams(spark, bodies, 3) == [sorted(model_tokens(b, 3)) for b in bodies]


def test_ngram_totals(spark):
    df = spark.createDataFrame([(b,) for b in [*CASES, "a b c d e"]], "body string")
    rows = df.select("body", *(tokens.ngram_total(tokens.num_words(F.col("body")), n).alias(f"n{n}") for n in (1, 2, 3, 7))).collect()
    assert all(r[f"n{n}"] == len(model_tokens(r.body, n)) for r in rows for n in (1, 2, 3, 7))


def test_murmur_vectors():
    h1, h2 = hashing.murmur_halves([b"The quick brown fox jumps over the lazy dog", b"hello"], 0)
    assert [hex(x) for x in (int(h1[0]), int(h2[0]), int(h1[1]), int(h2[1]))] == ["0xe34bbc7bbc071b6c", "0x7a433ca9c49a9347", "0xcbd8a7b341bd9b02", "0x5b1e906a48ae1d19"]
    u = lambda key, seed: int(hashing.murmur([key], seed).view(np.uint64)[0])
    assert u(b"", hashing.FEATURE_SEED) == 0xF205A6566731BC38 and u(b"", 0) == 0
    assert u(b"a", hashing.FEATURE_SEED) == 0x19393A55CD5ED115 and u(b"a", hashing.row_seed(1)) == 0x5AE488BF303EBA9C
    assert u(b"click here now", hashing.FEATURE_SEED) == 0x4F8BC7B9B6307B3F
    assert u(b"the quick brown fox jumps over", hashing.row_seed(2)) == 0x18B3ECD108E7B4C2


def test_murmur_of_mixed_lengths_is_that_of_each():
    rnd = random.Random(5)
    keys = [bytes(rnd.randrange(256) for _ in range(n)) for n in [*range(40), 100, 1000, 5000]]
    assert [int(x) for x in hashing.murmur(keys, 7)] == [int(hashing.murmur([k], 7)[0]) for k in keys]


def test_row_seeds():
    assert [hashing.row_seed(i) for i in range(5)] == [0x0, 0x7F4A7C15, 0xFE94F82A, 0x7DDF743F, 0xFD29F054]


def test_hash_modes_agree_in_shape(spark):
    df = spark.createDataFrame([("free",), ("",)], "ng string")
    for mode in ("md5", "murmur", "xxhash"):
        rows = df.select(hashing.feature_hash(F.col("ng"), mode).alias("f"), hashing.sketch_hashes(F.col("ng"), 3, mode).alias("s")).collect()
        assert all(len(r.f) == 1 and len(r.s) == 3 for r in rows)


@pytest.mark.parametrize(
    "rows, want",
    [
        ([(0.9, 1), (0.2, 0)], dict(tp=1, fp=0, tn=1, fn=0, precision=1.0, recall=1.0, fpr=0.0, fnr=0.0, f05=1.0)),
        ([(0.1, 0)], dict(precision=1.0, recall=1.0, f1=0.0, fpr=0.0, accuracy=1.0)),
        ([(0.5, 1)], dict(tp=0, fn=1, recall=0.0, precision=1.0, fnr=1.0)),
        ([], dict(tp=0, accuracy=0.0, precision=1.0)),
    ],
)
def test_rates_at_the_edges(spark, rows, want):
    df = spark.createDataFrame(rows, "score double, spam long")
    got = metrics.rates(df.agg(*metrics.confusion(F.col("spam"), metrics.predicted(F.col("score"))))).first()
    assert {k: got[k] for k in want} == want


def test_calibration(spark):
    df = spark.createDataFrame([(0.9, 1), (0.8, 1), (0.705, 0), (0.6, 1), (0.4, 0), (0.2, 0)], "score double, spam long")
    r = df.agg(metrics.brier(F.col("score"), F.col("spam")).alias("b"), metrics.log_loss(F.col("score"), F.col("spam")).alias("l")).first()
    assert r.b == pytest.approx(0.151170833, abs=1e-9)
    assert r.l == pytest.approx(-sum(map(math.log, (0.9, 0.8, 0.295, 0.6, 0.6, 0.8))) / 6, abs=1e-12)
    s = spark.range(1).select(metrics.brier_skill(F.lit(r.b), F.lit(0.5)).alias("s"), metrics.brier_skill(F.lit(0.1), F.lit(1.0)).alias("one_class")).first()
    assert s.s == pytest.approx(0.395316667, abs=1e-9) and s.one_class is None
