"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Features: character 1- to 3-grams of the lower-cased whole text, hashed to FEATURES slots; 1 + ln(count), times the inverse document
frequency, scaled to length 1. Document frequencies are counted over all labelled training texts. Weights are trained by
follow-the-regularised-leader (proximal, a learning rate for each coordinate) with elastic-net penalties, on at most SAMPLE texts of
each language; then one temperature is fitted on at most CALIBRATION other training texts of each. Both samples are those whose hashes,
of id and text, are smallest. L1 is as large as held-out accuracy stays what it is without: most weights are zero. Training runs on the driver, over the bounded sample; counting and predicting are narrow maps.

The model sent to the workers has FEATURES x languages weights, which doesn't grow with the documents.

Defined results: a text of any length is read whole; a null text, or one without a letter, is `und` with score 0, and is not learned from; an empty training set makes every
text `und`; rows with a null label are not learned from; equal scores go to the language that sorts first; repeated documents each get
a row; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyflow.llm.common import crc_mod_col, map_text

FEATURES = 1 << 14
SAMPLE, CALIBRATION, EPOCHS = 600, 200, 4
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.3, 1e-3
UNKNOWN = "und"
_LETTER = regex.compile(r"\p{L}")
_MULS = tuple(np.uint32(m) for m in (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D))


def ngram_counts(text: str | None) -> tuple[np.ndarray, np.ndarray] | None:
    """Slots and counts of a text's n-grams; None if it has no letter."""
    if not text or not _LETTER.search(text):
        return None
    c = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)
    count, h = np.zeros(FEATURES, np.int64), np.zeros(len(c), np.uint32)
    for n, mul in enumerate(_MULS):
        if len(c) <= n:
            break
        h = (h[: len(c) - n] ^ c[n:]) * mul
        count += np.bincount((h ^ (h >> np.uint32(15))) & np.uint32(FEATURES - 1), minlength=FEATURES)
        h = h + np.uint32(n + 1)
    at = np.flatnonzero(count)
    return at, count[at]


@dataclass
class Model:
    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0

    def vector(self, at: np.ndarray, count: np.ndarray) -> np.ndarray:
        x = (1 + np.log(count)) * self.idf[at]
        return x / max(np.sqrt(x @ x), 1e-12)

    def logits(self, at: np.ndarray, count: np.ndarray) -> np.ndarray:
        return self.vector(at, count) @ self.weights[at] + self.bias

    def predict(self, text: str | None) -> tuple[str, float]:
        found = ngram_counts(text) if self.languages else None
        if found is None:
            return UNKNOWN, 0.0
        p = softmax(self.logits(*found) / self.temperature)
        best = int(p.argmax())
        return self.languages[best], float(p[best])


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max())
    return e / e.sum()


class Ftrl:
    """Follow-the-regularised-leader for multinomial logistic regression; slot FEATURES is the bias and has no penalty."""

    def __init__(self, n: int):
        self.z, self.n = np.zeros((FEATURES + 1, n)), np.zeros((FEATURES + 1, n))

    def weights(self, at: np.ndarray | slice) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        l1 = np.where(np.arange(FEATURES + 1)[at] == FEATURES, 0.0, L1)[:, None]
        return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((BETA + np.sqrt(n)) / ALPHA + L2))

    def learn(self, at: np.ndarray, x: np.ndarray, label: int) -> None:
        at, x = np.append(at, FEATURES), np.append(x, 1.0)
        w = self.weights(at)
        p = softmax(x @ w)
        p[label] -= 1
        g = x[:, None] * p
        root = np.sqrt(self.n[at])
        self.n[at] += g * g
        self.z[at] += g - (np.sqrt(self.n[at]) - root) / ALPHA * w


def fit_temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """The temperature of least negative log likelihood, by golden section over its logarithm.

    Each label keeps one part in rows + 2 for the other classes: rows without an error would otherwise ask for temperature 0."""
    smooth = 1 / (len(labels) + 2)

    def loss(t: float) -> float:
        z = logits / np.exp(t)
        z = z - z.max(axis=1, keepdims=True)
        own = z[np.arange(len(z)), labels]
        rest = (z.sum(axis=1) - own) / max(z.shape[1] - 1, 1)
        return float((np.log(np.exp(z).sum(axis=1)) - (1 - smooth) * own - smooth * rest).mean())

    lo, hi, gold = -4.0, 3.0, (5**0.5 - 1) / 2
    for _ in range(40):
        a, b = hi - gold * (hi - lo), lo + gold * (hi - lo)
        lo, hi = (lo, b) if loss(a) < loss(b) else (a, hi)
    return float(np.exp((lo + hi) / 2))


def _features(columns: list[str], text_col: str):
    def part(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [ngram_counts(t) or ([], []) for t in batch.column(text_col).to_pylist()]
        own = [batch.column(c) for c in columns]
        return pa.RecordBatch.from_arrays([*own, pa.array([a for a, _ in found], pa.list_(pa.int32())), pa.array([c for _, c in found], pa.list_(pa.int32()))], [*columns, "at", "count"])

    return part


def _document_frequencies(text_col: str):
    def run(batches):
        n, df = 0, np.zeros(FEATURES, np.int64)
        for batch in batches:
            for text in batch.column(text_col):
                if (found := ngram_counts(text.as_py())) is not None:
                    n += 1
                    df[found[0]] += 1
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1), pa.int32()), pa.array(np.append(df[at], n), pa.int64())], ["slot", "n"])

    return run


def train(docs: DataFrame, is_training: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """The model of the labelled rows for which is_training holds."""
    labelled = docs.where(is_training & F.col(lang_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    counts = labelled.select(F.col("text").cast("string").alias("text")).mapInArrow(_document_frequencies("text"), "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n")).collect()
    df = np.zeros(FEATURES + 1)
    for r in counts:
        df[r["slot"]] = r["n"]
    idf = np.log((1 + df[-1]) / (1 + df[:-1])) + 1
    sizes = {r["lang"]: r["count"] for r in labelled.groupBy("lang").count().collect()}
    languages = sorted(sizes)
    if not languages:
        return Model([], idf, np.zeros((FEATURES, 0)), np.zeros(0))
    # a bounded sample of each language: by hash below a share, then the smallest hashes
    want, scale = SAMPLE + CALIBRATION, 1 << 30
    h = F.pmod(F.xxhash64("id", "text", F.lit(11)), F.lit(scale))
    share = F.coalesce(*(F.when(F.col("lang") == lang, F.lit(min(scale, int(scale * (want + 8 * want**0.5) / n) + 1))) for lang, n in sizes.items()))
    first = F.row_number().over(Window.partitionBy("lang").orderBy("h", "id", F.xxhash64("text")))  # cut down in each task before rows meet

    def sampled(some: DataFrame) -> dict[str, list]:
        """Features of at most `want` rows a language."""
        few = some.where(F.col("text").rlike(r"\p{L}")).withColumn("rank", first).where(F.col("rank") <= want)
        taken = map_text(few.select("lang", "rank", "text"), partial(_features, ["lang", "rank"], "text"), "lang string, rank int, at array<int>, count array<int>", "text")
        out: dict[str, list] = {lang: [] for lang in languages}
        for r in sorted(taken.where(F.size("at") > 0).collect(), key=lambda r: r["rank"]):
            out[r["lang"]].append((np.array(r["at"]), np.array(r["count"])))
        return out

    rows = sampled(labelled.withColumn("h", h).where(F.col("h") < share))
    # where few distinct rows are repeated very often, a share may hold too little of them
    if short := [lang for lang, n in sizes.items() if len(rows[lang]) < min(want, n) // 2]:
        rows |= {lang: x for lang, x in sampled(labelled.where(F.col("lang").isin(short)).withColumn("h", h)).items() if lang in short}
    ftrl, model = Ftrl(len(languages)), Model(languages, idf, np.zeros((FEATURES, len(languages))), np.zeros(len(languages)))
    # a language of few texts keeps one in four for the temperature
    held = {lang: min(CALIBRATION, len(x) // 4) for lang, x in rows.items()}
    fit = [(i, at, model.vector(at, c)) for i, lang in enumerate(languages) for at, c in rows[lang][held[lang] :]]
    rng = np.random.default_rng(5)
    for _ in range(EPOCHS):
        for i in rng.permutation(len(fit)):
            label, at, x = fit[i]
            ftrl.learn(at, x, label)
    w = ftrl.weights(slice(None))
    model.weights, model.bias = w[:-1].astype(np.float32), w[-1]
    rest = [(i, model.logits(at, c)) for i, lang in enumerate(languages) for at, c in rows[lang][: held[lang]]]
    if rest:
        model.temperature = fit_temperature(np.array([z for _, z in rest]), np.array([i for i, _ in rest]))
    return model


def _predict(model: Model, columns: list[str], text_col: str):
    def part(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [model.predict(t) for t in batch.column(text_col).to_pylist()]
        return pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.float64())], [*columns, "lang_pred", "score"])

    return part


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score of each document."""
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return map_text(docs, partial(_predict, model, ["doc_id"], "text"), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double", "text")


def held_out(id_col: str = "doc_id") -> Column:
    return crc_mod_col(id_col, 4) == 2


#: How far a score must be from chance, as a share of the way to certainty, for a text to count as placed.
MARGIN = 0.2


def least_score(model: Model, least: float) -> float:
    """`least`, or what MARGIN asks for if that is more: with few languages the best of them has a high score by chance alone."""
    chance = 1 / max(len(model.languages), 1)
    return max(least, chance + MARGIN * (1 - chance))


def accepted(docs: DataFrame, model: Model, least: float, text_col: str = "text") -> DataFrame:
    """The rows whose language is known with a score of at least `least` (see `least_score`); all columns stay."""
    least = least_score(model, least)

    def make() -> Callable[[pa.RecordBatch], pa.RecordBatch]:
        def part(batch: pa.RecordBatch) -> pa.RecordBatch:
            keep = [lang != UNKNOWN and score >= least for lang, score in map(model.predict, batch.column(text_col).to_pylist())]
            return batch.filter(pa.array(keep, pa.bool_()))

        return part

    return map_text(docs, make, docs.schema, text_col)
