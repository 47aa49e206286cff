"""Two-class Naive Bayes over bounded counters, as joins and aggregations.

Counters are additive, so the model that scores an email is a sum of counters over slots: all smaller slots (test-then-train
windows), all other slots (cross-validation folds), its own slot too (in-sample), or a training subset. The loop of the sequential form
is one aggregation to (row, bucket, slot), one running total of those, and one join back on the same key. A frequent bucket has at most
one row a slot there, and the join's key includes the slot, so no key gathers all documents.

Feature hashing ("FH") has one counter a bucket and class; a Count-Min sketch ("CM") has num_hashes of them and takes the least, for
each class apart. Sketches of fewer rows are prefixes of those of more: one pass serves every depth. An n-gram is hashed once and
masked to each number of buckets.

Where all counters fit in a worker (`replay.fits`), `score` has them there and deals out texts instead of n-grams: `replay`.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import groupby

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyflow.functions import hashing, tokens
from tallyflow.operators import replay, splits
from tallyflow.operators.running import before_slot, dealt

MODES = ("prequential", "folds", "in_sample", "split")
#: Counters (about 60 bytes each) that are sent to all executors.
BROADCAST_ROWS = 1 << 20
CONFIG = ("classifier", "ngram", "log_buckets", "num_hashes")


@dataclass(frozen=True)
class Config:
    """num_hashes is 0 for feature hashing."""

    classifier: str
    ngram: int
    log_buckets: int
    num_hashes: int = 0
    threshold: float = 0.5

    @property
    def counter_bytes(self) -> int:
        """Of both classes' counters, at 4 bytes each."""
        return 2 * max(1, self.num_hashes) * (1 << self.log_buckets) * 4


def grid(ngrams: list[int], log_buckets: list[int], num_hashes: list[int]) -> list[Config]:
    """All feature-hashing configurations, then all sketches."""
    fh = [Config("FH", n, b) for n in ngrams for b in log_buckets]
    return fh + [Config("CM", n, b, d) for n in ngrams for b in log_buckets for d in num_hashes]


def occurrences(emails: DataFrame, n: int, configs: list[Config], hash_mode: str = "md5") -> DataFrame:
    """doc_id, spam, slot, trains, k, ng, tf, fh, cm: each n-gram of an email once, with the hashes that the configurations need.

    Bodies are dealt out by doc_id: they are smaller than their n-grams, which then are counted where they are made. If feature hashing
    alone is wanted, n-grams count by their hashes and ng is absent (an Arrow hash is taken of distinct n-grams all the same)."""
    keep = ("doc_id", "spam", "slot", "trains")
    rows = tokens.ngrams(dealt(emails.select(*keep, "body")), n, keep=keep)
    depth = max((c.num_hashes for c in configs), default=0)
    if configs and not depth and hash_mode != "murmur":
        return rows.groupBy(*keep, "k", hashing.feature_hash(F.col("ng"), hash_mode)[0].alias("fh")).agg(F.count("*").alias("tf"))
    tf = rows.groupBy(*keep, "k", "ng").agg(F.count("*").alias("tf"))
    if any(c.classifier == "FH" for c in configs):
        tf = tf.withColumn("fh", hashing.feature_hash(F.col("ng"), hash_mode)[0])
    return tf.withColumn("cm", hashing.sketch_hashes(F.col("ng"), depth, hash_mode)) if depth else tf


def _tables(configs: list[Config], classifier: str) -> list[tuple[int, int, list[int]]]:
    """(ngram, log_buckets, depths) that share counters."""
    own = sorted({(c.ngram, c.log_buckets, c.num_hashes) for c in configs if c.classifier == classifier})
    return [(n, b, [d for *_, d in g]) for (n, b), g in groupby(own, key=lambda x: x[:2])]


def _known(c: Column, default: int) -> Column:
    """c without nulls. Catalyst then has no null check to push into one use of a plan alone, and both uses share its exchanges."""
    return F.coalesce(c, F.lit(default).cast("long"))


def units(occ: DataFrame, configs: list[Config], classifier: str) -> DataFrame:
    """The counters that emails touch: t (number of the shared table), doc_id, spam, slot, trains, ng, i, bucket, tf.

    Feature hashing sums an email's n-grams of a bucket first (ng is null); a sketch needs each n-gram's own rows."""
    tables = _tables(configs, classifier)
    base = ["doc_id", "spam", "slot", "trains"]
    if classifier == "FH":
        wide = F.explode(F.array(*(F.struct(F.lit(t).alias("t"), F.lit(n).alias("n"), _known(hashing.bucket(F.col("fh"), b), 0).alias("bucket")) for t, (n, b, _) in enumerate(tables))))
        rows = occ.select(*base, "k", "tf", wide.alias("x")).where("k <= x.n")
        return rows.groupBy(F.col("x.t").alias("t"), *base, F.lit(0).alias("i"), F.col("x.bucket").alias("bucket")).agg(F.sum("tf").alias("tf")).withColumn("ng", F.lit(None).cast("string"))
    cells = [F.struct(F.lit(t).alias("t"), F.lit(n).alias("n"), F.lit(i).alias("i"), _known(hashing.bucket(F.col("cm")[i], b), 0).alias("bucket")) for t, (n, b, ds) in enumerate(tables) for i in range(max(ds))]
    rows = occ.select(*base, "k", "tf", "ng", F.explode(F.array(*cells)).alias("x")).where("k <= x.n")
    return rows.select("x.t", *base, "ng", "x.i", "x.bucket", "tf")


def counters(cells: DataFrame) -> DataFrame:
    """t, i, bucket, slot, s, h: occurrences in spam and ham."""
    return cells.where("trains").groupBy("t", "i", "bucket", "slot").agg(F.sum(F.col("tf") * F.col("spam")).alias("s"), F.sum(F.col("tf") * (1 - F.col("spam"))).alias("h"))


def _states(sums: DataFrame, keys: list[str], values: list[str], mode: str, slots: int | None) -> DataFrame:
    """Sums by keys and slot, turned into what a model knows when it scores that slot."""
    if mode == "prequential":
        return before_slot(sums, keys, "slot", values, slots)
    if mode == "folds":
        every = Window.partitionBy(*keys)
        return sums.withColumns({v: F.sum(v).over(every) - F.col(v) for v in values})
    if mode == "in_sample":
        return sums
    raise ValueError(mode)


def sized(df: DataFrame, most: int) -> DataFrame:
    """df, which has at most `most` rows, for a join: sent to all if those are few, else dealt out by the join's key."""
    return F.broadcast(df) if most <= BROADCAST_ROWS else df.hint("merge")


def _lookups(cells: DataFrame, mode: str, slots: int, buckets: int) -> DataFrame:
    """cells with the counters s, h that their emails see; buckets: how many all tables have."""
    sums = counters(cells)
    keys = ["t", "i", "bucket"]
    if mode == "split":
        state = sums.groupBy(*keys).agg(F.sum("s").alias("s"), F.sum("h").alias("h"))
        found = cells.where(~F.col("trains")).join(sized(state, buckets), keys, "left")
    else:
        found = cells.join(sized(_states(sums, keys, ["s", "h"], mode, slots), buckets * slots), [*keys, "slot"], "left")
    return found.withColumns({c: F.coalesce(c, F.lit(0)).cast("long") for c in ("s", "h")})


def log_ratio(tf: Column, s: Column, h: Column) -> Column:
    return tf * (F.ln(h + 1) - F.ln(s + 1))


def likelihoods(occ: DataFrame, configs: list[Config], mode: str, slots: int) -> DataFrame:
    """classifier, ngram, log_buckets, num_hashes, doc_id, ll: sum of tf (ln(h + 1) - ln(s + 1)); emails without n-grams are absent."""
    parts = []
    for classifier in ("FH", "CM"):
        tables = _tables(configs, classifier)
        if not tables:
            continue
        buckets = sum(max(1, *ds) << b for _, b, ds in tables)
        found = _lookups(units(occ, configs, classifier), mode, slots, buckets)
        if classifier == "FH":
            sums = found.groupBy("t", "doc_id").agg(F.sum(log_ratio(F.col("tf"), F.col("s"), F.col("h"))).alias("ll0"))
            depths = [0]
        else:
            depths = sorted({d for *_, ds in tables for d in ds})
            least = found.groupBy("t", "doc_id", "ng", "tf").agg(*(F.min(F.when(F.col("i") < d, F.col(c))).alias(f"{c}{d}") for d in depths for c in "sh"))
            sums = least.groupBy("t", "doc_id").agg(*(F.sum(log_ratio(F.col("tf"), F.col(f"s{d}"), F.col(f"h{d}"))).alias(f"ll{d}") for d in depths))
        wanted = [(t, n, b, d) for t, (n, b, ds) in enumerate(tables) for d in ds]
        each = F.explode(F.filter(F.array(*(F.struct(F.lit(t).alias("t"), F.lit(n).alias("ngram"), F.lit(b).alias("log_buckets"), F.lit(d).alias("num_hashes"), F.col(f"ll{d}").alias("ll")) for t, n, b, d in wanted)), lambda x: x["t"] == F.col("t")))
        parts.append(sums.select("t", "doc_id", each.alias("x")).select(F.lit(classifier).alias("classifier"), "x.ngram", "x.log_buckets", "x.num_hashes", "doc_id", "x.ll"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def totals(emails: DataFrame, ngrams: list[int], mode: str, slots: int | None) -> DataFrame:
    """ngram, slot, ns, nh, ts, th: emails and n-grams of each class that a model knows when it scores the slot."""
    sizes = F.explode(F.array(*(F.struct(F.lit(n).alias("ngram"), tokens.ngram_total(F.col("words"), n).alias("grams")) for n in ngrams)))
    rows = emails.select("spam", "slot", "trains", sizes.alias("x")).select("spam", "slot", "trains", "x.ngram", "x.grams")
    one = lambda spam, what, name: F.sum(F.when(F.col("trains") & (F.col("spam") == spam), what).otherwise(0)).cast("long").alias(name)
    sums = rows.groupBy("ngram", *([] if mode == "split" else ["slot"])).agg(one(1, F.lit(1), "ns"), one(0, F.lit(1), "nh"), one(1, F.col("grams"), "ts"), one(0, F.col("grams"), "th"))
    return sums if mode == "split" else _states(sums, ["ngram"], ["ns", "nh", "ts", "th"], mode, slots)


def posterior(ll: Column, grams: Column, log_buckets: Column, ns: Column, nh: Column, ts: Column, th: Column) -> Column:
    """Spam score from the counters' log ratio: add-one smoothing by the number of buckets, log ratio clamped to 50 either way."""
    size = F.pow(F.lit(2.0), log_buckets)
    x = ll + grams * (F.ln(ts + size) - F.ln(th + size)) + F.ln(nh + 1) - F.ln(ns + 1)
    return F.when(ns + nh == 0, F.lit(0.5)).otherwise(1 / (1 + F.exp(F.greatest(F.lit(-50.0), F.least(F.lit(50.0), x)))))


def replayed_scores(rows: DataFrame, layout: replay.Layout, digits: int | None = 6, layer: int = 0) -> DataFrame:
    """`score`'s columns from those of `replay.parts`."""
    configs, first = layout.configs, layer * len(layout.totals)
    at = {n: first + 1 + i for i, n in enumerate(layout.ngrams)}
    known = lambda n: (F.get("s", F.lit(first)).alias("ns"), F.get("h", F.lit(first)).alias("nh"), F.get("s", F.lit(at[n])).alias("ts"), F.get("h", F.lit(at[n])).alias("th"))
    each = F.explode(F.array(*(F.struct(*(F.lit(getattr(c, a)).alias(a) for a in CONFIG), F.get("ll", F.lit(layer * len(configs) + i)).alias("ll"), tokens.ngram_total(F.col("words"), c.ngram).alias("grams"), *known(c.ngram)) for i, c in enumerate(configs))))
    own = ["doc_id", "seq", "spam", "slot"]
    one = rows.select(*own, each.alias("x")).select(*own, "x.*")
    s = posterior(*(F.col(c) for c in ("ll", "grams", "log_buckets", "ns", "nh", "ts", "th")))
    return one.select(*CONFIG, *own, (F.round(s, digits) if digits is not None else s).alias("score"))


def score(emails: DataFrame, configs: list[Config], mode: str = "prequential", slots: int | None = None, hash_mode: str = "md5", digits: int | None = 6, occ: DataFrame | None = None, stored: bool = False) -> DataFrame:
    """classifier, ngram, log_buckets, num_hashes, doc_id, seq, spam, slot, score of every email (mode "split": of those that don't train).

    emails: doc_id, seq, body, spam (0 or 1), slot; optional boolean trains. Emails without n-grams are scored by the prior; a null slot
    comes before all others. `slots` is how many there can be (found if not given): few need no segments of running totals, and with the
    numbers of buckets it bounds the counters, which are broadcast only up to BROADCAST_ROWS rows. `stored`: emails come from
    `replay.in_order`."""
    if "trains" not in emails.columns:
        emails = emails.withColumn("trains", F.lit(True))
    emails = emails.withColumn("slot", _known(F.col("slot"), -1))
    if occ is None and replay.fits(configs, hash_mode):
        layout = replay.Layout(configs)
        return replayed_scores(replay.parts(emails, layout, mode, hash_mode, stored=stored), layout, digits)
    if slots is None:
        slots = 1 if mode == "split" else (emails.agg(F.max("slot")).first()[0] or 0) + 2
    emails = emails.withColumn("words", tokens.num_words(F.col("body")))
    if occ is None:
        occ = occurrences(emails, max(c.ngram for c in configs), configs, hash_mode)
    else:
        occ = occ.withColumn("slot", _known(F.col("slot"), -1))
    ll = likelihoods(occ, configs, mode, slots)
    known = totals(emails, sorted({c.ngram for c in configs}), mode, slots)
    each = F.explode(F.array(*(F.struct(*(F.lit(getattr(c, a)).alias(a) for a in CONFIG)) for c in configs)))
    docs = emails.where(~F.col("trains")) if mode == "split" else emails
    docs = docs.select("doc_id", "seq", "spam", "slot", "words", each.alias("c")).select("c.*", "doc_id", "seq", "spam", "slot", "words")
    ngrams = len({c.ngram for c in configs})
    both = docs.join(ll.hint("merge"), [*CONFIG, "doc_id"], "left").join(sized(known, ngrams * slots), ["ngram"] if mode == "split" else ["ngram", "slot"], "left")
    count = lambda c: F.coalesce(c, F.lit(0))
    grams = F.coalesce(*(F.when(F.col("ngram") == n, tokens.ngram_total(F.col("words"), n)) for n in sorted({c.ngram for c in configs})))
    s = posterior(F.coalesce("ll", F.lit(0.0)), grams, F.col("log_buckets"), count("ns"), count("nh"), count("ts"), count("th"))
    return both.select(*CONFIG, "doc_id", "seq", "spam", "slot", (F.round(s, digits) if digits is not None else s).alias("score"))


def score_folds_and_in_sample(emails: DataFrame, configs: list[Config], hash_mode: str = "md5", digits: int | None = 6) -> tuple[DataFrame, DataFrame]:
    """What `score` gives in modes "folds" and "in_sample" (there slot is 0). Both read the same counters: where these fit in a worker, the
    emails are counted once and their n-grams are taken once for both scores."""
    if not replay.fits(configs, hash_mode):
        return score(emails, configs, "folds", hash_mode=hash_mode, digits=digits), score(emails.withColumn("slot", F.lit(0).cast("long")), configs, "in_sample", hash_mode=hash_mode, digits=digits)
    if "trains" not in emails.columns:
        emails = emails.withColumn("trains", F.lit(True))
    layout = replay.Layout(configs)
    rows = replay.parts(emails.withColumn("slot", _known(F.col("slot"), -1)), layout, "folds", hash_mode, whole=True)
    return replayed_scores(rows, layout, digits), replayed_scores(rows.withColumn("slot", F.lit(0).cast("long")), layout, digits, 1)


def score_windows(stream: DataFrame, configs: list[Config], sizes: list[int], hash_mode: str = "md5", digits: int | None = 6) -> dict[int, DataFrame]:
    """What `score` gives test-then-train for each window size. stream comes from `replay.in_order`, and counters fit in a worker. Each
    size's windows begin at multiples of it; n-grams are taken once for all sizes."""
    layout = replay.Layout(configs)
    rows = replay.windowed(stream, layout, sizes, hash_mode)
    if rows is None:
        return {w: score(splits.windows(stream, w), configs, hash_mode=hash_mode, digits=digits, stored=True) for w in sizes}
    return {w: replayed_scores(rows.withColumn("slot", F.floor(F.col("seq") / w).cast("long")), layout, digits, i) for i, w in enumerate(sizes)}


def cm_estimates(emails: DataFrame, n: int, log_buckets: int, depth: int, hash_mode: str = "md5") -> DataFrame:
    """ng, spam_true, ham_true, spam_est, ham_est of each distinct n-gram after all emails."""
    c = [Config("CM", n, log_buckets, depth)]
    emails = emails.withColumn("trains", F.lit(True)).withColumn("slot", F.lit(0))
    exact = occurrences(emails, n, [], hash_mode).groupBy("ng").agg(F.sum(F.col("tf") * F.col("spam")).alias("spam_true"), F.sum(F.col("tf") * (1 - F.col("spam"))).alias("ham_true"))
    hashed = exact.withColumn("cm", hashing.sketch_hashes(F.col("ng"), depth, hash_mode))
    cells = hashed.select("ng", "spam_true", "ham_true", F.posexplode("cm").alias("i", "h")).select("ng", "spam_true", "ham_true", "i", hashing.bucket(F.col("h"), c[0].log_buckets).alias("bucket"))
    sums = cells.groupBy("i", "bucket").agg(F.sum("spam_true").alias("s"), F.sum("ham_true").alias("h"))
    return cells.join(sums, ["i", "bucket"]).groupBy("ng", "spam_true", "ham_true").agg(F.min("s").alias("spam_est"), F.min("h").alias("ham_est"))
