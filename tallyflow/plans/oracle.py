"""DuckDB SQL of the registered queries, put together from the same few common table expressions.

`e` has the emails (doc_id, body, spam, seq); `scores` makes a table of scores of given configurations.
"""

from __future__ import annotations

from tallyflow.operators.models import Config
from tallyflow.plans.queries import CM, CORPORA, CURVE_SIZES, FH, FH2, GRID, MURMUR, WIDE_SIZES, WINDOW

_E = "e AS MATERIALIZED (SELECT d.doc_id, coalesce(d.text, '') AS body, l.toxic::BIGINT AS spam, row_number() OVER (ORDER BY d.doc_id) - 1 AS seq FROM documents d JOIN labels l ON d.doc_id = l.doc_id WHERE l.toxic IS NOT NULL)"
_ELS = "CASE WHEN body = '' THEN [] ELSE regexp_extract_all(substring(body, 1, length(body) - 1) || ' ', '[^ \n]*[ \n]') END"


def _cut(source: str = "e", columns: str = "doc_id, spam") -> str:
    return f"els AS MATERIALIZED (SELECT {columns}, {_ELS} AS els FROM {source})"


def _grams(n: int, columns: str = "doc_id, spam") -> str:
    """g: a row for each occurrence."""
    each = " UNION ALL ".join(f"SELECT {columns}, {k} AS k, substring(s, 1, length(s) - 1) AS ng FROM (SELECT {columns}, unnest(list_transform(range(1, len(els) - {k - 1} + 1), lambda i: array_to_string(els[i : i + {k - 1}], ''))) AS s FROM els WHERE len(els) >= {k})" for k in range(1, n + 1))
    return f"g AS MATERIALIZED ({each})"


def _hash(of: str) -> str:
    return f"('0x' || substr(md5({of}), 1, 8))::BIGINT"


def _occ(n: int) -> str:
    return f"{_cut()}, {_grams(n)}, occ AS MATERIALIZED (SELECT doc_id, spam, k, ng, count(*) AS tf FROM g GROUP BY ALL), words AS (SELECT doc_id, len(els)::BIGINT AS words FROM els)"


def _state(mode: str, keys: str) -> str:
    """What a model knows of a sum, given sums over keys and slot."""
    if mode == "prequential":
        return f"coalesce(sum({{0}}) OVER (PARTITION BY {keys} ORDER BY slot RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)"
    if mode == "folds":
        return f"sum({{0}}) OVER (PARTITION BY {keys}) - {{0}}"
    return "{0}"


def _one(c: Config, mode: str, name: str) -> str:
    """CTEs that end in {name}: classifier, ngram, log_buckets, num_hashes, doc_id, spam, slot, score; e has slot (and trains)."""
    size = 1 << c.log_buckets
    split = mode == "split"
    cells = f"SELECT doc_id, ng, tf, 0 AS i, {_hash('ng')} & {size - 1} AS bucket FROM occ WHERE k <= {c.ngram}" if c.classifier == "FH" else " UNION ALL ".join(f"SELECT doc_id, ng, tf, {i} AS i, {_hash(f"'{i}:' || ng")} & {size - 1} AS bucket FROM occ WHERE k <= {c.ngram}" for i in range(c.num_hashes))
    st, tot = _state(mode, "i, bucket"), _state(mode, "one")
    m = f"least({c.ngram}, words)"
    grams = f"({m} * words - ({m} * ({m} - 1)) // 2)"
    on = "" if split else " AND x.slot = u.slot"
    return f"""
{name}_u AS MATERIALIZED (SELECT c.*, e.spam, e.slot, e.trains FROM ({cells}) c JOIN e USING (doc_id)),
{name}_k AS (SELECT i, bucket, slot, sum(tf * spam) AS s, sum(tf * (1 - spam)) AS h FROM {name}_u WHERE trains GROUP BY ALL),
{name}_x AS MATERIALIZED (SELECT i, bucket, slot, {st.format('s')} AS s, {st.format('h')} AS h FROM {name}_k),
{name}_m AS (SELECT u.doc_id, u.ng, u.tf, min(coalesce(x.s, 0)) AS s, min(coalesce(x.h, 0)) AS h FROM {name}_u u LEFT JOIN {name}_x x ON x.i = u.i AND x.bucket = u.bucket{on} {"WHERE NOT u.trains" if split else ""} GROUP BY ALL),
{name}_l AS (SELECT doc_id, sum(tf * (ln(h + 1) - ln(s + 1))) AS ll FROM {name}_m GROUP BY doc_id),
{name}_d AS (SELECT e.doc_id, e.spam, e.slot, e.trains, {grams} AS grams FROM e JOIN words USING (doc_id)),
{name}_t AS (SELECT 1 AS one, slot, sum(spam) AS ns, sum(1 - spam) AS nh, sum(spam * grams) AS ts, sum((1 - spam) * grams) AS th FROM {name}_d WHERE trains GROUP BY slot),
{name}_o AS (SELECT slot, {tot.format('ns')} AS ns, {tot.format('nh')} AS nh, {tot.format('ts')} AS ts, {tot.format('th')} AS th FROM {name}_t),
{name} AS MATERIALIZED (SELECT '{c.classifier}' AS classifier, {c.ngram} AS ngram, {c.log_buckets} AS log_buckets, {c.num_hashes} AS num_hashes, d.doc_id, d.spam, d.slot,
  round(CASE WHEN ns + nh = 0 THEN 0.5 ELSE 1 / (1 + exp(greatest(-50, least(50, coalesce(ll, 0) + grams * (ln(ts + {size}) - ln(th + {size})) + ln(nh + 1) - ln(ns + 1))))) END, 6) AS score
  FROM {name}_d d JOIN {name}_o o ON {"NOT d.trains" if split else "d.slot = o.slot"} LEFT JOIN {name}_l l ON l.doc_id = d.doc_id)"""


_SLOT = {"prequential": "seq // {0}", "folds": "seq % 5", "in_sample": "0"}


def _emails(slot: str, trains: str = "true", base: str = _E, source: str = "e0") -> str:
    return f"{base.replace('e AS', 'e0 AS', 1)}, e AS MATERIALIZED (SELECT *, ({slot})::BIGINT AS slot, {trains} AS trains FROM {source})"


def scores(configs: list[Config], mode: str = "prequential", size: int = WINDOW, head: str | None = None) -> str:
    """WITH ... p AS (scores of all configurations); more can follow after a comma."""
    head = head or _emails(_SLOT[mode].format(size))
    parts = [_one(c, mode, f"c{i}") for i, c in enumerate(configs)]
    union = " UNION ALL ".join(f"SELECT * FROM c{i}" for i in range(len(configs)))
    return f"WITH {head}, {_occ(max(c.ngram for c in configs))}, {', '.join(parts)}, p AS MATERIALIZED ({union})"


_KEYS = "classifier, ngram, log_buckets, num_hashes"
_CONF = "count(*) FILTER (WHERE spam = 1 AND {0}) AS tp, count(*) FILTER (WHERE spam = 0 AND {0}) AS fp, count(*) FILTER (WHERE spam = 0 AND NOT ({0})) AS tn, count(*) FILTER (WHERE spam = 1 AND NOT ({0})) AS fn"
_P, _R = "(CASE WHEN tp + fp = 0 THEN 1 ELSE tp / (tp + fp) END)", "(CASE WHEN tp + fn = 0 THEN 1 ELSE tp / (tp + fn) END)"


def _fb(b: float) -> str:
    return f"(CASE WHEN tp = 0 THEN 0 ELSE {1 + b * b}::DOUBLE * {_P} * {_R} / ({b * b}::DOUBLE * {_P} + {_R}) END)"


_RATE = {
    "accuracy": "(CASE WHEN tp + fp + tn + fn = 0 THEN 0 ELSE (tp + tn) / (tp + fp + tn + fn) END)",
    "precision": _P,
    "recall": _R,
    "f1": _fb(1.0),
    "f05": _fb(0.5),
    "fpr": "(CASE WHEN fp + tn = 0 THEN 0 ELSE fp / (fp + tn) END)",
    "fnr": "(CASE WHEN tp + fn = 0 THEN 0 ELSE fn / (tp + fn) END)",
}


def _rates(names=tuple(_RATE), digits: int | None = 9, prefix: str = "") -> str:
    return ", ".join(f"{f'round({_RATE[n]}::DOUBLE, {digits})' if digits is not None else f'{_RATE[n]}::DOUBLE'} AS {prefix}{n}" for n in names)


def _roc(keys: str, preds: str = "p") -> str:
    """r: a point for each prediction."""
    part = f"PARTITION BY {keys} " if keys else ""
    return f"""r0 AS (SELECT *, row_number() OVER w AS rn, sum(spam) OVER w AS tp, sum(1 - spam) OVER w AS fp, sum(spam) OVER ({part}) AS positives, sum(1 - spam) OVER ({part}) AS negatives FROM {preds} WINDOW w AS ({part}ORDER BY score DESC, doc_id ROWS UNBOUNDED PRECEDING)),
r AS MATERIALIZED (SELECT *, tp / nullif(positives, 0) AS tpr, fp / nullif(negatives, 0) AS fpr, tp / (tp + fp) AS precision, (tp - spam) / nullif(positives, 0) AS bt, (fp - (1 - spam)) / nullif(negatives, 0) AS bf FROM r0)"""


def _cv(keys: str) -> str:
    """cv: metrics by keys, of r."""
    both = "max(positives) > 0 AND max(negatives) > 0"
    wrap = lambda x: f"CASE WHEN {both} THEN coalesce({x}, 0) ELSE 0 END"
    return f"""cv AS MATERIALIZED (SELECT {keys}, {wrap('sum((fpr - bf) * (tpr + bt) / 2)')}::DOUBLE AS auc, {wrap('coalesce(min(tpr) FILTER (WHERE fpr >= 0.01), max(tpr))')}::DOUBLE AS recall_at_fpr_001, {wrap('coalesce(min(tpr) FILTER (WHERE fpr >= 0.001), max(tpr))')}::DOUBLE AS recall_at_fpr_0001,
{wrap('max(tpr) FILTER (WHERE precision >= 0.99)')}::DOUBLE AS recall_at_prec_99, {wrap('max(tpr) FILTER (WHERE precision >= 0.95)')}::DOUBLE AS recall_at_prec_95, avg((score - spam) * (score - spam)) AS brier_score FROM r GROUP BY {keys})"""


_METRICS = ("recall_at_fpr_001", "recall_at_fpr_0001", "auc", "recall_at_prec_99", "recall_at_prec_95", "brier_score")


def _rounded(names, digits: int = 9) -> str:
    return ", ".join(f"round({n}, {digits}) AS {n}" for n in names)


def _best(source: str = "cv") -> str:
    """avg_cv, chosen."""
    each = " UNION ALL ".join(f"SELECT {_KEYS}, '{m}' AS optimized_for, round({'1 - ' if m == 'brier_score' else ''}{m}, 9) AS value FROM avg_cv" for m in _METRICS)
    return f"""avg_cv AS MATERIALIZED (SELECT {_KEYS}, {', '.join(f'avg({m}) AS {m}' for m in _METRICS)} FROM {source} GROUP BY {_KEYS}),
chosen AS MATERIALIZED (SELECT optimized_for, {_KEYS}, value FROM ({each}) QUALIFY row_number() OVER (PARTITION BY classifier, optimized_for ORDER BY value DESC, ngram, log_buckets, num_hashes) = 1)"""


_GRID80 = "t AS (SELECT (9 + i) / 100 AS threshold FROM range(1, 81) x(i))"


def _thresholds(keys: str = "", preds: str = "p") -> str:
    k = f"{keys}, " if keys else ""
    return f"{_GRID80}, tm AS MATERIALIZED (SELECT {k}threshold, {_CONF.format('score > threshold')} FROM {preds}, t GROUP BY {k}threshold)"


_STRAT = "strat AS MATERIALIZED (SELECT doc_id, body, spam, seq, CASE WHEN row_number() OVER (PARTITION BY spam ORDER BY seq) <= floor(0.8::DOUBLE * count(*) OVER (PARTITION BY spam)) THEN 'dev' ELSE 'test' END AS split FROM {0})"


def _part(split: str, slot: str, order: str = "doc_id") -> str:
    """e: one part of the split, its positions in the given order."""
    return f"{_E.replace('e AS', 'ee AS', 1)}, {_STRAT.format('ee')}, e0 AS (SELECT doc_id, body, spam, row_number() OVER (ORDER BY {order}) - 1 AS seq FROM strat WHERE split = '{split}'), e AS MATERIALIZED (SELECT *, ({slot})::BIGINT AS slot, true AS trains FROM e0)"


def _chosen(order: str = "doc_id") -> str:
    return f"{scores(GRID, 'folds', head=_part('dev', 'seq % 5', order))}, {_roc(f'{_KEYS}, slot')}, {_cv(f'{_KEYS}, slot')}, {_best()} SELECT * FROM chosen"


def _search(order: str = "doc_id") -> str:
    """The whole search as one statement: three rounds of scores, each inside its own scope."""
    part = lambda s, slot: _part(s, slot, order)
    chosen = _chosen(order)
    tuned = f"{scores(GRID, 'in_sample', head=part('dev', '0'))}, {_thresholds(_KEYS)}, tr AS (SELECT {_KEYS}, threshold, {_rates(digits=None)} FROM tm) SELECT * FROM tr QUALIFY row_number() OVER (PARTITION BY {_KEYS} ORDER BY round(f05, 9) DESC, threshold) = 1"
    test = f"{scores(GRID, 'prequential', 1, head=part('test', 'seq'))} SELECT * FROM p"
    names = ("precision", "recall", "f1", "f05", "accuracy")
    return f"""WITH ch AS MATERIALIZED ({chosen}), tu AS MATERIALIZED ({tuned}), te AS MATERIALIZED ({test}),
f AS MATERIALIZED (SELECT optimized_for, {', '.join(f'tu.{k.strip()}' for k in _KEYS.split(','))}, threshold, {', '.join(f'tu.{n} AS dev_{n}' for n in names)} FROM ch JOIN tu USING ({_KEYS})),
m AS (SELECT optimized_for, {_KEYS}, {_CONF.format('score > threshold')} FROM te JOIN f USING ({_KEYS}) GROUP BY optimized_for, {_KEYS}),
out AS (SELECT f.optimized_for, {', '.join(f'f.{k.strip()}' for k in _KEYS.split(','))}, round(f.threshold, 6) AS threshold, {', '.join(f'round(dev_{n}, 6) AS dev_{n}' for n in names)}, {_rates((*names, 'fpr', 'fnr'), 6, 'test_')} FROM f JOIN m USING (optimized_for, {_KEYS}))"""


_SWEEP = f"{scores(GRID, 'prequential', 1)}, sw0 AS (SELECT {_KEYS}, {_CONF.format('score > 0.5')} FROM p GROUP BY {_KEYS}), sw AS MATERIALIZED (SELECT {_KEYS}, {_rates(digits=None)} FROM sw0)"
_FH_PREQ, _FH_FOLDS, _FH_IN = scores([FH]), scores([FH], "folds"), scores([FH], "in_sample")
_CONFUSED = f"{_FH_PREQ}, cm AS (SELECT {_CONF.format('score > 0.5')} FROM p)"
_TOK = f"WITH {_E}, {_cut()}, tk AS (SELECT doc_id, list_transform(els, lambda x: substring(x, 1, length(x) - 1)) AS t FROM els)"
_LL = "least(1 - 1e-15::DOUBLE, greatest(1e-15::DOUBLE, score))"
_BRIER = f"avg((score - spam) * (score - spam)) AS b, avg(-(spam * ln({_LL}) + (1 - spam) * ln(1 - {_LL}))) AS l, avg(spam) AS r"
_BRIER_OUT = "round(b, 9) AS brier_score, round(1 - b / (r * (1 - r)), 9) AS brier_score_scaled, round(l, 9) AS log_loss"
_CELLS_CM = " UNION ALL ".join(f"SELECT ng, spam, tf, {i} AS i, {_hash(f"'{i}:' || ng")} & 4095 AS bucket FROM occ" for i in range(3))
_EST = f"""WITH {_E}, {_occ(1)}, ex AS MATERIALIZED (SELECT ng, sum(tf * spam)::BIGINT AS spam_true, sum(tf * (1 - spam))::BIGINT AS ham_true FROM occ GROUP BY ng), u AS MATERIALIZED ({_CELLS_CM}),
k AS (SELECT i, bucket, sum(tf * spam)::BIGINT AS s, sum(tf * (1 - spam))::BIGINT AS h FROM u GROUP BY ALL), d AS (SELECT DISTINCT ng, i, bucket FROM u),
est AS (SELECT ng, spam_true, ham_true, min(s) AS spam_est, min(h) AS ham_est FROM d JOIN k USING (i, bucket) JOIN ex USING (ng) GROUP BY ALL)"""
_SCORE_OUT = "SELECT doc_id, spam, slot, score FROM p"
_DIMS = " UNION ALL ".join(f"SELECT '{d}' AS dimension, classifier, {d}::BIGINT AS level, count(*) AS n, round(avg(accuracy), 9) AS mean_accuracy, round(stddev_samp(accuracy), 9) AS std_accuracy, round(avg(f05), 9) AS mean_f05, round(stddev_samp(f05), 9) AS std_f05 FROM sw GROUP BY classifier, {d}" for d in ("ngram", "log_buckets", "num_hashes"))
_ORDER = "CASE classifier WHEN 'FH' THEN 0 ELSE 1 END, ngram, log_buckets, num_hashes"
_CURVE_OF = {
    size: f"SELECT {size} AS \"window\", * FROM ({scores([FH, CM], size=size)}, a AS (SELECT {_KEYS}, slot, count(*) AS n, {_CONF.format('score > 0.5')} FROM p GROUP BY {_KEYS}, slot), b AS (SELECT {_KEYS}, slot AS step, sum(n) OVER w AS num_examples, sum(tp) OVER w AS tp, sum(fp) OVER w AS fp, sum(tn) OVER w AS tn, sum(fn) OVER w AS fn FROM a WINDOW w AS (PARTITION BY {_KEYS} ORDER BY slot)) SELECT {_KEYS}, step, num_examples::BIGINT AS num_examples, {_rates()} FROM b)"
    for size in (*CURVE_SIZES, *WIDE_SIZES)
}
_CURVES, _WIDE = (" UNION ALL ".join(_CURVE_OF[s] for s in sizes) for sizes in (CURVE_SIZES, WIDE_SIZES))
_THIN = "q AS (SELECT *, lead(spam) OVER ({0}ORDER BY rn) AS nx FROM r WHERE positives > 0 AND negatives > 0), cp AS (SELECT {1}rn, score AS threshold, tp::BIGINT AS tp, fp::BIGINT AS fp, (negatives - fp)::BIGINT AS tn, (positives - tp)::BIGINT AS fn FROM q WHERE rn = 1 OR nx IS NULL OR nx <> spam)"
_UNLABELLED = f"{_E.replace('e AS', 'l0 AS', 1)}, e AS MATERIALIZED (SELECT doc_id, body, spam, seq, 0::BIGINT AS slot, true AS trains FROM l0 UNION ALL SELECT doc_id, coalesce(text, ''), 0, -1, 0, false FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels))"
_WARM = f"{_E.replace('e AS', 'ee AS', 1)}, {_STRAT.format('ee')}, e AS MATERIALIZED (SELECT doc_id, body, spam, seq, 0::BIGINT AS slot, split = 'dev' AS trains FROM strat)"
_LINES = "lines AS MATERIALIZED (SELECT source, unnest(range(len(a))) AS line_no, unnest(a) AS line FROM (SELECT source, string_split(raw, chr(10)) AS a FROM files))"
#: mails: source, email_no, header, body of the lines of files.
_PARSED = f"""{_LINES},
cut AS (SELECT *, line = '' AS blank, starts_with(line, 'EMAIL> ') AS head, coalesce(sum((line = '')::INT) OVER (PARTITION BY source ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS seg FROM lines),
segs AS (SELECT source, seg, arg_max(line, line_no) FILTER (WHERE head) AS header, bool_or(blank) AS closed, coalesce(string_agg(line, '' ORDER BY line_no) FILTER (WHERE NOT blank AND NOT head), '') AS body FROM cut GROUP BY source, seg),
nums AS (SELECT *, closed AND header IS NOT NULL AS emits, coalesce(sum((closed AND header IS NOT NULL)::INT) OVER (PARTITION BY source ORDER BY seg ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS email_no FROM segs),
mails AS (SELECT source, email_no, max(header) FILTER (WHERE emits) AS header, string_agg(body, '' ORDER BY seg) AS body FROM nums GROUP BY source, email_no HAVING bool_or(emits))"""
_IS_SPAM = "(substr(header, 14, 1) = '1')::BIGINT"
_FILES = f"files AS (SELECT doc_id % {CORPORA} AS source, string_agg('EMAIL> label=' || spam || ' ' || doc_id || chr(10) || body || chr(10) || chr(10), '' ORDER BY doc_id) AS raw FROM e GROUP BY 1)"
_POINTS = f"ch AS MATERIALIZED ({_chosen()}), pt AS MATERIALIZED ({scores(GRID, 'in_sample', head=_part('dev', '0'))}, {_roc(_KEYS)}, {_THIN.format(f'PARTITION BY {_KEYS} ', f'{_KEYS}, ')} SELECT * FROM cp)"
_POINT = f"optimized_for, {_KEYS}, rn, threshold, tp, fp, tn, fn"
_SEED42 = "md5('42:' || doc_id), doc_id"

SQL: dict[str, str] = {
    "corpus_profile": f"WITH {_E} SELECT count(*) AS num_emails, sum(spam)::BIGINT AS num_spam, 100 * avg(spam) AS spam_percent FROM e",
    "shuffle_order": f"WITH {_E} SELECT doc_id, row_number() OVER (ORDER BY md5('12:' || doc_id), doc_id) - 1 AS seq FROM e",
    "tokenize": f"{_TOK} SELECT doc_id, len(t)::BIGINT AS num_words, len(list_filter(t, lambda x: x = ''))::BIGINT AS empty_words, t[1] AS first_word, t[-1] AS last_word, len(list_distinct(t))::BIGINT AS distinct_words FROM tk WHERE len(t) > 0",
    "ngram_length_stats": f"WITH src AS (SELECT doc_id, coalesce(text, '') AS body FROM documents), {_cut('src', 'doc_id')}, {_grams(3, 'doc_id')} SELECT k::BIGINT AS k, count(*) AS ngrams, count(DISTINCT ng) AS distinct_ngrams, sum(length(ng))::BIGINT AS chars FROM g GROUP BY k",
    "ngram_iter_size": f"WITH {_E}, {_cut()}, w AS (SELECT doc_id, len(els)::BIGINT AS m FROM els) SELECT doc_id, {', '.join(f'(SELECT coalesce(sum(m - k + 1), 0) FROM range(1, {n} + 1) x(k) WHERE k <= m)::BIGINT AS grams{n}' for n in (1, 2, 3))} FROM w",
    "nb_fh_train": f"WITH {_E}, {_occ(2)} SELECT {_hash('ng')} & {(1 << FH2.log_buckets) - 1} AS bucket, sum(tf * spam)::BIGINT AS spam_count, sum(tf * (1 - spam))::BIGINT AS ham_count FROM occ GROUP BY 1",
    "nb_cm_train": f"WITH {_E}, {_occ(1)}, u AS ({_CELLS_CM}) SELECT i::BIGINT AS hash_row, bucket, sum(tf * spam)::BIGINT AS spam_count, sum(tf * (1 - spam))::BIGINT AS ham_count FROM u GROUP BY ALL",
    "cm_point_estimate": f"{_EST} SELECT * FROM est",
    "cm_overestimate_check": f"{_EST} SELECT count(*) AS ngrams, count(*) FILTER (WHERE spam_est > spam_true) AS over_spam, count(*) FILTER (WHERE ham_est > ham_true) AS over_ham, count(*) FILTER (WHERE spam_est < spam_true OR ham_est < ham_true) AS under FROM est",
    "collision_rate": f"WITH {_E}, {_occ(1)}, x AS (SELECT {_hash('ng')} & 4095 AS bucket, count(*) AS n FROM (SELECT DISTINCT ng FROM occ) GROUP BY 1) SELECT sum(n)::BIGINT AS distinct_ngrams, count(*) AS used_buckets, sum(CASE WHEN n > 1 THEN n ELSE 0 END) / sum(n) AS collision_rate FROM x",
    "nb_fh_prequential": f"{scores([FH2])} {_SCORE_OUT}",
    "nb_cm_prequential": f"{scores([CM])} {_SCORE_OUT}",
    "nb_fh_window_one": f"{scores([FH], size=1)} {_SCORE_OUT}",
    "nb_fh_in_sample": f"{_FH_IN} {_SCORE_OUT}",
    "nb_cm_in_sample": f"{scores([CM], 'in_sample')} {_SCORE_OUT}",
    "nb_fh_folds": f"{_FH_FOLDS} {_SCORE_OUT}",
    "nb_warm_split": f"{scores([FH], 'split', head=_WARM)} {_SCORE_OUT}",
    "score_unlabelled": f"{scores([FH], 'split', head=_UNLABELLED)} SELECT doc_id, score FROM p",
    "classify": f"{_FH_PREQ} SELECT doc_id, spam, (score > 0.5)::BIGINT AS pred FROM p",
    "confusion": f"{_CONFUSED} SELECT *, {_rates()} FROM cm",
    "fbeta": f"{_CONFUSED} {' UNION ALL '.join(f'SELECT {b}::DOUBLE AS beta, round({_fb(b)}::DOUBLE, 9) AS fbeta FROM cm' for b in (0.5, 1.0, 2.0))}",
    "brier_logloss": f"{_FH_PREQ}, x AS (SELECT {_BRIER} FROM p) SELECT {_BRIER_OUT} FROM x",
    "stream_metrics": f"{_FH_PREQ}, a AS (SELECT slot, count(*) AS n, {_CONF.format('score > 0.5')} FROM p GROUP BY slot), b AS (SELECT slot, (sum(n) OVER w)::BIGINT AS num_examples, {', '.join(f'(sum({c}) OVER w)::BIGINT AS {c}' for c in ('tp', 'fp', 'tn', 'fn'))} FROM a WINDOW w AS (ORDER BY slot)) SELECT *, {_rates()} FROM b",
    "stream_roc": f"{scores([FH], size=100)}, st AS MATERIALIZED (SELECT s.slot AS step, p.doc_id, p.spam, p.score FROM p JOIN (SELECT DISTINCT slot FROM p) s ON p.slot <= s.slot), {_roc('step', 'st')}, {_cv('step')} SELECT step, {_rounded(_METRICS)} FROM cv",
    "stratified_split": f"WITH {_E}, {_STRAT.format('e')} SELECT doc_id, spam, split FROM strat",
    "split_profile": f"WITH {_E}, {_STRAT.format('e')} SELECT split, count(*) AS num_emails, sum(spam)::BIGINT AS num_spam, round(100 * avg(spam), 9) AS spam_percent FROM strat GROUP BY split",
    "kfold_assign": f"WITH {_E} SELECT doc_id, seq % 5 AS fold FROM e",
    "roc_points": f"{_FH_FOLDS}, {_roc('slot')} SELECT slot AS fold, doc_id, rn, tp::BIGINT AS tp, fp::BIGINT AS fp, {_rounded(('tpr', 'fpr', 'precision'))} FROM r",
    "roc_points_grouped": f"{_FH_PREQ}, a AS (SELECT score, sum(spam) AS s, sum(1 - spam) AS h FROM p GROUP BY score), b AS (SELECT score, row_number() OVER w AS rn, sum(s) OVER w AS tp, sum(h) OVER w AS fp, sum(s) OVER () AS np, sum(h) OVER () AS nn FROM a WINDOW w AS (ORDER BY score DESC)) SELECT score, rn, tp::BIGINT AS tp, fp::BIGINT AS fp, round(tp / nullif(np, 0), 9) AS tpr, round(fp / nullif(nn, 0), 9) AS fpr FROM b",
    "curve_points": f"{_FH_IN}, {_roc('')}, {_THIN.format('', '')} SELECT rn, threshold, tp, fp, tn, fn, {_rates(('precision', 'recall', 'f1', 'f05', 'fpr', 'accuracy'))} FROM cp",
    "threshold_sweep": f"{_FH_PREQ}, {_thresholds()} SELECT *, {_rates()} FROM tm",
    "best_threshold": f"{_FH_PREQ}, {_thresholds()} SELECT *, {_rates()} FROM tm QUALIFY row_number() OVER (ORDER BY round({_fb(0.5)}::DOUBLE, 9) DESC, threshold) = 1",
    "cv_metrics": f"{scores(GRID, 'folds')}, {_roc(f'{_KEYS}, slot')}, {_cv(f'{_KEYS}, slot')} SELECT {_KEYS}, slot AS fold, {_rounded(_METRICS)} FROM cv",
    "cv_average": f"{scores(GRID, 'folds')}, {_roc(f'{_KEYS}, slot')}, {_cv(f'{_KEYS}, slot')}, {_best()} SELECT {_KEYS}, {_rounded(_METRICS)} FROM avg_cv",
    "select_best": f"{scores(GRID, 'folds')}, {_roc(f'{_KEYS}, slot')}, {_cv(f'{_KEYS}, slot')}, {_best()} SELECT * FROM chosen",
    "parameter_search": f"{_search()} SELECT * FROM out",
    "dev_test_gap": f"{_search()} SELECT optimized_for, {_KEYS}, round(test_f05 - dev_f05, 6) AS gap, test_f05 - dev_f05 < -0.05 AS overfits FROM out",
    "learning_curves": _CURVES,
    "parameter_sweep": f"{_SWEEP} SELECT {_KEYS}, {_rounded(_RATE)} FROM sw",
    "pivot_sweep": f"{_SWEEP} SELECT classifier, ngram, round(avg(accuracy) FILTER (WHERE log_buckets = 10), 9) AS b10, round(avg(accuracy) FILTER (WHERE log_buckets = 12), 9) AS b12 FROM sw GROUP BY classifier, ngram",
    "sweep_mean_std": f"{_SWEEP} {_DIMS}",
    "best_config": f"{_SWEEP} SELECT 'best' AS kind, * FROM (SELECT {_KEYS}, round(accuracy, 9) AS accuracy FROM sw ORDER BY round(accuracy, 9) DESC, {_ORDER} LIMIT 1) UNION ALL SELECT 'worst', * FROM (SELECT {_KEYS}, round(accuracy, 9) AS accuracy FROM sw ORDER BY round(accuracy, 9), {_ORDER} LIMIT 1)",
    "grid_search_f05": f"{_SWEEP} SELECT {_KEYS}, {_rounded(_RATE)} FROM sw QUALIFY row_number() OVER (PARTITION BY classifier ORDER BY round(f05, 9) DESC, ngram, log_buckets, num_hashes) = 1",
    "config_report": f"{_SWEEP} SELECT CASE classifier WHEN 'FH' THEN 'FH n=' || ngram || ' b=2^' || log_buckets ELSE 'CM n=' || ngram || ' b=2^' || log_buckets || ' d=' || num_hashes END AS label, {_KEYS}, 1::BIGINT << log_buckets AS buckets, (1::BIGINT << log_buckets) * greatest(num_hashes, 1) AS dimension FROM sw WHERE num_hashes = 3 OR classifier = 'FH'",
    "calibration": f"{scores([FH, CM], size=1)}, x AS (SELECT {_KEYS}, {_BRIER} FROM p GROUP BY {_KEYS}) SELECT {_KEYS}, {_BRIER_OUT} FROM x",
    "curve_auc": f"{_FH_FOLDS}, {_roc('slot')}, {_THIN.format('PARTITION BY slot ', 'slot, ')}, z AS (SELECT slot, {_RATE['fpr']}::DOUBLE AS f, {_R}::DOUBLE AS t FROM cp), zz AS (SELECT slot, (f - lag(f, 1, 0) OVER w) * (t + lag(t, 1, 0) OVER w) / 2 AS s FROM z WINDOW w AS (PARTITION BY slot ORDER BY f, t)) SELECT slot AS fold, round(sum(s), 9) AS auc FROM zz GROUP BY slot",
    "space_usage": "SELECT CASE d WHEN 0 THEN 'FH' ELSE 'CM' END AS classifier, d AS num_hashes, b::INT AS log_buckets, (16::BIGINT << b::INT) * greatest(d, 1) AS bytes FROM range(8, 22) x(b), (VALUES (0), (2), (3), (4), (5)) y(d)",
    "streaming_prequential": f"{scores([CM], size=200)} {_SCORE_OUT}",
    "parsed_corpus": f"WITH {_E}, files AS (SELECT doc_id AS source, 'EMAIL> label=' || spam || ' doc' || chr(10) || body || chr(10) AS raw FROM e), {_PARSED} SELECT source AS doc_id, email_no::BIGINT AS email_no, length(body)::BIGINT AS body_chars, md5(body) AS body_md5, {_IS_SPAM} AS is_spam FROM mails",
    "corpus_load": f"WITH {_E}, {_FILES}, {_PARSED}, m AS (SELECT *, row_number() OVER (ORDER BY source, email_no) - 1 AS doc_id FROM mails) SELECT doc_id, header, md5(body) AS body_md5, {_IS_SPAM} AS spam, row_number() OVER (ORDER BY md5('12:' || doc_id), doc_id) - 1 AS seq FROM m",
    "baseline_precision": f"WITH {_E} SELECT round(avg(spam), 9) AS baseline_precision FROM e",
    "murmur_buckets": f"SELECT key, hash_row::BIGINT AS hash_row, bucket10::BIGINT AS bucket10, bucket20::BIGINT AS bucket20 FROM (VALUES {', '.join(map(str, MURMUR))}) t(key, hash_row, bucket10, bucket20)",
    "kept_classifier": f"{scores([FH], 'split', head=_WARM)} SELECT doc_id, score, (score > 0.5)::BIGINT AS pred, (SELECT count(*) FROM e WHERE trains) AS num_examples FROM p",
    "held_out_confusion": f"{scores([FH, CM], 'split', head=_WARM)}, cm AS (SELECT {_KEYS}, {_CONF.format('score > 0.5')} FROM p GROUP BY {_KEYS}) SELECT *, {_rates()} FROM cm",
    "shuffled_split": f"WITH {_E}, {_STRAT.format('e')} SELECT doc_id, split, row_number() OVER (PARTITION BY split ORDER BY {_SEED42}) - 1 AS seq FROM strat",
    "pr_curve": f"WITH {_POINTS} SELECT {_POINT}, {_rates(('precision', 'recall', 'f1', 'f05', 'accuracy'))} FROM ch JOIN pt USING ({_KEYS})",
    "roc_curve": f"WITH {_POINTS} SELECT {_POINT}, round({_R}::DOUBLE, 9) AS tpr, {_rates(('fpr', 'accuracy'))} FROM ch JOIN pt USING ({_KEYS})",
    "stream_curves": f"{scores(GRID, 'prequential', 1)}, {_roc(_KEYS)}, {_THIN.format(f'PARTITION BY {_KEYS} ', f'{_KEYS}, ')} SELECT {_KEYS}, rn, threshold, tp, fp, tn, fn, {_rates(('precision', 'recall', 'f1', 'f05', 'fpr', 'accuracy'))} FROM cp",
    "experiment_tables": f"{_search(_SEED42)} SELECT * FROM out",
    "learning_curves_wide": _WIDE,
    "learning_curve_slice": f"SELECT * FROM ({_CURVE_OF[CURVE_SIZES[-1]]}) WHERE classifier = 'FH'",
    "csv_round_trip": f"{_SWEEP} SELECT {_KEYS}, {_rounded(_RATE)} FROM sw",
}
