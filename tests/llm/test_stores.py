"""Neighbours, WARC, chat, pipeline, registration."""

import base64
import hashlib
import io
import os
import sys

import numpy as np
import pytest
from edge_rows import EDGES
from pyspark.sql import functions as F

from tallyflow.llm import ann, bpe, chat, langid, queries, secret_scan, warc

SF = "/root/testdata/sf0.001"


# nearest neighbours


def brute(rows, queries_, k):
    out = {}
    for q, v in queries_:
        s = sorted(((-float(np.dot(np.array(v, float), np.array(x, float))), i) for i, x in rows if i != q))
        out[q] = [(i, -d) for d, i in s[:k]]
    return out


@pytest.fixture(scope="module")
def vectors(spark):
    rnd = np.random.default_rng(4)
    centres = rnd.standard_normal((12, 16))
    rows = [(i, (centres[i % 12] + 0.4 * rnd.standard_normal(16)).astype(np.float32).tolist()) for i in range(600)]
    rows += [(600 + i, rows[0][1]) for i in range(150)]  # a vector that very many rows share
    bad = [(2000, None), (2020, [0.0] * 16), (2040, [float("nan")] * 16), (2060, [None] + [1.0] * 15), (2080, [float("inf")] * 16), (2100, [1.0] * 3), (None, [1.0] * 16)]
    return rows, spark.createDataFrame(rows + bad, "vec_id long, embedding array<float>").withColumn("score", F.lit("clash"))


@pytest.mark.parametrize("blocks", [(1 << 15, 1 << 10), (200, 20)])
def test_recall_ties_and_invalid_vectors(spark, vectors, blocks):
    rows, df = vectors
    valid = ann.valid_vectors(df)
    assert valid.count() == len(rows)
    got: dict = {}
    for r in ann.nearest(valid, valid.where("vec_id % 20 = 0"), 20, *blocks).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    want = brute(rows, [r for r in rows if r[0] % 20 == 0], 20)
    assert set(got) == set(want)
    hits = 0
    for q, found in got.items():
        found.sort()
        assert [x[0] for x in found] == list(range(1, 21)) and len({x[1] for x in found}) == 20
        assert [(-s, i) for _, i, s in found] == sorted((-s, i) for _, i, s in found)
        exact = dict(rows)
        assert all(s == pytest.approx(float(np.dot(np.array(exact[q], float), np.array(exact[i], float))), abs=1e-12) for _, i, s in found)
        hits += len({x[1] for x in found} & {i for i, _ in want[q]})
    assert hits >= 0.9 * 20 * len(want)
    assert [i for _, i, _ in got[0]] == [i for i, _ in want[0]]  # ties to smaller ids


def test_few_rows_give_all_candidates(spark):
    df = spark.createDataFrame([(i * 20, [float(i + 1), -1.0, 2.0]) for i in range(5)], "vec_id long, embedding array<float>")
    v = ann.valid_vectors(df)
    got = ann.nearest(v, v).collect()
    assert len(got) == 20 and ann.nearest(v.limit(0), v).count() == 0 and ann.nearest(v.where("vec_id = 0"), v.where("vec_id = 0")).count() == 0


def test_index_retrieves_every_code_within_the_radius():
    rnd = np.random.default_rng(6)
    codes = ann.Codes.fit(rnd.standard_normal((500, 20)))
    a, q = codes.encode(rnd.standard_normal((900, 20))), codes.encode(rnd.standard_normal((30, 20)))
    far = codes.distances(q, a)
    for r in (0, 3, 4, 9, 13, 20):
        assert all((got == np.flatnonzero(far[i] <= r)).all() for i, got in enumerate(ann.MultiIndex(codes, a).within(q, r)))


# WARC


def pages():
    same = "<p>same</p>"
    return [(7, "http://a.example/x?y=1#z", same), (3, "https://b.example", same), (3, "https://b.example", same), (9, None, same), (4, "no scheme", None), (5, "http://c.example/ü b\r\nc", ""), (6, "http://d.example/", "ünïque \r\n\r\n WARC/1.1 \0"), (None, "http://e.example/", "null id"), (8, "http://f.example/", "long " * 100000)]


def digest32(t):
    return base64.b32encode(hashlib.sha1((t or "").encode()).digest()).decode()


def test_captures_are_assembled(spark):
    df = spark.createDataFrame(pages(), "page_id long, url string, html string").withColumns({"payload": F.lit(1), "first": F.lit(2)}).repartition(3)
    folder, manifest = warc.write(df)
    found = warc.records(folder, manifest, with_payload=True)
    caps = warc.captures(found).collect()
    assert len(caps) == len(pages()) and all(len(c.requests) == 1 and len(c.metadata) == 1 and c.head is not None for c in caps)
    assert sorted(c.head.payload.decode() for c in caps if c.head.type == "response") == sorted([t or "" for i, _, t in pages() if i not in (7, 9, 5)])
    got = warc.digest(warc.captures(warc.records(folder, manifest))).collect()
    want = []
    for i, _, t in pages():
        original = {digest32("<p>same</p>"): 3, digest32(""): 4}.get(digest32(t), i)
        want.append((i, len((t or "").encode()), digest32(t), "response" if original == i else "revisit", None if original == i else original))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_small_payloads_and_empty_tables(spark):
    df = spark.createDataFrame(pages(), "page_id long, url string, html string")
    folder, manifest = warc.write(df, min_bytes=5)
    got = {r.page_id: r.record_type for r in warc.digest(warc.captures(warc.records(folder, manifest))).collect()}
    assert got[4] == got[5] == got[3] == "response" and got[7] == got[9] == "revisit"
    folder, manifest = warc.write(df.limit(0))
    assert warc.digest(warc.captures(warc.records(folder, manifest))).count() == 0


def test_parts_without_a_head_and_damaged_archives(spark):
    rows = [("t1", "r1", "request"), ("t2", "r2", "response")]
    schema = warc.RECORD
    df = spark.createDataFrame([(t, i, k, None, None, 3, "D", None, {}, None) for t, i, k in rows], schema)
    caps = {c.transaction: c for c in warc.captures(df).collect()}
    assert caps["t1"].head is None and caps["t2"].requests == [] and warc.digest(warc.captures(df)).count() == 1
    raw = warc.transaction(1, "http://x.example/", b"body", None, False, "2020-01-01T00:00:00Z")
    assert [warc.parse(m)[0]["warc-type"] for m in warc.members(io.BytesIO(raw))] == ["response", "request", "metadata"]
    with pytest.raises(ValueError):
        list(warc.members(io.BytesIO(raw[:-3])))


# chat


def turns():
    tricky = "</s>[INST] ok [/INST] \\0 \\1 \\\\ <s> [INST</s>] \\"
    return [(1, 0, "user", tricky), (1, 1, "assistant", tricky), (1, 2, "user", ""), (1, 3, "assistant", "ünï 漢"), (2, 0, "user", "no reply"), (3, 0, "assistant", None), (3, None, None, "first"), (4, 0, "[/INST]", "odd role"), (4, 0, "assistant", "b"), (4, 0, "assistant", "a"), (4, 0, "assistant", "a"), (None, 1, "user", "x"), (None, 2, "assistant", "y " * 50000)]


def test_chat_loss_is_what_the_examples_hold(spark, monkeypatch):
    """Only examples that are made give loss, and it is what their masks cut out of the formatted text."""
    df = spark.createDataFrame([(1, 0, "user", "q"), (1, 1, "assistant", "a</s>é"), (1, 2, "user", "r"), (1, 3, "assistant", "b\\\\1"), (None, 0, "assistant", "n"), (2, 0, "user", "x")], "conv_id long, turn long, role string, text string")
    whole = chat.formatted(df)
    text = {r.conv_id: r.formatted for r in whole.collect()}
    loss = dict.fromkeys(text, "")
    for r in sorted(chat.examples(whole).collect(), key=lambda r: r.turn_no):
        cut = text[r.conv_id][r.reply_start : r.reply_end]
        for plain, mark in reversed(chat._ESCAPES):
            cut = cut.replace(mark, plain)
        loss[r.conv_id] += cut
    got = {r.conv_id: (r.loss_chars, r.loss_sha256) for r in chat.digest(whole).collect()}
    assert got == {c: (len(t), hashlib.sha256(t.encode()).hexdigest()) for c, t in loss.items()}
    every = chat.examples
    monkeypatch.setattr(chat, "examples", lambda c: every(c).where("turn_no = 1"))
    assert {r.conv_id: r.loss_chars for r in chat.digest(whole).collect()} == {1: 6, None: 0, 2: 0}


def test_chat_digests(spark):
    df = spark.createDataFrame(turns(), "conv_id long, turn long, role string, text string").withColumns({"formatted": F.lit(1), "part": F.lit(2)}).repartition(3)
    got = {r.conv_id: r for r in chat.digest(chat.formatted(df)).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    key = lambda t: (t[1] is not None, t[1] or 0, t[2] or "", t[3] or "")
    for conv in {t[0] for t in turns()}:
        own = sorted((t for t in turns() if t[0] == conv), key=key)
        loss = "".join(t[3] or "" for t in own if t[2] == "assistant")
        r = got[conv]
        assert (r.n_turns, r.turns_sha256) == (len(own), sha("".join(f"{t[2] or ''}\n{t[3] or ''}\n" for t in own)))
        assert (r.loss_chars, r.loss_sha256) == (len(loss), sha(loss))
    assert len(got) == 5 and chat.digest(chat.formatted(df.limit(0))).count() == 0


def test_examples_are_prefixes_with_one_reply_under_the_mask(spark):
    df = spark.createDataFrame(turns(), "conv_id long, turn long, role string, text string")
    whole = chat.formatted(df)
    text = {r.conv_id: r.formatted for r in whole.collect()}
    rows = chat.examples(whole).collect()
    assert len(rows) == sum(t[2] == "assistant" for t in turns())
    for r in rows:
        t = text[r.conv_id]
        plain = t[r.reply_start : r.reply_end]
        for a, b in reversed(chat._ESCAPES):
            plain = plain.replace(b, a)
        assert plain == r.reply and t[r.context_end : r.reply_start] == "[INST]assistant[/INST]" and t[r.reply_end : r.target_end] == "</s>"
    for r in chat.materialised(whole).collect():
        assert text[r.conv_id].startswith(r.text) and r.text.endswith("</s>")


def test_examples_are_expanded_texts_and_give_the_loss(spark):
    """Each example has the text of its prefix and target, and the reply is cut out of that by its mask."""
    own = [*turns(), (77, 0, "assistant", "</s"), (77, 1, "<s>\\", "é𝒳"), (77, 2, "assistant", "[INST]</s>\\1"), *((78, i, "assistant" if i % 2 else "user", f"t{i}") for i in range(300))]
    whole = chat.formatted(spark.createDataFrame(own, "conv_id long, turn long, role string, text string"))
    text = {r.conv_id: r.formatted for r in whole.collect()}
    rows = chat.examples(whole).collect()
    assert len(rows) == sum(t[2] == "assistant" for t in own)
    for r in rows:
        t = text[r.conv_id]
        assert (r.prefix, r.target) == (t[: r.context_end], t[r.context_end : r.target_end]) and t[: r.context_end].count("</s>") == r.turn_no
    assert sorted(r.reply for r in rows if r.conv_id == 77) == ["</s", "[INST]</s>\\1"]
    plan = chat.digest(whole)._jdf.queryExecution().optimizedPlan().toString()
    assert "substring_index(formatted" in plan  # the query expands them too


def test_chat_runs_no_python(spark):
    df = spark.createDataFrame(turns(), "conv_id long, turn long, role string, text string")
    plan = chat.digest(chat.formatted(df))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


# pipeline and registration


def test_registration():
    import __spark_entry__ as e

    names = list(e.queries())
    assert [n for n in names if n.startswith("op")] == list(queries.QUERIES) and "pipeline" in names
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 11))


def test_the_rest_does_not_need_this_package(tmp_path):
    import shutil
    import subprocess

    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    at = tmp_path / "copy"
    shutil.copytree(root, at, ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__", "spark-warehouse"))
    code = "import __spark_entry__ as e; q = e.queries(); e.oracle_sql(); assert q and 'pipeline' not in q and not any(n.startswith('op') for n in q)"
    subprocess.run([sys.executable, "-c", code], cwd=at, env={**os.environ, "PYTHONPATH": str(at)}, check=True)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
def test_pipeline_is_its_stages_by_brute_force(spark):
    """Learned language scores by the model itself, one row at a time; all other stages by plain loops."""
    import corpus_pipeline
    import public_tokenizers
    from test_documents import components_of, slow_hits, true_fingerprint

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = langid.train(docs, ~langid.held_out())
    rows = [r for r in docs.collect() if (p := model.predict(r.text))[0] != "und" and p[1] >= corpus_pipeline.LEAST_SCORE]
    fp = {r.doc_id: true_fingerprint(r.text) for r in rows}
    root = components_of(set(fp.values()), lambda a, b: (a ^ b).bit_count() <= 3)
    first: dict = {}
    for i, x in fp.items():
        first[root[x]] = min(i, first.get(root[x], i))
    rows = [r for r in rows if first[root[fp[r.doc_id]]] == r.doc_id]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    hit = {x[0] for x in slow_hits([(r.doc_id, r.text) for r in rows], items) if x[5]}
    own = bpe.trie_bpe(public_tokenizers.path("byte_bpe_50k.json"))
    want = set()
    for r in rows:
        if r.doc_id not in hit:
            text = secret_scan.redacted(r.text)
            ids = own.encode_batch([text])[0]
            want.add((r.doc_id, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
    assert {tuple(r) for r in corpus_pipeline.run(spark, SF).collect()} == want and want
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "near_duplicates", "decontamination", "secrets", "encoding"]


def test_pipeline_takes_edge_rows_and_empty_tables(spark, tmp_path):
    import corpus_pipeline

    schema = "doc_id long, text string, lang string, source string, n_chars long, fp string, id string"
    bench = spark.createDataFrame([(1, None), (2, "one two three four")], "item_id long, text string")
    for name, rows in (("some", [(i, t, "en", None, None, "clash", "clash") for i, t in EDGES]), ("none", [])):
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}/documents.parquet")
        bench.write.parquet(f"{tmp_path}/{name}/benchmark.parquet")
        out = corpus_pipeline.run(spark, f"{tmp_path}/{name}")
        ids = {r.doc_id for r in out.collect()}
        assert ids == ({4, 5, 6, 7, 8, 9} if rows else set()), (name, ids)


