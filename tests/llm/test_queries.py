"""Every query over a whole small table, against SQL, a library or brute force."""

import hashlib
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest

from catadrift.llm import queries, tokens

SMALL, MEDIUM = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
QUERIES, SQL = queries.queries(), queries.oracle_sql()


def documents(folder):
    return duckdb.sql(f"SELECT doc_id, coalesce(text, '') FROM '{folder}/documents.parquet' ORDER BY doc_id").fetchall()


def run(spark, name, folder=SMALL):
    return QUERIES[name](spark, folder).collect()


def test_there_is_one_of_each():
    assert [int(re.match(r"op(\d+)_", n)[1]) for n in QUERIES] == list(range(1, len(QUERIES) + 1))


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, name):
    df = QUERIES[name](spark, SMALL)
    con = duckdb.connect()
    for table in ("documents", "pages", "benchmark"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SMALL}/{table}.parquet'")
    columns = sorted(df.columns)
    want = con.sql(f"SELECT {', '.join(columns)} FROM ({SQL[name]})").fetchall()
    assert Counter(map(tuple, df.select(*columns).collect())) == Counter(want)


def test_neighbours(spark):
    rows = duckdb.sql(f"SELECT vec_id, embedding FROM '{SMALL}/embeddings.parquet'").fetchall()
    ids, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], dtype=float)
    found: dict = {}
    for r in sorted(run(spark, "op2_hilbert_neighbours"), key=lambda r: (r.query_id, r.rank)):
        found.setdefault(r.query_id, []).append(r)
    hits = total = 0
    assert set(found) == {int(i) for i in ids if i % 20 == 0}
    for q, got in found.items():
        score = x @ x[ids == q][0]
        order = [int(ids[i]) for i in np.lexsort((ids, -score)) if ids[i] != q][:20]
        assert [r.rank for r in got] == list(range(1, 21))
        assert np.allclose([r.score for r in got], [score[ids == r.vec_id][0] for r in got], rtol=0, atol=1e-12)
        hits, total = hits + len(set(order) & {r.vec_id for r in got}), total + 20
    assert hits >= 0.9 * total


def test_repeats(spark):
    seen, want = set(), set()
    for doc, text in documents(SMALL):
        body, gone = text.encode(), np.zeros(len(text.encode()), bool)
        for p in range(len(body) - 99):
            window = body[p : p + 100]
            if window in seen:
                gone[p : p + 100] = True
            seen.add(window)
        spans = int((np.diff(np.r_[False, gone].astype(int)) == 1).sum())
        kept = np.frombuffer(body, np.uint8)[~gone].tobytes()
        want.add((doc, len(body), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    assert {tuple(r) for r in run(spark, "op3_suffix_repeats")} == want


def test_tokens(spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokens.default_path())
    library.no_truncation()
    library.no_padding()
    want = set()
    for doc, text in documents(SMALL):
        ids = library.encode(text, add_special_tokens=False).ids
        back = library.decode(ids, skip_special_tokens=False)
        want.add((doc, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(back.encode()).hexdigest()))
    got = run(spark, "op7_bpe_tokens")
    assert {(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got} == want


def test_tokens_are_made_and_read_back_in_one_python_worker(spark):
    rows = [(1, "a", "It's  the\n<|endoftext|> x"), (2, "b", None), (3, None, ""), (None, "c", "\u00e9\u4e2d \U0001f600"), (1, "a", "It's  the\n<|endoftext|> x")]
    docs, path = spark.createDataFrame(rows, "doc_id long, lang string, text string"), tokens.default_path()
    plan = tokens.tokenised(docs, path)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1
    both, apart = tokens.round_trip(docs, path), tokens.decode(tokens.encode(docs, path), path).drop("text")
    assert both.schema == apart.schema
    assert sorted(map(repr, both.collect())) == sorted(map(repr, apart.collect()))


def test_secrets(spark):
    assign = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
    want = {}
    for doc, text in documents(MEDIUM):
        kinds = [
            [m.span() for m in assign.finditer(text) if len(m[2]) >= 8],
            [m.span() for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16],
            [m.span() for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32],
        ]
        spans = sorted((a, k, b) for k, found in enumerate(kinds) for a, b in found)
        told = ",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in spans)
        want[doc] = (*map(len, kinds), hashlib.sha256(told.encode()).hexdigest(), told)
    got = {r.doc_id: r for r in run(spark, "op10_secret_scan", MEDIUM)}
    assert {d: (r.n_assign, r.n_access, r.n_hex, r.base_sha256) for d, r in got.items()} == {d: w[:4] for d, w in want.items()}
    assert sum(w[0] + w[1] + w[2] for w in want.values()) > 20
    for doc, r in got.items():
        assert set(filter(None, want[doc][4].split(","))) <= set(r.spans.split(","))


def test_languages_on_held_out_documents(spark):
    truth = dict(duckdb.sql(f"SELECT doc_id, lang FROM '{MEDIUM}/documents.parquet'").fetchall())
    rows = run(spark, "op6_crf_languages", MEDIUM)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out and truth[r.doc_id]]
    assert len(held) > 150 and np.mean([truth[r.doc_id] == r.lang_pred for r in held]) > 0.95


def test_toxicity_on_held_out_documents(spark):
    truth = dict(duckdb.sql(f"SELECT doc_id, toxic FROM '{MEDIUM}/labels.parquet'").fetchall())
    rows = run(spark, "op8_toxicity", MEDIUM)
    assert len(rows) == 1000 and all(r.predicted == (r.score >= 0.5) and 0 <= r.score <= 1 for r in rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    held = [r for r in rows if r.held_out and r.doc_id in truth]
    assert np.mean([truth[r.doc_id] == r.predicted for r in held]) > 0.9
    toxic, clean = ([r.score for r in held if truth[r.doc_id] == y] for y in (1, 0))
    assert np.mean([a > b for a in toxic for b in clean]) > 0.85
