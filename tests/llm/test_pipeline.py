"""Each stage of the pipeline on its own input, and the registry without the corpus operators."""

import hashlib
import os
import shutil
import subprocess
import sys
from pathlib import Path

import duckdb
import numpy as np

import corpus_pipeline
from catadrift.llm import leaks, lines, similar, tokens, toxicity
from catadrift.llm.languages import fold

SMALL = "/root/testdata/sf0.001"
ROOT = Path(__file__).resolve().parent.parent.parent


def oracle(folder, sql):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/*.parquet'")
    con.execute(f"CREATE VIEW benchmark AS SELECT * FROM '{SMALL}/benchmark.parquet'")
    return con.sql(sql).fetchall()


def test_stages_against_sql_and_brute_force(spark, tmp_path):
    from tokenizers import Tokenizer

    docs, before = spark.read.parquet(f"{SMALL}/documents.parquet"), None
    columns = docs.columns
    for number, (name, stage) in enumerate(corpus_pipeline.STAGES):
        path = str(tmp_path / str(number))
        stage(spark, docs, SMALL).write.parquet(path)
        after = spark.read.parquet(path)
        rows = {r[0]: tuple(r) for r in after.collect()}
        if name == "toxicity":
            score = toxicity.scored(docs, spark.read.parquet(f"{SMALL}/labels.parquet"), lambda k: fold(k, 5) != 0)
            assert rows == {r.doc_id: tuple(r)[:-1] for r in score.collect() if r.score < 0.5}
        elif name == "line dedup":
            kept = {d: s for d, _, _, s in oracle(before, f"SELECT doc_id, n_lines, n_dropped, kept_sha256 FROM ({lines.ORACLE})")}
            assert {d: hashlib.sha256((r[1] or "").encode()).hexdigest() for d, r in rows.items()} == kept
            assert all(r[4] == len(r[1]) for r in rows.values())
        elif name == "n-gram Jaccard join":
            assert set(rows) == {c for _, _, c in oracle(before, f"SELECT doc_id, n_shingles, component_id FROM ({similar.ORACLE})")}
        elif name == "benchmark decontamination":
            assert set(rows) == {d for d, hit in oracle(before, f"SELECT doc_id, contaminated FROM ({leaks.ORACLE})") if not hit}
        else:
            library = Tokenizer.from_file(tokens.default_path())
            library.no_truncation()
            texts = {r.doc_id: r.text or "" for r in docs.collect()}
            assert set(rows) == set(texts)
            for r in after.collect():
                assert np.frombuffer(r.ids, "<u4").tolist() == library.encode(texts[r.doc_id], add_special_tokens=False).ids
        if number + 1 < len(corpus_pipeline.STAGES):
            assert after.columns == columns
        docs, before = after, path


def test_the_rest_works_without_the_corpus_operators(tmp_path):
    copy = tmp_path / "repo"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", ".tmp", "llm", "corpus_pipeline.py", "spark-warehouse", "__pycache__"))
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 50 and 'pipeline' not in q; assert set(q) == set(e.oracle_sql())"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    subprocess.run([sys.executable, "-c", code], cwd=copy, env=env, check=True, timeout=120)
