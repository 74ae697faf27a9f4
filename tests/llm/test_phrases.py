"""Collocations against brute force: nulls, case, separators, ties, parts of longer phrases, hot documents."""

import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from catadrift.llm import phrases
from catadrift.llm.texts import flat

DOCS = "doc_id long, text string, lang string, n int, phrase string, block int"


def pieces(text):
    folded = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return [w for p in re.split(r"[.,;:!?\x0A-\x0D]", folded) if (w := re.findall(r"[^\x20\x09]+", p))]


def brute_counts(rows, longest=3):
    f, total = defaultdict(Counter), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for p in pieces(text):
            total[lang] += len(p)
            for k in range(1, longest + 1):
                f[lang].update(tuple(p[i : i + k]) for i in range(len(p) - k + 1))
    return f, total


def brute(rows, support=10, longest=3, top=2000, kept=50):
    f, total = brute_counts(rows, longest)
    out = []
    for lang, found in f.items():
        many = {p: a for p, a in found.items() if len(p) > 1 and a >= support}
        scored = []
        for p, a in many.items():
            score, _, l, r = min((1_000_000 * a * a // (found[p[:k]] * found[p[k:]]), k, found[p[:k]], found[p[k:]]) for k in range(1, len(p)))
            inside = [b for q, b in many.items() if len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))]
            if not any(100 * b >= kept * a for b in inside):
                scored.append((-score, -a, " ".join(p).encode(), l, r))
        for rank, (s, a, p, l, r) in enumerate(sorted(scored)[:top], 1):
            out.append((lang, rank, p.decode(), -a, l, r, total[lang], -s))
    return sorted(out)


def frame(spark, rows):
    return spark.createDataFrame([(i, t, lang, 1, "x", 2) for i, (t, lang) in enumerate(rows)], DOCS)


def run(spark, rows, support=10, longest=3, top=2000, kept=50):
    counts = phrases.phrase_counts(frame(spark, rows), support, longest)
    return sorted(map(tuple, phrases.collocations(counts.cache(), top, kept).collect()))


def random_rows(seed, n=120, words="the of big big small New york Straße Straße x co-op '' é \U0001f642".split()):
    r = np.random.default_rng(seed)
    ends = [" ", " ", " ", " ", "\t", "  ", ". ", ",", "\n", "\r\n", "\v", " ", "!?"]
    rows = [("".join(str(x) + str(r.choice(ends)) for x in r.choice(words, size=r.integers(0, 40))), [None, "en", "de", ""][r.integers(0, 4)]) for _ in range(n)]
    return [*rows, (None, "en"), ("", "fr"), (" \t\n.", "fr"), ("alone", "es")]


def test_words_and_pieces():
    texts = ["A b\tc. d  e\nf", None, "", "g", "h", ",", "i j", "\x0bk\x00l m"]
    data, offsets = flat(pa.array(texts))
    start, end, doc, together = phrases.words(data, offsets)
    found = defaultdict(list)
    for i, (a, b, d) in enumerate(zip(start, end, doc, strict=True)):
        if i and together[i - 1]:
            found[int(d)][-1].append(data[a:b].tobytes().decode().lower())
        else:
            found[int(d)].append([data[a:b].tobytes().decode().lower()])
    assert [found[i] for i in range(len(texts))] == [pieces(t) for t in texts]


@pytest.mark.parametrize("shards", [1, 4, 7])
def test_counts_equal_brute_force(spark, shards):
    rows = random_rows(shards)
    got = phrases.phrase_counts(frame(spark, rows), support=5, shards=shards).collect()
    f, total = brute_counts(rows)
    want = {(lang, " ".join(p)): n for lang, found in f.items() for p, n in found.items() if n >= 5}
    assert {(r.lang, r.phrase): r.n for r in got if r["size"]} == want
    assert {r.lang: r.n for r in got if not r["size"]} == dict(total)


def test_collocations_equal_brute_force(spark):
    rows = random_rows(11)
    assert run(spark, rows) == brute(rows)
    assert run(spark, rows, support=3, longest=4, top=7, kept=80) == brute(rows, 3, 4, 7, 80)


def test_one_document_is_a_third_of_all_rows(spark):
    rows = [("to be or not to be", "en")] * 300 + random_rows(5, 100) * 2
    assert run(spark, rows) == brute(rows)


def test_exact_arithmetic_beyond_64_bits(spark):
    big = 3_000_000_000_000
    counts = spark.createDataFrame(
        [("en", 0, "", 4 * big), ("en", 1, "a", big + 1), ("en", 1, "b", big + 7), ("en", 2, "a b", big)], "lang string, size int, phrase string, n long"
    )
    r = phrases.collocations(counts).collect()[0]
    assert (r.a, r.l, r.r, r.n, r.score) == (big, big + 1, big + 7, 4 * big, 1_000_000 * big * big // ((big + 1) * (big + 7)))


def test_nothing_to_find(spark):
    assert run(spark, [("a b", "en")]) == [] and phrases.collocations(phrases.phrase_counts(frame(spark, []))).count() == 0
