"""Ranked lexical search against plain scoring of every document, and against its SQL."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from oracle import compare, connect

from strandline.llm import queries, ranked_search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def split(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, top=10):
    """Rows (item_id, rank, doc_id, score), every document scored."""
    held = [(d, Counter(split(t)), len(split(t))) for d, t in docs]
    big_n, big_l = sum(n > 0 for *_, n in held), sum(n for *_, n in held)
    df = Counter(t for _, c, _ in held for t in c)
    out = []
    for item, text in items:
        scored = []
        for d, c, n in held:
            s = sum(math.floor(1000 * math.log((2 * big_n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * (25 + 75 * n * big_n // big_l))) for t in split(text) if c[t])
            if s > 0:
                scored.append((s, d))
        scored.sort(key=lambda r: (-r[0], r[1] is None, r[1] or 0))
        out += [(item, k, d, s) for k, (s, d) in enumerate(scored[:top], 1)]
    return sorted(out, key=str)


def corpus(n=400, seed=2):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(200)]
    text = lambda k: rng.choice([" ", ", ", "\n-"]).join(vocabulary[min(199, int(rng.paretovariate(0.7)))] for _ in range(k))
    docs = [(i, text(rng.randint(1, 60))) for i in range(n)]
    docs[3:8] = [(3, None), (4, ""), (5, " \t..!"), (6, "É漢字 ÉCOLE École x"), (7, "W1 " * 20_000)]
    docs += [docs[i] for i in range(20, 40)] + [(None, docs[50][1]), (None, docs[51][1])] + [(1000 + i, "w5 w9") for i in range(30)]
    items = [(i, text(rng.randint(1, 25))) for i in range(30)] + [(100, None), (101, ""), (102, "--"), (103, "École W1 w1 w1"), (103, "École W1 w1 w1"), (104, "unseen words"), (105, "w9 w5")]
    return docs, items


@pytest.mark.parametrize("block_bytes", [1 << 20, 300])
def test_search(spark, block_bytes):
    docs, items = corpus()
    d = spark.createDataFrame([(*r, "x", 1, 2, 3) for r in docs], "doc_id long, text string, item string, n long, score int, rank int").repartition(3)
    b = spark.createDataFrame([(*r, "y") for r in items], "item_id long, text string, doc_id string")
    got = ranked_search.search(d, b, block_bytes=block_bytes)
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(docs, items)


def test_search_of_empty_tables(spark):
    d, b = spark.createDataFrame([(1, "a b")], "doc_id long, text string"), spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert ranked_search.search(d.where("false"), b).collect() == [] and ranked_search.search(d, b.where("false")).collect() == []
    assert ranked_search.search(d.selectExpr("doc_id", "cast(null as string) as text"), b).columns == ["item_id", "rank", "doc_id", "score"]


def test_accumulators_stop_and_scores_stay_exact():
    """A rare term that decides, then a common one: no accumulator is made for documents that have only the latter."""
    starts, docs = np.array([0, 12, 112]), np.concatenate([np.arange(12), np.arange(100)])
    worth = np.concatenate([np.full(12, 1000), np.arange(100)])
    most = np.array([1000, 99])
    found, score = ranked_search.block_scores((np.array([0, 1]), np.array([1, 1])), starts, docs, worth, most, 100, 0, 10)
    assert found.tolist() == list(range(2, 12)) and score.tolist() == [1000 + i for i in range(2, 12)]
    found, _ = ranked_search.block_scores((np.array([0, 1]), np.array([1, 1])), starts, docs, worth, most, 100, 1100, 10)
    assert len(found) == 0


def test_search_is_the_sql(spark):
    sf = "/root/testdata/sf0.001"
    assert compare(queries.op13_ranked_search(spark, sf).toPandas(), connect(sf).sql(ranked_search.SQL).df()) == ""
