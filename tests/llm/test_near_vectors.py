"""Multi-index hashing against brute force."""

import numpy as np

from strandline.llm import near_vectors, queries

SCHEMA = "vec_id long, embedding array<double>, label int, rank int, score double, cls string"


def brute(rows, top=20, every=20):
    """{query id: [(vec_id, score)]} of rows (vec_id, vector)."""
    kept = {(i, tuple(v)) for i, v in rows if i is not None and v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    out = {}
    for i, v in sorted(kept):
        if i % every == 0:
            scored = sorted(((sum(a * b for a, b in zip(v, w, strict=True)), j) for j, w in kept if j != i and len(w) == len(v)), key=lambda r: (-r[0], r[1]))
            out.setdefault(i, []).extend((j, s) for s, j in scored[:top])
    return out


def answers(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        assert r["rank"] == len(out[r["query_id"]])
    return out


def recall(got, want):
    return np.mean([len({j for j, _ in got.get(q, [])} & {j for j, _ in w}) / len(w) for q, w in want.items()])


def table(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], 1, 2, 3.0, "x") for i, v in rows], SCHEMA)


def clustered(n=1500, d=24, seed=4):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((30, d))
    x = centres[rng.integers(0, 30, n)] + 0.3 * rng.standard_normal((n, d))
    x *= rng.uniform(0.5, 2, n)[:, None]
    return [(i, v.tolist()) for i, v in enumerate(x)]


def test_nearest_with_hostile_rows(spark):
    rows = clustered()
    rows[100:103] = [(100, None), (101, [0.0] * 24), (102, [float("nan")] + [1.0] * 23)]
    rows[103:105] = [(103, [None] + [1.0] * 23), (104, [float("inf")] * 24)]
    long = max((r for r in rows if r[0] % 20 == 0 and r[0] != 100), key=lambda r: sum(v * v for v in r[1]))
    rows += [(5000 + i, long[1]) for i in range(60)] + [(None, rows[3][1]), rows[20], (20_000, []), (30_000, [1.0, 2.0]), (30_020, [2.0, 0.5]), (30_040, [3.0])]
    got, want = answers(near_vectors.nearest(table(spark, rows))), brute(rows)
    want = {q: w for q, w in want.items() if w}
    assert set(got) == set(want) and recall(got, want) >= 0.9
    assert [j for j, _ in got[long[0]]] == [j for j, _ in want[long[0]]] and 5000 in dict(got[long[0]])
    scores = dict(((q, j), s) for q, w in want.items() for j, s in w)
    for q, found in got.items():
        assert len(found) == len(want[q]) and all(j != q for j, _ in found) and found == sorted(found, key=lambda r: (-r[1], r[0]))
        assert all(abs(scores[q, j] - s) < 1e-12 for j, s in found if (q, j) in scores)


def test_few_and_no_vectors(spark):
    rows = [(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [1.0, 0.0]), (20, [-1.0, 0.2])]
    assert answers(near_vectors.nearest(table(spark, rows))) == brute(rows)
    assert near_vectors.nearest(table(spark, rows[1:2])).collect() == []
    assert near_vectors.nearest(table(spark, rows).where("false")).collect() == []


def test_every_code_within_the_radius_is_found_once():
    """Pigeonhole probing over all substrings gives each code within the radius exactly once, whatever the radius."""
    rng = np.random.default_rng(0)
    x, q = rng.standard_normal((700, 20)), rng.standard_normal((9, 20))
    coder = near_vectors.Coder(rng.standard_normal((200, 20)), float(np.sqrt((x * x).sum(axis=1)).max()))
    coder.words = 3
    coder.turn = near_vectors.learn_rotation(coder._lift(x), 48)
    codes, asked = coder.codes(x).astype(np.int64), coder.query_codes(q).astype(np.int64)
    apart = np.bitwise_count(codes[None] ^ asked[:, None]).sum(axis=2)
    for radius in (0, 1, 2, 5, 13, 20, 31, 48):
        found = []
        for word in range(3):
            a, b, _ = near_vectors.probe(x, codes, q, asked, np.full(9, radius), np.full(9, -np.inf), word, 10_000)
            found += list(zip(a.tolist(), b.tolist(), strict=True))
        assert sorted(found) == [tuple(r) for r in np.argwhere(apart <= radius).tolist()]


def test_queries_that_find_too_few_are_put_to_all_codes(spark, monkeypatch):
    monkeypatch.setattr(near_vectors, "CONFIDENCE", 1e-9)
    rows = clustered(300)
    got, want = answers(near_vectors.nearest(table(spark, rows))), brute(rows)
    assert recall(got, want) == 1


def test_small_cells_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(near_vectors, "CELL_ROWS", 40)
    monkeypatch.setattr(near_vectors, "QUERY_ROWS", 7)
    monkeypatch.setattr(near_vectors, "SAMPLE_BYTES", 8 * 24 * 100)
    rows = clustered(800)
    got, want = answers(near_vectors.nearest(table(spark, rows))), brute(rows)
    assert recall(got, want) >= 0.9


def test_recall_on_the_given_vectors(spark):
    sf = "/root/testdata/sf0.01"
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    got, want = answers(queries.op12_nearest_vectors(spark, sf)), brute(rows)
    assert set(got) == set(want) and recall(got, want) >= 0.9
