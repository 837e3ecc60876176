"""The Merkle manifest against a plain reduction of lists."""

import zlib
from hashlib import sha256

import pytest
from oracle import compare, connect

from strandline.llm import merkle, queries

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, node string, tree string, pos int"


def h(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def leaf(doc_id, source, lang, n_chars, text):
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)))


def climb(nodes, at):
    """(top, siblings beside the way up, each with its side) of a node of a list."""
    way = []
    while len(nodes) > 1:
        run = nodes[at // 2 * 2 : at // 2 * 2 + 2]
        way.append([(s, i < at % 2) for i, s in enumerate(run) if i != at % 2])
        nodes, at = [h(*nodes[i : i + 2]) for i in range(0, len(nodes), 2)], at // 2
    return nodes[0], way


def brute(rows):
    """Sorted result rows of a table (doc_id, text, lang, source, n_chars)."""
    trees = {}
    for doc_id, text, lang, source, n in rows:
        bent = n is not None and doc_id is not None and zlib.crc32(str(doc_id).encode()) % 7 == 0
        own = leaf(doc_id, source, lang, n, text)
        trees.setdefault(lang, []).append((doc_id, own, leaf(doc_id, source, lang, n + 1, text) if bent else own))
    names = sorted(trees, key=lambda v: (v is not None, (v or "").encode()))
    for v in names:
        trees[v].sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    tops = [climb([r[1] for r in trees[v]], 0)[0] for v in names]
    out = []
    for k, v in enumerate(names):
        for i, (doc_id, own, bent) in enumerate(trees[v]):
            sub, low = climb([r[1] for r in trees[v]], i)
            root, high = climb(tops, k)
            node = bent
            for beside in low + high:
                node = h(*(s for s, left in beside if left), node, *(s for s, left in beside if not left))
            out.append((doc_id, own, sub, root, h(*(s for beside in low + high for s, _ in beside)), node, node == root))
    return sorted(out, key=str)


def made(n, langs):
    texts = ["", None, "é漢 " * 3000, "a:b", "12:x"]
    rows = [(i * 3 % n if i % 11 else None, texts[i % 5] if i % 3 else f"text {i}", langs[i % 7 % len(langs)], None if i % 13 == 0 else f"s{i % 2}", None if i % 17 == 0 else i) for i in range(n)]
    return rows + rows[5:12]


@pytest.mark.parametrize(("n", "langs"), [(100, ["en", None, "", "de", "é", "z"]), (1, [None]), (64, ["a"])])
@pytest.mark.parametrize("superblock", [2, 4096])
def test_manifest(spark, n, langs, superblock):
    rows = made(n, langs)[: n if n == 1 else None]
    df = spark.createDataFrame([(*r, "x", "y", 1) for r in rows], SCHEMA)
    got = sorted((tuple(r) for r in merkle.manifest(df, superblock=superblock).collect()), key=str)
    assert got == brute(rows)


def test_manifest_detects_only_what_was_tampered_with(spark):
    df = spark.createDataFrame([(i, f"t{i}", "en", "s", 2) for i in range(200)], "doc_id long, text string, lang string, source string, n_chars long")
    for r in merkle.manifest(df, superblock=8).collect():
        assert r["verified"] == (zlib.crc32(str(r["doc_id"]).encode()) % 7 != 0)
    assert merkle.manifest(df.where("false")).collect() == []


def test_manifest_is_the_sql(spark):
    sf = "/root/testdata/sf0.001"
    assert compare(queries.op11_merkle_manifest(spark, sf).toPandas(), connect(sf).sql(merkle.SQL).df()) == ""
