"""Merkle manifest of a dataset: a root over all rows, a proof for each row, and the check that a tampered row fails.

Rows become leaves, leaves of a language become a binary tree, and the languages' roots become another one. Trees are taken in superblocks
of consecutive nodes. A first pass reduces every superblock to one node; the nodes above them are few, and each superblock needs only those
beside its own way up. Leaves and these outer nodes are cogrouped by superblock: one call finishes the superblock's own levels, joins inner
and outer siblings to proofs, and folds every row's (tampered) leaf up to the root.
"""

from __future__ import annotations

from hashlib import sha256

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.llm.common import Scratch, crc_mod
from strandline.operators.placement import placed

#: Consecutive nodes of a tree that one task reduces at once; a power of two, so that superblocks are whole subtrees.
SUPERBLOCK = 4096
#: Rows whose id's crc32 it divides are tampered with.
TAMPER_EVERY = 7

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(*parts: str) -> str:
    return sha256("".join(parts).encode()).hexdigest()


def levels(nodes: list[str], whole: bool, height: int) -> list[list[str]]:
    """The nodes and what they become, level by level: until one is left if whole, else over height levels."""
    out = [nodes]
    while len(out[-1]) > 1 if whole else len(out) <= height:
        now = out[-1]
        out.append([digest(*now[i : i + 2]) for i in range(0, len(now), 2)])
    return out


def siblings(tree: list[list[str]], at: int) -> list[tuple[str, bool] | None]:
    """On the way up from a node: on each level its neighbour in the run and whether that is the left one, None where it is alone."""
    way = []
    for level in tree[:-1]:
        other = at ^ 1
        way.append((level[other], other < at) if other < len(level) else None)
        at >>= 1
    return way


def pack_way(way: list[tuple[str, bool] | None]) -> str:
    """A way as text: `<` or `>` and the neighbour on its left or right, `-` where there is none."""
    return " ".join("-" if s is None else "<>"[not s[1]] + s[0] for s in way)


def fold(node: str, steps: list[str]) -> str:
    """The node at the end of a packed way."""
    for s in steps:
        node = digest(s[1:], node) if s[0] == "<" else digest(node, s[1:]) if s[0] == ">" else digest(node)
    return node


def proof_of(steps: list[str]) -> str:
    return digest(*(s[1:] for s in steps if s != "-"))


def _own_ways(pdf: pd.DataFrame, superblock: int) -> tuple[pd.DataFrame, list[list[str]], int]:
    """A superblock's nodes in order, its levels, and the place of its first node."""
    pdf = pdf.sort_values("pos", kind="stable").reset_index(drop=True)
    height, n = superblock.bit_length() - 1, int(pdf["n"].iloc[0])
    return pdf, levels(pdf["node"].tolist(), n <= superblock, height), int(pdf["pos"].iloc[0])


def outer_ways(nodes: DataFrame, superblock: int, scratch: Scratch) -> DataFrame:
    """(tree, pos, way, top): the packed way from each node (tree, pos, node, n) to the top of its tree, and that top.

    n is the number of nodes of the tree and pos the place among them. Trees of more than a superblock take a round a factor of superblock.
    """
    most = nodes.agg(F.max("n")).first()[0] or 0
    outer = None
    if most > superblock:
        above = scratch.keep(superblock_roots(nodes, superblock))
        outer = outer_ways(above, superblock, scratch).withColumnRenamed("pos", "sb")
    found = nodes.withColumn("sb", F.expr(f"pos div {superblock}"))

    def join_ways(mine: pd.DataFrame, rest: pd.DataFrame | None) -> pd.DataFrame:
        mine, tree, first = _own_ways(mine, superblock)
        upper, top = ("", tree[-1][0]) if rest is None or not len(rest) else (rest["way"].iloc[0], rest["top"].iloc[0])
        ways = [" ".join(filter(None, (pack_way(siblings(tree, i)), upper))) for i in range(len(mine))]
        return pd.DataFrame({"tree": mine["tree"], "pos": mine["pos"], "way": ways, "top": top})

    schema = "tree string, pos long, way string, top string"
    if outer is None:
        return found.groupBy("tree", "sb").applyInPandas(lambda mine: join_ways(mine, None), schema)
    return found.groupBy("tree", "sb").cogroup(outer.groupBy("tree", "sb")).applyInPandas(join_ways, schema)


def superblock_roots(nodes: DataFrame, superblock: int) -> DataFrame:
    """(tree, pos, node, n): one node for each superblock, pos and n being its place and their number in the tree."""

    def reduce(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, tree, first = _own_ways(pdf, superblock)
        return pd.DataFrame({"tree": pdf["tree"].iloc[:1], "pos": [first // superblock], "node": tree[-1], "n": [-(-int(pdf["n"].iloc[0]) // superblock)]})

    return nodes.withColumn("sb", F.expr(f"pos div {superblock}")).groupBy("tree", "sb").applyInPandas(reduce, "tree string, pos long, node string, n long")


def _leaf(columns: list[Column]) -> Column:
    """H of values, each as its UTF-8 length, a colon and the value, or `-` for null."""
    texts = [c.cast("string") for c in columns]
    return F.sha2(F.concat(*(F.when(t.isNull(), "-").otherwise(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t)) for t in texts)), 256)


def manifest(docs: DataFrame, fields: tuple[str, ...] = FIELDS, superblock: int = SUPERBLOCK, tamper_every: int = TAMPER_EVERY) -> DataFrame:
    """Per row: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified.

    fields are the names of the id, source, language, length and text, in the order in which they are hashed; other columns don't count,
    whatever they are called. Nulls of any field hash as `-`, empty texts as `0:`; a text is hashed in the JVM and never leaves its row,
    however long it is. Rows with a null language are a tree of their own, before all others. In a tree, rows stand by id, null ids first;
    rows that repeat an id stand by their leaf, and rows that are equal in all fields are leaves of their own with equal digests, each with
    the proof of its own place. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "merkle")
    doc_id, source, lang, n_chars, text = (F.col(f) for f in fields)
    tampered = F.coalesce(crc_mod(doc_id, tamper_every) == 0, F.lit(False)) & n_chars.isNotNull()
    bent = F.when(tampered, _leaf([doc_id, source, lang, n_chars + 1, text]))
    # "" is the null language, "=" stands before the others: sorts null first, the rest by UTF-8 bytes
    tree = F.when(lang.isNull(), "").otherwise(F.concat(F.lit("="), lang.cast("string")))
    leaves = docs.select(doc_id.alias("doc_id"), tree.alias("tree"), _leaf([doc_id, source, lang, n_chars, text]).alias("node"), bent.alias("bent"))
    at = placed(leaves, ["doc_id", "node"], ["tree"], out="pos", first=0)
    sizes = at.groupBy("tree").agg(F.count("*").alias("n"))
    nodes = scratch.keep(at.join(sizes, "tree").withColumn("sb", F.expr(f"pos div {superblock}")))

    inner = scratch.keep(superblock_roots(nodes.select("tree", "pos", "node", "n"), superblock))
    ways = scratch.keep(outer_ways(inner, superblock, scratch))
    subroots = ways.where("pos = 0").select(F.col("tree").alias("lang_tree"), F.col("top").alias("node"))
    count = subroots.count()
    ranked = placed(subroots, ["lang_tree"], out="pos", first=0).select(F.lit("").alias("tree"), "pos", "node", F.lit(count).cast("long").alias("n"), "lang_tree")
    upper = outer_ways(ranked.select("tree", "pos", "node", "n"), superblock, scratch).join(ranked.select("pos", "lang_tree"), "pos")
    outer = ways.join(upper.select(F.col("lang_tree").alias("tree"), F.col("way").alias("upper"), F.col("top").alias("root")), "tree").select("tree", F.col("pos").alias("sb"), F.concat_ws(" ", F.nullif("way", F.lit("")), F.nullif("upper", F.lit(""))).alias("way"), F.col("top").alias("subroot"), "root")

    kind = docs.select(doc_id).schema[0].dataType.simpleString()

    def finish(mine: pd.DataFrame, rest: pd.DataFrame) -> pd.DataFrame:
        mine, tree, _ = _own_ways(mine, superblock)
        above, root = rest["way"].iloc[0].split(), rest["root"].iloc[0]
        proofs, folded = [], []
        for i, (node, bent) in enumerate(zip(mine["node"], mine["bent"], strict=True)):
            steps = pack_way(siblings(tree, i)).split() + above
            proofs.append(proof_of(steps))
            folded.append(fold(bent if isinstance(bent, str) else node, steps))
        return pd.DataFrame({"doc_id": mine["doc_id"], "leaf": mine["node"], "subroot": rest["subroot"].iloc[0], "root": root, "proof_sha256": proofs, "folded_root": folded, "verified": [f == root for f in folded]})

    # ids pass through pandas as text, where a null would turn integers into floats
    held = nodes.withColumn("doc_id", F.col("doc_id").cast("string"))
    done = held.groupBy("tree", "sb").cogroup(outer.groupBy("tree", "sb")).applyInPandas(finish, "doc_id string, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")
    return done.withColumn("doc_id", F.col("doc_id").cast(kind))


#: The same in SQL: levels by recursion, a way up for each leaf as (level, tree, place).
SQL = r"""
WITH RECURSIVE f AS (SELECT doc_id, source, lang, n_chars, text, doc_id IS NOT NULL AND xor(4294967295, list_reduce([4294967295] || list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: ascii(c)),
      lambda a, x: list_reduce([xor(a, x), 0, 0, 0, 0, 0, 0, 0, 0], lambda b, y: xor(b >> 1, 3988292384 * (b & 1))))) % 7 = 0 AS tampered FROM documents),
h AS (SELECT doc_id, lang, sha256(p1 || p2 || p3 || CASE WHEN n_chars IS NULL THEN '-' ELSE strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars END || p5) AS leaf,
      CASE WHEN tampered AND n_chars IS NOT NULL THEN sha256(p1 || p2 || p3 || strlen(CAST(n_chars + 1 AS VARCHAR)) || ':' || (n_chars + 1) || p5) END AS bent
      FROM (SELECT *, CASE WHEN doc_id IS NULL THEN '-' ELSE strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id END AS p1, CASE WHEN source IS NULL THEN '-' ELSE strlen(source) || ':' || source END AS p2,
            CASE WHEN lang IS NULL THEN '-' ELSE strlen(lang) || ':' || lang END AS p3, CASE WHEN text IS NULL THEN '-' ELSE strlen(text) || ':' || text END AS p5 FROM f)),
b AS (SELECT coalesce('=' || lang, '') AS tree, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, doc_id, leaf, bent FROM h),
n AS (SELECT tree, 0 AS lvl, pos, leaf AS node, count(*) OVER (PARTITION BY tree) AS c FROM b
      UNION ALL SELECT tree, lvl + 1, pos // 2, sha256(string_agg(node, '' ORDER BY pos)), (max(c) + 1) // 2 FROM n WHERE c > 1 GROUP BY tree, lvl, pos // 2),
s AS (SELECT tree, node AS subroot, lvl AS height, row_number() OVER (ORDER BY tree) - 1 AS pos, count(*) OVER () AS c FROM n WHERE c = 1),
m AS (SELECT 0 AS lvl, pos, subroot AS node, c FROM s UNION ALL SELECT lvl + 1, pos // 2, sha256(string_agg(node, '' ORDER BY pos)), (max(c) + 1) // 2 FROM m WHERE c > 1 GROUP BY lvl, pos // 2),
w AS (SELECT b.tree, b.pos, b.doc_id, b.leaf, b.bent, s.subroot, s.height, s.pos AS spos, (SELECT node FROM m WHERE m.c = 1) AS root FROM b JOIN s ON s.tree = b.tree),
u AS (SELECT tree, pos, 0 AS lvl, coalesce(bent, leaf) AS node, '' AS proof, pos AS at FROM w
      UNION ALL SELECT u.tree, u.pos, u.lvl + 1, sha256(CASE WHEN o.node IS NULL THEN u.node WHEN u.at % 2 = 1 THEN o.node || u.node ELSE u.node || o.node END), u.proof || coalesce(o.node, ''), u.at // 2
      FROM u JOIN s ON s.tree = u.tree AND u.lvl < s.height LEFT JOIN n o ON o.tree = u.tree AND o.lvl = u.lvl AND o.pos = xor(u.at, 1)),
v AS (SELECT u.tree, u.pos, 0 AS lvl, u.node, u.proof, s.pos AS at FROM u JOIN s ON s.tree = u.tree AND s.height = u.lvl
      UNION ALL SELECT v.tree, v.pos, v.lvl + 1, sha256(CASE WHEN o.node IS NULL THEN v.node WHEN v.at % 2 = 1 THEN o.node || v.node ELSE v.node || o.node END), v.proof || coalesce(o.node, ''), v.at // 2
      FROM v JOIN (SELECT max(lvl) AS height FROM m) z ON v.lvl < z.height LEFT JOIN m o ON o.lvl = v.lvl AND o.pos = xor(v.at, 1))
SELECT w.doc_id, w.leaf, w.subroot, w.root, sha256(v.proof) AS proof_sha256, v.node AS folded_root, v.node = w.root AS verified
FROM w JOIN v ON v.tree = w.tree AND v.pos = w.pos JOIN (SELECT max(lvl) AS height FROM m) z ON v.lvl = z.height
"""
