"""Embedding near-dedup through a pivot-permutation index.

Every vector is described by the NEAREST pivots (reference vectors) that are closest to it, in order. An inverted list for each label and
set of pivots holds the vectors with those pivots among theirs; sets have one pivot in small tables and up to MAX_DEPTH in large ones, so
that lists stay about equally short at any size. Two vectors of a list are candidates if their shared pivots count MIN_SHARED or more,
a shared pivot counting the more the nearer it stands in both orders; candidates are verified by their exact cosine in double precision.
Equal vectors are one class from the start; a list beyond BLOCK vectors is taken block against block.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm.common import Scratch, connected_components

CUT = 0.93
#: Nearest pivots that describe a vector. A pivot at places i and j (from 0) of two orders counts (NEAREST - i) (NEAREST - j) / NEAREST^2,
#: so the same nearest pivot is enough alone.
NEAREST, MIN_SHARED = 6, 0.75
#: Pivots: about 2 sqrt(vectors) of each dimension, a bounded sample of the vectors themselves; none within PIVOT_CUT of another.
MIN_PIVOTS, MAX_PIVOTS, PIVOT_CUT = 64, 1024, 0.8
#: Pivots that name a list: as few as keep lists of all labels together at LIST_ROWS vectors on average. Near vectors share the more pivots the
#: fewer there are, which is why large tables get longer names and not more pivots.
MAX_DEPTH, LIST_ROWS = 4, 1000
_NAME_BITS = 12
#: Vectors of a list that are compared as one block, and postings that one task takes.
BLOCK, BUCKET_ROWS = 512, 20_000


def rows_of(col: pa.Array) -> list[np.ndarray]:
    """Each list of a column without nulls, in double precision."""
    flat, ends = np.asarray(col.flatten(), dtype=np.float64), np.append(0, np.cumsum(np.asarray(col.value_lengths())))
    return [flat[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def depth_of(vectors: int, pivots: int) -> int:
    """Pivots in the name of a list."""
    depths = range(1, min(MAX_DEPTH, NEAREST, pivots) + 1)
    return next((d for d in depths if math.comb(NEAREST, d) * vectors <= LIST_ROWS * math.comb(pivots, d)), max(depths))


def choose_pivots(classes: DataFrame) -> dict[int, tuple[np.ndarray, int]]:
    """By dimension: pivots as unit rows, and depth_of(). Drawn by a hash of the vector, so the same table gives the same pivots."""
    out = {}
    for r in classes.groupBy("dim").count().orderBy(F.desc("count")).limit(64).collect():
        want = min(MAX_PIVOTS, max(MIN_PIVOTS, math.ceil(2 * math.sqrt(r["count"]))))
        drawn = classes.where(F.col("dim") == r["dim"]).orderBy(F.xxhash64("cls", F.lit(1)), "cls").limit(want).select("vec").toArrow()
        x, kept = unit(np.stack(rows_of(drawn["vec"].combine_chunks()))), []
        near = x @ x.T
        for i in range(len(x)):
            if not kept or near[i, kept].max() < PIVOT_CUT:
                kept.append(i)
        out[r["dim"]] = x[kept], depth_of(r["count"], len(kept))
    return out


def permutations(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """The NEAREST pivots of each row, the nearest first; fewer if there are fewer pivots."""
    near = -(unit(x) @ pivots.T)
    k = min(NEAREST, len(pivots))
    some = np.argpartition(near, k - 1, axis=1)[:, :k]
    return np.take_along_axis(some, np.argsort(np.take_along_axis(near, some, axis=1), axis=1, kind="stable"), axis=1)


def list_names(order: np.ndarray, depth: int) -> np.ndarray:
    """For each row of pivots a number for each set of depth of them: that of the lists it is on."""
    ascending = np.sort(order.astype(np.int64), axis=1)
    return np.stack([sum(ascending[:, c] << (_NAME_BITS * k) for k, c in enumerate(some)) for some in combinations(range(order.shape[1]), depth)], axis=1)


def _postings(pivots: dict[int, tuple[np.ndarray, int]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vecs, dims = rows_of(batch["vec"]), np.asarray(batch["dim"])
            for dim in np.unique(dims):
                at = np.flatnonzero(dims == dim)
                basis = pivots.get(int(dim))
                order, depth = (np.zeros((len(at), 1), np.int64), 1) if basis is None else (permutations(np.stack([vecs[i] for i in at]), basis[0]), basis[1])
                names = list_names(order, min(depth, order.shape[1]))
                again, shown = np.repeat(at, names.shape[1]), np.repeat(order, names.shape[1], axis=0).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(shown) + 1) * shown.shape[1], pa.int32()), pa.array(shown.reshape(-1)))
                yield pa.RecordBatch.from_arrays([*(batch[c].take(again) for c in ("cls", "label", "dim")), pa.array(np.full(len(again), min(depth, order.shape[1]), np.int32)), pa.array(names.reshape(-1)), lists], ["cls", "label", "dim", "depth", "name", "nearest"])

    return run


def shared_counts(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each row of a with each row of b: their shared pivots, counted by place."""
    names, place = np.unique(np.concatenate([a.reshape(-1), b.reshape(-1)]), return_inverse=True)
    worth = (NEAREST - np.arange(a.shape[1])) / NEAREST
    sides = []
    for rows, at in ((a, place[: a.size]), (b, place[a.size :])):
        table = np.zeros((len(rows), len(names)), np.float32)
        table[np.arange(len(rows))[:, None], at.reshape(rows.shape)] = worth
        sides.append(table)
    return sides[0] @ sides[1].T


def _first_shared(a: np.ndarray, b: np.ndarray, depth: int) -> np.ndarray:
    """The list of the depth smallest pivots that each row of a has in common with the same row of b; -1 if they share fewer."""
    none = np.iinfo(np.int64).max
    shared = np.sort(np.where((a[:, :, None] == b[:, None, :]).any(axis=2), a, none), axis=1)[:, :depth]
    name = sum(shared[:, k] % (1 << _NAME_BITS) << (_NAME_BITS * k) for k in range(depth))
    return np.where((shared == none).any(axis=1), -1, name)


def _cell_links(x: np.ndarray, nearest: np.ndarray, name: int, depth: int, cut: float, across: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """(i, j), i before j, of linked vectors of one cell. A pair is looked at on the list of its first shared pivots alone.

    across: if given, the block of each vector; only pairs of different blocks count.
    """
    i, j = np.nonzero(np.triu(shared_counts(nearest, nearest) >= MIN_SHARED - 1e-6, 1))
    if across is not None:
        apart = across[i] != across[j]
        i, j = i[apart], j[apart]
    here = _first_shared(nearest[i], nearest[j], depth) == name
    i, j = i[here], j[here]
    linked = np.concatenate([np.einsum("ij,ij->i", x[i[k : k + 65_536]], x[j[k : k + 65_536]]) >= cut for k in range(0, len(i), 65_536)] or [np.zeros(0, bool)])
    return i[linked], j[linked]


def _verify(table: pa.Table, cut: float) -> pa.Table:
    """(cls, links, root) of the cells of one bucket: links counts vectors, root is a class that this one is linked with inside the cell."""
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    cols = {c: np.asarray(table[c].combine_chunks()) for c in ("cls", "dim", "depth", "name", "lo", "hi", "block", "mult")}
    cols["label"] = np.unique(np.asarray(table["label"].combine_chunks(), dtype=object).astype(str), return_inverse=True)[1]
    order = np.lexsort((cols["cls"], cols["hi"], cols["lo"], cols["name"], cols["dim"], cols["label"]))
    cols = {k: v[order] for k, v in cols.items()}
    vecs, nearest = rows_of(table["vec"].combine_chunks()), rows_of(table["nearest"].combine_chunks())
    keys = np.stack([cols[k] for k in ("label", "dim", "name", "lo", "hi")])
    starts = np.flatnonzero(np.append(True, (keys[:, 1:] != keys[:, :-1]).any(axis=0)))
    for a, b in zip(starts, np.append(starts[1:], len(order)), strict=True):
        if b - a < 2:
            continue
        x = unit(np.stack([vecs[i] for i in order[a:b]]))
        pivots = np.stack([nearest[i] for i in order[a:b]]).astype(np.int64)
        i, j = _cell_links(x, pivots, int(cols["name"][a]), int(cols["depth"][a]), cut, cols["block"][a:b] if cols["lo"][a] != cols["hi"][a] else None)
        if not len(i):
            continue
        cls, mult = cols["cls"][a:b], cols["mult"][a:b]
        links = (np.bincount(i, weights=mult[j], minlength=b - a) + np.bincount(j, weights=mult[i], minlength=b - a)).astype(np.int64)
        root = np.arange(b - a)
        while True:
            low = root.copy()
            np.minimum.at(low, i, root[j])
            np.minimum.at(low, j, root[i])
            low = low[low]
            if (low == root).all():
                break
            root = low
        used = links > 0
        out.append((cls[used], links[used], cls[root[used]]))
    cat = [np.concatenate([o[k] for o in out]) if out else np.zeros(0, np.int64) for k in range(3)]
    return pa.table({"cls": cat[0], "links": cat[1], "root": cat[2]})


def dedup_embeddings(embeddings: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", cut: float = CUT) -> DataFrame:
    """Per row: vec_id, n_links, component_id, kept.

    Vectors link when their labels (of any type that has a text form) are equal and not null, their lengths are equal, and their cosine is
    cut or more. A vector that is null, empty or zero, that holds a null or a non-finite component, or whose id is null links with nothing:
    n_links 0, its own component, kept. Rows that repeat an id are vectors of their own with that id: each has the links and the component
    of its vector. Ids are integers; equal vectors of a label are found by a 64-bit fingerprint. An empty table gives an empty result.
    """
    spark = embeddings.sparkSession
    scratch = Scratch(spark, "embeddings")
    vec, label = F.col(vec_col).cast("array<double>"), F.col(label_col).cast("string")
    rows = embeddings.select(F.col(id_col).cast("long").alias("vec_id"), label.alias("label"), vec.alias("vec"))
    finite = F.forall("vec", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != F.lit(float("inf"))))
    good = F.coalesce(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & finite & F.exists("vec", lambda v: v != 0), F.lit(False))
    marked = rows.withColumn("good", good).withColumn("cls", F.when(F.col("good"), F.xxhash64("label", "vec")))
    classes = scratch.keep(marked.where("good").groupBy("cls").agg(F.min("vec_id").alias("rep"), F.count("*").alias("mult"), F.first("label").alias("label"), F.first("vec").alias("vec"), F.first(F.size("vec")).alias("dim")))
    pivots = choose_pivots(classes)

    posted = scratch.keep(classes.select("cls", "label", "dim", "vec").mapInArrow(_postings(pivots), "cls long, label string, dim int, depth int, name long, nearest array<int>"))
    lists = posted.groupBy("label", "dim", "name").agg(F.count("*").alias("size")).where("size > 1")
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    placed = posted.join(lists, ["label", "dim", "name"]).withColumn("blocks", blocks).withColumn("block", F.pmod("cls", F.col("blocks")).cast("int"))
    cells = placed.select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")).select("cls", "label", "dim", "depth", "name", "nearest", "block", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"))
    n = cells.count()
    buckets = max(64, -(-n // BUCKET_ROWS))
    full = cells.join(classes.select("cls", "vec", "mult"), "cls").withColumn("bucket", F.pmod(F.xxhash64("label", "dim", "name", "lo", "hi"), F.lit(buckets)))

    def verify(table: pa.Table) -> pa.Table:
        return _verify(table, cut)

    met = scratch.keep(full.groupBy("bucket").applyInArrow(verify, "cls long, links long, root long"))
    counts = met.groupBy("cls").agg(F.sum("links").alias("links"))
    roots = connected_components(met.select(F.col("cls").alias("a"), F.col("root").alias("b")), scratch).withColumnsRenamed({"node": "cls", "root": "comp"})
    joined = classes.select("cls", "rep", "mult").join(counts, "cls", "left").join(roots, "cls", "left")
    judged = joined.select("cls", "rep", (F.coalesce("links", F.lit(0)) + F.col("mult") - 1).alias("n_links"), F.coalesce("comp", "cls").alias("comp"))
    least = judged.groupBy("comp").agg(F.min("rep").alias("component_id"))
    out = marked.select("vec_id", "cls").join(judged.join(least, "comp").select("cls", "n_links", "component_id"), "cls", "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))


#: The same result in SQL: all pairs of a label.
SQL = """
WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE label IS NOT NULL AND list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[])) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
      WHERE list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))) >= 0.93),
r AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b),
c AS (SELECT a, min(b) AS c FROM r GROUP BY 1), n AS (SELECT a, count(*) AS n FROM l GROUP BY 1)
SELECT e.vec_id, coalesce(n.n, 0) AS n_links, c.c AS component_id, e.vec_id = c.c AS kept FROM embeddings e JOIN c ON c.a = e.vec_id LEFT JOIN n ON n.a = e.vec_id
"""
