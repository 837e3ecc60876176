"""Approximate nearest neighbours by multi-index hashing.

A vector's code is the signs of a learned rotation. Codes are cut into substrings of 16 bits and every substring is indexed. Codes within a
Hamming radius of a query's are all found by the pigeonhole principle: in some substring they differ by no more than its share of the radius,
so the index entries within that share of the query's substring are probed; what is within the radius is reranked by exact inner products.

The radius is the query's own. A lower bound of its k-th best product (from a bounded sample, and from a first round that probes the
query's own index entries) is an angle that all its nearest vectors are within, and bits differ with a chance of angle / pi: the radius is
the CONFIDENCE quantile of that many differing bits. The bound is that of DEPTH times as many neighbours as are asked for, so that enough lie
within the radius; a query that still finds too few is put to all codes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandline.llm.common import Scratch

NEAREST, QUERY_EVERY = 20, 20
WORD = 16
#: Most substrings of a code; there are as many as the dimensions of a vector fill.
MAX_WORDS = 16
#: The sample that the rotation and first bounds come from, and so what is sent to tasks: so many bytes of vectors for each length of vector.
SAMPLE_BYTES = 8 << 20
#: Vectors that rotations are fitted on at most, rounds of the fit, and lengths of vector that get a rotation (others are compared directly).
FIT_ROWS, FIT_ROUNDS, MAX_LENGTHS = 4096, 20, 16
#: Chance that a vector as near as the bound lies within the radius.
CONFIDENCE = 0.97
#: Bounds are those of so many times the neighbours that are asked for.
DEPTH = 1.5
#: Entries of one cell of the index, and queries that one task puts to it.
CELL_ROWS, QUERY_ROWS = 8192, 4096


def rows_of(col: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """A column of lists of one length as a matrix."""
    col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    return np.asarray(col.flatten()).reshape(len(col), -1) if len(col) else np.zeros((0, 1))


def learn_rotation(x: np.ndarray, bits: int) -> np.ndarray:
    """dimensions x bits with orthonormal columns (or rows): turned so that signs are near to what is rotated, by alternating fits."""
    made = np.random.default_rng(7).standard_normal((x.shape[1], bits))
    u, _, v = np.linalg.svd(made, full_matrices=False)
    turn = u @ v
    for _ in range(FIT_ROUNDS):
        u, _, v = np.linalg.svd(x.T @ np.where(x @ turn >= 0, 1.0, -1.0), full_matrices=False)
        turn = u @ v
    return turn


class Coder:
    """Codes of vectors of one length. Vectors get one more component that makes them equally long, so the largest product is the least angle."""

    def __init__(self, sample: np.ndarray, longest: float):
        self.sample, self.longest = sample, longest
        self.words = min(MAX_WORDS, max(1, round(sample.shape[1] / WORD)))
        self.turn = learn_rotation(self._lift(sample[:FIT_ROWS]), self.words * WORD)
        bits = self.words * WORD
        logs = np.cumsum(np.log(np.maximum(1, np.arange(bits + 1))))
        k = np.arange(bits + 1)
        chance = np.linspace(0, 1, 2001)[:, None].clip(1e-12, 1 - 1e-12)
        mass = np.exp(logs[bits] - logs[k] - logs[bits - k] + k * np.log(chance) + (bits - k) * np.log1p(-chance))
        #: Radius by chance that a bit differs, in steps of 1 / 2000.
        self.radii = (np.cumsum(mass, axis=1) < CONFIDENCE).sum(axis=1).clip(max=bits)

    def _lift(self, x: np.ndarray) -> np.ndarray:
        y = x / self.longest
        return np.hstack([y, np.sqrt(np.maximum(0, 1 - (y * y).sum(axis=1)))[:, None]])

    def _codes(self, x: np.ndarray) -> np.ndarray:
        return np.packbits(x @ self.turn >= 0, axis=1).view(">u2").astype(np.int32)

    def codes(self, x: np.ndarray) -> np.ndarray:
        return self._codes(self._lift(x))

    def query_codes(self, q: np.ndarray) -> np.ndarray:
        return self._codes(np.hstack([q, np.zeros((len(q), 1))]))

    def first_bound(self, q: np.ndarray, top: int) -> np.ndarray:
        """For each query a product that top vectors of the sample reach; minus infinity if there are fewer."""
        if len(self.sample) < top:
            return np.full(len(q), -np.inf)
        parts = [np.partition(q[i : i + 256] @ self.sample.T, -top, axis=1)[:, -top] for i in range(0, len(q), 256)]
        bound = np.concatenate(parts) if parts else np.zeros(0)
        return bound - 1e-9 * np.abs(bound)

    def radius(self, q: np.ndarray, bound: np.ndarray) -> np.ndarray:
        """Hamming radius for queries that want products of bound or more; minus infinity wants all codes."""
        cosine = np.where(np.isfinite(bound), bound, 0) / (np.sqrt((q * q).sum(axis=1)) * self.longest)
        steps = np.ceil(np.arccos(cosine.clip(-1, 1)) / math.pi * 2000).astype(int)
        return np.where(np.isfinite(bound), self.radii[steps], self.words * WORD)


def shares(radius: np.ndarray, words: int) -> np.ndarray:
    """queries x words: how far each substring is probed. A code within the radius is within the share of some substring; -1 is not at all."""
    return radius[:, None] // words - (np.arange(words)[None, :] > radius[:, None] % words)


def _code(coders: dict[int, Coder], top: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length = np.asarray(batch["dim"])
            for dim in np.unique(length):
                part = batch.filter(pa.array(length == dim))
                x, coder = rows_of(part["vec"]), coders.get(int(dim))
                n = len(x)
                own, asked = (coder.codes(x), coder.query_codes(x)) if coder else (np.zeros((n, 1), np.int32),) * 2
                bound = np.full(n, -np.inf)
                wanted = np.flatnonzero(np.asarray(part["asked"]))
                if coder:
                    bound[wanted] = coder.first_bound(x[wanted], top)
                lists = [pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * c.shape[1], pa.int32()), pa.array(c.reshape(-1))) for c in (own, asked)]
                yield pa.RecordBatch.from_arrays([part["cls"], part["rep"], part["dim"], part["vec"], part["asked"], *lists, pa.array(bound)], ["cls", "rep", "dim", "vec", "asked", "code", "asked_code", "bound"])

    return run


def _routes(coders: dict[int, Coder], cell_bits: int, reach: str):
    """Queries to the cells of the index that their probes reach: (cls, dim, word, cell, radius).

    reach: own (the entries of the query's own substrings), bound (the radius of its bound) or all codes.
    """
    masks = np.arange(1 << cell_bits, dtype=np.int64)
    masks = masks[np.argsort(np.bitwise_count(masks), kind="stable")]
    within = np.cumsum(np.bincount(np.bitwise_count(masks), minlength=WORD + 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length = np.asarray(batch["dim"])
            for dim in np.unique(length):
                part = batch.filter(pa.array(length == dim))
                coder, codes, bound = coders.get(int(dim)), rows_of(part["asked_code"]), np.asarray(part["bound"])
                words = codes.shape[1]
                radius = np.full(len(codes), words - 1 if reach == "own" else WORD * words)
                if reach == "bound" and coder:
                    radius = coder.radius(rows_of(part["vec"]), bound)
                share = shares(radius, words)
                for w in range(words):
                    probed = np.flatnonzero(share[:, w] >= 0)
                    count = within[np.minimum(share[probed, w], WORD)]
                    at = np.repeat(probed, count)
                    step = np.arange(len(at)) - np.repeat(np.cumsum(count) - count, count)
                    cell = (codes[at, w] >> (WORD - cell_bits)) ^ masks[step]
                    yield pa.RecordBatch.from_arrays([part["cls"].take(pa.array(at)), pa.array(np.full(len(at), dim, np.int32)), pa.array(np.full(len(at), w, np.int32)), pa.array(cell.astype(np.int32)), pa.array(radius[at].astype(np.int32))], ["cls", "dim", "word", "cell", "radius"])

    return run


def probe(x: np.ndarray, codes: np.ndarray, q: np.ndarray, asked: np.ndarray, radius: np.ndarray, bound: np.ndarray, word: int, top: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, entry, product): of the entries within each query's radius, found through this substring first, the top with products of bound or more."""
    words = codes.shape[1]
    entries, where = np.unique(codes[:, word], return_inverse=True)
    by = np.argsort(where, kind="stable")
    ends = np.searchsorted(where[by], np.arange(len(entries) + 1))
    out = []
    for a in range(0, len(q), 256):
        part = slice(a, a + 256)
        share = shares(radius[part].astype(np.int64), words)
        hit = np.bitwise_count(entries[None, :] ^ asked[part, word][:, None]) <= share[:, word][:, None]
        # rows of the probed entries of each query, one after another
        who, entry = np.nonzero(hit)
        size = ends[entry + 1] - ends[entry]
        query = np.repeat(who, size)
        row = by[np.repeat(ends[entry], size) + np.arange(len(query)) - np.repeat(np.cumsum(size) - size, size)]
        total = np.zeros(len(query), np.int64)
        fresh = np.ones(len(query), bool)
        for w in range(words):
            apart = np.bitwise_count(codes[row, w] ^ asked[part, w][query])
            total += apart
            if w < word:
                fresh &= apart > share[query, w]
        kept = fresh & (total <= radius[part][query])
        query, row = query[kept], row[kept]
        product = (q[part] @ x.T)[query, row] if len(query) * 8 > len(x) * len(share) else np.einsum("ij,ij->i", q[part][query], x[row])
        near = product >= bound[part][query]
        query, row, product = query[near], row[near], product[near]
        order = np.lexsort((-product, query))
        query, row, product = query[order], row[order], product[order]
        place = np.arange(len(query)) - np.searchsorted(query, query)
        best = place < top
        out.append((query[best] + a, row[best]))
    query, row = (np.concatenate([o[k] for o in out]) if out else np.zeros(0, np.int64) for k in range(2))
    # products are summed from the first component on, so that a pair has one score wherever it is computed
    return query, row, np.add.accumulate(q[query] * x[row], axis=1)[:, -1] if len(query) else np.zeros(0)


def _meet(top: int):
    def run(entries: pa.Table, queries: pa.Table) -> pa.Table:
        if not len(entries) or not len(queries):
            return pa.table({"q": pa.array([], pa.int64()), "rep": pa.array([], pa.int64()), "cls": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        word = entries["word"][0].as_py()
        asked, codes = rows_of(queries["asked_code"]).astype(np.int64), rows_of(entries["code"]).astype(np.int64)
        query, row, score = probe(rows_of(entries["vec"]), codes, rows_of(queries["vec"]), asked, np.asarray(queries["radius"]), np.asarray(queries["bound"]), word, top)
        took = entries.select(["rep", "cls"]).take(pa.array(row))
        return pa.table({"q": queries["cls"].take(pa.array(query)), "rep": took["rep"], "cls": took["cls"], "score": pa.array(score)})

    return run


def _round(coded: DataFrame, queries: DataFrame, coders: dict[int, Coder], cell_bits: int, top: int, scratch: Scratch, reach: str) -> DataFrame:
    """(q, cls, score): the top classes that each query's probes find."""
    keys = ["dim", "word", "cell"]
    routes = scratch.keep(queries.select("cls", "dim", "vec", "asked_code", "bound").mapInArrow(_routes(coders, cell_bits, reach), "cls long, dim int, word int, cell int, radius int"))
    entries = coded.select("cls", "rep", "dim", "vec", "code", F.posexplode("code").alias("word", "sub")).withColumn("cell", F.shiftright("sub", WORD - cell_bits)).drop("sub")
    blocks = coded.select("dim", F.posexplode("code").alias("word", "sub")).groupBy("dim", "word", F.shiftright("sub", WORD - cell_bits).alias("cell")).agg(F.ceil(F.count("*") / CELL_ROWS).cast("int").alias("blocks"))
    shape = scratch.keep(routes.groupBy(*keys).agg(F.ceil(F.count("*") / QUERY_ROWS).cast("int").alias("chunks")).join(blocks, keys))
    placed = entries.join(shape, keys).withColumn("block", F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int")).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    put = routes.join(shape, keys).withColumn("chunk", F.pmod(F.xxhash64("cls", F.lit(1)), F.col("chunks")).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    put = put.select("cls", "word", "cell", "block", "chunk", "radius").join(queries.select("cls", "dim", "vec", "asked_code", "bound"), "cls")
    by = [*keys, "block", "chunk"]
    left = placed.select("cls", "rep", "vec", "code", *by).groupBy(*by)
    right = put.select("cls", "vec", "asked_code", "bound", "radius", *by).groupBy(*by)
    met = left.cogroup(right).applyInArrow(_meet(top), "q long, rep long, cls long, score double")
    best = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "rep"))
    return scratch.keep(met.withColumn("place", best).where(F.col("place") <= top).select("q", "cls", "score", "place"))


def nearest(embeddings: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", top: int = NEAREST, query_every: int = QUERY_EVERY) -> DataFrame:
    """Per query (rows whose id query_every divides) and rank: query_id, rank, vec_id, score, the top other vectors by inner product.

    Vectors that are null, empty or zero, that hold a null or a non-finite component, or whose id is null take no part. Only vectors of one
    length are compared. Equal vectors are one class (by a 64-bit fingerprint), searched once and found together; of a class only the
    top + 1 smallest ids can matter, so no more are carried. Ties go to the smaller id. A row that repeats an id and its vector counts
    once; one that repeats an id with another vector is a candidate and a query of its own, but no candidate of its id. Ids are integers.
    An empty table, or one without queries, gives an empty result.
    """
    spark = embeddings.sparkSession
    scratch = Scratch(spark, "nearest")
    rows = embeddings.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("vec"))
    finite = F.forall("vec", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != F.lit(float("inf"))))
    good = rows.where(F.coalesce(F.col("vec_id").isNotNull() & finite & F.exists("vec", lambda v: v != 0), F.lit(False))).withColumn("cls", F.xxhash64("vec"))
    asks = F.col("vec_id") % query_every == 0
    classes = scratch.keep(good.groupBy("cls").agg(F.min("vec_id").alias("rep"), F.first("vec").alias("vec"), F.first(F.size("vec")).alias("dim"), F.max(asks).alias("asked")))
    # ids of a class: the smallest of each of 256 parts first, so that a class of any size spreads over tasks
    ids = good.select("cls", "vec_id").distinct()
    of = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy("vec_id"))
    few = ids.withColumn("part", F.pmod(F.xxhash64("vec_id"), F.lit(256))).withColumn("place", of("cls", "part")).where(F.col("place") <= top + 1)
    members = few.withColumn("place", of("cls")).where(F.col("place") <= top + 1).select("cls", "vec_id")

    norm = F.sqrt(F.aggregate("vec", F.lit(0.0), lambda a, v: a + v * v))
    lengths = classes.groupBy("dim").agg(F.count("*").alias("n"), F.max(norm).alias("longest")).orderBy(F.desc("n"), "dim").limit(MAX_LENGTHS).collect()
    coders, total = {}, sum(r["n"] for r in lengths)
    for r in lengths:
        drawn = classes.where(F.col("dim") == r["dim"]).orderBy(F.xxhash64("cls", F.lit(1)), "cls").limit(max(64, SAMPLE_BYTES // (8 * r["dim"]))).select("vec").toArrow()
        coders[r["dim"]] = Coder(rows_of(drawn["vec"]), r["longest"])
    cell_bits = min(WORD, max(0, math.ceil(math.log2(max(1, total / CELL_ROWS)))))

    deep = math.ceil(DEPTH * (top + 1))
    coded = scratch.keep(classes.mapInArrow(_code(coders, deep), "cls long, rep long, dim int, vec array<double>, asked boolean, code array<int>, asked_code array<int>, bound double"))
    # read once more, as Spark can't tell the two sides of a cogroup apart where both come from one DataFrame
    queries = spark.read.schema(coded.schema).parquet(coded._scratch_path).where("asked")
    early = _round(coded, queries, coders, cell_bits, deep, scratch, "own")
    reached = early.groupBy("q").agg(F.count("*").alias("found"), F.min("score").alias("least")).where(F.col("found") == deep)
    sharper = queries.join(reached.select(F.col("q").alias("cls"), "least"), "cls", "left").withColumn("bound", F.greatest("bound", F.coalesce("least", "bound"))).drop("least")
    sharper = scratch.keep(sharper)
    found = _round(coded, sharper, coders, cell_bits, deep, scratch, "bound")
    # a query without a bound was put to all codes already
    enough = found.groupBy(F.col("q").alias("cls")).count().where(F.col("count") > top)
    short = sharper.where(F.col("bound") > float("-inf")).join(enough, "cls", "left_anti")
    if not short.isEmpty():
        short = scratch.keep(short)
        more = _round(coded, short, coders, cell_bits, deep, scratch, "all")
        found = found.join(short.select(F.col("cls").alias("q")), "q", "left_anti").unionByName(more)
    found = found.where(F.col("place") <= top + 1)

    named = found.join(members, "cls").select("q", "vec_id", "score")
    closest = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "vec_id"))
    listed = named.withColumn("place", closest).where(F.col("place") <= top + 1)
    answered = ids.where(asks).select(F.col("vec_id").alias("query_id"), F.col("cls").alias("q")).join(listed, "q").where("vec_id <> query_id")
    rank = F.row_number().over(Window.partitionBy("query_id", "q").orderBy("place"))
    return answered.withColumn("rank", rank).where(F.col("rank") <= top).select("query_id", "rank", "vec_id", "score")
