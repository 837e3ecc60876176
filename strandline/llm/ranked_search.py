"""Ranked lexical search: accumulator-limited term-at-a-time evaluation over blocks of documents.

A first pass turns every text into the items' terms that it holds (a forward index in the shared folder), from which Spark counts
documents, terms and document frequencies. A second pass takes the index a block of documents at a time. In a block, an item's terms are
evaluated one after another, the rarest first, into one accumulator a document. Once what the terms still to come can add at most is below
the score that the item's k-th document already has, no accumulator is created any more, and only those that exist are updated, to
their exact scores. A task hands its best score of earlier blocks on to the next ones, and gives k documents an item.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandline.llm.common import Scratch
from strandline.llm.decontaminate import item_blocks
from strandline.llm.shingles import text_slices, words

TOP = 10
#: Text of the items that one pass searches for, and so a bound on what is sent to tasks.
BLOCK_BYTES = 8 << 20

#: Bytes of a term (letters and digits of ASCII and all bytes of other characters) as they are, any other byte as a blank.
_TERM = np.full(256, 0x20, np.uint8)
_TERM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = [*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]


def terms(flat: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit fingerprint, text index) of each term of some texts, A-Z as a-z."""
    return words(_TERM[flat], offsets)


@dataclass
class Items:
    """Some items' terms: keys are the fingerprints in order; terms[i] and repeats[i] are item i's places in keys and how often they occur."""

    ids: list
    keys: np.ndarray
    terms: list[np.ndarray]
    repeats: list[np.ndarray]

    @staticmethod
    def of(rows: list[tuple[object, str]]) -> "Items":
        raw = [t.encode() for _, t in rows]
        marks, owner = terms(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
        keys, slot = np.unique(marks, return_inverse=True)
        counted = [np.unique(slot[owner == i], return_counts=True) for i in range(len(rows))]
        return Items([i for i, _ in rows], keys, [c[0] for c in counted], [c[1] for c in counted])


def _index(held) -> object:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = held.value.keys
        for batch in batches:
            for ids, flat, offsets in text_slices(batch.column(0), batch.column(1)):
                n = len(offsets) - 1
                marks, text = terms(flat, offsets)
                length = np.bincount(text, minlength=n)
                at = np.minimum(np.searchsorted(keys, marks), max(0, len(keys) - 1))
                known = keys[at] == marks if len(keys) else np.zeros(len(marks), bool)
                pair, tf = np.unique(text[known] * max(1, len(keys)) + at[known], return_counts=True)
                ends = np.searchsorted(pair, np.arange(n + 1) * max(1, len(keys))).astype(np.int32)
                lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(v.astype(np.int32))) for v in (pair % max(1, len(keys)), tf)]
                yield pa.RecordBatch.from_arrays([ids, pa.array(length), *lists], ["doc_id", "n", "slots", "tfs"])

    return run


def block_scores(item: tuple[np.ndarray, np.ndarray], starts: np.ndarray, docs: np.ndarray, worth: np.ndarray, most: np.ndarray, total: int, floor: int, top: int) -> tuple[np.ndarray, np.ndarray]:
    """(documents, scores) of a block that can be among the top of an item; all scores are exact.

    item: its terms, the rarest first, and their repeats. Term t's postings are docs and worth [starts[t]:starts[t + 1]], its largest worth
    is most[t]. floor: a score that top documents elsewhere reach already.
    """
    slots, repeats = item
    left = np.append(np.cumsum((most[slots] * repeats)[::-1])[::-1], 0)
    none = np.zeros(0, np.int64)
    if not len(slots) or left[0] < max(1, floor):
        return none, none
    score, alive, create = np.zeros(total, np.int64), np.zeros(total, bool), True
    for k, t in enumerate(slots.tolist()):
        d, w = docs[starts[t] : starts[t + 1]], worth[starts[t] : starts[t + 1]] * repeats[k]
        if create:
            kth = floor
            # partial scores are at most what the terms so far can give, so there is no need to look before that is more than the rest
            if left[0] - left[k] > left[k]:
                partial = score[alive]
                kth = max(kth, int(np.partition(partial, -top)[-top]) if len(partial) >= top else 0)
            create = left[k] >= kth
        if create:
            alive[d] = True
            score[d] += w
        else:
            mine = alive[d]
            score[d[mine]] += w[mine]
    found = np.flatnonzero(alive)
    found = found[score[found] >= max(1, floor)]
    if len(found) > top:
        kth = np.partition(score[found], -top)[-top]
        found = found[score[found] >= kth]
    return found, score[found]


def _best(rows: list[tuple[int, object]], top: int) -> list[tuple[int, object]]:
    return sorted(rows, key=lambda r: (-r[0], r[1] is None, r[1] if r[1] is not None else 0))[:top]


def _search(held, top: int, kind: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, weights, documents, all_terms = held.value
        rarest = [np.argsort(-weights[t], kind="stable") for t in items.terms]
        order = [(t[o], r[o]) for t, r, o in zip(items.terms, items.repeats, rarest, strict=True)]
        best: list[list[tuple[int, object]]] = [[] for _ in order]
        for batch in batches:
            ids, n = batch.column(0), np.asarray(batch.column(1))
            slots, tf, ends = np.asarray(batch.column(2).flatten()), np.asarray(batch.column(3).flatten()).astype(np.int64), np.asarray(batch.column(2).value_lengths())
            doc = np.repeat(np.arange(len(n)), ends)
            by = np.argsort(slots, kind="stable")
            slots, tf, doc = slots[by], tf[by], doc[by]
            long = 25 + 75 * n * documents // all_terms
            worth = weights[slots] * (1_000_000_000 * tf // (1000 * tf + 8 * long[doc]))
            starts = np.searchsorted(slots, np.arange(len(items.keys) + 1))
            most = np.zeros(len(items.keys), np.int64)
            held_here = np.flatnonzero(np.diff(starts))
            if len(held_here):
                most[held_here] = np.maximum.reduceat(worth, starts[held_here])
            for i, item in enumerate(order):
                floor = best[i][-1][0] if len(best[i]) == top else 0
                found, score = block_scores(item, starts, doc, worth, most, len(n), floor, top)
                if len(found):
                    best[i] = _best(best[i] + list(zip(score.tolist(), ids.take(pa.array(found)).to_pylist(), strict=True)), top)
        flat = [(i, d, s) for i, rows in enumerate(best) for s, d in rows]
        cols = list(zip(*flat, strict=True)) if flat else [[], [], []]
        yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), pa.array(cols[1], kind), pa.array(cols[2], pa.int64())], ["item", "doc_id", "score"])

    return run


def weight(documents: int, frequency: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * frequency + 1)))


def search(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", top: int = TOP, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Per item its top documents with a score above 0: item_id, rank (from 1, the highest first), doc_id, score.

    Null and empty texts have no terms; items without terms, or that no document matches, give no row. Equal scores stand by ascending id,
    null ids last. Repeated documents are ranked each, repeated items answered each. Whole texts count, however long; terms are compared by
    64-bit fingerprints. Ids are integers or text. Empty tables give an empty result. A benchmark over block_bytes takes one pass a block.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "search")
    picked = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind, item_kind = picked.schema["doc_id"].dataType.simpleString(), benchmark.select(item_col).schema[0].dataType.simpleString()
    arrow = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[kind]
    out = None
    for rows in item_blocks(benchmark, item_col, item_text_col, block_bytes):
        items = Items.of(rows)
        index = scratch.keep(picked.mapInArrow(_index(spark.sparkContext.broadcast(items)), f"doc_id {kind}, n long, slots array<int>, tfs array<int>"))
        documents, all_terms = index.agg(F.count(F.when(F.col("n") > 0, 1)), F.coalesce(F.sum("n"), F.lit(0))).first()
        if not documents:
            continue
        weights = np.full(len(items.keys), weight(documents, 0), np.int64)
        for slot, df in index.select(F.explode("slots").alias("slot")).groupBy("slot").count().collect():  # a row for each term of this block of items
            weights[slot] = weight(documents, df)
        held = spark.sparkContext.broadcast((items, weights, documents, all_terms))
        found = index.mapInArrow(_search(held, top, arrow), f"item int, doc_id {kind}, score long")
        rank = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
        ranked = found.withColumn("rank", rank).where(F.col("rank") <= top)
        names = spark.createDataFrame([(k, i) for k, i in enumerate(items.ids)], f"item int, item_id {item_kind}")
        part = ranked.join(names, "item").select("item_id", "rank", "doc_id", "score")
        out = part if out is None else out.unionByName(part)
    return spark.createDataFrame([], f"item_id {item_kind}, rank int, doc_id {kind}, score long") if out is None else out


_CLASS = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
#: The same result in SQL.
SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_LOWER}, '{_CLASS}') AS t FROM documents),
c AS (SELECT count(*) FILTER (len(t) > 0) AS n, CAST(sum(len(t)) AS BIGINT) AS l FROM d),
p AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(t) AS term FROM d) GROUP BY ALL),
i AS (SELECT row_number() OVER () AS k, item_id, regexp_extract_all({_LOWER}, '{_CLASS}') AS t FROM benchmark),
q AS (SELECT k, item_id, term, count(*) AS qf FROM (SELECT k, item_id, unnest(t) AS term FROM i) GROUP BY ALL),
w AS (SELECT term, CAST(floor(1000 * ln((2 * c.n + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM p, c GROUP BY term, c.n),
s AS (SELECT k, item_id, d.doc_id, CAST(sum(qf * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * len(d.t) * c.n) // c.l)))) AS BIGINT) AS score
      FROM q JOIN p ON p.term = q.term JOIN w ON w.term = q.term JOIN d ON d.r = p.r, c GROUP BY k, item_id, d.r, d.doc_id)
SELECT item_id, CAST(row_number() OVER (PARTITION BY k ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM s WHERE score > 0
QUALIFY row_number() OVER (PARTITION BY k ORDER BY score DESC, doc_id) <= 10
"""
