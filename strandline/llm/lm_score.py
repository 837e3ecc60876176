"""Language-model scoring by deleted interpolation.

P(w | v) mixes three maximum-likelihood estimates, c(vw) / c(v), c(w) / N and 1 / (V + 1). The weights depend on the frequency bucket
of the context v and are learned by expectation-maximisation on held-out counts: every training token is held out from the counts that
predict it (its own occurrence is deleted from c(vw), c(v) and c(w)).

Texts become chunks of word numbers. A chunk asks buckets for the corpus counts of its distinct words and word pairs, all in one
shuffle, and the answers come back in the order of the questions. What EM needs is a histogram of held-out counts of bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm.common import Scratch, crc_mod, mix64
from strandline.llm.shingles import text_slices, words

#: Fixed marks of the two tokens that aren't words.
START, END = np.uint64(0x5354415254), np.uint64(0x454E44)
#: Tokens of one chunk at most (a longer text is a chunk of its own), and bytes of text whose counts one bucket keeps.
CHUNK_TOKENS, BUCKET_TEXT = 1_000_000, 8 << 20
#: Buckets of context frequency (by powers of two), and steps an octave of the histogram's count and ratio classes.
CONTEXTS, STEPS, EM_ROUNDS = 20, 3, 60
_PAIR_BITS = 64


def _squeeze(x: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(np.ascontiguousarray(x).tobytes())


def _swell(raw: bytes, kind: str) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), kind)


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each chunk: ids and training flags of its texts, tokens a text, distinct words, and each token's number among them."""
    # a partition reads the same rows at every attempt, so partition and place name a chunk
    names = count(TaskContext.get().partitionId() << 32)
    parts, waiting = [], 0
    for batch in batches:
        keys = pa.StructArray.from_arrays([batch.column(0), batch.column(1)], ["doc_id", "train"])
        for rows, flat, offsets in text_slices(keys, batch.column(2)):
            mark, text = words(flat, offsets)
            at = np.append(np.searchsorted(text, np.arange(1, len(rows))), len(mark)) if len(rows) else np.zeros(0, np.int64)
            parts.append((rows, np.insert(mark, at, END), np.bincount(text, minlength=len(rows)) + 1))
            waiting += len(parts[-1][1])
            if waiting > CHUNK_TOKENS:
                yield _chunk(parts, next(names))
                parts, waiting = [], 0
    if parts:
        yield _chunk(parts, next(names))


def _chunk(parts: list, name: int) -> pa.RecordBatch:
    rows = pa.concat_arrays([p[0] for p in parts])
    marks, many = np.concatenate([p[1] for p in parts]), np.concatenate([p[2] for p in parts])
    vocabulary, number = np.unique(np.append(marks, START), return_inverse=True)
    train = np.asarray(rows.field("train").fill_null(False)).astype(np.uint8)
    ids = rows.field("doc_id")
    cell = lambda x: pa.array([x], pa.binary())
    return pa.RecordBatch.from_arrays(
        [pa.array([name], pa.int64()), pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids), cell(_squeeze(train)), cell(_squeeze(many.astype("<i8"))), cell(_squeeze(vocabulary)), cell(_squeeze(number[:-1].astype("<u4")))],
        ["chunk", "ids", "train", "many", "vocabulary", "tokens"],
    )


class Chunk:
    """A chunk unpacked: token numbers, the number before each, distinct pairs, and the order in which words and pairs are asked for."""

    def __init__(self, row: dict, buckets: int):
        self.train, self.many = _swell(row["train"], "u1").astype(bool), _swell(row["many"], "<i8")
        self.vocabulary, self.token = _swell(row["vocabulary"], "<u8"), _swell(row["tokens"], "<u4").astype(np.int64)
        self.first = np.cumsum(self.many) - self.many
        self.start = int(np.searchsorted(self.vocabulary, START))
        self.context = np.append(self.start, self.token[:-1])
        self.context[self.first] = self.start
        self.taught = np.repeat(self.train, self.many)
        self.pairs, self.pair = np.unique(self.context << 32 | self.token, return_inverse=True)
        self.word_bucket = (self.vocabulary % np.uint64(buckets)).astype(np.int64)
        self.word_order = np.argsort(self.word_bucket, kind="stable")
        mark = mix64(self.vocabulary[self.pairs >> 32] * np.uint64(0x9E3779B97F4A7C15) + self.vocabulary[self.pairs & 0xFFFFFFFF])
        self.pair_bucket = (mark % np.uint64(buckets)).astype(np.int64)
        self.pair_mark = (mark // np.uint64(buckets)) & np.uint64((1 << _PAIR_BITS) - 1)
        self.pair_order = np.lexsort((self.pair_mark, self.pair_bucket))

    def word_counts(self) -> np.ndarray:
        """Training occurrences of each distinct word; of START, the training texts."""
        counts = np.bincount(self.token[self.taught], minlength=len(self.vocabulary))
        counts[self.start] = self.train.sum()
        return counts

    def pair_counts(self) -> np.ndarray:
        return np.bincount(self.pair[self.taught], minlength=len(self.pairs))


def _ask(buckets: int):
    """(bucket, chunk, words, word_counts, pairs, pair_counts): what a chunk asks each bucket for, and what it adds to the counts."""

    def run(table: pa.Table) -> pa.Table:
        out = {k: [] for k in ("bucket", "chunk", "words", "word_counts", "pairs", "pair_counts")}
        for row in table.drop_columns(["ids"]).to_pylist():
            c = Chunk(row, buckets)
            words_, pairs = c.word_order, c.pair_order
            word_counts, pair_counts = c.word_counts()[words_], c.pair_counts()[pairs]
            small = c.pair_mark[pairs].view(np.uint8).reshape(-1, 8)[:, : _PAIR_BITS // 8]
            w = np.searchsorted(c.word_bucket[words_], np.arange(buckets + 1))
            p = np.searchsorted(c.pair_bucket[pairs], np.arange(buckets + 1))
            for b in np.flatnonzero((np.diff(w) > 0) | (np.diff(p) > 0)):
                out["bucket"].append(int(b))
                out["chunk"].append(row["chunk"])
                out["words"].append(_squeeze(c.vocabulary[words_[w[b] : w[b + 1]]]))
                out["word_counts"].append(_squeeze(word_counts[w[b] : w[b + 1]].astype("<u4")))
                out["pairs"].append(_squeeze(small[p[b] : p[b + 1]].T))
                out["pair_counts"].append(_squeeze(pair_counts[p[b] : p[b + 1]].astype("<u4")))
        return pa.table(out, schema=_ASKED)

    return run


_ASKED = pa.schema([("bucket", pa.int64()), ("chunk", pa.int64()), ("words", pa.binary()), ("word_counts", pa.binary()), ("pairs", pa.binary()), ("pair_counts", pa.binary())])
_ASKED_SQL = "bucket long, chunk long, words binary, word_counts binary, pairs binary, pair_counts binary"
_TOLD_SQL = "chunk long, bucket long, words binary, pairs binary"


def _totals(asked: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """(distinct, total of each, totals in the order of each question)."""
    distinct, where = np.unique(np.concatenate(asked), return_inverse=True)
    total = np.bincount(where, weights=np.concatenate(counts).astype(np.float64), minlength=len(distinct)).astype("<u8")
    return distinct, total, np.split(total[where], np.cumsum([len(a) for a in asked])[:-1])


def _tell(key: tuple, table: pa.Table) -> pa.Table:
    """Answers of one bucket, and one row below zero, under a key of its own, with its training tokens and distinct training words."""
    word_marks = [_swell(x.as_py(), "<u8") for x in table["words"]]
    pair_marks = []
    for x in table["pairs"]:
        small = _swell(x.as_py(), "u1").reshape(_PAIR_BITS // 8, -1).T
        wide = np.zeros((len(small), 8), np.uint8)
        wide[:, : small.shape[1]] = small
        pair_marks.append(wide.view("<u8").reshape(-1))
    distinct, total, told_words = _totals(word_marks, [_swell(x.as_py(), "<u4") for x in table["word_counts"]])
    _, _, told_pairs = _totals(pair_marks, [_swell(x.as_py(), "<u4") for x in table["pair_counts"]])
    total = total[distinct != START]
    sums = np.array([total.sum(), (total > 0).sum()], "<u8")
    bucket = key[0].as_py()
    return pa.table({
        "chunk": pa.array([*table["chunk"].to_pylist(), -1 - bucket], pa.int64()),
        "bucket": pa.array([bucket] * (len(table) + 1), pa.int64()),
        "words": pa.array([*map(_squeeze, told_words), _squeeze(sums)], pa.binary()),
        "pairs": pa.array([*map(_squeeze, told_pairs), b""], pa.binary()),
    })


def count_class(c: np.ndarray) -> np.ndarray:
    """Class of a count: itself below 16, then STEPS classes an octave."""
    c = np.asarray(c, np.float64)
    return np.where(c < 16, c, 16 + np.floor(STEPS * np.log2(np.maximum(c, 16) / 16))).astype(np.int64)


def class_count(k: np.ndarray) -> np.ndarray:
    """A count in the middle of its class."""
    return np.where(k < 16, k, 16 * 2 ** ((k - 16 + 0.5) / STEPS)).astype(np.float64)


def ratio_class(r: np.ndarray) -> np.ndarray:
    """0 for 0, and then STEPS classes an octave down from 1."""
    return np.where(r > 0, 1 + np.floor(-STEPS * np.log2(np.maximum(r, 1e-12)) + 0.5), 0).astype(np.int64)


def class_ratio(k: np.ndarray) -> np.ndarray:
    return np.where(k > 0, 2.0 ** (-(k - 1.0) / STEPS), 0.0)


def context_bucket(c: np.ndarray) -> np.ndarray:
    """0 for a context that wasn't seen, and then one bucket for each power of two."""
    return np.minimum(CONTEXTS - 1, np.frexp(np.asarray(c, np.float64))[1])


_MERGED_SQL = "kind int, cell long, weight long, ids array<{id}>, many binary, tokens binary, word_counts binary, pair_counts binary"


def _merge(buckets: int, id_type: pa.DataType):
    schema = pa.schema([("kind", pa.int32()), ("cell", pa.int64()), ("weight", pa.int64()), ("ids", pa.list_(id_type)), ("many", pa.binary()), ("tokens", pa.binary()), ("word_counts", pa.binary()), ("pair_counts", pa.binary())])

    def run(chunks: pa.Table, told: pa.Table) -> pa.Table:
        """Kind 0: a chunk with the corpus counts of its words and pairs; 1: the histogram of its held-out counts; 2: a bucket's N and V."""
        rows, parts = [], []
        if len(chunks) == 0:
            sums = np.sum([_swell(x.as_py(), "<u8") for x in told["words"]], axis=0)
            return pa.Table.from_pylist([{"kind": 2, "cell": int(sums[1]), "weight": int(sums[0])}], schema)
        order = np.argsort(np.asarray(told["bucket"]))
        answers = {k: np.concatenate([_swell(told[k][int(i)].as_py(), "<u8") for i in order]) for k in ("words", "pairs")}
        for row in chunks.to_pylist():
            c = Chunk(row, buckets)
            words_, pairs = np.zeros(len(c.vocabulary), np.int64), np.zeros(len(c.pairs), np.int64)
            words_[c.word_order], pairs[c.pair_order] = answers["words"], answers["pairs"]
            rows.append({"kind": 0, "ids": row["ids"], "many": row["many"], "tokens": row["tokens"], "word_counts": _squeeze(np.append(words_, c.start)), "pair_counts": _squeeze(pairs)})
            # a training pair is held out from its own counts
            weight = c.pair_counts()
            seen = np.flatnonzero(weight)
            context = np.maximum(words_[c.pairs[seen] >> 32] - 1, 0)
            ratio = np.maximum(pairs[seen] - 1, 0) / np.maximum(context, 1)
            cell = (context_bucket(context) * 1024 + ratio_class(ratio)) * 1024 + count_class(np.maximum(words_[c.pairs[seen] & 0xFFFFFFFF] - 1, 0))
            cells, where = np.unique(cell, return_inverse=True)
            total = np.bincount(where, weights=weight[seen], minlength=len(cells)).astype(np.int64)
            parts.append(pa.table({"kind": pa.array(np.ones(len(cells), np.int32)), "cell": pa.array(cells), "weight": pa.array(total)}))
        return pa.concat_tables([pa.Table.from_pylist(rows, schema), *parts], promote_options="default").cast(schema)

    return run


def learn_weights(cells: np.ndarray, weight: np.ndarray, tokens: int, types: int) -> np.ndarray:
    """(CONTEXTS, 3) mixture weights of pair, word and uniform estimate, by EM on the histogram of held-out counts."""
    out = np.tile([0.0, 0.5, 0.5], (CONTEXTS, 1))
    bucket, ratio, count = cells // (1024 * 1024), cells // 1024 % 1024, cells % 1024
    for b in range(CONTEXTS):
        mine = bucket == b
        if not mine.any():
            out[b] = out[b - 1] if b else out[b]
            continue
        p = np.stack([class_ratio(ratio[mine]), class_count(count[mine]) / max(1, tokens - 1), np.full(mine.sum(), 1.0 / (types + 1))], axis=1)
        w = np.full(3, 1 / 3)
        for _ in range(EM_ROUNDS):
            share = p * w
            share *= (weight[mine] / share.sum(axis=1))[:, None]
            w = share.sum(axis=0) / share.sum()
        w = np.maximum(w, [0.0, 1e-9, 1e-6])
        out[b] = w / w.sum()
    return out


def _score(weights: np.ndarray, tokens: int, types: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                ids = batch["ids"][i].values
                many, token = _swell(batch["many"][i].as_py(), "<i8"), _swell(batch["tokens"][i].as_py(), "<u4").astype(np.int64)
                counts, pairs = _swell(batch["word_counts"][i].as_py(), "<i8"), _swell(batch["pair_counts"][i].as_py(), "<i8")
                counts, start = counts[:-1], int(counts[-1])
                first = np.cumsum(many) - many
                context = np.append(start, token[:-1])
                context[first] = start
                pair = pairs[np.unique(context << 32 | token, return_inverse=True)[1]]
                seen, before = counts[token].astype(np.float64), counts[context].astype(np.float64)
                mix = weights[context_bucket(before)]
                p = mix[:, 0] * pair / np.maximum(before, 1) + mix[:, 1] * seen / max(1, tokens) + mix[:, 2] / (types + 1)
                base = np.log10((seen + 1) / (tokens + 1 * (types + 1)))
                known = np.add.reduceat((seen > 0).astype(np.int64), first)
                yield pa.RecordBatch.from_arrays([ids, pa.array(many), pa.array(known), pa.array(np.add.reduceat(base, first)), pa.array(np.add.reduceat(np.log10(p), first))], ["doc_id", "n_tokens", "n_known", "base_score", "score"])

    return run


def score_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 7, held: int = 2) -> DataFrame:
    """Per row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10 probability under the mixture).

    Learned from the rows whose crc32(id as text) modulo folds isn't held. Tokens are the words `[^\\x20\\x09-\\x0D]+` with A-Z in lower
    case and one end. A null or empty text is the end alone. A row with a null id teaches nothing and has a null held_out. Repeated rows
    count and are scored as texts of their own. Words are told apart by 64-bit fingerprints, pairs by 40 bits besides their bucket. An
    empty table gives an empty result; with nothing to learn from every token has probability 1.
    """
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession, "lm")
    picked = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).select("doc_id", (crc_mod(F.col("doc_id"), folds) != held).alias("train"), "text")
    id_type = picked.schema["doc_id"].dataType.simpleString()
    total = picked.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(64, -(-total // BUCKET_TEXT))
    chunks = picked.mapInArrow(_chunks, f"chunk long, ids array<{id_type}>, train binary, many binary, vocabulary binary, tokens binary")
    asked = chunks.groupBy("chunk").applyInArrow(_ask(buckets), _ASKED_SQL)
    told = asked.groupBy("bucket").applyInArrow(_tell, _TOLD_SQL)
    arrow_id = {"string": pa.string(), "int": pa.int32()}.get(id_type, pa.int64())
    merged = scratch.keep(chunks.groupBy("chunk").cogroup(told.groupBy("chunk")).applyInArrow(_merge(buckets, arrow_id), _MERGED_SQL.format(id=id_type)))

    sums = merged.where("kind = 2").agg(F.sum("weight"), F.sum("cell")).first()
    tokens, types = int(sums[0] or 0), int(sums[1] or 0)
    # at most CONTEXTS * 1024 * 1024 cells, whatever the input
    cells = merged.where("kind = 1").groupBy("cell").agg(F.sum("weight").alias("weight")).toArrow()
    weights = learn_weights(np.asarray(cells["cell"]), np.asarray(cells["weight"]).astype(np.float64), tokens, types)
    scored = merged.where("kind = 0").select("ids", "many", "tokens", "word_counts", "pair_counts").mapInArrow(_score(weights, tokens, types), f"doc_id {id_type}, n_tokens long, n_known long, base_score double, score double")
    return scored.select("doc_id", (crc_mod(F.col("doc_id"), folds) == held).alias("held_out"), "n_tokens", "n_known", F.lit(tokens).cast("long").alias("train_tokens"), "base_score", "score")
