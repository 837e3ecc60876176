"""Suffix-array dedup by column-wise construction over many short documents.

A LENGTH-byte string is removed where it also starts in a document with a smaller id. Every LENGTH-byte window has an anchor, the K-gram
in it that comes first in one global order (rare first, by a frequency sketch over all texts, then by hash), and equal windows have equal
anchors at equal places. Consecutive windows with one anchor form a piece of at most 2 LENGTH - K bytes. Texts are gathered in chunks;
a chunk first asks which of its anchors another chunk has as well (5 bytes an anchor), and then deals only the pieces of such anchors to
buckets by anchor, so that all windows that could be equal meet. Each bucket is a collection of many short documents: the pieces that have
a window's length around their anchor in common with another one, cut to that. An anchor with very many different texts is taken in
several collections, by where it stands in the windows and by the bytes that those share.

In a bucket the Burrows-Wheeler transform and the common prefixes of the collection are built column by column from the right: each
round puts the next symbol in front of every piece's suffix, and the whole list is read once in order and dealt to one run per symbol,
which is the next list; the common prefix of neighbours is one more than the least common prefix between them in the old list. Windows
whose common prefix is LENGTH or more are equal. Runs are appended and read in sequence; between tasks they are Spark's shuffle files.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator
from itertools import count

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm.shingles import text_slices

LENGTH, K = 50, 24
WIDTH = 2 * LENGTH - K
#: Bytes of text whose pieces one bucket takes, of a slice that is cut at once, and pieces that one construction takes.
BUCKET_TEXT, SLICE_BYTES, COLLECTION = 8 << 20, 4 << 20, 20_000
#: Windows whose anchors are found at once (fewer than 2^20 less LENGTH).
ANCHOR_BLOCK = 128 << 10
#: Bytes of an anchor's hash that a chunk asks with, besides what its bucket says.
ASK_BYTES = 5
_ASK_SHIFT = 8 * ASK_BYTES
#: The sketch has a counter for about 1024 bytes of text, at most 2^MAX_BITS of one byte each when sent.
MIN_BITS, MAX_BITS, BLOCK_BITS = 16, 26, 14


def gram_hashes(flat: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each run of K bytes."""
    n = len(flat) - K + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    raw = np.ascontiguousarray(flat)
    return _gram_hash(*(np.ndarray((n,), "<u8", raw, k, (1,)) for k in range(0, K, 8)))


def _gram_hash(first: np.ndarray, second: np.ndarray, third: np.ndarray) -> np.ndarray:
    mark = (second ^ (second >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    mark += first * np.uint64(0x9E3779B97F4A7C15)
    mark += (third ^ (third >> np.uint64(29))) * np.uint64(0xD6E8FEB86659FD93)
    mark ^= mark >> np.uint64(32)
    mark *= np.uint64(0x94D049BB133111EB)
    mark ^= mark >> np.uint64(29)
    return mark


def window_anchors(flat: np.ndarray, classes: np.ndarray, bits: int) -> np.ndarray:
    """For each LENGTH-byte window of flat: how far in its anchor starts, by frequency class and then hash; block by block."""
    n = len(flat) - LENGTH + 1
    out, width = np.zeros(max(0, n), np.uint8), LENGTH - K + 1
    for begin in range(0, n, ANCHOR_BLOCK):
        end = min(n, begin + ANCHOR_BLOCK)
        hashes = gram_hashes(flat[begin : end + LENGTH - 1])
        place = np.arange(len(hashes), dtype=np.uint64)
        rank = classes[(hashes >> np.uint64(64 - bits)).view(np.int64)].astype(np.uint64)
        low = (rank << np.uint64(56)) | ((hashes >> np.uint64(28)) << np.uint64(20)) | place
        span = 1
        while span * 2 <= width:
            low = np.minimum(low[:-span], low[span:])
            span *= 2
        if span < width:
            low = np.minimum(low[: len(low) - (width - span)], low[width - span :])
        out[begin:end] = (low & np.uint64((1 << 20) - 1)).view(np.int64) - np.arange(end - begin)
    return out


def cut_pieces(flat: np.ndarray, offsets: np.ndarray, classes: np.ndarray, bits: int) -> tuple[np.ndarray, ...]:
    """(document, start, length, anchor place) of each piece of a slice; classes is the frequency sketch of K-grams."""
    none = (np.zeros(0, np.int64),) * 4
    if len(flat) < LENGTH:
        return none
    inside = np.ones(len(flat) - LENGTH + 1, bool)
    for end in offsets[1:-1].tolist():
        inside[max(0, end - LENGTH + 1) : end] = False
    anchor = window_anchors(flat, classes, bits)
    fresh = inside.copy()
    # the anchor stays the same where its place in the window falls by one
    fresh[1:] &= ~inside[:-1] | (anchor[1:] + np.uint8(1) != anchor[:-1])
    first = np.flatnonzero(fresh)
    if not len(first):
        return none
    windows = np.diff(np.append(np.cumsum(inside, dtype=np.int32)[first] - 1, np.count_nonzero(inside)))
    return np.searchsorted(offsets, first, side="right") - 1, first, windows + LENGTH - 1, anchor[first].astype(np.int64)


def grams_at(flat: np.ndarray, place: np.ndarray) -> np.ndarray:
    """The hashes of the K-grams of flat at these places."""
    if not len(place):
        return np.zeros(0, np.uint64)
    return _gram_hash(*np.ndarray((len(flat) - K + 1, K), np.uint8, np.ascontiguousarray(flat), 0, (1, 1))[place].view("<u8").T)


def piece_rows(flat: np.ndarray, first: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The pieces as rows of WIDTH bytes padded to whole words, zero behind the end."""
    padded = np.append(flat, np.zeros(_WIDE, np.uint8))
    rows = np.ndarray((len(padded) - _WIDE + 1, _WIDE), np.uint8, padded, 0, (1, 1))[first]
    words = rows.view("<u8")
    words &= _MASKS[length]
    return rows


#: Bytes of a padded row, and for each length the words that keep its bytes.
_WIDE = -(-WIDTH // 8) * 8
_MASKS = np.where(np.arange(_WIDE)[None, :] < np.arange(_WIDE + 1)[:, None], np.uint8(255), np.uint8(0)).view("<u8")


def same_rows(rows: np.ndarray, length: np.ndarray, anchor: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(order, fresh): equal rows of equal length (and anchor) stand together in order; fresh marks the first of each."""
    words = rows.view("<u8")
    mark = length.astype(np.uint64)
    for i in range(words.shape[1]):
        mark = (mark ^ (mark >> np.uint64(29))) * np.uint64(0xD6E8FEB86659FD93) + words[:, i]
    order = np.argsort(mark) if anchor is None else np.lexsort((mark, anchor))
    fresh = np.ones(len(rows), bool)
    fresh[1:] = (words[order[1:]] != words[order[:-1]]).any(axis=1)
    for key in (length, anchor) if anchor is not None else (length,):
        fresh[1:] |= key[order[1:]] != key[order[:-1]]
    return order, fresh


#: Whole part of the logarithm (base 2) of each number.
_LEVEL = (np.frexp(np.arange(1 << 20).astype(np.float64))[1] - 1).astype(np.int8)


def _levels(n: np.ndarray) -> np.ndarray:
    if n.max(initial=0) < len(_LEVEL):
        return _LEVEL[n].astype(np.int64)
    return np.frexp(n.astype(np.float64))[1].astype(np.int64) - 1


def equal_windows(rows: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(group, piece, offset) of each LENGTH-byte window of the pieces that equals another: the column-wise construction."""
    n = len(rows)
    symbol = np.zeros((n, WIDTH + 1), np.int16)  # symbol[i, l] stands before the suffix of l bytes; 0 before a whole piece
    for size in np.unique(length):
        mine = length == size
        symbol[mine, :size] = rows[mine, :size][:, ::-1].astype(np.int16) + 1
    empty = np.arange(n, dtype=np.int32)
    piece, size, common = empty, np.zeros(n, np.int16), np.zeros(n, np.uint8)
    for _ in range(int(length.max())):
        before = symbol[piece, size]
        order = np.argsort(before, kind="stable")
        order = order[np.searchsorted(before[order], 1) :]
        # the least common prefix between neighbours of the new list, over the old list's (earlier, later]
        kept = before[order]
        together = np.flatnonzero(kept[1:] == kept[:-1])
        begin, end = order[together] + 1, order[together + 1]
        level = _levels(end - begin + 1)
        tables = [common]
        for k in range(int(level.max(initial=0))):
            last = tables[-1]
            tables.append(np.append(np.minimum(last[: -(1 << k)], last[1 << k :]), np.zeros(1 << k, np.uint8)))
        table = np.concatenate(tables)
        base = level * len(common)
        least = np.zeros(len(order), np.uint8)
        least[together + 1] = np.minimum(table[base + begin], table[base + end + 1 - (np.int64(1) << level)]) + 1
        piece = np.append(empty, piece[order])
        size = np.append(np.zeros(n, np.int16), size[order] + 1)
        common = np.append(np.zeros(n, np.uint8), least)
    same = common >= LENGTH
    run = np.cumsum(~same)
    used = same | np.append(same[1:], False)
    return run[used], piece[used], (length[piece] - size)[used]


def shared_reach(rows: np.ndarray, length: np.ndarray, place: np.ndarray, anchor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How many bytes before and behind its anchor each piece has in common with some other piece of that anchor, LENGTH - K at most.

    A window that two pieces share lies within what they share, so pieces with less than a window's length need not be looked at, and of
    the others only that part.
    """
    far, steps = LENGTH - K, np.arange(LENGTH - K)
    out = []
    for at in (place[:, None] - 1 - steps, place[:, None] + K + steps):
        there = (at >= 0) & (at < length[:, None])
        side = np.where(there, np.take_along_axis(rows, np.clip(at, 0, rows.shape[1] - 1), axis=1).astype(np.int16) + 1, 0)
        order = np.lexsort([*side.T[::-1], anchor])
        sides, anchors = side[order], anchor[order]
        same = (sides[1:] == sides[:-1]) & (sides[1:] > 0) & (anchors[1:] == anchors[:-1])[:, None]
        reach = np.where(same.all(axis=1), far, same.argmin(axis=1))
        most = np.zeros(len(rows), np.int64)
        most[order] = np.maximum(np.append(0, reach), np.append(reach, 0))
        out.append(most)
    return out[0], out[1]


def _pack(own: np.ndarray, ids: np.ndarray, doc: np.ndarray, start: np.ndarray, length: np.ndarray, place: np.ndarray, rows: np.ndarray) -> bytes:
    """Some of a chunk's pieces, in document order: place of the document in the chunk and its id, start, length, anchor, and the bytes."""
    text = rows[np.arange(rows.shape[1])[None, :] < length[:, None]].tobytes()
    parts = [own[doc], ids[doc], start]
    return struct.pack("<q", len(doc)) + b"".join(p.astype("<i8").tobytes() for p in parts) + length.astype("u1").tobytes() + place.astype("u1").tobytes() + text


def _unpack(raw: bytes) -> tuple[np.ndarray, ...]:
    (n,) = struct.unpack_from("<q", raw)
    own, ids, start = np.frombuffer(raw, "<i8", 3 * n, 8).reshape(3, n)
    at = 8 + 24 * n
    length, place = np.frombuffer(raw, "u1", n, at).astype(np.int64), np.frombuffer(raw, "u1", n, at + n).astype(np.int64)
    return own, ids, start, length, place, piece_rows(np.frombuffer(raw, "u1", -1, at + 2 * n), np.cumsum(length) - length, length)


def frequency_classes(docs: DataFrame, bits: int) -> np.ndarray:
    """For each counter of a sketch over the K-grams of all texts: four times the logarithm (base 2) of its count."""
    block = min(bits, BLOCK_BITS)

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(1 << bits, np.uint32)
        for batch in batches:
            for _, flat, _ in text_slices(batch.column(0), batch.column(0), ANCHOR_BLOCK):
                np.add.at(seen, (gram_hashes(flat) >> np.uint64(64 - bits)).astype(np.int64), np.uint32(1))
        parts, pack = seen.reshape(-1, 1 << block), zstandard.ZstdCompressor(level=1).compress
        some = np.flatnonzero(parts.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array([pack(parts[i].tobytes()) for i in some], pa.binary())], ["block", "counts"])

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        total, unpack = np.zeros(1 << block, np.uint64), zstandard.ZstdDecompressor().decompress
        for blob in pdf["counts"]:
            total += np.frombuffer(unpack(blob), np.uint32)
        return pd.DataFrame({"block": pdf["block"][:1], "classes": [np.rint(4 * np.log2(total + 1.0)).astype(np.uint8).tobytes()]})

    out = np.zeros(1 << bits, np.uint8).reshape(-1, 1 << block)
    for r in docs.select("text").mapInArrow(tally, "block long, counts binary").groupBy("block").applyInPandas(add, "block long, classes binary").toLocalIterator():
        out[r["block"]] = np.frombuffer(r["classes"], np.uint8)
    return out.reshape(-1)


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each chunk of whole texts: its name (partition and place), ids, where each text ends, and the bytes."""
    pack, names = zstandard.ZstdCompressor(level=3).compress, count(TaskContext.get().partitionId() << 40)
    for batch in batches:
        for ids, flat, offsets in text_slices(batch.column(0), batch.column(1), SLICE_BYTES):
            body = flat.tobytes()
            yield pa.RecordBatch.from_arrays([pa.array([next(names)], pa.int64()), pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids), pa.array([offsets.astype("<i8").tobytes()], pa.binary()), pa.array([pack(body)], pa.binary())], ["chunk", "ids", "offsets", "body"])


class Cut:
    """A chunk's pieces. Those that an equal piece of a smaller id of the chunk covers are late; the others may ask and be dealt."""

    def __init__(self, row: dict, classes: np.ndarray, bits: int, buckets: int):
        self.offsets = np.frombuffer(row["offsets"], "<i8")
        flat = np.frombuffer(zstandard.ZstdDecompressor().decompress(row["body"]), np.uint8) if self.offsets[-1] else np.zeros(0, np.uint8)
        named = np.array([i is not None for i in row["ids"]], bool)
        self.ids = np.array([i if i is not None else 0 for i in row["ids"]], np.int64)
        doc, start, length, place = cut_pieces(flat, self.offsets, classes, bits)
        keep = named[doc]
        self.doc, first, self.length, self.place = doc[keep], start[keep], length[keep], place[keep]
        self.rows, self.start = piece_rows(flat, first, self.length), first - self.offsets[self.doc]
        self.anchor = grams_at(flat, first + self.place)
        self.late = np.zeros(len(first), bool)
        if len(first):
            order, fresh = same_rows(self.rows, self.length)
            own = self.ids[self.doc[order]]
            self.late[order] = own > np.minimum.reduceat(own, np.flatnonzero(fresh))[np.cumsum(fresh) - 1]
        stay = np.flatnonzero(~self.late)
        # by bucket and then by the anchor's lower bits; should anchors that differ there alternate, they ask more than once
        key = (self.anchor[stay] % np.uint64(buckets) << np.uint64(_ASK_SHIFT)) | (self.anchor[stay] // np.uint64(buckets) & np.uint64((1 << _ASK_SHIFT) - 1))
        self.stay = stay[np.argsort(key)]
        marks = self.anchor[self.stay]
        self.head = np.flatnonzero(np.append(True, marks[1:] != marks[:-1])) if len(marks) else np.zeros(0, np.int64)
        self.bucket = (marks[self.head] % np.uint64(buckets)).astype(np.int64)
        self.ask = marks[self.head] // np.uint64(buckets) & np.uint64((1 << _ASK_SHIFT) - 1)


_TABLE = "bucket long, chunk long, body binary"


def _table(bucket, chunk, body) -> pa.Table:
    return pa.table({"bucket": pa.array(bucket, pa.int64()), "chunk": pa.array(chunk, pa.int64()), "body": pa.array(body, pa.binary())})


def _by_bucket(bucket: np.ndarray) -> Iterator[tuple[int, int, int]]:
    cuts = [0, *(np.flatnonzero(np.diff(bucket)) + 1).tolist(), len(bucket)] if len(bucket) else [0]
    yield from ((int(bucket[a]), a, b) for a, b in zip(cuts[:-1], cuts[1:], strict=True))


def _ask(classes, bits: int, buckets: int):
    """The anchors of each chunk, once each, by bucket."""

    def run(chunks: pa.Table) -> pa.Table:
        out = [[], [], []]
        for row in chunks.to_pylist():
            c = Cut(row, classes.value, bits, buckets)
            small = np.ascontiguousarray(c.ask).view("u1").reshape(-1, 8)[:, :ASK_BYTES]
            for b, i, j in _by_bucket(c.bucket):
                for column, v in zip(out, (b, row["chunk"], small[i:j].T.tobytes()), strict=True):
                    column.append(v)
        return _table(*out)

    return run


def _tell(table: pa.Table) -> pa.Table:
    """For each chunk that asked this bucket: a bit for each anchor, in the order asked, set if another chunk asked for it."""
    asked = []
    for body in table["body"]:
        small = np.frombuffer(body.as_py(), "u1").reshape(ASK_BYTES, -1).T
        wide = np.zeros((len(small), 8), np.uint8)
        wide[:, :ASK_BYTES] = small
        asked.append(wide.view("<u8").reshape(-1))
    _, where, many = np.unique(np.concatenate(asked), return_inverse=True, return_counts=True)
    shared = np.split(many[where] > 1, np.cumsum([len(a) for a in asked])[:-1])
    return _table(table["bucket"], table["chunk"], [np.packbits(x).tobytes() for x in shared])


def _deal(classes, bits: int, buckets: int):
    """Pieces whose anchor another chunk or another document of the chunk has, by bucket; spans of late pieces, in buckets below zero."""

    def run(chunks: pa.Table, told: pa.Table) -> pa.Table:
        out, pack = [[], [], []], zstandard.ZstdCompressor(level=3).compress
        bits_of = {(c, b): body for c, b, body in zip(told["chunk"].to_pylist(), told["bucket"].to_pylist(), told["body"].to_pylist(), strict=True)}
        for row in chunks.to_pylist():
            c = Cut(row, classes.value, bits, buckets)
            late = np.flatnonzero(c.late)
            if len(late):
                for column, v in zip(out, (-1, row["chunk"], _spans(c.doc[late], c.start[late], (c.start + c.length)[late])), strict=True):
                    column.append(v)
            if not len(c.stay):
                continue
            shared = np.zeros(len(c.head), bool)
            for b, i, j in _by_bucket(c.bucket):
                shared[i:j] = np.unpackbits(np.frombuffer(bits_of[row["chunk"], b], "u1"), count=j - i).astype(bool)
            own = c.doc[c.stay]
            shared |= np.minimum.reduceat(own, c.head) < np.maximum.reduceat(own, c.head)
            many = np.diff(np.append(c.head, len(c.stay)))
            chosen, bucket = c.stay[np.repeat(shared, many)], np.repeat(c.bucket, many)[np.repeat(shared, many)]
            for b, i, j in _by_bucket(bucket):
                g = np.sort(chosen[i:j])
                for column, v in zip(out, (b, row["chunk"], pack(_pack(np.arange(len(c.ids)), c.ids, c.doc[g], c.start[g], c.length[g], c.place[g], c.rows[g]))), strict=True):
                    column.append(v)
        return _table(*out)

    return run


def _spans(doc: np.ndarray, start: np.ndarray, end: np.ndarray) -> bytes:
    return np.stack([doc, start, end]).astype("<i8").tobytes()


def merge_spans(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs that the half-open spans cover together."""
    if not len(start):
        return start, end
    order = np.argsort(start, kind="stable")
    start, end = start[order], np.maximum.accumulate(end[order])
    fresh = np.append(True, start[1:] > end[:-1])
    return start[fresh], end[np.append(np.flatnonzero(fresh)[1:] - 1, len(end) - 1)]


def _collections(texts: np.ndarray, groups: np.ndarray, pieces_of: np.ndarray, rows: np.ndarray, length: np.ndarray, place: np.ndarray) -> Iterator[tuple[np.ndarray, int, int]]:
    """Texts in collections of at most COLLECTION: (texts, least and most bytes before the anchor of the windows that are compared there).

    Texts of one anchor stay together; an anchor of more texts, such as a line with a counter, is narrowed by _narrow().
    """
    name, begin = groups[texts], 0
    while begin < len(texts):
        end = min(len(texts), begin + COLLECTION)
        if end < len(texts) and name[end] == name[end - 1]:
            end = int(np.searchsorted(name, name[end]))
            if end == begin:
                end = int(np.searchsorted(name, name[begin], side="right"))
                yield from _narrow(texts[begin:end], pieces_of, rows, length, place, 0, LENGTH - K)
                begin = end
                continue
        yield texts[begin:end], 0, LENGTH - K
        begin = end


def _narrow(part: np.ndarray, pieces_of: np.ndarray, rows: np.ndarray, length: np.ndarray, place: np.ndarray, low: int, high: int) -> Iterator[tuple[np.ndarray, int, int]]:
    """Collections of one anchor's texts, for windows with low to high bytes before it.

    The windows are split in two by where the anchor stands in them. All windows of a half hold certain bytes on both sides of the anchor, so
    only texts that agree in those can have equal ones; where such texts are still too many, their half is split again. In the end windows
    have one place, and texts that agree in all their bytes have one window.
    """
    middle = (low + high) // 2
    for least, most in ((low, middle), (middle + 1, high)):
        at = pieces_of[part]
        fits = (place[at] >= least) & (length[at] - place[at] >= LENGTH - most)
        mine, at = part[fits], at[fits]
        if len(mine) < 2:
            continue
        agreed = np.ascontiguousarray(rows[at[:, None], (place[at] - least)[:, None] + np.arange(least + LENGTH - most)[None, :]])
        group = np.unique(agreed.view(f"V{agreed.shape[1]}").reshape(-1), return_inverse=True)[1]
        by = np.argsort(group, kind="stable")
        starts = np.flatnonzero(np.append(True, np.diff(group[by]) != 0))
        waiting: list[np.ndarray] = []
        for a, b in zip(starts, np.append(starts[1:], len(by)), strict=True):
            if b - a < 2:
                continue
            some = mine[by[a:b]]
            if least == most:
                yield some, least, most
            elif len(some) > COLLECTION:
                yield from _narrow(some, pieces_of, rows, length, place, least, most)
            else:
                if sum(map(len, waiting)) + len(some) > COLLECTION:
                    yield np.concatenate(waiting), least, most
                    waiting = []
                waiting.append(some)
        if waiting:
            yield np.concatenate(waiting), least, most


def _bucket_spans(table: pa.Table) -> pa.Table:
    """Spans to remove that one bucket finds, a row for each chunk."""
    unpack = zstandard.ZstdDecompressor().decompress
    parts = [_unpack(unpack(b.as_py())) for b in table["body"]]
    chunk = np.repeat(np.asarray(table["chunk"]), [len(p[0]) for p in parts])
    own, doc, start, length, place, rows = (np.concatenate(c) for c in zip(*parts, strict=True))
    at = np.arange(len(rows))[:, None]
    gram = np.ascontiguousarray(rows[at, place[:, None] + np.arange(K)[None, :]]).view("<u8")
    anchor = _gram_hash(*gram.T)
    order, fresh = same_rows(rows, length, anchor)
    text, first = np.cumsum(fresh) - 1, np.flatnonzero(fresh)
    least = np.minimum.reduceat(doc[order], first)
    late = doc[order] > least[text]
    got = [(order[late], np.zeros(late.sum(), np.int64), length[order[late]])]
    # only anchors with different texts of different documents can hold further equal windows
    heads = np.flatnonzero(np.append(True, anchor[order[first]][1:] != anchor[order[first]][:-1]))
    many = np.diff(np.append(heads, len(first)))
    groups = np.repeat(np.arange(len(heads)), many)
    texts = np.flatnonzero(np.repeat((many > 1) & (np.minimum.reduceat(least, heads) < np.maximum.reduceat(least, heads)), many))
    early = order[~late]
    entries_of = np.argsort(text[~late], kind="stable")
    bounds = np.searchsorted(text[~late][entries_of], np.arange(len(first) + 1))
    pieces_of = order[first]
    for part, least_before, most_before in _collections(texts, groups, pieces_of, rows, length, place):
        at = pieces_of[part]
        if least_before == most_before:
            # one window, which all of the part hold
            owner = part[least[part] > least[part].min()]
            offset = place[pieces_of[owner]] - least_before
        else:
            before, behind = shared_reach(rows[at], length[at], place[at], anchor[at])
            before, behind = np.minimum(before, most_before), np.minimum(behind, LENGTH - K - least_before)
            wide = before + behind >= LENGTH - K
            part, at, before, behind = part[wide], at[wide], before[wide], behind[wide]
            if not len(part):
                continue
            cut, size = place[at] - before, K + before + behind
            group, piece, offset = equal_windows(piece_rows(rows[at].reshape(-1), np.arange(len(at)) * rows.shape[1] + cut, size), size)
            if not len(group):
                continue
            offset += cut[piece]
            fresh_group = np.append(True, group[1:] != group[:-1])
            low = np.minimum.reduceat(least[part[piece]], np.flatnonzero(fresh_group))[np.cumsum(fresh_group) - 1]
            hit = least[part[piece]] > low
            owner, offset = part[piece[hit]], offset[hit]
        size = bounds[owner + 1] - bounds[owner]
        entry = early[entries_of[np.repeat(bounds[owner] - np.cumsum(size) + size, size) + np.arange(size.sum())]]
        got.append((entry, np.repeat(offset, size), np.full(len(entry), LENGTH)))
    entry, offset, size = (np.concatenate([g[k] for g in got]) for k in range(3))
    by = np.argsort(chunk[entry], kind="stable")
    entry, begin, end = entry[by], (start[entry] + offset)[by], (start[entry] + offset + size)[by]
    spans = [(c, _spans(own[entry[i:j]], begin[i:j], end[i:j])) for c, i, j in _by_bucket(chunk[entry])]
    return _table([-1] * len(spans), [c for c, _ in spans], [b for _, b in spans])


def _digest(chunks: pa.Table, spans: pa.Table) -> pa.Table:
    """n_bytes, n_removed, n_spans and kept_sha256 of each document of a chunk."""
    out = {"doc_id": [], "n_bytes": [], "n_removed": [], "n_spans": [], "kept_sha256": []}
    found = [np.frombuffer(b.as_py(), "<i8").reshape(3, -1) for b in spans["body"]]
    doc, start, end = np.concatenate(found, axis=1) if found else np.zeros((3, 0), np.int64)
    order = np.argsort(doc, kind="stable")
    doc, start, end = doc[order], start[order], end[order]
    for row in chunks.to_pylist():
        offsets = np.frombuffer(row["offsets"], "<i8")
        flat = zstandard.ZstdDecompressor().decompress(row["body"]) if offsets[-1] else b""
        bounds = np.searchsorted(doc, np.arange(len(offsets)))
        for i, id_ in enumerate(row["ids"]):
            raw = flat[offsets[i] : offsets[i + 1]]
            a, b = merge_spans(start[bounds[i] : bounds[i + 1]], end[bounds[i] : bounds[i + 1]])
            kept = b"".join(raw[x:y] for x, y in zip([0, *b.tolist()], [*a.tolist(), len(raw)], strict=True))
            for column, v in zip(out.values(), (id_, len(raw), len(raw) - len(kept), len(a), hashlib.sha256(kept).hexdigest()), strict=True):
                column.append(v)
    return pa.table(out, schema=pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())]))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_bytes, n_removed, n_spans, kept_sha256.

    Texts are UTF-8 bytes, null is empty; a byte goes if a LENGTH-byte string over it also starts in a document with a smaller id.
    A row with a null id keeps all its bytes and covers nothing. Rows that repeat an id don't cover each other. Texts are taken whole, however
    long; of equal strings the one of the smallest id stays. An empty table gives an
    empty result. Ids are integers.
    """
    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    total = picked.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = min(MAX_BITS, max(MIN_BITS, int(total // 1024).bit_length()))
    buckets = max(64, -(-total // BUCKET_TEXT))
    classes = docs.sparkSession.sparkContext.broadcast(frequency_classes(picked, bits))

    chunks = picked.mapInArrow(_chunks, "chunk long, ids array<long>, offsets binary, body binary")
    told = chunks.groupBy("chunk").applyInArrow(_ask(classes, bits, buckets), _TABLE).groupBy("bucket").applyInArrow(_tell, _TABLE)
    dealt = chunks.groupBy("chunk").cogroup(told.groupBy("chunk")).applyInArrow(_deal(classes, bits, buckets), _TABLE)
    # spans that a chunk found by itself pass through under keys of their own
    spread = dealt.withColumn("bucket", F.when(F.col("bucket") < 0, -1 - F.pmod(F.xxhash64("chunk"), F.lit(4 * buckets))).otherwise(F.col("bucket")))

    def meet(key: tuple, table: pa.Table) -> pa.Table:
        return table if key[0].as_py() < 0 else _bucket_spans(table)

    spans = spread.groupBy("bucket").applyInArrow(meet, _TABLE)
    return chunks.groupBy("chunk").cogroup(spans.groupBy("chunk")).applyInArrow(_digest, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


#: The same result in SQL: every 50-byte string of every text, as hex.
SQL = """
WITH h AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT doc_id, i, substr(h, 2 * i + 1, 100) AS s FROM (SELECT doc_id, h, unnest(range(0, len(h) // 2 - 49)) AS i FROM h)),
m AS (SELECT s, min(doc_id) AS d FROM w GROUP BY s),
c AS (SELECT w.doc_id, w.i FROM w JOIN m ON m.s = w.s WHERE w.doc_id > m.d),
f AS (SELECT doc_id, i, CASE WHEN i > lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 50 THEN 1 ELSE 0 END AS fresh FROM c),
g AS (SELECT doc_id, i, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM f),
r AS (SELECT doc_id, run, min(i) AS a, max(i) + 50 AS b FROM g GROUP BY 1, 2),
k AS (SELECT doc_id, a, b, lag(b, 1, 0) OVER (PARTITION BY doc_id ORDER BY a) AS prev FROM r),
t AS (SELECT k.doc_id, string_agg(substr(h.h, CAST(2 * prev + 1 AS BIGINT), CAST(2 * (a - prev) AS BIGINT)), '' ORDER BY a) AS head, max(b) AS last, sum(b - a) AS removed, count(*) AS spans
      FROM k JOIN h ON h.doc_id = k.doc_id GROUP BY 1)
SELECT h.doc_id, CAST(len(h.h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(removed, 0) AS BIGINT) AS n_removed, coalesce(spans, 0) AS n_spans,
       sha256(unhex(coalesce(head, '') || substr(h.h, CAST(2 * coalesce(last, 0) + 1 AS BIGINT)))) AS kept_sha256
FROM h LEFT JOIN t ON t.doc_id = h.doc_id
"""
