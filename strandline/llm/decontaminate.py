"""Benchmark decontamination by q-gram lemma filtering.

An item of m characters that occurs in a text with at most e edits shares at least m + 1 - q (e + 1) q-grams with it, all on
diagonals (text offset minus item offset) that differ by at most e. Texts are scanned for q-grams of the items; hits are counted in
overlapping bands of diagonals; bands that reach the bound are verified by a banded alignment, many at a time.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.llm.common import Scratch

Q, EDIT_RATE = 10, 0.08
#: Items are sent to the executors in blocks of about so many bytes of text; a larger benchmark takes several passes over the documents.
BLOCK_BYTES = 8 << 20
#: Hits that are held at once, and cells of the alignments that are computed at once.
MAX_HITS, MAX_CELLS = 1 << 20, 1 << 20
_BITS = 22
_KEEP = bytes(b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in range(256))


def normalise(text: str) -> str:
    """Lower-cased text with each run of ASCII white space and punctuation as one space."""
    return b" ".join(text.lower().encode("utf-8", "replace").translate(_KEEP).split()).decode("utf-8", "replace")


def letters(text: str) -> np.ndarray:
    """The code points of text."""
    return np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)


def gram_hashes(text: str) -> np.ndarray:
    """A 64-bit hash of each run of Q characters, from its first and its last eight, with one byte for a character.

    Characters beyond ASCII share 128 bytes, so grams that differ may have one hash, but equal ones always do.
    """
    n = len(text) - Q + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    if text.isascii():
        raw = text.encode()
    else:
        wide = letters(text)
        raw = np.where(wide < 128, wide, 128 | (wide * np.uint32(0x9E3779B1) >> np.uint32(25))).astype(np.uint8).tobytes()
    head = np.ndarray((n,), "<u8", raw, 0, (1,))
    tail = np.ndarray((n,), "<u8", raw, Q - 8, (1,))
    return head * np.uint64(0x9E3779B97F4A7C15) + (tail ^ (tail >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)


def edit_budget(m: int) -> int:
    """Edits allowed for an item of m characters: EDIT_RATE of them, or as many as leave one shared q-gram."""
    return max(0, min(int(m * EDIT_RATE), m // Q - 1))


@dataclass
class ItemIndex:
    """q-grams of the items: which hash values occur (a bit table first), and at which item and offset."""

    ids: list
    texts: list[str]
    table: np.ndarray
    keys: np.ndarray
    #: For each place of a gram in an item: the gram's number times the number of items, plus the item; ascending.
    places: np.ndarray
    offsets: np.ndarray
    sizes: np.ndarray
    budgets: np.ndarray
    #: The items' letters one after another, and where each item starts.
    flat: np.ndarray
    starts: np.ndarray
    #: Items of fewer than Q characters, which are searched as whole words: ids by the item's words, by their number.
    short: dict[int, dict[tuple[str, ...], list]]

    @staticmethod
    def build(rows: list[tuple[object, str]]) -> "ItemIndex":
        plain = [(i, normalise(t or "")) for i, t in rows]
        kept = [(i, t) for i, t in plain if len(t) >= Q]
        short: dict[int, dict[tuple[str, ...], list]] = {}
        for i, t in plain:
            if 0 < len(t) < Q:
                short.setdefault(t.count(" ") + 1, {}).setdefault(tuple(t.split(" ")), []).append(i)
        hashes = [gram_hashes(t) for _, t in kept]
        flat = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
        items = np.repeat(np.arange(len(kept)), [len(h) for h in hashes])
        offsets = np.concatenate([np.arange(len(h), dtype=np.int32) for h in hashes]) if hashes else np.zeros(0, np.int32)
        order = np.argsort(flat, kind="stable")
        keys, gram = np.unique(flat, return_inverse=True)
        table = np.zeros(1 << _BITS, bool)
        table[flat >> np.uint64(64 - _BITS)] = True
        sizes = np.array([len(t) for _, t in kept], np.int64)
        budgets = np.array([edit_budget(m) for m in sizes.tolist()], np.int64)
        return ItemIndex([i for i, _ in kept], [t for _, t in kept], table, keys, (gram * max(1, len(kept)) + items)[order], offsets[order], sizes, budgets, letters("".join(t for _, t in kept)), np.cumsum(sizes) - sizes, short)

    def find(self, text: str) -> list[tuple[object, int]]:
        """(item id, edits) of each item that occurs within its budget."""
        raw = normalise(text)
        return self._whole_words(raw) + self._near(raw)

    def _whole_words(self, raw: str) -> list[tuple[object, int]]:
        """Items too short for q-grams that stand in a normalised text as whole words, without an edit."""
        if not self.short:
            return []
        words = raw.split(" ")
        return [(i, 0) for n, held in self.short.items() for key in held.keys() & set(zip(*(words[k:] for k in range(n)))) for i in held[key]]

    def _near(self, raw: str) -> list[tuple[object, int]]:
        h = gram_hashes(raw)
        at = np.flatnonzero(self.table[h >> np.uint64(64 - _BITS)])
        if not len(at) or not len(self.keys):
            return []
        slot = np.minimum(np.searchsorted(self.keys, h[at]), len(self.keys) - 1)
        real = self.keys[slot] == h[at]
        at, slot = at[real], slot[real]
        best: dict[int, int] = {}
        for item, lo, hi in self._candidates(at, slot, 0, len(self.ids)):
            for i in np.unique(item).tolist():
                if best.get(i) != 0 and self.texts[i] in raw:
                    best[i] = 0
            todo = np.array([best.get(i) != 0 for i in item.tolist()], bool)
            wide = letters(raw)
            for i, edits in zip(item[todo].tolist(), self._align(wide, item[todo], lo[todo], hi[todo]), strict=True):
                if edits <= self.budgets[i]:
                    best[i] = min(edits, best.get(i, edits))
        return [(self.ids[i], best[i]) for i in sorted(best)]

    def _candidates(self, at: np.ndarray, slot: np.ndarray, first: int, last: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(item, begin, end) of text parts whose bands reach the bound, for items first .. last - 1 and hits at places of the text.

        Too many hits at once are taken in parts: first by items, then by overlapping parts of the text. Where one item has too many in a
        part of the text that is short already, both repeat themselves, and grams are counted without making their pairs.
        """
        n = len(self.ids)
        begin, end = np.searchsorted(self.places, slot * n + first), np.searchsorted(self.places, slot * n + last)
        many = end - begin
        if not (total := int(many.sum())):
            return
        reach = int((self.sizes[first:last] + 2 * self.budgets[first:last]).max())
        if total > MAX_HITS and last - first > 1:
            middle = (first + last) // 2
            yield from self._candidates(at, slot, first, middle)
            yield from self._candidates(at, slot, middle, last)
            return
        if total > MAX_HITS and at[-1] - at[0] > 4 * reach:
            middle = int(at[0] + at[-1]) // 2
            left, right = at < middle + reach, at >= middle - reach
            yield from self._candidates(at[left], slot[left], first, last)
            yield from self._candidates(at[right], slot[right], first, last)
            return
        if total > MAX_HITS:
            yield from self._bands_of_repeats(at, slot, begin, end, first)
            return
        where = np.repeat(begin - np.cumsum(many) + many, many) + np.arange(total)
        item, offset = self.places[where] % n, self.offsets[where].astype(np.int64)
        diagonal = np.repeat(at, many) - offset
        enough = np.bincount(item - first, minlength=last - first) >= self._bound(np.arange(first, last))
        chosen = enough[item - first]
        item, offset, diagonal = item[chosen], offset[chosen], diagonal[chosen]
        if not len(item):
            return
        # each band spans two steps of the item's budget, so diagonals that differ by at most that share a band
        width = np.maximum(1, self.budgets[item])
        band = np.concatenate([diagonal // width, diagonal // width - 1])
        item, offset, diagonal = (np.concatenate([x, x]) for x in (item, offset, diagonal))
        low, wide = int(band.min()), int(offset.max()) + 1
        spread = int(band.max()) - low + 1
        if (last - first) * spread * wide < 1 << 62:
            order = np.argsort(((item - first) * spread + band - low) * wide + offset)
        else:
            order = np.lexsort((offset, band, item))
        item, offset, diagonal, band = item[order], offset[order], diagonal[order], band[order]
        head = np.append(True, (item[1:] != item[:-1]) | (band[1:] != band[:-1]))
        fresh = head | np.append(True, offset[1:] != offset[:-1])
        start = np.flatnonzero(head)
        counts = np.add.reduceat(fresh.astype(np.int64), start)
        low, high = np.minimum.reduceat(diagonal, start), np.maximum.reduceat(diagonal, start)
        item = item[start]
        full = counts >= self._bound(item)
        item, e = item[full], self.budgets[item[full]]
        yield item, np.maximum(0, low[full] - e), high[full] + self.sizes[item] + e

    def _bands_of_repeats(self, at: np.ndarray, slot: np.ndarray, begin: np.ndarray, end: np.ndarray, item: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """The same for one item, gram by gram: a place of the item counts in a band if its gram's first place in the text from the band's start on lies inside it."""
        m, e = int(self.sizes[item]), int(self.budgets[item])
        width = max(1, e)
        bands = np.arange((int(at[0]) - m) // width - 1, int(at[-1]) // width + 1)
        counts, low, high = np.zeros(len(bands), np.int64), np.full(len(bands), 1 << 60), np.full(len(bands), -(1 << 60))
        by = np.argsort(slot, kind="stable")
        for here in np.split(by, np.flatnonzero(np.diff(slot[by])) + 1):
            text, places = at[here], self.offsets[begin[here[0]] : end[here[0]]].astype(np.int64)
            step = max(1, MAX_CELLS // len(bands))
            for k in range(0, len(places), step):
                part = places[k : k + step, None]
                start = part + bands[None, :] * width
                a, b = np.searchsorted(text, start), np.searchsorted(text, start + 2 * width)
                some = b > a
                counts += some.sum(axis=0)
                low = np.minimum(low, np.where(some, text[np.minimum(a, len(text) - 1)] - part, 1 << 60).min(axis=0))
                high = np.maximum(high, np.where(some, text[np.maximum(b, 1) - 1] - part, -(1 << 60)).max(axis=0))
        full = counts >= self._bound(np.array([item]))[0]
        yield np.full(int(full.sum()), item), np.maximum(0, low[full] - e), high[full] + m + e

    def _bound(self, item: np.ndarray) -> np.ndarray:
        return self.sizes[item] + 1 - Q * (self.budgets[item] + 1)

    def _align(self, wide: np.ndarray, item: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> list[int]:
        """Least edits between each item and any part of wide[lo:hi], up to its budget; else some number above it.

        A path within the budget stays near the diagonals that the part's length allows, so those are computed: the part gets budget
        sentinels (0, which normalised text never holds) on both sides.
        """
        out = np.zeros(len(item), np.int64)
        hi = np.minimum(hi, len(wide))
        reach, sizes = self.budgets[item], self.sizes[item]
        spare = hi - lo + 2 * reach - sizes
        out[spare < 0] = reach[spare < 0] + 1
        todo = np.flatnonzero(spare >= 0)
        todo = todo[np.argsort(-sizes[todo], kind="stable")]
        done = 0
        while done < len(todo):
            width = int(spare[todo[done:]].max()) + 1
            part = todo[done : done + max(1, MAX_CELLS // (width + int(sizes[todo[done]])))]
            done += len(part)
            longest = int(sizes[part[0]])
            steps = np.arange(longest + width)[:, None]
            at = steps + (lo - reach)[part]
            text = np.where((at >= lo[part]) & (at < hi[part]), wide[np.clip(at, 0, len(wide) - 1)], 0)
            place = steps[:longest] + self.starts[item[part]]
            pattern = self.flat[np.minimum(place, len(self.flat) - 1)]
            out[part] = banded_edits(pattern, text, sizes[part], width)
        return out.tolist()


def banded_edits(pattern: np.ndarray, text: np.ndarray, sizes: np.ndarray, width: int) -> np.ndarray:
    """For each column, longest pattern first: least edits between pattern[:size] and a part of text, over width diagonals."""
    steps = np.arange(width, dtype=np.int16)[:, None]
    row, out = np.zeros((width, len(sizes)), np.int16), np.zeros(len(sizes), np.int64)
    active = len(sizes)
    for r in range(int(sizes[0])):
        while active and sizes[active - 1] <= r:
            active -= 1
            out[active] = row[:, active].min()
        now = row[:, :active]
        best = now + (text[r : r + width, :active] != pattern[r, :active])
        np.minimum(best[:-1], now[1:] + 1, out=best[:-1])
        best -= steps
        reach = 1
        while reach < width:  # running minima by doubling
            best[reach:] = np.minimum(best[reach:], best[:-reach])
            reach *= 2
        row[:, :active] = best + steps
    out[:active] = row[:, :active].min(axis=0)
    return out


def item_blocks(benchmark: DataFrame, id_col: str, text_col: str, block_bytes: int) -> Iterator[list[tuple]]:
    """Rows (id, text) of the items, about block_bytes of text at a time; null texts are no items."""
    items = benchmark.select(F.col(id_col).alias("item_id"), F.col(text_col).alias("text")).where(F.col("text").isNotNull())
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-total // block_bytes))
    part = F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks))
    for b in range(blocks):
        yield [tuple(r) for r in items.where(part == b).collect()]


_BUILT: dict[str, ItemIndex] = {}


class _Held:
    """A broadcast block of items; each Python worker builds its index once and keeps one index at a time."""

    def __init__(self, docs: DataFrame, rows: list[tuple]):
        self.rows, self.name = docs.sparkSession.sparkContext.broadcast(rows), uuid.uuid4().hex

    def index(self) -> ItemIndex:
        if self.name not in _BUILT:
            _BUILT.clear()
            _BUILT[self.name] = ItemIndex.build(self.rows.value)
        return _BUILT[self.name]


def _found_in(docs: DataFrame, rows: list[tuple], item_type: str):
    """A function of texts: the list of (item, edits) that each holds."""
    held = _Held(docs, rows)

    @F.arrow_udf(f"array<struct<item {item_type}, edits long>>")
    def found(texts: pa.Array) -> pa.Array:
        index = held.index()
        got = [index.find(t.as_py()) if t.is_valid else [] for t in texts]
        kind = pa.from_numpy_dtype("int64") if item_type == "bigint" else {"string": pa.string(), "int": pa.int32()}.get(item_type)
        inner = pa.struct([("item", kind), ("edits", pa.int64())])
        return pa.array([[{"item": i, "edits": int(e)} for i, e in f] for f in got], pa.list_(inner))

    return found


def _clean_of(docs: DataFrame, rows: list[tuple]):
    """A function of texts: true where no item occurs."""
    held = _Held(docs, rows)

    @F.arrow_udf("boolean")
    def clean(texts: pa.Array) -> pa.Array:
        index = held.index()
        return pa.array([not (t.is_valid and index.find(t.as_py())) for t in texts], pa.bool_())

    return clean


def find_contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Per row: doc_id, contaminated, n_items, least_edits (null if none), items (`item:edits` joined by commas, in item order).

    A null or empty text is clean. Lengths, q-grams and edits are of characters after normalise(). Items of fewer than Q characters have no
    q-gram; they occur where their words stand in a row, without edits. Items without a letter or digit are none. Texts and items may be of
    any length and repeat themselves: what is held at once is bounded by MAX_HITS and MAX_CELLS. Repeated rows and null ids are rows of their own, repeated items count each. An empty table gives
    an empty result, an empty benchmark clean rows. A benchmark over block_bytes takes one pass a block, and each row carries what the
    passes before found (a table in the shared folder), so the answer doesn't depend on the blocks.
    """
    item = F.col(item_col)
    kind = benchmark.select(item).schema[0].dataType.simpleString()
    if kind not in ("bigint", "int", "string"):
        item, kind = item.cast("string"), "string"
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.array().cast(f"array<struct<item:{kind},edits:bigint>>").alias("found"))
    scratch, last = Scratch(docs.sparkSession, "contamination"), None
    for block in item_blocks(benchmark.select(item.alias(item_col), F.col(item_text_col).alias("_t")), item_col, "_t", block_bytes):
        if last is not None:
            kept = scratch.keep(last)
            if rows is not None and hasattr(rows, "_scratch_path"):
                scratch.drop(rows)
            rows = kept
        last = rows.withColumn("found", F.concat("found", _found_in(docs, block, kind)(F.coalesce(F.col("text"), F.lit("")))))
    judged = last.select("doc_id", F.array_sort("found").alias("found"))
    n = F.size("found")
    named: Column = F.array_join(F.transform("found", lambda f: F.concat_ws(":", f["item"].cast("string"), f["edits"].cast("string"))), ",")
    return judged.select("doc_id", (n > 0).alias("contaminated"), n.cast("long").alias("n_items"), F.array_min(F.transform("found", lambda f: f["edits"])).alias("least_edits"), named.alias("items"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """docs without the rows in which an item occurs; all columns stay as they are. One pass for each block of items, no shuffle.

    Null and empty texts stay, null ids and repeated rows are judged like any other; only texts go to Python.
    """
    out, scratch, before = docs, Scratch(docs.sparkSession, "clean"), None
    for k, block in enumerate(item_blocks(benchmark, item_col, item_text_col, block_bytes)):
        if k:
            kept = scratch.keep(out)
            if before is not None:
                scratch.drop(before)
            out = before = kept
        out = out.where(_clean_of(docs, block)(F.coalesce(F.col(text_col), F.lit(""))))
    return out
