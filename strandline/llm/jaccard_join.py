"""N-gram Jaccard self-join by filtering under several global token orders.

Two sets of Jaccard similarity t or more share a token among the first n - ceil(t n) + 1 of each, under every total order of the tokens.
Candidates of the first order (rare tokens first) come from an index: the tokens of all prefixes are dealt to buckets, and sets on one
token's list are candidates if the position filter leaves enough tokens in both. Candidates of the further orders are those whose
prefixes meet there. The filters of all orders are intersected on rows of prefixes alone; whole sets are fetched for the pairs that pass
them all, and verified exactly.

Sets that are equal are one class from the start. Candidates come in two rounds, so that a group of g near copies costs about g
verifications and not g^2: first each set against the leader of its lists (the one with the fewest tokens before the list's own); then,
of what these links have not joined, the pairs that share a list. A pair is looked for only where its smaller set has the token among its
first n - ceil(2 t n / (1 + t)) + 1, and sets meet by list and size, so that a common token doesn't pair all that hold it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.llm.common import Scratch, connected_components, mix64
from strandline.llm.shingles import set_prints, shingle_sets, sort_each, text_slices

SIZE, PERCENT = 5, 80
#: Further orders: each ranks tokens by a hash of its own.
ORDERS = [0x1D8E4E27C47D124F, 0xEB44ACCAB455D165]
#: Bytes of text that one bucket of the index answers for, and postings of one token that one bucket takes before the token is salted.
BUCKET_TEXT, HOT = 16 << 20, 200_000
#: Postings that a task gathers before it sends them.
SEND = 1 << 18
#: Ids that are sent to all tasks at most (16 bytes each or so); more are joined by shuffle.
BROADCAST_IDS = 1_000_000
#: The frequency sketch has 2^bits counters, a counter for about TOKENS_EACH tokens of the corpus; never more than 2^MAX_BITS (one byte each when sent).
MIN_BITS, MAX_BITS, BLOCK_BITS, TOKENS_EACH = 16, 24, 14, 32


def prefix_size(n: np.ndarray) -> np.ndarray:
    """Tokens of a set of n that must be looked at: n - ceil(PERCENT n / 100) + 1."""
    return n - -(-n * PERCENT // 100) + 1


def sketch_bits(total_bytes: int) -> int:
    return min(MAX_BITS, max(MIN_BITS, round(math.log2(max(1, total_bytes / 6 / TOKENS_EACH)))))


def frequency_classes(docs: DataFrame, bits: int, size: int) -> np.ndarray:
    """For each counter of a sketch over the tokens of all sets: four times the logarithm (base 2) of its count, one byte each.

    A counter is at least the number of sets that hold any one of its tokens. Its size is bounded by 2^MAX_BITS bytes.
    """
    block = min(bits, BLOCK_BITS)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(1 << bits, np.uint32)
        for batch in batches:
            for _, flat, offsets in text_slices(batch.column(0), batch.column(0)):
                marks, _ = shingle_sets(flat, offsets, size)
                np.add.at(seen, (marks >> np.uint64(64 - bits)).view(np.int64), np.uint32(1))
        parts, pack = seen.reshape(-1, 1 << block), zstandard.ZstdCompressor(level=1).compress
        for i in range(len(parts)):
            if parts[i].any():
                yield pa.RecordBatch.from_arrays([pa.array([i], pa.int64()), pa.array([pack(parts[i].tobytes())], pa.binary())], ["block", "counts"])

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        total, unpack = np.zeros(1 << block, np.uint64), zstandard.ZstdDecompressor().decompress
        for blob in pdf["counts"]:
            total += np.frombuffer(unpack(blob), np.uint32)
        return pd.DataFrame({"block": pdf["block"][:1], "classes": [np.rint(4 * np.log2(total + 1.0)).astype(np.uint8).tobytes()]})

    out = np.zeros(1 << bits, np.uint8).reshape(-1, 1 << block)
    for r in docs.select("text").mapInArrow(count, "block long, counts binary").groupBy("block").applyInPandas(add, "block long, classes binary").toLocalIterator():
        out[r["block"]] = np.frombuffer(r["classes"], np.uint8)
    return out.reshape(-1)


def first_tokens(keys: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(tokens, set, place) of each set's prefix; keys are its tokens as numbers in their order, and are sorted in place."""
    sort_each(keys, bounds)
    sizes = np.diff(bounds)
    many = np.minimum(prefix_size(sizes), sizes)
    owner = np.repeat(np.arange(len(sizes)), many)
    place = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
    return keys[bounds[:-1][owner] + place], owner, place


def _index(docs: DataFrame, classes, bits: int, buckets: int, size: int, id_type: str) -> DataFrame:
    """Rows of documents (doc_id, n, cls) and packed postings (bucket, hot, blob) from one pass over the texts."""

    def postings(ids: pa.Array, marks: np.ndarray, bounds: np.ndarray, cls: np.ndarray, seen: set[int]) -> np.ndarray:
        """Of the sets that this task hasn't shown lately."""
        _, at = np.unique(cls, return_index=True)
        fresh = np.zeros(len(cls), bool)
        fresh[[i for i in at.tolist() if int(cls[i]) not in seen]] = True
        seen.update(cls[fresh].tolist())
        # a token's number: its frequency class and then most of its hash
        keys = (classes.value[(marks >> np.uint64(64 - bits)).view(np.int64)].astype(np.uint64) << np.uint64(56)) | (marks >> np.uint64(8))
        token, owner, place = first_tokens(keys, bounds)
        used = fresh[owner] & np.asarray(ids.is_valid())[owner]
        p = np.empty(used.sum(), _POSTING)
        p["token"], p["cls"], p["n"] = token[used], cls[owner[used]], np.diff(bounds)[owner[used]]
        p["left"] = p["n"] - place[used]
        return p

    def dealt(found: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        p = np.concatenate(found)
        salts = np.exp2((p["token"] >> np.uint64(56)).astype(np.float64) / 4 + 0.25).astype(np.uint64) // np.uint64(HOT) + np.uint64(1)
        hot = salts > 1
        salt = np.where(hot, mix64(p["cls"].view(np.uint64) % salts + np.uint64(1)), np.uint64(0))
        group = (mix64(p["token"] + salt) % np.uint64(buckets)).astype(np.int64) * 2 + hot
        order = np.argsort(group, kind="stable")
        cuts = np.flatnonzero(np.diff(group[order])) + 1
        first = group[order[np.append(0, cuts)]]
        for i in range(0, len(first), 64):
            blobs = [_pack(p[order[a:b]]) for a, b in zip(np.append(0, cuts)[i : i + 64], np.append(cuts, len(p))[i : i + 64], strict=True)]
            yield _rows(id_type, bucket=first[i : i + 64] // 2, hot=first[i : i + 64] % 2 == 1, blob=blobs)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, seen = [], set()
        for batch in batches:
            for ids, flat, offsets in text_slices(batch.column(0), batch.column(1)):
                marks, bounds = shingle_sets(flat, offsets, size)
                cls = set_prints(marks, bounds)
                # rows of documents only pass through the index, under keys that grow in number with it
                aside = mix64(cls.view(np.uint64) + np.arange(len(cls), dtype=np.uint64)) % np.uint64(8 * buckets)
                yield _rows(id_type, ids, np.diff(bounds), cls, bucket=-1 - aside.astype(np.int64))
                # an id that is null keeps its set from being shown, not that of another row
                named = np.asarray(ids.is_valid())
                p = postings(ids, marks, bounds, np.where(named, cls, -1 - np.arange(len(cls))), seen)
                if len(p):
                    found.append(p)
                if sum(map(len, found)) > SEND:
                    yield from dealt(found)
                    found = []
                if len(seen) > SEND:
                    seen = set()
        if found:
            yield from dealt(found)

    return docs.select("doc_id", "text").mapInArrow(deal, _schema(id_type)[0])


_POSTING = np.dtype([("token", "<u8"), ("cls", "<i8"), ("n", "<u4"), ("left", "<u4")])


def _pack(postings: np.ndarray) -> bytes:
    """The postings column by column, compressed."""
    return zstandard.ZstdCompressor(level=1).compress(b"".join(np.ascontiguousarray(postings[f]).tobytes() for f in _POSTING.names))


def _unpack(blob: bytes) -> np.ndarray:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    out = np.empty(len(raw) // _POSTING.itemsize, _POSTING)
    at = 0
    for f in _POSTING.names:
        kind = _POSTING[f]
        out[f] = np.frombuffer(raw, kind, len(out), at)
        at += len(out) * kind.itemsize
    return out


def _schema(id_type: str) -> tuple[str, list[str]]:
    names = ["doc_id", "n", "cls", "bucket", "hot", "blob"]
    return f"doc_id {id_type}, n long, cls long, bucket long, hot boolean, blob binary", names


def _rows(id_type, ids=None, n=None, cls=None, bucket=None, hot=None, blob=None) -> pa.RecordBatch:
    size = len(ids) if ids is not None else len(blob)
    kind = ids.type if ids is not None else {"string": pa.string(), "int": pa.int32()}.get(id_type, pa.int64())
    column = lambda v, t: pa.nulls(size, t) if v is None else pa.array(v, t)
    return pa.RecordBatch.from_arrays([ids if ids is not None else pa.nulls(size, kind), column(n, pa.int64()), column(cls, pa.int64()), column(bucket, pa.int64()), column(hot, pa.bool_()), column(blob, pa.binary())], _schema(id_type)[1])


def _meet(table: pa.Table) -> pa.Table:
    """The lists of one bucket: (list, cls, n, left) rows of each list of two or more sets, left being the tokens from the list's own on.

    Lists with the same members are listed once, with the most left that each member has on them.
    """
    found = []
    for hot in (False, True):
        blobs = [b.as_py() for b, h in zip(table["blob"], table["hot"], strict=True) if h.as_py() is hot]
        if not blobs:
            continue
        p = np.concatenate([_unpack(b) for b in blobs])
        del blobs
        if not hot:  # most tokens are in one set alone
            order = np.argsort(p["token"])
            token = p["token"][order]
            again = np.append(False, token[1:] == token[:-1])
            p = p[order[again | np.append(again[1:], False)]]
        p = p[np.lexsort((p["cls"], p["token"]))]
        p = p[np.append(True, (p["token"][1:] != p["token"][:-1]) | (p["cls"][1:] != p["cls"][:-1]))[: len(p)]]
        if not len(p):
            continue
        start = np.flatnonzero(np.append(True, p["token"][1:] != p["token"][:-1]))
        count = np.diff(np.append(start, len(p)))
        if hot:
            name, chosen = p["token"][start], np.ones(len(start), bool)
        else:
            name = mix64(np.add.reduceat(mix64(p["cls"].view(np.uint64)), start) + count.astype(np.uint64))
            chosen = count > 1
        rows = np.repeat(chosen, count)
        q, names = p[rows], np.repeat(name, count)[rows]
        order = np.lexsort((q["cls"], names))
        q, names = q[order], names[order]
        head = np.flatnonzero(np.append(True, (names[1:] != names[:-1]) | (q["cls"][1:] != q["cls"][:-1]))) if len(q) else np.zeros(0, np.int64)
        most = np.maximum.reduceat(q["left"], head) if len(q) else q["left"]
        found.append((names[head].view(np.int64), q["cls"][head], q["n"][head].astype(np.int64), most.astype(np.int64)))
    cat = [np.concatenate([f[k] for f in found]) if found else np.zeros(0, np.int64) for k in range(4)]
    return pa.table(dict(zip(("list", "cls", "n", "left"), cat, strict=True)))


def _fits(a: str, b: str) -> Column:
    """Are the sizes of two sets near enough, and is so much left of both on a list that they can have the overlap that a link needs?"""
    near = F.least(f"{a}n", f"{b}n") * 100 >= F.greatest(f"{a}n", f"{b}n") * PERCENT
    return near & (F.least(f"{a}left", f"{b}left") * (100 + PERCENT) >= (F.col(f"{a}n") + F.col(f"{b}n")) * PERCENT)


def _band(n: Column) -> Column:
    """Sizes in bands that grow by 100 / PERCENT, so that sets near enough in size are in one band or in neighbouring ones."""
    return F.floor(F.log(n.cast("double")) / math.log(100 / PERCENT)).cast("int")


def _sharing(probes: DataFrame, indexed: DataFrame) -> DataFrame:
    """(a, b) pairs of different components that share a list and fit, b of indexed being no larger than a of probes."""
    p = probes.select("list", *(F.col(c).alias(f"a{c}") for c in ("cls", "n", "left", "comp")))
    # what is left of a bounds how large b can be
    most = F.least(F.col("an"), F.floor(F.col("aleft") * (100 + PERCENT) / PERCENT) - F.col("an"))
    least = F.ceil(F.col("an") * PERCENT / 100)
    p = p.where(most >= least).withColumn("band", F.explode(F.sequence(_band(least), _band(most))))
    i = indexed.where(F.col("left") * (100 + PERCENT) >= F.col("n") * 2 * PERCENT).select("list", _band(F.col("n")).alias("band"), *(F.col(c).alias(f"b{c}") for c in ("cls", "n", "left", "comp")))
    below = (F.col("bn") < F.col("an")) | ((F.col("bn") == F.col("an")) & (F.col("bcls") < F.col("acls")))
    met = p.join(i, (p["list"] == i["list"]) & (p["band"] == i["band"]) & (F.col("acomp") != F.col("bcomp")) & below & _fits("a", "b"))
    return met.select(F.least("acls", "bcls").alias("a"), F.greatest("acls", "bcls").alias("b"))


def _prefixes(docs: DataFrame, size: int) -> DataFrame:
    """(cls, order1, order2, ...): each text's fingerprint and its prefixes under the further orders."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, flat, offsets in text_slices(batch.column(0), batch.column(0)):
                marks, bounds = shingle_sets(flat, offsets, size)
                columns = [pa.array(set_prints(marks, bounds), pa.int64())]
                for salt in ORDERS:
                    token, owner, _ = first_tokens(mix64(marks ^ np.uint64(salt)), bounds)
                    ends = np.append(0, np.cumsum(np.bincount(owner, minlength=len(bounds) - 1)))
                    columns.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array((token >> np.uint64(32)).astype(np.uint32).view(np.int32))))
                yield pa.RecordBatch.from_arrays(columns, ["cls", *_ORDER_NAMES])

    return docs.select("text").mapInArrow(build, f"cls long, {', '.join(f'{c} array<int>' for c in _ORDER_NAMES)}")


_ORDER_NAMES = [f"order{k + 1}" for k in range(len(ORDERS))]


def _sets(docs: DataFrame, size: int) -> DataFrame:
    """(cls, n, marks): each text's fingerprint, the size of its set, and the set."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, flat, offsets in text_slices(batch.column(0), batch.column(0)):
                marks, bounds = shingle_sets(flat, offsets, size)
                sets = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(marks.view(np.int64), pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array(set_prints(marks, bounds), pa.int64()), pa.array(np.diff(bounds), pa.int64()), sets], ["cls", "n", "marks"])

    return docs.select("text").mapInArrow(build, "cls long, n long, marks array<long>")


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id (the smallest id reachable by links of Jaccard PERCENT / 100 or more).

    Words are `[^\\x20\\x09-\\x0D]+` with A-Z lower-cased; a text of fewer than size words is one shingle; a null, empty or word-free
    text has no shingle and is linked with nothing. A row with a null id links with nothing and has a null component. Rows that repeat
    an id are documents of their own with that id. Shingles and sets are compared by 64-bit fingerprints. An empty table gives an empty
    result.
    """
    return _components(docs, id_col, text_col, size).select("doc_id", "n_shingles", "component_id")


def _components(docs: DataFrame, id_col: str, text_col: str, size: int) -> DataFrame:
    """jaccard_components() with cls, the fingerprint of each row's set, and comp, a name that no other component has."""
    spark = docs.sparkSession
    picked = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    id_type = picked.schema["doc_id"].dataType.simpleString()
    scratch = Scratch(spark, "jaccard")
    total = picked.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits, buckets = sketch_bits(total), max(64, -(-total // BUCKET_TEXT))
    classes = spark.sparkContext.broadcast(frequency_classes(picked, bits, size))

    dealt = _index(picked, classes, bits, buckets, size, id_type)
    rows_schema = f"doc_id {id_type}, n long, cls long, list long, left long"

    def meet(key: tuple, table: pa.Table) -> pa.Table:
        if key[0].as_py() < 0:
            none = pa.nulls(len(table), pa.int64())
            return table.select(["doc_id", "n", "cls"]).append_column("list", none).append_column("left", none)
        out = _meet(table)
        return pa.table({"doc_id": pa.nulls(len(out), table.schema.field("doc_id").type), **{k: out[k] for k in ("n", "cls", "list", "left")}})

    met = scratch.keep(dealt.groupBy("bucket").applyInArrow(meet, rows_schema))
    members = met.where("list is null").select("doc_id", "n", "cls")
    lists = scratch.keep(met.where("list is not null").groupBy("list", "cls").agg(F.first("n").alias("n"), F.max("left").alias("left")))

    kinds = members.where("n > 0 and doc_id is not null").groupBy("cls").agg(F.min("doc_id").alias("first"))
    leaders = lists.groupBy("list").agg(F.min(F.struct((F.col("n") - F.col("left")).alias("before"), "cls", "n", "left")).alias("l"))
    leaders = leaders.select("list", F.col("l.cls").alias("a"), F.col("l.n").alias("an"), F.col("l.left").alias("aleft"))
    named = lists.select("list", F.col("cls").alias("b"), F.col("n").alias("bn"), F.col("left").alias("bleft"))
    stars = named.join(leaders, (named["list"] == leaders["list"]) & (F.col("a") != F.col("b")) & _fits("a", "b"))
    stars = scratch.keep(stars.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    reps = scratch.keep(kinds.join(lists.select("cls").distinct(), "cls", "left_semi").select("cls", F.col("first").alias("doc_id")))
    texts = lambda some: picked.join(_small(some.select("doc_id").distinct()), "doc_id", "left_semi")
    prefixes = scratch.keep(_prefixes(texts(reps), size))

    def verified(pairs: DataFrame) -> DataFrame:
        """The pairs that share a prefix token under each further order, and then have the overlap; only for these sets are built."""
        named = prefixes.join(_classes_of(pairs), "cls", "left_semi")
        for order in _ORDER_NAMES:
            left, right = (named.select(F.col("cls").alias(side), F.col(order).alias(f"p{side}")) for side in "ab")
            pairs = pairs.join(left, "a").join(right, "b").where(F.arrays_overlap("pa", "pb")).select("a", "b")
        pairs = scratch.keep(pairs.distinct())
        whole = scratch.keep(_sets(texts(reps.join(_classes_of(pairs), "cls", "left_semi")), size))
        left, right = (whole.select(F.col("cls").alias(side), F.col("n").alias(f"n{side}"), F.col("marks").alias(f"m{side}")) for side in "ab")
        common = F.size(F.array_intersect("ma", "mb"))
        linked = pairs.join(left, "a").join(right, "b").where(common * 100 >= (F.col("na") + F.col("nb") - common) * PERCENT)
        linked = scratch.keep(linked.select("a", "b").distinct())
        scratch.drop(pairs, whole)
        return linked

    links = verified(stars)
    roots = _near_labels(links)
    placed = lists.join(roots, "cls", "left").select("list", "cls", "n", "left", F.coalesce("comp", "cls").alias("comp"))
    # of an open list's largest component no two sets need meet
    largest = placed.groupBy("list", "comp").agg(F.count("*").alias("size")).groupBy("list").agg(F.max_by("comp", F.struct("size", "comp")).alias("main"), F.count("*").alias("comps"))
    still = scratch.keep(placed.join(largest.where("comps > 1").select("list", "main"), "list").withColumn("rest", F.col("comp") != F.col("main")))
    across = _sharing(still, still.where("rest")).union(_sharing(still.where("rest"), still.where("not rest"))).distinct()
    fresh = scratch.keep(across.join(stars, ["a", "b"], "left_anti"))
    more = verified(fresh)
    roots2 = connected_components(links.unionByName(more), scratch).withColumnsRenamed({"node": "cls", "root": "comp"})
    # the result is made of met and of the components' table alone
    scratch.drop(lists, stars, reps, prefixes, links, still, fresh, more)

    owned = kinds.join(roots2, "cls", "left").select("cls", "first", F.coalesce("comp", "cls").alias("comp"))
    named = owned.groupBy("comp").agg(F.min("first").alias("component_id"))
    final = owned.select("cls", "comp").join(named, "comp").select("cls", "comp", "component_id")
    out = members.join(final, "cls", "left")
    component = F.when((F.col("n") > 0) & F.col("doc_id").isNotNull(), F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), "cls", "comp")


def _near_labels(links: DataFrame) -> DataFrame:
    """(cls, comp): the smallest of the sets within two links. Sets with one label are in one component, and a star has one label."""
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    one = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("b"), F.least("a", "m").alias("m"))
    two = both.join(one, "b").groupBy("a").agg(F.min("m").alias("m"))
    return two.select(F.col("a").alias("cls"), F.least("a", "m").alias("comp"))


def keep_one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE) -> DataFrame:
    """docs with one document of each component, that of the smallest id; all columns stay as they are.

    Documents without shingles or with a null id stay. Rows that repeat an id are documents of their own: of several rows of a component
    with its smallest id, one of the set with the smallest fingerprint stays.
    """
    found = Scratch(docs.sparkSession, "kept").keep(_components(docs, id_col, text_col, size))
    named = found.where("doc_id is not null and n_shingles > 0")
    if named.groupBy("doc_id").count().where("count > 1").isEmpty():
        gone = named.where("doc_id <> component_id").select(F.col("doc_id").alias(id_col))
        return docs.join(_small(gone), id_col, "left_anti").select(docs.columns)
    stays = named.where("doc_id = component_id").groupBy("comp").agg(F.min("cls").alias("_cls"), F.first("component_id").alias(id_col)).select(id_col, "_cls")
    marked = docs.withColumn("_cls", _print_of(size)(F.coalesce(F.col(text_col), F.lit(""))))
    free = F.col(id_col).isNull() | F.col("_cls").isNull()
    one = marked.where(~free).join(stays, [id_col, "_cls"], "left_semi").dropDuplicates([id_col, "_cls"])
    return one.unionByName(marked.where(free)).select(docs.columns)


def _print_of(size: int):
    """A function of texts that gives the fingerprint of each one's set, null for one without shingles."""

    @F.arrow_udf("long")
    def prints(texts: pa.Array) -> pa.Array:
        out = [pa.array([], pa.int64())]
        for _, flat, offsets in text_slices(texts, texts):
            marks, bounds = shingle_sets(flat, offsets, size)
            out.append(pa.array(set_prints(marks, bounds), pa.int64(), mask=np.diff(bounds) == 0))
        return pa.concat_arrays(out)

    return prints


def _classes_of(pairs: DataFrame) -> DataFrame:
    """The classes that a kept table of pairs names."""
    return _small(pairs.select(F.col("a").alias("cls")).union(pairs.select(F.col("b").alias("cls"))).distinct())


def _small(ids: DataFrame) -> DataFrame:
    """ids, to be broadcast if they are at most BROADCAST_IDS; otherwise joins shuffle both sides."""
    return F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids


#: The same result in SQL: all pairs that share a shingle.
SQL = """
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN CAST([] AS VARCHAR[]) WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
      ELSE list_distinct([w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3] || ' ' || w[i + 4] FOR i IN range(1, len(w) - 3)]) END AS s FROM w),
n AS (SELECT doc_id, CAST(len(s) AS BIGINT) AS n FROM s),
x AS (SELECT doc_id, unnest(s) AS g FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM x a JOIN x b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT p.a, p.b FROM p JOIN n na ON na.doc_id = p.a JOIN n nb ON nb.doc_id = p.b WHERE 100 * c >= 80 * (na.n + nb.n - c)),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b)
SELECT n.doc_id, n.n AS n_shingles, m.c AS component_id FROM n JOIN (SELECT a, min(b) AS c FROM r GROUP BY 1) m ON m.a = n.doc_id
"""
