"""Best-fit packing of tokenised documents by the sum-of-squares rule.

Every document is tokenised whole and closed with the end id; only documents longer than a sequence are cut. Each piece goes to the
open bin (sequence) whose choice makes the sum over gaps g of N(g)^2 smallest, N(g) being the number of open bins with gap g.
"""

from __future__ import annotations

import json
import re
import zlib
from array import array
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm.common import Scratch

CAPACITY, END_ID = 2048, 0
#: Pieces that one packing group holds on average; the bins left open at a group's end are what grouping costs.
GROUP_ROWS = 40_000
#: Fixed value: the pattern by which a byte-level pre-tokenizer (with its pattern on and no prefix blank) splits a text.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

_TOKENIZERS: dict[str, "TextIds"] = {}


#: Runs of white space from this length on are taken out before the pattern is matched: its look-ahead keeps a step back for each character.
LONG_BLANK = 10_000
#: White space of the pattern: Unicode's White_Space, which is not Python's.
_BLANK = r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
_LONG_RUN = re.compile(f"{_BLANK}{{{LONG_BLANK},}}")


class TextIds:
    """Ids of whole texts under a byte-level BPE tokenizer file.

    The file's own vocabulary is loaded as ranks into the faster of the two installed byte-level encoders; the tests hold its ids to
    those of the first. As there, the string of an added token in a text is that token. A file that doesn't split texts by PATTERN is an error.
    """

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            said = json.load(f)
        split = said.get("pre_tokenizer") or {}
        if said.get("normalizer") or split.get("type") != "ByteLevel" or split.get("add_prefix_space") or not split.get("use_regex", True) or said["model"].get("type", "BPE") != "BPE":
            raise ValueError(f"{path}: only byte-level BPE files with the usual pattern, no prefix blank and no normaliser can be used")
        as_byte = {shown: b for b, shown in enumerate(_byte_letters())}
        file = Tokenizer.from_file(path)
        added = {t.content: i for i, t in file.get_added_tokens_decoder().items()}
        ranks = {bytes(as_byte[c] for c in token): i for token, i in file.get_vocab(with_added_tokens=True).items() if token not in added}
        self.bpe = tiktoken.Encoding(path, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=added)

    def encode(self, text: str) -> np.ndarray:
        if len(text) < LONG_BLANK:
            return np.array(array("I", self.bpe.encode(text, allowed_special="all")), np.uint32)
        parts, done = array("I"), 0
        for run in _LONG_RUN.finditer(text):
            # white space before a word gives up its last character to it, at the end of the text it is one piece
            end = run.end() - (run.end() < len(text))
            parts.extend(self.bpe.encode(text[done : run.start()], allowed_special="all"))
            parts.extend(self.blanks(text[run.start() : end]))
            done = end
        parts.extend(self.bpe.encode(text[done:], allowed_special="all"))
        return np.array(parts, np.uint32)

    def blanks(self, run: str) -> list[int]:
        """Ids of a run of white space, which is one piece."""
        return self.bpe._encode_single_piece(run)


def _byte_letters() -> list[str]:
    """The letter that stands for each byte in a byte-level vocabulary: printable Latin-1 as itself, the rest from code point 256 on."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(256, 512))
    return [chr(b if b in shown else next(spare)) for b in range(256)]


def tokenizer_at(path: str) -> TextIds:
    if path not in _TOKENIZERS:
        _TOKENIZERS[path] = TextIds(path)
    return _TOKENIZERS[path]


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of each piece of n ids; only the first may be shorter than capacity."""
    first = n % capacity
    starts = [0] * bool(first) + list(range(first, n, capacity))
    return [(s, first if first and s == 0 else capacity) for s in starts]


def sum_of_squares(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each length, placed in the given order. Ties go to the smallest gap that is left, then to the oldest bin."""
    count = np.zeros(capacity + 1, np.int64)
    count_at_new = 1 << 60
    open_bins: dict[int, list[int]] = defaultdict(list)
    bins, offsets, made = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64), 0
    for i, n in enumerate(map(int, lengths)):
        if n >= capacity:
            bins[i], made = made, made + 1
            continue
        # from gap g to gap g - n: N(g)^2 falls by 2 N(g) - 1 and N(g - n)^2 rises by 2 N(g - n) + 1 (a full bin isn't counted)
        change = 2 - 2 * count[n:capacity] + 2 * count[: capacity - n]
        change[0] = 1 - 2 * count[n]
        change[count[n:capacity] == 0] = count_at_new
        at = int(np.argmin(change))
        if change[at] <= 2 * count[capacity - n] + 1:
            g = n + at
            b = open_bins[g].pop()
            count[g] -= 1
        else:
            g, b, made = capacity, made, made + 1
        bins[i], offsets[i] = b, capacity - g
        if g > n:
            count[g - n] += 1
            open_bins[g - n].append(b)
    return bins, offsets


def _pieces(path: str, capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokenizer_at(path).encode
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column(0), batch.column(1), strict=True):
                ids = np.append(encode(text.as_py() or ""), np.uint32(END_ID)).astype("<u4")
                rows += [(doc.as_py(), k, s, n, zlib.crc32(ids[s : s + n].tobytes())) for k, (s, n) in enumerate(cut(len(ids), capacity))]
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], batch.schema.field(0).type), pa.array(cols[1], pa.int32()), *(pa.array(c, pa.int64()) for c in cols[2:])], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return run


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, capacity: int = CAPACITY, group_rows: int = GROUP_ROWS) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A null or empty text is the end id alone; a null id stays null. Texts are encoded whole, however long they or their runs of white space are. Full pieces are sequences of their own and are not shuffled: they are
    named by partition and place, below zero. The others, at most one of each document, are spread over groups by a hash of all but their
    text and a row number, so that no source, id or repeated row fills one; within a group they are placed from the longest to the
    shortest. Repeated rows are packed as documents of their own. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    picked = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = picked.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long"
    # texts are encoded once; both ways on read what was written
    pieces = Scratch(spark, "pieces").keep(picked.mapInArrow(_pieces(tokenizer or default_tokenizer(), capacity), schema).withColumn("row", F.monotonically_increasing_id()))
    whole = pieces.where(F.col("length") >= capacity).withColumn("sequence_id", -1 - F.col("row")).withColumn("offset", F.lit(0).cast("long")).drop("row")
    short = pieces.where(F.col("length") < capacity)
    groups = max(1, round(short.count() / group_rows))
    grouped = short.withColumn("grp", F.pmod(F.xxhash64("doc_id", "row"), F.lit(groups))).drop("row")

    def place(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "doc_id", "piece", "ids_crc32"], ascending=[False, True, True, True], kind="stable")
        bins, offsets = sum_of_squares(pdf["length"].to_numpy(), capacity)
        return pdf.drop(columns="grp").assign(sequence_id=bins + (pdf["grp"].to_numpy() << 32), offset=offsets)

    return whole.unionByName(grouped.groupBy("grp").applyInPandas(place, f"{schema}, sequence_id long, offset long"))
