"""Secret scans by assignment-aware lexing.

Three base patterns find credentials anywhere in a text. On top of them a small lexer reads source and configuration syntax into
name-literal pairs (`name = "x"`, `name: x`, `"name": "x"`, `NAME := 'x' + 'y'`), propagates constants through later names
(`key = "..."`, `password = key`) and scores each literal by how sensitive its target name is and how random it looks. Of a value only
what the score needs is kept, and which literals it is made of as a graph that is walked once, so the work grows with the text.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


# The base patterns, the least lengths, and the order of kinds at equal starts.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
LEAST = {"assign": 12, "access": 18, "hex": 16}
KINDS = ["assign", "access", "hex", "lexed"]

#: Weight of a target name that contains the word; the strongest counts.
SENSITIVE = {
    "password": 3.0, "passwd": 3.0, "passphrase": 3.0, "pwd": 2.5, "secret": 3.0, "token": 2.5, "apikey": 3.0, "accesskey": 3.0,
    "privatekey": 3.0, "credential": 2.5, "auth": 1.5, "signature": 1.0, "key": 1.0,
}
#: A literal is a placeholder if it is one of these signs repeated, stands between one of these pairs, or starts with one of these words and goes on in words.
SIGNS, PAIRS = ["xX", "*", "."], [("<", ">"), ("${", "}"), ("%", "%")]
WORDS = ["your", "my", "example", "sample", "dummy", "test", "change", "replace", "todo", "none", "null", "true", "false"]
MIN_SCORE = 6.0

_OPERATOR = re.compile(r"[:=]")
_TAIL = re.compile(r"(?::=|=>|=|:)[ \t]*")
_TERM = re.compile(r"""(?:"((?:[^"\\\n]|\\.)*)"|'((?:[^'\\\n]|\\.)*)'|([A-Za-z0-9_+/.$-]+(?:=+(?![A-Za-z0-9_+/.$=-]))?))""")
_PLUS = re.compile(r"[ \t]*\+[ \t]*(?=[\"'A-Za-z_])")
_IDENT = re.compile(r"[A-Za-z_][A-Za-z0-9_.-]*\Z")
_HEX_RUN = re.compile(r"[0-9a-f]{16,}")


def base_spans(text: str) -> list[tuple[int, str, int]]:
    """(start, kind, end) of the base patterns: leftmost and non-overlapping per kind, short matches dropped after they matched."""
    found = []
    if ":" in text or "=" in text:
        found += [(m.start(), "assign", m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= LEAST["assign"]]
    if "AKIA" in text:
        found += [(m.start(), "access", m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST["access"]]
    # a run of hex digits is matched whole, so runs of the least length are exactly the matches that stay
    found += [(m.start(), "hex", m.end()) for m in _HEX_RUN.finditer(text)]
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[1])))


def sensitivity(name: str) -> float:
    flat = re.sub(r"[^a-z0-9]", "", name.lower())
    return max((w for k, w in SENSITIVE.items() if k in flat), default=0.0)


_HEAD, _MANY = 16, 1e12
_ODD = re.compile(rb"[\x00-\x1f!-,/:-@\[-^`{-\x7f]")


class Value:
    """What the score needs of a literal: its first characters, the last one, and how often each byte of it occurs."""

    __slots__ = ("head", "last", "counts", "cased", "plain")

    def __init__(self, text: str = ""):
        raw = text.encode("utf-8", "replace")
        self.head, self.last, self.counts = text[:_HEAD], text[-1:], Counter(raw)
        self.cased = (any(c.islower() for c in text), any(c.isupper() or c.istitle() for c in text))
        self.plain = not _ODD.search(raw)

    @staticmethod
    def join(parts: list["Value"]) -> "Value":
        """The values one after another. Counts beyond _MANY are scaled down together: only their shares matter by then."""
        out, at = Value(), 0
        while at < len(parts) and len(out.head) < _HEAD:
            out.head, at = (out.head + parts[at].head)[:_HEAD], at + 1
        out.last = next((v.last for v in reversed(parts) if v.last), "")
        once = {id(v): v for v in parts}
        for key, times in Counter(map(id, parts)).items():
            v = once[key]
            for byte, n in v.counts.items():
                out.counts[byte] += n * times
            out.cased = (out.cased[0] or v.cased[0], out.cased[1] or v.cased[1])
            out.plain = out.plain and v.plain
        if (total := len(out)) > _MANY:
            out.counts = Counter({byte: n * _MANY / total for byte, n in out.counts.items()})
        return out

    def __len__(self) -> int:
        return int(sum(self.counts.values()))

    def has(self, first: str, last: str) -> bool:
        return any(ord(first) <= byte <= ord(last) for byte in self.counts)

    def placeholder(self) -> bool:
        head, used = self.head.lower(), set(self.counts)
        if any(used <= set(sign.encode()) for sign in SIGNS):
            return True
        if any(self.head.startswith(a) and self.last == b and len(self) >= len(a + b) for a, b in PAIRS):
            return True
        return self.plain and head.startswith(tuple(WORDS))

    def randomness(self) -> float:
        """Shannon entropy in bits a byte, plus half a bit for each class of characters beyond the first."""
        n = sum(self.counts.values())
        entropy = -sum(c / n * math.log2(c / n) for c in self.counts.values() if c > 0)
        return entropy + 0.5 * max(0, self.has("a", "z") + self.has("A", "Z") + self.has("0", "9") - 1)


def literal_score(name: str, value: Value) -> float:
    """Sensitivity of the name times the randomness of the literal; 0 for short, spaced and placeholder literals."""
    weight = sensitivity(name)
    if not weight or len(value) < 8 or ord(" ") in value.counts or value.placeholder():
        return 0.0
    if not value.has("0", "9") and value.cased == (True, False):
        return 0.0
    return weight * value.randomness()


class Made:
    """What a value is made of: one span, or the parts of other values."""

    __slots__ = ("span", "parts")

    def __init__(self, span: tuple[int, int] | None, parts: list["Made"]):
        self.span, self.parts = span, parts


def spans_of(made: Made, done: set[int]) -> Iterator[tuple[int, int]]:
    """The spans of all literals below made, but for those under a part in done; what is walked is added to done."""
    todo = [made]
    while todo:
        if id(now := todo.pop()) in done:
            continue
        done.add(id(now))
        if now.span is not None:
            yield now.span
        todo += now.parts


def lex_assignments(text: str) -> Iterator[tuple[str, Value, Made]]:
    """(name, value, what it is made of) of each assignment whose right side resolves to literals; literals joined on the spot share one span."""
    env: dict[str, tuple[Value, Made]] = {}
    done = 0
    for op in _OPERATOR.finditer(text):
        p = op.start()
        if p < done:
            continue
        b = p
        while b and text[b - 1] in " \t":
            b -= 1
        if b and text[b - 1] in "\"'":
            b -= 1
        a = b
        while a and (text[a - 1].isalnum() or text[a - 1] in "_.-"):
            a -= 1
        name = text[a:b].lstrip(".-0123456789")
        if not name or text[p : p + 2] == "==" or text[p : p + 3] in ("://",):
            continue
        at = _TAIL.match(text, p).end()
        values, made, here = [], [], None
        while m := _TERM.match(text, at):
            quoted, end = m[1] if m[1] is not None else m[2], m.end()
            parts = [] if quoted is not None else m[3].rstrip("+").split("+")
            if parts and all(v in env for v in parts):
                values += [env[v][0] for v in parts]
                made += [env[v][1] for v in dict.fromkeys(parts)]
                here, end = None, m.start() + len(m[3].rstrip("+"))
            elif quoted is not None or not made or not _IDENT.match(m[3]):
                # a name that isn't known is a literal only where it comes first
                values.append(Value(m[3] if quoted is None else quoted))
                if here is not None:
                    made[-1] = Made((here, end), [])
                else:
                    here = m.start()
                    made.append(Made(m.span(), []))
            else:
                values.append(Value(m[3]))
                here = None
            if quoted is None:
                done = max(done, end)
            at = end
            if not (plus := _PLUS.match(text, at)):
                break
            at = plus.end()
        if made:
            env[name] = (values[0] if len(values) == 1 else Value.join(values), made[0] if len(made) == 1 else Made(None, made))
            yield name, *env[name]
            done = max(done, p + 1)


def find_spans(text: str, min_score: float = MIN_SCORE) -> tuple[list[tuple[int, str, int]], list[tuple[int, str, int]]]:
    """(base spans, all spans): what the lexer adds is not inside a base span, and every base span stays."""
    base = base_spans(text)
    if ":" not in text and "=" not in text:
        return base, base
    done: set[int] = set()
    found = [(name, value, made) for name, value, made in lex_assignments(text)]  # kept, so that no id is used twice
    extra = {s for name, value, made in found if id(made) not in done and literal_score(name, value) >= min_score for s in spans_of(made, done)}
    starts, reach = [s for s, _, _ in base], list(accumulate((e for _, _, e in base), max))
    added = [(s, "lexed", e) for s, e in extra if not ((k := bisect_right(starts, s)) and reach[k - 1] >= e)]
    return base, sorted([*base, *added], key=lambda s: (s[0], KINDS.index(s[1])))


def joined(spans: list[tuple[int, str, int]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, kind, end in spans)


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_score: float = MIN_SCORE) -> DataFrame:
    """Per row: doc_id, n_assign, n_access, n_hex, base_sha256, spans. One pass without a shuffle.

    A null or empty text has no span (base_sha256 is that of the empty string). A null id stays null. Repeated rows give a row each.
    Offsets are code points, ends are exclusive. An empty table gives an empty result.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = {"n_assign": [], "n_access": [], "n_hex": [], "base_sha256": [], "spans": []}
            for text in batch.column(1):
                base, spans = find_spans(text.as_py() or "", min_score)
                kinds = Counter(k for _, k, _ in base)
                for k in ("assign", "access", "hex"):
                    rows[f"n_{k}"].append(kinds[k])
                rows["base_sha256"].append(hashlib.sha256(joined(base).encode()).hexdigest())
                rows["spans"].append(joined(spans))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(rows[k], pa.int64()) for k in ("n_assign", "n_access", "n_hex")), pa.array(rows["base_sha256"], pa.string()), pa.array(rows["spans"], pa.string())],
                ["doc_id", *rows],
            )

    picked = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = picked.schema["doc_id"].dataType.simpleString()
    return picked.mapInArrow(scan, f"doc_id {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", mark: str = "[SECRET]", min_score: float = MIN_SCORE) -> DataFrame:
    """docs with every span of scan_secrets replaced by mark, all columns kept.

    Overlapping spans become one mark; null texts stay null and empty ones empty; null ids and repeated rows don't matter. Only texts go to
    Python.
    """

    @F.arrow_udf("string")
    def clean(texts: pa.Array) -> pa.Array:
        out = []
        for value in texts:
            text = value.as_py()
            _, spans = find_spans(text or "", min_score)
            if spans:
                parts, done = [], 0
                for start, _, end in spans:
                    if start >= done:
                        parts += [text[done:start], mark]
                    done = max(done, end)
                text = "".join([*parts, text[done:]])
            out.append(text)
        return pa.array(out, pa.string())

    return docs.withColumn(text_col, clean(F.col(text_col)))
