"""Language identification by hierarchical discrimination.

First a linear SVM per language family picks the family; then one-versus-one linear SVMs among the languages of that family vote for
the language. Both read one vector of hashed character trigrams of the whole text. The models are fitted on the driver on a bounded sample of
labelled texts, some of every language however rare; prediction is one pass over the texts without a shuffle, a few texts at a time as one
matrix product. Margins only say which language fits best, so keep_identified(), which lets documents go, also holds a text against the trigram
frequencies of each language; identify() always answers with the best one.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm.common import LETTER, crc_mod

#: Language families by ISO 639-1 code. A language that isn't listed is a family of its own.
FAMILIES = {
    "germanic": ["en", "de", "nl", "sv", "da", "no", "is"],
    "romance": ["fr", "es", "it", "pt", "ro", "ca", "gl"],
    "slavic": ["ru", "uk", "pl", "cs", "sk", "bg", "sr", "hr", "sl"],
    "baltic": ["lt", "lv"],
    "uralic": ["fi", "et", "hu"],
    "turkic": ["tr", "az", "kk"],
    "indic": ["hi", "bn", "ur", "mr", "gu", "pa"],
}
#: About SAMPLE_PER_LANG labelled texts of each language are used to fit; of many languages fewer, so that all have about MAX_SAMPLE, but never
#: fewer than LEAST_PER_LANG (where there are as many). Every language that has a row is learned.
SAMPLE_PER_LANG, MAX_SAMPLE, LEAST_PER_LANG = 250, 4000, 8
BITS = 13
#: Texts that are judged by one matrix product, and bytes of a text that are counted at once.
STACK, SLICE_BYTES = 64, 1 << 20
#: A text fits a language if the mean log frequency of its words' trigrams, with FIT_SIGMAS standard errors for its length added, is at most FIT_SLACK
#: below what all but FIT_SHARE of the language's sample reach when each half is scored by the other one. Fewer rows set no bound.
FIT_SHARE, FIT_SLACK, FIT_SIGMAS, FIT_ROWS = 0.1, 2.0, 3.0, 4
SHARES = np.dtype([("at", "<u2"), ("share", "<f4")])
_WORD = re.compile(r"\w+")


def features(text: str) -> np.ndarray:
    """Square roots of hashed byte-trigram counts of the lower-cased text, scaled to length 1."""
    counts = np.zeros(1 << BITS, np.int64)
    raw = f" {text.lower()} ".encode("utf-8", "replace")
    for at in range(0, len(raw) - 2, SLICE_BYTES):  # a very long text is counted in slices that share two bytes
        part = np.frombuffer(raw, np.uint8, min(SLICE_BYTES + 2, len(raw) - at), at).astype(np.uint32)
        counts += np.bincount((part[:-2] * np.uint32(0x9E3779B1) + part[1:-1] * np.uint32(0x85EBCA77) + part[2:] * np.uint32(0xC2B2AE3D)) >> np.uint32(32 - BITS), minlength=1 << BITS)
    x = np.sqrt(counts.astype(np.float32))
    return x / max(np.float32(1e-12), np.sqrt(np.float32(x @ x)))


def word_trigrams(text: str) -> tuple[np.ndarray, int]:
    """(place and share of each hashed byte trigram, how many there are) of the words of letters alone: digits and signs are in no language."""
    words = " ".join(w for w in _WORD.findall(text.lower()) if w.isalpha())
    if not words:
        return np.zeros(0, SHARES), 0
    x = features(words)
    out = np.zeros(np.count_nonzero(x), SHARES)
    out["at"] = np.flatnonzero(x)
    out["share"] = np.square(x[out["at"]])
    return out, len(words.encode("utf-8", "replace"))


def fit_svm(x: np.ndarray, y: np.ndarray, rounds: int = 300, reg: float = 1e-4) -> np.ndarray:
    """Weights (the last one is the bias) of a linear SVM: averaged sub-gradient steps on the class-balanced hinge loss; y is +1 or -1."""
    y = y.astype(np.float32)
    cost = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())).astype(np.float32)
    w, mean, shrink = np.zeros(x.shape[1] + 1, np.float32), np.zeros(x.shape[1] + 1, np.float32), np.float32(1 - reg)
    for t in range(rounds):
        push = y * cost * (y * (x @ w[:-1] + w[-1]) < 1)
        w = w * shrink + np.float32(2.0 / (1 + t / 50)) * np.append(push @ x, push.sum())
        if t >= rounds // 2:
            mean += w
    return mean / (rounds - rounds // 2)


@dataclass
class Hierarchy:
    """Fitted models. weights: a row for each; family_at: name to row; pair_at: (language, language) to row."""

    langs: dict[str, list[str]]
    weights: np.ndarray
    family_at: dict[str, int] = field(default_factory=dict)
    pair_at: dict[tuple[str, str], int] = field(default_factory=dict)
    #: Languages with a bound; a row of log frequencies, a standard deviation and a bound for each.
    bounded: list[str] = field(default_factory=list)
    logs: np.ndarray | None = None
    spread: np.ndarray | None = None
    least: np.ndarray | None = None

    def predict(self, texts: list[str]) -> list[tuple[str, float]]:
        """(language, score) of each text: the best family's best language, however little the text looks like it."""
        out = []
        for at in range(0, len(texts), STACK):
            x = np.stack([features(t) for t in texts[at : at + STACK]])
            out += [self._decide(m) for m in (x @ self.weights[:, :-1].T + self.weights[:, -1]).astype(float)]
        return out

    def _decide(self, margins: np.ndarray) -> tuple[str, float]:
        names = list(self.langs)
        if len(names) == 1:
            family, score = names[0], 1.0
        else:
            by = sorted(names, key=lambda n: (-margins[self.family_at[n]], n))
            family = by[0]
            score = _sure(margins[self.family_at[by[0]]] - margins[self.family_at[by[1]]])
        votes = {lang: [0, 0.0] for lang in self.langs[family]}
        for a, b in combinations(self.langs[family], 2):
            m = margins[self.pair_at[a, b]]
            votes[a if m >= 0 else b][0] += 1
            votes[a][1] += m
            votes[b][1] -= m
        best = min(votes, key=lambda k: (-votes[k][0], -votes[k][1], k))
        least = min((m if best == a else -m for (a, b), at in self.pair_at.items() if best in (a, b) for m in [margins[at]]), default=None)
        return best, float(score if least is None else score * _sure(2 * least))

    def fits(self, text: str) -> bool:
        """Whether the words of text reach the bound of any language; true if there are no words, or no bounds."""
        if self.logs is None:
            return True
        found, n = word_trigrams(text)
        return not n or bool((self.logs[:, found["at"]] @ found["share"] + FIT_SIGMAS * self.spread / np.sqrt(n) >= self.least).any())


def _sure(margin: float) -> float:
    return float(1 / (1 + np.exp(-min(30.0, max(-30.0, 2 * margin)))))


def family_of(lang: str) -> str:
    return next((k for k, v in FAMILIES.items() if lang.lower()[:2] in v), f"only-{lang}")


def fit_hierarchy(x: np.ndarray, langs: list[str]) -> Hierarchy:
    """Families one against the rest, then each pair of languages of a family."""
    known = sorted(set(langs))
    tree: dict[str, list[str]] = {}
    for lang in known:
        tree.setdefault(family_of(lang), []).append(lang)
    labels, columns, out = np.array(langs, dtype=object), [], Hierarchy(dict(sorted(tree.items())), np.zeros((0, 0)))
    if len(tree) > 1:
        fam = np.array([family_of(v) for v in langs], dtype=object)
        for name in out.langs:
            out.family_at[name] = len(columns)
            columns.append(fit_svm(x, np.where(fam == name, 1.0, -1.0)))
    for members in out.langs.values():
        for a, b in combinations(members, 2):
            rows = (labels == a) | (labels == b)
            out.pair_at[a, b] = len(columns)
            columns.append(fit_svm(x[rows], np.where(labels[rows] == a, 1.0, -1.0)))
    out.weights = np.array(columns, np.float32) if columns else np.zeros((0, x.shape[1] + 1), np.float32)
    return out


def _frequencies(rows: list[np.ndarray]) -> tuple[np.ndarray, float]:
    """Log trigram frequencies of texts, each text counting the same, and the standard deviation of one trigram's."""
    flat = np.concatenate(rows)
    p = np.bincount(flat["at"], flat["share"], 1 << BITS) / len(rows) + 1 / (30 << BITS)
    p /= p.sum()
    logs = np.log(p)
    return logs.astype(np.float32), float(np.sqrt(max(0.0, p @ (logs * logs) - (p @ logs) ** 2)))


def fit_bounds(model: Hierarchy, sample: list[tuple[str, bytes, int]]) -> None:
    """Set what texts of each language reach, from the distinct ones of sample: (language, word_trigrams as bytes, their number)."""
    bounds = []
    for lang in sorted({v for v, _, _ in sample}):
        distinct = sorted({(raw, n) for v, raw, n in sample if v == lang and n}, key=lambda r: hashlib.blake2b(r[0]).digest())
        if len(distinct) < FIT_ROWS:
            continue
        rows = [np.frombuffer(raw, SHARES) for raw, _ in distinct]
        logs, spread = _frequencies(rows)
        reached = []
        for k in (0, 1):
            other = _frequencies(rows[1 - k :: 2])[0]
            reached += [other[r["at"]] @ r["share"] + FIT_SIGMAS * spread / np.sqrt(n) for r, (_, n) in zip(rows[k::2], distinct[k::2], strict=True)]
        bounds.append((lang, logs, spread, np.quantile(reached, FIT_SHARE) - FIT_SLACK))
    if bounds:
        model.bounded, logs, spread, least = map(list, zip(*bounds, strict=True))
        model.logs, model.spread, model.least = np.array(logs), np.array(spread), np.array(least)


def _with_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x = []
        for t in batch.column(1):
            dense = features(t.as_py())
            part = np.zeros(np.count_nonzero(dense), SHARES)
            part["at"] = np.flatnonzero(dense)
            part["share"] = dense[part["at"]]
            x.append(part.tobytes())
        words = [word_trigrams(t.as_py()) for t in batch.column(1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(x, pa.binary()), pa.array([w.tobytes() for w, _ in words], pa.binary()), pa.array([n for _, n in words], pa.int64())], ["lang", "x", "words", "n"])


def quota(languages: int, per_lang: int = SAMPLE_PER_LANG) -> int:
    """Texts of each language that are used to fit."""
    return max(LEAST_PER_LANG, min(per_lang, MAX_SAMPLE // max(1, languages)))


def train(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", per_lang: int = SAMPLE_PER_LANG) -> Hierarchy | None:
    """Fit on about quota() texts of each language, chosen by a hash of the text, so that neither ids nor row order matter.

    Rows with a null language or a text without a letter teach nothing; copies of a text teach once. None if nothing is left.
    """
    rows = labelled.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where(F.col("lang").isNotNull() & F.col("text").rlike(LETTER))
    rows = rows.withColumn("mark", F.xxhash64("text"))
    # an estimate of distinct texts is enough to choose a share of them by hash, and merges before it is shuffled
    counts = {r["lang"]: max(1, r["n"]) for r in rows.groupBy("lang").agg(F.approx_count_distinct("mark", 0.02).alias("n")).toLocalIterator()}
    if not counts:
        return None
    spread, want = 1 << 40, quota(len(counts), per_lang)
    cut = F.create_map(*[F.lit(v) for lang, n in counts.items() for v in (lang, spread if n <= 1.1 * want else spread * want // n)])
    chosen = rows.where(F.pmod("mark", F.lit(spread)) < cut[F.col("lang")]).groupBy("lang", "mark").agg(F.first("text").alias("text"))
    got = chosen.select("lang", "text").mapInArrow(_with_features, "lang string, x binary, words binary, n long").toArrow()
    if not got.num_rows:
        return None
    langs, raw = got["lang"].to_pylist(), got["x"].to_pylist()
    sample = list(zip(langs, got["words"].to_pylist(), got["n"].to_pylist(), strict=True))
    del got
    order = sorted(range(len(langs)), key=lambda i: (langs[i], hashlib.blake2b(raw[i]).digest()))
    x = np.zeros((len(order), 1 << BITS), np.float32)
    for row, i in zip(x, order, strict=True):
        part = np.frombuffer(raw[i], SHARES)
        row[part["at"]] = part["share"]
    del raw
    model = fit_hierarchy(x, [langs[i] for i in order])
    fit_bounds(model, sample)
    return model


def predict(docs: DataFrame, model: Hierarchy | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, lang_pred, score. `und` with score 0 if the text is null or has no letter, or if there is no model.

    Any other text gets a language of the model, its score saying how clear that was. Repeated rows give a row each and a null id stays
    null; texts count whole, very long ones in slices. An empty table gives an empty result.
    """

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            asked = np.flatnonzero(np.asarray(batch.column(2))) if model else np.zeros(0, np.int64)
            got = [("und", 0.0)] * batch.num_rows
            for a in range(0, len(asked), STACK):
                some = asked[a : a + STACK]
                for i, found in zip(some.tolist(), model.predict(batch.column(1).take(pa.array(some)).to_pylist()), strict=True):
                    got[i] = found
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())], ["doc_id", "lang_pred", "score"])

    picked = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.coalesce(F.col(text_col).rlike(LETTER), F.lit(False)).alias("has_letter"))
    return picked.mapInArrow(judge, f"doc_id {picked.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double")


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", folds: int = 5) -> DataFrame:
    """Per row: doc_id, held_out, lang_pred, score; learned from rows whose crc32(id as text) modulo folds isn't 0.

    lang_pred is `und`, score 0, for null and letter-free texts alone, or where no row teaches anything. Null ids are not held out; repeated
    rows get a row each, and the same text the same answer, whatever its id, source or label. An empty table gives an empty result.
    """
    model = train(docs.where(crc_mod(F.col(id_col), folds) != 0), text_col, lang_col)
    return predict(docs, model, id_col, text_col).select("doc_id", (crc_mod(F.col("doc_id"), folds) == 0).alias("held_out"), "lang_pred", "score")


def keep_identified(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", min_score: float = 0.2) -> DataFrame:
    """docs without the rows that fit no language or score under min_score; all columns stay as they are.

    Null, empty and letter-free texts go; a null id or language doesn't matter; repeated rows are judged alike. Only texts go to Python.
    """
    model = train(docs.where(crc_mod(F.col(id_col), 5) != 0), text_col, lang_col)

    @F.arrow_udf("boolean")
    def known(texts: pa.Array) -> pa.Array:
        out = []
        for at in range(0, len(texts) if model else 0, STACK):
            some = texts.slice(at, STACK).to_pylist()
            out += [score >= min_score and (lang not in model.bounded or model.fits(t)) for (lang, score), t in zip(model.predict(some), some, strict=True)]
        return pa.array(out if model else [False] * len(texts), pa.bool_())

    return docs.where(F.col(text_col).rlike(LETTER)).where(known(F.col(text_col)))
