"""The pipeline's stages against versions of their decisions that don't use the code under test, and on odd tables."""

import re
import zlib
from collections import Counter

import corpus_pipeline
import numpy as np
import pytest
from test_llm import brute_jaccard, brute_score, brute_spans, brute_vote, edits

from strandline.llm import language_id, packing, secret_scan

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.Scratch(spark, "test").keep(stage(spark, docs, SF))
        out.append((name, docs.collect()))
    return dict(out)


def trigrams(text):
    """Shares of hashed byte trigrams of the words of letters alone, and the bytes of those words."""
    words = " ".join(w for w in re.findall(r"\w+", text.lower()) if w.isalpha())
    raw = f" {words} ".encode()
    slot = lambda a, b, c: ((a * 0x9E3779B1 + b * 0x85EBCA77 + c * 0xC2B2AE3D) & 0xFFFFFFFF) >> (32 - language_id.BITS)
    counts = Counter(slot(*raw[i : i + 3]) for i in range(len(raw) - 2))
    return {k: v / sum(counts.values()) for k, v in counts.items()}, len(words.encode())


def known(model, text):
    """Has the text a letter, does it fit a language, and is the vote sure enough?"""
    if not text or not any(c.isalpha() for c in text):
        return False
    shares, n = trigrams(text)
    if brute_vote(model, text) in model.bounded and n:
        reach = [sum(model.logs[k, s] * v for s, v in shares.items()) + language_id.FIT_SIGMAS * model.spread[k] / n**0.5 >= model.least[k] for k in range(len(model.bounded))]
        if not any(reach):
            return False
    return brute_score(model, text) >= 0.2


def plain(text):
    return " ".join(re.sub(r"[\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]", " ", text.lower()).split())


def test_stages(spark, stages):
    before = spark.read.parquet(f"{SF}/documents.parquet").collect()
    columns = list(before[0].asDict())
    items = [plain(r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    for name in ("language_id", "jaccard_join", "decontamination", "secret_scan"):
        now = stages[name]
        assert list(now[0].asDict()) == columns
        texts = {r["doc_id"]: r["text"] for r in before}
        kept = {r["doc_id"] for r in now}
        if name == "language_id":
            model = language_id.train(spark.createDataFrame([r for r in before if zlib.crc32(str(r["doc_id"]).encode()) % 5]))
            assert kept == {i for i, t in texts.items() if known(model, t)}
        elif name == "jaccard_join":
            assert kept == {i for i, (_, c) in brute_jaccard(list(texts), list(texts.values())).items() if i == c}
        elif name == "decontamination":
            whole = {i for i, t in texts.items() if any(x in plain(t or "") for x in items if len(x) >= 10)}
            assert not kept & whole
            for i in sorted(set(texts) - kept - whole)[:5]:  # what else goes is near an item
                assert any(edits(x, plain(texts[i])) <= 0.08 * len(x) for x in items if len(x) >= 10)
        else:
            assert kept == set(texts)
            for r in now:
                assert not brute_spans(r["text"]) and r["n_chars"] == len(r["text"] or "")
                if not brute_spans(texts[r["doc_id"]]) and not secret_scan.find_spans(texts[r["doc_id"]] or "")[1]:
                    assert r["text"] == texts[r["doc_id"]]
        before = now
    pieces = stages["best_fit_packing"]
    assert {r["doc_id"] for r in pieces} == {r["doc_id"] for r in before}
    assert max(r["offset"] + r["length"] for r in pieces) <= packing.CAPACITY


def test_odd_tables(spark, tmp_path):
    """Nulls, empty texts, repeated and null ids, a very long text and columns that the operators use themselves; and an empty table."""
    given = spark.read.parquet(f"{SF}/documents.parquet").collect()
    texts = [r["text"] for r in given if r["text"] and len(r["text"]) > 200][:30]
    rows = [(i, t, "en", "s", len(t), 1, "a", "b", "c") for i, t in enumerate(texts)]
    rows += [(0, texts[1], "en", "s", 1, 1, "a", "b", "c"), (0, texts[0], "en", "s", 1, 1, "a", "b", "c"), (None, texts[2], None, None, None, 1, "a", "b", "c"), (None, None, "en", "s", 0, 1, "a", "b", "c"), (40, "", "en", "s", 0, 1, "a", "b", "c"), (41, " ".join(texts) * 20, "en", "s", 0, 1, "a", "b", "c")]
    schema = "doc_id long, text string, lang string, source string, n_chars long, cls int, found string, row string, lang_pred string"
    docs = spark.createDataFrame(rows, schema)
    for table in (docs, docs.where("false")):
        now = table
        for name, stage in corpus_pipeline.STAGES:
            after = corpus_pipeline.Scratch(spark, "odd").keep(stage(spark, now, SF))
            if name != "best_fit_packing":
                assert after.columns == docs.columns
            now = after
        got = now.collect()
        assert bool(got) == (table is docs)
    assert None in {r["doc_id"] for r in corpus_pipeline.keep_one_copy(spark, docs, SF).collect()}
    lengths = Counter(r["doc_id"] for r in got)
    assert not lengths or np.isfinite(sum(lengths.values()))
