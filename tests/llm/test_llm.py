"""Each operator against a brute-force version on small tables with nulls, empty and long texts, ties, repeated rows and clashing names."""

import hashlib
import itertools
import json
import math
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from strandline.llm import chat_format, decontaminate, embedding_dedup, jaccard_join, language_id, lm_score, packing, secret_scan, shingles, suffix_dedup, url_filter

SYLLABLES = ["the", "an", "ti", "on", "er", "re", "ed", "nd", "ha", "ou", "wh", "st"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, bucket int, cls string, score int, tag string"


def slowness():
    """How many times a millisecond this machine takes just now for what takes one on the machine that the limits were set on; at least 1."""
    took = []
    for _ in range(21):
        began = time.thread_time()
        sum(range(50_000))
        took.append((time.thread_time() - began) * 1000)
    return max(1.0, sorted(took)[10])


def prose(rng, n, parts=SYLLABLES):
    return " ".join("".join(rng.choice(parts) for _ in range(rng.randint(1, 3))) for _ in range(n))


def corpus(n=60, seed=0):
    """Texts with exact and near copies, shared passages, nulls, empties and one long text."""
    rng = random.Random(seed)
    texts = [prose(rng, rng.randint(1, 80)) for _ in range(n)]
    passage = prose(rng, 60)
    for i in range(0, n, 7):
        texts[i] = texts[i] + "\n" + passage
    for i in range(3, n, 9):
        texts[i] = texts[i - 3]
    for i in range(5, n, 8):
        w = texts[i - 4].split(" ")
        w[len(w) // 2] = "CHANGED"
        texts[i] = " ".join(w)
    texts[10], texts[11], texts[12], texts[13] = None, "", "  \t\n ", "É ß 漢字 \u00a0 end"
    texts[14] = prose(rng, 4000)
    return texts


def table(spark, texts, ids=None):
    ids = list(range(len(texts))) if ids is None else ids
    rows = [(i, t, "en" if k % 2 else "fr", "s", len(t or ""), 1, "x", 2, "y") for k, (i, t) in enumerate(zip(ids, texts, strict=True))]
    return spark.createDataFrame(rows, SCHEMA)


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def tokens(t):
    return re.findall(r"[^\x20\x09-\x0D]+", lower(t))


def shingle_set(t, k=5):
    w = tokens(t)
    return frozenset([tuple(w)] if 0 < len(w) < k else [tuple(w[i : i + k]) for i in range(len(w) - k + 1)])


def components(ids, links):
    root = {i: i for i in ids}
    for _ in ids:
        for a, b in links:
            low = min(root[a], root[b])
            root[a] = root[b] = low
    return root


def test_words_and_shingles():
    texts = [t or "" for t in corpus()]
    raw = [t.encode() for t in texts]
    flat, offsets = np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])
    marks, text = shingles.words(flat, offsets)
    assert np.bincount(text, minlength=len(texts)).tolist() == [len(tokens(t)) for t in texts]
    names = {}
    for m, w in zip(marks.tolist(), [w for t in texts for w in tokens(t)], strict=True):
        assert names.setdefault(m, w) == w
    assert len(names) == len({w for t in texts for w in tokens(t)})
    found, bounds = shingles.shingle_sets(flat, offsets, 5)
    assert np.diff(bounds).tolist() == [len(shingle_set(t)) for t in texts]


def test_language_id(spark):
    rng = random.Random(1)
    parts = {"en": ["the", "ing", "wh", "th"], "de": ["sch", "ung", "ß", "ei"], "fr": ["eau", "è", "oi", "que"], "es": ["ción", "ñ", "os", "ll"]}
    langs = [list(parts)[i % 4] for i in range(200)]
    texts = [prose(rng, 30, parts[v]) for v in langs]
    ids = list(range(200))
    df = spark.createDataFrame([*zip(ids, texts, langs), (200, None, "en"), (201, "", "en"), (202, "12 34 !!", "en"), (None, texts[0], "en"), (0, texts[0], "en")], "doc_id long, text string, lang string")
    got = language_id.identify(df).collect()
    assert len(got) == 205
    by = {r["doc_id"]: r for r in got}
    assert all(by[i]["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i in ids)
    held = [i for i in ids if by[i]["held_out"]]
    assert np.mean([by[i]["lang_pred"] == langs[i] for i in held]) > 0.95
    assert all(0 <= r["score"] <= 1 for r in got) and all(by[i]["lang_pred"] == "und" for i in (200, 201, 202))
    kept = language_id.keep_identified(df)
    assert kept.columns == df.columns and {r["doc_id"] for r in kept.collect()} == {*ids, None}
    empty = spark.createDataFrame([], df.schema)
    assert language_id.identify(empty).count() == 0


def test_language_id_rejects_other_languages(spark):
    rng = random.Random(9)
    parts = {"en": ["the", "ing", "wh", "th"], "de": ["sch", "ung", "ß", "ei"], "fr": ["eau", "è", "oi", "que"], "es": ["ción", "ñ", "os", "ll"]}
    rows = [(i, prose(rng, rng.choice([3, 30, 300]), parts[v]), v) for i in range(400) for v in [list(parts)[i % 4]]]
    none = [prose(rng, 40, ["ää", "yö", "kk", "nen"]), prose(rng, 40, ["щу", "кра", "ться", "ые"]), prose(rng, 40, ["漢", "字", "です"]), prose(rng, 40, ["zx", "qj", "kv", "bp"]), "Pchnąć w tę łódź jeża lub ośm skrzyń fig"]
    rows += [(1000 + i, t, lang) for i, t in enumerate(none) for lang in (None, "en")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert {r["doc_id"] for r in language_id.keep_identified(df).collect()} == set(range(400))
    model = language_id.train(df)
    answers = language_id.predict(df.where("doc_id >= 1000"), model).collect()
    assert len(answers) == 10 and {r["lang_pred"] for r in answers} <= set(parts) and not any(model.fits(t) for t in none)


def test_every_text_with_a_letter_gets_a_language(spark):
    """Short, odd, foreign and very long texts; only null and letter-free ones are undetermined."""
    rng = random.Random(9)
    parts = {"en": ["the", "ing", "wh", "th"], "de": ["sch", "ung", "ß", "ei"], "fr": ["eau", "è", "oi", "que"], "es": ["ción", "ñ", "os", "ll"]}
    rows = [(i, prose(rng, rng.choice([3, 30]), parts[v]), v) for i in range(200) for v in [list(parts)[i % 4]]]
    odd = ["Xk", "zzzz qqqq wwww", "def f(x): return x+1", "Lorem ipsum dolor sit amet", "Это русское предложение", "漢字", "x" * 3_000_000, prose(rng, 300_000, parts["de"]), "é"]
    rows += [(1000 + i, t, None) for i, t in enumerate(odd)] + [(2000 + i, t, None) for i, t in enumerate([None, "", "12 34", "\n\t --", "١٢٣"])]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r["doc_id"]: r for r in language_id.identify(df).collect()}
    assert all(got[1000 + i]["lang_pred"] in parts and 0 < got[1000 + i]["score"] <= 1 for i in range(len(odd))) and got[1007]["lang_pred"] == "de"
    assert all((got[2000 + i]["lang_pred"], got[2000 + i]["score"]) == ("und", 0.0) for i in range(5))


def test_language_id_learns_every_language(spark, monkeypatch):
    rng = random.Random(12)
    letters = [chr(c) for c in [*range(0x61, 0x7B), *range(0xE0, 0xF6), *range(0x3B1, 0x3C9), *range(0x430, 0x44F)]]
    own = {f"q{k:02d}": rng.sample(letters, 9) for k in range(40)}
    word = lambda v: "".join(rng.choice(own[v]) for _ in range(rng.randint(3, 7)))
    rows = [(i, " ".join(word(v) for _ in range(25)), v) for i in range(6000) for v in [f"q{i % 40:02d}"]]
    rows += [(6000 + i, "the same copied text", "q00") for i in range(2000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(7)
    assert language_id.quota(40) == 100 and language_id.quota(4) == 250 and language_id.quota(100_000) == language_id.LEAST_PER_LANG
    monkeypatch.setattr(language_id, "MAX_SAMPLE", 600)
    model = language_id.train(df)
    assert sorted(v for members in model.langs.values() for v in members) == sorted(own)
    got = language_id.predict(df.where("doc_id < 400"), model).collect()
    assert np.mean([r["lang_pred"] == f"q{r['doc_id'] % 40:02d}" for r in got]) > 0.9


def brute_vote(model, text):
    """The same decision from the margins alone, written out: families first, then every pair inside the best one."""
    x = language_id.features(text).astype(float)
    margin = lambda row: float(np.dot(model.weights[row, :-1].astype(float), x) + model.weights[row, -1])
    family = next(iter(model.langs)) if len(model.langs) == 1 else max(sorted(model.langs), key=lambda f: margin(model.family_at[f]))
    wins, sums = Counter(), Counter()
    for (a, b), row in model.pair_at.items():
        if a in model.langs[family]:
            wins[a if margin(row) >= 0 else b] += 1
            sums[a] += margin(row)
            sums[b] -= margin(row)
    return min(model.langs[family], key=lambda v: (-wins[v], -sums[v], v))


def brute_score(model, text):
    """How clear the vote was, from the margins alone: the lead of the best family, times the narrowest pair of the best language."""
    x = language_id.features(text).astype(float)
    margin = lambda row: float(np.dot(model.weights[row, :-1].astype(float), x) + model.weights[row, -1])
    sure = lambda m: 1 / (1 + math.exp(-min(30, max(-30, 2 * m))))
    best, lead = brute_vote(model, text), sorted((margin(row) for row in model.family_at.values()), reverse=True)
    pairs = [margin(row) * (1 if best == a else -1) for (a, b), row in model.pair_at.items() if best in (a, b)]
    return (sure(lead[0] - lead[1]) if len(lead) > 1 else 1.0) * (sure(2 * min(pairs)) if pairs else 1.0)


def test_language_id_votes_and_ties(spark):
    rng = random.Random(13)
    parts = {"en": ["the", "ing", "wh"], "de": ["sch", "ung", "ei"], "nl": ["ij", "oe", "aa"], "sv": ["sk", "å", "ör"], "fr": ["eau", "è", "oi"], "es": ["ción", "ñ", "os"]}
    rows = [(i, prose(rng, 20, parts[v]), v) for i in range(300) for v in [list(parts)[i % 6]]]
    mixed = [prose(rng, 20, parts["en"] + parts["de"]) for _ in range(30)] + [rows[0][1]] * 3
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.train(df)
    texts = [r[1] for r in rows] + mixed
    assert [lang for lang, _ in model.predict(texts)] == [brute_vote(model, t) for t in texts]
    tie = language_id.Hierarchy({"f": ["a", "b", "c"]}, np.zeros((3, (1 << language_id.BITS) + 1), np.float32), {}, {("a", "b"): 0, ("a", "c"): 1, ("b", "c"): 2})
    assert tie.predict(["any text"]) == [("a", 0.5)] and brute_vote(tie, "any text") == "a"
    clash = df.withColumnsRenamed({"lang": "lang_pred", "doc_id": "score"}).withColumn("held_out", F.lit("x")).withColumn("has_letter", F.lit("y"))
    got = language_id.identify(clash, "score", "text", "lang_pred")
    assert got.columns == ["doc_id", "held_out", "lang_pred", "score"] and got.count() == 300


def test_language_prediction_ignores_columns(spark):
    df = table(spark, corpus())
    model = language_id.train(df)
    a = language_id.predict(df, model).collect()
    b = language_id.predict(df.drop("lang", "source"), model).collect()
    assert sorted(map(str, a)) == sorted(map(str, b))


def edits(item, text):
    row = [0] * (len(text) + 1)
    for c in item:
        new = [row[0] + 1]
        for j, d in enumerate(text):
            new.append(min(row[j] + (c != d), row[j + 1] + 1, new[j] + 1))
        row = new
    return min(row)


def test_decontamination(spark):
    rng = random.Random(2)
    items = [prose(rng, 25) for _ in range(6)] + [None, "short", ""]
    texts = [prose(rng, rng.randint(0, 60)) for _ in range(20)] + [None, ""]
    for i, e in enumerate([0, 2, 5, 9, 14, 25]):
        t = list(items[i])
        for _ in range(e):
            t[rng.randrange(len(t))] = rng.choice("xyz")
        texts[i] = texts[i] + " " + "".join(t) + " " + texts[i]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    docs = table(spark, texts)
    want = {}
    for d, t in enumerate(texts):
        raw = decontaminate.normalise(t or "")
        hits = [(i, edits(decontaminate.normalise(x or ""), raw)) for i, x in enumerate(items) if len(decontaminate.normalise(x or "")) >= decontaminate.Q]
        want[d] = ",".join(f"{i}:{e}" for i, e in hits if e <= decontaminate.edit_budget(len(decontaminate.normalise(items[i]))))
    got = {r["doc_id"]: r for r in decontaminate.find_contamination(docs, bench).collect()}
    assert {d: r["items"] for d, r in got.items()} == want and any(want.values())
    blocks = {r["doc_id"]: r["items"] for r in decontaminate.find_contamination(docs, bench, block_bytes=200).collect()}
    assert blocks == want
    kept = decontaminate.drop_contaminated(docs, bench)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {d for d, w in want.items() if not w}
    assert decontaminate.find_contamination(docs, bench.where("false")).where("contaminated").count() == 0


def test_decontamination_at_the_ends_of_a_text():
    rng = random.Random(8)
    for n in range(60):
        item = decontaminate.normalise(prose(rng, 30))[:200].strip()
        e = decontaminate.edit_budget(len(item))
        near = list(item)
        kind = n % 3
        for _ in range(rng.choice([1, 4, e // 2, e])):
            at = rng.choice([0, 1, len(near) // 2, len(near) - 2, len(near) - 1, rng.randrange(len(near))])
            if kind == 0 or kind == 2 and rng.random() < 0.5:
                del near[at]
            else:
                near.insert(at, rng.choice("xyz"))
        near, other = "".join(near), prose(rng, 20)
        for text in (near, near + " " + other, other + " " + near):
            raw = decontaminate.normalise(text)
            want = edits(item, raw)
            found = decontaminate.ItemIndex.build([(1, item)]).find(text)
            assert found == ([(1, want)] if want <= e else []), (n, text)
    index = decontaminate.ItemIndex.build([(1, "abcdefghijklmnopqrst")])
    assert index.find("abcdefghijlmnopqrst") == [(1, 1)] and index.budgets.tolist() == [1]


def test_decontamination_counts_characters():
    rng = random.Random(14)
    item = decontaminate.normalise(prose(rng, 30, ["ä", "ß", "漢", "щу", "é", "a", "ñ"]))
    for n in range(0, 14):
        near = list(item)
        for at in rng.sample(range(len(near)), n):
            near[at] = rng.choice("öüя字z")
        text = "vor " + "".join(near) + " nach"
        want = edits(item, decontaminate.normalise(text))
        found = decontaminate.ItemIndex.build([(1, item)]).find(text)
        assert found == ([(1, want)] if want <= decontaminate.edit_budget(len(item)) else []), n


def test_decontamination_of_templated_items(monkeypatch):
    rng = random.Random(15)
    stem = "which of the following sentences is the right answer to the question about "
    items = [(i, f"{stem}{prose(rng, 4)} number {i}") for i in range(1000)]
    index = decontaminate.ItemIndex.build(items)
    text = " ".join(f"{stem}{prose(rng, 4)}." if k % 3 else items[k][1] + "x" for k in range(90))[:10_000]
    began = time.process_time()
    got = index.find(text)
    assert time.process_time() - began < 5 * slowness()
    raw = decontaminate.normalise(text)
    some = [0, 3, 6, *rng.sample(range(1000), 12)]
    want = {i: e for i in some for e in [edits(index.texts[i], raw)] if e <= index.budgets[i]}
    assert {i: e for i, e in got if i in some} == want and len(want) >= 3
    monkeypatch.setattr(decontaminate, "MAX_HITS", 2000)
    monkeypatch.setattr(decontaminate, "MAX_CELLS", 5000)
    short = text[:1500]
    assert index.find(short) == decontaminate.ItemIndex.build(items).find(short)
    same = [(1, "a" * 600), (2, "ab" * 200)]
    assert decontaminate.ItemIndex.build(same).find("a" * 3000 + "ab" * 199) == [(1, 0), (2, 1)]


def test_decontamination_does_not_depend_on_blocks(spark):
    rng = random.Random(16)
    items = [(i // 2 if i < 6 else None, prose(rng, 20)) for i in range(8)] + [(9, items_text) for items_text in [prose(rng, 20)] * 2]
    texts = [items[0][1], items[0][1] + " and " + items[9][1], None, "", items[7][1], prose(rng, 50), items[3][1]]
    docs = table(spark, texts, [5, 5, None, None, None, 1, 2]).withColumnRenamed("tag", "found")
    bench = spark.createDataFrame(items, "item_id long, text string").withColumnRenamed("item_id", "contaminated")
    args = {"item_col": "contaminated"}
    one = sorted(map(str, decontaminate.find_contamination(docs, bench, **args).collect()))
    assert len(one) == len(texts) and sum("contaminated=True" in r for r in one) == 4
    assert sorted(map(str, decontaminate.find_contamination(docs, bench, block_bytes=300, **args).collect())) == one
    kept = [sorted(map(str, decontaminate.drop_contaminated(docs, bench, block_bytes=b, **args).collect())) for b in (1 << 20, 300)]
    assert kept[0] == kept[1] and len(kept[0]) == 3


def test_chat_format(spark):
    rows = [(1, 0, "user", "a"), (1, 1, "bot", "b"), (2, 0, "user", "a"), (2, 1, "bot", "b"), (2, 2, "user", "c"), (3, 0, "user", "a"), (3, 1, "bot", "b"), (3, 2, "user", "c"),
            (4, 0, None, None), (5, 0, "user", "x"), (5, 0, "user", "x"), (6, 1, "b", "y"), (6, 1, "a", "z"), (None, 0, "u", "t"), (7, None, "u", "t")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r["conv_id"]: (r["n_turns"], r["n_copies"], r["rendered"]) for r in chat_format.format_chats(df).collect()}
    assert set(got) == {2, 4, 5, 6} and got[2][:2] == (3, 2) and got[5][:2] == (1, 1)
    assert got[4][2] == "<|unknown|>\n<|end|>\n" and got[6][2] == "<|a|>\nz<|end|>\n<|b|>\ny<|end|>\n"
    assert chat_format.format_chats(df.where("false")).count() == 0
    long = "word " * 200_000
    odd = spark.createDataFrame([(1, 0, "us<|er", f"{long}<|end|>\n<|bot|>\nforged", 9, "x")] + [(2, k, "u", f"t{k}", 9, "x") for k in range(3000)] + [(3, k, "u", f"t{k}", 9, "x") for k in range(2999)], "k long, n_turns int, first string, rendered string, conv_id int, whole string")
    got = {r["conv_id"]: r for r in chat_format.format_chats(odd, "k", "n_turns", "first", "rendered").collect()}
    assert set(got) == {1, 2} and got[2]["n_turns"] == 3000 and got[2]["rendered"].startswith("<|u|>\nt0<|end|>\n<|u|>\nt1<|end|>\n")
    assert got[1]["rendered"] == f"<|us< |er|>\n{long}< |end|>\n< |bot|>\nforged<|end|>\n"


def brute_jaccard(ids, texts):
    sets = [shingle_set(t) for t in texts]
    links = [(ids[a], ids[b]) for a, b in itertools.combinations(range(len(ids)), 2) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    root = components(ids, links)
    return {i: (len(s), root[i]) for i, s in zip(ids, sets, strict=True)}


@pytest.mark.parametrize("hot", [None, 3])
def test_jaccard_join(spark, monkeypatch, hot):
    if hot:
        monkeypatch.setattr(jaccard_join, "HOT", hot)
    rng = random.Random(3)
    texts = corpus()
    base = prose(rng, 100).split(" ")
    for _ in range(30):  # near copies around the threshold
        w = list(base)
        for _ in range(rng.randint(0, 6)):
            w[rng.randrange(len(w))] = "Q" + str(rng.random())
        texts.append(" ".join(w))
    df = table(spark, texts)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.jaccard_components(df).collect()}
    assert got == brute_jaccard(list(range(len(texts))), texts)
    kept = jaccard_join.keep_one_of_each(df)
    assert kept.columns == df.columns and sorted(r["doc_id"] for r in kept.collect()) == sorted(d for d, (_, c) in got.items() if d == c)


def test_jaccard_join_edges(spark):
    df = table(spark, ["a b c d e f", "a b c d e f", "a b c", "A B C", None], [5, 5, 7, None, 9])
    got = sorted(map(tuple, jaccard_join.jaccard_components(df).collect()), key=str)
    assert got == sorted([(5, 2, 5), (5, 2, 5), (7, 1, 7), (None, 1, None), (9, 0, 9)], key=str)
    assert jaccard_join.jaccard_components(df.where("false")).count() == 0


def test_jaccard_join_of_repeated_ids(spark):
    a, b = "a b c d e f g", "h i j k l m n"
    df = table(spark, [a, a, b, "o p q r s", a, b, None, None, "x y"], [5, 5, 5, 5, 7, 4, None, 5, None])
    kept = jaccard_join.keep_one_of_each(df)
    assert kept.columns == df.columns
    assert sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=str) == sorted([(5, a), (4, b), (5, "o p q r s"), (None, None), (5, None), (None, "x y")], key=str)


def test_jaccard_join_of_a_common_line(spark):
    texts = [f"one very common line w{i}" if i % 2 else f"w{i} one very common line and w{i % 7} more words to follow it" for i in range(400)]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.jaccard_components(table(spark, texts)).collect()}
    assert got == brute_jaccard(list(range(len(texts))), texts)


def brute_repeats(ids, texts, n=50):
    seen, out = {}, {}
    raws = [(t or "").encode() for t in texts]
    for i, raw in zip(ids, raws, strict=True):
        for k in range(len(raw) - n + 1):
            w = raw[k : k + n]
            seen[w] = min(seen.get(w, i), i)
    for i, raw in zip(ids, raws, strict=True):
        gone = [False] * len(raw)
        for k in range(len(raw) - n + 1):
            if seen[raw[k : k + n]] < i:
                gone[k : k + n] = [True] * n
        kept = bytes(c for c, g in zip(raw, gone, strict=True) if not g)
        out[i] = (len(raw), sum(gone), sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone)), hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("slice_bytes", [4 << 20, 600])
def test_suffix_dedup(spark, monkeypatch, slice_bytes):
    monkeypatch.setattr(suffix_dedup, "SLICE_BYTES", slice_bytes)
    rng = random.Random(4)
    texts = corpus() + ["x" * 300, "x" * 200, "ab" * 120, "\0" * 90, "\0" * 120]
    ids = list(range(len(texts)))
    rng.shuffle(ids)
    got = {r["doc_id"]: tuple(r)[1:] for r in suffix_dedup.remove_repeats(table(spark, texts, ids)).collect()}
    assert got == brute_repeats(ids, texts)


def test_suffix_dedup_edges(spark):
    t = "0123456789" * 6
    got = sorted((r["doc_id"], r["n_removed"]) for r in suffix_dedup.remove_repeats(table(spark, [t, t, t], [1, 1, 2])).collect())
    assert got == [(1, 0), (1, 0), (2, 60)]
    assert suffix_dedup.remove_repeats(table(spark, [t, t], [None, 3])).agg({"n_removed": "sum"}).first()[0] == 0
    assert suffix_dedup.remove_repeats(table(spark, [t]).where("false")).count() == 0


def test_suffix_dedup_of_equal_chunks(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "SLICE_BYTES", 200)
    monkeypatch.setattr(suffix_dedup, "ANCHOR_BLOCK", 64)
    rng = random.Random(19)
    t = prose(rng, 60)
    ids, texts = [3, 3, 3, 4, 4, None, 2, 2], [t, t, t, t[:90], t[:90], t, prose(rng, 30), t[20:120]]
    df = table(spark, texts, ids).repartition(3)
    got = sorted((tuple(r) for r in suffix_dedup.remove_repeats(df).collect()), key=str)
    raws = [x.encode() for x in texts]
    want = []
    for i, raw in zip(ids, raws, strict=True):
        earlier = {r[k : k + 50] for j, r in zip(ids, raws, strict=True) if i is not None and j is not None and j < i for k in range(len(r) - 49)}
        gone = [False] * len(raw)
        for k in range(len(raw) - 49):
            if raw[k : k + 50] in earlier:
                gone[k : k + 50] = [True] * 50
        kept = bytes(c for c, g in zip(raw, gone, strict=True) if not g)
        want.append((i, len(raw), sum(gone), sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone)), hashlib.sha256(kept).hexdigest()))
    assert got == sorted(want, key=str) and any(w[2] for w in want)


def test_equal_windows_is_a_suffix_order():
    rng = np.random.default_rng(5)
    rows = np.zeros((40, -(-suffix_dedup.WIDTH // 8) * 8), np.uint8)
    length = rng.integers(50, suffix_dedup.WIDTH + 1, 40)
    for i, n in enumerate(length):
        rows[i, :n] = rng.integers(97, 99, n) if i % 3 else rows[i - 1, :n]
    group, piece, offset = suffix_dedup.equal_windows(rows, length)
    want = {}
    for i, n in enumerate(length):
        for k in range(n - 49):
            want.setdefault(rows[i, k : k + 50].tobytes(), set()).add((i, k))
    got = {}
    for g, i, k in zip(group.tolist(), piece.tolist(), offset.tolist(), strict=True):
        got.setdefault(g, set()).add((i, k))
    assert sorted(map(sorted, got.values())) == sorted(sorted(v) for v in want.values() if len(v) > 1)


def test_embedding_dedup(spark, monkeypatch):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(400, 16))
    for i in range(100, 250):
        x[i] = x[i % 20] + rng.normal(size=16) * rng.choice([0.0, 0.02, 0.05])
    label = [int(i % 3) for i in range(400)]
    rows = [(i, [float(v) for v in x[i]], label[i]) for i in range(400)]
    rows += [(400, None, 1), (401, [0.0] * 16, 1), (402, [float("nan")] * 16, 1), (403, [None] + [1.0] * 15, 1), (404, rows[0][1], None), (405, [], 0), (None, rows[0][1], 0), (406, [float("inf")] * 16, 1), (407, rows[0][1][:8], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    y = np.array([[np.float32(v) for v in r[1]] for r in rows[:400]], float)
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    links = [(a, b) for a, b in itertools.combinations(range(400), 2) if label[a] == label[b] and y[a] @ y[b] >= 0.93]
    n, root = Counter(itertools.chain.from_iterable(links)), components(range(400), links)
    for block in (512, 5):
        monkeypatch.setattr(embedding_dedup, "BLOCK", block)
        got = {r["vec_id"]: r for r in embedding_dedup.dedup_embeddings(df).collect()}
        assert len(got) == 409
        assert sum(got[i]["n_links"] for i in range(400)) >= 0.97 * 2 * len(links) and all(got[i]["n_links"] <= n[i] for i in range(400))
        assert np.mean([got[i]["component_id"] == root[i] for i in range(400)]) > 0.97
        assert all(got[i]["n_links"] == 0 and got[i]["kept"] and got[i]["component_id"] == i for i in [*range(400, 408), None])
    assert embedding_dedup.dedup_embeddings(df.where("false")).count() == 0


def test_embedding_dedup_of_repeated_ids_and_text_labels(spark):
    rng = np.random.default_rng(18)
    a, b = (rng.normal(size=8) for _ in range(2))
    rows = [(1, a, "x"), (5, a * 2 + 1e-3, "x"), (5, b, "x"), (7, b + 1e-3, "x"), (5, a, "y"), (9, a, None), (5, a, "x")]
    df = spark.createDataFrame([(i, [float(x) for x in v], label, 3, "z") for i, v, label in rows], "vec_id long, embedding array<double>, label string, links int, cls string")
    got = sorted(map(tuple, embedding_dedup.dedup_embeddings(df).collect()))
    assert got == sorted([(1, 2, 1, True), (5, 2, 1, False), (5, 1, 5, True), (7, 1, 5, False), (5, 0, 5, True), (9, 0, 9, True), (5, 2, 1, False)])


@pytest.mark.parametrize(("list_rows", "depth"), [(1000, 1), (10, 2), (1, 3)])
def test_embedding_recall_against_brute_force(spark, monkeypatch, list_rows, depth):
    """Lists named by one pivot, and by two and three as in large tables. Vectors of the given table with noisy copies of every 20th (cosines on both sides of the cut); ids divisible by 20 against all rows."""
    rng = np.random.default_rng(20)
    given = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").toPandas()
    x, label = np.stack(given["embedding"].to_numpy()).astype(float), given["label"].to_numpy()
    some = np.flatnonzero(np.arange(len(x)) % 20 == 0)
    copies = [x[some] + rng.normal(size=(len(some), x.shape[1])) * size * np.linalg.norm(x[some], axis=1, keepdims=True) / math.sqrt(x.shape[1]) for size in (0.05, 0.2, 0.3, 0.36, 0.4)]
    x, label = np.concatenate([x, *copies]), np.concatenate([label, *[label[some]] * len(copies)])
    df = spark.createDataFrame([(i, v, int(y)) for i, (v, y) in enumerate(zip(x.tolist(), label.tolist(), strict=True))], "vec_id long, embedding array<double>, label int")
    monkeypatch.setattr(embedding_dedup, "LIST_ROWS", list_rows)
    assert embedding_dedup.depth_of(len(x), math.ceil(2 * math.sqrt(len(x)))) == depth
    got = {r["vec_id"]: r["n_links"] for r in embedding_dedup.dedup_embeddings(df).collect()}
    u = embedding_dedup.unit(x)
    queries = np.arange(0, len(x), 20)
    want = ((u[queries] @ u.T >= embedding_dedup.CUT) & (label[queries][:, None] == label[None, :])).sum(axis=1) - 1
    found = np.array([got[i] for i in queries.tolist()])
    assert want.sum() > 500 and (found <= want).all() and found.sum() >= 0.95 * want.sum()


def test_lists_stay_short_at_any_size():
    """Vectors of an average list as the table grows, with all the pivots that may be used."""
    for n in (10**5, 10**7, 10**8, 10**9):
        pivots = min(embedding_dedup.MAX_PIVOTS, math.ceil(2 * math.sqrt(n)))
        depth = embedding_dedup.depth_of(n, pivots)
        assert math.comb(embedding_dedup.NEAREST, depth) * n / math.comb(pivots, depth) <= embedding_dedup.LIST_ROWS
    order = np.array([[7, 3, 9, 1, 4, 2], [9, 7, 5, 1, 8, 0]])
    names = embedding_dedup.list_names(order, 3)
    assert names.shape == (2, 20) and len(set(names[0]) & set(names[1])) == 1
    assert embedding_dedup._first_shared(order[:1], order[1:], 3)[0] in set(names[0]) & set(names[1])
    assert embedding_dedup._first_shared(order[:1], order[1:], 4)[0] == -1


def test_pivot_orders_count_by_place():
    a, b = np.array([[3, 1, 2, 9, 8, 7]]), np.array([[3, 5, 6, 1, 4, 0], [0, 4, 5, 6, 2, 3]])
    n = embedding_dedup.NEAREST
    want = [(n * n + (n - 1) * (n - 3)) / n**2, (n * (n - 5) + (n - 2) * (n - 4)) / n**2]
    assert np.allclose(embedding_dedup.shared_counts(a, b)[0], want)
    x = np.eye(3)[[0, 0, 1]] + 0.01
    assert embedding_dedup.permutations(x, np.eye(3))[:, 0].tolist() == [0, 0, 1]


def test_lm_score(spark):
    texts = corpus()
    df = table(spark, texts)
    held = [zlib.crc32(str(i).encode()) % 7 == 2 for i in range(len(texts))]
    lists = [[*tokens(t), None] for t in texts]
    c = Counter(w for t, h in zip(lists, held, strict=True) if not h for w in t)
    total, types = sum(c.values()), len(c)
    got = {r["doc_id"]: r for r in lm_score.score_texts(df).collect()}
    for i, t in enumerate(lists):
        r = got[i]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[i], len(t), sum(c[w] > 0 for w in t), total)
        assert math.isclose(r["base_score"], sum(math.log10((c[w] + 1) / (total + types + 1)) for w in t), rel_tol=1e-9)
        assert r["score"] < 0
    out = [i for i in range(len(texts)) if held[i]]
    assert sum(got[i]["score"] for i in out) > sum(got[i]["base_score"] for i in out)
    assert lm_score.score_texts(df.where("false")).count() == 0
    odd = lm_score.score_texts(table(spark, ["a", "a"], [None, 1])).collect()
    assert {(r["doc_id"], r["held_out"]) for r in odd} == {(None, None), (1, zlib.crc32(b"1") % 7 == 2)}


def test_lm_score_by_brute_force(spark):
    """The mixture written out with dictionaries; EM on exact held-out counts, so weights differ a little from those on classes of counts."""
    rng = random.Random(22)
    texts = [prose(rng, rng.randint(0, 120), ["the", "an", "ti"]) for _ in range(120)] + [None, ""]
    held = [zlib.crc32(str(i).encode()) % 7 == 2 for i in range(len(texts))]
    lists = [["<s>", *tokens(t), "</s>"] for t in texts]
    pairs, ones = Counter(), Counter()
    for t, h in zip(lists, held, strict=True):
        if not h:
            pairs.update(zip(t[:-1], t[1:], strict=True))
            ones.update(t)
    total, types = sum(c for w, c in ones.items() if w != "<s>"), len(ones) - 1
    bucket = lambda c: min(lm_score.CONTEXTS - 1, c.bit_length())
    kept = {}
    for (v, w), c in pairs.items():
        context = ones[v] - 1
        kept.setdefault(bucket(context), []).append((((c - 1) / max(1, context), (ones[w] - 1) / (total - 1), 1 / (types + 1)), c))
    weights, last = {}, [0.0, 0.5, 0.5]
    for b in range(lm_score.CONTEXTS):
        if b in kept:
            last = [1 / 3] * 3
            for _ in range(lm_score.EM_ROUNDS):
                sums = [0.0] * 3
                for p, c in kept[b]:
                    mix = [x * y for x, y in zip(p, last, strict=True)]
                    sums = [s + c * m / sum(mix) for s, m in zip(sums, mix, strict=True)]
                last = [s / sum(sums) for s in sums]
        weights[b] = last
    got = {r["doc_id"]: r["score"] for r in lm_score.score_texts(table(spark, texts)).collect()}
    for i, t in enumerate(lists):
        want = 0.0
        for v, w in zip(t[:-1], t[1:], strict=True):
            mix = weights[bucket(ones[v])]
            want += math.log10(mix[0] * pairs[v, w] / max(1, ones[v]) + mix[1] * ones[w] / total + mix[2] / (types + 1))
        assert abs(got[i] - want) <= 0.01 * abs(want) + 0.01, i


def test_lm_weights_sum_to_one_and_follow_the_data():
    ratio, count = lm_score.ratio_class(np.array([0.5])), lm_score.count_class(np.array([100]))
    cells = (5 * 1024 + ratio) * 1024 + count
    w = lm_score.learn_weights(cells, np.array([10.0]), 10_000, 500)
    assert np.allclose(w.sum(axis=1), 1) and w[5, 0] > 0.99
    k = np.arange(200)
    assert (lm_score.count_class(lm_score.class_count(k)) == k).all()


def brute_rule(host, path):
    best = None
    for what, rule in url_filter.RULES:
        h, _, p = rule.partition("/")
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p) and (best is None or len(rule) > len(best[1])):
            best = (what, rule)
    return best


def test_url_filter(spark):
    urls = ["http://A.Example.COM/en/7x?q=/", "https://b.example.com/en/1#f", "http://x.net/de/8", "http://y.example.net/de/8/z", "ftp://q.org/es/", "http://notcom/en/", "no scheme", None, "", "http://h", "http://h?a/b", "x://a.com://b/en/", "http://poker-bonus.example.org/fr/1", "http://www.garden-notes.example.org/en/2"]
    df = spark.createDataFrame([(i, u, "x", "y") for i, u in enumerate(urls)], "page_id long, url string, host string, rule string")
    got = {r["page_id"]: r for r in url_filter.filter_urls(df).collect()}
    for i, u in enumerate(urls):
        m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", u or "")
        host, path = (lower(m[1]), m[2]) if m else ("", "")
        best = brute_rule(host, path)
        assert (got[i]["host"], got[i]["path"], got[i]["rule"]) == (host, path, best and best[1])
        if best:
            assert got[i]["verdict"] == best[0]
        assert got[i]["verdict"] in ("allow", "block")
    assert got[12]["verdict"] == "block" and got[13]["verdict"] == "allow"
    assert url_filter.filter_urls(df.where("false")).count() == 0


def brute_regression(rows, urls):
    """The probability of each url by plain gradient descent; an n-gram's slot is its 64-bit xxHash with Spark's seed, modulo the slots."""
    def grams(u):
        m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", u or "")
        if not m or m[1] + m[2] == "":
            return Counter()
        t = re.sub("[1-9]", "0", "^" + lower(m[1]) + "$" + m[2])
        return Counter(xxhash.xxh64_intdigest(t[i : i + n], seed=42) % (1 << url_filter.BITS) for n in url_filter.SIZES for i in range(len(t) - n + 1))

    data = [({g: c / math.sqrt(sum(x.values())) for g, c in x.items()}, y) for u, y in rows for x in [grams(u)]]
    w, bias = Counter(), 0.0
    for _ in range(600):
        grad, g0 = Counter(), 0.0
        for x, y in data:
            d = 1 / (1 + math.exp(-(bias + sum(w[g] * v for g, v in x.items())))) - y
            g0 += d
            for g, v in x.items():
                grad[g] += d * v
        bias -= 10 * g0 / len(data)
        for g in grad:
            w[g] -= 10 * (grad[g] / len(data) + 1e-4 * w[g])
    return [1 / (1 + math.exp(-(bias + sum(w[g] * c for g, c in x.items()) / math.sqrt(max(1, sum(x.values())))))) for x in map(grams, urls)]


def test_url_regression_against_plain_descent(spark):
    rows = [(r["url"], r["label"]) for r in url_filter.default_labelled(spark).collect()][::91]
    urls = ["http://www.megacasino.example/x", "https://library.example/en/7?q", None, "none", "x://" + "long" * 60 + ".test/" + "p/" * 200, "http://a.b/c"]
    df = spark.createDataFrame([(k if k else None, u) for k, u in enumerate(urls)] + [(5, urls[5])], "page_id long, url string")
    got = url_filter.filter_urls(df, spark.createDataFrame(rows, "url string, label int"), rules=[]).collect()
    want = dict(zip([None, *range(1, len(urls))], brute_regression(rows, urls), strict=True))
    assert len(got) == 7
    for r in got:
        assert abs(r["p_block"] - want[r["page_id"]]) < 1e-4 and r["verdict"] == ("block" if r["p_block"] >= 0.5 else "allow")


def url_rates(spark, group):
    """{label: (precision, recall)} of the regression on folds by group(place in the table), each judged by a fit that never saw it."""
    rows = [(u, y, group(i)) for i, (u, y) in enumerate(url_filter.labelled_urls())]
    pairs = []
    for fold in range(4):
        out = [r for r in rows if zlib.crc32(str(r[2]).encode()) % 4 == fold]
        fit = spark.createDataFrame([r[:2] for r in rows if r not in out], "url string, label int")
        got = url_filter.filter_urls(spark.createDataFrame([(i, r[0]) for i, r in enumerate(out)], "page_id long, url string"), fit, rules=[]).collect()
        pairs += [(out[r["page_id"]][1], int(r["verdict"] == "block")) for r in got]
    assert len(pairs) == len(rows)
    hit = Counter(pairs)
    return {y: (hit[y, y] / max(1, hit[0, y] + hit[1, y]), hit[y, y] / (hit[y, 0] + hit[y, 1])) for y in (0, 1)}


def test_url_regression_on_hosts_left_out(spark):
    """Folds by host, and by the word of the trade: sites of trades that the fit has never seen. No host stands in the given pages."""
    rows = url_filter.labelled_urls()
    host = lambda u: re.match(r".*?://([^/?#]*)", u)[1]
    assert len(rows) == len(set(rows)) and len({host(u) for u, _ in rows}) > 400
    assert not {host(u) for u, _ in rows} & {host(u[0]) for u in spark.read.parquet("/root/testdata/sf0.1/pages.parquet").select("url").distinct().collect()}
    by_host, by_word = url_rates(spark, lambda i: host(rows[i][0])), url_rates(spark, lambda i: i // 6)
    print("url regression, precision and recall of allow and block:", by_host, by_word)
    assert all(v > 0.85 for pair in by_host.values() for v in pair) and all(v > 0.7 for pair in by_word.values() for v in pair)


def brute_spans(t):
    t = t or ""
    found = [(m.start(), 0, m.end()) for m in secret_scan.ASSIGN.finditer(t) if len(m[2]) >= 12]
    found += [(m.start(), 1, m.end()) for m in secret_scan.ACCESS.finditer(t) if len(m[0]) >= 18]
    found += [(m.start(), 2, m.end()) for m in secret_scan.HEX.finditer(t) if len(m[0]) >= 16]
    return sorted(found)


def test_secret_scan(spark):
    texts = ["password=b7db7aa4a5fcc78305 x", 'API_KEY": "abcdefghijklmnop"', "token: secret = ABCDEFGHIJKLMNO", "AKIAABCDEFGHIJKLMN AKIAX", "0123456789abcdef0 0123", "ſecret=abcdefghijklmn", None, "", "é password='Aa1_______bbbbb'",
             'db_key = "abcDEF123456xyz"\npassword = db_key', "client.secret: 'Zx81' + \"qq77Lm02\"", "password = changeme", 'title = "the password is not here"', "http://example.com/a=b"]
    got = {r["doc_id"]: r for r in secret_scan.scan_secrets(table(spark, texts)).collect()}
    for i, t in enumerate(texts):
        spans = brute_spans(t)
        text = ",".join(f"{secret_scan.KINDS[k]}:{a}:{b}" for a, k, b in spans)
        assert got[i]["base_sha256"] == hashlib.sha256(text.encode()).hexdigest()
        assert [got[i][f"n_{k}"] for k in ("assign", "access", "hex")] == [sum(s[1] == j for s in spans) for j in range(3)]
        assert set(filter(None, text.split(","))) <= set(got[i]["spans"].split(","))
    assert got[9]["spans"] == "lexed:9:26" and got[10]["spans"].startswith("lexed:15:") and got[11]["spans"] == got[12]["spans"] == got[13]["spans"] == ""
    clean = {r["doc_id"]: r["text"] for r in secret_scan.redact(table(spark, texts)).collect()}
    assert clean[0] == "[SECRET] x" and clean[6] is None and clean[7] == "" and clean[12] == texts[12]


def test_secret_scan_of_joined_constants(spark):
    a, b, clean = "Xk29fQ7wLm", "q8ZtR41vNb", "plain words of the text\n" * 200
    texts = [
        f'base = "{a}"\n{clean}token = base + "{b}"\n',
        f'first = "{a}"\nsecond = "{b}"\n{clean}password = first + second\n',
        f'first = "{a}"\n{clean}second = "{b}"\npassword=first+second\n',
        f'base = "{a}"\n{clean}token = "{b}" + base\n',
        f'base = "{a}"\n{clean}token=base+"{b}"\n',
        f'base = "{a}"\n{clean}token = "Vw3" + base + "{b}" + "7Pc"\n',
    ]
    got = {r["doc_id"]: r for r in secret_scan.scan_secrets(table(spark, texts)).collect()}
    redacted = {r["doc_id"]: r["text"] for r in secret_scan.redact(table(spark, texts)).collect()}
    for i, t in enumerate(texts):
        assert a not in redacted[i] and b not in redacted[i] and clean in redacted[i], i
        found = {tuple(map(int, s.split(":")[1:])) for s in got[i]["spans"].split(",") if s.startswith("lexed")}
        want = [f'"{a}"', f'"{b}" + "7Pc"' if i == 5 else f'"{b}"'] + ['"Vw3"'] * (i == 5)
        assert found == {(t.index(w), t.index(w) + len(w)) for w in want}, i


def brute_lexed(text):
    """Spans that the lexer adds, with values as whole strings: a plain version for texts of simple lines."""
    env, out = {}, set()
    for m in re.finditer(r"""(?m)^(\w+) = (.+)$""", text):
        value, spans = "", []
        for part in re.finditer(r"""'([^']*)'|"([^"]*)"|(\w+)""", m[2]):
            span = (m.start(2) + part.start(), m.start(2) + part.end())
            if part[3] is None:
                literal = part[1] if part[1] is not None else part[2]
                value, spans = value + literal, spans + [span]
            else:
                value, spans = value + env[part[3]][0], spans + env[part[3]][1]
        env[m[1]] = (value, spans)
        weight = max((w for k, w in secret_scan.SENSITIVE.items() if k in re.sub("[^a-z0-9]", "", m[1].lower())), default=0)
        if not weight or len(value) < 8 or " " in value or (value.islower() and not re.search("[0-9]", value)):
            continue
        if re.match(r"(?i)^(?:x+|\*+|\.+|<.*>|\$\{.*\}|%.*%|(?:your|my|example|sample|dummy|test|change|replace|todo|none|null|true|false)[\w .-]*)$", value):
            continue
        n = len(value)
        entropy = -sum(c / n * math.log2(c / n) for c in Counter(value).values())
        classes = sum(bool(re.search(p, value)) for p in ("[a-z]", "[A-Z]", "[0-9]"))
        if weight * (entropy + 0.5 * max(0, classes - 1)) >= secret_scan.MIN_SCORE:
            out |= set(spans)
    base = brute_spans(text)
    return {s for s in out if not any(a <= s[0] and s[1] <= b for a, _, b in base)}


def test_secret_lexer_against_whole_strings():
    rng = random.Random(17)
    names = ["host", "db_key", "password", "auth_header", "title", "private_key", "pwd"]
    words = ["changeme", "xxxxxxxxxx", "hello world", "<token>", "${SECRET}", "Qx7-uP2.mV", "zz", "AAAAbbbb1111", "lowercaseword", "******", "9f8e7d6c", "your_key_1", "Ab1", "%x%"]
    for _ in range(300):
        lines, known = [], []
        for _ in range(rng.randint(1, 8)):
            name = rng.choice(names) + str(rng.randint(0, 3))
            if known and rng.random() < 0.5:
                right = f'"{rng.choice(words)}"' if rng.random() < 0.3 else " + ".join(rng.choice(known) for _ in range(rng.randint(1, 3)))
            else:
                right = f'"{rng.choice(words)}"'
            lines.append(f"{name} = {right}")
            known.append(name)
        text = "\n".join(lines)
        got = {(a, b) for a, kind, b in secret_scan.find_spans(text)[1] if kind == "lexed"}
        assert got == brute_lexed(text), text


def test_secret_scan_of_hostile_texts():
    began = time.process_time()
    grown = 'a = "Xk29fQ7wLm"\n' + "a = a + a\n" * 4000 + "password = a\n"
    assert ("lexed", 4, 16) in [(k, a, b) for a, k, b in secret_scan.find_spans(grown)[1]]
    assert secret_scan.find_spans("a=" * 500_000)[1] == []
    chained = 'token = "q8ZtR41vNb"\n' + "".join(f'token = token + "x{i}"\n' for i in range(10_000))
    assert len(secret_scan.find_spans(chained)[1]) == 10_001
    secret_scan.find_spans("token = " + "a+" * 300_000 + "a")
    secret_scan.find_spans("password = 'Xy12abCD9kk' " * 20_000)
    secret_scan.find_spans("password " * 50_000 + '="' * 50_000 + "api_key" + " " * 200_000)
    assert time.process_time() - began < 40 * slowness()


def test_tokenizer_ids_are_the_files(spark):
    from tokenizers import Tokenizer

    path = packing.default_tokenizer()
    plain = Tokenizer.from_file(path)
    fast = packing.tokenizer_at(path)
    for t in [*filter(None, corpus()), "a  b", " \n ", "<|endoftext|> x", "a<|endoftext|><|endoftext|>", "<|endoftext|", " <| endoftext|>", "don't we'll", "漢字 😀", "x\n \ny  "]:
        assert fast.encode(t).tolist() == plain.encode(t, add_special_tokens=False).ids


def test_packing(spark):
    texts = corpus() + ["word " * 5000]
    got = packing.pack(table(spark, texts), group_rows=40).collect()
    ids = {i: [*packing.tokenizer_at(packing.default_tokenizer()).encode(t or "").tolist(), 0] for i, t in enumerate(texts)}
    by = {}
    for r in got:
        part = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert zlib.crc32(np.array(part, "<u4").tobytes()) == r["ids_crc32"] and len(part) == r["length"]
        by.setdefault(r["doc_id"], []).append(r)
    for i, rows in by.items():
        rows.sort(key=lambda r: r["piece"])
        assert [r["piece"] for r in rows] == list(range(len(rows))) and sum(r["length"] for r in rows) == len(ids[i])
        assert all(r["length"] == 2048 for r in rows[1:]) and [r["start"] for r in rows] == [sum(x["length"] for x in rows[:k]) for k in range(len(rows))]
    assert set(by) == set(ids)
    bins = {}
    for r in got:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in bins.values():
        places.sort()
        assert [o for o, _ in places] == [sum(n for _, n in places[:k]) for k in range(len(places))] and sum(n for _, n in places) <= 2048
    assert packing.pack(table(spark, texts).where("false")).count() == 0


def test_sum_of_squares_rule():
    rng = np.random.default_rng(7)
    lengths = rng.integers(1, 65, 400)
    bins, offsets = packing.sum_of_squares(lengths, 64)
    fill, opened = {}, Counter()
    for n, b, o in zip(lengths.tolist(), bins.tolist(), offsets.tolist(), strict=True):
        assert fill.get(b, 0) == o
        gaps = Counter(64 - f for f in fill.values() if f < 64)
        cost = {}
        for g in [*(g for g in gaps if g >= n), 64]:
            after = Counter(gaps)
            if g < 64:
                after[g] -= 1
            if g > n:
                after[g - n] += 1
            cost[g] = sum(v * v for v in after.values())
        assert cost[64 - o if b in fill else 64] == min(cost.values())
        fill[b] = o + n
    assert sum(fill.values()) == lengths.sum() and max(fill.values()) <= 64


def test_short_items_and_texts_that_repeat_themselves(spark):
    items = [(0, "cat"), (1, "The cat."), (2, "a b c d"), (3, "é!"), (4, "..!"), (5, "ab " * 700), (6, "a" * 2000), (7, None), (8, "cat")]
    texts = ["my CAT, sat", "the\ncat", "concatenate", "x a-b c. d", "xa b c d", "É", None, "", "ab " * 5000, "a" * 8000, "a" * 1990 + "b" * 30, "b" * 500 + "a" * 1900, "ab " * 500]
    want = {0: {0, 8}, 1: {0, 1, 8}, 2: set(), 3: {2}, 4: set(), 5: {3}, 6: set(), 7: set(), 8: {5}, 9: {6}, 10: {6}, 11: {6}, 12: set()}
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in decontaminate.find_contamination(docs, spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert {i: {int(v.split(":")[0]) for v in r["items"].split(",") if v} for i, r in got.items()} == want
    assert got[10]["items"] == "6:10" and got[11]["items"] == "6:100"


@pytest.mark.parametrize("seed", range(4))
def test_bands_of_repeats_are_those_of_pairs(monkeypatch, seed):
    rng = random.Random(seed)
    piece = "".join(rng.choice("aab") for _ in range(7))
    item = (piece * 60)[: rng.randint(150, 400)]
    index = decontaminate.ItemIndex.build([(1, item)])
    for text in (piece * 200, item[:100] + "x" + item[101:], "".join(rng.choice("ab") for _ in range(1500)) + item, (piece + "b") * 100):
        raw = decontaminate.normalise(text)
        monkeypatch.setattr(decontaminate, "MAX_HITS", 1 << 20)
        want = index._near(raw)
        monkeypatch.setattr(decontaminate, "MAX_HITS", 50)
        assert index._near(raw) == want


def test_long_white_space_is_tokenised_as_the_file_does(spark, tmp_path):
    from tokenizers import Tokenizer

    path = packing.default_tokenizer()
    file, ours = Tokenizer.from_file(path), packing.tokenizer_at(path)
    blanks = [" " * 12_000, "\n" * 10_001, "\r\n" * 8_000, "\u3000" * 11_000, " \t" * 9_000, " " * 9_000 + "\x1c" + " " * 10_500, " " * 9_999]
    for run in blanks:
        for text in (run, "a" + run, run + "b", "it's" + run + "x" + run + "\n", run + "\u00e9<|endoftext|>"):
            assert ours.encode(text).tolist() == file.encode(text, add_special_tokens=False).ids
    rows = [(1, "a" + " " * 2_000_000 + "b", "x"), (2, "\n" * 2_000_000, "x"), (None, "c", "x"), (None, "c", "x"), (3, "q" * 300_000, "x")]
    got = packing.pack(spark.createDataFrame(rows, "doc_id long, text string, piece string")).collect()
    counts = Counter()
    for r in got:
        counts[r["doc_id"]] += r["length"]
    assert counts == {1: 2_000_002, 2: len(ours.encode("\n" * 2_000_000)) + 1, None: 4, 3: len(ours.encode("q" * 300_000)) + 1}
    said = json.loads(open(path, encoding="utf-8").read())
    said["pre_tokenizer"]["add_prefix_space"] = True
    (tmp_path / "other.json").write_text(json.dumps(said))
    with pytest.raises(ValueError, match="byte-level"):
        packing.TextIds(str(tmp_path / "other.json"))


def test_operators_leave_the_session_as_it_is(spark):
    before = {k: spark.conf.get(k) for k in ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch")}
    docs = table(spark, corpus())
    language_id.identify(docs), secret_scan.scan_secrets(docs), packing.pack(docs), jaccard_join.jaccard_components(docs)
    assert before == {k: spark.conf.get(k) for k in before}


def bucket_spans_of(texts):
    """{document: removed spans} that one bucket finds for a chunk of texts whose pieces are all dealt to it."""
    import zstandard

    raws = [t.encode() for t in texts]
    row = {"chunk": 0, "ids": list(range(len(raws))), "offsets": np.cumsum([0, *map(len, raws)]).astype("<i8").tobytes(), "body": zstandard.ZstdCompressor().compress(b"".join(raws))}
    c = suffix_dedup.Cut(row, np.zeros(1 << suffix_dedup.MIN_BITS, np.uint8), suffix_dedup.MIN_BITS, 1)
    g = np.sort(c.stay)
    body = zstandard.ZstdCompressor().compress(suffix_dedup._pack(np.arange(len(c.ids)), c.ids, c.doc[g], c.start[g], c.length[g], c.place[g], c.rows[g]))
    found = suffix_dedup._bucket_spans(suffix_dedup._table([0], [0], [body]))
    doc, start, end = np.concatenate([np.frombuffer(b.as_py(), "<i8").reshape(3, -1) for b in found["body"]] or [np.zeros((3, 0), np.int64)], axis=1)
    return {int(d): [tuple(map(int, s)) for s in zip(*suffix_dedup.merge_spans(start[doc == d], end[doc == d]), strict=True)] for d in np.unique(doc)}


@pytest.mark.parametrize("collection", [2, 40, 700])
def test_an_anchor_of_many_texts_is_taken_in_collections(monkeypatch, collection):
    """Lines with a counter before, behind, and on both sides of what they share, and some whole copies; the same spans as in one collection."""
    rng = random.Random(collection)
    line = "licensed under the terms of the agreement number nine of the year"
    texts = [f"{rng.randrange(10**6):06d} {line} {rng.randrange(10**4):04d}-{k % 7}" for k in range(600)] + [f"{line} {k % 90:03d} end of the file" for k in range(300)] + [line[k % 9 :] + f"{k % 5}" for k in range(100)]
    rng.shuffle(texts)
    whole = bucket_spans_of(texts)
    monkeypatch.setattr(suffix_dedup, "COLLECTION", collection)
    assert bucket_spans_of(texts) == whole
    brute = brute_repeats(range(len(texts)), texts)
    for i, t in enumerate(texts):  # one bucket and one chunk: nothing else removes anything, but equal texts inside the chunk are found before
        if i in whole:
            assert sum(b - a for a, b in whole[i]) <= brute[i][1]
    assert sum(sum(b - a for a, b in s) for s in whole.values()) > 10_000
