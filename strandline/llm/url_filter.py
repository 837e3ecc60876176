"""URL filters: host and path rules first, then logistic regression on hashed character n-grams, in DataFrame functions only.

The regression is fitted on a small labelled table of URLs (a parameter; by default labelled_urls(), sites invented by a rule from words
of trades that block lists and link collections name, without a look at any table that is to be judged): their n-grams are hashed by the same
Spark expression that scores pages, at most MAX_LABELLED rows come to the driver, and the weights (a fixed number, 2^BITS) go back as one
constant array.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BITS, SIZES, MAX_LABELLED = 13, (3, 4, 5), 2000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: The rules of the query, action and rule (host, then the path's start).
RULES = [("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/")]

#: Words of invented sites: what they deal in, what such sites add to their names, and where their pages stand; to be blocked, and clean.
BLOCKED = (
    "poker roulette jackpot blackjack wager lottery slots bingo viagra cialis steroid slimming replica counterfeit warez keygen crack torrent nulled hacktool "
    "popunder clickbait botnet phish sexcam porn escort hookup nude payday forex doubler giveaway prize quickcash getrich miracle weightloss".split(),
    "bonus vip hot mega 24 online deals cash king club xl best".split(),
    ["/go", "/bonus/claim", "/out?id=3", "/hot/new", "/signup/now", "/vip/1", "/offer/2", "/buy/now", "/click/9", ""],
)
CLEAN = (
    "library museum garden recipe weather university school physics history bakery cycling hiking orchestra theatre council railway hospital astronomy chess "
    "knitting pottery birdwatch gazette herald chronicle journal atlas dictionary grammar botany geology harbour parish festival observatory aquarium forest choir".split(),
    "society trust guide notes review centre college town house field group works".split(),
    ["/about", "/articles/2021/05", "/docs/intro", "/wiki/page", "/news/story-7.html", "/events/12", "/contact", "/people/8", "/en/start", ""],
)
#: Paths of either kind of site.
COMMON_PATHS = ("/", "/index.html", "/p/18", "/2023/06/item-4", "/en/about", "")
ENDINGS = ("example", "test", "example.org", "example.net", "invalid")


def labelled_urls(each: int = 6) -> list[tuple[str, int]]:
    """(url, 1 to block, else 0): each sites for every word, dealt an ending, a path (every other one of either kind) and, but for the last, a second word."""
    rows = []
    for label, (words, more, paths) in ((1, BLOCKED), (0, CLEAN)):
        for i, word in enumerate(words):
            for k in range(each):
                n = i * each + k
                second, front = more[(5 * i + 7 * k) % len(more)], ("", "www.", "shop.", "m.", "blog.")[n % 5]
                hyphen = "-" if n % 3 == 0 else ""
                name = word if k == each - 1 else f"{word}{hyphen}{second}" if n % 4 else f"{second}{hyphen}{word}"
                path = COMMON_PATHS[(i + k) % len(COMMON_PATHS)] if k % 2 else paths[(i + 3 * k) % len(paths)]
                rows.append((f"https://{front}{name}.{ENDINGS[(3 * i + k) % len(ENDINGS)]}{path}", label))
    return rows


def split_url(url: Column) -> tuple[Column, Column]:
    """(host, path): what lies between the first :// and the next /, ? or #, with A-Z in lower case, and then up to ? or #. Never null."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"^[^?#]*", 0)
    return F.translate(host, UPPER, LOWER), path


def rule_for(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """(rule, action) of the longest rule that fits the host or a parent domain and the start of the path; nulls if none fits."""
    rule, action = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, text in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        domain, slash, start = text.partition("/")
        fits = ((host == domain) | host.endswith("." + domain)) & path.startswith(slash + start)
        rule, action = F.when(fits, text).otherwise(rule), F.when(fits, what).otherwise(action)
    return rule, action


def gram_slots(host: Column, path: Column) -> Column:
    """Hashed slots of the character n-grams of `^host$path`, each digit read as 0; an array, empty if host and path are."""
    text = F.translate(F.concat(F.lit("^"), host, F.lit("$"), path), "123456789", "000000000")
    none = F.array().cast("array<bigint>")

    def slots_of(n: int) -> Column:
        at = F.sequence(F.lit(1), F.length(text) - n + 1)
        return F.when(F.length(text) >= n, F.transform(at, lambda i: F.pmod(F.xxhash64(F.substring(text, i, F.lit(n))), F.lit(1 << BITS)))).otherwise(none)

    grams = [slots_of(n) for n in SIZES]
    return F.when((host == "") & (path == ""), none).otherwise(F.concat(*grams))


def fit(labelled: DataFrame, url_col: str = "url", label_col: str = "label", rounds: int = 600, rate: float = 10.0, decay: float = 1e-4) -> list[float]:
    """2^BITS weights and the bias of the regression, by gradient descent with weight decay over at most MAX_LABELLED rows."""
    host, path = split_url(F.col(url_col))
    rows = labelled.where(F.col(label_col).isNotNull()).select(gram_slots(host, path).alias("slots"), F.col(label_col).cast("int").alias("y")).orderBy(F.xxhash64(url_col), "y").limit(MAX_LABELLED).collect()
    used = sorted({s for r in rows for s in r["slots"]})
    column = {s: i for i, s in enumerate(used)}
    x, y = np.zeros((len(rows), len(used))), np.array([r["y"] for r in rows], float)
    for row, r in zip(x, rows, strict=True):
        np.add.at(row, [column[s] for s in r["slots"]], 1 / math.sqrt(max(1, len(r["slots"]))))
    w, bias = np.zeros(len(used)), 0.0
    for _ in range(rounds if rows else 0):
        gap = 1 / (1 + np.exp(-np.clip(x @ w + bias, -30, 30))) - y
        bias -= rate * gap.mean()
        w -= rate * (gap @ x / len(rows) + decay * w)
    weights = np.zeros(1 << BITS)
    weights[used] = w
    return [*weights.tolist(), float(bias)]


def probability(slots: Column, weights: list[float]) -> Column:
    """Probability that a URL is to be blocked."""
    table = F.split(F.lit(",".join(repr(round(v, 6)) for v in weights[:-1])), ",").cast("array<double>")
    total = F.aggregate(slots, F.lit(0.0), lambda acc, s: acc + F.get(table, s.cast("int")))
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-(F.lit(weights[-1]) + total / F.sqrt(F.greatest(F.size(slots), F.lit(1)).cast("double")))))


def default_labelled(spark: SparkSession) -> DataFrame:
    """labelled_urls() as a table; a few hundred rows."""
    return spark.createDataFrame(labelled_urls(), "url string, label int")


def filter_urls(pages: DataFrame, labelled: DataFrame | None = None, rules: list[tuple[str, str]] = RULES, id_col: str = "page_id", url_col: str = "url", cut: float = 0.5) -> DataFrame:
    """Per row: page_id, host, path, rule, verdict, p_block. One pass, no shuffle; only id and url are read.

    labelled has columns url and label (1 to block, 0 not, null rows teach nothing). A null url or one without :// has an empty host and
    path, fits no rule, and gets the regression's bias alone. Null ids stay null, repeated rows give a row each, urls of any length are read
    whole. An empty table gives an empty result.
    """
    weights = fit(labelled if labelled is not None else default_labelled(pages.sparkSession))
    host, path = split_url(F.col("_u"))
    split = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("_u")).select("page_id", host.alias("host"), path.alias("path"))
    rule, action = rule_for(F.col("host"), F.col("path"), rules)
    scored = split.select("page_id", "host", "path", rule.alias("rule"), action.alias("action"), probability(gram_slots(F.col("host"), F.col("path")), weights).alias("p_block"))
    return scored.select("page_id", "host", "path", "rule", F.coalesce("action", F.when(F.col("p_block") >= cut, "block").otherwise("allow")).alias("verdict"), F.round("p_block", 6).alias("p_block"))
