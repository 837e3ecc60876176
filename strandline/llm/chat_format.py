"""Chat formatting with cumulative-snapshot collapse, in DataFrame functions only.

Chat logs often hold the same conversation several times, each snapshot a few turns longer. A rolling hash over the turns identifies
every prefix of every conversation; a conversation whose own hash is a proper prefix of another is a snapshot and goes, of equal ones
the smallest id stays, and what is left is rendered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CLOSE = "<|end|>\n"
#: A text's own "<|" is shown so, and can't open or close a turn.
MARK, SHOWN = "<|", "< |"


def _text_key(text: str) -> Column:
    return F.md5(F.coalesce(F.col(text), F.lit("")))


def _turns(conversations: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    return conversations.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), F.lit("unknown")).alias("role"), F.col(text_col).alias("text")).where("conv_id is not null and turn is not null")


def prefix_hashes(turns: DataFrame) -> DataFrame:
    """(conv_id, k, first, second, whole): rolling hashes of the first k turns, and whether those are all. Only digests of the texts are shuffled.

    Every turn is hashed with its place, twice, and the hashes are added up along the conversation, so no conversation is gathered in a row.
    """
    keyed = turns.select("conv_id", "turn", "role", _text_key("text").alias("key"))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "key")
    once = keyed.withColumn("before", F.lag(F.struct("turn", "role", "key")).over(order)).where(~F.struct("turn", "role", "key").eqNullSafe(F.col("before")))
    placed = once.withColumn("k", F.row_number().over(order))
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    rolling = lambda seed: F.sum(F.xxhash64(F.lit(seed), "k", "role", "key").cast("decimal(20,0)")).over(so_far)
    return placed.select("conv_id", "k", rolling(1).alias("first"), rolling(2).alias("second"), F.lead("k").over(order).isNull().alias("whole"))


def maximal(turns: DataFrame) -> DataFrame:
    """(conv_id, n_turns, n_copies) of the conversations that no longer one continues; of equal ones the smallest id, with their number."""
    hashed = prefix_hashes(turns)
    own = ["k", "first", "second"]
    kept = hashed.where("whole").groupBy(*own).agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_copies"))
    prefixes = hashed.where("not whole").select(*own).distinct()
    return kept.join(prefixes, own, "left_anti").select("conv_id", F.col("k").alias("n_turns"), "n_copies")


def format_chats(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row for each maximal conversation: conv_id, n_turns, n_copies, rendered.

    Rows with a null conversation or turn belong nowhere and are left out. A null role is `unknown`, a null text is empty. Turns with
    the same number are ordered by role and digest of the text; rows that repeat a turn wholly count once. `<|` inside a role or text is
    rendered `< |`. Texts of any length are rendered whole. An empty table gives an empty result.
    """
    turns = _turns(conversations, conv_col, turn_col, role_col, text_col)
    chosen = maximal(turns)
    plain = lambda c: F.replace(c, F.lit(MARK), F.lit(SHOWN))
    piece = F.concat(F.lit("<|"), plain(F.col("role")), F.lit("|>\n"), plain(F.coalesce("text", F.lit(""))), F.lit(CLOSE))
    item = F.struct("turn", "role", _text_key("text").alias("key"), piece.alias("piece"))
    rendered = turns.join(chosen.select("conv_id"), "conv_id", "left_semi").groupBy("conv_id").agg(F.array_join(F.transform(F.sort_array(F.collect_set(item)), lambda t: t["piece"]), "").alias("rendered"))
    return chosen.join(rendered, "conv_id")


#: The same result in SQL: prefixes compared as strings of digests.
SQL = """
WITH t AS (SELECT DISTINCT conv_id, turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text FROM conversations
           WHERE conv_id IS NOT NULL AND turn IS NOT NULL),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, md5(text)) AS k FROM t),
p AS (SELECT conv_id, k, string_agg(md5(role) || md5(text), '') OVER (PARTITION BY conv_id ORDER BY k) AS pre,
             count(*) OVER (PARTITION BY conv_id) AS n FROM o),
f AS (SELECT pre, min(conv_id) AS conv_id, count(*) AS n_copies, any_value(n) AS n_turns FROM p WHERE k = n GROUP BY pre),
m AS (SELECT * FROM f WHERE pre NOT IN (SELECT pre FROM p WHERE k < n))
SELECT m.conv_id, CAST(m.n_turns AS INTEGER) AS n_turns, m.n_copies,
       string_agg('<|' || replace(o.role, '<|', '< |') || '|>' || chr(10) || replace(o.text, '<|', '< |') || '<|end|>' || chr(10), '' ORDER BY o.k) AS rendered
FROM m JOIN o ON o.conv_id = m.conv_id GROUP BY m.conv_id, m.n_turns, m.n_copies
"""
