"""Operator 6: chat formatting after cumulative-snapshot collapse.

Logs often hold a conversation again after every turn. Each conversation's turns are hashed in a rolling way, so that
turn t's hash stands for the first t turns: a chain of SHA-256 inside every SPAN turns, and a chain over the spans before
them, so the work follows the number of turns and no array is longer than SPAN or the number of spans. A conversation
whose full hash is a shorter prefix of another goes (anti join); of equal conversations the one of the smallest conv_id
stays. What is left is rendered with role markers. Numbering the turns sorts each conversation within one task, on disk
if need be; rendering gathers one conversation's text, which is one value of the result, and so has to fit 2 GB.

Turns are ordered by turn number, then role and text (nulls first), so ties and repeated rows have one order. Null role
or text count as empty but differ from the empty string in the hash. Rows with a null conv_id belong to no conversation
and are left out. Empty tables give empty tables; other columns are ignored. Texts are whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .staging import stage

SPAN = 256
OPEN, MIDDLE, CLOSE = "<|im_start|>", "\n", "<|im_end|>\n"


def _field(c: str):
    """A field's part of a turn's hash: null apart from empty, and no two field lists alike."""
    return F.when(F.col(c).isNull(), F.lit("-")).otherwise(F.concat(F.length(c).cast("string"), F.lit(":"), F.col(c)))


def _chain(digests: Column) -> Column:
    """The rolling hash after each of some digests."""
    empty = F.array().cast("array<string>")
    return F.aggregate(digests, empty, lambda held, x: F.concat(held, F.array(F.sha2(F.concat(F.coalesce(F.try_element_at(held, F.lit(-1)), F.lit("")), x), 256))))


def rolling_hashes(turns: DataFrame) -> DataFrame:
    """(conv_id, place, last, prefix): the hash of a conversation's first ``place`` turns; last says whether that is all of it. Only digests move, not texts."""
    digest = turns.select("conv_id", "turn", F.sha2(F.concat(_field("role"), _field("text")), 256).alias("digest"))
    one = Window.partitionBy("conv_id").orderBy("turn", "digest")
    placed = digest.select("conv_id", (F.row_number().over(one) - 1).alias("at"), F.lead("digest").over(one).isNull().alias("last"), "digest")
    spans = placed.groupBy("conv_id", F.floor(F.col("at") / SPAN).alias("span")).agg(F.array_sort(F.collect_list(F.struct("at", "digest"))).alias("list"), F.max("last").alias("ends"))
    inner = stage(spans.select("conv_id", "span", "ends", _chain(F.transform("list", lambda x: x["digest"])).alias("chain")), "spans")
    heads = inner.filter("not ends").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("span", F.element_at("chain", -1).alias("h")))).alias("list"))
    before = heads.select("conv_id", F.posexplode(_chain(F.transform("list", lambda x: x["h"])))).select("conv_id", (F.col("pos") + 1).alias("span"), F.col("col").alias("start"))
    # the first span, for most conversations the only one, has nothing before it
    started = inner.filter("span = 0").withColumn("start", F.lit("")).unionByName(inner.filter("span > 0").join(before, ["conv_id", "span"]))
    each = started.select("conv_id", "span", "ends", "start", F.posexplode("chain"), F.size("chain").alias("n"))
    return each.select("conv_id", (F.col("span") * SPAN + F.col("pos") + 1).alias("place"), (F.col("ends") & (F.col("pos") == F.col("n") - 1)).alias("last"), F.sha2(F.concat("start", F.col("col")), 256).alias("prefix"))


def maximal_conversations(turns: DataFrame) -> DataFrame:
    """conv_id of conversations that no longer one starts with, one of each group of equal ones."""
    hashes = rolling_hashes(turns.filter("conv_id is not null"))
    # a hash that some conversation ends with is a full one; where a longer one passes through it, it is no maximal one
    ends = hashes.groupBy("prefix").agg(F.min(F.when(F.col("last"), F.col("conv_id"))).alias("conv_id"), F.bool_or(~F.col("last")).alias("passed"))
    return ends.filter("conv_id is not null and not passed").select("conv_id")


def render_chats(turns: DataFrame, key: str = "conv_id") -> DataFrame:
    """(conv_id, n_turns, chat) of each maximal conversation of (conv_id, turn, role, text) rows."""
    turns = turns.select(F.col(key).alias("conv_id"), "turn", "role", "text")
    kept = turns.join(maximal_conversations(turns), "conv_id", "left_semi")
    line = F.concat(F.lit(OPEN), F.coalesce("role", F.lit("")), F.lit(MIDDLE), F.coalesce("text", F.lit("")), F.lit(CLOSE))
    order = F.sha2(F.concat(_field("role"), _field("text")), 256)
    lines = kept.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct(F.col("turn"), order.alias("digest"), line.alias("line")))).alias("list"))
    return lines.select(F.col("conv_id").alias(key), F.size("list").cast("long").alias("n_turns"), F.array_join(F.transform("list", lambda x: x["line"]), "").alias("chat"))


ORACLE_SQL = """
WITH t AS (SELECT conv_id, turn, role, text,
  (CASE WHEN role IS NULL THEN '-' ELSE length(role)::VARCHAR || ':' || role END) || (CASE WHEN text IS NULL THEN '-' ELSE length(text)::VARCHAR || ':' || text END) AS field
  FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, count(*) AS n_turns, list(sha256(field) ORDER BY turn NULLS FIRST, sha256(field)) AS digests,
  string_agg('<|im_start|>' || coalesce(role, '') || chr(10) || coalesce(text, '') || '<|im_end|>' || chr(10), '' ORDER BY turn NULLS FIRST, sha256(field)) AS chat FROM t GROUP BY conv_id),
p AS (SELECT DISTINCT digests[1:k]::VARCHAR AS prefix FROM (SELECT digests, unnest(generate_series(1, n_turns - 1)) AS k FROM c)),
m AS (SELECT min(conv_id) AS conv_id FROM c WHERE digests::VARCHAR NOT IN (SELECT prefix FROM p) GROUP BY digests::VARCHAR)
SELECT c.conv_id, c.n_turns, c.chat FROM c JOIN m ON c.conv_id = m.conv_id
"""
