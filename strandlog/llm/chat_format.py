"""Chat formatting with cumulative snapshots collapsed.

Loggers write a conversation again after every turn, so most logged conversations are prefixes of longer ones. Each
turn gets two 64-bit hashes of its place, role and text; their running exclusive-or along the conversation is the rolling
hash of the prefix that ends there, with its length 192 bits in all. A conversation whose whole hash is the hash of a
proper prefix of another is collapsed into that one (anti-join), of equal ones the least conv_id stays, and only the
maximal conversations are rendered.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandlog.llm.common import save

_KEY = ["k", "x1", "x2"]


def prefix_hashes(turns: DataFrame) -> DataFrame:
    """conv_id, k (from 1), n, role, text and the prefix's hashes x1, x2 of every turn.

    Turns go by turn, then role, then text; rows equal in all four columns are one turn logged twice. Null roles and
    texts are empty, a null turn comes first, rows without a conv_id form one conversation. Other columns are ignored.
    """
    said = turns.select("conv_id", "turn", *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("role", "text")]).distinct()
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    said = said.withColumn("k", F.row_number().over(order))
    said = said.withColumn("h1", F.xxhash64("k", "role", "text")).withColumn("h2", F.xxhash64(F.lit(7), "k", "role", "text"))
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = Window.partitionBy("conv_id")
    return said.select(
        "conv_id", "k", F.count("*").over(whole).alias("n"), "role", "text", F.bit_xor("h1").over(upto).alias("x1"), F.bit_xor("h2").over(upto).alias("x2")
    )


def maximal_conversations(hashed: DataFrame) -> DataFrame:
    """conv_id, n, n_copies (equal ones, itself included) of the conversations that no longer one begins with."""
    whole = hashed.filter("k = n").groupBy(*_KEY).agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_copies"))
    longer = hashed.filter("k < n").select(*_KEY).distinct()
    return whole.join(longer, _KEY, "left_anti").select("conv_id", F.col("k").cast("long").alias("n"), "n_copies")


def render(turns: DataFrame) -> DataFrame:
    """conv_id, n_turns, n_copies, text of each maximal conversation.

    A turn is <|role|>, a line break, its text, <|end|>, a line break; "<|" within a role or text gets a space so that
    it can't be taken for a mark. A conversation is one row of the result, so it must fit in one.
    """
    hashed = save(prefix_hashes(turns), "chat-turns")
    kept = maximal_conversations(hashed).alias("m")
    safe = lambda c: F.replace(F.col(c), F.lit("<|"), F.lit("< |"))
    piece = F.concat(F.lit("<|"), safe("role"), F.lit("|>\n"), safe("text"), F.lit("<|end|>\n"))
    lines = hashed.alias("t").join(kept, F.expr("t.conv_id <=> m.conv_id")).select("m.conv_id", "m.n", "m.n_copies", "k", piece.alias("piece"))
    lines = lines.groupBy("conv_id", "n", "n_copies").agg(F.array_sort(F.collect_list(F.struct("k", "piece"))).alias("pieces"))
    return lines.select("conv_id", F.col("n").alias("n_turns"), "n_copies", F.array_join(F.transform("pieces", lambda p: p["piece"]), "").alias("text"))


SQL = """
with said as (
  select distinct conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
), placed as (
  select *, row_number() over (partition by conv_id order by turn nulls first, role, text) as k, count(*) over (partition by conv_id) as n from said
), prefixed as (
  select *, string_agg(chr(30) || role || chr(31) || text, '') over (partition by conv_id order by k) as prefix from placed
), whole as (
  select prefix, min(conv_id) as conv_id, count(*) as n_copies from prefixed where k = n group by prefix
), kept as (
  select * from whole where prefix not in (select prefix from prefixed where k < n)
)
select kept.conv_id, cast(max(n) as bigint) as n_turns, max(n_copies) as n_copies,
  string_agg('<|' || replace(role, '<|', '< |') || '|>' || chr(10) || replace(text, '<|', '< |') || '<|end|>' || chr(10), '' order by k) as text
from kept join placed using (conv_id) group by kept.conv_id
"""
