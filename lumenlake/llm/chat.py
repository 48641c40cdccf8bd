"""Chat formatting: logged snapshots of growing conversations collapse to the longest.

Each conversation has a rolling hash per turn prefix. Whole-conversation hashes are made distinct first, and
so are the strict prefixes; an anti-join then drops conversations that are a strict prefix of another, both
sides with one row per key. Equal conversations keep the smallest conv_id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, table

START, END = "<|im_start|>", "<|im_end|>"


def escaped(text):
    """Markers in a text get one backslash more: so what is rendered can be told apart."""
    return F.regexp_replace(text, r"<\|(\\*)im_", r"<|\\$1im_")


def collapse(turns: DataFrame) -> DataFrame:
    """conv_id, n_turns, n_copies (conversations equal to it, itself included), rendered.

    Turns are ordered by turn, role, text; null role or text counts as empty, and a row with a null conv_id is a conversation
    of its own. Repeated rows are turns like others. One output row is one rendered conversation, so a conversation has to fit in one. In roles and texts, <|im_ gets a
    backslash, and line ends in roles become spaces. An empty table gives no rows; other columns are not read.
    """
    role = F.regexp_replace(escaped(F.coalesce("role", F.lit(""))), "\n", " ")
    turn = F.struct("turn", role.alias("role"), escaped(F.coalesce("text", F.lit(""))).alias("text"))
    talks = turns.withColumn("_alone", F.when(F.col("conv_id").isNull(), F.monotonically_increasing_id())).groupBy("conv_id", "_alone").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    step = lambda acc, x: F.array_append(acc, F.sha2(F.concat_ws("\n", F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit("")), F.length(x.role).cast("string"), x.role, x.text), 256))
    hashed = talks.withColumn("prefixes", F.aggregate("turns", F.array().cast("array<string>"), step))
    hashed = materialize(hashed.select("conv_id", "_alone", "turns", "prefixes", F.element_at("prefixes", -1).alias("whole")), "talks")
    whole = hashed.groupBy("whole").agg(F.min(F.struct(F.col("conv_id").isNull().alias("none"), "conv_id", "_alone")).alias("first"), F.count("*").alias("n_copies"))
    strict = hashed.select(F.explode(F.slice("prefixes", F.lit(1), F.size("prefixes") - 1)).alias("whole")).distinct()
    kept = whole.join(strict, "whole", "left_anti").select("first.conv_id", "first._alone", "n_copies")
    lines = F.transform("turns", lambda x: F.concat(F.lit(START), x.role, F.lit("\n"), x.text, F.lit(END + "\n")))
    return hashed.join(kept, hashed.conv_id.eqNullSafe(kept.conv_id) & hashed["_alone"].eqNullSafe(kept["_alone"])).select(hashed.conv_id, F.size("turns").cast("long").alias("n_turns"), "n_copies", F.array_join(lines, "").alias("rendered"))


def op4_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collapse(table(spark, sf_dir, "conversations"))


SQL = r"""
WITH e AS (SELECT conv_id, CASE WHEN conv_id IS NULL THEN row_number() OVER () END AS alone, turn, regexp_replace(coalesce(role,''), '<\|(\\*)im_', '<|\\\1im_', 'g') AS role, regexp_replace(coalesce(text,''), '<\|(\\*)im_', '<|\\\1im_', 'g') AS text FROM conversations),
t AS (SELECT conv_id, alone, turn, replace(role, chr(10), ' ') AS role, text FROM e),
p AS (SELECT conv_id, row_number() OVER w AS k, count(*) OVER (PARTITION BY conv_id, alone) AS n,
        string_agg('<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10), '') OVER (w ROWS UNBOUNDED PRECEDING) AS r
      FROM t WINDOW w AS (PARTITION BY conv_id, alone ORDER BY turn, role, text)),
f AS (SELECT r, min(conv_id) AS conv_id, count(*) AS n_copies, max(n) AS n_turns FROM p WHERE k = n GROUP BY r)
SELECT conv_id, n_turns, n_copies, r AS rendered FROM f WHERE r NOT IN (SELECT r FROM p WHERE k < n)
"""
