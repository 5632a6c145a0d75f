"""Chat logs: cumulative snapshots collapse to maximal conversations, which are rendered.

A conversation logged after every turn appears as many conversations, each a prefix of the next. Every turn is hashed
with its place; running sums of those hashes name each prefix (two sums of 43-bit hashes and the number of turns). A
conversation whose own name is that of a proper prefix of another goes (an anti-join); of equal conversations the one
with the smallest ``conv_id`` stays. Prefix names are made distinct before the join, so a first turn that many
conversations share is one row.

Prefixes whose names are equal are taken as equal. Turns are ordered by ``turn``, then role and text; repeated rows are
turns of their own, and of equal ones any comes first. Null roles and texts are empty; very long texts are hashed and
rendered whole; rows with a null ``conv_id`` belong to no conversation and are left out, so no group grows with the
table's broken rows; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import own, read


def maximal(turns: DataFrame) -> DataFrame:
    """The turns (conv_id, place, role, text, n_turns) of the conversations that stay."""
    ordered = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    rows = own(turns, "conv_id", "turn", "role", "text").where("conv_id is not null").withColumns({c: F.coalesce(c, F.lit("")) for c in ("role", "text")})
    rows = rows.withColumn("place", F.row_number().over(ordered)).withColumn("n_turns", F.count("*").over(Window.partitionBy("conv_id")))
    sums = {f"s{k}": F.sum(F.shiftrightunsigned(F.xxhash64(F.lit(k), "place", "role", "text"), 21)).over(ordered) for k in (1, 2)}
    rows = rows.withColumns(sums)
    prefixes = rows.where("place < n_turns").select("place", "s1", "s2").distinct()
    whole = rows.where("place = n_turns").groupBy("place", "s1", "s2").agg(F.min(F.struct("conv_id")).alias("kept"))
    kept = whole.join(prefixes, ["place", "s1", "s2"], "left_anti").select(F.col("kept.conv_id").alias("_conv"))
    return rows.join(kept, rows["conv_id"] == kept["_conv"], "left_semi").select("conv_id", "place", "role", "text", "n_turns")


def render(turns: DataFrame, opening: str = "<|im_start|>", closing: str = "<|im_end|>\n") -> DataFrame:
    """One row per conversation: its turns in order, each between the marks, the role on a line of its own."""
    line = F.concat(F.lit(opening), F.col("role"), F.lit("\n"), F.col("text"), F.lit(closing))
    parts = F.sort_array(F.collect_list(F.struct("place", line.alias("line"))))
    return turns.groupBy("conv_id").agg(F.count("*").alias("n_turns"), F.array_join(F.transform(parts, lambda p: p["line"]), "").alias("text"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return render(maximal(read(spark, sf_dir, "conversations")))


ORACLE = r"""
with turns as (
  select conv_id, row_number() over (partition by conv_id order by turn, role, text) as place,
    '<|im_start|>' || coalesce(role, '') || chr(10) || coalesce(text, '') || '<|im_end|>' || chr(10) as line
  from conversations where conv_id is not null
), prefixes as (
  select conv_id, place, count(*) over (partition by conv_id) as n, string_agg(line, '') over (partition by conv_id order by place) as text from turns
), whole as (
  select min(conv_id) as conv_id, place as n_turns, text from prefixes where place = n group by place, text
)
select conv_id, n_turns, text from whole w where not exists (select 1 from prefixes p where p.place < p.n and p.place = w.n_turns and p.text = w.text)
"""
