"""Preference pairs as one prompt and two masked completions.

``format_preferences`` finds for each pair the longest run of turns with which the chosen and the
rejected conversation both begin, renders it once as the prompt, and renders the turns after it as
the two completions, turn by turn. Assistant turns of a completion are trained on; all else is masked.
Turns stay rows, so a conversation of any length is spread over many tasks: turns are numbered by
running sums over ranges, and the two sides meet turn by turn.

Defined results: turns are ordered by ``turn`` (null last), then role and text; rows of a null
conversation take no part; a null text is rendered as empty and a null role as no role, but both differ
from empty ones when turns are compared; equal conversations give a prompt and no completions; against
a conversation without turns all turns are completion; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paneloom.llm.shared import query, stored, table
from paneloom.operators.ranking import attach, positions


def numbered_turns(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, role, text, place): turns in order, counted from 1."""
    rows = turns.filter(F.col(conv).isNotNull()).select(
        F.col(conv).alias("conv_id"), F.col(turn).alias("turn"), F.col(role).alias("role"), F.col(text).alias("text")
    )
    order = [("turn", True), ("role", True), ("text", True)]
    return stored(positions(rows, ["conv_id"], order, "place").drop("turn"), "turns")


def sides_of_pairs(turns: DataFrame, pairs: DataFrame) -> DataFrame:
    """(pair_id, side, place, role, text) of numbered turns and (pair_id, chosen_id, rejected_id) pairs."""
    ends = F.array(
        F.struct(F.lit("chosen").alias("side"), F.col("chosen_id").alias("conv_id")),
        F.struct(F.lit("rejected").alias("side"), F.col("rejected_id").alias("conv_id")),
    )
    sides = pairs.select("pair_id", F.explode(ends).alias("s")).select("pair_id", "s.*")
    return turns.join(sides, "conv_id").select("pair_id", "side", "place", "role", "text")


def format_preferences(sides: DataFrame) -> DataFrame:
    """Rows (pair_id, part, place, role, rendered, trained) of (pair_id, side, place, role, text) turns; a side is chosen or rejected."""
    rows = stored(sides, "sides")
    digest = F.sha2(F.to_json(F.struct("role", "text")), 256)
    met = rows.select("pair_id", "place", digest.alias("digest")).groupBy("pair_id", "place")
    compared = met.agg((F.count(F.lit(1)) == 2).alias("both"), (F.min("digest") == F.max("digest")).alias("same"))
    ends = F.coalesce(F.min(F.when(~(F.col("both") & F.col("same")), F.col("place"))) - 1, F.max("place"))
    shared_turns = compared.groupBy("pair_id").agg(ends.alias("prefix"))
    cut = attach(rows, shared_turns, ["pair_id"]).withColumn("prompt", F.col("place") <= F.col("prefix"))
    rendered = F.concat(
        F.lit("<|im_start|>"), F.coalesce("role", F.lit("")), F.lit("\n"), F.coalesce("text", F.lit("")), F.lit("<|im_end|>\n")
    )
    return cut.filter("side = 'chosen' OR NOT prompt").select(
        "pair_id",
        F.when(F.col("prompt"), "prompt").otherwise(F.col("side")).alias("part"),
        "place",
        "role",
        rendered.alias("rendered"),
        (~F.col("prompt") & F.coalesce(F.col("role") == "assistant", F.lit(False))).alias("trained"),
    )


def answers_exchanged(turns: DataFrame) -> DataFrame:
    """Sides of one pair per conversation that ends with an answer: chosen as it is, rejected with the last
    answer of the next such conversation by id (the first one's after the last)."""
    lengths = turns.groupBy("conv_id").agg(F.max("place").alias("turns"))
    last = turns.join(lengths, "conv_id").filter("place = turns AND role = 'assistant'").select("conv_id", "turns", "text")
    placed = stored(positions(last, [], [("conv_id", True)], "n"), "answers")
    count = placed.count()
    others = placed.select(F.when(F.col("n") == 1, F.lit(count)).otherwise(F.col("n") - 1).alias("n"), F.col("text").alias("other"))
    exchanged = placed.join(others, "n").select("conv_id", "turns", "other")
    both = attach(turns, exchanged, ["conv_id"]).filter("turns IS NOT NULL")
    side = F.explode(F.array(F.lit("chosen"), F.lit("rejected"))).alias("side")
    swapped = F.when((F.col("side") == "rejected") & (F.col("place") == F.col("turns")), F.col("other")).otherwise(F.col("text"))
    return both.select("*", side).select(F.col("conv_id").alias("pair_id"), "side", "place", "role", swapped.alias("text"))


PREFERENCE_SQL = """
WITH t AS (
  SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS LAST, role NULLS LAST, text NULLS LAST) AS place
  FROM conversations WHERE conv_id IS NOT NULL),
n AS (SELECT conv_id, max(place) AS turns FROM t GROUP BY conv_id),
f AS (
  SELECT conv_id, turns, text, row_number() OVER (ORDER BY conv_id) AS k
  FROM t JOIN n USING (conv_id) WHERE place = turns AND role = 'assistant'),
x AS (SELECT a.conv_id, a.turns, b.text AS other FROM f a JOIN f b ON b.k = a.k % (SELECT count(*) FROM f) + 1),
s AS (
  SELECT conv_id AS pair_id, 'chosen' AS side, place, role, text FROM t JOIN x USING (conv_id)
  UNION ALL
  SELECT conv_id, 'rejected', place, role, CASE WHEN place = turns THEN other ELSE text END FROM t JOIN x USING (conv_id)),
d AS (
  SELECT pair_id, place, count(*) = 2 AND count(DISTINCT struct_pack(r := role, t := text)) = 1 AS same FROM s GROUP BY ALL),
p AS (SELECT pair_id, coalesce(min(place) FILTER (NOT same) - 1, max(place)) AS prefix FROM d GROUP BY pair_id)
SELECT pair_id, CASE WHEN place <= prefix THEN 'prompt' ELSE side END AS part, place, role,
       '<|im_start|>' || coalesce(role, '') || chr(10) || coalesce(text, '') || '<|im_end|>' || chr(10) AS rendered,
       place > prefix AND coalesce(role = 'assistant', false) AS trained
FROM s JOIN p USING (pair_id) WHERE side = 'chosen' OR place > prefix
"""


@query("op5_preference_pairs", PREFERENCE_SQL)
def preference_pairs(spark, folder):
    """Each conversation against itself with another conversation's last answer."""
    return format_preferences(answers_exchanged(numbered_turns(table(spark, folder, "conversations"))))
