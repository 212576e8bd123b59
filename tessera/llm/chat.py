"""Chat formatting (operator 2): preference pairs with a shared prompt. Native: no Python on executors.

Turns of the chosen and the rejected conversation of a pair are numbered; the longest common
prefix of turns (equal role and text) is the prompt and is rendered once; what follows on either
side is its completion. The result is one row a rendered turn: part prompt, chosen or rejected,
its place and its first character's offset in the part, the segment and loss_mask, 1 where a model
is to be trained (assistant turns of completions). A part's segments in order are its string;
`assembled` joins them for pairs whose strings fit a row (the query does not: one conversation may
hold a third of all turns).

Nothing gathers a conversation in one task: numbers and offsets are two-level (blocks of turns,
then within a block), the prefix is a partial minimum, and only hashes of turns are compared.

Defined cases: turns are ordered by turn (null first), then role and md5 of the text; repeated rows are turns
of their own; a null role renders as an empty role, a null text as an empty text; a pair with one
side only has an empty prompt and that side as a completion; equal conversations are all prompt;
turns without a pair are left out; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

BLOCK = 256
OPEN, CLOSE, END = "<|", "|>\n", "<|end|>\n"


def preferences(turns: DataFrame, block: int = BLOCK) -> DataFrame:
    """turns(pair_id, side 'chosen' or 'rejected', turn, role, text) -> (pair_id, part, place, start, role, segment, loss_mask).

    Turns that are known to be in the shared prefix need no text on the rejected side if a column `digest` holds its md5.
    """
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit(""))
    turns = turns.where("pair_id is not null and side in ('chosen', 'rejected')").select("pair_id", "side", F.coalesce(F.col("turn").cast("long"), F.lit(-(1 << 62))).alias("turn"), role.alias("role"), text.alias("text"), (F.col("digest") if "digest" in turns.columns else F.md5(text.cast("binary"))).alias("digest"))
    turns = turns.withColumn("_b", F.floor(F.col("turn") / block))
    side = ["pair_id", "side"]
    ahead = Window.partitionBy(*side).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    counts = turns.groupBy(*side, "_b").agg(F.count(F.lit(1)).alias("_n")).select(*side, "_b", F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_ahead"))
    numbered = turns.withColumn("_in", F.row_number().over(Window.partitionBy(*side, "_b").orderBy("turn", "role", "digest"))).join(counts, [*side, "_b"])
    numbered = common.publish(numbered.select("pair_id", "side", (F.col("_ahead") + F.col("_in") - 1).alias("place"), "role", "text", "digest"), "turns")

    same = numbered.groupBy("pair_id", "place").agg(
        F.count(F.lit(1)).alias("n"),
        *(f(F.xxhash64(F.lit(s), "role", "digest")).alias(f"{name}{s}") for s in (1, 2) for name, f in (("lo", F.min), ("hi", F.max))),
    )
    equal = F.expr("n = 2 and lo1 = hi1 and lo2 = hi2")
    shared = same.groupBy("pair_id").agg(F.coalesce(F.min(F.when(~equal, F.col("place"))), F.max("place") + 1).alias("shared"))
    parts = numbered.join(shared, "pair_id").where("side = 'chosen' or place >= shared")
    completion = F.col("place") >= F.col("shared")
    rendered = parts.select(
        "pair_id",
        F.when(completion, F.col("side")).otherwise(F.lit("prompt")).alias("part"),
        F.when(completion, F.col("place") - F.col("shared")).otherwise(F.col("place")).alias("place"),
        "role",
        F.concat(F.lit(OPEN), "role", F.lit(CLOSE), "text", F.lit(END)).alias("segment"),
        (completion & (F.col("role") == "assistant")).cast("int").alias("loss_mask"),
    )
    rendered = rendered.withColumn("_b", F.floor(F.col("place") / block)).withColumn("_len", F.length("segment").cast("long"))
    part = ["pair_id", "part"]
    ahead = Window.partitionBy(*part).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    sums = rendered.groupBy(*part, "_b").agg(F.sum("_len").alias("_n")).select(*part, "_b", F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_ahead"))
    inside = Window.partitionBy(*part, "_b").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    placed = rendered.withColumn("_mine", F.coalesce(F.sum("_len").over(inside), F.lit(0))).join(sums, [*part, "_b"])
    return placed.select("pair_id", "part", F.col("place").cast("long").alias("place"), (F.col("_ahead") + F.col("_mine")).cast("long").alias("start"), "role", "segment", "loss_mask")


def assembled(segments: DataFrame) -> DataFrame:
    """(pair_id, prompt, chosen, rejected) strings with the masked spans [start, end) of either completion; for pairs that fit a row."""
    rows = segments.groupBy("pair_id").pivot("part", ["prompt", "chosen", "rejected"]).agg(F.sort_array(F.collect_list(F.struct("place", "segment", "start", "loss_mask"))))
    text = lambda c: F.array_join(F.transform(c, lambda t: t["segment"]), "").alias(c)
    mask = lambda c: F.transform(F.filter(c, lambda t: t["loss_mask"] == 1), lambda t: F.struct(t["start"].alias("start"), (t["start"] + F.length(t["segment"])).alias("end"))).alias(f"{c}_spans")
    return rows.select("pair_id", text("prompt"), text("chosen"), text("rejected"), mask("chosen"), mask("rejected"))


def answered_otherwise(turns: DataFrame) -> DataFrame:
    """turns(conv_id, turn, role, text) -> preference pairs (pair_id, side, turn, role, text).

    Chosen is a conversation as it is. Rejected is the same up to its last assistant turn, where the
    last assistant turn of its neighbour (2k and 2k + 1 are neighbours) answers instead, if there is one.
    """
    turns = turns.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("pair_id"), "turn", F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    turns = turns.withColumn("digest", F.md5(F.coalesce("text", F.lit("")).cast("binary")))
    light = common.publish(turns.drop("text"), "light")
    last = turns.where("role = 'assistant' and turn is not null").groupBy("pair_id").agg(F.max(F.struct("turn", F.coalesce("text", F.lit("")).alias("text"))).alias("last"))
    last = common.publish(last.select("pair_id", F.col("last.turn").alias("at"), F.col("last.text").alias("answer")), "last")
    swapped = last.join(last.select(F.col("pair_id").bitwiseXOR(F.lit(1)).alias("pair_id"), F.col("answer").alias("other")), "pair_id").select("pair_id", "at", "other")
    before = common.join_hot(light, swapped.select("pair_id", "at"), ["pair_id"], "left").where("at is null or turn is null or turn < at")
    before = before.select("pair_id", "turn", "role", F.lit(None).cast("string").alias("text"), "digest")  # all of it is in the shared prefix
    answer = swapped.select("pair_id", F.col("at").alias("turn"), F.lit("assistant").alias("role"), F.col("other").alias("text"), F.md5(F.col("other").cast("binary")).alias("digest"))
    sides = [turns.withColumn("side", F.lit("chosen")), *(t.withColumn("side", F.lit("rejected")) for t in (before, answer))]
    return sides[0].unionByName(sides[1]).unionByName(sides[2])


def op2_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each conversation against the same one with its neighbour's last answer."""
    return preferences(answered_otherwise(common.table(spark, sf_dir, "conversations")))


OP2_SQL = """
WITH all_turns AS (
  SELECT CAST(conv_id AS BIGINT) AS pair_id, turn, role, text FROM conversations WHERE conv_id IS NOT NULL),
last AS (
  SELECT pair_id, turn AS last_turn, coalesce(text, '') AS answer
  FROM (SELECT *, row_number() OVER (PARTITION BY pair_id ORDER BY turn DESC, coalesce(text, '') DESC) AS n
        FROM all_turns WHERE role = 'assistant' AND turn IS NOT NULL)
  WHERE n = 1),
swapped AS (
  SELECT a.pair_id, a.last_turn, b.answer AS other FROM last a JOIN last b ON b.pair_id = xor(a.pair_id, 1)),
sides AS (
  SELECT pair_id, 'chosen' AS side, turn, role, text FROM all_turns
  UNION ALL
  SELECT t.pair_id, 'rejected', t.turn, t.role, t.text
  FROM all_turns t LEFT JOIN swapped s ON s.pair_id = t.pair_id
  WHERE s.last_turn IS NULL OR t.turn IS NULL OR t.turn < s.last_turn
  UNION ALL
  SELECT pair_id, 'rejected', last_turn, 'assistant', other FROM swapped),
turns AS (
  SELECT pair_id, side, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM sides),
numbered AS (
  SELECT pair_id, side, role, text,
         row_number() OVER (PARTITION BY pair_id, side ORDER BY turn NULLS FIRST, role, md5(text)) - 1 AS place
  FROM turns),
shared AS (
  SELECT pair_id, coalesce(min(CASE WHEN NOT same THEN place END), max(place) + 1) AS shared
  FROM (SELECT pair_id, place,
               count(*) = 2 AND min(role) = max(role) AND min(text) = max(text) AS same
        FROM numbered GROUP BY pair_id, place)
  GROUP BY pair_id),
rendered AS (
  SELECT pair_id,
         CASE WHEN place >= shared THEN side ELSE 'prompt' END AS part,
         CAST(CASE WHEN place >= shared THEN place - shared ELSE place END AS BIGINT) AS place,
         role, concat('<|', role, '|>', chr(10), text, '<|end|>', chr(10)) AS segment,
         CAST(place >= shared AND role = 'assistant' AS INTEGER) AS loss_mask
  FROM numbered JOIN shared USING (pair_id)
  WHERE side = 'chosen' OR place >= shared)
SELECT pair_id, part, place,
       CAST(coalesce(sum(length(segment)) OVER (PARTITION BY pair_id, part ORDER BY place
            ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start,
       role, segment, loss_mask
FROM rendered
"""
