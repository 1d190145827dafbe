"""Chat formatting: every participant's view of a multi-party dialogue, with loss masks.  DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.llm import common

#: Speaker whose turns are instructions: rendered for everyone, nobody's perspective.
SYSTEM = "system"
#: Turn numbers of one rendered block; a longer dialogue comes as several rows in order of ``block``.
BLOCK_TURNS = 256
#: Turns of one rendered row; a block with more, by several turns of one number, comes in parts.
PART_TURNS = 1_024

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"


def _escaped(words: Column) -> Column:
    """Without the beginning of a marker, so that no text can forge a turn."""
    return F.replace(words, F.lit("<|"), F.lit("< |"))


def _header(speaker: Column, perspective: Column) -> Column:
    who = (
        F.when(speaker == SYSTEM, F.lit("system"))
        .when(speaker == perspective, F.lit("assistant"))
        .when(speaker.isNull(), F.lit("user"))
        .otherwise(F.concat(F.lit("user name="), F.replace(_escaped(speaker), F.lit("\n"), F.lit(" "))))
    )
    return F.concat(F.lit(OPEN), who, F.lit("\n"))


def _number(digits: int) -> Column:
    """A number of so many hexadecimal digits that follows from speaker and text."""
    said = F.concat(F.coalesce("speaker", F.lit("")), F.lit("/"), "text")
    return F.conv(F.substring(F.md5(said.cast("binary")), 1, digits), 16, 10).cast("long")


def rotate(turns: DataFrame, speaker: str = "role", block_turns: int = BLOCK_TURNS, part_turns: int = PART_TURNS) -> DataFrame:
    """One row per turn and perspective: the rendered segment, its place in its part and what of it is trained.

    Columns ``conv_id, perspective, block, part, place, segment, start, mask_start, mask_end``: offsets are characters
    in the part's text; the mask covers the speaker's own words and the closing marker, and is null for other turns.

    Every speaker but ``system`` is a perspective once.  Turns stand in order of turn, then speaker, then text, nulls
    first; equal rows are one turn.  ``<|`` in a text or name becomes ``< |``, a line break in a name a blank.  A null
    text is empty; a turn without speaker is an unnamed user's and no perspective.  A turn without number has no place
    in its dialogue: it stands alone, for each perspective, with a null ``block``; a row without ``conv_id`` belongs to
    no dialogue and stands alone for its own speaker.  ``part`` is a hash that tells these apart, else 0.  Only where
    a block has over ``part_turns`` unlike turns are they dealt to parts by hash of speaker and text, so that no row
    grows without bound.  A dialogue of system turns only has no rows, nor has an empty table.  Other columns are
    ignored.
    """
    own = turns.select("conv_id", "turn", F.col(speaker).alias("speaker"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    speaks = (F.col("speaker") != SYSTEM) & F.col("speaker").isNotNull()
    known = own.filter(F.col("conv_id").isNotNull()).distinct()
    known = known.withColumn("block", F.floor(F.col("turn") / block_turns).cast("long")).withColumn("part", F.when(F.col("turn").isNull(), _number(15)).otherwise(0))
    blocks = known.filter("block IS NOT NULL").groupBy("conv_id", "block").agg(F.count("*").alias("n"))
    # Counted with repeated rows first, which needs no shuffle of texts; as a rule no block is left for the true count.
    rows = own.filter(F.col("conv_id").isNotNull()).groupBy("conv_id", F.floor(F.col("turn") / block_turns).cast("long").alias("block")).agg(F.count("*").alias("rows"))
    many = common.stored(rows.filter((F.col("rows") > part_turns) & F.col("block").isNotNull()).select("conv_id", "block"))
    crowded = many
    if not many.isEmpty():
        crowded = common.stored(blocks.join(many, ["conv_id", "block"], "left_semi").filter(F.col("n") > part_turns).select("conv_id", "block", F.ceil(F.col("n") / part_turns).cast("long").alias("parts")))
    if not crowded.isEmpty():
        known = known.join(crowded, ["conv_id", "block"], "left").withColumn("part", F.coalesce(_number(8) % F.col("parts"), "part")).drop("parts")
    views = own.filter(speaks & F.col("conv_id").isNotNull()).select("conv_id", F.col("speaker").alias("perspective")).distinct()
    lost = own.filter(speaks & F.col("conv_id").isNull()).distinct().select("*", F.lit(None).cast("long").alias("block"), _number(15).alias("part"), F.col("speaker").alias("perspective"))
    seen = known.join(views, "conv_id").unionByName(lost)
    parts = seen.withColumn("header", _header(F.col("speaker"), F.col("perspective")))
    parts = parts.withColumn("segment", F.concat("header", _escaped(F.col("text")), F.lit(CLOSE + "\n")))
    order = W.partitionBy("conv_id", "perspective", "block", "part").orderBy("turn", "speaker", "text")
    parts = parts.withColumn("place", F.row_number().over(order)).withColumn(
        "start", F.sum(F.length("segment")).over(order.rowsBetween(W.unboundedPreceding, W.currentRow)) - F.length("segment")
    )
    mine = F.col("speaker").eqNullSafe(F.col("perspective"))
    return parts.select(
        "conv_id", "perspective", "block", "part", "place", "segment", "start",
        F.when(mine, F.col("start") + F.length("header")).alias("mask_start"),
        F.when(mine, F.col("start") + F.length("segment") - 1).alias("mask_end"),
    )


def render(turns: DataFrame, speaker: str = "role", block_turns: int = BLOCK_TURNS, part_turns: int = PART_TURNS) -> DataFrame:
    """One row per dialogue, perspective, block and part: ``n_turns``, ``n_trained``, the rendered ``text`` and ``mask``,
    an array of ``(start, end)`` character spans to train on, end exclusive.  Rows as in ``rotate``.

    A block covers ``block_turns`` turn numbers, so one endless dialogue is many bounded rows.
    """
    parts = rotate(turns, speaker, block_turns, part_turns)
    span = F.struct(F.col("mask_start").alias("start"), F.col("mask_end").alias("end"))
    return parts.groupBy("conv_id", "perspective", "block", "part").agg(
        F.count("*").alias("n_turns"),
        F.count("mask_start").alias("n_trained"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", "segment"))), lambda s: s["segment"]), "").alias("text"),
        F.sort_array(F.collect_list(F.when(F.col("mask_start").isNotNull(), span))).alias("mask"),
    )


def _query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = render(common.table(spark, sf_dir, "conversations"))
    spans = F.transform("mask", lambda s: F.concat(s["start"].cast("string"), F.lit(":"), s["end"].cast("string")))
    return rows.select("conv_id", "perspective", "block", "part", "n_turns", "n_trained", F.col("text").alias("rendered"), F.array_join(spans, ",").alias("mask"))


QUERIES = {"op1_perspective_chat": _query}
ORACLE_SQL = {
    "op1_perspective_chat": r"""
WITH turns AS (
  SELECT DISTINCT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
), views AS (
  SELECT DISTINCT conv_id, role AS perspective FROM turns WHERE role <> 'system' AND conv_id IS NOT NULL
), numbered AS (
  SELECT *, CAST(floor(turn / 256) AS BIGINT) AS block, coalesce(role, '') || '/' || text AS said FROM turns
), sizes AS (
  SELECT conv_id, block, CAST(ceil(count(*) / 1024) AS BIGINT) AS parts FROM numbered
  WHERE conv_id IS NOT NULL AND turn IS NOT NULL GROUP BY conv_id, block
), dealt AS (
  SELECT n.conv_id, n.turn, n.role, n.text, n.block, v.perspective,
         CASE WHEN n.turn IS NULL THEN CAST('0x' || substr(md5(n.said), 1, 15) AS BIGINT)
              WHEN s.parts > 1 THEN CAST('0x' || substr(md5(n.said), 1, 8) AS BIGINT) % s.parts ELSE 0 END AS part
  FROM numbered n JOIN views v ON n.conv_id = v.conv_id LEFT JOIN sizes s ON s.conv_id = n.conv_id AND s.block = n.block
  UNION ALL
  SELECT conv_id, turn, role, text, NULL, role, CAST('0x' || substr(md5(said), 1, 15) AS BIGINT)
  FROM numbered WHERE conv_id IS NULL AND role <> 'system'
), headed AS (
  SELECT *, '<|im_start|>' || CASE WHEN role = 'system' THEN 'system' WHEN role = perspective THEN 'assistant' WHEN role IS NULL THEN 'user'
                                   ELSE 'user name=' || replace(replace(role, '<|', '< |'), chr(10), ' ') END || chr(10) AS header
  FROM dealt
), segments AS (
  SELECT *, header || replace(text, '<|', '< |') || '<|im_end|>' || chr(10) AS segment FROM headed
), placed AS (
  SELECT *, row_number() OVER w AS place,
         sum(length(segment)) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - length(segment) AS start
  FROM segments
  WINDOW w AS (PARTITION BY conv_id, perspective, block, part ORDER BY turn NULLS FIRST, role NULLS FIRST, text)
)
SELECT conv_id, perspective, block, CAST(part AS BIGINT) AS part, count(*) AS n_turns, count(*) FILTER (role = perspective) AS n_trained,
       string_agg(segment, '' ORDER BY place) AS rendered,
       coalesce(string_agg(CAST(start + length(header) AS BIGINT) || ':' || CAST(start + length(segment) - 1 AS BIGINT), ',' ORDER BY place)
                FILTER (role = perspective), '') AS mask
FROM placed GROUP BY conv_id, perspective, block, part
"""
}
