"""Chat formatting: multi-party perspective rotation.

For every participant of a conversation the dialogue is rendered with that speaker as the assistant and all others
as named users; the mask marks what the model is trained on, the assistant's own messages with their end marks.
Speakers in CONTEXT_ROLES (system) take no part and stand as themselves in every rendering.

A rendering comes in parts of PART_TURNS turn numbers, in order, and a part that has more than PIECE_MESSAGES messages (many
of one turn number) in pieces; a conversation of any length is so spread over many rows and tasks, and its rows put
together are the whole rendering. Mask offsets count code points within the row; `offset` is where the row begins in the
whole rendering.

Edge cases: null text is an empty message; a null speaker is the participant "unknown". Turns that share a number
are ordered by speaker, then text; null turns come first, as part -1, in pieces too. Repeated rows are repeated messages.
The opening characters of control marks inside names and texts are taken apart, so that no message can end early. A null
conv_id is a conversation of its own. Extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import read_table

PART_TURNS = 64
PIECE_MESSAGES = 1024
CONTEXT_ROLES = ("system",)


def rotations(turns: DataFrame, part_turns: int = PART_TURNS, piece: int = PIECE_MESSAGES, context: tuple[str, ...] = CONTEXT_ROLES) -> DataFrame:
    """conv_id, perspective, part, piece, offset, n_turns, text, mask_starts, mask_ends from conv_id, turn, role, text."""
    plain = lambda c: F.replace(c, F.lit("<|"), F.lit("< |"))
    messages = turns.select(
        "conv_id",
        F.coalesce(F.floor(F.col("turn") / part_turns), F.lit(-1)).cast("long").alias("part"),
        "turn",
        plain(F.coalesce("role", F.lit("unknown"))).alias("speaker"),
        plain(F.coalesce("text", F.lit(""))).alias("said"),
    )
    turn = F.row_number().over(Window.partitionBy("conv_id", "part").orderBy("turn", "speaker", "said")) - 1
    said = messages.withColumn("piece", F.floor(turn / piece))
    # A message is as long in all renderings but its speaker's, where the name gives way to the role.
    outer = ~F.col("speaker").isin(*context)
    other = F.length("said") + F.length("speaker") + F.when(outer, len("user name=")).otherwise(0) + len("<|im_start|>\n<|im_end|>\n")
    parts = said.groupBy("conv_id", "part", "piece").agg(F.sort_array(F.collect_list(F.struct("turn", "speaker", "said"))).alias("turns"), F.sum(other).alias("others"))
    speakers = messages.where(outer).select(F.col("conv_id").alias("in_conv"), F.col("speaker").alias("perspective")).distinct()
    both = parts.join(speakers, F.col("conv_id").eqNullSafe(F.col("in_conv"))).drop("in_conv")
    own = F.size(F.filter("turns", lambda t: t.speaker == F.col("perspective"))) * (len("assistant") - len("user name=") - F.length("perspective"))
    both = both.withColumn("length", F.col("others") + own)
    outside = ", ".join(f"'{c}'" for c in context)
    segments = both.withColumn(
        "segments",
        F.expr(
            rf"""transform(turns, t -> named_struct('own', t.speaker = perspective,
                 'head', concat('<|im_start|>', CASE WHEN t.speaker = perspective THEN 'assistant' WHEN t.speaker IN ({outside}) THEN t.speaker
                                                     ELSE concat('user name=', t.speaker) END, '\n'),
                 'body', concat(t.said, '<|im_end|>'), 'tail', '\n'))"""
        ),
    )
    # Where each segment begins, by a running sum.
    placed = segments.withColumn(
        "starts",
        F.expr(
            """aggregate(segments, named_struct('at', 0L, 'all', cast(array() as array<bigint>)),
                 (s, g) -> named_struct('at', s.at + length(g.head) + length(g.body) + length(g.tail), 'all', array_append(s.all, s.at)), s -> s.all)"""
        ),
    ).withColumn("spans", F.expr("filter(arrays_zip(segments, starts), z -> z.segments.own)"))
    rows = placed.select(
        "conv_id",
        "perspective",
        "part",
        "piece",
        F.size("turns").cast("long").alias("n_turns"),
        F.expr("array_join(transform(segments, g -> concat(g.head, g.body, g.tail)), '')").alias("text"),
        F.expr("transform(spans, z -> z.starts + length(z.segments.head))").alias("mask_starts"),
        F.expr("transform(spans, z -> z.starts + length(z.segments.head) + length(z.segments.body))").alias("mask_ends"),
    )
    # Where a row begins follows from lengths alone; texts stay where they are.
    running = Window.partitionBy("conv_id", "perspective").orderBy("part", "piece").rowsBetween(Window.unboundedPreceding, -1)
    begins = both.select("conv_id", "perspective", "part", "piece", "length").withColumn("offset", F.coalesce(F.sum("length").over(running), F.lit(0)))
    same = [F.col(f"r.{c}").eqNullSafe(F.col(f"b.{c}")) for c in ("conv_id", "perspective", "part", "piece")]
    return rows.alias("r").join(begins.alias("b"), same).select("r.*", F.col("b.offset").alias("offset"))


def op3_perspectives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rotations(read_table(spark, sf_dir, "conversations"))


ORACLE = f"""
WITH t AS (
  SELECT conv_id, coalesce(floor(turn / {PART_TURNS}), -1)::BIGINT AS part, turn,
         replace(coalesce(role, 'unknown'), '<|', '< |') AS speaker, replace(coalesce(text, ''), '<|', '< |') AS said FROM conversations),
s AS (SELECT *, (row_number() OVER (PARTITION BY conv_id, part ORDER BY turn NULLS FIRST, speaker, said) - 1) // {PIECE_MESSAGES} AS piece FROM t),
p AS (SELECT DISTINCT conv_id, speaker AS perspective FROM s WHERE speaker <> 'system'),
g AS (
  SELECT s.*, perspective, speaker = perspective AS own,
         '<|im_start|>' || CASE WHEN speaker = perspective THEN 'assistant' WHEN speaker = 'system' THEN speaker ELSE 'user name=' || speaker END || chr(10) AS head,
         said || '<|im_end|>' AS body
  FROM s JOIN p ON s.conv_id IS NOT DISTINCT FROM p.conv_id),
o AS (SELECT *, sum(length(head) + length(body) + 1) OVER w - length(head) - length(body) - 1 AS spot, sum(length(head) + length(body) + 1) OVER v - length(head) - length(body) - 1 AS place FROM g
      WINDOW w AS (PARTITION BY conv_id, perspective, part, piece ORDER BY turn NULLS FIRST, speaker, said ROWS UNBOUNDED PRECEDING),
             v AS (PARTITION BY conv_id, perspective ORDER BY part, turn NULLS FIRST, speaker, said ROWS UNBOUNDED PRECEDING))
SELECT conv_id, perspective, part, piece, min(place)::BIGINT AS offset, count(*) AS n_turns,
       array_to_string(list(head || body || chr(10) ORDER BY spot), '') AS text,
       coalesce(list((spot + length(head))::BIGINT ORDER BY spot) FILTER (own), []) AS mask_starts,
       coalesce(list((spot + length(head) + length(body))::BIGINT ORDER BY spot) FILTER (own), []) AS mask_ends
FROM o GROUP BY conv_id, perspective, part, piece
"""
