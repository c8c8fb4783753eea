"""Chat formatting by cumulative-snapshot collapse (DataFrame functions only)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Production rendering of one turn.
TURN_TEMPLATE = "<|im_start|>%s\n%s<|im_end|>\n"
#: Role shown where a turn has none.
NO_ROLE = "unknown"


def chat_format(conversations: DataFrame, template: str = TURN_TEMPLATE) -> DataFrame:
    """Renders every maximal conversation of a log that also holds its earlier snapshots.

    Input: conv_id, turn, role, text (other columns are ignored).  Turns are taken
    in the order (turn, role, text), nulls first; exactly repeated rows of a
    conversation count once.  A rolling 128-bit hash of the turns so far (position,
    role and text, null apart from empty) marks every prefix; a conversation whose
    whole hash is a shorter prefix of another goes by an anti-join, and of equal
    conversations the one with the smallest conv_id stays (null after all others).
    A null conv_id is a conversation of its own; a null role is rendered as
    'unknown', a null text as empty; long texts and conversations are rendered whole
    (a conversation is one row in the end, so its turns meet in one task).  An empty
    table gives no rows.

    Returns conv_id, n_turns (long), rendered (string).  Prefix hashes are
    deduplicated before the shuffle, so a first turn shared by a third of the log
    is sent once per task, not once per conversation.
    """
    # a null conv_id has a key of its own, so that every step shares one partitioning
    kind = dict(conversations.dtypes)["conv_id"]
    key = [F.col("conv_id").isNull().alias("none"), F.coalesce("conv_id", F.lit("0").cast(kind)).alias("id")]
    order = Window.partitionBy("none", "id").orderBy("turn", "role", "text")
    rolling = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before, between, after = template.split("%s")
    piece = F.concat(F.lit(before), F.coalesce("role", F.lit(NO_ROLE)), F.lit(between), F.coalesce("text", F.lit("")), F.lit(after))
    shape = [F.col("pos"), F.col("role").isNull(), F.coalesce("role", F.lit("")), F.col("text").isNull(), F.coalesce("text", F.lit(""))]
    turns = (
        conversations.select(*key, "turn", "role", "text")
        .withColumn("this", F.struct("turn", "role", "text"))
        .withColumn("again", F.lag("this").over(order).eqNullSafe(F.col("this")))
        .where("not again")
        .withColumn("pos", F.row_number().over(order).cast("long"))
        .withColumn("h1", F.bit_xor(F.xxhash64(F.lit(17), *shape)).over(rolling))
        .withColumn("h2", F.bit_xor(F.xxhash64(F.lit(7919), F.lit("second"), *shape)).over(rolling))
    )
    # rows of a conversation are together already: its last prefix and its rendered turns come without another shuffle
    whole = turns.groupBy("none", "id").agg(F.max(F.struct("pos", "h1", "h2")).alias("last"), F.array_sort(F.collect_list(F.struct("pos", piece.alias("piece")))).alias("pieces"))
    prefixes = turns.withColumn("n_turns", F.count("*").over(Window.partitionBy("none", "id")))
    shorter = prefixes.where("pos < n_turns").select(F.col("pos").alias("n_turns"), "h1", "h2").distinct()
    kept = (
        prefixes.where("pos = n_turns")
        .groupBy("n_turns", "h1", "h2")
        .agg(F.min(F.struct("none", "id")).alias("first"))
        .join(shorter, ["n_turns", "h1", "h2"], "left_anti")
        .select("first.none", "first.id")
    )
    shown = F.array_join(F.transform("pieces", lambda x: x["piece"]), "")
    return whole.join(kept, ["none", "id"], "left_semi").select(F.when(~F.col("none"), F.col("id")).alias("conv_id"), F.col("last.pos").alias("n_turns"), shown.alias("rendered"))


ORACLE_SQL = """
WITH turns AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS pos
  FROM (SELECT DISTINCT conv_id, turn, role, text FROM conversations)
), prefixes AS (
  SELECT conv_id, pos, count(*) OVER (PARTITION BY conv_id) AS n_turns,
    string_agg(coalesce('r' || role, 'n') || chr(1) || coalesce('t' || text, 'n'), chr(2)) OVER (PARTITION BY conv_id ORDER BY pos) AS so_far
  FROM turns
), whole AS (
  SELECT n_turns, so_far, min(conv_id) AS conv_id FROM prefixes WHERE pos = n_turns GROUP BY n_turns, so_far
), kept AS (
  SELECT conv_id, n_turns FROM whole w
  WHERE NOT EXISTS (SELECT 1 FROM prefixes p WHERE p.pos < p.n_turns AND p.pos = w.n_turns AND p.so_far = w.so_far)
)
SELECT k.conv_id, k.n_turns,
  string_agg('<|im_start|>' || coalesce(t.role, 'unknown') || chr(10) || coalesce(t.text, '') || '<|im_end|>' || chr(10), '' ORDER BY t.pos) AS rendered
FROM kept k JOIN turns t ON k.conv_id IS NOT DISTINCT FROM t.conv_id
GROUP BY k.conv_id, k.n_turns
"""
