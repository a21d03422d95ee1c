"""Chat formatting by multi-party perspective rotation.

For every participant of a conversation the whole dialogue is rendered once with that
speaker as the assistant and the others as named users; only the assistant's words and
their end mark are trained on.  System turns belong to nobody and stay system turns.

The result has one row per (conversation, perspective, turn): the rendered segment, its
place in the rendered dialogue and the trained range, both in characters.  Segments in
``position`` order, end to end, are the dialogue; nothing is ever gathered into one row, so
a conversation with a third of all turns is only many rows.  Turns are dealt out by ranges
of (conversation, turn, role, text); places are running sums inside a range plus the sums
of the earlier ranges of the same conversation.

Cases: turns are ordered by turn (null first), role and text; repeated rows are separate
turns; a null role is the speaker ``unknown``; a null text is empty; a null conv_id is a
conversation of its own; a conversation without participants has no perspective and no
rows; ``<|`` inside texts is broken up as ``< |``, and characters of names beyond letters,
digits, ``_`` and ``-`` become ``_``, so that neither can forge a mark; columns beyond
conv_id, turn, role and text are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ROW_BITS, written

OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"


def _same(left: str, right: str) -> Column:
    return F.col(left).eqNullSafe(F.col(right))


def rotate(turns: DataFrame, system: str = "system") -> DataFrame:
    """conv_id, perspective, position, turn, role, name, segment, start, end, train, train_start, train_end."""
    spark = turns.sparkSession
    order = ["conv_id", "turn", "role", "text"]
    rows = turns.select(
        "conv_id",
        "turn",
        F.coalesce(F.col("role").cast("string"), F.lit("unknown")).alias("role"),
        F.replace(F.coalesce(F.col("text").cast("string"), F.lit("")), F.lit("<|"), F.lit("< |")).alias("text"),
    )
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("mid", F.monotonically_increasing_id())
    local = written(dealt.withColumn("part", F.shiftright("mid", ROW_BITS)), "chat-turns")

    # Speakers of each conversation, carried once per range the conversation lies in.
    spoken = local.where(F.col("role") != system).select("conv_id", "role").distinct()
    speakers = spoken.groupBy("conv_id").agg(F.array_sort(F.collect_list("role")).alias("speakers")).withColumnRenamed("conv_id", "_conv")
    ranges = local.select("conv_id", "part").distinct().join(speakers, _same("conv_id", "_conv")).select(F.col("conv_id").alias("_conv"), F.col("part").alias("_part"), "speakers")
    turned = local.join(ranges, _same("conv_id", "_conv") & (F.col("part") == F.col("_part"))).select(*local.columns, F.explode("speakers").alias("perspective"))

    own = F.col("role") == F.col("perspective")
    shown = F.when(own, "assistant").when(F.col("role") == system, "system").otherwise("user")
    name = F.when(shown == "user", F.regexp_replace("role", "[^A-Za-z0-9_-]", "_"))
    head = F.concat(F.lit(OPEN), shown, F.coalesce(F.concat(F.lit(" name="), name), F.lit("")), F.lit("\n"))
    segments = turned.withColumns({"shown": shown, "name": name, "head": F.char_length(head), "segment": F.concat(head, "text", F.lit(CLOSE))}).withColumn("size", F.char_length("segment").cast("long"))

    keys = ["conv_id", "perspective", "part"]
    sums = segments.groupBy(*keys).agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("conv_id", "perspective").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(
        F.col("conv_id").alias("_conv"),
        F.col("perspective").alias("_view"),
        F.col("part").alias("_part"),
        F.coalesce(F.sum("size").over(earlier), F.lit(0)).alias("size_before"),
        F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("n_before"),
    )
    inside = Window.partitionBy(*keys).orderBy("mid").rowsBetween(Window.unboundedPreceding, 0)
    placed = segments.withColumns({"upto": F.sum("size").over(inside), "nth": F.count(F.lit(1)).over(inside)})
    placed = placed.join(offsets, _same("conv_id", "_conv") & (F.col("perspective") == F.col("_view")) & (F.col("part") == F.col("_part")))
    end = F.col("size_before") + F.col("upto")
    start = end - F.col("size")
    train = F.col("shown") == "assistant"
    return placed.select(
        "conv_id",
        "perspective",
        (F.col("n_before") + F.col("nth") - 1).alias("position"),
        "turn",
        F.col("shown").alias("role"),
        "name",
        "segment",
        start.alias("start"),
        end.alias("end"),
        train.alias("train"),
        F.when(train, start + F.col("head")).alias("train_start"),
        F.when(train, end - 1).alias("train_end"),
    )
