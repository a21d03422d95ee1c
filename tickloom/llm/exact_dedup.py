"""Exact dedup by a tree merge of sorted digest runs.

Each input partition makes one run: its distinct digests, each with the verified best
row so far and the number of rows.  Runs then meet in rounds as in a binomial tree:
``2**step`` neighbouring runs exchange their digests and are merged into one longer run,
which keeps the best row of each digest, until one level holds each digest once.  A merge
is Spark's grouping by (run, digest) in place of a sorted multiway merge, so a run is
spread over all tasks and no task holds or sorts one whole; of a group of copies with a third of all rows, a
merge sees at most ``2**step`` entries.  The answers go down the same tree: a level
asks only the level above, and a row asks only its own run.

A digest is the SHA-256 of the text without ASCII white space, held together with
the length and an independent 64-bit hash of that text; entries that differ in any
of the three are never merged.  Of equal texts, the row with the most code points in
the original text stays, then the smallest doc_id, then the earlier row.

Cases: null text counts as empty; empty and blank texts are equal to one another;
null doc_ids come after all others; repeated rows are separate members, one of which
stays; an empty table gives no rows; columns beyond doc_id and text are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ROW_BITS, addressed, rows_by_mark, text_or_empty, written

KEY = ["digest", "n_bare", "check"]
BLANK = r"[\x20\x09-\x0D]+"


def bare(text: Column) -> Column:
    return F.regexp_replace(text, BLANK, "")


def digests(docs: DataFrame, *more: str) -> DataFrame:
    """One small row per document: digest key, rank of the row and the run (input partition) it belongs to."""
    rows = (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("_text"), *more)
        .select("doc_id", F.char_length("_text").cast("long").alias("n_chars"), bare(F.col("_text")).alias("_bare"), *more)
        .select(
            "doc_id",
            F.unhex(F.sha2(F.col("_bare").cast("binary"), 256)).alias("digest"),
            F.octet_length("_bare").cast("long").alias("n_bare"),
            F.xxhash64("_bare").alias("check"),
            F.struct((-F.col("n_chars")).alias("less"), F.col("doc_id").isNull().alias("unnamed"), "doc_id", F.monotonically_increasing_id().alias("row")).alias("best"),
            *more,
        )
        .withColumn("node", F.shiftright("best.row", ROW_BITS))
    )
    return written(rows, "exact-rows")


def exact_groups(docs: DataFrame, step: int = 4) -> DataFrame:
    """doc_id, keep_id, group_size, kept and text_sha256 for every row of ``docs``."""
    return _groups(digests(docs), step)


def _groups(rows: DataFrame, step: int = 4, *more: str) -> DataFrame:
    merged = rows.groupBy("node", *KEY).agg(F.min("best").alias("best"), F.count(F.lit(1)).alias("n"))
    levels = [written(merged, "exact-run0")]
    last = rows.agg(F.max("node")).first()[0] or 0
    while last:
        up = levels[-1].withColumn("node", F.shiftright("node", step)).groupBy("node", *KEY).agg(F.min("best").alias("best"), F.sum("n").alias("n"))
        levels.append(written(up, f"exact-run{len(levels)}"))
        last >>= step
    # Single rows answer themselves; only groups of two or more travel down.
    answer = levels[-1].where("n > 1").select("node", *KEY, F.col("best").alias("keep"), F.col("n").alias("total"))
    for level in reversed(levels[:-1]):
        own = level.select("node", *KEY, F.shiftright("node", step).alias("above"))
        answer = own.join(answer.withColumnRenamed("node", "above"), ["above", *KEY]).drop("above")
    out = rows.join(answer, ["node", *KEY], "left")
    keep = F.coalesce("keep", "best")
    return out.select(
        "doc_id",
        keep["doc_id"].alias("keep_id"),
        F.coalesce("total", F.lit(1)).cast("long").alias("group_size"),
        (keep["row"] == F.col("best.row")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
        *more,
    )


def drop_exact(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, one per group, with all their columns."""
    rows = addressed(docs, "exact-docs")
    found = _groups(digests(rows.select("row.doc_id", "row.text", "at"), "at"), 4, "at")
    return rows_by_mark(rows, found.where("not kept").select("at"), "exact-gone", marked=False).select("row.*")
