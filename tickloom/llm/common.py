"""Shared helpers: written intermediates, row numbering, deterministic splits, table reading."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.session import scratch

ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ROW_BITS = 33  # monotonically_increasing_id() keeps the row number of a partition in these bits


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` as a table in the shared folder; a lost executor costs no recomputation beyond it."""
    spark = df.sparkSession
    path = scratch(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


MASK_BITS = 6  # rows of 64 share one mask
MASKS = 1_000_000  # masks broadcast at once, some 40 bytes each


def addressed(docs: DataFrame, label: str) -> DataFrame:
    """``docs`` as (at, file, row): ``at`` tells rows apart whatever their columns hold, ``row`` has all of them.

    The address is the file's number among the sorted names and the row's place in the file,
    so it is the same in every scan.  Frames that are not a scan of files are written first.
    """
    try:
        meta = docs.metadataColumn("_metadata")
        plain = docs.inputFiles() and not docs.select(meta["row_index"]).isStreaming
        plan = docs._jdf.queryExecution().analyzed().toString()
        plain = plain and not any(node in plan for node in ("Join", "Generate", "Union", "Expand", "Aggregate"))
    except AnalysisException:
        plain = False
    if not plain:
        docs = written(docs, label)
        meta = docs.metadataColumn("_metadata")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), meta["file_path"].alias("file"), meta["row_index"].alias("place"))
    # As many names as the scan itself has listed on the driver.
    names = sorted(r[0] for r in rows.select("file").distinct().collect())
    numbers = docs.sparkSession.createDataFrame(list(enumerate(names)), "number long, file string")
    at = F.shiftleft("number", ROW_BITS) + F.col("place")
    return rows.join(F.broadcast(numbers), "file").select(at.alias("at"), "file", "row")


def rows_by_mark(rows: DataFrame, marks: DataFrame, label: str, marked: bool, masks: int = MASKS) -> DataFrame:
    """The rows of ``rows`` (as ``addressed`` gives them) whose address is, or is not, in ``marks(at)``.

    No row leaves its scan: the addresses become one mask for 64 rows.  Masks are counted and broadcast;
    beyond ``masks`` of them the files are read in slices, each with the masks of its own files.
    """
    block = F.shiftright("at", MASK_BITS)
    one = F.expr(f"shiftleft(1L, cast(at & {(1 << MASK_BITS) - 1} as int))")
    table_of = written(marks.groupBy(block.alias("block")).agg(F.bit_or(one).alias("mask")), label)
    counts = table_of.groupBy(F.shiftright("block", ROW_BITS - MASK_BITS).alias("number")).count()
    found = F.col("mask").isNotNull() & (F.expr(f"shiftrightunsigned(mask, cast(at & {(1 << MASK_BITS) - 1} as int)) & 1") == 1)

    def joined(part: DataFrame, own: DataFrame) -> DataFrame:
        met = part.withColumn("block", block).join(F.broadcast(own), "block", "inner" if marked else "left")
        return met.where(found if marked else ~found).select(part.columns)

    if table_of.count() <= masks:
        return joined(rows, table_of)
    per_file, names = {r[0]: r[1] for r in counts.collect()}, sorted(r[0] for r in rows.select("file").distinct().collect())
    out, first, held = None, 0, 0
    for k in range(len(names)):
        held += per_file.get(k, 0)
        if k + 1 == len(names) or held + per_file.get(k + 1, 0) > masks:
            number = F.shiftright("block", ROW_BITS - MASK_BITS)
            part = joined(rows.where(F.col("file").between(names[first], names[k])), table_of.where(number.between(first, k)))
            out, first, held = part if out is None else out.unionByName(part), k + 1, 0
    return out


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z alone; other letters keep their case."""
    return F.translate(text, ASCII_UPPER, ASCII_UPPER.lower())


def crc_fold(column: str, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; null ids count as the empty string."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % F.lit(folds)


def positioned(df: DataFrame, order: Column, label: str) -> tuple[DataFrame, int]:
    """Rows in the order of ``order`` with their global position ``pos`` (from 0), and their number.

    A range partitioning replaces the one-task sort: only the row count of each
    partition reaches the driver.
    """
    parts = df.sparkSession.conf.get("spark.sql.shuffle.partitions")
    local = written(
        df.repartitionByRange(int(parts), order).sortWithinPartitions(order).withColumn("_mid", F.monotonically_increasing_id()),
        label,
    )
    split = F.shiftright("_mid", ROW_BITS)
    counts = {r[0]: r[1] for r in local.groupBy(split.alias("p")).count().collect()}
    starts, total = {}, 0
    for p in sorted(counts):
        starts[p] = total
        total += counts[p]
    offsets = F.create_map(*[F.lit(x) for p, s in starts.items() for x in (p, s)]) if starts else None
    inner = F.col("_mid").bitwiseAND(F.lit((1 << ROW_BITS) - 1))
    pos = (F.try_element_at(offsets, split) + inner) if starts else F.lit(0)
    return local.withColumn("pos", pos.cast("long")).drop("_mid"), total
