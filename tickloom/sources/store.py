"""The bar store: monthly delta files behind a manifest, range scans, compaction, audit, results.

A batch writes its own rows and nothing else: files under ``data/batch=/freq=/month=`` and audit
rows under ``audit/batch=``.  One manifest entry, a small file with the next number, publishes all
of them at once; what no entry names is not part of the store.  A batch whose id an entry already
has is not written again, so replays after a failure at any point change nothing.  Two writers
that take the same number cannot both create it, and the later one takes the next.

Readers open the months of their range alone.  A month written by one batch is read as it is;
one with several is merged on read, the later batch winning.  ``compact`` writes such months
anew as one batch that replaces what it has read.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.align import keep_last
from ..schemas import BAR_COLUMNS, BAR_NUMERIC

# Read with this schema: inferred, a partition value such as 1d becomes a number.
STORE_SCHEMA = "symbol string, ts timestamp_ntz, {}, batch string, freq string, month string".format(
    ", ".join(f"{c} double" for c in BAR_NUMERIC)
)
AUDIT_SCHEMA = (
    "symbol string, freq string, provider string, start timestamp_ntz, end timestamp_ntz, rows long, "
    "status string, detail string, logged_at timestamp, batch string"
)


def month_of(ts: Column | str = "ts") -> Column:
    return F.date_format(ts, "yyyy-MM")


# --- manifest --------------------------------------------------------------


def _files(spark: SparkSession, path: str):
    """Hadoop file system and path object, for any store that Spark can write to."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def manifest(spark: SparkSession, path: str) -> list[dict]:
    """The entries in order, each with its number; one small file for each batch."""
    fs, folder = _files(spark, f"{path}/manifest")
    if not fs.exists(folder):
        return []
    rows = spark.read.option("wholetext", True).text(f"{path}/manifest/*.json").select("value", F.col("_metadata.file_name").alias("name")).collect()
    return sorted(({**json.loads(r["value"]), "number": int(r["name"].split(".")[0])} for r in rows), key=lambda e: e["number"])


def publish(spark: SparkSession, path: str, entry: dict) -> bool:
    """Create the next entry; False if the batch has one already."""
    while True:
        known = manifest(spark, path)
        if any(e["batch"] == entry["batch"] for e in known):
            return False
        number = known[-1]["number"] + 1 if known else 1
        fs, target = _files(spark, f"{path}/manifest/{number:012d}.json")
        _, draft = _files(spark, f"{path}/manifest/.{uuid.uuid4().hex}")
        out = fs.create(draft, False)
        out.write(bytearray(json.dumps(entry).encode()))
        out.close()
        # Renaming onto an existing entry fails, and the next number is tried.
        if not fs.exists(target) and fs.rename(draft, target):
            return True
        fs.delete(draft, False)


def live_parts(entries: list[dict], freq: str) -> dict[str, list[tuple[int, str]]]:
    """month -> (generation, folder) of the batches that hold it, oldest first.

    A compaction is as old as the newest entry it has read, so a batch published meanwhile wins over it.
    """
    parts: dict[str, list[tuple[int, str]]] = {}
    for e in entries:
        for month in e["months"] if e["freq"] == freq else []:
            kept = [p for p in parts.get(month, []) if p[1] not in e["replaces"]]
            parts[month] = sorted([*kept, (e["as_of"] or e["number"], e["folder"])])
    return parts


# --- bars ------------------------------------------------------------------


def merge_bars(stored: DataFrame | None, fresh: DataFrame, keys=("freq", "symbol", "ts")) -> DataFrame:
    """Stored and fresh bars, the fresh one winning, and among these the highest ``_seq``."""
    cols = [c for c in fresh.columns if c != "_seq"]
    seq = F.col("_seq") if "_seq" in fresh.columns else F.lit(0)
    both = fresh.select(*cols, F.struct(F.lit(1), seq).alias("_o"))
    if stored is not None:
        both = stored.select(*cols, F.struct(F.lit(0), F.lit(0)).alias("_o")).unionByName(both)
    return keep_last(both, list(keys), "_o").select(*cols)


def write_bars(spark: SparkSession, bars: DataFrame, path: str, freq: str, batch: str | None = None, provider: str = "landed", detail: str = "") -> bool:
    """Upsert bars and log them; False if ``batch`` has been published before.

    Of repeated (symbol, ts) the highest ``_seq`` counts, and a later batch wins over an earlier
    one.  Files are sorted by (symbol, ts), so a range scan skips row groups by their statistics.
    """
    batch = batch or uuid.uuid4().hex
    if any(e["batch"] == batch for e in manifest(spark, path)):
        return False
    absent = {c: F.lit(None).cast("double") for c in BAR_NUMERIC if c not in bars.columns}
    bars = bars.withColumns(absent) if absent else bars
    seq = F.col("_seq") if "_seq" in bars.columns else F.lit(0)
    fresh = keep_last(bars.select(*BAR_COLUMNS, seq.alias("_seq")), ["symbol", "ts"], "_seq").drop("_seq")
    return _write(spark, fresh, path, freq, batch, provider, detail)


def _write(spark: SparkSession, rows: DataFrame, path: str, freq: str, batch: str, provider: str, detail: str, replaces: tuple = (), as_of: int | None = None) -> bool:
    folder = f"{batch}-{uuid.uuid4().hex[:8]}"  # an attempt that fails leaves a folder nothing names
    data = f"{path}/data/batch={folder}"
    placed = rows.select(*BAR_COLUMNS, F.lit(freq).alias("freq"), month_of().alias("month"))
    spread = placed.hint("rebalance", "month").sortWithinPartitions("month", "symbol", "ts")
    spread.write.partitionBy("freq", "month").parquet(data)
    stored = spark.read.schema(STORE_SCHEMA).option("basePath", f"{path}/data").parquet(data)
    audit_row(stored, freq, provider, detail=detail).write.parquet(f"{path}/audit/batch={folder}")
    months = sorted(r[0] for r in stored.select("month").distinct().collect())
    return publish(spark, path, {"batch": batch, "folder": folder, "freq": freq, "months": months, "replaces": list(replaces), "as_of": as_of})


def read_bars(
    spark: SparkSession,
    path: str,
    symbols: list[str] | None = None,
    start: str | None = None,
    end: str | None = None,
    freq: str = "1d",
) -> DataFrame:
    """Range scan over the months of the range, with pushdown on symbol and ts."""
    return _scan(spark, path, live_parts(manifest(spark, path), freq), freq, symbols, start, end)


def _scan(spark: SparkSession, path: str, parts: dict, freq: str, symbols=None, start=None, end=None) -> DataFrame:
    low, high = (start or "")[:7], (end or "9999-99")[:7]
    parts = {m: p for m, p in parts.items() if low <= m <= high}
    single = [(m, p) for m, p in parts.items() if len(p) == 1]
    several = [(m, p) for m, p in parts.items() if len(p) > 1]

    def load(chosen: list) -> DataFrame:
        folders = [f"{path}/data/batch={folder}/freq={freq}/month={m}" for m, p in chosen for _, folder in p]
        if not folders:
            return spark.createDataFrame([], STORE_SCHEMA)
        df = spark.read.schema(STORE_SCHEMA).option("basePath", f"{path}/data").parquet(*folders)
        if symbols is not None:
            df = df.filter(F.col("symbol").isin(symbols))
        if start is not None:
            df = df.filter(F.col("ts") >= F.lit(start).cast("timestamp_ntz"))
        if end is not None:
            df = df.filter(F.col("ts") <= F.lit(end).cast("timestamp_ntz"))
        return df

    columns = [*BAR_COLUMNS, "freq"]
    out = load(single).select(*columns)
    if several:
        # As many batches as overlap in the range; compaction makes them one.
        ages = {folder: age for _, p in several for age, folder in p}
        age = F.create_map(*[F.lit(x) for pair in ages.items() for x in pair])[F.col("batch")]
        merged = keep_last(load(several).select(*columns, age.alias("_age")), ["freq", "symbol", "ts"], "_age")
        out = out.unionByName(merged.select(*columns))
    return out


def compact(spark: SparkSession, path: str, freq: str = "1d", start: str | None = None, end: str | None = None) -> bool:
    """Merge the months of the range that several batches hold into one batch; False if there are none."""
    entries = manifest(spark, path)
    low, high = (start or "")[:7], (end or "9999-99")[:7]
    parts = {m: p for m, p in live_parts(entries, freq).items() if len(p) > 1 and low <= m <= high}
    if not parts:
        return False
    folders = sorted({folder for p in parts.values() for _, folder in p})
    rows = _scan(spark, path, parts, freq)
    return _write(spark, rows, path, freq, f"compaction-{uuid.uuid4().hex}", "store", "compaction", tuple(folders), entries[-1]["number"])


# --- audit -----------------------------------------------------------------


def audit_row(bars: DataFrame, freq: str, provider: str, status: str = "ok", detail: str = "") -> DataFrame:
    """One audit row per symbol landed."""
    return bars.groupBy("symbol").agg(
        F.min("ts").alias("start"), F.max("ts").alias("end"), F.count(F.lit(1)).alias("rows")
    ).select(
        "symbol",
        F.lit(freq).alias("freq"),
        F.lit(provider).alias("provider"),
        "start",
        "end",
        "rows",
        F.lit(status).alias("status"),
        F.lit(detail).alias("detail"),
        F.current_timestamp().alias("logged_at"),
    )


def read_audit(spark: SparkSession, path: str) -> DataFrame:
    """The audit rows of all published batches."""
    folders = [f"{path}/audit/batch={e['folder']}" for e in manifest(spark, path)]
    if not folders:
        return spark.createDataFrame([], AUDIT_SCHEMA)
    return spark.read.schema(AUDIT_SCHEMA).option("basePath", f"{path}/audit").parquet(*folders)


# --- results ---------------------------------------------------------------


def save_result(tables: dict[str, DataFrame], path: str) -> None:
    """Result tables partitioned by run, so re-saving a run replaces only it."""
    for name, df in tables.items():
        (
            df.write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy("run_id")
            .parquet(f"{path.rstrip('/')}/{name}")
        )


def load_result(spark: SparkSession, path: str, table: str, run_id: str) -> DataFrame:
    return spark.read.parquet(f"{path.rstrip('/')}/{table}").filter(F.col("run_id") == run_id)


LEDGER_COLUMNS = (
    "ts", "symbol", "side", "qty", "price", "notional", "cost_bps", "reason", "tag", "pnl",
)


def export_ledger(trades: DataFrame, path: str) -> None:
    """Ledger as CSV with a fixed column order, one file per writing task."""
    trades.select(*LEDGER_COLUMNS).write.mode("overwrite").option("header", True).csv(path)
