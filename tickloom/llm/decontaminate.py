"""Benchmark decontamination by a prefix-filtered join on word shingles.

A window is ``window`` consecutive words of an item (all of them, if it has fewer).  A
document contains it only if it contains every shingle of ``shingle`` words of the window,
so one shingle, the window's prefix, must be found: the rarest one, by its count over all
documents.  Documents look up each of their shingles among the prefixes; the position of a
match and the prefix's offset fix where the window would start, starts outside the text
are dropped by the length bounds, and the remaining ones are compared word by word.

Both passes read whole documents and keep text out of the shuffle: the benchmark's distinct
windows are broadcast up to ``broadcast_windows`` of them (a few hundred bytes each, counted
beforehand).  Beyond that the same join runs on shuffled shingle hashes, and candidates
fetch the words of their documents afterwards.

Hit words are the union of the occurrences' word ranges, found by one ordered pass over
the starts in a document.  Documents are told apart by id and text.

Cases: null and empty texts have no words; items without words have no windows; a null
item_id counts as the empty string; repeated items and rows count once and keep their rows;
an empty table on either side gives no rows or zero hits; columns beyond doc_id, text and
item_id are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import addressed, ascii_lower, rows_by_mark, text_or_empty, written

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WORD_ANY_CASE = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    """Lower-cased words; texts in ASCII alone take the faster built-in."""
    lowered = F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(ascii_lower(text))
    return F.regexp_extract_all(lowered, F.lit(WORD), F.lit(0))


def shingles(words: Column, size: int) -> Column:
    """Hashes of all runs of ``size`` words; empty if there are fewer words."""
    n = F.size(words)
    hashed = F.transform(F.sequence(F.lit(0), n - size), lambda i: F.xxhash64(*[F.get(words, i + j) for j in range(size)]))
    return F.when(n >= size, hashed).otherwise(F.array().cast("array<bigint>"))


def windows(items: DataFrame, window: int) -> tuple[DataFrame, DataFrame]:
    """Distinct windows (wid, wwords, wlen) and the items that have them (wid, item)."""
    split = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), words_of(text_or_empty()).alias("words")).where(F.size("words") > 0)
    starts = F.explode(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("words") - window + 1)))
    rows = written(split.select("item", "words", starts.alias("at")).select("item", F.slice("words", F.col("at"), F.lit(window)).alias("wwords")).distinct(), "bench-rows")
    known = written(rows.select("wwords").distinct().withColumn("wid", F.monotonically_increasing_id()).withColumn("wlen", F.size("wwords")), "bench-windows")
    return known, written(rows.join(known.select("wid", "wwords"), "wwords").select("wid", "item"), "bench-items")


def _tokenised(docs: DataFrame) -> DataFrame:
    return docs.select("key", words_of(text_or_empty()).alias("words"))


def _occurrences(docs: DataFrame, known: DataFrame, size: int, small: bool) -> DataFrame:
    """(key, start, wlen, wid): where windows, all with shingles of ``size`` words, occur in the documents."""
    offered = known.select("wid", "wwords", "wlen", F.posexplode_outer(shingles(F.col("wwords"), size)).alias("off", "h"))
    hashes = offered.select("h").distinct()
    tokens = _tokenised(docs).select("key", "words", shingles(F.col("words"), size).alias("hs"))
    # How often each shingle of the benchmark occurs in the documents.
    flat = tokens.select(F.explode_outer("hs").alias("h"))
    found = flat.join(F.broadcast(hashes), "h").groupBy("h").count() if small else flat.groupBy("h").count().join(hashes, "h")
    ranked = offered.join(written(found, "bench-counts"), "h")  # a window with a shingle that never occurs can still fail on others
    order = F.struct("count", "off", "h")
    rarest = ranked.groupBy("wid").agg(F.min(order).alias("r"), F.count(F.lit(1)).alias("n"))
    prefix = known.join(rarest, "wid").where(F.col("n") == F.col("wlen") - size + 1).select("wid", "wwords", "wlen", F.col("r.off").alias("off"), F.col("r.h").alias("h"))
    prefix = written(prefix, "bench-prefix")
    start = F.col("pos") - F.col("off")
    if small:
        met = tokens.select("key", "words", F.posexplode_outer("hs").alias("pos", "h")).join(F.broadcast(prefix), "h")
        inside = (start >= 0) & (start + F.col("wlen") <= F.size("words"))
        return met.where(inside).where(F.slice("words", start + 1, F.col("wlen")) == F.col("wwords")).select("key", start.alias("start"), "wlen", "wid")
    places = tokens.select("key", F.size("words").alias("n"), F.posexplode_outer("hs").alias("pos", "h"))
    near = places.join(prefix.select("h", "off", "wid", "wlen"), "h").where((start >= 0) & (start + F.col("wlen") <= F.col("n")))
    near = written(near.select("key", start.alias("start"), "wlen", "wid").distinct(), "bench-candidates")
    texts = _tokenised(docs).join(near.select("key").distinct(), "key", "left_semi").dropDuplicates(["key"])
    held = near.join(prefix.select("wid", "wwords"), "wid").join(texts, "key")
    return held.where(F.slice("words", F.col("start") + 1, F.col("wlen")) == F.col("wwords")).select("key", "start", "wlen", "wid")


def contamination(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 and contaminated for every row of ``docs``."""
    keyed = docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("key"))
    return _keyed_contamination(keyed, items, **options).drop("key")


def _keyed_contamination(docs: DataFrame, items: DataFrame, window: int = 13, shingle: int = 5, share: int = 20, broadcast_windows: int = 200_000) -> DataFrame:
    """The columns of ``contamination`` and ``key``, by which ``docs`` (doc_id, text, key) tells documents apart."""
    known, owners = windows(items, window)
    by_size = {r[0]: r[1] for r in known.groupBy(F.least(F.lit(shingle), F.col("wlen"))).count().collect()}
    small = sum(by_size.values()) <= broadcast_windows
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), "key")
    parts = [_occurrences(docs, known.where(F.least(F.lit(shingle), F.col("wlen")) == size), size, small) for size in sorted(by_size)]
    base = docs.select("doc_id", "key", F.regexp_count(text_or_empty(), F.lit(WORD_ANY_CASE)).cast("long").alias("n_words"))
    nothing = docs.sparkSession.createDataFrame([], "key long, start int, wlen int, wid long")
    hits = nothing
    for part in parts:
        hits = hits.unionByName(part)
    hits = written(hits.distinct(), "bench-hits")
    spans = hits.groupBy("key", "start").agg(F.max("wlen").alias("wlen")).withColumn("end", F.col("start") + F.col("wlen"))
    before = Window.partitionBy("key").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    fresh = F.greatest(F.lit(0), F.col("end") - F.greatest("start", F.coalesce(F.max("end").over(before), F.lit(0))))
    covered = spans.withColumn("fresh", fresh).groupBy("key").agg(F.sum("fresh").cast("long").alias("n_hit"))
    named = hits.select("key", "wid").distinct().join(owners, "wid").select("key", "item").distinct()
    listed = named.groupBy("key").agg(F.count(F.lit(1)).alias("n_items"), F.sha2(F.array_join(F.array_sort(F.collect_list("item")), ","), 256).alias("items_sha256"))
    marked = written(covered.join(listed, "key"), "bench-marked")
    n_hit = F.coalesce("n_hit", F.lit(0))
    return base.join(marked, "key", "left").select(
        "doc_id",
        "key",
        "n_words",
        n_hit.alias("n_hit"),
        F.coalesce("n_items", F.lit(0)).alias("n_items"),
        F.coalesce("items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256"),
        ((n_hit > 0) & (share * n_hit >= F.col("n_words"))).alias("contaminated"),
    )


def drop_contaminated(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that are not contaminated, with all their columns."""
    rows = addressed(docs, "bench-docs")
    found = _keyed_contamination(rows.select("row.doc_id", "row.text", F.col("at").alias("key")), items, **options)
    return rows_by_mark(rows, found.where("contaminated").select(F.col("key").alias("at")), "bench-gone", marked=False).select("row.*")
