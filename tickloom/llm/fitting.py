"""Bounded, repeatable samples for the trained operators, and features collected from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def spread(rows: DataFrame, by: str, cap: int, key: str = "doc_id", seed: int = 11) -> DataFrame:
    """At most ``cap`` rows of each value of ``by``, the same ones in every run.

    One aggregate counts the values; a hash threshold then thins each of them to about
    1.2 * cap rows before the ``cap`` smallest hashes are taken, so no value, however
    common, is sorted or gathered whole.  ``weight`` is the number of rows a chosen one stands for.
    """
    counts = {r[0]: r[1] for r in rows.where(F.col(by).isNotNull()).groupBy(by).count().collect()}
    draw = F.xxhash64(key, F.lit(seed))
    parts = []
    for value, n in sorted(counts.items()):
        share = min(1.0, (1.2 * cap + 50) / n)
        own = rows.where(F.col(by) == F.lit(value)).where(F.pmod(draw, F.lit(1 << 20)) < int(share * (1 << 20)) + 1)
        parts.append(own.orderBy(draw, key).limit(cap).withColumn("weight", F.lit(float(max(1.0, n / cap)))))
    if not parts:
        return rows.limit(0).withColumn("weight", F.lit(1.0))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def with_features(docs: DataFrame, chosen: DataFrame, features: Column) -> DataFrame:
    """Features, made of ``text``, of the documents in ``chosen`` (doc_id and labels), which is bounded by its sample size."""
    chosen = chosen.withColumnRenamed("doc_id", "_id")
    return docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("_id")).select(*[c for c in chosen.columns if c != "_id"], "doc_id", features.alias("features"))
