"""Mixing sources to target weights by pivotal dependent rounding.

Every document gets ``target / source_size`` copies on average.  The whole part
is given at once; the fractions are settled by pivotal rounding: two units of a
source meet, and one moves part of its expected *words* to the other until one of
them holds none or all of its fraction.  The words of the pair stay the same, and so
do both expectations, so a source misses its target by at most the one document that
remains fractional at the end.

Rounding runs as a reduction tree.  In a leaf of about ``leaf_rows`` documents, which
all start with the fraction of their source, the largest document meets the bundle of
all others, then the next largest meets the rest, so that a short document remains
fractional.  ``fan_in`` leaves then meet in a node of the next level, where the
remaining documents pair one by one, until one is left per source.  A source with a
third of all rows has many leaves, never one large group.

Cases: null or blank texts have size 0 and take 0; a null source is a source of
its own, ranked last; null doc_ids stay null; repeated rows are separate documents; an empty table gives
no rows; columns beyond doc_id, text and source are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import positioned, text_or_empty, written

WORD = r"[^\x20\x09-\x0D]+"
NO_ID = -(1 << 63)  # stands for a null doc_id inside the tree, where pandas would turn the column into floats
NODE = "doc_id long, size long, source_size long, target double, rank long, node long, base long, p double, copies long"


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3) -> DataFrame:
    """source, source_size, n_docs, rank and target for every source.

    The level ``lam`` of ``target = min(most * size, lam * weight)`` is found by
    repeated aggregates: each round the sources above their cap leave the share.
    """
    per_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    ranked, _ = positioned(per_source, F.col("source").asc_nulls_last(), "mix-sources")
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    ranked = ranked.withColumnRenamed("pos", "rank").withColumn("weight", weight)
    total = ranked.agg(F.sum("source_size")).first()[0] or 0
    cap, lam, capped = F.col("source_size") * most, 0.0, -1
    while True:
        full = cap <= F.lit(lam) * F.col("weight")
        row = ranked.agg(
            F.coalesce(F.sum(F.when(full, cap)), F.lit(0)).alias("held"),
            F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0)).alias("open"),
            F.count(F.when(full, 1)).alias("n"),
        ).first()
        if row["n"] == capped or not row["open"]:
            break
        capped, lam = row["n"], (total - row["held"]) / row["open"]
    target = F.least(cap.cast("double"), F.lit(lam) * F.col("weight"))
    return ranked.withColumn("target", target).select("source", "source_size", "n_docs", "rank", "target")


def exchange(a: float, x: float, b: float, y: float, draw: float) -> tuple[float, float]:
    """One pivotal step between units of ``a`` and ``b`` words with fractions ``x`` and ``y``: one becomes 0 or 1."""
    gain, loss = min(a * (1 - x), b * y), min(a * x, b * (1 - y))
    if draw * (gain + loss) < loss:  # words move to the first unit
        return (1.0 if a * (1 - x) <= b * y else x + gain / a), (0.0 if b * y <= a * (1 - x) else y - gain / b)
    return (0.0 if a * x <= b * (1 - y) else x - loss / a), (1.0 if b * (1 - y) <= a * x else y + loss / b)


def settle_leaf(size: np.ndarray, p: np.ndarray, draws: np.ndarray) -> tuple[np.ndarray, int]:
    """Leaf of rows with one common fraction, largest first: 0/1 for each row and the index still open."""
    out, common, rest = np.zeros(len(p), dtype=np.int64), float(p[0]), float(size.sum())
    for i in range(len(p) - 1):
        rest -= size[i]
        x, common = exchange(float(size[i]), common, rest, common, draws[i])
        if x not in (0.0, 1.0):  # the bundle was settled instead
            out[i + 1 :], p[i] = int(common), x
            return out, i
        out[i] = int(x)
        if common in (0.0, 1.0):
            out[i + 1 :] = int(common)
            return out, -1
    p[-1] = common
    return out, len(p) - 1


def settle(size: np.ndarray, p: np.ndarray, draws: np.ndarray) -> tuple[np.ndarray, int]:
    """Pairs of a node above the leaves, in row order: 0/1 for each row and the index still open (-1: none)."""
    out, open_at, x = np.zeros(len(p), dtype=np.int64), -1, 0.0
    for i in range(len(p)):
        if open_at < 0:
            open_at, x = i, p[i]
            continue
        x, y = exchange(float(size[open_at]), x, float(size[i]), p[i], draws[i])
        p[open_at], p[i] = x, y
        if x in (0.0, 1.0):
            out[open_at] = int(x)
            open_at, x = (i, y) if y not in (0.0, 1.0) else (-1, 0.0)
        if open_at != i and y in (0.0, 1.0):
            out[i] = int(y)
    return out, open_at


def _node_fold(level: int, seed: int):
    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        order, up = (["key", "doc_id", "size"], True) if level else (["size", "key", "doc_id"], [False, True, True])
        rows = rows.sort_values(order, ascending=up, kind="stable").reset_index(drop=True)
        rng = np.random.default_rng([seed, level, int(rows["rank"].iat[0]), int(rows["node"].iat[0])])
        p = rows["p"].to_numpy(dtype=np.float64).copy()
        ones, left = (settle if level else settle_leaf)(rows["size"].to_numpy(), p, rng.random(len(rows)))
        copies = (rows["base"].to_numpy() + ones).astype("float64")
        if left >= 0:
            copies[left] = np.nan
        rows["copies"], rows["p"] = pd.array(copies, dtype="Int64"), p
        return rows[[c.split()[0] for c in NODE.split(", ")]]

    return fold


def mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3, leaf_rows: int = 2000, fan_in: int = 64, seed: int = 7) -> DataFrame:
    """doc_id, size, source_size, target, copies and taken for every document."""
    sizes = written(docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"), F.col("source").cast("string").alias("source"), word_count(text_or_empty()).alias("size")), "mix-sizes")
    sources = written(source_targets(sizes, weights, most), "mix-targets")
    rate = F.when(F.col("source_size") > 0, F.least(F.lit(float(most)), F.col("target") / F.col("source_size"))).otherwise(F.lit(0.0))
    leaves = F.greatest(F.lit(1), F.ceil(F.col("n_docs") / leaf_rows))
    rows = (
        sizes.alias("d")
        .join(sources.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source")))
        .withColumn("rate", rate)
        .withColumn("base", F.floor("rate").cast("long"))
        .withColumn("p", F.when(F.col("size") > 0, F.col("rate") - F.col("base")).otherwise(F.lit(0.0)))
        .withColumn("node", F.pmod(F.xxhash64("doc_id", "size", F.lit(seed)), leaves).cast("long"))
    )
    held = ["doc_id", "size", "source_size", "target"]
    done = rows.where("p = 0").select(*held, F.col("base").alias("copies"))
    key = F.xxhash64(F.lit(seed), "size", "doc_id")
    level, open_rows = 0, rows.where("p > 0").select(*held, "rank", "node", "base", "p")
    nodes = sources.agg(F.max(leaves)).first()[0] or 0
    while nodes:
        folded = written(open_rows.withColumn("key", key).groupBy("rank", "node").applyInPandas(_node_fold(level, seed), NODE), f"mix-level{level}")
        done = done.unionByName(folded.where("copies is not null").select(*held, "copies"))
        rest = folded.where("copies is null")
        if nodes == 1:
            # one document per source: its own draw decides
            draw = F.pmod(F.xxhash64(F.lit(seed), "rank", "doc_id"), F.lit(1 << 30)) / float(1 << 30)
            done = done.unionByName(rest.select(*held, (F.col("base") + (draw < F.col("p")).cast("long")).alias("copies")))
            break
        open_rows = rest.withColumn("node", F.floor(F.col("node") / fan_in).cast("long")).select(*held, "rank", "node", "base", "p")
        level, nodes = level + 1, math.ceil(nodes / fan_in)
    done = done.withColumn("doc_id", F.nullif("doc_id", F.lit(NO_ID)))
    return done.select(*held, "copies", (F.col("copies") * F.col("size")).alias("taken"))
