"""Near-duplicates by SimHash and meet-in-the-middle ball hashing.

Two fingerprints within 3 bits meet halfway: one walks at most one bit, the other
at most two.  Every distinct fingerprint emits its *near* ball, the 65 variants
within one bit; near balls that share a variant are within 2 bits.  At exactly 3 bits
the two have different parity, so the odd one alone walks the two bits (the *far*
variants), and two of three bits always lie in the same half of the fingerprint, so
2 x 496 far variants suffice.  The other half of such a pair then differs in at most
one bit; a far half is emitted only where an even fingerprint has its other half that
near, which a semi-join on half-balls settles without loss.

All rows are shuffled on the variant.  A variant has at most 65 near and 2,016 far
owners, whatever the data.  Each owner links to the smallest near owner: at most
1 + 2 bits away, checked once more by bit count.  So a group of any size gives a
star of links, not all its pairs, and no link between two components is lost.

Cases: null, empty and blank texts have fingerprint 0 and link like any other; equal
fingerprints form one class before any ball is emitted; null doc_ids keep their row
and never name a component unless it has no other id; repeated rows share a component;
an empty table gives no rows; columns beyond doc_id and text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from .common import addressed, rows_by_mark, text_or_empty, written
from .components import components

SEED = 42
BLOCK = 1 << 16  # shingles hashed at once
MASK32 = (1 << 32) - 1


def fingerprint(text: str, words_per_shingle: int = 3) -> int:
    """Unsigned 64-bit majority of the shingles' hashes; 0 without words."""
    from xxhash import xxh64_intdigest

    words = text.encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and ASCII white space alone
    if not words:
        return 0
    k = min(words_per_shingle, len(words))
    total, ones = len(words) - k + 1, np.zeros(64, dtype=np.int64)
    for start in range(0, total, BLOCK):
        part = words[start : start + BLOCK + k - 1]
        hashes = np.array([xxh64_intdigest(b" ".join(s), SEED) for s in zip(*(part[i:] for i in range(k)), strict=False)], dtype="<u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > total, bitorder="little").view("<u8")[0])


@F.pandas_udf(LongType())
def fingerprints(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for texts in batches:
        yield pd.Series(np.array([fingerprint(t) for t in texts], dtype=np.uint64).view(np.int64))


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _flips(bits: int, low: int, high: int) -> list[int]:
    return [signed(sum(1 << i for i in chosen)) for chosen in combinations(range(low, high), bits)]


def _masks(masks: list[int]) -> Column:
    return F.explode(F.array(*[F.lit(m).cast("long") for m in masks]))


def near_links(prints: DataFrame) -> DataFrame:
    """Links (a, b) that join all distinct fingerprints ``fp`` within 3 bits into components."""
    odd = F.bit_count("fp") % 2 == 1
    near = prints.select("fp", _masks([0, *_flips(1, 0, 64)]).alias("m")).select(F.col("fp").bitwiseXOR(F.col("m")).alias("v"), "fp", F.lit(True).alias("near"))
    low, high = F.col("fp").bitwiseAND(F.lit(MASK32)), F.shiftrightunsigned("fp", 32)
    halves = F.explode(F.array(F.struct(F.lit(0).alias("half"), low.alias("other")), F.struct(F.lit(1).alias("half"), high.alias("other"))))
    split = prints.select("fp", odd.alias("odd"), halves.alias("h")).select("fp", "odd", "h.half", "h.other")
    reached = (
        split.where("not odd").select("half", "other", _masks([0, *_flips(1, 0, 32)]).alias("m")).select("half", F.col("other").bitwiseXOR(F.col("m")).alias("other")).distinct()
    )
    # ``reached`` has 66 rows for a fingerprint, which an estimate from file sizes does not see: it is never broadcast.
    walkers = split.where("odd").join(reached.hint("merge"), ["half", "other"], "left_semi")
    # ``half`` names the part that stays; the two bits are flipped in the other one.
    far = [walkers.where(F.col("half") == half).select("fp", _masks(_flips(2, lo, lo + 32)).alias("m")) for half, lo in ((0, 32), (1, 0))]
    far_rows = far[0].union(far[1]).select(F.col("fp").bitwiseXOR(F.col("m")).alias("v"), "fp", F.lit(False).alias("near"))
    hub = F.min(F.when(F.col("near"), F.col("fp"))).over(Window.partitionBy("v"))
    met = near.union(far_rows).withColumn("hub", hub).where("hub is not null and hub <> fp")
    return met.where(F.bit_count(F.col("fp").bitwiseXOR(F.col("hub"))) <= 3).select(F.col("fp").alias("a"), F.col("hub").alias("b")).distinct()


def _members(rows: DataFrame, *more: str) -> DataFrame:
    """doc_id, fp and, as ``best``, the least (unnamed, doc_id, *more) of the row's component, of ``rows`` (doc_id, fp, *more)."""
    least = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", *more))
    classes = written(rows.groupBy("fp").agg(least.alias("least")), "simhash-classes")
    links = components(near_links(classes.select("fp")), "simhash-links")
    # Groups of one class name themselves; only linked classes are looked up.
    linked = classes.join(links.select(F.col("node").alias("fp"), "root"), "fp")
    best = linked.select("root", "least").union(classes.join(links.select(F.col("root").alias("fp")).distinct(), "fp", "left_semi").select("fp", "least"))
    best = best.groupBy("root").agg(F.min("least").alias("best"))
    named = links.join(best, "root").select(F.col("node").alias("fp"), "best").union(best.select("root", "best"))
    ids = written(classes.join(named, "fp", "left").select("fp", F.coalesce("best", "least").alias("best")), "simhash-ids")
    return rows.join(ids, "fp").select("doc_id", "fp", *more, "best")


def _printed(docs: DataFrame, *more: str) -> DataFrame:
    return written(docs.select(F.col("doc_id").cast("long").alias("doc_id"), fingerprints(text_or_empty()).alias("fp"), *more), "simhash-rows")


def near_groups(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint and component_id for every row of ``docs``."""
    return _members(_printed(docs)).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("best.doc_id").alias("component_id"))


def drop_near(docs: DataFrame) -> DataFrame:
    """One row of each group of near-duplicates, that of the smallest doc_id and then the first, with all columns."""
    rows = addressed(docs, "simhash-docs")
    found = _members(_printed(rows.select("row.doc_id", "row.text", "at"), "at"), "at")
    gone = found.where(F.col("at") != F.col("best.at")).select("at")
    return rows_by_mark(rows, gone, "simhash-gone", marked=False).select("row.*")
