"""N-gram Jaccard join by universe partition and the pigeonhole principle.

A document is the set of its ``SHINGLE``-word runs.  Two sets link when 100 * intersection is at
least ``PERCENT`` * union, so linked sets differ in few shingles: at most ``differences(a, b)``.

* Equal sets form one class before anything is compared.
* Size bands: linked sets lie in the same band or in neighbouring ones, and the larger one's
  band decides how the universe is cut: shingles are hashed into segments, and each set falls
  into one subset for each segment.
* Pigeonhole: a segment of allowance 1 is indexed by its subset and fails only if the two
  subsets differ; one of allowance 2 is indexed by its subset and all subsets with one shingle
  deleted and fails only from two differences on.  If the allowances add up to more than the
  differences, some segment of linked sets has a common key.  ``allocate`` chooses the number of
  segments of each kind for a band by cost, from the band's sizes and its number of sets.
* Empty subsets would meet in one bucket.  They are not indexed; each band has a reserve of
  allowances for them, and only the few sets with more of them than the reserve index them, too:
  what a pair loses, both of its sets lack.
* Buckets: equal keys of one batch meet inside the batch, so a bucket sends one row for each batch.
  Every member is compared with the least set of its bucket; that links groups of any size by
  stars.  Buckets whose members are then still in different components compare the members
  outside the bucket's largest component with a few of its members, so that those with many
  links to it need not list them, and what then remains with all members of other components.  No other pair
  can join two components, so no link is lost and pairs of one group are never listed.
* Candidates pass the length bound and a parity bitmap (one bit flips for every differing
  shingle, so more different bits than ``differences`` prove a pair unlinked; long sets have a
  second, longer one) before the texts of the rest are fetched and verified exactly.

Texts are read three times, by row address: for set sizes, for keys (one row for each class) and for
verification (candidates alone).  Shingles are compared as word tuples when verified, and by
64-bit hashes before; equal sets are told by size and two such sums.

Cases: null, empty and blank texts have the empty set and link with nothing; fewer words than a
shingle are one shingle; null doc_ids keep their row and name a component only if it has no id;
repeated rows share a component; an empty table gives no rows; columns beyond doc_id and text are
ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import addressed, rows_by_mark, text_or_empty, written
from .components import components

SHINGLE, PERCENT = 4, 85
LANES = 8  # 64-bit words of a parity bitmap
SPARSE = 50.0  # how much dearer a key is whose subset is likely empty
SEATS = 4  # members of a bucket's largest component that those outside it meet first
THIN = 1000.0  # sets of a band that may index empty subsets
PART = 1 << 20  # rows handed on at once

Shingles = list[tuple[bytes, ...]]


def shingles(text: str, size: int = SHINGLE) -> Iterator[tuple[bytes, ...]]:
    words = text.encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and ASCII white space alone
    k = min(size, len(words))
    return zip(*(words[i:] for i in range(k)), strict=False)


def mixed(x: np.ndarray) -> np.ndarray:
    """A well-spread permutation of unsigned 64-bit numbers."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def hashes(text: str) -> np.ndarray:
    """The distinct shingles of a text as unsigned 64-bit hashes."""
    from xxhash import xxh64_intdigest

    return np.array(list({xxh64_intdigest(b" ".join(s), 0) for s in shingles(text)}), dtype=np.uint64)


def parity(h: np.ndarray, lanes: int) -> np.ndarray:
    """Bitmap of ``lanes`` 64-bit words in which each shingle has flipped one bit; ``lanes`` is a power of two."""
    flips = np.bincount((mixed(h) & np.uint64(64 * lanes - 1)).astype(np.int64), minlength=64 * lanes) & 1
    return np.packbits(flips.astype(np.uint8), bitorder="little").view("<i8")


def lanes_of(n: int) -> int:
    """Words of a bitmap with at least a bit for every shingle."""
    return max(LANES, 1 << (n // 64).bit_length())


def differences(a: int, b: int, percent: int = PERCENT) -> int:
    """How many shingles linked sets of ``a`` and ``b`` elements can differ in."""
    return (100 - percent) * (a + b) // (100 + percent)


def bands(longest: int) -> list[tuple[int, int]]:
    """Sizes from 1 to ``longest`` in ranges of a ratio of about 1.5."""
    out, low = [], 1
    while low <= longest:
        out.append((low, max(low, low * 3 // 2 - (low % 2 == 0) * (low > 2))))
        low = out[-1][1] + 1
    return out


@dataclass(frozen=True)
class Cut:
    """How a band is cut: ``segments``, of which the first ``double`` have allowance 2, and the reserve for empty subsets."""

    low: int
    segments: int
    double: int
    reserve: int


def reserve_for(low: int, segments: int, double: int, share: float) -> int:
    """Allowances such that sets lack more of them with a probability of ``share`` at most (Poisson tail)."""
    if segments == 1:
        return 0
    mean = low / segments
    lost = (segments - double) * math.exp(-mean) + 2 * double * (1 + mean) * math.exp(-mean)
    if lost > 500.0:  # beyond the range of exp; such a cut lacks more than it could ever reserve
        return 2 * segments
    term, kept, k = math.exp(-lost), math.exp(-lost), 0
    while 1 - kept > share:
        k += 1
        term *= lost / k
        kept += term
    return k


def cuts_of(low: int, need: int, share: float) -> Iterator[tuple[float, Cut]]:
    """Cuts whose allowances reach ``need`` and their reserve, with their costs."""
    # Few doubled segments pay in long sets, where the deletions outnumber the segments saved.
    for double in range(need + 1 if need <= 64 else 1):
        for single in range(max(0, need - 2 * double), low - double + 1):
            segments = single + double
            reserve = reserve_for(low, segments, double, share)
            if single + 2 * double >= need + reserve:
                mean = low / segments
                yield single * (1 + SPARSE * math.exp(-mean)) + double * (1 + mean) * (1 + SPARSE * math.exp(1 - mean)), Cut(low, segments, double, reserve)
                break


def allocate(low: int, high: int, sets: int, percent: int = PERCENT) -> Cut:
    """The cheapest cut of a band by keys for a set, sparse subsets weighing more.

    Where no cut keeps the sets that index empty subsets at ``THIN``, more of them are put up with.
    """
    need, share = differences(high, high, percent) + 1, min(1.0, THIN / max(sets, 1))
    if need == 1:
        return Cut(low, 1, 0, 0)
    while True:
        found = min(cuts_of(low, need, share), key=lambda c: c[0], default=None)
        if found or share >= 1.0:
            return found[1] if found else Cut(low, need, 0, 0)
        share = min(1.0, share * 4)


def keys(h: np.ndarray, cut: Cut) -> np.ndarray:
    """The index keys of one set in one band."""
    salt = np.uint64(cut.low * 0x1000193 % (1 << 61))
    segment = (mixed(h + salt) % np.uint64(cut.segments)).astype(np.int64)
    part, count = mixed(h), np.bincount(segment, minlength=cut.segments)
    total = np.zeros(cut.segments, dtype=np.uint64)
    np.add.at(total, segment, part)
    allowance = np.where(np.arange(cut.segments) < cut.double, 2, 1)
    thin = int(allowance[count < allowance].sum()) > cut.reserve
    place = mixed(np.arange(1, cut.segments + 1, dtype=np.uint64) + (salt << np.uint64(20)))
    whole = (total + place)[(count > 0) | thin]
    doubled = segment < cut.double
    less = (total[segment] - part + place[segment])[doubled & ((count[segment] > 1) | thin)]
    return np.unique(mixed(np.concatenate([whole, less])))


def keys_of_set(h: np.ndarray, edges: list[tuple[int, int]], cuts: list[Cut], percent: int = PERCENT) -> np.ndarray:
    """Keys in the set's own band and, as the smaller one of a pair, in the next."""
    own = next(k for k, (low, high) in enumerate(edges) if low <= len(h) <= high)
    out = [keys(h, cuts[own])]
    if own + 1 < len(edges) and 100 * len(h) >= percent * edges[own + 1][0]:
        out.append(keys(h, cuts[own + 1]))
    return np.concatenate(out)


def measured(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    names = ["n", "s1", "s2", "bits", "wide"]
    for texts in batches:
        rows = []
        for text in texts:
            h = hashes(text)
            wide = parity(h, lanes_of(len(h))).tolist() if lanes_of(len(h)) > LANES else None
            rows.append((len(h), *(int(mixed(x).sum(dtype=np.uint64).view(np.int64)) for x in (h, ~h)), parity(h, LANES).tolist(), wide))
        yield pd.DataFrame(rows, columns=names)


def bucket_rows(edges: list[tuple[int, int]], cuts: list[Cut]):
    """mapInArrow function: (at, text) to (key, bucket, id, hub), equal keys of a batch already met.

    The first set with a key travels under it (bucket 0; hub: itself if others follow, else -1); the others travel
    under a key of their own, with the bucket's key and the first set as their hub.
    """
    names = ["key", "bucket", "id", "hub"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, found = batch.column("at").to_numpy(), []
            owners = []
            for i, text in enumerate(batch.column("text")):
                h = hashes(text.as_py())
                if len(h):
                    found.append(keys_of_set(h, edges, cuts))
                    owners.append(np.full(len(found[-1]), ids[i]))
            if not found:
                continue
            key, owner = np.concatenate(found).view(np.int64), np.concatenate(owners)
            order = np.lexsort((owner, key))
            key, owner = key[order], owner[order]
            head = np.append(True, key[1:] != key[:-1])
            starts = np.flatnonzero(head)
            hub = np.repeat(owner[starts], np.diff(np.append(starts, len(key))))
            followed = np.append(~head[1:], False)
            own = mixed((key ^ owner).view(np.uint64) + np.uint64(1)).view(np.int64)
            columns = [np.where(head, key, own), np.where(head, 0, key), owner, np.where(head & ~followed, -1, hub)]
            for at in range(0, len(key), PART):
                yield pa.RecordBatch.from_arrays([pa.array(c[at : at + PART]) for c in columns], names)

    return run


def linked(x: str, y: str, percent: int = PERCENT) -> bool:
    a, b = set(shingles(x)), set(shingles(y))
    same = len(a & b)
    return 100 * same >= percent * (len(a) + len(b) - same)


def verified(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    text, known = None, frozenset()  # pairs come in the order of their second text
    for xs, ys in batches:
        out = []
        for x, y in zip(xs, ys, strict=True):
            if y != text:
                text, known = y, frozenset(shingles(y))
            a = set(shingles(x))
            same = len(a & known)
            out.append(100 * same >= PERCENT * (len(a) + len(known) - same))
        yield pd.Series(out, dtype=bool)


def most_apart(x: Column, y: Column) -> Column:
    return F.floor((100 - PERCENT) * (x["n"] + y["n"]) / (100 + PERCENT))


def plausible(a: str, b: str) -> Column:
    """Length bound and parity bound of two sets, as structs (n, bits)."""
    x, y = F.col(a), F.col(b)
    apart = sum((F.bit_count(x["bits"][i].bitwiseXOR(y["bits"][i])) for i in range(LANES)), F.lit(0))
    return (100 * F.least(x["n"], y["n"]) >= PERCENT * F.greatest(x["n"], y["n"])) & (apart <= most_apart(x, y))


def plausible_wide(a: str, b: str) -> Column:
    """Parity bound of two sets too long for the short bitmap, as structs (n, wide); the longer bitmap is folded onto the other."""
    x, y = F.col(a), F.col(b)
    lanes = F.least(F.size(x["wide"]), F.size(y["wide"]))

    def folded(bits: Column) -> Column:
        halves = F.zip_with(F.slice(bits, 1, lanes), F.slice(bits, lanes + 1, lanes), lambda p, q: p.bitwiseXOR(q))
        return F.when(F.size(bits) > lanes, halves).otherwise(bits)

    apart = F.aggregate(F.zip_with(folded(x["wide"]), folded(y["wide"]), lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda s, k: s + k)
    return F.coalesce(apart <= most_apart(x, y), F.lit(True))


def true_links(pairs: DataFrame, classes: DataFrame, rows: DataFrame, label: str) -> DataFrame:
    """Those of ``pairs(a, b)`` that link by the texts at their addresses."""
    pairs = written(pairs, f"{label}-plausible")
    marks = classes.where("wide is not null").select("id", F.struct("n", "wide").alias("set"))
    x, y = (marks.select(F.col("id").alias(side), F.col("set").alias(name)) for side, name in (("a", "x"), ("b", "y")))
    pairs = written(pairs.join(x, "a", "left").join(y, "b", "left").where(plausible_wide("x", "y")).select("a", "b"), f"{label}-candidates")
    wanted = pairs.select(F.col("a").alias("at")).union(pairs.select("b")).distinct()
    texts = rows_by_mark(rows, wanted, f"{label}-wanted", marked=True).select("at", F.coalesce(F.col("row.text").cast("string"), F.lit("")).alias("text"))
    met = pairs.join(texts.select(F.col("at").alias("a"), F.col("text").alias("x")), "a").join(texts.select(F.col("at").alias("b"), F.col("text").alias("y")), "b")
    return written(met.where(F.pandas_udf(verified, "boolean")("x", "y")).select("a", "b"), f"{label}-links")


def set_links(rows: DataFrame, classes: DataFrame) -> DataFrame:
    """(id, root) of all classes that link with others, but the roots; ``classes``: id, n, bits, wide."""
    sized = classes.groupBy("n").count().collect()  # one row for each set size
    edges = bands(max((r["n"] for r in sized), default=0))
    held = [sum(r["count"] for r in sized if low <= r["n"] <= high) for low, high in edges]
    cuts = [allocate(low, high, n + (held[k - 1] if k else 0)) for k, ((low, high), n) in enumerate(zip(edges, held, strict=True))]
    marks = classes.select("id", F.struct("n", "bits").alias("set"))
    given = rows_by_mark(rows, classes.select(F.col("id").alias("at")), "sets-classes", marked=True).select("at", F.coalesce(F.col("row.text").cast("string"), F.lit("")).alias("text"))
    sent = given.mapInArrow(bucket_rows(edges, cuts), "key long, bucket long, id long, hub long")
    here = Window.partitionBy("key")
    shared = (F.col("hub") >= 0) | (F.count(F.lit(1)).over(here) > 1)
    hub = F.when(F.col("bucket") == 0, F.min("id").over(here)).otherwise(F.col("hub"))
    members = sent.select(F.when(F.col("bucket") == 0, F.col("key")).otherwise(F.col("bucket")).alias("bucket"), "id", hub.alias("hub"), shared.alias("shared"))
    members = written(members.where("shared").drop("shared"), "sets-members")

    def between(pairs: DataFrame) -> DataFrame:
        with_sets = pairs.join(marks.select(F.col("id").alias("a"), F.col("set").alias("x")), "a").join(marks.select(F.col("id").alias("b"), F.col("set").alias("y")), "b")
        return with_sets.where(plausible("x", "y")).select("a", "b")

    stars = members.where("id <> hub").select(F.col("id").alias("a"), F.col("hub").alias("b")).distinct()
    links = true_links(between(stars), classes, rows, "sets-star")
    roots = components(links, "sets-first").withColumnsRenamed({"node": "id"})

    def open_members(roots: DataFrame) -> DataFrame:
        """(bucket, id, root, main) of the buckets whose members are in different components; ``main``: the largest of them."""
        placed = members.select("bucket", "id").distinct().join(roots, "id", "left").select("bucket", "id", F.coalesce("root", "id").alias("root"))
        per_root = placed.groupBy("bucket", "root").count()
        several = per_root.groupBy("bucket").agg(F.max_by("root", F.struct("count", "root")).alias("main"), F.count(F.lit(1)).alias("roots")).where("roots > 1")
        return written(placed.join(several.select("bucket", "main"), "bucket"), "sets-open")

    # Members outside the largest component first meet a few of its members: one link is enough to join it.
    met = open_members(roots)
    seats = F.array_distinct(F.array(*[F.min_by("id", F.xxhash64("id", F.lit(k))) for k in range(SEATS)]))
    hubs = met.where("root = main").groupBy("bucket").agg(seats.alias("seats")).select("bucket", F.explode("seats").alias("b"))
    tried = met.where("root <> main").select("bucket", F.col("id").alias("a")).join(hubs, "bucket").select("a", "b").distinct()
    links = links.union(true_links(between(tried), classes, rows, "sets-seats"))
    met = open_members(components(links, "sets-second").withColumnsRenamed({"node": "id"})).join(marks, "id")
    outside = met.where("root <> main").select("bucket", F.col("id").alias("a"), F.col("root").alias("ra"), F.col("set").alias("x"))
    others = met.select("bucket", F.col("id").alias("b"), F.col("root").alias("rb"), F.col("set").alias("y"), (F.col("root") == F.col("main")).alias("inside"))
    crossing = outside.join(others, "bucket").where((F.col("ra") != F.col("rb")) & (F.col("inside") | (F.col("a") > F.col("b"))) & plausible("x", "y"))
    known = stars.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))  # stars have been verified
    new = crossing.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct().join(known, ["a", "b"], "left_anti")
    return components(links.union(true_links(new, classes, rows, "sets-rest")), "sets-links").withColumnsRenamed({"node": "id"})


def set_groups(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles and component_id for every row of ``docs``."""
    rows = addressed(docs, "sets-docs")
    text = F.coalesce(F.col("row.text").cast("string"), F.lit(""))
    measure = F.pandas_udf(measured, "n long, s1 long, s2 long, bits array<long>, wide array<long>")
    sets = written(rows.select("at", F.col("row.doc_id").cast("long").alias("doc_id"), measure(text).alias("m")).select("at", "doc_id", "m.*"), "sets-rows")
    whole = ["n", "s1", "s2"]
    first = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id"))
    classes = sets.where("n > 0").groupBy(*whole).agg(F.min("at").alias("id"), first.alias("least"), F.min_by(F.struct("bits", "wide"), "at").alias("marks"))
    classes = written(classes.select(*whole, "id", "least", "marks.*"), "sets-known")
    roots = written(set_links(rows, classes.select("id", "n", "bits", "wide")), "sets-roots")
    # Classes without links answer themselves.
    root_of = classes.join(roots, "id", "left").withColumn("root", F.coalesce("root", "id"))
    best = root_of.groupBy("root").agg(F.min("least").alias("best"))
    answers = root_of.join(best, "root").select(*whole, F.col("best.doc_id").alias("best"))
    found = sets.where("n > 0").select("doc_id", *whole).join(answers, whole).select("doc_id", F.col("n").alias("n_shingles"), F.col("best").alias("component_id"))
    return found.unionByName(sets.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))
