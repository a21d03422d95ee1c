"""Fuzzy line dedup by MinHash, with exact verification and distributed union-find.

Lines are the pieces of a text between line feeds, less ASCII white space at their ends;
blank lines are not rows of the result.  Equal lines form a class.  A line is the set of its
runs of ``SHINGLE`` characters (UTF-16 units; shorter lines are one run), and two lines are
near when the Jaccard similarity of their sets is ``similarity`` or more.

* Signature: each shingle is hashed once; the hashes are cut into ``BANDS`` x ``ROWS`` equal ranges, and a
  range's minimum is the smallest hash of the line from its lower edge on, so an empty range takes
  that of the next filled one.  All of it happens inside the row, so no minima are shuffled.
* Bands of ``ROWS`` minima are the buckets: with 8 x 3, a pair at 0.8 shares one with 99.7 %.
* Profile: a line's number of shingles and a bitmap of them, which bound the overlap of two lines from above.  Texts
  meet only for pairs that the bound leaves open; what links is the exact Jaccard similarity.
* Star: every member of a bucket meets its hub.  Members that this leaves in different components then meet
  each other; in large buckets the profiles of those outside the bucket's largest component meet
  all others, in blocks of lines.  Of the pairs left open, the closest by profile are verified first, then
  those that this has not joined.  No link of a bucket is lost; such a bucket costs its members times
  those outside.
* Only texts of lines in a bucket are fetched; a broadcast sieve of their digests keeps most others
  from being shuffled, an exact join follows.
* Links are joined by distributed union-find; of each component the first line (smallest
  doc_id, then line number, then the earlier row) stays, one line whatever the ids.

Cases: null and empty texts have no lines; null doc_ids come after all others; repeated rows
have lines of their own; an empty table gives no rows; columns beyond doc_id and text are
ignored.
"""

from __future__ import annotations

from functools import reduce
from operator import add, or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import MASK_BITS, MASKS, text_or_empty, written
from .components import components

SHINGLE, BANDS, ROWS = 8, 8, 3
BINS = BANDS * ROWS
STEP = 2**64 // BINS  # a range of hashes; range k begins at (k - BINS / 2) * STEP
SMALL, BLOCK = 64, 256  # buckets of more members than SMALL are compared in blocks of about BLOCK
TURNS = 2  # in which each line meets its nearest candidate before all pairs that are still apart
WORDS, FOLDED = 64, 16  # of 64 bits, in a line's bitmap and in its coarse form
SIEVE_BITS = 16  # bits for each digest that is looked for: about 6 % of the other lines pass
BLANK = " \t\x0b\x0c\r"


def occurrences(docs: DataFrame) -> DataFrame:
    """(doc_id, row, line_no, line) of all lines that are not blank; ``row`` numbers the rows of ``docs``."""
    numbered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("row"), text_or_empty().alias("text"))
    pieces = numbered.select("doc_id", "row", F.posexplode_outer(F.split("text", "\n")).alias("line_no", "line"))
    # Trimming walks through the whole line, so only lines with white space at an end are trimmed.
    padded = reduce(or_, [F.startswith("line", F.lit(c)) | F.endswith("line", F.lit(c)) for c in BLANK])
    return pieces.withColumn("line", F.when(padded, F.trim("line", F.lit(BLANK))).otherwise(F.col("line"))).where("line <> ''")


def digest(line: Column) -> Column:
    return F.unhex(F.md5(line.cast("binary")))


def shingle_hashes(line: Column) -> Column:
    """Hashes of a line's shingles, repeats included; the outer lambda holds the units, so that no position copies them."""
    units = F.array(F.encode(line, "UTF-16BE"))
    places = lambda u: F.sequence(F.lit(1), F.greatest(F.lit(1), F.octet_length(u) - (2 * SHINGLE - 1)), F.lit(2))
    return F.transform(units, lambda u: F.transform(places(u), lambda i: F.xxhash64(F.substring(u, i, F.lit(2 * SHINGLE)))))[0]


def shingle_set(line: Column) -> Column:
    return F.array_distinct(shingle_hashes(line))


def distance(x: Column, y: Column) -> Column:
    """The Jaccard distance of two sets."""
    same = F.size(F.array_intersect(x, y))
    return 1.0 - same / (F.size(x) + F.size(y) - same)


def signatures(found: DataFrame) -> DataFrame:
    """(digest, band, minima): the smallest hash in each of a band's ranges, empty ranges taking that of the next filled one."""
    hashed = found.select(digest(F.col("line")).alias("digest"), shingle_hashes(F.col("line")).alias("h"))
    edge = lambda k: (k - BINS // 2) * STEP
    laid = hashed.select("digest", "h", F.sort_array(F.concat("h", F.array(*[F.lit(edge(k)) for k in range(BINS)]))).alias("y"))
    laid = laid.select("digest", "h", "y", F.explode(F.array(*[F.lit(band) for band in range(BANDS)])).alias("band"))

    def least(k: Column) -> Column:
        """What follows the lower edge of range k.  After another edge or the end, it is sought among the hashes alone."""
        place = F.array_position("y", edge(k)).cast("int")
        after = F.get("y", place)
        hashes = F.sort_array("h")  # the edge has as many of them before it as its place less the earlier edges
        sought = F.coalesce(F.get(hashes, place - k.cast("int") - 1), F.get(hashes, F.lit(0)))
        return F.when(after < edge(k + 1), after).otherwise(sought)

    ranges = [F.col("band").cast("long") + BANDS * row for row in range(ROWS)]
    return laid.select("digest", "band", F.array(*[least(k) for k in ranges]).alias("minima"))


def buckets(found: DataFrame) -> DataFrame:
    """(bucket, digest) of all buckets with two or more different lines."""
    members = signatures(found).select("digest", F.xxhash64("band", "minima").alias("bucket")).distinct()
    return members.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("bucket"))).where("n > 1").select("bucket", "digest")


def sieved(rows: DataFrame, wanted: DataFrame, masks: int = MASKS) -> DataFrame:
    """The rows whose digest is in ``wanted(digest)``, and some others, before anything is shuffled.

    The digests set bits in at most ``masks`` masks of 64, which are broadcast.  More digests than
    these hold let more other rows pass; none that is wanted is lost.
    """
    blocks = min(masks, max(1, wanted.count() * SIEVE_BITS >> MASK_BITS))
    place = F.pmod(F.xxhash64("digest"), F.lit(blocks << MASK_BITS))
    one = F.expr(f"shiftleft(1L, cast(place & {(1 << MASK_BITS) - 1} as int))")
    table_of = wanted.select(place.alias("place")).groupBy(F.shiftright("place", MASK_BITS).alias("block")).agg(F.bit_or(one).alias("mask"))
    met = rows.withColumn("place", place).withColumn("block", F.shiftright("place", MASK_BITS)).join(F.broadcast(table_of), "block")
    return met.where(F.col("mask").bitwiseAND(one) != 0).select(rows.columns)


def profiles(texts: DataFrame) -> DataFrame:
    """(id, n, bits, coarse): the number of shingles of each of texts(id, line), repeats included, and bitmaps of their hashes as words of 64."""
    units = texts.select("id", F.encode("line", "UTF-16BE").alias("units"))
    units = units.select("id", "units", F.greatest(F.lit(1), F.shiftright(F.octet_length("units"), 1) - (SHINGLE - 1)).alias("n"))
    each = units.select("id", "units", "n", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("i"))
    each = each.select("id", "n", F.xxhash64(F.substring("units", F.shiftleft("i", 1) + 1, F.lit(2 * SHINGLE))).alias("h"))
    word, bit = F.pmod("h", F.lit(WORDS)).cast("int"), F.expr("shiftleft(1L, cast(shiftrightunsigned(h, 8) & 63 as int))")
    each = each.select("id", "n", F.pmod(word, F.lit(FOLDED)).alias("place"), F.floor(word / FOLDED).cast("int").alias("fold"), bit.alias("bit"))
    words = [F.coalesce(F.bit_or(F.when(F.col("place") == k, F.col("bit"))), F.lit(0).cast("long")).alias(f"w{k}") for k in range(FOLDED)]
    parts = each.groupBy("id", "fold").agg(F.max("n").alias("n"), *words).select("id", "fold", "n", F.array(*[f"w{k}" for k in range(FOLDED)]).alias("part"))
    none = F.array(*[F.lit(0).cast("long")] * FOLDED)
    folds = [f"fold{f}" for f in range(WORDS // FOLDED)]
    wide = parts.groupBy("id").agg(F.max("n").alias("n"), *[F.coalesce(F.max(F.when(F.col("fold") == f, F.col("part"))), none).alias(name) for f, name in enumerate(folds)])
    folded = [reduce(lambda a, b: a.bitwiseOR(b), [F.get(name, F.lit(k)) for name in folds]) for k in range(FOLDED)]
    return wide.select("id", "n", F.concat(*folds).alias("bits"), F.array(*folded).alias("coarse"))


def lacking(x: str, y: str) -> Column:
    """At most as many shingles as one of two lines lacks, as one differing bit stands for one or more."""
    return reduce(add, [F.bit_count(F.get(f"{x}.coarse", F.lit(k)).bitwiseXOR(F.get(f"{y}.coarse", F.lit(k)))) for k in range(FOLDED)])


def lacking_wide(x: str, y: str) -> Column:
    return F.aggregate(F.zip_with(f"{x}.bits", f"{y}.bits", lambda a, b: F.bit_count(a.bitwiseXOR(b))), F.lit(0), add)


def can_be_near(lacking: Column, x: str, y: str, similarity: float) -> Column:
    """Whether the profiles of two lines leave it open that they are near; repeats only widen the bound."""
    return lacking <= (1.0 - similarity) / (1.0 + similarity) * (F.col(f"{x}.n") + F.col(f"{y}.n")) + 1e-6


def near_links(found: DataFrame, similarity: float) -> tuple[DataFrame, DataFrame]:
    """Links (a, b) that join all near lines of the buckets into components, and the (digest, id) that they speak of."""
    members = written(buckets(found), "line-members")
    wanted = written(members.select("digest").distinct().select("digest", F.monotonically_increasing_id().alias("id")), "line-wanted")
    named = found.select(digest(F.col("line")).alias("digest"), "line")
    # An inner join on distinct digests: Spark would push a semi-join below the sieve, and shuffle every text.
    texts = sieved(named, wanted.select("digest")).join(wanted, "digest").select("id", "line").dropDuplicates(["id"])
    texts = written(texts, "line-texts")
    known = written(profiles(texts), "line-profiles")

    def near(pairs: DataFrame) -> DataFrame:
        """Those of pairs(a, b) whose exact Jaccard similarity suffices; lines travel as text, an eighth of their shingle hashes."""
        both = pairs.join(texts.select(F.col("id").alias("a"), F.col("line").alias("x")), "a").join(texts.select(F.col("id").alias("b"), F.col("line").alias("y")), "b")
        sets = both.select("a", "b", shingle_set(F.col("x")).alias("x"), shingle_set(F.col("y")).alias("y"))
        return sets.select("a", "b", distance(F.col("x"), F.col("y")).alias("d")).where(F.col("d") <= 1.0 - similarity + 1e-12).select("a", "b")

    # The star of each bucket: every member meets the hub.
    left = members.join(wanted, "digest").select("bucket", "id")
    hubs = left.groupBy("bucket").agg(F.min("id").alias("hub"), F.count(F.lit(1)).alias("members"))
    seats = written(left.join(hubs, "bucket").where("id <> hub"), "line-seats")
    profile = F.struct("id", "n", "coarse")
    stars = seats.select("hub", "id").distinct().join(known.select("id", profile.alias("x")), "id").join(known.select(F.col("id").alias("hub"), profile.alias("y")), "hub")
    stars = written(stars.where(can_be_near(lacking("x", "y"), "x", "y", similarity)).select(F.col("hub").alias("a"), F.col("id").alias("b")), "line-stars")
    links = written(near(stars), "line-spokes")
    joined = written(components(links, "line-stars"), "line-joined")
    # Hubs have met every member.  Others meet where the stars left them in different components.
    held = seats.join(joined.select(F.col("node").alias("id"), "root"), "id", "left").select("bucket", "members", "id", F.coalesce("root", "id").alias("root"))
    mixed = held.groupBy("bucket").agg((F.min("root") < F.max("root")).alias("mixed")).where("mixed").select("bucket")
    held = written(held.join(mixed, "bucket").join(known, "id"), "line-held")
    open_ = (F.col("x.root") != F.col("y.root")) & can_be_near(lacking("x", "y"), "x", "y", similarity)

    few = held.where(F.col("members") <= SMALL).select("bucket", F.struct("id", "root", "n", "coarse").alias("x"))
    pairs = few.join(few.select("bucket", F.col("x").alias("y")), "bucket").where((F.col("x.id") < F.col("y.id")) & open_)
    ends = [F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b"), lacking("x", "y").alias("lacking")]
    pairs = pairs.select(*ends)

    # In large buckets, blocks of the lines outside the largest component meet blocks of all lines.
    many = held.where(F.col("members") > SMALL)
    roots = many.groupBy("bucket", "root").agg(F.count(F.lit(1)).alias("size"))
    major = roots.groupBy("bucket").agg(F.max(F.struct("size", "root")).alias("major"), F.sum("size").alias("held"))
    blocks = lambda n: F.ceil(n / BLOCK).cast("int")
    major = major.select("bucket", F.col("major.root").alias("major"), blocks(F.col("held")).alias("blocks"), blocks(F.col("held") - F.col("major.size")).alias("outer"))
    seated = many.join(major, "bucket").withColumn("line", F.struct("id", "root", "n", "bits", "coarse")).withColumn("minor", F.col("root") != F.col("major"))
    own = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    full = seated.groupBy("bucket", own("blocks").alias("j")).agg(F.collect_list(F.struct("minor", "line")).alias("ys"))
    outer = seated.where("minor").groupBy("bucket", "blocks", own("outer").alias("i")).agg(F.collect_list("line").alias("xs"))
    outer = outer.select("bucket", "xs", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("j"))
    rows = outer.join(full, ["bucket", "j"]).select("ys", F.explode("xs").alias("x")).select("x", F.explode("ys").alias("other")).select("x", F.col("other.minor").alias("minor"), F.col("other.line").alias("y"))
    met = rows.where((~F.col("minor") | (F.col("x.id") < F.col("y.id"))) & open_)
    met = met.where(can_be_near(lacking_wide("x", "y"), "x", "y", similarity)).select(*ends)
    pairs = written(pairs.union(met).distinct(), "line-pairs")

    # Each line first meets the one that the bounds put nearest; pairs that this joins are left out.
    for turn in range(TURNS):
        nearest = [pairs.groupBy(side).agg(F.min(F.struct("lacking", "a", "b")).alias("pair")).select("pair.a", "pair.b") for side in ("a", "b")]
        links = links.union(written(near(nearest[0].union(nearest[1]).distinct()), f"line-near-{turn}"))
        joined = written(components(links, f"line-turn-{turn}"), f"line-joined-{turn}")
        root = lambda side: joined.select(F.col("node").alias(side), F.col("root").alias(f"root_{side}"))  # noqa: E731, B023
        rest = pairs.join(root("a"), "a", "left").join(root("b"), "b", "left").where(F.coalesce("root_a", "a") != F.coalesce("root_b", "b"))
        pairs = written(rest.select("a", "b", "lacking"), f"line-rest-{turn}")
    return links.union(written(near(pairs.select("a", "b")), "line-near")), wanted


def line_groups(docs: DataFrame, similarity: float = 0.8) -> DataFrame:
    """doc_id, line_no, keep_doc_id, keep_line_no, group_lines and kept for every line that is not blank."""
    found = occurrences(docs)
    place = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "line_no", "row")
    rows = written(found.select("doc_id", "row", "line_no", digest(F.col("line")).alias("digest")), "line-rows")
    classes = rows.groupBy("digest").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n"))
    classes = written(classes, "line-classes")
    links, wanted = near_links(found, similarity)
    roots = components(links, "line-links")
    # Classes without links answer themselves.
    linked = roots.union(roots.select(F.col("root").alias("node"), "root").distinct()).join(wanted, F.col("node") == F.col("id")).select("digest", "root")
    of_root = classes.join(linked, "digest").select("digest", "root", "first", "n")
    of_root = written(of_root, "line-linked")
    best = of_root.groupBy("root").agg(F.min("first").alias("best"), F.sum("n").alias("total"))
    linked = of_root.join(best, "root").select("digest", "best", "total")
    answers = written(classes.join(linked, "digest", "left").select("digest", F.coalesce("best", "first").alias("best"), F.coalesce("total", "n").alias("total")), "line-answers")
    return rows.join(answers, "digest").select(
        "doc_id",
        "line_no",
        F.col("best.doc_id").alias("keep_doc_id"),
        F.col("best.line_no").alias("keep_line_no"),
        F.col("total").alias("group_lines"),
        ((F.col("row") == F.col("best.row")) & (F.col("line_no") == F.col("best.line_no"))).alias("kept"),
    )
