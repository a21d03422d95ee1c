"""Set join, fill-in-middle and conversation repair against brute force; row addresses."""

import hashlib
import heapq
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from tickloom.llm import common, decontaminate, exact_dedup, fim, repair, setjoin, simhash

from . import brute
from .test_operators import AWKWARD, DOC, documents, empty, prose

# --- n-gram Jaccard join ---------------------------------------------------


def jaccard_groups(docs):
    sets = []
    for _, t in docs:
        words = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(brute.LOWER))
        sets.append({tuple(words[i : i + 4]) for i in range(max(1, len(words) - 3))} if words else set())
    groups = brute.Groups(len(docs))
    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= 85 * len(a | sets[j]):
                groups.join(i, j)
    least = {}
    for i, (doc, _) in enumerate(docs):
        least.setdefault(groups.find(i), []).append(doc)
    return sorted((doc, len(sets[i]), min(least[groups.find(i)])) for i, (doc, _) in enumerate(docs))


def edited(rng, words, edits):
    words = list(words)
    for _ in range(edits):
        words[rng.randrange(len(words))] = rng.choice("new other words here".split()) + str(rng.randrange(99))
    return " ".join(words)


def collection(rng):
    texts = [*AWKWARD, "one two three", "One  two\tthree", "one two three four", "a b c d e"]
    for n in (5, 7, 9, 12, 20, 40, 80, 150, 400):
        base = prose(rng, n).split()
        texts += [" ".join(base), " ".join(base).upper()]
        # around the limit, from one word changed to clearly too many
        texts += [edited(rng, base, k) for k in (1, 1, 1 + n // 60, 2 + n // 40, 3 + n // 20, n // 5)]
        texts += [" ".join(base[k:]) for k in (1, 1 + n // 20)] + [" ".join(base + base[: n // 10])]
    # one family: all share a base, some near each other, many not
    base = prose(rng, 120).split()
    texts += [edited(rng, base, rng.randrange(1, 7)) for _ in range(40)]
    # a passage that many unlike texts share
    texts += [prose(rng, 30) + " " + " ".join(base[:60]) + " " + prose(rng, 30) for _ in range(12)]
    return texts


@pytest.mark.parametrize("partitions", [1, 7])
def test_set_join_against_brute_force(spark, partitions):
    texts = collection(random.Random(21))
    df = documents(spark, texts).repartition(partitions)
    got = sorted(tuple(r) for r in setjoin.set_groups(df).collect())
    assert got == jaccard_groups(list(enumerate(texts)))
    assert len({r[2] for r in got}) < len(texts) - 40


def test_set_join_of_empty_null_and_repeated_rows(spark):
    assert setjoin.set_groups(empty(spark)).count() == 0
    assert [tuple(r) for r in setjoin.set_groups(documents(spark, [None])).collect()] == [(0, 0, 0)]
    rows = [(None, "a b c d e"), (None, "a b c d e"), (7, "a b c d e"), (7, "a b c d e"), (None, ""), (3, None), (None, "x y z")]
    df = spark.createDataFrame([(i, t, None, None, None) for i, t in rows], DOC)
    got = sorted((tuple(r) for r in setjoin.set_groups(df).collect()), key=repr)
    assert got == sorted([(None, 2, 7), (None, 2, 7), (7, 2, 7), (7, 2, 7), (None, 0, None), (3, 0, 3), (None, 1, None)], key=repr)


@pytest.mark.parametrize("sets", [1, 40_000, 10**9])
def test_allowances_exceed_the_differences_and_the_reserve(sets):
    before = 0
    for low, high in setjoin.bands(25_000):
        assert low == before + 1 and high >= low
        cut = setjoin.allocate(low, high, sets)
        assert cut.segments + cut.double > setjoin.differences(high, high) + cut.reserve
        before = high


@pytest.mark.parametrize("sets", [100, 10**9])
def test_linked_sets_always_share_a_key(sets):
    import numpy as np

    rng, draw = random.Random(8), np.random.default_rng(8)
    edges = setjoin.bands(400)
    cuts = [setjoin.allocate(low, high, sets) for low, high in edges]
    for _ in range(1500):
        n = rng.choice([*range(1, 30), rng.randrange(30, 320)])
        a = draw.integers(0, 2**63, n).astype(np.uint64)
        gone = rng.randrange(0, min(n - 1, setjoin.differences(n, n)) + 1)
        more = rng.randrange(0, setjoin.differences(n, n) + 1)
        if 100 * (n - gone) < 85 * (n + more):
            continue
        b = np.concatenate([a[gone:], draw.integers(0, 2**63, more).astype(np.uint64)])
        assert len(np.intersect1d(setjoin.keys_of_set(a, edges, cuts), setjoin.keys_of_set(b, edges, cuts)))


def test_bitmaps_fold_and_bound_the_differences(spark):
    import numpy as np

    draw = np.random.default_rng(3)
    h = draw.integers(0, 2**63, 3000).astype(np.uint64)
    wide, half = setjoin.parity(h, 64), setjoin.parity(h, 32)
    assert ((wide[:32] ^ wide[32:]) == half).all()
    other = np.concatenate([h[40:], draw.integers(0, 2**63, 25).astype(np.uint64)])
    apart = int(np.bitwise_count(setjoin.parity(h, 64) ^ setjoin.parity(other, 64)).sum())
    assert 0 < apart <= 65
    sides = [(3000, wide.tolist()), (2985, setjoin.parity(other, 32).tolist())]
    row = spark.createDataFrame([tuple(sides)], "x struct<n:long,wide:array<long>>, y struct<n:long,wide:array<long>>")
    assert row.select(setjoin.plausible_wide("x", "y")).first()[0] is True
    far = setjoin.parity(draw.integers(0, 2**63, 2900).astype(np.uint64), 64).tolist()
    row = spark.createDataFrame([((3000, wide.tolist()), (2900, far))], row.schema)
    assert row.select(setjoin.plausible_wide("x", "y")).first()[0] is False


# --- fill in the middle ----------------------------------------------------


def plain_fim(doc, text):
    text = text or ""
    tokens = re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", text)
    h = hashlib.sha256(f"42:{'' if doc is None else doc}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[k : k + 8], 16) for k in (0, 8, 16, 24))
    n = len(tokens)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    prefix, middle, suffix = ("".join(tokens[i:j]) for i, j in ((0, a), (a, b), (b, n)))
    form, lengths, out = "plain", (None, None), text
    if text and not any(s in text for s in ("<P>", "<S>", "<M>")) and h3 % 100 < 50:
        form, lengths = "spm" if h4 % 100 < 80 else "psm", (len(prefix), len(middle))
        out = f"<S>{suffix}<P>{prefix}<M>{middle}" if form == "spm" else f"<P>{prefix}<S>{suffix}<M>{middle}"
    return (doc, n, form, *lengths, out)


def test_fill_in_middle_against_plain_strings(spark):
    rng = random.Random(5)
    texts = [*AWKWARD, "<", "<S", "ends with <", "a <P> inside", "<M>", "\n\n", "tail \n", "  lead", "x" * 70_000 + " y"]
    texts += [prose(rng, rng.randrange(1, 60)) for _ in range(120)] + ["𝒳 𝒴𝒵 ünï <S P>" * 9] * 12
    got = fim.fill_in_middle(documents(spark, texts)).select("*", fim.output().alias("output")).collect()
    assert len(got) == len(texts) and {r["form"] for r in got} == {"plain", "psm", "spm"}
    for r in got:
        want = plain_fim(r["doc_id"], texts[r["doc_id"]])
        assert (r["doc_id"], r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]) == want
        assert r["output_sha256"] == hashlib.sha256(want[-1].encode()).hexdigest()
        assert r["restored_sha256"] == hashlib.sha256((texts[r["doc_id"]] or "").encode()).hexdigest()


def test_fill_in_middle_of_null_ids_repeats_and_nothing(spark):
    assert fim.fill_in_middle(empty(spark)).count() == 0
    df = spark.createDataFrame([(None, "one two three", None, None, None)] * 2 + [(None, None, None, None, None)], DOC)
    rows = fim.fill_in_middle(df).select("doc_id", "n", "form", "prefix_chars", "middle_chars", fim.output().alias("o")).collect()
    assert sorted(map(tuple, rows), key=repr) == sorted([plain_fim(None, t) for t in ("one two three", "one two three", None)], key=repr)


def test_pieces_are_never_text():
    table = fim.parts_of([fim.Piece(fim.TEXT, 0, 10)], (4, 7))
    assert table == [[(0, 0, 4)], [(0, 4, 3)], [(0, 7, 3)]]
    assert fim.arrange(table, "spm") == [(1, 3, 3), (0, 7, 3), (1, 0, 3), (0, 0, 4), (1, 6, 3), (0, 4, 3)]
    assert fim.restore("<S>ghi<P>abcd<M>ef", "spm") == [(0, 9, 4), (0, 16, 2), (0, 3, 3)]


# --- conversation repair ---------------------------------------------------


def dijkstra(initials, faults, start=repair.START, goals=repair.ACCEPTS, last=True):
    heap, seen = [(0, "", 0, start)], set()
    while heap:
        cost, audit, i, state = heapq.heappop(heap)
        if i == len(initials) and state in goals:
            return cost, audit
        if (i, state) not in seen:
            seen.add((i, state))
            for letter, more, j, then in repair.edits(i, state, initials, faults, last):
                heapq.heappush(heap, (cost + more, audit + letter, j, then))


def random_turns(rng, n):
    return "".join(rng.choice("suuuaaax-") for _ in range(n)), "".join(rng.choice("bdt-----") for _ in range(n))


def test_search_finds_the_least_audit():
    rng = random.Random(1)
    for _ in range(800):
        turns = random_turns(rng, rng.randrange(0, 14))
        assert repair.search(*turns) == dijkstra(*turns)


def test_blocks_join_to_the_least_audit():
    rng = random.Random(2)
    for _ in range(150):
        n, size = rng.randrange(5, 22), rng.randrange(2, 6)
        initials, faults = random_turns(rng, n)
        cuts = range(0, n, size)
        tables = [{r[:2]: r[2:] for r in repair.block_table(initials[c : c + size], faults[c : c + size], c == 0, c + size >= n)} for c in cuts]
        assert repair.compose(tables) == dijkstra(initials, faults)
        for c in cuts:
            part = initials[c : c + size], faults[c : c + size]
            for start, end, cost, audit in repair.block_table(*part, False, False):
                assert (cost, audit) == dijkstra(*part, start, (end,), False)


def plain_repair(rows):
    """conv_id -> result columns; rows of (conv_id, turn, role, text)"""
    out, convs = {}, {}
    for conv, turn, role, text in rows:
        convs.setdefault(conv, [])
        name = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        kind, role, text = zlib.crc32(name.encode()) % 20, " " if role is None else role, " " if text is None else text
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        convs[conv] += [] if kind == 0 else [(turn is not None, turn or 0, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    for conv, turns in convs.items():
        turns.sort()
        initials, faults, seen = "".join(t[2][:1] or "-" for t in turns), "", set()
        for _, _, role, text in turns:
            body = text.strip(" \t\n\x0b\x0c\r")
            faults += "b" if not body else "d" if (role, text) in seen else "t" if body[-1] not in ".!?" else "-"
            seen.add((role, text))
        numbers = [t[1] for t in turns if t[0]]
        cost, audit = dijkstra(initials, faults)
        lines, k, state = [], 0, repair.START
        for op in audit:
            if op != "D":
                initial = initials[k] if op == "K" else repair.WANTED[state]
                state = repair.NEXT[state][initial]
                role = turns[k][2] if op == "K" else {"u": "user", "a": "assistant"}[initial]
                lines.append(f"{role}:{'' if op == 'I' else turns[k][3]}")
            k += op != "I"
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))
        gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
        digest = hashlib.sha256("\n".join(lines).encode()).hexdigest()
        out[conv] = (gaps, *(faults.count(f) for f in "bdt"), illegal, cost, audit, digest)
    return out


TURNS = "conv_id long, turn long, role string, text string, position int, fault string, conv string, ops string"


def test_repair_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(repair, "BLOCK", 8)
    rng = random.Random(6)
    rows = []
    for conv in [*range(120), None]:
        for turn in range(rng.choice([1, 2, 4, 6, 30]) if conv != 7 else 90):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None]) if rng.random() < 0.3 else ("user", "assistant")[turn % 2]
            text = rng.choice(["Fine.", "no end", "", " \t", None, "What?", "Ünï!", "a\nb.", "x" * 5000 + "."])
            rows.append((conv, None if rng.random() < 0.03 else turn, role, text))
    rows += rows[:25]
    df = spark.createDataFrame([(*r, 1, "b", "c", "K") for r in rows], TURNS)
    got = {r["conv_id"]: tuple(r)[1:] for r in repair.repaired(df.repartition(5)).collect()}
    assert got == plain_repair(rows)
    assert repair.repaired(df.limit(0)).count() == 0


# --- row addresses ---------------------------------------------------------


def test_rows_by_mark_in_slices(spark):
    df = common.written(spark.range(2000).withColumn("text", F.col("id").cast("string")).repartition(7), "test-rows")
    rows = common.addressed(df, "test")
    marks = common.written(rows.where("row.id % 3 = 0").select("at"), "test-marks")
    for masks in (10**6, 9, 1):
        kept = common.rows_by_mark(rows, marks, "test-kept", True, masks).select("row.*")
        gone = common.rows_by_mark(rows, marks, "test-gone", False, masks).select("row.*")
        assert sorted(r["id"] for r in kept.collect()) == list(range(0, 2000, 3))
        assert sorted(r["id"] for r in gone.collect()) == [i for i in range(2000) if i % 3]
    assert rows.select("at").distinct().count() == 2000


HELPERS = "at file row block mask key mark _id _known _mark _order _metadata number place text_sha256 digest fp best node keep n_hit".split()


@pytest.mark.parametrize("name", ["exact", "near", "contaminated"])
def test_stages_keep_columns_of_any_name(spark, name):
    rng = random.Random(3)
    a, b = prose(rng, 60), prose(rng, 60)
    base = spark.createDataFrame([(1, a), (2, a), (3, b), (None, b), (5, "x")], "doc_id long, text string")
    df = base.select("*", *[F.concat(F.lit(f"{h}-"), F.coalesce("doc_id", F.lit(0)).cast("string")).alias(h) for h in HELPERS], F.lit(1).alias("a.b"))
    bench = spark.createDataFrame([(1, a)], "item_id long, text string")
    drop = {"exact": exact_dedup.drop_exact, "near": simhash.drop_near, "contaminated": lambda d: decontaminate.drop_contaminated(d, bench)}[name]
    out = drop(df)
    assert out.columns == df.columns
    rows = out.collect()
    assert sorted(r["doc_id"] or 0 for r in rows) == ([1, 3, 5] if name != "contaminated" else [0, 3, 5])
    assert all(r[h] == f"{h}-{r['doc_id'] or 0}" for r in rows for h in HELPERS)


# --- line dedup: one kept line for each component --------------------------


def test_one_line_of_a_component_is_kept_whatever_the_ids(spark):
    from tickloom.llm import lines

    rng = random.Random(17)
    a, b, c = (prose(rng, 12) for _ in range(3))
    rows = [(None, a), (None, a), (1, b), (1, b), (7, c), (7, c + "."), (None, "alone here")]
    df = spark.createDataFrame([(i, t, None, None, None) for i, t in rows], DOC).repartition(3)
    got = lines.line_groups(df).collect()
    assert len(got) == 7 and sum(r["kept"] for r in got) == 4
    assert sorted(r["group_lines"] for r in got if r["kept"]) == [1, 2, 2, 2]
