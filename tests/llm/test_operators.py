import os
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tickloom.llm import chat, components, decontaminate, exact_dedup, language, lines, mixing, quality, queries, simhash, tokens, toxicity

from . import brute

DOC = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = "the and of a river stone cloud winter garden letter market yellow quiet engine paper window".split()
AWKWARD = [None, "", " \t\n\r ", "a", "word", "x" * 20000, "Ünïcödé ßtraße ÄÖ", "日本語 テキスト", "tie", "tie", "\x00\x01 <|endoftext|> \x85"]
SF = "/root/testdata/sf0.001"


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + (rng.choice(WORDS) if rng.random() < 0.5 else "") for _ in range(n))


def documents(spark, texts, langs=None, sources=None):
    rows = [(i, t, (langs or [None] * len(texts))[i], (sources or [None] * len(texts))[i], None) for i, t in enumerate(texts)]
    # columns whose names clash with those the operators use inside
    df = spark.createDataFrame(rows, DOC)
    return df.selectExpr("*", "'clash' as key", "1 as size", "2 as score", "3 as fp", "4 as digest", "5 as weight", "6 as node", "7 as _x")


def empty(spark):
    return documents(spark, ["x"]).limit(0)


def labels(spark, quality_by_id, column):
    return spark.createDataFrame([(i, v) for i, v in quality_by_id], f"doc_id long, {column} int")


def varied(rng):
    texts = list(AWKWARD)
    base = [prose(rng, 60) for _ in range(12)]
    for b in base:
        words = b.split()
        texts += [b, b.upper(), b + " end", " ".join(words[:30] + ["new"] + words[31:])]
    texts += [base[0]] * 5 + ["\n".join(base[1:4]), "\n".join(base[1:4] + [base[5] + "!"])]
    return texts


def test_lines_against_brute_force(spark):
    rng = random.Random(1)
    texts = varied(rng)
    stem = prose(rng, 40)
    texts += [stem[:k] + "#" + stem[k:] for k in range(0, 200, 7)]  # one bucket of many different near lines
    got = {(r[0], r[1]): (r[2], r[3], r[4]) for r in lines.line_groups(documents(spark, texts)).collect()}
    assert got == brute.near_lines(list(enumerate(texts)))
    assert lines.line_groups(empty(spark)).count() == 0


def test_lines_done_with_different_hubs_are_compared(spark, monkeypatch):
    """One bucket with a chain h1 - x - y - h2: in round 1 x is near the hub h1 alone and y near the hub h2 alone."""
    rng = random.Random(910)  # so that digests and hash slices make these the hubs
    words = [rng.choice(WORDS) + rng.choice(WORDS) for _ in range(20)]
    texts = [" ".join(words)]
    for k in (3, 8, 13):
        words[k] = rng.choice(WORDS) + rng.choice(WORDS)
        texts.append(" ".join(words))
    texts.append(" ".join(rng.choice(WORDS) + rng.choice(WORDS) for _ in range(20)))  # the hub of round 0
    monkeypatch.setattr(lines, "buckets", lambda found: found.select(F.lit(1).cast("long").alias("bucket"), lines.digest(F.col("line")).alias("digest")).distinct())
    got = {(r[0], r[1]): (r[2], r[3], r[4]) for r in lines.line_groups(documents(spark, texts)).collect()}
    assert got == brute.near_lines(list(enumerate(texts))) and got[3, 0] == (0, 0, 4)


def test_repetitive_lines_of_any_length_meet(spark):
    texts = [c * n for c in "-=" for n in (20, 60, 110, 200)]
    texts += ["no signal on this line, " * n + "no signal" for n in (3, 10, 30)]
    texts += [("0123456789" * 13)[: 7 + n] + prose(random.Random(13), 40)[:130] for n in (20, 60, 110)]
    got = {(r[0], r[1]): (r[2], r[3], r[4]) for r in lines.line_groups(documents(spark, texts)).collect()}
    assert got == brute.near_lines(list(enumerate(texts))) and got[3, 0] == (0, 0, 4)


def test_exact_groups_and_filter(spark):
    texts = [*AWKWARD, "a b", "ab", "a  b", "a\tb ", None, " "]
    df = documents(spark, texts).repartition(5)
    groups = {}
    for i, t in enumerate(texts):
        groups.setdefault("".join(c for c in t or "" if c not in brute.WS), []).append((-len(t or ""), i))
    want = {i: (min(g)[1], len(g), min(g)[1] == i) for g in groups.values() for _, i in g}
    got = {r["doc_id"]: (r["keep_id"], r["group_size"], r["kept"]) for r in exact_dedup.exact_groups(df, step=1).collect()}
    assert got == want
    assert sorted(r["doc_id"] for r in exact_dedup.drop_exact(df).collect()) == sorted(i for i in want if want[i][2])
    repeated = df.union(df.where("doc_id in (3, 11)"))
    kept = exact_dedup.drop_exact(repeated)
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(i for i in want if want[i][2])
    assert kept.columns == df.columns
    assert exact_dedup.exact_groups(empty(spark)).count() == 0


def test_components_of_a_long_chain_and_a_hub(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 50)]
    got = {r[0]: r[1] for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(1, 41)}, **{100 + i: 100 for i in range(1, 50)}}


def test_simhash_against_brute_force(spark):
    rng = random.Random(2)
    texts = varied(rng)
    long_text = prose(rng, 900)
    texts += [long_text + " " + prose(rng, k) for k in range(6)]
    got = sorted(tuple(r) for r in simhash.near_groups(documents(spark, texts)).collect())
    assert got == brute.simhash_groups(list(enumerate(texts)))
    kept = simhash.drop_near(documents(spark, texts))
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted({g[2] for g in got})
    assert simhash.near_groups(empty(spark)).count() == 0


def test_every_pair_within_three_bits_is_linked(spark):
    rng = random.Random(3)
    centre = rng.getrandbits(64)
    prints = {centre}
    for bits in (1, 2, 3, 3, 3, 4, 5):
        for _ in range(6):
            prints.add(centre ^ sum(1 << b for b in rng.sample(range(64), bits)))
    prints = sorted(prints)
    df = spark.createDataFrame([(simhash.signed(p),) for p in prints], "fp long")
    groups, want = brute.Groups(len(prints)), brute.Groups(len(prints))
    at = {simhash.signed(p): i for i, p in enumerate(prints)}
    for r in simhash.near_links(df).collect():
        groups.join(at[r["a"]], at[r["b"]])
    for i, p in enumerate(prints):
        for j in range(i):
            if (p ^ prints[j]).bit_count() <= 3:
                want.join(i, j)
    assert [groups.find(i) for i in range(len(prints))] == [want.find(i) for i in range(len(prints))]


@pytest.mark.parametrize("most_broadcast", [200_000, 0])
def test_contamination_against_brute_force(spark, most_broadcast):
    rng = random.Random(4)
    items = [(i, prose(rng, n)) for i, n in enumerate((40, 25, 13, 6, 3, 1))] + [(90, None), (91, ""), (2, prose(rng, 20)), (None, prose(rng, 15))]
    items.append((92, items[0][1]))
    texts = [*AWKWARD, *(prose(rng, 40) + " " + (t or "").upper() + ". " + prose(rng, k) for k, (_, t) in enumerate(items)), items[0][1] + " " + items[0][1]]
    bench = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 as key", "2 as wid")
    got = [tuple(r) for r in decontaminate.contamination(documents(spark, texts), bench, broadcast_windows=most_broadcast).collect()]
    assert sorted(got) == sorted(brute.contamination(list(enumerate(texts)), items))
    assert {r[2] for r in decontaminate.contamination(documents(spark, texts), bench.limit(0)).collect()} == {0}
    assert decontaminate.contamination(empty(spark), bench).count() == 0


def test_mix_meets_targets_and_repeats(spark):
    rng = random.Random(5)
    texts = [*AWKWARD, *(prose(rng, rng.randint(1, 300)) for _ in range(400))]
    sources = [rng.choice(["big", "big", "big", "b", "c", None, "ä"]) for _ in texts]
    rows = mixing.mix(documents(spark, texts, sources=sources), leaf_rows=20, fan_in=3).collect()
    again = mixing.mix(documents(spark, texts, sources=sources).repartition(7), leaf_rows=20, fan_in=3).collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, again))
    size = {i: len([w for w in "".join(" " if c in brute.WS else c for c in t or "").split(" ") if w]) for i, t in enumerate(texts)}
    per_source = Counter()
    for i, s in enumerate(sources):
        per_source[s] += size[i]
    want, taken = brute.targets(per_source), Counter()
    for r in rows:
        s = sources[r["doc_id"]]
        assert (r["size"], r["source_size"]) == (size[r["doc_id"]], per_source[s]) and r["target"] == pytest.approx(want[s])
        assert r["taken"] == r["copies"] * r["size"] <= 3 * r["size"]
        taken[s] += r["taken"]
    assert len(rows) == len(texts)
    assert all(abs(taken[s] - want[s]) <= 300 for s in want)
    assert mixing.mix(empty(spark)).count() == 0


def test_rows_without_id_or_repeated_are_kept(spark):
    texts = [*AWKWARD, *(prose(random.Random(k), 30) for k in range(8))]
    df = documents(spark, texts, langs=["xx", "yy"] * 9 + ["xx"], sources=["s"] * 19)
    df = df.selectExpr("if(doc_id % 4 = 0, null, doc_id + 9007199254740993) as doc_id", *df.columns[1:])
    df = df.union(df)
    bench = spark.createDataFrame([(1, texts[12])], "item_id long, text string")
    known = df.selectExpr("doc_id", "cast(doc_id % 2 as int) as quality", "cast(doc_id % 2 as int) as toxic")
    ids = sorted(r[0] or 0 for r in df.select("doc_id").collect())
    results = [
        exact_dedup.exact_groups(df),
        quality.scores(df, known),
        decontaminate.contamination(df, bench),
        language.predictions(df, steps=5),
        mixing.mix(df, leaf_rows=5, fan_in=2),
        toxicity.scores(df, known),
        simhash.near_groups(df),
    ]
    for got in results:
        assert sorted(r["doc_id"] or 0 for r in got.select("doc_id").collect()) == ids
    assert {r[0] for r in lines.line_groups(df).select("doc_id").collect()} <= set(r[0] for r in df.select("doc_id").collect())


def test_stages_drop_rows_not_ids(spark):
    rng = random.Random(14)
    a, b, c, d, e = (prose(rng, 60) for _ in range(5))

    def frame(rows):
        return spark.createDataFrame([(i, t, None, f"s{k}", None) for k, (i, t) in enumerate(rows)], DOC).repartition(3)

    def left(df):
        return sorted(((r["doc_id"], r["text"], r["source"]) for r in df.collect()), key=repr)

    def want(rows, places):
        return sorted(((*rows[k], f"s{k}") for k in places), key=repr)

    # null ids with and without copies; id 5 on two texts, one of them kept; of equal texts the longest stays
    rows = [(None, a), (3, a), (None, b), (None, c), (5, c + " "), (5, d), (2, d), (7, e), (7, e + " ")]
    assert left(exact_dedup.drop_exact(frame(rows))) == want(rows, [1, 2, 4, 6, 8])
    rows = [(None, a), (3, a + " end"), (None, b), (None, c), (None, c + " "), (5, d), (5, e), (2, d + " "), (9, e + "  ")]
    assert {f"s{k}" for k in (1, 2, 6, 7)} <= {r[2] for r in left(simhash.drop_near(frame(rows)))}
    kept = left(simhash.drop_near(frame(rows)))
    assert len(kept) == 5 and sum(r[1].startswith(c) for r in kept) == 1
    twice = [(1, a), (1, a), (None, b), (None, b), (None, "x")]
    assert [r[:2] for r in left(simhash.drop_near(frame(twice)))] == sorted([(1, a), (None, b), (None, "x")], key=repr)
    bench = spark.createDataFrame([(1, a)], "item_id long, text string")
    rows = [(None, a), (None, b), (4, a), (4, c), (6, d), (6, d), (None, None)]
    assert left(decontaminate.drop_contaminated(frame(rows), bench)) == want(rows, [1, 3, 4, 5, 6])


def test_rounding_keeps_expectations():
    sizes, p, total = np.array([50.0, 9, 7, 5, 3, 1]), 0.3, np.zeros(6)
    for seed in range(4000):
        rng, q = np.random.default_rng(seed), np.full(6, p)
        ones, left = mixing.settle_leaf(sizes, q, rng.random(6))
        total += ones
        if left >= 0:
            total[left] += q[left]
            assert (sizes * ones).sum() + sizes[left] * q[left] == pytest.approx(p * sizes.sum())
    assert np.abs(total / 4000 - p).max() < 0.04


def test_quality_learns_and_is_total(spark):
    rng = random.Random(6)
    good = [prose(rng, 40).capitalize() + "." for _ in range(80)]
    bad = [" ".join([w + "&&&" for w in prose(rng, 40).split()]) if k % 2 else " ".join([rng.choice(WORDS)] * 40) for k in range(40)]
    texts = good + bad + AWKWARD
    known = [(i, 1) for i in range(80)] + [(i, 0) for i in range(80, 120)] + [(0, None), (9999, 1)]
    df = documents(spark, texts)
    rows = {r["doc_id"]: r for r in quality.scores(df, labels(spark, known, "quality")).collect()}
    held = [i for i in range(120) if rows[i]["held_out"]]
    assert held and all(rows[i]["predicted"] == (i < 80) for i in held)
    assert len(rows) == len(texts) and all(0 <= r["score"] <= 1 for r in rows.values())
    kept = quality.drop_rejected(df, labels(spark, known, "quality"))
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(i for i, r in rows.items() if r["predicted"])
    assert {r["score"] for r in quality.scores(df, labels(spark, [(1, 1)], "quality")).collect()} == {0.5}
    assert quality.scores(empty(spark), labels(spark, known, "quality").limit(0)).count() == 0


def test_toxicity_learns_and_is_total(spark):
    rng = random.Random(7)
    foul = ["grimble", "snorkish", "vexatious"]
    plain = ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(3000)]
    toxic = [" ".join(rng.sample(plain, 20) + rng.sample(foul, 2)) for _ in range(90)]
    clean = [" ".join(rng.sample(plain, 25)) for _ in range(500)]
    texts = toxic + clean + AWKWARD
    known = [(i, 1) for i in range(0, 90, 2)] + [(i, 0) for i in range(90, 400)] + [(3, None)]
    rows = {r["doc_id"]: r for r in toxicity.scores(documents(spark, texts), labels(spark, known, "toxic")).collect()}
    assert np.mean([rows[i]["predicted"] for i in range(90) if rows[i]["held_out"]]) > 0.9
    assert np.mean([rows[i]["predicted"] for i in range(90, 590) if rows[i]["held_out"]]) < 0.02
    assert len(rows) == len(texts) and all(0 <= r["score"] <= 1 for r in rows.values())
    assert toxicity.scores(documents(spark, texts), labels(spark, [], "toxic")).where("predicted = 1").count() == 0
    assert toxicity.scores(empty(spark), labels(spark, [], "toxic")).count() == 0


def test_network_gradients():
    rng = np.random.default_rng(8)
    layer = language.Layer(*(w.astype(np.float64) for w in vars(language.Layer.fresh(rng, 3)).values()))
    codes, mask, pull = rng.integers(0, 256, (6, 4)), np.ones((6, 4)), rng.normal(size=(6, 3, 4))
    mask[4:, 1] = 0

    def loss():
        state, total = np.zeros((3, 4)), 0.0
        for t in range(6):
            state = layer.step(codes[t], state)[0] * mask[t]
            total += (state * pull[t]).sum()
        return total

    grads = layer.gradients(codes, mask, pull)
    for w, g in zip((layer.inputs, layer.recur, layer.bias), grads):
        spots = [np.unravel_index(k, w.shape) for k in np.argsort(-np.abs(g), axis=None)[:5]]
        for at in spots:
            old = w[at]
            w[at] = old + 1e-5
            high = loss()
            w[at] = old - 1e-5
            low = loss()
            w[at] = old
            assert g[at] == pytest.approx((high - low) / 2e-5, rel=1e-3)


def test_fast_and_plain_inference_agree():
    rng = np.random.default_rng(9)
    net = language.Network(["a", "b"], language.Layer.fresh(rng, 4), language.Layer.fresh(rng, 4), rng.normal(size=(2, 9)).astype(np.float32))
    texts = [bytes(rng.integers(0, 256, n, dtype=np.uint8)) for n in (0, 1, 63, 64, 65, 1000)]
    got = net.pooled(texts)
    for text, row in zip(texts, got):
        total = np.zeros(2)
        for start in range(0, len(text), language.CHUNK):
            codes = np.frombuffer(text[start : start + language.CHUNK], np.uint8)[:, None]
            total += sum(net.positions(s)[:, 0] for s in net.both(codes, None))
        assert row == pytest.approx(total / max(1, len(text)), abs=1e-4)


def test_language_learns_and_is_total(spark):
    rng = random.Random(10)
    kinds = {"xx": "zarn vokk grusk tavvik".split(), "yy": "olea miuai eoliu auea".split()}
    langs = [rng.choice(["xx", "yy"]) for _ in range(120)]
    texts = [" ".join(rng.choice(kinds[k]) for _ in range(30)) for k in langs] + AWKWARD + ["12 34"]
    rows = {r["doc_id"]: r for r in language.predictions(documents(spark, texts, langs + [None] * 12)).collect()}
    held = [i for i in range(120) if rows[i]["held_out"]]
    assert np.mean([rows[i]["lang_pred"] == langs[i] for i in held]) > 0.95
    assert {rows[120 + AWKWARD.index(t)]["lang_pred"] for t in (None, "", " \t\n\r ")} | {rows[131]["lang_pred"]} == {"und"}
    assert len(rows) == len(texts) and all(0 <= r["score"] <= 1 for r in rows.values())
    assert {r["lang_pred"] for r in language.predictions(documents(spark, ["abc"])).collect()} == {"und"}
    assert language.predictions(empty(spark)).count() == 0


def test_rotation_round_trip(spark):
    turns = [(1, 0, "ann", "hi"), (1, 1, "bob", "<|im_start|>x"), (1, 2, "ann", None), (1, 2, "ann", None), (2, 0, "system", "be kind"), (2, 1, "c d", "é"), (2, 1, None, "?"), (None, 5, "ann", "alone"), (3, 0, "system", "nobody")]
    turns += [(7, k, "ann" if k % 3 else "bob", f"turn {k}") for k in range(200)]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").selectExpr("*", "1 as part", "2 as size")
    views = {}
    for r in chat.rotate(df).orderBy("conv_id", "perspective", "position").collect():
        views.setdefault((r["conv_id"], r["perspective"]), []).append(r)
    assert set(views) == {(1, "ann"), (1, "bob"), (2, "c d"), (2, "unknown"), (None, "ann"), (7, "ann"), (7, "bob")}
    for (conv, who), rows in views.items():
        whole, at = "".join(r["segment"] for r in rows), 0
        assert len(rows) == sum(t[0] == conv for t in turns) and [r["position"] for r in rows] == list(range(len(rows)))
        for r in rows:
            assert (r["start"], whole[r["start"] : r["end"]]) == (at, r["segment"])
            at = r["end"]
            if r["train"]:
                assert r["role"] == "assistant" and whole[r["train_start"] : r["train_end"]].endswith("<|im_end|>")
    assert "".join(r["segment"] for r in views[1, "bob"]).startswith("<|im_start|>user name=ann\nhi<|im_end|>\n<|im_start|>assistant\n< |im_start|>x<|im_end|>\n")
    assert {r["name"] for r in views[2, "unknown"]} == {None, "c_d"}
    assert chat.rotate(df.limit(0)).count() == 0


def vocabulary():
    P = pytest.importorskip("public_tokenizers")
    return P.path("byte_bpe_50k.json")


def test_token_counts_equal_the_library(spark):
    tokenizers = pytest.importorskip("tokenizers")
    rng = random.Random(11)
    signs = "aA1 \n\t\r.,'!?é ß日ا\x1c\x85 ​😀<|endoftext|>"
    texts = [*AWKWARD, "don't I'll 'S  x", "<|endoftext|><|endoftext|>", *("".join(rng.choice(signs) for _ in range(60)) for _ in range(150)), *(prose(rng, 50) for _ in range(30)), "ab " * 400_000]
    library = tokenizers.Tokenizer.from_file(vocabulary())
    want = {i: len(e.ids) for i, e in enumerate(library.encode_batch([t or "" for t in texts], add_special_tokens=False))}
    rows = tokens.token_counts(documents(spark, texts), vocabulary()).collect()
    assert {r["doc_id"]: r["n_tokens"] for r in rows} == want
    assert all(r["n_bytes"] == len((texts[r["doc_id"]] or "").encode()) and r["over_limit"] == (r["n_tokens"] > 1024) for r in rows)
    assert tokens.token_counts(empty(spark), vocabulary()).count() == 0


def test_pretoken_pattern_agrees_with_the_library_on_every_fast_character():
    tokenizers = pytest.importorskip("tokenizers")
    cut, pre, shown = tokens.cutter(), tokenizers.Tokenizer.from_file(vocabulary()).pre_tokenizer, tokens.byte_alphabet()
    for lo, hi in tokens.FAST:
        for c in map(chr, range(lo, hi + 1)):
            for text in (f"a{c}b 1{c}2 ,{c}. {c}", f" {c}{c}  x", f"'{c}s {c}\n"):
                want = [p for p, _ in pre.pre_tokenize_str(text)]
                assert ["".join(shown[b] for b in p.encode()) for p in cut.findall(text)] == want


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_matches_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = queries.QUERIES[name](spark, SF)
    cur = con.execute(queries.ORACLES[name])
    columns = [c[0] for c in cur.description]
    assert sorted(repr(tuple(r)) for r in df.select(*columns).collect()) == sorted(map(repr, cur.fetchall()))


def test_simhash_half_balls_are_not_broadcast(spark, tmp_path):
    """The half-balls are 66 rows for a fingerprint; file sizes of a small table let them look tiny."""
    path = str(tmp_path / "prints")
    spark.range(2000).select(F.xxhash64("id").alias("fp")).coalesce(1).write.parquet(path)
    links = simhash.near_links(spark.read.parquet(path))
    links.count()
    assert "BroadcastHashJoin" not in links._jdf.queryExecution().executedPlan().toString()


def test_line_sieve_loses_no_wanted_line(spark):
    rows = spark.range(20000).select(lines.digest(F.col("id").cast("string")).alias("digest"), "id")
    wanted = rows.where("id % 50 = 7").select("digest")
    for masks, most in ((1000, 3000), (4, 20000)):  # four masks are full: all rows may pass
        passed = {r["id"] for r in lines.sieved(rows, wanted, masks).collect()}
        assert set(range(7, 20000, 50)) <= passed and len(passed) <= most
    assert lines.sieved(rows, wanted.limit(0)).count() == 0
    assert lines.sieved(rows, wanted).columns == rows.columns


def test_line_buckets_of_any_size_are_compared_whole(spark, monkeypatch):
    """All lines in one bucket, in blocks of about six: near groups, chains and others, against brute force."""
    rng = random.Random(29)
    texts = []
    for _ in range(4):
        words = prose(rng, 30).split()
        for k in range(9):
            words[3 * k] = prose(rng, 1)
            texts.append(" ".join(words))
    texts += [prose(rng, 25) for _ in range(10)]
    monkeypatch.setattr(lines, "buckets", lambda found: found.select(F.lit(1).cast("long").alias("bucket"), lines.digest(F.col("line")).alias("digest")).distinct())
    monkeypatch.setattr(lines, "SMALL", 4, raising=False)
    monkeypatch.setattr(lines, "BLOCK", 6, raising=False)
    got = {(r[0], r[1]): (r[2], r[3], r[4]) for r in lines.line_groups(documents(spark, texts)).collect()}
    assert got == brute.near_lines(list(enumerate(texts)))


def test_line_templates_write_no_row_for_each_pair(spark, monkeypatch):
    """120 lines of one template that are not near each other: rows grow with the lines, not their pairs."""
    rng = random.Random(31)
    head = prose(rng, 6)[:45]
    texts = [head + "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(30)) for _ in range(120)]
    rows, written = {}, lines.written

    def counted(df, label):
        out = written(df, label)
        rows[label] = out.count()
        return out

    monkeypatch.setattr(lines, "written", counted)
    got = lines.line_groups(documents(spark, texts)).collect()
    assert len(got) == 120 and all(r["kept"] for r in got)
    assert rows["line-members"] > 120 and max(rows.values()) <= lines.BANDS * 120


def test_lines_meet_by_profile_before_texts(spark, monkeypatch):
    """A large bucket of near copies and others: profiles are bounds, and blocks hold the lines outside its largest component alone."""
    rng = random.Random(29)
    letters = lambda n: "".join(rng.choice("abcdefgh ij") for _ in range(n))
    stem = letters(160)
    texts = [stem[:k] + rng.choice("XYZ") + stem[k:] for k in range(0, 160, 2)] + [stem[:100] + letters(60) for _ in range(6)] + ["-" * 30, "-" * 90, "short"]
    monkeypatch.setattr(lines, "buckets", lambda found: found.select(F.lit(1).cast("long").alias("bucket"), lines.digest(F.col("line")).alias("digest")).distinct())
    monkeypatch.setattr(lines, "BLOCK", 16)
    seen, near = [], lines.can_be_near
    monkeypatch.setattr(lines, "can_be_near", lambda lacking, x, y, s: seen.append((x, y)) or near(lacking, x, y, s))
    got = {(r[0], r[1]): (r[2], r[3], r[4]) for r in lines.line_groups(documents(spark, texts)).collect()}
    assert got == brute.near_lines(list(enumerate(texts))) and seen

    table = spark.createDataFrame(list(enumerate(texts)), "id long, line string")
    sets = table.select("id", lines.shingle_set(F.col("line")).alias("s"))
    both = lines.profiles(table).join(sets, "id")
    pairs = both.select(F.struct("*").alias("x")).crossJoin(both.select(F.struct("*").alias("y")))
    apart = F.size(F.array_except("x.s", "y.s")) + F.size(F.array_except("y.s", "x.s"))
    short = pairs.where((lines.lacking("x", "y") > lines.lacking_wide("x", "y")) | (lines.lacking_wide("x", "y") > apart))
    assert short.count() == 0 and pairs.where(lines.lacking_wide("x", "y") > 0).count() > 1000


def test_line_minima_are_those_of_their_ranges(spark):
    texts = ["ab", "-" * 40, "the quick brown fox jumps over the lazy dog", "".join(chr(97 + k * k % 23) + chr(65 + k % 26) for k in range(400))]
    found = spark.createDataFrame([(t,) for t in texts], "line string")
    hashes = {bytes(r[0]): sorted(r[1]) for r in found.select(lines.digest(F.col("line")), lines.shingle_hashes(F.col("line"))).collect()}
    got = {(bytes(r["digest"]), r["band"]): r["minima"] for r in lines.signatures(found).collect()}
    assert len(got) == lines.BANDS * len(texts)
    for (key, band), minima in got.items():
        edges = [(band + lines.BANDS * row - lines.BINS // 2) * lines.STEP for row in range(lines.ROWS)]
        assert minima == [next((h for h in hashes[key] if h >= e), hashes[key][0]) for e in edges]
