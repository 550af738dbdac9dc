"""Each operator against a plain version, on small tables with nulls, empty and long texts, ties, copies and clashing names."""

from __future__ import annotations

import base64
import hashlib
import os
import random

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.llm import bpe, common, components, decontaminate, jvm, langid, lm, pieces, quality, queries, simhash, substring_dedup, suffix_dedup, token_files, warc
from lodestone.llm.common import written

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def made(seed=1):
    """(doc_id, text, lang, source, n_chars): prose of few words, copies, near copies, shared passages, odd texts."""
    r = random.Random(seed)
    vocab = ["the", "of", "and", "Über", "ñu", "stone", "River", "x", "lake", "été", "a1", "run#", "go|on", "ab"]
    prose = lambda n: " ".join(r.choice(vocab) + r.choice(["", "", "", str(r.randrange(40))]) for _ in range(n))
    texts = [prose(r.randrange(1, 160)) for _ in range(40)]
    passage = prose(60)
    texts += [prose(20) + "\n" + passage + " " + prose(30) for _ in range(6)]
    texts += [texts[0]] * 4 + [texts[1] + " tail", texts[1] + " tail two", passage, passage]
    texts += [None, "", " \n\t ", "word", "a b", "a" * 300, "ab" * 120, " ".join(["go"] * 120), "\n".join(["same line here"] * 30), prose(3000), "tab\tand\x0bnew\x1cline \x00 zero", "é" * 90, " wide space   three  two \n \n x"]
    return [(i * 3 + 1, t, None if i % 11 == 0 else "en", None if i % 13 == 0 else "src0", None) for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def rows():
    return made()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def vocabulary():
    return queries.vocabulary()


def plain(rows):
    return [(r[0], r[1]) for r in rows]


def listed(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


EMPTY = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def test_quality_base(docs, rows):
    out = listed(quality.clean(docs), "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert out == sorted((d, *brute.op1(t)) for d, t in plain(rows))


@pytest.mark.parametrize("fold", [True, False])
def test_quality_verdict(spark, docs, rows, fold):
    """The whole verdict against plain Python, with hosts that share lines, lines that differ in digits, and clashing names."""
    r = random.Random(4)
    body = lambda n: "\n".join(" ".join("".join(r.choices("abcdeé", k=4)) for _ in range(9)) for _ in range(n))
    menu = [" Home | About\t| 3 items ", "Page {} of 12", "Kontakt ÜBER uns {}", "\x1c odd"]
    more = [(1000 + i, body(r.randrange(5, 12)) + "\n" + "\n".join(m.format(i % 7) for m in menu * r.randrange(1, 4)), f"h{i % 3}" if i % 9 else None) for i in range(90)]
    more += [more[0], (None, more[1][1], "h0"), (None, None, None), (2000, "", "h0")]
    df = spark.createDataFrame(more, "doc_id bigint, text string, source string").repartition(4)
    df = df.withColumn("r_", F.lit(1)).withColumn("doc_", F.lit(2)).withColumn("row", F.lit(3)).withColumn("kept", F.lit("x")).withColumn("f", F.lit(5)).withColumn("c0", F.lit(6))
    out = quality.clean(df, fold_digits=fold)
    assert out.columns == ["doc_id", "text", "source", "r_", "doc_", "row", "f", "c0", *quality.MADE]
    got = sorted(((-1 if d is None else d, *rest) for d, *rest in out.select("doc_id", "n_left", F.size("removed_lines"), "kept").collect()))
    assert got == sorted((-1 if d is None else d, *rest) for d, *rest in brute.op1_verdict(more, fold=fold))
    assert {a[3] for a in got if a[1]} == {True, False} and any(a[2] for a in got)


def test_quality_lines(spark):
    """Lines that differ in digits, as these bodies do, are told apart where digits are not folded."""
    clean = lambda df: quality.clean(df, fold_digits=False)
    body = lambda i: " ".join(f"w{i}x{j}" for j in range(80))
    menu = " ".join(f"menu{j}" for j in range(120))
    rows = [(i, f"{menu}\n{body(i)}" if i < 12 else f"{body(i)}\nown {i}", "en", "h", 0) for i in range(60)]
    rows += [(100, f"{menu}\n{body(100)}", "en", "other", 0), (101, None, None, None, None)]
    out = {r["doc_id"]: r for r in clean(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert [out[i]["kept"] for i in (0, 11, 12, 59, 100, 101)] == [False, False, True, True, True, False]
    assert out[0]["clean_text"] == body(0) and out[100]["clean_text"].startswith("menu0") and out[101]["clean_text"] is None
    # A row that is repeated is one document: eight ids stay under the limit of ten.
    few = [(i % 8, f"{menu}\n{body(i % 8)}", "en", "h", 0) for i in range(24)]
    assert all(r["kept"] for r in clean(spark.createDataFrame(few, SCHEMA)).collect())


def test_suffix_dedup(docs, rows):
    out = suffix_dedup.deduplicate(docs)
    assert listed(out, "doc_id", "n_symbols", "n_removed", (F.octet_length("spans") / 8).cast("int"), F.sha2("kept_bytes", 256)) == brute.op4(plain(rows))
    assert set(out.columns) == {"doc_id", "lang", "source", "n_chars", "n_symbols", "n_removed", "kept_bytes", "spans"}


def test_substring_dedup(docs, rows):
    out = substring_dedup.remove_repeated(docs)
    assert listed(out, "doc_id", "n_symbols", "n_removed", F.sha2("kept_bytes", 256)) == brute.op5(plain(rows))


def test_pieces_null_ids_repeats_and_clashes(spark):
    t = "0123456789" * 3 + "abcdefghijklmnopqrstuvwxyz" + "ABCDE"
    df = spark.createDataFrame([(5, t, "k"), (5, t, "k"), (None, t, None), (2, "zz" + t, "k")], "doc_id bigint, text string, kept_bytes string")
    out = sorted((r["doc_id"] or 99, r["n_removed"]) for r in suffix_dedup.deduplicate(df).collect())
    assert out == [(2, 0), (5, len(t)), (5, len(t)), (99, len(t))]


@pytest.mark.parametrize("f", [suffix_dedup.deduplicate, substring_dedup.remove_repeated, simhash.near_duplicates, quality.clean, lambda d: bpe.encode(d, {bytes([i]): i for i in range(256)}, queries.vocabulary()[1]), lambda d: lm.score(d, F.lit(True)), lambda d: langid.predict(d, langid.fit(d))])
def test_empty_tables(spark, f):
    assert f(spark.createDataFrame([], EMPTY)).collect() == []


@pytest.mark.parametrize("f, check", [(suffix_dedup.deduplicate, brute.op4), (substring_dedup.remove_repeated, brute.op5)])
def test_edges_of_a_shared_passage(spark, monkeypatch, f, check):
    """Windows over the edges of a passage have minimizers inside it and contexts of their own: they don't share a bucket."""
    r = random.Random(17)
    own = lambda: " ".join(f"{r.getrandbits(32):x}" for _ in range(60))
    passage = " ".join(f"pass{j}" for j in range(80))
    rows = [(i, f"{own()} {passage} {own()}") for i in range(300)] + [(i, t) for i, t, *_ in made(3) if t]
    monkeypatch.setattr(pieces, "BUCKET_BYTES", 4 << 10)
    sizes = {}
    for hot in (1 << 30, 16):
        monkeypatch.setattr(pieces, "HOT_PIECES", hot, raising=False)
        seen = []
        monkeypatch.setattr(pieces, "written", lambda df, name, seen=seen: seen.append((name, written(df, name))) or seen[-1][1])
        out = f(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3))
        got = listed(out, "doc_id", "n_symbols", "n_removed", F.sha2("kept_bytes", 256))
        assert got == sorted((w[0], w[1], w[2], w[-1]) for w in check(rows))
        per = [x["n"] for x in dict(seen)["answers"].groupBy("bucket").agg(F.sum(F.octet_length("blob")).alias("n")).collect()]
        sizes[hot] = max(per) / sum(per)
    assert sizes[16] < 0.5 * sizes[1 << 30]


def test_as_text(spark):
    kept = [b"ab\xc3", "é�x".encode(), b"\xa9z", b"", None, "😀".encode()[1:] + b"k"]
    df = spark.createDataFrame([(i, bytearray(x) if x is not None else None) for i, x in enumerate(kept)], "i int, kept binary")
    assert [r[0] for r in df.orderBy("i").select(suffix_dedup.as_text(spark, F.col("kept"))).collect()] == ["ab", "é�x", "z", "", None, "k"]


def test_linear_grouping(spark):
    """Kernels' suffix arrays by their use: windows of bytes of texts that repeat themselves in every way."""
    r = random.Random(7)
    texts = ["".join(r.choice(alphabet) for _ in range(r.randrange(400))) for alphabet in ("a", "ab", "abc", "\x00a") for _ in range(12)]
    rows = [(i, t) for i, t in enumerate(texts)]
    out = suffix_dedup.deduplicate(spark.createDataFrame(rows, "doc_id bigint, text string"))
    assert listed(out, "doc_id", "n_symbols", "n_removed", (F.octet_length("spans") / 8).cast("int"), F.sha2("kept_bytes", 256)) == brute.op4(rows)


@pytest.mark.parametrize("ranges, group", [(2048, 4096), (3, 2)])
def test_borders_of_chunks_and_buckets(spark, monkeypatch, vocabulary, docs, rows, ranges, group):
    """Chunks of 700 bytes and buckets of 2,000, in one step or two: every border that large tables have is crossed."""
    monkeypatch.setattr(common, "RANGES", ranges)
    monkeypatch.setattr(common, "GROUP", group)
    for m in (pieces, bpe, lm):
        monkeypatch.setattr(m, "CHUNK", 700)
        monkeypatch.setattr(m, "BUCKET_BYTES", 2000)
    few = docs.repartition(2)
    assert listed(suffix_dedup.deduplicate(few), "doc_id", "n_symbols", "n_removed", (F.octet_length("spans") / 8).cast("int"), F.sha2("kept_bytes", 256)) == brute.op4(plain(rows))
    assert listed(substring_dedup.remove_repeated(few), "doc_id", "n_symbols", "n_removed", F.sha2("kept_bytes", 256)) == brute.op5(plain(rows))
    assert listed(bpe.encode(few, *vocabulary), "doc_id", F.sha2("decoded", 256)) == sorted((d, hashlib.sha256((t or "").encode()).hexdigest()) for d, t in plain(rows))
    want, _, _ = brute.op2(plain(rows), {7})
    got = {r["doc_id"]: r for r in lm.score(few, F.col("doc_id") == 7).collect()}
    assert all(got[d]["score"] is None or got[d]["h_background"] == pytest.approx(x[1]) and got[d]["h_target"] == pytest.approx(x[0]) for (d, _), x in zip(plain(rows), want, strict=True))


def test_rows_that_chunks_send_grow_with_the_text(spark, monkeypatch):
    """Chunks and buckets grow with the text; what is sent grows with the chunks, not with the product."""
    monkeypatch.setattr(common, "RANGES", 8)
    monkeypatch.setattr(pieces, "CHUNK", 4000)
    monkeypatch.setattr(pieces, "BUCKET_BYTES", 4000)
    for n in (16, 64):
        sent = []
        monkeypatch.setattr(pieces, "met", lambda rows, *a, sent=sent: sent.append((rows.select(F.sum(F.size("sent"))).first()[0], a[0], a[1])) or common.met(rows, *a))
        r = random.Random(n)
        df = spark.createDataFrame([(i, " ".join(f"{r.getrandbits(24):x}" for _ in range(600))) for i in range(n)], "doc_id bigint, text string").repartition(2)
        substring_dedup.remove_repeated(df).count()
        rows, buckets, chunks = sent[0]
        assert buckets >= n / 2 and chunks >= n / 2 and rows <= 8 * chunks


def test_simhash(docs, rows):
    assert listed(simhash.near_duplicates(docs), "doc_id", "fingerprint", "component_id") == brute.op6(plain(rows))
    ids = listed(simhash.keep_one(docs), "doc_id")
    assert ids == sorted({(c,) for _, _, c in brute.op6(plain(rows))})


def test_keep_one_of_null_and_repeated_ids(spark):
    r = random.Random(11)
    text = [" ".join(str(r.getrandbits(40)) for _ in range(80)) for _ in range(9)]
    rows = [(None, text[0]), (None, text[1]), (None, text[1]), (5, text[2]), (5, text[3]), (5, text[3]), (7, text[4]), (None, text[4]), (8, text[5]), (8, text[6]), (9, text[6]), (3, text[7]), (None, text[8]), (5, text[8]), (None, None), (None, "")]
    out = [tuple(x) for x in simhash.keep_one(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)).collect()]
    want = [(None, text[0]), (None, text[1]), (5, text[2]), (5, text[3]), (7, text[4]), (8, text[5]), (8, text[6]), (3, text[7]), (5, text[8])]
    assert sorted(map(str, out)) == sorted(map(str, [*want, (None, None)]))


def test_variants_are_dealt_out(spark):
    """The exchange in front of the variants is in the plan that runs, though fingerprints are dealt out already."""
    fps = spark.range(1000).select(F.xxhash64("id").alias("fp")).groupBy("fp").agg(F.count("*").alias("n")).select("fp")
    edges = simhash.links(fps)
    edges.collect()
    plan = edges._jdf.queryExecution().executedPlan().toString()
    assert "xxhash64(fp" in plan.split("Generate")[1] and "REPARTITION_BY_NUM" in plan


def test_keep_one_of_equal_rows(spark):
    t = " ".join(str(i * 7919) for i in range(90))
    df = spark.createDataFrame([(1, t, "b", 1), (1, t, "a", 2), (None, "x", "q", 3), (None, "x", "p", 4), (None, "x", "p", 4)], "doc_id bigint, text string, own string, id int").repartition(3)
    assert sorted(tuple(r)[2:] for r in simhash.keep_one(df).collect()) == [("a", 2), ("p", 4)]


def test_simhash_links(spark):
    r = random.Random(3)
    base = [r.getrandbits(64) for _ in range(40)]
    fps = base + [x ^ (1 << r.randrange(64)) ^ (1 << r.randrange(64)) for x in base for _ in range(4)]
    fps = sorted({x - (1 << 64) if x >> 63 else x for x in fps})
    edges = simhash.links(spark.createDataFrame([(x,) for x in fps], "fp bigint"))
    got = {}
    for node, label in components.components(edges).collect():
        got.setdefault(label, set()).add(node)
    near = {x: {y for y in fps if ((x ^ y) & (2**64 - 1)).bit_count() <= 2} for x in fps}
    want, left = [], set(fps)
    while left:
        todo = [left.pop()]
        group = set(todo)
        while todo:
            new = near[todo.pop()] - group
            group |= new
            todo += new
        left -= group
        want.append(group)
    assert sorted(map(sorted, got.values())) == sorted(sorted(g) for g in want if len(g) > 1)


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(70, 70), (None, 3), (81, 80), (81, 80)], "a bigint, b bigint")
    assert {n: v for n, v in components.components(edges).collect()} == {i: 0 for i in range(61)} | {80: 80, 81: 80}


ITEMS = [(7, "One two three four five six seven eight nine ten eleven twelve thirteen fourteen"), (12, "Short item"), (3, None), (9, ""), (10, "été ÜBER"), (11, "short ITEM!")]


@pytest.mark.parametrize("most", [200_000, 3, 0])
def test_decontamination(spark, docs, rows, monkeypatch, most):
    """With all n-grams broadcast, with those of some sizes, and with none: the same rows."""
    monkeypatch.setattr(decontaminate, "BROADCAST_GRAMS", most)
    long = "x " * 10 + "one TWO, three four five six seven eight nine ten eleven twelve thirteen. fourteen " * 2
    more = [*rows, (900, long, None, None, None), (901, long + "pad " * 900, None, None, None), (902, "a short item here", None, None, None), (903, "ÉTÉ über été Über été ÜBER", None, None, None), (903, "ÉTÉ über été Über été ÜBER", None, None, None), (None, "short item", None, None, None), (904, "an unnamed item", None, None, None)]
    items = [*ITEMS, (None, "unnamed ITEM")]
    out = decontaminate.scan(spark.createDataFrame(more, SCHEMA), spark.createDataFrame(items, "item_id bigint, text string"))
    cols = ["doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ",").cast("binary"), 256), "contaminated"]
    got = sorted((-1 if r[0] is None else r[0], *r[1:]) for r in out.select(*cols).collect())
    assert got == brute.op8([(-1 if r[0] is None else r[0], r[1]) for r in more], [("" if i is None else i, t) for i, t in items])
    kept = {r["doc_id"] for r in decontaminate.remove(spark.createDataFrame(more, SCHEMA), out).collect()}
    assert 900 not in kept and 901 in kept and 1 in kept and 904 not in kept


def test_decontamination_by_many_items(spark):
    """More n-grams than are broadcast; some items are passages of documents, one of them in very many."""
    r = random.Random(21)
    text = lambda n: " ".join(f"{r.getrandbits(30):x}" for _ in range(n))
    shared = text(20)
    docs = [(i, f"{text(60)} {shared if i % 3 == 0 else text(5)} {text(30)}") for i in range(400)]
    items = [(i, text(1015)) for i in range(230)] + [(1000, shared.upper())] + [(2000 + i, " ".join(docs[i][1].split()[5:25])) for i in range(40)]
    out = decontaminate.scan(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string"))
    want = brute.op8(docs, items)
    assert listed(out, "doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ",").cast("binary"), 256), "contaminated") == want
    assert sum(w[2] > 0 for w in want) > 150


def test_decontamination_of_no_documents(spark):
    items = spark.createDataFrame(ITEMS, "item_id bigint, text string")
    assert decontaminate.scan(spark.createDataFrame([], SCHEMA), items).collect() == []


def test_remove_by_the_row(spark):
    rows = [(None, "short item"), (None, "a clean text"), (None, "another"), (None, None), (5, "short item"), (5, "clean"), (6, "Short, item!"), (7, "clean")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    out = decontaminate.remove(df, decontaminate.scan(df, spark.createDataFrame(ITEMS, "item_id bigint, text string")))
    assert sorted(map(str, map(tuple, out.collect()))) == sorted(map(str, [(None, "a clean text"), (None, "another"), (None, None), (5, "clean"), (7, "clean")]))


def test_decontamination_without_items(spark, docs, rows):
    out = decontaminate.scan(docs, spark.createDataFrame([(1, None)], "item_id bigint, text string"))
    assert {(r["n_hit"], r["contaminated"]) for r in out.collect()} == {(0, False)} and out.count() == len(rows)


def test_cut(spark):
    df = spark.createDataFrame([(1, "pre short item post", 5, 1), (2, "clean", 6, 1), (None, "SHORT Item, and", 7, 1), (1, "Pre Short", 8, 1)], "doc_id bigint, text string, spans int, hit_ int")
    found = decontaminate.scan(df, spark.createDataFrame(ITEMS, "item_id bigint, text string"))
    got = [tuple(r) for r in decontaminate.cut(df, found).collect()]
    assert sorted(got, key=lambda r: r[2]) == [(1, "pre post", 5, 1), (2, "clean", 6, 1), (None, "and", 7, 1), (1, "Pre Short", 8, 1)]


def test_bpe(spark, docs, rows, vocabulary):
    import tiktoken

    ranks, pattern = vocabulary
    t = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    out = bpe.encode(docs, ranks, pattern)
    want = []
    for d, x in plain(rows):
        ids = np.array(t.encode_ordinary(x or ""), "<u4").tobytes()
        want.append((d, len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256((x or "").encode()).hexdigest()))
    assert listed(out, "doc_id", "n_tokens", F.sha2("ids", 256), F.sha2("decoded", 256)) == sorted(want)
    again = bpe.decode(out.select("doc_id", "ids"), ranks)
    assert listed(again, "doc_id", F.sha2("decoded", 256)) == sorted((w[0], w[3]) for w in want)


def test_pretokens(vocabulary):
    import regex

    r, whole = random.Random(5), regex.compile(vocabulary[1])
    texts = ["".join(r.choice([" ", " ", "  ", "\n", "\t", "a", "B", "é", "7", "'", "'s", "!", " ", " ", "\0"]) for _ in range(r.randrange(30))) for _ in range(4000)]
    pre = bpe.Pretokens(vocabulary[1])
    numbered = pre.number(texts)
    names = list(pre.ids)
    for t, row in zip(texts, numbered, strict=True):
        assert [names[i] for u in row for i in pre.parts[u]] == whole.findall(t), repr(t)


def test_bpe_of_unknown_code_points(spark, vocabulary):
    """Code points that one library knows and another doesn't: the ids are tiktoken's."""
    import tiktoken

    r, t = random.Random(9), tiktoken.Encoding("own", pat_str=vocabulary[1], mergeable_ranks=vocabulary[0], special_tokens={})
    rows = [(i, "".join(r.choice(["7", "\U00010940", "'s", "\u088f", " ", "  ", "x", "\n", "é", "\u0378"]) for _ in range(r.randrange(1, 14)))) for i in range(3000)]
    out = bpe.encode(spark.createDataFrame(rows, "doc_id bigint, text string"), *vocabulary)
    assert listed(out, "doc_id", F.hex("ids")) == [(i, np.array(t.encode_ordinary(x), "<u4").tobytes().hex().upper()) for i, x in rows]


def test_pretokens_of_other_patterns():
    import regex

    r = random.Random(6)
    texts = ["".join(r.choice([" ", "  ", "\n", "a", "B", "7", "!", "_"]) for _ in range(r.randrange(20))) for _ in range(500)]
    for pattern in (r"\S+\s?", r"\w+|[^\w]+", r".|\n"):
        pre = bpe.Pretokens(pattern)
        numbered = pre.number(texts)
        names = list(pre.ids)
        assert [[names[i] for u in row for i in pre.parts[u]] for row in numbered] == [regex.findall(pattern, t) for t in texts]


def test_rank_file(tmp_path):
    p = tmp_path / "ranks"
    p.write_bytes(base64.b64encode(b"ab") + b" 0\n\n" + base64.b64encode(b"c") + b" 1\n")
    assert bpe.ranks_of(str(p)) == {b"ab": 0, b"c": 1}


@pytest.mark.parametrize("good", [{r[0] for r in made() if r[0] % 4 == 1}, set(), {r[0] for r in made()}])
def test_lm(spark, docs, rows, good):
    out = lm.score(docs.withColumn("score", F.lit("clash")).withColumn("target", F.col("doc_id") + 1).withColumn("_", F.lit(7)), F.col("doc_id").isin(*good) if good else F.lit(None).cast("boolean"))
    assert out.columns == ["doc_id", "lang", "source", "n_chars", "target", "_", "n_tokens", "h_target", "h_background", "score"]
    losses, _, _ = brute.op2(plain(rows), good)
    want = {r[0]: x for r, x in zip(rows, losses, strict=True)}
    seen = out.collect()
    assert len(seen) == len(rows)
    for r in seen:
        assert r["target"] == r["doc_id"] + 1 and r["_"] == 7
        if r["n_tokens"] == 1:
            assert r["score"] is None
        else:
            assert (r["h_target"], r["h_background"]) == pytest.approx(want[r["doc_id"]])
            assert r["score"] == pytest.approx(r["h_target"] - r["h_background"])


def test_lm_probabilities_sum_to_one(rows):
    """The definition itself, which test_lm holds the operator against: after every context, with a row left out or not."""
    _, model, vocabulary = brute.op2(plain(rows), {r[0] for r in rows if r[0] % 4 == 1})
    for side in (True, False):
        for without in (None, 0, 3):
            p = model(side, without)
            for v in ("<s>", "<unk>", "the", "lake"):
                assert sum(p(v, w) for w in vocabulary) == pytest.approx(1)


def test_language(spark):
    r = random.Random(2)
    words = {"en": "the of and that with this from".split(), "de": "der die und nicht mit für über".split(), "fr": "le la et dans avec être où".split()}
    rows = [(i, " ".join(r.choice(words[lang]) for _ in range(60)), lang, "s", 0) for i in range(300) for lang in words]
    odd = [(900, None, None, None, None), (901, "", "en", None, None), (902, "123 456 !!", "en", None, None)]
    df = spark.createDataFrame(rows + odd, SCHEMA)
    model = langid.fit(df.where(~langid.held_out()))
    out = langid.predict(df, model)
    got = [tuple(x) for x in out.where("doc_id < 900").select("lang", "lang_pred", "score", "lang_rejected").collect()]
    assert sum(a == b for a, b, *_ in got) / len(got) > 0.99 and all(0 <= s <= 1 for *_, s, _ in got) and sum(x[3] for x in got) < 0.02 * len(got)
    assert listed(out.where("doc_id >= 900"), "doc_id", "lang_pred", "score", "lang_rejected") == [(900, "und", 0.0, True), (901, "und", 0.0, True), (902, "und", 0.0, True)]
    far = langid.predict(spark.createDataFrame([(1, "ლლლ ჰჰჰ " * 30)], "doc_id bigint, text string"), model).first()
    assert far["lang_rejected"]


def test_language_of_long_and_copied_texts(spark):
    """A label whose texts are all long is learned; copies of one text don't take the places of a label's other texts."""
    r = random.Random(8)
    one = lambda words, n: " ".join(r.choice(words) for _ in range(n))
    de, en, fr = "der die und nicht mit für".split(), "the of and that with".split(), "le la et dans avec être".split()
    rows = [(i, one(de, 6000), "de") for i in range(8)] + [(100 + i, one(en, 50), "en") for i in range(30)]
    rows += [(1000 + i, "le la le la et", "fr") for i in range(900)] + [(3000 + i, one(fr, 40), "fr") for i in range(20)]
    model = langid.fit(spark.createDataFrame(rows, "u_ bigint, text string, lang string"))
    assert sorted(set(model.langs)) == ["de", "en", "fr"]
    out = langid.predict(spark.createDataFrame([(1, one(de, 30)), (2, one(en, 30)), (3, one(fr, 30))], "doc_id bigint, text string"), model)
    assert listed(out, "lang_pred", "lang_rejected") == [("de", False), ("en", False), ("fr", False)]
    ids = spark.createDataFrame([(None,), (1,), (2,), (3,)], "doc_id bigint").select(langid.held_out().alias("h")).collect()
    assert ids[0]["h"] is False and None not in [x["h"] for x in ids]


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="needs the test tables")
def test_language_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = queries.op9_language(spark, "/root/testdata/sf0.01").join(docs.select("doc_id", "lang", "text"), "doc_id").where("held_out and lang is not null and lang_pred != 'und'")
    right, n = out.agg(F.count_if(F.col("lang") == F.col("lang_pred")), F.count("*")).first()
    assert n > 200 and right / n >= 0.95


PAGES = "page_id bigint, url string, html string, offset string"


def pages(n=2000):
    return [(i, f"http://h/{i}", "x" * (i % 50), "extra") for i in range(n)] + [(5, "http://dup", "y", ""), (5, "http://dup", "y", ""), (None, None, None, None), (None, "http://u", "zé", None)]


def test_warc(spark):
    df = spark.createDataFrame(pages(), PAGES)
    a = warc.layout(df)
    assert warc.audit(a, a).count() == 0
    first = df.withColumn("html", F.when(F.col("page_id") == 77, F.concat(F.lit("~"), F.expr("substring(html, 2)"))).otherwise(F.col("html")))
    assert listed(warc.audit(a, warc.layout(first)), "id", "status") == [(77, "changed")]
    for x, y, status in ((a, a.limit(0), "missing"), (a.limit(0), a, "extra")):
        assert {tuple(r) for r in warc.audit(x, y).groupBy("status").count().collect()} == {(status, 2004)}
    assert warc.audit(a.limit(0), a.limit(0)).count() == 0


def test_warc_finds_the_record(spark):
    """A record that is lost, grows or is new moves those behind it in its file; none of those is called changed."""
    df = spark.createDataFrame(pages(), PAGES)
    harmed = df.where("page_id is null or page_id not in (0, 1999)").withColumn("html", F.when(F.col("page_id").isin(0, 600, 1050), F.lit("changed")).otherwise(F.col("html")))
    harmed = harmed.union(spark.createDataFrame([(1500, "http://new", "new", "")], PAGES))
    bad = listed(warc.audit(warc.layout(df), warc.layout(harmed)), "id", "status")
    assert [x for x in bad if x[1] != "moved"] == [(0, "missing"), (600, "changed"), (1050, "changed"), (1500, "extra"), (1999, "missing")]
    moved = {i for i, s in bad if s == "moved"}
    assert set(range(1, 512)) <= moved and moved <= {i for i in range(2000) if i < 512 or 600 < i < 1024 or i > 1050}


def test_warc_files(spark, tmp_path):
    """What is written is read again as it was laid out; files that are harmed on the disk are found out."""
    df = spark.createDataFrame(pages(1200), PAGES)
    files = warc.write(df)
    a, cols = warc.layout(df), ["file", "ordinal", "offset", "length", "id", "digest"]
    text = lambda rows: sorted(map(str, rows))
    assert text(listed_null(warc.read(files), *cols)) == text(listed_null(a, *cols))
    path = files.where("file = 1").first()["path"].removeprefix("file://")
    data = bytearray(open(path, "rb").read())
    at = data.find(b"\x1f\x8b\x08", len(data) // 2)
    data[at + 30] ^= 0x55
    (tmp_path / "harmed.warc.gz").write_bytes(data)
    other = files.where("file != 1").union(spark.createDataFrame([(1, f"file://{tmp_path}/harmed.warc.gz")], files.schema))
    found = warc.audit(a, warc.read(other)).where("status in ('missing', 'changed', 'extra')").collect()
    assert 1 <= len(found) <= 4 and {r["file"] for r in found} == {1}
    assert warc.read(warc.write(df.limit(0))).collect() == [] and warc.layout(df.limit(0)).collect() == []


def listed_null(df, *cols):
    return [tuple(r) for r in df.select(*cols).collect()]


def test_warc_query_and_sql(spark, tmp_path):
    """The query and its SQL on a table with empty pages, of which some are harmed and some lost."""
    import oracle

    rows = [(i, f"http://h/{i}", "" if i % 3 == 0 else None if i % 7 == 0 else "é" * (i % 11)) for i in range(1400)]
    for t in oracle.TABLES:
        path = f"{tmp_path}/{t}.parquet"
        (spark.createDataFrame(rows, "page_id bigint, url string, html string") if t == "pages" else spark.range(0)).coalesce(1).write.parquet(path)
    query, sql = queries.QUERIES["op7_warc_fixity"]
    out = query(spark, str(tmp_path))
    assert oracle.compare(out, oracle.connect(str(tmp_path)), sql) == ""
    assert {r["status"] for r in out.select("status").distinct().collect()} == {"ok", "changed", "missing", "moved"}


def test_token_files(spark, docs, rows, vocabulary):
    import tiktoken

    ranks, pattern = vocabulary
    t = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    files = token_files.write(docs, ranks, pattern, file_tokens=2000)
    named = files.select("path", F.posexplode("ids").alias("ordinal", "doc_id"))
    for block in (7, 512, 1 << 20):
        out = token_files.count(files.select("path", "tokens"), block=block).join(named, ["path", "ordinal"])
        assert listed(out, "doc_id", "n_tokens") == sorted((d, len(t.encode_ordinary(x or ""))) for d, x in plain(rows))


def test_token_files_of_wide_ids(spark):
    ranks = {bytes([i]): i * 300 for i in range(256)}
    df = spark.createDataFrame([("a", "héllo"), ("a", None), (None, "xy")], "doc_id string, text string").coalesce(1)
    out = token_files.count_documents(spark, df, ranks, r"[\s\S]", id_col="doc_id")
    assert sorted(((r["doc_id"] or ""), r["n_tokens"]) for r in out.collect()) == [("", 2), ("a", 0), ("a", 6)]
    assert out.first()["path"].endswith(".u32")
    with pytest.raises(ValueError, match="end"):
        token_files.write(df, ranks, r"\S+", end=300)
    assert token_files.count_documents(spark, df.limit(0), ranks, r"\S+").collect() == []


def test_token_file_without_last_separator(spark, tmp_path):
    (tmp_path / "a.u16").write_bytes(np.array([1, 2, 50256, 50256, 3, 4, 5], "<u2").tobytes())
    (tmp_path / "b.u16").write_bytes(np.array([9] * 20, "<u2").tobytes())
    files = spark.createDataFrame([(f"file://{tmp_path}/a.u16", 7), (f"file://{tmp_path}/b.u16", 20), (f"file://{tmp_path}/none", 0)], "path string, tokens bigint")
    for block in (1, 3, 100):
        assert listed(token_files.count(files, block=block), F.substring_index("path", "/", -1), "ordinal", "n_tokens") == [("a.u16", 0, 2), ("a.u16", 1, 0), ("a.u16", 2, 3), ("b.u16", 0, 20)]


def test_kernels_register_twice(spark):
    for _ in range(2):
        f = jvm.register(spark, "lodestone_simhash", "SimHash", "bigint")
        assert spark.range(1).select(F.call_function(f, F.lit(None).cast("binary"))).first()[0] == 0
