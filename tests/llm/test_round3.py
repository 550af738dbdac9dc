"""Operators 11 to 13 against plain versions, on small tables with nulls, ties, repeated rows, long keys and clashing names."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.llm import ann, phrases, scan, trie

CONVS = "conv_id bigint, turn bigint, role string, text string, n_ string, c string"


def plain_trie(rows):
    own = defaultdict(list)
    for c, turn, role, text, *_ in rows:
        if c is not None:
            role, text = role or "", text or ""
            own[c].append((turn is not None, turn or 0, hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest(), role, text))
    own = {c: [(x[3], x[4]) for x in sorted(v)] for c, v in own.items()}
    made = {}
    for c, mine in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = own.get(c - (abs(c) % 5 if c >= 0 else -(abs(c) % 5)), [])
        made[c] = base[:h] + mine[h:]
    members = defaultdict(list)
    for c, seq in made.items():
        for d in range(len(seq) + 1):
            members[tuple(seq[:d])].append(c)
    kids = Counter(k[:-1] for k in members if k)
    out = []
    for k, cs in members.items():
        under = [x for x in members if x[: len(k)] == k]
        ends = ",".join(str(c) for c in sorted(cs) if len(made[c]) == len(k))
        saved = sum((len(members[x]) - 1) * len(x[-1][1].encode()) for x in under if x)
        out.append((min(cs), len(k), min(members[k[:-1]]) if k else None, len(cs), kids[k], sum(kids[x] == 0 for x in under), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def tried(spark, rows, partitions=5):
    from lodestone.llm import queries

    df = spark.createDataFrame(rows, CONVS).repartition(partitions)
    c = F.col("c")
    convs, turns = trie.rebuilt(trie.turns(df), c - c % 5, F.pmod(F.crc32(c.cast("string").cast("binary")), F.lit(9)), 8)
    assert queries.QUERIES["op11_prefix_trie"][1]
    return sorted((tuple(r)[:8] for r in trie.trie(convs, turns).collect()), key=str)


def conversations(seed=3):
    r = random.Random(seed)
    rows = []
    for c in [*range(40), -3, -5, 1005, 1007]:
        for t in range(r.choice([1, 2, 3, 5, 9, 12])):
            rows.append((c, None if r.random() < 0.05 else t, r.choice(["user", "assistant", None]), r.choice(["a", "b", "é" * 3, None, ""]), "x", "y"))
    rows += rows[:7] + [(None, 1, "user", "lost", "x", "y")]
    rows += [(100 + i, t, "user", f"same {t}", None, None) for i in range(30) for t in range(12)]
    return rows + [(500, t, "user", f"turn {t % 3}", None, None) for t in range(400)]


@pytest.mark.parametrize("block", [1024, 3])
def test_trie_equals_plain(spark, monkeypatch, block):
    monkeypatch.setattr(trie, "BLOCK", block)
    rows = conversations()
    assert tried(spark, rows) == plain_trie(rows)


def test_trie_of_nothing_and_of_turnless(spark):
    assert tried(spark, []) == []
    rows = [(2, 0, "user", "x", None, None)]  # its base isn't there, and its own first turns go
    assert tried(spark, rows) == plain_trie(rows)
    assert tried(spark, rows)[0][:4] == (2, 0, None, 1)


def test_ids_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(trie, "PIECE", 2)
    rows = [(c, 0, "user", "hello", None, None) for c in range(0, 250, 5)]
    assert tried(spark, rows) == plain_trie(rows)


def test_scan_over_tasks(spark):
    df = spark.createDataFrame([(k, i, (i * 7919 + k) % 1009) for k in (1, 2, 3) for i in range(500 if k == 2 else 3)], "k bigint, i bigint, w bigint").repartition(7)
    got = defaultdict(list)
    for r in scan.scanned(df, "k", ["i"], "t", ("w",)).collect():
        got[r["k"]].append((r["i"], r["n_"], r["w_"], r["w"]))
    for v in got.values():
        x = 0
        for at, (_, n, running, w) in enumerate(sorted(v), 1):
            x ^= w
            assert (n, running) == (at, x)


def exact(rows, k=20, every=20):
    ok = sorted({(i, tuple(map(float, v))) for i, v in rows if v and all(x is not None and np.isfinite(x) for x in v) and any(v)}, key=str)
    size = max((len(v) for _, v in ok), default=0)
    out = set()
    for q, v in ok:
        if q is None or q % every:
            continue
        mine = []
        for i, w in ok:
            if i is None or i != q:
                s = 0.0
                for d in range(size):
                    s += (v[d] if d < len(v) else 0.0) * (w[d] if d < len(w) else 0.0)
                mine.append((-s, i is None, i or 0))
        out |= {(q, r, None if none else i, -s) for r, (s, none, i) in enumerate(sorted(mine)[:k], 1)}
    return out


def embedded(seed=5, n=300, size=8):
    r = np.random.default_rng(seed)
    x = r.standard_normal((n, size)).astype(np.float32)
    rows = [(i, [float(v) for v in x[i]]) for i in range(n)]
    rows += [(1000 + i, rows[40][1]) for i in range(60)]  # copies of a query's vector: ties
    rows += [(7, rows[7][1]), (None, rows[9][1]), (2000, None), (2020, [0.0] * size), (2040, [1.0] * (size - 1) + [None]), (2060, [float("nan")] * size), (2080, [float("inf")] * size), (2100, []), (2120, [2.0, 1.0])]
    return rows


def test_neighbours_equal_plain(spark):
    rows = embedded()
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id bigint, embedding array<float>, id int").repartition(4)
    got = {tuple(r) for r in ann.search(df, F.col("id") % 20 == 0).collect()}
    assert got == exact(rows)


def test_neighbours_of_nothing(spark):
    assert ann.search(spark.createDataFrame([], "vec_id bigint, embedding array<float>"), F.col("id") % 20 == 0).collect() == []
    one = spark.createDataFrame([(20, [1.0, 0.0])], "vec_id bigint, embedding array<double>")
    assert ann.search(one, F.col("id") % 20 == 0).collect() == []


def test_neighbours_by_parts(spark):
    rows = embedded(n=1500, size=16)
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").repartition(4)
    got = [tuple(r) for r in ann.search(df, F.col("id") % 20 == 0, part_rows=200, sample=800).collect()]
    want = exact(rows)
    assert len(got) == len(want)
    assert len({g[::2][:2] for g in got} & {w[::2][:2] for w in want}) >= 0.9 * len(want)


def test_parts_are_balanced_and_cut_little():
    near = np.array([[(i // 50) * 50 + (i + d) % 50 for d in (1, 2, 3, 7)] for i in range(400)])
    part = ann.balanced(near, 8)
    assert np.bincount(part, minlength=8).tolist() == [50] * 8
    assert (part[near] == part[:, None]).mean() > 0.9


def plain_phrases(rows, least, most=2000, longest=5):
    f, n = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        lower = "".join(chr(ord(x) + 32) if "A" <= x <= "Z" else x for x in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower):
            w = [x for x in re.split(r"[\x20\x09]+", piece) if x]
            n[lang] += len(w)
            f.update((lang, *w[i : i + m]) for m in range(1, longest + 1) for i in range(len(w) - m + 1))
    found = {k: v for k, v in f.items() if v >= least and len(k) > 2}
    out = []
    for k, a in found.items():
        words, lang = k[1:], k[0]
        if any(x[0] == lang and len(x) > len(k) and v >= a and any(x[1 + i : 1 + i + len(words)] == words for i in range(len(x))) for x, v in found.items()):
            continue
        cuts = [(1000 * a * n[lang] // (f[k[: 1 + c]] * f[(lang, *words[c:])]), c, f[k[: 1 + c]], f[(lang, *words[c:])]) for c in range(1, len(words))]
        score, _, left, right = min(cuts)
        out.append((lang, " ".join(words), a, left, right, n[lang], score))
    got = []
    for lang in n:
        best = sorted((x for x in out if x[0] == lang), key=lambda x: (-x[6], -x[2], x[1].encode()))[:most]
        got += [(x[0], i, *x[1:]) for i, x in enumerate(best, 1)]
    return sorted(got)


def prose(seed=9):
    r = random.Random(seed)
    vocab = ["the", "The", "of", "AND", "Über", "ñu", "stone", "a\x00b", "lake\t", "x;", "y.", "z\x0bw", "rare%d"]
    rows = [(" ".join((lambda w: w % r.randrange(10**6) if "%" in w else w)(r.choice(vocab)) for _ in range(r.randrange(0, 120))), r.choice(["en", "de", None, "und"])) for _ in range(120)]
    return rows + [(None, "en"), ("", "fr"), (" \n ", None), ("one fixed phrase here now again", "de")] + [("one fixed phrase here now again! the of", "de")] * 9


@pytest.mark.parametrize(("hot", "chunk"), [(10**6, 1 << 20), (40, 600), (0, 2000)])
def test_phrases_equal_plain(spark, monkeypatch, hot, chunk):
    monkeypatch.setattr(phrases, "CHUNK", chunk)
    monkeypatch.setattr(phrases, "BUCKET_BYTES", 3000)
    rows = prose()
    df = spark.createDataFrame([(t, x, 1, 2) for t, x in rows], "text string, lang string, word int, ids int").repartition(3)
    got = sorted(tuple(r) for r in phrases.collocations(df, least=6, most=50, hot=hot).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())
    assert got == plain_phrases(rows, 6, 50)
    assert len(got) > 60


def test_phrases_of_nothing(spark):
    assert phrases.collocations(spark.createDataFrame([], "text string, lang string")).collect() == []
    assert phrases.collocations(spark.createDataFrame([(None, None), ("a b", "en")], "text string, lang string")).collect() == []


def test_texts_without_letters_are_und():
    from lodestone.llm import langid

    assert [langid.has_letter(x) for x in ("½", "²", "Ⅷ", "12 _", "", "aß", "日", "ª")] == [False, False, False, False, False, True, True, True]


def test_removed_lines_are_the_rows_own(spark):
    from lodestone.llm import quality

    shared = "this very line stands everywhere"
    rows = [(i, f"{shared}\nown words of {'abcdefghij'[i % 10]} {'klm' * (i + 1)}", "h") for i in range(40)]
    rows += [(None, shared + "\nnull one", "h"), (None, "other text alone", "h"), (3, "again three", "h")]
    out = quality.clean(spark.createDataFrame(rows, "doc_id bigint, text string, source string"), min_docs=5, min_share=0.2).collect()
    assert {r["text"] if "text" in r else r["clean_text"]: len(r["removed_lines"]) for r in out if r["doc_id"] is None} == {shared + "\nnull one": 1, "other text alone": 0}
    assert sorted(len(r["removed_lines"]) for r in out if r["doc_id"] == 3) == [0, 1]


def test_far_path_is_linear_in_copies(spark, monkeypatch):
    from lodestone.llm import decontaminate

    monkeypatch.setattr(decontaminate, "BROADCAST_GRAMS", 0)
    text = " ".join(f"w{i}" for i in range(40))
    docs = spark.createDataFrame([(1, text)] * 800 + [(2, text + " more"), (3, "clean")], "doc_id bigint, text string")
    items = spark.createDataFrame([("a", text)], "item_id string, text string")
    got = decontaminate.scan(docs, items)
    assert got.groupBy("doc_id", "n_hit", "n_items").count().orderBy("doc_id").collect() == [(1, 40, 1, 800), (2, 40, 1, 1), (3, 0, 0, 1)]


def test_checkpoints_are_freed(spark):
    from pathlib import Path

    from lodestone.llm import common

    root = Path(common.scratch_root(spark).removeprefix("file://"))
    files = lambda: {p for p in root.rglob("part-*")}
    before = files()
    keep = common.scratch(spark, "kept")
    with common.freed(spark, keep):
        common.checkpointed(spark.range(5)).write.parquet(keep)
        assert len(files() - before) > 1
    assert {str(p.parent).rsplit("/", 1)[1] for p in files() - before} == {keep.rsplit("/", 1)[1]}
