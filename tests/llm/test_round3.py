"""Whitening, sharding and periodic runs: brute force and odd rows."""

from __future__ import annotations

import hashlib
import random
import time
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.conftest import words
from tidemark.llm import decontam, html, queries, repeats, sharding, substring, whitening
from tidemark.llm.frames import table

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


# Whitening


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>")


def brute_whitening(rows, components=4):
    """By fractions, from the contract's words: rows of (vec_id, component, n, deviation, |whitened|, explained)."""
    good = [(i, [int(np.floor(256 * np.float64(c))) for c in v]) for i, v in rows if v and all(c is not None and np.isfinite(c) for c in v)]
    fit = [list(x) for x in {tuple(x) for _, x in good}]
    n, d = len(fit), len(fit[0])
    s = [sum(x[j] for x in fit) for j in range(d)]
    v = np.array([[float(sum((Fraction(x[a]) - Fraction(s[a], n)) * (Fraction(x[b]) - Fraction(s[b], n)) for x in fit) / n) for b in range(d)] for a in range(d)])
    e, u = np.linalg.eigh(v)
    out = []
    for i, x in good:
        deviation = sum((n * x[j] - s[j]) ** 2 for j in range(d))
        centred = np.array([float(Fraction(x[j]) - Fraction(s[j], n)) for j in range(d)])
        for k in range(min(components, d)):
            out.append((i, k + 1, n, deviation, abs(centred @ u[:, d - 1 - k]) / np.sqrt(e[d - 1 - k]), e[d - 1 - k] / np.trace(v)))
    return sorted(out)


@pytest.mark.parametrize("offset", [0.0, 3e9])
def test_whitening_follows_fractions(spark, offset):
    r = random.Random(8)
    rows = [(i, [offset + r.gauss(0, 3 - 0.3 * j) for j in range(6)]) for i in range(150)]
    rows += [(200, rows[3][1]), (3, rows[3][1]), (201, None), (202, [0.0, None, 1.0, 1.0, 1.0, 1.0]), (203, [float("nan")] * 6), (204, [float("inf")] + [0.0] * 5)]
    got = whitening.whitened_embeddings(vectors(spark, rows)).collect()
    expected = brute_whitening(rows)
    assert len(got) == len(expected) and got[0].identity_error < 1e-9 and len({x.identity_error for x in got}) == 1
    signs = Counter()
    for x, y in zip(sorted(got, key=lambda x: (x.vec_id, x.component)), expected, strict=True):
        assert (x.vec_id, x.component, x.n, x.deviation, int(x.deviation_wide)) == (*y[:4], y[3])
        assert abs(x.whitened) == pytest.approx(y[4], rel=1e-6, abs=1e-6) and x.explained == pytest.approx(y[5], rel=1e-9)
        signs[x.component] += x.whitened
    assert all(abs(s) < 5 for s in signs.values())  # centred, so one sign for all rows


def test_whitening_odd_vectors(spark):
    assert whitening.whitened_embeddings(vectors(spark, [])).collect() == []
    assert whitening.whitened_embeddings(vectors(spark, [(1, None), (2, []), (3, [None])])).collect() == []
    # One vector has no spread; vectors of another dimension don't count.
    got = whitening.whitened_embeddings(vectors(spark, [(1, [1.0, 2.0]), (None, [1.0, 2.0]), (2, [-0.0, 0.0]), (3, [5.0])])).collect()
    assert Counter((x.vec_id, x.component, x.n) for x in got) == Counter((i, k, 2) for i in (1, None, 2) for k in (1, 2))
    assert all((x.whitened is None) == (x.component == 2) for x in got)
    alone = whitening.whitened_embeddings(vectors(spark, [(1, [1.0])])).collect()
    assert [(x.component, x.deviation, x.whitened, x.explained, x.identity_error) for x in alone] == [(1, 0, None, None, None)]
    # Entries beyond a long become its ends, and deviations beyond one are given in full only.
    far = whitening.whitened_embeddings(vectors(spark, [(1, [1e30, 0.0]), (2, [-1e30, 0.0]), (3, [0.0, 1.0])])).collect()
    assert {x.vec_id: x.deviation for x in far} == {1: None, 2: None, 3: (1 + 0) ** 2 + (3 * 256 - 256) ** 2}


def test_residues_are_exact():
    r = random.Random(2)
    for bound in (5, 10**9, 2**126):
        moduli = whitening.primes(2 * bound)
        values = [r.randint(-bound, bound) for _ in range(50)] + [bound, -bound, 0]
        residues = np.array([[v % p for v in values] for p in moduli])
        assert whitening.remaindered(residues, moduli) == values


def test_query_whitens_all_embeddings(spark):
    got = queries.op11_embedding_whitening(spark, SF).collect()
    rows = [(r.vec_id, [float(c) for c in r.embedding]) for r in table(spark, SF, "embeddings").collect()]
    x = np.floor(256 * np.array([v for _, v in rows]))
    fit = np.unique(x, axis=0)
    e, u = np.linalg.eigh(np.cov(fit.T, bias=True))
    w = {i: np.abs((row - fit.mean(0)) @ u[:, ::-1][:, :4] / np.sqrt(e[::-1][:4])) for (i, _), row in zip(rows, x, strict=True)}
    assert len(got) == 4 * len(rows) and {r.n for r in got} == {len(fit)} and got[0].identity_error < 1e-9
    assert all(abs(r.whitened) == pytest.approx(w[r.vec_id][r.component - 1], abs=1e-7) for r in got)


# Sharding


def brute_shards(rows, shards):
    """(doc_id, text, source) rows to a list of (row, shard, slot): fractional ranks of a shuffled order, cut."""
    by_source = {}
    for row in rows:
        crc = zlib.crc32((row[1] or "").encode())
        key = hashlib.md5(f"20240:{'-' if row[0] is None else row[0]}:{crc}".encode()).hexdigest()
        by_source.setdefault(row[2], []).append((key, row[0], crc, len((row[1] or "").encode()) + 8))
    placed = []
    for source, held in by_source.items():
        for rank, item in enumerate(sorted(held, key=lambda x: x[0])):
            placed.append((Fraction(2 * rank + 1, 2 * len(held)), "" if source is None else "=" + source, rank, item))
    placed.sort(key=lambda x: x[:3])
    out, slots = [], Counter()
    for place, (_, _, _, (_, doc_id, crc, size)) in enumerate(placed):
        shard = place * shards // len(placed)
        out.append((doc_id, size, crc, shard, slots[shard]))
        slots[shard] += 1
    return out


def shards_of(rows):
    return Counter((r.doc_id, r.size, r.text_crc32, r.shard, r.slot) for r in rows)


def test_shards_follow_brute_force(spark):
    r = random.Random(9)
    rows = [(i, words(r, r.randint(0, 5)), r.choice(["a", "a", "a", "b", "c", None]), "en", 0) for i in range(700)] + [(5, "same", "a", "en", 0)] * 40
    docs = spark.createDataFrame([(i, t, lang, s, n) for i, t, s, lang, n in rows], DOCS)
    got = sharding.sharded_documents(docs).collect()
    assert shards_of(got) == Counter(brute_shards([x[:3] for x in rows], 24))
    counts = Counter(x.shard for x in got)
    assert set(counts) == set(range(24)) and max(counts.values()) - min(counts.values()) <= 1
    for source in ("a", "b", None):  # every shard holds the mixture
        mine = Counter(x.shard for x in got if x.source == source)
        assert all(abs(mine[s] - sum(mine.values()) / 24) < 2 for s in range(24))


def test_shards_of_odd_rows(spark, odd_docs, clashing_docs, no_docs):
    got = sharding.sharded_documents(odd_docs).collect()
    assert shards_of(got) == Counter(brute_shards([(r.doc_id, r.text, r.source) for r in odd_docs.collect()], 24))
    assert {(r.law, r.grown_shard) for r in got} == {("rows", None)}
    assert shards_of(sharding.sharded_documents(clashing_docs.withColumn("shard", F.lit("x")).withColumn("part", F.lit(1))).collect()) == shards_of(got)
    assert sharding.sharded_documents(no_docs).collect() == []


def test_written_shards_come_back(spark, odd_docs, tmp_path):
    sharding.write_shards(odd_docs, f"file://{tmp_path}/shards", 3, tasks=4)
    back = spark.read.parquet(f"file://{tmp_path}/shards")
    assert Counter(map(str, back.select(*odd_docs.columns).collect())) == Counter(map(str, odd_docs.collect()))
    held = sorted((r.shard, r.slot) for r in back.collect())
    assert held == [(s, k) for s, n in enumerate((5, 5, 4)) for k in range(n)]


# Periodic runs


def brute_runs(w):
    found = {}
    for q in range(1, len(w) // 4 + 1):
        i = 0
        while i + q < len(w):
            start = i
            while i + q < len(w) and w[i] == w[i + q]:
                i += 1
            if i > start and i + q - start >= max(6, 4 * q):
                found.setdefault((start, i + q), q)
            i += i == start
    return sorted((s, e - s, q) for (s, e), q in found.items())


def brute_digest(doc_id, text):
    w = [x for x in (text or "").encode().split()]
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    g, n = h // 10, len(w)
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = brute_runs(w)
    dropped = {i for s, length, q in runs for i in range(s + q, s + length)}
    best = min(((-length, s, q) for s, length, q in runs), default=None)
    top = (best[1], -best[0], best[2], -1000 * best[0] // best[2]) if best else (None,) * 4
    sha = lambda b: hashlib.sha256(b).hexdigest()
    lines = "".join(f"{s},{length},{q}\n" for s, length, q in runs)
    return (doc_id, len(runs), *top, sha(lines.encode()), sha(b" ".join(x for i, x in enumerate(w) if i not in dropped)))


@pytest.mark.parametrize("seed", range(3))
def test_runs_follow_brute_force(seed):
    r = random.Random(seed)
    for _ in range(300):
        n, k = r.randint(0, 70), r.choice([1, 2, 3, 6])
        w = [r.randrange(k) for _ in range(n)]
        if n > 4 and r.random() < 0.6:
            a = r.randrange(n)
            p = 1 + (n - a) // r.randint(3, 10)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        assert list(zip(*(x.tolist() for x in repeats.maximal_runs(np.array(w, dtype=np.int64))), strict=True)) == brute_runs(w)


def test_leaves_are_tried_in_pieces(monkeypatch):
    r = random.Random(4)
    w = np.array([r.randrange(2) for _ in range(3000)])
    whole = [x.tolist() for x in repeats.maximal_runs(w)]
    monkeypatch.setattr(repeats, "LEAVES", 7)
    assert [x.tolist() for x in repeats.maximal_runs(w)] == whole
    assert list(zip(*whole, strict=True)) == brute_runs(w.tolist())


def test_run_digests(spark, odd_docs, clashing_docs, no_docs):
    r = random.Random(6)
    texts = {i: words(r, r.randint(0, 60)) for i in range(100, 250)}
    texts |= {1: "a b " * 9 + "c", 2: "x" + " y" * 8 + "\n\ty", 3: "A a " * 6, 4: "k " * 5, 5: "a b c d e f g h " * 6 + "a b", 6: " ".join("ab" * 3 + "ab" * 5)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {tuple(x) for x in repeats.run_digests(docs).collect()}
    assert got == {brute_digest(i, t) for i, t in texts.items()}
    odd = Counter(tuple(x) for x in repeats.run_digests(odd_docs).collect())
    assert odd == Counter(brute_digest(x.doc_id, x.text) for x in odd_docs.collect() if x.doc_id != 4) + Counter(
        k for k in odd if k[0] == 4
    )
    assert odd == Counter(tuple(x) for x in repeats.run_digests(clashing_docs.withColumn("runs", F.lit(1))).collect())
    assert repeats.run_digests(no_docs).collect() == []


def test_run_query_on_all_documents(spark):
    docs = {r.doc_id: r.text for r in table(spark, SF, "documents").collect()}
    got = {r.doc_id: tuple(r) for r in queries.op13_periodic_runs(spark, SF).collect()}
    assert len(got) == len(docs)
    short = [i for i, t in docs.items() if len(t.split()) < 400]
    assert len(short) > 100 and all(got[i] == brute_digest(i, docs[i]) for i in short)
    assert sum(got[i][1] > 0 for i in short) > 5


# Passages of op3


def as_docs(spark, texts):
    return spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], DOCS)


def removed_rows(spark, texts):
    return {tuple(x)[:4] for x in substring.passages(as_docs(spark, texts)).where("removed").collect()}


def test_units_of_several_owners_are_no_passage(spark):
    r = random.Random(21)
    stock = [words(r, 6) for _ in range(5)]
    holders = ["\n".join([words(r, 30), line, words(r, 30)]) for line in stock]
    unique = [words(r, 10) for _ in range(2)]
    gaps = "\n".join([words(r, 20), stock[0], unique[0], stock[1], unique[1], stock[2], words(r, 20)])
    adjacent = "\n".join([words(r, 20), *stock, words(r, 20)])
    texts = [*holders, gaps, adjacent]
    assert removed_rows(spark, texts) == set()
    assert {x.text for x in substring.remove_passages(as_docs(spark, texts)).collect()} == set(texts)


def test_gaps_count_as_edits(spark):
    r = random.Random(22)
    a, b, c, d = (words(r, n) for n in (30, 25, 8, 9))
    short = [words(r, 9) for _ in range(3)]
    texts = [
        ". ".join([words(r, 20), a, c, b, words(r, 20)]) + ".",
        "\n".join([words(r, 20), *short, words(r, 20)]),
        ". ".join([words(r, 15), a, d, b, words(r, 20)]) + ".",  # a changed sentence of 9 words in 63
        "\n".join([words(r, 15), short[0], words(r, 9), short[1], words(r, 9), short[2], words(r, 20)]),  # 18 changed in 45
        ". ".join([words(r, 15), b, words(r, 40), a, words(r, 20)]) + ".",  # another order, and far apart
    ]
    assert removed_rows(spark, texts) == {(2, 15, 30 + 9 + 25, 0), (4, 15 + 25 + 40, 30, 0)}


def test_longer_passages_of_later_owners(spark):
    r = random.Random(23)
    run = words(r, 50).split()
    texts = [f"{words(r, 20)} {' '.join(run[:40])} {words(r, 20)}", f"{words(r, 20)} {' '.join(run)} {words(r, 20)}", f"{words(r, 30)} {' '.join(run)} {words(r, 20)}"]
    rows = removed_rows(spark, texts)
    assert {x for x in rows if x[3] == 0} == {(1, 20, 40, 0), (2, 30, 40, 0)}
    lost = {d: set() for d in (1, 2)}
    for doc, start, n, _ in rows:
        lost[doc] |= set(range(start, start + n))
    assert lost == {1: set(range(20, 60)), 2: set(range(30, 80))}


# Broken and unusual markup of op1

TEXT = "this is one of the things that we had for a long time and it was what they all have been"
OTHER = "there is more to it than that, which is what you would have from some of them when we were in it"


@pytest.mark.parametrize(
    "shape",
    ["<div>" * 60_000 + "</p>" * 60_000, "<a " * 300_000, '<b a="' * 160_000, '<span class="ad">x' * 60_000, "<p>x</p>" + '<b a="' * 160_001 + ">", "<!-- x" * 150_000],
)
def test_broken_markup_takes_linear_time(shape):
    began = time.process_time()
    html.main_text(shape)
    assert len(shape) > 500_000 and time.process_time() - began < 5


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (f"<article><p>{TEXT} <span class='ad'>cheap</p><p>{OTHER}</p></article>", f"{TEXT}\n\n{OTHER}"),
        (f"<article><span class='ad'>cheap<p>{TEXT}</p><p>{OTHER}</p></article>", f"{TEXT}\n\n{OTHER}"),
        (f"<p>{TEXT} <span class='ad'>a <span>b</span> cheap pills</span> end</p>", f"{TEXT} end"),
        (f"<p>{TEXT} <b class='ad'>buy</b> <em>end</em></p>", f"{TEXT} end"),
        (f"<div>{TEXT}<span class='ad'><div>Buy now</div> cheap</span></div><p>{OTHER}</p>", f"{TEXT}\n\n{OTHER}"),
        (f"<article><header><h1>Head</h1><p>By A</p><p>{TEXT}</p></header><p>{OTHER}</p></article>", f"Head\n\n{TEXT}\n\n{OTHER}"),
        (f"<header><p>{TEXT}</p></header><p>{OTHER}</p>", OTHER),
        (f"<p>{OTHER}</p><a href='x", OTHER),
        (f"<p>{OTHER} 1 < 2 <3</p>", f"{OTHER} 1 < 2 <3"),
    ],
)
def test_markup_that_names_boilerplate(page, text):
    assert html.main_text(page) == text


def test_short_items_tell_their_words(spark):
    docs = spark.createDataFrame([(1, "well is it so"), (2, "this item"), (3, None)], "doc_id long, text string")
    items = spark.createDataFrame([(7, "is it"), (7, "is it"), (8, None)], "item_id long, text string")
    got = [tuple(r) for r in decontam.contaminated(docs, items).collect()]
    assert got == [(1, 7, 1, 2, 0, True)]
    assert decontam.contaminated(docs, items.limit(0)).collect() == []
