"""Operators against brute force, round trips and held-out accuracy."""

from __future__ import annotations

import base64
import hashlib
import itertools
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.conftest import words
from tidemark.llm import decontam, html, jaccard, mixing, quality, substring, textkit, tokencount, toxicity, warc

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def as_docs(spark, texts, source="s"):
    return spark.createDataFrame([(i, t, "en", source, len(t)) for i, t in enumerate(texts)], DOCS)


def near_copies(r, base, n, edits):
    out = []
    for _ in range(n):
        w = base.split()
        for _ in range(r.randint(0, edits)):
            w[r.randrange(len(w))] = words(r, 1)
        out.append(" ".join(w))
    return out


def shingles(text, k):
    w = re.findall(rb"[^\x20\x09-\x0D]+", text.encode().lower())
    return {tuple(w)} if 0 < len(w) < k else {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}


def brute_components(texts, k, percent):
    sets = [shingles(t, k) for t in texts]
    top = list(range(len(texts)))
    for a, b in itertools.combinations(range(len(texts)), 2):
        both = len(sets[a] & sets[b])
        if sets[a] and sets[b] and 100 * both >= percent * len(sets[a] | sets[b]):
            lo, hi = sorted((top[a], top[b]))
            top = [lo if x == hi else x for x in top]
    return top


@pytest.mark.parametrize(("k", "percent", "seed"), [(4, 85, 1), (5, 80, 2)])
def test_jaccard_components(spark, k, percent, seed):
    r = random.Random(seed)
    texts = [words(r, r.randint(1, 90)) for _ in range(25)]
    for size, edits in ((30, 7), (12, 4), (8, 12)):  # groups on both sides of the threshold
        texts += near_copies(r, words(r, 150), size, edits)
    texts += [texts[3], texts[3].upper(), "", " ", "a b", "a  b"]
    r.shuffle(texts)
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in jaccard.jaccard_components(as_docs(spark, texts), k, percent).collect()}
    expected = brute_components(texts, k, percent)
    assert got == {i: (len(shingles(t, k)), expected[i]) for i, t in enumerate(texts)}


def test_keep_one(spark):
    r = random.Random(4)
    base = words(r, 120)
    texts = [words(r, 50), base, *near_copies(r, base, 5, 1), words(r, 60)]
    kept = {x.doc_id for x in jaccard.keep_one(as_docs(spark, texts), 5, 80).collect()}
    assert kept == {0, 1, len(texts) - 1}


def test_word_hashes_follow_split():
    r = random.Random(3)
    for _ in range(50):
        data = bytes(r.choice(b"ab \t\n\x0b\x0c\r\xc3\xa9") for _ in range(r.randint(0, 80)))
        got = textkit.word_hashes(data)
        parts = data.split()
        assert len(got) == len(parts)
        assert len(set(got.tolist())) == len(set(parts))


def test_long_texts_are_hashed_alike():
    text = b" ".join(b"w%d" % i for i in range(500_000))
    assert len(text) > 2 * textkit.PIECE
    assert np.array_equal(textkit.word_hashes(text)[:1000], textkit.word_hashes(text[:20_000])[:1000])


def test_substring_dedup(spark):
    r = random.Random(6)
    passage = ". ".join(words(r, 12).capitalize() for _ in range(6)) + "."
    edited = " ".join(w if i != 40 else "changed" for i, w in enumerate(passage.split()))
    line = words(r, 90)
    near = " ".join(w if i != 45 else "changed" for i, w in enumerate(line.split()))
    clean = [words(r, 100) + "." for _ in range(4)]
    texts = [clean[0] + " " + passage + " " + words(r, 30), *clean[1:], words(r, 40) + ". " + passage + " " + words(r, 10), "a.\n" + line, "b.\n" + near + "\nend.", edited]
    docs = as_docs(spark, texts)
    got = substring.passages(docs).collect()
    assert {(x.doc_id, x.removed, x.first_doc_id) for x in got if x.removed} == {(4, True, 0), (6, True, 5), (7, True, 0)}
    assert {x.doc_id for x in got if not x.removed} == {0, 5, 4} & {x.doc_id for x in got if not x.removed} | {0, 5}
    left = {x.doc_id: x for x in substring.remove_passages(docs).collect()}
    assert passage.split(". ")[2] not in left[4].text and passage in left[0].text
    assert near not in left[6].text and left[6].text.endswith("end.")
    assert all(left[i].text == texts[i] for i in (0, 1, 2, 3, 5))
    assert all(x.n_chars == len(x.text) for x in left.values())


def test_substring_dedup_inside_sentences(spark):
    r = random.Random(16)
    bare, cut = words(r, 60), ". ".join(words(r, 20) for _ in range(4)).split()[7:57]
    changed = [w if i != 30 else "changed" for i, w in enumerate(bare.split())]
    texts = [f"{words(r, 40)} {bare} {words(r, 30)}", f"{words(r, 25)} {' '.join(cut)} {words(r, 9)}"]
    texts += [f"{words(r, 33)} {bare} {words(r, 50)}", f"{words(r, 21)} {' '.join(cut)} {words(r, 60)}"]
    texts += [f"{words(r, 70)} {' '.join(changed[6:56])} {words(r, 40)}", words(r, 200)]
    got = {(x.doc_id, x.start_word, x.n_words, x.first_doc_id, x.removed) for x in substring.passages(as_docs(spark, texts)).collect()}
    removed = {(2, 33, 60, 0, True), (3, 21, 50, 1, True), (4, 70, 50, 0, True)}
    assert got == removed | {(0, 40, 60, 0, False), (1, 25, 50, 1, False)}


def test_units_with_edits_at_any_place(spark):
    """Lines and sentences of 10 to 90 words with a word changed, added or dropped: the links of brute force are found."""
    r = random.Random(18)
    texts = []
    for n in (8, 10, 30, 48, 49, 90):
        for _ in range(6):
            w = words(r, n).split()
            texts.append(w)
            for at in (0, n // 2, n - 1):
                texts += [w[:at] + ["changed"] + w[at + 1 :], w[:at] + w[at + 1 :], w[:at] + ["more"] + w[at:]]
    texts = [" ".join(w) for w in texts]
    for inner in (False, True):  # lines, and sentences inside lines
        texts = [t + "." * inner for t in texts]
        expected = brute_components(texts, 5, 80)
        docs = as_docs(spark, [f"{words(r, 9)}. {t} {words(r, 9)}." if inner else t for t in texts])
        found = substring.units(docs).select("id", "key", "words", F.size("buckets").alias("n_buckets"), F.explode("buckets").alias("bucket"))
        met = found.where(F.col("words") >= substring.BANDED_WORDS)
        top = {x.id: x.component for x in substring.unit_components(docs, met).collect()}
        keys = [int(substring.run_hashes(h, *np.array([[0], [len(h)]])).view(np.int64)[0]) for h in (textkit.word_hashes(t.encode()) for t in texts)]
        got = [top.get(k, k) for k in keys]
        linked = sum(e != i for i, e in enumerate(expected))
        caught = sum(got[i] == got[e] for i, e in enumerate(expected) if e != i)
        assert caught >= 0.95 * linked and linked > 200
        wrong = [i for i, j in itertools.combinations(range(len(texts)), 2) if got[i] == got[j] and expected[i] != expected[j]]
        assert not wrong


def test_lists_of_short_lines(spark):
    r = random.Random(20)
    lines = [words(r, 3) for _ in range(14)]
    texts = ["\n".join([words(r, 20), *lines, words(r, 20)]), words(r, 60), "\n".join([words(r, 31), *lines])]
    got = [tuple(x) for x in substring.passages(as_docs(spark, texts)).where("removed").collect()]
    assert got == [(2, 31, 42, 0, True)]


def test_shared_runs_are_covered(spark):
    r = random.Random(17)
    pool = [words(r, n).split() for n in (30, 31, 35, 47, 90)]
    texts = []
    for _ in range(40):
        run = r.choice(pool)
        texts.append(words(r, r.randint(0, 80)).split() + run + words(r, r.randint(0, 80)).split())
    got = {}
    for x in substring.passages(as_docs(spark, [" ".join(t) for t in texts])).where("removed").collect():
        got.setdefault(x.doc_id, set()).update(range(x.start_word, x.start_word + x.n_words))
    seen, expected = set(), {}
    for d, t in enumerate(texts):
        grams = [tuple(t[i : i + 30]) for i in range(len(t) - 29)]
        held = {i + k for i, g in enumerate(grams) if g in seen for k in range(30)}
        seen.update(grams)
        expected |= {d: held} if held else {}
    assert got == expected


def test_contamination(spark):
    r = random.Random(8)
    items = [(i, words(r, 30)) for i in range(20)]
    texts, expected = [], set()
    for d in range(40):
        text = words(r, 200)
        if d % 2:
            i, item = r.choice(items)
            chars = list(item)
            for _ in range(len(chars) // 25 if d % 4 == 1 else 0):
                chars[r.randrange(len(chars))] = "z"
            at = r.randrange(len(text))
            text = f"{text[:at]} {''.join(chars).upper() if d % 3 else ''.join(chars)}\n {text[at:]}"
            expected.add((d, i))
        texts.append(text)
    bench = spark.createDataFrame(items, "item_id long, text string")
    docs = as_docs(spark, texts)
    assert {(x.doc_id, x.item_id) for x in decontam.contaminated(docs, bench).collect()} == expected
    kept = {x.doc_id for x in decontam.clean_documents(docs, bench).collect()}
    assert kept == set(range(40)) - {d for d, _ in expected}


def test_contamination_in_passes(spark, monkeypatch):
    monkeypatch.setattr(decontam, "PASS_BYTES", 400)
    r = random.Random(9)
    items = [(i, words(r, 25)) for i in range(10)]
    docs = as_docs(spark, [words(r, 30) + " " + t for _, t in items])
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert {(x.doc_id, x.item_id) for x in decontam.contaminated(docs, bench).collect()} == {(i, i) for i in range(10)}


def brute_window_edits(item, text, chars):
    """The fewest edits between a window of the item and any region of the text."""
    best = chars
    for i in range(len(item) - chars + 1):
        row = [0] * (len(text) + 1)
        for a in range(1, chars + 1):
            last, row[0] = row[0], a
            for b in range(1, len(text) + 1):
                last, row[b] = row[b], min(last + (item[i + a - 1] != text[b - 1]), row[b] + 1, row[b - 1] + 1)
        best = min(best, min(row))
    return best


def test_contamination_equals_brute_force(monkeypatch):
    monkeypatch.setattr(decontam, "LEAST_CHARS", 40)
    monkeypatch.setattr(decontam, "PIECE_PAIRS", 64)
    r = random.Random(21)
    hits = 0
    for case in range(60):
        item = words(r, 12)[: r.choice((30, 40, 60))]
        part = list(item[r.randint(0, 8) :] if case % 3 else item)
        for _ in range(r.randint(0, 5)):
            at = r.randrange(len(part))
            part[at : at + 1] = r.choice(([], ["z"], [part[at], "q"]))
        if case % 7 == 0:
            part = list("a" * 60) if case % 2 else list(item[:22])
        text = decontam.normal(f"{words(r, 3)}{''.join(part)}{words(r, 4)}").decode()
        index = decontam.Items([(1, item), (2, "zz"), (3, "a" * 45)])
        chars = min(40, len(decontam.normal(item)))
        within = brute_window_edits(decontam.normal(item).decode(), text, chars) <= decontam.edit_budget(chars)
        assert (0 in {m[0] for m in index.matches(text)}) == within, (item, text)
        hits += within
    assert 15 < hits < 55
    assert decontam.Items([(7, "ab c")]).exact_words(b"x ab c y") == [(7, 2)] and not decontam.Items([(7, "ab c")]).exact_words(b"xab c y")


def test_banded_score_equals_full_alignment():
    r = random.Random(2)
    for _ in range(40):
        a, b = ("".join(r.choice("abc") for _ in range(r.randint(5, 25))) for _ in range(2))
        best, rows = 0, [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a, 1):
            for j, y in enumerate(b, 1):
                hit = decontam.GAIN if x == y else -decontam.LOSS
                rows[i][j] = max(0, rows[i - 1][j - 1] + hit, rows[i - 1][j] - decontam.LOSS, rows[i][j - 1] - decontam.LOSS)
                best = max(best, rows[i][j])
        x, y = (np.frombuffer(t.encode(), dtype=np.uint8) for t in (a, b))
        score, start, end = decontam.banded_score(x, y, -len(a), len(a) + len(b) + 1)
        assert score == best and 0 <= start <= end <= len(b)


def test_unigram_counts_equal_the_tokenizer():
    tokenizers = pytest.importorskip("tokenizers")
    path = "/opt/tokenizers/piece_bpe_32k.model"
    vocabulary, _ = tokencount.load_vocabulary(path)
    low = min(s for _, s in vocabulary)
    r = random.Random(3)
    texts = ["", " ", "  a", "▁▁ a", "日本語 漢字かな", "😀😀 x😀", "zzzzqqqq\U0001f9ff\U0001f9ff"]
    texts += ["".join(r.choice("ab é😀▁ \n漢qzthe") for _ in range(40)) for _ in range(300)]
    for with_bytes in (True, False):
        extra = [f"<0x{i:02X}>" for i in range(256)] if with_bytes else []
        full = [(p, low) for p in ["<unk>", *extra]] + vocabulary
        model = tokenizers.models.Unigram(full, unk_id=0, byte_fallback=with_bytes)
        exact = tokenizers.Tokenizer(model)
        exact.pre_tokenizer = tokenizers.pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always", split=True)
        counter = tokencount.Counter(vocabulary, with_bytes)
        assert [counter.text(t) for t in texts] == [len(exact.encode(t, add_special_tokens=False).tokens) for t in texts]


def test_permutation():
    for n in (1, 2, 3, 7, 64, 1000):
        index = np.arange(n)
        for key in (1, -5):
            got = mixing.permuted(index, np.full(n, n), np.full(n, key))
            assert sorted(got.tolist()) == index.tolist()


def brute_targets(sizes, weights=(3, 1, 2)):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode("utf-32-be")))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, budget, target = set(names), 1.5 * sum(sizes.values()), {}
    while left:
        level = budget / sum(weight[s] for s in left)
        full = {s for s in left if level * weight[s] > 2 * sizes[s]}
        if not full:
            return target | {s: level * weight[s] for s in left}
        target |= {s: 2.0 * sizes[s] for s in full}
        budget -= sum(2.0 * sizes[s] for s in full)
        left -= full
    return target


def test_mixture(spark):
    r = random.Random(1)
    rows = [(i, words(r, r.randint(1, 300)), "en", r.choice(["a", "b", "b", "b", "é", None, "z"]), 1) for i in range(250)]
    docs = spark.createDataFrame(rows, DOCS)
    got = mixing.mixed_words(docs).collect()
    size = {i: len(t.split()) for i, t, *_ in rows}
    source = {i: s for i, _, _, s, _ in rows}
    sums: dict = {}
    for i, n in size.items():
        sums[source[i]] = sums.get(source[i], 0) + n
    target = brute_targets(sums)
    taken: dict = {}
    for x in got:
        assert (x["size"], x.source_size) == (size[x.doc_id], sums[source[x.doc_id]])
        assert abs(x.target - target[source[x.doc_id]]) < 1e-6 * max(1, x.target)
        assert x.taken <= 2 * x["size"]
        taken[source[x.doc_id]] = taken.get(source[x.doc_id], 0) + x.taken
    assert all(abs(taken[s] - target[s]) <= 2 * mixing.BLOCK_WORDS for s in target)
    assert sorted(map(tuple, got)) == sorted(map(tuple, mixing.mixed_words(docs.repartition(7)).collect()))
    blocks = mixing.mixed_blocks(docs).collect()
    assert sum(b.n_words for b in blocks) == sum(taken.values())
    assert all(len(b.text.split(" ")) == b.n_words <= mixing.BLOCK_WORDS for b in blocks)


def test_warc_splits_own_each_record_once(spark, tmp_path):
    pages = spark.createDataFrame(
        [(i, f"http://h/{i}", "<p>" + words(random.Random(i), 1 + i * 7 % 300) + "</p>") for i in range(300)] + [(900, None, "<p>x</p>"), (901, "u", "<p>x</p>")],
        "page_id long, url string, html string",
    )
    expected = {r.page_id: (r.html or "").encode() for r in pages.collect()}
    files = warc.write_archives(pages, f"file://{tmp_path}/w")
    for split in (500, 10_000, 1 << 20):
        got = warc.read_archives(files, split_bytes=split).collect()
        assert len(got) == len(expected)
        for r in got:
            page = int(r.record_id.removeprefix(warc.PAGE_URN))
            digest = base64.b32encode(hashlib.sha1(expected[page]).digest()).decode()
            assert (r.payload_bytes, r.payload_digest) == (len(expected[page]), digest)
            assert r.record_type == ("revisit" if page == 900 else "response")
            assert r.payload is None if page == 900 else bytes(r.payload) == expected[page]


def test_warc_reader_skips_false_magic(tmp_path):
    import pyarrow as pa

    good = warc.member(warc.record(1, "u", b"hello", 5, "D", None))
    data = b"junk" + warc.MAGIC + b"not gzip" + warc.member(b"plain text, no record") + good + warc.MAGIC
    path = tmp_path / "x.gz"
    path.write_bytes(data)
    for cut in range(1, len(data), 37):
        found = []
        for a, b in ((0, cut), (cut, len(data))):
            with pa.OSFile(str(path)) as f:
                found += [o for o, _ in warc.read_range(f, a, b)]
        assert found == [data.index(good)]


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>if (a < b) x = "</p>";</script></head>
<body class="has-sidebar"><header><a href="/">Site</a> slogan of the site</header><nav><ul><li><a href="/a">A</a><li><a href="/b">B</a></ul></nav>
<div id="cookie-notice">We use cookies on this site and you can be sure that they are good for all of us</div>
<main><article><header><h1>Title &amp; more</h1></header><p>First   paragraph with the &lt;b&gt; and <b>what</b> of it is.<p>Short.
<aside>An aside that is about the things of the day</aside><div class="ad">Buy the best of all</div><blockquote>q &eacute;&#233;&nbsp;x</blockquote></article>
<section class="comments"><p>A reader's comment, which is long and has the words that it takes to be text.</p></section></main>
<form><label>mail</label></form><footer>(c) of the site</footer></body></html>"""


def test_main_text():
    assert html.main_text(PAGE) == "Title & more\n\nFirst paragraph with the <b> and what of it is.\n\nShort.\n\nq éé x"


def test_main_text_without_article():
    page = (
        "<body><div class=menu><a href=1>a</a></div><div><h2>Head</h2><div>This is the long text of the page and it is about what was in "
        "the news for all of us to see.</div><div>Short one.</div><div><a href=x>next page</a> <a href=y>back</a></div></div></body>"
    )
    assert html.main_text(page) == (
        "Head\n\nThis is the long text of the page and it is about what was in the news for all of us to see.\n\nShort one."
    )


SAY = "It was the first of the days on which we were to see what is in the house, and all of us had been there for some time."


@pytest.mark.parametrize("name", ["no-sidebar", "content with-comments", "article-body ad-free", "post share-count", "related-story", "promo", "x"])
def test_names_only_weigh(name):
    page = f'<body><nav>a</nav><div class="{name}"><h1>Head</h1><p>{SAY}</p><p>{SAY} Twice.</p></div><footer>f</footer></body>'
    assert html.main_text(page) == f"Head\n\n{SAY}\n\n{SAY} Twice."


@pytest.mark.parametrize("name", ["sidebar", "comment-list", "cookie-notice", "ad", "post-comments", "relatedPosts widget", "newsletter_box", "adSlot"])
def test_named_boilerplate_goes(name):
    page = f'<body><article><p>{SAY}</p><div class="{name}"><p>{SAY} More.</p></div></article><div id="{name}">{SAY}</div></body>'
    assert html.main_text(page) == SAY


def test_attributes_with_apostrophes():
    page = f"<body><p title=it's>{SAY}</p><p data-x='a>b' y=\"c>'d\">{SAY} Two.</p><p title=it's>{SAY} Three.</p></body>"
    assert html.main_text(page) == f"{SAY}\n\n{SAY} Two.\n\n{SAY} Three."


def test_second_pass_equals_nearest_neighbours():
    r = random.Random(31)
    for _ in range(400):
        labels = [r.choice((True, False, None, None)) for _ in range(r.randint(0, 9))]
        headings, inside = [r.random() < 0.2 for _ in labels], r.random() < 0.4
        expected = []
        for i, label in enumerate(labels):
            left = next(((i - j, labels[j]) for j in range(i - 1, -1, -1) if labels[j] is not None), None)
            right = next(((j - i, labels[j]) for j in range(i + 1, len(labels)) if labels[j] is not None), None)
            if label is None:
                near = [x for x in (left, right) if x]
                if headings[i] and right:
                    label = right[1]
                elif near:
                    least = min(x[0] for x in near)
                    label = any(x[1] for x in near if x[0] == least)
                else:
                    label = True
                if inside and not (left and right and not left[1] and not right[1]):
                    label = True
            expected.append(label)
        assert html.pass_two(labels, headings, inside) == expected


def test_toxicity_on_held_out_rows(spark):
    r = random.Random(11)
    bad = ["vile", "awful", "nasty"]
    rows, marks = [], []
    for i in range(600):
        toxic, low = r.random() < 0.3, r.random() < 0.3
        text = words(r, 60).split() + (r.sample(bad, 2) if toxic else [])
        r.shuffle(text)
        rows.append((i, "### ".join(text) if low else " ".join(text), "en", "s", 1))
        marks.append((i, int(not low), int(toxic)))
    docs = spark.createDataFrame(rows, DOCS)
    labels = spark.createDataFrame(marks[:400], "doc_id long, quality int, toxic int")
    got = {x.doc_id: x for x in toxicity.score(docs, toxicity.fit_chain(docs, labels)).collect()}
    held = marks[400:]
    for name, truth in (("is_toxic", [t for _, _, t in held]), ("is_low_quality", [1 - q for _, q, _ in held])):
        right = sum(got[i][name] == bool(t) for (i, _, _), t in zip(held, truth, strict=True))
        assert right >= 0.97 * len(held)


def test_chain_equals_plain_loops():
    r = np.random.default_rng(5)
    vocabulary = textkit.mix(np.arange(1, 41, dtype=np.uint64))
    y = (r.random((120, 2)) < 0.4).astype(float)
    y[:, 1] = np.where(r.random(120) < 0.8, y[:, 0], y[:, 1])
    rows = [np.sort(vocabulary[(r.random(40) < 0.2 + 0.6 * y[i, 0] * (np.arange(40) < 3))]) for i in range(120)]
    style, folds = r.random((120, 4)), np.arange(120) % toxicity.FOLDS
    chain = toxicity.fit_arrays(["a", "b"], rows, style, y, folds)

    def inputs(chosen, train):
        mean, spread = style[train].mean(axis=0), style[train].std(axis=0)
        return np.array([[1.0, *((style[i] - mean) / spread), *(float(w in rows[i]) for w in chosen)] for i in range(120)])

    logit = lambda p: np.log(np.clip(p, 1e-4, 1 - 1e-4) / (1 - np.clip(p, 1e-4, 1 - 1e-4)))
    aside = np.zeros(120)
    for k in range(toxicity.FOLDS):
        train = np.flatnonzero(folds != k)
        chosen = toxicity.telling_words([rows[i] for i in train], y[train])
        x = inputs(chosen, train)
        w = toxicity.fit_linear(x[train], y[train, 0])
        for i in np.flatnonzero(folds == k):
            aside[i] = 1 / (1 + np.exp(-(x[i] @ w)))
    everything = np.arange(120)
    x = inputs(toxicity.telling_words(rows, y), everything)
    assert np.allclose(chain.weights[0], toxicity.fit_linear(x, y[:, 0]), atol=1e-6)
    assert np.allclose(chain.weights[1], toxicity.fit_linear(np.column_stack([x, logit(aside)]), y[:, 1]), atol=1e-4)
    assert len(chain.words) > 0


def test_quality_counts(spark):
    repeated = " ".join(f"w{i}" for i in range(10)) + " x " + " ".join(f"w{i}" for i in range(10))
    texts = [repeated, "a b\nc\na b\n\n \na b", "# $ <x> | &"]
    got = {x.doc_id: x for x in quality.quality_verdicts(as_docs(spark, texts)).collect()}
    assert (got[0].n_words, got[0].n_repeat_words, got[0].base_failed) == (21, 20, True)
    assert (got[1].n_dup_lines, got[1].word_chars) == (2, 7)
    assert got[2].n_symbols == 6


def test_depleted_documents(spark):
    r = random.Random(12)
    menu = "\n".join(words(r, 12) for _ in range(3))
    texts = [menu + "\n" + words(r, 10) for _ in range(40)] + [menu.split("\n")[0] + "\n" + words(r, 60)] + [words(r, 50)] * 40
    got = {x.doc_id: x.kept for x in quality.quality_verdicts(as_docs(spark, texts)).collect()}
    assert not any(got[i] for i in range(40)) and all(got[i] for i in range(40, 81))
    left = {x.doc_id: (x.text, x.n_chars) for x in quality.quality_filter(as_docs(spark, texts)).collect()}
    body = texts[40].split("\n")[1]
    assert left == {40: (body, len(body))} | {i: (texts[i], len(texts[i])) for i in range(41, 81)}


def test_pipeline_removes_frequent_lines(spark):
    import corpus_pipeline

    r = random.Random(19)
    menu, bodies = words(r, 12), [[words(r, 30), words(r, 20)] for _ in range(40)]
    texts = [f"{a}\n\n  {menu.upper()} \n{b}" for a, b in bodies] + [menu + "\n" + words(r, 10), words(r, 50)]
    docs = as_docs(spark, texts).union(as_docs(spark, [menu + "\n" + words(r, 40)], "other"))
    got = {(x.doc_id, x.source): (x.text, x.n_chars) for x in corpus_pipeline.quality_rules(spark, docs, SF).collect()}
    expected = {(i, "s"): f"{a}\n\n{b}" for i, (a, b) in enumerate(bodies)} | {(41, "s"): texts[41]}
    other = docs.where("source = 'other'").first().text
    assert got == {k: (v, len(v)) for k, v in (expected | {(0, "other"): other}).items()}


def test_pipeline_runs(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES][-1] == "source_mixture"
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, SF).cache()
        assert after.columns == docs.columns, name
        assert 0 < after.count() <= docs.count()
        docs = after
    assert corpus_pipeline.run(spark, SF).count() > 0
