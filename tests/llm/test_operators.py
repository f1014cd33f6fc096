"""Small cases of each operator: nulls, empty and long texts, ties, repeats, empty tables, clashing columns."""

import base64
import hashlib
import itertools
import math
import random
import re
import string
import textwrap
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from scrivena.llm import (
    chat_format,
    components,
    decontaminate,
    exact_dedup,
    html_extract,
    jaccard_join,
    language_id,
    license_scan,
    packing,
    quality,
    url_filter,
    words,
)

from scrivena.plans import staging

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
ASCII_LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def words_in(text):
    return WORD.findall((text or "").translate(ASCII_LOWER))


def documents(spark, rows, more=""):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string" + more)


def prose(rng, n, vocabulary=200):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


# words


def test_words_match_the_regex_across_blocks(monkeypatch):
    monkeypatch.setattr(words, "BLOCK_BYTES", 64)
    rng = random.Random(5)
    texts = ["", None, "Été, ÉTÉ x9", "a" * 300, "-" * 200, " ".join("ab" * rng.randrange(9) for _ in range(200)), "x\x00y\u00a0z", "end"]
    data, offsets = words.utf8(pa.array(texts))
    found = words.words_of(data, offsets)
    for i, text in enumerate(texts):
        own = [found.data[found.starts[k] : found.ends[k]].tobytes().decode() for k in range(found.first[i], found.first[i + 1])]
        assert own == words_in(text)
    by_word = {}
    for k in range(len(found.hashes)):
        by_word.setdefault(found.data[found.starts[k] : found.ends[k]].tobytes(), set()).add(int(found.hashes[k]))
    assert all(len(h) == 1 for h in by_word.values()) and len({min(h) for h in by_word.values()}) == len(by_word)


def test_sliced_arrays_are_read_from_their_own_start():
    data, offsets = words.utf8(pa.array(["skip", "one", None, "two"]).slice(1))
    assert bytes(data) == b"onetwo" and offsets.tolist() == [0, 3, 3, 6]


# 1 html


PAGE = """<html><head><title>T</title></head><body><header><a href=/>Home</a></header><nav><ul><li>Menu, one</li></ul></nav>
<div class="content"><h1>Head &amp; line</h1><p>First   paragraph, with commas, and enough words to be prose.</p>
<p><b>Second<br>one<p>Third &lt;b&gt; &eacute;<script>if (a < b) { "</p>" }</script></div>
<div class="cookie-notice">We use cookies, always.</div><aside>Side, side, side</aside><form>Mail, please <input></form>
<section id="comments"><p>I, a reader, think, that, this is, good.</p></section><footer>&copy; us</footer></body></html>"""


def test_main_text_of_a_page():
    assert html_extract.main_text(PAGE) == "Head & line\n\nFirst paragraph, with commas, and enough words to be prose.\n\nSecond one\n\nThird <b> é"


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (None, ""),
        ("", ""),
        ("<p>", ""),
        ("no markup", "no markup"),
        ("<p>a&#65;&nbsp;b<br>c</p>", "aA b c"),
        ("<article><p>x<p>y</article>", "x\n\ny"),
        ("</p></div>stray", "stray"),
        ("<article><h1>T</h1><p>cut in the mid", "T\n\ncut in the mid"),
        ("<div>" * 5000 + "deep" + "</div>" * 5000, "deep"),
        ("<article><p>A &am", "A &am"),
    ],
)
def test_odd_pages(page, text):
    assert html_extract.main_text(page) == text


LONG = "A paragraph of the article, with commas, and long enough to be read as prose by any measure."


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (f'<div class="content no-sidebar"><article><p>{LONG}</article></div>', LONG),
        (f'<div class="has-sidebar"><div><p>{LONG}<p>{LONG}</div><div class="sidebar"><p>Side, side, side</div></div>', f"{LONG}\n\n{LONG}"),
        (f'<div id="sidebar"><article><p>{LONG}</article></div>', LONG),
        (f'<div class="header-layout social"><p>{LONG}</div>', LONG),
        (f'<div class="widget">{LONG}</div><div class="menu">Menu</div>', LONG),
        (f'<article><section id="side-effects"><h2 id="related-work">Related work</h2><p>{LONG}</section></article>', f"Related work\n\n{LONG}"),
        (f'<main><p>{LONG}<section id="social-policy"><p>Second.</section><section id="related"><p>Third.</section></main>', f"{LONG}\n\nSecond.\n\nThird."),
        (f'<article><p>{LONG}<div class="ad">Buy</div><div class="related-posts">More</div><section class="comments"><p>{LONG * 9}</section></article>', LONG),
        (f'<div class="ad">{LONG}</div><article><p>Short.</article>', "Short."),
        (f'<div><p>{LONG}</div><section id="comments"><p>{LONG * 9}</section>', LONG),
        (f"<html><head><title>T</title><meta charset=utf-8><body><article><p>{LONG}</article></body></html>", LONG),
        (f"<html><head><title>T</title><h1>Head</h1><p>{LONG}", f"Head\n\n{LONG}"),
        (f'<article><svg viewBox="0 0 1 1"/><p>{LONG}<math/><p>Second.</article>', f"{LONG}\n\nSecond."),
        (f'<article><p>{LONG}<svg><text>no</text></svg><p>Second.<svg class=x><p>Third.</article>', f"{LONG}\n\nSecond.\n\nThird."),
    ],
)
def test_articles_are_not_lost_to_names_or_omitted_tags(page, text):
    assert html_extract.main_text(page) == text


PROBES = [
    (f"<article><p>{LONG}<p data-x=don't>{LONG}<p title=it's>{LONG}</article>", f"{LONG}\n\n{LONG}\n\n{LONG}"),
    (f"<article><p title='a > b' class=\"x\">{LONG}<p class='y' lang=\"en>{LONG}</article>", f"{LONG}\n\n{LONG}"),
    (f'<article><h2 id="related-work">Related work</h2><section id="notice-and-consent"><p>{LONG}</section><p class="social-science">{LONG}<div class="side-by-side"><p>{LONG}</div></article>', f"Related work\n\n{LONG}\n\n{LONG}\n\n{LONG}"),
    (f'<article><p>{LONG}<ul><li><a href=1>Read more about one</a><li><a href=2>Another story</a></ul></article>', LONG),
    (f'<article><p>{LONG}<ul><li>See <a href=1>one</a>, which tells the same at some more length and with figures.</ul></article>', f"{LONG}\n\nSee one, which tells the same at some more length and with figures."),
    (f'<div><ul><li><a>One</a><li><a>Two</a></ul></div><div><p>{LONG}<p>{LONG}</div>', f"{LONG}\n\n{LONG}"),
    (f"<div><p>{LONG}</div><div><p>{LONG}</div>", f"{LONG}\n\n{LONG}"),  # a tie: the other is a sibling
    ("<p><a href=x>only a link</a>", "only a link"),
]


@pytest.mark.parametrize(("page", "text"), PROBES)
def test_markup_read_by_the_rules_and_links_discounted(page, text):
    assert html_extract.main_text(page) == text


REMARK = "I think, really, that this is quite a remark, and that there is more to say about it."


@pytest.mark.parametrize("name", "user-comments reader-comments comment-thread comment-body comments_3 google-ad ad-300x250 newsletter-cta".split())
def test_comments_and_adverts_go_whatever_stands_beside_their_names(name):
    for page in (
        f'<article><p>{LONG}<p>{LONG}<div class="{name}"><p>{REMARK}</div></article>',
        f'<article><p>{LONG}<div id="{name}"><h3>Comments (3)</h3><p>{REMARK}</div><p>{LONG}</article>',
        f'<div id=c><p>{LONG}<p>{LONG}</div><div class="x {name}"><h3>Comments (3)</h3><p>{REMARK}</div>',
        f'<div id=c><p>{LONG}<p>{LONG}</div><h3>Comments (3)</h3><div class="{name}"><p>{REMARK}</div>',
    ):
        assert html_extract.main_text(page) == f"{LONG}\n\n{LONG}", page


def test_what_stands_between_parts_of_the_article_stays():
    assert html_extract.main_text(f"<div id=c><div><p>{LONG}</div><div><p>Short note, here.</p></div><div><p>{LONG}</div></div>") == f"{LONG}\n\nShort note, here.\n\n{LONG}"
    assert html_extract.main_text(f"<div id=c><div><p>{LONG}</div><div><a href=1>One</a> <a href=2>Two</a></div><div><p>{LONG}</div></div>") == f"{LONG}\n\n{LONG}"
    assert html_extract.main_text(f'<div class="post comments-open"><p>{LONG}</div>') == LONG


def tree_by_force(page):
    """Scores of all block containers, each summed on its own over the paragraphs within it by walking up from each."""
    root, nodes = html_extract.parse(page)
    values = {}
    for top in nodes:
        if top.block is not top:
            continue
        points = size = links = 0
        for owner, text, linked in html_extract._blocks(root):
            if owner.header and not owner.heading:
                continue
            at = owner.parent if (owner.name in html_extract.PARAGRAPHS or owner.heading and owner.name in html_extract.HEADINGS) and owner.parent else owner
            share = 1.0
            while at is not None and at is not top:
                share = share / 2 if at.block is at else share
                at = at.parent
            if at is top:
                given = 0.25 if owner.name in html_extract.HEADINGS or len(text) < 25 else 1 + text.count(",") + min(len(text) // 100, 3)
                points, size, links = points + given * share, size + len(text), links + min(linked, len(text))
        values[nodes.index(top)] = points * (1 - links / max(size, 1)) / (2 if top.mark == html_extract.WEAK else 1)
    return values


def test_scores_against_a_brute_force_scorer():
    rng = random.Random(41)
    for _ in range(60):
        page = "".join(
            rng.choice(["<div>", "</div>", "<p>", "</p>", "<section class=side-by-side>", "</section>", "<b>", "</b>", "<a href=x>", "</a>", "<h2>", "</h2>", "<li>", "<ul>", "</ul>", LONG, "few, words ", "x" * 120 + ", "])
            for _ in range(rng.randrange(3, 40))
        )
        expected = tree_by_force(page)
        root, nodes = html_extract.parse(page)
        html_extract._score([b for b in html_extract._blocks(root) if not b[0].header or b[0].heading], nodes)
        assert {k: html_extract.value(n) for k, n in enumerate(nodes) if n.block is n} == pytest.approx(expected)


@pytest.mark.parametrize("page", ["<div>x " * 100_000, "<b>" * 50_000 + "</i>" * 50_000, "<b>" * 50_000 + "<div>x</div>" * 50_000, "<a b='" * 50_000, "<p>" * 30_000 + "</q></p>" * 30_000, "<table><tr><td>" * 30_000, "<!--" * 50_000, "<svg>" * 100_000, "<math><svg>" * 50_000])
def test_hostile_pages_take_linear_time(page):
    import time

    began = time.process_time()
    html_extract.main_text(page)
    whole = time.process_time() - began
    began = time.process_time()
    html_extract.main_text(page[: len(page) // 4])
    assert whole < 16 * (time.process_time() - began) + 2 and whole < 10


def test_long_pages_are_read_whole():
    page = "<article>" + "".join(f"<p>{LONG} {i}</p>" for i in range(20_000)) + "</article>"
    assert html_extract.main_text(page) == "\n\n".join(f"{LONG} {i}" for i in range(20_000))


def test_extraction_query_columns(spark):
    rows = [(1, "u", "<article><p>Ünï</p></article>", "clash"), (2, None, None, "x"), (2, None, None, "x")]
    found = html_extract.extracted(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()
    assert sorted((r.page_id, r.text, r.n_chars) for r in found) == [(1, "Ünï", 3), (2, "", 0), (2, "", 0)]
    assert html_extract.extracted(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


# 2 language


def language_rows(n, seed):
    rng = random.Random(seed)
    heads = {"aa": "th er ing ou", "bb": "ción os ñ ll", "cc": "sch ü ung ß", "dd": "eau é ç ux"}
    return [(i, " ".join("".join(rng.choices(heads[lang].split(), k=3)) for _ in range(20)), lang) for i, lang in enumerate(rng.choices(list(heads), k=n))]


def test_languages_are_learned_and_held_out_ones_recognised(spark):
    rows = [*language_rows(400, 1), (1000, None, "aa"), (1001, "12 %", "aa"), (1002, "", None)]
    found = {r.doc_id: r for r in language_id.identified(documents(spark, rows)).collect()}
    tried = [(found[i].lang_pred == lang) for i, _, lang in rows if i < 1000 and found[i].held_out]
    assert len(tried) > 80 and np.mean(tried) > 0.98
    assert all(found[i].lang_pred == "und" and found[i].score == 0 for i in (1000, 1001, 1002))
    assert all(0 <= r.score <= 1 for r in found.values())


def test_labels_of_held_out_rows_change_nothing(spark):
    rows = language_rows(200, 2)
    kept = documents(spark, rows)
    held = {r.doc_id for r in language_id.identified(kept).collect() if r.held_out}
    wrong = documents(spark, [(i, t, "zz" if i in held else lang) for i, t, lang in rows])
    assert language_id.identified(kept).collect() == language_id.identified(wrong).collect()


def test_language_without_labels_or_rows(spark):
    assert {r.lang_pred for r in language_id.identified(documents(spark, [(0, "abc", None)])).collect()} == {"und"}
    assert language_id.identified(documents(spark, [])).count() == 0
    only = language_id.identified(documents(spark, [(0, "abc", "aa"), (3, "abd", "aa"), (4, "abe", "aa")])).collect()
    assert {r.lang_pred for r in only} == {"aa"}


def test_numerals_are_no_letters(spark):
    assert [language_id.has_letter(t) for t in ("½ 12", "² Ⅷ ①", "_", "٣", "", "½a", "ǅ", "ʰ", "中")] == [False] * 5 + [True] * 4
    rows = language_rows(60, 6) + [(100, "½ 12", "aa"), (101, "Ⅷ ①", None)]
    assert {r.lang_pred for r in language_id.identified(documents(spark, rows)).collect() if r.doc_id >= 100} == {"und"}


def test_language_sums_come_from_tasks_that_have_a_language(spark, monkeypatch):
    rows = documents(spark, [(k, text, lang) for k, (text, lang) in enumerate([("abc abd", "aa"), ("xyz xyy", "bb"), ("mno mnp", "cc")] * 4)])
    one = language_id.fit(rows)
    sent, collect = [], type(rows).collect
    monkeypatch.setattr(type(rows), "collect", lambda self: sent.append((self.columns, collect(self))) or sent[-1][1])
    monkeypatch.setattr(language_id, "SUM_PARTS", 50)
    many = language_id.fit(rows)
    assert sum(len(found) for columns, found in sent if columns == ["plus", "minus"]) <= 3
    assert abs(many.weights - one.weights).max() < 1e-12 and (many.reliability == one.reliability).all()


def test_any_number_of_languages_is_learned(spark):
    rng = random.Random(43)
    alphabets = {f"l{k:03d}": "".join(chr(0x4E00 + 20 * k + j) for j in range(20)) for k in range(600)}
    rows = [(i, " ".join("".join(rng.choices(own, k=6)) for _ in range(60)), lang) for i, (lang, own) in enumerate([*alphabets.items()] * 4)]
    found = language_id.identified(documents(spark, rows)).toPandas().set_index("doc_id")
    held = [i for i, *_ in rows if found.held_out[i]]
    learned = {rows[i][2] for i, *_ in rows if not found.held_out[i]}
    tried = [found.lang_pred[i] == rows[i][2] for i in held if rows[i][2] in learned]
    assert len(learned) > 512 and np.mean(tried) > 0.8  # by chance 1 in 600


def decoded_by_force(rows, text):
    """Counts, log-odds, losses and choice by plain loops over the grams' buckets."""
    learned = [r for r in rows if r[2] is not None and r[1] and zlib.crc32(str(r[0]).encode()) % 3 != 1]
    languages = sorted({lang for *_, lang in learned})
    code = language_id.codewords(len(languages))
    counts = {lang: [0.5] * language_id.BUCKETS for lang in languages}
    for _, own, lang in learned:
        for b, n in enumerate(language_id.gram_buckets(own).tolist()):
            counts[lang][b] += n
    share = {lang: [x / sum(own) for x in own] for lang, own in counts.items()}

    def weight(bit, b):
        group = lambda sign: [share[lang][b] for i, lang in enumerate(languages) if code[i, bit] * sign > 0]
        return math.log(sum(group(1)) / len(group(1))) - math.log(sum(group(-1)) / len(group(-1)))

    weights = [[weight(bit, b) for b in range(language_id.BUCKETS)] for bit in range(code.shape[1])]

    def margins(values, total):
        out = []
        for bit, own in enumerate(weights):
            ends = [[sum(w * x for w, x in zip(own, share[lang])) for i, lang in enumerate(languages) if code[i, bit] * sign > 0] for sign in (1, -1)]
            low, high = min(ends[0]), max(ends[1])
            out.append((sum(w * v for w, v in zip(own, values)) / total - (low + high) / 2) / max(1e-9, (low - high) / 2))
        return out

    def of(own):
        values = language_id.gram_buckets(own).tolist()
        return margins(values, max(1, sum(values)))

    good = [1] * code.shape[1]
    for _, own, lang in learned:
        for bit, m in enumerate(of(own)):
            good[bit] += m * code[languages.index(lang), bit] > 0
    reliability = [max(2 * g / (len(learned) + 2) - 1, 0.01) for g in good]
    found = of(text)
    losses = [sum(r * math.exp(-code[i, bit] * min(max(m, -3), 3) * 4 / 3) for bit, (m, r) in enumerate(zip(found, reliability))) / sum(reliability) for i in range(len(languages))]
    likely = [math.exp(-4 * (x - min(losses))) for x in losses]
    return languages[losses.index(min(losses))], max(likely) / sum(likely)


def test_decoding_against_a_brute_force_decoder(spark, monkeypatch):
    monkeypatch.setattr(language_id, "BUCKETS", 1 << 12)
    rows = language_rows(24, 8)
    found = {r.doc_id: r for r in language_id.identified(documents(spark, [*rows, (500, rows[0][1], None), (500, rows[0][1], None)], "")).collect()}
    for i, text, _ in rows[:5]:
        lang, score = decoded_by_force(rows, text)
        assert found[i].lang_pred == lang and found[i].score == pytest.approx(score)


def test_equal_losses_go_to_the_first_language_and_long_texts_and_clashing_columns_are_read(spark):
    code = language_id.codewords(3)
    nothing = np.zeros(code.shape[1])
    coder = language_id.Coder(["aa", "bb", "cc"], code, np.zeros((language_id.BUCKETS, code.shape[1])), nothing, nothing + 1, nothing + 1)
    assert coder.decode("any text") == ("aa", pytest.approx(1 / 3), True)
    rows = language_rows(60, 9)
    docs = documents(spark, rows).withColumn("lang_pred", F.lit("clash")).withColumn("decoded", F.lit(1))
    assert language_id.with_language(docs).columns == docs.columns and language_id.with_language(docs).count() == 60
    assert {tuple(r) for r in language_id.identified(docs).collect()} == {tuple(r) for r in language_id.identified(documents(spark, rows)).collect()}
    long = [(100, rows[0][1] * 20_000, None), (100, rows[0][1], None)]
    assert {r.lang_pred for r in language_id.identified(documents(spark, rows + long)).collect() if r.doc_id == 100} == {rows[0][2]}


def test_codewords_differ_and_long_texts_are_read_in_pieces(monkeypatch):
    for n in (2, 3, 7, 8, 40):
        code = language_id.codewords(n)
        assert len({tuple(c) for c in code}) == n
    text = language_rows(1, 3)[0][1] * 40
    whole = language_id.gram_buckets(text)
    monkeypatch.setattr(language_id, "PIECE", 100)
    assert (language_id.gram_buckets(text) == whole).all()


# 3 exact dedup


def test_exact_duplicates_against_brute_force(spark):
    rng = random.Random(7)
    base = [prose(rng, rng.randrange(1, 60)) for _ in range(15)] + ["", "É", "é", "x" * 5000, "y" * 4999 + "Z"]
    rows = [(i, rng.choice([t, t.upper(), t.title()]) if t.isascii() else t, None) for i, t in enumerate(rng.choices(base, k=120))]
    rows += [(500, None, None), (501, "", None), (502, "Twice", None), (502, "Twice", None)]
    normal = [(i, (t or "").translate(ASCII_LOWER)) for i, t, _ in rows]
    expected = sorted(
        (i, max(j for j, u in normal if u == t), sum(u == t for _, u in normal), i == max(j for j, u in normal if u == t), hashlib.sha256(t.encode()).hexdigest())
        for i, t in normal
    )
    for segment in (1 << 16, 100):
        found = exact_dedup.exact_duplicates(documents(spark, rows), segment_chars=segment).drop("raw").collect()
        assert sorted(map(tuple, found)) == expected


def test_colliding_fingerprints_drop_nothing(spark, monkeypatch):
    rows = [(1, "alpha", None), (2, "bravo", None), (3, "ALPHA", None), (4, "bravo", None), (None, "gamma", None)]
    real = exact_dedup.fingerprints

    def colliding(docs, size):
        found = real(docs, size)
        for k in range(exact_dedup.N):
            found = found.withColumn(f"h{k}", found.n_bytes * 0)
        return found

    monkeypatch.setattr(exact_dedup, "fingerprints", colliding)
    found = {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_duplicates(documents(spark, rows)).collect()}
    assert found == {1: (3, 2, False), 3: (3, 2, True), 2: (4, 2, False), 4: (4, 2, True), None: (None, 1, True)}


def test_null_ids_are_compared_too(spark, monkeypatch):
    rows = [(None, "alpha", None), (None, "bravo", None), (None, "ALPHA", None), (7, "bravo", None), (None, "Bravo", None), (8, "delta", None)]
    real = exact_dedup.fingerprints

    def colliding(docs, size):
        found = real(docs, size)
        for k in range(exact_dedup.N):
            found = found.withColumn(f"h{k}", found.n_bytes * 0)
        return found

    expected = sorted([("None", "None", 2, True)] * 2 + [("None", "7", 3, False)] * 2 + [("7", "7", 3, True), ("8", "8", 1, True)])
    for colliding_or_not in (real, colliding):
        monkeypatch.setattr(exact_dedup, "fingerprints", colliding_or_not)
        found = exact_dedup.exact_duplicates(documents(spark, rows)).collect()
        assert sorted((str(r.doc_id), str(r.keep_id), r.group_size, r.kept) for r in found) == expected


def test_huge_texts_take_time_in_proportion(spark):
    import time

    def seconds(megabytes):
        text = f"concat('Ü', repeat('Some Words, ', int(id * 0) + {megabytes * 87_381}), if(id = 1, '1', '0'))"
        docs = staging.stage(spark.range(3).repartition(3).select(F.col("id").alias("doc_id"), F.expr(f"if(id = 0, replace({text}, 'S', 's'), {text})").alias("text")), "huge")
        began = time.time()
        found = exact_dedup.exact_duplicates(docs).orderBy("doc_id").collect()
        assert [(r.keep_id, r.group_size) for r in found] == [(2, 2), (1, 1), (2, 2)]
        return time.time() - began

    seconds(1)
    small, large = seconds(4), seconds(32)
    assert large < 12 * small, (small, large)


def test_polynomials_of_pieces_compose():
    rng = np.random.default_rng(3)
    table = exact_dedup._chunk_powers()
    for n, cut in ((3000, 1024), (2500, 7), (1, 1)):
        text = rng.integers(0, 256, n, dtype=np.uint8)
        whole, a, b = (exact_dedup.polynomial_hashes(x, np.array([0, len(x)]), table)[0] for x in (text, text[:cut], text[cut:]))
        for k, r in enumerate(exact_dedup.RADIXES):
            assert int(whole[k]) == (int(a[k]) * pow(r, n - cut, exact_dedup.PRIME) + int(b[k])) % exact_dedup.PRIME
            direct = 0
            for byte in text.tolist():
                direct = (direct * r + byte) % exact_dedup.PRIME
            assert int(whole[k]) == direct


def test_exact_dedup_keeps_columns_and_empty_tables(spark):
    rows = [(1, "Same", "aa", 5), (2, "same", "bb", 6), (3, None, "cc", 7)]
    docs = documents(spark, rows, ", keep_id long")
    assert sorted(map(tuple, exact_dedup.deduplicated(docs).collect())) == [(2, "same", "bb", 6), (3, None, "cc", 7)]
    assert exact_dedup.exact_duplicates(documents(spark, [])).count() == 0


# 4 decontamination


def contamination_by_force(docs, items):
    windows = {}
    for item, text in items:
        w = words_in(text)
        n = min(13, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[k : k + n]), set()).add(item)
    out = []
    for doc, text in docs:
        w, hit, found = words_in(text), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                own = windows.get(tuple(w[k : k + n]))
                if own:
                    hit |= set(range(k, k + n))
                    found |= own
        out.append((doc, len(w), len(hit), len(found), decontaminate.items_digest([str(i) for i in found]), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out)


@pytest.mark.parametrize("most_bits", [decontaminate.MOST_BITS, 4])
def test_contamination_against_brute_force(spark, most_bits):
    rng = random.Random(11)
    items = [(i, prose(rng, n)) for i, n in enumerate([30, 13, 14, 40, 3, 1, 12, 25, 0])] + [(20, None), (21, "!!"), (3, prose(rng, 20))]
    items += [(30, items[0][1]), (31, items[0][1].upper())]
    docs = []
    for i in range(80):
        text = prose(rng, rng.randrange(0, 120))
        if i % 2:
            source = rng.choice([t for _, t in items if t]).split()
            k = rng.randrange(len(source))
            part = " ".join(source[k : k + rng.choice([3, 12, 13, 14, 30])])
            text = f"{text} {part}, {prose(rng, rng.randrange(0, 40))}"
        docs.append((i, rng.choice([text, text.title(), text.replace(" ", " -- ")])))
    docs += [(90, None), (91, ""), (92, items[0][1]), (92, items[0][1])]
    found = decontaminate.contamination(
        spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), most_bits
    )
    assert sorted(map(tuple, found.drop("spans").collect())) == contamination_by_force(docs, items)


def test_blocks_of_long_texts_have_every_run_once(monkeypatch):
    rng = random.Random(51)
    monkeypatch.setattr(words, "BLOCK_BYTES", 40)
    for text in [prose(rng, 200), "x" * 500, f"{'y' * 90} " * 6, f"a {'z' * 200} b c d e f", "-" * 300, prose(rng, 30) + "-" * 200 + prose(rng, 30)]:
        data, offsets = words.utf8(pa.array([text]))
        whole = words.words_of(data, offsets)
        for overlap in (0, 1, 4, 12):
            for n in range(1, overlap + 2):
                seen = {}
                total = 0
                for own, before, again in words.blocks_of(data, overlap):
                    total += len(own.hashes) - again
                    for j in range(len(own.hashes) - n + 1):
                        if j + n > again:
                            assert before + j not in seen
                            seen[before + j] = own.text(j, j + n)
                assert total == len(whole.hashes)
                assert seen == {j: whole.text(j, j + n) for j in range(len(whole.hashes) - n + 1)}


def test_very_long_texts_and_items_are_scanned_whole(spark):
    rng = random.Random(53)
    long = prose(rng, 400_000, 10**6)  # of several blocks
    items = [(1, prose(rng, 20, 10**6)), (2, "two words"), (3, prose(rng, 250_000, 10**6))]
    first, last = items[0][1], items[2][1].split()[-40:]
    docs = [(1, f"{first} {long} two words {' '.join(last)}"), (2, f"{long} {first}"), (3, " ".join(items[2][1].split()[100_000:100_100])), (4, long), (5, "x" * 3_000_000), (6, None)]
    found = decontaminate.contamination(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert sorted((r.doc_id, r.n_words, r.n_hit, r.n_items, [tuple(s) for s in r.spans]) for r in found.collect()) == [
        (1, 400_062, 62, 3, [(0, 20), (400_020, 400_062)]),
        (2, 400_020, 20, 1, [(400_000, 400_020)]),
        (3, 100, 100, 1, [(0, 100)]),
        (4, 400_000, 0, 0, []),
        (5, 1, 0, 0, []),
        (6, 0, 0, 0, []),
    ]


@pytest.mark.parametrize("most_bits", [decontaminate.MOST_BITS, 3])
def test_items_without_an_id_are_hit_too(spark, most_bits):
    rng = random.Random(37)
    long, other, both = (prose(rng, 20, 5000) for _ in range(3))
    items = [(None, long), (None, "two words"), (7, other), (8, both), (None, both)]
    docs = [(1, long), (2, "two words and two words"), (3, other), (4, both), (5, f"{long} {both}"), (6, "clean")]
    found = decontaminate.contamination(
        spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), most_bits
    )
    digest = decontaminate.items_digest
    assert sorted(map(tuple, found.drop("spans").collect())) == [
        (1, 20, 20, 1, digest([]), True),
        (2, 5, 4, 1, digest([]), True),
        (3, 20, 20, 1, digest(["7"]), True),
        (4, 20, 20, 2, digest(["8"]), True),
        (5, 40, 40, 2, digest(["8"]), True),
        (6, 1, 0, 0, digest([]), False),
    ]


def test_decontaminated_keeps_columns_and_empty_benchmarks(spark):
    rows = [(1, "one two three", "a", 1), (2, "clean text here", "b", 2), (3, None, "c", 3)]
    docs = documents(spark, rows, ", items int")
    items = spark.createDataFrame([(5, "ONE two three")], "item_id long, text string")
    assert sorted(map(tuple, decontaminate.decontaminated(docs, items).collect())) == rows[1:]
    assert decontaminate.decontaminated(docs, items.limit(0)).count() == 3
    assert decontaminate.contamination(docs.limit(0), items).count() == 0


# 5 chat


def test_escaping_is_reversible_and_hides_control_strings():
    rng = random.Random(13)
    for _ in range(3000):
        text = "".join(rng.choices(["<", "|", "\\", ">", "a", "<|end|>", "<|start|>", "<|endoftext|>", "\n"], k=rng.randrange(12)))
        assert chat_format.unescape(chat_format.escape(text)) == text
        assert "<|" not in chat_format.escape(text)


def test_conversations_read_back(spark, monkeypatch):
    rng = random.Random(17)
    bits = ["héllo ", "☃☃", "<|end|>", "  ", "\n\n", "</s>[INST] ok [/INST]", "<|endoftext|>", "", "x" * 50, "𝔘", "\\", "<"]
    rows = [(c, t, rng.choice(["user", "assistant", "system", None]), "".join(rng.choices(bits, k=rng.randrange(6)))) for c in range(30) for t in range(rng.randrange(1, 9))]
    rows += [(50, t, "assistant" if t % 2 else "user", f"turn {t}") for t in range(9000)]  # dealt in parts
    rows += [(52, None, "user", f"{k % 300}") for k in range(600)]  # all turns are equal
    rows += [(51, 0, "assistant", None), (51, 0, "assistant", None), (None, None, "user", "lost")]
    monkeypatch.setattr(chat_format, "PART_CHARS", 4000)
    expected = {}
    by_conversation = {}
    for conv, turn, role, text in rows:
        by_conversation.setdefault(conv, []).append((-1 if turn is None else turn, role or "", text or ""))
    for conv, turns in by_conversation.items():
        turns.sort()
        learned = "".join(t for _, r, t in turns if r == "assistant")
        said = "".join(f"{r}\n{t}\n" for _, r, t in turns)
        expected[conv] = (len(turns), hashlib.sha256(said.encode()).hexdigest(), len(learned), hashlib.sha256(learned.encode()).hexdigest())
    df = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, part int")
    parts = chat_format.formatted(df)
    found = {r.conv_id: tuple(r)[1:5] for r in chat_format.digests(parts).collect()}
    assert found == expected
    assert parts.filter("conv_id = 50").count() > 2 and parts.filter("conv_id = 52").count() > 2
    assert chat_format.digests(chat_format.formatted(df.limit(0))).count() == 0
    # Whether in parts or not, a conversation has the tokens, offsets and mask of the whole encoded once.
    tokenizer = chat_format.load_tokenizer(chat_format.TOKENIZER_FILE)
    by_id = {}
    for r in parts.orderBy("conv_id", "chunk", "part").collect():
        by_id.setdefault(r.conv_id, []).append(r)
    for conv, turns in by_conversation.items():
        text, spans = chat_format.render([(r, t) for _, r, t in turns])
        whole = tokenizer.encode(text, add_special_tokens=False)
        at = np.array(whole.offsets).reshape(-1, 2)
        assert by_id[conv][0].whole == (len(by_id[conv]) == 1 and sum(len(r) + len(t) + 32 for _, r, t in turns) <= 4000)
        shift, ids, begins, masks = 0, [], [], []
        for r in by_id[conv]:
            ids += r.input_ids
            begins += [shift + b for b in r.token_begin]
            masks += r.loss_mask
            shift += len(r.text)
        assert "".join(r.text for r in by_id[conv]) == text
        assert ids == whole.ids and begins == at[:, 0].tolist() and masks == chat_format.mask(at[:, 0], at[:, 1], spans).tolist()


def test_no_token_is_half_in_a_turn():
    tokenizer = chat_format.load_tokenizer(chat_format.TOKENIZER_FILE)
    text, spans = chat_format.render([("user", " a "), ("assistant", "\n b☃"), ("assistant", "c"), ("assistant", "")])
    encoded = tokenizer.encode(text, add_special_tokens=False)
    at = np.array(encoded.offsets)
    learned = chat_format.mask(at[:, 0], at[:, 1], spans)
    for (a, b), flag in zip(encoded.offsets, learned):
        inside = [s <= a and b <= e for s, e in spans if s < b and a < e]
        assert bool(inside) == flag and all(inside)
    assert chat_format.masked_texts(text, at[:, 0].tolist(), at[:, 1].tolist(), learned.tolist()) == ["\n b☃", "c"]


# 6 packing


def padding(lengths, counts, bounds):
    return sum(c * (min(b for b in bounds if b >= n) - n) for n, c in zip(lengths, counts))


def test_bounds_are_optimal():
    rng = random.Random(19)
    for _ in range(40):
        lengths = sorted(rng.sample(range(1, 60), rng.randrange(1, 9)))
        counts = [rng.randrange(1, 30) for _ in lengths]
        for k in (1, 2, 3, 5):
            bounds = packing.best_bounds(lengths, counts, k)
            assert len(bounds) <= k and bounds[-1] == lengths[-1]
            least = min(padding(lengths, counts, [*c, lengths[-1]]) for m in range(k) for c in itertools.combinations(lengths[:-1], min(m, len(lengths) - 1)))
            assert padding(lengths, counts, bounds) == least
    assert packing.best_bounds([], [], 4) == []


def packed_by_force(rows, most, buckets, budget):
    """Every piece with its place, by plain loops: pieces in the order of their buckets, shares and ids."""
    tokenizer, _ = packing.load_tokenizer(packing.TOKENIZER_FILE)
    cut = []
    for doc_id, text in rows:
        ids = tokenizer.encode_ordinary(text or "")
        for k in range(max(1, -(-len(ids) // most))):
            own = ids[k * most : k * most + most]
            before = len(tokenizer.decode_bytes(ids[: k * most]))
            name = zlib.crc32(np.array(own, "<i4").tobytes(), zlib.crc32(f"{doc_id}/{k}".encode()))
            cut.append((doc_id, k, k * most, len(own), before, len(tokenizer.decode_bytes(own)), own, name))
    lengths = sorted({c[3] for c in cut if c[3]})
    counts = [sum(c[3] == n for c in cut) for n in lengths]
    choices = [[*c, lengths[-1]] for m in range(min(buckets, len(lengths))) for c in itertools.combinations(lengths[:-1], m)]
    least = min(padding(lengths, counts, c) for c in choices)
    bounds = packing.best_bounds(lengths, counts, buckets)
    assert padding(lengths, counts, bounds) == least and len(bounds) <= buckets
    out = [(*c[:7], None, None, None) for c in cut if not c[3]]
    shares = packing.number_of_shares(sum(counts))
    for low, bound in zip([0, *bounds], bounds):
        own = sorted((c for c in cut if low < c[3] <= bound), key=lambda c: (c[7] % shares, c[0], c[1], c[6]))
        slots = max(1, budget // bound)
        out += [(*c[:7], bound, i // slots, i % slots) for i, c in enumerate(own)]
    return out


def test_packing_against_brute_force(spark):
    rng = random.Random(23)
    texts = [prose(rng, rng.choice([2, 5, 5, 40, 90])) for _ in range(60)] + ["Ünïcode ☃☃ 𝔘 " * 30, "\n\n  \t x" * 20, "a" * 500]
    rows = [*enumerate(texts), (900, None), (901, ""), (902, "a b"), (902, "a b"), (903, "a"), (903, "c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"bucket": F.lit("clash"), "input_ids": F.lit(1), "hash": F.lit("x")})
    found = packing.packed(docs, most_tokens=60, buckets=3, budget=200)
    assert sorted(map(str, (tuple(r) for r in found.collect()))) == sorted(map(str, packed_by_force(rows, 60, 3, 200)))
    assert packing.packed(documents(spark, [])).count() == 0


def test_batches_keep_the_budget_and_pieces_their_place(spark):
    rng = random.Random(23)
    rows = [(i, prose(rng, rng.choice([5, 5, 5, 40, rng.randrange(1, 300)])) + " ☃", None) for i in range(300)] + [(900, None, None), (902, "a b", None), (902, "a b", None)]
    found = packing.packed(documents(spark, rows), most_tokens=100, buckets=4, budget=400).toPandas()
    tokenizer, _ = packing.load_tokenizer(packing.TOKENIZER_FILE)
    text_of = {i: t.encode() for i, t, _ in rows if t}
    full = found[found.n_tokens > 0]
    for r in full.itertuples():
        assert tokenizer.decode_bytes(list(r.input_ids)) == text_of[r.doc_id][r.first_byte : r.first_byte + r.n_bytes] and len(r.input_ids) == r.n_tokens
    assert all(own.n_bytes.sum() == len(text_of[i]) * (2 if i == 902 else 1) for i, own in full.groupby("doc_id"))
    assert (full.n_tokens <= full.bucket).all() and full.bucket.nunique() <= 4
    for (bucket, _), own in full.groupby(["bucket", "batch"]):
        assert sorted(own.slot) == list(range(len(own))) and len(own) * bucket <= max(400, bucket)
    for bucket, own in full.groupby("bucket"):  # only the last batch of a bucket is not full
        sizes = own.groupby("batch").size()
        assert (sizes.iloc[:-1] == max(1, 400 // bucket)).all() and list(sizes.index) == list(range(len(sizes)))


def test_long_texts_are_encoded_as_they_would_be_whole(monkeypatch):
    rng = random.Random(47)
    tokenizer, sizes = packing.load_tokenizer(packing.TOKENIZER_FILE)
    monkeypatch.setattr(packing, "BLOCK_CHARS", 50)
    for _ in range(200):
        text = "".join(rng.choice(["word", " ", "  ", "\n", "it's", "12", "☃", ", ", "\u3000", " x", "\x1c", "é", "'ll", "Ⅷ", "\x85"]) for _ in range(rng.randrange(200)))
        assert "".join(packing.blocks_of(text, 50)) == text
        assert packing.encoded(text).tolist() == tokenizer.encode_ordinary(text)
    coded = base64.b64encode(rng.randbytes(20_000)).decode()
    han = "".join(chr(rng.randrange(0x4E00, 0x9000)) for _ in range(5000))
    for text in ("x" * 1000, " " * 1000, "\n" * 130 + "y" * 200, coded, han, han + "。" * 300 + han, "!\x1c" * 300):  # stretches without a space
        ids = packing.encoded(text)
        assert ids.tolist() == tokenizer.encode_ordinary(text) and sizes[ids].sum() == len(text.encode())
    assert len(list(packing.blocks_of(coded, 50))) > 300


# 7 Jaccard join


def classes_by_force(rows, threshold=0.8):
    from fractions import Fraction

    sets, same = {}, {}
    for i, text in rows:
        w = tuple(words_in(text))
        same.setdefault(w, []).append(i)
        sets[w] = {w[k : k + 5] for k in range(max(1, len(w) - 4))} if w else set()
    parent = {w: w for w in sets}

    def find(w):
        while parent[w] != w:
            w = parent[w]
        return w

    links = dict.fromkeys(sets, 0)
    keys = [w for w in sets if w]
    for a in range(len(keys)):
        for b in range(a):
            x, y = sets[keys[a]], sets[keys[b]]
            if Fraction(len(x & y), len(x | y)) >= Fraction(str(threshold)):
                links[keys[a]] += 1
                links[keys[b]] += 1
                parent[find(keys[a])] = find(keys[b])
    least = {}
    for w, ids in same.items():
        if w:
            least[find(w)] = min([*ids, *([least[find(w)]] if find(w) in least else [])])
    out = []
    for w, ids in same.items():
        out += [(i, least[find(w)], links[w], len(ids)) if w else (i, i, 0, 1) for i in ids]
    return sorted(out)


def near_rows(seed, groups=6, size=12):
    rng = random.Random(seed)
    rows = []
    for _ in range(groups):
        base = prose(rng, rng.randrange(30, 150), 5000).split()
        for _ in range(size):
            own = list(base)
            for _ in range(rng.randrange(0, 5)):
                own[rng.randrange(len(own))] = f"n{rng.randrange(10**6)}"
            rows.append(" ".join(own))
            if rng.random() < 0.1:
                base = own  # a chain of copies of copies
    rows += [prose(rng, rng.randrange(1, 80), 5000) for _ in range(40)] + ["one two", "ONE, two!", "", None, "!!", "three"] + [rows[0].upper()] * 3
    rng.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize(("seed", "block"), [(1, 256), (2, 4), (3, 3)])
def test_near_duplicates_against_brute_force(spark, seed, block):
    rows = near_rows(seed)
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, node int")
    found = jaccard_join.near_duplicates(docs, block=block).drop("raw").collect()
    assert sorted(map(tuple, found)) == classes_by_force(rows)


def test_rows_that_share_an_id_cost_no_more_than_rows_with_their_own(spark):
    import time

    rng = random.Random(61)
    base, texts = prose(rng, 60, 5000).split(), []
    for k in range(1500):
        own = list(base)
        own[k % 60] = f"n{k}"
        texts.append(" ".join(own))
    found, took = [], []
    for ids in ([*range(1500)], [None] * 1500, [7] * 1500):
        docs = spark.createDataFrame(list(zip(ids, texts)), "doc_id long, text string")
        began = time.time()
        found.append(sorted(r.n_links for r in jaccard_join.near_duplicates(docs).select("n_links").collect()))
        took.append(time.time() - began)
    assert found[0] == found[1] == found[2] and max(took[1:]) < 2 * took[0] + 5


@pytest.mark.parametrize("block", [512, 80])
def test_large_groups_against_brute_force(spark, block):
    rng = random.Random(59)
    rows = []
    for size, length in ((220, 60), (90, 25)):
        base = prose(rng, length, 5000).split()
        for _ in range(size):
            own = list(base)
            for _ in range(rng.randrange(0, 4)):
                own[rng.randrange(length)] = f"n{rng.randrange(10**6)}"
            rows.append(" ".join(own))
    rows = list(enumerate(rows))
    found = jaccard_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), block=block).drop("raw").collect()
    assert sorted(map(tuple, found)) == classes_by_force(rows)


def one_family(n, length=93):
    """Texts with one word of their own each, and how many of the others each is linked to, which goes by the places of those words."""
    rng = np.random.default_rng(61)
    place = rng.integers(0, length, n)
    base = [f"w{k}" for k in range(length)]
    texts = [" ".join([*base[:p], f"own{i}", *base[p + 1 :]]) for i, p in enumerate(place.tolist())]
    touched = [set(range(max(0, p - 4), min(length - 5, p) + 1)) for p in range(length)]  # the grams that have the word at p
    total = length - 4
    shared = np.array([[total - len(a | b) for b in touched] for a in touched])
    linked = (10 * shared >= 8 * (2 * total - shared)).astype(np.int64)
    return texts, (linked @ np.bincount(place, minlength=length))[place] - np.diag(linked)[place]


def test_ten_thousand_near_copies(spark):
    texts, expected = one_family(10_000)
    found = jaccard_join.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(8)).toPandas().sort_values("doc_id")
    assert set(found.class_id) == {0}
    assert found.n_links.sum() / expected.sum() > 0.9999 and (found.n_links.to_numpy() <= expected).all()


def test_one_of_each_class_keeps_columns(spark):
    rng = random.Random(3)
    base = prose(rng, 60, 5000)
    rows = [(4, base, "a"), (2, base + " more", "b"), (9, "else entirely", "c"), (5, None, "d"), (6, None, "e")]
    assert {r.doc_id for r in jaccard_join.one_of_each_class(documents(spark, rows)).collect()} == {2, 9, 5, 6}
    assert jaccard_join.near_duplicates(documents(spark, [])).count() == 0


def test_posterior_rule_keeps_probable_pairs():
    rule = dict(jaccard_join.least_matches(0.8, 1e-6))
    rng = np.random.default_rng(1)
    draws = rng.random((20_000, jaccard_join.HASHES)) < 0.8
    lost = np.zeros(len(draws), bool)
    for n, m in rule.items():
        lost |= draws[:, :n].sum(axis=1) < m
    assert lost.mean() < 1e-3 and rule[128] > 60


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(200, 201), (201, 200), (300, 300)]
    found = {r.node: r.root for r in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {**dict.fromkeys(range(41), 0), **dict.fromkeys(range(100, 130), 100), 200: 200, 201: 200}


# 8 quality


def test_isotonic_is_the_best_monotone_fit():
    assert quality.isotonic(np.array([1.0, 3, 2, 4, 0]), np.ones(5)).tolist() == [1.0, 2.25, 2.25, 2.25, 2.25]
    assert quality.isotonic(np.array([3.0, 1]), np.array([1.0, 3])).tolist() == [1.5, 1.5]
    assert len(quality.isotonic(np.zeros(0), np.zeros(0))) == 0


def test_statistics_of_a_text():
    found = dict(zip(quality.NAMES, quality.statistics(pa.array(["Ab ab cd.\nAb ab cd.\n1"]))[0]))
    assert found["distinct_words"] == pytest.approx(3 / 7) and found["same_as_before"] == pytest.approx(2 / 7)
    assert found["repeated_lines"] == pytest.approx(1 / 3) and found["upper"] == pytest.approx(2 / 21)
    assert np.isfinite(quality.statistics(pa.array([None, "", "\n", "a"]))).all()


def statistics_by_force(text):
    raw = (text or "").encode()
    found = [w.encode() for w in words_in(text)]
    lines = raw.split(b"\n")
    n, size = max(1, len(found)), max(1, len(raw))
    kinds = {k: sum(c in own for c in raw) for k, own in {"upper": string.ascii_uppercase.encode(), "stops": b".,", "digits": b"0123456789", "spaces": b" \n", "pipes": b"|"}.items()}
    plain = string.ascii_letters.encode() + string.digits.encode() + b"., \n"
    lengths = [len(w) for w in found] or [0]
    distinct = len(set(found))
    return {
        "log_chars": math.log1p(len(raw)),
        "log_words": math.log1p(len(found)),
        "word_bytes": sum(lengths) / n,
        "word_bytes_sd": float(np.std(lengths)),
        "distinct_words": distinct / n,
        "log_distinct": math.log1p(distinct) / math.log1p(n),
        "same_as_before": sum(a == b for a, b in itertools.pairwise(found)) / n,
        "upper": kinds["upper"] / size,
        "symbols": sum(c not in plain and c < 128 for c in raw) / size,
        "stops": kinds["stops"] / n,
        "digits": kinds["digits"] / size,
        "spaces": kinds["spaces"] / size,
        "repeated_lines": 1 - len(set(lines)) / len(lines),
        "pipes": kinds["pipes"] / n,
        "line_words": math.log1p(len(found) / len(lines)),
    }


def odd_text(rng, n):
    return "".join(rng.choice(["word", "Word", " ", " ", "\n", "a a a", "12", "☃é", ".", ", ", "|", "##", "\nsame line\n", "\x00", "ÜB"]) for _ in range(n))


@pytest.mark.parametrize("block", [1 << 20, 64, 7])
def test_statistics_against_brute_force(monkeypatch, block):
    monkeypatch.setattr(quality, "BLOCK_BYTES", block)
    monkeypatch.setattr(words, "BLOCK_BYTES", block)
    rng = random.Random(71)
    texts = [odd_text(rng, rng.randrange(120)) for _ in range(120)] + [None, "", "\n", "\n\n", "x" * 300, "a " * 100, "b\n" * 90, "x" * 99 + "\n" + "x" * 99]
    found = np.concatenate([quality.statistics(pa.array([t], pa.string())) for t in texts])
    expected = [statistics_by_force(t) for t in texts]
    assert np.allclose(found, [[e[k] for k in quality.NAMES] for e in expected], rtol=1e-9, atol=1e-6)
    if block == 1 << 20:  # texts of one run
        assert np.allclose(quality.statistics(pa.array(texts, pa.string())), found, rtol=1e-12)


def scores_by_force(rows, labels):
    """Random features, ridge by least squares on stacked equations, isotonic by its minimax form, all in one place."""
    stats = np.array([[statistics_by_force(t)[k] for k in quality.NAMES] for _, t, _ in rows])
    given = {}
    for i, q, _ in labels:
        if i is not None and q is not None and zlib.crc32(str(i).encode()) % 5:
            given.setdefault(i, []).append(q)
    at = [k for k, (i, _, _) in enumerate(rows) if i in given]
    y = np.array([np.mean(given[rows[k][0]]) for k in at])
    half = np.array([zlib.crc32(f"half{rows[k][0]}".encode()) % 2 for k in at])
    rng = np.random.default_rng(20268)
    directions, phases = rng.normal(0, 1 / quality.BANDWIDTH, (len(quality.NAMES), quality.FEATURES)), rng.uniform(0, 2 * np.pi, quality.FEATURES)
    mean, sd = stats[at].mean(axis=0), stats[at].std(axis=0)
    x = np.clip((stats - mean) / np.where(sd > 1e-9, sd, 1), -quality.CLIP, quality.CLIP)
    z = np.column_stack([np.sqrt(2 / quality.FEATURES) * np.cos(x @ directions + phases), np.ones(len(x))])

    def ridge(own_z, own_y):
        more = math.sqrt(quality.RIDGE * 10 * len(own_y) / z.shape[1])
        return np.linalg.lstsq(np.vstack([own_z, more * np.eye(z.shape[1])]), np.concatenate([own_y, np.zeros(z.shape[1])]), rcond=None)[0]

    fitted = z[at]
    raw = np.where(half == 0, fitted @ ridge(fitted[half == 1], y[half == 1]), fitted @ ridge(fitted[half == 0], y[half == 0]))
    bins = np.clip(np.floor(raw * quality.BINS / 2), -quality.BINS // 2, quality.BINS)
    each = sorted(set(bins))
    middle, share, n = (np.array([f(bins == b) for b in each]) for f in (lambda o: raw[o].mean(), lambda o: y[o].mean(), np.sum))
    best = [max(min(np.average(share[j : k + 1], weights=n[j : k + 1]) for k in range(i, len(n))) for j in range(i + 1)) for i in range(len(n))]
    return np.clip(np.interp(z @ ridge(fitted, y), middle, best), 0, 1)


def test_scores_against_a_plain_fit(spark):
    rng = random.Random(73)
    rows = [(i, odd_text(rng, rng.randrange(5, 80)), None) for i in range(150)] + [(900, None, None), (3, "another text of three", None)]
    labels = [(i, int(len(t) + rng.randrange(-60, 60) > 120), 0) for i, t, _ in rows if t] + [(5, 1, 0), (6, None, 0), (None, 1, 0)]
    found = quality.scored(documents(spark, rows).coalesce(1), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    expected = scores_by_force(rows, labels)
    assert [r.doc_id for r in found] == [i for i, _, _ in rows] and len({r.score for r in found}) > 5
    assert np.allclose([r.score for r in found], expected, atol=1e-6)


def test_quality_is_learned(spark):
    rng = random.Random(29)
    rows, labels = [], []
    for i in range(500):
        good = rng.random() < 0.7
        rows.append((i, prose(rng, 60, 3000) + "." if good else " ".join(["same###"] * rng.randrange(20, 90)), None))
        labels.append((i, int(good), 0))
    rows += [(900, None, None), (901, "", None)]
    labels += [(0, labels[0][1], 0), (1, None, 0), (None, 1, 0)]
    schema = "doc_id long, quality int, toxic int"
    found = quality.scored(documents(spark, rows), spark.createDataFrame(labels, schema)).toPandas().set_index("doc_id")
    held = found[found.held_out & (found.index < 500)]
    assert len(held) > 60 and (held.predicted == [labels[i][1] for i in held.index]).mean() > 0.97
    assert found.score.between(0, 1).all() and len(found) == 502
    flipped = [(i, 1 - q if i in set(held.index) and q is not None else q, t) for i, q, t in labels]
    again = quality.scored(documents(spark, rows), spark.createDataFrame(flipped, schema)).toPandas().set_index("doc_id")
    assert np.allclose(found.score.sort_index(), again.score.sort_index(), atol=1e-9)
    none = quality.scored(documents(spark, rows[:3]), spark.createDataFrame([], schema)).collect()
    assert {r.score for r in none} == {0.5}
    assert quality.scored(documents(spark, []), spark.createDataFrame(labels, schema)).count() == 0


# 9 licences


def test_licence_texts_are_found_in_their_variants(spark):
    mit = dict(license_scan.KNOWN[:1])["MIT"]
    rows = [
        (1, "Copyright (c) 2020 A. Person\n\n" + mit.upper().replace(",", " ,").replace("SUBLICENSE", "sub-licence"), None),
        (2, "Some prose.\nReleased under the MIT Licence\nmore. All rights reserved.\nALL RIGHTS RESERVED", None),
        (3, mit + " But changed.", None),
        (4, None, None),
        (5, "", None),
        (6, "LICENSED UNDER CC BY-NC 4.0", None),
        (6, "LICENSED UNDER CC BY-NC 4.0", None),
    ]
    found = sorted(tuple(r) for r in license_scan.scanned(documents(spark, rows, "").withColumnRenamed("lang", "digest")).collect() if r.doc_id != 6)
    assert [f[:2] for f in found] == [(1, "MIT"), (2, None), (3, None), (4, None), (5, None)]
    assert found[1][2:] == (2, "LicenseRef-all-rights-reserved,MIT") and found[3][2:] == (0, "")
    assert license_scan.scanned(documents(spark, rows[-2:])).filter("license = 'CC-BY-NC-4.0' and n_license_lines = 1").count() == 2
    assert license_scan.scanned(documents(spark, [])).count() == 0


@pytest.mark.parametrize("width", [20, 40, 60, 72, 79])
def test_known_texts_are_found_at_any_width(spark, width):
    wrap = lambda text, w: "\n\n".join(textwrap.fill(p, w, break_long_words=False, break_on_hyphens=False) for p in text.split("\n\n"))
    notices = ["Copyright (c) 2020 A. Person", "Copyright © A. Person", "Copyright 2020 A. Person", "Copyright by A. Person", "Copyright The Authors", "Copyright holder: A. Person, 2020"]
    cases = [(name, notices[(i + w) % len(notices)] + "\n\n" + wrap(text, w)) for i, (name, text) in enumerate(license_scan.KNOWN) for w in range(width, width + 8)]
    cases.append(("ISC", dict(license_scan.KNOWN)["ISC"].replace("above copyright", "above\ncopyright")))
    found = {r.doc_id: r.license for r in license_scan.scanned(documents(spark, [(i, text, None) for i, (_, text) in enumerate(cases)])).collect()}
    assert found == {i: name for i, (name, _) in enumerate(cases)}


def test_whole_licences_are_found_and_every_known_text_has_an_anchor(spark):
    known = license_scan.known_texts()
    assert {"Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "GPL-2.0-only", "GPL-3.0-only", "LGPL-2.1-only", "LGPL-3.0-only", "MPL-2.0", "Unlicense", "CC0-1.0"} <= {name for name, _ in known}
    rows = [(i, text, None) for i, (_, text) in enumerate(known)]
    rows += [(1000 + i, "".join(f"  {line.upper()} \r\n" for line in text.split("\n")), None) for i, text, _ in rows]
    rows += [(2000 + i, text + " but changed", None) for i, text, _ in rows[: len(known)]]
    rows += [(3000, "Released under the MIT License.\n" * 200_000, None), (3001, "Licence", None), (3001, "Licence", None)]
    found = {r.doc_id: (r.license, r.n_license_lines) for r in license_scan.scanned(documents(spark, rows)).collect()}
    for i, (name, text) in enumerate(known):
        assert found[i][0] == found[1000 + i][0] == name and found[2000 + i][0] is None
        assert any(a in text.lower() for a in license_scan.ANCHORS)
    assert found[3000] == (None, 200_000) and found[3001] == (None, 0)
    forms = license_scan.canonical(F.lower("text"))
    assert spark.createDataFrame([(t,) for _, t in known], "text string").select(license_scan.anchored(forms).alias("a")).filter("not a").count() == 0


def test_equal_known_texts_go_by_the_first_name_and_many_are_joined(spark, monkeypatch):
    monkeypatch.setattr(license_scan, "BROADCAST_DIGESTS", 1)
    known = [("b", "Some licence."), ("a", "some LICENSE"), ("c", "other licence")]
    rows = [(1, "(Some) licence", None), (2, "other license\nsome licence\nSome licence!", None), (None, "none", None)]
    found = license_scan.scanned(documents(spark, rows).withColumn("row", F.lit(0)), known).collect()
    assert sorted(map(str, (tuple(r) for r in found))) == sorted(map(str, [(1, "a", 1, "a"), (2, None, 3, "a,c"), (None, None, 0, "")]))
    assert license_scan.scanned(documents(spark, rows), []).filter("license is null").count() == 3


# 10 urls


def test_url_rules(spark):
    urls = {
        "https://a.example.org/es/1?x": ("a.example.org", "/es/1", "example.org/es/", "block"),
        "HTTP://Example.ORG/en/17#t": ("example.org", "/en/17", "example.org/en/1", "block"),
        "http://notexample.org/es/": ("notexample.org", "/es/", "org/", "allow"),
        "http://org/es/": ("org", "/es/", "org/", "allow"),
        "http://x.com/fr/": ("x.com", "/fr/", "com/fr/", "allow"),
        "http://x.com/de/9": ("x.com", "/de/9", "com/de/", "block"),
        "http://x.com/FR/": ("x.com", "/FR/", None, "allow"),
        "http://www.cheap-pills.example.com/en": ("www.cheap-pills.example.com", "/en", None, "block"),
        "http://phishing-x.net/": ("phishing-x.net", "/", None, "block"),
        "http://spam-farm.example.org": ("spam-farm.example.org", "", None, "block"),
        "ftp://a://b/c": ("a:", "//b/c", None, "allow"),
        "no-scheme/org/": ("", "", None, "allow"),
        "://": ("", "", None, "allow"),
        "": ("", "", None, "allow"),
        None: ("", "", None, "allow"),
    }
    rows = [(i, u, "clash") for i, u in enumerate(urls)] + [(99, "http://x.com/fr/", "twice")]
    pages = spark.createDataFrame(rows, "page_id long, url string, rule string")
    found = {r.page_id: tuple(r)[1:] for r in url_filter.judged(pages, url_filter.rule_table(spark)).collect()}
    assert [found[i] for i in range(len(urls))] == list(urls.values()) and found[99] == urls["http://x.com/fr/"]
    assert url_filter.judged(pages.limit(0), url_filter.rule_table(spark)).count() == 0


def test_url_rules_against_running_all_of_them(spark):
    rng = random.Random(31)
    parts = ["example", "org", "com", "spam", "farm", "casino", "porn", "es", "en", "fr", "de", "1", "pills", "malware-", "x"]
    urls = ["http://" + rng.choice([".", "-"]).join(rng.choices(parts, k=rng.randrange(1, 4))) + "/" + "/".join(rng.choices(parts, k=rng.randrange(3))) for _ in range(300)]
    rules = url_filter.rule_table(spark)
    table = sorted((tuple(r) for r in rules.collect()), key=lambda r: (-r[4], r[0]))
    found = url_filter.judged(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), rules).collect()
    for r in found:
        hit = next(((x[1], x[2]) for x in table if re.search(x[3], r.host + r.path)), (None, "allow"))
        assert (r.rule, r.verdict) == hit
