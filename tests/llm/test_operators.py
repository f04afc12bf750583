"""The training-data operators against brute force, the libraries, and odd tables."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from twinreel.llm import entry, exact_dedup, html_extract, line_dedup, mixing, ngram_join, piece_codec, pieces, quality, token_counts, topk, toxicity
from twinreel.llm.common import read

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, keep_id string, n_tokens string"


def docs(spark, rows):
    """Documents with columns whose names clash with those of results."""
    return spark.createDataFrame([(i, t, "en", s, 0, "x", "y", "z") for i, t, s in rows], SCHEMA)


ODD = [
    (1, "a b c", "s"), (2, "a b c", "s"), (3, None, None), (4, "", "t"), (4, "", "t"), (None, "a b c", "s"), (None, None, None),
    (5, "word " * 30000, "s"), (6, "É ▁ x\n\t  y　z 🎉\x00", "t"), (7, "one", None),
]


def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=entry.piece_model())


def test_tokens_equal_the_library(spark):
    sp = library()
    table = docs(spark, ODD)
    texts = sorted((t or "") for _, t, _ in ODD)
    counts = token_counts.token_counts(table, entry.piece_model()).collect()
    assert sorted(r.n_tokens for r in counts) == sorted(len(sp.encode(t)) for t in texts)
    assert sorted(r.n_bytes for r in counts) == sorted(len(t.encode()) for t in texts)
    assert [r.over_limit for r in counts if r.doc_id == 5] == [True]
    coded = piece_codec.encode_decode(table, entry.piece_model(), keep_text=True).collect()
    want = Counter((",".join(map(str, ids)), sp.decode(ids)) for ids in map(sp.encode, texts))
    assert Counter((",".join(map(str, r.ids)), r.decoded) for r in coded) == want
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert Counter((r.ids_sha256, r.decoded_sha256) for r in coded) == Counter({(digest(a), digest(b)): n for (a, b), n in want.items()})


def test_units_and_agenda_equal_the_library_on_random_texts():
    model, proof, sp = entry.piece_model(), pieces.prove(entry.piece_model()), library()
    codec, counter = piece_codec.Codec(model, proof), token_counts.Counter(model, proof)
    assert proof.proven and all(re.compile(pieces.UNIT).fullmatch(p.replace("▁", " ")) for p in codec.vocabulary.ids)
    assert all(len(sp.encode("\n" + s)) == 3 for s in random.Random(1).sample(sorted(proof.shortcut), 500))
    with pytest.raises(ValueError, match="not the model that was proven"):
        pieces.Vocabulary(model, proof._replace(digest=""))
    rng, parts = random.Random(2), [*"abe \n\t▁.,;12²éü漢🎉\x00-_()", "  ", "the", "ing", "<s>", "</s>"]
    texts = ["".join(rng.choices(parts, k=rng.randrange(60))) for _ in range(1500)] + ["", " ", "a" * 3000]
    want = sp.encode(texts)
    assert counter.count(texts) == [len(w) for w in want]
    assert codec.encode(texts) == [(",".join(map(str, w)), len(w), sp.decode(w), 0) for w in want] and codec.mismatches == 0


def test_whole_tables_equal_the_library(spark):
    sp = library()
    texts = {r.doc_id: r.text for r in read(spark, SF, "documents").collect()}
    got = entry.op3_piece_codec(spark, SF).collect()
    assert not any(r.n_corrected for r in got)
    assert {r.doc_id: r.n_tokens for r in got} == {i: len(sp.encode(t or "")) for i, t in texts.items()}
    assert {r.doc_id: r.n_tokens for r in entry.op1_token_counts(spark, SF).collect()} == {r.doc_id: r.n_tokens for r in got}
    assert all(r.decoded_sha256 == hashlib.sha256((texts[r.doc_id] or "").encode()).hexdigest() for r in got if "▁" not in (texts[r.doc_id] or ""))


def test_exact_dedup(spark):
    got = exact_dedup.exact_dedup(docs(spark, ODD)).collect()
    assert len(got) == len(ODD)
    groups = defaultdict(list)
    for i, t, _ in ODD:
        groups[hashlib.sha256((t or "").encode()).hexdigest()].append(i)
    for r in got:
        ids = groups[r.text_sha256]
        known = [i for i in ids if i is not None]
        assert r.group_size == len(ids) and r.keep_id == (max(known) if known else None)
    kept = Counter(r.text_sha256 for r in got if r.kept)
    assert set(kept) == set(groups) and set(kept.values()) == {1}
    assert exact_dedup.exact_dedup(docs(spark, [])).count() == 0


@pytest.mark.parametrize(("short", "full"), [(1, 32), (1, 1)])
def test_exact_dedup_compares_bytes_where_hashes_collide(spark, short, full):
    rows = [(i, f"text {i % 300}", "s") for i in range(900)] + [(900, None, "s"), (None, "text 1", "s"), (5, "text 5", "s")]
    got = exact_dedup.exact_dedup(docs(spark, rows), hash_bytes=short, full_bytes=full).collect()
    want = exact_dedup.exact_dedup(docs(spark, rows)).collect()
    assert Counter(map(tuple, got)) == Counter(map(tuple, want))
    sizes = Counter(t or "" for _, t, _ in rows)
    most = {t: max(i for i, u, _ in rows if u == t and i is not None) for t in sizes if t}
    names = {hashlib.sha256(t.encode()).hexdigest(): t for t in sizes}
    assert all(r.group_size == sizes[names[r.text_sha256]] and r.keep_id == most.get(names[r.text_sha256], 900) for r in got)


def test_mixing(spark):
    rng = random.Random(3)
    rows = [(i, "w " * rng.randrange(200), s) for s, n in (("a", 400), ("b", 30), ("c", 60), (None, 20)) for i in range(n)]
    rows = [(k, t, s) for k, (_, t, s) in enumerate(rows)]
    got = mixing.mix(docs(spark, rows)).collect()
    again = {r.doc_id: r.taken for r in mixing.mix(docs(spark, rows).repartition(7)).collect()}
    assert {r.doc_id: r.taken for r in got} == again and len(got) == len(rows)
    source = {k: s for k, _, s in rows}
    size, taken, target = Counter(), Counter(), {}
    for r in got:
        size[source[r.doc_id]] += r.size
        taken[source[r.doc_id]] += r.taken
        target[source[r.doc_id]] = r.target
        assert 0 <= r.taken <= 3 * r.size
    weights, open_, want = {"a": 5, "b": 2, "c": 1, None: 5}, set(size), {}
    while True:
        level = (sum(size.values()) - sum(want.values())) / sum(weights[s] for s in open_)
        over = {s for s in open_ if level * weights[s] > 3 * size[s]}
        if not over:
            break
        want |= {s: 3 * size[s] for s in over}
        open_ -= over
    want |= {s: level * weights[s] for s in open_}
    for s in size:
        assert target[s] == pytest.approx(want[s]) and abs(taken[s] - want[s]) <= 200
    odd = mixing.mix(docs(spark, ODD)).collect()
    assert len(odd) == len(ODD) and all(r.taken <= 3 * r.size for r in odd)
    assert mixing.mix(docs(spark, [])).count() == 0


def brute_lines(rows):
    """What line_dedup leaves of (id, text) rows with different ids, as a program over lists."""
    md5 = lambda s: hashlib.md5(s.encode()).hexdigest()
    words = lambda line: len(line.strip(" ").split(" "))
    chunks, windows, lines_of = defaultdict(list), defaultdict(list), {}
    for i, t in sorted((i, t) for i, t in rows if t is not None):
        lines = lines_of[i] = t.split("\n")
        long = [words(x) >= 50 for x in lines]
        start = 0
        for k, x in enumerate(lines):
            rolled = md5((md5(lines[k - 1]) if k else "") + md5(x))
            if k == len(lines) - 1 or rolled[0] < "5" or long[k] or long[k + 1]:
                if k > start or long[start]:
                    chunks["\n".join(lines[start : k + 1])].append((i, start, k + 1))
                start = k + 1
        for k in range(len(lines) - 1):
            windows["\n".join(lines[k : k + 2])].append((i, k))
    lost = defaultdict(set)
    for places in chunks.values():
        for i, low, high in sorted(places)[1:]:
            lost[i] |= set(range(low, high))
    repeated = {p: p == min(places) for places in windows.values() if len(places) > 1 for p in places}
    for (i, k), first in repeated.items():
        low, high = k, k
        while (i, low - 1) in repeated:
            low -= 1
        while (i, high + 1) in repeated:
            high += 1
        if not first and sum(map(words, lines_of[i][low : high + 2])) >= 50:
            lost[i] |= {k, k + 1}
    return {i: (None if t is None else "\n".join(x for k, x in enumerate(lines_of[i]) if k not in lost[i]), len(lost[i])) for i, t in rows}


def test_line_dedup(spark):
    passage = " ".join(f"w{i}" for i in range(60))
    rows = [(1, f"x1\n{passage}\ny1", "s"), (2, f"x2\ny2\n{passage}\nz2", "s"), (3, "only here\nand here", "s"), (4, None, "s"), (5, "", "s"), (6, "only here\nand here", "s")]
    got = {r.doc_id: r for r in line_dedup.line_dedup(docs(spark, rows)).collect()}
    assert got[1].text == rows[0][1] and got[2].text == "x2\ny2\nz2" and got[2].n_removed == 1
    assert got[3].text == rows[2][1] and got[6].text == brute_lines([(i, t) for i, t, _ in rows])[6][0] and got[4].text is None and got[5].text == ""
    assert line_dedup.line_dedup(docs(spark, ODD)).count() == len(ODD) and line_dedup.line_dedup(docs(spark, [])).count() == 0


def test_line_dedup_equals_brute_force_and_misses_no_passage(spark):
    """Passages of four to six short lines, over 50 words each, between lines of their own."""
    rng = random.Random(21)
    line = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    passages = [[line(rng.randrange(12, 16)) for _ in range(rng.randrange(4, 7))] for _ in range(25)]
    rows = [(i, "\n".join([line(9) for _ in range(rng.randrange(4))] + rng.choice(passages) + [line(9) for _ in range(rng.randrange(4))])) for i in range(120)]
    rows += [(120, "\n".join(["short one"] * 6)), (121, None), (122, "\n\n\n"), (123, "\n\n\n")]
    got = {r.doc_id: (r.text, r.n_removed) for r in line_dedup.line_dedup(docs(spark, [(i, t, "s") for i, t in rows])).collect()}
    assert got == brute_lines(rows)
    left = "\n".join(t for t, _ in got.values() if t)
    assert all(left.count("\n".join(p)) <= 1 and left.count(p[0]) <= 1 for p in passages)


def brute_components(rows, words, percent):
    sets = {}
    for i, t in rows:
        w = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "").encode().split()
        sets[i] = {tuple(w[k : k + words]) for k in range(max(1, len(w) - words + 1))} if w else set()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                common = len(sets[a] & sets[b])
                if 100 * common >= percent * (len(sets[a]) + len(sets[b]) - common):
                    ra, rb = find(a), find(b)
                    root[max(ra, rb)] = min(ra, rb)
    return {i: (len(sets[i]), find(i)) for i in ids}


@pytest.mark.parametrize(("words", "percent"), [(3, 90), (5, 80)])
def test_ngram_join_equals_brute_force(spark, words, percent):
    rng = random.Random(words)
    rows = [(0, None), (1, ""), (2, "a"), (3, "A"), (4, "a b"), (5, "x y z")]
    for length in (9, 12, 40, 150):
        base = [f"w{rng.randrange(3000)}" for _ in range(length)]
        for _ in range(12):
            copy = list(base)
            for _ in range(rng.randrange(0, 3 + length // 30)):
                copy[rng.randrange(length)] = f"v{rng.randrange(9999)}"
            rows.append((len(rows), " ".join(copy)))
    rows += [(len(rows) + k, "the same start here " + " ".join(f"u{rng.randrange(99999)}" for _ in range(30))) for k in range(15)]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.ngram_join(docs(spark, [(i, t, "s") for i, t in rows]), words, percent).collect()}
    assert got == brute_components(rows, words, percent)


def test_ngram_join_odd_tables(spark):
    got = ngram_join.ngram_join(docs(spark, ODD)).collect()
    assert len(got) == len(ODD) and {r.component_id for r in got if r.doc_id in (1, 2)} == {1}
    assert all(r.component_id is None for r in got if r.doc_id is None)
    assert ngram_join.ngram_join(docs(spark, [])).count() == 0


PAGE = """<html><head><title>T</title><style>p{{}}</style><script>var a = "</p>";</script></head><body>
<header><h1>Site</h1></header><nav><ul><li><a href="/">Home</a></li></ul></nav><div class="cookie-notice"><p>We use cookies, a lot of them, really.</p></div>
<aside class="sidebar"><p>Read this instead of what you came for</p></aside>
<div class="content post-{n}"><h1>Head {n}</h1><p>First &amp; <b>bold</b>
  text<br>more&nbsp;here</p><!-- <p>no</p> --><ul><li>item</li></ul><form><input><p>Sign up</p></form></div>
<div id="comments"><p>{long}</p></div><footer>&copy; me</footer></body></html>"""


def test_html_extraction(spark):
    rows = [(n, f"http://Host.example/{n}", PAGE.format(n=n, long="great page! " * (200 if n == 3 else 1))) for n in range(6)]
    rows += [(7, None, None), (8, "http://host.example/x", ""), (9, "u", "no markup, just text &lt;here"), (9, "u", "no markup, just text &lt;here")]
    got = html_extract.extract_pages(spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, text string")).collect()
    by = {r.page_id: r for r in got}
    assert len(got) == len(rows)
    for n in range(6):
        assert by[n].text == f"Head {n}\nFirst & bold text more here\nitem" and by[n].n_chars == len(by[n].text)
    assert by[7].text == "" and by[8].text == "" and by[9].text == "no markup, just text <here"


LONG = "The long story of a short day and what came of it in the end, told again. " * 4


@pytest.mark.parametrize(
    ("html", "want"),
    [
        ('<div class="page has-sidebar"><div class="sidebar">no</div><article><p>{0}</p></article></div>', "{0}"),
        ('<article class="post no-comments"><p>{0}</p></article><div class="comments">{0}{0}</div>', "{0}"),
        ('<article><p>{0}</p><div class="search-results"><p>Kept</p></div><div class="ad">Buy</div></article>', "{0}\nKept"),
        ('<article><p>{0} <span class="ad">BUY <b>now</b></span> end <a class="share" href="/">tell all</a></p></article>', "{0} end"),
        ('<div class="comments">{0}{0}</div><div class="content"><p>{0}</p></div>', "{0}"),
        ('<div id="wrap"><div class="widget"><p>{0}</p></div></div>', "{0}"),
        ('<main class="sidebar-left"><article class="comment">{0}{0}</article><article class="story"><p>{0}</p></article></main>', None),
        ('<div class="cookieNotice">We use them</div><div class="entry"><p>{0}</p><p hidden>x</p></div>', "{0}"),
        ("<p>{0}" + "<div>" * 60 + "deep" + "</div>" * 60, "{0}\ndeep"),
    ],
)
def test_html_parts_are_judged_by_content(html, want):
    page = html_extract.Page(f"<html><body>{html.format(LONG)}</body></html>")
    text = page.text(page.best_path())
    assert text == want.format(LONG.strip()) if want else text == LONG.strip()


def test_html_hosts_vote(spark):
    """The path of most pages of a host wins, counted by hand; a page without it goes by its own."""
    rows = [(i, f"http://a.example/{i}", f'<body><div class="x{i}"><p>{LONG}</p></div><div class="note"><p>{LONG * (3 if i == 0 else 0)}n</p></div></body>') for i in range(7)]
    rows += [(20 + i, f"http://b.example/{i}", f'<body><section class="s"><p>{LONG}{i}</p></section></body>') for i in range(3)]
    rows += [(30, "http://b.example/other", f'<body><div class="t"><p>{LONG}other</p></div></body>')]
    got = {r.page_id: r.text for r in html_extract.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    votes = defaultdict(Counter)
    for _, url, html in rows:
        votes[url.split("/")[2]][html_extract.Page(html).best_path()] += 1
    for i, url, html in rows:
        counted = votes[url.split("/")[2]]
        assert got[i] == html_extract.Page(html).text(min(counted, key=lambda p: (-counted[p], p)))
    assert got[0] == LONG.strip() and got[22] == f"{LONG}2" and got[30] == f"{LONG}other"


PIECES = {
    "nav": ["<nav><ul><li><a href=/>Home<li><a href=/b>Shop</ul></nav>", "<div class='main-menu navbar'><a>Start</a> <a>News</a></div>"],
    "head": ["<header><h1>Site</h1><p>motto</p></header>", '<div id="masthead">Daily &amp; Sunday</div>'],
    "side": ["<aside><p>See also</p></aside>", '<div class="sidebar widget"><p>Top ten</p><p>Most read</p></div>', "<SCRIPT>if (a < b) { x = '<p>no</p>' }</SCRIPT>", "<style>p > a {}</style>"],
    "inner": ['<div class="advert">Buy now</div>', '<form><input name=q><button>Go</button></form>', "<!-- <p>hidden</p> -->", '<p style="display: none">no</p>', '<aside class=pull>Quote</aside>', "<noscript>turn it on</noscript>"],
    "foot": ["<footer>All rights</footer>", '<div class="cookie-consent">We use them</div><div class="comments"><p>First!</p><p>İ agree</p></div>'],
}
FRAMES = [
    "<!DOCTYPE html><html><head><title>T</title></head><body>{nav}{head}<article>{body}</article>{side}{foot}</body></html>",
    '<HTML><BODY>{head}{nav}<div class="wrap has-sidebar"><div class="content post-12"><section>{body}</section></div>{side}</div>{foot}</BODY></HTML>',
    "<body>{nav}<main>{head}<div>{body}</div></main>{side}{foot}",
    '<body><table><tr><td>{side}<td class="story">{body}</table>{foot}{nav}',
]


def test_html_templates_with_known_texts(spark):
    """Pages put together from parts whose article is known: no other parser is asked."""
    from html import escape

    rng, rows, want = random.Random(13), [], {}
    words = "lorem dolor İstanbul ſome straße a<b x&y 5>3 “quoted” naïve and the of".split()
    for i in range(160):
        frame = i % len(FRAMES)
        blocks, parts = [], []
        for k in range(rng.randrange(2, 7)):
            text = " ".join(rng.choices(words, k=rng.randrange(12, 60)))
            blocks.append(text)
            shown = escape(text).replace(" ", rng.choice([" ", "\n ", "&#32;", "\t"]))
            tag = rng.choice(["p", "P", "div", "blockquote", "h2", "pre"])
            inside = rng.choice(["{}", "<b>{}</b>", '<a href="/x?a=1&b=2" title="a > b">{}</a>', "<span class=lead>{}</span>"])
            parts.append(f"<{tag}>{inside.format(shown)}" + ("" if tag == "p" and rng.random() < 0.4 else f"</{tag}>"))
            if rng.random() < 0.4:
                parts.append(rng.choice(PIECES["inner"]))
        pick = {k: rng.choice(v) for k, v in PIECES.items() if k != "inner"}
        if frame == 2:
            pick["head"] = ""
        rows.append((i, f"http://host{frame}.example/{i}", FRAMES[frame].format(body="".join(parts), **pick)))
        want[i] = "\n".join(blocks)
    got = {r.page_id: r.text for r in html_extract.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert [i for i in want if got[i] != want[i]] == []


def test_html_of_broken_or_deep_pages_takes_time_by_length():
    import time
    import tracemalloc

    assert html_extract.Page("<p>one</p><SCRIPT>x</SCRIPT><p>İ two</p><STYLE>y</style><p>three</p>").text(None) == "one\nİ two\nthree"
    began = time.time()
    for broken in ("<a ", "<!", "<a href='", '<p class="', "</", "<!--", "</x>", "<p <b "):
        html_extract.Page(broken * 10_000 + "end")
    assert html_extract.Page("<p>a <b one <i two>c</i></p>").text(None) == "a c"
    assert time.time() - began < 20
    tracemalloc.start()
    n = 20_000
    page = html_extract.Page("<div class=section>" * n + "text" + "</p></li></x>" * n)
    assert page.text(page.best_path()) == "text" and tracemalloc.get_traced_memory()[1] < 60e6
    tracemalloc.stop()
    began = time.time()
    html_extract.Page("<ul><li>" + "<div class=ad>" * n + "<li></li>" * n)
    html_extract.Page("<li><ul>" + "<div>" * n + "<li></li><dt></dt><td></td>" * n)
    assert time.time() - began < 20


def test_html_extraction_of_all_pages(spark):
    from html import unescape

    for r in html_extract.extract_pages(read(spark, SF, "pages")).join(read(spark, SF, "pages").select("page_id", "html"), "page_id").collect():
        body = r.html[r.html.index("<article>") + 9 : r.html.index("</article>")]
        blocks = [" ".join(unescape(re.sub(r"<[^>]*>", " ", b)).split()) for b in re.split(r"</?(?:p|h1)>", body)]
        assert r.text == "\n".join(b for b in blocks if b)


def test_quality(spark):
    labels = read(spark, SF, "labels")
    got = {r.doc_id: r for r in quality.quality(read(spark, SF, "documents"), labels).collect()}
    marked = {r.doc_id: r.quality for r in labels.collect()}
    good, bad = [i for i, q in marked.items() if q == 1], [i for i, q in marked.items() if q == 0]
    assert sum(got[i].kept for i in good) >= 0.95 * len(good) and sum(got[i].kept for i in bad) <= 0.5 * len(bad)
    odd = quality.quality(docs(spark, ODD), labels).collect()
    assert len(odd) == len(ODD) and all(r.kept == bool(r.n_symbols) or r.n_symbols for r in odd)
    assert quality.quality(docs(spark, []), labels.limit(0)).count() == 0


def brute_kneser_ney(texts):
    """cost(history, symbol) of interpolated modified Kneser-Ney over dictionaries."""
    n = quality.ORDER
    counts = [Counter() for _ in range(n)]
    for t in texts:
        t = "\0" * (n - 1) + t
        counts[n - 1].update(t[i - n + 1 : i + 1] for i in range(n - 1, len(t)))
    for k in range(n - 2, -1, -1):
        counts[k].update(gram[1:] for gram in counts[k + 1])
    below, off = 1 / (len(counts[0]) + 1), []
    for c in counts:
        n1, n2, n3, n4 = (sum(v == k for v in c.values()) for k in (1, 2, 3, 4))
        y = n1 / (n1 + 2 * n2) if n1 else 0.0
        off.append([min(max(k - (k + 1) * y * b / a, 0.0), k) if a else 0.5 for k, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4))])

    def p(history, symbol):
        k = len(history)
        lower = p(history[1:], symbol) if k else below
        own = {gram: v for gram, v in counts[k].items() if gram[:-1] == history}
        if not own:
            return lower
        total, cut = sum(own.values()), lambda v: off[k][min(v, 3) - 1]
        v = own.get(history + symbol, 0)
        return (v - cut(v) if v else 0) / total + sum(map(cut, own.values())) / total * lower

    return p


def test_quality_equals_a_kneser_ney_model_over_dictionaries(spark, monkeypatch):
    import math

    monkeypatch.setattr(quality, "SLICE", 20)
    monkeypatch.setattr(quality, "BLOCK_CHARS", 100)
    rng = random.Random(3)
    rows = [(i, "".join(rng.choices("abcdé漢🎉 ", weights=[9, 7, 5, 3, 2, 1, 1, 4], k=rng.randrange(1, 70))), "s") for i in range(60)] + [(60, None, "s"), (61, "", "s"), (None, "abc", "s"), (1, "once more", "s")]
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(40)] + [(None, 1), (1000, 1)], "doc_id long, quality int")
    ids = spark.range(1001).select("id", quality.held(F.col("id")).alias("held")).collect()
    kept_back = {r.id for r in ids if r.held}
    trusted = [r for r in rows if r[0] is not None and r[0] < 40 and r[0] % 3 > 0]
    p = brute_kneser_ney([t for i, t, _ in trusted if i not in kept_back])
    assert 0 < sum(i in kept_back for i, _, _ in trusted) < len(trusted)
    assert abs(sum(p("ab", c) for c in "abcdé漢🎉 onmre\0") - 1) < 0.2
    got = quality.quality(docs(spark, rows), labels).collect()
    want = Counter()
    for i, t, _ in rows:
        x = "\0\0\0" + (t or "")
        cost = [-math.log(max(p(x[k - 3 : k], x[k]), 1e-12)) for k in range(3, len(x))]
        want[(i, len(cost), round(math.exp(sum(cost) / len(cost)), 6) if cost else None)] += 1
    assert Counter((r.doc_id, r.n_symbols, r.perplexity and round(r.perplexity, 6)) for r in got) == want
    assert not any(r.kept for r in got if not r.n_symbols)
    # texts longer than a block are scored in parts
    monkeypatch.setattr(quality, "BLOCK_CHARS", 7)
    assert Counter((r.doc_id, r.n_symbols, r.perplexity and round(r.perplexity, 6)) for r in quality.quality(docs(spark, rows), labels).collect()) == want
    assert not [t for t in spark.catalog.listTables() if "quality" in t.name]


def test_quality_thresholds_equal_brute_force(spark, monkeypatch):
    """Which documents are kept, from their perplexities: quantiles of held trusted texts by language, or of all."""
    import math

    monkeypatch.setattr(quality, "FEW", 3)
    rng, rows = random.Random(5), []
    for i in range(400):
        lang = rng.choice(["en", "de", None, "xx"]) if i < 390 else "zz"
        text = "".join(rng.choices("abcdefgh ", k=rng.randrange(5, 60))) if i % 9 else "".join(rng.choices("äöüßxyz 123", k=30))
        rows.append((i, text, lang, "s", 0))
    rows += [(400, None, "en", "s", 0), (401, "", "de", "s", 0), (5, rows[5][1], rows[5][2], "s", 0), (None, "abc", "en", "s", 0)]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([(i, int(i % 9 > 0)) for i in range(0, 300)], "doc_id long, quality int")
    got = quality.quality(table, labels).collect()
    kept_back = {r.id for r in spark.range(401).select("id", quality.held(F.col("id")).alias("held")).collect() if r.held}
    cost = lambda r: math.floor(math.log(r.perplexity) * quality.STEP + 1e-9)
    trusted = [r for r in got if r.doc_id is not None and r.doc_id < 300 and r.doc_id % 9 and r.perplexity]

    def bounds(rows_):
        every, judged = sorted(map(cost, rows_)), sorted(cost(r) for r in rows_ if r.doc_id in kept_back)
        n, judged = len(judged), judged or every
        at = lambda x, q: x[max(0, math.ceil(q * len(x) - 1e-9) - 1)]
        top = at(judged, quality.HIGH)
        return n, at(every, quality.LOW), top + math.ceil((top - at(judged, 0.5)) * quality.MARGIN)

    overall = bounds(trusted)
    for r in got:
        own = [x for x in trusted if x.lang == r.lang]
        n, least, most = bounds(own) if own else (0, 0, 0)
        if n < quality.FEW:
            _, least, most = overall
        if r.perplexity is None:
            assert not r.kept
        elif cost(r) not in (least - 1, least, most, most + 1):  # but for the last digit of the logarithm
            assert r.kept == (least < cost(r) < most), r
    assert 0 < sum(r.kept for r in got) < len(got)
    assert all(r.kept for r in quality.quality(table, labels.limit(0)).collect() if r.n_symbols)


def test_quality_keeps_unlabelled_good_texts_as_trusted_ones(spark):
    """Labels withheld from half of the good documents: they are kept at nearly the rate of the rest."""
    big = "/root/testdata/sf0.1"
    labels = read(spark, big, "labels")
    shown = labels.filter("quality = 0 OR doc_id % 2 = 0")
    got = quality.quality(read(spark, big, "documents"), shown).join(labels, "doc_id").filter("perplexity IS NOT NULL")
    rate = {(r.quality, r.seen): r.kept for r in got.groupBy("quality", (F.col("doc_id") % 2 == 0).alias("seen")).agg(F.avg(F.col("kept").cast("int")).alias("kept")).collect()}
    assert abs(rate[1, True] - rate[1, False]) < 0.03 and min(rate[1, True], rate[1, False]) > 0.95
    assert max(rate[0, True], rate[0, False]) < 0.35


def test_toxicity(spark):
    big = "/root/testdata/sf0.1"
    got = toxicity.toxicity_scores(read(spark, big, "documents"), read(spark, big, "labels"))
    held = got.filter("held_out").join(read(spark, big, "labels"), "doc_id").collect()
    hits = sum(r.predicted and r.toxic for r in held)
    assert hits / sum(r.predicted for r in held) > 0.8 and hits / sum(r.toxic for r in held) >= 0.9
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in held)
    odd = toxicity.toxicity_scores(docs(spark, ODD), read(spark, SF, "labels")).collect()
    assert len(odd) == len(ODD) and all(r.score is not None for r in odd)
    none = toxicity.toxicity_scores(docs(spark, ODD), read(spark, SF, "labels").limit(0)).collect()
    assert {r.score for r in none} == {0.5}


def test_toxicity_sample_leaves_out_texts_beyond_its_bound(spark):
    table = docs(spark, [(i, "nitwit " * (5000 if i == giant else 3), "s") for giant in [0] for i in range(40)])
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, toxic int")
    whole = toxicity.training_sample(table, labels)[0]
    some = toxicity.training_sample(table, labels, chars=2000)[0]
    assert len(whole) == len(some) + (max(map(len, whole)) > 2000) and len(some) > 20
    assert max(map(len, toxicity.training_sample(table, labels, chars=40)[0])) == 21


def test_toxicity_map_is_the_nystrom_map_of_a_kernel_of_texts():
    """Where every word is a landmark the products of maps are the kernel of texts itself."""
    landmarks = ["^alpha", "^beta", "^gamma", "^alphas"]
    kernel = toxicity.Kernel(landmarks)
    texts = ["alpha beta", "gamma alphas alpha", "beta beta gamma", "alphas"]
    root = toxicity.nystrom_root(kernel)
    z = kernel.summed(texts) @ root
    at, k = kernel.values(landmarks)
    gram = np.where(k >= toxicity.NEAR, k, 0).astype(float) ** toxicity.POWER
    mean = np.array([[t.split().count(w[1:]) / len(t.split()) for w in landmarks] for t in texts]) * toxicity.PARTS
    assert z @ z.T == pytest.approx(mean @ gram @ mean.T, rel=1e-3)


def test_toxicity_reads_gapped_and_inserted_letters():
    clean = ["the and for with that from this are was have been more than into over"] * 1
    words = "the and for with that from this are was have been more than into over under after".split()
    rng = random.Random(5)
    texts, toxic = [], []
    for k in range(400):
        w = rng.choices(words, k=30)
        if k % 4 == 0:
            w[3], w[20] = rng.choice(["blockhead", "nitwit"]), rng.choice(["blockhead", "nitwit"])
        texts.append(" ".join(w))
        toxic.append(int(k % 4 == 0))
    model = toxicity.fit(texts, toxic)
    score = toxicity.scorer(model)
    say = lambda w: score([f"{clean[0]} {w} {clean[0]} {w}"])[0]
    assert say("of") < 0.3
    assert min(say(w) for w in ("blockhead", "BLOCK-HEAD", "b l o c k h e a d", "b.l.o.c.k.h.e.a.d", "bloockhead", "nittwit", "nixtwit", "bló¢ckhead")) > 0.3


def test_toxicity_tolerates_another_letter_in_short_words_of_any_script():
    clean = {"en": "the and for with that from this are was have been more than into over".split(), "ru": "и в не на что с как это по они мы вы все так его".split()}
    rude = {"en": ["idiot", "scum"], "ru": ["идиот", "дурак"]}
    rng, texts, toxic = random.Random(7), [], []
    for k in range(600):
        lang = "en" if k % 2 else "ru"
        w = rng.choices(clean[lang], k=25)
        if k % 5 == 0:
            w[4] = rng.choice(rude[lang])
        texts.append(" ".join(w))
        toxic.append(int(k % 5 == 0))
    score = toxicity.scorer(toxicity.fit(texts, toxic))
    say = lambda lang, w: score([" ".join([*clean[lang], w, *clean[lang]])])[0]
    assert max(say("en", "of"), say("ru", "но"), say("en", "idea"), say("ru", "иди"), say("en", "12345")) < 0.3
    assert min(say("en", w) for w in ("idiot", "idixot", "IDIOT!", "scxum", "idi0ot")) >= 0.3
    assert min(say("ru", w) for w in ("идиот", "Идиот", "идижот", "дурщак", "д у р а к")) >= 0.3


def test_toxicity_scores_do_not_depend_on_what_a_worker_remembers():
    rng, clean = random.Random(11), "the and for with that from this are was have been more than".split()
    words = ["".join(rng.choices("bcdfghlmnprst", k=7)) for _ in range(600)]
    texts = [" ".join(rng.sample(words, 12) + clean + ["nitwit"] * (k % 3 == 0)) for k in range(300)]
    model = toxicity.fit(texts, [int(k % 3 == 0) for k in range(300)])
    whole = toxicity.score(model, texts, toxicity.Kernel(model["landmarks"]))
    assert ((whole >= 0.3) == [k % 3 == 0 for k in range(300)]).all()
    for memory in (0, 40, 200):
        kernel = toxicity.Kernel(model["landmarks"], memory)
        parts = [x for low in range(0, 300, 5) for x in toxicity.score(model, texts[low : low + 5], kernel)]
        assert parts == pytest.approx(whole.tolist())


def test_toxicity_kernel_equals_the_naive_one():
    from itertools import combinations

    def phi(word):
        out = Counter()
        for i, j, k in combinations(range(len(word)), 3):
            if k - i < toxicity.SPAN:
                out[word[i] + word[j] + word[k]] += toxicity.DECAY ** (k - i - 2)
        return out

    dot = lambda a, b: sum(v * b[u] for u, v in a.items())
    rng = random.Random(9)
    words = ["".join(rng.choices("abcdé漢я1", k=rng.randrange(3, 15))) for _ in range(60)]
    landmarks = words[:7]
    at, k = toxicity.Kernel(landmarks).values(words)
    assert at.tolist() == list(range(len(words)))
    for w, row in zip(words, k, strict=True):
        for mark, value in zip(landmarks, row, strict=True):
            a, b = phi(w), phi(mark)
            assert value == pytest.approx(dot(a, b) / (dot(a, a) * dot(b, b)) ** 0.5, abs=1e-5)
    assert (toxicity.Kernel(landmarks).bounds(words) >= k.max(axis=1) - 1e-5).all()


def test_top_k(spark):
    import numpy as np

    rng = np.random.default_rng(6)
    rows = [(i, [float(x) for x in rng.normal(size=8)], "x") for i in range(300)]
    rows += [(i, rows[7][1], "x") for i in range(300, 400)]  # ties
    rows += [(400, None, "x"), (450, [float("nan")] * 8, "x"), (451, [1.0, None] + [0.0] * 6, "x"), (None, rows[0][1], "x")]
    got = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<float>, score string"))
    v = {i: np.floor(256 * np.array(np.array(e, np.float32), float)).astype(int) for i, e, _ in rows[:400]}
    want = set()
    for q in range(0, 400, 50):
        best = sorted(((-int(v[q] @ v[c]), c) for c in v if c != q))[:5]
        want |= {(q, n + 1, c, -s) for n, (s, c) in enumerate(best)}
    assert {(r.query_id, r["rank"], r.vec_id, r.score) for r in got.collect()} == want
    few = spark.createDataFrame([(0, [1.0]), (1, [2.0]), (50, [3.0])], "vec_id long, embedding array<float>")
    assert sorted((r.query_id, r.vec_id) for r in topk.top_k(few).collect()) == [(0, 1), (0, 50), (50, 0), (50, 1)]
    assert topk.top_k(few.limit(0)).count() == 0


def test_top_k_takes_rows_that_repeat_an_id(spark):
    rows = [(50, [1.0, 0.0]), (50, [0.0, 1.0]), (50, [0.0, 1.0]), (7, [0.5, 0.25]), (8, [300.0, 1.0])]
    got = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), k=2).collect()
    whole = [(i, [int(256 * x) for x in v]) for i, v in rows]
    want = Counter()
    for a in range(3):
        best = sorted((-sum(x * y for x, y in zip(whole[a][1], whole[b][1], strict=True)), whole[b][0]) for b in range(5) if a != b)[:2]
        want.update((50, n + 1, i, -s) for n, (s, i) in enumerate(best))
    assert Counter((r.query_id, r["rank"], r.vec_id, r.score) for r in got) == want


def test_top_k_sends_no_copies_of_queries_through_the_driver(spark):
    rows = [(i, [float(i % 7), float(i % 11)]) for i in range(300)]
    found = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    assert "BroadcastHashJoin" not in found._jdf.queryExecution().executedPlan().toString() and found.count() == 30


def test_pipeline_stages(spark):
    table = read(spark, SF, "documents")
    rows = table.withColumn("extra", F.lit(1))
    clean = corpus_pipeline.drop_toxic(spark, rows, SF)
    assert clean.columns == rows.columns
    copies = docs(spark, ODD)
    left = corpus_pipeline.drop_copies(spark, copies, SF).collect()
    assert len(left) == len({t or "" for _, t, _ in ODD})
    near = corpus_pipeline.drop_near_copies(spark, table, SF).select("doc_id").collect()
    brute = brute_components([(r.doc_id, r.text) for r in table.collect()], 5, 80)
    assert {r.doc_id for r in near} == {c for _, c in brute.values()}
    mixed = corpus_pipeline.mix_sources(spark, table, SF)
    taken = {r.doc_id: r.taken for r in mixing.mix(table).collect()}
    size = {r.doc_id: r.size for r in mixing.mix(table).collect()}
    assert Counter(r.doc_id for r in mixed.select("doc_id").collect()) == Counter({i: n // size[i] for i, n in taken.items() if n})


def test_pipeline_runs_as_its_stages(spark):
    whole = Counter(r.ids_sha256 for r in corpus_pipeline.run(spark, SF).collect())
    step = read(spark, SF, "documents")
    for _, stage in corpus_pipeline.STAGES:
        step = stage(spark, step, SF)
    assert whole == Counter(r.ids_sha256 for r in step.collect()) and whole


def test_components_extended_by_links_equal_those_of_all_links(spark):
    first, more = [(1, 2), (5, 6), (8, 9), (2, 4)], [(4, 6), (9, 20), (30, 31), (1, 4)]
    frame = lambda rows: spark.createDataFrame(rows, "a long, b long")
    whole = ngram_join.components(frame(first + more)).collect()
    apart = ngram_join.extended(ngram_join.components(frame(first)), frame(more)).collect()
    assert sorted(map(tuple, apart)) == sorted(map(tuple, whole))


def test_bitmaps_never_rule_a_link_out(spark):
    rng, rows = np.random.default_rng(5), []
    for n in (1, 3, 40, 250, 300, 900, 4000):
        for gone in (0.0, 0.05, 0.1, 0.2, 0.3):
            a = np.unique(rng.integers(0, 1 << 62, n).astype(np.uint64))
            b = np.unique(np.r_[a[int(n * gone) :], rng.integers(0, 1 << 62, int(n * gone / 3)).astype(np.uint64)])
            rows.append((len(a), len(b), *(ngram_join.parity_words(x, 80).tolist() for x in (a, b)), ngram_join.linked(a, b, 80)))
    frame = spark.createDataFrame(rows, "n long, m long, x array<long>, y array<long>, ok boolean")
    seen = frame.select("ok", ngram_join.may_link(F.col("n"), F.col("m"), F.col("x"), F.col("y"), 80), "n", "m", *(ngram_join.sketch(c)[f"s{k}"].alias(f"{c}{k}") for c in "xy" for k in range(8))).collect()
    assert all(r[1] for r in seen if r.ok) and not all(r[1] for r in seen if not r.ok)
    import pyarrow as pa

    one = lambda at, part, n, s: [at, 0, 1, part, 2 * at + part, 2 * at + part, n, *s]
    flat = [x for at, r in enumerate(seen) for x in (one(at, 0, r.n, r[4:12]), one(at, 1, r.m, r[12:20]))]
    batch = pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*flat, strict=True)], [*"kijpxcn", *map(str, range(8))])
    batches = [batch.slice(low, 3) for low in range(0, batch.num_rows, 3)]
    left = {a // 2 for out in ngram_join.tile_pairs(batches, 80) for a in out.column(0).to_pylist()}
    assert left >= {at for at, r in enumerate(seen) if r.ok} and len(left) < len(seen)


def test_ngram_join_keeps_links_of_every_text_of_an_id(spark):
    a, b = [" ".join(f"{c}{k}" for k in range(n)) for c, n in (("a", 200), ("b", 60))]
    near = " ".join([*b.split()[:-1], "other"])
    got = ngram_join.ngram_join(docs(spark, [(5, a, "s"), (5, b, "s"), (7, near, "s"), (9, "alone here now", "s")])).collect()
    assert sorted((r.doc_id, r.component_id) for r in got) == [(5, 5), (5, 5), (7, 5), (9, 9)]


@pytest.mark.parametrize("hubs", [0, 1])
def test_ngram_join_in_small_tiles(spark, monkeypatch, hubs):
    """Sets that are alike under many keys and mostly do not link, in several tiles a key."""
    monkeypatch.setattr(ngram_join, "TILE", 4)
    monkeypatch.setattr(ngram_join, "HUBS", hubs)
    rng = random.Random(11)
    base = [f"w{k}" for k in range(60)]
    rows = []
    for i in range(60):
        copy = list(base)
        for at in rng.sample(range(60), rng.randrange(2, 7)):
            copy[at] = f"v{i}-{at}" if rng.random() < 0.7 else f"v{at}"
        rows.append((i, " ".join(copy)))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.ngram_join(docs(spark, [(i, t, "s") for i, t in rows]), 5, 80).collect()}
    assert got == brute_components(rows, 5, 80) and len({c for _, c in got.values()}) > 5


def test_pipeline_stages_on_odd_tables(spark):
    """Null and repeated ids, empty tables and columns with clashing names in each stage."""
    table = docs(spark, ODD)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, table, SF)
        assert out.columns == table.columns and out.count() <= len(ODD) * 3
        assert stage(spark, docs(spark, []), SF).count() == 0
    assert corpus_pipeline.drop_toxic(spark, table, SF).count() == len(ODD)
    # rows 1, 2 and the null id have one text, row 7 is alone, and so are 5 and 6; rows without words all stay
    assert Counter(r.doc_id for r in corpus_pipeline.drop_near_copies(spark, table, SF).collect()) == Counter([1, 3, 4, 4, None, 5, 6, 7])
    mixed = corpus_pipeline.mix_sources(spark, table.withColumn("tw_key", F.lit(1)), SF).collect()
    times = Counter((r.doc_id, r.text) for r in mixed)
    repeated = Counter((i, t) for i, t, _ in ODD)
    assert all(n <= 3 * repeated[key] for key, n in times.items())
    assert corpus_pipeline.encode(spark, table, SF).count() == len(ODD)


HELPERS = ["turn", "times", "mixed_row", "tw_row", "tw_row_", "tw_key", "tw_word", "tw_mark", "tw_place", "tw_marks", "tw_times", "tw_turn", "tw_mixed", "tw_hot", "tw_salt", "TW_Row", "row", "n", "kept", "best", "draw", "size", "copy", "block", "label", "h"]


@pytest.mark.parametrize("stage", [s[0] for s in corpus_pipeline.STAGES[:-1]])
def test_pipeline_stages_leave_columns_of_any_name_alone(spark, stage):
    texts = [f"some words of text number {i} and more of them {i * 7}" for i in range(12)] + ["same text here"] * 3
    base = spark.createDataFrame([(i, t, "en", f"s{i % 3}", 5) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    names = [c for k, c in enumerate(HELPERS) if c.lower() not in [x.lower() for x in HELPERS[:k]]]
    table = base.select("*", *((F.col("doc_id") * 100 + k).alias(c) for k, c in enumerate(names)))
    out = dict(corpus_pipeline.STAGES)[stage](spark, table, SF)
    assert out.columns == table.columns and out.schema == table.schema
    rows = out.collect()
    assert rows and all(r[c] == r.doc_id * 100 + k for r in rows for k, c in enumerate(names))
    plain = dict(corpus_pipeline.STAGES)[stage](spark, base, SF).select("text").collect()
    assert Counter(r.text for r in rows) == Counter(r.text for r in plain)


def test_salted_joins_equal_plain_ones(spark, monkeypatch):
    from twinreel.llm import common

    monkeypatch.setattr(common, "HOT_ROWS", 5)
    rows = spark.createDataFrame([(i, f"k{i % 3}" if i % 4 else "hot") for i in range(300)] + [(999, "none"), (1000, None)], "i int, k string")
    found = rows.filter("k <> 'none'").groupBy("k").agg(F.count("*").alias("n"))
    for how in ("inner", "left"):
        got = common.salted_join(rows, found, ["k"], "n", ["i"], how).select("i", "k", "n").collect()
        assert Counter(got) == Counter(rows.join(found, "k", how).select("i", "k", "n").collect())


def test_mixing_spreads_rows_of_one_id_and_of_one_text(spark):
    rows = [(None, f"text {k} of a hot source", "s") for k in range(300)] + [(1, "same words here", "s")] * 200 + [(k, f"t {k}", "t") for k in range(60)]
    table = docs(spark, rows)
    got = mixing.mix(table).collect()
    assert Counter(r.doc_id for r in got) == Counter(i for i, _, _ in rows)
    for source_size in {r.source_size for r in got}:
        own = [r for r in got if r.source_size == source_size]
        assert sum(r.size for r in own) == source_size and abs(sum(r.taken for r in own) - own[0].target) <= max(r.size for r in own)
    numbered = mixing.mix(table.withColumn("nr", F.monotonically_increasing_id()), row_col="nr").collect()
    assert Counter((r.doc_id, r.size, r.taken) for r in numbered) == Counter((r.doc_id, r.size, r.taken) for r in got)


def test_pipeline_mixes_rows_not_ids(spark):
    rows = [(None, f"n{k} " * (k + 1), "s") for k in range(12)] + [(5, "a b", "s"), (5, "c d e", "t"), (6, "f g", "t"), (None, None, "t")]
    docs = spark.createDataFrame([(i, t, "en", s, 0) for i, t, s in rows], "doc_id long, text string, lang string, source string, n_chars long")
    mixed = corpus_pipeline.mix_sources(spark, docs, "")
    assert mixed.columns == docs.columns
    got = Counter(len(r.text.split()) for r in mixed.collect())
    want = Counter()
    for r in mixing.mix(docs).filter("taken > 0").collect():
        want[r.size] += r.taken // r.size
    assert got == want and max(Counter(r.text for r in mixed.collect()).values()) <= 3
