"""HTML extraction, WARC and exact search on small and awkward tables."""

import math
import random

import pytest
from fixtures import sentence
from pyspark.sql import functions as F

from trialloom.llm import htmltemplate, topk, warc

PAGE = """<!DOCTYPE html><html><head><title>T {i}</title><style>p{{x:1}}</style><script>var a="<p>no</p>";</script></head><body>
<header class="top"><a href="/">Site</a> Welcome to the site</header><nav><ul>{menu}</ul></nav><div class="sidebar">Popular {i}</div>
<div id="cookie-notice">We use cookies</div><main><article><h1>Title &amp; {i}</h1><p>{body}<p>Second&nbsp;part of <b>{i}</b><br>ends here
<div class="ad">Buy {i}</div><form><input name=q>Search {i}</form><p>Follow our feed for more news every day of the week</p></article>
<section class="comments"><div class=c><b>Ann {i}</b><p>Nice text {i}</p></div><div class=c><b>Bob {i}</b><p>I agree</p></div></section></main>
<footer>&copy; Site {i}</footer>"""


def pages(n=12):
    rng = random.Random(1)
    return [(i, f"http://host.example/{i}", PAGE.format(i=i, body=sentence(rng, 60 + i), menu="".join(
        f"<li><a href=/{j}>Menu {j}" for j in range(2 + i % 3)))) for i in range(n)]


def table(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string").withColumns(
        {c: F.lit(c) for c in ("host", "shard", "n", "text", "record", "row", "digest")})


def test_html_main_text(spark):
    rows = pages()
    rng = random.Random(1)
    want = {i: "\n".join([f"Title & {i}", sentence(rng, 60 + i), f"Second part of {i} ends here"]) for i in range(12)}
    got = {r.page_id: r for r in htmltemplate.extract(table(spark, rows)).collect()}
    assert {i: got[i].text for i in want} == want  # what all pages say alike is the template's
    assert all(r.n_chars == len(r.text) for r in got.values())


def test_html_groups_copies_and_awkward_pages(spark):
    same = pages(1)[0][2]
    rows = pages(40) + [(100 + i, "http://copies.example/x", same) for i in range(30)]
    rows += [(200, None, None), (201, None, ""), (202, "http://a.example/", "no markup at all"), (203, "http://a.example/", "<p>un<b>closed <i>tags &lt; 3"),
             (204, "http://b.example/", "<div><article>" + "<p>word</p>" * 20_000), (None, "http://c.example/", "<main><p>a</p><nav>m</nav></main>"),
             (205, "nourl", "<script>x"), (205, "nourl", "<script>x"), (206, "http://d.example/", "<" * 50 + "a b=\"c")]
    got = sorted(((r.page_id is None, r.page_id or 0, r.text) for r in htmltemplate.extract(table(spark, rows), group=8).collect()))
    text = {p: t for none, p, t in got if not none}
    assert len(got) == len(rows) and text[200] == text[201] == text[205] == "" and text[202] == "no markup at all"
    assert text[203] == "unclosed tags < 3" and text[204] == "\n".join(["word"] * 20_000) and got[-1][2] == "a"
    assert len({text[100 + i] for i in range(30)}) == 1 and "Title & 0" in text[100] and "Menu" not in text[100]
    assert htmltemplate.extract(table(spark, [])).collect() == []


def test_template_classes():
    docs = [htmltemplate.events(h) for _, _, h in pages(6)]
    found = htmltemplate.deduce(docs)
    words = {w for _, w in found.wording()}
    assert {"cookies", "Welcome", "Follow"} <= words and "Title" in words and not any(w.startswith("w1") for w in words)
    assert found.frame == [t for t in htmltemplate.tokens(docs[0]) if t in set(found.frame)]
    assert htmltemplate.deduce(docs[:2]) is None


def test_html_raw_elements_do_not_swallow_the_page():
    icon = "<article><p>one <svg class=i viewBox='0 0 1 1'/>two</p><p>three <svg><title/><path d='M0'/></svg>four</p><p>five <math/>six</p>"
    custom = "<title-bar>seven</title-bar><svg-icon>eight</svg-icon><object-card>nine</object-card><template-x>ten</template-x>"
    shown = "<p>eleven <math><mi>x</mi><mo>=</mo><mn>2</mn></math></p><object data=a>twelve</object><svg><text>no</text><p>thirteen</p>"
    hidden = "<template><p>no</p></template><noscript>no</noscript><iframe src=a>no</iframe><textarea>no</textarea><p>fourteen <iframe>fifteen</p>"
    got = htmltemplate.extract_group([icon + custom + shown + hidden + "</article>"])[0]
    assert got.split() == ("one two three four five six seven eight nine ten eleven x=2 twelve thirteen fourteen fifteen").split()
    assert "one two" in got.split("\n") and "three four" in got.split("\n")


def test_html_template_survives_empty_and_other_pages():
    docs = [h for _, _, h in pages(12)]
    want = htmltemplate.extract_group(docs)
    other = "<html><body><table><tr><td class=x>Quite another layout</td></tr></table></body></html>"
    got = htmltemplate.extract_group(["", *docs, "<p> </p>", other])
    assert got[1:-2] == want and got[0] == got[-2] == "" and got[-1] == "Quite another layout"
    assert not any("Follow our feed" in text for text in want)


def test_html_wording_by_spread():
    rng = random.Random(4)
    notice = "This notice stands below every article of this site and says the same thing again and again to all who read it"
    form = "<html><body><main><p>{}</p><p>{}</p></main></body></html>"
    long = [sentence(rng, 150) for _ in range(8)]
    short = sentence(rng, 4)
    assert htmltemplate.extract_group([form.format(t, notice) for t in [*long, short]]) == [*long, short]
    near = [f"{i} {long[0]}" for i in range(8)]  # near copies share their article, not a template
    assert htmltemplate.extract_group([form.format(t, long[1]) for t in near]) == [f"{t}\n{long[1]}" for t in near]


def test_html_names_only_hint():
    parts = ['<h2 id="related-work">a', '<section id="search-methods">b</section>', '<p id="market-share">c', '<h3 id="modal-logic">d',
             '<h2 id="ad-hoc">e', '<div class="overflow hidden">f</div>', '<p class="block hidden sm:block">g', '<p title="the hidden life">h',
             '<section id="comments">i</section>', '<p class=notice>j', '<p><span class=copyright>k</span>']
    gone = ['<div class="ad">no</div>', '<p hidden>no', '<div style="color:red;display: none">no</div>', '<div class="share-buttons x">no</div>']
    page = "<html><body><article>" + "".join(parts + gone) + "</article></body></html>"
    assert htmltemplate.extract_group([page]) == ["\n".join("abcdefghijk")]
    rng = random.Random(6)
    bodies = [sentence(rng, 80) for _ in range(6)]
    form = "<html><body><div class=top>Site</div><article><p>{}</p><div class=ad>Buy {}</div>{}</article></body></html>"
    once = '<div class="search">about searching</div>'  # in one page only: no block of the template
    got = htmltemplate.extract_group([form.format(b, i, once if i == 2 else "") for i, b in enumerate(bodies)])
    assert got == [b + "\nabout searching" * (i == 2) for i, b in enumerate(bodies)]


def test_html_whole_article_in_sibling_elements():
    rng = random.Random(7)
    form = ("<html><body><div class=top>Welcome to the site</div><div class=m><ul><li><a href=/>Home</a><li><a href=/b>Blog</a></ul></div>"
            "<div class=wrap><div class=title>{}</div><section class=intro>{}</section><section class=body>{}</section></div></body></html>")
    parts = [(f"Title {i} {sentence(rng, 3)}", sentence(rng, 20), sentence(rng, 90)) for i in range(9)]
    assert htmltemplate.extract_group([form.format(*p) for p in parts]) == ["\n".join(p) for p in parts]
    assert htmltemplate.extract_group([form.format(*p) for p in parts[:1]]) == ["Welcome to the site\n" + "\n".join(parts[0])]
    several = '<body><main><h1>T</h1><article id=a1>{}</article><article id=b2>{} <a href=x>{}</a></article></main></body>'
    assert htmltemplate.extract_group([several.format("one", "two", "three")]) == ["T\none\ntwo three"]
    assert htmltemplate.extract_group([several.format(*p) for p in parts[:5]]) == [f"{a}\n{b} {c}" for a, b, c in parts[:5]]  # T is template
    assert htmltemplate.extract_group(["<body><div><h1>T</h1></div><article>one</article></body>"]) == ["T\none"]


def warc_rows():
    rng = random.Random(2)
    rows = [(i, f"http://h/{i}", sentence(rng, rng.choice([1, 50, 9000]))) for i in range(25)]
    rows += [(30 + i, "http://h/copy", "copied page") for i in range(40)]
    return rows + [(90, None, None), (91, "http://h/ é\r\nX: 1", ""), (92, "u", "a\r\n\r\nWARC/1.1\r\n\r\n"), (93, "u", "日本 \x00 ü" * 3000)]


def test_warc_round_trip(spark, tmp_path):
    rows = warc_rows()
    warc.write_archives(table(spark, rows), str(tmp_path / "a"), segment=500, records=7)
    got = {int(r.page): r for r in warc.read_archives(spark, str(tmp_path / "a"), keep_payload=True).collect()}
    newest = {}
    for i, _, html in rows:
        newest[html or ""] = max(i, newest.get(html or "", -1))
    for i, _, html in rows:
        body = (html or "").encode()
        r, first = got[i], newest[html or ""] == i
        assert (r.payload_bytes, r.payload_digest, r.record_type) == (len(body), warc.digest(body), "response" if first else "revisit")
        assert (r.refers_to or None) == (None if first else str(newest[html or ""])) and (not first or r.html == (html or ""))
    assert len(got) == len(rows)


def test_warc_repeated_rows_and_rows_without_id(spark, tmp_path):
    rows = [(1, "u", "x"), (1, "u", "x"), (None, "u", "x"), (None, "u", "only"), (None, "u", "only")]
    warc.write_archives(table(spark, rows), str(tmp_path / "a"))
    got = sorted((str(r.page), r.record_type, str(r.refers_to), r.payload_bytes) for r in warc.read_archives(spark, str(tmp_path / "a")).collect())
    assert got == sorted([("1", "response", "None", 1)] * 2 + [("None", "revisit", "1", 1)] + [("None", "response", "None", 4)] * 2)
    warc.write_archives(table(spark, []), str(tmp_path / "b"))
    assert warc.read_archives(spark, str(tmp_path / "b")).collect() == []


def test_segments_are_verified():
    records = warc.page_records("k", 1, "u", b"payload " * 400, False, segment=300)
    blocks = [b for _, b in warc.parse(b"".join(r + b"\r\n\r\n" for r in records))]
    fields = [f for f, _ in warc.parse(b"".join(r + b"\r\n\r\n" for r in records))]
    total = int(fields[-1]["warc-segment-total-length"])
    numbers = [int(f["warc-segment-number"]) for f in fields]
    assert {f["warc-segment-origin-id"] for f in fields[1:]} == {fields[0]["warc-record-id"]}
    assert warc.payload_of(warc.join_segments("r", numbers, blocks, total)) == b"payload " * 400
    for wrong in ((numbers[:-1], blocks[:-1]), (numbers[1:], blocks[1:]), ([1, *numbers], [blocks[0], *blocks])):
        with pytest.raises(ValueError):
            warc.join_segments("r", *wrong, total)
    with pytest.raises(ValueError):
        warc.checked("r", blocks[0], "OTHER")
    assert warc.unchunked(b"3;x=1\r\nabc\r\n2\r\nde\r\n0\r\nTrailer: x\r\n\r\n") == b"abcde"


def brute_topk(rows, k=20):
    good = [(i, [math.floor(64 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, qv in good:
        if q % 20 == 0:
            scored = sorted(((-sum(a * b for a, b in zip(qv, v)), i) for i, v in good if i != q and len(v) == len(qv)))[:k]
            out += [(q, rank, i, -s) for rank, (s, i) in enumerate(scored, 1)]
    return sorted(out)


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, vector array<float>").withColumns({c: F.lit(c) for c in ("q", "rank", "score")})


def found(spark, rows, **kw):
    df = topk.search(vectors(spark, rows), F.pmod(F.col("vec_id"), F.lit(20)) == 0, **kw)
    return sorted((r.query_id, r.rank, r.vec_id, r.score) for r in df.collect())


def test_topk_matches_brute_force(spark):
    rng = random.Random(3)
    rows = [(i, [rng.gauss(0, 1) * (1 + i % 7) for _ in range(40)]) for i in range(600)]
    hot = [rng.gauss(0, 1) for _ in range(40)]
    rows += [(600 + i, hot) for i in range(300)]  # a third of the rows ties
    rows += [(1001, None), (1002, [math.nan] * 40), (1003, [math.inf] + [0.0] * 39), (1004, [None] * 40), (1020, []), (1021, []), (1040, [1.0, 2.0]), (None, hot)]
    assert found(spark, rows) == brute_topk(rows)
    assert found(spark, rows, block=9) == brute_topk(rows)


def test_topk_small_huge_and_repeated(spark):
    assert found(spark, []) == []
    assert found(spark, [(0, [1.0])]) == []
    few = [(0, [1.0, -2.0]), (3, [-0.5, 0.25]), (7, [0.5, 0.25]), (0, [1.0, -2.0])]
    assert found(spark, few) == brute_topk(few[:3])
    big = [(0, [1e7, 3.0]), (1, [1e6, 1.0]), (2, [1e6, 2.0]), (4, [-1e6, 2.0])]  # beyond what doubles hold exactly
    assert found(spark, big) == brute_topk(big)
    assert [x[3] for x in found(spark, [(0, [3e38]), (1, [3e38]), (2, [-3e38])])] == [(1 << 63) - 1, -(1 << 63)]
