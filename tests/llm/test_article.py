"""What an article keeps and loses: shared headings, controls, links, comments, menus; generated pages with known articles."""

import random

from trialloom.llm.htmltemplate import extract_group

WORDS = [f"word{i}" for i in range(3000)]


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n)) + "."


def test_headings_that_pages_share_stay_above_their_sections():
    rng = random.Random(1)
    bodies = [(prose(rng, 5), prose(rng, 30), prose(rng, 40)) for _ in range(10)]
    shell = "<html><body><nav><a href=/>Home</a></nav><div class=main><h1>{}</h1><h2>Ingredients</h2><p>{}</p><h2>Method</h2><p>{}</p>" \
            "<h2>More recipes</h2><ul><li><a href=/1>One</a></li><li><a href=/2>Two</a></li></ul></div><footer>Site</footer></body></html>"
    got = extract_group([shell.format(*b) for b in bodies])
    assert got == [f"{a}\nIngredients\n{b}\nMethod\n{c}" for a, b, c in bodies]


def test_labels_and_fieldsets_of_an_article_stay():
    page = "<body><article><h1>Forms</h1><fieldset><p>In a set.</p></fieldset><p>A <label>labelled</label> word.</p>" \
           "<form><label>Name</label><input></form></article><label>Outside</label></body>"
    assert extract_group([page]) == ["Forms\nIn a set.\nA labelled word."]


def test_a_paragraph_that_is_one_link_stays():
    assert extract_group(["<body><p><a href=/x>All of the text is a link</a></p></body>"]) == ["All of the text is a link"]
    assert extract_group(["<body><div><p>Own text.</p><p><a href=/x>Linked paragraph</a></p><p>More.</p></div></body>"]) == [
        "Own text.\nLinked paragraph\nMore."]
    assert extract_group(["<body><ul><li><a href=/x>Only</a></li><li><a href=/y>menus</a></li></ul></body>"]) == [""]


def test_threads_of_comments_go_without_a_template():
    thread = "<section id=comments><h2>Comments</h2><div class=c><span class=author>Ann</span><p>First!</p></div>" \
             "<div class=c><span class=author>Bob</span><p>Second.</p></div></section>"
    assert extract_group([f"<body><article><p>The text.</p>{thread}</article></body>"]) == ["The text."]
    essay = "<section id=comments><h2>On comments</h2><p>What readers write.</p><p>And why.</p></section>"
    assert extract_group([f"<body><article><p>The text.</p>{essay}</article></body>"]) == ["The text.\nOn comments\nWhat readers write.\nAnd why."]


def test_plain_menus_and_copyright_lines_go_without_a_template():
    page = "<body><ul><li><a href=/>Home</a></li><li><a href=/b>Blog</a></li></ul><p>The text goes on.</p><p>Copyright matters here.</p>" \
           "<p>It ends.</p><p>© 2024 Some Company. All rights reserved.</p></body>"
    assert extract_group([page]) == ["The text goes on.\nCopyright matters here.\nIt ends."]


def test_generated_pages_give_their_articles():
    """Sites of different shapes; the article is what was put in, whatever stands around it."""
    rng = random.Random(7)
    shells = [
        "<html><head><title>t</title></head><body><header>Site head</header><nav><ul><li><a href=/>Home</a></li></ul></nav><main><article>{}</article></main>"
        "<aside><p>Side text for all</p></aside><footer>Foot</footer></body></html>",
        "<body><div id=top><a href=/>Home</a> <a href=/a>About</a></div><div id=content>{}</div><div class=sidebar><p>Read our books today</p></div>"
        "<div id=bottom><p>All rights reserved by the site</p></div><script>var a = '<p>no</p>';</script></body>",
        "<body><table><tr><td><a href=/1>One</a></td></tr><tr><td class=story>{}</td></tr></table><div class=cookie-notice>We use cookies</div></body>",
    ]
    for shell in shells:
        pages, want = [], []
        for _ in range(9):
            parts = [("h1", prose(rng, 6))]
            for _ in range(rng.randrange(2, 7)):
                parts.append((rng.choice(["p", "p", "p", "h2", "blockquote"]), prose(rng, rng.choice([8, 30, 80]))))
            parts.append(("p", prose(rng, 20)))
            pages.append(shell.format("".join(f"<{t}>{x}</{t}>\n" for t, x in parts)))
            want.append("\n".join(x for _, x in parts))
        assert extract_group(pages) == want
