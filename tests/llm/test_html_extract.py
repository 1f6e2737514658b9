from scoreloom.llm import html_extract as m

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body class="c">
<header><a href=x>Home</a></header><nav><ul><li>menu</li></ul></nav><div class="notice-bar">We use cookies.</div>
<article><h1>Caf&eacute; &amp;amp</h1><p>One  two
three &lt;b&gt;.<p>Second<br>line&nbsp;<b>bold</b>.</p><aside>side</aside><div class="ad top">Buy!</div><form><p>Name</p></form>
<ul><li>Item one.<li>Item two.</ul><section id="comments"><p>Reader says long long text here.</p></section></article><footer>&copy;</footer></body>"""
TEXT = "Café &amp\nOne two three <b>.\nSecond line bold.\nItem one.\nItem two."


def test_article_without_boilerplate():
    path, _ = m.best_path(PAGE)
    assert path == ">html>body.c>article" and m.extract(PAGE, path) == TEXT


def test_broken_and_empty_pages():
    assert m.extract(None, None) == m.extract("", ">html") == m.extract("<nav>x</nav>", None) == ""
    assert m.extract("<body><p>a<p>b <!-- x --", None) == "a\nb"
    assert m.extract('<div class="x>y"><p title=">">a</p></div><', None).startswith("a")


def test_hosts_agree_and_other_pages_fall_back(spark):
    page = lambda body, side: f"<html><body><div class='main'>{body}</div><div class='teaser7'>{side}</div></body></html>"
    long, short = "<p>" + "Words of text here. " * 20 + "</p>", "<p>Short.</p>"
    rows = [(i, f"https://a.org:80/{i}", page(long, short)) for i in range(5)]
    rows += [(5, "http://u@A.org/5", page(short, long)), (6, "https://b.org/x", page(short, long)), (7, "https://a.org/7", "<body><td>Alone.</td></body>"), (8, None, None), (8, None, None)]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, text string")
    found = sorted((r.page_id, r.text, r.n_chars) for r in m.extract_pages(pages).collect())
    assert found[5] == (5, "Short.", 6)  # by the votes of its host
    assert found[6][1].startswith("Words") and found[7][1] == "Alone." and found[8:] == [(8, "", 0)] * 2
    paths = {r.host: r.path for r in m.winning_paths(pages).collect()}
    assert paths["a.org"].endswith("div.main") and paths["b.org"].endswith("div.teaser#")
    assert m.extract_pages(pages.limit(0)).count() == 0


def test_title_and_sections_around_the_best_container(spark):
    text = lambda word, n: "<p>" + f"{word} text here. " * n + "</p>"
    wrapped = f"<html><body><div class=top>Elsewhere.</div><article><h1>T</h1><p>Lead.</p><div class=body>{text('Long', 40)}{text('More', 30)}</div></article></body>"
    split = f"<html><body><main><article><h1>T</h1><section class=one>{text('First', 40)}</section><section class=two>{text('Second', 32)}</section><section class=three>{text('Third', 30)}</section></article></main></body>"
    divs = f"<html><body><div class=post><div class=one>{text('First', 40)}</div><div class=two>{text('Second', 32)}</div></div><div class=side>Other.</div></body>"
    assert m.best_path(wrapped)[0] == ">html>body>article" and m.best_path(split)[0] == ">html>body>main>article" and m.best_path(divs)[0] == ">html>body>div.post"
    rows = [(1, "https://a.org/1", wrapped), (2, "https://b.org/1", split), (3, "https://b.org/2", split), (4, "https://c.org/1", divs)]
    found = {r.page_id: r.text.split("\n") for r in m.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert found[1][:2] == ["T", "Lead."] and [x.split()[0] for x in found[1][2:]] == ["Long", "More"]
    assert [x.split()[0] for x in found[2]] == [x.split()[0] for x in found[3]] == ["T", "First", "Second", "Third"]
    assert [x.split()[0] for x in found[4]] == ["First", "Second"]


def test_labels_of_the_whole_page_and_of_states_mark_nothing_out():
    text = "<p>Words of the article.</p>"
    for open_tags in (
        "<html class='header-fixed'><body>", "<body class='has-sidebar'>", "<body class='sidebar no-comments'>", "<body><main class=widget>",
        "<body><article class='post comments-open'>", "<body><div class='with-sidebar'>", "<body><div class='comments-closed navbar-fixed'>",
    ):
        page = f"{open_tags}{text}<div class='sidebar no-print'><p>Side.</p></div><div class=comments><p>Reader.</p></div>"
        assert m.extract(page, m.best_path(page)[0]) == "Words of the article.", open_tags
    only = f"<html><body><nav>Menu</nav><div class='page-header'>{text}</div></body></html>"
    assert m.extract(only, m.best_path(only)[0]) == "Words of the article."


def extracted(page):
    return m.extract(page, m.best_path(page)[0])


def test_names_do_not_decide_about_articles():
    text = "<p>" + "Words of the article here. " * 12 + "</p>"
    plain = ("Words of the article here. " * 12).strip()
    for open_tags in ("<body class='home has-sidebar'>", "<main class='content with-sidebar'>", "<article class='post comments-open'>", "<div class='elementor-widget-container'>", "<div id='header-main'>"):
        assert extracted(f"<html>{open_tags}{text}</html>") == plain, open_tags
    inside = f"<body><article><p class='notice-period'>Notice period.</p>{text}<p>A <span class='share'>share</span> of it.</p></article></body>"
    assert extracted(inside) == f"Notice period.\n{plain}\nA share of it."
    head = f"<body><article><header><div><h1>Title</h1></div><p>Lead of it.</p></header>{text}</article></body>"
    assert extracted(head) == f"Title\nLead of it.\n{plain}"
    parts = f"<body><header><h1>Site</h1></header><div class='post'><div class='lead'><p>Lead of it.</p></div><div class='body'>{text}</div></div><div class='side'><p>Else.</p></div></body>"
    assert extracted(parts) == f"Lead of it.\n{plain}"
    comments = f"<body><article>{text}<div id='comments'>{'<article class=comment><p>Reader says much more here.</p></article>' * 40}</div></article></body>"
    assert extracted(comments) == plain
    assert extracted(f"<body><div role=banner><p>Shop.</p></div>{text}<div hidden><p>Not seen.</p></div></body>") == plain


def test_attributes_and_references():
    page = "<body><article><p title=it's data-x='a>b' class = \"q>\">A &lt;b&gt; &#233;&#x20AC; &amp;lt; 1 < 2</p><img alt='x'/><p>B<b/>C</p></article></body>"
    assert extracted(page) == "A <b> é€ &lt; 1 < 2\nBC"
    assert extracted("<article><script>if (a < b) '</p>'</SCRIPT ><p>Seen.</p><style>p{}</style></article><!-- <p>no</p>") == "Seen."


def test_malformed_long_pages_take_linear_time():
    import time

    began = time.monotonic()
    for piece in ("<a ", "<a x='", "<b>", "<div>", "<div><p>", "</p><li>", "<!--", "<script>", "&", "<a href=x>", "<table><tr><td>", "<ul><li><b>"):
        page = "<article><p>Start.</p>" + piece * (100_000 // len(piece))
        assert m.extract(page, m.best_path(page)[0]).startswith("Start.")
    assert m.extract("<p>Start.</p>" + "<a " * 1_700_000, None) == "Start."
    assert m.extract("<div><p>x" * 60_000, None) == "\n".join(["x"] * 60_000)
    assert time.monotonic() - began < 120


def test_ties_of_votes_go_to_the_smaller_path(spark):
    text = "<p>" + "Words of text here. " * 20 + "</p>"
    rows = [(1, "http://t.org/1", f"<body><div class=b>{text}</div></body>"), (2, "http://t.org/2", f"<body><div class=a>{text}</div></body>")]
    assert [r.path for r in m.winning_paths(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()] == [">body>div.a"]


def test_generated_pages_against_their_texts(spark):
    import random

    rng = random.Random(9)
    sentence = lambda n: " ".join(rng.choice(["Alpha", "beta", "gamma", "delta", "epsilon"]) for _ in range(n)) + "."
    layouts = [
        lambda a: f"<main><article class='post has-sidebar'>{a}<section id=comments><p>{sentence(40)}</p></section></article><aside>{sentence(9)}</aside></main>",
        lambda a: f"<div id=page><div class='content'>{a}</div><div class='sidebar'><p>{sentence(60)}</p></div></div>",
        lambda a: f"<table><tr><td class=nav><a href=x>{sentence(3)}</a></td><td class=text>{a}</td></tr></table>",
    ]
    rows, expected = [], {}
    for i in range(60):
        parts = [sentence(rng.randrange(8, 60)) for _ in range(rng.randrange(2, 7))]
        body = "".join(f"<p>{p}</p>" if rng.random() < 0.7 else f"<p>{p}" for p in parts)
        page = f"<html><head><title>x</title></head><body class='single no-js'><nav><ul><li><a href=/>{sentence(2)}</a></ul></nav>{layouts[i % 3](body)}<footer><p>{sentence(20)}</p></footer></body></html>"
        rows.append((i, f"https://h{i % 3}.org/{i}", page))
        expected[i] = "\n".join(parts)
    found = m.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string"))
    assert {r.page_id: r.text for r in found.collect()} == expected


def test_adverts_notices_and_comments_inside_an_article():
    body = "".join(f"<p>Sentence {i} of the article goes on for a while, and then it ends.</p>" for i in range(6))
    plain = "\n".join(f"Sentence {i} of the article goes on for a while, and then it ends." for i in range(6))
    extracted = lambda inside: m.extract(f"<html><body><article>{inside}</article></body></html>", None)
    for gone in (
        "<p class='advert'>Buy now!</p>", "<p class=notice>We use cookies on this page.</p>", "<span class='ad'>Best price today.</span>", "<ol class='commentlist'><li>First! Nice read.</li></ol>",
        "<div class='advert-leaderboard'>Buy.</div>", "<div class='ad-slot-2'>Buy.</div>", "<div id=cookie-notice>Cookies.</div>", "<ul class='share-buttons'><li>Tell a friend.</li></ul>",
        "<section class='user-comments'><article><p>I do not agree with this.</p></article></section>", "<div class='related-posts'><p>Read this as well.</p></div>", "<div class='AdBox'>Buy.</div>",
    ):
        assert extracted(gone + body) == extracted(body + gone) == plain, gone
    for kept, text in (
        ("<div class='notice-period'>A notice period applies.</div>", "A notice period applies."), ("<section class='header-files'><p>Header files come first.</p></section>", "Header files come first."),
        ("<dl class='menu'><dt>Soup</dt><dd>Five.</dd></dl>", "Soup\nFive."), ("<div class='ad-hoc'>An ad-hoc group met.</div>", "An ad-hoc group met."), ("<p class='alert-levels'>Levels.</p>", "Levels."),
        ("<p>One <span class='ad-hoc'>group</span> met.</p>", "One group met."), ("<p>A <span class='ad'>hidden</span> word.</p>", "A word."), ("<div class='has-sidebar'>Text.</div>", "Text."),
    ):
        assert extracted(body + kept) == f"{plain}\n{text}", kept


def test_generated_articles_with_adverts_notices_and_comments(spark):
    import random

    rng = random.Random(7)
    sentence = lambda n: " ".join(rng.choice(["stone", "river", "light", "walked", "under", "green", "quiet"]) for _ in range(n)).capitalize() + "."
    noise = [
        "<div class='ad-unit'><p>{}</p></div>", "<p class='advertisement'>{}</p>", "<div class='notice'>{}</div>", "<aside><p>{}</p></aside>", "<div class='newsletter-box'><p>{}</p><form><input></form></div>",
        "<div class='sponsored-content'><p>{}</p></div>", "<figure><figcaption class='advert'>{}</figcaption></figure>",
    ]
    pages, texts = [], []
    for i in range(40):
        parts, kept = [], []
        for _ in range(rng.randint(4, 9)):
            kept.append(sentence(rng.randint(8, 40)))
            parts.append(f"<p>{kept[-1]}</p>")
            if rng.random() < 0.4:
                parts.append(rng.choice(noise[:6]).format(sentence(12)))
        comments = "".join(f"<li class='comment'><p>{sentence(15)}</p></li>" for _ in range(rng.randint(0, 6)))
        article = f"<article><h1>Title {i}</h1>{''.join(parts)}<section id='comments'><h2>Comments</h2><ol class='commentlist'>{comments}</ol></section></article>"
        pages.append((i, f"https://h{i % 3}.example/{i}", f"<html><body><nav><a href=/>Home</a></nav>{article}<footer>{sentence(9)}</footer></body></html>"))
        texts.append("\n".join([f"Title {i}", *kept]))
    found = {r["page_id"]: r["text"] for r in m.extract_pages(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert [found[i] for i in range(40)] == texts


def test_null_page_ids(spark):
    pages = spark.createDataFrame([(None, None, "<p>A.</p>"), (None, "x", None)], "page_id long, url string, html string")
    assert sorted((r["page_id"] is None, r["text"], r["n_chars"]) for r in m.extract_pages(pages).collect()) == [(True, "", 0), (True, "A.", 2)]
