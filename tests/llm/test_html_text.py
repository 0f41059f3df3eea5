import pytest

from salmoura.llm.html_text import extracted, lines, main_text, stretches

ARTICLE = "".join(f"<p>Sentence number {i} of the article, long enough to count as text.</p>" for i in range(6))
BODY = "\n\n".join(f"Sentence number {i} of the article, long enough to count as text." for i in range(6))


@pytest.mark.parametrize("html, text", [
    (None, ""), ("", ""), ("   ", ""), ("plain text &amp; more", "plain text & more"), ("<", "<"),
    ("<p>a\n <b>b</b>&nbsp;c<br>d<p>e</p>", "a b c d\n\ne"),
    ("<nav><a href=/>menu</a></nav><article><h1>T</h1><p>x.</p><p>y</p></article><footer>f</footer>", "T\n\nx.\n\ny"),
    ("<article><p>a</p><script>var t='</p>'</script><style>p{}</style><p>b</p><!-- <p>c</p> --></article>", "a\n\nb"),
    ("<main><p>A.</p><form>Name<input></form><aside>side</aside><p>B.</p><section id=comments><article><p>reader"
     "</p></article></section></main>", "A.\n\nB."),
    (f"<div class='cookie-notice'>We use cookies</div><ul><li><a href=/>Home</a></li></ul>{ARTICLE}<div class=sidebar>"
     "Other</div><div id='comments'><p>First!</p></div>", BODY),
    (f"<header>Site</header><div>{ARTICLE}</div><div class='ad banner'>Buy now</div>", BODY),
    (f"<body class='has sidebar'><div>{ARTICLE}</div>", BODY),
    ("<article><p>cut &lt;off&gt; in the mid", "cut <off> in the mid"),
    ("<article><p>cut in a tag</p><p clas", "cut in a tag"),
    ("<article><header><h1>Head</h1></header><p>x</p><table><tr><td>1</td><td>2</td></tr></table></article>", "Head\n\nx\n\n1\n\n2"),
    ("<p title='a > b'>quoted</p>", "quoted"), ("<p title='open>x</p>", "x"), ("a < b and c > d", "a < b and c > d"),
])
def test_main_text(html, text):
    assert main_text(html) == text


@pytest.mark.parametrize("html, text", [
    ("<article><h2 id='related-work'>Related work</h2><p id='social-effects'>a</p><h2 id='reply'>b</h2></article>", "Related work\n\na\n\nb"),
    ("<article class='post has-comments'><p>a</p></article>", "a"),
    ("<main><article class='post has-comments'><p>a</p></article></main>", "a"),
    ("<div class='content-sidebar-wrap'><article><p>a</p></article></div>", "a"),
    ("<div class='has-sidebar'><div class='banner'>x</div><article><p>a</p></article><div id='comments'><article>c</article></div></div>", "a"),
    ("<article><p>a</p><article class='comment'><p>c</p></article></article>", "a"),
    ("<div class='sidebar'><div class='menu'><article><p>a</p></article></div></div>", "a"),
    ("<nav><div class='sidebar'><article>n</article></div></nav><p>a</p>", "a"),
    ("<article><p>a</p></article><div id='comments'><article>c</article></div>", "a"),
    (f"{ARTICLE}<div class='related'><article></article></div>", BODY),
])
def test_names_of_texts_and_of_what_is_around_an_article_do_not_count(html, text):
    assert main_text(html) == text
    assert len(main_text("<div class=ad>" * 5_000 + "<article>x")) == 1


SHORT, LONG = "s" * 80, "l" * 400
AD = "<div class='ad'>buy</div>"


@pytest.mark.parametrize("html, text", [
    (f"<div><p>{SHORT}</p>{AD}{f'<p>{LONG}</p>' * 5}{AD}<p>{SHORT}</p></div>", [SHORT, *[LONG] * 5, SHORT]),
    (f"<div><section><p>{SHORT}</p></section>{AD}<section>{f'<p>{LONG}</p>' * 5}</section></div>", [SHORT, *[LONG] * 5]),
    (f"<div><p>{SHORT}</p><ul class='menu'><li>m</ul>{f'<p>{LONG}</p>' * 5}</div><div class='ad'>b</div><div>foot</div>", [SHORT, *[LONG] * 5]),
    (f"<div>{AD}<p>{SHORT}</p></div>{AD}<div><p>{LONG}</p></div>{AD}<div><p>{'m' * 100}</p></div>", [LONG, "m" * 100]),
    (f"<p>{LONG}</p><p><a>{'a' * 30}</a> and {'b' * 10}</p><p>{LONG}</p>", [LONG, "a" * 30 + " and " + "b" * 10, LONG]),
    (f"<p>{LONG}</p><p><a>one</a></p><p><a>two</a></p><ul><li><a>home</a></ul><div><a>contact</a> | <a>details</a></div>", [LONG]),
])
def test_unmarked_pages_keep_the_whole_container(html, text):
    assert main_text(html) == "\n\n".join(text)


def test_stretches_surge_and_dive():
    assert stretches([0, 0, 0, 5, 0, 7, 0, 0, 0, 2, 0]) == [(3, 6), (9, 10)]
    assert stretches([]) == [] and stretches([0, 0]) == [] and stretches([3]) == [(0, 1)]


def test_long_and_hostile_pages():
    assert main_text("<article><p>" + "word " * 200_000 + "</article>").count("word") == 200_000
    assert len(lines("<div>" * 20_000 + "x" + "</div>" * 20_000)) == 1
    assert main_text("<p a='" * 3_000) == ""
    assert main_text("<!--" * 3_000) == ""


def test_rows(spark):
    rows = [(1, "u", "<p>é</p>"), (1, "u", "<p>é</p>"), (None, None, None), (2, "", "")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'x' AS text", "1 AS n_chars")
    found = sorted(map(tuple, extracted(df).collect()), key=str)
    assert found == sorted([(1, "u", "é", 1), (1, "u", "é", 1), (None, None, "", 0), (2, "", "", 0)], key=str)
    assert extracted(df.limit(0)).count() == 0
