"""Template lines inside articles, and many pages with the very same lines."""

from tallywork.llm import pages


def texts(spark, rows):
    return {r.page_id: r.text for r in pages.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}


def test_lines_of_two_neighbours_go_inside_an_article(spark):
    def page(k, more=()):
        body = "".join(f"<p>{x}</p>" for x in [*(f"story {k} line {j}" for j in range(4)), *more])
        return f"<body><article><div class='zone-7'>Buy our knives</div>{body}<div class='zone-8'>All offers here</div></article></body>"

    rows = [(k, f"http://h/{k:03}", page(k, ["story 4 line 1"] if k == 5 else ())) for k in range(12)]
    rows += [(50 + k, f"http://copies/{k}", page(99).replace("story 99 line 0", f"at {k}")) for k in range(3)]
    got = texts(spark, rows)
    own = {k: [f"story {k} line {j}" for j in range(4)] + (["story 4 line 1"] if k == 5 else []) for k in range(12)}
    assert all(got[k].split("\n") == own[k] for k in own)
    assert all("story 99 line 2" in got[50 + k] for k in range(3))


def test_many_copies_still_find_a_different_neighbour(spark):
    flat = lambda body: f"<body><div>Our shop</div><p>{body}</p><div>All rights</div></body>"
    rows = [(k, f"http://h/m?q={k}", flat("the same")) for k in range(40)] + [(100, "http://h/a", flat("first")), (101, "http://h/z", flat("last"))]
    got = texts(spark, rows)
    assert got == {**{k: "the same" for k in range(40)}, 100: "first", 101: "last"}


def test_titles_and_paragraphs_of_an_article_stay(spark):
    """Neighbours with one title, one closing paragraph and one boxed line in the middle; only the boxes around the article's own lines go."""
    def page(k):
        return f"<body><main><div>Part of our series</div><h1>The same title</h1><p>own {k} a</p><div>boxed alike</div><p>own {k} b</p><p>The same last words</p><div>Read on</div></main></body>"

    got = texts(spark, [(k, f"http://h/{k:03}", page(k)) for k in range(6)])
    assert got == {k: f"The same title\nown {k} a\nboxed alike\nown {k} b\nThe same last words" for k in range(6)}
