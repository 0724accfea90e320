"""Main text of pages: parsing, alignment, templates."""

import itertools
import random

from tallywork.llm import pages


def text_of(html, shared=()):
    return pages.main_text(pages.lines_of(html), set(shared))


def test_article_without_its_surroundings():
    html = """<!DOCTYPE html><html><head><title>T</title><script>var x = "<p>no</p>"</script><style>p{}</style></head><body>
    <header><h1>Site</h1></header><nav><ul><li>Home</li></ul></nav><div class="cookie-notice">We use cookies</div>
    <article><h1>Title &amp; more</h1><p>First <b>bold</b>
       line&nbsp;one.<p>Second<br>half <i>x</i>y &lt;tag&gt; &#233;&eacute; &amp</p><div class="advert">Buy</div><aside>Side</aside>
    <ul><li>one<li>two</ul><form><input>Name <button>Send</button></form><section id="comments"><p>Nice post</p></section><!-- <p>hidden</p> --></article>
    <div class="sidebar">More</div><footer>&copy; us</footer></body></html>"""
    assert text_of(html) == "Title & more\nFirst bold line one.\nSecond\nhalf xy <tag> éé &\none\ntwo"


def test_damaged_markup_gives_text_and_never_fails():
    assert text_of("<article><p>a<b>b<br><p>c</article><footer>f") == "ab\nc"
    assert text_of("plain text") == "plain text" and text_of("") == "" and text_of(None) == ""
    assert text_of("<p>1 < 2 & 3</p><p class='x>y") == "1 < 2 & 3\ny"
    assert text_of("<script>never closed <p>x</p>") == ""
    assert text_of("<div>" * 3000 + "deep") == "deep"
    for seed in range(30):
        r = random.Random(seed)
        html = "".join(r.choice(["<p>", "</p>", "<b", ">", "<div class=\"", "'", "text ", "<!--", "-->", "</article>", "<article>", "&", "&#x;", "<li>", "<td>"]) for _ in range(200))
        text_of(html)


def test_common_lines_is_a_longest_common_subsequence():
    def length(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            last = 0
            for j, y in enumerate(b):
                last, row[j + 1] = row[j + 1], last + 1 if x == y else max(row[j + 1], row[j])
        return row[-1]

    r = random.Random(1)
    for _ in range(300):
        a, b = ([r.randint(0, 6) for _ in range(r.randint(0, 12))] for _ in range(2))
        at = pages.common_lines(a, b)
        assert at == sorted(set(at)) and len(at) == length(a, b)
        used = iter(b)
        assert all(any(a[k] == y for y in used) for k in at)


def flat(k, body):
    return f"<body><div>Our shop</div><div>Call us</div>{''.join(f'<p>{x}</p>' for x in body)}<div>All rights</div></body>"


def test_shared_lines_go_where_no_element_marks_the_article(spark, clashing):
    rows = [(k, f"https://Host.example/{k:03}?q={k}", flat(k, [f"story {k} {j}" for j in range(3)])) for k in range(20)]
    rows += [(50, "https://alone.example/x", flat(50, ["only"])), (51, None, None), (52, "bad url", ""), (53, "https://host.example/003", rows[3][2]), (None, "https://host.example/004", flat(4, ["no id"])), (51, None, None)]
    out = pages.extract(clashing(spark.createDataFrame(rows, "page_id long, url string, html string")))
    got = {r.page_id: r for r in out.collect()}
    assert out.count() == len(rows) and out.columns == ["page_id", "url", "text", "n_chars"]
    for k in range(20):
        assert got[k].text == "\n".join(f"story {k} {j}" for j in range(3))
    assert got[50].text == "Our shop\nCall us\nonly\nAll rights" and got[51].text == got[52].text == "" and got[None].text == "no id"
    assert all(r.n_chars == len(r.text) for r in got.values())


def test_blocks_do_not_change_neighbours(spark, monkeypatch):
    rows = [(k, f"http://h/{k:04}", flat(k, [f"s{k}", f"t{k // 2}"])) for k in range(90)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    whole = {(r.page_id, r.text) for r in pages.extract(df).collect()}
    monkeypatch.setattr(pages, "BLOCK_PAGES", 16)
    assert {(r.page_id, r.text) for r in pages.extract(df.repartition(7)).collect()} == whole
    assert pages.extract(df.limit(0)).count() == 0


def test_places():
    assert pages.place_of("HTTPS://A.b/c/d?e#f") == ("a.b", "/c/d") and pages.place_of(None) == ("", "/") and pages.place_of("//x") == ("x", "/")
    assert list(itertools.islice(pages.place_of("a/b"), 2)) == ["a", "/b"]
