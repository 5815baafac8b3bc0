"""Templates of a site by the distinct page contents that have them."""


def texts(spark, pages):
    from glyphflow.llm.html_text import extract_main_text

    rows = [(k, f"http://h.example/{k}", p) for k, p in enumerate(pages)]
    return {r.page_id: r.text for r in extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}


def test_a_template_is_found_on_a_host_of_any_size(spark):
    block = "<div><div>Read our long list of partners</div><div>and of friends</div></div>"
    pages = [f"<body>{block if k < 6 else ''}<div>own {k}</div>" for k in range(40)]
    assert texts(spark, pages) == {k: f"own {k}" for k in range(40)}


def test_copies_of_an_article_count_once(spark):
    article = "<div><div>The same article on many pages</div></div>"
    pages = [f"<body><nav>path {k}</nav>{article}" for k in range(8)] + [f"<body>{article}<div>note {k}</div>" for k in range(2)]
    got = texts(spark, pages)
    assert all(got[k] == "The same article on many pages" for k in range(8))


def test_paragraphs_are_spared_in_an_article_only(spark):
    line, cell = "<p>All rights reserved</p>", "<table><tr><td>Home</td><td>News {0}</td></tr></table>"
    bare = [f"<body>{cell.format(k)}<p>own <b>bold</b> text {k}</p>{line}" for k in range(6)]
    inside = [f"<body><article><p>own text {k}</p>{line}</article>" for k in range(6)]
    assert texts(spark, bare + inside) == {k: f"News {k}\nown bold text {k}" for k in range(6)} | {6 + k: f"own text {k}\nAll rights reserved" for k in range(6)}


def test_shared_and_joined_templates_give_the_same(spark):
    from glyphflow.llm.html_text import extract_main_text

    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    assert sorted(extract_main_text(pages).collect(), key=str) == sorted(extract_main_text(pages, shared=-1).collect(), key=str)


def test_words_of_a_layout_delete_nothing():
    from glyphflow.llm.html_text import main_text

    assert main_text('<article class="post no-sidebar"><p>Hello world</p></article>') == "Hello world"
    assert main_text('<div class="page has-sidebar"><article><p>Hello</p></article></div>') == "Hello"
    assert main_text('<main class="search-optimised-article">x</main>') == "x"
    assert main_text('<div class="widget"><article>in</article></div><div class="ad-box">buy</div>') == "in"
    assert main_text('<div class="related"><article>teaser</article></div><article>real</article>') == "real"
    assert main_text('<p>a</p><div id="cookie-notice">b</div><div class="siteFooter">c</div>') == "a"


def test_cut_off_pages_are_parsed_in_linear_time():
    import time

    from glyphflow.llm.html_text import main_text

    for x in ('<a x="" ', "<a ", "<a x='", "<b>", "<b></x>", "</", "<!", "<script ", "<p>", 'a="', "&", "<!--"):
        t = time.process_time()
        main_text(x * ((1 << 20) // len(x)))
        assert time.process_time() - t < 20, x
    assert main_text("<p>one</p>two <a href='") == "one\ntwo"
    assert main_text("a < b</ p>c<?x?>d<p title='it's'>e") == "a < bcd\ne"
    assert main_text('<script>var t="</p>";</script>z<SCRIPT>q</Script >w<title>t') == "zw"


def test_rows_with_clashing_columns_nulls_and_repeats(spark):
    from glyphflow.llm.html_text import extract_main_text

    rows = [(1, "http://h/1", "<p>a</p>", "x", 1), (1, "http://h/1", "<p>a</p>", "y", 2), (None, None, None, None, 3)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string, hash long")
    assert sorted((r.page_id or 0, r.text, r.n_chars) for r in extract_main_text(pages).collect()) == [(0, "", 0), (1, "a", 1), (1, "a", 1)]
    assert extract_main_text(pages.where("hash > 9")).count() == 0


def test_a_raw_element_costs_no_copy_of_the_page():
    """A page of other letters was translated as a whole, letter by letter, for its first script."""
    import time

    from glyphflow.llm.html_text import main_text, parse

    page = "<script>var t='</scripty>';</SCRIPT\n>" + "é" * (6 << 20)
    t = time.process_time()
    parse(page)
    assert time.process_time() - t < 0.5
    assert main_text("<script>a</ſcript>b</script/>c<style>d</STYLE") == "c"
