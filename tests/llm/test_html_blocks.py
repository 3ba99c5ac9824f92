import numpy as np
import pytest

from threadlens.llm import html_blocks as op


def page(i):
    words = f"story {i} goes on with many words, as the text of an article does."
    paragraphs = "".join(f"<p>{words} part {k}.</p>" for k in range(i % 4 + 2))
    return f'<html><head><title>t</title><script>var t="</p>";</script></head><body><nav><ul><li><a href="/a">Home {i}</a></li></ul></nav><!-- ad --><div class="ad">buy now {i}</div><article><h1>Title {i}</h1>{paragraphs}</article><footer>&copy; site</footer></body></html>'


def article(i):
    words = f"story {i} goes on with many words, as the text of an article does."
    return "\n\n".join([f"Title {i}", *(f"{words} part {k}." for k in range(i % 4 + 2))])


@pytest.fixture(scope="module")
def trained(spark):
    pages = spark.createDataFrame([(i, "u", page(i)) for i in range(120)], "page_id long, url string, html string")
    return op.train(pages)


def test_blocks():
    cut = op.blocks("a &lt;b&gt;<p>one\n two<p><b>three<br>four<p>five<!-- <p>no --><script>x</script></div><ul><li>i<li>j</ul>tail<style>s")
    assert [b.text for b in cut] == ["a <b>", "one two", "three four", "five", "i", "j", "tail"]
    assert op.blocks("") == [] and op.blocks("<p></p><br>") == [] and [b.text for b in op.blocks("no tags < at all")] == ["no tags < at all"]


def test_attribute_values_end_by_the_rules():
    texts = lambda page: [b.text for b in op.blocks(page)]
    assert texts("<article><p title=don't>Hello world</p><p>it is fine</p><p>it's > ok</p></article>") == ["Hello world", "it is fine", "it's > ok"]
    assert texts('<p>a<a href="x>bad</p>') == ["abad"] and texts("<p>a<a href='x>bad</p>") == ["abad"]
    assert texts("<p title=\"a > b\">c</p><p data-x='1 > 0' class = x>d</p><p a=b<c>e</p><p =\"q\">f</p>") == ["c", "d", "e", "f"]
    assert texts("<p title='the hidden truth'>kept</p>") == ["kept"]
    assert op.blocks("<p title='the hidden truth'>kept</p>")[0].path[-1][1] == frozenset()
    hidden = ["<p hidden>x", "<p style=\"color:red; display : none\">x", "<p aria-hidden=true>x", "<p class=hidden>x"]
    assert all("hidden" in op.blocks(h)[0].path[-1][1] for h in hidden)
    assert "hidden" not in op.blocks("<p aria-hidden=false id=a_b>x")[0].path[-1][1]
    assert texts("<p>" + "<a " * 20_000 + "end") != []


def test_pages_outside_the_sample(spark, trained):
    pages = spark.createDataFrame(
        [(i, None, page(i), 1) for i in range(500, 540)] + [(1, "u", None, 2), (2, "u", "", 3), (None, "u", page(500), 4), (3, "u", "<nav>only</nav>", 5)],
        "page_id long, url string, html string, n_chars int",
    )
    got = {r.page_id: r for r in op.extract(pages, trained).collect()}
    assert len(got) == 44
    assert all(got[i].text == article(i) for i in range(500, 540)) and got[None].text == article(500)
    assert got[1].text == got[2].text == got[3].text == "" and got[500].n_chars == len(article(500))


def test_without_pages(spark):
    none = spark.createDataFrame([], "page_id long, url string, html string")
    assert op.train(none) is None and op.extract(none, None).count() == 0
    assert op.main_texts([page(1)], None) == [article(1)]


def test_gradients_by_difference():
    random = np.random.default_rng(0)
    x, mask = op._padded([random.normal(size=(n, op.DIMS)).astype(np.float32) for n in (3, 5)])
    w_in, w_re = (random.normal(size=s).astype(np.float64) * 0.1 for s in ((op.DIMS, 4 * op.HIDDEN), (op.HIDDEN, 4 * op.HIDDEN)))
    weigh = random.normal(size=(2, 5, op.HIDDEN)) * mask[..., None]
    kept = []
    op._run(x, mask, w_in, w_re, kept)
    d_in, d_re = op._back(x, weigh, kept, w_re)
    for w, slope in ((w_in, d_in), (w_re, d_re)):
        at = (3, 7)
        base, step = w[at], 1e-2
        w[at] = base + step
        up = (op._run(x, mask, w_in, w_re) * weigh).sum()
        w[at] = base - step
        down = (op._run(x, mask, w_in, w_re) * weigh).sum()
        w[at] = base
        assert abs((up - down) / (2 * step) - slope[at]) < 1e-2 * max(1, abs(slope[at]))


def test_text_after_hidden_elements_stays():
    read = lambda page: [b.text for b in op.blocks(page)]
    assert read("<p>one<object><p>fallback</p></object></p><p>two</p><p>three</p>")[-2:] == ["two", "three"]
    assert read("<p>one<svg><foreignObject><div>x</div></foreignObject></svg></p><p>two</p>")[-1] == "two"
    assert read('<article><svg class=icon/>one<p>two</p></article>') == ["one", "two"]
    assert read('<p>one<svg><path d="m0"/><g/><text>no</text></svg> two</p>') == ["one two"]
    assert read("<p>one<object><p>fallback</p></object></p><p>two</p>") == ["one", "two"]


def test_without_article_or_main(spark):
    html = "<body><nav>menu</nav><div class=story><p>one</p><p>two</p></div><footer>site</footer></body>"
    pages = spark.createDataFrame([(1, "u", html)], "page_id long, url string, html string")
    model = op.train(pages)
    assert model is None and [r.text for r in op.extract(pages, model).collect()] == ["one\n\ntwo"]
