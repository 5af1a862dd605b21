import html
import re

import numpy as np
import pytest

from rowgrove.llm import html_blocks, html_extract, html_lstm, html_train
from rowgrove.llm.html_blocks import Features, blocks_of

from . import other_pages


def test_blocks_keep_order_decode_and_fold_white_space():
    page = "<body><h1>A&amp;B</h1><p>one\n  <b>two</b><br>three<p>four&nbsp;five<ul><li>six<li>seven</ul>tail</body>"
    assert [b.text for b in blocks_of(page)] == ["A&B", "one two three", "four five", "six", "seven", "tail"]


@pytest.mark.parametrize("page", ["", "   ", "<", "<p", "<p class='x", "<!-- open", "<script>var a = '<p>x</p>';", "<style>p{}</style>", "<head><title>t</title></head>", "</p></div>"])
def test_pages_without_text(page):
    assert [b for b in blocks_of(page) if b.text not in ("<",)] == []


def test_paths_and_hidden_elements():
    blocks = blocks_of('<div class="site-Header"><a href="/">Home</a></div><article><p style="display:none">x</p></article>')
    node = blocks[0].node
    assert (node.tag, node.parent.tag, node.depth) == ("a", "div", 2) and blocks[0].link_chars == 4
    assert blocks[1].node.mask & html_blocks._bit("n hidden") and node.mask & html_blocks._bit("n header")


def test_gradients_agree_with_differences():
    rng = np.random.default_rng(0)
    w = html_lstm.fresh()
    lengths = [3, 1, 4]
    paths, words = [[1, 2], [3], [4, 5], [1], [2, 9], [7], [3], [8]], [[1030], [], [1040, 1050], [1060], [1030], [1031], [], [1032]]
    figures, y = rng.normal(size=(8, html_lstm.FIGURES)).astype(np.float32), np.array([1, 0, 1, 1, 0, 0, 1, 1], np.float32)
    _, grads = html_lstm.gradients(paths, words, figures, lengths, y, w)
    for name, at in (("f_rec", (2, 5)), ("b_in", (1, 30)), ("buckets", (1, 3)), ("figures", (4, 4)), ("out", (7, 0)), ("f_bias", (25,)), ("b_rec", (3, 61))):
        up, down = ({k: v.astype(np.float64) for k, v in w.items()} for _ in range(2))
        up[name][at] += 1e-3
        down[name][at] -= 1e-3
        slope = (html_lstm.gradients(paths, words, figures, lengths, y, up)[0] - html_lstm.gradients(paths, words, figures, lengths, y, down)[0]) / 2e-3
        assert slope == pytest.approx(float(grads[name][at]), abs=2e-4)


def test_held_out_accuracy_on_generated_pages():
    assert html_train.accuracy(html_lstm.load(), 150, seed=991) > 0.985


def test_pages_of_other_layouts():
    """Held out from another generator, pages with text directly in the body among them."""
    made = other_pages.pages(200, 3)
    right = kept = known = 0
    for got, (_, main) in zip(html_extract.main_texts([p for p, _ in made]), made, strict=True):
        found = got.split("\n")
        right, kept, known = right + len(set(found) & set(main)), kept + len(found), known + len(main)
    print("precision", right / kept, "recall", right / known)
    assert right / kept > 0.97 and right / known > 0.97


@pytest.mark.parametrize("page", ["<div>x" * 100_000, "<b '" * 50_000, "<div>" * 50_000 + "</section>" * 50_000, "".join(f"<div class=c{i}>x" for i in range(20_000)), "<li><blockquote>" * 20_000 + "x"])
def test_work_goes_with_the_length_of_a_page(page):
    import time

    began = time.process_time()
    Features().of(blocks_of(page))
    assert time.process_time() - began < 6


def test_training_lowers_the_loss():
    said = []
    html_train.train(pages=120, epochs=2, seed=3, say=said.append)
    first, last = (float(x.rsplit(" ", 1)[1]) for x in (said[0], said[-1]))
    assert last < first


def expected(page: str) -> str:
    article = re.search(r"<article>(.*?)(?:</article>|$)", page, re.S)[1]
    parts = (" ".join(html.unescape(re.sub(r"<[^>]+>", " ", x)).split()) for x in re.split(r"</?(?:p|h1)\b[^>]*>", article))
    return "\n".join(x for x in parts if x)


def test_pages_of_the_fixture(spark, sf_dir):
    got = {r.page_id: r for r in html_extract.op1_html_extract(spark, sf_dir).collect()}
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").collect()
    assert len(got) == len(pages)
    assert np.mean([got[p.page_id].text == expected(p.html) for p in pages]) > 0.98
    assert all(r.n_chars == len(r.text) for r in got.values())


def test_labels_are_the_same_in_any_batch():
    maker = html_train.Maker(5)
    pages = [maker.page().replace(maker.MARK, "") for _ in range(30)]
    together = html_extract.main_texts(pages, Features())
    assert together == [html_extract.main_texts([p], Features())[0] for p in pages]


def test_boilerplate_around_an_article():
    page = (
        "<html><head><title>t</title></head><body><header><h1>Site</h1></header><nav><ul><li><a href='/a'>Home</a></li></ul></nav><div class='cookie-notice'>We use cookies</div>"
        "<article><h1>Title</h1><p>First paragraph of the text, which is long enough to be read.</p><p>Second paragraph.</p></article>"
        "<aside class='sidebar'><h3>Related</h3><p>Other story</p></aside><section class='comments'><p>Great post, I agree with all of it.</p></section><form><label>Email</label></form><footer>&copy; Site</footer></body></html>"
    )
    assert html_extract.main_texts([page]) == ["Title\nFirst paragraph of the text, which is long enough to be read.\nSecond paragraph."]


def test_edge_rows(spark):
    long = "<article><p>" + "word " * 200_000 + "</p></article>"
    rows = [(1, None, None), (1, None, None), (2, "u", ""), (3, None, long), (4, "u", "<p>" * 50_000 + "x")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", html_extract.F.lit("clash"))
    got = sorted((r.page_id, r.n_chars) for r in html_extract.extract(df).collect())
    assert got[:3] == [(1, 0), (1, 0), (2, 0)] and got[3] == (3, 999_999) and got[4][0] == 4
    assert html_extract.extract(df.where("false")).count() == 0
