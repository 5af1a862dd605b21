import pytest

from rowgrove.llm import html_extract
from rowgrove.llm.html_blocks import blocks_of


@pytest.mark.parametrize(
    "page, blocks",
    [
        ("<p>one</p><svg viewBox='0 0 1 1'/><p>two</p>", ["one", "two"]),
        ("<p>one</p><svg/><p>two</p><svg><text>x</text></svg><p>three</p>", ["one", "two", "three"]),
        ("<p>one</p><svg><p>two</p><svg><text>x</text></svg><p>three</p>", ["one", "two", "three"]),
        ("<p>one</p><svg><svg><text>x</text></svg><text>y</text></svg><p>two</p>", ["one", "two"]),
        ("<p>a <math/>b</p><p>two</p>", ["a b", "two"]),
        ("<p>so <math><mi>x</mi><mo>=</mo><mn>1</mn></math> holds</p>", ["so x=1 holds"]),
        ("<object data='f'><p>no file</p></object><p>two</p>", ["no file", "two"]),
        ("<canvas>a chart</canvas><p>two</p>", ["a chart", "two"]),
        *[(f"<p>one</p><{x}><p>two</p>", ["one", "two"]) for x in ("noscript", "select", "textarea", "iframe", "template", "title", "object", "canvas", "svg", "math")],
        *[(f"<p>one</p><{x}>gone</{x}><p>two</p>", ["one", "two"]) for x in ("noscript", "select", "textarea", "iframe", "template", "title", "svg", "script", "style")],
        ("<p>one</p><script>var a = '<p>x</p>'", ["one"]),
    ],
)
def test_raw_elements(page, blocks):
    assert [b.text for b in blocks_of(page)] == blocks


def test_an_icon_does_not_cut_the_article():
    page = "<body><nav><a href='/'>Home</a></nav><article><h1>Title</h1><p>First paragraph of the text, which is long enough to be read.</p>{}<p>Second paragraph of the text, also long enough.</p></article></body>"
    assert html_extract.main_texts([page.format("<svg class='icon'/>")]) == html_extract.main_texts([page.format("")])
