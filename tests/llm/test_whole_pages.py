"""No element cuts an article short."""

import pytest

from calorine.llm import html_text

PAGE = "<html><body><article><h1>A title of some words</h1><p>{}</p>{}<p>{}</p></article></body></html>"
WORDS = " ".join(["word"] * 40)


def text(between, last="the last words of it " + WORDS):
    return html_text.main_text(PAGE.format(WORDS, between, last))


@pytest.mark.parametrize("name", ["button", "select", "object", "canvas", "svg", "audio", "video", "template", "datalist"])
def test_unclosed_elements_are_empty(name):
    assert "the last words of it" in text(f"<{name} class=x>")
    # Nor does a later element's end tag close it.
    assert "the last words of it" in html_text.main_text(PAGE.format(WORDS, f"<{name}>", "the last words of it " + WORDS).replace("</article>", f"<{name}>gone</{name}></article>"))
    assert "gone" not in text(f"<{name}>gone<{name}>gone</{name}>gone</{name}>")


@pytest.mark.parametrize("name", ["script", "style"])
def test_code_goes_on_to_the_end(name):
    assert "the last words of it" not in text(f"<{name}>")
    assert "the last words of it" in text(f"<{name}>gone</{name}>") and "gone" not in text(f"<{name}>gone</{name}>")


@pytest.mark.parametrize("name", ["textarea", "title", "iframe", "noscript"])
def test_other_raw_text_ends_at_the_next_tag_when_unclosed(name):
    assert "the last words of it" in text(f"<{name}>gone") and "gone" not in text(f"<{name}>gone")
    assert "the last words of it" in text(f"<{name}><p>gone</p></{name}>") and "gone" not in text(f"<{name}><p>gone</p></{name}>")


def test_formulas_and_inline_elements_are_kept():
    assert "x = 7 holds" in text("", f"<math><mi>x</mi> = <mn>7</mn></math> holds {WORDS}")
    assert "kept" in text("", f"<math>kept {WORDS}")
    assert "a part of it" in text("", f"{WORDS} <span hidden>a part</span> of it")
