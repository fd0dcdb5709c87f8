"""Tags with long or odd attributes, and names of parts inside articles."""

import time

import pytest

from tilewright.llm.html import main_text


@pytest.mark.parametrize("n", [10, 6_000, 70_000, 300_000])
def test_attributes_of_any_length(n):
    assert main_text('<article><p>Text.</p><img src="data:image/svg+xml,<svg><text>LEAK</text>' + "x" * n + '"><p>End.</p></article>') == "Text. End."
    assert main_text("<article><p>A.</p><img alt=" + " " * n + "'y\">z'><p>B.</p></article>") == "A. B."
    assert main_text('<article><p>A.</p><p title="' + "b" * n + "'>" + '">C.</p></article>') == "A. C."


def test_quotes_that_never_close():
    assert main_text('<article><p title="x>Open quote.</p><p>Next.</p></article>') == "Open quote. Next."
    assert main_text("<article><p title='it>One.</p><p class=\"q\">Two.</p></article>") == "One. Two."


@pytest.mark.parametrize("bad", ['<p a="', "<p a='\"=>", 'a="><p " ', "<p a= ", "<p ='\"", "<p a=\"<p b='", '<a href="x" ', "=" + " " * 50])
def test_cost_is_in_proportion(bad):
    times = []
    for n in (20_000, 80_000):
        start = time.process_time()
        main_text("<p " + bad * n)
        times.append(time.process_time() - start)
    assert times[1] < 12 * times[0] + 0.3


def test_names_inside_an_article():
    words = "Some words of the text stand here, and a few more follow."
    page = f"<article><p>{words}</p>%s<p>{words}</p></article>"
    kept = ['<section id="related-work"><p>Related work is cited here in full.</p></section>', '<div class="social-history"><p>Related work is cited here in full.</p></div>', '<div class="notice-of-war"><p>Related work is cited here in full.</p></div>']
    gone = [
        '<div class="related-posts"><a href=x>Other</a> and more words of prose that stand here</div>', '<div class="ad-slot-2">Buy this fine thing now, today.</div>', '<div class="related-things"><a href=1>a b</a><a href=2>c</a></div>',
        '<div class="reader-comments"><p>I like this very much, said a reader at length.</p></div>', '<div id="comments"><p>I like this very much, said a reader at length.</p></div>', '<aside><p>Beside the point, and long enough to count.</p></aside>',
    ]
    for part in kept:
        assert main_text(page % part) == f"{words} Related work is cited here in full. {words}"
    for part in gone:
        assert main_text(page % part) == f"{words} {words}"
    outside = f'<div class="related-work"><p>{words}</p></div>'  # outside an article a listed word still decides
    assert main_text(outside + page % "") == f"{words} {words}"
