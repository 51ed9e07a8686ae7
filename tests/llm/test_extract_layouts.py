"""Main text of page layouts, written out by hand, and of hostile pages."""
import time

import pytest

from freightline.llm.extract import main_text

PARAGRAPHS = ["First para, with commas, and words that go on for quite a while to be an article.",
              "Second para, which also says a lot, about this and that, in many words, so it counts.",
              "Third para, the last of them, ends the text of this page, as was to be expected."]
BODY = "".join(f"<p>{p}</p>" for p in PARAGRAPHS)
TEXT = " ".join(PARAGRAPHS)
NOISE = ('<nav><ul><li><a href="/">Home</a></li><li><a href="/x">Other pages of the site</a></li></ul></nav>',
         '<div class="sidebar"><p>Buy this, now, or never, at a good price, in all shops of the land.</p></div>'
         '<div id="comments"><p>I, for one, agree, with all of this, and more, as I always do.</p></div>'
         '<footer>All rights reserved, by us, since long ago.</footer>')
WRAPPERS = ["site has-sidebar", "no-sidebar", "content-with-header", "post-tags", "entry-content share", "comments-open",
            "has-banner", "footer-fixed", "post tag-news category-social", "menu-open page", "header-sticky"]


@pytest.mark.parametrize("name", WRAPPERS)
def test_class_of_a_wrapper_is_only_evidence(name):
    assert main_text(f'<html><body><div class="{name}">{BODY}</div></body></html>') == TEXT
    assert main_text(f'<html><body>{NOISE[0]}<div class="{name}"><article>{BODY}</article>{NOISE[1]}</div></body></html>') == TEXT
    assert main_text(f'<body class="{name}">{NOISE[0]}<div>{BODY}</div>{NOISE[1]}</body>') == TEXT


def test_form_around_the_page():
    assert main_text(f'<form id="aspnetForm" action="x"><div>{NOISE[0]}<div id="content">{BODY}</div>{NOISE[1]}</div></form>') == TEXT
    assert main_text(f'<div>{BODY}</div><form><p>Your name, please, and your address, and the rest.</p><input></form>') == TEXT


def test_named_parts_still_go():
    many = "".join(f"<p>Remark {i}, as long as any other, with commas, and words.</p>" for i in range(40))
    for part in (f'<section class="article-comments">{many}</section>', f'<div id="disqus_thread">{many}</div>',
                 '<div class="cookie-notice"><p>We, and others, use cookies, as all do.</p></div>',
                 '<div class="main-sidebar"><p>Buy this, now, or never, in all shops.</p></div>',
                 '<div role="search"><p>Search here, there, and everywhere.</p></div>',
                 '<aside><p>An aside, with commas, that is none of it.</p></aside>'):
        assert main_text(f"<html><body><div class='content'>{BODY}</div>{part}</body></html>") == TEXT


def test_tags_with_odd_quotes():
    assert main_text('<div title="a > b"><p>one, two</p></div>') == "one, two"
    assert main_text("<p title='x>one, two</p>") == "one, two"
    assert main_text('<p>5 < 6 and 7 > 3</p>') == "5 < 6 and 7 > 3"
    assert main_text("<p>text</p><a href='cut") == "text"


@pytest.mark.parametrize("page", [
    "<a " * 200_000, '<a "' * 100_000, '<a ">" ' * 50_000, "<a '>" * 50_000, "<" * 300_000, "</b" * 100_000, "<!--" * 100_000,
    "<blockquote>x, " * 20_000, "<div>" * 20_000 + "</x>" * 20_000, "<article>" * 20_000 + "y", "<ul><li>" * 10_000 + "z",
    "<b>" * 20_000 + "<p>a" * 20_000, "&amp" * 100_000, "<p>" + "w " * 300_000], ids=lambda p: p[:12])
def test_time_is_linear(page):
    start = time.perf_counter()
    main_text(page)
    assert time.perf_counter() - start < 3
