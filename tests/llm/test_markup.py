"""Visible text of pages against the pattern that defines it, and in linear time."""
import html
import random
import re
import time

import pytest

from freightline.llm import langid

PATTERN = re.compile(r"<(script|style)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>", re.S | re.I)


def test_visible_text_matches_the_pattern():
    rng = random.Random(1)
    parts = ["<script>", "</script >", "<SCRIPT x", "<style>", "</style>", "<scripts>", "<!--", "-->", "<!-->", "<p>", "<", ">", "a", " b ", "&amp;", "</script", "<a href='>'>"]
    for _ in range(20_000):
        page = "".join(rng.choices(parts, k=rng.randrange(12)))
        assert langid.visible(page) == html.unescape(PATTERN.sub(" ", page)), page


@pytest.mark.parametrize("page", ["<script>x " * 20_000, "<" * 200_000, "<!--" * 100_000, "<style>" * 50_000 + "</script>", "<html " * 50_000])
def test_broken_pages_take_linear_time(page):
    start = time.perf_counter()
    langid.visible(page)
    langid.DECLARED.search(page)
    assert time.perf_counter() - start < 2
