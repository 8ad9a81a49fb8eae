"""The forward reader of pages: equal to one pattern over the whole page, and linear on broken markup."""

import random
import re
import time

import pytest

from wardline.llm.dom import Page, tokens

PATTERN = re.compile(r"<!--(?:.*?-->|.*\Z)|<!\[CDATA\[.*?\]\]>|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
BITS = ["<", ">", '"', "'", "a", "b ", "/", "!", "--", "-->", "<!--", "<![CDATA[", "]]>", "<a ", "</a>", "=", "?", " "]


def test_reader_equals_the_pattern():
    r = random.Random(5)
    for _ in range(20_000):
        page = "".join(r.choice(BITS) for _ in range(r.randint(0, 14)))
        want = [(m.start(), m.end(), m.group(2)) for m in PATTERN.finditer(page)]
        assert [(a, b, m.group(2) if m else None) for a, b, _, m in tokens(page)] == want, page


def test_cdata_is_text():
    assert [text for _, _, text, _ in tokens("<p><![CDATA[a<b]]></p>")] == [None, "a<b", None]


@pytest.mark.parametrize("page", ['<a href="x <b ' * 70_000, "<svg>" * 60_000, "<a b='" * 150_000, "<![CDATA[" * 100_000,
                                  "<x" * 300_000 + '"', "<" * 500_000 + ">", "<a " * 200_000 + '">'])
def test_a_megabyte_of_broken_markup_is_read_in_seconds(page):
    start = time.monotonic()
    Page(page)
    assert time.monotonic() - start < 20
