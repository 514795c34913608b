"""Pages in pieces give what whole pages give."""

from __future__ import annotations

import random

import pytest

from pagemill.functions.markup import serialize
from pagemill.sources.push import PushParser, StreamingTokenizer
from pagemill.sources.tokens import Tokenizer
from pagemill.sources.tree import parse

PAGES = [
    "<!doctype html><html lang=en><head><title>a &amp; b</title><script>if (a < b) '</p>';</script></head><body><p class='x y'>one<br>two &copy; <b>three<p>four</b></p><!-- c --><table><tr><td>1<td>2</table><svg><circle/></svg><textarea><b></textarea></body></html>",
    "plain text only", "", "<p", "<p>x</", "<!-- open", "<script>never closed", "a\r\nb\rc<pre>\n\nx</pre>", "<title>t</ti</title>&am", "﻿<p>mark",
]


@pytest.mark.parametrize("page", PAGES)
def test_trees(page):
    rng = random.Random(len(page))
    wanted = serialize(parse(page))
    for size in (1, 2, 3, 7, 50, 1000):
        parser, at = PushParser(), 0
        while at < len(page):
            step = rng.randrange(1, size + 1)
            parser.feed(page[at : at + step])
            at += step
        assert serialize(parser.close()) == wanted, size


def test_trees_grow():
    with PushParser() as parser:
        parser.feed("<ul><li>1<li>2<li")
        assert [n.tag for n in parser.document.elements()][-2:] == ["li", "li"]
        parser.feed(">3</ul><p>x")
        assert parser.document.first("ul").text() == "123" and parser.document.first("p") is not None
    assert parser.document.first("p").text() == "x"


@pytest.mark.parametrize("page", PAGES[:1] + PAGES[7:8])
def test_tokens(page):
    def whole():
        tokens = Tokenizer(page)
        for t in tokens:
            if t.kind == "start" and t.data in ("script", "title", "textarea"):
                tokens.raw = t.data
            yield t

    def joined(tokens):
        out = []
        for t in tokens:
            if t.kind == "text" and out and out[-1][0] == "text":
                out[-1] = ("text", out[-1][1] + t.data)
            else:
                out.append((t.kind, t.data))
        return out

    seen = []
    stream = StreamingTokenizer(seen.append)
    got = [t for i in range(0, len(page), 5) for t in stream.feed(page[i : i + 5])] + stream.close()
    assert joined(got) == joined(whole()) and len(seen) == len(got) and stream.close() == []
    with pytest.raises(ValueError, match="closed"):
        stream.feed("x")
    stream.reset()
    assert [t.data for t in stream.feed("<b>x<i")] == ["b", "x"] and [t.data for t in stream.close()] == []
