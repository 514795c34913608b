"""Command line: ``python -m pagemill FORM [FILE]`` with FORM text, markdown, html, minified, sanitized, css, js, errors or
encoding; reads a file or the input. ``python -m pagemill nodes PAGES.parquet OUT`` writes the node table of pages (``page_id``, ``html``)."""

from __future__ import annotations

import sys

from pagemill.functions.markup import minify, serialize, to_markdown, to_text
from pagemill.functions.script import minify_js
from pagemill.functions.styles import minify_css
from pagemill.operators.cleaning import READABLE, sanitize_tree
from pagemill.sources.encodings import detect
from pagemill.sources.errors import errors_of
from pagemill.sources.tree import parse, parse_fragment

FORMS = {
    "text": lambda t: to_text(parse(t)),
    "markdown": lambda t: to_markdown(parse(t)),
    "html": lambda t: serialize(parse(t)),
    "minified": lambda t: minify(parse(t)),
    "sanitized": lambda t: serialize(sanitize_tree(parse_fragment(t), READABLE, []), inner=True),
    "css": minify_css,
    "js": minify_js,
    "errors": lambda t: "\n".join(f"{line}:{col} {code}" for code, _, line, col in errors_of(t)),
}


def main(arguments: list[str]) -> int:
    if len(arguments) == 3 and arguments[0] == "nodes":
        from pagemill.session import local_session
        from pagemill.sources.nodes import parse_nodes

        spark = local_session()
        parse_nodes(spark.read.parquet(arguments[1])).write.mode("overwrite").parquet(arguments[2])
        return 0
    if not arguments or arguments[0] not in (*FORMS, "encoding"):
        print(__doc__, file=sys.stderr)
        return 2
    if len(arguments) > 1:
        with open(arguments[1], "rb") as file:
            data = file.read()
    else:
        data = sys.stdin.buffer.read()
    encoding, confidence = detect(data)
    print(f"{encoding} {confidence}" if arguments[0] == "encoding" else FORMS[arguments[0]](data.decode(encoding, "replace")))
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
