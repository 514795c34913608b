"""Pages that arrive in chunks: Structured Streaming keeps the chunks of unfinished pages and parses each page when it is whole."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from pagemill.functions.markup import to_text
from pagemill.sources.tree import parse

RESULT = "page_id bigint, n_elements int, title string, text string, complete boolean"
_STATE = "chunks array<string>, numbers array<int>, expected int"


def _row(page: int, html: str, complete: bool) -> pd.DataFrame:
    document = parse(html)
    title = document.first("title")
    return pd.DataFrame(
        [(page, sum(1 for _ in document.elements()), title.text() if title is not None else None, to_text(document), complete)],
        columns=["page_id", "n_elements", "title", "text", "complete"],
    )


def parse_chunks(chunks: DataFrame, timeout: str | None = "10 minutes") -> DataFrame:
    """Parse pages from a stream of (``page_id``, ``chunk_no`` from 0, ``last``, ``data``).

    Chunks may come in any order and more than once; a page is parsed when all up to its last one are there. With
    ``timeout``, a page that gets no further chunk for so long is parsed as far as it came, with ``complete`` false.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        have: dict[int, str] = {}
        expected = -1
        if state.exists:
            data, numbers, expected = state.get
            have = dict(zip(numbers, data, strict=True))
        if state.hasTimedOut:
            state.remove()
            yield _row(key[0], "".join(have[n] for n in sorted(have)), False)
            return
        for batch in batches:
            for number, last, data in zip(batch["chunk_no"], batch["last"], batch["data"], strict=True):
                have[int(number)] = data if data is not None else ""
                if last:
                    expected = int(number)
        if expected >= 0 and len(have) >= expected + 1:
            if state.exists:
                state.remove()
            yield _row(key[0], "".join(have[n] for n in range(expected + 1)), True)
        else:
            numbers = sorted(have)
            state.update(([have[n] for n in numbers], numbers, expected))
            if timeout:
                state.setTimeoutDuration(timeout)

    mode = GroupStateTimeout.ProcessingTimeTimeout if timeout else GroupStateTimeout.NoTimeout
    return chunks.groupBy("page_id").applyInPandasWithState(step, RESULT, _STATE, "append", mode)
