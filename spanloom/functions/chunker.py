"""Cutting a text into chunks of lines; stateful along a text, so an Arrow function over batches."""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame

HEADING = re.compile(r"#{1,6}\s+\S")
SCHEMA = "seq int, start_line int, end_line int, chunk string"


def spans(weights: list[int], headings: list[int], blanks: list[int], most: int, overlap: int):
    """(first, past the last) line of each chunk, by places alone.

    ``weights``: characters of each line with its end; ``headings`` and ``blanks``: ascending
    places of such lines. A chunk ends before the next heading, or with the line at which its
    weight reaches ``most``, whichever comes first. In the second case it ends after its last
    blank line instead, if that has ``overlap`` lines before it; without one the next chunk
    begins ``overlap`` lines earlier.
    """
    before = list(accumulate(weights, initial=0))
    first, new, n = 0, 0, len(weights)  # the lines before ``new`` are known not to end the chunk
    while first < n:
        full = bisect_left(before, before[first] + most, max(new, first) + 1) - 1
        k = bisect_left(headings, max(new, first + 1))
        heading = headings[k] if k < len(headings) else n
        if heading <= full or full >= n:
            yield first, heading
            first = new = heading
            continue
        k = bisect_right(blanks, full) - 1
        new = full + 1
        if k >= 0 and blanks[k] >= first + overlap:
            yield first, blanks[k] + 1
            first = blanks[k] + 1
        else:
            yield first, new
            first = max(first, new - overlap)


def chunks(text: str, most: int = 1600, overlap: int = 3):
    """(first line, last line, text) of each chunk that is not blank; lines count from 1. A line longer than ``most`` comes twice."""
    lines = text.splitlines()
    headings = [k for k, line in enumerate(lines) if HEADING.match(line)]
    blanks = [k for k, line in enumerate(lines) if not line.strip()]
    for first, stop in spans([len(line) + 1 for line in lines], headings, blanks, most, overlap):
        body = "\n".join(lines[first:stop]).strip()
        if body:
            yield first + 1, stop, body


def chunk_rows(docs: DataFrame, key: str, text: str = "text", most: int = 1600) -> DataFrame:
    """The key with seq, start_line, end_line and chunk; null texts have none."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches):
        for batch in batches:
            rows = [(k, seq, *c) for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for seq, c in enumerate(chunks(t or "", most))]
            columns = list(zip(*rows)) or [()] * 5
            kinds = (batch.schema.field(0).type, pa.int32(), pa.int32(), pa.int32(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], [key, "seq", "start_line", "end_line", "chunk"])

    return docs.select(key, text).mapInArrow(run, f"{key} {kind}, {SCHEMA}")
