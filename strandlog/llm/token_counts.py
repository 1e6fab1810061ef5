"""Token counts by offset-mapped attribution (operator 3).

Whole documents are encoded once.  The bytes of consecutive tokens tile the text, so running sums
of token lengths give every token's byte span, and a count of the bytes that start a character
gives its character span.  Token spans are then joined with the sections' character spans by
binary search over sorted section starts, and every token that crosses a boundary goes to exactly
one section by the rule named:

``first``     the section that holds the token's first character (default);
``majority``  the section that holds most of the token's characters, the earlier one on a tie.

Tokens that lie in no section are counted in a row with ``section`` -1, so the counts of a
document always add up to its number of tokens.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from strandlog.llm.bpe import tokenizer
from strandlog.llm.common import parts as split

Span = tuple[int, int]
ROWS = 50_000  #: rows per batch handed back to Spark


def lines(text: str) -> list[Span]:
    """Sections are lines, each with the line feed that ends it."""
    out, start = [], 0
    while (at := text.find("\n", start)) >= 0:
        out.append((start, at + 1))
        start = at + 1
    return out + [(start, len(text))] if start < len(text) else out


def spans_of(tok, ids: list[int], data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Character spans [start, end) of the tokens; a token that starts inside a character counts from that character."""
    ends = np.cumsum(tok.lengths[np.asarray(ids, dtype=np.int64)])
    starts = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
    char = np.cumsum((np.frombuffer(data, dtype=np.uint8) & 0xC0) != 0x80) - 1  # of each byte
    return char[starts], char[ends - 1] + 1


def disjoint(given: list[dict | None] | None) -> list[Span]:
    """Given sections as spans that do not overlap, each in its place of the list.

    A section that is null or has a null end, or that ends before it starts, is empty; where two overlap,
    the one that starts later (of equal starts, the later in the list) holds what both would.
    """
    spans = [(0, 0) if x is None or x["start"] is None or x["end"] is None else (max(0, x["start"]), max(0, x["start"], x["end"])) for x in given or []]
    order = [k for k in sorted(range(len(spans)), key=lambda k: (spans[k][0], k)) if spans[k][0] < spans[k][1]]
    for k, after in zip(order, order[1:]):
        spans[k] = spans[k][0], min(spans[k][1], spans[after][0])
    return spans


def attribute(starts: np.ndarray, ends: np.ndarray, sections: list[Span], rule: str) -> tuple[np.ndarray, np.ndarray]:
    """For each token the section it goes to (-1: none) and whether it crosses a boundary.

    ``sections`` do not overlap; their order is free.
    """
    place = np.array([k for k in sorted(range(len(sections)), key=lambda k: sections[k]) if sections[k][0] < sections[k][1]], dtype=np.int64)
    s = np.array([sections[k][0] for k in place], dtype=np.int64)
    e = np.array([sections[k][1] for k in place], dtype=np.int64)
    if not len(s):
        return np.full(len(starts), -1), np.zeros(len(starts), dtype=bool)

    def holder(at):
        k = np.searchsorted(s, at, side="right") - 1
        return np.where((k >= 0) & (at < e[np.maximum(k, 0)]), k, -1)

    first, last = holder(starts), holder(ends - 1)
    crosses = (first != last) | ((first < 0) & (np.searchsorted(s, ends, side="left") > np.searchsorted(s, starts, side="right")))
    to = first.copy()
    if rule == "majority":
        for i in np.flatnonzero(crosses):
            a, b = int(starts[i]), int(ends[i])
            near = range(max(0, int(np.searchsorted(s, a, side="right")) - 1), int(np.searchsorted(s, b, side="left")))
            held = [(min(b, int(e[k])) - max(a, int(s[k])), -k) for k in near]
            best = max(held, default=(0, 0))
            to[i] = -best[1] if best[0] > 0 else -1
    elif rule != "first":
        raise ValueError(f"unknown rule {rule!r}")
    return np.where(to >= 0, place[np.maximum(to, 0)], -1), crosses


def count_tokens(
    df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text",
    sections: Callable[[str], list[Span]] = lines, sections_col: str | None = None, rule: str = "first",
) -> DataFrame:
    """One row per document and section: id, section, start_char, end_char, n_tokens, n_crossing.

    Sections come from ``sections_col`` (array<struct<start,end>> over characters, made ``disjoint``;
    one row each, also for those without a token) or are computed by ``sections``.  ``n_crossing``:
    how many of the section's tokens cross its boundary.  A null or empty text without sections has one row,
    section -1 with 0 tokens; repeated rows and equal ids are counted row by row; other columns are
    ignored.  An id column named like an output is an error.
    """

    made = ["section", "start_char", "end_char", "n_tokens", "n_crossing"]
    if id_col in made:
        raise ValueError(f"{id_col!r} is the name of an output; rename the id column")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = tokenizer(path, pattern)
        names = [id_col, *made]
        for batch in split(batches):
            ids_in = batch.column(batch.schema.get_field_index(id_col))
            texts = batch.column(batch.schema.get_field_index(text_col))
            given = batch.column(batch.schema.get_field_index(sections_col)) if sections_col else None
            parts, rows, held = [], [], 0

            def out(parts=parts, rows=rows, ids_in=ids_in):
                cols = [np.concatenate(c) for c in zip(*parts)]
                return pa.RecordBatch.from_arrays([ids_in.take(pa.array(np.concatenate(rows)))] + [pa.array(c.astype(np.int64)) for c in cols], names)

            for i in range(batch.num_rows):
                text = texts[i].as_py() or ""
                data = text.encode()
                tokens = tok.encode(text)
                own = disjoint(given[i].as_py()) if given is not None else sections(text)
                starts, ends = spans_of(tok, tokens, data) if tokens else (np.zeros(0, np.int64),) * 2
                to, crosses = attribute(starts, ends, own, rule)
                n = np.bincount(to + 1, minlength=len(own) + 1)
                cut = np.bincount(to[crosses] + 1, minlength=len(own) + 1)
                k = np.arange(-1, len(own))
                a, b = np.array([(0, 0)] + own, dtype=np.int64).T
                some = (k >= 0) | (n > 0) if own else k < 0
                parts.append((k[some], a[some], b[some], n[some], cut[some]))
                rows.append(np.full(int(some.sum()), i))
                held += int(some.sum())
                if held >= ROWS:
                    yield out()
                    parts.clear(), rows.clear()
                    held = 0
            if rows:
                yield out()

    f = T.StructField
    schema = T.StructType([f(id_col, df.schema[id_col].dataType)] + [f(n, T.LongType()) for n in made])
    needed = [id_col, text_col] + ([sections_col] if sections_col else [])
    return df.select(*dict.fromkeys(needed)).mapInArrow(run, schema)
