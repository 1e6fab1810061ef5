"""Byte-level BPE encoding and decoding by monoid tree reduction (operator 2).

A text is cut by the tokenizer's pattern; every match (a *piece*) is encoded for itself.  A piece
is encoded as a tree: its halves are encoded recursively and joined.  Joining re-encodes a window
around the seam and lets it grow until both its edges are *stable*: the token outside the window
and the token inside it, encoded together, come back as the same two tokens.

Why that is exact: byte pair merging always takes the pair of least rank, leftmost first.  Take a
token sequence in which each two neighbours are stable, and suppose merging the whole bytes ever
crossed a seam between two of them.  Until the first crossing, the merges inside those two tokens
run in the order in which they run for the two alone, because other merges do not touch them; so
the same crossing would happen for the two alone, against their stability.  Hence a sequence is
the encoding of its bytes if and only if all neighbours are stable.  Both halves already have that
property, the window is an encoding, and its edges are checked: the joined sequence has it too.
When a window reaches the end of a side there is no edge to check there.

Texts are cut into pieces, and pieces concatenate, so the same monoid carries on above the pieces;
decoding concatenates the tokens' bytes up a tree.  Memory is bounded by one Arrow batch of input
and slices of the output; the cache of pieces is emptied when it is full and changes no result.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandlog.llm.common import only, release

try:
    import tiktoken
except ImportError:  # slower, with the same results
    tiktoken = None

LEAF = 8  #: pieces up to so many bytes are merged directly
WIDE = 48  #: windows above so many bytes are merged with a heap
CACHE = 60_000  #: words, pieces, leaves and seams kept by a worker
SLICE = 400_000  #: quarter of the bytes per batch that decoding hands back to Spark
NEVER = 1 << 60  #: rank of a pair that is no token
PART = 2 << 20  #: bytes of text encoded together
#: A space at either end, or before white space (the pattern's \\s).
ODD_SPACES = r"^ | \z| [\t-\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
FOLD = 4096  #: tokens per leaf of the decoding tree


def words_head(texts: pa.Array, i: int) -> str:
    """What a text has before its first space."""
    return texts[i].as_py().partition(" ")[0]


class Known(dict):
    """Results of a function by its argument; emptied when full, which changes no result."""

    def __init__(self, make):
        super().__init__()
        self.make = make

    def __missing__(self, text):
        value = self.make(text)
        if not isinstance(text, (str, bytes)) or len(text) <= 48:
            if len(self) >= CACHE:
                self.clear()
            self[text] = value
        return value


class Tokenizer:
    """Ranks of a byte-level BPE and the pattern that cuts texts into pieces."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as f:
            rows = [line.split() for line in f if line.strip()]
        self.ranks = {base64.b64decode(a): int(b) for a, b in rows}
        self.vocab = [b""] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            self.vocab[rank] = token
        self.lengths = np.array([len(t) for t in self.vocab], dtype=np.int64)
        self.cut = regex.compile(pattern).findall
        self._core = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=self.ranks, special_tokens={})._core_bpe if tiktoken else None
        self._reached = Known(self.reaches)
        self._leaves = Known(self.leaf)
        self._pairs = Known(self.pair)
        self._pieces = Known(self.piece)
        self._words = Known(self.word)

    # -- merging ---------------------------------------------------------------------------------
    def merge(self, data: bytes) -> list[int]:
        """Plain byte pair merging of all bytes, for leaves and windows.

        Short inputs go to tiktoken's compiled merge where that is installed.  It answers a whole
        token at once, even one that merging would never reach, so such answers count only if
        merging does reach them.
        """
        if len(data) > WIDE:
            return self._merge_wide(data)
        if self._core is None:
            return self._merge_small(data)
        ids = self._core.encode_single_piece(data)
        return ids if len(ids) > 1 or self._reached[ids[0]] else self._merge_small(data)

    def reaches(self, token: int) -> bool:
        return self._merge_small(self.vocab[token]) == [token]

    def _merge_small(self, data: bytes) -> list[int]:
        get, parts = self.ranks.get, [data[i : i + 1] for i in range(len(data))]
        ranks = [get(data[i : i + 2], NEVER) for i in range(len(data) - 1)]
        while ranks:
            least = min(ranks)
            if least == NEVER:
                break
            i = ranks.index(least)
            parts[i] = self.vocab[least]
            del parts[i + 1], ranks[i]
            if i < len(ranks):
                ranks[i] = get(parts[i] + parts[i + 1], NEVER)
            if i:
                ranks[i - 1] = get(parts[i - 1] + parts[i], NEVER)
        return [self.ranks[p] for p in parts]

    def _merge_wide(self, data: bytes) -> list[int]:
        """The same with a heap over (rank, place): n log n for long windows."""
        n, get = len(data), self.ranks.get
        after, before, end = list(range(1, n + 1)), list(range(-1, n - 1)), [i + 1 for i in range(n)]
        alive = [True] * n
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := get(data[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, stop = heapq.heappop(heap)
            if not alive[i] or (j := after[i]) >= n or end[j] != stop:
                continue
            alive[j], end[i], after[i] = False, end[j], after[j]
            if after[i] < n:
                before[after[i]] = i
                if (r := get(data[i : end[after[i]]])) is not None:
                    heapq.heappush(heap, (r, i, end[after[i]]))
            if (h := before[i]) >= 0 and (r := get(data[h : end[i]])) is not None:
                heapq.heappush(heap, (r, h, end[i]))
        return [self.ranks[data[i : end[i]]] for i in range(n) if alive[i]]

    # -- the monoid ------------------------------------------------------------------------------
    def pair(self, seam: tuple[int, int]) -> tuple[int, ...]:
        """The encoding of the bytes of two tokens; the tokens are stable if it is they."""
        return tuple(self.merge(self.vocab[seam[0]] + self.vocab[seam[1]]))

    def join(self, left: tuple[int, ...], right: tuple[int, ...]) -> tuple[int, ...]:
        """The encoding of the bytes of two encodings, one after the other."""
        if not left or not right:
            return left + right
        seam, pairs = (left[-1], right[0]), self._pairs
        window = pairs[seam]
        if window == seam:
            return left + right
        a = b = 1
        while True:
            on_left = a == len(left) or pairs[edge := (left[-a - 1], window[0])] == edge
            on_right = b == len(right) or pairs[edge := (window[-1], right[b])] == edge
            if on_left and on_right:
                return left[: len(left) - a] + window + right[b:]
            a, b = a if on_left else min(2 * a, len(left)), b if on_right else min(2 * b, len(right))
            window = tuple(self.merge(b"".join([self.vocab[t] for t in left[len(left) - a :] + right[:b]])))

    def tree(self, data: bytes) -> tuple[int, ...]:
        if len(data) <= LEAF:
            return self._leaves[data]
        half = len(data) // 2
        return self.join(self.tree(data[:half]), self.tree(data[half:]))

    def leaf(self, data: bytes) -> tuple[int, ...]:
        return tuple(self.merge(data))

    def piece(self, text: str) -> tuple[int, ...]:
        data = text.encode()
        whole = self.ranks.get(data)  # a piece that is a token is that token
        return (whole,) if whole is not None else self.tree(data)

    def word(self, text: str) -> tuple[int, ...]:
        """The ids of a word with a space before it."""
        if text.isalpha():  # letters and the space before them are one piece
            return self._pieces[" " + text]
        return tuple(self.cut_and_encode(" " + text))

    def encode(self, text: str | None) -> list[int]:
        """The ids of all pieces of a text; a null text has none."""
        return self.cut_and_encode(text) if text else []

    def encode_all(self, texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Token counts and ids of consecutive texts, some thousands of texts at a time.

        Between two characters that are not white space, a single space starts a piece, and no
        piece reaches over its front, whatever follows.  So a text is looked up by its words, each
        with the space before it, and each distinct word is encoded once.  Texts with any other use
        of spaces are cut as a whole.
        """
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))
        first = 0
        while first < len(texts):
            done = ends[first - 1] if first else 0
            last = max(first + 1, int(np.searchsorted(ends, done + PART, side="right")))
            yield self._encode_part(texts.slice(first, last - first))
            first = last

    def _encode_part(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        odd = pc.match_substring_regex(texts, ODD_SPACES).to_numpy(zero_copy_only=False)
        split = pc.split_pattern(texts, " ")
        starts = split.offsets.to_numpy() - split.offsets[0].as_py()
        coded = split.flatten().dictionary_encode()
        index = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        words, known = coded.dictionary.to_pylist(), self._words
        used = np.zeros(len(words), dtype=bool)
        plain = np.repeat(~odd, np.diff(starts))
        plain[starts[:-1][~odd]] = False  # the first word has no space before it
        used[index[plain]] = True
        rows = [known[w] if u else () for w, u in zip(words, used.tolist())]
        # First words of regular texts, and odd texts as a whole, are entries of their own.
        heads = starts[:-1]
        index[~plain] = len(rows)
        rows.append(())
        for i in range(len(texts)):
            index[heads[i]] = len(rows)
            rows.append(self.cut_and_encode(texts[i].as_py() if odd[i] else words_head(texts, i)))
        sizes = np.fromiter(map(len, rows), dtype=np.int64, count=len(rows))
        flat = np.fromiter(chain.from_iterable(rows), dtype=np.int32, count=int(sizes.sum()))
        begins = np.cumsum(sizes) - sizes
        taken = sizes[index]
        stops = np.cumsum(taken)
        counts = np.diff(np.concatenate([[0], stops])[starts])
        at = np.repeat((begins[index] - (stops - taken)), taken) + np.arange(int(stops[-1]) if len(stops) else 0)
        return counts, flat[at]

    def cut_and_encode(self, text: str) -> list[int]:
        known = self._pieces
        return list(chain.from_iterable([known[p] for p in self.cut(text)]))

    def decode(self, ids: list[int]) -> bytes:
        """Concatenates the tokens' bytes up a binary tree with leaves of FOLD tokens."""
        if len(ids) <= FOLD:
            return b"".join(map(self.vocab.__getitem__, ids))
        half = len(ids) // 2
        return self.decode(ids[:half]) + self.decode(ids[half:])


def tokenizer(path: str, pattern: str) -> Tokenizer:
    """The tokenizer of a vocabulary file, loaded once by each worker process."""
    return only((path, pattern), lambda: Tokenizer(path, pattern))


def _kept(df: DataFrame, drop: set[str]) -> list[T.StructField]:
    return [f for f in df.schema.fields if f.name not in drop]


def _encoded(tok: Tokenizer, batch: pa.RecordBatch, names: list[str], text_col: str, out_col: str) -> Iterator[pa.RecordBatch]:
    """Slices of a batch: its columns ``names`` and the ids of its texts."""
    first = 0
    for counts, ids in tok.encode_all(batch.column(batch.schema.get_field_index(text_col))):
        part = batch.slice(first, len(counts))
        first += len(counts)
        offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
        rows = pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids, type=pa.int32()))
        yield pa.RecordBatch.from_arrays([part.column(part.schema.get_field_index(n)) for n in names] + [rows], names + [out_col])


def _decoded(tok: Tokenizer, batch: pa.RecordBatch, names: list[str], ids_col: str, out_col: str) -> Iterator[pa.RecordBatch]:
    """Slices of a batch: its columns ``names`` and the bytes of its ids."""
    ids, first, done, size = batch.column(batch.schema.get_field_index(ids_col)), 0, [], 0
    for i in range(batch.num_rows):
        done.append(tok.decode(ids[i].values.to_numpy(zero_copy_only=False).tolist() if ids[i].is_valid else []))
        size += len(done[-1])
        if size >= 4 * SLICE or i + 1 == batch.num_rows:
            part = batch.slice(first, len(done))
            yield pa.RecordBatch.from_arrays([part.column(part.schema.get_field_index(n)) for n in names] + [pa.array(done, type=pa.binary())], names + [out_col])
            first, done, size = i + 1, [], 0


def encode(df: DataFrame, path: str, pattern: str, text_col: str = "text", out_col: str = "ids", keep_text: bool = True) -> DataFrame:
    """Adds ``out_col``, the token ids of the whole text, as an array of int.

    A null text counts as empty and gives an empty array; repeated rows are encoded alike; an
    empty table gives an empty table.  A column already named ``out_col`` is replaced; other
    columns pass through (``text_col`` too unless ``keep_text`` is false).  ``path`` must exist
    on every executor.
    """
    keep = _kept(df, {out_col} | (set() if keep_text else {text_col}))
    names = [f.name for f in keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = tokenizer(path, pattern)
        for batch in batches:
            yield from _encoded(tok, batch, names, text_col, out_col)
        release()

    schema = T.StructType(keep + [T.StructField(out_col, T.ArrayType(T.IntegerType(), False))])
    needed = list(dict.fromkeys(names + [text_col]))
    return df.select(*needed).mapInArrow(run, schema)


def decode(df: DataFrame, path: str, pattern: str, ids_col: str = "ids", out_col: str = "decoded", keep_ids: bool = True) -> DataFrame:
    """Adds ``out_col``, the bytes of the token ids (binary; an empty or null array gives b"")."""
    keep = _kept(df, {out_col} | (set() if keep_ids else {ids_col}))
    names = [f.name for f in keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = tokenizer(path, pattern)
        for batch in batches:
            yield from _decoded(tok, batch, names, ids_col, out_col)
        release()

    schema = T.StructType(keep + [T.StructField(out_col, T.BinaryType())])
    return df.select(*list(dict.fromkeys(names + [ids_col]))).mapInArrow(run, schema)


def round_trip(df: DataFrame, path: str, pattern: str, text_col: str = "text", ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """``encode`` without the text, then ``decode``, by one worker: half the processes of the two in a row."""
    keep = _kept(df, {ids_col, out_col, text_col})
    names = [f.name for f in keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = tokenizer(path, pattern)
        for batch in batches:
            for ids in _encoded(tok, batch, names, text_col, ids_col):
                yield from _decoded(tok, ids, names + [ids_col], ids_col, out_col)
        release()

    schema = T.StructType(keep + [T.StructField(ids_col, T.ArrayType(T.IntegerType(), False)), T.StructField(out_col, T.BinaryType())])
    return df.select(*dict.fromkeys(names + [text_col])).mapInArrow(run, schema)


def round_trip_digests(df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, number of tokens, SHA-256 of the decimal ids joined by commas and of the decoded bytes."""
    return round_trip(df.select(id_col, text_col), path, pattern, text_col).select(
        F.col(id_col),
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
    )
