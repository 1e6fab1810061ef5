"""Language identification by prediction by partial matching (operator 6).

For every language a context tree over bytes (contexts of 3, 2, 1 and 0 bytes) holds frozen counts
from training texts.  A byte's probability is that of PPM with escape method C and exclusion: in
the longest context that the language's tree holds, a symbol counted c times of n, with d different
symbols, has c / (n + d), and d / (n + d) escapes to the next shorter context, in which the symbols
already tried are left out; after the empty context the remaining mass is spread over the bytes not
seen.  These are proper distributions, so the sum of -log2 is the exact code length of a text.  The
language with the shortest code wins.  A tree holds a context of three bytes if its own language's
training texts have it ``min_count`` times or more, shorter ones always.

Because the counts are frozen, the code length of a byte depends on the three bytes before it only.
Trees are sorted arrays of what was seen; a worker finds the length of a window of four bytes once in
each language and keeps it while there is room, so memory is bounded whatever the number of languages.

The model is fitted on at most ``per_lang`` documents of each language, chosen by a hash of the
id; more than ``max_langs`` languages are an error, none is left out.  Scoring covers every byte of every text.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandlog.llm.common import only, parts

BASE = 257  #: 256 bytes and the sign for "before the text"
PAD = 256
PIECE = 1 << 20  #: bytes scored at once
SLOTS = 1 << 21  #: places in which kept windows are looked up
ROOM = 64 << 20  #: bytes of lengths that a worker keeps
UND = "und"


@dataclass
class Model:
    """Counts of (context of three, byte) by language, as sorted numbers to the base 257."""

    langs: list[str]
    grams: list[np.ndarray]
    counts: list[np.ndarray]
    min_count: int = 3
    key: str = field(default_factory=lambda: uuid.uuid4().hex)


def held_out(id_col) -> object:
    """Whether an id belongs to the held-out fifth; a null id does."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5 == 0, F.lit(True))


def _windows(x: np.ndarray) -> np.ndarray:
    """The numbers of the windows of four in a sequence of bytes."""
    x = x.astype(np.int64)
    return ((x[:-3] * BASE + x[1:-2]) * BASE + x[2:-1]) * BASE + x[3:]


def _grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    joined = b"".join(t.encode() for t in texts)
    sizes = [len(t.encode()) for t in texts]
    at, x = 0, np.full(len(joined) + 3 * len(texts), PAD, dtype=np.int64)
    data, done = np.frombuffer(joined, dtype=np.uint8), 0
    for n in sizes:
        x[at + 3 : at + 3 + n] = data[done : done + n]
        at, done = at + 3 + n, done + n
    if len(x) < 4:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.unique(_windows(x)[x[3:] != PAD], return_counts=True)


def train(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_lang: int = 300, max_langs: int = 1000, min_count: int = 3) -> Model:
    """Counts from the rows that are not held out and have a text and a language."""
    own = df.select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    usable = own.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out("id"))
    langs = sorted(r[0] for r in usable.select("lang").distinct().limit(max_langs + 1).collect())
    if len(langs) > max_langs:
        raise ValueError(f"more than max_langs = {max_langs} languages: documents of those left out would all be given a wrong one")
    if not langs:
        return Model([], [], [], min_count)
    order = Window.partitionBy("lang").orderBy(F.xxhash64("id"), "id")
    # At most per_lang * max_langs ids: small enough to broadcast at any size of the input.
    chosen = usable.select("id", "lang").withColumn("r", F.row_number().over(order)).filter(F.col("r") <= per_lang).select("id").distinct()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            by: dict[str, list[str]] = {}
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                by.setdefault(lang, []).append(text)
            for lang, texts in by.items():
                g, n = _grams(texts)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(g), pa.string()), pa.array(g), pa.array(n.astype(np.int64))], ["lang", "gram", "n"])

    seen = usable.join(F.broadcast(chosen), "id").select("lang", "text").mapInArrow(count, "lang string, gram long, n long")
    rows = seen.groupBy("lang", "gram").agg(F.sum("n").alias("n")).toPandas()
    grams, counts = [], []
    for lang in langs:
        own_rows = rows[rows["lang"] == lang].sort_values("gram")
        grams.append(own_rows["gram"].to_numpy(np.int64))
        counts.append(own_rows["n"].to_numpy(np.int64))
    return Model(langs, grams, counts, min_count)


def _find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place of each wanted number among sorted keys, and whether it is there."""
    if not len(keys):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return at, keys[at] == wanted


class Tree:
    """The context tree of one language: per number of context bytes the windows seen and the contexts."""

    def __init__(self, grams: np.ndarray, counts: np.ndarray, min_count: int):
        windows, n, contexts, total, different, starts = ([None] * 4 for _ in range(6))
        for k in (3, 2, 1, 0):
            code, back = np.unique(grams % BASE ** (k + 1), return_inverse=True)
            c = np.bincount(back, weights=counts, minlength=len(code))
            if k == 3 and len(code):
                context, back = np.unique(code // BASE, return_inverse=True)
                code, c = (x[np.bincount(back, weights=c)[back] >= min_count] for x in (code, c))
            windows[k], n[k] = code, c
            contexts[k], starts[k] = np.unique(code // BASE, return_index=True)
            total[k] = np.add.reduceat(c, starts[k]) if len(code) else np.zeros(0)
            different[k] = np.diff(np.append(starts[k], len(code)))
        self.windows, self.n, self.contexts = windows, n, contexts
        # ``after[k]``: factors for the shorter contexts, and for a byte never seen, once a context of k bytes has escaped.
        seen = different[0][0] if len(different[0]) else 0
        after = [np.zeros((max(1, len(contexts[0])), 5))]
        after[0][:, 4] = 1 / (256 - seen) if seen < 256 else 0
        for k in (1, 2, 3):
            shorter = np.searchsorted(contexts[k - 1], contexts[k] % BASE ** (k - 1))
            own = n[k - 1][np.searchsorted(windows[k - 1], windows[k] % BASE**k)] if len(windows[k]) else np.zeros(0)
            left = total[k - 1][shorter] - (np.add.reduceat(own, starts[k]) if len(own) else own)  # counts of bytes not tried yet
            fresh = different[k - 1][shorter] - different[k]
            some = left > 0
            below = np.where(some, left + fresh, 1)
            factors = np.where(some, fresh / below, 1)[:, None] * after[k - 1][shorter]
            factors[:, k - 1] = np.where(some, 1 / below, 0)
            after.append(factors)
        self.factors = []  # by the number of bytes of the longest context
        for k in range(4):
            all_of = total[k] + different[k] if len(contexts[k]) else np.ones(1)
            escape = different[k] / all_of if len(contexts[k]) else np.ones(1)  # nothing learned: every byte is new
            factors = escape[:, None] * after[k][: len(all_of)]
            factors[:, k] = 1 / all_of
            self.factors.append(factors)

    def lengths(self, codes: np.ndarray) -> np.ndarray:
        """Code length in bits of the last byte of each window of four."""
        out = np.zeros((len(codes), 5))
        level, open_ = np.zeros(len(codes), np.int64), np.ones(len(codes), bool)
        for k in (3, 2, 1, 0):
            at, there = _find(self.contexts[k], codes // BASE % BASE**k)
            if k == 0:
                at, there = np.zeros(len(codes), np.int64), np.ones(len(codes), bool)
            now = open_ & there
            out[now], level[now] = self.factors[k][at[now]], k
            open_ &= ~there
        p = out[:, 4]
        for k in range(4):  # the longest context in which the byte was seen counts
            at, there = _find(self.windows[k], codes % BASE ** (k + 1))
            there &= level >= k
            p = np.where(there, out[:, k] * (self.n[k][at] if len(self.n[k]) else 0), p)
        return -np.log2(np.maximum(p, 1e-300))


class Scorer:
    """The trees of a model, and the code lengths of the windows met so far."""

    def __init__(self, model: Model):
        self.trees = [Tree(g, n, model.min_count) for g, n in zip(model.grams, model.counts)]
        self.slot = np.zeros(SLOTS, np.int32)
        self.codes, self.kept = np.full(1, -1, np.int64), np.zeros((len(self.trees), 1))

    def _lengths(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places, table): the column of the table that holds the lengths of each window."""
        hashed = ((codes.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)).astype(np.int64) % SLOTS
        at = self.slot[hashed].astype(np.int64)
        lacking = np.flatnonzero(self.codes[at] != codes)
        if not len(lacking):
            return at, self.kept
        new, first, back = np.unique(codes[lacking], return_index=True, return_inverse=True)
        own = np.stack([t.lengths(new) for t in self.trees])
        at[lacking] = self.kept.shape[1] + back
        table = np.concatenate([self.kept, own], axis=1)
        free = self.slot[hashed[lacking[first]]] == 0
        if (len(self.codes) + free.sum()) * 8 * len(self.trees) <= ROOM:
            self.slot[hashed[lacking[first[free]]]] = len(self.codes) + np.arange(free.sum())
            self.codes, self.kept = np.append(self.codes, new[free]), np.concatenate([self.kept, own[:, free]], axis=1)
        return at, table

    def bits(self, texts: list[bytes]) -> np.ndarray:
        """Code length of each text in each language, in bits."""
        out = np.zeros((len(texts), len(self.trees)))
        first = 0
        while first < len(texts):
            last, size = first, 0
            while last < len(texts) and (last == first or size + len(texts[last]) <= PIECE):
                size += len(texts[last])
                last += 1
            self._score(texts, first, last, out)
            first = last
        return out

    def _score(self, texts, first, last, out):
        if last - first == 1:
            text = texts[first]
            for at in range(0, len(text), PIECE):  # a long text in pieces, each after its last three bytes
                before = text[max(0, at - 3) : at]
                x = np.concatenate([np.full(3 - len(before), PAD), np.frombuffer(before + text[at : at + PIECE], dtype=np.uint8)])
                places, table = self._lengths(_windows(x))
                out[first] += [lengths[places].sum() for lengths in table]
            return
        sizes = np.array([len(t) for t in texts[first:last]])
        x = np.frombuffer(b"".join(b"\0\0\0" + t for t in texts[first:last]), dtype=np.uint8).astype(np.int64)
        heads = np.cumsum(sizes + 3) - (sizes + 3)
        real = np.ones(len(x), dtype=bool)
        for k in range(3):
            x[heads + k] = PAD
            real[heads + k] = False
        some = sizes > 0
        if some.any():
            places, table = self._lengths(_windows(x)[real[3:]])
            starts = (np.cumsum(sizes) - sizes)[some]
            for k, lengths in enumerate(table):
                out[np.arange(first, last)[some], k] = np.add.reduceat(lengths[places], starts)


def scorer(model: Model) -> Scorer:
    """The trees of a model, made once by each worker process."""
    return only(model.key, lambda: Scorer(model))


def identify(df: DataFrame, model: Model, text_col: str = "text", lang_out: str = "lang_pred", score_out: str = "score") -> DataFrame:
    """Adds the predicted language and its share of the posterior (equal priors) among the languages.

    A null text, one without a letter, and any text if the model knows no language get ``und`` and
    score 0.  Ties go to the language that sorts first.  Columns already named like the outputs are
    replaced; all others pass through; an empty table gives an empty table.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)
    keep = [f for f in df.schema.fields if f.name not in (lang_out, score_out)]
    names = [f.name for f in keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        table = scorer(model) if model.langs else None
        for batch in parts(batches):
            texts = batch.column(batch.schema.get_field_index(text_col)).to_pylist()
            known = [bool(t) and any(map(str.isalpha, t)) for t in texts]
            lang, score = [UND] * len(texts), np.zeros(len(texts))
            if table is not None:
                bits = table.bits([t.encode() if k else b"" for t, k in zip(texts, known)])
                best = bits.argmin(1)
                share = 1 / np.exp2(-np.minimum(bits - bits.min(1, keepdims=True), 1000)).sum(1)
                for i in np.flatnonzero(known):
                    lang[i], score[i] = model.langs[best[i]], share[i]
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index(n)) for n in names] + [pa.array(lang, pa.string()), pa.array(score)], names + [lang_out, score_out])

    schema = T.StructType(keep + [T.StructField(lang_out, T.StringType()), T.StructField(score_out, T.DoubleType())])
    return df.select(*dict.fromkeys(names + [text_col])).mapInArrow(run, schema)
