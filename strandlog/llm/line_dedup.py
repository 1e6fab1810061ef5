"""Line deduplication by overlapping chunks of lines (operator 4).

A text is cut at its line feeds.  Every two neighbouring lines (lines without words between them
included) are a chunk, and a line of ``long_words`` words or more is one of its own too.  Chunks
overlap and depend on their own lines only, so a passage has the same chunks wherever it stands, and
they cover it to its edges.  A chunk whose bytes occur anywhere before (by document id, then place) is
removed; the first occurrence stays.  So of two lines or more that stand together elsewhere before,
none is left, however few they are, and the first place of every line stays.

Equal chunks are found by a 128-bit hash; a chunk is removed only after its bytes have been
compared with those of the first occurrence.  One short line by itself is never removed.

Only hashes are shuffled for all chunks; texts are shuffled once by document, and the bytes of
chunks only where their hash repeats.  The occurrences of a very common chunk are compared in several
tasks, each with its own copy of the first.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandlog.llm.common import only, parts, staged

SPREAD = 4096  #: occurrences of a chunk that one task compares with the first


def chunks(text: str | None, long_words: int = 50) -> list[tuple[int, int, str]]:
    """(first line, line after the last, text) of the chunks that may be removed."""
    if not text:
        return []
    lines = text.split("\n")
    out, last = [], None
    for k, line in enumerate(lines):
        if not line or line.isspace():
            continue
        if last is not None:
            out.append((last, k + 1, "\n".join(lines[last : k + 1])))
        if len(line) >= 2 * long_words - 1 and len(line.split()) >= long_words:
            out.append((k, k + 1, line))
        last = k
    return out


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def find_repeats(docs: DataFrame, id_col: str, text_col: str, **rule) -> tuple[DataFrame, DataFrame]:
    """The documents with ``own_hash`` and ``spots`` (their repeated chunks), and the verified removals.

    A removal is (rid, rhash, removed): the (place, stop) of a document's chunks that occur before.
    """
    docs = docs.withColumn("own_hash", F.xxhash64(text_col))

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only()
        for batch in parts(batches):
            rows, hi, lo, place, stop = [], [], [], [], []
            for i, text in enumerate(batch.column(2).to_pylist()):
                for a, b, own in chunks(text, **rule):
                    x = xxhash.xxh3_128_intdigest(own)
                    rows.append(i)
                    hi.append(_signed(x >> 64))
                    lo.append(_signed(x & ((1 << 64) - 1)))
                    place.append(a)
                    stop.append(b)
            at = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(hi, pa.int64()), pa.array(lo, pa.int64()), pa.array(place, pa.int32()), pa.array(stop, pa.int32())], ["id", "own_hash", "hi", "lo", "place", "stop"])

    f = T.StructField
    id_type = docs.schema[id_col].dataType
    found = docs.select(F.col(id_col).alias("id"), "own_hash", F.col(text_col).alias("text")).mapInArrow(
        hashes, T.StructType([f("id", id_type), f("own_hash", T.LongType()), f("hi", T.LongType()), f("lo", T.LongType()), f("place", T.IntegerType()), f("stop", T.IntegerType())])
    )
    found = staged(found, "chunks")
    spot = F.struct("id", "own_hash", "place")
    repeated = found.groupBy("hi", "lo").agg(F.min(spot).alias("first"), F.max(spot).alias("last"), F.count(F.lit(1)).alias("n")).filter(~F.col("first").eqNullSafe(F.col("last"))).select("hi", "lo", "first", (F.col("n") / SPREAD).cast("int").alias("salts"))
    spots = found.join(repeated, ["hi", "lo"]).groupBy("id", "own_hash").agg(F.sort_array(F.collect_set(F.struct("place", "stop", "hi", "lo", F.col("first").eqNullSafe(spot).alias("is_first"), "salts"))).alias("spots"))
    spots = spots.select(F.col("id").alias("sid"), F.col("own_hash").alias("shash"), "spots")
    with_spots = docs.join(spots, docs[id_col].eqNullSafe(spots["sid"]) & (docs["own_hash"] == spots["shash"]), "left").drop("sid", "shash")

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only()
        names = batches_names
        for batch in parts(batches):
            ids, own, texts, all_spots = (batch.column(batch.schema.get_field_index(n)) for n in names)
            rows, values = [], []
            for i, found in enumerate(all_spots.to_pylist()):
                if found:
                    lines = texts[i].as_py().split("\n")
                    for s in found:
                        rows.append(i)
                        values.append((s["hi"], s["lo"], s["place"], s["stop"], s["is_first"], s["salts"], "\n".join(lines[s["place"] : s["stop"]]).encode()))
            at = pa.array(rows, pa.int64())
            columns = list(zip(*values)) or [()] * 7
            yield pa.RecordBatch.from_arrays([ids.take(at), own.take(at)] + [pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.int32(), pa.binary()))], ["id", "own_hash", "hi", "lo", "place", "stop", "is_first", "salts", "bytes"])

    batches_names = [id_col, "own_hash", text_col, "spots"]
    # No column is pruned before this map, so both uses of with_spots share one shuffle of the texts.
    cut = with_spots.filter("spots is not null").mapInArrow(
        pieces, T.StructType([f("id", id_type), f("own_hash", T.LongType()), f("hi", T.LongType()), f("lo", T.LongType()), f("place", T.IntegerType()), f("stop", T.IntegerType()), f("is_first", T.BooleanType()), f("salts", T.IntegerType()), f("bytes", T.BinaryType())])
    )
    cut = staged(cut, "repeated-chunks")
    firsts = cut.filter("is_first").select("hi", "lo", "salts", F.col("bytes").alias("first_bytes")).groupBy("hi", "lo").agg(F.min("first_bytes").alias("first_bytes"), F.max("salts").alias("salts"))
    firsts = firsts.select("hi", "lo", "first_bytes", F.explode(F.sequence(F.lit(0), F.col("salts"))).alias("salt"))
    dealt = cut.filter("not is_first").withColumn("salt", F.pmod(F.hash("id", "own_hash", "place"), F.col("salts") + 1))
    same = dealt.join(firsts, ["hi", "lo", "salt"]).filter(F.col("bytes") == F.col("first_bytes"))
    removals = same.groupBy("id", "own_hash").agg(F.collect_set(F.struct("place", "stop")).alias("removed")).select(F.col("id").alias("rid"), F.col("own_hash").alias("rhash"), "removed")
    return with_spots, removals


REPORT = ("lines_removed", "words_removed", "words_left")


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", report: bool | tuple[str, str, str] = False, **rule) -> DataFrame:
    """The documents with repeated chunks of lines taken out of ``text_col``.

    All columns come back (with ``report`` also lines_removed, words_removed and words_left, or three columns
    of the names given there; they replace columns of their names).  A null text stays null, an empty one empty; a text all of
    whose lines repeat becomes empty.  Equal ids with different texts are ordered by a hash of the
    text; rows equal in id and text count as one document, and each of them keeps what it keeps.
    An empty table gives an empty table.
    """
    made = REPORT if report is True else tuple(report or ())
    names = [c for c in docs.columns if c not in made]
    docs = docs.select(*names)
    plain = docs.select(*[F.col(c).alias(f"c{i}") for i, c in enumerate(names)])  # no clash with names used here
    own_id, own_text = f"c{names.index(id_col)}", f"c{names.index(text_col)}"
    with_spots, removals = find_repeats(plain, own_id, own_text, **rule)
    joined = with_spots.join(removals, with_spots[own_id].eqNullSafe(removals["rid"]) & (with_spots["own_hash"] == removals["rhash"]), "left").drop("rid", "rhash", "own_hash")
    kept = [f for f in plain.schema.fields]

    def edit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only()
        for batch in parts(batches):
            get = lambda n: batch.column(batch.schema.get_field_index(n))  # noqa: E731, B023
            texts, lines_out, words_out, left = get(own_text).to_pylist(), [], [], []
            for i, (spots, removed) in enumerate(zip(get("spots").to_pylist(), get("removed").to_pylist())):
                gone = words = 0
                if removed:
                    drop, lines = {(x["place"], x["stop"]) for x in removed}, texts[i].split("\n")
                    first = {(s["hi"], s["lo"]): s["stop"] for s in spots if s["is_first"]}
                    marks = [False] * len(lines)
                    for s in spots:
                        if (s["place"], s["stop"]) in drop:
                            # One line over and over: what the first occurrence holds of this one stays.
                            start = max(s["place"], first.get((s["hi"], s["lo"]), 0))
                            marks[start : s["stop"]] = [True] * (s["stop"] - start)
                    if all(m or not x or x.isspace() for x, m in zip(lines, marks)):
                        marks = [True] * len(lines)
                    gone = sum(marks)
                    words = sum(len(x.split()) for x, m in zip(lines, marks) if m)
                    texts[i] = "\n".join(x for x, m in zip(lines, marks) if not m)
                lines_out.append(gone)
                words_out.append(words)
                left.append(len(texts[i].split()) if texts[i] and report else 0)
            cols = [pa.array(texts, pa.string()) if f.name == own_text else get(f.name) for f in kept]
            yield pa.RecordBatch.from_arrays(cols + [pa.array(x, pa.int64()) for x in (lines_out, words_out, left)], [f.name for f in kept] + list(REPORT))

    f = T.StructField
    out = joined.mapInArrow(edit, T.StructType(kept + [f(n, T.LongType()) for n in REPORT]))
    own = [F.col(f"c{i}").alias(c) for i, c in enumerate(names)]
    return out.select(*own, *[F.col(a).alias(b) for a, b in zip(REPORT, made)])
