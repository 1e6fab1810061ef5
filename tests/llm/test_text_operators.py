import hashlib
import math
import random
import re
import struct
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import tiktoken
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from strandlog.llm import bpe, langid, line_dedup, quality, queries, token_counts, toxicity
from tests.llm.conftest import DOCS

PATH, PATTERN = queries.tokenizer_files()
TOK = bpe.tokenizer(PATH, PATTERN)
LIBRARY = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=TOK.ranks, special_tokens={})
TEXTS = st.lists(st.sampled_from([*"abth ein'sré 12\n\t　\x1c\x85日!", "  ", "the", "ation"]), max_size=150).map("".join)


@settings(max_examples=300, deadline=None)
@given(TEXTS)
def test_bpe_equals_library(text):
    expected = LIBRARY.encode_ordinary(text)
    assert TOK.encode(text) == expected
    [(counts, ids)] = list(TOK.encode_all(pa.array([text, None, text])))
    assert counts.tolist() == [len(expected), 0, len(expected)] and ids.tolist() == expected * 2
    assert TOK.decode(expected) == text.encode()


def test_bpe_joins_long_pieces_and_windows():
    rnd = random.Random(5)
    for letters in ("ab", "aeint", "z"):
        data = "".join(rnd.choice(letters) for _ in range(3000)).encode()
        whole = TOK._merge_wide(data)
        assert list(TOK.tree(data)) == whole == LIBRARY.encode_ordinary(data.decode())
        for cut in (1, 7, 1500, 2999):
            assert list(TOK.join(tuple(TOK._merge_wide(data[:cut])), tuple(TOK._merge_wide(data[cut:])))) == whole
    assert all(TOK._merge_small(d) == TOK._merge_wide(d) for d in (b"there", b"ation and", b"xyzzyxx"))


def test_bpe_query_on_odd_rows(spark, odd_docs):
    out = bpe.round_trip_digests(odd_docs, PATH, PATTERN).collect()
    texts = Counter((r.doc_id, r.text or "") for r in odd_docs.collect())
    expected = Counter()
    for (i, t), n in texts.items():
        ids = LIBRARY.encode_ordinary(t)
        expected[i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest()] += n
    assert Counter(tuple(r) for r in out) == expected
    assert bpe.encode(odd_docs, PATH, PATTERN).columns == [c for c in odd_docs.columns if c != "ids"] + ["ids"]
    assert bpe.round_trip_digests(odd_docs.limit(0), PATH, PATTERN).count() == 0


@pytest.mark.parametrize("rule", ["first", "majority"])
def test_token_counts_by_hand(rule):
    text = "Zwei Sätze.\n\n  Ende\nhier é日本"
    ids = TOK.encode(text)
    starts, ends = token_counts.spans_of(TOK, ids, text.encode())
    sections = [(0, 6), (6, 12), (12, 17), (19, len(text))]
    to, crosses = token_counts.attribute(starts, ends, sections, rule)
    for k, (a, b) in enumerate(zip(starts, ends)):
        parts = [max(0, min(b, e) - max(a, s)) for s, e in sections]
        first = next((i for i, (s, e) in enumerate(sections) if s <= a < e), -1)
        want = first if rule == "first" else (int(np.argmax(parts)) if max(parts) else -1)
        assert to[k] == want
        assert crosses[k] == (not any(s <= a and b <= e for s, e in sections) and max(parts) > 0)


def test_token_counts_row_by_row(spark, odd_docs):
    docs = odd_docs.filter("coalesce(length(text), 0) < 10000")
    out = token_counts.count_tokens(docs, PATH, PATTERN).collect()
    want = Counter()
    for r in docs.collect():
        text = r.text or ""
        at, spans = 0, []
        for token in LIBRARY.encode_ordinary(text):
            raw = LIBRARY.decode_single_token_bytes(token)
            spans.append((at, at + len(raw)))
            at += len(raw)
        data = text.encode()
        char = lambda b: len(data[:b].decode(errors="ignore"))  # noqa: E731, B023
        counts = Counter()
        for a, b in spans:
            first = char(a)  # a token that starts inside a character counts from that character
            last = next(k for k in range(first, len(text)) if len(text[: k + 1].encode()) >= b)
            counts[text.count("\n", 0, first)] += 1
            counts["cut", text.count("\n", 0, first)] += text.count("\n", 0, first) != text.count("\n", 0, last)
        lines, start = text.split("\n"), 0
        if lines[-1] == "":
            lines.pop()
        for k, x in enumerate(lines):
            end = min(len(text), start + len(x) + 1)
            want[r.doc_id, k, start, end, counts[k], counts["cut", k]] += 1
            start = end
        if not lines:
            want[r.doc_id, -1, 0, 0, 0, 0] += 1
    assert Counter(tuple(r) for r in out) == want


def test_token_counts_of_odd_sections(spark):
    text = "one two three four five six"
    given = [{"start": 10, "end": 20}, None, {"start": 4, "end": 14}, {"start": None, "end": 3}, {"start": 9, "end": 2}, {"start": 24, "end": 99}, {"start": 24, "end": 99}]
    assert token_counts.disjoint(given) == [(10, 20), (0, 0), (4, 10), (0, 0), (9, 9), (24, 24), (24, 99)]
    docs = spark.createDataFrame([("a", text, given), ("b", None, None), ("c", text, [])], "section_id string, text string, parts array<struct<start:int,end:int>>")
    out = token_counts.count_tokens(docs, PATH, PATTERN, id_col="section_id", sections_col="parts").collect()
    assert sum(r.n_tokens for r in out if r.section_id == "a") == len(TOK.encode(text)) and len([r for r in out if r.section_id == "a"]) == 8
    assert [(r.section, r.n_tokens) for r in out if r.section_id == "b"] == [(-1, 0)] and [r.section for r in out if r.section_id == "c"] == [-1]
    with pytest.raises(ValueError, match="section"):
        token_counts.count_tokens(docs.withColumnRenamed("section_id", "section"), PATH, PATTERN, id_col="section")


def test_token_counts_add_up(spark, odd_docs):
    out = token_counts.count_tokens(odd_docs, PATH, PATTERN).groupBy("doc_id").sum("n_tokens").collect()
    want = Counter()
    for r in odd_docs.collect():
        want[r.doc_id] += len(TOK.encode(r.text))
    assert {r[0]: r[1] for r in out} == dict(want)
    assert token_counts.count_tokens(odd_docs.limit(0), PATH, PATTERN).count() == 0


def plain_dedup(rows):
    """The rule of line dedup, one text after the other: neighbouring lines, and single lines of 50 words or more."""
    def pieces(lines):
        own = [k for k, x in enumerate(lines) if x.strip()]
        yield from ((a, b + 1) for a, b in zip(own, own[1:]))
        yield from ((k, k + 1) for k in own if len(lines[k].split()) >= 50)

    seen, out = set(), []
    for _, text in rows:
        lines = (text or "").split("\n")
        drop = set()
        for a, b in sorted(pieces(lines)):
            if (piece := "\n".join(lines[a:b])) in seen:
                drop |= set(range(a, b))
            seen.add(piece)
        out.append(None if text is None else "\n".join(x for k, x in enumerate(lines) if k not in drop))
    return out


@pytest.mark.parametrize("spread", [4096, 3])
def test_line_dedup_equals_plain(spark, monkeypatch, spread):
    monkeypatch.setattr(line_dedup, "SPREAD", spread)
    rnd = random.Random(2)
    lines = [" ".join(rnd.choice(["aa", "bb", "cc", "dd"]) for _ in range(rnd.choice([3, 9, 60]))) for _ in range(60)]
    passage = [f"passage line {k} here" for k in range(12)]
    rows = []
    for i in range(80):
        body = [rnd.choice(lines) for _ in range(rnd.randint(1, 20))]
        if i % 3 == 0:
            at = rnd.randint(0, len(body))
            body[at:at] = passage
        rows.append((i, "\n".join(body)))
    rows += [(100, rows[3][1]), (101, None), (102, "")]
    got = {r.doc_id: r.text for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == dict(zip([i for i, _ in rows], plain_dedup(rows)))
    assert any(got[i] != t for i, t in rows)  # something goes


def test_line_dedup_shift_resistant_and_long_lines():
    passage = [f"passage line {k} here" for k in range(30)]
    cut = [{own for _, _, own in line_dedup.chunks("\n".join(head + passage + ["tail"]))} for head in (["x"], ["x", "y", "z"])]
    assert len(cut[0] & cut[1]) >= 3
    long = " ".join(f"w{k}" for k in range(55))
    assert all(long in {own for _, _, own in line_dedup.chunks(t)} for t in (f"a\n{long}\nb c", long, f"{long}\nx"))


def test_line_dedup_removes_passages_whole(spark):
    rnd = random.Random(4)
    rows, want = [], {}
    own = lambda: " ".join(f"w{rnd.random()}" for _ in range(8))
    for n in (2, 3, 5, 8, 10, 20):
        for case in range(6):
            passage = [own() for _ in range(n)]
            if case % 2:
                passage[1:1] = ["", " "]
            for copy in range(3):
                i, before, after = len(rows), [own() for _ in range(copy)], [own(), passage[0]]
                rows.append((i, "\n".join(before + passage + after)))
                want[i] = "\n".join(before + (passage if copy == 0 else []) + after)
    same = [(1000, "la\nla\nla\nla\nend"), (1001, "so\nla\nla\nla\n"), (1002, "\nla\nla\n\n"), (1003, "end"), (1004, "end\n\nnew")]
    want |= {1000: "la\nla\nend", 1001: "so\n", 1002: "", 1003: "end", 1004: "end\n\nnew"}
    got = {r.doc_id: r.text for r in line_dedup.dedup_lines(spark.createDataFrame(rows + same, "doc_id long, text string")).collect()}
    assert got == want


def test_line_dedup_on_odd_rows(spark, odd_docs):
    out = line_dedup.dedup_lines(odd_docs, report=True)
    assert out.columns == odd_docs.columns + ["lines_removed", "words_removed", "words_left"]
    rows = sorted(((r.doc_id, r.text) for r in out.collect() if r.doc_id is not None), key=str)
    assert len(rows) == 11 and (3, None) in rows and (4, "") in rows
    assert sum(i == 2 for i, _ in rows) == 2
    assert line_dedup.dedup_lines(odd_docs.limit(0)).count() == 0


def base(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    tri = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
    c = Counter(tri)
    covered = {k + j for k, x in enumerate(tri) if c[x] > 1 for j in range(3)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


def test_quality_counts_windows_of_equal_hash(spark, monkeypatch):
    rnd = random.Random(5)
    rows = [(i, " ".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(0, 400)))) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("words", F.split("text", " ")).withColumn("hashes", quality.hashed(F.col("words")))
    for low in (1 << 24, 1 << 61, 1 << 63):  # 40, 3 and no bits of the hashes
        monkeypatch.setattr(quality, "_LOW", low - 1)
        monkeypatch.setattr(quality, "_LONG", (1 << 31) - 1)
        got = {r.doc_id: r.n_repeat_words for r in quality.repeated_words(docs).collect()}
        assert got == {i: base(t)[4] for i, t in rows}


def spark_hash(x, seed=42):
    """Spark's xxhash64 of a string or a long."""
    n = xxhash.xxh64_intdigest(x.encode() if isinstance(x, str) else struct.pack("<q", x), seed % (1 << 64))
    return n - (1 << 64) if n >= 1 << 63 else n


def test_quality_equals_plain_ratios(spark):
    rnd = random.Random(6)
    words = [f"w{k}" for k in range(40)]
    rows = [(i, " ".join(rnd.choice(words[: 10 if i % 3 else 40]) for _ in range(rnd.randint(0, 90)))) for i in range(60)] + [(60, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    good, buckets = {i for i in range(60) if i % 3}, 64
    out = quality.judge(docs, quality.ratios(docs, spark.createDataFrame([(i,) for i in good], "doc_id long"), buckets=buckets), buckets=buckets, threshold=0.01).collect()

    def cells(text):
        h = [spark_hash(w) for w in (text or "").split()]
        return [x % buckets for x in h] + [(spark_hash(y, spark_hash(x)) if y is not None else spark_hash(x)) % buckets for x, y in zip(h, h[1:] + [None])][: len(h)]

    every = Counter(c for _, t in rows for c in cells(t))
    trusted = Counter(c for i, t in rows if i in good for c in cells(t))
    ratio = {c: round((math.log((trusted[c] + 0.5) / (trusted.total() + 0.5 * buckets)) - math.log((n + 0.5) / (every.total() + 0.5 * buckets))) * (1 << 20)) for c, n in every.items()}
    for r in out:
        text = dict(rows)[r.doc_id]
        own = cells(text)
        want = sum(ratio[c] for c in own) / len(own) / (1 << 20) if own else 0.0
        assert abs(r.llr - want) < 2e-6
        assert r.kept == (not r.base_failed and r.llr >= 0.01)
    assert {r.kept for r in out if not r.base_failed} == {True, False}


def test_quality_counts_and_ratios(spark, odd_docs):
    rnd = random.Random(4)
    good, junk = ["the", "cat", "sat", "on", "a", "mat"], ["#x", "$y", "z%", "q|"]
    rows = [(100 + i, " ".join(rnd.choice(junk if i % 4 == 0 else good) + str(rnd.randint(0, 30)) for _ in range(80))) for i in range(40)]
    docs = odd_docs.select("doc_id", "text").unionByName(spark.createDataFrame(rows, "doc_id long, text string"))
    trusted = spark.createDataFrame([(100 + i,) for i in range(40) if i % 4], "doc_id long")
    table = quality.ratios(docs, trusted)
    out = quality.judge(docs, table).collect()
    want = Counter((r.doc_id, *base(r.text)) for r in docs.collect())
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in out) == want
    for r in out:
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert r.kept == (not r.base_failed and r.llr >= -0.35)
    by = {r.doc_id: r for r in out}
    assert all(by[100 + i].kept == bool(i % 4) or by[100 + i].base_failed for i in range(40))
    assert quality.judge(docs.limit(0), table).count() == 0


def test_language_is_proper_and_learns(spark, odd_docs):
    rnd = random.Random(6)
    words = {"en": ["the", "and", "ing", "house"], "fr": ["les", "été", "eau", "où"]}
    rows = [(i, " ".join(rnd.choice(words[x]) for _ in range(30)), x) for i, x in enumerate(["en", "fr"] * 60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.train(docs, min_count=1)
    assert model.langs == ["en", "fr"]
    out = langid.identify(docs.withColumn("held_out", langid.held_out("doc_id")), model).collect()
    assert all(r.lang_pred == r.lang and 0.5 <= r.score <= 1 for r in out) and any(r.held_out for r in out)
    for tree in langid.Scorer(model).trees:  # a distribution in every context
        for context in [*tree.contexts[3][::50], *tree.contexts[2][::20], 0]:
            assert abs(np.exp2(-tree.lengths(context * langid.BASE + np.arange(256))).sum() - 1) < 1e-9
    odd = {r.doc_id: r for r in langid.identify(odd_docs.select("doc_id", "text", "score"), model).collect()}
    assert all(odd[i].lang_pred == "und" and odd[i].score == 0 for i in (3, 4, 6, 8)) and odd[9].lang_pred == "fr"
    none = langid.train(docs.limit(0))
    assert {r.lang_pred for r in langid.identify(docs, none).collect()} == {"und"}


def test_language_leaves_none_out(spark):
    docs = spark.createDataFrame([(i, "abc", "xyz"[i % 3]) for i in range(60)], "doc_id long, text string, lang string")
    assert langid.train(docs, max_langs=3).langs == ["x", "y", "z"]
    with pytest.raises(ValueError, match="max_langs"):
        langid.train(docs, max_langs=2)


def plain_ppm(train, text, min_count):
    """Code length of a text by a plain coder: escape method C with exclusion over contexts of 3 to 0 bytes."""
    seen = defaultdict(Counter)
    for t in train:
        x = [256] * 3 + list(t)
        for i in range(3, len(x)):
            for k in range(4):
                seen[tuple(x[i - k : i])][x[i]] += 1
    for c in [c for c in seen if len(c) == 3 and seen[c].total() < min_count]:
        del seen[c]
    x, bits = [256] * 3 + list(text), 0.0
    for i in range(3, len(x)):
        tried, p, k = set(), 1.0, next(k for k in (3, 2, 1, 0) if k == 0 or tuple(x[i - k : i]) in seen)
        while k >= 0:
            left = {a: n for a, n in seen[tuple(x[i - k : i])].items() if a not in tried}
            n, d = sum(left.values()), len(left)
            if x[i] in left:
                p *= left[x[i]] / (n + d)
                break
            if n:
                p *= d / (n + d)
            tried |= set(left)
            k -= 1
        else:
            p /= 256 - len(tried)
        bits -= math.log2(p)
    return bits


def test_language_equals_plain_coder(monkeypatch):
    rnd = random.Random(3)
    monkeypatch.setattr(langid, "ROOM", 2000)  # most windows are not kept
    for _ in range(20):
        letters = rnd.choice(["ab ", "abcde éß", "xyz日本語 "])
        mk = lambda n: "".join(rnd.choice(letters) for _ in range(n)).encode()  # noqa: E731, B023
        train, least = [mk(rnd.randint(0, 60)) for _ in range(rnd.randint(1, 5))], rnd.choice([1, 2, 3])
        table = langid.Scorer(langid.Model(["x"], *([x] for x in langid._grams([t.decode() for t in train])), least))
        texts = [mk(rnd.randint(0, 40)) + rnd.choice([b"", b"Q", "ü".encode()]) for _ in range(6)]
        for _ in range(2):
            assert np.allclose(table.bits(texts)[:, 0], [plain_ppm(train, t, least) for t in texts], atol=1e-6)


def test_language_long_text_in_pieces(monkeypatch):
    g, n = langid._grams(["abc abd abe"] * 3)
    table = langid.Scorer(langid.Model(["x"], [g], [n]))
    texts = [b"abc abd", b"", b"abd abc abd abx"]
    whole = table.bits(texts)
    monkeypatch.setattr(langid, "PIECE", 4)
    assert np.allclose(table.bits(texts), whole)
    assert np.allclose(table.bits([texts[2]])[0], whole[2])


def test_toxicity_fit_is_the_optimum():
    """At the fitted weights the slope of the plain likelihood is what the L1 penalty allows."""
    rnd = random.Random(2)
    rows, grades = [], []
    for i in range(300):
        grade = rnd.choice([0, 0, 0, 1, 2, 3])
        rows.append(np.unique([rnd.randint(0, 30) for _ in range(6)] + [100 + rnd.randint(0, 3) for _ in range(grade)]))
        grades.append(grade)
    grades, l1 = np.array(grades), 2e-3
    model = toxicity.fit(rows, grades, l1=l1, steps=4000)

    def loss(theta, weights):
        total = 0.0
        for x, y in zip(rows, grades):
            s = [1.0] + [1 / (1 + math.exp(t - sum(weights.get(int(f), 0.0) for f in x))) for t in theta] + [0.0]
            total -= math.log(s[y] - s[y + 1])
        return total / len(rows)

    at, eps = loss(model.theta, model.weights), 1e-5
    assert model.theta == sorted(model.theta) and at < loss([math.log(1 / p - 1) for p in [(grades >= k).mean() for k in (1, 2, 3)]], {})
    for k in range(3):
        assert abs(loss([t + eps * (j == k) for j, t in enumerate(model.theta)], model.weights) - at) / eps < 2e-3
    for f in {int(x) for r in rows for x in r}:
        w = model.weights.get(f, 0.0)
        slope = (loss(model.theta, model.weights | {f: w + eps}) - at) / eps
        assert abs(slope) <= l1 + 1e-3 if w == 0 else abs(slope + math.copysign(l1, w)) < 1e-3
    assert all(model.weights.get(100 + k, 0) > 0.3 for k in range(4))


def test_toxicity_on_held_out_labels(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    half = F.crc32(F.col("doc_id").cast("string")) % 2 == 0
    model = toxicity.train(docs, labels.filter(half))
    real = {r.doc_id: r.toxic for r in labels.filter(~half).collect()}
    said = {r.doc_id: int(r.toxic) for r in toxicity.score(docs.select("doc_id", "text"), model).collect() if r.doc_id in real}
    hits, named = sum(said[i] and real[i] for i in said), sum(said.values())
    assert named and hits / named > 0.7 and sum(said[i] and not real[i] for i in said) < 0.03 * len(said)


def test_toxicity_one_document_an_id(spark):
    rows = [(1, f"text {k} vile") for k in range(50)] + [(2, "good words")]
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 0), (None, 1), (3, None)], "doc_id long, toxic int")
    model = toxicity.train(spark.createDataFrame(rows + [(None, "x"), (4, None)], "doc_id long, text string"), labels)
    assert model.theta == sorted(model.theta)


def test_toxicity_orders_and_flags(spark, odd_docs):
    rnd = random.Random(8)
    bad, good = [f"vile{k}" for k in "abcdef"], [f"word{k}" for k in "abcdefghijklmn"]
    rows, labels = [], []
    for i in range(400):
        n = [0, 0, 0, 2, 4, 6][i % 6]
        own = [rnd.choice(good) for _ in range(40)] + rnd.sample(bad, n)
        rnd.shuffle(own)
        rows.append((i, " ".join(own)))
        if i < 300:
            labels.append((i, int(n > 0)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = toxicity.train(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    assert model.theta == sorted(model.theta)
    out = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    assert all(out[i].toxic == (i % 6 >= 3) for i in range(300, 400))
    mean = [np.mean([out[i].expected_severity for i in out if i % 6 == k]) for k in (0, 3, 4, 5)]
    assert mean == sorted(mean)
    odd = toxicity.score(odd_docs, model)
    assert odd.count() == 13 and odd.columns[-3:] == ["expected_severity", "grade", "toxic"]
    empty = toxicity.train(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert not toxicity.score(docs, empty).filter("toxic").count()
    assert spark.createDataFrame([], DOCS).count() == 0
