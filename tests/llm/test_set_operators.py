import hashlib
import io
import math
import random
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from strandlog.llm import mixing, near_dup, topk, warc
from strandlog.llm.common import join_one
from strandlog.llm.oracle import ORACLE


@pytest.mark.parametrize("block, chunk, head", [(2048, 64 << 20, 16), (7, 2000, 4)])
def test_top_k_equals_brute_force(spark, monkeypatch, block, chunk, head):
    for name, value in (("BLOCK", block), ("CHUNK", chunk), ("HEAD", head)):
        monkeypatch.setattr(topk, name, value)
    rnd = np.random.default_rng(1)
    x = rnd.normal(size=(300, 24)) * rnd.uniform(0.1, 3, size=(300, 1))
    x[50:80] = x[50]  # ties
    rows = [(i, [float(v) for v in x[i]]) for i in range(300)]
    odd = [(1000, None), (1020, [1.0, None]), (1040, [float("nan")] * 24), (1060, []), (2000, [1.0, 2.0]), (None, [1.0] * 24)]
    out = topk.top_k(spark.createDataFrame([(*r, 1) for r in rows + odd + rows[:3]], "vec_id long, embedding array<double>, score int"), k=5)
    ints = np.floor(64 * x)
    want = set()
    for q in range(0, 300, 20):
        s = (ints @ ints[q]).astype(int)
        order = [j for j in np.lexsort((np.arange(300), -s)) if j != q][:5]
        want |= {(q, r + 1, int(j), int(s[j])) for r, j in enumerate(order)}
    assert {tuple(r) for r in out.collect()} == want
    assert topk.top_k(spark.createDataFrame([], "vec_id long, embedding array<double>")).count() == 0


def test_top_k_prunes_without_loss():
    rnd = np.random.default_rng(3)
    c = np.floor(rnd.normal(size=(500, 32)) * np.linspace(60, 1, 32))
    q = np.floor(rnd.normal(size=(7, 32)) * np.linspace(60, 1, 32))
    ids, basis = np.arange(500), np.linalg.svd(c, full_matrices=False)[2]
    exact = q @ c.T
    least = np.sort(exact, axis=1)[:, -9]
    got = {i: list(zip(v.tolist(), s.tolist())) for i, v, s in topk.best_in_block(np.arange(-7, 0), q, ids, c, least, 9, basis)}
    for i in range(7):
        order = np.lexsort((ids, -exact[i]))[:9]
        assert got[i] == [(int(j), int(exact[i, j])) for j in order]


def test_mixing_targets_and_oracle(spark, odd_docs, tmp_path):
    rnd = random.Random(3)
    rows = [(i, " ".join(["w"] * rnd.randint(0, 60)), rnd.choice(["a", "b", "b", "b", "c", None, "é"])) for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {tuple(r) for r in mixing.mix(docs).select("doc_id", "size", "source_size", "target", "taken").collect()}
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += len(t.split())
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None]
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    target, open_, left = {}, set(names), float(sum(sizes.values()))
    while open_:  # share, cap, reshare
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        above = {s for s in open_ if share[s] > 3 * sizes[s]}
        for s in above or open_:
            target[s] = 3.0 * sizes[s] if above else share[s]
        left -= sum(target[s] for s in above)
        open_ = open_ - above if above else set()
    by = {i: s for i, _, s in rows}
    taken = Counter()
    for i, size, source_size, t, own in got:
        assert source_size == sizes[by[i]] and math.isclose(t, target[by[i]], rel_tol=1e-12)
        assert own <= 3 * size and (size == 0 or own % size == 0)
        taken[by[i]] += own
    assert all(abs(taken[s] - target[s]) <= 60 for s in names)
    again = {tuple(r) for r in mixing.mix(docs.repartition(7)).select("doc_id", "size", "source_size", "target", "taken").collect()}
    assert again == got
    con = duckdb.connect()
    docs.toPandas().to_parquet(tmp_path / "d.parquet")
    con.sql(f"create view documents as select * from '{tmp_path}/d.parquet'")
    sql = {(r[0], r[1], r[2], round(r[3], 6), r[4]) for r in con.sql("select doc_id, size, source_size, target, taken from (" + ORACLE["op8_mix_sources"] + ")").fetchall()}
    assert sql == {(i, s, z, round(t, 6), k) for i, s, z, t, k in got}
    assert mixing.mix(odd_docs).count() == 13 and mixing.mix(odd_docs.limit(0)).count() == 0


def plain_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(last[j - 1] + (x != y), last[j] + 1, row[-1] + 1))
    return row[-1]


def edited(rnd, words, n):
    words = list(words)
    for _ in range(n):
        k = rnd.randrange(len(words))
        words[k : k + 1] = rnd.choice([[], [f"new{rnd.random()}"], [words[k], f"more{rnd.random()}"]])
    return words


def test_banded_alignment_equals_plain():
    rnd = random.Random(7)
    for _ in range(400):
        a = [rnd.randint(0, 9) for _ in range(rnd.randint(0, 50))]
        b = list(a) if rnd.random() < 0.8 else [rnd.randint(0, 9) for _ in range(rnd.randint(0, 50))]
        for _ in range(rnd.randint(0, 10)):
            b[rnd.randint(0, len(b)) : rnd.randint(0, len(b))] = [rnd.randint(0, 9)]
        most = rnd.randint(0, 14)
        assert near_dup.edit_within(np.array(a, np.uint64), np.array(b, np.uint64), most) == (plain_distance(a, b) <= most)


def test_banded_alignment_of_long_sequences(monkeypatch):
    rnd = random.Random(8)
    monkeypatch.setattr(near_dup, "MASKS", 1)  # as for sequences whose places do not fit at once
    for case in range(150):
        a = [rnd.randint(0, 3 if case % 2 else 40) for _ in range(rnd.randint(30, 120))]
        b = edited(rnd, a, rnd.randint(0, 20)) if case % 5 else [rnd.randint(0, 3) for _ in range(60)]
        b = [x if isinstance(x, int) else 99 for x in b] or [1]
        d, band = plain_distance(a, b), rnd.randint(0, 60)
        got = near_dup.banded_distance(a, b, band)
        assert got == d if d <= band else got > band


def every_link(texts, similarity=0.8):
    """Pairs of all texts whose words align, each pair compared."""
    numbers: dict[str, int] = {}
    rows = [np.array([numbers.setdefault(w, len(numbers)) for w in t], np.uint64) for t in texts]
    return {(i, j) for i in range(len(rows)) for j in range(i) if near_dup.edit_within(rows[i], rows[j], int(max(len(rows[i]), len(rows[j])) * (1 - similarity) + 1e-9))}


def test_near_duplicates_against_all_pairs(spark):
    """Texts with edits spread evenly, at levels up to the operator's own threshold; copies of copies; one vocabulary."""
    rnd = random.Random(21)
    texts, made, level = [], {}, {}
    for g in range(168):
        words = [f"w{int(rnd.paretovariate(0.6)) % 3000}" for _ in range(rnd.choice([40, 100, 300]))]
        i = len(texts)
        texts.append(words)
        share = (0.05, 0.10, 0.14, 0.18)[g % 4]
        for _ in range(1 + g % 2):
            at = set(rnd.sample(range(len(words)), int(share * len(words))))
            made[len(texts)], level[len(texts)] = i, share
            texts.append([f"new{rnd.random()}" if k in at else w for k, w in enumerate(words)])
    links = every_link(texts)
    root = list(range(len(texts)))
    for _ in range(5):
        for i, j in links:
            root[i] = root[j] = min(root[i], root[j])
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    out = {r.doc_id: r.class_id for r in near_dup.near_duplicates(docs).collect()}
    assert all(root[out[i]] == root[i] for i in out)  # nothing is joined that no links join
    for share in sorted(set(level.values())):
        own = [(i, j) for i, j in links if level.get(i) == share]
        found = sum(out[i] == out[j] for i, j in own)
        assert len(own) >= 40 and found >= 0.9 * len(own), (share, found, len(own))
    again = near_dup.near_duplicates(docs.repartition(13, "text")).collect()
    assert {r.doc_id: r.class_id for r in again} == out


def test_near_duplicates_lose_no_link(spark):
    """Classes are those of all links: one key a text, so many links share none; texts of few words; all edits spread evenly."""
    rnd = random.Random(22)
    texts = [["a", "b"], ["a", "b "], ["b", "a"], *[[f"s{k}" for k in range(n)] for n in (4, 5, 6, 9, 10, 11)]]
    for g in range(90):
        words = [f"w{int(rnd.paretovariate(0.6)) % 900}" for _ in range(rnd.choice([5, 7, 10, 25, 60, 150]))]
        for share in (0, 0.1, 0.16, 0.2):
            at = set(rnd.sample(range(len(words)), int(share * len(words))))
            own = [rnd.choice([[], ["x", w], [f"new{rnd.random()}"]]) if k in at else [w] for k, w in enumerate(words)]
            texts.append([w for part in own for w in part])
    texts = [" ".join(t).split() for t in texts]
    root = list(range(len(texts)))
    links = every_link(texts)
    while any(root[i] != root[j] for i, j in links):
        for i, j in links:
            root[i] = root[j] = min(root[i], root[j])
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    few = [near_dup.sketch(np.array([near_dup.word_hash(w) for w in t], np.uint64), 1, 1)[0] for t in texts]
    assert sum(few[i] != few[j] for i, j in links) >= 50
    for sketches, take in ((1, 1), (10, 4)):
        got = {r.doc_id: r.class_id for r in near_dup.near_duplicates(docs, sketches=sketches, take=take).collect()}
        assert got == dict(enumerate(root))


def test_near_duplicates_after_a_member_has_left_with_its_head(spark):
    """Of three texts with one key, the second links to the head and the third only to the second."""
    words = [f"w{k}" for k in range(60)]
    for seed in range(200):
        rnd = random.Random(seed)
        at = rnd.sample(range(60), 20)
        chain = [words, [f"x{seed}" if k in at[:10] else w for k, w in enumerate(words)], [f"x{seed}" if k in at else w for k, w in enumerate(words)]]
        head = min(range(3), key=lambda k: hashlib.sha256(" ".join(chain[k]).encode()).digest())
        key = {near_dup.sketch(np.array([near_dup.word_hash(w) for w in t], np.uint64), 1, 1)[0] for t in chain}
        if head != 1 and len(key) == 1:
            break
    assert len(key) == 1 and head != 1 and len(every_link(chain)) == 2
    docs = spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(chain)], "doc_id long, text string")
    assert {r.class_id for r in near_dup.near_duplicates(docs, sketches=1, take=1).collect()} == {0}


def test_texts_that_align_share_a_first_gram():
    rnd = random.Random(23)
    for case in range(3000):
        similarity = rnd.choice([0.4, 0.6, 0.75, 0.8, 0.9])
        a = [rnd.randint(0, 5 if case % 2 else 5000) for _ in range(rnd.randint(1, 60))]
        b = [x if isinstance(x, int) else rnd.randint(0, 9) for x in edited(rnd, a, rnd.randint(0, 1 + len(a) // 3))]
        p, q = (near_dup.mixed(np.array(x, np.uint64) + np.uint64(1)) for x in (a, b))
        known = np.unique(near_dup.grams(np.concatenate([p, q])[::2], 2))
        counts = np.array([rnd.randint(1, 9) for _ in known])
        if len(q) and near_dup.edit_within(p, q, int(max(len(p), len(q)) * (1 - similarity) + 1e-9)):
            first = [near_dup.first_grams(x, similarity, known, counts) for x in (p, q)]
            assert len(set(first[0][0].tolist()) & set(first[1][0].tolist())) >= min(n for _, n in first) >= 1


def test_near_duplicates_ids_of_any_kind(spark):
    words = " ".join(f"w{k}" for k in range(40))
    rows = [("b", words, 1), ("a", words + " x", 2), ("a", words, 3), ("c", "other words only", 4), (None, words, 5), (None, "x y z", 6)]
    out = near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id string, text string, digest int"), digest_col="hex").collect()
    assert {r.class_id for r in out if r.hex in {hashlib.sha256(t.encode()).hexdigest() for t in (words, words + " x")}} == {"a"}
    assert sum(r.is_first for r in out) == 3 and sum(r.is_first for r in out if r.doc_id == "a") == 1


def test_join_of_hot_keys(spark, tmp_path):
    rnd = random.Random(1)
    left = [(k, 0 if k % 3 else rnd.randint(0, 50)) for k in range(3000)]
    spark.createDataFrame(left, "node long, other long").write.parquet(str(tmp_path / "left"))
    right = spark.createDataFrame([(k, k * 7) for k in range(40)], "other long, root long")
    got = join_one(spark.read.parquet(str(tmp_path / "left")), right, "other").select("node", "other", "root").collect()
    assert {tuple(r) for r in got} == {(n, k, k * 7) for n, k in left if k < 40} and len(got) == sum(k < 40 for _, k in left)


def test_near_duplicates_find_planted_groups(spark, odd_docs):
    rnd = random.Random(9)
    rows, group = [], {}
    passage = [f"shared{k}" for k in range(60)]
    for g in range(40):
        words = [f"w{rnd.randint(0, 5000)}" for _ in range(rnd.choice([40, 150, 600]))]
        if g % 2:
            words[20:20] = passage  # a passage that unrelated texts share
        for c in range(rnd.randint(1, 5)):
            i = len(rows)
            own = words if c == 1 else edited(rnd, words, len(words) // 40 if c else 0)
            rows.append((i, " ".join(own)))
            group[i] = g
    rows += [(5000 + k, rows[0][1]) for k in range(300)]  # a hot group of copies
    group |= {5000 + k: group[0] for k in range(300)}
    out = {r.doc_id: r for r in near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    first = {}
    for i in sorted(group):
        first.setdefault(group[i], i)
    assert {i: r.class_id for i, r in out.items()} == {i: first[g] for i, g in group.items()}
    assert sum(r.is_first for r in out.values()) == 40
    odd = near_dup.near_duplicates(odd_docs).collect()
    by = {r.doc_id: r.class_id for r in odd if r.doc_id is not None}
    assert len(odd) == 13 and by[2] == by[1] == 1 and by[4] == by[5] == 4 and by[10] == by[7] == 7 and by[3] == 3 and by[6] == 6
    assert near_dup.near_duplicates(odd_docs.limit(0)).count() == 0


def test_near_duplicates_beside_an_unlike_head(spark):
    rnd = random.Random(11)
    passage, rows = [f"shared{k}" for k in range(70)], []
    for g in range(30):  # unlike texts that share a passage, each with a near copy
        words = [f"w{rnd.random()}" for _ in range(15)] + passage + [f"w{rnd.random()}" for _ in range(rnd.choice([15, 16, 60]))]
        rows += [(len(rows), words), (len(rows) + 1, words[:3] + ["new"] + words[3:])]
    rnd.shuffle(rows)
    hashed = {i: np.array([near_dup.word_hash(w) for w in words], np.uint64) for i, words in rows}
    key = {i: near_dup.sketch(h, 1, 1)[0] for i, h in hashed.items()}
    out = near_dup.near_duplicates(spark.createDataFrame([(i, " ".join(words)) for i, words in rows], "doc_id long, text string"), sketches=1, take=1)
    got = {r.doc_id: r.class_id for r in out.collect()}
    assert Counter(key.values()).most_common(1)[0][1] > 20
    assert got == {i: i - 1 if i % 2 and key[i] == key[i - 1] else i for i in got}


def test_bags_never_part_what_aligns(spark):
    rnd = random.Random(12)
    rows = []
    for i in range(300):
        words = [f"w{rnd.randint(0, 9 if i % 2 else 900)}" for _ in range(rnd.choice([5, 60, 3000]))]
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(edited(rnd, words, rnd.randint(0, len(words) // 3))))]
    made = {r.id: r for r in near_dup.sketched(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text", 1, 1).collect()}
    x, y = (pa.table({"node": [r.id for r in t], "n_words": [r.n_words for r in t], "bag": [bytes(r.bag) for r in t]}) for t in ([r for i, r in made.items() if i % 2 == k and r.bag] for k in (0, 1)))
    a, b = near_dup.possible(x, y, 0.8)
    left = set(zip(x["node"].to_numpy()[a].tolist(), y["node"].to_numpy()[b].tolist()))
    h = {i: np.array([near_dup.word_hash(w) for w in t.split()], np.uint64) for i, t in rows}
    good = {(i, i + 1) for i in range(0, 600, 2) if made[i + 1].bag and near_dup.edit_within(h[i], h[i + 1], int(max(len(h[i]), len(h[i + 1])) * 0.2 + 1e-9))}
    assert good <= left and good and len(left) < 300 * 299 / 2


def test_components_of_a_chain(spark):
    links = spark.createDataFrame([(k, k + 1) for k in range(40)] + [(100, 101)], "a long, b long")
    assert {r.node: r.root for r in near_dup.components(links).collect()} == {k: 0 for k in range(41)} | {100: 100, 101: 100}


PAGES = "page_id long, url string, html string, payload string"


def test_warc_round_trip(spark, tmp_path):
    long = "<html>" + "é" * 200
    rows = [(5, "http://a", long), (3, "http://b", long), (9, None, long), (1, "x", None), (2, "y", ""), (4, "z", "short"), (6, "z", "short"), (7, "u", "\x1f\x8b\x08 WARC/1.1\r\n\r\n" * 50), (None, "n", long), (8, "big", "ab" * 2_000_000), (3, "http://b", long)]
    out = warc.archive(spark.createDataFrame([(*r, "clash") for r in rows], PAGES)).collect()
    want = Counter()
    for i, u, h in rows:
        data = (h or "").encode()
        to = 3 if h == long and i not in (3, None) else None
        want[i, len(data), hashlib.sha256(data).hexdigest(), "revisit" if to else "response", to] += 1
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in out) == want
    assert all(bytes(r.payload).decode() == next(h or "" for i, u, h in rows if i == r.page_id) for r in out if r.payload is not None)
    assert warc.archive(spark.createDataFrame([], PAGES)).count() == 0


class File(io.BytesIO):
    def size(self):
        return len(self.getvalue())

    def read_at(self, n, at):
        return self.getvalue()[at : at + n]


@pytest.mark.parametrize("width", [1, 37, 500, 10_000])
def test_warc_ranges_own_each_record_once(width):
    rnd = random.Random(width)
    bodies = [rnd.randbytes(rnd.randint(0, 700)) + warc.MAGIC * rnd.randint(0, 3) for _ in range(25)]
    data = b"".join(warc.member("response", k, "u", b, hashlib.sha256(b).hexdigest(), len(b), None) for k, b in enumerate(bodies))
    found = [body for start in range(0, len(data), width) for _, body in warc.records_in(File(data), start, min(len(data), start + width))]
    assert found == bodies


def test_warc_passes_over_nothing():
    made = [warc.member("response", k, "u", b"body" * 50, "0", 200, None) for k in range(4)]
    read = lambda data, a=0: [b for _, b in warc.records_in(File(data), a, len(data))]
    assert len(read(b"".join(made))) == 4
    for bad in (b"".join(made)[:-3], made[0] + b"junk" + made[1], made[0] + made[1][:40] + made[2], b"".join(made) + b"\0"):
        with pytest.raises(ValueError):
            read(bad)


@pytest.mark.parametrize("width", [1000, 70_000, 1 << 23])
def test_warc_headers_of_any_length(width):
    rnd = random.Random(width)
    urls = ["u", "a" * 65_400, "b" * 65_600, "c" * 3_000_000, rnd.randbytes(1_000_000).hex(), "v"]
    made = [warc.member("revisit" if k == 2 else "response", k, u, b"body" * k, "0", 4 * k, 1 if k == 2 else None) for k, u in enumerate(urls)]
    data = b"".join(made)
    found = [(head["warc-target-uri"], body) for start in range(0, len(data), width) for head, body in warc.records_in(File(data), start, min(len(data), start + width))]
    assert found == [(u, b"" if k == 2 else b"body" * k) for k, u in enumerate(urls)]


def test_least_common_grams_against_all_lengths():
    for similarity in (0.3, 0.55, 0.6, 0.7, 0.8, 0.9):
        size = near_dup.gram_size(similarity)
        for n in range(1, 120):
            plain = min(m + size - 1 - size * int(m * (1 - similarity) + 1e-9) for m in range(n, int(n / similarity) + 2))
            assert near_dup.least_common(n, similarity)[0] <= max(plain, 1)
            assert 1 <= near_dup.needed(n, similarity)[()].min() <= near_dup.least_common(n, similarity)[0]


def test_members_of_a_cluster_meet_by_bags(spark, monkeypatch):
    monkeypatch.setattr(near_dup, "BLOCK", 8)  # several parts
    rng = np.random.default_rng(5)
    base, rows = [f"w{k}" for k in range(60)], []
    for i in range(40):
        words = list(base)
        for k in rng.choice(60, int(rng.integers(0, 12)), replace=False):
            words[k] = f"x{rng.integers(10**9)}"
        rows.append((i, " ".join(words)))
    made = near_dup.sketched(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text", 1, 1)
    members = made.selectExpr("id AS node", "n_words", "bag", "id % 5 AS root", "7L AS cluster")
    got = [(r.a, r.b) for r in near_dup.inside(members, 0.8).collect()]
    h = [np.array([near_dup.word_hash(w) for w in t.split()], np.uint64) for _, t in rows]
    linked = {(i, j) for j in range(40) for i in range(j) if i % 5 != j % 5 and near_dup.edit_within(h[i], h[j], 12)}
    assert linked <= set(got) and len(got) == len(set(got)) and all(i < j and i % 5 != j % 5 for i, j in got)


def test_pairs_leave_a_bucket_with_their_part_of_the_grams_only(spark, monkeypatch):
    monkeypatch.setattr(near_dup, "HELD", 50)  # a few texts at a time
    rnd, buckets, rows = random.Random(4), 4, []
    passage = [f"p{k}" for k in range(12)]
    for i in range(60):
        base = rows[-1][1] if i % 3 else [f"w{rnd.randint(0, 10**6)}" for _ in range(100)] + passage
        rows.append((i, [f"x{rnd.randint(0, 10**6)}" if k < 100 and i % 3 and rnd.random() < 0.08 else w for k, w in enumerate(base)]))
    hashed = [np.array([near_dup.word_hash(w) for w in words], np.uint64) for _, words in rows]
    none = near_dup.levels(np.zeros(0, np.uint64), np.zeros(0, np.int64))
    first = [near_dup.first_grams(h, 0.8, None, none) for h in hashed]
    tag = lambda i: i - i % 2  # noqa: E731  texts of one tag are not taken for each other
    made = [(tag(i), near_dup.in_buckets(first[i - i % 2][0], buckets)) for i in range(60)] * 2
    texts = spark.createDataFrame([(tag(i), i, len(rows[i][1]), i % 7) for i in range(60)], "tag long, node long, n_words long, root long")
    posted = near_dup.postings(spark.createDataFrame(made, "tag long, grams binary"), buckets).unionByName(near_dup.told(texts, buckets))
    got = [(r.a, r.b) for r in near_dup.meeting(posted, 0.8, buckets).collect()]

    def parts(i):
        x = first[i - i % 2][0] >> np.uint64(8)
        return [{int(v) for v in x if (int(v) >> 32) % buckets == b} for b in range(buckets)]

    own = [parts(i) for i in range(60)]
    need = {(i, j): -(-min(first[i][1], first[j][1]) // buckets) for j in range(60) for i in range(j)}
    plain = {(i, j) for (i, j), n in need.items() if i % 7 != j % 7 and any(len(p & q) >= n for p, q in zip(own[i], own[j]))}
    assert sorted(got) == sorted(plain) and 40 < len(got) < 300  # the passage alone brings no two together
    links = {(i, j) for j in range(0, 60, 2) for i in range(0, j, 2) if i % 7 != j % 7 and near_dup.edit_within(hashed[i], hashed[j], int(112 * 0.2 + 1e-9))}
    assert links and links <= plain


def test_texts_to_align_are_looked_up_either_way(spark, monkeypatch):
    base = [f"w{k}" for k in range(40)]
    docs = spark.createDataFrame([(i, " ".join(base[: 40 - i])) for i in range(4)] + [(9, "another text of no more than nine words")], "doc_id long, text string")
    out = []
    for most in (near_dup.CARRIED, 0):
        monkeypatch.setattr(near_dup, "CARRIED", most)
        out.append({r.doc_id: r.class_id for r in near_dup.near_duplicates(docs).collect()})
    assert out[0] == out[1] == {0: 0, 1: 0, 2: 0, 3: 0, 9: 9}


def test_texts_just_too_far_apart_make_no_rows_of_pairs(spark, monkeypatch):
    """Equal bags in different orders: bags leave every two open, and no alignment links them."""
    rng, front = np.random.default_rng(3), [f"f{k}" for k in range(12)]
    texts = [" ".join(front + [f"w{k}" for k in rng.permutation(40)]) for _ in range(60)]
    texts.append(texts[7].replace("f3", "g3"))  # linked to one of them
    rows = []
    monkeypatch.setattr(near_dup, "staged", lambda df, label, staged=near_dup.staged: rows.append((label, (out := staged(df, label)).count())) or out)
    found = {r.doc_id: r.class_id for r in near_dup.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert found == {i: i for i in range(60)} | {60: 7}
    assert max(n for label, n in rows) < 60 * 59 // 4, rows


def test_pairs_go_on_only_if_their_buckets_can_hold_all_they_need(spark):
    rnd, buckets, rows = random.Random(6), 4, []
    for i in range(40):
        base = [w for w in rows[-1]] if i % 4 else [f"w{rnd.randint(0, 10**6)}" for _ in range(90)]
        rows.append([f"x{rnd.randint(0, 10**6)}" if rnd.random() < (0.02, 0.08, 0.5)[i % 3] else w for w in base])
    hashed = [np.array([near_dup.word_hash(w) for w in words], np.uint64) for words in rows]
    none = near_dup.levels(np.zeros(0, np.uint64), np.zeros(0, np.int64))
    first = [near_dup.first_grams(h, 0.8, None, none) for h in hashed]
    made = spark.createDataFrame([(i, near_dup.in_buckets(first[i][0], buckets), len(rows[i]), i) for i in range(40)], "tag long, grams binary, n_words long, root long")
    of_all = near_dup.postings(made.select("tag", "grams"), buckets).unionByName(near_dup.told(made.selectExpr("tag", "tag AS node", "n_words", "root"), buckets))
    brought = near_dup.postings(made, buckets)  # a bucket is told of the texts that are in it only
    met, own = ({(r.a, r.b) for r in near_dup.meeting(x, 0.8, buckets).collect()} for x in (of_all, brought))
    kept = [{(r.a, r.b) for r in near_dup.enough(near_dup.shared(x, 0.8, buckets), buckets).collect()} for x in (of_all, brought)]
    grams = [{int(v) >> 8 for v in f} for f, _ in first]
    whole = {(i, j) for j in range(40) for i in range(j) if len(grams[i] & grams[j]) >= min(first[i][1], first[j][1])}
    linked = {(i, j) for j in range(40) for i in range(j) if near_dup.edit_within(hashed[i], hashed[j], 18)}
    assert met == own and kept[0] == kept[1] and linked and linked <= whole <= kept[0] < met


def test_texts_are_looked_up_by_bits(spark):
    rows = spark.range(3000).selectExpr("id", "unhex(sha2(cast(id AS string), 256)) AS digest")
    needed = rows.filter("id % 7 = 0").select("digest")
    got = {r.id for r in near_dup.among(rows, needed, needed.count()).collect()}
    assert {i for i in range(0, 3000, 7)} <= got and len(got) < 429 + 2571 // 8  # one of 16 others, about
