"""The pipeline's stages on odd rows, and the whole of it against plain Python."""

import hashlib
import random
from collections import Counter

import duckdb
import numpy as np
import pytest
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from strandlog.llm import bpe, langid, queries
from strandlog.llm.oracle import ORACLE
from tests.llm.test_set_operators import edited, every_link
from tests.llm.test_text_operators import plain_dedup

CLASHING = ["copies", "digest", "taken_id", "words_left", "words_removed", "lines_removed", "_digest", "lang_pred", "score", "first_id", "node", "id", "c0"]


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_stages_take_any_rows(spark, odd_docs, name, stage):
    docs = odd_docs.select("doc_id", "text", "lang", "source", "n_chars", *[F.lit(f"own {c}").alias(c) for c in CLASHING])
    out = stage(spark, docs, "")
    rows = out.collect()
    assert rows or name == "language_id"
    if name != "byte_bpe":
        assert out.columns == docs.columns
        assert all(r[c] == f"own {c}" for r in rows for c in CLASHING)
        assert dict(out.dtypes) == dict(docs.dtypes)
    assert stage(spark, docs.limit(0), "").count() == 0


def plain_stages(docs, con, tmp_path):
    """The rows of the pipeline: every stage by plain means."""
    train = {}
    for i, text, lang, *_ in docs:
        if lang and text and i is not None and _crc(i) % 5:
            train.setdefault(lang, []).append(text)
    langs = sorted(train)
    table = langid.Scorer(langid.Model(langs, *zip(*(langid._grams(train[x]) for x in langs))))
    kept = []
    for d in docs:
        if d[1] and any(map(str.isalpha, d[1])):
            bits = table.bits([d[1].encode()])[0]
            if 1 / np.exp2(-np.minimum(bits - bits.min(), 1000)).sum() >= 0.5:
                kept.append(d)
    texts = plain_dedup([(d[0], d[1]) for d in kept])
    kept = [(d[0], t, *d[2:]) for d, t in zip(kept, texts) if t == d[1] or len(t.split()) > 0.2 * len(d[1].split())]
    links = every_link([d[1].split() for d in kept])
    root = list(range(len(kept)))
    for _ in range(5):
        for i, j in links:
            root[i] = root[j] = min(root[i], root[j])
    kept = [d for k, d in enumerate(kept) if root[k] == k]
    import pandas as pd

    pd.DataFrame(kept, columns=["doc_id", "text", "lang", "source", "n_chars"]).to_parquet(tmp_path / "kept.parquet")
    con.sql(f"create or replace view documents as select * from '{tmp_path}/kept.parquet'")
    copies = {r[0]: r[1] for r in con.sql("select doc_id, case when size = 0 then 0 else taken // size end from (" + ORACLE["op8_mix_sources"] + ")").fetchall()}
    return [d for d in kept for _ in range(copies[d[0]])]


def _crc(i):
    from zlib import crc32

    return crc32(str(i).encode())


def test_pipeline_equals_plain(spark, tmp_path):
    rnd = random.Random(31)
    words = {"en": [f"the{k}ing" for k in range(400)], "de": [f"und{k}ung" for k in range(400)]}
    docs, passage = [], "\n".join(" ".join(f"passage{k}word{j}" for j in range(9)) for k in range(7))
    for i in range(150):
        lang = "de" if i % 3 == 0 else "en"
        lines = [" ".join(rnd.choice(words[lang]) for _ in range(9)) for _ in range(rnd.randint(6, 14))]
        if i % 10 == 5:
            lines.insert(3, passage)
        if i % 7 == 6:
            text = " ".join(edited(rnd, docs[i - 1][1].split(), 3))
        elif i % 11 == 10:
            text = docs[i - 3][1]
        else:
            text = "\n".join(lines)
        docs.append((i, text, lang, "abc"[i % 7 % 3], len(text)))
    docs += [(150, None, "en", "a", None), (151, "", None, None, 0), (152, "12 34", None, "b", 5)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    got = Counter(tuple(r) for r in corpus_pipeline.run(spark, str(tmp_path)).collect())
    path, pattern = queries.tokenizer_files()
    library = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=bpe.tokenizer(path, pattern).ranks, special_tokens={})
    want = Counter()
    for i, text, *_ in plain_stages(docs, duckdb.connect(), tmp_path):
        ids = library.encode_ordinary(text)
        want[i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()] += 1
    assert got == want and len(want) > 60


def test_near_stage_joins_texts_without_a_shared_run(spark):
    """Every fifth word differs, so the texts are within the threshold but have no run of five words, and no sketch key, in common."""
    words = [f"w{k}" for k in range(60)]
    other = [f"x{k}" if k % 5 == 4 else w for k, w in enumerate(words)]
    docs = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(other)), (3, "some other text")], "doc_id long, text string")
    assert {r.doc_id for r in corpus_pipeline.dedup_near(spark, docs, "").collect()} == {1, 3}
