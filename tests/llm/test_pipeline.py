import random
import re

import corpus_pipeline
import pytest

from fieldstream.llm.packing import pack
from fieldstream.llm.quality_rules import judge


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("aeiourstlnmd") for _ in range(rng.randint(2, 8)))
    rows = []
    for i in range(30):
        body = [word() for _ in range(150)]
        text = " ".join(body)
        rows.append((10 * i, text))
        if i % 3 == 0:
            rows.append((10 * i + 1, text.replace(" ", "  ")))
        if i % 4 == 0:
            rows.append((10 * i + 2, " ".join([*body[:70], word(), *body[71:]])))
        if i % 5 == 0:
            rows.append((10 * i + 3, " ".join(word() for _ in range(60)) + f". Mail p{i}@mail.example.com now"))
    rows += [(1001, None), (1002, ""), (1003, "same word " * 50), (1004, "too short")]
    rng.shuffle(rows)
    return spark.createDataFrame([(d, t, "en", "s", len(t or "")) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")


def shingles(text):
    w = text.lower().split()
    return set(zip(*(w[i:] for i in range(5)), strict=False))


def brute(rows):
    kept = sorted((d, t) for d, t in rows if judge(t or "")[6])
    first = {}
    for d, t in kept:
        first.setdefault(" ".join(t.split()), (d, t))
    left = sorted(first.values())
    out = []
    for d, t in left:
        if all(len(shingles(t) & shingles(x)) < 0.8 * len(shingles(t) | shingles(x)) for _, x in out):
            out.append((d, t))
    return {d: re.sub(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "[EMAIL]", t) for d, t in out}


def test_stages_equal_brute_force(spark, docs, tmp_path):
    want = brute([(r.doc_id, r.text) for r in docs.collect()])
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    now, columns = spark.read.parquet(f"{tmp_path}/documents.parquet"), docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        now = stage(spark, now, str(tmp_path))
        if name != "packing":
            assert now.columns == columns
            now.write.parquet(f"{tmp_path}/{k}")
            now = spark.read.parquet(f"{tmp_path}/{k}")
        if name == "pii":
            assert {r.doc_id: r.text for r in now.collect()} == want
            again = {r.doc_id for r in pack(now).collect()}
    assert {r.doc_id for r in now.collect()} == want.keys() == again
    whole = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted((r.doc_id, r.start, r.length, r.ids_crc32) for r in whole.collect())[0][0] == min(want)


def test_stages_without_rows(spark, docs):
    now = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        now = stage(spark, now, "")
    assert now.count() == 0
