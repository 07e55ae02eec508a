"""One table of odd rows through every operator and every stage that keeps columns.

It has null and empty texts, a very long one, rows that repeat, rows that share an
id, null ids, and further columns named like the operators' results and intermediate columns.
"""

from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from fieldstream.llm import exact_dedup, html_extract, packing, pii, quality_mil, quality_rules, secrets, sentence_pieces, simhash, toxicity

STORY = "The committee met on Tuesday to discuss the budget for next year, and several members asked for more detail about the cost of repairs before any vote could take place in public."
OTHER = "Rain fell on the harbour all night while the crew of the old ferry waited for a part that nobody in town could find, so breakfast was late and every passenger walked home along the wet road."
ROWS = [(1, STORY), (1, STORY), (2, None), (2, None), (3, ""), (4, " \n\t "), (5, OTHER), (5, "token=abcdef mail a@b.com"), (6, STORY + " Again."), (None, OTHER + " Then it stopped."), (None, None), (7, "long " * 60_000 + "tail")]
CLASHES = """start length ids_crc32 doc_tokens sequence_id offset found kind base votes bare keep_id group_size kept text_sha256 group_key stands wins score held_out predicted label quality toxic n_words reason script entropy
ids begins ends decoded fingerprint component_id id root vid own size fp sig hashes key count tile x u v n pop digest end value before after host path paths part salt url html""".split()
NAMED = [c for c in CLASHES if c not in ("url", "html")]


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame([(d, t, len(t or "")) for d, t in ROWS], "doc_id long, text string, n_chars long")
    return df.select("*", *(F.lit(c).alias(c) for c in CLASHES)).repartition(3).cache()


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(k, k % 2, k % 2, "x", "x") for k in range(8)], "doc_id long, quality int, toxic int, text string, score string")


def by_row(df, *drop):
    """How often each result row is there, as text."""
    return Counter(str(tuple(r.asDict(True).items())) for r in df.drop(*drop).collect())


EACH = {
    "secrets": lambda d, _: secrets.secrets(d),
    "pii": lambda d, _: pii.detect(d),
    "exact": lambda d, _: exact_dedup.exact_groups(d),
    "quality": quality_mil.classify,
    "rules": lambda d, _: quality_rules.measure(d),
    "pieces": lambda d, _: sentence_pieces.encode(d),
    "toxicity": toxicity.classify,
    "simhash": lambda d, _: simhash.fingerprints(d),
}


@pytest.mark.parametrize("name", EACH)
def test_one_row_for_each(docs, labels, name):
    run = EACH[name]
    got = run(docs, labels).collect()
    assert Counter(r.doc_id for r in got) == Counter(d for d, _ in ROWS)
    if name != "exact":  # which of two equal rows stays is not a function of the row
        for k in (1, 2):
            one, other = (r.asDict() for r in got if r.doc_id == k)
            assert abs(one.pop("score", 0) - other.pop("score", 0)) < 1e-6 and one == other
    assert run(docs.limit(0), labels).collect() == []
    # further columns change nothing
    drop = ("score",) if name in ("quality", "toxicity") else ()  # alike up to 1e-6
    assert by_row(run(docs.drop(*CLASHES), labels), *drop) == by_row(run(docs, labels), *drop)


def test_packing(docs):
    got = packing.pack(docs).collect()
    assert {r.doc_id for r in got} == {d for d, _ in ROWS}
    assert sum(r.length for r in got) == sum(r.doc_tokens for r in got if r.start == 0)
    assert sum(r.start == 0 for r in got) == len(ROWS) and max(r.length for r in got) <= 1024
    assert packing.pack(docs.limit(0)).count() == 0


def test_pages(spark, docs):
    rows = [(1, "http://a.example/1", f"<body><p>{STORY}</p></body>"), (1, "http://a.example/1", f"<body><p>{STORY}</p></body>"), (2, None, None), (3, "", ""), (None, "nonsense", "<p>x"), (4, "http://a.example/2", "<p>" + "long " * 100_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").select("*", *(F.lit(c).alias(c) for c in (*NAMED, "text", "n_chars")))
    for limit in (html_extract.BROADCAST_BYTES, -1):
        got = html_extract.extract(pages, limit).collect()
        assert Counter((r.page_id, r.url) for r in got) == Counter((p, u) for p, u, _ in rows)
        assert {(r.page_id, r.n_chars) for r in got} == {(1, len(STORY)), (2, 0), (3, 0), (None, 1), (4, 499_999)}
        assert html_extract.extract(pages.limit(0), limit).count() == 0


#: The ids that each stage leaves of ROWS.
LEFT = {
    "quality_rules": [1, 1, 5, 6, None],
    "exact_dedup": [1, 2, 4, 5, 5, 6, 7, None],
    # rows of one id stay or go together, and rows without id stay
    "simhash_near_dedup": [1, 1, 2, 2, 5, 5, 7, None, None],
    "pii": [d for d, _ in ROWS],
}


@pytest.mark.parametrize("name", LEFT)
def test_stages_keep_columns(spark, docs, name):
    stage = dict(corpus_pipeline.STAGES)[name]
    got = stage(spark, docs, "")
    assert got.columns == docs.columns and got.schema.simpleString() == docs.schema.simpleString()
    rows = got.collect()
    assert Counter(r.doc_id for r in rows) == Counter(LEFT[name])
    assert all(r[c] == c for r in rows for c in CLASHES)
    if name == "pii":
        assert {r.text for r in rows if r.doc_id == 5} == {OTHER, "token=abcdef mail [EMAIL]"}
        assert all(r.text is None for r in rows if r.doc_id == 2) and all(r.n_chars == len(r.text) for r in rows if r.text is not None)
    assert stage(spark, docs.limit(0), "").count() == 0
