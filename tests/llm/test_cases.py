"""The cases that every operator defines: nulls, empty and very long texts, repeated rows, clashing columns, empty tables; and whole tables by brute force."""

import base64
import hashlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from attestry.llm import hamming_search, html_extract, language_id, minhash_dedup, mixing, quality_rules, sentence_pieces, shared, substring_dedup, token_files
from attestry.llm import queries as llm_queries

CLASH = ["word", "words", "ids", "part", "chunk", "start", "n", "node", "band", "key", "cell", "size", "bound", "q", "code", "place", "h", "alone", "lettered", "score", "text_hash", "_x", "length", "file"]
LONG = " ".join(f"w{i % 5003}x{i % 977}" for i in range(150_000))


def clashing(df):
    return df.select("*", *[F.lit("clash").alias(c) for c in CLASH if c not in df.columns])


@pytest.fixture(scope="module")
def rows(spark):
    texts = [(1, "one two three four five six"), (1, "one two three four five six"), (1, "another text of id one"), (2, None), (3, ""), (None, "no id here at all"), (None, "no id here at all"), (4, LONG), (5, " \n\t "), (6, "x" * 30_000)]
    made = [(d, t, "en" if d != 5 else None, "web" if d != 3 else None, len(t or "")) for d, t in texts]
    return clashing(spark.createDataFrame(made, "doc_id long, text string, lang string, source string, n_chars long"))


def test_op1_over_all_pages(spark, sf_dir):
    pages = [(r.page_id, (r.html or "").encode()) for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()]
    top = defaultdict(int)
    for k, data in pages:
        top[data] = max(top[data], k)
    want = Counter((k, len(d), base64.b32encode(hashlib.sha1(d).digest()).decode(), "response" if k == top[d] else "revisit", None if k == top[d] else top[d]) for k, d in pages)
    found = llm_queries.QUERIES["op1_warc"](spark, sf_dir).collect()
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in found) == want


def test_op2(rows, spark):
    labels = spark.createDataFrame([(1, 1), (1, 0), (None, 1), (4, None)], "doc_id long, quality int")
    found = quality_rules.judge(rows, labels).collect()
    assert Counter((r.doc_id, r.n_words) for r in found)[(4, 150_000)] == 1 and len(found) == 10
    assert quality_rules.judge(rows.where("false"), labels.where("false")).count() == 0


def test_op3(rows):
    table = sentence_pieces.load(public_tokenizers.path("piece_bpe_32k.model"))
    found = sentence_pieces.encode(rows, table, decoded=True).collect()
    assert Counter((r.doc_id, r.text) for r in found) == Counter((r.doc_id, r.text or "") for r in rows.collect())
    assert {len(r.ids) for r in found if not r.text} == {0}


def test_op4(rows, spark):
    train = clashing(spark.createDataFrame([(k, f"the cat and the dog number {k}", "en") for k in range(40)] + [(99, "der hund und die katze", "de")], "doc_id long, text string, lang string"))
    model = language_id.fit(train)
    found = Counter((r.doc_id, r.lang_pred == "und") for r in language_id.predict(rows, model).collect())
    assert found == Counter({(1, False): 3, (2, True): 1, (3, True): 1, (None, False): 2, (4, False): 1, (5, True): 1, (6, False): 1})
    many = spark.createDataFrame([(k, "a b", f"l{k}") for k in range(5)], "doc_id long, text string, lang string")
    with pytest.raises(ValueError, match="languages"):
        language_id.fit(many, languages=4)


def test_op5(spark):
    base = clashing(spark.createDataFrame([(1, 5), (1, 5), (2, 5), (None, 5), (3, None), (4, -1)], "id long, code long"))
    found = {(r.query_id, r["rank"]): (r.neighbor_id, r.distance) for r in hamming_search.search(base, base.where("id = 1"), k=3).collect()}
    assert found == {(1, 1): (2, 0), (1, 2): (4, 62)}


def test_op6(rows):
    found = mixing.mix(rows).collect()
    assert len(found) == 10 and Counter(r["size"] for r in found)[150_000] == 1
    assert all(r.taken <= 2 * r["size"] for r in found)


def test_op7_and_op10(rows):
    found = Counter((r.doc_id, r.component_id, r.kept) for r in minhash_dedup.near_duplicates(rows).collect())
    assert found[(1, 1, True)] == 3 and found[(None, None, True)] == 2 and found[(4, 4, True)] == 1 and sum(found.values()) == 10
    twice = rows.union(rows.where("doc_id = 4").withColumn("doc_id", F.lit(40).cast("long")))
    gone = {(r.doc_id, r.n_removed) for r in substring_dedup.remove_repeats(twice, carry=("lang",)).collect()}
    assert {(4, 150_000), (40, 150_000), (6, 0), (2, 0)} <= gone


def test_op8(spark):
    pages = clashing(spark.createDataFrame([(1, "u", "<article><p>" + "long words. " * 100_000 + "</p></article>"), (1, "u", "<article><p>Short.</p></article>"), (None, None, None), (2, "u", "")], "page_id long, url string, html string"))
    net = html_extract.fit(pages)
    found = html_extract.extract(pages, net).collect()
    assert Counter(r.page_id for r in found) == Counter({1: 2, None: 1, 2: 1}) and {len(r.text) for r in found if r.page_id != 1} == {0}
    assert html_extract.extract(pages, html_extract.fit(pages.where("false"))).count() == 4


def test_op9(rows, spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    from tokenizers import Tokenizer

    known = Tokenizer.from_file(path)
    folder = shared.shared_dir(spark)
    token_files.write_files(token_files.encode(rows, path), folder)
    found = sorted(token_files.read_files(spark, folder).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in found] == [None, None, 1, 1, 1, 2, 3, 4, 5, 6]
    own = Counter((r.doc_id, np.array([*known.encode(r.text or "", add_special_tokens=False).ids, 2], "<u4").tobytes()) for r in rows.collect())
    assert Counter((r.doc_id, bytes(r.ids)) for r in found) == own
    assert [r.start for r in found] == [0, *np.cumsum([r.n_tokens for r in found])[:-1].tolist()]


def test_pipeline(rows, spark, tmp_path):
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    long_rows = clashing(rows.unionByName(rows.where("doc_id = 4").withColumn("text", F.concat("text", F.lit(" and an end of its own")))))
    docs = long_rows
    for name, stage in corpus_pipeline.STAGES:
        docs = shared.written(stage(spark, docs, str(tmp_path)))
        if name == "quality rules":
            assert {r.doc_id for r in docs.select("doc_id").collect()} == {4} and docs.columns == list(corpus_pipeline.COLUMNS)
        if name == "near duplicates":
            assert docs.count() == 2, "rows of one doc_id with different texts are its own document each"
    assert docs.count() >= 1
