"""Whitening and product codes against plain numpy and integer versions; license scans against a plain per-text version."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from attestry.llm import hamming_search, language_id, licenses, vector_codes, whitening
from attestry.llm import queries as llm_queries

SCHEMA = "vec_id long, embedding array<float>, label int, x int, i string, n long, row long, part string"


def table(spark, rows, schema=SCHEMA):
    return spark.createDataFrame([(*r, 1, "clash", 2, 3, "clash")[: schema.count(",") + 1] for r in rows], schema)


def plain_whitening(vectors, count=16):
    """x, n, deviations, eigenvalues and eigenvectors by the whole covariance matrix."""
    x = np.array([[math.floor(64 * float(c)) + 1_000_000 for c in v] for v in vectors])
    fit = np.array(sorted({tuple(r) for r in x.tolist()}))
    n, sums = len(fit), fit.sum(axis=0)
    centred = (n * fit - sums) / n
    cov = centred.T @ centred / n
    values, q = np.linalg.eigh(cov)
    return x, n, ((n * x - sums) ** 2).sum(axis=1), values[::-1][:count], q[:, ::-1][:, :count], (n * x - sums) / n, np.trace(cov)


def compare_whitening(found, ids, vectors, apart=1e-9):
    x, n, deviation, values, q, centred, trace = plain_whitening(vectors)
    own = values > 1e-12 * values[0]
    values, q = values[own], q[:, own]
    want = centred @ q / np.sqrt(values)
    assert len(found) == len(ids) * len(values)
    rows = defaultdict(list)
    for r in found:
        rows[r.vec_id].append(r)
    got = np.zeros_like(want)
    for k, i in enumerate(ids):
        for r in rows[i]:
            assert (r.n, r.deviation) == (n, deviation[k])
            assert abs(r.explained * trace / values[r.component - 1] - 1) < 1e-6 and r.identity_error < 1e-6
            got[k, r.component - 1] = r.whitened
    signs = np.sign((got * want).sum(axis=0))
    assert np.abs(got * signs - want).max() < apart
    assert len({r.identity_error for r in found}) == 1


def test_whitening_of_all_rows(spark, sf_dir):
    kept = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    found = llm_queries.QUERIES["op11_whitening"](spark, sf_dir).collect()
    compare_whitening(found, [i for i, _ in kept], [v for _, v in kept])


def test_whitening_of_batches_larger_than_a_matrix(spark, monkeypatch):
    """Arrow batches that are taken in several slices keep all their rows; some vectors need 64 bits an entry."""
    monkeypatch.setattr(whitening, "MOST_BYTES", 8 * 20 * 100)
    rng = np.random.default_rng(5)
    vectors = rng.standard_normal((1500, 20)) * np.where(np.arange(1500) % 7 == 0, 600, 1)[:, None]
    rows = [(k, [float(np.float32(c)) for c in v], 0) for k, v in enumerate(vectors)]
    found = whitening.whiten(table(spark, rows).coalesce(1)).collect()
    compare_whitening(found, range(1500), [r[1] for r in rows])


def test_whitening_cases(spark):
    rng = np.random.default_rng(5)
    good = [(k, [float(c) for c in rng.standard_normal(24) * 3], k % 3) for k in range(60)]
    good += [(100 + k, good[k][1], None) for k in range(40)]  # copies: rows of the result, one vector of the fit list
    bad = [(1, None, 1), (2, [None] + [0.0] * 23, 1), (3, [float("nan")] * 24, 1), (4, [float("inf")] * 24, 1), (5, [], 1), (6, [1.0] * 7, 1), (7, [1e30] * 24, 1)]
    found = whitening.whiten(table(spark, good + bad)).collect()
    compare_whitening(found, [r[0] for r in good], [r[1] for r in good])
    assert {r.vec_id for r in whitening.whiten(table(spark, [(None, good[0][1], 0), *good])).collect()} >= {None}
    few = [(k, [float((k * j) % 5) for j in range(20)], 0) for k in range(4)]
    compare_whitening(whitening.whiten(table(spark, few)).collect(), range(4), [r[1] for r in few])
    for none in (bad[:5], [], [(k, [1.0, 2.0], 0) for k in range(5)]):
        found = whitening.whiten(table(spark, none))
        assert found.count() == 0 and found.columns == [c.split()[0] for c in whitening.SCHEMA.split(", ")]
    large = [(k, [2.0**40 * (k - 1), 1.0], 0) for k in range(3)]
    assert {r.deviation for r in whitening.whiten(table(spark, large)).collect() if r.vec_id != 1} == {None}


def test_chebyshev_components_of_close_eigenvalues():
    rng = np.random.default_rng(1)
    q = np.linalg.qr(rng.standard_normal((300, 300)))[0]
    values = np.sort(np.concatenate([[900.0, 40.0, 40.0], 2 + 0.1 * np.arange(20), 1 + 0.001 * np.arange(277)]))[::-1]
    matrix = q * values @ q.T
    passes = [0]

    def times(x):
        passes[0] += 1
        return matrix @ x

    e, u = whitening.components(times, 300)
    assert np.abs(e / values[:16] - 1).max() < 1e-12
    assert np.abs(matrix @ u - u * e).max() < 1e-9 and np.abs(u.T @ u - np.eye(16)).max() < 1e-12
    assert passes[0] < 250


def plain_codes(rows, rounds=2):
    """rows: (vec_id, vector, label) that count. Code, error and label error by row, and the codebooks' text."""
    rows = [(i, [math.floor(256 * float(c)) for c in v], label) for i, v, label in rows]
    width = len(rows[0][1]) // 16
    part = lambda v, p: v[p * width : (p + 1) * width]
    first = sorted(rows, key=lambda r: (r[0] is None, r[0]))[:64]
    books = [[part(v, p) for _, v, _ in first] for p in range(16)]
    away = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    assign = lambda: [[min((away(part(v, p), e), k) for k, e in enumerate(books[p])) for p in range(16)] for _, v, _ in rows]
    for _ in range(rounds):
        found = assign()
        for p in range(16):
            for k in range(len(books[p])):
                own = [part(v, p) for (_, v, _), a in zip(rows, found, strict=True) if a[p][1] == k]
                if own:
                    books[p][k] = [sum(c) // len(own) for c in zip(*own, strict=True)]
    last = assign()
    errors = [sum(d for d, _ in a) for a in last]
    labels = Counter()
    for (_, _, label), e in zip(rows, errors, strict=True):
        labels[label] += e
    text = ",".join(str(c) for book in books for e in book for c in e)
    digest = hashlib.sha256(text.encode()).hexdigest()
    return Counter((i, "".join(f"{k:02x}" for _, k in a), e, labels[label], digest) for (i, _, label), a, e in zip(rows, last, errors, strict=True))


@pytest.mark.parametrize("case", ["random", "few", "hot", "large", "three"])
def test_codes_against_a_plain_version(spark, case):
    rng = random.Random(case)
    draw = lambda: [rng.uniform(-3, 3) for _ in range(32)]
    rows = [(k, draw(), k % 4 or None) for k in range({"few": 9}.get(case, 150))]
    if case == "hot":
        rows += [(1000 + k, rows[3][1], 7) for k in range(200)]
    if case == "large":
        rows = [(k, [x * 1e5 for x in v], label) for k, v, label in rows]
    rows = [(i, [float(np.float32(x)) for x in v], label) for i, v, label in rows]
    bad = [(1, None, 1), (2, [None] * 32, 1), (3, [float("nan")] * 32, 1), (4, [], 1), (5, [1.0] * 16, None), (6, [1.0] * 15, 2)]
    rounds = 3 if case == "three" else 2
    coded, books = vector_codes.encode(table(spark, rows + bad), rounds)
    found = vector_codes.label_errors(coded).collect()
    digest = hashlib.sha256(vector_codes.books_text(books).encode()).hexdigest()
    assert Counter((r.vec_id, r.code, r.error, r.label_error, digest) for r in found) == plain_codes(rows, rounds)


def test_codes_without_rows(spark):
    for rows in ([], [(1, None, 1), (2, [], None)], [(1, [float("nan")] * 16, 1)]):
        coded, _ = vector_codes.encode(table(spark, rows))
        assert vector_codes.label_errors(coded).count() == 0


def plain_licenses(docs, templates=licenses.TEMPLATES):
    """By the docstring: every start of every template tried in turn."""
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    texts = [re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(low)) for _, t in docs]
    known = {w for _, text, _ in templates for w in text.split()}
    df = Counter(w for words in texts for w in set(words) & known)
    weight = {w: max(1, math.floor(1000 * math.log((len(docs) + 1) / (df[w] + 1)) + 0.5)) for w in known if df[w]}
    out = []
    for (doc, _), words in zip(docs, texts, strict=True):
        at = defaultdict(set)
        for p, w in enumerate(words):
            at[w].add(p)
        stands = lambda p, phrase, words=words: words[p : p + len(phrase)] == phrase
        base = [(p, label) for phrase, label in licenses.BASE.items() for p in range(len(words)) if stands(p, phrase.split())]
        labels, score = {x for _, x in base}, 0.0
        for label, text, phrases in templates:
            own = text.split()
            ranked = sorted(set(own) & set(weight), key=lambda w: (-weight[w], w))
            kept = set(ranked[: min(licenses.RARE, -(-len(ranked) // 2))])
            places = [(q, w) for q, w in enumerate(own) if w in kept]
            starts = {p - q for q, w in places for p in at[w]}
            for cell in {s // 8 - k for s in starts for k in (0, 1)}:
                inside = lambda q, ps, cell=cell: any(8 * cell <= p - q < 8 * cell + 16 for p in ps)
                met = sum(weight[w] for q, w in places if inside(q, at[w]))
                there = all(inside(next(q for q in range(len(own)) if own[q : q + len(f.split())] == f.split()), [p for p in at[f.split()[0]] if stands(p, f.split())]) for f in phrases)
                whole = sum(weight[w] for _, w in places)
                if places and there and met * 100 >= whole * licenses.SHARE_PERCENT:
                    labels.add(label)
                    score = max(score, met / whole)
        starts = [p for p, _ in base]
        out.append((doc, len(words), len(base), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in base})), ",".join(sorted(labels)), score))
    return Counter(out)


def license_rows(df):
    return Counter(tuple(r[c] for c in ("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")) for r in df.collect())


def test_licenses_of_all_documents(spark, sf_dir):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    found = license_rows(llm_queries.QUERIES["op13_license_scan"](spark, sf_dir))
    assert found == plain_licenses(docs)
    lines = {"Released under the MIT License.": "mit", "Licensed under the Apache License, Version 2.0.": "apache-2.0", "the GNU General Public License, version 3.": "gpl-3.0", "Licensed under CC BY-NC 4.0.": "cc-by-nc", "All rights reserved.": "reserved"}
    labels = {r[0]: set(r[6].split(",")) for r in found}
    held = [(d, label) for d, t in docs for line, label in lines.items() if line in (t or "")]
    assert held and all(label in labels[d] for d, label in held)
    assert all(not labels[d] - {""} for d, t in docs if not any(line in (t or "") for line in lines))


def test_license_cases(spark):
    mit = licenses.TEMPLATES[2][1]
    cut = " ".join(w for k, w in enumerate(mit.split()) if k % 9 != 5 or k < 10 or 18 < k < 28)
    docs = [
        (1, None), (2, ""), (3, " ... \n"), (None, "CC-BY, cc by; CC/BY"), (4, "All Rights\nReserved all rights RESERVED all rights"), (5, mit.upper()), (5, mit.upper()), (6, f"{mit} {mit}"),
        (7, "filler words here " * 40 + cut + " and more " * 40), (8, "the mit license is spoken of, version 2 0, and nothing is granted"), (9, "apache license " * 3 + "version 2 0"),
        (10, "License version 3 public general"), (11, "Überall ÄÖÜ general public license 3 version"), (12, "cc by cc by cc by nc 4.0"), (13, "Licensed under the MIT License. Licensed under the Apache License, Version 2.0. All rights reserved."),
        (14, "w " * 100_000 + "released under the mit license " + "x " * 50_000), (15, "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License"),
        (16, "İ I K all rights reserved"), (17, "x" * 30_000),
    ]
    rows = spark.createDataFrame([(d, t, "clash", 1) for d, t in docs], "doc_id long, text string, words string, p int")
    found = license_rows(licenses.scan(rows))
    assert found == plain_licenses(docs)
    labels = {r[0]: r[6] for r in found}
    assert labels[5] == labels[6] == labels[7] == labels[14] == "mit" and labels[8] == labels[10] == ""
    assert labels[13] == "apache-2.0,mit,reserved" and labels[15] == "gpl,gpl-3.0"
    assert licenses.scan(rows.where("false")).count() == 0


def test_license_plan_stays_in_the_jvm(spark, sf_dir):
    plan = llm_queries.QUERIES["op13_license_scan"](spark, sf_dir)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "CartesianProduct" not in plan


def test_most_queries_end_in_the_rounds(spark):
    """On the largest table: the share of queries that multi-index rounds answer, and all answers by brute force."""
    rows = [(r.vec_id, r.code) for r in spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select("vec_id", hamming_search.sign_code("embedding").alias("code")).collect()]
    base = spark.createDataFrame(rows, "id long, code long")
    found = hamming_search.search(base, base.where("id % 50 = 0")).collect()
    want = {}
    for q, code in rows:
        if q % 50 == 0:
            near = sorted((bin((code ^ c) & (2**64 - 1)).count("1"), i) for i, c in rows if i != q)[:10]
            want |= {(q, k + 1): (i, d) for k, (d, i) in enumerate(near)}
    assert {(r.query_id, r["rank"]): (r.neighbor_id, r.distance) for r in found} == want
    ways = {r.query_id: r.way for r in found}
    share = sum(w == "rounds" for w in ways.values()) / len(ways)
    print(f"answered by rounds: {share:.2f}")
    assert share > 0.9


def plain_grams(text):
    """Counts of hashed 3-byte grams, by the docstring of language_id."""
    raw = [b if b >= 128 or 97 <= b <= 122 else 32 for b in text.lower().encode()]
    raw = [32, *raw, 32]
    counts = Counter()
    for k in range(len(raw) - 2):
        if raw[k : k + 3] != [32, 32, 32]:
            counts[((raw[k] | raw[k + 1] << 8 | raw[k + 2] << 16) * 2654435761 % 2**32) >> 20] += 1
    return counts


def test_languages_by_a_plain_version(spark, sf_dir):
    """Frequencies over all training documents, and every document's nearest centroid, counted gram by gram."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", language_id.held_out(F.col("doc_id")).alias("held"))
    rows = docs.collect()
    names, floors, centroids, idf = language_id.fit(docs.where("not held"))
    train = [plain_grams(r.text) for r in rows if not r.held and r.text is not None and r.lang is not None]
    df = Counter(d for g in train for d in g)
    want = np.array([math.log((len(train) + 1) / (df[d] + 1)) + 1 for d in range(language_id.DIMS)])
    assert np.abs(idf - want).max() < 1e-5
    assert np.abs(np.linalg.norm(centroids, axis=1) - 1).max() < 1e-5 and set(names) == {r.lang for r in rows if not r.held and r.lang}
    found = {r.doc_id: r for r in llm_queries.QUERIES["op4_language_id"](spark, sf_dir).collect()}
    assert len(found) == len(rows)
    right = 0
    for r in rows:
        own = found[r.doc_id]
        if not any(c.isalpha() for c in r.text or ""):
            assert (own.lang_pred, own.score) == ("und", 0.0)
            continue
        v = np.zeros(language_id.DIMS)
        for d, n in plain_grams(r.text).items():
            v[d] = math.log1p(n) * want[d]
        near = centroids @ (v / max(np.linalg.norm(v), 1e-12))
        best = near.max()
        assert abs(own.score - min(1, max(0, best))) < 1e-4 and near[names == own.lang_pred].max() > best - 1e-4
        right += r.held and own.lang_pred == r.lang
    assert right >= 0.95 * sum(r.held and r.lang is not None and any(c.isalpha() for c in r.text or "") for r in rows)
