"""Registered queries over whole driver tables against brute force."""

import collections
import math

from aerolith.llm import queries as Q
from tests.llm.test_dedup import brute_passages, brute_simhash

SF = "/root/testdata/sf0.001"


def rows(spark):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]


def test_simhash_query(spark):
    fps, group = brute_simhash(rows(spark))
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in Q.op7_simhash_dedup(spark, SF).collect()}
    assert got == {d: (f"{fps[d]:016x}", group[d]) for d in fps}


def test_passage_query(spark):
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in Q.op8_substring_dedup(spark, SF).collect()}
    assert got == brute_passages(rows(spark), 35)


def test_nearest_query(spark):
    vectors = {r.vec_id: r.embedding for r in spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").collect() if r.embedding}
    got = collections.defaultdict(dict)
    for r in Q.op3_hilbert_ann(spark, "/root/testdata/sf0.1").collect():
        got[r.query_id][r.vec_id] = r.score
    asked = [v for v in vectors if v % 100 == 0]
    hit = 0
    for q in asked:
        near = sorted((math.dist(vectors[q], x), v) for v, x in vectors.items() if v != q)[:10]
        hit += sum(v in got[q] for _, v in near)
        assert len(got[q]) == 10 and all(abs(s - math.dist(vectors[q], vectors[v])) < 1e-9 for v, s in got[q].items())
    assert set(got) == set(asked) and hit >= 0.9 * 10 * len(asked)


def test_toxicity_query_on_held_out_labels(spark):
    d = "/root/testdata/sf0.1"
    toxic = {r.doc_id: r.toxic for r in spark.read.parquet(f"{d}/labels.parquet").collect()}
    held = [r for r in Q.op10_toxicity(spark, d).collect() if r.held_out and toxic.get(r.doc_id) is not None]
    bad, fine = ([r for r in held if toxic[r.doc_id] == t] for t in (1, 0))
    caught, alarms = sum(r.predicted for r in bad) / len(bad), sum(r.predicted for r in fine) / len(fine)
    assert len(held) > 1000 and caught >= 0.8 and alarms <= 0.005, (caught, alarms)
