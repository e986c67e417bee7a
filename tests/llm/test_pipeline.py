import random

import corpus_pipeline
from tests.llm.helpers import DOCS


def words(seed, n):
    rng = random.Random(seed)
    return " ".join(f"v{rng.randrange(997)}" for _ in range(n))


def test_pipeline_on_planted_documents(spark, tmp_path):
    rows = [(i, words(i, 60 + i % 40), "en", "big" if i % 4 else "small", 1) for i in range(400)]
    rows += [(1000 + i, words(i, 50) + " dunderhead", "en", "big", 1) for i in range(60)]
    rows += [(2000, rows[5][1], "en", "big", 1), (2001, rows[6][1].replace("v", "V"), "en", "big", 1), (2002, None, "en", None, 1), (2003, "", "en", "big", 1)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(i, 1, int(i >= 1000)) for i in [*range(200), *range(1000, 1060)]]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    ids = {r.doc_id for r in got}
    assert not ids & set(range(1000, 1060))
    assert 2000 in ids and 5 not in ids  # the larger id of equal texts
    assert len(ids & {6, 2001}) == 1 and len(ids & {2002, 2003}) == 1
    assert ids >= set(range(7, 400)) and all(r.n_ids == len(r.ids) for r in got)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "near_dedup", "mixing", "tokens"]


def test_pipeline_on_awkward_rows(spark, tmp_path):
    """Rows that share ids or have none, null labels, one very long text: each row is judged by its own text."""
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [(i, words(i, 60), "en", "a", 1) for i in range(120)] + [(500 + i, words(i, 50) + " dunderhead", "en", "a", 1) for i in range(60)]
    rows += [(500, words(9001, 60), "en", "a", 1), (3, words(9002, 60), "en", None, 1), (None, words(9003, 60), "en", "a", 1), (None, words(9004, 60), None, "a", None), (None, "you dunderhead", "en", "a", 1)]
    rows += [(700, words(9005, 250_000), "en", "a", 1), (None, rows[4][1], "en", "a", 1), (8, rows[8][1], "en", "a", 1)]
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(i, 1, int(i >= 500)) for i in [*range(120), *range(500, 560)]] + [(5, 1, None), (None, 1, 1), (999, 1, 1)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs, kept = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        kept.append(sorted((str(r.doc_id), r.text) for r in docs.collect()))
    own = lambda found: sorted((str(r[0]), r[1]) for r in found)
    clean = [r for r in rows if "dunderhead" not in r[1]]
    assert kept[0] == own(clean)
    once = own({(r[0], r[1]) for r in clean} - {(None, rows[4][1])})
    assert kept[1] == kept[2] == once and sorted(set(kept[3])) == once
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == len(kept[3])


def test_stages_keep_columns_and_take_empty_tables(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    d = spark.createDataFrame([], DOCS)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, d, str(tmp_path))
        assert out.columns == d.columns and out.count() == 0, name
