import random

import corpus_pipeline
import pytest

from ledgerlens.llm import queries

pytest.importorskip("public_tokenizers")
pytest.importorskip("tokenizers")


def test_stages_take_effect(spark, tmp_path):
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(3, 9)))
    prose = lambda n: " ".join(word() for _ in range(n))
    base, leak = prose(120), prose(40)
    near = base.split()
    near[60] = "changed"
    rows = [(i, prose(80), "en" if i % 2 else "de", "s", 1) for i in range(30)]
    rows += [(100, base, "en", "s", 1), (101, base + "\n", "en", "s", 1), (102, " ".join(near), "en", "s", 1), (103, f"{prose(50)} {leak} {prose(50)}", "en", "s", 1), (104, "123 456 !", "en", "s", 1), (105, None, None, None, None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {r.doc_id for r in corpus_pipeline.run(spark, f"file://{tmp_path}").collect()}
    # the longer of the exact copies stays, then the least doc_id of the near copies
    assert got == {*range(30), 101}


def test_every_operator_has_a_query():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 14))
    assert set(queries.ORACLES) <= set(queries.QUERIES)


def test_rows_without_an_id_of_their_own(spark):
    """Null and repeated ids: every text is judged by itself, one row of each repeat stays."""
    rng = random.Random(2)
    prose = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(n))
    a, b, c, d, leak = (prose(60) for _ in range(5))
    near = a.split()
    near[30] = "changed"
    rows = [(None, a), (None, b), (None, b), (2, c), (2, c), (2, d), (3, d), (4, None), (4, ""), (None, " ".join(near)), (None, f"{prose(20)} {leak}"), (5, f"{prose(20)} {leak} {prose(5)}")]
    docs = spark.createDataFrame([(i, t, "en", "s", 1, "x") for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, own string").repartition(3)
    exact = corpus_pipeline.exact_dedup(spark, docs, "")
    assert exact.columns == docs.columns
    kept = [(r.doc_id, r.text) for r in exact.collect()]
    assert sorted((t or "") for _, t in kept) == sorted({t or "" for _, t in rows}) and (3, d) in kept
    left = [r.text for r in corpus_pipeline.near_dedup(spark, docs, "").collect()]
    assert left.count(b) == 1 and left.count(c) == 1 and left.count(d) == 1 and (a in left) != (" ".join(near) in left)


def test_decontamination_without_ids(spark, tmp_path):
    rng = random.Random(3)
    prose = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(n))
    leak, other = prose(40), prose(60)
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = [(None, other), (None, f"{prose(20)} {leak}"), (7, f"{prose(20)} {leak} {prose(5)}"), (7, prose(50)), (8, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = corpus_pipeline.decontamination(spark, docs, f"file://{tmp_path}").collect()
    assert sorted(str(r.text) for r in got) == sorted([other, rows[3][1], "None"])
