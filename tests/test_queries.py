import random

import duckdb
import pytest

from platewise.plans import catalogue

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def rows(frame):
    plain = lambda v: None if v is None or v != v else float(v) if not isinstance(v, str) else v
    return sorted(repr([plain(v) for v in r]) for r in frame[sorted(frame.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query(spark, duck, name):
    got = catalogue.queries()[name](spark, DATA).toPandas()
    if name in catalogue.oracles():
        assert rows(got) == rows(duck.execute(catalogue.oracles()[name]).df())
    else:
        assert len(got) > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0


def test_hybrid_scores_all_documents(spark, tmp_path):
    """A similar document of BM25 rank 6 or lower, and one without a word of the item, come in."""
    docs = [(i, "salt " * (9 - i) + "pad " * i) for i in range(8)] + [(8, "other"), (9, None)]
    for name, rows, schema in (("documents", docs, "doc_id long, text string"), ("labels", [(7, 1), (8, 1), (0, 0)], "doc_id long, quality int"), ("benchmark", [(1, "salt"), (2, "none of it")], "item_id long, text string")):
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    got = catalogue.queries()["hybrid_retrieval"](spark, str(tmp_path)).orderBy("item_id", "rank").collect()
    assert [(r["item_id"], r["doc_id"]) for r in got] == [(1, 7), (1, 8), (1, 0), (2, 7), (2, 8), (2, 0)]


def test_levenshtein_pairs_loses_none(spark, duck):
    from platewise.operators import joins

    rng = random.Random(5)
    names = {"", "a", "abcde", "zbcdefgh"} | {"".join(rng.choices("abc ", k=rng.randrange(1, 16))) for _ in range(150)}
    frame = spark.createDataFrame([(x,) for x in [*names, None]], "w string")
    every = duck.execute("SELECT a, b, levenshtein(a, b) FROM (SELECT unnest(?) AS a) x JOIN (SELECT unnest(?) AS b) y ON a < b", [[*names], [*names]]).fetchall()
    for k in (1, 2, 5):
        expected = {(a, b): d for a, b, d in every if d <= k}
        assert {(r["a"], r["b"]): r["d"] for r in joins.levenshtein_pairs(frame, "w", k).collect()} == expected


def test_levenshtein_alias_whole_crosses_first_letters(spark):
    got = catalogue.queries()["levenshtein_alias_whole"](spark, DATA).collect()
    assert any(r["a"][0] != r["b"][0] for r in got) and ("blue anvil", "cold anvil", 4) in {(r["a"], r["b"], r["d"]) for r in got}


def test_pref_sides(spark):
    """Both sides of each user, up to 80 each, filled up to three by weaker ones."""
    got = catalogue.queries()["pref_ensemble_sides_topk"](spark, DATA).toPandas()
    liked, disliked = got[got.side == "liked"], got[got.side == "disliked"]
    assert (liked.score >= 0).all() and (disliked.score <= 0).all() and len(liked) and len(disliked)
    former = catalogue.queries()["pref_ensemble_topk"](spark, DATA).toPandas()
    assert set(zip(former.u, former.i, strict=True)) < set(zip(liked.u, liked.i, strict=True))
    assert not got.duplicated(["u", "i"]).any() and got.r.max() <= 80 and (got[got.score.abs() < 0.04].r <= 3).all()
