"""Queries over whole tables: no modulo filter and no id prefix stands between a query and its table."""

import duckdb
import numpy as np
import pytest

import __spark_entry__ as entry
from quarry.operators import search
from quarry.plans import catalog
from tests.conftest import TESTDATA
from tests.test_oracle import TABLES, rows

KNN = """
WITH q AS (SELECT vec_id AS query_id, embedding AS q FROM embeddings WHERE vec_id % 50 = 0),
 s AS (SELECT query_id, vec_id, round(list_cosine_similarity(q::DOUBLE[], embedding::DOUBLE[]), 6) AS similarity FROM q JOIN embeddings ON vec_id <> query_id),
 r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, vec_id) AS rank FROM s)
"""

#: The SQL of these queries, written out: no modulo filter and no id prefix but the query sets.
WHOLE = {
    "g16_components": """
WITH RECURSIVE e AS (SELECT DISTINCT l_orderkey AS a, l_orderkey + 1 AS b FROM lineitem WHERE l_returnflag = 'R' AND l_linenumber = 1),
 w(n, root) AS (SELECT a, a FROM e WHERE a NOT IN (SELECT b FROM e) UNION ALL SELECT e.b, w.root FROM w JOIN e ON e.a = w.n)
SELECT n AS node, root AS component FROM w
""",
    "sea02_knn": KNN + "SELECT query_id, vec_id, similarity, rank FROM r WHERE rank <= 10",
    "sea05_rrf": KNN + "SELECT vec_id, round(sum(1 / (rank + 60)), 6) AS score FROM r WHERE rank <= 10 GROUP BY 1",
    "jo18_sha_prefix": """
WITH s AS (SELECT o_orderkey, o_orderpriority AS repo, sha1(o_orderkey::VARCHAR) AS sha FROM orders), a AS (SELECT repo, substr(sha, 1, 7 + (o_orderkey % 5)::INT) AS short FROM s)
SELECT s.o_orderkey, a.short FROM a JOIN s ON s.repo = a.repo AND starts_with(s.sha, a.short)
""",
    "sea06_hybrid": KNN + f""",
 b AS ({catalog.oracle_sql()["sea04_bm25"]}), k AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM b),
 v AS (SELECT query_id, vec_id, rank FROM r WHERE rank <= 20), w AS (SELECT query_id, doc_id AS vec_id, rank FROM q, k WHERE rank <= 20)
SELECT coalesce(v.query_id, w.query_id) AS query_id, coalesce(v.vec_id, w.vec_id) AS vec_id, round(coalesce(1 / (60 + v.rank), 0) + coalesce(1 / (60 + w.rank), 0), 6) AS score,
 CASE WHEN w.rank IS NULL THEN 'vector' WHEN v.rank IS NULL THEN 'keyword' ELSE 'both' END AS matched FROM v FULL JOIN w ON v.query_id = w.query_id AND v.vec_id = w.vec_id
""",
}


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{TESTDATA}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", sorted(WHOLE))
def test_whole(spark, duck, sf_dir, name):
    got = entry.queries()[name](spark, sf_dir).toPandas()
    want = duck.execute(WHOLE[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("blocks", [(2, 3), (256, 4096)])
def test_knn_in_blocks(spark, blocks):
    rng = np.random.default_rng(4)
    v = {i: rng.normal(size=3).round(1).tolist() for i in range(40)} | {i: [1.0, 2.0, 2.0] for i in range(40, 60)}
    v |= {60: None, 61: [1.0, None, 2.0], 62: [1.0, 2.0], 63: [0.0, 0.0, 0.0]}
    d = spark.createDataFrame(list(v.items()), "vec_id long, embedding array<float>")
    unit = {i: np.float32(x).astype(float) for i, x in v.items() if i < 60}

    def similarity(a, b):
        return round(float(a @ b / np.sqrt(a @ a * (b @ b))), 6)

    want = set()
    for q in range(0, 60, 5):
        near = sorted((-similarity(unit[q], x), i) for i, x in unit.items() if i != q)
        want |= {(q, r, i, -s) for r, (s, i) in enumerate(near[:7], 1)}
    got = search.knn(d, d.where("vec_id % 5 = 0 and vec_id < 60"), 7, *blocks).collect()
    assert {(r.query_id, r["rank"], r.vec_id, r.similarity) for r in got} == want
    assert all(r.similarity is None for r in search.knn(d, d.where("vec_id >= 60"), 3, *blocks).where("query_id <> 62").collect())
    assert search.knn(d, d.limit(0), 7).count() == search.knn(d.limit(0), d, 7).count() == 0


def test_leakset_finds_short_passages(spark, tmp_path):
    passages = ["one", "Two words", "here are three", "now there are four", "and these five are words", "six words stand in this passage", "seven words are what this passage has"]
    passages += ["ends", "  ne two wor ", "", "a  b", "not in any of the texts", None]
    texts = ["none", "xtwo wordsy and two", "where are threes", "now there are  four", "know there are fourteen", "x and these five are words", "and these five are word"]
    texts += ["six words stand in this passage and seven words are what this passage has", "line\nends here are\nthree", "one two words", "a b a  b", "", None]
    spark.createDataFrame(list(enumerate(passages)), "item_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    c = duckdb.connect()
    for t in ("benchmark", "documents"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{tmp_path}/{t}.parquet/*.parquet')")
    got = entry.queries()["txt_passages"](spark, str(tmp_path)).toPandas()
    assert rows(got) == rows(c.execute(entry.oracle_sql()["txt_passages"]).df())
    assert len(got) == 12
    c.execute("CREATE OR REPLACE TABLE x AS FROM benchmark WHERE item_id IN (2, 3, 4, 5, 6)")
    spark.read.parquet(f"{tmp_path}/benchmark.parquet").where("item_id between 2 and 6").write.parquet(f"{tmp_path}/b/benchmark.parquet")
    spark.read.parquet(f"{tmp_path}/documents.parquet").write.parquet(f"{tmp_path}/b/documents.parquet")
    c.execute("CREATE OR REPLACE VIEW benchmark AS FROM x")
    got = entry.queries()["txt_passages"](spark, f"{tmp_path}/b").toPandas()
    assert len(got) and rows(got) == rows(c.execute(entry.oracle_sql()["txt_passages"]).df())
