import duckdb
import pytest

import __spark_entry__ as entry
from quern.plans import catalog

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    return con


def rows(df):
    df = df[sorted(df.columns)]
    plain = lambda v: None if v is None or v != v else round(float(v), 8) if isinstance(v, float) else str(v)
    return sorted(map(str, (tuple(map(plain, r)) for r in df.itertuples(index=False))))


@pytest.mark.parametrize("name", ["classify_counts", "batch_dedupe", "line_import", "tfidf_top5", "bigram_prune", "corpus_entities", "entity_signature", "evidence_top3", "centroid_pairs", "trend", "title_collisions", "tag_patterns", "crm_match", "priority_score", "related_2hop", "hybrid_search", "coverage_metrics"])
def test_equals_sql(spark, duck, name):
    got, want = catalog.queries()[name](spark, DIR).toPandas(), duck.execute(catalog.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_registry():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(catalog.queries()) > 60


def test_entry(spark):
    out = entry.entry(spark)
    assert out.columns[:2] == ["cluster", "title"] and out.count() > 0
