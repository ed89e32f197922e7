"""Every catalogue query against its SQL, plans of the hot paths, and the entry points."""

from __future__ import annotations

import importlib

import duckdb
import pytest

from glyphmill import catalogue
from glyphmill.operators import lexical

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def duck(sf):
    connection = duckdb.connect()
    for name in TABLES:
        connection.sql(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf}/{name}.parquet')")
    return connection


def rows_of(frame):
    frame = frame[sorted(frame.columns)]
    return sorted(tuple(repr(float(v)) if isinstance(v, float) else str(v) for v in row) for row in frame.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_query_equals_sql(spark, duck, sf, name):
    got, want = catalogue.queries()[name](spark, sf).toPandas(), duck.sql(catalogue.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows_of(got) == rows_of(want)


def test_entry_points(spark):
    entry = importlib.import_module("__spark_entry__")
    assert entry.entry(spark).count() == 10
    assert set(entry.oracle_sql()) <= set(entry.queries())


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_plans(spark, sf):
    units = catalogue.units_docs(spark, sf)
    hits = _plan(lexical.search_fts(units, catalogue.QUERIES, 10, weights=catalogue.CONTENT))
    assert "WindowGroupLimit" in hits and "CartesianProduct" not in hits
    scan = _plan(catalogue.queries()["content_hash_dedup"](spark, sf))
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in scan
    narrowed = _plan(catalogue.queries()["all_symbols"](spark, sf))
    assert "PushedFilters: [IsNotNull(lang), EqualTo(lang,de)]" in narrowed


@pytest.mark.parametrize("name", ["bm25_branch_filter_global_stats", "bm25_batch", "corpus_stats", "term_document_frequency", "mode_lexical_only"])
def test_word_searches_shuffle_no_texts(spark, duck, sf, name):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = catalogue.queries()[name](spark, sf)
        plan = _plan(found)
        assert "LeftOuter" in plan and not [line for line in plan.splitlines() if "SortMergeJoin" in line and "LeftOuter" in line]
        assert rows_of(found.toPandas()) == rows_of(duck.sql(catalogue.oracle_sql()[name]).df())
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_matches_are_found_once(spark, sf):
    found = catalogue.queries()["bm25_branch_filter_global_stats"](spark, sf)
    found.collect()
    ran = _plan(found).split("== Initial Plan ==")[0]
    assert sum("Generate posexplode" in line for line in ran.splitlines()) == 1


def test_joined_units_hash_before_the_join(spark, sf):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = _plan(catalogue.units_docs(spark, sf).select("rowid", "file_hash", "embedding_model"))
        joined = next(k for k, line in enumerate(plan.splitlines()) if "SortMergeJoin" in line)
        assert not any("sha2" in line for line in plan.splitlines()[:joined]) and "sha2" in plan
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_texts_repeat_as_their_vectors_do(spark, tmp_path):
    spark.createDataFrame([(k, f"text {k}", "en", "web", 6) for k in range(6)] + [(None, "none", "en", "web", 4)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(k, [1.0], 0) for k in (0, 2, 2, 2, 4, 4, None, None, 9, 9)], "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    units, texts = catalogue.units_docs(spark, str(tmp_path)), catalogue.texts_docs(spark, str(tmp_path))
    columns = [c for c in units.columns if c not in ("embedding", "embedding_model")]
    assert texts.columns == columns
    assert sorted(map(str, texts.collect())) == sorted(map(str, units.select(columns).collect())) and texts.count() == 10
