import os

import pytest

from maskwright.catalog import ORACLE, QUERIES

DATA = "/root/testdata/sf0.001"


def test_every_oracle_has_a_query():
    assert set(ORACLE) <= set(QUERIES)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("name", ["documents_pseudonymized", "email_tokens", "alloc_collisions", "restore_roundtrip", "replacement_report"])
def test_query_equals_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for f in os.listdir(DATA):
        path = os.path.join(DATA, f) + ("/*" if os.path.isdir(os.path.join(DATA, f)) else "")
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{path}'")
    df = QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    want = con.execute(f"SELECT {', '.join(columns)} FROM ({ORACLE[name]})").fetchall()
    assert sorted(map(str, map(tuple, df.select(columns).collect()))) == sorted(map(str, want))


def test_page_titles_are_looked_at_and_heads_of_mails_are_not(spark, tmp_path):
    import duckdb

    from maskwright.sources.formats import html_to_text

    head = "<html><head><title>an a@firma.de</title><style>b@firma.de</style></head><body>"
    pages = [(0, f"{head}<p>c&#64;firma.de</p></body></html>"), (1, f"{head}</body></html>"), (2, "<p>c@firma.de</p>")]
    spark.createDataFrame(pages, "page_id long, html string").coalesce(1).write.parquet(str(tmp_path / "pages.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{tmp_path}/pages.parquet/*.parquet')")
    got = sorted(map(tuple, QUERIES["html_text_pii"](spark, str(tmp_path)).collect()))
    assert got == sorted(con.execute(ORACLE["html_text_pii"]).fetchall()) == [(0, 2), (1, 1), (2, 1)]
    assert html_to_text(pages[0][1]) == "c@firma.de"


def test_the_rest_stands_without_the_optional_part(monkeypatch):
    import importlib.util

    import __spark_entry__ as entry

    real = importlib.util.find_spec
    monkeypatch.setattr(importlib.util, "find_spec", lambda name, *a: None if name in ("maskwright.llm", "corpus_pipeline") else real(name, *a))
    assert set(entry.queries()) == set(QUERIES) and set(entry.oracle_sql()) == set(ORACLE)
