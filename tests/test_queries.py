import pytest

from tessera import queries as q


@pytest.mark.parametrize("name", sorted(q.oracle_sql()))
def test_query_gives_the_rows_of_its_sql(name, same_as_duckdb):
    same_as_duckdb(q.queries()[name], q.oracle_sql()[name])


def test_every_query_but_the_tokenizer_has_sql():
    assert set(q.queries()) - set(q.oracle_sql()) == {"token_count_bpe"}


def test_entry_module_has_the_queries():
    import __spark_entry__ as entry

    assert set(q.queries()) <= set(entry.queries()) and set(q.oracle_sql()) <= set(entry.oracle_sql())


def test_entry_has_rows(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("frame", ["cs", "cs_flat", "xml"])
def test_frames_hold_every_line_of_the_text(spark, sf_dir, frame):
    framed = spark.read.parquet(f"{sf_dir}/documents.parquet").selectExpr("text", f"{q.FRAMES[frame]} AS framed").collect()
    assert any("\n" in r.text for r in framed)
    assert all(line in r.framed for r in framed for line in r.text.split("\n"))
