"""Tables that are folders of several Parquet files, against DuckDB's reading of them."""

import duckdb

from tessera.plans import queries as plans
from tessera.sources import files as fl

NAMES = ("part-10", "part-2", "a b", "Z", "part-1", "é", "z%20", "none")


def several(folder, select: str, rows: int = 3) -> str:
    """A table of NAMES files in folder, the last without rows; what DuckDB reads it by."""
    folder.mkdir()
    for i, name in enumerate(NAMES):
        duckdb.sql(f"COPY (SELECT {select.format(i=i)} FROM range({0 if name == 'none' else rows + i}) AS t(x)) TO '{folder}/{name}.parquet'")
    return f"'{folder}/*.parquet'"


def held(spark, tmp_path, name: str, table: str, files: str) -> list[tuple]:
    con = duckdb.connect()
    con.sql(f"CREATE VIEW {table} AS SELECT * FROM {files}")
    want = con.sql(plans.ORACLE_SQL[name])
    got = plans.QUERIES[name](spark, f"file://{tmp_path}").select(*want.columns)
    rows = sorted(want.fetchall(), key=str)
    assert sorted(map(tuple, got.collect()), key=str) == rows
    return rows


def test_pages_are_numbered_over_all_files(spark, tmp_path):
    files = several(tmp_path / "pages.parquet", "{i} * 100 + x AS page_id, 'http://h/' || x AS url, 'p' AS html")
    rows = held(spark, tmp_path, "pages_in_file_order", "pages", files)
    assert sorted(r[2] for r in rows) == list(range(len(rows))) and len(rows) == 7 * 3 + 21


def test_a_folder_is_surveyed_as_one_table(spark, tmp_path):
    files = several(tmp_path / "documents.parquet", "x AS doc_id, 't' AS text, 'en' AS lang, 's' AS source, 1 AS n_chars")
    (tmp_path / "documents.parquet" / "_SUCCESS").touch()
    assert ("documents.parquet", 7 * 3 + 21, 5, True) in held(spark, tmp_path, "shard_survey", "documents", files)
    size = sum(p.stat().st_size for p in (tmp_path / "documents.parquet").glob("*.parquet"))
    (tmp_path / "empty").mkdir()
    planned = [("c", f"file://{tmp_path}/documents.parquet", size), ("c", f"file://{tmp_path}/documents.parquet", 1), ("c", f"file://{tmp_path}/empty", 0)]
    a, b, c = fl.survey(spark.createDataFrame(planned, "corpus string, path string, size long")).collect()
    assert (a["actual_size"], a["size_matches"], b["size_matches"], c["reachable"], c["n_rows"]) == (size, True, False, False, None)
    (tmp_path / "documents.parquet" / "torn.parquet").write_text("no footer")
    assert not fl.survey(spark.createDataFrame(planned[:1], "corpus string, path string, size long")).first()["reachable"]
