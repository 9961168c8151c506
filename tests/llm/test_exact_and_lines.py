import time

import duckdb
import pytest
from pyspark.sql import functions as F

from palimpsest.llm import exactdedup, linededup

LINE = "this line is long enough to count as a repeated line"


def oracle(sql, rows):
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    return sorted(con.execute(sql).fetchall(), key=repr)


def rows_of(df, *names):
    return sorted((tuple(r) for r in df.select(*names).collect()), key=repr)


EXACT = [(1, "Abc"), (2, "aBC"), (3, "abd"), (4, ""), (5, None), (6, "É"), (7, "é"), (8, "x" * 50), (9, "x" * 49 + "y"), (10, "X" * 50), (11, "x" * 33), (12, "x" * 33)]


@pytest.mark.parametrize("block", [1, 4, 4096])
def test_exact_groups(spark, block):
    got = exactdedup.exact_groups(spark.createDataFrame(EXACT, "doc_id long, text string"), block=block)
    assert rows_of(got, "id", "keep_id", "group_size", "kept", "text_sha256") == oracle(exactdedup.OP8_SQL, EXACT)


def test_exact_hot_blocks(spark, monkeypatch):
    monkeypatch.setattr(exactdedup, "BUCKET_ROWS", 2)
    monkeypatch.setattr(exactdedup, "HOT_ROWS", 5)
    rows = [(i, "hot text" if i % 3 else f"cold {i // 6}") for i in range(60)]
    got = exactdedup.exact_groups(spark.createDataFrame(rows, "doc_id long, text string"), block=5)
    assert rows_of(got, "id", "keep_id", "group_size", "kept", "text_sha256") == oracle(exactdedup.OP8_SQL, rows)


@pytest.mark.parametrize("hot", [5, 1000])
def test_names_do_not_rest_on_hashes(spark, monkeypatch, hot):
    monkeypatch.setattr(exactdedup, "_hashed", lambda *keys: F.lit(3).cast("long"))
    monkeypatch.setattr(exactdedup, "HOT_ROWS", hot)
    rows = [(i, "hot text" if i % 3 else f"cold {i // 6} and longer" * (1 + i // 6)) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = {i: t for i, t in rows}
    for block in (5, 4096):
        found = exactdedup.identities(docs, exactdedup.Scratch(spark, "test"), block=block).collect()
        assert len(found) == 40 and all((a.level, a.name) == (b.level, b.name) if want[a.id] == want[b.id] else (a.level, a.name) != (b.level, b.name) for a in found for b in found)


def test_a_very_long_text(spark):
    long = spark.range(3).selectExpr("id AS doc_id", "concat(repeat('ab\nÉx', 1000000), CASE WHEN id < 2 THEN 'Z' ELSE 'y' END) AS text", "1 AS block", "2 AS name")
    began = time.time()
    got = rows_of(exactdedup.exact_groups(long), "id", "keep_id", "group_size", "kept")
    assert got == [(0, 1, 2, False), (1, 1, 2, True), (2, 2, 1, True)] and time.time() - began < 60


def test_exact_repeats_nulls_and_empty(spark):
    rows = [(1, "a"), (1, "a"), (None, "a"), (2, "b"), (2, "c"), (None, None)]
    got = rows_of(exactdedup.exact_groups(spark.createDataFrame(rows, "doc_id long, text string")), "id", "keep_id", "group_size", "kept")
    assert got == sorted([(1, 1, 3, True), (1, 1, 3, True), (None, 1, 3, False), (2, 2, 1, True), (2, 2, 1, True), (None, None, 1, True)], key=repr)
    assert exactdedup.exact_groups(spark.createDataFrame([], "doc_id long, text string")).count() == 0


LINES = [(i, f"own line {i}\n{LINE if i % 2 else LINE.upper()}  \nshort\n" + ("\t" + LINE + " too" if i < 4 else "")) for i in range(8)]
LINES += [(20, None), (21, ""), (22, "\n\n"), (23, f"{LINE}\n{LINE}"), (24, "é" * 39), (25, "é" * 40 + "\r"), *((30 + k, "é" * 40) for k in range(5))]


@pytest.mark.parametrize("filter_bytes", [64 << 20, 1])
def test_lines(spark, filter_bytes):
    got = linededup.drop_repeated_lines(spark.createDataFrame(LINES, "doc_id long, text string"), keep_text=False, filter_bytes=filter_bytes)
    assert rows_of(got, "row.doc_id", "n_lines", "n_dropped", "kept") == oracle(linededup.OP10_SQL, LINES)


def test_lines_keep_text_repeats_and_columns(spark):
    rows = [(i, f"{LINE}\nrest", i) for i in range(5)] + [(2, f"{LINE}\nrest", 9), (None, f"{LINE}\nq", 0)]
    got = linededup.drop_repeated_lines(spark.createDataFrame(rows, "doc_id long, text string, keys int"))
    kept = {(r.row.doc_id, r["row"]["keys"]): r.kept for r in got.collect()}
    assert len(kept) == 7 and kept[(4, 4)] == f"{LINE}\nrest" and kept[(2, 2)] == kept[(2, 9)] == "rest" and kept[(None, 0)] == "q"
    assert linededup.drop_repeated_lines(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_queries_on_the_table(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert rows_of(exactdedup.op8_exact_dedup(spark, sf), "doc_id", "keep_id", "group_size", "kept", "text_sha256") == oracle(exactdedup.OP8_SQL, docs)
    assert rows_of(linededup.op10_line_dedup(spark, sf), "doc_id", "n_lines", "n_dropped", "kept_sha256") == oracle(linededup.OP10_SQL, docs)
