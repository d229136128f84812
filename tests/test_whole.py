"""Whole tables against brute force, and against each query's own SQL."""

import duckdb
import pytest

import __spark_entry__ as entry
from proofframe.storage import shared_path


@pytest.fixture(scope="module")
def documents(spark):
    """Twelve documents, so that every remainder of 3 and 4 occurs, and their folder."""
    texts = {i: "\n".join(["Head. one", "aé line", f"on {'the' if i % 2 else 'a'} way", "Next. two", "the end"]) for i in range(12)} | {12: None, 13: ""}
    folder = shared_path(spark, "whole-documents")
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(f"{folder}/documents.parquet")
    return {i: x for i, x in texts.items() if x is not None}, folder


def got(spark, name, folder):
    return sorted((tuple(r) for r in entry.queries()[name](spark, folder).collect()), key=repr)


def part(name, folder, columns):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{folder}/documents.parquet/*.parquet'")
    return sorted(con.execute(f"select {columns} from ({entry.oracle_sql()[name]})").fetchall(), key=repr)


def test_text_diff_compares_all_documents(spark, documents):
    texts, folder = documents
    want = []
    for i, x in texts.items():
        y = x.replace("the", "THE") if i % 3 == 0 else x
        want += [(i, n, a, b) for n, (a, b) in enumerate(zip(x.split("\n"), y.split("\n"), strict=True), 1) if a != b][:1]
    whole = got(spark, "text_diff", folder)
    assert whole == sorted(want, key=repr) and {r[0] for r in whole} == {0, 3, 6, 9}
    assert whole == part("text_diff", folder, 'doc_id, line_no, "expected", found')


def test_bytes_diff_compares_all_documents(spark, documents):
    texts, folder = documents
    want = []
    for i, x in texts.items():
        y = x.replace("the", "THE") if i % 3 == 0 else x
        want += [(i, len(x.encode()), len(y.encode()), n) for n, (a, b) in enumerate(zip(x.encode(), y.encode(), strict=True)) if a != b][:1]
    whole = got(spark, "bytes_diff", folder)
    assert whole == sorted(want, key=repr) and len(whole) == 4
    assert whole == part("bytes_diff", folder, "doc_id, a_bytes, b_bytes, first")


def test_section_of_line_reads_all_documents(spark, documents):
    texts, folder = documents
    want = []
    for i, x in texts.items():
        head = None
        for n, line in enumerate(x.split("\n"), 1):
            head = line[:12] if line.startswith(("Head.", "Next.")) else head
            want.append((i, n, head))
    whole = got(spark, "section_of_line", folder)
    assert whole == sorted(want, key=repr)
    assert whole == part("section_of_line", folder, "doc_id, line_no, section")
