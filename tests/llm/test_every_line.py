"""Runs of one line: single repeated lines and short documents."""

import cases

from pagelake.llm import lines, queries


def test_single_lines_go(spark, tmp_path):
    rows = [cases.row(1, "only here\nSubscribe now\nalso here"), cases.row(2, "Subscribe now"), cases.row(3, "x\n Subscribe now\t\ny\nx"), cases.row(None, "Subscribe now"), cases.row(4, None)]
    cases.frame(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.text, r.removed_lines) for r in queries.QUERIES["line_dedup_every_line"](spark, str(tmp_path)).collect()}
    assert got == {1: (rows[0][1], 0), 2: ("", 1), 3: ("x\ny", 2), None: ("Subscribe now", 0), 4: (None, 0)}


def test_against_plain_version(spark):
    rows = cases.nasty()
    want = cases.without_repeated_lines(rows, 1)
    got = lines.dedup_lines(cases.frame(spark, rows), 1).collect()
    assert sorted((r.doc_id or -1, r.text or "", r.text is None) for r in got) == sorted((r[0] or -1, want.get((r[0], r[1]), r[1]) or "", r[1] is None) for r in rows)
