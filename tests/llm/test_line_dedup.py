import duckdb
import pytest

from tastegraph.llm.line_dedup import SQL, drop_lines


def texts(df):
    return {(r["doc_id"], r["text"]) for r in df.collect()}


def test_recurring_lines_go_but_for_the_first(docs):
    found = texts(drop_lines(docs((1, "boiler plate line\none"), (2, "two\nboiler plate line"), (3, "boiler plate line\nthree"), (4, "boiler  plate\tline"))))
    assert found == {(1, "boiler plate line\none"), (2, "two"), (3, "three"), (4, "")}


def test_variable_fields_make_one_template(docs):
    line = "It was posted by {} on day {} in the big news section of today"  # the tree goes by the first three tokens
    rows = [(i, line.format(n, i * 7)) for i, n in enumerate(("ann", "bob", "cy", "dee"))]
    found = {r["doc_id"]: r["n_dropped"] for r in drop_lines(docs(*rows)).collect()}
    assert found == {0: 0, 1: 1, 2: 1, 3: 1}


def test_rows_of_numbers_are_no_template(docs):
    rows = [(i, f"{i} {i + 1} {i + 2}") for i in range(6)]
    assert {r["n_dropped"] for r in drop_lines(docs(*rows)).collect()} == {0}


def test_two_documents_and_repeats_inside_one_do_not_count(docs):
    found = texts(drop_lines(docs((1, "same line here\nsame line here\nsame line here"), (2, "same line here"))))
    assert found == {(1, "same line here\nsame line here\nsame line here"), (2, "same line here")}


def test_a_long_line_recurs_in_two_documents(docs):
    long, other = (" ".join(f"{w}{'abcdefghijklmnopqrstuvwxyz'[i]}" for i in range(26)) for w in ("some", "what"))
    rows = [(1, f"{long}\nown one"), (2, f"two\n{long}"), (3, f"{other}\n{other}"), (4, " ".join(long.split()[:19])), (5, " ".join(long.split()[:19]))]
    found = texts(drop_lines(docs(*rows)))
    assert found == {(1, rows[0][1]), (2, "two"), (3, rows[2][1]), (4, rows[3][1]), (5, rows[4][1])}


def test_odd_rows(spark, docs):
    rows = docs((1, None), (2, ""), (3, "\n\n \n"), (None, "a b c"), (5, "a b c"), (6, "a b c"), (6, "a b c"), (7, "word " * 50_000))
    out = drop_lines(rows)
    found = sorted(((r["doc_id"], r["text"], r["n_lines"], r["n_dropped"]) for r in out.collect()), key=repr)
    assert [f for f in found if f[0] == 1] == [(1, None, 0, 0)]
    assert [f for f in found if f[0] == 3] == [(3, "\n\n \n", 4, 0)]
    assert [f[1] for f in found if f[0] == 6] == ["", ""]  # repeated rows change alike
    assert out.columns[: len(rows.columns)] == rows.columns
    assert drop_lines(docs()).count() == 0


def test_sql_agrees(docs):
    rows = [(i, "\n".join(f"line {j} of {['red', 'blue', 'green'][(i + j) % 3]} things is here in part {i % 2}" for j in range(6)) + f"\n{i} own") for i in range(9)]
    rows += [(20, None), (21, ""), (22, "a\x0bb c\t d\r")]
    long = " ".join(f"long line with {'abcdefghijklmnopqrstuvwxyz'[i]} in it" for i in range(9))
    rows += [(30, f"{long}\n{long} 7"), (31, f"x\n{long} 8"), (32, f"{long}\n{long}"), (33, "only a " + long), (34, "only a " + long), (35, "only a once " + long)]
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    want = sorted(con.execute(SQL).fetchall(), key=repr)
    got = sorted((tuple(r) for r in drop_lines(docs(*rows)).select("doc_id", "n_lines", "n_dropped", "text").collect()), key=repr)
    assert got == want and any(w[2] for w in want)
