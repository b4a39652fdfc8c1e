import pytest
from hypothesis import given
from hypothesis import strategies as st

from seqloom.sources import records as R
from seqloom.sources.records import load_records, parse, parse_csv, parse_fasta

CASES = [
    ("fasta", ">h\nAC\r\nDE\n", 4, None),
    ("fasta", ">h\rAC DE\r\r", 4, None),
    ("fasta", "h\nACDE", 4, "header"),
    ("fasta", ">h\n>g\nACDE", 4, "header"),
    ("fasta", "\n>h\nACDE", 4, "header"),
    ("fasta", ">h", 4, "empty"),
    ("fasta", ">h\n \r\n", 4, "empty"),
    ("fasta", ">h\nACdE", 4, "symbol"),
    ("fasta", ">h\nAC­E", 4, "symbol"),
    ("fasta", ">h\nACD", 4, "length"),
    ("fasta", None, 4, "header"),
    ("fasta", "", 4, "header"),
    ("csv", "id,ACDE", 4, None),
    ("csv", 'id,"AC\nDE"\r\n', 4, None),
    ("csv", '"i ""x"", d",AC-E\r', 4, None),
    ("csv", 'id,AC"DE', 4, "quoting"),
    ("csv", 'id,"ACDE', 4, "quoting"),
    ("csv", 'id,"AC"DE', 4, "quoting"),
    ("csv", "id,ACDE,3", 4, "columns"),
    ("csv", "id\tACDE", 4, "columns"),
    ("csv", "id,AC\nDE", 4, "columns"),
    ("csv", "id,ACDE\n\n", 4, "columns"),
    ("csv", None, 4, "columns"),
    ("csv", "id,", 4, "empty"),
    ("csv", "id,ACXE", 4, "symbol"),
    ("csv", "id,ACD", 4, "length"),
]


def test_reasons(spark):
    raw = spark.createDataFrame([(k, f"F{n}", fmt, s, "extra") for k, (fmt, s, n, _) in enumerate(CASES)], "record_id long, family string, fmt string, sequence string, reason string")
    families = spark.createDataFrame([("F4", 4)], "family string, n_cols int")
    got = {r["record_id"]: r for r in load_records(raw, families).collect()}
    for k, (_, _, _, reason) in enumerate(CASES):
        assert got[k]["reason"] == reason, CASES[k]
        assert (got[k]["states"] is None) == (reason is not None)
    assert got[1]["states"] == [1, 2, 3, 4]


def test_unknown_family_and_empty_table(spark):
    families = spark.createDataFrame([("F4", 4), ("F4", 4)], "family string, n_cols int")
    raw = spark.createDataFrame([(1, None, "csv", "i,ACDE"), (2, "F9", None, ">h\nACDE")], "record_id long, family string, fmt string, sequence string")
    assert [r["reason"] for r in load_records(raw, families).collect()] == ["length", "length"]
    assert load_records(raw.limit(0), families).count() == 0


def test_recovery_goes_on_at_the_next_record():
    records, errors = parse_csv('a,ACDE\nb,"AC\nc,AC-E\nd,"DE"x\ne,EF\n')
    assert records == [("a", "ACDE"), ("c", "AC-E"), ("e", "EF")]
    assert [r for r, _ in errors] == ["quoting", "quoting"]
    records, errors = parse_fasta("junk\n>a\nAC\n>b\nDE\n")
    assert [h for h, _ in records] == ["a", "b"] and errors == [("header", 0)]


def test_place_of_an_error():
    assert parse('a,b\nc,"d', "csv")[2:5] == ("quoting", 2, 6)


@given(st.lists(st.tuples(st.text(alphabet='ab,"\n\r ', max_size=6), st.text(alphabet="ACD\n", max_size=6)), min_size=1, max_size=4))
def test_written_csv_is_read_back(rows):
    quote = lambda s: '"' + s.replace('"', '""') + '"'
    records, errors = parse_csv("\r\n".join(f"{quote(a)},{quote(b)}" for a, b in rows))
    assert records == rows and not errors


@pytest.mark.parametrize("n", [10, 200_000])
def test_long_texts(n):
    assert parse(">h\n" + "A" * n, "fasta")[1] == "A" * n
    assert parse('x,"' + "A\n" * n, "csv")[2] == "quoting"


def test_all_errors_are_located_and_records_behind_them_recovered(spark):
    text = 'a,AC\n"b,CD\nc,DE"x\nd,EF\n"e"f,GH\ng,HI\n'
    rows = [(1, text, "csv"), (2, "x,AC", "csv"), (3, None, "csv"), (4, ">h\nAC\n>i\nxx", "fasta"), (5, ">j\nAC", "fasta"), (6, "AC\n>k\nCD", "fasta")]
    raw = spark.createDataFrame(rows, "record_id long, sequence string, fmt string")
    errors = sorted(tuple(r) for r in R.syntax_errors(raw).collect())
    assert [(e[0], e[1], e[2]) for e in errors] == [(1, "quoting", 3), (1, "quoting", 5), (3, "columns", 1), (6, "header", 1)]
    for k, _, line, at in errors:
        whole = dict((r[0], r[1]) for r in rows)[k] or ""
        assert line == 1 + whole[:at].count("\n")
    got = {(r["record_id"], r["header"]): r["states"] for r in R.recovered_records(raw).collect()}
    assert {(1, "a"), (1, "d"), (1, "g"), (4, "h"), (4, "i"), (6, "k")} <= set(got) and not {k for k, _ in got} & {2, 3, 5}
    assert got[(1, "d")] == [4, 5] and got[(4, "i")] is None
    assert R.syntax_errors(raw.limit(0)).count() == 0 and R.recovered_records(raw.limit(0)).count() == 0
