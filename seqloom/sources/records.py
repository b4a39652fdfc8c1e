"""Raw sequence records with errors: a recovering recursive-descent grammar.

Each text is parsed as FASTA or RFC 4180 CSV. After a syntax error the parser
goes on at the next place where a whole record can be read from the start of
a line, so that one broken quote costs one record. It returns the records
read and the errors with their places.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fixed: the letters of states 0 to 20.
ALPHABET = "-ACDEFGHIKLMNPQRSTVWY"

_EOL = re.compile(r"\r\n|\r|\n")
_QUOTED = re.compile(r'"((?:[^"]|"")*)"')
_BARE = re.compile(r'[^",\r\n]*')
_LAYOUT = str.maketrans("", "", "\r\n \t")

Record = tuple[str, str]
Error = tuple[str, int]


class Syntax(Exception):
    def __init__(self, reason: str, at: int):
        super().__init__(reason)
        self.reason, self.at = reason, at


def _field(text: str, at: int) -> tuple[str, int]:
    """field := quoted | bare, up to a comma, a line end or the end."""
    if text.startswith('"', at):
        m = _QUOTED.match(text, at)
        if not m:
            raise Syntax("quoting", at)
        value = m[1].replace('""', '"')
    else:
        m = _BARE.match(text, at)
        value = m[0]
    end = m.end()
    if end < len(text) and text[end] not in ",\r\n":
        raise Syntax("quoting", end)
    return value, end


def _row(text: str, at: int) -> tuple[list[str], int]:
    """row := field (',' field)* (EOL | end)."""
    value, at = _field(text, at)
    fields = [value]
    while text.startswith(",", at):
        value, at = _field(text, at + 1)
        fields.append(value)
    m = _EOL.match(text, at)
    return fields, m.end() if m else at


def _anchor(text: str, at: int) -> int | None:
    """The next line start after ``at`` from which two fields with a sequence as the second can be read."""
    for m in _EOL.finditer(text, at):
        try:
            fields, _ = _row(text, m.end())
        except Syntax:
            continue
        body = fields[-1].translate(_LAYOUT)
        if len(fields) == 2 and fields[0] and body and not body.strip(ALPHABET):
            return m.end()
    return None


def parse_csv(text: str) -> tuple[list[Record], list[Error]]:
    """rows := row*; the records and the errors of a CSV text."""
    records: list[Record] = []
    errors: list[Error] = []
    at = 0
    if not text:
        errors.append(("columns", 0))
    while at < len(text):
        try:
            fields, end = _row(text, at)
        except Syntax as e:
            errors.append((e.reason, e.at))
            # a quote that closes far behind may have swallowed whole records: look from the row's start on
            back = _anchor(text, at)
            if back is None:
                break
            at = back
            continue
        if len(fields) == 2:
            records.append((fields[0], fields[1]))
        else:
            errors.append(("columns", at))
        at = end
    return records, errors


def parse_fasta(text: str) -> tuple[list[Record], list[Error]]:
    """file := record*; record := '>' header EOL (line EOL)*; the anchor is a line that starts with '>'."""
    records: list[Record] = []
    errors: list[Error] = []
    at = 0
    if not text.startswith(">"):
        errors.append(("header", 0))
        m = re.compile(r"[\r\n]>").search(text)
        at = m.end() - 1 if m else len(text)
    while at < len(text):
        m = _EOL.search(text, at)
        header, start = (text[at + 1 : m.start()], m.end()) if m else (text[at + 1 :], len(text))
        n = re.compile(r"(?:^|(?<=[\r\n]))>").search(text, start) if start < len(text) else None
        end = n.start() if n and (n.start() > start or text[start] == ">") else len(text)
        if start < len(text) and text[start] == ">":
            end = start
        records.append((header, text[start:end]))
        at = end
    return records, errors


def parse(text: str | None, fmt: str | None) -> tuple[str | None, str | None, str | None, int | None, int | None, int, int]:
    """Header, body, reason, place of the error as line and offset, and how many records and errors there are.

    The text counts as one record only if it holds nothing else.
    """
    text = text or ""
    records, errors = parse_csv(text) if fmt == "csv" else parse_fasta(text)
    reason = at = None
    if errors:
        reason, at = min(errors, key=lambda e: (e[0] != "quoting", e[1]))
    elif len(records) != 1:
        reason, at = ("columns" if fmt == "csv" else "header"), 0
    line = None if at is None else 1 + len(_EOL.findall(text, 0, at))
    header, body = records[0] if records else (None, None)
    return header, body, reason, line, at, len(records), len(errors)


_PARSED = T.StructType(
    [
        T.StructField("header", T.StringType()),
        T.StructField("body", T.StringType()),
        T.StructField("reason", T.StringType()),
        T.StructField("error_line", T.IntegerType()),
        T.StructField("error_at", T.IntegerType()),
        T.StructField("n_records", T.IntegerType()),
        T.StructField("n_errors", T.IntegerType()),
    ]
)


@F.pandas_udf(_PARSED)
def parsed(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    """``parse`` for Arrow batches of text and format."""
    for text, fmt in batches:
        rows = [parse(t, f) for t, f in zip(text, fmt, strict=True)]
        out = pd.DataFrame(rows, columns=_PARSED.names)
        for c in ("error_line", "error_at", "n_records", "n_errors"):
            out[c] = out[c].astype("Int32")
        yield out


_PARTS = T.StructType(
    [
        T.StructField("records", T.ArrayType(T.StructType([T.StructField("header", T.StringType()), T.StructField("body", T.StringType())]))),
        T.StructField("errors", T.ArrayType(T.StructType([T.StructField("reason", T.StringType()), T.StructField("line", T.IntegerType()), T.StructField("at", T.IntegerType())]))),
    ]
)


@F.pandas_udf(_PARTS)
def parts_of(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    """All records and all located errors of Arrow batches of text and format."""
    for texts, fmts in batches:
        out: dict[str, list] = {"records": [], "errors": []}
        for text, fmt in zip(texts, fmts, strict=True):
            text = text or ""
            records, errors = parse_csv(text) if fmt == "csv" else parse_fasta(text)
            out["records"].append([{"header": h, "body": b} for h, b in records])
            out["errors"].append([{"reason": r, "line": 1 + len(_EOL.findall(text, 0, at)), "at": at} for r, at in errors])
        yield pd.DataFrame(out)


def syntax_errors(raw: DataFrame, key: str = "record_id", text: str = "sequence", fmt: str = "fmt") -> DataFrame:
    """key, reason, error_line (from 1) and error_at (offset from 0) of every syntax error; a text may have several.

    A null text has the error of an empty one. Other columns are not used.
    """
    p = raw.select(F.col(key), F.explode(parts_of(F.col(text), F.col(fmt))["errors"]).alias("_e"))
    return p.select(key, F.col("_e.reason").alias("reason"), F.col("_e.line").alias("error_line"), F.col("_e.at").alias("error_at"))


def recovered_records(raw: DataFrame, key: str = "record_id", text: str = "sequence", fmt: str = "fmt") -> DataFrame:
    """key, part, header, sequence_text and states of the records that can be read in texts that have syntax errors or hold several.

    ``part`` counts the text's records from 0; states are null where a
    letter is outside the alphabet. Texts that are one record without an
    error are not among them (``load_records`` loads these).
    """
    p = raw.select(F.col(key), parts_of(F.col(text), F.col(fmt)).alias("_p")).where((F.size("_p.errors") > 0) | (F.size("_p.records") > 1))
    p = p.select(key, F.posexplode("_p.records").alias("part", "_r")).select(key, "part", F.col("_r.header").alias("header"), F.translate("_r.body", "\r\n \t", "").alias("sequence_text"))
    states = F.transform(F.split("sequence_text", ""), lambda c: F.instr(F.lit(ALPHABET), c) - 1)
    fits = (F.col("sequence_text") != "") & (F.translate("sequence_text", ALPHABET, "") == "")
    return p.withColumn("states", F.when(fits, states))


def load_records(raw: DataFrame, families: DataFrame, key: str = "record_id", text: str = "sequence", fmt: str = "fmt", family: str = "family", n_cols: str = "n_cols") -> DataFrame:
    """Every record with its header, its states or the reason why it can't be loaded.

    ``raw`` has one row a key. Result: key, family, header, sequence_text
    (layout removed), states (null where there is a reason), reason (null
    where loaded), error_line and error_at (1-based line and 0-based offset
    of a syntax error), n_records and n_errors of the text.

    A null text counts as empty; a format other than ``csv``, null too, is
    read as FASTA. A record whose family is null or unknown has no length it
    could fit and gets ``length``. Other columns of ``raw`` are not used. An
    empty table gives an empty result.
    """
    p = raw.select(F.col(key), F.col(family).alias("family"), parsed(F.col(text), F.col(fmt)).alias("_p"))
    sizes = families.select(F.col(family).alias("family"), F.col(n_cols).alias("_n_cols")).dropDuplicates(["family"])
    p = p.select(key, "family", "_p.*").join(sizes, "family", "left")
    body = F.translate("body", "\r\n \t", "")
    p = p.withColumn("sequence_text", body)
    length = F.char_length("sequence_text")
    reason = (
        F.when(F.col("reason").isNotNull(), F.col("reason"))
        .when(length == 0, "empty")
        .when(F.translate("sequence_text", ALPHABET, "") != "", "symbol")
        .when(F.col("_n_cols").isNull() | (length != F.col("_n_cols")), "length")
    )
    p = p.withColumn("reason", reason)
    states = F.transform(F.split("sequence_text", ""), lambda c: F.instr(F.lit(ALPHABET), c) - 1)
    return p.select(
        key,
        "family",
        "header",
        "sequence_text",
        F.when(F.col("reason").isNull(), states).alias("states"),
        "reason",
        "error_line",
        "error_at",
        "n_records",
        "n_errors",
    )
