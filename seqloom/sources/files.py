"""Reading and writing of FASTA, structure and model files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.operators.alignment import decode, encode

#: Fixed: three-letter names of the residues; any other is X.
RESIDUES = {
    "ALA": "A", "CYS": "C", "ASP": "D", "GLU": "E", "PHE": "F", "GLY": "G", "HIS": "H", "ILE": "I", "LYS": "K", "LEU": "L",
    "MET": "M", "ASN": "N", "PRO": "P", "GLN": "Q", "ARG": "R", "SER": "S", "THR": "T", "VAL": "V", "TRP": "W", "TYR": "Y",
}


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """header and states of the records that hold no letter outside the alphabet; files are split at the records' marks."""
    text = spark.read.option("lineSep", ">").text(path).where(F.trim(F.regexp_replace("value", r"[\r\n]", "")) != "")
    parts = text.select(F.regexp_extract("value", r"^([^\r\n]*)", 1).alias("header"), F.regexp_replace(F.regexp_replace("value", r"^[^\r\n]*", ""), r"[\s]", "").alias("body"))
    out = parts.select("header", encode(F.col("body")).alias("states"))
    return out.where((F.size("states") > 0) & ~F.exists("states", lambda s: s < 0))


def write_fasta(rows: DataFrame, path: str, header: str = "header", states: str = "states") -> None:
    """One record a row; an existing folder is an error."""
    rows.select(F.concat(F.lit(">"), F.coalesce(F.col(header).cast("string"), F.lit("")), F.lit("\n"), decode(F.col(states))).alias("value")).write.mode("errorifexists").text(path)


def read_structure(spark: SparkSession, path: str, chain: str = "A") -> DataFrame:
    """number and letter of the residues of a chain, in order, from fixed-width ATOM lines of the first model."""
    lines = spark.read.text(path).where(F.col("value").startswith("ATOM"))
    at = lambda start, n: F.trim(F.substring("value", start, n))
    atoms = lines.select(at(22, 1).alias("chain"), at(23, 4).cast("int").alias("number"), at(27, 1).alias("insertion"), at(18, 3).alias("name")).where(F.col("chain") == chain)
    names = F.create_map(*[F.lit(x) for kv in RESIDUES.items() for x in kv])
    one = atoms.groupBy("number", "insertion").agg(F.min("name").alias("name"))
    return one.select("number", "insertion", F.coalesce(F.try_element_at(names, F.col("name")), F.lit("X")).alias("letter")).orderBy("number", "insertion")


def write_model(path: str, fields: DataFrame, couplings: DataFrame | None = None) -> None:
    """A model as one folder with a Parquet table for each kind of parameter."""
    fields.write.mode("errorifexists").parquet(f"{path}/fields")
    if couplings is not None:
        couplings.write.mode("errorifexists").parquet(f"{path}/couplings")


def read_model(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{path}/fields"), spark.read.parquet(f"{path}/couplings")


def table_hash(df: DataFrame) -> int:
    """A hash of a table's rows that doesn't depend on their order."""
    h = F.xxhash64(*[F.col(f"`{c}`") for c in sorted(df.columns)]).cast("decimal(38,0)")
    return int(df.agg(F.sum(h)).first()[0] or 0)


def read_npy(spark: SparkSession, path: str) -> DataFrame:
    """path, row and states of the two-dimensional integer arrays in ``.npy`` files, each file read in one task."""
    import io
    from collections.abc import Iterator

    import numpy as np
    import pandas as pd

    def load(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for p, content in zip(f["path"], f["content"], strict=True):
                x = np.load(io.BytesIO(content), allow_pickle=False)
                for k in range(0, len(x), 10_000):
                    part = x[k : k + 10_000].astype(np.int32)
                    yield pd.DataFrame({"path": np.full(len(part), p, object), "row": np.arange(k, k + len(part)), "states": list(part)})

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.npy").load(path).select("path", "content")
    return files.mapInPandas(load, "path string, row long, states array<int>")


def manifest(df: DataFrame, label: str, options: dict[str, object] | None = None) -> dict[str, object]:
    """What a run made: its label, the table's columns, rows and order-free hash, options and versions, ready for JSON."""
    import datetime
    import platform

    clean = {k: v if isinstance(v, (str, int, float, bool, type(None))) else str(v) for k, v in (options or {}).items()}
    return {
        "schema_version": 1,
        "label": label,
        "made_at": datetime.datetime.now(datetime.UTC).isoformat(timespec="seconds"),
        "columns": dict(df.dtypes),
        "rows": df.count(),
        "hash": str(table_hash(df)),
        "options": clean,
        "versions": {"spark": df.sparkSession.version, "python": platform.python_version()},
    }
