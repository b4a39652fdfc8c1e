from seqloom.sources import files as S


def test_fasta_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([("a b", [1, 0, 20]), ("c", [2, 3, 4])], "header string, states array<int>")
    S.write_fasta(rows, str(tmp_path / "out"))
    back = S.read_fasta(spark, str(tmp_path / "out"))
    assert S.table_hash(back) == S.table_hash(rows.repartition(2))
    (tmp_path / "raw.fasta").write_bytes(b">x\r\nAC\r\nD-\r\n>bad\nAXC\n>y\rACDE\r\n")
    got = {r["header"]: r["states"] for r in S.read_fasta(spark, str(tmp_path / "raw.fasta")).collect()}
    assert got == {"x": [1, 2, 3, 0], "y": [1, 2, 3, 4]}


def test_structure(spark, tmp_path):
    line = "ATOM  {:>5}  CA  {} {}{:>4}    {:8.3f}{:8.3f}{:8.3f}  1.00  0.00\n"
    text = "".join(line.format(k, n, c, r, 0, 0, 0) for k, (n, c, r) in enumerate([("ALA", "A", 5), ("ALA", "A", 5), ("XXX", "A", 6), ("TRP", "A", 7), ("GLY", "B", 1)]))
    (tmp_path / "s.pdb").write_text("HEADER\n" + text)
    assert [(r["number"], r["letter"]) for r in S.read_structure(spark, str(tmp_path / "s.pdb")).collect()] == [(5, "A"), (6, "X"), (7, "W")]


def test_model_round_trip(spark, tmp_path):
    h = spark.createDataFrame([("A", 0, 1, 0.5)], "family string, pos int, state int, v double")
    S.write_model(str(tmp_path / "m"), h, h)
    one, two = S.read_model(spark, str(tmp_path / "m"))
    assert S.table_hash(one) == S.table_hash(two) == S.table_hash(h)


def test_npy_and_manifest(spark, tmp_path):
    import json

    import numpy as np

    np.save(tmp_path / "m.npy", np.array([[1, 0, 2], [3, 4, 5]], np.int8))
    x = S.read_npy(spark, str(tmp_path))
    assert [(r["row"], r["states"]) for r in x.orderBy("row").collect()] == [(0, [1, 0, 2]), (1, [3, 4, 5])]
    m = S.manifest(x, "test", {"theta": 0.3, "path": tmp_path})
    assert json.loads(json.dumps(m))["rows"] == 2 and m["hash"] == S.manifest(x.repartition(2), "again")["hash"]
