import random
import zipfile
import zlib

import pytest

from litgrid.sources import sheets, workbooks


def test_check_sums_join():
    rng = random.Random(3)
    for size in (0, 1, 7, 300, 70_000):
        a, b = rng.randbytes(rng.randrange(500)), rng.randbytes(size)
        assert workbooks.joined_crc(zlib.crc32(a), zlib.crc32(b), len(b)) == zlib.crc32(a + b)


def test_workbooks_hold_all_rows_in_order(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(workbooks, "STRETCH_BYTES", 200)
    rng = random.Random(5)
    # a third of the rows has one key
    rows = [("a" if i % 3 == 0 else rng.choice(["b", "c/d", ".."]), i, rng.choice([None, "x<&>\x01", "é", ""]), rng.choice([None, 0.5, float("inf")]), i % 2 == 0) for i in range(3000)]
    rng.shuffle(rows)
    rows.append((None, -1, "keyless", 1.0, True))
    first = spark.createDataFrame(rows, "paper string, n int, text string, `a.b` double, flag boolean")
    second = spark.createDataFrame([("b", 2), ("b", 1), ("only", 9)], "paper string, n int")
    folder = str(tmp_path / "books")
    listed = workbooks.write_workbooks({"rows & all": (first, ["n"]), "more": (second, ["n"])}, "paper", folder).collect()
    want = {k: sorted(r for r in rows if r[0] == k) for k in ("a", "b", "c/d", "..")} | {"only": []}
    assert {(r["key"], r["sheet"]): r["n_rows"] for r in listed} == {(k, "rows & all"): len(v) for k, v in want.items()} | {(k, "more"): {"b": 2, "only": 1}.get(k, 0) for k in want}
    assert len({r["path"] for r in listed}) == 5
    for r in listed:
        with zipfile.ZipFile(r["path"]) as z:
            assert z.testzip() is None
        with open(r["path"], "rb") as f:
            data = f.read()
        assert len(data) == r["n_bytes"]
        got = {(s, i, j): v for s, _, i, j, v in sheets.workbook_cells(data)}
        expected = {(0, 0, j): v for j, v in enumerate(["n", "text", "a.b", "flag"])} | {(1, 0, 0): "n"}
        for i, (_, n, text, x, flag) in enumerate(want[r["key"]], 1):
            shown = [str(n), text and text.replace("\x01", ""), None if x is None else str(x), str(flag)]
            expected |= {(0, i, j): v for j, v in enumerate(shown) if v}
        expected |= {(1, i, 0): str(n) for i, n in enumerate({"b": [1, 2], "only": [9]}.get(r["key"], []), 1)}
        assert got == expected
    back = sheets.read_workbooks(spark, f"{folder}/*.xlsx")
    assert back.where("table_no = 0 and row_idx > 0 and col_idx = 0").count() == 3000


def test_no_rows_and_no_sheets(spark, tmp_path):
    none = spark.createDataFrame([], "paper string, n int")
    assert workbooks.write_workbooks({"s": (none, [])}, "paper", str(tmp_path / "none")).count() == 0
    with pytest.raises(ValueError, match="needs a sheet"):
        workbooks.write_workbooks({}, "paper", str(tmp_path / "none"))
