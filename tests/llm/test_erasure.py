import hashlib
import math
import os
import random
import time
import zlib
from datetime import datetime, timedelta

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from litgrid.llm import erasure

CLIENTS = "client_id bigint, master_id bigint, name string, updated_at timestamp_ntz, balance double"
CLICKS = "click_id bigint, client_id bigint, kind string, value double, props string, fine boolean, day date"
SALES = "sale_id bigint, client_id bigint, total double, priority int"
LINES = "sale_id bigint, line_no int, amount double, flag string"


@pytest.fixture(scope="module")
def shop():
    rng = random.Random(8)
    at = datetime(2024, 1, 1)
    clients = [(i, rng.choice([i, i, i // 2, None]), rng.choice(["a", "b\0", "", None, "é" * 300]), at + timedelta(seconds=rng.randrange(10**6)), rng.choice([None, -1.505, 0.0, 2.675, -0.0, 12.34])) for i in range(300)]
    clients += [(None, 11, "no id", at, 1.0), clients[5], clients[5], (2, 999, "two masters", None, 3.0)]
    client = lambda: rng.choice([7, 7, 7, None, *range(300), 5000])
    clicks = [(i, 7 if rng.random() < 0.35 else client(), rng.choice(["x", None, "y,z"]), rng.choice([None, 5.25, -7.005, float(i)]), '{"k": 1}' * rng.randrange(3), rng.choice([True, False, None]), at.date()) for i in range(1500)]
    clicks += [clicks[3]] * 400 + [(None, None, None, None, None, None, None)] * 2
    sales = [(i, 7 if rng.random() < 0.3 else client(), rng.choice([None, 9.99, 100.0]), rng.randrange(5)) for i in range(700)]
    sales += [sales[9], (33, 1, 1.0, 1), (33, None, 1.0, 1), (None, 7, 1.0, 1)]
    lines = [(44 if rng.random() < 0.35 else rng.choice([None, 9999, *range(700)]), rng.randrange(9), rng.choice([None, 10.005, 3.0]), rng.choice(["f", None])) for _ in range(2500)]
    lines += [lines[0]] * 300
    return {"clients": clients, "clicks": clicks, "sales": sales, "sale_lines": lines}


def brute(shop, files=250, share=200):
    crc = lambda c: zlib.crc32(("" if c is None else str(c)).encode())
    of_sale = {}
    for s, c, *_ in shop["sales"]:
        if s is not None and c is not None:
            of_sale[s] = min(c, of_sale.get(s, c))
    client = {"clients": lambda r: r[0], "clicks": lambda r: r[1], "sales": lambda r: r[1], "sale_lines": lambda r: of_sale.get(r[0])}
    money = {"clients": 4, "clicks": 3, "sales": 2, "sale_lines": 2}
    of_master = {}
    for c, m, *_ in shop["clients"]:
        if m is not None:
            of_master.setdefault(m, set()).add(c)
    n_clicks = {m: sum(r[1] in cs and r[1] is not None for r in shop["clicks"]) for m, cs in of_master.items()}
    most = min(of_master, key=lambda m: (-n_clicks[m], m), default=None)
    masters = {m for m in of_master if m == most or crc(m) % share == 0}
    gone = {r[0] for r in shop["clients"] if r[1] in masters and r[0] is not None and r[1] is not None}
    sales = {r[0] for r in shop["sales"] if r[1] in gone and r[0] is not None}
    erased = {"clients": lambda r: r[1] in masters, "clicks": lambda r: r[1] in gone, "sales": lambda r: r[1] in gone, "sale_lines": lambda r: r[0] in sales}
    out = {}
    for name, rows in shop.items():
        rows = sorted(rows, key=lambda r: (crc(client[name](r)), *[(v is not None, v if v is not None else 0) for v in r]))
        size = 1 + len(rows) // files
        for k in range(0, len(rows), size):
            whole = rows[k : k + size]
            kept = [r for r in whole if not erased[name](r)]
            if kept:
                cents = sum(math.floor(100 * (r[money[name]] or 0) + 0.5) for r in kept)
                sha = hashlib.sha256(",".join("" if r[0] is None else str(r[0]) for r in kept).encode()).hexdigest()
                out[name, k // size] = (len(kept), len(whole) - len(kept), cents, len(kept) < len(whole), sha, kept)
    return out


def frames(spark, shop):
    schemas = {"clients": CLIENTS, "clicks": CLICKS, "sales": SALES, "sale_lines": LINES}
    return {n: spark.createDataFrame(rows, schemas[n]).repartition(3) for n, rows in shop.items()}


def check(spark, shop, files, share):
    tables = frames(spark, shop)
    got = erasure.erase(*tables.values(), files=files, share=share).collect()
    want = brute(shop, files, share)
    assert {(r["table_name"], r["file_no"]) for r in got} == set(want)
    for r in got:
        n, gone, cents, rewritten, sha, kept = want[r["table_name"], r["file_no"]]
        assert (r["n_rows"], r["n_erased"], r["cents"], r["rewritten"], r["ids_sha256"]) == (n, gone, cents, rewritten, sha)
        assert r["columns"] == ",".join(tables[r["table_name"]].columns)
        written = pq.read_table(r["path"])
        assert [tuple(x.values()) for x in written.to_pylist()] == kept
        meta = pq.ParquetFile(r["path"]).metadata
        for k in range(meta.num_row_groups):
            stats = meta.row_group(k).column(0).statistics
            ids = [x[0] for x in kept if x[0] is not None]
            assert not stats.has_min_max or (min(ids) <= stats.min and stats.max <= max(ids))
    if got:
        top = os.path.dirname(os.path.dirname(got[0]["path"]))
        left = {os.path.join(d, f) for d, _, names in os.walk(top) for f in names if not f.startswith(".")}
        assert left == {r["path"] for r in got}
    return got


def test_files_match_brute_force(spark, shop):
    got = check(spark, shop, 25, 20)
    assert any(r["rewritten"] for r in got) and not all(r["rewritten"] for r in got)
    again = erasure.erase(*frames(spark, shop).values(), files=25, share=20).collect()
    assert {r["path"] for r in again}.isdisjoint(r["path"] for r in got)  # a new folder at every call
    assert sorted(r["ids_sha256"] for r in again) == sorted(r["ids_sha256"] for r in got)


def test_small_and_empty_tables(spark, shop):
    none = {n: [] for n in shop}
    assert check(spark, none, 250, 200) == []
    check(spark, shop | {"sales": [], "clicks": []}, 5, 1)  # every master is a victim, no clicks decide
    check(spark, shop | {"clients": []}, 5, 1)
    few = {"clients": [(1, 1, "a", None, None), (2, None, "b", None, 1.0)], "clicks": [(1, 1, "k", 1.0, "", True, None)], "sales": [], "sale_lines": [(5, 1, 2.5, None)]}
    assert {(r["table_name"], r["n_rows"]) for r in check(spark, few, 250, 200)} == {("clients", 1), ("sale_lines", 1)}


def seconds(run):
    took = []
    for _ in range(3):
        start = time.perf_counter()
        run()
        took.append(time.perf_counter() - start)
    return min(took)


def test_columns_become_values_fast_and_come_back():
    texts = pa.array([None, "", "=", "a\0b", "é" * 300, "\U0001f600x"])
    times = pa.array([None, 0, -5, 2**62], pa.timestamp("us"))
    for column in (texts, texts.cast(pa.large_string()), times, pa.array([None, -1, 2**63 - 1]), pa.array([3, 4]), pa.array([True, None, False]), pa.array([None, -0.0, 1.5, float("inf")]), pa.array([0, None], pa.date32()), pa.array([], pa.string())):
        values = erasure.sortable(column)
        assert all(type(v) in (int, str, float) for v in values)
        assert erasure.column_of(values, column.type).equals(column)
    for column in (pa.array(range(200_000)), pa.array([f"text {i}" for i in range(200_000)]), pa.array(range(200_000)).cast(pa.timestamp("us"))):
        assert seconds(lambda c=column: erasure.sortable(c)) < seconds(lambda c=column.cast(pa.int64()) if pa.types.is_timestamp(column.type) else column: c.to_pylist()) / 2


def test_other_types_are_refused(spark, shop):
    tables = frames(spark, {n: rows[:2] for n, rows in shop.items()})
    tables["clients"] = tables["clients"].selectExpr("*", "array(1) as a")
    with pytest.raises(Exception, match="not sorted here"):
        erasure.erase(*tables.values())
