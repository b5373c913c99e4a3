"""Byte comparison where documents are empty, null, without an id, or share one."""

from collections import Counter

import duckdb
import pytest

from octetlake.operators import diff
from octetlake.plans import catalog


@pytest.fixture(scope="module")
def odd_dir(spark, tmp_path_factory):
    """Documents of which a third is odd: an empty text alone made the queries fail."""
    text = lambda i: ("abcé"[i % 4] * (i * i % 41) + "same line of text " * (i % 5)) * (1 + 30 * (i % 17 == 0))
    rows = [(i, text(i)) for i in range(60)]
    rows += [(60 + i, "" if i % 3 < 2 else text(i)) for i in range(9)] + [(69 + i, "") for i in range(3)]  # a group has nothing but empty ones
    rows += [(72 + i, None if i % 3 == 1 else text(i)) for i in range(9)] + [(81 + i, None) for i in range(3)]
    rows += [(None, "of no group"), (None, ""), (None, None)]
    rows += [(90 + i // 4, text(i)) for i in range(24)] + [(102, "of many " + text(i)) for i in range(50)]
    rows += [(-1 - i, text(i + 3)) for i in range(7)] + [(2**60 + i, text(i + 5)) for i in range(9)]
    made = tmp_path_factory.mktemp("odd")
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{made}/documents.parquet")
    return made


def _agrees(name, spark, d):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from read_parquet('{d}/documents.parquet/*.parquet')")
    cur = con.execute(catalog.ORACLES[name])
    cols = [c[0] for c in cur.description]
    want = Counter(cur.fetchall())
    assert Counter(tuple(r[c] for c in cols) for r in catalog.QUERIES[name](spark, str(d)).collect()) == want and len(want) > 30


def test_classes_of_odd_documents(spark, odd_dir):
    _agrees("hexdiff_classes", spark, odd_dir)


def test_collapse_of_odd_documents(spark, odd_dir):
    _agrees("hexdiff_collapse", spark, odd_dir)


@pytest.mark.parametrize("at_once", [1, 2, 256])
def test_cells_of_equal_ord(spark, monkeypatch, at_once):
    """Files of equal ord are columns of their own, the longer one first; null is an empty file; groups of many files are cut shorter."""
    monkeypatch.setattr(diff, "_AT_ONCE", at_once)
    groups = {0: [(0, b"ab" * 30), (1, b"abab" * 4), (1, b"ab"), (2, None)], 1: [(k % 7, bytes([k]) * (90 - k)) for k in range(40)], 2: [(0, b""), (0, None)], 3: [(None, b"a"), (5, b"ab")]}
    df = spark.createDataFrame([(g, k, c) for g, fs in groups.items() for k, c in fs] + [(None, 0, b"abc")], "group_id long, ord long, content binary")
    want = {}
    for g, fs in groups.items():
        cs = [c or b"" for _, c in sorted(fs, key=lambda f: (f[0] is not None, f[0] or 0, -len(f[1] or b"")))]
        for at in range(0, max(map(len, cs)), 16):
            cells = []
            for i in range(at, min(at + 16, max(map(len, cs)))):
                v = [c[i : i + 1] for c in cs]
                kinds = len({x for x in v if x}) + v.count(b"")
                cells.append((" ".join(x.hex().upper() or "XX" for x in v), "red" if kinds == len(cs) else "green" if kinds == 1 else "blue"))
            k = Counter(c[1] for c in cells)
            want[g, at] = (cells, "red" if k["red"] else "blue" if k["blue"] else "green", k["green"], k["blue"], k["red"])
    got = {(r.group_id, r.offset): ([tuple(c) for c in r.cells], *r[3:]) for r in diff.hex_diff(df).collect()}
    assert got == want
    assert {(r.group_id, r.offset): tuple(r[2:]) for r in diff.hex_diff(df, cells=False).collect()} == {k: v[1:] for k, v in want.items()}
