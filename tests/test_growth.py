"""What a larger table costs: plans that do not grow with a loop, arrays instead of Python objects, the same results as plain code."""

import bz2
import lzma
import math
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from octetlake.functions import batches, codecs
from octetlake.functions import checksums as cs
from octetlake.operators import archives, diff, filesystems, packages, rules, scan, stats
from octetlake.plans import formats
from octetlake.plans.shared import written


def test_tree_paths_many_levels(spark):
    """Twenty levels whose parents come from an expression; each level's plan must stay as small as the first one's."""
    nodes = spark.range(1, 23).select(F.col("id").alias("k"), F.when(F.col("id") == 1, F.lit(None)).when(F.col("id") == 22, 22).otherwise(F.floor((F.col("id") * 2 - 2) / 2)).cast("long").alias("parent"), F.col("id").cast("string").alias("name"))
    got = {r.k: (r.path, r.depth) for r in packages.tree_paths(nodes, "k", "parent", "name").collect()}
    assert got == {k: ("/".join(map(str, range(1, k + 1))), k - 1) for k in range(1, 22)}  # 22 is its own parent
    planned = written(nodes.where("parent is not null"))._jdf.queryExecution().optimizedPlan()
    assert planned.constraints().isEmpty() and nodes.where("parent is not null").count() == 21


def test_block_statistics_are_plain_ones(spark):
    """Blocks and odd pieces of blobs of every kind against plain counts; islands of blocks are judged beside the blob as they are from their content."""
    rng = np.random.default_rng(1)
    blobs = [b"", None, bytes(range(256)) * 20, bytes(range(256)) * 4 + b"\x55" * 33, rng.integers(0, 256, 5001, dtype=np.uint8).tobytes(), b"abcab" * 300]
    df = spark.createDataFrame(list(enumerate(blobs)), "file_id long, content binary")
    got = {(r.file_id, r.start): r for r in stats.block_stats(df, 1024, ratio=True).collect()}
    want = {(k, at): Counter(v[at : at + 1024]) for k, v in enumerate(blobs) if v for at in range(0, len(v), 1024)}
    assert set(got) == set(want)
    for key, c in want.items():
        n = sum(c.values())
        assert got[key].n == n and abs(got[key].chi_square - (256 * sum(x * x for x in c.values()) / n - n)) < 1e-6
        assert abs(got[key].entropy + sum(x / n * math.log2(x / n) for x in c.values()) / 8) < 1e-9 and 0 < got[key].zlib_ratio <= 1
    odd = {r.file_id: r.o for r in df.select("file_id", stats._odd_places(32, 512.0)(F.col("content")).alias("o")).collect()}
    chi = lambda p: 256 * sum(x * x for x in Counter(p).values()) / len(p) - len(p)
    assert odd == {k: [at for at in range(0, len(v or b""), 32) if chi(v[at : at + 32]) >= 512] for k, v in enumerate(blobs)}
    found = stats.islands(stats.block_stats(df, 256), 0.5, 512)
    rows = lambda **k: sorted(map(tuple, stats.verdicts(found, df, **k).collect()))
    assert rows(block=256) == rows() != []


def test_triples_are_counted_as_arrays(spark, monkeypatch):
    monkeypatch.setattr(stats, "_TRIPLES", 7)
    out = list(stats._triples([pa.RecordBatch.from_arrays([pa.array([b"abcabcabcd", None, b"", b"xyzab", b"abc"], pa.binary())], ["content"])]))
    total = Counter()
    for b in out:
        total.update(dict(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)))
    number = lambda t: int.from_bytes(t, "big")
    assert total == {number(b"abc"): 4, number(b"xyz"): 1} and len(out) > 1


def test_hex_diff_against_bytes(spark, monkeypatch):
    """Cells, classes and numbers of files of all lengths, over several slices, against a look at each byte."""
    monkeypatch.setattr(diff, "_AT_ONCE", 2)
    groups = {0: [b"a" * 70, b"a" * 33 + b"b" * 40, b""], 1: [b"xyz"], 2: [b"0123456789abcdefX", b"0123456789abcdefX"], 3: [b"", b""], 4: [bytes(range(50)), bytes(range(48)), bytes(range(40)) + b"z"]}
    df = spark.createDataFrame([(g, k, c) for g, cs in groups.items() for k, c in enumerate(cs)], "group_id long, ord long, content binary")
    want = {}
    for g, cs in groups.items():
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


def test_cipher_side_by_side_is_one_by_one(spark, monkeypatch):
    """Values of all lengths and null, stepped together and one by one; each is plain again by its key."""
    key = bytes(range(16))
    df = spark.createDataFrame([(k, None if k == 7 else bytes((i * k) % 256 for i in range(k * k % 97))) for k in range(80)], "k long, c binary").coalesce(1)

    def coded() -> dict:
        rows = df.select("k", "c", cs.feedback_cipher(F.col("c"), key).alias("e")).select("k", "c", "e", cs.feedback_cipher(F.col("e"), key, undo=True).alias("p")).collect()
        assert all(r.p == r.c for r in rows)
        return {r.k: r.e for r in rows}

    monkeypatch.setattr(cs, "_SIDE_BY_SIDE", 10**9)  # the loop over one value
    alone = coded()
    monkeypatch.setattr(cs, "_SIDE_BY_SIDE", 4)
    assert coded() == alone and alone[7] is None and alone[0] == b"" and hasattr(cs, "_SIDE_BY_SIDE")


def test_scan_skips_steps_no_rule_asks_for(spark):
    """Rules without the tags once, jump and many cost no join and no window behind the winners; hits are all displayed."""
    df = spark.createDataFrame([(1, b"..MAGI..MAGI"), (2, b"none"), (3, None)], "file_id long, content binary")
    hits = scan.scan(df, rules.parse("0 string MAGI Record"))
    assert sorted((r.file_id, r.offset, r.display) for r in hits.collect()) == [(1, 2, True), (1, 8, True)]
    plan = hits._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Window" not in plan
    many = scan.scan(df, rules.parse("0 string MAGI Record {many}"))
    assert sorted((r.file_id, r.offset, r.display) for r in many.collect()) == [(1, 2, True), (1, 8, False)]


def test_slices_hold_a_few_rows(spark):
    """Slices of binary, text and nested columns are the rows in order, each of a bounded size or one row."""
    a = pa.array([b"x" * (k * k % 50) for k in range(100)] + [b"y" * 5000, None, b""], pa.binary())
    b = pa.array([[str(k)] * (k % 4) for k in range(len(a))], pa.list_(pa.string()))
    parts = list(batches.slices((a, b), 600))
    assert [v for x, _ in parts for v in x.to_pylist()] == a.to_pylist() and [v for _, y in parts for v in y.to_pylist()] == b.to_pylist()
    assert all(len(x) == 1 or x.nbytes + y.nbytes <= 600 for x, y in parts) and len(parts) > 10
    assert list(batches.slices((a[:0],), 600)) == [(a[:0],)]


def _evaluations(df) -> int:
    return df._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython")


def test_package_is_unpacked_once_a_level(spark):
    """Two levels, one worker each; every entry comes out, what is no package has none."""
    e = spark.createDataFrame([(a, k, f"t{k}", bytes([k]) * a) for a in range(30) for k in range(a % 4 + 1)], "archive_id long, ord int, name string, content binary")
    control = e.select("archive_id").distinct().select("archive_id", F.lit(0).alias("ord"), F.lit("./control").alias("name"), F.lit(b"Package: p").alias("content"))
    made = written(archives.build_package(control, e)).unionByName(spark.createDataFrame([(98, b"none"), (99, None)], "archive_id long, content binary"))
    got = archives.read_package(made.coalesce(1))
    assert _evaluations(got) == 2
    rows = {(r.archive_id, r.part, r.name): (r.ord, r.content) for r in got.collect()}
    assert rows == {(a, "data", f"t{k}"): (k, bytes([k]) * a) for a in range(30) for k in range(a % 4 + 1)} | {(a, "control", "./control"): (0, b"Package: p") for a in range(30)}


def test_blobs_are_searched_once(spark, monkeypatch):
    """One search whatever is made of its hits, in slices, with blobs of many hits, none, and null between them."""
    monkeypatch.setattr(batches, "SLICE", 1000)
    blobs = [b"ab" * 700, None, b"", b"xab", b"b" * 3000, *[b"ab" * (k % 9) for k in range(300)]]
    df = spark.createDataFrame(list(enumerate(blobs)), "file_id long, content binary").coalesce(1)
    hits = scan.tested(df, rules.parse("0 string ab Pair\n0 regex b{3} Run"))
    assert _evaluations(hits) == 1
    want = [(k, i, "Pair") for k, v in enumerate(blobs) for i in range(len(v or b"")) if v[i : i + 2] == b"ab"] + [(4, i, "Run") for i in range(0, 3000, 3)]
    assert sorted((r.file_id, r.offset, r.title) for r in hits.collect()) == sorted(want)
    assert sorted(map(tuple, scan.candidates(df, rules.parse("0 string ab Pair")).collect())) == sorted((k, 0, i) for k, i, t in want if t == "Pair")


def test_streams_are_judged_by_pieces(spark, sf_dir):
    """Encoders and validators share one worker; a window is judged as if decoded at once, but what comes out is not kept, nor limited."""
    assert _evaluations(formats.stream_validators(spark, sf_dir)) == 1
    plain = bytes(range(256)) * 900
    for codec in codecs.CODECS:
        whole = codecs._ENCODERS[codec.removesuffix("_modem")](plain)
        whole = whole[:5] + whole[13:] if codec == "lzma_modem" else whole
        rows = [None, b"", plain, whole, whole + b"rest", *[whole[:k] for k in (1, 12, 13, 40, 300, len(whole) - 3)], whole[:60] + b"\xff" * 9 + whole[69:], whole[:-7] + bytes(7)]
        df = spark.createDataFrame(list(enumerate(rows)), "k int, c binary").coalesce(1)
        once = [v is not None and bool(((r := codecs.CODECS[codec](v, codecs.LIMIT))["ok"] or r["truncated"]) and r["data"]) for v in rows]
        got = {r.k: (r.a, r.b) for r in df.select("k", codecs.is_valid(codec, F.col("c"), 1 << 20).alias("a"), codecs.is_valid(codec, F.col("c"), None).alias("b")).collect()}
        assert [got[k] for k in range(len(rows))] == [(v, v) for v in once] and {True, False} == set(once)
    beyond = spark.createDataFrame([("xz", lzma.compress(bytes(codecs.LIMIT + 9))), ("bzip2", bz2.compress(bytes(codecs.LIMIT + 9)))], "k string, c binary")
    assert all(len(r.c) < 33 << 10 for r in beyond.collect())
    assert all(beyond.where(F.col("k") == k).select(codecs.is_valid(k, F.col("c")).alias("v")).first().v for k in ("xz", "bzip2"))
    packed = zlib.compress(bytes(20 << 20))
    tracemalloc.start()
    assert sum(map(len, codecs._pieces("zlib", packed, 64 << 10))) == 20 << 20 and tracemalloc.get_traced_memory()[1] < 1 << 20
    tracemalloc.stop()


def test_dictionaries_fit_the_data(spark):
    """LZMA's tables are made for what a value needs, at least 64 KB and at most preset 1's; heads of streams are those of whole ones."""
    for n, size in ((0, 1 << 16), (1, 1 << 16), (1 << 16, 1 << 16), ((1 << 16) + 1, 1 << 17), (3 << 20, 1 << 20)):
        data = (bytes(range(251)) * (n // 251 + 1))[:n]
        coded = codecs._ENCODERS["lzma"](data)
        assert int.from_bytes(coded[1:5], "little") == size and lzma.decompress(coded) == lzma.decompress(codecs._ENCODERS["xz"](data)) == data
    df = spark.createDataFrame([(k, bytes([k]) * 5000 + b"text") for k in range(9)], "k int, c binary")
    for name in codecs._ENCODERS:
        assert all(r.h == r.w[:20] for r in df.select(codecs.encode_by(F.lit(name), F.col("c"), 20).alias("h"), codecs.encode_by(F.lit(name), F.col("c")).alias("w")).collect())


def test_squashfs_images_are_built_and_walked_once(spark):
    """Images of three codecs: pieces, image, walk and blocks are one worker each, whichever codec an image has."""
    t = spark.createDataFrame([(i, f"d/{k}", bytes([65 + k]) * 700 * k) for i in range(6) for k in range(4)], "image_id long, path string, content binary")
    for images, n in ((filesystems.build_squashfs(t, "xz", 1024), 4), (filesystems.build_squashfs(t, "zlib", 1024).unionByName(filesystems.build_squashfs(t.withColumn("image_id", F.col("image_id") + 6), "lzma", 1024)), 6)):
        got = filesystems.read_squashfs(images)
        assert _evaluations(got) == n
        rows = {(r.image_id, r.path): r.content for r in got.where("kind = 'file'").collect()}
        assert rows == {(i, f"d/{k}"): bytes([65 + k]) * 700 * k for i in range(6 if n == 4 else 12) for k in range(4)}


def test_fuzzy_hashes_step_by_step(spark):
    """Hashes of files taken together against one byte after the other, and scores against a table of edits."""
    rng = np.random.default_rng(3)
    files = [None, b"", b"a", bytes(3000), *[rng.integers(0, 256, int(n), dtype=np.uint8).tobytes() for n in (1, 6, 7, 8, 200, 193, 5000)], *[b"the quick brown fox %d " % k * k for k in range(40)]]
    digits = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"

    def pieces(v: bytes, size: int) -> str:
        out, h, cuts = "", 0x28021967, 0
        for i, x in enumerate(v):
            h = ((h * 0x01000193) & 0xFFFFFFFF) ^ x
            last = [v[i - k] if i >= k else 0 for k in range(7)]
            roll = sum(c * (8 - k) + (c << 5 * k) for k, c in enumerate(last)) & 0xFFFFFFFF
            if roll % size == size - 1 and cuts < 63 or i == len(v) - 1:
                out, h, cuts = out + digits[h & 63], 0x28021967, cuts + 1
        return out

    def plain(v: bytes | None) -> str | None:
        if v is None:
            return None
        size = 3
        while size * 64 < len(v):
            size *= 2
        while size > 3 and len(pieces(v, size)) < 32:
            size //= 2
        return f"{size}:{pieces(v, size)}:{pieces(v, 2 * size)}"

    df = spark.createDataFrame(list(enumerate(files)), "k int, c binary").coalesce(1)
    got = {r.k: r.h for r in df.select("k", diff.fuzzy_hash("c").alias("h")).collect()}
    assert got == {k: plain(v) for k, v in enumerate(files)}

    def common(x: str, y: str) -> int:
        row = [0] * (len(y) + 1)
        for c in x:
            before = 0
            for j, d in enumerate(y, 1):
                before, row[j] = row[j], before + 1 if c == d else max(row[j], row[j - 1])
        return row[-1]

    words = ["".join(rng.choice(list("ABCx"), int(n))) for n in rng.integers(0, 64, 60)]
    assert all(diff._common(x, y) == common(x, y) for x in words for y in words[:9])


def test_written_by_a_column_is_read_by_it(spark):
    """What is written by a column comes back whole, and a reader of one of its values takes only that folder."""
    df = spark.range(40).select(F.concat(F.lit("f"), F.col("id") % 4).alias("format"), "id")
    back = written(df, "format")
    assert sorted(back.select("format", "id").collect()) == sorted(df.collect()) and sorted(written(df).collect()) == sorted(df.collect())
    one = back.where(F.col("format") == "f2")
    assert "PartitionFilters: [isnotnull(format" in one._jdf.queryExecution().executedPlan().toString() and one.count() == 10
