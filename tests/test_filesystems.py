"""File systems: trees written and read back, odd and broken images."""

import os
import struct

import pytest

from octetlake.operators import filesystems as fs

ROWS = [(1, "a/b/c.txt", b"hello" * 3000), (1, "a/d.txt", b""), (1, "z", os.urandom(10000)), (1, "a/null", None), (1, "a/b/copy", b"hello" * 3000), (2, "only", b"x")]
ROWS += [(3, f"d{k % 3}/f{k:04d}", (b"line %d\n" % k) * k) for k in range(900)]  # several metadata blocks, over 256 names in a directory
WANT = {(i, p): c or b"" for i, p, c in ROWS}
BROKEN = [
    (1, None), (2, b""), (3, b"hsqs"), (4, b"\x45\x3d\xcd\x28" + bytes(12) + b"Compressed ROMFS" + b"\xff" * 200),
    (5, b"hsqs" + bytes(8) + struct.pack("<IIHHHHH", 4096, 0, 1, 12, 0, 1, 4) + b"\xff" * 200),
]


@pytest.fixture(scope="module")
def entries(spark):
    return spark.createDataFrame(ROWS, "image_id int, path string, content binary")


def contents(df):
    return {(r.image_id, r.path): r.content if r.content is None else bytes(r.content) for r in df.where("kind = 'file'").collect()}


@pytest.mark.parametrize("codec", ["zlib", "lzma"])
def test_cramfs(entries, codec):
    images = fs.build_cramfs(entries, codec).cache()
    assert all(r.ok for r in fs.check_cramfs(images).collect())
    assert contents(fs.read_cramfs(images)) == WANT


@pytest.mark.parametrize("codec", ["zlib", "xz", "lzma"])
def test_squashfs(entries, codec):
    assert contents(fs.read_squashfs(fs.build_squashfs(entries, codec, 4096))) == WANT


def test_turned_byte(entries, spark):
    """A block that does not inflate costs its file, not the others."""
    good = bytes(fs.build_cramfs(entries.where("image_id = 1")).collect()[0].content)
    at = good.index(b"\x78\x9c") + 3
    bad = good[:at] + bytes([good[at] ^ 255]) + good[at + 1 :]
    images = spark.createDataFrame([(1, bad)], "image_id int, content binary")
    got = contents(fs.read_cramfs(images))
    lost = [k for k, v in got.items() if v is None]
    assert lost and all(got[k] == WANT[k] for k in got if k not in lost) and len(got) == 5
    assert [r.ok for r in fs.check_cramfs(images).collect()] == [False]


def test_directory_that_leads_to_itself(entries, spark):
    good = bytearray(fs.build_cramfs(entries.where("image_id = 2")).collect()[0].content)
    struct.pack_into("<III", good, 76, 0o040755, 20, 1 | 76 // 4 << 6)  # its only record becomes a directory at the root's own table
    images = spark.createDataFrame([(2, bytes(good))], "image_id int, content binary")
    assert [(r.path, r.kind) for r in fs.read_cramfs(images).collect()][0] == ("only", "dir")


@pytest.mark.parametrize(("tags_at", "big"), [(0, False), (2, True)])
def test_yaffs(spark, tags_at, big):
    rows = [
        (1, 257, 1, "dir", "etc", None, None), (1, 258, 257, "file", "conf", None, b"k=v\n" * 2000), (1, 259, 1, "file", "empty", None, None), (1, 260, 257, "hard link", "alias", 258, None),
        (1, 261, 3, "file", "gone", None, b"x"), (2, 257, 1, "file", "one", None, b"y" * 2048),
    ]
    objects = spark.createDataFrame(rows, "image_id int, obj_id bigint, parent_id bigint, kind string, name string, equiv_id bigint, content binary")
    images = fs.build_yaffs(objects, tags_at=tags_at, big=big)
    newer = fs.build_yaffs(objects.where("image_id = 2").selectExpr("image_id", "obj_id", "parent_id", "kind", "'new' name", "equiv_id", "cast('n' as binary) content"), tags_at=tags_at, big=big)
    got = {(r.image_id, r.path): (r.kind, r.size, None if r.content is None else bytes(r.content)) for r in fs.read_yaffs(images, tags_at=tags_at, big=big).collect()}
    conf = b"k=v\n" * 2000
    assert got == {(1, "etc"): ("dir", 0, None), (1, "etc/conf"): ("file", 8000, conf), (1, "empty"): ("file", 0, b""), (1, "etc/alias"): ("hard link", 8000, conf), (2, "one"): ("file", 2048, b"y" * 2048)}
    a, b = bytes(images.where("image_id = 2").collect()[0].content), bytes(newer.collect()[0].content)
    again = spark.createDataFrame([(2, a + b)], "image_id int, content binary")  # the same object written anew further on
    assert [(r.path, bytes(r.content)) for r in fs.read_yaffs(again, tags_at=tags_at, big=big).collect()] == [("new", b"n")]


def test_broken(spark):
    bad = spark.createDataFrame(BROKEN, "image_id int, content binary")
    assert fs.read_cramfs(bad).count() == fs.read_squashfs(bad).count() == fs.read_yaffs(bad).count() == 0
    assert {r.image_id: r.ok for r in fs.check_cramfs(bad).collect()} == {1: None, 2: None, 3: None, 4: False, 5: None}
