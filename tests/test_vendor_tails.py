"""Ciphers, tags and CRCs of vendor images against plain ones."""

import zlib

from pyspark.sql import functions as F

from octetlake.functions import checksums as cs
from octetlake.operators import vendors


def values(spark, rows, **columns):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, c binary").select("i", *[c.alias(k) for k, c in columns.items()])
    return [{k: bytes(v) if isinstance(v, bytearray) else v for k, v in r.asDict().items() if k != "i"} for r in df.orderBy("i").collect()]


def test_cipher(spark):
    rows = [b"", b"\0", bytes(range(256)) * 3, None, b"same" * 4]
    key = b"0123456789abcdef"
    coded = cs.feedback_cipher(F.col("c"), key)
    got = values(spark, rows, coded=coded, plain=cs.feedback_cipher(coded, key, undo=True))
    assert [g["plain"] for g in got] == rows
    assert got[1]["coded"] == bytes([158]) and got[0]["coded"] == b"" and got[3]["coded"] is None
    assert len({got[4]["coded"][k : k + 4] for k in range(0, 16, 4)}) == 4  # the stream depends on what came before


def test_tags(spark):
    rows = [b"", b"abc", None]
    tagged = vendors.cksum_tag(F.col("c"), 0x04030201)
    got = values(spark, rows, t=tagged, back=vendors.read_cksum_tag(tagged, 0x04030201), other=vendors.read_cksum_tag(tagged, 1), bare=vendors.read_cksum_tag(F.col("c"), 1))
    assert [g["back"] for g in got] == rows and all(g["other"] is None and g["bare"] is None for g in got)
    assert got[0]["t"] == b"\x01\x02\x03\x04" + (0xFFFFFFFF).to_bytes(4, "little")  # POSIX cksum of nothing
    sums = values(spark, [b"\xff" * 600, b"\x01" * 11, b"\x01" * 12, None], s=vendors.fixed_sum(F.col("c"), 10))
    assert [g["s"] for g in sums] == [b"\xff" * 10 + (2550).to_bytes(2, "little") + b"\xff" * 588, None, b"\x01" * 10 + b"\x0a\x00", None]


def test_retag(spark):
    data, filler = bytes(range(256)) * 2, b"!" * 64
    got = values(spark, [data, data[:255], None], r=vendors.retag(F.col("c"), "Another", filler))
    want = bytearray(data)
    want[4:24] = b"Another".ljust(20, b"\0")
    want[142:216] = bytes(74)
    register = int.from_bytes(data[216:220])
    for byte in filler:
        register ^= byte
        for _ in range(8):
            register = register >> 1 ^ (0xEDB88320 if register & 1 else 0)
    want[216:220] = register.to_bytes(4)
    want[236:240] = (zlib.crc32(bytes(want[:236])) ^ 0xFFFFFFFF).to_bytes(4)
    assert [g["r"] for g in got] == [bytes(want), None, None]
