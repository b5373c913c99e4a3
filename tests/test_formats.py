"""Codecs, layouts, checksums and image repair: exact round trips and known values."""

import binascii
import gzip
import lzma
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from octetlake.functions import codecs, lens
from octetlake.functions.checksums import crc32_raw, xor_mask
from octetlake.operators import image, scan
from octetlake.operators.rules import default_rules, parse
from octetlake.sources.blobs import blocks


@pytest.fixture(scope="module")
def blobs(spark):
    rows = [("all", bytes(range(256)) * 20), ("empty", b""), ("null", None), ("text", b"hello <html> world " * 50)]
    return spark.createDataFrame(rows, "file_id string, content binary").cache()


def test_lens_is_exact(blobs):
    got = blobs.select("content", lens.unlens(lens.lens(F.col("content"))).alias("back")).collect()
    assert all(r.content == r.back for r in got)


def test_codecs_round_trip(spark):
    plain = b"some plain bytes " * 400
    rows = [("gzip", gzip.compress(plain)), ("zlib", zlib.compress(plain)), ("xz", lzma.compress(plain)), ("lzma", lzma.compress(plain, lzma.FORMAT_ALONE)), ("gzip", b"no such thing"), ("gzip", None)]
    df = spark.createDataFrame(rows, "codec string, content binary")
    got = [r.d for r in df.select(codecs.decode_by(F.col("codec"), F.col("content")).alias("d")).collect()]
    assert all(plain in [bytes(v) for v in r if isinstance(v, bytes | bytearray)] for r in got[:4])
    assert not any(plain in [v for v in (r or ()) if isinstance(v, bytes | bytearray)] for r in got[4:])


def test_xor_mask_twice_is_nothing(blobs):
    rows = blobs.where("content is not null")
    back = rows.select("content", xor_mask(xor_mask(F.col("content"), b"key"), b"key").alias("b")).collect()
    assert all(r.content == r.b for r in back)


def test_crc(blobs):
    for r in blobs.where("content is not null").select("content", crc32_raw(F.col("content")).alias("c")).collect():
        assert r.c == binascii.crc32(r.content) ^ 0xFFFFFFFF


def test_trx_repair(spark):
    body = struct.pack("<IIIII", 1 << 16, 28, 0, 0, 0)[:16] + b"kernel" * 30
    whole = b"HDR0" + struct.pack("<I", 12 + len(body)) + b"\0\0\0\0" + body
    fixed = spark.createDataFrame([(whole,)], "content binary").select(image.repair_trx(F.col("content")).alias("f")).first().f
    assert fixed[:8] == whole[:8] and fixed[12:] == whole[12:]
    assert struct.unpack("<I", fixed[8:12])[0] == binascii.crc32(whole[12:]) ^ 0xFFFFFFFF


def test_blocks_cover_the_bytes(blobs):
    got = blocks(blobs, 1000, 10).where("file_id = 'all'").orderBy("block_id").collect()
    assert sum(r.dlen for r in got) == 5120 and got[0].start == 0


def test_printf_and_rules(spark):
    rules = parse("0 string MAGI Thing,\n>4 byte x letter %c,\n>5 leshort x count %d\n")
    df = spark.createDataFrame([("a", b"..MAGIZ\x05\x00.")], "file_id string, content binary")
    (r,) = scan.scan(df, rules).collect()
    assert r.offset == 2 and "letter Z" in r.description and "count 5" in r.description
    assert len(default_rules()) > 20


def test_scan_of_nothing(blobs):
    assert scan.scan(blobs.limit(0)).count() == 0


def test_nand_code_of_every_block(spark):
    from octetlake.functions import checksums as cs

    rng = np.random.default_rng(5)
    data = [rng.integers(0, 256, n, dtype=np.uint8).tobytes() for n in (1, 255, 256, 257, 700, 256 * 4097 + 3)] + [b"", None]
    df = spark.createDataFrame([(i, b) for i, b in enumerate(data)], "i int, b binary")
    got = df.select("i", cs.nand_parity_blocks(F.col("b")).alias("p"), cs.nand_ecc_blocks(F.col("b")).alias("e")).orderBy("i").collect()
    for r, b in zip(got, data, strict=True):
        parts = None if b is None else [np.frombuffer(b[k : k + 256], dtype=np.uint8) for k in range(0, len(b), 256)]
        assert r.p == (None if b is None else [cs._ecc(x) for x in parts])
        assert r.e == (None if b is None else [cs._ecc_bytes(x) for x in parts])


def bitwise_crc(data, poly, bits, start=0, final=0):
    c = start
    for x in data:
        c ^= x << (bits - 8)
        for _ in range(8):
            c = ((c << 1) ^ (poly if c >> (bits - 1) else 0)) & ((1 << bits) - 1)
    return c ^ final


def signed_bitwise_crc(data, start=0):
    c = start
    for x in data:
        c ^= (x - 256 if x > 127 else x) & 0xFFFFFFFF
        for _ in range(8):
            c = (c >> 1) ^ (0xEDB88320 if c & 1 else 0)
    return c


def test_crcs_bit_by_bit(spark):
    import hashlib
    import hmac

    from octetlake.functions import checksums as cs

    rng = np.random.default_rng(6)
    data = [rng.integers(0, 256, n, dtype=np.uint8).tobytes() for n in (0, 1, 2, 3, 4, 5, 9, 300)] + [b"123456789", b"\xff" * 7, None]
    c = F.col("b")
    got = spark.createDataFrame([(i, b) for i, b in enumerate(data)], "i int, b binary").select("i", cs.crc16_ccitt(c).alias("x"), cs.posix_cksum(c).alias("p"), cs.signed_crc()(c).alias("s"), cs.signed_crc(77)(c).alias("t"), cs.hmac_sha1(c, b"key").alias("h"), cs.crc32_from_zero(c).alias("z")).orderBy("i").collect()
    for r, b in zip(got, data, strict=True):
        if b is None:
            assert r[1:] == (None,) * 6
            continue
        tail = len(b).to_bytes((len(b).bit_length() + 7) // 8, "little")
        assert (r.x, r.p) == (bitwise_crc(b, 0x1021, 16), bitwise_crc(b + tail, 0x04C11DB7, 32, 0, 0xFFFFFFFF))
        assert (r.s, r.t, r.h) == (signed_bitwise_crc(b), signed_bitwise_crc(b, 77), hmac.new(b"key", b, hashlib.sha1).hexdigest())
        assert r.z == zlib.crc32(b, 0xFFFFFFFF) ^ 0xFFFFFFFF
    assert got[8].p == 930766865


def test_includes_also_hold_for_descriptions(spark):
    rules = parse("0 string MAGI Thing,\n>4 byte x letter %c\n")
    df = spark.createDataFrame([("a", b"MAGIA MAGIB")], "file_id string, content binary")
    assert [r.offset for r in scan.scan(df, rules, ["thing, letter a"]).collect()] == []  # the title has no letter
    both = scan.scan(df, rules, ["thing", "nothing at all"]).collect()
    assert len(both) == 2
    assert [r.offset for r in scan.scan(df, rules, exclude=["letter b"]).collect()] == [0]


def test_strings_take_linear_time(spark):
    import time

    rows = [("a" * 400_000,), ("a" * 9 + "\x00" + "b" * 10 + "\x00" + "c" * 12,), ("d" * 10 + "\x00" + "d" * 9,), ("",), (None,)]
    began = time.time()
    got = [r.s for r in spark.createDataFrame(rows, "t string").select(lens.strings(F.col("t"), 10).alias("s")).collect()]
    assert got == [[], ["b" * 10], ["d" * 10], [], None] and time.time() - began < 20


def test_streams_beyond_the_limit(spark):
    plain = bytes(range(256)) * 4000
    rows = [(1, gzip.compress(plain)), (2, b"junk"), (3, gzip.compress(plain)[:-9]), (4, None)]
    df = spark.createDataFrame(rows, "file_id long, content binary")
    got = {r.file_id: r.d for r in df.select("file_id", codecs.decode("gzip", F.col("content"), 1000).alias("d")).collect()}
    assert got[1].over and not got[1].ok and not got[2].over
    pieces = codecs.parts(df, "gzip", 100_000).orderBy("file_id", "part").collect()
    assert b"".join(bytes(p.data) for p in pieces if p.file_id == 1) == plain and {p.file_id for p in pieces} == {1, 3}
    for codec, packed in (("xz", lzma.compress(plain)), ("bzip2", __import__("bz2").compress(plain)), ("zlib", zlib.compress(plain))):
        one = spark.createDataFrame([(1, packed)], "file_id long, content binary")
        assert b"".join(bytes(p.data) for p in codecs.parts(one, codec, 100_000).orderBy("part").collect()) == plain
