"""Checksums and byte transforms of vendor images, as column functions over BINARY columns.

Spark's own crc32, md5, sha1 and sha2 are used where they fit; the order-dependent and word-wise sums
are Arrow functions that handle each value's bytes as one array.
"""

from __future__ import annotations

import binascii
import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def crc32_raw(content: Column) -> Column:
    """CRC-32 (reflected, all ones at the start) without the final inversion."""
    return F.crc32(content).bitwiseXOR(F.lit(0xFFFFFFFF))


def crc32_from_zero(content: Column) -> Column:
    """CRC-32 with start 0 and no inversion, by the linearity of the code."""
    zeros = F.unhex(F.repeat(F.lit("00"), F.octet_length(content)))
    return F.crc32(content).bitwiseXOR(F.crc32(zeros))


def _of_bytes(f: Callable[[np.ndarray], int]) -> Callable[[Column], Column]:
    """A checksum of each value's bytes as bigint; null stays null."""

    @F.arrow_udf(T.LongType())
    def run(col: pa.Array) -> pa.Array:
        return pa.array([None if v is None else int(f(np.frombuffer(v, dtype=np.uint8))) for v in col.to_pylist()], pa.int64())

    return run


def _padded(b: np.ndarray, width: int) -> np.ndarray:
    return np.concatenate([b, np.zeros(-len(b) % width, dtype=np.uint8)])


_REVERSED = np.packbits(np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1)[:, ::-1], axis=1)[:, 0]


def _register(data: bytes, start: int = 0) -> int:
    """The register of the reflected CRC-32 after the data, from a start, without inversions."""
    return zlib.crc32(data, start ^ 0xFFFFFFFF) ^ 0xFFFFFFFF


def _posix_cksum(b: np.ndarray) -> int:
    """By the mirror image: the reflected CRC of the bytes with their bits turned, its bits turned back."""
    n = len(b)
    data = _REVERSED[np.concatenate([b, np.frombuffer(n.to_bytes((n.bit_length() + 7) // 8, "little"), dtype=np.uint8)])].tobytes()
    return int(f"{_register(data):032b}"[::-1], 2) ^ 0xFFFFFFFF


def _sum16(b: np.ndarray) -> int:
    return int(_padded(b, 2).view("<u2").sum(dtype=np.int64)) & 0xFFFF


def _end_around(b: np.ndarray) -> int:
    s = int(_padded(b, 2).view("<u2").sum(dtype=np.int64))
    while s >> 16:
        s = (s & 0xFFFF) + (s >> 16)
    return s


def _two_registers(b: np.ndarray) -> int:
    """c0 adds the bytes and c1 adds c0 at each byte; either is folded to 16 bits."""
    x = b.astype(object) if len(b) > 1 << 24 else b.astype(np.int64)
    fold = lambda v: ((v & 0xFFFF) + (v >> 16)) & 0xFFFFFFFF
    c0, c1 = int(x.sum()) & 0xFFFFFFFF, int((x * np.arange(len(b), 0, -1)).sum()) & 0xFFFFFFFF
    c0, c1 = fold(fold(c0)) & 0xFFFF, fold(fold(c1)) & 0xFFFF
    return (c1 << 16) | c0


def _xor32(b: np.ndarray) -> int:
    w = _padded(b, 4).view("<u4")
    return int(np.bitwise_xor.reduce(w)) if len(w) else 0


#: CRC-16 with polynomial 0x1021, most significant bit first.
crc16_ccitt = _of_bytes(lambda b: binascii.crc_hqx(b.tobytes(), 0))
#: The POSIX cksum value (CRC-32, polynomial 0x04C11DB7, most significant bit first, then the length, inverted).
posix_cksum = _of_bytes(_posix_cksum)
#: Sum of bytes modulo 256, and its two's complement.
sum8 = _of_bytes(lambda b: int(b.sum(dtype=np.int64)) & 0xFF)
sum8_complement = _of_bytes(lambda b: -int(b.sum(dtype=np.int64)) & 0xFF)
#: Sum of bytes modulo 2**32, and what makes up 255 with the sum of bytes.
byte_sum = _of_bytes(lambda b: int(b.sum(dtype=np.int64)) & 0xFFFFFFFF)
sum8_inverted = _of_bytes(lambda b: 0xFF - (int(b.sum(dtype=np.int64)) & 0xFF))
#: Sum of little-endian 16-bit words modulo 2**16 (an odd last byte counts as a word), and its two's complement.
sum16 = _of_bytes(_sum16)
sum16_complement = _of_bytes(lambda b: -_sum16(b) & 0xFFFF)
#: The same sum with the carry added back.
sum16_end_around = _of_bytes(_end_around)
#: XOR, and sum modulo 2**32, of little-endian 32-bit words (the last one padded with zeros).
xor32 = _of_bytes(_xor32)
sum32 = _of_bytes(lambda b: int(_padded(b, 4).view("<u4").sum(dtype=np.uint64)) & 0xFFFFFFFF)
#: Two running sums, each folded to 16 bits: (c1 << 16) | c0.
two_register_sum = _of_bytes(_two_registers)


def _ecc(b: np.ndarray) -> int:
    """Parities of a block of 256 bytes by column and by row bits, as a 22-bit number."""
    block = np.zeros(256, dtype=np.uint8)
    block[: min(256, len(b))] = b[:256]
    bits = np.unpackbits(block, bitorder="little").astype(np.int64)
    place, out = np.arange(2048), 0
    for k in range(11):  # bits 0-2: which bit of the byte; 3-10: which byte
        odd = (place >> k) & 1
        out |= int(bits[odd == 1].sum() & 1) << (2 * k + 1) | int(bits[odd == 0].sum() & 1) << (2 * k)
    return out


def _big_end_around(b: np.ndarray) -> int:
    s = int(_padded(b, 2).view(">u2").sum(dtype=np.int64))
    while s >> 16:
        s = (s & 0xFFFF) + (s >> 16)
    return s


#: Sum of big-endian 16-bit words with the carry added back.
sum16_big_end_around = _of_bytes(_big_end_around)


def signed_crc(start: int = 0):
    """A reflected CRC-32 step over bytes that are taken as signed, from a given start, without inversion."""

    def f(b: np.ndarray) -> int:
        # A negative byte also turns the upper 24 bits of the register. By linearity that is the same as turning the
        # three bytes that follow, and what of it lies beyond the end is turned in the result.
        high = np.concatenate([np.zeros(3, dtype=np.uint8), b >> 7])
        turned = high[2:-1] ^ high[1:-2] ^ high[:-3]
        c = _register((b ^ turned * np.uint8(255)).tobytes(), start)
        for k in range(min(3, len(b))):
            c ^= (0xFFFFFF >> (8 * k)) * int(high[-1 - k])
        return c

    return _of_bytes(f)


def _ecc_bytes(b: np.ndarray) -> int:
    """Three ECC bytes as one number: inverted row parities (two bytes), inverted column parities and two ones."""
    v = ~_ecc(b) & 0x3FFFFF
    return ((v >> 6) << 8) | ((v & 0x3F) << 2) | 3


_PARITY = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).sum(axis=1).astype(np.uint8) & 1


def _eccs(b: np.ndarray) -> np.ndarray:
    """_ecc of each block of 256 bytes, the last one padded with zeros."""
    out = np.zeros(-(-len(b) // 256), dtype=np.int64)
    for at in range(0, len(out), 4096):
        block = _padded(b[256 * at : 256 * (at + 4096)], 256).reshape(-1, 256)
        odd_bytes, column = _PARITY[block], np.bitwise_xor.reduce(block, axis=1)
        rows = np.bitwise_xor.reduce(odd_bytes * np.arange(256, dtype=np.uint8), axis=1)
        part, total = np.zeros(len(block), dtype=np.int64), _PARITY[column].astype(np.int64)
        for k in range(11):
            odd = _PARITY[column & (0xAA, 0xCC, 0xF0)[k]] if k < 3 else (rows >> (k - 3)) & 1
            part |= odd.astype(np.int64) << (2 * k + 1) | (total ^ odd) << (2 * k)
        out[at : at + 4096] = part
    return out


def _of_blocks(f: Callable[[np.ndarray], np.ndarray]) -> Callable[[Column], Column]:
    """The numbers of each value's blocks as an array of bigint; null stays null."""

    @F.arrow_udf(T.ArrayType(T.LongType()))
    def run(col: pa.Array) -> pa.Array:
        return pa.array([None if v is None else f(np.frombuffer(v, dtype=np.uint8)) for v in col.to_pylist()], pa.list_(pa.int64()))

    return run


def _eccs_bytes(b: np.ndarray) -> np.ndarray:
    v = ~_eccs(b) & 0x3FFFFF
    return ((v >> 6) << 8) | ((v & 0x3F) << 2) | 3


#: The 3-byte NAND code, and row and column parities (bit 2k + 1 of bits whose place has bit k set, bit 2k of the others), of every block of 256 bytes, as arrays in the order of the blocks.
nand_ecc_blocks = _of_blocks(_eccs_bytes)
nand_parity_blocks = _of_blocks(_eccs)


def xor_mask(content: Column, key: bytes, offset: int = 0) -> Column:
    """The content XORed with a repeating key that begins at offset."""
    k = np.frombuffer(key, dtype=np.uint8)

    @F.arrow_udf(T.BinaryType())
    def run(col: pa.Array) -> pa.Array:
        out = []
        for v in col.to_pylist():
            b = None if v is None else np.frombuffer(v, dtype=np.uint8)
            out.append(None if b is None else (b ^ k[(np.arange(len(b)) + offset) % len(k)]).tobytes())
        return pa.array(out, pa.binary())

    return run(content)


def xor_chain(content: Column, undo: bool = False) -> Column:
    """Each byte XORed with all bytes before it and with the low byte of the CRC-16 (start 0xFFFF) of the plain content,
    the CRC behind the coded bytes, low byte first; or, with undo, the plain content, null where the CRC does not fit."""

    def code(b: np.ndarray) -> bytes:
        crc = binascii.crc_hqx(b.tobytes(), 0xFFFF)
        return (np.bitwise_xor.accumulate(b) ^ np.uint8(crc & 255)).tobytes() + crc.to_bytes(2, "little")

    def plain(b: np.ndarray) -> bytes | None:
        if len(b) < 2:
            return None
        crc, body = int(b[-2]) | int(b[-1]) << 8, b[:-2]
        out = (body ^ np.concatenate([np.array([crc & 255], dtype=np.uint8), body[:-1]])[: len(body)]).tobytes()
        return out if binascii.crc_hqx(out, 0xFFFF) == crc else None

    @F.arrow_udf(T.BinaryType())
    def run(col: pa.Array) -> pa.Array:
        f = plain if undo else code
        return pa.array([None if v is None else f(np.frombuffer(v, dtype=np.uint8)) for v in col.to_pylist()], pa.binary())

    return run(content)


def hmac_sha1(content: Column, key: bytes) -> Column:
    """HMAC with SHA-1, composed of Spark's sha1, as hex."""
    import hashlib

    k = (hashlib.sha1(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    inner, outer = bytes(x ^ 0x36 for x in k), bytes(x ^ 0x5C for x in k)
    return F.sha1(F.concat(F.lit(outer), F.unhex(F.sha1(F.concat(F.lit(inner), content)))))


def keyed_md5(content: Column, offset: int, key: bytes) -> Column:
    """MD5 of the content with the field at offset overwritten by key, as hex."""
    return F.md5(F.concat(F.substring(content, F.lit(1), F.lit(offset)), F.lit(key), F.substring(content, F.lit(offset + len(key) + 1), F.lit((1 << 31) - 1))))


def is_sparse(content: Column) -> Column:
    """Nothing but zero bytes."""
    return F.decode(content, "ISO-8859-1").rlike(r"(?s)^\x00*\z")


#: Fewer values than this are coded one by one.
_SIDE_BY_SIDE = 32


def feedback_cipher(content: Column, key: bytes, undo: bool = False) -> Column:
    """The content under the PC1 stream cipher of vendor images (a key of 16 bytes), or, with undo, the plain content.

    Eight 16-bit words of the key run through a multiplying register, whose outputs together give one byte of
    the stream; then the plain byte is mixed into all bytes of the key. The constants are those of the
    cipher. Each byte depends on all before it, so the values of a batch step together, byte by byte.
    """
    if len(key) != 16:
        raise ValueError("the key has 16 bytes")

    start = np.frombuffer(key, dtype=">u2").astype(np.uint32)

    def onwards(data: bytes, words: list[int], total: int, last: int) -> bytes:
        """The rest of one value, from the registers before it."""
        out = bytearray()
        for byte in data:
            x = mixed = 0
            for i, word in enumerate(words):
                x ^= word
                step = 346 * x
                total = ((total + i) * 20021 + step + last) & 0xFFFF
                last = step & 0xFFFF
                x = (x * 20021 + 1) & 0xFFFF
                mixed ^= x ^ total
            coded = byte ^ (mixed >> 8) ^ (mixed & 255)
            out.append(coded)
            plain = 0x101 * (coded if undo else byte)
            words = [w ^ plain for w in words]
        return bytes(out)

    def code(values: list[bytes]) -> list[bytes]:
        """All values byte by byte, side by side, as long as many go on; the few longest are finished one by one."""
        order = sorted(range(len(values)), key=lambda k: -len(values[k]))
        sizes = np.array([len(values[k]) for k in order])
        data = np.frombuffer(b"".join(values[k] for k in order), dtype=np.uint8)
        first = np.concatenate([[0], np.cumsum(sizes)])[:-1]
        coded_all = np.zeros(len(data), dtype=np.uint8)
        words = np.repeat(start[:, None], len(values), axis=1)
        total, last = (np.zeros(len(values), dtype=np.uint32) for _ in range(2))
        t = 0
        while (live := int(np.searchsorted(-sizes, -t, side="left"))) >= _SIDE_BY_SIDE:
            w, tot, la = words[:, :live], total[:live], last[:live]
            x, mixed = (np.zeros(live, dtype=np.uint32) for _ in range(2))
            for i in range(8):
                x ^= w[i]
                step = 346 * x
                tot = ((tot + np.uint32(i)) * np.uint32(20021) + step + la) & np.uint32(0xFFFF)
                la = step & np.uint32(0xFFFF)
                x = (x * np.uint32(20021) + np.uint32(1)) & np.uint32(0xFFFF)
                mixed ^= x ^ tot
            total[:live], last[:live] = tot, la
            byte = data[first[:live] + t]
            coded = byte ^ ((mixed >> np.uint32(8)) ^ mixed).astype(np.uint8)
            coded_all[first[:live] + t] = coded
            w ^= (coded if undo else byte).astype(np.uint32) * np.uint32(0x101)
            t += 1
        out = [b""] * len(values)
        for n, k in enumerate(order):
            done = min(t, len(values[k]))
            head = coded_all[first[n] : first[n] + done].tobytes()
            out[k] = head + onwards(values[k][done:], words[:, n].tolist(), int(total[n]), int(last[n]))
        return out

    @F.arrow_udf(T.BinaryType())
    def run(col: pa.Array) -> pa.Array:
        there = code(col.drop_null().to_pylist())
        rest = iter(there)
        return pa.array([next(rest) if ok else None for ok in col.is_valid().to_pylist()], pa.binary())

    return run(content)


@F.arrow_udf(T.LongType())
def crc32_onwards(register: pa.Array, content: pa.Array) -> pa.Array:
    """The register of CRC-32 after more bytes, from the register before them, without inversions."""
    return pa.array([None if r is None or v is None else _register(v, r & 0xFFFFFFFF) for r, v in zip(register.to_pylist(), content.to_pylist(), strict=True)], pa.int64())
