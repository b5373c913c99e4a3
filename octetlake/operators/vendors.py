"""Vendor images: headers with lengths and checksums, sealed, verified and repaired by one table.

A format is a layout, its fixed values, the fields that hold lengths, and its checksums in the order in which
they are put in; each says over which bytes it is taken, with its own field (and later ones) zero. Sealing
an image puts all of them in; an image is right if sealing it anew changes nothing; a repair is the sealed
image. Tails (a checksum behind the data) work likewise. Values are fixed by the formats.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from octetlake.functions import checksums as cs
from octetlake.functions import lens
from octetlake.functions.layouts import LAYOUTS, encode_struct, size

BIG = (1 << 31) - 1
Over = Callable[[Column, Column], Column]  # (header, payload) -> the bytes that are summed


class Sum(NamedTuple):
    field: str
    how: Callable[[Column], Column]
    over: Over


class Format(NamedTuple):
    fixed: dict[str, int | str] = {}
    lengths: dict[str, int] = {}  # field: what is added to the payload's length
    sums: list[Sum] = []
    tail: Callable[[Column], Column] | None = None  # the bytes behind the image, of tail_size bytes, from all that comes before
    tail_size: int = 0


def _payload(h: Column, p: Column) -> Column:
    return p


def _header(h: Column, p: Column) -> Column:
    return h


def _whole(h: Column, p: Column) -> Column:
    return F.concat(h, p)


def _from(start: int, stop: int | None = None) -> Over:
    """The image from a byte on (of the header up to stop, if given)."""
    if stop is None:
        return lambda h, p: F.concat(F.substring(h, F.lit(start + 1), F.lit(BIG)), p)
    return lambda h, p: F.substring(h, F.lit(start + 1), F.lit(stop - start))


def _md5(c: Column) -> Column:
    return F.unhex(F.md5(c))


def _sha1(c: Column) -> Column:
    return F.unhex(F.sha1(c))


def _inverted16(c: Column) -> Column:
    return F.lit(0xFFFF) - cs.sum16_end_around(c)


_SALT = bytes([0xDC, 0xD7, 0x3A, 0xA5, 0xC3, 0x95, 0x98, 0xFB, 0xDD, 0xF9, 0xE7, 0xF4, 0x0E, 0xAE, 0x47, 0x38])  # stands in the MD5 field while it is taken

FORMATS: dict[str, Format] = {
    "trx": Format({"magic": "HDR0", "version": 1}, {"length": 28}, [Sum("crc32", cs.crc32_raw, _from(12))]),
    "uimage": Format({"magic": "27051956"}, {"size": 0}, [Sum("data_crc", F.crc32, _payload), Sum("header_crc", F.crc32, _header)]),
    "umedia": Format({"magic": "27051956"}, {"size": 0}, [Sum("data_crc", F.crc32, _payload), Sum("header_crc", F.crc32, _header)]),
    "model_crc": Format({}, {}, [Sum("crc32", F.crc32, _whole)]),
    "magic_crc": Format({}, {}, [Sum("crc32", F.crc32, _header)]),
    "u2nd": Format({"id": "U2ND"}),
    "airlink": Format({"magic": "GMTK", "product": 5}, {"kernel_size": 0, "file_size": 32}),
    "buffalo_tag": Format({"region_mask": 0xFFFFFFFF}, {"length": 160, "data_length": 0}, [Sum("crc", cs.posix_cksum, _whole)]),
    "bcm_tag": Format(
        {"version": "6"}, {},
        [Sum("image_crc", cs.crc32_raw, _payload), Sum("kernel_crc", cs.crc32_raw, _payload), Sum("fskernel_crc", cs.crc32_raw, _payload), Sum("header_crc", cs.crc32_raw, _from(0, 236))],
    ),
    "eva": Format({"magic": 0xFEED1281}, {"packed_size": 0}, [Sum("crc32", F.crc32, _payload)]),
    "amit": Format(
        {"mark1": 0x01014842, "mark2": 0x01000050, "kind": 0x000B}, {"size": 0}, [Sum("data_sum", cs.sum16_end_around, _payload), Sum("header_sum", _inverted16, _header)],
    ),
    "cameo": Format({"header_len": 80}, {"image_size": 0, "kernel_size": 0}, [Sum("checksum", cs.byte_sum, _payload)]),
    "cas": Format({}, {"kernel_size": 0}, [Sum("kernel_sum", cs.sum32, _payload)]),
    "nfs": Format({}, {"kernel_size": 0}, [Sum("kernel_sum", cs.sum32, _payload)]),
    "chk": Format(
        {"magic": "*#$^", "header_len": 40}, {"kernel_len": 0}, [Sum("kernel_sum", cs.two_register_sum, _payload), Sum("image_sum", cs.two_register_sum, _payload), Sum("header_sum", cs.two_register_sum, _header)],
    ),
    "csys": Format({"signature": "CSYS"}, {"size": 2}, tail=lambda c: lens.pack(cs.sum16_complement(F.substring(c, F.lit(13), F.lit(BIG))), 2, big=False), tail_size=2),
    "dap": Format({"header_len": 64}, {"size": 0}, [Sum("checksum", cs.byte_sum, _payload)]),
    "dir615h1": Format({"magic": 305419896}, {"size": 0}, [Sum("md5", _md5, _payload), Sum("checksum", cs.byte_sum, _from(0, 96))]),
    "edimax": Format({}, {"size": 2}, tail=lambda c: lens.pack(cs.sum16_complement(F.substring(c, F.lit(21), F.lit(BIG))), 2, big=False), tail_size=2),
    "fwimage": Format({"magic": "OPEN"}, {}, [Sum("crc32", F.crc32, _from(0, 260))]),
    "fwimage_part": Format({"magic": "PART"}, {"data_size": 0, "part_size": 0}, tail=lambda c: F.concat(lens.pack(F.crc32(c), 4), F.lit(bytes(4))), tail_size=8),
    "mylo": Format({"magic": 0x4C594D00}, {}, [Sum("crc32", F.crc32, _whole)]),
    "motorola": Format({"flags": 0x10577050}, {}, [Sum("crc32", cs.crc32_raw, _from(4))]),
    "planex": Format({"unknown": "0000"}, {"data_length": 0}, [Sum("sha1", _sha1, lambda h, p: F.concat(F.lit(bytes([0, 0, 0, 2])), p))]),
    "seama": Format({"magic": "5ea3a417"}, {"image_size": 0}),
    "tplink": Format({"version": 1}, {"fw_length": 512}, [Sum("md5", _md5, lambda h, p: F.concat(F.substring(h, F.lit(1), F.lit(76)), F.lit(_SALT), F.substring(h, F.lit(93), F.lit(BIG)), p))]),
    "wrg": Format(
        {"magic1": 0x20040220, "magic2": 0x20040220}, {"size": 0}, [Sum("md5", _md5, lambda h, p: F.concat(F.substring(h, F.lit(45), F.lit(36)), p))],
    ),
    "zcfw": Format({"magic": "firm"}, {"length": 8}, tail=lambda c: F.concat(F.lit(bytes(4)), lens.pack(F.crc32(F.concat(F.substring(c, F.lit(17), F.lit(BIG)), F.lit(bytes(4)))), 4)), tail_size=8),
    "zynos": Format({"signature": "SIG"}, {"size": 0}, [Sum("sum", cs.sum16_big_end_around, _payload)]),
    "usr": Format({"magic": "USR0", "version": 0x06235D03, "compatibility": 1, "revision": 1}, {"length": 0}, [Sum("crc32", cs.crc32_raw, _payload)]),
    "edips": Format({"signature": "PS16", "start": 0x80500000}, {"length": 0}),
    "vxworks": Format({"pattern": "W54S", "header_size": 512}, {}, [Sum("checksum", cs.sum32, _whole)]),
}


def _place(header: Column, name: str, field: str, value: Column) -> Column:
    f = next(f for f in LAYOUTS[name] if f.name == field)
    data = value if f.kind == "x" else lens.pack(value, f.width, f.kind == "be")
    return F.overlay(header, data, f.offset + 1, f.width)  # names the header once, so that expressions do not double


def _sealed(parts: DataFrame, name: str) -> DataFrame:
    """parts (header, payload, ...) with `content`, all lengths and checksums put in."""
    f = FORMATS[name]
    for s in f.sums:
        width = next(x.width for x in LAYOUTS[name] if x.name == s.field)
        parts = parts.withColumn("header", _place(F.col("header"), name, s.field, F.lit(bytes(width)) if _is_bytes(name, s.field) else F.lit(0)))
    for s in f.sums:  # one projection each, so that no sum is taken twice
        parts = parts.withColumn("sum", s.how(s.over(F.col("header"), F.col("payload"))))
        parts = parts.withColumn("header", _place(F.col("header"), name, s.field, F.col("sum"))).drop("sum")
    parts = parts.withColumn("content", F.concat("header", "payload"))
    if f.tail:
        parts = parts.withColumn("content", F.concat("content", f.tail(F.col("content"))))
    return parts.drop("header", "payload")


def _is_bytes(name: str, field: str) -> bool:
    return next(x.kind for x in LAYOUTS[name] if x.name == field) == "x"


def _width(name: str) -> int:
    """The header's length, with gaps at its end."""
    return {"u2nd": 32, "bcm_tag": 256, "airlink": 32, "cameo": 80, "eva": 36, "zcfw": 16, "zynos": 48, "usr": 28, "buffalo_tag": 160, "umedia": 64, "fwimage": 268, "tplink": 512, "vxworks": 512}.get(name, size(name))


def seal(images: DataFrame, name: str, values: dict[str, Column] | None = None, payload: str = "payload") -> DataFrame:
    """images with `content`: header and payload in the format, with fixed values, the given ones, lengths and checksums.

    A null payload is an empty one.
    """
    f = FORMATS[name]
    data = F.coalesce(F.col(payload), F.lit(b""))
    fields = {k: F.lit(v) for k, v in f.fixed.items()} | {k: F.octet_length(data) + n for k, n in f.lengths.items()} | (values or {})
    header = F.concat(encode_struct(name, fields), F.lit(bytes(_width(name) - size(name))))
    keep = [c for c in images.columns if c not in ("header", "payload", "content")]
    return _sealed(images.select(*keep, header.alias("header"), data.alias("payload")), name)


def _fixed_bytes(name: str, field: str) -> tuple[int, bytes]:
    f = next(x for x in LAYOUTS[name] if x.name == field)
    v = FORMATS[name].fixed[field]
    if f.kind == "x":
        return f.offset, bytes.fromhex(str(v))
    return f.offset, str(v).encode("latin-1").ljust(f.width, b"\0") if f.kind == "s" else int(v).to_bytes(f.width, "big" if f.kind == "be" else "little")


def verify(images: DataFrame, name: str, content: str = "content") -> DataFrame:
    """images with `payload`, `repaired` (lengths stay, checksums put in anew) instead of content, and `ok` (nothing to repair);
    ok is null for content that is shorter than the header or has another magic. decode_struct gives the fields."""
    f, width = FORMATS[name], _width(name)
    whole = F.col(content)
    data = F.substring(whole, F.lit(width + 1), F.greatest(F.octet_length(whole) - width - f.tail_size, F.lit(0)).cast("int"))
    keep = [c for c in images.columns if c not in (content, "header", "payload", "original", "data", "ok", "repaired")]
    rows = images.select(*keep, whole.alias("original"), F.substring(whole, F.lit(1), F.lit(width)).alias("header"), data.alias("payload"), data.alias("data"))
    rows = _sealed(rows, name)
    fits = F.octet_length("original") >= width + f.tail_size
    for k in ("magic", "signature", "pattern", "id", "magic1"):
        if k in f.fixed:
            at, value = _fixed_bytes(name, k)
            fits = fits & (F.substring("original", at + 1, len(value)) == F.lit(value))
    return rows.select(*keep, F.col("data").alias("payload"), F.col("content").alias("repaired"), F.when(fits, F.col("content") == F.col("original")).alias("ok"))


def footer(content: Column, magic: int) -> Column:
    """The content padded with FF to 1 KiB, the last 12 bytes being its length, a magic and its CRC-32, little-endian."""
    n = F.octet_length(content)
    gap = F.pmod(-(n + 12), F.lit(1024)).cast("int")
    return F.concat(content, F.unhex(F.repeat(F.lit("FF"), gap)), lens.pack(n, 4, big=False), F.lit(magic.to_bytes(4, "little")), lens.pack(F.crc32(content), 4, big=False))


def read_footer(image: Column, magic: int) -> Column:
    """The content under such a footer; null where length, magic or CRC do not fit."""
    end = F.octet_length(image) - 12
    n, crc = lens.integer(image, end, 4, big=False), lens.integer(image, end + 8, 4, big=False)
    data = F.substring(image, F.lit(1), n.cast("int"))
    return F.when((end >= 0) & (n <= end) & (lens.integer(image, end + 4, 4, big=False) == magic) & (F.crc32(data) == crc), data)


def label_header(payload: Column, board: str, version: str, region: str) -> Column:
    """128 bytes of text lines before the payload, and behind it the byte that makes up 255 with the sum of all."""
    text = f"device:{board}\nversion:V{version}\nregion:{region}\n".encode()
    whole = F.concat(F.lit(text.ljust(128, b"\0")), payload)
    return F.concat(whole, lens.pack(cs.sum8_inverted(whole), 1))


def partition_entry(start: Column, length: Column, kind: int = 0x83, active: bool = False, heads: int = 16, sectors: int = 63) -> Column:
    """The 16 bytes of an MBR partition entry, with start and end also as cylinder, head and sector."""

    def chs(at: Column) -> Column:
        sector, head, cylinder = F.pmod(at, F.lit(sectors)) + 1, F.pmod(F.floor(at / sectors), F.lit(heads)), F.floor(at / (sectors * heads))
        return F.concat(lens.pack(head, 1), lens.pack(sector.bitwiseOR(F.shiftright(cylinder, 2).bitwiseAND(F.lit(0xC0))), 1), lens.pack(cylinder.bitwiseAND(F.lit(0xFF)), 1))

    head = F.concat(F.lit(b"\x80" if active else b"\0"), chs(start), F.lit(bytes([kind])), chs(start + length - 1))
    return F.concat(head, lens.pack(start, 4, big=False), lens.pack(length, 4, big=False))


def srecords(lines: DataFrame, line: str = "line") -> DataFrame:
    """lines with type, address, data and ok of each S-record; null for a line that is none.

    A record is S, its type, and hex digits: a count of the bytes that follow, an address of 2 to 4 bytes by
    the type, data, and a checksum, so that all bytes after the type sum up to 255 modulo 256.
    """
    text = F.upper(F.trim(F.col(line)))
    hexa = F.regexp_extract(text, r"^S[0-9]((?:[0-9A-F]{2})+)$", 1)
    body = F.unhex(hexa)
    kind = F.substring(text, 2, 1).cast("int")
    width = F.when(kind.isin(2, 8, 6), 3).when(kind.isin(3, 7), 4).otherwise(2)
    sum_ = F.aggregate(F.split(lens.lens(body), ""), F.lit(0), lambda a, c: a + F.when(c == "", 0).otherwise(F.ascii(c)))
    rows = lines.withColumn("type", F.when(hexa != "", kind)).withColumn("body", F.when(hexa != "", body))
    there = F.col("type").isNotNull()
    return rows.select(
        *lines.columns, "type", F.when(there, F.conv(F.hex(F.substring("body", F.lit(2), width)), 16, 10).cast("long")).alias("address"),
        F.when(there, F.substring(F.col("body"), width + 2, F.greatest(F.octet_length("body") - width - 2, F.lit(0)))).alias("data"),
        F.when(there, (F.octet_length("body") == F.conv(F.hex(F.substring("body", F.lit(1), F.lit(1))), 16, 10).cast("int") + 1) & (sum_ % 256 == 255)).alias("ok"),
    )


def cksum_tag(content: Column, magic: int) -> Column:
    """The content with a tag of 8 bytes behind it: a magic and its POSIX checksum, little-endian."""
    return F.concat(content, F.lit(magic.to_bytes(4, "little")), lens.pack(cs.posix_cksum(content), 4, big=False))


def read_cksum_tag(image: Column, magic: int) -> Column:
    """The content before such a tag; null where there is none or its checksum does not fit."""
    end = F.octet_length(image) - 8
    data = F.substring(image, F.lit(1), F.greatest(end, F.lit(0)))
    tagged = (end >= 0) & (lens.integer(image, end, 4, big=False) == magic)
    return F.when(tagged & (cs.posix_cksum(data) == lens.integer(image, end + 4, 4, big=False)), data)


def fixed_sum(image: Column, at: Column | int) -> Column:
    """The image with the sum of all bytes before a place at that place, in 16 bits, little-endian; null if it is shorter."""
    at = F.lit(at) if isinstance(at, int) else at
    value = lens.pack(cs.byte_sum(F.substring(image, F.lit(1), at)).bitwiseAND(F.lit(0xFFFF)), 2, big=False)
    return F.when(F.octet_length(image) >= at + 2, F.overlay(image, value, at + 1, F.lit(2)))


def retag(image: Column, signature: str, more: bytes) -> Column:
    """An image with a 256-byte tag for another firm: its signature, no certificates, the image's CRC carried on over more bytes, and
    the tag's CRC anew; null if it is shorter. Fields are those of the layout bcm_tag."""
    head = F.overlay(F.substring(image, 1, 256), F.lit(signature.encode().ljust(20, b"\0")), 5, 20)
    head = F.overlay(head, F.lit(bytes(74)), 143, 74)
    head = F.overlay(head, lens.pack(cs.crc32_onwards(lens.integer(image, 216, 4), F.lit(more)), 4), 217, 4)
    head = F.concat(F.substring(head, 1, 236), lens.pack(cs.crc32_raw(F.substring(head, 1, 236)), 4), F.substring(head, 241, 16))
    return F.when(F.octet_length(image) >= 256, F.concat(head, F.substring(image, F.lit(257), F.lit(BIG))))
