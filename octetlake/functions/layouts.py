"""Vendor headers as layout tables, with one decoder and one encoder for all of them.

The widths, orders and names of fields are fixed by the formats.

A layout is a list of fields (name, offset, width, kind): kind 'be' or 'le' for unsigned integers, 's' for
text up to the first NUL, 'x' for hex digits. Sizes and orders are those of the formats.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

from octetlake.functions import lens


class Field(NamedTuple):
    name: str
    offset: int
    width: int
    kind: str


def layout(*fields: tuple[str, int, str], start: int = 0) -> list[Field]:
    """Fields in a row from (name, width, kind); a name that begins with '_' is only a gap."""
    out, at = [], start
    for name, width, kind in fields:
        if name[0] != "_":
            out.append(Field(name, at, width, kind))
        at += width
    return out


LAYOUTS: dict[str, list[Field]] = {
    "trx": layout(("magic", 4, "s"), ("length", 4, "le"), ("crc32", 4, "le"), ("flags", 2, "le"), ("version", 2, "le"), ("offset0", 4, "le"), ("offset1", 4, "le"), ("offset2", 4, "le")),
    "uimage": layout(
        ("magic", 4, "x"), ("header_crc", 4, "be"), ("time", 4, "be"), ("size", 4, "be"), ("load", 4, "be"), ("entry", 4, "be"), ("data_crc", 4, "be"), ("os", 1, "be"), ("arch", 1, "be"),
        ("type", 1, "be"), ("compression", 1, "be"), ("name", 32, "s"),
    ),
    "dlob": layout(("magic", 4, "x"), ("header_size", 4, "be"), ("data_size", 4, "be")),
    "tplink": layout(
        ("version", 4, "be"), ("vendor", 24, "s"), ("fw_version", 36, "s"), ("product_id", 4, "be"), ("product_ver", 4, "be"), ("_", 4, "x"), ("md5", 16, "x"), ("_", 4, "x"), ("kernel_md5", 16, "x"),
        ("_", 4, "x"), ("kernel_load", 4, "be"), ("kernel_entry", 4, "be"), ("fw_length", 4, "be"), ("kernel_offset", 4, "be"), ("kernel_length", 4, "be"), ("rootfs_offset", 4, "be"),
        ("rootfs_length", 4, "be"), ("boot_offset", 4, "be"), ("boot_length", 4, "be"), ("ver_hi", 2, "be"), ("ver_mid", 2, "be"), ("ver_lo", 2, "be"),
    ),
    "seama": layout(("magic", 4, "x"), ("_", 2, "x"), ("meta_size", 2, "be"), ("image_size", 4, "be")),
    "u2nd": layout(("magic", 4, "s"), ("_", 4, "x"), ("year", 1, "be"), ("month", 1, "be"), ("day", 1, "be"), ("version", 3, "x"), ("id", 4, "s"), ("hardware", 1, "be"), ("serial", 1, "be"), ("flags", 2, "le"), ("_", 10, "x")),
    "chk": layout(("magic", 4, "s"), ("header_len", 4, "be"), ("_", 8, "x"), ("kernel_sum", 4, "be"), ("rootfs_sum", 4, "be"), ("kernel_len", 4, "be"), ("rootfs_len", 4, "be"), ("image_sum", 4, "be"), ("header_sum", 4, "be")),
    "edimax": layout(("signature", 4, "s"), ("start", 4, "le"), ("flash", 4, "le"), ("model", 4, "s"), ("size", 4, "le")),
    "motorola": layout(("crc32", 4, "be"), ("flags", 4, "le")),
    "mbr_entry": layout(("active", 1, "le"), ("chs_start", 3, "x"), ("type", 1, "le"), ("chs_end", 3, "x"), ("start", 4, "le"), ("length", 4, "le")),
    "cramfs": layout(("magic", 4, "le"), ("size", 4, "le"), ("flags", 4, "le"), ("_", 4, "le"), ("signature", 16, "s"), ("crc", 4, "le"), ("edition", 4, "le"), ("blocks", 4, "le"), ("files", 4, "le"), ("name", 16, "s")),
    "squashfs4": layout(
        ("magic", 4, "s"), ("inodes", 4, "le"), ("mkfs_time", 4, "le"), ("block_size", 4, "le"), ("fragments", 4, "le"), ("compression", 2, "le"), ("block_log", 2, "le"), ("flags", 2, "le"), ("ids", 2, "le"),
        ("major", 2, "le"), ("minor", 2, "le"), ("root_inode", 8, "le"), ("bytes_used", 8, "le"), ("id_table", 8, "le"), ("xattr_table", 8, "le"), ("inode_table", 8, "le"), ("directory_table", 8, "le"),
        ("fragment_table", 8, "le"), ("lookup_table", 8, "le"),
    ),
    "linksys_footer": layout(("magic", 9, "s"), ("header_version", 2, "s"), ("length", 5, "s"), ("sku_length", 1, "s"), ("_", 16, "s"), ("cksum", 8, "s"), ("sign_type", 1, "s"), ("signer", 7, "s"), ("_", 1, "s"), ("kernel_offset", 7, "s"), ("_", 1, "s"), ("rootfs_offset", 7, "s")),
    "tar": layout(("name", 100, "s"), ("mode", 8, "s"), ("uid", 8, "s"), ("gid", 8, "s"), ("size", 12, "s"), ("mtime", 12, "s"), ("chksum", 8, "s"), ("typeflag", 1, "s"), ("linkname", 100, "s"), ("magic", 6, "s")),
    "cpio_newc": layout(("magic", 6, "s"), *[(n, 8, "s") for n in ("ino", "mode", "uid", "gid", "nlink", "mtime", "filesize", "devmajor", "devminor", "rdevmajor", "rdevminor", "namesize", "check")]),
    "model_crc": layout(("model", 16, "s"), ("crc32", 4, "be")),
    "magic_crc": layout(("magic", 4, "s"), ("crc32", 4, "be")),
    "airlink": layout(("magic", 4, "s"), ("version", 4, "x"), ("_", 4, "x"), ("kernel_size", 4, "be"), ("file_size", 4, "be"), ("product", 4, "be"), ("boot_sum", 4, "be"), ("_", 4, "x")),
    "buffalo_tag": layout(
        ("product", 32, "s"), ("brand", 32, "s"), ("major", 8, "s"), ("minor", 8, "s"), ("region", 2, "s"), ("region_mask", 4, "be"), ("_", 2, "x"), ("language", 8, "s"), ("platform", 8, "s"),
        ("hardware", 4, "s"), ("hardware_value", 4, "s"), ("_", 24, "x"), ("length", 4, "be"), ("crc", 4, "be"), ("base1", 4, "be"), ("base2", 4, "be"), ("data_length", 4, "be"), ("flag", 1, "be"), ("_", 3, "x"),
    ),
    "umedia": layout(
        ("magic", 4, "x"), ("header_crc", 4, "be"), ("time", 4, "be"), ("size", 4, "be"), ("load", 4, "be"), ("entry", 4, "be"), ("data_crc", 4, "be"), ("os", 1, "be"), ("arch", 1, "be"), ("type", 1, "be"),
        ("compression", 1, "be"), ("name", 20, "s"), ("umedia_magic", 4, "be"), ("board", 4, "be"), ("image_type", 1, "be"), ("load_default", 1, "be"), ("_", 2, "x"),
    ),
    "bcm_tag": layout(
        ("version", 4, "s"), ("company1", 20, "s"), ("company2", 14, "s"), ("chip", 6, "s"), ("board", 16, "s"), ("big_endian", 2, "s"), ("total_length", 10, "s"), ("cfe_address", 12, "s"), ("cfe_length", 10, "s"),
        ("image_start", 12, "s"), ("root_length", 10, "s"), ("kernel_address", 12, "s"), ("kernel_length", 10, "s"), ("dual", 2, "s"), ("inactive", 2, "s"), ("rsa", 20, "s"), ("info1", 30, "s"), ("layout", 4, "s"),
        ("fskernel_crc", 4, "be"), ("info2", 16, "s"), ("image_crc", 4, "be"), ("rootfs_crc", 4, "be"), ("kernel_crc", 4, "be"), ("sequence", 4, "be"), ("real_root_length", 4, "be"), ("header_crc", 4, "be"), ("_", 16, "x"),
    ),
    "eva": layout(("magic", 4, "le"), ("record_length", 4, "le"), ("load", 4, "le"), ("type", 4, "le"), ("packed_size", 4, "le"), ("size", 4, "le"), ("crc32", 4, "le"), ("properties", 1, "le"), ("dictionary", 4, "le"), ("_", 3, "x")),
    "amit": layout(
        ("text1", 14, "s"), ("data_sum", 2, "le"), ("text2", 12, "s"), ("id", 4, "le"), ("address", 4, "le"), ("space", 4, "le"), ("offset", 4, "le"), ("size", 4, "le"), ("_", 16, "x"), ("mark1", 4, "le"),
        ("mark2", 4, "le"), ("address2", 4, "le"), ("kind", 2, "le"), ("header_sum", 2, "le"),
    ),
    "cameo": layout(
        ("checksum", 4, "be"), ("image_size", 4, "be"), ("kernel_size", 4, "be"), ("model", 20, "s"), ("signature", 30, "s"), ("region", 4, "s"), ("version", 12, "s"), ("header_len", 1, "be"), ("tgz", 1, "be"), ("_", 4, "x"),
    ),
    "cas": layout(("type", 4, "le"), ("kernel_offset", 4, "le"), ("kernel_size", 4, "le"), ("id", 4, "le"), ("kernel_sum", 4, "le"), ("magic1", 4, "le"), ("magic2", 4, "le"), ("magic3", 4, "le")),
    "nfs": layout(("type", 4, "le"), ("kernel_offset", 4, "le"), ("kernel_size", 4, "le"), ("fs_offset", 4, "le"), ("fs_size", 4, "le"), ("kernel_sum", 4, "le"), ("fs_sum", 4, "le"), ("id", 4, "le")),
    "csys": layout(("signature", 4, "s"), ("address", 4, "le"), ("size", 4, "le")),
    "dap": layout(("checksum", 4, "be"), ("model", 20, "s"), ("signature", 30, "s"), ("partition", 1, "be"), ("header_len", 1, "be"), ("_", 4, "x"), ("size", 4, "be")),
    "dir615h1": layout(
        ("head", 4, "be"), ("vendor", 4, "be"), ("product", 4, "be"), ("version", 16, "s"), ("type", 4, "be"), ("size", 4, "be"), ("zero", 4, "be"), ("md5", 16, "x"), ("_", 32, "x"), ("checksum", 4, "be"), ("magic", 4, "be"),
    ),
    "fwimage": layout(("magic", 4, "s"), ("version", 256, "s"), ("crc32", 4, "be"), ("_", 4, "x")),
    "fwimage_part": layout(("magic", 4, "s"), ("name", 16, "s"), ("_", 12, "x"), ("memory", 4, "be"), ("index", 4, "be"), ("base", 4, "be"), ("entry", 4, "be"), ("data_size", 4, "be"), ("part_size", 4, "be")),
    "mylo": layout(
        ("magic", 4, "le"), ("crc32", 4, "le"), ("_", 8, "x"), ("vendor", 2, "le"), ("device", 2, "le"), ("sub_vendor", 2, "le"), ("sub_device", 2, "le"), ("revision", 4, "le"), ("version_hi", 4, "le"),
        ("version_lo", 4, "le"), ("flags", 4, "le"),
    ),
    "mylo_block": layout(("type", 4, "le"), ("address", 4, "le"), ("data_length", 4, "le"), ("block_length", 4, "le")),
    "planex": layout(("sha1", 20, "x"), ("version", 8, "s"), ("unknown", 2, "x"), ("data_length", 4, "be")),
    "wrg": layout(("signature", 32, "s"), ("magic1", 4, "le"), ("magic2", 4, "le"), ("size", 4, "le"), ("offset", 4, "le"), ("device", 32, "s"), ("md5", 16, "x")),
    "zcfw": layout(("magic", 4, "s"), ("length", 4, "le"), ("_", 8, "x")),
    "zynos": layout(
        ("address", 4, "be"), ("_", 2, "x"), ("signature", 3, "s"), ("type", 1, "be"), ("size", 4, "be"), ("packed_size", 4, "be"), ("flags", 1, "be"), ("_", 1, "x"), ("sum", 2, "be"), ("packed_sum", 2, "be"),
        ("version", 15, "s"), ("map_address", 4, "be"), ("_", 5, "x"),
    ),
    "usr": layout(("magic", 4, "s"), ("length", 4, "le"), ("crc32", 4, "le"), ("version", 4, "le"), ("compatibility", 2, "le"), ("revision", 2, "le"), ("_", 8, "x")),
    "edips": layout(("signature", 4, "s"), ("length", 4, "le"), ("start", 4, "le")),
    "vxworks": layout(
        ("pattern", 4, "s"), ("_", 4, "x"), ("year", 1, "be"), ("month", 1, "be"), ("day", 1, "be"), ("product0", 1, "be"), ("minor0", 1, "be"), ("_", 1, "x"), ("format", 4, "s"), ("_", 238, "x"), ("product1", 1, "be"),
        ("minor1", 1, "be"), ("major1", 2, "be"), ("_", 2, "x"), ("header_size", 2, "be"), ("checksum", 4, "be"), ("_", 4, "x"), ("_", 48, "x"), ("model", 32, "s"), ("vendor", 32, "s"),
    ),
    "event": layout(("event_id", 8, "be"), ("user_id", 4, "le"), ("kind", 1, "be")),
}


def size(name: str) -> int:
    return max(f.offset + f.width for f in LAYOUTS[name])


def decode_struct(content: Column, name: str, at: Column | int = 0) -> Column:
    """A struct of the layout's fields at an offset; null where the content ends before the header does."""
    off = F.lit(at) if isinstance(at, int) else at
    cols = []
    for f in LAYOUTS[name]:
        where = off + f.offset
        if f.kind == "s":
            v = F.regexp_extract(lens.lens(F.substring(content, where.cast("int") + 1, F.lit(f.width))), r"(?s)^([^\x00]*)", 1)
        elif f.kind == "x":
            v = F.lower(F.hex(F.substring(content, where.cast("int") + 1, F.lit(f.width))))
        else:
            v = F.conv(lens.hex_field(content, where.cast("int"), f.width, f.kind == "be"), 16, 10).cast("long") if f.width < 8 else lens.integer(content, where.cast("int"), 8, f.kind == "be")
        cols.append(v.alias(f.name))
    return F.when(off + size(name) <= F.octet_length(content), F.struct(*cols))


def encode_struct(name: str, values: dict[str, Column]) -> Column:
    """The header's bytes; a field without a value is zero."""
    parts, at = [], 0
    for f in LAYOUTS[name]:
        if f.offset > at:
            parts.append(F.lit(bytes(f.offset - at)))
        v = values.get(f.name)
        if v is None:
            parts.append(F.lit(bytes(f.width)))
        elif f.kind == "s":
            parts.append(F.substring(F.concat(F.encode(v, "ISO-8859-1"), F.lit(bytes(f.width))), F.lit(1), F.lit(f.width)))
        elif f.kind == "x":
            parts.append(F.unhex(v))
        else:
            parts.append(lens.pack(v, f.width, f.kind == "be"))
        at = f.offset + f.width
    return F.concat(*parts)
