"""Archives as rows of entries: tar, cpio (newc), packages of a device's package manager, WDK images, web interface indexes.

Building goes from rows (archive_id, ord, name, content) to one blob per archive: each entry is encoded where it
is, and the entries of an archive are put together in order. Reading goes back: a small Arrow function hops
from header to header (where the next one stands depends on the last) and returns places only; names and
contents are cut beside the blob.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from octetlake.functions import checksums as cs
from octetlake.functions import codecs, lens
from octetlake.functions.batches import stepwise
from octetlake.functions.layouts import encode_struct, size
from octetlake.operators.image import join_parts

_PLACES = T.ArrayType(T.StructType([T.StructField(n, T.LongType()) for n in ("header", "name_at", "name_size", "start", "size")] + [T.StructField("kind", T.StringType())]))
_ARROW = pa.list_(pa.struct([*[(n, pa.int64()) for n in ("header", "name_at", "name_size", "start", "size")], ("kind", pa.string())]))


def _octal(value: Column, width: int) -> Column:
    return F.lpad(F.conv(value.cast("string"), 10, 8), width, "0")


def _padded(content: Column, to: int) -> Column:
    gap = F.pmod(-F.octet_length(content), F.lit(to)).cast("int")
    return F.concat(content, F.unhex(F.repeat(F.lit("00"), gap)))


def _together(entries: DataFrame, part: Column, end: bytes) -> DataFrame:
    parts = entries.select(F.col("archive_id").alias("image_id"), "ord", part.alias("content"))
    return join_parts(parts).select(F.col("image_id").alias("archive_id"), F.concat("content", F.lit(end)).alias("content"))


def _read(archives: DataFrame, places) -> DataFrame:
    return _entries(archives.select("archive_id", "content", places(F.col("content")).alias("p")))


def _entries(rows: DataFrame) -> DataFrame:
    """The entries of rows (archive_id, content, p), p being their places."""
    cut = lambda at, n: F.substring(F.col("content"), (at + 1).cast("int"), n.cast("int"))
    name = lambda p: F.regexp_extract(lens.lens(cut(p["name_at"], p["name_size"])), r"(?s)^([^\x00]*)", 1)
    entry = lambda p: F.struct(p["header"].alias("offset"), F.decode(lens.unlens(name(p)), "UTF-8").alias("name"), p["kind"].alias("kind"), p["size"].alias("size"), cut(p["start"], p["size"]).alias("content"))
    rows = rows.select("archive_id", F.transform("p", entry).alias("e"))
    return rows.select("archive_id", F.posexplode("e").alias("ord", "e")).select("archive_id", "ord", "e.*")


def build_tar(entries: DataFrame) -> DataFrame:
    """(archive_id, content) of (archive_id, ord, name, content): ustar headers with checksums, contents padded to 512 bytes."""
    n = F.coalesce(F.octet_length("content"), F.lit(0))
    fields = {
        "name": F.col("name"), "mode": F.lit("0000644"), "uid": F.lit("0000000"), "gid": F.lit("0000000"), "size": _octal(n, 11), "mtime": _octal(F.lit(0), 11), "chksum": F.lit(" " * 8),
        "typeflag": F.lit("0"), "magic": F.lit("ustar"),
    }
    rest = F.concat(F.lit(b"00"), F.lit(bytes(512 - size("tar") - 2)))
    rows = entries.select("archive_id", "ord", F.concat(encode_struct("tar", fields), rest).alias("h"), F.coalesce("content", F.lit(b"")).alias("data"))
    rows = rows.withColumn("sum", cs.byte_sum(F.col("h")))
    head = F.concat(F.substring("h", 1, 148), F.encode(F.concat(_octal(F.col("sum"), 6), F.lit("\0 ")), "ISO-8859-1"), F.substring("h", 157, 512))
    return _together(rows, F.concat(head, _padded(F.col("data"), 512)), bytes(1024))


def _number(text: bytes) -> int | None:
    text = text.strip(b" \0")
    return int(text, 8) if text and not text.strip(b"01234567") else None if text else 0


def _tar_hops(content: pa.Array) -> pa.Array:
    out = []
    for x in content:
        v = x.as_py()
        at, found = 0, []
        while v and v[at + 257 : at + 262] == b"ustar":
            n, checksum = _number(v[at + 124 : at + 136]), _number(v[at + 148 : at + 156])
            if n is None or checksum != sum(v[at : at + 148]) + 256 + sum(v[at + 156 : at + 512]):
                break
            found.append({"header": at, "name_at": at, "name_size": 100, "start": at + 512, "size": n, "kind": chr(v[at + 156])})
            at += 512 + -(-n // 512) * 512
        out.append(found)
    return pa.array(out, _ARROW)


@stepwise(_PLACES)
def tar_places(content: pa.Array) -> pa.Array:
    """The headers of a tar archive, hop by hop, while they have the magic, a size and the right checksum."""
    return _tar_hops(content)


@stepwise(T.StructType([T.StructField("content", T.BinaryType()), T.StructField("p", _PLACES)]))
def _unzipped_tar(content: pa.Array) -> pa.Array:
    """What gzipped archives inflate to, with the places in it; null and none for what is no whole stream."""
    plain = codecs.decoded("gzip", content)
    data = pa.array([r["data"] if r["ok"] else None for r in plain], pa.binary())
    return pa.StructArray.from_arrays([data, _tar_hops(data)], ["content", "p"])


def read_tar(archives: DataFrame) -> DataFrame:
    """(archive_id, ord, offset, name, kind, size, content) of each entry of (archive_id, content); what is no tar has none."""
    return _read(archives, tar_places)


_CPIO_END = b"TRAILER!!!"


def build_cpio(entries: DataFrame) -> DataFrame:
    """(archive_id, content) of (archive_id, ord, name, content) as a newc archive: headers of hex digits, all padded to 4 bytes."""
    hexa = lambda v: F.lpad(F.hex(v.cast("long")), 8, "0")
    name = F.encode("name", "UTF-8")
    data = F.coalesce("content", F.lit(b""))

    def head(size_: Column, name_size: Column, ino: Column) -> Column:
        fields = {"magic": F.lit("070701"), "ino": hexa(ino), "mode": F.lit("000081A4"), "filesize": hexa(size_), "namesize": hexa(name_size)}
        fields |= {k: F.lit("00000000") for k in ("uid", "gid", "mtime", "devmajor", "devminor", "rdevmajor", "rdevminor", "check")} | {"nlink": F.lit("00000001")}
        return encode_struct("cpio_newc", fields)

    entry = F.concat(_padded(F.concat(head(F.octet_length(data), F.octet_length(name) + 1, F.col("ord") + 1), name, F.lit(b"\0")), 4), _padded(data, 4))
    zero = "0" * 8
    end = b"070701" + (zero * 4 + "00000001" + zero * 6 + "0000000B" + zero).encode() + _CPIO_END + b"\0"
    return _together(entries, entry, end + bytes(-len(end) % 4))


@stepwise(_PLACES)
def cpio_places(content: pa.Array) -> pa.Array:
    """The headers of a newc archive, hop by hop, up to its trailer."""
    out = []
    for v in content.to_pylist():
        at, found = 0, []
        while v and v[at : at + 5] == b"07070" and v[at + 5 : at + 6] in (b"1", b"2"):
            try:
                n, name = int(v[at + 54 : at + 62], 16), int(v[at + 94 : at + 102], 16)
            except ValueError:
                break
            if v[at + 110 : at + 110 + name - 1] == _CPIO_END:
                break
            start = at + -(-(110 + name) // 4) * 4
            found.append({"header": at, "name_at": at + 110, "name_size": name, "start": start, "size": n, "kind": v[at + 14 : at + 22].decode("latin-1")})
            at = start + -(-n // 4) * 4
        out.append(found)
    return pa.array(out, _ARROW)


def read_cpio(archives: DataFrame) -> DataFrame:
    """(archive_id, ord, offset, name, kind, size, content) of each entry; kind is the mode in hex digits."""
    return _read(archives, cpio_places)


def _gzip(df: DataFrame) -> DataFrame:
    return df.withColumn("content", codecs.encode_by(F.lit("gzip"), F.col("content")))


def build_package(control: DataFrame, data: DataFrame) -> DataFrame:
    """(archive_id, content): a gzipped tar of debian-binary, control.tar.gz and data.tar.gz, from two tables of entries."""
    part = lambda df, k, name: _gzip(build_tar(df)).select("archive_id", F.lit(k).alias("ord"), F.lit(name).alias("name"), "content")
    version = control.select("archive_id").distinct().select("archive_id", F.lit(0).alias("ord"), F.lit("./debian-binary").alias("name"), F.lit(b"2.0\n").alias("content"))
    return _gzip(build_tar(version.unionByName(part(data, 1, "./data.tar.gz")).unionByName(part(control, 2, "./control.tar.gz"))))


def read_package(packages: DataFrame) -> DataFrame:
    """(archive_id, part, ord, name, size, content): the entries of a package's control and data archives."""
    opened = lambda df: _entries(df.select("archive_id", _unzipped_tar("content").alias("u")).select("archive_id", "u.content", "u.p"))
    part = F.regexp_extract("name", r"(control|data)\.tar\.gz$", 1)
    inner = opened(packages).withColumn("part", part).where("part <> ''").select(F.struct("archive_id", "part").alias("archive_id"), "content")
    return opened(inner).select("archive_id.archive_id", "archive_id.part", "ord", "name", "size", "content")


def control_fields(entries: DataFrame) -> DataFrame:
    """(archive_id, field, value) of the `Field: value` lines of the control files among entries."""
    lines = entries.where(F.endswith("name", F.lit("control"))).select("archive_id", F.explode(F.split(F.decode("content", "UTF-8"), r"\r?\n")).alias("line"))
    return lines.select("archive_id", F.regexp_extract("line", r"^([A-Za-z-]+):", 1).alias("field"), F.trim(F.regexp_extract("line", r"^[A-Za-z-]+:(.*)$", 1)).alias("value")).where("field <> ''")


def build_wdk(entries: DataFrame) -> DataFrame:
    """(archive_id, content): a table of (2 bytes, size, name) behind a head of 26 bytes, then the contents in order."""
    head = F.concat(F.lit(bytes(2)), lens.pack(F.octet_length("content"), 2), F.encode("name", "ISO-8859-1"), F.lit(b"\0"))
    rows = entries.select("archive_id", "ord", _padded(head, 2).alias("h"), "content")
    table = _together(rows.select("archive_id", "ord", F.col("h").alias("part")), F.col("part"), b"").withColumnRenamed("content", "table")
    data = _together(rows.select("archive_id", "ord", F.col("content").alias("part")), F.col("part"), b"").select(F.col("archive_id").alias("a"), F.col("content").alias("data"))
    j = table.join(data, F.col("archive_id") == F.col("a"))
    return j.select("archive_id", F.concat(F.lit(bytes(16)), lens.pack(F.octet_length("table") + 26, 2), F.lit(b"WDK 2.0\0"), "table", "data").alias("content"))


@stepwise(_PLACES)
def wdk_places(content: pa.Array) -> pa.Array:
    """The entries of a WDK 2.0 table; their contents follow one another from the data's beginning."""
    out = []
    for v in content.to_pylist():
        found: list[dict] = []
        if v and v[18:25] == b"WDK 2.0":
            at, data = 26, int.from_bytes(v[16:18], "big")
            start = data
            while at + 4 < data:
                end = v.find(b"\0", at + 4, data)
                if end < 0:
                    break
                n = int.from_bytes(v[at + 2 : at + 4], "big")
                found.append({"header": at, "name_at": at + 4, "name_size": end - at - 4, "start": start, "size": n, "kind": "file"})
                start += n
                at = end + 1 + (end + 1) % 2
        out.append(found)
    return pa.array(out, _ARROW)


def read_wdk(archives: DataFrame) -> DataFrame:
    """(archive_id, ord, offset, name, kind, size, content) of each entry of a WDK 2.0 image (big-endian)."""
    return _read(archives, wdk_places)


def web_index(images: DataFrame, at: Column, count: Column, base: Column, with_offset: bool = False, key: int = 0) -> DataFrame:
    """(image_id, ord, name, start, size): the file index of a web interface, a table of count little-endian entries at a place.

    An entry is (name pointer, offset, size) or, without offset, (name pointer, size); then contents stand one
    behind the other. Pointers are from base; key is taken off each size.
    """
    width = 12 if with_offset else 8
    field = lambda k, o: lens.integer(F.col("content"), (at + k * width + o).cast("int"), 4, big=False)
    entry = lambda k: F.struct(lens.c_string(F.col("content"), (field(k, 0) - base).cast("int")).alias("name"), field(k, 4).alias("a"), field(k, width - 4).alias("size"))
    entries = F.when(count > 0, F.transform(F.sequence(F.lit(0), (count - 1).cast("int")), entry))
    rows = images.select("image_id", F.posexplode(entries).alias("ord", "e")).select("image_id", "ord", "e.*").withColumn("size", F.col("size") - key)
    if with_offset:
        return rows.select("image_id", "ord", "name", F.col("a").alias("start"), "size")
    w = Window.partitionBy("image_id").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    return rows.select("image_id", "ord", "name", F.coalesce(F.sum("size").over(w), F.lit(0)).alias("start"), "size")


def size_key(entries: DataFrame, sizes: DataFrame) -> DataFrame:
    """(image_id, key): what every size in an index is too large by: the sum of the sizes less the real size of the data,
    by the number of entries, or 0 if that is no whole number. sizes is (image_id, bytes)."""
    per = entries.groupBy("image_id").agg(F.sum("size").alias("total"), F.count(F.lit(1)).alias("n"))
    over = F.col("total") - F.col("bytes")
    return per.join(sizes, "image_id").select("image_id", F.when(F.pmod(over, F.col("n")) == 0, F.floor(over / F.col("n"))).otherwise(0).cast("long").alias("key"))


def replaced_index(entries: DataFrame, new: DataFrame) -> DataFrame:
    """(image_id, ord, name, start, size, content): an index whose entries take the contents (image_id, name, content) that are
    given, the others their own, with all starts moved accordingly. entries has content."""
    n = new.select(F.col("image_id").alias("i2"), F.col("name").alias("n2"), F.col("content").alias("other"))
    j = entries.join(n, (F.col("image_id") == F.col("i2")) & (F.col("name") == F.col("n2")), "left")
    data = F.coalesce("other", "content")
    w = Window.partitionBy("image_id").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    rows = j.select("image_id", "ord", "name", F.octet_length(data).cast("long").alias("size"), data.alias("content"))
    return rows.select("image_id", "ord", "name", F.coalesce(F.sum("size").over(w), F.lit(0)).alias("start"), "size", "content")


def totals(entries: DataFrame, packed: str = "packed_size") -> DataFrame:
    """(size, packed_size, ratio) over all entries with these columns; the ratio is null for no bytes."""
    return entries.agg(F.sum("size").alias("size"), F.sum(packed).alias("packed_size"), F.try_divide(F.sum(packed), F.sum("size")).alias("ratio"))
