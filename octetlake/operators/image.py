"""Images: split into segments, verify and repair checksums, assemble, transplant."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from octetlake.functions import lens
from octetlake.functions.checksums import crc32_raw
from octetlake.functions.layouts import decode_struct

BIG = (1 << 31) - 1


def _cut(content: Column, start: Column, stop: Column | None = None) -> Column:
    n = F.lit(BIG) if stop is None else F.greatest(stop - start, F.lit(0)).cast("int")
    return F.substring(content, (start + 1).cast("int"), n)


def split_at_filesystem(images: DataFrame, magics: tuple[str, ...] = ("hsqs", "sqsh", "\x45\x3d\xcd\x28", "\x28\xcd\x3d\x45"), align: int = 4096) -> DataFrame:
    """(image_id, ord, kind, offset, length): kernel before the first filesystem magic, the filesystem, and a trailer
    from the last multiple of align on. An image without a magic is all kernel."""
    chars = lens.lens(F.col("content"))
    first = F.array_min(F.filter(F.array(*[F.instr(chars, m) - 1 for m in magics]), lambda x: x >= 0))
    n = F.octet_length("content")
    rows = images.select("image_id", n.alias("n"), first.alias("fs"))
    tail = F.when(F.col("fs").isNotNull(), F.greatest(F.floor(F.col("n") / align) * align, F.col("fs"))).otherwise(F.col("n"))
    rows = rows.withColumn("tail", tail.cast("long")).withColumn("fs", F.coalesce("fs", "n").cast("long"))
    part = lambda o, k, a, b: F.struct(F.lit(o).alias("ord"), F.lit(k).alias("kind"), F.col(a).alias("offset") if isinstance(a, str) else a.alias("offset"), (F.col(b) - (F.col(a) if isinstance(a, str) else a)).alias("length"))
    parts = F.array(part(0, "kernel", F.lit(0).cast("long"), "fs"), part(1, "filesystem", "fs", "tail"), part(2, "trailer", "tail", "n"))
    return rows.select("image_id", F.explode(F.filter(parts, lambda p: p["length"] > 0)).alias("p")).select("image_id", "p.*")


def split_trx(images: DataFrame) -> DataFrame:
    """(image_id, ord, offset, length) of the partitions of a TRX image: each runs to the next offset or the end."""
    h = decode_struct(F.col("content"), "trx")
    rows = images.select("image_id", h.alias("h")).where("h.magic = 'HDR0'")
    rows = rows.select("image_id", F.col("h.length").alias("n"), F.explode(F.array_distinct(F.array("h.offset0", "h.offset1", "h.offset2"))).alias("offset")).where("offset > 0")
    w = Window.partitionBy("image_id").orderBy("offset")
    return rows.select("image_id", (F.row_number().over(w) - 1).alias("ord"), "offset", (F.coalesce(F.lead("offset").over(w), F.col("n")) - F.col("offset")).alias("length"))


def header_and_footer(hits: DataFrame, images: DataFrame, filesystem: str = "fs image") -> DataFrame:
    """(image_id, fs_offset, fs_size, header, footer): the last filesystem hit divides an image; the footer is what
    follows the final run of one repeated byte (16 or more), if that run lies beyond the filesystem."""
    fs = hits.where(F.contains(F.lower("description"), F.lit(filesystem))).groupBy("file_id").agg(F.max(F.struct("offset", "size")).alias("h"))
    j = images.join(fs, images["image_id"] == fs["file_id"], "left")
    rest = F.when(F.col("h").isNotNull(), lens.lens(_cut(F.col("content"), F.col("h.offset"))))
    footer = F.regexp_extract(rest, r"(?s)^.*(.)\1{15,}(?!\1)(.*)$", 2)
    header = F.when(F.col("h").isNotNull(), _cut(F.col("content"), F.lit(0), F.col("h.offset"))).otherwise(F.col("content"))
    return j.select("image_id", F.col("h.offset").alias("fs_offset"), F.col("h.size").alias("fs_size"), header.alias("header"), lens.unlens(F.coalesce(footer, F.lit(""))).alias("footer"))


def split_many(hits: DataFrame) -> DataFrame:
    """(file_id, ord, kind, start, stop): filesystems with a size cut an image; what lies between them are gaps."""
    w = Window.partitionBy("file_id").orderBy("offset")
    before = F.coalesce(F.lag(F.col("offset") + F.col("size")).over(w), F.lit(0))
    rows = hits.where("size is not null").select("file_id", "offset", "size", before.alias("gap_start"), (F.row_number().over(w) - 1).alias("k"))
    parts = F.array(
        F.struct((2 * F.col("k")).alias("ord"), F.lit("gap").alias("kind"), F.col("gap_start").alias("start"), F.col("offset").alias("stop")),
        F.struct((2 * F.col("k") + 1).alias("ord"), F.lit("filesystem").alias("kind"), F.col("offset").alias("start"), (F.col("offset") + F.col("size")).alias("stop")),
    )
    return rows.select("file_id", F.explode(F.filter(parts, lambda p: p["stop"] > p["start"])).alias("p")).select("file_id", "p.*")


def join_parts(parts: DataFrame) -> DataFrame:
    """(image_id, content): the parts (image_id, ord, content) of each image in order. The parts of one image are one value."""
    whole = F.array_sort(F.collect_list(F.struct("ord", "content")))
    return parts.groupBy("image_id").agg(F.aggregate(whole, F.lit(b""), lambda acc, x: F.concat(acc, x["content"])).alias("content"))


def assemble(parts: DataFrame, filler: str = "FF") -> DataFrame:
    """Rows with header, filesystem, footer and original_size: (image_id, content, status). A gap is filled before the
    footer; an image that would be larger than the original is refused (no content, status 'too large')."""
    used = F.octet_length("header") + F.octet_length("filesystem") + F.octet_length("footer")
    gap = F.greatest(F.col("original_size") - used, F.lit(0)).cast("int")
    content = F.concat("header", "filesystem", F.unhex(F.repeat(F.lit(filler), gap)), "footer")
    return parts.select("image_id", F.when(used <= F.col("original_size"), content).alias("content"), F.when(used <= F.col("original_size"), "ok").otherwise("too large").alias("status"))


def place(content: Column, at: int | Column, new: Column, width: int) -> Column:
    """content with width bytes at an offset replaced."""
    off = F.lit(at) if isinstance(at, int) else at
    return F.overlay(content, new, (off + 1).cast("int"), F.lit(width))  # names the content once, so that expressions do not double


def trx_crc(content: Column) -> Column:
    n = lens.integer(content, 4, 4, big=False)
    return crc32_raw(_cut(content, F.lit(12), n))


def repair_trx(content: Column) -> Column:
    """The raw CRC-32 over bytes 12 to the header's length, put at 8, little-endian."""
    return place(content, 8, lens.pack(trx_crc(content), 4, big=False), 4)


def repair_uimage(content: Column) -> Column:
    """First the data's CRC at 24, then the header's, taken with its own field zero, at 4; big-endian."""
    data = _cut(content, F.lit(64), F.lit(64) + lens.integer(content, 12, 4))

    def header(fresh: Column) -> Column:
        zeroed = place(fresh, 4, F.lit(bytes(4)), 4)
        return place(fresh, 4, lens.pack(F.crc32(F.substring(zeroed, F.lit(1), F.lit(64))), 4), 4)

    return _bind(place(content, 24, lens.pack(F.crc32(data), 4), 4), header)


def repair_dlob(content: Column) -> Column:
    """The MD5 of the data under the second header, put right behind that header; an image without one stays as it is."""
    second = 12 + lens.integer(content, 4, 4) + lens.integer(content, 8, 4)
    start = second + 12 + lens.integer(content, (second + 4).cast("int"), 4) + 16
    stop = start + lens.integer(content, (second + 8).cast("int"), 4)
    there = (second + 12 <= F.octet_length(content)) & (stop <= F.octet_length(content))
    return F.when(there, place(content, second + 12, F.unhex(F.md5(_cut(content, start, stop))), 16)).otherwise(content)


def _bind(value: Column, f) -> Column:
    """f(value), with value evaluated once."""
    return F.transform(F.array(value), f)[0]


def repair(content: Column) -> Column:
    """Whichever of the known headers the content has; others stay as they are."""

    def of(c: Column) -> Column:
        magic = F.hex(F.substring(c, F.lit(1), F.lit(4)))
        return F.when(magic == "48445230", repair_trx(c)).when(magic == "27051956", repair_uimage(c)).when(magic == "5EA3A417", repair_dlob(c)).otherwise(c)

    return _bind(content, of)


def verify(content: Column) -> Column:
    """True if the stored checksum of a known header is right; null for other content."""
    known = ("48445230", "27051956", "5EA3A417")
    return _bind(content, lambda c: F.when(F.hex(F.substring(c, F.lit(1), F.lit(4))).isin(*known), repair(c) == c))


def cramfs_crc(content: Column) -> Column:
    """CRC-32 of a CramFS image with its own field (at 32) taken as 0."""
    return F.crc32(place(content, 32, F.lit(bytes(4)), 4))


def transplant(target: DataFrame, donor: DataFrame, kinds: tuple[str, ...] = ("filesystem",)) -> DataFrame:
    """The parts (image_id, ord, kind, content) of target, those of the named kinds taken from donor where it has them."""
    d = donor.where(F.col("kind").isin(*kinds)).select("image_id", "kind", F.col("content").alias("other"))
    return target.join(d, ["image_id", "kind"], "left").select("image_id", "ord", "kind", F.coalesce("other", "content").alias("content"))


def arcadyan(content: Column) -> Column:
    """Undo the vendor's scrambling of the first block: bytes 4-35 and 104-135 change places, then in the latter
    place the nibbles and then the neighbours of each byte pair are swapped."""
    a, b = F.substring(content, F.lit(5), F.lit(32)), F.substring(content, F.lit(105), F.lit(32))
    nibbles = F.unhex(F.regexp_replace(F.hex(b), "(.)(.)", "$2$1"))
    pairs = F.unhex(F.regexp_replace(F.hex(nibbles), "(..)(..)", "$2$1"))
    return F.concat(F.substring(content, F.lit(1), F.lit(4)), pairs, _cut(content, F.lit(36), F.lit(104)), a, _cut(content, F.lit(136)))
