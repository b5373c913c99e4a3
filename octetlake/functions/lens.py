"""Byte-exact string functions: the Latin-1 lens, and typed fields of binary columns.

`lens(content)` shows each byte as the character of the same number, so that length, substring,
locate, split and regular expressions count bytes and stay inside generated code. Offsets are from
0. Patterns over a lens should begin with `(?d)`, after which '.' leaves out only the line feed.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_bytes(text: Column) -> Column:
    """The UTF-8 bytes of a string column; null stays null."""
    return F.encode(text, "UTF-8")


def lens(content: Column) -> Column:
    return F.decode(content, "ISO-8859-1")


def text_lens(text: Column) -> Column:
    return lens(as_bytes(text))


def unlens(chars: Column) -> Column:
    return F.encode(chars, "ISO-8859-1")


def byte_range(content: Column, offset: int = 0, length: int | None = None) -> Column:
    """Bytes from offset on; a negative offset counts from the end; both are cut to the content."""
    size = F.octet_length(content)
    start = F.greatest(size + offset, F.lit(0)) if offset < 0 else F.least(F.lit(offset), size)
    return F.substring(content, start + 1, F.lit(length if length is not None else (1 << 31) - 1))


def literal_offsets(chars: Column, literal: str) -> Column:
    """Offsets of a literal, from left to right and without overlap."""
    quoted = "\\Q" + literal.replace("\\E", "\\E\\\\E\\Q") + "\\E"
    parts = F.split(chars, quoted, -1)
    step = len(literal)

    def found(p: Column) -> Column:
        start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<bigint>").alias("all"))
        return F.aggregate(
            F.slice(p, 1, F.size(p) - 1),
            start,
            lambda s, x: F.struct((s["at"] + F.length(x) + step).alias("at"), F.concat(s["all"], F.array(s["at"] + F.length(x))).alias("all")),
            lambda s: s["all"],
        )

    return F.when(F.contains(chars, F.lit(literal)), F.transform(F.array(parts), found)[0]).otherwise(F.array().cast("array<bigint>"))


def hex_field(content: Column, offset: Column | int, width: int, big: bool = True) -> Column:
    """width bytes at an offset as upper-case hex digits, most significant first; empty beyond the end."""
    off = F.lit(offset) if isinstance(offset, int) else offset
    h = F.hex(F.substring(content, off + 1, F.lit(width)))
    if big or width == 1:
        return h
    return F.concat(*[F.substring(h, 2 * i + 1, 2) for i in reversed(range(width))])


def integer(content: Column, offset: Column | int, width: int = 4, big: bool = True, signed: bool = False) -> Column:
    """An integer field of 1, 2, 4 or 8 bytes as bigint (an unsigned one of 8 bytes wraps). A short read gives 0."""
    off = F.lit(offset) if isinstance(offset, int) else offset
    whole = (off >= 0) & (off + width <= F.octet_length(content))
    value = F.conv(hex_field(content, off, width, big), 16, -10 if width == 8 else 10).cast("long")
    if signed and width < 8:
        value = F.when(value >= 1 << (8 * width - 1), value - (1 << (8 * width))).otherwise(value)
    return F.when(whole, value).otherwise(F.lit(0).cast("long"))


def c_string(content: Column, offset: Column | int, limit: int = 128) -> Column:
    """A string field: up to limit bytes, cut at the first NUL, CR or LF."""
    off = F.lit(offset) if isinstance(offset, int) else offset
    return F.regexp_extract(lens(F.substring(content, off + 1, F.lit(limit))), r"(?d)^([^\x00\r\n]*)", 1)


def epoch_date(seconds: Column) -> Column:
    """A 4-byte epoch as 'yyyy-MM-dd HH:mm:ss' in UTC (the session's time zone must be UTC)."""
    return F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd HH:mm:ss")


def pack(value: Column, width: int, big: bool = True) -> Column:
    """The bytes of an integer."""
    h = F.substring(F.lpad(F.hex(value.cast("long")), 16, "0"), 17 - 2 * width, 2 * width)
    return F.unhex(h if big else F.concat(*[F.substring(h, 2 * i + 1, 2) for i in reversed(range(width))]))


def swap(content: Column, n: int) -> Column:
    """Every n bytes reversed; a shorter tail is reversed too."""
    if n < 2:
        return content
    h = F.hex(content)
    groups = "".join("(..)" for _ in range(n))
    whole = F.substring(h, F.lit(1), F.octet_length(content) - F.octet_length(content) % n + F.octet_length(content) - F.octet_length(content) % n)
    tail = F.substring(content, F.octet_length(content) - F.octet_length(content) % n + 1, F.lit(n))
    turned = F.regexp_replace(whole, groups, "".join(f"${i}" for i in range(n, 0, -1)))
    return F.concat(F.unhex(turned), unlens(F.reverse(lens(tail))))


def is_printable(text: Column) -> Column:
    """Not empty and nothing but blank to tilde."""
    return text.rlike(r"^[ -~]+\z")


def strings(chars: Column, minimum: int = 4, keep_last: bool = False) -> Column:
    """Runs of printable characters (tab to CR, blank to tilde) of a lens; a run at the very end only with keep_last."""
    found = F.regexp_extract_all(chars, F.lit(rf"([\x09-\x0d\x20-\x7e]{{{minimum},}}+)"), F.lit(1))
    if keep_last:
        return found
    at_end = lambda f: F.when((F.size(f) > 0) & F.endswith(chars, F.try_element_at(f, F.lit(-1))), F.slice(f, 1, F.size(f) - 1)).otherwise(f)
    return F.transform(F.array(found), at_end)[0]


def strip_quoted(text: Column) -> Column:
    """The text without what stands from the first to the last double quote."""
    return F.regexp_replace(text, '(?ds)"(.*)"', "")


def quoted(text: Column) -> Column:
    """What stands between the first and the last double quote of a line; empty if there is none."""
    return F.regexp_extract(text, '(?d)"(.*)"', 1)


def is_ascii(text: Column) -> Column:
    """Nothing but characters from 1 to 127; an empty text is."""
    return text.rlike(r"^[\x01-\x7F]*\z")


def safe_path(path: Column) -> Column:
    """A path in which every character but letters, digits, dots, dashes and slashes is '_' and no part is '..'."""
    plain = F.regexp_replace(path, r"[^A-Za-z0-9._/-]", "_")
    return F.regexp_replace(plain, r"(^|/)\.\.(/|$)", "$1_$2")
