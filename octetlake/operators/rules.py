"""Signature rules: the text form, the model, and the compiler to column expressions.

A rule is an indented tree of lines `[>...]offset  type[op operand]  [cond]value  [format {tags}]`.
The line of level 0 is the magic that is searched; the others are tests relative to the hit. A
line is tried if the line it is indented under matched; lines of one level do not exclude each other.
So a line holds exactly if it and all lines above it on its branch match, and a tree becomes one flat
expression per line, without state.

Offsets may be numbers, `(off.T+expr)` (read there, signed; T is b, s, l little-endian or B, S, L
big-endian) and `&n` (n beyond the end of the line above). Integers are big-endian unless `le` is put
before the type, signed unless `u` is put before all. A field beyond the end reads as 0. `&`, `|` and `^`
hold if any bit is left; `~` compares with the complement; `x` always holds.
"""

from __future__ import annotations

import ast
import re
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from octetlake.functions import lens

WIDTHS = {"byte": 1, "short": 2, "long": 4, "quad": 8, "date": 4}


@dataclass
class Line:
    level: int
    offset: str
    kind: str  # string, regex or a key of WIDTHS
    big: bool
    signed: bool
    op: str | None  # of a value before it is compared
    operand: int
    cond: str
    value: str | int | None  # None: any
    text: str
    tags: dict[str, str]
    parent: int = -1


@dataclass
class Rule:
    title: str
    magic: str  # latin-1 characters
    shift: int  # of the magic within the record
    confidence: int
    lines: list[Line] = field(default_factory=list)
    is_regex: bool = False

    @property
    def tags(self) -> dict[str, str]:
        return self.lines[0].tags


def unescape(text: str) -> str:
    r"""\xHH, \NNN and single-letter escapes, and a trailing *n for repetition."""
    times = re.fullmatch(r"(.*)\*(\d+)", text, re.S)
    if times:
        text = times[1]
    simple = {"n": "\n", "r": "\r", "t": "\t", "0": "\0", "\\": "\\", " ": " "}

    def one(m: re.Match) -> str:
        if m[1]:
            return chr(int(m[1], 16))
        return chr(int(m[2], 8)) if m[2] else simple.get(m[3], m[3])

    out = re.sub(r"\\(?:x([0-9A-Fa-f]{1,2})|([0-7]{3})|(.))", one, text, flags=re.S)
    return out * int(times[2]) if times else out


def self_overlapping(rules: list[Rule]) -> list[str]:
    """Titles of the rules whose magic can begin inside itself and that are not tagged overlap: their next hit may be missed."""
    inside = lambda m: any(m.startswith(m[k:]) for k in range(1, len(m)))
    return [r.title for r in rules if not r.is_regex and "overlap" not in r.tags and inside(r.magic)]


def expression(text: str, **values: Column) -> Column:
    """An arithmetic expression over named values: + - * / ** ^ & | ~, unary minus, numbers. Whatever cannot be
    computed (an unknown name, a division by zero, an overflow) is null."""
    ops = {
        ast.Add: F.try_add, ast.Sub: F.try_subtract, ast.Mult: F.try_multiply, ast.Div: lambda a, b: F.floor(F.try_divide(a, b)), ast.BitXor: lambda a, b: a.bitwiseXOR(b),
        ast.BitAnd: lambda a, b: a.bitwiseAND(b), ast.BitOr: lambda a, b: a.bitwiseOR(b), ast.Pow: lambda a, b: F.when((b >= 0) & (F.abs(F.pow(a, b)) < 2.0**53), F.pow(a, b).cast("long")),
    }

    def of(node: ast.expr) -> Column:
        if isinstance(node, ast.Constant) and isinstance(node.value, int):
            return F.lit(node.value).cast("long")
        if isinstance(node, ast.Name) and node.id in values:
            return values[node.id].cast("long")
        if isinstance(node, ast.UnaryOp):
            return {ast.USub: lambda x: F.try_subtract(F.lit(0).cast("long"), x), ast.UAdd: lambda x: x, ast.Invert: F.bitwise_not}[type(node.op)](of(node.operand))
        if isinstance(node, ast.BinOp) and type(node.op) in ops:
            return ops[type(node.op)](of(node.left), of(node.right))
        raise ValueError(ast.dump(node))

    try:
        return of(ast.parse(text, mode="eval").body)
    except (ValueError, KeyError, SyntaxError):
        return F.lit(None).cast("long")


def parse_line(text: str) -> Line:
    m = re.match(r"(>*)(\S+)\s+(\S+)\s+((?:\\.|\S)+)\s*(.*)$", text, re.S)
    if not m:
        raise ValueError(f"not a rule line: {text!r}")
    level, offset, kind, value, rest = len(m[1]), m[2], m[3], m[4], m[5]
    k = re.match(r"(u?)(be|le)?(byte|short|long|quad|date|string|regex)(?:([&|*+\-/~^])(\S*))?$", kind)
    if not k:
        raise ValueError(f"unknown type {kind!r}")
    tags = {a: b or "" for a, b in re.findall(r"\{(\w+)(?::([^}]*))?\}", rest)}
    cond, parsed = "=", None
    if k[3] in ("string", "regex"):
        if value != "x":
            if level and value[0] in "!=" and len(value) > 1:
                cond, value = value[0], value[1:]
            parsed = value if k[3] == "regex" else unescape(value)
    elif value != "x":
        if value[0] in "=!<>&|^~" and len(value) > 1:
            cond, value = value[0], value[1:]
        parsed = int(value, 0)
    return Line(level, offset, k[3], k[2] != "le", not k[1] and k[3] != "date", k[4], int(k[5], 0) if k[5] else 0, cond, parsed, re.sub(r"\{[^}]*\}", "", rest).strip(), tags)


def parse(text: str) -> list[Rule]:
    """Rules of a rule file: '#' begins a comment, blank lines and lines with '!' in front are skipped."""
    rules: list[Rule] = []
    for raw in text.splitlines():
        raw = raw.split("#")[0].strip()
        if not raw or raw[0] == "!":
            continue
        line = parse_line(raw)
        if line.level == 0:
            if line.kind in ("string", "regex"):
                magic = str(line.value)
            else:
                width = WIDTHS[line.kind]
                magic = (int(line.value or 0) % (1 << (8 * width))).to_bytes(width, "big" if line.big else "little").decode("latin-1")
            conf = int(line.tags["confidence"]) if line.tags.get("confidence") else len(magic)
            rules.append(Rule(line.text.split(",")[0].split("%")[0].strip() or magic, magic, int(line.offset, 0), conf, [line], line.kind == "regex"))
        else:
            done = rules[-1].lines
            line.parent = next(i for i in reversed(range(len(done))) if done[i].level < line.level)
            done.append(line)
    return sorted(rules, key=lambda r: -r.confidence)


def _math(value: Column, op: str | None, operand: int) -> Column:
    n = F.lit(operand).cast("long")
    if op is None:
        return value
    return {
        "&": lambda: value.bitwiseAND(n), "|": lambda: value.bitwiseOR(n), "^": lambda: value.bitwiseXOR(n), "~": lambda: F.bitwise_not(value), "*": lambda: value * n,
        "+": lambda: value + n, "-": lambda: value - n, "/": lambda: F.try_divide(value, n).cast("long"),
    }[op]()


def _offset(content: Column, at: Column, text: str, above: Column) -> Column:
    if text.startswith("&"):
        return above + int(text[1:], 0)
    m = re.fullmatch(r"\((&?)(-?\w+)\.([bBsSlL])([&|*+\-/^])?(-?\w+)?\)", text)
    if not m:
        return at + int(text, 0)
    where = (above if m[1] else at) + int(m[2], 0)
    width = {"b": 1, "s": 2, "l": 4}[m[3].lower()]
    return at + _math(lens.integer(content, where.cast("int"), width, m[3].isupper(), True), m[4], int(m[5], 0) if m[5] else 0)


def _value(content: Column, at: Column, line: Line) -> Column:
    where = at.cast("int")
    if line.kind == "string":
        if line.value is None:
            return lens.c_string(content, where)
        return lens.lens(F.substring(content, where + 1, F.lit(len(str(line.value)))))
    if line.kind == "regex":
        return F.regexp_extract(lens.lens(F.substring(content, where + 1, F.lit(1024))), "(?d)^(" + str(line.value) + ")", 1)
    return _math(lens.integer(content, where, WIDTHS[line.kind], line.big, line.signed), line.op, line.operand)


def _holds(value: Column, line: Line) -> Column:
    if line.value is None:
        return F.lit(True)
    if line.kind == "regex":
        return value != ""
    v = F.lit(line.value) if line.kind == "string" else F.lit(int(line.value)).cast("long")
    return {
        "=": lambda: value == v, "!": lambda: value != v, "<": lambda: value < v, ">": lambda: value > v, "&": lambda: value.bitwiseAND(v) != 0,
        "|": lambda: value.bitwiseOR(v) != 0, "^": lambda: value.bitwiseXOR(v) != 0, "~": lambda: value == F.bitwise_not(v),
    }[line.cond]()


def _printf(text: str, value: Column, kind: str) -> Column:
    spec = re.search(r"%[-+ 0#]*\d*(?:\.\d+)?[lh]*[diouxXcs]", text)
    if not spec:
        return F.lit(text.replace("%%", "%"))
    if kind == "date":
        value = lens.epoch_date(value)
    f = re.sub(r"[lh]", "", spec[0])
    f = f[:-1] + {"i": "d", "u": "d"}.get(f[-1], f[-1])
    head, tail = (text[: spec.start()].replace("%%", "%").replace("%", "%%"), text[spec.end() :].replace("%%", "%").replace("%", "%%"))
    if f[-1] == "c" and kind in WIDTHS:  # the character of the low byte
        f, value = f[:-1] + "s", F.char(value)
    elif f[-1] == "s" or kind in ("string", "regex", "date"):
        f, value = "%s", value.cast("string")
    return F.format_string(head + f + tail, value)


def compile_rule(rule: Rule, content: Column, at: Column) -> Column:
    """struct(description, valid, size, jump, adjust, name) of a hit of the rule at an offset.

    The hit is not valid if a line with the tag `invalid` matches, or if the description is empty or not
    printable; bounds against the file are tested by the scan.
    """
    ok: list[Column] = [F.lit(True)]
    values: list[Column] = [F.lit(rule.magic)]
    ends: list[Column] = [at + rule.shift + len(rule.magic)]
    counted = F.lit(0)  # what the last line with the tag strlen read
    for line in rule.lines[1:]:
        up = ok[line.parent]
        where = _offset(content, at, line.offset, ends[line.parent])
        value = _value(content, where, line)
        if "string" in line.tags and line.kind == "string" and line.value is None:
            value = lens.lens(F.substring(content, where.cast("int") + 1, counted.cast("int")))
        if "strlen" in line.tags:
            counted = F.when(up, value if "%" in line.tags["strlen"] or not line.tags["strlen"] else F.lit(int(line.tags["strlen"], 0))).otherwise(counted)
        ok.append(up & F.coalesce(_holds(value, line), F.lit(False)))
        values.append(value)
        ends.append(where + (F.length(value) if line.kind in ("string", "regex") else F.lit(WIDTHS.get(line.kind, 0))))
    parts = [F.when(o, _printf(x.text, v, x.kind)) for o, v, x in zip(ok, values, rule.lines, strict=True) if x.text]
    description = F.regexp_replace(F.concat_ws(" ", *parts), r"(?d).?\\b", "")
    bad = F.lit(False)
    tags = {"size": F.lit(None).cast("long"), "jump": F.lit(None).cast("long"), "adjust": F.lit(None).cast("long")}
    name = F.lit(None).cast("string")
    for o, v, x in zip(ok, values, rule.lines, strict=True):
        if "invalid" in x.tags:
            bad = bad | o
        for k in tags:
            if k in x.tags:
                number = v.cast("long") if "%" in x.tags[k] else F.lit(int(x.tags[k], 0)).cast("long")
                tags[k] = F.when(o, number).otherwise(tags[k])
        if "name" in x.tags:
            name = F.when(o, v.cast("string")).otherwise(name)
    return F.struct(
        description.alias("description"), (~bad & lens.is_printable(description)).alias("valid"), *[c.alias(k) for k, c in tags.items()], name.alias("name")
    )


#: Our own table, from public format descriptions, by family. Magics and offsets are fixed by the formats.
FAMILIES = {
    "archives": r"""
0 string PK\003\004 Zip member,
>4 leshort >90 {invalid}
>4 byte x needs version %d
>18 lelong x packed to %d bytes
>22 lelong x from %d
>26 leshort <1 {invalid}
0 string PK\005\006 Zip directory end,
>20 leshort x comment of %d bytes
0 string PK\001\002 Zip directory entry {many}{confidence:3}
257 string ustar Tar archive,
>0 string x first file %s {name}
0 string 070701 Cpio member, new format {many}
0 string 070702 Cpio member, new format with sums {many}
0 string 070707 Cpio member, portable old format {many}
0 string !<arch>\x0a Library of object files (ar)
0 string !<arch>\x0adebian Debian package
0 string \xed\xab\xee\xdb Red Hat package,
>4 byte x format %d
>4 byte >4 {invalid}
0 string MSCF\0\0\0\0 Cabinet of files,
>8 ulelong x %d bytes {size:%d}
>8 ulelong <36 {invalid}
0 string Rar!\x1a\x07\x00 Rar archive, version 4
0 string Rar!\x1a\x07\x01\x00 Rar archive, version 5
0 string 7z\xbc\xaf\x27\x1c 7z archive,
>6 byte x format %d
>7 byte x .%d
2 string -lh5- LHA member, method 5
2 string -lh7- LHA member, method 7
20 string \xdc\xa7\xc4\xfd Zoo archive
7 string **ACE** ACE archive
0 string xar! Xar archive
0 string SIT! StuffIt archive
0 string MSWIM\0\0\0 Windows image file
0 string koly\0\0\0\x04 Disk image trailer
""",
    "compressed": r"""
0 string \x1f\x8b\x08 Gzip stream,
>3 byte&0x08 !0 named
>>10 string x %s {name}
>3 byte >31 {invalid}
>3 byte <0 {invalid}
>4 ledate x of %s
0 string \x78\x9c Zlib stream, usual level {confidence:2}
0 string \x78\xda Zlib stream, highest level {confidence:2}
0 string \x78\x01 Zlib stream, lowest level {confidence:2}
0 string \x78\x5e Zlib stream, low level {confidence:2}
0 string \xfd7zXZ\0 Xz stream
0 string \x5d\x00\x00 LZMA stream {confidence:2}
>3 leshort <1 {invalid}
>5 lequad x of %d bytes
0 string BZh Bzip2 stream,
>3 byte <49 {invalid}
>3 byte >57 {invalid}
>3 byte x blocks of %c00 kB
>4 string !1AY&SY {invalid}
0 string \x28\xb5\x2f\xfd Zstandard frame
0 string \x04\x22\x4d\x18 LZ4 frame
0 string \x02\x21\x4c\x18 LZ4 frame, old format
0 string \x89LZO\x00\x0d\x0a\x1a\x0a Lzop file
0 string LZIP Lzip member,
>4 byte x version %d
>4 byte >1 {invalid}
0 string \xff\x06\x00\x00sNaPpY Snappy stream
0 string LRZI Long-range zip
0 string RZIP Rzip file
0 string zPQ Zpaq block
0 string \x1f\x9d\x90 Compress (LZW) file, 16 bits
0 string \x1f\x1e Packed (Huffman) file {confidence:1}
>2 belong <1 {invalid}
0 string SZDD\x88\xf0\x27\x33 Compressed file of an old installer
""",
    "bootloaders": r"""
0 string U-Boot\ 20 U-Boot version text {once}
0 string U-Boot\ 1. U-Boot version text, first series {once}
0 string CFE1CFE1 Common firmware environment boot block
0 string RedBoot(tm) RedBoot banner {once}
0 string PMON\ version PMON banner
0 string YAMON\ ROM YAMON banner
0 string barebox\ 20 Barebox version text
40 string _FVH Firmware volume of a UEFI image,
>32 ulelong x %d bytes
0 string GRUB\ GRUB stage text {once}
6 string LILO LILO boot sector
0 string iPXE\ iPXE banner {once}
0 string coreboot- Coreboot build text
0 string LARCHIVE Coreboot file system member {many}
""",
    "console": r"""
0 string BusyBox\ v1. BusyBox banner {once}
0 string \x0d\x0alogin:\x20 Login prompt
0 string Password:\x20 Password prompt {once}
0 string \x1b[2J\x1b[ Terminal: clear screen {many}
0 string ttyS0,115200 Serial console setting {once}
0 string console=tty Kernel console setting {once}
0 string /bin/sh\0 Path of the shell {once}
""",
    "crypto": r"""
0 string \x63\x7c\x77\x7b\xf2\x6b\x6f\xc5 AES substitution box
0 string \x52\x09\x6a\xd5\x30\x36\xa5\x38 AES inverse substitution box
0 string \x24\x3f\x6a\x88\x85\xa3\x08\xd3 Blowfish subkeys, big-endian
0 string \x88\x6a\x3f\x24\xd3\x08\xa3\x85 Blowfish subkeys, little-endian
0 string \x3a\x32\x2a\x22\x1a\x12\x0a\x02 DES initial permutation
0 string expand\ 32-byte\ k ChaCha or Salsa constant
0 string Salted__ Encrypted by a pass phrase (salted)
0 string LUKS\xba\xbe LUKS volume header,
>6 beshort x version %d
>6 beshort >2 {invalid}
0 string -----BEGIN\ CERTIFICATE PEM block: certificate
0 string -----BEGIN\ RSA\ PRIVATE PEM block: RSA private key
0 string -----BEGIN\ EC\ PRIVATE PEM block: EC private key
0 string -----BEGIN\ PRIVATE PEM block: private key
0 string -----BEGIN\ PUBLIC PEM block: public key
0 string -----BEGIN\ OPENSSH PEM block: OpenSSH private key
0 string -----BEGIN\ PGP PGP text block
0 string ssh-rsa\  SSH public key, RSA
0 string ssh-ed25519\  SSH public key, Ed25519
0 string PuTTY-User-Key-File- PuTTY key file
""",
    "ecos": r"""
0 string eCos\ v Text of the eCos system {once}
0 string cyg_thread_create Symbol of the eCos kernel {once}
0 string CYGPKG_ Name of an eCos package {many}
0 string .ecos. Section name of eCos {once}
""",
    "encoding": r"""
0 string ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/ Alphabet of Base64
0 string ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_ Alphabet of Base64 for URLs
0 string ABCDEFGHIJKLMNOPQRSTUVWXYZ234567 Alphabet of Base32 {confidence:20}
0 string begin\ 644\  Uuencoded file,
>10 string x named %s {name}
0 string =ybegin\ line= Yenc part
0 string (This\ file\ must\ be\ converted\ with\ BinHex BinHex file
0 string :020000040000FA Intel hex record, extended address
0 string S00600004844521B S-record header
0 string \xef\xbb\xbf Byte order mark of UTF-8 {confidence:1}
""",
    "executables": r"""
0 string \x7fELF ELF object,
>4 byte 1 32 bits
>4 byte 2 64 bits
>4 byte >2 {invalid}
>4 byte <1 {invalid}
>5 byte 1 little-endian
>5 byte 2 big-endian
>5 byte >2 {invalid}
0 string MZ DOS or Windows program {confidence:2}
>60 lelong <64 {invalid}
>(60.l) string !PE {invalid}
>(60.l) string PE\0\0 with PE header
0 string \xca\xfe\xba\xbe Java class or universal Mach-O object
0 string \xfe\xed\xfa\xce Mach-O object, 32 bits, big-endian
0 string \xce\xfa\xed\xfe Mach-O object, 32 bits, little-endian
0 string \xfe\xed\xfa\xcf Mach-O object, 64 bits, big-endian
0 string \xcf\xfa\xed\xfe Mach-O object, 64 bits, little-endian
0 string \0asm WebAssembly binary,
>4 ulelong x version %d
0 string dex\x0a03 Dalvik classes
>7 byte !0 {invalid}
0 string \x1bLua Lua bytecode
0 string bFLT Flat binary of uClinux,
>4 belong x version %d
>4 belong >8 {invalid}
0 string \x23!/ Script,
>2 string x run by %s
""",
    "filesystems": r"""
0 string hsqs SquashFS image, little-endian,
>28 leshort >4 {invalid}
>28 leshort <1 {invalid}
>28 leshort x version %d
>30 leshort x .%d
>40 lequad x of %d bytes {size:%d}
0 string sqsh SquashFS image, big-endian,
>28 beshort >4 {invalid}
>28 beshort <1 {invalid}
>28 beshort x version %d
0 string shsq SquashFS image with another magic, little-endian,
>28 leshort >4 {invalid}
>28 leshort <1 {invalid}
>28 leshort x version %d
0 string \x45\x3d\xcd\x28 CramFS image, little-endian,
>16 string !Compressed {invalid}
>4 lelong x of %d bytes {size:%d}
0 string \x28\xcd\x3d\x45 CramFS image, big-endian,
>16 string !Compressed {invalid}
>4 belong x of %d bytes {size:%d}
0 string \x85\x19 JFFS2 filesystem node, little-endian {many}{confidence:2}
>2 uleshort !0xE001
>>2 uleshort !0xE002
>>>2 uleshort !0x2003 {invalid}
0 string \x19\x85 JFFS2 filesystem node, big-endian {many}{confidence:2}
>2 ubeshort !0xE001
>>2 ubeshort !0xE002
>>>2 ubeshort !0x2003 {invalid}
0 string UBI\x23 UBI erase count header,
>4 byte >2 {invalid}
>4 byte x version %d
0 string UBI! UBI volume header {many}
0 string \x31\x18\x10\x06 UBIFS node {many}
0 string -rom1fs- Romfs image,
>8 belong x of %d bytes {size:%d}
1080 string \x53\xef Ext2, ext3 or ext4 volume {confidence:1}
>1024 lelong <1 {invalid}
>1048 lelong >6 {invalid}
>1048 lelong <0 {invalid}
54 string FAT12\x20\x20\x20 FAT volume, 12 bits
54 string FAT16\x20\x20\x20 FAT volume, 16 bits
82 string FAT32\x20\x20\x20 FAT volume, 32 bits
3 string NTFS\x20\x20\x20\x20 NTFS volume
3 string EXFAT\x20\x20\x20 ExFAT volume
32769 string CD001 ISO 9660 volume
0 string XFSB XFS volume
65588 string ReIsEr ReiserFS volume
1024 string \x10\x20\xf5\xf2 F2FS volume
65600 string _BHRfS_M Btrfs volume
1024 string \xe2\xe1\xf5\xe0 EROFS image
0 string LABELONE LVM physical volume
18 string WDK\ 2.0 WDK file system
""",
    "firmware": r"""
0 string \x27\x05\x19\x56 U-Boot image header,
>4 ubelong x header CRC 0x%X,
>8 bedate x made %s,
>12 belong x data of %d bytes
>12 belong <0 {invalid}
>32 string x named %s
0 string HDR0 TRX image,
>4 ulelong x of %d bytes,
>4 ulelong <28 {invalid}
>8 ulelong x CRC 0x%X
0 string \x5e\xa3\xa4\x17 DLOB or SEAMA image,
>4 belong x sizes %d
>8 belong x and %d
0 string \xd0\x0d\xfe\xed Device tree blob,
>4 belong x of %d bytes {size:%d}
>4 belong <40 {invalid}
0 string ANDROID! Android boot image
0 string *\x23$^ CHK image,
>4 belong x header of %d bytes
>4 belong >1024 {invalid}
0 string USR0 USR image,
>4 ulelong x of %d bytes
0 string OPEN Image of parts, open variant {confidence:3}
>4 byte <32 {invalid}
0 string UBNT Image of parts, maker's variant {confidence:3}
>4 byte <32 {invalid}
0 string PART Part of an image {confidence:3}
>4 byte <32 {invalid}
4 string TP-LINK\ Technologies TP-Link image
0 string CSYS CSYS image
6 string SIG\x04 ZyNOS object {confidence:2}
0 string W54S Code pattern of a router, W54S
0 string W54G Code pattern of a router, W54G
0 string NL16 Code pattern of a router, NL16
0 string firm\0 ZComax image
0 string Kimg\0 ZComax kernel
0 string Rimg\0 ZComax root file system
0 string PS16 Print server image {confidence:3}
0 string \x00MDL\x4c\x59\x4d MyLoader image {confidence:3}
0 string --PaCkImGs-- Packed images with a marker
12 string U2ND Code header with second magic
""",
    "hashing": r"""
0 string \x00\x00\x00\x00\x96\x30\x07\x77 Table of CRC-32, little-endian
0 string \x00\x00\x00\x00\x77\x07\x30\x96 Table of CRC-32, big-endian
0 string \x00\x00\x00\x00\x04\xc1\x1d\xb7 Table of CRC-32, not reflected, big-endian
0 string \x00\x00\x21\x10\x42\x20\x63\x30 Table of CRC-16, polynomial 1021, little-endian
0 string \x00\x00\xc0\xc1\xc1\x81\x01\x40 Table of CRC-16, polynomial 8005, big-endian
0 string \x98\x2f\x8a\x42\x91\x44\x37\x71 SHA-256 round constants, little-endian
0 string \x42\x8a\x2f\x98\x71\x37\x44\x91 SHA-256 round constants, big-endian
0 string \x67\xe6\x09\x6a\x85\xae\x67\xbb SHA-256 start values, little-endian
0 string \x6a\x09\xe6\x67\xbb\x67\xae\x85 SHA-256 start values, big-endian
0 string \x22\xae\x28\xd7\x98\x2f\x8a\x42 SHA-512 round constants, little-endian
0 string \x42\x8a\x2f\x98\xd7\x28\xae\x22 SHA-512 round constants, big-endian
0 string \x01\x23\x45\x67\x89\xab\xcd\xef MD5 or SHA-1 start values, little-endian
0 string \x67\x45\x23\x01\xef\xcd\xab\x89 MD5 or SHA-1 start values, big-endian
0 string \x78\xa4\x6a\xd7\x56\xb7\xc7\xe8 MD5 sine constants, little-endian
""",
    "images": r"""
0 string \x89PNG\x0d\x0a\x1a\x0a PNG picture,
>16 belong <1 {invalid}
>16 belong x %d by
>20 belong x %d,
>24 byte x %d bits
0 string GIF8 GIF picture,
>4 byte <55 {invalid}
>4 byte >57 {invalid}
>6 uleshort x %d by
>8 uleshort x %d
0 string \xff\xd8\xff JPEG picture
>3 ubyte <0xC0 {invalid}
0 string BM Bitmap {confidence:1}
>6 lelong !0 {invalid}
>14 lelong !40 {invalid}
>2 lelong x of %d bytes {size:%d}
0 string II\x2a\0 TIFF picture, little-endian
>4 ulelong <8 {invalid}
0 string MM\0\x2a TIFF picture, big-endian
>4 ubelong <8 {invalid}
0 string 8BPS\0\x01 Photoshop picture
0 string \x00\x00\x00\x0cjP\x20\x20 JPEG 2000 picture
0 string AT&TFORM DjVu document
0 string /*\ XPM\ */ XPM picture
0 string gimp\ xcf GIMP picture
0 string <svg SVG drawing
0 string qoif QOI picture
0 string farbfeld Farbfeld picture
""",
    "linux": r"""
0 string Linux\ version\  Version text of a Linux kernel {once}
36 string \x18\x28\x6f\x01 Linux zImage for ARM
514 string HdrS Linux kernel for x86
56 string ARM\x64 Linux kernel for 64-bit ARM
0 string IKCFG_ST Configuration inside a Linux kernel
0 string vermagic= Version text of a kernel module {many}
0 string init=/ Kernel setting: first process {once}
""",
    "misc": r"""
0 string %PDF- PDF document,
>5 byte <48 {invalid}
>5 byte >50 {invalid}
>5 string x version %s
0 string %!PS-Adobe- PostScript document
0 string {\x5crtf1 RTF document
0 string \xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1 Compound document
0 string <html HTML document header
>5 byte !0x20
>>5 byte !0x3E {invalid}
0 string </html> HTML document footer
0 string <!DOCTYPE Document type of HTML or XML
0 string <?xml XML document
0 string <script Embedded script {many}
0 string <style Embedded style sheet
0 string <title> HTML title
>7 string x %s
0 string OggS Ogg page {many}
0 string fLaC FLAC sound
0 string ID3 MP3 with tags,
>3 byte >4 {invalid}
>3 byte <2 {invalid}
>3 byte x version 2.%d
0 string MThd\0\0\0\x06 MIDI song
0 string RIFF RIFF container,
>4 ulelong x of %d bytes
>8 string x %s
0 string OTTO\0 OpenType font
0 string wOFF Web font
0 string GPG\0 Key box {confidence:1}
0 string LPKSHHRH Journal of a system log
""",
    "network": r"""
0 string \xd4\xc3\xb2\xa1 Packet capture, little-endian,
>4 uleshort x version %d
>4 uleshort >2 {invalid}
0 string \xa1\xb2\xc3\xd4 Packet capture, big-endian,
>4 ubeshort x version %d
>4 ubeshort >2 {invalid}
0 string \x0a\x0d\x0d\x0a Packet capture, next generation
>8 ulelong !0x1a2b3c4d {invalid}
0 string snoop\0\0\0 Snoop capture
0 string SSH-2.0- SSH greeting
0 string HTTP/1.1\ HTTP answer
0 string GET\ / HTTP request {many}
>5 byte <32 {invalid}
0 string User-Agent:\  HTTP client name {many}
0 string M-SEARCH\ *\ HTTP Discovery request
""",
    "sql": r"""
0 string SQLite\ format\ 3\0 SQLite database,
>16 ubeshort x pages of %d bytes
0 string CREATE\ TABLE\  SQL: table definition {many}
0 string INSERT\ INTO\  SQL: rows {many}
0 string PGDMP PostgreSQL dump
4 string Standard\ Jet\ DB Access database
0 string \xfe\x01\x07 MySQL table definition {confidence:1}
>3 byte >10 {invalid}
12 string \x61\x15\x06\x00 Berkeley DB hash, little-endian
12 string \x62\x31\x05\x00 Berkeley DB tree, little-endian
""",
    "vxworks": r"""
0 string VxWorks5. Version text of VxWorks 5 {once}
0 string VxWorks\ 6. Version text of VxWorks 6 {once}
0 string WIND\ version\ 2 Kernel version text of VxWorks {once}
0 string Wind\ River\ Systems Maker's text of VxWorks {once}
0 string usrAppInit\0 Symbol of a VxWorks program {once}
""",
}

#: Beginnings and ends of functions, from the instruction sets' manuals: (machine, bytes, what it is).
OPCODES = [
    ("MIPS", r"\x03\xe0\x00\x08", "return (jr)"), ("MIPS", r"\x27\xbd\xff", "stack grows (addiu)"), ("MIPSEL", r"\x08\x00\xe0\x03", "return (jr)"), ("ARM", r"\x1e\xff\x2f\xe1", "return (bx)"),
    ("ARM", r"\x00\x48\x2d\xe9", "registers saved (push)"), ("ARMEB", r"\xe1\x2f\xff\x1e", "return (bx)"), ("ARMEB", r"\xe9\x2d\x48\x00", "registers saved (push)"), ("AArch64", r"\xc0\x03\x5f\xd6", "return (ret)"),
    ("AArch64", r"\xfd\x7b\xbf\xa9", "frame set up (stp)"), ("PowerPC", r"\x4e\x80\x00\x20", "return (blr)"), ("PowerPC", r"\x7c\x08\x02\xa6", "link register read (mflr)"), ("x86", r"\x55\x89\xe5", "frame set up (push, mov)"),
    ("x86", r"\x55\x8b\xec", "frame set up (push, mov)"), ("x86-64", r"\x55\x48\x89\xe5", "frame set up (push, mov)"), ("SPARC", r"\x81\xc7\xe0\x08", "return (ret)"), ("SPARC", r"\x9d\xe3\xbf", "window saved (save)"),
    ("SuperH", r"\x0b\x00\x09\x00", "return (rts, nop)"), ("SuperH", r"\x00\x0b\x00\x09", "return (rts, nop), big-endian"), ("Nios II", r"\x3a\x28\x00\xf8", "return (ret)"), ("AVR", r"\x08\x95\xdf\x93", "return (ret, push)"),
    ("68000", r"\x4e\x5e\x4e\x75", "return (unlk, rts)"), ("68000", r"\x4e\x56\xff", "frame set up (link)"), ("S/390", r"\x07\xfe\x07\x07", "return (br, nop)"), ("Alpha", r"\x01\x80\xfa\x6b", "return (ret)"),
    ("RISC-V", r"\x67\x80\x00\x00", "return (ret)"), ("ARC", r"\xe0\x7f\xc1\x40", "return (j_s)"), ("IA-64", r"\x08\x00\x84\x00", "return (br.ret)"), ("PA-RISC", r"\xe8\x40\xc0\x00", "return (bv)"),
]


def opcode_rules() -> list[Rule]:
    """Rules that find code by the instructions functions begin and end with; not part of the usual scan."""
    return parse("\n".join(f"0 string {magic} {machine} instructions, {what} {{many}}" for machine, magic, what in OPCODES))


def default_rules() -> list[Rule]:
    return sorted((r for text in FAMILIES.values() for r in parse(text)), key=lambda r: -r.confidence)


def by_family() -> dict[str, list[Rule]]:
    """All rules, those of instructions included, by family."""
    return {name: parse(text) for name, text in FAMILIES.items()} | {"binarch": opcode_rules()}


def sample(rule: Rule, room: int = 512) -> bytes:
    """A record that fits a rule: its magic, and fields set so that no line that makes a hit invalid holds."""
    out = bytearray(rule.shift + len(rule.magic) + room)
    out[rule.shift : rule.shift + len(rule.magic)] = rule.magic.encode("latin-1")
    for line in rule.lines[1:]:
        if "invalid" not in line.tags:
            continue
        while line.parent:  # a line holds only if the ones above it do, so the topmost is enough
            line = rule.lines[line.parent]
        m = re.fullmatch(r"\((\d+)\.([bslBSL])\)", line.offset)
        at = int(line.offset, 0) if not m else int.from_bytes(out[int(m[1]) :][: {"b": 1, "s": 2, "l": 4}[m[2].lower()]], "big" if m[2].isupper() else "little")
        if line.kind == "string":
            text = str(line.value).encode("latin-1")
            out[at : at + len(text)] = text if line.cond == "!" else bytes(len(text))
            continue
        width, value = WIDTHS[line.kind], int(line.value or 0)
        now = int.from_bytes(out[at : at + width], "big" if line.big else "little", signed=line.signed)
        wanted = {"!": value, "<": max(now, value), ">": min(now, value), "=": value + 1 if now == value else now}[line.cond]
        out[at : at + width] = wanted.to_bytes(width, "big" if line.big else "little", signed=line.signed)
    return bytes(out)
