"""File systems as rows of files: CramFS, SquashFS 4 and YAFFS2 images, written from rows and read back.

An image is one value (image_id, content). Where directory records lead from one to the next, a small Arrow
function returns places only: for each node its path and where its blocks stand. Blocks are cut beside the
image, so that no row of a file carries the whole of it, and are inflated per file after the rows have been spread.
YAFFS2 is a table of pages: there the newest header of each object, its data and its path are plain
aggregates and joins.

What is no such image has no rows; a record that leads out of the image ends the walk of it, and what was
found before stays. A file of which a block does not inflate, or whose bytes do not add up, has a null content.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from octetlake.functions import codecs, lens
from octetlake.functions.batches import stepwise
from octetlake.operators.image import cramfs_crc, join_parts, place
from octetlake.operators.packages import tree_paths

KINDS = {1: "fifo", 2: "char", 4: "dir", 6: "block", 8: "file", 10: "link", 12: "socket"}
_BLOCK = pa.struct([("at", pa.int64()), ("n", pa.int64()), ("packed", pa.bool_()), ("full", pa.int64()), ("skip", pa.int64()), ("take", pa.int64())])
_NODE = pa.struct([("path", pa.string()), ("kind", pa.string()), ("mode", pa.int32()), ("uid", pa.int64()), ("gid", pa.int64()), ("size", pa.int64()), ("target", pa.string()), ("blocks", pa.list_(_BLOCK))])
NODES = "array<struct<path string, kind string, mode int, uid bigint, gid bigint, size bigint, target string, blocks array<struct<at bigint, n bigint, packed boolean, full bigint, skip bigint, take bigint>>>>"
FILE = "struct<codec string, data binary>"


def _inflated(column: Column, chain: Column) -> Column:
    """The blocks of a file, each by the first codec of the chain (an array of names) that decodes it, as one value; null if one fails."""

    def one(blocks: list[dict] | None, chain: list[str]) -> dict | None:
        if blocks is None:
            return None
        out, used = [], None
        for b in blocks:
            data = b["bytes"] if b["n"] else bytes(b["full"])
            if b["n"] and b["packed"]:
                tried = ((name, codecs.CODECS[name](data, b["full"] + 1)) for name in chain)
                used, data = next(((name, r["data"]) for name, r in tried if r["ok"] and len(r["data"]) <= b["full"]), (None, None))
                if data is None:
                    return {"codec": None, "data": None}
            out.append(data[b["skip"] : b["skip"] + b["take"]])
        return {"codec": used, "data": b"".join(out)}

    @stepwise(FILE)
    def run(col: pa.Array, chains: pa.Array) -> pa.Array:
        return pa.array([one(v.as_py(), c.as_py()) for v, c in zip(col, chains, strict=True)], pa.struct([("codec", pa.string()), ("data", pa.binary())]))

    return run(column, chain)


def _files(images: DataFrame, nodes: Column, chain: Column) -> DataFrame:
    """(image_id, path, kind, mode, uid, gid, size, packed_size, target, codec, content) of the nodes of images, each with its chain of codecs."""
    cut = lambda b: F.struct(F.substring("content", (b["at"] + 1).cast("int"), b["n"].cast("int")).alias("bytes"), *[b[k].alias(k) for k in ("n", "packed", "full", "skip", "take")])
    node = lambda x: F.struct(*[x[k].alias(k) for k in ("path", "kind", "mode", "uid", "gid", "size", "target")], F.transform(x["blocks"], cut).alias("blocks"))
    rows = images.select("image_id", "content", chain.alias("chain"), nodes.alias("nodes")).select("image_id", "chain", F.transform("nodes", node).alias("nodes"))
    rows = rows.select("image_id", "chain", F.explode("nodes").alias("x")).select("image_id", "chain", "x.*")
    rows = rows.withColumn("packed_size", F.aggregate("blocks", F.lit(0).cast("long"), lambda a, b: a + b["n"])).withColumn("f", _inflated(F.col("blocks"), F.col("chain")))
    whole = F.when(F.octet_length("f.data") == F.col("size"), F.col("f.data"))
    return rows.select("image_id", "path", "kind", "mode", "uid", "gid", "size", "packed_size", "target", F.col("f.codec").alias("codec"), whole.alias("content"))


def _walked(walk: Callable[[bytes], Iterator[dict]], content: Column) -> Column:
    """The nodes of each image; a walk that breaks off keeps what it has found."""

    @stepwise(NODES)
    def run(col: pa.Array) -> pa.Array:
        out = []
        for image in col:
            v, found = image.as_py() or b"", []
            try:
                for node in walk(v):
                    inside = all(min(b.values()) >= 0 and b["at"] + b["n"] <= len(v) for b in node.get("blocks") or ())
                    found.append(node if inside else node | {"blocks": None})
            except (struct.error, IndexError, KeyError, OverflowError, ValueError):
                pass
            out.append([x for x in found if x["size"] < 1 << 63])
        return pa.array(out, pa.list_(_NODE))

    return run(content)


def _name(raw: bytes) -> str:
    return raw.split(b"\0")[0].decode("utf-8", "replace")


# --- CramFS ---------------------------------------------------------------------------------------------------------

PAGE = 4096


def _cramfs_walk(v: bytes) -> Iterator[dict]:
    if v[:4] != b"\x45\x3d\xcd\x28" or v[16:32] != b"Compressed ROMFS":
        return

    def inode(at: int) -> tuple[int, int, int, int, int, int]:
        a, b, c = struct.unpack_from("<III", v, at)
        return a & 0xFFFF, a >> 16, b & 0xFFFFFF, b >> 24, (c & 63) * 4, (c >> 6) * 4

    root = inode(64)
    todo, seen = [("", root[5], root[2])], set()
    while todo:
        above, at, size = todo.pop()
        if at in seen:
            continue  # a directory that leads back to itself
        seen.add(at)
        end = at + size
        while at < end:
            mode, uid, size, gid, width, start = inode(at)
            path, kind, blocks = above + _name(v[at + 12 : at + 12 + width]), KINDS.get(mode >> 12, "other"), None
            if kind == "dir":
                if size:
                    todo.append((path + "/", start, size))
            elif kind in ("file", "link"):
                n = -(-size // PAGE)
                ends = struct.unpack_from(f"<{n}I", v, start) if n else ()
                starts = (start + 4 * n, *ends)
                blocks = [{"at": a, "n": b - a, "packed": True, "full": (f := min(PAGE, size - k * PAGE)), "skip": 0, "take": f} for k, (a, b) in enumerate(zip(starts, ends))]  # noqa: B905
            yield {"path": path, "kind": kind, "mode": mode, "uid": uid, "gid": gid, "size": size, "blocks": blocks}
            at += 12 + width


def read_cramfs(images: DataFrame, chain: tuple[str, ...] = ("zlib", "lzma")) -> DataFrame:
    """The files of little-endian CramFS images, one row each; blocks by the first codec of the chain that fits. A link's content is its target."""
    return _files(images, _walked(_cramfs_walk, F.col("content")), F.array(*map(F.lit, chain)))


def check_cramfs(images: DataFrame) -> DataFrame:
    """(image_id, ok): whether the CRC of an image is that in its header; null for what is no CramFS image."""
    c = F.col("content")
    return images.select("image_id", F.when(F.substring(c, 1, 4) == F.lit(b"\x45\x3d\xcd\x28"), cramfs_crc(c) == lens.integer(c, 32, 4, big=False)).alias("ok"))


def _pieces(content: Column, codec: str, size: int) -> Column:
    """The content in compressed pieces of a size, each with whether it was worth it."""

    @stepwise("array<struct<bytes binary, packed boolean>>")
    def run(col: pa.Array) -> pa.Array:
        out = []
        for v in col:
            data = v.as_py() or b""
            raw = [data[k : k + size] for k in range(0, len(data), size)]
            out.append([{"bytes": p, "packed": True} if len(p := codecs._ENCODERS[codec](r)) < len(r) else {"bytes": r, "packed": False} for r in raw])
        return pa.array(out, pa.list_(pa.struct([("bytes", pa.binary()), ("packed", pa.bool_())])))

    return run(content)


def _tree(files: list[dict]) -> dict[str, dict[str, dict | None]]:
    """The directories of files by path, each with its names; a name with null is a directory. Parents stand before their children."""
    dirs: dict[str, dict[str, dict | None]] = {"": {}}
    for f in sorted(files, key=lambda x: x["path"]):
        *above, name = f["path"].split("/")
        for k, part in enumerate(above):
            dirs["/".join(above[:k])].setdefault(part, None)
            dirs.setdefault("/".join(above[: k + 1]), {})
        dirs["/".join(above)][name] = f
    return dirs


def _cramfs_image(files: list[dict]) -> bytes | None:
    pad = lambda b: b + bytes(-len(b) % 4)
    dirs, at = _tree(files), 76
    place_of, size_of = {}, {}
    for path, names in dirs.items():
        place_of[path], size_of[path] = at, sum(12 + len(pad(n.encode())) for n in names)
        at += size_of[path]
    data, known, records = bytearray(), {}, {}

    def inode(mode: int, size: int, width: int, start: int) -> bytes:
        if size >= 1 << 24 or width > 252 or start >= 1 << 28:
            raise OverflowError
        return struct.pack("<III", mode, size, width // 4 | start // 4 << 6)

    def stored(blocks: list[dict]) -> int:
        key = tuple(b["bytes"] for b in blocks)
        if key not in known:  # equal contents share their blocks
            known[key] = start = at + len(data)
            ends, end = [], start + 4 * len(blocks)
            for b in blocks:
                ends.append(end := end + len(b["bytes"]))
            data.extend(pad(struct.pack(f"<{len(ends)}I", *ends) + b"".join(key)))
        return known[key]

    try:
        for path, names in dirs.items():
            rows = []
            for name, f in sorted(names.items()):
                raw, below = pad(name.encode()), f"{path}/{name}".lstrip("/")
                head = inode(0o040755, size_of[below], len(raw), place_of[below]) if f is None else inode(0o100644, f["size"], len(raw), stored(f["blocks"]) if f["blocks"] else 0)
                rows.append(head + raw)
            records[path] = b"".join(rows)
        root = inode(0o040755, size_of[""], 0, 76)
    except OverflowError:
        return None
    n = at + len(data)
    blocks = sum(len(f["blocks"]) for f in files)
    head = struct.pack("<IIII", 0x28CD3D45, n, 3, 0) + b"Compressed ROMFS" + struct.pack("<IIII", 0, 0, blocks, len(files) + len(dirs)) + bytes(16) + root
    return head + b"".join(records.values()) + bytes(data)


def _built(entries: DataFrame, codec: str, size: int, layout: Callable[[list[dict]], bytes | None]) -> DataFrame:
    @stepwise(T.BinaryType())
    def image(col: pa.Array) -> pa.Array:
        return pa.array([layout(v.as_py()) for v in col], pa.binary())

    rows = entries.select("image_id", F.struct("path", F.coalesce(F.octet_length("content"), F.lit(0)).cast("long").alias("size"), _pieces(F.col("content"), codec, size).alias("blocks")).alias("f"))
    return rows.groupBy("image_id").agg(F.collect_list("f").alias("fs")).select("image_id", image(F.col("fs")).alias("content"))


def build_cramfs(entries: DataFrame, codec: str = "zlib") -> DataFrame:
    """(image_id, content): a CramFS image of the rows (image_id, path, content) of each image, with its CRC. Every block is compressed.

    Paths are unique within an image and part by '/'. A null content is an empty file. An image that the format cannot hold (files
    of 16 MiB, 256 MiB in all, names over 252 bytes) is null.
    """
    made = _built(entries, codec, PAGE, lambda fs: _cramfs_image([f | {"blocks": _always(f["blocks"], codec)} for f in fs]))
    return made.select("image_id", place(F.col("content"), 32, lens.pack(F.crc32("content"), 4, big=False), 4).alias("content"))


def _always(blocks: list[dict], codec: str) -> list[dict]:
    return [b if b["packed"] else {"bytes": codecs._ENCODERS[codec](b["bytes"]), "packed": True} for b in blocks]


# --- SquashFS 4 -----------------------------------------------------------------------------------------------------

META = 8192
NONE = 0xFFFFFFFF
SQUASH_CODECS = {1: "zlib", 2: "lzma", 4: "xz"}  # numbers fixed by the format


def _metadata(v: bytes, at: int, end: int, codec: str) -> tuple[bytes, dict[int, int]]:
    """The metadata blocks from a place to another as one stream, and where each block's own begin stands in it."""
    out, begins, start = bytearray(), {}, at
    while at + 2 <= min(end, len(v)):
        (head,) = struct.unpack_from("<H", v, at)
        raw = v[at + 2 : at + 2 + (head & 0x7FFF)]
        begins[at - start] = len(out)
        if head & 0x8000:
            out += raw
        else:
            r = codecs.CODECS[codec](raw, META + 1)
            if not r["ok"]:
                break
            out += r["data"]
        at += 2 + (head & 0x7FFF)
    return bytes(out), begins


def _squashfs_walk(v: bytes) -> Iterator[dict]:
    if v[:4] != b"hsqs":
        return
    block_size, fragments, compression, _, _, ids, major = struct.unpack_from("<IIHHHHH", v, 12)
    root, _, id_at, _, inode_at, dir_at, fragment_at, _ = struct.unpack_from("<QQQQQQQQ", v, 32)
    codec = SQUASH_CODECS.get(compression)
    if major != 4 or codec is None or not 0 < block_size <= 1 << 20:
        return

    def table(at: int, count: int, width: int) -> bytes:
        """A table behind a list of pointers to its metadata blocks."""
        pointers = struct.unpack_from(f"<{-(-count * width // META)}Q", v, at)
        return b"".join(_metadata(v, p, p + 1 + 2, codec)[0] for p in pointers)

    owners = struct.unpack_from(f"<{ids}I", table(id_at, ids, 4))
    parts = table(fragment_at, fragments, 16) if fragments else b""
    first = struct.unpack_from("<Q", v, fragment_at)[0] if fragments else min(x for x in (fragment_at, id_at) if x > dir_at)
    inodes, inode_begins = _metadata(v, inode_at, dir_at, codec)
    names, name_begins = _metadata(v, dir_at, first, codec)

    def stored(at: int, words: tuple[int, ...], size: int, fragment: int, offset: int) -> Iterator[dict]:
        for k, w in enumerate(words):
            full = min(block_size, size - k * block_size)
            yield {"at": at, "n": w & 0xFFFFFF, "packed": not w >> 24 & 1, "full": full, "skip": 0, "take": full}
            at += w & 0xFFFFFF
        if fragment != NONE:
            at, w, _ = struct.unpack_from("<QII", parts, 16 * fragment)
            yield {"at": at, "n": w & 0xFFFFFF, "packed": not w >> 24 & 1, "full": block_size, "skip": offset, "take": size - len(words) * block_size}

    todo, seen = [("", root >> 16, root & 0xFFFF)], set()
    while todo:
        path, block, offset = todo.pop()
        at = inode_begins[block] + offset
        kind, mode, uid, gid, _, number = struct.unpack_from("<HHHHII", inodes, at)
        node = {"path": path, "mode": mode, "uid": owners[uid], "gid": owners[gid], "size": 0}
        at += 16
        if kind in (1, 8):
            start, size, begin = (lambda x: (x[0], x[2], x[3]))(struct.unpack_from("<IIHH", inodes, at)) if kind == 1 else (lambda x: (x[2], x[1], x[5]))(struct.unpack_from("<IIIIHH", inodes, at))
            if path:
                yield node | {"kind": "dir"}
            if number in seen:
                continue  # a directory that leads back to itself
            seen.add(number)
            if size <= 3:
                continue
            here = name_begins[start] + begin
            end = here + size - 3
            while here < end:
                count, block, _ = struct.unpack_from("<III", names, here)
                here += 12
                for _ in range(count + 1):
                    offset, _, _, width = struct.unpack_from("<HhHH", names, here)
                    todo.append((f"{path}/{_name(names[here + 8 : here + 9 + width])}".lstrip("/"), block, offset))
                    here += 9 + width
        elif kind in (2, 9):
            if kind == 2:
                start, fragment, begin, size = struct.unpack_from("<IIII", inodes, at)
            else:
                start, size, _, _, fragment, begin, _ = struct.unpack_from("<QQQIIII", inodes, at)
            n = size // block_size if fragment != NONE else -(-size // block_size)
            words = struct.unpack_from(f"<{n}I", inodes, at + (16 if kind == 2 else 40))
            yield node | {"kind": "file", "size": size, "blocks": list(stored(start, words, size, fragment, begin))}
        elif kind in (3, 10):
            _, width = struct.unpack_from("<II", inodes, at)
            yield node | {"kind": "link", "size": width, "target": inodes[at + 8 : at + 8 + width].decode("utf-8", "replace")}
        else:
            yield node | {"kind": {4: "block", 5: "char", 6: "fifo", 0: "socket"}.get(kind % 7, "other")}


def read_squashfs(images: DataFrame) -> DataFrame:
    """The nodes of little-endian SquashFS 4 images (zlib, LZMA or XZ), one row each but for the root; tails come from their fragments, holes are zeros."""
    number = lens.integer(F.col("content"), 20, 2, big=False)
    named = images.withColumn("codec", F.coalesce(*[F.when(number == k, name) for k, name in SQUASH_CODECS.items()])).where("codec is not null")
    return _files(named, _walked(_squashfs_walk, F.col("content")), F.array("codec"))


class _Meta:
    """A stream of metadata blocks that is being written."""

    def __init__(self, pack: Callable[[bytes], bytes]):
        self.out, self.now, self.pack = bytearray(), bytearray(), pack

    def add(self, data: bytes) -> tuple[int, int]:
        at = len(self.out), len(self.now)
        self.now += data
        while len(self.now) >= META:
            self.flush()
        return at

    def flush(self) -> None:
        raw = bytes(self.now[:META])
        if raw:
            packed = self.pack(raw)
            self.out += struct.pack("<H", len(packed)) + packed if len(packed) < len(raw) else struct.pack("<H", len(raw) | 0x8000) + raw
        self.now = self.now[META:]


def _squashfs_image(files: list[dict], codec: str, block_size: int) -> bytes:
    pack = codecs._ENCODERS[codec]
    image, tails, parts = bytearray(96), bytearray(), []
    inodes, names, table, ids = _Meta(pack), _Meta(pack), _Meta(pack), _Meta(pack)

    def settle() -> None:
        raw = bytes(tails)
        packed = pack(raw)
        less = len(packed) < len(raw)
        parts.append(struct.pack("<QII", len(image), len(packed) if less else len(raw) | 1 << 24, 0))
        image.extend(packed if less else raw)
        tails.clear()

    for f in files:
        tail = f["blocks"].pop() if f["size"] % block_size else None
        f["start"], f["fragment"], f["offset"] = len(image), NONE, 0
        for b in f["blocks"]:
            image += b["bytes"]
        if tail:
            raw = codecs.CODECS[codec](tail["bytes"], block_size)["data"] if tail["packed"] else tail["bytes"]
            if len(tails) + len(raw) > block_size:
                settle()
            f["fragment"], f["offset"] = len(parts), len(tails)
            tails += raw
    if tails:
        settle()
    dirs, refs, number = _tree(files), {}, 0
    for path in sorted(dirs, key=lambda p: (-p.count("/") if p else 1, p)):  # children before their parents
        listed = []
        for name, f in sorted(dirs[path].items()):
            if f is not None:
                number += 1
                words = [len(b["bytes"]) | (0 if b["packed"] else 1 << 24) for b in f["blocks"]]
                at = inodes.add(struct.pack("<HHHHIIIIII", 2, 0o644, 0, 0, 0, number, f["start"], f["fragment"], f["offset"], f["size"]) + struct.pack(f"<{len(words)}I", *words))
                listed.append((name, 2, at, number))
            else:
                listed.append((name, 1, *refs[f"{path}/{name}".lstrip("/")]))
        rows, k = [], 0
        while k < len(listed):
            base = listed[k]
            run = [e for e in listed[k : k + 256]]
            run = run[: next((i for i, e in enumerate(run) if e[2][0] != base[2][0] or abs(e[3] - base[3]) > 32767), len(run))]
            rows.append(struct.pack("<III", len(run) - 1, base[2][0], base[3]))
            rows += [struct.pack("<HhHH", e[2][1], e[3] - base[3], e[1], len(e[0].encode()) - 1) + e[0].encode() for e in run]
            k += len(run)
        listing = b"".join(rows)
        number += 1
        start, offset = names.add(listing)
        refs[path] = inodes.add(struct.pack("<HHHHIIIIIIHHI", 8, 0o755, 0, 0, 0, number, 2, len(listing) + 3, start, number + 1, 0, offset, NONE)), number
    for p in parts:
        table.add(p)
    ids.add(bytes(4))
    places = []
    for m in (inodes, names, table, ids):
        while m.now:
            m.flush()
        places.append(len(image))
        image += m.out
        if m is table:
            pointers = [places[2] + b for b in _metadata(bytes(m.out), 0, len(m.out), codec)[1]]
            places[2] = len(image)
            image += struct.pack(f"<{len(pointers)}Q", *pointers)
    id_list = len(image)
    image += struct.pack("<Q", places[3])
    root = refs[""][0]
    head = struct.pack("<4sIIIIHHHHHH", b"hsqs", number, 0, block_size, len(parts), next(k for k, c in SQUASH_CODECS.items() if c == codec), block_size.bit_length() - 1, 0, 1, 4, 0)
    image[:96] = head + struct.pack("<QQQQQQQQ", root[0] << 16 | root[1], len(image), id_list, (1 << 64) - 1, places[0], places[1], places[2], (1 << 64) - 1)
    return bytes(image)


def build_squashfs(entries: DataFrame, codec: str = "zlib", block_size: int = 1 << 17) -> DataFrame:
    """(image_id, content): a SquashFS 4 image of the rows (image_id, path, content) of each image.

    Tails of files share fragment blocks; a block that does not shrink is stored as it is. Paths are unique within an image
    and part by '/'; a null content is an empty file.
    """
    return _built(entries, codec, block_size, lambda fs: _squashfs_image(sorted(fs, key=lambda f: f["path"]), codec, block_size))


# --- YAFFS2 ---------------------------------------------------------------------------------------------------------

YAFFS_KINDS = {0: "unknown", 1: "file", 2: "link", 3: "dir", 4: "hard link", 5: "special"}
ROOT = 1  # the object id of the root, fixed by the format


def yaffs_chunks(images: DataFrame, page: int = 2048, spare: int = 64, tags_at: int = 0, big: bool = False) -> DataFrame:
    """(image_id, pos, seq, obj_id, chunk_id, n_bytes, data): the pages in use, with the tags of their spare bytes. chunk_id 0 is a header."""
    w = page + spare
    n = F.floor(F.octet_length("content") / w).cast("int")
    cuts = F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.substring("content", k * w + 1, F.lit(w))))
    rows = images.select("image_id", F.posexplode(cuts).alias("pos", "c"))
    tag = lambda k: lens.integer(F.col("c"), page + tags_at + 4 * k, 4, big)
    rows = rows.select("image_id", "pos", tag(0).alias("seq"), tag(1).alias("obj"), tag(2).alias("chunk"), tag(3).alias("n_bytes"), F.substring("c", 1, page).alias("data"))
    extra = F.col("chunk").bitwiseAND(F.lit(1 << 31)) != 0  # a header whose tags hold its parent and kind too
    rows = rows.where((F.col("obj") != NONE) & (F.col("seq") != NONE) & (F.col("obj") != 0))
    return rows.select("image_id", "pos", "seq", F.when(extra, F.col("obj").bitwiseAND(F.lit(0x0FFFFFFF))).otherwise(F.col("obj")).alias("obj_id"), F.when(extra, 0).otherwise(F.col("chunk")).alias("chunk_id"), "n_bytes", "data")


def yaffs_objects(chunks: DataFrame, big: bool = False) -> DataFrame:
    """(image_id, obj_id, kind, parent_id, name, mode, size, equiv_id, target): the newest header of each object."""
    newest = F.max_by("data", F.struct("seq", "pos"))
    h = chunks.where("chunk_id = 0").groupBy("image_id", "obj_id").agg(newest.alias("d"))
    number = lambda at: lens.integer(F.col("d"), at, 4, big)
    text = lambda at, n: F.decode(lens.unlens(F.regexp_extract(lens.lens(F.substring("d", at + 1, n)), r"(?s)^([^\x00]*)", 1)), "UTF-8")
    kind = F.element_at(F.create_map(*[F.lit(x) for kv in YAFFS_KINDS.items() for x in kv]), number(0).cast("int"))
    return h.select(
        "image_id", "obj_id", kind.alias("kind"), number(4).alias("parent_id"), text(10, 256).alias("name"), number(268).cast("int").alias("mode"), F.when(kind == "file", number(292)).otherwise(0).alias("size"),
        F.when(kind == "hard link", number(296)).alias("equiv_id"), F.when(kind == "link", text(300, 160)).alias("target"),
    )


def read_yaffs(images: DataFrame, page: int = 2048, spare: int = 64, tags_at: int = 0, big: bool = False) -> DataFrame:
    """(image_id, obj_id, path, kind, mode, size, target, content) of the objects that hang under the root; a hard link has its object's
    size and content. Of pages written anew the newest counts; deleted objects hang under no directory and have no row."""
    chunks = yaffs_chunks(images, page, spare, tags_at, big)
    objects = yaffs_objects(chunks, big)
    key = F.struct("image_id", "obj_id").alias("k")
    nodes = objects.where(F.col("obj_id") != ROOT).select(key, F.struct("image_id", F.col("parent_id").alias("obj_id")).alias("p"), "name")
    roots = images.select(F.struct("image_id", F.lit(ROOT).cast("long").alias("obj_id")).alias("k"), F.lit(None).cast(nodes.schema["p"].dataType).alias("p"), F.lit("").alias("name"))
    paths = tree_paths(nodes.unionByName(roots), "k", "p", "name").where("depth > 0").select(F.col("k.image_id").alias("i"), F.col("k.obj_id").alias("o"), F.substring("path", 2, 1 << 30).alias("path"))
    pages = chunks.where("chunk_id > 0").groupBy("image_id", "obj_id", "chunk_id").agg(F.max_by(F.substring(F.col("data"), F.lit(1), F.least("n_bytes", F.lit(page)).cast("int")), F.struct("seq", "pos")).alias("content"))
    data = join_parts(pages.select(F.struct("image_id", "obj_id").alias("image_id"), F.col("chunk_id").alias("ord"), "content")).select(F.col("image_id.image_id").alias("di"), F.col("image_id.obj_id").alias("do"), F.col("content").alias("whole"))
    sizes = objects.where("kind = 'file'").select(F.col("image_id").alias("si"), F.col("obj_id").alias("so"), F.col("size").alias("n"))
    rows = objects.join(paths, (F.col("image_id") == F.col("i")) & (F.col("obj_id") == F.col("o"))).withColumn("source", F.coalesce("equiv_id", "obj_id"))
    rows = rows.join(sizes, (F.col("image_id") == F.col("si")) & (F.col("source") == F.col("so")), "left").join(data, (F.col("image_id") == F.col("di")) & (F.col("source") == F.col("do")), "left")
    whole = F.when(F.col("n").isNotNull(), F.substring(F.coalesce("whole", F.lit(b"")), F.lit(1), F.col("n").cast("int")))
    return rows.select("image_id", "obj_id", "path", "kind", "mode", F.coalesce("n", F.lit(0)).cast("long").alias("size"), "target", whole.alias("content"))


def build_yaffs(objects: DataFrame, page: int = 2048, spare: int = 64, tags_at: int = 0, big: bool = False) -> DataFrame:
    """(image_id, content): a YAFFS2 image of the rows (image_id, obj_id, parent_id, kind, name, equiv_id, content), headers before data, by obj_id.

    Kinds are those of YAFFS_KINDS; the root has no row; equiv_id counts for hard links only. Unused bytes are FF.
    """
    code = F.element_at(F.create_map(*[F.lit(x) for k, v in YAFFS_KINDS.items() for x in (v, k)]), F.col("kind"))
    data = F.coalesce(F.when(F.col("kind") == "file", F.col("content")), F.lit(b""))
    number = lambda v: F.hex(lens.pack(v, 4, big))
    fill = lambda h, n: F.rpad(h, 2 * n, "F")
    tags = lambda chunk, n: fill(F.concat(F.lit("FF" * tags_at), number(F.lit(4097)), number(F.col("obj_id")), number(chunk), number(n)), spare)
    name = F.rpad(F.hex(F.encode("name", "UTF-8")), 512, "0")
    head = F.concat(number(code), number(F.col("parent_id")), F.lit("FFFF"), name, F.lit("0000"), number(F.when(F.col("kind") == "dir", 0o040755).otherwise(0o100644)), F.lit("0" * 40), number(F.octet_length(data)), number(F.coalesce("equiv_id", F.lit(0))))
    n = F.ceil(F.octet_length(data) / page).cast("int")
    piece = lambda k: F.substring(data, k * page + 1, F.lit(page))
    body = F.when(n > 0, F.array_join(F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.concat(fill(F.hex(piece(k)), page), tags(k + 1, F.octet_length(piece(k))))), "")).otherwise("")
    parts = objects.select("image_id", F.col("obj_id").alias("ord"), F.unhex(F.concat(fill(head, page), tags(F.lit(0), F.lit(0)), body)).alias("content"))
    return join_parts(parts)
