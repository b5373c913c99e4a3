"""Decompression as column functions: struct(ok, truncated, over, data, consumed) per value.

No command is ever run. `limit` bounds what one value may inflate to; a stream that passes it has `over`
set, which is a result of its own and no failure, and `parts` gives the whole of such a stream in rows of a
bounded size.
"""

from __future__ import annotations

import bz2
import lzma
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from octetlake.functions.batches import stepwise

LIMIT = 64 << 20
_BROKEN = (zlib.error, lzma.LZMAError, OSError, EOFError, ValueError)
RESULT = T.StructType([T.StructField("ok", T.BooleanType()), T.StructField("truncated", T.BooleanType()), T.StructField("over", T.BooleanType()), T.StructField("data", T.BinaryType()), T.StructField("consumed", T.LongType())])
_ARROW = pa.struct([("ok", pa.bool_()), ("truncated", pa.bool_()), ("over", pa.bool_()), ("data", pa.binary()), ("consumed", pa.int64())])


def _stream(decoder, data: bytes, limit: int) -> dict:
    out, fail = b"", False
    try:
        out = decoder.decompress(data, limit)
    except _BROKEN:
        fail = True
    eof = decoder.eof
    rest = getattr(decoder, "unused_data", b"") or b""
    more = getattr(decoder, "unconsumed_tail", b"") or b""
    over = len(out) >= limit and not eof
    return {"ok": not fail and eof and not over, "truncated": not fail and not eof and not over, "over": over, "data": out, "consumed": len(data) - len(rest) - len(more)}


def _lzma_alone(data: bytes, limit: int) -> dict:
    return _stream(lzma.LZMADecompressor(lzma.FORMAT_ALONE), data, limit)


def _lzma_modem(data: bytes, limit: int) -> dict:
    """LZMA whose header lacks the 8 bytes of the uncompressed size."""
    r = _lzma_alone(data[:5] + b"\xff" * 8 + data[5:], limit)
    return r | {"consumed": max(0, r["consumed"] - 8)}


CODECS: dict[str, Callable[[bytes, int], dict]] = {
    "gzip": lambda d, n: _stream(zlib.decompressobj(31), d, n),
    "zlib": lambda d, n: _stream(zlib.decompressobj(15), d, n),
    "deflate": lambda d, n: _stream(zlib.decompressobj(-15), d, n),
    "xz": lambda d, n: _stream(lzma.LZMADecompressor(lzma.FORMAT_XZ), d, n),
    "lzma": _lzma_alone,
    "lzma_modem": _lzma_modem,
    "bzip2": lambda d, n: _stream(bz2.BZ2Decompressor(), d, n),
}
#: Formats that are recognised but have no decoder here; extraction says so instead of losing them.
UNSUPPORTED = ("lzo", "lha", "rar", "arj", "compress", "stuffit")


def decoded(codec: str, col: pa.Array, limit: int = LIMIT) -> list[dict]:
    """The results of one codec for an array of values."""
    f = CODECS[codec]
    return [{"ok": False, "truncated": False, "over": False, "data": None, "consumed": 0} if v is None else f(v, limit) for v in (x.as_py() for x in col)]


def decode(codec: str, content: Column, limit: int = LIMIT) -> Column:
    """Decode by a codec's name; null and failures have ok false."""

    @stepwise(RESULT)
    def run(col: pa.Array) -> pa.Array:
        return pa.array(decoded(codec, col, limit), _ARROW)

    return run(content)


def decode_by(codec: Column, content: Column, limit: int = LIMIT) -> Column:
    """Decode each value by the codec named in its row; an unknown name has ok false."""

    @stepwise(RESULT)
    def run(names: pa.Array, col: pa.Array) -> pa.Array:
        out = []
        for name, v in zip(names.to_pylist(), col.to_pylist(), strict=True):
            f = CODECS.get(name)
            out.append(f(v, limit) if f and v is not None else {"ok": False, "truncated": False, "over": False, "data": None, "consumed": 0})
        return pa.array(out, _ARROW)

    return run(codec, content)


_DECODERS: dict[str, Callable[[], object]] = {
    "gzip": lambda: zlib.decompressobj(31), "zlib": lambda: zlib.decompressobj(15), "deflate": lambda: zlib.decompressobj(-15), "xz": lambda: lzma.LZMADecompressor(lzma.FORMAT_XZ),
    "lzma": lambda: lzma.LZMADecompressor(lzma.FORMAT_ALONE), "bzip2": lambda: bz2.BZ2Decompressor(),
}


def _pieces(codec: str, data: bytes, size: int) -> Iterator[bytes]:
    """What data inflate to, in pieces of at most `size` bytes, until the stream ends or wants more; an error is raised behind what came before it."""
    if codec == "lzma_modem":
        codec, data = "lzma", data[:5] + b"\xff" * 8 + data[5:]
    decoder = _DECODERS[codec]()
    while not decoder.eof:
        out = decoder.decompress(data, size)
        data = getattr(decoder, "unconsumed_tail", b"")
        if out:
            yield out
        elif not data and getattr(decoder, "needs_input", True):
            return


def is_valid(codec: str, content: Column, window: int | None = 33 << 10) -> Column:
    """The first bytes decode, or break off for want of more; only that is tolerated. What they decode to is not kept, however much it is.

    Without window the content is taken as it is: where encode_by has cut it, both then run in one worker.
    """

    def begins(v: bytes) -> bool:
        try:
            return sum(map(len, _pieces(codec, v, 64 << 10))) > 0
        except _BROKEN:
            return False

    @stepwise(T.BooleanType(), stream=False)
    def run(col: pa.Array) -> pa.Array:
        return pa.array([v is not None and begins(v) for v in (x.as_py() for x in col)], pa.bool_())

    return run(content if window is None else F.substring(content, F.lit(1), F.lit(window)))


def first_of(codecs: list[str], content: Column, limit: int = LIMIT) -> Column:
    """struct(codec, r): the first codec of the chain that decodes each value, and its result; null if none does. Later codecs are not tried."""

    @stepwise(T.StructType([T.StructField("codec", T.StringType()), T.StructField("r", RESULT)]))
    def run(col: pa.Array) -> pa.Array:
        out = []
        for v in col.to_pylist():
            tried = ((name, CODECS[name](v, limit)) for name in codecs) if v is not None else ()
            out.append(next(({"codec": name, "r": r} for name, r in tried if r["ok"] or r["over"]), None))
        return pa.array(out, pa.struct([("codec", pa.string()), ("r", _ARROW)]))

    return run(content)


def parts(blobs: DataFrame, codec: str, size: int = 16 << 20) -> DataFrame:
    """(file_id, part, data): what (file_id, content) inflates to, in parts of `size` bytes, however much it is.

    Parts stream out of the task one by one. A stream that breaks off gives what came before; null gives nothing.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for id_, v in zip(b.column("file_id"), b.column("content").to_pylist(), strict=True):
                try:
                    for k, data in enumerate(_pieces(codec, v, size) if v is not None else ()):
                        yield pa.RecordBatch.from_arrays([pa.array([id_.as_py()], b.column("file_id").type), pa.array([k], pa.int32()), pa.array([data], pa.binary())], ["file_id", "part", "data"])
                except _BROKEN:
                    continue

    kind = blobs.schema["file_id"].dataType.simpleString()
    return blobs.select("file_id", "content").mapInArrow(run, f"file_id {kind}, part int, data binary")


_FOUND = T.ArrayType(T.StructType([T.StructField("offset", T.LongType()), T.StructField("n", T.LongType())]))


def deflate_offsets(content: Column, window: int = 33 << 10, least: int = 64) -> Column:
    """Every offset where at least `least` bytes inflate without error (the costly scan; opt-in)."""

    @stepwise(_FOUND)
    def run(col: pa.Array) -> pa.Array:
        out = []
        for v in col.to_pylist():
            hits = []
            for at in range(len(v or b"")):
                if (v[at] & 7) in (2, 4, 3, 5):  # a block of fixed or dynamic codes
                    r = _stream(zlib.decompressobj(-15), v[at : at + window], 1 << 20)
                    if (r["ok"] or r["truncated"]) and len(r["data"]) >= least:
                        hits.append({"offset": at, "n": len(r["data"])})
            out.append(hits)
        return pa.array(out, pa.list_(pa.struct([("offset", pa.int64()), ("n", pa.int64())])))

    return run(content)


def lzma_offsets(content: Column, full: bool = False, window: int = 64 << 10, least: int = 64) -> Column:
    """Every offset where raw LZMA data follow, under the usual properties (or, with full, under all)."""
    props = [p for p in range(225) if p % 9 + p // 9 % 5 <= 4] if full else [0x5D, 0x6E]
    sizes = [1 << k for k in range(16, 26)] if full else [1 << 25]
    heads = [bytes([p]) + d.to_bytes(4, "little") + b"\xff" * 8 for p in props for d in sizes]

    @stepwise(_FOUND)
    def run(col: pa.Array) -> pa.Array:
        out = []
        for v in col.to_pylist():
            hits = []
            for at in range(len(v or b"")):
                if v[at] == 0:  # the range coder's first byte
                    for h in heads:
                        r = _lzma_alone(h + v[at : at + window], 1 << 20)
                        if (r["ok"] or r["truncated"]) and len(r["data"] or b"") >= least:
                            hits.append({"offset": at, "n": len(r["data"])})
                            break
            out.append(hits)
        return pa.array(out, pa.list_(pa.struct([("offset", pa.int64()), ("n", pa.int64())])))

    return run(content)


def _lzma(data: bytes, form: int, filter_id: int) -> bytes:
    """Preset 1 with a dictionary no larger than the data ask for: the encoder's tables, many MB else, are made anew for each value."""
    size = min(1 << 20, max(1 << 16, 1 << (len(data) - 1).bit_length()))
    return lzma.compress(data, form, filters=[{"id": filter_id, "preset": 1, "dict_size": size}])


_ENCODERS: dict[str, Callable[[bytes], bytes]] = {
    "gzip": lambda d: (lambda c: c.compress(d) + c.flush())(zlib.compressobj(6, zlib.DEFLATED, 31)),
    "zlib": lambda d: zlib.compress(d),
    "deflate": lambda d: (lambda c: c.compress(d) + c.flush())(zlib.compressobj(6, zlib.DEFLATED, -15)),
    "xz": lambda d: _lzma(d, lzma.FORMAT_XZ, lzma.FILTER_LZMA2),
    "lzma": lambda d: _lzma(d, lzma.FORMAT_ALONE, lzma.FILTER_LZMA1),
    "bzip2": lambda d: bz2.compress(d),
}


def encode_by(codec: Column, content: Column, first: int | None = None) -> Column:
    """Compress each value by the codec named in its row; null for an unknown name. With `first`, so many bytes of each are kept."""

    @stepwise(T.BinaryType(), stream=False)
    def run(names: pa.Array, col: pa.Array) -> pa.Array:
        return pa.array([_ENCODERS[n](v)[:first] if n in _ENCODERS and v is not None else None for n, v in zip(names.to_pylist(), col.to_pylist(), strict=True)], pa.binary())

    return run(codec, content)
