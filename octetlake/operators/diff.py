"""Byte comparison of several blobs, duplicates and similarity."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from octetlake.functions.batches import stepwise

_NAMES = np.array(["green", "blue", "red"])
_DIGITS = np.array([*(f"{b:02X}" for b in range(256)), "XX"])  # the last one for -1
_LINE = [T.StructField("line_class", T.StringType()), *[T.StructField(f"n_{k}", T.LongType()) for k in ("green", "blue", "red")]]
_CELL = T.ArrayType(T.StructType([T.StructField("bytes", T.StringType()), T.StructField("kind", T.StringType())]))
_AT_ONCE = 256  # lines of three files that are compared together; fewer of more files


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers from each start on, one range after the other."""
    return np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())


def _codes(data: np.ndarray, size: np.ndarray, many: np.ndarray, files: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The class of each place of all rows, and the lines of each row. A row has `many` slices of data, of the given sizes, out of
    its number of files. 0 green: all equal; 2 red: all distinct (a missing byte is a value of its own); 1 blue: some; -1 beyond
    the longest slice. One file is all red."""
    begun, starts = np.cumsum(many) - many, np.cumsum(size) - size
    longest = np.maximum.reduceat(size, begun) if len(size) else size
    places = -(-longest // width) * width
    at, row = np.cumsum(places) - places, np.repeat(np.arange(len(many)), many)
    code = np.empty(places.sum(), np.int8)
    for k in np.unique(many):  # rows of as many slices side by side
        own, mine = many == k, many[row] == k
        n = places[own].sum()
        m = np.full(k * n, -1, np.int16)
        to = np.repeat(np.cumsum(places[own]) - places[own], k) + np.tile(np.arange(k) * n, own.sum())
        m[_ranges(to, size[mine])] = data[_ranges(starts[mine], size[mine])]
        s = np.sort(m.reshape(k, n), axis=0)
        present, all_of = (s >= 0).sum(axis=0), np.repeat(files[own], places[own])
        kinds = (s[0] >= 0) + ((s[1:] != s[:-1]) & (s[1:] >= 0)).sum(axis=0) + all_of - present
        found = np.where(kinds == all_of, 2, np.where(kinds == 1, 0, 1))
        code[_ranges(at[own], places[own])] = np.where(present > 0, found, -1)
    return code, places // width


def _cells(slices: pa.Array, files: np.ndarray, at: pa.Array, code: np.ndarray, lines: np.ndarray, width: int) -> pa.Array:
    """For each line an array of its cells; `at` has the place of each slice among the files of its group."""
    shown, first = [], 0
    for row, where, n, k in zip(slices, at, files, lines, strict=True):
        m = np.full((n, k * width), -1, np.int16)
        for i, v in zip(where.as_py(), row.as_py(), strict=True):
            m[i, : len(v)] = np.frombuffer(v, np.uint8)
        shown += [" ".join(x) for x in _DIGITS[m.T[code[first : first + k * width] >= 0]]]
        first += k * width
    there = code >= 0
    ends = np.cumsum([0, *there.reshape(-1, width).sum(axis=1)]).astype(np.int32)
    cells = pa.StructArray.from_arrays([pa.array(shown, pa.string()), _named(code[there])], ["bytes", "kind"])
    return pa.ListArray.from_arrays(pa.array(ends), cells)


def _named(code: np.ndarray) -> pa.Array:
    return pa.array(_NAMES).take(pa.array(code))


def _lines(width: int, cells: bool):
    @stepwise(T.ArrayType(T.StructType(_LINE + [T.StructField("cells", _CELL)] * cells)))
    def run(slices: pa.Array, files: pa.Array, *at: pa.Array) -> pa.Array:
        many, parts = slices.value_lengths().to_numpy().astype(np.int64), slices.flatten()
        size, n = pc.binary_length(parts).to_numpy().astype(np.int64), files.to_numpy()
        code, lines = _codes(np.frombuffer(b"".join(parts.to_pylist()), np.uint8), size, many, n, width)
        by_line = code.reshape(-1, width)
        n_of = [(by_line == k).sum(axis=1) for k in range(3)]
        columns = [_named(np.where(n_of[2] > 0, 2, np.where(n_of[1] > 0, 1, 0))), *map(pa.array, n_of)]
        if cells:
            columns.append(_cells(slices, n, at[0], code, lines, width))
        fields = [f.name for f in _LINE] + ["cells"] * cells
        return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *lines]).astype(np.int32)), pa.StructArray.from_arrays(columns, fields))

    return run


def _cut(content: Column, size: Column) -> Column:
    """Slices of a binary column with their offsets; one empty slice of an empty or null one, since a sequence to -1 is an error
    that no filter before it keeps off: the planner may evaluate it first. Beside an array the content is not copied for each slice."""

    def whole(c: Column) -> Column:
        last = F.greatest(F.octet_length(c) - 1, F.lit(0))
        return F.transform(F.sequence(F.lit(0), last, size), lambda at: F.struct(at.alias("offset"), F.substring(c, at + 1, size).alias("h")))

    return F.explode_outer(F.transform(F.array(F.coalesce(content, F.lit(b""))), whole)[0])  # outer: no filter repeats it


def hex_diff(files: DataFrame, width: int = 16, cells: bool = True) -> DataFrame:
    """(group_id, offset, cells, line_class, n_green, n_blue, n_red): rows of `width` bytes of the files (group_id, ord, content) of each group.

    cells are struct(hex digits of each file, 'XX' where it has ended; class); without them only the classes and numbers of
    cells are made. A row is green if all its cells are, red if any is red, else blue. Slices of the files meet by group
    and offset, so no file is exploded to bytes or lines; the lines of slices that met are compared as arrays. Rows of equal
    ord are files of their own, those without a group are left out. Slices are shorter in groups of many files.
    """
    order = [(-F.coalesce(F.octet_length("content"), F.lit(0))).alias("less"), F.xxhash64("content").alias("digest")] if cells else []
    # slices are cut beside the file and then made rows, so that no row carries the whole file
    rows = files.select("group_id", "ord", *order, _cut(F.col("content"), F.lit(width * _AT_ONCE)).alias("p")).select("*", "p.*").drop("p")
    # both sides are dealt by group, and stay so
    rows = rows.join(files.groupBy("group_id").agg(F.count(F.lit(1)).alias("files")), "group_id")
    again = _cut(F.col("h"), F.greatest(F.lit(1), F.least(F.lit(_AT_ONCE), F.floor(F.lit(3 * _AT_ONCE) / F.col("files")))).cast("int") * width)
    rows = rows.withColumnRenamed("offset", "start").withColumn("p", again).withColumn("offset", F.col("start") + F.col("p.offset")).withColumn("h", F.col("p.h"))
    by = rows.groupBy("group_id", "offset")
    if not cells:
        met = by.agg(F.first("files").alias("files"), F.collect_list("h").alias("slices"))
        made = _lines(width, cells)("slices", "files")
    else:
        # of files of equal ord those that are present come first, as they are in order of their length
        ords = files.groupBy("group_id").agg(F.array_sort(F.collect_list(F.struct("ord"))).alias("ords"))
        met = by.agg(F.first("files").alias("files"), F.array_sort(F.collect_list(F.struct(F.struct("ord").alias("o"), "less", "digest", "h"))).alias("s")).join(ords, "group_id")
        met = met.withColumn("at", F.transform("s", lambda x, i: (F.array_position(F.col("ords"), x["o"]) + i - F.array_position(F.col("s.o"), x["o"])).cast("int")))
        made = _lines(width, cells)("s.h", "files", "at")
    lines = met.select("group_id", F.col("offset").alias("start"), F.posexplode(made).alias("k", "l"))
    shown = ["l.cells"] * cells
    return lines.select("group_id", (F.col("start") + F.col("k") * width).cast("long").alias("offset"), *shown, "l.line_class", "l.n_green", "l.n_blue", "l.n_red")


def collapse(lines: DataFrame, show: tuple[str, ...] = ("red", "blue")) -> DataFrame:
    """Lines of the shown classes; each run of others becomes one row with `star`."""
    w = Window.partitionBy("group_id").orderBy("offset")
    marked = lines.withColumn("star", ~F.col("line_class").isin(*show))
    return marked.withColumn("again", F.coalesce(F.lag("star").over(w), F.lit(False))).where("not (star and again)").drop("again")


def duplicates(blobs: DataFrame) -> DataFrame:
    """(file_id, first_id): the smallest id with the same size and content; content is compared by its SHA-256."""
    keyed = blobs.select("file_id", F.octet_length("content").alias("size"), F.sha2("content", 256).alias("digest"))
    first = keyed.groupBy("size", "digest").agg(F.min("file_id").alias("first_id"))
    # an expression instead of the bare key: both sides get an exchange, so the rows of a hot digest can be split
    first = first.select((F.col("size") + 0).alias("s"), F.concat("digest", F.lit("")).alias("d"), "first_id")
    return keyed.join(first, (keyed["size"] == first["s"]) & (keyed["digest"] == first["d"])).select("file_id", "first_id")


def basename_groups(files: DataFrame) -> DataFrame:
    """(base, first_id, digest, members, kinds): of the files (file_id, base, digest), the classes of equal content under
    one base name, with the smallest id and the number of each class and the number of classes of the name. Pairs of
    equal name follow from the classes; they are not listed, since their number is quadratic."""
    classes = files.groupBy("base", "digest").agg(F.min("file_id").alias("first_id"), F.count(F.lit(1)).alias("members"))
    kinds = classes.groupBy("base").agg(F.count(F.lit(1)).alias("kinds")).withColumnRenamed("base", "b")
    return classes.join(kinds, F.col("base") == F.col("b")).select("base", "first_id", "digest", "members", "kinds")


_BASE64 = np.frombuffer(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", dtype=np.uint8)


def _rolled(b: np.ndarray) -> np.ndarray:
    """At each byte the low 32 bits of a hash of the seven bytes up to it (zeros before the first)."""
    roll = np.zeros(len(b), np.uint32)
    for k in range(min(7, len(b))):  # the byte k places before
        x = b[: len(b) - k].astype(np.uint32)
        roll[k:] += x * np.uint32(8 - k) + (x << np.uint32(5 * k))
    return roll


def _fnv(b: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The low six bits of an FNV hash of each piece of b that begins at starts.

    A step is h * p ^ x, of which a bit follows from the bit before it, the byte's, and lower bits of h alone. So bit by bit
    the steps of all pieces are one running XOR.
    """
    p, first = 0x01000193 & 63, 0x28021967 & 63
    before, length = np.zeros(len(b), np.uint8), np.diff([*starts, len(b)])
    last, out = starts + length - 1, np.zeros(len(starts), np.uint8)
    for k in range(6):
        low = before & np.uint8((1 << k) - 1)
        run = np.bitwise_xor.accumulate(((low * np.uint8(p)) ^ b) >> np.uint8(k) & np.uint8(1))
        # a piece begins with the first value's bit instead of what has run before it
        own = np.where(starts > 0, run[starts - 1], 0).astype(np.uint8) ^ np.uint8(first >> k & 1)
        out |= (run[last] ^ own) << np.uint8(k)
        if k < 5:
            bit = np.empty_like(run)
            bit[1:] = run[:-1] ^ np.repeat(own, length)[1:]
            bit[starts] = first >> k & 1
            before |= bit << np.uint8(k)
    return out


def _starts(roll: np.ndarray, size: int) -> np.ndarray:
    """Where the context-triggered pieces of a file begin at a block size: at most 64, the last one up to the end."""
    starts = np.concatenate([[0], np.flatnonzero(roll % np.uint32(size) == size - 1)[:63] + 1])
    return starts[starts < len(roll)]


@stepwise(T.StringType(), stream=False)
def fuzzy_hash(content: pa.Array) -> pa.Array:
    """A context-triggered piecewise hash 'blocksize:pieces:pieces at twice that'; null for null. There is one base-64 digit for each piece."""
    files = [x.as_py() for x in content]
    data = np.frombuffer(b"".join(v or b"" for v in files), dtype=np.uint8)
    rolled = _rolled(np.frombuffer(b"".join(bytes(6) + (v or b"") for v in files), dtype=np.uint8))  # the zeros before each first byte
    at, sizes, cuts = 0, [], ([], [])
    for k, v in enumerate(files):
        n, size = len(v or b""), 3
        while size * 64 < n:
            size *= 2
        roll = rolled[at + 6 * (k + 1) :][:n]
        once, twice = _starts(roll, size), _starts(roll, 2 * size)
        while len(once) < 32 and size > 3:
            size //= 2
            once, twice = _starts(roll, size), once
        sizes.append(size)
        for c, starts in zip(cuts, (once, twice), strict=True):
            c.append(starts + at)
        at += n
    shown = []
    for c in cuts:
        digits = _BASE64[_fnv(data, np.concatenate(c))].tobytes().decode() if len(data) else ""
        ends = np.cumsum([len(x) for x in c]).tolist()
        shown.append([digits[x:y] for x, y in zip([0, *ends], ends, strict=False)])
    return pa.array([None if v is None else f"{size}:{a}:{b}" for v, size, a, b in zip(files, sizes, *shown, strict=True)], pa.string())


def _common(x: str, y: str) -> int:
    """The length of the longest common subsequence; a bit for each place of x, zero where it grows."""
    places: dict[str, int] = {}
    for i, c in enumerate(x):
        places[c] = places.get(c, 0) | 1 << i
    whole = row = (1 << len(x)) - 1
    for c in y:
        hit = row & places.get(c, 0)
        row = (row + hit | row - hit) & whole
    return len(x) - row.bit_count()


def _similarity(a: str, b: str) -> int:
    """0 to 100 for two fuzzy hashes, by edit distance where they share seven pieces in a row."""
    sa, a1, a2 = a.split(":")
    sb, b1, b2 = b.split(":")
    best = 0
    for x, y in ((a1, b1), (a2, b2)) if sa == sb else ((a1, b2),) if int(sa) == 2 * int(sb) else ((a2, b1),) if int(sb) == 2 * int(sa) else ():
        if x == y and x:
            return 100
        grams = {x[i : i + 7] for i in range(len(x) - 6)}
        if not any(y[i : i + 7] in grams for i in range(len(y) - 6)):
            continue
        # a change costs 2, as much as taking out and putting in, so the distance is what the longest common subsequence leaves
        best = max(best, 100 - 100 * (len(x) + len(y) - 2 * _common(x, y)) // (len(x) + len(y)))
    return best


@stepwise(T.IntegerType())
def similarity(a: pa.Array, b: pa.Array) -> pa.Array:
    return pa.array([None if x is None or y is None else _similarity(x, y) for x, y in zip(a.to_pylist(), b.to_pylist(), strict=True)], pa.int32())


def similar_files(needles: DataFrame, haystack: DataFrame, cutoff: int = 1, same_name: bool = False) -> DataFrame:
    """(needle, file_id, score): files whose fuzzy hash scores at least cutoff against a needle's.

    Candidates share seven neighbouring pieces at a common block size, which any score above 0 needs
    (or the whole string, if it is shorter); so files meet by an equi-join, not all pairs. With
    same_name the base names must agree too. Hashes are computed once per file.
    """

    def grams(df: DataFrame, name: str) -> DataFrame:
        h = df.select(F.col("file_id").alias(name), fuzzy_hash("content").alias(f"{name}_hash"), *([F.element_at(F.split("path", "/"), -1).alias("base")] if same_name else []))
        p = F.split(f"{name}_hash", ":")
        size = F.element_at(p, 1).cast("long")

        def of(pieces, s):
            n = F.length(pieces)
            return F.transform(F.sequence(F.lit(1), F.greatest(n - 6, F.lit(1))), lambda i: F.struct(s.alias("size"), F.substring(pieces, i, F.lit(7)).alias("gram")))

        return h.withColumn("g", F.explode(F.array_distinct(F.concat(of(F.element_at(p, 2), size), of(F.element_at(p, 3), size * 2)))))

    keys = ["g", "base"] if same_name else ["g"]
    pairs = grams(needles, "needle").join(grams(haystack, "file_id"), keys).select("needle", "needle_hash", "file_id", "file_id_hash").distinct()
    return pairs.select("needle", "file_id", similarity("needle_hash", "file_id_hash").alias("score")).where(F.col("score") >= cutoff)
