"""SimHash near-duplicates with pigeonring filtering.

A 64-bit fingerprint is the bitwise majority over the XXH64 hashes of a text's 3-word shingles.
Two fingerprints within r bits are found without comparing all pairs. The bits are a ring of r + 1
segments. If the differences of all segments add up to at most r, some segment begins a chain whose
running differences keep within the budgets floor(l * r / (r + 1)) for every length l: the first
segment is equal and the first two differ by at most one bit, so one half of the second is equal
too. First segment and half of the second are the join key (r + 1 segments by 2 halves per
fingerprint); the rest of the chain is checked before the full Hamming distance.

Documents of one fingerprint are one row in that join, so exact copies never meet pairwise, and a
fingerprint has at most sum(C(64, i), i <= r) neighbours, so links cannot grow with the square of a
group. Components come from distributed star contraction.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from octetlake.llm.common import checkpoint, row_hash, spare
from octetlake.llm.components import connected_components

SEED = 42
BLOCK = 1 << 20


def _blocks(text: bytes) -> Iterator[list[bytes]]:
    """The words of a text in blocks, so that a very long text never becomes one list."""
    at = 0
    while at < len(text):
        end = at + BLOCK
        while end < len(text) and not text[end : end + 1].isspace():
            end += 1
        yield text[at:end].split()
        at = end


def text_fingerprint(text: str | None, shingle: int = 3) -> int:
    """The fingerprint as a signed 64-bit integer; null or no words: 0."""
    ones, n, carry, short = np.zeros(64, dtype=np.int64), 0, [], True
    h = xxhash.xxh64_intdigest
    for words in _blocks((text or "").encode().lower()):
        words = carry + words
        if len(words) >= shingle:
            short = False
            ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
            starts = (ends - np.fromiter(map(len, words), np.int64, len(words)) - 1).tolist()
            flat, last = b" ".join(words), (ends[shingle - 1 :] - 1).tolist()
            got = np.array([h(flat[a:b], SEED) for a, b in zip(starts, last)], dtype=np.uint64)  # noqa: B905 the last starts begin no shingle
            ones += np.unpackbits(got.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
            n += len(got)
        carry = words[len(words) - shingle + 1 :] if len(words) >= shingle else words
    if short:
        if not carry:
            return 0
        return int(np.uint64(h(b" ".join(carry), SEED)).astype(np.int64))
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.int64)[0])


@F.arrow_udf(T.LongType())
def fingerprint(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for col in texts:
        yield pa.array([text_fingerprint(x.as_py()) for x in col], pa.int64())


def _segments(fp: Column, r: int) -> list[tuple[Column, int]]:
    """r + 1 segments of the 64 bits, with their widths."""
    out, at = [], 0
    for i in range(r + 1):
        width = (64 - at) // (r + 1 - i)
        out.append((F.shiftrightunsigned(fp, at).bitwiseAND(F.lit((1 << width) - 1)), width))
        at += width
    return out


def _keys(fp: Column, r: int) -> Column:
    """The chain keys of a fingerprint: (segment number, its value, which half of the next one, that half)."""
    seg, keys = _segments(fp, r), []
    for i, (value, _) in enumerate(seg):
        after, width = seg[(i + 1) % len(seg)]
        half = width // 2
        for k, part in enumerate((after.bitwiseAND(F.lit((1 << half) - 1)), F.shiftrightunsigned(after, half))):
            keys.append(F.struct(F.lit(i).alias("i"), F.shiftleft(value, 18).bitwiseOR(part).alias("v"), F.lit(k).alias("h")))
    return F.array(*keys)


def _chain(i: Column, diff: Column, r: int) -> Column:
    """The running differences from segment i on keep within their budgets."""
    counts = [F.bit_count(s) for s, _ in _segments(diff, r)]
    m, out = r + 1, F.lit(False)
    for start in range(m):
        ok, total = F.lit(True), F.lit(0)
        for n in range(1, m + 1):
            total = total + counts[(start + n - 1) % m]
            ok = ok & (total <= n * r // m)
        out = out | ((i == start) & ok)
    return out


def fingerprint_links(prints: DataFrame, r: int = 2) -> DataFrame:
    """(u, v): pairs of different fingerprints of prints (fp, distinct) within r bits, r from 1 to 7. A pair may be found by several keys."""
    keyed = prints.select("fp", F.explode(_keys(F.col("fp"), r)).alias("k")).select("fp", "k.*")
    a = keyed.select(F.col("fp").alias("u"), F.col("i").alias("ai"), F.col("v").alias("av"), F.col("h").alias("ah"))
    b = keyed.select(F.col("fp").alias("w"), "i", "v", "h")
    diff = F.col("u").bitwiseXOR(F.col("w"))
    same = (F.col("av") == F.col("v")) & (F.col("ai") == F.col("i")) & (F.col("ah") == F.col("h"))
    return a.join(b, same & (F.col("u") < F.col("w")) & _chain(F.col("i"), diff, r) & (F.bit_count(diff) <= r)).select("u", F.col("w").alias("v"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", r: int = 2) -> DataFrame:
    """One row per row of docs: (doc_id, fp, component_id).

    component_id is the smallest id among all documents that links reach. Null, empty and wordless
    texts share fingerprint 0. A null id gets its row too and never is a component's id unless all
    its members' ids are null. Repeated ids and rows keep their rows.
    """
    prints = checkpoint(docs.select(F.col(id_col).alias("doc_id"), fingerprint(F.col(text_col)).alias("fp")))
    distinct = checkpoint(prints.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = connected_components(fingerprint_links(distinct.select("fp"), r)).select(F.col("node").alias("fp"), "root")
    members = distinct.join(roots, "fp")
    least = members.groupBy("root").agg(F.min("least").alias("component"))
    linked = members.join(least, "root").select("fp", "component")
    names = checkpoint(distinct.join(linked, "fp", "left").select("fp", F.coalesce("component", "least").alias("component_id")))
    return prints.join(names, "fp").select("doc_id", "fp", "component_id")


def report(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 lower-case hex digits), component_id, kept."""
    return near_duplicates(docs).select(
        "doc_id",
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        "component_id",
        F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"),
    )


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", r: int = 2) -> DataFrame:
    """docs with one row of each group: the one with the smallest id, then fingerprint, then row hash. Columns stay as they are.

    Null ids come last. Different texts of one id, or of null ids, are rows of their own. Only the id and
    the row hash are joined back to the rows; of rows equal in both one stays.
    """
    tmp, row = spare(docs, "__kept_id"), spare(docs, "__row_hash")
    prints = docs.select(F.col(id_col).alias("doc_id"), fingerprint(F.col(text_col)).alias("fp"), row_hash(docs).alias("h"))
    rows = prints.groupBy("doc_id", "fp", "h").agg(F.count(F.lit(1)).alias("n"))
    best = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "h", "n"))
    best = checkpoint(rows.groupBy("fp").agg(best.alias("b")).select("fp", "b.*"))
    roots = connected_components(fingerprint_links(best.select("fp"), r)).select(F.col("node").alias("fp"), "root")
    first = F.min(F.struct("none", "doc_id", "fp", "h", "n"))
    kept = best.join(roots, "fp", "left").groupBy(F.coalesce("root", "fp").alias("root")).agg(first.alias("b"))
    kept = checkpoint(kept.select(F.col("b.doc_id").alias(tmp), F.col("b.h").alias("h"), F.col("b.n").alias("n")))  # one row of each group
    out = docs.withColumn(row, row_hash(docs))
    out = out.join(kept.select(tmp, "h"), out[id_col].eqNullSafe(kept[tmp]) & (out[row] == kept["h"]), "left_semi")
    if kept.where("n > 1").limit(1).count():
        out = out.dropDuplicates([id_col, row])
    return out.drop(row)
