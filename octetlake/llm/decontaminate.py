"""Benchmark decontamination: a broadcast hash set of normalised test n-grams.

Every item of the benchmark gives its windows of n consecutive words (an item of fewer words is one
window). Their 64-bit hashes form a sorted array that is broadcast; the documents' windows are
looked up there, each hit is verified word by word, and words covered by verified windows are hit.
No text is shuffled: the documents are scanned once and the answer is a column beside them.

Broadcast bound: windows are counted before they are sent. Up to max_windows go out at once. A
larger benchmark is cut into slices of its windows; the documents, written once with a row number, are
scanned for each slice, so that a task never holds more than one, and only the matches of rows that
have any come back to the rows. All slices together give the whole answer.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from octetlake.llm import wordscan
from octetlake.llm.common import WORD, ascii_lower, checkpoint, n_words, spare

MATCH = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("starts", T.ArrayType(T.LongType())),
        T.StructField("ends", T.ArrayType(T.LongType())),
        T.StructField("items", T.ArrayType(T.StringType())),
    ]
)
ARROW_MATCH = pa.struct([("n_words", pa.int64()), ("starts", pa.list_(pa.int64())), ("ends", pa.list_(pa.int64())), ("items", pa.list_(pa.string()))])


def item_windows(benchmark: DataFrame, n: int = 13, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(gram, items): each distinct window with the ids, as text, of the items that hold it.

    Items of null or wordless text have no window. The windows of items with a null id are kept: what
    they match is hit, but names no item.
    """
    words = F.regexp_extract_all(ascii_lower(F.coalesce(F.col(text_col), F.lit(""))), F.lit(f"({WORD})"), F.lit(1))
    item = benchmark.select(F.col(id_col).cast("string").alias("item"), words.alias("w")).where(F.size("w") > 0)
    last = F.greatest(F.size("w") - n, F.lit(0))
    gram = item.select("item", F.explode(F.transform(F.sequence(F.lit(0), last), lambda i: F.array_join(F.slice("w", i + 1, n), " "))).alias("gram"))
    return gram.groupBy("gram").agg(F.sort_array(F.collect_set("item")).alias("items"))


def _lookup(rows: list) -> tuple[dict[int, np.ndarray], dict[bytes, list[str]]]:
    """Sorted window hashes by number of words, and the items of each window."""
    table = {r["gram"].encode(): list(r["items"]) for r in rows}
    by: dict[int, list[int]] = {}
    for gram in table:
        data = np.frombuffer(gram, dtype=np.uint8)
        (w,) = wordscan.words(np.array([0, len(data)]), data)
        by.setdefault(len(w.hashes), []).append(int(wordscan.runs(w.hashes, len(w.hashes))[0]))
    return {k: np.unique(np.array(v, dtype=np.uint64)) for k, v in by.items()}, table


def _merge(starts: list[int], lens: list[int]) -> tuple[list[int], list[int]]:
    """Spans that touch or overlap, as one."""
    out: list[list[int]] = []
    for s, n in sorted(zip(starts, lens, strict=True)):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], s + n)
        else:
            out.append([s, s + n])
    return [s for s, _ in out], [e for _, e in out]


def _matches(col: pa.Array, hashes: dict[int, np.ndarray], table: dict[bytes, list[str]]) -> pa.Array:
    off, data = wordscan.string_buffers(col)
    n_words = np.zeros(len(off) - 1, dtype=np.int64)
    found: dict[int, tuple[list[int], list[int], set[str]]] = {}
    for w in wordscan.words(off, data):
        n_words[w.first : w.last] = w.counts
        first = np.concatenate([[0], np.cumsum(w.counts)])
        row = w.rows
        for n, known in hashes.items():
            r = wordscan.runs(w.hashes, n)
            if len(r) == 0:
                continue
            at = np.searchsorted(known, r)
            at[at == len(known)] = 0
            hit = np.flatnonzero(known[at] == r)
            for i in hit[row[hit] == row[hit + n - 1]]:  # a window stays within its document
                items = table.get(wordscan.normal(data, w.starts[i : i + n], w.ends[i : i + n]))
                if items is not None:
                    starts, lens, ids = found.setdefault(w.first + int(row[i]), ([], [], set()))
                    starts.append(int(i - first[row[i]]))
                    lens.append(n)
                    ids.update(items)
    spans = [_merge(*found[k][:2]) if k in found else ([], []) for k in range(len(n_words))]
    return pa.StructArray.from_arrays(
        [
            pa.array(n_words),
            pa.array([s for s, _ in spans], pa.list_(pa.int64())),
            pa.array([e for _, e in spans], pa.list_(pa.int64())),
            pa.array([sorted(found[k][2]) if k in found else [] for k in range(len(n_words))], pa.list_(pa.string())),
        ],
        fields=list(ARROW_MATCH),
    )


def _scanner(spark, rows: list):
    lookup = spark.sparkContext.broadcast(_lookup(rows))

    @F.arrow_udf(MATCH)
    def scan(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        hashes, table = lookup.value
        for col in texts:
            yield _matches(col, hashes, table)

    return scan


def find_contamination(docs: DataFrame, benchmark: DataFrame, n: int = 13, text_col: str = "text", match_col: str = "match", max_windows: int = 500_000) -> DataFrame:
    """docs with one more column: struct(n_words, starts, ends, items).

    starts and ends are word positions of disjoint spans covered by benchmark windows; items are the
    ids of the items found, as text, sorted. A null text has no words. An empty benchmark matches
    nothing. Rows are neither dropped nor merged, so repeated ids and rows stay as they are. A column
    that is already named match_col is replaced.
    """
    spark = docs.sparkSession
    grams = item_windows(benchmark, n)
    count = grams.count()
    if count <= max_windows:
        return docs.withColumn(match_col, _scanner(spark, grams.collect())(F.col(text_col)))
    slices = -(-count // max_windows) + 1
    part = checkpoint(grams.withColumn("slice", F.pmod(F.xxhash64("gram"), F.lit(slices))))
    row, other, all_ = (spare(docs, c) for c in ("__row", "__row2", "__matches"))
    rows = checkpoint(docs.withColumn(row, F.monotonically_increasing_id()))
    found = None
    for k in range(slices):
        new = _scanner(spark, part.where(F.col("slice") == k).drop("slice").collect())(F.col(text_col))
        hits = rows.select(F.col(row).alias(other), new.alias("m")).where(F.size("m.starts") > 0)
        found = checkpoint(hits) if found is None else found.unionByName(checkpoint(hits))
    found = found.groupBy(other).agg(F.collect_list("m").alias(all_))  # at most one entry a slice
    out = rows.join(found, rows[row] == found[other], "left").withColumn(match_col, _union(F.col(text_col), F.col(all_)))
    return out.select(*[c for c in docs.columns if c != match_col], match_col)


def _union(text: Column, matches: Column) -> Column:
    """The matches of one text by several slices (null: none) as one match."""
    every = F.coalesce(matches, F.array().cast("array<struct<n_words:bigint,starts:array<bigint>,ends:array<bigint>,items:array<string>>>"))
    pair = lambda s, e: F.struct(s.alias("s"), e.alias("e"))
    spans = F.array_sort(F.flatten(F.transform(every, lambda m: F.zip_with(m["starts"], m["ends"], pair))))
    merged = F.aggregate(
        spans,
        F.array().cast("array<struct<s:bigint,e:bigint>>"),
        lambda acc, x: F.when(
            (F.size(acc) > 0) & (F.element_at(acc, -1)["e"] >= x["s"]),
            F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(pair(F.element_at(acc, -1)["s"], F.greatest(F.element_at(acc, -1)["e"], x["e"])))),
        ).otherwise(F.concat(acc, F.array(x))),
    )
    items = F.array_sort(F.array_distinct(F.flatten(F.transform(every, lambda m: m["items"]))))
    return F.struct(n_words(text).alias("n_words"), merged["s"].alias("starts"), merged["e"].alias("ends"), items.alias("items"))


def n_hit(match: Column) -> Column:
    """Number of hit words of a match."""
    return F.aggregate(F.zip_with(match["ends"], match["starts"], lambda e, s: e - s), F.lit(0).cast("long"), lambda a, x: a + x)


def is_contaminated(match: Column, share: int = 20) -> Column:
    """At least one word in share is hit."""
    return (n_hit(match) > 0) & (share * n_hit(match) >= match["n_words"])


def remove_spans(text: Column, match: Column) -> Column:
    """The text without its hit words (and what stands between them), by word positions.

    Text before, between and after the spans is kept as it is, separators included; a null text stays null.
    """

    @F.arrow_udf(T.StringType())
    def cut(texts: pa.Array, matches: pa.Array) -> pa.Array:
        off, data = wordscan.string_buffers(texts)
        starts, ends = (pa.compute.struct_field(matches, k).to_pylist() for k in ("starts", "ends"))
        out: list[str | None] = texts.to_pylist()
        for w in wordscan.words(off, data):
            first = np.concatenate([[0], np.cumsum(w.counts)])
            for r in range(w.first, w.last):
                if starts[r]:
                    k, at, kept = first[r - w.first], int(off[r]), []
                    for s, e in zip(starts[r], ends[r], strict=True):
                        kept.append(data[at : w.starts[k + s]].tobytes())
                        at = int(w.ends[k + e - 1])
                    out[r] = b"".join([*kept, data[at : int(off[r + 1])].tobytes()]).decode()
        return pa.array(out, pa.string())

    return cut(text, match)


def decontaminate(docs: DataFrame, benchmark: DataFrame, action: str = "drop", n: int = 13, share: int = 20, text_col: str = "text") -> DataFrame:
    """The documents cleaned, with the columns they came with.

    action 'drop' leaves out documents of which at least one word in `share` is hit and keeps all
    others unchanged; 'cut' keeps every document and removes the hit spans from the text.
    """
    tmp = spare(docs, "__contamination")
    found = find_contamination(docs, benchmark, n, text_col, tmp)
    if action == "drop":
        found = found.where(~is_contaminated(F.col(tmp), share))
    elif action == "cut":
        found = found.withColumn(text_col, remove_spans(F.col(text_col), F.col(tmp)))
    else:
        raise ValueError(f"unknown action {action!r}")
    return found.select(*docs.columns)


def report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Per document of (doc_id, text): n_words, n_hit, n_items, items_sha256, contaminated, spans."""
    m = F.col("match")
    found = find_contamination(docs.select("doc_id", "text"), benchmark)
    return found.select(
        "doc_id",
        m["n_words"].alias("n_words"),
        n_hit(m).alias("n_hit"),
        F.size(m["items"]).cast("long").alias("n_items"),
        F.sha2(F.array_join(m["items"], ",").cast("binary"), 256).alias("items_sha256"),
        is_contaminated(m).alias("contaminated"),
    )


SQL = r"""
WITH item AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
gram AS (SELECT DISTINCT item, list_slice(w, i, least(i + 12, len(w))) AS g
         FROM item, unnest(generate_series(1, greatest(len(w) - 12, 1))) AS t(i) WHERE len(w) > 0),
d AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
lens AS (SELECT DISTINCT len(g) AS n FROM gram),
win AS (SELECT r, i, n, list_slice(w, i, i + n - 1) AS g FROM d, lens, unnest(generate_series(1, len(w) - n + 1)) AS t(i) WHERE len(w) >= n),
hit AS (SELECT r, i, n, item FROM win JOIN gram USING (g)),
cover AS (SELECT r, count(DISTINCT p) AS n_hit FROM hit, unnest(generate_series(i, i + n - 1)) AS t(p) GROUP BY r),
items AS (SELECT r, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS ids FROM hit GROUP BY r)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(d.w) AS contaminated
FROM d LEFT JOIN cover USING (r) LEFT JOIN items USING (r)
"""
