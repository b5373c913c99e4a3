"""The registered queries of the byte-analytics library and their SQL twins.

Each query runs over its whole table. Byte offsets are counted on UTF-8 bytes; floating results are
rounded to six places on both sides.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from octetlake.functions import checksums as cs
from octetlake.functions import lens
from octetlake.functions.layouts import decode_struct, encode_struct
from octetlake.operators import diff, image, packages, scan, stats
from octetlake.operators.rules import parse
from octetlake.sources.blobs import blocks, text_blobs

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _docs(spark, d):
    return text_blobs(_t(spark, d, "documents"), "doc_id", "text")


def _pages(spark, d):
    return text_blobs(_t(spark, d, "pages"), "page_id", "html")


HTML_RULES = r"""
0 string <html HTML document header
>5 byte !0x20
>>5 byte !0x3E {invalid}
0 string </html> HTML document footer
0 string <script Embedded script {many}
0 string <style Embedded style sheet
0 string </ Closing tag {many}{confidence:1}
0 string <title> HTML title
0 string <!DOCTYPE Document type {once}
0 string <p> Paragraph, {many}
>3 byte >64 capital: %c
"""

# --- signature scan ---------------------------------------------------------------------------------------


def _sql_offsets(lit: str, table: str = "pages", key: str = "page_id", col: str = "html") -> str:
    n = len(lit.encode())
    return f"""SELECT {key}, CAST(list_sum(list_transform(parts[1:i], lambda x: strlen(x))) + (i - 1) * {n} AS BIGINT) AS "offset", parts[i + 1] AS rest
FROM (SELECT {key}, string_split({col}, '{lit}') AS parts FROM {table} WHERE contains({col}, '{lit}')), unnest(generate_series(1, len(parts) - 1)) AS t(i)"""


@query(f"""SELECT page_id, "offset", 'HTML document header' AS description FROM ({_sql_offsets('<html')}) WHERE left(rest, 1) IN (' ', '>')""")
def html_header_scan(spark, d):
    rules = parse(HTML_RULES)
    hits = scan.scan(_pages(spark, d), [r for r in rules if r.title == "HTML document header"])
    return hits.select(F.col("file_id").alias("page_id"), "offset", "description")


@query(f"""SELECT page_id, "offset", '0x' || upper(to_hex("offset")) AS hexadecimal FROM ({_sql_offsets('</html>')})""")
def html_footer_scan(spark, d):
    hits = scan.literal_hits(_pages(spark, d), "</html>")
    return hits.select(F.col("file_id").alias("page_id"), "offset", F.concat(F.lit("0x"), F.hex("offset")).alias("hexadecimal"))


@query("""SELECT page_id, path, count(*) AS n FROM (SELECT page_id, unnest(regexp_extract_all(html, '(?:/[A-Za-z0-9_.-]+)+')) AS path FROM pages) GROUP BY ALL""")
def unix_path_scan(spark, d):
    chars = lens.lens(F.col("content"))
    found = F.regexp_extract_all(chars, F.lit(r"(?d)((?:/[A-Za-z0-9_.-]+)+)"), F.lit(1))
    return _pages(spark, d).select(F.col("file_id").alias("page_id"), F.explode(found).alias("path")).groupBy("page_id", "path").agg(F.count(F.lit(1)).alias("n"))


@query(" UNION ALL ".join(f"""SELECT doc_id, "offset", '{x}' AS needle FROM ({_sql_offsets(x, 'documents', 'doc_id', 'text')})""" for x in ("License", "ing ", "é", "tion")))
def raw_bytes_scan(spark, d):
    needles = ["License", "ing ", "é", "tion"]
    rules = [scan.raw_rule(x.encode()) for x in needles]
    found = scan.candidates(_docs(spark, d), rules)
    return found.select(F.col("file_id").alias("doc_id"), "offset", F.get(F.array(*map(F.lit, needles)), F.col("rule")).alias("needle"))


_RULE_HITS = " UNION ALL ".join(
    f"""SELECT page_id, "offset", '{t}' AS title, {c} AS confidence, {many} AS many, rest FROM ({_sql_offsets(x)})"""
    for x, t, c, many in (
        ("<script", "Embedded script", 7, "true"), ("<style", "Embedded style sheet", 6, "false"), ("</", "Closing tag", 1, "true"), ("</html>", "HTML document footer", 7, "false"),
        ("<title>", "HTML title", 7, "false"), ("<!DOCTYPE", "Document type", 9, "false"),
    )
)


def _page_hits(spark, d):
    rules = [r for r in parse(HTML_RULES) if r.title not in ("HTML document header", "Paragraph")]
    return scan.tested(_pages(spark, d), rules)


@query(f"""SELECT page_id, "offset", title, CAST(confidence AS INTEGER) AS confidence FROM ({_RULE_HITS}) QUALIFY row_number() OVER (PARTITION BY page_id, "offset" ORDER BY confidence DESC, title) = 1""")
def signature_priority_winner(spark, d):
    return scan.winners(_page_hits(spark, d)).select(F.col("file_id").alias("page_id"), "offset", "title", "confidence")


@query(f"""SELECT page_id, "offset", title FROM ({_RULE_HITS}) WHERE regexp_matches(lower(title), 'html|embedded') AND NOT regexp_matches(lower(title), 'style')""")
def include_exclude_filter(spark, d):
    rules = scan.select_rules(parse(HTML_RULES), ["HTML|embedded"], ["Style", "header"])
    hits = scan.tested(_pages(spark, d), rules)
    return hits.select(F.col("file_id").alias("page_id"), "offset", "title")


@query(f"""SELECT page_id, "offset" FROM (SELECT s.page_id, s."offset", strlen(p.html) AS n FROM ({_sql_offsets('</')}) s JOIN pages p USING (page_id)) WHERE "offset" + 64 <= n""")
def size_bounds_filter(spark, d):
    rules = parse("0 string </ Closing tag {size:64}")
    hits = scan.tested(_pages(spark, d), rules)
    return hits.select(F.col("file_id").alias("page_id"), "offset")


@query(
    f"""SELECT page_id, "offset", title FROM (SELECT *, lag(title) OVER (PARTITION BY page_id ORDER BY "offset") AS before FROM
(SELECT * FROM ({_RULE_HITS}) QUALIFY row_number() OVER (PARTITION BY page_id, "offset" ORDER BY confidence DESC, title) = 1)) WHERE NOT (many AND coalesce(before = title, false))"""
)
def run_suppression_many(spark, d):
    hits = scan.suppress_runs(scan.winners(_page_hits(spark, d))).where("display")
    return hits.select(F.col("file_id").alias("page_id"), "offset", "title")


@query(f"""SELECT page_id, "offset" FROM (SELECT page_id, "offset" FROM ({_sql_offsets('<!DOCTYPE')}) ORDER BY 1, 2 LIMIT 1)""")
def once_per_rule(spark, d):
    return scan.once(_page_hits(spark, d)).where("once").select(F.col("file_id").alias("page_id"), "offset")


@query(f"""SELECT page_id, "offset", 'Paragraph, capital: ' || left(rest, 1) AS description FROM ({_sql_offsets('<p>')}) WHERE ascii(left(rest, 1)) BETWEEN 65 AND 127
UNION ALL SELECT page_id, "offset", 'Paragraph,' FROM ({_sql_offsets('<p>')}) WHERE rest = '' OR ascii(left(rest, 1)) <= 64 OR ascii(left(rest, 1)) > 127""")
def printable_description_filter(spark, d):
    rules = [r for r in parse(HTML_RULES) if r.title == "Paragraph"]
    hits = scan.tested(_pages(spark, d), rules)
    return hits.select(F.col("file_id").alias("page_id"), "offset", "description")


# --- blocks, views, hashes -----------------------------------------------------------------------------------


@query("""SELECT doc_id, CAST(i AS INTEGER) AS block_id, CAST(i * 1024 AS BIGINT) AS start, CAST(least(1024, n - i * 1024) AS BIGINT) AS dlen, CAST(least(1152, n - i * 1024) AS BIGINT) AS n_bytes
FROM (SELECT doc_id, strlen(text) AS n FROM documents), unnest(generate_series(0, (n - 1) // 1024)) AS t(i) WHERE n > 0""")
def block_grid_count(spark, d):
    b = blocks(_docs(spark, d), 1024, 128)
    return b.select(F.col("file_id").alias("doc_id"), "block_id", "start", "dlen", F.octet_length("data").cast("long").alias("n_bytes"))


_SWAP = "unhex(regexp_replace(h[1:len(h) - len(h) % {w}], '{g}', '{r}', 'g') || {tail})"


@query("""SELECT doc_id, md5(unhex(regexp_replace(hex(encode(text)), '(..)(..)', '\\2\\1', 'g'))) AS digest FROM documents WHERE text IS NOT NULL""")
def byte_swap_2(spark, d):
    return _docs(spark, d).select(F.col("file_id").alias("doc_id"), F.md5(lens.swap(F.col("content"), 2)).alias("digest"))


@query("SELECT doc_id, CAST(strlen(text) AS BIGINT) AS size, md5(text) AS md5, sha1(text) AS sha1, sha256(text) AS sha256 FROM documents WHERE text IS NOT NULL")
def file_md5_sha(spark, d):
    c = F.col("content")
    return _docs(spark, d).select(F.col("file_id").alias("doc_id"), F.octet_length(c).cast("long").alias("size"), F.md5(c).alias("md5"), F.sha1(c).alias("sha1"), F.sha2(c, 256).alias("sha256"))


# Bytes of a table's texts in SQL: one row per byte.
def _sql_bytes(table: str = "documents", key: str = "doc_id", col: str = "text") -> str:
    return f"""SELECT {key}, i, CAST(('0x' || substr(h, 2 * i + 1, 2)) AS INTEGER) AS b FROM (SELECT {key}, hex(encode({col})) AS h, strlen({col}) AS n FROM {table}), unnest(generate_series(0, n - 1)) AS t(i) WHERE n > 0"""


@query(f"SELECT CAST(b AS INTEGER) AS byte, count(*) AS n FROM ({_sql_bytes()}) GROUP BY ALL")
def byte_histogram(spark, d):
    return stats.byte_histogram(_docs(spark, d))


_SQL_BLOCKS = f"""SELECT {{key}}, blk, sum(c) AS n, (log2(sum(c)) - sum(c * log2(c)) / sum(c)) / 8 AS entropy, 256 * sum(c * c) / sum(c) - sum(c) AS chi
FROM (SELECT {{key}}, i // {{size}} AS blk, b, CAST(count(*) AS DOUBLE) AS c FROM ({{bytes}}) GROUP BY ALL) GROUP BY ALL"""
_ENTROPY = _SQL_BLOCKS.format(key="doc_id", size=1024, bytes=_sql_bytes())


@query(f"SELECT doc_id, CAST(blk AS INTEGER) AS block_id, CAST(n AS BIGINT) AS n, round(entropy, 6) AS entropy FROM ({_ENTROPY})")
def shannon_entropy_blocks(spark, d):
    return stats.block_stats(_docs(spark, d)).select(F.col("file_id").alias("doc_id"), "block_id", "n", F.round("entropy", 6).alias("entropy"))


@query(f"SELECT doc_id, CAST(blk AS INTEGER) AS block_id, round(chi, 4) AS chi_square FROM ({_ENTROPY})")
def chi_square(spark, d):
    return stats.block_stats(_docs(spark, d)).select(F.col("file_id").alias("doc_id"), "block_id", F.round("chi_square", 4).alias("chi_square"))


@query(f"""SELECT doc_id, CAST(blk * 64 AS BIGINT) AS start, edge FROM (SELECT *, lag(edge) OVER (PARTITION BY doc_id ORDER BY blk) AS before FROM
(SELECT doc_id, blk, CASE WHEN entropy >= 0.53 THEN 'rising' WHEN entropy <= 0.49 THEN 'falling' END AS edge FROM ({_SQL_BLOCKS.format(key='doc_id', size=64, bytes=_sql_bytes())})) WHERE edge IS NOT NULL) WHERE before IS NULL OR before <> edge""")
def entropy_edges(spark, d):
    """Text never reaches the thresholds of packed data, so the blocks are short and the thresholds its own."""
    b = stats.block_stats(_docs(spark, d), 64)
    return stats.edges(b.withColumn("entropy", F.round("entropy", 9)), 0.53, 0.49).select(F.col("file_id").alias("doc_id"), "start", "edge")


@query(f"""SELECT doc_id, min(start) AS island_start, max(stop) AS island_end, count(*) AS n_blocks, round(max(entropy), 6) AS top_entropy FROM
(SELECT *, sum(turn) OVER (PARTITION BY doc_id ORDER BY start) AS run FROM (SELECT *, CAST(above <> lag(above, 1, false) OVER (PARTITION BY doc_id ORDER BY start) AS INTEGER) AS turn FROM
(SELECT doc_id, CAST(blk * 256 AS BIGINT) AS start, CAST(blk * 256 + n AS BIGINT) AS stop, entropy, entropy >= 0.52 AS above FROM ({_SQL_BLOCKS.format(key='doc_id', size=256, bytes=_sql_bytes())}))))
WHERE above GROUP BY doc_id, run HAVING max(stop) - min(start) >= 1024""")
def entropy_islands(spark, d):
    b = stats.block_stats(_docs(spark, d), 256)
    out = stats.islands(b, 0.52, 1024)
    return out.select(F.col("file_id").alias("doc_id"), "island_start", "island_end", "n_blocks", F.round("top_entropy", 6).alias("top_entropy"))


@query("""SELECT CAST(('0x' || t) AS BIGINT) AS tuple, count(*) AS n FROM (SELECT unnest(regexp_extract_all(hex(encode(text)), '.{6}')) AS t FROM documents) GROUP BY ALL ORDER BY n DESC, tuple LIMIT 1000""")
def byte_tuple_topk(spark, d):
    return stats.tuple_counts(_docs(spark, d), 1000)


@query(r"""SELECT page_id, CAST(len(s) AS BIGINT) AS n_strings, CAST(coalesce(list_sum(list_transform(s, lambda x: strlen(x))), 0) AS BIGINT) AS n_bytes FROM
(SELECT page_id, list_filter(regexp_extract_all(html, '([\x09-\x0d\x20-\x7e]{10,})[^\x09-\x0d\x20-\x7e]', 1), lambda x: true) AS s FROM pages WHERE html IS NOT NULL)""")
def printable_strings(spark, d):
    found = lens.strings(lens.lens(F.col("content")), 10)
    total = F.aggregate(found, F.lit(0).cast("long"), lambda a, x: a + F.length(x))
    return _pages(spark, d).select(F.col("file_id").alias("page_id"), F.size(found).cast("long").alias("n_strings"), total.alias("n_bytes"))


@query(r"""SELECT page_id, regexp_extract(html, '"([^\n]*)"', 1) AS quoted, strlen(regexp_replace(html, '(?s)"(.*)"', '')) AS n_left FROM pages WHERE html IS NOT NULL""")
def quoted_strings(spark, d):
    p = _t(spark, d, "pages").where("html is not null")
    return p.select("page_id", lens.quoted(F.col("html")).alias("quoted"), F.octet_length(lens.strip_quoted(F.col("html"))).cast("long").alias("n_left"))


# --- checksums ----------------------------------------------------------------------------------------------------


def _checksum(f):
    return lambda spark, d: _docs(spark, d).select(F.col("file_id").alias("doc_id"), f(F.col("content")).alias("checksum"))


def _sum_query(name: str, f, sql: str) -> None:
    q = _checksum(f)
    q.__name__ = name
    query(f"SELECT doc_id, CAST({sql} AS BIGINT) AS checksum FROM ({_sql_bytes()}) GROUP BY doc_id")(q)


_N = "(max(i) + 1)"
_sum_query("sum8_checksum", cs.sum8, "sum(b) % 256")
_sum_query("sum8_complement", cs.sum8_complement, "(256 - sum(b) % 256) % 256")
_sum_query("sum16_checksum", cs.sum16, "sum(CASE WHEN i % 2 = 0 THEN b ELSE b * 256 END) % 65536")
_sum_query("sum32_checksum", cs.sum32, "sum(b::BIGINT << ((i % 4) * 8)::INTEGER) % 4294967296")
_sum_query("xor32_checksum", cs.xor32, "bit_xor(b::BIGINT << ((i % 4) * 8)::INTEGER)")
_FOLD = "(({0} & 65535) + (({0} >> 16) & 65535))"
_C0, _C1 = "(sum(b)::BIGINT % 4294967296)", f"(sum(b::BIGINT * (n - i)) % 4294967296)::BIGINT"


@query(f"""WITH s AS (SELECT doc_id, (sum(b)::BIGINT % 4294967296)::BIGINT AS c0, (sum(b::HUGEINT * (n - i)) % 4294967296)::BIGINT AS c1
FROM ({_sql_bytes()}) JOIN (SELECT doc_id, strlen(text) AS n FROM documents) USING (doc_id) GROUP BY doc_id),
f AS (SELECT doc_id, (c0 & 65535) + (c0 >> 16) AS d0, (c1 & 65535) + (c1 >> 16) AS d1 FROM s)
SELECT doc_id, CAST(((((d1 >> 16) + d1) & 65535) << 16) | (((d0 >> 16) + d0) & 65535) AS BIGINT) AS checksum FROM f""")
def netgear_checksum(spark, d):
    return _checksum(cs.two_register_sum)(spark, d)


_KEY = b"\x5a\x13\xc7\x88\x01"


@query(f"""SELECT doc_id, CAST(i AS BIGINT) AS "offset", CAST(xor(b, list_extract([{', '.join(map(str, _KEY))}], CAST((i + 3) % {len(_KEY)} + 1 AS BIGINT))) AS INTEGER) AS byte FROM ({_sql_bytes('benchmark', 'item_id', 'text').replace('item_id', 'item_id AS doc_id', 1)})""")
def xor_mask_bytes(spark, d):
    """The benchmark's texts under a repeating key that begins in its fourth byte, byte by byte."""
    masked = lens.lens(cs.xor_mask(F.col("content"), _KEY, 3))
    bytes_ = F.transform(F.split(masked, ""), lambda c: F.ascii(c))
    rows = text_blobs(_t(spark, d, "benchmark"), "item_id", "text").where(F.octet_length("content") > 0)
    return rows.select(F.col("file_id").alias("doc_id"), F.posexplode(bytes_).alias("offset", "byte")).withColumn("offset", F.col("offset").cast("long"))


@query("SELECT doc_id, md5(text) AS digest FROM documents WHERE text IS NOT NULL")
def xor_mask_roundtrip(spark, d):
    twice = cs.xor_mask(cs.xor_mask(F.col("content"), _KEY, 3), _KEY, 3)
    return _docs(spark, d).select(F.col("file_id").alias("doc_id"), F.md5(twice).alias("digest"))


@query(f"""SELECT doc_id, CAST(i // 256 AS BIGINT) AS block_id, CAST({' + '.join(f"(sum(CASE WHEN ({k} < 3 AND ((j >> {min(k, 2)}) & 1) = {o}) OR ({k} >= 3 AND ((i >> {max(k - 3, 0)}) & 1) = {o}) THEN (b >> j) & 1 ELSE 0 END) % 2) * {1 << (2 * k + o)}" for k in range(11) for o in (0, 1))} AS BIGINT) AS checksum
FROM ({_sql_bytes()}), unnest(generate_series(0, 7)) AS u(j) GROUP BY doc_id, i // 256""")
def nand_parity_blocks(spark, d):
    """One row for each block of 256 bytes of each document."""
    parts = _docs(spark, d).select(F.col("file_id").alias("doc_id"), F.posexplode(cs.nand_parity_blocks(F.col("content"))).alias("block_id", "checksum"))
    return parts.withColumn("block_id", F.col("block_id").cast("long"))


@query()
def crc_family(spark, d):
    """CRC variants; DuckDB has none, so tests hold them against zlib and published check values."""
    c = F.col("content")
    return _docs(spark, d).select(
        F.col("file_id").alias("doc_id"), F.crc32(c).alias("crc32"), cs.crc32_raw(c).alias("crc32_raw"), cs.crc32_from_zero(c).alias("crc32_from_zero"),
        cs.crc16_ccitt(c).alias("crc16"), cs.posix_cksum(c).alias("cksum"), cs.hmac_sha1(c, b"key").alias("hmac"),
    )


# --- comparison, duplicates ---------------------------------------------------------------------------------------

_TRIO = "SELECT doc_id // 3 AS group_id, doc_id % 3 AS ord, text FROM documents WHERE text IS NOT NULL"


def _trios(spark, d):
    """Documents in groups of three neighbours; a null text is no file."""
    docs = text_blobs(_t(spark, d, "documents").where("text is not null"), "doc_id", "text")
    return docs.select(F.expr("file_id div 3").alias("group_id"), (F.col("file_id") % 3).alias("ord"), "content")


_SQL_DIFF = f"""WITH f AS ({_TRIO}), n AS (SELECT group_id, count(*) AS files, max(strlen(text)) AS longest FROM f GROUP BY 1),
b AS (SELECT group_id, i, count(DISTINCT h) AS kinds, count(*) AS present FROM (SELECT group_id, ord, i, substr(hex(encode(text)), 2 * i + 1, 2) AS h FROM f, unnest(generate_series(0, strlen(text) - 1)) AS t(i) WHERE strlen(text) > 0) GROUP BY ALL),
c AS (SELECT group_id, i, CASE WHEN kinds + files - present = files THEN 'red' WHEN kinds + files - present = 1 THEN 'green' ELSE 'blue' END AS kind FROM b JOIN n USING (group_id)),
l AS (SELECT group_id, i // 16 AS line, CASE WHEN bool_or(kind = 'red') THEN 'red' WHEN bool_or(kind = 'blue') THEN 'blue' ELSE 'green' END AS line_class, count(*) FILTER (kind = 'green') AS n_green, count(*) FILTER (kind = 'blue') AS n_blue, count(*) FILTER (kind = 'red') AS n_red FROM c GROUP BY ALL)
"""


@query(_SQL_DIFF + "SELECT group_id, CAST(line * 16 AS BIGINT) AS \"offset\", line_class, n_green, n_blue, n_red FROM l")
def hexdiff_classes(spark, d):
    return diff.hex_diff(_trios(spark, d), cells=False)


@query(_SQL_DIFF + """SELECT group_id, CAST(line * 16 AS BIGINT) AS "offset", star FROM (SELECT *, line_class = 'red' AS star, coalesce(lag(line_class = 'red') OVER (PARTITION BY group_id ORDER BY line), false) AS again FROM l) WHERE NOT (star AND again)""")
def hexdiff_collapse(spark, d):
    """Here the all-different lines are the ones that collapse: neighbouring documents rarely agree."""
    return diff.collapse(diff.hex_diff(_trios(spark, d), cells=False), ("green", "blue")).select("group_id", "offset", "star")


@query("SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS first_id FROM documents WHERE text IS NOT NULL")
def exact_dedup(spark, d):
    return diff.duplicates(_docs(spark, d)).select(F.col("file_id").alias("doc_id"), "first_id")


@query("""WITH p AS (SELECT page_id, regexp_extract(url, '([^/?#]*)/?(?:[?#].*)?$', 1) AS base, md5(html) AS digest FROM pages WHERE url IS NOT NULL),
c AS (SELECT base, digest, min(page_id) AS first_id, count(*) AS members FROM p WHERE base <> '' GROUP BY ALL)
SELECT base, first_id, digest, members, count(*) OVER (PARTITION BY base) AS kinds FROM c""")
def basename_similarity_join(spark, d):
    """Pages of one base name: classes of equal content with their size, from which the pairs follow."""
    base = F.regexp_extract("url", r"([^/?#]*)/?(?:[?#].*)?$", 1)
    p = _t(spark, d, "pages").where("url is not null").select(F.col("page_id").alias("file_id"), base.alias("base"), F.md5(F.encode("html", "UTF-8")).alias("digest")).where("base <> ''")
    return diff.basename_groups(p)


@query()
def fuzzy_hash_matches(spark, d):
    """Documents that resemble a document whose id is divisible by 100, by piecewise hashes."""
    docs = _docs(spark, d)
    return diff.similar_files(docs.where("file_id % 100 = 0"), docs, 1)


# --- rules, extraction ----------------------------------------------------------------------------------------------

_THETA = "(0, '^embedded', 'embedded'), (1, 'html', 'html'), (2, 'script', 'js'), (3, 'title|type', 'meta')"


@query(f"""SELECT page_id, "offset", priority, ext FROM ({_RULE_HITS}) h JOIN (VALUES {_THETA}) AS r(priority, regex, ext) ON regexp_matches(lower(h.title), r.regex)""")
def rule_theta_join(spark, d):
    rules = spark.sql(f"SELECT * FROM VALUES {_THETA} AS r(priority, regex, ext)")
    return scan.rule_matches(_page_hits(spark, d), rules).select(F.col("file_id").alias("page_id"), "offset", "priority", "ext")


@query("""SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'gzip' WHEN 1 THEN 'zlib' WHEN 2 THEN 'xz' ELSE 'bzip2' END AS codec, md5(text) AS digest FROM documents WHERE text IS NOT NULL""")
def first_success_codec(spark, d):
    """Documents packed by one of four codecs; the chain finds the one that unpacks each."""
    from octetlake.functions import codecs

    kind = F.element_at(F.array(*map(F.lit, ("gzip", "zlib", "xz", "bzip2"))), (F.col("file_id") % 4 + 1).cast("int"))
    packed = _docs(spark, d).select("file_id", codecs.encode_by(kind, F.col("content")).alias("p"))
    found = packed.select(F.col("file_id").alias("doc_id"), codecs.first_of(["bzip2", "xz", "zlib", "gzip"], F.col("p")).alias("f"))
    return found.select("doc_id", "f.codec", F.md5("f.r.data").alias("digest"))


@query("""WITH p AS (SELECT page_id, strlen(html) AS n, CASE WHEN contains(html, '<body') THEN strlen(string_split(html, '<body')[1]) ELSE strlen(html) END AS fs FROM pages WHERE html IS NOT NULL),
q AS (SELECT *, CASE WHEN fs < n THEN greatest(n // 64 * 64, fs) ELSE n END AS tail FROM p)
SELECT page_id, ord, kind, "offset", length FROM (SELECT page_id, 0 AS ord, 'kernel' AS kind, CAST(0 AS BIGINT) AS "offset", CAST(fs AS BIGINT) AS length FROM q UNION ALL SELECT page_id, 1, 'filesystem', fs, tail - fs FROM q UNION ALL SELECT page_id, 2, 'trailer', tail, n - tail FROM q) WHERE length > 0""")
def segment_split(spark, d):
    """The page's body takes the part of the filesystem."""
    images = _pages(spark, d).withColumnRenamed("file_id", "image_id")
    out = image.split_at_filesystem(images, ("<body",), 64)
    return out.withColumnRenamed("image_id", "page_id")


@query("""SELECT conv_id, turn, CAST(coalesce(sum(strlen(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset", CAST(coalesce(strlen(text), 0) AS BIGINT) AS size FROM conversations""")
def running_offset_layout(spark, d):
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    return _t(spark, d, "conversations").select("conv_id", "turn", F.coalesce(F.sum(size).over(w), F.lit(0)).cast("long").alias("offset"), size.alias("size"))


# --- packages, order, set operations -----------------------------------------------------------------------------------


@query("""SELECT c_custkey, CAST(coalesce(p.priority, 0) AS INTEGER) AS priority FROM customer c LEFT JOIN (SELECT o_custkey, CAST(min(o_totalprice) % 100 AS INTEGER) AS priority FROM orders GROUP BY 1) p ON p.o_custkey = c.c_custkey""")
def sort_priority_default(spark, d):
    pri = _t(spark, d, "orders").groupBy("o_custkey").agg(F.min("o_totalprice").alias("p")).select(F.col("o_custkey").alias("c_custkey"), F.rint(F.col("p") % 100).cast("int").alias("priority"))
    return packages.by_priority(_t(spark, d, "customer").select("c_custkey"), pri, 0, "c_custkey")


@query("""SELECT coalesce(s.k, c.k) AS k, coalesce(s.name, c.name) AS name, coalesce(s.nation, c.nation) AS nation FROM (SELECT c_custkey AS k, c_name AS name, c_nationkey AS nation FROM customer) c FULL JOIN (SELECT s_suppkey AS k, s_name AS name, s_nationkey AS nation FROM supplier) s ON s.k = c.k""")
def package_overlay(spark, d):
    base = _t(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("name"), F.col("c_nationkey").alias("nation"))
    new = _t(spark, d, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("name"), F.col("s_nationkey").alias("nation"))
    return packages.overlay(base, new, "k")


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL AND o_totalprice > 400000)")
def package_remove_anti(spark, d):
    gone = _t(spark, d, "orders").where("o_totalprice > 400000").select(F.col("o_custkey").alias("c_custkey"))
    return packages.remove(_t(spark, d, "customer").select("c_custkey", "c_name"), gone, "c_custkey")


@query("SELECT p_partkey FROM part EXCEPT SELECT l_partkey FROM lineitem WHERE l_quantity > 45")
def directory_listing_except(spark, d):
    return _t(spark, d, "part").select("p_partkey").subtract(_t(spark, d, "lineitem").where("l_quantity > 45").select(F.col("l_partkey").alias("p_partkey")))


# --- fields --------------------------------------------------------------------------------------------------------------


def _packed_events(spark, d):
    """Events as 13-byte records: id big-endian, user little-endian, kind one byte."""
    e = _t(spark, d, "events")
    record = encode_struct("event", {"event_id": F.col("event_id"), "user_id": F.col("user_id"), "kind": F.length("event_type")})
    return e.select("event_id", F.unix_seconds(F.col("ts").cast("timestamp")).alias("epoch"), record.alias("content"))


@query("SELECT event_id AS key, event_id, user_id, CAST(length(event_type) AS BIGINT) AS kind, CAST(0 AS BIGINT) AS beyond FROM events")
def be_le_field_decode(spark, d):
    s = F.col("s")
    rows = _packed_events(spark, d).select(F.col("event_id").alias("key"), decode_struct(F.col("content"), "event").alias("s"), lens.integer(F.col("content"), 10, 4).alias("beyond"))
    return rows.select("key", s["event_id"].alias("event_id"), s["user_id"].alias("user_id"), s["kind"].alias("kind"), "beyond")


@query("SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS created FROM events")
def epoch_date_decode(spark, d):
    packed = _packed_events(spark, d).select("event_id", lens.pack(F.col("epoch"), 4, big=False).alias("content"))
    return packed.select("event_id", lens.epoch_date(lens.integer(F.col("content"), 0, 4, big=False)).alias("created"))


@query("""WITH p AS (SELECT page_id, strlen(html) AS n, html, (page_id % 3) * 100 AS slack FROM pages WHERE html IS NOT NULL)
SELECT page_id, CASE WHEN page_id % 5 <> 4 THEN 'ok' ELSE 'too large' END AS status, CASE WHEN page_id % 5 <> 4 THEN sha256(unhex(hex(encode(html)) || repeat('FF', CAST(slack AS INTEGER)) || hex(encode('end')))) END AS digest FROM p""")
def assemble_with_padding(spark, d):
    p = _pages(spark, d)
    n = F.octet_length("content")
    size = F.when(F.col("file_id") % 5 == 4, n - 1).otherwise(n + 3 + F.col("file_id") % 3 * 100)
    parts = p.select(
        F.col("file_id").alias("image_id"), F.substring(F.col("content"), F.lit(1), F.lit(40)).alias("header"), F.substring(F.col("content"), F.lit(41), F.lit((1 << 31) - 1)).alias("filesystem"),
        F.lit(b"end").alias("footer"), size.alias("original_size"),
    )
    out = image.assemble(parts)
    return out.select(F.col("image_id").alias("page_id"), "status", F.sha2("content", 256).alias("digest"))


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """Hits of the default rules in all pages, with the entropy of the 1 KiB block that each stands in."""
    pages = _pages(spark, d)
    hits = scan.scan(pages, present_first=True)
    b = stats.block_stats(pages, 1024).select("file_id", "block_id", "entropy", "chi_square")
    joined = hits.withColumn("block_id", F.floor(F.col("offset") / 1024).cast("int")).join(b, ["file_id", "block_id"])
    return joined.select(F.col("file_id").alias("page_id"), "offset", "description", "display", F.round("entropy", 6).alias("entropy"), F.round("chi_square", 4).alias("chi_square"))


@query()
def page_signatures_with_entropy(spark, d):
    return flagship(spark, d)
