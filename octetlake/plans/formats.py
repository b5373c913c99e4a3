"""Queries over packed data: formats are written from the tables and read back, so that SQL knows what must come out."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from octetlake.functions import checksums as cs
from octetlake.functions import codecs, lens
from octetlake.functions.layouts import decode_struct, encode_struct
from octetlake.operators import archives, extract, filesystems, image, packages, rules, scan, stats, vendors
from octetlake.plans.catalog import _docs, _sql_bytes, _t, query
from octetlake.plans.shared import checkpoint, spread, written
from octetlake.sources.blobs import limited, text_blobs

BIG = (1 << 31) - 1


def _talks(spark, d) -> DataFrame:
    """Conversations as (conv_id, turn, content); null texts are empty."""
    return _t(spark, d, "conversations").select("conv_id", "turn", F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("content"))


# --- the scan's tests and orders, on packed orders ---------------------------------------------------------------

_RECORD_RULES = r"""
0 string MAGI Record,
>4 ulelong x customer %d,
>8 ubyte&0x0F >7 high nibble,
>8 ubyte^0xFF <56 large kind,
>11 byte &4 flag set,
>(9.S+0) string NAME name
>>&0 string x %s
>13 ubyte x  {strlen:%d}
>14 string x counted %s {string}
"""


def _records(spark, d) -> DataFrame:
    """Orders as blobs: some dots, then a record that points to its own name field."""
    o = spread(_t(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus"), "o_orderkey")
    k = F.col("o_orderkey")
    n = F.pmod(k, F.lit(5)).cast("int")
    body = F.concat(
        F.lit(b"MAGI"), lens.pack(F.col("o_custkey"), 4, big=False), lens.pack(F.pmod(k, F.lit(200)), 1), lens.pack(F.lit(24), 2), lens.pack(F.pmod(k, F.lit(16)), 1), F.lit(b"\0"), lens.pack(n, 1),
        F.substring(F.lit(b"abcdefghij"), F.lit(1), n), F.unhex(F.repeat(F.lit("2E"), 10 - n)), F.lit(b"NAME"), F.encode("o_orderstatus", "UTF-8"), F.lit(b"\0"),
    )
    return o.select(F.col("o_orderkey").alias("file_id"), F.concat(F.unhex(F.repeat(F.lit("2E"), F.pmod(k, F.lit(7)).cast("int"))), body).alias("content"))


@query("""SELECT o_orderkey, CAST(o_orderkey % 7 AS BIGINT) AS "offset", 'Record, customer ' || o_custkey || ',' || CASE WHEN ((o_orderkey % 200) & 15) > 7 THEN ' high nibble,' ELSE '' END
|| CASE WHEN 255 - o_orderkey % 200 < 56 THEN ' large kind,' ELSE '' END || CASE WHEN ((o_orderkey % 16) & 4) <> 0 THEN ' flag set,' ELSE '' END || ' name ' || o_orderstatus
|| ' counted ' || left('abcdefghij', CAST(o_orderkey % 5 AS INTEGER)) AS description FROM orders""")
def record_rule_tree(spark, d):
    """Operands before a test, conditions on bits, indirect and relative offsets, counted strings."""
    hits = scan.scan(_records(spark, d), rules.parse(_RECORD_RULES))
    return hits.select(F.col("file_id").alias("o_orderkey"), "offset", F.concat(F.rtrim("description"), F.when(F.endswith(F.rtrim("description"), F.lit("counted")), " ").otherwise("")).alias("description"))


@query("""SELECT o_orderkey, CAST(o_orderkey % 7 AS BIGINT) AS "offset" FROM orders WHERE o_orderkey % 7 = 0""")
def prefix_match(spark, d):
    hits = scan.prefix_match(_records(spark, d), rules.parse(_RECORD_RULES))
    return hits.select(F.col("file_id").alias("o_orderkey"), "offset")


@query("""SELECT o_orderkey, CAST(o_orderkey % 7 + 24 AS BIGINT) AS "offset" FROM orders WHERE o_orderstatus IN ('F', 'O')""")
def regex_rule_scan(spark, d):
    hits = scan.scan(_records(spark, d), rules.parse("0 regex NAME[FO] Closed or open record {confidence:5}"))
    return hits.select(F.col("file_id").alias("o_orderkey"), "offset")


@query("""SELECT o_orderkey, CAST(o_orderkey % 7 AS BIGINT) AS "offset", CAST(o_orderkey % 7 + 2 AS BIGINT) AS adjusted FROM orders""")
def anchor_shift_and_adjust(spark, d):
    """A magic that stands inside its record, and a rule that moves its hit."""
    blobs = _records(spark, d)
    a = scan.scan(blobs, rules.parse("24 string NAME Record by its name")).select("file_id", "offset")
    b = scan.scan(blobs, rules.parse("0 string MAGI Record\n>4 byte x  {adjust:2}")).select(F.col("file_id").alias("f"), F.col("offset").alias("adjusted"))
    return a.join(b, F.col("file_id") == F.col("f")).select(F.col("file_id").alias("o_orderkey"), "offset", "adjusted")


@query("""SELECT o_orderkey, ("a" * 3 + 7) // 4 AS x, CASE WHEN o_custkey % 3 = 0 THEN NULL ELSE "a" // (o_custkey % 3) END AS y, -"a" + xor("a", 255) AS z FROM (SELECT *, o_orderkey % 1000 AS "a" FROM orders)""")
def safe_arithmetic(spark, d):
    o = _t(spark, d, "orders")
    a, b = F.pmod("o_orderkey", F.lit(1000)), F.pmod("o_custkey", F.lit(3))
    return o.select("o_orderkey", rules.expression("(a * 3 + 7) / 4", a=a).alias("x"), rules.expression("a / b", a=a, b=b).alias("y"), rules.expression("-a + (a ^ 255)", a=a).alias("z"))


@query("SELECT c_custkey, 0 AS ord, CAST(0 AS BIGINT) AS \"offset\", 'Box' AS title FROM customer UNION ALL SELECT c_custkey, 1, CAST(24 + c_custkey % 5 AS BIGINT), 'Thing' FROM customer")
def jump_regions(spark, d):
    """What stands inside a box that the scan jumps over is no hit; what follows it is."""
    c = _t(spark, d, "customer")
    n = F.pmod("c_custkey", F.lit(5)).cast("int")
    box = F.concat(F.lit(b"BOXX"), lens.pack(n + 24, 4, big=False), F.lit(b"..MAGI..BOXX...."), F.unhex(F.repeat(F.lit("2E"), n)), F.lit(b"MAGI"))
    hits = scan.scan(c.select(F.col("c_custkey").alias("file_id"), box.alias("content")), rules.parse("0 string MAGI Thing\n0 string BOXX Box\n>4 ulelong x  {jump:%d}"))
    return hits.select(F.col("file_id").alias("c_custkey"), F.when(F.col("title") == "Box", 0).otherwise(1).alias("ord"), "offset", "title")


@query("""SELECT conv_id, title, count(*) AS n, sum(CAST("extract" AS INTEGER)) AS extracted FROM (SELECT conv_id, 'Entry' AS title, row_number() OVER (PARTITION BY conv_id, turn % 2 ORDER BY turn) = 1 AS "extract" FROM
(SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS turn FROM conversations)) GROUP BY ALL HAVING false
UNION ALL SELECT conv_id, t, n, CASE WHEN t = 'Entry' THEN 1 ELSE n END FROM (SELECT conv_id, count(*) AS c FROM conversations GROUP BY 1), (VALUES ('Entry'), ('End')) v(t), LATERAL (SELECT CASE WHEN t = 'Entry' THEN c ELSE 1 END AS n)""")
def archive_grouping(spark, d):
    """Of the entries of an archive only the first is extracted, and its end record."""
    parts = _talks(spark, d).select(F.col("conv_id").alias("image_id"), F.col("turn").alias("ord"), F.lit(b"ENTR....").alias("content"))
    blobs = image.join_parts(parts).select(F.col("image_id").alias("file_id"), F.concat("content", F.lit(b"ENDR")).alias("content"))
    hits = scan.group_entries(scan.scan(blobs, rules.parse("0 string ENTR Entry\n0 string ENDR End")), "Entry", "End")
    return hits.groupBy(F.col("file_id").alias("conv_id"), "title").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("extract").cast("int")).alias("extracted"))


@query("""SELECT s_suppkey, CAST(k * 128 AS BIGINT) AS "offset", k = 0 AS display FROM supplier, (VALUES (0), (1), (2), (3)) v(k)""")
def erase_block_stride(spark, d):
    """Headers at whole erase blocks; one that stands between two blocks and one with a wrong checksum are none."""
    s = _t(spark, d, "supplier")
    head = F.concat(F.lit(b"UBI#\x01\0\0\0"), lens.pack(F.col("s_suppkey"), 8), F.lit(bytes(44)))
    good = F.concat(head, lens.pack(cs.crc32_raw(head), 4))
    block = F.concat(good, F.lit(bytes(64)))
    odd = F.concat(good, F.lit(bytes(10)), F.substring(head, 1, 50), F.lit(bytes(4)))
    blobs = s.select(F.col("s_suppkey").alias("file_id"), F.concat(block, block, block, odd).alias("content"))
    hits = scan.stride(scan.tested(blobs, [r for r in rules.default_rules() if r.title.startswith("UBI")]), "UBI")
    return hits.select(F.col("file_id").alias("s_suppkey"), "offset", "display")


@query("SELECT s_suppkey, big, true AS good, false AS bad FROM supplier, (VALUES (true), (false)) v(big)")
def jffs2_node_check(spark, d):
    s = _t(spark, d, "supplier")

    def node(big: bool) -> Column:
        head = F.concat(lens.pack(F.lit(0x1985), 2, big), lens.pack(F.lit(0xE001), 2, big), lens.pack(F.col("s_suppkey") + 12, 4, big))
        return F.concat(F.lit(b"..."), head, lens.pack(cs.crc32_from_zero(head), 4, big))

    rows = s.select("s_suppkey", F.explode(F.array(*[F.struct(F.lit(b).alias("big"), node(b).alias("c")) for b in (True, False)])).alias("x")).select("s_suppkey", "x.*")
    return rows.select("s_suppkey", "big", scan.jffs2_node_ok(F.col("c"), F.lit(3)).alias("good"), scan.jffs2_node_ok(F.col("c"), F.lit(2)).alias("bad"))


@query("""SELECT p_partkey, CAST(8 * k AS BIGINT) AS "offset", CASE k WHEN 0 THEN 'MIPS' WHEN 1 THEN 'PowerPC' WHEN 2 THEN 'x86-64' ELSE 'AArch64' END AS machine FROM part, generate_series(0, CAST(p_size % 4 AS BIGINT)) AS t(k)""")
def opcode_search(spark, d):
    """Function starts and ends of four machines, as many as each part's size says."""
    code = b"\x03\xe0\x00\x08....\x4e\x80\x00\x20....\x55\x48\x89\xe5....\xc0\x03\x5f\xd6...."
    blobs = _t(spark, d, "part").select(F.col("p_partkey").alias("file_id"), F.substring(F.lit(code), F.lit(1), ((F.col("p_size") % 4 + 1) * 8).cast("int")).alias("content"))
    hits = scan.tested(blobs, rules.opcode_rules())
    return hits.select(F.col("file_id").alias("p_partkey"), "offset", F.regexp_extract("title", "^(.*) instructions$", 1).alias("machine"))


@query("""SELECT o_orderkey, CAST(o_orderkey % 7 AS BIGINT) AS "offset", 'Record' AS description, 'record' AS kind FROM orders""")
def scan_log_round_trip(spark, d):
    """The scan's log table as printed lines, read again; a line that is no result is left out."""
    log = scan.log_table(scan.scan(_records(spark, d), rules.parse("0 string MAGI Record")))
    line = F.concat(F.rpad(F.col("decimal").cast("string"), 14, " "), F.rpad("hexadecimal", 16, " "), "description")
    lines = log.select("file_id", F.explode(F.array(line, F.lit("DECIMAL       HEXADECIMAL     DESCRIPTION"), F.lit("12  0xFF  not the same"))).alias("line"))
    return scan.read_log(lines).select(F.col("file_id").alias("o_orderkey"), "offset", "description", "kind")


# --- extraction -------------------------------------------------------------------------------------------------------


def _nested(spark, d) -> DataFrame:
    """Conversations as gzip inside zlib, behind bytes that are no magic."""
    t = _talks(spark, d)
    inner = t.select("conv_id", "turn", codecs.encode_by(F.lit("gzip"), F.concat(F.lit(b"Text: "), F.col("content"), F.lit(b" :end of text"))).alias("c"))
    outer = inner.select("conv_id", "turn", codecs.encode_by(F.lit("zlib"), F.concat(F.lit(b"...."), F.col("c"))).alias("c"))
    return outer.select(F.struct("conv_id", "turn").alias("file_id"), F.concat(F.lit(b"######"), F.col("c")).alias("content"))


@query("""SELECT conv_id, turn, generation, path, ext, status, CASE generation WHEN 2 THEN md5('Text: ' || coalesce(text, '') || ' :end of text') END AS digest FROM conversations, (VALUES (1, '/6.zlib', 'zlib', 'extracted'), (2, '/6.zlib/4.gz', 'gz', 'extracted')) v(generation, path, ext, status)""")
def extract_recursive(spark, d):
    blobs = _nested(spark, d).select(F.xxhash64("file_id.conv_id", "file_id.turn").alias("file_id"), "file_id.conv_id", "file_id.turn", "content")
    packed = [r for r in rules.default_rules() if r.title.startswith(("Gzip", "Zlib"))]
    out = extract.extract(blobs, [("^gzip", "gz", "gzip", True), ("^zlib", "zlib", "xz", True), ("^zlib", "zlib", "zlib", True)], scan_rules=packed)
    ids = blobs.select(F.col("file_id").alias("root_id"), "conv_id", "turn")
    out = out.where("offset = case generation when 1 then 6 else 4 end")  # compressed bytes may look like a magic by chance
    return out.join(ids, "root_id").select("conv_id", "turn", "generation", "path", "ext", "status", F.when(F.col("generation") == 2, F.md5("content")).alias("digest"))


@query("""SELECT o_orderkey, upper(to_hex(o_orderkey % 7)) || '.rec' AS name, CAST(12 AS BIGINT) AS size, md5('MAGI') AS head FROM orders""")
def carve_names(spark, d):
    """Hits cut out by offset and size, at most 12 bytes of each."""
    blobs = _records(spark, d)
    hits = scan.rule_matches(scan.scan(blobs, rules.parse("0 string MAGI Record {size:20}")), extract.rule_table(spark, [("^record", "rec", None, False)]))
    cut = extract.carve(extract.eligible(hits, 1), blobs, 12)
    return cut.select(F.col("parent_id").alias("o_orderkey"), "name", "size", F.md5(F.substring("content", 1, 4)).alias("head"))


@query("""SELECT conv_id, turn, status FROM conversations, (VALUES (0, 'over'), (1, 'unsupported'), (2, 'carved'), (3, 'failed')) v(k, status) WHERE (conv_id + turn) % 4 = k""")
def extraction_outcomes(spark, d):
    """A stream beyond the limit, a format without decoder, a rule without codec, and a chain in which nothing decodes."""
    t = _talks(spark, d)
    k = F.pmod(F.col("conv_id") + F.col("turn"), F.lit(4)).cast("int")
    whole = F.concat(F.lit(b"SIGN"), F.when(k == 0, codecs.encode_by(F.lit("gzip"), F.concat(F.col("content"), F.lit(bytes(100))))).otherwise(F.col("content")))
    blobs = t.select(F.struct("conv_id", "turn").alias("file_id"), F.substring(whole, F.lit(5), F.lit(BIG)).alias("content"), k.alias("k"))
    plan = {0: ["gzip"], 1: ["gzip", "lzo"], 2: ["xz", None, "gzip"], 3: ["xz", "bzip2"]}
    chain = lambda n: F.array(*[F.struct(F.lit(i).alias("priority"), F.lit("x").alias("ext"), F.lit(c).cast("string").alias("codec"), F.lit(True).alias("recurse")) for i, c in enumerate(plan[n])])
    chained = blobs.withColumn("offset", F.lit(0).cast("long")).withColumn("size", F.lit(None).cast("long")).withColumn("chain", F.when(F.col("k") == 0, chain(0)).when(F.col("k") == 1, chain(1)).when(F.col("k") == 2, chain(2)).otherwise(chain(3))).select("file_id", "offset", "size", "chain")
    out = extract.first_success(chained, blobs.select("file_id", "content"), limit=50)
    return out.select("parent_id.conv_id", "parent_id.turn", "status")


@query("""SELECT conv_id, turn, CAST(5 + turn % 3 AS BIGINT) AS "offset", true AS whole FROM conversations WHERE strlen(text) >= 64""")
def raw_deflate_scan(spark, d):
    """Where a raw stream begins behind bytes that begin none, and whether it holds the whole text."""
    t = _talks(spark, d).where(F.octet_length("content") >= 64)
    front = F.unhex(F.repeat(F.lit("FF"), (5 + F.col("turn") % 3).cast("int")))
    packed = t.select("conv_id", "turn", F.octet_length("content").alias("n"), F.concat(front, codecs.encode_by(F.lit("deflate"), F.col("content"))).alias("c"))
    first = F.get(codecs.deflate_offsets(F.col("c")), 0)
    found = packed.select("conv_id", "turn", "n", first.alias("f"))
    return found.select("conv_id", "turn", "f.offset", (F.col("f.n") == F.col("n")).alias("whole"))


@query("""SELECT conv_id, turn, md5(text) AS digest, true AS found FROM conversations WHERE strlen(text) >= 64""")
def lzma_variants(spark, d):
    """LZMA whose header lacks the size (and behind nothing, the raw stream of it)."""
    t = _talks(spark, d).where(F.octet_length("content") >= 64)
    alone = t.select("conv_id", "turn", codecs.encode_by(F.lit("lzma"), F.col("content")).alias("c"))
    modem = F.concat(F.substring("c", 1, 5), F.substring("c", 14, BIG))
    raw = F.concat(F.lit(b"\xff\xff\xff"), F.substring("c", 14, BIG))
    rows = alone.select("conv_id", "turn", codecs.decode("lzma_modem", modem).alias("m"), codecs.lzma_offsets(raw).alias("f"))
    return rows.select("conv_id", "turn", F.md5("m.data").alias("digest"), F.exists("f", lambda x: x["offset"] == 3).alias("found"))


@query("""SELECT conv_id, turn, true AS gzip, true AS zlib, true AS lzma, false AS other FROM conversations WHERE strlen(text) > 0""")
def stream_validators(spark, d):
    """The first bytes of a stream tell whether it is one."""
    t = _talks(spark, d).where(F.octet_length("content") > 0)
    kinds = ("gzip", "zlib", "lzma")
    packed = t.select("conv_id", "turn", "content", *[codecs.encode_by(F.lit(k), F.col("content"), 200).alias(k) for k in kinds])
    return packed.select("conv_id", "turn", *[codecs.is_valid(k, F.col(k), None).alias(k) for k in kinds], codecs.is_valid("gzip", F.concat(F.lit(b"\x1f\x8b\x08"), F.col("content"))).alias("other"))


# --- images --------------------------------------------------------------------------------------------------------------

_NAMES = ", ".join(f"('{n}', {str(bool(f.tail) or any(s.over is not vendors._header and n not in ('fwimage', 'magic_crc') for s in f.sums)).lower()})" for n, f in vendors.FORMATS.items())


@query(f"""SELECT format, conv_id, turn, broken, CAST(strlen(text) AS INTEGER) AS n, CASE WHEN NOT broken THEN md5(text) END AS digest, NOT (covered AND broken) AS ok FROM conversations, (VALUES {_NAMES}) v(format, covered), (VALUES (true), (false)) w(broken) WHERE strlen(text) > 0""")
def vendor_round_trip(spark, d):
    """Every vendor format: seal, then read and verify the image as it is and with its last byte turned."""
    t = _talks(spark, d).where(F.octet_length("content") > 0).withColumnRenamed("content", "payload")
    sealed = [vendors.seal(t, name).select(F.lit(name).alias("format"), "conv_id", "turn", "content") for name in vendors.FORMATS]
    whole = written(reduce(DataFrame.unionByName, sealed), "format")  # each format reads its own images below
    last = F.octet_length("content")
    turned = F.concat(F.substring(F.col("content"), F.lit(1), last - 1), lens.pack(255 - lens.integer(F.col("content"), last - 1, 1), 1))
    both = whole.unionByName(whole.withColumn("content", turned).withColumn("broken", F.lit(True)), allowMissingColumns=True).withColumn("broken", F.coalesce("broken", F.lit(False)))
    read = [vendors.verify(both.where(F.col("format") == name), name) for name in vendors.FORMATS]
    rows = [r.select("format", "conv_id", "turn", "broken", F.octet_length("payload").alias("n"), F.when(~F.col("broken"), F.md5("payload")).alias("digest"), "ok") for r in read]
    return reduce(DataFrame.unionByName, rows)


_TALK_SUM = "CAST(coalesce(list_sum([CAST(('0x' || substr(hex(encode(text)), CAST(2 * i + 1 AS BIGINT), 2)) AS INTEGER) for i in range(strlen(text))]), 0) AS BIGINT)"


@query(f"""SELECT conv_id, turn, {_TALK_SUM} AS cameo, {_TALK_SUM} AS dap, CAST(strlen(text) + 512 AS BIGINT) AS tplink_length, md5(unhex('04000000' || rpad(hex(encode('dev')), 64, '0') || hex(encode(text)))) AS wrg,
sha1(unhex('00000002' || hex(encode(text)))) AS planex, md5(text) AS dir615h1, CAST(strlen(text) + 28 AS BIGINT) AS trx_length FROM conversations WHERE text IS NOT NULL""")
def vendor_header_fields(spark, d):
    """Decoded header fields against sums taken in SQL."""
    t = _t(spark, d, "conversations").where("text is not null").select("conv_id", "turn", F.encode("text", "UTF-8").alias("payload"))
    get = {
        "cameo": ("cameo", lambda f: f["checksum"]), "dap": ("dap", lambda f: f["checksum"]), "tplink_length": ("tplink", lambda f: f["fw_length"]), "wrg": ("wrg", lambda f: f["md5"]),
        "planex": ("planex", lambda f: f["sha1"]), "dir615h1": ("dir615h1", lambda f: f["md5"]), "trx_length": ("trx", lambda f: f["length"]),
    }
    given = {"wrg": {"offset": F.lit(4), "device": F.lit("dev")}}
    rows = t
    for column, (name, field) in get.items():
        rows = vendors.seal(rows.withColumn("kept", F.col("payload")), name, given.get(name)).withColumnRenamed("kept", "payload").withColumn(column, field(decode_struct(F.col("content"), name)))
    return rows.select("conv_id", "turn", *get)


@query(f"""SELECT conv_id, turn, md5(text) AS footer_data, CAST(1024 * ((strlen(text) + 12 + 1023) // 1024) AS INTEGER) AS footer_size,
CAST(255 - (({_TALK_SUM} + {sum(b'device:board' + bytes([10]) + b'version:V1' + bytes([10]) + b'region:x' + bytes([10]))}) % 256) AS INTEGER) AS label_byte, md5(text) AS chain FROM conversations WHERE text IS NOT NULL""")
def footers_and_labels(spark, d):
    """A footer behind padding, a text header with a sum behind the data, a chained coding with its CRC."""
    t = _t(spark, d, "conversations").where("text is not null").select("conv_id", "turn", F.encode("text", "UTF-8").alias("c"))
    rows = t.select("conv_id", "turn", vendors.footer(F.col("c"), 0x12345678).alias("f"), vendors.label_header(F.col("c"), "board", "1", "x").alias("l"), cs.xor_chain(F.col("c")).alias("x"))
    last = F.octet_length("l") - 1
    return rows.select(
        "conv_id", "turn", F.md5(vendors.read_footer(F.col("f"), 0x12345678)).alias("footer_data"), F.octet_length("f").alias("footer_size"), lens.integer(F.col("l"), last, 1).cast("int").alias("label_byte"),
        F.md5(cs.xor_chain(F.col("x"), undo=True)).alias("chain"),
    )


_KEY = b"0123456789abcdef"
_FIRST = 158  # the first byte of this key's stream, worked out by hand


@query(f"""SELECT conv_id, turn, CAST(strlen(text) AS INTEGER) AS n, coalesce(upper(lpad(to_hex(xor(TRY_CAST(('0x' || substr(hex(encode(text)), 1, 2)) AS INTEGER), {_FIRST})), 2, '0')), '') AS first_byte, md5(text) AS digest, CASE WHEN strlen(text) > 8 THEN true END AS other_key_fails FROM conversations WHERE text IS NOT NULL""")
def cipher_round_trip(spark, d):
    """Texts under a cipher whose stream depends on the key and on all bytes before, and plain again by the key only."""
    t = _t(spark, d, "conversations").where("text is not null").select("conv_id", "turn", F.encode("text", "UTF-8").alias("content"))
    coded = t.select("conv_id", "turn", cs.feedback_cipher(F.col("content"), _KEY).alias("c"))
    plain = F.md5(cs.feedback_cipher(F.col("c"), _KEY, undo=True))
    other = F.md5(cs.feedback_cipher(F.col("c"), _KEY[::-1], undo=True))
    return coded.select("conv_id", "turn", F.octet_length("c").alias("n"), F.hex(F.substring("c", 1, 1)).alias("first_byte"), plain.alias("digest"), F.when(F.octet_length("c") > 8, plain != other).alias("other_key_fails"))


@query(f"""SELECT conv_id, turn, md5(text) AS tagged, CAST(NULL AS VARCHAR) AS turned, upper(lpad(to_hex(s % 256), 2, '0') || lpad(to_hex(s // 256 % 256), 2, '0')) AS sum FROM (SELECT *, {_TALK_SUM} AS s FROM conversations WHERE text IS NOT NULL)""")
def checksum_tags(spark, d):
    """A tag with the POSIX checksum, read as it is and with the checksum's last byte turned; a sum at a place of its own, here behind the text."""
    t = _t(spark, d, "conversations").where("text is not null").select("conv_id", "turn", F.encode("text", "UTF-8").alias("c"))
    rows = t.select("conv_id", "turn", "c", vendors.cksum_tag(F.col("c"), 0x04030201).alias("g"))
    last = F.octet_length("g")
    turned = F.concat(F.substring(F.col("g"), F.lit(1), last - 1), lens.pack(255 - lens.integer(F.col("g"), last - 1, 1), 1))
    summed = vendors.fixed_sum(F.concat("c", F.lit(bytes(4))), F.octet_length("c"))
    return rows.select("conv_id", "turn", F.md5(vendors.read_cksum_tag(F.col("g"), 0x04030201)).alias("tagged"), F.md5(vendors.read_cksum_tag(turned, 0x04030201)).alias("turned"), F.hex(F.substring(summed, F.octet_length("c") + 1, F.lit(2))).alias("sum"))


@query("""SELECT p_partkey, CAST(p_partkey * 63 AS BIGINT) AS start, CAST(p_size * 100 AS BIGINT) AS length, 131 AS kind, upper(lpad(to_hex(p_partkey % 16), 2, '0')) || upper(lpad(to_hex(1 | (((p_partkey // 16) >> 2) & 192)), 2, '0')) || upper(lpad(to_hex((p_partkey // 16) & 255), 2, '0')) AS chs FROM part""")
def partition_table(spark, d):
    p = _t(spark, d, "part")
    entry = vendors.partition_entry(F.col("p_partkey") * 63, (F.col("p_size") * 100).cast("long"))
    rows = p.select("p_partkey", entry.alias("c")).select("p_partkey", "c", decode_struct(F.col("c"), "mbr_entry").alias("e"))
    return rows.select("p_partkey", "e.start", "e.length", F.col("e.type").cast("int").alias("kind"), F.upper("e.chs_start").alias("chs"))


@query("""SELECT o_orderkey, 1 AS "type", CAST(o_orderkey % 65536 AS BIGINT) AS address, upper(lpad(to_hex(o_custkey), 8, '0')) AS data, o_orderkey % 10 <> 3 AS ok FROM orders""")
def srecord_decode(spark, d):
    """Records with an address and four bytes; every tenth has a wrong checksum."""
    o = _t(spark, d, "orders")
    body = F.concat(F.lit("07"), F.lpad(F.hex(F.pmod("o_orderkey", F.lit(65536))), 4, "0"), F.lpad(F.hex("o_custkey"), 8, "0"))
    byte = lambda i: F.conv(F.substring(body, 2 * i + 1, 2), 16, 10).cast("int")
    total = sum((byte(i) for i in range(1, 7)), byte(0))
    check = F.pmod(255 - total + F.when(F.pmod("o_orderkey", F.lit(10)) == 3, 1).otherwise(0), F.lit(256))
    lines = o.select("o_orderkey", F.concat(F.lit("S1"), body, F.lpad(F.hex(check), 2, "0")).alias("line"))
    return vendors.srecords(lines).select("o_orderkey", "type", "address", F.hex("data").alias("data"), "ok")


def _trx(spark, d) -> DataFrame:
    """Conversations as images of two partitions."""
    t = _talks(spark, d).where(F.octet_length("content") > 0).select("conv_id", "turn", F.concat(F.col("content"), F.lit(b"second part")).alias("payload"), F.octet_length("content").alias("n"))
    return vendors.seal(t, "trx", {"offset0": F.lit(28), "offset1": F.col("n") + 28})


@query("""SELECT conv_id, turn, k AS ord, CASE k WHEN 0 THEN 28 ELSE CAST(strlen(text) + 28 AS BIGINT) END AS "offset", CASE k WHEN 0 THEN CAST(strlen(text) AS BIGINT) ELSE 11 END AS length FROM conversations, (VALUES (0), (1)) v(k) WHERE strlen(text) > 0""")
def trx_partitions(spark, d):
    parts = image.split_trx(_trx(spark, d).select(F.struct("conv_id", "turn").alias("image_id"), "content"))
    return parts.select("image_id.conv_id", "image_id.turn", "ord", "offset", "length")


@query("""SELECT conv_id, turn, true AS trx, true AS uimage, false AS broken, true AS mended, true AS dlob, CAST(NULL AS BOOLEAN) AS other FROM conversations WHERE strlen(text) > 0""")
def checksum_repair(spark, d):
    """TRX, uImage and DLOB headers: right, broken and repaired, and content that is none of them."""
    t = _talks(spark, d).where(F.octet_length("content") > 0)
    trx = _trx(spark, d).select("conv_id", "turn", F.col("content").alias("trx"))
    ui = vendors.seal(t.withColumnRenamed("content", "payload"), "uimage", {"name": F.lit("kernel")}).select("conv_id", "turn", F.col("content").alias("ui"))
    n = F.octet_length("content")
    dlob = F.concat(F.unhex(F.lit("5EA3A417")), lens.pack(F.lit(0), 4), lens.pack(F.lit(0), 4), F.unhex(F.lit("5EA3A417")), lens.pack(F.lit(0), 4), lens.pack(n, 4), F.lit(bytes(16)), F.col("content"))
    j = trx.join(ui, ["conv_id", "turn"]).join(t.select("conv_id", "turn", "content", dlob.alias("dlob")), ["conv_id", "turn"])
    broken = image.place(F.col("ui"), 70, F.lit(b"\xfe"), 1)
    j = j.select("conv_id", "turn", "content", "trx", "ui", "dlob", broken.alias("broken"))
    return j.select(
        "conv_id", "turn", image.verify(F.col("trx")).alias("trx"), image.verify(F.col("ui")).alias("uimage"), (image.verify(F.col("broken")) & (F.octet_length("broken") == F.octet_length("ui"))).alias("broken"),
        image.verify(image.repair(F.col("broken"))).alias("mended"), image.verify(image.repair(F.col("dlob"))).alias("dlob"), image.verify(F.concat(F.lit(b"none"), F.col("content"))).alias("other"),
    )


@query("""SELECT conv_id, turn, CAST(strlen(text) AS BIGINT) AS fs_offset, CAST(100 AS BIGINT) AS fs_size, md5(text) AS header, md5('tail') AS footer FROM conversations WHERE strlen(text) > 0 AND NOT contains(text, 'hsqs')""")
def header_footer_split(spark, d):
    """A file system behind the text, padding, and a footer behind a long run of one byte."""
    t = _talks(spark, d).where((F.octet_length("content") > 0) & ~F.contains(lens.lens(F.col("content")), F.lit("hsqs")))
    fs = F.concat(encode_struct("squashfs4", {"magic": F.lit("hsqs"), "major": F.lit(4), "bytes_used": F.lit(100)}), F.lit(b"x" * 4))
    images = t.select(F.struct("conv_id", "turn").alias("image_id"), F.concat(F.col("content"), fs, F.lit(b"\xff" * 40 + b"tail")).alias("content"))
    hits = scan.tested(images.withColumnRenamed("image_id", "file_id"), [r for r in rules.default_rules() if r.title.startswith("SquashFS")])
    out = image.header_and_footer(hits, images)
    return out.select("image_id.conv_id", "image_id.turn", "fs_offset", "fs_size", F.md5("header").alias("header"), F.md5("footer").alias("footer"))


@query("""SELECT c_custkey, ord, kind, CAST(start AS BIGINT) AS start, CAST(stop AS BIGINT) AS stop FROM customer, LATERAL (VALUES (0, 'gap', 0, 10 + c_custkey % 3), (1, 'filesystem', 10 + c_custkey % 3, 110 + c_custkey % 3), (2, 'gap', 110 + c_custkey % 3, 117 + c_custkey % 3), (3, 'filesystem', 117 + c_custkey % 3, 217 + c_custkey % 3)) v(ord, kind, start, stop)""")
def multi_filesystem_split(spark, d):
    c = spread(_t(spark, d, "customer").select("c_custkey"), "c_custkey")
    fs = F.concat(encode_struct("squashfs4", {"magic": F.lit("hsqs"), "major": F.lit(4), "bytes_used": F.lit(100)}), F.lit(b"x" * 4))
    blob = F.concat(F.unhex(F.repeat(F.lit("2E"), (10 + F.col("c_custkey") % 3).cast("int"))), fs, F.lit(b"-------"), fs)
    hits = scan.tested(c.select(F.col("c_custkey").alias("file_id"), blob.alias("content")), [r for r in rules.default_rules() if r.title.startswith("SquashFS")])
    return image.split_many(hits).select(F.col("file_id").alias("c_custkey"), "ord", "kind", "start", "stop")


@query("""SELECT a.page_id, sha256(unhex(hex(encode('head')) || hex(encode(coalesce(b.html, a.html))) || hex(encode('foot')))) AS digest FROM pages a LEFT JOIN pages b ON b.page_id = a.page_id + 1 WHERE a.html IS NOT NULL AND (b.page_id IS NULL OR b.html IS NOT NULL)""")
def transplant_filesystem(spark, d):
    """Each image with the file system of the next one, put together again."""
    p = _t(spark, d, "pages").where("html is not null").select("page_id", F.encode("html", "UTF-8").alias("fs"))
    part = lambda o, k, c: F.struct(F.lit(o).alias("ord"), F.lit(k).alias("kind"), c.alias("content"))
    parts = p.select(F.col("page_id").alias("image_id"), F.explode(F.array(part(0, "header", F.lit(b"head")), part(1, "filesystem", F.col("fs")), part(2, "footer", F.lit(b"foot")))).alias("p")).select("image_id", "p.*")
    donor = parts.withColumn("image_id", F.col("image_id") - 1)
    return image.join_parts(image.transplant(parts, donor)).select(F.col("image_id").alias("page_id"), F.sha2("content", 256).alias("digest"))


@query("""SELECT conv_id, turn, md5(unhex(substr(h, 1, 8) || substr(h, 209, 64) || substr(h, 73, 136) || substr(h, 9, 64) || substr(h, 273))) AS changed_places, strlen(text) AS n FROM (SELECT *, hex(encode(text)) AS h FROM conversations WHERE strlen(text) >= 140)""")
def block_descramble(spark, d):
    """The scrambled first block: written from the text by turning nibbles and pairs, it reads as two places changed."""
    t = _talks(spark, d).where(F.octet_length("content") >= 140)
    b = F.substring("content", 105, 32)
    pairs = F.unhex(F.regexp_replace(F.hex(b), "(..)(..)", "$2$1"))
    mixed = image.place(F.col("content"), 104, F.unhex(F.regexp_replace(F.hex(pairs), "(.)(.)", "$2$1")), 32)
    rows = t.select("conv_id", "turn", F.octet_length("content").cast("long").alias("n"), mixed.alias("m"))
    return rows.select("conv_id", "turn", F.md5(image.arcadyan(F.col("m"))).alias("changed_places"), "n")


# --- archives ---------------------------------------------------------------------------------------------------------------


def _entries(spark, d) -> DataFrame:
    t = _talks(spark, d)
    return t.select(F.col("conv_id").alias("archive_id"), F.col("turn").cast("int").alias("ord"), F.format_string("dir/t%04d.txt", F.col("turn")).alias("name"), "content")


_ENTRIES = "SELECT conv_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS INTEGER) AS ord, printf('dir/t%04d.txt', turn) AS name, CAST(coalesce(strlen(text), 0) AS BIGINT) AS size, md5(coalesce(text, '')) AS digest FROM conversations"


def _listed(df: DataFrame) -> DataFrame:
    return df.select(F.col("archive_id").alias("conv_id"), "ord", "name", F.col("size").cast("long").alias("size"), F.md5("content").alias("digest"))


@query(_ENTRIES)
def tar_walk(spark, d):
    return _listed(archives.read_tar(archives.build_tar(_entries(spark, d))))


@query(_ENTRIES)
def cpio_walk(spark, d):
    return _listed(archives.read_cpio(archives.build_cpio(_entries(spark, d))))


@query(_ENTRIES)
def wdk_walk(spark, d):
    return _listed(archives.read_wdk(archives.build_wdk(_entries(spark, d))))


@query(f"""SELECT conv_id, 'data' AS part, name, size, digest, CAST(NULL AS VARCHAR) AS package FROM ({_ENTRIES}) UNION ALL SELECT DISTINCT conv_id, 'control', './control', CAST(strlen('Package: pkg' || conv_id || chr(10) || 'Version: 1' || chr(10)) AS BIGINT), md5('Package: pkg' || conv_id || chr(10) || 'Version: 1' || chr(10)), 'pkg' || conv_id FROM conversations""")
def package_build_and_read(spark, d):
    data = _entries(spark, d)
    text = F.concat(F.lit("Package: pkg"), F.col("archive_id").cast("string"), F.lit("\nVersion: 1\n"))
    control = data.select("archive_id").distinct().select("archive_id", F.lit(0).alias("ord"), F.lit("./control").alias("name"), F.encode(text, "UTF-8").alias("content"))
    got = archives.read_package(written(archives.build_package(control, data)))  # read twice below
    fields = archives.control_fields(got).where("field = 'Package'").select(F.col("archive_id").alias("a"), F.col("value").alias("package"))
    j = got.join(fields, (F.col("archive_id") == F.col("a")) & (F.col("part") == "control"), "left")
    return j.select(F.col("archive_id").alias("conv_id"), "part", "name", F.col("size").cast("long").alias("size"), F.md5("content").alias("digest"), "package")


@query("""WITH n AS (SELECT conv_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS INTEGER) AS ord, printf('dir/t%04d.txt', turn) AS name, CAST(coalesce(strlen(text), 0) AS BIGINT) AS size FROM conversations)
SELECT conv_id, ord, name, CAST(coalesce(sum(size) OVER (PARTITION BY conv_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start, size, CAST(5 AS BIGINT) AS "key" FROM n""")
def web_index_walk(spark, d):
    """An index of (pointer to the name, size with a key added), the key inferred from the data's real size."""
    e = _entries(spark, d).select(F.col("archive_id").alias("image_id"), F.struct("ord", "name", (F.octet_length("content") + 5).alias("size")).alias("e"))
    e = e.groupBy("image_id").agg(F.array_sort(F.collect_list("e")).alias("es"), F.sum(F.col("e.size") - 5).alias("bytes"))
    n = F.size("es")
    index = F.aggregate(F.transform("es", lambda x, i: F.concat(lens.pack(F.lit(1000) + n * 8 + i * 14, 4, big=False), lens.pack(x["size"], 4, big=False))), F.lit(b""), lambda a, x: F.concat(a, x))
    names = F.aggregate(F.transform("es", lambda x: F.concat(F.encode(x["name"], "UTF-8"), F.lit(b"\0"))), F.lit(b""), lambda a, x: F.concat(a, x))
    images = e.select("image_id", "bytes", n.alias("n"), F.concat(index, names).alias("content"))
    raw = archives.web_index(images, F.lit(0), F.col("n"), F.lit(1000))
    key = archives.size_key(raw, images.select("image_id", "bytes"))
    clean = archives.web_index(images, F.lit(0), F.col("n"), F.lit(1000), key=5)
    return clean.join(key, "image_id").select(F.col("image_id").alias("conv_id"), "ord", "name", "start", "size", "key")


@query("SELECT CAST(sum(strlen(text)) AS BIGINT) AS size, count(*) * 10 AS packed_size, round(count(*) * 10 / sum(strlen(text)), 9) AS ratio FROM documents WHERE text IS NOT NULL")
def compression_totals(spark, d):
    e = _t(spark, d, "documents").where("text is not null").select(F.octet_length("text").cast("long").alias("size"), F.lit(10).cast("long").alias("packed_size"))
    return archives.totals(e).select("size", "packed_size", F.round("ratio", 9).alias("ratio"))


# --- file systems ---------------------------------------------------------------------------------------------------------------


def _trees(spark, d) -> DataFrame:
    return _entries(spark, d).select(F.col("archive_id").alias("image_id"), F.col("name").alias("path"), "content")


@query(f"""SELECT conv_id, name AS path, 'file' AS kind, size, digest, true AS crc_ok FROM ({_ENTRIES}) UNION ALL SELECT conv_id, 'dir', 'dir', 24 * count(*), NULL, true FROM conversations GROUP BY conv_id""")
def cramfs_walk(spark, d):
    """Trees written as CramFS images and read back; a directory's size is that of its records."""
    images = filesystems.build_cramfs(_trees(spark, d))
    checked = filesystems.check_cramfs(images).select(F.col("image_id").alias("i"), F.col("ok").alias("crc_ok"))
    j = filesystems.read_cramfs(images).join(checked, F.col("image_id") == F.col("i"))
    return j.select(F.col("image_id").alias("conv_id"), "path", "kind", "size", F.md5("content").alias("digest"), "crc_ok")


@query(f"""SELECT conv_id, name AS path, CASE WHEN size > 0 THEN CASE WHEN conv_id % 2 = 0 THEN 'zlib' ELSE 'lzma' END END AS codec, digest FROM ({_ENTRIES})""")
def filesystem_codec_chain(spark, d):
    """Images of two codecs, each read by the first codec of the chain that fits."""
    t = _trees(spark, d)
    images = filesystems.build_cramfs(t.where("image_id % 2 = 0")).unionByName(filesystems.build_cramfs(t.where("image_id % 2 <> 0"), "lzma"))
    found = filesystems.read_cramfs(images, ("lzma", "zlib")).where("kind = 'file'")
    return found.select(F.col("image_id").alias("conv_id"), "path", "codec", F.md5("content").alias("digest"))


@query(f"""SELECT conv_id, name AS path, 'file' AS kind, 420 AS mode, size, digest FROM ({_ENTRIES}) UNION ALL SELECT DISTINCT conv_id, 'dir', 'dir', 493, 0, NULL FROM conversations""")
def squashfs_walk(spark, d):
    """Trees written as SquashFS 4 images of three codecs, with small blocks and shared fragments, and read back."""
    t = _trees(spark, d)
    images = [filesystems.build_squashfs(t.where(F.col("image_id") % 3 == k), codec, 1024) for k, codec in enumerate(filesystems.SQUASH_CODECS.values())]
    return filesystems.read_squashfs(reduce(DataFrame.unionByName, images)).select(F.col("image_id").alias("conv_id"), "path", "kind", "mode", "size", F.md5("content").alias("digest"))


@query(f"""WITH e AS ({_ENTRIES}) SELECT conv_id, CAST(300 + ord AS BIGINT) AS obj_id, name AS path, 'file' AS kind, size, digest FROM e
UNION ALL SELECT DISTINCT conv_id, 257, 'dir', 'dir', 0, NULL FROM e UNION ALL SELECT conv_id, 258, 'alias', 'hard link', size, digest FROM e WHERE ord = 0""")
def yaffs_walk(spark, d):
    """Objects written as YAFFS2 pages and read back: a directory, its files, a hard link in the root, one deleted object, small pages."""
    e = _entries(spark, d).select(F.col("archive_id").alias("image_id"), F.struct("ord", F.element_at(F.split("name", "/"), -1).alias("name"), "content").alias("e"))
    w = Window.partitionBy("image_id").orderBy("e.ord")
    files = e.select("image_id", (F.row_number().over(w) + 299).cast("long").alias("obj_id"), F.lit(257).alias("parent_id"), F.lit("file").alias("kind"), "e.name", "e.content")
    one = e.select("image_id").distinct()
    made = lambda obj, parent, kind, name: one.select("image_id", F.lit(obj).cast("long").alias("obj_id"), F.lit(parent).alias("parent_id"), F.lit(kind).alias("kind"), F.lit(name).alias("name"))
    others = made(257, 1, "dir", "dir").unionByName(made(258, 1, "hard link", "alias").withColumn("equiv_id", F.lit(300)), allowMissingColumns=True).unionByName(made(259, 4, "file", "gone"), allowMissingColumns=True)
    images = filesystems.build_yaffs(files.unionByName(others, allowMissingColumns=True), page=512, spare=16)
    found = filesystems.read_yaffs(checkpoint(images), page=512, spare=16)
    return found.select(F.col("image_id").alias("conv_id"), "obj_id", "path", "kind", "size", F.md5("content").alias("digest"))


# --- ranges, statistics, checksums --------------------------------------------------------------------------------------------


@query("""SELECT doc_id, md5(unhex(substr(h, 21, 200))) AS middle, md5(unhex(CASE WHEN n > 30 THEN substr(h, 2 * (n - 30) + 1) ELSE h END)) AS last, md5(unhex(regexp_replace(substr(h, 1, 8 * (n // 4)), '(..)(..)(..)(..)', '\\4\\3\\2\\1', 'g') || CASE n % 4 WHEN 1 THEN right(h, 2) WHEN 2 THEN right(h, 2) || substr(right(h, 4), 1, 2) WHEN 3 THEN right(h, 2) || substr(right(h, 4), 1, 2) || substr(right(h, 6), 1, 2) ELSE '' END)) AS swapped
FROM (SELECT doc_id, hex(encode(text)) AS h, strlen(text) AS n FROM documents WHERE text IS NOT NULL)""")
def byte_ranges(spark, d):
    """A range from the front, one from the end, and the view with every four bytes turned."""
    b = text_blobs(_t(spark, d, "documents").where("text is not null"), "doc_id", "text")
    cut = lambda name, *a: limited(b, *a).select(F.col("file_id").alias("f"), F.md5("content").alias(name))
    j = b.select("file_id")
    for name, a in (("middle", (10, 100)), ("last", (-30,)), ("swapped", (0, None, 4))):
        j = j.join(cut(name, *a), F.col("file_id") == F.col("f")).drop("f")
    return j.withColumnRenamed("file_id", "doc_id")


@query("""SELECT doc_id, CAST(greatest(1024, (strlen(text) + 2097151) // 2097152 * 1024) AS BIGINT) AS block, CAST((strlen(text) + b - 1) // b AS BIGINT) AS blocks FROM (SELECT *, greatest(1024, (strlen(text) + 2097151) // 2097152 * 1024) AS b FROM documents WHERE strlen(text) > 0)""")
def auto_block_size(spark, d):
    blobs = text_blobs(_t(spark, d, "documents").where(F.octet_length("text") > 0), "doc_id", "text")
    counted = stats.block_stats(blobs).groupBy("file_id").agg(F.count(F.lit(1)).alias("blocks"))
    sizes = blobs.select(F.col("file_id").alias("doc_id"), stats.auto_block(F.octet_length("content")).alias("block"))
    return sizes.join(counted, F.col("doc_id") == F.col("file_id")).select("doc_id", "block", "blocks")


@query("""SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'encrypted' ELSE 'compressed' END AS verdict, CAST(CASE WHEN c_custkey % 2 = 0 THEN 0 ELSE 1 END AS INTEGER) AS n_odd FROM customer""")
def island_verdicts(spark, d):
    """Every byte once in each block: even everywhere, but for one piece of a single byte in every other file."""
    flat = bytes(range(256)) * 20
    odd = flat[:512] + b"\x55" * 32 + flat[512:]
    c = spread(_t(spark, d, "customer").select("c_custkey"), "c_custkey")
    blobs = c.select(F.col("c_custkey").alias("file_id"), F.when(F.col("c_custkey") % 2 == 0, F.lit(flat)).otherwise(F.lit(odd)).alias("content"))
    found = stats.islands(stats.block_stats(blobs, 1024), 0.9, 4096)
    return stats.verdicts(found, blobs, block=1024).select(F.col("file_id").alias("c_custkey"), "verdict", "n_odd")


@query("""SELECT doc_id, n, true AS bounded, true AS repeats_are_lower FROM (SELECT doc_id, CAST((strlen(text) + 1023) // 1024 AS BIGINT) AS n FROM documents WHERE strlen(text) > 0)""")
def zlib_ratio_entropy(spark, d):
    """The ratio of the deflated to the plain size of each block: from 0 to 1, and lower for the same block of one byte."""
    blobs = text_blobs(_t(spark, d, "documents").where(F.octet_length("text") > 0), "doc_id", "text")
    flat = blobs.select("file_id", F.unhex(F.repeat(F.lit("61"), F.octet_length("content"))).alias("content"))
    s = stats.block_stats(blobs, 1024, ratio=True).select("file_id", "block_id", "zlib_ratio")
    z = stats.block_stats(flat, 1024, ratio=True).select(F.col("file_id").alias("f"), F.col("block_id").alias("b"), F.col("zlib_ratio").alias("flat"))
    j = s.join(z, (F.col("file_id") == F.col("f")) & (F.col("block_id") == F.col("b")))
    return j.groupBy(F.col("file_id").alias("doc_id")).agg(F.count(F.lit(1)).alias("n"), F.min((F.col("zlib_ratio") > 0) & (F.col("zlib_ratio") <= 1)).alias("bounded"), F.min(F.col("flat") <= F.col("zlib_ratio")).alias("repeats_are_lower"))


def _table(poly: int, reflected: bool) -> list[int]:
    out = []
    for i in range(256):
        c = i if reflected else i << 24
        for _ in range(8):
            c = (c >> 1) ^ (poly if c & 1 else 0) if reflected else ((c << 1) ^ (poly if c >> 31 else 0)) & 0xFFFFFFFF
        out.append(c)
    return out


_LOW, _HIGH = (str(_table(p, r)) for p, r in ((0xEDB88320, True), (0x04C11DB7, False)))
_SHORT = str([c >> 16 for c in _table(0x10210000, False)])
_STEP = "list_reduce(list_prepend(CAST({start} AS BIGINT), bs), lambda c, x: {f})"
_REFLECTED = "xor(c >> 8, lo[xor(c & 255, x) + 1])"


@query(f"""WITH t AS (SELECT CAST({_LOW} AS BIGINT[]) AS lo, CAST({_HIGH} AS BIGINT[]) AS hi, CAST({_SHORT} AS BIGINT[]) AS sh),
b AS (SELECT conv_id, turn, text, strlen(text) AS n, [CAST(('0x' || substr(hex(encode(text)), CAST(2 * i + 1 AS BIGINT), 2)) AS BIGINT) for i in range(strlen(text))] AS bs, lo, hi, sh FROM conversations, t WHERE text IS NOT NULL)
SELECT conv_id, turn, xor({_STEP.format(start='4294967295', f=_REFLECTED)}, 4294967295) AS crc32, {_STEP.format(start='4294967295', f=_REFLECTED)} AS crc32_raw, {_STEP.format(start='0', f=_REFLECTED)} AS crc32_from_zero,
{_STEP.format(start='0', f='xor((c << 8) & 65535, sh[xor(c >> 8, x) + 1])')} AS crc16,
xor({_STEP.format(start='0', f='xor((c << 8) & 4294967295, hi[xor(c >> 24, x) + 1])').replace('bs)', "list_concat(bs, [CAST((n >> CAST(8 * k AS BIGINT)) & 255 AS BIGINT) for k in range(8) if (n >> CAST(8 * k AS BIGINT)) > 0]))")}, 4294967295) AS cksum,
{_STEP.format(start='0', f='xor(xor(c >> 8, lo[xor(c & 255, x) + 1]), CASE WHEN x > 127 THEN 16777215 ELSE 0 END)')} AS signed_crc,
sha1(unhex('{bytes(x ^ 0x5C for x in b"key".ljust(64, bytes(1))).hex()}' || sha1(unhex('{bytes(x ^ 0x36 for x in b"key".ljust(64, bytes(1))).hex()}' || hex(encode(text)))))) AS hmac,
md5(unhex(substr(hex(encode(text)), 1, 4) || '6B6579' || substr(hex(encode(text)), 11))) AS keyed FROM b""")
def crc_checksums(spark, d):
    """CRC variants, HMAC and keyed MD5 of the conversations' texts, folded byte by byte in SQL."""
    t = _t(spark, d, "conversations").where("text is not null").select("conv_id", "turn", F.encode("text", "UTF-8").alias("content"))
    c = F.col("content")
    return t.select(
        "conv_id", "turn", F.crc32(c).alias("crc32"), cs.crc32_raw(c).alias("crc32_raw"), cs.crc32_from_zero(c).alias("crc32_from_zero"), cs.crc16_ccitt(c).alias("crc16"), cs.posix_cksum(c).alias("cksum"),
        cs.signed_crc()(c).alias("signed_crc"), cs.hmac_sha1(c, b"key").alias("hmac"), cs.keyed_md5(c, 2, b"key").alias("keyed"),
    )


@query(f"""SELECT doc_id, CAST((65536 - sum(CASE WHEN i % 2 = 0 THEN b ELSE b * 256 END) % 65536) % 65536 AS BIGINT) AS complement, CAST(CASE WHEN sum(CASE WHEN i % 2 = 0 THEN b ELSE b * 256 END) = 0 THEN 0 ELSE (sum(CASE WHEN i % 2 = 0 THEN b ELSE b * 256 END) - 1) % 65535 + 1 END AS BIGINT) AS around,
CAST(CASE WHEN sum(CASE WHEN i % 2 = 1 THEN b ELSE b * 256 END) = 0 THEN 0 ELSE (sum(CASE WHEN i % 2 = 1 THEN b ELSE b * 256 END) - 1) % 65535 + 1 END AS BIGINT) AS big_around FROM ({_sql_bytes()}) GROUP BY doc_id""")
def sum16_variants(spark, d):
    b = _docs(spark, d).where(F.octet_length("content") > 0)
    c = F.col("content")
    return b.select(F.col("file_id").alias("doc_id"), cs.sum16_complement(c).alias("complement"), cs.sum16_end_around(c).alias("around"), cs.sum16_big_end_around(c).alias("big_around"))


@query("SELECT doc_id, regexp_full_match(text, '[\\x01-\\x7F]*') AS ascii, CAST(instr(text, 'the') AS INTEGER) AS place, regexp_replace(regexp_replace(coalesce(source, ''), '[^A-Za-z0-9._/-]', '_', 'g'), '(^|/)\\.\\.(/|$)', '\\1_\\2', 'g') AS path FROM documents WHERE text IS NOT NULL")
def text_checks(spark, d):
    """Whether a text is ASCII, where a word stands in it, and a source's name as a harmless path."""
    t = _t(spark, d, "documents").where("text is not null")
    return t.select("doc_id", lens.is_ascii(F.col("text")).alias("ascii"), F.instr("text", "the").alias("place"), lens.safe_path(F.coalesce("source", F.lit(""))).alias("path"))


@query("SELECT p_partkey, p_partkey % 3 = 0 AS sparse FROM part")
def sparse_blocks(spark, d):
    p = _t(spark, d, "part")
    content = F.concat(F.unhex(F.repeat(F.lit("00"), F.col("p_size"))), F.when(F.col("p_partkey") % 3 == 0, F.lit(b"")).otherwise(F.lit(b"\x01\0")))
    return p.select("p_partkey", cs.is_sparse(content).alias("sparse"))


# --- sets, orders, trees ---------------------------------------------------------------------------------------------------------


@query("SELECT p_partkey FROM part WHERE NOT (p_name LIKE '%a%' AND p_name NOT LIKE '%e%')")
def path_exclusion(spark, d):
    """A pattern that leaves paths out, and one that takes some of them back in."""
    return packages.exclude(_t(spark, d, "part").select("p_partkey", "p_name"), ["a", "!e"], key="p_name").select("p_partkey")


@query("SELECT page_id FROM pages WHERE regexp_matches(url, 'example|com') AND NOT regexp_matches(url, '/de/')")
def name_filter(spark, d):
    from octetlake.sources.blobs import name_filter as passes

    return _t(spark, d, "pages").where(passes(F.col("url"), "example|com", "/de/")).select("page_id")


@query("""SELECT k, path, "depth" FROM (WITH RECURSIVE r AS (SELECT CAST(1 AS BIGINT) AS k, CAST('1' AS VARCHAR) AS path, 0 AS "depth" UNION ALL SELECT CAST(p.p_partkey AS BIGINT), r.path || '/' || p.p_partkey, r."depth" + 1 FROM part p JOIN r ON p.p_partkey // 3 = r.k WHERE p.p_partkey > 2) SELECT * FROM r)""")
def object_tree_paths(spark, d):
    """Paths of a tree of objects that know their parents."""
    nodes = _t(spark, d, "part").select(F.col("p_partkey").cast("long").alias("k")).where("k = 1 or k > 2").select("k", F.when(F.col("k") == 1, F.lit(None)).otherwise(F.floor(F.col("k") / 3)).cast("long").alias("parent"), F.col("k").cast("string").alias("name"))
    return packages.tree_paths(nodes, "k", "parent", "name").select("k", "path", "depth")


@query("""SELECT l_orderkey, l_linenumber, c_name, n_name FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey""")
def table_lookups(spark, d):
    """Fact rows resolved through tables of tables, as inodes are through fragments and ids."""
    c = _t(spark, d, "customer").join(_t(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "c_name", "n_name")
    o = _t(spark, d, "orders").select("o_orderkey", "o_custkey").join(c, F.col("o_custkey") == F.col("c_custkey"))
    return _t(spark, d, "lineitem").select("l_orderkey", "l_linenumber").join(o, F.col("l_orderkey") == F.col("o_orderkey")).select("l_orderkey", "l_linenumber", "c_name", "n_name")


@query("""SELECT o_custkey, min(o_custkey) OVER (PARTITION BY s) AS first_key FROM (SELECT o_custkey, string_agg(DISTINCT o_orderpriority, '|' ORDER BY o_orderpriority) AS s FROM orders GROUP BY 1)""")
def attribute_set_dedup(spark, d):
    """Owners with the same set of attributes share the first one's: met by a short checksum, told apart by the whole set."""
    sets = _t(spark, d, "orders").groupBy("o_custkey").agg(F.array_join(F.array_sort(F.collect_set("o_orderpriority")), "|").alias("s"))
    return packages.same_sets(sets, "o_custkey", "s").select("o_custkey", "first_key")


@query("""SELECT o_orderkey, CAST(row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS BIGINT) AS place FROM (SELECT * FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 100)""")
def ordered_with_limit(spark, d):
    """Results by confidence with ties by key, the first hundred."""
    from pyspark.sql import Window

    top = _t(spark, d, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(100)
    return top.select("o_orderkey", F.row_number().over(Window.orderBy(F.desc("o_totalprice"), "o_orderkey")).cast("long").alias("place"))


# --- crafted records for the rules of each family -----------------------------------------------------------------------------------


@query(f"""SELECT * FROM (VALUES {', '.join(f"('{k}', {n})" for k, n in sorted((k, len(v)) for k, v in rules.by_family().items()))}) v(family, found)""")
def signature_families(spark, d):
    """For every rule of the table a record that it must find: its magic, and what its tests ask for. Counted by family."""
    return scan.families_found(spark)
