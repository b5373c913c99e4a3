"""The signature scan: candidates, rule tests, winners, and the per-file order of hits.

An Arrow function finds all magics of all rules in one pass over a blob (Aho-Corasick); the compiled rules
test the array of candidates where the blob is; one window per file picks the most confident valid rule at
each offset. Nothing but narrow hit rows leaves the blob or is shuffled.
"""

from __future__ import annotations

import re
import zlib
from array import array

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from octetlake.functions import lens
from octetlake.functions.batches import stepwise
from octetlake.functions.checksums import crc32_from_zero, crc32_raw
from octetlake.operators.rules import Rule, by_family, compile_rule, default_rules, sample
from octetlake.plans.shared import checkpoint

#: Extraction rules that may be broadcast.
MAX_RULES = 10_000

_CANDIDATES = T.ArrayType(T.StructType([T.StructField("rule", T.IntegerType()), T.StructField("offset", T.LongType())]))


def select_rules(rules: list[Rule], include: list[str] | None = None, exclude: list[str] | None = None) -> list[Rule]:
    """Rules whose title passes: includes are a white list, an exclude beats them; patterns are lower-cased and searched."""
    title = lambda r: r.title.lower()
    hit = lambda ps, r: any(re.search(p.lower(), title(r)) for p in ps)
    return [r for r in rules if not (exclude and hit(exclude, r)) and (not include or hit(include, r))]


def raw_rule(needle: bytes) -> Rule:
    """A rule of one byte string without tests."""
    from octetlake.operators.rules import Line

    text = "Raw signature (" + "".join(chr(b) if 32 < b < 127 else f"0x{b:02X}" for b in needle) + ")"
    return Rule(text, needle.decode("latin-1"), 0, len(needle), [Line(0, "0", "string", True, True, None, 0, "=", None, text, {})])


def _finder(rules: list[Rule]):
    """All places of each rule's magic, without overlap within a rule (unless it is tagged overlap)."""
    magics: dict[str, list[int]] = {}
    for k, r in enumerate(rules):
        if not r.is_regex:
            magics.setdefault(r.magic, []).append(k)
    regexes = [(k, re.compile(r.magic.encode("latin-1"), re.S)) for k, r in enumerate(rules) if r.is_regex]
    shifts, free = [r.shift for r in rules], ["overlap" in r.tags for r in rules]
    built: list = []

    @stepwise(_CANDIDATES)
    def find(content: pa.Array) -> pa.Array:
        if not built:
            a = ahocorasick.Automaton()
            for m, ks in magics.items():
                a.add_word(m, (len(m), ks))
            if magics:
                a.make_automaton()
            built.append(a)
        rule, offset, sizes = array("i"), array("q"), [0]  # numbers, not objects: a blob may have very many hits
        for x in content:
            v = x.as_py()
            ends: dict[int, int] = {}
            if v and magics:
                for end, (n, ks) in built[0].iter(v.decode("latin-1")):
                    at = end - n + 1
                    for k in ks:
                        if free[k] or at >= ends.get(k, 0):
                            ends[k] = end + 1
                            if 0 <= at - shifts[k] < len(v):
                                rule.append(k)
                                offset.append(at - shifts[k])
            for k, rx in regexes if v else ():
                for m in rx.finditer(v):
                    if m.start() >= shifts[k]:
                        rule.append(k)
                        offset.append(m.start() - shifts[k])
            sizes.append(len(rule))
        hits = pa.StructArray.from_arrays([pa.array(np.array(rule, np.int32)), pa.array(np.array(offset, np.int64))], ["rule", "offset"])
        return pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), hits)

    return find


def candidates(blobs: DataFrame, rules: list[Rule]) -> DataFrame:
    """(file_id, rule, offset): each place where a rule's magic stands."""
    found = blobs.select("file_id", _finder(rules)(F.col("content")).alias("found"))
    return found.select("file_id", F.explode("found").alias("c")).select("file_id", "c.rule", "c.offset")


def tested(blobs: DataFrame, rules: list[Rule], keep_invalid: bool = False, checks: dict | None = None) -> DataFrame:
    """Candidates with what their rules say: title, confidence, description, valid, size, jump, adjust, name, many, once.

    checks are more conditions (content, offset) -> bool for the rules whose title begins with their key. Tests run over the array of a blob's candidates, beside the blob, and only their results are made
    rows; the blob is never copied for a candidate.
    """
    if not rules:
        return tested(blobs, [raw_rule(b"\0")], keep_invalid).limit(0)
    pick = lambda values, c: F.get(F.array(*[F.lit(v) for v in values]), c["rule"])
    plain = [len(r.lines) == 1 and not r.tags.keys() & {"size", "jump", "adjust", "invalid", "name"} and "%" not in r.lines[0].text for r in rules]
    none, n = F.lit(None), F.lit(None).cast("long")

    def test(c: Column) -> Column:
        usual = F.struct(pick([r.lines[0].text for r in rules], c).alias("description"), F.lit(True).alias("valid"), n.alias("size"), n.alias("jump"), n.alias("adjust"), none.cast("string").alias("name"))
        result = F.when(c["rule"] < 0, usual)  # one flat case; the plain rules fall through
        for k, r in enumerate(rules):
            if not plain[k]:
                result = result.when(c["rule"] == k, compile_rule(r, F.col("content"), c["offset"]))
        result, good = result.otherwise(usual), F.when(c["rule"] < 0, F.lit(True))
        for title, check in (CHECKS if checks is None else checks).items():
            mine = [k for k, r in enumerate(rules) if r.title.startswith(title)]
            good = good.when(c["rule"].isin(mine), check(F.col("content"), c["offset"])) if mine else good
        good = good.otherwise(F.lit(True))
        return F.struct(c["rule"].alias("rule"), c["offset"].alias("at"), result.alias("r"), good.alias("good"))

    found = F.col("found") if "found" in blobs.columns else _finder(rules)(F.col("content"))  # given, or searched for
    rows = blobs.select("file_id", "content", found.alias("found"))
    rows = rows.select("file_id", F.octet_length("content").alias("n"), F.transform("found", test).alias("found"))
    rows = rows.select("file_id", "n", F.explode("found").alias("c")).select("file_id", "n", "c.*")
    at = F.col("at")
    bounds = (at + F.coalesce("r.size", F.lit(0)) <= F.col("n")) & (at + F.coalesce("r.jump", F.lit(0)) <= F.col("n"))
    of = lambda values: pick(values, {"rule": F.col("rule")})
    rows = rows.select(
        "file_id", (at + F.coalesce("r.adjust", F.lit(0))).alias("offset"), "rule", of([r.title for r in rules]).alias("title"), of([r.confidence for r in rules]).alias("confidence"),
        "r.description", (F.col("r.valid") & F.col("good") & bounds).alias("valid"), "r.size", "r.jump", "r.name", of(["many" in r.tags for r in rules]).alias("many"), of(["once" in r.tags for r in rules]).alias("once"),
    )
    return rows if keep_invalid else rows.where("valid")


def winners(hits: DataFrame) -> DataFrame:
    """Of the valid hits at one offset of a file the most confident, then the first rule."""
    w = Window.partitionBy("file_id", "offset").orderBy(F.desc("confidence"), "rule")
    return hits.withColumn("rank", F.row_number().over(w)).where("rank = 1").drop("rank")


def once(hits: DataFrame) -> DataFrame:
    """Hits of rules tagged once: only the first by file and offset for each title."""
    first = hits.where("once").groupBy("title").agg(F.min(F.struct("file_id", "offset")).alias("first"))
    first = first.select(F.col("title").alias("t"), "first")
    joined = hits.join(first, F.col("title") == F.col("t"), "left")
    return joined.where(~F.col("once") | (F.struct("file_id", "offset") == F.col("first"))).drop("t", "first")


def suppress_runs(hits: DataFrame) -> DataFrame:
    """Hits with `display`: a hit of a rule tagged many is hidden if the hit before it in the file is of the same rule."""
    w = Window.partitionBy("file_id").orderBy("offset", "rule")
    return hits.withColumn("display", ~(F.col("many") & F.coalesce(F.lag("rule").over(w) == F.col("rule"), F.lit(False))))


def follow_jumps(hits: DataFrame) -> DataFrame:
    """Hits that are not inside a region that an earlier kept hit of the file jumps over.

    Only files with a jump are folded, in offset order, over (offset, jump) pairs; the pairs of one file are
    bounded by its hits.
    """
    jumping = hits.where("jump > 0").select("file_id").distinct().withColumnRenamed("file_id", "j")
    plain = hits.join(jumping, F.col("file_id") == F.col("j"), "left_anti")
    some = hits.join(jumping, F.col("file_id") == F.col("j"), "left_semi")
    regions = some.where("jump > 0").groupBy("file_id").agg(F.array_sort(F.collect_list(F.struct("offset", "jump"))).alias("all"))
    kept = F.aggregate(
        "all",
        F.array().cast("array<struct<start:bigint,stop:bigint>>"),
        lambda acc, x: F.when((F.size(acc) > 0) & (x["offset"] < F.element_at(acc, -1)["stop"]), acc).otherwise(
            F.concat(acc, F.array(F.struct(x["offset"].alias("start"), (x["offset"] + x["jump"]).alias("stop"))))
        ),
    )
    regions = regions.select(F.col("file_id").alias("g"), kept.alias("kept"))
    inside = some.join(regions, F.col("file_id") == F.col("g")).where(~F.exists("kept", lambda r: (F.col("offset") > r["start"]) & (F.col("offset") < r["stop"])))
    return plain.unionByName(inside.drop("g", "kept"))


def group_entries(hits: DataFrame, first: str, last: str) -> DataFrame:
    """Hits with `extract`: of the entries of an archive (titles with `first`) only the one after an end record (`last`) is extracted."""
    w = Window.partitionBy("file_id").orderBy("offset")
    ends = F.sum(F.contains("title", F.lit(last)).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1))
    entry = F.contains("title", F.lit(first))
    ranked = hits.withColumn("part", F.coalesce(ends, F.lit(0))).withColumn("entry", entry)
    rank = F.row_number().over(Window.partitionBy("file_id", "part", "entry").orderBy("offset"))
    return ranked.withColumn("extract", ~F.col("entry") | (rank == 1)).drop("part", "entry")


def scan(blobs: DataFrame, rules: list[Rule] | None = None, include: list[str] | None = None, exclude: list[str] | None = None, dumb: bool = False, plugins: tuple = (), present_first: bool = False) -> DataFrame:
    """The signature scan of (file_id, content): offset, title, description, size, jump, name, display of each hit.

    A hit must fit one of the include patterns, and none of the exclude patterns, by its rule's title and
    by its own description. Plugins are functions (hits, blobs) -> hits that run in order after validation
    and before winners are chosen. With dumb, jumps are not followed. With present_first, a pass that looks for
    magics alone finds out which rules need their tests compiled: the same hits, planned faster for a large table of
    rules, but the blobs are read twice. A null or empty blob has no hit.
    """
    rules = select_rules(rules if rules is not None else default_rules(), include, exclude)
    if present_first:
        seen = {r["rule"] for r in candidates(blobs, rules).select("rule").distinct().collect()}  # at most one row a rule
        rules = [r for k, r in enumerate(rules) if k in seen]
    hits = tested(blobs, rules)
    said = lambda patterns: any_of(*[F.lower("description").rlike(p.lower()) for p in patterns])
    hits = hits.where(said(include)) if include else hits
    hits = hits.where(~said(exclude)) if exclude else hits
    for plugin in plugins:
        hits = plugin(hits, blobs)
    hits = checkpoint(winners(hits))  # narrow rows; what follows reads them several times
    tags = {t for r in rules for line in r.lines for t in line.tags}
    # a step for which no rule has a tag would change nothing; plugins may add what no rule says
    if plugins or "once" in tags:
        hits = once(hits)
    if not dumb and (plugins or "jump" in tags):
        hits = follow_jumps(hits)
    return suppress_runs(hits) if plugins or "many" in tags else hits.withColumn("display", F.lit(True))


def prefix_match(blobs: DataFrame, rules: list[Rule] | None = None) -> DataFrame:
    """The most confident valid hit at the very beginning of each blob; only the first bytes are searched for magics."""
    rules = rules if rules is not None else default_rules()
    far = max((r.shift + len(r.magic) for r in rules), default=1)
    first = F.filter(_finder(rules)(F.substring("content", 1, far)), lambda c: c["offset"] == 0)
    return winners(tested(blobs.select("file_id", "content", first.alias("found")), rules)).where("offset = 0")


def stride(hits: DataFrame, title: str) -> DataFrame:
    """Hits of one title that stand at whole multiples of the distance between the first two of their file, only the first
    of them displayed (for erase blocks that each begin with a header); other hits stay as they are."""
    w = Window.partitionBy("file_id").orderBy("offset")
    mine = hits.where(F.contains("title", F.lit(title)))
    two = mine.withColumn("k", F.row_number().over(w)).where("k <= 2").groupBy("file_id").agg(F.min("offset").alias("first"), (F.max("offset") - F.min("offset")).alias("step"))
    two = two.select(F.col("file_id").alias("f"), "first", "step")
    shown = "display" if "display" in hits.columns else None
    j = mine.join(two, F.col("file_id") == F.col("f")).where("step = 0 or (offset - first) % step = 0")
    j = j.withColumn("display", (F.col("offset") == F.col("first")) & (F.col(shown) if shown else F.lit(True))).drop("f", "first", "step")
    rest = hits.where(~F.contains("title", F.lit(title)))
    return j.unionByName(rest if shown else rest.withColumn("display", F.lit(True)))


def jffs2_node_ok(content: Column, at: Column) -> Column:
    """The header CRC of a node at an offset, in either byte order: CRC-32 of its first 8 bytes from start 0."""
    crc = crc32_from_zero(F.substring(content, (at + 1).cast("int"), F.lit(8)))
    there = at + 12 <= F.octet_length(content)
    return there & ((crc == lens.integer(content, (at + 8).cast("int"), 4, big=True)) | (crc == lens.integer(content, (at + 8).cast("int"), 4, big=False)))


def ubi_header_ok(content: Column, at: Column) -> Column:
    """The CRC of an erase counter header at an offset: CRC-32 without final inversion of 60 bytes, big-endian behind them."""
    crc = crc32_raw(F.substring(content, (at + 1).cast("int"), F.lit(60)))
    return (at + 64 <= F.octet_length(content)) & (crc == lens.integer(content, (at + 60).cast("int"), 4))


#: Checks of the content at a hit, by the beginning of the rule's title.
CHECKS = {"JFFS2 filesystem": jffs2_node_ok, "UBI erase count header": ubi_header_ok}


def to_log(hits: DataFrame, path: str) -> None:
    """The scan log as CSV files with a header line."""
    log_table(hits).write.option("header", "true").mode("overwrite").csv(path)


def read_log(lines: DataFrame, line: str = "line") -> DataFrame:
    """lines of a printed scan log with offset (decimal), description and kind (the description's first words up to a comma,
    lower-cased); lines that do not begin with a decimal and a hexadecimal offset of the same value are left out."""
    pattern = r"^\s*(\d{1,18})\s+0x([0-9A-Fa-f]{1,15})\s+(.*?)\s*$"
    offset, digits, said = (F.regexp_extract(line, pattern, k) for k in (1, 2, 3))
    rows = lines.select(*lines.columns, offset.try_cast("long").alias("offset"), F.conv(digits, 16, 10).try_cast("long").alias("same"), said.alias("description"))
    return rows.where("offset = same").select(*lines.columns, "offset", "description", F.lower(F.regexp_extract("description", "^[^,]*", 0)).alias("kind"))


def families_found(spark, rules_by_family: dict[str, list[Rule]] | None = None) -> DataFrame:
    """(family, found): how many rules of each family find the record that is made for them, at its beginning."""
    families = rules_by_family or by_family()
    rules = [(family, r) for family in families for r in families[family]]
    rows = []
    for k, (family, r) in enumerate(rules):
        data = bytearray(sample(r))
        if r.title.startswith("UBI erase"):
            data[60:64] = (zlib.crc32(bytes(data[:60])) ^ 0xFFFFFFFF).to_bytes(4, "big")
        if r.title.startswith("JFFS2"):
            data[8:12] = (zlib.crc32(bytes(data[:8]), 0xFFFFFFFF) ^ 0xFFFFFFFF).to_bytes(4, "big")
        rows.append((family, k, bytes(data)))
    records = spark.createDataFrame(rows, "family string, k int, content binary")
    hits = tested(records.select(F.struct("family", "k").alias("file_id"), "content"), [r for _, r in rules])
    hits = hits.where("offset = 0 and rule = file_id.k").select("file_id.family", "rule").distinct()
    return hits.groupBy("family").agg(F.count(F.lit(1)).cast("int").alias("found"))


def literal_hits(blobs: DataFrame, literal: str) -> DataFrame:
    """(file_id, offset) of one literal, without Python: for a single rule the split of the lens is enough."""
    return blobs.select("file_id", F.explode(lens.literal_offsets(lens.lens(F.col("content")), literal)).alias("offset"))


def log_table(hits: DataFrame) -> DataFrame:
    """The three columns of a scan log: decimal, hexadecimal, description with runs of four blanks or more squeezed."""
    return hits.select("file_id", F.col("offset").alias("decimal"), F.concat(F.lit("0x"), F.hex("offset")).alias("hexadecimal"), F.regexp_replace("description", " {4,}", " ").alias("description"))


def rule_matches(hits: DataFrame, rules: DataFrame) -> DataFrame:
    """hits joined with every extraction rule whose expression is found in the lower-cased description.

    rules (priority, regex, ...) is a dimension table from a parameter file; its rows are the rules, so the
    join is hits times rules and is evaluated by broadcasting them. More than MAX_RULES are refused.
    """
    if rules.limit(MAX_RULES + 1).count() > MAX_RULES:
        raise ValueError(f"more than {MAX_RULES} extraction rules")
    return hits.join(F.broadcast(rules), F.expr("lower(description) rlike regex"))


def any_of(*conditions: Column) -> Column:
    out = F.lit(False)
    for c in conditions:
        out = out | c
    return out
