"""License scans by ordered signature rules; DataFrame functions only.

Documents without any trigger literal (most) are done after a byte search. The others are
normalised to words; a rule is tried only where its keyword occurs; its matches are intervals. The
intervals of a document are taken by priority (then the longer, then the earlier rule, then the first
place), and one that overlaps an interval taken before, or holds it or lies in it, is suppressed. So
an interval is suppressed only by one that stays. What stays are the detections. Everything is an
expression of the row: no join, no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from octetlake.llm.common import WORD, ascii_lower, n_words
from octetlake.llm.license_rules import CC_BY, RULES, TRIGGERS

#: Phrases of the base contract and their labels.
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
_PHRASES = "(?:" + "|".join(BASE) + ") "
_HIT = "struct<start:int,stop:int,priority:int,label:string,confidence:double,rule:int>"
#: Numbers that are added up together in running sums.
PIECE = 128


def _gate(text: Column) -> Column:
    def any_trigger(low: Column) -> Column:
        out = low.contains("cc") & low.rlike(CC_BY)
        for t in reversed(TRIGGERS):
            out = low.contains(t) | out
        return out

    return F.exists(F.array(F.lower(text)), any_trigger)  # the lambda over one element binds the lower-cased text


def _rules() -> Column:
    rows = (F.struct(F.lit(r.keyword).alias("keyword"), F.lit(r.regex).alias("regex"), F.lit(r.priority).alias("priority"), F.lit(r.label).alias("label"), F.lit(r.confidence).alias("confidence"), F.lit(k).alias("rule")) for k, r in enumerate(RULES))
    return F.array(*rows)


def _bind(value: Column, f) -> Column:
    """f(value), with value evaluated once."""
    return F.transform(F.array(value), f)[0]


def _starts(gaps: Column, found: Column) -> Column:
    """Where each match begins, from the gaps before the matches: running sums, piece by piece so that no long array is copied for each match."""
    steps = F.zip_with(F.slice(gaps, 1, F.size(found)), found, lambda g, f: F.struct(F.length(g).alias("gap"), F.length(f).alias("hit")))

    def within(at: Column, piece: Column) -> Column:
        start = F.struct(at.alias("at"), F.array().cast("array<int>").alias("all"))
        return F.aggregate(piece, start, lambda s, x: F.struct((s["at"] + x["gap"] + x["hit"]).alias("at"), F.concat(s["all"], F.array(s["at"] + x["gap"])).alias("all")))

    def fold(steps: Column) -> Column:
        pieces = F.transform(F.sequence(F.lit(0), F.floor((F.size(steps) - 1) / PIECE).cast("int")), lambda k: F.slice(steps, k * PIECE + 1, F.lit(PIECE)))
        start = F.struct(F.lit(0).alias("at"), F.array().cast("array<array<int>>").alias("all"))
        return F.aggregate(pieces, start, lambda s, p: _bind(within(s["at"], p), lambda r: F.struct(r["at"].alias("at"), F.concat(s["all"], F.array(r["all"])).alias("all"))))

    return F.flatten(_bind(steps, fold)["all"])


def _intervals(words: Column, rule: Column) -> Column:
    """The matches of a rule in the normalised text."""

    def interval(hit: Column, start: Column) -> Column:
        return F.struct(
            start.alias("start"), (start + F.length(hit)).alias("stop"), rule["priority"].alias("priority"), rule["label"].alias("label"), rule["confidence"].alias("confidence"), rule["rule"].alias("rule")
        )

    def of(found: Column) -> Column:
        hits = F.zip_with(found, _starts(F.split(words, rule["regex"], -1), found), interval)
        return F.when(F.size(found) > 0, hits).otherwise(F.array().cast(f"array<{_HIT}>"))

    return _bind(F.regexp_extract_all(words, rule["regex"], F.lit(0)), of)


def _resolve(hits: Column) -> Column:
    """Of overlapping intervals the strongest, in order of place; hits are sorted by start.

    Chains of intervals, each of which overlaps the ones before, are resolved on their own.
    """
    many = f"array<array<{_HIT}>>"
    start = F.struct(F.array().cast(many).alias("chains"), F.array().cast(f"array<{_HIT}>").alias("last"), F.lit(-1).alias("stop"))

    def step(s: Column, h: Column) -> Column:
        joined = F.struct(s["chains"].alias("chains"), F.concat(s["last"], F.array(h)).alias("last"), F.greatest(s["stop"], h["stop"]).alias("stop"))
        return F.when(h["start"] < s["stop"], joined).otherwise(F.struct(F.concat(s["chains"], F.array(s["last"])).alias("chains"), F.array(h).alias("last"), h["stop"].alias("stop")))

    chains = F.aggregate(hits, start, step, lambda s: F.concat(s["chains"], F.array(s["last"])))

    def strongest(chain: Column) -> Column:
        ranked = F.sort_array(F.transform(chain, lambda h: F.struct(h["priority"], h["stop"] - h["start"], -h["rule"], -h["start"], h.alias("h"))), asc=False)
        free = lambda kept, h: ~F.exists(kept, lambda k: (h["start"] < k["stop"]) & (k["start"] < h["stop"]))
        kept = F.aggregate(ranked, F.array().cast(f"array<{_HIT}>"), lambda kept, r: F.when(free(kept, r["h"]), F.concat(kept, F.array(r["h"]))).otherwise(kept))
        return F.when(F.size(chain) < 2, chain).otherwise(F.array_sort(kept))

    return F.flatten(F.transform(chains, strongest))


def _n_spaces(c: Column) -> Column:
    return F.length(c) - F.length(F.replace(c, F.lit(" "), F.lit("")))


def _scan(words: Column, count: Column) -> Column:
    """Of ' w w ... w ': base places and detections."""

    def base(pieces: Column) -> Column:
        at_start = F.element_at(pieces, 1).rlike("^" + _PHRASES)
        more = F.size(pieces) > 1
        return F.struct(
            (F.size(pieces) - 1 + at_start.cast("int")).cast("long").alias("n_base"),
            F.when(at_start, 0).when(more, _n_spaces(F.element_at(pieces, 1))).cast("long").alias("first_word"),
            F.when(more, count - _n_spaces(F.element_at(pieces, -1))).when(at_start, 0).cast("long").alias("last_word"),
        )

    # the lambda over one element binds the pieces, so that the text is split once
    places = F.transform(F.array(F.split(F.substring(words, 2, 1 << 30), f"(?<![^ ])(?={_PHRASES})", -1)), base)[0]
    labels = F.filter(F.array(*[F.when(words.contains(f" {p} "), F.lit(v)) for p, v in BASE.items()]), lambda x: x.isNotNull())
    tried = F.filter(_rules(), lambda r: words.contains(r["keyword"]))
    hits = F.array_sort(F.flatten(F.transform(tried, lambda r: _intervals(words, r))))
    return F.struct(places.alias("base"), F.array_sort(labels).alias("base_labels"), F.when(F.size(tried) > 0, _resolve(hits)).otherwise(F.array().cast(f"array<{_HIT}>")).alias("detections"))


def scan(docs: DataFrame, text_col: str = "text", out_col: str = "license") -> DataFrame:
    """docs with out_col (replaced if there): struct(n_words, base(n_base, first_word, last_word), base_labels, detections).

    detections are struct(start, stop, priority, label, confidence, rule), start and stop being places in the
    normalised text. A null or wordless text has no places and no detections; a whole text is
    scanned, however long.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    count = n_words(text)
    words = F.concat(F.lit(" "), F.array_join(F.regexp_extract_all(ascii_lower(text), F.lit(f"({WORD})"), F.lit(1)), " "), F.lit(" "))
    bound = _bind(F.struct(words.alias("w"), count.alias("n")), lambda x: _scan(x["w"], x["n"]))
    found = F.when(_gate(text), bound)
    nothing = F.struct(
        F.struct(F.lit(0).cast("long").alias("n_base"), F.lit(None).cast("long").alias("first_word"), F.lit(None).cast("long").alias("last_word")).alias("base"),
        F.array().cast("array<string>").alias("base_labels"),
        F.array().cast(f"array<{_HIT}>").alias("detections"),
    )
    return docs.withColumn(out_col, F.struct(count.alias("n_words"), F.coalesce(found, nothing).alias("s"))).withColumn(
        out_col, F.struct(F.col(f"{out_col}.n_words"), F.col(f"{out_col}.s.base"), F.col(f"{out_col}.s.base_labels"), F.col(f"{out_col}.s.detections"))
    )


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    score is the largest confidence of a detection, 0.9 at least where a base phrase stands, else 0.
    """
    s = F.col("license")
    rows = scan(docs.select("doc_id", "text")).select("doc_id", "license")
    labels = F.array_sort(F.array_distinct(F.concat(s["base_labels"], F.transform(s["detections"], lambda d: d["label"]))))
    best = F.coalesce(F.array_max(F.transform(s["detections"], lambda d: d["confidence"])), F.lit(0.0))
    return rows.select(
        "doc_id",
        s["n_words"].alias("n_words"),
        s["base"]["n_base"].alias("n_base"),
        s["base"]["first_word"].alias("first_word"),
        s["base"]["last_word"].alias("last_word"),
        F.array_join(s["base_labels"], ",").alias("base_labels"),
        F.array_join(labels, ",").alias("labels"),
        F.greatest(best, F.when(s["base"]["n_base"] > 0, 0.9).otherwise(0.0)).alias("score"),
    )
