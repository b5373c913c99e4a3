"""Mixing sources to target weights by pivotal dependent rounding; DataFrame functions only.

A source's documents are all wanted `rate` = target / size times. The whole part is certain; the
fraction p is rounded dependently: two documents with fractions p, q and sizes s, t trade word mass
- one gains e / s, the other loses e / t, at random and without bias - until one of them is 0 or 1.
The sum of s * p never changes, so what a source takes differs from its target by less than the
one document that is left last.

Trades form a reduction tree. The documents of a source and size class (powers of two) are dealt by
a hash into groups of about GROUP; each group is folded by trades to one fractional residual, and
residuals are dealt and folded again until a class has GROUP of them. The root of a source then
folds what its classes left, the largest documents first, and rounds what is left of the last, a
small one, at random. Huge documents (over 1 / 128 of their source) trade among themselves first;
the one that is left is settled against all others at once, whose common fraction makes up for it.
A level divides the rows by about GROUP, so even a source with a third of all rows never meets in
one task, and each level is one shuffle of narrow rows. All random numbers are hashes of ids, so
reruns agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from octetlake.llm.common import TOKEN, checkpoint, row_hash, spare

GROUP = 64
#: Sources up to this many are broadcast (their rates are then under 1 MB); more are joined by shuffle.
BROADCAST_SOURCES = 10_000
#: Copies of one row that are written together.
PART = 1_000


def text_size(text: Column) -> Column:
    """Number of runs of characters that are no ASCII white space; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(TOKEN)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, cap: float = 3.0) -> DataFrame:
    """(source, source_size, target) for (source, size) rows.

    Sources weigh 1, 2, 3, 1, ... in code-point order, a null source last, and share the sum of all
    sizes; a target above cap times its source's size is cut to that, and what is cut off goes to
    the others by weight, until none is above. Every step works on one row per source.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))
    per = per.withColumn("w", (F.row_number().over(order) - 1) % 3 + 1)
    # In order of cap * size / weight the cut sources are a prefix: a source is cut if it is below the
    # level that all sources from it on would share.
    ratio = F.col("source_size") / F.col("w")
    before = Window.orderBy(ratio, F.col("source").isNull(), F.col("source").cast("binary")).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    total, weight = F.sum("source_size").over(whole), F.sum("w").over(whole)
    level = (total - cap * F.coalesce(F.sum("source_size").over(before), F.lit(0))) / (weight - F.coalesce(F.sum("w").over(before), F.lit(0)))
    per = per.withColumn("level", level).withColumn("full", cap * ratio <= F.col("level"))
    free = F.min(F.when(~F.col("full"), F.struct(ratio, F.col("source").isNull(), F.col("source").cast("binary"), F.col("level").alias("level")))).over(whole)
    share = F.when(F.col("full"), cap * F.col("source_size")).otherwise(F.col("w") * free["level"])
    return per.select("source", "source_size", F.coalesce(share, F.lit(0.0)).cast("double").alias("target"))


def _chance(*parts) -> Column:
    """A number in [0, 1) that is a hash of the parts."""
    return F.shiftrightunsigned(F.xxhash64(*parts), 11) / F.lit(float(1 << 53))


def _trade(a: Column, b: Column, seed: int) -> Column:
    """Trade between two fractional documents: struct(done, bit, left). done is integral with that bit; left may be fractional."""
    up = F.least(a["size"] * (1 - a["p"]), b["size"] * b["p"])  # the mass that a can gain
    down = F.least(a["size"] * a["p"], b["size"] * (1 - b["p"]))  # and lose
    gains = _chance(F.lit(seed), a["id"], a["k"], b["id"], b["k"]) * (up + down) < down
    a_end, b_end = a["size"] * (1 - a["p"]) <= b["size"] * b["p"], a["size"] * a["p"] <= b["size"] * (1 - b["p"])

    def entry(x: Column, p: Column) -> Column:
        return F.struct(x["id"].alias("id"), x["k"].alias("k"), x["size"].alias("size"), F.least(F.greatest(p, F.lit(0.0)), F.lit(1.0)).alias("p"))

    def outcome(done: Column, bit: int, left: Column, p: Column) -> Column:
        return F.struct(done["id"].alias("id"), done["k"].alias("k"), done["size"].alias("size"), F.lit(bit).alias("bit"), entry(left, p).alias("left"))

    return (
        F.when(gains & a_end, outcome(a, 1, b, b["p"] - up / b["size"]))
        .when(gains, outcome(b, 0, a, a["p"] + up / a["size"]))
        .when(b_end, outcome(a, 0, b, b["p"] + down / b["size"]))
        .otherwise(outcome(b, 1, a, a["p"] - down / a["size"]))
    )


_STATE = "struct<done:array<struct<id:{id},k:bigint,size:bigint,bit:int>>,left:struct<id:{id},k:bigint,size:bigint,p:double>>"


def _fold(items: Column, seed: int, id_type: str) -> Column:
    """Fold a group's documents by trades, the largest first, so that a small one is left: struct(done, left)."""
    first = F.element_at(items, 1)
    start = F.struct(F.array().alias("done"), F.struct(*(first[c].alias(c) for c in ("id", "k", "size", "p"))).alias("left")).cast(_STATE.format(id=id_type))

    def step(state: Column, x: Column) -> Column:
        t = _trade(state["left"], x, seed)
        return F.transform(
            F.array(t), lambda r: F.struct(F.concat(state["done"], F.array(F.struct(r["id"], r["k"], r["size"], r["bit"]))).alias("done"), r["left"].alias("left")).cast(_STATE.format(id=id_type))
        )[0]

    return F.aggregate(F.slice(items, 2, F.greatest(F.size(items) - 1, F.lit(0))), start, step)


def plan_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", cap: float = 3.0, seed: int = 4) -> DataFrame:
    """One row per row of docs: (doc_id, source, size, source_size, target, copies, taken).

    A row is taken `copies` times, between 0 and cap rounded up, so `taken` = copies * size. Rows that
    agree in id, source and size are interchangeable and counted once with their number. Null ids,
    null sources and null or empty texts (size 0, never taken) are rows like any other.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), text_size(F.col(text_col)).alias("size"))
    id_type = dict(rows.dtypes)["id"]
    rows = checkpoint(rows.groupBy("id", "source", "size").count())
    per = checkpoint(source_targets(rows.select("source", (F.col("size") * F.col("count")).alias("size")), cap))
    per = per.withColumn("rate", F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(cap))).otherwise(0.0))
    per = per.withColumn("whole", F.floor("rate")).withColumn("p", F.col("rate") - F.col("whole")).withColumnRenamed("source", "s2")
    few = per.count()
    side = F.broadcast(per) if few <= BROADCAST_SOURCES else per
    kind = F.when(F.col("size") > 0, F.floor(F.log2("size")).cast("int")).otherwise(-1)
    classes = rows.groupBy(F.col("source").alias("s3"), kind.alias("c3")).agg(F.sum("count").alias("n"))
    most = classes.where("c3 >= 0").agg(F.max("n")).first()[0] or 0
    classes = F.broadcast(classes) if few <= BROADCAST_SOURCES else classes  # under 64 classes a source
    each = rows.withColumn("k", F.explode(F.sequence(F.lit(1).cast("long"), F.col("count")))).drop("count").withColumn("class", kind)
    each = each.join(side, each["source"].eqNullSafe(side["s2"])).join(classes, each["source"].eqNullSafe(classes["s3"]) & (F.col("class") == F.col("c3")))
    fraction = (F.col("size") > 0) & (F.col("p") > 0)
    out = each.where(~fraction).select("source", "id", "k", "size", F.lit(0).alias("bit"))
    huge = F.col("size") * GROUP * 2 > F.col("source_size")  # fewer than 2 * GROUP of a source
    level = 0

    def folded(groups: DataFrame, *keys: str) -> DataFrame:
        items = groups.groupBy("source", *keys).agg(F.sort_array(F.collect_list(F.struct("x.size", "x.id", "x.k", "x.p")), asc=False).alias("items"))
        return checkpoint(items.select("source", *keys, _fold(F.col("items"), seed + level, id_type).alias("f")))

    def settled(f: DataFrame) -> DataFrame:
        return f.select("source", F.explode("f.done").alias("d")).select("source", "d.*")

    # huge documents trade among themselves; what is left of them is settled against all the others at once
    f = folded(each.where(fraction & huge).select("source", F.struct("id", "k", "size", "p").alias("x")))
    out = out.unionByName(settled(f))
    pool = each.where(fraction & ~huge).groupBy(F.col("source").alias("s4")).agg(F.sum("size").alias("pool"), F.first("p").alias("q"))
    x = F.col("f.left")
    up, down = F.col("q") - x["size"] * (1 - x["p"]) / F.col("pool"), F.col("q") + x["size"] * x["p"] / F.col("pool")  # the others' fraction if it is taken, or not
    taken = F.when((up >= 0) & ~(down <= 1), True).when(~(up >= 0) & (down <= 1), False).otherwise(_chance(F.lit(seed), F.lit(-2), x["id"], x["k"]) < x["p"])
    shift = f.join(pool, F.col("source").eqNullSafe(F.col("s4")), "left").withColumn("taken", taken)
    shift = checkpoint(shift.select("source", "f", "taken", F.least(F.greatest(F.when(F.col("taken"), up).otherwise(down), F.lit(0.0)), F.lit(1.0)).alias("q")))
    out = out.unionByName(shift.select("source", "f.left.id", "f.left.k", "f.left.size", F.col("taken").cast("int").alias("bit")))
    moved = shift.select(F.col("source").alias("s4"), "q")
    moved = F.broadcast(moved) if few <= BROADCAST_SOURCES else moved
    left = each.where(fraction & ~huge).join(moved, F.col("source").eqNullSafe(F.col("s4")), "left")
    left = left.select("source", "class", "n", F.struct("id", "k", "size", F.coalesce("q", "p").alias("p")).alias("x"))
    parts = F.greatest(F.ceil(F.col("n") / GROUP), F.lit(GROUP))  # so many groups, and residuals, of a class
    while most > GROUP:
        group = F.pmod(F.xxhash64(F.lit(seed), F.lit(level), F.col("x.id"), F.col("x.k"), F.col("x.size")), parts)
        f = folded(left.where(F.col("n") > GROUP).withColumn("g", group), "class", "n", "g")
        out = out.unionByName(settled(f))
        left = left.where(F.col("n") <= GROUP).unionByName(f.select("source", "class", parts.alias("n"), F.col("f.left").alias("x")))
        most, level = max(-(-most // GROUP), GROUP), level + 1  # the most documents, then residuals, of a class
    f = folded(left)
    out = out.unionByName(settled(f))
    left = f.select("source", F.col("f.left").alias("x"))
    # one residual per source: rounded at random
    last = left.select("source", F.col("x.id").alias("id"), F.col("x.k").alias("k"), F.col("x.size").alias("size"), (_chance(F.lit(seed), F.lit(-1), F.col("x.id"), F.col("x.k")) < F.col("x.p")).cast("int").alias("bit"))
    out = out.unionByName(last)
    out = out.join(side, out["source"].eqNullSafe(side["s2"]))
    copies = (F.col("whole") + F.col("bit")).cast("long")
    return out.select(F.col("id").alias("doc_id"), "source", "size", "source_size", "target", F.when(F.col("size") > 0, copies).otherwise(0).cast("long").alias("copies")).withColumn("taken", F.col("copies") * F.col("size"))


def report(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken, for every row of docs (null ids, sources and texts too). No rows give none."""
    return plan_copies(docs).select("doc_id", "size", "source_size", "target", "taken")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mixed documents: each row of docs as often as its plan says, with its columns.

    A plan is made for each different row (by a hash of the whole row) and its number, and joined to the
    rows by that hash, the one shuffle of texts. Rows that agree in everything are interchangeable: each
    is taken equally often, and what is left over is added as further copies of it. Null ids and
    repeated ids with different texts are rows of their own.
    """
    key, copies = spare(docs, "__key"), spare(docs, "__copies")
    named = docs.select(F.struct(F.col(id_col).alias("id"), row_hash(docs).alias("h")).alias("id"), F.col(source_col).alias("source"), F.col(text_col).alias("text"))
    plan = plan_copies(named, "id", "text", "source").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.sum("copies").alias("all"))
    each = F.floor(F.col("all") / F.col("n"))
    plan = checkpoint(plan.select(F.col("doc_id.id").alias("id"), F.col("doc_id.h").alias("h"), "n", each.alias("each"), (F.col("all") - each * F.col("n")).alias("more")).where("each > 0 or more > 0"))
    rows = docs.withColumn(key, row_hash(docs))

    def taken(plan: DataFrame) -> DataFrame:
        p = plan.select(F.col("h").alias("h2"), F.col("id").alias("id2"), "c")
        return rows.join(p, (rows[key] == p["h2"]) & rows[id_col].eqNullSafe(p["id2"])).withColumn(copies, F.col("c"))

    single = (F.col("n") == 1).cast("long")
    out = taken(plan.withColumn("c", F.col("each") + single * F.col("more")).where("c > 0"))
    out = out.withColumn(copies, F.explode(F.sequence(F.lit(1).cast("long"), F.col(copies)))).select(*docs.columns)
    rest = plan.where("n > 1 and more > 0").withColumn("c", F.col("more"))
    if rest.limit(1).count():
        # one of the equal rows, as often as is still wanted, in parts so that no task writes all copies of a frequent row
        one = taken(rest).dropDuplicates([key, id_col]).withColumn(copies, F.explode(F.sequence(F.lit(0).cast("long"), F.col(copies) - 1, F.lit(PART))))
        one = one.repartition(key, copies).withColumn(copies, F.explode(F.sequence(F.lit(1).cast("long"), F.least(F.lit(PART), F.col("c") - F.col(copies)))))
        out = out.unionByName(one.select(*docs.columns))
    return out
