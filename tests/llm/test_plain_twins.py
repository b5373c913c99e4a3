"""Plain-Python twins: license rules and labels, the classifiers' features, learning and scores, slices, bounds."""

import itertools
import math
import re
from bisect import bisect_right
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from octetlake.llm import common, decontaminate, langid, license_scan, mixing, quality, sharding, toxicity
from octetlake.llm.common import table
from octetlake.llm.license_rules import CC_BY, RULES, TRIGGERS
from tests.llm.test_brute_force import BASE, UPPER, WORD, words

M64 = (1 << 64) - 1

# --- license rules -------------------------------------------------------------------------------------------


def samples(tree, limit=40):
    """Texts that a parsed expression matches, each alternative and each option taken at least once."""
    out = [""]
    for op, arg in tree:
        op = str(op)
        if op == "LITERAL":
            part = [chr(arg)]
        elif op == "IN":
            part = [chr(v if str(k) == "LITERAL" else v[0]) for k, v in arg]
        elif op in ("MAX_REPEAT", "MIN_REPEAT"):
            lo, hi, sub = arg
            one = samples(sub, limit)
            part = [x * n for n in {lo, min(int(hi), lo + 1)} for x in (one if n else [""])]
        elif op == "SUBPATTERN":
            part = samples(arg[-1], limit)
        elif op == "BRANCH":
            part = [x for t in arg[1] for x in samples(t, limit)]
        elif op == "ANY":
            part = ["q"]
        elif op in ("ASSERT", "ASSERT_NOT"):
            part = [""]
        else:
            raise AssertionError(op)
        out = [a + b for a, b in itertools.product(out, part)]
        if len(out) > limit:
            out = out[:: -(-len(out) // limit)] + out[-1:]
    return out


SAMPLES = [(k, s) for k, r in enumerate(RULES) for s in dict.fromkeys(samples(re._parser.parse(r.regex)))]


def test_rules_keep_their_promises():
    assert len(RULES) > 300 and {k for k, _ in SAMPLES} == set(range(len(RULES)))
    for k, s in SAMPLES:
        r = RULES[k]
        assert re.search(r.regex, f" {s} "), (r.label, s)
        assert r.keyword in f" {s} ", (r.label, r.keyword, s)
        assert any(t in w for t in TRIGGERS for w in s.split()) or re.search(CC_BY, s), (r.label, s)


def plain_labels(text):
    """Labels and score of a text: all matches of all rules, the strongest first, none that overlaps one before."""
    w = words(text)
    whole = " " + " ".join(w) + " "
    hits = [(r.priority, m.end() - m.start(), -k, -m.start(), m.start(), m.end(), r) for k, r in enumerate(RULES) for m in re.finditer(r.regex, whole)]
    kept = []
    for h in sorted(hits, key=lambda h: h[:4], reverse=True):
        if all(h[4] >= k[5] or k[4] >= h[5] for k in kept):
            kept.append(h)
    base = {v for p, v in BASE.items() if f" {p} " in whole}
    score = max([k[6].confidence for k in kept] + [0.9 if base else 0.0])
    return ",".join(sorted({k[6].label for k in kept} | base)), score


def test_license_labels(spark, sf_dir):
    texts = [s.title() for _, s in SAMPLES[::3]] + ["Intro, " + ". ".join(s for _, s in SAMPLES[i : i + 7]) for i in range(0, len(SAMPLES), 40)]
    texts += ["MIT No Attribution", "CC Attribution ShareAlike 4.0", "open-rail license", "", None, "!!", "all rights reserved " * 3000, "mit license apache license " * 400]
    texts += [r.text for r in table(spark, sf_dir, "documents").collect()]
    got = license_scan.report(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert len(got) == len(texts)
    for r in got:
        assert (r.labels, r.score) == plain_labels(texts[r.doc_id]), (texts[r.doc_id] or "")[:200]


def test_chain_of_overlaps(spark):
    hit = lambda a, b, p, k: (a, b, p, f"l{k}", 0.5, k)
    hits = [hit(0, 10, 1, 0), hit(8, 20, 2, 1), hit(18, 30, 3, 2), hit(40, 50, 1, 3), hit(50, 60, 1, 4)]
    df = spark.createDataFrame([(hits,), ([],)], f"h array<{license_scan._HIT}>")
    got = [[h.rule for h in r[0]] for r in df.select(license_scan._resolve(F.col("h"))).collect()]
    assert got == [[0, 2, 3, 4], []]  # 1 gives way to 2, so 0 stays


# --- hashes of words, as plain integers ----------------------------------------------------------------------


def mix(h):
    h ^= h >> 31
    h = h * 0x7FB5D329728EA185 & M64
    h ^= h >> 27
    h = h * 0x81DADEF4BC2DD44D & M64
    return h ^ h >> 33


def word_hash(w):
    return mix(sum((b + 1) * pow(0x9E3779B97F4A7C15, i, 1 << 64) for i, b in enumerate(w.encode())) & M64)


def toxic_features(text):
    h, out = [word_hash(w) for w in words(text)], set()
    for x in h:
        out.add(x >> 44)
    for gap, base in ((1, 1 << 20), (2, (1 << 20) + (1 << 19))):
        for a, b in zip(h, h[gap:]):  # noqa: B905
            out.add((mix((a * (0x9FB21C651E98DF25 + 2 * gap) + b) & M64) >> 45) + base)
    return out


def plain_ftrl(rows, s):
    z, n = defaultdict(float), defaultdict(float)

    def weight(i):
        if i == "bias":
            return -z[i] / ((s.beta + math.sqrt(n[i])) / s.alpha + s.l2)
        return 0.0 if abs(z[i]) <= s.l1 else -(z[i] - math.copysign(s.l1, z[i])) / ((s.beta + math.sqrt(n[i])) / s.alpha + s.l2)

    def chance(feats):
        t = sum(weight(i) for i in feats) + weight("bias")
        return 1 / (1 + math.exp(-max(-35, min(35, t))))

    for _ in range(s.rounds):
        for feats, y in rows:
            g = chance(feats) - y
            for i, w in [(i, weight(i)) for i in [*feats, "bias"]]:
                z[i] += g - (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / s.alpha * w
                n[i] += g * g
    return chance


def test_toxicity_plain(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    s = toxicity.Settings(l1=0.5)
    sample = common.labelled_texts(docs, labels, "toxic", s.max_rows, 2).orderBy(F.xxhash64(F.lit(2), F.col("doc_id")), "text").collect()
    chance = plain_ftrl([(toxic_features(r.text), r.y) for r in sample], s)
    model = toxicity.fit(docs, labels, settings=s)
    got = docs.select("text", toxicity.score(docs, model).alias("p")).collect()
    assert len(model.index) > 20
    for r in got:
        assert r.p == pytest.approx(chance(toxic_features(r.text)), abs=1e-9)


def plain_quality(text):
    w = words(text)
    if not w:
        return [0.0] * len(quality.NAMES)
    data, k = text.encode(), len(w)
    c = lambda chars: sum(data.count(x) for x in chars.encode())
    upper, high = c("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), sum(b > 127 for b in data)
    named = upper + high + c("0123456789!|#$%&*+<=>@\\^_`{}~[]/\n.? \t\r,;:'\"()-")
    lower, size, lens = len(data) - named, max(1, len(data)), [len(x.encode()) for x in w]
    lines = c("\n")
    return [
        math.log1p(k), sum(lens) / k, upper / max(1, lower + upper), c("0123456789") / size, c(",;:'\"()-") / k, c("!") / k, c("|") / k, c("#$%&*+<=>@\\^_`{}~[]/") / k, lines / k,
        math.log1p(size / (lines + 1)), len(set(w)) / k, len(set(zip(w, w[1:]))) / max(1, k - 1), c(".?") / k, sum(n <= 2 for n in lens) / k, sum(n > 12 for n in lens) / k, high / size,  # noqa: B905
        max(Counter(w).values()) / k,
    ]


def test_quality_plain(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    m = quality.fit(docs, labels)
    assert m.tables and m.pairs
    for r in docs.select("text", quality.score(docs, m).alias("p"), quality.feature_column("text").alias("x")).collect():
        x = plain_quality(r.text)
        assert r.x == pytest.approx(x, abs=1e-9)
        t = m.bias + sum(table_[bisect_right(edges, v)] for edges, table_, v in zip(m.edges, m.tables, r.x, strict=True))
        t += sum(tab[bisect_right(m.coarse[f], r.x[f]), bisect_right(m.coarse[g], r.x[g])] for f, g, tab in m.pairs)
        assert r.p == pytest.approx(1 / (1 + math.exp(-max(-35, min(35, t)))), abs=1e-9)


def test_quality_trees_are_the_best_cuts():
    rng = np.random.default_rng(4)
    for _ in range(20):
        g, h = rng.normal(size=9), rng.random(9) + 0.1
        gain = lambda a, b: g[a:b].sum() ** 2 / (h[a:b].sum() + 1)  # noqa: B023, E731
        best = max(range(1, 9), key=lambda c: gain(0, c) + gain(c, 9))
        step = quality._tree(g, h, 2)
        assert step == pytest.approx(np.r_[[-g[:best].sum() / (h[:best].sum() + 1)] * best, [-g[best:].sum() / (h[best:].sum() + 1)] * (9 - best)])
        gg, hh = rng.normal(size=(4, 5)), rng.random((4, 5)) + 0.1
        parts = lambda i, j: [(slice(0, i), slice(0, j)), (slice(0, i), slice(j, 5)), (slice(i, 4), slice(0, j)), (slice(i, 4), slice(j, 5))]
        total = {(i, j): sum(gg[p].sum() ** 2 / (hh[p].sum() + 1) for p in parts(i, j)) for i in range(1, 4) for j in range(1, 5)}
        got, _ = quality._quadrants(gg, hh)
        assert got == pytest.approx(max(total.values()))


def plain_trigrams(text):
    b = bytes(x if x in b"0123456789abcdefghijklmnopqrstuvwxyz" or x > 127 else 32 for x in text.translate(UPPER).encode())
    n = Counter()
    for i in range(len(b) - 2):
        t = b[i : i + 3]
        if t[1] != 32 or (t[0] != 32 and t[2] != 32):
            n[(int.from_bytes(t, "big") * 2654435761 & 0xFFFFFFFF) >> 21] += 1
    norm = math.sqrt(sum(n.values())) or 1.0
    return {k: math.sqrt(v) / norm for k, v in n.items()}


def test_langid_plain(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    m = langid.fit(docs)
    assert sum(map(len, m.families)) >= 3
    dot = lambda w, x: sum(float(w[k]) * v for k, v in x.items()) + float(w[-1])
    for r in docs.select("text", langid.predict(docs, m).alias("p")).collect():
        if not re.search(r"[^\W\d_]", r.text or ""):
            assert tuple(r.p) == ("und", 0.0)
            continue
        x = plain_trigrams(r.text)
        margins = [dot(m.family_weights[:, f], x) for f in range(len(m.families))]
        f = max(range(len(margins)), key=margins.__getitem__)
        codes, votes, total = m.families[f], Counter(), Counter()
        for i, j in itertools.combinations(range(len(codes)), 2):
            d = dot(m.duels[f, i, j], x)
            votes[i if d > 0 else j] += 1
            total[i] += d
            total[j] -= d
        best = max(range(len(codes)), key=lambda i: votes[i] + 1e-3 * math.tanh(total[i]))
        score = 1 / (1 + math.exp(-3 * margins[f])) * (1 / (1 + math.exp(-3 * total[best] / (len(codes) - 1))) if len(codes) > 1 else 1)
        assert r.p.lang == codes[best] and r.p.score == pytest.approx(score, abs=1e-4)


def test_linear_svm_is_at_its_optimum():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(200, 6)).astype(np.float32)
    y = np.where(x[:, 0] - 0.5 * x[:, 1] + 0.3 * rng.normal(size=200) > 0.4, 1, -1)
    one, side = np.hstack([x, np.ones((200, 1))]), np.where(y > 0, 0.5 / (y > 0).sum(), 0.5 / (y < 0).sum())
    loss = lambda w: (w @ w) / 2000 + (side * np.maximum(0, 1 - y * (one @ w)) ** 2).sum()
    w = langid.linear_svm(x, y, steps=1000).astype(float)
    nearby = [loss(w + 0.05 * rng.normal(size=7)) for _ in range(200)]
    assert loss(w) <= min(nearby) + 1e-4


# --- bounds ----------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("bound", [1, 37, 150])
def test_benchmark_slices(bound, spark, sf_dir):
    docs, bench = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    m = F.struct("doc_id", "match")
    whole = {r[0].doc_id: r[0] for r in decontaminate.find_contamination(docs, bench).select(m).collect()}
    few = decontaminate.item_windows(bench).count() // bound if bound > 1 else 1 << 40
    sliced = decontaminate.find_contamination(docs.withColumn("__row", F.lit(1)), bench, max_windows=min(few, 1000) if bound > 1 else 400)
    got = {r[0].doc_id: r[0] for r in sliced.select(m).collect()}
    assert got == whole and any(r.match.starts for r in whole.values())


def test_shares_of_huge_tables_are_not_nothing(spark):
    assert common.threshold(1e-12) > 9_000_000 and common.threshold(1e-30) == 1 and common.threshold(1.0) == (1 << 63) - 1
    got = spark.range(100_000).where(common.positive(F.xxhash64("id")) < common.threshold(0.25)).count()
    assert abs(got - 25_000) < 1_000


def test_samples_are_bounded_by_rows(spark):
    docs = spark.createDataFrame([(1, f"text {i % 7} of the same id", "en") for i in range(500)] + [(2, "a text alone", "de")], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(1, 1), (2, 0), (None, 1)], "doc_id long, toxic int")
    got = common.labelled_texts(docs, labels, "toxic", 10, 1).collect()
    assert sorted((r.doc_id, r.y) for r in got) == [(1, 1), (2, 0)][: len(got)] and len(got) >= 1
    assert langid._sample(docs, "lang", 4000, 200, 9).count() <= 8
    assert langid._sample(docs, "lang", 4000, 1, 9).select("lang").distinct().count() == 1


def test_mix_of_repeated_rows(spark):
    rows = [(1, "a b c", "x")] * 2500 + [(None, f"t {i} u", "x") for i in range(300)] + [(None, f"v w {i}", None) for i in range(300)] + [(5, "one two", "y"), (5, "three four five", "y"), (6, None, "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("__key", F.lit(1))
    plan = {r.source: (r.taken, r.target) for r in mixing.plan_copies(docs).groupBy("source").agg(F.sum("taken").alias("taken"), F.max("target").alias("target")).collect()}
    got = mixing.mix(docs)
    assert got.columns == docs.columns
    n = Counter((r.doc_id, r.text, r.source) for r in got.collect())
    have = Counter(rows)
    assert all(v <= 3 * have[k] and k[1] for k, v in n.items())
    taken = Counter()
    for (_, text, source), v in n.items():
        taken[source] += v * len(text.split())
    assert all(abs(taken[s] - target) <= 3 for s, (_, target) in plan.items())


@pytest.mark.parametrize(("whole", "parted"), [(0.0, True), (0.01, True), (float("inf"), False)])
def test_shards_of_equal_texts(whole, parted, spark):
    rows = [(i, "the same long text for many rows " * 3) for i in range(600)] + [(1000 + i, f"text {i} " * (1 + i % 9)) for i in range(600)]
    got = sharding.report(spark.createDataFrame(rows, "doc_id long, text string"), 8, whole).collect()
    homes = {r.shard for r in got if r.doc_id < 600}
    assert (len(homes) > 1) == parted
    if parted:
        load = Counter()
        for r in got:
            load[r.shard] += r["size"]
        assert max(load.values()) - min(load.values()) <= 600
    with pytest.raises(ValueError, match="shards"):
        sharding.build_tree(spark.createDataFrame(rows[:2], "doc_id long, text string"), 5000)
