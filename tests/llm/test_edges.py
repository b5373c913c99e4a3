"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns, for each operator and stage."""

import pytest

import corpus_pipeline
from octetlake.llm import decontaminate, embedding_dedup, langid, license_scan, mixing, quality, sharding, simhash, toxicity, url_filter

LONG = "word " * 300_000
PASSAGE = " ".join(f"bench{i}" for i in range(14))
DOC_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, match string, class int, size long, shard int, id int"
EXTRA = (0.5, "m", 1, 7, 3, 9)


def _docs(spark, rows):
    return spark.createDataFrame([(*r, *EXTRA) for r in rows], DOC_SCHEMA)


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(1, None, None, None, None), (2, "", "en", "a", 0), (3, "  \n\t", "en", "a", 4), (4, LONG, "en", "a", len(LONG)), (None, "no id here", None, "b", 10)]
    rows += [(5, "same text twice over", "de", "b", 20)] * 2 + [(6, "same text twice over", "de", None, 20), (7, f"Intro, {PASSAGE.upper()} outro", "en", "b", 90)]
    rows += [(8, "ünïcödé 漢字 \U0001f600 text", None, "c", 9), (9, "!!! ???", "fr", "c", 7)]
    return _docs(spark, rows).cache()


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(2, 0, 0), (5, 1, 1), (5, 0, 0), (7, 1, 0), (None, 1, 1), (8, None, None)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def bench(spark):
    return spark.createDataFrame([(1, PASSAGE), (2, None), (3, ""), (None, "lonely words")], "item_id long, text string")


DOC_REPORTS = {
    "op1": lambda d, lab, b: decontaminate.report(d, b),
    "op2": lambda d, lab, b: toxicity.report(d, lab),
    "op4": lambda d, lab, b: mixing.report(d),
    "op5": lambda d, lab, b: license_scan.report(d),
    "op6": lambda d, lab, b: simhash.report(d),
    "op7": lambda d, lab, b: quality.report(d, lab),
    "op9": lambda d, lab, b: langid.report(d),
    "op10": lambda d, lab, b: sharding.report(d),
}


@pytest.mark.parametrize("op", DOC_REPORTS)
def test_odd_rows_keep_one_row_each(op, odd, labels, bench):
    got = DOC_REPORTS[op](odd, labels, bench).collect()
    assert sorted(str(r.doc_id) for r in got) == sorted(str(r.doc_id) for r in odd.select("doc_id").collect())


@pytest.mark.parametrize("op", DOC_REPORTS)
def test_empty_table(op, odd, labels, bench):
    assert DOC_REPORTS[op](odd.limit(0), labels, bench).count() == 0


@pytest.mark.parametrize("op", DOC_REPORTS)
def test_empty_sides(op, odd, labels, bench):
    assert DOC_REPORTS[op](odd, labels.limit(0), bench.limit(0)).count() == odd.count()


def test_decontaminate_values(odd, bench):
    got = {r.doc_id: r for r in decontaminate.report(odd, bench).collect() if r.doc_id is not None}
    assert (got[7].n_words, got[7].n_hit, got[7].n_items, got[7].contaminated) == (16, 14, 1, True)
    assert (got[1].n_words, got[1].n_hit, got[1].contaminated) == (0, 0, False)
    assert got[4].n_words == 300_000
    cut = {r.doc_id: r.text for r in decontaminate.decontaminate(odd, bench, "cut").collect()}
    assert cut[7] == "Intro,  outro"


@pytest.mark.parametrize("step", range(len(corpus_pipeline.STAGES)))
def test_stages_keep_columns(step, spark, odd, labels, bench, tmp_path):
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    bench.write.parquet(f"{tmp_path}/benchmark.parquet")
    _, stage = corpus_pipeline.STAGES[step]
    for docs in (odd, odd.limit(0)):
        got = stage(spark, docs, str(tmp_path))
        rows = got.collect()
        if step < len(corpus_pipeline.STAGES) - 1:
            assert got.columns == docs.columns
        assert len(rows) > 0 or docs is not odd


def test_vectors(spark):
    rows = [(1, [1.0, 0.0], 5), (2, [2.0, 0.0], 5), (3, [0.0, 0.0], 5), (4, None, 5), (5, [float("nan"), 1.0], 5), (6, [1.0, None], 5), (7, [1.0, 0.1], 5), (7, [1.0, 0.1], 5)]
    rows += [(8, [float("inf"), 1.0], 5), (9, [], 5), (None, [0.0, -1.0], 5), (10, [1e-300, 0.0], 5)]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>, keys int")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embedding_dedup.report(v).collect()}
    for k in (1, 2, 7, 10):
        assert got[k] == (4, 1, k == 1)
    for k in (3, 4, 5, 6, 8, 9):
        assert got[k] == (0, k, True)
    assert got[None][:2] == (0, None)
    assert embedding_dedup.report(v.limit(0)).count() == 0
    assert embedding_dedup.report(v.where("vec_id in (3, 4)")).count() == 2


def test_urls(spark):
    urls = [None, "", "no scheme", "http://A.Com/en/x", "ftp://example.com/en/7z?q", "://", "https://com", "https://x.org/es/", "http://xorg/es/", "http://example.net/de/8#f", "http://h.test/a.zip", "http://b.com?/en/"]
    pages = spark.createDataFrame([(i, u, None, "r") for i, u in enumerate(urls)], "page_id long, url string, html string, rule string")
    got = [tuple(r)[1:] for r in url_filter.report(pages).orderBy("page_id").collect()]
    assert got[0] == got[1] == got[2] == ("", "", None, "allow")
    assert got[3] == ("a.com", "/en/x", "com/en/", "block")
    assert got[4] == ("example.com", "/en/7z", "example.com/en/7", "allow")
    assert got[7][2:] == ("org/es/", "block") and got[8][2] is None
    assert got[9] == ("example.net", "/de/8", "example.net/de/8", "block")
    assert got[10][2:] == (None, "block") and got[11][1:3] == ("", None)
    assert url_filter.report(pages.limit(0)).count() == 0


def test_prefix_rules_are_the_contract_s(spark):
    """Each rule's word as the contract lists them; net/ allows, also where a glob of the filter's own would block."""
    said = {"com/en/": "block", "example.com/en/7": "allow", "net/de/": "allow", "example.net/de/8": "block", "org/es/": "block"}
    assert {h + p: v for h, p, v in url_filter.PREFIX_RULES} == said
    pages = spark.createDataFrame([(0, "http://a.net/de/1"), (1, "http://ads.example.net/de/x.zip"), (2, "http://example.net/de/81"), (3, "http://a.net/en/x.zip")], "page_id long, url string")
    got = [tuple(r)[3:] for r in url_filter.report(pages).orderBy("page_id").collect()]
    assert got == [("net/de/", "allow"), ("net/de/", "allow"), ("example.net/de/8", "block"), (None, "block")]


def test_simhash_keeps_one_row_of_each_group(spark):
    a, b, c, d = (" ".join(f"{x}{i}" for i in range(40)) for x in "abcd")
    rows = [(None, a, "en", "s", 1), (None, b, "en", "s", 1), (5, c, "en", "s", 1), (5, d, "en", "s", 1), (6, c, "en", "s", 1), (7, c, "en", "s", 1)]
    rows += [(7, "text of its own under seven", "en", "s", 1)] * 2 + [(8, "", "en", "s", 1), (8, None, "en", "s", 1)]
    got = simhash.drop_near_duplicates(_docs(spark, rows))
    kept = sorted((str(r.doc_id), r.text or "") for r in got.collect())
    assert kept == sorted([("None", a), ("None", b), ("5", c), ("5", d), ("7", "text of its own under seven"), ("8", "")])


def test_vectors_of_two_lengths(spark):
    rows = [(i, [1.0, float(i), 0.0]) for i in range(10, 20, 5)] + [(30 + i, [1.0, 0.01 * i]) for i in range(2)] + [(40, [1.0, 0.0]), (50, [2.0]), (51, [3.0])]
    rows += [(60 + i, [float(i % 7), 1.0, float(i % 5)]) for i in range(20)]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {r.vec_id: (r.n_links, r.component_id) for r in embedding_dedup.report(v).collect()}
    assert len(got) == len(rows)
    assert [got[k] for k in (30, 31, 40)] == [(2, 30)] * 3 and [got[k] for k in (50, 51)] == [(1, 50)] * 2


def test_values_of_odd_rows(odd, labels, bench):
    """What nulls, empty, wordless, very long and repeated texts give, operator by operator."""
    by = lambda df: {r.doc_id: r for r in df.collect() if r.doc_id is not None}
    tox, qual = by(toxicity.report(odd, labels)), by(quality.report(odd, labels))
    for got in (tox, qual):
        assert got[1].score == got[2].score == got[3].score == got[9].score  # null, empty and wordless texts have no features
        assert got[5].score == got[6].score  # equal texts
        assert all(0 <= r.score <= 1 for r in got.values())
    lang = by(langid.report(odd))
    assert all(tuple(lang[k])[2:] == ("und", 0.0) for k in (1, 2, 3, 9)) and lang[8].lang_pred in ("en", "de", "fr")
    mixed = by(mixing.report(odd))
    assert [mixed[k]["size"] for k in (1, 2, 3, 4, 5, 8, 9)] == [0, 0, 0, 300_000, 4, 4, 2]
    assert all(mixed[k].taken == 0 for k in (1, 2, 3)) and all(r.taken % max(1, r["size"]) == 0 and r.taken <= 3 * r["size"] for r in mixed.values())
    lic = by(license_scan.report(odd))
    for k in (1, 2, 3, 9):
        assert tuple(lic[k])[1:] == (0, 0, None, None, "", "", 0.0)
    assert lic[4].n_words == 300_000 and lic[4].labels == ""
    sim = by(simhash.report(odd))
    assert sim[1].fingerprint == sim[2].fingerprint == sim[3].fingerprint == "0" * 16 and sim[3].component_id == 1
    assert sim[6].component_id == 5 and sim[9].fingerprint != "0" * 16  # marks are words there
    rows = by(sharding.report(odd))
    assert [(rows[k]["size"], rows[k].text_crc32) for k in (1, 2)] == [(8, 0), (8, 0)] and rows[4]["size"] == len(LONG) + 8
    assert rows[1].shard == rows[2].shard and rows[5].shard == rows[6].shard


def test_two_null_ids_and_names_with_underscores(spark, labels, bench):
    """Rows without id stay apart in every operator and stage; columns named like those used inside come back unharmed."""
    rows = [(None, f"document number {i} without any id at all", "en", "s", 5) for i in range(4)] + [(5, "one text of five", "en", "s", 4), (5, "another text of five", "en", "s", 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for name in ("__size", "__copy", "__contamination", "__toxicity", "__row_hash", "__key", "__hash", "match", "h"):
        docs = docs.withColumn(name, docs["n_chars"])
    for op, report in DOC_REPORTS.items():
        assert report(docs, labels, bench).count() == 6, op
    outs = {
        "toxicity": toxicity.drop_toxic(docs, labels, 2.0), "simhash": simhash.drop_near_duplicates(docs), "cut": decontaminate.decontaminate(docs, bench, "cut"),
        "slices": decontaminate.find_contamination(docs.drop("match"), bench, max_windows=1).drop("match").withColumn("match", docs["n_chars"]), "sharding": sharding.shard(docs).drop("shard", "slot"),
    }
    want = sorted(map(str, docs.collect()))
    for name, out in outs.items():
        assert sorted(map(str, out.select(*docs.columns).collect())) == want, name
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns and {str(r) for r in mixed.collect()} <= set(want)
