"""Nulls in any column, empty and long texts, ties and repeated rows, empty tables, clashing columns."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from cubiform.llm import chunk_dedup, decontam, minhash, mixing, pii, queries, repetition, secrets, suffix_dedup, toxicity, url_rules
from tests.llm import cases


def items(spark):
    return spark.createDataFrame([(1, "the lazy dog while the band plays a slow tune about rivers"), (None, None), (2, "")], "item_id long, text string")


def model():
    import numpy as np

    return toxicity.Ordinal(np.zeros(1 << toxicity.ToxicityRules().bits), np.array([1.0, 2.0]))


OPERATORS = {
    "secrets": (lambda d, s: secrets.scan(d), ["secret_spans", "kind"]), "mixing": (lambda d, s: mixing.mix_sources(d, keep=("lang",)), ["size", "target", "taken", "seats", "name", "_shard"]),
    "chunks": (lambda d, s: chunk_dedup.dedup_chunks(d, texts=True), ["n_bytes", "row", "digest", "kept_text"]), "leaks": (lambda d, s: decontam.find_leaks(d, items(s)), ["n_words", "hit_items"]),
    "near": (lambda d, s: minhash.near_groups(d), ["node", "bands", "kept"]), "quality": (lambda d, s: repetition.quality(d), ["kept", "n_words"]),
    "suffix": (lambda d, s: suffix_dedup.remove_repeats(d, texts=True), ["row1", "key", "removed"]), "toxicity": (lambda d, s: toxicity.grade_texts(d, model()), ["severity", "toxic"]),
    "pii": (lambda d, s: pii.find_pii(d), ["pii_spans", "_pii_text", "_pii_email"]),
}
DOCUMENTS = {
    "keep_good": (lambda d, s: repetition.keep_good(d), ["kept", "n_words"]), "drop_near": (lambda d, s: minhash.drop_near(d), ["node", "kept"]),
    "decontaminate": (lambda d, s: decontam.decontaminate(d, items(s)), ["n_words", "hit_ranges"]), "redact": (lambda d, s: pii.redact(d), ["_pii_spans", "pii_spans", "start"]),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_one_row_for_each(spark, name):
    f, clash = OPERATORS[name]
    assert f(cases.hard(spark), spark).count() == len(cases.hard_rows())
    assert f(cases.hard(spark, clash), spark).count() == len(cases.hard_rows())
    assert f(cases.empty(spark), spark).count() == 0


@pytest.mark.parametrize("name", DOCUMENTS)
def test_documents_keep_their_columns(spark, name):
    f, clash = DOCUMENTS[name]
    df = cases.hard(spark, [*clash, "with.dot"])
    got = f(df, spark)
    assert got.columns == df.columns and {tuple(r[c] for c in [*clash, "with.dot"]) for r in got.collect()} <= {("own",) * (len(clash) + 1)}
    assert f(cases.empty(spark), spark).count() == 0


def test_defined_results(spark):
    hard = cases.hard(spark)
    near = {r.doc_id: r for r in minhash.near_groups(hard).collect() if r.doc_id is not None}
    assert (near[1].n_shingles, near[1].component_id, near[1].kept) == (0, 1, True) and near[2].kept and near[3].kept
    assert near[5].component_id == 4 and near[7].component_id == 6 and near[9].component_id == 8
    nulls = [r for r in minhash.near_groups(hard).collect() if r.doc_id is None]
    assert sorted((r.component_id or 0, r.kept) for r in nulls) == [(0, True), (4, False)]
    mixed = mixing.mix_sources(hard).collect()
    assert all(0 <= r.taken <= 3 * r.size for r in mixed) and [r.size for r in mixed if r.doc_id in (1, 2, 3)] == [0, 0, 0]
    repeats = {r.doc_id: r for r in suffix_dedup.remove_repeats(hard, keep=["doc_id"]).collect() if r.doc_id is not None}
    assert repeats[1].n_bytes == 0 and repeats[7].n_removed == 0 and repeats[9].n_removed == repeats[9].n_bytes - 4 and repeats[10].n_removed == 100_000
    graded = toxicity.grade_texts(hard, model(), keep=["doc_id"]).collect()
    assert not any(r.toxic for r in graded)


def test_fits_without_lessons(spark):
    labels = spark.createDataFrame([(1, 1, 0), (None, 0, 1), (4, None, 1)], "doc_id long, quality int, toxic int")
    fitted = toxicity.fit_table(cases.hard(spark), labels)
    assert not fitted.weights.any()
    assert not toxicity.fit_table(cases.empty(spark), labels).weights.any()
    pages = spark.createDataFrame([(1, None), (2, "no scheme"), (3, "x://"), (3, "x://"), (None, "x://a.org/")], "page_id long, url string")
    assert url_rules.mine(pages, labels, F.expr("quality = 0")).count() == 0
    got = url_rules.judge_urls(pages.withColumn("host", F.lit("own")), []).collect()
    assert len(got) == 5 and {(r.host, r.path) for r in got if r.page_id in (1, 2, 3)} == {("", "")} and all(r.verdict == "allow" for r in got)
    assert url_rules.judge_urls(pages.limit(0), []).count() == 0


def test_every_query_is_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 11))


def test_native_operators_use_no_python(spark):
    for name in ("op3_source_mix", "op10_pii"):
        df = queries.QUERIES[name](spark, cases.SF)
        assert "Python" not in df._jdf.queryExecution().toString() and "Arrow" not in df._jdf.queryExecution().toString()


def test_pipeline_against_plain_stages(spark):
    """Each stage is held against a plain version of it, on what the stages before kept."""
    docs = cases.documents(spark)
    before = {r.doc_id: r for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES:
        after = stage(spark, spark.createDataFrame(list(before.values()), docs.schema), cases.SF).collect()
        now = {r.doc_id: r for r in after}
        assert len(now) == len(after)
        if name == "near-dedup":
            assert set(now) == {i for i, c in cases.near_components({i: r.text for i, r in before.items()}).items() if i == c}
        elif name == "quality rules":
            kept = {r.doc_id for r in queries.QUERIES["op7_quality_rules"](spark, cases.SF).collect() if r.kept}
            assert set(now) == kept
        elif name == "benchmark decontamination":
            windows = set()
            for item in spark.read.parquet(f"{cases.SF}/benchmark.parquet").collect():
                words = cases.alnum_words(item.text)
                windows |= {tuple(words[i : i + 10]) for i in range(len(words) - 9)}
            hit = lambda t: any(tuple(w[i : i + 10]) in windows for w in [cases.alnum_words(t)] for i in range(len(w) - 9))
            assert all(now[i].text == r.text for i, r in before.items() if not hit(r.text))
            assert not any(hit(r.text) for r in now.values()) and all(i in now for i, r in before.items() if not hit(r.text))
        elif name == "pii":
            assert set(now) == set(before) and any(now[i].text != before[i].text for i in now)
            assert all(r.n_chars == len(r.text) for r in now.values())
        else:
            assert set(now) == set(before) and sum(r.taken for r in after) > 0
            break
        assert stage and list(after[0].__fields__) == docs.columns
        before = now
    assert corpus_pipeline.run(spark, cases.SF).count() == len(now)


def hard_pages(spark, folder, clash=()):
    """Hard rows that the quality rules reject, and some like them that pass: long, null in other columns, repeated, tied."""
    import random

    random.seed(4)
    words = ["".join(random.choices("abcdefghijklmnop", k=random.randint(2, 9))) for _ in range(20_000)]
    prose = lambda a, n: " ".join(words[(a + 7 * i) % 20_000] for i in range(n))
    long = " ".join(random.choices(words, k=60_000))
    rows = cases.hard_rows() + [
        (50, prose(0, 120), None, None, None), (51, prose(0, 120), "en", "a", 1), (51, prose(0, 120), "en", "a", 1), (None, prose(3, 90), "en", "a", 1), (52, long, "en", "b", 1), (53, f"{long} end", "en", "b", 1),
        (54, f"{prose(5, 80)} mail jo@example.org or +1 555 010 0199", "de", "c", None), (55, f"{prose(9, 60)} the lazy dog while the band plays a slow tune about rivers {prose(11, 60)}", "en", "a", 1), (56, f"{prose(2, 40)} é ü \u2028 \0 {prose(4, 40)}", "fr", "b", 1),
    ]
    df = spark.createDataFrame(rows, cases.DDL)
    for name in clash:
        df = df.withColumn(name, F.lit("own"))
    df.write.parquet(f"{folder}/documents.parquet")
    items(spark).write.parquet(f"{folder}/benchmark.parquet")
    return df


def test_pipeline_on_hard_rows(spark, tmp_path):
    clash = ["kept", "n_words", "node", "label", "hit_ranges", "_pii_text", "size", "taken", "with.dot"]
    hard_pages(spark, tmp_path, clash)
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted((r.doc_id or 0) for r in got) == [0, 50, 52, 54, 55, 56]
    size = {r.doc_id: r.size for r in got}
    assert size[52] == 60_000 and size[55] == 120 and size[54] == 84 and all(0 <= r.taken <= 3 * r.size for r in got)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == [*(x.split()[0] for x in cases.DDL.split(", ")), *clash]


def test_pipeline_on_empty_tables(spark, tmp_path):
    cases.empty(spark).write.parquet(f"{tmp_path}/documents.parquet")
    items(spark).limit(0).write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_very_long_texts(spark):
    """A text of three megabytes is read whole by every operator."""
    import random

    random.seed(9)
    words = ["".join(random.choices("abcdefghijklmnop", k=6)) for _ in range(50_000)]
    body = " ".join(random.choices(words, k=430_000))
    end = " password: hunter22 client_id=jo7 mail jo@example.org"
    df = spark.createDataFrame([(1, body + end, "en", "a", 1), (2, body[:-7] + end, "en", "a", 1), (3, "short", "en", "a", 1)], cases.DDL)
    assert {r.doc_id: len(r.pii_spans) for r in pii.find_pii(df).collect()} == {1: 1, 2: 1, 3: 0}
    assert {r.doc_id: [s.kind for s in r.secret_spans] for r in secrets.scan(df).collect()}[1] == ["assign", "client"]
    assert {r.doc_id: r.component_id for r in minhash.near_groups(df).collect()} == {1: 1, 2: 1, 3: 3}
    removed = {r.doc_id: (r.n_bytes, r.n_removed) for r in suffix_dedup.remove_repeats(df, keep=["doc_id"]).collect()}
    assert removed[1][1] == len(body) - 6 and removed[2][0] - removed[2][1] == len(end) - 1 and removed[3] == (5, 0)
    shared = {r.doc_id: r.n_removed for r in chunk_dedup.dedup_chunks(df, keep=["doc_id"]).collect()}
    assert shared[1] == 0 and shared[2] > 0.999 * (len(body) - 7)
    assert {r.doc_id: r.n_words for r in repetition.quality(df, keep=["doc_id"]).collect()}[1] == 430_000 + 5
    assert {r.doc_id: r.n_words for r in decontam.find_leaks(df, items(spark), keep=["doc_id"]).collect()}[3] == 1
    assert mixing.mix_sources(df).filter("doc_id = 1").first().size == 430_000 + 5


def test_many_matches_in_one_text(spark):
    """Places are right beyond one block of a running total."""
    import re

    text = " ".join(f"user{i}@example.org" if i % 3 else f"+1 555 01{i:05d}" for i in range(1000))
    row = pii.find_pii(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert [(s.start, s.stop) for s in row.pii_spans if s.kind == "email"] == [(m.start(), m.end()) for m in re.finditer(r"user\d+@example\.org", text)]
    clean = pii.redact(spark.createDataFrame([(1, text)], "doc_id long, text string")).first().text
    assert clean == " ".join("[EMAIL]" if i % 3 else "[PHONE]" for i in range(1000))
