"""Operators against brute force, on the small tables and on made ones."""

import hashlib
import random
import re
from collections import Counter, defaultdict
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from cubiform.llm import chunk_dedup, components, decontam, minhash, mixing, pii, queries, repetition, secrets, suffix_dedup, suffixes, toxicity, url_rules
from tests.llm import cases

SF = cases.SF


def run(spark, name):
    return queries.QUERIES[name](spark, SF).collect()


def test_op7(spark):
    docs = cases.texts(spark)
    rows = run(spark, "op7_quality_rules")
    assert len(rows) == len(docs)
    for r in rows:
        text = docs[r.doc_id]
        words = cases.blank_words(text)
        grams = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
        hit = {k for i in range(len(words) - 4) if grams[tuple(words[i : i + 5])] > 1 for k in range(i, i + 5)}
        lines = [x for x in text.split("\n") if cases.blank_words(x)]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_repeat_words) == (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(hit))
        assert r.n_dup_lines == len(lines) - len(set(lines))
        assert r.base_failed == (len(words) < 10 or 100 * len(hit) > 20 * len(words)) and not (r.base_failed and r.kept)


def test_op7_keeps_prose(spark):
    random.seed(1)
    text = lambda: " ".join("".join(random.choices("abcdefghij", k=random.randint(1, 9))) for _ in range(300))
    df = spark.createDataFrame([(i, text()) for i in range(50)], "doc_id long, text string")
    assert repetition.quality(df).filter("kept").count() == 50


def reference_spans(text):
    found = []
    for kind, plain in pii.PLAIN.items():
        for m in re.finditer(plain, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            total = sum((v := int(c) * (1 + i % 2)) - 9 * (v > 9) for i, c in enumerate(reversed(digits)))
            if {"email": True, "ip": kind != "ip" or all(int(p) < 256 for p in m[0].split(".")), "card": 16 <= len(digits) <= 19 and total % 10 == 0, "phone": 8 <= len(digits) <= 15}[kind]:
                found.append(f"{kind}:{m.start()}:{m.end()}")
    return found


def test_op10_documents(spark):
    docs = cases.texts(spark)
    for r in run(spark, "op10_pii"):
        spans = reference_spans(docs[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(",".join(spans).encode()).hexdigest() and set(spans) <= set(r.spans.split(",")) | {""}
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s.startswith(k + ":") for s in spans) for k in pii.BASE]


def test_op10_made(spark):
    random.seed(2)
    bits = ["a@b.c", "_d@e.f-g.h", "1.2.3.4", "999.1.1.1.7", "4242 4242 4242 4242", "4242-4242-4242-4243", "+1 (555) 010-9999", "+4 ", "..", "@", " ", "é𝄞", "00000255.1.01.9", "12 34", "-", "+", "x.y@z", "\n"]
    rows = [(i, "".join(random.choices(bits, k=random.randint(1, 12)))) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: [f"{s.kind}:{s.start}:{s.stop}" for s in r.pii_spans if s.kind in pii.BASE] for r in pii.find_pii(df).collect()}
    assert got == {i: reference_spans(t) for i, t in rows}


def test_op10_checks_and_context(spark):
    df = spark.createDataFrame([(1, "iban DE89 3704 0044 0532 0130 00 ok"), (2, "iban DE88 3704 0044 0532 0130 00 no"), (3, "ssn 123-45-6789"), (4, "part 123-45-6789")], "doc_id long, text string")
    got = {r.doc_id: [s.kind for s in r.pii_spans] for r in pii.find_pii(df).collect()}
    assert got == {1: ["iban"], 2: [], 3: ["ssn"], 4: []}
    clean = {r.doc_id: r.text for r in pii.redact(df).collect()}
    assert clean == {1: "iban [IBAN] ok", 2: df.filter("doc_id = 2").first().text, 3: "ssn [SSN]", 4: "part 123-45-6789"}


def test_op2(spark):
    docs = cases.texts(spark)
    plain = {
        "assign": r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", "access": r"AKIA[A-Z0-9]+", "hex": r"[0-9a-f]+",
    }
    for r in run(spark, "op2_secret_scan"):
        found = []
        for rank, (kind, pattern) in enumerate(plain.items()):
            for m in re.finditer(pattern, docs[r.doc_id]):
                if len(m[2] if kind == "assign" else m[0]) >= {"assign": 6, "access": 20, "hex": 24}[kind]:
                    found.append((m.start(), rank, f"{kind}:{m.start()}:{m.end()}"))
        assert r.base_sha256 == hashlib.sha256(",".join(s for *_, s in sorted(found)).encode()).hexdigest()


def test_op2_links_parts():
    key, token = "AKIA" + "ABCDEFGHIJKLMNOP", "wJalrXUtnFEMI7K7MDENGbPxRfiCYEXAMPLEKEYz"
    kinds = lambda t: [k for _, k, _ in secrets.linked_spans(t, secrets.base_spans(t))]
    assert kinds(f"id {key} then {token} at https://db.example.com") == ["opaque", "endpoint"]
    assert kinds(f"only {token} here") == [] and kinds("see https://db.example.com") == []
    assert kinds(f"id {key}\n\nthen {token}") == [] and kinds(f"id {key} {'far ' * 100} {token}") == []


def test_op5(spark):
    docs, items = cases.texts(spark), {str(r.item_id): cases.alnum_words(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    for r in run(spark, "op5_decontaminate"):
        words, hit, met = cases.alnum_words(docs[r.doc_id]), set(), set()
        for name, item in items.items():
            n = min(10, len(item))
            windows = {tuple(item[i : i + n]) for i in range(len(item) - n + 1)} if n else set()
            for i in range(len(words) - n + 1):
                if tuple(words[i : i + n]) in windows:
                    hit |= set(range(i, i + n))
                    met.add(name)
        assert (r.n_words, r.n_hit, r.n_items, r.contaminated) == (len(words), len(hit), len(met), bool(hit))
        assert r.items_sha256 == hashlib.sha256(",".join(sorted(met)).encode()).hexdigest()


@pytest.mark.parametrize("block_words", [6, 10**6])
def test_op5_short_items_and_blocks(spark, block_words):
    random.seed(3)
    words = lambda n: " ".join(random.choices("abcd", k=n))
    items = [(i, words(random.randint(0, 9))) for i in range(9)] + [(None, "a b"), (20, None), (21, "a b c"), (21, "a b c")]
    docs = [(i, words(random.randint(0, 40))) for i in range(60)]
    rules = decontam.LeakRules(window=5, block_words=block_words)
    got = decontam.find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), rules=rules)
    for r in got.collect():
        body, hit, met = dict(docs)[r.doc_id].split(), set(), set()
        for name, item in items:
            item = (item or "").split()
            n = min(5, len(item))
            for i in range(len(body) - n + 1 if n else 0):
                if any(body[i : i + n] == item[j : j + n] for j in range(len(item) - n + 1)):
                    hit |= set(range(i, i + n))
                    met |= {str(name)} if name is not None else set()  # an item without an id hits words, but has no name to list
        assert hit == {k for s in r.hit_ranges for k in range(s.first, s.end)} and sorted(met) == r.hit_items


def test_op5_cuts(spark):
    item = "one two three four five six seven eight nine ten eleven"
    docs = [(1, f"Before it, {item.title()}! and after it " + "more " * 20), (2, item), (3, "clean"), (4, None)]
    got = decontam.decontaminate(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(1, item)], "item_id long, text string"))
    assert {r.doc_id: r.text for r in got.collect()} == {1: "Before it, ! and after it " + "more " * 20, 3: "clean", 4: None}


def test_op6(spark):
    docs = cases.texts(spark)
    want = cases.near_components(docs)
    for r in run(spark, "op6_near_dedup"):
        assert (r.component_id, r.kept, r.n_shingles) == (want[r.doc_id], want[r.doc_id] == r.doc_id, len(cases.shingles(docs[r.doc_id])))


def test_op6_groups_around_the_threshold(spark):
    """Copies with a few words changed: many pairs just above and just below the limit."""
    random.seed(8)
    docs, base = {}, [f"w{k}" for k in range(120)]
    for i in range(300):
        words = list(base)
        for _ in range(random.randint(0, 9)):
            words[random.randrange(len(words))] = f"x{random.randrange(10_000)}"
        docs[i] = " ".join(words[: random.choice([120, 120, 100])])
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in minhash.near_groups(df).collect()}
    assert got == cases.near_components(docs)


def test_sketch_estimates_similarity():
    import numpy as np

    rules = minhash.NearRules()
    seeds = minhash._seeds(256, rules.seed)
    random.seed(5)
    for n in (3, 50, 2000):
        keys = np.array(random.sample(range(1 << 62), 2 * n), np.uint64)
        a, b = minhash.sketch(keys[: n + n // 2], 128, seeds), minhash.sketch(keys[n // 2 :], 128, seeds)
        true = len(set(keys[: n + n // 2]) & set(keys[n // 2 :])) / (2 * n)
        assert abs((a == b).mean() - true) < 0.2


def test_components(spark):
    random.seed(7)
    edges = [(random.randrange(300), random.randrange(300)) for _ in range(220)] + [(k, k + 1) for k in range(1000, 1060)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    got = {r.node: r.label for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for e in edges if e[0] != e[1] for x in e}


def brute_repeats(texts, least):
    bodies = [(t or "").encode() for t in texts]
    seen = Counter(b[i : i + least] for b in bodies for i in range(len(b) - least + 1))
    for b in bodies:
        marks = bytearray(len(b))
        for i in range(len(b) - least + 1):
            if seen[b[i : i + least]] > 1:
                marks[i : i + least] = b"\1" * least
        yield len(b), sum(marks), len(re.findall(b"\1+", bytes(marks))), hashlib.sha256(bytes(x for x, m in zip(b, marks) if not m)).hexdigest()


def test_op8(spark):
    docs = cases.texts(spark)
    want = dict(zip(docs, brute_repeats(docs.values(), 400)))
    assert {r.doc_id: tuple(r)[1:5] for r in run(spark, "op8_suffix_dedup")} == want


@pytest.mark.parametrize("unit_bytes", [30, 300, 30_000])
def test_op8_made(spark, unit_bytes):
    random.seed(unit_bytes)
    parts = ["".join(random.choices("ab ", k=random.randint(10, 60))) for _ in range(4)] + ["x", "é"]
    rows = [(i, None if i % 9 == 8 else "".join(random.choices(parts, k=random.randint(0, 6)))) for i in range(40)] + [(3, "same " * 20)] * 2 + [(None, "same " * 20), (50, "a" * 200)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    rules = suffix_dedup.RepeatRules(least=20, passage=12, gram=8, shard_bytes=100, unit_bytes=unit_bytes, unit_span=50)
    got = suffix_dedup.remove_repeats(df, keep=["doc_id"], rules=rules).collect()
    assert Counter(tuple(r)[:5] for r in got) == Counter((i, *w) for (i, _), w in zip(rows, brute_repeats([t for _, t in rows], 20)))


def test_suffix_arrays():
    import numpy as np

    random.seed(4)
    for _ in range(300):
        k = random.choice([1, 2, 4, 300])
        text = [random.randint(1, k) for _ in range(random.randint(0, 60))] + [0]
        assert suffixes.suffix_array(np.array(text), k + 1).tolist() == sorted(range(len(text)), key=lambda i: text[i:])


def test_op4_planted(spark):
    random.seed(2)
    vocabulary = ["".join(random.choices("abcdefghijklmnop", k=random.randint(2, 8))) for _ in range(3000)]
    words = lambda n: " ".join(random.choices(vocabulary, k=n))
    passages = [words(random.randint(60, 80)) for _ in range(100)]
    rows = [(i, f"{words(random.randint(5, 200))} {passages[i // 2]} {words(random.randint(5, 200))}") for i in range(200)] + [(i, words(300)) for i in range(200, 300)]
    got = {r.doc_id: r for r in chunk_dedup.dedup_chunks(spark.createDataFrame(rows, "doc_id long, text string"), keep=["doc_id"], texts=True).collect()}
    assert sum(got[i].n_shared > 0 for i in range(200)) >= 198
    assert all(got[i].n_removed == 0 for i in range(0, 200, 2)) and all(got[i].n_shared == 0 for i in range(200, 300))
    assert all(got[i].kept_text == dict(rows)[i] for i in range(0, 200, 2))


def test_op4_insertions_shift_nothing():
    import numpy as np

    random.seed(6)
    text = "".join(random.choices("abcdefgh ", k=4000)).encode()
    rules = chunk_dedup.ChunkRules()
    digests = lambda b: chunk_dedup.chunks(np.frombuffer(b, np.uint8), np.array([0, len(b)]), rules)[1].tolist()
    a, b = digests(text), digests(text[:1000] + b"inserted" + text[1000:])
    assert len(set(a) - set(b)) <= 4 and len(a) > 40


def test_op3(spark):
    sizes = {r.doc_id: (r.source, len(cases.blank_words(r.text))) for r in cases.documents(spark).collect()}
    rows = run(spark, "op3_source_mix")
    assert rows and sorted(rows) == sorted(run(spark, "op3_source_mix"))
    total, taken = Counter(), Counter()
    for s, n in sizes.values():
        total[s] += n
    weights = {s: (5, 2, 1)[k % 3] for k, s in enumerate(sorted(total))}
    target, left = {}, set(total)
    while left:
        level = (sum(total.values()) - sum(target.values())) / sum(weights[s] for s in left)
        over = {s for s in left if weights[s] * level > 3 * total[s]}
        target |= {s: 3 * total[s] for s in over} if over else {s: weights[s] * level for s in left}
        left = left - over if over else set()
    for r in rows:
        s = sizes[r.doc_id][0]
        assert r.size == sizes[r.doc_id][1] and r.source_size == total[s] and abs(r.target - target[s]) < 1e-6 and 0 <= r.taken <= 3 * r.size
        taken[s] += r.taken
    assert all(abs(taken[s] - target[s]) <= 16 + 0.002 * target[s] for s in total)


def test_op3_apportionment_is_sainte_lague(spark):
    random.seed(3)
    for blocks in (1, 7, 100, 9999):
        claims = [(k, float(random.randint(1, 1000))) for k in range(12)]
        df = spark.createDataFrame(claims, "place long, claim double")
        got = {r.place: r.seats for r in mixing.apportion(df, [], ["place"], "claim", F.lit(blocks)).collect()}
        want = dict.fromkeys(got, 0)
        for _ in range(blocks):
            k = max(claims, key=lambda c: (c[1] / (2 * want[c[0]] + 1), -c[0]))[0]
            want[k] += 1
        assert got == want


def test_op3_caps(spark):
    rows = [(i, "w " * 10, "small") for i in range(2)] + [(i, "w " * 1000, "z") for i in range(10, 15)] + [(20, "w " * 5, None)]
    got = mixing.mix_sources(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    assert {(r.source_size, round(r.target, 6)) for r in got} == {(20, 60.0), (5000, 4950.0), (5, 15.0)}
    assert all(r.taken == 30 for r in got if r.source_size == 20)


def test_op9_learns(spark):
    documents, labels = cases.documents(spark, "/root/testdata/sf0.1"), spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    model = toxicity.fit_table(documents, labels.filter("doc_id % 3 > 0"))
    got = toxicity.grade_texts(documents, model, keep=["doc_id"]).join(labels.filter("doc_id % 3 = 0").withColumnRenamed("toxic", "labelled"), "doc_id")
    rows = Counter((r.labelled, r.toxic) for r in got.collect())
    assert rows[0, True] <= 0.01 * (rows[0, True] + rows[0, False]) and rows[1, True] >= 0.85 * (rows[1, True] + rows[1, False])
    assert (model.thresholds[1:] >= model.thresholds[:-1]).all()


def test_op1_written_rules():
    rule = lambda url: url_rules.written_rule(*url_rules.split_url(url)[:2], url_rules.WRITTEN)
    assert rule("http://a.Example.ORG/es/1?x") == ("block", "example.org/es/") and rule("x://example.org/en/12") == ("block", "example.org/en/1") and rule("x://b.org/en") == ("allow", "org/")
    assert rule("x://borg/") is None and rule("x://a.com/fr/") == ("allow", "com/fr/") and rule("x://a.org") is None and rule(None) is None and rule("a.org/") is None
    assert url_rules.split_url("h://A.b/C?d/e") == ("a.b", "/C", "?d/e") and url_rules.split_url("h://a#b/c") == ("a", "", "#b/c")


def brute_rules(urls, bad, least, confidence, gain):
    """All combinations of tokens, counted one by one; tokens of the very same URLs are one, named by the least."""
    rows = [set(url_rules.url_tokens(*url_rules.split_url(u))) for u in urls]
    where = {}
    for i, tokens in enumerate(rows):
        for t in tokens:
            where.setdefault(t, set()).add(i)
    names = {}
    for t, at in sorted(where.items()):
        if len(at) >= least:
            names.setdefault(frozenset(at), t)
    items = set(names.values())
    freq, both = Counter(), Counter()
    for tokens, wrong in zip(rows, bad):
        have = sorted(tokens & items)
        for n in range(1, len(have) + 1):
            for some in combinations(have, n):
                freq[some] += 1
                both[some] += wrong
    known = {s: both[s] / freq[s] for s in freq if both[s] >= least}
    good = {s: c for s, c in known.items() if c >= confidence}
    inner = lambda s: max((good[p] for n in range(1, len(s)) for p in combinations(s, n) if p in good), default=0)
    return {s: c for s, c in good.items() if not inner(s) or c >= inner(s) + gain}


def made_pages(n):
    """URLs of many tokens, deep hosts and long queries; those of a farm, and those of two tokens together, are bad."""
    random.seed(1)
    pages, bad = [], []
    for i in range(n):
        farm, host, q = i % 4 == 0, random.choice(["news.a.b.c.d", "blog"]), random.choice("xyz")
        pages.append((i, f"https://{'spam-farm' if farm else host}.host{i % 3}.net/en/{'/'.join('abcdefghijklmnopq'[: i % 17])}/{i}?{q}=1&k=2"))
        bad.append(bool(farm or (host == "blog" and q == "z") or i % 29 == 0))
    return pages, bad


def test_op1_mines(spark):
    pages, bad = made_pages(240)
    rules = url_rules.UrlRules(min_support=0.1, min_count=5)
    labels = [(i, int(not b), 0) for i, b in enumerate(bad)]
    mined = url_rules.mine(spark.createDataFrame(pages, "page_id long, url string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), F.expr("quality = 0"), rules=rules)
    mined = [(tuple(r.tokens), r.confidence) for r in mined.collect()]
    assert {t: round(c, 9) for t, c in mined} == {t: round(c, 9) for t, c in brute_rules([u for _, u in pages], bad, 24, rules.min_confidence, rules.min_gain).items()}
    assert any("label:spam-farm" in t for t, _ in mined) and any(len(t) > 1 for t, _ in mined)
    index = url_rules.Index(mined)
    for _, url in pages:
        tokens = url_rules.url_tokens(*url_rules.split_url(url))
        brute = [(c, " & ".join(sorted(t))) for t, c in mined if set(t) <= set(tokens)]
        assert index.match(tokens) == (min(brute, key=lambda b: (-b[0], b[1])) if brute else None)


def test_op1_joined_rules_judge_alike(spark):
    """Rules that are too many for one index meet the URLs in a join, with the same results."""
    pages, bad = made_pages(120)
    df = spark.createDataFrame([*pages, (900, None), (901, "nothing"), (0, pages[0][1])], "page_id long, url string").withColumn("host", F.lit("own"))
    mined = [(t, c) for t, c in brute_rules([u for _, u in pages], bad, 12, 0.6, 0.02).items()]
    one, two = (sorted(map(tuple, url_rules.judge_urls(df, mined, rules=url_rules.UrlRules(broadcast_rules=n)).collect()), key=repr) for n in (0, 1000))
    assert one == two and len(one) == 123 and any(r[-1] for r in one)


def test_op1_query(spark):
    urls = {r.page_id: r.url for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    for r in run(spark, "op1_url_filter"):
        host, path, _ = url_rules.split_url(urls[r.page_id])
        fixed = url_rules.written_rule(host, path, url_rules.WRITTEN)
        assert (r.host, r.path) == (host, path) and (r.verdict, r.rule) == (fixed or (r.verdict, None)) and r.verdict in ("allow", "block")


def brute_links(text, rules=secrets.LinkRules()):
    """Every weak part against every other part of its scope."""
    base = secrets.base_spans(text, rules)
    weak = [(m.start(), k, m.end()) for k, (_, p) in secrets.WEAK.items() for m in p.finditer(text) if all(h.search(m[0]) for h in secrets.HOLDS.get(k, ()))]
    weak = [w for w in weak if not any(b[0] < w[2] and w[0] < b[2] for b in base)]
    scope = lambda at: len([m for m in re.finditer(r"\n[\x20\t]*\n", text) if m.end() <= at])
    role = lambda k: secrets.ROLES.get(k) or secrets.WEAK[k][0]
    needs = {"identifier": ("secret",), "secret": ("identifier",), "endpoint": ("identifier", "secret")}
    near = lambda a, b: b[2] >= a[0] - rules.reach and b[0] <= a[2] + rules.reach and not (b[0] < a[2] and a[0] < b[2])
    return sorted(w for w in weak if all(any(role(p[1]) == n and scope(p[0]) == scope(w[0]) and near(w, p) for p in [*base, *weak]) for n in needs[role(w[1])]))


def test_op2_links_like_brute_force():
    random.seed(6)
    token = lambda n: "".join(random.choices("abcXYZ0189+/", k=n - 2)) + "A1"
    found = 0
    for _ in range(300):
        parts = ["client_id = user-77", f"login: {'n' * random.randint(3, 90)}", token(32), token(65), token(120) + "==", "x" * 40, "https://api.example.com:8443", f"redis://{'h' * random.randint(3, 300)}", "password: hunter22", "f" * 30, "AKIA" + "Q" * 20, "\n\n", "word " * random.randint(1, 30)]
        text = " ".join(random.choices(parts, k=random.randint(1, 14)))
        base = secrets.base_spans(text)
        got = secrets.linked_spans(text, base)
        assert got == brute_links(text)
        found += len(got)
    assert found > 100


@pytest.mark.parametrize("n", [64, 65, 254, 5000])
def test_op2_takes_parts_of_any_length(n):
    for client, opaque, host in ((n, 12, 9), (9, n, 9), (9, 12, n)):
        text = f"at https://{'h' * host}.net:8080 client_id={'i' * client} key {'aB3' * opaque}"
        spans = secrets.linked_spans(text, secrets.base_spans(text))
        want = [("endpoint", 8 + host + 9), ("client", 10 + client), ("opaque", 3 * opaque)]
        assert [(k, e - s) for s, k, e in spans] == (want if client < 200 else want[1:])  # an endpoint needs the secret near it


def brute_chunks(body, rules):
    """Cuts and chunks of one text, byte by byte."""
    import numpy as np

    from cubiform.llm import textcore as tc

    with np.errstate(over="ignore"):
        values = [int(v) for v in tc.mix((np.arange(256, dtype=np.uint64) + np.uint64(rules.seed)) * np.uint64(0x9E3779B97F4A7C15))]
    hashes = []
    for i in range(len(body)):
        h = sum(values[body[i - k]] << k for k in range(min(i + 1, 1 << rules.window_steps))) & (1 << 64) - 1
        hashes.append(int(tc.mix(np.array([h], np.uint64))[0]))
    cuts, reach = [], rules.reach
    for i in range(reach, len(body) - reach):
        if all(hashes[i] <= h for h in hashes[i - reach : i + reach + 1]) and all(hashes[i] < h for h in hashes[i - reach : i]):
            cuts.append(i + 1)
    edges = [0, *cuts, len(body)] if body else []
    return [body[a:b] for a, b in zip(edges, edges[1:])]


def test_op4_against_brute_force(spark):
    """Chunks, owners, what is shared and what goes, one document after the other."""
    random.seed(3)
    rules = chunk_dedup.ChunkRules()
    words = lambda n: " ".join("".join(random.choices("abcdefghij é", k=random.randint(2, 9))) for _ in range(n))
    passages = [words(70) for _ in range(6)]
    rows = [(i, " ".join([words(random.randint(0, 60)), random.choice(passages), words(random.randint(0, 30)), random.choice(passages)])) for i in range(40)]
    rows += [(100, "short"), (101, "short"), (102, ""), (103, None), (104, passages[0]), (105, passages[0]), (106, "z" * 3000), (107, "q" * 500 + "q" * 500)]
    chunks = {i: brute_chunks((t or "").encode(), rules) for i, t in rows}
    total, owner = Counter(), {}
    for i in sorted(chunks):
        total.update(chunks[i])
        for c in chunks[i]:
            owner.setdefault(c, i)
    want = {}
    for i, listed in chunks.items():
        repeat = [total[c] > 1 for c in listed]
        elsewhere = [total[c] > 1 and owner[c] != i for c in listed]
        first = [c not in listed[:k] for k, c in enumerate(listed)]
        whole = bool(listed) and (all(elsewhere) or (all(first) and not any(elsewhere)))
        k = 0
        while k < len(listed):
            end = k
            while end < len(listed) and repeat[end] == repeat[k]:
                end += 1
            if repeat[k] and sum(map(len, listed[k:end])) < rules.least_run and not (whole and end - k == len(listed)):
                repeat[k:end] = [False] * (end - k)
            k = end
        gone = [r and (e or not f) for r, e, f in zip(repeat, elsewhere, first)]
        left = b"".join(c for c, g in zip(listed, gone) if not g)
        size = lambda marks: sum(len(c) for c, m in zip(listed, marks) if m)
        want[i] = (sum(map(len, listed)), len(listed), size(repeat), size(gone), hashlib.sha256(left).hexdigest())
    got = chunk_dedup.dedup_chunks(spark.createDataFrame(rows, "doc_id long, text string"), keep=["doc_id"]).collect()
    assert {r.doc_id: (r.n_bytes, r.n_chunks, r.n_shared, r.n_removed, r.kept_sha256) for r in got} == want
    assert sum(w[3] > 0 for w in want.values()) > 20


def test_op9_grades_like_plain_sums(spark):
    """Each text's features counted one by one; the model is the fitted one."""
    import numpy as np

    from cubiform.llm import textcore as tc

    documents, labels = cases.documents(spark), spark.read.parquet(f"{SF}/labels.parquet")
    rules = toxicity.ToxicityRules(least_z=2.0)
    model = toxicity.fit_table(documents, labels, rules=rules)
    used = {int(i): float(model.weights[i]) for i in np.flatnonzero(model.weights)}
    assert used

    def slot(piece, salt):
        data = np.frombuffer(piece, np.uint8)
        h = tc.spans(tc.running(data), np.array([0]), np.array([len(piece)]))
        return int((tc.mix(h + np.uint64(salt)) if salt else h)[0] >> np.uint64(64 - rules.bits))

    cache = {}
    for r in toxicity.grade_texts(documents, model, keep=["doc_id", "text"], rules=rules).filter("doc_id % 5 = 0").collect():
        words = [w.encode() for w in cases.alnum_words(r.text)]
        counts = Counter()
        for w in words:
            for piece, salt in [(w, 0), *((w[:k], k) for k in rules.prefixes if len(w) > k)]:
                if (piece, salt) not in cache:
                    cache[piece, salt] = slot(piece, salt)
                counts[cache[piece, salt]] += 1
        score = sum(used.get(s, 0.0) * n * 50.0 / (len(words) + 50.0) for s, n in counts.items())
        above = [1 / (1 + np.exp(-np.clip(score - t, -30, 30))) for t in model.thresholds]
        assert abs(r.severity - sum(above)) < 1e-9 and r.toxic == (above[0] >= rules.limit)


def test_longest_shared():
    random.seed(12)
    for _ in range(60):
        pieces = ["".join(random.choices("ab", k=random.randint(1, 30))).encode() for _ in range(random.randint(1, 8))]
        starts = [random.randint(0, len(p)) for p in pieces]
        places = [(k, i) for k, n in enumerate(starts) for i in range(n)]
        agree = lambda x, y: next((n for n, (a, b) in enumerate(zip(x, y)) if a != b), min(len(x), len(y)))
        want = [max((agree(pieces[k][i:], pieces[l][j:]) for l, j in places if (l, j) != (k, i)), default=0) for k, i in places]  # noqa: E741
        assert suffixes.longest_shared(pieces, starts).tolist() == want if places else True
