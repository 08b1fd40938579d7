"""SQL for the queries that SQL can express; the others are tested against brute force."""

from __future__ import annotations

from . import pii
from .mixing import Mix
from .repetition import QualityRules

_WORD = r"[^\x20\x09-\x0D]+"
_ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _folded(text: str) -> str:
    return f"translate(coalesce({text}, ''), '{_UPPER}', '{_LOWER}')"


def op3(mix: Mix = Mix()) -> str:
    weights = f"list_extract([{', '.join(map(str, mix.weights))}], CAST(place % {len(mix.weights)} + 1 AS BIGINT))"
    return f"""WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{_WORD}')) AS size, md5(concat_ws(':', '{mix.seed}', coalesce(CAST(doc_id AS VARCHAR), ''), md5(coalesce(text, '')))) AS o FROM documents),
 s1 AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
 s2 AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place FROM s1), s3 AS (SELECT *, {weights} AS weight FROM s2),
 s4 AS (SELECT *, sum(source_size) OVER () - coalesce(sum({mix.max_repeat} * source_size) OVER w, 0) AS lw, sum(weight) OVER () - coalesce(sum(weight) OVER w, 0) AS lt FROM s3 WINDOW w AS (ORDER BY source_size / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
 s5 AS (SELECT *, lw * weight > {mix.max_repeat} * source_size * lt AS capped FROM s4),
 s6 AS (SELECT *, CASE WHEN capped THEN CAST({mix.max_repeat} * source_size AS DOUBLE) ELSE weight * CAST((SELECT arg_min(lw, (source_size / weight, place)) FROM s5 WHERE NOT capped) AS DOUBLE) / CAST((SELECT arg_min(lt, (source_size / weight, place)) FROM s5 WHERE NOT capped) AS DOUBLE) END AS target FROM s5),
 seats AS (SELECT place, count(*) AS seats FROM (SELECT place, row_number() OVER (ORDER BY target / (2 * k - 1) DESC, place, k) AS r FROM (SELECT place, target, unnest(range(1, CAST(target / {mix.block_tokens} + 50 AS BIGINT))) AS k FROM s6) AS a) AS b WHERE r <= (SELECT round(sum(target) / {mix.block_tokens}) FROM s6) GROUP BY place),
 s7 AS (SELECT s6.*, coalesce(seats, 0) AS seats, CAST(greatest(ceil(source_size / {float(mix.shard_tokens)}), 1) AS BIGINT) AS shards FROM s6 LEFT JOIN seats USING (place)),
 e AS (SELECT d.*, s7.* EXCLUDE (source), CAST('0x' || substr(o, 1, {mix.cell_digits}) AS BIGINT) * shards // {16**mix.cell_digits} AS shard FROM d JOIN s7 ON d.source IS NOT DISTINCT FROM s7.source),
 hg AS (SELECT place, shard // {mix.group_shards} AS grp, any_value(seats) AS n, sum(size) AS gw FROM e GROUP BY ALL),
 qg AS (SELECT place, grp, count(*) AS seats FROM (SELECT *, row_number() OVER (PARTITION BY place ORDER BY CAST(gw AS DOUBLE) / (2 * k - 1) DESC, grp, k) AS r FROM (SELECT *, unnest(range(1, n + 1)) AS k FROM hg WHERE gw > 0) AS a) AS b WHERE r <= n GROUP BY place, grp),
 h AS (SELECT s.place, s.shard, s.sw, coalesce(qg.seats, 0) AS n FROM (SELECT place, shard, sum(size) AS sw FROM e GROUP BY place, shard) AS s LEFT JOIN qg ON qg.place = s.place AND qg.grp = s.shard // {mix.group_shards}),
 q AS (SELECT place, shard, count(*) AS seats FROM (SELECT *, row_number() OVER (PARTITION BY place, shard // {mix.group_shards} ORDER BY CAST(sw AS DOUBLE) / (2 * k - 1) DESC, shard, k) AS r FROM (SELECT *, unnest(range(1, n + 1)) AS k FROM h WHERE sw > 0) AS a) AS b WHERE r <= n GROUP BY place, shard),
 f AS (SELECT e.*, h.sw, least(coalesce(q.seats, 0) * {mix.block_tokens}, {mix.max_repeat} * h.sw) AS quota, sum(size) OVER (PARTITION BY e.place, e.shard ORDER BY o, size ROWS UNBOUNDED PRECEDING) AS till FROM e JOIN h USING (place, shard) LEFT JOIN q USING (place, shard))
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target, CAST(quota // greatest(sw, 1) * size + greatest(least(till, quota - quota // greatest(sw, 1) * sw) - (till - size), 0) AS BIGINT) AS taken FROM f"""


OP5 = f"""WITH d AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all({_folded('text')}, '{_ALNUM}') AS w FROM documents),
 b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all({_folded('text')}, '{_ALNUM}') AS w FROM benchmark),
 iw AS (SELECT DISTINCT item, n, array_to_string(w[i:i + n - 1], ' ') AS win FROM (SELECT item, w, least(10, len(w)) AS n, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM b WHERE len(w) > 0) AS t),
 dw AS (SELECT r, i, n, array_to_string(w[i:i + n - 1], ' ') AS win FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM iw) AS ns WHERE len(w) >= n) AS t),
 met AS (SELECT r, i, n, item FROM dw JOIN iw USING (n, win)),
 hit AS (SELECT r, count(DISTINCT j) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS j FROM met) AS t GROUP BY r),
 its AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT r, item FROM met WHERE item IS NOT NULL) AS t GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated FROM d LEFT JOIN hit USING (r) LEFT JOIN its USING (r)"""

OP6 = f"""WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_folded('text')}, '{_WORD}') AS w FROM documents),
 sh AS (SELECT DISTINCT doc_id, hash(s) AS s FROM (SELECT doc_id, array_to_string(w[i:i + 4], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM d WHERE len(w) > 0) AS t) AS u),
 n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
 links AS (SELECT x AS a, y AS b FROM (SELECT p.doc_id AS x, q.doc_id AS y, count(*) AS k FROM sh AS p JOIN sh AS q ON p.s = q.s AND p.doc_id <> q.doc_id GROUP BY ALL) AS t JOIN n AS nx ON nx.doc_id = x JOIN n AS ny ON ny.doc_id = y WHERE 100 * k >= 75 * (nx.n + ny.n - k)),
 reach(a, b) AS (SELECT doc_id, doc_id FROM d UNION SELECT r.a, l.b FROM reach AS r JOIN links AS l ON r.b = l.a)
SELECT doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, c.m AS component_id, doc_id = c.m AS kept FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT a, min(b) AS m FROM reach GROUP BY a) AS c ON c.a = doc_id"""


def op7(rules: QualityRules = QualityRules()) -> str:
    def covered(n: int) -> str:
        return (
            f"SELECT r, count(*) FILTER (inside) AS words_{n}, coalesce(sum(length(x)) FILTER (inside), 0) AS chars_{n} FROM (SELECT r, x, bool_or(twice) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) AS inside FROM "
            f"(SELECT r, i, x, i <= m - {n - 1} AND count(*) OVER (PARTITION BY r, i <= m - {n - 1}, hash(g)) > 1 AS twice FROM (SELECT r, i, m, w[i] AS x, array_to_string(w[i:i + {n - 1}], ' ') AS g FROM p) AS a) AS b) AS c GROUP BY r"
        )

    lengths = [n for n, _ in rules.coverage]
    grams = ", ".join(f"g{n} AS ({covered(n)})" for n in sorted({5, *lengths}))
    joins = " ".join(f"LEFT JOIN g{n} USING (r)" for n in sorted({5, *lengths}))
    limits = " AND ".join(f"100 * coalesce(chars_{n}, 0) <= {most} * word_chars" for n, most in rules.coverage)
    failed = f"n_words < {rules.min_words} OR 100 * coalesce(words_5, 0) > {rules.max_repeat_word_percent} * n_words"
    return f"""WITH d AS (SELECT doc_id, row_number() OVER () AS r, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS w FROM documents),
 p AS (SELECT r, w, len(w) AS m, unnest(range(1, len(w) + 1)) AS i FROM d), {grams},
 l AS (SELECT r, sum(c - 1) AS n_dup_lines, sum((c - 1) * length(regexp_replace(x, '[\\x20\\x09-\\x0D]', '', 'g'))) AS dup_line_chars FROM (SELECT r, x, count(*) AS c FROM (SELECT r, unnest(string_split(t, chr(10))) AS x FROM d) AS u WHERE regexp_matches(x, '{_WORD}') GROUP BY r, x) AS v GROUP BY r),
 f AS (SELECT d.*, len(w) AS n_words, length(regexp_replace(t, '[\\x20\\x09-\\x0D]', '', 'g')) AS word_chars, len(regexp_extract_all(t, '[#*$%&|<>]')) AS n_symbols FROM d)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, CAST(coalesce(n_dup_lines, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(words_5, 0) AS BIGINT) AS n_repeat_words, CAST(coalesce(dup_line_chars, 0) AS BIGINT) AS dup_line_chars,
 {failed} AS base_failed, NOT ({failed}) AND {limits} AND 100 * coalesce(dup_line_chars, 0) <= {rules.max_dup_line_percent} * word_chars AND 100 * n_symbols <= {rules.max_symbols_percent} * n_words AS kept FROM f {joins} LEFT JOIN l USING (r)"""


def op10(rules: pii.PiiRules = pii.PiiRules()) -> str:
    """Positions from the pieces between matches; the patterns in their plain forms."""
    patterns = pii.PLAIN | {"iban": r"\b[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}\b", "ssn": "[0-9-]+"}
    value = "CASE WHEN c BETWEEN '0' AND '9' THEN CAST(c AS INT) ELSE ascii(c) - 55 END"
    bare = "replace(m, ' ', '')"
    luhn = "list_sum(list_transform(range(0, length(g)), lambda i: CASE WHEN i % 2 = 0 THEN CAST(substr(g, length(g) - i, 1) AS INT) ELSE 2 * CAST(substr(g, length(g) - i, 1) AS INT) - CASE WHEN CAST(substr(g, length(g) - i, 1) AS INT) > 4 THEN 9 ELSE 0 END END)) % 10 = 0"
    near = f"substr(t, greatest(a - {rules.context_chars}, 0) + 1, b - greatest(a - {rules.context_chars}, 0) + {rules.context_chars})"
    confirmed = {
        "email": "TRUE", "ip": "len(list_filter(string_split(m, '.'), lambda x: NOT (length(ltrim(x, '0')) < 3 OR (length(ltrim(x, '0')) = 3 AND ltrim(x, '0') <= '255')))) = 0",
        "card": f"length(g) BETWEEN 16 AND 19 AND {luhn}", "phone": "length(g) BETWEEN 8 AND 15",
        "iban": f"length({bare}) BETWEEN 15 AND 34 AND list_reduce(list_prepend(0, list_transform(string_split(substr({bare}, 5) || substr({bare}, 1, 4), ''), lambda c: {value})), lambda x, y: (x * CASE WHEN y > 9 THEN 100 ELSE 10 END + y) % 97) = 1",
        "ssn": f"regexp_full_match(m, '[0-9]{{3}}-[0-9]{{2}}-[0-9]{{4}}') AND regexp_matches({near}, '(?i)\\b(?:{dict(rules.context)['ssn']})\\b')",
    }
    size = lambda part, i: f"coalesce(list_sum(list_transform({part}[1:{i}], lambda x: length(x))), 0)"
    kinds = " UNION ALL ".join(
        f"SELECT r, {rank} AS rank, '{k}' AS kind, a, b FROM (SELECT *, a + length(m) AS b, regexp_replace(m, '[^0-9]', '', 'g') AS g FROM (SELECT r, t, f[i] AS m, CAST({size('p', 'i')} + {size('f', 'i - 1')} AS BIGINT) AS a FROM "
        f"(SELECT r, t, f, p, unnest(range(1, len(f) + 1)) AS i FROM (SELECT r, t, regexp_extract_all(t, '{x}') AS f, string_split_regex(t, '{x}') AS p FROM d) AS q) AS u) AS v) AS y WHERE {confirmed[k]}"
        for rank, (k, x) in enumerate(patterns.items())
    )
    counts = ", ".join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in pii.BASE)
    text = "kind || ':' || CAST(a AS BIGINT) || ':' || CAST(b AS BIGINT)"
    return f"""WITH d AS (SELECT doc_id, row_number() OVER () AS r, coalesce(text, '') AS t FROM documents), s AS ({kinds}),
 c AS (SELECT r, {counts}, string_agg({text}, ',' ORDER BY rank, a) FILTER (rank < {len(pii.BASE)}) AS base, string_agg({text}, ',' ORDER BY rank, a) AS spans FROM s GROUP BY r)
SELECT doc_id, {', '.join(f'CAST(coalesce(n_{k}, 0) AS BIGINT) AS n_{k}' for k in pii.BASE)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN c USING (r)"""


ORACLES = {"op3_source_mix": op3(), "op5_decontaminate": OP5, "op6_near_dedup": OP6, "op7_quality_rules": op7(), "op10_pii": op10()}
