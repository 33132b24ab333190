"""DuckDB SQL of the queries that SQL can express, over the test tables.

It is written from the contracts: plain patterns instead of the linear ones, all
pairs instead of hashing, and recursion instead of star steps. Training, hashing,
tokenizing, scheduling and cutting into shards have no SQL; ``tests/llm`` holds
them against brute force, exact tokenizers and held-out accuracy.
"""

from __future__ import annotations

# The contract's patterns, phrases and words, and the templates.
PII_PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "ssn": r"[0-9-]+",
}
PII_SCORES = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.6, "ssn": 0.3}
PII_CONTEXT = {
    "email": r"\b(e-?mail|contact|write to|mailto)\b",
    "ip": r"\b(ip|address|host|server|login)\b",
    "card": r"\b(card|visa|mastercard|amex|credit|payment)\b",
    "phone": r"\b(phone|tel|telephone|call|mobile|fax)\b",
    "ssn": r"\b(ssn|social security|tax id)\b",
}
LICENSE_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
LICENSE_TEXTS = (
    ("mit", True, "under the mit license"),
    ("apache-2", True, "apache license version 2"),
    ("cc-by-nc", True, "cc by nc"),
    ("mit", False, "released under the mit license"),
    ("mit", False, "permission is hereby granted free of charge to any person obtaining a copy of this software "
                   "and associated documentation files the software to deal in the software without restriction"),
    ("apache-2", False, "licensed under the apache license version 2 0"),
    ("cc-by-nc", False, "licensed under cc by nc 4 0"),
    ("gpl-3", False, "this work is licensed under the gnu general public license version 3"),
    ("bsd-3", False, "redistribution and use in source and binary forms with or without modification are permitted "
                     "provided that the following conditions are met"),
)


def _lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _luhn(d: str) -> str:
    each = (f"list_transform(range(1, length({d}) + 1), lambda i: CAST(substr(reverse({d}), CAST(i AS INTEGER), 1) AS INTEGER) "
            f"* (2 - CAST(i % 2 AS INTEGER)))")
    return f"list_sum(list_transform({each}, lambda x: CASE WHEN x > 9 THEN x - 9 ELSE x END)) % 10 = 0"


def op1_sql() -> str:
    """All kinds but ``iban``: a pattern without look-behind cannot place it, and no
    text of the test tables holds one; ``tests/llm`` has its own test."""
    digits = "regexp_replace(m, '[^0-9]', '', 'g')"
    rules = {
        "email": "TRUE",
        "ip": "list_bool_and(list_transform(string_split(m, '.'), lambda x: length(ltrim(x, '0')) <= 3 "
              "AND coalesce(try_cast(ltrim(x, '0') AS INTEGER), 0) <= 255))",
        "card": f"length({digits}) BETWEEN 12 AND 19 AND {_luhn(digits)}",
        "phone": f"length({digits}) BETWEEN 9 AND 15",
        "ssn": r"regexp_full_match(m, '[0-9]{3}-[0-9]{2}-[0-9]{4}') AND NOT regexp_matches(m, '^(000|666|9)|-00-|-0000$')",
    }
    arms = []
    for rank, (kind, pattern) in enumerate(PII_PATTERNS.items()):
        p = _lit(pattern)
        arms.append(
            f"SELECT n, t, '{kind}' AS kind, {rank} AS rank, m, list_sum([length(x) for x in gaps[1:k]]) + "
            f"coalesce(list_sum([length(x) for x in found[1:k - 1]]), 0) AS s FROM (SELECT n, t, gaps, found, k, found[k] AS m FROM "
            f"(SELECT n, t, string_split_regex(t, {p}) AS gaps, regexp_extract_all(t, {p}, 0) AS found FROM d), "
            f"range(1, len(found) + 1) r(k)) WHERE {rules[kind]}")
    score = "CASE kind " + " ".join(
        f"WHEN '{k}' THEN {v} + CASE WHEN regexp_matches(before, {_lit(PII_CONTEXT[k])}) THEN 0.3 ELSE 0.0 END"
        for k, v in PII_SCORES.items()) + " END"
    base = "('email', 'ip', 'card', 'phone')"
    span = "kind || ':' || CAST(s AS BIGINT) || ':' || CAST(s + length(m) AS BIGINT)"
    join = lambda cond: f"coalesce(string_agg({span}, ',' ORDER BY s, rank) FILTER (WHERE {cond}), '')"
    return (
        f"WITH d AS (SELECT row_number() OVER () AS n, doc_id, coalesce(text, '') AS t FROM documents), "
        f"f AS ({' UNION ALL '.join(arms)}), "
        f"c AS (SELECT *, least(CAST({score} AS DOUBLE), 1.0) AS score FROM (SELECT *, lower(substr(t, "
        f"CAST(greatest(s - 40, 0) + 1 AS BIGINT), CAST(s - greatest(s - 40, 0) AS BIGINT))) AS before FROM f)), "
        f"g AS (SELECT * FROM c WHERE kind IN {base} OR (score >= 0.5 AND NOT EXISTS (SELECT 1 FROM c b WHERE b.n = c.n "
        f"AND b.kind IN {base} AND b.s < c.s + length(c.m) AND c.s < b.s + length(b.m)))) "
        f"SELECT any_value(doc_id) AS doc_id, "
        + ", ".join(f"CAST(count(CASE WHEN kind = '{k}' THEN 1 END) AS BIGINT) AS n_{k}" for k in ("email", "ip", "card", "phone"))
        + f", sha256({join(f'kind IN {base}')}) AS base_sha256, {join('kind IS NOT NULL')} AS spans, max(score) AS top_score "
        f"FROM d LEFT JOIN g USING (n) GROUP BY n")


def op3_sql() -> str:
    return (
        r"WITH RECURSIVE d AS (SELECT row_number() OVER () AS n, doc_id, "
        r"[x for x in string_split_regex(lower(coalesce(text, '')), '\s+') if x <> ''] AS w FROM documents), "
        "s AS (SELECT n, doc_id, CASE WHEN len(w) > 0 THEN list_sort(list_distinct([array_to_string(w[i:i + 4], ' ') "
        "for i in range(1, greatest(len(w) - 4, 1) + 1)])) END AS g FROM d), "
        "c AS (SELECT row_number() OVER () AS c, g, len(g) AS size, count(*) AS copies, min(doc_id) AS least FROM s "
        "WHERE g IS NOT NULL GROUP BY g), "
        "u AS (SELECT c, hash(x) AS x FROM (SELECT c, unnest(g) AS x FROM c)), "
        "p AS (SELECT a.c AS a, b.c AS b, count(*) AS shared FROM u a JOIN u b ON a.x = b.x AND a.c < b.c GROUP BY ALL), "
        "l AS (SELECT p.a, p.b FROM p JOIN c x ON p.a = x.c JOIN c y ON p.b = y.c WHERE 5 * shared >= 4 * (x.size + y.size - shared)), "
        "e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l), "
        "r(c, root) AS (SELECT c, c FROM c UNION SELECT e.b, r.root FROM r JOIN e ON r.c = e.a), "
        "m AS (SELECT r.c, min(least) AS component FROM r JOIN c k ON r.root = k.c GROUP BY r.c), "
        "k AS (SELECT e.a AS c, sum(copies) AS near FROM e JOIN c ON e.b = c.c GROUP BY e.a) "
        "SELECT s.doc_id, coalesce(c.least, s.doc_id) AS class_id, "
        "CAST(CASE WHEN s.g IS NULL THEN 0 ELSE copies - 1 + coalesce(near, 0) END AS BIGINT) AS n_links, "
        "coalesce(component, s.doc_id) AS component_id, coalesce(component, s.doc_id) = s.doc_id AS kept "
        "FROM s LEFT JOIN c ON s.g = c.g LEFT JOIN m ON c.c = m.c LEFT JOIN k ON c.c = k.c")


def op4_sql() -> str:
    grams = []
    for tid, (label, phrase, text) in enumerate(LICENSE_TEXTS):
        w = text.split()
        grams += [f"({tid}, {_lit(label)}, {phrase}, {len(w) - 2}, {i}, {_lit(w[i])}, {_lit(w[i + 1])}, {_lit(w[i + 2])})"
                  for i in range(len(w) - 2)]
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    labels = lambda cond: (f"coalesce(array_to_string(list_sort(list_distinct(list(label) FILTER (WHERE {cond}))), ','), '')")
    return (
        f"WITH t(tid, label, phrase, n_grams, tpos, a, b, c) AS (VALUES {', '.join(grams)}), "
        f"d AS (SELECT row_number() OVER () AS n, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{lower}'), "
        f"{_lit(LICENSE_WORD)}) AS w FROM documents), "
        f"p AS (SELECT n, unnest(range(0, len(w) - 2)) AS pos, unnest(w[1:len(w) - 2]) AS a, unnest(w[2:len(w) - 1]) AS b, "
        f"unnest(w[3:]) AS c FROM d WHERE len(w) >= 3), "
        f"v AS (SELECT n, tid, label, phrase, n_grams, tpos, pos, pos - tpos AS diag FROM p JOIN t USING (a, b, c)), "
        f"g AS (SELECT *, CASE WHEN phrase OR diag - lag(diag) OVER (PARTITION BY n, tid ORDER BY diag) > 2 THEN 1 ELSE 0 END AS new "
        f"FROM (SELECT n, tid, label, phrase, n_grams, diag, list(DISTINCT tpos) AS ts, min(pos) AS lo FROM v GROUP BY ALL)), "
        f"s AS (SELECT *, sum(new) OVER (PARTITION BY n, tid ORDER BY diag) AS span FROM g), "
        f"x AS (SELECT n, tid, label, phrase, span, len(list_distinct(flatten(list(ts)))) / n_grams AS cover, min(lo) AS lo "
        f"FROM s GROUP BY n, tid, label, phrase, n_grams, span) "
        f"SELECT any_value(doc_id) AS doc_id, CAST(any_value(len(w)) AS BIGINT) AS n_words, "
        f"CAST(count(CASE WHEN phrase AND cover = 1 THEN 1 END) AS BIGINT) AS n_base, "
        f"CAST(min(CASE WHEN phrase AND cover = 1 THEN lo END) AS BIGINT) AS first_word, "
        f"CAST(max(CASE WHEN phrase AND cover = 1 THEN lo END) AS BIGINT) AS last_word, "
        f"{labels('phrase AND cover = 1')} AS base_labels, {labels('(phrase AND cover = 1) OR (NOT phrase AND cover >= 0.6)')} AS labels, "
        f"coalesce(max(cover), 0.0) AS score FROM d LEFT JOIN x USING (n) GROUP BY n")


def op6_sql() -> str:
    size = lambda v: f"sqrt(list_dot_product({v}.e, {v}.e))"
    return (
        "WITH RECURSIVE v AS (SELECT row_number() OVER () AS n, vec_id, label, CASE WHEN len(list_filter(embedding, lambda x: x IS NULL "
        "OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0 THEN CAST(embedding AS DOUBLE[]) END AS e FROM embeddings), "
        f"l AS (SELECT a.n AS a, b.n AS b FROM v a JOIN v b ON a.label = b.label AND a.n <> b.n AND len(a.e) = len(b.e) "
        f"AND list_dot_product(a.e, b.e) / ({size('a')} * {size('b')}) >= 0.93), "
        "r(n, root) AS (SELECT n, n FROM v UNION SELECT l.b, r.root FROM r JOIN l ON r.n = l.a), "
        "m AS (SELECT r.n, min(x.vec_id) AS component FROM r JOIN v x ON r.root = x.n GROUP BY r.n), "
        "k AS (SELECT a AS n, count(*) AS links FROM l GROUP BY a) "
        "SELECT vec_id, CAST(coalesce(links, 0) AS BIGINT) AS n_links, component AS component_id, "
        "component IS NOT DISTINCT FROM vec_id AS kept FROM v LEFT JOIN m USING (n) LEFT JOIN k USING (n)")


def op11_sql() -> str:
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return (
        "WITH RECURSIVE t AS (SELECT i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, k: "
        "CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) AS v FROM range(256) x(i)), "
        f"o AS (SELECT doc_id, w, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(translate(text, '{upper}', '{lower}'), "
        "'[a-zA-ZÀ-ÿ]+')) AS w FROM documents) GROUP BY ALL), "
        "b AS (SELECT w, n, flatten(list_transform(string_split(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || w, ''), lambda c: "
        "CASE WHEN unicode(c) < 128 THEN [CAST(unicode(c) AS BIGINT)] ELSE [CAST(unicode(c) // 64 + 192 AS BIGINT), CAST(unicode(c) % 64 + 128 AS BIGINT)] END)) "
        "AS b FROM o), "
        "h(w, n, b, k, c) AS (SELECT w, n, b, CAST(1 AS BIGINT), 4294967295 FROM b UNION ALL SELECT w, n, b, k + 1, xor(c // 256, t.v) "
        "FROM h JOIN t ON t.i = xor(c % 256, b[k]) WHERE k <= len(b)), "
        "d AS (SELECT n, w, xor(c, 4294967295) AS h FROM h WHERE k = len(b) + 1), "
        "e AS (SELECT n, CASE WHEN h % 97 = 0 THEN substr(w, 1, CAST(h % length(w) AS BIGINT)) || substr(w, CAST(h % length(w) AS BIGINT) + 2) ELSE w END AS word FROM d), "
        "w AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM e WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3), "
        "g AS (SELECT word, i, substr(word, 1, i - 1) || substr(word, i + 1) AS g FROM w, range(1, length(word) + 1) x(i)), "
        "p AS (SELECT a.word AS a, b.word AS b FROM g a JOIN g b ON a.g = b.g AND a.i = b.i AND a.word <> b.word "
        "UNION SELECT word, g FROM g WHERE g IN (SELECT word FROM w) UNION SELECT g, word FROM g WHERE g IN (SELECT word FROM w)), "
        "q AS (SELECT p.a AS word, count(*) AS n_near, max(y.n) AS most, min({'m': -y.n, 'word': p.b}) AS f "
        "FROM p JOIN w y ON p.b = y.word GROUP BY p.a), "
        "f AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN most >= 2 * w.n THEN f.word END AS form, "
        "CASE WHEN most >= 2 * w.n THEN most END AS form_n FROM w LEFT JOIN q USING (word)), "
        "r(word, root) AS (SELECT word, word FROM f UNION ALL SELECT r.word, f.form FROM r JOIN f ON r.root = f.word WHERE f.form IS NOT NULL) "
        "SELECT f.word, f.form, r.root, f.n, CAST(f.n_near AS BIGINT) AS n_near, f.form_n FROM f JOIN r USING (word) "
        "JOIN f z ON r.root = z.word WHERE z.form IS NULL")


def op13_sql() -> str:
    dist = "CAST(list_sum(list_transform(range(1, len(p.x) + 1), lambda i: (p.x[i] - b.x[i]) * (p.x[i] - b.x[i]))) AS BIGINT)"
    steps = ["b0 AS (SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS entry, x FROM p "
             "WHERE vec_id IN (SELECT vec_id FROM v ORDER BY vec_id LIMIT 64))"]
    for k in range(3):
        # the least of distance * 64 + entry is the nearest entry, ties to the lower index
        steps.append(f"a{k} AS (SELECT n, vec_id, label, part, any_value(p.x) AS x, min({dist} * 64 + entry) AS best "
                     f"FROM p JOIN b{k} b USING (part) GROUP BY n, vec_id, label, part)")
        if k < 2:
            steps.append(
                f"m{k} AS (SELECT part, entry, list(m ORDER BY i) AS x FROM (SELECT part, best % 64 AS entry, i, "
                f"CAST(floor(sum(x[i]) / count(*)) AS BIGINT) AS m FROM a{k}, range(1, len(x) + 1) y(i) GROUP BY ALL) GROUP BY part, entry)")
            steps.append(f"b{k + 1} AS (SELECT b.part, b.entry, coalesce(m.x, b.x) AS x FROM b{k} b LEFT JOIN m{k} m USING (part, entry))")
    return (
        "WITH v AS (SELECT row_number() OVER () AS n, vec_id, label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS x "
        "FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0), "
        "p AS (SELECT n, vec_id, label, part, x[part * (len(x) // 16) + 1:(part + 1) * (len(x) // 16)] AS x FROM v, range(16) y(part)), "
        + ", ".join(steps) +
        ", s AS (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY part, entry)) AS sha FROM b2), "
        "c AS (SELECT vec_id, label, string_agg(printf('%02x', best % 64), '' ORDER BY part) AS code, CAST(sum(best // 64) AS BIGINT) AS error "
        "FROM a2 GROUP BY n, vec_id, label) "
        "SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, sha AS codebooks_sha256 FROM c, s")


def oracle_sql() -> dict[str, str]:
    return {"op1_pii": op1_sql(), "op3_jaccard": op3_sql(), "op4_licenses": op4_sql(), "op6_vectors": op6_sql(),
            "op11_spelling": op11_sql(), "op13_codes": op13_sql()}
