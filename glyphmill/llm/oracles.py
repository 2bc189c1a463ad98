"""DuckDB SQL for the queries of this folder that SQL can express, written apart from the operators' own methods."""

from __future__ import annotations

from glyphmill.llm import licenses, quality, queries, secrets, urls

_UP, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WORDS = r"[^\x20\x09-\x0D]+"


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


OP1 = rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UP}', '{_LOW}'), '{_WORDS}') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i+4], ' ') AS g FROM w, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS t(i) WHERE len(ws) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b USING (g) WHERE a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 85 * (x.n + y.n - i)),
both_ways AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
r(id, root) AS (SELECT doc_id, doc_id FROM documents UNION SELECT b, root FROM r JOIN both_ways ON a = id)
SELECT d.doc_id, coalesce(any_value(n.n), 0)::BIGINT AS n_shingles, min(root) AS component_id, d.doc_id = min(root) AS kept
FROM documents d JOIN r ON r.id = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id GROUP BY d.doc_id
"""


def _op2() -> str:
    """Positions from splitting at the pattern; entropy of every window from list_entropy."""
    def places(pattern: str, kind: int, source: str) -> str:
        return f"""
        SELECT doc_id, {kind} AS kind, m[i] AS word,
          list_sum(list_transform(p[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i-1], lambda x: length(x))), 0) AS a
        FROM (SELECT doc_id, regexp_extract_all(t, {_q(pattern)}) AS m, string_split_regex(t, {_q(pattern)}) AS p FROM {source}), unnest(range(1, len(m) + 1)) AS u(i)"""

    windows = f"list_max(list_transform(range(1, length(word) - {secrets.WINDOW - 2}), lambda i: list_entropy(string_split(word[i:i+{secrets.WINDOW - 1}], ''))))"
    allowed = " OR ".join(f"regexp_matches(word, {_q(p)})" for p in secrets.ALLOW)
    path = f"regexp_matches(word, {_q(secrets.SEPARATOR)}) AND len(list_filter(string_split_regex(word, {_q(secrets.SEPARATOR)}), lambda p: NOT regexp_matches(p, {_q(secrets.PLAIN_PART)}))) = 0"
    return f"""
    WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
    found AS ({places(secrets.ASSIGN, 0, "d")} UNION ALL {places(secrets.ACCESS, 1, "d")} UNION ALL {places(secrets.HEX, 2, "d")} UNION ALL {places(secrets.CANDIDATE, 3, "d")}),
    base AS (SELECT doc_id, kind, a::BIGINT AS a, (a + length(word))::BIGINT AS b FROM found WHERE kind IN (1, 2) OR kind = 0 AND length(regexp_extract(word, {_q(secrets.ASSIGN)}, 2)) >= {secrets.MIN_ASSIGNED}),
    run AS (SELECT doc_id, a::BIGINT AS a, (a + length(word))::BIGINT AS b, word FROM found WHERE kind = 3),
    lo AS (SELECT DISTINCT f.doc_id, f.a AS f, f.b, f.word, unnest([f.a, x.b]) AS p FROM run f LEFT JOIN base x ON x.doc_id = f.doc_id AND x.a < f.b AND f.a < x.b),
    free AS (SELECT * FROM lo WHERE p < b AND p IS NOT NULL AND NOT EXISTS (SELECT 1 FROM base x WHERE x.doc_id = lo.doc_id AND x.a <= lo.p AND lo.p < x.b)),
    cut AS (SELECT free.doc_id, f, p, word, least(any_value(free.b), coalesce(min(x.a), any_value(free.b))) AS q FROM free LEFT JOIN base x ON x.doc_id = free.doc_id AND x.a >= p GROUP BY ALL),
    piece AS (SELECT doc_id, p AS a, q AS b, word[p - f + 1:q - f] AS word FROM cut WHERE q - p >= {secrets.WINDOW}),
    more AS (SELECT doc_id, 3 AS kind, a, b FROM piece WHERE NOT ({allowed} OR {path})
      AND {windows} >= CASE WHEN regexp_matches(word, {_q(secrets.HEX_CLASS)}) THEN {secrets.THRESHOLD["hex"]} ELSE {secrets.THRESHOLD["mixed"]} END),
    every_span AS (SELECT * FROM base UNION ALL SELECT * FROM more),
    named AS (SELECT *, ['assign', 'access', 'hex', 'entropy'][kind + 1] || ':' || a || ':' || b AS s FROM every_span)
    SELECT d.doc_id, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex,
      sha256(coalesce(string_agg(s, ',' ORDER BY a, kind) FILTER (kind < 3), '')) AS base_sha256, coalesce(string_agg(s, ',' ORDER BY a, kind), '') AS spans
    FROM d LEFT JOIN named ON named.doc_id = d.doc_id GROUP BY d.doc_id"""


def _ledger() -> str:
    bits = " + ".join(f"CASE WHEN {rule} THEN {quality.BIT[name]} ELSE 0 END" for name, rule in quality.RULES)
    return rf"""
    WITH w AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{_WORDS}') AS ws,
        list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '{_WORDS}')) AS ls FROM documents),
    g AS (SELECT doc_id, i, ws[i] || ' ' || ws[i+1] || ' ' || ws[i+2] AS g FROM w, unnest(range(1, len(ws) - 1)) AS u(i)),
    c AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM g),
    r AS (SELECT doc_id, count(DISTINCT i + o) AS n FROM c, (VALUES (0), (1), (2)) AS o(o) WHERE c.n > 1 GROUP BY 1),
    m AS (SELECT w.doc_id, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
        len(ls)::BIGINT AS n_lines, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(r.n, 0)::BIGINT AS n_repeat_words FROM w LEFT JOIN r USING (doc_id)),
    b AS (SELECT *, ({bits})::BIGINT AS failed_bits FROM m)
    """


def _op4() -> str:
    mask, base = quality.PRODUCTION.mask, quality.BASE.mask
    return f"""{_ledger()}
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (failed_bits & {base}) <> 0 AS base_failed, (failed_bits & {mask}) = 0 AS kept, failed_bits FROM b"""


def _ablations() -> str:
    """Each rule's rows one by one, without masks of several rules."""
    parts = [
        f"SELECT '{p.version}' AS policy, '{r}' AS rule, count(*) FILTER ((failed_bits // {quality.BIT[r]}) % 2 = 1) AS n_failed, "
        f"count(*) FILTER ((failed_bits // {quality.BIT[r]}) % 2 = 1 AND {' AND '.join(f'(failed_bits // {quality.BIT[o]}) % 2 = 0' for o in p.rejects if o != r)}) AS n_only FROM b"
        for p in (quality.BASE, quality.PRODUCTION) for r in p.rejects
    ]
    return _ledger() + " UNION ALL ".join(parts)


def _op5(shards: int = 24, buckets: int = 4096) -> str:
    """CRC-32 byte by byte with the reflected polynomial; rendezvous by the same digest, ranked by SQL."""
    entry = "i::BIGINT"
    for _ in range(8):
        entry = f"list_transform([{entry}], lambda x: xor(x >> 1, CASE WHEN x & 1 = 1 THEN 3988292384 ELSE 0 END))[1]"
    u = "('0x' || substr(md5(k || '/' || s), 1, 13))::BIGINT"
    return f"""
    WITH crc AS MATERIALIZED (SELECT list({entry} ORDER BY i) AS t FROM range(256) AS r(i)),
    d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(doc_id::VARCHAR, 'null') AS k, coalesce(text, '') AS x FROM documents),
    bytes AS (SELECT rid, list_transform(range(1, (length(hex(encode(x))) // 2 + 1)::BIGINT), lambda i: ('0x' || substr(hex(encode(x)), (2 * i - 1)::BIGINT, 2))::BIGINT) AS b FROM d),
    sums AS (SELECT rid, xor(list_reduce(b, lambda c, y: xor(c >> 8, t[xor(c & 255, y) + 1]), 4294967295::BIGINT), 4294967295) AS crc FROM bytes, crc),
    scores AS (SELECT rid, s, {u} AS u FROM d, range({shards + 1}) AS r(s)),
    won AS (SELECT rid, arg_max(s, u - s / 1e6) FILTER (s < {shards}) AS shard, arg_max(s, u - s / 1e6) AS grown FROM scores GROUP BY rid)
    SELECT doc_id, (octet_length(encode(x)) + 8)::BIGINT AS size, crc AS text_crc32, 'key' AS law, shard::INTEGER AS shard,
      (row_number() OVER (PARTITION BY shard ORDER BY ('0x' || substr(md5(k || '/slot'), 1, 8))::BIGINT % {buckets}, md5(k || '/slot'), doc_id) - 1)::BIGINT AS slot, grown::INTEGER AS grown_shard
    FROM d JOIN sums USING (rid) JOIN won USING (rid)"""


def _op6() -> str:
    cases_rule, cases_verdict = [], []
    for what, text in sorted(urls.RULES, key=lambda r: (-len(r[1]), r[1])):
        h, p = text[: text.index("/")], text[text.index("/") :]
        fits = f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')"
        cases_rule.append(f"WHEN {fits} THEN '{text}'")
        cases_verdict.append(f"WHEN {fits} THEN '{what}'")
    return rf"""
    WITH a AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, position('://' IN url) + 3) ELSE '' END AS rest FROM pages),
    b AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{_UP}', '{_LOW}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM a),
    k AS (SELECT *, CASE WHEN host <> '' THEN host || regexp_replace(path, '/+$', '') END AS canon FROM b),
    l AS (SELECT sub || site || '.example.' || top || '/' || lang || '/' || n AS canon FROM unnest({list(queries.LISTED_SUBS)}) AS a(sub), unnest({list(queries.LISTED_SITES)}) AS b(site), unnest({list(queries.LISTED_TOPS)}) AS c(top),
      unnest({list(queries.LISTED_LANGS)}) AS d(lang), range({queries.LISTED_NUMBERS}) AS e(n))
    SELECT page_id, host, path, CASE {" ".join(cases_rule)} END AS rule,
      coalesce(CASE {" ".join(cases_verdict)} END, CASE WHEN l.canon IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict, l.canon IS NOT NULL AS listed
    FROM k LEFT JOIN l ON l.canon = k.canon"""


def _template_regex(template: str) -> str:
    """The template as a pattern over folded words that each have a space before them; with an end, over the lower-cased text."""
    out, at = "", 0
    if template.endswith("<<end>>"):
        gap = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]"
        words = (w.decode() for w in template.removesuffix("<<end>>").encode().translate(licenses.ALNUM).split())
        return f"(?:^|{gap})" + f"{gap}+".join(words) + rf"(?:$|[\x00-\x2A\x2C\x2F\x3A-\x60\x7B-\x7F]|[-+.](?:$|{gap}))"
    for m in [*licenses.MARKUP.finditer(template), None]:
        text = template[at : m.start() if m else len(template)]
        out += "".join(" " + w.decode() for w in text.encode().translate(licenses.ALNUM).split())
        if m is None:
            break
        out += "(?:" if m[1] == "beginOptional" else ")?" if m[1] == "endOptional" else f"(?: [^ ]+){{0,{m[2]}}}"
        at = m.end()
    return out + "(?: |$)"


def _op8() -> str:
    word = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    phrases = " UNION ALL ".join(
        "SELECT doc_id, i - 1 AS place, '" + label + "' AS label FROM w, unnest(range(1, len(ws) + 1)) AS u(i) WHERE "
        + " AND ".join(f"ws[i+{j}] = '{x}'" for j, x in enumerate(phrase.split()))
        for phrase, label in licenses.PHRASES
    )
    own = " UNION ".join(f"SELECT doc_id, '{label}' AS label, {score} AS score FROM w WHERE regexp_matches({'low' if t.endswith('<<end>>') else 'joined'}, {_q(_template_regex(t))})" for label, score, t in licenses.TEMPLATES)
    return rf"""
    WITH w AS (SELECT doc_id, low, ws, ' ' || array_to_string(ws, ' ') AS joined FROM (SELECT doc_id, translate(coalesce(text, ''), '{_UP}', '{_LOW}') AS low, regexp_extract_all(low, '{word}') AS ws FROM documents)),
    p AS ({phrases}), t AS ({own}),
    b AS (SELECT doc_id, count(*) AS n, min(place) AS lo, max(place) AS hi, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM p GROUP BY 1),
    o AS (SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT doc_id, label FROM p UNION SELECT doc_id, label FROM t) GROUP BY 1),
    a AS (SELECT doc_id, max(score) AS score FROM t GROUP BY 1)
    SELECT w.doc_id, len(ws)::BIGINT AS n_words, coalesce(b.n, 0)::BIGINT AS n_base, b.lo::BIGINT AS first_word, b.hi::BIGINT AS last_word, coalesce(b.labels, '') AS base_labels,
      coalesce(o.labels, '') AS labels, CASE WHEN a.doc_id IS NOT NULL THEN a.score WHEN b.doc_id IS NOT NULL THEN {licenses.PHRASE} ELSE 0.0 END::DOUBLE AS score
    FROM w LEFT JOIN b USING (doc_id) LEFT JOIN o USING (doc_id) LEFT JOIN a ON a.doc_id = w.doc_id"""


def oracles() -> dict[str, str]:
    return {"op1_minhash_dedup": OP1, "op2_secret_scan": _op2(), "op4_quality_rules": _op4(), "quality_ablations": _ablations(), "op5_sharding": _op5(), "op6_url_filter": _op6(), "op8_license_scan": _op8()}
