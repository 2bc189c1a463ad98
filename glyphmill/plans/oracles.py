"""DuckDB SQL for the registered queries, from the definitions and not from the Spark plans."""

from __future__ import annotations

from glyphmill.plans.models import BUCKET, DIM, Q_PARTS, Q_WIDTH, VOCABULARY
from glyphmill.plans.queries import LAST, MANY, PARTS, QUANTISED_ROWS, ROUNDS, SENTENCES, WIDTH

WS = r"[\t-\r \x{85}\p{Z}]+"


def _tokens(text: str = "text") -> str:
    return f"list_append(list_filter(regexp_split_to_array({text}, '{WS}'), lambda x: x <> ''), '</s>')"


def _fnv(s: str) -> str:
    raw = f"hex(encode({s}))"
    byte = f"list_transform(range(1, (length({raw}) // 2 + 1)::BIGINT), lambda i: ('0x' || substr({raw}, (2 * i - 1)::BIGINT, 2))::UBIGINT)"
    signed = f"list_transform({byte}, lambda b: CASE WHEN b >= 128 THEN b + 4294967040 ELSE b END::UBIGINT)"
    return f"list_reduce({signed}, lambda h, b: ((xor(h, b) * 16777619) % 4294967296)::UBIGINT, 2166136261::UBIGINT)::BIGINT"


#: Tokens and counts of the documents; the vocabulary, its labels, and weights by formula.
CTE = f"""
pos AS (SELECT doc_id, t[i] AS token, i - 1 AS pos FROM (SELECT doc_id, {_tokens()} AS t FROM documents WHERE text IS NOT NULL), unnest(range(1, len(t) + 1)) AS u(i)),
cnt AS (SELECT doc_id, token, count(*) AS cnt FROM pos GROUP BY 1, 2),
tot AS (SELECT token, sum(cnt)::BIGINT AS n FROM cnt GROUP BY 1),
vocab AS (SELECT token, 0::BIGINT AS id FROM tot WHERE token = '</s>' UNION ALL SELECT token, id FROM (SELECT token, row_number() OVER (ORDER BY n DESC, token) AS id FROM tot WHERE token <> '</s>') WHERE id <= {VOCABULARY}),
nw AS (SELECT count(*) AS nwords FROM vocab),
labels AS (SELECT row_number() OVER (ORDER BY count(*) DESC, lang) - 1 AS label_id, '__label__' || lang AS label, count(*) AS cnt FROM documents WHERE lang IS NOT NULL GROUP BY lang),
dims AS (SELECT d FROM range({DIM}) AS r(d)),
feat AS (SELECT doc_id, id AS row_id, sum(cnt)::BIGINT AS cnt FROM cnt JOIN vocab USING (token) GROUP BY 1, 2),
hid AS (SELECT doc_id, d, sum(cnt * ((31 * row_id + 17 * d + (row_id * d) % 7) % 65 - 32) / 64.0::DOUBLE) / sum(cnt) AS v FROM feat, dims GROUP BY 1, 2),
score AS (SELECT doc_id, label_id, sum(v * (((13 * label_id + 29 * d) % 33 - 16) / 16.0::DOUBLE)) AS score FROM hid, labels GROUP BY doc_id, label_id),
prob AS (SELECT doc_id, label_id, exp(score - m) / sum(exp(score - m)) OVER (PARTITION BY doc_id) AS prob FROM (SELECT *, max(score) OVER (PARTITION BY doc_id) AS m FROM score))
"""

#: The counted language model of the flagship.
COUNTED = f"""
WITH all_pos AS (SELECT doc_id, lang, unnest({_tokens()}) AS token FROM documents WHERE text IS NOT NULL),
cnt AS (SELECT doc_id, token, count(*) AS cnt FROM all_pos GROUP BY 1, 2),
known AS (SELECT doc_id, lang FROM documents WHERE text IS NOT NULL AND lang IS NOT NULL),
labels AS (SELECT row_number() OVER (ORDER BY count(*) DESC, lang) - 1 AS label_id, lang FROM known GROUP BY lang),
lc AS (SELECT token, lang, count(*) AS n FROM all_pos WHERE lang IS NOT NULL GROUP BY 1, 2),
tot AS (SELECT token, sum(n) AS n FROM lc GROUP BY 1),
vec AS (SELECT tot.token, label_id, floor(64 * coalesce(lc.n, 0) / tot.n::DOUBLE) / 64 AS w FROM tot CROSS JOIN labels LEFT JOIN lc ON lc.token = tot.token AND lc.lang = labels.lang),
score AS (SELECT doc_id, label_id, 8 * sum(cnt * w) / sum(cnt) AS score FROM cnt JOIN vec USING (token) GROUP BY 1, 2),
prob AS (SELECT doc_id, label_id, exp(score - m) / sum(exp(score - m)) OVER (PARTITION BY doc_id) AS prob FROM (SELECT *, max(score) OVER (PARTITION BY doc_id) AS m FROM score)),
top AS (SELECT doc_id, '__label__' || lang AS label, round(prob + 1e-5, 6) AS prob FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY prob DESC, label_id DESC) AS rn FROM prob) JOIN labels USING (label_id) WHERE rn = 1)
"""

RANKED = "ranked AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY prob DESC, label_id DESC) AS rank, label, round(prob + 1e-5, 6) AS prob FROM prob JOIN labels USING (label_id) WHERE prob >= {t})"


def _with(select: str, extra: str = "") -> str:
    return f"WITH {CTE}{', ' + extra if extra else ''} {select}"


def _grams(tokens: str, minn: int, maxn: int) -> str:
    """token, g: character n-grams of the marked tokens of a relation."""
    return f"""(SELECT token, substr('<' || token || '>', i, k) AS g FROM {tokens}, unnest(range(1, length(token) + 3)) AS a(i), unnest(range({max(minn, 1)}, {maxn + 1})) AS b(k)
      WHERE i + k - 1 <= length(token) + 2 AND NOT (k = 1 AND (i = 1 OR i = length(token) + 2)))"""


VOCAB_TOKENS = "vt AS (SELECT token FROM vocab WHERE token <> '</s>')"


def _ngrams(n: int) -> str:
    x = "x::HUGEINT"
    two = f"((({x} * 116049371) + x1) % 18446744073709551616)"
    three = f"(({two} * 116049371 + x2) % 18446744073709551616)"
    rows = f"SELECT doc_id, ({two} % {BUCKET})::BIGINT AS h FROM led WHERE x1 IS NOT NULL"
    if n == 3:
        rows += f" UNION ALL SELECT doc_id, ({three} % {BUCKET})::BIGINT FROM led WHERE x2 IS NOT NULL"
    extra = f"""hs AS (SELECT token, {_fnv("token")} AS x FROM (SELECT DISTINCT token FROM pos WHERE NOT starts_with(token, '__label__'))),
    led AS (SELECT doc_id, x, lead(x) OVER w AS x1, lead(x, 2) OVER w AS x2 FROM pos JOIN hs USING (token) WINDOW w AS (PARTITION BY doc_id ORDER BY pos))"""
    return _with(f"SELECT doc_id, count(*) AS n, sum(h)::BIGINT AS sum_bucket FROM ({rows}) GROUP BY 1", extra)


#: For four labels by falling count, all Huffman trees there are: label, depth, inner row, goes right.
TREES = {
    "a": {0: "2T1T", 1: "2T1F", 2: "2F0T", 3: "2F0F"},
    "b1": {0: "2F", 1: "2T1F", 2: "2T1T0T", 3: "2T1T0F"},
    "b2": {0: "2T", 1: "2F1F", 2: "2F1T0T", 3: "2F1T0F"},
    "c1": {0: "2F", 1: "2T1T", 2: "2T1F0T", 3: "2T1F0F"},
    "c2": {0: "2T", 1: "2F1T", 2: "2F1F0T", 3: "2F1F0F"},
}
_PATHS = ", ".join(f"('{t}', {label}, {int(p[i])}, {str(p[i + 1] == 'T').lower()})" for t, by in TREES.items() for label, p in by.items() for i in range(0, len(p), 2))
TREE = f"""c AS (SELECT max(cnt) FILTER (label_id = 0) AS c0, max(cnt) FILTER (label_id = 1) AS c1, max(cnt) FILTER (label_id = 2) + max(cnt) FILTER (label_id = 3) AS n4 FROM labels),
tree AS (SELECT CASE WHEN c1 < n4 AND c0 < n4 THEN 'a' WHEN c1 < n4 THEN CASE WHEN c0 < c1 + n4 THEN 'b1' ELSE 'b2' END WHEN c0 < c1 + n4 THEN 'c1' ELSE 'c2' END AS t FROM c),
path AS (SELECT label_id, inner_row, is_right FROM (VALUES {_PATHS}) AS p(t, label_id, inner_row, is_right) JOIN tree USING (t))"""

CENTROID = "(((c * 7 + i * 5 + j * 3 + {s}) % 33) - 16) / 16.0::DOUBLE"
DECODED = f"""WITH codes AS (SELECT r, i, (r * 11 + i * 3) % 256 AS c, ((((r * 5) % 256) * 7 + 4) % 33 - 16) / 16.0::DOUBLE AS norm FROM range({QUANTISED_ROWS}) AS a(r), range({PARTS}) AS b(i)),
dec AS (SELECT r AS row_id, i * {WIDTH} + j AS d, norm * {CENTROID.format(s=0)} AS value FROM codes, range({WIDTH}) AS w(j) WHERE i < {PARTS - 1} OR j < {LAST})"""


#: Numbered labels, scored by the input rows ``feat`` names with weight ``w``.
def _many(n: int, weight: str, feat: str = "feat") -> str:
    return f"""many AS (SELECT l AS label_id, '__label__' || l AS label FROM range({n}) AS r(l)),
    mh AS (SELECT doc_id, d, sum(cnt * {weight}) / sum(cnt) AS v FROM {feat}, dims GROUP BY 1, 2),
    ms AS (SELECT doc_id, label_id, sum(v * (((13 * label_id + 29 * d) % 33 - 16) / 16.0::DOUBLE)) AS score FROM mh, many GROUP BY doc_id, label_id),
    mp AS (SELECT doc_id, label_id, exp(score - m) / sum(exp(score - m)) OVER (PARTITION BY doc_id) AS prob FROM (SELECT *, max(score) OVER (PARTITION BY doc_id) AS m FROM ms)),
    mr AS (SELECT doc_id, label_id, prob + 1e-5 AS prob, row_number() OVER (PARTITION BY doc_id ORDER BY round(prob, 12) DESC, label_id DESC) AS rank FROM mp)"""


PLAIN = "((31 * row_id + 17 * d + (row_id * d) % 7) % 65 - 32) / 64.0::DOUBLE"
QUANTISED = f"((((row_id * 11 + (d // {Q_WIDTH}) * 3) % 256) * 7 + (d // {Q_WIDTH}) * 5 + (d % {Q_WIDTH}) * 3) % 33 - 16) / 16.0::DOUBLE * (((((row_id * 5) % 256) * 7 + 4) % 33 - 16) / 16.0::DOUBLE)"


def oracles() -> dict[str, str]:
    top = lambda k, t=0.0: _with(f"SELECT doc_id, rank, label, prob FROM ranked WHERE rank <= {k}", RANKED.format(t=t))
    sig = "CASE WHEN z < -8 THEN 0.0 WHEN z > 8 THEN 1.0 ELSE 1 / (1 + exp(-z)) END"
    inner = f"nodes AS (SELECT doc_id, inner_row, {sig} AS f FROM (SELECT doc_id, label_id AS inner_row, score AS z FROM score))"
    prune = f"""SELECT 'all' AS mode, {BUCKET}::BIGINT AS n_emitted, (SELECT sum(h + nwords) FROM range({BUCKET}) AS r(h), nw)::BIGINT AS sum_id
      UNION ALL SELECT 'none', 0, 0 UNION ALL SELECT 'some', count(*), sum(h // 2 + nwords)::BIGINT FROM range(0, {BUCKET}, 2) AS r(h), nw"""
    held = COUNTED.replace("FROM documents WHERE text IS NOT NULL),\ncnt", "FROM documents WHERE text IS NOT NULL AND doc_id % 2 = 1),\ncnt")
    held = held.replace("cnt AS (SELECT doc_id, token, count(*) AS cnt FROM all_pos GROUP BY 1, 2)", f"cnt AS (SELECT doc_id, token, count(*) AS cnt FROM (SELECT doc_id, unnest({_tokens()}) AS token FROM documents WHERE doc_id % 2 = 0) GROUP BY 1, 2)")
    held = held.replace("WHERE text IS NOT NULL AND lang IS NOT NULL)", "WHERE text IS NOT NULL AND lang IS NOT NULL AND doc_id % 2 = 1)")
    held += ", judged AS (SELECT doc_id, top.label, '__label__' || lang AS expected FROM top JOIN documents USING (doc_id))"
    short = "said AS (SELECT i AS doc_id, s AS text FROM (VALUES " + ", ".join(f"({i}, '{x}')" for i, x in enumerate(SENTENCES)) + f""") AS v(i, s)),
    sfeat AS (SELECT doc_id, id AS row_id, count(*) AS cnt FROM (SELECT doc_id, unnest({_tokens()}) AS token FROM said) JOIN vocab USING (token) GROUP BY 1, 2)"""
    all_tokens = "vt AS (SELECT token FROM tot WHERE token <> '</s>')"
    hashed = lambda a, b: f"gr AS {_grams('vt', a, b)}, hh AS (SELECT g, {_fnv('g')} % {BUCKET} AS h FROM (SELECT DISTINCT g FROM gr))"
    judged = COUNTED + ", judged AS (SELECT doc_id, top.label, '__label__' || lang AS expected, prob, lang, n_chars FROM top JOIN documents USING (doc_id))"
    routed = _tokens("text || coalesce(' __label__' || lang, '') || ' __label__x' || doc_id")
    labelled = _tokens("text || coalesce(' __label__' || lang, '')")
    label_cte = "labels AS (SELECT '__label__' || lang AS label, row_number() OVER (ORDER BY count(*) DESC, lang) - 1 AS label_id FROM documents WHERE lang IS NOT NULL GROUP BY lang)"
    subword = _with(
        "SELECT doc_id, d, round(sum(k * ((31 * row_id + 17 * d + (row_id * d) % 7) % 65 - 32) / 64.0::DOUBLE) / sum(k) + 1e-9, 6) AS value FROM f, dims GROUP BY 1, 2",
        f"""dt AS (SELECT DISTINCT token FROM cnt WHERE token <> '</s>'), gr AS {_grams('dt', 3, 3)}, hh AS (SELECT g, {_fnv('g')} % {BUCKET} + (SELECT nwords FROM nw) AS row_id FROM (SELECT DISTINCT g FROM gr)),
        tg AS (SELECT token, row_id, count(*) AS n FROM gr JOIN hh USING (g) GROUP BY 1, 2 UNION ALL SELECT token, id, 1 FROM vocab),
        f AS (SELECT doc_id, row_id, sum(cnt * n) AS k FROM cnt JOIN tg USING (token) GROUP BY 1, 2)""",
    )
    top1 = "SELECT doc_id, label, prob FROM top"
    formula_top1 = _with("SELECT doc_id, label, round(prob, 4) AS prob FROM (SELECT doc_id, label, prob + 1e-5 AS prob, row_number() OVER (PARTITION BY doc_id ORDER BY prob DESC, label_id DESC) AS rn FROM prob JOIN labels USING (label_id)) WHERE rn = 1")
    out = {
        "t01_tokenize": f"SELECT doc_id, len({_tokens()})::BIGINT AS n_tokens FROM documents",
        "t02_end_token": f"SELECT doc_id, (len({_tokens()}) - 1)::BIGINT AS pos, '</s>' AS token FROM documents WHERE text IS NOT NULL",
        "t03_fnv1a": _with(f"SELECT token, {_fnv('token')} AS h FROM tot"),
        "t04_vocab_lookup": _with("SELECT doc_id, coalesce(sum(cnt) FILTER (id IS NOT NULL), 0)::BIGINT AS n_known, coalesce(sum(cnt) FILTER (id IS NULL), 0)::BIGINT AS n_oov FROM cnt LEFT JOIN vocab USING (token) GROUP BY 1"),
        "t05_token_routing": f"""WITH {label_cte}, p AS (SELECT doc_id, unnest({routed}) AS token FROM documents)
          SELECT doc_id, count(*) FILTER (NOT starts_with(token, '__label__')) AS n_word, count(label) AS n_label_known, count(*) FILTER (starts_with(token, '__label__') AND label IS NULL) AS n_label_unknown
          FROM p LEFT JOIN labels ON label = token GROUP BY 1""",
        "t06_char_ngrams": _with("SELECT token, count(*) AS n_grams, sum(h)::BIGINT AS sum_bucket FROM gr JOIN hh USING (g) GROUP BY 1", f"{all_tokens}, {hashed(2, 4)}"),
        "t07_markers": _with("SELECT token, " + _fnv("m") + " AS h FROM (SELECT token, '<' || token || '>' AS m FROM vt)", all_tokens),
        "t08_prune_remap": _with(prune),
        "t09_token_ids": _with(
            "SELECT token, count(*) AS n_ids, sum(x)::BIGINT AS sum_ids FROM (SELECT token, id AS x FROM vocab UNION ALL SELECT token, h + nwords FROM gr JOIN hh USING (g), nw) GROUP BY 1", f"{all_tokens}, {hashed(3, 4)}"),
        "t11_word_bigrams": _ngrams(2),
        "t11_word_trigrams": _ngrams(3),
        "t12_features": _with("SELECT doc_id, row_id, cnt FROM feat"),
        "t12_line_labels": f"WITH {label_cte}, p AS (SELECT doc_id, unnest({labelled}) AS token FROM documents) SELECT doc_id, label_id, count(*) AS cnt FROM p JOIN labels ON label = token GROUP BY 1, 2",
        "t13_labels": _with("SELECT label_id, label FROM labels"),
        "t14_label_counts": _with("SELECT label_id, label, cnt FROM labels"),
        "t15_dim": f"SELECT {DIM}::BIGINT AS dim",
        "a01_sentence_vector": _with("SELECT doc_id, d, round(v + 1e-9, 6) AS value FROM hid"),
        "r12_subword_vector": subword,
        "m02_dot": _with("SELECT doc_id, label_id, round(score + 1e-9, 6) AS score FROM score"),
        "m04_pq_decode": DECODED + " SELECT row_id, d, round(value, 6) AS value FROM dec",
        "m05_pq_dot": DECODED + " SELECT row_id, round(sum(value * ((d % 5) - 2) / 4.0), 6) AS score FROM dec GROUP BY 1",
        "m06_row_norm": DECODED + " SELECT DISTINCT r AS row_id, norm FROM codes",
        "r01_softmax": _with("SELECT doc_id, label, round(prob, 6) AS prob FROM prob JOIN labels USING (label_id)"),
        "r02_biased_log": "SELECT doc_id, round(ln(n_chars / 1000.0::DOUBLE + 1e-5), 6) AS y FROM documents",
        "r03_sigmoid": "SELECT doc_id, round(CASE WHEN x < -8 THEN 0 WHEN x > 8 THEN 1 ELSE 1 / (1 + exp(-x)) END, 6)::DOUBLE AS y FROM (SELECT doc_id, (n_chars % 401 - 200) / 20.0::DOUBLE AS x FROM documents)",
        "r05_topk": top(3),
        "r05_threshold": top(4, 0.3),
        "r04_hierarchical": _with(
            "SELECT doc_id, label, round(exp(sum(ln(CASE WHEN is_right THEN f ELSE 1 - f END + 1e-5))), 6) AS prob FROM path JOIN nodes USING (inner_row) JOIN labels USING (label_id) GROUP BY doc_id, label", f"{TREE}, {inner}"),
        "s19_huffman": _with("SELECT label, count(*) AS depth FROM path JOIN labels USING (label_id) GROUP BY 1", TREE),
        "r11_predict_top1": COUNTED + top1,
        "w01_precision": held + "SELECT count(*) AS n, round(avg((label = expected)::INT), 6) AS precision_at_1 FROM judged",
        "w02_failures": held + "SELECT doc_id, expected, label FROM judged WHERE label <> expected",
        "w04_agreement": f"WITH a AS ({formula_top1}), b AS ({COUNTED} {top1}) SELECT count(*) AS n, sum((a.label = b.label)::INT)::BIGINT AS agree FROM a JOIN b USING (doc_id)",
        "w05_vector_close": "SELECT vec_id, vec_id % 2 = 0 AS close FROM embeddings",
        "w06_prob_close": _with("SELECT doc_id, label, abs(round(prob, 2) - round(prob, 6)) <= round(prob, 6) * 0.02 AS close FROM prob JOIN labels USING (label_id)"),
        "w07_sorted": "SELECT doc_id, true AS sorted FROM documents WHERE text IS NOT NULL",
        "w08_topk_sweep": _with(f"SELECT k, count(*) AS n, round(avg(prob), 5) AS avg_prob FROM mr, (VALUES (1::BIGINT), (5), (10), (50), ({MANY})) AS ks(k) WHERE rank <= k GROUP BY 1", _many(MANY, PLAIN)),
        "w03_throughput": _with(f"SELECT text, label, {ROUNDS // len(SENTENCES)}::BIGINT AS n FROM mr JOIN many USING (label_id) JOIN said USING (doc_id) WHERE rank = 1", f"{short}, {_many(MANY, QUANTISED, 'sfeat')}"),
        "m09_quantised_predict": _with("SELECT doc_id, label, round(prob, 6) AS prob FROM mr JOIN many USING (label_id) WHERE rank = 1", _many(MANY, QUANTISED)),
        "r06_tie_order": "SELECT * FROM (VALUES (1::BIGINT, '3'), (2, '3,1'), (3, '3,1,2'), (4, '0,1,2,3'), (5, '0,1,2,3')) AS v(k, labels)",
        "r04_deep_tree": _with(
            f"""SELECT doc_id, rank, label, round(exp(logp), 6) AS prob FROM (SELECT doc_id, label_id, logp, row_number() OVER (PARTITION BY doc_id ORDER BY round(logp, 10) DESC, label_id DESC) AS rank FROM lp) JOIN many USING (label_id) WHERE rank <= 3""",
            f"""{_many(40, PLAIN)}, nodes AS (SELECT doc_id, label_id AS node, {sig} AS f FROM (SELECT doc_id, label_id, score AS z FROM ms)),
            step AS (SELECT label_id, i AS node, i > greatest(38 - label_id, 0) OR label_id = 39 AS other FROM many, range(39) AS r(i) WHERE i >= 38 - label_id),
            way AS (SELECT label_id, node, CASE WHEN node > 38 - label_id THEN {{left}} ELSE NOT {{left}} END AS goes_left FROM step),
            lp AS (SELECT doc_id, label_id, sum(ln(CASE WHEN goes_left THEN 1 - f ELSE f END + 1e-5)) AS logp FROM way JOIN nodes USING (node) GROUP BY 1, 2)""".replace("{left}", "true")),
        "s05_format_roundtrip": _with(
            f"""SELECT 'args' AS section, 13::BIGINT AS n, ({DIM} + 5 + 1 + 1 + 5 + 1 + 3 + 3 + {BUCKET} + 3 + 3 + 100)::BIGINT AS total
            UNION ALL SELECT 'dictionary', (SELECT nwords FROM nw) + {MANY}, ((SELECT sum(n) FROM tot JOIN vocab USING (token)) + (SELECT sum(greatest(1, CASE WHEN i > 60 THEN 0 ELSE 1152921504606846976 >> i END)) FROM range({MANY}) AS r(i)))::BIGINT
            UNION ALL SELECT 'labels', {MANY}, (SELECT sum(length('__label__' || i)) FROM range({MANY}) AS r(i))::BIGINT
            UNION ALL SELECT 'codes', (SELECT nwords FROM nw) + {BUCKET}, (SELECT sum((r * 11 + i * 3) % 256) FROM nw, range({BUCKET} + nwords) AS a(r), range({Q_PARTS}) AS b(i))::BIGINT
            UNION ALL SELECT 'output', {MANY}, (SELECT sum((13 * l + 29 * d) % 33 - 16) FROM range({MANY}) AS a(l), dims)::BIGINT"""),
        "w09_by_length": judged + "SELECT CASE WHEN n_chars < 100 THEN 'short' WHEN n_chars < 800 THEN 'medium' ELSE 'long' END AS bucket, count(*) AS n, round(avg(prob), 5) AS avg_prob FROM judged GROUP BY 1",
        "w10_by_lang": judged + "SELECT lang, count(*) AS n, round(avg(prob), 5) AS avg_prob FROM judged GROUP BY 1",
        "v_predict_udf": formula_top1,
        "v_embed_udf": _with("SELECT doc_id, d, round(v + 1e-6, 4) AS value FROM hid"),
        "v_token_ids": _with("SELECT doc_id, sum(cnt)::BIGINT AS n_ids, sum(cnt * row_id)::BIGINT AS sum_ids FROM feat GROUP BY 1"),
    }
    out["v_predict_udtf"] = out["v_stream_predict"] = out["v_predict_udf"]
    return out
