"""Secret scans: three fixed patterns, then sliding-window entropy over candidate strings.  Built-in functions only.

Positions come from splitting a text at a pattern: pieces and matches alternate, so their lengths add up to places.
Entropy: base spans are blanked out first, so a candidate is a run of 20 or more token characters that no base span
covers, and what a base span leaves of a longer run is a candidate of its own.  Candidates that an allow-list rule takes
are dropped.  A window of 20 characters slides over the others; counts per character change by one in and one out, and with
them the sum of c * log2(c) in fixed point, from which Shannon's entropy of the window follows.  A candidate of a class
(hex, or mixed) is a span of kind ``entropy`` if any window reaches the class's threshold; the windows after it are not counted.

Null text: as the empty text.  Rows are independent (no shuffle), repeated rows get the same spans, an empty table gives an
empty result, and columns other than id, text and those to carry are not read.  Very long texts and candidates: no pattern repeats a
group, so none recurses; sums over n matches take about n * ``STEP`` steps, and cutting a text at its spans reads it by blocks.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _either_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


#: Fixed: the base kinds in their order, and their patterns.  The shorter forms of access and hex are equal to
#: "match, then drop the short ones", for what they match is a whole run of their characters.
KEYWORDS = "|".join(_either_case(w) for w in ("password", "passwd", "secret", "token", "api_?key"))
VALUE = "[A-Za-z0-9+/_.=-]"
ASSIGN = rf"""({KEYWORDS})["']?\x20*[:=]\x20*["']?({VALUE}+)"""
ACCESS = "AKIA[A-Z0-9]{14,}"
HEX = "[0-9a-f]{16,}"
MIN_ASSIGNED = 12
KINDS = ("assign", "access", "hex", "entropy")

WINDOW = 20
CANDIDATE = "[A-Za-z0-9+/_=-]{20,}"
#: Suppressed candidates: no digit or no letter, UUIDs, counting runs ...
ALLOW = [
    "^[^0-9]*$",
    "^[^A-Za-z]*$",
    "^[0-9A-Fa-f]{8}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{12}$",
    "0123456789|abcdefghij|ABCDEFGHIJ",
]
#: ... and paths of plain words: each part between separators is letters, then at most four digits.
SEPARATOR, PLAIN_PART = "[/_=-]", "^[A-Za-z]*[0-9]{0,4}$"
HEX_CLASS = "^[0-9A-Fa-f]+$"
#: Bits of a window of 20 characters; 20 equally likely hex digits have about 3.4, 64 characters about 4.0.
THRESHOLD = {"hex": 3.05, "mixed": 3.72}
ONE = 1 << 20
TERMS = [round(ONE * c * math.log2(c)) if c else 0 for c in range(WINDOW + 2)]


def most(threshold: float) -> int:
    """The largest sum of c * log2(c), in fixed point, of a window that reaches the threshold."""
    return math.floor(ONE * WINDOW * (math.log2(WINDOW) - threshold))


SPAN = "array<struct<start:bigint,kind:int,end:bigint>>"
NO_STRINGS = "cast(array() as array<string>)"
#: Values summed one by one; longer arrays go by parts of this size.  Code points of a text that are cut at once.
STEP, BLOCK = 256, 1 << 15


def _let(value: Column, use) -> Column:
    """use(value), with value computed once: a lambda variable is a value, not an expression."""
    return F.transform(F.array(value), use)[0]


def _before(values: Column, join) -> Column:
    """For each value (long), join over all earlier ones, from 0 on.  join: a sum or a maximum."""
    zero = F.lit(0).cast("long")

    def steps(part: Column, start: Column) -> Column:
        none = F.struct(start.alias("at"), F.expr("cast(array() as array<bigint>)").alias("out"))
        return F.aggregate(part, none, lambda s, x: F.struct(join(s["at"], x).alias("at"), F.concat(s["out"], F.array(s["at"])).alias("out")), lambda s: s["out"])

    def by_parts(parts: Column) -> Column:
        starts = steps(F.transform(parts, lambda q: F.aggregate(q, zero, join)), zero)
        return F.flatten(F.zip_with(parts, starts, steps))

    def of(v: Column) -> Column:
        last = F.greatest(((F.size(v) - 1) / STEP).cast("int"), F.lit(0))
        return _let(F.transform(F.sequence(F.lit(0), last), lambda k: F.slice(v, k * STEP + 1, F.lit(STEP))), by_parts)

    return _let(values, of)


def _matches(text: Column, matches: Column, pattern: str) -> Column:
    """array of (start, end, text), in code points, end exclusive; text is not split where nothing matches."""
    pieces = F.split(text, pattern, -1)
    pairs = F.filter(F.zip_with(pieces, matches, lambda p, m: F.struct(F.length(p).cast("long").alias("gap"), F.length(m).cast("long").alias("n"), m.alias("match"))), lambda x: x["match"].isNotNull())

    def place(p: Column) -> Column:
        before = _before(F.transform(p, lambda x: x["gap"] + x["n"]), lambda a, x: a + x)
        return F.zip_with(p, before, lambda x, at: F.struct((at + x["gap"]).alias("start"), (at + x["gap"] + x["n"]).alias("end"), x["match"].alias("text")))

    return F.when(F.size(matches) > 0, _let(pairs, place)).otherwise(F.expr("cast(array() as array<struct<start:bigint,end:bigint,text:string>>)"))


def _replaced(text: Column, spans: Column, put) -> Column:
    """The text with put(length) in place of each span (sorted); of a span that earlier ones cover in part, the rest counts."""

    def cut(blocks: Column, a: Column, b: Column) -> Column:
        def one(k: Column) -> Column:
            lo = F.greatest(a - k * BLOCK, F.lit(0).cast("long"))
            return F.substring(F.get(blocks, k), (lo + 1).cast("int"), (F.least(b - k * BLOCK, F.lit(BLOCK).cast("long")) - lo).cast("int"))

        first, last = (a / BLOCK).cast("int"), ((b - 1) / BLOCK).cast("int")
        return F.when(a < b, F.array_join(F.transform(F.sequence(first, last), one), "")).otherwise("")

    def of(blocks: Column) -> Column:
        def pieces(before: Column) -> Column:
            def piece(x: Column, at: Column) -> Column:
                inside = x["start"] < at
                return F.concat(cut(blocks, at, F.greatest(x["start"], at)), put(F.greatest(x["end"] - F.greatest(x["start"], at), F.lit(0).cast("long")), inside))

            return F.array_join(F.zip_with(spans, before, piece), "")

        end = F.array_max(F.transform(spans, lambda x: x["end"]))
        return F.concat(_let(_before(F.transform(spans, lambda x: x["end"]), lambda a, x: F.greatest(a, x)), pieces), cut(blocks, end, F.length(text).cast("long")))

    blocks = F.transform(F.sequence(F.lit(0), ((F.length(text) - 1) / BLOCK).cast("int")), lambda k: F.substring(text, k * BLOCK + 1, F.lit(BLOCK)))
    return F.when(F.size(spans) > 0, _let(blocks, of)).otherwise(text)


def _spans(found: Column, kind: int) -> Column:
    return F.transform(found, lambda x: F.struct(x["start"].alias("start"), F.lit(kind).alias("kind"), x["end"].alias("end")))


def _least_sum(chars: Column, limit: Column) -> Column:
    """The least sum of c * log2(c) over the windows of WINDOW characters: the window of most entropy, or the first within the limit."""
    terms = F.array(*[F.lit(t).cast("long") for t in TERMS])

    def put(counts: Column, at: Column, by: int) -> Column:
        return F.concat(F.slice(counts, F.lit(1), at), F.array(F.get(counts, at) + by), F.slice(counts, at + 2, F.lit(128)))

    def step(state: Column, i: Column) -> Column:
        new = F.ascii(F.get(chars, i))
        old = F.ascii(F.get(chars, i - WINDOW))  # null before the window is full
        had = F.get(state["counts"], new)
        up = F.struct(put(state["counts"], new, 1).alias("c"), (state["sum"] + F.get(terms, had + 1) - F.get(terms, had)).alias("s"))

        def leave(u: Column) -> Column:
            n = F.get(u["c"], old)
            down = F.struct(put(u["c"], old, -1).alias("c"), (u["s"] + F.get(terms, n - 1) - F.get(terms, n)).alias("s"))
            return F.when(i >= WINDOW, down).otherwise(u)

        def close(u: Column) -> Column:
            best = F.when(i >= WINDOW - 1, F.least(state["best"], u["s"])).otherwise(state["best"])
            return F.struct(u["c"].alias("counts"), u["s"].alias("sum"), best.alias("best"))

        return F.when(state["best"] <= limit, state).otherwise(F.transform(F.transform(F.array(up), leave), close)[0])

    start = F.struct(F.array_repeat(F.lit(0), 128).alias("counts"), F.lit(0).cast("long").alias("sum"), F.lit(1 << 60).cast("long").alias("best"))
    return F.aggregate(F.sequence(F.lit(0), F.size(chars) - 1), start, step, lambda s: s["best"])


def _secret(x: Column) -> Column:
    limit = F.when(x["text"].rlike(HEX_CLASS), F.lit(most(THRESHOLD["hex"]))).otherwise(F.lit(most(THRESHOLD["mixed"]))).cast("long")
    return _let(F.struct(F.split(x["text"], "").alias("chars"), limit.alias("limit")), lambda v: _least_sum(v["chars"], v["limit"]) <= v["limit"])


def _allowed(text: Column) -> Column:
    path = text.rlike(SEPARATOR) & F.forall(F.split(text, SEPARATOR, -1), lambda p: p.rlike(PLAIN_PART))
    return F.exists(F.array(*[text.rlike(p) for p in ALLOW]), lambda b: b) | path


def find_secrets(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """id, the columns named in carry, _text, and spans: array of (start, kind, end), sorted; kind is the place in KINDS."""
    carry = carry or []
    rows = df.select(F.col(id_col).alias("_id"), *[F.col(c).alias(f"_c{i}") for i, c in enumerate(carry)], F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    extra = [f"_c{i}" for i in range(len(carry))]
    none = F.expr(NO_STRINGS)
    rows = rows.select(
        "_id", *extra, "_text",
        F.when(F.col("_text").rlike(KEYWORDS), F.regexp_extract_all("_text", F.lit(ASSIGN), F.lit(0))).otherwise(none).alias("_a"),
        F.when(F.contains("_text", F.lit("AKIA")), F.regexp_extract_all("_text", F.lit(ACCESS), F.lit(0))).otherwise(none).alias("_k"),
        F.regexp_extract_all("_text", F.lit(f"({CANDIDATE})|({HEX})"), F.lit(0)).alias("_any"),
    )
    rows = rows.select("_id", *extra, "_text", "_a", "_k", "_any", F.when(F.size("_any") > 0, F.regexp_extract_all("_text", F.lit(HEX), F.lit(0))).otherwise(none).alias("_h"))
    assigned = F.filter(_matches(F.col("_text"), F.col("_a"), ASSIGN), lambda x: F.length(F.regexp_extract(x["text"], ASSIGN, 2)) >= MIN_ASSIGNED)
    base = F.concat(_spans(assigned, 0), _spans(_matches(F.col("_text"), F.col("_k"), ACCESS), 1), _spans(_matches(F.col("_text"), F.col("_h"), HEX), 2))
    rows = rows.select("_id", *extra, "_text", "_any", F.sort_array(base).alias("_base"))
    blank = _replaced(F.col("_text"), F.col("_base"), lambda n, inside: F.repeat(F.lit(" "), n.cast("int")))
    rows = rows.select("_id", *extra, "_text", "_base", F.when(F.size("_any") > 0, blank).alias("_rest"))
    rows = rows.select("_id", *extra, "_text", "_base", "_rest", F.when(F.col("_rest").isNotNull(), F.regexp_extract_all("_rest", F.lit(CANDIDATE), F.lit(0))).otherwise(none).alias("_e"))
    fresh = F.filter(_matches(F.col("_rest"), F.col("_e"), CANDIDATE), lambda x: ~_allowed(x["text"]) & _secret(x))
    rows = rows.select("_id", *extra, "_text", F.sort_array(F.concat(F.col("_base"), _spans(fresh, 3))).cast(SPAN).alias("spans"))
    return rows.select(F.col("_id").alias(id_col), *[F.col(f"_c{i}").alias(c) for i, c in enumerate(carry)], "_text", "spans")


def joined(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def redacted(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """The text with every span, overlapping ones as one, replaced by the mark."""
    return _replaced(text, spans, lambda n, inside: F.when(inside, "").otherwise(mark))
