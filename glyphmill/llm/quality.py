"""Quality rules as a bitmask ledger.

``ledger`` evaluates every rule once per row and stores the measurements and one failure bit per rule;
``apply_policy`` turns the bits into a verdict under a versioned policy (a mask of rules that reject), and
``ablations`` says, from the bits alone, how many rows each rule of a policy rejects by itself.  Rows are
independent: the ledger is one projection without a shuffle, the ablations one aggregate with partial sums.

Null or empty text: no words, so it fails ``few_words``.  Repeated rows are judged alike; columns other than the id and
the text are not read; an empty table gives an empty ledger, and no ablations.  Very long texts are measured whole, by one sort of their windows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed: the characters that separate words, and those counted as symbols.
SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"

#: Rule name to failure condition over the measurements; the place in this list is the bit.
RULES: list[tuple[str, str]] = [
    ("few_words", "n_words < 50"),
    ("repeated_words", "100 * n_repeat_words > 50 * n_words"),
    ("symbols", "100 * n_symbols > 20 * n_words"),
    ("repeated_lines", "n_lines >= 5 AND 100 * n_dup_lines > 50 * n_lines"),
    ("long_words", "word_chars > 14 * n_words"),
    ("short_words", "word_chars < 2 * n_words"),
]
BIT = {name: 1 << i for i, (name, _) in enumerate(RULES)}


@dataclass(frozen=True)
class Policy:
    version: str
    rejects: tuple[str, ...]

    @property
    def mask(self) -> int:
        return sum(BIT[r] for r in self.rejects)


BASE = Policy("base", ("few_words", "repeated_words"))
PRODUCTION = Policy("2024-1", ("few_words", "repeated_words", "symbols", "repeated_lines", "long_words", "short_words"))


def _let(value: Column, use) -> Column:
    """use(value), with value computed once: a lambda variable is a value, not an expression."""
    return F.transform(F.array(value), use)[0]


def _repeats(words: Column) -> Column:
    """Words that lie in a 3-word window found twice or more: sort the windows, keep neighbours that are equal."""

    def covered(sorted_: Column) -> Column:
        pairs = F.zip_with(
            F.slice(sorted_, F.lit(1), F.size(sorted_) - 1),
            F.slice(sorted_, F.lit(2), F.size(sorted_) - 1),
            lambda a, b: F.when(a["w"] == b["w"], F.array(a["i"], a["i"] + 1, a["i"] + 2, b["i"], b["i"] + 1, b["i"] + 2)),
        )
        return F.size(F.array_distinct(F.flatten(F.filter(pairs, lambda p: p.isNotNull()))))

    def of(w: Column) -> Column:
        n = F.size(w) - 2
        two = F.zip_with(F.slice(w, F.lit(1), n), F.slice(w, F.lit(2), n), lambda a, b: F.concat(a, F.lit(" "), b))
        three = F.zip_with(two, F.slice(w, F.lit(3), n), lambda a, b: F.concat(a, F.lit(" "), b))
        return _let(F.sort_array(F.transform(three, lambda x, i: F.struct(x.alias("w"), i.alias("i")))), covered)

    return F.when(F.size(words) < 4, F.lit(0)).otherwise(_let(words, of))


def ledger(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words (long), failed_bits (long)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = df.select(F.col(id_col).alias(id_col), text.alias("_t"))
    words = F.array_remove(F.split(F.translate("_t", SPACES, " " * len(SPACES)), " ", -1), "")
    lines = F.filter(F.split("_t", "\n", -1), lambda x: F.length(F.translate(x, SPACES, "")) > 0)
    rows = rows.select(id_col, "_t", words.alias("_w"), lines.alias("_l"))
    length = F.length("_t")
    rows = rows.select(
        id_col,
        F.size("_w").cast("long").alias("n_words"),
        F.length(F.translate("_t", SPACES, "")).cast("long").alias("word_chars"),
        (length - F.length(F.translate("_t", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        F.size("_l").cast("long").alias("n_lines"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        _repeats(F.col("_w")).cast("long").alias("n_repeat_words"),
    )
    bits = F.lit(0).cast("long")
    for name, fails in RULES:
        bits = bits.bitwiseOR(F.when(F.expr(fails), F.lit(BIT[name])).otherwise(F.lit(0)).cast("long"))
    return rows.withColumn("failed_bits", bits)


def fails(policy: Policy) -> Column:
    return F.col("failed_bits").bitwiseAND(F.lit(policy.mask).cast("long")) != 0


def apply_policy(rows: DataFrame, policy: Policy = PRODUCTION) -> DataFrame:
    """The ledger with policy (its version) and kept."""
    return rows.withColumn("policy", F.lit(policy.version)).withColumn("kept", ~fails(policy))


def ablations(rows: DataFrame, policy: Policy = PRODUCTION) -> DataFrame:
    """rule, n_failed, n_only: rows that fail the rule, and rows that the policy would keep without it."""
    mask = F.col("failed_bits").bitwiseAND(F.lit(policy.mask).cast("long"))
    counts = rows.groupBy(mask.alias("bits")).agg(F.count("*").alias("n"))  # at most one row per mask
    rules = F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(BIT[r]).cast("long").alias("bit")) for r in policy.rejects])).alias("r")
    each = counts.select("bits", "n", rules).select("bits", "n", "r.rule", "r.bit")
    has = F.col("bits").bitwiseAND(F.col("bit")) != 0
    return each.groupBy("rule").agg(
        F.sum(F.when(has, F.col("n")).otherwise(0)).alias("n_failed"),
        F.sum(F.when(F.col("bits") == F.col("bit"), F.col("n")).otherwise(0)).alias("n_only"),
    )
