"""Column functions: tokens, hashes, n-gram buckets, sigmoid, logarithm, vector products.  Built-in expressions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from glyphmill.sources.model_file import EOS

#: Fixed: Unicode White_Space, FNV-1a 32 and the word n-gram multiplier.
WHITE_SPACE = "[\\t-\\r \\x85\\p{Z}]+"
FNV_BASIS, FNV_PRIME, NGRAM_FACTOR = 2166136261, 16777619, 116049371
U32 = 0xFFFFFFFF


def tokens(text: Column) -> Column:
    """The words of a text, then the end-of-sentence token; null for null."""
    return F.concat(F.array_remove(F.split(text, WHITE_SPACE, -1), ""), F.array(F.lit(EOS)))


def let(value: Column, use) -> Column:
    """use(value), with value computed once: a lambda variable is a value, not an expression."""
    return F.transform(F.array(value), use)[0]


def _bytes(text: Column) -> Column:
    """For each character its UTF-8 bytes, sign-extended to 32 bits: array of arrays of longs."""
    high = lambda base, x: (x + (base + U32 - 255)).cast("long")

    def of(c: Column) -> Column:
        tail = [high(128, F.shiftright(c, 6 * i).bitwiseAND(F.lit(63))) for i in (2, 1, 0)]
        return (
            F.when(c < 0x80, F.array(c.cast("long"))).when(c < 0x800, F.array(high(0xC0, F.shiftright(c, 6)), tail[2]))
            .when(c < 0x10000, F.array(high(0xE0, F.shiftright(c, 12)), *tail[1:])).otherwise(F.array(high(0xF0, F.shiftright(c, 18)), *tail))
        )

    return F.transform(F.array_remove(F.split(text, ""), ""), lambda c: let(F.ascii(c), of))


def _fnv(raw: Column) -> Column:
    """FNV-1a over sign-extended bytes."""
    step = lambda h, b: (h.bitwiseXOR(b) * F.lit(FNV_PRIME).cast("long")).bitwiseAND(F.lit(U32).cast("long"))
    return F.aggregate(raw, F.lit(FNV_BASIS).cast("long"), step)


def fnv1a(text: Column) -> Column:
    """FNV-1a over UTF-8 bytes, each sign-extended to 32 bits before the xor; a long in 0 .. 2**32 - 1."""
    return _fnv(F.flatten(_bytes(text)))


def _grams(n: Column, minn: int, maxn: int, take) -> Column:
    """take(start, length) of the character n-grams of a marked token of n characters, by start and then length; no single
    characters at either end."""
    lengths = F.sequence(F.lit(max(minn, 1)), F.lit(maxn)) if 0 <= minn and max(minn, 1) <= maxn else F.expr("cast(array() as array<int>)")

    def at(i: Column) -> Column:
        fits = F.filter(lengths, lambda k: (i + k - 1 <= n) & ~((k == 1) & ((i == 1) | (i == n))))
        return F.transform(fits, lambda k: take(i, k))

    return F.flatten(F.transform(F.sequence(F.lit(1), n), at))


def _marked(token: Column) -> Column:
    return F.concat(F.lit("<"), token, F.lit(">"))


def char_ngrams(token: Column, minn: int, maxn: int) -> Column:
    """The character n-grams of <token>, as text."""
    return let(_marked(token), lambda m: _grams(F.length(m), minn, maxn, lambda i, k: F.substring(m, i, k)))


def subword_buckets(token: Column, minn: int, maxn: int, bucket: int) -> Column:
    """The bucket numbers of the character n-grams of <token>: array of longs, hashed in the row."""
    return let(_bytes(_marked(token)), lambda c: _grams(F.size(c), minn, maxn, lambda i, k: _fnv(F.flatten(F.slice(c, i, k))) % F.lit(bucket).cast("long")))


def word_ngram_buckets(hashes: Column, most: int, bucket: int) -> Column:
    """The bucket numbers of the n-grams of 2 .. most consecutive token hashes."""
    none = F.expr("cast(array() as array<bigint>)")

    def of(x: Column) -> Column:
        def at(n: int):
            return lambda i: ngram_bucket([F.get(x, i + j) for j in range(n)], bucket)

        sized = [F.when(F.size(x) >= n, F.transform(F.sequence(F.lit(0), F.size(x) - n), at(n))).otherwise(none) for n in range(2, most + 1)]
        return F.flatten(F.array(*sized)) if sized else none

    return let(hashes, of)


def ngram_bucket(hashes: list[Column], bucket: int) -> Column:
    """The word n-gram hash of consecutive token hashes, modulo bucket, with wrapping 64-bit arithmetic in 32-bit limbs."""
    m = F.lit(U32).cast("long")
    c = F.lit(NGRAM_FACTOR).cast("long")
    hi, lo = F.lit(0).cast("long"), hashes[0]
    for x in hashes[1:]:
        wide = lo * c + x
        hi, lo = (hi * c + F.shiftrightunsigned(wide, 32)).bitwiseAND(m), wide.bitwiseAND(m)
    b = F.lit(bucket).cast("long")
    return ((hi % b) * F.lit((1 << 32) % bucket).cast("long") + lo % b) % b


def std_log(x: Column) -> Column:
    return F.log(x + F.lit(1e-5))


def sigmoid(x: Column) -> Column:
    return F.when(x < -8, F.lit(0.0)).when(x > 8, F.lit(1.0)).otherwise(F.lit(1.0) / (F.lit(1.0) + F.exp(-x)))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def close(a: Column, b: Column, tolerance: float) -> Column:
    """Whether two vectors are as long as each other and nowhere further apart."""
    return (F.size(a) == F.size(b)) & F.forall(F.zip_with(a, b, lambda x, y: F.abs(x.cast("double") - y.cast("double")) < tolerance), lambda x: x)


def near_relative(actual: Column, expected: Column, share: float) -> Column:
    return F.abs(actual - expected) <= expected * share
