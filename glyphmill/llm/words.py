"""Vectorised word hashing: whole Arrow batches of texts become flat arrays of 64-bit word hashes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Bytes of UTF-8 hashed at a time; a longer text goes in pieces cut between words.
PIECE = 1 << 20


def fold_table(separators: bytes) -> bytes:
    """For bytes.translate: A-Z to lower case, each separator to a space.  All are ASCII, so UTF-8 stays intact."""
    table = bytearray(range(256))
    for c in range(ord("A"), ord("Z") + 1):
        table[c] = c + 32
    for c in separators:
        table[c] = 32
    return bytes(table)


#: Words are [^\x20\x09-\x0D]+.
SPACED = fold_table(bytes([0x20, *range(0x09, 0x0E)]))
#: Words are [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ once A-Z are lower case.
ALNUM = fold_table(bytes(c for c in range(128) if not chr(c).isalnum()))

_RNG = np.random.default_rng(20240229)
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_P = 0x9E3779B97F4A7C15 | 1
_PINV = pow(_P, -1, 1 << 64)
_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        steps = np.full(max(n, PIECE + 4096), base, dtype=np.uint64)
        steps[0] = 1
        have = _POWERS[base] = np.multiply.accumulate(steps)
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _hash_buffer(buf: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Start bytes and hashes of the space-separated words of a folded buffer."""
    a = np.frombuffer(buf, dtype=np.uint8)
    word = np.zeros(len(a) + 2, dtype=bool)
    word[1:-1] = a != 32
    edge = np.flatnonzero(word[1:] != word[:-1])
    starts, ends = edge[::2], edge[1::2]
    sums = np.zeros(len(a) + 1, dtype=np.uint64)
    np.cumsum(_BYTE[a] * _powers(_P, len(a)), out=sums[1:])
    h = (sums[ends] - sums[starts]) * _powers(_PINV, len(a) + 1)[starts]
    return starts, mix(h + (ends - starts).astype(np.uint64))


def _long(buf: bytes) -> np.ndarray:
    out, at = [], 0
    while at < len(buf):
        end = len(buf)
        if end - at > PIECE:
            cut = buf.rfind(b" ", at, at + PIECE)
            cut = cut if cut > at else buf.find(b" ", at + PIECE)
            end = cut if cut > at else end
        out.append(_hash_buffer(buf[at:end])[1])
        at = end
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def hashed(texts: list[str | None], table: bytes) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, word hashes, offsets) of consecutive rows; row i's words are hashes[offsets[i]:offsets[i + 1]].

    A null text has no words.
    """
    rows: list[bytes] = []
    first = held = 0

    def flush() -> tuple[int, np.ndarray, np.ndarray]:
        starts, h = _hash_buffer(b" ".join(rows))
        at = np.cumsum([0] + [len(r) + 1 for r in rows])
        return first, h, np.searchsorted(starts, at)

    for i, text in enumerate(texts):
        raw = (text or "").encode("utf-8", "replace").translate(table)
        if rows and held + len(raw) > PIECE:
            yield flush()
            rows, held, first = [], 0, i
        if len(raw) > PIECE:
            h = _long(raw)
            yield i, h, np.array([0, len(h)])
            rows, held, first = [], 0, i + 1
        else:
            rows.append(raw)
            held += len(raw) + 1
    if rows:
        yield flush()


def windows(h: np.ndarray, width: int, seed: int = 1) -> np.ndarray:
    """A hash of each run of width consecutive words."""
    n = len(h) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    k = seed * 2 + 1
    for j in range(width):
        k = k * 0xD1342543DE82EF95 + 0x5851F42D4C957F2D & (1 << 64) - 1
        out += h[j : j + n] * np.uint64(k | 1)
    return mix(out)
