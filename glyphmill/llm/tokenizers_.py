"""SentencePiece BPE encoding and decoding, and byte-level BPE token counts.

The driver reads a vocabulary file and broadcasts its entries (a file of a fixed vocabulary: megabytes, whatever the
input); workers build the pair table once.  Texts are cut into words that no piece crosses; each distinct
word is merged once per task (``bpe``) and remembered in a table of bounded size, which goes at the task's end, for workers live on.  A long text goes in pieces cut
between words, so a worker holds one text and one piece of it.  Rows are independent: no shuffle.

Null text: as the empty text.  Repeated rows get equal results; an empty table gives an empty result; columns other
than id and text are not read.
"""

from __future__ import annotations

import codecs
import contextlib
import ctypes
import hashlib
import json
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphmill.llm.bpe import Pairs, merge_words

PIECE_CHARS = 1 << 19
GROUP_CHARS = 1 << 22
CACHE_WORDS, CACHE_CHARS = 400_000, 40
MARK = "▁"
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6

codecs.register_error("each-byte", lambda e: ("�" * (e.end - e.start), e.end))


class Cache:
    """word to value; when full, only the words of the group at hand stay.  Long words are not kept."""

    def __init__(self, encode: Callable[[list[str]], list]):
        self.encode, self.known = encode, {}

    def of(self, words: list[str]) -> list:
        try:
            return list(map(self.known.__getitem__, words))
        except KeyError:
            pass
        new = [w for w in dict.fromkeys(words) if w not in self.known]
        if len(self.known) + len(new) > CACHE_WORDS:  # what this group knows already is what texts have in common
            self.known = {w: self.known[w] for w in words if w in self.known}
        self.known.update(zip(new, self.encode(new), strict=True))
        found = list(map(self.known.__getitem__, words))
        for w in new:
            if len(w) > CACHE_CHARS:
                del self.known[w]
        return found

    def forget(self) -> None:
        self.known = {}


def give_back() -> None:
    """Freed memory goes back to the system, where the C library can do that: other tasks' workers need it."""
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def groups(texts: list[str]) -> Iterator[list[str]]:
    """Consecutive texts of about GROUP_CHARS characters together, so that their new words are merged in one go."""
    group, held = [], 0
    for t in texts:
        group.append(t)
        held += len(t)
        if held >= GROUP_CHARS:
            yield group
            group, held = [], 0
    if group:
        yield group


def learn(cache: Cache, words: re.Pattern, texts: list[str]) -> None:
    """Merges the words of texts that the cache lacks; longer texts and words are left to their turn."""
    new: set[str] = set()
    for t in texts:
        new.update(words.findall(t))
    cache.of([w for w in new if len(w) <= CACHE_CHARS])


def pieces(text: str, boundary: re.Pattern) -> Iterator[str]:
    """The text, cut at a boundary (its second character starts a piece) about every PIECE_CHARS characters."""
    at = 0
    while len(text) - at > PIECE_CHARS:
        cut = boundary.search(text, at + PIECE_CHARS - 1)
        if not cut:
            break
        yield text[at : cut.start() + 1]
        at = cut.start() + 1
    yield text[at:] if at else text


class SentencePieceBpe:
    """Encodes and decodes as the library does for a BPE model with identity normalisation and byte fallback."""

    WORDS = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
    LINES = re.compile(f"{MARK}*[^{MARK}\\n]+|{MARK}+|\\n")
    ALONE = re.compile(r"(?!)")
    BOUNDARY = re.compile(f"[^{MARK}]{MARK}")

    def __init__(self, vocabulary: list[tuple[str, float, int]], bos: int, eos: int, dummy_prefix: bool):
        self.bos, self.eos, self.dummy_prefix = bos, eos, dummy_prefix
        self.id = {p: i for i, (p, _, kind) in enumerate(vocabulary) if kind == NORMAL}
        self.byte = {int(p[3:5], 16): i for i, (p, _, kind) in enumerate(vocabulary) if kind == BYTE}
        self.size = len(vocabulary)
        split = not any(re.search(f"[^{MARK}]{MARK}", p) for p in self.id)
        lines = not any("\n" in p for p in self.id)  # then nothing merges with a line's end
        self.words = (self.LINES if lines else self.WORDS) if split else re.compile("(?s).+")
        self.boundary = self.BOUNDARY if split else self.ALONE
        # a character that is no piece has a symbol above all pieces
        self.of_point = np.arange(self.size, self.size + 0x110000)
        for p, i in self.id.items():
            if len(p) == 1:
                self.of_point[ord(p)] = i
        self.symbol = {c: self.size + ord(c) for p in self.id for c in p} | self.id
        scores = sorted({s for p, s, kind in vocabulary if kind == NORMAL}, reverse=True)
        place = {s: i for i, s in enumerate(scores)}
        rows = [(self.symbol[p[:k]], self.symbol[p[k:]], place[score], i) for i, (p, score, kind) in enumerate(vocabulary) if kind == NORMAL for k in range(1, len(p)) if p[:k] in self.symbol and p[k:] in self.symbol]
        left, right, rank, merged = np.array(rows or [(0, 0, 0, 0)], np.int64).T
        self.pairs = Pairs(left, right, rank, merged, ordered=False)
        self.cache = Cache(self._encode)
        surface = {NORMAL: lambda p: p.replace(MARK, " ").encode(), BYTE: lambda p: bytes([int(p[3:5], 16)]), CONTROL: lambda p: b"", UNKNOWN: lambda p: " ⁇ ".encode()}
        self.surface = [surface.get(kind, surface[NORMAL])(p) for p, _, kind in vocabulary]

    def _encode(self, words: list[str]) -> list[bytes]:
        if not words:
            return []
        points = np.frombuffer("".join(words).encode("utf-32-le"), "<u4")
        sym, sizes = merge_words(self.of_point[points], np.array([len(w) for w in words]), self.pairs)
        raw, ends = sym.astype("<u4").tobytes(), (4 * np.cumsum(sizes)).tolist()
        out = [raw[a:b] for a, b in zip([0, *ends], ends, strict=False)]
        odd = np.repeat(np.arange(len(words)), sizes)[sym >= self.size]
        for w in np.unique(odd).tolist():
            out[w] = self._with_bytes(np.frombuffer(out[w], "<u4").tolist())
        return out

    def _with_bytes(self, symbols: list[int]) -> bytes:
        """Symbols that are no pieces become the byte pieces of their character."""
        ids = [x for s in symbols for x in ([s] if s < self.size else [self.byte[b] for b in chr(s - self.size).encode()])]
        return np.array(ids, "<u4").tobytes()

    def normal(self, text: str) -> str:
        return (MARK if self.dummy_prefix and text else "") + text.replace(" ", MARK)

    def forget(self) -> None:
        self.cache.forget()

    def prepare(self, texts: list[str]) -> None:
        learn(self.cache, self.words, [self.normal(t) for t in texts if len(t) <= PIECE_CHARS])

    def encode(self, text: str) -> Iterator[bytes]:
        """Little-endian 32-bit ids, in parts, with begin and end ids."""
        yield np.array([self.bos], "<u4").tobytes()
        for part in pieces(self.normal(text), self.boundary):
            yield b"".join(self.cache.of(self.words.findall(part)))
        yield np.array([self.eos], "<u4").tobytes()

    def decode(self, parts: Iterator[bytes]) -> Iterator[bytes]:
        """UTF-8 of the text, in parts; the first space of the first piece that has text is the dummy prefix."""
        fresh, rest = self.dummy_prefix, b""
        for part in parts:
            raw = b"".join([self.surface[i] for i in np.frombuffer(part, "<u4").tolist()])
            if fresh and raw:
                raw, fresh = raw.removeprefix(b" "), False
            yield (rest + raw).decode("utf-8", "each-byte").encode()

    def rows(self, text: str) -> tuple[int, str, str]:
        n, ids, back = 0, hashlib.sha256(), hashlib.sha256()

        def noted() -> Iterator[bytes]:
            nonlocal n
            for part in self.encode(text):
                n += len(part) // 4
                ids.update(part)
                yield part

        for part in self.decode(noted()):
            back.update(part)
        return n, ids.hexdigest(), back.hexdigest()

    def count(self, text: str) -> int:
        return sum(len(p) for p in self.encode(text)) // 4 - 2


class ByteBpe:
    """Counts the tokens of a byte-level BPE with the GPT-2 split, as the library does with its defaults."""

    SPLIT = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
    #: Fixed: the characters with the property White_Space.
    SPACE = "\t-\r \x85\xa0  -     　"
    WORDS = re.compile(f"[{SPACE}]*[^{SPACE}]+|[{SPACE}]+")
    BOUNDARY = re.compile(f"[^{SPACE}][{SPACE}]")

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], special: list[str]):
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        shown = {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in set(plain))}
        self.byte = np.array([vocab[shown[b]] for b in range(256)])
        made: dict[str, int] = {}
        ordered = True
        for r, (a, b) in enumerate(merges):
            ordered &= a + b not in made and made.get(a, -1) < r and made.get(b, -1) < r
            made[a + b] = r
        self.pairs = Pairs([vocab[a] for a, _ in merges], [vocab[b] for _, b in merges], range(len(merges)), [vocab[a + b] for a, b in merges], ordered)
        self.special = re.compile("|".join(map(re.escape, sorted(special, key=len, reverse=True)))) if special else None
        self.parts = Cache(self._merge)
        self.cache = Cache(self._encode)

    def _merge(self, tokens: list[str]) -> list[int]:
        if not tokens:
            return []
        raw = [t.encode() for t in tokens]
        sym = self.byte[np.frombuffer(b"".join(raw), np.uint8)]
        return merge_words(sym, np.array([len(r) for r in raw]), self.pairs)[1].tolist()

    def _encode(self, words: list[str]) -> list[int]:
        split = [self.SPLIT.findall(w) for w in words]
        flat = iter(self.parts.of([t for s in split for t in s]))
        return [sum(next(flat) for _ in s) for s in split]

    def forget(self) -> None:
        self.cache.forget()
        self.parts.forget()

    def prepare(self, texts: list[str]) -> None:
        learn(self.cache, self.WORDS, [t for t in texts if len(t) <= PIECE_CHARS])

    def count(self, text: str) -> int:
        n = 0
        if self.special and (found := len(self.special.findall(text))):
            n, texts = found, self.special.split(text)
        else:
            texts = [text]
        for t in texts:
            for part in pieces(t, self.BOUNDARY):
                n += sum(self.cache.of(self.WORDS.findall(part)))
        return n


def read_vocabulary(path: str) -> tuple:
    """(kind, arguments) of the encoder for a .model or .json file, read on the driver."""
    if path.endswith(".model"):
        from sentencepiece import sentencepiece_model_pb2 as pb

        m = pb.ModelProto()
        with open(path, "rb") as f:
            m.ParseFromString(f.read())
        n = m.normalizer_spec
        if m.trainer_spec.model_type != 2 or n.precompiled_charsmap or n.remove_extra_whitespaces or m.trainer_spec.treat_whitespace_as_suffix or not m.trainer_spec.byte_fallback or any(p.type not in (NORMAL, UNKNOWN, CONTROL, BYTE) for p in m.pieces):
            raise ValueError("a BPE model with byte fallback and identity normalisation is needed")
        return "pieces", ([(p.piece, p.score, p.type) for p in m.pieces], m.trainer_spec.bos_id, m.trainer_spec.eos_id, n.add_dummy_prefix)
    with open(path, encoding="utf-8") as f:
        j = json.load(f)
    pre = j["pre_tokenizer"] or {}
    if j["model"]["type"] != "BPE" or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or j.get("normalizer"):
        raise ValueError("a byte-level BPE without prefix space or normaliser is needed")
    merges = [tuple(m.split(" ", 1)) if isinstance(m, str) else tuple(m) for m in j["model"]["merges"]]
    special = [t["content"] for t in j["added_tokens"]]
    return "bytes", (j["model"]["vocab"] | {t["content"]: t["id"] for t in j["added_tokens"]}, merges, special)


_BUILT: dict[str, object] = {}


def encoder(kind: str, args: tuple, name: str):
    """Built once in each worker."""
    if name not in _BUILT:
        _BUILT.clear()
        _BUILT[name] = (SentencePieceBpe if kind == "pieces" else ByteBpe)(*args)
    return _BUILT[name]


def _map(df: DataFrame, path: str, id_col: str, text_col: str, schema: str, row: Callable) -> DataFrame:
    kind, args = read_vocabulary(path)
    shared = df.sparkSession.sparkContext.broadcast((kind, args, f"{path}:{hash(str(args[0])[:100000])}"))
    names = [s.split()[0] for s in schema.split(",")]
    types = {"bigint": pa.int64(), "string": pa.string(), "boolean": pa.bool_()}
    kinds = [types[s.split()[1]] for s in schema.split(",")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(*shared.value)
        try:
            for batch in batches:
                found = []
                for group in groups([t or "" for t in batch.column(1).to_pylist()]):
                    enc.prepare(group)
                    found += [row(enc, t) for t in group]
                columns = list(zip(*found, strict=True)) if found else [[] for _ in names]
                yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]], names=["_id", *names])
        finally:
            enc.forget()
            give_back()

    rows = df.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    key = rows.schema["_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"_id {key}, {schema}").withColumnRenamed("_id", id_col)


def sentencepiece_round_trip(df: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_tokens, ids_sha256, decoded_sha256 of encoding with begin and end ids, and decoding those ids."""
    return _map(df, model, id_col, text_col, "n_tokens bigint, ids_sha256 string, decoded_sha256 string", lambda e, t: e.rows(t))


def sentencepiece_ids(df: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, ids (array of int), decoded: the encoding and its decoding themselves."""
    kind, args = read_vocabulary(model)
    shared = df.sparkSession.sparkContext.broadcast((kind, args, f"{model}:{hash(str(args[0])[:100000])}"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(*shared.value)
        try:
            for batch in batches:
                parts = [list(enc.encode(t.as_py() or "")) for t in batch.column(1)]
                ids = pa.array([np.frombuffer(b"".join(p), "<u4").astype(np.int32) for p in parts], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([batch.column(0), ids, pa.array([b"".join(enc.decode(iter(p))).decode() for p in parts], pa.string())], names=["_id", "ids", "decoded"])
        finally:
            enc.forget()
            give_back()

    rows = df.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    key = rows.schema["_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"_id {key}, ids array<int>, decoded string").withColumnRenamed("_id", id_col)


def count_tokens(df: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 512) -> DataFrame:
    """id, n_bytes, n_tokens, over_limit."""

    def row(enc, text: str) -> tuple[int, int, bool]:
        n = enc.count(text)
        return len(text.encode()), n, n > limit

    return _map(df, vocabulary, id_col, text_col, "n_bytes bigint, n_tokens bigint, over_limit boolean", row)
