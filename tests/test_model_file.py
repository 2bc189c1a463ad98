import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from glyphmill.functions import columns as C
from glyphmill.operators import scoring as S
from glyphmill.plans import models
from glyphmill.plans.queries import quantised_matrix
from glyphmill.sources import errors
from glyphmill.sources.frames import code_frame, codebook_frame
from glyphmill.sources.model_file import huffman, load, load_spark, parse


def model_bytes() -> bytes:
    """A small dense model file in the format."""
    words = [("</s>", 9, 0), ("hello", 5, 0), ("world", 4, 0), ("__label__a", 6, 1), ("__label__b", 3, 1)]
    head = struct.pack("<2i12id", 793712314, 12, 4, 5, 1, 1, 5, 1, 3, 3, 10, 2, 3, 100, 0.5)
    entries = b"".join(w.encode() + b"\0" + struct.pack("<qB", c, k) for w, c, k in words)
    dense = lambda m: struct.pack("<B2q", 0, m, 4) + np.array([models.input_weight(r, j) for r in range(m) for j in range(4)], "<f4").tobytes()
    return head + struct.pack("<3i2q", 5, 3, 2, 27, -1) + entries + dense(13) + dense(2)


def quantised_bytes(qnorm: bool, qout: bool, prune: int) -> bytes:
    m = quantised_matrix()
    words = [("</s>", 9, 0), ("hello", 5, 0), ("world", 4, 0), ("__label__a", 6, 1), ("__label__b", 3, 1)]
    head = struct.pack("<2i12id", 793712314, 12, 8, 5, 1, 1, 5, 1, 1, 3, 10, 2, 3, 100, 0.5)
    pairs = b"".join(struct.pack("<2i", h, h // 2) for h in range(0, 10, 2)) if prune > 0 else b""
    body = struct.pack("<3i2q", 5, 3, 2, 27, 5 if prune > 0 else prune) + b"".join(w.encode() + b"\0" + struct.pack("<qB", c, k) for w, c, k in words) + pairs
    book = lambda b: struct.pack("<4i", b.dim, b.parts, b.width, b.last_width) + b.centroids.astype("<f4").tobytes()

    def matrix(rows: int) -> bytes:
        out = struct.pack("<B2qi", qnorm, rows, 8, rows * 3) + m.codes[:rows].tobytes() + book(m.book)
        return out + (m.norm_codes[:rows].tobytes() + book(m.norm_book) if qnorm else b"")

    dense = struct.pack("<2q", 2, 8) + np.arange(16, dtype="<f4").tobytes()
    return head + body + b"\1" + matrix(13) + (b"\1" + matrix(2) if qout else b"\0" + dense)


def test_dense_file(tmp_path, spark):
    path = tmp_path / "model.bin"
    path.write_bytes(model_bytes() + b"ignored")
    m = load(str(path))
    assert (m.dim, m.nwords, m.nlabels, m.input.rows, m.output.rows, m.labels) == (4, 3, 2, 13, 2, ["__label__a", "__label__b"])
    assert load_spark(spark, str(path)).words == m.words


@pytest.mark.parametrize("qnorm", [False, True])
@pytest.mark.parametrize("qout", [False, True])
@pytest.mark.parametrize("prune", [-1, 0, 1])
def test_quantised_file(qnorm, qout, prune):
    m = parse(quantised_bytes(qnorm, qout, prune))
    want = quantised_matrix()
    rows = np.stack([np.concatenate([want.book.part(p)[want.codes[r, p]] for p in range(3)]) * (want.norm_book.centroids[want.norm_codes[r]] if qnorm else 1) for r in range(13)])
    assert np.allclose(m.input.values, rows)
    assert m.output.values.shape == (2, 8) and len(m.prune) == (5 if prune > 0 else 0)


def test_bad_files():
    good = model_bytes()
    with pytest.raises(errors.InvalidModelError):
        parse(bytes(100))
    with pytest.raises(errors.ModelIOError):
        parse(good[:100])
    with pytest.raises(errors.UnsupportedVersionError) as e:
        parse(struct.pack("<2i", 793712314, 11) + bytes(200))
    assert (e.value.expected, e.value.actual) == (12, 11)
    with pytest.raises(errors.ModelError):
        parse(struct.pack("<2i", 793712314, 12) + b"\xff" * 200)
    with pytest.raises(errors.ModelIOError):
        load("/nowhere/at/all")
    for cut in range(0, len(good), 37):
        with pytest.raises(errors.ModelError):
            parse(good[:cut])


def test_join_form_equals_decoding(spark):
    m = quantised_matrix()
    got = S.decode_rows(code_frame(spark, m), codebook_frame(spark, m.book), codebook_frame(spark, m.norm_book)).orderBy("row_id").collect()
    want = m.book.decode(m.codes) * m.norm_book.part(0)[m.norm_codes, 0][:, None]
    assert np.allclose([r.vec for r in got], want)


def test_huffman():
    assert huffman([7]) == [[]]
    assert [len(p) for p in huffman([8, 4, 2, 1])] == [1, 2, 3, 3]
    assert [len(p) for p in huffman([1, 1, 1, 1])] == [2, 2, 2, 2]
    with pytest.raises(errors.InvalidModelError):
        huffman([])


def test_close(spark):
    df = spark.createDataFrame([([1.0, 2.0], [1.00005, 2.0]), ([1.0], [1.1]), ([1.0], [1.0, 1.0])], "a array<double>, b array<double>")
    assert [r[0] for r in df.select(C.close(F.col("a"), F.col("b"), 1e-4)).collect()] == [True, False, False]


def test_load_time_does_not_grow_with_the_file_per_string():
    import time

    n = 60_000
    head = struct.pack("<2i12id", 793712314, 12, 4, 5, 1, 1, 5, 1, 3, 3, 10, 0, 0, 100, 0.5)
    entries = b"".join(f"word{i}".encode() + b"\0" + struct.pack("<qB", 1, 0) for i in range(n)) + b"__label__a\0" + struct.pack("<qB", 1, 1)
    data = head + struct.pack("<3i2q", n + 1, n, 1, 5, -1) + entries + struct.pack("<B2q", 0, n, 4) + bytes(16 * n) + struct.pack("<B2q", 0, 1, 4) + bytes(16)
    began = time.time()
    assert len(parse(data).words) == n + 1 and time.time() - began < 1
