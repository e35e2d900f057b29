import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

P = pytest.importorskip("public_tokenizers")
tokenizers = pytest.importorskip("tokenizers")

from ledgerlens.llm import bpe, tokenids  # noqa: E402
from ledgerlens.llm.common import new_path  # noqa: E402

ODD = [
    "", "  a  b ", "Straße ΣΑΣ ΟΔΟΣ İstanbul é é ½²③ <|endoftext|> x<|startoftext|>y <|endof", "a\x1cb \x85 c d e don't we'll I'M 12345 </w>",
    "� 日本語テスト 한국어 🎉👩‍👩‍👧 __x__", "a" * 700, "'s's'S '''", "a\0b \0c", "a \n b\n", "\n\na\tb  c ", "x<|endoftext|>", " lead",
]
DOCS = "doc_id long, text string, ids string, start string"


def test_backtracking_equals_the_library():
    path = P.path("word_bpe_49k.json")
    ours, library = bpe.WordBpe(path), tokenizers.Tokenizer.from_file(path)
    rng = random.Random(4)
    made = ["".join(rng.choice("abcdeé THEing'.,1 ") for _ in range(rng.randrange(60))) for _ in range(400)]
    for text in ODD + made:
        ids = library.encode(text, add_special_tokens=False).ids
        assert ours.encode(text).tolist() == ids, text
        assert ours.decode(np.array(ids, np.int64)).decode() == library.decode(ids, skip_special_tokens=False)


def test_pieces_equal_the_library(monkeypatch):
    path = P.path("byte_bpe_50k.json")
    library, rng = tokenizers.Tokenizer.from_file(path), random.Random(6)
    made = ["".join(rng.choice(["a", "b", "é", "à", " ", " ", " ", "\u00a0", "\u3000", "\u2003", "—", "«", ".", "'s", "\n", "\0", "\x85", "12", "word", "x" * 30, "<|endoftext|>", "日"]) for _ in range(rng.randrange(40))) for _ in range(1500)]
    for kept in (250_000, 50):  # with the table of pieces kept, and dropped again and again
        monkeypatch.setattr(tokenids, "KEPT", kept)
        ours = tokenids.PieceEncoder(path)
        for texts in (ODD, ODD, made, made[::-1], [None, "", None], []):
            ids, at = ours.encode(pa.array(texts, pa.string()), 2)
            assert len(at) == len(texts) + 1 and at[-1] == len(ids)
            for text, a, b in zip(texts, at[:-1], at[1:], strict=True):
                assert ids[a:b].tolist() == [*library.encode(text or "", add_special_tokens=False).ids, 2], text


def test_spans_of_boundaries():
    rng = np.random.default_rng(2)
    values = np.cumsum(rng.integers(0, 5000, 3000))
    packed = tokenids.EliasFano(tokenids.EliasFano.pack(values))
    for _ in range(200):
        a, b = sorted(rng.integers(0, 3001, 2).tolist())
        assert packed.span(a, b).tolist() == values[a:b].tolist()


@pytest.mark.parametrize("values", [[], [0], [1], [3, 3, 10, 500, 100_000], list(range(0, 9000, 7)), [0] * 200 + [5]])
def test_elias_fano_round_trip(values):
    packed = tokenids.EliasFano(tokenids.EliasFano.pack(np.array(values, np.int64)))
    assert packed.all().tolist() == values
    assert [packed.select(i) for i in range(len(values))] == values


def test_elias_fano_is_small():
    values = np.cumsum(np.random.default_rng(1).integers(1, 1000, 10_000))
    assert len(tokenids.EliasFano.pack(values)) < 10_000 * 12 / 8 + 1000


def test_written_blocks_read_back(spark):
    library = tokenizers.Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    rows = [(10 - i, t, "x", "y") for i, t in enumerate(ODD)] + [(99, None, "x", "y"), (100, "long " * 30_000, "x", "y"), (100, "long " * 30_000, "x", "y")]
    path = new_path(spark, "test-ids")
    tokenids.write_token_ids(spark.createDataFrame(rows, DOCS), path, P.path("byte_bpe_50k.json"), 2, block_ids=500)
    got = sorted(tuple(r) for r in tokenids.read_token_ids(spark, path).collect())
    start, want = 0, []
    for doc, text, *_ in sorted(rows, key=lambda r: r[0]):
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 2]
        want.append((doc, start, len(ids), np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert [(a, b, c, zlib.crc32(d)) for a, b, c, d in got] == [(a, b, c, zlib.crc32(d)) for a, b, c, d in sorted(want)]


def test_no_rows(spark):
    empty, path = spark.createDataFrame([], DOCS), new_path(spark, "test-none")
    tokenids.write_token_ids(empty, path, P.path("byte_bpe_50k.json"), 2)
    assert tokenids.read_token_ids(spark, path).count() == 0
    words = P.path("word_bpe_49k.json")
    assert bpe.bpe_decode(bpe.bpe_encode(empty, words), words).count() == 0


def test_encode_and_decode_columns(spark):
    path = P.path("word_bpe_49k.json")
    library = tokenizers.Tokenizer.from_file(path)
    rows = [(i, t, "old", "kept") for i, t in enumerate([*ODD, None])]
    made = bpe.bpe_decode(bpe.bpe_encode(spark.createDataFrame(rows, DOCS), path), path).collect()
    assert len(made) == len(rows)
    for r in made:
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        assert (list(r.ids), r.start) == (ids, "kept")
        assert hashlib.sha256(r.decoded.encode()).digest() == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).digest()
