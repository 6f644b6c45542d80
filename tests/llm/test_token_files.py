"""Simple-8b blocks of token ids: round trips, the tokenizer's own ids, odd rows."""

import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from pagequarry.llm import tokenfiles
from pagequarry.llm.queries import QUERIES

TOKENIZER = open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8").read()


def library_ids(texts):
    tokenizer = Tokenizer.from_str(TOKENIZER)
    tokenizer.encode_special_tokens = True
    return [[*e.ids, 0] for e in tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def expected(rows):
    """doc_id, start, n_tokens, crc of (doc_id, text) in the order of the files, as sets by id."""
    crc = [(d, len(i), zlib.crc32(np.array(i, "<u4").tobytes())) for (d, _), i in zip(rows, library_ids([t for _, t in rows]))]
    return sorted(crc, key=lambda r: (r[0] is not None, r[0] or 0, r[1:]))


@pytest.mark.parametrize("seed", range(5))
def test_blocks_round_trip(seed):
    rng = np.random.default_rng(seed)
    for _ in range(40):
        documents = []
        for n in rng.integers(0, 900, size=rng.integers(0, 6)):
            bits = rng.choice([0, 1, 2, 3, 5, 9, 16, 20, 32, 60, 61, 64], size=n)
            documents.append(np.array([int(rng.integers(0, 2**63)) * 2 >> int(64 - b) for b in bits], np.uint64))
        block = tokenfiles.pack(documents)
        read = tokenfiles.unpack(block)
        assert len(read) == len(documents)
        assert all(np.array_equal(a, b) for a, b in zip(read, documents))


def test_words_hold_as_many_ids_as_fit():
    sizes = {1: 60, 3: 30, 7: 20, 15: 15, 31: 12, 63: 10, 127: 8, 255: 7, 1023: 6, 4095: 5, 32767: 4, 50256: 3, 1 << 29: 2, 1 << 59: 1}
    for value, count in sizes.items():
        block = tokenfiles.pack([np.full(600, value, np.uint64)])
        assert np.frombuffer(block, "<u4", 4, 4)[1] == -(-600 // count)
    with pytest.raises(ValueError, match="not a block"):
        tokenfiles.unpack(b"something else")


def test_ids_are_the_librarys():
    texts = ["a  b", "a\x1c b!\x1cb \x1c", "  \n a\t\n", "x  y   z ", "", None, "　　a 　", "don't 's  'll\x85\x85 x",
             "  \n", "a!\x1d  \x1f?", " a", " a b", "a\n b c", "<|endoftext|> a <|endoftext|>", "x" * 5000, "é  ü",
             "word " * 3000, "漢字 🎉\x00"]
    encode = tokenfiles.Encoder(TOKENIZER, 0)
    for _ in range(2):  # the second time from memory
        assert [x.tolist() for x in encode(texts)] == library_ids(texts)


def test_memory_is_bounded(monkeypatch):
    monkeypatch.setattr(tokenfiles, "REMEMBERED", 8)
    encode = tokenfiles.Encoder(TOKENIZER, 0)
    for k in range(20):
        texts = [f"a{k} b{k} c{k} common d", "common d"]
        assert [x.tolist() for x in encode(texts)] == library_ids(texts)
    assert len(encode.spaced) < 20


def test_memory_is_bounded_within_a_call(monkeypatch):
    monkeypatch.setattr(tokenfiles, "REMEMBERED", 8)
    encode = tokenfiles.Encoder(TOKENIZER, 0)
    texts = [f"a{k} b{k} c{k} common d" for k in range(3 * 512 + 1)]
    assert [x.tolist() for x in encode(texts)] == library_ids(texts)
    assert len(encode.spaced) < 3 * 512


def test_query_gives_every_documents_ids(spark, data):
    rows = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()
    got = sorted(QUERIES["op12_token_files"](spark, data).collect(), key=lambda r: r.doc_id)
    assert [(r.doc_id, r.n_tokens, r.ids_crc32) for r in got] == expected([(r.doc_id, r.text) for r in rows])
    assert [r.start for r in got] == [0, *np.cumsum([r.n_tokens for r in got])[:-1].tolist()]


def test_odd_rows_and_files_of_several_blocks(spark, odd_docs, no_docs, tmp_path, monkeypatch):
    rows = odd_docs.collect()
    made = tokenfiles.token_files(odd_docs, TOKENIZER).collect()
    key = lambda r: (r[0] is not None, r[0] or 0, r[1:])
    assert sorted([(r.doc_id, r.n_tokens, r.ids_crc32) for r in made], key=key) == expected([(r.doc_id, r.text) for r in rows])
    in_order = sorted(made, key=lambda r: r.start)
    assert [r.start for r in in_order] == [0, *np.cumsum([r.n_tokens for r in in_order])[:-1].tolist()]
    ids = [r.doc_id for r in in_order]
    assert ids == sorted(ids, key=lambda x: (x is not None, x or 0))
    assert tokenfiles.token_files(no_docs, TOKENIZER).collect() == []
    tokenfiles.write(odd_docs, TOKENIZER, f"{tmp_path}/ids", end=7)
    whole = sorted(tokenfiles.read(spark, f"{tmp_path}/ids").collect(), key=lambda r: r.start)
    assert all(r.ids[-1] == 7 and len(r.ids) == r.n_tokens for r in whole)
    assert [r.start for r in whole] == [r.start for r in in_order]
