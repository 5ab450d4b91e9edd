import zlib

import numpy as np
import pytest

from terrafold.llm import rans
from terrafold.llm.common import HashedTokenizer, row_blocks, utf8, vocabulary


@pytest.mark.parametrize("n, top", [(1, 1), (5, 2), (70_000, 50_257), (200_000, 3), (40_000, 30)])
def test_round_trip(n, top):
    ids = (np.random.default_rng(n).zipf(1.2, n) % top).astype(np.uint32)
    row = rans.encode_segment(ids) | {"n_tokens": n}
    assert (rans.decode_segment(row) == ids).all()


def test_blocks_decode_alone_and_checksums_hold():
    ids = (np.random.default_rng(1).zipf(1.3, 150_000) % 5000).astype(np.uint32)
    row = rans.encode_segment(ids) | {"n_tokens": len(ids)}
    assert row["n_blocks"] > 2
    size = row["block_tokens"]
    assert (rans.decode_segment(row, range(1, 3)) == ids[size : 3 * size]).all()
    damaged = bytearray(row["payload"])
    damaged[len(damaged) // 2] ^= 1
    with pytest.raises(ValueError):
        rans.decode_segment(row | {"payload": bytes(damaged)})
    with pytest.raises(ValueError):
        rans.decode_segment(row | {"payload": bytes(damaged)}, range(row["n_blocks"] // 2, row["n_blocks"] // 2 + 1))


def test_size_is_near_the_entropy():
    ids = (np.random.default_rng(2).zipf(1.4, 300_000) % 40_000).astype(np.uint32)
    p = np.unique(ids, return_counts=True)[1] / len(ids)
    assert len(rans.encode_segment(ids)["payload"]) * 8 <= len(ids) * -(p * np.log2(p)).sum() * 1.01


@pytest.mark.parametrize("name, kind", [("byte_bpe_50k.json", "byte"), ("word_bpe_49k.json", "word")])
def test_cached_ids_are_the_library_s(odd_rows, name, kind):
    tokens = HashedTokenizer(vocabulary(name), kind)
    more = [" a", "a ", "a\n\nb", "a \n b", "a\tb", "don't I'll x's", "a\x1cb", "1,2, ½, a½, é, ×,", "́ x", "<|endoftext|> a", "“a” b.", "a b", "ﬁ ẞ ΑΣ"]
    texts = [r[1] or "" for r in odd_rows] + more
    import pyarrow as pa

    raw, offsets = utf8(pa.array(texts))
    for limit in (40, 1 << 20):
        got = []
        for i, j in row_blocks(offsets, limit):
            ids, bounds = tokens.encode(raw, offsets, i, j)
            got += [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:])]
        assert got == [tokens.whole(t).tolist() for t in texts]


@pytest.mark.parametrize("name, kind", [("byte_bpe_50k.json", "byte"), ("word_bpe_49k.json", "word")])
def test_added_tokens_are_the_plain_library_s(name, kind):
    import pyarrow as pa
    from tokenizers import Tokenizer

    plain, tokens = Tokenizer.from_file(vocabulary(name)), HashedTokenizer(vocabulary(name), kind)
    texts = [
        "some text <|endoftext|> more", "a <|EndOfText|> b", "<|endoftext|>", "<|startoftext|> a<|endoftext|>b", "x <|endof", "text|> y", "<|endoftext|> <|endoftext|>", "é<|endoftext|>é",
        "a <|ENDOFTEXT|> b", "<|startoftext|>", "a <|startoftext|>. b", "", "plain words, here.",
    ]
    raw, offsets = utf8(pa.array(texts))
    for limit in (20, 1 << 20, 20):
        got = []
        for i, j in row_blocks(offsets, limit):
            ids, bounds = tokens.encode(raw, offsets, i, j)
            got += [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:])]
        assert got == [plain.encode(t, add_special_tokens=False).ids for t in texts]


def test_file_of_odd_documents(spark, odd_docs, odd_rows, tmp_path):
    path = f"file://{tmp_path}/tokens"
    rans.write_file(odd_docs, path, vocabulary("byte_bpe_50k.json"), segment_tokens=500)
    got = sorted(((r["doc_id"] is not None, r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"], bytes(r["ids"])) for r in rans.read_documents(spark, path).collect()), key=lambda r: r[2])
    whole = HashedTokenizer(vocabulary("byte_bpe_50k.json"), "byte").whole
    at = 0
    for (_, doc_id, start, n, crc, ids), row in zip(got, sorted(odd_rows, key=lambda r: (r[0] is not None, r[0] or 0)), strict=True):
        want = np.append(whole(row[1] or ""), 2).astype("<u4").tobytes()
        assert (doc_id, start, n, crc, ids) == (row[0], at, len(want) // 4, zlib.crc32(want), want)
        at += n


def test_empty_table(spark, no_docs, tmp_path):
    path = f"file://{tmp_path}/none"
    rans.write_file(no_docs, path, vocabulary("byte_bpe_50k.json"))
    assert rans.read_documents(spark, path).count() == 0
