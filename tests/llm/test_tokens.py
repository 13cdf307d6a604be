import base64
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
import tokenizers

from tessera.llm import bpe, rans
from tessera.llm.common import new_path

RANKS, WORDS = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.path("word_bpe_49k.json")


def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_byte_bpe_against_the_library(spark, docs, none, monkeypatch):
    enc = library()
    want = sorted((r[0] or -1, np.array(enc.encode_ordinary(r[1] or ""), "<u4").tobytes(), (r[1] or "").encode()) for r in docs.select("doc_id", "text").collect())
    for size in (10_000_000, 40):  # one block for each task, and many
        got = bpe.decode(bpe.encode(docs, RANKS, public_tokenizers.PATTERN, block_chars=size), RANKS).collect()
        assert sorted((r[0] or -1, bytes(r[1]), bytes(r[2])) for r in got) == want
    key = lambda i: -1 if i is None else i
    want = [(r[0], np.array(enc.encode_ordinary(r[1] or ""), "<u4").tobytes(), (r[1] or "").encode()) for r in docs.select("doc_id", "text").collect()]
    made = {key(r[0]): tuple(r[1:]) for r in bpe.digests(docs, RANKS, public_tokenizers.PATTERN).collect()}
    assert all(made[key(i)] == (len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(text).hexdigest()) for i, ids, text in want)
    assert bpe.digests(none, RANKS, public_tokenizers.PATTERN).count() == 0


def test_pre_tokens_are_those_of_the_whole_text():
    cut = bpe.PreTokenizer(public_tokenizers.PATTERN)
    random.seed(2)
    for _ in range(20_000):
        text = "".join(random.choice("ab1,.'s  \n\t\x1c\x85!é日😀 ") for _ in range(random.randint(0, 16)))
        parts, _, whole = cut.pieces(text, {})
        if not whole:
            assert [w for k, p in enumerate(parts) for w in (cut.words(p) if k else cut.find(p))] == cut.find(text), text


def test_files_against_the_library(spark, docs, none, monkeypatch):
    t = tokenizers.Tokenizer.from_file(WORDS)
    monkeypatch.setattr(rans, "APART", 2)
    folder = new_path(spark, "rans-test")
    blocks = rans.write_ids(docs, folder, WORDS, 2)
    got = rans.read_ids(blocks, folder).collect()
    rows = sorted(docs.select("doc_id", "text").collect(), key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    want, start = [], 0
    for doc_id, text in rows:
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 2]
        want.append((doc_id or -1, start, zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted((r[0] or -1, r[1], zlib.crc32(r[2])) for r in got) == sorted(want)
    assert blocks.agg({"parts": "max"}).first()[0] > 1
    empty = new_path(spark, "rans-test")
    assert rans.read_ids(rans.write_ids(none, empty, WORDS, 2), empty).count() == 0


def test_tokenizer_memo_is_the_library(monkeypatch):
    own = rans.Tokenizer(WORDS, remember=60)
    library = tokenizers.Tokenizer.from_file(WORDS)
    assert own.by_piece
    random.seed(3)
    texts = []
    for _ in range(3000):
        text = "".join(random.choice([*"aAbZé ß'sŚİΣ\u0085\x1c\x1f\n\t 12٣.!?-日😀‍<|endoftext|>reÀÿ÷×ª\x00\x7f", "<|endoftext|>", "<|StartOfText|>", "the", " hello"]) for _ in range(random.randint(0, 20)))
        texts.append(text)
    want = [library.encode(t, add_special_tokens=False).ids for t in texts]
    for size in (4_000_000, 50, 1):
        monkeypatch.setattr(rans, "PIECES_CHARS", size)
        for text, ids, right in zip(texts, own.encode(texts), want):
            assert np.frombuffer(ids, "<u4").tolist() == right, text


def test_tokenizer_merges_each_word_of_many_texts_once(monkeypatch):
    own, merged = rans.Tokenizer(WORDS), []

    class Counted:
        def encode_to_numpy(self, text, **options):
            merged.append(len(text))
            return merge.encode_to_numpy(text, **options)

    merge, own.merge = own.merge, Counted()
    texts = ["Größe und Ähnliches, don't 'STOP' at 12 × 3.", "\u65e5\u672c only", "the quick brown fox's höhle; " * 500, "", "Été ÷ 'llama' THE\tquick\n\nbrown " * 500]
    library = tokenizers.Tokenizer.from_file(WORDS)
    assert [np.frombuffer(ids, "<u4").tolist() for ids in own.encode(texts)] == [library.encode(t, add_special_tokens=False).ids for t in texts]
    texts = [texts[2], *texts[2:4] * 3]  # of ASCII and Latin-1 letters
    merged.clear()
    assert [np.frombuffer(ids, "<u4").tolist() for ids in own.encode(texts)] == [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert 0 < sum(merged) < 200 < sum(map(len, texts))


@pytest.mark.parametrize("n", [0, 1, 700, 60_000])
def test_coder(n):
    ids = np.minimum(np.random.default_rng(n).zipf(1.3, n), 60_000).astype(np.uint32)
    table = rans.Table.scaled(np.bincount(ids))
    assert (rans.Table.from_bytes(table.to_bytes()).freq == table.freq).all()
    data = rans.encode_block(ids, [None, 5], [n, 0], 9, table, apart=16)
    reads = []
    block = rans.Block(lambda at, size: reads.append((at, size)) or data[at : at + size])
    assert block.doc_ids == [None, 5] and block.place == 9
    assert len(block.parts) > 3 or n < 10_000
    for part in reversed(range(len(block.parts))):  # each by itself, in any order
        first, last = block.bounds(part)
        assert (block.decode(table, part) == ids[first:last]).all()
        assert (block.decode(table, part, 5)[:5] == ids[first:last][:5]).all() and len(block.decode(table, part, 5)) <= max(5, block.lanes)
    reads.clear()
    block = rans.Block(lambda at, size: reads.append((at, size)) or data[at : at + size])
    for part in range(len(block.parts)):
        block.decode(table, part)
    assert sum(size for _, size in reads) == len(data)
    wrong = data[:-1] + bytes([data[-1] ^ 1]) if n > 1 else data[:60] + b"x" + data[61:]
    with pytest.raises(ValueError):
        block = rans.Block(lambda at, size: wrong[at : at + size])
        [block.decode(table, k) for k in range(len(block.parts))]
    with pytest.raises(ValueError):
        rans.Block(lambda at, size: (data[: rans.HEAD.size + 3] + b"?" + data[rans.HEAD.size + 4 :])[at : at + size])
    with pytest.raises(ValueError):
        rans.Table.from_bytes(b"x" + table.to_bytes()[1:])
    counts = np.bincount(ids, minlength=2)
    if n > 10_000:
        p = counts[counts > 0] / n
        assert len(data) < 1.15 * n * -(p * np.log2(p)).sum() / 8 + 2048 + len(block.parts) * (rans.PART.size + 8 * block.lanes)
