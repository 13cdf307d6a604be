"""Byte-level BPE encoding and decoding by a global distinct-word shuffle.

Texts are stored in blocks, compressed. The pre-tokens of a block are exploded to its
distinct words; all blocks' words are shuffled by hash buckets of words, so that one
task sees every block's words of a bucket and runs the merges once for each distinct
word. The ids go back to the blocks, and each text is reassembled from its block's by walking
its pre-tokens in order of position. Decoding joins the token-byte table, whose size the
vocabulary fixes.

What is shuffled travels packed, a row for each block and bucket, and positions are not
shuffled: a text is a sequence of pre-tokens, and the walk over it gives them in order again.
As rows of document, position and word the 31 million pre-tokens of the 0.1 GB check table
would be some 0.6 GB to shuffle, six times the input, and as much again on the ids' way back;
packed words and ids are about half the input.
"""

from __future__ import annotations

import base64
import pickle
import uuid
import zlib
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
import tiktoken
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import bound_batches, lean, new_path, shuffle_partitions, stage
from tessera.llm.files import Attempt, filesystem

BLOCK_CHARS = 10_000_000  # of text whose distinct words are looked up together
CHUNK_CHARS = 1_000_000  # of text compressed into one row
BUCKETS = 4  # of words for each shuffle partition


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines) }


class WordEncoder:
    """Ids of one pre-token, as little-endian unsigned 32-bit integers."""

    def __init__(self, path: str, pattern: str):
        self._encode = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=load_ranks(path), special_tokens={})._core_bpe.encode_single_piece

    def __call__(self, word: str) -> bytes:
        return array("I", self._encode(word.encode())).tobytes()


class PreTokenizer:
    """Cuts texts at single spaces first. A single space between two characters that
    are not white space always begins a pre-token, and no pre-token looks past the
    end of such a piece; so a piece is matched once and remembered. Texts with other
    spaces are matched as a whole."""

    def __init__(self, pattern: str):
        self.find = regex.compile(pattern).findall
        # letters with a space before them, and a comma or full stop after letters, are
        # pre-tokens of this well-known pattern; others are always matched
        self.plain = pattern.endswith(r"| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
        self.loose: set[str] = set()  # pieces that show that their text has other spaces

    def pieces(self, text: str, seen) -> tuple[list[str], set[str], bool]:
        """The text cut at spaces, pieces that are not yet ``seen``, and whether the text
        must be matched as a whole."""
        parts = text.split(" ")
        new = {p for p in parts if p not in seen}
        for p in new:
            if not p or p[0].isspace() or p[-1].isspace():
                self.loose.add(p)
        return parts, new, bool(self.loose) and not self.loose.isdisjoint(parts)

    def words(self, piece: str) -> list[str]:
        """Pre-tokens of a piece and the space before it."""
        if self.plain:
            if piece.isalpha():
                return [" " + piece]
            if piece[-1] in ",." and piece[:-1].isalpha():
                return [" " + piece[:-1], piece[-1]]
        return self.find(" " + piece)


def _blocks(batches: Iterable[pa.RecordBatch], most: int) -> Iterator[tuple[int, list, list[str]]]:
    """(block, doc_ids, texts): pieces of the stream, in order; blocks are numbered by
    task and hold about ``most`` code points of text."""
    block, chars = TaskContext.get().partitionId() << 24, 0
    for batch in batches:
        ids, texts = batch.column(0).to_pylist(), [t or "" for t in batch.column(1).to_pylist()]
        at = 0
        for k, text in enumerate(texts):
            chars += len(text)
            if chars >= most:
                yield block, ids[at : k + 1], texts[at : k + 1]
                at, block, chars = k + 1, block + 1, 0
        if at < len(texts):
            yield block, ids[at:], texts[at:]


def _pack(value) -> bytes:
    return zstandard.compress(pickle.dumps(value, 5), 3)


def _unpack(data: bytes):
    return pickle.loads(zstandard.decompress(data))


def _store(folder: str, most: int):
    """Writes texts in compressed chunks of blocks to a file for each task, and gives where they
    are: rows that appear only when the file is whole, and name the file of their own attempt."""

    def run(batches):
        out, rows, seq = None, [], 0
        for block, ids, texts in _blocks(batches, most):
            at = chars = 0
            for k in range(len(texts)):
                chars += len(texts[k])
                if chars >= CHUNK_CHARS or k + 1 == len(texts):
                    out = out or Attempt(folder, f"texts-{uuid.uuid4().hex}")
                    data = _pack((ids[at : k + 1], texts[at : k + 1]))
                    rows.append({"block": block, "seq": (seq := seq + 1), "path": out.uri, "offset": out.write(data), "length": len(data)})
                    at, chars = k + 1, 0
        if out:
            out.close()
            yield pa.RecordBatch.from_pylist(rows)

    return run


def _read(batch: pa.RecordBatch) -> Iterator[tuple[int, list, list[str]]]:
    """(block, doc_ids, texts) of each stored chunk."""
    for row in batch.select(["block", "path", "offset", "length"]).to_pylist():
        system, path = filesystem(row["path"])
        with system.open_input_file(path) as file:
            ids, texts = _unpack(file.read_at(row["length"], row["offset"]))
        yield row["block"], ids, texts


def _distinct_words(pattern: str, buckets: int):
    def run(batches):
        cut = PreTokenizer(pattern)
        now, words, seen = None, set(), set()

        def rows():
            dealt: dict[int, list[str]] = {}
            for word in words:
                dealt.setdefault(zlib.crc32(word.encode()) % buckets, []).append(word)
            if dealt:
                data = [_pack(sorted(part)) for part in dealt.values()]
                yield pa.record_batch({"bucket": pa.array(dealt.keys(), pa.int32()), "block": pa.array([now] * len(data), pa.int64()), "words": pa.array(data, pa.binary())})

        for batch in batches:
            for block, _, texts in _read(batch):
                if block != now:
                    yield from rows()
                    now, words, seen = block, set(), set()
                for text in texts:
                    parts, new, whole = cut.pieces(text, seen)
                    if whole:
                        words.update(cut.find(text))
                        continue
                    seen |= new
                    words.update(cut.find(parts[0]))
                    for p in new:
                        words.update(cut.words(p))
        yield from rows()

    return run


def _encode_words(path: str, pattern: str):
    def run(batches):
        encode, now, known = WordEncoder(path, pattern), None, {}
        for batch in batches:
            buckets, data = batch.column("bucket").to_pylist(), []
            for bucket, packed in zip(buckets, batch.column("words")):
                if bucket != now:
                    now, known = bucket, {}
                words = _unpack(packed.as_py())
                for word in words:
                    if word not in known:
                        known[word] = encode(word)
                data.append(_pack((words, [known[w] for w in words])))
            yield pa.record_batch({"block": batch.column("block"), "words": pa.array(data, pa.binary())})

    return run


def _assemble(pattern: str):
    def run(batches):
        cut = PreTokenizer(pattern)
        now, ids_of, known = None, {}, {}

        def ids(words: list[str]) -> bytes:
            return b"".join(map(ids_of.__getitem__, words))  # its words have met every block

        for batch in batches:
            for k, (block, seq) in enumerate(zip(batch.column("block").to_pylist(), batch.column("seq").to_pylist())):
                if block != now:
                    now, ids_of, known = block, {}, {}
                if seq == 0:
                    ids_of.update(zip(*_unpack(batch.column("words")[k].as_py())))
                    continue
                ((_, doc_ids, texts),) = _read(batch.slice(k, 1))
                for at in range(0, len(texts), 128):
                    out = []
                    for text in texts[at : at + 128]:
                        parts, new, whole = cut.pieces(text, known)
                        if whole:
                            out.append(ids(cut.find(text)))
                            continue
                        for p in new:
                            known[p] = ids(cut.words(p))
                        out.append(ids(cut.find(parts[0])) + b"".join(map(known.__getitem__, parts[1:])))
                    yield pa.record_batch({"doc_id": pa.array(doc_ids[at : at + 128], pa.int64()), "ids": pa.array(out, pa.binary())})

    return run


def _decode(path: str):
    def run(batches):
        ranks = load_ranks(path)
        table: list[bytes] = [b""] * (max(ranks.values(), default=-1) + 1)
        known = np.zeros(len(table), bool)
        for token, rank in ranks.items():
            table[rank], known[rank] = token, True
        sizes = np.array([len(t) for t in table], np.int64)
        starts = np.cumsum(sizes) - sizes
        flat = np.frombuffer(b"".join(table), np.uint8)

        def text(data: bytes) -> bytes:
            out = []
            for at in range(0, len(data) // 4, 1 << 16):
                ids = np.frombuffer(data, "<u4", min(1 << 16, len(data) // 4 - at), 4 * at)
                if not known[ids].all():
                    raise ValueError("an id is not in the table")
                own = sizes[ids]
                ends = np.cumsum(own)
                out.append(flat[np.arange(ends[-1]) + np.repeat(starts[ids] - ends + own, own)].tobytes())
            return b"".join(out)

        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = [text(i.as_py() or b"") for i in part.column("ids")]
                yield pa.record_batch({"doc_id": part.column("doc_id"), "ids": part.column("ids"), "bytes": pa.array(texts, pa.binary())})

    return run


ENCODED = "doc_id long, ids binary"
DECODED = "doc_id long, ids binary, bytes binary"


def _encoded(docs: DataFrame, path: str, pattern: str, block_chars: int) -> DataFrame:
    """Rows (block, seq, words, path, offset, length) from which ``_assemble`` makes the ids:
    of each block the packed words with their ids (seq 0), then where its texts are. Texts are
    read from what was stored once, so a task that runs again finds the same blocks."""
    spark = docs.sparkSession
    bound_batches(spark)
    n = shuffle_partitions(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    stored = stage(rows.mapInArrow(lean(_store(new_path(spark, "bpe-texts"), block_chars)), "block long, seq long, path string, offset long, length long"), "bpe-blocks")
    dealt = stored.repartition(n, "block").sortWithinPartitions("block", "seq")
    words = dealt.mapInArrow(lean(_distinct_words(pattern, BUCKETS * n)), "bucket int, block long, words binary")
    coded = words.repartition(n, "bucket").sortWithinPartitions("bucket").mapInArrow(lean(_encode_words(path, pattern)), "block long, words binary").withColumn("seq", F.lit(0).cast("long"))
    return coded.unionByName(stored, allowMissingColumns=True).repartition(n, "block").sortWithinPartitions("block", "seq")


def encode(docs: DataFrame, path: str, pattern: str, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(doc_id, ids) for each row of ``docs`` (doc_id, text; other columns are ignored):
    ids of the whole text as little-endian unsigned 32-bit integers, each match of
    ``pattern`` encoded separately by the rank file ``path``, no special tokens.

    Null and empty texts have no ids (an empty binary). Rows with equal or null
    doc_id are each encoded. An empty table gives an empty result. Words are looked up for
    blocks of ``block_chars``: larger ones shuffle less and take more memory."""
    return _encoded(docs, path, pattern, block_chars).mapInArrow(lean(_assemble(pattern)), ENCODED)


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids, bytes) for each row of ``encoded`` (doc_id, ids): the join of ids
    with the token-byte table of the rank file, in order. Null ids count as none; an
    id that the table lacks is an error."""

    return encoded.select("doc_id", "ids").mapInArrow(_decode(path), DECODED)


def round_trip(docs: DataFrame, path: str, pattern: str, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """``decode`` of ``encode``: (doc_id, ids, bytes), both steps in one process of a task."""
    assemble, back = _assemble(pattern), _decode(path)
    return _encoded(docs, path, pattern, block_chars).mapInArrow(lean(lambda batches: back(assemble(batches))), DECODED)


def digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """Per document: number of ids and SHA-256 of ids and of the decoded bytes."""
    return round_trip(docs, path, pattern).select(
        "doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("bytes", 256).alias("decoded_sha256")
    )


def op4_byte_bpe(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return digests(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
