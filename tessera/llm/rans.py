"""Token ids in binary files, packed by a static range asymmetric numeral system.

One frequency table, counted over all ids and scaled to 2**20, is shared by all
files. Ids are cut into blocks of whole documents. A block is coded by itself: its
ids are dealt out to interleaved lanes, one 64-bit state each, which numpy advances
together; words of 32 bits leave the states as they fill. At set steps the decoder's
states and its place among the words are kept as checkpoints, from which parts of a
block decode independently. Checksums cover the table, each block's body and its ids.

A file: magic, table's CRC, then blocks. A block: head (fixed fields), document ids
and lengths, end states, checkpoints, words. The table is a file of its own.
"""

from __future__ import annotations

import json
import re
import struct
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import bound_batches, drop_staged, lean, new_path, shuffle_partitions, stage
from tessera.llm.files import Attempt, filesystem

SCALE_BITS = 20
LOW = np.uint64(1 << 32)
BLOCK_IDS = 1 << 20  # a block ends with the document that reaches this many
FILE_BYTES = 256 << 20
APART = 128  # steps from one checkpoint to the next
MAGIC = b"TSRANS01"
HEAD = struct.Struct("<4sQQQIIIIIII")  # mark, bytes from the head to the words, first id's place, ids, documents, lanes, steps, words, parts, bytes of documents, CRC of all up to the words
PART = struct.Struct("<IQI")  # first step, first word, CRC of ids; the states follow
PIECES_CHARS = 4_000_000  # of texts whose distinct pieces are looked up together


#: Kinds of bytes of text in UTF-8 whose A-Z are in lower case. Signs are of ASCII; × and ÷ are no letters and count as others.
SPACE, LETTER, DIGIT, SIGN, SHORT, FIRST, SECOND, OTHER = range(8)
KINDS = np.full(256, OTHER, np.uint8)
KINDS[list(range(33, 127))] = SIGN
KINDS[list(b" \t\n\x0b\x0c\r")] = SPACE
KINDS[list(b"0123456789")] = DIGIT
KINDS[list(b"abcdefghijklmnopqrstuvwxyz")] = LETTER
KINDS[0xC3] = FIRST
KINDS[[b for b in range(0x80, 0xC0) if b not in (0x97, 0xB7)]] = SECOND
KINDS_OF = KINDS.tobytes()
LOWERED = bytes(range(256)).lower()
#: Second bytes of capitals to those of lower-case letters.
SMALL = np.arange(256, dtype=np.uint8)
SMALL[0x80:0x9F] += 0x20
#: The pattern of words that is matched by kinds of bytes.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

# --- tokens -----------------------------------------------------------------


LOWER = "abcdefghijklmnopqrstuvwxyz"
#: Bytes of words of lower-case Latin-1 letters in UTF-8: ASCII letters, the first byte of the others, and their second bytes.
WORD_BYTES = [*LOWER.encode(), 0xC3, 0x9F, *range(0xA0, 0xB7), *range(0xB8, 0xC0)]


NUMBERS = np.zeros(256, np.uint8)
NUMBERS[WORD_BYTES] = np.arange(1, len(WORD_BYTES) + 1)
NUMBERS_OF = NUMBERS.tobytes()


@lru_cache(1)
def word_ranks(path: str) -> tuple[dict[bytes, int], dict[int, int]]:
    """For words of WORD_BYTES: ranks of tokens by merge, and the ids of the ranks. A byte is
    written as its number in WORD_BYTES from 1 on, a word's last byte as one of as many
    numbers more, so that each is one symbol.

    Where a token's letters are alone, merges go the same way as inside a word up to the
    token, so two neighbours that make a token are those that its last merge joins, and
    merging by the rank of what two symbols make is merging by the rank of the pair.
    Tokens that their own letters do not lead to are never made, and left out."""
    with open(path, encoding="utf-8") as file:
        model = json.load(file)["model"]
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    byte_of = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}
    letter_of = {b: c for c, b in byte_of.items()}
    number, n = {b: k for k, b in enumerate(WORD_BYTES, 1)}, len(WORD_BYTES)
    merges = {tuple(m if isinstance(m, list) else m.split(" ")): rank for rank, m in enumerate(model["merges"])}
    ranks, ids = {}, {}
    for b, k in number.items():
        for own, text in ((k, letter_of[b]), (k + n, letter_of[b] + "</w>")):
            ranks[bytes([own])], ids[own] = own, model["vocab"][text]
    for token in {a + b for a, b in merges}:
        end = token.endswith("</w>")
        letters = token.removesuffix("</w>")
        if any(byte_of.get(c) not in number for c in letters):
            continue
        parts, last = list(letters), -1
        parts[-1] += "</w>" * end
        while len(parts) > 1:
            rank, at = min((merges.get(pair, 1 << 60), k) for k, pair in enumerate(zip(parts, parts[1:])))
            if rank == 1 << 60:
                break
            parts[at : at + 2], last = [parts[at] + parts[at + 1]], rank
        if len(parts) == 1:
            data = [number[byte_of[c]] for c in letters]
            ranks[bytes([*data[:-1], data[-1] + n * end])], ids[256 + last] = 256 + last, model["vocab"][token]
    return ranks, ids


class Tokenizer:
    """Ids of whole texts as the tokenizers library gives them.

    For a file that folds white space, lower-cases, keeps the matches of a pattern and
    maps bytes to letters (the steps are read from the file), texts of ASCII and Latin-1
    letters are cut into words by their bytes, many texts at once; of their distinct words those
    of letters are merged together by tiktoken under the file's merges (``word_ranks``), others are
    looked up. Of other texts the distinct pieces between white space are cut into words,
    and each distinct word is encoded once and remembered, at most ``remember`` of them;
    pieces with letters beyond Latin-1 go to the library as they are, and so do whole texts
    that hold the string of an added token or control characters that Python, but not the
    library, takes for white space, or under a file of other steps."""

    ODD = re.compile("[\x1c-\x1f\x85]")
    PLAIN = re.compile("[!-~\u00c0-\u00ff]+").fullmatch
    SPACE = re.compile(r"\s")
    END = 0xFFFFFFFF  # after each piece, in place of an id

    def __init__(self, path: str, remember: int = 400_000):
        import tokenizers

        self.path, self.library = path, tokenizers.Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            steps = json.load(file)
        self.added = [t["content"] for t in steps.get("added_tokens", [])]
        normal = [x["type"] for x in (steps["normalizer"] or {}).get("normalizers", [])]
        cut = (steps["pre_tokenizer"] or {}).get("pretokenizers", [])
        plain_added = all(not (t["normalized"] or t["single_word"] or t["lstrip"] or t["rstrip"]) for t in steps.get("added_tokens", []))
        self.by_piece = plain_added and normal == ["NFC", "Replace", "Lowercase"] and [x["type"] for x in cut] == ["Split", "ByteLevel"] and cut[0]["invert"] and cut[0]["behavior"] == "Removed" and not cut[1]["use_regex"]
        self.find = regex.compile(r"\n|" + cut[0]["pattern"]["Regex"]).findall if self.by_piece else None
        # the usual letters for bytes: printable Latin-1 stands for itself, the rest follow from 256 on
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        self.letters = {b: 256 + k for k, b in enumerate(b for b in range(256) if b not in shown)}
        if self.by_piece and cut[0]["pattern"]["Regex"] == WORDS and (steps["model"].get("end_of_word_suffix"), steps["model"].get("dropout"), steps["model"].get("continuing_subword_prefix")) == ("</w>", None, None):
            ranks, ids = word_ranks(path)
            self.merge = tiktoken.Encoding("words", pat_str=r"[^\x00]+", mergeable_ranks=ranks, special_tokens={})
            self.id_of = np.zeros(max(ids) + 1, np.uint32)
            self.id_of[list(ids)] = list(ids.values())
            self.last = np.zeros(len(self.id_of), bool)
            self.last[[rank for token, rank in ranks.items() if token[-1] > len(WORD_BYTES)]] = True
        else:
            self.merge = None
        self.words: dict[str, bytes] = {}
        self.odd: dict[str, bytes] = {}
        self.remember = remember

    def whole(self, text: str) -> bytes:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def word(self, word: str) -> bytes:
        letters = word if word.isascii() else word.encode().decode("latin-1").translate(self.letters)
        return array("I", [t.id for t in self.library.model.tokenize(letters)]).tobytes()

    def pieces(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, starts, lengths) of each piece without white space."""
        plain = np.fromiter((self.PLAIN(p) is not None for p in pieces), bool, len(pieces))
        words = self.find("".join([p + "\n" for p, own in zip(pieces, plain) if own]).lower())
        distinct = set(words) - {"\n"}
        if len(self.words) + len(distinct) > self.remember:
            self.words = {}
        for word in distinct - self.words.keys():
            self.words[word] = self.word(word)
        self.words["\n"] = np.uint32(self.END).tobytes()
        of_words = b"".join(map(self.words.__getitem__, words))
        held = []
        for p in (p for p, own in zip(pieces, plain) if not own):
            if p not in self.odd:
                if len(self.odd) >= self.remember // 16:
                    self.odd = {}
                self.odd[p] = self.whole(p)
            held.append(self.odd[p])
        ids = np.frombuffer(of_words + b"".join(held), "<u4")
        ends = np.flatnonzero(ids[: len(of_words) // 4] == self.END)
        starts, lengths = np.zeros(len(pieces), np.int64), np.zeros(len(pieces), np.int64)
        starts[plain] = np.concatenate(([0], ends[:-1] + 1))[: len(ends)]
        lengths[plain] = ends - starts[plain]
        sizes = np.array([len(x) // 4 for x in held], np.int64)
        lengths[~plain] = sizes
        starts[~plain] = len(of_words) // 4 + np.cumsum(sizes) - sizes
        return ids, starts, lengths

    def _together(self, texts: list[str]) -> list[bytes]:
        cut = [t.split() for t in texts]
        flat = [p for own in cut for p in own]
        if not flat:
            return [b""] * len(texts)
        coded = pa.array(flat, pa.string()).dictionary_encode()
        ids, starts, lengths = self.pieces(coded.dictionary.to_pylist())
        index = coded.indices.to_numpy()
        n = lengths[index]
        ends = np.cumsum(n)
        data = ids[np.repeat(starts[index] - (ends - n), n) + np.arange(ends[-1])].tobytes()
        places = np.concatenate(([0], 4 * ends))[np.cumsum([0] + [len(own) for own in cut])].tolist()
        return [data[s:e] for s, e in zip(places, places[1:])]

    def _units(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[int]]:
        """The texts' bytes in lower case with a line end after each, where the pattern's matches
        begin in them, the texts' bounds, and which texts have others than ASCII and
        Latin-1 letters; those are blank here."""
        raw = [t.encode() for t in texts]
        lines = np.cumsum([0] + [len(t) + 1 for t in raw])
        text = b"\n".join([*raw, b""]).translate(LOWERED)
        data = np.frombuffer(bytearray(text), np.uint8)
        kind = np.frombuffer(bytearray(text.translate(KINDS_OF)), np.uint8)
        firsts = np.flatnonzero(kind == FIRST)
        if len(firsts):  # a letter of two bytes, the second of which stands after nothing else
            right = kind[firsts + 1] == SECOND
            kind[firsts[~right]] = OTHER
            firsts = firsts[right]
            kind[firsts] = kind[firsts + 1] = LETTER
            data[firsts + 1] = SMALL[data[firsts + 1]]
        odd = np.flatnonzero(np.maximum.reduceat(kind, lines[:-1]) == OTHER).tolist()
        for k in odd:
            kind[lines[k] : lines[k + 1]], data[lines[k] : lines[k + 1]] = SPACE, 32
        # an apostrophe that begins a run of signs goes with the letters that the pattern names
        marks = np.flatnonzero((data == 39) & (kind == SIGN))
        marks = marks[(marks == 0) | (kind[marks - 1] != SIGN)]
        one, two = data[marks + 1], data[np.minimum(marks + 2, len(data) - 1)]
        size = np.where(np.isin(one, list(b"stmd")), 2, np.where(((one == 114) | (one == 118)) & (two == 101) | (one == 108) & (two == 108), 3, 0))
        for k in range(3):
            kind[marks[size > k] + k] = SHORT
        # runs of letters, runs of signs, digits, apostrophes with their letters
        starts = kind == DIGIT
        starts[:1] |= kind[:1] != SPACE
        starts[1:] |= (kind[1:] != kind[:-1]) & (kind[1:] != SPACE)
        starts[marks[size > 0]] = True
        return data, np.flatnonzero(starts), lines, odd

    def _distinct(self, data: bytes, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, starts, lengths) of matches, which stand with the white space after them between
        ``bounds`` of ``data``."""
        symbols = np.frombuffer(bytearray(data.translate(NUMBERS_OF)), np.uint8)
        letters = symbols[bounds[:-1]] > 0
        others = np.flatnonzero(~letters)
        held = []
        for s, e in zip(bounds[others].tolist(), bounds[others + 1].tolist()):
            symbols[s:e] = 0
            word = data[s:e].rstrip(b" \t\n\x0b\x0c\r").decode()
            if word not in self.words:
                if len(self.words) >= self.remember:
                    self.words = {}
                self.words[word] = self.word(word)
            held.append(self.words[word])
        stops, begins = symbols > 0, np.zeros(len(symbols) + 1, bool)
        begins[bounds] = True
        stops[:-1] &= (symbols[1:] == 0) | begins[1:-1]
        symbols[stops] += len(WORD_BYTES)
        # words stand apart even where one follows another without a gap
        merged = self.merge.encode_to_numpy(symbols.tobytes().decode("latin-1"), disallowed_special=()) if letters.any() else np.zeros(0, np.uint32)
        # a token that ends a word holds a symbol of the upper half last
        ends = np.flatnonzero(self.last[merged]) + 1
        starts, lengths = np.zeros(len(letters), np.int64), np.zeros(len(letters), np.int64)
        starts[letters] = np.concatenate(([0], ends))[: len(ends)]
        lengths[letters] = ends - starts[letters]
        lengths[others] = [len(ids) // 4 for ids in held]
        starts[others] = len(merged) + np.cumsum(lengths[others]) - lengths[others]
        return np.concatenate((self.id_of[merged], np.frombuffer(b"".join(held), "<u4"))), starts, lengths

    def _by_bytes(self, texts: list[str]) -> list[bytes | None]:
        """Ids of texts of ASCII and Latin-1 letters; None for others."""
        data, begins, lines, odd = self._units(texts)
        if len(begins):
            bounds = pa.py_buffer(np.concatenate((begins, [len(data)])))
            units = pa.Array.from_buffers(pa.large_binary(), len(begins), [None, bounds, pa.py_buffer(data)]).dictionary_encode()
            _, bounds, data = units.dictionary.buffers()
            bounds = np.frombuffer(bounds, np.int64, len(units.dictionary) + 1)
            ids, starts, lengths = self._distinct(data.to_pybytes()[: bounds[-1]], bounds)
            index = units.indices.to_numpy()
            n = lengths[index]
            total = np.concatenate(([0], np.cumsum(n)))
            out = ids[np.repeat(starts[index] - total[:-1], n) + np.arange(total[-1])].astype("<u4", copy=False).tobytes()
        else:
            total, out = np.zeros(1, np.int64), b""
        cuts = (4 * total[np.searchsorted(begins, lines)]).tolist()
        found: list[bytes | None] = [out[s:e] for s, e in zip(cuts, cuts[1:])]
        for k in odd:
            found[k] = None
        return found

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        out: list[list[bytes]] = [[] for _ in texts]
        held: list[tuple[int, str]] = []
        size = 0

        def look_up():
            nonlocal held, size
            parts = [part for _, part in held]
            found = self._by_bytes(parts) if self.merge and parts else [None] * len(parts)
            found = [self.whole(part) if ids is None and self.ODD.search(part) else ids for part, ids in zip(parts, found)]
            rest = iter(self._together([part for part, ids in zip(parts, found) if ids is None]))
            for (k, _), ids in zip(held, found):
                out[k].append(next(rest) if ids is None else ids)
            held, size = [], 0

        for k, text in enumerate(texts):
            if not self.by_piece or len(text) > PIECES_CHARS and self.ODD.search(text) or any(t in text for t in self.added):
                out[k].append(self.whole(text))
                continue
            at = 0
            while at < len(text):  # a long text is cut at white space
                space = self.SPACE.search(text, at + PIECES_CHARS) if len(text) - at > PIECES_CHARS else None
                end = space.start() if space else len(text)
                held.append((k, text[at:end]))
                size, at = size + end - at, end
                if size >= PIECES_CHARS:
                    look_up()
        look_up()
        return [b"".join(parts) for parts in out]


_tokenizers: dict[str, Tokenizer] = {}  # of a worker process, which serves many tasks


def tokenize(docs: DataFrame, path: str, end_id: int) -> DataFrame:
    """Blocks of ids in ascending doc_id order: (part, seq, base, n_ids, doc_ids, lengths,
    ids): base counts the ids of the same part before the block."""
    bound_batches(docs.sparkSession)
    n = shuffle_partitions(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, base, size = TaskContext.get().partitionId(), 0, 0, 0
        if path not in _tokenizers:
            _tokenizers[path] = Tokenizer(path)
        end = np.uint32(end_id).tobytes()
        doc_ids, rows = [], []

        def block():
            lengths = np.array([len(r) // 4 for r in rows], np.uint32)
            return pa.record_batch(
                {"part": pa.array([part], pa.int32()), "seq": pa.array([seq], pa.int64()), "base": pa.array([base], pa.int64()), "n_ids": pa.array([size], pa.int64()), "doc_ids": pa.array([doc_ids], pa.list_(pa.int64())), "lengths": pa.array([lengths], pa.list_(pa.int64())), "ids": pa.array([_narrow(b"".join(rows))], pa.binary())}
            )

        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for key, ids in zip(batch.column(0).to_pylist(), _tokenizers[path].encode(texts)):
                doc_ids.append(key)
                rows.append(ids + end)
                size += len(rows[-1]) // 4
                if size >= BLOCK_IDS:
                    yield block()
                    seq, base, size = seq + 1, base + size, 0
                    doc_ids, rows = [], []
        if rows:
            yield block()

    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", "text")
    return ordered.mapInArrow(lean(run), "part int, seq long, base long, n_ids long, doc_ids array<long>, lengths array<long>, ids binary")


def _narrow(ids: bytes) -> bytes:
    """A mark of the width, and the ids in 16 bits where all fit."""
    wide = np.frombuffer(ids, "<u4")
    return b"\x02" + wide.astype("<u2").tobytes() if not len(wide) or wide.max() < 1 << 16 else b"\x04" + ids


def _wide(data: bytes) -> np.ndarray:
    return np.frombuffer(data, "<u2" if data[:1] == b"\x02" else "<u4", offset=1)


# --- coding -------------------------------------------------------------------


class Table:
    """Frequencies of all ids, scaled to 2**SCALE_BITS; each id that occurs keeps one at least."""

    def __init__(self, frequencies: np.ndarray):
        self.freq = frequencies.astype(np.uint64)
        ends = np.cumsum(self.freq)
        self.start = ends - self.freq
        if ends[-1] != 1 << SCALE_BITS:
            raise ValueError("frequencies do not add up")
        self.symbol = np.repeat(np.arange(len(self.freq), dtype=np.uint32), self.freq.astype(np.int64))

    @classmethod
    def scaled(cls, counts: np.ndarray) -> Table:
        counts = np.asarray(counts, np.float64).copy()
        if (counts > 0).sum() < 2:  # a lone id would fill the scale
            counts = np.concatenate((counts, np.zeros(max(0, 2 - len(counts)))))
            counts[np.flatnonzero(counts == 0)[: 2 - int((counts > 0).sum())]] = 1
        used, total = counts > 0, 1 << SCALE_BITS
        if used.sum() > total // 2:
            raise ValueError("too many distinct ids for the scale")
        freq = np.where(used, np.maximum(1, np.floor(counts / counts.sum() * total)), 0).astype(np.int64)
        order = np.argsort(-freq, kind="stable")
        rest = total - int(freq.sum())
        for at in order:  # the most frequent ids give or take the rest
            if rest == 0:
                break
            step = rest if rest > 0 else max(rest, -(int(freq[at]) // 2))
            freq[at] += step
            rest -= step
        return cls(freq)

    def to_bytes(self) -> bytes:
        data = struct.pack("<I", len(self.freq)) + self.freq.astype("<u4").tobytes()
        return data + struct.pack("<I", zlib.crc32(data))

    @classmethod
    def from_bytes(cls, data: bytes) -> Table:
        if zlib.crc32(data[:-4]) != struct.unpack("<I", data[-4:])[0]:
            raise ValueError("the table's checksum does not match")
        return cls(np.frombuffer(data, "<u4", offset=4, count=struct.unpack_from("<I", data)[0]))


def encode_block(ids: np.ndarray, doc_ids: list[int | None], lengths: list[int], place: int, table: Table, apart: int | None = None) -> bytes:
    n, apart = len(ids), apart or APART
    lanes = int(min(4096, max(1, n // 512)))
    steps = -(-n // lanes)
    states = np.full(lanes, LOW, np.uint64)
    freq, start = table.freq[ids], table.start[ids]
    limit = freq << np.uint64(64 - SCALE_BITS)
    bits, half, low = np.uint64(SCALE_BITS), np.uint64(32), np.uint64(0xFFFFFFFF)
    words: list[np.ndarray] = []
    points: dict[int, np.ndarray] = {}
    for step in range(steps - 1, -1, -1):
        s, e = step * lanes, min(n, (step + 1) * lanes)
        x, f = states[: e - s], freq[s:e]
        full = x >= limit[s:e]
        words.append((x[full] & low).astype("<u4"))
        x = np.where(full, x >> half, x)
        q = x // f
        states[: e - s] = (q << bits) + (x - q * f) + start[s:e]
        if step and step % apart == 0:
            points[step] = states.copy()
    words.reverse()
    sizes = np.cumsum([0] + [len(w) for w in words])
    points[0] = states
    firsts = sorted(points)
    ids = np.ascontiguousarray(ids, "<u4")
    parts = b"".join(PART.pack(step, sizes[step], zlib.crc32(ids[step * lanes : end * lanes])) + points[step].astype("<u8").tobytes() for step, end in zip(firsts, [*firsts[1:], steps]))
    known = np.array([d is not None for d in doc_ids], bool)
    keys = zlib.compress(np.packbits(known).tobytes() + np.array([d or 0 for d in doc_ids], "<i8").tobytes() + np.array(lengths, "<u8").tobytes(), 6)
    front = keys + parts
    return HEAD.pack(b"BLK2", len(front), place, n, len(doc_ids), lanes, steps, int(sizes[-1]), len(firsts), len(keys), zlib.crc32(front)) + front + b"".join(w.tobytes() for w in words)


def parts_of(block: bytes) -> int:
    return HEAD.unpack_from(block)[8]


class Block:
    """A block read back through ``read(offset, length)``, of which only what is asked for is
    read: the documents, and the ids of each part."""

    def __init__(self, read):
        self.read = read
        mark, size, self.place, self.n, docs, self.lanes, self.steps, self.n_words, parts, n_keys, crc = HEAD.unpack(read(0, HEAD.size))
        front = read(HEAD.size, size)
        if mark != b"BLK2" or len(front) != size or zlib.crc32(front) != crc:
            raise ValueError("the block's checksum does not match")
        keys = zlib.decompress(front[:n_keys])
        known = np.unpackbits(np.frombuffer(keys, np.uint8, -(-docs // 8)), count=docs).astype(bool)
        at = -(-docs // 8)
        self.doc_ids = [d if k else None for d, k in zip(np.frombuffer(keys, "<i8", docs, at).tolist(), known)]
        self.lengths = np.frombuffer(keys, "<u8", docs, at + 8 * docs).astype(np.int64)
        self.parts, at = [], n_keys
        for _ in range(parts):
            self.parts.append((*PART.unpack_from(front, at), np.frombuffer(front, "<u8", self.lanes, at + PART.size)))
            at += PART.size + 8 * self.lanes
        self.words_at = HEAD.size + size

    def bounds(self, part: int) -> tuple[int, int]:
        """The ids of a part: first and end, counted in the block."""
        end = self.parts[part + 1][0] if part + 1 < len(self.parts) else self.steps
        return min(self.n, self.parts[part][0] * self.lanes), min(self.n, end * self.lanes)

    def decode(self, table: Table, part: int, most: int | None = None) -> np.ndarray:
        """Ids of a part, from its own checkpoint; with ``most``, the first so many or a few
        more. A checksum of a whole part that does not match is an error."""
        first, word, crc, states = self.parts[part]
        last, end = (self.parts[part + 1][:2]) if part + 1 < len(self.parts) else (self.steps, self.n_words)
        whole = last
        if most is not None:
            last = min(last, first - (-most // self.lanes))
        words = np.frombuffer(self.read(self.words_at + 4 * word, 4 * (end - word)), "<u4")
        states, at = states.astype(np.uint64), 0
        start, stop = self.bounds(part)
        out = np.empty(min(stop, last * self.lanes) - start, np.uint32)
        bits, half, mask = np.uint64(SCALE_BITS), np.uint64(32), np.uint64((1 << SCALE_BITS) - 1)
        for step in range(first, last):
            s, e = (step - first) * self.lanes, min(len(out), (step - first + 1) * self.lanes)
            x = states[: e - s]
            slot = x & mask
            symbols = table.symbol[slot.astype(np.int64)]
            out[s:e] = symbols
            x = table.freq[symbols] * (x >> bits) + slot - table.start[symbols]
            empty = x < LOW
            n = int(np.count_nonzero(empty))
            if at + n > len(words):
                raise ValueError("the part's words end too early")
            x[empty] = (x[empty] << half) | words[at : at + n]
            at += n
            states[: e - s] = x
        after = self.parts[part + 1][3] if part + 1 < len(self.parts) else LOW  # where the coder began
        if last == whole and (zlib.crc32(out) != crc or at < len(words) or (states != after).any()):
            raise ValueError("a part does not match its checksum")
        return out


# --- files ----------------------------------------------------------------------


def count_ids(blocks: DataFrame) -> np.ndarray:
    """How often each id occurs in all blocks. One row a task and id reaches the
    aggregation, and as many rows as the vocabulary has ids reach the driver."""

    def run(batches):
        total = np.zeros(0, np.int64)
        for batch in batches:
            for data in batch.column(0).to_pylist():
                own = np.bincount(_wide(data))
                if len(own) > len(total):
                    own[: len(total)] += total
                    total = own
                else:
                    total[: len(own)] += own
        used = np.flatnonzero(total)
        yield pa.record_batch({"id": pa.array(used), "n": pa.array(total[used])})

    rows = blocks.select("ids").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toArrow()
    ids = rows.column("id").to_numpy()
    counts = np.zeros(int(ids.max()) + 1 if len(ids) else 1, np.int64)
    counts[ids] = rows.column("n").to_numpy()
    return counts


def write_ids(docs: DataFrame, folder: str, path: str, end_id: int) -> DataFrame:
    """Tokenize whole texts of ``docs`` (doc_id, text; other columns are ignored), append
    ``end_id`` to each and write all ids to files in ``folder`` in ascending order of
    doc_id. Returns (path, offset, length, parts) of each block, staged.

    Null and empty texts have the end id alone. Null doc_ids come first; rows with
    equal doc_id follow each other in order of text. An empty table gives no file
    but the table's."""
    blocks = stage(tokenize(docs, path, end_id), "token-blocks")
    totals = dict(blocks.groupBy("part").agg(F.sum("n_ids")).collect())  # a row for each part of the range partitioning
    bases, place = {}, 0
    for part in sorted(totals):
        bases[part], place = place, place + totals[part]
    table = Table.scaled(count_ids(blocks)).to_bytes()
    out = Attempt(folder, "table.bin")
    out.write(table)
    out.close()

    def run(batches):
        shared, out, rows, last = Table.from_bytes(table), None, [], None
        for batch in batches:
            for row in batch.to_pylist():
                if out is None or last != (row["part"], row["seq"] - 1) or out.at >= FILE_BYTES:
                    if out is not None:
                        out.close()
                        yield pa.RecordBatch.from_pylist(rows)
                    out, rows = Attempt(folder, f"ids-{row['part']:06d}-{row['seq']:08d}.rans"), []
                    out.write(MAGIC + table[-4:])
                last = (row["part"], row["seq"])
                data = encode_block(_wide(row["ids"]), row["doc_ids"], row["lengths"], bases[row["part"]] + row["base"], shared)
                rows.append({"path": out.uri, "offset": out.write(data), "length": len(data), "parts": parts_of(data)})
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pylist(rows)

    written = stage(blocks.mapInArrow(lean(run), "path string, offset long, length long, parts long"), "id-blocks")
    drop_staged(blocks)
    return written


def read_ids(blocks: DataFrame, folder: str) -> DataFrame:
    """(doc_id, start, ids) for each document of the blocks (path, offset, length, parts):
    start counts the ids of all documents before it; ids are little-endian unsigned 32-bit
    integers, end id included. Every part of a block is decoded by itself from its
    checkpoint, in any task, which owns the documents that begin in it and decodes the next
    parts as far as the last of them goes. A checksum that does not match is an error."""
    n = shuffle_partitions(blocks.sparkSession)

    def run(batches):
        table = None
        for batch in batches:
            for row in batch.to_pylist():
                system, path = filesystem(row["path"])
                if table is None:
                    shared, base = filesystem(folder)
                    with shared.open_input_stream(f"{base}/table.bin") as file:
                        table = Table.from_bytes(file.read())
                part = row["part"]
                with system.open_input_file(path) as file:
                    block = Block(lambda at, size: file.read_at(size, row["offset"] + at))
                    first, last = block.bounds(part)
                    ends = np.cumsum(block.lengths)
                    starts = ends - block.lengths
                    own = np.flatnonzero((starts >= first) & (starts < last))
                    ids = [block.decode(table, part)]
                    while len(own) and last < ends[own[-1]]:
                        part += 1
                        ids.append(block.decode(table, part, int(ends[own[-1]]) - last))
                        last = block.bounds(part)[1]
                data = np.concatenate(ids).tobytes()
                each = [data[4 * s : 4 * e] for s, e in zip((starts[own] - first).tolist(), (ends[own] - first).tolist())]
                yield pa.record_batch({"doc_id": pa.array([block.doc_ids[k] for k in own], pa.int64()), "start": pa.array(starts[own] + block.place), "ids": pa.array(each, pa.binary())})

    each = blocks.select("path", "offset", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"))
    return each.repartition(n, "path", "offset", "part").mapInArrow(lean(run), "doc_id long, start long, ids binary")


def op8_rans(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    folder = new_path(spark, "rans")
    blocks = write_ids(spark.read.parquet(f"{sf_dir}/documents.parquet"), folder, public_tokenizers.path("word_bpe_49k.json"), 2)
    return read_ids(blocks, folder).select("doc_id", "start", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))
