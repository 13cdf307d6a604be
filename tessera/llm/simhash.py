"""SimHash near-duplicates with Golay-code fuzzy hashing.

A 64-bit fingerprint is cut into three segments of 22, 21 and 21 bits. If two
fingerprints differ in at most two bits, one segment is equal, and of the other
two at least one differs in at most one bit (pigeonhole). So for each ordered pair
of segments (A, B) a fingerprint gets keys made of A's bits and of the index of the
Golay codeword near B: the perfect [23,12] code decodes every 23-bit word to the one
codeword within three bits. A word and a neighbour one bit off decode to the same
codeword or to one of at most five others, hence a home key and about five probe
keys. Two fingerprints within two bits meet where the home key of one is a home or
probe key of the other; every meeting is verified by counting bits.

Equal fingerprints are one node throughout, so copies cost nothing; a bucket's
verified links leave its task as a spanning forest, never as all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import bound_batches, connected_components, lean, merge_labels, pairs_in_runs, run_bounds, shuffle_partitions, stage, whole_runs

SEGMENTS = ((0, 22), (22, 21), (43, 21))  # (lowest bit, width)
GENERATOR = 0b110001110101  # of the binary Golay code: x^11+x^10+x^6+x^5+x^4+x^2+1
HOT = 1 / 1000  # share of all rows beyond which a fingerprint's or a component's rows stay where they are
PAIRWISE = 65536  # rows of a bucket up to which all its pairs are counted; beyond, every mask of one or two bits is looked up


# --- fingerprints -----------------------------------------------------------


def shingle_hashes(text: bytes, width: int, seed: int) -> np.ndarray:
    """XXH64 of every run of ``width`` words, words of ASCII-lower-cased text
    between ASCII white space; of the whole sequence if it is shorter."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    line = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) <= width:
        return np.array([digest(line, seed)], np.uint64)
    ends = (np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1).tolist()
    starts = [0] + [e + 1 for e in ends[:-width]]
    return np.fromiter((digest(line[s:e], seed) for s, e in zip(starts, ends[width - 1 :])), np.uint64, len(starts))


def simhash(hashes: np.ndarray) -> int:
    """Bit b is 1 if it is set in over half of the hashes."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = np.ascontiguousarray(hashes[at : at + (1 << 16)], "<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, width: int = 3, seed: int = 42) -> DataFrame:
    """(doc_id, fp long) of every row of ``docs``; null and wordless texts: 0."""

    bound_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [simhash(shingle_hashes(t.as_py() or b"", width, seed)) for t in batch.column(1)]
            yield pa.record_batch({"doc_id": batch.column(0), "fp": pa.array(np.array(fps, np.uint64).view(np.int64))})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")).mapInArrow(lean(run), "doc_id long, fp long")


# --- Golay keys ----------------------------------------------------------------


def _syndromes() -> tuple[list[np.ndarray], np.ndarray]:
    """Tables: remainders modulo the generator by byte of a word, and the error of
    weight 3 or less for each remainder (the code is perfect: there is just one)."""

    def remainder(word: int) -> int:
        for bit in range(22, 10, -1):
            if word >> bit & 1:
                word ^= GENERATOR << (bit - 11)
        return word

    unit = [remainder(1 << b) for b in range(23)] + [0]
    tables = []
    for byte in range(3):
        table = np.zeros(256, np.int64)
        for bit in range(8):
            table[(np.arange(256) >> bit & 1) == 1] ^= unit[8 * byte + bit]
        tables.append(table)
    errors = np.zeros(2048, np.int64)
    for i in range(23):
        errors[unit[i]] = 1 << i
        for j in range(i):
            errors[unit[i] ^ unit[j]] = 1 << i | 1 << j
            for k in range(j):
                errors[unit[i] ^ unit[j] ^ unit[k]] = 1 << i | 1 << j | 1 << k
    return tables, errors


_TABLES: tuple[list[np.ndarray], np.ndarray] | None = None


def golay_index(words: np.ndarray) -> np.ndarray:
    """12-bit index of the Golay codeword within three bits of each 23-bit word."""
    global _TABLES
    if _TABLES is None:
        _TABLES = _syndromes()
    (low, mid, high), errors = _TABLES
    rest = low[words & 255] ^ mid[words >> 8 & 255] ^ high[words >> 16]
    return (words ^ errors[rest]) >> 11


def keys_of(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, key, home) of all keys of each fingerprint (unsigned 64-bit)."""
    parts = [((fps >> np.uint64(at)) & np.uint64((1 << width) - 1)).astype(np.int64) for at, width in SEGMENTS]
    rows, keys, homes = [], [], []
    for b, (_, width) in enumerate(SEGMENTS):
        flips = np.concatenate(([0], 1 << np.arange(width)))
        index = golay_index(parts[b][:, None] ^ flips)
        home = index[:, :1]
        rest = np.sort(np.where(index == home, -1, index), axis=1)
        fresh = (rest >= 0) & (np.concatenate((np.full((len(fps), 1), -1), rest[:, :-1]), axis=1) != rest)
        r, c = np.nonzero(fresh)
        row = np.concatenate((np.arange(len(fps)), r))
        code = np.concatenate((home[:, 0], rest[r, c]))
        is_home = np.concatenate((np.ones(len(fps), bool), np.zeros(len(r), bool)))
        for a in range(3):
            if a != b:
                rows.append(row)
                keys.append(((a * 3 + b) << 34) | (parts[a][row] << 12) | code)
                homes.append(is_home)
    return np.concatenate(rows), np.concatenate(keys), np.concatenate(homes)


# --- links -----------------------------------------------------------------------


def link_bucket(fps: np.ndarray, most: int) -> np.ndarray:
    """Position of the first member that links of at most ``most`` (0 to 2) bits reach,
    for each member of one bucket; exact for any size."""
    labels = np.arange(len(fps))
    if len(fps) <= PAIRWISE:
        tile = max(1, (1 << 22) // len(fps))
        for at in range(0, len(fps), tile):
            i, j = np.nonzero(np.bitwise_count(fps[at : at + tile, None] ^ fps[None, :]) <= most)
            labels = merge_labels(labels, i + at, j)
        return labels
    order = np.argsort(fps)
    sorted_fps = fps[order]
    masks = [np.uint64(0)] + [np.uint64(1 << i) for i in range(64)] * (most > 0) + [np.uint64(1 << i | 1 << j) for i in range(64) for j in range(i)] * (most > 1)
    for mask in masks:
        other = fps ^ mask
        place = np.minimum(np.searchsorted(sorted_fps, other), len(fps) - 1)
        hit = sorted_fps[place] == other
        labels = merge_labels(labels, np.flatnonzero(hit), order[place[hit]])
    return labels


def _forest(most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_runs(batches, "key", 1 << 16):
            keys, fps, home = (table.column(c).to_numpy() for c in ("key", "fp", "home"))
            fps = fps.view(np.uint64)
            bounds = run_bounds(keys)
            i, j = pairs_in_runs(bounds, 64)
            near = (home[i] | home[j]) & (np.bitwise_count(fps[i] ^ fps[j]) <= most)
            # one node for all rows of a fingerprint in this table
            nodes, node = np.unique(fps, return_inverse=True)
            labels = merge_labels(np.arange(len(nodes)), node[i[near]], node[j[near]])
            for s, e in zip(bounds[:-1], bounds[1:]):
                if e - s > 64:
                    firsts = link_bucket(fps[s:e], most)
                    labels = merge_labels(labels, node[s:e], node[s + firsts])
            moved = np.flatnonzero(labels != np.arange(len(nodes)))
            yield pa.record_batch({"u": pa.array(nodes[moved].view(np.int64)), "v": pa.array(nodes[labels[moved]].view(np.int64))})

    return run


def link_fingerprints(fps: DataFrame, most: int = 2) -> DataFrame:
    """Links (u, v) between distinct fingerprints of ``fps`` (column fp) that differ in
    at most ``most`` (0 to 2) bits, as a forest with the same components."""
    if not 0 <= most <= 2:
        raise ValueError("the segments guarantee links up to two bits")

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column(0).to_numpy()
            for at in range(0, len(own), 8192):
                part = own[at : at + 8192]
                rows, keys, homes = keys_of(part.view(np.uint64))
                yield pa.record_batch({"key": pa.array(keys), "fp": pa.array(part[rows]), "home": pa.array(homes)})

    n = shuffle_partitions(fps.sparkSession)
    keyed = fps.select("fp").distinct().mapInArrow(spread, "key long, fp long, home boolean")
    return keyed.repartition(n, "key").sortWithinPartitions("key").mapInArrow(_forest(most), "u long, v long")


def hand_back(rows: DataFrame, values: DataFrame, key: str) -> DataFrame:
    """``rows`` with what ``values`` (a row for each key, of n rows) has for their key. Keys of
    more than a share of all rows, of which there are at most 1 / HOT, go to all tasks:
    their rows need not meet."""
    hot = F.broadcast(values.where(F.col("n") > HOT * rows.count()).drop("n"))
    rest = rows.join(hot, key, "left_anti").join(values.drop("n"), key)
    return rows.join(hot, key).unionByName(rest)


def near_duplicates(docs: DataFrame, width: int = 3, most: int = 2) -> DataFrame:
    """SimHash near-duplicates: (doc_id, fp long, component_id) for each row of ``docs``
    (doc_id, text; other columns are ignored). component_id is the smallest doc_id
    that links of at most ``most`` differing bits reach, the row's own included.

    Null, empty and wordless texts have fingerprint 0 and link like any other.
    Repeated rows and equal fingerprints are one node of the link graph. A null
    doc_id takes part in linking but is never a component_id unless all are null.
    An empty table gives an empty result."""
    fps = stage(fingerprints(docs, width), "simhash")
    firsts = fps.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("n"))
    comps = stage(connected_components(link_fingerprints(fps, most)), "simhash-components")
    roots = stage(firsts.join(comps.select(F.col("node").alias("fp"), F.col("component").alias("root")), "fp").select("fp", "first", "root"), "simhash-roots")
    smallest = stage(roots.groupBy("root").agg(F.min("first").alias("low"), F.count("*").alias("n")), "simhash-smallest")
    linked = hand_back(roots.select("fp", "root"), smallest, "root").select("fp", "low")
    resolved = stage(firsts.join(linked, "fp", "left").select("fp", "n", F.coalesce("low", "first").alias("component_id")), "simhash-resolved")
    return hand_back(fps, resolved, "fp").select("doc_id", "fp", "component_id")


def fingerprint_hex(column: str = "fp"):
    return F.lpad(F.lower(F.hex(column)), 16, "0")


def op6_simhash(spark, sf_dir: str) -> DataFrame:
    found = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", fingerprint_hex().alias("fingerprint"), "component_id")
