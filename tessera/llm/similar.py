"""Near-duplicate texts: links of Jaccard similarity between sets of word shingles.

64 bits do not tell a similarity: texts of Jaccard 0.8 differ in about ten bits of their
SimHash, some in twenty, and no Golay key reaches that far. So fingerprints and their Golay
keys find the texts that differ little, and a prefix filter completes them: in one order of
all shingles, two sets of similarity t share one of the first n - ceil(t n) + 1 of each (n its
size), and every pair that meets so, may reach t by size and place and is not yet joined by
other links is computed exactly. The order puts shingles of many texts last; it bears on
speed only. Sketches of 256 parity bits bound how far two sets differ at least, and rule most
pairs out before they leave a task.

Sets hold 48 bits of a 64-bit polynomial hash of each shingle, computed for whole batches at
once. Equal sets are one node; a node with its set travels once for each pair that is computed.
All sets together are larger than the stored texts, so they are never written: each pass
computes from the texts those it needs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import bound_batches, connected_components, drop_staged, free_name, lean, pairs_in_runs, run_bounds, shuffle_partitions, stage, whole_runs
from tessera.llm.simhash import link_fingerprints, simhash

CHUNK = 1 << 18  # bytes of texts hashed at once, or one text's shingle if that is longer
COMMON = 1 << 16  # shingles that the order puts last, at most
OFTEN = 4  # texts of a task that hold a shingle, from which on it may be among them
CROWD = 64  # sets that meet at a shingle, beyond which the order should have it among them
ORDERS = 2  # times that the order is mended by such shingles, at most
SAMPLE = 8  # one row of so many shows which they are
NEIGHBOURS = 64  # sets that meet at a shingle, up to which all pairs of them are looked at to find those that none can be similar to
REMEMBERED = 1 << 18  # nodes that a task remembers so as to pass copies on once
STARS = 2  # rounds in which buckets are computed around one set, before all pairs still apart
FEW_NODES = 500_000  # nodes up to which the components found so far go to all tasks (8 MB); more are joined by shuffle
SENT = 2_000_000  # nodes up to which their list goes to all tasks; a longer one is joined by shuffle

# --- sets ---------------------------------------------------------------------------

_BASE = 0x9E3779B97F4A7C15 | 1
_tables: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A random number for each byte, and the powers 0 to n of the base and of its inverse
    modulo 2**64."""
    if len(_tables.get("up", ())) <= n:
        size = max(n, CHUNK) + 1
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _tables[name] = np.multiply.accumulate(steps)
        _tables["bytes"] = np.random.default_rng(5).integers(1, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
    return _tables["bytes"], _tables["up"], _tables["down"]


def _mixed(h: np.ndarray) -> np.ndarray:
    for factor in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
        h = (h ^ (h >> np.uint64(33))) * np.uint64(factor)
    return h ^ (h >> np.uint64(33))


def _hashes(lines: list[bytes], width: int) -> list[np.ndarray]:
    """Hashes of the shingles of each line of words parted by single spaces."""
    data = np.frombuffer(b"\n".join(lines) + b"\n", np.uint8)
    of_byte, up, down = _powers(len(data))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(of_byte[data] * up[: len(data)], out=sums[1:])
    ends = np.flatnonzero((data == 32) | (data == 10))
    starts = np.concatenate(([0], ends[:-1] + 1))
    last = np.flatnonzero(data[ends] == 10)  # the last word of each line
    first = np.concatenate(([0], last[:-1] + 1))
    words = np.where(ends[last] > starts[first], last - first + 1, 0)
    count = np.where(words > 0, np.maximum(words - width + 1, 1), 0)
    line = np.repeat(np.arange(len(lines)), count)
    begin = np.repeat(first - (np.cumsum(count) - count), count) + np.arange(len(line))
    s, e = starts[begin], ends[np.minimum(begin + width - 1, last[line])]
    h = _mixed((sums[e] - sums[s]) * down[s])
    return np.split(h, np.cumsum(count)[:-1])


def shingle_hashes(texts: list[bytes], width: int) -> Iterator[np.ndarray]:
    """Sorted distinct 64-bit hashes of the runs of ``width`` words of each text, words of
    ASCII-lower-cased text between ASCII white space; of the whole sequence if it is shorter."""
    held: list[bytes] = []
    size = 0
    for text in texts:
        line = b" ".join(text.lower().split())
        if held and size + len(line) > CHUNK:
            yield from map(np.unique, _hashes(held, width))
            held, size = [], 0
        if len(line) <= CHUNK:
            held.append(line)
            size += len(line) + 1
            continue
        words, parts, at = line.split(b" "), [], 0
        while at < len(words):  # pieces that overlap by all but one word of a shingle
            end, n = at, 0
            while end < len(words) and (n <= CHUNK or end - at < width):
                n += len(words[end]) + 1
                end += 1
            parts.append(np.unique(_hashes([b" ".join(words[at:end])], width)[0]))
            if end == len(words):
                break
            at = end - width + 1
        yield np.unique(np.concatenate(parts))
    if held:
        yield from map(np.unique, _hashes(held, width))


def pack(hashes: np.ndarray) -> bytes:
    """48 bits of sorted hashes: the upper 32 of each, then the lower 16 of each."""
    top = np.unique(hashes >> np.uint64(16))
    return (top >> np.uint64(16)).astype("<u4").tobytes() + top.astype("<u2").tobytes()


def unpack(data: bytes) -> np.ndarray:
    n = len(data) // 6
    return np.frombuffer(data, "<u4", n).astype(np.uint64) << np.uint64(16) | np.frombuffer(data, "<u2", n, 4 * n).astype(np.uint64)


_ROWS = "key long, doc_id long, node long, size int, fp long, p0 long, p1 long, p2 long, p3 long, odd binary"
PARITIES = ("p0", "p1", "p2", "p3")


def parities(hashes: np.ndarray) -> np.ndarray:
    """256 bits as four numbers: whether an odd number of hashes falls into each cell. Of two
    sets the bits that differ are at most the hashes that only one of them has."""
    odd = np.bincount((hashes >> np.uint64(16) & np.uint64(255)).astype(np.int64), minlength=256) & 1
    return np.packbits(odd.astype(bool), bitorder="little").view("<i8")


MOST_CELLS = 16  # bits of the number of cells of a long set, at most


def odd_cells(top: np.ndarray) -> bytes:
    """As ``parities``, of 48-bit hashes and with about a cell for each of them: bounds that
    hold long texts apart, too."""
    cells = 1 << min(max(6, (len(top) - 1).bit_length()), MOST_CELLS)
    odd = np.bincount((top & np.uint64(cells - 1)).astype(np.int64), minlength=cells) & 1
    return np.packbits(odd.astype(bool), bitorder="little").tobytes()


def least_apart(one: bytes, other: bytes) -> int:
    """Hashes that only one of two sets has, at least, by their ``odd_cells``."""
    x, y = np.frombuffer(one, np.uint8), np.frombuffer(other, np.uint8)
    while len(x) != len(y):  # the halves of the longer one fall into the same cells
        if len(x) < len(y):
            x, y = y, x
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    return int(np.bitwise_count(x ^ y).sum())


def row_key() -> Column:
    return F.xxhash64(F.col("doc_id").cast("long"), "text")


def texts_of(docs: DataFrame) -> DataFrame:
    """(key, text) of every row of ``docs``: a hash of id and text, and the text's bytes."""
    return docs.select(row_key().alias("key"), F.col("text").cast("binary").alias("text"))


def _node(packed: bytes) -> int:
    return xxhash.xxh64_intdigest(packed, 42)


def shingle_sets(docs: DataFrame, width: int) -> DataFrame:
    """(key, doc_id, node, size, fp, p0 to p3, odd) of every row: a hash of id and text, a hash
    of its set, the set's size, SimHash, parities and odd cells."""
    bound_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, nodes, fps, odd, cells = [], [], [], [], []
            for h in shingle_hashes([t.as_py() or b"" for t in batch.column(2)], width):
                packed = pack(h)
                sizes.append(len(packed) // 6)
                nodes.append(_node(packed))
                fps.append(simhash(h))
                odd.append(parities(h))
                cells.append(odd_cells(unpack(packed)))
            odd = np.stack(odd, axis=1) if odd else np.zeros((4, 0), np.int64)
            yield pa.record_batch({"key": batch.column(0), "doc_id": batch.column(1), "node": pa.array(np.array(nodes, np.uint64).view(np.int64)), "size": pa.array(sizes, pa.int32()), "fp": pa.array(np.array(fps, np.uint64).view(np.int64)), **{name: pa.array(odd[k]) for k, name in enumerate(PARITIES)}, "odd": pa.array(cells, pa.binary())})

    return docs.select(row_key().alias("key"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")).mapInArrow(lean(run), _ROWS)


def _from_sets(texts: DataFrame, width: int, run, schema: str) -> DataFrame:
    """``run`` over batches (node, shingles) of the sets of ``texts``, which stay in their task."""
    bound_batches(texts.sparkSession)

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packed = [pack(h) for h in shingle_hashes([t.as_py() or b"" for t in batch.column(0)], width)]
            nodes = np.array([_node(x) for x in packed], np.uint64).view(np.int64)
            yield pa.record_batch({"node": pa.array(nodes), "shingles": pa.array(packed, pa.binary())})

    return texts.select("text").mapInArrow(lean(lambda batches: run(sets(batches))), schema)


# --- places where sets meet ------------------------------------------------------------


def common_shingles(texts: DataFrame, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of shingles that many texts hold, and their counts: at most COMMON."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def counted():
            values, counts = np.unique(np.concatenate(held), return_counts=True)
            return pa.record_batch({"h": pa.array(values[counts >= OFTEN].view(np.int64)), "n": pa.array(counts[counts >= OFTEN])})

        for batch in batches:
            for x in batch.column(1):
                held.append(unpack(x.as_py()))
                n += len(held[-1])
                if n > 1 << 18:
                    yield counted()
                    held, n = [], 0
        if held:
            yield counted()

    found = _from_sets(texts, width, run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "h").limit(COMMON).toArrow()
    hashes, counts = found.column("h").to_numpy().astype(np.uint64), found.column("n").to_numpy()
    order = np.argsort(hashes)
    return hashes[order], counts[order]


def _merged(one: tuple[np.ndarray, np.ndarray], other: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Shingles of either with their larger counts; at most COMMON, those of most."""
    hashes, place = np.unique(np.concatenate((one[0], other[0])), return_inverse=True)
    counts = np.zeros(len(hashes), np.int64)
    np.maximum.at(counts, place, np.concatenate((one[1], other[1])))
    keep = np.sort(np.argsort(-counts, kind="stable")[:COMMON])
    return hashes[keep], counts[keep]


def _up(x):
    return np.ceil(x - 1e-9).astype(np.int64)


def _may_reach(least: float, n, at, m, other) -> np.ndarray:
    """Whether sets of n and m shingles that share the ones at these places can have the similarity."""
    return np.minimum(at, other) + 1 + np.minimum(n - at - 1, m - other - 1) >= _up((n + m) * (least / (1 + least)))


def _firsts(least: float, common: tuple[np.ndarray, np.ndarray]):
    """The first shingles of each set in the common order: (key, node, size, at). Copies that
    follow each other in a task pass once."""
    hashes, counts = common

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            keys, nodes, sizes, places = [], [], [], []
            for node, x in zip(batch.column(0).to_pylist(), batch.column(1)):
                if node in seen:
                    continue
                if len(seen) >= REMEMBERED:
                    seen.clear()
                seen.add(node)
                own = unpack(x.as_py())
                n = len(own)
                if not n:
                    continue
                take = n - int(_up(least * n)) + 1
                if len(hashes):
                    place = np.minimum(np.searchsorted(hashes, own), len(hashes) - 1)
                    often = np.where(hashes[place] == own, counts[place], 0)
                    if often.any():
                        own = own[np.argsort(often, kind="stable")]
                keys.append(own[:take])
                nodes.append(np.full(take, node))
                sizes.append(np.full(take, n, np.int32))
                places.append(np.arange(take, dtype=np.int32))
            if keys:
                yield pa.record_batch({"key": pa.array(np.concatenate(keys).view(np.int64)), "node": pa.array(np.concatenate(nodes)), "size": pa.array(np.concatenate(sizes)), "at": pa.array(np.concatenate(places))})

    return run


def _shared(least: float | None):
    """Of rows sorted by key and node, each node once in a bucket, and buckets of several only;
    with ``least``, without the rows that can reach it with no other of their bucket."""

    def once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in batches:
            key, node = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            if not len(key):
                continue
            fresh = np.ones(len(key), bool)
            fresh[1:] = (key[1:] != key[:-1]) | (node[1:] != node[:-1])
            fresh[0] = last != (key[0], node[0])
            last = (key[-1], node[-1])
            yield batch.filter(pa.array(fresh))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_runs(once(batches), "key", 1 << 15):
            bounds = run_bounds(table.column("key").to_numpy())
            sizes = np.diff(bounds)
            if least is None:
                keep = np.repeat(sizes > 1, sizes)
            else:
                keep = np.repeat(sizes > NEIGHBOURS, sizes)
                size, at = (table.column(c).to_numpy() for c in ("size", "at"))
                i, j = pairs_in_runs(bounds, NEIGHBOURS)
                ok = _may_reach(least, size[i], at[i], size[j], at[j])
                keep[i[ok]] = keep[j[ok]] = True
            yield from table.filter(pa.array(keep)).to_batches()

    return run


# --- pairs ----------------------------------------------------------------------------------


def _apart(least: float, star: int | None):
    """Pairs of sets in different components that share a bucket: (u, v) around one set of each
    bucket (in round 0 the one that shares most buckets, later that one outside the largest
    component), to which each other set is paired in one bucket only, the one that is drawn
    for it; or, without ``star``, all, packed by u with sizes and numbers of buckets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_runs(batches, "key", 1 << 15):
            key, node, size, at, label, shared = (table.column(c).to_numpy() for c in ("key", "node", "size", "at", "label", "shared"))
            odd = np.stack([table.column(c).to_numpy() for c in PARITIES]).view(np.uint64)
            drawn = np.ones(len(key), bool) if star is None else table.column("drawn").to_numpy(zero_copy_only=False)
            bounds = run_bounds(key)
            i, j = pairs_in_runs(bounds, 2)
            ok = (label[i] != label[j]) & (drawn[i] | drawn[j])
            found, held = [(i[ok], j[ok])], 0

            def rows():
                i, j = (np.concatenate([f[k] for f in found]) for k in (0, 1))
                ok = _may_reach(least, size[i], at[i], size[j], at[j])
                i, j = i[ok], j[ok]
                apart = sum(np.bitwise_count(p[i] ^ p[j]).astype(np.int64) for p in odd)
                ok = apart <= size[i] + size[j] - 2 * _up((size[i] + size[j]) * (least / (1 + least)))
                i, j = i[ok], j[ok]
                i, j = np.where(node[i] < node[j], i, j), np.where(node[i] < node[j], j, i)
                order = np.lexsort((node[j], node[i]))
                i, j = i[order], j[order]
                pair = np.stack((node[i], node[j]), axis=1).view([("u", np.int64), ("v", np.int64)]).reshape(-1)
                starts = run_bounds(pair)
                n, i, j = np.diff(starts).astype("<i4"), i[starts[:-1]] if len(i) else i, j[starts[:-1]] if len(j) else j
                if star is not None:
                    return pa.record_batch({"u": pa.array(node[i]), "v": pa.array(node[j])})
                lists = run_bounds(node[i])
                others = [node[j[s:e]].astype("<i8").tobytes() + size[j[s:e]].astype("<i4").tobytes() + n[s:e].tobytes() for s, e in zip(lists[:-1], lists[1:])] if len(i) else []
                return pa.record_batch({"u": pa.array(node[i[lists[:-1]]] if len(i) else node[i]), "size": pa.array(size[i[lists[:-1]]] if len(i) else size[i]), "others": pa.array(others, pa.binary())})

            for s, e in zip(bounds[:-1], bounds[1:]):
                if e - s < 3:
                    continue
                own = label[s:e]
                if star is None:
                    hubs = range(s, e - 1)
                elif star == 0:
                    hubs = [s + int(np.argmax(shared[s:e]))]
                else:
                    labels, where, counts = np.unique(own, return_inverse=True, return_counts=True)
                    hubs = [s + int(np.argmax(np.where(where != counts.argmax(), shared[s:e], 0)))] if len(labels) > 1 else []
                for i in hubs:
                    j = np.flatnonzero(own != label[i]) + s
                    j = j[j > i] if star is None else j[drawn[j]]
                    if len(j):
                        found.append((np.full(len(j), i), j))
                        held += len(j)
                    if held > 1 << 18:
                        yield rows()
                        found, held = [], 0
            if found:
                yield rows()

    return run


def _enough(least: float):
    """Pairs (u, v) that share so many of their first shingles, over all buckets, that they can
    have the similarity: of the set whose first shingles end earlier in the order, only the
    others can be shared besides. Rows are sorted by u, whose ``others`` are packed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = lambda n: _up(n * least) - 1
        for table in whole_runs(batches, "u", 4096):
            held = [[], [], [], []]
            for u, size, data in zip(table.column("u").to_pylist(), table.column("size").to_pylist(), table.column("others").to_pylist()):
                m = len(data) // 16
                for out, x in zip(held, (np.full(m, u), np.full(m, size), np.frombuffer(data, "<i8", m), np.frombuffer(data, "<i4", 2 * m, 8 * m))):
                    out.append(x)
            if not held[0]:
                continue
            u, own, v = (np.concatenate(x) for x in held[:3])
            size, n = (np.concatenate([x.reshape(2, -1)[k] for x in held[3]]) for k in (0, 1))
            order = np.lexsort((v, u))
            u, own, v, size, n = u[order], own[order], v[order], size[order], n[order].astype(np.int64)
            starts = run_bounds(np.stack((u, v), axis=1).view([("u", np.int64), ("v", np.int64)]).reshape(-1))[:-1]
            n = np.add.reduceat(n, starts)
            u, own, v, size = u[starts], own[starts], v[starts], size[starts]
            ok = n + np.maximum(rest(own), rest(size)) >= _up((own + size) * (least / (1 + least)))
            yield pa.record_batch({"u": pa.array(u[ok]), "v": pa.array(v[ok])})

    return run


def _similar(least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = []
            for a, b in zip(batch.column(2), batch.column(3)):
                x, y = unpack(a.as_py()), unpack(b.as_py())
                both = len(np.intersect1d(x, y, assume_unique=True))
                near.append(both >= least * (len(x) + len(y) - both) - 1e-9)
            yield pa.record_batch({"u": batch.column(0), "v": batch.column(1)}).filter(pa.array(near, pa.bool_()))

    return run


def _may_be(least: float):
    """Pairs (u, v) that sizes and odd cells do not rule out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = batch.column(2).to_numpy().astype(np.int64) + batch.column(3).to_numpy()
            most = both - 2 * _up(both * (least / (1 + least)))
            apart = np.array([least_apart(a.as_py(), b.as_py()) for a, b in zip(batch.column(4), batch.column(5))], np.int64)
            yield pa.record_batch({"u": batch.column(0), "v": batch.column(1)}).filter(pa.array(apart <= most))

    return run


def similar_links(texts: DataFrame, rows: DataFrame, width: int, pairs: DataFrame, least: float) -> DataFrame:
    """Those of the distinct ``pairs`` (u, v) whose sets have the similarity. ``rows`` (key,
    node, size, odd) tells whose they are. Only sets of pairs that odd cells leave open are
    computed, each from one row of ``texts``."""
    pairs = stage(pairs, "similar-pairs")
    n = pairs.count()
    if not n:
        return pairs

    def nodes(pairs: DataFrame, n: int) -> DataFrame:
        ids = pairs.select(F.explode(F.array("u", "v")).alias("node")).distinct()
        return F.broadcast(ids) if 2 * n <= SENT else ids

    def with_both(pairs: DataFrame, of: DataFrame, *columns: str) -> DataFrame:
        for end in "vu":
            pairs = pairs.join(of.select(F.col("node").alias(end), *[F.col(c).alias(f"{c}_{end}") for c in columns]), end)
        return pairs.select("u", "v", *[f"{c}_{end}" for c in columns for end in "uv"])

    whose = stage(rows.join(nodes(pairs, n), "node", "left_semi").groupBy("node").agg(F.min("key").alias("key"), F.first("size").alias("size"), F.first("odd").alias("odd")), "similar-whose")
    left = stage(with_both(pairs, whose, "size", "odd").mapInArrow(lean(_may_be(least)), "u long, v long"), "similar-open")
    drop_staged(pairs)
    n = left.count()
    if not n:
        drop_staged(whose)
        return left
    keys = whose.join(nodes(left, n), "node", "left_semi").select("key")
    own = texts.join(F.broadcast(keys) if 2 * n <= SENT else keys, "key", "left_semi")
    held = stage(_from_sets(own, width, lambda batches: batches, "node long, shingles binary").groupBy("node").agg(F.first("shingles").alias("shingles")), "similar-sets")
    links = stage(with_both(left, held, "shingles").mapInArrow(lean(_similar(least)), "u long, v long"), "similar-links")
    for done in (whose, left, held):
        drop_staged(done)
    return links


def fingerprint_pairs(sets: DataFrame) -> DataFrame:
    """Pairs (u, v) of sets whose fingerprints differ in two bits at most: around one set of
    each fingerprint, and a forest over the fingerprints that Golay keys link."""
    known = stage(sets.where("size > 0").select("fp", "node").distinct(), "similar-fingerprints")
    first = known.groupBy("fp").agg(F.min("node").alias("u"))
    equal = known.join(first, "fp").where("node <> u").select("u", F.col("node").alias("v"))
    forest = link_fingerprints(known.select("fp")).select(F.col("u").alias("a"), F.col("v").alias("b"))
    near = forest.join(first.select(F.col("fp").alias("a"), "u"), "a").join(first.select(F.col("fp").alias("b"), F.col("u").alias("v")), "b").select("u", "v")
    return equal.union(near).distinct()


def similar_components(docs: DataFrame, sets: DataFrame, width: int, least: float) -> DataFrame:
    """(node, component) of all nodes of ``sets``, the shingle sets of ``docs``, that links of
    Jaccard similarity ``least`` or more join to others; no pair is left out."""
    n = shuffle_partitions(sets.sparkSession)
    texts = texts_of(docs)
    links = similar_links(texts, sets, width, fingerprint_pairs(sets), least)
    comps = stage(connected_components(links), "similar-components")
    common = common_shingles(texts, width)

    def dealt_firsts(texts: DataFrame, least_met: float | None) -> DataFrame:
        schema = "key long, node long, size int, at int"
        first = _from_sets(texts, width, _firsts(least, common), schema)
        return first.repartition(n, "key").sortWithinPartitions("key", "node").mapInArrow(lean(_shared(least_met)), schema)

    some = texts.where(F.pmod("key", F.lit(SAMPLE)) == 0)
    for _ in range(ORDERS):  # by a sample: the order bears on speed only, and whole tables are dealt once
        crowds = dealt_firsts(some, None).groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > CROWD / SAMPLE).orderBy(F.desc("n"), "key").limit(COMMON).toArrow()
        mended = _merged(common, (crowds.column("key").to_numpy().astype(np.uint64), SAMPLE * crowds.column("n").to_numpy()))
        if np.array_equal(mended[0], common[0]):
            break
        common = mended
    met = stage(dealt_firsts(texts, least), "similar-met")
    # a text that copies were made from shares more buckets than they: their edits are in none
    lots = [F.xxhash64("key", F.lit(k)) for k in range(STARS)]
    known = sets.groupBy("node").agg(*[F.first(c).alias(c) for c in PARITIES]).join(met.groupBy("node").agg(F.count("*").alias("shared"), F.array(*map(F.min, lots)).alias("lots")), "node")
    members = stage(met.join(known, "node"), "similar-members")
    drop_staged(met)
    star: int | None = 0
    while True:
        drawn = F.lit(True) if star is None else lots[star] == F.col("lots")[star]
        sent = F.broadcast(comps) if comps.count() <= FEW_NODES else comps
        now = members.join(sent, "node", "left").select("key", "node", "size", "at", "shared", *PARITIES, F.coalesce("component", "node").alias("label"), drawn.alias("drawn"))
        dealt = now.repartition(n, "key").sortWithinPartitions("key", "node")
        if star is None:  # only this round sees all that two sets share
            lists = dealt.mapInArrow(lean(_apart(least, None)), "u long, size int, others binary")
            met = lists.repartition(n, "u").sortWithinPartitions("u").mapInArrow(lean(_enough(least)), "u long, v long")
        else:
            met = dealt.mapInArrow(lean(_apart(least, star)), "u long, v long").distinct()
        more = similar_links(texts, sets, width, met, least)
        found = not more.isEmpty()
        if found:
            links = links.union(more)
            old, comps = comps, stage(connected_components(links), "similar-components")
            drop_staged(old)
        if star is None:
            break
        star = star + 1 if found and star + 1 < STARS else None
    drop_staged(members)
    return comps


def keep_one(docs: DataFrame, width: int = 5, least: float = 0.8) -> DataFrame:
    """``docs`` without near-duplicates: of each group that links of Jaccard similarity
    ``least`` or more on shingles of ``width`` words join, one row stays, that of the smallest
    doc_id; null ids come last, rows of one id by a hash of their text. Rows are told apart
    by id and text: unlike texts that share an id, or have none, all stay. Wordless and
    null texts are one group. Columns of any name pass unchanged; an empty table stays empty.
    ``docs`` is read several times: it should be a stored table."""
    sets = stage(shingle_sets(docs, width), "similar-rows")
    comps = similar_components(docs, sets, width, least)
    found = sets.select("key", "doc_id", "node").join(comps, "node", "left").select("key", "doc_id", F.coalesce("component", "node").alias("root"))
    first = found.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "key"))["key"].alias("key")).select("key", F.lit(True).alias("stays"))
    keys = stage(found.groupBy("key").agg(F.count("*").alias("n")).join(first, "key", "left").select("key", "n", F.coalesce("stays", F.lit(False)).alias("stays")), "similar-keys")
    drop_staged(sets)
    # those that go are fewer than those that stay: their keys are joined, and texts stay put where Spark finds the keys few enough to send to all tasks
    name = free_name(docs, "key")
    keyed = docs.withColumn(name, row_key())
    gone = stage(keys.where("NOT stays OR n > 1").select(F.col("key").alias(name)), "similar-gone")
    kept = keyed.join(gone, name, "left_anti").drop(name)
    repeated = keys.where("stays AND n > 1").select(F.col("key").alias(name))
    if repeated.isEmpty():
        return kept
    return kept.union(keyed.join(repeated, name, "left_semi").dropDuplicates([name]).drop(name))
