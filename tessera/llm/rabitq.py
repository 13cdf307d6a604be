"""Near-duplicate vectors by randomised-rotation binary codes.

A unit vector is rotated at random and kept as the signs of its components, with two
correction factors: the inner product of the code with the vector it stands for, and
the width that follows from it. Of a code and another vector's rotation, kept in four bits a
component, they give an unbiased estimate of the cosine and a confidence bound. Pairs whose
upper bound stays under the threshold are done with; all others are computed again from the
vectors in double precision, so no link is ever wrong.

Which pairs meet: signs of further random directions form bands of bits, and vectors of
equal label that agree in a whole band meet. The number of bits follows from the
largest label's size, the number of bands from the wanted recall at the threshold, so
work grows nearly in proportion at every size. Codes alone travel to the bands. A pair
counts in the first band that it agrees in only, and vectors follow only to where they have
such a pair that the bounds leave open. Sums of codes and four-bit numbers are integers, so
a pair is judged alike wherever it meets. Buckets beyond a size are dealt out in tiles, each
pair of tiles to a task of its own. Equal vectors are one representative with a count.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import connected_components, drop_staged, lean, merge_labels, pairs_in_runs, run_bounds, shuffle_partitions, stage, whole_runs

TILE = 2048  # representatives of a bucket that meet at once
SIGMAS = 5.0  # width of the confidence bounds
RECALL = 0.999  # of pairs exactly at the threshold; closer pairs fare better
LENGTHS = 64  # different lengths of vectors that one table may have


@dataclass(frozen=True)
class Rotations:
    """What all tasks share: a rotation for the codes, directions for the bands."""

    dimension: int
    bits: int
    bands: int
    seed: int = 11
    element: str = "<f8"  # of components as they travel

    @property
    def kind(self) -> str:
        """Of a band's bits."""
        return "<u1" if self.bits <= 8 else "<u2" if self.bits <= 16 else "<u4"

    def matrices(self) -> tuple[np.ndarray, np.ndarray]:
        rng = np.random.default_rng(self.seed)
        rotation, upper = np.linalg.qr(rng.standard_normal((self.dimension, self.dimension)))
        return rotation * np.sign(np.diag(upper)), rng.standard_normal((self.dimension, self.bits * self.bands))


def band_sizes(largest: int, threshold: float, recall: float = RECALL) -> tuple[int, int]:
    """(bits, bands): bits so that a bucket of unlike vectors stays near 64 rows, bands so
    that a pair at the threshold agrees in one of them with probability ``recall``."""
    bits = max(6, min(24, math.ceil(math.log2(max(largest, 1) / 64 + 1))))
    agree = 1 - math.acos(min(1.0, max(-1.0, threshold))) / math.pi
    return bits, math.ceil(math.log(1 - recall) / math.log(1 - agree**bits)) if agree < 1 else 1


def scaled(vectors: np.ndarray) -> np.ndarray:
    """Vectors times a power of two each, so that squares neither overflow nor vanish; their
    cosines stay what they are, to the last bit."""
    _, exponents = np.frexp(np.abs(vectors).max(axis=1))
    return np.ldexp(vectors, -exponents[:, None])


def encode(unit: np.ndarray, rotation: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(codes, corrections, widths) of unit vectors: packed signs of the rotated vectors,
    the inner product of code and vector, and the standard error that the code leaves."""
    turned = unit @ rotation
    inner = np.abs(turned).sum(axis=1) / math.sqrt(unit.shape[1])
    width = np.sqrt(np.maximum(0.0, 1 - inner**2)) / np.maximum(inner, 1e-9) / math.sqrt(max(unit.shape[1] - 1, 1))
    return np.packbits(turned > 0, axis=1), inner, width


def quantize(turned: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(numbers from -7 to 7, steps) of rotated vectors: numbers times step are the components
    on average, as they are rounded up or down at random."""
    step = np.abs(turned).max(axis=1) / 7 + 1e-12
    dither = np.random.default_rng(seed).random(turned.shape[1])  # the same for every vector, so that equal vectors have equal numbers
    return np.clip(np.floor(turned / step[:, None] + dither), -7, 7).astype(np.int8), step


def estimate(codes: np.ndarray, inner: np.ndarray, turned: np.ndarray) -> np.ndarray:
    """Unbiased estimates of the inner products of coded vectors (rows) with unit vectors
    given rotated (columns)."""
    d = turned.shape[1]
    signs = np.unpackbits(codes, axis=1, count=d).astype(np.float32) * 2 - 1
    return (signs @ turned.T.astype(np.float32)) / (math.sqrt(d) * inner[:, None])


def representatives(vectors: DataFrame) -> DataFrame:
    """(vec_id, label, vector, valid) of each row, vector the components in double precision."""
    parts = F.col("embedding").cast("array<double>")
    valid = F.col("label").isNotNull() & F.col("embedding").isNotNull() & ~F.exists(parts, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(parts, lambda x: x != 0)
    # -0.0 and 0.0 are one value
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), F.transform(parts, lambda x: x + F.lit(0.0)).alias("vector"), valid.alias("valid"))
    return rows


class Cell:
    """Rows of a table sorted by key, read into arrays. Pairs (i, j) are ordered by ``rep``,
    and judged by the code of i and the numbers of j."""

    def __init__(self, table: pa.Table, shared: Rotations, threshold: float):
        own = lambda name: table.column(name).to_numpy()
        matrix = lambda name, kind: np.frombuffer(b"".join(table.column(name).to_pylist()), kind).reshape(table.num_rows, -1)
        d = shared.dimension
        self.d, self.threshold = d, threshold
        self.key, self.rep, self.band, self.role = (own(c) for c in ("key", "rep", "band", "role"))
        self.inner, self.width, self.step = (own(c).astype(np.float64) for c in ("inner", "width", "step"))
        self.signs = np.unpackbits(matrix("code", np.uint8), axis=1, count=d).astype(np.float32) * 2 - 1
        packed = matrix("numbers", np.uint8)
        self.numbers = np.stack((packed & 15, packed >> 4), axis=2).reshape(table.num_rows, -1)[:, :d].astype(np.float32) - 8
        self.signature = matrix("signature", shared.kind)

    def upper(self, total: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Upper bounds of cosines from the integer sums of codes and numbers."""
        guess = total * self.step[j] / (math.sqrt(self.d) * self.inner[i])
        return guess + SIGMAS * np.sqrt(self.width[i] ** 2 + (self.step[j] / (2 * self.inner[i])) ** 2)

    def open_pairs(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs that count here: their bounds leave them open, and this is the first band in
        which they agree."""

        def kept(i: np.ndarray, j: np.ndarray, total: np.ndarray):
            ok = self.upper(total, i, j) >= self.threshold
            i, j = i[ok], j[ok]
            for at in range(0, len(i), 1 << 17):
                a, b = i[at : at + (1 << 17)], j[at : at + (1 << 17)]
                first = np.argmax(self.signature[a] == self.signature[b], axis=1) == self.band[a]
                yield a[first], b[first]

        def ordered(i: np.ndarray, j: np.ndarray):
            swap = self.rep[i] > self.rep[j]
            return np.where(swap, j, i), np.where(swap, i, j)

        bounds = run_bounds(self.key)
        i, j = pairs_in_runs(bounds, 64)
        for at in range(0, len(i), 1 << 18):
            a, b = i[at : at + (1 << 18)], j[at : at + (1 << 18)]
            ok = ((self.role[a] < 0) | (self.role[a] != self.role[b])) & (self.rep[a] != self.rep[b])  # a pair of unlike tiles holds pairs between the tiles only
            a, b = ordered(a[ok], b[ok])
            yield from kept(a, b, np.einsum("ij,ij->i", self.signs[a], self.numbers[b]))
        for s, e in zip(bounds[:-1], bounds[1:]):
            if e - s <= 64:
                continue
            own = np.arange(s, e)[np.argsort(self.rep[s:e], kind="stable")]
            for at in range(0, len(own), 512):
                rows = own[at : at + 512]
                later = own[at:]
                total = self.signs[rows] @ self.numbers[later].T
                a, b = np.nonzero(self.upper(total, rows[:, None], later[None, :]) >= self.threshold)
                i, j = rows[a], later[b]
                ok = (self.rep[i] < self.rep[j]) & ((self.role[i] < 0) | (self.role[i] != self.role[j]))
                yield from kept(i[ok], j[ok], total[a, b][ok])


def _active(threshold: float, shared: Rotations):
    """(key, rep, band, role) of the rows that have a pair to be computed here."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_runs(batches, "key", 8192):
            cell = Cell(table, shared, threshold)
            hit = np.zeros(table.num_rows, bool)
            for i, j in cell.open_pairs():
                hit[i] = hit[j] = True
            yield from table.select(["key", "rep", "band", "role"]).filter(pa.array(hit)).combine_chunks().to_batches()

    return run


def _links(threshold: float, shared: Rotations):
    """(rep, n, root): of each representative the rows that it links with, counted by copies,
    and the smallest representative that links of the table reach."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_runs(batches, "key", 4096):
            cell = Cell(table, shared, threshold)
            _, label = np.unique(np.array(table.column("label").to_pylist(), object).astype(str), return_inverse=True)
            copies = table.column("copies").to_numpy()
            vectors = scaled(np.frombuffer(b"".join(table.column("data").to_pylist()), shared.element).reshape(table.num_rows, -1).astype(np.float64))
            norms = np.sqrt((vectors * vectors).sum(axis=1))
            nodes, node = np.unique(cell.rep, return_inverse=True)
            counts, labels = np.zeros(len(nodes), np.int64), np.arange(len(nodes))
            for i, j in cell.open_pairs():
                same = label[i] == label[j]  # buckets are hashes of labels and bands
                i, j = i[same], j[same]
                cosine = np.einsum("ij,ij->i", vectors[i], vectors[j]) / (norms[i] * norms[j])
                i, j = i[cosine >= threshold], j[cosine >= threshold]
                np.add.at(counts, node[i], copies[j])
                np.add.at(counts, node[j], copies[i])
                labels = merge_labels(labels, node[i], node[j])
            keep = counts > 0
            yield pa.record_batch({"rep": pa.array(nodes[keep]), "n": pa.array(counts[keep]), "root": pa.array(nodes[labels][keep])})

    return run


def near_vectors(vectors: DataFrame, threshold: float = 0.93, seed: int = 11) -> DataFrame:
    """Near-duplicates among ``vectors`` (vec_id, embedding, label; other columns are
    ignored): for each row vec_id, n_links (other rows linked to it directly),
    component_id (smallest vec_id that links reach) and kept (vec_id = component_id).

    Two vectors link if their labels are equal and not null and their cosine, in double
    precision, reaches ``threshold`` (over 0). Vectors that are null, zero, or hold a
    null or non-finite component link with nothing, nor do vectors of unlike lengths.
    Rows of equal vectors link with each other. Rows of equal vec_id count as rows of
    their own, joined to the result of their own vector; a null vec_id is kept by
    none. An empty table gives an empty result. More than LENGTHS lengths are an error."""
    n = shuffle_partitions(vectors.sparkSession)
    rows = representatives(vectors)
    names = (F.xxhash64("label", "vector").alias("h"), F.xxhash64(F.lit(1), "vector", "label").alias("g"))  # 128 bits stand for a vector where its own row is looked up
    groups = rows.where("valid").groupBy("label", "vector").agg(F.min("vec_id").alias("low"), F.count("*").alias("copies"))
    reps = stage(groups.select("*", F.monotonically_increasing_id().alias("rep"), *names), "vectors")
    sizes = sorted(r["d"] for r in reps.select(F.size("vector").alias("d")).distinct().limit(LENGTHS + 1).collect())
    if len(sizes) > LENGTHS:
        raise ValueError(f"vectors of more than {LENGTHS} different lengths")
    largest = reps.groupBy("label").count().agg(F.max("count")).first()[0] or 0
    bits, bands = band_sizes(largest, threshold)
    element = "<f4" if dict(vectors.dtypes)["embedding"] == "array<float>" else "<f8"
    edges = links = None
    for dimension in sizes:
        found = _links_of(reps.where(F.size("vector") == dimension), Rotations(dimension, bits, bands, seed, element), threshold, n)
        e, c = found.where("rep <> root").select(F.col("rep").alias("u"), F.col("root").alias("v")), found.groupBy("rep").agg(F.sum("n").alias("n"))
        edges, links = (e, c) if edges is None else (edges.union(e), links.union(c))
    if edges is None:
        return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.lit(0).cast("long").alias("n_links"), F.col("vec_id").cast("long").alias("component_id"), F.col("vec_id").isNotNull().alias("kept"))
    comps = connected_components(edges)
    joined = reps.select("rep", "low", "copies", "h", "g").join(comps.select(F.col("node").alias("rep"), "component"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    lows = joined.groupBy("component").agg(F.min("low").alias("component_id"))
    known = joined.join(lows, "component").join(links, "rep", "left").select("h", "g", "component_id", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("links"))
    own = rows.select("vec_id", "valid", *names)
    own = own.select("vec_id", F.when(F.col("valid"), F.col("h")).alias("h"), F.when(F.col("valid"), F.col("g")).alias("g"))
    return own.join(known, ["h", "g"], "left").select(
        "vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"), F.coalesce(F.col("vec_id") == F.coalesce("component_id", "vec_id"), F.lit(False)).alias("kept")
    )


def _coded(shared: Rotations):
    """Code, numbers and factors of each representative, its bits in each band, and its
    components as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rotation, directions = shared.matrices()
        weights = 1 << np.arange(shared.bits)
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                vectors = part.column("vector").flatten().to_numpy().reshape(-1, shared.dimension)
                unit = scaled(vectors)
                unit = unit / np.sqrt((unit * unit).sum(axis=1))[:, None]
                codes, inner, width = encode(unit, rotation)
                numbers, step = quantize(unit @ rotation, shared.seed)
                even = np.zeros((len(unit), shared.dimension + shared.dimension % 2), np.uint8)
                even[:, : shared.dimension] = numbers + 8
                packed = even[:, ::2] | even[:, 1::2] << 4
                bits = ((unit @ directions > 0).reshape(len(unit), shared.bands, shared.bits) * weights).sum(axis=2)
                raw = lambda x: pa.array([r.tobytes() for r in x], pa.binary())
                yield pa.record_batch(
                    {"rep": part.column("rep"), "label": part.column("label"), "copies": part.column("copies"), "data": raw(vectors.astype(shared.element)), "code": raw(codes), "numbers": raw(packed), "inner": pa.array(inner, pa.float32()), "width": pa.array(width, pa.float32()), "step": pa.array(step, pa.float32()), "bits": pa.array(bits.astype(np.int32).tolist(), pa.list_(pa.int32())), "signature": raw(bits.astype(shared.kind))}
                )

    return run


CODES = ("code", "numbers", "inner", "width", "step", "signature")


def _links_of(reps: DataFrame, shared: Rotations, threshold: float, n: int) -> DataFrame:
    """(rep, n, root), as ``_links`` finds them, among representatives of one length."""
    coded = stage(reps.select("rep", "label", "copies", "vector").mapInArrow(lean(_coded(shared)), "rep long, label string, copies long, data binary, code binary, numbers binary, inner float, width float, step float, bits array<int>, signature binary"), "vector-codes")
    banded = coded.select("rep", "label", *CODES, F.posexplode("bits").alias("band", "own"))
    keyed = banded.withColumn("bucket", F.xxhash64("label", "band", "own")).drop("label", "own")
    # sizes come from the keys alone; buckets beyond a tile meet by pairs of tiles
    sizes = keyed.groupBy("bucket").agg(F.count("*").alias("m")).where(f"m > {TILE}").withColumn("tiles", F.ceil(F.col("m") / TILE).cast("int")).select("bucket", "tiles")
    placed = keyed.join(sizes, "bucket", "left").withColumn("tile", F.when(F.col("tiles").isNotNull(), F.pmod(F.xxhash64("rep", F.lit(1)), F.col("tiles")).cast("int")))
    cells = F.when(F.col("tile").isNull(), F.array(F.struct(F.lit(-1).alias("a"), F.lit(-1).alias("b"), F.lit(-1).alias("role")))).otherwise(
        F.transform(F.sequence(F.lit(0), F.col("tiles") - 1), lambda t: F.struct(F.least(t, "tile").alias("a"), F.greatest(t, "tile").alias("b"), F.when(t == F.col("tile"), -1).when(F.col("tile") < t, 0).otherwise(1).alias("role")))
    )
    met = placed.withColumn("cell", F.explode(cells)).select(F.xxhash64("bucket", "cell.a", "cell.b").alias("key"), "rep", *CODES, "band", F.col("cell.role").alias("role"))
    active = stage(met.repartition(n, "key").sortWithinPartitions("key").mapInArrow(lean(_active(threshold, shared)), "key long, rep long, band int, role int"), "vector-open")
    open_ = active.join(coded.drop("bits"), "rep").select("key", "rep", "band", "role", "label", "copies", "data", *CODES)
    found = stage(open_.repartition(n, "key").sortWithinPartitions("key").mapInArrow(lean(_links(threshold, shared)), "rep long, n long, root long"), "vector-links")
    drop_staged(active)
    drop_staged(coded)
    return found


def op3_rabitq(spark, sf_dir: str) -> DataFrame:
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


OP3_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
u AS (SELECT vec_id, label, e, sqrt(list_dot_product(e, e)) AS n FROM v),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.label = b.label AND a.vec_id <> b.vec_id
      WHERE list_dot_product(a.e, b.e) / (a.n * b.n) >= 0.93),
r(a, b) AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a, min(b) AS low FROM r GROUP BY a),
k AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT m.vec_id, coalesce(k.n, 0) AS n_links, least(m.vec_id, coalesce(c.low, m.vec_id)) AS component_id,
       m.vec_id = least(m.vec_id, coalesce(c.low, m.vec_id)) AS kept
FROM embeddings m LEFT JOIN c ON c.a = m.vec_id LEFT JOIN k ON k.a = m.vec_id
"""
