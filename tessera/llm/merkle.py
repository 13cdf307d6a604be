"""Document fingerprints: Merkle trees over sections, paragraphs and their pieces.

A document's root covers its sections, a section its paragraphs (lines), a paragraph
its pieces (runs of about four words, cut the same way at every length of text). Roots are equal for equal
texts; where roots differ, equal branches are skipped and the differing ones tell
which spans of the text were edited. Sections end where the content says so, at a
blank line or by a paragraph's own hash, and pieces after words whose hash says so, so
an edit moves only the borders near it.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import bound_batches, lean, shuffle_partitions

PIECE = 96  # code points of a piece at most, besides the white space that ends it
SECTION = 8  # a section has about so many paragraphs
#: A piece ends after a word whose last character is one of these, which about every fourth
#: word of Latin script has, or after such a character of a script without spaces (about every
#: fourth of them): where it ends depends on what it says, not on where it stands.
LAST = "adhlt.T0"
WIDE = re.escape("".join(chr(c) for c in range(0x3000, 0xD800) if c * 0x9E37 >> 3 & 3 == 0))
_PIECES = re.compile(rf".{{0,{PIECE - 1}}}?(?:[{LAST}](?!\S)|[{WIDE}])\s*|.{{1,{PIECE}}}(?<=\s)|.{{1,{PIECE}}}\s*", re.DOTALL)


def _pieces(line: str) -> list[str]:
    """The line cut into pieces: after the first word that ends one, else after the last word
    of PIECE code points, else after as many."""
    return _PIECES.findall(line)


def _hash(data: bytes, size: int = 16) -> bytes:
    return hashlib.blake2b(data, digest_size=size).digest()


def _short(digest: bytes) -> str:
    return base64.urlsafe_b64encode(digest[:6]).decode()


class Node:
    """A branch: its hash, how many pieces and code points it has, and what is below: of a
    section its paragraphs, of a paragraph (hash, length) of its pieces. A paragraph's code
    points hold its line's end. ``text`` is the branch as fingerprints have it."""

    __slots__ = ("below", "digest", "length", "pieces", "text")

    def __init__(self, digest: bytes, length: int, pieces: int, below: list, text: str):
        self.digest, self.length, self.pieces, self.below, self.text = digest, length, pieces, below, text


def _paragraph(line: str) -> Node:
    pieces = _pieces(line)
    digests = [_hash(p.encode("utf-8", "surrogatepass")) for p in pieces]
    digest = _hash(b"p" + b"".join(digests))
    text = f"{_short(digest)}={base64.urlsafe_b64encode(b''.join([d[:6] for d in digests])).decode()}"
    return Node(digest, len(line) + 1, len(pieces), list(zip(digests, map(len, pieces))), text)


class Tree:
    """root (hex) and sections, nodes of paragraphs, which are nodes of pieces. Paragraphs of
    lines that ``known`` trees have are theirs."""

    def __init__(self, text: str, *known: Tree):
        self.sections: list[Node] = []
        self.lines: dict[str, Node] = {}
        now: list[Node] = []

        def end():
            digest = _hash(b"s" + b"".join([p.digest for p in now]))
            self.sections.append(Node(digest, sum([p.length for p in now]), sum([p.pieces for p in now]), list(now), f"{_short(digest)}:" + ";".join([p.text for p in now])))
            now.clear()

        for line in text.split("\n"):
            node = self.lines.get(line) or next((t.lines[line] for t in known if line in t.lines), None)
            self.lines[line] = node = node or _paragraph(line)
            now.append(node)
            if not line.strip() or node.digest[0] % SECTION == 0:
                end()
        if now:
            end()
        self.root = _hash(b"d" + b"".join([s.digest for s in self.sections]) + hashlib.sha256(text.encode("utf-8", "surrogatepass")).digest()).hex()
        self.pieces = sum([s.pieces for s in self.sections])

    def __str__(self) -> str:
        return self.root + "|" + "/".join([s.text for s in self.sections])


def parse(fingerprint: str) -> Tree:
    """The tree of a fingerprint; it knows hashes (as the fingerprint has them), not lengths."""
    tree = Tree.__new__(Tree)
    tree.root, _, rest = fingerprint.partition("|")
    tree.sections = []
    for section in rest.split("/"):
        own, _, paragraphs = section.partition(":")
        below = []
        for paragraph in paragraphs.split(";"):
            name, _, pieces = paragraph.partition("=")
            leaves = [(pieces[k : k + 8].encode(), 0) for k in range(0, len(pieces), 8)]
            below.append(Node(name.encode(), 0, len(leaves), leaves, paragraph))
        tree.sections.append(Node(own.encode(), 0, sum(p.pieces for p in below), below, section))
    tree.pieces = sum(s.pieces for s in tree.sections)
    return tree


def _below(nodes: list[tuple[Node, int]]) -> list[tuple[Node, int]]:
    """Branches below, with where each begins."""
    found = []
    for node, at in nodes:
        for below in node.below:
            found.append((below, at))
            at += below.length
    return found


def compare(one: Tree, other: Tree) -> tuple[float, list[tuple[int, int]]]:
    """How like two trees are, and the spans of code points of ``one`` whose pieces ``other``
    lacks. Branches of equal hash are alike as wholes and not looked into; of the others the
    branches below are compared, down to the pieces; repeats count. The likeness, 0 to 1, is
    twice the common pieces over all, and 1 only if the roots are equal."""
    if one.root == other.root:
        return 1.0, []
    own: list[tuple[Node, int]] = []
    at = 0
    for section in one.sections:
        own.append((section, at))
        at += section.length
    theirs, common = list(other.sections), 0
    for level in range(2):  # sections, then paragraphs
        alike = Counter([n.digest for n in theirs]) & Counter([n.digest for n, _ in own])
        left: list[tuple] = []
        taken = Counter(alike)
        for node, at in own:
            if taken[node.digest] > 0:
                taken[node.digest] -= 1
                common += node.pieces
            else:
                left.append((node, at))
        rest = []
        for node in theirs:
            if alike[node.digest] > 0:
                alike[node.digest] -= 1
            else:
                rest += node.below
        own, theirs = _below(left) if level == 0 else left, rest
    there = Counter([digest for digest, _ in theirs])
    spans: list[tuple[int, int]] = []
    for paragraph, at in own:
        for digest, length in paragraph.below:
            if there[digest] > 0:
                there[digest] -= 1
                common += 1
            elif spans and spans[-1][1] == at:
                spans[-1] = (spans[-1][0], at + length)
            else:
                spans.append((at, at + length))
            at += length
    total = one.pieces + other.pieces
    return (min(2.0 * common / total, 1 - 1e-9) if total else 0.0), spans


def likeness(one: str, other: str) -> float:
    """``compare`` of two fingerprints."""
    return compare(parse(one), parse(other))[0]


def edits(one: Tree, other: Tree) -> list[tuple[int, int]]:
    """Spans of code points of ``one`` whose pieces ``other`` lacks."""
    return compare(one, other)[1]


def fingerprint(text: str | None) -> str:
    return str(Tree(text or ""))


def with_next(docs: DataFrame) -> tuple[DataFrame, int]:
    """Rows (part, role, doc_id, text): each row of ``docs`` with role 0 in the part of
    the doc_id range that holds it, and each part's first rows once more, with role
    1, in the part before (cyclically), so that a sorted part has every row's
    successor. Parts and their firsts are a few numbers each."""
    spark = docs.sparkSession
    n = shuffle_partitions(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    cuts = np.unique(rows.select(F.percentile_approx("doc_id", [k / n for k in range(1, n)], 100 * n)).first()[0] or []).astype(np.int64) if n > 1 else np.zeros(0, np.int64)

    @F.pandas_udf("int")
    def part_of(doc_id: pd.Series) -> pd.Series:
        return pd.Series(np.where(doc_id.isna(), 0, np.searchsorted(cuts, doc_id.fillna(0).astype("int64"))), dtype="int32")

    rows = rows.withColumn("part", part_of("doc_id"))
    found = rows.groupBy("part").agg(F.min("doc_id"), F.max(F.col("doc_id").isNull())).collect()  # a row for each part
    firsts = sorted((part, None if has_null else low) for part, low, has_null in found)
    before = [(part, low, firsts[k - 1][0]) for k, (part, low) in enumerate(firsts)]
    known = spark.createDataFrame(before, "at int, low long, before int")
    joined = rows.join(F.broadcast(known), F.col("part") == F.col("at"), "left")
    again = F.when(F.col("doc_id").eqNullSafe(F.col("low")), F.struct(F.col("before").alias("part"), F.lit(1).alias("role")))
    both = F.array_compact(F.array(F.struct(F.col("part").alias("part"), F.lit(0).alias("role")), again))
    return joined.select(F.explode(both).alias("to"), "doc_id", "text").select("to.part", "to.role", "doc_id", "text"), max(len(firsts), 1)


def _compare(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by part, role, doc_id, text: every row with role 0 meets its successor,
    the next such row or the first with role 1."""

    def emit(row: tuple, after: tuple) -> dict:
        doc_id, text, own = row
        n = len(text)
        half = n // 2
        edited = text[: n - half] + after[1][:half]
        fresh = Tree(edited, own, after[2])
        like, spans = compare(own, fresh)
        return {"doc_id": doc_id, "n_chars": n, "edited_sha256": hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), "fingerprint": str(own), "edited_fingerprint": str(fresh), "near_edited": like, "near_next": compare(own, after[2])[0], "edits": ",".join(f"{s}:{e}" for s, e in spans)}

    schema = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64()), ("edits", pa.string())])
    last, part, closed = None, None, False
    for batch in batches:
        parts, roles, ids = (batch.column(k).to_pylist() for k in (0, 1, 2))
        for at in range(0, batch.num_rows, 250):
            out = []
            for k, text in enumerate(batch.column(3).slice(at, 250).to_pylist(), at):
                if parts[k] != part:
                    last, part, closed = None, parts[k], False
                if closed:
                    continue
                row = (ids[k], text or "", Tree(text or ""))
                if last is not None:
                    out.append(emit(last, row))
                last, closed = row, roles[k] == 1
            if out:
                yield pa.RecordBatch.from_pylist(out, schema)


def fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprint of each row of ``docs`` (doc_id, text; other columns are ignored) and of
    its edited text: the last floor(n/2) code points give way to the first as many (or
    all) of the next document by ascending doc_id; the first follows the last.

    Columns: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next, edits. A fingerprint is the root (32 hex digits), a bar, and the
    tree's hashes: sections parted by /, with paragraphs parted by ;, with pieces. edits are
    the spans of the text whose pieces the edited text lacks (start:end, comma-joined).
    Null texts count as empty. Rows with equal doc_id follow each other in order of
    text, null doc_ids come first. A lone row is its own successor; an empty table
    gives an empty result."""
    spread, parts = with_next(docs)
    bound_batches(docs.sparkSession)
    n = shuffle_partitions(docs.sparkSession)
    return spread.repartition(max(parts, n), "part").sortWithinPartitions("part", "role", "doc_id", "text").mapInArrow(
        lean(_compare), "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, edits string"
    )


def op1_merkle(spark, sf_dir: str) -> DataFrame:
    return fingerprints(spark.read.parquet(f"{sf_dir}/documents.parquet"))
