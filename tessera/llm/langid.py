"""Language identification: multinomial naive Bayes over hashed character n-grams.

Counts by language and bucket are summed over all training texts; the matrix of log
probabilities has a fixed number of buckets for each language and goes to all tasks.
Texts are scored in batches: the n-grams of many texts are one sparse matrix, given by
its rows (texts) and columns (buckets), whose product with the log probabilities is taken
language by language. Long texts pass through in pieces that overlap, so no n-gram is lost.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import bound_batches, free_name, lean, run_bounds

BUCKET_BITS = 15
ORDERS = (1, 2, 3)
EVIDENCE = 50.0  # n-grams that count as independent at most, for the score
STEP = 1 << 19  # code points of texts that are hashed at once
MOST_LANGUAGES = 1000  # that a model may have: 256 KB of it each go to all tasks

_letters: np.ndarray | None = None


def letters(text: str) -> np.ndarray:
    """Code points of the lower-cased text, 32 for everything that is no letter."""
    global _letters
    if _letters is None:
        table = np.full(1 << 16, 32, np.uint32)
        for code in range(1 << 16):
            if not 0xD800 <= code < 0xE000 and chr(code).isalpha():
                low = chr(code).lower()
                table[code] = ord(low[0])
        _letters = table
    codes = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
    if len(codes) and codes.max() >= 1 << 16:
        far = np.array([c < 1 << 16 or chr(c).isalpha() for c in codes.tolist()])
        return np.where(codes < 1 << 16, _letters[np.minimum(codes, 0xFFFF)], np.where(far, codes, 32)).astype(np.uint32)
    return _letters[codes]


def _hash(codes: np.ndarray, order: int) -> np.ndarray:
    """Bucket of the n-gram that starts at each place."""
    wide = codes.astype(np.uint64)
    n = len(wide) - order + 1
    key = wide[:n].copy()
    for k in range(1, order):
        key = key * np.uint64(0x100000001B3) + wide[k : n + k]
    key = (key + np.uint64(order)) * np.uint64(0x9E3779B97F4A7C15)
    return (key >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)


def grams(texts: Iterable[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(numbers of texts, ascending, and buckets) of all n-grams of all texts, in pieces of one
    order each. An n-gram lies in one text, whose runs of what is no letter count as one
    space; a lone space is none."""
    longest = max(ORDERS)
    held: list[tuple[np.ndarray, np.ndarray]] = []
    size, carried = 0, 0

    def piece(last: bool) -> list[tuple[np.ndarray, np.ndarray]]:
        nonlocal held, size, carried
        rows, codes = (np.concatenate([h[k] for h in held]) for k in (0, 1))
        again = (codes[1:] == 32) & (codes[:-1] == 32) & (rows[1:] == rows[:-1])
        again[: max(0, carried - 1)] = False
        keep = np.concatenate(([True], ~again))
        rows, codes = rows[keep], codes[keep]
        # places from which all n-grams are whole: the others wait for what follows
        ready = len(codes) if last else max(0, len(codes) - longest + 1)
        found = []
        for order in ORDERS:
            n = min(ready, len(codes) - order + 1)
            if n <= 0:
                continue
            ok = rows[:n] == rows[order - 1 : n + order - 1]
            if order == 1:
                ok &= codes[:n] != 32
            found.append((rows[:n][ok], _hash(codes, order)[:n][ok]))
        held, carried = [(rows[ready:], codes[ready:])], len(codes) - ready
        size = carried
        return found

    for k, text in enumerate(texts):
        for at in range(0, len(text), STEP):
            codes = letters(text[at : at + STEP])
            held.append((np.full(len(codes), k), codes))
            size += len(codes)
            if size >= STEP:
                yield from piece(False)
    if held:
        yield from piece(True)


class Model:
    """Languages in order of name, and log probabilities: a row for each language."""

    def __init__(self, languages: list[str], counts: np.ndarray, documents: np.ndarray, smoothing: float = 0.5):
        self.languages = languages
        if languages:
            smooth = counts + smoothing
            self.log = np.log(smooth / smooth.sum(axis=1, keepdims=True))
            self.prior = np.log((documents + 1) / (documents + 1).sum())

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """Languages and scores of a batch of texts."""
        m, count = len(texts), np.zeros(len(texts))
        if not self.languages:
            return ["und"] * m, count
        total = np.zeros((m, len(self.languages)))
        for rows, buckets in grams([t or "" for t in texts]):
            if len(rows):
                bounds = run_bounds(rows)
                own = rows[bounds[:-1]]
                count[own] += np.diff(bounds)
                for k, log in enumerate(self.log):
                    total[own, k] += np.add.reduceat(log.take(buckets), bounds[:-1])
        # n-grams of one text are far from independent: the score takes them as fewer
        odds = total * np.minimum(1.0, EVIDENCE / np.maximum(count, 1))[:, None] + self.prior
        best = np.argmax(total + self.prior, axis=1)
        score = np.clip(1.0 / np.exp(odds - odds[np.arange(m), best][:, None]).sum(axis=1), 0.0, 1.0)
        known = count > 0
        return [self.languages[b] if k else "und" for b, k in zip(best.tolist(), known)], np.where(known, score, 0.0)


def held_out(doc_id: str = "doc_id") -> Column:
    """Whether crc32 of the id as text leaves no remainder by 5; a null id is not held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(docs: DataFrame) -> Model:
    """A model of all rows with text, non-null lang and an id that is not held out. Tasks add
    up their texts' n-grams first; what is collected is a number for each language and
    bucket. More than MOST_LANGUAGES languages are an error."""

    bound_batches(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, np.ndarray] = {}
        for batch in batches:
            own, texts = np.array(batch.column(0).to_pylist(), object), batch.column(1).to_pylist()
            names, number = np.unique(own, return_inverse=True)
            for name in names:
                totals.setdefault(name, np.zeros((1 << BUCKET_BITS) + 1, np.int64))
            for k, name in enumerate(names):
                totals[name][-1] += int((number == k).sum())
            for rows, buckets in grams(texts):
                cells = np.bincount((number[rows] << BUCKET_BITS) + buckets, minlength=len(names) << BUCKET_BITS)
                for name, part in zip(names, cells.reshape(len(names), -1)):
                    totals[name][:-1] += part
            if len(totals) > MOST_LANGUAGES:
                raise ValueError(f"more than {MOST_LANGUAGES} languages")
        for name, total in totals.items():
            there = np.flatnonzero(total)
            yield pa.record_batch({"lang": pa.array([name] * len(there), pa.string()), "bucket": pa.array(there, pa.int32()), "n": pa.array(total[there])})

    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & ~held_out()).select(F.col("lang").cast("string"), "text")
    summed = rows.mapInArrow(lean(count), "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    languages = sorted(summed.column("lang").unique().to_pylist())
    if len(languages) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    counts = np.zeros((len(languages), (1 << BUCKET_BITS) + 1))
    if languages:
        place = {name: k for k, name in enumerate(languages)}
        names = summed.column("lang").combine_chunks().dictionary_encode()
        k = np.array([place[x] for x in names.dictionary.to_pylist()])[names.indices.to_numpy()]
        counts[k, summed.column("bucket").to_numpy()] = summed.column("n").to_numpy()
    return Model(languages, counts[:, :-1], counts[:, -1])


def predict(docs: DataFrame, model: Model, name: str = "label") -> DataFrame:
    """``docs`` with a column ``name``, a struct of lang_pred and score; other columns pass
    unchanged."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most 256 KB for each of MOST_LANGUAGES

    @F.arrow_udf("lang_pred string, score double")
    def label(texts: pa.Array) -> pa.Array:
        found, scores = shared.value.predict(texts.to_pylist())
        return pa.StructArray.from_arrays([pa.array(found, pa.string()), pa.array(scores, pa.float64())], ["lang_pred", "score"])

    # a filter on the label must not make Spark compute it twice
    return docs.withColumn(name, label.asNondeterministic()("text"))


def identify(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for each row of ``docs`` (doc_id, text, lang;
    other columns are ignored), learnt from the rows that are not held out.

    Texts that are null or have no letter are ``und`` with score 0, and so is every
    text if no row can be learnt from. A null doc_id is neither learnt from nor held
    out. Repeated rows count as often as they occur. Ties go to the first language by
    name. An empty table gives an empty result."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang")
    found = predict(rows.select("doc_id", "text"), train(rows))
    return found.select("doc_id", held_out().alias("held_out"), "label.lang_pred", "label.score")


def keep_identified(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """``docs`` without the documents that the model rejects: those it can't label, and
    those whose label has a score under ``least``. lang becomes the label where it is
    null; other columns, whatever their names, pass unchanged."""
    name = free_name(docs, "label")
    found = predict(docs, train(docs), name).where((F.col(f"{name}.lang_pred") != "und") & (F.col(f"{name}.score") >= least))
    return found.withColumn("lang", F.coalesce("lang", f"{name}.lang_pred")).drop(name)


def op9_langid(spark, sf_dir: str) -> DataFrame:
    return identify(spark.read.parquet(f"{sf_dir}/documents.parquet"))
