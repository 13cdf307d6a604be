"""Personal data by base patterns and bootstrapped contextual extraction.

Matches of the base patterns are seeds; identifier-like strings that no base pattern takes
are candidates. The words around identifiers induce lexical patterns: the last word before,
the last two, the first word after, and the words on both sides. Patterns and the instances
that they surround form a graph, which Spark scores in rounds: a pattern is as sure as the
share of its instances that are known or that other patterns vouch for, and it must be
specific, its words standing around identifiers in a good share of all their places; an
instance is as sure as its sure patterns together. Instances that are accepted are known from
then on, induce patterns as seeds do, and so on until nothing new is accepted. All places of
accepted instances are found, whatever stands around them.

Spans are in code points, end exclusive.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import bound_batches, drop_staged, free_name, lean, stage

KINDS = ("email", "ip", "card", "phone")
SCORINGS = 3  # of the graph in each round
MOST_ROUNDS = 20  # of induction; a chain of contexts longer than this is followed no further
SURE = 0.5  # score of a pattern that vouches, at least
ACCEPTED = 0.5  # score of an instance that is known from then on, at least
SUPPORT = 3  # different known instances that a pattern rests on, at least
SPECIFIC = 0.3  # share of all places of a pattern's words that stand around an identifier, at least
COUNTED = 400_000  # words that a task counts before it passes them on
LISTED = 200_000  # patterns up to which all tasks know them; beyond, all words and pairs are counted and joined
GAP = 3  # tokens of an identifier between two words, at most

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# a match never starts inside a run of digits: what fails at the run's start fails in it
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NUMBER = re.compile(r"(?<!\w)\+?\(?[0-9](?:[\x20()./:-]{0,2}[0-9]){6,}(?!\w)")
_SPELT = re.compile(r"(?<!\S)\S+\s?[\[(]at[\])]\s?\S+(?:\s?[\[(]dot[\])]\s?\S+)*", re.IGNORECASE)
_TOKEN = re.compile(r"\S+")
_STRIP = ".,;:!?()[]{}<>\"'|=*"


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = int(d) * (1 + k % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Around each @ in turn: the part before it begins where its characters begin, or
    at the last match's end, whatever follows. So no run is scanned twice."""
    last = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            last = m.end()
            yield start, last
        at = text.find("@", at + 1)


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) by kind, then start: leftmost matches that do not overlap others
    of their kind; matches that fail their kind's test are dropped."""
    found = [("email", s, e) for s, e in emails(text)]
    found += [("ip", *m.span()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
    found += [("card", *m.span()) for m in _CARD.finditer(text) if 13 <= len(d := _digits(m[0])) <= 19 and luhn(d)]
    found += [("phone", *m.span()) for m in _PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15] if "+" in text else []
    return found


def likely(value: str) -> list[str]:
    """Kinds that an identifier-like string may be of."""
    if "@" in value or _SPELT.fullmatch(value):
        return ["email"]
    digits = len(_digits(value))
    kinds = ["ip"] if re.fullmatch(r"[0-9]{1,3}(?:[.:-][0-9]{1,3}){3}(?:[:/][0-9]+)?", value) else []
    kinds += ["card"] if 12 <= digits <= 19 else []
    return kinds + (["phone"] if 7 <= digits <= 15 else [])


def candidates(text: str, base: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Identifier-like spans that overlap no base span, once for each likely kind."""
    spans = [m.span() for m in _NUMBER.finditer(text)]
    at = text.find("@")
    while at >= 0:
        s, e = at, at + 1
        while s and not text[s - 1].isspace() and text[s - 1] != "@":
            s -= 1
        while e < len(text) and not text[e].isspace() and text[e] != "@":
            e += 1
        if s < at and e > at + 1:
            spans.append((s, e))
        at = text.find("@", at + 1)
    low = "at]" in text or "at)" in text or "AT]" in text or "AT)" in text
    spans += [m.span() for m in _SPELT.finditer(text)] if low else []
    taken = sorted((s, e) for _, s, e in base)
    found, k, last = [], 0, -1
    for s, e in sorted(set(spans)):
        while k < len(taken) and taken[k][1] <= s:
            k += 1
        if (k < len(taken) and taken[k][0] < e) or s < last:
            continue
        kinds = likely(text[s:e])
        last = e if kinds else last
        found += [(kind, s, e) for kind in kinds]
    return found


def word_of(token: str) -> str:
    return token.lower().strip(_STRIP)


class Words:
    """The words of a text by place: tokens as ``word_of`` gives them, without empty ones."""

    def __init__(self, text: str):
        self.text = text
        self.tokens = [m.span() for m in _TOKEN.finditer(text)]
        self.starts = [s for s, _ in self.tokens]

    def around(self, start: int, end: int) -> tuple[str | None, str | None, str | None]:
        """The last word before a span, the one before that, and the first word after it.
        Of tokens that the span cuts, what stands outside of it counts."""
        before: list[str] = []
        k = bisect_left(self.starts, start) - 1
        while k >= 0 and len(before) < 2:
            s, e = self.tokens[k]
            if word := word_of(self.text[s : min(e, start)]):
                before.append(word)
            k -= 1
        after, k = None, max(0, bisect_right(self.starts, end) - 1)
        while k < len(self.tokens) and not after:
            s, e = self.tokens[k]
            after = word_of(self.text[max(s, end) : e]) or None
            k += 1
        before += [None, None]
        return before[0], before[1], after


SPANS = "array<struct<kind:string,start:long,end:long>>"
_SCAN = f"row long, key long, doc_id long, base {SPANS}, seen array<struct<kind:string,start:long,end:long,value:string,word:string,before:string,after:string,seed:boolean>>"


def scan(docs: DataFrame) -> DataFrame:
    """Each row's base spans, and every seed and candidate with the words around it.
    ``row`` tells rows apart once the result is staged; ``key`` is a hash of id and text."""

    bound_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 33
        span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])
        seen_type = pa.struct([*span, *(pa.field(name, pa.string()) for name in ("value", "word", "before", "after")), pa.field("seed", pa.bool_())])
        for batch in batches:
            rows, bases, seens = [], [], []
            for text in batch.column(1).to_pylist():
                text = text or ""
                base = base_spans(text)
                seen, words = [], None
                for seed, spans in ((True, base), (False, candidates(text, base))):
                    for kind, s, e in spans:
                        words = words or Words(text)
                        word, before, after = words.around(s, e)
                        seen.append({"kind": kind, "start": s, "end": e, "value": text[s:e].lower(), "word": word, "before": before, "after": after, "seed": seed})
                row += 1
                rows.append(row)
                bases.append([{"kind": k, "start": s, "end": e} for k, s, e in base])
                seens.append(seen)
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), batch.column(2), batch.column(0), pa.array(bases, pa.list_(span)), pa.array(seens, pa.list_(seen_type))], ["row", "key", "doc_id", "base", "seen"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64(F.col("doc_id").cast("long"), "text")).mapInArrow(lean(run), _SCAN)


SIDES = ("left", "two", "right", "both")  # which words: (word,), (before, word), (after,), (word, after)


def edges(scanned: DataFrame) -> DataFrame:
    """(kind, side, one, two, value, seed, n): each pair of a pattern and an instance once,
    with the number of its places; copies of a text weigh no more than one in scores."""
    each = scanned.select(F.explode("seen").alias("s")).select("s.*")
    none = F.lit(None).cast("string")
    pattern = lambda side, one, two=none: F.struct(F.lit(side).alias("side"), one.alias("one"), two.alias("two"))
    word, before, after = F.col("word"), F.col("before"), F.col("after")
    made = F.array(
        F.when(word.isNotNull(), pattern("left", word)),
        F.when(before.isNotNull(), pattern("two", before, word)),
        F.when(after.isNotNull(), pattern("right", after)),
        F.when(word.isNotNull() & after.isNotNull(), pattern("both", word, after)),
    )
    flat = each.select("kind", "value", "seed", F.explode(F.array_compact(made)).alias("p"))
    return flat.groupBy("kind", "p.side", "p.one", "p.two", "value").agg(F.max("seed").alias("seed"), F.count("*").alias("n"))


def place_counts(docs: DataFrame, patterns: DataFrame) -> DataFrame:
    """(side, one, two, n): how often the words of each of ``patterns`` (side, one, two) stand
    as the pattern has them, over all texts: a word; two words that follow each other; two
    words with up to GAP tokens between them."""
    wanted = patterns.select("side", "one", "two").distinct()
    listed = {tuple(r) for r in wanted.collect()} if wanted.count() <= LISTED else None
    if listed is not None:
        shared = docs.sparkSession.sparkContext.broadcast(({p[1] for p in listed}, listed))  # LISTED patterns at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        firsts, known = shared.value if listed is not None else (None, None)
        of = lru_cache(1 << 16)(word_of)

        def rows():
            found = pa.record_batch({name: pa.array([p[k] for p in counts], pa.string()) for k, name in enumerate(("side", "one", "two"))} | {"n": pa.array(counts.values(), pa.int64())})
            counts.clear()
            return found

        for batch in batches:
            for text in batch.column(0).to_pylist():
                words = [w for w in map(of, (text or "").split()) if w]
                places = range(len(words)) if firsts is None else [k for k, w in enumerate(words) if w in firsts]
                for k in places:
                    one = words[k]
                    made = [("left", one, None), ("right", one, None)]
                    if k + 1 < len(words):
                        made.append(("two", one, words[k + 1]))
                    made += [("both", one, w) for w in set(words[k + 2 : k + 2 + GAP])]
                    counts.update(p for p in made if known is None or p in known)
                if len(counts) > COUNTED:
                    yield rows()
        yield rows()

    counted = docs.select("text").mapInArrow(lean(run), "side string, one string, two string, n long").groupBy("side", "one", "two").agg(F.sum("n").alias("n"))
    same = counted["side"].eqNullSafe(wanted["side"]) & counted["one"].eqNullSafe(wanted["one"]) & counted["two"].eqNullSafe(wanted["two"])
    return counted.join(wanted, same, "left_semi")


def accepted(scanned: DataFrame, docs: DataFrame) -> DataFrame:
    """(kind, value) of the candidates that the bootstrap accepts."""
    each = stage(edges(scanned).withColumn("pattern", F.xxhash64("kind", "side", "one", "two")), "pii-edges")
    # others can never find anything: they have no candidate, or too few instances to rest on
    able = each.groupBy("pattern", "kind", "side", "one", "two").agg(F.sum(F.col("seed").cast("int")).alias("seeds"), F.sum((~F.col("seed")).cast("int")).alias("open"), F.sum("n").alias("places"))
    able = stage(able.where((F.col("seeds") + F.col("open") >= SUPPORT) & (F.col("open") > 0)), "pii-patterns")
    nothing = each.select("kind", "value").where("false")
    if able.where(F.col("seeds") >= SUPPORT).isEmpty():
        return nothing
    counts = place_counts(docs, able).withColumnsRenamed({"side": "s", "one": "o", "two": "t", "n": "all"})
    specific = able.join(counts, able["side"].eqNullSafe(counts["s"]) & able["one"].eqNullSafe(counts["o"]) & able["two"].eqNullSafe(counts["t"]))
    specific = specific.where(F.col("places") >= SPECIFIC * F.col("all")).select("pattern")
    graph = stage(each.join(specific, "pattern", "left_semi").select("pattern", F.xxhash64("kind", "value").alias("instance"), "kind", "value", "seed"), "pii-graph")
    known = stage(graph.where("seed").select("instance").distinct(), "pii-known")
    for _ in range(MOST_ROUNDS):
        fresh = stage(score(graph, known).join(known, "instance", "left_anti"), "pii-fresh")
        if fresh.isEmpty():
            break
        old, known = known, stage(known.union(fresh), "pii-known")
        drop_staged(old)
        drop_staged(fresh)
    found = graph.where("NOT seed").join(known, "instance", "left_semi").select("kind", "value").distinct()
    return stage(found, "pii-accepted")


def score(graph: DataFrame, known: DataFrame) -> DataFrame:
    """(instance) of those in ``graph`` (pattern, instance) that its sure patterns vouch for,
    known ones included. A pattern that rests on enough known instances is as sure as its
    instances on average: a known one counts 1, another one what its other patterns give."""
    marked = graph.select("pattern", "instance").join(known.withColumn("known", F.lit(True)), "instance", "left").withColumn("known", F.coalesce("known", F.lit(False)))
    marked = stage(marked, "pii-marked")
    sure = F.when(F.col("known"), 1.0).otherwise(0.0)
    now = marked.withColumn("sure", sure)
    for _ in range(SCORINGS):
        patterns = now.groupBy("pattern").agg(F.avg("sure").alias("p"), F.sum(F.col("known").cast("int")).alias("support")).where(F.col("support") >= SUPPORT)
        doubt = F.log1p(-F.least(F.coalesce(F.col("p"), F.lit(0.0)), F.lit(0.999)))
        linked = marked.join(patterns.select("pattern", "p"), "pattern", "left").withColumn("doubt", doubt)
        vouched = F.col("p") >= SURE
        total = linked.groupBy("instance").agg(F.sum("doubt").alias("total"), F.sum(F.when(vouched, F.col("doubt")).otherwise(0.0)).alias("vouched"))
        now = linked.join(total, "instance").withColumn("sure", F.when(F.col("known"), 1.0).otherwise(1 - F.exp(F.col("total") - F.col("doubt"))))
    out = now.where(1 - F.exp("vouched") >= ACCEPTED).select("instance").distinct()
    return out


def extract(docs: DataFrame) -> DataFrame:
    """Personal data in each row of ``docs`` (doc_id, text; other columns are ignored):
    (row, key, doc_id, base, found): arrays of (kind, start, end), base ones sorted by kind
    as in KINDS, then start; found ones are what the bootstrap adds.

    Null and empty texts have none. Rows of equal or null doc_id are rows of their own.
    Of overlapping candidates the first, then longest counts. An empty table gives an
    empty result."""
    scanned = stage(scan(docs), "pii-scan")
    values = accepted(scanned, docs)
    if values.isEmpty():
        return scanned.select("row", "key", "doc_id", "base", F.array().cast(SPANS).alias("found"))
    open_ = scanned.select("row", F.explode(F.filter("seen", lambda s: ~s["seed"])).alias("s")).select("row", "s.*")
    hit = open_.join(values, ["kind", "value"], "left_semi")
    found = hit.groupBy("row").agg(F.array_sort(F.collect_set(F.struct("kind", "start", "end"))).alias("found"))
    return scanned.select("row", "key", "doc_id", "base").join(found, "row", "left").select("row", "key", "doc_id", "base", F.coalesce("found", F.array().cast(SPANS)).alias("found"))


def joined(spans: Column) -> Column:
    """kind:start:end by kind as in KINDS, then start, comma-joined."""
    ranked = F.array_sort(F.transform(spans, lambda s: F.struct(F.array_position(F.array(*map(F.lit, KINDS)), s["kind"]).alias("k"), s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    return F.array_join(F.transform(ranked, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with personal data in texts replaced by marks such as <EMAIL>, n_chars
    renewed, other columns, whatever their names, unchanged. Overlapping spans become one,
    named by the first."""
    names = docs.columns
    key, mark = free_name(docs, "key"), free_name(docs, "found")
    # rows are found again by what they hold: equal rows hold equal spans
    held = stage(extract(docs).where(F.size("found") > 0).groupBy("key").agg(F.first("found").alias(mark)), "pii-found")
    if held.isEmpty():
        marked = docs.withColumn(mark, F.array().cast(SPANS))
    else:
        marked = docs.withColumn(key, F.xxhash64(F.col("doc_id").cast("long"), "text")).join(held.withColumnRenamed("key", key), key, "left").withColumn(mark, F.coalesce(mark, F.array().cast(SPANS)))

    @F.arrow_udf("string")
    def clean(texts: pa.Array, founds: pa.Array) -> pa.Array:
        out = []
        for text, found in zip(texts.to_pylist(), founds.to_pylist()):
            spans = [] if text is None else sorted([(s, -e, k) for k, s, e in base_spans(text)] + [(f["start"], -f["end"], f["kind"]) for f in found])
            parts, at = [], 0
            for s, minus, kind in spans:
                if s >= at:
                    parts += [text[at:s], f"<{kind.upper()}>"]
                at = max(at, -minus)
            out.append(text if text is None or not spans else "".join(parts) + text[at:])
        return pa.array(out, pa.string())

    cleaned = marked.withColumn("text", clean.asNondeterministic()("text", mark))  # once, whatever follows
    if "n_chars" in names:
        cleaned = cleaned.withColumn("n_chars", F.length("text").cast("long"))
    return cleaned.select(*names)


def op5_pii(spark, sf_dir: str) -> DataFrame:
    found = extract(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    counts = [F.size(F.filter(F.col("base.kind"), lambda kind: kind == kind_)).cast("long").alias(f"n_{kind_}") for kind_ in KINDS]
    return found.select("doc_id", *counts, F.sha2(joined(F.col("base")).cast("binary"), 256).alias("base_sha256"), joined(F.concat("base", "found")).alias("spans"))
