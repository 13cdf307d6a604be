import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tessera.llm import mixing, pii


def brute(t):
    good = lambda d: sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10 == 0
    digits = lambda s: re.sub(r"[^0-9]", "", s)
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [("card", *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 13 <= len(digits(m[0])) <= 19 and good(digits(m[0]))]
    return out + [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(digits(m[0])) <= 15]


def test_base_spans_are_the_patterns():
    random.seed(3)
    for _ in range(30_000):
        t = "".join(random.choice("ab@@.+-_%0123456789  ()12..é") for _ in range(random.randint(0, 60)))
        assert pii.base_spans(t) == brute(t), t
    assert pii.base_spans("a" * 300_000 + "@") == [] and pii.base_spans("1" * 200_000) == []


def test_query_columns(spark, docs, none):
    got = {r["doc_id"]: r for r in pii.extract(docs).select("doc_id", pii.joined(F.concat("base", "found")).alias("spans")).collect()}
    for r in docs.collect():
        assert got[r["doc_id"]]["spans"] == ",".join(f"{k}:{s}:{e}" for k, s, e in brute(r["text"] or ""))
    assert pii.extract(none).count() == 0 and pii.redact(none).count() == 0


def contexts(spark):
    rows = [(k, f"some words here, dial +1 456 555 {1000 + k} and more {k % 7} things") for k in range(12)]
    rows += [(100, "please dial 456 555 7777 today"), (101, "order of 456 555 8888 screws"), (102, "we saw 12345678 of them"), (103, None)]
    rows += [(200 + k, "of the of the we saw of order words") for k in range(30)]
    return spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, n_chars long, base string")


def test_patterns_find_what_seeds_show(spark):
    df = contexts(spark)
    found = {r["doc_id"]: [(f["kind"], f["start"], f["end"]) for f in r["found"]] for r in pii.extract(df).collect()}
    assert found[100] == [("phone", 12, 24)] and not any(v for k, v in found.items() if k != 100)


def test_redaction(spark):
    df = contexts(spark)
    rows = {r["doc_id"]: r for r in pii.redact(df).collect()}
    assert rows[100]["text"] == "please dial <PHONE> today" and rows[101]["text"] == "order of 456 555 8888 screws" and rows[103]["text"] is None
    assert rows[3]["text"] == "some words here, dial <PHONE> and more 3 things" and rows[3]["n_chars"] == len(rows[3]["text"])
    assert pii.redact(df).columns == df.columns


def test_plans():
    sizes = [1000, 100, 10]
    p = mixing.plan(sizes, max_repeats=3.0)
    assert min(p.epochs) == pytest.approx(1) and max(p.epochs) == pytest.approx(3, rel=1e-6) and 0 < p.exponent < 1
    p = mixing.plan(sizes, budget=500, target_entropy=0.9)
    assert mixing.entropy(p.weights) == pytest.approx(0.9, abs=1e-9) and sum(w * 500 for w in p.weights) == pytest.approx(500)
    assert mixing.plan(sizes, max_repeats=1000.0).exponent == 0 and mixing.plan([], max_repeats=2.0).weights == []
    assert mixing.plan([5], max_repeats=2.0).epochs == [1.0]
    with pytest.raises(ValueError):
        mixing.plan(sizes)


def test_mix(spark, docs, none):
    rows = [(k, "abcd" * (1 + k % 5), f"s{min(k % 10, 3)}" if k % 11 else None, "z") for k in range(600)] + [(600, None, "s0", "z"), (601, "", "empty", "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, slot string")
    size = {r[0]: len(r[1] or "") // 4 for r in rows}
    source = {r[0]: r[2] for r in rows}
    got = mixing.mix(df, max_repeats=2.0).select("doc_id", "slot", "_mix.*").toDF("doc_id", "own", "tokens", "epoch", "block", "slot", "draw").collect()
    uses = Counter(r["doc_id"] for r in got)
    assert set(uses) == set(size) and max(uses.values()) <= 2 and {r["own"] for r in got} == {"z"}
    totals, out = Counter(), Counter()
    for k, n in size.items():
        totals[source[k]] += n
        out[source[k]] += n * uses[k]
    names = sorted(totals, key=str)
    p = mixing.plan([totals[s] for s in names], max_repeats=2.0)
    for s, epochs in zip(names, p.epochs):
        assert epochs * totals[s] - 5 <= out[s] <= epochs * totals[s] + 1e-6 or not totals[s]
    budget = mixing.mix(df, budget=300.0, max_repeats=None, target_entropy=1.2).select("doc_id", "_mix.*").collect()
    assert 270 <= sum(r["tokens"] for r in budget) <= 300
    assert all(r["epoch"] == 0 for r in budget if uses[r["doc_id"]] == 0) and 0 <= min(r["slot"] for r in got) and max(r["slot"] for r in got) < 1024
    again = mixing.mix(df, max_repeats=2.0).select("doc_id", "_mix.*").collect()
    assert sorted((r["doc_id"], r["epoch"], r["slot"]) for r in again) == sorted((r["doc_id"], r["epoch"], r["slot"]) for r in got)
    clash = docs.withColumns({"_id": F.lit("i"), "_source": F.lit("s"), "_row": F.lit(0), "_mix": F.lit(1), "_block": F.lit(2)})
    assert mixing.mix(clash).columns == [*clash.columns, "__mix"] and {r["_id"] for r in mixing.mix(clash).collect()} == {"i"}
    assert mixing.mix(none).count() == 0 and mixing.mix(docs).drop("_mix").columns == docs.columns
    assert math.isclose(sum(p.weights), 1)


def test_limits_that_cannot_be_met_are_refused():
    with pytest.raises(ValueError):
        mixing.plan([1000, 100], budget=5000, max_repeats=2.0)
    assert max(mixing.plan([1000, 100], budget=2200, max_repeats=2.0).epochs) <= 2 * (1 + 1e-9)


def test_blocks_are_permuted_one_to_one(spark):
    for bits in (0, 1, 2, 3, 7, 10):
        df = spark.range(1 << bits).select("id", F.lit(bits).alias("bits"))
        orders = [tuple(r[0] for r in df.select(mixing.permuted(F.col("id"), F.col("bits"), F.lit(key).cast("long"))).collect()) for key in (1, 2)]
        assert all(sorted(o) == list(range(1 << bits)) for o in orders) and (bits < 3 or orders[0] != orders[1])
    top = spark.createDataFrame([((1 << mixing.MOST_BITS) - 1, mixing.MOST_BITS)], "id long, bits int")
    assert 0 <= top.select(mixing.permuted(F.col("id"), F.col("bits"), F.lit(5).cast("long"))).first()[0] < 1 << mixing.MOST_BITS


def test_mix_against_draws_one_by_one(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK_ROWS", 20)
    rng = random.Random(6)
    rows = [(k, "x" * rng.randint(0, 60), rng.choice(["a", "a", "a", "b", None])) for k in range(500)] + [(3, "yy", "a"), (None, "zzzz", "b")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for options in ({"max_repeats": 2.5}, {"budget": 900.0, "max_repeats": None, "target_entropy": 0.8}):
        want = Counter()
        names = sorted({r[2] for r in rows}, key=lambda s: "n" if s is None else "s" + s)
        of = {s: [(r[0], -(-len(r[1]) // 4)) for r in rows if r[2] == s] for s in names}
        p = mixing.plan([sum(n for _, n in of[s]) for s in names], **options)
        for s, epochs in zip(names, p.epochs):
            total, full = sum(n for _, n in of[s]), math.floor(epochs + 1e-9)
            bits = (len(of[s]) // 20).bit_length()
            ids = spark.createDataFrame([(i, n, bits, "n" if s is None else "s" + s) for i, n in of[s]], "_id long, n long, _bits int, _source string").withColumn("_block", mixing._block(F.col("_bits"), 7))
            want.update((i, e) for i, _ in of[s] for e in range(full))
            left = int((epochs - full) * total)
            groups = {}
            for r in ids.select("_id", "n", mixing._rank(F.lit(full), 7).alias("rank"), mixing._draw(F.lit(full), 7).alias("draw")).collect():
                groups.setdefault((r["rank"], r["draw"]), []).append((r["_id"], r["n"]))
            for place in sorted(groups):  # documents of one id are drawn together
                left -= sum(n for _, n in groups[place])
                if left < 0 or epochs - full <= 0:
                    break
                want.update((i, full) for i, _ in groups[place])
        got = mixing.mix(df, **options).select("doc_id", "_mix.epoch").collect()
        assert Counter(map(tuple, got)) == want


def test_two_words_count_by_their_own_places(spark):
    rows = [(k, f"you can reach me at +1 456 555 {1000 + k} or not {k % 7}") for k in range(12)]
    rows += [(100, "please reach me at 456 555 7777 today"), (101, "we are at 456 555 8888 now"), (102, "sat (me, at) 12345678 once")]
    rows += [(200 + k, "he looked at it at noon at home at last") for k in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r["doc_id"]: [(f["kind"], f["start"], f["end"]) for f in r["found"]] for r in pii.extract(df).collect()}
    assert found[100] == [("phone", 19, 31)] and found[101] == []


def plain_places(texts, pattern):
    """How often the words of a pattern stand as it has them."""
    side, one, two = pattern
    n = 0
    for text in texts:
        words = [w for w in map(pii.word_of, (text or "").split()) if w]
        for k, w in enumerate(words):
            if w == one:
                n += side in ("left", "right") or (side == "two" and words[k + 1 : k + 2] == [two]) or (side == "both" and two in words[k + 2 : k + 5])
    return n


def plain_bootstrap(texts):
    """Accepted (kind, value), by loops over one graph."""
    places, seeds = Counter(), set()
    for text in texts:
        text = text or ""
        base = pii.base_spans(text)
        for seed, spans in ((True, base), (False, pii.candidates(text, base))):
            for kind, s, e in spans:
                words = lambda part: [w for w in map(pii.word_of, part.split()) if w]
                left, right = words(text[:s]), words(text[e:])
                value = (kind, text[s:e].lower())
                seeds |= {value} if seed else set()
                if left:
                    places[("left", left[-1], None), value] += 1
                if len(left) > 1:
                    places[("two", left[-2], left[-1]), value] += 1
                if right:
                    places[("right", right[0], None), value] += 1
                if left and right:
                    places[("both", left[-1], right[0]), value] += 1
    of = {}
    for p, v in places:
        of.setdefault((v[0], p), set()).add(v)
    keep = {}
    for (kind, p), values in of.items():
        if len(values) >= 3 and values - seeds:
            all_ = plain_places(texts, p)
            if sum(places[p, v] for v in values) >= 0.3 * all_:
                keep[kind, p] = values
    known = {v for values in keep.values() for v in values} & seeds
    while True:
        sure = {(p, v): float(v in known) for p, values in keep.items() for v in values}
        for _ in range(3):
            score = {p: sum(sure[p, v] for v in values) / len(values) for p, values in keep.items() if len(values & known) >= 3}
            doubt = {(p, v): math.log1p(-min(score.get(p, 0.0), 0.999)) for p, v in sure}
            total, vouched = Counter(), Counter()
            for (p, v), d in doubt.items():
                total[v] += d
                vouched[v] += d if score.get(p, 0) >= 0.5 else 0
            sure = {(p, v): 1.0 if v in known else 1 - math.exp(total[v] - doubt[p, v]) for p, v in sure}
        fresh = {v for v in vouched if 1 - math.exp(vouched[v]) >= 0.5} - known
        if not fresh:
            return {v for values in keep.values() for v in values if v in known and v not in seeds}
        known |= fresh


def planted(seed):
    """Texts with seeds in contexts, unseen identifiers in the same and in further contexts,
    and numbers that are none; with the values that are identifiers."""
    rng = random.Random(seed)
    filler = [f"word{k}" for k in range(60)]
    say = lambda n: " ".join(rng.choice(filler) for _ in range(n))
    number = lambda: f"{rng.randint(200, 999)} {rng.randint(200, 999)} {rng.randint(1000, 9999)}"
    texts, true = [], set()
    for k in range(30):
        texts.append(f"{say(5)} dial +1 {number()} {say(4)}")
        texts.append(f"{say(3)} ring me under +1 {number()} anytime {say(4)}")
        texts.append(f"{say(4)} mail to u{k}@mail.example.com please {say(2)}")
    for _ in range(12):  # the context of the seeds, and a word after that seeds never have
        n = number()
        true.add(("phone", n))
        texts.append(f"{say(3)} dial {n} extension {say(3)}")
    for _ in range(8):  # only that word
        n = number()
        true.add(("phone", n))
        texts.append(f"{say(2)} {n} extension {say(3)}")
    for k in range(6):
        true.add(("email", f"x{k}(at)mail(dot)org"))
        texts.append(f"mail to x{k}(at)mail(dot)org please {say(3)}")
    for _ in range(40):
        texts.append(f"{say(3)} {number()} {say(3)} order {number()} pieces {say(2)}")
    return texts, true


def test_bootstrap_against_brute_force_and_planted_cases(spark, monkeypatch):
    for seed in (1, 2):
        texts, true = planted(seed)
        df = spark.createDataFrame(list(enumerate(texts)) + [(None, None), (7, "")], "doc_id long, text string")
        scanned = pii.stage(pii.scan(df), "test-scan")
        want = plain_bootstrap(texts)
        for listed in (200_000, 0):
            monkeypatch.setattr(pii, "LISTED", listed)
            assert {tuple(r) for r in pii.accepted(scanned, df).collect()} == want
        assert len(want & true) >= 0.95 * len(true) and len(want - true) <= 0.05 * len(want)


def test_places_are_counted_as_patterns_have_them(spark):
    texts = ["he looked at it at noon at home at last", "(me, at) 1 x y z", "me at", None, "at a b c d e at"]
    asked = [("left", "at", None), ("two", "me", "at"), ("right", "noon", None), ("both", "at", "at"), ("both", "at", "z"), ("both", "at", "e"), ("two", "x", "q")]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    got = {(r["side"], r["one"], r["two"]): r["n"] for r in pii.place_counts(df, spark.createDataFrame(asked, "side string, one string, two string")).collect()}
    assert got == {p: n for p in asked if (n := plain_places(texts, p))}


def test_words_around_spans_have_no_limit():
    text = "call " + "* " * 500 + "x" * 400 + " | 123 456 789 " + "| " * 300 + "now"
    s = text.index("123")
    assert pii.Words(text).around(s, s + 11) == ("x" * 400, "call", "now")
    assert pii.Words("tel:123end").around(4, 7) == ("tel", None, "end")
    assert pii.Words("123").around(0, 3) == (None, None, None)
    long = "a" * 300 + "@" + "b" * 300
    assert pii.candidates(long, []) == [("email", 0, 601)]
    spelt = "c" * 200 + "(at)" + "d" * 200 + "(dot)org"
    assert ("email", 0, len(spelt)) in pii.candidates(spelt, [])
