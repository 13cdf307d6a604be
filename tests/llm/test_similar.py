import pathlib
import random

import numpy as np
from pyspark.sql import functions as F

from tessera.llm import common, similar


def shingles(text, width=5):
    words = (text or "").encode().lower().split()
    return {b" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))} if words else set()


def test_sets_hold_every_shingle_once(monkeypatch):
    rng = np.random.default_rng(6)
    texts = ["", " ", "One", "a b c d e", "a b c d e a b c d e", "A  b\tc\nD e \u00c9"] + [" ".join(rng.choice(["x", "yy", "zzz", "\u00e9\u00e9"], n)) for n in (4, 60, 300)] + ["w" * 90 + " end"]
    seen = {}
    for chunk in (1 << 18, 64, 7):
        monkeypatch.setattr(similar, "CHUNK", chunk)
        for text, found in zip(texts, similar.shingle_hashes([t.encode() for t in texts], 5)):
            assert len(found) == len(shingles(text))
            assert seen.setdefault(text, found.tolist()) == found.tolist()
            packed = similar.unpack(similar.pack(found))
            assert (packed == found >> np.uint64(16)).all()
    sets = {t: set(f) for t, f in seen.items()}
    for a in texts:
        for b in texts:
            assert len(sets[a] & sets[b]) == len(shingles(a) & shingles(b))


def test_one_stays(spark, docs, none):
    docs = docs.withColumns({"key": F.lit("own"), "_gone": F.lit(1), "_key": F.lit(2)})
    assert similar.keep_one(none).count() == 0
    kept = similar.keep_one(docs)
    assert kept.columns == docs.columns
    ids = sorted(r[0] for r in kept.select(F.coalesce("doc_id", F.lit(-1))).collect())
    assert ids.count(11) == 1 and 1 not in ids and 0 in ids and ids.count(4) + ids.count(5) == 1


def similar_groups(texts, width=5, least=0.8):
    sets = []
    for t in texts:
        w = t.lower().split()
        sets.append({tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))})
    label = list(range(len(texts)))
    changed = True
    while changed:
        changed = False
        for i, a in enumerate(sets):
            for j, b in enumerate(sets[:i]):
                if label[i] != label[j] and 5 * len(a & b) >= 4 * len(a | b):
                    label[i] = label[j] = min(label[i], label[j])
                    changed = True
    return label


def test_pairs_of_similarity_stay_once(spark, monkeypatch):
    random.seed(8)
    draw = lambda n: [f"w{random.randint(0, 400)}" for _ in range(n)]
    passage = draw(30)
    texts = []
    for _ in range(25):
        words = draw(random.randint(20, 150)) + passage
        texts.append(words)
        for _ in range(3):
            other = words[:]
            for at in random.sample(range(len(other)), random.randint(1, 5)):
                other[at] = "new" + str(random.randint(0, 10**6))
            texts.append(other)
    for _ in range(40):  # a chain of near copies: each is similar to the last, not to the first
        other = texts[-1][:]
        other[random.randrange(len(other))] = "step" + str(random.randint(0, 10**6))
        texts.append(other)
    texts = [" ".join(t) for t in texts]
    want = sorted(set(similar_groups(texts)))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    fps = [int(r[0]) % 2**64 for r in similar.shingle_sets(df.coalesce(1), 5).select("fp").limit(4).collect()]
    assert max(bin(fps[0] ^ f).count("1") for f in fps[1:]) > 2  # Golay keys alone would miss some
    for rounds in (3, 1):
        monkeypatch.setattr(similar, "STARS", rounds)
        assert sorted(r[0] for r in similar.keep_one(df).select("doc_id").collect()) == want


def test_rows_without_an_id_or_of_one_id_are_rows_of_their_own(spark):
    random.seed(9)
    texts = [" ".join(f"w{random.randint(0, 9999)}" for _ in range(30)) for _ in range(8)]
    rows = [(None, t) for t in texts[:4]] + [(None, texts[0]), (None, texts[4]), (1, texts[4]), (2, texts[5]), (2, texts[6]), (2, texts[6]), (3, texts[6]), (3, texts[7])]
    kept = similar.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = [(None, t) for t in texts[:4]] + [(1, texts[4]), (2, texts[5]), (2, texts[6]), (3, texts[7])]
    assert sorted(map(tuple, kept), key=str) == sorted(want, key=str)


def test_components_are_the_same_by_one_task_or_many(spark, monkeypatch):
    rng = random.Random(3)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(5, 5), (None, 3)] + [(400 + k, 401 + k) for k in range(60)]
    df = spark.createDataFrame(pairs, "u long, v long")
    label = {}
    for u, v in pairs:
        if u is not None and u != v:
            label.setdefault(u, u), label.setdefault(v, v)
    for _ in label:
        for u, v in pairs:
            if u in label and v in label:
                label[u] = label[v] = min(label[u], label[v])
    for few in (common.FEW, 0):
        monkeypatch.setattr(common, "FEW", few)
        assert dict(map(tuple, common.connected_components(df).collect())) == label
        assert common.connected_components(df.where("false")).count() == 0


def test_odd_cells_never_hold_more_than_differs():
    rng = np.random.default_rng(11)
    for n, m in ((1, 1), (40, 40), (60, 70), (500, 520), (1025, 1024), (70_000, 80_000)):
        for share in (0.0, 0.5, 0.95):
            pool = np.unique(rng.integers(0, 1 << 48, n + m, np.uint64))
            rng.shuffle(pool)
            both = int(share * min(n, m))
            a, b = pool[:n], np.concatenate((pool[:both], pool[n : n + m - both]))
            x, y = similar.odd_cells(a), similar.odd_cells(b)
            apart = len(np.setxor1d(a, b))
            assert similar.least_apart(x, x) == 0
            assert apart / 8 <= similar.least_apart(x, y) == similar.least_apart(y, x) <= apart


def test_sets_are_not_written_and_the_table_is_dealt_once(spark, monkeypatch):
    random.seed(12)
    draw = lambda n: " ".join(f"w{random.randint(0, 10**6)}" for _ in range(n))
    passages = [draw(40) for _ in range(4)]  # in many texts: the order of shingles has to be mended
    texts = [f"{passages[k % 4]} {draw(120)}" for k in range(1200)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(60)
    written, real = [], similar.stage

    def stage(frame, name):
        out = real(frame, name)
        written.append((name, sum(f.stat().st_size for f in pathlib.Path(out.staged_path).rglob("part-*"))))
        return out

    monkeypatch.setattr(similar, "stage", stage)
    assert similar.keep_one(df).count() == len(texts)
    assert [name for name, _ in written].count("similar-met") == 1
    assert max(n for _, n in written) < 6 * 156 * len(texts) / 2  # 6 bytes for each shingle
