import random

import numpy as np
import xxhash
from pyspark.sql import functions as F

from tessera.llm import simhash
from tessera.llm.simhash import golay_index, keys_of, link_bucket


def plain(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def components(ids, fps, most=2):
    label = list(range(len(fps)))
    for _ in fps:
        for i, a in enumerate(fps):
            for j, b in enumerate(fps):
                if bin(a ^ b).count("1") <= most:
                    label[i] = label[j] = min(label[i], label[j])
    low = {}
    for i, d in zip(label, ids):
        low[i] = d if low.get(i) is None else min(low[i], d if d is not None else low[i])
    return [low[i] for i in label]


def test_against_brute_force(spark, docs, none, monkeypatch):
    rows = docs.select("doc_id", "text").collect()
    fps = [plain(r[1]) for r in rows]
    want = sorted(zip([r[0] or -1 for r in rows], fps, components([r[0] for r in rows], fps)), key=str)
    for share in (1 / 1000, 0.2, 1.0):  # all, some and no fingerprints are of many rows
        monkeypatch.setattr(simhash, "HOT", share)
        got = simhash.near_duplicates(docs).select("doc_id", simhash.fingerprint_hex().alias("f"), "component_id").collect()
        assert sorted(((r[0] or -1, int(r[1], 16), r[2]) for r in got), key=str) == want
    assert simhash.near_duplicates(none).count() == 0


def test_rows_of_one_component_need_not_meet(spark, monkeypatch):
    """One fingerprint, f, and all that differ from it in a bit: what their component is goes to
    tasks by fingerprint, and no task is dealt all of them by component."""
    dealt, stage = [], simhash.stage

    def seen(df, name):
        if name == "simhash-resolved":
            plan = df._jdf.queryExecution().optimizedPlan().toString()
            dealt.append([line for line in plan.splitlines() if "Join Inner, (root" in line])
        return stage(df, name)

    monkeypatch.setattr(simhash, "stage", seen)
    near = [1 << b for b in range(63)] + [0]
    monkeypatch.setattr(simhash, "fingerprints", lambda docs, width: docs.select("doc_id", F.col("text").cast("long").alias("fp")))
    monkeypatch.setattr(simhash, "HOT", 0.5)
    far = 0b1111 << 40
    docs = spark.createDataFrame([*enumerate(map(str, near)), (64, str(far)), (65, str(far | 1))], "doc_id long, text string").repartition(4)
    got = {r[0]: r[2] for r in simhash.near_duplicates(docs).collect()}
    assert got == {k: 0 for k in range(64)} | {64: 64, 65: 64}
    assert any("rightHint=(strategy=broadcast)" in line for line in dealt[0])


def test_spark_hash_agrees(spark):
    assert spark.sql("select xxhash64('the cat sat')").first()[0] % 2**64 == xxhash.xxh64_intdigest(b"the cat sat", 42)


def test_links_of_planted_fingerprints(spark):
    random.seed(5)
    fps = [random.getrandbits(64) for _ in range(150)]
    for f in fps[:60]:
        for bits in (1, 2, 3):
            g = f
            for b in random.sample(range(64), bits):
                g ^= 1 << b
            fps.append(g)
    hub = random.getrandbits(64)
    fps += [hub ^ (1 << b) for b in range(64)]
    df = spark.createDataFrame([(int(np.uint64(f).astype(np.int64)),) for f in fps], "fp long")
    edges = simhash.link_fingerprints(df).collect()
    label = {f: f for f in fps}

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for u, v in edges:
        a, b = root(u % 2**64), root(v % 2**64)
        label[max(a, b)] = min(a, b)
    found = [root(f) for f in fps]
    want = components(list(range(len(fps))), fps)
    assert len(set(zip(found, want))) == len(set(found)) == len(set(want))


def test_code_and_keys():
    words = np.random.default_rng(1).integers(0, 1 << 23, 4000)
    index = golay_index(words)
    assert index.min() >= 0 and index.max() < 4096
    flipped = golay_index(words[:, None] ^ (1 << np.arange(23)))
    assert max(len(set(r)) for r in np.concatenate((index[:, None], flipped), axis=1).tolist()) <= 6
    fps = np.random.default_rng(2).integers(0, 1 << 63, 500).astype(np.uint64)
    for bits in (0, 1, 2):
        other = fps.copy()
        rng = np.random.default_rng(bits)
        for k in range(len(fps)):
            for b in rng.choice(64, bits, replace=False):
                other[k] ^= np.uint64(1) << np.uint64(b)
        a, b = keys_of(fps), keys_of(other)
        homes = [set(a[1][(a[0] == k) & a[2]]) for k in range(len(fps))]
        assert all(homes[k] & set(b[1][b[0] == k]) for k in range(len(fps)))


def test_large_buckets_take_the_other_way(monkeypatch):
    rng = np.random.default_rng(3)
    fps = np.unique(rng.integers(0, 1 << 20, 900).astype(np.uint64))
    by_pairs = link_bucket(fps, 2)
    monkeypatch.setattr(simhash, "PAIRWISE", 10)
    by_masks = link_bucket(fps, 2)
    assert len(set(zip(by_pairs, by_masks))) == len(set(by_pairs)) == len(set(by_masks))
