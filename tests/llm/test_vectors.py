import math

import numpy as np

from tessera.llm import rabitq


def rows(seed=1):
    rng = np.random.default_rng(seed)
    out = []
    for k in range(60):
        base = rng.standard_normal(64)
        out.append((len(out), base.tolist(), k % 3))
        for noise in (0, 0.1, 0.3, 0.35):
            out.append((len(out), (base + noise * rng.standard_normal(64) * (k % 2)).tolist(), k % 3))
    n = len(out)
    out += [(n, None, 1), (n + 1, [0.0] * 64, 1), (n + 2, [float("nan")] + [1.0] * 63, 1), (n + 3, [None] + [1.0] * 63, 1), (n + 4, out[0][1], None), (n + 5, [float("inf")] * 64, 1), (n + 6, [1.0, 2.0], 1), (n + 7, [2.0, 4.0], 1), (n + 8, [-0.0, 4.0], 1), (n + 9, [0.0, 4.0], 1), (n + 10, [], 2), (n + 11, [1e200, 2e200], 1), (n + 12, [1e-200, 2e-200], 1)]
    out += [(3, out[0][1], 0), (None, out[0][1], 0)]  # an id twice, and a row without one
    return out


def brute(data, threshold=0.93):
    links = {r[0]: set() for r in data}
    good = [r for r in data if r[2] is not None and r[1] and all(x is not None and math.isfinite(x) for x in r[1]) and any(r[1])]
    for a in good:
        for b in good:
            if a[0] != b[0] and a[2] == b[2] and len(a[1]) == len(b[1]):
                x, y = (np.array(v[1]) / np.abs(v[1]).max() for v in (a, b))
                if (x * y).sum() / (np.sqrt((x * x).sum()) * np.sqrt((y * y).sum())) >= threshold:
                    links[a[0]].add(b[0])
    component = {}
    for r in sorted(links):
        todo = [r]
        while todo:
            x = todo.pop()
            if x not in component:
                component[x] = r
                todo += links[x]
    return {k: (len(v), component[k], component[k] == k) for k, v in links.items()}


def test_against_brute_force(spark):
    data = rows()[:-2]
    df = spark.createDataFrame([(*r, 5, "x") for r in data], "vec_id long, embedding array<double>, label int, n_links long, rep string")
    got = {r[0]: tuple(r[1:]) for r in rabitq.near_vectors(df).collect()}
    want = brute(data)
    assert got == want
    assert rabitq.near_vectors(df.where("false")).count() == 0


def test_repeated_and_absent_ids(spark):
    data = rows()
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>, label int")
    got = rabitq.near_vectors(df).collect()
    assert len(got) == len(data)
    apart = [(k, *r[1:]) for k, r in enumerate(data)]
    want = brute(apart)  # every row for itself
    ids = {k: r[0] for k, r in enumerate(data)}
    groups = {}
    for k, (_, component, _) in want.items():
        groups.setdefault(component, []).append(ids[k])
    low = {c: min((i for i in members if i is not None), default=None) for c, members in groups.items()}
    expected = [(ids[k], n, low[c], ids[k] is not None and ids[k] == low[c]) for k, (n, c, _) in want.items()]
    assert sorted(map(tuple, got), key=str) == sorted(expected, key=str)
    floats = df.select("vec_id", df.embedding.cast("array<float>").alias("embedding"), "label").where("vec_id < 300")
    assert sum(r["n_links"] for r in rabitq.near_vectors(floats).collect()) > 100


def test_tiles_of_large_buckets(spark, monkeypatch):
    monkeypatch.setattr(rabitq, "TILE", 40)
    rng = np.random.default_rng(7)
    base = rng.standard_normal(64)
    data = [(k, (base + 0.15 * rng.standard_normal(64)).tolist(), 0) for k in range(180)]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>, label int")
    want = brute(data)
    got = {r[0]: tuple(r[1:]) for r in rabitq.near_vectors(df).collect()}
    assert sum(v[0] for v in got.values()) >= 0.99 * sum(v[0] for v in want.values())
    assert {k: v[1] for k, v in got.items()} == {k: v[1] for k, v in want.items()}


def test_estimates_are_unbiased_and_bounded():
    rng = np.random.default_rng(1)
    unit = rng.standard_normal((400, 64))
    unit /= np.linalg.norm(unit, axis=1)[:, None]
    errors, widths = [], []
    for seed in range(20):
        rotation, _ = rabitq.Rotations(64, 8, 2, seed).matrices()
        assert np.allclose(rotation @ rotation.T, np.eye(64))
        codes, inner, width = rabitq.encode(unit, rotation)
        guess = rabitq.estimate(codes, inner, unit[:50] @ rotation)
        off = ~np.eye(400, 50, dtype=bool)
        errors.append((guess - unit @ unit[:50].T)[off])
        widths.append(np.broadcast_to(width[:, None], guess.shape)[off])
    errors, widths = np.concatenate(errors), np.concatenate(widths)
    assert abs(errors.mean()) < 0.002 and (abs(errors) <= 5 * widths).mean() > 0.99999
    turned = unit @ rotation
    made = [rabitq.quantize(turned, seed) for seed in range(40)]
    assert abs(np.mean([(numbers * step[:, None] - turned).mean() for numbers, step in made])) < 0.002 and max(abs(numbers).max() for numbers, _ in made) <= 7
    big = rabitq.scaled(np.array([[1e200, 3e200], [1e-200, 0.0], [3.0, 4.0]]))
    assert np.isfinite(big * big).all() and (big * big > 0).sum() == 5 and big[2, 1] / big[2, 0] == 4 / 3


def test_bands_follow_size_and_recall():
    for n in (10, 10_000, 10_000_000):
        bits, bands = rabitq.band_sizes(n, 0.93)
        p = 1 - math.acos(0.93) / math.pi
        assert 1 - (1 - p**bits) ** bands >= rabitq.RECALL and (n / 2**bits <= 64 or bits == 24)
