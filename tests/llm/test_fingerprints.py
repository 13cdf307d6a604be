import hashlib
import random
from collections import Counter

from tessera.llm import merkle
from tessera.llm.merkle import Tree, edits, fingerprint, likeness


def by_id(df):
    return sorted(df.collect(), key=lambda r: (r["doc_id"] is not None, r["doc_id"]))


def test_against_a_plain_loop(spark, docs, none):
    rows = sorted(docs.select("doc_id", "text").collect(), key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    texts = [r[1] or "" for r in rows]
    got = by_id(merkle.fingerprints(docs))
    assert [r["doc_id"] for r in got] == [r[0] for r in rows]
    for k, r in enumerate(got):
        t, n = texts[k], len(texts[k])
        edited = t[: n - n // 2] + texts[(k + 1) % len(texts)][: n // 2]
        assert r["n_chars"] == n and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert r["fingerprint"] == fingerprint(t) and r["edited_fingerprint"] == fingerprint(edited)
        assert r["near_edited"] == likeness(fingerprint(t), fingerprint(edited)) and 0 <= r["near_next"] <= 1
    assert merkle.fingerprints(none).count() == 0
    lone = merkle.fingerprints(docs.where("doc_id = 3")).collect()
    assert len(lone) == 1 and lone[0]["near_next"] == 1


def test_likeness_and_edits():
    random.seed(1)
    lines = [" ".join("".join(random.choice("abcdefg") for _ in range(6)) for _ in range(12)) + "." for _ in range(40)]
    text = "\n".join(lines)
    assert likeness(fingerprint(text), fingerprint(text)) == 1
    changed = lines[:]
    changed[17] = "something else altogether."
    other = "\n".join(changed)
    assert 0.9 < likeness(fingerprint(text), fingerprint(other)) < 1
    (start, end), = edits(Tree(text), Tree(other))
    at = text.index(lines[17])
    assert at <= start < end <= at + len(lines[17]) and edits(Tree(text), Tree(text)) == []
    assert likeness(fingerprint(text), fingerprint("nothing alike.")) == 0
    assert fingerprint(None) == fingerprint("") != fingerprint(" ")
    assert fingerprint("a\nb") != fingerprint("a b") and fingerprint("a\n") != fingerprint("a")


def test_likeness_does_not_depend_on_length():
    random.seed(2)
    words = ["".join(random.choice("abcdefghij") for _ in range(6)) for _ in range(400)]
    for n in (60, 72, 74, 100, 140, 400):  # 420 to 2,800 code points
        text = " ".join(words[:n])
        edited = text[: len(text) - len(text) // 2] + "a short next document"
        assert 0.5 < likeness(fingerprint(text), fingerprint(edited)) < 0.9, n
        assert sum(e - s for s, e in edits(Tree(text), Tree(edited))) < 0.65 * len(text), n
    line = "".join(random.choice("日本語文書木林森山川水火土金月星空海") for _ in range(900))
    assert "".join(merkle._pieces(line)) == line and likeness(fingerprint(line), fingerprint(line[:430])) > 0.5


def plain_pieces(line):
    """Pieces one by one: up to a word's last character that ends one, or a wide one, and the white space after it."""
    ends = lambda k: (line[k] in "adhlt.T0" and (k + 1 == len(line) or line[k + 1].isspace())) or ("\u3000" <= line[k] < "\ud800" and ord(line[k]) * 0x9E37 >> 3 & 3 == 0)
    found, at = [], 0
    while at < len(line):
        stop = next((k + 1 for k in range(at, min(at + 96, len(line))) if ends(k)), None)
        if stop is None:
            stop = min(at + 96, len(line))
            stop = next((k + 1 for k in range(stop - 1, at - 1, -1) if line[k].isspace()), stop)
            white = line[stop - 1].isspace()
        else:
            white = False
        while not white and stop < len(line) and line[stop].isspace():
            stop += 1
        found.append(line[at:stop])
        at = stop
    return found


def plain_root(text):
    h = lambda data: hashlib.blake2b(data, digest_size=16).digest()
    sections, now = [], []
    for line in text.split("\n"):
        now.append(h(b"p" + b"".join(h(p.encode()) for p in plain_pieces(line))))
        if not line.strip() or now[-1][0] % 8 == 0:
            sections.append(h(b"s" + b"".join(now)))
            now = []
    sections += [h(b"s" + b"".join(now))] if now else []
    return h(b"d" + b"".join(sections) + hashlib.sha256(text.encode()).digest()).hex()


def test_trees_against_brute_force():
    rng = random.Random(7)
    line = lambda: " ".join(rng.choice(["aa", "bcd", "efgh", "日本", "i" * 40, "", "jk"]) for _ in range(rng.randint(0, 30)))
    lines = [line() for _ in range(12)]
    texts = ["\n".join(rng.choice(lines) for _ in range(rng.randint(0, 25))) for _ in range(40)]
    for t in texts:
        assert fingerprint(t)[:32] == plain_root(t) and str(merkle.parse(fingerprint(t))) .count("/") == fingerprint(t).count("/")
    for a in texts:
        for b in texts:
            own, other = ([p for x in t.split("\n") for p in plain_pieces(x)] for t in (a, b))
            common = sum((Counter(own) & Counter(other)).values())
            want = 1.0 if a == b else min(2 * common / (len(own) + len(other)), 1 - 1e-9) if own or other else 0.0
            assert merkle.compare(Tree(a), Tree(b))[0] == likeness(fingerprint(a), fingerprint(b)) == want
            lacking = "".join(a[s:e] for s, e in edits(Tree(a), Tree(b))).replace("\n", "")
            assert a == b or sorted(lacking) == sorted("".join((Counter(own) - Counter(other)).elements()))
