"""Whitening, SimHash and spelling variants against brute force, and odd rows."""

import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest
import xxhash

from navengine.llm import simhash, spelling, whitening
from navengine.llm.common import table

SF = "/root/testdata/sf0.001"


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    if not words:
        return 0
    k = min(3, len(words))
    h = [xxhash.xxh64_intdigest(" ".join(words[i : i + k]).encode(), 42) for i in range(len(words) - k + 1)]
    return sum(1 << j for j in range(64) if 2 * sum(x >> j & 1 for x in h) > len(h))


def brute_groups(docs, radius=3):
    """[(id, fingerprint, smallest id reachable)] of [(id, text)]."""
    fps = [brute_fingerprint(t) for _, t in docs]
    known = sorted(set(fps))
    near = {a: [b for b in known if (a ^ b).bit_count() <= radius] for a in known}
    label = {}
    for a in known:
        todo, seen = [a], {a}
        while todo and a not in label:
            for b in near[todo.pop()]:
                if b not in seen:
                    seen.add(b)
                    todo.append(b)
        if a not in label:
            low = min((i for (i, _), f in zip(docs, fps, strict=True) if f in seen and i is not None), default=None)
            label |= dict.fromkeys(seen, low)
    return sorted(((i, f"{f:016x}", label[f]) for (i, _), f in zip(docs, fps, strict=True)), key=str)


def found_groups(df, **how):
    return sorted((tuple(r) for r in simhash.near_duplicates(df, **how).select("doc_id", "fingerprint", "component_id").collect()), key=str)


def test_simhash_of_documents(spark):
    df = table(spark, SF, "documents")
    assert found_groups(df) == brute_groups([(r.doc_id, r.text) for r in df.collect()])


def test_simhash_odd_rows(spark):
    long = " ".join(f"w{i % 977} x{i}" for i in range(150_000))
    rows = [(1, None, 5), (2, "", 5), (None, " \t", 5), (4, "One two", 5), (4, "ONE\ntwo", 5), (4, "three", 5), (7, "a b Ä c", 5), (None, "only here", 5), (9, long, 5), (10, long + " end", 5), (3, "one two", 5)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, component_id int")
    assert found_groups(df) == brute_groups([r[:2] for r in rows])
    assert found_groups(df.where("false")) == []


def test_simhash_large_buckets(spark):
    """Thousands of fingerprints near each other, dealt in parts, give the components of all pairs."""
    draw = random.Random(7)
    centres = [draw.getrandbits(64) for _ in range(3)]
    fps = {c ^ sum(1 << b for b in draw.sample(range(64), draw.randrange(5))) for c in centres for _ in range(700)} | {draw.getrandbits(64) for _ in range(500)}
    fps = sorted(fps)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    df = spark.createDataFrame([(f,) for f in signed], "fp bigint")
    x = np.array(fps, np.uint64)
    parent = np.arange(len(x))
    for _ in range(len(x)):
        new = np.array([parent[np.bitwise_count(x ^ f) <= 3].min() for f in x])
        if (new == parent).all():
            break
        parent = new
    for most in (1 << 16, 100):
        ties = [(r.a % (1 << 64), r.b % (1 << 64)) for r in simhash._ties(df, len(fps), 3, most).collect()]
        root = {f: f for f in fps}

        def top(f, root=root):
            while root[f] != f:
                f = root[f]
            return f

        for a, b in ties:
            a, b = sorted((top(a), top(b)))
            root[b] = a
        assert [top(f) for f in fps] == [fps[i] for i in parent]


@pytest.mark.parametrize("radius", [0, 1, 2, 3, 4, 6])
def test_lanes(radius):
    r = np.random.default_rng(radius)
    x = r.integers(0, 1 << 64, 300, np.uint64)
    x[100:] = x[7] ^ np.bitwise_or.reduce(np.uint64(1) << r.integers(0, 64, (200, 5)).astype(np.uint64), axis=1)
    p = simhash.planes(x, 300)
    for shift in (1, 5, 63, 64, 65, 128, 200, 299):
        want = [i for i in range(300 - shift) if int(x[i] ^ x[i + shift]).bit_count() <= radius]
        assert simhash.near_lanes(p, 300 - shift, shift, radius).tolist() == want


@pytest.mark.parametrize("blocks, radius", [(4, 3), (5, 3), (6, 3), (1, 0), (3, 2)])
def test_choices(blocks, radius):
    draw = random.Random(blocks)
    masks = simhash.choices(blocks, radius)
    for _ in range(300):
        a = draw.getrandbits(64)
        b = a ^ sum(1 << i for i in draw.sample(range(64), radius))
        assert any(a & m == b & m for m in masks)


def whitening_rows(df):
    return df.collect() if df is not None else []


def check_whitening(rows, got, k=4):
    """rows: [(id, list of floats)]; got: the operator's rows."""
    good = [(i, [int(np.floor(256 * float(np.float32(c)))) for c in v]) for i, v in rows if v is not None and all(c is not None and np.isfinite(c) for c in v)]
    dims = max(len(v) for _, v in good)
    good = [(i, v + [0] * (dims - len(v))) for i, v in good]
    fit = sorted({tuple(v) for _, v in good})
    n, sums = len(fit), [sum(c) for c in zip(*fit, strict=True)]
    y = np.array([[n * c - s for c, s in zip(v, sums, strict=True)] for v in fit], object)
    exact = (y.T @ y) / 1
    v = np.array([[float(Fraction(int(c), n**3)) for c in r] for r in y.T @ y])
    e, w = np.linalg.eigh(v)
    e, w = e[::-1], w[:, ::-1]
    assert exact.shape == (dims, dims) and len(got) == len(good) * k
    of = {}
    for r in got:
        of.setdefault((r.vec_id, r.component), []).append(r)
    white = {}
    for i, x in good:
        dev = sum((n * c - s) ** 2 for c, s in zip(x, sums, strict=True))
        z = np.array([float(Fraction(n * c - s, n)) for c, s in zip(x, sums, strict=True)]) @ w[:, :k] / np.sqrt(e[:k])
        for c in range(k):
            assert any(r.deviation == dev and r.n == n and abs(abs(r.whitened) - abs(z[c])) < 1e-8 * (1 + abs(z[c])) and abs(r.explained / (e[c] / np.trace(v)) - 1) < 1e-9 and r.identity_error < 1e-6 for r in of[i, c + 1])
        white[tuple(x)] = [of[i, c + 1][0].whitened for c in range(k)] if len(of[i, 1]) == 1 else z
    m = np.array([white[f] for f in fit])
    assert np.abs(m.T @ m / n - np.eye(k)).max() < 1e-6 or any(len(x) > 1 for x in of.values())


def test_whitening_of_embeddings(spark):
    df = table(spark, SF, "embeddings")
    check_whitening([(r.vec_id, r.embedding) for r in df.collect()], whitening.whiten(df).collect())


def test_whitening_odd_rows(spark):
    draw = random.Random(3)
    rows = [(i, [draw.gauss(0, 3) for _ in range(6)], 1) for i in range(40)]
    rows += [(50, None, 1), (51, [1.0, None, 0.0, 0.0, 0.0, 0.0], 1), (52, [float("nan")] * 6, 1), (53, [float("inf")] + [0.0] * 5, 1), (54, [1.0, 2.0], 1), (55, [], 1), (3, [draw.gauss(0, 3) for _ in range(6)], 1), (None, [0.5] * 6, 1)]
    rows += [(60 + i, [9.0, -9.0, 0.0, 0.0, 1.0, -0.001], 1) for i in range(30)]  # copies count once
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, n int")
    check_whitening([r[:2] for r in rows], whitening.whiten(df).collect())
    assert whitening.whiten(df.where("false")).collect() == []
    assert whitening.whiten(df.where("vec_id >= 60")).collect() == []  # no variance at all
    flat = spark.createDataFrame([(i, [float(i), 2.0 * i, 0.0]) for i in range(9)], "vec_id int, embedding array<double>")
    assert {r.component for r in whitening.whiten(flat).collect()} == {1}


def test_exact_scatter_of_large_entries(spark):
    rows = [(i, [float(3**i), -float(5**i), 7.0 * i]) for i in range(1, 9)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").repartition(5)
    check_whitening(rows, whitening.whiten(df, k=2).collect(), k=2)
    huge = spark.createDataFrame([(i, [float(1 << 40) * i, float(i % 2)]) for i in range(9)], "vec_id bigint, embedding array<double>")
    with pytest.raises(Exception, match="(?i)overflow|too large"):
        whitening.whiten(huge).collect()


def test_residues():
    r = np.random.default_rng(1)
    x = r.integers(-(1 << 40), 1 << 40, (9000, 3))
    of = whitening.primes(9000 << 80)
    assert len(set(of)) == len(of) and all(all(p % q for q in range(2, 1449)) for p in of)
    want = x.astype(object).T @ x.astype(object)
    assert (whitening.remainder({p: whitening.product(x, p) for p in of}) == want).all()


def near(a, b):
    """Exactly one insertion, deletion or replacement apart."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_spelling(counts, factor=5):
    forms, out = {}, []
    nears = {w: [v for v in counts if abs(len(v) - len(w)) <= 1 and near(v, w)] for w in counts}
    for w, ns in nears.items():
        best = min(ns, key=lambda v: (-counts[v], v), default=None)
        forms[w] = best if best is not None and 0 < counts[best] >= factor * counts[w] else None
    for w in counts:
        root = w
        while forms[root] is not None:
            root = forms[root]
        out.append((w, forms[w], root, counts[w], len(nears[w]), counts.get(forms[w])))
    return sorted(out)


@pytest.mark.parametrize("letters, most, top_rows", [("ab", 7, 200_000), ("abc", 5, 1), ("abÿ", 6, 3), ("abcdefgh", 4, 2)])
def test_spelling_of_random_words(spark, letters, most, top_rows):
    draw = random.Random(most)
    counts = {"".join(draw.choices(letters, k=draw.randrange(most + 1))): draw.choice([0, 1, 5, 9, 26, 26, 140, 900]) for _ in range(600)}
    df = spark.createDataFrame(list(counts.items()), "word string, n bigint")
    got = spelling.spelling_groups(df).select("word", "form", "root", "n", "n_near", "form_n").collect()
    assert sorted(tuple(r) for r in got) == brute_spelling(counts)
    pairs = {r.word: r.n_near for r in spelling.near_words(df, top_rows).collect()}
    assert pairs == {r[0]: r[4] for r in brute_spelling(counts) if r[4]}


def test_hot_nodes(spark):
    """Nodes above and below the bound for broadcasts give the same pairs."""
    draw = random.Random(11)
    counts = {"".join(draw.choices("abcdef", k=draw.randrange(5, 8))): draw.randrange(1, 1000) for _ in range(3000)}
    df = spark.createDataFrame(list(counts.items()), "word string, n bigint")
    want = sorted(map(tuple, spelling.near_words(df, 1).collect()))
    assert sorted(map(tuple, spelling.near_words(df, 100_000).collect())) == want


def test_spelling_query(spark):
    docs = [(r.doc_id, r.text) for r in table(spark, SF, "documents").collect()]
    counts = {}
    for i, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m.group().lower(), run)
            h = zlib.crc32(f"{i}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] = counts.get(run, 0) + 1
    counts = {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}
    got = spelling.op13_spelling_variants(spark, SF).select("word", "form", "root", "n", "n_near", "form_n").collect()
    assert counts and sorted(tuple(r) for r in got) == brute_spelling(counts)


def test_spelling_odd_rows(spark):
    df = spark.createDataFrame([("colour", 100, 1), ("color", 3, 1), ("color", 2, 1), (None, 9, 1), ("", 1, 1), ("a", 10, 1), ("b", None, 1)], "word string, n bigint, form int")
    got = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in spelling.spelling_groups(df).collect()}
    assert got == {"colour": (None, "colour", 100, 1, None), "color": ("colour", "colour", 5, 1, 100), "": ("a", "a", 1, 2, 10), "a": (None, "a", 10, 2, None), "b": ("a", "a", 0, 2, 10)}
    assert spelling.spelling_groups(df.where("false")).collect() == []
    with pytest.raises(ValueError):
        spelling.spelling_groups(df, factor=1)
    long = "x" * 1_000_000 + " word×s \U0001f600mixed " + "word " * 200_000
    docs = spark.createDataFrame([(1, None), (2, ""), (None, "Word"), (3, long), (3, long)], "doc_id bigint, text string")
    n = {(r.id, r.run): r.n for r in spelling.runs(docs).groupBy("id", "run").count().withColumnRenamed("count", "n").collect()}
    assert n == {(None, "word"): 1, (3, "x" * 1_000_000): 2, (3, "word×s"): 2, (3, "mixed"): 2, (3, "word"): 400_000}
