"""Operators without SQL against plain versions written apart from them."""

import random
import re
import zlib

import numpy as np
import pyarrow.parquet as pq
import xxhash

from navengine.llm import line_dedup, media, packing, quality
from navengine.llm.common import shared_dir

SF = "/root/testdata/sf0.01"
KIND = "doc_id long, text string"


def plain_line_dedup(rows, depth, least_tokens, least_docs, similarity):
    """Templates one after the other: the commonest open line of a leaf takes all open lines that fit it."""

    def tokens(line):
        t = [x for x in re.split(r"[ \t\n\x0b\f\r]+", line.strip(" \t\n\x0b\f\r"))]
        return tuple("<*>" if len(t) >= 3 and re.search("[0-9]", x) else x for x in t)

    def code(t):
        h = 42
        for x in t:
            h = xxhash.xxh64_intdigest(x.encode(), seed=h)
        return h - (1 << 64) if h >> 63 else h

    counts = lambda t: len(t) >= least_tokens and t[0] != ""
    at = {}
    for i, text in rows:
        for t in {tokens(x) for x in text.split("\n")}:
            if counts(t):
                at.setdefault(t, []).append(i)
    leaves = {}
    for t in at:
        leaves.setdefault((len(t), t[:depth]), []).append(t)
    first = {}
    for open_ in leaves.values():
        while open_:
            head = max(open_, key=lambda t: (len(at[t]), code(t)))
            mine = [t for t in open_ if sum(a == b for a, b in zip(t, head, strict=True)) >= similarity * len(t)]
            open_ = [t for t in open_ if t not in mine]
            docs = {i for t in mine for i in at[t]}
            if len(docs) >= least_docs:
                first |= dict.fromkeys(mine, min(docs))
    return {i: "\n".join(x for x in text.split("\n") if first.get(tokens(x), i) == i) for i, text in rows}


def test_line_dedup(spark):
    rng = random.Random(8)
    words = ["the", "old", "house", "7", "on", "page", "12", "sea", "x9", ""]
    lines = [" ".join(rng.choice(words) for _ in range(rng.randrange(1, 8))) for _ in range(60)]
    rows = [(i, "\n".join(rng.choice(lines) for _ in range(rng.randrange(1, 9)))) for i in range(60)]
    df = spark.createDataFrame(rows, KIND).repartition(3)
    for least_tokens, least_docs in ((1, 2), (3, 3)):
        got = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(df, depth=2, least_tokens=least_tokens, least_docs=least_docs, batch=1).collect()}
        assert got == plain_line_dedup(rows, 2, least_tokens, least_docs, 0.6)
        assert got != dict(rows)


def test_packing_ids_equal_the_library():
    import public_tokenizers
    from tokenizers import Tokenizer

    rng = random.Random(1)
    some = "aAéßñ中あ\U0001f600 \t\n\r\x0b\x1c\x85\xa0 '’.,-_0９²"
    texts = pq.read_table(f"{SF}/documents.parquet", columns=["text"])["text"].to_pylist()
    texts += ["".join(rng.choice(some) for _ in range(rng.randrange(60))) for _ in range(3000)]
    texts += ["".join(chr(rng.choice([rng.randrange(32, 0x3000), rng.randrange(0x10000, 0x1FFFF)])) for _ in range(30)) for _ in range(1000)]
    texts = [t for t in texts if t]
    tk = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    mine = packing._encoder(None, None, None)
    for lo in range(0, len(texts), 500):
        for t, want in zip(texts[lo : lo + 500], tk.encode_batch(texts[lo : lo + 500], add_special_tokens=False), strict=True):
            assert np.frombuffer(mine.encode(t), "<u4").tolist() == want.ids, repr(t)


def test_crossover_and_migration_save_bins():
    size, plain, evolved, alone, met = 1000, 0, 0, 0, 0
    for seed in range(10):
        rng = random.Random(seed)
        lens = []
        for _ in range(20):  # three items fill a bin exactly
            a = rng.randrange(380, 490)
            b = rng.randrange(250, (1000 - a) // 2 + 1)
            lens += [a, b, size - a - b]
        rng.shuffle(lens)
        order = sorted(range(len(lens)), key=lambda i: -lens[i])
        run = lambda s, seeds: packing.evolve(lens, size, seeds, random.Random(s), 8, 16)  # noqa: E731, B023
        one, two = run(1, []), run(2, [])
        both = packing.evolve(lens, size, [one, two], random.Random(3), 8, 16)
        for bins in (one, both):
            assert sorted(i for b in bins for i in b) == list(range(len(lens))) and all(sum(lens[i] for i in b) <= size for b in bins)
        plain += len(packing.best_fit(order, lens, size, []))
        evolved += len(one)
        alone += min(len(one), len(two))
        met += len(both)
    assert evolved < plain and met < alone


def test_support_vectors_close_the_duality_gap():
    rng = np.random.default_rng(2)
    dim, n = 30, 80
    rows = [np.sort(rng.choice(dim, 6, replace=False)) for _ in range(n)]
    values = [rng.normal(size=6) / 3 for _ in range(n)]
    y, cost = np.where(rng.random(n) < 0.5, -1.0, 1.0), np.full(n, 0.7)
    w = quality.dual_coordinate_descent(rows, values, y, dim, cost, epochs=4000)
    primal = lambda w: 0.5 * w @ w + cost @ np.maximum(0, 1 - y * np.array([v @ w[r] + w[-1] for r, v in zip(rows, values, strict=True)]))
    best = primal(w)
    for step in (0.3, 0.03, 0.003):  # no direction leads lower
        for _ in range(300):
            assert primal(w + rng.normal(size=dim + 1) * step) > best - 1e-3


def test_quality_of_one_class_and_clashing_columns(spark):
    kind = "doc_id long, text string, quality int, score double"
    rows = spark.createDataFrame([(1, "good text", 1, 0.0), (2, None, 1, 0.0), (3, "good text", None, 0.0)], kind)
    got = quality.classify(rows, quality.train(rows)).collect()
    assert {r["score"] for r in got} == {0.75} and len(got) == 3


def test_media_values_and_damaged_members(spark):
    texts = [(1, "abc"), (2, None), (3, "é" * 100), (4, "abc"), (None, "n")]
    folder = shared_dir(spark)
    manifest = media.write_media(spark.createDataFrame(texts, KIND).coalesce(1), folder)
    got = {r["doc_id"]: r for r in media.media_features(media.read_media(spark, folder, manifest)).collect()}
    for i, t in texts:
        raw = (t or "").encode()
        whole = raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))
        assert (got[i]["n_bytes"], got[i]["payload_bytes"], got[i]["tail_crc32"]) == (len(raw), len(whole), zlib.crc32(whole[-64:]))
    assert got[1][1:] == got[4][1:]
    path = manifest.first()["path"].removeprefix("file://")
    with open(path, "r+b") as f:  # damage to the second member's signature
        at = f.read().index(b"\x89PNG", 10)
        f.seek(at)
        f.write(b"?")
    left = media.read_media(spark, folder, manifest, onError="null", tries="2").collect()
    assert len(left) == 5 and sum(r["media"] is None for r in left) == 1
    lenient = media.media_features(media.read_media(spark, folder, manifest, onError="null"))
    assert lenient.count() == 5 and lenient.where("feature is null").count() == 1  # a failed member keeps its row
    empty = shared_dir(spark)
    assert media.read_media(spark, empty, media.write_media(spark.createDataFrame([], KIND), empty)).collect() == []


def test_lines_count_documents_not_rows(spark):
    line = "a line that stands in several rows of one document"
    kind = "doc_id bigint, text string, n_lines int"

    def left(rows, **how):
        return sorted((str(r["doc_id"]), r["text"]) for r in line_dedup.dedup_lines(spark.createDataFrame([(i, t, 0) for i, t in rows], kind), **how).collect())

    assert left([(1, line), (1, line), (2, line)], least_docs=3) == [("1", line), ("1", line), ("2", line)]
    assert left([(1, line), (1, line), (2, line)]) == [("1", line), ("1", line), ("2", "")]
    assert left([(None, line), (5, line)]) == [("5", line), ("None", "")]  # null comes last
    assert left([(None, line), (None, line)]) == [("None", line)] * 2  # one document
    long = "\n".join(f"line {w} of a very long text" for w in ("x" * (1 + i % 400) for i in range(20_000)))
    assert left([(1, long), (2, "other")]) == [("1", long), ("2", "other")]


def test_prior_counts_all_rows(spark):
    from navengine.llm import language_id

    rows = [(i, f"alpha beta {i}", "a") for i in range(300)] + [(1000 + i, f"gamma delta {i}", "b") for i in range(100)] + [(None, "gamma", "b"), (9, None, "a"), (8, "no language", None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    model = language_id.train(df, rows_per_language=20)
    assert np.allclose(np.exp(model.prior), np.array([301, 101]) / 402)
    got = language_id.identify(spark.createDataFrame([(1, "zzz", 0.5), (2, "", 0.5), (None, None, 0.5), (3, "gamma " * 300_000, 0.5)], "doc_id bigint, text string, score double"), model)
    assert {r["doc_id"]: r["lang_pred"] for r in got.collect()} == {1: "a", 2: "und", None: "und", 3: "b"}


def test_damage_inside_a_member_is_retried(spark, tmp_path):
    rows = [(i, f"text number {i} " * 30, 0) for i in range(12)] + [(None, None, 0), (5, "é" * 200_000, 0)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, n_bytes int").coalesce(1)
    folder = str(tmp_path / "media")
    manifest = media.write_media(df, folder)
    assert media.media_features(media.read_media(spark, folder, manifest)).count() == 14
    (path,) = (tmp_path / "media").glob("*.media")
    whole = path.read_bytes()
    at = whole.find(b"IDAT", whole.find(b"IDAT") + 1) + 9  # in the data of the second member
    path.write_bytes(whole[:at] + bytes([whole[at] ^ 1]) + whole[at + 1 :])
    start = whole.rfind(b"\x89PNG", 0, at)
    assert media.member(f"file://{path}", start, 10, 2)[1] == "short or damaged member"
    got = media.read_media(spark, folder, manifest, onError="null").collect()
    assert len(got) == 14 and [r["error"] for r in got if r["media"] is None] == ["short or damaged member"]
    found = media.media_features(media.read_media(spark, folder, manifest, onError="null")).collect()
    assert len(found) == 14 and sum(r["feature"] is None for r in found) == 1
    try:
        media.read_media(spark, folder, manifest).collect()
        raise AssertionError("the damage went unseen")
    except Exception as e:
        assert "damaged" in str(e)


def test_copies_beyond_the_broadcast(spark, tmp_path):
    from navengine.llm import warc

    page = "<p>" + "x" * 200 + "</p>"
    rows = [(i, f"u{i}", page if i % 3 else f"{page}{i % 7}", 1) for i in range(200, 0, -1)] + [(900, "a", None, 1), (901, None, "", 1), (7, "again", page, 1), (7, "again", page, 1)]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string, offset int").repartition(3)
    want = None
    for most in (10_000, 0):
        got = sorted(map(tuple, warc.read_warc(warc.write_warc(df, str(tmp_path / f"w{most}"), broadcast_rows=most), range_bytes=2000).select("page_id", "record_type", "refers_to", "payload_bytes").collect()), key=str)
        assert len(got) == len(rows) and (want is None or got == want)
        want = got
    assert {r[0] for r in want if r[1] == "response" and r[3] == 207} == {1}
    assert warc.read_warc(warc.write_warc(df.where("false"), str(tmp_path / "none"))).collect() == []


def test_top_k_over_many_blocks(spark):
    from navengine.llm import topk_search

    r = np.random.default_rng(3)
    x = r.normal(0, 1, (400, 5)).round(2)
    rows = [(i, v.tolist(), 1) for i, v in enumerate(x)] + [(i, [1.0, 1.0], 1) for i in (500, 501)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, rank int").repartition(5)
    w = {i: np.floor(1024 * np.array([*v, 0, 0, 0][:5])).astype(int) for i, v, _ in rows}
    asked = df.where("vec_id % 20 = 0")
    for size in (100, 5000, 1 << 20):
        got = sorted(map(tuple, topk_search.exact_top_k(df, asked, k=7, query_rows=6, block_bytes=size).collect()))
        assert got == sorted((q, k + 1, i, -s) for q in w if q % 20 == 0 for k, (s, i) in enumerate(sorted((-int(w[q] @ w[i]), i) for i in w if i != q)[:7]))


def test_quality_model_by_hand(spark):
    """Ratios, weights, margins and scores of a whole model against plain counts and the optimum of the hinge loss."""
    import math
    import random

    draw = random.Random(12)
    good, bad = "clear plain words about one thing".split(), "buy now cheap !!! click win".split()
    rows = [(i, " ".join(draw.choices(good if i % 2 else bad, k=5) + draw.choices(["the", "of", "a"], k=3)), i % 2) for i in range(120)] + [(200, None, 1), (201, "", 0), (None, "clear words", 1), (202, "unlabelled", None), (3, rows_text := "plain thing", 1)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, quality int")
    model = quality.train(df, rows_per_class=10_000, least_rows=1)
    counts = {}
    for _, t, y in rows:
        if y is not None:
            for f in quality.features(t):
                counts.setdefault(f, [1.0, 1.0])[1 - y] += 1
    p, q = sum(c[0] for c in counts.values()), sum(c[1] for c in counts.values())
    assert model.ratio.keys() == counts.keys()
    assert all(abs(model.ratio[f] - math.log((c[0] / p) / (c[1] / q))) < 1e-9 for f, c in counts.items())

    def margin(text):
        hit = [f for f in quality.features(text) if f in counts]
        norm = math.sqrt(2.0 + sum(model.ratio[f] ** 2 for f in hit))
        return model.bias + sum(model.weight[f] / norm for f in hit)

    docs = [(9, None), (9, ""), (None, "clear words"), (1, "buy now"), (1, rows_text), (2, "clear words " * 100_000)]
    got = quality.classify(spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id bigint, text string, score string"), model).collect()
    for r in got:
        m = margin(r["text"])
        assert abs(r["score"] - 1 / (1 + math.exp(-model.slope * m - model.shift))) < 1e-9 and r["predicted"] == int(r["score"] >= 0.7)
    # No small step of the weights lowers the objective: squared length and hinge losses at their cost.
    w = {f: model.weight[f] / model.ratio[f] for f in counts if abs(model.ratio[f]) > 1e-9}
    known = [(quality.features(t), 1 if y else -1) for _, t, y in rows if y is not None]
    share = {s: sum(y == s for _, y in known) / len(known) for s in (1, -1)}

    def loss(w, bias):
        total = 0.5 * (sum(x * x for x in w.values()) + bias * bias)
        for fs, y in known:
            hit = [f for f in fs if f in w]
            norm = math.sqrt(2.0 + sum(model.ratio[f] ** 2 for f in fs))
            total += max(0.0, 1 - y * (bias + sum(w[f] * model.ratio[f] for f in hit) / norm)) / (2 * share[y])
        return total

    least = loss(w, model.bias)
    for _ in range(60):
        step = {f: x + draw.gauss(0, 0.02) for f, x in w.items()}
        assert loss(step, model.bias + draw.gauss(0, 0.02)) > least - 2e-3 * least
    assert quality.train(df.where("false")).score("x") == 0.5


def test_quality_shuffles_no_text_that_is_not_sampled(spark, tmp_path, monkeypatch):
    """Texts meet the sampled labels alone; repeated documents and labels count as in a join of all."""
    import random

    draw = random.Random(4)
    rows = [(i, " ".join(f"{draw.getrandbits(64):x}" for _ in range(300)) + (" good" if i % 2 else " bad")) for i in range(2000)]
    docs = spark.createDataFrame([*rows, rows[0], rows[3], (5, None), (None, "x")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(2500)] + [(3, 1), (3, 0), (4, None), (None, 1), (6, 7)], "doc_id long, quality int")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    pick = quality.sample_per_class
    monkeypatch.setattr(quality, "sample_per_class", lambda rows, kind, id_col, most: pick(rows, kind, id_col, 20))
    store = spark.sparkContext._jsc.sc().statusStore()

    def written():
        executors = store.executorList(False)
        return sum(executors.apply(i).totalShuffleWrite() for i in range(executors.size()))

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        before = written()
        assert quality.op10_quality_classifier(spark, str(tmp_path)).count() == len(rows) + 4
        assert written() - before < 2_000_000  # the texts have 10 MB
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    for most in (20, 10_000):
        monkeypatch.setattr(quality, "sample_per_class", lambda rows, kind, id_col, _, most=most: pick(rows, kind, id_col, most))
        few = docs.where("doc_id < 60")
        a, b = quality.train(labels, docs=few, least_rows=1), quality.train(few.join(labels, "doc_id"), least_rows=1)
        assert a.ratio == b.ratio and len(a.ratio) > 2 and abs(a.bias - b.bias) < 0.05 and abs(a.shift - b.shift) < 0.5
