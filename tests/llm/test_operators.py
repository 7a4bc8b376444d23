"""The operators against brute force, exact round trips and odd rows."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from navengine.llm import html_text, jaccard_join, language_id, line_dedup, media, packing, quality, sentence_pieces, topk_search, warc
from navengine.llm.common import shared_dir

KIND = "doc_id long, text string, lang string, fp long"  # a column that clashes with an internal name
ODD = [(1, None, None, 0), (2, "", "en", 0), (3, "one", "en", 0), (None, "no id here at all", "en", 0), (3, "one", "en", 0), (4, "\U0001f600 é\x00 ▁ x y\r\n\ttab  two ", "fr", 0)]


def docs(spark, rows):
    return spark.createDataFrame(rows, KIND).repartition(3)


def brute_components(rows):
    def shingles(t):
        w = re.findall(r"[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()}

    sets = {i: shingles(t) for i, t in rows}
    label = {i: i for i in sets}

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    ids = sorted(sets)
    for k, i in enumerate(ids):
        for j in ids[k + 1 :]:
            a, b = sets[i], sets[j]
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                x, y = sorted((root(i), root(j)))
                label[y] = x
    return {i: (len(sets[i]), root(i)) for i in ids}


@pytest.mark.parametrize("cold", [2, 48])
def test_jaccard_join_is_exact(spark, cold):
    """Near copies, a passage that all share, and short texts; a low bound sends buckets through the blocks."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    passage, base = [word() for _ in range(30)], [word() for _ in range(90)]
    rows = []
    for i in range(40):
        w = list(base)
        for _ in range(rng.randrange(4)):
            w[rng.randrange(len(w))] = word()
        rows.append((len(rows), " ".join(w)))
    for _ in range(40):
        rows.append((len(rows), " ".join([*passage, *(word() for _ in range(rng.randrange(1, 12)))])))
    for n in range(1, 14):
        t = [word() for _ in range(n)]
        rows += [(len(rows), " ".join(t)), (len(rows) + 1, " ".join(t[:-1] or t)), (len(rows) + 2, " ".join(t).upper())]
    got = jaccard_join.ngram_jaccard_join(docs(spark, [(i, t, None, 0) for i, t in rows]), cold=cold).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == brute_components(rows)


def test_jaccard_join_odd_rows(spark):
    got = [(r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard_join.ngram_jaccard_join(docs(spark, ODD)).collect()]
    assert sorted(got, key=str) == sorted([(1, 0, 1), (2, 0, 2), (3, 1, 3), (None, 1, None), (3, 1, 3), (4, brute_components([(4, ODD[-1][1])])[4][0], 4)], key=str)
    assert jaccard_join.ngram_jaccard_join(docs(spark, [])).collect() == []


def test_language_id(spark):
    rows = [(i, f"the cat sat on mat {i} there", "en", 0) for i in range(20)] + [(100 + i, "le chat est sur la table verte", "fr", 0) for i in range(20)]
    model = language_id.train(docs(spark, rows))
    got = language_id.identify(docs(spark, [*ODD, (9, "The cats", "", 0), (10, "LA CHATTE", "", 0), (11, "12 -", "", 0)]), model)
    found = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in got.collect()}
    assert got.count() == 9 and found[9][0] == "en" and found[10][0] == "fr"
    assert found[1] == found[2] == found[11] == ("und", 0.0)
    empty = language_id.train(docs(spark, []))
    assert {r["lang_pred"] for r in language_id.identify(docs(spark, ODD), empty).collect()} == {"und"}


def test_quality(spark):
    rows = [(i, f"clean words of prose number {i % 7} go here", 1) for i in range(60)] + [(100 + i, f"junk ### && {i % 7} ### words", 0) for i in range(60)]
    model = quality.train(spark.createDataFrame(rows, "doc_id long, text string, quality int"))
    got = {r["doc_id"]: r for r in quality.classify(docs(spark, [*ODD, (8, "clean prose here", "", 0), (9, "### && junk", "", 0)]), model).collect()}
    assert got[8]["predicted"] == 1 and got[9]["predicted"] == 0 and all(0 <= r["score"] <= 1 for r in got.values())
    none = quality.train(spark.createDataFrame([], "doc_id long, text string, quality int"))
    assert none.score("x") == 0.5


def test_dual_coordinate_descent_separates():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(200, 3))
    y = np.sign(x @ np.array([1.0, -2.0, 0.5]))
    w = quality.dual_coordinate_descent([np.arange(3)] * 200, list(x), y, 3, np.full(200, 10.0), epochs=200)
    assert (np.sign(x @ w[:3] + w[3]) == y).mean() > 0.97


def test_sentence_pieces(spark):
    import public_tokenizers
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    p = sentence_pieces.Pieces(public_tokenizers.path("piece_bpe_32k.model"))
    for t in ("Hello there, world.\nNew line", "Öffnung année 123", "x" * 100):
        assert np.frombuffer(p.encode(t), "<u4").tolist() == sp.encode(t)
    texts = [t for _, t, _, _ in ODD]
    got = sentence_pieces.encode_pieces(docs(spark, ODD), dropout=0.3, seed=3)
    assert sorted(str(r["text"]) for r in sentence_pieces.decode_pieces(got).collect()) == sorted(t or "" for t in texts)
    a, b = p.encode("varied merge type segmentations of this text", 20000, 1), p.encode("varied merge type segmentations of this text", 20000, 2)
    assert a != b and p.decode(a) == p.decode(b)


def test_warc(spark, tmp_path):
    magic = "WARC/1.0\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    rows = [(1, "http://a", "x" * 200), (2, "http://b", "x" * 200), (3, None, None), (4, "u", magic * 9), (5, "u", "short"), (6, "u", "short"), (7, "a\r\nb", "é" * 90)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(2)
    manifest = warc.write_warc(pages, shared_dir(spark))
    got = {r["page_id"]: r for r in warc.read_warc(manifest, range_bytes=97, with_payload=True).collect()}
    assert len(got) == 7
    for i, _, h in rows:
        data = (h or "").encode()
        assert got[i]["payload_digest"] == hashlib.sha256(data).hexdigest() and got[i]["payload_bytes"] == len(data)
        assert got[i]["record_type"] == ("revisit" if i == 2 else "response") and got[i]["refers_to"] == (1 if i == 2 else None)
        assert bytes(got[i]["payload"]) == (b"" if i == 2 else data)
    assert warc.read_warc(warc.write_warc(pages.limit(0), shared_dir(spark))).collect() == []


def test_html(spark):
    page = '<html><head><title>T</title></head><body><nav><ul><li>menu</li></ul></nav><div class="ad">buy</div><article><h1>Head</h1><p>One &amp; two<br>three.<p>A\n b</p><section class="comments"><p>me too</p></section></article><aside>side</aside><footer>&copy; all'
    assert html_text.main_blocks(page) == ["Head", "One & two three.", "A b"]
    long = "word " * 40
    assert html_text.main_blocks(f'<div id="menu">a</div><p>{long}</p><p>{long}</p>') == [long.strip()] * 2
    rows = spark.createDataFrame([(1, None), (2, ""), (3, page)], "page_id long, html string")
    assert {r["page_id"]: r["n_chars"] for r in html_text.extract_text(rows).collect()} == {1: 0, 2: 0, 3: 27}


def test_packing(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    rng = random.Random(2)
    rows = [*ODD, *((10 + i, " ".join(rng.choice(["alpha", "beta,", "don't", "12", "é!\n\n x"]) for _ in range(rng.randrange(1, 400))), "", 0) for i in range(60)), (80, "a <|endoftext|> b<|endoftext|>", "", 0), (81, "x\x1c y", "", 0)]
    got = packing.pack(docs(spark, rows), size=128, per_shard=50).collect()
    tk = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    by = {}
    for r in got:
        by.setdefault(r["doc_id"], []).append(r)
    for i, t, _, _ in rows:
        ids = np.array([*tk.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        mine = sorted({(r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in by[i]})
        assert sum(m[2] for m in mine) == len(ids) and all(zlib.crc32(ids[s : s + n].tobytes()) == c for _, s, n, c in mine)
    bins = {}
    for r in got:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for b in bins.values():
        at = 0
        for o, n in sorted(b):
            assert o == at
            at += n
        assert at <= 128
    assert len(bins) <= 1.1 * sum(r["length"] for r in got) / 128 + 2
    assert packing.pack(docs(spark, [])).collect() == []


def test_media(spark):
    folder = shared_dir(spark)
    manifest = media.write_media(docs(spark, ODD), folder, archive_bytes=300)
    got = media.media_features(media.read_media(spark, folder, manifest, rangeBytes="150")).collect()
    want = sorted((str(i), len((t or "").encode()), hashlib.sha256(media.padded(t)[0]).hexdigest()) for i, t, _, _ in ODD)
    assert sorted((str(r["doc_id"]), r["n_bytes"], r["payload_sha256"]) for r in got) == want
    assert media.member("file:///nowhere/at.all", 0, 9, 2)[0] is None


def test_top_k(spark):
    rng = np.random.default_rng(3)
    v = [(i, [float(x) for x in rng.integers(-3, 3, 4) / 8]) for i in range(120)] + [(500, None), (501, [1.0, None, 0.0, 0.0]), (502, [float("nan")] * 4), (503, [])]
    t = spark.createDataFrame(v, "vec_id long, embedding array<double>").repartition(4)
    got = {}
    for r in topk_search.exact_top_k(t, t.where("vec_id % 20 = 0"), k=5, query_rows=4, block_bytes=256).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    w = {i: np.floor(1024 * np.array(x)).astype(int) if x else np.zeros(4, int) for i, x in v if i < 120 or i == 503}
    for q in range(0, 120, 20):
        best = sorted(((-int(w[q] @ x), i) for i, x in w.items() if i != q))[:5]
        assert sorted(got[q]) == [(k + 1, i, -s) for k, (s, i) in enumerate(best)]


def test_line_dedup(spark):
    note = "page 7 of our site is free"
    rows = [(20 + i, f"own text number {chr(97 + i)} stands here\n{note.replace('7', str(i))}\nok", "", 0) for i in range(5)] + [(40, "all rights reserved by us", "", 0), (41, "all rights reserved by us", "", 0)]
    got = {r["doc_id"]: r for r in line_dedup.dedup_lines(docs(spark, [*rows, *ODD]), least_tokens=3, least_docs=3).collect() if r["doc_id"] is not None}
    assert got[20]["text"].split("\n")[1] == "page 0 of our site is free" and got[23]["text"].split("\n")[-1] == "ok"
    assert all("page" not in got[i]["text"] for i in range(21, 25)) and got[40]["text"] == got[41]["text"] != ""
    assert got[21]["n_dropped"] >= 1 and got[22]["n_dropped"] >= 1
    assert line_dedup.dedup_lines(docs(spark, [])).collect() == []


def test_warc_headers_of_any_length_and_lost_records(spark):
    rows = [(1, "http://a", "x" * 300), (2, "http://b/" + "p" * 70_000 + "\n" * 50_000, "long"), (3, "http://c", "y" * 300), (4, "http://d/" + "q" * 200_000, None), (5, "http://e", "z")]
    manifest = warc.write_warc(spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1), shared_dir(spark))
    for size in (16 << 20, 30_000):
        got = {r["page_id"]: r["url"] for r in warc.read_warc(manifest, range_bytes=size).collect()}
        assert got == {i: u.replace("\n", "%0A") for i, u, _ in rows}
    with pytest.raises(ValueError, match="manifest"):
        warc.read_warc(manifest.withColumn("records", F.col("records") + 1))
    path = manifest.first()["path"].removeprefix("file://")
    with open(path, "r+b") as f:  # damage to the third record's start
        data = f.read()
        f.seek(data.rindex(warc.MAGIC, 0, data.index(b"Target-URI: http://c")))
        f.write(b"?")
    with pytest.raises(ValueError, match="manifest"):
        warc.read_warc(manifest)


def test_line_dedup_two_documents_short_lines_and_many_templates(spark):
    def dropped(rows, **k):
        got = line_dedup.dedup_lines(docs(spark, [(i, t, "", 0) for i, t in rows]), least_tokens=1, least_docs=2, **k).collect()
        return {r["doc_id"]: r["text"] for r in got}

    rows = [(1, "a passage that repeats in two\n\nLes.\n7\n全部一行没有空格"), (2, "a passage that repeats in two\n\nAnd ornd.\n8\nfirst only"), (3, "Les.\n\nAnd ornd.\n7\n全部一行没有空格")]
    assert dropped(rows) == {1: rows[0][1], 2: "\nAnd ornd.\n8\nfirst only", 3: ""}
    # Five templates in one leaf; every line stands in one document, so only fields make them recur.
    tails = ["red big old dog ran far", "blue tiny new cat sat near", "green wet odd fox hid low", "grey dry raw owl flew high", "pink hot shy eel swam deep"]
    rows = [(10 * k + j, f"we saw the very {t} {j}") for k, t in enumerate(tails) for j in range(2)]
    for batch in (1, 2, 64):
        assert dropped(rows, batch=batch) == {i: t if i % 10 == 0 else "" for i, t in rows}


def test_sentence_pieces_each_occurrence_draws():
    import public_tokenizers

    p = sentence_pieces.Pieces(public_tokenizers.path("piece_bpe_32k.model"))
    plain = tuple(p.merge("▁international")[1])
    text = " ".join(["international"] * 20_000)
    ids = np.frombuffer(p.encode(text, 6554, 5, 77), "<u4")
    assert p.decode(ids.tobytes()) == text and ids.tobytes() == p.encode(text, 6554, 5, 77)
    words, at = [], []
    for i in ids.tolist():
        if p.text[i].startswith(b" ") and at:
            words.append(tuple(at))
            at = []
        at.append(i)
    words.append(tuple(at))
    assert len(words) == 20_000 and len(set(words)) > 10
    keys = random.Random(1)  # the plain way: a draw for each candidate
    each = np.mean([tuple(p._merge_long("▁international", 6554, keys.getrandbits(64))) == plain for _ in range(20_000)])
    assert abs(np.mean([w == plain for w in words]) - each) < 0.02 and 0.1 < each < 0.9
    long = "ab" * 500
    assert p.decode(p.encode(long, 6554)) == long and p.decode(p.encode("我们 в x▁y " + long, 30000, 1, 2)) == "我们 в x▁y " + long


def test_top_k_large_components(spark):
    rows = [(100, [1.0, 1.0]), (1, [70000.0, 0.0]), (2, [0.5, 0.5]), (3, [float("inf"), 0.0])]
    t = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = topk_search.exact_top_k(t, t.where("vec_id = 100")).orderBy("rank").collect()
    assert [(r["vec_id"], r["score"]) for r in got] == [(1, 70000 * 1024 * 1024), (2, 1024 * 1024)]
    big = np.array([[1 << 40, 3]], np.int64)
    assert topk_search.accumulate(big, np.array([[5], [7]], np.int64)).tolist() == [[5 * (1 << 40) + 21]]
    with pytest.raises(OverflowError):
        topk_search.accumulate(big, big.T)
    assert topk_search.exact_top_k(t.limit(0), t.limit(0)).collect() == []
    repeated = topk_search.exact_top_k(t.unionByName(t.where("vec_id = 2")), t.where("vec_id = 100")).orderBy("rank")
    assert [r["vec_id"] for r in repeated.collect()] == [1, 2, 2]


def test_language_id_with_many_languages(spark):
    rows = [(i, f"word{chr(97 + i % 26)}{chr(97 + i // 26)} of its own", f"l{i:03d}", 0) for i in range(300)]
    model = language_id.train(docs(spark, rows))
    assert len(model.languages) == 300
    got = language_id.identify(docs(spark, rows[:5]), model).collect()
    assert {r["doc_id"]: r["lang_pred"] for r in got} == {i: f"l{i:03d}" for i in range(5)}


def test_language_scores_by_brute_force(spark):
    train = [(1, "the cat and the dog", "en", 0), (2, "le chat et le chien", "fr", 0), (3, "the hat", "en", 0)]
    model = language_id.train(docs(spark, train), alpha=0.2)
    items = {"en": ["the cat and the dog", "the hat"], "fr": ["le chat et le chien"]}

    def grams(n):
        return {lang: [g for t in texts for w in language_id.words(t) for g in ([w] if not n else language_id.ngrams(w, n))] for lang, texts in items.items()}

    tables = {n: grams(n) for n in (0, *language_id.LENGTHS)}
    size = len({(min(n, 1), g) for n, by in tables.items() for gs in by.values() for g in gs})
    log = lambda n, g, lang: np.log((tables[n][lang].count(g) + 0.2) / (len(tables[n][lang]) + 0.2 * size))

    def score(text, lang):
        total = np.log(len(items[lang]) / sum(map(len, items.values())))  # the share of labelled rows
        for w in language_id.words(text):
            if any(w in x for x in tables[0].values()):
                total += log(0, w, lang)
                continue
            for n in language_id.LENGTHS:
                seen = [g for g in language_id.ngrams(w, n) if any(g in x for x in tables[n].values())]
                if seen:
                    total += np.mean([log(n, g, lang) for g in seen])
                    break
        return total

    texts = ["the chats", "le hatter", "zzz qqq", "doge chien the"]
    got = {r["doc_id"]: r for r in language_id.identify(docs(spark, [(i, t, None, 0) for i, t in enumerate(texts)]), model).collect()}
    for i, t in enumerate(texts):
        s = {lang: score(t, lang) for lang in items}
        best = max(sorted(s), key=s.get)
        assert got[i]["lang_pred"] == best
        assert abs(got[i]["score"] - 1 / sum(np.exp(x - s[best]) for x in s.values())) < 1e-4


def test_pieces_with_dropout_by_brute_force():
    import public_tokenizers

    p = sentence_pieces.Pieces(public_tokenizers.path("piece_bpe_32k.model"))
    odds = [(1 - 9000 / 65536) ** k * 2.0**64 for k in range(1, sentence_pieces.LONG + 1)]

    def slow(part, key):
        """A part's ids: before each skip, as many candidates are merged as the draw says."""
        parts, barred = list(part), set()
        draw = sentence_pieces._drawn(np.array([key], np.uint64))
        gap = sum(int(draw[0]) < o for o in odds)
        while True:
            spots = [(p.rank[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in p.rank and (i, a, b) not in barred]
            if not spots:
                return p._ids(parts)
            _, i = min(spots)
            if not gap:
                barred.add((i, parts[i], parts[i + 1]))
                draw = sentence_pieces._drawn(draw)
                gap = sum(int(draw[0]) < o for o in odds)
                continue
            gap -= 1
            barred = {(j - (j > i), a, b) for j, a, b in barred if j not in (i - 1, i + 1)}
            parts[i : i + 2] = [parts[i] + parts[i + 1]]

    words = ["international", "telephone", "banana", "abab", "kindness", "overwhelming"] * 5
    got = p.encode(" ".join(words), 9000, 3, 11)
    want = [x for k, w in enumerate(words) for x in slow("▁" + w, k + 3 * 0x9E3779B9 + 11)]
    assert np.frombuffer(got, "<u4").tolist() == want


def test_pieces_of_many_texts_at_once(monkeypatch):
    """Texts together, in blocks and after forgetting equal each text alone; new words cost no call each."""
    import sys

    import public_tokenizers

    rng = random.Random(8)
    texts = ["".join(rng.choices("abcdeinorst  é▁我\n\ud800", k=rng.randrange(200))) for _ in range(300)] + [None, "", " ", "▁", "ab" * 200, "in" * 24 + " " + "in" * 25]
    keys = [rng.getrandbits(64) for _ in texts]
    p, few = (sentence_pieces.Pieces(public_tokenizers.path("piece_bpe_32k.model"), most) for most in (500_000, 50))
    for rate in (0, 6554, 40000):
        want = [p.encode(t, rate, 3, k) for t, k in zip(texts, keys, strict=True)]
        assert p.encode_all(texts, rate, 3, keys) == want and [p.decode(x) if x else t for x, t in zip(want, texts, strict=True)] == texts
        with monkeypatch.context() as m:
            m.setattr(sentence_pieces, "BLOCK", 7)
            m.setattr(sentence_pieces, "AT_ONCE", 5)
            assert few.encode_all(texts, rate, 3, keys) == want
    words = " ".join("".join(rng.choices("abcdeinorst", k=9)) for _ in range(20_000))
    calls = [0]
    sys.setprofile(lambda frame, event, arg: calls.__setitem__(0, calls[0] + (event == "call")))
    try:
        p.encode(words, 6554, 1, 1)
    finally:
        sys.setprofile(None)
    assert calls[0] < 30_000  # one numbers each new word; the merges make none


def test_components_by_brute_force(spark):
    from navengine.llm.components import connected_components

    rng = random.Random(5)
    links = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(rng.randrange(200, 300), rng.randrange(200, 300)) for _ in range(60)] + [(7, 7), (None, 3), (101, 100)]
    want = {}

    def root(i):
        while want.setdefault(i, i) != i:
            i = want[i]
        return i

    for a, b in links:
        if a is not None and a != b:
            x, y = sorted((root(a), root(b)))
            want[y] = x
    made = lambda rows: spark.createDataFrame(rows, "a long, b long")
    whole = {r["node"]: r["label"] for r in connected_components(made(links)).collect()}
    assert whole == {i: root(i) for i in list(want)}
    later = connected_components(made(links[40:]), known=connected_components(made(links[:40])))
    assert {r["node"]: r["label"] for r in later.collect()} == whole
    assert connected_components(made([])).collect() == []
