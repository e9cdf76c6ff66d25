"""The ten operators against brute force, on small tables with nulls, empty and long texts, ties and repeats."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

public_tokenizers = pytest.importorskip("public_tokenizers")

from tokenizers import Tokenizer  # noqa: E402

from pathloom.llm import bpe, classlm, components, decontaminate, langid, neardup, sharding, textkit, tokenstore, topk, toxicity, urlfilter  # noqa: E402

PATH = str(public_tokenizers.path("byte_bpe_50k.json"))
SCHEMA = "doc_id long, text string, lang string, rep string, score double"


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def _texts():
    rng = random.Random(2)
    vocab = [f"w{k}" for k in range(300)]
    base = [" ".join(rng.choices(vocab, k=rng.randint(30, 120))) for _ in range(25)]
    rows = [(k, t) for k, t in enumerate(base)]
    k = len(rows)
    for t in base[:12]:
        words = t.split()
        for _ in range(4):
            copy = words[:]
            for _ in range(rng.randint(0, 2)):
                copy[rng.randrange(len(copy))] = rng.choice(vocab)
            rows.append((k, " ".join(copy).upper() if rng.random() < 0.3 else "\t".join(copy)))
            k += 1
    rows += [(k, None), (k + 1, ""), (k + 2, " \n "), (k + 3, "a b"), (k + 4, "A  b"), (k + 5, "b a"), (k + 6, " ".join(vocab * 40)), (k + 7, "\u00e9t\u00e9 \u4e2d\u6587 \U0001f642 <|endoftext|> it's  we'll\n\n x")]
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "en", "x", 1.0) for i, t in _texts()], SCHEMA)


def _words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def _shingles(words):
    return {tuple(words[k : k + 5]) for k in range(len(words) - 4)} if len(words) >= 5 else ({tuple(words)} if words else set())


def _components(sets, links):
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in sets}


def test_near_duplicates(docs):
    sets = {i: _shingles(_words(t)) for i, t in _texts()}
    ids = sorted(sets)
    links = [(a, b) for a in ids for b in ids if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])]
    want = _components(sets, links)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in neardup.near_duplicates(docs).collect()}
    assert got == {i: (len(sets[i]), want[i], want[i] == i) for i in ids}
    assert len(set(want.values())) < len(ids)


def test_near_duplicates_split_buckets_and_blocks(docs, monkeypatch):
    whole = sorted(map(tuple, neardup.near_duplicates(docs).collect()))
    monkeypatch.setattr(neardup, "BUCKET_ROWS", 2)
    monkeypatch.setattr(neardup, "BLOCK_ROWS", 2)
    assert sorted(map(tuple, neardup.near_duplicates(docs).collect())) == whole


def test_near_duplicates_repeated_null_and_no_rows(spark):
    rows = [(3, "a b c d e f"), (3, "a b c d e f"), (1, "a b c d e f"), (3, "quite another text of words here"), (7, "quite another text of words here"), (None, "a b c d e f")]
    got = Counter(tuple(r) for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == Counter([(3, 2, 1, False), (3, 2, 1, False), (1, 2, 1, True), (3, 2, 1, False), (7, 2, 1, False), (None, 2, None, True)])
    assert neardup.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_connected_components(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + [(k, k + 1) for k in range(1000, 1060)] + [(4, None), (5, 5)]
    nodes = {x for a, b in edges if b is not None and a != b for x in (a, b)}
    want = _components({n: 0 for n in nodes}, [(a, b) for a, b in edges if b is not None and a != b])
    got = {r["node"]: r["component"] for r in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == want


@settings(max_examples=40, deadline=None)
@given(st.lists(st.text(alphabet="aB \t\n\x0b.é中", max_size=25), max_size=6))
def test_word_kernel(texts):
    import pyarrow as pa

    data, offs = textkit.utf8(pa.array(texts, pa.string()))
    keys, _, _, word_offs = textkit.words(data, offs)
    seen = {}
    for text, a, b in zip(texts, word_offs[:-1], word_offs[1:], strict=True):
        words = _words(text)
        assert b - a == len(words)
        for word, key in zip(words, keys[a:b].tolist(), strict=True):
            assert seen.setdefault(word, key) == key
    assert len(set(seen.values())) == len(seen)


def test_shards(docs):
    rows = {r["doc_id"]: r for r in sharding.balanced_shards(docs, 8).collect()}
    texts = dict(_texts())
    sizes = {i: len((t or "").encode()) + 1 for i, t in texts.items()}
    assert all(rows[i]["size"] == sizes[i] and rows[i]["text_crc32"] == zlib.crc32((t or "").encode()) and rows[i]["law"] == "bytes" and rows[i]["grown_shard"] is None for i, t in texts.items())
    order = [rows[i]["shard"] for i in sorted(texts)]
    assert order == sorted(order) and set(order) <= set(range(8))
    for shard in range(8):
        own = [i for i in sorted(texts) if rows[i]["shard"] == shard]
        assert [rows[i]["slot"] for i in own] == list(range(len(own)))
        assert abs(sum(sizes[i] for i in own) - sum(sizes.values()) / 8) <= max(sizes.values())


def test_shards_of_repeats_and_none(spark):
    got = sorted(tuple(r) for r in sharding.balanced_shards(spark.createDataFrame([(1, "a"), (1, "a"), (None, None), (2, "b")], "doc_id long, text string"), 2).select("shard", "slot").collect())
    assert got == [(0, 0), (0, 1), (1, 0), (1, 1)]
    assert sharding.balanced_shards(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_bpe_equals_the_library(docs, library):
    got = {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"], r["ids"]) for r in bpe.round_trips(docs, PATH, with_ids=True).collect()}
    for i, t in _texts():
        ids = library.encode(t or "", add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        assert got[i] == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest(), ids)


@settings(max_examples=80, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from(list("abst've rlm'\n\t  12.,!?aaaa")), st.characters(exclude_categories=["Cs"])), max_size=40), min_size=1, max_size=5))
def test_bpe_property(texts):
    library = Tokenizer.from_file(PATH)
    assert [x.tolist() for x in bpe.encoder(PATH).encode(texts)] == [library.encode(t, add_special_tokens=False).ids for t in texts]


def test_token_store(spark, docs, library):
    path = tokenstore.store_path(spark)
    tokenstore.write_store(docs, path, PATH)
    start, want, ids_of = 0, {}, {}
    for i, t in sorted(_texts()):
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 0]
        want[i], ids_of[i] = (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())), ids
        start += len(ids)
    assert {r["doc_id"]: (r["start"], r["n_tokens"], r["ids_crc32"]) for r in tokenstore.read_digests(spark, path).collect()} == want
    assert {r["doc_id"]: r["ids"] for r in tokenstore.read_ids(spark, path).collect()} == ids_of
    chunks = spark.read.parquet(f"{path}/chunks")
    assert chunks.count() == chunks.select("chunk_id").distinct().count()


def test_token_store_of_repeats_and_none(spark):
    path = tokenstore.store_path(spark)
    tokenstore.write_store(spark.createDataFrame([(1, "x"), (1, "x"), (None, None)], "doc_id long, text string"), path, PATH)
    got = sorted((r["start"], r["n_tokens"]) for r in tokenstore.read_digests(spark, path).collect())
    assert got == [(0, 1), (1, 2), (3, 2)] and spark.read.parquet(f"{path}/chunks").count() == 2
    empty = tokenstore.store_path(spark)
    tokenstore.write_store(spark.createDataFrame([], "doc_id long, text string"), empty, PATH)
    assert tokenstore.read_digests(spark, empty).count() == 0


def test_damaged_chunk_is_found():
    import pyarrow as pa

    batch = pa.record_batch([pa.array([b"0" * 16]), pa.array([2], pa.int8()), pa.array([b"\1\0"])], names=["chunk_id", "width", "data"])
    with pytest.raises(ValueError, match="does not match"):
        list(tokenstore._checked(iter([batch])))


def test_decontamination(spark):
    rng = random.Random(6)
    vocab = [f"t{k}" for k in range(400)]
    items = [(k, " ".join(rng.choices(vocab, k=n))) for k, n in enumerate([3, 5, 8, 20, 40, 90, 300])] + [(90, None), (91, ""), (None, "x y z u v w")]
    docs = []
    for k in range(40):
        words = rng.choices(vocab, k=rng.choice([3, 50, 400]))
        if k % 2:
            passage = items[rng.randrange(7)][1].split()
            for _ in range(rng.randint(0, len(passage) // 12)):
                passage[rng.randrange(len(passage))] = "changed"
            words[1:1] = passage
        docs.append((k, ", ".join(words).title()))
    docs += [(100, items[0][1]), (101, None), (102, ""), (3, docs[3][1])]

    def sets(t):
        return _shingles(re.findall(r"[^\W_]+", (t or "").lower()))

    want = Counter()
    for i, t in docs:
        for k, item in items:
            own, shared = sets(item), sets(t) & sets(item)
            if k is not None and own and len(shared) >= 0.8 * len(own):
                want[(i, k, len(shared), len(own))] += 1
    df = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id long, text string, item_id string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert Counter(tuple(r) for r in decontaminate.leaks(df, bench).collect()) == want and want
    leaked = {i for i, *_ in want}
    kept = decontaminate.without_leaks(df, bench)
    assert kept.columns == df.columns and Counter(r["doc_id"] for r in kept.collect()) == Counter(i for i, _ in docs if i not in leaked)
    assert decontaminate.leaks(df, bench.limit(0)).count() == 0


@pytest.mark.parametrize("threshold", [0.5, 0.8, 0.95, 1.0])
def test_every_size_class_holds_the_miss_bound(threshold):
    """Chance that a contained item's sketch shows too few values, drawn from the item's shingles without replacement."""
    for size_class in range(13):
        width = decontaminate.sketch_width(size_class)
        need = decontaminate.needed(width, threshold)
        for n in {2**size_class // 2 + 1, 2**size_class}:
            if n > width:
                held = math.ceil(threshold * n - 1e-9)
                missed = sum(math.comb(held, k) * math.comb(n - held, width - k) for k in range(need)) / math.comb(n, width)
                assert missed <= 1e-7, (n, width, need)
            assert n > width or width >= n
    assert [decontaminate.sketch_width(c) for c in (0, 3, 5, 6, 8)] == [1, 8, 32, 32, 36]


def test_decontamination_of_clashing_names_and_equal_items(spark):
    text = "one two three four five six seven"
    docs = spark.createDataFrame([(1, text + " eight", "p", "q", 3), (2, None, "p", "q", 4), (3, "other words " * 9, "p", "q", 5)], "k1 long, text string, k2 string, of string, item_id long")
    items = spark.createDataFrame([(7, text), (8, text.upper()), (9, "nothing of this kind at all here")], "item_id long, text string")
    assert sorted(tuple(r) for r in decontaminate.leaks(docs, items, id_col="k1").collect()) == [(1, 7, 3, 3), (1, 8, 3, 3)]
    kept = decontaminate.without_leaks(docs, items)
    assert kept.columns == docs.columns and sorted(r["k1"] for r in kept.collect()) == [2, 3]
    long = spark.createDataFrame([(1, ("word " * 60_000) + text)], "doc_id long, text string")
    assert {r["item_id"] for r in decontaminate.leaks(long, items).collect()} == {7, 8}


def test_exact_top_k(spark, monkeypatch):
    monkeypatch.setattr(topk, "BUCKET_ROWS", 16)
    rng = np.random.RandomState(1)
    rows = [(k, [float(x) for x in rng.randn(8) * rng.choice([0.1, 1, 3])]) for k in range(200)]
    rows += [(k, rows[0][1]) for k in range(200, 240)] + [(300, None), (301, []), (302, [None] * 8), (303, [float("nan")] * 8), (None, rows[1][1]), (304, [1.0, 2.0]), (400, [0.0] * 8)]
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<float>, score string")
    held = [(i, np.floor(64 * np.array(v, np.float32).astype(float)).astype(int)) for i, v in rows if i is not None and v and None not in v and not np.isnan(v).any()]
    want = []
    for q, v in held:
        if q % 20 == 0:
            best = sorted((-int(v @ w), i) for i, w in held if i != q and len(w) == len(v))[:20]
            want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(best)]
    got = sorted(tuple(r) for r in topk.exact_top_k(df, df.where("vec_id % 20 = 0")).collect())
    assert got == sorted(want)
    assert topk.exact_top_k(df.limit(0), df.limit(0)).count() == 0


def test_toxicity(spark):
    rng = random.Random(3)
    vocab = [f"{a}{b}{c}" for a in "bdfgkl" for b in "aeiou" for c in ("mer", "nal", "tos")]
    rows, labels = [], []
    for k in range(600):
        words, toxic = rng.choices(vocab, k=rng.randint(20, 80)), int(k % 5 == 0)
        if toxic:
            for _ in range(3):
                words[rng.randrange(len(words))] = rng.choice(["zarkon", "zarkish", "zarkite", "blemple"])
        rows.append((k, " ".join(words)))
        labels.append((k, toxic))
    rows += [(1000, None), (1001, ""), (1002, "you are an \u0456d\u0456ot and a m0r0n"), (1003, "the class clown sat by the trash can"), (1004, "ZARK0N zarkish 123 " * 3000)]
    df = spark.createDataFrame([(i, t, 9) for i, t in rows], "doc_id long, text string, predicted int")
    marks = spark.createDataFrame([*labels, (3, None), (None, 1)], "doc_id long, toxic int")
    model = toxicity.learn(df, marks)
    got = {r["doc_id"]: r for r in toxicity.score_toxicity(df, model).collect()}
    held = [k for k in range(600) if zlib.crc32(str(k).encode()) % 5 == 0]
    assert all(got[k]["held_out"] == (k in set(held)) for k in range(600))
    assert np.mean([got[k]["predicted"] == int(k % 5 == 0) for k in held]) > 0.97
    assert [got[k]["predicted"] for k in (1000, 1001, 1002, 1003, 1004)] == [0, 0, 1, 0, 1]
    kept = toxicity.without_toxic(df, model)
    assert kept.columns == df.columns and {1002, 1004}.isdisjoint(r["doc_id"] for r in kept.collect())
    assert toxicity.learn(df, marks.limit(0)).entries.keys() == {f" {w} " for w in toxicity.SEED}
    assert toxicity.score_toxicity(df.limit(0), model).count() == 0


def test_language(spark):
    rng = random.Random(4)
    parts = {"aa": ["ka", "lo", "mi"], "bb": ["schr", "ung", "keit"], "cc": ["\u00e9au", "oi", "\u00e7on"], "dd": ["zzy", "qua", "ix"], "ee": ["tho", "rr", "wen"], "ff": ["\u4e2d", "\u6587", "\u5b57"]}
    rows = []
    for k in range(360):
        lang = list(parts)[k % 6]
        rows.append((k, " ".join("".join(rng.choices(parts[lang], k=3)) for _ in range(rng.randint(3, 30))), lang))
    rows += [(900, None, "aa"), (901, "", None), (902, "12 34 !!", "bb"), (903, "kalomi " * 50000, None)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, lang string, score string")
    model = langid.learn(df)
    got = {r["doc_id"]: r for r in langid.identify(df, model).collect()}
    held = [k for k in range(360) if zlib.crc32(str(k).encode()) % 3 == 1]
    assert all(got[k]["held_out"] == (k in set(held)) for k in range(360))
    assert np.mean([got[k]["lang_pred"] == rows[k][2] for k in held]) > 0.97
    assert [got[k]["lang_pred"] for k in (900, 901, 902, 903)] == ["und", "und", "und", "aa"]
    assert all(0 <= r["score"] <= 1 for r in got.values())
    kept = langid.with_language(df, model)
    assert kept.columns == df.columns and {r["doc_id"] for r in kept.collect()} >= set(held) - {900}
    assert langid.learn(df.limit(0)) is None and {r["lang_pred"] for r in langid.identify(df, None).collect()} == {"und"}


def test_texts_without_letters_take_no_place_in_the_sample(spark, monkeypatch):
    monkeypatch.setattr(langid, "SAMPLE", 16)
    rows = [(k, None if k % 3 else "12 34", lang) for k in range(300) for lang in ("aa", "bb")]
    rows += [(1000 + k, {"aa": "kalo mika loka", "bb": "schrung keit ung"}[lang], lang) for k in range(8) for lang in ("aa", "bb")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.learn(df, usable=F.lit(True))
    assert model is not None and model.languages == ("aa", "bb")
    asked = spark.createDataFrame([(1, "mika kalo"), (2, "keit schrung")], "doc_id long, text string")
    assert {r["doc_id"]: r["lang_pred"] for r in langid.identify(asked, model).collect()} == {1: "aa", 2: "bb"}


def test_codewords_are_far_apart():
    for n in (2, 3, 5, 9, 40):
        code = langid.codewords(n)
        assert len({tuple(r) for r in code}) == n
    assert langid._distance(langid.codewords(40)) >= 5


def _lm_rows():
    rng = random.Random(9)
    a, b = [f"a{k}" for k in range(60)], [f"b{k}" for k in range(60)]
    rows = [(k, " ".join(w for _ in range(rng.randint(2, 40)) for w in (rng.choice(a), rng.choice(b)))) for k in range(400)]
    return rows + [(500, None), (501, ""), (502, "never seen words"), (503, "a1 b2 " * 20000)]


@pytest.mark.parametrize("lexicon", [400_000, 10])
def test_class_lm(spark, monkeypatch, lexicon):
    monkeypatch.setattr(classlm, "LEXICON", lexicon)
    monkeypatch.setattr(classlm, "SEEDS", 40)
    rows = _lm_rows()
    df = spark.createDataFrame([(i, t, 1.0) for i, t in rows], "doc_id long, text string, score double")
    counts = Counter()
    for i, t in rows:
        if zlib.crc32(str(i).encode()) % 10:
            counts.update([*_words(t), None])
    n, v = sum(counts.values()), len(counts)
    got = {r["doc_id"]: r for r in classlm.score_texts(df, classlm.train(df)).collect()}
    again = {r["doc_id"]: r for r in classlm.score_corpus(df).collect()}
    assert again.keys() == got.keys() and all(again[i][:6] == got[i][:6] and again[i]["score"] == pytest.approx(got[i]["score"], rel=1e-12) for i in got)
    model = base = 0.0
    for i, t in rows:
        tokens = [*_words(t), None]
        r = got[i]
        assert r["held_out"] == (zlib.crc32(str(i).encode()) % 10 == 0)
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(tokens), sum(counts[x] > 0 for x in tokens), n)
        assert r["base_score"] == pytest.approx(sum(math.log10((counts[x] + 0.1) / (n + 0.1 * (v + 1))) for x in tokens), rel=1e-9)
        assert r["score"] < 0 and math.isfinite(r["score"])
        assert r["perplexity"] == pytest.approx(10 ** (-r["score"] / len(tokens)), rel=1e-9)
        if r["held_out"] and i < 500:
            model, base = model + r["score"], base + r["base_score"]
    assert model > base * 0.9  # the alternating classes are found


def _word_classes(spark, m):
    """(key, bucket, count, class) of all words of a model's corpus, the end left out."""
    words = [tuple(r) for r in spark.read.parquet(m.lexicon.path).where("bucket >= 0").collect()]
    keys = np.array([w[0] for w in words], np.int64)
    bucket = np.array([w[1] for w in words])
    placed = {r["s"]: r["class"] for r in spark.read.parquet(m.placed).where("late").collect()} if m.placed else {}
    at = m.lexicon.find(keys.view(np.uint64))
    of = np.where(at >= 0, m.classes[np.maximum(at, 0)], m.classes[m.lexicon.end + 1 + bucket])
    of = np.array([placed.get(k, c) for k, c in zip(keys.tolist(), of.tolist(), strict=True)])
    return keys, bucket, np.array([w[2] for w in words]), of


@pytest.mark.parametrize("lexicon", [400_000, 60])
def test_class_lm_is_a_distribution(spark, monkeypatch, lexicon):
    monkeypatch.setattr(classlm, "LEXICON", lexicon)
    monkeypatch.setattr(classlm, "SEEDS", 40)
    m = classlm.train(spark.createDataFrame(_lm_rows(), "doc_id long, text string"))
    assert np.allclose((10**m.log_next).sum(axis=2), 1)
    _, _, count, of = _word_classes(spark, m)
    mass = np.zeros(m.log_next.shape[0])
    np.add.at(mass, of, 10 ** (m.log_known[of] + np.log10(count)))
    np.add.at(mass, m.classes[m.lexicon.end + 1 :], 10**m.log_unknown)
    used = np.bincount(of, minlength=len(mass)) > 0
    assert np.allclose(mass[used], 1)


@pytest.mark.parametrize("lexicon", [400_000, 60])
def test_class_lm_scores_by_brute_force(spark, monkeypatch, lexicon):
    """Every token's class, the class trigrams' interpolation and the words' shares, counted again in plain Python."""
    monkeypatch.setattr(classlm, "LEXICON", lexicon)
    monkeypatch.setattr(classlm, "SEEDS", 40)
    monkeypatch.setattr(classlm, "SYMBOL_BYTES", 300)
    rows = _lm_rows()[:60] + [(500, None), (502, "never seen words a1 a1 a1"), (503, "a1 b2 " * 300), (504, "a1 a1")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    m = classlm.train(df)
    keys, bucket, count, of = _word_classes(spark, m)
    known = {k: (b, c, g) for k, b, c, g in zip(keys.tolist(), bucket.tolist(), count.tolist(), of.tolist(), strict=True)}
    end = int(m.classes[m.lexicon.end])

    def tokens(text):
        data, offs = textkit.utf8(textkit.pa.array([text or ""]))
        w, first, stop, _ = textkit.words(data, offs)
        b = classlm._bucket(data, first, stop) if len(w) else np.zeros(0, int)
        return [(known[k][2], known[k][1], y) if k in known else (int(m.classes[m.lexicon.end + 1 + y]), 0, y) for k, y in zip(w.view(np.int64).tolist(), b.tolist(), strict=True)]

    three, two, one = Counter(), Counter(), Counter()
    once = Counter(b for b, c, _ in known.values() if c == 1)
    for i, t in rows:
        if zlib.crc32(str(i).encode()) % 10:
            x, y = end, end
            for z in [*(g for g, *_ in tokens(t)), end]:
                three[x, y, z] += 1
                two[y, z] += 1
                one[z] += 1
                x, y = y, z
    size = len(m.log_next)

    def p(context, z):
        """Witten-Bell: kinds seen after the context weigh for the shorter one."""
        if context is None:
            return 1 / size
        level = (three, two, one)[2 - len(context)]
        after = [level[(*context, g)] if context else one[g] for g in range(size)]
        shorter = p(context[1:] if context else None, z)
        n, kinds = sum(after), sum(c > 0 for c in after)
        return (after[z] + kinds * shorter) / (n + kinds) if n else shorter

    first_unknown = {g: sum(once[b] + 0.1 for b in range(classlm.BUCKETS) if m.classes[m.lexicon.end + 1 + b] == g) for g in range(size)}
    share = {g: min(0.5, max(1e-6, v / max(one[g], 1))) if v else 0.0 for g, v in first_unknown.items()}
    got = {r["doc_id"]: r["score"] for r in classlm.score_texts(df, m).collect()}
    memo = {}
    for i, t in rows:
        x, y, total = end, end, 0.0
        for g, c, b in [*tokens(t), (end, None, None)]:
            if (x, y, g) not in memo:
                memo[x, y, g] = math.log10(p((x, y), g))
            total += memo[x, y, g]
            if c is not None:
                total += math.log10((1 - share[g]) * c / one[g] if c else share[g] * (once[b] + 0.1) / first_unknown[g])
            x, y = y, g
        assert got[i] == pytest.approx(total, rel=1e-9)


@pytest.mark.parametrize("lexicon", [400_000, 100])
def test_all_words_but_rare_ones_are_clustered(spark, monkeypatch, lexicon):
    """Words beyond the seeds, whose endings tell nothing, go to the classes of the words used like them."""
    monkeypatch.setattr(classlm, "SEEDS", 40)
    monkeypatch.setattr(classlm, "LEXICON", lexicon)
    monkeypatch.setattr(classlm, "HELD_CODES", 50)
    monkeypatch.setattr(classlm, "DENSE", 60)
    monkeypatch.setattr(classlm, "PLACED_WORDS", 7)
    monkeypatch.setattr(classlm, "SYMBOL_BYTES", 500)
    rng = random.Random(12)
    a, b = [f"a{k}xx" for k in range(120)], [f"b{k}xx" for k in range(120)]
    rows = [(k, " ".join(w for _ in range(rng.randint(10, 40)) for w in (a[int(rng.random() ** 2 * 120)], b[int(rng.random() ** 2 * 120)]))) for k in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    counts = Counter(w for i, t in rows if zlib.crc32(str(i).encode()) % 10 for w in t.split())
    m = classlm.train(df)

    often = sorted(w for w, c in counts.items() if c >= classlm.LEAST_PLACED)
    assert len(often) > 200 and (m.placed is None) == (lexicon > 100)
    data, offs = textkit.utf8(textkit.pa.array([" ".join(often)]))
    keys, *_ = textkit.words(data, offs)
    found = _word_classes(spark, m)
    classes = dict(zip(found[0].tolist(), found[3].tolist(), strict=True))
    of = [classes[k] for k in keys.view(np.int64).tolist()]
    kinds = Counter(zip(of, (w[0] for w in often)))
    pure = sum(max(kinds[c, "a"], kinds[c, "b"]) for c in set(of)) / len(often)
    assert pure > 0.95, pure  # with the ending alone all but the seeds stand in one class


def test_neighbours_are_counted_by_brute_force():
    """Vectors of held words, buckets and words not held, over the edges of texts and repeats of a word."""
    import pyarrow as pa

    rng = np.random.RandomState(2)
    end, first, classes = 6, 2, np.concatenate((rng.randint(0, 3, 6), [3], rng.randint(0, 3, classlm.BUCKETS)))
    standing = np.arange(len(classes))
    standing[5] = end + 1 + 9  # a rare word counts as bucket 9
    classes[5] = classes[end + 1 + 9]
    docs = [([int(x) for x in rng.randint(0, 9, n)], [77, 78], [9, 4]) for n in (0, 1, 5, 30)]  # 6 and 7 are the text's own words, 8 a held one
    texts = [[x if x < 6 else 2 if x == 8 else ("late", x - 6) for x in own] for own, *_ in docs]
    batch = pa.record_batch(
        [
            pa.array([np.array([x if x < 6 else 2 if x == 8 else end + 1 + x - 6 for x in own] + [end], "<i4").tobytes() for own, *_ in docs]),
            pa.array([np.array(b, "<i2").tobytes() for *_, b in docs]),
            pa.array([np.array(k, "<i8").tobytes() for _, k, _ in docs]),
        ],
        names=["stream", "buckets", "keys"],
    )
    want = Counter()
    for text, (_, keys, buckets) in zip(texts, docs, strict=True):
        symbol = [end + 1 + buckets[x[1]] if isinstance(x, tuple) else int(standing[x]) for x in text]
        name = [("late", keys[x[1]]) if isinstance(x, tuple) else None for x in text]
        for kind, own in (("symbol", symbol), ("late", name)):
            for k, x in enumerate(own):
                if x is None or kind == "symbol" and x < first:
                    continue
                before, after = [(symbol[j] if 0 <= j < len(own) else end) for j in (k - 1, k + 1)]
                same_before, same_after = [0 <= j < len(own) and own[j] == x for j in (k - 1, k + 1)]
                key = x if kind == "late" else ("held", x)
                if not same_before:
                    want[key, int(classes[before])] += 1
                if same_after:
                    want[key, 8] += 1
                else:
                    want[key, 4 + int(classes[after])] += 1
    got = Counter()
    for out in classlm._neighbours(classes, end, first, standing, True)(iter([batch, batch])):
        for r in out.to_pylist():
            entries = np.frombuffer(r["vector"], np.uint8).reshape(-1, 3).astype(int)
            for slot, low, high in entries.tolist():
                got["late" if r["late"] else "held", r["s"], slot] += low + 256 * high
    assert got == Counter({(k[0], k[1], slot): 2 * n for (k, slot), n in want.items()})


def test_symbols_beyond_two_bytes():
    import pyarrow as pa

    end = 300_000
    batch = pa.record_batch([pa.array([np.array([7, end + 1, end + 2, end], "<i4").tobytes(), np.array([end], "<i4").tobytes()]), pa.array([np.array([511, 3], "<i2").tobytes(), None])], names=["stream", "buckets"])
    (found,) = classlm._pieces(batch, 0, 1, end)
    assert found[2].tolist() == [7, end + 512, end + 4, end, end] and found[4].tolist() == [1, 2] and found[5].tolist() == [0, 1]


def test_vectors_split_great_counts():
    batch = classlm._vectors(False, np.array([3, 5, 14]), np.array([65535 * 2 + 7, 65535, 1]), 10)
    entries = [np.frombuffer(v, np.uint8).reshape(-1, 3).astype(int) for v in batch.column(3).to_pylist()]
    assert [(int(s), [(e[0], e[1] + 256 * e[2]) for e in v.tolist()]) for s, v in zip(batch.column(1).to_pylist(), entries, strict=True)] == [(0, [(3, 65535), (3, 65535), (3, 7), (5, 65535)]), (1, [(4, 1)])]


def test_best_classes_against_the_likelihood():
    rng = np.random.RandomState(4)
    n, size = 30, 6
    counts = rng.poisson(0.7, (n + 1, n + 1)).astype(float)
    counts[3, 3] = 4
    of = np.append(rng.randint(0, size - 1, n), size - 1)

    def grams(of):
        member = np.eye(size)[of]
        return member.T @ counts @ member

    def likelihood(of):
        g = grams(of)
        return sum((x * np.log(np.maximum(x, 1e-300))).sum() * sign for x, sign in ((g, 1), (g.sum(axis=0), -1), (g.sum(axis=1), -1)))

    left, right, twice = np.zeros((n, size)), np.zeros((n, size)), np.diag(counts)[:n]
    for w in range(n):
        for x in range(n + 1):
            if x != w:
                left[w, of[x]] += counts[x, w]
                right[w, of[x]] += counts[w, x]
    got = classlm.best_classes(of[:n], left, right, twice, grams(of))
    for w in range(n):
        moved = [likelihood(np.where(np.arange(n + 1) == w, k, of)) for k in range(size - 1)]
        assert moved[got[w]] == pytest.approx(max(moved), rel=1e-12)
    assert (got != of[:n]).any()


def test_class_lm_without_training_rows(spark):
    df = spark.createDataFrame([(k, "a b") for k in range(200) if zlib.crc32(str(k).encode()) % 10 == 0], "doc_id long, text string")
    got = classlm.score_texts(df, classlm.train(df)).collect()
    assert len(got) == df.count() and all(r["n_known"] == 0 and r["train_tokens"] == 0 and math.isfinite(r["score"]) for r in got)
    assert classlm.score_texts(df.limit(0), classlm.train(df.limit(0))).count() == 0


def test_url_filter(spark):
    rules = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]
    rng = random.Random(1)
    rows = [(k, f"http://{'good' if k % 2 else 'spam'}{rng.randint(0, 99)}.{'x.org/fr/' if k % 2 else 'y.net/'}p{k}") for k in range(300)]
    rows += [(400, "HTTPS://WWW.Example.NET/en/a?b#c"), (401, "http://example.net/EN/"), (402, None), (403, "no scheme"), (404, "http://a.b://c/d"), (405, "http://example.com?x=/de/"), (406, "http://good12.z.info/p"), (407, "http://spam12.z.info/p"), (408, "x://sub.example.com/de/" + "q" * 5000), (409, "http://"), (401, "http://example.net/EN/")]

    def parts(u):
        if not u or "://" not in u:
            return "", ""
        rest = u.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0]
        return re.sub("[A-Z]", lambda m: m[0].lower(), host), re.match(r"[^?#]*", rest[len(host) :])[0]

    def rule(host, path):
        fit = [(len(h + p), h + p, kind) for kind, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        return max(fit, default=(0, None, None))

    df = spark.createDataFrame([(i, u, "x", "y") for i, u in rows], "page_id long, url string, html string, host string")
    got = Counter((r["page_id"], r["host"], r["path"], r["rule"]) for r in urlfilter.judge_urls(df, rules).collect())
    assert got == Counter((i, *parts(u), rule(*parts(u))[1]) for i, u in rows)
    judged = {r["page_id"]: r["verdict"] for r in urlfilter.judge_urls(df, rules).collect()}
    for i, u in rows:
        if rule(*parts(u))[2]:
            assert judged[i] == rule(*parts(u))[2]
    assert (judged[406], judged[407]) == ("allow", "block")
    assert {r["verdict"] for r in urlfilter.judge_urls(df.where("page_id > 401"), []).collect()} == {"allow"}
    assert urlfilter.judge_urls(df.limit(0), rules).count() == 0


def test_exact_top_k_of_repeats_lengths_and_huge_components(spark, monkeypatch):
    monkeypatch.setattr(topk, "BUCKET_ROWS", 4)
    monkeypatch.setattr(topk, "QUERY_ROWS", 2)
    monkeypatch.setattr(topk, "CHUNK", 2)
    monkeypatch.setattr(topk, "BOUNDS", 3)
    rng = np.random.RandomState(3)
    rows = [(k, [float(x) for x in rng.randn(6) * 10.0 ** rng.randint(-3, 2)]) for k in range(60)]
    rows += [(k, [1.0] * 6) for k in range(60, 100)] + [(20, [0.5] * 6), (40, [-3.0] * 6), (7, [2.0] * 6), (120, [1e300] * 6), (121, [-1e300, 0.0, 0.0, 0.0, 0.0, 0.0]), (140, [0.0] * 6)]
    rows += [(k, [float(x) for x in rng.randn(3)]) for k in range(200, 230)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    whole = [(i, [max(-int(1e150), min(int(1e150), math.floor(64 * x))) for x in v]) for i, v in rows]
    asking = {}
    for i, v in whole:
        if i % 20 == 0:
            asking[i] = min(v, asking.get(i, v))

    def score(a, b):
        return max(-(2**63), min(2**63 - 1, sum(x * y for x, y in zip(a, b, strict=True))))

    want = []
    for q, v in asking.items():
        best = sorted((-score(v, w), i) for i, w in whole if i != q and len(w) == len(v))[:5]
        want += [(q, k + 1, i, -x) for k, (x, i) in enumerate(best)]
    got = sorted(tuple(r) for r in topk.exact_top_k(df, df.where("vec_id % 20 = 0"), k=5).collect())
    assert got == sorted(want)


def _chain_rows(n, seed):
    """Texts of which each is near the one before: a few words at the front go, a few come at the end."""
    rng = random.Random(seed)
    words = [f"c{seed}x{k}" for k in range(3 * n + 120)]
    return [" ".join(words[3 * k : 3 * k + 120]) for k in rng.sample(range(n), n)]


@pytest.mark.parametrize("percent", [80, 85])
def test_large_clusters_are_confirmed_in_parts(spark, monkeypatch, percent):
    """Chains, near copies of one text, and texts that look alike but aren't near enough, in clusters over a block."""
    monkeypatch.setattr(neardup, "BLOCK_ROWS", 6)
    monkeypatch.setattr(neardup, "BLOCK_SHINGLES", 800)
    rng = random.Random(percent)
    texts = _chain_rows(40, 1)
    for base in range(3):
        words = [f"b{base}w{k}" for k in range(150)]
        for _ in range(25):
            copy = words[:]
            for _ in range(rng.choice([1, 2, 3, 4, 5, 6])):
                copy[rng.randrange(150)] = f"z{rng.randrange(10**6)}"
            texts.append(" ".join(copy))
    rng.shuffle(texts)
    sets = {i: _shingles(_words(t)) for i, t in enumerate(texts)}
    ids = sorted(sets)
    want = _components(sets, [(a, b) for a in ids for b in ids if a < b and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])])
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(df, percent=percent).collect()}
    assert got == want and len(set(want.values())) > 4


def test_contraction_by_brute_force():
    rng = random.Random(4)
    for n in (1, 5, 60, 400):
        edges = [(rng.randrange(n), rng.randrange(n)) for _ in range(n)] + [(k, k + 1) for k in range(900, 900 + n)]
        node, root = components.contracted(*np.array(edges).T)
        assert dict(zip(node.tolist(), root.tolist(), strict=True)) == _components({x: 0 for e in edges for x in e}, edges)


def test_components_with_hot_nodes(spark, monkeypatch):
    monkeypatch.setattr(components, "LOCAL_EDGES", 9)
    monkeypatch.setattr(components, "HOT_EDGES", 3)
    monkeypatch.setattr(components, "HOT_NODES", 20)
    edges = [(0, k) for k in range(1, 60)] + [(k, 900) for k in range(100, 150)] + [(59, 700), (700, 701)] + [(2000 + k, 2001 + k) for k in range(9)]
    want = _components({n: 0 for e in edges for n in e}, edges)
    got = {r["node"]: r["component"] for r in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == want


def test_many_rows_of_one_id_count_once(spark):
    rows = [(1, "one two three four five six")] * 50 + [(2, "one two three four five six seven")] + [(3, "one two three four five six")]
    got = Counter(tuple(r) for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), percent=61).collect())
    assert got == Counter({(1, 2, 1, True): 50, (2, 3, 1, False): 1, (3, 2, 1, False): 1})


def test_empty_tables_and_long_texts_of_bpe_and_shards(spark, library):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert bpe.round_trips(empty, PATH).count() == 0 and bpe.round_trips(empty, PATH, with_ids=True).columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids"]
    long = "wörd and word " * 100_000
    df = spark.createDataFrame([(1, long), (1, long), (2, None), (None, "x")], "doc_id long, text string")
    got = Counter(tuple(r) for r in bpe.round_trips(df, PATH).select("doc_id", "n_tokens").collect())
    assert got == Counter({(1, len(library.encode(long, add_special_tokens=False).ids)): 2, (2, 0): 1, (None, 1): 1})
    sizes = sorted((r["size"], r["text_crc32"]) for r in sharding.balanced_shards(df, 2).collect())
    assert sizes == sorted([(len(long.encode()) + 1, zlib.crc32(long.encode()))] * 2 + [(1, 0), (2, zlib.crc32(b"x"))])


def test_shards_of_sizes_beyond_a_long(monkeypatch):
    import pyarrow as pa

    size = np.array([2**61, 2**61, 2**60], np.int64)
    batch = pa.record_batch([pa.array([1, 2, 3]), pa.array(size), pa.array([0, 0, 0]), pa.array([0, 0, 0], pa.int32())], names=["doc_id", "size", "text_crc32", "part"])
    (out,) = sharding._placed({0: 0}, int(size.sum()), 8, {0: 0}, None)(iter([batch]))
    assert out.column(3).to_pylist() == [1, 4, 7]


def test_class_lm_of_repeated_rows(spark):
    rows = [(k, "the cat sat on the mat " * 3) for k in range(40)]
    one = {r["doc_id"]: r["score"] for r in classlm.score_corpus(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    twice = classlm.score_corpus(spark.createDataFrame(rows + rows[:5] + [(None, "the cat")], "doc_id long, text string")).collect()
    assert len(one) == 40 and Counter(r["doc_id"] for r in twice) == Counter([i for i, _ in rows] + [i for i, _ in rows[:5]] + [None])
    assert len({r["score"] for r in twice if r["doc_id"] is not None}) == 1
