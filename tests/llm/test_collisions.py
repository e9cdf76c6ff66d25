"""Texts that structured hashes confuse, damaged stores, and long texts cut into pieces."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")

from tokenizers import Tokenizer  # noqa: E402

from pathloom.llm import bpe, classlm, neardup, textkit, tokenstore  # noqa: E402

PATH = str(public_tokenizers.path("byte_bpe_50k.json"))


def thue_morse(steps):
    text = "a"
    for _ in range(steps):
        text += text.translate(str.maketrans("ab", "ba"))
    return text


ONE = thue_morse(11)
OTHER = ONE.translate(str.maketrans("ab", "ba"))


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.mark.parametrize("encoder", [bpe.encoder, tokenstore.library_encoder])
def test_structured_texts_keep_their_own_ids(encoder, library):
    texts = [ONE, OTHER, ONE[:1024], OTHER[:1024], ONE[:16], OTHER[:16], ONE[:15], OTHER[:15]]
    for _ in range(2):  # once learned, once remembered
        assert [x.tolist() for x in encoder(PATH).encode(texts)] == [library.encode(t, add_special_tokens=False).ids for t in texts]


def test_words_of_all_lengths_have_their_own_keys():
    texts = [(a * n)[:k] for n in (1, 2) for k in (1, 7, 8, 9, 15, 16, 17, 63, 64, 65, 200, 1024) for a in (ONE, OTHER)] + ["\0", "\0\0", "a\0", "a"]
    data, offs = textkit.utf8(pa.array(sorted(set(texts)), pa.string()))
    keys, *_ = textkit.words(data, offs)
    assert len(set(keys.tolist())) == len(set(texts))


def test_structured_documents_stay_apart(spark):
    df = spark.createDataFrame([(1, ONE), (2, OTHER), (3, ONE.upper())], "doc_id long, text string")
    assert {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(df).collect()} == {1: 1, 2: 2, 3: 1}


def test_structured_words_are_counted_apart(spark):
    train = [k for k in range(40) if zlib.crc32(str(k).encode()) % 10]
    df = spark.createDataFrame([(k, ONE) for k in train] + [(100, OTHER), (101, ONE)], "doc_id long, text string")
    got = {r["doc_id"]: r["n_known"] for r in classlm.score_texts(df, classlm.train(df, usable=classlm.F.col("doc_id") < 100)).collect()}
    assert got[100] == 1 and got[101] == 2


def test_long_texts_are_cut_between_words(library, monkeypatch):
    monkeypatch.setattr(bpe, "PIECE_BYTES", 300)
    rng = random.Random(5)
    words = ["don't", "a", "été", "中文", "12", "!!", "\n\n", "<|endoftext|>", "　x", "word", "it's"]
    texts = [rng.choice(["", " ", "\n"]).join(rng.choices(words, k=rng.choice([1, 50, 2000]))) for _ in range(12)] + ["x" * 5000, "", " " * 900]
    coder = bpe.Encoder(bpe.vocabulary(PATH).encode_words, bpe.vocabulary(PATH).special)
    assert [x.tolist() for x in coder.encode(texts)] == [library.encode(t, add_special_tokens=False).ids for t in texts]


def test_forgetting_changes_nothing(library, monkeypatch):
    monkeypatch.setattr(bpe, "PIECE_BYTES", 60)
    coder = bpe.Encoder(bpe.vocabulary(PATH).encode_words, bpe.vocabulary(PATH).special, 8, 50)
    texts = ["the cat sat on the mat and the dog sat on the rug " * 5, "a much much longer and uncharacteristically inconsequential matter<|endoftext|>"] * 3
    assert [x.tolist() for x in coder.encode(texts)] == [library.encode(t, add_special_tokens=False).ids for t in texts]


def test_digests_in_slices_equal_those_of_the_whole(monkeypatch):
    vocab = bpe.vocabulary(PATH)
    ids = bpe.encoder(PATH).encode(["中文 \U0001f642 some words of text " * 20])[0]
    whole = bpe._digests(vocab, ids)
    monkeypatch.setattr(bpe, "DIGEST_IDS", 3)
    assert bpe._digests(vocab, ids) == whole


def test_merkle_trees():
    assert len({tokenstore.merkle([b"x"] * n) for n in range(70)}) == 70
    leaves = [bytes([k]) for k in range(9)]
    assert tokenstore.merkle(leaves) != tokenstore.merkle(leaves[::-1])

    def plain(level):
        while len(level) > 1:
            level = [tokenstore._hash(b"\1" + b"".join(level[k : k + 2])) if k + 1 < len(level) else level[k] for k in range(0, len(level), 2)]
        return level[0]

    for n in range(1, 20):
        own = [bytes([k]) for k in range(n)]
        assert tokenstore.merkle(own) == plain([tokenstore._hash(b"\0" + x) for x in own])


def test_chunks_depend_on_content_alone():
    rng = np.random.RandomState(0)
    passage = rng.randint(1, 50000, 6000).astype("<u2")
    one, other = np.concatenate((rng.randint(1, 50000, 777).astype("<u2"), passage)), passage
    stream, offs = np.concatenate((one, other)), np.array([0, len(one), len(one) + len(other)])
    begin, owner = tokenstore.cuts(stream, offs)
    assert begin[0] == 0 and (np.diff(begin) <= tokenstore.MOST).all() and set(owner.tolist()) == {0, 1}
    edges = np.append(begin, len(stream))
    chunks = [[stream[a:b].tobytes() for a, b, o in zip(edges[:-1], edges[1:], owner, strict=True) if o == doc] for doc in (0, 1)]
    assert b"".join(chunks[0]) == one.tobytes() and b"".join(chunks[1]) == other.tobytes()
    assert len(set(chunks[0]) & set(chunks[1])) > len(chunks[1]) / 2
    alone, _ = tokenstore.cuts(other, np.array([0, len(other)]))
    assert (begin[owner == 1] - len(one)).tolist() == alone.tolist()


@pytest.fixture(scope="module")
def store(spark):
    rng = random.Random(1)
    rows = [(k, " ".join(rng.choices(["some", "words", "of", "text", "cat", "dog"], k=400))) for k in range(12)] + [(50, None), (51, "")]
    path = tokenstore.store_path(spark)
    tokenstore.write_store(spark.createDataFrame(rows, "doc_id long, text string"), path, PATH)
    return path


def _copied(spark, store, skip):
    path = tokenstore.store_path(spark)
    for name in {"chunks", "recipes", "manifest"} - {skip}:
        spark.read.parquet(f"{store}/{name}").write.parquet(f"{path}/{name}")
    return path


@pytest.mark.parametrize("read", [tokenstore.read_digests, tokenstore.read_ids])
def test_a_missing_chunk_is_found(spark, store, read):
    path = _copied(spark, store, "chunks")
    spark.read.parquet(f"{store}/chunks").orderBy("chunk_id").offset(1).write.parquet(f"{path}/chunks")
    with pytest.raises(Exception, match="missing|does not match"):
        read(spark, path).collect()


@pytest.mark.parametrize("read", [tokenstore.read_digests, tokenstore.read_ids])
def test_changed_recipes_are_found(spark, store, read):
    path = _copied(spark, store, "recipes")
    spark.read.parquet(f"{store}/recipes").selectExpr("IF(doc_id = 3, 99, doc_id) AS doc_id", "start", "n_tokens", "recipe", "root", "part").write.parquet(f"{path}/recipes")
    with pytest.raises(ValueError, match="manifest"):
        read(spark, path).collect()


def test_a_removed_document_is_found(spark, store):
    path = _copied(spark, store, "recipes")
    spark.read.parquet(f"{store}/recipes").where("doc_id <> 51").write.parquet(f"{path}/recipes")
    with pytest.raises(Exception, match="manifest|gap"):
        tokenstore.read_digests(spark, path).collect()


def test_a_changed_manifest_is_found(spark, store):
    path = _copied(spark, store, "manifest")
    spark.read.parquet(f"{store}/manifest").selectExpr("part", "start", "n_tokens", "documents", "IF(part = -1, cast('x' AS binary), root) AS root").write.parquet(f"{path}/manifest")
    with pytest.raises(ValueError, match="manifest"):
        tokenstore.read_digests(spark, path)
