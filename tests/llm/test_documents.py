"""Operators on documents against brute force, on the small table and on hard cases."""

import random
import sys
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

sys.path.insert(0, str(Path(__file__).parent))
import brute  # noqa: E402

from barloom.llm import decontamination, language_id, mixing, simhash, token_output  # noqa: E402
from barloom.llm.queries import END_ID, QUERIES, tokenizer_path  # noqa: E402


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def documents(spark, texts):
    """With extra columns whose names clash with the operators' own."""
    schema = "doc_id long, text string, lang string, source string, score double, row string, copy int, n_words string"
    return spark.createDataFrame([(k, t, None, "s", 0.5, "r", 7, "x") for k, t in enumerate(texts)], schema)


def hard_texts():
    r = random.Random(3)
    vocabulary = ["alpha", "Beta", "gam", "é", "ü1", "x-y", "9"]
    long = " ".join(r.choice(vocabulary) for _ in range(3000))
    passage = " ".join(f"w{k}" for k in range(40))
    texts = [None, "", " ", "one", "one", "two words", "A B C", "a b c", "...", "\n\n", long, long, long + " tail", passage]
    texts += [f"start {k} {passage} end {k}" for k in range(6)]
    texts += [" ".join(r.choice(vocabulary) for _ in range(r.randrange(1, 60))) for _ in range(40)]
    texts += ["w5 w6 w7 w8 w9 w10 w11 w12 w13 w14 w15 w16 w17", "<|endoftext|> x <|ENDOFTEXT|>", "don't İstanbul ΟΔΟΣ 10²", "a b c\x1cd", "日本語 text é é"]
    return texts


@pytest.fixture(scope="module")
def hard(spark):
    return documents(spark, hard_texts()).cache()


@pytest.fixture(scope="module")
def small(spark, small_dir):
    return spark.read.parquet(f"{small_dir}/documents.parquet").select("doc_id", "text").collect()


def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path())


def test_tokens_match_on_the_small_table(spark, small_dir, small):
    assert rows(QUERIES["op1_token_rans"](spark, small_dir)) == sorted(brute.op1(small, tokenizer(), END_ID), key=repr)


def test_tokens_of_hard_texts_come_back(spark, hard):
    path = token_output.token_archive(hard, tokenizer_path(), END_ID)
    got = token_output.read_documents(spark, path, with_ids=True).orderBy("doc_id").collect()
    want = brute.op1(list(enumerate(hard_texts())), tokenizer(), END_ID)
    assert [tuple(r)[:4] for r in got] == want
    ids = tokenizer().encode(hard_texts()[10], add_special_tokens=False).ids
    assert got[10]["ids"] == [*ids, END_ID]


def test_tokens_of_repeated_null_and_no_documents(spark):
    schema = "doc_id long, text string"
    least = -(1 << 63)
    twice = spark.createDataFrame([(1, "a"), (1, "a"), (None, "b"), (0, None), (least, "c")], schema)
    got = token_output.read_documents(spark, token_output.token_archive(twice, tokenizer_path(), END_ID)).orderBy("start").collect()
    assert [(r["doc_id"], r["start"], r["n_tokens"]) for r in got] == [(None, 0, 2), (least, 2, 2), (0, 4, 1), (1, 5, 2), (1, 7, 2)]
    hot = [(7, f"w{k}") for k in range(300)] + [(None, f"x{k} y") for k in range(300)] + [(k, "z z z") for k in range(100)]
    got = token_output.read_documents(spark, token_output.token_archive(spark.createDataFrame(hot, schema), tokenizer_path(), END_ID)).orderBy("start").collect()
    assert len(got) == 700 and [r["doc_id"] is None for r in got] == [True] * 300 + [False] * 400
    assert all(a["start"] + a["n_tokens"] == b["start"] and (a["doc_id"] or 0) <= b["doc_id"] for a, b in zip(got, got[1:]) if b["doc_id"] is not None)
    empty = spark.createDataFrame([], schema)
    assert token_output.read_documents(spark, token_output.token_archive(empty, tokenizer_path(), END_ID)).count() == 0


def test_chunks_are_encoded_as_the_tokenizer_does():
    import public_tokenizers

    r = random.Random(4)
    texts = ["".join(r.choice("aZé.,|'stİ \n9<\u0301日") for _ in range(r.randrange(0, 30))) for _ in range(3000)]
    long = " ".join(r.choice(["ab", "cdé", "don't", "x|y", "|"]) for _ in range(700_000))
    for name in ("word_bpe_49k.json", "byte_bpe_50k.json"):
        encoder = token_output.ChunkEncoder(public_tokenizers.path(name))
        assert encoder.by_chunk == (name == "word_bpe_49k.json")
        assert [len(x) for x in encoder.encode([long[:200_000], ""])][1] == 0
        for got, text in zip(encoder.encode(texts), texts, strict=True):
            assert np.frombuffer(got, encoder.kind).tolist() == encoder.tokenizer.encode(text, add_special_tokens=False).ids, text
        if encoder.by_chunk:
            assert np.frombuffer(encoder.encode([long])[0], encoder.kind).tolist() == encoder.tokenizer.encode(long, add_special_tokens=False).ids


def test_a_damaged_block_is_noticed():
    import numpy as np

    from barloom.llm import rans

    table = rans.Table(rans.scaled(np.array([5, 0, 1, 100])))
    block = token_output.pack(7, 0, [1, 2], [np.array([0, 3, 3], "<u4"), np.array([2], "<u4")], table)
    first, unnamed, docs, sizes, ids = token_output.unpack(block, table)
    assert (first, unnamed, docs.tolist(), sizes.tolist(), ids.tolist()) == (7, 0, [1, 2], [3, 1], [0, 3, 3, 2])
    with pytest.raises(ValueError):
        token_output.unpack(block[:100] + bytes([block[100] ^ 1]) + block[101:], table)


def test_rans_round_trip_of_random_lanes():
    import numpy as np

    from barloom.llm import rans

    r = np.random.default_rng(1)
    counts = r.integers(0, 50, 2000) ** 3
    table = rans.Table(rans.scaled(counts))
    lengths = r.integers(0, 300, 97)
    lanes = np.zeros((97, 300), np.uint32)
    for k, n in enumerate(lengths):
        lanes[k, :n] = r.choice(2000, n, p=counts / counts.sum())
    got = rans.decode(table, *rans.encode(table, lanes, lengths), lengths)
    assert (got == lanes[:, : got.shape[1]]).all()
    one = rans.Table(rans.scaled(np.array([0, 9])))
    assert (rans.decode(one, *rans.encode(one, np.ones((3, 5), np.uint32), np.array([5, 0, 3])), np.array([5, 0, 3]))[0] == 1).all()


def test_decontamination_matches_on_the_small_table(spark, small_dir, small):
    items = spark.read.parquet(f"{small_dir}/benchmark.parquet").select("item_id", "text").collect()
    assert rows(QUERIES["op2_fm_decontamination"](spark, small_dir)) == sorted(brute.op2(small, items), key=repr)


@pytest.mark.parametrize("block_bytes", [1 << 20, 40_000])
def test_decontamination_of_hard_texts(spark, hard, block_bytes):
    items = [(1, " ".join(f"w{k}" for k in range(40))), (2, "one"), (3, None), (4, "..."), (5, "alpha beta"), (6, hard_texts()[10]), (7, "w3 w4 w5")]
    table = spark.createDataFrame(items, "item_id long, text string")
    found = decontamination.contamination(hard, table, block_bytes=block_bytes).withColumn("n_hit", decontamination.hit_words())
    got = {(r["doc_id"], r["n_words"], r["n_hit"], ",".join(sorted(r["items"]))) for r in found.collect()}
    import hashlib

    want = brute.op2(list(enumerate(hard_texts())), items)
    assert {(d, n, h, hashlib.sha256(i.encode()).hexdigest()) for d, n, h, i in got} == {w[:3] + (w[4],) for w in want}


def test_decontamination_judges_each_row_at_any_block_size(spark):
    """Repeated and missing ids, in one block and in many."""
    passage = " ".join(f"w{k}" for k in range(30))
    docs = [(1, passage), (1, "x y"), (None, passage + " end"), (None, None), (2, "so " + passage)]
    items = spark.createDataFrame([(k, " ".join(f"w{n}" for n in range(k, k + 14))) for k in range(8)] + [(99, "q r s")], "item_id long, text string")
    table = spark.createDataFrame(docs, "doc_id long, text string")
    got = []
    for block_bytes in (1 << 24, 300):
        found = decontamination.contamination(table, items, block_bytes=block_bytes)
        got.append(sorted((str(r["doc_id"]), r["n_words"], [(s["start"], s["end"]) for s in r["spans"]], r["items"]) for r in found.collect()))
    ids = [str(k) for k in range(8)]
    assert got[0] == got[1] == sorted([("1", 30, [(0, 21)], ids), ("1", 2, [], []), ("None", 31, [(0, 21)], ids), ("None", 0, [], []), ("2", 31, [(1, 22)], ids)])


def test_decontamination_without_items_or_documents(spark, hard):
    none = spark.createDataFrame([], "item_id long, text string")
    assert all(not r["spans"] for r in decontamination.contamination(hard, none).collect())
    assert decontamination.contamination(hard.limit(0), spark.createDataFrame([(1, "one two")], "item_id long, text string")).count() == 0


def test_simhash_matches_on_the_small_table(spark, small_dir, small):
    assert rows(QUERIES["op6_simhash"](spark, small_dir)) == sorted(brute.op6(small), key=repr)


def test_simhash_of_hard_texts(spark, hard):
    found = simhash.near_duplicates(hard)
    got = sorted((r["doc_id"], f"{r['fp'] & (1 << 64) - 1:016x}", r["component_id"]) for r in found.collect())
    assert got == brute.op6(list(enumerate(hard_texts())))
    assert simhash.near_duplicates(hard.limit(0)).count() == 0


def test_any_five_positions_hold_one_of_the_sets():
    from itertools import combinations

    sets = simhash.position_sets()
    assert len(set(sets)) == 14 and all(len(x) == 4 for x in sets)
    assert all(any(set(x) <= set(five) for x in sets) for five in combinations(range(8), 5))


def test_every_pair_within_three_bits_is_joined(spark):
    r = random.Random(5)
    fps = {r.getrandbits(64) for _ in range(60)}
    for f in list(fps)[:30]:  # chains of one to four flips
        for _ in range(4):
            for b in r.sample(range(64), r.randrange(1, 5)):
                f ^= 1 << b
            fps.add(f)
    fps = sorted(x - (1 << 64) if x >> 63 else x for x in fps)
    edges = simhash.links(spark.createDataFrame([(x,) for x in fps], "fp long")).collect()
    near = [(x, y) for x in fps for y in fps if x < y and bin((x ^ y) & (1 << 64) - 1).count("1") <= 3]
    assert brute.components(fps, [tuple(e) for e in edges]) == brute.components(fps, near)
    base = np.uint64(r.getrandbits(64))
    wide = np.unique(base ^ np.array([sum(1 << (24 + b) for b in r.sample(range(40), r.randrange(0, 5))) for _ in range(300)], np.uint64))
    close = np.unique(base ^ np.array([sum(1 << (8 + b) for b in r.sample(range(24), r.randrange(0, 9))) for _ in range(400)], np.uint64))
    for dense in (wide, close):  # members that agree in three and in five positions
        pairs = [(a, b) for a in range(len(dense)) for b in range(a) if bin(int(dense[a] ^ dense[b])).count("1") <= 3]
        for limit in (10, 10_000):
            i, j = simhash.spanning_forest(dense, limit)
            assert brute.components(range(len(dense)), list(zip(i.tolist(), j.tolist(), strict=True))) == brute.components(range(len(dense)), pairs)


def test_simhash_of_repeated_and_missing_ids(spark):
    rows_ = [(1, "a b c d"), (1, "x y z u v w"), (None, "a b c d"), (2, "x y z u v w"), (None, "only me here")]
    got = simhash.near_duplicates(spark.createDataFrame(rows_, "doc_id long, text string"))
    assert sorted((r["doc_id"] or 0, r["component_id"] or 0) for r in got.collect()) == [(0, 0), (0, 1), (1, 1), (1, 1), (2, 1)]


def test_language_accuracy_on_held_out_documents(spark):
    folder = "/root/testdata/sf0.01"
    truth = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "lang").collect()}
    got = [r for r in QUERIES["op9_ppm_language"](spark, folder).collect() if r["held_out"]]
    assert len(got) > 150
    assert sum(r["lang_pred"] == truth[r["doc_id"]] for r in got) / len(got) > 0.95
    assert all(0 <= r["score"] <= 1 for r in got)


def test_language_of_hard_texts(spark, hard):
    model = language_id.train(documents(spark, ["the and of that", "le la les que", None]).withColumn("lang", F.when(F.col("doc_id") == 0, "en").when(F.col("doc_id") == 1, "fr")))
    got = language_id.predict(hard, model).select("row.*", "lang_pred", F.col("row.score").alias("own")).collect()
    assert len(got) == len(hard_texts())
    assert all(r["own"] == 0.5 for r in got)
    for r in got:
        letters = any(c.isalpha() for c in r["text"] or "")
        assert (r["lang_pred"] == "und") == (not letters)
    none = language_id.train(hard.limit(0))
    assert {r["lang_pred"] for r in language_id.predict(hard, none).collect()} == {"und"}


def test_query_gives_the_code_lengths_of_plain_trees(spark):
    """The predictions of whole texts against trees in dictionaries, one context at a time: escapes with exclusion."""
    r = random.Random(8)
    words = {"xx": ["ab", "ba", "aab", "é"], "yy": ["ab", "cc", "cab", "ñ"], "zz": ["b", "ab a", "\u0430"]}
    rows_ = [(k, None if k % 29 == 7 else " ".join(r.choice(words[lang]) for _ in range(r.randrange(0, 12))), lang) for k in range(90) for lang in [r.choice(list(words))]]
    rows_ += [(200, "²½①", "xx"), (201, "A", "yy"), (202, "\x00\xff q", None), (203, "ab", None)]
    docs = spark.createDataFrame(rows_, "doc_id long, text string, lang string")
    got = {x["doc_id"]: x for x in language_id.identify(docs).select("row.doc_id", "held_out", "lang_pred", "score").collect()}
    import zlib

    trees = {}
    for doc, text, lang in rows_:
        if text is not None and lang is not None and zlib.crc32(str(doc).encode()) % 5:
            data = b"   " + text.encode()
            for i in range(3, len(data)):
                for o in range(4):
                    node = trees.setdefault(lang, {}).setdefault(data[i - o : i], {})
                    node[data[i]] = node.get(data[i], 0) + 1
    for doc, text, _ in rows_:
        assert got[doc]["held_out"] == (zlib.crc32(str(doc).encode()) % 5 == 0)
        if text is None or not any(map(str.isalpha, text)):
            assert (got[doc]["lang_pred"], got[doc]["score"]) == ("und", 0)
            continue
        data = b"   " + text.encode()
        bits = {lang: sum(plain_bits(tree, data[i - 3 : i], data[i]) for i in range(3, len(data))) for lang, tree in trees.items()}
        best = min(bits.values())
        assert bits[got[doc]["lang_pred"]] <= best + 0.1
        assert abs(got[doc]["score"] - 1 / sum(2 ** (best - b) for b in bits.values())) < 0.02


def plain_bits(tree, context, byte):
    import math

    p, excluded = 1.0, set()
    for o in range(3, -1, -1):
        node = {b: n for b, n in tree.get(context[3 - o :], {}).items() if b not in excluded}
        total, q = sum(node.values()), len(node)
        if byte in node:
            return -math.log2(p * node[byte] / (total + q))
        if q:
            p *= q / (total + q)
        excluded |= set(node)
    return -math.log2(p / (256 - len(excluded)))


def test_every_label_is_learned_and_ties_go_by_name(spark):
    rows_ = [(k, f"{chr(0x4e00 + k % 150)}{chr(0x5e00 + k % 150)}", f"l{k % 150:03d}") for k in range(900)]
    docs = spark.createDataFrame(rows_, "doc_id long, text string, lang string")
    found = language_id.identify(docs).select("row.lang", "lang_pred").collect()
    assert all(x["lang"] == x["lang_pred"] for x in found)
    same = spark.createDataFrame([(k, "same words", x) for k, x in enumerate(["b", "a", "c"] * 20)], "doc_id long, text string, lang string")
    model = language_id.train(same.where("doc_id < 3"))
    assert {x["lang_pred"] for x in language_id.predict(same, model).collect()} == {"a"}


def test_a_long_text_is_added_up_piece_by_piece(monkeypatch):
    tree = language_id.Tree(*np.unique(language_id._grams(np.frombuffer(b"the cat and the dog", np.uint8), np.array([0, 19])), return_counts=True))
    raw = np.frombuffer(b"the dog and a cat, the end of it" * 9, np.uint8)
    offsets = np.array([0, 0, 5, 90, 90, 91, len(raw)])
    model = language_id.Model(["x"], [tree])
    whole = language_id.total_lengths(model, raw, offsets)
    for size in (1, 7, 64):
        monkeypatch.setattr(language_id, "SLICE_BYTES", size)
        assert np.allclose(language_id.total_lengths(model, raw, offsets), whole)


def test_poisson_draws(spark, hard):
    rates = [(k, 0.25 + 3.1 * (k % 9)) for k in range(4000)]
    df = spark.createDataFrame(rates, "k long, rate double").withColumn("u", mixing.uniform(F.col("k"), 1)).withColumn("n", mixing.poisson(F.least("rate", F.lit(8.0)), F.col("u")))
    import math

    total = want = 0.0
    for r in df.collect():
        rate = min(r["rate"], 8.0)
        term = total_p = math.exp(-rate)
        k = 0
        while r["u"] >= total_p:
            k += 1
            term *= rate / k
            total_p += term
        assert r["n"] == k
        total, want = total + k, want + rate
    assert abs(total / want - 1) < 0.03


def test_mixing_keeps_rows_whole_and_repeats_itself(spark, hard):
    rates = spark.createDataFrame([("s", 20.5)], "source string, rate double")
    one, two = (mixing.replicate(hard, rates=rates).select("row.*", F.col("copy").alias("number"), "place").collect() for _ in range(2))
    assert sorted(map(tuple, one), key=repr) == sorted(map(tuple, two), key=repr)
    assert abs(len(one) / (20.5 * len(hard_texts())) - 1) < 0.2
    none = spark.createDataFrame([], T.StructType(hard.schema.fields))
    assert mixing.replicate(none).count() == 0
    assert mixing.replicate(hard.withColumn("source", F.lit(None).cast("string"))).count() > 0


@pytest.mark.parametrize("key", ["doc_id", "none"])
def test_a_language_of_one_long_text_is_learned(spark, key):
    long = " ".join(["the", "word", "that", "which"] * 20_000)
    rows = [(k, None, "der die das und ein nicht " * 5, "de") for k in range(40)] + [(k, None, None, "en") for k in range(40, 43)] + [(44, None, long, "en"), (45, None, long, "en")]
    docs = spark.createDataFrame(rows, "doc_id long, none long, text string, lang string")
    for seed in range(8):
        model = language_id.train(docs, key=key, bytes_per_language=2000, seed=seed)
        sizes = {name: int(tree.counts[0].sum()) for name, tree in zip(model.languages, model.trees, strict=True)}
        assert sizes["de"] > 0 and 0 < sizes["en"] <= 2 * max(2000, language_id.LEAST_BYTES) + len(long), sizes
