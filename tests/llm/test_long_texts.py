"""One text of 20 MB beside ordinary ones, through the eight operators on texts."""

import hashlib
import random
import sys
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
import xxhash

sys.path.insert(0, str(Path(__file__).parent))
import brute  # noqa: E402

from barloom.llm.queries import END_ID, QUERIES, tokenizer_path  # noqa: E402

N_WORDS = 3_300_000


@pytest.fixture(scope="module")
def corpus(tmp_path_factory):
    """(folder, documents, items): the long text shares a passage with a short document and with the benchmark, and names two people's data."""
    draw = random.Random(1)
    words = ["".join(draw.choice("abcdefghij") for _ in range(draw.randint(2, 8))) for _ in range(5000)]
    text = " ".join(draw.choice(words) + "\n" * (k % 12 == 0) for k in range(N_WORDS)) + " mail ann@example.org or call +1 555 123 4567 now"
    assert len(text) >= 20_000_000
    docs = [(1, text, "en", "a"), (2, "the quick brown fox jumps over the lazy dog", "en", "a"), (3, None, None, "b"), (4, text[5000:9000], "de", "b")]
    items = [(1, text[7000:7300]), (2, "nothing like it at all in here")]
    folder = tmp_path_factory.mktemp("long")
    pq.write_table(pa.table(dict(zip(["doc_id", "text", "lang", "source"], map(list, zip(*docs, strict=True)), strict=True))), folder / "documents.parquet")
    pq.write_table(pa.table({"item_id": [1, 2], "text": [t for _, t in items]}), folder / "benchmark.parquet")
    return f"file://{folder}", [(d, t) for d, t, _, _ in docs], items


def result(spark, corpus, name):
    return {r["doc_id"]: r for r in QUERIES[name](spark, corpus[0]).collect()}


def test_token_files(spark, corpus):
    from tokenizers import Tokenizer

    want = brute.op1(corpus[1], Tokenizer.from_file(tokenizer_path()), END_ID)
    assert sorted(tuple(r)[:4] for r in result(spark, corpus, "op1_token_rans").values()) == want


def test_decontamination(spark, corpus):
    assert sorted(tuple(r)[:6] for r in result(spark, corpus, "op2_fm_decontamination").values()) == sorted(brute.op2(corpus[1], corpus[2]))


def test_line_windows(spark, corpus):
    got = result(spark, corpus, "op3_line_windows")
    assert {d: got[d]["n_removed"] for d in got} == {1: 0, 2: 0, 3: 0, 4: got[4]["n_lines"] - 2}  # its first and last lines are cut


def test_fingerprints(spark, corpus):
    w = brute.SPACED.findall(corpus[1][0][1].translate(brute.ASCII_LOWER))
    h = np.array([xxhash.xxh64_intdigest(" ".join(w[k : k + 3]), 42) for k in range(len(w) - 2)], np.uint64)
    bits = sum(1 << b for b in range(64) if 2 * int(((h >> np.uint64(b)) & np.uint64(1)).sum()) > len(h))
    got = result(spark, corpus, "op6_simhash")
    assert got[1]["fingerprint"] == f"{bits:016x}" and [got[d]["component_id"] for d in (1, 2, 3, 4)] == [1, 2, 3, 4]


def test_repeated_passages(spark, corpus):
    got = result(spark, corpus, "op7_fingerprint_index")
    w = {d: brute.SPACED.findall(t or "") for d, t in corpus[1]}
    assert (got[1]["n_words"], got[1]["n_removed"]) == (len(w[1]), 0) and got[1]["kept_sha256"] == hashlib.sha256(" ".join(w[1]).encode()).hexdigest()
    # a word that the cut of the short document halves may start no window of the long one
    assert got[4]["n_words"] - 2 <= got[4]["n_removed"] <= got[4]["n_words"] == len(w[4])


def test_language_and_personal_data(spark, corpus):
    got = result(spark, corpus, "op9_ppm_language")
    assert got[1]["lang_pred"] in ("en", "de") and got[3]["lang_pred"] == "und" and 0 <= got[1]["score"] <= 1
    text = corpus[1][0][1]
    found = result(spark, corpus, "op10_pii_crf")[1]
    at, phone = text.index("ann@"), text.index("+1 555")
    base = f"email:{at}:{at + 15},phone:{phone}:{phone + 15}"
    assert (found["n_email"], found["n_phone"]) == (1, 1) and found["base_sha256"] == hashlib.sha256(base.encode()).hexdigest()


def test_mixing(spark, corpus):
    assert all(r["text_length"] == len(corpus[1][0][1]) for r in QUERIES["op5_poisson_mixing"](spark, corpus[0]).where("doc_id = 1").collect())
