import base64
import hashlib
import random

import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from panelstat.llm import bpe

MULTI = P.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def plain():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(bpe.RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


PIECES = ["word", "Wörter", "日本語", "12", "x9y", "'s", "'ll", "can't", "!!'re", " ", "  ", "\n", "\r\n", "\t", "\x1c", "\xa0", "　", "​", "<|endoftext|>", "🙂", "é", "\x00"]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.sampled_from(PIECES), st.text(max_size=4)), max_size=60), st.integers(1, 20))
def test_parts_encode_as_the_whole(plain, pieces, size):
    text = "".join(pieces).encode(errors="ignore").decode()
    parts = list(bpe.split(text, size))
    assert "".join(p for p, _ in parts) == text
    assert [i for p, _ in parts for i in plain.encode_ordinary(p)] == plain.encode_ordinary(text)


@pytest.mark.parametrize("tail", ["", "x", " x", "9", "\n", "'s"])
@pytest.mark.parametrize("space", [" ", "\n", " \n", "\t　"])
def test_long_white_space(plain, space, tail):
    for head in ("", "a", "?"):
        text = head + space * bpe.RUN + tail
        assert bpe.encode_text(plain, text) == plain.encode_ordinary(text)


def test_very_long_texts(plain):
    rnd = random.Random(3)
    text = "".join(rnd.choice(PIECES) for _ in range(100_000))
    ids = bpe.encode_text(plain, text)
    assert ids == plain.encode_ordinary(text) and plain.decode_bytes(ids) == text.encode()
    # the regex engine alone overflows on this one
    ids = bpe.encode_text(plain, "a" + " " * 1_000_000 + "b")
    assert plain.decode_bytes(ids) == b"a" + b" " * 1_000_000 + b"b"
    assert ids[:1] + ids[-1:] == plain.encode_ordinary("a") + plain.encode_ordinary(" b")


def test_round_trip(docs, clashing, rows, plain):
    for d in (docs, clashing):
        got = bpe.round_trip(d).collect()
        assert all(bytes(r["data"]).decode() == plain.decode(r["ids"]) for r in got)
        assert sorted((str(r["doc_id"]), r["ids"], bytes(r["data"])) for r in got) == sorted((str(i), plain.encode_ordinary(t or ""), (t or "").encode()) for i, t, *_ in rows)


def test_odd_rows(spark, no_docs, plain):
    assert bpe.round_trip(no_docs).collect() == []
    odd = spark.createDataFrame([(None, "x y"), (None, None), (1, "é" * 5), (1, "é" * 5)], "doc_id long, text string")
    got = bpe.round_trip(odd).collect()
    assert sorted((r["doc_id"] or 0, bytes(r["data"]).decode()) for r in got) == [(0, ""), (0, "x y"), (1, "é" * 5), (1, "é" * 5)]
    ids = spark.createDataFrame([(1, None), (2, []), (3, plain.encode_ordinary("é")[:1]), (4, [188])], "doc_id long, ids array<int>")
    assert {r["doc_id"]: bytes(r["data"]) for r in bpe.decode(ids).collect()} == {1: b"", 2: b"", 3: plain.decode_bytes(plain.encode_ordinary("é")[:1]), 4: b"\x00"}


def test_another_vocabulary(docs):
    got = bpe.round_trip(docs, ranks=MULTI).collect()
    own = bpe.load(open(MULTI, "rb").read(), P.PATTERN)
    assert all(own.encode_ordinary(bytes(r["data"]).decode()) == r["ids"] for r in got)


def test_file_is_bounded(tmp_path):
    (tmp_path / "ranks").write_bytes(b"x" * 20)
    with pytest.raises(ValueError):
        bpe.read_bounded(str(tmp_path / "ranks"), 10)


def test_query(spark, plain):
    from panelstat.llm.catalog import QUERIES

    folder = "/root/testdata/sf0.001"
    texts = {r[0]: r[1] or "" for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()}
    for r in QUERIES["op11_byte_bpe"](spark, folder).collect():
        ids = plain.encode_ordinary(texts[r["doc_id"]])
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()
