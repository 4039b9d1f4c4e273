import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
import sentencepiece
import tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from panelstat.llm import alignment

PIECES = ["word", " the", "Wörter", " ﬁ", "日本語", " 12", "x9y", "'s", " ", "  ", "\n", "\r\n ", "\t", "\xa0", "　", "​", "<|endoftext|>", "<s>", "<0x0A>", "🙂", "é", "é", "\x00", "\x1c", " \x85"]


class Plain:
    """Whole texts by the two libraries, byte by byte."""

    def __init__(self):
        self.a = tokenizers.Tokenizer.from_file(alignment.BYTE_BPE)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=alignment.PIECE_BPE)
        letters = alignment.byte_letters()
        self.name = {i: bytes(letters[c] for c in t) for t, i in self.a.get_vocab().items() if i != 50256}

    def groups(self, text):
        if not text:
            return []
        raw = (" " + text).encode()
        a = [(i, self.name[i]) for i in self.a.encode(" " + text, add_special_tokens=False).ids]
        b = [(i, bytes([int(self.b.id_to_piece(i)[3:5], 16)]) if self.b.is_byte(i) else self.b.id_to_piece(i).replace("▁", " ").encode()) for i in self.b.encode(text)]
        if b"".join(x for _, x in a) != raw or b"".join(x for _, x in b) != raw:
            return []
        out, own, at = [], ([], []), [0, 0]
        sides = [list(a), list(b)]
        while sides[0] or sides[1]:
            k = 0 if at[0] <= at[1] else 1
            i, x = sides[k].pop(0)
            own[k].append(i)
            at[k] += len(x)
            if at[0] == at[1]:
                out.append(own)
                own = ([], [])
        return out


@pytest.fixture(scope="module")
def plain():
    return Plain()


@pytest.fixture(scope="module")
def aligner():
    return alignment.Aligner(open(alignment.BYTE_BPE).read(), open(alignment.PIECE_BPE, "rb").read())


def shown(groups):
    return ";".join(f"{','.join(map(str, a))}|{','.join(map(str, b))}" for a, b in groups)


def brute(plain, texts):
    """Per text (n_a, n_b, n_groups, n_links, n_best, count_sum, groups)."""
    all_groups = [plain.groups(t) for t in texts]
    links = [Counter((i, j) for a, b in g for i in a for j in b) for g in all_groups]
    n = Counter(p for x in links for p in x)
    most = defaultdict(int)
    for (i, _), c in n.items():
        most[i] = max(most[i], c)
    return [(sum(len(a) for a, _ in g), sum(len(b) for _, b in g), len(g), sum(x.values()), sum(c for p, c in x.items() if n[p] == most[p[0]]), sum(c * n[p] for p, c in x.items()), shown(g)) for g, x in zip(all_groups, links)], n


def pairs_of(aligner, got):
    return [Counter({(c // aligner.n_pieces, c % aligner.n_pieces): n for r, c, n in zip(got.row.tolist(), got.code.tolist(), got.times.tolist()) if r == i}) for i in range(len(got.groups))]


@settings(max_examples=300, deadline=None)
@given(st.text(st.characters(max_codepoint=0x24F), max_size=80))
def test_both_engines_agree(plain, aligner, text):
    assert aligner.ranked is not None
    assert alignment.encode_text(aligner.ranked, text) == plain.a.encode(text, add_special_tokens=False).ids


def test_engines_agree_on_documents(spark, plain, aligner):
    texts = [" " + r[0] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect() if r[0] and not alignment._WIDE.search(r[0])]
    assert len(texts) > 500
    assert [alignment.encode_text(aligner.ranked, t) for t in texts] == [x.ids for x in plain.a.encode_batch(texts, add_special_tokens=False)]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.one_of(st.sampled_from(PIECES), st.text(max_size=4)), max_size=40), max_size=4))
def test_as_whole_texts(plain, aligner, texts):
    texts = ["".join(pieces).encode(errors="ignore").decode() for pieces in texts]
    got = aligner.align(texts)
    want = [plain.groups(t) for t in texts]
    assert got.groups == [shown(g) for g in want]
    links = [Counter((i, j) for a, b in g for i in a for j in b) for g in want]
    assert pairs_of(aligner, got) == links
    assert got.figures.tolist() == [[sum(len(a) for a, _ in g), sum(len(b) for _, b in g), len(g), sum(x.values())] for g, x in zip(want, links)]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.sampled_from(PIECES), st.text(max_size=4)), max_size=60), st.integers(1, 20))
def test_parts_encode_as_the_whole(plain, pieces, size):
    text = "".join(pieces).encode(errors="ignore").decode()
    parts = alignment.split(text, size)
    assert "".join(parts) == " " + text
    assert [i for p in parts for i in plain.a.encode(p, add_special_tokens=False).ids] == plain.a.encode(" " + text, add_special_tokens=False).ids
    assert [i for p in parts for i in plain.b.encode(p[1:])] == plain.b.encode(text)


def test_other_space_mark_has_no_tokens(plain, aligner):
    got = aligner.align(["a \u2581b", "\u2581"])
    assert got.groups == ["", ""] and not got.figures.any() and plain.groups("\u2581") == []


def test_long_run_out_of_step(aligner):
    got = aligner.align(["?" * 100_003, "a"])
    sizes = [[side.count(",") + 1 for side in g.split("|")] for g in got.groups[0].split(";")]
    assert got.figures[0].tolist() == [*np.sum(sizes, 0).tolist(), len(sizes), sum(a * b for a, b in sizes)]
    assert got.figures[0, 3] == got.times[got.row == 0].sum() > 100_000_000 and (got.row == 0).sum() < 100


def collected(docs):
    out, counts = alignment.align(docs, {"groups": F.col("groups")})
    return [tuple(r) for r in out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups").collect()], counts


def test_as_brute_force(docs, clashing, rows, plain):
    want, n = brute(plain, [t for _, t, *_ in rows])
    for d in (docs, clashing):
        got, counts = collected(d)
        assert sorted(map(str, got)) == sorted(str((r[0], *w)) for r, w in zip(rows, want))
        assert {(r["a"], r["b"]): r["n"] for r in counts.collect()} == dict(n)


def test_many_blocks(spark, plain, monkeypatch):
    rnd = random.Random(5)
    texts = ["".join(rnd.choice(PIECES + [f" w{rnd.randint(0, 50)}" for _ in range(20)]) for _ in range(rnd.randint(0, 60))) for _ in range(120)]
    texts += ["x" * 3000, " " * 3000, "ab " * 3000, None, ""]
    monkeypatch.setattr(alignment, "BLOCK", 700)
    monkeypatch.setattr(alignment, "CHUNK", 300)
    monkeypatch.setattr(alignment, "LARGE", 3)
    got, _ = collected(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3))
    want, _ = brute(plain, texts)
    assert sorted(got) == [(i, *w) for i, w in enumerate(want)]


def test_odd_rows(spark, no_docs, plain):
    assert collected(no_docs)[0] == []
    odd = [(None, "a b"), (None, None), (1, "a b"), (1, "a b"), (2, ""), (3, "a ▁")]
    got, _ = collected(spark.createDataFrame(odd, "doc_id long, text string"))
    want, _ = brute(plain, [t for _, t in odd])
    assert sorted(map(str, got)) == sorted(str((i, *w)) for (i, _), w in zip(odd, want))
    assert alignment.groups(spark.createDataFrame(odd, "doc_id long, text string")).count() == 6


def test_query(spark, plain):
    from panelstat.llm.catalog import QUERIES

    folder = "/root/testdata/sf0.001"
    texts = dict(tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect())
    want, _ = brute(plain, list(texts.values()))
    cols = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    got = [tuple(r) for r in QUERIES["op13_token_alignment"](spark, folder).select(*cols).collect()]
    assert sorted(got) == sorted((i, *w[:-1], hashlib.sha256(w[-1].encode()).hexdigest() if w[-1] else "") for i, w in zip(texts, want))
