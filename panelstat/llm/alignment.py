"""Alignment of two tokenizers: which tokens of one cover the same bytes as which tokens of the other.

A text is encoded by both, and every token has an end, the number of bytes up to and with it. The ends of each side
go into a dictionary from end to index; the ends that both dictionaries have, sorted, cut both lists of ids into
groups. Within a group every token of one side is linked to every token of the other.

Long texts are encoded in parts. A part begins with a space that follows a printing character (ASCII or Latin, and
one follows the spaces), and both tokenizers end a token there: the first splits such places before it merges, and
no piece of the second holds a space after another character, which is checked when it is loaded.

If the merges of the first vocabulary are in the order of their ids, rank by rank they are what the tiktoken library applies,
several times as fast; it encodes the texts whose characters are all below U+0250, where no version of Unicode moves letters, numbers or
white space. All other texts, and other vocabularies, are encoded by the tokenizers library.

Corpus counts: every block of texts has its distinct pairs with the number of documents that hold them; these
rows, one for each block and pair however often the pair occurs, are summed by pair, the highest sum of each first id is
found, and every block gets the figures of its own pairs back. No table of all pairs is sent to a task.

Defined cases: a text that is null or empty, or whose tokens do not give back its bytes, has no tokens: zeros and an empty ``groups``.
Equal rows, also of one doc_id, are documents of their own; null ids stay. Other columns of the input are left out.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import public_tokenizers
import sentencepiece
import tiktoken
import tokenizers
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from panelstat.llm.bpe import encode_text, read_bounded
from panelstat.llm.common import cut

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
PIECE_BPE = public_tokenizers.path("piece_bpe_32k.model")
BLOCK, CHUNK = 8 << 20, 1 << 20  # bytes of the texts of a block, and of those that are aligned at a time
PART, LARGE = 1 << 16, 1 << 12  # characters of a part; links of a group whose pairs are counted instead of written out

# printing characters that no version of Unicode counts as white space
_PRINT = r"!-~\u00a1-\u024f"
_BREAK = re.compile(f"(?<=[{_PRINT}])(?= +[{_PRINT}])")
_WIDE = re.compile(r"[^\x00-\u024f]")
_HEX = re.compile(r"<0x([0-9A-F]{2})>")


def byte_letters() -> dict[str, int]:
    """The letter that byte-level vocabularies write for each byte: itself if it prints, else the next letter from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


def split(text: str, size: int = PART) -> list[str]:
    """The text after a space, in parts that both tokenizers encode apart as in the whole."""
    text, at, out = " " + text, 0, []
    while len(text) - at > size:
        found = _BREAK.search(text, at + size)
        if not found:
            break
        out.append(text[at: found.start()])
        at = found.start()
    return [*out, text[at:]]


class Aligned(NamedTuple):
    """Texts aligned: tokens of both, groups, links and the groups as text of each; and their distinct pairs, row by row, in ascending order."""

    figures: np.ndarray
    groups: list[str]
    row: np.ndarray
    code: np.ndarray
    times: np.ndarray


class Aligner:
    """Two tokenizers. A pair of ids is one number, ``a * n_pieces + b``."""

    def __init__(self, byte_bpe: str, piece_bpe: bytes):
        if json.loads(byte_bpe).get("normalizer"):
            raise ValueError("the byte-level vocabulary must not normalise texts")
        self.a = tokenizers.Tokenizer.from_str(byte_bpe)
        self.a.encode_special_tokens = True
        letters = byte_letters()
        names = [self.a.id_to_token(i) or "" for i in range(self.a.get_vocab_size(with_added_tokens=True))]
        self.a_bytes = [bytes(letters[c] for c in x) if all(c in letters for c in x) else x.encode() for x in names]
        self.ranked = self._ranked(json.loads(byte_bpe), self.a_bytes)
        self.b = sentencepiece.SentencePieceProcessor(model_proto=piece_bpe)
        self.n_pieces = self.b.vocab_size()
        pieces = [self.b.id_to_piece(i) for i in range(self.n_pieces)]
        if any("\u2581" in p.lstrip("\u2581") for p in pieces):
            raise ValueError("a piece holds a space after another character")
        self.b_bytes = [bytes([int(_HEX.fullmatch(p)[1], 16)]) if self.b.is_byte(i) else p.replace("\u2581", " ").encode() for i, p in enumerate(pieces)]
        self.a_len, self.b_len = (np.array([len(x) for x in y], np.int64) for y in (self.a_bytes, self.b_bytes))
        # every id as text with what may follow it: another of its side, the other side, the next group
        ids = [str(i) for i in range(max(len(names), self.n_pieces))]
        self.shown = [f"{i}{end}" for end in (",", "|", ";") for i in ids]
        self.n_ids = len(ids)

    @staticmethod
    def _ranked(vocabulary: dict, tokens: list[bytes]) -> tiktoken.Encoding | None:
        """The merges as ranks, if they are in the order of their ids and the texts are split by the plain pattern."""
        split_by = vocabulary.get("pre_tokenizer") or {}
        ids, merges = vocabulary["model"]["vocab"], vocabulary["model"]["merges"]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in merges]
        if split_by.get("type") != "ByteLevel" or split_by.get("add_prefix_space") or not split_by.get("use_regex", True):
            return None
        if [ids.get(x + y) for x, y in pairs] != list(range(256, 256 + len(pairs))) or sorted(tokens[:256]) != [bytes([b]) for b in range(256)]:
            return None
        ranks = {tokens[i]: i for i in range(256 + len(pairs))}
        return tiktoken.Encoding("local", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(self, texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """The ids of each text by both; none if they do not stand for its bytes."""
        parts = [split(t) if t else [] for t in texts]
        plain = [self.ranked is not None and not _WIDE.search(t) for t in texts]
        by_a = iter(self.a.encode_batch_fast([p for own, known in zip(parts, plain, strict=True) if not known for p in own], add_special_tokens=False))
        by_b = iter(self.b.encode([p[1:] for own in parts for p in own], num_threads=1))
        for own, known in zip(parts, plain, strict=True):
            by_part = [(encode_text(self.ranked, p) if known else next(by_a).ids, next(by_b)) for p in own]
            a, b = by_part[0] if len(by_part) == 1 else ([i for x, _ in by_part for i in x], [i for _, x in by_part for i in x])
            a, b, raw = np.array(a, np.int64), np.array(b, np.int64), "".join(own).encode()
            # tokens of bytes can leave some out, but never change one
            same = self.a_len[a].sum() == len(raw) and b"".join(map(self.b_bytes.__getitem__, b.tolist())) == raw
            yield (a, b) if same else (a[:0], b[:0])

    def cuts(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How many ids of each side there are up to the end of each group."""
        ends_a = dict(zip(np.cumsum(self.a_len[a]).tolist(), range(1, len(a) + 1), strict=True))
        ends_b = dict(zip(np.cumsum(self.b_len[b]).tolist(), range(1, len(b) + 1), strict=True))
        common = sorted(ends_a.keys() & ends_b.keys())
        return tuple(np.fromiter(map(ends.__getitem__, common), np.int64, len(common)) for ends in (ends_a, ends_b))

    def align(self, texts: list[str]) -> Aligned:
        ids_a, ids_b, cuts_a, cuts_b, figures = [], [], [], [], []
        for a, b in self.encode(texts):
            x, y = self.cuts(a, b)
            figures.append((len(a), len(b), len(x), 0))
            for whole, own in ((ids_a, a), (ids_b, b), (cuts_a, x), (cuts_b, y)):
                whole.append(own)
        figures = np.array(figures, np.int64).reshape(-1, 4)
        a, b = (np.concatenate([*x, np.zeros(0, np.int64)]) for x in (ids_a, ids_b))
        before = np.cumsum(figures, axis=0) - figures
        # ends and sizes of all groups in the ids of all texts
        row = np.repeat(np.arange(len(texts)), figures[:, 2])
        end_a, end_b = (np.concatenate([*x, np.zeros(0, np.int64)]) + before[row, k] for k, x in enumerate((cuts_a, cuts_b)))
        n_a, n_b = np.diff(end_a, prepend=0), np.diff(end_b, prepend=0)
        np.add.at(figures[:, 3], row, n_a * n_b)
        return Aligned(figures, self._texts(figures, a, b, end_a, end_b, n_a, n_b), *self._pairs(row, a, b, end_a - n_a, end_b - n_b, n_a, n_b))

    def _texts(self, figures, a, b, end_a, end_b, n_a, n_b) -> list[str]:
        """Of each text its groups as ``a1,a2|b1;a3|b2,b3``: ids of A and B in order."""
        group = np.arange(len(n_a))
        seq = np.empty(len(a) + len(b), np.int64)
        side, other = a.copy(), b.copy()
        side[end_a - 1] += self.n_ids
        other[end_b - 1] += 2 * self.n_ids
        seq[np.arange(len(a)) + (end_b - n_b)[np.repeat(group, n_a)]] = side
        seq[np.arange(len(b)) + end_a[np.repeat(group, n_b)]] = other
        at = np.append(0, np.cumsum(figures[:, 0] + figures[:, 1]))
        return ["".join(map(self.shown.__getitem__, seq[x:y].tolist()))[:-1] for x, y in zip(at[:-1], at[1:], strict=True)]

    def _pairs(self, row, a, b, at_a, at_b, n_a, n_b) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, code, times) of the distinct pairs linked in each text."""
        size = n_a * n_b
        plain = np.flatnonzero(size <= LARGE)
        group = np.repeat(plain, size[plain])
        place = np.arange(len(group)) - np.repeat(np.cumsum(size[plain]) - size[plain], size[plain])
        codes = a[at_a[group] + place // n_b[group]] * self.n_pieces + b[at_b[group] + place % n_b[group]]
        span = len(self.a_bytes) * self.n_pieces  # rows of a chunk times this stay far below 64 bits
        keys = np.sort(row[group] * span + codes)
        at = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else keys
        keys, times = keys[at], np.diff(np.append(at, len(keys)))
        for g in np.flatnonzero(size > LARGE):
            # a long run that the two cut out of step is one group
            x, n = np.unique(a[at_a[g]: at_a[g] + n_a[g]], return_counts=True)
            y, m = np.unique(b[at_b[g]: at_b[g] + n_b[g]], return_counts=True)
            more = np.concatenate([keys, row[g] * span + np.add.outer(x * self.n_pieces, y).ravel()])
            n = np.concatenate([times, np.multiply.outer(n, m).ravel()])
            keys, which = np.unique(more, return_inverse=True)
            times = np.zeros(len(keys), np.int64)
            np.add.at(times, which, n)
        return keys // span, keys % span, times


DOCS = "_block long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups string, _pairs binary, _times binary, _kind string, _codes binary, _docs binary"


def _chunks(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Rows of about CHUNK bytes of text, or one row."""
    size = np.asarray(pc.fill_null(pc.binary_length(texts), 0), np.int64)
    at = np.cumsum(size + 100) // CHUNK
    edges = np.flatnonzero(np.append(True, at[1:] != at[:-1])) if len(at) else at
    yield from zip(edges.tolist(), [*edges[1:].tolist(), len(at)], strict=True)


def _block(number: int, ids: list[pa.Array], aligned: list[Aligned]) -> Iterator[pa.RecordBatch]:
    """The rows of a block's documents, their pairs as numbers of the block's distinct ones, and a row of these."""
    codes = np.unique(np.concatenate([x.code for x in aligned]))
    pairs = np.concatenate([np.searchsorted(codes, x.code) for x in aligned]).astype(np.int32)
    docs, done = np.bincount(pairs, minlength=len(codes)).astype(np.int64), 0
    kind = np.min_scalar_type(max((int(x.times.max()) for x in aligned if len(x.times)), default=0))
    names = [x.split()[0] for x in DOCS.split(", ")]
    for own, x in zip(ids, aligned, strict=True):
        n = len(own)
        at = np.searchsorted(x.row, np.arange(n + 1))
        both = [[y[i:j].tobytes() for i, j in zip(at[:-1], at[1:], strict=True)] for y in (pairs[done: done + len(x.code)], x.times.astype(kind))]
        done += len(x.code)
        yield pa.RecordBatch.from_arrays([
            pa.array(np.full(n, number)), own, *[pa.array(c) for c in x.figures.T], pa.array(x.groups, pa.string()), *[pa.array(c, pa.binary()) for c in both],
            pa.array([kind.str] * n, pa.string()), pa.nulls(n, pa.binary()), pa.nulls(n, pa.binary()),
        ], names=names)
    last = [number, None, 0, 0, 0, 0, None, None, None, None, codes.tobytes(), docs.tobytes()]
    types = [pa.int64()] * 6 + [pa.string()] + [pa.binary()] * 2 + [pa.string()] + [pa.binary()] * 2
    yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(last, types, strict=True)], names=names)


def _aligned(sent):
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        if "aligner" not in own:
            own["aligner"] = Aligner(own["byte_bpe"], own["piece_bpe"])
        number, size, ids, aligned = TaskContext.get().partitionId() << 32, 0, [], []
        for b in batches:
            for first, end in _chunks(b.column(1)):
                texts = [x.as_py() or "" for x in b.column(1)[first:end]]
                ids.append(b.column(0)[first:end])
                aligned.append(own["aligner"].align(texts))
                size += sum(map(len, texts)) + 100 * len(texts)
                if size >= BLOCK:
                    yield from _block(number, ids, aligned)
                    number, size, ids, aligned = number + 1, 0, [], []
        if size:
            yield from _block(number, ids, aligned)

    return each


def _block_pairs(n_pieces: int):
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for block, codes, docs in zip(*b.columns, strict=True):
                codes, docs = np.frombuffer(codes.as_py(), np.int64), np.frombuffer(docs.as_py(), np.int64)
                for at in range(0, len(codes), 1 << 16):
                    own = codes[at: at + (1 << 16)]
                    yield pa.RecordBatch.from_arrays([
                        pa.array(np.full(len(own), block.as_py())), pa.array(np.arange(at, at + len(own), dtype=np.int32)),
                        pa.array((own // n_pieces).astype(np.int32)), pa.array((own % n_pieces).astype(np.int32)), pa.array(docs[at: at + (1 << 16)]),
                    ], names=["_block", "_k", "a", "b", "n"])

    return each


def _joined(keep: list[str]):
    """Documents of one block and the figures of its pairs: the links of each document."""

    def join(docs: pa.Table, known: pa.Table) -> pa.Table:
        n, best = np.zeros(known.num_rows, np.int64), np.zeros(known.num_rows, np.int64)
        if known.num_rows:
            k = np.asarray(known["_k"].combine_chunks(), np.int64)
            n[k], best[k] = (np.asarray(known[c].combine_chunks(), np.int64) for c in ("n", "best"))
        sums, bests = [], []
        for pairs, times, kind in zip(docs["_pairs"], docs["_times"], docs["_kind"], strict=True):
            at = np.frombuffer(pairs.as_py(), np.int32)
            times = np.frombuffer(times.as_py(), kind.as_py()).astype(np.int64)
            sums.append(int(times @ n[at]))
            bests.append(int(times @ best[at]))
        return docs.select(keep).append_column("n_best", pa.array(bests, pa.int64())).append_column("count_sum", pa.array(sums, pa.int64()))

    return join


def groups(docs: DataFrame, byte_bpe: str = BYTE_BPE, piece_bpe: str = PIECE_BPE) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, groups) of every row; groups as ``a1,a2|b1;a3|b2,b3``: ids of A and B in order."""
    return _stage(docs, byte_bpe, piece_bpe).filter("_codes is null").select("doc_id", "n_a", "n_b", "n_groups", "n_links", "groups")


def _stage(docs: DataFrame, byte_bpe: str, piece_bpe: str) -> DataFrame:
    sent = docs.sparkSession.sparkContext.broadcast({"byte_bpe": read_bounded(byte_bpe).decode(), "piece_bpe": read_bounded(piece_bpe)})
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_aligned(sent), DOCS)


def align(docs: DataFrame, derived: dict[str, Column] | None = None, byte_bpe: str = BYTE_BPE, piece_bpe: str = PIECE_BPE) -> tuple[DataFrame, DataFrame]:
    """The alignment of every row, and the links of the corpus.

    First: doc_id, n_a, n_b, n_groups, n_links, n_best (links whose pair is in as many documents as any pair of its id of
    A), count_sum (over the links, the documents that hold the pair) and the ``derived`` columns, expressions
    over these (but the last two) and ``groups``. The groups themselves, several times as long as the text, are kept only if derived.
    Second: (a, b, n, best), every linked pair of ids with the number of documents that hold it, and whether no other pair of
    ``a`` has more.
    """
    n_pieces = sentencepiece.SentencePieceProcessor(model_file=piece_bpe).vocab_size()
    staged = _stage(docs, byte_bpe, piece_bpe)
    derived = derived or {}
    staged = cut(staged.select(*[c for c in staged.columns if c != "groups" and c not in derived], *[c.alias(name) for name, c in derived.items()]), "alignment")
    own = cut(staged.filter("_codes is not null").select("_block", "_codes", "_docs").mapInArrow(_block_pairs(n_pieces), "_block long, _k int, a int, b int, n long"), "alignment-pairs")
    counts = own.groupBy("a", "b").agg(F.sum("n").alias("n"))
    highest = counts.groupBy("a").agg(F.max("n").alias("_most"))
    counts = cut(counts.join(highest, "a").select("a", "b", "n", (F.col("n") == F.col("_most")).alias("best")), "alignment-counts")
    known = own.drop("n").join(counts, ["a", "b"]).select("_block", "_k", "n", F.col("best").cast("long").alias("best"))
    docs = staged.filter("_codes is null").drop("_codes", "_docs")
    keep = [c for c in docs.columns if c not in ("_block", "_pairs", "_times", "_kind")]
    schema = StructType([docs.schema[c] for c in keep]).add("n_best", "long").add("count_sum", "long")
    return docs.groupBy("_block").cogroup(known.groupBy("_block")).applyInArrow(_joined(keep), schema), counts
