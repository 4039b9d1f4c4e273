"""Byte-level BPE encoding and decoding with the tiktoken library and a local rank file.

Long texts are taken apart before they are encoded, at places that no match of the pattern can lie across, so
that neither the regex engine nor the merges ever see a very long text. Such places are, for the default pattern:
before white space that follows something else, and between ASCII letters and digits. A long run of white space
is a match of its own but for its last character, and is merged as one piece without the regex, whose look-ahead
would need a stack as long as the run. One unbroken run of letters stays one piece: it is one match.

The rank file is read by the driver and sent to the tasks (50,000 ranks are less than 1 MB; ``MOST_BYTES`` bounds it).

Defined cases: a null or empty text has no ids, null or no ids decode to no bytes. Rows are independent: equal rows, null ids
and rows without doc_id stay as they are. Strings that look like special tokens are ordinary text.
"""

from __future__ import annotations

import base64
import re
from array import array
from collections.abc import Iterator

import pyarrow as pa
import public_tokenizers
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
PART, RUN = 1 << 16, 1 << 12  # characters of a part, and of white space that comes alone
MOST_BYTES, IDS = 1 << 26, 1 << 20  # bytes of a rank file; ids in a batch of rows

# the characters that \s of the pattern matches (Unicode White_Space)
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_RUN = re.compile(f"[{SPACE}]{{{RUN},}}")
_SAFE = re.compile(f"(?<=[^{SPACE}])(?=[{SPACE}])|(?<=[A-Za-z])(?=[0-9])|(?<=[0-9])(?=[A-Za-z])")


def _cuts(text: str, at: int, end: int, size: int) -> Iterator[str]:
    while end - at > size:
        safe = _SAFE.search(text, at + size, end)
        if not safe:
            break
        yield text[at: safe.start()]
        at = safe.start()
    if at < end:
        yield text[at:end]


def split(text: str, size: int = PART) -> Iterator[tuple[str, bool]]:
    """The text in parts that can be encoded apart, and whether a part is one match (a long run of white space)."""
    at = 0
    for run in _RUN.finditer(text):
        yield from ((part, False) for part in _cuts(text, at, run.start(), size))
        # the last of the run belongs to what follows, if anything does
        at = run.end() - (run.end() < len(text))
        yield text[run.start(): at], True
    yield from ((part, False) for part in _cuts(text, at, len(text), size))


def load(raw: bytes, pattern: str) -> tiktoken.Encoding:
    ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, raw.splitlines())}
    return tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def encode_text(encoding: tiktoken.Encoding, text: str) -> list[int]:
    if len(text) <= RUN:
        return encoding.encode_ordinary(text)
    ids: list[int] = []
    for part, alone in split(text):
        ids += encoding._encode_single_piece(part) if alone else encoding.encode_ordinary(part)
    return ids


def read_bounded(path: str, most: int = MOST_BYTES) -> bytes:
    """A vocabulary file of at most ``most`` bytes, to be sent to the tasks."""
    with open(path, "rb") as f:
        raw = f.read(most + 1)
    if len(raw) > most:
        raise ValueError(f"{path} has more than {most} bytes")
    return raw


def _encoding(sent) -> tiktoken.Encoding:
    """Made once in a Python worker and kept beside what was sent."""
    own = sent.value
    if "encoding" not in own:
        own["encoding"] = load(own["raw"], own["pattern"])
    return own["encoding"]


def _send(df: DataFrame, ranks: str, pattern: str):
    return df.sparkSession.sparkContext.broadcast({"raw": read_bounded(ranks), "pattern": pattern})


def encode(docs: DataFrame, ranks: str = RANKS, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """(doc_id, ids) of every row of ``docs`` (doc_id, text)."""
    sent = _send(docs, ranks, pattern)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = _encoding(sent)
        for b in batches:
            ids, ends, first = array("i"), array("i", [0]), 0
            for row, text in enumerate(b.column(1)):
                ids.extend(encode_text(encoding, text.as_py() or ""))
                ends.append(len(ids))
                if len(ids) >= IDS or row + 1 == b.num_rows:
                    lists = pa.ListArray.from_arrays(pa.array(memoryview(ends), pa.int32()), pa.array(memoryview(ids), pa.int32()))
                    yield pa.RecordBatch.from_arrays([b.column(0).slice(first, len(lists)), lists], names=["doc_id", "ids"])
                    ids, ends, first = array("i"), array("i", [0]), row + 1

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(each, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, ranks: str = RANKS, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """(doc_id, ids, data): the bytes that the ids of every row stand for. They need not be UTF-8."""
    sent = _send(encoded, ranks, pattern)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = _encoding(sent)
        for b in batches:
            for first in range(0, b.num_rows, 64):
                own = b.slice(first, 64)
                data = [encoding.decode_bytes(x.values.to_numpy().tolist() if x.is_valid else []) for x in own.column(1)]
                yield pa.RecordBatch.from_arrays([*own.columns, pa.array(data, pa.binary())], names=["doc_id", "ids", "data"])

    return encoded.select("doc_id", "ids").mapInArrow(each, "doc_id long, ids array<int>, data binary")


def round_trip(docs: DataFrame, ranks: str = RANKS, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """(doc_id, ids, data) of every row: its ids, and the bytes that these decode to."""
    return decode(encode(docs, ranks, pattern), ranks, pattern)
