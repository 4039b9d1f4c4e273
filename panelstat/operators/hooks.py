"""Pluggable steps: embedding texts, answering work lists and parsing answers.

The callables are the user's own and run inside Spark tasks; nothing here talks to a service.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def embed(items: DataFrame, embedder: Callable[[list[str]], list[list[float]]], key: Column, text: Column, batch_size: int = 64) -> DataFrame:
    """(case_id, embedding) of every item (F1, F2): ``key`` and ``text`` are expressions over it.

    The embedder gets lists of texts and returns as many vectors in the same order.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            vectors: list = []
            for lo in range(0, len(pdf), batch_size):
                texts = pdf["text"].iloc[lo : lo + batch_size].tolist()
                got = embedder(texts)
                if len(got) != len(texts):
                    raise ValueError(f"embedder returned {len(got)} vectors for {len(texts)} texts")
                vectors.extend([[float(x) for x in v] for v in got])
            yield pd.DataFrame({"case_id": pdf["case_id"], "embedding": vectors})

    chosen = items.select(key.cast("string").alias("case_id"), text.alias("text"))
    return chosen.mapInPandas(run, "case_id string, embedding array<float>")


def respond(work: DataFrame, responder: Callable[[pd.DataFrame], list]) -> DataFrame:
    """Answers to a work list (F4): (case_id, rater, run, response_text).

    The responder gets a frame and returns one text or None per row; rows without an answer are left
    out and stay pending, so running the work list again is the retry.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            answers = list(responder(pdf))
            if len(answers) != len(pdf):
                raise ValueError("one answer per row is needed")
            out = pdf[["case_id", "rater", "run"]].assign(response_text=answers)
            yield out[out["response_text"].notna()]

    types = {f.name: f.dataType.simpleString() for f in work.schema.fields}
    schema = f"case_id {types['case_id']}, rater {types['rater']}, run {types['run']}, response_text string"
    return work.mapInPandas(run, schema)


def mentioned_choice(response, choice_1, choice_2) -> Column:
    """Rule-based choice of a free answer (F3 default).

    The exact option text, else which of the two options is mentioned by text or number; an answer
    that mentions both or neither is a refusal when it declines, else unknown (NULL).
    """
    r, a, b = (F.lower(F.trim(F.col(c) if isinstance(c, str) else c)) for c in (response, choice_1, choice_2))
    one = F.contains(r, a) | r.rlike(r"\b(choice|option) 1\b")
    two = F.contains(r, b) | r.rlike(r"\b(choice|option) 2\b")
    declines = r.rlike(r"\b(refuse|decline|cannot recommend|neither)\b")
    return (
        F.when(r == a, "choice_1").when(r == b, "choice_2").when(one & ~two, "choice_1").when(two & ~one, "choice_2")
        .when(declines, "REFUSAL")
    )


def parse_choices(answers: DataFrame, parser: Callable[[pd.DataFrame], list] | None = None) -> DataFrame:
    """Answers with ``parsed_choice`` (F3); input has response_text, choice_1 and choice_2.

    A user's parser gets a frame and returns choice_1, choice_2, REFUSAL or None per row; anything
    else fails the job. Unparsed rows keep NULL.
    """
    if parser is None:
        return answers.withColumn("parsed_choice", mentioned_choice("response_text", "choice_1", "choice_2"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            got = list(parser(pdf))
            bad = {g for g in got if g is not None} - {"choice_1", "choice_2", "REFUSAL"}
            if bad:
                raise ValueError(f"unknown choices {sorted(bad)}")
            yield pdf.assign(parsed_choice=pd.Series(got, index=pdf.index, dtype=object))

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in answers.schema.fields)
    return answers.mapInPandas(run, f"{fields}, parsed_choice string")


def hashing_embedder(size: int = 32) -> Callable[[list[str]], list[list[float]]]:
    """A deterministic embedder of hashed words, for tests."""
    import hashlib

    def embed_texts(texts: list[str]) -> list[list[float]]:
        out = []
        for t in texts:
            v = [0.0] * size
            for w in t.lower().split():
                h = int(hashlib.md5(w.encode()).hexdigest()[:8], 16)
                v[h % size] += 1.0
            out.append(v)
        return out

    return embed_texts
