"""Decoding of heads whose classes are pieces of words: byte-level pairs and word pieces. The vocabulary is a list of texts by id."""

from __future__ import annotations

from collections.abc import Iterator
from math import prod

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

# The spaces that joined word pieces lose, in this order.
TIGHT = ((" .", "."), (" ?", "?"), (" !", "!"), (" ,", ","), (" ' ", "'"), (" n't", "n't"), (" 'm", "'m"), (" 's", "'s"), (" 've", "'ve"), (" 're", "'re"))
END = "[SEP]"


def pairs_text(steps: list[tuple[int, float]], table: list[str], end: str = "#") -> tuple[str, float]:
    """Texts of the steps before the end's, and the product of their probabilities."""
    n = next((k for k, (i, _) in enumerate(steps) if table[i] == end), len(steps))
    return "".join(table[i] for i, _ in steps[:n]), prod(p for _, p in steps[:n])


def pieces_text(steps: list[tuple[int, float]], table: list[str]) -> tuple[str, float]:
    """Word pieces joined up to END, and the product of the probabilities up to and with it. Without END the last character, and the last
    step's probability, do not count; nothing left has confidence 0."""
    text = " ".join(table[i] for i, _ in steps).replace(" ##", "")
    for a, b in TIGHT:
        text = text.replace(a, b)
    n = next((k + 1 for k, (i, _) in enumerate(steps) if table[i] == END), max(len(steps) - 1, 0))
    return text[: text.find(END)], prod(p for _, p in steps[:n]) if n else 0.0


def decoded(path: Column, table: list[str], kind: str) -> Column:
    """array<struct<id, p>> -> struct<text, conf>, of `pairs` or of word `pieces`. The first step is a start symbol; ids out of the vocabulary
    are left out."""
    read = {"pairs": pairs_text, "pieces": pieces_text}[kind]

    @F.arrow_udf("struct<text:string,conf:double>")
    def run(paths: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in paths:
            got = [read([(s["id"], s["p"]) for s in (one or [])[1:] if 0 <= s["id"] < len(table)], table) for one in batch.to_pylist()]
            yield pa.StructArray.from_arrays([pa.array([g[0] for g in got], pa.string()), pa.array([float(g[1]) for g in got], pa.float64())], ["text", "conf"])

    return run(path)
