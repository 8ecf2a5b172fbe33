"""Token counts and ids without a shuffle: a broadcast table of frequent units, and a bounded cache in each Python worker."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Units that a worker's cache holds before it starts anew; longer units are encoded each time.
CACHE, LONGEST = 700_000, 64
_TAIL = ".,;:!?"
_TOKENIZERS: dict = {}


def tokenizer(path: str):
    """The tokenizer of a .json file, loaded once a process."""
    if path not in _TOKENIZERS:
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        _TOKENIZERS[path] = Tokenizer.from_file(path)
    return _TOKENIZERS[path]


def plain_tokenizer(path: str):
    """The tokenizer without its normalizer and pattern, for texts of small Latin letters and single spaces, on which they do nothing."""
    if (path, "plain") not in _TOKENIZERS:
        from tokenizers import Tokenizer, pre_tokenizers

        tok = Tokenizer.from_str(tokenizer(path).to_str())
        tok.normalizer = None
        tok.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        _TOKENIZERS[path, "plain"] = tok
    return _TOKENIZERS[path, "plain"]


def vocabulary_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


# Python's \s holds every white-space character of the tokenizers' patterns
_ODD = re.compile(r"\s\s|[^\w\s]{2}|\s[.,]\s|[_\x01-\x04\x1c-\x1f]")
_RAW = "\x04"
_MARKS = {"\x01": ".", "\x02": ","}


def units(text: str) -> list[str]:
    """Names of parts of a text whose byte-level pre-tokens are those of the text; spelled() gives a name's part.

    Parts begin at each lone space between two other characters that are no white space: the pattern lets a pre-token cross neither
    side of such a place. Where no two marks meet, a full stop or comma before white space and the text after a line's end are parts
    too. A name is the part without its leading space, so that names come from one split of the text.
    """
    if _ODD.search(text) or text[0].isspace():
        return [_RAW + x for x in re.split(r"(?<=\S)(?= \S)", text)]
    out = text.replace("\n", " \x03").replace(". ", " \x01 ").replace(", ", " \x02 ").split(" ")
    out[0] = _RAW + out[0]
    return out


def spelled(name: str) -> str:
    if name[:1] == _RAW:
        return name[1:]
    if name[:1] == "\x03":
        return "\n" + name[1:]
    return _MARKS.get(name) or " " + name


_WORD, _SPACED = re.compile(r"[a-z\u00df-\u00f6\u00f8-\u00ff]+"), re.compile(r" [A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+")


def encoded(path: str, wanted: list[str], fold: bool = False) -> list[bytes]:
    """The ids of each unit, as the library gives them for the unit alone, in little-endian unsigned 32-bit numbers.

    Latin words (after a space; with `fold`, in small letters, for a tokenizer that has no others) are pre-tokens of their own, so
    they are encoded many to a call, in a text of words, and cut apart at the library's word numbers. Of other units' tails of
    common marks, a pre-token too, and of the rest each is encoded by itself.
    """
    word = (_WORD if fold else _SPACED).fullmatch
    done = {x: b"" for x in wanted if len(x) <= LONGEST and word(x)}
    split, alone = [], {}
    for x in wanted:
        if x not in done:
            core = x.rstrip(_TAIL)
            if core != x and core and len(core) <= LONGEST and word(core):
                done[core] = b""
                alone[x[len(core) :]] = b""
                split.append((x, core))
            else:
                alone[x] = b""
    tok, some = tokenizer(path), list(done)
    for i in range(0, len(some), 2048):
        part = some[i : i + 2048]
        got = (plain_tokenizer(path) if fold else tok).encode((" " if fold else "").join(part), add_special_tokens=False)
        ids, number = np.array(got.ids, "<u4").tobytes(), np.array(got.word_ids)
        cut = np.concatenate([[0], np.flatnonzero(np.diff(number)) + 1, [len(number)]]) * 4
        if len(cut) != len(part) + 1:
            raise ValueError(f"{path}: not a tokenizer whose pre-tokens are words")
        cut = cut.tolist()
        done.update(zip(part, [ids[a:b] for a, b in zip(cut, cut[1:], strict=False)], strict=True))
    alone.update(zip(list(alone), (np.array(e.ids, "<u4").tobytes() for e in tok.encode_batch(list(alone), add_special_tokens=False)), strict=True))
    for x, core in split:
        done[x] = done[core] + alone[x[len(core) :]]
    return [done[x] if x in done else alone[x] for x in wanted]


class Counter:
    """Token counts of units: a shared frequent table first, then this worker's cache, then the tokenizer, in batches."""

    def __init__(self, path: str, frequent: dict[str, int]):
        self.path, self.frequent, self.seen = path, frequent, dict(frequent)

    def counts(self, texts: list[str | None]) -> list[int]:
        parts = [units(x) if x else [] for x in texts]
        new = list(set().union(*parts).difference(self.seen))
        if new:
            self.seen.update(zip(new, (len(x) // 4 for x in encoded(self.path, [spelled(x) for x in new])), strict=True))
        get = self.seen.__getitem__
        out = [sum(map(get, x)) for x in parts]
        for x in new:
            if len(x) > LONGEST:
                del self.seen[x]
        if len(self.seen) - len(self.frequent) > CACHE:
            self.seen = dict(self.frequent)
        return out


def frequent_units(path: str) -> dict[str, int]:
    """unit -> token count for each entry of the vocabulary that is a word after a space; as many as the vocabulary has at most."""
    tok = tokenizer(path)
    texts = [x for x in (tok.decode([i]) for i in range(tok.get_vocab_size())) if x[:1] == " " and x[1:].isalpha()]
    return dict(zip((x[1:] for x in texts), (len(e.ids) for e in tok.encode_batch(texts, add_special_tokens=False)), strict=True))


_TABLES: dict = {}


def _frequent(spark: SparkSession, path: str):
    """The broadcast frequent table of a vocabulary: at most its size in entries (about 50,000, under 2 MB)."""
    key = (spark.sparkContext.applicationId, path)
    if key not in _TABLES:
        _TABLES[key] = spark.sparkContext.broadcast(frequent_units(path))
    return _TABLES[key]


_WORKER: dict = {}


def token_counts(docs: DataFrame, path: str, limit: int = 512, text: str = "text") -> DataFrame:
    """(doc_id, text, ...) -> (doc_id, n_bytes, n_tokens, over_limit), a row per row of docs; no shuffle.

    `path` is a byte-level tokenizer file that every worker can read. Special strings inside texts count as the library's default
    has it. Null texts count as empty; texts are counted whole and of any length; repeated rows each keep their row; an empty
    table gives an empty result; other columns of docs are not used.
    """
    table = _frequent(docs.sparkSession, path)

    @F.arrow_udf("long")
    def count(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = _WORKER.get(path)
        if own is None:
            own = _WORKER[path] = Counter(path, table.value)
        for batch in texts:
            out: list[int] = []
            for k in range(0, len(batch), 512):
                out += own.counts(batch.slice(k, 512).to_pylist())
            yield pa.array(out, pa.int64())

    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select("doc_id", F.octet_length(body).cast("long").alias("n_bytes"), count(body).alias("n_tokens"))
    return rows.withColumn("over_limit", F.col("n_tokens") > limit)
