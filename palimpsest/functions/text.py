"""Text predicates, normalisations, similarities and time codes as Column expressions."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: White space of Python's str.strip, beyond \s: stated as a class for the JVM's regular expressions.
SPACE = r"[\s\x{1c}-\x{1f}\x{85}\p{Z}]"


def stripped(text: Column) -> Column:
    return F.regexp_replace(text, f"^{SPACE}+|{SPACE}+$", "")


def is_blank(text: Column) -> Column:
    return F.coalesce(stripped(text), F.lit("")) == ""


def is_logo(text: Column) -> Column:
    """One or two capitals and nothing else."""
    return stripped(text).rlike(r"\A[A-Z]{1,2}\z")


def without_spaces(text: Column) -> Column:
    return F.replace(text, F.lit(" "), F.lit(""))


def alphanumeric(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9A-Za-z]", "")


def within_charset(text: Column, charset: str) -> Column:
    """Other characters removed; case folded first if the charset has letters of one case only."""
    if charset.lower() == charset:
        text = F.lower(text)
    elif charset.upper() == charset:
        text = F.upper(text)
    keep = "".join("\\" + c if not c.isalnum() and ord(c) < 128 else c for c in charset)
    return F.regexp_replace(text, f"[^{keep}]", "")


def common_subsequence(a: Column, b: Column) -> Column:
    """Length of the longest common subsequence, row by row with two nested folds; for short strings."""
    chars = lambda s: F.filter(F.split(s, ""), lambda c: c != "")
    bs = chars(b)

    def row(prev: Column, ca: Column) -> Column:
        start = F.struct(F.array(F.lit(0)).alias("row"), F.lit(1).alias("j"))
        step = lambda acc, cb: F.struct(
            F.concat(acc["row"], F.array(F.when(ca == cb, F.element_at(prev, acc["j"]) + 1).otherwise(F.greatest(F.element_at(prev, acc["j"] + 1), F.element_at(acc["row"], -1))))).alias("row"),
            (acc["j"] + 1).alias("j"),
        )
        return F.aggregate(bs, start, step, lambda acc: acc["row"])

    return F.element_at(F.aggregate(chars(a), F.array_repeat(F.lit(0), F.size(bs) + 1), row), -1)


def ratio(a: Column, b: Column) -> Column:
    """2 LCS / (|a| + |b|) of lower-cased texts without spaces; 1 for two blanks. Equal texts skip the fold."""
    a, b = F.lower(without_spaces(a)), F.lower(without_spaces(b))
    total = F.length(a) + F.length(b)
    return F.when(a == b, F.lit(1.0)).otherwise(F.lit(2.0) * common_subsequence(a, b) / total)


def edit_distance(a: Column, b: Column) -> Column:
    """Levenshtein distance over the longer length; 0 for two empty texts."""
    return F.coalesce(F.try_divide(F.levenshtein(a, b).cast("double"), F.greatest(F.length(a), F.length(b)).cast("double")), F.lit(0.0))


def srt_time(seconds: Column) -> Column:
    """HH:MM:SS,mmm, every part truncated."""
    s = seconds.cast("double")
    part = s % 60
    return F.format_string("%02d:%02d:%02d,%03d", F.floor(s / 3600), F.floor((s % 3600) / 60), F.floor(part), F.floor((part - F.floor(part)) * 1000))


def display_width(text: Column) -> Column:
    """Length less half (rounded up) of the count of ASCII letters, digits and white space."""
    narrow = F.length(text) - F.length(F.regexp_replace(text, r"[A-Za-z0-9\s]", ""))
    return F.length(text) - F.ceil(narrow / 2.0)


def reversed_runs(text: Column) -> Column:
    """Right-to-left order: runs of ASCII letters, digits and ` :*./%+-` stay, their order and single others' is reversed."""
    return F.array_join(F.reverse(F.regexp_extract_all(text, F.lit(r"([a-zA-Z0-9 :*./%+\-]+|[^a-zA-Z0-9 :*./%+\-])"), F.lit(1))), "")


def truth(text: Column) -> Column:
    return F.lower(text).isin("true", "t", "1")


def integers(text: Column) -> Column:
    return F.transform(F.split(text, ","), lambda x: F.trim(x).try_cast("int"))


def file_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def stem(path: Column) -> Column:
    return F.regexp_replace(file_name(path), r"(?<=.)\.[^.]*$", "")


@F.arrow_udf(StringType())
def _ascii(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for batch in texts:
        plain = (None if t is None else unicodedata.normalize("NFKD", t).encode("ascii", "ignore").decode() for t in batch.to_pylist())
        yield pa.array([None if t is None else "".join(t.split()) for t in plain], pa.string())


def ascii_folded(text: Column) -> Column:
    """ASCII characters of the compatibility decomposition, without white space. Texts that are ASCII already stay in the JVM."""
    return F.when(text.rlike(r"\A\p{ASCII}*\z"), F.regexp_replace(text, r"[\s\x{1c}-\x{1f}]", "")).otherwise(_ascii(text))


def clock(at: Column | None = None) -> Column:
    """A moment, or that of the query, as `2024-05-01 13:45:30.123456`."""
    return F.date_format(F.current_timestamp() if at is None else at, "yyyy-MM-dd HH:mm:ss.SSSSSS")
