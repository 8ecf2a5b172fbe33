"""Quality rules with thresholds from mergeable quantile sketches per language and source."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import chain
from math import isqrt

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .shared import Written, bounded, same, written

# Fixed values of the base rule.
SYMBOLS = b"#*$%&|<>"
MIN_WORDS, REPEAT_PERCENT, WINDOW = 10, 20, 5
SPACE = b" \t\n\r\x0b\x0c"
UPPER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: ASCII marks: what is neither letter, digit nor space.
MARKS = bytes(c for c in range(33, 127) if not chr(c).isalnum())
#: A word is an echo if it is one of this many words before it.
ECHO = 8
#: Greatest bin of a sketch.
TOP = 10_000

#: metric -> whether a low value is odd as well as a high one, and what a single event comes to in a text of one word (of five characters):
#: marks and capitals in thousandths of the characters, echoes in thousandths of the words, hundredths of characters a word.
METRICS = {"mark": (False, 200), "upper": (False, 200), "echo": (False, 1000), "length": (True, 100)}
#: What is sketched: the metrics, and the root of the number of words, rounded down.
SKETCHED = (*METRICS, "root")
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
_FEATURES = StructType([StructField(c, LongType()) for c in (*COUNTS, *SKETCHED)])


def repeated_words(words: list, window: int = WINDOW) -> int:
    """How many words lie in a window of `window` words that is found twice or more."""
    if len(words) <= window:
        return 0
    grams = list(zip(*(words[i:] for i in range(window)), strict=False))
    if len(set(grams)) == len(grams):
        return 0
    times, covered, upto = Counter(grams), 0, 0
    for i, g in enumerate(grams):
        if times[g] > 1:
            covered += i + window - max(i, upto)
            upto = i + window
    return covered


def echoes(words: list) -> int:
    """How many words are among the ECHO words before them."""
    last: dict = {}
    n = 0
    for i, w in enumerate(words):
        if i - last.get(w, -ECHO - 1) <= ECHO:
            n += 1
        last[w] = i
    return n


def features(text: str | None) -> tuple[int, ...]:
    """The counts of COUNTS, then the values of SKETCHED (rounded down, TOP at most)."""
    text = text or ""
    raw = text.encode()
    words = raw.split()
    n, chars = len(words), len(text) - (len(raw) - len(raw.translate(None, SPACE)))
    lines = [x for x in raw.split(b"\n") if x and not x.isspace()]
    symbols, marks, upper = (len(raw) - len(raw.translate(None, x)) for x in (SYMBOLS, MARKS, UPPER))
    per = lambda a, b: min(a // max(b, 1), TOP)
    values = (per(1000 * marks, chars), per(1000 * upper, chars), per(1000 * echoes(words), n), per(100 * chars, n), min(isqrt(n), TOP))
    return n, chars, symbols, len(lines) - len(set(lines)), repeated_words(words), *values


@F.arrow_udf(_FEATURES)
def _features(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
    names = (*COUNTS, *SKETCHED)
    for batch in texts:
        flat = list(chain.from_iterable(features(x.as_py()) for x in batch))
        yield pa.StructArray.from_arrays([pa.array(flat[i :: len(names)], pa.int64()) for i in range(len(names))], list(names))


def sketches(measured: DataFrame) -> DataFrame:
    """(lang, source, f) -> (lang, source, metric, bin, n): for each group and sketched value a histogram of whole numbers.

    Histograms of parts add up to the histogram of the whole, so they merge in any order (within map tasks first, and from sources
    to a language and to all below), and a quantile read from them is exact to a bin. A group has at most TOP + 1 bins a value;
    no group's rows are brought together.
    """
    rows = measured.select("lang", "source", F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(f"f.{m}").alias("bin")) for m in SKETCHED])).alias("x"))
    return rows.groupBy("lang", "source", "x.metric", "x.bin").agg(F.count(F.lit(1)).alias("n"))


def quartiles(sketch: DataFrame, by: list[str], prefix: str) -> DataFrame:
    """(…by, metric, bin, n) -> (…by, metric, n rows, quartiles 1, 2, 3, spreads above and below), all named with the prefix, from merged
    sketches. The spread above the middle is read from the quarter below it, and the other way round, so that up to half of a group
    may be odd before its middle moves; it is one bin and a sixteenth of the middle more, so a group of equal texts has a spread too."""
    merged = sketch.groupBy(*by, "metric", "bin").agg(F.sum("n").alias("n"))
    group = Window.partitionBy(*by, "metric")
    upto = F.sum("n").over(group.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0))
    at = merged.withColumn("upto", upto).withColumn("size", F.sum("n").over(group))
    quartile = lambda k: F.min(F.when(F.col("upto") * 4 >= F.col("size") * k, F.col("bin"))).alias(f"{prefix}{k}")
    q = at.groupBy(*by, "metric").agg(F.first("size").alias(f"{prefix}n"), *[quartile(k) for k in (1, 2, 3)])
    spread = [F.expr(f"{prefix}{hi} - {prefix}{lo} + 1 + {prefix}2 div 16").alias(f"{prefix}{side}") for side, hi, lo in (("above", 2, 1), ("below", 3, 2))]
    return q.select(*[F.col(c).alias(f"{prefix}{c}") for c in (*by, "metric")], f"{prefix}n", *[f"{prefix}{k}" for k in (1, 2, 3)], *spread)


def thresholds(measured: DataFrame, prior: int = 20) -> DataFrame:
    """(lang, source, f) -> (lang, source, and of each sketched value a struct (low, below, high, above)), a row per pair of language
    and source: the group's middle and its spread to either side.

    Quartiles and spreads of a pair of n documents are weighed by n against `prior` documents' worth of its language's, and those of a
    language so against the whole table's. A group's middle and spread go beyond its language's only so far: the middle to the
    outer quartile and a spread, the spread to twice.
    """
    sketch = Written(sketches(measured))
    own, lang, every = quartiles(sketch.df, ["lang", "source"], "o"), quartiles(sketch.df, ["lang"], "l"), quartiles(sketch.df, [], "e")
    rows = own.join(lang, same(own["olang"], lang["llang"]) & (own["ometric"] == lang["lmetric"])).join(every, F.col("ometric") == F.col("emetric"))
    for a, b in ("le", "ol"):
        rows = rows.withColumns({f"{a}{k}": F.expr(f"({a}n * {a}{k} + {prior} * {b}{k}) div ({a}n + {prior})") for k in (1, 2, 3, "above", "below")})
    limit = F.struct(
        F.greatest("o2", F.col("l1") - F.col("lbelow")).alias("low"), F.least("obelow", 2 * F.col("lbelow")).alias("below"), F.least("o2", F.col("l3") + F.col("labove")).alias("high"), F.least("oabove", 2 * F.col("labove")).alias("above")
    )
    out = written(rows.groupBy(F.col("olang").alias("lang"), F.col("osource").alias("source")).pivot("ometric", list(SKETCHED)).agg(F.first(limit)))
    sketch.drop()
    return out


def judged(measured: DataFrame, reach: int = 8, prior: int = 20) -> DataFrame:
    """(…, lang, source, f) -> the same with booleans __base_failed and __kept.

    A value may be `reach` spreads from the middle of its group, a single event in the group's middle text counted into the spread; in a
    text of fewer words than that one, whose values vary more by chance, further by the root of the ratio.
    """
    limits = thresholds(measured, prior)
    limits = bounded(limits.select(F.col("lang").alias("__lang"), F.col("source").alias("__source"), *[F.col(m).alias(f"__{m}") for m in SKETCHED]))
    rows = measured.join(limits, same(measured["lang"], limits["__lang"]) & same(measured["source"], limits["__source"]), "left")
    n = F.col("f.n_words")
    failed = (n < MIN_WORDS) | (100 * F.col("f.n_repeat_words") > REPEAT_PERCENT * n)
    rows = rows.withColumn("__size", F.greatest(F.lit(1), F.col("__root.low") * F.col("__root.low")))
    beyond = lambda by, spread: (by > 0) & (by * by * n > reach * reach * spread * spread * F.greatest(n, F.col("__size")))
    odd = F.lit(False)
    for m, (both, one) in METRICS.items():
        event = F.expr(f"{one} div __size")
        odd = odd | beyond(F.col(f"f.{m}") - F.col(f"__{m}.high"), F.col(f"__{m}.above") + event)
        if both:
            odd = odd | beyond(F.col(f"__{m}.low") - F.col(f"f.{m}"), F.col(f"__{m}.below") + event)
    return rows.withColumn("__base_failed", failed).withColumn("__kept", ~failed & ~odd).drop("__lang", "__source", "__size", *[f"__{m}" for m in SKETCHED])


def quality(docs: DataFrame, reach: int = 8, prior: int = 20) -> DataFrame:
    """(doc_id, text, lang, source, ...) -> (doc_id, the five counts, base_failed, kept), a row per row of docs.

    Words are runs other than \\x20 and \\x09-\\x0D of the whole text. A null text has no words and fails. Null languages and
    sources are groups of their own. Repeated rows count as often as they come. An empty table gives an empty result; other
    columns of docs are not used. Texts are read once; the numbers read from them are a written table.
    """
    measured = written(docs.select("doc_id", "lang", "source", _features(F.col("text")).alias("f")))
    return judged(measured, reach, prior).select("doc_id", *[F.col(f"f.{c}").alias(c) for c in COUNTS], F.col("__base_failed").alias("base_failed"), F.col("__kept").alias("kept"))


def accepted(docs: DataFrame, reach: int = 8, prior: int = 20) -> DataFrame:
    """The rows of docs that quality() keeps, all columns as they came; nulls, repeated rows and empty tables as there.

    Rows are written once beside their numbers, so that texts go through Python once.
    """
    columns = [F.col(c).alias(f"__c{i}") for i, c in enumerate(docs.columns)]
    measured = written(docs.select(*columns, "lang", "source", _features(F.col("text")).alias("f")))
    return judged(measured, reach, prior).where("__kept").select(*[F.col(f"__c{i}").alias(c) for i, c in enumerate(docs.columns)])
