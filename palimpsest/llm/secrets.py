"""Secret scans over a ledger of content-addressed blobs, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import BROADCAST_ROWS, Written, bounded, exists, same, written

# Kind, pattern, group that must reach the least length (0: whole match), least length. Order is the kinds' order.
BASE = (
    ("assign", r"""((?i)password|passwd|secret|token|api_?key)(?-i)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    ("access", r"AKIA[A-Z0-9]+", 0, 16),
    ("hex", r"[0-9a-f]{32,}", 0, 32),
)
#: Kinds that this scan adds to the base ones.
ADDED = (
    ("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 1),
    ("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}", 0, 1),
    ("github", r"gh[pousr]_[A-Za-z0-9]{36,}", 0, 1),
)
RULES = BASE + ADDED
RULE_VERSION = 1
#: The session's setting that names the folder of a lasting ledger. Unset, a scan starts from an empty one of its own.
LEDGER = "spark.palimpsest.secrets.ledger"
_LEDGER = "blob string, rule_version int, found array<struct<start:int,rank:int,end:int,kind:string>>"


def _spans(text: Column, order: int, kind: str, pattern: str, group: int, least: int) -> Column:
    """array<struct<start int, kind int, end int, name>> of the matches that pass, in code points.

    A split by the pattern gives the texts between the matches; summing lengths along both gives each match's place.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    between = F.split(text, pattern, -1)
    step = lambda acc, x: F.struct(
        (acc["at"] + F.length(x["gap"]) + F.length(x["m"])).alias("at"),
        F.when(
            F.length(F.regexp_extract(x["m"], pattern, group) if group else x["m"]) >= least,
            F.concat(acc["out"], F.array(F.struct((acc["at"] + F.length(x["gap"])).alias("start"), F.lit(order).alias("rank"), (acc["at"] + F.length(x["gap"]) + F.length(x["m"])).alias("end"), F.lit(kind).alias("kind")))),
        ).otherwise(acc["out"]).alias("out"),
    )
    none = F.expr("cast(array() as array<struct<start:int,rank:int,end:int,kind:string>>)")
    pairs = F.zip_with(F.slice(between, 1, F.greatest(F.size(found), F.lit(1))), found, lambda gap, m: F.struct(F.coalesce(gap, F.lit("")).alias("gap"), m.alias("m")))
    walked = F.aggregate(pairs, F.struct(F.lit(0).alias("at"), none.alias("out")), step, lambda acc: acc["out"])
    return F.when(F.size(found) > 0, walked).otherwise(none)


def spans(text: Column) -> Column:
    """All rules' spans of a text column (null: none), ordered by start, then kind as listed."""
    text = F.coalesce(text, F.lit(""))
    return F.array_sort(F.concat(*[_spans(text, i, *rule) for i, rule in enumerate(RULES)]))


def joined(found: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def blob_of(text: Column) -> Column:
    """The content address of a text; null texts share that of the empty text."""
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def addressed(versions: DataFrame) -> Written:
    """(path, blob) of versions' (path, text) rows, written: texts are hashed once, and what follows moves addresses only."""
    return Written(versions.select("path", blob_of(F.col("text")).alias("blob")))


def scan(versions: DataFrame, ledger: DataFrame | None = None, rule_version: int = RULE_VERSION, places: DataFrame | None = None) -> DataFrame:
    """New ledger rows (blob, rule_version, found) for versions' (path, text) rows.

    Every distinct blob that `ledger` does not hold under `rule_version` is scanned once, whichever and however many paths or
    historical versions have it; what it holds is not scanned again. A blob that only one row has is scanned where that row is read.
    The others, and those of the ledger, are a table that tells which path stands for the blob, if any: it is broadcast if it is
    within the bound, else rows are shuffled by blob and path, so that copies of one blob are spread over tasks.
    """
    places = addressed(versions).df if places is None else places
    per = places.groupBy("blob").agg(F.count(F.lit(1)).alias("n"), F.min("path").alias("path"))
    if ledger is None:
        special = per.where("n > 1").select("blob", "path", F.lit(False).alias("held"))
    else:
        held = ledger.where(F.col("rule_version") == rule_version).select(F.col("blob").alias("__held")).distinct()
        special = per.join(held, per["blob"] == held["__held"], "left").where("n > 1 or __held is not null").select("blob", "path", F.col("__held").isNotNull().alias("held"))
    special = bounded(written(special.select(F.col("blob").alias("__blob"), F.col("path").alias("__path"), "held")))
    rows = versions.select(F.col("path").alias("path"), F.col("text"), blob_of(F.col("text")).alias("blob"))
    rows = rows.join(special, rows["blob"] == special["__blob"], "left").where(F.col("__blob").isNull() | (~F.col("held") & same(F.col("path"), F.col("__path"))))
    once = rows.select("blob", spans(F.col("text")).alias("found"))
    # rows repeated with their path give the same spans again
    return once.groupBy("blob").agg(F.max("found").alias("found")).select("blob", F.lit(rule_version).alias("rule_version"), "found")


def ledger_dir(spark: SparkSession) -> str | None:
    """The folder of the ledger that lasts from scan to scan: the session's setting LEDGER, if any."""
    return spark.conf.get(LEDGER, None) or spark.sparkContext.getConf().get(LEDGER, None)


def recorded(spark: SparkSession, path: str) -> DataFrame | None:
    """The ledger (blob, rule_version, found) in a folder; None if there is no such folder. A blob may have several rows, alike."""
    if not exists(spark, path):
        return None
    return spark.read.schema(_LEDGER).parquet(path)


def findings(versions: DataFrame, ledger: DataFrame | None = None, rule_version: int = RULE_VERSION, path: str | None = None) -> tuple[DataFrame, DataFrame]:
    """((path, blob, found) for each row of versions, the ledger with the new blobs). Findings go back to every path by blob.

    The starting point is `ledger`, or the one in the folder `path`, to which new rows are appended before they are joined. An
    append that fails commits nothing, or rows that the next scan finds and need not add; two scans at a time may add the same
    rows, which are taken once.
    """
    spark = versions.sparkSession
    if path is not None:
        ledger = recorded(spark, path)
    places = addressed(versions)
    new = scan(versions, ledger, rule_version, places.df)
    if path is None:
        now = written(new)
        now = now if ledger is None else now.unionByName(ledger)
    else:
        new.write.mode("append").parquet(path)
        now = recorded(spark, path)
    known = now.where(F.col("rule_version") == rule_version).where(F.size("found") > 0).groupBy(F.col("blob").alias("__blob")).agg(F.max("found").alias("found"))
    none = F.expr("cast(array() as array<struct<start:int,rank:int,end:int,kind:string>>)")
    out = places.df.join(known, places.df["blob"] == known["__blob"], "left").select("path", "blob", F.coalesce("found", none).alias("found"))
    return out, now


def secrets(docs: DataFrame) -> DataFrame:
    """(doc_id, text, ...) -> (doc_id, n_assign, n_access, n_hex, base_sha256, spans), a row per row of docs.

    Null and empty texts have no spans; texts are scanned whole; equal texts and repeated rows are scanned once and each keep
    their row; doc_id may be null or repeated with other texts. An empty table gives an empty result. Other columns of docs are
    not used. Where the session names a ledger (LEDGER), blobs that it holds are not scanned, and it takes in the others.
    """
    out, _ = findings(docs.select(F.col("doc_id").alias("path"), "text"), path=ledger_dir(docs.sparkSession))
    base = F.filter("found", lambda s: s["rank"] < len(BASE))
    count = lambda i, kind: F.size(F.filter("found", lambda s: s["rank"] == i)).cast("long").alias(f"n_{kind}")
    return out.select(F.col("path").alias("doc_id"), *[count(i, r[0]) for i, r in enumerate(BASE)], F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("found")).alias("spans"))


def masked(text: Column, found: Column, mask: str = "[SECRET]") -> Column:
    """The text with every span, or union of overlapping spans, replaced by the mask."""
    step = lambda acc, s: F.when(
        s["start"] >= acc["at"],
        F.struct(s["end"].alias("at"), F.concat(acc["out"], F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), F.lit(mask)).alias("out")),
    ).otherwise(F.struct(F.greatest(acc["at"], s["end"]).alias("at"), acc["out"].alias("out")))
    done = F.aggregate(found, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))
    return F.when(F.size(found) > 0, done).otherwise(text)


def redacted(docs: DataFrame) -> DataFrame:
    """docs with the secrets of text masked (and n_chars, if there, counted anew where that changed the text); every row stays.

    Null and empty texts, repeated rows and empty tables stay as they are. Where the session names a ledger, as in secrets().
    The spans of blobs with secrets are broadcast if they are few enough in all, else rows are shuffled by blob.
    """
    out, _ = findings(docs.select(F.col("doc_id").alias("path"), "text"), path=ledger_dir(docs.sparkSession))
    hits = written(out.where(F.size("found") > 0).groupBy(F.col("blob").alias("__blob")).agg(F.max("found").alias("__found")))
    total = hits.agg(F.sum(F.size("__found"))).first()[0] or 0
    known = F.broadcast(hits) if total <= BROADCAST_ROWS else hits
    rows = docs.withColumn("__own", blob_of(F.col("text")))
    rows = rows.join(known, rows["__own"] == known["__blob"], "left")
    hit = F.col("__blob").isNotNull()
    new = {"text": F.when(hit, masked(F.col("text"), F.col("__found"))).otherwise(F.col("text"))}
    rows = rows.withColumns(new)
    if "n_chars" in docs.columns:
        rows = rows.withColumn("n_chars", F.when(hit, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return rows.select(*docs.columns)
