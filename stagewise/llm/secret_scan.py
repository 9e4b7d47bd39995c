"""Secret scan over an incremental ledger of blobs.

A text is named by the SHA-256 of its bytes, so every version and copy of a file that has
ever been seen is one blob. The ledger is a table in a shared folder with one row for each (blob, rule version) that was
scanned and its findings. A run hashes the given versions, takes the blobs that the ledger lacks for the current rule
version, scans only those, appends them, reads the ledger back, and joins findings to every path (row) by content address.

The folder is the setting `stagewise.secrets.ledger` of the session, which later runs then build on; without it each call
keeps its own in the folder of spark.checkpoint.dir and scans everything once. Two writers may append one blob twice: readers
take one row for each blob.

The base kinds are fixed; the method adds two of its own, `pem` (private key blocks: to the END line, or without one to the
end of what looks like a key's body) and `jwt` (signed tokens). The rule version is a digest of all rules, so a changed rule
makes every blob unseen again.

Defined cases: null text is the empty blob; empty texts have no spans and very long ones are scanned whole; rows with equal or
null ids, and repeated rows, each get the findings of their own text; findings that start alike are ordered by kind; an empty
table gives an empty result and an empty ledger; other columns pass through unread, but the two that a function adds replace
columns of these names.
"""

from __future__ import annotations

import hashlib
import re
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stagewise.llm.common import ensure_checkpoint_dir

# Kind, pattern, least length, group that the length counts for.
RULES = (
    ("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 12, 2),
    ("access", r"AKIA[A-Z0-9]+", 18, 0),
    ("hex", r"[0-9a-f]{16,}", 16, 0),
    ("pem", r"-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----(?:(?:(?!-----BEGIN )[\s\S])*?-----END [A-Z ]{0,30}PRIVATE KEY-----|(?:\s+(?:[A-Za-z-]+: \S+|[A-Za-z0-9+/]{20,}={0,2}))*(?:\s+[A-Za-z0-9+/]+={1,2}(?!\S)|\s+[A-Za-z0-9+/]{1,80}\s*\Z)?)", 0, 0),
    ("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}", 0, 0),
)
BASE = 3  # the first rules are the base
LEDGER = "blob string, rule_version string, spans array<struct<kind:int,start:int,end:int>>"


def rule_version(rules=RULES) -> str:
    return hashlib.sha256(repr(rules).encode()).hexdigest()[:16]


def scan_text(text: str, compiled) -> list[tuple[int, int, int]]:
    """(kind, start, end) of every finding, by start and then kind."""
    found = []
    for kind, (pattern, least, group) in enumerate(compiled):
        for m in pattern.finditer(text):
            if m.end(group) - m.start(group) >= least:
                found.append((kind, m.start(), m.end()))
    return sorted(found, key=lambda x: (x[1], x[0]))


def _blob(text_col: str):
    return F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256)


def scan_blobs(blobs: DataFrame, rules=RULES) -> DataFrame:
    """blobs (blob, text) -> rows of the ledger."""
    version = rule_version(rules)

    def run(batches):
        compiled = [(re.compile(p, re.ASCII), least, group) for _, p, least, group in rules]
        kind = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32())]))
        for b in batches:
            spans = [[{"kind": k, "start": s, "end": e} for k, s, e in scan_text(t.as_py() or "", compiled)] for t in b.column(1)]
            yield pa.record_batch([b.column(0), pa.array([version] * len(spans)), pa.array(spans, kind)], names=["blob", "rule_version", "spans"])

    return blobs.select("blob", "text").mapInArrow(run, LEDGER)


def update_ledger(docs: DataFrame, ledger: DataFrame | None = None, text_col: str = "text", rules=RULES) -> DataFrame:
    """The rows that the ledger lacks: one for each blob of docs that it has not for this rule version."""
    rows = docs.select(_blob(text_col).alias("blob"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    if ledger is not None:
        rows = rows.join(ledger.where(F.col("rule_version") == rule_version(rules)).select("blob"), "blob", "left_anti")
    return scan_blobs(rows.groupBy("blob").agg(F.first("text").alias("text")), rules)


def ledger_folder(spark: SparkSession) -> str:
    """The session's ledger, or a new one in the shared folder."""
    ensure_checkpoint_dir(spark)
    return spark.conf.get("stagewise.secrets.ledger", None) or f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/ledger-{uuid.uuid4().hex}"


def record(docs: DataFrame, folder: str, text_col: str = "text", rules=RULES) -> DataFrame:
    """Appends to the ledger what it lacks, and reads it: blob and spans of the rule version, one row for each blob."""
    spark = docs.sparkSession
    spark.createDataFrame([], LEDGER).write.mode("append").parquet(folder)  # makes the folder, if there is none
    seen = spark.read.schema(LEDGER).parquet(folder)
    update_ledger(docs, seen, text_col, rules).write.mode("append").parquet(folder)
    known = spark.read.schema(LEDGER).parquet(folder).where(F.col("rule_version") == rule_version(rules))
    return known.groupBy("blob").agg(F.first("spans").alias("spans"))


def _joined(rows: DataFrame, known: DataFrame, how: str = "inner", salts: int = 8) -> DataFrame:
    """rows with the spans of their blob; the rows of a blob with many copies are dealt over several copies of its findings."""
    rows = rows.withColumn("salt", F.pmod(F.monotonically_increasing_id(), F.lit(salts)).cast("int"))
    return rows.join(known.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))), ["blob", "salt"], how).drop("salt")


def findings(docs: DataFrame, folder: str | None = None, text_col: str = "text", rules=RULES) -> DataFrame:
    """docs with blob and spans (array of kind, start, end): scans what the ledger in the folder lacks."""
    known = record(docs, folder or ledger_folder(docs.sparkSession), text_col, rules)
    rows = _joined(docs.select(F.struct(*docs.columns).alias("row"), _blob(text_col).alias("blob")), known)
    return rows.select(*(F.col("row").getField(c).alias(c) for c in docs.columns if c not in ("blob", "spans")), "blob", "spans")


def redact(docs: DataFrame, folder: str | None = None, text_col: str = "text", rules=RULES) -> DataFrame:
    """docs with each span of text_col replaced by <kind>; overlapping spans are merged, the first kind named. Other columns stay."""
    names = [r[0] for r in rules]
    known = record(docs, folder or ledger_folder(docs.sparkSession), text_col, rules).where(F.size("spans") > 0)

    def run(batches):
        for b in batches:
            out = []
            for t, spans in zip(b.column(b.num_columns - 2), b.column(b.num_columns - 1).to_pylist(), strict=True):
                if not spans:
                    out.append(t.as_py())
                    continue
                t, at, parts = t.as_py(), 0, []
                for x in spans:
                    if x["start"] >= at:
                        parts += [t[at : x["start"]], f"<{names[x['kind']]}>"]
                    at = max(at, x["end"])
                out.append("".join([*parts, t[at:]]))
            yield pa.record_batch([*b.columns[:-2], pa.array(out, pa.string())], names=[*places, "t"])

    others = [c for c in docs.columns if c != text_col]
    places = [f"c{i}" for i in range(len(others))]
    rows = docs.select(*(F.col(c).alias(p) for c, p in zip(others, places, strict=True)), F.col(text_col).alias("t"), _blob(text_col).alias("blob"))
    # only blobs with findings travel, so this side is small unless secrets are everywhere
    rows = _joined(rows, known, "left").select(*places, "t", "spans")
    clean = rows.mapInArrow(run, rows.drop("spans").schema)
    back = dict(zip(others, places, strict=True)) | {text_col: "t"}
    return clean.select(*(F.col(back[c]).alias(c) for c in docs.columns))


def op3_secret_scan(spark, sf_dir: str, folder: str | None = None) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    known = record(docs, folder or ledger_folder(spark))
    out = _joined(docs.select("doc_id", _blob("text").alias("blob")), known)
    names = F.array(*(F.lit(r[0]) for r in RULES))
    joined = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"].cast("string"), x["end"].cast("string"))), ",")
    count = lambda k: F.size(F.filter("spans", lambda x: x["kind"] == k)).cast("long")
    return out.select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(joined(F.filter("spans", lambda x: x["kind"] < BASE)), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"),
    )
