r"""Secret scans over an incremental blob ledger.

Every version of every path is content-addressed (SHA-256 of its text).  The ledger is an append-only table of the
``(blob, rule_version)`` pairs scanned so far with their findings; a scan takes one copy of each blob that the ledger has not seen
under the present rules, and the findings are joined back to all paths that hold the blob.

Defined results: null and empty texts are the blob of the empty text, without findings; repeated rows and copies share one scan and
all get its findings; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batch, documents, fresh_path, text_or_empty

#: The base kinds in their order, their patterns and the least length of what they must hold.
BASE_KINDS = ("assign", "access", "hex")
_ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]+")
LEAST = {"assign": 6, "access": 20, "hex": 24}
#: Further formats with a public, unmistakable prefix.
MORE_RULES = {
    "pem": r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----",
    "forge": r"gh[pousr]_[A-Za-z0-9]{36,}",
    "chat": r"xox[abprs]-[A-Za-z0-9-]{20,}",
}
_MORE = {kind: re.compile(p) for kind, p in MORE_RULES.items()}
_HEX_RUN = re.compile(r"[0-9a-f]{24,}")


def rule_version() -> str:
    """Names the present rules; findings of other versions are not reused."""
    said = repr((_ASSIGN.pattern, _ACCESS.pattern, _HEX.pattern, sorted(LEAST.items()), sorted(MORE_RULES.items())))
    return hashlib.sha256(said.encode()).hexdigest()[:16]


def find_secrets(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, by start, then base kinds as listed, then the further rules."""
    found = [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= LEAST["assign"]]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= LEAST["access"]]
    # A run of 24 or more is found whole by the bounded pattern too: runs are maximal and never overlap.
    found += [(m.start(), 2, m.end()) for m in _HEX_RUN.finditer(text)]
    found += [(m.start(), 3 + k, m.end()) for k, p in enumerate(_MORE.values()) for m in p.finditer(text)]
    kinds = (*BASE_KINDS, *_MORE)
    return [(kinds[k], a, b) for a, k, b in sorted(found)]


_FOUND = pa.schema([("blob", pa.string()), *((f"n_{k}", pa.int64()) for k in BASE_KINDS), ("base_sha256", pa.string()), ("spans", pa.string())])
_FOUND_SQL = "blob string, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"
#: Parts that the paths of one blob are dealt to when findings are joined back; only blobs with findings are repeated.
SALTS = 16
EMPTY_SHA = hashlib.sha256(b"").hexdigest()


def _scan(batches):
    for b in batches:
        rows = []
        for blob, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            found = find_secrets(text)
            said = [f"{k}:{a}:{e}" for k, a, e in found]
            own = [s for s, f in zip(said, found, strict=True) if f[0] in LEAST]
            counts = [sum(f[0] == k for f in found) for k in BASE_KINDS]
            rows.append((blob, *counts, hashlib.sha256(",".join(own).encode()).hexdigest(), ",".join(said)))
        yield batch(_FOUND, zip(*rows, strict=True) if rows else [[] for _ in _FOUND])


@dataclass
class BlobLedger:
    """The ledger's table: one row for each (blob, rule_version) that was scanned, also without findings."""

    spark: SparkSession
    path: str

    def table(self) -> DataFrame | None:
        """All that was scanned so far, or None before the first scan."""
        jvm = self.spark._jvm
        at = jvm.org.apache.hadoop.fs.Path(self.path)
        if not at.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(at):
            return None
        return self.spark.read.schema(f"{_FOUND_SQL}, rule_version string").parquet(self.path)

    def scan(self, versions: DataFrame, text: str = "text") -> DataFrame:
        """Scan the unseen blobs of ``versions`` and return its rows without the text, with ``blob`` and its findings."""
        version = rule_version()
        addressed = versions.withColumn(text, text_or_empty(text)).withColumn("blob", F.sha2(text, 256))
        seen = self.table()
        unseen = addressed.select("blob", text)
        if seen is not None:
            unseen = unseen.join(seen.where(F.col("rule_version") == version).select("blob"), "blob", "left_anti")
        # One copy of each blob: pre-aggregated in each task, so that copies are not shuffled.
        once = unseen.groupBy("blob").agg(F.first(text).alias("t"))
        found = once.mapInArrow(_scan, _FOUND_SQL).withColumn("rule_version", F.lit(version))
        found.write.mode("append").parquet(self.path)
        # Two runs that scanned the same blob at once may both have added it.
        told = self.table().where((F.col("rule_version") == version) & (F.col("spans") != "")).drop("rule_version").dropDuplicates(["blob"])
        salted = told.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        return (
            addressed.drop(text, *(f"n_{k}" for k in BASE_KINDS), "base_sha256", "spans")
            .withColumn("salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int"))
            .join(salted, ["blob", "salt"], "left")
            .drop("salt")
            .fillna(0, [f"n_{k}" for k in BASE_KINDS])
            .fillna(EMPTY_SHA, ["base_sha256"])
            .fillna("", ["spans"])
        )


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of all documents, by a ledger that begins empty."""
    ledger = BlobLedger(spark, fresh_path(spark, "ledger"))
    found = ledger.scan(documents(spark, sf_dir).select("doc_id", "text"))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "blob")
