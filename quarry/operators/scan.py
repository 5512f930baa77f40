"""a scan of texts, line by line, for labelled patterns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CREDENTIAL = r"""(?i)(api[_-]?key|secret|token|password)["' ]*[:=]["' ]*[A-Za-z0-9_\-]{16,}"""
#: Label: pattern (without look-around, so that other engines can run it too).
PATTERNS = {"credential": CREDENTIAL}
# What must not be published, line by line, and documented placeholders that are cut out of a line first.
RELEASE_PATTERNS = {
    "absolute drive path": r"\b[A-Za-z]:\\{1,2}[A-Za-z0-9_]",
    "hardcoded credential": r"""(?i)\b(api[_-]?key|secret|token|password|passwd|access[_-]?key)\b\s*[:=]\s*['"][^'"]{12,}['"]""",
    "aws access key id": r"\bAKIA[0-9A-Z]{16}\b",
    "credential env assignment": r"(?i)^\s*(?:export\s+)?[A-Z0-9_]*(KEY|TOKEN|SECRET|PASSWORD|PASSWD)[A-Z0-9_]*=\S{16,}$",
    "model hub token": r"\bhf_[A-Za-z0-9]{30,}",
    "code host token": r"\bgh[pousr]_[A-Za-z0-9]{30,}",
    "private key": r"-----BEGIN [A-Z ]*PRIVATE KEY-----",
}
PLACEHOLDERS = ("C:\\Users\\you",)


def scan_lines(docs: DataFrame, patterns: dict[str, str], placeholders: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, line, label, value): each line (from 1) of docs (doc_id, text) that a pattern matches once placeholders are cut out."""
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("at", "value"))
    for p in placeholders:
        lines = lines.withColumn("value", F.replace("value", F.lit(p)))
    labels = F.filter(F.array(*[F.when(F.col("value").rlike(p), F.lit(k)) for k, p in patterns.items()]), lambda x: x.isNotNull())
    return lines.select("doc_id", (F.col("at") + 1).alias("line"), F.explode(labels).alias("label"), "value")
