"""Small fixed tables looked up by column: weakness recipes and title translation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Weakness ids and names of the public enumeration, with the technique each enables; the advice is ours.
WEAKNESSES = [
    ("CWE-22", "Path Traversal", "T1574", "Resolve the path with its links and check that it stays below the intended folder."),
    ("CWE-78", "OS Command Injection", "T1059", "Start programs from a list of arguments, never through a shell with text put together."),
    ("CWE-79", "Cross-site Scripting (XSS)", "T1059", "Escape what goes into a page by its place in it, and send a content security policy."),
    ("CWE-89", "SQL Injection", "T1190", "Bind values as parameters of a prepared statement."),
    ("CWE-94", "Code Injection", "T1059", "Parse input as data against a grammar of what is allowed; don't evaluate it."),
    ("CWE-502", "Deserialization of Untrusted Data", "T1587", "Take data formats that can't carry code, and check them against a schema."),
]


def weakness_table(spark: SparkSession) -> DataFrame:
    """(cwe, name, technique, advice)."""
    return spark.createDataFrame(WEAKNESSES, "cwe string, name string, technique string, advice string")


def weakness_id(raw: str | Column) -> Column:
    """An id in upper case with its prefix."""
    up = F.upper(F.trim(raw))
    return F.when(up.startswith("CWE-"), up).otherwise(F.concat(F.lit("CWE-"), up))


def with_recipes(df: DataFrame, column: str) -> DataFrame:
    """df with name, technique and advice of the weakness that a column names; unknown ones get nulls."""
    table = F.broadcast(weakness_table(df.sparkSession))  # a few fixed rows
    return df.withColumn("_cwe", weakness_id(column)).join(table, F.col("_cwe") == F.col("cwe"), "left").drop("_cwe", "cwe")


#: Our own small English-Japanese dictionary of titles' phrases; the longer ones go first.
TITLE_PHRASES = {
    "Vulnerability Detection": "脆弱性検出", "Autonomous Vehicles": "自動運転車両", "Machine Learning": "機械学習", "Side-Channel": "サイドチャネル", "Zero Trust": "ゼロトラスト", "Vulnerability": "脆弱性",
    "Cryptography": "暗号", "Encryption": "暗号化", "Ransomware": "ランサムウェア", "Malware": "マルウェア", "Security": "セキュリティ", "Privacy": "プライバシー", "Attack": "攻撃", "Detection": "検出", "Network": "ネットワーク",
}


def translate_title(title: str | Column) -> Column:
    """Known phrases in Japanese, letter case aside; all else, names above all, stays."""
    out = F.col(title) if isinstance(title, str) else title
    for phrase in sorted(TITLE_PHRASES, key=len, reverse=True):
        out = F.regexp_replace(out, rf"(?i)\b{phrase}s?\b", TITLE_PHRASES[phrase])
    return out
