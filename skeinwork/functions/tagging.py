"""Keyword taxonomies and pattern scans; keywords match as substrings of the lower-case text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Domains in order of precedence with their keywords.
DOMAINS = {
    "AI/ML Security": ["llm", "prompt injection", "agent", "mllm", "rag", "adversarial attack", "machine learning"],
    "Cryptography": ["cryptography", "encryption", "zero-knowledge", "lattice", "signature", "rsa", "ecc"],
    "Network Security": ["network", "quic", "darknet", "traffic", "routing", "ddos", "dns", "firewall"],
    "Software Security": ["malware", "fuzzing", "vulnerability", "bytecode", "smart contract", "exploit", "binary"],
    "Privacy & Provenance": ["privacy", "anonymity", "differential privacy", "watermark", "provenance", "leakage"],
    "IoT & Hardware Security": ["iot", "vehicle", "autonomous", "smart grid", "embedded", "firmware", "arm cca"],
}
OTHER_DOMAIN = "General Cyber Security"
#: Tags and their keywords.
TAGS = {
    "llm-security": ["llm", "agent", "prompt"],
    "malware-analysis": ["malware", "virus", "trojan"],
    "fuzzing": ["fuzzing", "fuzzer", "crash"],
    "privacy-preservation": ["privacy", "anonymity"],
    "network-protocol": ["network", "protocol", "quic"],
    "trusted-execution": ["hardware", "arm", "enclave"],
    "blockchain-forensics": ["blockchain", "smart contract"],
    "data-provenance": ["provenance", "watermark"],
}
#: Technique ids and their keywords.
TECHNIQUES = {
    "T1059": ["command execution", "code injection", "scripting", "powershell", "python interpreter"],
    "T1078": ["valid accounts", "credential stuffing", "impersonation", "stolen credentials"],
    "T1190": ["exploit public-facing application", "vulnerability", "remote code execution", "rce", "cve"],
    "T1499": ["denial of service", "flooding", "ddos", "resource exhaustion", "algorithmic complexity"],
    "T1566": ["phishing", "smishing", "social engineering", "spearphishing"],
    "T1574": ["hijacking", "dll sideloading", "backdoor", "path traversal", "library injection"],
    "T1587": ["exploit generation", "malware synthesis", "payload development"],
}
#: Threat categories and their keywords.
STRIDE = {
    "Spoofing": ["impersonation", "spoofing", "identity theft", "credential stuffing", "forgery"],
    "Tampering": ["tampering", "poisoning", "data corruption", "memory corruption", "backdoor", "code modification"],
    "Repudiation": ["provenance", "repudiation", "audit evasion", "log tampering", "untraceable"],
    "Information Disclosure": ["privacy leakage", "information leakage", "relational privacy", "side channel", "exfiltration"],
    "Denial of Service": ["dos", "ddos", "delay attack", "resource exhaustion", "amplification"],
    "Elevation of Privilege": ["privilege escalation", "bypass", "exploit", "sandbox escape", "rooting"],
}
#: Threat patterns and their labels, in order.
THREATS = [
    (r"(?i)\b(rm\s+-rf|chmod\s+777|wget\s+http|curl\s+http.*\|\s*sh)\b", "COMMAND_INJECTION: Dangerous Shell Command"),
    (r"(?i)\b(nc\s+-e|/bin/sh|/bin/bash)\b", "COMMAND_INJECTION: Reverse Shell Pattern"),
    (r"(?i)\b(eval\(|exec\(|__import__\(|getattr\(.*system)\b", "COMMAND_INJECTION: Dynamic Code Execution"),
    (r"(?i)(\bUNION\b\s+\bSELECT\b|'\s+OR\s+'1'='1|--\s*$|/\*.*\*/)", "SQLI: SQL Injection Pattern"),
    (r"(?i)<script.*?>.*?</script.*?>", "XSS: Script Tag XSS"),
    (r"(?i)javascript:", "XSS: JavaScript URI Scheme"),
    (r"(?i)onload\s*=|onerror\s*=", "XSS: Inline Event Handler XSS"),
]
#: Terms that speak for the security topic.
TOPIC_TERMS = "security vulnerability cryptography exploit attack malware ransomware zero-trust cve authentication encryption privacy adversarial side-channel patch firmware protocol audit".split()


def has_any(low: Column, keywords: list[str]) -> Column:
    """One regular expression instead of a scan for each keyword: the text is read once."""
    import re

    return low.rlike("|".join(re.escape(k).replace("\\ ", " ").replace("\\-", "-") for k in keywords))


def classify_domain(text: Column) -> Column:
    low, out = F.lower(text), None
    for name, keywords in DOMAINS.items():
        out = F.when(has_any(low, keywords), name) if out is None else out.when(has_any(low, keywords), name)
    return out.otherwise(OTHER_DOMAIN)


def labels(text: Column, taxonomy: dict[str, list[str]]) -> Column:
    """Sorted names of a taxonomy whose keywords occur."""
    low = F.lower(text)
    return F.array_sort(F.array_compact(F.array(*[F.when(has_any(low, ks), name) for name, ks in taxonomy.items()])))


def security_tags(text: Column, categories: Column) -> Column:
    """Categories, domain (from text and categories) and rule tags (from text), sorted and distinct."""
    base = F.coalesce(categories, F.array(F.lit("cs.CR")))
    domain = classify_domain(F.concat_ws(" ", text, F.array_join(base, " ")))
    return F.array_sort(F.array_distinct(F.concat(base, F.array(domain), labels(text, TAGS))))


def threats(text: Column) -> Column:
    """Labels of the patterns found, in order."""
    return F.array_compact(F.array(*[F.when(text.rlike(p), name) for p, name in THREATS]))


def topic_relevance(text: Column) -> Column:
    """Ten times the share of topic terms among words, at most 1."""
    tokens = F.regexp_extract_all(F.lower(text), F.lit(r"(?U)\b[a-zA-Z_-]+\b"), F.lit(0))
    hits = F.size(F.filter(tokens, lambda t: t.isin(TOPIC_TERMS)))
    return F.when(F.size(tokens) > 0, F.least(F.lit(1.0), 10.0 * hits / F.size(tokens))).otherwise(0.0)


def record_tags(topic: Column, title: Column, text: Column) -> Column:
    both = F.concat_ws(" ", F.lower(title), F.lower(text))
    return F.array_sort(F.array_distinct(F.array_compact(F.array(
        topic,
        F.when(both.contains("security"), "security"),
        F.when(F.lower(title).contains("zero trust") | F.lower(text).contains("zero trust"), "zero-trust"),
        F.when(F.lower(title).contains("ai") | F.lower(text).contains("model"), "artificial-intelligence"),
    ))))
