"""Text analysis as Column expressions: they stay inside code generation and need no Python workers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Word and CJK patterns, stop words.
WORD = r"[a-zA-Z0-9_\-]+"
DOTTED_WORD = r"[a-zA-Z0-9_\-.]*[a-zA-Z0-9_\-]"
CJK_RUN = "[぀-ヿ㐀-䶿一-鿿]+"
STOP_WORDS = "a an and are as at be but by for if in into is it no not of on or such that the their then there these they this to was will with".split()
STOP_PARTICLES = ["て", "に", "を", "は", "が", "の", "と"]

#: Our own small English-Japanese dictionary; the pinned pair is ransomware.
SYNONYMS = {"ransomware": "ランサムウェア", "malware": "マルウェア", "attack": "攻撃", "security": "セキュリティ", "cryptography": "暗号"}


def all_matches(text: Column, pattern: str) -> Column:
    return F.coalesce(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.array().cast("array<string>"))


def words(text: Column) -> Column:
    return all_matches(text, WORD)


def grams(run: Column, n: int) -> Column:
    """All n-character substrings of a string, in order."""
    return F.when(F.length(run) >= n, F.transform(F.sequence(F.lit(1), F.length(run) - (n - 1)), lambda i: F.substring(run, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))


def cjk_tokens(text: Column, *sizes: int) -> Column:
    """Each CJK run followed by its n-grams."""
    return F.flatten(F.transform(all_matches(text, CJK_RUN), lambda r: F.concat(F.array(r), *[grams(r, n) for n in sizes])))


def standard_tokens(text: Column) -> Column:
    """Words first, then CJK runs with bigrams."""
    return F.concat(words(text), cjk_tokens(text, 2))


def search_tokens(text: Column) -> Column:
    """Lower-case words, then CJK runs with their 2-grams and 3-grams."""
    return F.concat(words(F.lower(text)), cjk_tokens(text, 2, 3))


def lowercase(tokens: Column) -> Column:
    return F.transform(tokens, F.lower)


def drop_stop_words(tokens: Column) -> Column:
    stop = F.array(*[F.lit(w) for w in [*STOP_WORDS, *STOP_PARTICLES]])
    return F.filter(tokens, lambda t: ~F.array_contains(stop, F.lower(t)))


def with_synonyms(tokens: Column, pairs: dict[str, str] = SYNONYMS) -> Column:
    """Each token followed by its synonym, if it has one."""
    table = F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])
    return F.flatten(F.transform(tokens, lambda t: F.filter(F.array(t, F.try_element_at(table, F.lower(t))), lambda x: x.isNotNull())))


def strip_html(text: Column) -> Column:
    """Tags become blanks, then the five common references are decoded, the ampersand last."""
    out = F.regexp_replace(text, "<[^>]+>", " ")
    for name, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        out = F.replace(out, F.lit(name), F.lit(char))
    return out


def escape_html(text: Column) -> Column:
    out = F.coalesce(text, F.lit(""))
    for char, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        out = F.replace(out, F.lit(char), F.lit(name))
    return out


def map_chars(text: Column, pairs: dict[str, str]) -> Column:
    for old, new in pairs.items():
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


def clean(text: Column) -> Column:
    """White space runs as one blank, trimmed; null as empty."""
    return F.coalesce(F.trim(F.regexp_replace(text, r"\s+", " ")), F.lit(""))


def analyze(text: Column) -> Column:
    """Character filters, tokenizer, token filters: strip tags, tokenize, lower, drop stop words."""
    return drop_stop_words(lowercase(standard_tokens(strip_html(text))))


def count_substring(text: Column, part: str) -> Column:
    """Occurrences, letter case aside: apart in texts of up to 1000 characters, overlapping ones too in longer ones."""
    low, q = F.lower(text), part.lower()
    apart = ((F.length(low) - F.length(F.replace(low, F.lit(q), F.lit("")))) / len(q)).cast("long")
    ahead = F.size(F.regexp_extract_all(low, F.lit(f"(?=({''.join(chr(92) + c if not c.isalnum() and not c.isspace() else c for c in q)}))"), F.lit(1))).cast("long")
    return F.when(F.length(low) <= 1000, apart).otherwise(ahead)


def jaccard(a: Column, b: Column) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / union)


def edge_grams(token: Column, least: int = 2, most: int = 6) -> Column:
    return F.when(F.length(token) >= least, F.transform(F.sequence(F.lit(least), F.least(F.length(token), F.lit(most))), lambda i: F.substring(token, F.lit(1), i))).otherwise(F.array().cast("array<string>"))


def title(text: Column) -> Column:
    """The first line."""
    return F.substring_index(text, "\n", 1)
