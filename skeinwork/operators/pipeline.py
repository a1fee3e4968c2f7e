"""The staged search pipeline and the select handler: understand, retrieve, fuse, present."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.highlight import fragment
from . import fulltext as X
from .vectors import dot, embed, embed_column, rrf


@dataclass
class Query:
    """A query taken apart.

    Grammar (ours): +must -not "a phrase"~slop prefix* word~edits word^boost field:word, and AND, OR, NOT with brackets;
    AND binds closer than OR, and what stands side by side in such an expression is joined by OR.
    """

    terms: dict[str, float] = field(default_factory=dict)
    must: list[str] = field(default_factory=list)
    banned: list[str] = field(default_factory=list)
    phrases: list[tuple[list[str], int]] = field(default_factory=list)
    prefixes: list[str] = field(default_factory=list)
    fuzzy: list[tuple[str, int]] = field(default_factory=list)
    fields: list[tuple[str, str]] = field(default_factory=list)
    expansions: dict[str, str] = field(default_factory=dict)
    tree: tuple | None = None


_CLAUSE = re.compile(r'"([^"]+)"(?:~(\d+))?|([+-]?)(?:(\w+):)?([\w.-]+)(\*|~(\d?))?(?:\^(\d+(?:\.\d+)?))?|([()])')
#: How much a synonym counts beside the word that was asked for.
EXPANSION = 0.5


def _clause(phrase: str, slop: str, name: str, word: str, mark: str, edits: str) -> tuple:
    if phrase:
        return ("phrase", phrase.lower().split(), int(slop or 0))
    word = word.lower()
    if name:
        return ("field", name, word)
    return ("prefix", word) if mark == "*" else ("fuzzy", word, int(edits or 1)) if mark else ("term", word)


def _add_term(out: Query, word: str, boost: str) -> None:
    out.terms[word] = float(boost or 1)
    if word in T.SYNONYMS:
        out.expansions[word] = T.SYNONYMS[word]


def _boolean(found: list[tuple], out: Query) -> tuple:
    """The tree of an expression with operators; its terms, but for those under NOT, are scored."""
    at = 0

    def peek() -> str:
        return "" if at >= len(found) else found[at][8] or (found[at][4] if found[at][4] in ("AND", "OR", "NOT") and not found[at][2] else "x")

    def either() -> tuple:
        nonlocal at
        parts = [both()]
        while peek() not in ("", ")"):
            at += peek() == "OR"
            if peek() in ("", ")"):
                break
            parts.append(both())
        return parts[0] if len(parts) == 1 else ("or", parts)

    def both() -> tuple:
        nonlocal at
        parts = [single(True)]
        while peek() == "AND":
            at += 1
            parts.append(single(True))
        return parts[0] if len(parts) == 1 else ("and", parts)

    def single(scored: bool) -> tuple:
        nonlocal at
        if peek() in ("", ")", "AND", "OR"):
            raise ValueError("an operator of the query has nothing to work on")
        if peek() == "NOT":
            at += 1
            before = (dict(out.terms), dict(out.expansions))
            inner = single(False)
            out.terms, out.expansions = before
            return ("not", inner)
        if peek() == "(":
            at += 1
            inner = either()
            if peek() != ")":
                raise ValueError("a bracket of the query is left open")
            at += 1
            return inner
        phrase, slop, sign, name, word, mark, edits, boost, _ = found[at]
        at += 1
        clause = _clause(phrase, slop, name, word, mark, edits)
        if sign == "-":
            return ("not", clause)
        if clause[0] == "term":
            _add_term(out, clause[1], boost)
        return clause

    tree = either()
    if at < len(found):
        raise ValueError("a bracket of the query was never opened")
    return tree


def parse(text: str) -> Query:
    out, found = Query(), _CLAUSE.findall(text)
    if any(x[8] or x[4] in ("AND", "OR", "NOT") and not x[2] for x in found):
        out.tree = _boolean(found, out)
        return out
    for phrase, slop, sign, name, word, mark, edits, boost, _ in found:
        kind, *rest = _clause(phrase, slop, name, word, mark, edits)
        if kind == "phrase":
            out.phrases.append(tuple(rest))
        elif kind == "field":
            out.fields.append(tuple(rest))
        elif kind == "prefix":
            out.prefixes.append(rest[0])
        elif kind == "fuzzy":
            out.fuzzy.append(tuple(rest))
        elif sign == "-":
            out.banned.append(rest[0])
        else:
            _add_term(out, rest[0], boost)
            if sign == "+":
                out.must.append(rest[0])
    return out


def _starts(prefix: str):
    return lambda t: t.startswith(prefix)


def _near(word: str, edits: int):
    return lambda t: X.fuzzy(t, word, edits)


def _holds(node: tuple, toks: Column, columns: list[str]) -> Column:
    """Whether a row meets a clause or a tree of them; a word is met by its synonym as well."""
    kind = node[0]
    if kind in ("and", "or"):
        out = None
        for part in node[1]:
            met = _holds(part, toks, columns)
            out = met if out is None else out & met if kind == "and" else out | met
        return out
    if kind == "not":
        return ~_holds(node[1], toks, columns)
    if kind == "phrase":
        return X.has_phrase(toks, node[1], node[2])
    if kind == "prefix":
        return F.exists(toks, _starts(node[1]))
    if kind == "fuzzy":
        return F.exists(toks, _near(node[1], node[2]))
    if kind == "field":
        return F.coalesce(F.lower(F.col(node[1]).cast("string")) == node[2], F.lit(False)) if node[1] in columns else F.lit(False)
    met = F.array_contains(toks, node[1])
    return met | F.array_contains(toks, T.SYNONYMS[node[1]]) if node[1] in T.SYNONYMS else met


def matches(q: Query, toks: Column, columns: list[str]) -> Column:
    """The clauses that admit or shut out a row, as one condition over its tokens."""
    clauses = [("term", w) for w in q.must] + [("not", ("term", w)) for w in q.banned] + [("phrase", *p) for p in q.phrases] + [("prefix", p) for p in q.prefixes]
    clauses += [("fuzzy", *f) for f in q.fuzzy] + [("field", *f) for f in q.fields] + ([q.tree] if q.tree else [])
    keep = F.lit(True)
    for c in clauses:
        keep &= _holds(c, toks, columns)
    return keep


def retrieve(df: DataFrame, q: Query, key: str, text: str) -> DataFrame:
    """(key, score) by BM25 of the rows that meet the clauses; corpus statistics are of all rows. Synonyms score with EXPANSION of their word's boost."""
    tokenize = T.search_tokens if q.expansions else X.tokens
    tokened = X.once(df, "_toks", tokenize(F.coalesce(F.col(text), F.lit(""))))
    flagged = tokened.withColumn("_ok", matches(q, F.col("_toks"), df.columns))
    if not q.terms:
        return flagged.filter("_ok").select(key, F.lit(1.0).alias("score"))
    boosts = q.terms | {s: EXPANSION * q.terms[w] for w, s in q.expansions.items()}
    return X.bm25_of_tokens(flagged, key, {"_toks": 1.0}, boosts, keep=["_ok"]).filter("_ok").select(key, "score")


def search(docs: DataFrame, vectors: DataFrame | None, text: str, k: int = 10, key: str = "doc_id") -> DataFrame:
    """Lexical hits and neighbours of the query's embedding, fused by rank, with snippets.

    vectors: (key, vector) of embedded documents, as embed_column gives; None embeds docs' whole texts now.
    """
    q = parse(text)
    lexical = X.top(retrieve(docs, q, key, "text"), key, 5 * k)
    wanted = F.array(*[F.lit(x) for x in embed(" ".join([*q.terms, *q.expansions.values()]))])
    if vectors is None:
        vectors = docs.select(key, embed_column("text").alias("vector"))
    near = vectors.select(key, dot("vector", wanted).alias("score")).orderBy(F.desc("score"), key).limit(5 * k)
    best = rrf(lexical, near, key, k)
    shown = docs.join(F.broadcast(best), key)  # k rows
    return shown.select(key, "rrf_score", "lexical_rank", "vector_rank", fragment(F.col("text"), list(q.terms), centred=True, size=150).alias("snippet"))


def select(docs: DataFrame, params: dict, key: str = "doc_id") -> DataFrame:
    """The select request: q, fq (a condition), rows, hl. Returns (key, score, num_found[, highlight])."""
    q = parse(params.get("q", "*"))
    flagged = docs.withColumn("_in", F.coalesce(F.expr(params.get("fq") or "true"), F.lit(False)))
    hits = retrieve(flagged, q, key, "text").join(flagged.filter("_in").select(key), key, "left_semi")
    total = hits.agg(F.count(F.lit(1)).alias("num_found"))
    best = X.top(hits, key, int(params.get("rows", 10))).crossJoin(F.broadcast(total))
    if not params.get("hl"):
        return best
    return docs.join(F.broadcast(best), key).select(key, "score", "num_found", fragment(F.col("text"), list(q.terms), centred=True, size=150).alias("highlight"))
