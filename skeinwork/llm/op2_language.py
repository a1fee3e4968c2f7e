"""Operator 2: multilingual mixture inference.

A text is taken as words (runs of letters), each from one of its languages. A word's likelihood in a language is the
product over its letters of the probability of the letter's trigram (with the word's edges), hashed to BUCKETS; the
tables are counts over labelled rows. Expectation-maximisation estimates each document's language proportions. The
language set is the one of highest penalised likelihood among the nested sets of its largest proportions: every
language beyond the first must raise the log likelihood by more than PENALTY * ln(1 + words).

The label is the set's largest language, the score its proportion; null texts and texts without letters get ``und`` and
score 0, as all do if there is nothing to learn from. Rows with a null key train nothing and are never held out.
Repeated rows get equal results; ties go to the first language by code point; very long texts are whole; empty tables
give empty tables; other columns are ignored. The labels are taken to be languages: the driver and every task hold the model, which
is at most MODEL_CELLS numbers; with more than 512 languages it has fewer buckets each, with none left out.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bytewords import char_classes, chunks, code_points, utf8_view

BUCKETS = 1 << 16
MODEL_CELLS = 1 << 25
SMOOTH = 0.5
PENALTY = 3.0
STEPS = 40
TRAIN_ROWS = 20_000
"""About so many labelled rows of each language are learned from, chosen by a hash of the key."""
UNKNOWN = "und"


@functools.lru_cache(1)
def _lower() -> np.ndarray:
    table = np.arange(0x110000, dtype=np.uint32)
    for i in np.flatnonzero(char_classes() == 1).tolist():
        low = chr(i).lower()
        if len(low) == 1:
            table[i] = ord(low)
    return table


def trigrams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bucket of every letter's trigram, where each word starts among them, first word of each text, n + 1 values)."""
    cps, at = code_points(data)
    first = np.searchsorted(at, offsets)
    if not len(cps):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    letters = np.where(char_classes()[cps] == 1, _lower()[cps], 0).astype(np.uint32)
    before, after = np.concatenate([[0], letters[:-1]]).astype(np.uint32), np.concatenate([letters[1:], [0]]).astype(np.uint32)
    edge = first[first < len(cps)]
    before[edge] = 0
    after[edge[edge > 0] - 1] = 0
    own = np.flatnonzero(letters)
    b, c, a = before[own], letters[own], after[own]
    h = b * np.uint32(0x85EBCA6B) + c * np.uint32(0xC2B2AE35) + a * np.uint32(0x27D4EB2F)
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x2C1B3C6D)
    words = np.flatnonzero(b == 0)
    return (h >> np.uint32(16)).astype(np.int64), words, np.searchsorted(own[words], first)


def _counts(df: DataFrame) -> DataFrame:
    """(lang, bucket, n) of (text, lang)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = batch.column(1)
            for lang in langs.unique().to_pylist():
                part = batch.column(0).filter(pc.equal(langs, lang))
                data, offsets = utf8_view(part)
                for a, b in chunks(offsets):
                    h, _, _ = trigrams(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                    tables[lang] = tables.get(lang, 0) + np.bincount(h, minlength=BUCKETS)
        for lang, table in tables.items():
            some = np.flatnonzero(table)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(some), pa.string()), pa.array(some, pa.int32()), pa.array(table[some], pa.int64())], names=["lang", "bucket", "n"])

    return df.mapInArrow(run, "lang string, bucket int, n bigint")


def held_out(key: str) -> Column:
    return F.coalesce(F.crc32(F.col(key).cast("string")) % 4 == 2, F.lit(False))


def learn(df: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", rows: int = TRAIN_ROWS) -> tuple[list[str], np.ndarray]:
    """(languages, log probabilities [bucket, language]) from labelled rows that aren't held out, about ``rows`` of each language."""
    labelled = df.filter(F.col(lang).isNotNull() & F.col(text).isNotNull() & F.col(key).isNotNull() & ~held_out(key)).select(F.col(key).alias("k"), F.col(text).alias("text"), F.col(lang).alias("lang"))
    sizes = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row a language
    names = sorted(sizes)
    if not names:
        return [], np.zeros((BUCKETS, 0), np.float32)
    share = F.element_at(F.create_map(*[F.lit(x) for n in names for x in (n, min(1.0, rows / sizes[n]))]), F.col("lang"))
    drawn = F.crc32(F.concat(F.lit("train:"), F.col("k").cast("string"))) / float(1 << 32) < share
    narrow = max(0, (len(names) * BUCKETS // MODEL_CELLS).bit_length() - (len(names) * BUCKETS <= MODEL_CELLS))
    table = _counts(labelled.filter(drawn).select("text", "lang")).groupBy("lang", F.shiftright("bucket", narrow).alias("bucket")).agg(F.sum("n").alias("n")).toPandas()  # at most MODEL_CELLS rows
    out = np.full((BUCKETS >> narrow, len(names)), SMOOTH)
    at = {x: i for i, x in enumerate(names)}
    out[table["bucket"].to_numpy(), [at[x] for x in table["lang"]]] += table["n"].to_numpy()
    return names, np.log(out / out.sum(axis=0)).astype(np.float32)


def _fit(like: np.ndarray, first: np.ndarray, allowed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Proportions and log likelihood of texts (each with words) by EM from equal shares of the allowed languages."""
    texts, n = len(first) - 1, np.diff(first)
    share = allowed / allowed.sum(axis=1, keepdims=True)
    ll = np.zeros(texts)
    open_ = np.arange(texts)
    rows, at = like, first
    for step in range(STEPS):
        weighted = rows * np.repeat(share[open_], np.diff(at), axis=0).astype(np.float32)
        mix = weighted.sum(axis=1)
        np.maximum(mix, 1e-37, out=mix)
        ll[open_] = np.add.reduceat(np.log(mix), at[:-1])
        weighted /= mix[:, None]
        new = np.add.reduceat(weighted, at[:-1], axis=0) / np.diff(at)[:, None]
        moved = np.abs(new - share[open_]).max(axis=1)
        share[open_] = new
        go = moved > 2e-3
        if step == STEPS - 1 or not go.any():
            break
        if go.mean() < 0.7:
            keep = np.repeat(go, np.diff(at))
            rows, at = rows[keep], np.concatenate([[0], np.cumsum(n[open_[go]])])
            open_ = open_[go]
    return share, ll


def mixtures(logp: np.ndarray, words_at: np.ndarray, buckets: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Proportions of the chosen language set for each text; all zero without words."""
    k = logp.shape[1]
    out = np.zeros((len(first) - 1, k))
    some = np.flatnonzero(np.diff(first))
    if not len(some) or not k:
        return out
    own = np.add.reduceat(logp[buckets // (BUCKETS // len(logp))], words_at, axis=0)
    own -= own.max(axis=1, keepdims=True)
    at = np.concatenate([first[some], first[-1:]])
    n = np.diff(at)
    single = np.add.reduceat(own, at[:-1], axis=0)
    like = np.exp(own)
    price = PENALTY * np.log1p(n)
    share, full = _fit(like, at, np.ones((len(some), k)))
    order = np.argsort(-share, axis=1, kind="stable")
    best = single.argmax(axis=1)
    chosen = np.zeros((len(some), k))
    chosen[np.arange(len(some)), best] = 1
    value = single[np.arange(len(some)), best].astype(float)
    for m in range(2, k + 1):
        # no set of m or more languages can be better than all languages less the price of m - 1
        try_ = np.flatnonzero(full + 0.5 - price * (m - 1) > value)
        if not len(try_):
            break
        allowed = np.zeros((len(try_), k))
        np.put_along_axis(allowed, order[try_, :m], 1, axis=1)
        if m == k:
            got, ll = share[try_], full[try_]
        else:
            keep = np.zeros(len(some), bool)
            keep[try_] = True
            got, ll = _fit(like[np.repeat(keep, n)], np.concatenate([[0], np.cumsum(n[try_])]), allowed)
        ll = ll - price[try_] * (m - 1)
        better = ll > value[try_]
        chosen[try_[better]], value[try_[better]] = got[better], ll[better]
    out[some] = chosen
    return out


def predict(df: DataFrame, model: tuple[list[str], np.ndarray], key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, lang_pred, score, languages, proportions) of every row; only the text decides."""
    names, logp = model
    schema = T.StructType([df.schema[key], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("languages", T.ArrayType(T.StringType())), T.StructField("proportions", T.ArrayType(T.DoubleType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8_view(batch.column(1))
            for a, b in chunks(offsets):
                h, words, first = trigrams(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                got = mixtures(logp, words, h, first)
                label, score, langs, shares = [], [], [], []
                for row in got:
                    some = np.flatnonzero(row > 0)
                    some = some[np.argsort(-row[some], kind="stable")]
                    label.append(names[some[0]] if len(some) else UNKNOWN)
                    score.append(min(1.0, float(row[some[0]])) if len(some) else 0.0)
                    langs.append([names[i] for i in some])
                    shares.append([float(row[i]) for i in some])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(label, pa.string()), pa.array(score, pa.float64()), pa.array(langs, pa.list_(pa.string())), pa.array(shares, pa.list_(pa.float64()))], names=schema.names)

    return df.select(key, text).mapInArrow(run, schema)


def keep_identified(df: DataFrame, model: tuple[list[str], np.ndarray], text: str = "text", least: float = 0.5) -> DataFrame:
    """The rows of df whose text has a language that makes up ``least`` of it, with df's columns; texts don't move."""
    names, logp = model
    at = df.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8_view(batch.column(at))
            for a, b in chunks(offsets):
                h, words, first = trigrams(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                top = mixtures(logp, words, h, first).max(axis=1, initial=0)
                yield batch.slice(a, b - a).filter(pa.array(top >= least))

    return df.mapInArrow(run, df.schema)


def identify(df: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """(key, held_out, lang_pred, score, languages, proportions) of every row of df, learned from its own labelled rows."""
    found = predict(df, learn(df, key, text, lang), key, text)
    return found.select(key, held_out(key).alias("held_out"), "lang_pred", "score", "languages", "proportions")
