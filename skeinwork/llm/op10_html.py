"""Operator 10: main text of web pages by a linear-chain conditional random field over leaf blocks, decoded by Viterbi.

The model is trained on the driver from labelled sample pages (a fixed number, the same each time) and sent along; pages
are read in one pass without a shuffle. Null or empty html gives an empty text; pages without main text too. Character
references are decoded, white space inside a block becomes one space, blocks are joined by a blank line; nothing is
capped. Repeated rows get equal results; empty tables give empty tables; other columns are ignored; long pages are whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .html_blocks import leaf_blocks
from .html_crf import Crf, trained


def main_text(page: str, model: Crf) -> str:
    blocks = leaf_blocks(page)
    return "\n\n".join(b.text for b, label in zip(blocks, model.decode(blocks), strict=True) if label)


def extract_text(df: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", model: Crf | None = None) -> DataFrame:
    """(key, url, text, n_chars) of every row of df."""
    model = model or trained()
    schema = T.StructType([df.schema[key], df.schema[url], T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(p or "", model) for p in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, batch.schema.field(2).type), pa.array([len(t) for t in texts], pa.int64())], names=schema.names)

    return df.select(key, url, html).mapInArrow(run, schema)
