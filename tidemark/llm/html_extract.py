"""Main text of web pages by the recurrent block labeller.

Each page is split into leaf blocks (blocks.py), a bidirectional LSTM labels all of a page's blocks with the whole
page in view (labeller.py), and the article's blocks are joined in page order by an empty line. The model has a
fixed size, is trained on the driver on drawn pages, and travels with the tasks; there is no shuffle.

Null and empty pages, and pages without blocks, have an empty text. Rows that repeat a page get the same text. A
null id or url stays null. Pages of any length are read whole. Of the table's columns only three are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import parse
from .common import as_text, chunks, utf8
from .labeller import Labeller, trained

#: Pages are labelled together in runs of about so many bytes, to bound memory.
_RUN = 1 << 22


def text_rows(model: Labeller):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, offsets = utf8(batch.column(2))
            for lo, hi in chunks(offsets, _RUN):
                part = batch.slice(lo, hi - lo)
                pages = [parse(source) for source in part.column(2).to_pylist()]
                texts, sizes = [""] * len(pages), [0] * len(pages)
                for i, flags in model.label(pages):
                    kept = [t for t, keep in zip(pages[i].text, flags.tolist()) if keep]
                    texts[i], sizes[i] = "\n\n".join(kept), len(kept)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64()), pa.array([len(p.node) for p in pages], pa.int64()), pa.array(sizes, pa.int64())],
                    names=["id", "url", "text", "n_chars", "n_blocks", "n_kept"],
                )

    return run


def extract(pages: DataFrame, model: Labeller | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """id, url, text, n_chars (code points of the text), n_blocks and n_kept (blocks of the page and of the article)."""
    kinds = {f.name: f.dataType.simpleString() for f in pages.schema.fields}
    base = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), as_text(html_col).alias("html"))
    told = base.mapInArrow(text_rows(model or trained()), f"id {kinds[id_col]}, url {kinds[url_col]}, text string, n_chars bigint, n_blocks bigint, n_kept bigint")
    return told.withColumnRenamed("id", id_col).withColumnRenamed("url", url_col)
