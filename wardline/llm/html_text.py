"""HTML main text by gradient-boosted trees over DOM nodes with hierarchical decoding.

Trees are fitted on ``TRAIN_PAGES`` generated pages (a fixed number, built on the driver).  Each block element of a
page has features of its own text, its subtree (size, density, links, sentences), attribute tokens of
itself and its ancestors, depth and siblings.  The log-odds are decoded over the tree: the choice
of the greatest total such that nothing below a dropped element is kept.

Formulas are text of the block around them; fallback content (noscript, object, audio, video, canvas) is judged like any
block.  Null or empty html gives an empty text.  Unclosed and misnested mark-up is read as far as it goes.  Repeated rows
give repeated rows; other columns of ``pages`` are left alone.  Work is per page; nothing is shuffled.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardline.llm.boosting import Boosted
from wardline.llm.dom import Page, decode, main_text
from wardline.llm.registry import query
from wardline.llm.tables import scalar, table
from wardline.llm.training_pages import pages

TRAIN_PAGES, SEED, BATCH = 500, 11, 64


def train(n: int = TRAIN_PAGES, seed: int = SEED) -> Boosted:
    x, y = [], []
    for source in pages(n, seed):
        page = Page(source)
        f = page.features()
        known = [i for i, label in enumerate(page.label) if label is not None]
        x.append(np.vstack([f[known], f[:1]]))
        y.append(np.array([page.label[i] for i in known] + [1.0]))
    return Boosted(np.vstack(x), np.concatenate(y))


def extract(sources: list[str | None], model: Boosted) -> list[str]:
    """The main text of each page."""
    out: list[str] = []
    for a in range(0, len(sources), BATCH):
        read = [Page(s, labels=False) if s else None for s in sources[a : a + BATCH]]
        some = [p for p in read if p is not None]
        odds = model.predict(np.vstack([p.features() for p in some])) if some else np.zeros(0)
        at = 0
        for p in read:
            if p is None:
                out.append("")
                continue
            n = len(p.tag)
            out.append(main_text(p, decode(p.parent, odds[at : at + n])))
            at += n
    return out


def with_main_text(docs: DataFrame, model: Boosted, column: str = "html") -> DataFrame:
    """``docs`` with the column ``text``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return docs.withColumn("text", scalar(lambda c: pa.array(extract(c.to_pylist(), shared.value), pa.string()), "string")(F.col(column)))


@query("op4_dom_boosting")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = with_main_text(table(spark, sf_dir, "pages").select("page_id", "url", "html"), train())
    return rows.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
