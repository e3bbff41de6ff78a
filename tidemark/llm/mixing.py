"""Mixing to target weights by iterative proportional fitting.

Documents fall into cells of source, language and topic; token counts of the cells are raked until their
marginals match the targets, and each document stays as often as its cell's calibrated weight asks, by a hash of
its id and text, so that a run can be repeated and a lost task gives the same rows again. Documents of cells that
are too small for their target stay more than once: else the sample would miss the targets.

Every value that a target does not name belongs to the rest of that dimension ("*"), so there are at most
(sources named + 1) * (languages named + 1) * (topics named + 1) cells, whatever the data hold: that bound makes
it safe to fit on the driver and to send the probabilities as a literal.

Null values belong to the rest. Null and empty texts weigh one token. Rows that repeat an id and a text share
their decision. Very long texts are read as a whole, for their length. An empty table gives an empty result. Targets of dimensions without any tokens are ignored.
"""

from __future__ import annotations

import warnings
from collections.abc import Mapping

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, as_text

REST = "*"
#: Target shares of the query and the pipeline, by dimension; "*" is everything not named.
TARGETS: dict[str, dict[str, float]] = {
    "source": {"src0": 0.2, **{f"src{i}": 0.035 for i in range(1, 20)}, REST: 0.135},
    "lang": {"en": 0.5, "fr": 0.17, "de": 0.17, "es": 0.12, REST: 0.04},
    "topic": {"short": 0.02, "prose": 0.65, "data": 0.1, "long": 0.22, REST: 0.01},
}


def n_tokens(text: Column) -> Column:
    """About the number of words: white-space runs inside the trimmed text, and one."""
    return (F.regexp_count(F.btrim(text, F.lit(" \t\n\x0b\f\r")), F.lit(SPACE)) + 1).cast("bigint")


def topic(text: Column, tokens: Column) -> Column:
    """A genre in place of a topic label, from the text alone."""
    digits = F.length(text) - F.length(F.translate(text, "0123456789#*$%&|<>{}=", ""))
    return F.when(digits * 20 > F.length(text), "data").when(tokens < 60, "short").when(tokens > 1500, "long").otherwise("prose")


def rake(mass: np.ndarray, targets: list[np.ndarray], rounds: int = 200, tolerance: float = 1e-9) -> np.ndarray:
    """The array nearest to `mass` in relative entropy whose marginals are the targets (shares of one).

    A target of an empty marginal cannot be met; the other shares of that dimension grow in its place.
    """
    fitted = mass / mass.sum()
    axes = range(fitted.ndim)
    sums = lambda a: fitted.sum(axis=tuple(x for x in axes if x != a))
    wanted = []
    for a, t in enumerate(targets):
        t = np.where(sums(a) > 0, t, 0.0)
        wanted.append(t / t.sum() if t.sum() > 0 else sums(a))
    for _ in range(rounds):
        worst = 0.0
        for a, t in enumerate(wanted):
            have = sums(a)
            ratio = np.divide(t, have, out=np.zeros_like(have), where=have > 0)
            worst = max(worst, float(np.abs(have - t).max()))
            fitted = fitted * np.expand_dims(ratio, tuple(x for x in axes if x != a))
        if worst < tolerance:
            break
    miss = max(float(np.abs(sums(a) - t).max()) for a, t in enumerate(wanted))
    if miss > 1e-4:
        warnings.warn(f"the cells cannot meet all targets: a share is off by {miss:.4f}")
    return fitted


def expected_copies(mass: np.ndarray, weights: np.ndarray, share: float) -> np.ndarray:
    """c * weight, the mean number of copies, with c such that `share` of the mass is expected in the sample."""
    return weights * (share * mass.sum() / float((mass * weights).sum()))


def calibrate(docs: DataFrame, targets: Mapping[str, Mapping[str, float]] = TARGETS, share: float = 0.6, seed: int = 7, id_col: str = "doc_id", text_col: str = "text", topic_col: str | None = None, prefix: str = "m_") -> DataFrame:
    """The input rows and columns, with source, lang, topic, tokens, weight, probability, copies and kept, each name behind the prefix.

    copies says how often the row belongs in the sample, probability the chance that it is there at all. Input columns
    of these names, prefix included, are replaced; `sample` takes a prefix that no column has.
    """
    dims = list(targets)
    names = [list(targets[d]) + ([] if REST in targets[d] else [REST]) for d in dims]
    text = as_text(text_col)
    results = [*dims, "tokens", "spot", "weight", "probability", "copies", "kept"]
    col = lambda name: F.col(f"`{prefix}{name}`")
    docs = docs.drop(*(f"{prefix}{r}" for r in results))
    own = docs.columns
    cells = docs.withColumn(f"{prefix}tokens", n_tokens(text))
    for d, known in zip(dims, names):
        value = topic(text, col("tokens")) if d == "topic" and topic_col is None else F.col(topic_col if d == "topic" else d)
        cells = cells.withColumn(f"{prefix}{d}", F.when(value.isin([k for k in known if k != REST]), value.cast("string")).otherwise(F.lit(REST)))
    keys = [f"{prefix}{d}" for d in dims]
    rows = cells.groupBy(*keys).agg(F.sum(col("tokens")).alias("mass")).collect()  # at most as many as the targets span
    mass = np.zeros([len(n) for n in names])
    for r in rows:
        mass[tuple(n.index(r[k]) for n, k in zip(names, keys))] = r["mass"]
    if not rows:
        weights, copies = np.ones_like(mass), np.ones_like(mass)
    else:
        fitted = rake(mass, [np.array([targets[d].get(k, 0.0) for k in n]) for d, n in zip(dims, names)])
        weights = np.divide(fitted * mass.sum(), mass, out=np.zeros_like(mass), where=mass > 0)
        copies = expected_copies(mass, weights, share)
    spot = F.lit(0)
    for n, k in zip(names, keys):
        spot = spot * len(n) + F.array_position(F.array(*map(F.lit, n)), F.col(f"`{k}`")).cast("int") - 1
    flat = lambda a: F.split(F.lit(",".join(repr(float(x)) for x in a.ravel())), ",").cast("array<double>")
    unit = F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.coalesce(F.col(id_col).cast("string"), F.lit("")), text), 11) / F.lit(float(1 << 53))
    place = cells.withColumn(f"{prefix}spot", spot)
    sure, more = np.floor(copies), copies - np.floor(copies)
    told = place.withColumns({f"{prefix}weight": F.get(flat(weights), col("spot")), f"{prefix}probability": F.get(flat(np.minimum(1.0, copies)), col("spot"))})
    told = told.withColumn(f"{prefix}copies", (F.get(flat(sure), col("spot")) + F.when(unit < F.get(flat(more), col("spot")), 1).otherwise(0)).cast("int"))
    return told.withColumn(f"{prefix}kept", col("copies") > 0).select(*(F.col(f"`{c}`") for c in own), *(col(r) for r in results if r != "spot"))


def sample(docs: DataFrame, **parameters) -> DataFrame:
    """The documents that the calibrated sample holds, as often as it holds them, with the columns of the input."""
    prefix = "m_"
    while any(c.lower().startswith(prefix) for c in docs.columns):
        prefix = f"_{prefix}"
    told = calibrate(docs, prefix=prefix, **parameters)
    # The outer form, as a filter before it would compute the copies again.
    own = [F.col(f"`{c}`") for c in docs.columns]
    again = told.select(*own, F.explode_outer(F.array_repeat(F.lit(0), F.col(f"`{prefix}copies`"))).alias(f"{prefix}again"))
    return again.filter(F.col(f"`{prefix}again`").isNotNull()).select(*own)
