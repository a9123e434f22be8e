"""Operator 2: a quality classifier from weak labels: EM over overlapping heuristic labellers, then a hashed scorer."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, lean, slices, utf8, written
from .textkernel import LOWER, U64, span_hashes, word_spans

#: Slots of the hashed scorer: byte trigrams, shape 4-grams, and bands of the statistics.
TRIGRAMS, SHAPES, BANDS = 3072, 960, 64
SLOTS = TRIGRAMS + SHAPES + BANDS

# Frequent function words of the languages at hand.
STOP_WORDS = """
the of and to in is that for it as with on be by was are this at from
de la le et les des en un une du que est pour qui dans par sur au pas avec
der die und das von zu den mit ist im dem nicht ein eine für auf sich des
el los las y se del con no una su para al lo como más
""".split()

#: A text is kept from this probability of good on; under one half, so that the doubtful stay.
LEAST = 0.25

STATS = ("symbols", "upper", "bars", "adjacent", "variety", "stops", "shouts", "plain")


def _of_words(words: list[str]) -> np.ndarray:
    raw = [w.encode() for w in words]
    data = np.frombuffer(b"".join(raw), np.uint8)
    end = np.cumsum([len(r) for r in raw])
    return np.unique(span_hashes(data, end - [len(r) for r in raw], end))


_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"*$%&#@^~|<>{}[]\\=+_")] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[0xC3:] = True  # a lead byte of two or more stands for a letter
_SHAPE = np.arange(256, dtype=np.uint64)
_SHAPE[97:123], _SHAPE[65:91], _SHAPE[48:58], _SHAPE[128:] = 97, 65, 48, 97


def stats_of(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(a row of STATS for each text, its number of words)."""
    rows = len(at) - 1

    def count(flag: np.ndarray) -> np.ndarray:
        run = np.concatenate(([0], np.cumsum(flag)))
        return (run[at[1:]] - run[at[:-1]]).astype(float)

    start, end, row = word_spans(data, at)
    words = np.bincount(row, minlength=rows).astype(float)
    some = np.maximum(words, 1)
    low = span_hashes(LOWER[data], start, end)
    same = (low[1:] == low[:-1]) & (row[1:] == row[:-1]) if len(low) else np.zeros(0, bool)
    adjacent = np.bincount(row[1:][same], minlength=rows) / some
    order = np.lexsort((low, row))
    fresh = np.ones(len(low), bool)
    fresh[1:] = (low[order][1:] != low[order][:-1]) | (row[order][1:] != row[order][:-1])
    kinds = np.bincount(row[order][fresh], minlength=rows)
    letters = np.maximum(count(_LETTER[data]), 1)
    stops = np.bincount(row[np.isin(low, _of_words(STOP_WORDS))], minlength=rows) / some
    lower = np.concatenate(([0], np.cumsum((data >= 97) & (data < 123) | (data >= 128))))
    plain = np.bincount(row[(lower[end] - lower[start]) >= 0.75 * (end - start)], minlength=rows) / some
    shouts = count(data == ord("!")) / some
    # variety falls with length, so it is held against what a text of its length has at least
    variety = kinds / np.maximum(some**0.75, 1)
    return np.stack([count(_SYMBOL[data]) / np.maximum(np.diff(at), 1), count(_UPPER[data]) / letters, count(data == ord("|")) / some, adjacent, variety, stops, shouts, plain], axis=1), words


#: For each labeller: votes bad at or beyond the first bound, good at or within the second, else abstains.
BOUNDS = {
    "symbols": (0.03, 0.006),
    "upper": (0.35, 0.12),
    "bars": (0.08, 0.005),
    "adjacent": (0.15, 0.03),
    "variety": (0.35, 0.9),
    "stops": (0.03, 0.12),
    "shouts": (0.15, 0.03),
    "plain": (0.35, 0.7),
}


def votes_of(stats: np.ndarray, words: np.ndarray) -> np.ndarray:
    """1 good, 2 bad, 0 abstains; a text of under 5 words gets no vote."""
    out = np.zeros(stats.shape, np.int64)
    for k, name in enumerate(STATS):
        bad, good = BOUNDS[name]
        x = stats[:, k]
        out[:, k] = np.where(x >= bad, 2, np.where(x <= good, 1, 0)) if bad > good else np.where(x <= bad, 2, np.where(x >= good, 1, 0))
    out[words < 5] = 0
    return out


def estimate(patterns: np.ndarray, counts: np.ndarray, rounds: int = 200) -> tuple[np.ndarray, np.ndarray, float]:
    """Expectation-maximisation for labellers that err independently given the class.

    patterns: (p, labellers) of 0 abstain, 1 good, 2 bad; counts: how often each occurs.  Returns the posterior of
    good for each pattern, the labellers' rates P(vote | class) as (labeller, class bad/good, vote), and P(good).
    Abstaining is missing, not evidence.  Each labeller knows one defect and a bad text has one or two of many, so
    bad is a mixture of kinds, one begun by each labeller: with a single kind, labellers of a rare defect would seem to
    err.  It does not start from the majority: two votes for bad start as bad however many labellers see nothing.
    """
    n, labellers = patterns.shape
    votes = np.stack([patterns == 1, patterns == 2], axis=2).astype(float)
    bad = votes[:, :, 1].sum(axis=1)
    post = np.zeros((n, labellers + 1))  # the last is good
    post[:, labellers] = np.where(bad >= 2, 0.1, 0.9)
    post[:, :labellers] = (1 - post[:, labellers:]) * (votes[:, :, 1] + 0.01) / (votes[:, :, 1] + 0.01).sum(axis=1, keepdims=True)
    strength = np.tile([1.0, 1.0], (labellers + 1, 1))
    strength[labellers] = 19.0, 1.0  # a labeller seldom calls a good text bad
    for _ in range(rounds):
        weight = counts[:, None] * post
        prior = (weight.sum(axis=0) + 0.5) / (counts.sum() + 0.5 * (labellers + 1))
        got = np.einsum("pc,plv->clv", weight, votes) + strength[:, None, :]
        rate = got / got.sum(axis=2, keepdims=True)
        log = np.log(prior) + np.einsum("plv,clv->pc", votes, np.log(rate))
        log -= log.max(axis=1, keepdims=True)
        new = np.exp(log)
        new /= new.sum(axis=1, keepdims=True)
        done = np.abs(new - post).max() < 1e-7
        post = new
        if done:
            break
    weight = counts[:, None] * post
    of_bad = np.einsum("pc,plv->lv", weight[:, :labellers], votes) + 1.0
    rates = np.stack([of_bad / of_bad.sum(axis=1, keepdims=True), rate[labellers]], axis=1)
    return post[:, labellers], rates, float(np.clip(weight[:, labellers].sum() / max(counts.sum(), 1), 0.02, 0.98))


def features_of(data: np.ndarray, at: np.ndarray, stats: np.ndarray) -> np.ndarray:
    """Hashed features of each text, (rows, SLOTS): square roots of relative frequencies, each part of length 1."""
    rows = len(at) - 1
    own = np.repeat(np.arange(rows), np.diff(at))
    out = np.zeros((rows, SLOTS), np.float32)

    def add(values: np.ndarray, width: int, base: int, slots: int) -> None:
        n = len(values) - width + 1
        if n <= 0:
            return
        h = np.zeros(n, U64)
        for j in range(width):
            h = h * U64(0x100) + values[j : n + j]
        inside = own[:n] == own[width - 1 :]
        slot = ((h * U64(0x9E3779B97F4A7C15)) >> U64(40)) % U64(slots)
        got = np.bincount(own[:n][inside] * slots + slot[inside].astype(np.int64), minlength=rows * slots).reshape(rows, slots)
        out[:, base : base + slots] = np.sqrt(got / np.maximum(got.sum(axis=1, keepdims=True), 1))

    add(LOWER[data].astype(U64), 3, 0, TRIGRAMS)
    add(_SHAPE[data], 4, TRIGRAMS, SHAPES)
    # eight bands for each statistic, between the labeller's two bounds and beyond
    for k, name in enumerate(STATS):
        a, b = BOUNDS[name]
        band = np.clip(np.floor((stats[:, k] - b) / (a - b) * 4 + 2), 0, 7).astype(np.int64)
        out[np.arange(rows), TRIGRAMS + SHAPES + 8 * k + band] = 0.5
    return out


@dataclass
class Scorer:
    """A fitted model: the weights and bias of the linear scorer, and what EM found out about the labellers."""

    weights: np.ndarray
    bias: float
    prior: float
    rates: dict[str, list[list[float]]]


def fit_linear(x: np.ndarray, y: np.ndarray, l2: float = 1e-4, rounds: int = 250) -> tuple[np.ndarray, float]:
    """Logistic regression on soft labels y by accelerated gradient steps; both classes weigh alike at most 10 to 1."""
    n = len(y)
    share = np.clip(np.array([(1 - y).sum(), y.sum()]) / max(n, 1), 0.05, 1)
    weight = ((1 - y) / share[0] + y / share[1]) / 2
    weight /= weight.sum()
    x, y, weight = (a.astype(np.float32) for a in (x, y, weight))  # in one precision, or each product copies x
    w, b = np.zeros(x.shape[1], np.float32), 0.0
    vw, vb = w.copy(), b
    rate = 4.0 / max(1e-9, float(np.mean((x**2).sum(axis=1))) + 1)
    for k in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ vw + np.float32(vb), -30, 30)))
        g = weight * (p - y)
        nw, nb = vw - np.float32(rate) * (g @ x + np.float32(l2) * vw), vb - rate * float(g.sum())
        m = np.float32(k / (k + 3))
        vw, vb = nw + m * (nw - w), nb + m * (nb - b)
        w, b = nw, nb
    return w, float(b)


def _arrays(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    data, at = utf8(part.column("_text"))
    stats, words = stats_of(data, at)
    return data, at, stats, words


def fit(docs: DataFrame, text_col: str = "text", train_rows: int = 4096) -> Scorer:
    """Fit on docs: labeller votes and EM over every row, the linear scorer on a sample of ``train_rows`` texts.

    The vote patterns (at most 3 to the power of 8, whatever the input) are counted by Spark and EM runs over the
    counts.  The sample are the texts with the least hashes, each once however many rows have it, so reruns agree; a
    task keeps at most ``train_rows`` hashes and so many texts come to the driver.
    """
    text = docs.select(F.col(text_col).cast("string").alias("_text")).withColumn("_h", F.when(F.col("_text").isNotNull(), F.xxhash64("_text", F.lit("train"))))

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = 3 ** np.arange(len(STATS))
        least = np.zeros(0, np.int64)
        for batch in batches:
            least = np.unique(np.concatenate([least, batch.column("_h").drop_null().to_numpy()]))[:train_rows]
            for part in slices(batch, "_text"):
                _, _, stats, words = _arrays(part)
                pattern, n = np.unique(votes_of(stats, words) @ base, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(pattern), pa.array(n), pa.nulls(len(n), pa.int64())], ["pattern", "n", "h"])
        yield pa.RecordBatch.from_arrays([pa.nulls(len(least), pa.int64()), pa.nulls(len(least), pa.int64()), pa.array(least)], ["pattern", "n", "h"])

    votes = written(text.mapInArrow(lean(vote), "pattern bigint, n bigint, h bigint"), "votes")
    rows = votes.where("pattern is not null").groupBy("pattern").agg(F.sum("n").alias("n")).orderBy("pattern").collect()
    if not rows:
        return Scorer(np.zeros(SLOTS), 0.0, 0.5, {})
    picked = votes.where("h is not null").select("h").distinct().orderBy("h").limit(train_rows).agg(F.max("h")).first()[0]
    discard(votes)
    code = np.array([r.pattern for r in rows])
    patterns = code[:, None] // 3 ** np.arange(len(STATS)) % 3
    counts = np.array([r.n for r in rows], float)
    post, rates, prior = estimate(patterns, counts)
    posterior = dict(zip(code.tolist(), post.tolist()))

    def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = 3 ** np.arange(len(STATS))
        for batch in batches:
            for part in slices(batch, "_text"):
                data, at, stats, words = _arrays(part)
                x = features_of(data, at, stats).astype(np.float16)
                y = [posterior.get(p, prior) for p in (votes_of(stats, words) @ base).tolist()]
                yield pa.RecordBatch.from_arrays([part.column("_h"), pa.array([r.tobytes() for r in x], pa.binary()), pa.array(y)], ["h", "x", "y"])

    once = text.where(F.col("_h") <= F.lit(picked)).groupBy("_h").agg(F.min("_text").alias("_text"))
    sample = sorted(once.mapInArrow(lean(featured), "h bigint, x binary, y double").collect(), key=lambda r: r.h)
    if not sample:
        return Scorer(np.zeros(SLOTS), float(np.log(prior / (1 - prior))), prior, {})
    x = np.stack([np.frombuffer(r.x, np.float16).astype(np.float32) for r in sample])
    w, b = fit_linear(x, np.array([r.y for r in sample], np.float32))
    return Scorer(w, b, prior, {name: rates[k].round(4).tolist() for k, name in enumerate(STATS)})


def score(docs: DataFrame, scorer: Scorer, id_col: str = "doc_id", text_col: str = "text", least: float = LEAST) -> DataFrame:
    """(id_col, n_votes_bad, score, kept) for every row: kept when the scorer's probability of good is ``least`` or
    more.  Null and empty texts and texts without words score 0 and are not kept."""
    kind = docs.schema[id_col].dataType.simpleString()
    weights, bias = scorer.weights.astype(np.float32), scorer.bias

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "_text"):
                data, at, stats, words = _arrays(part)
                p = 1 / (1 + np.exp(-np.clip(features_of(data, at, stats) @ weights + bias, -30, 30)))
                p = np.where(words > 0, p, 0.0).astype(float)
                bad = (votes_of(stats, words) == 2).sum(axis=1)
                yield pa.RecordBatch.from_arrays([part.column("_id"), pa.array(bad), pa.array(p), pa.array(p >= least)], ["_id", "n_votes_bad", "score", "kept"])

    picked = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"))
    return picked.mapInArrow(lean(run), f"_id {kind}, n_votes_bad bigint, score double, kept boolean").withColumnRenamed("_id", id_col)


def accepted(docs: DataFrame, scorer: Scorer, text_col: str = "text", least: float = LEAST) -> DataFrame:
    """The rows of docs that the scorer keeps, with all their columns, in one pass; see ``score``."""
    weights, bias = scorer.weights.astype(np.float32), scorer.bias

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text_col):
                data, at = utf8(part.column(text_col))
                stats, words = stats_of(data, at)
                p = 1 / (1 + np.exp(-np.clip(features_of(data, at, stats) @ weights + bias, -30, 30)))
                yield part.filter(pa.array((words > 0) & (p >= least)))

    return docs.mapInArrow(lean(run), docs.schema)


def classify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", train_rows: int = 4096, least: float = LEAST) -> DataFrame:
    """Fit on docs and score every row of docs; see ``fit`` and ``score``.  Ids may be null or repeated, extra columns
    are ignored, an empty table gives no rows."""
    return score(docs, fit(docs, text_col, train_rows), id_col, text_col, least)


__all__ = ["Scorer", "classify", "estimate", "fit", "fit_linear", "score"]
