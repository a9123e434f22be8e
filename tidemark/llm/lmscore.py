"""Operator 10: cross-entropy difference of two matched bigram models, gathered from and sent back to blocks of text."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import NULL_ID, QUESTION, answered, load, packed, questions, ranges_for, unpacked, write_blocks
from .common import slices, utf8, written
from .textkernel import LOWER, U64, mix, span_hashes, word_spans
from .tokenstore import Attempt, open_store

#: Words that the whole corpus has fewer times share one entry of the vocabulary.
LEAST_COUNT = 2
#: Weight of the unigram model in the bigram's estimate, in words.
PRIOR = 8.0
#: Ids of the target up to which they are broadcast, some 16 bytes each.
BROADCAST_IDS = 1_000_000
UNKNOWN = U64(0x243F6A8885A308D3)
START = U64(0x13198A2E03707344)


def words_of(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of every lower-cased word of a block's rows."""
    out, row = [], 0
    for part in slices(batch, "text"):
        data, at = utf8(part.column("text"))
        start, end, own = word_spans(data, at)
        out.append((span_hashes(LOWER[data], start, end) if len(start) else np.zeros(0, U64), own + row))
        row += part.num_rows
    return np.concatenate([o[0] for o in out]), np.concatenate([o[1] for o in out])


def bigrams_of(word: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Hash of each word with the word before it; a row's first word follows the start sign."""
    before = np.empty(len(word), U64)
    if len(word):
        before[0] = START
        before[1:] = np.where(row[1:] == row[:-1], word[:-1], START)
    return mix(before * U64(0x9E3779B97F4A7C15) ^ mix(word))


def tally(h: np.ndarray, target: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(distinct hashes, place of each h in them, count, count where target)."""
    kinds, which = np.unique(h, return_inverse=True)
    return kinds, which, np.bincount(which, minlength=len(kinds)), np.bincount(which[target], minlength=len(kinds))


def own_counts(which: np.ndarray, row: np.ndarray) -> np.ndarray:
    """How often each entry's own row has its kind."""
    if not len(which):
        return np.zeros(0, np.int64)
    order = np.lexsort((which, row))
    new = np.ones(len(order), bool)
    new[1:] = (which[order][1:] != which[order][:-1]) | (row[order][1:] != row[order][:-1])
    size = np.diff(np.append(np.flatnonzero(new), len(order)))
    out = np.empty(len(order), np.int64)
    out[order] = np.repeat(size, size)
    return out


def marked(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, text_col, in_target): docs, and whether ``target`` has the id (null: no).

    Up to BROADCAST_IDS ids are broadcast, so that texts stay where they are; more are joined by shuffle.
    """
    ids = written(target.select(id_col).dropna().distinct().withColumn("in_target", F.lit(True)), "target")
    few = ids.count() <= BROADCAST_IDS
    return docs.select(id_col, text_col).join(F.broadcast(ids) if few else ids, id_col, "left")


def cross_entropy_difference(docs: DataFrame, target: str, id_col: str = "doc_id", text_col: str = "text", least: float = 0.0) -> DataFrame:
    """(id_col, n_words, target_loss, background_loss, difference, kept) for every row of docs.

    target: an SQL condition on docs that marks the target's documents (null: not).  The background is all of docs.
    Both models are bigram models with Dirichlet smoothing by their unigrams over one vocabulary: the words that docs
    have twice or more, and one entry for all others.  They are matched: the background's counts are scaled to the
    target's number of words, so smoothing weighs alike in both.  A document's own words are taken out of the counts
    that score it, so that having been a training text earns nothing.  Losses are nats for each word;
    difference = target_loss - background_loss, kept where it is at most ``least``.

    Null and empty texts and texts without words have losses and difference 0 and are kept; without any target words
    all differences are 0.  Ids may be null or repeated; extra columns are ignored; an empty table gives no rows.
    All counts cover the whole of docs; words and bigrams are told apart by 64-bit hashes.
    """
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType.simpleString()
    some = f"`{text_col}` rlike '[^\\\\x20\\\\x09-\\\\x0D]'"
    blocks = write_blocks(docs, id_col, text_col, {"target": target, "some": some, "target_some": f"({target}) and {some}"})
    path = blocks.path
    docs_n, docs_t = blocks.table.agg(*[F.coalesce(F.sum(F.col("true")[k]), F.lit(0)) for k in (1, 2)]).first()
    few = ranges_for(blocks.bytes // 64, spark)
    many = ranges_for(blocks.bytes // 8, spark)

    def flags(batch: pa.RecordBatch) -> np.ndarray:
        return batch.column("target").to_numpy(zero_copy_only=False)

    def ask_words(block: int, _: list[bytes]) -> Iterator[pa.RecordBatch]:
        batch = load(path, block)
        word, row = words_of(batch)
        kinds, _, n, t = tally(word, flags(batch)[row] if len(row) else np.zeros(0, bool))
        yield from questions(block, kinds, few, n.astype(np.uint32), t.astype(np.uint32))

    def add(hashes: np.ndarray, which: np.ndarray, values: list[np.ndarray]) -> list[np.ndarray]:
        return [np.bincount(which, weights=v, minlength=len(hashes)).astype(np.uint64) for v in values]

    def add_words(hashes: np.ndarray, which: np.ndarray, values: list[np.ndarray]) -> list[np.ndarray]:
        return [*add(hashes, which, values), np.bincount(which).astype(np.uint32)]  # and how many blocks have the word

    word_counts = written(answered(blocks.each(ask_words, QUESTION), few, add_words), "words")

    def known(batch: pa.RecordBatch, payloads: list[bytes]) -> tuple[np.ndarray, ...]:
        """The block's words with rare ones made one; row; counts of each word in corpus and target."""
        word, row = words_of(batch)
        kinds, which = np.unique(word, return_inverse=True)
        got = [unpacked(p) for p in payloads]
        n, t = (np.concatenate([g[k] for g in got]).astype(np.int64) if got else np.zeros(0, np.int64) for k in (0, 1))
        rare = n < LEAST_COUNT
        kinds = np.where(rare, UNKNOWN, kinds)
        return kinds[which], row, n[which], t[which], rare[which]

    def ask_bigrams(block: int, payloads: list[bytes]) -> Iterator[pa.RecordBatch]:
        batch = load(path, block)
        word, row, _, _, _ = known(batch, payloads)
        flag = flags(batch)[row] if len(row) else np.zeros(0, bool)
        kinds, _, n, t = tally(bigrams_of(word, row), flag)
        yield from questions(block, kinds, many, n.astype(np.uint32), t.astype(np.uint32))

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for payload in batch.column("payload").to_pylist():
                n, t, k = (a.astype(float) for a in unpacked(payload))
                rare = n < LEAST_COUNT  # each block adds its share of a word
                out = [(n / k).sum(), (t / k).sum(), (n / k)[rare].sum(), (t / k)[rare].sum(), (1 / k)[~rare].sum()]
                yield pa.RecordBatch.from_arrays([pa.array([x]) for x in out], ["n", "t", "rare_n", "rare_t", "kinds"])

    got = word_counts.select("payload").mapInArrow(sums, "n double, t double, rare_n double, rare_t double, kinds double").agg(*[F.coalesce(F.round(F.sum(c)), F.lit(0.0)).alias(c) for c in ("n", "t", "rare_n", "rare_t", "kinds")]).first()
    total, of_target, rare_n, rare_t, vocabulary = got
    vocabulary += rare_n > 0
    bigram_counts = written(answered(blocks.each(ask_bigrams, QUESTION, word_counts), many, add), "bigrams")

    both = word_counts.withColumn("place", F.col("place") * 2).unionByName(bigram_counts.withColumn("place", F.col("place") * 2 + 1))

    def rate(batch: pa.RecordBatch, payloads: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row of each word, and its loss under the target and the background."""
        words = [p for p in payloads if p[:1] == b"w"]
        pairs = [unpacked(p[1:]) for p in payloads if p[:1] == b"b"]
        word, row, n1, t1, rare = known(batch, [p[1:] for p in words])
        n1, t1 = np.where(rare, rare_n, n1), np.where(rare, rare_t, t1)
        flag = flags(batch)[row] if len(row) else np.zeros(0, bool)
        kinds, which = np.unique(bigrams_of(word, row), return_inverse=True)
        n2, t2 = (np.concatenate([g[k] for g in pairs]).astype(np.int64)[which] if pairs else np.zeros(0, np.int64) for k in (0, 1))
        own1, own2 = own_counts(np.unique(word, return_inverse=True)[1], row), own_counts(which, row)
        first = np.ones(len(row), bool)
        first[1:] = row[1:] != row[:-1]

        def context(count: np.ndarray, starts: int) -> np.ndarray:
            out = np.empty(len(count))
            out[1:] = count[:-1]
            out[first] = starts
            return out

        own_context = context(own1, 1)
        length = np.bincount(row, minlength=batch.num_rows)[row]
        losses = []
        for c1, c2, size, starts, mine in ((t1, t2, of_target, docs_t, flag), (n1, n2, total, docs_n, np.ones(len(row), bool))):
            scale = of_target / max(size, 1)
            uni = (np.maximum(c1 - own1 * mine, 0) * scale + 1.0) / (np.maximum(size - length * mine, 0) * scale + vocabulary)
            over = np.maximum(c2 - own2 * mine, 0) * scale + PRIOR * uni
            under = np.maximum(context(c1, starts) - own_context * mine, 0) * scale + PRIOR
            losses.append(-np.log(over / under))
        return row, losses[0], losses[1]

    def finish(block: int, payloads: list[bytes]) -> Iterator[pa.RecordBatch]:
        batch = load(path, block)
        row, target_loss, background_loss = rate(batch, payloads)
        n = np.bincount(row, minlength=batch.num_rows)
        t, b = (np.bincount(row, weights=x, minlength=batch.num_rows) / np.maximum(n, 1) for x in (target_loss, background_loss))
        difference = t - b if of_target else np.zeros(len(n))
        ids = batch.column("id").to_numpy()
        yield pa.RecordBatch.from_arrays([pa.array(ids, mask=ids == NULL_ID), pa.array(n), pa.array(t), pa.array(b), pa.array(difference)], ["id", "n_words", "target_loss", "background_loss", "difference"])

    marked = both.withColumn("payload", F.concat(F.when(F.col("place") % 2 == 0, F.lit(b"w")).otherwise(F.lit(b"b")), F.col("payload")))
    done = blocks.each(finish, "id bigint, n_words bigint, target_loss double, background_loss double, difference double", marked)
    return done.select(F.col("id").cast(kind).alias(id_col), "n_words", "target_loss", "background_loss", "difference", (F.col("difference") <= least).alias("kept"))
