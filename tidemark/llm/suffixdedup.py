"""Operator 9: remove repeated passages by a collection's Burrows-Wheeler transform, built column by column.

Every 50-byte string has one anchor: the 20 bytes in it with the least hash (the leftmost of equals).  Neighbouring
strings with one anchor make up a piece of 50 to 80 bytes, and equal strings lie in pieces of equal anchors.  So pieces
are dealt by anchor, and each deal is a collection of short documents whose transform is built in memory-sized files:
each round inserts one symbol of every piece and updates transform and common prefixes (``column_wise``).
Pieces whose anchor occurs in one document only can match nothing and are left out first.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import NULL_ID, QUESTION, answered, load, packed, questions, range_edges, ranges_for, unpacked, write_blocks
from .common import lean, slices, utf8, written
from .textkernel import U64, mix, span_hashes
from .tokenstore import Attempt, open_store

LENGTH = 50
ANCHOR = 20
#: Pieces of one collection, on average at most (an anchor's pieces stay together), and bytes of text for each deal.
COLLECTION = 1 << 14
DEAL_BYTES = 8 << 20


# --- anchors and pieces ------------------------------------------------------------------------------------------


def pieces_of(data: np.ndarray, at: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, row, anchor hash) of every piece of the texts data[at[i]:at[i+1]].

    A piece data[start:end] holds the neighbouring strings of ``length`` bytes that have the same anchor occurrence's
    hash; pieces overlap, their strings don't.
    """
    n, none = len(data), np.zeros(0, np.int64)
    if n < length:
        return none, none, none, none.view(U64)
    x = data.astype(U64)
    p = 0x9E3779B97F4A7C15
    width = 1
    while width * 2 <= ANCHOR:  # hashes of 1, 2, 4, 8, 16 bytes
        x = x[:-width] * U64(pow(p, width, 1 << 64)) + x[width:]
        width *= 2
    if width < ANCHOR:  # and of all of them, by two that overlap
        x = x[: width - ANCHOR] * U64(0xD6E8FEB86659FD93) + x[ANCHOR - width :]
    x = mix(x)
    reach, width = length - ANCHOR + 1, 1
    while width * 2 <= reach:
        x = np.minimum(x[:-width], x[width:])
        width *= 2
    if reach > width:
        x = np.minimum(x[: width - reach], x[reach - width :])
    # x[i]: the least anchor hash of data[i:i+length]
    row = np.repeat(np.arange(len(at) - 1), np.diff(at))
    inside = row[: len(x)] == row[length - 1 :]
    new = np.ones(len(x), bool)
    new[1:] = (x[1:] != x[:-1]) | (row[1 : len(x)] != row[: len(x) - 1])
    # a run of equal anchors may not be longer than one occurrence allows, or periodic text would make long pieces
    first = np.flatnonzero(new)
    run = np.arange(len(x)) - np.repeat(first, np.diff(np.append(first, len(x))))
    long = run >= reach
    if long.any():
        new |= long & (run % reach == 0)
    start = np.flatnonzero(new)
    end = np.append(start[1:], len(x))
    ok = inside[start]
    # strings that would cross a row's end are the last of their row
    last = at[1:][row[start[ok]]]
    start, end = start[ok], np.minimum(end[ok] + length - 1, last)
    return start, end, row[start], mix(x[start])  # least hashes are small: mixed, they spread evenly over the ranges


# --- the transform -----------------------------------------------------------------------------------------------


def column_wise(text: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All suffixes of the documents text[start:end] in order: (document, length, common prefix with the one before).

    Round j inserts the suffix of length j of every document that has one.  The transform (the symbol before each
    suffix) tells where: the new suffix stands as far into its symbol's part as its tail stands among the tails with
    that symbol, a rank that one sequential scan gives.  The new suffix' common prefix is one more than the least
    between its tail and the nearest tail before it with the same symbol; the suffix after it is updated alike.
    """
    m = len(start)
    size = end - start
    there = np.zeros(256, bool)
    there[text] = True
    if there.all():
        raise ValueError("UTF-8 texts have fewer kinds of bytes")
    symbol = np.cumsum(there).astype(np.uint8)[text]  # 0: the end marker

    def column(which: np.ndarray, j: int) -> np.ndarray:
        """The symbol before the suffix of length j."""
        place = end[which] - 1 - j
        return np.where(place >= start[which], symbol[np.maximum(place, 0)], 0).astype(np.uint8)

    before = column(np.arange(m), 0)
    common = np.zeros(m, np.uint8)
    name = np.arange(m, dtype=np.int32) << 8  # document and length
    pending = np.arange(m)  # where the suffixes of the last round stand
    for j in range(1, int(size.max(initial=0)) + 1):
        n = len(before)
        fresh = np.zeros(n, bool)
        fresh[pending[before[pending] > 0]] = True
        order = np.argsort(before, kind="stable")
        ended = n - np.count_nonzero(before)
        rank = np.flatnonzero(fresh[order])
        tail = order[rank]
        # common prefixes of the new suffixes and of those right after them
        touched = np.zeros(n + 1, bool)
        touched[rank] = touched[rank + 1] = True
        touched[n] = False
        k = np.flatnonzero(touched)
        k = k[k > ended]
        low, high = order[k - 1], order[k]
        same = before[low] == before[high]
        k, low, high = k[same], low[same], high[same]
        down = np.argsort(-low)
        span = np.empty(2 * len(k), np.int64)
        span[0::2], span[1::2] = low[down] + 1, high[down] + 1
        least = np.minimum.reduceat(np.append(common, np.uint8(0)), span)[0::2] if len(k) else np.zeros(0, np.uint8)
        # insert
        at = m + rank - ended
        total = m + n - ended
        old = np.ones(total, bool)
        old[at] = False
        which = name[tail] >> 8
        grown = np.empty(total, np.uint8), np.empty(total, np.uint8), np.empty(total, np.int32)
        for new, was in zip(grown, (before, common, name)):
            new[old] = was
        grown[0][at] = column(which, j)
        grown[1][at] = 0
        grown[2][at] = which << 8 | j
        changed = np.flatnonzero(touched)
        changed = changed[changed >= ended]
        grown[1][m + changed - ended] = 0
        grown[1][m + k[down] - ended] = least + np.uint8(1)
        before, common, name = grown
        pending = at
    return name >> 8, name & 255, common


def least_owner(text: np.ndarray, start: np.ndarray, end: np.ndarray, owner: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """For every string of ``length`` bytes of every document: the least owner of an equal string in the collection.

    Returns (edge, least): the strings of document i are least[edge[i]:edge[i+1]], from its start on.
    """
    doc, size, common = column_wise(text, start, end)
    long = np.flatnonzero(size >= length)  # suffixes too short to hold a string stand apart from those that share one
    head = np.ones(len(long), bool)
    cut = np.concatenate(([0], np.cumsum(common < length)))
    head[1:] = cut[long[1:] + 1] != cut[long[:-1] + 1]
    strings = np.maximum(end - start - length + 1, 0)
    edge = np.concatenate(([0], np.cumsum(strings)))
    least = np.zeros(edge[-1], np.int64)
    if len(long):
        first = np.flatnonzero(head)
        low = np.minimum.reduceat(owner[doc[long]], first)
        where = edge[doc[long]] + (end - start)[doc[long]] - size[long]
        least[where] = np.repeat(low, np.diff(np.append(first, len(long))))
    return edge, least


# --- the operator ------------------------------------------------------------------------------------------------


def _pieces(batch: pa.RecordBatch) -> tuple[np.ndarray, ...]:
    """(start, end, owner, anchor) of all pieces of a block; places count from the block's first byte."""
    ids = batch.column("id").to_numpy()
    out, row, base = [], 0, 0
    for part in slices(batch, "text"):
        data, at = utf8(part.column("text"))
        start, end, own, anchor = pieces_of(data, at)
        out.append((start + base, end + base, ids[own + row], anchor))
        row, base = row + part.num_rows, base + len(data)
    start, end, owner, anchor = (np.concatenate([o[k] for o in out]) for k in range(4))
    return start, end, owner, anchor.astype(U64)


def _anchors(owner: np.ndarray, anchor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A block's anchors, distinct and ascending, and whether two documents of the block have it."""
    order = np.argsort(anchor, kind="stable")
    h, d = anchor[order], owner[order]
    if not len(h):
        return h, np.zeros(0, bool)
    first = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
    return h[first], np.minimum.reduceat(d, first) != np.maximum.reduceat(d, first)


def _text_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, step: int = 10_000) -> np.ndarray:
    """Hashes of pieces in ascending places, few at a time as the running sums take 8 bytes and more for each byte."""
    return np.concatenate([span_hashes(data[start[k] : end[min(k + step, len(end)) - 1]], start[k : k + step] - start[k], end[k : k + step] - start[k]) for k in range(0, len(start), step)])


def _same(data: np.ndarray, start: np.ndarray, size: np.ndarray, other: np.ndarray, step: int = 20_000) -> np.ndarray:
    """Whether data[start : start + size] and data[other : other + size] agree byte for byte, for each of many."""
    out = np.ones(len(start), bool)
    for k in range(0, len(start), step):
        n = size[k : k + step].astype(np.int64)
        if len(n):
            differ = data[_expand(start[k : k + step], n)] != data[_expand(other[k : k + step], n)]
            out[k : k + step] = ~np.logical_or.reduceat(differ, np.cumsum(n) - n)
    return out


def _merged(data: np.ndarray, start: np.ndarray, size: np.ndarray, owner: np.ndarray, anchor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(one, of): equal pieces once, by (anchor, hash) with the least owner of each, and the place of every piece in it.

    Pieces of one hash are compared byte for byte; where they differ none of that hash is merged.
    """
    text = _text_hashes(data, start, start + size)
    order = np.lexsort((owner, text, anchor))
    new = np.ones(len(order), bool)
    new[1:] = (anchor[order][1:] != anchor[order][:-1]) | (text[order][1:] != text[order][:-1])
    head = order[new][np.cumsum(new) - 1]  # in order: the first piece of each run
    alike = size[order] == size[head]
    alike[alike] = _same(data, start[order[alike]], size[order[alike]], start[head[alike]])
    if not alike.all():
        mixed = np.isin(text[order], text[order][~alike])
        new |= mixed
    of = np.empty(len(order), np.int64)
    of[order] = np.cumsum(new) - 1
    return order[new], of


def _expand(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """start[i], start[i]+1, ... n[i] of them, end to end."""
    edge = np.cumsum(n) - n
    return np.arange(int(n.sum())) - np.repeat(edge - start, n)


def covered(at: np.ndarray, ids: np.ndarray, place: np.ndarray, number: np.ndarray, runs: np.ndarray, run: np.ndarray, owner: np.ndarray, step: int = 50_000) -> np.ndarray:
    """Whether each byte of the texts with edges ``at`` lies in a string whose least owner is smaller than its own text's id.

    place, number: where each piece starts, and which one it is; runs: how many runs of strings with one least owner each
    different piece has, in ``run`` and ``owner``.  A block is counted in place, four bytes for each of its own.
    """
    edge = np.concatenate(([0], np.cumsum(runs, dtype=np.int64)))
    change = np.zeros(int(at[-1]) + 1, np.int32)
    for k in range(0, len(place), step):
        p, num = place[k : k + step], number[k : k + step].astype(np.int64)
        n = runs[num].astype(np.int64)
        which = _expand(edge[num], n)
        length = run[which].astype(np.int64)
        done = np.cumsum(length) - length
        first = np.repeat(p - done[np.cumsum(n) - n], n) + done  # where each run of strings starts
        mine = np.repeat(ids[np.searchsorted(at, p, side="right") - 1], n)
        bad = owner[which] < mine
        np.add.at(change, first[bad], 1)
        np.add.at(change, first[bad] + length[bad] + LENGTH - 1, -1)
    return np.cumsum(change[:-1], dtype=np.int32, out=change[:-1]) > 0


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(id_col, n_bytes, n_removed, n_spans, kept): each text as UTF-8 bytes without its repeated passages.

    keep: further columns of docs to return; small ones, as they travel with the texts.

    A byte goes if a 50-byte string that covers it also starts in a document with a smaller id; strings are judged on
    the input.  kept has the remaining bytes (binary: a cut may split a character).  Null and empty texts have 0 bytes;
    texts under 50 bytes stay.  A null id counts as larger than all others and comes back null; rows with one id never
    remove from each other.  Repeated rows each give a row, extra columns are ignored, an empty table gives no rows.
    """
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType.simpleString()
    blocks = write_blocks(docs, id_col, text_col, keep={f"keep_{k}": f"`{c}`" for k, c in enumerate(keep)})
    path = blocks.path
    extra = [f"keep_{k}" for k in range(len(keep))]
    ranges = ranges_for(blocks.bytes // 18, spark)

    def ask(block: int, _: list[bytes]) -> Iterator[pa.RecordBatch]:
        _, _, owner, anchor = _pieces(load(path, block))
        yield from questions(block, _anchors(owner, anchor)[0], ranges)

    def shared(hashes: np.ndarray, which: np.ndarray, _: list) -> list[np.ndarray]:
        return [np.bincount(which, minlength=len(hashes)) > 1]

    answers = answered(blocks.each(ask, QUESTION), ranges, shared)

    deals = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-blocks.bytes // DEAL_BYTES))

    def cut(block: int, payloads: list[bytes]) -> Iterator[pa.RecordBatch]:
        """Deal the block's pieces with shared anchors, each text once with its least id; keep their places."""
        batch = load(path, block)
        start, end, owner, anchor = _pieces(batch)
        anchors, many = _anchors(owner, anchor)
        flag = np.concatenate([unpacked(p)[0] for p in payloads]) if payloads else np.zeros(0, bool)
        wanted = anchors[flag | many]
        if not len(wanted):
            return
        hit = wanted[np.minimum(np.searchsorted(wanted, anchor), len(wanted) - 1)] == anchor
        start, end, owner, anchor = start[hit], end[hit], owner[hit], anchor[hit]
        data, _ = utf8(batch.column("text"))
        one, number = _merged(data, start, end - start, owner, anchor)
        number = number.astype(np.uint32)
        file = Attempt(path, f"pieces-{block}.bin")
        file.out.write(packed(start, number))
        file.close()
        for place, lo, hi in range_edges(anchor[one], deals):
            some = one[lo:hi]
            size = end[some] - start[some]
            payload = packed(anchor[some], size.astype(np.uint8), owner[some], data[_expand(start[some], size)])
            yield pa.RecordBatch.from_arrays([pa.array([place]), pa.array([block]), pa.array([payload], pa.binary())], ["place", "block", "payload"])

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One deal after the other."""
        now, blocks, blobs = None, [], []
        for batch in batches:
            for place, block, payload in zip(*(batch.column(k).to_pylist() for k in ("place", "block", "payload"))):
                if place != now:
                    if blobs:
                        yield from solve(now, blocks, blobs)
                    now, blocks, blobs = place, [], []
                blocks.append(block)
                blobs.append(unpacked(payload))
        if blobs:
            yield from solve(now, blocks, blobs)

    def solve(place: int, blocks: list[int], blobs: list[list[np.ndarray]]) -> Iterator[pa.RecordBatch]:
        """Tell each block the least owner of every string of the pieces that it sent."""
        anchor, size, owner, data = (np.concatenate([b[k] for b in blobs]) for k in range(4))
        end = np.cumsum(size.astype(np.int64))
        start = end - size
        one, of = _merged(data, start, size.astype(np.int64), owner, anchor)  # each different piece once, with its least owner
        a = anchor[one]
        head = np.flatnonzero(np.concatenate(([True], a[1:] != a[:-1])))
        members = np.diff(np.append(head, len(a)))
        strings = size[one].astype(np.int64) - LENGTH + 1
        edge = np.concatenate(([0], np.cumsum(strings)))
        # an anchor that has one piece, once equal ones are merged, has none to compare it with
        least = np.repeat(owner[one], strings)
        rest = np.flatnonzero(np.repeat(members, members) > 1)
        stops = np.flatnonzero(np.concatenate((a[rest][1:] != a[rest][:-1], [True]))) + 1 if len(rest) else []
        lo = 0
        while lo < len(rest):
            hi = int(stops[max(np.searchsorted(stops, lo + COLLECTION, side="right") - 1, np.searchsorted(stops, lo, side="right"))])
            mine = rest[lo:hi]
            some = one[mine]
            n = size[some].astype(np.int64)
            stop = np.cumsum(n)
            _, got = least_owner(data[_expand(start[some], n)], stop - n, stop, owner[some])
            least[_expand(edge[mine], strings[mine])] = got
            lo = hi
        sent = np.concatenate(([0], np.cumsum([len(b[0]) for b in blobs])))
        for k, block in enumerate(blocks):
            mine = of[sent[k] : sent[k + 1]]
            n = strings[mine]
            g = least[_expand(edge[mine], n)]
            first_of = np.cumsum(n) - n
            head = np.ones(len(g), bool)  # runs of equal owners
            head[1:] = g[1:] != g[:-1]
            head[first_of] = True
            first = np.flatnonzero(head)
            payload = packed(np.add.reduceat(head.astype(np.uint8), first_of), np.diff(np.append(first, len(g))).astype(np.uint8), g[first])
            yield pa.RecordBatch.from_arrays([pa.array([block]), pa.array([place]), pa.array([payload], pa.binary())], ["block", "place", "payload"])

    sent = blocks.each(cut, QUESTION, answers).repartition(deals, "place").sortWithinPartitions("place", "block")
    told = written(sent.mapInArrow(lean(match), "block bigint, place bigint, payload binary"), "owners")

    def finish(block: int, payloads: list[bytes]) -> Iterator[pa.RecordBatch]:
        batch = load(path, block)
        gone = None
        if payloads:
            store, folder = open_store(path)
            with store.open_input_file(f"{folder}/pieces-{block}.bin") as f:
                place, number = unpacked(f.read())
            got = [unpacked(p) for p in payloads]  # deals in order, so pieces in the order of their numbers
            runs, run, owner = (np.concatenate([g[k] for g in got]) for k in range(3))
            _, at = utf8(batch.column("text"))
            gone = covered(at, batch.column("id").to_numpy(), place, number, runs, run, owner)
        base = 0
        for part in slices(batch, "text"):
            data, at = utf8(part.column("text"))
            out = gone[base : base + len(data)] if gone is not None else np.zeros(len(data), bool)
            base += len(data)
            run = np.concatenate(([0], np.cumsum(out)))
            head = out.copy()
            head[1:] &= ~out[:-1]
            inner = at[1:-1][at[1:-1] < len(data)]
            head[inner] = out[inner]
            heads = np.concatenate(([0], np.cumsum(head)))
            removed = run[at[1:]] - run[at[:-1]]
            left = data[~out]
            off = at - run[at]
            kept = pa.Array.from_buffers(pa.large_binary(), part.num_rows, [None, pa.py_buffer(off.astype(np.int64).tobytes()), pa.py_buffer(left.tobytes())]).cast(pa.binary())
            ids = part.column("id").to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(ids, mask=ids == NULL_ID), pa.array(np.diff(at)), pa.array(removed), pa.array(heads[at[1:]] - heads[at[:-1]]), kept, *[part.column(k) for k in extra]], ["id", "n_bytes", "n_removed", "n_spans", "kept", *extra])

    kinds = "".join(f", {e} {docs.schema[c].dataType.simpleString()}" for e, c in zip(extra, keep))
    done = blocks.each(finish, f"id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept binary{kinds}", told)
    return done.select(F.col("id").cast(kind).alias(id_col), "n_bytes", "n_removed", "n_spans", "kept", *[F.col(e).alias(c) for e, c in zip(extra, keep)])


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The digest of ``remove_repeats``: kept_sha256 in place of kept."""
    return remove_repeats(docs, id_col, text_col).select(id_col, "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
