"""Benchmark decontamination by SimHash over item-sized windows.

Words are lower-cased runs of letters and digits. An item of n words is cut into STEP windows of one size of a ladder just
below n, an item over MOST words into such groups of STEP windows at every SPREAD words and at its end; documents are cut into
windows of every size in use, one each STEP words, so a passage that repeats an item, or a part of a long one, has a document window
that lines up with one of the item's. Windows get 64-bit SimHash fingerprints of their words. The fingerprint is
split into BLOCKS blocks; two fingerprints within RADIUS bits differ in at most RADIUS // BLOCKS bits of some block, so looking
up every block in the item's blocks with that many bits flipped finds all fingerprints within the radius. Candidates are
verified exactly: the weighted Jaccard similarity of the 5-word shingles (weights: how often each occurs) of the item and of the
aligned document words must reach LEAST. Before, candidates are dropped whose document words hold fewer shingles of any item than
that needs, which loses none. Items of fewer than STEP words have too few windows to line up with those of a document, so
they are looked up word for word at every place.

Fingerprints of all windows come from running sums: eight 64-bit words hold the 64 counters in bytes, and differences of running
sums are exact because no window has over 255 words. Larger items are fingerprinted all over by windows of 255 words, so that any part
without edits proposes them wherever the edits are, and verified whole.

Items travel to the tasks as texts, in blocks of at most PASS_PRINTS fingerprints, one pass over the documents for each, so a benchmark of
any size is handled; a worker builds the index of one block at a time, some 2,200 bytes a fingerprint.

Defined cases: null and empty texts and items match nothing; items of fewer than 5 words must be found word for word as a whole;
repeated items match each on its own; repeated rows repeat their matches; of several places in a document the best is
reported, of equals the first; very long texts are searched whole, at their own size in memory; a null doc_id is kept, and so is an item with a
null item_id; further columns are ignored; an empty table, of documents or items, gives an empty result.
"""

from __future__ import annotations

import uuid
from collections import Counter
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkstone.llm.common import map_batches, texts_of
from inkstone.llm.words import U, chunks, grams

STEP, LADDER, MOST = 4, 1.12, 255
#: Words from one group of windows to the next in items of over MOST words.
SPREAD = 64
RADIUS, BLOCKS = 11, 4
SHINGLE, LEAST = 5, 0.8
#: Fingerprints in one pass: bounds a worker's index to about 130 MB.
PASS_PRINTS = 60_000
#: Bytes of text handled at a time: their running sums stay in the processor's cache.
PART = 1 << 18

NOT_WORD = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
LANES = U(0x0101010101010101)


def sizes(longest: int = MOST) -> list[int]:
    out, x = [1], 1.0
    while out[-1] < longest:
        x *= LADDER
        if int(x) > out[-1]:
            out.append(min(int(x), longest))
    return out


def size_for(n: int) -> int:
    """The window size of an item of n words: leaves room for STEP windows where the item is long enough."""
    return max(s for s in sizes() if s <= max(1, n - STEP + 1))


def window_places(n: int, size: int) -> np.ndarray:
    """First words of the windows of an item of n words: STEP in a row from its start, in a long item also from every SPREAD-th word and up to its end."""
    last = n - size
    if size < MOST:
        return np.arange(min(STEP, last + 1))
    groups = np.append(np.arange(0, last - STEP + 1, SPREAD), max(0, last - STEP + 1))
    return np.unique(np.minimum(groups[:, None] + np.arange(STEP)[None, :], last))


def running(h: np.ndarray) -> list[np.ndarray]:
    """Running sums of the bits of h; array j counts bits j, j + 8, ... in its bytes."""
    out = []
    for j in range(8):
        total = np.zeros(len(h) + 1, U)
        np.cumsum((h >> U(j)) & LANES, out=total[1:])
        out.append(total)
    return out


def fingerprints(sums: list[np.ndarray], at: np.ndarray, size: int) -> np.ndarray:
    """SimHash of the windows of size words at the given places: a bit is set where over half of the words have it."""
    out = np.zeros(len(at), U)
    need, high = size // 2 + 1, U(0x8080808080808080)
    for j, total in enumerate(sums):
        count = total[at + size] - total[at]
        if need > 128:  # compare in two steps, as bytes can't hold count + 128
            over = ((count & ~high) + LANES * U(256 - need)) & count & high
        else:
            over = (((count & ~high) + LANES * U(128 - need)) | count) & high
        out |= (over >> U(7)) << U(j)
    return out


class Index:
    """Fingerprints of item windows by window size, with one table of items by value for each block; short items by their hash."""

    def __init__(self, items: list[tuple[int | None, str]]):
        self.words: list[np.ndarray] = []
        self.ids = [i for i, _ in items]
        self.shingles: list[Counter] = []
        prints: dict[int, list[tuple[int, int, int]]] = {}
        short: dict[int, dict[int, list[int]]] = {}
        for c in chunks(pc.utf8_lower(pa.array([t for _, t in items], pa.string())), separator=NOT_WORD) if items else []:
            h = c.hashes(seed=41)
            for r in range(c.rows):
                own = h[c.first[r] : c.first[r + 1]]
                k = len(self.words)
                self.words.append(own)
                self.shingles.append(weigh(own))
                if 0 < len(own) < STEP:
                    short.setdefault(len(own), {}).setdefault(int(grams(own, len(own), 43)[0]), []).append(k)
                elif len(own):
                    size = size_for(len(own))
                    at = window_places(len(own), size)
                    for a, f in zip(at, fingerprints(running(own), at, size), strict=True):
                        prints.setdefault(size, []).append((int(f), k, int(a)))
        self.sizes = {s: Blocks(p) for s, p in prints.items()}
        self.short = {n: (np.array(sorted(by), U), by) for n, by in short.items()}
        self.lengths = np.array([len(w) for w in self.words], np.int64)
        # A bit for each hash of a shingle of any item; others may share it.
        every = np.concatenate([np.zeros(0, U), *(grams(w, SHINGLE, 47) for w in self.words)])
        self.shift = U(64 - min(26, max(16, 4 + len(every).bit_length())))
        self.held = np.zeros(1 << (64 - int(self.shift)), bool)
        self.held[every >> self.shift] = True

    def shingles_up_to(self, h: np.ndarray) -> np.ndarray:
        """Running count of the places where a shingle begins that an item may hold."""
        out = np.zeros(len(h) + 1, np.int64)
        found = self.held[grams(h, SHINGLE, 47) >> self.shift]
        np.cumsum(found, out=out[1 : len(found) + 1])
        out[len(found) + 1 :] = out[len(found)]
        return out


class Blocks:
    def __init__(self, prints: list[tuple[int, int, int]]):
        self.prints = np.array([p[0] for p in prints], U)
        self.owner = np.array([p[1] for p in prints])
        self.offset = np.array([p[2] for p in prints])
        width = 64 // BLOCKS
        flips = [0, *(sum(1 << b for b in bits) for n in range(1, RADIUS // BLOCKS + 1) for bits in combinations(range(width), n))]
        self.first, self.lists = [], []
        for b in range(BLOCKS):
            value = ((self.prints >> U(b * width)) & U((1 << width) - 1)).astype(np.int64)
            key = (value[:, None] ^ np.array(flips)[None, :]).ravel()
            which = np.repeat(np.arange(len(self.prints), dtype=np.int32), len(flips))
            self.lists.append(which[np.argsort(key, kind="stable")])
            self.first.append(np.concatenate([[0], np.cumsum(np.bincount(key, minlength=1 << width))]).astype(np.int32))

    def near(self, f: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place in f, number of the item window) of every pair within RADIUS bits."""
        width, at, found = 64 // BLOCKS, [], []
        for b in range(BLOCKS):
            value = ((f >> U(b * width)) & U((1 << width) - 1)).astype(np.int64)
            first = self.first[b]
            lo = first[value]
            n = first[value + 1] - lo
            some = np.flatnonzero(n)
            lo, n = lo[some], n[some]
            a = np.repeat(some, n)
            w = self.lists[b][np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())]
            close = np.bitwise_count(f[a] ^ self.prints[w]) <= RADIUS
            at.append(a[close])
            found.append(w[close].astype(np.int64))
        pair = np.unique(np.concatenate(at) * len(self.prints) + np.concatenate(found))
        return pair // len(self.prints), pair % len(self.prints)


def weigh(h: np.ndarray) -> Counter:
    """Shingles of SHINGLE words with their counts; a shorter sequence is one shingle."""
    k = min(SHINGLE, len(h))
    return Counter(zip(*(h[j : len(h) - k + 1 + j].tolist() for j in range(k)), strict=True)) if k else Counter()


def similarity(a: Counter, b: Counter) -> float:
    both = sum(min(n, b[s]) for s, n in a.items() if s in b)
    total = sum(a.values()) + sum(b.values()) - both
    return both / total if total else 0.0


def matches(index: Index, column: pa.Array):
    """(row, number of the item, similarity, first word) of the best place of each item in each text."""
    for c in chunks(pc.utf8_lower(column), PART, NOT_WORD):
        h = c.hashes(seed=41)
        if not len(h):
            continue
        sums, held = running(h), index.shingles_up_to(h)
        row = np.repeat(np.arange(c.rows), np.diff(c.first))
        place = np.arange(len(h)) - c.first[row]
        strided = np.flatnonzero(place % STEP == 0)
        left = c.first[row[strided] + 1] - strided
        best: dict[tuple[int, int], tuple[float, int]] = {}
        seen: set[tuple[int, int, int]] = set()
        for size, blocks in index.sizes.items():
            at = strided[left >= size]
            if not len(at):
                continue
            where, which = blocks.near(fingerprints(sums, at, size))
            item, own = blocks.owner[which], row[at[where]]
            low, high = c.first[own], c.first[own + 1]
            start = np.clip(at[where] - blocks.offset[which], low, high)
            last = np.maximum(start, np.minimum(high, start + index.lengths[item]) - SHINGLE + 1)
            enough = held[last] - held[start] >= LEAST * (index.lengths[item] - SHINGLE + 1) - 1e-9
            enough |= index.lengths[item] < SHINGLE
            for r, item, start, high in zip(*(x[enough].tolist() for x in (own, item, start, high)), strict=True):
                if (r, item, start) in seen:
                    continue
                seen.add((r, item, start))
                s = similarity(index.shingles[item], weigh(h[start : min(high, start + len(index.words[item]))]))
                if s >= LEAST and (s, -start) > best.get((r, item), (0.0, 0)):
                    best[(r, item)] = (s, -start)
        for n, (keys, by) in index.short.items():
            if len(h) < n:
                continue
            g = grams(h, n, 43)
            at = np.flatnonzero(np.isin(g, keys) & (row[: len(g)] == row[n - 1 :]))
            # Of each row and hash the first place.
            for w in at[np.unique(np.stack([row[at].astype(U), g[at]]), axis=1, return_index=True)[1]].tolist():
                for item in by[int(g[w])]:
                    if np.array_equal(index.words[item], h[w : w + n]):
                        best[(int(row[w]), item)] = (1.0, -w)
        for (r, item), (s, start) in sorted(best.items()):
            yield c.row + r, item, s, -start - int(c.first[r])


def passes(benchmark: DataFrame) -> list[DataFrame]:
    """The benchmark in blocks whose fingerprints are bounded: STEP windows an item, of long ones two groups and one more for every SPREAD words of at least two characters."""
    prints = benchmark.where("text is not null").agg(F.sum(3 * STEP + F.length("text") * STEP / (2 * SPREAD))).first()[0] or 0
    n = 1 + int(prints) // PASS_PRINTS
    return [benchmark.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == i) for i in range(n)]


def items_of(block: DataFrame) -> list[tuple[int | None, str]]:
    rows = block.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("text is not null").collect()
    return sorted(((r.item_id, r.text) for r in rows), key=lambda x: (x[0] is None, x[0] or 0, x[1]))


_latest: list = ["", None]


def index_of(block: tuple[str, list[tuple[int | None, str]]]) -> Index:
    """The index of a block (name, items); a worker holds the one it used last."""
    if _latest[0] != block[0]:
        _latest[:] = ["", None]
        _latest[:] = [block[0], Index(block[1])]
    return _latest[1]


def find_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, similarity, first_word of every item that a document holds."""
    spark, texts, out = docs.sparkSession, texts_of(docs), None
    for block in passes(benchmark):
        shared = spark.sparkContext.broadcast((uuid.uuid4().hex, items_of(block)))

        def run(batches, shared=shared):
            index = index_of(shared.value)
            for batch in batches:
                found = list(matches(index, batch.column("text")))
                yield pa.RecordBatch.from_pydict({
                    "doc_id": batch.column("doc_id").take(pa.array([f[0] for f in found], pa.int64())), "item_id": pa.array([index.ids[f[1]] for f in found], pa.int64()),
                    "similarity": pa.array([f[2] for f in found], pa.float64()), "first_word": pa.array([f[3] for f in found], pa.int64()),
                })

        one = map_batches(texts, run, "doc_id long, item_id long, similarity double, first_word long")
        out = one if out is None else out.unionByName(one)
    return out


def without_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs that hold no item, all columns as they are."""
    for block in passes(benchmark):
        shared = docs.sparkSession.sparkContext.broadcast((uuid.uuid4().hex, items_of(block)))

        def run(batches, shared=shared):
            for batch in batches:
                keep = np.ones(batch.num_rows, bool)
                keep[[f[0] for f in matches(index_of(shared.value), batch.column("text"))]] = False
                yield batch.filter(pa.array(keep))

        docs = map_batches(docs, run, docs.schema)
    return docs
