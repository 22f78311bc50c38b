"""Substring dedup by seed and extend.

Seed: of every WINDOW consecutive words, winnowing picks one anchor, the least hash among the ANCHOR-word grams in the window
(the last of equals), so two equal windows pick the same anchor. Documents are joined on anchor hashes; an anchor that only one
document holds rules out every window that picked it. Extend: a shared anchor is extended word by word to both sides as far as
windows still pick it, and each window so reached is compared by 96-bit hashes of all its words; it is marked where a document of
smaller doc_id holds it too. The next anchor's extension takes over where one ends, so the marked windows that touch or overlap
join to the maximal repeats, none shorter than WINDOW words; these are reported as spans and their words are removed.

Nothing is paired with everything: a batch of documents sends one posting for each distinct hash, that of its least doc_id,
and settles the others on the spot, so a passage that a third of all documents hold costs one posting a batch. Postings move
as packed arrays in buckets of a size that doesn't depend on the input; documents are dealt by doc_id into like buckets.

Marks carry the hash that was matched, not a place, so rows that share a doc_id but not a text don't mix.

Defined cases: null and empty texts have no words and stay; a text of fewer than 13 words has no window and stays; of equal
texts, and of any repeat, the least doc_id keeps its words; rows of one doc_id never remove each other's words, whether their texts
are equal or not, and each loses what documents of smaller doc_id hold; a very long text is handled alone and whole; rows with a
null doc_id neither remove nor lose words; further columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkstone.llm.common import map_batches, texts_of
from inkstone.llm.words import U, chunks, grams

WINDOW, ANCHOR = 13, 5
#: Characters of text in a bucket of documents, on average.
BUCKET_CHARS = 6_000_000
#: Stands for a null doc_id, which takes no part.
NO_ID = np.iinfo(np.int64).min

POSTINGS = "bucket long, settled boolean, docs binary, hashes binary, checks binary, owners binary"
MARKS = "bucket long, docs binary, owners binary, hashes binary"


def pick_anchors(g: np.ndarray, span: int) -> np.ndarray:
    """For each span consecutive grams the place of the least, the last of equals."""
    n = len(g) - span + 1
    least = g[:n].copy()
    at = np.arange(n)
    for j in range(1, span):
        np.minimum(least, g[j : j + n], out=least)
    out = at.copy()
    for j in range(1, span):
        hit = g[j : j + n] == least
        out[hit] = at[hit] + j
    return out


def windows(column: pa.Array):
    """By chunk: (chunk, row of each window, first word of each window, anchor word of each window, gram hashes, word hashes)."""
    for c in chunks(column):
        h = c.hashes(seed=31)
        if len(h) < WINDOW:
            yield c, np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, U), h
            continue
        row = np.repeat(np.arange(c.rows), np.diff(c.first))
        g = grams(h, ANCHOR, 33)
        anchor = pick_anchors(g, WINDOW - ANCHOR + 1)
        start = np.flatnonzero(row[: len(h) - WINDOW + 1] == row[WINDOW - 1 :])
        yield c, row[start], start, anchor[start], g, h


def pack(bucket, settled, docs, hashes, checks, owners) -> dict:
    """One row: docs are this row's doc_ids, owners index them."""
    used, own = np.unique(docs[owners], return_inverse=True)
    return {"bucket": int(bucket), "settled": settled, "docs": used.tobytes(), "hashes": hashes.tobytes(), "checks": checks.tobytes(), "owners": own.astype(np.uint32).tobytes()}


def post(docs: np.ndarray, owner: np.ndarray, hashes: np.ndarray, checks: np.ndarray, buckets: int, settle_least: bool):
    """Rows of POSTINGS from (hash, check, document) of a batch. Of equal hashes the least doc_id is posted by hash; the others,
    which a smaller doc_id is known to share, are settled and dealt by document. With settle_least the least is settled too."""
    order = np.lexsort((docs[owner], checks, hashes))
    h, k, d, o = hashes[order], checks[order], docs[owner][order], owner[order]
    fresh = np.ones(len(h), bool)
    fresh[1:] = (h[1:] != h[:-1]) | (k[1:] != k[:-1])
    new_doc = fresh.copy()
    new_doc[1:] |= d[1:] != d[:-1]
    group = np.cumsum(fresh) - 1
    many = np.bincount(group, new_doc) > 1
    settled = new_doc & (many[group] if settle_least else ~fresh)
    for chosen, key, flag in ((fresh, (h % U(buckets)).astype(np.int64), False), (settled, d % buckets, True)):
        at = np.flatnonzero(chosen)
        at = at[np.argsort(key[at], kind="stable")]
        cuts = np.flatnonzero(np.diff(key[at])) + 1
        for part in np.split(at, cuts) if len(at) else []:
            yield pack(key[part[0]], flag, docs, h[part], k[:0] if flag else k[part], o[part])


POSTINGS_ARROW = pa.schema([("bucket", pa.int64()), ("settled", pa.bool_()), *((n, pa.binary()) for n in ("docs", "hashes", "checks", "owners"))])
MARKS_ARROW = pa.schema([("bucket", pa.int64()), *((n, pa.binary()) for n in ("docs", "owners", "hashes"))])


def doc_ids(column: pa.Array) -> np.ndarray:
    return column.cast(pa.int64()).fill_null(int(NO_ID)).to_numpy(zero_copy_only=False)


def seed_postings(buckets: int):
    """The distinct (anchor hash, document) of each batch."""

    def run(batches):
        for batch in batches:
            ids = doc_ids(batch.column("doc_id"))
            owners, hashes = [np.zeros(0, np.int64)], [np.zeros(0, U)]
            for c, row, _, anchor, g, _ in windows(batch.column("text")):
                at, first = np.unique(anchor, return_index=True)
                live = ids[c.row + row[first]] != NO_ID
                owners.append(c.row + row[first][live])
                hashes.append(g[at[live]])
            h = np.concatenate(hashes)
            yield from pa.Table.from_pylist(list(post(ids, np.concatenate(owners), h, np.zeros(len(h), np.uint32), buckets, True)), POSTINGS_ARROW).to_batches()

    return run


def unpack(part: dict) -> tuple[np.ndarray, ...]:
    docs, owners = np.frombuffer(part["docs"], np.int64), np.frombuffer(part["owners"], np.uint32)
    return docs[owners], np.frombuffer(part["hashes"], U), np.frombuffer(part["checks"], np.uint32)


def settle(buckets: int, keep_least: bool):
    """Of a bucket's postings: marks of those whose hash another document holds (keep_least: one of smaller doc_id)."""

    def run(part: pa.Table) -> pa.Table:
        marked_docs, marked_hashes, open_parts = [np.zeros(0, np.int64)], [np.zeros(0, U)], []
        for r in part.to_pylist():
            d, h, k = unpack(r)
            if r["settled"]:
                marked_docs.append(d)
                marked_hashes.append(h)
            else:
                open_parts.append((d, h, k))
        if open_parts:
            d, h, k = (np.concatenate(x) for x in zip(*open_parts, strict=True))
            order = np.lexsort((d, k, h))
            d, h, k = d[order], h[order], k[order]
            fresh = np.ones(len(h), bool)
            fresh[1:] = (h[1:] != h[:-1]) | (k[1:] != k[:-1])
            group = np.cumsum(fresh) - 1
            least = d[np.flatnonzero(fresh)][group]
            most = np.full(group[-1] + 1, NO_ID)
            np.maximum.at(most, group, d)
            chosen = d > least if keep_least else least < most[group]
            marked_docs.append(d[chosen])
            marked_hashes.append(h[chosen])
        d, h = np.concatenate(marked_docs), np.concatenate(marked_hashes)
        key = d % buckets
        order = np.lexsort((d, key))
        out = []
        for x in np.split(order, np.flatnonzero(np.diff(key[order])) + 1) if len(d) else []:
            used, own = np.unique(d[x], return_inverse=True)
            out.append({"bucket": int(key[x[0]]), "docs": used.tobytes(), "owners": own.astype(np.uint32).tobytes(), "hashes": h[x].tobytes()})
        return pa.Table.from_pylist(out, MARKS_ARROW)

    return run


def marks_of(marks: pa.Table) -> dict[int, np.ndarray]:
    """Distinct marked hashes by doc_id."""
    parts = [(np.frombuffer(r["docs"], np.int64)[np.frombuffer(r["owners"], np.uint32)], np.frombuffer(r["hashes"], U)) for r in marks.to_pylist()]
    if not parts:
        return {}
    d, h = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.argsort(d, kind="stable")
    d, h = d[order], h[order]
    ids, first = np.unique(d, return_index=True)
    return {int(i): np.unique(x) for i, x in zip(ids, np.split(h, first[1:]), strict=True)}


def extend(buckets: int):
    """The distinct (window hash, document) of the windows that shared anchors are extended to."""

    def run(docs: pa.Table, marks: pa.Table) -> pa.Table:
        shared = marks_of(marks)
        rows: list[dict] = []
        for batch in docs.to_batches() if shared else []:
            ids = doc_ids(batch.column("doc_id"))
            keep = np.flatnonzero([int(i) in shared for i in ids])
            if not len(keep):
                continue
            ids = ids[keep]
            owners, hashes, checks = [], [], []
            for c, row, start, anchor, g, h in windows(batch.column("text").take(pa.array(keep))):
                marked = np.zeros(len(g) + 1, bool)
                for r in range(c.rows):
                    a, b = int(c.first[r]), int(c.first[r + 1]) - ANCHOR + 1
                    if b > a:
                        marked[a:b] = np.isin(g[a:b], shared[int(ids[c.row + r])])
                found = marked[anchor]
                if not found.any():
                    continue
                w, extra = grams(h, WINDOW, 35), grams(h, WINDOW, 37)
                owners.append(c.row + row[found])
                hashes.append(w[start[found]])
                checks.append((extra[start[found]] >> U(32)).astype(np.uint32))
            if owners:
                rows += post(ids, *(np.concatenate(x) for x in (owners, hashes, checks)), buckets, False)
        return pa.Table.from_pylist(rows, POSTINGS_ARROW)

    return run


RESULT = "doc_id long, n_words long, n_removed long, kept_sha256 string, repeats array<struct<first:int,last:int>>"
RESULT_ARROW = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), ("repeats", pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())])))])


def remove(docs: pa.Table, marks: pa.Table) -> pa.Table:
    """The result of each document of a bucket."""
    marked = marks_of(marks)
    out: dict[str, list] = {"doc_id": docs.column("doc_id").to_pylist(), "n_words": [], "n_removed": [], "kept_sha256": [], "repeats": []}
    for batch in docs.to_batches():
        ids = doc_ids(batch.column("doc_id"))
        for c, _, _, _, _, h in windows(batch.column("text")):
            w = grams(h, WINDOW, 35)
            for r in range(c.rows):
                a, b = int(c.first[r]), int(c.first[r + 1])
                found = c.raw[c.offsets[r] : c.offsets[r + 1]].tobytes().split()
                known = marked.get(int(ids[c.row + r])) if b - a >= WINDOW else None
                removed, spans = 0, []
                if known is not None:
                    covered = np.zeros(b - a + 1, np.int64)
                    hit = np.flatnonzero(np.isin(w[a : b - WINDOW + 1], known))
                    covered[hit] += 1
                    covered[hit + WINDOW] -= 1
                    gone = np.cumsum(covered)[:-1] > 0
                    removed = int(gone.sum())
                    found = list(compress(found, ~gone))
                    edges = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]]))).reshape(-1, 2)
                    spans = [{"first": x, "last": y - 1} for x, y in edges.tolist()]
                out["n_words"].append(b - a)
                out["n_removed"].append(removed)
                out["kept_sha256"].append(hashlib.sha256(b" ".join(found)).hexdigest())
                out["repeats"].append(spans)
    return pa.Table.from_pydict(out, RESULT_ARROW)


def is_prime(n: int) -> bool:
    return n > 1 and all(n % i for i in range(2, int(n**0.5) + 1))


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and repeats (first and last word of each maximal repeat) of each document."""
    texts = texts_of(docs)
    chars = texts.agg(F.sum(F.length("text"))).first()[0] or 0
    # A prime, so that patterns in the ids don't fill few buckets.
    buckets = max(7, int(chars // BUCKET_CHARS))
    while not is_prime(buckets):
        buckets += 1
    dealt = texts.withColumn("bucket", F.pmod(F.coalesce("doc_id", F.lit(int(NO_ID))), F.lit(buckets)))
    seeds = map_batches(texts, seed_postings(buckets), POSTINGS).groupBy("bucket").applyInArrow(settle(buckets, False), MARKS)
    spread = dealt.groupBy("bucket").cogroup(seeds.groupBy("bucket")).applyInArrow(extend(buckets), POSTINGS)
    marks = spread.groupBy("bucket").applyInArrow(settle(buckets, True), MARKS)
    return dealt.groupBy("bucket").cogroup(marks.groupBy("bucket")).applyInArrow(remove, RESULT)
