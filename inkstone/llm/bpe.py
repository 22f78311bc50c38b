"""Byte-level BPE encoding and decoding through a minimal acyclic transducer.

The frequent pre-tokens of the corpus are compiled, with their id sequences, into an automaton whose equal
suffixes are shared. Arcs carry additive outputs: the outputs along a word's path sum to the word's rank, and the
rank indexes a table of id sequences. The arrays are one file in shared storage that every Python worker maps into
memory. A pre-token that the automaton doesn't accept is merged exactly by the ranks of the vocabulary.

Defined cases: null text counts as empty (no ids, empty decoding); a very long text is encoded whole, alone in its portion; rows are independent, so ties and repeated rows
need no rule; a null doc_id is kept; further columns of the input are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import heapq
import io
import json
import re
from collections import Counter
from functools import lru_cache
from itertools import chain
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkstone.llm.common import map_batches, put_shared_bytes, texts_of

#: Frequent words in the automaton, and those that one task proposes. They decide on speed only: any other word is merged exactly.
LEXICON_WORDS, TASK_WORDS = 60_000, 20_000
#: Words whose ids a worker remembers before it starts afresh.
MEMO_WORDS = 250_000

SPLIT = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+")
#: The same split by the standard library, for texts of characters up to U+024F and a few marks, whose classes are plain ranges.
FAST = re.compile(r" ?[A-Za-zªµºÀ-ÖØ-öø-ɏ]+|'(?:[stmd]|re|ve|ll)| ?[0-9]+| ?[^\sA-Za-z0-9ªµºÀ-ÖØ-öø-ɏ]+|\s+(?!\S)|\s+")
ODD = re.compile("[^\t-\r\x20-\x7e\xa0-\xb1\xb4-\xb8\xba\xbb\xbf-ɏ‐-‧‰-⁞€]")


def byte_alphabet() -> dict[str, int]:
    """Printable stand-ins of the 256 bytes: printable Latin-1 stands for itself, the others follow from U+0100."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(0x100 + i): b for i, b in enumerate(hidden)}


#: Stands for a pair that never merges; larger than any (rank, id), and than any rank << 32 | place.
NO_MERGE, NO_KEY = (1 << 62, 0), 1 << 62
#: Words that are merged together, and the longest of them.
MERGED_TOGETHER, LONG_WORD = 1 << 15, 64
#: Characters of text that are split at a time, which bounds the memory of the pieces.
SPLIT_CHARS = 1 << 20


def portions(texts: list[str], most: int = SPLIT_CHARS):
    """Runs of texts that hold about so many characters together; a longer text stands alone."""
    run, held = [], 0
    for t in texts:
        if run and held + len(t) > most:
            yield run
            run, held = [], 0
        run.append(t)
        held += len(t)
    if run:
        yield run


def gather(data: np.ndarray, first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The stretches data[first : first + count], one after the other."""
    total = int(count.sum())
    return data[np.repeat(first - np.cumsum(count) + count, count) + np.arange(total)]


class Vocabulary:
    """The tokenizer file's vocabulary as bytes, with the merges as pairs of ids."""

    def __init__(self, path: str):
        spec = json.loads(open(path, encoding="utf-8").read())
        alphabet = byte_alphabet()
        ids = spec["model"]["vocab"]
        raw = lambda s: bytes(alphabet[c] for c in s)
        added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.size = max([*ids.values(), *added.values()]) + 1
        self.bytes: list[bytes] = [b""] * self.size
        for s, i in ids.items():
            if s not in added:
                self.bytes[i] = raw(s)
        for s, i in added.items():
            self.bytes[i] = s.encode()
        self.text = [str(i) for i in range(self.size)]
        self.byte_ids = [0] * 256
        for c, b in alphabet.items():
            self.byte_ids[b] = ids[c]
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, m in enumerate(spec["model"]["merges"]):
            a, b = m.split(" ") if isinstance(m, str) else m
            self.merges.setdefault((ids[a], ids[b]), (rank, ids[a + b]))
        # The same as arrays: pairs as numbers in order, with rank and result; bytes of all tokens one after the other.
        keys = np.array([a * self.size + b for a, b in self.merges], np.int64)
        order = np.argsort(keys)
        self.pair_keys = keys[order]
        found = np.array(list(self.merges.values()), np.int64).reshape(-1, 2)[order]
        self.pair_ranks, self.pair_ids = found[:, 0], found[:, 1]
        self.rank_ids = np.zeros(int(found[:, 0].max(initial=0)) + 1, np.int64)
        self.rank_ids[self.pair_ranks] = self.pair_ids
        self.byte_count = np.fromiter(map(len, self.bytes), np.int64, self.size)
        self.byte_first = np.cumsum(self.byte_count) - self.byte_count
        self.byte_data = np.frombuffer(b"".join(self.bytes), np.uint8)
        self.added = added
        self.at_added = re.compile("(" + "|".join(map(re.escape, sorted(added, key=len, reverse=True))) + ")") if added else None

    def merge(self, word: bytes) -> tuple[int, ...]:
        """Exact merging: always the pair of least rank, the leftmost of equals."""
        part = [self.byte_ids[b] for b in word]
        if len(part) > 64:
            return self._merge_long(part)
        # Only the pairs beside a merge change, so each merge costs two look-ups and one minimum.
        found = self.merges.get
        ranks = [found(p, NO_MERGE) for p in zip(part, part[1:])]
        while ranks:
            best = min(ranks)
            if best is NO_MERGE:
                break
            at = ranks.index(best)
            part[at : at + 2] = [best[1]]
            del ranks[at]
            if at:
                ranks[at - 1] = found((part[at - 1], part[at]), NO_MERGE)
            if at < len(ranks):
                ranks[at] = found((part[at], part[at + 1]), NO_MERGE)
        return tuple(part)

    def merge_many(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """merge for many words of at least one byte at once: ids of all, one word after the other, and how many each has.

        In a step every word makes its next merge: the pair of least rank, the leftmost of equals."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        token = np.array(self.byte_ids, np.int64)[np.frombuffer(b"".join(words), np.uint8)]
        n = len(token)
        first = np.cumsum(sizes) - sizes
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        after[first + sizes - 1] = -1
        before[first] = -1
        alive = np.ones(n, bool)

        def keys(at: np.ndarray) -> np.ndarray:
            """rank << 32 | place of the pairs that begin at the places; NO_KEY where none can be merged."""
            out = np.full(len(at), NO_KEY)
            has = np.flatnonzero(after[at] >= 0)
            pair = token[at[has]] * self.size + token[after[at[has]]]
            where = np.minimum(np.searchsorted(self.pair_keys, pair), len(self.pair_keys) - 1)
            good = self.pair_keys[where] == pair
            out[has[good]] = self.pair_ranks[where[good]] << 32 | at[has[good]]
            return out

        key = keys(np.arange(n))
        while True:
            best = np.minimum.reduceat(key, first)
            best = best[best < NO_KEY]
            if not len(best):
                break
            i = best & 0xFFFFFFFF
            j = after[i]
            token[i] = self.rank_ids[best >> 32]
            after[i] = after[j]
            more = after[i] >= 0
            before[after[i[more]]] = i[more]
            key[j], alive[j] = NO_KEY, False
            key[i] = keys(i)
            left = before[i]
            left = left[left >= 0]
            key[left] = keys(left)
        return token[alive].astype(np.int32), np.add.reduceat(alive, first, dtype=np.int64)

    def decoded(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of ids, one token after the other."""
        return gather(self.byte_data, self.byte_first[ids], self.byte_count[ids])

    def _merge_long(self, part: list[int]) -> tuple[int, ...]:
        """The same for long words with a queue, in n log n steps."""
        merges, n = self.merges, len(part)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        queue = [(*m, i, part[i], part[i + 1]) for i in range(n - 1) if (m := merges.get((part[i], part[i + 1])))]
        queue = [(rank, i, a, b, new) for rank, new, i, a, b in queue]
        heapq.heapify(queue)
        while queue:
            _, i, a, b, new = heapq.heappop(queue)
            j = after[i]
            if part[i] != a or j >= n or part[j] != b:
                continue
            part[i], part[j] = new, -1
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y < n and (m := merges.get((part[x], part[y]))):
                    heapq.heappush(queue, (m[0], x, part[x], part[y], m[1]))
        return tuple(p for p in part if p >= 0)

    def pieces(self, text: str) -> list[str]:
        """Pre-tokens in order; special tokens stand as pieces of their own."""
        if self.at_added is None or not any(s in text for s in self.added):
            return (SPLIT if ODD.search(text) else FAST).findall(text)
        out: list[str] = []
        for k, part in enumerate(self.at_added.split(text)):
            if k % 2:
                out.append(part)
            elif part:
                out += (SPLIT if ODD.search(part) else FAST).findall(part)
        return out


class Transducer:
    """Minimal acyclic automaton over bytes; the outputs on a word's path sum to its rank among the words."""

    @staticmethod
    def build(words: list[bytes], outputs: list[tuple[int, ...]]) -> bytes:
        """words: sorted and distinct. Returns the arrays as one block for memory mapping."""
        register: dict[tuple, int] = {}
        states: list[tuple[bool, tuple[tuple[int, int], ...]]] = []
        counts: list[int] = []

        def freeze(node: list) -> int:
            key = (node[0], tuple(node[1]))
            if (at := register.get(key)) is None:
                at = register[key] = len(states)
                states.append(key)
                counts.append(node[0] + sum(counts[t] for _, t in node[1]))
            return at

        # A node is [accepting, [(byte, frozen target), ...], byte of the open arc]; the path holds the last word's.
        path: list[list] = [[0, [], -1]]
        last = b""
        for word in words:
            common = 0
            while common < min(len(last), len(word)) and last[common] == word[common]:
                common += 1
            while len(path) > common + 1:
                node = path.pop()
                path[-1][1].append((path[-1][2], freeze(node)))
            for b in word[common:]:
                path[-1][2] = b
                path.append([0, [], -1])
            path[-1][0], last = 1, word
        while len(path) > 1:
            node = path.pop()
            path[-1][1].append((path[-1][2], freeze(node)))
        root = freeze(path[0])
        keys, targets, gains = [], [], []
        for s, (accepting, arcs) in enumerate(states):
            gain = int(accepting)
            for b, t in arcs:
                keys.append(s * 256 + b)
                targets.append(t)
                gains.append(gain)
                gain += counts[t]
        sizes = np.fromiter(map(len, outputs), np.int64, len(outputs))
        arrays = [
            np.array([root], np.int64), np.array(keys, np.int64), np.array(targets, np.int64), np.array(gains, np.int64), np.array([a for a, _ in states], np.int64),
            np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64), np.fromiter(chain.from_iterable(outputs), np.int64, int(sizes.sum())),
        ]
        out = io.BytesIO()
        out.write(np.array([len(a) for a in arrays], np.int64).tobytes())
        for a in arrays:
            out.write(a.tobytes())
        return out.getvalue()

    def __init__(self, mapped: np.ndarray):
        """mapped: the block as int64, from np.memmap or np.frombuffer."""
        sizes, at, parts = mapped[:7], 7, []
        for n in sizes:
            parts.append(mapped[at : at + int(n)])
            at += int(n)
        root, self.keys, self.targets, self.gains, self.accepting, self.offsets, self.ids = parts
        self.root = int(root[0])

    def lookup(self, words: list[bytes]) -> list[tuple[int, ...] | None]:
        """The outputs of words; None for those not accepted."""
        good, first, count = self.find(words)
        out: list[tuple[int, ...] | None] = [None] * len(words)
        for i, a, n in zip(np.flatnonzero(good).tolist(), first.tolist(), count.tolist(), strict=True):
            out[i] = tuple(self.ids[a : a + n].tolist())
        return out

    def find(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Which words are accepted, and of these where their outputs begin and how many there are. All words walk together, one byte at a step."""
        n = len(words)
        if not n or not len(self.keys):
            return np.zeros(n, bool), np.zeros(0, np.int64), np.zeros(0, np.int64)
        sizes = np.fromiter(map(len, words), np.int64, n)
        flat = np.frombuffer(b"".join(words), np.uint8)
        starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        state, rank, live = np.full(n, self.root), np.zeros(n, np.int64), np.arange(n)
        dead = np.zeros(n, bool)
        step = 0
        while True:
            live = live[sizes[live] > step]
            if not len(live):
                break
            key = state[live] * 256 + flat[starts[live] + step]
            arc = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            found = self.keys[arc] == key
            dead[live[~found]] = True
            live, arc = live[found], arc[found]
            rank[live] += self.gains[arc]
            state[live] = self.targets[arc]
            step += 1
        good = ~dead & (self.accepting[state] == 1)
        first = self.offsets[rank[good]]
        return good, first, self.offsets[rank[good] + 1] - first


class Codec:
    """Encodes and decodes texts with a vocabulary and a mapped transducer. Known pieces have numbers; their ids stand one after the other."""

    def __init__(self, vocabulary: Vocabulary, transducer: Transducer):
        self.v, self.t = vocabulary, transducer
        self.forget()

    def forget(self) -> None:
        self.memo: dict[str, int] = {}
        self.ids, self.first, self.count = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)
        added = sorted(self.v.added.items())
        self.keep([s for s, _ in added], np.array([i for _, i in added], np.int32), np.ones(len(added), np.int64))

    def keep(self, pieces: list[str], ids: np.ndarray, count: np.ndarray) -> None:
        self.memo.update(zip(pieces, range(len(self.count), len(self.count) + len(pieces)), strict=True))
        self.first = np.concatenate([self.first, len(self.ids) + np.cumsum(count) - count])
        self.ids, self.count = np.concatenate([self.ids, ids.astype(np.int32)]), np.concatenate([self.count, count])

    def learn(self, pieces: set[str]) -> None:
        """Numbers for all pieces: the transducer's words first, the others merged exactly."""
        new = list(pieces.difference(self.memo))
        if len(self.memo) + len(new) > MEMO_WORDS and len(self.memo) > len(self.v.added):
            self.forget()
            new = list(pieces.difference(self.memo))
        raw = [p.encode() for p in new]
        good, first, count = self.t.find(raw)
        self.keep([new[k] for k in np.flatnonzero(good)], gather(self.t.ids, first, count), count)
        rest = np.flatnonzero(~good).tolist()
        short = [k for k in rest if len(raw[k]) <= LONG_WORD]
        for at in range(0, len(short), MERGED_TOGETHER):
            part = short[at : at + MERGED_TOGETHER]
            self.keep([new[k] for k in part], *self.v.merge_many([raw[k] for k in part]))
        for k in rest:
            if len(raw[k]) > LONG_WORD:
                found = self.v.merge(raw[k])
                self.keep([new[k]], np.array(found, np.int32), np.array([len(found)]))

    def encode_all(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text."""
        split = [self.v.pieces(t) for t in texts]
        self.learn(set(chain.from_iterable(split)))
        n = np.fromiter(map(len, split), np.int64, len(split))
        number = np.fromiter(map(self.memo.__getitem__, chain.from_iterable(split)), np.int64, int(n.sum()))
        count = self.count[number]
        ends = np.concatenate([[0], np.cumsum(count)])[np.cumsum(n)]
        return np.split(gather(self.ids, self.first[number], count), ends[:-1]) if len(texts) else []

    def encode(self, text: str) -> list[int]:
        return self.encode_all([text])[0].tolist()

    def decode(self, ids: list[int] | np.ndarray) -> bytes:
        """UTF-8 of the decoded text; bytes that are not UTF-8 become U+FFFD."""
        return self.v.decoded(np.asarray(ids, np.int64)).tobytes().decode("utf-8", "replace").encode()


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def compile_lexicon(texts: DataFrame, path: str, size: int = LEXICON_WORDS) -> bytes:
    """Count pre-tokens over all texts, each task proposing its most frequent; compile the most frequent of all."""

    def count(batches):
        found: Counter[str] = Counter()
        v = vocabulary(path)
        for batch in batches:
            for text in batch.column("text").to_pylist():
                found.update(v.pieces(text or ""))
            if len(found) > 40 * TASK_WORDS:
                found = Counter(dict(found.most_common(20 * TASK_WORDS)))
        # Words more frequent than the first one beyond TASK_WORDS.
        least = np.partition(np.fromiter(found.values(), np.int64, len(found)), -TASK_WORDS - 1)[-TASK_WORDS - 1] if len(found) > TASK_WORDS else 0
        top = sorted((w, n) for w, n in found.items() if n > least)
        yield pa.RecordBatch.from_pydict({"word": pa.array([w for w, _ in top], pa.string()), "n": pa.array([n for _, n in top], pa.int64())})

    counted = map_batches(texts.select("text"), count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    v = vocabulary(path)
    words = sorted({r.word.encode() for r in counted.orderBy(F.desc("n"), "word").limit(size).collect() if r.word not in v.added})
    return Transducer.build(words, [v.merge(w) for w in words])


def encode_documents(docs: DataFrame, path: str, with_ids: bool = False, lexicon_words: int = LEXICON_WORDS) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and, if asked for, the ids of each whole text."""
    spark = docs.sparkSession
    texts = texts_of(docs)
    uri = put_shared_bytes(spark, compile_lexicon(texts, path, lexicon_words), ".fst")
    # A shared folder that is mounted is mapped in place; from other storage Spark hands each executor a copy.
    mounted = urlparse(uri).path if uri.startswith("file:") else None
    if not mounted:
        spark.sparkContext.addFile(uri)
    name = uri.rsplit("/", 1)[-1]

    def run(batches):
        codec = Codec(vocabulary(path), Transducer(np.memmap(mounted or SparkFiles.get(name), np.int64, "r")))
        v = codec.v
        for batch in batches:
            n_tokens, ids_sha, decoded_sha, all_ids = [], [], [], []
            for run in portions([t or "" for t in batch.column("text").to_pylist()]):
                for ids in codec.encode_all(run):
                    n_tokens.append(len(ids))
                    ids_sha.append(hashlib.sha256(",".join(map(v.text.__getitem__, ids.tolist())).encode()).hexdigest())
                    decoded_sha.append(hashlib.sha256(codec.decode(ids)).hexdigest())
                    if with_ids:
                        all_ids.append(ids)
            out = {"doc_id": batch.column("doc_id"), "n_tokens": pa.array(n_tokens, pa.int64()), "ids_sha256": pa.array(ids_sha, pa.string()), "decoded_sha256": pa.array(decoded_sha, pa.string())}
            if with_ids:
                out["ids"] = pa.array(all_ids, pa.list_(pa.int32()))
            yield pa.RecordBatch.from_pydict(out)

    return map_batches(texts, run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids)
