"""MinHash near-duplicates by a signature-coordinate inverted join.

Every document posts its (coordinate, value) pairs of a MinHash signature. Documents of one shingle set are one
representative first. Two signatures that agree in at least MATCHES of COORDINATES places agree in one of their
COORDINATES - MATCHES + 1 rarest pairs (prefix); pairs that occur once can agree with nothing and are skipped, and a
document with fewer than MATCHES shared pairs is skipped altogether. Candidates are confirmed on the full shingle sets.

Linked documents are joined to components in rounds. In a round every posting list compares its members with one hub, which costs
as many pairs as members; the hub is the member whose pairs are most common, the centre of a group of copies. Members that
are still in different components afterwards are compared with each other where the list is short. The members of long lists are told apart by
how they differ from the list's hub. Two sets that differ from the hub by D and E differ from each other by |D| + |E| - 2 |D & E|, so a member
that isn't linked to the hub can only be linked to one that shares over p / (p + q) of its differences (for similarity p / q). Rare differences
are listed, and a prefix and positional filter leaves pairs that may share enough; members with a common passage only, or with edits of
their own, drop out, and no link is lost.

Nodes of the graph are distinct sets, named by their least doc_id; where a doc_id is the least of several sets, the others have
names from 2**62 on, and all sets of one doc_id are linked. Copies of one set are one node, so only near copies share a hub; where
these hold a third of all documents, the hub's pairs are two numbers each and are split among tasks by the adaptive skew join.

Defined cases: a document without words (null or empty text) has an empty set, links with nothing and is its own component;
one with fewer words than a shingle has its whole sequence as one shingle; equal texts, and equal sets, link (similarity 1);
ties keep the least doc_id; rows of one doc_id share its component, also with different texts, and link what each of them links;
doc_ids are below 2**62; a very long text is one set of all its shingles; rows with a null doc_id are left out of the
groups and returned alone with a null component; further columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkstone.llm.common import cut, map_batches, texts_of
from inkstone.llm.graph import components
from inkstone.llm.words import U, chunks, grams, mix, stream

#: Signature length, and the agreements kept. At similarity 0.8, 64 coordinates agree in 51 places on average with a
#: deviation of 3.2; fewer than 36 agree for 4 pairs in a million at just that similarity, and for fewer above it.
COORDINATES, MATCHES = 64, 36
#: Hub rounds, and the longest list whose members are compared directly afterwards.
HUB_ROUNDS, SHORT_LIST = 1, 8
#: Names of the further sets of a doc_id begin here.
FURTHER = 1 << 62

SCHEMA = "doc_id long, n_shingles long, set_a long, set_b long, signature array<int>"


def shingle_sets(column: pa.Array, k: int):
    """(row, sorted distinct 64-bit shingle hashes) of each row."""
    for c in chunks(column):
        h = c.hashes(seed=3, lower=True)
        g = grams(h, k)
        for r in range(c.rows):
            a, b = int(c.first[r]), int(c.first[r + 1])
            if b - a >= k:
                yield c.row + r, np.unique(g[a : b - k + 1])
            elif b > a:
                short = np.zeros(1, U)
                for x in h[a:b]:
                    short = mix(short * U(0x9E3779B97F4A7C15) + x + U(b - a))
                yield c.row + r, short
            else:
                yield c.row + r, np.zeros(0, U)


def set_sums(flat: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two sums that stand for each set; cuts: where the sets begin in flat."""
    return np.add.reduceat(mix(flat ^ U(0x1234567)), cuts), np.add.reduceat(mix(flat ^ U(0x89ABCDEF01)), cuts)


def signatures(docs: DataFrame, k: int) -> DataFrame:
    """doc_id, n_shingles, two sums that stand for the set, and the signature (null for an empty set)."""

    def run(batches):
        factors, flips = stream(21, COORDINATES) | U(1), stream(22, COORDINATES)
        for batch in batches:
            sets = [s for _, s in shingle_sets(batch.column("text"), k)]
            sizes = np.fromiter(map(len, sets), np.int64, len(sets))
            flat = np.concatenate([*sets, np.zeros(0, U)])
            full = np.flatnonzero(sizes)
            cuts = np.concatenate([[0], np.cumsum(sizes)])[:-1][full]
            a, b, sig = np.zeros(len(sets), U), np.zeros(len(sets), U), np.zeros((len(full), COORDINATES), np.int32)
            if len(full):
                a[full], b[full] = set_sums(flat, cuts)
                for j in range(COORDINATES):
                    sig[:, j] = (np.minimum.reduceat((flat ^ flips[j]) * factors[j], cuts) >> U(32)).astype(np.uint32).view(np.int32)
            bounds = np.concatenate([[0], np.cumsum(np.where(sizes > 0, COORDINATES, 0))]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(bounds), pa.array(sig.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(sizes), pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), lists], ["doc_id", "n_shingles", "set_a", "set_b", "signature"])

    return map_batches(texts_of(docs), run, SCHEMA)


def postings(reps: DataFrame) -> DataFrame:
    """token, doc, weight: the prefix of each representative that shares at least MATCHES pairs with others; weight: how common its pairs are."""
    tokens = reps.select("doc", F.posexplode("signature").alias("at", "value")).select("doc", F.xxhash64("at", "value").alias("token"))
    shared = tokens.groupBy("token").agg(F.count("*").alias("n")).where("n > 1")
    held = tokens.join(shared, "token").groupBy("doc").agg(F.sort_array(F.collect_list(F.struct("n", "token"))).alias("held")).where(F.size("held") >= MATCHES)
    weight = F.aggregate("held", F.lit(0).cast("long"), lambda s, x: s + x["n"])
    return held.select("doc", weight.alias("weight"), F.explode(F.slice("held", F.lit(1), F.size("held") - (MATCHES - 1))).alias("x")).select("x.token", "doc", "weight")


def confirm(pairs: DataFrame, signed: DataFrame, sets: DataFrame) -> DataFrame:
    """a, b, inter, total: exact sizes of pairs whose signatures agree in MATCHES places. signed: doc, signature; sets: doc, hashes."""
    agree = F.aggregate(F.zip_with("sa", "sb", lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x)
    left = signed.select(F.col("doc").alias("a"), F.col("signature").alias("sa"))
    right = signed.select(F.col("doc").alias("b"), F.col("signature").alias("sb"))
    near = pairs.join(left, "a").join(right, "b").where(agree >= MATCHES).select("a", "b")
    full = near.join(sets.select(F.col("doc").alias("a"), F.col("hashes").alias("ha")), "a").join(sets.select(F.col("doc").alias("b"), F.col("hashes").alias("hb")), "b")

    def run(batches):
        for batch in batches:
            inter, total = [], []
            for x, y in zip(batch.column("ha").to_pylist(), batch.column("hb").to_pylist(), strict=True):
                x, y = np.frombuffer(x, U), np.frombuffer(y, U)
                at = np.minimum(np.searchsorted(x, y), len(x) - 1)
                n = int((x[at] == y).sum())
                inter.append(n)
                total.append(len(x) + len(y) - n)
            yield pa.RecordBatch.from_pydict({"a": batch.column("a"), "b": batch.column("b"), "inter": pa.array(inter, pa.int64()), "total": pa.array(total, pa.int64())})

    return map_batches(full.select("a", "b", "ha", "hb"), run, "a long, b long, inter long, total long")


def set_table(docs: DataFrame, wanted: DataFrame, k: int, several: bool) -> DataFrame:
    """doc, hashes (packed 64-bit shingle hashes, sorted) of the sets in wanted (doc, owner, set_a, set_b); owner: a doc_id with that set.

    several: a doc_id may have several sets; else doc and owner are the same."""

    def run(batches):
        for batch in batches:
            found = [s for _, s in shingle_sets(batch.column("text"), k)]
            sums = [[x[0] for x in set_sums(s, np.zeros(1, np.int64))] if len(s) else [U(0), U(0)] for s in found]
            a, b = (np.array([x[i] for x in sums], U).view(np.int64) for i in (0, 1))
            yield pa.RecordBatch.from_pydict({"owner": batch.column("doc_id"), "set_a": pa.array(a), "set_b": pa.array(b), "hashes": pa.array([s.tobytes() for s in found], pa.binary())})

    owners = wanted.select(F.col("owner").alias("doc_id")).distinct()
    found = map_batches(texts_of(docs).join(owners, "doc_id", "left_semi"), run, "owner long, set_a long, set_b long, hashes binary")
    found = found.join(wanted, ["owner", "set_a", "set_b"]) if several else found.withColumnRenamed("owner", "doc")
    return found.select("doc", "hashes").dropDuplicates(["doc"])


def alike_sizes(a: str, b: str, least: tuple[int, int]) -> Column:
    """Sets of the least similarity differ no more than by it in size."""
    return F.least(a, b) * least[1] >= F.greatest(a, b) * least[0]


def near_groups(docs: DataFrame, k: int = 5, least: tuple[int, int] = (80, 100)) -> DataFrame:
    """doc_id, n_shingles, component_id for each row of docs. Linked: least[1] * |intersection| >= least[0] * |union|."""
    signed = cut(signatures(docs, k))
    key = ["set_a", "set_b", "n_shingles"]
    reps = signed.where("n_shingles > 0 and doc_id is not null").groupBy(*key).agg(F.min("doc_id").alias("owner"), F.min("signature").alias("signature"))
    # doc_ids with several sets, as a rule none.
    spans = [F.min(c) != F.max(c) for c in key]
    mixed = cut(signed.where("doc_id is not null").groupBy("doc_id").agg((spans[0] | spans[1] | spans[2]).alias("several")).where("several").select("doc_id"))
    some = mixed.limit(1).count() > 0
    if some:
        several = reps.groupBy("owner").agg(F.min(F.struct(*key)).alias("first"))
        further = F.lit(FURTHER).bitwiseOR(F.shiftrightunsigned(F.xxhash64(*key, "owner"), 2))
        reps = reps.join(several, "owner").withColumn("doc", F.when(F.struct(*key) != F.col("first"), further).otherwise(F.col("owner"))).drop("first")
    else:
        reps = reps.withColumn("doc", F.col("owner"))
    reps = cut(reps)
    posts = cut(postings(reps))
    wanted = posts.select("doc").distinct()
    mine = cut(reps.join(wanted, "doc", "left_semi"))
    posts = cut(posts.join(mine.select("doc", "n_shingles"), "doc"))
    sets = cut(set_table(docs, mine.select("doc", "owner", "set_a", "set_b"), k, some))
    mine = mine.select("doc", "signature")
    if some:  # the sets that one doc_id holds are linked
        held = cut(signed.join(mixed, "doc_id").select("doc_id", *key).distinct().join(reps, key).select("doc_id", "doc"))
        same = held.join(held.groupBy("doc_id").agg(F.min("doc").alias("a")), "doc_id").select("a", F.col("doc").alias("b")).where("a <> b")
    spark = docs.sparkSession
    tested = spark.createDataFrame([], "a long, b long, inter long, total long")
    labels = spark.createDataFrame([], "node long, component long")
    linked = F.col("inter") * least[1] >= F.col("total") * least[0]
    for turn in range(HUB_ROUNDS + 1):
        named = posts.join(labels, posts.doc == labels.node, "left").select("token", "doc", "weight", "n_shingles", F.coalesce("component", "doc").alias("component"))
        centre = F.struct("weight", "doc", "component", "n_shingles")
        lists = named.groupBy("token").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.max(centre).alias("hub"), F.count("*").alias("members")).where("low <> high")
        rest = named.join(lists, "token")
        if turn < HUB_ROUNDS:
            pairs = rest.where((F.col("hub.component") != F.col("component")) & alike_sizes("hub.n_shingles", "n_shingles", least)).select(F.least("hub.doc", "doc").alias("a"), F.greatest("hub.doc", "doc").alias("b"))
        else:
            rest = cut(rest.select("token", "doc", "component", "n_shingles", "members", F.col("hub.doc").alias("hub")))
            pairs = cross_pairs(rest.where(F.col("members") <= SHORT_LIST), least).unionByName(difference_pairs(rest.where(F.col("members") > SHORT_LIST), sets, least))
        pairs = pairs.distinct().join(tested, ["a", "b"], "left_anti")
        found = cut(confirm(pairs, mine, sets))
        tested = found if turn == 0 else tested.unionByName(found)
        links = tested.where(linked).select("a", "b")
        labels = components(links.unionByName(same) if some else links)
    by_set = reps.join(labels, reps.doc == labels.node, "left").select("doc", *key, F.coalesce("component", "doc").alias("component_id"))
    found = signed.join(by_set, key, "left")
    if some:
        of_doc = held.join(by_set, "doc").groupBy("doc_id").agg(F.min("component_id").alias("of_doc"))
        found = found.join(of_doc, "doc_id", "left").withColumn("component_id", F.coalesce("of_doc", "component_id"))
    return found.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"))


def difference_pairs(members: DataFrame, sets: DataFrame, least: tuple[int, int]) -> DataFrame:
    """a, b: pairs of members of a hub's lists that may be linked, one of them not linked to the hub. members: hub, doc, component, n_shingles.

    With t = (q - p) / (q + p), sets of sizes n and m are linked if they differ by at most t * (n + m). For x not linked to the hub, any partner y
    shares s > |D_y| * p / (p + q) differences with it, and s >= |D_x| - t * (n_x + n_y); so their first shared difference in the order
    (count, difference) is among the first |D| - s + 1 of each, and what follows it must still hold enough."""
    p, q = least
    own = members.select("hub", "doc", "component", "n_shingles").distinct().where("hub <> doc")
    both = own.join(sets, "doc").join(sets.select(F.col("doc").alias("hub"), F.col("hashes").alias("centre")), "hub")

    def differ(batches):
        for batch in batches:
            size, rows, tokens = [], [], []
            for k, (x, h) in enumerate(zip(batch.column("hashes").to_pylist(), batch.column("centre").to_pylist(), strict=True)):
                x, h = np.frombuffer(x, U), np.frombuffer(h, U)
                found = np.concatenate([np.setdiff1d(x, h, True), mix(np.setdiff1d(h, x, True) ^ U(0x5DEECE66D))])
                size.append(len(found))
                rows.append(np.full(len(found), k))
                tokens.append(found.view(np.int64))
            at = pa.array(np.concatenate([*rows, np.zeros(0, np.int64)]))
            names = ["hub", "doc", "component", "n_shingles"]
            out = {n: batch.column(n).take(at) for n in names}
            yield pa.RecordBatch.from_pydict(out | {"differs": pa.array(size, pa.int64()).take(at), "token": pa.array(np.concatenate([*tokens, np.zeros(0, np.int64)]), pa.int64())})

    keys = ["hub", "doc", "component", "n_shingles", "differs"]
    every = cut(map_batches(both.select("hub", "doc", "component", "n_shingles", "hashes", "centre"), differ, "hub long, doc long, component long, n_shingles long, differs long, token long"))
    shared = every.groupBy("hub", "token").agg(F.count("*").alias("n")).where("n > 1")
    held = every.join(shared, ["hub", "token"]).groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("n", "token"))).alias("held"))
    # Differences that occur once come first in the order and find no one; only their number counts.
    sizes = sets.select(F.col("doc").alias("hub"), (F.octet_length("hashes") / 8).cast("long").alias("hub_size"))
    listed = held.withColumn("common", F.size("held")).join(sizes, "hub").select(*keys, "hub_size", "common", F.posexplode("held").alias("k", "x"))
    listed = listed.select(*keys, F.col("x.token").alias("token"), (F.col("differs") * (q + p) > (F.col("n_shingles") + F.col("hub_size")) * (q - p)).alias("apart"), (F.col("differs") - F.col("common") + F.col("k")).alias("place"))
    listed = cut(listed.withColumn("reach", F.expr(f"n_shingles * (1 + {q} / {p}) * {q - p} / {q + p}")))
    # What a partner of a member apart from the hub, and what a member apart from the hub, has to list.
    partner = listed.where(F.expr(f"place < differs - differs * {p} div {p + q}") & (~F.col("apart") | (F.col("place") <= F.col("reach"))))
    x, y = listed.where(F.col("apart") & (F.col("place") <= F.col("reach"))).alias("x"), partner.alias("y")
    left = F.least(F.col("x.differs") - F.col("x.place"), F.col("y.differs") - F.col("y.place"))
    enough = (F.col("x.differs") + F.col("y.differs") - 2 * left) * (q + p) <= (F.col("x.n_shingles") + F.col("y.n_shingles")) * (q - p)
    near = (F.col("x.hub") == F.col("y.hub")) & (F.col("x.token") == F.col("y.token")) & (F.col("x.component") != F.col("y.component")) & alike_sizes("x.n_shingles", "y.n_shingles", least) & enough
    return x.join(y, near).select(F.least("x.doc", "y.doc").alias("a"), F.greatest("x.doc", "y.doc").alias("b")).distinct()


def cross_pairs(members: DataFrame, least: tuple[int, int]) -> DataFrame:
    """Pairs of one list that are in different components and alike in size."""
    a, b = members.alias("x"), members.alias("y")
    near = (F.col("x.token") == F.col("y.token")) & (F.col("x.component") < F.col("y.component")) & alike_sizes("x.n_shingles", "y.n_shingles", least)
    return a.join(b, near).select(F.least("x.doc", "y.doc").alias("a"), F.greatest("x.doc", "y.doc").alias("b")).distinct()


def near_duplicates_removed(docs: DataFrame, k: int = 5, least: tuple[int, int] = (80, 100)) -> DataFrame:
    """docs less every row whose document is linked to one of smaller doc_id in its component; rows without doc_id stay."""
    dropped = near_groups(docs, k, least).where("component_id < doc_id").select("doc_id").distinct()
    return docs.join(dropped, "doc_id", "left_anti").select(*docs.columns)
