"""Operators over whole corpora against brute force, and the pipeline."""

import hashlib
import math
import random
import re
import time
from collections import Counter
from itertools import combinations

import pytest

from inkstone.llm import backoff, graph, minhash, substring, urls

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


@pytest.fixture(scope="module")
def corpus(spark):
    """Exact and near copies, shared passages, internal repeats, null and empty rows, repeated ids, clashing columns."""
    rng = random.Random(11)
    pool = [f"{a}{b}{c}" for a in "BdfgK" for b in "aeiou" for c in "lmnrst"]
    texts = [" ".join(rng.choices(pool, k=rng.choice((0, 2, 12, 13, 40, 120)))) for _ in range(60)]
    base = rng.choices(pool, k=120)
    for _ in range(25):
        w = list(base)
        for _ in range(rng.randint(0, 4)):
            w[rng.randrange(len(w))] = rng.choice(pool)
        texts.append(" ".join(w))
    texts += [texts[5]] * 12 + ["same words " * 40] * 3
    passage = " ".join(rng.choices(pool, k=30))
    texts += [f"{' '.join(rng.choices(pool, k=9))} {passage}\t{' '.join(rng.choices(pool, k=9))}" for _ in range(10)] + [None, "", "  \n "]
    rng.shuffle(texts)
    rows = [(i, t) for i, t in enumerate(texts)]
    rows += [(3, rows[3][1]), (None, texts[5]), (None, None)]
    return spark.createDataFrame([(i, t, "x", 1, 2) for i, t in rows], "doc_id long, text string, component_id string, n_words long, bucket long"), rows


def brute_removed(rows):
    least, out = {}, Counter()
    for i, t in rows:
        w = WORD.findall(t or "")
        for j in range(len(w) - 12):
            k = tuple(w[j : j + 13])
            if i is not None:
                least[k] = min(least.get(k, i), i)
    for i, t in rows:
        w, gone = WORD.findall(t or ""), set()
        for j in range(len(w) - 12):
            if i is not None and least[tuple(w[j : j + 13])] < i:
                gone |= set(range(j, j + 13))
        kept = " ".join(x for j, x in enumerate(w) if j not in gone)
        out[i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()] += 1
    return out


def test_substring_equals_brute_force(corpus):
    df, rows = corpus
    got = Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in substring.remove_repeats(df).collect())
    assert got == brute_removed(rows)
    assert substring.remove_repeats(df.limit(0)).count() == 0


def test_substring_tells_rows_of_one_id_apart_and_reports_repeats(spark):
    word = lambda p, n: " ".join(f"{p}{i}" for i in range(n))
    shared, other = word("s", 20), word("t", 15)
    long = " ".join([word("L", 30_000), shared, word("M", 30_000)])
    rows = [(1, shared), (5, f"{word('a', 7)} {shared} {word('b', 7)}"), (5, f"{word('c', 60)} {shared}"), (5, f"{other} {word('d', 3)} {other}"), (6, f"{shared} {other}"), (7, long), (8, long + " z")]
    got = substring.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"))
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got.collect()) == brute_removed(rows)
    spans = {(r.doc_id, r.n_words): [(x.first, x.last) for x in r.repeats] for r in got.collect()}
    assert spans == {(1, 20): [], (5, 34): [(7, 26)], (5, 80): [(60, 79)], (5, 33): [], (6, 35): [(0, 34)], (7, 60_020): [(30_000, 30_019)], (8, 60_021): [(0, 60_019)]}


def brute_groups(rows, k, least):
    sets = {}
    for i, t in rows:
        w = WORD.findall(lower(t))
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()
    parent = {i: i for i in sets}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(i for i in sets if i is not None)
    for x in ids:
        for y in ids:
            if x < y and sets[x] and sets[y]:
                n = len(sets[x] & sets[y])
                if least[1] * n >= least[0] * (len(sets[x]) + len(sets[y]) - n):
                    a, b = find(x), find(y)
                    parent[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in ids}


@pytest.mark.parametrize("k,least", [(3, (85, 100)), (5, (80, 100))])
def test_near_groups_equal_brute_force(corpus, k, least):
    df, rows = corpus
    got = minhash.near_groups(df, k, least).collect()
    want = brute_groups(rows, k, least)
    assert len(got) == len(rows)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got if r.doc_id is not None} == want
    assert all(r.component_id is None for r in got if r.doc_id is None)
    kept = minhash.near_duplicates_removed(df, k, least)
    assert kept.columns == df.columns
    assert {r.doc_id for r in kept.collect()} == {None} | {i for i, (_, c) in want.items() if i == c}
    assert minhash.near_groups(df.limit(0), k, least).count() == 0


def test_rows_of_one_id_link_what_each_of_them_links(spark):
    """Groups of (0, A), (5, A edited), (5, B edited), (7, B): one component; an id with an empty row; a long text and its copy."""
    rng = random.Random(21)
    pool = [f"{a}{b}{c}" for a in "bdfgk" for b in "aeiou" for c in "lmnrst"]
    rows, want = [(9000, ""), (9000, "only this text here"), (9100, "x y z " * 40_000), (9101, "x y z " * 40_000), (9200, None)], {9000: 9000, 9100: 9100, 9101: 9100, 9200: 9200}
    for g in range(20):
        a, b = (rng.choices(pool, k=120) for _ in range(2))
        edit = lambda w: " ".join([*w[:60], "edited", *w[61:]])
        base = 10 * g
        rows += [(base, " ".join(a)), (base + 5, edit(a)), (base + 5, edit(b)), (base + 7, " ".join(b))]
        want |= {base: base, base + 5: base, base + 7: base}
    rng.shuffle(rows)
    got = minhash.near_groups(spark.createDataFrame(rows, "doc_id long, text string"), 3, (85, 100)).collect()
    assert len(got) == len(rows)
    assert {(r.doc_id, r.component_id) for r in got} == set(want.items())


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, j) for j in range(101, 140)] + [(7, 7)]
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {j: 100 for j in range(100, 140)}


@pytest.mark.parametrize("order", [1, 2, 3])
def test_backoff_equals_brute_force(corpus, order):
    df, rows = corpus
    texts = [WORD.findall(lower(t)) for _, t in rows]
    counts = [Counter() for _ in range(order + 1)]
    for w in texts:
        for n in range(1, order + 1):
            counts[n].update(tuple(w[j : j + n]) for j in range(len(w) - n + 1))
    total = sum(counts[1].values())

    def score(w, j, n):
        if n == 1:
            return math.log(counts[1][(w[j],)] / total)
        g = tuple(w[j - n + 1 : j + 1])
        return math.log(counts[n][g] / counts[n - 1][g[:-1]]) if counts[n][g] else math.log(0.4) + score(w, j, n - 1)

    want = sorted((len(w), round(sum(score(w, j, min(order, j + 1)) for j in range(len(w))), 4)) for w in texts)
    assert sorted((r.n_tokens, round(r.score, 4)) for r in backoff.score_documents(df, order).collect()) == want
    if order == 2:
        assert sorted((r.n_tokens, round(r.score, 4)) for r in backoff.score_relational(df).collect()) == want
        assert backoff.score_relational(df.limit(0)).count() == 0
    assert backoff.score_documents(df.limit(0)).count() == 0


def test_backoff_leaves_out_rare_pairs_only_when_asked(spark):
    """least=2 scores pairs that occur once by the shorter context; a long text is scored whole."""
    rows = [(1, "a b a b"), (2, "b a"), (3, "x " * 50_000 + "y")]
    got = {r.doc_id: r.score for r in backoff.score_documents(spark.createDataFrame(rows, "doc_id long, text string"), least=2).collect()}
    total = 50_007
    assert got[2] == pytest.approx(math.log(3 / total) + math.log(2 / 3))
    assert got[3] == pytest.approx(math.log(50_000 / total) + 49_999 * math.log(49_999 / 50_000) + math.log(0.4 / total))


PAGES = [
    "https://a.net/x", "http://EXAMPLE.net/en/1", "http://www.example.com/de/2?q=1", "http://b.org/fr/", "http://b.org/frx", "http://other.org/de/3", "nourl", None, "", "http://net", "http://xnet/", "http://example.net?x#y", "ftp://h/p#f", "http://a.b.c.d.e.f.org/fr/#z",
]


def brute_rule(url):
    if url is None or "://" not in url:
        return "", "", None
    rest = url.split("://", 1)[1]
    host = lower(re.split(r"[/?#]", rest, maxsplit=1)[0])
    path = re.split(r"[?#]", rest[len(host) :], maxsplit=1)[0]
    fits = [(len(h + p), h + p, v) for v, h, p in urls.LISTED if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, max(fits)[1:] if fits else None


def test_url_rules_equal_brute_force(spark):
    rows = [(i, u, "x") for i, u in enumerate(PAGES * 2)] + [(None, "http://z.net/", "x")]
    got = urls.judge(spark.createDataFrame(rows, "page_id long, url string, verdict string")).collect()
    assert len(got) == len(rows)
    by = {r.page_id: r for r in got}
    for i, u, _ in rows:
        host, path, rule = brute_rule(u)
        assert (by[i].host, by[i].path, by[i].rule) == (host, path, rule and rule[0])
        assert by[i].verdict == rule[1] if rule else by[i].verdict in ("allow", "block")


def keyed(spark, baskets):
    return spark.createDataFrame([(str(i), *b) for i, b in enumerate(baskets)], "key string, tokens array<string>, verdict string")


def test_mined_rules_meet_support_and_confidence(spark):
    baskets = [(["h0:com", "p:ads"], "block")] * 30 + [(["h0:com", "p:news"], "allow")] * 60 + [(["h0:com", "p:ads", "q:ref"], "block")] * 10
    mined = urls.mine(keyed(spark, baskets), 0.05, 0.9).collect()
    assert {tuple(r.tokens): r.verdict for r in mined} == {("p:ads",): "block", ("p:news",): "allow", ("q:ref",): "block"}
    pages = spark.createDataFrame([(1, ["p:ads", "h0:org"]), (2, ["h0:com"]), (3, [])], "key long, tokens array<string>")
    got = urls.mined_verdicts(pages, spark.createDataFrame(mined)).collect()
    assert {r.key: r.mined for r in got} == {1: "block"}
    assert urls.mine(keyed(spark, [])).count() == 0


def test_mining_counts_all_tokens_of_long_urls(spark):
    """q:utm stands in 1 % of the URLs that are short and blocked and, behind 24 other tokens, in 5 % that are long and unlabelled;
    q:ref stands behind 24 other tokens in 5 % that are blocked."""
    long = [[f"q:{i}x{j}" for j in range(24)] for i in range(100)]
    baskets = [(["h0:com", "q:utm"], "block")] * 10 + [([*t, "q:utm"], None) for t in long[:50]] + [([*t, "q:ref"], "block") for t in long[50:]] + [(["h0:com"], None)] * 890
    mined = urls.mine(keyed(spark, baskets), 0.01, 0.6).collect()
    assert {tuple(r.tokens): (r.verdict, r.confidence) for r in mined} == {("h0:com", "q:utm"): ("block", 1.0), ("q:ref",): ("block", 1.0)}


def test_growth_counts_what_plain_mining_counts(spark):
    rng = random.Random(3)
    rows = [(sorted({f"t{int(rng.expovariate(0.3))}" for _ in range(rng.randint(0, 9))}), rng.choice(("block", "allow", None))) for _ in range(400)]
    df = spark.createDataFrame(rows, "tokens array<string>, verdict string")
    plain, grown = ({(tuple(r.tokens), r.verdict, r.freq) for r in f(df, 12).collect()} for f in (urls.plain_sets, urls.grow))
    want = Counter((c, v) for t, label in rows for k in (1, 2, 3) for c in combinations(t, k) for v in {None, label})
    assert plain == grown == {(c, v, n) for (c, v), n in want.items() if n >= 12}


def assert_equals_sql(spark, tmp_path, rows):
    import duckdb

    from inkstone.llm.queries import OP10

    df = spark.createDataFrame(rows, "page_id long, url string, verdict string")
    df.write.mode("overwrite").parquet(f"{tmp_path}/pages")
    db = duckdb.connect()
    db.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{tmp_path}/pages/*.parquet')")
    want = Counter(db.execute(f"SELECT page_id, host, path, rule, verdict FROM ({OP10})").fetchall())
    assert Counter(tuple(r) for r in urls.judge(df).collect()) == want


@pytest.mark.parametrize("shared", [3, 14])
def test_url_rules_equal_sql_on_urls_of_many_tokens(spark, tmp_path, shared):
    """Segments that many URLs share, in parts of each; segments of their own; query keys; nulls, repeats and one very long URL."""
    rng = random.Random(shared)
    common = [f"seg{chr(97 + i)}" for i in range(shared)]
    rows = [(None, None, "x"), (1, "", "x"), (2, "https://long.net/" + "abc/" * 20_000, "x")]
    for i in range(250):
        host = rng.choice(("a.net", "www.b.com", "c.org", "example.com", "x.example.net"))
        path = "/".join([rng.choice(("de", "fr", "en", "it")), *(c for c in common if rng.random() < 0.7), *("".join(rng.choices("klmn", k=6)) for _ in range(rng.randint(0, 20)))])
        rows.append((i, f"http{'s' * (i % 2)}://{host}/{path}?{rng.choice(('utm', 'ref', 'q'))}=1", "x"))
    assert_equals_sql(spark, tmp_path, rows + rows[5:40])


def test_many_shared_tokens_are_mined_in_bounded_time(spark):
    """40 segments that all URLs share, and 25 that each URL has with a chance of one half: 2^40 and 2^25 combinations without the bound."""
    rng = random.Random(9)
    same = "/".join(f"s{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(40))
    some = [f"m{chr(97 + i)}" for i in range(25)]
    rows = [(i, f"http://{rng.choice(('a.net', 'b.com', 'c.org'))}/{same}/{'/'.join(x for x in some if rng.random() < 0.5)}/u{chr(97 + i % 26)}") for i in range(600)]
    began = time.perf_counter()
    got = urls.judge(spark.createDataFrame(rows, "page_id long, url string")).collect()
    assert len(got) == 600 and time.perf_counter() - began < 120


def test_url_rules_on_an_empty_table(spark):
    assert urls.judge(spark.createDataFrame([], "page_id long, url string, host string")).collect() == []


def test_pipeline_stages_take_effect(spark):
    import corpus_pipeline as P

    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    counts = [docs.count()]
    for name, stage in P.STAGES[:-1]:
        docs = stage(spark, docs, folder)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        counts.append(docs.count())
    assert counts[0] > counts[1] > counts[2] >= counts[3] == counts[4] > 0
    left = {r.doc_id: r.text for r in docs.collect()}
    assert not any("@mail" in t for t in left.values())
    encoded = P.STAGES[-1][1](spark, docs, folder).collect()
    assert {r.doc_id: r.decoded_sha256 for r in encoded} == {i: hashlib.sha256(t.encode()).hexdigest() for i, t in left.items()}
    assert P.run(spark, folder).count() == len(left)


def shingled(words):
    k = min(5, len(words))
    return Counter(tuple(words[j : j + k]) for j in range(len(words) - k + 1)) if k else Counter()


def holds(text, item):
    """Whether the item's words stand somewhere in the text with a weighted shingle similarity of 0.8."""
    w, v = (re.findall(r"[^\W_]+|[^\x00-\x7f]+", (x or "").lower()) for x in (text, item))
    want = shingled(v)
    for at in range(len(w) if want.keys() & shingled(w).keys() else 0):
        got = shingled(w[at : at + len(v)])
        both = sum((got & want).values())
        if both >= 0.8 * (sum(got.values()) + sum(want.values()) - both):
            return True
    return False


def test_pipeline_stages_equal_brute_force(spark):
    import corpus_pipeline as P
    from inkstone.llm import pii

    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    rows = {r.doc_id: r.text for r in docs.collect()}
    stages = dict(P.STAGES)
    after = {name: {r.doc_id: r.text for r in stages[name](spark, docs, folder).collect()} for name in ("near_dedup", "decontamination", "pii")}
    groups = brute_groups(list(rows.items()), 5, (80, 100))
    assert after["near_dedup"] == {i: t for i, t in rows.items() if groups[i][1] == i}
    items = [r.text for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    assert after["decontamination"] == {i: t for i, t in rows.items() if not any(holds(t, x) for x in items)}
    assert after["pii"] == {i: pii.redact(t, pii.find_spans(t)) for i, t in rows.items()}


def test_long_lists_lose_no_link(spark, monkeypatch):
    """Groups of edited copies of copies, with most lists over the limit of direct comparison."""
    monkeypatch.setattr(minhash, "SHORT_LIST", 3)
    rng = random.Random(4)
    pool = [f"{a}{b}{c}" for a in "bdfgk" for b in "aeiou" for c in "lmnrst"]
    rows = []
    for _ in range(2):
        kids = [rng.choices(pool, k=110)]
        for _ in range(50):
            w = list(rng.choice(kids) if rng.random() < 0.5 else kids[0])
            for _ in range(rng.randint(0, 6)):
                k, r = rng.randrange(len(w)), rng.random()
                if r < 0.6:
                    w[k] = rng.choice(pool)
                elif r < 0.8:
                    del w[k]
                else:
                    w.insert(k, rng.choice(pool))
            kids.append(w)
        rows += kids
    passage = rng.choices(pool, k=60)
    rows += [rng.choices(pool, k=rng.randint(5, 25)) + passage for _ in range(40)]
    rng.shuffle(rows)
    rows = [(i, " ".join(w)) for i, w in enumerate(rows)]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_groups(spark.createDataFrame(rows, "doc_id long, text string"), 3, (85, 100)).collect()}
    assert got == brute_groups(rows, 3, (85, 100))
