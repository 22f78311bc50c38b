"""Operators that work on one text at a time: exact references, round trips and the defined cases."""

import hashlib
import random
import re

import pyarrow as pa
import pytest

from inkstone.llm import bpe, decontaminate, pii, toxicity, webp, words, zlang

ODD = [None, "", " ", "one", "a b  c\td", "é ß — 日本語 😀", "<|endoftext|>x <|endoftext|>", "x " * 30000, "a" * 20000, "same text", "same text"]


@pytest.fixture(scope="module")
def odd(spark):
    """Null id, null, empty, long and repeated texts, with further columns whose names clash with results."""
    rows = [(None if i == 3 else i, t, "en", "s", 1, 0.5, 7, "x", 9) for i, t in enumerate(ODD)] + [(1, "", "en", "s", 1, 0.5, 7, "x", 9)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score double, bucket long, spans string, n_words long")


def ids_of(rows):
    return sorted((-1 if r.doc_id is None else r.doc_id) for r in rows)


def test_word_hashes_split_like_the_pattern():
    texts = [t or "" for t in ODD] + ["a\x0bb\x0cc\r\nd", "x\x1cy\x85z"]
    seen = {}
    for c in words.chunks(pa.array(texts), most=50):
        h = c.hashes()
        for r in range(c.rows):
            own = [bytes(c.raw[a:b]).decode() for a, b in zip(c.start[c.first[r] : c.first[r + 1]], c.end[c.first[r] : c.first[r + 1]], strict=True)]
            assert own == re.findall(r"[^\x20\x09-\x0D]+", texts[c.row + r])
            for w, x in zip(own, h[c.first[r] : c.first[r + 1]].tolist(), strict=True):
                assert seen.setdefault(w, x) == x
    assert len(set(seen.values())) == len(seen)


def library():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    return path, Tokenizer.from_file(path)


def test_bpe_equals_library_on_odd_and_random_texts():
    path, t = library()
    v = bpe.vocabulary(path)
    rng = random.Random(7)
    texts = [x for x in ODD if x] + ["".join(rng.choice("ab 1²'s\t\n\x85\x1c_.éßⅷ́日😀-") for _ in range(rng.randint(1, 50))) for _ in range(1500)]
    known = sorted({p.encode() for x in texts[:300] for p in v.pieces(x) if p not in v.added})
    codec = bpe.Codec(v, bpe.Transducer(__import__("numpy").frombuffer(bpe.Transducer.build(known, [v.merge(w) for w in known]), "int64")))
    for x in texts:
        want = t.encode(x, add_special_tokens=False).ids
        assert codec.encode(x) == want
        assert codec.decode(want).decode() == t.decode(want, skip_special_tokens=False)


def test_merging_many_words_equals_merging_each():
    v = bpe.vocabulary(library()[0])
    rng = random.Random(17)
    words = ["".join(rng.choice("aeinorst éß日-0 9.") for _ in range(rng.randint(1, 20))).encode()[:60] for _ in range(3000)] + [b"a" * 64, b"\xff\xfe", b" ", b"the the the"]
    ids, count = v.merge_many(words)
    ends = count.cumsum().tolist()
    assert [tuple(ids[e - n : e].tolist()) for e, n in zip(ends, count.tolist(), strict=True)] == [v.merge(w) for w in words]
    codec = bpe.Codec(v, bpe.Transducer(__import__("numpy").frombuffer(bpe.Transducer.build([], []), "int64")))
    assert [codec.decode(x) for x in codec.encode_all(["", "a b", "x" * 500, "a b"])] == [b"", b"a b", b"x" * 500, b"a b"]


def test_transducer_accepts_its_words_only():
    import numpy as np

    built = [b"a", b"ab", b"abc", b"xbc", b"xyz"]
    block = np.frombuffer(bpe.Transducer.build(built, [(i, i + 1) for i in range(5)]), np.int64)
    t = bpe.Transducer(block)
    assert t.lookup(built) == [(i, i + 1) for i in range(5)]
    assert t.lookup([b"", b"b", b"abcd", b"xy", b"zzz"]) == [None] * 5
    assert len(t.accepting) < 1 + sum(map(len, built))
    assert bpe.Transducer(np.frombuffer(bpe.Transducer.build([], []), np.int64)).lookup([b"a"]) == [None]


def test_bpe_query_on_odd_rows(spark, odd):
    path, t = library()
    got = bpe.encode_documents(odd, path, with_ids=True).collect()
    assert len(got) == len(ODD) + 1
    want = sorted(hashlib.sha256(",".join(map(str, t.encode(x or "", add_special_tokens=False).ids)).encode()).hexdigest() for x in [*ODD, ""])
    assert sorted(r.ids_sha256 for r in got) == want
    assert all(r.n_tokens == len(r.ids) for r in got)
    assert bpe.encode_documents(odd.limit(0), path).count() == 0


PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def brute_spans(t):
    out = []
    for k, (kind, p) in enumerate(PATTERNS.items()):
        for m in re.finditer(p, t):
            d = re.sub("[^0-9]", "", m[0])
            if {"email": lambda: True, "ip": lambda m=m: all(int(x) <= 255 for x in m[0].split(".")), "card": lambda d=d: 13 <= len(d) <= 19 and pii.luhn(d), "phone": lambda d=d: 9 <= len(d) <= 15}[kind]():
                out.append((k, m.start(), m.end()))
    return sorted(out)


def test_pii_base_equals_patterns():
    rng = random.Random(3)
    pieces = ["1", "2", "45", "4111111111111111", "9", " ", "-", ".", "..", "+", "+4", "@", "a", "b.c", "@x.y", "(", ")", "é", "_", "%", "255.", "1.2.3.4"]
    for _ in range(4000):
        t = "".join(rng.choice(pieces) for _ in range(rng.randint(1, 30)))
        assert [s for s in pii.find_spans(t) if s[0] < 4] == brute_spans(t)


def test_pii_adds_accounts_secrets_and_addresses_and_redacts():
    t = "see https://me:pw@host.org/x. IBAN: DE89 3704 0044 0532 0130 00, account no. 12345678, token = abcdefgh12345678ab!"
    kinds = [pii.KINDS[s[0]] for s in pii.find_spans(t)]
    assert kinds.count("account") == 2 and "url" in kinds and "secret" in kinds
    assert "3704" not in pii.redact(t, pii.find_spans(t)) and "12345678" not in pii.redact(t, pii.find_spans(t))
    assert pii.find_spans("IBAN: DE88 3704 0044 0532 0130 00 and accounts 12") == []
    assert pii.redact("clean text", pii.find_spans("clean text")) == "clean text"


def test_pii_on_odd_rows(spark, odd):
    got = pii.find_pii(odd).collect()
    assert len(got) == len(ODD) + 1 and all(r.n_email == 0 for r in got)
    kept = pii.redact_documents(odd)
    assert kept.columns == odd.columns and kept.count() == odd.count() and pii.find_pii(odd.limit(0)).count() == 0


def test_webp_round_trip_and_determinism(spark, odd):
    texts = [t or "" for t in ODD] + ["y" * 191, "y" * 192, "z" * 193, "ab" * 9000]
    payloads = [webp.payload_of(t)[1] for t in texts]
    files = webp.encode_payloads(payloads)
    assert all(i[..., :3].tobytes() == p for i, p in zip(webp.decode_files(files), payloads, strict=True))
    assert [webp.encode_payloads([p])[0] for p in payloads] == files
    got = webp.store_and_read(odd).collect()
    assert len(got) == len(ODD) + 1 and all(r.payload_bytes % 192 == 0 and r.payload_bytes > 0 for r in got)
    assert webp.store_and_read(odd.limit(0)).count() == 0
    with pytest.raises(webp.WebPError):
        webp.decode_files([files[7][: len(files[7]) // 2]])


def test_webp_frames_of_every_kind_invert_their_transforms():
    """Text, smooth and grey payloads take the kind made for them; each header names its transforms, and the decoder undoes them."""
    import numpy as np

    rng = random.Random(5)
    text = " ".join("".join(rng.choices("etaonirshdl", k=5)) for _ in range(700)).encode()
    steps = np.cumsum(np.array(rng.choices((-1, 0, 1), k=2048 * 3)).reshape(-1, 3), 0) + np.array(rng.choices((60, 61), k=2048 * 3)).reshape(-1, 3) // 60 * 90
    smooth = (np.repeat(steps[:, :1], 3, axis=1) % 256).astype(np.uint8).tobytes()
    payloads = [p + b" " * (-len(p) % 192) for p in (text, smooth, b" " * 501 + b"===" * 192, b"---" * 3000 + b"***" * 8)]
    cuts = np.array([0, *np.cumsum([len(p) // 3 for p in payloads])])
    pixels = np.frombuffer(b"".join(payloads), np.uint8).reshape(-1, 3)
    kinds = {k: kind for kind, frames, _, _ in webp.coded_pixels(pixels, cuts) for k in frames.tolist()}
    assert kinds[0] == "text" and kinds[1] == "smooth" and kinds[2] == kinds[3] == "marks"
    files = webp.encode_payloads(payloads)
    assert all(i[..., :3].tobytes() == p and (i[..., 3] == 255).all() for i, p in zip(webp.decode_files(files), payloads, strict=True))
    transforms = [sorted({t[0] for _, _, d in webp.parse_file(f) for t in webp.read_header(d)[2].transforms}) for f in files]
    assert transforms[0] == [0] and transforms[1] == [0, 1] and transforms[2] == [3]
    for mode in (0, 1, 2):
        image = np.frombuffer(rng.randbytes(7 * 9 * 4), np.uint8).reshape(7, 9, 4)
        fast, slow = image.copy(), image.copy()
        webp.inverse_one_mode(fast, mode)
        modes = np.full((7, 9), mode << 8)
        modes[0, 0] = 11 << 8  # another mode in a corner that has fixed predictions, so the general way is taken
        webp.inverse_predictor(slow, 0, modes)
        assert (fast == slow).all()


def test_language_by_compression(spark, odd):
    rows = [(i, " ".join(random.Random(i).choices(("the", "and", "house") if i % 2 else ("der", "und", "haus"), k=40)), "en" if i % 2 else "de") for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    fitted = zlang.fit_dictionaries(docs.where("doc_id < 120"))
    got = zlang.identify(docs.where("doc_id >= 120"), fitted).collect()
    assert all(r.lang_pred == ("en" if r.doc_id % 2 else "de") for r in got)
    by = {r.lang_pred for r in zlang.identify(odd, fitted).where("doc_id is null or doc_id < 3").collect()}
    assert by <= {"und", "en", "de"} and all(0 <= r.score <= 1 for r in got)
    assert {r.lang_pred for r in zlang.identify(odd, zlang.fit_dictionaries(docs.where("lang is null"))).collect()} == {"und"}
    assert zlang.identify(odd.limit(0), fitted).count() == 0


def test_language_learns_whole_distinct_texts(spark):
    rng = random.Random(8)
    letters = "abcdefghijklmnopqrstuvwxyz"
    texts = [" ".join("".join(rng.choices(letters, k=9)) for _ in range(n)) for n in (1500, 30, 900)]
    rows = [(0, texts[0], "en"), (1, texts[1], "en"), (2, texts[2], "en")] + [(i, texts[1], "en") for i in range(3, 90)]
    got = zlang.fit_dictionaries(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert sorted(got["en"].decode().split("\n")) == sorted(texts)
    many = [(i, " ".join("".join(rng.choices(letters, k=9)) for _ in range(3000)), "en") for i in range(40)]
    found = zlang.fit_dictionaries(spark.createDataFrame(many, "doc_id long, text string, lang string"))["en"]
    assert zlang.DICT_BYTES <= len(found) < zlang.DICT_BYTES + 30_000 and set(found.decode().split("\n")) <= {t for _, t, _ in many}


def test_toxicity_learns_held_out_rows(spark, odd):
    rng = random.Random(2)
    vocabulary = [f"w{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(300)]
    texts = [(i, " ".join(rng.choices(vocabulary, k=60) + (["vile"] if i % 4 == 0 else [])), int(i % 4 == 0)) for i in range(1200)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in texts], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in texts if i < 900], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    got = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    held = [(got[i].predicted, y) for i, _, y in texts if i >= 900]
    assert sum(p == y for p, y in held) / len(held) > 0.97 and len(model.index) < 300
    assert toxicity.reject_toxic(docs, model).where("doc_id % 4 = 0").count() < 15
    assert ids_of(toxicity.score(odd, model).collect()) == ids_of(odd.collect())
    untrained = toxicity.fit(docs, labels.limit(0))
    assert {r.predicted for r in toxicity.score(odd, untrained).collect()} == {0}
    assert toxicity.reject_toxic(odd, model).columns == odd.columns


def test_simhash_windows_equal_counting():
    import numpy as np

    rng = np.random.default_rng(1)
    h = rng.integers(0, 2**64 - 1, 400, dtype=np.uint64)
    for size in (1, 2, 40, 127, 128, 200, 255):
        at = np.arange(0, 100, 9)
        for a, f in zip(at, decontaminate.fingerprints(decontaminate.running(h), at, size), strict=True):
            assert int(f) == sum(1 << b for b in range(64) if 2 * sum((int(x) >> b) & 1 for x in h[a : a + size]) > size)


def test_decontamination_finds_exact_and_edited_items(spark, odd):
    rng = random.Random(5)
    pool = [f"{a}{b}{c}" for a in "bdfgk" for b in "aeiou" for c in "lmnrst"]
    items = [(i, " ".join(rng.choices(pool, k=rng.randint(50, 70)))) for i in range(30)] + [(98, "too short"), (99, None)]
    docs, want = [], set()
    for i in range(90):
        text = rng.choices(pool, k=rng.randint(0, 300))
        if i < 60:
            w = items[i % 30][1].split()
            if i >= 30:
                w[rng.randrange(len(w))] = "edit"
            at = rng.randint(0, len(text))
            text[at:at] = w
            want.add((i, i % 30))
        docs.append((i, " ".join(text)))
    docs.append((500, "Too, SHORT!"))
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.find_leaks(frame, bench).collect()}
    assert got == want | {(500, 98)}
    assert {r.doc_id for r in decontaminate.without_leaks(frame, bench).collect()} == set(range(60, 90))
    assert decontaminate.find_leaks(odd, bench).count() == 0 and decontaminate.find_leaks(odd, bench.limit(0)).count() == 0
    assert decontaminate.without_leaks(odd, bench).columns == odd.columns


@pytest.mark.parametrize("place", [0, 270, 540])
def test_decontamination_finds_long_items_wherever_they_are_edited(spark, place):
    rng = random.Random(6)
    pool = [f"{a}{b}{c}{d}" for a in "bdfgk" for b in "aeiou" for c in "lmnrst" for d in "aeiou"]
    items = [(i, " ".join(rng.choices(pool, k=600))) for i in range(20)]
    docs = []
    for i, text in items:
        w = text.split()
        w[place : place + 60] = rng.choices(pool, k=60)
        docs.append((i, " ".join(rng.choices(pool, k=rng.randint(0, 60)) + w + rng.choices(pool, k=9))))
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in decontaminate.find_leaks(frame, bench).collect()} == {(i, i) for i in range(20)}
    assert decontaminate.without_leaks(frame, bench).count() == 0


def test_decontamination_finds_short_items_at_every_place_and_keeps_null_ids(spark):
    items = [(1, "alpha"), (2, "Beta gamma"), (3, "delta eps zeta"), (4, "gamma delta"), (None, "eta theta"), (None, " ".join(f"n{i}" for i in range(30)))]
    docs, want = [], set()
    for i, (item, text) in enumerate(items):
        for place in range(5):
            docs.append((10 * i + place, " ".join(["x"] * place + [text.upper(), "y", text])))
            want.add((10 * i + place, item, 1.0, place))
    docs += [(97, "beta x gamma"), (98, "delta eps"), (99, "zeta"), (100, "beta")]
    frame = spark.createDataFrame(docs, "doc_id long, text string").coalesce(1)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = [(r.doc_id, r.item_id, r.similarity, r.first_word) for r in decontaminate.find_leaks(frame, bench).collect()]
    assert len(got) == len(want) and set(got) == want
    assert {r.doc_id for r in decontaminate.without_leaks(frame, bench).collect()} == {97, 98, 99, 100}


def test_decontamination_against_all_windows():
    """Items of 5 to 320 words, edited at random places, against brute force over every window; the recall is measured."""
    rng = random.Random(12)
    pool = [f"{a}{b}{c}" for a in "bdfgk" for b in "aeiou" for c in "lmnrst"]
    items = [(i, " ".join(rng.choices(pool, k=rng.choice((5, 8, 15, 40, 90, 150, 320))))) for i in range(40)]
    docs = []
    for i in range(160):
        w = items[i % 40][1].split()
        for _ in range(rng.randint(0, max(1, len(w) // 25))):
            k = rng.randrange(len(w))
            w[k : k + rng.randint(0, 1)] = rng.choices(pool, k=rng.randint(0, 1))
        docs.append(" ".join(rng.choices(pool, k=rng.randint(0, 40)) + w + rng.choices(pool, k=rng.randint(0, 40))))
    index = decontaminate.Index(items)
    found = {(r, index.ids[k]): s for r, k, s, _ in decontaminate.matches(index, pa.array(docs))}
    want = {}
    for r, text in enumerate(docs):
        w = text.split()
        for i, item in items:
            v = item.split()
            mine = decontaminate.Counter(zip(*(v[j:] for j in range(5)), strict=False))
            for a in range(len(w)):
                s = decontaminate.similarity(mine, decontaminate.Counter(zip(*(w[a : a + len(v)][j:] for j in range(5)), strict=False)))
                if s >= 0.8:
                    want[r, i] = max(s, want.get((r, i), 0))
    assert found.keys() <= want.keys() and all(s <= want[k] for k, s in found.items())
    assert len(want) > 100 and len(found) >= 0.98 * len(want)


def test_decontamination_in_several_passes_and_on_long_texts(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "PASS_PRINTS", 60)
    rng = random.Random(13)
    pool = [f"{a}{b}{c}" for a in "bdfgk" for b in "aeiou" for c in "lmnrst"]
    items = [(i, " ".join(rng.choices(pool, k=30))) for i in range(25)] + [(3, None), (4, "")]
    long = " ".join([*rng.choices(pool, k=150_000), items[7][1], *rng.choices(pool, k=150_000)])
    frame = spark.createDataFrame([(1, items[3][1]), (2, long), (3, None), (4, "no item"), (5, items[3][1] + " x " + items[3][1])], "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert len(decontaminate.passes(bench)) > 3
    assert {(r.doc_id, r.item_id, r.similarity, r.first_word) for r in decontaminate.find_leaks(frame, bench).collect()} == {(1, 3, 1.0, 0), (2, 7, 1.0, 150_000), (5, 3, 1.0, 0)}
    assert {r.doc_id for r in decontaminate.without_leaks(frame, bench).collect()} == {3, 4}
    assert decontaminate.find_leaks(frame.limit(0), bench).count() == 0 and decontaminate.without_leaks(frame.limit(0), bench).count() == 0
