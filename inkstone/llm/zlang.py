"""Language identification by compression.

A bounded sample of each language's labelled texts becomes a raw-content zstandard dictionary. A text belongs to the
language whose dictionary gives the smallest encoding; where the second smallest is hardly larger, the decision is
marked rejected, though the smallest stays the prediction.

Defined cases: a very long text is compressed whole; a text that is null or has no letter is `und`, rejected, with score 0; equal sizes go to the language
of most labelled texts; rows are independent; null lang teaches nothing; without any labelled text every text is `und`;
further columns of the input are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import re

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkstone.llm.common import map_batches, texts_of

#: Bounds of the fitting sample: one text from each of so many hash buckets a language, and no further text from so many bytes of text on.
BUCKETS, DICT_BYTES = 64, 112 * 1024
#: zstandard level, and the least relative distance of the two smallest sizes for a decision.
LEVEL, MARGIN = 6, 0.01


NO_LETTERS = re.compile(r"[\W\d_]+")


def plain(text: str) -> bytes:
    """Lower-case letters with single spaces: marks and digits tell nothing of a language."""
    return NO_LETTERS.sub(" ", text.lower()).encode()


def fit_dictionaries(labelled: DataFrame) -> dict[str, bytes]:
    """Dictionaries by language, the most frequent language first.

    labelled: doc_id, text, lang. Of each language and hash bucket the text of least hash, so equal texts count once; these whole
    texts in the order of their hashes until they have DICT_BYTES. Hashes and lengths come first, so no text is shuffled but these."""
    keyed = labelled.where("lang is not null and text is not null").withColumn("h", F.xxhash64("text", "lang")).withColumn("bucket", F.pmod("h", F.lit(BUCKETS)))
    least = keyed.groupBy("lang", "bucket").agg(F.min(F.struct("h", F.octet_length("text").alias("size"))).alias("x")).select("lang", "x.h", "x.size").collect()
    often = {r.lang: r.n for r in labelled.where("lang is not null").groupBy("lang").agg(F.count("*").alias("n")).collect()}
    taken, filled = [], dict.fromkeys(often, 0)
    for r in sorted(least, key=lambda r: (r.lang, r.h)):
        if filled[r.lang] < DICT_BYTES:
            taken.append((r.lang, r.h))
            filled[r.lang] += r.size
    wanted = labelled.sparkSession.createDataFrame(taken, "lang string, h long")
    rows = keyed.join(F.broadcast(wanted), ["lang", "h"]).groupBy("lang", "h").agg(F.min("text").alias("text"))
    by: dict[str, list[tuple[int, bytes]]] = {}
    for r in rows.collect():
        by.setdefault(r.lang, []).append((r.h, plain(r.text)))
    return {lang: b"\n".join(t for _, t in sorted(texts)) for lang, texts in sorted(by.items(), key=lambda x: (-often[x[0]], x[0]))}


class Classifier:
    def __init__(self, dictionaries: dict[str, bytes]):
        self.langs = list(dictionaries)
        made = [zstandard.ZstdCompressionDict(dictionaries[k], dict_type=zstandard.DICT_TYPE_RAWCONTENT) for k in self.langs]
        for d in made:
            d.precompute_compress(level=LEVEL)
        self.encoders = [zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=False, write_dict_id=False) for d in made]

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        if not text or not self.langs or not any(map(str.isalpha, text)):
            return "und", 0.0, True
        raw = plain(text)
        sizes = [len(e.compress(raw)) for e in self.encoders]
        best = min(range(len(sizes)), key=sizes.__getitem__)
        rest = min((s for i, s in enumerate(sizes) if i != best), default=2 * sizes[best])
        margin = (rest - sizes[best]) / rest
        return self.langs[best], 1 - math.exp(-margin / MARGIN) / 2, margin < MARGIN


def identify(docs: DataFrame, dictionaries: dict[str, bytes]) -> DataFrame:
    """doc_id, lang_pred, score, rejected for each row. The dictionaries are of bounded size, so they travel with the tasks."""
    shared = docs.sparkSession.sparkContext.broadcast(dictionaries)

    def run(batches):
        c = Classifier(shared.value)
        for batch in batches:
            found = [c.predict(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch.column("doc_id"), "lang_pred": pa.array([x[0] for x in found], pa.string()),
                "score": pa.array([x[1] for x in found], pa.float64()), "rejected": pa.array([x[2] for x in found], pa.bool_()),
            })

    return map_batches(texts_of(docs), run, "doc_id long, lang_pred string, score double, rejected boolean")
