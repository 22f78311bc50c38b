"""Known answers and state machines for expressions and counters."""

import random

from pyspark.sql import functions as F

from inkstone.functions import numbering as N
from inkstone.functions import text as X
from inkstone.functions import values as V
from inkstone.operators import sequences as Q


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_numbers(spark):
    got = spark.createDataFrame([(n,) for n in (0, 1, 4, 26, 27, 52, 53, 702, 703, 1994, 4001)], "n long").select("n", N.roman_upper(F.col("n")).alias("r"), N.alpha_bijective(F.col("n")).alias("a"), N.alpha_cyclic(F.col("n")).alias("c")).collect()
    by = {r.n: r for r in got}
    assert by[1994].r == "MCMXCIV" and by[0].r == "" and by[4001].r == "MMMMI"
    assert [by[n].a for n in (0, 1, 26, 27, 52, 53, 702, 703)] == ["", "A", "Z", "AA", "AZ", "BA", "ZZ", "AAA"]
    assert by[27].c == "A"


def test_words_for_numbers(spark):
    assert one(spark, N.hangul_number(F.lit(21))) == "이십일"
    assert one(spark, N.ideograph_number(F.lit(10))) == "十"
    assert one(spark, N.circled_auto(F.lit(35))) == "㉟"
    assert one(spark, N.from_template(F.lit("제^N장 ^1"), F.lit("3"))) == "제3장 3"
    assert one(spark, N.numbered(F.lit("none"), F.lit(2), F.lit("arabic"), F.lit(1))) == "가."


def test_values(spark):
    assert one(spark, V.mm_text(F.lit(0.0))) == "0.00mm"
    assert one(spark, V.mm_text(F.lit(3.0))) == "3mm"
    assert one(spark, V.mm_text(F.lit(3.146))) == "3.15mm"
    assert one(spark, V.colour_hex(F.lit(0x0000FF))) == "#FF0000"
    assert one(spark, V.parse_colour(F.lit("#zz0000"))) is None
    assert one(spark, V.version_text(F.lit(0x05010001))) == "5.1.0.1"


def test_text(spark):
    assert one(spark, X.visible_spaces(F.lit("  a   b "))) == "&nbsp;&nbsp;a &nbsp;&nbsp;b&nbsp;"
    assert one(spark, X.command_to_url(F.lit("a\\:b|x;2;0"))) == "mailto:a:b"
    assert one(spark, X.command_to_url(F.lit("no type"))) is None
    assert one(spark, X.markdown_style(F.lit("t"), F.lit(True), F.lit(True), F.lit(True))) == "~~***t***~~"
    assert one(spark, X.strip_links(F.lit("a ![b](c) [d](e) f"))) == "a   f"


def outline_model(levels):
    counts, out = [0] * 8, []
    for level in levels:
        if level > 7:
            out.append(0)
            continue
        counts[level] += 1
        for deeper in range(level + 1, 8):
            counts[deeper] = 0
        out.append(counts[level])
    return out


def test_outline_counter_equals_state_machine(spark):
    rng = random.Random(1)
    rows, want = [], {}
    for doc in range(20):
        levels = [rng.randint(1, 9) for _ in range(100)]
        for pos, (level, n) in enumerate(zip(levels, outline_model(levels), strict=True)):
            rows.append((doc, pos, level))
            want[doc, pos] = n
    df = spark.createDataFrame(rows, "doc long, pos long, level long")
    assert {(r.doc, r.pos): r.n for r in Q.outline_numbers(df, ["doc"], "pos", "level").collect()} == want


def test_reset_counter(spark):
    rows = [(1, 0, None), (1, 1, None), (1, 2, 7), (1, 3, None), (1, 4, None)]
    df = spark.createDataFrame(rows, "doc long, pos long, start long")
    reset = F.col("start").isNotNull()
    got = Q.numbers_with_reset(df, ["doc"], "pos", reset, F.col("start"), ~reset).orderBy("pos").collect()
    assert [r.n for r in got] == [1, 2, None, 7, 8]


def test_letters_go_on_after_zzz(spark):
    """27 AA, 703 AAA, 18279 AAAA, up to the largest number of 32 bits: the plain loop over base 26 without a zero."""

    def letters(n):
        out = ""
        while n > 0:
            out, n = chr(65 + (n - 1) % 26) + out, (n - 1) // 26
        return out

    numbers = [0, 26, 27, 702, 703, 18278, 18279, 19999, 475254, 475255, 12356630, 12356631, 321272406, 321272407, 2**32 - 1]
    got = {r.n: r.t for r in spark.createDataFrame([(n,) for n in numbers], "n long").select("n", N.alpha_bijective(F.col("n")).alias("t")).collect()}
    assert got == {n: letters(n) for n in numbers} and got[18279] == "AAAA"
