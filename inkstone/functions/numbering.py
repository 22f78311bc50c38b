"""Number formats of outlines, lists and automatic numbers, as Column expressions over non-negative whole numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the document formats.
SYLLABLES = "가나다라마바사아자차카타파하"
JAMO = "ㄱㄴㄷㄹㅁㅂㅅㅇㅈㅊㅋㅌㅍㅎ"
STEMS = "갑을병정무기경신임계"
STEM_IDEOGRAPHS = "甲乙丙丁戊己庚辛壬癸"
HANGUL_DIGITS, HANGUL_TEN = "일이삼사오육칠팔구", "십"
IDEOGRAPH_DIGITS, IDEOGRAPH_TEN = "一二三四五六七八九", "十"
ROMAN = (("", "I", "II", "III", "IV", "V", "VI", "VII", "VIII", "IX"), ("", "X", "XX", "XXX", "XL", "L", "LX", "LXX", "LXXX", "XC"), ("", "C", "CC", "CCC", "CD", "D", "DC", "DCC", "DCCC", "CM"))
CIRCLED_DIGITS = "".join(map(chr, range(0x2460, 0x2474)))
CIRCLED_MORE = "".join(map(chr, range(0x3251, 0x3260)))
CIRCLED_UPPER = "".join(map(chr, range(0x24B6, 0x24D0)))
CIRCLED_LOWER = "".join(map(chr, range(0x24D0, 0x24EA)))
CIRCLED_SYLLABLES = "".join(map(chr, range(0x326E, 0x327C)))
CIRCLED_JAMO = "".join(map(chr, range(0x3260, 0x326E)))
CIRCLED_IDEOGRAPHS = "".join(map(chr, range(0x3280, 0x328A)))
#: Shape codes of automatic numbers.
SHAPES = {
    0: "arabic", 1: "circled_arabic", 2: "roman_upper", 3: "roman_lower", 4: "alpha_upper", 5: "alpha_lower", 6: "circled_alpha_upper", 7: "circled_alpha_lower", 8: "hangul",
    9: "circled_hangul", 10: "jamo", 11: "circled_jamo", 12: "hangul_number", 13: "ideograph_number", 14: "circled_ideograph", 15: "stem", 16: "stem_ideograph", 128: "four_repeat", 129: "custom_repeat",
}


def pick(chars: str, i: Column) -> Column:
    """The i-th character from 1."""
    return F.substring(F.lit(chars), i.cast("int"), F.lit(1)) if isinstance(i, Column) else F.lit(chars[i - 1])


def decimal(n: Column) -> Column:
    return n.cast("string")


def cyclic(chars: str, n: Column) -> Column:
    """Starts anew after the last character; '' for 0."""
    return F.when(n == 0, F.lit("")).otherwise(pick(chars, F.pmod(n - 1, F.lit(len(chars))) + 1))


def roman_upper(n: Column) -> Column:
    digit = lambda k: F.element_at(F.array(*map(F.lit, ROMAN[k])), (F.pmod(F.floor(n / 10**k), F.lit(10)) + 1).cast("int"))
    return F.concat(F.repeat(F.lit("M"), F.floor(n / 1000).cast("int")), digit(2), digit(1), digit(0))


def roman_lower(n: Column) -> Column:
    return F.lower(roman_upper(n))


def alpha_cyclic(n: Column, upper: bool = True) -> Column:
    return cyclic("ABCDEFGHIJKLMNOPQRSTUVWXYZ" if upper else "abcdefghijklmnopqrstuvwxyz", n)


def alpha_bijective(n: Column, upper: bool = True, digits: int = 7) -> Column:
    """1 A, 26 Z, 27 AA, as far as so many letters go (7 letters: over 8 * 10**9)."""
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ" if upper else "abcdefghijklmnopqrstuvwxyz"
    out, shorter = F.lit(""), 0
    for k in range(digits):
        shorter += 26**k  # the least number of k + 1 letters
        out = F.concat(F.when(n >= shorter, pick(letters, F.pmod(F.floor((n - shorter) / 26**k), F.lit(26)) + 1)).otherwise(F.lit("")), out)
    return out


def hangul(n: Column) -> Column:
    return cyclic(SYLLABLES, n)


def jamo(n: Column) -> Column:
    return cyclic(JAMO, n)


def within(chars: str, n: Column, other: Column, first: int = 1) -> Column:
    return F.when(n.between(first, first + len(chars) - 1), pick(chars, n - first + 1)).otherwise(other)


def circled_outline(n: Column) -> Column:
    return within(CIRCLED_DIGITS, n, decimal(n))


def circled_auto(n: Column) -> Column:
    return within(CIRCLED_DIGITS, n, within(CIRCLED_MORE, n, decimal(n), 21))


def tens(digits: str, ten: str, n: Column) -> Column:
    """1 to 99 in words of tens and ones; other numbers stay decimal."""
    t, o = F.floor(n / 10), F.pmod(n, F.lit(10))
    some = lambda x, least: F.when(x >= least, pick(digits, x)).otherwise(F.lit(""))
    return F.when(n.between(1, 99), F.concat(some(t, 2), F.when(t >= 1, F.lit(ten)).otherwise(F.lit("")), some(o, 1))).otherwise(decimal(n))


def hangul_number(n: Column) -> Column:
    return tens(HANGUL_DIGITS, HANGUL_TEN, n)


def ideograph_number(n: Column) -> Column:
    return tens(IDEOGRAPH_DIGITS, IDEOGRAPH_TEN, n)


def or_decimal(text: Column, n: Column) -> Column:
    return F.when(n == 0, decimal(n)).otherwise(text)


def by_shape(shape: Column, n: Column) -> Column:
    """An automatic number in the shape of its code; unknown and repeating shapes stay decimal."""
    forms = {
        1: circled_auto(n), 2: roman_upper(n), 3: roman_lower(n), 4: alpha_bijective(n), 5: alpha_bijective(n, False),
        6: within(CIRCLED_UPPER, n, alpha_bijective(n)), 7: within(CIRCLED_LOWER, n, alpha_bijective(n, False)), 8: or_decimal(hangul(n), n),
        9: within(CIRCLED_SYLLABLES, n, or_decimal(hangul(n), n)), 10: or_decimal(jamo(n), n), 11: within(CIRCLED_JAMO, n, or_decimal(jamo(n), n)),
        12: hangul_number(n), 13: ideograph_number(n), 14: within(CIRCLED_IDEOGRAPHS, n, ideograph_number(n)),
        15: or_decimal(cyclic(STEMS, n), n), 16: or_decimal(cyclic(STEM_IDEOGRAPHS, n), n),
    }
    out = F.when(shape == 0, decimal(n))
    for code, text in forms.items():
        out = out.when(shape == code, text)
    return out.otherwise(decimal(n))


def outline_format(level: Column, n: Column) -> Column:
    d, h = decimal(n), hangul(n)
    text = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))
    return F.when(level == 2, text(h, ".")).when(level == 3, text(d, ")")).when(level == 4, text(h, ")")).when(level == 5, text("(", d, ")")).when(level == 6, text("(", h, ")")).when(level == 7, circled_outline(n)).otherwise(text(d, "."))


def narrow_kind(kind: Column) -> Column:
    """The eight types of list numbers of the nineteen that automatic numbers know; any other is arabic."""
    names = {1: "circled", 2: "roman_upper", 3: "roman_lower", 4: "alpha_upper", 5: "alpha_lower", 8: "hangul", 10: "hangul_cycle"}
    out = F.when(kind == 1, F.lit(names[1]))
    for code, name in names.items():
        out = out.when(kind == code, F.lit(name))
    return out.otherwise(F.lit("arabic"))


def list_format(kind: Column, n: Column) -> Column:
    """The eight number types of lists, by name."""
    return (
        F.when(kind == "circled", circled_outline(n)).when(kind == "roman_upper", roman_upper(n)).when(kind == "roman_lower", roman_lower(n))
        .when(kind == "alpha_upper", alpha_cyclic(n)).when(kind == "alpha_lower", alpha_cyclic(n, False)).when(kind.isin("hangul", "hangul_cycle"), hangul(n)).otherwise(decimal(n))
    )


def template_valid(template: Column) -> Column:
    return template.isNotNull() & template.contains("^") & ~template.rlike("[\\x00-\\x08\\x0A-\\x1F\\x7F]")


def from_template(template: Column, number: Column) -> Column:
    """Every ^1 to ^7 and ^N becomes the formatted number."""
    return F.regexp_replace(template, F.lit("\\^[1-7N]"), number)


def numbered(template: Column, level: Column, kind: Column, n: Column) -> Column:
    """A valid template, else the outline's own format."""
    return F.when(template_valid(template), from_template(template, list_format(kind, n))).otherwise(outline_format(level, n))
