"""Scalar queries: one expression over one table each."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkstone.functions import numbering as N
from inkstone.functions import text as X
from inkstone.functions import values as V


def over(table: str, *cols: Callable[[], Column] | str) -> Callable[[SparkSession, str], DataFrame]:
    """A projection of one table; columns are made when a session runs."""
    return lambda spark, d: spark.read.parquet(f"{d}/{table}.parquet").select(*(c if isinstance(c, str) else c() for c in cols))


def sql_cyclic(chars: str, n: str) -> str:
    return f"CASE WHEN {n} = 0 THEN '' ELSE substring('{chars}', CAST(({n} - 1) % {len(chars)} + 1 AS INTEGER), 1) END"


def sql_roman(n: str) -> str:
    digits = " || ".join(f"list_extract([{', '.join(repr(x) for x in N.ROMAN[k])}], CAST(({n} // {10**k}) % 10 + 1 AS INTEGER))" for k in (2, 1, 0))
    return f"repeat('M', CAST({n} // 1000 AS INTEGER)) || {digits}"


def sql_bijective(n: str) -> str:
    """A to ZZZ, by counting the shorter words off."""
    letter = lambda e: f"chr(CAST(65 + {e} AS INTEGER))"
    return (
        f"CASE WHEN {n} = 0 THEN '' WHEN {n} <= 26 THEN {letter(f'({n} - 1)')} WHEN {n} <= 702 THEN {letter(f'(({n} - 27) // 26)')} || {letter(f'(({n} - 27) % 26)')} "
        f"ELSE {letter(f'(({n} - 703) // 676)')} || {letter(f'((({n} - 703) // 26) % 26)')} || {letter(f'(({n} - 703) % 26)')} END"
    )


def sql_within(chars: str, n: str, other: str, first: int = 1) -> str:
    return f"CASE WHEN {n} BETWEEN {first} AND {first + len(chars) - 1} THEN substring('{chars}', CAST({n} - {first - 1} AS INTEGER), 1) ELSE {other} END"


def sql_tens(digits: str, ten: str, n: str) -> str:
    words = "[''" + "".join(f", '{c}'" for c in digits) + "]"
    return f"CASE WHEN {n} BETWEEN 1 AND 99 THEN (CASE WHEN {n} >= 20 THEN list_extract({words}, CAST({n} // 10 + 1 AS INTEGER)) ELSE '' END) || (CASE WHEN {n} >= 10 THEN '{ten}' ELSE '' END) || list_extract({words}, CAST({n} % 10 + 1 AS INTEGER)) ELSE CAST({n} AS VARCHAR) END"


def sql_circled(n: str) -> str:
    return sql_within(N.CIRCLED_DIGITS, n, f"CAST({n} AS VARCHAR)")


def sql_outline(level: str, n: str) -> str:
    h, d = f"({sql_cyclic(N.SYLLABLES, n)})", f"CAST({n} AS VARCHAR)"
    return f"CASE {level} WHEN 2 THEN {h} || '.' WHEN 3 THEN {d} || ')' WHEN 4 THEN {h} || ')' WHEN 5 THEN '(' || {d} || ')' WHEN 6 THEN '(' || {h} || ')' WHEN 7 THEN {sql_circled(n)} ELSE {d} || '.' END"


def sql_shape(shape: str, n: str) -> str:
    d = f"CAST({n} AS VARCHAR)"
    zero = lambda t: f"CASE WHEN {n} = 0 THEN '0' ELSE {t} END"
    hangul, jamo = zero(sql_cyclic(N.SYLLABLES, n)), zero(sql_cyclic(N.JAMO, n))
    forms = {
        1: sql_within(N.CIRCLED_DIGITS, n, sql_within(N.CIRCLED_MORE, n, d, 21)), 2: sql_roman(n), 3: f"lower({sql_roman(n)})", 4: sql_bijective(n), 5: f"lower({sql_bijective(n)})",
        6: sql_within(N.CIRCLED_UPPER, n, sql_bijective(n)), 7: sql_within(N.CIRCLED_LOWER, n, f"lower({sql_bijective(n)})"), 8: hangul, 9: sql_within(N.CIRCLED_SYLLABLES, n, hangul), 10: jamo,
        11: sql_within(N.CIRCLED_JAMO, n, jamo), 12: sql_tens(N.HANGUL_DIGITS, N.HANGUL_TEN, n), 13: sql_tens(N.IDEOGRAPH_DIGITS, N.IDEOGRAPH_TEN, n),
        14: sql_within(N.CIRCLED_IDEOGRAPHS, n, sql_tens(N.IDEOGRAPH_DIGITS, N.IDEOGRAPH_TEN, n)), 15: zero(sql_cyclic(N.STEMS, n)), 16: zero(sql_cyclic(N.STEM_IDEOGRAPHS, n)),
    }
    return f"CASE {shape} " + " ".join(f"WHEN {k} THEN {t}" for k, t in forms.items()) + f" ELSE {d} END"


def sql_names(x: str, names: dict[int, str]) -> str:
    return "concat_ws(',', " + ", ".join(f"CASE WHEN ({x} >> {b}) & 1 = 1 THEN '{n}' END" for b, n in names.items()) + ")"


def part_query(fn: Callable[[Column], Column], sql: str, mod: int | None = None):
    """A number format over part keys (modulo mod). sql holds {n}."""
    n = (lambda: F.col("p_partkey")) if mod is None else (lambda: F.pmod(F.col("p_partkey"), F.lit(mod)))
    s = "p_partkey" if mod is None else f"(p_partkey % {mod})"
    return over("part", "p_partkey", lambda: fn(n()).alias("text")), f"SELECT p_partkey, {sql.replace('{n}', s)} AS text FROM part"


def catalog() -> dict:
    c: dict = {}
    plain = {
        "roman_upper": (N.roman_upper, sql_roman("{n}"), None), "roman_lower": (N.roman_lower, f"lower({sql_roman('{n}')})", None),
        "alpha_cyclic": (N.alpha_cyclic, sql_cyclic("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "{n}"), None), "alpha_bijective": (N.alpha_bijective, sql_bijective("{n}"), None),
        "hangul_cyclic": (N.hangul, sql_cyclic(N.SYLLABLES, "{n}"), None), "jamo_cyclic": (N.jamo, sql_cyclic(N.JAMO, "{n}"), None),
        "stem_hangul": (lambda n: N.cyclic(N.STEMS, n), sql_cyclic(N.STEMS, "{n}"), None), "stem_hanja": (lambda n: N.cyclic(N.STEM_IDEOGRAPHS, n), sql_cyclic(N.STEM_IDEOGRAPHS, "{n}"), None),
        "circled_list": (N.circled_outline, sql_circled("{n}"), 40), "circled_auto": (N.circled_auto, sql_within(N.CIRCLED_DIGITS, "{n}", sql_within(N.CIRCLED_MORE, "{n}", "CAST({n} AS VARCHAR)", 21)), 40),
        "circled_alpha": (lambda n: N.within(N.CIRCLED_UPPER, n, N.alpha_bijective(n)), sql_within(N.CIRCLED_UPPER, "{n}", sql_bijective("{n}")), 40),
        "hangul_numeral": (N.hangul_number, sql_tens(N.HANGUL_DIGITS, N.HANGUL_TEN, "{n}"), 120), "ideograph_numeral": (N.ideograph_number, sql_tens(N.IDEOGRAPH_DIGITS, N.IDEOGRAPH_TEN, "{n}"), 120),
    }
    for name, (fn, sql, mod) in plain.items():
        c[name] = part_query(fn, sql, mod)
    c["outline_format"] = (
        over("lineitem", "l_orderkey", "l_linenumber", "l_partkey", lambda: N.outline_format(F.col("l_linenumber"), F.col("l_partkey")).alias("label")),
        f"SELECT l_orderkey, l_linenumber, l_partkey, {sql_outline('l_linenumber', 'l_partkey')} AS label FROM lineitem",
    )
    kinds = ("arabic", "circled", "roman_upper", "roman_lower", "alpha_upper", "alpha_lower", "hangul", "hangul_cycle")
    template = lambda k: F.element_at(F.array(*map(F.lit, ("^1.", "제^N장", "(^2)", "no mark"))), (F.pmod(k, F.lit(4)) + 1).cast("int"))
    kind = lambda k: F.element_at(F.array(*map(F.lit, kinds)), (F.pmod(k, F.lit(8)) + 1).cast("int"))
    key, n = "o_orderkey", "(o_orderkey % 100)"
    by_kind = f"CASE o_orderkey % 8 WHEN 1 THEN {sql_circled(n)} WHEN 2 THEN {sql_roman(n)} WHEN 3 THEN lower({sql_roman(n)}) WHEN 4 THEN {sql_cyclic('ABCDEFGHIJKLMNOPQRSTUVWXYZ', n)} WHEN 5 THEN {sql_cyclic('abcdefghijklmnopqrstuvwxyz', n)} WHEN 6 THEN {sql_cyclic(N.SYLLABLES, n)} WHEN 7 THEN {sql_cyclic(N.SYLLABLES, n)} ELSE CAST({n} AS VARCHAR) END"
    level = "(o_orderkey % 7 + 1)"
    c["number_template"] = (
        over("orders", key, lambda: N.numbered(template(F.col(key)), F.pmod(F.col(key), F.lit(7)) + 1, kind(F.col(key)), F.pmod(F.col(key), F.lit(100))).alias("label")),
        f"SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN ({by_kind}) || '.' WHEN 1 THEN '제' || ({by_kind}) || '장' WHEN 2 THEN '(' || ({by_kind}) || ')' ELSE {sql_outline(level, n)} END AS label FROM orders",
    )
    shape = lambda: F.when(F.pmod(F.col("p_partkey"), F.lit(19)) < 17, F.pmod(F.col("p_partkey"), F.lit(19))).otherwise(F.pmod(F.col("p_partkey"), F.lit(19)) + 111)
    c["autonumber_shape_dispatch"] = (
        over("part", "p_partkey", lambda: N.by_shape(shape(), F.pmod(F.col("p_partkey"), F.lit(120))).alias("text")),
        f"SELECT p_partkey, {sql_shape('(CASE WHEN p_partkey % 19 < 17 THEN p_partkey % 19 ELSE p_partkey % 19 + 111 END)', '(p_partkey % 120)')} AS text FROM part",
    )
    c["unit_to_mm"] = (
        over("lineitem", "l_orderkey", "l_linenumber", "l_quantity", lambda: V.round2(V.unit_to_mm(F.col("l_quantity") * 720)).alias("mm"), lambda: V.mm_to_unit(F.col("l_quantity")).alias("units")),
        "SELECT l_orderkey, l_linenumber, l_quantity, round(l_quantity * 720 / 7200 * 25.4 * 100, 0) / 100 AS mm, CAST(trunc(l_quantity / 25.4 * 7200) AS BIGINT) AS units FROM lineitem",
    )
    c["mm_format"] = (
        over("lineitem", "l_orderkey", "l_linenumber", "l_quantity", "l_discount", lambda: V.mm_text(F.col("l_quantity") * F.col("l_discount") * 10).alias("text")),
        "SELECT l_orderkey, l_linenumber, l_quantity, l_discount, CASE WHEN r = 0 THEN '0.00mm' WHEN r = floor(r) THEN CAST(CAST(floor(r) AS BIGINT) AS VARCHAR) || 'mm' ELSE printf('%.2f', r) || 'mm' END AS text FROM (SELECT *, round(l_quantity * l_discount * 10 * 100, 0) / 100 AS r FROM lineitem)",
    )
    c["colour_hex"] = (
        over("orders", key, lambda: V.colour_hex(F.col(key) * 7919).alias("hex"), lambda: V.parse_colour(V.colour_hex(F.col(key) * 7919)).alias("rgb"), lambda: V.parse_colour(F.col("o_orderstatus")).alias("none")),
        "SELECT o_orderkey, printf('#%02X%02X%02X', v & 255, (v >> 8) & 255, (v >> 16) & 255) AS hex, ((v & 255) << 16) + (((v >> 8) & 255) << 8) + ((v >> 16) & 255) AS rgb, CAST(NULL AS BIGINT) AS none FROM (SELECT o_orderkey, o_orderkey * 7919 AS v FROM orders)",
    )
    flags = dict(enumerate(V.DOCUMENT_FLAGS))
    c["document_flag_names"] = (over("orders", key, lambda: V.names_of_bits(F.col(key) * 37, flags).alias("flags")), f"SELECT o_orderkey, {sql_names('(o_orderkey * 37)', flags)} AS flags FROM orders")
    c["segment_flag_decode"] = (over("orders", key, lambda: V.names_of_bits(F.col(key) * 8191, V.SEGMENT_FLAGS).alias("flags")), f"SELECT o_orderkey, {sql_names('(o_orderkey * 8191)', V.SEGMENT_FLAGS)} AS flags FROM orders")
    c["control_mask_names"] = (over("orders", key, lambda: V.names_of_bits(F.col(key) * 262139, V.CONTROL_MARKS).alias("controls")), f"SELECT o_orderkey, {sql_names('(o_orderkey * 262139)', V.CONTROL_MARKS)} AS controls FROM orders")
    c["record_header_decode"] = (
        over("lineitem", "l_orderkey", "l_linenumber", "l_partkey", *((lambda name=name, at=at, w=w: V.field(F.col("l_orderkey") * 65537 + F.col("l_partkey"), at, w).alias(name)) for name, at, w in (("tag_id", 0, 10), ("level", 10, 10), ("size", 20, 12))), lambda: (V.field(F.col("l_orderkey") * 65537 + F.col("l_partkey"), 20, 12) == 0xFFF).alias("has_extended_size")),
        "SELECT l_orderkey, l_linenumber, l_partkey, v & 1023 AS tag_id, (v >> 10) & 1023 AS level, (v >> 20) & 4095 AS size, ((v >> 20) & 4095) = 4095 AS has_extended_size FROM (SELECT *, l_orderkey * 65537 + l_partkey AS v FROM lineitem)",
    )
    c["version_string"] = (
        over("orders", key, lambda: V.version_text(F.lit(0x05000000) + F.col(key)).alias("version")),
        "SELECT o_orderkey, concat_ws('.', (v >> 24) & 255, (v >> 16) & 255, (v >> 8) & 255, v & 255) AS version FROM (SELECT o_orderkey, 83886080 + o_orderkey AS v FROM orders)",
    )
    ts = lambda: F.col("ts").cast("timestamp")
    c["filetime_roundtrip"] = (
        over("events", "event_id", lambda: V.filetime(ts()).alias("filetime"), lambda: F.unix_seconds(V.filetime_to_timestamp(V.filetime(ts()))).alias("seconds")),
        "SELECT event_id, epoch_us(ts) * 10 + 116444736000000000 AS filetime, epoch_us(ts) // 1000000 AS seconds FROM events",
    )
    c["filetime_local_text"] = (over("events", "event_id", lambda: V.filetime_text(V.filetime(ts())).alias("text")), "SELECT event_id, strftime(date_trunc('second', ts) + INTERVAL 9 HOUR, '%Y-%m-%dT%H:%M:%S') || '+09:00' AS text FROM events")
    escape = "replace(replace(replace(replace({t}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;')"
    c["html_escape"] = (over("pages", "page_id", lambda: X.html_escape(F.col("html")).alias("text")), f"SELECT page_id, {escape.replace('{t}', 'html')} AS text FROM pages")
    c["visible_spaces"] = (
        over("documents", "doc_id", lambda: X.visible_spaces(F.concat(F.lit("  "), F.replace("text", F.lit("e"), F.lit("  ")), F.lit(" "))).alias("text")),
        "SELECT doc_id, '&nbsp;&nbsp;' || repeat('&nbsp;', length(t) - length(ltrim(t, ' '))) || regexp_replace(replace(replace(ltrim(t, ' '), '  ', ' &nbsp;'), '&nbsp; ', '&nbsp;&nbsp;'), ' $', '&nbsp;') AS text FROM (SELECT doc_id, replace(text, 'e', '  ') || ' ' AS t FROM documents)",
    )
    md = "'![i](' || url || ') see [t](' || url || ') end'"
    c["strip_md_images_links"] = (
        over("pages", "page_id", lambda: X.strip_images(md_of()).alias("no_images"), lambda: X.strip_links(md_of()).alias("no_links")),
        f"SELECT page_id, ' see [t](' || url || ') end' AS no_images, ' see  end' AS no_links FROM (SELECT *, {md} AS md FROM pages)",
    )
    command = "url || '|x;' || CAST(page_id % 5 AS VARCHAR) || ';0;'"
    c["link_command_to_url"] = (
        over("pages", "page_id", lambda: X.command_to_url(F.concat(F.col("url"), F.lit("|x;"), F.pmod("page_id", F.lit(5)).cast("string"), F.lit(";0;"))).alias("target")),
        f"SELECT page_id, CASE page_id % 5 WHEN 0 THEN '#' || url WHEN 1 THEN url WHEN 2 THEN 'mailto:' || url WHEN 3 THEN 'file://' END AS target FROM (SELECT *, {command} AS command FROM pages)",
    )
    c["url_to_onclick"] = (
        over("pages", "page_id", lambda: X.url_to_onclick(variant_url()).alias("onclick")),
        "SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'window.open(''' || url || ''', ''_newtab'')' WHEN 1 THEN 'location.href=''mailto:' || url || '''' WHEN 2 THEN 'location.href=''#''' ELSE 'location.href=''file://''' END AS onclick FROM pages",
    )
    c["media_type_lookup"] = (
        over("part", "p_partkey", lambda: X.media_type(X.extension(part_file())).alias("mime"), lambda: X.extension(part_file()).alias("extension")),
        "SELECT p_partkey, CASE e WHEN 'png' THEN 'image/png' WHEN 'gif' THEN 'image/gif' WHEN 'bmp' THEN 'image/bmp' ELSE 'image/jpeg' END AS mime, e AS extension FROM (SELECT p_partkey, list_extract(['png', 'gif', 'bmp', 'jpg', 'xyz'], CAST(p_partkey % 5 + 1 AS INTEGER)) AS e FROM part)",
    )
    c["base64_data_uri"] = (over("benchmark", "item_id", lambda: X.data_uri(F.col("text").cast("binary"), F.lit("text/plain")).alias("uri")), "SELECT item_id, 'data:text/plain;base64,' || to_base64(encode(text)) AS uri FROM benchmark")
    wide = "[\\x{1100}-\\x{11FF}\\x{3000}-\\x{303F}\\x{3040}-\\x{30FF}\\x{3130}-\\x{318F}\\x{4E00}-\\x{9FFF}\\x{AC00}-\\x{D7AF}\\x{F900}-\\x{FAFF}\\x{FF01}-\\x{FF60}]"
    c["full_width_count"] = (over("documents", "doc_id", lambda: X.full_width_count(F.concat(F.col("text"), F.lit("가나 漢字！"))).cast("long").alias("wide"), lambda: F.length("text").cast("long").alias("chars")), f"SELECT doc_id, CAST(length(t) - length(regexp_replace(t, '{wide}', '', 'g')) AS BIGINT) AS wide, CAST(length(text) AS BIGINT) AS chars FROM (SELECT *, text || '가나 漢字！' AS t FROM documents)")
    c["marker_width"] = (
        over("part", "p_partkey", lambda: X.marker_width(N.outline_format(F.pmod("p_partkey", F.lit(6)) + 1, F.col("p_partkey"))).alias("mm")),
        f"SELECT p_partkey, round(100 * ((length(t) - length(regexp_replace(t, '[0-9]', '', 'g'))) * 3.44 + (length(t) - length(regexp_replace(t, '[.]', '', 'g'))) * 1.46 + (length(t) - length(regexp_replace(t, '[()]', '', 'g'))) * 1.75 + length(regexp_replace(t, '[0-9.()]', '', 'g')) * 4.86), 0) / 100 AS mm FROM (SELECT p_partkey, {sql_outline('(p_partkey % 6 + 1)', 'p_partkey')} AS t FROM part)",
    )
    c["border_width_lookup"] = (
        over("part", "p_partkey", lambda: V.border_mm(F.pmod("p_partkey", F.lit(18))).alias("mm")),
        f"SELECT p_partkey, CASE WHEN p_partkey % 18 < 16 THEN CAST(list_extract([{', '.join(f'{x:.2f}' for x in V.BORDER_MM)}], CAST(p_partkey % 18 + 1 AS INTEGER)) AS DOUBLE) ELSE 0.12::DOUBLE END AS mm FROM part",
    )
    c["number_kind_narrowing"] = (over("part", "p_partkey", lambda: N.narrow_kind(F.pmod("p_partkey", F.lit(19))).alias("kind")), "SELECT p_partkey, CASE p_partkey % 19 WHEN 1 THEN 'circled' WHEN 2 THEN 'roman_upper' WHEN 3 THEN 'roman_lower' WHEN 4 THEN 'alpha_upper' WHEN 5 THEN 'alpha_lower' WHEN 8 THEN 'hangul' WHEN 10 THEN 'hangul_cycle' ELSE 'arabic' END AS kind FROM part")
    marks = [0xF06C, 0xF046, 0xF0A1, 0xF0AB, 0xF077, 0x2022]
    mark = lambda: F.element_at(F.array(*(F.lit(chr(m)) for m in marks)), (F.pmod("p_partkey", F.lit(len(marks))) + 1).cast("int"))
    listed = lambda table: ", ".join(f"'{table.get(m, chr(m))}'" for m in marks)
    c["bullet_marks"] = (
        over("part", "p_partkey", lambda: X.bullet_mark(mark()).alias("shown"), lambda: X.bullet_mark(mark(), True).alias("placed"), lambda: X.bullet_mark(F.lit(None).cast("string")).alias("none")),
        f"SELECT p_partkey, list_extract([{listed(X.BULLETS)}], CAST(p_partkey % 6 + 1 AS INTEGER)) AS shown, list_extract([{listed(X.PLACED_BULLETS)}], CAST(p_partkey % 6 + 1 AS INTEGER)) AS placed, '●' AS none FROM part",
    )
    caption = lambda: F.element_at(F.array(F.lit("표 12 of parts"), F.lit("표없음"), F.concat(F.lit("  "), "p_name", F.lit(" ")), F.concat(F.lit("Tab ~"), "p_name")), (F.pmod("p_partkey", F.lit(4)) + 1).cast("int"))
    parts = lambda name: (lambda: X.caption_parts(caption(), F.when(F.pmod("p_partkey", F.lit(4)) == 3, F.lit(4)), F.when(F.pmod("p_size", F.lit(2)) == 0, F.lit("IV")), F.col("p_size"))[name].alias(name))
    shown = "CASE WHEN p_size % 2 = 0 THEN 'IV' ELSE CAST(p_size AS VARCHAR) END"
    c["caption_split"] = (
        over("part", "p_partkey", parts("label"), parts("number"), parts("body")),
        f"SELECT p_partkey, CASE p_partkey % 4 WHEN 2 THEN '' WHEN 3 THEN 'Tab' ELSE '표' END AS label, CASE p_partkey % 4 WHEN 0 THEN '12' WHEN 1 THEN CAST(p_size AS VARCHAR) ELSE {shown} END AS number, CASE p_partkey % 4 WHEN 0 THEN 'of parts' WHEN 1 THEN '표없음' ELSE trim(p_name) END AS body FROM part",
    )
    piece = lambda at: F.element_at(F.array(*map(F.lit, ("text", "![i](u)", "| a |", "---", "\nx"))), (F.pmod(F.expr(at), F.lit(5)) + 1).cast("int"))
    c["block_separators"] = (
        over("part", "p_partkey", lambda: X.separator(piece("p_partkey"), piece("p_partkey div 5")).alias("sep"), lambda: X.is_block(piece("p_partkey")).alias("block")),
        "SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 AND (p_partkey // 5) % 5 = 0 THEN '  ' || chr(10) ELSE chr(10) || chr(10) END AS sep, p_partkey % 5 IN (1, 2, 3) AS block FROM part",
    )
    before = lambda: F.when(F.pmod("page_id", F.lit(2)) == 0, F.lit("wor")).otherwise(F.lit("word "))
    label = lambda: F.element_at(F.array(F.lit("d"), F.lit("(d"), F.lit("")), (F.pmod("page_id", F.lit(3)) + 1).cast("int"))
    c["link_in_word"] = (
        over("pages", "page_id", lambda: X.link_markdown(before(), label(), F.col("url")).alias("link")),
        "SELECT page_id, CASE WHEN page_id % 3 = 2 THEN '[' || url || '](' || url || ')' WHEN page_id % 2 = 0 AND page_id % 3 = 0 THEN 'd' ELSE '[' || CASE page_id % 3 WHEN 0 THEN 'd' ELSE '(d' END || '](' || url || ')' END AS link FROM pages",
    )
    c["image_urls"] = (
        over("benchmark", "item_id", lambda: X.image_url(F.col("text").cast("binary"), F.lit("image/png"), F.lit("a.png"), "img/").alias("named"), lambda: X.image_url(F.encode("text", "UTF-8"), F.lit("image/png"), F.lit("a.png")).alias("embedded"), lambda: X.image_url(F.lit(None).cast("binary"), F.lit("image/png"), F.lit("a.png")).alias("none")),
        "SELECT item_id, 'img/a.png' AS named, 'data:image/png;base64,' || to_base64(encode(text)) AS embedded, '' AS none FROM benchmark",
    )
    c["font_names"] = (over("part", "p_partkey", lambda: X.font_escape(F.concat(F.lit("\\it's "), "p_name")).alias("font"), lambda: X.attribute_escape(F.concat("p_name", F.lit('"<&>'))).alias("title")), "SELECT p_partkey, '\\\\it\\''s ' || p_name AS font, p_name || '&quot;&lt;&amp;&gt;' AS title FROM part")
    c["border_width_text"] = (over("part", "p_partkey", lambda: V.border_mm_text(F.pmod("p_partkey", F.lit(18))).alias("mm")), f"SELECT p_partkey, CASE WHEN p_partkey % 18 < 16 THEN list_extract([{', '.join(repr(f'{x}mm') for x in V.BORDER_MM)}], CAST(p_partkey % 18 + 1 AS INTEGER)) ELSE '0.1mm' END AS mm FROM part")
    names = lambda x, flags: F.split(V.names_of_bits(x, flags), ",")
    c["flags_there_and_back"] = (
        over("part", "p_partkey", lambda: V.bits_of_names(names(F.col("p_partkey"), V.SEGMENT_FLAGS), V.SEGMENT_FLAGS).alias("segment"), lambda: V.names_of_bits(F.col("p_partkey"), dict(enumerate(V.LICENSE_FLAGS))).alias("licence"), lambda: V.names_of_bits(F.col("p_size"), V.DIVIDE_FLAGS).alias("divide")),
        f"SELECT p_partkey, CAST(p_partkey & {sum(1 << b for b in V.SEGMENT_FLAGS)} AS BIGINT) AS segment, {sql_names('p_partkey', dict(enumerate(V.LICENSE_FLAGS)))} AS licence, {sql_names('p_size', V.DIVIDE_FLAGS)} AS divide FROM part",
    )
    c["seven_languages"] = (
        over("part", "p_partkey", lambda: V.seven(F.array(F.col("p_size"), F.col("p_size") + 1))["korean"].cast("long").alias("first"), lambda: V.seven(F.array(F.col("p_size"), F.col("p_size") + 1))["user"].cast("long").alias("last"), lambda: V.all_seven(F.array_repeat("p_size", 7), lambda x: x > 25).alias("large")),
        "SELECT p_partkey, CAST(p_size AS BIGINT) AS first, CAST(p_size + 1 AS BIGINT) AS last, p_size > 25 AS large FROM part",
    )
    c["marker_width_by_size"] = (
        over("part", "p_partkey", lambda: X.marker_width(F.lit("●1."), F.col("p_size") + 1.0).alias("mm")),
        "SELECT p_partkey, round(100 * (5.29 * (p_size + 1.0) / 10.0 + 3.44 + 1.46), 0) / 100 AS mm FROM part",
    )
    return c


def md_of() -> Column:
    return F.concat(F.lit("![i]("), F.col("url"), F.lit(") see [t]("), F.col("url"), F.lit(") end"))


def variant_url() -> Column:
    k = F.pmod("page_id", F.lit(4))
    return F.when(k == 0, F.col("url")).when(k == 1, F.concat(F.lit("mailto:"), F.col("url"))).when(k == 2, F.concat(F.lit("#"), F.col("url"))).otherwise(F.concat(F.lit("/"), F.col("url")))


def part_file() -> Column:
    return F.concat(F.lit("a.b."), F.element_at(F.array(*map(F.lit, ("PNG", "gif", "bmp", "jpg", "xyz"))), (F.pmod("p_partkey", F.lit(5)) + 1).cast("int")))
