"""The library's expressions as SQL functions of a session: register(spark), then SELECT inkstone_html_escape(text) ...

Each is a SQL function whose body is the expression itself, so it is inlined into the plan and costs what the expression costs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from inkstone.functions import numbering as N
from inkstone.functions import text as X
from inkstone.functions import values as V

#: name: (types of the arguments, expression).
FUNCTIONS: dict[str, tuple[tuple[str, ...], Callable[..., Column]]] = {
    "html_escape": (("string",), X.html_escape), "visible_spaces": (("string",), X.visible_spaces), "strip_images": (("string",), X.strip_images), "strip_links": (("string",), X.strip_links), "plain_cell": (("string",), X.plain_cell),
    "command_to_url": (("string",), X.command_to_url), "url_to_onclick": (("string",), X.url_to_onclick), "extension": (("string",), X.extension), "media_type": (("string",), X.media_type), "detect_format": (("binary",), X.detect_format), "full_width_count": (("string",), X.full_width_count),
    "marker_width": (("string",), X.marker_width), "control_class": (("bigint",), X.control_class), "control_units": (("bigint",), X.control_units), "bullet_mark": (("string",), X.bullet_mark), "data_uri": (("binary", "string"), X.data_uri),
    "roman": (("bigint",), N.roman_upper), "alpha": (("bigint",), N.alpha_bijective), "number_by_shape": (("bigint", "bigint"), N.by_shape), "outline_number": (("bigint", "bigint"), N.outline_format),
    "colour_hex": (("bigint",), V.colour_hex), "parse_colour": (("string",), V.parse_colour), "mm_text": (("double",), V.mm_text), "unit_to_mm": (("double",), V.unit_to_mm), "version_text": (("bigint",), V.version_text), "filetime_text": (("bigint",), V.filetime_text), "border_mm": (("bigint",), V.border_mm),
}


def register(spark: SparkSession, prefix: str = "inkstone_") -> list[str]:
    """Make the functions known to the session; returns their names."""
    out = []
    for name, (types, make) in FUNCTIONS.items():
        given = [f"a{k}" for k in range(len(types))]
        empty = spark.range(0).select(*(F.lit(None).cast(t).alias(a) for a, t in zip(given, types, strict=True)))
        made = empty.select(make(*map(F.col, given)).alias("made"))
        body = made._jdf.queryExecution().analyzed().expressions().head().child().sql()
        result = dict(made.dtypes)["made"]
        arguments = ", ".join(f"{a} {t.upper()}" for a, t in zip(given, types, strict=True))
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {prefix}{name}({arguments}) RETURNS {result} RETURN {body}")
        out.append(prefix + name)
    return out
