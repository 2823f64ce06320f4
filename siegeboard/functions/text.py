"""Text expressions: map names, links and display formats."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: version suffix of a map name.
MAP_VERSION_PATTERN = r"(?i)[_\s]+[v\d\.]+\w*$"


def normalize_map_name(name: Column) -> Column:
    return F.regexp_replace(name, MAP_VERSION_PATTERN, "")


def hyperlink(ids: Column, base: str) -> Column:
    """Spreadsheet link to the first id that shows all ids; blank for an empty list."""
    first = F.try_element_at(ids, F.lit(1))
    text = F.concat(F.lit(f'=hyperlink("{base}'), first, F.lit('";"'), F.array_join(ids, ", "), F.lit('")'))
    return F.coalesce(text, F.lit(" "))


def fixed(value: Column, digits: int) -> Column:
    """Number with exactly ``digits`` decimals."""
    return F.round(value.cast("double"), digits).cast(f"decimal(38,{digits})").cast("string")


def drop_zero_decimals(text: Column) -> Column:
    return F.regexp_replace(text, r"\.0+$", "")


def percent(value: Column, digits: int = 0) -> Column:
    return F.concat(fixed(F.coalesce(value.cast("double"), F.lit(0.0)) * 100, digits), F.lit("%"))


def one_decimal(value: Column) -> Column:
    """At least four characters; longer numbers stay whole."""
    text = drop_zero_decimals(fixed(value, 1))
    return F.concat(text, F.repeat(F.lit(" "), F.greatest(F.lit(0), 4 - F.length(text))))


def blank_zero(value: Column) -> Column:
    """A number as text, zero of any number type as blank."""
    return F.when(value == 0, F.lit("")).otherwise(value.cast("string"))


def blank_zero_text(value: Column) -> Column:
    return F.when(value == "0", F.lit("")).otherwise(value)


def lobby_number(text: Column) -> Column:
    """Trim trailing zero decimals and blank a lone zero."""
    return F.regexp_replace(drop_zero_decimals(text), r"^0$", "")
