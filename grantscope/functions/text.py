"""Line and path expressions, all of built-in functions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: One token of source text: a string that ends at its quote or line end, a comment, or what lies between.
TOKENS = (
    r'"(?:[^"\\\n]++|\\.)*+\\?"?'
    r"|'(?:[^'\\\n]++|\\.)*+\\?'?"
    r"|//[^\n]*+|/\*[\s\S]*?(?:\*/|\z)|[^\"'/]++|/"
)
INT, BLANK = r"^[+-]?[0-9]+$", r"^\s+|\s+$"


def relative_path(path: Column, root: Column | str) -> Column:
    """The path below ``root``, with ``/`` and none in front."""
    root = F.lit(root) if isinstance(root, str) else root
    below = F.when(F.startswith(path, root), F.substring(path, F.length(root) + 1, F.length(path))).otherwise(path)
    return F.regexp_replace(F.replace(below, F.lit("\\"), F.lit("/")), "^/+", "")


def _or_root(name: Column) -> Column:
    return F.when(name == "", "root").otherwise(name)


def module_of(path: Column) -> Column:
    """What stands before the first ``/src/``, else the first part of the path, else ``root``."""
    return F.when(F.instr(path, "/src/") > 1, F.substring_index(path, "/src/", 1)).otherwise(_or_root(F.substring_index(path, "/", 1)))


def manifest_module(path: Column) -> Column:
    """As :func:`module_of`, but a ``/src/`` at the very start gives ``root``."""
    return _or_root(F.when(F.instr(path, "/src/") > 0, F.substring_index(path, "/src/", 1)).otherwise(F.substring_index(path, "/", 1)))


def is_test(path: Column) -> Column:
    return F.contains(path, F.lit("/test/")) | F.contains(path, F.lit("/androidTest/")) | F.endswith(path, F.lit("Test.kt")) | F.endswith(path, F.lit("Test.java"))


def language_of(path: Column) -> Column:
    return F.when(F.endswith(F.lower(path), F.lit(".kt")), "Kotlin").when(F.endswith(F.lower(path), F.lit(".dart")), "Dart").otherwise("Java")


def lines_of(text: Column) -> Column:
    """Lines by any line end; an empty last one is dropped, so an empty text has none."""
    parts = F.split(text, "\r\n|\n|\r")
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def strip_comments(text: Column) -> Column:
    """Text with ``//`` and ``/* */`` comments removed and every line end kept.

    Strings are kept, with their escapes, and end at the latest at the line end; block
    comments go on over lines and do not nest.  A text without the two ways to begin one is not taken apart.
    """
    tokens = F.regexp_extract_all(text, F.lit(TOKENS), F.lit(0))
    code = F.transform(
        tokens,
        lambda t: F.when(F.startswith(t, F.lit("//")), "").when(F.startswith(t, F.lit("/*")), F.regexp_replace(t, r"[^\n]", "")).otherwise(t),
    )
    return F.when(F.contains(text, F.lit("//")) | F.contains(text, F.lit("/*")), F.array_join(code, "")).otherwise(text)


def strip(text: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(text, BLANK, "")


def snippet(raw: Column, width: int = 220) -> Column:
    return F.coalesce(F.left(strip(raw), F.lit(width)), F.lit(""))


def short_name(name: Column) -> Column:
    return F.substring_index(name, ".", -1)


def line_at(before: Column) -> Column:
    """The line number at which the text after ``before`` begins."""
    return F.length(before) - F.length(F.replace(before, F.lit("\n"), F.lit(""))) + 1


def strict_int(text: Column) -> Column:
    """A whole number with an optional sign and nothing else, else null."""
    return F.when(text.rlike(INT), text.try_cast("int"))


def strict_bool(text: Column) -> Column:
    """``true`` or ``false`` exactly, else null."""
    return F.when(text == "true", F.lit(True)).when(text == "false", F.lit(False))


def holds_any(text: Column, hints: Sequence[str]) -> Column:
    """Whether the text holds one of the hints, in any case."""
    low = F.lower(text)
    found = F.lit(False)
    for hint in hints:
        found = found | F.contains(low, F.lit(hint.lower()))
    return found


def first_match(lines: Column, pattern: str, word: str = "") -> Column:
    """Group 1 of the first line that matches, else the empty text; ``word`` stands in every line that can match."""
    return F.coalesce(F.try_element_at(all_matches(lines, pattern, word), F.lit(1)), F.lit(""))


def all_matches(lines: Column, pattern: str, word: str = "") -> Column:
    """Group 1 of every line that matches, in order; ``word`` stands in every line that can match, so others are not tried."""
    some = F.filter(lines, lambda x: F.contains(x, F.lit(word))) if word else lines
    return F.filter(F.transform(some, lambda x: F.regexp_extract(x, pattern, 1)), lambda x: x != "")


def around(df: DataFrame, keys: Sequence[str], order: str, text: str, reach: int = 4, name: str = "window") -> DataFrame:
    """Adds the texts of the rows up to ``reach`` before and after, joined by spaces."""
    frame = Window.partitionBy(*keys).orderBy(order).rowsBetween(-reach, reach)
    return df.withColumn(name, F.concat_ws(" ", F.collect_list(text).over(frame)))


def request_fields(body: Column) -> tuple[Column, Column, Column]:
    """Path, whether tests count, and what is wrong, of a request's body of JSON text; unknown keys are ignored.

    Nothing is cast: a path must be a string with more than white space, and only ``true`` asks for tests.
    A null body, and one that repeats a key, are no JSON.
    """
    # text after a whole value passes for JSON unless something has to follow it: as an item and as a member it has to end alike
    item, member = F.try_parse_json(F.concat(F.lit("["), body, F.lit("]"))), F.try_parse_json(F.concat(F.lit('{"body":'), body, F.lit("}")))
    asked = F.when(member.isNotNull() & F.try_variant_get(item, "$[1]", "variant").isNull(), F.try_variant_get(item, "$[0]", "variant"))
    field = lambda name, kind: F.when(F.schema_of_variant(F.try_variant_get(asked, f"$.{name}", "variant")) == kind.upper(), F.try_variant_get(asked, f"$.{name}", kind))
    path = field("path", "string")
    given = F.coalesce(F.rlike(path, F.lit(r"(?U)\S")), F.lit(False))
    error = (
        F.when(asked.isNull(), "The body is not JSON")
        .when(~F.startswith(F.schema_of_variant(asked), F.lit("OBJECT")), "The body is not a JSON object")
        .when(~given, "No project path was given")
    )
    tests = F.coalesce(field("includeTests", "boolean"), F.lit(False)) & error.isNull()
    return F.when(error.isNull(), path).otherwise(""), tests, error
