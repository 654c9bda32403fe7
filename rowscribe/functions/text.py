"""Text functions: note cleaning, field formats and value phrases."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The cleaning steps of a note, in order. WS is every character that
# counts as white space in Unicode text. END stands for "at the end, or before a
# final line break".
WS = (
    r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}"
    r"\x{205f}\x{3000}]"
)
END = r"(\n?)\z"
CLEANING_STEPS: tuple[tuple[str, str], ...] = (
    (r"[ \t]+", " "),
    (r"\n\n\n+", "\n\n"),
    (r"\A[ \t]+", ""),
    (r"\n[ \t]+", "\n"),
    (r"[ \t]" + END, "$1"),
    (r"[ \t]\n", "\n"),
    (WS + r"*\." + END, ".$1"),
    (WS + r"*\.\n", ".\n"),
    (r"\.+" + END, ".$1"),
    (r"\.+\n", ".\n"),
    (WS + r"*\." + END, ".$1"),
    (WS + r"*\.\n", ".\n"),
    (r"[ \t]+", " "),
    (r"\n\n\n+", "\n\n"),
)
# A run of blanks and dots that ends in a dot and is followed by a space becomes
# one ". ". Notes that contain "... " keep their dots.
DOT_RUN = "[" + WS[1:-1] + r".]*\. +"
KEPT_ELLIPSIS = "... "


def strip(text: Column) -> Column:
    """Remove white space of any kind from both ends."""
    return F.regexp_replace(text, r"\A" + WS + "+|" + WS + r"+\z", "")


# White space beyond \s. Written as "none of the others" with the usual letters first, so
# that a scan of ordinary text decides each character at once.
RARE_WS = (
    r"[^!-\x{84}\x00-\x1b\x20\x{a1}-\x{167f}\x{86}-\x{9f}\x{1681}-\x{1fff}\x{200b}-\x{2027}"
    r"\x{202a}-\x{202e}\x{2030}-\x{205e}\x{2060}-\x{2fff}\x{3001}-\x{10ffff}]"
)


def has_rare_space(text: Column) -> Column:
    """Whether a text holds white space that the short class \\s does not cover."""
    is_ascii = F.octet_length(text) == F.length(text)
    return F.when(is_ascii, text.rlike(r"[\x1c-\x1f]")).otherwise(text.rlike(RARE_WS))


def _cleaning_steps(text: Column, space: str) -> Column:
    for pattern, replacement in CLEANING_STEPS:
        text = F.regexp_replace(text, pattern.replace(WS, space), replacement)
    return text


def _close_dot_runs(text: Column, space: str) -> Column:
    pattern = DOT_RUN if space == WS else r"[\s.]*\. +"
    return F.when(F.contains(text, F.lit(KEPT_ELLIPSIS)), text).otherwise(
        F.regexp_replace(text, pattern, ". ")
    )


def clean_notes(df: DataFrame, raw: Column, out: str) -> DataFrame:
    """Add a column with the cleaned text: blanks, line breaks and dots normalised.

    The text, the choice of the short white-space class and the result of the steps
    are separate projections, because each is used more than once.
    """
    rare = F.col("_rare")
    return (
        df.withColumn("_raw", raw)
        .withColumn("_rare", has_rare_space(F.col("_raw")))
        .withColumn(
            "_steps",
            F.when(rare, _cleaning_steps(F.col("_raw"), WS)).otherwise(
                _cleaning_steps(F.col("_raw"), r"\s")
            ),
        )
        .withColumn(
            out,
            F.when(rare, _close_dot_runs(F.col("_steps"), WS)).otherwise(
                _close_dot_runs(F.col("_steps"), r"\s")
            ),
        )
        .drop("_raw", "_rare", "_steps")
    )


def clean_note(text: Column, space: str = WS) -> Column:
    """The cleaned text as one expression; for many rows prefer ``clean_notes``. ``space``
    may be the short class \\s where a text holds no rare blanks."""
    return _close_dot_runs(_cleaning_steps(text, space), space)


def integer_text(value: Column) -> Column:
    """A number cut to its integer part, as text."""
    return value.cast("bigint").cast("string")


def fixed_text(digits: int) -> Callable[[Column], Column]:
    """Formatter for a number with a fixed count of decimals.

    The double itself is rounded, half to even: 2.675, stored a little below, gives 2.67.
    Decimals past the 17th significant digit are zeros.
    """
    pattern = "0." + "0" * digits if digits else "0"

    def to_text(value: Column) -> Column:
        number = value.cast("double")
        odd = F.when(F.isnan(number), "nan").when(number == float("inf"), "inf").when(number == float("-inf"), "-inf")
        return F.coalesce(odd, F.call_function("format_number", number, F.lit(pattern)))

    return to_text


def phrases(
    mapping: Mapping[str, str], on_missing: str = "error"
) -> Callable[[Column], Column]:
    """Formatter that looks a code up.

    ``on_missing`` is "error" (an unknown code fails the query), "null" (it is
    treated as absent) or "keep" (it is printed as it is).
    """
    if on_missing not in ("error", "null", "keep"):
        raise ValueError(f"on_missing must be error, null or keep, not {on_missing!r}")

    def to_text(value: Column) -> Column:
        code = value.cast("string")
        chain = F
        for key, phrase in mapping.items():
            chain = chain.when(code == F.lit(key), F.lit(phrase))
        if on_missing == "null":
            return chain
        if on_missing == "keep":
            return chain.otherwise(code)
        return chain.when(code.isNull(), F.lit(None)).otherwise(
            F.raise_error(F.concat(F.lit("no phrase for code "), code))
        )

    return to_text


def two_way(code, yes: str, no: str) -> Callable[[Column], Column]:
    """``yes`` for one code, ``no`` for every other present value."""

    def to_text(value: Column) -> Column:
        return F.when(value == F.lit(code), F.lit(yes)).when(value.isNotNull(), F.lit(no))

    return to_text


def sentinel(code, phrase: str, otherwise: Callable[[Column], Column]) -> Callable[[Column], Column]:
    """A phrase for one special value, a formatter for the rest."""

    def to_text(value: Column) -> Column:
        return F.when(value == F.lit(code), F.lit(phrase)).otherwise(otherwise(value))

    return to_text


def absent_if(*codes: str) -> Callable[[Column], Column]:
    """Treat some codes, compared without case, as absent."""
    lowered = [c.lower() for c in codes]

    def to_text(value: Column) -> Column:
        return F.when(~F.lower(value).isin(lowered), value)

    return to_text


def lower_first_if_second_low(text: Column) -> Column:
    """Lower-case the first letter unless the second is a capital."""
    return F.when(
        (F.length(text) < 2) | F.substring(text, 2, 1).rlike(r"^\p{Lu}$"), text
    ).otherwise(F.concat(F.lower(F.substring(text, 1, 1)), F.substring(text, 2, 2147483647)))


def short_name(text: Column) -> Column:
    """Normalise a short concept name: no trailing mark, lower first letter, and
    long names in capitals become lower case."""
    name = F.regexp_replace(strip(text), r"[^\p{L}\p{N}]\z", "")
    name = lower_first_if_second_low(name)
    shouting = (F.length(name) > 4) & (name == F.upper(name)) & (name != F.lower(name))
    return F.when(shouting, F.lower(name)).otherwise(name)


def replace_all(pairs: Sequence[tuple[str, str]]) -> list[Callable[[Column], Column]]:
    """Whole-text functions for literal replacements, in order."""
    return [
        (lambda text, old=old, new=new: F.replace(text, F.lit(old), F.lit(new)))
        for old, new in pairs
    ]


def task_name(dataset: Column, subset: Column, template: Column) -> Column:
    """dataset[_subset]_template with every run of other characters as one '_'."""
    joined = F.concat(
        dataset,
        F.when(subset.isNull(), F.lit("_")).otherwise(F.concat(F.lit("_"), subset, F.lit("_"))),
        template,
    )
    return F.regexp_replace(joined, r"[^\p{L}\p{N}_.]+", "_")


def token_count(text: Column, space: str = WS) -> Column:
    """Token estimate: the number of blank-separated words."""
    return F.size(F.array_remove(F.split(text, space + "+"), ""))


def token_cut(text: Column, longest: int) -> Column:
    """The first ``longest`` words of a text."""
    words = F.array_remove(F.split(text, WS + "+"), "")
    return F.array_join(F.slice(words, 1, longest), " ")
