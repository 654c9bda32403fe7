"""Note templates compiled to one column expression.

A template is parsed once on the driver. Each ``${name}`` becomes an expression over
the column of that name and the whole note one ``concat``, so rendering a row is a
projection inside generated code.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

ColumnFn = Callable[[Column], Column]

# Fixed value: how dates are written in notes.
DATE_FORMAT = "MMMM d, yyyy"

_PLACEHOLDER = re.compile(r"\$(?:(\$)|\{([^{}]+)\}|([A-Za-z_][A-Za-z0-9_]*))")


@dataclass(frozen=True)
class NoteTemplate:
    """Text with ``${column}`` placeholders and rules for each field.

    ``pre`` runs on the raw value; NULL, NaN and '' then count as absent. A present
    value gets ``prefixes``/``suffixes`` and goes through ``post``. An absent one
    is replaced by ``defaults`` or by nothing. ``fns`` run on the whole text.
    """

    text: str
    prefixes: Mapping[str, str] = field(default_factory=dict)
    suffixes: Mapping[str, str] = field(default_factory=dict)
    defaults: Mapping[str, str] = field(default_factory=dict)
    pre: Mapping[str, ColumnFn] = field(default_factory=dict)
    post: Mapping[str, ColumnFn] = field(default_factory=dict)
    fns: Sequence[ColumnFn] = ()

    def parts(self) -> list[tuple[str, str]]:
        """The template as ('text', literal) and ('field', name) parts."""
        found: list[tuple[str, str]] = []
        at = 0
        for match in _PLACEHOLDER.finditer(self.text):
            found.append(("text", self.text[at : match.start()]))
            if match.group(1):
                found.append(("text", "$"))
            else:
                found.append(("field", match.group(2) or match.group(3)))
            at = match.end()
        found.append(("text", self.text[at:]))
        return [p for p in found if p[0] == "field" or p[1]]

    def fields(self) -> list[str]:
        return list(dict.fromkeys(name for kind, name in self.parts() if kind == "field"))

    def render(self, df: DataFrame) -> Column:
        """The note as a column over ``df``. Placeholders without a column are absent."""
        known = set(df.columns)
        raw = {
            name: self.pre.get(name, _same)(F.col(f"`{name}`"))
            for name in self.fields()
            if name in known
        }
        types = df.select(*[c.alias(n) for n, c in raw.items()]).schema if raw else T.StructType()
        shown = {
            name: self._shown(name, raw[name], types[name].dataType) if name in raw
            else F.lit(self.defaults.get(name, ""))
            for name in self.fields()
        }
        pieces = [
            F.lit(value) if kind == "text" else shown[value] for kind, value in self.parts()
        ]
        note = F.concat(*pieces) if pieces else F.lit("")
        for fn in self.fns:
            note = fn(note)
        return note

    def _shown(self, name: str, value: Column, data_type: T.DataType) -> Column:
        text = as_text(name, value, data_type)
        before, after = self.prefixes.get(name, ""), self.suffixes.get(name, "")
        if before or after:
            text = F.concat(F.lit(before), text, F.lit(after))
        if name in self.post:
            text = self.post[name](text)
        return F.coalesce(text, F.lit(self.defaults.get(name, "")))


def _same(value: Column) -> Column:
    return value


def as_text(name: str, value: Column, data_type: T.DataType) -> Column:
    """A present value as text, an absent one as NULL."""
    if isinstance(data_type, (T.StringType, T.CharType, T.VarcharType)):
        return F.nullif(value, F.lit(""))
    if isinstance(data_type, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return F.date_format(value, DATE_FORMAT)
    if isinstance(data_type, T.DayTimeIntervalType):
        return F.extract(F.lit("DAY"), value).cast("string")
    if isinstance(data_type, T.BooleanType):
        return F.when(value, F.lit("True")).when(~value, F.lit("False"))
    if isinstance(data_type, (T.DoubleType, T.FloatType)):
        raise ValueError(
            f"field {name!r} is a floating-point number without a format; "
            "give it one, for example pre={name: fixed_text(2)}"
        )
    if isinstance(data_type, T.NullType):
        return F.lit(None).cast("string")
    return value.cast("string")


def list_template(features: Sequence[tuple[str, str]]) -> str:
    """One '- name: value' line per (column, display name)."""
    return "\n".join(f"- {shown}: ${{{column}}}" for column, shown in features)


def sentence_template(features: Sequence[tuple[str, str]]) -> str:
    """One sentence per (column, display name)."""
    return " ".join(f"The {shown} is ${{{column}}}." for column, shown in features)


def values_template(features: Sequence[tuple[str, str]]) -> str:
    """The bare value of each feature on its own line."""
    return "\n".join(f"${{{column}}}" for column, _ in features)


def permute_features(
    features: Sequence[tuple[str, str]], permutation: Sequence[int]
) -> list[tuple[str, str]]:
    """Keep the names in place and take the value of feature number permutation[i]."""
    if sorted(permutation) != list(range(1, len(features) + 1)):
        raise ValueError("not a permutation of the feature numbers 1..n")
    return [
        (features[source - 1][0], shown)
        for source, (_, shown) in zip(permutation, features)
    ]
