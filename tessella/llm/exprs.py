"""Column expressions shared by the operators that stay in the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once, however often the body uses it.

    A projection below would not do: the optimizer may merge it into a lambda, which then
    computes it for each element.
    """
    return F.transform(F.array(value), body)[0]


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case, all else as it is."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def words_between(text: Column, separators: str) -> Column:
    """The runs between separators (a regular expression of one or more); null has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), separators), "")


def literal_array(values: list, element: str) -> Column:
    """A bounded list as a constant array, which the optimizer folds to one literal."""
    return F.split(F.lit(",".join(map(repr, values))), ",").cast(f"array<{element}>")


#: White space of the rules, SimHash and the classifiers: space and the five controls from tab on.
BLANKS = "[\\x20\\x09-\\x0D]+"


def fresh(columns: list[str], *names: str) -> list[str]:
    """The names, each lengthened until no column has it, whatever its case."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def col(name: str) -> Column:
    """The column of exactly that name, dots and back quotes in it included."""
    return F.col("`" + name.replace("`", "``") + "`")


def refuse(keys: tuple[str, ...], *made: str) -> None:
    """Key columns must not have the names of the columns that are made."""
    clash = {k.lower() for k in keys} & set(made)
    if clash:
        raise ValueError(f"a key column is named as a column of the result: {sorted(clash)}")
