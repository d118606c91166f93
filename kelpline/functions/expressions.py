"""Column expressions: predicates, text cleaning, hashes, keys and quality flags.  All stay in the JVM."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

VALID, WARNING, ERROR = "valid", "warning", "error"


def all_true(conditions: Iterable[Column]) -> Column:
    return reduce(Column.__and__, conditions, F.lit(True))


def any_true(conditions: Iterable[Column]) -> Column:
    return reduce(Column.__or__, conditions, F.lit(False))


def all_present(names: Iterable[str]) -> Column:
    """True where none of the columns is null."""
    return all_true(F.col(n).isNotNull() for n in names)


def in_slice(names: Iterable[str], i: int, n: int) -> Column:
    """True in one of ``n`` slices, which a hash of the columns chooses; nulls hash like values, so each row is in one slice."""
    return F.lit(True) if n == 1 else F.pmod(F.xxhash64(*names), F.lit(n)) == i


def clean_text(name: str, case: str) -> Column:
    """Trimmed (blanks only), in ``upper`` or ``lower`` case; empty text becomes null."""
    change = {"upper": F.upper, "lower": F.lower}[case]
    return change(F.nullif(F.trim(F.col(name)), F.lit("")))


def record_hash(names: Iterable[str]) -> Column:
    """SHA-256 of the payload as JSON in contract order.  Nulls are left out of JSON; timestamps follow the session's time zone."""
    return F.sha2(F.to_json(F.struct(*names)), 256)


def business_key(names: Iterable[str]) -> Column:
    """Key columns joined by ``|``, nulls spelled out."""
    return F.concat_ws("|", *(F.coalesce(F.col(n).cast("string"), F.lit("null")) for n in names))


def flags(conditions: Mapping[str, Column]) -> Column:
    """Sorted names of the conditions that hold; a null condition doesn't.  Stays in generated code: no function over elements."""
    return F.array_remove(F.array(*(F.when(conditions[n], F.lit(n)).otherwise(F.lit("")) for n in sorted(conditions))), "") if conditions else no_flags()


def no_flags() -> Column:
    return F.expr("cast(array() as array<string>)")


def inherit(own: Column, sources: Mapping[str, Column]) -> Column:
    """A row's own flags and those of its sources as ``source:flag``, each once, sorted; an absent source has none."""

    def of_source(name: str) -> Callable[[Column], Column]:
        return lambda flag: F.concat(F.lit(f"{name}:"), flag)

    for name, theirs in sources.items():
        own = F.array_union(own, F.coalesce(F.transform(theirs, of_source(name)), no_flags()))
    return F.sort_array(own)


def status(error: Column, warning: Column) -> Column:
    """``error`` where the first holds, else ``warning`` where the second does, else ``valid``."""
    return F.when(error, ERROR).when(warning, WARNING).otherwise(VALID)
