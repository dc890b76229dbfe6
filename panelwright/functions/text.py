"""String column helpers and the ordered address rules."""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from panelwright.functions.scalars import as_column, map_values

# Punctuation that address normalisation removes; '#' and '/' carry meaning and stay.
_PUNCTUATION = r"""[!"$%&'()*+,\-.:;<=>?@\[\\\]^_`{|}~]"""


def join_text(*parts, sep=" ", null_as=None) -> Column:
    """Concatenate; any NULL part makes the result NULL.

    ``null_as="NA"`` prints missing parts as that text instead.
    """
    columns = [as_column(p).cast("string") for p in parts]
    if null_as is not None:
        return F.concat_ws(sep, *[F.coalesce(c, F.lit(null_as)) for c in columns])
    spaced = [columns[0]]
    for c in columns[1:]:
        spaced += [F.lit(sep), c]
    return F.concat(*spaced)


def area_id(county, tract, state="36") -> Column:
    """Full area id from county and tract codes; NULL if either is missing."""
    return F.concat(F.lit(state), as_column(county), as_column(tract))


def first_chars(value, n: int, start=1) -> Column:
    return F.substring(as_column(value), start, n)


def last_chars(value, n: int) -> Column:
    return F.right(as_column(value), F.lit(n))


def strip_prefix_for(value, prefix: str, condition: Column) -> Column:
    """Remove one leading ``prefix`` on the rows where ``condition`` holds."""
    value = as_column(value)
    stripped = F.regexp_replace(value, "^" + re.escape(prefix), "")
    return F.when(condition, stripped).otherwise(value)


def has_prefix(value, prefixes: Iterable[str]) -> Column:
    """One anchored character class instead of a chain of prefix tests."""
    choices = "|".join(re.escape(p) for p in prefixes)
    return as_column(value).rlike(f"^(?:{choices})")


def apply_rules(value, rules: Iterable[tuple[str, str]]) -> Column:
    """Fold an ordered list of (pattern, replacement) rules over a text column.

    Patterns without regular-expression syntax become plain substring
    replacement, which skips the regex engine.
    """
    out = as_column(value)
    for pattern, replacement in rules:
        if re.fullmatch(r"[A-Z0-9 ]+", pattern):
            out = F.replace(out, F.lit(pattern), F.lit(replacement))
        else:
            out = F.regexp_replace(out, pattern, replacement)
    return out


def normal_address(value) -> Column:
    """Upper case, punctuation removed, blanks squeezed; '' and 'NA' become NULL."""
    bare = F.regexp_replace(F.upper(as_column(value)), _PUNCTUATION, "")
    squeezed = F.trim(F.regexp_replace(bare, r"\s+", " "))
    return F.nullif(F.nullif(squeezed, F.lit("")), F.lit("NA"))


def label(value, labels: Mapping) -> Column:
    """Value-to-label lookup that keeps unlabelled values as text."""
    value = as_column(value)
    return map_values(value, labels, default=value.cast("string"))
