"""String functions as column expressions. Python runs only where Spark has no expression: Unicode forms and escapes, and
there only on the rows that need them."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
MISSING = "Not Found"


def collapse(c: Column) -> Column:
    """White space to single blanks, trimmed."""
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def unicode_form(c: Column, form: str = "NFKD") -> Column:
    """A Unicode normal form. ASCII rows stay in the JVM."""

    @F.pandas_udf("string")
    def normal(s: pd.Series) -> pd.Series:
        return s.map(lambda x: unicodedata.normalize(form, x), na_action="ignore")

    return F.when(c.rlike(r"[^\x00-\x7F]"), normal(c)).otherwise(c)


def lenient(c: Column) -> Column:
    """NFKC, lower case, white space collapsed."""
    return collapse(F.lower(unicode_form(c, "NFKC")))


def lenient_ascii(c: Column) -> Column:
    """``lenient`` for text known to be ASCII; no Python."""
    return collapse(F.lower(c))


def without_space(c: Column) -> Column:
    return F.regexp_replace(c, r"\s+", "")


def without_punctuation(c: Column) -> Column:
    return F.translate(c, PUNCTUATION, "")


def ascii_words(c: Column) -> Column:
    return F.regexp_replace(c, "[^A-Za-z0-9 ]", "")


def plain_dashes(c: Column) -> Column:
    return F.translate(c, "–—―", "---")


def unquoted(c: Column) -> Column:
    """Without one quote at either end, trimmed."""
    return F.trim(F.regexp_replace(c, "^['\"]|['\"]$", ""))


def unescaped(c: Column) -> Column:
    r"""``\uXXXX`` written out as characters; rows without such stay in the JVM."""
    import re

    @F.pandas_udf("string")
    def decode(s: pd.Series) -> pd.Series:
        pair = re.compile(r"(?:\\u[0-9a-fA-F]{4})+")
        one = lambda m: bytes.fromhex(m[0].replace("\\u", "")).decode("utf-16-be", "replace")
        return s.map(lambda x: pair.sub(one, x), na_action="ignore")

    return F.when(F.contains(c, F.lit("\\u")), decode(c)).otherwise(c)


def key_form(c: Column) -> Column:
    """Only lower-case ASCII letters and digits; what name keys are compared by."""
    return F.regexp_replace(F.lower(c), "[^a-z0-9]", "")


def to_number(c: Column) -> Column:
    """A number from text: commas dropped, ``n%`` as a hundredth, true and false as 1 and 0, all else (also ``nan`` and
    ``inf``) null."""
    t = F.lower(F.trim(F.replace(c, F.lit(","), F.lit(""))))
    digits = r"^[+-]?(\d+\.?\d*|\.\d+)(e[+-]?\d+)?$"
    number = lambda x: F.when(x.rlike(digits), x.try_cast("double"))
    return F.when(t == "true", 1.0).when(t == "false", 0.0).when(F.endswith(t, F.lit("%")), number(F.trim(F.rtrim(F.regexp_replace(t, "%$", "")))) / 100).otherwise(number(t))


def id_of_uri(c: Column) -> Column:
    """The last path segment."""
    return F.element_at(F.split(c, "/"), -1)


def uris_of_ids(c: Column, prefix: str) -> Column:
    """Comma-separated ids to an array of URIs."""
    return F.transform(F.split(c, ","), lambda x: F.concat(F.lit(prefix), F.trim(x)))


def label_with_ids(label: Column, ids: Column, scheme: str = "CID") -> Column:
    """``X [CID:1, 2]``; the label alone where there are no ids."""
    return F.when(F.size(ids) > 0, F.concat(label, F.lit(f" [{scheme}:"), F.array_join(ids, ", "), F.lit("]"))).otherwise(label)


def ids_of_label(c: Column, scheme: str = "CID") -> Column:
    found = F.regexp_extract(c, rf"\[{scheme}:([^\]]*)\]", 1)
    return F.when(found == "", F.array().cast("array<string>")).otherwise(F.transform(F.split(found, ","), lambda x: F.trim(x)))


def escaped_braces(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("{"), F.lit("{{")), F.lit("}"), F.lit("}}"))


def rendered(template: str, **values: Column) -> Column:
    """The template with each ``{name}`` replaced, one name after the other."""
    out = F.lit(template)
    for name, value in values.items():
        out = F.replace(out, F.lit("{" + name + "}"), F.coalesce(value.cast("string"), F.lit("")))
    return out


def token_chunks(tokens: Column, size: int, reserve: int = 4) -> Column:
    """An array of arrays of at most ``size - reserve`` tokens."""
    step = size - reserve

    def cut(t: Column) -> Column:
        starts = F.sequence(F.lit(0), F.greatest(F.floor((F.size(t) - 1) / step).cast("int"), F.lit(0)))
        return F.when(F.size(t) > 0, F.transform(starts, lambda i: F.slice(t, i * step + 1, step)))

    return F.get(F.transform(F.array(tokens), cut), F.lit(0))  # the tokens are worked out once, not for each chunk


def holds_any(path: Column, terms: list[str]) -> Column:
    """Whether the text holds one of the terms."""
    return F.exists(F.array(*map(F.lit, terms)), lambda t: F.contains(path, t)) if terms else F.lit(False)


def matching(values: Column, term: Column) -> Column:
    """The array's members that hold ``term`` in any case."""
    return F.filter(values, lambda v: F.contains(F.lower(v), F.lower(term)))


def present(c: Column) -> Column:
    """Not one of the spellings of a missing value."""
    return c.isNotNull() & ~F.trim(c).isin("", MISSING, "[]", "{}")


def printable(c: Column, nested: bool = False) -> Column:
    """Null as "", primitives as text, nested values as compact JSON."""
    return F.coalesce(F.to_json(c) if nested else c.cast("string"), F.lit(""))


def path_key(c: Column) -> Column:
    """A path's letters, digits and dots."""
    return F.regexp_replace(c, "[^A-Za-z0-9.]", "")
