"""Text expressions: normal forms, character n-grams, stable ids. Columns in, columns out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Unicode's white space, and the separators U+001C to U+001F, which Python's strip() removes too.
_EDGES = "".join(map(chr, (*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))


def normalized(text: Column) -> Column:
    """No-break and ideographic spaces as spaces, runs of spaces and tabs as one, no white space at the ends."""
    for space in ("\u00a0", "\u3000"):
        text = F.replace(text, F.lit(space), F.lit(" "))
    # most texts have no such run, and looking is cheap
    return bound(text, lambda t: F.btrim(F.when(t.contains("  ") | t.contains("\t"), F.regexp_replace(t, "[ \t]+", " ")).otherwise(t), F.lit(_EDGES)))


def comparable(text: Column) -> Column:
    """CJK ideographs, ASCII letters and digits alone, in lower case."""
    # most of what goes are spaces, which cost less without a pattern
    return F.lower(F.regexp_replace(F.replace(text, F.lit(" "), F.lit("")), "[^一-鿿A-Za-z0-9]+", ""))


def folded(text: Column) -> Column:
    """Letters and digits of any script, case-folded."""
    lower = F.lower(F.regexp_replace(text, r"(?U)[\W_]+", ""))
    return F.replace(F.replace(lower, F.lit("ß"), F.lit("ss")), F.lit("ς"), F.lit("σ"))


def bound(value: Column, use) -> Column:
    """use(value) with value computed once, also where use reads it in a lambda for each element."""
    return F.transform(F.array(value), use)[0]


def ngrams(text: Column, least: int, most: int) -> Column:
    """Character n-grams with repetition, by n and then by place. Characters are split once: substring walks from the start."""
    def of(chars: Column, n: int) -> Column:
        places = F.sequence(F.lit(0), F.greatest(F.lit(0), F.size(chars) - n))
        return F.when(F.size(chars) >= n, F.transform(places, lambda i: F.concat(*[F.get(chars, i + k) for k in range(n)]))).otherwise(F.array().cast("array<string>"))

    split = F.when(F.length(text) > 0, F.split(text, "")).otherwise(F.array().cast("array<string>"))
    return F.when(text.isNotNull(), bound(split, lambda chars: F.concat(*[of(chars, n) for n in range(least, most + 1)])))


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """df with columns that are computed once per row, whatever filters and projections read them."""
    made = F.struct(*[c.alias(n) for n, c in columns.items()])
    return df.withColumn("_made", F.explode(F.array(made))).select(*[c for c in df.columns if c not in columns], "_made.*")


def clamped(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def stable_id(prefix: str, *parts: Column, digits: int = 24) -> Column:
    return F.concat(F.lit(prefix), F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, digits))


def occurrences(text: Column, phrase: str) -> Column:
    """Non-overlapping occurrences of a phrase."""
    return ((F.length(text) - F.length(F.replace(text, F.lit(phrase), F.lit("")))) / len(phrase)).cast("int")


def rounded(x: Column | str, places: int) -> Column:
    """Half to even at a number of places, on the scaled binary value; SQL's round_even() does the same."""
    x = F.col(x) if isinstance(x, str) else x
    return F.rint(x * 10.0**places) / 10.0**places
