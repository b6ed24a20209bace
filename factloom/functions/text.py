"""Text rules as column expressions: headings, numbering, hashes, instants and percentiles."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: What Roman digits stand for, and the form of a number that is well written.
ROMAN = {"I": 1, "V": 5, "X": 10, "L": 50, "C": 100, "D": 500, "M": 1000}
ROMAN_FORM = "^M*(CM|CD|D?C{0,3})(XC|XL|L?X{0,3})(IX|IV|V?I{0,3})$"


@F.pandas_udf(StringType())
def heading_title(title: pd.Series) -> pd.Series:
    """Compatibility-composed, case-folded, white space as single blanks; Spark has no function that composes."""
    return title.map(lambda x: None if x is None else " ".join(unicodedata.normalize("NFKC", x).casefold().split()))


def embedding_text_hash(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def letter_ratio(title: Column) -> Column:
    """Share of letters among the characters; 0 of an empty title."""
    return F.when(F.length(title) > 0, F.length(F.regexp_replace(title, r"[^\p{L}]", "")) / F.length(title)).otherwise(0.0)


def roman_value(token: Column) -> Column:
    """Value of a well-formed Roman number in capitals, else null."""
    digits = F.split(token, "")
    value = F.create_map(*(F.lit(x) for pair in ROMAN.items() for x in pair))
    values = F.transform(F.filter(digits, lambda c: c != ""), lambda c: F.element_at(value, c))
    following = F.concat(F.slice(values, 2, F.greatest(F.size(values), F.lit(1))), F.array(F.lit(0)))
    signed = F.zip_with(values, following, lambda a, b: F.when(a < b, -a).otherwise(a))
    total = F.aggregate(signed, F.lit(0), lambda s, x: s + x)
    return F.when(token.rlike(ROMAN_FORM) & (F.length(token) > 0), total)


def leading_number(title: Column) -> Column:
    """(scheme, values) of the number that a title begins with: arabic_dotted, alpha or roman; null for none.

    A letter before a full stop is alpha unless it could be a Roman digit; those are Roman where they are well formed.
    """
    bare = F.regexp_replace(title, r"^\s+", "")
    arabic = F.regexp_extract(bare, r"^(\d+(?:\.\d+)*)(?=$|[\s.)])", 1)
    letter = F.lower(F.regexp_extract(bare, r"^([A-Za-z])\.(?=$|\s)", 1))
    roman = roman_value(F.upper(F.regexp_extract(bare, r"^([IVXLCDMivxlcdm]+)(?=$|[\s.)])", 1)))
    made = lambda scheme, values: F.struct(F.lit(scheme).alias("scheme"), values.cast("array<decimal(38,0)>").alias("values"))
    as_letter = made("alpha", F.array(F.ascii(letter) - 96))
    return (
        F.when(arabic != "", made("arabic_dotted", F.split(arabic, r"\.")))
        .when((letter != "") & ~letter.isin(*map(str.lower, ROMAN)), as_letter)
        .when(roman.isNotNull(), made("roman", F.array(roman)))
        .when(letter != "", as_letter)
    )


def instant_of(text: Column) -> Column:
    """(at, date_only) of an ISO date or instant; both null where it is neither."""
    at = F.try_to_timestamp(F.trim(text))
    return F.struct(at.alias("at"), F.when(at.isNotNull(), F.trim(text).rlike(r"^\d{4}-\d{2}-\d{2}$")).alias("date_only"))


def nearest_rank(values: Column, share: float) -> Column:
    """The nearest-rank percentile of an array: its ceil(share * n)-th smallest; null of an empty one."""
    n = F.size(values)
    return F.when(n > 0, F.element_at(F.array_sort(values), F.greatest(F.ceil(n * F.lit(share)).cast("int"), F.lit(1))))


def canonical_set_hash(values: Column) -> Column:
    """Hash of an array as a set: sorted, without repeats, in JSON."""
    return F.sha2(F.to_json(F.array_sort(F.array_distinct(values))).cast("binary"), 256)
