"""Text and n-grams as Column expressions; all stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clean_text(text: Column) -> Column:
    """Lower case; runs of anything but a-z and 0-9 become one space; null becomes empty."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+", " "))


def item_text() -> Column:
    """Title and tags stand twice, joined without a space, so a boundary token appears."""
    tags = clean_text(F.array_join(F.coalesce(F.col("tags"), F.array().cast("array<string>")), " "))
    once = [clean_text(F.col(c)) for c in ("category", "subcategory", "brand")]
    return F.concat_ws(" ", F.repeat(clean_text(F.col("title")), 2), *once, F.repeat(tags, 2), clean_text(F.col("description")))


def word_ngrams(text: Column) -> Column:
    """Words of two characters or more, and pairs of neighbouring ones."""
    words = F.regexp_extract_all(text, F.lit("[a-z0-9]{2,}"), F.lit(0))
    return F.concat(words, F.zip_with(F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0))), F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0))), lambda a, b: F.concat(a, F.lit(" "), b)))


def char_ngrams(text: Column, low: int = 3, high: int = 5) -> Column:
    """Substrings of every word with a space on each side: all of low to high characters."""
    words = F.filter(F.split(text, " +"), lambda w: w != "")

    def of_word(word: Column) -> Column:
        padded = F.concat(F.lit(" "), word, F.lit(" "))
        size = F.length(padded)

        def of_length(n: int) -> Column:
            cut = F.transform(F.sequence(F.lit(1), size - n + 1), lambda i: F.substring(padded, i, F.lit(n)))
            return F.when(size >= n, cut).otherwise(F.array().cast("array<string>"))

        return F.concat(*map(of_length, range(low, high + 1)))

    return F.flatten(F.transform(words, of_word))
