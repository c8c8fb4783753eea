"""Text of items: soups, tokens, prompts, explanations."""

from __future__ import annotations

from pyspark.ml.feature import StopWordsRemover
from pyspark.sql import Column
from pyspark.sql import functions as F


def soup(title: Column, author: Column, subjects: Column) -> Column:
    """Title. Author. Subjects"""
    return F.concat_ws(". ", F.coalesce(title, F.lit("")), F.coalesce(author, F.lit("")), F.coalesce(subjects, F.lit("")))


def weighted_soup() -> Column:
    """Title, three times the author, twice the subjects, the publisher."""
    c = lambda n: F.coalesce(F.col(n), F.lit(""))
    return F.concat(c("Title"), F.lit(" "), F.repeat(F.concat(c("Author"), F.lit(" ")), 3), F.repeat(F.concat(c("Subjects"), F.lit(" ")), 2), c("Publisher"))


def enriched_soup() -> Column:
    c = lambda n: F.coalesce(F.col(n), F.lit(""))
    return F.concat(F.lit("Titre: "), c("Title"), F.lit(". Auteur: "), c("clean_author"), F.lit(". Genre: "), c("category"), F.lit(". Sujets: "), c("Subjects"), F.lit(". Résumé: "), c("description"))


def stop_words() -> list[str]:
    """Spark's public English list."""
    return StopWordsRemover.loadDefaultStopWords("english")


def tokens(text: Column, stop: list[str] | None = None, bigrams: bool = False) -> Column:
    """Lower-case words of two or more word characters (any alphabet), without stop words; optionally with pairs of neighbours."""
    found = F.regexp_extract_all(F.lower(text), F.lit(r"(?U)\b\w\w+\b"), F.lit(0))
    kept = F.filter(found, lambda w: ~w.isin(stop)) if stop else found
    if not bigrams:
        return kept
    pairs = F.zip_with(F.slice(kept, 1, F.greatest(F.size(kept) - 1, F.lit(0))), F.slice(kept, 2, F.greatest(F.size(kept) - 1, F.lit(0))), lambda a, b: F.concat_ws(" ", a, b))
    return F.concat(kept, F.when(F.size(kept) > 1, pairs).otherwise(F.array().cast("array<string>")))


def prompt_line() -> Column:
    """ID:..|T:..|A:.. of an item, its author 'Unknown' where null."""
    return F.concat(F.lit("ID:"), F.col("i").cast("string"), F.lit("|T:"), F.coalesce(F.col("Title"), F.lit("")), F.lit("|A:"), F.coalesce(F.col("Author"), F.lit("Unknown")))


def reasons(author: Column, subjects: Column, titles: Column, genres: tuple[tuple[tuple[str, ...], str], ...], default: str) -> Column:
    """Why an item is shown: its author named in a title of the history, and genre words found in its subjects, joined by a bullet."""
    a, s = F.lower(F.coalesce(author, F.lit(""))), F.lower(F.coalesce(subjects, F.lit("")))
    named = (a != "") & F.exists(titles, lambda t: F.lower(t).contains(a))
    parts = [F.when(named, F.concat(F.lit("You have read "), author))]
    for words, label in genres:
        found = s.contains(words[0])
        for w in words[1:]:
            found = found | s.contains(w)
        parts.append(F.when(found, F.lit(label)))
    text = F.array_join(F.filter(F.array(*parts), lambda x: x.isNotNull()), " • ")
    return F.when(text == "", F.lit(default)).otherwise(text)
