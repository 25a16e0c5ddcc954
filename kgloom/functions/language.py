"""Whether a caption reads as Chinese, and small functions of contents."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that mark English prose, and capitals that are words rather than names.
GLUE = ("a", "an", "the", "and", "or", "but", "from", "to", "of", "for", "with", "without", "in", "on", "at", "by", "as", "is", "are", "was", "were", "be", "been", "being", "this", "that", "these", "those", "we", "you", "they", "he", "she", "it", "our", "your", "their", "can", "could", "will", "would", "have", "has", "had")
ORDINARY = ("THIS", "THAT", "IS", "ARE", "THE", "A", "AN", "AND", "OR", "YES", "NO", "HELLO", "WELCOME", "THANK", "THANKS", "YOU", "WE", "I", "IT", "DO", "NOT", "CAN", "WILL", "WITH", "TO", "FOR", "OF")
# Kinds of content that are documents.
DOCUMENTS = ("VideoObject", "Article", "Book", "CreativeWork", "MediaObject")


def chinese(text: Column) -> Column:
    """Han letters and no kana; of latin words no more than half the Han letters (three are free), unless all are names."""
    han = F.regexp_count(text, F.lit(r"[\x{3400}-\x{9fff}]"))
    latin = F.regexp_extract_all(text, F.lit("[A-Za-z]{2,}"), F.lit(0))
    names = F.forall(latin, lambda w: ~F.lower(w).isin(*GLUE) & F.rlike(w, F.lit("[A-Z]")))
    few = F.size(latin) <= F.greatest(F.lit(3), F.floor(han / 2))
    return F.coalesce(~F.rlike(text, F.lit(r"[\x{3040}-\x{30ff}]")) & (han > 0) & (few | names), F.lit(False))


def literal(text: Column) -> Column:
    """A URL, numbers, or up to four identifiers in capitals or digits."""
    words = F.filter(F.split(text, r"\s+"), lambda w: w != "")
    name = lambda w: F.rlike(w, F.lit(r"^[A-Za-z0-9.+_-]+$")) & ~F.upper(w).isin(*ORDINARY) & ((F.regexp_count(w, F.lit("[A-Z]")) >= 2) | F.rlike(w, F.lit(r"^\d+$")))
    plain = F.rlike(F.trim(text), F.lit(r"^https?://\S+$")) | F.rlike(text, F.lit(r"^[\d\s.,:%+\-/$¥€()]+$"))
    return F.coalesce((F.trim(text) != "") & (plain | (F.size(words).between(1, 4) & F.forall(words, name))), F.lit(False))


def visible(kind: Column, layer: str, only: str = "all") -> Column:
    """Whether an entity of a type is shown in a layer: all, claims, documents or core (neither)."""
    layers = {"all": F.lit(True), "claims": kind == "Claim", "documents": kind.isin(*DOCUMENTS), "core": ~kind.isin("Claim", *DOCUMENTS)}
    return layers[layer] & (F.lit(True) if only == "all" else kind == only)


def toggled(current: Column, category: Column, none: str) -> Column:
    """Categories after a person clicks one: gone if it was there, else added; `none` stands alone."""
    others = F.filter(current, lambda c: (c != category) & (c != none))
    left = F.when(F.size(others) == 0, F.array(F.lit(none))).otherwise(others)
    return F.when(category == none, F.array(F.lit(none))).when(F.array_contains(current, category), left).otherwise(F.array_append(F.filter(current, lambda c: c != none), category))


def stamp(text: Column, version: int) -> Column:
    """What an analysis was made of: sha256, number of characters, version."""
    body = F.coalesce(text, F.lit(""))
    return F.struct(F.sha2(body, 256).alias("sha256"), F.char_length(body).alias("chars"), F.lit(version).alias("version"))


def quoted(text: Column) -> Column:
    """A URL path part: all but letters, digits and _.-~ as %XX."""
    encoded = F.url_encode(text)
    return F.replace(F.replace(F.replace(encoded, F.lit("+"), F.lit("%20")), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))
