"""Text normalisation as Column expressions."""

from __future__ import annotations

import json
import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from aisle.functions import fixed_values as fv

#: Explicit so that the JVM, RE2 and Python agree on what a blank is.
_BLANKS = r"[\t\n\x0B\f\r \x1C-\x1F]+"
_TAG = r"<[^>]+>"
_URL = r"(?U)https?://\S+"
_WORD = r"\p{L}\p{N}_"


def squeeze(c: Column) -> Column:
    """Runs of blanks to one space, ends trimmed."""
    return F.trim(F.regexp_replace(c, _BLANKS, " "))


def tokens(c: Column) -> Column:
    return F.filter(F.split(c, r"(?U)\s+"), lambda w: w != "")


def word_count(c: Column) -> Column:
    return F.size(tokens(c))


def clean_text(c: Column) -> Column:
    """Markup, links and non-ASCII characters out; null tokens become ''."""
    text = F.coalesce(c.cast("string"), F.lit(""))
    body = F.regexp_replace(text, _TAG, " ")
    body = F.regexp_replace(body, _URL, "")
    body = F.regexp_replace(body, r"[^\x00-\x7F]", "")
    return F.when(F.lower(text).isin("", "nan", "none", "null"), "").otherwise(squeeze(body))


def boilerplate_pattern(
    patterns: Sequence[str] = tuple(fv.BOILERPLATE_PATTERNS),
    site: str = fv.SHOP_SITE,
    sku_min_len: int | None = fv.SKU_MIN_LEN,
) -> str:
    """One alternation, so that the leftmost phrase wins as a whole."""
    branches = [p.replace("{site}", site) for p in patterns]
    if sku_min_len is not None:
        branches.append(r"\b[a-z0-9]{%d,}\b" % sku_min_len)
    return "(?i)" + "|".join(branches)


def guarded_pattern() -> str:
    """:func:`boilerplate_pattern` with its defaults in a form that gives up early: the same matches.

    At each character the plain form tries every phrase, and reads on to the end of the
    word for a web address. Here phrases, which all begin with two plain characters, are
    tried only where two such stand, and an address only where its run of name characters,
    or the search after a match, begins: all starts inside a run see the same end of it.
    """
    branches, address = [], fv.BOILERPLATE_PATTERNS.index("{site}")
    for phrases in (fv.BOILERPLATE_PATTERNS[:address], fv.BOILERPLATE_PATTERNS[address + 1:]):
        starts = [re.match(r"(?:\\b)?\\?([a-z0-9(])([a-z0-9])", p).groups() for p in phrases]
        first, second = ("".join(sorted(set(letters))) for letters in zip(*starts))
        phrases = "|".join(phrases).replace("{site}", fv.SHOP_SITE)
        branches.append(f"(?=[{first}][{second}])(?:{phrases})")
    branches.insert(1, rf"(?:(?<![a-z0-9-])|\G){fv.SHOP_SITE}")
    branches.append(r"\b[a-z0-9]{%d,}\b" % fv.SKU_MIN_LEN)
    return "(?i)" + "|".join(branches)


def strip_boilerplate(c: Column, pattern: str | None = None) -> Column:
    """Sales phrases and article-number-like tokens out, punctuation re-spaced."""
    text = F.coalesce(c, F.lit(""))
    text = F.regexp_replace(text, pattern or guarded_pattern(), " ")
    text = F.regexp_replace(text, _BLANKS, " ")
    text = F.regexp_replace(text, r"\s*([,.;:!?])\s*", "$1 ")
    return F.btrim(text, F.lit(" ,.;:-"))


def _labelled(label: str, value: Column) -> Column:
    """The value after its label, null if it is blank; bound to a name, so that it is computed once."""
    def text(v: Column) -> Column:
        return F.when(F.trim(v) != "", F.concat(F.lit(f"{label}: "), v))

    return F.get(F.transform(F.array(value), text), F.lit(0))


def _field(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def combined_text(pattern: str | None = None) -> Column:
    """Labelled catalogue fields in one string; blank fields are left out."""
    category = F.concat_ws(" ", _field("department"), _field("category"), _field("subcategory"))
    return F.concat_ws(
        " ",
        _labelled("Product", _field("product_name")),
        _labelled("Category", category),
        _labelled("Type", _field("product_type")),
        _labelled("Brand", _field("brand")),
        _labelled("Features", strip_boilerplate(_field("features"), pattern)),
        _labelled("Description", strip_boilerplate(_field("description"), pattern)),
        _labelled("Tags", _field("tags")),
    )


def enhanced_text(pattern: str | None = None) -> Column:
    """The enriched description with key metadata, or the combined text if it is short."""
    enriched = F.trim(_field("enriched_description"))
    rich = F.concat(
        _field("product_name"), F.lit(". "), enriched,
        F.lit(". Category: "), _field("category"),
        F.lit(". Brand: "), _field("brand"),
        F.lit(". Tags: "), _field("tags"), F.lit("."),
    )
    return F.when(F.length(enriched) > 50, rich).otherwise(combined_text(pattern))


def leaf_text() -> Column:
    """Text of a product as a taxonomy leaf; blank fields keep their separators."""
    return F.concat(
        _field("product_name"), F.lit(". "), _field("category"), F.lit(". "), _field("features")
    )


def normalize_product_text(c: Column) -> Column:
    """Lower-cased text that keeps word characters and price/sentence punctuation."""
    text = F.lower(F.coalesce(c.cast("string"), F.lit("")))
    text = F.regexp_replace(text, _TAG, " ")
    text = F.regexp_replace(text, _URL, "")
    text = F.regexp_replace(text, rf"(?U)[^{_WORD}\s.,;:!?{fv.CURRENCY}$%-]", " ")
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def remove_special_chars(c: Column) -> Column:
    text = F.regexp_replace(c, rf"(?U)[^{_WORD}\s]", " ")
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def constant(value: object, ddl: str) -> Column:
    """A Python list or dict as one constant: the optimizer folds the parsed text."""
    return F.from_json(F.lit(json.dumps(value)), ddl)


def stopwords(*lists: Sequence[str]) -> Column:
    """Union of stopword lists as one array constant."""
    given = lists or (fv.ENGLISH_STOPWORDS, fv.EXTRA_STOPWORDS)
    union = constant(list(given[0]), "array<string>")
    for more in given[1:]:
        union = F.array_union(union, constant(list(more), "array<string>"))
    return union


def remove_stopwords(c: Column, stop: Column | None = None) -> Column:
    stop = stopwords() if stop is None else stop
    return F.array_join(F.filter(tokens(c), lambda w: ~F.array_contains(stop, w)), " ")


def map_words(c: Column, words: Mapping[str, str] | None = None) -> Column:
    """Each token replaced by its one- or many-word translation, if it has one."""
    table = fv.CODE_MIXED_WORDS if words is None else words
    entries = constant(dict(table), "map<string, string>")
    mapped = F.transform(tokens(F.lower(c)), lambda w: F.coalesce(F.try_element_at(entries, w), w))
    return F.array_join(mapped, " ")
