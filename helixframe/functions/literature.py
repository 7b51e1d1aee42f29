"""Text columns of curated tables: article numbers, p-values, genes, mojibake, trimmed prose, INFO fields."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Dashes that authored p-values hold, and what they stand for.
DASHES = "‐‑‒–—−"


def article_ids(raw: Column) -> Column:
    """Article numbers in order, without repeats: those written 'PMID n', else bare ones of 4 to 9 digits; none from other sites' URLs."""
    named = F.regexp_extract_all(raw, F.lit(r"(?i)pmid[:\s]*([0-9]+)"), F.lit(1))
    bare = F.regexp_extract_all(raw, F.lit(r"(?<![0-9])([0-9]{4,9})(?![0-9])"), F.lit(1))
    foreign = F.lower(raw).contains("http") & ~F.lower(raw).contains("pubmed")
    found = F.when(F.size(named) > 0, named).when(foreign, F.array().cast("array<string>")).otherwise(bare)
    stripped = F.transform(found, lambda x: F.regexp_replace(x, "^0+", ""))
    return F.array_distinct(F.filter(stripped, lambda x: x != ""))


def accepted(ids: Column) -> Column:
    return F.filter(ids, lambda x: F.length(x) <= 8)


def rejected(ids: Column) -> Column:
    return F.filter(ids, lambda x: F.length(x) > 8)


def p_value_text(raw: Column) -> Column:
    return F.translate(F.trim(raw), DASHES, "-" * len(DASHES))


def p_value(raw: Column) -> Column:
    """The number, where the text is a single number."""
    return p_value_text(raw).try_cast("double")


def _code_page() -> tuple[str, str]:
    """The letters of the Cyrillic code page 1251 above ASCII, and for each the character whose code is its byte."""
    found = [(bytes([b]).decode("cp1251", "ignore"), chr(b)) for b in range(0x80, 0x100)]
    letters = [(a, b) for a, b in found if a]
    return "".join(a for a, _ in letters), "".join(b for _, b in letters)


_LETTERS, _BYTES = _code_page()
_CYRILLIC = "[^\u0400-\u04ff]"


def unscrambled(text: Column) -> Column:
    """Undoes UTF-8 read as a Cyrillic code page where that leaves fewer Cyrillic letters; other texts stay as they are."""
    fits = text.rlike("[\u0400-\u04ff]") & (F.translate(text, _LETTERS, "").rlike("^[\\x00-\\x7f]*$"))
    # each letter becomes the character of its byte's code, so that Latin-1 writes the bytes that were misread
    other = F.encode(F.translate(F.when(fits, text).otherwise(""), _LETTERS, _BYTES), "ISO-8859-1").cast("string")
    count = lambda c: F.length(F.regexp_replace(c, _CYRILLIC, ""))
    return F.when(fits & F.is_valid_utf8(other) & (count(other) < count(text)), other).otherwise(text)


def gene_tokens(cell: Column) -> Column:
    """The symbols a cell holds, split at comma, semicolon, slash and bracket."""
    return F.filter(F.transform(F.split(cell, r"[,;/(]"), lambda x: F.trim(F.regexp_replace(x, r"[)]", ""))), lambda x: x != "")


def trimmed(text: Column, limit: int = 600) -> Column:
    """White space folded, and at most limit characters: whole sentences if one fits, else whole words, else cut."""
    text = F.trim(F.regexp_replace(text, r"\s+", " "))
    sentences = F.split(text, r"(?<=[.!?])\s+")
    join = lambda acc, x: F.when(acc["done"], acc).when(F.length(F.concat_ws(" ", acc["text"], x)) <= limit, F.struct(F.concat_ws(" ", acc["text"], x).alias("text"), F.lit(False).alias("done"))).otherwise(F.struct(acc["text"].alias("text"), F.lit(True).alias("done")))
    start = F.struct(F.lit(None).cast("string").alias("text"), F.lit(False).alias("done"))
    by_sentence = F.aggregate(sentences, start, join, lambda acc: acc["text"])
    by_word = F.regexp_extract(F.substring(text, 1, limit + 1), r"(?s)^(.*)\s", 1)
    return F.when(F.length(text) <= limit, text).otherwise(F.coalesce(F.nullif(by_sentence, F.lit("")), F.nullif(F.rtrim(by_word), F.lit("")), F.substring(text, 1, limit)))


def info_value(info: Column, key: str) -> Column:
    """A key's value in an INFO field; of several the last."""
    found = F.regexp_extract_all(F.concat(F.lit(";"), info, F.lit(";")), F.lit(f"(?<=;){key}=([^;]*)(?=;)"), F.lit(1))
    return F.element_at(F.when(F.size(found) > 0, found), -1)


def genes_of(info: Column) -> Column:
    """Gene symbols of GENEINFO, which lists symbol:number pairs apart by '|'."""
    return F.filter(F.transform(F.split(info_value(info, "GENEINFO"), "[|]"), lambda x: F.substring_index(x, ":", 1)), lambda x: x != "")


def has_pathogenic(significance: Column) -> Column:
    """True where one of the terms apart by '|' or '/' is pathogenic or likely pathogenic."""
    terms = F.transform(F.split(F.lower(significance), "[|/]"), lambda x: F.replace(F.trim(x), F.lit(" "), F.lit("_")))
    return F.coalesce(F.arrays_overlap(terms, F.array(F.lit("pathogenic"), F.lit("likely_pathogenic"))), F.lit(False))


def first_rs(info: Column) -> Column:
    number = F.regexp_extract(info_value(info, "RS"), "^([0-9]+)", 1)
    return F.when(number != "", F.concat(F.lit("rs"), number))
