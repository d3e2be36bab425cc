"""Plain forms of names and numbers, as column expressions."""

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Letters whose compatibility form is one ASCII character, and that character; derived from the Unicode tables.
FOLDS = {c: f for c in map(chr, range(0xA0, 0x10000)) if unicodedata.decomposition(c) and len(f := unicodedata.normalize("NFKD", c).encode("ascii", "ignore").decode()) == 1}


def ascii_folded(text: Column) -> Column:
    """Accents and width forms folded to ASCII; what has no ASCII form is dropped."""
    return F.regexp_replace(F.translate(text, "".join(FOLDS), "".join(FOLDS.values())), r"[^\x00-\x7F]+", "")


def plain(name: Column) -> Column:
    """ASCII letters and digits in lower case, one space between words."""
    return F.trim(F.regexp_replace(F.lower(ascii_folded(name)), r"[^a-z0-9]+", " "))


def words(name: Column) -> Column:
    """The words of a plain name; none for an empty one."""
    return F.filter(F.split(name, " "), lambda w: w != "")


def plain_number(value: Column, signed: bool = False) -> Column:
    """A number without trailing zeros ("2.5", "1"), with its sign if asked for."""
    text = F.regexp_replace(value.cast("decimal(12,4)").cast("string"), r"\.?0+$", "")
    return F.when(value >= 0, F.concat(F.lit("+"), text)).otherwise(text) if signed else text


def canonical_player(name: Column) -> Column:
    """"surname initial" from "Surname I.", "I. Surname" or "Firstname Surname"; a single word stays, no surname gives ""."""
    raw = F.filter(F.split(F.translate(name, ",", " "), r"\s+"), lambda w: w != "")
    token = lambda w: F.regexp_replace(F.lower(ascii_folded(w)), r"[^a-z0-9]", "")
    parts, initial = F.transform(raw, token), lambda w: F.length(token(w)) == 1
    n, first, last = F.size(raw), F.try_element_at(parts, F.lit(1)), F.try_element_at(parts, F.lit(-1))
    behind, before = F.array_join(F.slice(parts, 2, F.greatest(n - 1, F.lit(0))), ""), F.array_join(F.slice(parts, 1, F.greatest(n - 1, F.lit(0))), "")
    surname = F.when(initial(F.try_element_at(raw, F.lit(-1))), before).when(initial(F.try_element_at(raw, F.lit(1))), behind).otherwise(last)
    letter = F.when(initial(F.try_element_at(raw, F.lit(-1))), last).otherwise(first)
    return F.when(n == 0, "").when(n == 1, first).when((surname == "") | (letter == ""), "").otherwise(F.concat_ws(" ", surname, F.left(letter, F.lit(1))))


def without_digraphs(name: Column) -> Column:
    """Vowel pairs that stand for one foreign letter, as that letter's base."""
    for pair, letter in (("oe", "o"), ("ue", "u"), ("ae", "a"), ("aa", "a")):
        name = F.replace(name, F.lit(pair), F.lit(letter))
    return name
