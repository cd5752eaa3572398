"""Names: folding, branches, synonyms, similarity (FN-7 to FN-12, FN-15 to FN-20)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Accented letters and their plain forms, position by position.
ACCENTED = "ÁÀÂÄÃÅÉÈÊËÍÌÎÏÓÒÔÖÕÚÙÛÜÑÇ"
PLAIN = "AAAAAAEEEEIIIIOOOOOUUUUNC"

# Words of one meaning in the region's languages.
SYNONYMS = {"CONCELLO": "AYUNTAMIENTO", "UDALA": "AYUNTAMIENTO", "TROFEU": "TROFEO", "BANDEIRA": "BANDERA", "IKURRINA": "BANDERA", "CIDADE": "CIUDAD"}
CONJUNCTIONS = ("DE", "DEL", "LA", "LAS", "EL", "LOS", "E", "Y", "DO", "DA")

# Tokens that may stand for each other, and tokens that may be missing.
INTERCHANGEABLE = ("trofeo", "bandera", "regata")
OPTIONAL = ("trainera", "femenino", "masculino", "ayuntamiento")


def fold(text: Column) -> Column:
    """Upper case without accents; equal folds are equal names."""
    return F.translate(F.upper(text), ACCENTED, PLAIN)


def contains_folded(text: Column, part: Column) -> Column:
    return F.contains(fold(text), fold(part))


def joined_names(names: Column) -> Column:
    return F.array_join(names, " ")


def strip_branch(name: Column, faithful: bool = False) -> Column:
    """The name without its branch letter.

    The faithful form strips the letters B, C and blanks from the end as a set of characters, which
    also shortens names like CLUB; the other removes one trailing word B or C.
    """
    if faithful:
        return F.rtrim(F.rtrim(name, F.lit(" B")), F.lit(" C"))
    return F.regexp_replace(name, " [BC]$", "")


def branch_letter(name: Column) -> Column:
    """B, C or D at the end of a name, quotes allowed; null if there is none."""
    letter = F.regexp_extract(F.upper(name), " [\"']?([BCD])[\"']?$", 1)
    return F.when(letter != "", letter)


def can_be_branch(name: Column, all_names: Column) -> Column:
    """A lettered boat whose club is in the race under its plain name too."""
    return branch_letter(name).isNotNull() & F.array_contains(all_names, F.regexp_replace(name, " [\"']?[BCD][\"']?$", ""))


def display_club(club: Column, club_names: Column) -> Column:
    """The club with the quoted letters that stand as words in the names; null for no club."""
    words = F.flatten(F.transform(club_names, lambda n: F.split(n, " ")))
    letters = F.filter(F.array(F.lit("B"), F.lit("C"), F.lit("D")), lambda x: F.array_contains(words, x))
    quoted = F.transform(letters, lambda x: F.concat(F.lit(' "'), x, F.lit('"')))
    return F.concat(club, F.array_join(quoted, ""))


def clean_spaces(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def remove_parenthesis(text: Column) -> Column:
    return clean_spaces(F.regexp_replace(text, r"\([^)]*\)", ""))


def remove_symbols(text: Column) -> Column:
    return clean_spaces(F.regexp_replace(text, r"[^\p{L}\p{N}\s]", " "))


def remove_conjunctions(text: Column) -> Column:
    words = F.filter(F.split(text, " "), lambda w: ~F.upper(w).isin(*CONJUNCTIONS))
    return F.array_join(words, " ")


def normalize_synonyms(text: Column) -> Column:
    """Folded words, each replaced by the first word of its meaning."""
    table = F.create_map(*[F.lit(x) for pair in SYNONYMS.items() for x in pair])
    return F.array_join(F.transform(F.split(fold(text), " "), lambda w: F.coalesce(F.try_element_at(table, w), w)), " ")


def name_tokens(text: Column) -> Column:
    """Distinct folded words in lower case, sorted: the fallback for lemmas."""
    return F.sort_array(F.array_distinct(F.filter(F.split(F.lower(remove_conjunctions(remove_symbols(normalize_synonyms(text)))), " "), lambda w: w != "")))


def expand_tokens(tokens: Column) -> Column:
    """All alternatives of a token list: interchangeable tokens swapped, optional ones left out.

    The result holds the tokens themselves, each swap, and each of those without optional tokens.
    """
    present = F.filter(F.array(*[F.lit(x) for x in INTERCHANGEABLE]), lambda x: F.array_contains(tokens, x))
    rest = F.array_except(tokens, F.array(*[F.lit(x) for x in INTERCHANGEABLE]))
    swaps = F.transform(F.array(*[F.lit(x) for x in INTERCHANGEABLE]), lambda x: F.sort_array(F.array_union(rest, F.array(x))))
    swapped = F.when(F.size(present) > 0, swaps).otherwise(F.array(F.sort_array(tokens)))
    fewer = F.transform(swapped, lambda t: F.sort_array(F.array_except(t, F.array(*[F.lit(x) for x in OPTIONAL]))))
    return F.array_distinct(F.concat(F.array(F.sort_array(tokens)), swapped, fewer))


def is_play_off(name: Column) -> Column:
    return F.coalesce(name.ilike("%PLAY%OFF%"), F.lit(False))


def is_memorial(name: Column) -> Column:
    return F.coalesce(name.ilike("%MEMORIAL%"), F.lit(False))


def relative_distance(a: Column, b: Column) -> Column:
    """Edit distance over the mean length; null for two empty names."""
    mean = (F.length(a) + F.length(b)) / 2
    return F.when(mean > 0, F.levenshtein(a, b) / mean)


def similarity(a: Column, b: Column) -> Column:
    """1 for equal names, 0 for names without anything in common; null for two empty names."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest > 0, 1 - F.levenshtein(a, b) / longest)


def normalize_club(name: Column, known: Column, sponsors: tuple = (), pairs: tuple = (("IBERIA", "KAIKU"),)) -> Column:
    """A club's name without its sponsor.

    `known` tells of a folded name whether it is (part of) a club's name.  Of two parts around a
    dash the known one stays; a sponsor goes, unless both parts are one of `pairs`.  If neither part
    is known, or there is no dash, the name stays.  known is a function of a column.
    """
    first, second = F.trim(F.split_part(name, F.lit("-"), F.lit(1))), F.trim(F.split_part(name, F.lit("-"), F.lit(2)))
    paired = F.lit(False)
    for a, b in pairs:
        paired = paired | (F.sort_array(F.array(fold(first), fold(second))) == F.array(F.lit(a), F.lit(b)))
    usable = lambda part: known(fold(part)) & (part != "") & ~fold(part).isin(*sponsors) if sponsors else known(fold(part)) & (part != "")
    kept = F.concat_ws(" - ", F.when(usable(first), first), F.when(usable(second), second))
    return F.when(F.contains(name, F.lit("-")) & ~paired & (kept != ""), kept).otherwise(name)
