"""Text and name functions, all Column to Column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The English Snowball stop words, in their published order.
STOP_WORDS = (
    "i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself "
    "they them their theirs themselves what which who whom this that these those am is are was were be been being have has had having "
    "do does did doing would should could ought i'm you're he's she's it's we're they're i've you've we've they've i'd you'd he'd she'd "
    "we'd they'd i'll you'll he'll she'll we'll they'll isn't aren't wasn't weren't hasn't haven't hadn't doesn't don't didn't won't "
    "wouldn't shan't shouldn't can't cannot couldn't mustn't let's that's who's what's here's there's when's where's why's how's "
    "a an the and but if or because as until while of at by for with about against between into through during before after above below "
    "to from up down in out on off over under again further then once here there when where why how all any both each few more most "
    "other some such no nor not only own same so than too very"
).split()

# Latin letters with marks, and the ASCII letter of each.
MARKED = "ÀÁÂÃÄÅĀĂĄÇĆĈĊČĎĐÈÉÊËĒĔĖĘĚĜĞĠĢĤĦÌÍÎÏĨĪĬĮİĴĶĹĻĽŁÑŃŅŇÒÓÔÕÖØŌŎŐŔŖŘŚŜŞŠŢŤŦÙÚÛÜŨŪŬŮŰŲŴÝŶŸŹŻŽ"
PLAIN = "AAAAAAAAACCCCCDDEEEEEEEEEGGGGHHIIIIIIIIIJKLLLLNNNNOOOOOOOOORRRSSSSTTTUUUUUUUUUUWYYYZZZ"


def _column(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def clean_field(text: Column | str) -> Column:
    """Tokens of a field: lower case, punctuation deleted, white space to single blanks, split, stop words dropped.

    A leading blank leaves an empty first token, a trailing one none; an empty text has no tokens, null stays null.
    """
    plain = F.regexp_replace(F.regexp_replace(F.lower(_column(text)), r"\p{Punct}", ""), r"\s+", " ")
    trimmed = F.regexp_replace(plain, " $", "")
    tokens = F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, " "))
    return F.filter(tokens, lambda t: ~t.isin(STOP_WORDS))


def clean_whole(text: Column | str) -> Column:
    """A field as one token: its cleaned tokens joined again."""
    return F.array_join(clean_field(text), " ")


def clean_last_name(name: Column | str) -> Column:
    """Upper-case letters without marks, punctuation or blanks."""
    upper = F.translate(F.upper(F.regexp_replace(_column(name), "[ßẞ]", "ss")), MARKED, PLAIN)
    return F.regexp_replace(F.regexp_replace(upper, r"\p{Punct}", ""), r"\s+", "")


def character_bigrams(name: Column | str) -> Column:
    """Distinct pairs of neighbouring characters; a single letter is doubled."""
    name = _column(name)
    n = F.char_length(name)
    pairs = F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.substring(name, i, F.lit(2)))
    return F.when(n >= 2, F.array_distinct(pairs)).when(n == 1, F.array(F.concat(name, name))).when(n == 0, F.array().cast("array<string>"))


def soundex_number(name: Column | str) -> Column:
    """The character codes of the Soundex key, written one after the other, as a number."""
    key = F.soundex(_column(name))
    codes = F.transform(F.filter(F.split(key, ""), lambda c: c != ""), lambda c: F.ascii(c).cast("string"))
    return F.array_join(codes, "").cast("double")


def parse_author(author: Column | str) -> Column:
    """Struct last_name, fn_initial, mn_initial of "<last name> <initials>"; what does not end in a word of letters, digits and underscores behind a blank is a last name with null initials."""
    full = F.trim(_column(author))
    last = F.nullif(F.regexp_extract(full, r"^(.*)\s+[\p{L}\p{N}_]+$", 1), F.lit(""))
    initials = F.nullif(F.regexp_extract(full, r"\s([\p{L}\p{N}_]+)$", 1), F.lit(""))
    single = last.isNull()
    return F.when(full.isNotNull(), F.struct(
        F.when(single, full).otherwise(F.trim(last)).alias("last_name"),
        F.when(~single, F.substring(initials, 1, 1)).alias("fn_initial"),
        F.when(~single, F.substring(initials, 2, 1)).alias("mn_initial"),
    ))


def given_names(first: Column | str) -> Column:
    """Struct first_name, middle_name of a given name as catalogues write it: one trailing full stop goes from each part."""
    parts = F.split(_column(first), " ")
    strip = lambda c: F.regexp_replace(c, r"\.$", "")
    return F.struct(strip(parts[0]).alias("first_name"), F.coalesce(strip(F.get(parts, F.lit(1))), F.lit("")).alias("middle_name"))
