"""Text expressions: Column in, Column out, all inside the JVM.

Functions that read their input more than once (guards, look-ups) should be applied
in a ``withColumn`` step of their own, so that the optimiser can keep the input as a
computed column; ``webdrift.operators.pages`` does so.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from webdrift import constants as C


def strip(text: Column) -> Column:
    """Cut white space of every kind at both ends (``trim`` alone cuts blanks only)."""
    return F.btrim(text, F.lit(C.ASCII_SPACES))


def is_ascii(text: Column) -> Column:
    """As many bytes as characters: no pattern needed."""
    return F.octet_length(text) == F.char_length(text)


def empty_to_null(text: Column) -> Column:
    return F.nullif(text, F.lit(""))


# --- pages -------------------------------------------------------------------------


def drop_hidden(html: Column) -> Column:
    """Remove comments and the content of scripts and styles."""
    return F.regexp_replace(html, C.HIDDEN, "")


def break_list_items(html: Column) -> Column:
    """Put a newline behind the first link of each list item, so menu entries stay apart."""
    segments = F.split(html, C.LIST_ITEM_BORDER)
    return F.array_join(
        F.transform(segments, lambda s: F.regexp_replace(s, C.FIRST_LINK_END, "$1\n$2")), ""
    )


def drop_tags(html: Column) -> Column:
    return F.regexp_replace(html, C.TAG, "")


def decode_entities(text: Column) -> Column:
    """Decode named and numeric character references, each exactly once.

    As in a browser, numeric references and the oldest names need no semicolon.
    """
    names = F.create_map(*[F.lit(x) for pair in C.ENTITY_CHARS.items() for x in pair])

    def char_of(point: Column) -> Column:
        valid = point.between(1, 0xD7FF) | point.between(0xE000, 0x10FFFF)
        return F.when(valid, F.decode(F.unhex(F.lpad(F.hex(point), 8, "0")), "UTF-32"))

    def decode_piece(piece: Column) -> Column:
        rest, name = piece["rest"], piece["name"]
        decimal, hexadecimal, open_name = piece["decimal"], piece["hexadecimal"], piece["open"]
        char = (
            F.when(decimal != "", char_of(decimal.cast("long")))
            .when(hexadecimal != "", char_of(F.conv(hexadecimal, 16, 10).cast("long")))
            .when(open_name != "", F.try_element_at(names, open_name))
        )
        length = F.length(decimal) + F.length(hexadecimal) + F.length(open_name)
        length = length + F.when(decimal != "", 1).when(hexadecimal != "", 2).otherwise(0)
        behind = F.substr(rest, length + 1)
        return F.coalesce(
            F.concat(F.when(name != "", F.try_element_at(names, name)), F.substr(rest, F.length(name) + 2)),
            F.concat(char, F.when(behind.startswith(";"), F.substr(behind, F.lit(2))).otherwise(behind)),
            F.concat(F.lit("&"), rest),
        )

    pieces = F.split(text, "&")
    tail = F.transform(
        F.slice(pieces, F.lit(2), F.size(pieces)),
        lambda p: F.struct(
            F.regexp_extract(p, C.ENTITY_NAME, 1).alias("name"), F.regexp_extract(p, C.ENTITY_OPEN, 1).alias("decimal"),
            F.regexp_extract(p, C.ENTITY_OPEN, 2).alias("hexadecimal"), F.regexp_extract(p, C.ENTITY_OPEN, 3).alias("open"),
            p.alias("rest"),
        ),
    )
    decoded = F.concat(F.element_at(pieces, 1), F.array_join(F.transform(tail, decode_piece), ""))
    return F.when(F.contains(text, F.lit("&")), decoded).otherwise(text)


def transliterate(text: Column) -> Column:
    """Latin letters, signs and typographic marks to ASCII; other scripts stay.

    Texts that are ASCII already skip the work.
    """
    single = F.translate(text, C.TRANSLATE_FROM, C.TRANSLATE_TO)
    # of the characters with several replacement letters only those that occur are replaced
    table = F.create_map(*[F.lit(x) for pair in C.MULTI_ASCII.items() for x in pair])
    present = F.array_distinct(F.regexp_extract_all(text, F.lit(C.NON_ASCII), F.lit(0)))
    ascii_text = F.aggregate(
        present, single, lambda t, c: F.coalesce(F.replace(t, c, F.try_element_at(table, c)), t)
    )
    return F.when(is_ascii(text), text).otherwise(ascii_text)


def _mask_unclosed(text: Column, opening: str, closing: str, mark: str) -> Column:
    """Opening brackets behind the last closing one become ``mark``: they cannot match."""
    last = F.char_length(text) - F.instr(F.reverse(text), closing) + 1
    last = F.when(F.contains(text, F.lit(closing)), last).otherwise(0)
    return F.concat(F.substr(text, F.lit(1), last), F.translate(F.substr(text, last + 1), opening, mark))


def _without(text: Column, pattern: str) -> Column:
    """Texts without an opening bracket, as most are by then, skip the pattern.

    A bracket that is never closed would be looked at to the end of the text, many of them in
    quadratic time; they are out of the pattern's sight.
    """
    bracket = F.contains(text, F.lit("<")) | F.contains(text, F.lit("{"))
    angle, curly = C.UNCLOSED_MARKS
    marked = _mask_unclosed(_mask_unclosed(text, "<", ">", angle), "{", "}", curly)
    cut = F.translate(F.regexp_replace(marked, pattern, ""), C.UNCLOSED_MARKS, "<{")
    strange = F.contains(text, F.lit(angle)) | F.contains(text, F.lit(curly))
    return F.when(bracket, F.when(strange, F.regexp_replace(text, pattern, "")).otherwise(cut)).otherwise(text)


def strip_markup(text: Column) -> Column:
    return _without(text, C.MARKUP)


def strip_markup_repeated(text: Column) -> Column:
    return _without(text, C.MARKUP_REPEATED)


def normalize_lines(text: Column) -> Column:
    """Trim lines, cut them at double blanks, drop empty pieces, one piece per line."""
    pieces = F.split(text, C.PIECE_BREAK)
    return F.array_join(F.filter(F.transform(pieces, strip), lambda p: p != ""), "\n")


def newline_to_sentence(text: Column) -> Column:
    """A newline ends a sentence: add a period unless an end mark is there."""
    ended = F.when(
        F.contains(text, F.lit("\n\n")), F.regexp_replace(text, C.NEWLINE_AFTER_TEXT, "$1. ")
    ).otherwise(F.regexp_replace(text, C.SINGLE_NEWLINE_AFTER_TEXT, ". "))
    return F.replace(ended, F.lit("\n"), F.lit(" "))


def meta_description(html: Column) -> Column:
    """Content of the page's description tag, or null."""
    tag = F.regexp_extract(html, C.META_DESCRIPTION, 0)
    content = F.coalesce(
        empty_to_null(F.regexp_extract(tag, C.META_CONTENT_DOUBLE, 1)),
        empty_to_null(F.regexp_extract(tag, C.META_CONTENT_SINGLE, 1)),
    )
    return content


def prefix_description(description: Column, text: Column) -> Column:
    """Put the description in front of the text as a sentence of its own."""
    glue = F.when(description.rlike(r"[.!?]\z"), " ").otherwise(". ")
    return F.coalesce(F.concat(description, glue, text), text)


def id_from_name(name: Column, suffix: str = ".html") -> Column:
    """File name without folder and suffix."""
    base = F.regexp_replace(name, r"^.*/", "")
    return F.regexp_replace(base, escape_literal(suffix) + "$", "")


def escape_literal(literal: str) -> str:
    """Escape a literal for a regular expression."""
    return "".join("\\" + c if not c.isalnum() else c for c in literal)


# --- normalisation -------------------------------------------------------------------


def mask_phone(text: Column) -> Column:
    return F.regexp_replace(text, C.PHONE, C.PHONE_WORD)


def mask_email(text: Column) -> Column:
    return F.regexp_replace(text, C.EMAIL_LINEAR, C.EMAIL_WORD)


def fix_missing_space(text: Column) -> Column:
    return F.regexp_replace(text, C.MISSING_SPACE_LINEAR, "$1 $2")


def fix_missing_period(text: Column) -> Column:
    return F.regexp_replace(text, C.MISSING_PERIOD_LINEAR, "$1. $3")


def normalize_text(text: Column) -> Column:
    """Phone numbers, e-mail addresses, missing blanks, missing periods, in this order."""
    return fix_missing_period(fix_missing_space(mask_email(mask_phone(text))))


def has_letter(text: Column) -> Column:
    """False for texts of digits and signs only; the empty text counts as kept."""
    return ~text.rlike(C.NO_LETTER)


# --- words and sentences --------------------------------------------------------------


def whitespace_tokens(text: Column) -> Column:
    """Tokens between white space of any kind; ASCII texts need the short pattern only."""
    parts = F.when(is_ascii(text), F.split(text, f"{C.ASCII_SPACE}+")).otherwise(F.split(text, f"{C.SPACE}+"))
    return F.filter(parts, lambda t: t != "")


def word_set(text: Column) -> Column:
    return F.array_distinct(whitespace_tokens(text))


def word_tokens(text: Column, min_chars: int = 3) -> Column:
    """Lower-case runs of at least ``min_chars`` letters, digits or underscores."""
    return F.regexp_extract_all(F.lower(text), F.lit(f"{C.WORD_CHAR}{{{min_chars},}}"), F.lit(0))


def split_sentences(text: Column, abbreviations: Iterable[str] = (), end_marks: str = C.SENTENCE_END) -> Column:
    """Sentences of a text as an array; a known abbreviation does not end a sentence.

    ``end_marks``: pattern of one group, behind which white space ends a sentence.
    """
    known = sorted(set(abbreviations), key=lambda a: (-len(a), a))
    masked = text
    if known:
        masked = F.regexp_replace(text, abbreviation_pattern(known), "$1" + C.MASK_MARK)
    marked = F.regexp_replace(masked, end_marks + r"\s+", "$1" + C.SEGMENT_MARK)
    parts = F.split(marked, C.SEGMENT_MARK)
    restored = F.transform(parts, lambda p: strip(F.translate(p, C.MASK_MARK, " ")))
    return F.filter(restored, lambda p: p != "")


def abbreviation_pattern(abbreviations: Iterable[str]) -> str:
    """An abbreviation that starts a word, with the blank behind it.

    Where all of them are dotted words, a word is looked up only if it ends in a dot.
    """
    choices = "|".join(escape_literal(a) for a in abbreviations)
    dotted = all(re.fullmatch(r"[A-Za-z0-9_.]*\.", a) for a in abbreviations)
    guard = r"(?=[\w.]++(?<=\.)\s)" if dotted else ""
    return rf"(?i)(?<![\w.]){guard}({choices})\s+"


def letter_tokens(text: Column, known: Iterable[str]) -> Column:
    """Lower-case runs of letters that are known words."""
    listed = list(known)
    return F.filter(F.regexp_extract_all(F.lower(text), F.lit(r"\p{L}+"), F.lit(0)), lambda t: t.isin(*listed))


def language_votes(tokens: Column, words: Mapping[str, Iterable[str]]) -> dict[str, Column]:
    """Function words of each language among the tokens: one count per language.

    ``tokens`` should hold words of the lists only, see ``letter_tokens``.
    """

    def votes(known: Iterable[str]) -> Column:
        listed = list(known)
        return F.size(F.filter(tokens, lambda t: t.isin(*listed)))

    return {lang: votes(known) for lang, known in words.items()}


def language_flag(lang: Column) -> Column:
    """0 for Dutch, 1 for anything else."""
    return F.when(lang == "dutch", F.lit(0.0)).otherwise(F.lit(1.0))
