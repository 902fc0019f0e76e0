"""Patterns, word lists, thresholds and grids.

Results must equal those of the analysis this package reproduces, so the values
below are stated as they are.  Patterns are in Java syntax; ``re2`` gives the form
that engines without possessive quantifiers and look-behind accept.
"""

from __future__ import annotations

import unicodedata
from html.entities import html5, name2codepoint

# --- fixed values: text normalisation patterns ------------------------------------
PHONE = r"[\+\(\d-]?[1-9][0-9 .\-\(\)]{7,}[0-9]"
EMAIL = r"\w+[\.-]*\w*@{1}\w+[\.-]*\w*\.{1}\w+[\.-]*\w*"
MISSING_SPACE = r"([A-Za-z]+[\.\!\?]+)([A-Z]{1}[A-Za-z]*)"
MISSING_PERIOD = r"(\s[A-Z]?[a-z]{2,})([\.{3,}]*[\(.\)]*)([A-Z]{1}[a-z]+)"
NO_LETTER = r"^[^a-zA-z]+$"
MARKUP = r"<[^>]+>|\{[^}]+\}"
MARKUP_REPEATED = r"<+[^>]+>+|\{+[^}]+\}+"
NEWLINE_AFTER_TEXT = r"([^!.?])(\n)"
ABBREVIATION_SPLIT = r"\s\w+\s|\s*\/\s*|\;\s*"
ABBREVIATION_GLOSS = r"\s*\(.+\)"
ABBREVIATION_KEEP = r"^\w*\."
ABBREVIATION_NOTE = r"\[.*\]"
PHONE_WORD = "phonenumber"
EMAIL_WORD = "email"
SENTENCE_END = r"(>>|[.!?|]+)"
DEFAULT_LANGUAGE = "english"
LANGUAGE_NAMES = {"nl": "dutch", "en": "english"}
# ----------------------------------------------------------------------------------

# The same languages as EMAIL, MISSING_SPACE and MISSING_PERIOD, written so that a
# backtracking matcher needs linear time: runs are possessive, and a match may only
# start where a run starts (a leftmost match always does).  Web text holds words of
# any length (base64, minified code), on which the plain forms take quadratic or
# cubic time and would hang a task.
EMAIL_LINEAR = r"(?<!\w)\w++(?:[.-]++\w*+)?+@\w++(?:[.-]+\w*)?\.\w++(?:[.-]++\w*+)?+"
MISSING_SPACE_LINEAR = r"(?<![A-Za-z])([A-Za-z]++[.!?]++)([A-Z][A-Za-z]*+)"
MISSING_PERIOD_LINEAR = r"(\s[A-Z]?[a-z]{2,}+)([.{3,}]*+[(.)]*+)([A-Z][a-z]++)"

# --- page markup --------------------------------------------------------------------
# Comments, scripts and styles in one pass: whichever starts first wins; an unclosed
# one reaches to the end of the page, as in a browser.
HIDDEN = (
    r"(?is)<(?:!--.*?(?:-->|\z)"
    r"|script\b[^>]*>.*?(?:</script\s*>|\z)"
    r"|style\b[^>]*>.*?(?:</style\s*>|\z))"
)
# a quote opens a quoted value only behind an equals sign; elsewhere it is a plain character
TAG = (
    r"""<(?:/?[a-zA-Z](?:[^>=]++|=[=\s]*+(?:"[^"]*+"|'[^']*+'|[^\s"'>=]))*+(?:=[=\s]*+)?>"""
    r"""|[!?][^>]*+>)"""
)
LIST_ITEM_BORDER = r"(?i)(?=</?li\b)"
FIRST_LINK_END = r"(?is)^(<li\b.*?<a\s[^>]*\bhref\b[^>]*>.*?)(</a\s*>)"
META_DESCRIPTION = r"""(?is)<meta\b[^>]*\bname\s*=\s*["']?description["'\s/][^>]*>"""
META_CONTENT_DOUBLE = r'(?is)\bcontent\s*=\s*"([^"]*)"'
META_CONTENT_SINGLE = r"(?is)\bcontent\s*=\s*'([^']*)'"
ENTITY_NAME = r"^([A-Za-z][A-Za-z0-9]{1,31});"
# decimal, hexadecimal, and the names that browsers also take without a semicolon, longest first
ENTITY_OPEN = (
    r"^(?:#([0-9]{1,7})(?:[^0-9]|$)|#[xX]([0-9a-fA-F]{1,6})(?:[^0-9a-fA-F]|$)|("
    + "|".join(sorted((n for n in html5 if n[-1] != ";"), key=lambda n: (-len(n), n))) + "))"
)

# white space as Python's str.split / str.strip see it
ASCII_SPACE = r"[\t-\r\x1c-\x20]"
ASCII_SPACES = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f "
SPACE = (
    r"[\t-\r\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
)
LINE_BREAK = r"[\n-\r\x1c-\x1e]"
# a line break or two blanks, with one character class in front for speed
PIECE_BREAK = r"[\n-\r\x1c-\x1e ](?:(?<! )|(?<= ) )"
# as NEWLINE_AFTER_TEXT for texts without empty lines, looking at newlines only
SINGLE_NEWLINE_AFTER_TEXT = r"\n(?<=[^!.?]\n)"
NON_ASCII = r"[^\x00-\x7F]"
WORD_CHAR = r"[\p{L}\p{N}_]"

SEGMENT_MARK = "\x01"
MASK_MARK = "\x02"
UNCLOSED_MARKS = "\x03\x04"


def re2(pattern: str) -> str:
    """The pattern without possessive quantifiers."""
    return pattern.replace("++", "+").replace("*+", "*")


# --- transliteration: rule plus fixed exceptions --------------------------------------
# fixed values: characters that become several ASCII characters
MULTI_ASCII = {
    "ß": "ss", "Æ": "AE", "æ": "ae", "Œ": "OE", "œ": "oe", "Þ": "Th", "þ": "th",
    "Ĳ": "IJ", "ĳ": "ij", "«": "<<", "»": ">>", "©": "(c)", "®": "(r)", "™": "(tm)",
    "…": "...", "€": "EUR", "£": "PS", "§": "SS", "°": "deg", "±": "+-", "—": "--",
    "¼": "1/4", "½": "1/2", "¾": "3/4", "¢": "C/", "¥": "Y=",
}
# fixed values: characters that become one ASCII character
SINGLE_ASCII = {
    "Ø": "O", "ø": "o", "Đ": "D", "đ": "d", "Ð": "D", "ð": "d", "Ł": "L", "ł": "l",
    "ı": "i", "‘": "'", "’": "'", "‚": ",", "“": '"', "”": '"', "–": "-", "‐": "-",
    "•": "*", "·": "*", "×": "x", "÷": "/", "¡": "!", "¿": "?", "´": "'", "¨": '"',
    "¦": "|", "¬": "!", "¯": "-", "µ": "u", "¶": "P", "¸": ",",
}


def _single_ascii() -> dict[str, str]:
    """Latin letters and signs whose compatibility decomposition is one ASCII character."""
    table = dict(SINGLE_ASCII)
    blocks = (range(0xA0, 0x250), range(0x1E00, 0x1F00), range(0x2000, 0x200B), range(0xFF01, 0xFF5F))
    for point in (p for block in blocks for p in block):
        char = chr(point)
        base = "".join(c for c in unicodedata.normalize("NFKD", char) if not unicodedata.combining(c))
        if len(base) == 1 and base.isascii() and char not in MULTI_ASCII:
            table.setdefault(char, base)
    return table


TRANSLATE_TABLE = _single_ascii()
TRANSLATE_FROM = "".join(TRANSLATE_TABLE)
TRANSLATE_TO = "".join(TRANSLATE_TABLE.values())
ENTITY_CHARS = {name: chr(point) for name, point in sorted(name2codepoint.items())}
ENTITY_CHARS |= {name: char for name, char in sorted(html5.items()) if name[-1] != ";"}

# --- fixed values: dotted abbreviations of the ten lists ------------------------------
ABBREVIATIONS = [
    "Bcc.", "A.A.", "P.T.T.", "tel.", "adm.", "afd.", "ak.", "alg.", "apk.", "aps.",
    "bc.", "bijl.", "cat.", "centr.", "c.i.", "c.l.", "dg.", "dir.", "dra.", "drs.",
    "Dr.", "ds.", "G.G.", "ing.", "ir.", "lab.", "lic.", "mr.", "O.L.S.", "penn.",
    "Pres.", "prof.", "prof.em.", "red.", "r.s.g.", "Secr.", "n.o.s.", "Concen.",
    "A.I.D.", "B.B.C.", "B.S.", "B.W.", "G.A.B.", "G.S.", "H.K.H.", "H.M.", "intern.",
    "K.B.", "K.M.", "Kon.", "K.v.K.", "min.", "N.Br.", "N.H.", "prov.", "U.S.A.",
    "Z.K.H.", "Z.M.", "tab.", "W.A.", "W.Kh.", "adv.", "art.", "geb.", "jo.",
    "Lurisnr.", "subs.", "u.o.s.", "u.v.v.",
]

# Function words per language for the language vote.  The vote needs words that set the
# languages apart, so a handful of frequent ones each is enough.
FUNCTION_WORDS = {
    "nl": ["de", "het", "een", "en", "van", "ik", "te", "dat", "niet", "zijn", "voor", "met", "op",
           "aan", "er", "maar", "om", "ook", "bij", "naar", "uit", "wij", "ons", "onze", "deze"],
    "en": ["the", "and", "of", "to", "a", "in", "is", "that", "it", "for", "was", "with", "as",
           "are", "this", "be", "by", "from", "at", "which", "we", "our", "you", "your", "have"],
    "de": ["der", "die", "und", "das", "den", "von", "zu", "mit", "sich", "des", "auf", "ist", "im",
           "dem", "nicht", "ein", "eine", "als", "auch", "es", "wir", "uns", "für", "sie", "ich"],
    "fr": ["le", "la", "les", "des", "et", "un", "une", "du", "est", "que", "dans", "qui", "pour",
           "pas", "sur", "au", "avec", "ce", "il", "par", "nous", "vous", "notre", "votre", "aux"],
    "es": ["el", "los", "las", "y", "que", "en", "un", "una", "del", "se", "por", "con", "para",
           "es", "al", "lo", "como", "su", "más", "nos", "sus", "pero", "este", "esta", "nuestra"],
}

# --- fixed values: decision rules and settings ----------------------------------------
CLASS_NAMES = {0: "NINN", 1: "INN"}
HIGH_PROBABILITY = 0.75
LOW_PROBABILITY = 0.35
COMPANY_THRESHOLDS = (0.5, 0.55, 0.6)
BEST_THRESHOLD = 0.55
TEST_SHARE = 0.2
SEED = 42
CLUSTERS_PER_BUCKET = {"correct_high": 20, "wrong_high": 10, "correct_low": 20, "wrong_low": 10, "middle": 20}
CLUSTER_REPEATS = 10
REVIEW_ROWS = 50
HISTOGRAM_BINS = 100
MIN_DOCUMENT_FREQUENCY = 100
WORD_VECTOR_SIZE = 200
WORD_VECTOR_PASSES = 5
WORD_VECTOR_PARTS = 8
REGISTER_SAMPLE = 20_000
EMBEDDING_SIZE = 768
ENCODE_BATCH = 10_000
SEARCH_GRID = {
    "n_estimators": [100, 200, 300, 400, 500, 600, 700, 800, 900, 1000],
    "max_features": ["sqrt", 80, 160, 240],
    "max_depth": [100, 200, 300, 400, 500, 600, 700, 800, 900, 1000, None],
    "min_samples_split": [2, 5, 10, 100],
}
# Spark's trees stop at this depth: "no limit" and all depths above mean it
TREE_DEPTH = 30
SEARCH_DRAWS = 50
SEARCH_FOLDS = 5
# ----------------------------------------------------------------------------------
