"""Normalisation of Arabic script, for query strings (Python) and columns (built-in expressions)."""

from __future__ import annotations

import re
import string

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Letters that fold onto others, then the marks that are deleted (alef wasla among them).
FOLD_FROM = "أإآؤئىکگڭیےۀەۃٹپچژڤڨ"
FOLD_TO = "اااوييكككييههةتبجزفق"
MARKS = "".join(map(chr, range(0x064B, 0x0660))) + "ٰٱ"
_TABLE = str.maketrans(FOLD_FROM, FOLD_TO, MARKS)

WEAK = "وياء"
CLITICS = ("و", "ف", "ب", "ل", "ك")
SURFACE, LEMMA, ROOT = "surface", "lemma", "root"
MODES = (SURFACE, LEMMA, ROOT)

#: ASCII signs but the star, and the others by code point.
_QUERY_PUNCTUATION = string.punctuation.replace("*", "") + "¨«¬°´·¸»،؛؟٪٫٬۔–—‘’“”•…‹›、。〈〉《》「」『』【】〔〕"


def fold(text: str) -> str:
    return text.translate(_TABLE)


def fold_column(c: Column) -> Column:
    """One translate: characters beyond the targets are deleted."""
    return F.translate(c, FOLD_FROM + MARKS, FOLD_TO)


def root_form(text: str) -> str:
    """Words as dotted letters, the weak ones as #."""
    return " ".join(".".join("#" if ch in WEAK else ch for ch in word) for word in fold(text).split())


def root_form_column(c: Column) -> Column:
    weak = F.translate(F.trim(F.regexp_replace(fold_column(c), r"\s+", " ")), WEAK, "####")
    return F.regexp_replace(weak, r"(\S)(?=\S)", "$1.")


def for_mode(text: str, mode: str) -> str:
    if mode not in MODES:
        raise ValueError(f"unknown mode {mode!r}")
    return {SURFACE: fold, LEMMA: str, ROOT: root_form}[mode](text)


def letters(text: str) -> int:
    return sum(0x0621 <= ord(ch) <= 0x064A or 0x0671 <= ord(ch) <= 0x06D3 for ch in text)


def letters_column(c: Column) -> Column:
    return F.length(F.regexp_replace(c, "[^ء-يٱ-ۓ]", ""))


def clean_query(text: str, keep_star: bool = False) -> str:
    """Without punctuation, single spaces. ``keep_star`` leaves the wildcard sign in."""
    drop = _QUERY_PUNCTUATION + ("" if keep_star else "*")
    return " ".join(text.translate(str.maketrans("", "", drop)).split())


def words(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(r"(\S+)"), F.lit(1))


def with_clitics(query: str) -> list[str]:
    """The query, and with each proclitic before its first word."""
    return [query, *(p + query for p in CLITICS)] if query else [query]


# Reader text: which characters belong to which token.

#: ASCII signs but a few, and the others by code point.
SKIP_SIGNS = "".join(c for c in string.punctuation if c not in '#$%&*+@^`|~') + "¡§©«®°±¶·»¿×÷،؍؛؟٫٬٭۔–—‘’“”†‡•…′″‴™∂∇∏∑√∞∫≠≤≥○●◦⦗⦘﴾﴿"
_SKIP = "[" + re.escape(SKIP_SIGNS).replace("&", r"\&") + "A-Za-zÀ-ɏḀ-ỿ0-9٠-٩۰-۹]"
_ARABIC = "[؀-ۿݐ-ݿࢠ-ࣿ]"
LETTERS = _ARABIC[1:-1]
#: A token with what precedes it, up to the end of its run of letters and signs.
CHUNK = f"[^{LETTERS}]*{_ARABIC}(?:{_ARABIC}|{_SKIP})*"
_SKIP_RE, _ARABIC_RE = re.compile(_SKIP), re.compile(_ARABIC)


def token_map(text: str) -> list[int | None]:
    """The token of each character; signs, Latin letters and digits lie inside words without belonging to them."""
    out: list[int | None] = []
    token, inside = 0, False
    for ch in text:
        if _SKIP_RE.match(ch):
            out.append(None)
        elif _ARABIC_RE.match(ch):
            out.append(token)
            inside = True
        else:
            out.append(None)
            token, inside = token + inside, False
    return out


def arabic_tokens(c: Column) -> Column:
    """The words that ``token_map`` counts, in order."""
    return F.regexp_extract_all(F.regexp_replace(c, _SKIP, ""), F.lit(f"({_ARABIC}+)"), F.lit(1))
