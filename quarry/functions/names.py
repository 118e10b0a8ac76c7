"""Search patterns for personal names: kunya, nasab, nisba and shuhra."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from itertools import chain

from quarry.functions.arabic import CLITICS

_FOLD = str.maketrans("أإآ", "ااا", "".join(map(chr, range(0x064B, 0x0660))))
_KUNYA = re.compile(r"^(?:ابو|ابا|ابي)\s+(.+)")


@dataclass
class NameForm:
    kunyas: list[str] = field(default_factory=list)
    nasab: str = ""
    nisbas: list[str] = field(default_factory=list)
    shuhra: str = ""
    allow_rare_kunya_nisba: bool = False
    allow_kunya_nasab: bool = False
    allow_one_nasab: bool = False
    allow_one_nasab_nisba: bool = False
    allow_two_nasab: bool = False


def plain(text: str) -> str:
    return text.translate(_FOLD).strip()


def nasab_parts(nasab: str) -> tuple[list[str], str]:
    """The names of a lineage, and the word that links them."""
    text = plain(nasab)
    return [x for x in re.split(r"\s+(?:بن|بنت)\s+", text) if x], "بنت" if "بنت" in text else "بن"


def kunya_variants(kunya: str) -> list[str]:
    text = plain(kunya)
    m = _KUNYA.match(text)
    return [f"{k} {m[1]}" for k in ("ابو", "ابا", "ابي")] if m else [text]


def proclitic_variants(pattern: str) -> list[str]:
    return [pattern, *(c + " ".join(pattern.split()) for c in CLITICS)]


def _filled(form: NameForm) -> tuple[list[str], list[str], str, list[str], str]:
    parts, link = nasab_parts(form.nasab)
    kunyas = list(chain.from_iterable(kunya_variants(k) for k in form.kunyas if k.strip()))
    return kunyas, parts[:3], link, [plain(n) for n in form.nisbas if n.strip()], plain(form.shuhra)


def patterns(form: NameForm) -> list[str]:
    """All forms under which the name may stand, in the order of generation, without repeats."""
    kunyas, parts, link, nisbas, shuhra = _filled(form)
    chain_of = lambda names: f" {link} ".join(names)
    out: dict[str, None] = {}

    def add(*pieces: str) -> None:
        text = plain(" ".join(pieces))
        if text:
            out[text] = None

    def add_with_nisbas(*pieces: str) -> None:
        add(*pieces)
        for n in nisbas:
            add(*pieces, n)

    two = len(parts) >= 2
    for k in kunyas if two else ():
        for depth in range(2, len(parts) + 1):
            add_with_nisbas(k, chain_of(parts[:depth]))
        for n in nisbas:
            add(k, parts[0], n)
        for depth in range(2, len(parts) + 1):
            add_with_nisbas(k, link, chain_of(parts[1:depth]))
    if len(parts) == 3:
        add_with_nisbas(chain_of(parts))
    for n in nisbas if two else ():
        add(chain_of(parts[:2]), n)
    if form.allow_rare_kunya_nisba:
        for k in kunyas:
            for n in nisbas:
                add(k, n)
    if form.allow_kunya_nasab and parts:
        for k in kunyas:
            add_with_nisbas(k, parts[0])
    if form.allow_one_nasab and parts:
        add(parts[0])
    if form.allow_one_nasab_nisba and parts:
        for n in nisbas:
            add(parts[0], n)
    if form.allow_two_nasab and two:
        add(chain_of(parts[:2]))
    if shuhra:
        m = _KUNYA.match(shuhra)
        for known in ("المعروف", "المشهور"):
            add(f"{known} بابي {m[1]}" if m else f"{known} ب{shuhra}")
    return list(out)


def search_patterns(form: NameForm) -> list[str]:
    return list(dict.fromkeys(chain.from_iterable(map(proclitic_variants, patterns(form)))))


def display_patterns(form: NameForm) -> list[str]:
    return list(dict.fromkeys(re.sub(r"^(?:ابو|ابا|ابي)\s", "اب* ", p) for p in patterns(form)))


def is_valid(form: NameForm) -> bool:
    kunyas, parts, _, nisbas, shuhra = _filled(form)
    if shuhra or sum(map(bool, (kunyas, parts, nisbas))) >= 2:
        return True
    return bool(parts) and (form.allow_one_nasab or (len(parts) >= 2 and form.allow_two_nasab))
