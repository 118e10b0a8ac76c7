"""The predicate algebra of page search.

A page has three token arrays over the same positions (``surface lemma root``)
and a copy of each as one string, ``surface_j`` and so on, with a space before,
between and after the tokens. Every node gives ``matches()``, a condition on the
strings that stays inside whole-stage codegen, and ``positions()``, the sorted
token positions to highlight, by array functions that run on the few pages of a
result only. Nodes are local to a row, so they serve batch and stream alike.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from quarry.functions import arabic
from quarry.functions.arabic import SURFACE

#: Beyond this distance a pattern over the words between would recurse too deep.
PATTERN_REACH = 100

_META = re.compile(r"([.+*?^$()\[\]{}|\\])")


def escape(text: str) -> str:
    """For Java regular expressions."""
    return _META.sub(r"\\\1", text)


def _none() -> Column:
    return F.array().cast("array<int>")


def _union(arrays: list[Column]) -> Column:
    return F.array_sort(F.array_distinct(F.concat(*arrays))) if arrays else _none()


def _any(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False)) if not conditions else reduce(lambda a, b: a | b, conditions)


class Node:
    def matches(self) -> Column:
        raise NotImplementedError

    def positions(self) -> Column:
        raise NotImplementedError

    def label(self) -> str:
        raise NotImplementedError

    def streams(self) -> set[str]:
        """Which token streams it reads."""
        raise NotImplementedError


@dataclass(frozen=True)
class Nothing(Node):
    def matches(self) -> Column:
        return F.lit(False)

    def positions(self) -> Column:
        return _none()

    def label(self) -> str:
        return ""

    def streams(self) -> set[str]:
        return set()


@dataclass(frozen=True)
class Slot:
    """What one word of a phrase must be: the whole token, or its start and end."""

    start: str
    end: str | None = None

    @property
    def exact(self) -> bool:
        return self.end is None

    def test(self, token: Column) -> Column:
        if self.exact:
            return token == self.start
        c = token.startswith(self.start)
        return c & token.endswith(self.end) & (F.length(token) >= len(self.start) + len(self.end)) if self.end else c


@dataclass(frozen=True)
class Phrase(Node):
    """Consecutive words; a single one is a term. At most one slot is a wildcard."""

    slots: tuple[Slot, ...]
    stream: str

    def matches(self) -> Column:
        joined, wild = F.col(f"{self.stream}_j"), [i for i, s in enumerate(self.slots) if not s.exact]
        if not wild:
            return joined.contains(" " + " ".join(s.start for s in self.slots) + " ")
        at = wild[0]
        head = " " + " ".join(s.start for s in self.slots[: at + 1])
        slot = self.slots[at]
        if at == len(self.slots) - 1 and not slot.end:
            return joined.contains(head)
        tail = "".join(" " + escape(s.start) for s in self.slots[at + 1 :])
        return joined.contains(head) & joined.rlike(escape(head) + r"\S*" + escape(slot.end) + tail + " ")

    def positions(self) -> Column:
        tokens, n = F.col(self.stream), len(self.slots)
        here = lambda p: reduce(lambda a, b: a & b, (s.test(F.get(tokens, p + i)) for i, s in enumerate(self.slots)))
        starts = F.filter(F.sequence(F.lit(0), F.size(tokens) - n), here)
        covered = starts if n == 1 else F.flatten(F.transform(starts, lambda p: F.sequence(p, p + (n - 1))))
        return F.when(F.size(tokens) >= n, F.array_sort(F.array_distinct(covered))).otherwise(_none())

    def streams(self) -> set[str]:
        return {self.stream}

    def label(self) -> str:
        return " ".join(s.start if s.exact else f"{s.start}*{s.end}" for s in self.slots)


@dataclass(frozen=True)
class And(Node):
    parts: tuple[Node, ...]

    def matches(self) -> Column:
        return reduce(lambda a, b: a & b, (p.matches() for p in self.parts)) if self.parts else F.lit(False)

    def positions(self) -> Column:
        return _union([p.positions() for p in self.parts])

    def streams(self) -> set[str]:
        return set().union(*(p.streams() for p in self.parts))

    def label(self) -> str:
        plain = [p.label() for p in self.parts if not isinstance(p, Or)]
        groups = [f"({p.label()})" for p in self.parts if isinstance(p, Or)]
        ands = " AND ".join(plain)
        return " AND ".join(([f"({ands})"] if groups and ands else [ands] if ands else []) + groups)


@dataclass(frozen=True)
class Or(Node):
    parts: tuple[Node, ...]

    def matches(self) -> Column:
        return _any([p.matches() for p in self.parts])

    def positions(self) -> Column:
        return _union([p.positions() for p in self.parts])

    def streams(self) -> set[str]:
        return set().union(*(p.streams() for p in self.parts))

    def label(self) -> str:
        return " OR ".join(p.label() for p in self.parts)


@dataclass(frozen=True)
class Near(Node):
    """A token of ``left`` and one of ``right`` at most ``distance`` apart.

    A side of several words must stand on the page as a phrase, but any of its
    words may be the near one.
    """

    left: Phrase
    right: Phrase
    distance: int

    def _spots(self, side: Phrase) -> Column:
        # The tokens are an argument, not a name inside the function: there they would be split again for each word.
        words = [s.start for s in side.slots]
        at = F.transform(F.col(side.stream), lambda token, p: F.when(token.isin(words), p).otherwise(-1))
        return F.coalesce(F.filter(at, lambda p: p >= 0), _none())

    def matches(self) -> Column:
        single = len(self.left.slots) == len(self.right.slots) == 1
        present = self.left.matches() & self.right.matches()
        if single and self.left.stream == self.right.stream and (self.distance <= PATTERN_REACH or self.left.slots == self.right.slots):
            a, b = self.left.slots[0].start, self.right.slots[0].start
            if a == b:
                return self.left.matches()
            if self.distance == 0:
                return F.lit(False)
            x, y, gap = escape(a), escape(b), rf" (?:\S+ ){{0,{self.distance - 1}}}"
            return present & F.col(f"{self.left.stream}_j").rlike(f" {x}{gap}{y} | {y}{gap}{x} ")
        # In the sorted positions of both sides the closest pair stands side by side: no pairs, and any distance costs the same.
        tag = lambda side, bit: F.transform(self._spots(side), lambda p: p * 2 + bit)
        both = F.array_sort(F.concat(tag(self.left, 0), tag(self.right, 1)))
        steps = lambda both: F.zip_with(F.slice(both, F.lit(1), F.greatest(F.size(both) - 1, F.lit(0))), F.slice(both, 2, F.size(both)), lambda x, y: (x % 2 != y % 2) & (F.shiftright(y, 1) - F.shiftright(x, 1) <= self.distance))
        return present & F.exists(F.array(both), lambda once: F.exists(steps(once), lambda near: near))

    def _reach(self, spots: Column) -> Column:
        return F.flatten(F.transform(spots, lambda p: F.sequence(p - self.distance, p + self.distance)))

    def positions(self) -> Column:
        l, r = self._spots(self.left), self._spots(self.right)
        if self.distance <= PATTERN_REACH:
            return F.array_sort(F.array_union(F.array_intersect(l, self._reach(r)), F.array_intersect(r, self._reach(l))))
        # Wide reaches hold most positions, so the search for one ends soon.
        close = lambda x, ys: F.filter(x, lambda p: F.exists(ys, lambda q: F.abs(p - q) <= self.distance))
        return F.array_sort(F.array_union(close(l, r), close(r, l)))

    def streams(self) -> set[str]:
        return self.left.streams() | self.right.streams()

    def label(self) -> str:
        return f"{self.left.label()} ~{self.distance} {self.right.label()}"


# How queries are shown, from the strings as they were typed.


def combined_label(and_terms: list[str], or_terms: list[str] = ()) -> str:
    ands, ors = " AND ".join(and_terms), " OR ".join(or_terms)
    return f"({ands}) AND ({ors})" if ands and ors else ands or ors


def near_label(left: str, right: str, distance: int) -> str:
    return f"{left} ~{distance} {right}"


def names_label(forms: list[list[str]]) -> str:
    """The first pattern of each form."""
    return " AND ".join(f[0] for f in forms if f)


def tab_label(and_terms: list[str], or_terms: list[str] = ()) -> str:
    """Two terms at most, for the title of a tab."""
    ands, ors = ([t for t in ts if t.strip()] for ts in (and_terms, or_terms))
    if ands:
        return " AND ".join((ands + ors[: 2 - len(ands)] if len(ands) < 2 else ands)[:2])
    return " OR ".join(ors[:2]) or "Search"


def full_label(and_terms: list[str], or_terms: list[str] = ()) -> str:
    parts = [f"{name}: {', '.join(ts)}" for name, ts in (("AND", and_terms), ("OR", or_terms)) if ts]
    return " | ".join(parts) or "Search"


def name_tab_label(form) -> str:  # noqa: ANN001
    """Of a name form: its first kunya, the lineage and the first nisba, in 40 characters."""
    first = lambda xs: next((x.strip() for x in xs if x.strip()), "")
    text = " ".join(x for x in (first(form.kunyas), form.nasab.strip(), first(form.nisbas)) if x) or "Name Search"
    return text[:37] + "..." if len(text) > 40 else text


# From query strings to nodes.


def term(query: str, mode: str = arabic.LEMMA) -> Node:
    """A word, or a phrase of several, in one stream; punctuation doesn't count."""
    words = arabic.for_mode(arabic.clean_query(query), mode).split()
    return Phrase(tuple(map(Slot, words)), mode) if words else Nothing()


def combined(and_terms: list[tuple[str, str]], or_terms: list[tuple[str, str]] = ()) -> Node:
    """All of the first and, where there are some, one of the second."""
    # A term that comes twice is looked for once.
    ands, ors = (list(dict.fromkeys(n for n in (term(*t) for t in ts) if not isinstance(n, Nothing))) for ts in (and_terms, or_terms))
    parts = [*ands, *([Or(tuple(ors)) if len(ors) > 1 else ors[0]] if ors else [])]
    return Nothing() if not parts else parts[0] if len(parts) == 1 else And(tuple(parts))


def with_clitics(and_terms: list[tuple[str, str, bool]], or_terms: list[tuple[str, str, bool]] = (), compat: bool = False) -> Node:
    """Terms with a flag to take proclitics too. ``compat`` moves the variants of all of them into the one OR group."""

    def variants(q: str, mode: str, on: bool) -> list[tuple[str, str]]:
        clean = arabic.clean_query(q)
        return [(v, mode) for v in (arabic.with_clitics(clean) if on and mode == SURFACE else [clean])]

    loose = [v for t in or_terms for v in variants(*t)]
    fixed = [t for t in and_terms if not (t[2] and t[1] == SURFACE)]
    toggled = [t for t in and_terms if t[2] and t[1] == SURFACE]
    if compat:
        return combined([(arabic.clean_query(q), m) for q, m, _ in fixed], [v for t in toggled for v in variants(*t)] + loose)
    groups = [Or(tuple(term(*v) for v in variants(*t))) for t in toggled]
    rest = combined([(q, m) for q, m, _ in fixed], loose)
    parts = [*groups, *([] if isinstance(rest, Nothing) else [rest])]
    return Nothing() if not parts else parts[0] if len(parts) == 1 else And(tuple(parts))


def near(left: tuple[str, str], right: tuple[str, str], distance: int) -> Node:
    a, b = term(*left), term(*right)
    return Nothing() if Nothing() in (a, b) else Near(a, b, distance)


def check_wildcard(query: str, mode: str = SURFACE) -> None:
    text = query.strip()
    if "*" not in text:
        return
    if mode != SURFACE:
        raise ValueError("Wildcards only supported in Surface mode")
    if text.count("*") > 1:
        raise ValueError("Only one wildcard (*) allowed per search term")
    word = next(w for w in text.split() if "*" in w)
    at = word.index("*")
    if at == 0:
        raise ValueError("Wildcard cannot be at start of word")
    if at < len(word) - 1 and arabic.letters(word[:at]) < 2:
        raise ValueError("Internal wildcard requires at least 2 characters before it")


def wildcard(query: str, mode: str = SURFACE) -> Node:
    """A word or phrase with one ``*`` at the end of or inside a word."""
    check_wildcard(query, mode)
    text = arabic.clean_query(query, keep_star=True)
    if "*" not in text:
        return term(text, mode)
    slots = []
    for w in arabic.fold(text).split():
        start, star, end = w.partition("*")
        slots.append(Slot(start, end) if star else Slot(w))
    return Phrase(tuple(slots), SURFACE)


def wildcard_terms(query: str) -> Node:
    """The words in any order anywhere on the page, one of them with a wildcard."""
    node = wildcard(query)
    return And(tuple(Phrase((s,), node.stream) for s in node.slots)) if isinstance(node, Phrase) else node


def names(forms: list[list[str]]) -> Node:
    """Every form of which some pattern stands on the page; blank patterns and forms don't count."""
    groups = [[term(p, SURFACE) for p in form if p.strip()] for form in forms]
    parts = [Or(tuple(g)) for g in groups if g]
    return Nothing() if not parts else parts[0] if len(parts) == 1 else And(tuple(parts))
