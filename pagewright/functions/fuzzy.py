"""Approximate pattern search: all cheapest matches by where they end.

A pattern is compiled to the set of its character positions, with the positions that can follow each (Glushkov's
construction), so that there are no empty moves. The search keeps, for each position reached, the cheapest way to it and
of equally cheap ones the leftmost start. Literals, ``.``, classes, ``\\d \\s \\w \\p{..}``, groups, alternatives and
quantifiers are understood; anchors, look-around, word boundaries, references and named groups are refused.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from math import inf

import regex

TOKENS = regex.compile(r"\\[pP]\{[^}]*\}|\\.|\[\^?\]?(?:\\.|[^\]\\])*\]|\(\?:|\(\?|\{\d+(?:,\d*)?\}|[\s\S]")
# What the short classes stand for.
CLASSES = {r"\d": "[0-9]", r"\D": "[^0-9]", r"\w": "[A-Za-z0-9_]", r"\W": "[^A-Za-z0-9_]", ".": r"[^\n\r]"}


@dataclass(frozen=True)
class Match:
    start: int
    end: int
    cost: float
    edits: tuple[tuple[str, int], ...] = ()


class _Reader:
    """Reads a pattern into nested tuples: ('one', class), ('all', parts), ('any', parts), ('times', part, least, most)."""

    def __init__(self, source: str):
        self.tokens = TOKENS.findall(source)
        self.at = 0

    def peek(self) -> str | None:
        return self.tokens[self.at] if self.at < len(self.tokens) else None

    def take(self) -> str:
        self.at += 1
        return self.tokens[self.at - 1]

    def choice(self):
        parts = [self.sequence()]
        while self.peek() == "|":
            self.take()
            parts.append(self.sequence())
        return parts[0] if len(parts) == 1 else ("any", parts)

    def sequence(self):
        parts = []
        while self.peek() not in (None, "|", ")"):
            part = self.atom()
            while (t := self.peek()) is not None and (t in "?*+" or regex.fullmatch(r"\{\d+(?:,\d*)?\}", t)):
                self.take()
                if t in "?*+":
                    least, most = {"?": (0, 1), "*": (0, inf), "+": (1, inf)}[t]
                else:
                    low, comma, high = t[1:-1].partition(",")
                    least, most = int(low), (int(high) if high else inf) if comma else int(low)
                    if most < least:
                        raise ValueError("Quantifier range out of order")
                if self.peek() == "?":  # laziness changes nothing where all matches are reported
                    self.take()
                part = ("times", part, least, most)
            parts.append(part)
        return ("all", parts)

    def atom(self):
        t = self.take()
        if t in ("(", "(?:"):
            inner = self.choice()
            if self.peek() != ")":
                raise ValueError("Unclosed group")
            self.take()
            return inner
        if t == "(?":
            raise ValueError("Lookarounds and named groups are not supported")
        if t in "^$":
            raise ValueError("Anchors are not supported; use can_start and can_end")
        if t in "*+?":
            raise ValueError("Nothing to repeat")
        if t == "[":
            raise ValueError("Unclosed character class")
        if t in (r"\b", r"\B"):
            raise ValueError("Word boundaries are not supported; use can_start and can_end")
        if t == "\\":
            raise ValueError("Trailing backslash")
        if regex.fullmatch(r"\\[1-9]", t):
            raise ValueError("Back-references are not supported")
        if t in CLASSES:
            return ("one", CLASSES[t])
        if t.startswith("["):
            for short, long in CLASSES.items():
                if short.startswith("\\") and not long.startswith("[^"):
                    t = t.replace(short, long[1:-1])
            return ("one", t)
        return ("one", t if t.startswith("\\") else regex.escape(t))


class FuzzyPattern:
    """A compiled pattern. ``flags``: any of i, g, u; matching is always global and by code points."""

    def __init__(self, source: str, flags: str = ""):
        if set(flags) - set("igu"):
            raise ValueError(f"Unsupported flag in {flags!r}")
        reader = _Reader(source)
        tree = reader.choice()
        if reader.peek() is not None:
            raise ValueError(f"Unexpected {reader.peek()!r}")
        self.classes: list[regex.Pattern] = []
        self.follow: list[set[int]] = []
        self._flags = regex.IGNORECASE if "i" in flags else 0
        self.nullable, first, last = self._build(tree)
        self.first, self.last = frozenset(first), frozenset(last)
        self.next = [frozenset(f) for f in self.follow]
        self._known: dict[str, frozenset[int]] = {}

    def _build(self, tree) -> tuple[bool, set[int], set[int]]:
        kind = tree[0]
        if kind == "one":
            p = len(self.classes)
            self.classes.append(regex.compile(tree[1], self._flags))
            self.follow.append(set())
            return False, {p}, {p}
        if kind == "any":
            built = [self._build(t) for t in tree[1]]
            return any(b[0] for b in built), set().union(*(b[1] for b in built)), set().union(*(b[2] for b in built))
        if kind == "all":
            return self._chain([self._build(t) for t in tree[1]])
        _, part, least, most = tree
        copies = []
        for i in range(max(least, 1) if most == inf else most):
            empty, first, last = self._build(part)
            copies.append((empty or i >= least, first, last))
        if most == inf and copies:
            for p in copies[-1][2]:
                self.follow[p] |= copies[-1][1]
        return self._chain(copies)

    def _chain(self, parts) -> tuple[bool, set[int], set[int]]:
        empty, first, last = True, set(), set()
        for e, f, l_ in parts:
            for p in last:
                self.follow[p] |= f
            first = first | f if empty else first
            last = last | l_ if e else set(l_)
            empty = empty and e
        return empty, first, last

    def accepts(self, c: str) -> frozenset[int]:
        """The positions that the character can take."""
        found = self._known.get(c)
        if found is None:
            found = self._known[c] = frozenset(p for p, k in enumerate(self.classes) if k.fullmatch(c))
        return found

    def search(self, text: str, max_cost: float = 0, insert=1.0, substitute=1.0, delete=1.0, can_start: Callable[[int], bool] | None = None, can_end: Callable[[int], bool] | None = None, begin: int = 0, stop: int | None = None) -> list[Match]:
        """For each place a match can end, the cheapest; edit costs are numbers or functions of a character."""
        stop = len(text) if stop is None else stop
        price = lambda cost, c: cost(c) if callable(cost) else cost
        out: list[Match] = []
        # (position, whether junk came after it) -> cost, start, edits; position -1 is before the first
        now: dict[tuple[int, bool], tuple[float, int, tuple]] = {}
        for i in range(begin, stop + 1):
            if can_start is None or can_start(i):
                _offer(now, (-1, False), 0.0, i, (), max_cost)
            if not now:
                continue
            if delete <= max_cost:
                work = list(now)
                while work:
                    state = work.pop()
                    cost, start, edits = now[state]
                    for q in self.first if state[0] < 0 else self.next[state[0]]:
                        if _offer(now, (q, False), cost + delete, start, (*edits, ("delete", i)), max_cost):
                            work.append((q, False))
            ends = [v for (p, junk), v in now.items() if not junk and v[1] < i and (p in self.last or (p < 0 and self.nullable))]
            if ends and (can_end is None or can_end(i)):
                cost, start, edits = min(ends, key=lambda v: v[:2])
                out.append(Match(start, i, cost, edits))
            if i >= stop:
                break
            c = text[i]
            fits = self.accepts(c)
            stray = price(insert, c) if max_cost else inf
            swap = price(substitute, c) if max_cost else inf
            then: dict[tuple[int, bool], tuple[float, int, tuple]] = {}
            for (p, _), (cost, start, edits) in now.items():
                after = self.first if p < 0 else self.next[p]
                for q in after & fits:
                    _offer(then, (q, False), cost, start, edits, max_cost)
                if cost + swap <= max_cost:
                    for q in after - fits:
                        _offer(then, (q, False), cost + swap, start, (*edits, ("substitute", i)), max_cost)
                if after and cost + stray <= max_cost:
                    _offer(then, (p, True), cost + stray, start, (*edits, ("insert", i)), max_cost)
            now = then
        return out

    def match_all(self, text: str, max_cost: float = 0, **options) -> list[Match]:
        """Matches that don't overlap: cheap before dear, then left, then long."""
        kept: list[Match] = []
        for m in sorted(self.search(text, max_cost, **options), key=lambda m: (m.cost, m.start, m.start - m.end)):
            if not any(m.start < k.end and k.start < m.end for k in kept):
                kept.append(m)
        return sorted(kept, key=lambda m: m.start)


def _offer(states: dict, state, cost: float, start: int, edits: tuple, most: float) -> bool:
    old = states.get(state)
    if cost > most or (old is not None and (cost, start) >= old[:2]):
        return False
    states[state] = (cost, start, edits)
    return True
