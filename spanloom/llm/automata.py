"""Regular expressions over bytes, compiled together into one minimal deterministic automaton.

Patterns know bytes of ASCII, ``\\xHH``, escaped signs, classes with ranges, groups, ``|``, ``?``, ``*``, ``+``
and ``{n}``, ``{n,}``, ``{n,m}``.  A class that begins with ``^`` holds the other bytes of ASCII.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

MAX_STATES = 1 << 16  # more than rules of sane size need; compiling stops with an error beyond
_ASCII = (1 << 128) - 1

Node = tuple  # ("set", mask) | ("seq", nodes) | ("alt", nodes) | ("rep", node, least, most or None)


class _Reader:
    """Recursive descent over one pattern."""

    def __init__(self, pattern: str, any_case: bool):
        self.rest, self.any_case = list(reversed(pattern)), any_case

    def peek(self) -> str:
        return self.rest[-1] if self.rest else ""

    def take(self, wanted: str = "") -> str:
        if not self.rest or (wanted and self.rest[-1] != wanted):
            raise ValueError(f"pattern: expected {wanted or 'a character'} before {''.join(reversed(self.rest))!r}")
        return self.rest.pop()

    def alternatives(self) -> Node:
        branches = [self.sequence()]
        while self.peek() == "|":
            self.take()
            branches.append(self.sequence())
        return branches[0] if len(branches) == 1 else ("alt", branches)

    def sequence(self) -> Node:
        parts = []
        while self.peek() not in ("", "|", ")"):
            parts.append(self.repeated(self.atom()))
        return ("seq", parts)

    def repeated(self, node: Node) -> Node:
        while self.peek() and self.peek() in "?*+{":
            sign = self.take()
            if sign == "{":
                text = ""
                while self.peek() != "}":
                    text += self.take()
                self.take("}")
                low, comma, high = text.partition(",")
                node = ("rep", node, int(low), int(high) if high else None if comma else int(low))
            else:
                node = ("rep", node, int(sign == "+"), 1 if sign == "?" else None)
        return node

    def atom(self) -> Node:
        sign = self.take()
        if sign == "(":
            node = self.alternatives()
            self.take(")")
            return node
        if sign == "[":
            return ("set", self.cased(self.members()))
        if sign == ".":
            raise ValueError("pattern: write a class instead of a dot")
        return ("set", self.cased(1 << self.code(sign)))

    def code(self, sign: str) -> int:
        if sign == "\\":
            sign = self.take()
            if sign == "x":
                return int(self.take() + self.take(), 16)
            if sign.isalnum():
                raise ValueError(f"pattern: unknown escape \\{sign}")
        if ord(sign) > 127:
            raise ValueError("pattern: only ASCII")
        return ord(sign)

    def members(self) -> int:
        other = self.peek() == "^" and bool(self.take())
        mask, first = 0, True
        while first or self.peek() != "]":
            first = False
            low = high = self.code(self.take())
            if self.peek() == "-" and len(self.rest) > 1 and self.rest[-2] != "]":
                self.take()
                high = self.code(self.take())
            mask |= (1 << high + 1) - (1 << low)
        self.take("]")
        return _ASCII & ~mask if other else mask

    def cased(self, mask: int) -> int:
        if self.any_case:
            for upper in range(65, 91):
                pair = 1 << upper | 1 << upper + 32
                if mask & pair:
                    mask |= pair
        return mask


def parse(pattern: str, any_case: bool = False) -> Node:
    """The tree of a pattern; ``any_case`` lets every letter stand for both cases."""
    reader = _Reader(pattern, any_case)
    node = reader.alternatives()
    if reader.rest:
        raise ValueError("pattern: unbalanced bracket")
    return node


class _Graph:
    """States with empty moves and moves by byte sets."""

    def __init__(self, backward: bool):
        self.backward = backward
        self.empty: list[list[int]] = []
        self.moves: list[list[tuple[int, int]]] = []

    def state(self) -> int:
        self.empty.append([])
        self.moves.append([])
        return len(self.empty) - 1

    def add(self, node: Node, at: int) -> int:
        """Grow ``node`` from state ``at``; the state after it."""
        kind = node[0]
        if kind == "set":
            end = self.state()
            self.moves[at].append((node[1], end))
            return end
        if kind == "seq":
            for part in reversed(node[1]) if self.backward else node[1]:
                at = self.add(part, at)
            return at
        if kind == "alt":
            end = self.state()
            for part in node[1]:
                begin = self.state()
                self.empty[at].append(begin)
                self.empty[self.add(part, begin)].append(end)
            return end
        _, part, least, most = node
        for _ in range(least):
            at = self.add(part, at)
        end = self.state()
        if most is None:
            loop = self.state()
            self.empty[at].append(loop)
            self.empty[self.add(part, loop)].append(loop)
            self.empty[loop].append(end)
        else:
            self.empty[at].append(end)
            for _ in range(most - least):
                at = self.add(part, at)
                self.empty[at].append(end)
        return end

    def closure(self, states: set[int]) -> frozenset[int]:
        todo, seen = list(states), set(states)
        while todo:
            for other in self.empty[todo.pop()]:
                if other not in seen:
                    seen.add(other)
                    todo.append(other)
        return frozenset(seen)


@dataclass(frozen=True)
class Automaton:
    """State 0 is the first.  ``accepts`` has a bit per rule; states from ``first_accepting`` on have one set."""

    classes: np.ndarray  # uint8[256]: the column of a byte
    table: np.ndarray  # int32[states, columns]
    accepts: np.ndarray  # int64[states]
    first_accepting: int

    def longest(self, data: bytes, at: int) -> int:
        """The end of the longest match that begins at ``at``; -1 without one.  For anchored automata."""
        rows, classes, accepting, end, state = self.rows, self.class_bytes, self.first_accepting, -1, 0
        for place in range(at, len(data)):
            state = rows[state][classes[data[place]]]
            if state < 0:
                break
            if state >= accepting:
                end = place + 1
        return end

    def __post_init__(self) -> None:
        object.__setattr__(self, "rows", self.table.tolist())
        object.__setattr__(self, "class_bytes", self.classes.tobytes())


def build(trees: list[Node], backward: bool = False, anywhere: bool = False) -> Automaton:
    """One automaton for all ``trees`` (62 at most), by subset construction, then minimised.

    ``backward`` reads matches from their last byte to their first.  ``anywhere`` lets a match begin at
    every byte; without it the automaton is anchored, and -1 in its table means that nothing can follow.
    """
    graph = _Graph(backward)
    origin = graph.state()
    final: dict[int, int] = {}
    for rule, tree in enumerate(trees):
        begin = graph.state()
        graph.empty[origin].append(begin)
        final[graph.add(tree, begin)] = 1 << rule

    masks = sorted({mask for moves in graph.moves for mask, _ in moves})
    kinds: dict[tuple[int, ...], int] = {}
    classes = np.array([kinds.setdefault(tuple(m >> byte & 1 for m in masks), len(kinds)) for byte in range(256)], np.uint8)
    sample = {int(c): int(b) for b, c in enumerate(classes)}

    start = graph.closure({origin})
    names, todo, table = {start: 0}, [start], []
    while todo:
        members = todo.pop(0)
        row = []
        for column in range(len(kinds)):
            reached = {to for s in members for mask, to in graph.moves[s] if mask >> sample[column] & 1}
            after = graph.closure(reached) | (start if anywhere else frozenset())
            if not after:
                row.append(-1)
                continue
            if after not in names:
                if len(names) == MAX_STATES:
                    raise ValueError(f"the rules need more than {MAX_STATES} states")
                names[after] = len(names)
                todo.append(after)
            row.append(names[after])
        table.append(row)
    accepts = np.array([sum({final[s] for s in members if s in final}) for members in names], np.int64)
    return _minimised(classes, np.array(table, np.int32), accepts)


def _minimised(classes: np.ndarray, table: np.ndarray, accepts: np.ndarray) -> Automaton:
    """Merge states that no continuation tells apart, by refining the partition until it is stable."""
    _, group = np.unique(accepts, return_inverse=True)
    count = 0
    while group.max() + 1 > count:
        count = group.max() + 1
        follow = np.where(table >= 0, group[table], -1)
        _, group = np.unique(np.column_stack([group, follow]), axis=0, return_inverse=True)
    _, first = np.unique(group, return_index=True)  # one state of each group
    rank = np.lexsort((first, first != first[group[0]], accepts[first] != 0))
    place = np.empty(len(first), np.int64)
    place[rank] = np.arange(len(first))
    new = place[group]
    kept = first[rank]
    smaller = np.where(table[kept] >= 0, new[table[kept]], -1).astype(np.int32)
    return Automaton(classes, smaller, accepts[kept], int((accepts[kept] == 0).sum()))
