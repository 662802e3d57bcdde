"""Rules to one deterministic automaton: parse, subset construction, minimisation, transition arrays over bytes."""

from __future__ import annotations

import string

import numpy as np

# Nodes: ("set", frozenset of bytes) | ("cat", [...]) | ("or", [...]) | ("rep", node, least, most or None)


def parse(pattern: str, any_case: bool = False):
    """A regular expression of literals, classes, groups, ``|``, ``? * +``, ``{n}`` ``{n,}`` ``{n,m}`` and ``\\xHH``."""
    node, at = _either(pattern, 0, any_case)
    if at != len(pattern):
        raise ValueError(f"can't read {pattern!r} from {at}")
    return node


def _either(p: str, at: int, fold: bool):
    ways = []
    while True:
        items = []
        while at < len(p) and p[at] not in "|)":
            item, at = _atom(p, at, fold)
            while at < len(p) and p[at] in "?*+{":
                if p[at] == "{":
                    stop = p.index("}", at)
                    low, comma, high = p[at + 1 : stop].partition(",")
                    item, at = ("rep", item, int(low), int(high) if high else None if comma else int(low)), stop + 1
                else:
                    item, at = ("rep", item, int(p[at] == "+"), 1 if p[at] == "?" else None), at + 1
            items.append(item)
        ways.append(("cat", items))
        if at == len(p) or p[at] == ")":
            return (ways[0] if len(ways) == 1 else ("or", ways)), at
        at += 1


def _char(p: str, at: int) -> tuple[int, int]:
    if p[at] != "\\":
        return ord(p[at]), at + 1
    return (int(p[at + 2 : at + 4], 16), at + 4) if p[at + 1] == "x" else (ord(p[at + 1]), at + 2)


def _atom(p: str, at: int, fold: bool):
    if p[at] == "(":
        node, at = _either(p, at + 1, fold)
        return node, at + 1
    if p[at] != "[":
        byte, at = _char(p, at)
        return ("set", _folded({byte}, fold)), at
    found, at = set(), at + 1
    while p[at] != "]":
        low, at = _char(p, at)
        high = low
        if p[at] == "-" and p[at + 1] != "]":
            high, at = _char(p, at + 1)
        found.update(range(low, high + 1))
    return ("set", _folded(found, fold)), at + 1


def _folded(found: set[int], fold: bool) -> frozenset[int]:
    letters = {b for b in found if chr(b) in string.ascii_letters} if fold else set()
    return frozenset(found | {b ^ 0x20 for b in letters})


def reverse(node):
    if node[0] == "set":
        return node
    if node[0] == "rep":
        return ("rep", reverse(node[1]), *node[2:])
    parts = [reverse(x) for x in node[1]]
    return (node[0], parts[::-1] if node[0] == "cat" else parts)


class _Nfa:
    def __init__(self):
        self.free: list[set[int]] = []
        self.moves: list[list[tuple[frozenset[int], int]]] = []

    def new(self) -> int:
        self.free.append(set())
        self.moves.append([])
        return len(self.free) - 1

    def add(self, node, start: int) -> int:
        """The state reached from ``start`` after ``node``."""
        if node[0] == "set":
            end = self.new()
            self.moves[start].append((node[1], end))
            return end
        if node[0] == "cat":
            for x in node[1]:
                start = self.add(x, start)
            return start
        if node[0] == "or":
            end = self.new()
            for x in node[1]:
                first = self.new()
                self.free[start].add(first)
                self.free[self.add(x, first)].add(end)
            return end
        _, x, least, most = node
        for _ in range(least):
            start = self.add(x, start)
        if most is None:
            loop = self.new()
            self.free[start].add(loop)
            self.free[self.add(x, loop)].add(loop)
            return loop
        end = self.new()
        self.free[start].add(end)
        for _ in range(most - least):
            start = self.add(x, start)
            self.free[start].add(end)
        return end


def compile_rules(nodes: list, anywhere: bool) -> tuple[np.ndarray, np.ndarray]:
    """The minimal automaton for all rules: next state by (state, byte), and for each state the rules, as bits, that
    accept there. State 0 is the start. ``anywhere``: a rule may start at any byte, else only at the first."""
    nfa = _Nfa()
    root = nfa.new()
    bit = {}
    for k, node in enumerate(nodes):
        first = nfa.new()
        nfa.free[root].add(first)
        bit[nfa.add(node, first)] = 1 << k
    sets = {m for moves in nfa.moves for m, _ in moves}
    kinds: dict[tuple, int] = {}  # bytes that no rule tells apart
    of_byte = np.array([kinds.setdefault(tuple(b in s for s in sets), len(kinds)) for b in range(256)])
    sample = [int(np.flatnonzero(of_byte == c)[0]) for c in range(len(kinds))]

    closures: dict[int, frozenset[int]] = {}

    def closure(state: int) -> frozenset[int]:
        if state not in closures:
            seen, todo = {state}, [state]
            while todo:
                for x in nfa.free[todo.pop()] - seen:
                    seen.add(x)
                    todo.append(x)
            closures[state] = frozenset(x for x in seen if nfa.moves[x] or x in bit)
        return closures[state]

    step: dict[tuple[int, int], frozenset[int]] = {}
    for q, moves in enumerate(nfa.moves):
        for c, b in enumerate(sample):
            if hit := [closure(to) for s, to in moves if b in s]:
                step[q, c] = frozenset().union(*hit)
    begin = closure(root)
    index, order, table = {begin: 0}, [begin], []
    none: frozenset[int] = frozenset()
    for now in order:
        row = []
        for c in range(len(kinds)):
            to = none.union(*(step.get((q, c), none) for q in now), begin if anywhere else none)
            if to not in index:
                index[to] = len(order)
                order.append(to)
            row.append(index[to])
        table.append(row)
    moves = np.array(table)
    accept = np.array([sum({bit[q] for q in now if q in bit}) for now in order])
    # Moore's refinement: states stay together while they accept the same rules and move to the same classes.
    group = np.unique(accept, return_inverse=True)[1].ravel()
    while True:
        finer = np.unique(np.c_[group, group[moves]], axis=0, return_inverse=True)[1].ravel()
        if finer.max() == group.max():
            break
        group = finer
    first = np.full(group.max() + 1, -1)
    for q in range(len(group) - 1, -1, -1):
        first[group[q]] = q
    rename = np.argsort(np.argsort(np.where(first == first[group[0]], -1, first)))  # the start becomes state 0
    lead = first[np.argsort(rename)]
    return rename[group[moves[lead]]][:, of_byte].astype(np.int32), accept[lead]
