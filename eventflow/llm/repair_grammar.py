"""Cheapest edits of a row sequence as products of min-plus matrices, one per rule of a shared grammar.

A row is a letter: the initial of its role (s, u, a, other) with its fault (none, blank, duplicate,
truncated). The repaired roles must read ``(s?(ua)+)?``; the automaton's states are what came last
(nothing, s, u, a). An edit is D (delete, 2), K (keep, 0), R (make it user or assistant, 1) or I (insert
user or assistant, 5); a truncated row that stays costs 5 more, blank and duplicate rows go. A matrix
holds, for each pair of states, the least cost and the least audit of that cost. Two audits of one cost
over the same rows are never prefixes of each other (an insert more would cost more), so the least of a
product is the product of the least, however the rows are cut: matrices may be shared and multiplied in
any order of brackets. A kept s is written L inside, so that the states can be read from an audit alone;
of one row K and L are never both possible, and L stands where K does between I and R.

Audits inside a grammar are ropes: a rule's audit refers to those of the two symbols it stands for.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Sequence

ROLES = "suax"  # x: any other
OK, BLANK, DUPLICATE, TRUNCATED = range(4)
FIRST_LETTER, FIRST_RULE = ord("A"), 0x100
STATES = 4
DELETE, RENAME, INSERT, CUT_OFF = 2, 1, 5, 5
_U, _A = 2, 3
_AFTER = {"s": {0: 1}, "u": {0: _U, 1: _U, 3: _U}, "a": {_U: _A}, "x": {}}
_NEXT = {0: _U, 1: _U, _U: _A, _A: _U}  # the only role that u or a can have after a state


def letter(role: int, fault: int) -> str:
    return chr(FIRST_LETTER + 4 * role + fault)


class Rope:
    """A text, or two ropes end to end."""

    __slots__ = ("left", "right", "size", "text")

    def __init__(self, text: str | None, left: Rope | None = None, right: Rope | None = None):
        self.text, self.left, self.right = text, left, right
        self.size = len(text) if text is not None else left.size + right.size

    def __add__(self, other: Rope) -> Rope:
        if not other.size:
            return self
        return Rope(None, self, other) if self.size else other

    def __lt__(self, other: Rope) -> bool:
        """By character; parts that both share are passed over whole."""
        mine, theirs = [self], [other]
        while mine and theirs:
            x, y = mine.pop(), theirs.pop()
            if x is y:
                continue
            if x.text is None and (y.text is not None or x.size >= y.size):
                mine += [x.right, x.left]
                theirs.append(y)
            elif y.text is None:
                theirs += [y.right, y.left]
                mine.append(x)
            else:
                n = min(x.size, y.size)
                if x.text[:n] != y.text[:n]:
                    return x.text < y.text
                if x.size > n:
                    mine.append(Rope(x.text[n:]))
                if y.size > n:
                    theirs.append(Rope(y.text[n:]))
        return bool(theirs) and not mine

    def __str__(self) -> str:
        parts, left = [], [self]
        while left:
            x = left.pop()
            if x.text is None:
                left += [x.right, x.left]
            else:
                parts.append(x.text)
        return "".join(parts)


# A matrix: {(from, to): (cost, audit)}, unreachable pairs left out; audits are ropes or texts.
Matrix = dict


def product(left: Matrix, right: Matrix) -> Matrix:
    out: Matrix = {}
    after: dict[int, list] = {}
    for (k, j), entry in right.items():
        after.setdefault(k, []).append((j, entry))
    for (i, k), (cost, audit) in left.items():
        for j, (more, rest) in after.get(k, ()):
            old = out.get((i, j))
            if old is None or cost + more < old[0]:
                out[i, j] = (cost + more, audit + rest)
            elif cost + more == old[0]:
                joined = audit + rest
                if joined < old[1]:
                    out[i, j] = (old[0], joined)
    return out


def _inserts(make) -> Matrix:
    """Any number of inserted rows; more than two in a row never help."""
    out = {}
    for i in range(STATES):
        at = i
        for n in range(3):
            if (i, at) not in out:
                out[i, at] = (INSERT * n, make("I" * n))
            at = _NEXT[at]
    return out


INSERTS = _inserts(str)


def leaf(symbol: str) -> Matrix:
    """Inserts, then one row."""
    role, fault = divmod(ord(symbol) - FIRST_LETTER, 4)
    row = {(i, i): (DELETE, Rope("D")) for i in range(STATES)}
    if fault in (OK, TRUNCATED):
        extra = CUT_OFF if fault == TRUNCATED else 0
        for i in range(STATES):
            row[i, _NEXT[i]] = (RENAME + extra, Rope("R"))
        for i, j in _AFTER[ROLES[role]].items():
            row[i, j] = (extra, Rope("L" if ROLES[role] == "s" else "K"))
    return product(_inserts(Rope), row)


def apply_rules(letters: str, rules: Iterable[tuple[str, str]]) -> str:
    for pair, symbol in rules:
        letters = letters.replace(pair, symbol)
    return letters


def count_pairs(sequences: Iterable[tuple[str, int]]) -> Counter:
    found: Counter = Counter()
    for letters, n in sequences:
        for a, b in zip(letters, letters[1:], strict=False):
            found[a + b] += n
    return found


def choose_pairs(counted: Sequence[str], rules: list[tuple[str, str]], most: int) -> list[tuple[str, str]]:
    """New rules for the first pairs that share no symbol: these can be replaced side by side."""
    used: set[str] = set()
    made = []
    for pair in counted:
        if len(made) < most and not used & set(pair):
            made.append((pair, chr(FIRST_RULE + len(rules) + len(made))))
            used |= set(pair)
    return made


class Grammar:
    """Matrices of all letters and rules, made bottom-up once."""

    def __init__(self, rules: Sequence[tuple[str, str]]):
        self.rules = list(rules)
        self._matrices = {
            letter(r, f): leaf(letter(r, f)) for r in range(len(ROLES)) for f in range(4)
        }
        for (a, b), symbol in self.rules:
            self._matrices[symbol] = product(self._matrices[a], self._matrices[b])

    def matrix(self, letters: str) -> Matrix:
        """Of a sequence of at least one letter; audits as ropes."""
        symbols = apply_rules(letters, self.rules)
        out = self._matrices[symbols[0]]
        for symbol in symbols[1:]:
            out = product(out, self._matrices[symbol])
        return out


def packed(matrix: Matrix) -> tuple[list[int | None], list[str | None]]:
    """Costs and audits in a row, by (from, to); null where there is no way."""
    cells = [matrix.get((i, j)) for i in range(STATES) for j in range(STATES)]
    return [c and c[0] for c in cells], [c and str(c[1]) for c in cells]


def unpacked(costs: Sequence, audits: Sequence) -> Matrix:
    return {
        divmod(n, STATES): (int(cost), audit)
        for n, (cost, audit) in enumerate(zip(costs, audits, strict=True))
        if audit is not None
    }


def best_end(matrix: Matrix) -> tuple[int, str, int, str]:
    """Least cost and audit from the start to an accepted end, the state before the closing inserts, and those."""
    ways = [
        (cost + more, audit + rest, j, rest)
        for (i, j), (cost, audit) in matrix.items()
        if i == 0
        for (k, t), (more, rest) in INSERTS.items()
        if k == j and t in (0, _A)
    ]
    return min(ways)


def best_path(matrices: Sequence[Matrix], start: int, end: int) -> list[tuple[int, int]]:
    """The states before and after each of several matrices on the least way from ``start`` to ``end``."""
    at = {start: (0, "", [])}
    for matrix in matrices:
        then: dict = {}
        for (i, j), (more, rest) in matrix.items():
            if i in at:
                cost, audit, path = at[i]
                way = (cost + more, audit + rest, [*path, (i, j)])
                if j not in then or way[:2] < then[j][:2]:
                    then[j] = way
        at = then
    return at[end][2]


def rows_of(audit: str, state: int) -> list[tuple[list[str], str, str | None]]:
    """For each row that ``audit`` edits: roles inserted before it, its edit, and its new role if R."""
    names = {_U: "user", _A: "assistant"}
    out, before = [], []
    for edit in audit:
        if edit == "I":
            state = _NEXT[state]
            before.append(names[state])
            continue
        role = None
        if edit == "L":
            state = 1
        elif edit in "KR":
            state = _NEXT[state]
            role = names[state] if edit == "R" else None
        out.append((before, "K" if edit == "L" else edit, role))
        before = []
    return out


def roles_after(state: int, inserts: str) -> list[str]:
    """The roles of rows inserted after a state."""
    out = []
    for _ in inserts:
        state = _NEXT[state]
        out.append("user" if state == _U else "assistant")
    return out
