"""Lightest derivations by Knuth's agenda, and the repair of role sequences as deductions.

Runs inside tasks; plain Python over one block of a conversation at a time.

An item is weighted by (cost, audit): the price of the edits and their initials. A deduction
adds a price to the cost and letters to the end of the audit. That is monotone and superior: no conclusion is lighter
than its premises, and lighter premises give lighter conclusions (of two audits that reach
one item at one cost neither begins with the other, as every letter more than the rows
passed is an insertion, which costs). So an item is final when the agenda yields it.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterable, Iterator

# --- Fixed values: prices and initials of the edits, states of the role grammar --------
KEEP, REROLE, DELETE, INSERT = "K", "R", "D", "I"
PRICE = {KEEP: 0, REROLE: 2, DELETE: 3, INSERT: 2}
TRUNCATED_PRICE = 1
START, SYSTEM, ASKED, ANSWERED = range(4)
STATES = (START, SYSTEM, ASKED, ANSWERED)
FINAL = (START, ANSWERED)
# (s?(ua)+)?
NEXT = {
    (START, "s"): SYSTEM,
    (START, "u"): ASKED,
    (SYSTEM, "u"): ASKED,
    (ASKED, "a"): ANSWERED,
    (ANSWERED, "u"): ASKED,
}
LEGAL = ("su", "ua", "au")
# ---------------------------------------------------------------------------------------

SOUND, BLANK, DUPLICATE, TRUNCATED = range(4)
Weight = tuple[int, str]


def due_role(state: int) -> str:
    """The role, of user and assistant, that may follow."""
    return "assistant" if state == ASKED else "user"


def after_due(state: int) -> int:
    return ANSWERED if state == ASKED else ASKED


def lightest(
    axioms: dict, deductions: Callable[[object], Iterable[tuple[object, int, str]]], goals: set | None = None
) -> dict:
    """Final weights of the items that can be derived, all or until the goals are final.

    `deductions` gives (conclusion, price, letters) of a final item.
    """
    final: dict = {}
    best = dict(axioms)
    agenda = [(*weight, item) for item, weight in axioms.items()]
    heapq.heapify(agenda)
    open_goals = set(goals) if goals else None
    while agenda:
        cost, audit, item = heapq.heappop(agenda)
        if item in final:
            continue
        final[item] = (cost, audit)
        if open_goals is not None:
            open_goals.discard(item)
            if not open_goals:
                break
        for conclusion, price, letters in deductions(item):
            weight = (cost + price, audit + letters)
            if conclusion not in final and (conclusion not in best or weight < best[conclusion]):
                best[conclusion] = weight
                heapq.heappush(agenda, (*weight, conclusion))
    return final


def spans(rows: list[tuple[str, int]], starts: Iterable[int]) -> Iterator[tuple[int, int, int, str]]:
    """(state before, state after, cost, audit): the lightest repairs of a run of rows.

    Rows are (role initial, fault). Items are (rows passed, state).
    """

    def edits(item: tuple[int, int]) -> Iterator[tuple[tuple[int, int], int, str]]:
        i, state = item
        yield (i, after_due(state)), PRICE[INSERT], INSERT
        if i == len(rows):
            return
        initial, fault = rows[i]
        yield (i + 1, state), PRICE[DELETE], DELETE
        if fault in (BLANK, DUPLICATE):
            return
        extra = TRUNCATED_PRICE if fault == TRUNCATED else 0
        if (state, initial) in NEXT:
            yield (i + 1, NEXT[state, initial]), PRICE[KEEP] + extra, KEEP
        yield (i + 1, after_due(state)), PRICE[REROLE] + extra, REROLE

    for start in starts:
        for (i, state), (cost, audit) in lightest({(0, start): (0, "")}, edits).items():
            if i == len(rows):
                yield start, state, cost, audit


def joined(prefixes: dict[int, Weight], block: Iterable[tuple[int, int, int, str]]) -> dict[int, Weight]:
    """Repairs up to a block and those of the block as premises of the repairs up to its end."""
    onward: dict = {}
    for before, after, cost, audit in block:
        onward.setdefault(before, []).append(((1, after), cost, audit))

    def steps(item: tuple[int, int]):
        return onward.get(item[1], ()) if item[0] == 0 else ()

    found = lightest({(0, state): weight for state, weight in prefixes.items()}, steps)
    return {state: weight for (at, state), weight in found.items() if at == 1}


def goal(prefixes: dict[int, Weight]) -> Weight:
    """The lightest repair of a whole conversation."""

    def end(item: tuple[int, int]):
        return (((1, 0), 0, ""),) if item[0] == 0 and item[1] in FINAL else ()

    axioms = {(0, state): weight for state, weight in prefixes.items()}
    return lightest(axioms, end, {(1, 0)})[1, 0]


class Repair:
    """Applies an audit to the rows of a conversation, which pass by one at a time."""

    def __init__(self, audit: str):
        self.audit, self.at, self.state = audit, 0, START

    def _inserted(self) -> Iterator[tuple[str, str, str]]:
        while self.at < len(self.audit) and self.audit[self.at] == INSERT:
            self.at += 1
            role, self.state = due_role(self.state), after_due(self.state)
            yield INSERT, role, ""

    def row(self, role: str, text: str) -> Iterator[tuple[str, str, str]]:
        """(edit, role, text) of what stands before the row and of the row, if it stays."""
        yield from self._inserted()
        edit = self.audit[self.at]
        self.at += 1
        if edit == KEEP:
            self.state = NEXT[self.state, role[:1]]
            yield KEEP, role, text
        elif edit == REROLE:
            role, self.state = due_role(self.state), after_due(self.state)
            yield REROLE, role, text

    def end(self) -> Iterator[tuple[str, str, str]]:
        yield from self._inserted()
