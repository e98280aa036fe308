"""Cheapest edit scripts over a conversation's lattice by the auction algorithm for shortest paths (Bertsekas, 1991).

Layer i of the lattice stands before row i; its four nodes are the states of the wanted order ``(s?(ua)+)?``: nothing yet,
after a system row, after a user row, after an assistant row.  Arcs are the edits of a row and insertions; their costs are
small integers.  Every node has a price.  A path grows from the origin: while its last node's price equals the best of
(arc cost + next price) it is extended along that arc, else the price is raised to it and the path contracts by one node.
Prices stay a feasible dual solution, so once the path reaches the target, the arcs that lie on any shortest path are
exactly tight, and the least script is read off them letter by letter.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

FAR = 1 << 60
STATES = 4
#: State after a row of this role initial; "x" is any other role.
NEXT = {"s": (1, -1, -1, -1), "u": (2, 2, -1, 2), "a": (-1, -1, 3, -1), "x": (-1, -1, -1, -1)}
#: State after a row that was inserted, or given the role that fits here.
FITS = (2, 2, 3, 2)
DELETE, INSERT, REROLE, TRUNCATED = 3, 2, 2, 1
#: A row's code is its role's initial (s, u, a, x) and one of: k = sound, t = truncated, d = must be deleted.
END = "."


class Lattice:
    """The lattice of some consecutive rows.

    ``codes``: two characters for each row.  With ``last`` the conversation ends behind these rows and ``out`` is not
    used; otherwise ``out[q]`` is the cost from state q behind the rows to the end, FAR if there is no way.
    """

    def __init__(self, codes: str, last: bool, out: Sequence[int] = ()):
        self.rows = len(codes) // 2
        self.target = STATES * (self.rows + 1)
        #: Taken off all ways to the target and added to the cost again: prices only rise by what differs.
        self.offset = 0 if last else min(out)
        self.arcs: list[list[tuple[int, int, str]]] = []
        floor = [0] * (self.rows + 1)
        for i in range(self.rows - 1, -1, -1):
            floor[i] = floor[i + 1] + {"d": DELETE, "t": TRUNCATED, "k": 0}[codes[2 * i + 1]]
        for i in range(self.rows):
            after, fault = NEXT[codes[2 * i]], codes[2 * i + 1]
            layer, more = STATES * (i + 1), TRUNCATED if fault == "t" else 0
            for q in range(STATES):
                ways = [(DELETE, layer + q, "D"), (INSERT, layer - STATES + FITS[q], "I")]
                if fault != "d":
                    if after[q] >= 0:
                        ways.append((more, layer + after[q], "K"))
                    ways.append((REROLE + more, layer + FITS[q], "R"))
                self.arcs.append(ways)
        end = STATES * self.rows
        for q in range(STATES):
            if last:
                self.arcs.append([(INSERT, end + FITS[q], "I")] + ([(0, self.target, END)] if q in (0, 3) else []))
            else:
                self.arcs.append([(out[q] - self.offset, self.target, END)] if out[q] < FAR else [])
        #: A row costs at least what its fault does: feasible prices to begin with.
        self.prices = [floor[n // STATES] for n in range(self.target)] + [0]
        # on a node without a way to the target, insertions would raise each other's prices for ever: it is priced out
        leads = self._leading(lambda n, cost, j: True)
        for n in range(self.target):
            if not leads[n]:
                self.prices[n] = FAR

    def _leading(self, admit: Callable[[int, int, int], bool]) -> bytearray:
        """Nodes from which admitted arcs ``(node, cost, next)`` lead to the target."""
        good = bytearray(self.target + 1)
        good[self.target] = 1
        for layer in range(self.rows, -1, -1):
            nodes = range(STATES * layer, STATES * layer + STATES)
            for _ in range(STATES - 1):  # insertions lead through at most so many nodes of one layer
                for n in nodes:
                    if not good[n]:
                        good[n] = any(good[j] and admit(n, cost, j) for cost, j, _ in self.arcs[n])
        return good

    def auction(self, origin: int) -> int:
        """Cost from state ``origin`` before the first row to the target (FAR if there is no way); prices converge for it."""
        arcs, prices, target = self.arcs, self.prices, self.target
        if prices[origin] >= FAR:
            return FAR
        path, node = [origin], origin
        while node != target:
            best, to = FAR, -1
            for cost, j, _ in arcs[node]:
                value = cost + prices[j]
                if value < best:
                    best, to = value, j
            if prices[node] < best:
                prices[node] = best
                if len(path) > 1:
                    path.pop()
                node = path[-1]
            else:
                path.append(to)
                node = to
        return prices[origin] + self.offset

    def _open(self) -> bytearray:
        """Nodes from which tight arcs lead to the target."""
        prices = self.prices
        return self._leading(lambda n, cost, j: prices[n] < FAR and prices[n] == cost + prices[j])

    def scripts(self, origins: Sequence[int]) -> dict[int, tuple[int, list[str], int]]:
        """For each origin: (cost, edits before or of each row and behind the last one, state reached), least script first.

        An origin without a way to the target is left out.
        """
        costs = {q: self.auction(q) for q in origins}
        good, found = self._open(), {}
        for q, cost in costs.items():
            if cost >= FAR:
                continue
            node, at, parts = q, 0, [""] * (self.rows + 1)
            while True:
                _, to, letter = min(
                    ((c, j, x) for c, j, x in self.arcs[node] if good[j] and self.prices[node] == c + self.prices[j]), key=lambda a: a[2]
                )
                if letter == END:
                    break
                parts[at] += letter
                at += letter != "I"
                node = to
            found[q] = (cost, parts, node % STATES)
        return found


def transfer(codes: str, last: bool) -> list[int]:
    """Cost from each state before the rows to each state behind them (row by row; FAR: no way)."""
    if last:  # one way to end: it is booked under state 0
        whole = Lattice(codes, True)
        return [x for q in range(STATES) for x in (whole.auction(q), FAR, FAR, FAR)]
    columns = []
    for exit_ in range(STATES):
        part = Lattice(codes, False, [0 if q == exit_ else FAR for q in range(STATES)])
        columns.append([part.auction(q) for q in range(STATES)])
    return [columns[b][a] for a in range(STATES) for b in range(STATES)]
