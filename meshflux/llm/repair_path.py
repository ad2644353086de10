"""Cheapest edits of a run of turns: backward cost vectors at checkpoints, blocks recomputed on the way forward."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

#: What the turns so far end with: nothing, a system turn, a user turn, an assistant turn.
STATES = 4
#: The state after an inserted or reroled turn; its role follows from the state before.
FORCED = (2, 2, 3, 2)
ROLE = {2: "user", 3: "assistant"}
#: State after a kept turn of initial s, u, a.
KEPT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
KEEP, REROLE, DELETE, INSERT, CUT = 0, 2, 3, 2, 1
#: First faults of a row.
SOUND, BLANK, DUPLICATE, TRUNCATED = range(4)
INITIALS = ("s", "u", "a", "")
#: More than any run of edits costs.
NEVER = 1 << 60
#: Rows between two checkpoints of a block.
STRIDE = 32


def code(initial: str, fault: int) -> int:
    return (INITIALS.index(initial) if initial in "sua" and initial else 3) * 4 + fault


def _choices(initial: str, fault: int, state: int) -> list[tuple[str, int, int]]:
    """(edit, cost, state after) of a row, in the order of the letters."""
    found = [("D", DELETE, state)]
    if fault not in (BLANK, DUPLICATE):
        more = CUT if fault == TRUNCATED else 0
        if (state, initial) in KEPT:
            found.append(("K", KEEP + more, KEPT[state, initial]))
        found.append(("R", REROLE + more, FORCED[state]))
    return found


_CHOICES = [[_choices(i, f, q) for q in range(STATES)] for i in INITIALS for f in range(4)]


def closed(w: Sequence[int]) -> list[int]:
    """Costs with any number of inserted turns first; two lead through all states."""
    once = [min(w[q], INSERT + w[FORCED[q]]) for q in range(STATES)]
    return [min(once[q], INSERT + once[FORCED[q]]) for q in range(STATES)]


#: Costs after the last row: turns may end with nothing or an assistant turn.
END = closed([0, NEVER, NEVER, 0])


def before(row: int, after: Sequence[int]) -> list[int]:
    """Costs of each state before a row, from those after it."""
    return closed([min(cost + after[to] for _, cost, to in choices) for choices in _CHOICES[row]])


def start(rows: Sequence[int], end: Sequence[int]) -> list[int]:
    for row in reversed(rows):
        end = before(row, end)
    return list(end)


def matrix(rows: Sequence[int]) -> list[int]:
    """Cost from each state before the rows to each state after them, row by row of the matrix."""
    columns = [start(rows, [0 if q == to else NEVER for q in range(STATES)]) for to in range(STATES)]
    return [min(columns[to][q], NEVER) for q in range(STATES) for to in range(STATES)]


def applied(m: Sequence[int], end: Sequence[int]) -> list[int]:
    return [min(NEVER, *(m[q * STATES + to] + end[to] for to in range(STATES))) for q in range(STATES)]


def walk(rows: Sequence[int], end: Sequence[int], state: int) -> Iterator[tuple[list[str], str, int]]:
    """(roles inserted before, edit, state after) of each row: of the cheapest runs of edits the one whose letters come first.

    Cost vectors are kept at every STRIDE rows only; those between two
    checkpoints are computed again when the walk gets there. The letter decides
    the next state, so the least letter that keeps the cost is always right.
    """
    marks = [list(end)]
    for low in reversed(range(STRIDE, len(rows), STRIDE)):
        marks.append(start(rows[low : low + STRIDE], marks[-1]))
    for low in range(0, len(rows), STRIDE):
        vectors = [marks.pop()]
        for row in reversed(rows[low : low + STRIDE]):
            vectors.append(before(row, vectors[-1]))
        here = vectors.pop()
        for row in rows[low : low + STRIDE]:
            after, inserted = vectors.pop(), []
            while True:
                deleting, *others = _CHOICES[row][state]
                if deleting[1] + after[state] == here[state]:
                    edit = "D"
                    break
                if INSERT + here[FORCED[state]] == here[state]:
                    state = FORCED[state]
                    inserted.append(ROLE[state])
                    continue
                edit, _, state = next(c for c in others if c[1] + after[c[2]] == here[state])
                break
            yield inserted, edit, state
            here = after


def ending(state: int) -> list[str]:
    """Roles inserted after the last row."""
    found = []
    while state in (1, 2):
        state = FORCED[state]
        found.append(ROLE[state])
    return found
