"""A generalised suffix automaton over word numbers."""

from __future__ import annotations


class SuffixAutomaton:
    """All substrings of several word sequences; states know where in each sequence they end first."""

    def __init__(self, sequences: list[list[int]]):
        self.next: list[dict[int, int]] = [{}]
        self.link = [-1]
        self.length = [0]
        self.ends: list[dict[int, int]] = [{}]  # sequence -> smallest end (exclusive)
        for number, words in enumerate(sequences):
            last = 0
            for k, word in enumerate(words):
                last = self._extend(last, word)
                self.ends[last].setdefault(number, k + 1)
        for state in sorted(range(1, len(self.next)), key=lambda s: -self.length[s]):
            above = self.ends[self.link[state]]
            for number, end in self.ends[state].items():
                above[number] = min(end, above.get(number, end))

    def _state(self, length: int, link: int, following: dict[int, int]) -> int:
        self.next.append(following)
        self.link.append(link)
        self.length.append(length)
        self.ends.append({})
        return len(self.next) - 1

    def _split(self, above: int, word: int, old: int) -> int:
        """A copy of ``old`` for the strings that also end another way; predecessors from ``above`` up use it."""
        copy = self._state(self.length[above] + 1, self.link[old], dict(self.next[old]))
        self.link[old] = copy
        while above >= 0 and self.next[above].get(word) == old:
            self.next[above][word] = copy
            above = self.link[above]
        return copy

    def _extend(self, last: int, word: int) -> int:
        known = self.next[last].get(word)
        if known is not None:  # an earlier sequence has this prefix already
            return known if self.length[known] == self.length[last] + 1 else self._split(last, word, known)
        fresh = self._state(self.length[last] + 1, 0, {})
        above = last
        while above >= 0 and word not in self.next[above]:
            self.next[above][word] = fresh
            above = self.link[above]
        if above >= 0:
            old = self.next[above][word]
            self.link[fresh] = old if self.length[old] == self.length[above] + 1 else self._split(above, word, old)
        return fresh

    def statistics(self, words: list[int]) -> list[tuple[int, int]]:
        """(length, state) of the longest substring that ends at each word: the matching statistics."""
        state, length, out = 0, 0, []
        following, link, lengths = self.next, self.link, self.length
        for word in words:
            while state and word not in following[state]:
                state = link[state]
                length = lengths[state]
            if word in following[state]:
                state = following[state][word]
                length += 1
            out.append((length, state))
        return out

    def find(self, words: list[int]) -> int:
        """The state of a substring."""
        state = 0
        for word in words:
            state = self.next[state][word]
        return state
