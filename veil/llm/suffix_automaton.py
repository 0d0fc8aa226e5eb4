"""A suffix automaton over words, grown text by text (helper of operator 8)."""

from __future__ import annotations


class SuffixAutomaton:
    """All runs of words of the texts added so far."""

    def __init__(self):
        self.to: list[dict] = [{}]
        self.link, self.length = [-1], [0]
        self.words = 0

    def _state(self, to: dict, link: int, length: int) -> int:
        self.to.append(to)
        self.link.append(link)
        self.length.append(length)
        return len(self.to) - 1

    def _split(self, p: int, word, q: int) -> int:
        """The state that ``p`` reaches by ``word``, made its own where ``q`` stands for longer runs too."""
        if self.length[q] == self.length[p] + 1:
            return q
        clone = self._state(dict(self.to[q]), self.link[q], self.length[p] + 1)
        self.link[q] = clone
        while p >= 0 and self.to[p].get(word) == q:
            self.to[p][word] = clone
            p = self.link[p]
        return clone

    def add(self, text: list) -> None:
        last = 0
        for word in text:
            known = self.to[last].get(word)
            if known is not None:
                last = self._split(last, word, known)
                continue
            new, p = self._state({}, 0, self.length[last] + 1), last
            while p >= 0 and word not in self.to[p]:
                self.to[p][word] = new
                p = self.link[p]
            if p >= 0:
                self.link[new] = self._split(p, word, self.to[p][word])
            last = new
        self.words += len(text)

    def matches(self, text: list) -> list[int]:
        """At each word, the length of the longest run ending there that the automaton has."""
        to, link, length = self.to, self.link, self.length
        state = size = 0
        out = []
        for word in text:
            while state and word not in to[state]:
                state = link[state]
                size = length[state]
            found = to[state].get(word)
            if found is not None:
                state, size = found, size + 1
            out.append(size)
        return out
