"""Suffix automaton over words, and matching statistics against it."""

from __future__ import annotations

from collections.abc import Hashable, Iterable


class SuffixAutomaton:
    """Recognises every run of words of the passages added so far."""

    def __init__(self):
        self.next: list[dict[Hashable, int]] = [{}]
        self.link = [-1]
        self.length = [0]
        self.last = 0
        self.passages = 0

    def add(self, words: Iterable[Hashable]) -> None:
        """Adds a passage; no match runs across two passages."""
        if self.passages:
            self._extend(("end of passage", self.passages))
        self.passages += 1
        for word in words:
            self._extend(word)

    def _extend(self, word: Hashable) -> None:
        following, link, length = self.next, self.link, self.length
        state, p = len(following), self.last
        following.append({})
        link.append(0)
        length.append(length[p] + 1)
        while p >= 0 and word not in following[p]:
            following[p][word] = state
            p = link[p]
        if p >= 0:
            q = following[p][word]
            if length[q] == length[p] + 1:
                link[state] = q
            else:
                clone = len(following)
                following.append(following[q].copy())
                link.append(link[q])
                length.append(length[p] + 1)
                while p >= 0 and following[p].get(word) == q:
                    following[p][word] = clone
                    p = link[p]
                link[q] = link[state] = clone
        self.last = state

    def matching_statistics(self, words: Iterable[Hashable]) -> list[int]:
        """For each word, the length of the longest run ending there that some passage holds."""
        following, link, length = self.next, self.link, self.length
        state, n, out = 0, 0, []
        for word in words:
            while state and word not in following[state]:
                state = link[state]
                n = length[state]
            if word in following[state]:
                state = following[state][word]
                n += 1
            out.append(n)
        return out
