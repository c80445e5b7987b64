"""Count transducers: minimal acyclic automata over word sequences that give each sequence its count.

Sequences enter in ascending order. The path of the last one stays open; what the next one no longer
shares is closed and merged with an equal state if there is one, so that the automaton is minimal at
any time (common prefixes and common ends are held once). Every arc knows how many sequences come
before those that go through it, which numbers the sequences in their order; the counts lie in an
array by that number. As a row of Spark the automaton is plain arrays (``FIELDS``).
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

Key = tuple[bytes, ...]

#: The columns that hold an automaton: sorted words, arcs up to the end of each state, word and target of each arc, which states end a sequence, counts.
FIELDS = "words array<binary>, ends array<int>, labels array<int>, targets array<int>, finals array<boolean>, counts array<long>"


class Transducer:
    """``arcs`` of each state: word -> (target, sequences of this state before those of the arc). The root is the last state."""

    __slots__ = ("arcs", "finals", "counts", "_below")

    def __init__(self) -> None:
        self.arcs: list[dict[bytes, tuple[int, int]]] = []
        self.finals: list[bool] = []
        self.counts: list[int] = []
        self._below: list[int] = []

    def _add_state(self, final: bool, arcs: Iterable[tuple[bytes, int]]) -> int:
        own, before = {}, int(final)
        for word, target in arcs:
            own[word] = target, before
            before += self._below[target]
        self.arcs.append(own)
        self.finals.append(final)
        self._below.append(before)
        return len(self.arcs) - 1

    @classmethod
    def build(cls, items: Iterable[tuple[Key, int]]) -> Transducer:
        """From (sequence, count) in strictly ascending order."""
        out = cls()
        known: dict[tuple, int] = {}
        path: list[tuple[list[tuple[bytes, int]], bool]] = [([], False)]  # closed arcs and end mark of the states of the open path
        last: Key = ()

        def close(depth: int) -> None:
            while len(path) > depth + 1:
                arcs, final = path.pop()
                signature = (final, *arcs)
                state = known.get(signature)
                if state is None:
                    state = known[signature] = out._add_state(final, arcs)
                path[-1][0].append((last[len(path) - 1], state))

        for key, count in items:
            if out.counts and key <= last:
                raise ValueError("sequences must ascend")
            shared = next((k for k, (a, b) in enumerate(zip(key, last)) if a != b), min(len(key), len(last)))
            close(shared)
            path.extend(([], False) for _ in key[shared:])
            path[-1] = path[-1][0], True
            out.counts.append(count)
            last = key
        close(0)
        out._add_state(path[0][1], path[0][0])
        return out

    def items(self) -> Iterator[tuple[Key, int]]:
        """All sequences with their counts, in order."""
        counts = iter(self.counts)
        stack: list[tuple[int, Key]] = [(len(self.arcs) - 1, ())]
        while stack:
            state, key = stack.pop()
            if self.finals[state]:
                yield key, next(counts)
            stack.extend((target, (*key, word)) for word, (target, _) in reversed(self.arcs[state].items()))

    def compose(self, other: Transducer) -> Iterator[tuple[Key, int]]:
        """The sequences of ``self`` that ``other`` has too, with the counts of ``other``: both are walked at once."""
        stack: list[tuple[int, int, int, Key]] = [(len(self.arcs) - 1, len(other.arcs) - 1, 0, ())]
        while stack:
            mine, its, number, key = stack.pop()
            if self.finals[mine] and other.finals[its]:
                yield key, other.counts[number]
            there = other.arcs[its]
            for word, (target, _) in reversed(self.arcs[mine].items()):
                if word in there:
                    at, before = there[word]
                    stack.append((target, at, number + before, (*key, word)))

    def row(self) -> dict[str, list]:
        """Columns ``FIELDS``."""
        words = sorted({w for arcs in self.arcs for w in arcs})
        number = {w: k for k, w in enumerate(words)}
        ends, labels, targets = [], [], []
        for arcs in self.arcs:
            labels += [number[w] for w in arcs]
            targets += [t for t, _ in arcs.values()]
            ends.append(len(labels))
        return {"words": words, "ends": ends, "labels": labels, "targets": targets, "finals": self.finals, "counts": self.counts}

    @classmethod
    def of(cls, row: dict[str, list]) -> Transducer:
        """From columns ``FIELDS``."""
        out = cls()
        words, labels, targets, at = [bytes(w) for w in row["words"]], row["labels"], row["targets"], 0
        for end, final in zip(row["ends"], row["finals"]):
            out._add_state(final, [(words[labels[k]], targets[k]) for k in range(at, end)])
            at = end
        out.counts = list(row["counts"])
        return out


def union(parts: Iterable[Transducer], least: int = 0) -> Transducer:
    """The sequences of all parts with their counts summed; sums under ``least`` fall away."""
    total: dict[Key, int] = {}
    for part in parts:
        for key, count in part.items():
            total[key] = total.get(key, 0) + count
    return Transducer.build(sorted((k, c) for k, c in total.items() if c >= least))
