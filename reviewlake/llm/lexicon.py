"""A minimal acyclic automaton that numbers words, kept as flat arrays.

Words are added in sorted order; a finished suffix is merged with an equal one,
so shared endings are stored once. A transition carries how many words lie
before the branch it opens; summed along the path that gives the word's number,
and the number leads to its ids. The arrays go to a file that is mapped into
memory. Whole batches of words walk the automaton side by side.
"""

from __future__ import annotations

import numpy as np


def build(words: list[bytes], outputs: list[bytes]) -> bytes:
    """The file for distinct words and their outputs (any bytes)."""
    order = sorted(range(len(words)), key=words.__getitem__)
    known: dict[tuple, int] = {}
    sizes: list[int] = []  # words below a finished state, itself included
    edges: list[tuple[tuple[int, int], ...]] = []
    final: list[bool] = []

    def finish(node: list) -> int:
        key = (node[0], tuple(node[1]))
        if key not in known:
            known[key] = len(sizes)
            sizes.append(node[0] + sum(sizes[t] for _, t in node[1]))
            edges.append(key[1])
            final.append(bool(node[0]))
        return known[key]

    path, last = [[0, []]], b""  # open states: is a word, finished transitions
    for i in order:
        word, common = words[i], 0
        while common < min(len(word), len(last)) and word[common] == last[common]:
            common += 1
        while len(path) > common + 1:
            done = finish(path.pop())
            path[-1][1].append((last[len(path) - 1], done))
        path.extend([0, []] for _ in word[common:])
        path[-1][0], last = 1, word
    while len(path) > 1:
        done = finish(path.pop())
        path[-1][1].append((last[len(path) - 1], done))
    root = finish(path[0])
    keys, to, add = [], [], []
    for state, own in enumerate(edges):
        before = int(final[state])
        for byte, target in own:
            keys.append(state << 8 | byte)
            to.append(target)
            add.append(before)
            before += sizes[target]
    ends = np.cumsum([len(outputs[i]) for i in order], dtype="<i8")
    head = np.array([root, len(edges), len(keys), len(words)], dtype="<i8")
    arrays = (head, *(np.array(x, dtype="<i8") for x in (keys, to, add, final)), ends)
    return b"".join(x.tobytes() for x in arrays) + b"".join(outputs[i] for i in order)


class Lexicon:
    def __init__(self, path: str):
        raw = np.memmap(path, dtype=np.uint8, mode="r").view(np.ndarray)
        self.root, states, arcs, words = raw[:32].view("<i8").tolist()
        place, parts = 32, []
        for n in (arcs, arcs, arcs, states, words):
            parts.append(raw[place: place + 8 * n].view("<i8"))
            place += 8 * n
        self.keys, self.to, self.add, self.final, self.ends = parts
        self.blob = raw[place:]

    def numbers(self, words: list[bytes]) -> np.ndarray:
        """The number of each word in sorted order, -1 for one that is not in the lexicon."""
        lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        starts = np.concatenate([[0], np.cumsum(lengths)[:-1]]) if words else lengths
        text = np.frombuffer(b"".join(words), dtype=np.uint8)
        state = np.full(len(words), self.root, dtype=np.int64)
        number = np.zeros(len(words), dtype=np.int64)
        alive, step = np.arange(len(words)), 0
        while True:
            alive = alive[(lengths[alive] > step)]
            if not len(alive) or not len(self.keys):
                state[alive] = -1
                break
            wanted = state[alive] << 8 | text[starts[alive] + step]
            at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
            ok = self.keys[at] == wanted
            state[alive[~ok]] = -1
            alive, at = alive[ok], at[ok]
            state[alive], step = self.to[at], step + 1
            number[alive] += self.add[at]
        good = state >= 0
        good[good] = self.final[state[good]] > 0
        return np.where(good, number, -1)

    def output(self, number: int) -> bytes:
        start = int(self.ends[number - 1]) if number else 0
        return self.blob[start: int(self.ends[number])].tobytes()
