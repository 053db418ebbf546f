"""Edit distances of many texts to many others at once."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np

#: Distances worked out at once, for bounded memory.
_CELLS = 1 << 16


class _Prefixes:
    """The different beginnings of some texts: per length their parents, last characters and the texts that end there."""

    def __init__(self, texts: Sequence[str]):
        self.letters = {c: k for k, c in enumerate(sorted(set("".join(texts))))}
        order = sorted(range(len(texts)), key=texts.__getitem__)
        self.levels, self.of_empty = [], np.array([k for k in order if not texts[k]], dtype=np.int64)
        held = [(k, 0) for k in order if texts[k]]
        length = 0
        while held:
            parents, chars, ends, at, going, last = [], [], [], [], [], None
            for k, parent in held:
                c = texts[k][length]
                if (parent, c) != last:
                    last = (parent, c)
                    parents.append(parent)
                    chars.append(self.letters[c])
                if len(texts[k]) == length + 1:
                    ends.append(k)
                    at.append(len(parents) - 1)
                else:
                    going.append((k, len(parents) - 1))
            self.levels.append(tuple(np.array(x, dtype=np.int64) for x in (parents, chars, ends, at)))
            held, length = going, length + 1


def _bits(names: Sequence[str], trie: _Prefixes, count: int) -> np.ndarray:
    """Distances of names of 1 to 64 characters: a column of the table of edits is two words of bits (Myers)."""
    one, top = np.uint64(1), np.array([[len(x) - 1] for x in names], dtype=np.uint64)
    where = np.zeros((len(names), len(trie.letters)), dtype=np.uint64)
    for i, name in enumerate(names):
        for j, c in enumerate(name):
            if c in trie.letters:
                where[i, trie.letters[c]] |= one << np.uint64(j)
    out = np.empty((len(names), count), dtype=np.int32)
    up, down = np.full((len(names), 1), ~np.uint64(0)), np.zeros((len(names), 1), dtype=np.uint64)
    score = np.array([[len(x)] for x in names], dtype=np.int32)
    out[:, trie.of_empty] = score
    for parents, chars, ends, at in trie.levels:
        same, up, down = where[:, chars], up[:, parents], down[:, parents]
        cross = (((same & up) + up) ^ up) | same
        right, left = down | ~(cross | up), up & cross
        score = score[:, parents] + ((right >> top) & one).astype(np.int32) - ((left >> top) & one).astype(np.int32)
        right, both = (right << one) | one, same | down
        up, down = (left << one) | ~(both | right), right & both
        out[:, ends] = score[:, at]
    return out


def _table(name: str, trie: _Prefixes, count: int) -> np.ndarray:
    """Distances of one name of any length, a row of the table of edits for each beginning."""
    codes, steps = np.array([trie.letters.get(c, -1) for c in name], dtype=np.int64), np.arange(len(name) + 1)
    out, rows = np.empty(count, dtype=np.int32), steps[None, :]
    out[trie.of_empty] = len(name)
    for parents, chars, ends, at in trie.levels:
        old = rows[parents]
        new = np.concatenate([old[:, :1] + 1, np.minimum(old[:, 1:] + 1, old[:, :-1] + (codes[None, :] != chars[:, None]))], axis=1)
        rows = np.minimum.accumulate(new - steps, axis=1) + steps
        out[ends] = rows[at, -1]
    return out


def distances(names: Sequence[str], others: Sequence[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The names a few at a time, as positions, and their edit distances to all the others."""
    trie, step = _Prefixes(others), max(1, _CELLS // max(len(others), 1))
    short = [i for i, x in enumerate(names) if 0 < len(x) <= 64]
    for a in range(0, len(short), step):
        at = short[a:a + step]
        yield np.array(at), _bits([names[i] for i in at], trie, len(others))
    for i, x in enumerate(names):
        if not 0 < len(x) <= 64:
            yield np.array([i]), _table(x, trie, len(others))[None, :]


def nearest_two(names: Sequence[str], others: Sequence[str], codes: Sequence[Sequence[int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each name's two most similar codes: positions of names, codes and similarities (1 less the edits over the longer length).

    An other stands for several codes, a code may have several others; ties go to the smaller code. All texts have characters.
    """
    of, code = (np.array([x[k] for x in sorted((c, i) for i, held in enumerate(codes) for c in held)], dtype=np.int64) for k in (1, 0))
    long, found = np.array([len(x) for x in others])[of], []
    for at, edits in distances(names, others):
        score = 1 - edits[:, of] / np.maximum(np.array([len(names[i]) for i in at])[:, None], long)
        rows = np.arange(len(at))
        first = score.argmax(1)
        found.append((at, code[first], score[rows, first]))
        score[code[None, :] == code[first][:, None]] = -1.0
        second = score.argmax(1)
        some = score[rows, second] >= 0
        found.append((at[some], code[second][some], score[rows, second][some]))
    return tuple(np.concatenate([x[k] for x in found]) for k in range(3))
