"""Whole texts to token ids with the tokenizers library, one word at a time and each new word once.

The library's own cost per character is far above a dictionary's, and most words of a corpus repeat.
Both vocabularies used here split texts before merging, so a text may be cut before any single space
that stands between two characters that are not white space: no piece of either pattern spans that
place, and the merges of a piece see nothing outside it. Texts with other white space around spaces
are cut only at the places where this holds. The word vocabulary's pieces in texts of printable ASCII
and Latin letters are found without words, by the classes of all bytes of a slice at once.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import Memo, Words, once_per_worker, text_slices

_SAFE_SPACE = re.compile(r"(?<=\S) (?=\S)")


class TextEncoder:
    """encode(texts) gives each text's ids in turn, as little-endian unsigned 32-bit integers (null text: none).

    ``keeps_space``: a space belongs to the word after it (byte-level vocabularies); otherwise white
    space is dropped by the vocabulary's splitting rule and plays no part. ``pieces``: the ids of pieces of
    steady texts under the word vocabulary, which are then cut into those instead of words.
    """

    def __init__(self, encode_many, keeps_space: bool, *memos: Memo, pieces: Memo | None = None):
        self.encode_many, self.keeps_space, self.pieces = encode_many, keeps_space, pieces
        self.memo = Memo(self._make, 48_000_000 if pieces else 96_000_000)
        self.memos = (self.memo, *memos)

    def _make(self, words: list[str]) -> dict:
        # None marks words next to which a space isn't a safe place; the text is then cut anew
        good = [w for w in words if self._safe(w)]
        made = dict(zip(good, self.encode_many([" " + w for w in good] if self.keeps_space else good), strict=True))
        if len(good) < len(words):
            made.update((w, None) for w in words if not self._safe(w))
        return made

    def _safe(self, word: str) -> bool:
        return bool(word) and not word[0].isspace() and not word[-1].isspace()

    def _with_care(self, text: str) -> bytes:
        first, *rest = _SAFE_SPACE.split(text)
        return b"".join(self.encode_many([first, *((" " + w if self.keeps_space else w) for w in rest)]))

    def forget(self) -> None:
        """Frees the kept words, for a worker whose next task does other work."""
        for memo in self.memos:
            memo.clear()
        pa.default_memory_pool().release_unused()

    def encode(self, texts: pa.Array, slice_bytes: int = 8_000_000) -> Iterator[bytes]:
        for part in text_slices(texts, slice_bytes):
            yield from self._by_pieces(part) if self.pieces else self._by_words(part)

    def _by_pieces(self, part: pa.Array) -> Iterator[bytes]:
        odd, (codes, unique, bounds) = steady_pieces(part)
        others = self._by_words(part.filter(pa.array(odd))) if odd.any() else iter(())
        known = self.pieces.holding(set(unique))
        placed = pa.array(list(map(known.__getitem__, unique)), pa.large_binary()).take(codes)
        at = np.frombuffer(placed.buffers()[1], np.int64)[:len(placed) + 1]
        cuts = at[bounds].tolist() if len(placed) else [0] * len(bounds)
        view = memoryview(placed.buffers()[2] or b"")
        for i, is_odd in enumerate(odd.tolist()):
            yield next(others) if is_odd else bytes(view[cuts[i]:cuts[i + 1]])

    def _by_words(self, part: pa.Array) -> Iterator[bytes]:
        for part in text_slices(part, 8_000_000):
            lists = pc.split_pattern(part, " ")
            bounds = np.asarray(lists.offsets)
            words = Words(lists.flatten(), bounds - bounds[0])
            unique = words.unique.to_pylist()
            known = self.memo.holding(set(unique))
            values = list(map(known.__getitem__, unique))
            unsafe = np.array([v is None for v in values], dtype=bool)
            placed = pa.array(values, pa.large_binary()).take(pa.array(words.code))
            data = placed.buffers()[2]
            at = np.frombuffer(placed.buffers()[1], np.int64)[:len(placed) + 1]
            bad = np.add.reduceat(unsafe[words.code].astype(np.int64), words.bounds[:-1]) > 0 if unsafe.any() else np.zeros(len(part), bool)
            starts = self.encode_many([unique[c] for c in words.code[words.bounds[:-1]].tolist()]) if self.keeps_space else None
            tos = at[words.bounds[1:]].tolist()
            froms = at[words.bounds[:-1] + (1 if self.keeps_space else 0)].tolist()
            view = memoryview(data) if data else b""
            for i in range(len(part)):
                if bad[i]:
                    yield self._with_care(part[i].as_py())
                else:
                    yield (starts[i] if starts else b"") + bytes(view[froms[i]:tos[i]])


#: Characters whose class and lower case no version of Unicode has changed: printable ASCII and Latin letters.
_STEADY = re.compile(r"[!-~À-ÖØ-öø-įı-ſ]+")
_LETTERS = "a-zß-öø-ÿāăąćĉċčďđēĕėęěĝğġģĥħĩīĭįıĳĵķĸĺļľŀłńņňŉŋōŏőœŕŗřśŝşšţťŧũūŭůűųŵŷźżžſ"
#: The splitting pattern of the word vocabulary over those characters in lower case.
_PIECES = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[0-9]|[^{_LETTERS}0-9]+")


#: Classes of the bytes of UTF-8 texts; of two-byte characters those of U+00C0 to U+017F are letters but for the three of _NOT_LETTERS.
_ODD, _SPACE, _LETTER, _DIGIT, _OTHER = range(5)
_CLASS = np.zeros(256, np.uint8)
_CLASS[33:127] = _OTHER
_CLASS[48:58] = _DIGIT
_CLASS[[*range(65, 91), *range(97, 123), *range(0x80, 0xC0), 0xC3, 0xC4, 0xC5]] = _LETTER
_CLASS[[9, 10, 13, 32]] = _SPACE
_NOT_LETTERS = np.array([0xC397, 0xC3B7, 0xC4B0], np.uint16)
_DOUBTFUL = np.isin(np.arange(256), _NOT_LETTERS & 255)
_LOWER = np.array([b | 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)


def steady_pieces(texts: pa.Array) -> tuple[np.ndarray, tuple[pa.Array, list[str], np.ndarray]]:
    """Which texts hold other characters than steady ones and plain white space, and the pieces of the word vocabulary's
    pattern in the rest: their codes, the different pieces in lower case by code, and each text's bounds in the codes."""
    n = len(texts)
    sizes = pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
    firsts = np.concatenate([[0], np.cumsum(sizes + 1)])  # a line feed after each text
    lines = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), texts.cast(pa.binary())), b"\n")
    data = np.full(firsts[-1] + 3, 10, np.uint8)
    if firsts[-1] > 1:
        data[:firsts[-1] - 1] = np.frombuffer(lines.buffers()[2], np.uint8)[:firsts[-1] - 1]
    kind = _CLASS[data]
    doubtful = np.flatnonzero(_DOUBTFUL[data])
    no_letter = np.isin(data[doubtful - 1] * np.uint16(256) + data[doubtful], _NOT_LETTERS)
    odd = np.zeros(n, bool)
    odd[np.searchsorted(firsts, np.concatenate([np.flatnonzero(kind == _ODD), doubtful[no_letter]]), "right") - 1] = True
    for i in np.flatnonzero(odd).tolist():
        kind[firsts[i]:firsts[i + 1]] = _SPACE
    full = kind != _SPACE
    starts = full.copy()
    starts[1:] &= (kind[1:] != kind[:-1]) | (kind[1:] == _DIGIT)
    # 's, 't, 'm, 'd, 're, 've and 'll where the apostrophe starts a piece: one piece, and what follows starts another
    marks = np.flatnonzero(data == 39)
    marks = marks[starts[marks]]
    one, two = (data[marks + k] | 32 for k in (1, 2))
    letter = kind[marks + 1] == _LETTER
    short = letter & np.isin(one, np.frombuffer(b"stmd", np.uint8))
    long = letter & (kind[marks + 2] == _LETTER) & (((one == 114) | (one == 118)) & (two == 101) | (one == 108) & (two == 108))
    for at, size in ((marks[short], 1), (marks[long], 2)):
        starts[at + 1] = False
        starts[at + 1 + size] |= kind[at + 1 + size] == _LETTER
    froms = np.flatnonzero(starts)
    tos = np.flatnonzero(full[:-1] & (starts[1:] | ~full[1:])) + 1
    offsets = np.concatenate([[0], np.cumsum(tos - froms)]).astype(np.int32)
    coded = pa.StringArray.from_buffers(len(froms), pa.py_buffer(offsets), pa.py_buffer(_LOWER[data[full]])).dictionary_encode()
    lower = pc.utf8_lower(coded.dictionary).dictionary_encode()  # letters beyond ASCII may still be capitals
    return odd, (lower.indices.take(coded.indices), lower.dictionary.to_pylist(), np.searchsorted(froms, firsts))


class _Joined:
    """Ids of many short texts by few calls of the library: they are joined, and the ids cut where they met.

    Byte-level: a text of one leading space starts with the only id that starts with a space. Word
    vocabularies: texts are taken apart into pieces, whose last id alone ends a word; each new piece is encoded
    once. Other texts are parted by a character that is one id of its own, or go alone.
    """

    def __init__(self, library, keeps_space: bool):
        self.library, self.keeps_space = library, keeps_space
        self.memo = Memo(lambda pieces: dict(zip(pieces, self._cut(pieces, " ", self._at_edges), strict=True)), 24_000_000 if keeps_space else 128_000_000)
        vocab = library.get_vocab(with_added_tokens=False)
        self.edge = np.zeros(max(vocab.values()) + 1, bool)
        self.edge[[i for t, i in vocab.items() if (t.startswith("\u0120") if keeps_space else t.endswith("</w>"))]] = True
        (self.mark_id,) = library.encode("\x01", add_special_tokens=False).ids

    def _cut(self, items: list[str], join: str, places, step: int = 2000) -> Iterator[bytes]:
        for a in range(0, len(items), step):
            part = items[a:a + step]
            ids = np.array(self.library.encode_batch_fast([join.join(part)], add_special_tokens=False)[0].ids, dtype="<u4")
            froms, tos = places(ids)
            if len(froms) != len(part):
                raise ValueError("the joined texts did not stay apart")
            data = ids.tobytes()
            yield from (data[f:t] for f, t in zip(froms.tolist(), tos.tolist(), strict=True))

    def _at_marks(self, ids: np.ndarray):
        cuts = 4 * np.flatnonzero(ids == self.mark_id)
        return np.concatenate([[0], cuts + 4]), np.concatenate([cuts, [4 * len(ids)]])

    def _at_edges(self, ids: np.ndarray):
        at = 4 * np.flatnonzero(self.edge[ids])
        if self.keeps_space:
            return at, np.concatenate([at[1:], [4 * len(ids)]])
        return np.concatenate([[0], at[:-1] + 4]), at + 4

    def many(self, texts: list[str]) -> list[bytes]:
        out: list[bytes] = [b""] * len(texts)
        if self.keeps_space:
            joined = [i for i, t in enumerate(texts) if len(t) < 64 and t[:1] == " " and " " not in t[1:] and t[1:2].strip() and t[-1:].strip()]
            made = self._cut([texts[i] for i in joined], "", self._at_edges)
        else:
            cut = [(i, _PIECES.findall(t.lower())) for i, t in enumerate(texts) if len(t) < 64 and _STEADY.fullmatch(t)]
            known = self.memo.holding({p for _, pieces in cut for p in pieces})
            for i, pieces in cut:
                out[i] = known[pieces[0]] if len(pieces) == 1 else b"".join(map(known.__getitem__, pieces))
            done = {i for i, _ in cut}
            joined = [i for i, t in enumerate(texts) if i not in done and len(t) < 64 and "\x01" not in t]
            made = self._cut([texts[i] for i in joined], " \x01 ", self._at_marks)
        for i, ids in zip(joined, made, strict=True):
            out[i] = ids
        done = set(joined) if self.keeps_space else done | set(joined)
        alone = [i for i in range(len(texts)) if i not in done]
        for i, e in zip(alone, self.library.encode_batch_fast([texts[i] for i in alone], add_special_tokens=False), strict=True):
            out[i] = np.array(e.ids, dtype="<u4").tobytes()
        return out


def library_encoder(path: str, keeps_space: bool) -> TextEncoder:
    """The encoder of a tokenizer file; special tokens' strings in a text are ordinary text."""

    def load():
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        library = Tokenizer.from_file(path)
        library.encode_special_tokens = True
        joined = _Joined(library, keeps_space)
        return TextEncoder(joined.many, keeps_space, joined.memo, pieces=None if keeps_space else joined.memo)

    return once_per_worker(("library", path, keeps_space), load)
