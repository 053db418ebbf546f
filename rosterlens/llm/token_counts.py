"""Token counts by heap-and-linked-list byte-pair merging, without any ids.

A piece starts as a linked list of one symbol a byte. A heap holds the adjacent pairs that may merge, by
rank and place; the lowest leaves it again and again, its right symbol is unlinked and the two new
neighbouring pairs enter. The piece's count is its symbols less its merges. White space parts pieces in
this kind of vocabulary, so each word is counted once and kept for the words to come.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .common import Memo, arrow_long, once_per_worker, text_slices, words_of

#: Text counted at once, for bounded memory.
SLICE_BYTES = 2_000_000
#: Words longer than this are counted anew each time, so that kept words stay short.
KEPT_BYTES = 64
_PLAIN = re.compile(r"[!-~]+")
#: The vocabulary's splitting pattern for printable ASCII in lower case.
_PLAIN_PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^a-z0-9]+")


class MergeCounter:
    """Counts of words under a byte-pair vocabulary file with word ends.

    The file's own normalizer and splitting rule are applied by its library; merging is done here.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            held = json.load(file)
        model = held["model"]
        end = model["end_of_word_suffix"]
        if model.get("type", "BPE") != "BPE" or not end or model["continuing_subword_prefix"] or model["unk_token"]:
            raise ValueError("only byte-pair vocabularies with word ends and no unknown token are counted")
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] for t in held["added_tokens"]):
            raise ValueError("added tokens must be plain strings")
        library = Tokenizer.from_file(path)
        self.normalize, self.split = library.normalizer.normalize_str, library.pre_tokenizer.pre_tokenize_str
        self.plain_rule = "[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+" in json.dumps(held["pre_tokenizer"]).replace("\\\\", "\\")
        special = sorted((t["content"] for t in held["added_tokens"]), key=len, reverse=True)
        self.special = re.compile("|".join(map(re.escape, special))) if special else None
        vocab = self.vocab = model["vocab"]
        self.last = {t[:-len(end)]: i for t, i in vocab.items() if t.endswith(end)}
        self.shift = len(vocab).bit_length()
        self.rank, self.made = {}, []
        for rank, pair in enumerate(model["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            self.rank.setdefault(vocab[left] << self.shift | vocab[right], rank)
            self.made.append(vocab[left + right])
        self.pieces = Memo(lambda pieces: dict(zip(pieces, map(self.merged, pieces), strict=True)))
        self.words = Memo(self._counted)

    def merged(self, piece: str) -> int:
        """Symbols left of a piece when no pair of it merges any more."""
        n = len(piece)
        if n == 1:
            return 1
        symbol = [*map(self.vocab.__getitem__, piece[:-1]), self.last[piece[-1]]]
        shift, rank_of, made = self.shift, self.rank.get, self.made
        heap = [rank << 32 | i for i in range(n - 1) if (rank := rank_of(symbol[i] << shift | symbol[i + 1])) is not None]
        heapify(heap)
        after, before, merges = list(range(1, n + 1)), list(range(-1, n - 1)), 0
        while heap:
            top = heappop(heap)
            rank, i = top >> 32, top & 0xFFFFFFFF
            j = after[i]
            if symbol[i] < 0 or j == n or rank_of(symbol[i] << shift | symbol[j]) != rank:
                continue  # one of the two has merged otherwise since
            symbol[i], symbol[j] = made[rank], -1
            merges += 1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (rank := rank_of(symbol[i] << shift | symbol[k])) is not None:
                    heappush(heap, rank << 32 | i)
            h = before[i]
            if h >= 0 and (rank := rank_of(symbol[h] << shift | symbol[i])) is not None:
                heappush(heap, rank << 32 | h)
        return n - merges

    def _pieces(self, word: str) -> tuple[int, list[str]]:
        """Special strings in the word, and the pieces of what is between them."""
        found, parts = 0, [word]
        if self.special and "<" in word:
            parts = self.special.split(word)
            found = len(parts) - 1
        pieces: list[str] = []
        for part in parts:
            if self.plain_rule and _PLAIN.fullmatch(part):
                pieces += _PLAIN_PIECES.findall(part.lower())
            elif part:
                pieces += [p for p, _ in self.split(self.normalize(part))]
        return found, pieces

    def _counted(self, words: list[str]) -> dict[str, int]:
        cut = list(map(self._pieces, words))
        known = self.pieces.holding({p for _, pieces in cut for p in pieces if len(p) <= KEPT_BYTES})
        of = lambda p: known[p] if len(p) <= KEPT_BYTES else self.merged(p)
        return {w: found + sum(map(of, pieces)) for w, (found, pieces) in zip(words, cut, strict=True)}

    def counts(self, texts: pa.Array) -> np.ndarray:
        """Tokens of each text, a null text none."""
        out = []
        for part in text_slices(texts, SLICE_BYTES):
            words = words_of(part)
            unique = words.unique.to_pylist()
            short = {w for w in unique if len(w) <= KEPT_BYTES}
            known = self.words.holding(short)
            long = self._counted([w for w in unique if w not in short])
            of_word = np.fromiter((known[w] if w in short else long[w] for w in unique), np.int64, len(unique))
            upto = np.concatenate([[0], np.cumsum(of_word[words.code])])
            out.append(np.diff(upto[words.bounds]))
        return np.concatenate(out) if out else np.zeros(0, np.int64)


def count_tokens(df: DataFrame, path: str, limit: int = 2048, text: str = "text") -> DataFrame:
    """The rows without their text, with `n_bytes` (UTF-8), `n_tokens` and `over_limit` (more than `limit` tokens).

    Counts are those of the vocabulary's library without begin, end or added tokens; its special strings
    inside a text are one token each. Null and empty texts have no bytes and no tokens; a text of any
    length is counted whole; repeated rows and nulls elsewhere stay as they are; an empty table gives no
    rows. Columns of the three names are replaced.
    """
    made = ("n_bytes", "n_tokens", "over_limit")
    kept = [c for c in df.columns if c != text and c not in made]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = once_per_worker(("counts", path), lambda: MergeCounter(path))
        for batch in batches:
            if batch.num_rows:
                texts = batch.column(0)
                n = counter.counts(texts)
                size = pc.cast(pc.binary_length(pc.fill_null(texts, "")), pa.int64())
                yield pa.RecordBatch.from_arrays([*batch.columns[1:], size, arrow_long(n), pa.array(n > limit)], names=[*kept, *made])

    schema = df.select(*kept).schema.add("n_bytes", "long").add("n_tokens", "long").add("over_limit", "boolean")
    return df.select(text, *kept).mapInArrow(run, schema)
