"""Language of whole texts by a linear-chain conditional random field over their words.

Each word has a label. Its features are the n-grams of its bytes with marks at both ends (those with
a mark are its affixes) and its entries in the lexicons of frequent words; learned transitions tie it
to its neighbours, so that a word common to two languages follows its surroundings and a text that
changes language does so in one place. Forward-backward gives each word's label probabilities; a
text's language is the one with the largest share of them.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, remainder, text_slices, words_of
from .simhash import _ranges

GRAMS = (1, 2, 3, 4)
BUCKETS = 1 << 16
UNKNOWN = "und"
_STEP = 32
#: Text labelled at once, for bounded memory.
SLICE_BYTES = 1_500_000


def letter_words(texts: pa.Array) -> Words:
    """The words with a letter, in lower case."""
    words = words_of(texts)
    lowered = pc.utf8_lower(words.unique)
    has = pc.match_substring_regex(lowered, r"\p{L}").to_numpy(zero_copy_only=False)
    keep = has[words.code]
    bounds = np.concatenate([[0], np.cumsum(keep)])[words.bounds]
    return Words(lowered.take(pa.array(words.code[keep])), bounds)


def word_features(unique: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(feature of each n-gram, bounds of each word among them, hash of each word), all by array arithmetic."""
    raw = unique.cast(pa.binary())
    n = len(raw)
    sizes = pc.binary_length(raw).to_numpy(zero_copy_only=False).astype(np.int64)
    data = np.frombuffer(b"".join(raw.to_pylist()), np.uint8)
    marked = np.full(len(data) + 2 * n, 256, dtype=np.uint64)  # 256 before and after each word
    begins = np.concatenate([[0], np.cumsum(sizes + 2)])
    marked[_ranges(begins[:-1] + 1, sizes)] = data
    odd = np.uint64(0x9E3779B97F4A7C15)
    hashed, of = [], []
    value = np.zeros(len(marked), dtype=np.uint64)
    for k in range(max(GRAMS)):
        value = value[:len(marked) - k] * odd + marked[k:] + np.uint64(1)
        counts = np.maximum(sizes + 2 - k, 0)
        at = _ranges(begins[:-1], counts)
        if k + 1 in GRAMS:
            hashed.append(((value[at] * odd) >> np.uint64(40)) % np.uint64(BUCKETS))
            of.append(np.repeat(np.arange(n), counts))
    of = np.concatenate(of)
    order = np.argsort(of, kind="stable")
    features = np.concatenate(hashed).astype(np.int64)[order]
    bounds = np.searchsorted(of[order], np.arange(n + 1))
    powers = np.cumprod(np.full(int(sizes.max(initial=0)) + 2, odd))
    word_hash = np.add.reduceat(marked * powers[_ranges(np.zeros(n, np.int64), sizes + 2)], begins[:-1]) if n else np.zeros(0, np.uint64)
    return features, bounds, word_hash


def word_blocks(unique: pa.Array, most: int = 20_000) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The features of `most` words at a time."""
    for i in range(0, len(unique), most):
        features, bounds, hashes = word_features(unique.slice(i, most))
        yield features.astype(np.int32), bounds, hashes


def emissions(model: dict, blocks: Iterable[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> np.ndarray:
    """Score of each label for each different word."""
    return np.concatenate([np.zeros((0, len(model["labels"]))), *(_emitted(model, *block) for block in blocks)])


def _emitted(model: dict, features: np.ndarray, bounds: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    scores = np.add.reduceat(model["grams"][features], bounds[:-1], axis=0)  # a word has at least its marks
    return scores / np.sqrt(np.diff(bounds))[:, None] + lexicon_entries(model, hashes)


def lexicon_entries(model: dict, hashes: np.ndarray) -> np.ndarray:
    known = model["lexicon"]
    if not len(known):
        return np.zeros((len(hashes), len(model["labels"])))
    at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
    return np.where((known[at] == hashes)[:, None], model["entries"][at], 0.0)


def forward_backward(scores: np.ndarray, bounds: np.ndarray, transitions: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Label probabilities of every word, and the expected number of each transition.

    Texts are cut into runs of _STEP words; all runs advance together. Products of a run's matrices
    carry the states from run to run within a text, so a very long text needs few steps.
    """
    n, labels = scores.shape
    if not n:
        return np.zeros((0, labels)), np.zeros((labels, labels))
    e = np.exp(scores - scores.max(axis=1, keepdims=True))
    a = np.exp(transitions)
    counts = np.diff(bounds)
    runs = -(-counts // _STEP)
    first_run = np.concatenate([[0], np.cumsum(runs)])
    run_text = np.repeat(np.arange(len(counts)), runs)
    nth = np.arange(first_run[-1]) - first_run[run_text]
    begin = bounds[run_text] + nth * _STEP
    size = np.minimum(_STEP, bounds[run_text + 1] - begin)
    m, first = len(begin), np.flatnonzero(nth == 0)
    at = np.minimum(begin[:, None] + np.arange(_STEP), n - 1)
    inside = np.arange(_STEP) < size[:, None]
    potential = np.where(inside[:, :, None], e[at], 1.0)

    def scaled(x: np.ndarray, axes) -> np.ndarray:
        return x / x.sum(axis=axes, keepdims=True)

    product = np.broadcast_to(np.eye(labels), (m, labels, labels)).copy()
    for j in range(_STEP):
        stepped = (product.reshape(-1, labels) @ a).reshape(m, labels, labels) * potential[:, j][:, None, :]
        if j == 0:  # a text's first word has no transition before it
            stepped[first] = product[first] * potential[first, 0][:, None, :]
        product = np.where(inside[:, j][:, None, None], scaled(stepped, (1, 2)), product)
    # entering: state before a run; leaving: what follows it
    entering, leaving = np.full((m, labels), 1.0 / labels), np.ones((m, labels))
    depth = int(runs.max())
    by_depth = np.argsort(nth, kind="stable")
    cuts = np.searchsorted(nth[by_depth], np.arange(depth + 1))
    for k in range(1, depth):
        r = by_depth[cuts[k]:cuts[k + 1]]
        entering[r] = scaled(np.einsum("ri,rij->rj", entering[r - 1], product[r - 1]), 1)
    for k in range(depth - 1, 0, -1):
        r = by_depth[cuts[k]:cuts[k + 1]]
        leaving[r - 1] = scaled(np.einsum("rij,rj->ri", product[r], leaving[r]), 1)
    alpha = np.empty((m, _STEP, labels))
    state = entering
    for j in range(_STEP):
        stepped = (state @ a) * potential[:, j]
        if j == 0:
            stepped[first] = potential[first, 0]
        state = np.where(inside[:, j][:, None], scaled(stepped, 1), state)
        alpha[:, j] = state
    gamma = np.empty((m, _STEP, labels))
    expected = np.zeros((labels, labels))
    beta = leaving
    for j in range(_STEP - 1, -1, -1):
        here = inside[:, j]
        gamma[:, j] = scaled(alpha[:, j] * beta, 1)
        weighted = potential[:, j] * beta
        before = alpha[:, j - 1] if j else entering
        pair = before[:, :, None] * a * weighted[:, None, :]
        real = here if j else here & (nth > 0)  # the first word of a text has nothing before it
        expected += (pair / pair.sum(axis=(1, 2), keepdims=True))[real].sum(axis=0)
        beta = np.where(here[:, None], scaled(weighted @ a.T, 1), beta)
    return gamma[inside], expected


def _parts_of(bounds: np.ndarray, most: int = 200_000) -> Iterator[tuple[int, int]]:
    """Consecutive texts of about `most` words together (one text at least): all of them, a part at a time for bounded memory."""
    a = 0
    while a < len(bounds) - 1:
        b = max(a + 1, int(np.searchsorted(bounds, bounds[a] + most, "right")) - 1)
        yield a, b
        a = b


def train(words: Words, label_of_text: np.ndarray, labels: list[str], rounds: int = 20, rate: float = 0.3, lexicon: int = 300) -> dict:
    """Fits the field by gradient steps (Adam) on the likelihood of each word carrying its text's label."""
    k, n_words = len(labels), len(words.code)
    blocks = list(word_blocks(words.unique))
    hashes = np.concatenate([np.zeros(0, np.uint64), *(h for _, _, h in blocks)])
    gold = label_of_text[words.row]
    counts = np.bincount(words.code * k + gold, minlength=len(words.unique) * k).reshape(-1, k)
    frequent = np.unique(np.concatenate([np.argsort(-counts[:, j], kind="stable")[:lexicon] for j in range(k)])) if n_words else np.zeros(0, np.int64)
    frequent = frequent[np.argsort(hashes[frequent], kind="stable")]
    # a label weighs as much as any other, however many words it has
    weight = np.divide(n_words / k, counts.sum(0), out=np.zeros(k), where=counts.sum(0) > 0)
    model = {"labels": labels, "grams": np.zeros((BUCKETS, k)), "lexicon": hashes[frequent], "entries": np.zeros((len(frequent), k)), "moves": 2.0 * np.eye(k)}
    state = {p: [np.zeros_like(model[p]), np.zeros_like(model[p])] for p in ("grams", "entries", "moves")}
    moved = np.zeros((k, k))
    np.add.at(moved, (label_of_text, label_of_text), np.maximum(words.counts - 1, 0))
    for step in range(1, rounds + 1 if n_words else 1):
        per_word = emissions(model, blocks)
        excess, expected = -counts * weight, np.zeros((k, k))
        for a, b in _parts_of(words.bounds):
            at = slice(words.bounds[a], words.bounds[b])
            code, w = words.code[at], weight[gold[at]]
            gamma, moves = forward_backward(per_word[code], words.bounds[a:b + 1] - words.bounds[a], model["moves"])
            excess += np.stack([np.bincount(code, gamma[:, j] * w, len(words.unique)) for j in range(k)], axis=1)
            expected += moves
        excess /= n_words
        grams, begin = 1e-7 * model["grams"], 0
        for features, bounds, _ in blocks:
            counted = np.diff(bounds)
            spread = np.repeat(excess[begin:begin + len(counted)] / np.sqrt(counted)[:, None], counted, axis=0)
            grams += np.stack([np.bincount(features, spread[:, j], BUCKETS) for j in range(k)], axis=1)
            begin += len(counted)
        slopes = {"grams": grams, "entries": excess[frequent] + 1e-7 * model["entries"], "moves": (expected - moved) / n_words + 1e-3 * model["moves"]}
        for p, g in slopes.items():
            mean, square = state[p]
            mean += 0.1 * (g - mean)
            square += 0.01 * (g * g - square)
            model[p] = model[p] - (rate if p != "moves" else 0.05) * (mean / (1 - 0.9 ** step)) / (np.sqrt(square / (1 - 0.99 ** step)) + 1e-9)
    return model


def fit(docs: DataFrame, most: int = 4_000) -> dict:
    """A field learned from text and non-null lang of documents whose remainder is not 2.

    Fits in one task on a bounded sample of about `most` documents at most, the same number for each
    language where there are enough, chosen by a hash of doc_id; whole texts of them. Languages seen
    in no such document aren't learned.
    """
    taught = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (remainder(F.col("doc_id"), 4) != 2)).select("doc_id", "lang", "text")
    sizes = {r["lang"]: r["count"] for r in taught.groupBy("lang").count().collect()}  # one row a language
    if not sizes:
        return {"labels": [], "grams": np.zeros((BUCKETS, 0)), "lexicon": np.zeros(0, np.uint64), "entries": np.zeros((0, 0)), "moves": np.zeros((0, 0))}
    labels, each = sorted(sizes), max(1, most // len(sizes))
    below = F.create_map(*(F.lit(x) for name in labels for x in (name, int(1_000_000 * each / sizes[name]) + 1)))
    chosen = taught.where(F.pmod(F.xxhash64(F.lit("sample"), "doc_id"), F.lit(1_000_000)) < below[F.col("lang")])

    def fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, langs = [], []
        for batch in batches:
            texts.append(batch.column("text"))
            langs += batch.column("lang").to_pylist()
        if not texts:
            return
        place = {name: i for i, name in enumerate(labels)}
        model = train(letter_words(pa.concat_arrays(texts)), np.array([place[x] for x in langs]), labels)
        yield pa.RecordBatch.from_arrays([pa.array([model[p].astype(t).tobytes()]) for p, t in _PARTS], names=[p for p, _ in _PARTS])

    row = chosen.repartition(1).sortWithinPartitions("doc_id", "lang", "text").mapInArrow(  # the same fit however the rows arrive
        fitted, ", ".join(f"{p} binary" for p, _ in _PARTS)).first()
    k = len(labels)
    parts = {p: np.frombuffer(row[p], t) for p, t in _PARTS}
    return {"labels": labels} | {p: v if p == "lexicon" else v.reshape(-1, k) for p, v in parts.items()}


_PARTS = (("grams", "<f4"), ("lexicon", "<u8"), ("entries", "<f8"), ("moves", "<f8"))


def predict(docs: DataFrame, model: dict) -> DataFrame:
    """Adds lang_pred and score (the language's share of the words, 0 to 1) to the documents, all whole texts.

    Null texts, texts without a letter and all texts when nothing was learned get `und` and 0. Ties go
    to the first language by name; other columns, nulls and repeated rows stay.
    """
    kept = [c for c in docs.columns if c not in ("lang_pred", "score")]
    shared = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS rows and the lexicons

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        labels = np.array(model["labels"], dtype=object)
        for batch in batches:
            langs, scores = [], []
            for part in text_slices(batch.column("text"), SLICE_BYTES):
                words = letter_words(part)
                if not len(labels):
                    langs.append(np.full(len(part), UNKNOWN, dtype=object))
                    scores.append(np.zeros(len(part)))
                    continue
                gamma, _ = forward_backward(emissions(model, word_blocks(words.unique))[words.code], words.bounds, model["moves"])
                counts = words.counts
                share = np.zeros((len(part), len(labels)))
                full = np.flatnonzero(counts)
                if len(full):
                    share[full] = np.add.reduceat(gamma, words.bounds[full], axis=0) / counts[full][:, None]
                best = share.argmax(axis=1)
                langs.append(np.where(counts > 0, labels[best], UNKNOWN))
                scores.append(np.clip(share[np.arange(len(part)), best], 0, 1))
            if langs:
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(np.concatenate(langs), pa.string()), pa.array(np.concatenate(scores))], names=[*kept, "lang_pred", "score"])

    return docs.mapInArrow(run, docs.select(*kept).schema.add("lang_pred", "string").add("score", "double"))
