"""Toxicity by nearest labelled examples under exact TF-IDF cosine.

A bounded sample of labelled rows (``max_examples``, the least by a hash of
doc_id) gives the examples.  Terms are whole words and word beginnings of four
and five letters; every term of the examples is indexed, and every text that
shares a term with an example is compared with all examples.  A term weighs its
IDF times a factor that grows with its label odds and is never 0.  The index is
an inverted one with block maxima: postings (example, weight) of all but the
frequent terms are added up, and the frequent terms, whose postings are long and
whose weights are small, have their greatest weight in each block of examples;
blocks and examples that cannot reach the k-th nearest are skipped.  All sums
are in double precision, so the k nearest are exact.  Distance-weighted votes are calibrated by a logistic fitted on leave-one-out
votes of the examples.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: Letters of the word beginnings that are terms beside the words.
BEGINNINGS = (4, 5)
#: Text that is read to terms at once: their arrays take a hundred times as much.
READ_BYTES = 1 << 19
SCORED = "doc_id long, score double, nearest_id long, nearest_cosine double, evidence string"
_SCORED = pa.schema([("doc_id", pa.int64()), ("score", pa.float64()), ("nearest_id", pa.int64()), ("nearest_cosine", pa.float64()), ("evidence", pa.string())])


def _offsets(values: pa.Array) -> np.ndarray:
    """Where the values of an array of strings or bytes begin, and the end of the last."""
    wide = pa.types.is_large_binary(values.type)
    return np.frombuffer(values.buffers()[1], "<i8" if wide else "<i4")[values.offset : values.offset + len(values) + 1].astype(np.int64)


#: What a byte becomes before texts are parted: A-Z the lower letter, ASCII that is no letter a space; bytes of other characters stay.
_FOLDED = np.array([c if c > 127 else ord(chr(c).lower()) if chr(c).isalpha() else 32 for c in range(256)], np.uint8)


def split(texts: pa.Array) -> tuple[np.ndarray, pa.DictionaryArray]:
    """The words of all texts, in lower case: maximal runs of letters, one text after the other, each with its text's number.

    Texts are parted at ASCII first; only distinct parts that hold other characters are looked at letter by letter.
    """
    texts = texts.cast(pa.string()).fill_null("")
    ends = _offsets(texts)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
    plain = pa.Array.from_buffers(pa.string(), len(texts), [None, pa.py_buffer((ends - ends[0]).astype("<i4")), pa.py_buffer(_FOLDED.take(data))])
    parts = pc.ascii_split_whitespace(plain)
    found = pc.list_flatten(parts)
    some = pc.greater(pc.binary_length(found), 0)  # a text's first and last parts may be empty
    doc = np.repeat(np.arange(len(texts)), pc.list_value_length(parts).to_numpy(zero_copy_only=False))[some.to_numpy(zero_copy_only=False)]
    coded = found.filter(some).dictionary_encode()
    ascii_ = pc.string_is_ascii(coded.dictionary)
    odd = ~ascii_.to_numpy(zero_copy_only=False)
    if not odd.any():
        return doc, coded
    parts = pc.split_pattern_regex(pc.utf8_lower(coded.dictionary.filter(pa.array(odd))), r"[^\p{L}]+")
    letters = pc.list_flatten(parts)
    some = pc.greater(pc.binary_length(letters), 0)
    of = np.repeat(np.flatnonzero(odd), pc.list_value_length(parts).to_numpy(zero_copy_only=False))[some.to_numpy(zero_copy_only=False)]
    every = pa.concat_arrays([coded.dictionary.filter(ascii_), letters.filter(some)]).dictionary_encode()
    lengths = np.where(odd, np.bincount(of, minlength=len(odd)), 1)
    starts = np.where(odd, np.count_nonzero(~odd) + np.searchsorted(of, np.arange(len(odd))), np.cumsum(~odd) - 1)
    code = coded.indices.to_numpy()
    at = _ranges(starts[code], lengths[code])
    return np.repeat(doc, lengths[code]), pa.DictionaryArray.from_arrays(every.indices.take(pa.array(at)), every.dictionary)


def words(text: str | None) -> list[str]:
    return split(pa.array([text], pa.string()))[1].to_pylist()


def term_table(known: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """All terms of distinct words, word by word for each kind of term, and the number of each one's word."""
    size = pc.utf8_length(known).to_numpy(zero_copy_only=False)
    kinds = [np.flatnonzero(size >= n) for n in (0, *BEGINNINGS)]
    terms = [pc.binary_join_element_wise("=", known, "")] + [pc.utf8_slice_codeunits(known.take(pa.array(at)), 0, n) for n, at in zip(BEGINNINGS, kinds[1:], strict=True)]
    return np.concatenate(kinds), pa.concat_arrays(terms)


def terms_of(word: str) -> tuple[str, ...]:
    return tuple(term_table(pa.array([word]))[1].to_pylist())


def _term_counts(text: str | None) -> Counter:
    out: Counter = Counter()
    for w, n in Counter(words(text)).items():
        for t in terms_of(w):
            out[t] += n
    return out


def _ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """All numbers of the ranges, one range after the other."""
    ends = np.cumsum(lengths)
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(int(ends[-1]) if len(ends) else 0)


def _frequencies(batches):
    """Negative and positive examples that hold a term, summed in the task."""
    total = (Counter(), Counter())
    for b in (part for batch in batches for part in common.blocks([batch], 0, READ_BYTES)):
        label = b.column(1).to_numpy(zero_copy_only=False).astype(bool)
        doc, coded = split(b.column(0))
        if not len(coded.dictionary):
            continue
        of, terms = term_table(coded.dictionary)
        terms = terms.dictionary_encode()
        names, of_term = terms.dictionary.to_pylist(), terms.indices.to_numpy()
        order = np.argsort(of, kind="stable")
        sizes = np.bincount(of, minlength=len(coded.dictionary))
        code = coded.indices.to_numpy()
        at = _ranges((np.cumsum(sizes) - sizes)[code], sizes[code])
        pair = np.unique(np.repeat(doc, sizes[code]) * len(names) + of_term[order[at]])
        for which, counts in enumerate(total):
            n = np.bincount(pair[label[pair // len(names)] == which] % len(names), minlength=len(names))
            counts.update({names[i]: int(n[i]) for i in np.flatnonzero(n).tolist()})
    names = list(total[0].keys() | total[1].keys())
    for at in range(0, len(names), 50_000):
        part = names[at : at + 50_000]
        yield pa.RecordBatch.from_pydict({"term": pa.array(part, pa.string()), "neg": pa.array([total[0][t] for t in part], pa.int64()), "pos": pa.array([total[1][t] for t in part], pa.int64())})


VECTORS = "doc_id long, label int, terms binary, counts binary"
_VECTORS = pa.schema([("doc_id", pa.int64()), ("label", pa.int32()), ("terms", pa.binary()), ("counts", pa.binary())])


def _vectors(shared):
    def run(batches):
        reader = Reader(shared.value)
        for b in batches:
            for part in common.blocks([b], 1, READ_BYTES):
                t, c, ends = reader.read(part.column(1))
                edge = [0, *ends.tolist()]
                t, c = ([x[lo:hi].astype("<i4").tobytes() for lo, hi in zip(edge, edge[1:], strict=False)] for x in (t, c))
                yield common.record(_VECTORS, part.column(0), part.column(2).cast(pa.int32()), t, c)

    return run


def _hashes(strings: pa.Array) -> np.ndarray:
    """A 64-bit polynomial in the bytes of each string."""
    ends = _offsets(strings)
    lengths = np.diff(ends)
    out = np.zeros(len(strings), np.uint64)
    if not len(strings) or ends[-1] == ends[0]:
        return out
    data = np.frombuffer(strings.buffers()[2], np.uint8)
    powers = np.cumprod(np.full(int(lengths.max()), 0x9E3779B97F4A7C15, np.uint64))
    for lo in range(0, len(strings), 1 << 16):  # bounds what is held at once
        part = ends[lo : lo + (1 << 16) + 1]
        some = lengths[lo : lo + (1 << 16)]
        terms = (data[part[0] : part[-1]] + np.uint64(1)) * powers[_ranges(np.zeros_like(some), some)]
        full = some > 0
        out[lo : lo + len(some)][full] = np.add.reduceat(terms, (part[:-1] - part[0])[full]) if full.any() else 0
    return out


class Lookup:
    """Places of strings among distinct names: found by hash, confirmed by comparison.

    Built once; a hash table of Arrow is built anew in each call.
    """

    def __init__(self, names: pa.Array):
        self.names = names
        hashes = _hashes(names)
        self.order = np.argsort(hashes, kind="stable").astype(np.int32)
        self.hashes = hashes[self.order]

    def find(self, strings: pa.Array) -> np.ndarray:
        """The place of each string, or -1."""
        out = np.full(len(strings), -1, np.int64)
        wanted = _hashes(strings)
        at, order = np.empty(len(wanted), np.int64), np.argsort(wanted)
        at[order] = np.searchsorted(self.hashes, wanted[order])  # in order: neighbours are near in memory
        left = np.arange(len(strings))
        while True:  # once, and again for names that share a hash
            left = left[at[left] < len(self.hashes)]
            left = left[self.hashes[at[left]] == wanted[left]]
            if not len(left):
                return out
            place = self.order[at[left]]
            same = pc.equal(self.names.take(pa.array(place)), strings.take(pa.array(left))).to_numpy(zero_copy_only=False)
            out[left[same]] = place[same]
            left = left[~same]
            at[left] += 1


class Reader:
    """Numbers and counts of texts' terms; terms that no example holds get numbers from ``size`` on, anew in each block."""

    def __init__(self, names: pa.Array):
        self.size = len(names)
        self.lookup = Lookup(names)

    def read(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of all texts, one after the other: terms in order, their counts; and the end of each text."""
        doc, coded = split(texts)
        known = max(1, len(coded.dictionary))
        of, terms = term_table(coded.dictionary)
        ids = self.lookup.find(terms)
        held = ids >= 0
        new = terms.filter(pa.array(~held)).dictionary_encode()
        ids[~held] = self.size + new.indices.to_numpy()
        ids, sizes = ids[np.argsort(of, kind="stable")], np.bincount(of, minlength=known)
        key, times = np.unique(doc * known + coded.indices.to_numpy(), return_counts=True)
        doc, word = key // known, key % known
        lengths = sizes[word]
        every = self.size + len(new.dictionary) + 1
        key = np.repeat(doc, lengths) * every + ids[_ranges((np.cumsum(sizes) - sizes)[word], lengths)]
        order = np.argsort(key, kind="stable")
        key, times = key[order], np.repeat(times, lengths)[order]
        first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, np.int64)
        counts = np.add.reduceat(times, first) if len(key) else key
        return key[first] % every, counts, np.searchsorted(key[first] // every, np.arange(len(texts)), side="right")


#: A term is frequent if one example in so many holds it.  Examples of one block, and those that are tried first.
OFTEN, BLOCK, FIRST = 16, 128, 48
#: Bytes at most of the frequent terms' dense columns; where they would take more, fewer terms count as frequent.
DENSE_BYTES = 48 << 20
#: Examples that a task of the fit votes on at least, as each task builds the index.
VOTES = 500
#: Dense rows that are copied at once.
ROWS = 512


@dataclass
class Model:
    vocabulary: pa.Array  # all terms of the examples, the most frequent first
    weight: np.ndarray
    unseen: float  # weight of a term that no example holds
    marks: np.ndarray  # terms that are likelier in positive examples
    frequent: int  # the first terms, which only bound a text until an example is a candidate
    k: int
    block: int  # texts that are scored together
    ids: np.ndarray
    labels: np.ndarray
    ends: np.ndarray  # examples that hold a term: their terms in order and counts, one after the other
    cols: np.ndarray
    counts: np.ndarray
    plain: float  # share of positives among examples that hold no term
    slope: float = 1.0
    shift: float = 0.0
    shared: Broadcast | None = None  # sent once, for the fit's votes and all scores; a worker builds its index in each task and keeps nothing

    def __getstate__(self):
        return {f: self.__dict__[f] for f in self.__dataclass_fields__ if f != "shared"}

    @property
    def names(self) -> list[str]:
        return self.vocabulary.to_pylist()

    @cached_property
    def starts(self) -> np.ndarray:
        return np.concatenate(([0], self.ends[:-1]))

    @cached_property
    def norm(self) -> np.ndarray:
        out = np.array([np.sqrt(((self.counts[a:b] * self.weight[self.cols[a:b]]) ** 2).sum()) for a, b in zip(self.starts, self.ends, strict=True)])
        return np.where(out > 0, out, 1.0)

    def _entries(self, a: int, b: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row, term and weight of the examples a to b."""
        lo, hi = self.starts[a], self.ends[b - 1]
        row = np.repeat(np.arange(a, b), (self.ends - self.starts)[a:b])
        term = self.cols[lo:hi]
        return row, term, self.counts[lo:hi] * self.weight[term] / self.norm[row]

    @property
    def matrix(self) -> np.ndarray:
        """The examples' unit rows, dense: for small models only."""
        out = np.zeros((len(self.ids), len(self.vocabulary)))
        row, term, value = self._entries(0, len(self.ids))
        out[row, term] = value
        return out

    @cached_property
    def _postings(self) -> tuple[np.ndarray, np.dtype, pa.Array]:
        """Postings of the other terms: where each term's begin in bytes, the kind of a number, and pairs of example and count as one value for each term.

        Built example by example, as each task holds an index.
        """
        n, size = len(self.ids), len(self.vocabulary)
        sizes = np.zeros(size, np.int64)
        for lo in range(0, len(self.cols), 1 << 20):
            sizes += np.bincount(self.cols[lo : lo + (1 << 20)], minlength=size)
        ends = np.concatenate(([0], np.cumsum(sizes[self.frequent :])))
        pairs = np.empty((int(ends[-1]), 2), np.result_type(np.min_scalar_type(n), self.counts.dtype))
        free = ends[:-1].copy()  # where a term's next posting goes
        for row, (lo, hi) in enumerate(zip((self.starts + self._often[0]).tolist(), self.ends.tolist(), strict=True)):
            term = self.cols[lo:hi].astype(np.int64) - self.frequent
            at = free[term]
            pairs[at, 0], pairs[at, 1] = row, self.counts[lo:hi]
            free[term] = at + 1
        ends *= 2 * pairs.itemsize
        of_term = pa.Array.from_buffers(pa.large_binary(), len(ends) - 1, [None, pa.py_buffer(ends), pa.py_buffer(pairs)])
        return ends, pairs.dtype, of_term

    @cached_property
    def _often(self) -> tuple[np.ndarray, ...]:
        """How many frequent terms each example holds, which are its first, and where they begin; these terms with their counts, example by example."""
        n = len(self.ids)
        held = np.zeros(n, np.int64)
        for lo in range(0, n, BLOCK):
            ends = self.ends[lo : lo + BLOCK] - self.starts[lo]
            less = np.concatenate(([0], np.cumsum(self.cols[self.starts[lo] : self.starts[lo] + ends[-1]] < self.frequent)))
            held[lo : lo + BLOCK] = np.diff(less[ends], prepend=0)
        at = _ranges(self.starts, held)
        return held, np.cumsum(held) - held, self.cols[at], self.counts[at]

    @cached_property
    def _dense(self) -> tuple[np.ndarray, ...]:
        """The frequent terms as dense rows, their lengths, and their greatest weight in each block of examples."""
        n = len(self.ids)
        held, first, cols, counts = self._often
        length = np.zeros(-(-n // BLOCK) * BLOCK)
        dense, top = np.zeros((n, self.frequent), np.float32), np.zeros((self.frequent, -(-n // BLOCK)))
        for lo in range(0, n, BLOCK):
            hi = min(n, lo + BLOCK)
            row = np.repeat(np.arange(lo, hi), held[lo:hi])
            part = slice(first[lo], first[hi - 1] + held[hi - 1])
            term = cols[part]
            value = counts[part] * self.weight[term] / self.norm[row]
            dense[row, term] = value
            top[:, lo // BLOCK] = dense[lo:hi].max(0)
            length[lo:hi] = np.sqrt(np.bincount(row - lo, value**2, hi - lo))
        return dense, length, top

    @property
    def _index(self) -> tuple[np.ndarray, ...]:
        return *self._postings, *self._dense

    def slim(self) -> None:
        """Keep only what searches for other texts need; for a worker's copy."""
        if len(self.cols):
            self.norm, self._postings, self._often  # noqa: B018 - built from what goes
            self.cols, self.counts = np.empty(0, self.cols.dtype), np.empty(0, self.counts.dtype)  # a slice would hold all of it
            common.give_back()  # before the dense rows are made

    @cached_property
    def _spread(self) -> np.ndarray:
        return np.zeros(self.frequent)

    def vectors(self, terms: np.ndarray, counts: np.ndarray, ends: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """Unit vectors (terms, values) of texts; terms that no example holds count in their length only."""
        held = terms < len(self.vocabulary)
        value = counts * np.where(held, self.weight[np.where(held, terms, 0)], self.unseen)
        sums = np.concatenate(([0.0], np.cumsum(value**2)))
        starts = np.concatenate(([0], ends[:-1]))
        out = []
        for a, b in zip(starts.tolist(), ends.tolist(), strict=True):
            if a == b or sums[b] == sums[a]:
                out.append((terms[:0], value[:0]))
            else:
                v, t = value[a:b], terms[a:b]
                m = int(np.searchsorted(t, len(self.vocabulary)))
                out.append((t[:m], v[:m] / math.sqrt(float(v @ v))))
        return out

    def _added(self, rows: np.ndarray) -> np.ndarray:
        """What the frequent terms of the text in ``_spread`` add for some examples, in double precision; equal examples get equal sums."""
        held, first, cols, counts = self._often
        lengths = held[rows]
        at = _ranges(first[rows], lengths)
        out, some = np.zeros(len(rows)), lengths > 0
        if some.any():
            out[some] = np.add.reduceat(self._spread[cols[at]] * counts[at], (np.cumsum(lengths) - lengths)[some])
        return out / self.norm[rows]

    def search(self, queries: list[tuple[np.ndarray, np.ndarray]], own: list[int] | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Cosines and rows of the k nearest examples of each query (terms in order, values), exactly; without the row ``own``.

        Postings of all but the frequent terms give each example a part of its
        cosine.  What the frequent terms can add is bounded for a block of
        examples by its greatest weights, and for one example by the lengths of
        the two parts.  The examples with the greatest parts are computed
        first; the k-th of them is the bar, and blocks and examples that cannot
        pass it are skipped.  Single precision picks what is computed in double.
        """
        n = len(self.ids)
        k = min(self.k, n - (own is not None))
        best, rows = np.empty((len(queries), k)), np.empty((len(queries), k), np.int64)
        ends, kind, of_term, dense, length, top = self._index
        few = min(max(FIRST, 2 * k), n)
        longest, lengths = float(length.max(initial=0)), length.reshape(-1, BLOCK)
        norm = np.concatenate([self.norm, np.ones(len(length) - n)])
        spread, single, aside = self._spread, np.zeros(self.frequent, np.float32), np.zeros(n, bool)
        error = (self.frequent + 16) * 2.0**-23  # twice what single precision can lose of a cosine
        for j, (t, v) in enumerate(queries):
            often = int(np.searchsorted(t, self.frequent))
            rare = t[often:] - self.frequent
            held = (ends[rare + 1] - ends[rare]) // (2 * kind.itemsize)
            pairs = np.frombuffer(of_term.take(pa.array(rare)).buffers()[2] or b"", kind, 2 * int(held.sum())).reshape(-1, 2)
            sims = np.bincount(pairs[:, 0], np.repeat(v[often:] * self.weight[t[often:]], held) * pairs[:, 1], len(length)) / norm
            sims[n:] = -3.0
            if own is not None:
                sims[own[j]] = -2.0
            parts = sims.reshape(-1, BLOCK)
            most = parts.max(1)
            terms, values = t[:often], v[:often]
            spread[terms], single[terms] = values * self.weight[terms], values
            # the greatest parts: none is below the greatest of each of so many blocks
            tried = np.flatnonzero(sims >= np.partition(most, len(most) - few)[len(most) - few]) if len(most) > few else np.arange(n)
            tried = tried[np.argpartition(sims[tried], len(tried) - few)[len(tried) - few :]]
            short = values.astype(np.float32) if len(terms) * 4 < self.frequent else None  # few terms: only their columns are read
            about = sims[tried] + (dense[tried] @ single if short is None else dense[tried[:, None], terms] @ short)
            bar = np.partition(about, few - k)[few - k] - error
            size = math.sqrt(float(values @ values))
            some = np.flatnonzero(most + size * longest >= bar)
            some = some[most[some] + (values @ top[terms])[some] >= bar]
            block, more = np.nonzero(parts[some] + size * lengths[some] >= bar)
            more += some[block] * BLOCK
            aside[tried] = True
            more = more[~aside[more]]
            aside[tried] = False
            if len(more):
                parts = [sims[x] + (dense[x] @ single if short is None else dense[x[:, None], terms] @ short) for x in np.split(more, range(ROWS, len(more), ROWS))]
                tried, about = np.concatenate([tried, more]), np.concatenate([about, *parts])
            maybe = tried[about >= np.partition(about, len(about) - k)[len(about) - k] - error]
            exact = sims[maybe] + self._added(maybe)
            spread[terms] = single[terms] = 0
            order = np.lexsort((maybe, -exact))[:k]
            best[j], rows[j] = exact[order], maybe[order]
        return best, rows

    def nearest(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same for dense queries over all terms."""
        return self.search([(np.flatnonzero(x), x[np.flatnonzero(x)]) for x in q])

    def vote(self, sims: np.ndarray, rows: np.ndarray) -> np.ndarray:
        w = 1 / (np.sqrt(np.maximum(0, 2 - 2 * sims)) + 0.02)
        return (w * self.labels[rows]).sum(1) / w.sum(1)

    def calibrated(self, vote: np.ndarray | float) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * (np.asarray(vote, float) - 0.5) + self.shift, -40, 40)))


def _left_out(shared):
    """The vote of all other examples on each example."""

    def run(batches):
        model: Model = shared.value
        for b in batches:
            for at in range(0, b.num_rows, model.block):
                own = b.column(0)[at : at + model.block].to_pylist()
                part = slice(model.starts[own[0]], model.ends[own[-1]])
                queries = model.vectors(model.cols[part].astype(np.int64), model.counts[part], model.ends[own] - model.starts[own[0]])
                yield pa.RecordBatch.from_pydict({"row": pa.array(own, pa.int64()), "vote": pa.array(model.vote(*model.search(queries, own)), pa.float64())})

    return run


def _platt(votes: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a logistic on votes, with Platt's smoothed targets."""
    pos = labels.sum()
    neg = len(labels) - pos
    target = np.where(labels == 1, (pos + 1) / (pos + 2), 1 / (neg + 2))
    x = np.stack([votes - 0.5, np.ones(len(votes))], 1)
    w = np.array([8.0, 0.0])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
        grad = x.T @ (p - target) + 1e-3 * w
        hess = (x * np.maximum(p * (1 - p), 1e-9)[:, None]).T @ x + 1e-3 * np.eye(2)
        step = np.linalg.solve(hess, grad)
        w -= step / max(1.0, np.abs(step).max() / 4)
        if np.abs(step).max() < 1e-9:
            break
    return (float(w[0]), float(w[1])) if w[0] > 0 else (8.0, 0.0)


def fit(docs: DataFrame, labelled: DataFrame, max_examples: int = 10_000, k: int = 11, block: int = 64) -> Model | None:
    """Fit on at most ``max_examples`` rows of ``labelled`` (doc_id, label); None without positives.

    Null labels and ids are ignored; of several labels of a document the
    greatest counts.  All terms of the sample are kept; they and the vectors
    that reach the driver are bounded by ``max_examples`` texts.
    """
    spark = docs.sparkSession
    known = labelled.where(F.col("label").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(F.col("label").cast("int")).alias("label"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_examples)
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    rows = common.scratch(texts.join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "label"), "examples")
    n, n1 = rows.count(), rows.where("label = 1").count()
    if not n1:
        return None
    n0 = n - n1
    df = rows.select("text", "label").mapInArrow(common.tidy(_frequencies), "term string, neg long, pos long").groupBy("term").agg(F.sum("neg").alias("neg"), F.sum("pos").alias("pos"))
    got = df.orderBy(F.desc(F.col("neg") + F.col("pos")), "term").toArrow()
    names = pa.concat_arrays([x.cast(pa.string()) for x in got["term"].chunks]) if got.num_rows else None
    if names is None:
        common.drop_scratch(rows)
        return None
    neg, pos = got["neg"].to_numpy(), got["pos"].to_numpy()
    # as if one more example held each term, with the sample's share of positives: a term of neither kind has odds 0
    odds = np.log((pos + n1 / n) / n1) - np.log((neg + n0 / n) / n0) if n0 else np.zeros(len(names))
    weight = np.log((1 + n) / (1 + pos + neg)) * (0.1 + np.abs(odds))
    shared = spark.sparkContext.broadcast(names)
    got = rows.mapInArrow(common.tidy(_vectors(shared), shared=shared), VECTORS).orderBy("doc_id").toArrow()
    shared.destroy()
    common.drop_scratch(rows)
    got = got.combine_chunks()  # the columns' buffers are the arrays that the model needs
    held = np.diff(_offsets(got["terms"].chunk(0))) // 4  # terms of each example
    label = got["label"].to_numpy()
    some = held > 0
    plain = np.bincount(label[~some], minlength=2).tolist()
    ids, labels, ends = got["doc_id"].to_numpy()[some], label[some], np.cumsum(held[some])
    cols, counts = (np.frombuffer(got[c].chunk(0).buffers()[2], "<i4", int(ends[-1]), int(_offsets(got[c].chunk(0))[0])) for c in ("terms", "counts"))
    cols, counts = cols.copy(), counts.astype(np.uint16 if counts.max() < 1 << 16 else np.int32)
    del got
    frequent = min(int((OFTEN * (pos + neg) >= n).sum()), DENSE_BYTES // (4 * len(ids)))
    share = (plain[1] + 0.5 * n1 / n) / (sum(plain) + 1)
    model = Model(names, weight, 0.1 * float(np.log(1 + n)), odds > 0, frequent, k, block, ids, labels, ends, cols, counts, share)
    if len(ids) > 2:
        shared = model.shared = spark.sparkContext.broadcast(model)
        # put in order here: a sort by Spark would vote twice, once for its sample
        got = spark.range(0, len(ids), 1, min(common.partitions(spark), len(ids) // VOTES + 1)).mapInArrow(common.tidy(_left_out(shared), shared=shared), "row long, vote double").toArrow()
        votes = got["vote"].to_numpy()[np.argsort(got["row"].to_numpy())]
        model.slope, model.shift = _platt(np.concatenate([votes, np.full(sum(plain), model.plain)]), np.concatenate([model.labels, np.repeat([0, 1], plain)]))
    return model


def _score(shared, slope: float, shift: float):
    def run(batches):
        model: Model = shared.value
        model.slope, model.shift = slope, shift  # fitted after the model was sent
        reader = model.__dict__.get("reader") or model.__dict__.setdefault("reader", Reader(model.vocabulary))
        model.slim()
        base = float(model.calibrated(model.plain))
        for b in common.blocks(batches, 1, READ_BYTES):
            n = b.num_rows
            score, near, cosine, evidence = np.full(n, base), [None] * n, [None] * n, [None] * n
            at, queries, told = [], [], []
            for i, (t, v) in enumerate(model.vectors(*reader.read(b.column(1)))):
                if len(t):
                    at.append(i)
                    queries.append((t, v))
                    marked = model.marks[t]
                    told.append(t[marked][np.argsort(-v[marked], kind="stable")[:5]])
            if at:
                best, end = model.vocabulary.take(pa.array(np.concatenate(told))).to_pylist(), 0
                for i, some in zip(at, told, strict=True):
                    end += len(some)
                    evidence[i] = " ".join(best[end - len(some) : end]) or None
                sims, rows = model.search(queries)
                score[at] = model.calibrated(model.vote(sims, rows))
                for j, i in enumerate(at):
                    near[i], cosine[i] = int(model.ids[rows[j, 0]]), float(sims[j, 0])
            yield common.record(_SCORED, b.column(0), score, near, cosine, evidence)

    return run


def _sent(docs: DataFrame, model: Model) -> Broadcast:
    model.shared = model.shared or docs.sparkSession.sparkContext.broadcast(model)
    return model.shared


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """(doc_id, score, nearest_id, nearest_cosine, evidence) for every row.

    Null and empty texts, and texts that share no term with any example, get the
    calibrated share of positives among examples without terms; without a model every score is 0.
    Repeated rows are scored alike; other columns are ignored.
    """
    kept = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    if model is None:
        return kept.select("doc_id", F.lit(0.0).alias("score"), F.lit(None).cast("long").alias("nearest_id"), F.lit(None).cast("double").alias("nearest_cosine"), F.lit(None).cast("string").alias("evidence"))
    shared = _sent(docs, model)
    return kept.mapInArrow(common.tidy(_score(shared, model.slope, model.shift), shared=shared), SCORED)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % 5 == 0, F.lit(False))


def toxic_labels(labels: DataFrame) -> DataFrame:
    """The rows that may be learned from: (doc_id, label)."""
    return labels.where(~held_out(F.col("doc_id"))).select(F.col("doc_id").cast("long"), F.col("toxic").alias("label"))


def _clean(shared, slope: float, shift: float, limit: float, text_at: int):
    def run(batches):
        judge = _score(shared, slope, shift)
        for b in batches:
            for part in common.blocks([b], text_at, READ_BYTES):
                pair = pa.RecordBatch.from_arrays([pa.nulls(part.num_rows, pa.int64()), part.column(text_at)], ["doc_id", "text"])
                scores = np.concatenate([x.column(1).to_numpy() for x in judge(iter([pair]))])
                yield part.filter(pa.array(scores < limit))

    return run


def drop_toxic(docs: DataFrame, model: Model | None, limit: float = 0.5) -> DataFrame:
    """The rows of ``docs``, all columns, that score below ``limit``; nothing is shuffled."""
    if model is None:
        return docs
    shared = _sent(docs, model)
    return docs.mapInArrow(common.tidy(_clean(shared, model.slope, model.shift, limit, docs.columns.index("text")), shared=shared), docs.schema)
