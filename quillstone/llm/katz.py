"""Katz backoff language model: Good-Turing discounts, exactly normalised backoff weights.

Texts are words and one end; the history of the first word is a start mark.

1. Each block of documents folds its bigrams to (word, history, document,
   frequency) and deals packed arrays to shards by the predicted word.  Words
   that a sample shows to be frequent, at most HOT_WORDS, are counted exactly
   beforehand and dealt by word and history, so no shard holds a hot word.
2. A shard counts its words and bigrams over the training documents, stores
   them, and answers each block with sums by document.  What depends on
   discounts is kept as counts of counts, which wait for the whole corpus.
3. Bigram types meet again by history: shards by history add up the mass that
   discounts free and the lower-order mass of the words seen, which gives each
   history its backoff weight, stored in a table.  Bigrams that no training text
   holds, which were sent along, take the weight of their history.
4. All sums of a block are added up by document.

P(w | h) = d(r) r / (c(h) + RESERVE) for a bigram seen r times; otherwise
a(h) P(w), with P(w) = d'(c) c / N for a word seen c times and the mass that the
unigram discounts free for the unknown word.  RESERVE keeps some mass for unseen
words in histories whose every follower is frequent.  An unseen history has
weight 1.  a(h) is such that P(. | h) adds up to 1 over known words and unknown.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common
from .minhash import mix

K, RESERVE = 5, 0.5
HOT_WORDS = 1000
END, START = np.uint64(0xE17D), np.uint64(0x57A97)
_H48 = np.uint64((1 << 48) - 1)


def training(doc_id: Column) -> Column:
    """Documents that are learned from: those whose checksum modulo 7 is not 2 (a null id is)."""
    return F.coalesce(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % 7 != 2, F.lit(True))


def planes(x: np.ndarray) -> bytes:
    """Numbers by byte planes; sorted numbers then compress well."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T).tobytes()


def unplanes(raw: bytes, kind: str) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(size, -1).T).view(kind).ravel()


def word_keys(words: list[str]) -> np.ndarray:
    return mix(pd.util.hash_array(np.array(words, object), categorize=False)) if words else np.zeros(0, np.uint64)


def _hot_sample(batches):
    """Words that make up a thousandth of the sampled words of a task."""
    total: dict[str, int] = {}
    n = 0
    for b in batches:
        for t in b.column(0).to_pylist():
            w = common.SPACED_WORD.findall(common.fold(t))
            n += len(w)
            for x in w:
                total[x] = total.get(x, 0) + 1
    keep = [x for x, c in total.items() if c * HOT_WORDS > n]
    yield pa.RecordBatch.from_pydict({"word": pa.array(keep, pa.string()), "n": pa.array([total[x] for x in keep], pa.int64())})


def _hot_counts(hot: list[str]):
    """Training counts of the hot words, and of training texts (null word)."""

    def run(batches):
        total = dict.fromkeys(hot, 0)
        texts = 0
        for b in (part for b in batches for part in common.blocks([b], 0)):
            words: Counter = Counter()
            for t in b.column(0).to_pylist():
                texts += 1
                words.update(common.SPACED_WORD.findall(common.fold(t)))
            for x in total.keys() & words.keys():
                total[x] += words[x]
        yield pa.RecordBatch.from_pydict({"word": pa.array([*total, None], pa.string()), "n": pa.array([*total.values(), texts], pa.int64())})

    return run


SENT = "shard int, block long, ids binary, train binary, lengths binary, words binary, types binary, histories binary, spread binary, docs binary, freqs binary"
_SENT = pa.schema([("shard", pa.int32()), ("block", pa.int64())] + [(c, pa.binary()) for c in ("ids", "train", "lengths", "words", "types", "histories", "spread", "docs", "freqs")])


def _send(shards: int, hot_keys: np.ndarray):
    def run(batches):
        task = TaskContext.get().partitionId()
        for k, b in enumerate(common.blocks(batches, 1, 4 << 20, 16_384)):
            block = (task << 32) | k
            lists = [common.SPACED_WORD.findall(common.fold(t)) for t in b.column(1).to_pylist()]
            train = b.column(2).to_numpy(zero_copy_only=False)
            n = np.array([len(x) + 1 for x in lists], np.int64)
            coded = pa.array([w for x in lists for w in x], pa.string()).dictionary_encode()
            keys = np.concatenate([word_keys(coded.dictionary.to_pylist()), [END, START]])
            end, start = len(keys) - 2, len(keys) - 1
            total = int(n.sum())
            last = np.cumsum(n) - 1
            word = np.full(total, end, np.int64)
            word[np.setdiff1d(np.arange(total), last, assume_unique=True)] = coded.indices.to_numpy()
            history = np.concatenate(([start], word[:-1]))
            history[last[:-1] + 1] = start
            doc = np.repeat(np.arange(len(n)), n)
            size, docs = len(keys), len(n)
            key, freq = np.unique((word * size + history) * docs + doc, return_counts=True)
            doc, pair = key % docs, key // docs
            word, history = pair // size, pair % size
            is_hot = np.isin(keys, hot_keys)
            home = mix(keys[word] + np.where(is_hot[word], mix(keys[history]), np.uint64(0)))
            shard = (home % np.uint64(shards)).astype(np.int64)
            order = np.argsort(shard, kind="stable")
            cut = np.searchsorted(shard[order], np.arange(shards + 1))
            rows = [(block % shards, block, b.column(0).fill_null(common.NULL_ID).to_numpy().astype("<i8").tobytes(), np.packbits(train).tobytes(), n.astype("<i8").tobytes(), *[None] * 6)]
            tag = (doc | (train[doc].astype(np.int64) << 15)).astype("<u2")
            for s in range(shards):
                at = order[cut[s] : cut[s + 1]]
                if not len(at):
                    continue
                p, w = pair[at], word[at]
                fresh = np.flatnonzero(np.concatenate(([True], p[1:] != p[:-1])))
                wp = w[fresh]
                word_fresh = np.flatnonzero(np.concatenate(([True], wp[1:] != wp[:-1])))
                spread = np.diff(np.append(fresh, len(at)))
                h = keys[history[at[fresh]]] & _H48
                rows.append((
                    s, block, None, None, None, keys[wp[word_fresh]].tobytes(), np.diff(np.append(word_fresh, len(wp))).astype("<u4").tobytes(),
                    h.view(np.uint8).reshape(-1, 8)[:, :6].tobytes(), planes(spread.astype("<u2")), tag[at].tobytes(), planes(freq[at].astype("<u4")),
                ))
            yield common.record(_SENT, *zip(*rows, strict=True))

    return run


#: kind: d (sums by document), t (stored bigram counts), h (types by history), p (types of hot histories), m (unseen bigrams), s (statistics).
OUT = "kind string, shard int, block long, a binary, b binary, c binary, d binary, e binary"
_OUT = pa.schema([("kind", pa.string()), ("shard", pa.int32()), ("block", pa.int64())] + [(c, pa.binary()) for c in "abcde"])
#: Columns of the counts that wait for discounts: bigrams seen 1..K times; unseen bigrams of words seen 1..K times; unknown words; unseen bigrams of known words.
WAITING = 2 * K + 2


def _sum_by(index: np.ndarray, n: int, weights: np.ndarray) -> np.ndarray:
    return np.bincount(index, weights, n)


def _count(shards: int, hot: dict[int, int]):
    hot_keys = np.array(sorted(hot), np.uint64)
    hot_h = np.sort(hot_keys & _H48)

    def run(batches):
        parts: list[dict] = []
        at_shard = 0
        for b in batches:
            for r in b.to_pylist():
                if r["ids"] is not None:
                    yield common.record(_OUT, ["d"], [0], [r["block"]], [r["ids"]], [r["train"]], [r["lengths"]], [None], [None])
                    continue
                at_shard = r["shard"]
                spread = unplanes(r["spread"], "<u2").astype(np.int64)
                types = np.frombuffer(r["types"], "<u4").astype(np.int64)
                wide = np.zeros((len(spread), 8), np.uint8)
                wide[:, :6] = np.frombuffer(r["histories"], np.uint8).reshape(-1, 6)
                parts.append({
                    "block": r["block"], "word": np.repeat(np.frombuffer(r["words"], "<u8"), types), "h": wide.view("<u8").ravel(), "spread": spread,
                    "tag": np.frombuffer(r["docs"], "<u2"), "freq": unplanes(r["freqs"], "<u4"),
                })
        if not parts:
            return
        bounds = [(p["block"], len(p["spread"]), len(p["tag"])) for p in parts]

        def joined(column: str) -> np.ndarray:
            return np.concatenate([p.pop(column) for p in parts])

        word, h, spread, tag, freq = map(joined, ("word", "h", "spread", "tag", "freq"))
        first = np.cumsum(spread) - spread
        seen = np.add.reduceat(freq.astype(np.int64) * (tag >> 15), first)
        order = np.lexsort((h, word)).astype(np.int32)
        w, hh = word[order], h[order]
        fresh_word = np.concatenate(([True], w[1:] != w[:-1]))
        fresh = fresh_word | np.concatenate(([True], hh[1:] != hh[:-1]))
        type_of, word_of = (np.cumsum(x, dtype=np.int32) - 1 for x in (fresh, fresh_word))
        r_type = np.bincount(type_of, seen[order]).astype(np.int64)
        words = w[fresh_word]
        c_word = np.bincount(word_of, seen[order]).astype(np.int64)
        is_hot = np.isin(words, hot_keys)
        c_word[is_hot] = [hot[int(x)] for x in words[is_hot]]
        r_row, c_row = np.empty(len(order), np.int64), np.empty(len(order), np.int64)
        r_row[order], c_row[order] = r_type[type_of], c_word[word_of]
        del seen, order
        # statistics: hot words are counted by the driver
        own = c_word[~is_hot]
        uni = np.bincount(np.minimum(own, K + 2), minlength=K + 3)[1:].astype("<i8")
        bi = np.bincount(np.minimum(r_type, K + 2), minlength=K + 3)[1:].astype("<i8")
        yield common.record(_OUT, ["s"], [at_shard], [0], [uni.tobytes()], [bi.tobytes()], [np.array([own.sum()], "<i8").tobytes()], [None], [None])
        # stored counts and types by history
        tw, th, tc = w[fresh], hh[fresh], c_word[word_of[fresh]]
        held = r_type > 0
        tw, th, tc, tr = tw[held], th[held], tc[held], r_type[held]
        del w, hh, fresh, fresh_word, type_of, word_of, held
        for lo in range(0, len(tw), 1 << 20):
            s = slice(lo, lo + (1 << 20))
            first = np.flatnonzero(np.concatenate(([True], tw[s][1:] != tw[s][:-1]))) if len(tw[s]) else np.zeros(0, np.int64)
            yield common.record(_OUT, ["t"], [at_shard], [0], [tw[s][first].tobytes()], [np.diff(np.append(first, len(tw[s]))).astype("<u4").tobytes()], [np.ascontiguousarray(th[s]).view(np.uint8).reshape(-1, 8)[:, :6].tobytes()], [planes(tr[s].astype("<u8"))], [None])
        yield from _types_by_history(th, tr, tc, shards, hot_h)
        del tw, th, tc, tr
        # sums by document
        misses = []
        type_at = at = 0
        for k, (block, t, m) in enumerate(bounds):
            e = np.repeat(np.arange(type_at, type_at + t), spread[type_at : type_at + t])
            f, d = freq[at : at + m].astype(np.int64), (tag[at : at + m] & 0x7FFF).astype(np.int64)
            at += m
            r, c, is_end = r_row[e], c_row[e], word[e] == END
            n = int(d.max()) + 1
            base = _sum_by(d, n, f * np.log10(c + 1.0))
            known = _sum_by(d, n, f * (c > 0))
            fixed = np.where(r > K, np.log10(np.maximum(r, 1)), 0) + np.where((r == 0) & (c > K), np.log10(np.maximum(c, 1)), 0)
            fixed -= np.where(~is_end & (c > 0), np.log10(c + RESERVE), 0)
            waiting = np.zeros((n, WAITING))
            slot = np.where(r > 0, np.where(r <= K, r - 1, -1), np.where(c == 0, 2 * K, np.where(c <= K, K + c - 1, -1)))
            ok = slot >= 0
            waiting += np.bincount(d[ok] * WAITING + slot[ok], f[ok], n * WAITING).reshape(n, WAITING)
            waiting[:, 2 * K + 1] = _sum_by(d, n, f * ((r == 0) & (c > 0)))
            touched = np.unique(d)
            yield common.record(
                _OUT, ["d"], [1], [block], [touched.astype("<u2").tobytes()], [base[touched].tobytes()], [known[touched].astype("<u4").tobytes()],
                [_sum_by(d, n, f * fixed)[touched].tobytes()], [planes(waiting[touched].astype("<u4").ravel())],
            )
            miss = np.flatnonzero(r == 0)
            if len(miss):
                misses.append((h[e[miss]], np.full(len(miss), k, np.int64), d[miss], f[miss]))
            type_at += t
        if misses:
            yield _miss_rows(*(np.concatenate(x) for x in zip(*misses, strict=True)), np.array([x[0] for x in bounds], np.uint64), shards, hot_h)

    return run


def _miss_rows(h: np.ndarray, part: np.ndarray, doc: np.ndarray, freq: np.ndarray, blocks: np.ndarray, shards: int, hot_h: np.ndarray) -> pa.RecordBatch:
    """Unseen bigrams, one row for each shard of their histories; those of hot histories are spread by block."""
    to = np.where(np.isin(h, hot_h), blocks[part] % np.uint64(shards), mix(h) % np.uint64(shards)).astype(np.int64)
    order = np.lexsort((h, part, to))
    cut = np.searchsorted(to[order], np.arange(shards + 1))
    rows = []
    for s in range(shards):
        i = order[cut[s] : cut[s + 1]]
        if len(i):
            first = np.flatnonzero(np.concatenate(([True], part[i][1:] != part[i][:-1])))
            runs = np.stack([blocks[part[i[first]]], np.diff(np.append(first, len(i))).astype(np.uint64)])
            rows.append(("m", s, 0, planes(h[i]), doc[i].astype("<u2").tobytes(), planes(freq[i].astype("<u4")), runs.tobytes(), None))
    return common.record(_OUT, *zip(*rows, strict=True))


def _types_by_history(h: np.ndarray, r: np.ndarray, c: np.ndarray, shards: int, hot_h: np.ndarray):
    hot_one = np.isin(h, hot_h)
    if hot_one.any():
        names, which = np.unique(h[hot_one], return_inverse=True)
        table = _mass_counts(which, len(names), r[hot_one], c[hot_one])
        yield common.record(_OUT, ["p"], [0], [0], [names.tobytes()], [table.astype("<i8").tobytes()], [None], [None], [None])
    h, r, c = h[~hot_one], r[~hot_one], c[~hot_one]
    to = (mix(h) % np.uint64(shards)).astype(np.int64)
    order = np.lexsort((h, to))
    cut = np.searchsorted(to[order], np.arange(shards + 1))
    rows = []
    for s in range(shards):
        i = order[cut[s] : cut[s + 1]]
        if len(i):
            code = (np.minimum(r[i], K + 1) * 8 + np.minimum(c[i], K + 1)).astype(np.uint8)
            rows.append(("h", s, 0, planes(h[i]), code.tobytes(), planes(r[i][r[i] > K].astype("<u8")), planes(c[i][c[i] > K].astype("<u8")), None))
    if rows:
        yield common.record(_OUT, *zip(*rows, strict=True))


#: Per history: its count, types seen 1..K times, words seen 1..K times, and the counts of other words.
MASS = 2 * K + 2


def _mass_counts(which: np.ndarray, n: int, r: np.ndarray, c: np.ndarray) -> np.ndarray:
    out = np.zeros((n, MASS), np.int64)
    out[:, 0] = np.bincount(which, r, n)
    for k in range(1, K + 1):
        out[:, k] = np.bincount(which, r == k, n)
        out[:, K + k] = np.bincount(which, c == k, n)
    out[:, -1] = np.bincount(which, np.where(c > K, c, 0), n)
    return out


def good_turing(n: np.ndarray) -> np.ndarray:
    """Discounts of counts 1..K from the numbers of types seen 1..K+1 times (Katz's form).

    Where they are not all strictly between 0 and 1, as in tiny or odd corpora,
    an absolute discount from the first two numbers takes their place.
    """
    r = np.arange(1, K + 1, dtype=float)
    n = np.asarray(n, float)
    if (n[: K + 1] > 0).all():
        top = (K + 1) * n[K] / n[0]
        d = ((r + 1) * n[1 : K + 1] / (r * n[:K]) - top) / (1 - top) if top < 1 else np.zeros(K)
        if ((d > 0) & (d < 1)).all():
            return d
    off = n[0] / (n[0] + 2 * n[1]) if n[0] and n[1] else 0.5
    return (r - off) / r


@dataclass
class Model:
    tokens: int
    vocabulary: int
    texts: int
    unigram: np.ndarray
    bigram: np.ndarray
    unknown: float
    hot: dict[int, float]

    def lower_mass(self, counts: np.ndarray) -> np.ndarray:
        """Unigram mass of the words counted in rows of MASS columns."""
        weights = np.arange(1, K + 1) * self.unigram
        return (counts[:, K + 1 : 2 * K + 1] @ weights + counts[:, -1]) / self.tokens

    def backoff(self, counts: np.ndarray) -> np.ndarray:
        """log10 of the backoff weights of histories counted in rows of MASS columns."""
        freed = counts[:, 1 : K + 1] @ (np.arange(1, K + 1) * (1 - self.bigram)) + RESERVE
        return np.log10(freed / (counts[:, 0] + RESERVE)) - np.log10(np.maximum(1 - self.lower_mass(counts), 1e-300))

    def correction(self, counts: np.ndarray) -> np.ndarray:
        """What an unseen bigram adds for its history: the weight, without the history's count that every token took off."""
        return self.backoff(counts) + np.log10(counts[:, 0] + RESERVE)


SUMS = "block long, docs binary, sums binary"
_SUMS = pa.schema([("block", pa.int64()), ("docs", pa.binary()), ("sums", pa.binary())])
WEIGHTS = "kind string, block long, docs binary, sums binary"


def _weigh(shared):
    """Backoff weights of a shard's histories (kind w: history, log10 weight), and sums of unseen bigrams (kind d)."""

    def run(batches):
        model: Model = shared.value
        types, misses = [], []
        for b in batches:
            for r in b.to_pylist():
                (types if r["kind"] == "h" else misses).append(r)
        h = np.concatenate([unplanes(r["a"], "<u8") for r in types] or [np.zeros(0, np.uint64)])
        code = np.concatenate([np.frombuffer(r["b"], np.uint8) for r in types] or [np.zeros(0, np.uint8)]).astype(np.int64)
        r, c = code >> 3, code & 7
        for which, column in ((r, "c"), (c, "d")):
            which[which > K] = np.concatenate([unplanes(x[column], "<u8") for x in types] or [np.zeros(0, np.uint64)])
        names, index = np.unique(h, return_inverse=True)
        counts = _mass_counts(index, len(names), r, c)
        weight = model.backoff(counts)
        schema = pa.schema([("kind", pa.string()), ("block", pa.int64()), ("docs", pa.binary()), ("sums", pa.binary())])
        if len(names):
            yield common.record(schema, ["w"], [0], [planes(names)], [weight.tobytes()])
        fix = model.correction(counts)
        hot = np.array(sorted(model.hot), np.uint64)
        hot_fix = np.array([model.hot[int(x)] for x in hot])
        fixes: dict[int, list] = {}
        for m in misses:
            hm = unplanes(m["a"], "<u8")
            doc, f = np.frombuffer(m["b"], "<u2").astype(np.int64), unplanes(m["c"], "<u4")
            value = np.zeros(len(hm))
            for known, amount in ((names, fix), (hot, hot_fix)):
                if len(known):
                    k = np.minimum(np.searchsorted(known, hm), len(known) - 1)
                    value += np.where(known[k] == hm, amount[k], 0)
            blocks, lengths = np.frombuffer(m["d"], "<u8").reshape(2, -1)
            ends = np.cumsum(lengths.astype(np.int64)).tolist()
            for block, lo, hi in zip(blocks.tolist(), [0, *ends[:-1]], ends, strict=True):
                fixes.setdefault(block, []).append((doc[lo:hi], value[lo:hi] * f[lo:hi]))
        rows = []
        for block, got in sorted(fixes.items()):
            doc, value = (np.concatenate(x) for x in zip(*got, strict=True))
            total = np.bincount(doc, value)
            touched = np.unique(doc)
            rows.append(("d", block, touched.astype("<u2").tobytes(), total[touched].tobytes()))
        if rows:
            yield common.record(schema, *zip(*rows, strict=True))

    return run


SCORED = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"
_SCORED = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])


def _finish(tokens: int, vocabulary: int, texts: int, unigram: np.ndarray, bigram: np.ndarray, unknown: float):
    r = np.arange(1, K + 1)
    # log10 of what each waiting count stands for
    waits = np.concatenate([np.log10(bigram * r), np.log10(unigram * r), [np.log10(unknown)], [-np.log10(max(tokens, 1))]])

    def run(rows: pa.Table) -> pa.Table:
        got = sorted(rows.to_pylist(), key=lambda x: (x["shard"], x["a"] or b"", x["b"] or b""))
        head = next(x for x in got if x["shard"] == 0)
        ids, n_tokens = np.frombuffer(head["a"], "<i8"), np.frombuffer(head["c"], "<i8")
        n = len(ids)
        train = np.unpackbits(np.frombuffer(head["b"], np.uint8), count=n).astype(bool)
        base, known, score, waiting = np.zeros(n), np.zeros(n, np.int64), np.zeros(n), np.zeros((n, WAITING))
        for x in got:
            if x["shard"] == 1:
                d = np.frombuffer(x["a"], "<u2")
                base[d] += np.frombuffer(x["b"], "<f8")
                known[d] += np.frombuffer(x["c"], "<u4")
                score[d] += np.frombuffer(x["d"], "<f8")
                waiting[d] += unplanes(x["e"], "<u4").reshape(len(d), WAITING)
            elif x["shard"] == 2:
                score[np.frombuffer(x["a"], "<u2")] += np.frombuffer(x["b"], "<f8")
        score += waiting @ waits
        if texts:
            score -= np.log10(texts + RESERVE)  # the start mark is each text's first history
        base -= n_tokens * np.log10(tokens + vocabulary + 1.0)
        return pa.Table.from_batches([common.record(_SCORED, pa.array(ids, mask=ids == common.NULL_ID), ~train, n_tokens, known, base, score)])

    return run


def score(docs: DataFrame, sample: int = 64) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Null and empty texts have one token, the end.  Repeated rows are counted
    and scored each; a row without doc_id is learned from.  One row in
    ``sample``, by a hash, shows which words to spread over shards; that
    changes how work is dealt, never a result.  With nothing to learn from,
    every word is unknown and has probability 1.
    """
    spark = docs.sparkSession
    shards = common.partitions(spark)
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), training(F.col("doc_id")).alias("train"))
    few = rows.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(sample)) == 0).select("text").mapInArrow(common.tidy(_hot_sample), "word string, n long")
    named = [r["word"] for r in few.groupBy("word").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "word").limit(HOT_WORDS).collect()]
    counted = rows.where("train").select("text").mapInArrow(common.tidy(_hot_counts(named)), "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    exact = {r["word"]: r["n"] for r in counted}
    texts = exact.pop(None, 0)
    hot = {int(k): exact.get(w, 0) for w, k in zip(named, word_keys(named), strict=True)}
    hot |= {int(END): texts, int(START): texts}
    dealt = common.deal(rows.mapInArrow(common.tidy(_send(shards, np.array(list(hot), np.uint64))), SENT), "shard")
    made = common.scratch(dealt.mapInArrow(common.tidy(_count(shards, hot)), OUT), "katz", "kind")

    uni, bi, tokens = np.zeros(K + 2, np.int64), np.zeros(K + 2, np.int64), 0
    for r in made.where("kind = 's'").select("a", "b", "c").toLocalIterator():
        uni += np.frombuffer(r["a"], "<i8")
        bi += np.frombuffer(r["b"], "<i8")
        tokens += int(np.frombuffer(r["c"], "<i8")[0])
    for key, n in hot.items():
        if key != int(START) and n:
            uni[min(n, K + 2) - 1] += 1
            tokens += n
    vocabulary = int(uni.sum())
    d1, d2 = good_turing(uni[: K + 1]), good_turing(bi[: K + 1])
    freed = float((uni[:K] * np.arange(1, K + 1) * (1 - d1)).sum())
    if tokens and not freed:
        freed = RESERVE  # no rare word at all: the unknown word gets a share, and the rest is scaled with it
    model = Model(max(tokens, 1), vocabulary, texts, d1, d2, freed / tokens if tokens else 1.0, {})
    partial = {}
    for r in made.where("kind = 'p'").select("a", "b").mapInArrow(common.tidy(_hot_rows), "history long, counts array<long>").groupBy("history").agg(*[F.sum(F.col("counts")[i]).alias(f"c{i}") for i in range(MASS)]).collect():
        partial[r["history"] & ((1 << 64) - 1)] = np.array([r[f"c{i}"] for i in range(MASS)], float)
    if partial:
        model.hot = dict(zip(partial, model.correction(np.stack(list(partial.values()))).tolist(), strict=True))
    routed = common.deal(made.where("kind IN ('h', 'm')").select("kind", "shard", "block", "a", "b", "c", "d"), "shard")
    weighed = common.scratch(routed.mapInArrow(common.tidy(_weigh(spark.sparkContext.broadcast(model))), WEIGHTS), "weights", "kind")
    corrections = weighed.where("kind = 'd'").select(F.lit(2).alias("shard"), "block", F.col("docs").alias("a"), F.col("sums").alias("b"), *[F.lit(None).cast("binary").alias(c) for c in "cde"])
    sums = made.where("kind = 'd'").select("shard", "block", *"abcde").unionByName(corrections)
    out = sums.groupBy("block").applyInArrow(common.tidy_group(_finish(tokens, vocabulary, texts, d1, d2, model.unknown)), SCORED)
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(tokens).cast("long").alias("train_tokens"), "base_score", "score")


def _hot_rows(batches):
    for b in batches:
        for r in b.to_pylist():
            names = np.frombuffer(r["a"], "<i8")
            yield pa.RecordBatch.from_pydict({"history": pa.array(names), "counts": pa.array(np.frombuffer(r["b"], "<i8").reshape(len(names), MASS).tolist(), pa.list_(pa.int64()))})
