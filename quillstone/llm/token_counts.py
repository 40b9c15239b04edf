"""Token counts: pieces are counted once per distinct pre-token.

1. Each block of documents is split to pre-tokens; equal ones are folded to
   (pre-token, document, frequency) and dealt to shards by a hash of the
   pre-token.  A block sends one packed row to a shard, however frequent a word.
2. A shard counts the pieces of each pre-token once, joins the counts to the
   frequencies it holds, and answers each block with sums by document.
3. The sums of a block are added up.  Ids are never materialised.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .pretokens import Pieces

SENT = "shard int, block long, ids binary, bytes binary, tokens string, spread binary, docs binary, freqs binary"
ANSWER = "block long, ids binary, bytes binary, docs binary, sums binary"
COUNTED = "doc_id long, n_bytes long, n_tokens long"
_SENT = pa.schema([("shard", pa.int32()), ("block", pa.int64()), ("ids", pa.binary()), ("bytes", pa.binary()), ("tokens", pa.string()), ("spread", pa.binary()), ("docs", pa.binary()), ("freqs", pa.binary())])
_ANSWER = pa.schema([("block", pa.int64()), ("ids", pa.binary()), ("bytes", pa.binary()), ("docs", pa.binary()), ("sums", pa.binary())])


def _fold_block(pieces: Pieces, texts: list, shards: int):
    """Per shard (tokens, postings per token, docs, freqs); and the special strings of each text."""
    flat: list[str] = []
    lengths = np.zeros(len(texts), np.int64)
    direct = np.zeros(len(texts), np.int64)
    for i, text in enumerate(texts):
        if not text:
            continue
        found, specials = pieces.split(text)
        flat += found
        lengths[i], direct[i] = len(found), len(specials)
    if not flat:
        return [], direct
    coded = pa.array(flat, pa.string()).dictionary_encode()
    words = coded.dictionary.to_pylist()
    at = np.fromiter((zlib.crc32(w.encode()) % shards for w in words), np.int64, len(words))
    order = np.argsort(at, kind="stable")
    rank = np.empty(len(words), np.int64)
    rank[order] = np.arange(len(words))
    n = len(texts)
    key, freq = np.unique(rank[coded.indices.to_numpy()] * n + np.repeat(np.arange(n), lengths), return_counts=True)
    token, doc = key // n, key % n
    spread = np.bincount(token, minlength=len(words))
    ends = np.concatenate(([0], np.cumsum(spread)))
    bounds = np.searchsorted(at[order], np.arange(shards + 1))
    out = []
    for s in range(shards):
        a, b = bounds[s], bounds[s + 1]
        if a < b:
            lo, hi = ends[a], ends[b]
            out.append((s, " ".join(words[i] for i in order[a:b]), spread[a:b].astype("<u2").tobytes(), doc[lo:hi].astype("<u2").tobytes(), freq[lo:hi].astype("<u4").tobytes()))
    return out, direct


def _send(path: str, shards: int):
    def run(batches):
        pieces = Pieces(path)
        task = TaskContext.get().partitionId()
        for k, b in enumerate(common.blocks(batches, 1)):
            ids = b.column(0)
            texts = b.column(1).to_pylist()
            block = (task << 32) | k
            rows, direct = _fold_block(pieces, texts, shards)
            sizes = np.array([len(t.encode()) if t else 0 for t in texts], "<i8")
            every = np.arange(len(texts), dtype="<u2").tobytes()
            head = (block % shards, block, _packed_ids(ids), sizes.tobytes(), None, None, every, direct.astype("<u4").tobytes())
            yield common.record(_SENT, *zip(*[head, *[(s, block, None, None, *r) for s, *r in rows]], strict=True))

    return run


def _packed_ids(ids: pa.Array) -> bytes:
    return ids.fill_null(common.NULL_ID).to_numpy().astype("<i8").tobytes()


def _answer(path: str, keep: int):
    def run(batches):
        pieces = Pieces(path)
        known: dict[str, int] = {}
        for b in batches:
            out = []
            for r in b.to_pylist():
                if r["tokens"] is None:
                    out.append((r["block"], r["ids"], r["bytes"], r["docs"], r["freqs"]))
                    continue
                words = r["tokens"].split(" ")
                if new := [w for w in words if w not in known]:
                    if len(known) > keep:
                        known.clear()
                        new = words
                    known.update(zip(new, pieces.count_new(new), strict=True))
                counts = np.fromiter(map(known.__getitem__, words), np.int64, len(words))
                docs = np.frombuffer(r["docs"], "<u2")
                sums = np.bincount(docs, weights=np.repeat(counts, np.frombuffer(r["spread"], "<u2")) * np.frombuffer(r["freqs"], "<u4"))
                seen = np.flatnonzero(sums)
                out.append((r["block"], None, None, seen.astype("<u2").tobytes(), sums[seen].astype("<u4").tobytes()))
            if out:
                yield common.record(_ANSWER, *zip(*out, strict=True))

    return run


def _add_up(rows: pa.Table) -> pa.Table:
    got = rows.to_pylist()
    head = next(r for r in got if r["ids"] is not None)
    ids = np.frombuffer(head["ids"], "<i8")
    total = np.zeros(len(ids), np.int64)
    for r in got:
        np.add.at(total, np.frombuffer(r["docs"], "<u2"), np.frombuffer(r["sums"], "<u4").astype(np.int64))
    return pa.table({"doc_id": pa.array(ids, mask=ids == common.NULL_ID), "n_bytes": pa.array(np.frombuffer(head["bytes"], "<i8")), "n_tokens": pa.array(total)})


def count_tokens(docs: DataFrame, tokenizer: str, keep: int = 4_000_000) -> DataFrame:
    """Tokens of every whole text: (doc_id, n_bytes, n_tokens), one row per input row.

    Null and empty texts have 0 bytes and 0 tokens; repeated rows are counted
    each; a null doc_id stays null; other columns of ``docs`` are ignored.
    ``keep`` bounds the pre-tokens a shard remembers; beyond it they are
    counted anew, which changes no result.
    """
    shards = common.partitions(docs.sparkSession)
    sent = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(common.tidy(_send(tokenizer, shards), "pieces"), SENT)
    return common.deal(sent, "shard").mapInArrow(common.tidy(_answer(tokenizer, keep), "pieces"), ANSWER).groupBy("block").applyInArrow(common.tidy_group(_add_up), COUNTED)
