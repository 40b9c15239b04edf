"""The corpus operators against brute force on small fixtures with nulls, empties, ties, repeats and extra columns."""

import hashlib
import math
import pickle
import random
import weakref
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")
from pyspark.sql import functions as F

from quillstone.llm import common, components, decontamination, embeddings, induced, katz, minhash, packing, pii, pretokens, sharding, suffix_dedup, token_counts, toxicity

BPE = public_tokenizers.path("word_bpe_49k.json")
WORDS = "the of and to in a is that it was idiot über señor 42 don't we'll x".split()


def text(r, n):
    return " ".join(r.choice(WORDS) for _ in range(n))


def corpus(seed=1, n=60):
    """(doc_id, text): shared passages, exact and near copies, edge cases."""
    r = random.Random(seed)
    passage = " ".join(f"w{r.randrange(10**6)}" for _ in range(40))
    base = [f"v{r.randrange(10**6)}" for _ in range(60)]
    out = []
    for i in range(n):
        kind = i % 6
        if kind == 0:
            t = text(r, r.randrange(1, 80))
        elif kind == 1:
            t = text(r, 10) + " " + passage + " " + text(r, 5)
        elif kind == 2:
            w = list(base)
            w[r.randrange(60)] = "edited"
            t = " ".join(w)
        elif kind == 3:
            t = " ".join(f"u{r.randrange(10**6)}" for _ in range(30))
        elif kind == 4:
            t = out[r.randrange(len(out))][1] or ""
        else:
            t = passage[r.randrange(100) :]
        out.append((i, t))
    out += [(n, None), (n + 1, ""), (n + 2, " \n\t"), (n + 3, "one two"), (n + 4, "One  TWO"), (n + 5, "a" * 3000), (n + 6, "a" * 200 + "b" + "a" * 200), (n + 7, "ab" * 400), (n + 8, "<|endoftext|>x<|startoftext|> <|ENDOFTEXT|>"), (n + 9, "ΑΣ ﬁ 中文 é é   x\x85y")]
    return out


@pytest.fixture(scope="module")
def docs(spark):
    rows = corpus()
    random.Random(5).shuffle(rows)
    return spark.createDataFrame([(i, t, "other", i) for i, t in rows], "doc_id long, text string, shard string, node int").repartition(5).cache()


def with_text(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


EMPTY = "doc_id long, text string"


# --- 1 suffix-array dedup


@pytest.mark.parametrize("seed", range(30))
def test_suffix_order(seed):
    r = np.random.default_rng(seed)
    a = int(r.integers(1, 6))
    t = np.append(np.repeat(r.integers(1, a + 1, r.integers(1, 40)), r.integers(1, 4)), 0).astype(np.int16)
    want = sorted(range(len(t)), key=lambda i: t[i:].tolist())
    got, prefix = induced.suffix_array(t, a + 1, memory=64, cap=5)
    assert got.tolist() == want == induced.suffix_array(t, a + 1).tolist()
    assert prefix.tolist() == induced.common_prefixes(t, got, 5).tolist()
    for k in range(1, len(t)):
        x, y, n = t[want[k - 1] :].tolist(), t[want[k] :].tolist(), 0
        while n < min(5, len(x), len(y)) and x[n] == y[n]:
            n += 1
        assert prefix[k] == n


@pytest.mark.parametrize("seed", range(40))
def test_suffix_order_by_ranges(seed, monkeypatch):
    monkeypatch.setattr(induced, "FEW", 3)
    monkeypatch.setattr(induced, "WORTH", 5)
    r = np.random.default_rng(seed)
    a = int(r.integers(1, 30))
    t = np.append(np.repeat(r.integers(1, a + 1, r.integers(1, 60)), r.integers(1, 4)), 0)
    assert induced.suffix_array(t, a + 1, memory=64).tolist() == sorted(range(len(t)), key=lambda i: t[i:].tolist())


def test_suffix_sort_recurses_and_spills():
    r = np.random.default_rng(1)
    vocabulary = [bytes(r.integers(97, 123, r.integers(2, 9)).astype(np.uint8)) for _ in range(2000)]
    raw = b" ".join(vocabulary[i] for i in np.minimum(r.zipf(1.3, 40_000) - 1, 1999))
    t = np.append(np.frombuffer(raw, np.uint8).astype(np.int16) + 2, 0).astype(np.int16)
    trace = []
    order, shared = induced.suffix_array(t, 258, memory=1 << 14, cap=50, trace=trace)
    assert len(trace) >= 3 and max(x["symbols"] for x in trace) > induced.FEW and sum(x["spilled"] for x in trace) > 0
    assert sorted(order.tolist()) == list(range(len(t)))
    whole = (np.frombuffer(raw, np.uint8).astype(np.uint8) + 1).tobytes() + b"\0"
    k = r.integers(1, len(t), 3000)
    assert all(whole[order[i - 1] :][:2000] <= whole[order[i] :][:2000] for i in k.tolist())
    assert shared.tolist() == induced.common_prefixes(t, order, 50).tolist()


def test_a_shard_larger_than_memory_is_parted_by_anchor(monkeypatch):
    r = np.random.default_rng(5)
    rows = []
    anchors = r.integers(1, 1 << 63, 40).astype(np.uint64)
    bodies = [bytes(r.integers(97, 100, 84).astype(np.uint8)) for _ in range(60)]
    for block in range(30):
        n = 12
        which, uses = r.integers(0, 60, n), r.integers(1, 3, n).astype("<u4")
        rows.append({
            "block": block, "hashes": anchors[which % 40], "folds": which.astype(np.uint64), "lengths": np.full(n, 84, np.uint8), "owners": r.integers(0, 50, n).astype("<i8"), "uses": uses,
            "docs": r.integers(0, 9, uses.sum()).astype("<u4"), "starts": r.integers(0, 900, uses.sum()).astype("<i8"), "bytes": np.frombuffer(b"".join(bodies[i] for i in which), np.uint8),
        })

    def marks(parts):
        out = Counter()
        for part in parts:
            for block, _, _, docs, starts, ends in suffix_dedup._marks(part, 1 << 12):
                out.update(zip([block] * (len(docs) // 4), np.frombuffer(docs, "<u4").tolist(), np.frombuffer(starts, "<i8").tolist(), np.frombuffer(ends, "<i8").tolist()))
        return out

    spool = suffix_dedup.Spool()
    for row in rows:
        spool.add(row)
    want = marks(spool.parts())
    monkeypatch.setattr(suffix_dedup, "HELD", 8000)
    spool = suffix_dedup.Spool()
    for row in rows:
        spool.add(row)
    parts = list(spool.parts())
    assert spool.file and len(parts) > 3 and want and marks(parts) == want


def repeats(rows, length=50):
    first = {}
    for i, t in sorted((i, (t or "").encode()) for i, t in rows if i is not None):
        for k in range(len(t) - length + 1):
            first.setdefault(t[k : k + length], i)
    out = []
    for i, t in rows:
        t = (t or "").encode()
        gone = bytearray(len(t))
        for k in range(len(t) - length + 1):
            if i is not None and first[t[k : k + length]] < i:
                gone[k : k + length] = b"\1" * length
        kept = bytes(c for c, g in zip(t, gone) if not g)
        runs = sum(1 for k in range(len(t)) if gone[k] and (not k or not gone[k - 1]))
        out.append((i, len(t), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def test_remove_repeats(docs):
    got = sorted((tuple(r) for r in suffix_dedup.remove_repeats(docs).collect()), key=repr)
    assert got == repeats([(r.doc_id, r.text) for r in docs.collect()])


def test_remove_repeats_edges(spark, monkeypatch):
    same = "x" * 70
    rows = [(None, same), (None, same), (3, same), (3, same), (3, same + "tail"), (7, "y" + same), (8, None)]
    got = sorted((tuple(r) for r in suffix_dedup.remove_repeats(with_text(spark, rows)).collect()), key=repr)
    assert got == repeats(rows)
    assert suffix_dedup.remove_repeats(with_text(spark, [])).collect() == []
    kept = suffix_dedup.remove_repeats(with_text(spark, [(1, "p" * 60), (2, "q" + "p" * 60)]), with_bytes=True).where("doc_id = 2").first()
    assert bytes(kept.kept) == b"q"


def test_only_regions_that_may_share_a_window_are_sorted(monkeypatch):
    r = random.Random(11)

    def noise(n):
        return "".join(r.choice("bcdfghjklmnpqrstvwxyz") for _ in range(n))

    passage, phrase = noise(90), "the anchor of many regions"
    rows = [(i, noise(60) + phrase + noise(60)) for i in range(300)]
    # one window to the left of the phrase, one to its right, one around it, and a near copy
    a, b = rows[0][1], rows[1][1]
    rows += [(300, noise(40) + a[30:86] + noise(40)), (301, noise(40) + b[58:120]), (302, a[44:102]), (303, b[:70] + "#" + b[71:])]
    rows += [(304 + i, noise(20 + i) + passage[i:] + noise(30)) for i in range(20)]
    block = suffix_dedup.Block([t.encode() for _, t in rows])
    doc, start, end = block.doc[block.segment], block.first, block.last + suffix_dedup.LENGTH
    places = start - block.starts[block.segment]
    row = {
        "block": 0, "hashes": block.hash, "folds": block.region_hash(np.arange(len(start))), "offsets": (block.anchor - start).astype(np.uint8), "lengths": (end - start).astype(np.uint8), "owners": doc, "uses": np.ones(len(start), "<u4"),
        "docs": doc.astype("<u4"), "starts": places, "bytes": np.concatenate([block.data[x:y] for x, y in zip(start, end, strict=True)]),
    }
    sizes, sort = [], suffix_dedup.suffix_array
    monkeypatch.setattr(suffix_dedup, "suffix_array", lambda t, *rest, **more: (sizes.append(len(t)), sort(t, *rest, **more))[1])
    gone = [bytearray(len(t)) for _, t in rows]
    for _, _, _, docs, starts, ends in suffix_dedup._marks([row], 1 << 12):
        for d, x, y in zip(*(np.frombuffer(c, k).tolist() for c, k in ((docs, "<u4"), (starts, "<i8"), (ends, "<i8"))), strict=True):
            gone[d][x:y] = b"\1" * (y - x)
    assert [sum(x) for x in gone] == [x[2] for x in sorted(repeats(rows), key=lambda x: x[0])] and sum(map(sum, gone)) > 1000
    several = Counter(block.hash.tolist())
    assert 0 < 4 * sum(sizes) < sum(n + 1 for n, x in zip((end - start).tolist(), block.hash.tolist(), strict=True) if several[x] > 1)


@pytest.mark.parametrize("partitions", [1, 6])
def test_blocks_without_shared_regions(spark, partitions):
    r = random.Random(8)
    unique = [(i, " ".join(f"u{r.randrange(10**9)}" for _ in range(20))) for i in range(12)]
    short = [(i, "short" * (i % 10)) for i in range(12)]
    shared = [(20, "x" * 70), (21, "y" + "x" * 70)]
    for rows in ([(i, None) for i in range(12)], [(i, "") for i in range(12)], short, unique, unique[:1], [(None, "x" * 70)], [*unique, *short, (30, None), *shared]):
        got = suffix_dedup.remove_repeats(with_text(spark, rows).repartition(partitions)).collect()
        assert sorted(map(tuple, got), key=repr) == repeats(rows)


def test_long_texts_are_cut_in_segments(spark, monkeypatch):
    r = random.Random(2)
    long = "".join(r.choice("abcdefgh") for _ in range(3000))
    monkeypatch.setattr(suffix_dedup, "SEGMENT", 700)
    monkeypatch.setattr(suffix_dedup, "SORT_SYMBOLS", 500)
    rows = [(1, long[500:900]), (2, long), (3, long[::-1] + long[1000:2000])]
    blocks = suffix_dedup.Block([t.encode() for _, t in rows])
    covered = Counter((int(blocks.doc[s]), int(p + blocks.base[s] - blocks.starts[s])) for f, e, s in zip(blocks.first, blocks.last, blocks.segment) for p in range(f, e + 1))
    assert set(covered.values()) == {1} and len(covered) == sum(len(t) - 49 for _, t in rows)


# --- 2 packing, 7 token counts


def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(BPE)


def test_pieces_equal_the_library():
    p, t = pretokens.Pieces(BPE), library()
    r = random.Random(3)
    chars = "abcABC  \t\n\x0b\x1c\x1f\x7f\x85\xa0'!?.,0123²½ªºµßéÉİıſĀ中ΣǺ’<|>-_\"" + "".join(map(chr, range(0xA0, 0x130, 7)))
    texts = ["".join(r.choice(chars) for _ in range(r.randrange(60))) for _ in range(400)] + [x or "" for _, x in corpus()]
    for x in texts:
        want = t.encode(x, add_special_tokens=False).ids
        assert np.frombuffer(p.ids(x), "<u2").tolist() == want, repr(x)
        got = p.split(x)
        assert sum(p.count_new([w])[0] for w in got[0]) + len(got[1]) == len(want)


def test_any_text_is_split_to_pre_tokens():
    p, t = pretokens.Pieces(BPE), library()
    texts = ["Ἀθῆναι — “quoted” ’tis", "漢字かな交じり文 and 한국어", "Привет, мир! don’t <|endoftext|> it's", "H\u0331i İstanbul ẞ K\u0301 x\u0301y 👩‍👩‍👧 ½ ٣٤", "naïve ﬁ ǅ Σς ΑΣ"]
    want = [t.encode(x, add_special_tokens=False).ids for x in texts]
    p.whole = None  # the library never gets a whole text
    assert [np.frombuffer(x, "<u2").tolist() for x in p.ids_of(texts)] == want
    rows, specials = token_counts._fold_block(p, texts, 4)
    total = specials.copy()
    for _, tokens, spread, at, freqs in rows:
        counts = np.repeat(p.count_new(tokens.split(" ")), np.frombuffer(spread, "<u2"))
        np.add.at(total, np.frombuffer(at, "<u2"), counts * np.frombuffer(freqs, "<u4"))
    assert total.tolist() == [len(x) for x in want]


def test_token_counts(spark, docs):
    t = library()
    rows = docs.collect()
    got = {r.doc_id: (r.n_bytes, r.n_tokens) for r in token_counts.count_tokens(docs, BPE, keep=3).collect()}
    assert got == {r.doc_id: (len((r.text or "").encode()), len(t.encode(r.text or "", add_special_tokens=False).ids)) for r in rows}
    twice = token_counts.count_tokens(with_text(spark, [(1, "a b"), (1, "a b"), (None, "c")]), BPE).collect()
    assert sorted(map(tuple, twice), key=repr) == [(1, 3, 2), (1, 3, 2), (None, 1, 1)]
    assert token_counts.count_tokens(with_text(spark, []), BPE).collect() == []


def check_packing(rows, pieces, window):
    t = library()
    ids = {r.doc_id: [*t.encode(r.text or "", add_special_tokens=False).ids, 2] for r in rows}
    sequences, documents = defaultdict(list), defaultdict(list)
    for p in pieces:
        d = ids[p.doc_id]
        part = np.array(d[p.start : p.start + p.length], "<u4")
        assert len(part) == p.length and p.doc_tokens == len(d) and p.ids_crc32 == zlib.crc32(part.tobytes())
        sequences[p.sequence_id].append((p.offset, p.length))
        documents[p.doc_id].append((p.start, p.length))
    for group, total in ((sequences, None), (documents, ids)):
        for k, parts in group.items():
            at = 0
            for start, length in sorted(parts):
                assert start == at
                at += length
            assert at == len(ids[k]) if total else at <= window
    assert set(documents) == set(ids)
    sizes = [sum(n for _, n in v) for v in sequences.values()]
    assert all(s == window or s & (s - 1) == 0 for s in sizes)


@pytest.mark.parametrize("window", [64, 256, 4096])
def test_packing(spark, docs, window):
    pieces = packing.pack(docs, BPE, window=window).collect()
    check_packing(docs.collect(), pieces, window)
    assert packing.pack(with_text(spark, []), BPE).collect() == []


@pytest.mark.parametrize("chunk", [40_000, 2048])
def test_the_mix_places_most_remainders(chunk):
    r = np.random.default_rng(3)
    lengths = np.maximum(1, r.lognormal(5.5, 1.2, 40_000).astype(np.int64))
    mix, repeats = packing.solve_mix(np.bincount(-(-(lengths % 4096) // 64), minlength=65)[1:])
    whole = pieces = seq = 0
    for k in range(0, len(lengths), chunk):
        part = lengths[k : k + chunk]
        got, seq = packing.plan(part, 4096, mix, repeats, len(part) / len(lengths), k // chunk, seq)
        tails = Counter(i for i, start, *_ in got if start >= part[i] - part[i] % 4096)
        whole, pieces = whole + sum(n == 1 for n in tails.values()), pieces + len(got)
    assert whole > 0.6 * len(lengths) and pieces < 1.4 * len(lengths)


def test_packing_of_many_small_partitions(spark, monkeypatch):
    r = random.Random(4)
    rows = [(i, text(r, r.randrange(1, 120))) for i in range(600)]
    docs = with_text(spark, rows).repartition(64)
    monkeypatch.setattr(packing, "PER_TASK", 200)
    got = packing.pack(docs, BPE, window=256).collect()
    check_packing(docs.collect(), got, 256)
    assert len({p.sequence_id >> 32 for p in got}) <= 3


def test_combinations_and_least_squares():
    assert set(packing.combinations(5, 3)) == {(5,), (4, 1), (3, 2), (3, 1, 1), (2, 2, 1)}
    r = np.random.default_rng(1)
    a = r.random((6, 12))
    x = packing.nnls(a, b := a @ np.maximum(r.normal(size=12), 0))
    assert (x >= 0).all() and np.allclose(a @ x, b, atol=1e-6)
    assert (packing.nnls(np.eye(3), np.array([1.0, -2.0, 3.0])) == [1, 0, 3]).all()
    mix, repeats = packing.solve_mix(np.array([0, 100, 0, 0, 0, 100, 0, 0]), 3)
    assert (6, 2) in mix and repeats[mix.index((6, 2))] > 90


# --- 3 pseudonyms


def luhn(d):
    return sum(int(c) if k % 2 == 0 else int(c) * 2 - 9 * (int(c) > 4) for k, c in enumerate(reversed(d))) % 10 == 0


def mod97(x):
    x = x.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in x[4:] + x[:4])) % 97


def pseudonyms(spark, texts, key="k"):
    got = pii.pseudonymise(with_text(spark, list(enumerate(texts))), key).orderBy("doc_id").collect()
    return [r.text for r in got], [r.pii_kinds for r in got]


def test_pseudonyms_keep_formats_and_links(spark):
    texts = ["4845168114407329", "4845-1681-1440-7329 x 4845 1681 1440 7329", "7536784127813050 4845168114407329", "9807915762804490 no card", "+1 (017) 555-7713, (017) 555-7713", "ip 97.51.17.173. and 999.1.1.1 v1.2.3.4.5",
             "2001-02-28 28.02.2001 02/28/2001 2001-02-30", "123-45-6789 666-45-6789 000-12-3456", "DE89 3704 0044 0532 0130 00 GB82WEST12345698765432 DE00 3704 0044 0532 0130 00", "a.b@x.example.com A.B@x.example.com.", None, "", "plain 123 text", "+44 20 7946 0958 and +442079460958 or +10175557713"]
    out, kinds = pseudonyms(spark, texts)
    card = out[0]
    assert luhn(card) and card != texts[0] and len(card) == 16
    assert out[1].replace("-", "").replace(" ", "") == f"{card}x{card}" and out[1][4] == "-" and out[1][-5] == " "
    assert out[2].split()[1] == card and all(map(luhn, out[2].split()))
    assert out[3] == texts[3] and kinds[3] == []
    assert out[4].split(", ")[0].endswith(out[4].split(", ")[1]) and out[4].startswith("+1 (") and out[4] != texts[4]
    new = out[5].split()[1].rstrip(".")
    assert all(0 <= int(o) <= 255 for o in new.split(".")) and out[5].endswith("and 999.1.1.1 v1.2.3.4.5")
    iso, dotted, slashed, bad = out[6].split()
    y, m, d = iso.split("-")
    assert (dotted, slashed, bad) == (f"{d}.{m}.{y}", f"{m}/{d}/{y}", "2001-02-30") and iso != "2001-02-28" and 1900 <= int(y) < 2100
    assert out[7].split()[1:] == texts[7].split()[1:] and out[7].split()[0] != "123-45-6789"
    ibans = out[8].split(" GB")[0], "GB" + out[8].split(" GB")[1].split()[0]
    assert all(mod97(x) == 1 for x in ibans) and ibans[0][:2] == "DE" and ibans[1][4:8] == "WEST" and out[8].endswith(texts[8][-27:])
    a, b = out[9].rstrip(".").split()
    assert a == b and a.endswith("@x.example.com") and "a.b" not in a
    assert out[10] is None and out[11] == "" and out[12] == texts[12]
    london, same, other = (x.strip().replace(" ", "") for x in out[13].replace("and", "|").replace("or", "|").split("|"))
    assert london == same != "+442079460958" and london.startswith("+44") and other == "+1" + "".join(c for c in out[4].split(", ")[1] if c.isdigit())
    assert pseudonyms(spark, texts, "other")[0][0] != card


def test_pseudonyms_of_values_with_neighbours(spark):
    card, es, be = "4111 1111 1111 1111", "ES91 2100 0418 4502 0005 1332", "BE68539007547034"
    texts = [card, f"{card} 12/27", f"{card} 123", f"1234 {card} x", f"{card} 5500 0000 0000 0004", "4111-1111-1111-1111-123", es, f"{es} EUR", f"{es} {card}", be, f"{be} THIS", f"XX12 {es}", f"{card} 123-45-6789", f"{es} 2001-02-28", "XX82 1234 5678 9012 NOTE", "6304 0000 0000 0000 000 12/27", "1234 5678 9012 3456 789"]
    out, kinds = pseudonyms(spark, texts)
    c, e, b = out[0], out[6], out[9]
    assert c != card and e != es and b != be and luhn(c.replace(" ", "")) and mod97(e) == mod97(b) == 1
    assert out[1] == f"{c} 12/27" and out[2] == f"{c} 123" and out[3] == f"1234 {c} x" and out[5] == c.replace(" ", "-") + "-123"
    assert out[4].startswith(c) and out[4][19:] != " 5500 0000 0000 0004" and luhn(out[4][20:].replace(" ", "")) and kinds[4] == ["card", "card"]
    assert out[7] == f"{e} EUR" and out[8] == f"{e} {c}" and out[10] == f"{b} THIS" and out[11] == f"XX12 {e}"
    assert out[12].startswith(c + " ") and kinds[12] == ["card", "ssn"] and out[13].startswith(e + " ") and kinds[13] == ["iban", "date"]
    assert kinds[2] == ["card"] and kinds[8] == ["iban", "card"] and kinds[16] == [] and out[16] == texts[16]


def test_pseudonyms_leave_other_columns(spark):
    row = spark.createDataFrame([("call 4845168114407329", ["mine"], 7, "x")], "text string, pii_kinds array<string>, `values` int, __values string")
    got = pii.pseudonymise(row, "k").first()
    assert got["pii_kinds"] == ["mine"] and got["values"] == 7 and got["__values"] == "x" and got["pii_kinds_"] == ["card"] and got["text"] != "call 4845168114407329"


def test_permutations_are_one_to_one(spark):
    digits = spark.range(1000).select(F.lpad(F.col("id").cast("string"), 3, "0").alias("d"))
    assert digits.select(pii.permute_digits(F.col("d"), "k", "t").alias("p")).distinct().count() == 1000
    days = spark.range(0, pii.DAYS, 7).select(F.date_format(F.date_add(F.lit(pii.FIRST_DAY).cast("date"), F.col("id").cast("int")), "yyyy-MM-dd").alias("d"))
    assert days.select(pii.date(F.col("d"), "k").alias("p")).distinct().count() == days.count()


def test_pseudonyms_in_the_corpus(docs):
    got = pii.pseudonymise(docs, "k")
    assert got.columns == [*docs.columns, "pii_kinds"]
    assert got.join(docs.select("doc_id", F.col("text").alias("old")), "doc_id").where(~F.col("text").eqNullSafe(F.col("old"))).count() == 0


# --- 4 sharding


def test_sharding(spark, docs):
    rows = sharding.shard_documents(docs, 24).collect()
    old = {r.doc_id: r.text for r in docs.collect()}
    for r in rows:
        raw = (old[r.doc_id] or "").encode()
        assert r.size == len(raw) + 8 and r.text_crc32 == zlib.crc32(raw) and r.law == "key" and r.grown_shard in (r.shard, 24)
    slots = defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values()) and len(rows) == len(old)
    edge = sharding.shard_documents(with_text(spark, [(1, "x"), (1, "x"), (None, None), (None, "y")]), 24).collect()
    assert len(edge) == 4 and len({(r.shard, r.slot) for r in edge}) == 4
    assert sharding.shard_documents(with_text(spark, []), 24).collect() == []


def test_tree_moves_rows_only_where_weights_change(spark):
    ids = spark.range(20000)
    n24 = ids.select("id", sharding.place(F.col("id"), sharding.even_tree(24)).alias("a"), sharding.place(F.col("id"), sharding.even_tree(25)).alias("b")).collect()
    count = Counter(r.a for r in n24)
    assert len(count) == 24 and max(count.values()) < 1.2 * 20000 / 24 and {r.b for r in n24 if r.a != r.b} == {24}
    assert 0.8 < Counter(r.b for r in n24)[24] / (20000 / 25) < 1.2
    for n in (1, 5, 8, 26):
        tree = sharding.even_tree(n)
        for shard in (n, n + 1):  # grown twice, one by one
            more = sharding.grow(tree, shard)
            moved = ids.select(sharding.place(F.col("id"), tree).alias("a"), sharding.place(F.col("id"), more).alias("b")).where("a <> b").select("b").distinct().collect()
            assert [r.b for r in moved] == [shard]
            tree = more
    N = sharding.Node
    tree = N("root", children=(N("x", children=(N("x0", 0, 1.0), N("x1", 1, 1.0))), N("y", children=(N("y0", 2, 1.0), N("y1", 3, 1.0)))))
    more = N("root", children=(N("x", children=(N("x0", 0, 1.0), N("x1", 1, 2.0))), tree.children[1]))
    moved = ids.select(sharding.place(F.col("id"), tree).alias("a"), sharding.place(F.col("id"), more).alias("b")).where("a <> b").collect()
    assert moved and all(r.b in (0, 1) for r in moved)  # rows move into the subtree that grew, and inside it


# --- 5 embeddings


def links_by_force(rows, threshold):
    links, low = defaultdict(int), {}
    good = {}
    for i, e, label in rows:
        low[i] = i
        if e and label is not None and all(x is not None and math.isfinite(x) for x in e) and any(e):
            good[i] = (np.array(e, float), label)
    edges = []
    for i, (a, la) in good.items():
        for j, (b, lb) in good.items():
            if i != j and la == lb and len(a) == len(b) and a @ b / (np.linalg.norm(a) * np.linalg.norm(b)) >= threshold:
                links[i] += 1
                edges.append((i, j))
    for _ in rows:
        for i, j in edges:
            low[i] = low[j] = min(low[i], low[j])
    return sorted((i, links[i], low[i], low[i] == i) for i, _, _ in rows)


def vectors(seed, n, dim=8, groups=20):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(groups, dim))
    out = [(int(i), [float(x) for x in centres[i % groups] + r.normal(size=dim) * r.choice([0.05, 0.3])], int(i % 3)) for i in range(n)]
    out += [(n + k, out[3][1], out[3][2]) for k in range(1, 40)]
    out += [(n + 50, None, 1), (n + 51, [0.0] * dim, 1), (n + 52, [1.0, float("nan"), *[0.0] * (dim - 2)], 1), (n + 53, [1.0, None, *[0.0] * (dim - 2)], 1), (n + 54, [float("inf"), *[0.0] * (dim - 1)], 1), (n + 55, out[1][1], None), (n + 56, [1.0, 2.0], 1), (n + 57, [], 1), (n + 58, [2 * x for x in out[4][1]], out[4][2])]
    return out


def test_embeddings(spark):
    rows = vectors(1, 400)
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = sorted(tuple(r) for r in embeddings.near_duplicates(frame, 0.93, shard_size=60, ef=16).collect())
    assert got == links_by_force(rows, 0.93)
    assert embeddings.near_duplicates(frame.limit(0)).collect() == []
    odd = spark.createDataFrame([(None, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (1, [1.0, 0.0], 1)], "vec_id long, embedding array<double>, label int")
    assert sorted((tuple(r) for r in embeddings.near_duplicates(odd).collect()), key=repr) == [(1, 1, 1, True), (1, 1, 1, True), (None, 0, None, True)]


def test_embeddings_by_the_graph(spark):
    rows = vectors(2, 900)  # 300 and more in a shard: over 8 * ef, and so searched by the graph
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: r.n_links for r in embeddings.near_duplicates(frame, 0.93, shard_size=2048, ef=8).collect()}
    want = {r[0]: r[1] for r in links_by_force(rows, 0.93)}
    recall = sum(got.values()) / sum(want.values())
    print("recall", recall)
    assert all(got[i] <= n for i, n in want.items()) and recall > 0.99


def test_embeddings_of_large_shards(spark):
    r = np.random.default_rng(9)
    v = r.normal(size=(400, 16))[r.integers(0, 400, 2600)] + 0.12 * r.normal(size=(2600, 16)) * r.random((2600, 1))
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    link = (unit @ unit.T >= 0.93) & ~np.eye(len(v), dtype=bool)
    low = np.arange(len(v))
    for _ in range(60):
        low = np.minimum(low, np.where(link, low[None, :], len(v)).min(1))
    frame = spark.createDataFrame([(int(i), x.tolist(), 1, "extra") for i, x in enumerate(v)], "vec_id long, embedding array<double>, label int, n_links string")
    got = {x.vec_id: tuple(x) for x in embeddings.near_duplicates(frame, 0.93, shard_size=900, ef=24).collect()}
    assert got == {i: (i, int(link[i].sum()), int(low[i]), low[i] == i) for i in range(len(v))}
    audit = embeddings.audits(frame, 0.93, shard_size=900, ef=24).first()
    assert audit.links > 100 and audit.found >= 0.99 * audit.links and audit.searched >= 2 * len(v) and audit.scanned == 0


def test_graph_finds_neighbours():
    r = np.random.default_rng(4)
    v = embeddings._unit(r.normal(size=(1500, 16)) + 3 * r.normal(size=(30, 16))[r.integers(0, 30, 1500)])
    g = embeddings.Graph.build(v, np.arange(1500))
    g = embeddings.Graph.unpack(v, g.pack())
    _, found = g.search(v[:200], 64)
    want = np.argsort(-(v[:200] @ v.T), axis=1)[:, :10]
    assert np.mean([len(set(a) & set(b)) / 10 for a, b in zip(found, want)]) > 0.95


# --- 6 language model


def katz_by_force(rows):
    def tokens(t):
        return [*common.SPACED_WORD.findall(common.fold(t)), None]

    def learned(i):
        return i is None or zlib.crc32(str(i).encode()) % 7 != 2

    uni, bi, his = Counter(), Counter(), Counter()
    for i, t in rows:
        if learned(i):
            h = ("start",)
            for w in tokens(t):
                uni[w] += 1
                bi[h, w] += 1
                his[h] += 1
                h = w
    n, v = sum(uni.values()), len(uni)
    of = [[sum(1 for c in x.values() if c == r) for r in range(1, 7)] for x in (uni, bi)]
    d1, d2 = katz.good_turing(np.array(of[0])), katz.good_turing(np.array(of[1]))

    def cut(d, r):
        return r * (d[r - 1] if r <= katz.K else 1)

    p1 = {w: cut(d1, c) / n for w, c in uni.items()}
    unknown = 1 - sum(p1.values()) if n else 1.0
    seen = defaultdict(lambda: [0.0, 0.0])
    for (h, w), r in bi.items():
        seen[h][0] += cut(d2, r) / (his[h] + katz.RESERVE)
        seen[h][1] += p1[w]
    weight = {h: (1 - a) / (1 - b) for h, (a, b) in seen.items()}

    def p(h, w):
        return cut(d2, bi[h, w]) / (his[h] + katz.RESERVE) if bi[h, w] else weight.get(h, 1) * p1.get(w, unknown)

    for h in list(weight)[:20]:
        assert abs(sum(p(h, w) for w in uni) + weight[h] * unknown - 1) < 1e-9
    out = []
    for i, t in rows:
        h, s = ("start",), 0.0
        for w in tokens(t):
            s += math.log10(p(h, w))
            h = w
        out.append((i, not learned(i), len(tokens(t)), sum(w in uni for w in tokens(t)), n, sum(math.log10((uni[w] + 1) / (n + v + 1)) for w in tokens(t)), s))
    return out


def same_scores(got, want):
    got, want = sorted(map(tuple, got), key=repr), sorted(want, key=repr)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    for g, w in zip(got, want):
        assert g[5] == pytest.approx(w[5], rel=1e-9) and g[6] == pytest.approx(w[6], rel=1e-9)


@pytest.mark.parametrize("sample", [1, 10**9])
def test_katz(docs, sample):
    same_scores(katz.score(docs, sample).collect(), katz_by_force([(r.doc_id, r.text) for r in docs.collect()]))


def test_katz_edges(spark):
    rows = [(None, "a b"), (1, "a b"), (1, "a b"), (2, None)]
    same_scores(katz.score(with_text(spark, rows)).collect(), katz_by_force(rows))
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2)
    (r,) = katz.score(with_text(spark, [(held, "a b")])).collect()
    assert r.held_out and r.n_known == 0 and r.train_tokens == 0 and r.score == 0.0 == r.base_score
    assert katz.score(with_text(spark, [])).collect() == []


# --- 8 decontamination


def leaks(rows, items, size=13):
    out = []
    words = decontamination.words
    windows = defaultdict(set)
    for item, t in items:
        w = words(t) if item is not None else []
        for a in range(max(1, len(w) - size + 1) if w else 0):
            windows[tuple(w[a : a + size])].add(str(item))
    for i, t in rows:
        w = words(t)
        hit, found = set(), set()
        for win, names in windows.items():
            for a in range(len(w) - len(win) + 1):
                if tuple(w[a : a + len(win)]) == win:
                    hit.update(range(a, a + len(win)))
                    found |= names
        out.append((i, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), 0 < len(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("max_bytes", [1 << 20, 200])
def test_decontamination(spark, docs, max_bytes):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    shared = dict(rows)[1]
    items = [(1, shared[40:300]), (2, "one two"), (3, None), (4, ""), (None, "one two"), (5, "nothing like it at all"), (2, "was"), (10, shared[60:320].upper()), (6, "the " * 20), (7, "!!")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontamination.decontaminate(docs, bench, max_bytes=max_bytes).drop("n_near").collect()
    assert sorted(map(tuple, got), key=repr) == leaks(rows, items)
    none = decontamination.decontaminate(docs, bench.limit(0)).collect()
    assert len(none) == len(rows) and not any(r.contaminated or r.n_hit for r in none)
    assert decontamination.decontaminate(docs.limit(0), bench).collect() == []
    odd = decontamination.decontaminate(with_text(spark, [(None, "one two"), (1, "one two"), (1, "one two"), (1, "x")]), bench).collect()
    assert Counter((r.doc_id, r.n_hit) for r in odd) == {(None, 2): 1, (1, 2): 2, (1, 0): 1}


def test_proximity(spark):
    items = spark.createDataFrame([(1, "zebra yak xylophone walrus " + "the " * 9)], "item_id long, text string")
    near = decontamination.decontaminate(with_text(spark, [(1, "walrus and a zebra or the yak with xylophone"), (2, "zebra " + "q " * 40 + "yak xylophone walrus the"), (3, "zebra yak the the the the")]), items)
    assert {r.doc_id: (r.n_near, r.n_hit) for r in near.collect()} == {1: (1, 0), 2: (0, 0), 3: (0, 0)}
    parted = [(1, "zebra yak xylophone walrus"), (2, "the the the zebra yak"), (3, "xylophone walrus")]  # words of different documents are not near
    near = decontamination.decontaminate(with_text(spark, parted).coalesce(1), items)
    assert {r.doc_id: r.n_near + r.n_hit for r in near.collect()} == {1: 1, 2: 0, 3: 0}


# --- 9 toxicity


@pytest.fixture(scope="module")
def judged(spark):
    r = random.Random(9)
    bad = ["scum", "moron", "trash", "loweix", "loweiy", "loweiz"]
    rows = []
    for i in range(600):
        toxic = i % 7 == 0
        w = [r.choice(WORDS) + r.choice(["", "x", "y"]) for _ in range(r.randrange(20, 60))]
        for _ in range(r.randrange(4, 8) if toxic else int(r.random() < 0.1)):
            w[r.randrange(len(w))] = r.choice(bad)
        rows.append((i, " ".join(w), int(toxic)))
    frame = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    return frame.drop("toxic"), frame.drop("text")


def test_toxicity(spark, judged):
    docs, labels = judged
    model = toxicity.fit(docs, toxicity.toxic_labels(labels))
    got = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    held = [i for i in truth if zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean([(got[i].score >= 0.5) == bool(truth[i]) for i in held]) > 0.97
    assert all(0 <= r.score <= 1 for r in got.values()) and any(r.evidence and "scum" in r.evidence for r in got.values())
    odd = toxicity.score(with_text(spark, [(None, "scum moron trash"), (1, None), (2, ""), (3, "zzz")]), model).collect()
    assert len(odd) == 4 and len({r.score for r in odd if r.doc_id}) == 1 and max(odd, key=lambda r: r.score).doc_id is None
    clean = toxicity.drop_toxic(docs.withColumn("label", F.lit(1)), model)
    assert clean.columns == ["doc_id", "text", "label"]
    assert {r.doc_id for r in clean.collect()} == {i for i, r in got.items() if r.score < 0.5}


def test_toxicity_learns_from_its_part_only(spark, judged):
    docs, labels = judged
    flipped = labels.withColumn("toxic", F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = (toxicity.fit(docs, toxicity.toxic_labels(x)) for x in (labels, flipped))
    assert (a.matrix == b.matrix).all() and (a.ids == b.ids).all()
    assert toxicity.fit(docs, toxicity.toxic_labels(labels.withColumn("toxic", F.lit(0)))) is None
    assert {r.score for r in toxicity.score(docs, None).collect()} == {0.0}
    assert toxicity.fit(docs, toxicity.toxic_labels(labels.withColumn("toxic", F.lit(None).cast("int")))) is None


def test_lookup_confirms_what_a_hash_finds():
    signs = ["a"]
    for _ in range(11):
        signs += ["b" if x == "a" else "a" for x in signs]
    twin = ("".join(signs), "".join("b" if x == "a" else "a" for x in signs))  # equal polynomials for any base
    names = pa.array(["x", "schön", *twin, "", "longer name", "x="])
    assert len(set(toxicity._hashes(pa.array(twin)).tolist())) == 1
    look = toxicity.Lookup(names)
    assert look.find(names).tolist() == list(range(7))
    assert look.find(names.slice(1, 4)).tolist() == [1, 2, 3, 4]
    assert look.find(pa.array(["y", twin[1], "x", twin[0] + "a", "x"])).tolist() == [-1, 3, 0, -1, 0]
    assert look.find(pa.array([], pa.string())).tolist() == []
    assert toxicity.Lookup(pa.array([twin[0]])).find(pa.array(twin)).tolist() == [0, -1]
    assert toxicity.Lookup(pa.array([], pa.string())).find(pa.array(["x", ""])).tolist() == [-1, -1]


def test_blocks_never_change_the_nearest(spark, judged):
    docs, labels = judged
    m = toxicity.fit(docs, toxicity.toxic_labels(labels), block=4)
    q = m.matrix[:50] + np.random.default_rng(0).random((50, m.matrix.shape[1])) * 0.1
    q /= np.linalg.norm(q, axis=1, keepdims=True)
    sims, rows = m.nearest(q)
    want = -np.sort(-(q @ m.matrix.T), axis=1)[:, : m.k]
    assert np.allclose(sims, want)


def test_only_parts_with_other_letters_are_read_letter_by_letter(monkeypatch):
    texts = pa.array(["left out", None, "", " Plain, TEXT2go\x1f\x00", "plain go", "Élan—vital “plain” İx \u212a2 中文,x́y é", "—", "left out"]).slice(1, 6)
    apart = pc.split_pattern_regex
    want = apart(pc.utf8_lower(texts.fill_null("")), r"[^\p{L}]+").to_pylist()
    seen = []
    monkeypatch.setattr(pc, "split_pattern_regex", lambda x, *a: (seen.extend(x.to_pylist()), apart(x, *a))[1])
    doc, found = toxicity.split(texts)
    assert list(zip(doc.tolist(), found.to_pylist(), strict=True)) == [(i, w) for i, x in enumerate(want) for w in x if w]
    assert "k" in found.to_pylist() and seen and not any("text" in x or "go" in x for x in seen)


def test_postings_are_taken_term_by_term(spark, judged, monkeypatch):
    docs, labels = judged
    m = toxicity.fit(docs, toxicity.toxic_labels(labels))
    monkeypatch.setattr(toxicity, "BLOCK", 8)  # more blocks than examples that are tried first
    m.frequent = len(m.names) // 3
    m._index  # noqa: B018
    rng = np.random.default_rng(1)
    few = np.zeros((3, len(m.names)))  # frequent terms only, others only, and both
    few[0, :3], few[1, -3:], few[2, [1, -1]] = 1.0, 1.0, 1.0
    q = np.concatenate([m.matrix[:30] + rng.random((30, len(m.names))) * 0.1, m.matrix[:30], few])
    q /= np.linalg.norm(q, axis=1, keepdims=True)
    one_by_one, ranges = [], toxicity._ranges
    monkeypatch.setattr(toxicity, "_ranges", lambda starts, lengths: (one_by_one.append(int(lengths.sum())), ranges(starts, lengths))[1])
    sims, rows = m.nearest(q)
    every = q @ m.matrix.T
    assert np.allclose(sims, -np.sort(-every, axis=1)[:, : m.k]) and np.allclose(np.take_along_axis(every, rows, 1), sims)
    postings = sum(int(np.isin(m.cols, np.flatnonzero(x)[np.flatnonzero(x) >= m.frequent]).sum()) for x in q[:30])
    assert sum(one_by_one) < postings / 4


def test_workers_keep_no_model_between_tasks(spark, judged):
    docs, labels = judged
    model = toxicity.fit(docs, toxicity.toxic_labels(labels))
    shared = model.shared

    def peek(batches):
        for b in batches:
            yield pa.RecordBatch.from_pydict({"held": pa.array(["_value" in vars(shared)] * b.num_rows)})

    def held():
        return {r.held for r in spark.range(0, 32, 1, 16).mapInArrow(peek, "held boolean").collect()}

    assert held() == {False}  # after the fit's votes
    for frame in (toxicity.score(docs.repartition(8), model), toxicity.drop_toxic(docs.repartition(8), model)):
        assert frame.collect() and held() == {False}


def test_a_slim_model_gives_its_sources_back(spark, judged):
    docs, labels = judged
    m = toxicity.fit(docs, toxicity.toxic_labels(labels))
    q = m.matrix[:20]
    want = m.nearest(q)
    slim = pickle.loads(pickle.dumps(m))
    sources = [weakref.ref(x) for x in (slim.cols, slim.counts)]
    slim.slim()
    assert all(x() is None for x in sources)
    assert all((a == b).all() for a, b in zip(slim.nearest(q), want, strict=True))


def test_each_example_is_voted_on_once(spark, judged, monkeypatch):
    docs, labels = judged
    seen, left_out = spark.sparkContext.accumulator(0), toxicity._left_out

    def counted(shared):
        def run(batches):
            for b in left_out(shared)(batches):
                seen.add(b.num_rows)
                yield b

        return run

    monkeypatch.setattr(toxicity, "_left_out", counted)
    monkeypatch.setattr(toxicity, "VOTES", 100, raising=False)
    model = toxicity.fit(docs, toxicity.toxic_labels(labels))
    assert seen.value == len(model.ids) > 400
    n = len(model.ids)
    sims, rows = model.search([(np.flatnonzero(x), x[np.flatnonzero(x)]) for x in model.matrix], list(range(n)))
    assert np.allclose([model.slope, model.shift], toxicity._platt(model.vote(sims, rows), model.labels))


def test_every_term_of_the_examples_is_searched(spark):
    r = random.Random(12)
    rows, toxic = [], {}
    for i in range(1500):  # a lexicon of 700 words, each in two or three examples
        toxic[i] = int(i % 2 == 0)
        w = [r.choice(WORDS) for _ in range(20)]
        if toxic[i]:
            w[3:6] = [f"bad{chr(97 + (i * 3 // 2 + j) % 700 // 26)}{chr(97 + (i * 3 // 2 + j) % 26)}slur{(i * 3 // 2 + j) % 700}" for j in range(3)]
            w = [x.translate(str.maketrans("0123456789", "qrstuvwxyz")) for x in w]
        rows.append((i, " ".join(w)))
    docs = with_text(spark, rows)
    model = toxicity.fit(docs, spark.createDataFrame(list(toxic.items()), "doc_id long, label int").where("doc_id % 10 > 1"))
    vocabulary = {t for i, x in rows if i % 10 > 1 for w in toxicity.words(x) for t in toxicity.terms_of(w)}
    assert set(model.names) == vocabulary and len(vocabulary) > 700
    got = {x.doc_id: x for x in toxicity.score(docs.union(with_text(spark, [(9000, "the of and")])), model).collect()}
    assert got[9000].nearest_id is not None and got[9000].nearest_cosine > 0
    m = model.matrix
    for i, x in rows[:40]:
        c = toxicity._term_counts(x)
        v = np.array([c[t] for t in model.names]) * model.weight
        size = math.sqrt((v**2).sum() + sum((n * model.unseen) ** 2 for t, n in c.items() if t not in vocabulary))
        assert got[i].nearest_cosine == pytest.approx((m @ v / size).max(), rel=1e-9)
    held = [i for i in toxic if i % 10 < 2]
    assert np.mean([(got[i].score >= 0.5) == bool(toxic[i]) for i in held]) > 0.97


# --- 10 MinHash


def near_by_force(rows, size, percent=80):
    def shingles(t):
        w = common.SPACED_WORD.findall(common.fold(t))
        return {tuple(w)} if 0 < len(w) < size else {tuple(w[k : k + size]) for k in range(len(w) - size + 1)}

    sets = [(i, shingles(t)) for i, t in rows]
    low = {i: i for i, _ in sets if i is not None}
    edges = [(i, j) for i, a in sets for j, b in sets if i is not None and j is not None and a and b and 100 * len(a & b) >= percent * len(a | b)]
    for _ in range(20):
        for i, j in edges:
            low[i] = low[j] = min(low[i], low[j])
    return sorted(((i, len(s), low.get(i), i is None or low[i] == i) for i, s in sets), key=repr)


@pytest.mark.parametrize("size", [4, 5])
def test_near_duplicates(docs, size):
    got = sorted((tuple(r) for r in minhash.near_duplicates(docs, size).collect()), key=repr)
    assert got == near_by_force([(r.doc_id, r.text) for r in docs.collect()], size)


def test_large_mixed_buckets_are_finished(spark, monkeypatch):
    r = random.Random(11)
    base = [f"w{k}" for k in range(60)]
    rows = []
    for i in range(160):  # most pairs are below the threshold, all meet in many tables
        w = list(base)
        for _ in range(r.randrange(0, 4)):
            w[r.randrange(60)] = f"e{r.randrange(1000)}"
        rows.append((i, " ".join(w)))
    monkeypatch.setattr(minhash, "BLOCK", 16)
    got = sorted((tuple(x) for x in minhash.near_duplicates(with_text(spark, rows), 4).collect()), key=repr)
    assert got == near_by_force(rows, 4)


@pytest.mark.parametrize("spread", [2, 8])
def test_pairs_of_one_group_stay_few(spark, monkeypatch, spread):
    tried, confirm = [], minhash.confirm
    monkeypatch.setattr(minhash, "confirm", lambda pairs, *a: (tried.append(pairs.count()), confirm(pairs, *a))[1])
    per_doc = []
    for n in (250, 2000):
        r = random.Random(n)
        base = [f"w{k}" for k in range(120)]
        rows = []
        for i in range(n):  # one group of near copies; with a wide spread most pairs are below the threshold
            w = list(base)
            for _ in range(r.randrange(0, spread)):
                w[r.randrange(120)] = f"e{r.randrange(10**6)}"
            rows.append((i, " ".join(w)))
        tried.clear()
        got = sorted((tuple(x) for x in minhash.near_duplicates(with_text(spark, rows), 4).collect()), key=repr)
        if n == 250:
            assert got == near_by_force(rows, 4)
        per_doc.append(sum(tried) / n)
    assert max(per_doc) < 10, per_doc


def test_buckets_without_a_pair_to_try():
    sig = np.arange(3 * 2 * minhash.M, dtype=np.uint64).reshape(3, -1)
    sig[:, [0, minhash.M]] = 7  # all three meet in table (0, 0)
    schema = minhash._ASKED
    for n, left in (([10, 100, 1000], 3), ([100, 100, 100], 3)):
        batch = minhash.pa.RecordBatch.from_pydict({"node": [1, 2, 3], "of": [1, 2, 3] if n[0] == 10 else [1, 1, 3], "n": minhash.pa.array(n, minhash.pa.int32()), "keys": [x.tobytes() for x in sig], "open": minhash.pa.array([None] * 3, minhash.pa.binary())})
        sent = list(minhash._ask_rows(iter([batch]), [0], 0, 2, 5))
        told = list(minhash._lead(0)(iter(sent)))
        got = minhash._tries([0], 0, 80)(minhash.pa.Table.from_batches(told, schema)).to_pylist()
        pairs = [(r["a"], r["b"]) for r in got if r["b"] is not None]
        assert len([r for r in got if r["b"] is None]) == left and (not pairs if n[0] == 10 else {a for a, _ in pairs} | {b for _, b in pairs} >= {3})


def test_near_duplicates_edges(spark):
    rows = [(None, "a b c d e"), (None, "a b c d e"), (4, "a b c d e"), (4, "a b c d e"), (5, "A B c d e"), (6, None), (7, ""), (8, "x"), (9, "X")]
    got = sorted((tuple(r) for r in minhash.near_duplicates(with_text(spark, rows), 4).collect()), key=repr)
    assert got == near_by_force(rows, 4)
    assert minhash.near_duplicates(with_text(spark, []), 4).collect() == []


@pytest.mark.parametrize("seed", range(3))
def test_components(spark, seed):
    r = random.Random(seed)
    edges = [(r.randrange(200), r.randrange(200)) for _ in range(150)] + [(500 + k, 501 + k) for k in range(30)] + [(None, 3), (7, 7)]
    low = {x: x for e in edges if None not in e and e[0] != e[1] for x in e}
    for _ in range(40):
        for a, b in edges:
            if a is not None and a != b:
                low[a] = low[b] = min(low[a], low[b])
    frame = spark.createDataFrame(edges, "a long, b long")
    assert {r.node: r.component for r in components.connected_components(frame).collect()} == low
    first = components.connected_components(frame.limit(90))
    assert {r.node: r.component for r in components.refine(first, frame).collect()} == low


@pytest.mark.parametrize("one_task", [0, 20, 200_000])
def test_few_links_are_united_in_one_task(spark, monkeypatch, one_task):
    r = random.Random(4)
    path = [(k, k + 1) for k in r.sample(range(1000, 1060), 60)]
    star = [(5000, 5001 + k) for k in range(10)]
    edges = [*path, *star, (7, 7), (9, 8), (8, 9), (None, 3), (-5, 1030), (-(1 << 62), 5003)]
    frame = spark.createDataFrame(edges, "a long, b long").repartition(7)
    tables, scratch = [], common.scratch
    monkeypatch.setattr(common, "scratch", lambda df, tag, *rest, **more: (tables.append(tag), scratch(df, tag, *rest, **more))[1])
    monkeypatch.setattr(components, "ONE_TASK", one_task, raising=False)
    got = {x.node: x.component for x in components.connected_components(frame).collect()}
    want = dict.fromkeys([*range(1000, 1061), -5], -5) | dict.fromkeys([*range(5000, 5011), -(1 << 62)], -(1 << 62)) | {8: 8, 9: 8}
    assert got == want
    assert components.connected_components(frame.limit(0)).collect() == []
    assert one_task < 200_000 or tables == ["links", "labels", "links"]
