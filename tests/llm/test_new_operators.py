"""Mixing, token alignment and vector codes: against plain versions, and their edges."""

import hashlib
import re
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest

from lorebase.llm import mixing, token_align, vector_codes
from lorebase.llm.piece_bpe import Vocabulary
from lorebase.llm.queries import BYTE_BPE, MODEL

CLASH = "score double, pair long, row int, n int, key string, own string, range string, size long, words long, kind string"
EXTRA = (0.5, 1, 2, 3, "k", "o", "r", 4, 5, "x")


# mixing


def plain_targets(sizes):
    """Shares by weight; what is over a limit is shared anew, until none is above (in fractions)."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    total, full = Fraction(sum(sizes.values())), set()
    while True:
        rest = [s for s in names if s not in full]
        left = total - sum(3 * sizes[s] for s in full)
        share = {s: left * weight[s] / sum(weight[x] for x in rest) for s in rest}
        over = {s for s in rest if share[s] > 3 * sizes[s]}
        if not over:
            return {s: float(share[s]) if s in share else float(3 * sizes[s]) for s in names}
        full |= over


@pytest.mark.parametrize("sizes", [{"a": 10, "b": 1000, None: 7}, {"a": 0, "b": 5}, {"a": 0}, {"x": 1, "y": 1, "z": 900, "é": 3, "Z": 40, None: 0}, {f"s{i}": i * i for i in range(40)}])
def test_targets(spark, sizes):
    rows = spark.createDataFrame(list(sizes.items()), "source string, words long")
    got = {r.source: r.target for r in mixing.source_targets(rows).collect()}
    want = plain_targets(sizes)
    assert got.keys() == want.keys() and all(abs(got[s] - want[s]) <= 1e-9 * max(1, want[s]) for s in want)
    assert abs(sum(got.values()) - sum(sizes.values())) < 1e-6


def test_running_sums(spark):
    rows = [(i * 37 % 101, i) for i in range(101)]
    got = mixing.running(spark.createDataFrame(rows, "k int, v long").repartition(7), [mixing.F.col("k")], {"before": mixing.F.col("v"), "place": mixing.F.lit(1)}).collect()
    total = 0
    for place, (k, v) in enumerate(sorted(rows)):
        r = next(x for x in got if x.k == k)
        assert (r.v, r.before, r.place) == (v, total, place)
        total += v


def mixed(spark, rows):
    docs = spark.createDataFrame([(*r, *EXTRA) for r in rows], f"doc_id long, text string, source string, {CLASH}")
    return mixing.mix(docs)


def test_mix(spark):
    rng = np.random.default_rng(1)
    rows = [(i, " ".join(["w"] * int(rng.integers(0, 30))), "big" if i % 3 else f"s{i % 7}") for i in range(600)]
    rows += [(1, "same text here", "big")] * 40 + [(None, "no id", None), (None, None, None), (5, "", None), (6, "long " * 50_000, "long")]
    got = mixed(spark, rows).collect()
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += size(t)
    want = plain_targets(sizes)
    assert Counter((r.doc_id, r.size, r.source) for r in got) == Counter((i, size(t), s) for i, t, s in rows)
    for s in sizes:
        own = [r for r in got if r.source == s]
        assert {r.source_size for r in own} == {sizes[s]} and abs(own[0].target - want[s]) < 1e-6
        assert abs(sum(r.taken for r in own) - want[s]) <= 0.5 + 1e-6
        # whole passes and a cut: at most one row is taken in part
        assert all(r.epochs * r.size <= r.taken <= min(3, r.epochs + 1) * r.size for r in own)
        assert sum(0 < r.taken - r.epochs * r.size < r.size for r in own) <= 1
    again = mixed(spark, rows[::-1]).collect()
    assert Counter(map(tuple, got)) == Counter(map(tuple, again))


def test_mix_of_nothing(spark):
    assert mixed(spark, []).count() == 0
    assert [(r.size, r.target, r.taken) for r in mixed(spark, [(1, None, "a"), (2, " \n", None)]).collect()] == [(0, 0.0, 0)] * 2


# alignment


@pytest.fixture(scope="module")
def tools():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(BYTE_BPE)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=MODEL)


def plain_alignment(tools, text):
    """(a ids, b ids, groups, links) by two pointers over whole texts, or None."""
    a, b = tools
    if not text:
        return None
    raw, of = (" " + text).encode(), token_align.byte_of()
    told = a.encode(" " + text, add_special_tokens=False)
    left = [(i, bytes(of[c] for c in t)) for i, t in zip(told.ids, told.tokens)]
    right = [(i, bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode()) for i in b.encode(text) for p in [b.id_to_piece(i)]]
    if b"".join(x for _, x in left) != raw or b"".join(x for _, x in right) != raw:
        return None
    ends = [np.cumsum([len(x) for _, x in side]).tolist() for side in (left, right)]
    links, groups, i, j, gi, gj = [], [], 0, 0, 0, 0
    while i < len(left):
        links.append((left[i][0], right[j][0]))
        x, y = ends[0][i], ends[1][j]
        i, j = i + (x <= y), j + (y <= x)
        if x == y:
            groups.append(",".join(str(t) for t, _ in left[gi:i]) + "|" + ",".join(str(t) for t, _ in right[gj:j]))
            gi, gj = i, j
    return [t for t, _ in left], [t for t, _ in right], groups, links


def plain_rows(tools, rows):
    told = [(i, plain_alignment(tools, t)) for i, t in rows]
    count, best = Counter(), Counter()
    for _, x in told:
        count.update(set(x[3]) if x else ())
    for (a, _), n in count.items():
        best[a] = max(best[a], n)
    return [
        (i, len(x[0]), len(x[1]), len(x[2]), len(x[3]), sum(count[p] == best[p[0]] for p in x[3]), sum(count[p] for p in x[3]), hashlib.sha256(";".join(x[2]).encode()).hexdigest()) if x else (i, *[0] * 6, "")
        for i, x in told
    ]


ODD = [
    "hello world", "don't stop  now", "  lead", "trail  \n", "a\r\nb\r\n\r\nc", "x;\r\n y\r z", "tab\tand\t\ttwo", "a b c d", "one  two", "e\x1cf \x1c g\x1f\x1fh !\x1c!", "ﷺ中文字 字", "▁ under ▁▁x", "been▁here",
    "<|endoftext|> and </s> <s>", "\x00nul\x00", "emoji 👩‍👩‍👧 ok", "a᠎ b​ c﻿ d", "é é", "....!!! ---", "if (x) {\r\n\treturn;\r\n}\r", "\n", "\r", " ", "\t \r\n  \n", "1234 56,7", "\x85 x\x85y", "q" * 3000, " " * 300 + "z",
]


def test_alignment(spark, tools, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()][:60]
    rng = np.random.default_rng(2)
    chars = list(" \n\t\r ab'sé中▁\x1c\x85 1!,") + ["the ", " of", "\r\n", "  "]
    rows = [*docs, *enumerate(ODD, 10_000), *((20_000 + i, "".join(rng.choice(chars, int(rng.integers(1, 40))))) for i in range(400))]
    rows += [(1, None), (None, ""), (2, ODD[0]), (2, ODD[0]), (3, "w0 w1, w2 " * 20_000)]
    frame = spark.createDataFrame([(*r, *EXTRA) for r in rows], f"doc_id long, text string, {CLASH}")
    want = sorted(plain_rows(tools, rows), key=str)
    for most in (token_align.MOST_PAIRS, 40, 0):  # all pairs sent, some, none
        assert sorted(map(tuple, token_align.compare(frame, BYTE_BPE, MODEL, most_pairs=most).collect()), key=str) == want
    assert token_align.compare(frame.limit(0), BYTE_BPE, MODEL).count() == 0


def test_memory_is_bounded(tools, monkeypatch):
    monkeypatch.setattr(token_align, "MEMORY", 10)
    memory = token_align.Memory(token_align.Pair(token_align._read(BYTE_BPE), Vocabulary.load(MODEL)))
    for t in ("a b c d e f g", "h i j k l m n o p q r s", "a b h", ""):
        told = memory.rows([t])[0]
        plain = plain_alignment(tools, t)
        assert told[:2] == ((len(plain[0]), len(plain[1])) if plain else (0, 0))


def test_group_products():
    a, b = token_align.products(np.array([2, 1, 0]), np.array([1, 3, 2]))
    assert list(zip(a.tolist(), b.tolist())) == [(0, 0), (1, 0), (2, 1), (2, 2), (2, 3)]


# vector codes


def plain_codes(rows):
    kept = [(i, label, [int(np.floor(float(c) * 256)) for c in v]) for i, label, v in rows if v and all(c is not None and np.isfinite(c) for c in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0], r[2]))
    if not kept:
        return []
    parts = np.array([r[2] for r in kept]).reshape(len(kept), 16, -1)
    books = [[parts[k, m].tolist() for k in range(min(64, len(kept)))] for m in range(16)]
    for at in range(3):
        far = [((parts[:, m, None, :] - np.array(books[m])[None]) ** 2).sum(2) for m in range(16)]
        best = [f.argmin(1) for f in far]
        for m in range(16 if at < 2 else 0):
            for k in range(len(books[m])):
                own = parts[best[m] == k, m]
                if len(own):
                    books[m][k] = [int(s) // len(own) for s in own.sum(0)]
    error = [int(sum(far[m][i, best[m][i]] for m in range(16))) for i in range(len(kept))]
    by_label = Counter()
    for (_, label, _), e in zip(kept, error):
        by_label[label] += e
    digest = hashlib.sha256(",".join(str(c) for book in books for entry in book for c in entry).encode()).hexdigest()
    return [(i, "".join(f"{best[m][at]:02x}" for m in range(16)), error[at], by_label[label], digest) for at, (i, label, _) in enumerate(kept)]


def coded(spark, rows):
    frame = spark.createDataFrame([(*r, *EXTRA) for r in rows], f"vec_id long, label int, embedding array<float>, {CLASH}".replace("score double", "code double"))
    found = vector_codes.compress(frame.repartition(3))
    out = vector_codes.with_label_errors(found.codes).select("vec_id", "code", "error", "label_error").collect()
    return found, [(*r, found.books.digest()) for r in out]


def test_codes(spark):
    rng = np.random.default_rng(3)
    rows = [(int(i), int(rng.integers(0, 4)) or None, v.tolist()) for i, v in enumerate(rng.normal(0, 0.4, (700, 32)).astype(np.float32))]
    rows += [(9000 + i, 7, rows[5][2]) for i in range(300)] + [(3, 1, rows[9][2]), (3, 1, rows[9][2]), (None, None, rows[1][2])]  # copies, repeated ids
    rows += [(-5, 1, None), (-4, 1, []), (-3, 1, [None] * 32), (-2, 1, [float("nan")] * 32), (-1, 1, [0.0] * 31 + [float("inf")])]
    found, got = coded(spark, rows)
    assert sorted(got, key=str) == sorted(plain_codes(rows), key=str)
    # in the last round the entries have nearly settled: most parts keep their bounds
    assert len(found.seen) == 1 and found.seen[0] <= 16 * len(got)


@pytest.mark.parametrize("scale", [1.0, 90.0, 30_000.0])
def test_codes_of_few_and_large(spark, scale):
    rng = np.random.default_rng(4)
    rows = [(i, i % 2, (rng.normal(0, 1, 16) * scale).astype(np.float32).tolist()) for i in range(5)]
    for some in (rows, rows[:1], []):
        _, got = coded(spark, some)
        assert sorted(got) == sorted(plain_codes(some))


def test_many_labels(spark, monkeypatch):
    codes = spark.createDataFrame([(i, i % 5 or None, "00", i) for i in range(50)], "vec_id long, label long, code string, error long")
    want = sorted(map(str, vector_codes.with_label_errors(codes).collect()))
    monkeypatch.setattr(vector_codes, "MANY_LABELS", 2)
    assert sorted(map(str, vector_codes.with_label_errors(codes).collect())) == want


def test_bounds_spare_parts():
    """Parts whose bounds hold aren't looked at, and a round finds what a full scan does."""
    rng = np.random.default_rng(5)
    centres = rng.integers(-4000, 4000, (16, 8, 4))
    parts = centres.transpose(1, 0, 2)[rng.integers(0, 8, 2000)] + rng.integers(-30, 30, (2000, 16, 4))
    books = vector_codes.Codebooks(centres + rng.integers(-20, 20, centres.shape), np.zeros((16, 8)))
    heaps, sums = vector_codes.first_pass(parts, books)
    seen = 0
    for _ in range(3):
        books = vector_codes.moved(books, sums)
        heaps, gain, n = vector_codes.next_pass(parts, heaps, books)
        sums, seen = sums + gain, seen + n
        for m, heap in enumerate(heaps):
            best = np.empty(2000, int)
            best[heap.row] = heap.assigned()
            assert (best == vector_codes.distances(parts[:, m], books.entries[m]).argmin(1)).all()
    assert seen < 0.05 * 3 * 2000 * 16


def test_wrong_lengths(spark):
    for vectors in ([[0.1] * 15], [[0.1] * 16, [0.1] * 32], [[1e30] * 16]):
        with pytest.raises(Exception, match="components"):
            coded(spark, [(i, 0, v) for i, v in enumerate(vectors)])
