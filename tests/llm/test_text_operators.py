from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from trackloom.llm import textkit
from trackloom.llm.decontaminate import decontaminate
from trackloom.llm.ngram_join import ngram_jaccard_join
from trackloom.llm.packing import best_fit, pack, patterns, plan
from trackloom.llm.sharding import SlotMap, shard
from trackloom.llm.substring_dedup import FingerprintIndex, substring_dedup
from trackloom.llm.tokens import _exact, encode, vocabulary_path

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def shingles(text, lower=True):
    w = WORD.findall((text or "").translate(LOWER) if lower else (text or ""))
    if len(w) >= 5:
        return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    return frozenset([tuple(w)] if w else [])


def test_word_hashes_agree_with_words():
    texts = ["a b  c", None, "", "b\ta\n", "é a\x0bb", "x" * 3_000_000 + " a", " a"]
    raw, at = textkit.buffers(pa.array(texts))
    starts, ends, first = textkit.word_spans(raw, at)
    h = textkit.word_hashes(raw, starts, ends, False)
    words = [w for t in texts for w in WORD.findall(t or "")]
    assert [bytes(raw[s:e]).decode() for s, e in zip(starts, ends)] == words
    assert len({(w, int(v)) for w, v in zip(words, h)}) == len(set(words)) == len(set(h.tolist()))
    assert np.diff(first).tolist() == [len(WORD.findall(t or "")) for t in texts]


def test_window_hashes_agree_however_they_are_made():
    words = textkit.mix(np.arange(50, dtype=np.uint64))
    runs = words[np.arange(38)[:, None] + np.arange(13)]
    assert (textkit.run_hashes(runs, 2) == textkit.shingle_hashes(words, 13, 2)).all()


def brute_components(rows):
    sets = {(i, k): shingles(t) for k, (i, t, *_) in enumerate(rows) if i is not None}
    keys = [k for k in sets if sets[k]]
    parent = {k[0]: k[0] for k in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(keys)):
        for b in range(a):
            x, y = sets[keys[a]], sets[keys[b]]
            n = len(x & y)
            if n and 100 * n >= 80 * (len(x) + len(y) - n):
                u, v = find(keys[a][0]), find(keys[b][0])
                parent[max(u, v)] = min(u, v)
    return Counter((i, len(shingles(t)), find(i) if i is not None and shingles(t) else i) for i, t, *_ in rows)


@pytest.mark.parametrize("sizes", [{}, {"small": 0}, {"id_bits": 4}])
def test_jaccard_join_is_brute_force(docs, rows, sizes):
    """However ids are brought to the texts, and where different sets get one id at first."""
    got = Counter(tuple(r) for r in ngram_jaccard_join(docs, **sizes).collect())
    assert got == brute_components(rows)


def unlike(n: int) -> tuple[str, str]:
    """Two words of n letters that agree in all sums over powers of two: the Thue-Morse sequence and its complement."""
    bits = [bin(i).count("1") % 2 for i in range(n)]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


@pytest.mark.parametrize("n", [8, 32, 64, 128, 1024])
def test_different_words_have_different_hashes(spark, n):
    one, two = unlike(n)
    pair = [(k, " ".join(f"{w}{i}" for i in range(13))) for k, w in ((1, one), (2, two))]
    pair += [(3, " ".join([one] * 13)), (4, " ".join([two] * 13))]
    frame = spark.createDataFrame(pair, "doc_id long, text string")
    assert sorted((r.doc_id, r.component_id) for r in ngram_jaccard_join(frame).collect()) == [(k, k) for k in (1, 2, 3, 4)]
    assert {r.n_removed for r in substring_dedup(frame).collect()} == {0}


@pytest.mark.parametrize("whole", [40_000, 0])
def test_jaccard_join_of_crowded_families(spark, whole):
    """Many near copies of few texts, so that prefix groups are crowded and a second round is needed."""
    import random

    rng = random.Random(1)
    rows = []
    for f in range(4):
        base = [f"f{f}w{rng.randint(0, 400)}" for _ in range(150)]
        for _ in range(40):
            near = list(base)
            for _ in range(rng.randint(0, 7)):
                near[rng.randrange(150)] = f"r{rng.random()}"
            rows.append((len(rows), " ".join(near)))
    got = Counter(tuple(r) for r in ngram_jaccard_join(spark.createDataFrame(rows, "doc_id long, text string"), whole=whole).collect())
    assert got == brute_components(rows)


def brute_dedup(rows, width=13):
    first = {}
    for i, t, *_ in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        w = WORD.findall(t or "")
        for k in range(len(w) - width + 1):
            first.setdefault(tuple(w[k : k + width]), i)
    out = Counter()
    for i, t, *_ in rows:
        w = WORD.findall(t or "")
        gone = np.zeros(len(w), bool)
        for k in range(len(w) - width + 1):
            if i is not None and first[tuple(w[k : k + width])] < i:
                gone[k : k + width] = True
        out[(i, len(w), int(gone.sum()), " ".join(x for x, g in zip(w, gone) if not g))] += 1
    return out


@pytest.mark.parametrize(("batches", "small"), [(1, 1_000_000), (4, 1_000_000), (4, 0)])
def test_substring_dedup_is_brute_force(docs, rows, batches, small):
    assert Counter(tuple(r) for r in substring_dedup(docs, batches, small=small).collect()) == brute_dedup(rows)


def test_fingerprint_index_compacts_and_keeps_earlier_batches(spark):
    passage = " ".join(f"p{i}" for i in range(30))
    index = FingerprintIndex(spark, fan=2)
    kept = []
    for b in range(4):
        batch = spark.createDataFrame([(100 - b, f"head{b} {passage}"), (50 - b, f"own{b} only")], "doc_id long, t string")
        kept.append(sorted(tuple(r) for r in index.add(batch).collect()))
    assert len(index.runs) <= 2
    assert kept[0][1] == (100, 31, 0, f"head0 {passage}")
    assert [k[1] for k in kept[1:]] == [(100 - b, 31, 30, f"head{b}") for b in (1, 2, 3)]


def held(item, text) -> tuple[int, int]:
    """Distinct shingles of an item, and how many of them are in the text, at the item's own width if it has fewer than five words."""
    q, t = WORD.findall((item or "").lower()), WORD.findall((text or "").lower())
    m = min(len(q), 5)
    of = lambda w: {tuple(w[i : i + m]) for i in range(len(w) - m + 1)} if m else set()
    return len(of(q)), len(of(q) & of(t))


@pytest.mark.parametrize("small", [200_000, 0])
def test_decontamination_is_brute_force(spark, docs, rows, small):
    texts = {i: t for i, t, *_ in rows if i is not None}
    words = WORD.findall(texts[20])
    items = [(0, " ".join(words[:16])), (1, " ".join(words[2:12]).upper()), (2, None), (3, ""), (4, "one two three four"), (5, " ".join([*words[:30], "odd"])), (6, texts[3]), (6, texts[3]), (None, texts[3]), (7, "nowhere at all to be found here")]
    frame = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit("clash"))
    items += [(8, " ".join(words[7:11])), (9, words[9]), (10, "b c d"), (11, "b d c"), (12, "four three")]
    frame = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit("clash"))
    want = set()
    for j, q in items:
        for i, t in texts.items():
            size, n = held(q, t)
            if j is not None and size and 100 * n >= 80 * size:
                want.add((i, j, size, n))
    assert {8, 9, 10} <= {j for _, j, _, _ in want}
    got = decontaminate(docs, frame, small=small).collect()
    assert {tuple(r)[:4] for r in got} == want and len(got) == len(want)
    assert all(abs(r.containment - r.n_found / r.n_item) < 1e-12 for r in got)
    assert {3, 20} <= {r.doc_id for r in got}


def test_decontamination_runs_no_python(docs, spark):
    items = spark.createDataFrame([(1, "a b c d e")], "item_id long, text string")
    text = decontaminate(docs, items)._jdf.queryExecution().toString()
    assert "Python" not in text and "Pandas" not in text and "Arrow" not in text


def test_sharding(docs, rows):
    got = shard(docs, n_shards=7, slots=256).collect()
    assert len(got) == len(rows)
    want = Counter((i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t, *_ in rows)
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in got) == want
    for k in {r.shard for r in got}:
        assert sorted(r.slot for r in got if r.shard == k) == list(range(sum(r.shard == k for r in got)))


def test_shards_of_a_table_are_even(spark):
    """On a table with copies and texts of very different lengths the shards' bytes are nearly equal."""
    import random

    rng = random.Random(9)
    rows = [(i, "x" * int(rng.paretovariate(1.1) * 50)) for i in range(6000)] + [(i, "copy") for i in range(6000, 9000)]
    rows = [(i, t[:20_000]) for i, t in rows]
    got = shard(spark.createDataFrame(rows, "doc_id long, text string"), n_shards=40).collect()
    load = Counter()
    for r in got:
        load[r.shard] += r["size"]
    assert len(load) == 40 and max(load.values()) - min(load.values()) <= 0.01 * sum(load.values()) / 40
    assert all(r["size"] == len(rows[r.doc_id][1]) + 16 for r in got)


def test_slot_map_versions(spark, tmp_path):
    size = [(i * 7919) % 1000 + 1 for i in range(512)]
    one = SlotMap.dealt(8, 512)
    two = one.rebalanced(size)
    load = Counter()
    for s, k in enumerate(two.shard_of):
        load[k] += size[s]
    assert max(load.values()) - min(load.values()) <= 2
    three = two.rebalanced(size, 9)
    moved = [s for s in range(512) if two.shard_of[s] != three.shard_of[s]]
    assert len(moved) < 512 / 9 * 2 and three.version == 3
    for m in (one, two, three):
        m.save(spark, str(tmp_path / "map"))
    assert SlotMap.load(spark, str(tmp_path / "map"), 8, 2).shard_of == two.shard_of
    assert SlotMap.load(spark, str(tmp_path / "map"), 9).shard_of == three.shard_of


def test_tokens_are_those_of_the_library():
    path = vocabulary_path()
    for text in ["Hello  world\n\n x", "ßé ñ  ", "<|endoftext|> a", "", " " * 5000 + "x", "a" * 3000, "\U0001f600 ‍"]:
        assert encode(text, path) == _exact(path).encode(text, add_special_tokens=False).ids


def test_tokens_of_a_corpus_are_those_of_the_library():
    """Both ways to the ids give the same on generated texts of many scripts, spaces, marks and repetitions."""
    import random

    rng = random.Random(21)
    path = vocabulary_path()
    parts = ["the", "Straße", "naïve", "don't", "I'LL", "42", "3.14", " ", "  ", "\n", "\n\n", "\t", "\r\n", "\u00a0", "\u200b", "é", "e\u0301", "日本語", "\U0001f469\u200d\U0001f4bb", "مرحبا", "!!!", "...", "--", "$", "\x00", "\ufeff", "aaaaaaaaaaaa", "'s", "<|", "|>", "١٢٣", "ǅ", "ⅷ"]
    for _ in range(1500):
        text = rng.choice(("", " ")).join(rng.choice(parts) for _ in range(rng.randint(1, 60)))
        assert encode(text, path) == _exact(path).encode(text, add_special_tokens=False).ids, repr(text)


def test_packing_of_equal_rows(spark):
    """Repeated rows, without an id or with one, are pieces of their own; full pieces too."""
    rows = [(None, "x y z")] * 700 + [(4, "a " * 3000)] * 5 + [(4, None)] * 30
    got = pack(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), vocabulary_path()).collect()
    by = Counter()
    seats = set()
    for r in got:
        by[r.sequence_id] += r.length
        seats.add((r.sequence_id, r.offset))
    assert len(seats) == len(got) and max(by.values()) <= 1024
    assert sum(r.start == 0 for r in got) == len(rows)
    assert len(by) <= sum(by.values()) / 1024 * 1.02 + 2


def test_packing(docs, rows):
    path = vocabulary_path()
    got = pack(docs, path).collect()
    want = Counter()
    for i, t, *_ in rows:
        ids = [*_exact(path).encode(t or "", add_special_tokens=False).ids, 0]
        for s in range(0, len(ids), 1024):
            part = np.array(ids[s : s + 1024], "<u4")
            want[(i, s, len(part), zlib.crc32(part.tobytes()), len(ids))] += 1
    assert Counter(tuple(r)[:5] for r in got) == want
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for pieces in by.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 1024


def test_column_generation_is_near_the_bound():
    rng = np.random.default_rng(0)
    lengths = np.unique(rng.integers(1, 400, 150))
    counts = rng.integers(1, 400, len(lengths))
    total = sum(v for _, v in patterns(lengths, counts))
    assert total <= (lengths * counts).sum() / 1024 * 1.005 + 1
    planned = plan(dict(zip(lengths.tolist(), counts.tolist())))
    used = Counter()
    for pattern, times in planned:
        assert sum(n * k for n, k in pattern.items()) <= 1024
        for n, k in pattern.items():
            used[n] += k * times
    assert used == Counter(dict(zip(lengths.tolist(), counts.tolist())))
    assert plan({}) == [] and plan({5: 1}) == [({5: 1}, 1)]
    assert sum(best_fit({600: 3, 400: 2}).values()) == 3


def test_empty_tables(spark, empty):
    items = spark.createDataFrame([(1, "a b c d e f")], "item_id long, text string")
    assert ngram_jaccard_join(empty).count() == 0
    assert substring_dedup(empty).count() == 0
    assert decontaminate(empty, items).count() == 0
    assert shard(empty).count() == 0
    assert pack(empty, vocabulary_path()).count() == 0


def test_digest_of_kept_text(docs):
    row = substring_dedup(docs.where("doc_id = 20")).select(F.sha2("kept", 256).alias("d"), "kept").first()
    assert row.d == hashlib.sha256(row.kept.encode()).hexdigest()


def test_a_repeated_row_does_not_add_up(spark):
    words = [f"q{i}" for i in range(60)]
    items = spark.createDataFrame([(1, " ".join(words))], "item_id long, text string")
    half, whole = " ".join(words[:36]), " ".join(words)
    docs = spark.createDataFrame([(1, half), (1, half), (1, half), (2, whole), (2, whole)], "doc_id long, text string")
    got = decontaminate(docs, items).collect()
    assert [(r.doc_id, r.n_found) for r in got] == [(2, got[0].n_item)] and got[0].containment == 1
