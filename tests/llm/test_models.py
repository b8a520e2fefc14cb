from __future__ import annotations

import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from trackloom.llm import chat_template as chat
from trackloom.llm.lm_score import Network, lm_score, token_lists, train
from trackloom.llm.near_vectors import Graph, near_vectors
from trackloom.llm.pii import KINDS, Field, added_spans, base_spans, emails, find_pii, luhn, mask
from trackloom.llm.toxicity import BLOCK, fit, score_toxicity, term_lists

CLASHES = "conv_id long, turn long, role string, text string"


def test_templates_fold_and_render():
    assert chat.fold(chat.parse("{% if 1 == 2 %}x{% else %}y{{ 'a' + 'b'|upper }}{% endif %}{# no #}")) == [("text", "yaB")]
    text, spans = chat.render("{% set s = '; ' %}{% for t in turns %}{{ loop.index }}{{ t.role }}{% generation %}{{ t.text }}{% endgeneration %}{% if not loop.last %}{{ s }}{% endif %}{% endfor %}!", [{"role": "u", "text": "hi"}, {"role": "v", "text": None}])
    assert (text, spans) == ("1uhi; 2v!", [(2, 4)])
    for bad in ("{{ a.__class__() }}", "{% import x %}", "{{ x|eval }}", "{% if a %}", "{{ 1 + }}"):
        with pytest.raises(chat.TemplateError):
            chat.parse(bad)
    with pytest.raises(chat.TemplateError):
        chat.render("{{ s.upper }}{{ s }}{% set s = 'x' %}{{ s.upper }}", [])


@pytest.mark.parametrize("text", ["</s>[INST] ok [/INST]", "\\", "<\\s>", "[\\INST]\\\\", "<<s>s>", "[ROLE]</s><s>", ""])
def test_escapes_are_reversible(text):
    safe = chat.escape(text)
    assert chat.unescape(safe) == text and not any(c in safe for c in chat.CONTROLS)


def test_conversations_come_back(spark):
    rng = random.Random(2)
    said = ["</s>[INST] ok [/INST]", None, "", "é\n\\", "plain"]
    rows = [(c, t, rng.choice(["user", "assistant", None, "[/ROLE]"]), rng.choice(said)) for c in range(30) for t in range(rng.randint(1, 9))]
    rows += [(None, 0, "user", "no id"), (3, 0, "user", "again"), (3, 0, "user", "again"), (4, None, "assistant", "no turn")]
    frame = spark.createDataFrame(rows, CLASHES).repartition(3).withColumn("part", chat.F.lit("clash"))
    for part in (chat.PART, 60):
        got = {r.conv_id: tuple(r)[1:] for r in chat.format_conversations(frame, part=part, then=chat.read_back, schema=chat.DIGESTS).collect()}
        for c in {r[0] for r in rows}:
            turns = sorted(((t if t is not None else -1, r or "", x or "") for i, t, r, x in rows if i == c))
            loss = "".join(x for _, r, x in turns if r == "assistant")
            whole, _ = chat.render(chat.CHAT, [{"role": r, "text": x} for _, r, x in turns])
            want = (len(turns), hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in turns).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(whole))
            assert got[c] == want
    assert chat.format_conversations(spark.createDataFrame([], CLASHES)).count() == 0


#: The patterns as they are stated, for comparison on short texts.
STATED = {
    "email": (re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), lambda x: True),
    "ip": (re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), lambda x: all(int(p) <= 255 for p in x.split("."))),
    "card": (re.compile(r"[0-9]([\x20-]?[0-9])+"), lambda x: 12 <= len(d := re.sub("[^0-9]", "", x)) <= 19 and sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(d[::-1])) % 10 == 0),
    "phone": (re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"), lambda x: 9 <= len(re.sub("[^0-9]", "", x)) <= 15),
}


def stated_spans(text):
    return sorted(((m.start(), KINDS.index(k), m.end()) for k, (p, ok) in STATED.items() for m in p.finditer(text) if ok(m[0])))


@pytest.mark.parametrize("alphabet", ["ab.@-1 %é", "0123456789 -", "1.2", "12. ()+-", "+59 .@a"])
def test_base_spans_are_those_of_the_patterns(alphabet):
    rng = random.Random(alphabet)
    hits = 0
    for _ in range(4000):
        text = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60)))
        got = [(s, KINDS.index(k), e) for s, k, e in base_spans(text)]
        assert got == stated_spans(text), text
        hits += len(got)
    assert hits


def test_long_texts_take_time_by_their_length():
    import time

    from trackloom.llm.pii import Words

    field = Field()
    for text in ("1" * 1_000_000, "1." * 500_000, "1.2.3.4 " * 100_000, "a@b.co " * 100_000, "+1 (555) 010-9999 " * 50_000, "+1" + "(" * 1_000_000):
        start = time.process_time()
        base = base_spans(text)
        added_spans(text, base, field)
        Words(text).labels(base)
        assert time.process_time() - start < 30, text[:20]


def test_patterns_of_personal_data():
    text = "a@b.co 1.2.3.4 999.1.1.1 x 4532015112830366 x 4532 0151 1283 0367 +1 (555) 010-9999 +12 1.2.3.4.5"
    assert [(k, text[s:e]) for s, k, e in base_spans(text)] == [("email", "a@b.co"), ("ip", "1.2.3.4"), ("card", "4532015112830366"), ("phone", "+1 (555) 010-9999"), ("ip", "1.2.3.4")]
    assert luhn("4532015112830366") and not luhn("4532015112830367")
    assert base_spans("0" * 6000 + ".1.1.1") == [(0, "ip", 6006)]
    assert mask("x a@b.co y", base_spans("x a@b.co y")) == "x [EMAIL] y"


def test_field_follows_distant_repeats():
    """A word that is like labelled ones only by its repetition is labelled through the skip link."""
    from trackloom.llm.pii import Words, _links, features

    rng = random.Random(5)
    documents = []
    for _ in range(300):
        text = " ".join([rng.choice(["call", "see", "of"]), f"u{rng.randint(10, 99)}@m{rng.randint(1, 9)}.example.com", "and", str(rng.randint(1, 99)), "end"])
        w = Words(text)
        documents.append((np.array(w.features), _links(w.chain), _links(w.skip), np.array(w.labels(base_spans(text)))))
    field = Field()
    field.fit(documents)
    words, _, _ = field.marginals(np.array(Words("mail z77@m3.example.com now").features), _links([]), _links([]))
    assert words[0].argmax() == KINDS.index("email") + 1
    alone = field.marginals(np.array([features("17", "x", "y")] * 2), _links([]), _links([(0, 1)]))[0]
    assert alone[0].argmax() == 0 and added_spans("x 17 y", [], field) == []
    field.skip[1, 1] += 6
    field.word[features("q9q", "k", "z"), 1] += 0.0
    tied = field.marginals(np.array([Words("mail z77@m3.example.com now").features[0], features("q9q", "k", "z")]), _links([]), _links([(0, 1)]))[0]
    free = field.marginals(np.array([features("q9q", "k", "z")]), _links([]), _links([]))[0]
    assert tied[1, 1] > free[0, 1]


def test_marginals_are_exact_on_a_chain():
    rng = np.random.default_rng(1)
    field = Field()
    field.word, field.chain = rng.normal(size=field.word.shape), rng.normal(size=field.chain.shape)
    features = rng.integers(0, 1024, (3, 10))
    own = field.word[features].sum(axis=1)
    joint = np.exp(own[0][:, None, None] + own[1][None, :, None] + own[2][None, None, :] + field.chain[:, :, None] + field.chain[None, :, :])
    joint /= joint.sum()
    words, pair, _ = field.marginals(features, np.array([[0, 1], [1, 2]]), np.zeros((0, 2), np.int64))
    assert np.abs(words[1] - joint.sum(axis=(0, 2))).max() < 0.02
    assert np.abs(pair[0] - joint.sum(axis=2)).max() < 0.02


def test_personal_data_of_a_table(spark, docs, rows, empty):
    got = find_pii(docs, keep=["lang"]).collect()
    assert len(got) == len(rows)
    for r in got[:20]:
        text = next(t for i, t, *_ in rows if i == r.doc_id)
        assert [(x.start, x.kind, x.end) for x in r.base] == base_spans(text or "")
    assert [r.masked for r in got if r.doc_id is not None and next(t for i, t, *_ in rows if i == r.doc_id) is None] == [None]
    assert find_pii(empty).count() == 0


def toxic_table(spark, n=400):
    rng = random.Random(6)
    bad = ["vile", "nasty", "grim", "foul"]
    docs, labels = [], []
    for i in range(n):
        toxic = i % 4 == 0
        words = [f"w{rng.randint(0, 300)}" for _ in range(60)]
        if toxic:
            for _ in range(6):
                words[rng.randrange(60)] = rng.choice(bad)
        docs.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int"), dict(labels)


def test_toxicity_held_out(spark, empty):
    from trackloom.llm.queries import held_out

    docs, labels, truth = toxic_table(spark)
    got = {r.doc_id: r for r in score_toxicity(docs, labels, ~held_out()).collect()}
    held = [i for i in truth if zlib.crc32(str(i).encode()) % 3 == 1]
    right = sum(got[i].predicted == truth[i] for i in held)
    assert len(held) > 50 and right / len(held) > 0.95
    assert all(zlib.crc32(str(e).encode()) % 3 != 1 for r in got.values() for e in r.evidence_ids)
    odd = spark.createDataFrame([(None, "vile nasty"), (1, None), (1, ""), (2, " ")], "doc_id long, text string")
    assert odd.count() == len(score_toxicity(odd.unionByName(docs), labels).where("doc_id is null or doc_id < 3").collect()) - 3
    assert score_toxicity(empty, labels).count() == 0
    none = score_toxicity(docs, labels.limit(0)).collect()
    assert len(none) == 400 and {r.predicted for r in none} == {0}


def test_block_max_search_is_exact(spark):
    docs, labels, truth = toxic_table(spark, 900)
    model = fit(docs.join(labels, "doc_id").selectExpr("doc_id", "toxic", "text as t"), {0: 675, 1: 225}, docs.select("text"))[0].value
    index = model.index
    assert index.size == 900 > 2 * BLOCK
    vectors = [index.vector(x) for x in term_lists(pa.array([r.text for r in docs.orderBy("doc_id").collect()]))]
    for common in (0, 40, len(index.vocabulary)):
        small = type(index).of(index.vocabulary, index.weight, vectors, common)
        dense = np.zeros((len(index.vocabulary), small.size))
        for e, (t, w) in enumerate(vectors):
            dense[t, e] = w.astype(np.float32)
        for k in (1, 10, 2000):
            without = list(range(60))
            for alone in (None, without):
                for e, (places, values) in enumerate(small.nearest(vectors[:60], k, alone)):
                    t, w = vectors[e]
                    every = w @ dense[t]
                    assert np.allclose(every[places], values, atol=1e-9)
                    if alone:
                        every[e] = 0
                        assert e not in places
                    best = np.sort(every[every > 0])[::-1][:k]
                    assert np.allclose(values, best, atol=1e-9) and len(values) == len(best)


def test_toxicity_is_brute_force(spark):
    """Scores and evidence of a whole table from dictionaries, without an index."""
    import math

    from trackloom.llm import toxicity

    rng = random.Random(12)
    rows = []
    for i in range(160):
        words = [f"w{rng.randint(0, 90)}long" for _ in range(rng.randint(0, 30))] + (["Vile!", "gräßlich"] if i % 3 == 0 else [])
        rng.shuffle(words)
        rows.append((i, " ".join(words) if i % 40 else None))
    labels = [(i, int(i % 3 == 0)) for i in range(0, 160, 2)] + [(999, 1), (3, None)]
    frame, known = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    got = {r.doc_id: r for r in score_toxicity(frame.withColumn("t", chat.F.lit("clash")), known).collect()}

    def bag(text):
        words = [w.lower().encode() for w in re.findall(r"[A-Za-z0-9\u0080-\U0010ffff]+", text or "")]
        out: dict = {}
        for w in [(w, "whole") for w in words] + [(w[:5], "head") for w in words if len(w) > 5]:
            out[w] = out.get(w, 0) + 1
        return out

    bags = {i: bag(t) for i, t in rows}
    toxic = {i: y for i, y in labels if i in bags and y is not None}
    n1, n0 = sum(toxic.values()), len(toxic) - sum(toxic.values())
    weight = {}
    for t in {t for i in toxic for t in bags[i]}:
        df = sum(t in b for b in bags.values())
        a, b = sum(t in bags[i] for i in toxic if toxic[i]), sum(t in bags[i] for i in toxic if not toxic[i])
        tells = math.log((a + 0.5) / (n1 + 1)) - math.log((b + 0.5) / (n0 + 1)) - toxicity.CAUTION * math.sqrt(1 / (a + 0.5) + 1 / (b + 0.5))
        weight[t] = (math.log((1 + len(rows)) / (1 + df)) + 1) * (toxicity.LEAST + max(tells, 0))

    def unit(b):
        w = {t: (1 + math.log(n)) * weight[t] for t, n in b.items() if t in weight}
        norm = math.sqrt(sum(x * x for x in w.values()))
        return {t: x / norm for t, x in w.items()}

    vectors = {i: unit(bags[i]) for i in toxic}
    pull = {1: (n1 + 1) / n1, 0: n0 / n0}  # 999 is a labelled row whose text is not there

    def vote(b, without=None):
        q = unit(b)
        near = sorted(((sum(x * v.get(t, 0) for t, x in q.items()), i) for i, v in vectors.items() if i != without), reverse=True)
        near = [(c, i) for c, i in near if c > 1e-12][: toxicity.NEIGHBOURS]
        total = sum(pull[toxic[i]] / (1.05 - min(c, 1)) for c, i in near)
        return (sum(pull[1] / (1.05 - min(c, 1)) for c, i in near if toxic[i]) / total if near else -1), near

    own = sorted((i, vote(bags[i], i)[0]) for i in toxic)
    at = [i for i, v in own if v >= 0]
    steps, rates = toxicity.isotonic(np.array([v for _, v in own if v >= 0]), np.array([float(toxic[i]) for i in at]), np.array([pull[toxic[i]] for i in at]))
    for i, _ in rows:
        v, near = vote(bags[i])
        if v >= 0:
            assert abs(got[i].score - np.interp(v, steps, rates)) < 1e-6
            assert np.allclose(sorted(got[i].evidence_cosines), sorted(c for c, _ in near))
        else:
            assert got[i].evidence_ids == []
    assert sum(r.predicted for r in got.values()) > 20


def test_language_model_scores_by_its_network(spark, docs, rows, empty):
    model = train(docs, epochs=5)
    got = {r.doc_id: r for r in lm_score(docs, model=model).collect()}
    for i in (0, 7, 70):
        tokens = next(token_lists(pa.array([rows[i][1]])))
        each = model.log_probabilities(tokens)
        assert got[i].n_tokens == len(tokens) and abs(got[i].log_likelihood - each.sum()) < 1e-3 * len(tokens)
    nothing = [r for r in got.values() if r.n_tokens == 0]
    assert len(nothing) == 3 and all(r.log_likelihood == 0 and r.mean_log_likelihood is None for r in nothing)
    assert lm_score(empty).count() == 0


def test_network_learns_from_both_sides():
    rng = np.random.default_rng(0)
    from trackloom.llm.lm_score import CLASSES, N_CONTEXTS, contexts

    table = np.zeros((N_CONTEXTS, CLASSES))
    for _ in range(300):
        c = rng.integers(0, 8, 40)
        c[1::2] = (np.roll(c, 1)[1::2] + np.roll(c, -1)[1::2]) % 8  # the middle follows from its neighbours together
        np.add.at(table, (contexts(c), c), 1)
    network = Network()
    history = network.fit(table, 30)
    assert history[-1] > history[0] + 0.3
    logp = network.forward(np.flatnonzero(table.sum(axis=1))[:10])[2]
    assert np.allclose(np.exp(logp).sum(axis=1), 1)


def vectors(n=600, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 16)).astype(np.float32)
    for k in range(0, 120, 3):
        x[k + 1] = x[k] + 0.02 * rng.normal(size=16)
    x[200:260] = x[200] + 0.03 * rng.normal(size=(60, 16))
    x[300:310] = x[300]
    return x, rng.integers(0, 3, n)


def brute_vectors(rows, threshold=0.98):
    """(vec_id, n_links, component_id) of each row: vectors are distinct (id, label, components)."""
    def fine(r):
        return r[0] is not None and r[1] is not None and r[2] is not None and len(r[1]) and all(c is not None and np.isfinite(c) for c in r[1]) and any(r[1])

    nodes = sorted({(r[0], r[2], tuple(r[1])) for r in rows if fine(r)})
    links = {n: [m for m in nodes if m != n and m[1] == n[1] and len(m[2]) == len(n[2]) and np.dot(n[2], m[2]) / np.linalg.norm(n[2]) / np.linalg.norm(m[2]) >= threshold] for n in nodes}
    low = {}
    for n in nodes:
        seen, todo = {n}, [n]
        while todo:
            for m in links[todo.pop()]:
                if m not in seen:
                    seen.add(m)
                    todo.append(m)
        low[n] = min(m[0] for m in seen)
    return sorted(((r[0], len(links[k := (r[0], r[2], tuple(r[1]))]), low[k]) if fine(r) else (r[0], 0, r[0]) for r in rows), key=repr)


def test_vectors_of_repeated_ids(spark):
    """Equal rows are one vector, one id under two labels is two, and so are two vectors of one id and label."""
    a, b, c = [1.0, 0.0, 0.01], [1.0, 0.0, 0.02], [0.0, 1.0, 0.0]
    rows = [(5, a, 1), (5, a, 1), (1, a, 1), (2, b, 1), (1, c, 2), (3, c, 2), (1, c, 1), (7, c, 1), (7, c, 1), (9, b, None), (None, a, 1)]
    rows += [(20 + i, [float(x) for x in np.random.default_rng(i // 2).normal(size=3)], i % 3) for i in range(40)]
    got = near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("key", chat.F.lit("clash")), shard=8).collect()
    assert sorted(((r.vec_id, r.n_links, r.component_id) for r in got), key=repr) == brute_vectors(rows)


def test_audits_are_written(spark, tmp_path):
    x, label = vectors()
    frame = spark.createDataFrame([(i, [float(c) for c in v], int(k)) for i, (v, k) in enumerate(zip(x, label))], "vec_id long, embedding array<float>, label int")
    near_vectors(frame, shard=100, audits=str(tmp_path / "audits")).count()
    rows = spark.read.parquet(str(tmp_path / "audits")).collect()
    assert sum(r.vectors for r in rows) == len({tuple(v) + (k,) for v, k in zip(x.tolist(), label.tolist())})
    assert all(r.recall >= 0.9 for r in rows) and any(r.linked for r in rows)


def test_near_vectors_find_the_links(spark):
    x, label = vectors()
    label[200:260] = 1
    rows = [(i, [float(c) for c in v], int(k)) for i, (v, k) in enumerate(zip(x, label))]
    rows += [(1000, None, 1), (1001, [0.0] * 16, 1), (1002, [float("nan")] * 16, 1), (1003, [None] * 16, 1), (1004, [1.0, 2.0], 1), (1005, [1.0, 2.0], None), (1006, [], 1), (None, [1.0, 2.0], 1)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(4).withColumn("g", chat.F.lit("clash"))
    got = {r.vec_id: r for r in near_vectors(frame, shard=100).collect()}
    assert len(got) == len(rows)
    d = x.astype(float)
    unit = d / np.linalg.norm(d, axis=1, keepdims=True)
    near = (unit @ unit.T >= 0.98) & (label[:, None] == label[None, :])
    np.fill_diagonal(near, False)
    found = sum(got[i].n_links for i in range(600))
    assert 0.97 * near.sum() <= found <= near.sum()
    root = np.arange(600)
    for _ in range(600):
        low = np.array([min(root[i], root[near[i]].min()) if near[i].any() else root[i] for i in range(600)])
        if (low == root).all():
            break
        root = low
    assert np.mean([got[i].component_id == root[i] for i in range(600)]) > 0.99
    assert all(got[i].n_links == 0 and got[i].component_id == i and got[i].kept for i in (1000, 1001, 1002, 1003, 1005, 1006))
    assert near_vectors(frame.limit(0)).count() == 0


def test_graph_audit_widens():
    x, _ = vectors(900, 3)
    unit = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(float)
    graph = Graph(unit)
    width = graph.audited(0.98, 4)
    truth = unit @ unit.T >= 0.98
    found = sum(truth[i, ids].sum() for i, ids in enumerate(graph.near(unit, 0.98 - 1e-5, width)))
    assert found >= 0.97 * truth.sum()


def test_language_model_knows_every_word(spark):
    """More words than any fixed table had, each with its own count."""
    from pyspark.sql import functions as F

    docs = spark.range(25).select(F.col("id").alias("doc_id"), F.concat_ws(" ", F.transform(F.sequence(F.col("id") * 10_000, F.col("id") * 10_000 + 9_999), lambda k: F.concat(F.lit("w"), k))).alias("text"))
    model = train(docs, epochs=0)
    assert model.words.count() == 250_000 == model.total


def test_language_model_predicts_words_from_their_context(spark):
    from trackloom.llm.lm_score import CLASSES, EDGE, RIGHT, UNSEEN, classes_of

    rng = random.Random(8)
    often = [f"{c}{c}" for c in "abcdefghijklmnopqrstuvwx"]
    rare = {s: [f"{s}{i}ing" for i in range(40)] for s in ("u", "v")}  # one ending
    pairs = [rng.choice((("aa", "u"), ("bb", "v"))) for _ in range(3000)] + [(w, "") for w in often for _ in range(60)]
    rng.shuffle(pairs)
    words = [x for a, s in pairs for x in (a, rng.choice(rare[s]) if s else "cc")]
    docs = spark.createDataFrame([(i, " ".join(words[i * 50 : i * 50 + 50])) for i in range(-(-len(words) // 50))], "doc_id long, text string")
    model = train(docs, epochs=1)
    fits, not_ = (model.log_probabilities(next(token_lists(pa.array([f"cc {a} u7ing cc"]))))[2] - model.network.forward(at)[2][0, c] for a, at, c in [(a, *_place(model, f"cc {a} u7ing cc", 2)) for a in ("aa", "bb")])
    assert fits > not_ + 1  # the left half of the mixture has three times as much
    known = {r.w: (r.n, r.beside) for r in model.words.collect()}
    of = classes_of(np.array(list(known)), model.frequent)
    for c in range(CLASSES):  # the words of a class and its unknown ones sum to 1 in every context
        for left, right in ((EDGE, 0), (0, 1), (1, EDGE)):
            spread = float(model.spread(np.array([c]), np.array([left]), np.array([right]))[0])
            mine = [known[w] for w, k in zip(known, of) if k == c]
            total = sum((b.get(left, 0) + b.get(right + RIGHT, 0)) / 2 + spread * (n + UNSEEN) for n, b in mine) + spread * UNSEEN
            assert abs(total - 1) < 1e-9
    joined, looked_up = ({r.doc_id: r.log_likelihood for r in lm_score(docs, model=model, head=h).collect()} for h in (1, 1 << 16))
    assert all(abs(joined[i] - looked_up[i]) < 1e-3 for i in joined) and len(joined) == docs.count()


def _place(model, text: str, i: int):
    from trackloom.llm.lm_score import classes_of, contexts

    c = classes_of(next(token_lists(pa.array([text]))), model.frequent)
    return contexts(c)[i : i + 1], c[i]


def test_audit_does_not_count_a_vector_itself():
    """Beside one hot cluster, whose links outnumber all others, each lone pair has to be found; without links there is nothing to pass."""
    from trackloom.llm.near_vectors import EXACT

    rng = np.random.default_rng(2)
    x = rng.normal(size=(900, 16))
    x[:300] = x[0] + 0.001 * rng.normal(size=(300, 16))
    x[301:900:2] = x[300:900:2] + 0.001 * rng.normal(size=(300, 16))
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    graph = Graph(unit)
    graph.layers[0][300:] = -1  # nothing leads to the pairs or away from them
    for layer in graph.layers:
        layer[layer >= 300] = -1
    width = graph.audited(0.98)
    near = graph.near(unit, 0.98 - 1e-5, width)
    assert all(i ^ 1 in near[i] for i in range(300, 900))
    apart = rng.normal(size=(200, 64))
    assert Graph(apart / np.linalg.norm(apart, axis=1, keepdims=True)).audited(0.98) == EXACT
