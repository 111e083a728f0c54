"""Quality, language and toxicity: held-out accuracy, odd rows, and the parts against brute force."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from rivulet.llm import language as L
from rivulet.llm import quality as Q
from rivulet.llm import toxicity as T
from tests.llm.helpers import empty, labels, messy, messy_rows, prose, with_null_ids

HELD = lambda i: i is not None and zlib.crc32(str(i).encode()) % 4 == 2


@pytest.fixture(scope="module")
def corpus():
    """(doc_id, text, lang, source) with labels: junk is of low quality, a few words are toxic."""
    rnd = random.Random(9)
    rows, marks = [], []
    tongues = {"en": ["the", "and", "of"] + [f"{a}ing" for a in "bcdfghklmnprst"], "de": ["der", "und", "für"] + [f"{a}schaft" for a in "bcdfghklmnprst"],
               "fr": ["le", "et", "été"] + [f"{a}eaux" for a in "bcdfghklmnprst"]}
    for i in range(600):
        lang = rnd.choice(list(tongues))
        words = [rnd.choice(tongues[lang]) for _ in range(rnd.randint(3, 120))]
        good, toxic = rnd.random() < 0.7, rnd.random() < 0.2
        if toxic:
            for _ in range(3):
                words.insert(rnd.randrange(len(words)), rnd.choice(["zorkface", "zorkling", "blarg", "zorky"]))
        if not good:
            words = [w.upper() + "!!" for w in words]
        rows.append((i, " ".join(words), lang, "a"))
        marks.append((i, int(good), int(toxic)))
    return rows, marks


def held_accuracy(out, truth, column):
    held = [(r[column], truth[r.doc_id]) for r in out if r.held_out]
    assert len(held) > 80
    return sum(a == b for a, b in held) / len(held)


def test_quality_held_out(spark, corpus):
    rows, marks = corpus
    out = Q.quality(messy(spark, rows), labels(spark, marks)).collect()
    assert all(r.held_out == HELD(r.doc_id) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in out)
    assert held_accuracy(out, {i: q for i, q, _ in marks}, "predicted") > 0.97


def test_toxicity_held_out(spark, corpus):
    rows, marks = corpus
    out = T.toxicity(messy(spark, rows), labels(spark, marks)).collect()
    assert all(r.held_out == HELD(r.doc_id) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in out)
    assert held_accuracy(out, {i: t for i, _, t in marks}, "predicted") > 0.97
    learned = {i for i, *_ in marks if not HELD(i)}
    assert all(e.id in learned for r in out for e in r.evidence) and any(r.evidence for r in out)


def test_language_held_out(spark, corpus):
    rows, _ = corpus
    out = L.identify(messy(spark, rows)).collect()
    assert held_accuracy(out, {i: lang for i, _, lang, _ in rows}, "lang_pred") > 0.97
    assert all(0 <= r.score <= 1 for r in out)


def test_held_out_rows_teach_nothing(spark, corpus):
    rows, marks = corpus
    lied = [(i, 1 - q if HELD(i) else q, 1 - t if HELD(i) else t) for i, q, t in marks]
    docs, lied_docs = messy(spark, rows), messy(spark, [(i, t, "xx" if HELD(i) else lang, s) for i, t, lang, s in rows])
    score = lambda out: {r.doc_id: round(r.score, 9) for r in out.collect()}
    assert score(Q.quality(docs, labels(spark, marks))) == score(Q.quality(docs, labels(spark, lied)))
    assert score(T.toxicity(docs, labels(spark, marks))) == score(T.toxicity(docs, labels(spark, lied)))
    assert score(L.identify(docs)) == score(L.identify(lied_docs))


def test_odd_rows(spark):
    rows = with_null_ids(messy_rows())
    docs = messy(spark, rows)
    marks = [(r[0], k % 2, k % 3 == 0) for k, r in enumerate(rows)]
    marks = labels(spark, [(i, None if k == 3 else q, int(t) if k != 4 else None) for k, (i, q, t) in enumerate(marks)] + [(None, None, None)])
    for out in (Q.quality(docs, marks), T.toxicity(docs, marks), L.identify(docs)):
        got = out.collect()
        assert len(got) == len(rows) and all(r.score is not None and 0 <= r.score <= 1 for r in got)
        by_id = {}
        for r in got:
            by_id.setdefault(r.doc_id, set()).add(r.score)
        assert len(by_id[70]) == 1 and len(by_id[5]) == 1  # repeated rows
    pred = {r.doc_id: r.lang_pred for r in L.identify(docs).collect()}
    assert pred[71] == pred[70] == pred[72] == pred[74] == "und" and pred[73] != "und"
    accepted = Q.accepted(docs, marks)
    assert accepted.columns == docs.columns


def test_nothing_to_learn_from(spark):
    rows = messy_rows()
    docs, none = messy(spark, rows), labels(spark, [])
    assert {r.score for r in Q.quality(docs, none).collect()} == {0.5}
    assert {r.score for r in T.toxicity(docs, none).collect()} == {0.5}
    unlabelled = messy(spark, [(i, t, None, s) for i, t, _, s in rows])
    assert {(r.lang_pred, r.score) for r in L.identify(unlabelled).collect()} == {("und", 0.0)}
    assert Q.accepted(docs, none).count() == len(rows)
    for out in (Q.quality(empty(spark), none), T.toxicity(empty(spark), none), L.identify(empty(spark))):
        assert out.count() == 0


def test_ppm_code_lengths_against_a_plain_walk():
    rnd = random.Random(2)
    texts = {"x": [prose(rnd, 200) for _ in range(3)], "y": ["äö ü" * 30, prose(rnd, 50)]}
    grams, counts = [], []
    for lang in texts:
        g, n = np.unique(np.concatenate([L._grams(L.prepared(t)) for t in texts[lang]]), return_counts=True)
        grams.append(g)
        counts.append(n.astype(float))
    model = L.build(list(texts), np.repeat(np.arange(2), [len(g) for g in grams]), np.concatenate(grams), np.concatenate(counts))
    for k, lang in enumerate(texts):
        by = {}
        for g, n in zip(grams[k].tolist(), counts[k].tolist()):
            c = g.to_bytes(4, "big")
            for o in range(4):
                by.setdefault((o, c[3 - o:3]), {})
                by[(o, c[3 - o:3])][c[3]] = by[(o, c[3 - o:3])].get(c[3], 0) + n

        def bits(raw):
            raw, out = b"   " + raw, 0.0
            for i in range(3, len(raw)):
                p = 1.0
                for o in (3, 2, 1, 0, -1):
                    if o < 0:
                        p /= 256
                        break
                    ctx = raw[i - o:i]
                    seen = by.get((o, ctx), {})
                    if not seen:
                        continue
                    n, d = sum(seen.values()), len(seen)
                    if raw[i] in seen:
                        p *= seen[raw[i]] / (n + d)
                        break
                    p *= d / (n + d)
                out -= np.log2(p)
            return out

        for t in ("the stanter of", "äö und ß", "", "q" * 30, "zz9 €"):
            raw = L.prepared(t)
            assert abs(model.code_lengths([raw])[0, k] - bits(raw)) < 1e-3 * (1 + bits(raw))


def test_two_hundred_languages_keep_all_their_contexts():
    rnd = random.Random(5)
    letters = "abcdefghijklmnopqrstuvwxyzäöüñéβγдж"
    words = [["".join(rnd.choice(letters) for _ in range(rnd.randint(2, 7))) for _ in range(60)] for _ in range(200)]
    text = lambda k, n: L.prepared(" ".join(rnd.choice(words[k]) for _ in range(n)))
    parts = [np.unique(L._grams(text(k, 2000)), return_counts=True) for k in range(200)]
    lang = np.repeat(np.arange(200), [len(g) for g, _ in parts])
    model = L.build([f"l{k:03}" for k in range(200)], lang, np.concatenate([g for g, _ in parts]),
                    np.concatenate([n for _, n in parts]).astype(float))
    # each string seen in a language is listed under it, once
    assert len(model.bytes[3].value) == sum(len(g) for g, _ in parts)
    assert sum(x.value.nbytes + x.lang.nbytes + x.keys.nbytes + x.at.nbytes for x in model.bytes + model.escapes) < 50 << 20
    found = model.code_lengths([text(k, 30) for k in range(200)]).argmin(axis=1)
    assert (found == np.arange(200)).mean() > 0.99


def test_nearest_examples_against_all_cosines():
    rnd = np.random.default_rng(6)
    examples = np.maximum(rnd.normal(0, 1, (700, 40)) - 0.8, 0)
    examples = examples[examples.sum(axis=1) > 0]
    examples[5:30] = examples[5]  # ties
    examples /= np.linalg.norm(examples, axis=1, keepdims=True)
    n = len(examples)
    index = T.Index({}, np.ones(40), np.arange(n), np.zeros(n), np.ones(n), examples.copy())
    for q in range(60):
        v = np.maximum(rnd.normal(0, 1, 40) - 1, 0) if q % 3 else examples[q]
        at = np.flatnonzero(v)
        if not len(at):
            continue
        w = v[at] / np.linalg.norm(v[at])
        found, sims = index.nearest(at, w, 10)
        every = index.examples[:, at] @ w
        kth = np.sort(every)[-10]
        want = {int(i) for i in np.flatnonzero((every >= kth - 1e-9) & (every > 0))}
        assert set(found.tolist()) == want and np.allclose(sims, every[found])


def test_lists_beside_the_matrix_against_all_cosines(monkeypatch):
    rnd = np.random.default_rng(7)
    monkeypatch.setattr(T, "HEAD", 5)
    examples = np.maximum(rnd.normal(0, 1, (500, 60)) - 1.2, 0)
    examples = examples[examples.sum(axis=1) > 0]
    examples[9:30] = examples[9]  # ties
    examples /= np.linalg.norm(examples, axis=1, keepdims=True)
    n = len(examples)
    index = T.Index({}, np.ones(60), np.arange(n), np.zeros(n), np.ones(n), examples.copy())
    assert index.head.shape == (n, 5) and len(index.rows) == np.count_nonzero(examples) - np.count_nonzero(index.head)
    for q in range(60):
        v = np.maximum(rnd.normal(0, 1, 60) - 1.5, 0) if q % 3 else examples[q]
        at = np.flatnonzero(v)
        if not len(at):
            continue
        w = v[at] / np.linalg.norm(v[at])
        found, sims = index.nearest(at, w, 10, without=q)
        every = np.where(index.ids == q, 0, index.examples[:, at] @ w)
        kth = np.sort(every)[-10]
        want = {int(i) for i in np.flatnonzero((every >= kth - 1e-9) & (every > 0))}
        assert set(found.tolist()) == want and np.allclose(sims, every[found])


def counted_index(counts, idf):
    """An index as ``fit`` makes it: unit vectors of (1 + log count) * idf, lists in runs of equal counts."""
    w = np.where(counts > 0, 1 + np.log(np.maximum(counts, 1)), 0) * idf
    norm = np.sqrt((w * w).sum(axis=1))
    term, row = np.nonzero(counts.T)
    runs, level, length, row = T.in_runs(term.astype(np.int32), counts[row, term].astype(np.int32), row.astype(np.uint16), len(idf))
    n = len(counts)
    index = T.Index({}, idf, np.arange(n), np.zeros(n), np.ones(n), None, postings=(runs, (1 + np.log(level)).astype(np.float32), length, row),
                    scale=1 / norm)
    return index, w / norm[:, None]


@pytest.mark.parametrize("topics", [1, 4])
def test_lists_in_runs_of_equal_counts_against_all_cosines(monkeypatch, topics):
    rnd = np.random.default_rng(8)
    monkeypatch.setattr(T, "HEAD", 6)
    monkeypatch.setattr(T, "BLOCK", 50)
    monkeypatch.setattr(T, "QUERIES", 7)
    n, terms = 400, 240
    counts = rnd.poisson(0.3, (n, terms))
    counts[np.arange(n)[:, None] * topics // n != np.arange(terms)[None] * topics // terms] = 0  # a topic's words are in its blocks only
    counts[np.arange(n), np.arange(n) * topics // n * (terms // topics)] += 1
    counts[20:45] = counts[20]  # ties
    index, every_weight = counted_index(counts, rnd.uniform(0.1, 3, terms))
    assert len(index.rows) == np.count_nonzero(counts) - np.count_nonzero(index.head)
    held = sum(x.nbytes for k, x in vars(index).items() if isinstance(x, np.ndarray) and k in ("pairs", "cells", "chunks", "level_of", "levels"))
    assert topics > 1 or held < 4 * len(index.rows)  # a posting is its example, not also its weight
    queries = [(np.flatnonzero(x), x[x > 0]) for x in every_weight[::5]] + [(np.zeros(0, np.int64), np.zeros(0))]
    pruned = []
    plain = T.Index._wanted
    monkeypatch.setattr(T.Index, "_wanted", lambda *a: pruned.append(plain(*a)) or pruned[-1])
    for without in (None, [*range(0, n, 5), -1]):
        got = list(index.nearest_each(queries, 10, without))
        assert len(got) == len(queries) and not len(got[-1][0])
        for q, ((at, w), (found, sims)) in enumerate(zip(queries[:-1], got)):
            every = every_weight[:, at] @ w
            if without:
                every[without[q]] = 0
            kth = np.sort(every)[-10]
            want = set(np.flatnonzero((every >= kth - 1e-9) & (every > 0)).tolist())
            near = {int(i) for i in found}
            # levels are of single precision: what is off the last place by less may change sides
            assert all(abs(every[i] - kth) < 1e-6 for i in near ^ want) and np.allclose(sims, every[found], atol=1e-6)
    assert topics == 1 or not all(x.all() for x in pruned)  # blocks of other topics were left out


def test_terms_of_pieces_are_those_of_the_words():
    texts = ["ὈΔΥΣΣΕΎΣ, Σ. ΑΣ-ΒΣ", "a\x85b\x1cc\u00a0d\u200be", "x1y2z 'tis (don't) naïve-café", "中文" * 100 + "。" + "字" * 70, "",
             None, "q" * 200, "İstanbul ß ﬁ", "- 12 _ !!"]
    words = sorted(set().union(*map(T.words_of, texts)))
    terms = T.numbered("\n".join(sorted({t for w in words for t in T.terms_of(w)})))
    index = T.Index(terms, np.ones(len(terms)), np.arange(0), np.zeros(0), np.ones(0), np.zeros((0, len(terms))))
    known = T.Vocabulary(terms)
    size = len(known.words), len(known.stems)
    unseen = ["naïver odyssee caféteria", "^naïv ^caf naïv naï caf café", "wholly unknown words", "ὈΔΥΣΣΕΎΣ" * 3]
    for text, (at, counts) in zip(texts + unseen, index.counts(texts + unseen, known), strict=True):
        want = {}
        for w in T.words_of(text):
            for t in T.terms_of(w):
                if t in terms:
                    want[terms[t]] = want.get(terms[t], 0) + 1
        assert dict(zip(at.tolist(), counts.tolist())) == want
    assert size == (len(known.words), len(known.stems))  # nothing is remembered that grows with the table


def test_a_copy_of_a_toxic_text_of_rare_words_finds_it(spark, corpus):
    rows, marks = corpus
    rare = "quondam vexillo brumal ixtle sphragid"
    own = next(i for i in range(1000, 1100) if not HELD(i))
    docs = messy(spark, rows + [(own, rare, "en", "a"), (2000, rare, "en", "a"), (2001, "tmesis gharial ouphe", "en", "a")])
    out = {r.doc_id: r for r in T.toxicity(docs, labels(spark, marks + [(own, 1, 1)])).where("doc_id >= 1000").collect()}
    first = out[2000].evidence[0]
    assert first.id == own and first.label == 1 and abs(first.cosine - 1) < 1e-6
    assert out[2001].evidence == []


def test_isotonic():
    x, y = Q.isotonic(np.array([0.0, 1, 2, 3]), np.array([10.0, 10, 10, 10]), np.array([1.0, 5, 3, 9]))
    assert (np.diff(y) > 0).all() and len(x) == 3


def test_features_approximate_the_kernel():
    rnd = np.random.default_rng(0)
    m = Q.Model(np.zeros(Q.N_STATS), np.ones(Q.N_STATS), rnd.normal(0, 1 / 3.0, (Q.N_STATS, 20000)), rnd.uniform(0, 2 * np.pi, 20000),
                np.zeros(1), np.zeros(1), np.zeros(1))
    a, b = rnd.normal(0, 1, (2, Q.N_STATS))
    fa, fb = m.features(a[None])[0, :-1], m.features(b[None])[0, :-1]
    assert abs(fa @ fb - np.exp(-((a - b) ** 2).sum() / 18)) < 0.05
