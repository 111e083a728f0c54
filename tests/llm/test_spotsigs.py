import hashlib
import random
import re

from pyspark.sql import functions as F

from rivulet.llm import spotsigs as S
from tests.llm.helpers import empty, messy, messy_rows, prose, with_null_ids


def brute_chains(text):
    """Pairs of content words after each common word or closing mark."""
    words, spot = [], True
    for m in re.finditer(r"(?P<w>[^\W_]+)|(?P<m>[.!?;:|\n\u2026\u203C\u2047-\u2049\u3002\uFF01\uFF0E\uFF1A\uFF1B\uFF1F\uFF5C\uFF61\u061B\u061F\u06D4\u0589"
                         r"\u0964\u0965\u1362\u2028\u2029])", "\n" + text.lower()):
        if m["w"] and m["w"] not in S.COMMON:
            words.append((m["w"], spot))
            spot = False
        else:
            spot = True
    return {" ".join(w for w, _ in words[k:k + S.CHAIN]) for k, (_, s) in enumerate(words) if s}


def test_signatures_against_a_plain_walk(spark):
    texts = [t or "" for _, t, *_ in messy_rows()] + ["The cat of the hat. A dog, und so | x", "the of", "Der. Die! das", "x"]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k bigint, t string")
    chains = df.select("k", F.transform(S.spots(F.col("t")), lambda s: F.regexp_replace(s, f"[^{S._L}]+", " ")).alias("c"))
    for r in chains.collect():
        assert set(r.c) == brute_chains(texts[r.k]), texts[r.k][:80]


def test_quotes_spaces_and_scripts_beyond_ascii(spark):
    cjk = "今天天气很好，我们去公园。他说：你好！明天见？好的；再见。春天来了，花开了。山上有雪，河里有鱼。猫在睡觉，狗在跑。"
    texts = ["in \u201cthe wall\u201d of \u2018stone\u2019 wall", "the\u00a0cat\u00a0of the\u2014hat\u2026 a\u3000dog", cjk, cjk.replace("。", "｡"),
             "«la pierre» – du mur", "the cat\u2009sat", "price \u20ac the stone\u00d7wall"]

    def walk(text):
        words, spot = [], True
        for m in re.finditer(r"(?P<w>[^\W_]+)|(?P<m>[.!?;:|\n…。｡！？；：])", "\n" + text.lower()):
            if m["w"] and m["w"] not in S.COMMON:
                words.append((m["w"], spot))
                spot = False
            else:
                spot = True
        return {" ".join(w for w, _ in words[k:k + S.CHAIN]) for k, (_, s) in enumerate(words) if s}

    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k bigint, t string")
    chains = df.select("k", F.transform(S.spots(F.col("t")), lambda s: F.regexp_replace(s, f"[^{S._L}]+", " ")).alias("c"))
    for r in chains.collect():
        assert set(r.c) == walk(texts[r.k]), texts[r.k]
    one = spark.createDataFrame([(1, cjk), (2, "x")], "doc_id bigint, text string")
    near = {r.doc_id: r.near_edited for r in S.edit_report(one).collect()}
    assert len(walk(cjk)) > 5 and 0.4 < near[1] <= 1


def test_report_against_brute_force(spark):
    rows = with_null_ids(messy_rows())
    got = {}
    for r in S.edit_report(messy(spark, rows)).collect():
        got.setdefault(r.doc_id, []).append(r)
    order = sorted(((i if i is not None else -1, t or "") for i, t, *_ in rows))
    prints = {}
    for k, (i, t) in enumerate(order):
        nxt = order[(k + 1) % len(order)][1]
        q = len(t) // 4
        edited = t[:len(t) - q] + nxt[:q]
        sha = hashlib.sha256(edited.encode()).hexdigest()
        match = [r for r in got[i if i >= 0 else None] if r.edited_sha256 == sha and r.n_chars == len(t)]
        assert match, i
        r = match[0]
        a, e, n = brute_chains(t), brute_chains(edited), brute_chains(nxt)
        if a and e and n:
            assert abs(r.near_edited - len(a & e) / len(a | e)) < 1e-9 and abs(r.near_next - len(a & n) / len(a | n)) < 1e-9
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        assert prints.setdefault(t, r.fingerprint) == r.fingerprint
        if t == edited:
            assert r.near_edited == 1 and r.edited_fingerprint == r.fingerprint


def test_pairs_against_all_pairs(spark):
    rnd = random.Random(8)
    rows, base = [], [prose(rnd, 120) for _ in range(15)]
    for i in range(60):
        t = rnd.choice(base).split()
        for _ in range(rnd.randint(0, 8)):
            t[rnd.randrange(len(t))] = f"new{rnd.randint(0, 9)}"
        rows.append((i, " ".join(t), "en", "a"))
    rows = with_null_ids(rows + [(60, rows[3][1], "en", "a"), (61, None, "en", "a"), (62, "", "en", "a"), (63, "the of", "en", "a")])
    members, pairs = S.near_pairs(messy(spark, rows))
    rep = {r.doc_id: r.rep for r in members.collect() if r.doc_id is not None}
    assert members.count() == len(rows)
    got = {(r.a, r.b): r.likeness for r in pairs.collect()}
    sigs = {r.doc_id: set(r.signatures) for r in S.fingerprints(messy(spark, rows)).collect() if r.doc_id is not None}
    want = {}
    for i in sigs:
        assert rep[i] == min(j for j in sigs if sigs[j] == sigs[i])
        for j in sigs:
            if rep[i] == i < j == rep[j] and sigs[i] and sigs[j]:
                x = len(sigs[i] & sigs[j]) / len(sigs[i] | sigs[j])
                if x >= 0.8:
                    want[(i, j)] = x
    assert want and {k: round(v, 9) for k, v in got.items()} == {k: round(v, 9) for k, v in want.items()}


def test_no_python_in_the_plan(spark):
    plan = S.edit_report(messy(spark))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "SinglePartition" not in plan


def test_empty_and_single(spark):
    assert S.edit_report(empty(spark)).count() == 0
    one = spark.createDataFrame([(4, "the stone of the wall")], "doc_id bigint, text string")
    assert S.edit_report(one).first().near_next == 1.0
