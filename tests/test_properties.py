"""Property-based checks (hypothesis) of the helpers against plain-Python models."""

import fnmatch
import re

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from rivulet.functions.coerce import glob_to_regex, intval, natural_key
from rivulet.operators.ordering import with_row_index

SLOW = settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab/.*?-", min_size=1, max_size=6), st.text(alphabet="ab/.-", max_size=8))
def test_glob_matches_fnmatch(pattern, name):
    assert bool(re.match(glob_to_regex(pattern), name, re.S)) == fnmatch.fnmatchcase(name, pattern)


@SLOW
@given(st.lists(st.integers(min_value=0, max_value=10**12), min_size=1, max_size=40, unique=True))
def test_natural_order_of_numbered_names(spark, nums):
    df = spark.createDataFrame([(f"Img{n}", n) for n in nums], "s string, n bigint")
    got = [r["n"] for r in df.orderBy(natural_key("s")).collect()]
    assert got == sorted(nums)


def _intval_model(s):
    m = re.match(r"^[+-]?\d+", s.strip())
    if not m:
        return 0
    v = int(m.group(0))
    return v if -(2**63) <= v < 2**63 else None


@SLOW
@given(st.lists(st.text(alphabet=" +-0123456789ax.", max_size=8), min_size=1, max_size=30))
def test_intval_model(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i bigint, t string")
    got = [r[0] for r in df.orderBy("i").select(intval("t")).collect()]
    want = [_intval_model(t) for t in texts]
    assert [g for g, w in zip(got, want) if w is not None] == [w for w in want if w is not None]


@SLOW
@given(st.lists(st.integers(min_value=-50, max_value=50), min_size=0, max_size=200), st.integers(1, 9))
def test_row_index_is_a_dense_global_order(spark, values, parts):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "id bigint, v bigint").repartition(parts)
    out = with_row_index(df, ["v", "id"], num_partitions=parts).collect()
    ranked = sorted(out, key=lambda r: r["row_index"])
    assert [r["row_index"] for r in ranked] == list(range(1, len(values) + 1))
    assert [(r["v"], r["id"]) for r in ranked] == sorted((v, i) for i, v in enumerate(values))


def _nat_key(s):
    out = []
    for part in re.findall(r"\d+|\D+", s):
        if part[0].isdigit():
            d = part.lstrip("0") or "0"
            out.append(f"{len(d):03d}{d}")
        else:
            out.append(part)
    return out


def _list_model(paths, returnvalue, sort, offset, limit, base, pattern):
    keep = [p for p in paths if p.rsplit("/", 1)[-1] not in (".", "..")
            and (not pattern or fnmatch.fnmatchcase(p, pattern))]
    if returnvalue == "basename":
        pairs = [(p.rstrip("/").rsplit("/", 1)[-1], p) for p in keep]
    elif returnvalue == "relativepath" and base:
        pairs = [(p.replace(base + "/", ""), p) for p in keep]
    else:
        pairs = [(p, p) for p in keep]
    if sort == "alpha":
        pairs.sort()
    elif sort == "alpha_reverse":
        pairs.sort(reverse=True)
    else:
        pairs.sort(key=lambda vp: (_nat_key(vp[0]), vp[1]))
    pairs = pairs[offset:offset + limit] if limit else pairs[offset:]
    return [v for v, _ in pairs]


PATH = st.lists(st.sampled_from(["a", "b", "out", "x1", "x10", "x2", "doc.csv", "r9.txt", "."]), min_size=1, max_size=3)


@SLOW
@given(st.lists(PATH.map("/".join), min_size=1, max_size=25, unique=True),
       st.sampled_from(["basename", "relativepath", "absolutepath"]),
       st.sampled_from(["alpha", "alpha_reverse", "natural"]), st.integers(0, 4), st.integers(0, 5),
       st.sampled_from(["", "out"]), st.sampled_from([None, "*", "*.csv", "out/*", "x?"]))
def test_list_constraints_model(spark, paths, rv, sort, offset, limit, base, pattern):
    from rivulet.sources.files import list_constraints
    df = spark.createDataFrame([(p,) for p in paths], "path string")
    out = list_constraints(df, "path", rv, sort, offset, limit, False, base, pattern)
    got = [r["value"] for r in out.orderBy("position").collect()]
    assert got == _list_model(paths, rv, sort, offset, limit, base, pattern)


@SLOW
@given(st.lists(st.tuples(st.integers(0, 5), st.integers(0, 100)), min_size=1, max_size=60))
def test_take_until_and_find_first_brute_force(spark, data):
    from rivulet.operators.control import find_first, take_until
    df = spark.createDataFrame([(i, g, v) for i, (g, v) in enumerate(data)], "k bigint, g bigint, v bigint")
    stop = next((i for i, (_, v) in enumerate(data) if v > 80), len(data))
    assert sorted(r["k"] for r in take_until(df, "v > 80", "k").collect()) == list(range(stop))
    want = {}
    for i, (g, v) in enumerate(data):
        if v % 2 == 0 and g not in want:
            want[g] = i
    got = {r["g"]: r["found"]["k"] for r in find_first(df, "v % 2 = 0", "k", "g").collect()}
    assert got == want


@SLOW
@given(st.lists(st.integers(-20, 20), min_size=1, max_size=40), st.integers(-10, 10), st.integers(-10, 10))
def test_switch_merge_matches_union_of_branches(spark, values, t1, t2):
    from rivulet.operators.routing import merge, switch, switch_merge
    from rivulet.operators.transform import alter
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i bigint, v bigint")
    cases = {"hi": f"v > {t1}", "lo": f"v < {t2}"}
    exprs = {"hi": {"v": "${{ v * 10 }}", "tag": "H"}, "lo": {"extra": "${{ v - 1 }}"}}
    one = sorted(map(tuple, switch_merge(df, cases, exprs).select("i", "v", "branch", "tag", "extra").collect()))
    b = switch(df, cases, keep_label=True)
    two = sorted(map(tuple, merge(alter(b["hi"], exprs["hi"]), alter(b["lo"], exprs["lo"]))
                     .select("i", "v", "branch", "tag", "extra").collect()))
    assert one == two
