"""Conversation repair, whitening and MinHash near-dedup against brute force."""

import hashlib
import itertools
import zlib
from collections import defaultdict
from decimal import Decimal
from fractions import Fraction

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from attrition.llm import conversations as cv
from attrition.llm import minhash as mh
from attrition.llm import whitening as wh
from attrition.llm.components import components
from attrition.llm.shingles import shingle_sets

SF = "/root/testdata/sf0.001"
CLASH = ["set", "n", "sig", "keys", "key", "part", "parts", "label", "side", "copy", "uid", "digest", "gid", "at", "chunk",
         "code", "codes", "c", "r", "d", "audit", "lead", "x", "v", "i", "count", "component", "own", "__maybe"]

# ------------------------------------------------------------- conversations

ROLES = {"s": 1, "u": 2, "a": 3}


def best(rows):
    """Least (cost, audit, lines) of rows (role, text, fault), by trying all edits backward."""
    follow = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}
    named = {2: "user", 3: "assistant"}

    def closed(table):
        for _ in range(3):
            for q in range(4):
                to = 3 if q == 2 else 2
                cost, audit, lines = table.get(to, (10 ** 9, "", ()))
                table[q] = min(table.get(q, (10 ** 9, "", ())), (cost + 3, "I" + audit, (f"{named[to]}:",) + lines))
        return table

    table = closed({0: (0, "", ()), 3: (0, "", ())})
    for role, text, fault in reversed(rows):
        now = {}
        for q in range(4):
            options = [(table[q][0] + 4, "D" + table[q][1], table[q][2])]
            if fault not in ("blank", "duplicate"):
                more = 3 if fault == "truncated" else 0
                if role[:1] in follow[q]:
                    c, a, t = table[follow[q][role[:1]]]
                    options.append((c + more, "K" + a, (f"{role}:{text}",) + t))
                to = 3 if q == 2 else 2
                c, a, t = table[to]
                options.append((c + 3 + more, "R" + a, (f"{named[to]}:{text}",) + t))
            now[q] = min(options)
        table = closed(now)
    return table[0]


def expected(rows):
    """{conv_id: contract's columns} of rows (conv_id, turn, role, text)."""
    out = {}
    groups = defaultdict(list)
    for conv, turn, role, text in rows:
        groups[conv]
        hit = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if hit == 0:
            continue
        text = "" if hit == 1 else "".join(c for c in text if c not in ".!?") if hit == 2 else text
        groups[conv] += [(turn, "user" if hit == 4 else role, text)] * (2 if hit == 3 else 1)
    for conv, own in groups.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).digest()))
        seen, faults = set(), []
        for _, role, text in own:
            core = text.strip(" \t\n\x0b\x0c\r")
            faults.append("blank" if not core else "duplicate" if (role, text) in seen
                          else "truncated" if core[-1] not in ".!?" else "")
            seen.add((role, text))
        turns = [t for t, _, _ in own if t is not None]
        pairs = [a[1][:1] + b[1][:1] for a, b in itertools.pairwise(own)]
        cost, audit, lines = best([(r, t, f) for (_, r, t), f in zip(own, faults)])
        out[conv] = (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0,
                     *(faults.count(k) for k in ("blank", "duplicate", "truncated")),
                     sum(p not in ("su", "ua", "au") for p in pairs), cost, audit,
                     hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def found(df):
    return {r["conv_id"]: tuple(r[c] for c in (
        "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")) for r in df.collect()}


def messy(n, seed=1):
    rng = np.random.default_rng(seed)
    roles = np.array(["user", "assistant", "system", "tool", None, "", "Sys", "u"], object)
    texts = ["Fine.", "cut off", " \n", "", None, "Why? \t", "Ünïcode!", "no end ", "x" * 5000 + "."]
    rows = []
    for conv in [*range(n), None]:
        for k in range(rng.integers(1, 14)):
            turn = None if rng.random() < .1 else int(rng.integers(0, 12))
            rows.append((conv, turn, roles[rng.choice(8, p=[.3, .3, .1, .1, .05, .05, .05, .05])],
                         texts[rng.integers(len(texts))]))
    return rows + rows[:3]


SCHEMA = "conv_id long, turn long, role string, text string"


@pytest.mark.parametrize("chunk", [1, 3, 128])
def test_repair_of_messy_rows(spark, chunk):
    rows = messy(60)
    df = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("x") for c in CLASH}).repartition(4)
    assert found(cv.repair_report(df, chunk)) == expected(rows)


def test_repair_where_vectors_never_meet(spark):
    """No role is known, so vectors keep their difference through all rows, and one
    conversation holds most of them: spans must grow."""
    rows = [(7, k, "tool", f"{k}.") for k in range(301)] + [(8, 0, "user", "Hi.")]
    assert found(cv.repair_report(spark.createDataFrame(rows, SCHEMA).repartition(5), 2)) == expected(rows)


def test_repaired_rows(spark):
    rows = [(1, 0, "assistant", "A."), (1, 1, "user", "B."), (1, 2, "user", "C"), (2, 0, "system", "S.")]
    got = cv.Repair(spark.createDataFrame(rows, SCHEMA)).rows().orderBy("conv_id", "place").collect()
    assert [(r["edit"], r["role"], r["text"]) for r in got if r["conv_id"] == 1] == list(_texts(
        [("assistant", "A.", ""), ("user", "B.", ""), ("user", "C", "truncated")]))
    assert not [r for r in got if r["conv_id"] == 2]        # nothing to answer: deleted


def _texts(rows):
    cost, audit, lines = best(rows)
    kept = [e for e in audit if e != "D"]
    return [(e, *line.split(":", 1)) for e, line in zip(kept, lines)]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "x"]),
                          st.sampled_from(["", "blank", "truncated"])), max_size=9))
def test_least_audit(rows):
    codes = [ROLES.get(r[:1], 0) + {"blank": cv.FORCED, "truncated": cv.TRUNCATED}.get(f, 0) for r, f in rows]
    lead, constant = cv.backward(codes, cv.END)
    _, audits = cv.traced(codes, cv.END, True)
    cost, audit, _ = best([(r, "t", f) for r, f in rows])
    assert (constant + lead[cv.START], audits[cv.START]) == (cost, audit)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 11), max_size=12), st.tuples(*[st.integers(0, 6)] * 4), st.tuples(*[st.integers(0, 6)] * 4))
def test_fix_up_equals_a_new_run(codes, old, new):
    lead, constant = cv.backward(codes, old)
    fixed, change = cv.fixed_up(codes, old, new)
    assert (fixed or lead, constant + change) == cv.backward(codes, new)


def test_repair_sql_twin_and_empty_table(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{SF}/conversations.parquet'")
    rel = con.sql(cv.SQL)
    twin = {r[0]: dict(zip(rel.columns, r)) for r in rel.fetchall()}
    got = {r["conv_id"]: r.asDict() for r in cv.op11_conversations(spark, SF).collect()}
    assert got == twin
    assert cv.repair_report(spark.createDataFrame([], SCHEMA)).count() == 0


# ------------------------------------------------------------- whitening

def test_whitening_against_fractions(spark):
    """Covariances by definition in exact fractions; entries far from zero, ties,
    nulls, other lengths and extra columns."""
    rng = np.random.default_rng(3)
    vecs = (rng.normal(size=(80, 5)) @ rng.normal(size=(5, 5)) + np.array([1e5, -3e4, 0, 5, 1])).tolist()
    vecs += vecs[:7]
    rows = [(i if i % 9 else None, v) for i, v in enumerate(vecs)]
    bad = [(1000, None), (1001, [1.0, None, 2.0, 3.0, 4.0]), (1002, [float("nan")] * 5), (1003, [float("inf")] * 5),
           (1004, [1.0, 2.0]), (1005, [])]
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<double>").withColumns(
        {c: F.lit("x") for c in CLASH}).repartition(3)
    got = wh.whiten(df).collect()
    assert len(got) == 5 * len(vecs) and {r["n"] for r in got} == {len(vecs)}
    x = [[Fraction(int(np.floor(64 * c)) + 1_000_000) for c in v] for v in vecs]
    n, mean = len(x), [sum(c) / Fraction(len(x)) for c in zip(*x)]
    z = [[a - m for a, m in zip(r, mean)] for r in x]
    cov = np.array([[float(sum(r[i] * r[j] for r in z) / n) for j in range(5)] for i in range(5)])
    values, vectors = np.linalg.eigh(cov)
    values, vectors = values[::-1], vectors[:, ::-1]
    w = np.array([[float(a) for a in r] for r in z]) @ vectors / np.sqrt(values)
    table = wh.whitened(wh.integers(df, "vec_id", "embedding"), wh.fit(wh.integers(df, "vec_id", "embedding"))).collect()
    mine = sorted((tuple(np.abs(r["whitened"]).round(6)), int(r["deviation"])) for r in table)
    dev = [int(sum((n * a) ** 2 for a in r)) for r in z]
    assert mine == sorted((tuple(np.abs(r).round(6) + 0.0), d) for r, d in zip(w, dev))
    for r in got:
        k = r["component"] - 1
        assert abs(r["explained"] - values[k] / values.sum()) <= 1e-9 * values[k] / values.sum()
        assert r["identity_error"] < 1e-6


def test_whitening_without_variance_and_empty(spark):
    schema = "vec_id long, embedding array<float>"
    got = wh.whiten(spark.createDataFrame([(1, [1.0, 2.0, 7.0]), (2, [1.0, 3.0, 7.0]), (3, [1.0, 4.0, 7.0])], schema)).collect()
    assert {(r["component"], r["whitened"] is None) for r in got} == {(1, False), (2, True), (3, True)}
    assert {r["explained"] for r in got if r["component"] > 1} == {0.0} and {r["identity_error"] for r in got} != {None}
    same = wh.whiten(spark.createDataFrame([(1, [1.0, 2.0])] * 4, schema)).collect()
    assert all(r["whitened"] is None and r["deviation"] == 0 for r in same)
    assert wh.whiten(spark.createDataFrame([], schema)).count() == 0
    assert wh.whiten(spark.createDataFrame([(1, None), (2, [])], schema)).count() == 0


def test_squares_stay_exact_beyond_64_bits():
    y = np.array([[3 * 2 ** 31, -5], [2 ** 32 + 1, 7]], np.int64)
    want = [sum(int(a) ** 2 for a in y[:, 0]), sum((int(a) + int(b)) ** 2 for a, b in y), 74]
    assert list(wh._squares(y)) == want
    f = wh.Fit(10 ** 9, (0, 0), np.eye(2), np.ones(2), 2.0)
    assert wh._deviations(y, f).to_pylist() == [Decimal(sum((10 ** 9 * int(a)) ** 2 for a in r)) for r in y]


# ------------------------------------------------------------- MinHash

def classes_of(texts, words=mh.WORDS, percent=mh.PERCENT):
    """{id: (set size, smallest id reachable)} of distinct ids."""
    sets = {i: {tuple(w[k:k + words]) for k in range(max(1, len(w) - words + 1))} if w else set()
            for i, t in texts.items()
            for w in ["".join(c.lower() if "A" <= c <= "Z" else c for c in t or "").split()]}
    up = {i: i for i in sets}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    ids = sorted(sets)
    for i, j in itertools.combinations(ids, 2):
        a, b = sets[i], sets[j]
        if a and b and root(i) != root(j) and 100 * len(a & b) >= percent * len(a | b):
            x, y = root(i), root(j)
            up[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), root(i)) for i in ids}


def family_texts(n_bases=12, copies=14, seed=5):
    """Texts that share a long passage, and copies of each at all distances."""
    rng = np.random.default_rng(seed)
    word = lambda: f"w{rng.integers(5000)}"
    passage = [word() for _ in range(30)]
    texts, i = {}, 0
    for _ in range(n_bases):
        base = [word() for _ in range(60)] + passage + [word() for _ in range(20)]
        for c in range(copies):
            own = list(base)
            for k in rng.choice(len(own), c // 2, replace=False):
                own[k] = word()
            texts[i] = " ".join(own)
            i += 1
    return texts


def got_classes(df):
    return {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in df.collect()}


@pytest.mark.parametrize("part", [1_024, 5])
def test_minhash_against_brute_force(spark, monkeypatch, part):
    """With parts of five members every group is cut, and links across parts count."""
    monkeypatch.setattr(mh, "PART", part)
    texts = family_texts()
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(4)
    out = mh.near_duplicates(df)
    assert got_classes(out) == classes_of(texts)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in out.collect())


def test_minhash_sql_twin(spark, small):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    twin = {r[0]: r[1:] for r in con.sql(mh.SQL).fetchall()}
    got = {r["doc_id"]: tuple(r)[1:] for r in mh.op13_minhash(spark, SF).collect()}
    assert got == twin and len(got) == len(small)


def test_minhash_edges(spark, edge_docs, no_docs):
    rows = mh.near_duplicates(edge_docs).collect()
    assert len(rows) == edge_docs.count()
    by = defaultdict(list)
    for r in rows:
        by[r["doc_id"]].append((r["n_shingles"], r["component_id"], r["kept"]))
    assert by[1] == [(0, 1, True)] and by[2] == [(0, 2, True)] and by[3] == [(0, 3, True)]
    assert by[5] == [(3, 5, True)] and by[7] == [(3, 5, False)] and by[6] == [(3, 5, False)] * 2
    assert sorted(by[None]) == [(0, None, True), (1, None, True)]
    assert mh.near_duplicates(no_docs).count() == 0


def test_posterior_bound():
    """The bound is the least m whose Beta(m + 1, n - m + 1) tail reaches MISS."""
    rng = np.random.default_rng(0)
    for n, m in ((32, 20), (64, 45), (128, 90)):
        tail = float((rng.beta(m + 1, n - m + 1, 400_000) >= 0.8).mean())
        assert (m >= mh.least_equal(n, 80, tail * 1.2)) is False or tail < 1e-4
        assert m >= mh.least_equal(n, 80, tail * 0.8)
    left = rng.integers(0, 1 << 16, (3, mh.SIGNATURE)).astype(np.uint16)
    right = left.copy()
    right[1, ::2] += 1        # half the minima differ
    right[2] += 1
    assert mh.survivors(left, right, 80, mh.MISS).tolist() == [0]


def test_signatures_estimate_similarity():
    texts = [" ".join(f"a{i}" for i in range(400)), " ".join(f"a{i}" for i in range(50, 450))]
    a, b = shingle_sets(texts, 4)
    least = mh.minima([a, b])
    true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
    assert abs((least[0] == least[1]).mean() - true) < 0.12


# ------------------------------------------------------------- components

@pytest.mark.parametrize("portion", [3, 1 << 17])
def test_components_within_and_across_portions(spark, portion):
    rng = np.random.default_rng(2)
    links = [(int(a), int(b)) for a, b in rng.integers(0, 150, (110, 2))] + [(k, k + 1) for k in range(500, 540)]
    links += [(1000, k) for k in range(1001, 1100)] + [(7, 7)]
    up = {x: x for e in links for x in e}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        x, y = root(a), root(b)
        up[max(x, y)] = min(x, y)
    want = {x: root(x) for e in links if e[0] != e[1] for x in e}
    df = spark.createDataFrame(links, "a long, b long").repartition(5)
    rows = components(df, portion).collect()
    assert {r["node"]: r["component"] for r in rows} == want and len(rows) == len(want)
    assert components(df.where("false")).count() == 0
