"""Exact dedup, quality rules, personal data, sharding."""
import hashlib
import math
import random
import re
import zlib
from collections import Counter

from pyspark.sql import functions as F

from attrition.llm import exact_dedup, pii, quality_rules, shard
from attrition.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


# exact dedup

def test_dedup_edges(edge_docs, no_docs):
    rows = exact_dedup.duplicate_groups(edge_docs).collect()
    assert len(rows) == edge_docs.count()
    by = {(r.doc_id, r.text_sha256): r for r in rows}
    empty = hashlib.sha256(b"").hexdigest()
    assert by[2, empty].keep_id == 2 and by[2, empty].group_size == 3 and not by[1, empty].kept
    same = hashlib.sha256(b"same text of some words here").hexdigest()
    assert [by[i, same].kept for i in (5, 6, 7)] == [False, False, True] and by[5, same].group_size == 4
    assert hashlib.sha256("É é same".encode()).hexdigest() in {r.text_sha256 for r in rows}  # A-Z only
    assert not exact_dedup.duplicate_groups(no_docs).count()


def test_dedup_rows_stay_whole(edge_docs, no_docs):
    kept = exact_dedup.drop_duplicates(edge_docs)
    assert kept.columns == edge_docs.columns
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id) == [2, 3, 4, 7, 8, 9, 10]
    assert not exact_dedup.drop_duplicates(no_docs).count()


def test_dedup_of_rows_that_repeat_the_largest_id(spark):
    docs = spark.createDataFrame([(1, "x"), (2, "X"), (2, "X"), (2, "x")], "doc_id long, text string")
    groups = exact_dedup.duplicate_groups(docs).collect()
    assert sorted((r.doc_id, r.kept) for r in groups) == [(1, False), (2, True), (2, True), (2, True)]
    assert exact_dedup.drop_duplicates(docs).count() == 1


def test_dedup_compares_content_when_digests_clash(spark):
    docs = spark.createDataFrame([(i, f"t{i % 5}") for i in range(40)], "doc_id long, text string")
    rows = exact_dedup.duplicate_groups(docs, digest=lambda t: F.lit(b"\1")).collect()
    assert {(r.doc_id, r.keep_id, r.group_size) for r in rows} == {(i, 35 + i % 5, 8) for i in range(40)}


# quality rules

def brute_statistics(t):
    w = WORD.findall(t or "")
    seen = Counter(zip(w, w[1:], w[2:]))
    inside = {i + k for i in range(len(w) - 2) if seen[w[i], w[i + 1], w[i + 2]] > 1 for k in range(3)}
    lines = [x for x in (t or "").split("\n") if WORD.search(x)]
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t or ""), len(lines) - len(set(lines)), len(inside))


def test_statistics_against_brute_force(spark, small):
    texts = list(small.values()) + ["a a a", "a a a a", "x y z x y z", "l\nl\n \nl", "# é|é\n", "\x0b\x1f a b"]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select(
        "i", quality_rules.statistics(F.col("t")).alias("s")).collect()
    assert [tuple(r.s) for r in sorted(rows)] == [brute_statistics(t) for t in texts]


def test_rules_learn_thresholds_and_spare_good_rows():
    rows = [({"a": i % 10 / 10, "b": i % 7}, i % 10 >= 8 and i % 7 >= 3) for i in range(700)]
    rules = quality_rules.learn(rows)
    assert rules and all(any(r.hits(x) for r in rules) == bad for x, bad in rows)
    assert quality_rules.learn([]) == [] and quality_rules.learn([({"a": 1.0}, False)] * 9) == []
    noise = [({"a": i % 10 / 10}, i % 3 == 0) for i in range(300)]
    assert quality_rules.learn(noise) == []


def test_quality_edges(edge_docs, no_docs, spark):
    labels = spark.createDataFrame([(4, 1, 0), (4, 0, 0), (None, 0, 1), (9, None, None)],
                                   "doc_id long, quality int, toxic int")
    rules = quality_rules.learn_rules(edge_docs, labels)
    assert rules == [] and quality_rules.learn_rules(no_docs, labels.where("false")) == []
    rows = quality_rules.judge(edge_docs, rules).collect()
    assert len(rows) == edge_docs.count() and {r.doc_id for r in rows if r.kept} == {4}
    texts = {r.doc_id: r.text for r in edge_docs.collect()}
    for r in rows:
        if r.doc_id:
            assert tuple(r)[1:6] == brute_statistics(texts[r.doc_id])
    assert quality_rules.keep_good(edge_docs, rules).columns == edge_docs.columns
    assert not quality_rules.judge(no_docs, rules).count()


def test_quality_query(spark):
    rows = QUERIES["op4_quality_rules"](spark, SF).collect()
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    good = [r.kept for r in rows if labels.get(r.doc_id) == 1 and not r.base_failed]
    assert all(good) and len(rows) == 200
    assert all(r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words) for r in rows)


# personal data

BASE = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
        ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")]


def brute_spans(t):
    out = []
    for k, (kind, pattern) in enumerate(BASE):
        for m in re.finditer(pattern, t or ""):
            d = re.sub("[^0-9]", "", m.group())
            twice = [int(c) if i % 2 == 0 else int(c) * 2 - 9 * (int(c) > 4) for i, c in enumerate(reversed(d))]
            if (kind == "ip" and any(int(p) > 255 for p in m.group().split(".")) or kind == "phone"
                    and not 9 <= len(d) <= 15 or kind == "card" and not (12 <= len(d) <= 19 and sum(twice) % 10 == 0)):
                continue
            out.append((m.start(), k, m.end()))
    return sorted(out)


HARD = ["a@b.c_d@e.f", "x@y", "@a.b", "..a@b-c.d..e", "1.2.3.4.5.6.7.8", "0001.02.255.256 10.0.0.255x",
        "4111 1111 1111 1111", "4111-1111  1111 1111", "4111111111111111 9", "+1 (375) 555-4393.", "+12 ) 3",
        "é 4111111111111111 a@b.co +49 30 1234567", "1" * 3000, "1 " * 3000, "a" * 3000 + "@", "+1" * 500,
        "12" * 2000 + " a@b.c", None, "", "a@b.c\na@b.c", "1.1.1.1@x.y 999.1.1.1 1.2.3"]


def test_base_spans_against_brute_force(spark, small):
    texts = HARD + list(small.values())
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select(
        "i", pii.base_spans(F.col("t")).alias("s")).collect()
    for r, t in zip(sorted(rows), texts):
        assert [tuple(x) for x in r.s] == brute_spans(t), t


def test_disclosing_terms_and_sanitised_text(spark):
    docs = [(i, f"write to boss@firm.com or meet Zanzibar{'x' * i} the Quixote office number {'abcdef'[i]}")
            for i in range(6)] + [(100 + i, f"the office of number {i} or to write and meet") for i in range(60)]
    rows = {r.doc_id: r for r in pii.find(spark.createDataFrame(docs, "doc_id long, text string")).withColumn(
        "clean", pii.sanitise(F.col("text"), F.col("spans"))).collect()}
    assert {docs[3][1][s.start:s.end] for s in rows[3].spans if s.kind == 4} == {"Quixote"}
    assert rows[3].clean == docs[3][1].replace("boss@firm.com", "<email>").replace("Quixote", "")
    assert not rows[100].spans and rows[100].clean is None
    copies = [(i, "mail boss@firm.com at the Quixote") for i in range(20)] + [(100 + i, "the at") for i in range(60)]
    found = pii.find(spark.createDataFrame(copies, "doc_id long, text string")).collect()
    assert all(s.kind < 4 for r in found for s in r.spans)   # copies of one line prove nothing


def shown(r, docs):
    return {docs[r.doc_id][s.start:s.end] for s in r.spans if s.kind == 4}


def test_terms_that_are_part_of_their_entity(spark):
    docs = {i: f"Anna Keller anna.keller@example.org wrote note {'abcdef'[i]}{i}x" for i in range(6)}
    docs |= {100 + i: f"wrote note {i} example" for i in range(60)}
    docs |= {200 + i: f"anna{i}@else.org wrote note {i}" for i in range(9)}   # inside entities a term doesn't count
    rows = pii.find(spark.createDataFrame(list(docs.items()), "doc_id long, text string")).collect()
    assert {r.doc_id: shown(r, docs) for r in rows} == {i: {"Anna", "Keller"} if i < 6 else set() for i in docs}


def test_terms_of_the_whole_document(spark):
    docs = {i: f"note {i} of {'abcdef'[i]}\nBo Li, KD48213\n李明\nbo@example.org\nsee it" for i in range(6)}
    docs |= {100 + i: f"note {i} of it, see" for i in range(60)}
    # Zed stands with the entity on one line and on others: all six documents count
    docs |= {200 + i: f"Zed zed@firm.com {i}" if i < 2 else f"Zed {i}\nzed@firm.com" for i in range(6)}
    docs |= {400 + i: "copy of Quixote\nq@firm.com" for i in range(20)}   # one text
    rows = pii.find(spark.createDataFrame(list(docs.items()), "doc_id long, text string")).collect()
    want = {i: {"Bo", "Li", "KD48213", "李明"} if i < 6 else {"Zed"} if 200 <= i < 206 else set() for i in docs}
    assert {r.doc_id: shown(r, docs) for r in rows} == want


def brute_terms(docs):
    term = re.compile(r"[^\W_]+")
    base = {i: brute_spans(t) for i, t in docs.items()}
    rest = {i: "".join(" " if any(a <= k < b for a, _, b in base[i]) else c for k, c in enumerate(t or ""))
            for i, t in docs.items()}
    terms = {i: {m.lower() for m in term.findall(t)} for i, t in rest.items()}
    holders = {}
    for i, spans in base.items():
        for a, _, b in spans:
            holders.setdefault(docs[i][a:b], set()).add(i)
    n_t = Counter(t for x in terms.values() for t in x)
    out = {i: set() for i in docs}
    for own in holders.values():
        n_te = Counter(t for i in own for t in terms[i])
        for t, n in n_te.items():
            texts = {docs[i] for i in own if t in terms[i]}
            if len(texts) >= 3 and len(own) < len(docs) and (
                    1 - math.log(n / n_t[t]) / math.log(len(own) / len(docs)) >= 0.9):
                for i in own:
                    out[i] |= {t} & terms[i]
    return {i: sorted((m.start(), m.end()) for m in term.finditer(rest[i]) if m.group().lower() in x)
            for i, x in out.items()}


def test_terms_against_brute_force(spark):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(25)] + ["a", "Öl", "x9", "7"]
    mails = [f"w{i}.a@m{i % 3}.org" for i in range(6)]
    docs = {i: "\n".join(" ".join(rng.choice(words) for _ in range(rng.randint(1, 3))) for _ in range(3))
            for i in range(150)}
    for i in range(60):
        k = rng.randrange(6)
        docs[i] += f"\nname{k} {mails[k]}" if rng.random() < 0.5 else f" {mails[k]}\nName{k} +49 30 123456{k}"
    docs |= {200 + i: docs[i % 5] for i in range(20)} | {300: None, 301: ""}
    rows = pii.find(spark.createDataFrame(list(docs.items()), "doc_id long, text string").repartition(3)).collect()
    got = {r.doc_id: [(s.start, s.end) for s in r.spans if s.kind == 4] for r in rows}
    assert got == brute_terms(docs) and any(got.values())


def test_pii_edges(edge_docs, no_docs, spark):
    rows = pii.find(edge_docs).collect()
    assert len(rows) == edge_docs.count()
    assert [r.doc_id for r in rows if r.spans] == [10]
    assert not pii.find(no_docs).count()
    got = {r.doc_id: r for r in QUERIES["op8_pii"](spark, SF).collect()}
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for i, t in docs.items():
        base = ",".join(f"{BASE[k][0]}:{a}:{b}" for a, k, b in brute_spans(t))
        assert got[i].base_sha256 == hashlib.sha256(base.encode()).hexdigest()


def test_pii_query_counts_by_kind(spark, tmp_path):
    card = "4785380592391139"   # each kind alone, pairs in both orders, one kind twice
    docs = {1: f"card {card}", 2: f"{card} at 152.143.123.131", 3: f"152.143.123.131 at {card}", 4: "+1 (521) 555-6210",
            5: "a@b.org", 6: "c@d.org a@b.org", 7: "none", 8: None, 9: f"1.2.3.4 {card}, +1 (521) 555-6210 a@b.org"}
    rows = [*docs.items(), (2, docs[2]), (None, docs[6])]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = Counter((r.doc_id, r.n_email, r.n_ip, r.n_card, r.n_phone)
                  for r in QUERIES["op8_pii"](spark, str(tmp_path)).collect())
    assert got == Counter((i, *[sum(k == j for _, k, _ in brute_spans(t)) for j in range(4)]) for i, t in rows)


# sharding

def test_shards_match_the_mixture(spark, small):
    rows = QUERIES["op10_shard"](spark, SF).collect()
    sizes, total = Counter(r.shard for r in rows), len(rows)
    assert max(sizes.values()) - min(sizes.values()) <= 1 and set(sizes) == set(range(16))
    for s in sizes:
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sizes[s]))
    for source, n in Counter(r.source for r in rows).items():
        for s in sizes:
            got = sum(r.source == source and r.shard == s for r in rows)
            assert abs(got - n * sizes[s] / total) <= 1.5
    for r in rows:
        raw = (small[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(raw) + 1, zlib.crc32(raw), "rows", None)
    again = QUERIES["op10_shard"](spark, SF).collect()
    assert {(r.doc_id, r.shard, r.slot) for r in rows} == {(r.doc_id, r.shard, r.slot) for r in again}


def test_interleaving_against_brute_force(spark, small):
    import hashlib as h
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for bucket_rows in (7, 10_000):
        got = shard.interleave(docs, shards=7, bucket_rows=bucket_rows).collect()
        by = {}
        for r in docs.collect():
            by.setdefault(r.source, []).append((h.md5(f"{shard.SEED}:{r.doc_id}".encode()).hexdigest(), r.doc_id))
        order = sorted(((2 * k + 1) / (2 * len(v)), x) for v in by.values() for k, x in enumerate(sorted(v)))
        assert [r.doc_id for r in sorted(got, key=lambda r: r["rank"])] == [i for _, (_, i) in order]


def test_shard_edges(edge_docs, no_docs):
    rows = shard.interleave(edge_docs, shards=50).collect()
    assert sorted(r["rank"] for r in rows) == list(range(edge_docs.count())) and {r.slot for r in rows} == {0}
    assert {r.text_crc32 for r in rows if r.doc_id in (1, 2)} == {0}
    assert not shard.interleave(no_docs).count()
