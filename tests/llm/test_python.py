"""Mixing, HTML text, Jaccard join, WARC, substring dedup, pieces, pipeline."""
import base64
import hashlib
import html
import itertools
import random
import re
from collections import Counter, defaultdict

import duckdb
import pytest

import corpus_pipeline
from attrition.llm import (
    html_text,
    jaccard_join,
    mixing,
    pieces,
    quality_rules,
    shingles,
    signature_tree,
    substring_dedup,
    warc,
)
from attrition.llm.queries import QUERIES, SQL

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "labels", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    df = QUERIES[name](spark, SF)
    want = con.sql(SQL[name])
    assert sorted(df.columns) == sorted(want.columns)
    cols = sorted(df.columns)
    assert sorted(map(repr, (tuple(r) for r in df.select(cols).collect()))) == sorted(
        map(repr, want.select(*cols).fetchall()))


# mixing

def test_targets():
    assert mixing.fill([100, 100, 100], [5, 2, 1]) == [200.0, 500 / 3, 250 / 3]
    assert mixing.fill([], []) == [] and mixing.fill([0, 10], [5, 2]) == [0.0, 15.0]
    assert sum(mixing.fill([7, 90, 3, 55], [5, 2, 1, 5])) == pytest.approx(1.5 * 155)


def test_splitting_tree_spends_quotas_exactly():
    tree = mixing.split_quotas([1000, 17, 0, 300], 7, 1)
    assert [sum(x) for x in zip(*tree)] == [1000, 17, 0, 300]
    sizes = [sum(x) for x in tree]
    assert max(sizes) - min(sizes) <= 2 and tree == mixing.split_quotas([1000, 17, 0, 300], 7, 1)


def test_mixing_meets_targets(spark, small):
    rows = QUERIES["op1_mixing"](spark, SF).collect()
    word = re.compile(r"[^\x20\x09-\x0D]+")
    assert {(r.doc_id, r.size) for r in rows} == {(i, len(word.findall(t or ""))) for i, t in small.items()}
    names = sorted({r.source for r in rows})
    sizes = [sum(r.size for r in rows if r.source == s) for s in names]
    targets = mixing.fill(sizes, [(5, 2, 1)[i % 3] for i in range(len(names))])
    for s, size, target in zip(names, sizes, targets):
        own = [r for r in rows if r.source == s]
        assert all(r.source_size == size and r.target == pytest.approx(target) for r in own)
        assert sum(r.taken for r in own) == pytest.approx(target, abs=0.51)
    assert all(0 <= r.taken <= 2 * r.size for r in rows)
    again = QUERIES["op1_mixing"](spark, SF).collect()
    assert sorted(map(repr, rows)) == sorted(map(repr, again))


def test_mix_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    plan = {r.doc_id: r for r in mixing.plan(docs, block_words=300).collect()}
    rows = mixing.mix(docs, block_words=300).collect()
    assert Counter(r.doc_id for r in rows) == {i: len(r.shards) for i, r in plan.items() if r.shards}
    assert {r.mix_shard for r in rows} == set(range(mixing.SHARDS))
    word, whole, words = re.compile(r"[^\x20\x09-\x0D]+"), {r.doc_id: r.text for r in docs.collect()}, Counter()
    for r in rows:
        words[r.doc_id] += len(word.findall(r.text))
        assert whole[r.doc_id].startswith(r.text)
    assert words == {i: r.taken for i, r in plan.items() if r.taken}
    cut = Counter(plan[r.doc_id].source for r in rows if r.text != whole[r.doc_id])
    assert cut and max(cut.values()) == 1


def test_first_words(spark):
    from pyspark.sql import functions as F
    df = spark.createDataFrame([(" a\n b  c ", 2), ("a b c", 1), ("x" * 9, 1), ("é\u00a0é b", 1)], "t string, n long")
    got = [r[0] for r in df.select(mixing.first_words(F.col("t"), F.col("n"))).collect()]
    assert got == [" a\n b", "a", "x" * 9, "é\u00a0é"]


def test_mix_tells_rows_of_one_id_apart(spark):
    docs = spark.createDataFrame([(i // 2, "w " * (3 + i), "ab"[i % 2]) for i in range(40)],
                                 "doc_id long, text string, source string")
    plan = mixing.plan(docs).collect()
    rows = mixing.mix(docs).collect()
    assert Counter((r.doc_id, r.source) for r in rows) == {
        (r.doc_id, r.source): len(r.shards) for r in plan if r.shards}
    assert sum(len(r.text.split()) for r in rows) == sum(r.taken for r in plan)


def test_mix_without_broadcasts(spark, monkeypatch):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want = sorted(map(repr, mixing.plan(docs).collect()))
    monkeypatch.setattr(mixing, "BROADCAST", 0)
    assert sorted(map(repr, mixing.plan(docs).collect())) == want


def test_mixing_edges(edge_docs, no_docs):
    rows = mixing.plan(edge_docs).collect()
    assert len(rows) == edge_docs.count()
    assert all(r.taken == 0 for r in rows if r.size == 0)
    assert {r.source for r in rows} == {"a", "b", "c", None}
    assert mixing.mix(edge_docs).columns == [*edge_docs.columns, "mix_shard"] and mixing.mix(edge_docs).count()
    assert not mixing.plan(no_docs).count() and not mixing.mix(no_docs).count()


# HTML text

def test_blocks_of_a_page():
    page = ("<html><head><title>t</title></head><body><header>top</header><div class='cookie-notice'>x</div>"
            "<nav><ul><li>m</ul></nav><article class=post><header><h1>A &amp; B</h1></header><p>one <b>two</b>\n three<p>"
            "f&ouml;ur&nbsp;&#33;<br>five<script>if (a</p>b) {}</script><ul><li>x<li>y</ul><!-- no <p> -->"
            "<div class='ad'>buy</div><section id='comments'><p>me too</p></section><form><p>name</p></form>"
            "<p hidden>h</p></article><aside>side</aside><footer>foot</footer></body></html>")
    assert " ".join(t for _, t in html_text._main(page)) == "A & B one two three för ! five x y".replace("för", "föur")
    assert html_text._main(None) == [] == html_text._main("") == html_text._main("<nav>only</nav>")
    assert " ".join(t for _, t in html_text._main("plain & simple <3 <p>x <")) == "plain & simple <3 x <"
    assert html_text._main("<p>" * 3000 + "deep")[-1][1] == "deep"


def simple_article(page):
    body = re.search(r"<article>(.*?)(</article>|\Z)", page, re.S)[1]
    body = re.sub(r"</?(h1|p|br|div|li|ul)[^>]*>", " ", body)
    return " ".join(html.unescape(re.sub(r"</?(b|i|a|em)\b[^>]*>", "", body)).split())


def test_text_of_the_given_pages(spark):
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    rows = QUERIES["op3_html_text"](spark, SF).collect()
    assert {r.page_id: r.text for r in rows} == {i: simple_article(p) for i, p in pages.items()}
    assert all(r.n_chars == len(r.text) for r in rows)


def test_style_tree_removes_what_a_host_repeats(spark):
    def page(i, story):
        return f"<body><div class=q7><p>Welcome to our site {i % 2}</p></div><div class=z><p>{story}</p></div></body>"
    rows = [(i, f"http://h.example/{i}", page(i, f"story {i} is unlike others")) for i in range(40)]
    rows += [(100 + i, f"http://two.example/{i}", page(i, f"tale {i}")) for i in range(2)]
    rows += [(200 + i, f"http://mirror.example/{i}", page(0, "the same tale")) for i in range(30)]
    rows += [(300, None, page(0, "no host")), (301, "http://e.example/", None), (302, "x", ""), (302, "x", "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr(
        "*", "'x' AS text", "'y' AS host", "1 AS node", "2 AS salt", "3 AS poor")
    got = {r.page_id: r.text for r in html_text.extract(pages).collect()}
    assert got[3] == "story 3 is unlike others"
    assert got[101] == "Welcome to our site 1 tale 1" and got[205] == "Welcome to our site 0 the same tale"
    assert got[300] == "Welcome to our site 0 no host" and got[301] == got[302] == ""
    assert html_text.extract(pages).count() == len(rows) and not html_text.extract(pages.where("false")).count()


# Jaccard join

def word_sets(docs):
    out = {}
    for i, t in docs:
        w = (t or "").encode().lower().split()
        out[i] = {tuple(w[k:k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    return out


def brute_components(docs, percent=80):
    sets, up = word_sets(docs), {}
    def root(i):
        while up.get(i, i) != i:
            i = up[i]
        return i
    by = defaultdict(set)
    for i, s in sets.items():
        for x in s:
            by[x].add(i)
    for a, b in {p for v in by.values() for p in itertools.combinations(sorted(v), 2)}:
        if 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
            x, y = sorted((root(a), root(b)))
            up[y] = x
    return {i: (len(s), root(i)) for i, s in sets.items()}


def near_copies(n, seed):
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(3000)}"
    out, passage = [], [word() for _ in range(30)]
    for g in range(n):
        base = [word() for _ in range(rng.randrange(3, 120))]
        if g % 3 == 0:
            base = passage + base
        for _ in range(rng.choice([1, 1, 2, 9])):
            w = list(base)
            for _ in range(rng.randrange(0, 4)):
                w[rng.randrange(len(w))] = word()
            out.append(" ".join(w))
    return list(enumerate(out))


@pytest.mark.parametrize("members,often", [(2048, 32), (3, 2)])
def test_links_against_brute_force(spark, monkeypatch, members, often):
    monkeypatch.setattr(jaccard_join, "PART_MEMBERS", members)
    monkeypatch.setattr(jaccard_join, "OFTEN", often)
    docs = near_copies(60, members)
    rows = jaccard_join.link_components(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows} == brute_components(docs)


def test_join_query_against_brute_force(spark, small):
    rows = QUERIES["op5_jaccard_join"](spark, SF).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows} == brute_components(list(small.items()))


def test_tree_loses_no_pair():
    import numpy as np
    rng = np.random.default_rng(3)
    base = [rng.integers(0, 2 ** 63, n, dtype=np.uint64) for n in (1, 2, 5, 17, 60, 61, 200)]
    sets = [np.unique(np.concatenate([b[k:], rng.integers(0, 2 ** 63, k, dtype=np.uint64)]))
            for b in base for k in range(0, 1 + len(b) // 5)]
    items = [(len(s), signature_tree.bitmap(s)) for s in sets]
    got = {tuple(sorted(p)) for p in signature_tree.candidates(signature_tree.trees(items), 80)}
    linked = {(i, j) for i, j in itertools.combinations(range(len(sets)), 2)
              if 100 * len(np.intersect1d(sets[i], sets[j])) >= 80 * len(np.union1d(sets[i], sets[j]))}
    assert linked <= got and len(got) < len(sets) * (len(sets) - 1) / 4


def test_pairs_of_one_group_are_not_walked_again():
    import numpy as np
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2 ** 63, 200, dtype=np.uint64)
    sets = [np.unique(np.concatenate([base[4:], rng.integers(0, 2 ** 63, 4, dtype=np.uint64)])) for _ in range(256)]
    far = [np.unique(rng.integers(0, 2 ** 63, 200, dtype=np.uint64)) for _ in range(40)]
    items = [(len(s), signature_tree.bitmap(s)) for s in sets + far]
    union, walked = jaccard_join._Union(len(items)), 0
    for i, j in signature_tree.candidates(signature_tree.trees(items), 80, signature_tree.joined(union.root)):
        union.join(i, j)
        walked += 1
    every = list(signature_tree.candidates(signature_tree.trees(items), 80))
    assert len(every) >= 256 * 255 // 2 and walked < 2 * 256
    assert all(union.root(i) == union.root(j) for i, j in every)
    left, right = signature_tree.trees(items[:100]), signature_tree.trees(items[100:], 100)
    assert sorted(signature_tree.between(left, right, 80)) == sorted(
        (min(p), max(p)) for p in every if min(p) < 100 <= max(p))


def test_a_line_of_many_documents_makes_no_block_of_them(spark, monkeypatch):
    rng = random.Random(2)
    line = " ".join(f"line{i}" for i in range(14))
    docs = [(i, " ".join([line] + [f"w{rng.randrange(10 ** 9)}" for _ in range(40)])) for i in range(300)]
    docs += [(300 + i, t + " more") for i, t in docs[:20]]
    families, members = jaccard_join._families, []

    def noted(rows, percent):
        members.extend(r["count"] for r in rows.groupBy("block", "part").count().collect())
        return families(rows, percent)
    monkeypatch.setattr(jaccard_join, "_families", noted)
    table = spark.createDataFrame(docs, "doc_id long, text string").repartition(30)  # ten rows a batch
    rows = jaccard_join.link_components(table).collect()
    assert {r.doc_id: r.component_id for r in rows} == {i: i - 300 if i >= 300 else i for i, _ in docs}
    assert sorted(members) == [2] * 20


def test_widespread_tokens_are_counted_over_all_batches(spark, monkeypatch):
    import numpy as np
    monkeypatch.setattr(jaccard_join, "FREQUENT", 6)
    monkeypatch.setattr(jaccard_join, "SPAN_TOKENS", 100)
    texts = [f"a b c d e f w{i} x y z" for i in range(40)] + [f"g h i j k v{i} x" for i in range(30)] + [None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(9)
    sets = shingles.shingle_sets(texts)
    classes = spark.createDataFrame([(len(s),) for s in sets], "n long")
    keys, rank, more = jaccard_join._widespread(docs, classes, 5)
    times = Counter(x for s in sets for x in s.tolist())
    want = sorted((t, x) for x, t in times.items() if t >= jaccard_join.OFTEN)
    assert len(want) == 3 and more < 32 and keys.tolist() == sorted(x >> more for _, x in want)
    assert [k for _, k in sorted(zip(rank.tolist(), keys.tolist()))] == [x >> more for _, x in want]
    monkeypatch.setattr(jaccard_join, "FREQUENT", 2)
    assert len(jaccard_join._widespread(docs, classes, 5)[0]) == 2
    none = jaccard_join._widespread(docs.where("false"), classes.where("false"), 5)
    assert len(none[0]) == len(none[1]) == 0 and keys.dtype == none[0].dtype == np.uint64


def test_join_edges(edge_docs, no_docs):
    rows = jaccard_join.link_components(edge_docs).collect()
    assert len(rows) == edge_docs.count()
    got = {(r.doc_id, r.n_shingles): r.component_id for r in rows}
    assert got[5, 2] == got[6, 2] == got[7, 2] == 5
    assert got[1, 0] == 1 and got[2, 0] == 2 and got[None, 0] is None and got[9, 1] == 9 and got[8, 1] == 8
    assert not jaccard_join.link_components(no_docs).count()
    kept = jaccard_join.one_of_each(edge_docs)
    assert kept.columns == edge_docs.columns
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id) == [1, 2, 3, 4, 5, 8, 9, 10]
    assert len(shingles.shingle_sets([None, "", "a", "a b c d e f"])[3]) == 2


def test_rows_that_share_an_id_are_judged_by_their_texts(spark):
    texts = [t for _, t in near_copies(40, 11)]
    for ids in (lambda i: i % 5 or None, lambda i: None if i % 3 else i, lambda i: i // 7, lambda i: None):
        rows = [(ids(i), t) for i, t in enumerate(texts)]
        component = {i: c for i, (_, c) in brute_components(list(enumerate(texts))).items()}
        least = {}
        for i, (d, _) in enumerate(rows):
            own = [x for x in (least.get(component[i]), d) if x is not None]
            least[component[i]] = min(own) if own else None
        want = [(d, t, least[component[i]]) for i, (d, t) in enumerate(rows)]
        docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
        got = jaccard_join.link_components(docs).collect()
        assert Counter((r.doc_id, r.component_id) for r in got) == Counter((d, c) for d, _, c in want)
        kept = jaccard_join.one_of_each(docs).collect()
        assert Counter(map(tuple, kept)) == Counter((d, t) for d, t, c in want if d == c)


def test_rows_with_null_or_repeated_ids_stay_for_themselves(spark):
    a, b, c, d = (" ".join(f"{x}{i}" for i in range(40)) for x in "abcd")
    rows = [(3, a), (7, a + " more"), (7, b), (8, c), (None, c.replace(" ", "  ")), (None, d), (None, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = jaccard_join.one_of_each(docs).collect()
    assert Counter(map(tuple, kept)) == Counter([(3, a), (7, b), (8, c), (None, d), (None, "")])
    named = spark.createDataFrame([(str(i) if i else None, 1, t) for i, t in rows], "k string, text int, body string")
    kept = jaccard_join.one_of_each(named, "k", "body")
    assert kept.columns == ["k", "text", "body"] and kept.count() == 5


# WARC

def test_archives_round_trip(spark, tmp_path):
    odd = "line\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\n\r\né"
    rows = [(1, "http://a/", odd), (2, None, odd), (3, "http://c/\r\nX: y ", odd), (4, "", None), (5, "u", ""),
            (None, "n", "x"), (None, "n", "x"), (6, "u6", "same"), (6, "u6", "same"), (7, "u7", "y" * 300_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr(
        "*", "'c' AS payload", "'d' AS salt", "1 AS first", "2 AS record_type")
    path = str(tmp_path / "w")
    warc.write_archives(warc.resolve(pages), path)
    got = {(r.page_id, r.url): r for r in warc.read_archives(spark, path).collect()}
    assert warc.read_archives(spark, path).count() == len(rows) and len(got) == 8
    for i, u, h in rows:
        raw = (h or "").encode()
        r = got[i, u]
        assert r.payload_bytes == len(raw)
        assert r.payload_digest == base64.b32encode(hashlib.sha1(raw).digest()).decode()
        assert r.payload is None if r.record_type == "revisit" else bytes(r.payload) == raw
    kinds = {k: (r.record_type, r.refers_to) for k, r in got.items()}
    assert kinds[1, "http://a/"] == ("revisit", 3) == kinds[2, None] and kinds[3, rows[2][1]] == ("response", None)
    assert kinds[4, ""] == ("revisit", 5) and kinds[6, "u6"][0] == "response" == kinds[None, "n"][0]
    assert warc.resolve(pages, min_bytes=1).where("record_type = 'revisit'").count() == 2
    empty = str(tmp_path / "e")
    warc.write_archives(warc.resolve(pages.where("false")), empty)
    assert not warc.read_archives(spark, empty).count()


# substring dedup

def brute_repeats(texts, length):
    seen = Counter(t[i:i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = [False] * len(t)
        for i in range(len(t) - length + 1):
            if seen[t[i:i + length]] > 1:
                gone[i:i + length] = [True] * length
        left = bytes(c for c, g in zip(t, gone) if not g)
        out.append((len(t), sum(gone), sum(k for k, _ in itertools.groupby(gone)), hashlib.sha256(left).hexdigest()))
    return out


def test_interval_expansion_against_brute_force():
    rng = random.Random(5)
    for length in (1, 3, 8, 20):
        for _ in range(40):
            texts = [bytes(rng.choice(b"ab\0") for _ in range(rng.randrange(0, 60))) for _ in range(rng.randrange(1, 6))]
            seen = Counter(t[i:i + length] for t in texts for i in range(len(t) - length + 1))
            want = [[i for i in range(len(t) - length + 1) if seen[t[i:i + length]] > 1] for t in texts]
            assert [g.tolist() for g in substring_dedup.repeated_windows(texts, length)] == want


@pytest.mark.parametrize("group,part", [(2048, 1 << 20), (2, 300)])
def test_repeats_against_brute_force(spark, monkeypatch, group, part):
    monkeypatch.setattr(substring_dedup, "GROUP", group)
    monkeypatch.setattr(substring_dedup, "PART_BYTES", part)
    rng = random.Random(group)
    noise = lambda n: "".join(rng.choice("abcdefgé ") for _ in range(n))
    passages = [noise(90), noise(250), "ab" * 60, "x" * 70]
    texts = [noise(rng.randrange(200)) + rng.choice(passages) + noise(rng.randrange(50)) + rng.choice(passages)
             for _ in range(40)] + ["", None, noise(39), "z" * 500, "z" * 20]
    texts += texts[:5] + [texts[7][10:]]
    docs = [(i if i else None, t) for i, t in enumerate(texts)] + [(9, "again " + texts[3])]
    rows = substring_dedup.remove_repeats(spark.createDataFrame(docs, "doc_id long, text string").repartition(5),
                                          length=40, gram=16).collect()
    want = brute_repeats([(t or "").encode() for _, t in docs], 40)
    got = Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(r.kept).hexdigest()) for r in rows)
    assert got == Counter((i, *w) for (i, _), w in zip(docs, want))


def test_substring_query_against_brute_force(spark, small):
    rows = {r.doc_id: r for r in QUERIES["op7_substring_dedup"](spark, SF).collect()}
    want = dict(zip(small, brute_repeats([(t or "").encode() for t in small.values()], 200)))
    assert {i: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for i, r in rows.items()} == want


def test_substring_edges(edge_docs, no_docs):
    rows = substring_dedup.remove_repeats(edge_docs).collect()
    assert len(rows) == edge_docs.count()
    docs = edge_docs.collect()
    want = brute_repeats([(r.text or "").encode() for r in docs], 200)
    got = Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(r.kept).hexdigest()) for r in rows)
    assert got == Counter((r.doc_id, *w) for r, w in zip(docs, want))
    assert sum(r.n_removed for r in rows) > 200_000    # the long text repeats its own start
    assert not substring_dedup.remove_repeats(no_docs).count()


# pieces

@pytest.fixture(scope="module")
def vocabulary():
    return pieces.Vocabulary(pieces._model_bytes(pieces.MODEL))


TEXTS = ["the cat", "a\tñ 梦龘", "Hello  wor", "", " ", "  a ", "x\n\ny", "a,b.c", "퟿\U0001f600!", "..,a"]


@pytest.mark.parametrize("text", TEXTS)
def test_n_best_against_all_paths(vocabulary, text):
    def paths(edges, end):
        return [(0.0, ())] if end == 0 else [
            (s + x, p + own) for start, x, own in edges[end] for s, p in paths(edges, start)]
    words = vocabulary.words(pieces.marked(text))
    assert "".join(words) == pieces.marked(text)
    best = [0.0]
    for w in words:
        best = sorted((a + s for a in best for s, _ in paths(vocabulary.edges(w), len(w))), reverse=True)[:4]
    whole = vocabulary.edges(pieces.marked(text))      # the undivided lattice has the same best path
    forward = [0.0]
    for end in range(1, len(whole)):
        forward.append(max(forward[s] + x for s, x, _ in whole[end]))
    ids, score, lists = pieces.encode_texts(vocabulary, [text], 4)
    assert score[0] == pytest.approx(best[0]) == pytest.approx(forward[-1])
    assert lists[0] == pytest.approx(best)
    full = pieces.segmentations(vocabulary, text, 4)
    assert [s for s, _ in full] == pytest.approx(best) and all(
        pieces.decode_ids(vocabulary, i) == text for _, i in full)
    assert pieces.decode_ids(vocabulary, ids[0].tolist()) == text


def test_pieces_round_trip(spark, small):
    import sentencepiece
    m = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    coded = pieces.encode(docs).cache()
    assert {r.doc_id: r.text for r in pieces.decode(coded).collect()} == small
    for r in coded.collect():
        assert r.lossless and r.n_pieces == len(r.ids) and m.decode(r.ids) == small[r.doc_id]
        assert r.score == r.nbest_scores[0] >= r.nbest_scores[-1]


def test_pieces_edges(edge_docs, no_docs, spark):
    rows = pieces.encode(edge_docs).collect()
    assert len(rows) == edge_docs.count() and all(r.lossless for r in rows)
    assert [r.ids for r in rows if r.doc_id == 1] == [[]]
    assert not pieces.encode(no_docs).count() and not pieces.decode(pieces.encode(no_docs)).count()
    mark = spark.createDataFrame([("k", "a▁b")], "doc_id string, text string")
    assert not pieces.encode(mark).first().lossless


# pipeline

def test_pipeline_against_brute_force(spark, small):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    rules = quality_rules.learn_rules(docs, labels)
    good = {r.doc_id: small[r.doc_id] for r in quality_rules.judge(docs, rules).where("kept").collect()}
    last = {}
    for i, t in good.items():
        key = re.sub("[A-Z]", lambda m: m[0].lower(), t)
        last[key] = max(i, last.get(key, -1))
    unique = {i: good[i] for i in last.values()}
    parts = brute_components(list(unique.items()))
    stay = {i for i, (n, c) in parts.items() if i == c}
    kept = docs.where(docs.doc_id.isin(sorted(stay)))
    want = {r.doc_id: len(r.shards) for r in mixing.plan(kept).collect() if r.shards}
    out = corpus_pipeline.run(spark, SF).collect()
    assert Counter(r.doc_id for r in out) == want and all(r.lossless for r in out)


def test_stages_keep_columns(edge_docs, no_docs, spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "quality_rules", "exact_dedup", "jaccard_join", "mixing", "sentencepiece"]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, edge_docs, SF).columns == edge_docs.columns, name
        assert stage(spark, no_docs, SF).count() == 0, name


def test_words_learnt_together_have_the_paths_of_each_alone():
    v = pieces.Vocabulary(pieces._model_bytes(pieces.MODEL))
    rng = random.Random(4)
    words = sorted({"".join(rng.choice("abeinrst\u2581\u00e9\u4e2d\U0001f600 .-") for _ in range(rng.choice([1, 2, 5, 9, 40, 300])))
                    for _ in range(120)})
    v.learn(words)
    for w in words:
        k = v.at[w]
        ids, best, second = v.path(w)
        assert v.best[k] == pytest.approx(best) and v.gap[k] == pytest.approx(best - second)
        own = v.ids[v.begin[k]:v.begin[k + 1]].tolist()
        assert own == ids and v.join(own) == b"".join(v.raw[i] for i in own).decode() == w
