"""Texts without a break, hostile pages and the parts of N-best lists."""

import base64
import random
import time

import pytest
from pyspark.sql import functions as F

from attrition.llm import pieces


@pytest.fixture(scope="module")
def vocabulary():
    return pieces.Vocabulary(pieces._model_bytes(pieces.MODEL))


LONG = {
    "base64": base64.b64encode(random.Random(1).randbytes(75_000)).decode(),
    "one letter": "a" * 100_000,
    "no blanks": "".join(chr(0x4E00 + random.Random(k).randrange(3000)) for k in range(100_000)),
}


@pytest.mark.parametrize("name", LONG)
def test_long_words_take_seconds(vocabulary, name):
    began = time.time()
    ids, best, lists, changes = pieces.encoded(vocabulary, [LONG[name]], 4)
    assert time.time() - began < 60
    assert 1 <= len(lists[0]) <= 4 and abs(lists[0][0] - best[0]) < 1e-6 and lists[0] == sorted(lists[0], reverse=True)
    own = ids[0].tolist()
    versions = [pieces.edited(own, c) for c in changes[0]]
    assert versions[0] == own and len({tuple(x) for x in versions}) == len(versions)
    assert all(pieces.decode_ids(vocabulary, x) == LONG[name] for x in versions)


def test_long_and_short_words_take_the_same_paths(vocabulary, monkeypatch):
    words = [pieces.MARK + "".join(random.Random(k).choices("abcdefghé日 ".replace(" ", ""), k=40)) for k in range(30)]
    pieces_of = lambda: [(vocabulary.ids[vocabulary.begin[i]:vocabulary.begin[i + 1]].tolist(),
                          round(vocabulary.best[i], 6), round(vocabulary.gap[i], 6))
                         for i in map(vocabulary.at.get, words)]
    vocabulary.clear()
    vocabulary.learn(list(words))
    block = pieces_of()
    vocabulary.clear()
    monkeypatch.setattr(pieces, "LONG", 0)
    vocabulary.learn(list(words))
    alone = pieces_of()
    assert [x[1:] for x in block] == [x[1:] for x in alone]
    vocabulary.clear()


def test_changes_make_the_n_best(vocabulary, spark):
    df = spark.createDataFrame([(1, "An unusual sentence, indeed."), (2, ""), (3, None)], "doc_id long, text string")
    for r in pieces.encode(df).orderBy("doc_id").collect():
        versions = [pieces.edited(r["ids"], [(c["place"], c["size"], c["ids"]) for c in k]) for k in r["nbest_changes"]]
        assert versions[0] == r["ids"] and len(versions) == len(r["nbest_scores"])
        assert len({tuple(x) for x in versions}) == len(versions)
        assert all(pieces.decode_ids(vocabulary, x) == ("An unusual sentence, indeed." if r["doc_id"] == 1 else "")
                   for x in versions)
    score = {i: s for s, i in vocabulary.score.values()}
    r = pieces.encode(df.where(F.col("doc_id") == 1)).first()
    for s, k in zip(r["nbest_scores"], r["nbest_changes"]):
        own = pieces.edited(r["ids"], [(c["place"], c["size"], c["ids"]) for c in k])
        assert abs(sum(score[i] for i in own) - s) < 1e-6


# ------------------------------------------------------------- pages

def _text(page):
    from attrition.llm import html_text
    return " ".join(t for _, t in html_text._main(page))


def test_names_count_as_whole_classes():
    assert _text('<div class="content has-sidebar"><p>Real article text.</p></div>') == "Real article text."
    assert _text('<div class="page no-sidebar with-comments"><p>Body.</p></div>') == "Body."
    assert _text('<article><p>A.</p><section class="discussion"><p>We find.</p></section></article>') == "A. We find."
    assert _text('<div class="market-share"><p>40 percent.</p></div>') == "40 percent."
    assert _text("<p>Let <math><mi>x</mi></math> be.</p>") == "Let x be."
    assert _text("<p>A</p><noscript><p>B</p></noscript><map><p>C</p></map>") == "A B C"
    assert _text('<div class="sidebar"><p>All there is.</p></div>') == "All there is."
    for name in ("sidebar", "site-footer", "cookie-banner", "ad", "sidebar-left", "related-posts", "comments"):
        assert _text(f'<p>Text.</p><div class="x {name}"><p>Gone.</p></div>') == "Text."


@pytest.mark.parametrize("page, least", [
    ("<a " * 333_000, 0), ("<div>x" * 100_000, 200_000 - 1), ("<b>" * 100_000 + "<h1>t</h1>" * 20_000, 40_000 - 1),
    ("<!-- " * 100_000, 0), ("<p a='" * 100_000 + ">t", 0), ("</x>" * 200_000 + "t", 1)])
def test_hostile_pages_take_seconds(page, least):
    from attrition.llm import html_text
    began = time.time()
    read = html_text.read_page(page)
    list(read.nodes())
    assert len(" ".join(read.outside({1}))) >= least and time.time() - began < 30


def test_trees_of_small_hosts(spark):
    """Two to nine pages that don't name their parts: what is the same on all goes."""
    from attrition.llm import html_text
    rows = []
    for host, n in (("two.example", 2), ("nine.example", 9)):
        rows += [(len(rows) + k, f"https://{host}/{k}", f"<div class=q1><p>All rights of {host}.</p></div>"
                  f"<div class=q2><p>Story {k} of {host}.</p><p>More {k * 7}.</p></div>") for k in range(n)]
    rows.append((99, "https://one.example/", "<div class=q1><p>Alone.</p></div>"))
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in html_text.extract(pages).collect()}
    assert got[0] == "Story 0 of two.example. More 0." and got[10] == "Story 8 of nine.example. More 56."
    assert got[99] == "Alone." and len(got) == len(rows)
