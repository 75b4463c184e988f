"""Templates come from distinct pages and leave no article empty; classes against brute force; neutral pages by template alone."""

from __future__ import annotations

import re
from collections import Counter, defaultdict

import pytest

from palimpsest.llm import templates

from .conftest import prose

PAGE = "<html><body><div class='top'><p>Site name</p></div>{}</body></html>"
BODY = "<h1>A title</h1><p>First words of it.</p><p>Second words of it.</p>"


def texts(spark, pages):
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    return {r.page_id: r["__main"] for r in templates.extract(df).collect()}


def test_copies_are_one_page(spark):
    inside, plain = PAGE.format(f"<article>{BODY}</article>"), PAGE.format(f"<div>{BODY}</div>")
    other = [(100 + i, "http://b.org/", PAGE.format(f"<div><h2>Other {i}</h2><section><p>Text {i} of its own</p></section></div>")) for i in range(2)]
    got = texts(spark, [(i, None, inside) for i in range(9)] + [(20 + i, "http://b.org/", plain) for i in range(4)] + other)
    want = "A title\nFirst words of it.\nSecond words of it."
    assert {got[i] for i in range(9)} == {want}
    assert all(got[20 + i].endswith(want) for i in range(4))


@pytest.mark.parametrize("n", [2, 7, 8, 9])
def test_an_article_keeps_all_its_text(spark, n):
    """Text that all articles of a host share stays in them, however many pages there are."""
    pages = [(i, "http://a.org/", PAGE.format(f"<article>{BODY}<p>Number {i}</p></article><footer>{i}</footer>")) for i in range(n)]
    assert texts(spark, pages) == {i: f"A title\nFirst words of it.\nSecond words of it.\nNumber {i}" for i in range(n)}


def neutral(i: int) -> tuple[str, str]:
    """A page whose tags and names say nothing, and its article."""
    body = [prose(100 * i + j, 40) for j in range(4)]
    links = "".join(f"<li><a href='/{k}'>{prose(1000 + i * 7 + k, 2)}</a></li>" for k in range(5))
    html = f"<html><body><div><ul>{links}</ul></div><div><b>Our site</b><p>Read us daily and tell others of it</p></div><div><section>{''.join(f'<p>{x}</p>' for x in body)}</section></div><div><p>Seen {i} times</p><p>All rights are ours</p></div></body></html>"
    return html, "\n".join(body)


def test_neutral_pages(spark):
    """Without a telling tag or name the template decides: what it leaves is the article, what names alone leave is not."""
    made = [neutral(i) for i in range(12)]
    got = texts(spark, [(i, "http://n.org/x", html) for i, (html, _) in enumerate(made)])
    alone = [templates.main_text(templates.Page(html), None, set())[0] for html, _ in made]
    assert [got[i] for i in range(12)] == [text for _, text in made]
    assert not any(a == text for a, (_, text) in zip(alone, made, strict=True))


def test_classes_against_brute_force(spark):
    """Tokens with the same counts on every distinct page of a host are one class; frequent classes of three tokens or more are kept."""
    pages = [("h", neutral(i)[0]) for i in range(9)] + [("h", neutral(0)[0])] + [("h", "<div><p>alone</p></div>")] + [("few", neutral(3)[0])]
    got = templates.templates(spark.createDataFrame(pages, "host string, html string")).collect()
    distinct = sorted({html for host, html in pages if host == "h"})
    vectors = defaultdict(list)
    for n, html in enumerate(distinct):
        for key, count in Counter(templates.Page(html).keys).items():
            vectors[key].append((n, count))
    classes = defaultdict(set)
    for key, vector in vectors.items():
        if len(vector) >= max(templates.LEAST_PAGES, templates.LEAST_SHARE * len(distinct)):
            classes[tuple(vector)].add(key)
    want = {frozenset(keys) for keys in classes.values() if len(keys) >= templates.LEAST_TOKENS}
    made = defaultdict(set)
    for t in next(r for r in got if r.host == "h").tokens:
        made[t["class"]].add(t["key"])
    assert {frozenset(x) for x in made.values()} == want and want
    assert not [r for r in got if r.host == "few" and r.tokens]


def test_classes_nest_in_one_slot():
    """A class whose tokens lie in two slots of the classes before it does not hold."""
    page = templates.Page("<div><p>a</p></div><div><p>b</p></div>")
    keys = page.keys
    token = lambda k, c, place, support: {"support": support, "class": c, "place": place, "key": k, "kind": 0}
    once = [k for k in keys if keys.count(k) == 1]
    assert len(once) == 2  # the two texts
    outer = [token(once[1], 1, 5, 9)]
    assert templates.main_text(page, [*outer, token(once[0], 2, 1, 5)], set())[1] == 2
    split = [token(once[0], 3, 1, 9), token(once[1], 3, 0, 9)]
    assert templates.main_text(page, split, set())[1] == 0  # not in the template's order


def test_long_and_broken_markup():
    page = templates.Page("<div>" * 3000 + "x" + "<p>" * 10)
    assert [b[3] for b in page.blocks] == ["x"]
    assert re.sub(r"\s", "", templates.main_text(templates.Page("<article>" + "<b>y" * 500), None, set())[0]) == "y" * 500
