"""Pages whose names mislead, unnamed comments, and the wrapper without any names or sectioning elements."""

import os
import random
import re
import subprocess
import sys
import time
from pathlib import Path

import pytest

from lorewell.llm import html_extraction as H


def prose(rng, n=3):
    return ["".join(rng.choice("abcdefgh") for _ in range(6)).capitalize() + " " + " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8))) for _ in range(30)) + "." for _ in range(n)]


def page(body, around="<div>{}</div>"):
    return f"<html><head><title>T</title></head><body>{around.format(body)}</body></html>"


WITH_NAMES = ['<div class="site with-sidebar">{}</div>', '<div id="page" class="has-sidebar">{}</div>', '<div class="search-results-page no-ads"><div>{}</div></div>', '<div id="content" class="sidebar">{}</div>', '<div role="dialog">{}</div>']


@pytest.mark.parametrize("around", WITH_NAMES)
@pytest.mark.parametrize("pages", [1, 3, 6])
def test_names_never_empty_a_page(around, pages):
    rng = random.Random(pages)
    texts = [prose(rng) for _ in range(pages)]
    got = H.extract([page("".join(f"<p>{x}</p>" for x in t), around) for t in texts])
    assert got == ["\n\n".join(t) for t in texts]


@pytest.mark.parametrize("pages", [1, 6])
@pytest.mark.parametrize("section", ['<div class="related-work"><p>{}</p></div>', '<section id="search-methods"><p>{}</p></section>', '<div class="social-history"><p>{}</p></div>'])
def test_sections_with_telling_words_stay(section, pages):
    rng = random.Random(7)
    texts = [prose(rng, 4) for _ in range(pages)]
    got = H.extract([page(f"<article><p>{t[0]}</p>{section.format(t[1])}<p>{t[2]}</p><p>{t[3]}</p></article>") for t in texts])
    assert got == ["\n\n".join(t) for t in texts]


def comments(rng, n, tag="div"):
    return "".join(f"<{tag}><p>Reader {k}, {rng.randint(1, 28)} May</p><p>{prose(rng, 1)[0]} {prose(rng, 1)[0]}</p></{tag}>" for k in range(n))


@pytest.mark.parametrize("pages", [1, 6])
@pytest.mark.parametrize("shape", ["<div><div>{}</div><div>{}</div></div>", "<div><div>{}</div><ul>{}</ul></div>", "<div>{}<div>{}</div></div>", '<div><article>{}<div class="x">{}</div></article></div>'])
def test_unnamed_comments_longer_than_the_article(shape, pages):
    rng = random.Random(9)
    texts = [prose(rng) for _ in range(pages)]
    tag = "li" if "<ul>" in shape else "div"
    got = H.extract([page(shape.format("".join(f"<p>{x}</p>" for x in t), comments(rng, 5 + k, tag))) for k, t in enumerate(texts)])
    assert got == ["\n\n".join(t) for t in texts]


def test_lists_and_sections_are_no_comments():
    rng = random.Random(4)
    t = prose(rng, 6)
    body = f"<article><p>{t[0]}</p><ul><li>{t[1]}</li><li>{t[2]}</li></ul><div><div><h3>Q one</h3><p>{t[3]}</p></div><div><h3>Q two</h3><p>{t[4]}</p></div></div><table><tr><td>a</td><td>b</td></tr><tr><td>c</td><td>d</td></tr></table></article>"
    assert H.extract([page(body)]) == ["\n\n".join([t[0], t[1], t[2], "Q one", t[3], "Q two", t[4], "a", "b", "c", "d"])]


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.1"), reason="no test tables")
def test_wrapper_needs_no_names_and_no_sectioning():
    import pyarrow.parquet as pq

    rows = pq.read_table("/root/testdata/sf0.1/pages.parquet").to_pylist()
    hosts = {}
    for r in rows:
        hosts.setdefault(re.match(r"[a-z]+://([^/]*)", r["url"])[1], []).append(r["html"])
    unnamed = lambda h: re.sub(r"""\s(?:class|id|role)=(?:"[^"]*"|'[^']*'|[^\s>]+)""", "", h)
    flat = lambda h: re.sub(r"<(/?)(?:nav|header|footer|aside|article|main|section)\b[^>]*>", r"<\1div>", h)
    seen = 0
    for pages in hosts.values():
        for k in range(0, len(pages), H.GROUP):
            some = pages[k : k + H.GROUP]
            if len(set(some)) >= 8:
                seen += len(some)
                want = H.extract(some)
                assert H.extract([unnamed(h) for h in some]) == want and all(want)
                assert H.extract([flat(unnamed(h)) for h in some]) == want
    assert seen > 1000


def test_many_differently_marked_children_in_seconds():
    rng = random.Random(3)
    pages = [page("<div>" + "".join(f'<div class="c{chr(97 + k % 26)}{"x" * (k % 70)} {rng.random().hex()[4:12]}"><p>{k} {rng.random()} words</p></div>' for k in range(5000)) + "</div>") for _ in range(4)]
    began = time.time()
    got = H.extract(pages)
    assert time.time() - began < 60 and all(len(x) > 5000 * 10 for x in got)


def test_large_pages_are_aligned_in_bounded_groups(spark):
    rng = random.Random(5)
    rows = [(k, "http://h.example/x", page("<p>Same notice on all pages.</p>" + "".join(f"<p>{x}</p>" for x in prose(rng, 6000)))) for k in range(14)]
    assert 1_000_000 < len(rows[0][2]) and sum(len(r[2]) for r in rows) > H.GROUP_CHARS
    got = H.html_extraction(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert len(got) == 14 and all(r["n_chars"] > 1_000_000 and "Same notice" not in r["text"] for r in got)


def test_memory_of_a_full_group():
    code = (
        "import resource, sys\nfrom lorewell.llm import html_extraction as H\n"
        "pages = ['<html><body><div>' + ''.join(f'<p class=c{n % 7}>{k} {n} ' + 'some words of text. ' * 8 + '</p>' for n in range(6000)) + '</div></body></html>' for k in range(64)]\n"
        "n = H.GROUP_CHARS // len(pages[0])\n"
        "assert all(H.extract(pages[:n]))\nprint(resource.getrusage(resource.RUSAGE_SELF).ru_maxrss)"
    )
    done = subprocess.run([sys.executable, "-c", code], check=True, capture_output=True, text=True, cwd=Path(__file__).parents[2])
    assert int(done.stdout) < 1_000_000  # KB
