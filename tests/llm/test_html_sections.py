"""Sections of an article stay whatever they are called; broken pages take linear time; the best run is the best one."""

from __future__ import annotations

import random
import time

import pytest

from quillframe.llm.html_text import PageModel, best_run, tokens

KEPT = ("related-work", "search-algorithms", "social-science", "ad-hoc", "note-search", "share-of-votes", "header-files", "menu-planning")
DROPPED = ("ad", "ad-slot", "share-buttons", "related-posts", "comment-list", "sidebar", "newsletter-signup", "banner-ad-2")


def page(name: str) -> str:
    return (f"<html><body><nav>go home</nav><main><p>first words of the text</p><div class='{name}'><p>words inside the part</p></div>"
            "<p>last words of the text</p></main><footer>end</footer></body></html>")


@pytest.mark.parametrize("name", KEPT)
def test_sections_of_the_article_stay(name):
    assert PageModel().extract(page(name)) == "first words of the text\nwords inside the part\nlast words of the text"
    assert "words inside the part" in PageModel().extract(page(name).replace("class=", "id="))


@pytest.mark.parametrize("name", DROPPED)
def test_marked_parts_of_the_article_go(name):
    assert PageModel().extract(page(name)) == "first words of the text\nlast words of the text"


@pytest.mark.parametrize("piece", ["<a ", "<a href='x", '<a href="x', "<div>", "<div class=ad>", "</x><div>", "<!-- ", "<p", "<script>", "<![x", "<div class='ad'><p>w</p></i>"])
def test_broken_pages_take_linear_time(piece):
    def took(n: int) -> float:
        started = time.process_time()
        tokens("<p>some words</p>" + piece * n)
        return time.process_time() - started

    took(100)
    assert took(40_000) < 40 * max(took(4000), 0.02)


def test_text_after_the_last_bracket():
    assert PageModel().extract("<p>one two</p>three <b") == "one two\nthree <b"
    assert PageModel().extract("<p>one two</p><script>var x = 1") == "one two"
    assert PageModel().extract("<p>one two</p><!-- a > b") == "one two"
    assert PageModel().extract("no tags at all") == "no tags at all" and PageModel().extract("") == ""


def test_best_run_against_all_runs():
    rng = random.Random(1)
    for _ in range(500):
        values = [rng.randint(-5, 5) for _ in range(rng.randint(0, 12))]
        sums = {(a, b): sum(values[a:b]) for a in range(len(values)) for b in range(a + 1, len(values) + 1)}
        first, end = best_run(values)
        assert sum(values[first:end]) == max([0, *sums.values()])
