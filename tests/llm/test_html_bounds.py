"""Hostile pages: time and output grow with the source alone, and no text is lost."""

import time

import pytest

from tessera.llm.html_text import rendered

PAGES = {
    "nested blocks": ("<div>" * 100_000 + "x", 1),
    "nested lists": ("<ul><li>x " * 50_000, 50_000),
    "nested quotes": ("<blockquote>x " * 50_000, 50_000),
    "nested tables": ("<table><tr><td>x " * 50_000, 50_000),
    "unclosed inline": ("<b>" * 100_000 + "x " + "</i>" * 100_000, 1),
    "a long cell": ("<table><tr><td>" + "x " * 500_000 + "<td>x<tr><td>x<td>x", 500_003),
    "a wide cell over short ones": ("<table><tr><td>" + "x" * 24_000 + "<td>y" + "<tr><td>x<td>x" * 2_000, 4_000),
    "many columns": ("<table><tr>" + "<td>" * 50_000 + ("<tr>" + "<td colspan=1000>" * 50 + "<td>x") * 500, 500),
    "many lines by many cells": ("<table><tr>" + "<td>x" * 25_000 + "<td>" + "x<br>" * 50_000, 75_000),
    "wide and high spans": ("<table>" + "<tr><td colspan=1000 rowspan=1000>x" * 20_000, 20_000),
    "odd quotes": ("<a '\">x " * 100_000, 100_000),
    "quoted brackets": ('<a b=">" c>x ' * 80_000, 80_000),
}


@pytest.mark.parametrize("name", PAGES)
def test_grows_with_the_source(name):
    source, words = PAGES[name]
    began = time.time()
    text, _ = rendered(source)
    assert time.time() - began < 20
    assert len(text) < 20 * len(source)
    assert text.split().count("x") == words


def test_layout_beyond_its_bounds_keeps_the_order():
    wide = "w" * 100
    assert rendered(f"<table><tr><td>{wide}<td>b<tr><td>a<td>c</table>")[0] == f"{wide}  b\na{' ' * 49}c"
    deep = "<table><tr><td>a<td>b" * 12
    assert rendered(deep)[0].split() == ["a", "b"] * 12
