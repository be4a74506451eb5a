"""Disguises that mix, and the signs that let the transducers run."""

import random

import pytest

from shelfline.llm import pii


@pytest.mark.parametrize(
    "text, kind",
    [
        ("plus 1 415 555 0123", "phone"),
        ("+one 415 555 0123", "phone"),
        ("bob (at) example dot com", "email"),
        ("bob@example dot com", "email"),
        ("bob at example (dot) com", "email"),
        ("bob@mail dot example.com", "email"),
        ("bob at mail.example dot com", "email"),
        ("bob at example dot se", "email"),
        ("bob at example dot xyz", "email"),
        ("bob at a dot at dot com", "email"),
        ("10 dot 0.0 dot 1", "ip"),
        ("bob&#64;example.com", "email"),
        ("bob%40example.com", "email"),
        ("bob&commat;example&period;com", "email"),
        ("&#98;o&#x62;&#x40;example%2Ecom", "email"),
        ("&#43;1 415 555 0123", "phone"),
    ],
)
def test_mixed_disguises(text, kind):
    for before, after in (("", ""), ("write to ", " today")):
        whole = f"{before}{text}{after}"
        found = pii.find(whole)[1][kind]
        assert [whole[a:b] for a, b in found] == [text]


@pytest.mark.parametrize("text", ["look at example.com", "at the dot we stop", "two plus 3 is five", "version 1.2 dot 3", "a &#64; b", "50%40 of it", "&#10;&#233;&nbsp;", "x%2Ey"])
def test_prose_stays(text):
    assert not any(pii.find(text)[1].values())


def test_signs_cover_the_transducers():
    rnd = random.Random(3)
    parts = ["bob", "at", "(at)", "@", "example", "dot", "[.]", "com", "plus", "+", "one", "five", "415", "5550123", "10", ".", "1", "٣", "о", "​", "PLUS", "-", ",", "&#64;", "%40", "&period;", "&#49;", "&#7;", "%", "&", "\xa0", "\r"]
    quiet = 0
    for _ in range(20_000):
        text = "".join(rnd.choice(parts) + rnd.choice([" ", "", " "]) for _ in range(rnd.randint(2, 9)))
        if not pii.disguised(text):
            quiet += 1
            assert pii.base_spans(text) == pii.base_spans(pii.normalise(text).text) and pii.normalise(text).text == text
    assert quiet > 1000


def test_a_base_span_is_listed_once():
    """What is found in both ways at one place is one span."""
    text = "write user%2Btag@example.com or &#64; and b&#64;c%40d@e.org"
    base, found = pii.find(text)
    assert base["email"][0] == (6, 28) and found["email"].count((6, 28)) == 1 and set(base["email"]) <= set(found["email"])
