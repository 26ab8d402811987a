import time

import pytest

from lexmill.llm import budget, language, pairs, pieces, pii, scans, sitelines, truncation

TEXTS = {
    "one word": "x" * 200_000 + " a@b.fr", "digits": "0" * 200_000 + " a@b.fr", "dots": "a." * 60_000 + " x@y.fr", "spaces": ". " + " " * 200_000 + "fin", "at signs": "a@" * 40_000,
    "hyphens": "a-" * 60_000 + "@b.fr", "brackets": "(" * 100_000 + "x", "lines": "\n" * 100_000, "blanks before a number": "page" + " " * 100_000 + "5 x", "notes": "(voir x) " * 20_000, "particles": "M. " + "de la " * 40_000, "quotes": "« " * 40_000,
}


@pytest.mark.parametrize("name", TEXTS)
def test_texts_that_tempt_patterns_to_search_back(name):
    t = TEXTS[name]
    began = time.monotonic()
    pii.items(t)
    language.scorer().judge([t])
    truncation.ending(t, truncation.Closings({}), truncation.Heads([]))
    truncation.stops(t)
    scans.line_flags(t.split("\n")[:2000], "titre", truncation.Heads(["note sur"]))
    scans.wrapped(t.split("\n"))
    pairs.defects("Quel délai s'applique ?", t)
    pieces.pieces_of(t)
    budget.features(t)
    sitelines.line_keys(t)
    assert time.monotonic() - began < 20
