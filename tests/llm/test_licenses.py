import random
import re

import pytest

from tests.llm.data import awkward, empty
from tillroll.llm import licenses
from tillroll.llm.licenses import Automaton, Scanner, Template, parse, split_words

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def test_words_are_those_of_the_pattern():
    text = "MIT-License, Ünï ÀB\x00c\x7f1_2  x"
    assert [w.decode() for w in split_words(text.encode())] == WORD.findall(text.translate(LOWER))


@pytest.mark.parametrize("seed", range(30))
def test_automaton_against_regex(seed):
    rng = random.Random(seed)

    def region(depth):
        out = []
        for _ in range(rng.randint(1, 3)):
            kind = rng.random()
            if kind < 0.5 or depth == 2:
                out.append(rng.choice("abc"))
            elif kind < 0.8:
                out.append(f"<<beginOptional>>{region(depth + 1)}<<endOptional>>")
            else:
                low = rng.randint(0, 1)
                out.append(f'<<var;words="{low}-{low + rng.randint(0, 2)}">>')
        return " ".join(out)

    markup = "a " + region(0)
    automaton, pattern = Automaton(parse(markup)), re.compile(licenses.as_regex(markup))
    for _ in range(60):
        words = [rng.choice("abc") for _ in range(rng.randint(1, 8))]
        line = "".join(w + " " for w in words)
        ends = [k for k in range(len(words) + 1) if pattern.fullmatch("".join(w + " " for w in words[:k]))]
        assert automaton.match([w.encode() for w in words], 0) == (max(ends) if ends else None), (markup, line)


def test_optional_and_replaceable_wording():
    notice = "Permission is hereby granted, free of charge, to any person obtaining a copy of {} (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, {}and/or sell copies"
    labels = lambda t: {licenses.TEMPLATES[k].label for k, _, _ in Scanner(licenses.TEMPLATES).scan(t.encode())[1]}
    assert labels(notice.format("this software", "sublicense, ")) == {"mit-opening"}
    assert labels(notice.format("any part of it", "")) == {"mit-opening"}
    assert labels(notice.format("this software", "").replace("restriction", "restrictions")) == set()
    assert labels("Released under the MIT License.") == {"mit", "mit-notice"}


MIT = """MIT License

Copyright (c) 2020 Someone

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
SOFTWARE.
"""


def _labels(text):
    return {licenses.TEMPLATES[k].label for k, _, _ in Scanner(licenses.TEMPLATES).scan(text.encode())[1]}


def test_a_changed_licence_is_not_the_licence():
    assert _labels(MIT) == {"mit", "mit-opening", "mit-text"}
    restricted = MIT.replace("copies of the Software, and", "copies of the Software for non-commercial purposes only, and")
    assert _labels(restricted) == {"mit", "mit-opening"}
    assert _labels(MIT.replace("WITHOUT WARRANTY", "WITH WARRANTY")) == {"mit", "mit-opening"}
    assert _labels(MIT[: MIT.index("THE SOFTWARE IS")]) == {"mit", "mit-opening"}


def _example(parts, optional):
    """A text that the template accepts, and the places of its mandatory words."""
    words, mandatory = [], []
    for part in parts:
        if isinstance(part, bytes):
            mandatory.append(len(words))
            words.append(part.decode())
        elif isinstance(part, tuple):
            words += ["filler"] * part[0]
        elif optional:
            inner, places = _example(part, optional)
            words += inner
    return words, mandatory


@pytest.mark.parametrize("template", [t for t in licenses.TEMPLATES if t.weight == 1.0 and not t.base], ids=lambda t: t.label)
def test_every_mandatory_word_counts(template):
    for optional in (False, True):
        words, mandatory = _example(parse(template.markup), optional)
        scanner = Scanner((template,))
        (found,) = scanner.scan(" ".join(words).encode())[1]
        assert found[1] == 0
        for at in mandatory:
            changed = [*words[:at], "changed", *words[at + 1 :]]
            assert not scanner.scan(" ".join(changed).encode())[1], (template.label, at)


def test_places():
    n, found = Scanner((Template("x", "b a b"),)).scan(b"B a b A, b.b")
    assert n == 6 and found == [(0, 0, 3), (0, 2, 5)]


def test_awkward_rows(spark):
    found = licenses.find_licenses(awkward(spark, ["The MIT License"]), ["doc_id", "label"])
    rows = {r.doc_id: r for r in found.collect()}
    assert rows[1].n_words == rows[2].n_words == rows[3].n_words == 0 and rows[4].n_words == 30000
    assert [m.label for m in rows[100].matches] == ["mit"] and found.count() == 9
    assert licenses.find_licenses(empty(spark), ["doc_id"]).count() == 0


def test_bad_markup():
    for markup in ("<<beginOptional>>a<<endOptional>> b", "a <<beginOptional>> b", "a <<other>>", ""):
        with pytest.raises(ValueError):
            parse(markup)
