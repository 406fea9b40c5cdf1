"""Licence texts inside longer documents, complete texts and copyright phrases; runs of lines against all runs."""

from __future__ import annotations

import random
from importlib.resources import files

import pytest

from foliospark.llm import license_scan as L

PROSE = "\n\n".join(f"The garden number {i} was quiet.\nNobody had watered plant {i} since spring {i * 7}." for i in range(80))
MIT = L.TEMPLATES["MIT"][-1]


def names(text):
    return {f[3] for f in L.Scanner(L.TEMPLATES, L.THRESHOLD).scan(text)}


def test_paragraphs_inside_a_document():
    a, b = MIT.index("The above copyright"), MIT.index("THE SOFTWARE IS")
    mit = f"{MIT[:a]}\n\n{MIT[a:b]}\n\n{MIT[b:]}"
    text = f"{PROSE}\n\n{mit}\n\n{PROSE}"
    assert names(text) == {"MIT"}
    (kind, start, end, _, score) = next(f for f in L.Scanner(L.TEMPLATES, L.THRESHOLD).scan(text) if f[0] == "run")
    assert score > 0.99 and text[start:end].strip() == mit.strip()


@pytest.mark.parametrize("name", sorted(f.name.removesuffix(".txt") for f in files("foliospark.llm").joinpath("licenses").iterdir()))
def test_complete_texts(name):
    text = files("foliospark.llm").joinpath("licenses", f"{name}.txt").read_text()
    assert name in names(text) and name in names(f"{PROSE}\n\n{text}\n\n{PROSE}")


@pytest.mark.parametrize("line", ["Copyright 2020 X. Licensed under the MIT License.", "Copyright (c) 2020 X Licensed under the MIT License."])
def test_rest_of_a_copyright_line(line):
    (found,) = L.Scanner(L.TEMPLATES, L.THRESHOLD).scan(f"Some text\n{line}\nMore")
    assert found[0] == "line" and found[3] == "MIT" and "Copyright" not in f"Some text\n{line}\nMore"[found[1] : found[2]]


def test_best_run_is_the_best_of_all_runs():
    templates = {"a": ["one two three four five six seven eight"], "b": ["six seven one three two nine"], "c": ["one two one three one four"]}
    scanner, rng = L.Scanner(templates, 0.45), random.Random(5)
    vocabulary = "one two three four five six seven eight nine".split()
    hits = 0
    for _ in range(400):
        lines = [[rng.choice(vocabulary)] * 1 + [rng.choice(vocabulary) for _ in range(rng.randint(0, 3))] for _ in range(rng.randint(2, 12))]
        want = max((found[1] for i in range(len(lines)) for j in range(i, len(lines)) if (found := scanner.best(L.bigrams(" ".join(w for x in lines[i : j + 1] for w in x))))), default=0)
        got = max((f[4] for f in scanner.scan("\n".join(map(" ".join, lines)))), default=0)
        assert got == pytest.approx(want)
        hits += want > 0
    assert hits > 50


@pytest.mark.parametrize("sentence, name", [("Licensed under the MIT License.", "MIT"), ("This work is licensed under the GNU General Public License, version 3.", "GPL-3.0"), ("Licensed under the Apache License, Version 2.0.", "Apache-2.0")])
def test_sentence_inside_a_long_line(sentence, name):
    line = f"The garden was quiet that day, and nobody had watered it. {sentence} Then it rained! And so on; it went."
    (found,) = L.Scanner(L.TEMPLATES, L.THRESHOLD).scan(line)
    assert found[0] == "sentence" and found[3] == name and line[found[1] : found[2]].strip() == sentence


def test_sentences_across_lines():
    a = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."
    b = L.TEMPLATES["ISC"][-1][L.TEMPLATES["ISC"][-1].index("THE SOFTWARE IS") :]
    text = f"It was late. {a}\n{b} And then the story went on, as stories do. {PROSE}"
    assert names(text) == {"ISC"}


def test_one_very_long_line():
    line = "The garden was quiet that day, and nobody had watered it. " * 20_000 + "Licensed under the MIT License."
    assert names(line) == {"MIT"}
