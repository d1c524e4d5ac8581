import random
import time

import pytest

from propensity_spark.llm import license, license_texts
from propensity_spark.llm.decontaminate import words
from tests.llm.test_license import KNOWN


@pytest.mark.parametrize("copies", [3, 50])
@pytest.mark.parametrize("between", [" ", " other "])
@pytest.mark.parametrize("name", sorted(license.NOTICES))
def test_a_notice_repeated_in_a_row_is_found_each_time(name, between, copies):
    body = words(("x y z " + between.join([license.NOTICES[name]] * copies) + " q r s t").encode())
    size, gap = len(words(license.NOTICES[name].encode())), len(between.split())
    want = [(name, 1.0, 3 + k * (size + gap), 3 + k * (size + gap) + size) for k in range(copies)]
    assert license.scan(body, KNOWN, license.COVERAGE) == want


ALL = license_texts.licenses()
TEMPLATES = license.templates(ALL)


def names(text):
    return [x[0] for x in license.scan(words(text.encode()), TEMPLATES, license.COVERAGE)]


def test_every_text_is_found_under_its_own_name():
    for name, texts in ALL.items():
        for text in texts:
            assert names(f"x y z {text} q r s") == [name], (name, text[:80])


def test_deciding_words():
    assert names("Licensed under CC BY 4.0") == ["CC-BY-4.0"]
    assert names("Licensed under CC BY-NC 9.0") == []
    assert names("GNU GENERAL PUBLIC LICENSE Version 3") == ["GPL-3.0"]
    assert names("This work is licensed under the GNU General Public License, version 2") == ["GPL-2.0"]
    assert names(license_texts.BSD.format("").replace("SUCH DAMAGE", "SUCH")) == ["BSD-2-Clause"]


def timed(text):
    start = time.process_time()
    got = license.scan(text, TEMPLATES, license.COVERAGE)
    return got, time.process_time() - start


def test_legal_prose_takes_time_in_proportion():
    """A megabyte of the words of licences in any order, no notice in it; then licences whole, in a row, and changed."""
    legal = [w for texts in ALL.values() for text in texts for w in words(text.encode())]
    rng = random.Random(1)
    text = rng.choices(legal, k=180_000)
    assert sum(map(len, text)) + len(text) > 1_000_000
    got, seconds = timed(text)
    assert got == [] or max(b - a for _, _, a, b in got) < 20
    assert seconds < 4
    gpl = words(max(ALL["GPL-3.0"], key=len).encode())
    assert len(gpl) > 4000
    got, seconds = timed(gpl + gpl)
    assert [(x[0], x[1]) for x in got] == [("GPL-3.0", 1.0)] * 2 and seconds < 4
    changed = [w if rng.random() > 0.05 else b"other" for w in gpl]
    got, seconds = timed(changed)  # a short notice inside may cover more, and then it is what stays
    assert {x[0] for x in got} == {"GPL-3.0"} and seconds < 2
    (name, share, a, b), = license.scan(changed, [t for t in TEMPLATES if t.words == gpl], license.COVERAGE)
    assert (name, a, b) == ("GPL-3.0", 0, len(gpl)) and 0.9 < share < 1
