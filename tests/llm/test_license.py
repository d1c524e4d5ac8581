from hypothesis import given, settings
from hypothesis import strategies as st

from propensity_spark.llm import license
from propensity_spark.llm.decontaminate import words

ROWS = st.lists(st.sampled_from("abcdef"), max_size=14)


def longest(pairs):
    best = [1] * len(pairs)
    for k, (_, j) in enumerate(pairs):
        best[k] = 1 + max([best[m] for m in range(k) if pairs[m][1] < j], default=0)
    return max(best, default=0)


@given(st.permutations(range(9)))
def test_longest_increasing(order):
    pairs = list(enumerate(order))
    got = license.longest_increasing(pairs)
    assert len(got) == longest(pairs)
    assert all(a[0] < b[0] and a[1] < b[1] for a, b in zip(got, got[1:]))


@settings(deadline=None)
@given(ROWS, ROWS)
def test_alignment_matches_equal_words_in_order(a, b):
    got = license.align(a, b)
    assert all(a[i] == b[j] for i, j in got)
    assert all(x[0] < y[0] and x[1] < y[1] for x, y in zip(got, got[1:]))
    anchors = license.longest_increasing(license.unique_anchors(a, b))
    assert len(got) >= (len(anchors) > 0)
    assert license.align(a, a) == [(i, i) for i in range(len(a))]


KNOWN = license.templates(license.NOTICES)


def found(text):
    return [(name, text_words[a:b]) for text_words in [words(text.encode())]
            for name, _, a, b in license.scan(text_words, KNOWN, license.COVERAGE)]


def test_every_notice_is_found_wherever_it_stands():
    for name, notice in license.NOTICES.items():
        for text in (notice, f"the this {notice} of the work is licensed", f"x {notice.upper()}.\ny", f"{notice}\n{notice}"):
            got = found(text)
            assert [n for n, _ in got] == [name] * (2 if "\n" + notice in text else 1), (text, got)
            assert all(w == words(notice.encode()) for _, w in got)


def test_changed_and_foreign_notices():
    assert [n for n, _ in found("Licensed under the new Apache License, Version 2.0")] == ["Apache-2.0"]
    assert [n for n, _ in found("Licensed under the Apache License, Version two")] == []
    assert found("a licensed work under a public sky, version 3") == []
    assert found("") == []


def test_long_template():
    text = " ".join(f"w{i % 40} v{i}" for i in range(300))
    known = license.templates({"long": text})
    body = words(f"the w1 {text[:700]} extra {text[700:]} w2 w3".encode())
    (name, share, a, b), = license.scan(body, known, 0.8)
    assert name == "long" and share == 1.0 and (a, b) == (2, 2 + 601)


def test_odd_rows(odd_docs, no_docs):
    got = license.license_scan(odd_docs, ["doc_id", "text"]).collect()
    assert len(got) == odd_docs.count() and all(r["licenses"] == [] for r in got)
    assert license.license_scan(no_docs, ["doc_id"]).count() == 0


def brute(text, known, coverage):
    """Finds from all places: a window of the template's size at every word, no votes, no bands."""
    finds = set()
    for t in known:
        size = len(t.words)
        for start in range(len(text)):
            matched = license.align(t.words, text[start:start + size])
            at = {i for i, _ in matched}
            if matched and len(matched) >= coverage * size and all(len(x & at) >= coverage * len(x) for x in t.deciding):
                finds.add((t.name, len(matched) / size, start + matched[0][1], start + matched[-1][1] + 1, len(matched)))
    out, taken = [], []
    for name, share, a, b, _ in sorted(finds, key=lambda x: (-x[1], -x[4], x[3] - x[2], x[2], x[0])):
        if all(b <= c or d <= a for c, d in taken):
            taken.append((a, b))
            out.append((name, share, a, b))
    return sorted(out, key=lambda x: (x[2], x[0], x[3]))


PIECES = st.one_of(st.sampled_from(sorted(license.NOTICES.values())), st.lists(st.sampled_from(
    "the a licensed under license version gpl foo bar x".split()), min_size=1, max_size=6).map(" ".join))


@settings(deadline=None, max_examples=150)
@given(st.lists(PIECES, max_size=6))
def test_scan_equals_all_windows(pieces):
    """Notices among other words: the same names at the same places as from windows at every word."""
    text = words(" ".join(pieces).encode())
    got = license.scan(text, KNOWN, license.COVERAGE)
    want = brute(text, KNOWN, license.COVERAGE)
    exact = [x for x in want if x[1] == 1.0]
    assert [x for x in got if x[1] == 1.0] == exact
    for name, share, a, b in want:  # what is not whole overlaps a find that covers as much
        assert any(c < b and a < d and s >= share for _, s, c, d in got), (name, share, a, b, got)


def test_clashing_names(odd_docs):
    got = license.license_scan(odd_docs.withColumn("licenses", odd_docs["text"]), ["doc_id", "n_words", "licenses"],
                               names=("words", "found"))
    assert got.columns == ["doc_id", "n_words", "licenses", "words", "found"]
    assert {r["n_words"] for r in got.collect()} == {"clash"}
