"""License notices found by patience alignment."""

from __future__ import annotations

import bisect
from collections import Counter, defaultdict
from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, DoubleType, LongType, StringType, StructField, StructType

from propensity_spark.llm.common import map_texts
from propensity_spark.llm.decontaminate import words

#: Short notices by the licence they name. The whole texts are in license_texts.py.
NOTICES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3",
    "MIT": "Released under the MIT License",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
}
#: A notice is found if the alignment covers this share of its words.
COVERAGE = 0.8
#: A band of starts is this many cells and one more.
BAND = 5
#: From so many words on a template is looked for by its pairs of words.
PAIRED = 30
FOUND = ArrayType(StructType([
    StructField("license", StringType()), StructField("coverage", DoubleType()),
    StructField("start", LongType()), StructField("end", LongType())]))


def unique_anchors(a: list, b: list) -> list[tuple[int, int]]:
    """Places of words that occur once in a and once in b, in the order of a."""
    in_a, in_b = Counter(a), Counter(b)
    at = {w: j for j, w in enumerate(b) if in_b[w] == 1}
    return [(i, at[w]) for i, w in enumerate(a) if in_a[w] == 1 and w in at]


def longest_increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest run of pairs, ascending in the first place, that ascends in the second (patience sorting)."""
    tops: list[int] = []
    last: list[int] = []
    before: list[int] = []
    for k, (_, j) in enumerate(pairs):
        pile = bisect.bisect_left(tops, j)
        before.append(last[pile - 1] if pile else -1)
        if pile == len(tops):
            tops.append(j)
            last.append(k)
        else:
            tops[pile], last[pile] = j, k
    out, k = [], last[-1] if last else -1
    while k >= 0:
        out.append(pairs[k])
        k = before[k]
    return out[::-1]


def align(a: list, b: list, i: int = 0, j: int = 0) -> list[tuple[int, int]]:
    """Matched places of a and b: equal ends, then anchors, then the same again in the gaps between the anchors."""
    head = 0
    while head < min(len(a), len(b)) and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < min(len(a), len(b)) - head and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    out = [(i + k, j + k) for k in range(head)]
    x, y = a[head:len(a) - tail], b[head:len(b) - tail]
    if x and y:
        p, q = 0, 0
        anchors = longest_increasing(unique_anchors(x, y))
        for m, n in [*anchors, (len(x), len(y))] if anchors else []:
            out += align(x[p:m], y[q:n], i + head + p, j + head + q)
            if m < len(x):
                out.append((i + head + m, j + head + n))
            p, q = m + 1, n + 1
    return out + [(i + len(a) - tail + k, j + len(b) - tail + k) for k in range(tail)]


@dataclass
class Template:
    name: str
    words: list[bytes]
    kinds: frozenset
    places: dict[bytes, list[int]]
    deciding: list[frozenset]  # for each near variant, the places of the words it lacks


def templates(notices: dict[str, str | list[str]], coverage: float = COVERAGE) -> list[Template]:
    """The templates of the notices, one or several for a name.

    Another licence's template that covers enough of one is its near variant: the words that it lacks decide.
    """
    out = []
    texts = [(name, x) for name, some in notices.items() for x in ([some] if isinstance(some, str) else some)]
    for name, text in sorted(set(texts)):
        w = words(text.encode())
        places: dict[bytes, list[int]] = {}
        for k, x in enumerate(w):
            places.setdefault(x, []).append(k)
        if w:
            out.append(Template(name, w, frozenset(w), places, []))
    counts = [Counter(t.words) for t in out]
    for t, have in zip(out, counts):
        need = coverage * len(t.words)
        for other, there in zip(out, counts):
            if other.name != t.name and sum((have & there).values()) >= need:
                lacks = frozenset(range(len(t.words))) - {i for i, _ in align(t.words, other.words)}
                if lacks and len(t.words) - len(lacks) >= need and lacks not in t.deciding:
                    t.deciding.append(lacks)
    return out


def drifts(missing: int) -> list[tuple[int, int]]:
    """Words by which a window is longer than a template, before and after it: none, then up to those missing."""
    steps = sorted({min(1 << k, missing) for k in range(missing.bit_length())})
    return [(0, 0), *[x for d in steps for x in ((d, 0), (0, d), (0, -d))]]


Places = dict[object, np.ndarray]


def places_of(items: Iterable) -> Places:
    """Where each of the items stands."""
    lists: dict[object, list[int]] = defaultdict(list)
    for i, x in enumerate(items):
        lists[x].append(i)
    return {x: np.array(at) for x, at in lists.items()}


def likely_starts(t: Template, words_at: Places, pairs_at: Places, n: int, missing: int):
    """Where t may start in a text of n words with at most `missing` of its words missing, the most voted first; and
    all votes, as starts in order and the places in t that voted.

    Every two words in a row of the template vote, each at all of their places in the text, for the start that would
    put them there. A missing word spoils two pairs and one put in spoils one, so a notice with less than a third of
    its size put in still has a known share of the pairs within a third of its size of each other. In templates of a
    few words the rarest words vote instead, more than can be missing. Bands of starts with votes of too few different
    places are dropped; what is left are notices and little else, however many words of a licence a text has.
    """
    size = len(t.words)
    if size >= PAIRED:
        asked = [(pairs_at.get(pair), k) for k, pair in enumerate(zip(t.words, t.words[1:]))]
        total, least = size - 1, size - 1 - 2 * missing - size // 3
    else:
        chosen: list[int] = []
        for w in sorted(t.kinds, key=lambda w: (len(words_at.get(w, ())), w)):
            if len(chosen) > 2.5 * missing:
                break
            chosen += t.places[w]
        asked = [(words_at.get(t.words[p]), p) for p in chosen]
        total, least = len(chosen), len(chosen) - missing
    votes = [(at - p, k) for k, (at, p) in enumerate(asked) if at is not None]
    if len(votes) < least:
        return [], np.zeros(0, int), np.zeros(0, int)
    starts = np.concatenate([v for v, _ in votes])
    voter = np.repeat([k for _, k in votes], [len(v) for v, _ in votes])
    width = (size // 3 + 2) // 4 + 1
    cell = (starts + size) // width
    hit = np.zeros(((n + size) // width + 1 + BAND, total), bool)
    hit[cell, voter] = True
    band = hit[:len(hit) - BAND].copy()
    for k in range(1, BAND + 1):
        band |= hit[k:len(hit) - BAND + k]
    good = np.zeros(len(hit), bool)
    for first in np.flatnonzero(band.sum(axis=1) >= least):
        good[first:first + BAND + 1] = True
    found, times = np.unique(starts[good[cell]], return_counts=True)
    order = np.argsort(starts, kind="stable")
    return found[np.lexsort((found, -times))].tolist(), starts[order], voter[order]


def scan(text: list[bytes], known: list[Template], coverage: float) -> list[tuple[str, float, int, int]]:
    """(license, coverage, start, end) of every notice: ranges of words, in order of start, then name.

    A notice that is covered holds a share of the template's pairs of words, one after another (likely_starts); around
    such a place a window, half as long again as the template, is aligned. Where that gives no notice in a row, windows
    of the template's size too, and some words longer or shorter, so a notice that is repeated in a row is found each
    time; a notice with words put in is found as long as they are fewer than a third of it. Of the words that a near
    variant lacks the same share must be matched. Of finds that overlap, of one template or of several that are alike,
    the one with the highest coverage stays, then the longest.
    """
    have, finds = Counter(text), set()
    words_at = pairs_at = None

    def add(t: Template, low: int, matched: list[tuple[int, int]]) -> None:
        at = {i for i, _ in matched}
        if all(len(x & at) >= coverage * len(x) for x in t.deciding):
            finds.add((t.name, len(matched) / len(t.words), low + matched[0][1], low + matched[-1][1] + 1, len(matched)))

    for t in known:
        size, need = len(t.words), coverage * len(t.words)
        if len(text) < need or sum(min(len(t.places[w]), have[w]) for w in t.kinds if w in have) < need:
            continue
        if words_at is None:
            words_at = places_of(text)
        if pairs_at is None and size >= PAIRED:
            pairs_at = places_of(zip(text, text[1:]))
        missing = int(size - need)
        copies: list[int] = []  # starts of notices found in a row, sorted; another copy is a template's size away
        slack = size // 2 + 2
        tried: list[int] = []
        likely, voted, voter = likely_starts(t, words_at, pairs_at, len(text), missing)
        for start in likely:
            at = bisect.bisect(copies, start)
            if any(abs(x - start) <= size // 2 for x in copies[max(0, at - 1):at + 1]):
                continue
            at = bisect.bisect(tried, start)
            if any(abs(x - start) <= size // (4 if size >= PAIRED else 8) for x in tried[max(0, at - 1):at + 1]):
                continue  # the slack around that start covers this one
            tried.insert(at, start)
            low = max(0, start - slack)
            window = text[low:max(0, start + size + slack)]
            matched = align(t.words, window)
            if matched and len(matched) >= need:
                add(t, low, matched)
                if matched[-1][1] + 1 - matched[0][1] <= size + missing // 4:
                    bisect.insort(copies, low + matched[0][1] - matched[0][0])
                    continue
            # Neighbouring copies hide the anchors: without slack, then by few words.
            if size >= PAIRED:  # a copy that drifts by no more than may be missing has these pairs about its start
                near = slice(*np.searchsorted(voted, [start - missing, start + missing + 1]))
                if len(np.unique(voter[near])) < size - 1 - 3 * missing:
                    continue
            inside = Counter(window)
            if sum(min(len(t.places[w]), inside[w]) for w in t.kinds) >= need:
                for before, after in drifts(missing):
                    low = max(0, start - before)
                    matched = align(t.words, text[low:max(0, start + size + after)])
                    if matched and len(matched) >= need:
                        add(t, low, matched)
                    if len(matched) == size == matched[-1][1] + 1 - matched[0][1]:
                        bisect.insort(copies, low + matched[0][1])
                        break
    out: list[tuple[str, float, int, int]] = []
    taken: list[tuple[int, int]] = []  # disjoint ranges, sorted
    for name, share, first, last, _ in sorted(finds, key=lambda x: (-x[1], -x[4], x[3] - x[2], x[2], x[0])):
        at = bisect.bisect(taken, (first, last))
        if (not at or taken[at - 1][1] <= first) and (at == len(taken) or last <= taken[at][0]):
            taken.insert(at, (first, last))
            out.append((name, share, first, last))
    return sorted(out, key=lambda x: (x[2], x[0], x[3]))


def license_scan(docs: DataFrame, keep: list[str], text: str = "text", notices: dict[str, str | list[str]] = NOTICES,
                 coverage: float = COVERAGE, names: tuple[str, str] = ("n_words", "licenses")) -> DataFrame:
    """The columns `keep`, n_words and `licenses` (or these under other `names`): every notice with its coverage and its
    range of words.

    Words are runs of ASCII digits and letters, lower-cased, and other than ASCII characters. One pass over whole
    texts, no shuffle; NULL and empty texts have no notice; repeated rows are scanned alike. The time for a text grows
    with its length, legal prose included, and memory is a few times the text.
    """
    known = templates(notices, coverage)

    def run(texts: list[bytes]) -> list:
        split = [words(t) for t in texts]
        found = [[dict(zip(("license", "coverage", "start", "end"), x)) for x in scan(w, known, coverage)]
                 for w in split]
        from pyspark.sql.pandas.types import to_arrow_type

        return [[len(w) for w in split], pa.array(found, to_arrow_type(FOUND))]

    return map_texts(docs, keep, text, run, [StructField(names[0], LongType()), StructField(names[1], FOUND)])
