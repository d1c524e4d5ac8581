"""Thousands of rules over a whole population: constants sorted per feature, rules as bit sets per interval."""

from __future__ import annotations

import bisect
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType

from propensity_spark.operators.rules import (COMPARE, _as_number, _sides, column_types, condition, counts_per_rule,
                                              dpd_bucket)

#: Rules whose bit sets are one table; the tables of a block grow with its rules times its constants.
BLOCK = 2048
#: Rows whose bit sets are made at a time.
ROWS = 2048


@dataclass
class Side:
    """One side of a feature, its numbers or its text, or a single condition that only Spark can test.

    Sorted constants c0 < c1 < ... cut the side into classes: 2 i + 1 is the value c_i, 2 i what lies below it and
    above the one before. Then follow two classes: a value that is on the feature's other side, and NULL.
    both[class] has a bit per rule, set unless a condition of it fails there; some[class] one where a condition holds.
    """

    name: str
    constants: list
    both: np.ndarray
    some: np.ndarray

    def classes(self, values: pa.Array, missing: np.ndarray) -> np.ndarray:
        """The class of every value; a NULL value is on the other side, unless the feature is `missing`."""
        n = 2 * len(self.constants) + 1
        if pa.types.is_boolean(values.type):  # a single condition: false, true
            return np.asarray(values.fill_null(False)).astype(np.int64)
        if pa.types.is_floating(values.type):
            v, c = values.fill_null(0.0).to_numpy(zero_copy_only=False), np.array(self.constants, float)
            out = np.searchsorted(c, v, "left") + np.searchsorted(c, v, "right")
            out = np.where(np.isnan(v), n - 1, out)  # above everything, as Spark orders it
        else:
            coded = pc.dictionary_encode(values.fill_null(""))
            words = [w.encode() for w in coded.dictionary.to_pylist()]
            place = [bisect.bisect_left(self.constants, w) + bisect.bisect_right(self.constants, w) for w in words]
            out = np.array(place, np.int64)[coded.indices.to_numpy()]
        out = np.where(np.asarray(values.is_null()), n, out)
        return np.where(missing, n + 1, out)


def _holds(op: str, wanted, constants: list) -> np.ndarray:
    """In which classes a condition holds."""
    at = np.arange(2 * len(constants) + 3)
    inside = at < len(at) - 2
    if op == "in":
        return inside & np.isin(at, [2 * bisect.bisect_left(constants, w) + 1 for w in wanted])
    here = 2 * bisect.bisect_left(constants, wanted) + 1
    if op == "!=":  # of a value on the other side too
        return (at != here) & (at < len(at) - 1)
    return inside & COMPARE[op](at, here)


def _placed(types: dict[str, DataType], cond: dict) -> tuple[str, str, str, object] | None:
    """(kind, feature, operator, constants) of a condition that is the same throughout a class; None for others."""
    name, op, value = cond.get("feature"), cond.get("operator"), cond.get("value")
    if name not in types:
        return None
    if op == "in" and isinstance(value, (list, tuple)):
        numbers = [float(v) for v in value if isinstance(v, (bool, int, float))]
        texts = [v.encode() for v in value if isinstance(v, str)]
        if numbers and texts or not (numbers or texts) or any(map(math.isnan, numbers)):
            return None
        return ("number", name, op, numbers) if numbers else ("text", name, op, texts)
    if op not in COMPARE and op != "!=":
        return None
    wanted = _as_number(value)
    if wanted is None:
        return "text", name, op, str(value).encode()
    return None if math.isnan(wanted) else ("number", name, op, wanted)


def _block(types: dict[str, DataType], rules: list[dict], loose: dict[str, dict]) -> tuple:
    """(sides, bits of AND rules, bits of OR rules) of a block; `loose` collects conditions that Spark tests."""
    n = len(rules)
    found: dict[tuple[str, str], list[tuple[int, str, object]]] = {}
    kinds = np.zeros((2, n), bool)
    for i, rule in enumerate(rules):
        conds = rule["rule_config"].get("conditions") or []
        if conds:  # a rule without conditions matches nothing
            kinds[int(str(rule["rule_config"].get("logic", "AND")).upper() == "OR"), i] = True
        for cond in conds:
            place = _placed(types, cond)
            if place is None:
                key = repr(sorted(cond.items(), key=lambda x: x[0]))
                found.setdefault(("loose", key), []).append((i, "", None))
                loose[key] = cond
            else:
                found.setdefault(place[:2], []).append((i, place[2], place[3]))
    sides = []
    for (kind, name), uses in found.items():
        constants = sorted({c for _, op, w in uses if kind != "loose" for c in (w if op == "in" else [w])})
        classes = 2 if kind == "loose" else 2 * len(constants) + 3
        both, some = np.ones((classes, n), bool), np.zeros((classes, n), bool)
        known: dict = {}
        for i, op, wanted in uses:
            key = (op, tuple(wanted) if op == "in" else wanted)
            if key not in known:
                known[key] = np.array([False, True]) if kind == "loose" else _holds(op, wanted, constants)
            both[:, i] &= known[key]
            some[:, i] |= known[key]
        pack = lambda x: np.packbits(x, axis=-1, bitorder="little")
        sides.append((kind, Side(name, constants, pack(both), pack(some) if kinds[1].any() else some[:, :0])))
    return sides, *np.packbits(kinds, axis=-1, bitorder="little"), n


def evaluate_many(df: DataFrame, rules: list[dict], delay: str = "payment_delay_days") -> DataFrame:
    """evaluate_rules() for any number of rules: the same rows, with work per row that hardly grows with the rules.

    A row's value of a feature is turned into its class among the sorted constants of all rules once, by binary
    search; each class has a bit set of the rules whose conditions on that feature hold there. AND of the bit sets of
    all features, or OR for rules of logic OR, is the set of rules that match. Conditions that are no threshold, a
    substring test or a list of numbers and text, are columns Spark computes. Each task counts matches per rule and
    delay bucket; what is shuffled is rules x buckets. The tables that the workers hold grow with the rules, which are
    configuration, and are cut into blocks.
    """
    types = column_types(df)
    loose: dict[str, dict] = {}
    blocks = [_block(types, rules[i:i + BLOCK], loose) for i in range(0, len(rules), BLOCK)]
    columns: dict[tuple[str, str], Column] = {}
    for sides, *_ in blocks:
        for kind, side in sides:
            if kind == "loose":
                columns[kind, side.name] = condition(types, loose[side.name])
            else:
                pair = _sides(side.name, types[side.name])
                columns[kind, side.name] = pair[0] if kind == "number" else pair[1]
    features = list(dict.fromkeys(name for kind, name in columns if kind != "loose"))
    bucket = dpd_bucket(F.col(delay)) if delay in types else F.lit(-1)
    source = df.select(bucket.cast("int").alias("bucket"), *[c.alias(f"c{i}") for i, c in enumerate(columns.values())],
                       *[F.col(f).isNull().alias(f"m{i}") for i, f in enumerate(features)])
    at = {key: i + 1 for i, key in enumerate(columns)}
    gone = {f: i + 1 + len(columns) for i, f in enumerate(features)}
    sent = df.sparkSession.sparkContext.broadcast(blocks)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = [np.zeros((6, n), np.int64) for *_, n in sent.value]
        total = np.zeros(6, np.int64)
        for part in parts:
            for start in range(0, part.num_rows, ROWS):
                few = part.slice(start, ROWS)
                place = few.column(0).to_numpy() + 1  # -1 is a population without delays
                total += np.bincount(place, minlength=6)
                for (sides, every, any_, n), count in zip(sent.value, counts):
                    both = np.repeat(every[None, :], len(place), axis=0)
                    some = np.zeros_like(both) if any_.any() else None
                    for kind, side in sides:
                        missing = np.asarray(few.column(gone[side.name])) if kind != "loose" else np.False_
                        of = side.classes(few.column(at[kind, side.name]), missing)
                        both &= side.both[of]
                        if some is not None:
                            some |= side.some[of]
                    if some is not None:
                        both |= some & any_
                    for b in np.unique(place):
                        count[b] += np.unpackbits(both[place == b], axis=1, count=n, bitorder="little").sum(
                            axis=0, dtype=np.int64)
        rows = [(-1, b - 1, int(x)) for b, x in enumerate(total) if x]
        for i, count in enumerate(counts):
            rows += [(i * BLOCK + int(r), int(b) - 1, int(count[b, r])) for b, r in zip(*np.nonzero(count))]
        columns_ = list(zip(*rows)) if rows else [[], [], []]
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(columns_, (pa.int32(), pa.int32(), pa.int64()))], ["rule", "bucket", "count"])

    return counts_per_rule(source.mapInArrow(run, "rule int, bucket int, count bigint"), rules)
