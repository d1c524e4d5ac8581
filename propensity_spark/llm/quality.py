"""Quality classifier learned from trusted positives and unlabelled text (non-negative PU learning)."""

from __future__ import annotations

import math
import zlib
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType, IntegerType, StructField

from propensity_spark.llm.common import fold, free_name, map_texts

#: At most so many trusted positives, and as many unlabelled texts, are learned from: those whose ids hash lowest.
SAMPLE = 20_000
#: Parts of the sample of which each is scored by a model of the others when the prior is estimated.
PARTS = 4
#: Rows of each kind in a step; the sign of the risk's second part is not to depend on a few.
BATCH = 2048
MARKS = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
SMALL = 1e-4


def features(text: bytes) -> list[float]:
    """Shares and ratios of a text's characters, words and lines; no word, id or label is looked at.

    An empty text has zeros. Shares enter as logarithms over SMALL, so that a few foreign marks in a long text and a
    text full of them are both told from none.
    """
    counts = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    size = max(1, len(text))
    upper, lower, digits = counts[65:91].sum(), counts[97:123].sum(), counts[48:58].sum()
    words, lines = text.split(), text.split(b"\n")
    n = max(1, len(words))
    kinds, line_kinds = len(set(words)), len(set(lines))
    same = sum(a == b for a, b in zip(words, words[1:])) if kinds < len(words) else 0
    same_lines = sum(a == b for a, b in zip(lines, lines[1:])) if line_kinds < len(lines) else 0
    ends = [w[-1:] for w in words]
    marks = sum(not (e.isalnum() or e >= b"\x80") for e in ends)
    shares = [
        upper / max(1, upper + lower), lower / size, digits / size, counts[128:].sum() / size,
        (counts[9:14].sum() + counts[32]) / size, counts[10] / size, counts[:9].sum() / size,
        1 - kinds / n, same / n, 1 - line_kinds / len(lines), same_lines / len(lines), marks / n,
        sum(w.isupper() and len(w) > 1 for w in words) / n, sum(w.istitle() for w in words) / n,
        sum(len(w) == 1 for w in words) / n, sum(len(w) > 15 for w in words) / n,
        *(counts[m] / size for m in MARKS),
    ]
    scaled = [math.log((s + SMALL) / SMALL) for s in map(float, shares)]
    return [*scaled, math.log1p(len(text)), math.log1p(len(words)), math.log1p(len(lines)), len(text) / n / 10]


N_FEATURES = len(features(b""))


@dataclass
class Model:
    """score = sigmoid of a network with one hidden layer over standardised features."""

    mean: np.ndarray
    scale: np.ndarray
    weights: list[np.ndarray]
    prior: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        a, b, c, d = self.weights
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        return np.tanh(z @ a + b) @ c + d

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -40, 40)))


def _fit(p: np.ndarray, u: np.ndarray, prior: float | None, steps: int, seed: int) -> Model:
    """Minimise the PU risk by Adam; prior None learns to tell p from u instead (logistic regression on a balance).

    With the sigmoid loss l(f) = sigmoid(-f), positives P, unlabelled U and prior q the risk is
    q E_P[l(f)] + max(0, E_U[l(-f)] - q E_P[l(-f)]). Where a step's second part is below zero, the gradient of its
    negative is followed alone (Kiryo et al. 2017), which takes back over-fitting. The loss is bounded, so a small
    error of the prior does not outweigh the negatives as margins grow.
    """
    rng = np.random.default_rng(seed)
    both = np.vstack([p, u])
    mean, scale = both.mean(0), both.std(0) + 0.3
    hidden, decay = 16, 1.5 / len(p)  # the fewer examples, the smaller the weights
    w = [rng.normal(0, 1 / math.sqrt(N_FEATURES), (N_FEATURES, hidden)), np.zeros(hidden),
         rng.normal(0, 1 / math.sqrt(hidden), hidden), np.zeros(())]
    model = Model(mean, scale, w, prior or 0.5)
    m, v = [np.zeros_like(x) for x in w], [np.zeros_like(x) for x in w]
    zp, zu = (np.clip((x - mean) / scale, -8, 8) for x in (p, u))
    sigmoid = lambda x: 1 / (1 + np.exp(-np.clip(x, -40, 40)))
    for step in range(1, steps + 1):
        bp, bu = (z if len(z) <= BATCH else z[rng.integers(0, len(z), BATCH)] for z in (zp, zu))
        hp, hu = np.tanh(bp @ w[0] + w[1]), np.tanh(bu @ w[0] + w[1])
        fp, fu = hp @ w[2] + w[3], hu @ w[2] + w[3]
        sp, su = sigmoid(fp), sigmoid(fu)
        if prior is None:  # logistic loss
            gp, gu = (sp - 1) / len(fp), su / len(fu)
        else:  # l(f) = sigmoid(-f): derivatives of l(f) and of l(-f) differ in sign alone
            dp, du = sp * (1 - sp) / len(fp), su * (1 - su) / len(fu)
            negative = su.mean() - prior * sp.mean()
            gp, gu = (-2 * prior * dp, du) if negative >= 0 else (prior * dp, -du)
        grads = [np.zeros_like(x) for x in w]
        for z, h, g in ((bp, hp, gp), (bu, hu, gu)):
            back = np.outer(g, w[2]) * (1 - h * h)
            for i, x in enumerate((z.T @ back, back.sum(0), h.T @ g, g.sum())):
                grads[i] = grads[i] + x
        rate = 0.01 * (1 - step / (steps + 1))
        for i in range(4):
            g = grads[i] + (decay * w[i] if i in (0, 2) else 0)
            m[i] = 0.9 * m[i] + 0.1 * g
            v[i] = 0.999 * v[i] + 0.001 * g * g
            w[i] = w[i] - rate * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)
    return model


def estimate_prior(p: np.ndarray, u: np.ndarray, part_p: np.ndarray, part_u: np.ndarray, seed: int = 7) -> float:
    """The share of positives in u: least ratio of u's to p's share above a limit of a score that tells p from u.

    Every part is scored by a model of the other parts; a document that is in p and in u must be in the same part, as
    else its copy in u would look more like p than it is. The limits are quantiles of p's scores in the part, the
    shares are means over the parts, and a bound on their error is added when the limit is chosen, so that thin tails
    do not decide (best-bin estimation).
    """
    above_p, above_u = [], []
    for part in np.unique(part_p):
        rest_p, rest_u, own_p, own_u = p[part_p != part], u[part_u != part], p[part_p == part], u[part_u == part]
        if min(map(len, (rest_p, rest_u, own_u))):
            model = _fit(rest_p, rest_u, None, 300, seed)
            a, b = np.sort(model.margin(own_p)), np.sort(model.margin(own_u))
            limits = np.quantile(a, np.linspace(0, 0.9, 91))
            above_p.append(len(a) - np.searchsorted(a, limits))
            above_u.append((len(b) - np.searchsorted(b, limits)) / len(b) * len(a))
    if not above_p:
        return 0.5
    n = sum(x[0] for x in above_p)
    share_p, share_u = np.sum(above_p, 0) / n, np.sum(above_u, 0) / n
    error = math.sqrt(math.log(40) / (2 * len(p))) + math.sqrt(math.log(40) / (2 * len(u)))
    best = np.argmin((share_u + error) / share_p)
    return float(np.clip(share_u[best] / share_p[best], 0.05, 0.99))


def train(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", sample: int = SAMPLE,
          steps: int = 1500, seed: int = 7) -> Model | None:
    """Learn from documents outside the held-out fold; None if there is no trusted positive or nothing unlabelled.

    Trusted positives are documents whose label rows all say 1; unlabelled text is any document of the learning
    folds, its label unseen. Of each, the `sample` ids whose hash is lowest are used, at most that many: only their
    ids, then their features, meet the driver. The choice reads ids alone and the features of the chosen alone. Of rows
    that share an id one counts, the one with the least features, so 2 * sample bounds the rows as well.
    """
    ids = docs.select(F.col(doc_id).alias("id")).where(fold(doc_id) != 0).distinct()
    good = labels.where((fold("doc_id") != 0) & F.col("quality").isNotNull())
    good = good.groupBy(F.col("doc_id").alias("id")).agg(F.min("quality").alias("least")).where("least = 1")
    trusted = _lowest(ids.join(good, "id", "left_semi"), 1, sample)
    chosen = trusted.select("id", F.lit(True).alias("positive")).unionByName(
        _lowest(ids, 2, sample).select("id", F.lit(False).alias("positive")))
    key = free_name("positive", docs.columns)
    bounded = F.broadcast(chosen.select("id", F.col("positive").alias(key)))  # 2 * sample ids at most
    wanted = docs.select(F.col(doc_id).alias("id"), text).join(bounded, "id").select("id", text, key)
    rows = map_texts(wanted, ["id", key], text, lambda texts: [_feature_lists(texts)], [_vector()])
    rows = rows.groupBy("id", key).agg(F.min("_features").alias("_features"))  # an id is one row, however often it comes
    rows = rows.toPandas().sort_values(["id", key], kind="stable")
    if not len(rows):
        return None
    x, positive = np.vstack(rows["_features"].to_numpy()).astype(float), rows[key].to_numpy(bool)
    p, u = x[positive], x[~positive]
    if len(p) < 2 or len(u) < 2:
        return None
    part = np.array([zlib.crc32(str(i).encode()) // 5 % PARTS for i in rows["id"]])
    return _fit(p, u, estimate_prior(p, u, part[positive], part[~positive], seed), steps, seed)


def _lowest(ids: DataFrame, salt: int, sample: int) -> DataFrame:
    """The `sample` ids whose hash is lowest.

    Ids are first counted by the leading 16 bits of the hash, and those beyond the range that holds the last id wanted
    are left out; so what is ordered is the sample and a 65536th of the ids, and not `sample` ids of every task.
    """
    order = F.xxhash64("id", F.lit(salt))
    leading = F.shiftright(order, 48)  # keeps the sign, so ranges are in the order of the hash
    counts = sorted(ids.groupBy(leading.alias("range")).count().collect())  # at most 65536 rows
    if counts:
        reach = np.searchsorted(np.cumsum([n for _, n in counts]), sample)
        ids = ids.where(leading <= counts[min(int(reach), len(counts) - 1)][0])
    return ids.orderBy(order, "id").limit(sample)


def _vector() -> StructField:
    from pyspark.sql.types import ArrayType

    return StructField("_features", ArrayType(FloatType()))


def _feature_lists(texts: list[bytes]) -> list[list[float]]:
    return [features(t) for t in texts]


def classify(
    docs: DataFrame, model: Model | None, keep: list[str], text: str = "text", score: str = "score",
    predicted: str = "predicted", limit: float = 0.3,
) -> DataFrame:
    """The columns `keep`, the score (0 to 1) and predicted (1 if score >= limit) of every whole text.

    One pass, no shuffle. NULL and empty texts are scored as empty. Without a model every score is 0.5. Repeated rows
    get equal scores.
    """

    def run(texts: list[bytes]) -> list:
        if model is None or not texts:
            scores = np.full(len(texts), 0.5)
        else:
            # Rounded, since the last bits of a matrix product depend on how many texts come together.
            scores = model.score(np.array(_feature_lists(texts), np.float32).astype(float)).round(9)
        return [scores, (scores >= limit).astype(np.int32)]

    return map_texts(docs, keep, text, run, [StructField(score, DoubleType()), StructField(predicted, IntegerType())])
