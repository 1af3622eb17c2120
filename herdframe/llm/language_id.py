"""Hierarchical language identification: the family first, then one-versus-one linear SVMs within it.

Features are the shares of hashed letter n-grams of a text (one to three bytes of UTF-8, A-Z
and the accented Latin-1 capitals lower-cased, what isn't a letter as a space). Training
takes PER_LANGUAGE distinct labelled texts of each language at most, picked by a hash of the text;
their features are made by Spark tasks and the support vector machines, small linear models,
are fitted on the driver. A language that isn't in the table of families is a family itself.

score is the probability of the family times that of the language in it, by logistic curves
fitted to the machines' margins. A null text and one without a letter is `und` with score 0,
and so is every text if nothing was learnt.

score only compares learnt languages, so junk and other languages have high ones too. Whether
a text is like its language at all tells the mean log share of its n-grams in that language's
labelled texts. It is known if that is at least what separates the labelled texts of the language
from those of other languages (the middle of both means, or less if over OUTLIERS of its own
lie below), less DEVIATIONS standard deviations of a text of its length, and if what isn't a
letter has at most twice the share that the language's texts have in the mean, with the same slack.
"""

import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from herdframe.llm.common import constant, flat, slices, tidied

#: Labelled texts of a language that training takes at most, hashed features, texts in one matrix.
PER_LANGUAGE, FEATURES, ROWS = 500, 4096, 512
#: Bytes of text in one pass over arrays.
PASS = 1 << 20
#: The share of labelled texts that may be unlike their language; deviations of slack.
OUTLIERS, DEVIATIONS = 0.005, 2.0
ORDERS = (1, 2, 3)
UNKNOWN = "und"
#: Families of languages, by ISO 639-1 code.
FAMILIES = {
    "germanic": ["af", "da", "de", "en", "is", "lb", "nb", "nl", "nn", "no", "sv"],
    "romance": ["ca", "es", "fr", "gl", "it", "oc", "pt", "ro"],
    "slavic": ["be", "bg", "bs", "cs", "hr", "mk", "pl", "ru", "sk", "sl", "sr", "uk"],
    "uralic": ["et", "fi", "hu"],
    "turkic": ["az", "kk", "tr", "uz"],
    "indic": ["bn", "gu", "hi", "mr", "ne", "pa", "ur"],
    "semitic": ["am", "ar", "he", "mt"],
    "sinitic": ["zh"],
}
_FAMILY = {code: family for family, codes in FAMILIES.items() for code in codes}

_LETTER = np.full(256, 32, np.uint8)
_LETTER[65:91] = np.arange(97, 123)
_LETTER[97:123] = np.arange(97, 123)
_LETTER[128:] = np.arange(128, 256)
#: The feature of a single byte that isn't a letter.
_BLANK = ((32 * 2654435761 + 40503) % (1 << 32)) >> 20


def frequencies(texts: pa.Array) -> np.ndarray:
    """A row of shares of hashed n-grams for each text."""
    raw, at = flat(texts)
    n = len(texts)
    if not len(raw):
        return np.zeros((n, FEATURES), np.float32)
    low = _LETTER[raw]
    accented = np.append(False, raw[:-1] == 0xC3) & (raw >= 0x80) & (raw <= 0x9E) & (raw != 0x97)
    low[accented] += 32
    counts = np.zeros(n * FEATURES, np.int64)
    for start in range(0, len(low), PASS):  # each pass has the n-grams that begin in it
        part = low[start : start + PASS + max(ORDERS) - 1]
        owner = (np.searchsorted(at, np.arange(start, start + len(part)), side="right") - 1) * FEATURES
        code = np.zeros(len(part), np.uint32)
        for k in range(1, max(ORDERS) + 1):
            code = code[: len(part) - k + 1] * np.uint32(256) + part[k - 1 :]
            own = min(len(code), PASS)
            if k in ORDERS and own:
                same = owner[:own] == owner[k - 1 : k - 1 + own]
                spot = ((code[:own] * np.uint32(2654435761) + np.uint32(k * 40503)) >> np.uint32(20)) & np.uint32(FEATURES - 1)
                counts += np.bincount((owner[:own] + spot)[same], minlength=n * FEATURES)
    shares = counts.reshape(n, FEATURES).astype(np.float32)
    return np.sqrt(shares / np.maximum(shares.sum(1, keepdims=True), 1))


@dataclass
class Machine:
    """A linear support vector machine and the logistic curve over its margin."""

    weights: np.ndarray
    bias: float
    slope: float
    offset: float

    @staticmethod
    def fit(x: np.ndarray, positive: np.ndarray, steps: int = 300, penalty: float = 1e-3) -> "Machine":
        """Squared hinge loss with balanced classes, by accelerated gradient steps."""
        y = np.where(positive, 1.0, -1.0).astype(np.float32)
        share = np.where(positive, 0.5 / max(1, positive.sum()), 0.5 / max(1, (~positive).sum())).astype(np.float32)
        mean = share @ x
        scale = 1 / np.sqrt(share @ (x - mean) ** 2 + 1e-4)
        z = (x - mean) * scale
        w, b = np.zeros(z.shape[1], np.float32), np.float32(0)
        v, c, t = w, b, 1.0
        top = np.ones(z.shape[1], np.float32)
        for _ in range(12):  # the largest curvature
            top = z.T @ (share * (z @ top))
            norm = float(np.linalg.norm(top))
            top = top / max(norm, 1e-12)
        rate = np.float32(1 / (2 * (norm + 1) + penalty))
        for _ in range(steps):
            slack = np.maximum(0, 1 - y * (z @ v + c))
            pull = -2 * share * y * slack
            new_w, new_b = v - rate * (z.T @ pull + penalty * v), c - rate * pull.sum()
            after = (1 + (1 + 4 * t * t) ** 0.5) / 2
            v, c = new_w + (t - 1) / after * (new_w - w), new_b + (t - 1) / after * (new_b - b)
            w, b, t = new_w, new_b, after
        weights = w * scale
        bias = float(b - mean @ weights)
        margin = (x @ weights + bias).astype(np.float64)
        target = np.where(positive, (positive.sum() + 1) / (positive.sum() + 2), 1 / ((~positive).sum() + 2))
        slope, offset = 1.0, 0.0
        for _ in range(25):  # Newton steps for the logistic curve
            p = 1 / (1 + np.exp(-np.clip(slope * margin + offset, -30, 30)))
            g, h = (p - target) * share, np.maximum(p * (1 - p), 1e-6) * share
            hess = np.array([[h @ margin**2 + 1e-6, h @ margin], [h @ margin, h.sum() + 1e-6]])
            step = np.linalg.solve(hess, [g @ margin, g.sum()])
            slope, offset = slope - float(np.clip(step[0], -2, 2)), offset - float(np.clip(step[1], -2, 2))
        return Machine(weights, bias, max(slope, 1e-3), offset)

    def probability(self, x: np.ndarray) -> np.ndarray:
        margin = (x @ self.weights + self.bias).astype(np.float64)
        return 1 / (1 + np.exp(-np.clip(self.slope * margin + self.offset, -30, 30)))


@dataclass
class OneVersusOne:
    """A machine for each pair of classes; the class with most wins, then with the largest probability, is taken."""

    classes: list[str]
    machines: dict[tuple[int, int], Machine] = field(default_factory=dict)

    @staticmethod
    def fit(x: np.ndarray, labels: np.ndarray) -> "OneVersusOne":
        out = OneVersusOne(sorted(set(labels.tolist())))
        for i, j in combinations(range(len(out.classes)), 2):
            own = (labels == out.classes[i]) | (labels == out.classes[j])
            out.machines[i, j] = Machine.fit(x[own], labels[own] == out.classes[i])
        return out

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the classes and their probabilities: a class's mean over its pairs."""
        n, m = len(x), len(self.classes)
        if m == 1:
            return np.zeros(n, int), np.ones(n)
        wins, total = np.zeros((n, m)), np.zeros((n, m))
        for (i, j), machine in self.machines.items():
            p = machine.probability(x)
            wins[:, i] += p >= 0.5
            wins[:, j] += p < 0.5
            total[:, i] += p
            total[:, j] += 1 - p
        best = np.argmax(wins + total / (m + 1), 1)
        return best, total[np.arange(n), best] / (m - 1)


@dataclass
class Likeness:
    """Log shares of n-grams in a language, the least mean of them that its texts have, the deviation of one n-gram, and the largest share of blanks."""

    logs: np.ndarray
    least: float
    deviation: float
    most: float

    @staticmethod
    def blanks(x: np.ndarray) -> np.ndarray:
        """The share of bytes that aren't letters: a blank is a third of its n-grams."""
        return np.minimum(len(ORDERS) * x[:, _BLANK].astype(np.float64) ** 2, 1)

    @staticmethod
    def fit(x: np.ndarray, own: np.ndarray) -> "Likeness":
        shares = (x[own].astype(np.float64) ** 2).mean(0)
        logs = np.log(0.99 * shares / max(shares.sum(), 1e-12) + 0.01 / FEATURES)
        means = (x.astype(np.float64) ** 2) @ logs
        inside = np.sort(means[own])
        least = inside[int(OUTLIERS * len(inside))]
        if (~own).any():
            least = min(least, (inside.mean() + means[~own].mean()) / 2)
        blank = np.sort(Likeness.blanks(x[own]))
        most = max(2 * blank.mean(), blank[-1 - int(OUTLIERS * len(blank))])
        return Likeness(logs.astype(np.float32), float(least), float(np.sqrt(max(0, shares @ logs**2 - (shares @ logs) ** 2))), float(most))

    def known(self, x: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        slack = DEVIATIONS / np.sqrt(np.maximum(sizes, 1))
        return ((x**2) @ self.logs >= self.least - 1e-3 - self.deviation * slack) & (self.blanks(x) <= self.most + 1e-3 + 0.5 * slack)


@dataclass
class Model:
    families: OneVersusOne
    languages: dict[str, OneVersusOne]
    like: dict[str, Likeness]

    @staticmethod
    def fit(x: np.ndarray, labels: np.ndarray) -> "Model":
        family = np.array([_FAMILY.get(code, code) for code in labels.tolist()], dtype=object)
        within = {f: OneVersusOne.fit(x[family == f], labels[family == f]) for f in sorted(set(family.tolist()))}
        return Model(OneVersusOne.fit(x, family), within, {code: Likeness.fit(x, labels == code) for code in sorted(set(labels.tolist()))})

    def predict(self, texts: pa.Array) -> tuple[list[str], np.ndarray]:
        return self._predict(frequencies(texts))

    def judge(self, texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Languages, scores, and whether the texts are like their languages."""
        x = frequencies(texts)
        names, score = self._predict(x)
        found, known, sizes = np.array(names, object), np.zeros(len(names), bool), np.diff(flat(texts)[1])
        for code, like in self.like.items():
            if len(own := np.flatnonzero(found == code)):
                known[own] = like.known(x[own], sizes[own])
        return names, score, known

    def _predict(self, x: np.ndarray) -> tuple[list[str], np.ndarray]:
        family, score = self.families.predict(x)
        names = np.full(len(x), UNKNOWN, object)
        for k, f in enumerate(self.families.classes):
            if len(own := np.flatnonzero(family == k)):
                lang, p = self.languages[f].predict(x[own])
                names[own] = np.array(self.languages[f].classes, object)[lang]
                score[own] *= p
        return names.tolist(), np.clip(score, 0, 1)


def fit(labelled: DataFrame, text: str = "text", lang: str = "lang", per_language: int = PER_LANGUAGE) -> Model | None:
    """A model from rows with a language; None if there are none.

    Of each language the per_language distinct texts with the smallest hashes are taken, or all if it
    has fewer, so copies and ids don't matter. A share of the hashes that holds about twice as many,
    from an approximate count of distinct texts, is all that is shuffled; one row a language
    and the features of per_language texts of each reach the driver.
    """
    h = F.xxhash64("t")
    rows = labelled.select(F.col(text).alias("t"), F.col(lang).alias("l")).where(F.col("l").isNotNull() & has_letter("t"))
    counts = {r.l: r.n for r in rows.groupBy("l").agg(F.approx_count_distinct(h).alias("n")).collect()}
    if not counts:
        return None
    names = F.array(*[F.lit(code) for code in counts])
    shares = constant([min(1 << 30, int((1 << 30) * 2.0 * per_language / max(1, n))) for n in counts.values()])
    share = F.get(shares, (F.array_position(names, F.col("l")) - 1).cast("int"))
    picked = rows.where(F.pmod(h, F.lit(1 << 30)) < share).withColumn("h", h)
    picked = picked.groupBy("l", "h").agg(F.min("t").alias("t"))

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tidied(batches):
            for at, part in slices(batch.column(2)):
                for k in range(0, len(part), ROWS):
                    x = frequencies(part.slice(k, ROWS)).astype(np.float16)
                    keys = [batch.column(c).slice(at + k, len(x)) for c in (0, 1)]
                    yield pa.RecordBatch.from_arrays([*keys, pa.array([r.tobytes() for r in x], pa.binary())], names=["l", "h", "x"])

    made = picked.mapInArrow(features, "l string, h long, x binary")
    rank = F.row_number().over(W.partitionBy("l").orderBy(F.pmod("h", F.lit(1 << 30)), "h"))
    found = made.withColumn("rank", rank).where(F.col("rank") <= per_language).orderBy("l", "rank").collect()
    x = np.stack([np.frombuffer(bytes(r.x), np.float16) for r in found]).astype(np.float32)
    return Model.fit(x, np.array([r.l for r in found], object))


def has_letter(text: str) -> Column:
    return F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False))


def predict(docs: DataFrame, model: Model | None, text: str = "text", like: str | None = None) -> DataFrame:
    """docs with lang_pred and score, and on demand a column that tells if the text is like its language; columns of these names are replaced. The prediction sees the text only."""
    if model is None:
        docs = docs.withColumn("lang_pred", F.lit(UNKNOWN)).withColumn("score", F.lit(0.0))
        return docs.withColumn(like, F.lit(False)) if like else docs
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("lang string, p double, known boolean")
    def guess(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in tidied(batches):
            names, scores, likes = [], [], []
            for _, part in slices(batch):
                for k in range(0, len(part), ROWS):
                    found, p, known = shared.value.judge(part.slice(k, ROWS))
                    names += found
                    scores.append(p)
                    likes.append(known)
            score = np.concatenate(scores) if scores else np.zeros(0)
            likes = np.concatenate(likes) if likes else np.zeros(0, bool)
            yield pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(score), pa.array(likes)], ["lang", "p", "known"])

    known = has_letter(text)
    name = f"guess_{uuid.uuid4().hex}"
    told = F.col(name)
    others = [F.col(f"`{c}`") for c in docs.columns if c not in ("lang_pred", "score", like)]
    out = docs.withColumn(name, F.when(known, guess(F.coalesce(F.col(text), F.lit("")))))
    extra = [F.coalesce(told["known"], F.lit(False)).alias(like)] if like else []
    return out.select(*others, F.coalesce(told["lang"], F.lit(UNKNOWN)).alias("lang_pred"), F.coalesce(told["p"], F.lit(0.0)).alias("score"), *extra)
