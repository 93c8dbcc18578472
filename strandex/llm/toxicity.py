"""Toxicity by a subsequence string kernel, Nyström landmarks and a support vector machine.

The kernel of two words is the sum, over all subsequences of three characters within six, of the products of their
weights; a subsequence weighs DECAY to the number of characters it skips. So an insult with inserted characters, with
gaps or with another ending keeps most of its likeness. The white space before a word counts as its first character, so
that beginnings of words count more than the same letters inside. Runs of single characters are joined to one word
first. Kernels are divided by a norm for each word's length (from that of four to that of ten), so that neither long
words nor those of two letters win. Letters beyond a-z share 26 symbols.

Training takes a bounded sample of labelled documents, each a bag of words: all words of a clean document are clean,
some word of a toxic one is toxic. Words found far more often in toxic bags than in clean ones are the first
witnesses; landmarks are picked by pivoted Cholesky among these and clean words; a squared-hinge support vector
machine is fitted on the Nyström features by Newton's method; then each toxic bag names the word that scores highest
as its witness, and the machine is fitted again. As a score is linear in the kernel values of the landmarks, it
collapses to one weight for each subsequence, and a text needs one pass over its characters. A document's evidence is
that of its worst word or, against a lower cut, of its second worst different one: fillers that look like an insult
come singly. Both cuts are those of the fewest errors on the sample; a logistic fit makes evidence a probability.

Null and empty texts have the score of a word without subsequences. Rows with repeated or null ids are scored each; an
empty table gives no rows; other columns, whatever their names, stay. Of several labels of one id the largest counts,
of several texts of one id the smallest trains. Without labels of both classes every score is 0. Only texts are inputs
of a score.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: Subsequences span so many characters at most; weight of each character skipped; longest length with its own norm.
SPAN, DECAY, NORMED = 6, 0.6, 10
#: Labelled documents to train on at most, toxic and clean; longer ones (in characters) don't train.
TOXIC, CLEAN, LONGEST = 2_500, 5_000, 20_000
LANDMARKS, CANDIDATES, WORDS = 192, 500, 10_000
#: Weight of the machine's errors against its ridge.
COST = 1.0
#: Score of a word that has nothing in common with the landmarks.
BIAS = -1.0
#: Weight of disguised forms of toxic words against these themselves.
DISGUISED = 0.1
#: predicted is 1 from this score on.
THRESHOLD = 0.7
_STEPS = [(a, b) for b in range(2, SPAN) for a in range(1, b)]


def _symbols() -> np.ndarray:
    """Code points to 64 symbols: 0 for marks, 63 for white space; letters beyond a-z share 26."""
    out = np.array([37 + c % 26 if c >= 0xAA and chr(c).isalpha() else 0 for c in range(0x3000)], np.uint8)
    out[ord("a") : ord("z") + 1] = np.arange(1, 27)
    out[ord("0") : ord("9") + 1] = np.arange(27, 37)
    out[[c for c in range(0x3000) if chr(c).isspace()]] = 63
    return np.append(out, 37)


_TABLE = _symbols()


class Stream:
    """The symbols of texts one after the other, words apart: rem[i] characters of the word follow place i. The white
    space before a word is its first character, so that subsequences know where words begin."""

    def __init__(self, texts: list[str]):
        lowered = [t.lower() for t in texts]
        joined = "\n" + "\n".join(lowered) + "\n"
        code = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        lengths = np.array([len(t) for t in lowered], np.int64)
        ends = np.cumsum(lengths + 1) + 1
        c = _TABLE[np.minimum(code, len(_TABLE) - 1)]
        space = c == 63
        # a space between two words of one character each
        padded = np.concatenate([[True, True], space, [True, True]])
        drop = space & ~padded[1:-3] & padded[:-4] & ~padded[3:-1] & padded[4:]
        drop[ends - 1] = False
        if drop.any():
            ends = ends - np.cumsum(drop)[ends - 1]
            c, space = c[~drop], space[~drop]
        self.c, self.ends = c.astype(np.int32), ends
        start = ~space & np.concatenate([[True], space[:-1]])
        stop = ~space & np.concatenate([space[1:], [True]])
        self.first, self.last = np.flatnonzero(start), np.flatnonzero(stop)
        following = np.searchsorted(self.last, np.arange(len(c)))
        self.rem = np.where(space, -1, np.append(self.last, len(c))[following] - np.arange(len(c))) if len(self.last) else np.full(len(c), -1)
        self.lengths = self.last - self.first + 1
        self.rem[self.first - 1] = self.lengths

    def codes(self):
        """(b, places, codes) of the subsequences; each place i starts one that ends at i + b."""
        n, lead = len(self.c), self.c << 12
        for a, b in _STEPS:
            if n > b:
                yield b, self.rem[: n - b] >= b, lead[: n - b] + (self.c[a : n - b + a] << 6) + self.c[b:]

    def word_sums(self, weight: np.ndarray) -> np.ndarray:
        """For each word, the weights of its subsequences, summed and divided by the norm of its length."""
        if not len(self.first):
            return np.zeros(0, np.float32)
        total = np.zeros(len(self.c), np.float32)
        for b, inside, code in self.codes():
            total[: len(code)] += weight[code] * (inside * np.float32(DECAY ** (b - 2)))
        edges = np.empty(2 * len(self.first), np.int64)
        edges[::2], edges[1::2] = self.first - 1, self.last + 1
        # between a word's end and the next one's white space there may be nothing, so sums are differences
        summed = np.concatenate([[0.0], np.cumsum(total, dtype=np.float64)])
        return ((summed[edges[1::2]] - summed[edges[::2]]) / norms()[np.minimum(self.lengths, NORMED)]).astype(np.float32)


def norms() -> np.ndarray:
    """By length: the root of the summed squared weights of a word's subsequences (as if all were different), its first
    place included. Lengths under four have that of four: a word of two letters would be like each that begins so."""
    squares = [sum(max(0, n + 1 - b) * DECAY ** (2 * (b - 2)) for _, b in _STEPS) for n in range(NORMED + 1)]
    return np.sqrt(np.maximum(squares, squares[4])).astype(np.float32)


@dataclass
class Model:
    weight: np.ndarray  # of each subsequence
    one: float = 0.0  # word score from which one word makes a text toxic
    two: float = np.inf  # and from which two different words do
    slope: float = 0.0  # of the logistic fit
    trained: bool = True

    def worst(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The highest word score of each text, and the highest one of another word."""
        out, low, n = [np.zeros((2, 0), np.float32)], 0, 0
        for i, t in enumerate(texts):  # a slice of characters at a time, as its arrays are many times as large
            n += len(t) + 1
            if n > 300_000 or i + 1 == len(texts):
                out.append(self._worst(texts[low : i + 1]))
                low, n = i + 1, 0
        first, second = np.concatenate(out, axis=1)
        return first, second

    def _worst(self, texts: list[str]) -> np.ndarray:
        stream = Stream(texts)
        best = np.full((2, len(texts)), BIAS, np.float32)
        scores = stream.word_sums(self.weight) + np.float32(BIAS)
        text_of = np.searchsorted(stream.ends, stream.first, "right")
        np.maximum.at(best[0], text_of, scores)
        other = scores < best[0][text_of] - 1e-4  # repeats of a word have its score
        np.maximum.at(best[1], text_of[other], scores[other])
        return best

    def evidence(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """From 0 on a text is toxic."""
        return np.maximum(first - self.one, second - self.two)

    def scores(self, texts: list[str]) -> np.ndarray:
        if not self.trained:
            return np.zeros(len(texts))
        return 1 / (1 + np.exp(-np.clip(self.slope * self.evidence(*self.worst(texts)).astype(float) + np.log(THRESHOLD / (1 - THRESHOLD)), -30, 30)))


def _sparse(words: list[str]):
    """Kernel features of words: word, code and weight of each subsequence."""
    stream = Stream(words)
    # a word's first place is the white space before it
    word_of = np.searchsorted(stream.ends, np.arange(1, len(stream.c) + 1), "right")
    rows, codes, weights = [], [], []
    for b, inside, code in stream.codes():
        at = np.flatnonzero(inside)
        rows.append(word_of[at])
        codes.append(code[at])
        weights.append(np.full(len(at), DECAY ** (b - 2)))
    norm = norms()[np.minimum([len(w) for w in words], NORMED)]
    rows = np.concatenate(rows)
    return rows, np.concatenate(codes), np.concatenate(weights) / norm[rows]


class Kernel:
    """Kernel values of any words with fixed ones."""

    def __init__(self, fixed: list[str]):
        rows, codes, weights = _sparse(fixed)
        self.codes, at = np.unique(codes, return_inverse=True)
        self.dense = np.zeros((len(self.codes), len(fixed)), np.float32)
        np.add.at(self.dense, (at, rows), weights)

    def of(self, words: list[str]) -> np.ndarray:
        out = np.zeros((len(words), self.dense.shape[1]))
        for low in range(0, len(words), 250):
            rows, codes, weights = _sparse(words[low : low + 250])
            at = np.searchsorted(self.codes, codes)
            known = (at < len(self.codes)) & (self.codes[np.minimum(at, len(self.codes) - 1)] == codes)
            np.add.at(out, rows[known] + low, self.dense[at[known]] * weights[known, None])
        return out


def _pivots(words: list[str], most: int) -> list[int]:
    """Words that span the others best: pivoted Cholesky of their kernel matrix, each word's own value made 1."""
    if not words:
        return []
    k = Kernel(words).of(words)
    size = np.sqrt(np.maximum(k.diagonal(), 1e-9))
    k = k / size / size[:, None]
    rest, basis, picked = k.diagonal().copy(), np.zeros((len(words), 0)), []
    for _ in range(min(most, len(words))):
        i = int(rest.argmax())
        if rest[i] < 1e-6:
            break
        column = (k[:, i] - basis @ basis[i]) / rest[i] ** 0.5
        basis, rest = np.column_stack([basis, column]), rest - column**2
        rest[i] = 0
        picked.append(i)
    return picked


def _svm(x: np.ndarray, y: np.ndarray, cost: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Weights w that minimise ridge |w|^2 / 2 + sum of cost max(0, 1 - y f)^2 with f = x w + BIAS, by Newton's method.

    The bias is fixed, so that a word that has nothing in common with the landmarks is clean."""
    w = np.zeros(x.shape[1])
    for _ in range(30):
        active = y * (x @ w + BIAS) < 1
        weighted = 2 * x[active].T * cost[active]
        fresh = np.linalg.solve(weighted @ x[active] + ridge * np.eye(len(w)), weighted @ (y[active] - BIAS))
        if np.abs(fresh - w).max() < 1e-6:
            break
        w = fresh
    return w


def _different(bags: list[np.ndarray]) -> list[np.ndarray]:
    """Without bags that are near copies of an earlier one: four smallest word hashes in common in one of four bands."""
    seen: set[tuple] = set()
    out = []
    factors = np.random.default_rng(3).integers(1 << 30, 1 << 32, 16, dtype=np.uint64) | np.uint64(1)
    for bag in bags:
        if not len(bag):
            continue
        raw = (bag.astype(np.uint64) + np.uint64(1)) * np.uint64(2654435761)
        low = ((raw[:, None] * factors) & np.uint64(0xFFFFFFFF)).min(axis=0).tolist()
        bands = {(i, *low[i : i + 4]) for i in range(0, 16, 4)}
        if not bands & seen:
            out.append(bag)
        seen |= bands
    return out


def _words(text: str) -> set[str]:
    stream = text.lower().split()
    runs, i = [], 0
    while i < len(stream):
        j = i
        while j < len(stream) and len(stream[j]) == 1:
            j += 1
        if j - i >= 2:
            runs.append("".join(stream[i:j]))
        else:
            runs.append(stream[i])
            j = i + 1
        i = max(j, i + 1)
    return {w.strip(".,;:!?\"'()") for w in runs} - {""}


def _disguised(word: str) -> list[str]:
    """Gapped and inserted-character forms that training takes a toxic word for, too."""
    if len(word) < 4:
        return []
    middle = len(word) // 2
    return [".".join(word), word[:middle] + "-" + word[middle:], word[: middle - 1] + "*" + word[middle - 1 :]]


def train(toxic: list[str], clean: list[str], seed: int = 11) -> Model:
    if not toxic or not clean:
        return Model(np.zeros(1 << 18, np.float32), trained=False)
    rng = np.random.default_rng(seed)
    number: dict[str, int] = {}  # bags are numbers of words, as sets of strings would need a hundred times the memory
    every_bad, every_good = ([np.array([number.setdefault(w, len(number)) for w in sorted(_words(t))], np.int32) for t in texts] for texts in (toxic, clean))
    names = list(number)
    bad, good = _different(every_bad), _different(every_good)
    in_bad, in_good = (np.bincount(np.concatenate([np.zeros(0, np.int32), *bags]), minlength=len(names)) for bags in (bad, good))
    share = len(bad) / (len(bad) + len(good))
    # likelihood ratio of each word's count in toxic bags, given its count in all
    p, n = in_bad.astype(float), in_good.astype(float)
    e = np.maximum((p + n) * share, 1e-9)
    ratio = 2 * (p * np.log(np.maximum(p, 1e-9) / e) + n * np.log(np.maximum(n, 1e-9) / np.maximum(p + n - e, 1e-9)))
    often = np.flatnonzero((p > e) & (p >= 2))
    ranked = often[np.argsort(-ratio[often], kind="stable")]
    # a ratio that no word of a corpus of so many would reach by chance
    least = 2 * np.log(len(ranked) + 1) + 2
    first = [i for i in ranked if ratio[i] > least and p[i] > 5 * n[i] * share / (1 - share)]
    seeds = [names[i] for i in first or ranked[:10].tolist() or range(min(10, len(names)))]
    clean_words = np.zeros(len(names), bool)
    for bag in every_good:
        clean_words[bag] = True
    clean_words[first] = False  # a word that is found far more often in toxic bags isn't clean for being in a clean one
    pool = np.flatnonzero(clean_words)
    others = [names[i] for i in pool[rng.permutation(len(pool))]]
    negative = list(dict.fromkeys([*(names[i] for i in np.argsort(-in_good, kind="stable")[: CANDIDATES // 4] if clean_words[i]), *others[:WORDS]]))
    # two halves, so that toxic words are spanned as well as clean ones
    toxic_half, clean_half = seeds[:CANDIDATES], negative[:CANDIDATES]
    landmarks = list(dict.fromkeys([*(toxic_half[i] for i in _pivots(toxic_half, LANDMARKS // 2)), *(clean_half[i] for i in _pivots(clean_half, LANDMARKS // 2))]))
    if not landmarks:  # no word has three characters
        return Model(np.zeros(1 << 18, np.float32), trained=False)
    kernel = Kernel(landmarks)
    values, vectors = np.linalg.eigh(kernel.of(landmarks))
    large = values > values.max() * 1e-6
    white = vectors[:, large] / values[large] ** 0.5

    def fit(positive: list[str]) -> np.ndarray:
        """Weights of the landmarks' kernel values."""
        forms = sorted({v for w in positive for v in _disguised(w)} - set(positive))
        words = [*positive, *forms, *negative]
        y = np.array([1.0] * (len(positive) + len(forms)) + [-1.0] * len(negative))
        cost = np.repeat([len(negative) / len(positive), DISGUISED * len(negative) / (len(forms) + 1), 1.0], [len(positive), len(forms), len(negative)]) * COST
        return white @ _svm(kernel.of(words) @ white, y, cost)

    def collapsed(w: np.ndarray) -> Model:
        weight = np.zeros(1 << 18, np.float32)
        weight[kernel.codes] = kernel.dense @ w
        return Model(weight)

    own = [bag[~clean_words[bag]] for bag in bad]
    every = np.unique(np.concatenate([np.zeros(0, np.int32), *own]))
    score = np.full(len(names), -np.inf, np.float32)
    positive = seeds
    for _ in range(4):
        model = collapsed(fit(positive))
        score[every] = model.worst([names[i] for i in every])[0]
        witnesses = {int(bag[score[bag].argmax()]) for bag in own if len(bag)}
        positive = sorted({names[x] for x in witnesses if score[x] > -0.5} | set(seeds))
        # clean words that the machine takes for toxic ones are the next ones it should learn
        negative = list(dict.fromkeys([*negative, *(others[i] for i in np.argsort(-model.worst(others)[0], kind="stable")[:1500])]))
    model = collapsed(fit(positive))
    one, two = (np.concatenate([x, y]).astype(float) for x, y in zip(model.worst(toxic), model.worst(clean), strict=True))
    truth = np.array([1.0] * len(toxic) + [0.0] * len(clean))
    model.one, model.two = _cuts(one, two, truth)
    model.slope = _slope(model.evidence(one, two), truth)
    return model


def _cuts(one: np.ndarray, two: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Cuts at which "one of its words, or each of two" tells y with the fewest errors; the second cut is as high as it
    can be without more errors."""
    steps = np.unique(np.quantile(two[y > 0], np.linspace(0, 1, 257)))
    best = (np.inf, 0.0, 0.0)
    for cut in [np.inf, *steps[::-1]]:
        rest = two < cut
        errors, at = _cut(one[rest], y[rest]) if rest.any() else (0, 0.0)
        best = min(best, (errors + int((1 - y[~rest]).sum()), -cut, at))
    return best[2], -best[1]


def _cut(x: np.ndarray, y: np.ndarray) -> tuple[int, float]:
    """The fewest errors with which a cut of x tells y, and the middle of where these are."""
    order = np.argsort(x, kind="stable")
    x, y = x[order], y[order]
    errors = np.concatenate([[0], np.cumsum(y)]) + (1 - y).sum() - np.concatenate([[0], np.cumsum(1 - y)])
    errors[1:-1][x[1:] == x[:-1]] = np.inf  # equal values stay together
    edges = np.concatenate([[x[0] - 1], (x[1:] + x[:-1]) / 2, [x[-1] + 1]])
    return int(errors.min()), float(np.median(edges[errors == errors.min()]))


def _slope(x: np.ndarray, y: np.ndarray) -> float:
    """Slope of a logistic fit that is THRESHOLD at 0, with a slight ridge and smoothed targets."""
    target = np.where(y > 0, 1 - 1 / (y.sum() + 2), 1 / ((1 - y).sum() + 2))
    w = 1.0
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(w * x + np.log(THRESHOLD / (1 - THRESHOLD)), -30, 30)))
        step = (x @ (p - target) + 1e-3 * w) / ((x * x) @ (p * (1 - p) + 1e-9) + 1e-3)
        w = max(w - float(np.clip(step, -2, 2)), 0.05)
    return w


def training_texts(docs: DataFrame, labels: DataFrame, toxic: int = TOXIC, clean: int = CLEAN) -> tuple[list[str], list[str]]:
    """Texts of a bounded sample of labelled documents: the first by a hash of the id, in each class."""
    kept = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))

    def first(value: int, most: int) -> DataFrame:
        return kept.where(F.col("toxic") == value).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)

    chosen = first(1, toxic).union(first(0, clean))
    known = docs.select("doc_id", "text").where(F.length("text") <= LONGEST).join(F.broadcast(chosen), "doc_id")
    rows = known.groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic")).collect()  # as many as `chosen`
    rows.sort(key=lambda r: (r.doc_id, r.text))
    return [r.text for r in rows if r.toxic], [r.text for r in rows if not r.toxic]


def toxicity(docs: DataFrame, model: Model, text: str = "text", out: str = "score") -> DataFrame:
    """docs with the score (double) as the column `out`, in place of one of that name."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches):
        for batch in batches:
            texts = [t or "" for t in batch.column(batch.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(shared.value.scores(texts), pa.float64())], [*batch.schema.names[:-1], "score"])

    kept = docs.columns
    # names may clash or repeat, so columns travel by place
    plain = docs.select(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(kept)), F.col(text).alias("text"))
    kinds = ", ".join(f"c{i} {f.dataType.simpleString()}" for i, f in enumerate(docs.schema.fields))
    done = plain.mapInArrow(score, f"{kinds}, score double")
    return done.select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(kept) if c != out), F.col("score").alias(out))


def held_out() -> F.Column:
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = train(*training_texts(docs, labels.where(~held_out())))
    out = toxicity(docs.select("doc_id", "text").withColumn("held_out", F.coalesce(held_out(), F.lit(False))), model).drop("text")
    return out.select("doc_id", "held_out", "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
