"""Language-model scores of texts: a log-bilinear model trained by noise-contrastive estimation.

Words are counted over all training texts. The most frequent words are classes of their own, all
others share classes by their ending. The model predicts the class of each token from the classes
of the two before it: context vectors, weighted by place, are summed and multiplied with every
class's vector. It starts at the classes' frequencies and learns, in numpy inside tasks, from every
position of every training text, once; tasks' parameters are averaged after each round, and each
round has its own texts. Scoring
sums over all classes for each pair of classes a context can have, once in a task, so that probabilities
are normalised, and shares a class's probability among its words by count.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sylva.llm.common import at_most, chunks, cut, remainder, row_ids
from sylva.session import table

#: Words with a class of their own (besides the end), and classes of endings.
OWN, ENDINGS = 383, 128
CLASSES = 1 + OWN + ENDINGS
WIDTH = 24
#: Noise words and positions of a step; rounds, each over its share of the texts; bytes of text whose positions are mixed.
NOISE, STEP, ROUNDS, SPEED, MIXED = 32, 512, 2, 0.15, 1_500_000
#: Words whose counts go to each task; the counts of all others are joined.
FREQUENT = 200_000
#: The end of a text, which no word equals.
END = b" "
CHUNK, MEMO = 6_000_000, 1_000_000


def word_hash(word: bytes) -> int:
    return xxhash.xxh3_64_intdigest(word) - (1 << 63)


def ending(word: bytes) -> int:
    return 1 + OWN + xxhash.xxh32_intdigest(word[-2:]) % ENDINGS


def words_of(texts: list[bytes]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """The distinct words of UTF-8 texts, A-Z lower-cased; which of them stand one after the other in all texts; and each text's number of words."""
    split = pc.ascii_split_whitespace(pc.ascii_lower(pa.array(texts, pa.large_binary()).view(pa.large_string())))
    there = pc.greater(pc.binary_length(split.values), 0)  # white space at an end leaves an empty word
    met = np.concatenate([[0], np.cumsum(there.to_numpy(zero_copy_only=False))])
    coded = split.values.filter(there).dictionary_encode()
    return coded.dictionary.view(pa.large_binary()).to_numpy(zero_copy_only=False).tolist(), coded.indices.to_numpy(), np.diff(met[split.offsets.to_numpy()])


class _Numbers(dict):
    """Words by the order in which they came."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


class Lookup:
    """Class and count (-1: not among the frequent) of the words that a task meets."""

    def __init__(self, hashes: np.ndarray, counts: np.ndarray, own: dict[int, int]):
        self.hashes, self.counts, self.own = hashes, counts, own
        self.clear()

    def clear(self) -> None:
        self.number = _Numbers()
        self.hash, self.kind, self.count = np.empty(0, np.int64), np.empty(0, np.int16), np.empty(0, np.int64)

    def tokens(self, texts: list[bytes]) -> list[np.ndarray]:
        """Numbers of each text's tokens, the end last."""
        if len(self.number) > MEMO:
            self.clear()
        number = self.number.__getitem__
        words, which, sizes = words_of(texts)
        ends = np.cumsum(sizes + 1) - 1
        inside = np.ones(len(which) + len(texts), bool)
        inside[ends] = False
        flat = np.full(len(inside), number(END), np.int64)
        flat[inside] = np.fromiter(map(number, words), np.int64, len(words))[which]
        new = list(self.number)[len(self.hash) :]
        h = np.fromiter(map(word_hash, new), np.int64, len(new))
        kind = np.fromiter((self.own.get(x) or ending(w) for x, w in zip(h.tolist(), new, strict=True)), np.int16, len(new))
        kind[[w == END for w in new]] = 0
        at = np.minimum(np.searchsorted(self.hashes, h), max(len(self.hashes) - 1, 0))
        there = self.hashes[at] == h if len(self.hashes) else np.zeros(len(h), bool)
        count = np.where(there, self.counts[at], -1) if len(self.hashes) else np.full(len(h), -1)
        self.hash, self.kind, self.count = (np.concatenate(x) for x in ((self.hash, h), (self.kind, kind), (self.count, count)))
        return np.split(flat, ends[:-1] + 1)


def count_words(docs: DataFrame) -> DataFrame:
    """h, kind and c of each distinct token of the column text, the end included."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(seen: Counter) -> pa.RecordBatch:
            kinds = [0 if w == END else ending(w) for w in seen]
            return pa.RecordBatch.from_arrays([pa.array(map(word_hash, seen), pa.int64()), pa.array(kinds, pa.int32()), pa.array(seen.values(), pa.int64())], ["h", "kind", "c"])

        seen: Counter = Counter()
        for _, texts in chunks(batches, CHUNK):
            words, which, _ = words_of(texts)
            seen.update(dict(zip(words, np.bincount(which, minlength=len(words)).tolist(), strict=True)))
            seen[END] += len(texts)
            if len(seen) > MEMO:
                yield flush(seen)
                seen = Counter()
        if seen:
            yield flush(seen)

    return docs.select("text").mapInArrow(run, "h bigint, kind int, c bigint").groupBy("h").agg(F.sum("c").alias("c"), F.first("kind").alias("kind"))


# ---------------------------------------------------------------- the model in numpy


def started(mass: np.ndarray) -> dict[str, np.ndarray]:
    """Parameters before learning: no effect of the context, biases at the classes' frequencies."""
    rng = np.random.default_rng(7)
    k = len(mass)
    return {
        "read": rng.normal(0, 0.1, (k + 1, WIDTH)).astype(np.float32),  # of a class in the context; the last stands before the text
        "place": np.ones((2, WIDTH), np.float32),
        "write": rng.normal(0, 0.1, (k, WIDTH)).astype(np.float32),  # of a predicted class
        "bias": np.log((mass + 1) / (mass.sum() + k)).astype(np.float32),
    }


def packed(p: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([v.ravel() for v in p.values()])


def unpacked(flat: np.ndarray, like: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for k, v in like.items():
        out[k] = flat[at : at + v.size].reshape(v.shape).astype(np.float32)
        at += v.size
    return out


class Learner:
    """AdaGrad on the noise-contrastive loss, one step after another over a stream of positions.

    A class's bias stands as one more number of its vector, which a context multiplies with 1: its two
    classes have a half each there, which nothing learns.
    """

    def __init__(self, p: dict[str, np.ndarray], mass: np.ndarray, seed: int):
        wide = lambda v, last: np.column_stack([v, np.broadcast_to(last, len(v))]).astype(np.float32)
        self.wide = {"read": wide(p["read"], 0.5), "place": wide(p["place"], 1), "write": wide(p["write"], p["bias"])}
        self.seen = {k: np.full_like(v, 1e-3) for k, v in self.wide.items()}
        self.cells = {k: np.arange(v.size).reshape(v.shape) for k, v in self.wide.items()}
        self.noise = (mass + 1) / (mass.sum() + len(mass))
        self.ends = np.cumsum(self.noise)
        self.usual = np.log(NOISE * self.noise).astype(np.float32)
        self.rng = np.random.default_rng(seed)
        self.n = 0

    @property
    def p(self) -> dict[str, np.ndarray]:
        read, place, write = self.wide.values()
        return {"read": read[:, :-1], "place": place[:, :-1], "write": write[:, :-1], "bias": write[:, -1]}

    def _update(self, name: str, g: np.ndarray) -> None:
        """Every row; those of no gradient stay as they are."""
        self.seen[name] += g * g
        self.wide[name] += SPEED * g / np.sqrt(self.seen[name])

    def _summed(self, name: str, at: np.ndarray, g: np.ndarray) -> np.ndarray:
        """Sums of g's rows by the rows of a parameter that they belong to."""
        cells = self.cells[name]
        out = np.zeros(cells.size, np.float32)
        np.add.at(out, cells.take(at, 0).ravel(), g.ravel())
        return out.reshape(cells.shape)

    def learn(self, positions: np.ndarray) -> None:
        """Once over positions (last, last but one, class), in a drawn order."""
        read, place, write = self.wide.values()
        self.n += len(positions)
        last, second, word = positions[self.rng.permutation(len(positions))].T.copy()
        starts = range(0, len(word), STEP)
        noise = np.minimum(np.searchsorted(self.ends, self.rng.random((len(starts), NOISE)), side="right"), len(self.noise) - 1)
        for start, x in zip(starts, noise, strict=True):
            a, b, w = (v[start : start + STEP] for v in (last, second, word))
            n = len(w)
            ra, rb, tw, tx = read.take(a, 0), read.take(b, 0), write.take(w, 0), write.take(x, 0)
            q = ra * place[0]
            q += rb * place[1]
            good = np.einsum("ij,ij->i", q, tw) - self.usual[w]
            tx[:, -1] -= self.usual[x]
            bad = q @ tx.T
            g = (1 / n / (1 + np.exp(np.clip(good, -30, 30)))).astype(np.float32)
            e = np.exp(-np.maximum(bad, -30, out=bad), out=bad)
            e += 1
            np.divide(-1 / n, e, out=e)
            gq = g[:, None] * tw
            gq += e @ tx
            gt = self._summed("write", np.concatenate([w, x]), np.concatenate([g[:, None] * q, e.T @ q]))
            gr = self._summed("read", np.concatenate([a, b]), np.concatenate([gq * place[0], gq * place[1]]))
            gp = np.stack([np.einsum("ij,ij->j", gq, ra), np.einsum("ij,ij->j", gq, rb)])
            gr[:, -1] = gp[:, -1] = 0
            self._update("place", gp)
            self._update("write", gt)
            self._update("read", gr)


def before(kinds: list[np.ndarray], k: int) -> tuple[np.ndarray, np.ndarray]:
    """The class before each position of each text, and the one before that; k before the text."""
    one, two = [], []
    for x in kinds:
        y = np.concatenate([[k, k], x[:-1]])
        one.append(y[1:])
        two.append(y[:-1])
    return np.concatenate(one), np.concatenate(two)


def normalised(p: dict[str, np.ndarray], rows: int = 4096) -> tuple[np.ndarray, ...]:
    """What the last class adds to each class, what the one before it adds (the bias within), and the logarithm of the
    sum over all classes for each pair of them: a product of exponentials, rows at once."""
    one, two = (((p["read"] * p["place"][i]).astype(np.float64) @ p["write"].T) for i in (0, 1))
    two += p["bias"]
    tops = one.max(1, keepdims=True), two.max(1, keepdims=True)
    other = np.exp(two - tops[1]).T
    total = np.concatenate([np.exp(one[i : i + rows] - tops[0][i : i + rows]) @ other for i in range(0, len(one), rows)])
    tiny = np.argwhere(total < 1e-280)  # the two tops are of classes so far apart that exponentials vanish
    norm = np.log(np.maximum(total, 1e-280)) + tops[0] + tops[1].T
    for start in range(0, len(tiny), rows):
        i, j = tiny[start : start + rows].T
        s = one[i] + two[j]
        top = s.max(1, keepdims=True)
        norm[i, j] = top[:, 0] + np.log(np.exp(s - top).sum(1))
    return one, two, norm


def log_probabilities(p: dict[str, np.ndarray], one: np.ndarray, two: np.ndarray, target: np.ndarray, rows: int = 4096) -> np.ndarray:
    """Natural logarithms of the targets' normalised probabilities."""
    return looked_up(normalised(p, rows), one, two, target)


def looked_up(tables: tuple[np.ndarray, ...], one: np.ndarray, two: np.ndarray, target: np.ndarray) -> np.ndarray:
    """log_probabilities by the tables of normalised()."""
    by_last, by_second, norm = tables
    return by_last[one, target] + by_second[two, target] - norm[one, two]


def positions_of(look: Lookup, texts: list[bytes], turn: int) -> np.ndarray:
    """Every position (last class, last but one, class) of those texts whose round it is."""
    texts = [t for t in texts if xxhash.xxh32_intdigest(t) % ROUNDS == turn]
    if not texts:
        return np.empty((0, 3), np.int64)
    kinds = [look.kind[t].astype(np.int64) for t in look.tokens(texts)]
    return np.stack([*before(kinds, CLASSES), np.concatenate(kinds)], 1)


# ---------------------------------------------------------------- the operator


def score_texts(docs: DataFrame, train: DataFrame, key: str = "doc_id") -> DataFrame:
    """rid, key, n_tokens, n_known, train_tokens, base_score and score for each row of docs.

    train has the texts to learn from (column text). Null text is empty: one token, the end. Very long
    texts are scored whole. Repeated rows and null keys each get a row, and repeated training rows are
    learned from as often. Words of equal counts have their classes by the order of their hashes. Other
    columns are ignored; an empty table gives an empty result. Without training texts every word is
    unknown, the base score is 0 and the model is uniform over its classes. Words are told apart by 64-bit hashes.
    """
    counts = cut(count_words(train))
    whole = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    total, distinct = whole.n, whole.v
    own_rows = counts.where("kind <> 0").orderBy(F.desc("c"), "h").limit(OWN).collect()
    own = {r["h"]: i + 1 for i, r in enumerate(own_rows)}
    mass, types = np.zeros(CLASSES), np.zeros(CLASSES)
    for r in counts.groupBy("kind").agg(F.sum("c").alias("c"), F.count("*").alias("v")).collect():  # a row for each class
        mass[r["kind"]], types[r["kind"]] = r["c"], r["v"]
    for r in own_rows:
        mass[r["kind"]] -= r["c"]
        types[r["kind"]] -= 1
        mass[own[r["h"]]] = r["c"]
    frequent = at_most(counts, FREQUENT).select("h", "c").toArrow()  # FREQUENT rows at most
    always = {r["h"]: r["c"] for r in own_rows} | {word_hash(END): int(mass[0])}
    h = np.concatenate([frequent.column("h").to_numpy(), np.array(list(always), np.int64)])
    c = np.concatenate([frequent.column("c").to_numpy(), np.array(list(always.values()), np.int64)])
    h, order = np.unique(h, return_index=True)
    c = c[order]
    spark = docs.sparkSession
    known = spark.sparkContext.broadcast((h, c, own))

    params = started(mass)
    flat = packed(params)
    for turn in range(ROUNDS):
        at = spark.sparkContext.broadcast(flat)

        def learned(batches: Iterator[pa.RecordBatch], at=at, turn=turn) -> Iterator[pa.RecordBatch]:
            look, learner = Lookup(*known.value), Learner(unpacked(at.value, params), mass, turn)
            for _, texts in chunks(batches, MIXED):
                learner.learn(positions_of(look, texts, turn))
            if learner.n:
                yield pa.RecordBatch.from_arrays([pa.array([learner.n], pa.int64()), pa.array([packed(learner.p)], pa.list_(pa.float32()))], ["n", "p"])

        taught = train.select("text").mapInArrow(learned, "n bigint, p array<float>").select("n", F.posexplode("p"))
        mean = taught.groupBy("pos").agg((F.sum(F.col("n") * F.col("col")) / F.sum("n")).alias("x")).toArrow()  # a row for each parameter
        if mean.num_rows:
            flat = np.zeros(len(flat))
            flat[mean.column("pos").to_numpy()] = mean.column("x").to_numpy()
    model = spark.sparkContext.broadcast(unpacked(flat, params))
    shared = np.where(np.arange(CLASSES) > OWN, np.log10(mass + types + 1), 0.0)  # what a class's counts are divided by
    floor = np.log10(total + 1.0 * (distinct + 1))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        look, tables = Lookup(*known.value), normalised(model.value)
        for held, texts in chunks(batches, CHUNK):
            tokens = look.tokens(texts)
            sizes = np.array([len(t) for t in tokens])
            first = np.cumsum(sizes) - sizes
            flat_tokens = np.concatenate(tokens)
            kind, count = look.kind[flat_tokens].astype(np.int64), look.count[flat_tokens]
            one, two = before([look.kind[t] for t in tokens], CLASSES)
            here = np.log10(np.maximum(count, 0) + 1.0)
            log10 = looked_up(tables, one, two, kind) / np.log(10) - shared[kind] + np.where(kind > OWN, here, 0.0)
            rare = []
            for t in tokens:
                ids, n = np.unique(t[look.count[t] < 0], return_counts=True)
                rare.append([{"h": a, "n": b} for a, b in zip(look.hash[ids].tolist(), n.tolist(), strict=True)])
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(held["rid"], pa.int64()),
                    pa.array(sizes, pa.int64()),
                    pa.array(np.add.reduceat((count >= 0).astype(np.int64), first)),
                    pa.array(np.add.reduceat(here, first) - sizes * floor),
                    pa.array(np.add.reduceat(log10, first)),
                    pa.array(rare, pa.list_(pa.struct([("h", pa.int64()), ("n", pa.int64())]))),
                ],
                ["rid", "n_tokens", "known", "base", "model", "rare"],
            )

    keyed = row_ids(docs.select(F.col(key).alias("key"), "text"))
    schema = "rid bigint, n_tokens bigint, known bigint, base double, model double, rare array<struct<h:bigint,n:bigint>>"
    done = cut(keyed.select("rid", "text").mapInArrow(scored, schema))
    rest = done.select("rid", F.explode("rare").alias("r")).select("rid", "r.h", "r.n").join(counts.select("h", "c"), "h")
    rest = rest.groupBy("rid").agg(F.sum("n").alias("more"), F.sum(F.col("n") * F.log10(F.col("c") + 1.0)).alias("gain"))
    more, gain = F.coalesce("more", F.lit(0)), F.coalesce("gain", F.lit(0.0))
    return keyed.select("rid", "key").join(done.drop("rare"), "rid").join(rest, "rid", "left").select(
        "rid",
        F.col("key").alias(key),
        "n_tokens",
        (F.col("known") + more).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base") + gain).alias("base_score"),
        (F.col("model") + gain).alias("score"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = remainder(F.col("doc_id"), 7) == 2
    scored = score_texts(docs, docs.where(~held_out))
    return scored.drop("rid").withColumn("held_out", held_out)
