"""Toxicity by a weighted lexicon, matched by Aho-Corasick in folded text.

Folding lower-cases, replaces look-alike letters and digits that stand for letters, and turns
punctuation into spaces. The lexicon is learned from labelled texts: whole words and beginnings of
words whose log-odds in toxic texts are clearly above those in others, each with that weight. Copies
and near copies of a text, by a signature, count once on both sides.
Phrases around a lexicon word that clean texts hold as often are exceptions: a match within one
does not count. A text's weights, summed and by its length, go into a logistic curve.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sylva.llm.common import cut, forget, give_back, remainder, row_ids, text_batches, whole_rows
from sylva.session import table

#: Labelled texts learned from, at most (all, if fewer), drawn by a hash of the text's id.
LABELLED = 30_000
#: Lengths of word beginnings; standard errors and log-odds that an entry needs, different toxic texts with it.
STEMS, CLEARLY, STRONGLY, LEAST = (4, 5, 6, 7), 3.5, 1.5, 8
#: An exception stands in so many clean texts at least, and in no greater a share of the toxic ones.
EXCEPTION = 3
THRESHOLD = 0.3
#: Words of a shingle of the signature.
SHINGLE = 4
#: Code points of text handled at once, and rows sent on at once.
CHUNK, HELD = 1_000_000, 100_000
# Letters of other scripts that look like Latin ones, and what digits and signs stand for.
ALIKE = dict(zip("абвгеѕіјкмнорсԁтухһԛԝαβεικνορτυχγω", "a6bresijkmhopcdtyxhqwabeiknoptuxyw", strict=True))
DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s"}


class _Fold(dict):
    """A translation table for str.translate, filled as code points are met."""

    def __missing__(self, code: int) -> str:
        c = chr(code)
        if 0xFF01 <= code <= 0xFF5E:  # full-width forms
            c = chr(code - 0xFEE0).lower()
        c = DIGITS.get(c) or ALIKE.get(c) or c
        self[code] = c = c if c.isalpha() else "" if code in (0x200B, 0x200C, 0x200D, 0xAD, 0xFEFF) else " "
        return c


def folded(text: str, table: dict) -> list[str]:
    return text.lower().translate(table).split()


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict[str, list], list[str]]]:
    forget()
    held, texts, size = {}, [], 0
    for batch in batches:
        names = batch.schema.names
        columns = {n: batch.column(i).to_pylist() for i, n in enumerate(names) if n != "text"}
        for k, t in enumerate(batch.column(names.index("text"))):
            texts.append(t.as_py() or "")
            for n, v in columns.items():
                held.setdefault(n, []).append(v[k])
            size += len(texts[-1])
            if size >= CHUNK:
                yield held, texts
                held, texts, size = {}, [], 0
    if texts:
        yield held, texts
        del held, texts
    give_back()


def entries_of(words: list[str]) -> set[str]:
    """Lexicon entries that a text holds: " word " and " stem"."""
    seen = set(words)
    out = {f" {w} " for w in seen if len(w) > 1}
    for n in STEMS:
        out |= {" " + w[:n] for w in seen if len(w) > n}
    return out


def signature(words: list[str]) -> int:
    """The least hash of a text's shingles: mostly equal for near copies, seldom for other texts."""
    return min(xxhash.xxh3_64_intdigest(" ".join(words[i : i + SHINGLE]).encode()) for i in range(max(len(words) - SHINGLE, 0) + 1)) - (1 << 63)


class Lexicon:
    """Weights of entries, exceptions, and the automaton that finds both."""

    def __init__(self, weights: dict[str, float], exceptions: set[str] = frozenset()):
        self.table, self.found = _Fold(), ahocorasick.Automaton()
        for e, w in weights.items():
            self.found.add_word(e, (len(e), w))
        for e in exceptions:
            self.found.add_word(e, (len(e), None))
        if len(self.found):
            self.found.make_automaton()

    def hits(self, words: list[str]) -> tuple[str, list[tuple[int, int, float]]]:
        """The folded text and (start, end, weight) of each match: the longest from each start, outside exceptions."""
        text = " " + " ".join(words) + " "
        if not len(self.found) or not words:
            return text, []
        best: dict[int, tuple[int, float]] = {}
        spared = []
        for last, (n, w) in self.found.iter(text):
            start = last - n + 1
            if w is None:
                spared.append((start, last + 1))
            elif n >= best.get(start, (0, 0.0))[0]:
                best[start] = (n, w)
        hits, until = [], 0
        spared.sort(reverse=True)
        for s, (n, w) in sorted(best.items()):
            while spared and spared[-1][0] <= s:  # until: the farthest end of an exception that has begun
                until = max(until, spared.pop()[1])
            if s + n > until:
                hits.append((s, s + n, w))
        return text, hits

    def features(self, text: str) -> tuple[float, float, float]:
        """1, the weights' sum (as a logarithm) and the sum by the length's square root."""
        words = folded(text, self.table)
        total = sum(w for _, _, w in self.hits(words)[1])
        return 1.0, math.log1p(total), total / math.sqrt(len(words) + 10.0)


def log_odds(toxic: np.ndarray, clean: np.ndarray, n_toxic: int, n_clean: int) -> tuple[np.ndarray, np.ndarray]:
    """Log-odds of an entry in toxic against clean texts, and their standard error."""
    value = np.log((toxic + 0.5) / (n_toxic + 1)) - np.log((clean + 0.5) / (n_clean + 1))
    return value, np.sqrt(1 / (toxic + 0.5) + 1 / (clean + 0.5))


def fit_curve(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Logistic regression by Newton's method with a small ridge."""
    b = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + np.diag([1e-6, 1e-2, 1e-2])
        step = np.linalg.solve(h, x.T @ (weight * (y - p)) - np.array([1e-6, 1e-2, 1e-2]) * b)
        b += np.clip(step, -4, 4)
        if np.abs(step).max() < 1e-6:
            break
    return b


def chosen_labels(labels: DataFrame, key: str = "doc_id") -> DataFrame:
    """key and toxic of LABELLED labelled ids at most; an id is toxic if any of its labels is."""
    labels = labels.where(F.col(key).isNotNull() & F.col("toxic").isNotNull()).groupBy(F.col(key).alias("key")).agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    n = labels.count()
    draw = F.pmod(F.xxhash64(F.lit("toxicity"), "key"), F.lit(1 << 20))
    # A margin of five standard errors keeps a drawn share below the bound.
    share = 1.0 if n <= LABELLED else (LABELLED - 5 * math.sqrt(LABELLED)) / n
    return labels.where(draw < int(share * (1 << 20)))


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id") -> tuple[dict[str, float], set[str], np.ndarray]:
    """Lexicon weights, exceptions and the curve, from labelled texts; nothing without labels of both kinds."""
    sample = docs.select(F.col(key).alias("key"), "text").join(F.broadcast(chosen_labels(labels, key)), "key").select("toxic", "text")

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, seen = _Fold(), (Counter(), Counter())

        def flush(y: int) -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(seen[y].keys(), pa.string()), pa.array([y] * len(seen[y]), pa.int32()), pa.array(seen[y].values(), pa.int64())], ["entry", "toxic", "n"])
            seen[y].clear()
            return out

        for held, texts in _texts(batches):
            for y, t in zip(held["toxic"], texts, strict=True):
                seen[y].update(entries_of(folded(t, table)))
                seen[y][""] += 1
                if len(seen[y]) > HELD:
                    yield flush(y)
        for y in (0, 1):
            yield flush(y)

    sums = sample.mapInArrow(counted, "entry string, toxic int, n bigint").groupBy("entry").agg(
        F.sum(F.when(F.col("toxic") == 1, F.col("n")).otherwise(0)).alias("t"), F.sum(F.when(F.col("toxic") == 0, F.col("n")).otherwise(0)).alias("c")
    )
    sums = cut(sums.where((F.col("entry") == "") | (F.col("t") >= LEAST)))
    whole = sums.where("entry = ''").first()
    if not whole or not whole.t or not whole.c:
        return {}, set(), np.array([-1.5, 0.0, 0.0])
    n_toxic, n_clean = whole.t, whole.c
    value = F.log((F.col("t") + 0.5) / (n_toxic + 1)) - F.log((F.col("c") + 0.5) / (n_clean + 1))
    # Loosely, as copies still count here: these entries are in LEAST of LABELLED texts at least, so bounded by the texts' words.
    loose = sums.where((F.col("entry") != "") & (value > STRONGLY / 3)).select("entry").toArrow()
    telling = docs.sparkSession.sparkContext.broadcast(frozenset(loose.column("entry").to_pylist()))

    def held_by(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, out = _Fold(), set()

        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], k) for i, k in enumerate((pa.string(), pa.int32(), pa.int64()))], ["entry", "toxic", "sig"])

        for held, texts in _texts(batches):
            for y, t in zip(held["toxic"], texts, strict=True):
                words = folded(t, table)
                sig = signature(words)
                out.add(("", y, sig))
                out.update((e, y, sig) for e in entries_of(words) if e in telling.value)
                if len(out) > HELD:
                    yield flush()
                    out = set()
        yield flush()

    # Different texts, on both sides and in their totals alike: what copies of one text share is held by one.
    once = sample.mapInArrow(held_by, "entry string, toxic int, sig bigint").distinct()
    once = once.groupBy("entry").agg(F.sum("toxic").alias("t"), F.sum(1 - F.col("toxic")).alias("c")).orderBy("entry").collect()  # telling entries at most
    stats = {}
    for r in once[1:]:
        w, e = log_odds(np.array([float(r["t"])]), np.array([float(r["c"])]), once[0]["t"], once[0]["c"])
        if r["t"] >= LEAST and w[0] > max(STRONGLY, CLEARLY * e[0]):
            stats[r["entry"]] = float(w[0])
    # A longer entry adds nothing where a beginning of it is nearly as telling.
    weights = {e: min(w, 6.0) for e, w in stats.items() if not any(stats.get(e[:k], 0.0) >= w - 1 for k in range(3, len(e)))}

    def phrased(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon, out = Lexicon(weights), Counter()
        for held, texts in _texts(batches):
            for y, text in zip(held["toxic"], texts, strict=True):
                text, hits = lexicon.hits(folded(text, lexicon.table))
                around = set()
                for start, end, _ in hits:
                    stop = text.index(" ", end - 1) if text[end - 1] != " " else end - 1
                    a, b = text.rfind(" ", 0, start) if start else -1, text.find(" ", stop + 1)
                    around |= {text[a : stop + 1]} if a >= 0 else set()
                    around |= {text[start : b + 1]} if b >= 0 else set()
                out.update((p, y) for p in around)
        yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in out], pa.string()), pa.array([y for _, y in out], pa.int32()), pa.array(out.values(), pa.int64())], ["phrase", "toxic", "n"])

    phrases = sample.mapInArrow(phrased, "phrase string, toxic int, n bigint").groupBy("phrase").agg(
        F.sum(F.when(F.col("toxic") == 1, F.col("n")).otherwise(0)).alias("t"), F.sum(F.when(F.col("toxic") == 0, F.col("n")).otherwise(0)).alias("c")
    )
    spared = phrases.where((F.col("c") >= EXCEPTION) & (F.col("t") / n_toxic <= F.col("c") / n_clean)).collect()  # around entries in the labelled texts only
    exceptions = {r["phrase"] for r in spared}

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = Lexicon(weights, exceptions)
        out = Counter()
        for held, texts in _texts(batches):
            out.update((y, *(round(v, 2) for v in lexicon.features(t))) for y, t in zip(held["toxic"], texts, strict=True))
        rows = list(out)
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.float64()) for i in range(4)] + [pa.array(out.values(), pa.int64())], ["y", "f0", "f1", "f2", "n"])

    m = sample.mapInArrow(measured, "y double, f0 double, f1 double, f2 double, n bigint").toArrow()  # LABELLED rows at most
    y, f0, f1, f2, n = (m.column(k).to_numpy().astype(float) for k in ("y", "f0", "f1", "f2", "n"))
    order = np.lexsort((f2, f1, y))
    return weights, exceptions, fit_curve(np.stack([f0, f1, f2], 1)[order], y[order], n[order])


def score_texts(docs: DataFrame, labels: DataFrame, key: str = "doc_id", threshold: float = THRESHOLD) -> DataFrame:
    """rid, key, score (0 to 1) and predicted for each row of docs, learned from labels (key, toxic).

    Null and empty texts get the score of a text without matches, null keys are scored like others.
    Very long texts are matched whole, their sum weighed by their length. Repeated rows each get a row
    and, learned from, count once, as all copies do. Of entries that start at one place the longest
    counts, and an id with several labels is toxic if one of them says so. Other columns are ignored, an empty table
    gives an empty result, and without labels of both kinds every text gets the same low score.
    """
    model = docs.sparkSession.sparkContext.broadcast(train(text_batches(docs), labels, key))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, exceptions, curve = model.value
        lexicon = Lexicon(weights, exceptions)
        for held, texts in _texts(batches):
            x = np.array([lexicon.features(t) for t in texts])
            p = 1 / (1 + np.exp(-np.clip(x @ curve, -30, 30)))
            yield pa.RecordBatch.from_arrays([pa.array(held["rid"], pa.int64()), pa.array(held["key"], pa.int64()), pa.array(p)], ["rid", "key", "score"])

    keyed = row_ids(docs.select(F.col(key).cast("long").alias("key"), "text"))
    out = keyed.select("rid", "key", "text").mapInArrow(run, "rid bigint, key bigint, score double")
    return out.select("rid", F.col("key").alias(key), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = remainder(F.col("doc_id"), 4) == 2
    labels = table(spark, sf_dir, "labels").where(~held_out)
    return score_texts(table(spark, sf_dir, "documents"), labels).drop("rid").withColumn("held_out", held_out)


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs without those that are predicted to be toxic.

    Rows of null or empty text or null key stay (they have no match), repeated rows stay or go together, an
    empty table stays empty, without labels all rows stay, and no column's name can clash. Very long texts are
    matched whole; a score that equals the threshold goes.
    """
    labels = table(spark, sf_dir, "labels").where(remainder(F.col("doc_id"), 4) != 2)
    toxic = score_texts(docs, labels).where("predicted = 1").select("rid")
    return whole_rows(docs).join(toxic, "rid", "left_anti").select("row.*")
