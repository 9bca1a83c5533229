"""Byte-level BPE by recursive DuckDB queries inside each partition.

A partition's texts are split by the tokenizer's pattern and its distinct words become rows of
token positions. A recursive query joins neighbouring tokens to the merge table and contracts each
word's leftmost pair of least rank until no pair merges; an ordered aggregation of the tokens'
bytes decodes. In long words a turn contracts all places of that pair, from the left, wherever no merged
token could come before the next of them; so turns do not grow with the word. Texts are then put
together from their words. A worker remembers the most used words from chunk to chunk and task to task.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from itertools import chain, islice

import duckdb
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sylva.llm.common import give_back, remembered, text_batches
from sylva.llm.units import gathered, numbered, parts
from sylva.session import table

VOCABULARY = "byte_bpe_50k.tiktoken"
#: Code points of text handled at once, and words that a worker remembers from chunk to chunk; bounds on memory, not on texts.
CHUNK, REMEMBERED = 8_000_000, 250_000
#: Words of more bytes contract all places of a pair in a turn, which costs more a turn but needs fewer.
LONG_WORD = 64
#: Words, and rows over all turns, of one recursive query; long words go on in another where these end.
WORDS, ROWS = 24_000, 3_000_000
#: Fixed value: the public pattern, for which texts may be cut before single spaces.
SPACED = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SCHEMA = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"

_STEP = """
WITH RECURSIVE step(place, tok, turn) AS (
  SELECT w * 65536 + pos, tok, 0 FROM letters
  UNION ALL
  SELECT CASE WHEN place > spot THEN place - 1 ELSE place END, CASE WHEN place = spot THEN merged ELSE tok END, turn + 1
  FROM step JOIN (
    SELECT place // 65536 AS word, (min(merged * 65536 + place % 65536) // 65536)::INT AS merged,
      place // 65536 * 65536 + min(merged * 65536 + place % 65536) % 65536 AS spot
    FROM (SELECT s.place, m.merged FROM step s JOIN step n ON n.place = s.place + 1 JOIN merges m ON m.pair = s.tok::BIGINT * 65536 + n.tok)
    GROUP BY place // 65536
  ) best ON word = place // 65536
  WHERE place <> spot + 1
),
last AS (SELECT place // 65536 AS word, max(turn) AS turn FROM step GROUP BY ALL),
whole AS (SELECT word AS w, place % 65536 AS pos, tok FROM step JOIN last ON word = place // 65536 AND last.turn = step.turn)
SELECT w, list(tok ORDER BY pos) AS ids, string_agg(hex, '' ORDER BY pos) AS bytes FROM whole JOIN vocabulary ON id = tok GROUP BY w
"""
# hit: a pair of the word's least rank; run: hits one after the other, of which every second overlaps;
# early: a token merged here would merge again before the next hit, so that only the first is contracted.
_STEP_LONG = """
WITH RECURSIVE step AS (
  SELECT w, pos, tok, 0 AS turn FROM letters
  UNION ALL
  SELECT w, pos, CASE WHEN taken THEN merged ELSE tok END AS tok, turn + 1
  FROM (SELECT *, lag(taken, 1, false) OVER (PARTITION BY w ORDER BY i) AS gone FROM (
    SELECT *, hit AND CASE WHEN bool_or(early) OVER (PARTITION BY w) THEN nth = 1 ELSE (i - run) % 2 = 0 END AS taken FROM (
      SELECT h.*, row_number() OVER (PARTITION BY w, hit ORDER BY i) AS nth, max(CASE WHEN NOT hit THEN i ELSE 0 END) OVER (PARTITION BY w ORDER BY i) + 1 AS run,
        hit AND (l.merged IS NOT NULL OR r.merged IS NOT NULL OR t.merged IS NOT NULL) AS early
      FROM (
        SELECT *, coalesce(merged = best, false) AS hit, row_number() OVER (PARTITION BY w ORDER BY pos) AS i FROM (
          SELECT *, min(merged) OVER (PARTITION BY w) AS best FROM (
            SELECT s.*, m.merged FROM (SELECT *, lag(tok) OVER o AS before, lead(tok) OVER o AS next, lead(tok, 2) OVER o AS after FROM step WINDOW o AS (PARTITION BY w ORDER BY pos)) s
            LEFT JOIN merges m ON m.pair = s.tok::BIGINT * 65536 + s.next)
        ) WHERE best IS NOT NULL AND turn < $turns
      ) h
      LEFT JOIN merges l ON l.pair = CASE WHEN hit THEN before::BIGINT * 65536 + best END AND l.merged < best
      LEFT JOIN merges r ON r.pair = CASE WHEN hit THEN best::BIGINT * 65536 + after END AND r.merged < best
      LEFT JOIN merges t ON t.pair = CASE WHEN hit THEN best::BIGINT * 65536 + best END AND t.merged < best
    )
  )) WHERE NOT gone
)
SELECT w, pos, tok, turn FROM step JOIN (SELECT w AS word, max(turn) AS most FROM step GROUP BY ALL) ON w = word AND turn = most
"""
_DECODE = "SELECT w, list(tok ORDER BY pos) AS ids, string_agg(hex, '' ORDER BY pos) AS bytes FROM letters JOIN vocabulary ON id = tok GROUP BY w"


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


def default_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class Words:
    """Ids and bytes of distinct words, by one DuckDB connection and its merge table."""

    def __init__(self, ranks: dict[bytes, int]):
        if ranks and max(ranks.values()) >= 1 << 16:
            raise ValueError("ids of 65,536 and more do not fit the merge table's pairs")
        self.ranks, self.pieces = ranks, {i: t for t, i in ranks.items()}
        merges = [(ranks[t[:k]], ranks[t[k:]], i) for t, i in ranks.items() for k in range(1, len(t)) if t[:k] in ranks and t[k:] in ranks]
        self.con = duckdb.connect(config={"threads": 1, "memory_limit": "300MB", "temp_directory": ""})  # queries are kept small instead of spilling
        a, b, m = np.array(merges, np.int64).reshape(-1, 3).T
        self._table("merges", pa.table({"pair": a * 65536 + b, "merged": m}))
        self._table("vocabulary", pa.table({"id": pa.array(list(self.pieces), pa.int32()), "hex": [t.hex() for t in self.pieces.values()]}))
        self.single = np.array([ranks.get(bytes([x]), -1) for x in range(256)], np.int32)
        self.known: dict[bytes, int] = {}  # remembered words by number, and what encode() gave for them
        self.flat, self.size, self.back = np.empty(0, np.uint32), np.empty(0, np.int64), []
        self.used = np.empty(0, np.int64)

    def _table(self, name: str, data: pa.Table) -> None:
        self.con.register("incoming", data)
        self.con.execute(f"CREATE OR REPLACE TABLE {name} AS SELECT * FROM incoming")
        self.con.unregister("incoming")

    def _letters(self, words: list[bytes]) -> None:
        """The table letters: a row for each byte of each word, by its token."""
        length = np.array([len(w) for w in words])
        data = np.frombuffer(b"".join(words), np.uint8)
        starts = np.cumsum(length) - length
        self._table("letters", pa.table({"w": np.repeat(np.arange(len(words)), length), "pos": np.arange(len(data)) - np.repeat(starts, length) + 1, "tok": self.single[data]}))

    def contracted(self, words: list[bytes], long: bool) -> pa.Table:
        """w, ids and bytes of each word."""
        self._letters(words)
        if not long:
            return self.con.sql(_STEP).to_arrow_table().combine_chunks()
        turns = max(1, ROWS // sum(len(w) for w in words))
        while True:
            state = self.con.execute(_STEP_LONG, {"turns": turns}).to_arrow_table()
            most = pa.compute.max(state.column("turn")).as_py()
            self._table("letters", state.drop_columns(["turn"]))
            if most < turns:
                return self.con.sql(_DECODE).to_arrow_table().combine_chunks()

    def encode(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
        """The ids of all words, one after the other, how many each has, and the bytes that these stand for."""
        sizes, back = np.zeros(len(words), np.int64), [b""] * len(words)
        parts: list[tuple[np.ndarray, np.ndarray]] = []  # words and all their ids
        whole, rest = [], ([], [])
        for k, w in enumerate(words):
            if (i := self.ranks.get(w)) is not None:
                whole.append((k, i))
                back[k] = self.pieces[i]
            else:
                rest[len(w) > LONG_WORD].append(k)
        if whole:
            at, ids = np.array(whole, np.int64).T
            sizes[at] = 1
            parts.append((at, ids.astype(np.uint32)))
        for long in (False, True):
            length = np.array([len(words[k]) for k in rest[long]], np.int64)
            rows = np.cumsum(length * 100 if long else length * (length + 1) // 2)
            start = 0
            while start < len(length):
                stop = int(np.searchsorted(rows, ROWS + (rows[start - 1] if start else 0), side="right"))
                stop = min(max(stop, start + 1), start + WORDS)
                part = np.array(rest[long][start:stop])
                start = stop
                done = self.contracted([words[k] for k in part], long)
                tokens = done.column("ids").combine_chunks()
                at = part[done.column("w").to_numpy()]
                sizes[at] = pa.compute.list_value_length(tokens).to_numpy()
                parts.append((at, tokens.flatten().to_numpy().astype(np.uint32)))
                for k, text in zip(at.tolist(), done.column("bytes").to_pylist(), strict=True):
                    back[k] = bytes.fromhex(text)
        first = np.cumsum(sizes) - sizes
        flat = np.empty(int(sizes.sum()), np.uint32)
        for at, ids in parts:
            n = sizes[at]
            flat[np.arange(len(ids)) + np.repeat(first[at] - (np.cumsum(n) - n), n)] = ids
        return flat, sizes, back

    def number(self, words: list[bytes], times: np.ndarray) -> np.ndarray:
        """The numbers of different words, which stand so many times in the texts; flat, size and back then hold them all."""
        if len(self.known) > REMEMBERED:
            keep = np.sort(np.argsort(-self.used, kind="stable")[:REMEMBERED])
            names = list(self.known)
            self.known = {names[i]: k for k, i in enumerate(keep.tolist())}
            self.back = [self.back[i] for i in keep.tolist()]
            self.flat = self.flat[gathered(np.cumsum(self.size) - self.size, self.size, keep)]
            self.size, self.used = self.size[keep], self.used[keep] // 2
        had = len(self.known)
        out = numbered(words, self.known)
        flat, size, back = self.encode(list(islice(self.known, had, None)))
        self.flat, self.size, self.back = np.concatenate([self.flat, flat]), np.append(self.size, size), self.back + back
        self.used = np.append(self.used, np.zeros(len(size), np.int64))
        self.used[out] += times
        return out

    def decode(self, ids: list[list[int]]) -> list[bytes]:
        """The bytes of each list of ids, by an ordered aggregation."""
        length = np.array([len(x) for x in ids], np.int64)
        flat = np.concatenate([np.asarray(x, np.int32) for x in ids]) if len(ids) else np.empty(0, np.int32)
        self._table("letters", pa.table({"w": np.repeat(np.arange(len(ids)), length), "pos": np.arange(len(flat)), "tok": flat}))
        out = [b""] * len(ids)
        done = self.con.sql(_DECODE).to_arrow_table()
        for k, n, text in zip(done.column("w").to_pylist(), pa.compute.list_value_length(done.column("ids")).to_pylist(), done.column("bytes").to_pylist(), strict=True):
            if n != length[k]:
                raise ValueError("an id is not in the vocabulary")
            out[k] = bytes.fromhex(text)
        return out


@remembered
def words_of(path: str) -> Words:
    """What a worker remembers for all its tasks of this operator."""
    return Words(read_ranks(path))


def encode_texts(texts: list[str], words: Words, pattern: str) -> Iterator[tuple[np.ndarray, bytes]]:
    """Ids and decoded bytes of each text.

    With the public pattern white space only joins what follows as one leading space, so a text can be cut
    before single spaces between other characters; with others a text's words are its parts.
    """
    split = regex.compile(pattern).findall
    cut = parts if pattern == SPACED else lambda t: [t]
    heads: dict[str, int] = {}  # first parts, and those that a space leads, without it
    rests: dict[str, int] = {}
    codes = []
    for t in texts:
        first, *others = cut(t)
        codes.append((numbered([first], heads).astype(np.int32), numbered(others, rests).astype(np.int32)))
    shift = len(heads)
    known: dict[str, int] = {}
    of, count = [], np.empty(shift + len(rests), np.int64)  # the words of all parts, and how many each has
    simple = pattern == SPACED
    for k, u in enumerate(chain(heads, rests)):
        unit = u if k < shift else " " + u
        ws = [unit] if simple and u.isascii() and u.isalpha() else split(unit)
        count[k] = len(ws)
        of += [known.setdefault(w, len(known)) for w in ws]
    del heads, rests
    of, begin = np.array(of, np.int64), np.cumsum(count) - count
    parts_used = np.bincount(np.concatenate([c + k for pair in codes for c, k in zip(pair, (0, shift), strict=True)]), minlength=len(count)) if codes else count
    times = np.bincount(of, np.repeat(parts_used, count), len(known)).astype(np.int64)
    of = words.number([w.encode("utf-8", "surrogatepass") for w in known], times)[of]
    del known
    flat, size, back = words.flat, words.size, words.back
    first = np.cumsum(size) - size
    text_of = [back[of[i]] if n == 1 else b"".join([back[w] for w in of[i : i + n]]) for i, n in zip(begin.tolist(), count.tolist(), strict=True)]
    for head, rest in codes:
        c = np.append(head, rest + shift)
        ws = of[gathered(begin, count, c)]
        yield flat[gathered(first, size, ws)], b"".join(map(text_of.__getitem__, c.tolist()))


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list[str]]]:
    keys, texts, size = [], [], 0
    for batch in batches:
        for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            keys.append(k)
            texts.append(t or "")
            size += len(texts[-1])
            if size >= CHUNK:
                yield keys, texts
                keys, texts, size = [], [], 0
    if keys:
        yield keys, texts


def encode(docs: DataFrame, path: str | None = None, pattern: str | None = None, key: str = "doc_id", text: str = "text", with_ids: bool = False) -> DataFrame:
    """Token count and digests of the ids and of the decoded bytes for each row of docs.

    Null and empty texts have no tokens. Very long texts and words are encoded whole. Repeated rows and
    null keys each get a row; among equal ranks in a word the leftmost pair goes first. An empty table
    gives an empty result; other columns are ignored. with_ids adds the ids themselves.
    """
    path, pattern = path or default_path(), pattern or default_pattern()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, texts in _chunks(batches):
            words = words_of(path)
            rows = [(len(i), hashlib.sha256(i.astype("<u4").tobytes()).hexdigest(), hashlib.sha256(b).hexdigest(), i if with_ids else None) for i, b in encode_texts(texts, words, pattern)]
            n, sha, back, ids = zip(*rows, strict=True)
            out = [pa.array(keys, pa.int64()), pa.array(n, pa.int64()), pa.array(sha), pa.array(back)]
            if with_ids:
                out.append(pa.array([x.astype(np.int32) for x in ids], pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(out, names)
            del rows, n, sha, back, ids, out, keys, texts
            give_back()

    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] + ["ids"] * with_ids
    out = text_batches(docs).select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, SCHEMA + ", ids array<int>" * with_ids)
    return out.withColumnRenamed("doc_id", key)


def decode(ids: DataFrame, path: str | None = None, key: str = "doc_id") -> DataFrame:
    """The bytes of each row's ids; null ids are none. An id that the vocabulary lacks is an error."""
    path = path or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = None
        for batch in batches:
            words = words or Words(read_ranks(path))
            for start in range(0, batch.num_rows, 500):
                part = batch.slice(start, 500)
                data = words.decode([x or [] for x in part.column(1).to_pylist()])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(data, pa.binary())], ["key", "bytes"])

    return ids.select(F.col(key).cast("long").alias("key"), "ids").mapInArrow(run, "key bigint, bytes binary").withColumnRenamed("key", key)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The last stage: what training reads of each document of the mix, without its text.

    One row for each row, null texts, null keys and repeated rows included; very long texts are encoded whole, of
    equal ranks in a word the leftmost goes first; an empty table gives none, and no column's name can clash, as
    only doc_id and text are read.
    """
    return encode(docs)
