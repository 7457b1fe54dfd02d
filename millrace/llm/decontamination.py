"""Operator 3: benchmark passages in documents, by latent semantic retrieval and sequence checks.

1. Words. The benchmark's words are the vocabulary; a document's words become their numbers (0: another word), written
   once, two bytes a word. Document frequencies over passages give the inverse document frequencies, positive for any word.
2. Latent space. Passages (48 words) are rows of a TF-IDF matrix A. One pass over all passages of all documents and of the
   benchmark sums A'(A O) and O'A'(A O) for a fixed Gaussian O, per partition and then across partitions; from these the
   driver has the randomised SVD's right singular vectors (Nystroem form). Both are tables of the vocabulary's size.
3. Candidates. Passages of 48 words, 24 apart, are projected with the singular values divided out, and compared by cosine
   with every passage (48 words at most) of every benchmark item.
4. Checks. A document is contaminated if a stretch of it has `same` (0.8) of the item's words in order, or, for paraphrases,
   `loose` (0.6) of them and `answer` (0.8) of the item's last sentence in order (longest common subsequences). Before any
   subsequence is computed, two bounds rule candidates out, which lose nothing: of an item's rarest words (over half of
   it) a stretch may lack no more than it may lack of the item, and it must hold `loose` of the item's words in some order.
   Then every stretch of a candidate's neighbourhood that meets the bound is tried.

Whole sequences are also looked up as such: an item whose words occur in a row is found by the hash of its first words and
confirmed word by word, whatever its length and however many documents hold it. Items of fewer than `least` words are
found in this way only, as parts of so few words occur by chance.

The benchmark is a query set against all rows: it is read in blocks of `block` items, and what a task is sent (vocabulary,
vectors) is bounded by a block. Words lie between white space and ASCII punctuation, are lower-cased and compared as
64-bit hashes; `first_word` counts in them.

Null and empty texts hold nothing; items without words are left out; ties of equal items are all reported; repeated rows
are merged into one result row per (document, item); null ids are reported as null; texts of any length are read whole;
empty tables give an empty result; other columns are ignored. `uncontaminated` keeps rows by their texts, so rows with
null or equal ids are judged each by its own text; its empty, null and repeated texts stay unless they hold an item.
"""

from __future__ import annotations

import re
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import ship, stash
from .words import MARKS, distinct, mix, rows
from .words import hash_words as _hash_words

WINDOW, STEP = 48, 24  # words of a passage, and from one to the next
ANCHOR = 5  # words by which whole sequences are looked up
RANK, SPARE = 64, 16
COSINE = 0.25
SAME, LOOSE, ANSWER, LEAST = 0.8, 0.6, 0.8, 8
#: The share of an item's words, the rarest ones, that rule stretches out; it is over the share that may be missing.
RAREST = 0.55
#: Words of text that a partition should have before it makes a table of the vocabulary's size.
WORDS_A_PART = 1 << 20


def hash_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Words between white space and ASCII punctuation: a comma more or less does not hide a passage."""
    return _hash_words(texts, breaks=MARKS)


def _codes(vocabulary: np.ndarray):
    width = np.uint16 if len(vocabulary) < 1 << 16 else np.uint32
    maybe = np.zeros(1 << 20, bool)
    maybe[vocabulary % np.uint64(1 << 20)] = True

    def number(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        words, at = hash_words(texts)
        code = np.zeros(len(words), width)
        hit = np.flatnonzero(maybe[words % np.uint64(1 << 20)])
        place = np.minimum(np.searchsorted(vocabulary, words[hit]), len(vocabulary) - 1)
        code[hit] = np.where(vocabulary[place] == words[hit], place + 1, 0)
        return code, at

    def codes(batches):
        for batch in batches:
            for part in rows(batch):
                code, at = number(part.column(1))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([code[a:b].tobytes() for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)], pa.binary())], ["id", "codes"])

    return number, codes, width


def _passages(code: np.ndarray, bounds: np.ndarray, words: int) -> np.ndarray:
    """The passage of each word, for texts at bounds cut every `words` words."""
    length = np.diff(bounds)
    inside = np.arange(len(code)) - np.repeat(bounds[:-1], length)
    per = -(-length // words)
    return np.repeat(np.cumsum(per) - per, length) + inside // words


def _unpack(column: pa.Array, width) -> tuple[np.ndarray, np.ndarray]:
    raw = column.to_pylist()
    bounds = np.concatenate([[0], np.cumsum([len(x) // width().itemsize for x in raw])]).astype(np.int64)
    return np.frombuffer(b"".join(raw), width), bounds


def _frequencies(size: int, width):
    def frequencies(batches):
        total, seen = np.zeros(size + 1, np.int64), 0
        for batch in batches:
            code, bounds = _unpack(batch.column(0), width)
            passage = _passages(code, bounds, WINDOW)
            seen += int((-(-np.diff(bounds) // (WINDOW))).sum())
            hit = code > 0
            pairs = distinct(passage[hit] * (size + 1) + code[hit])
            total += np.bincount(pairs % (size + 1), minlength=size + 1)
        total[0] = seen
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], ["word", "n"])

    return frequencies


def _by_passage(code, bounds, idf, words):
    """(passage, word, tf-idf) of the words of the vocabulary, by passage; rows have length 1."""
    hit = np.flatnonzero(code)
    key, tf = distinct(_passages(code, bounds, words)[hit] * len(idf) + code[hit], counts=True)
    passage, word = key // len(idf), key % len(idf)
    value = np.sqrt(tf) * idf[word]
    norm = np.sqrt(np.bincount(passage, value**2)) if len(passage) else value
    return passage, word, (value / norm[passage] if len(passage) else value).astype(np.float32)


def _runs_sum(matrix: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums of rows of one (sorted) key, and the keys."""
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    return (np.add.reduceat(matrix, first) if len(key) else matrix), key[first]


def _range(idf: np.ndarray, draw: np.ndarray, width):
    """A partition's share of A'(A O), a row per word."""

    def sketch(batches):
        z = np.zeros(draw.shape, np.float64)
        for batch in batches:
            code, bounds = _unpack(batch.column(0), width)
            at = 0
            while at < len(bounds) - 1:
                to = max(at + 1, int(np.searchsorted(bounds, bounds[at] + (1 << 18), side="right")) - 1)
                b = bounds[at : to + 1]
                passage, word, value = _by_passage(code[b[0] : b[-1]], b - b[0], idf, WINDOW)
                if len(word):
                    y, of = _runs_sum(draw[word] * value[:, None], passage)
                    order = np.argsort(word, kind="stable")
                    sums, used = _runs_sum(y[np.searchsorted(of, passage[order])] * value[order, None], word[order])
                    z[used] += sums
                at = to
        used = np.flatnonzero(np.abs(z).sum(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(list(z[used]), pa.list_(pa.float64()))], ["word", "z"])

    return sketch


def right_vectors(z: np.ndarray, draw: np.ndarray, rank: int) -> np.ndarray:
    """Right singular vectors over singular values, from Z = A'A O: the projection that whitens the latent space."""
    core = draw.astype(float).T @ z
    core = (core + core.T) / 2
    value, vector = np.linalg.eigh(core)
    good = value > value.max() * 1e-9 if len(value) and value.max() > 0 else value > 0
    if not good.any():
        return np.zeros((len(z), 1))
    half = z @ (vector[:, good] / np.sqrt(value[good]))
    u, s, _ = np.linalg.svd(half, full_matrices=False)
    keep = np.flatnonzero(s > s[0] * 1e-6)[:rank]
    return u[:, keep] / s[keep]


def lcs(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the longest common subsequence, a bit per word of a."""
    where: dict[int, int] = {}
    for i, x in enumerate(a.tolist()):
        where[x] = where.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for x in b.tolist():
        if m := where.get(x, 0):
            u = row & m
            row = ((row + u) | (row - u)) & full
    return len(a) - row.bit_count()


def check(item: np.ndarray, answer: int, near: np.ndarray, own: np.ndarray, rules: tuple) -> tuple[float, float, int] | None:
    """(share of the item's words in order, share of its answer's, first word) of the best stretch of near, or None.

    answer: where the item's last sentence begins; own: by word number, whether the item has the word; rules: the shares
    that are enough: the item's alone, or the item's and the answer's together. Stretches are a half longer than the item
    and a quarter of it apart; each that holds enough of the item's words in any order is tried.
    """
    same, loose, tail = rules
    slack = 2 + len(item) // 4
    wide = len(item) + 2 * slack
    met = np.concatenate([[0], np.cumsum(own[near])])
    begin = np.arange(0, max(1, len(near) - len(item) + slack), slack)
    held = met[np.minimum(begin + wide, len(near))] - met[begin]
    best = None
    for a in begin[held >= loose * len(item)].tolist():
        stretch = near[a : a + wide]
        share = lcs(item, stretch) / len(item)
        if share >= loose:
            end = lcs(item[answer:], stretch) / max(1, len(item) - answer)
            if share >= same or end >= tail:
                best = max(best or (0.0, 0.0, 0), (share, end, -a))
    return best and (best[0], best[1], -best[2])


class Sequences:
    """Whole items in texts: the hash of an item's first words retrieves it, the hash of all its words decides."""

    _FACTOR = 0xD6E8FEB86659FD93  # odd

    def __init__(self, items: list[tuple]):
        self.items = items
        by_length: dict[int, list[int]] = {}
        for k, (_, c, _) in enumerate(items):
            by_length.setdefault(min(ANCHOR, len(c)), []).append(k)
        self.tables = []
        for n, which in sorted(by_length.items()):
            key = np.array([self._hashes(items[k][1], n)[0] for k in which], np.uint64)
            order = np.argsort(key, kind="stable")
            maybe = np.zeros(1 << 20, bool)
            maybe[key % np.uint64(1 << 20)] = True
            self.tables.append((n, key[order], np.array(which)[order], maybe))

    def _hashes(self, code: np.ndarray, n: int) -> np.ndarray:
        """Of the n words from each place on: a polynomial in wrapping 64-bit arithmetic."""
        value, out = mix(code.astype(np.uint64), 71), np.zeros(max(0, len(code) - n + 1), np.uint64)
        for i in range(n):
            out = out * np.uint64(self._FACTOR) + value[i : i + len(out)]
        return out

    def find(self, code: np.ndarray, text_of: np.ndarray, bounds: np.ndarray):
        """(text, item, place): the first place of each item in each text."""
        texts, items, places = [], [], []
        for n, key, which, maybe in self.tables:
            h = self._hashes(code, n)
            at = np.flatnonzero(maybe[h % np.uint64(1 << 20)])
            lo, hi = np.searchsorted(key, h[at]), np.searchsorted(key, h[at], side="right")
            each = hi - lo
            k = which[np.repeat(lo, each) + np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)]
            texts.append(text_of[np.repeat(at, each)])
            items.append(k)
            places.append(np.repeat(at, each))
        if not texts:
            return []
        text, item, place = (np.concatenate(x).astype(np.int64) for x in (texts, items, places))
        fits = place + self.lengths()[item] <= bounds[text + 1]
        text, item, place = text[fits], item[fits], place[fits]
        out, done = [], set()
        for t, k, p in zip(text.tolist(), item.tolist(), place.tolist(), strict=True):
            if (t, k) not in done and np.array_equal(code[p : p + len(self.items[k][1])], self.items[k][1]):
                done.add((t, k))
                out.append((t, k, p))
        return out

    def lengths(self) -> np.ndarray:
        return np.array([len(c) for _, c, _ in self.items])


def _search(items: list[tuple], passages: tuple[np.ndarray, np.ndarray], idf: np.ndarray, project: np.ndarray, width, rules: tuple, least: int):
    """items: (number, codes, answer's start); passages: unit vectors of the items' passages, and whose they are."""
    cosine, loose = rules[0], rules[2]
    sizes = np.array([len(c) for _, c, _ in items])
    # an item's rarest words, a little over what a stretch may lack of it, and how many of them it must have
    needs, owners = np.zeros(len(items), np.int64), []
    for k, (_, c, _) in enumerate(items):
        order = np.argsort(-idf[c], kind="stable")
        some = np.unique(c[order[: max(1, int(np.ceil(RAREST * len(c))))]]).astype(np.int64)
        needs[k] = np.ceil(np.isin(c, some).sum() - (1 - loose) * len(c) - 1e-9)
        owners.append(some * len(items) + k)
    pairs = np.sort(np.concatenate(owners))
    holders, first_of = pairs % len(items), np.searchsorted(pairs // len(items), np.arange(len(idf) + 1))
    vectors, whose = passages[0][fit := sizes[passages[1]] >= least], passages[1][fit]
    project = (project * np.sqrt(len(project))).astype(np.float32) * idf[:, None].astype(np.float32)
    own, sequences = np.zeros(len(idf), bool), Sequences(items)

    def search(batches):
        for batch in batches:
            code, bounds = _unpack(batch.column(1), width)
            hits: dict[tuple[int, int], tuple] = {}
            piece = 0
            while piece < len(bounds) - 1:
                to = max(piece + 1, int(np.searchsorted(bounds, bounds[piece] + (1 << 18), side="right")) - 1)
                at = bounds[piece : to + 1]
                words, at = code[at[0] : at[-1]], at - at[0]
                text_of = np.repeat(np.arange(len(at) - 1), np.diff(at))
                for t, k, p in sequences.find(words, text_of, at):
                    hits[piece + t, k] = (1.0, 1.0, 1.0, p - int(at[t]))
                _similar(words, at, piece, hits)
                piece = to
            keys = sorted(hits)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array([r for r, _ in keys], pa.int64())), pa.array([items[k][0] for _, k in keys], pa.int64()), *[pa.array([hits[k][i] for k in keys], pa.float64()) for i in range(3)], pa.array([hits[k][3] for k in keys], pa.int64())],
                ["id", "item", "cosine", "lcs_share", "answer_share", "first_word"],
            )

    def _similar(words, at, piece, hits):
        """Candidates by cosine among the passages of texts at `at`, and their checks."""
        hit = np.flatnonzero(words)
        if not len(hit) or not len(vectors):
            return
        per = -(-np.diff(at) // STEP)
        unit_of = _passages(words, at, STEP)[hit]
        sums, used = _runs_sum(project[words[hit]], unit_of)
        latent = np.zeros((int(per.sum()) + 1, sums.shape[1]), np.float32)
        latent[used] = sums
        text_of = np.repeat(np.arange(len(per)), per)
        base = np.cumsum(per) - per
        two = np.append(text_of[1:] == text_of[:-1], False)  # a passage is a step's words and the next step's
        latent = latent[:-1] + np.where(two[:, None], latent[1:], 0)
        latent /= np.maximum(np.linalg.norm(latent, axis=1, keepdims=True), 1e-12)
        each = first_of[words[hit] + 1] - first_of[words[hit]]
        inside = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)
        # places of rarest words, by item
        span = len(words) + 1
        events = np.sort(holders[np.repeat(first_of[words[hit]], each) + inside] * span + np.repeat(hit, each))
        for s in range(0, len(latent), 4096):
            x, y = np.nonzero(latent[s : s + 4096] @ vectors.T >= cosine)
            x, k = x + s, whose[y]
            t = text_of[x]
            first = at[t] + (x - base[t]) * STEP
            lo, hi = np.maximum(first - 2 * sizes[k], at[t]), np.minimum(first + WINDOW + 2 * sizes[k], at[t + 1])
            enough = np.searchsorted(events, k * span + hi) - np.searchsorted(events, k * span + lo) >= needs[k]
            for i in np.flatnonzero(enough).tolist():
                row, item = piece + int(t[i]), int(k[i])
                if (row, item) in hits and hits[row, item][1] >= 0.999:
                    continue
                _, codes, cut = items[item]
                near = words[lo[i] : hi[i]]
                own[codes] = True
                found = check(codes, cut, near, own, rules[1:])
                own[codes] = False
                if found and ((row, item) not in hits or found[0] > hits[row, item][1]):
                    hits[row, item] = (float(latent[x[i]] @ vectors[y[i]]), found[0], found[1], int(lo[i] - at[t[i]]) + found[2])

    return search


_SENTENCE = re.compile(r"[.?!][\x20\x09-\x0D]+|\n")


def contaminated(docs: DataFrame, benchmark: DataFrame, block: int = 4096, cosine: float = COSINE, same: float = SAME, loose: float = LOOSE, answer: float = ANSWER, least: int = LEAST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, item_id, cosine, lcs_share, answer_share, first_word: a row for each document and benchmark item found in it."""
    spark = docs.sparkSession
    ship(spark)
    kind = docs.schema[id_col].dataType.simpleString()
    item_kind = benchmark.schema["item_id"].dataType.simpleString()
    schema = f"id {kind}, item long, cosine double, lcs_share double, answer_share double, first_word long"
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    numbered = stash(benchmark.where("text is not null").select("item_id", "text").withColumn("part", F.pmod(F.xxhash64("text", "item_id"), F.lit(max(1, -(-benchmark.count() // block))))), "items")
    found = []
    for (part,) in sorted(numbered.select("part").distinct().collect()):
        given = numbered.where(F.col("part") == part).orderBy("item_id", "text").collect()  # about `block` items
        items, vocabulary = [], np.unique(hash_words(pa.array([r.text for r in given], pa.string()))[0])
        if not len(vocabulary):
            continue
        number, codes, width = _codes(vocabulary)
        own, at = number(pa.array([r.text for r in given], pa.string()))
        names = []
        for k, r in enumerate(given):
            words = own[at[k] : at[k + 1]]
            if len(words):
                last = [m.end() for m in _SENTENCE.finditer(r.text.rstrip(" \t\r\n\v\f"))]
                tail = len(hash_words(pa.array([r.text[last[-1] :]]))[0]) if last else len(words)
                items.append((k, words, len(words) - tail))
                names.append((k, r.item_id))
        if not items:
            continue
        coded = stash(texts.mapInArrow(codes, f"id {kind}, codes binary"), "codes")
        counted = coded.select("codes").mapInArrow(_frequencies(len(vocabulary), width), "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).toPandas()
        df = np.zeros(len(vocabulary) + 1)
        df[counted.word.to_numpy()] = counted.n.to_numpy()
        passages = max(df[0], 1)
        idf = np.log1p(passages / (1 + df))
        idf[0] = 0
        draw = np.random.default_rng(3).normal(size=(len(idf), RANK + SPARE)).astype(np.float32)
        z = np.zeros(draw.shape)
        mine = np.array([w.tobytes() for _, w, _ in items], object)
        # a partition's share has the vocabulary's size: partitions of little text are read together
        parts = max(1, int(passages * WINDOW) // WORDS_A_PART)
        word, share = _total(coded.select("codes").coalesce(parts).mapInArrow(_range(idf, draw, width), "word long, z array<double>"))
        z[word] = share
        for b in _range(idf, draw, width)([pa.RecordBatch.from_arrays([pa.array(list(mine), pa.binary())], ["codes"])]):
            for word, row in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                z[word] += row
        project = right_vectors(z, draw, RANK)
        cuts = [(k, w[i : i + WINDOW]) for k, (_, w, _) in enumerate(items) for i in range(0, len(w), WINDOW)]
        vectors = np.stack([(project[w] * idf[w][:, None]).sum(axis=0) for _, w in cuts])
        vectors = (vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-12)).astype(np.float32)
        hits = coded.mapInArrow(_search(items, (vectors, np.array([k for k, _ in cuts])), idf, project, width, (cosine, same, loose, answer), least), schema)
        label = spark.createDataFrame(names, f"item long, item_id {item_kind}")
        found.append(hits.join(F.broadcast(label), "item").drop("item"))  # a row per item of the block
    if not found:
        return spark.createDataFrame([], f"{id_col} {kind}, item_id {item_kind}, cosine double, lcs_share double, answer_share double, first_word long")
    every = reduce(DataFrame.union, found)
    best = every.groupBy("id", "item_id").agg(F.max(F.struct("lcs_share", "answer_share", "cosine", "first_word")).alias("b"))
    return best.select(F.col("id").alias(id_col), "item_id", "b.cosine", "b.lcs_share", "b.answer_share", "b.first_word")


def uncontaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", **kw) -> DataFrame:
    """docs without the rows whose texts hold a benchmark item."""
    digest = F.md5(F.coalesce(F.col(text_col), F.lit("")).cast("binary"))
    found = contaminated(docs.select(digest.alias("digest"), F.col(text_col).alias("text")), benchmark, id_col="digest", **kw)
    found = stash(found.select("digest").distinct(), "leaks").alias("found")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), digest.alias("digest"))
    return rows.join(found, "digest", "left_anti").select("row.*")


def _total(parts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Partitions' word rows summed, in whole steps so that order does not matter: one row per vocabulary word at most."""
    width = RANK + SPARE
    total = parts.groupBy("word").agg(*[F.sum(F.round(F.col("z")[i] * float(1 << 24)).cast("long")).alias(f"z{i}") for i in range(width)]).toPandas()
    return total.word.to_numpy(), total[[f"z{i}" for i in range(width)]].to_numpy(float) / (1 << 24)
