"""Operator 9: exact text likelihoods under a hidden Markov language model trained by Baum-Welch.

The model. Tokens are lower-cased words and one end per text. A chain of K latent states emits word classes, and a class
emits its words: P(word | state) = P(class | state) * P(word | class). Classes are a hash of the word, so the states'
tables have a fixed size (K * 16385 numbers, about 1 MB) at any vocabulary, which is what makes them safe to send to
every task; the end is a class of its own. A share U of all emissions, the Good-Turing share of words seen once, goes to
new words, evenly over classes. So P(word | class) is (1 - u) * count / total of the class, and u for a word never seen,
where u is what new words have of the class's emissions. Counts are those of all training words, however many.

Training. Expected counts of transitions and emissions are computed per partition by scaled forward and backward
passes and summed across partitions by Spark. Training texts fall by hash into blocks of 1/64, 1/64, 1/32, ... 1/2 of
all. Incremental EM: the counts of each block are kept, a pass over a block replaces its own, and the parameters follow
from the sum of all blocks' counts so far; small blocks are gone through several times, a block without texts changes
nothing. Then every training text is recounted in `full` whole passes. Long texts are trained on in runs of 256 tokens,
each of whose first states has its own distribution. Scoring is exact: the forward recursion over the whole sequence, in
which long texts are the product of the transfer matrices of their runs.

Words become numbers once: a table has each text's codes in its block's dictionary, and the dictionaries. Counts are
summed over the dictionaries' entries of a word, so a word costs a row per block, not per occurrence, and a frequent word
is pre-summed; one exchange brings a word's entries together, another takes the counts back to their blocks. A block
holds about 16 MB of text, or a single longer text; its dictionary is what one task collects.

Null and empty texts are the end alone; null ids count as the empty string's hash for the split; repeated rows are
scored (and counted) each; with no training text, N and V are 0 and the model is uniform over classes; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .storage import ship, stash
from .words import hash_words, rows

STATES, CLASSES, RUN, FULL = 6, 1 << 14, 256, 1
BLOCK_BYTES = 16 << 20
#: Up to which of 64 hash shares a block of training texts reaches, and how often it is gone through.
BLOCKS = ((0, 1, 4), (1, 2, 3), (2, 4, 2), (4, 8, 2), (8, 16, 1), (16, 32, 1), (32, 64, 1))
_BATCH = 512
#: Steps between rescalings: products of this many emissions stay far above the smallest double.
_RESCALE = 12


def _encode(batches):
    """A row per text (codes, classes) and per word of a block's dictionary."""
    serial = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 32
    for batch in batches:
        for part in rows(batch, "text", BLOCK_BYTES):
            words, at = hash_words(part.column(1))
            known, code = np.unique(words, return_inverse=True)
            kind = np.uint16 if len(known) <= 1 << 16 else np.uint32
            classes = (known % np.uint64(CLASSES)).astype(np.uint16)[code]
            code, n = code.astype(kind), len(part)
            train = ~np.array(part.column(2).to_pylist(), bool)
            count = np.bincount(code, np.repeat(train, np.diff(at)), len(known)).astype(np.int32)
            cut = lambda x: [x[a:b].tobytes() for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            learned = [c if t else None for c, t in zip(cut(classes), train.tolist(), strict=True)]  # others' follow from their codes
            size = pa.array(np.diff(at) + 1, pa.int64())
            none = lambda k, t: pa.nulls(k, t)
            wide = pa.array([kind().itemsize] * n, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [pa.array([serial] * n, pa.int64()), part.column(0), part.column(2), part.column(3), size, wide, pa.array(cut(code), pa.binary()), pa.array(learned, pa.binary()), none(n, pa.int32()), none(n, pa.int64()), none(n, pa.int32())],
                _COLUMNS,
            )
            m = len(known)
            yield pa.RecordBatch.from_arrays(
                [pa.array([serial] * m, pa.int64()), none(m, part.column(0).type), none(m, pa.bool_()), none(m, pa.int32()), none(m, pa.int64()), none(m, pa.int32()), none(m, pa.binary()), none(m, pa.binary()), pa.array(np.arange(m, dtype=np.int32)), pa.array(known.view(np.int64)), pa.array(count)],
                _COLUMNS,
            )
            serial += 1


_COLUMNS = ["block", "id", "held_out", "share", "n_tokens", "width", "codes", "classes", "place", "word", "n"]


def _runs(classes: list[np.ndarray]) -> tuple[list[np.ndarray], np.ndarray]:
    """Texts cut into runs, and whether a run begins its text."""
    out, first = [], []
    for c in classes:
        for i in range(0, len(c), RUN):
            out.append(c[i : i + RUN])
            first.append(i == 0)
    return out, np.array(first, bool)


def _expect(model: dict):
    def expect(batches):
        """Expected counts of a partition: rows (kind, key, one number a state)."""
        start, step, emit = model["start"], model["step"], model["emit"]
        begin, move, seen = np.zeros_like(start), np.zeros_like(step), np.zeros_like(emit)
        any_ = False
        for batch in batches:
            runs, first = _runs([np.append(np.frombuffer(x, np.uint16), CLASSES).astype(np.int64) for x in batch.column(0).to_pylist()])
            order = np.argsort([-len(r) for r in runs], kind="stable")
            for i in range(0, len(order), _BATCH):
                any_ = True
                pick = order[i : i + _BATCH]
                size = np.array([len(runs[j]) for j in pick])
                c = np.full((size[0], len(pick)), CLASSES)
                for col, j in enumerate(pick):
                    c[: size[col], col] = runs[j]
                alive = np.searchsorted(-size, -np.arange(size[0]), side="left").tolist()  # runs longer than t
                alpha = np.zeros((size[0], len(pick), STATES))
                opening = (~first[pick]).astype(int)
                for t in range(size[0]):
                    k = alive[t]
                    x = start[opening] if t == 0 else alpha[t - 1, :k] @ step
                    np.multiply(x, emit[c[t, :k]], out=alpha[t, :k])
                    if t % _RESCALE == _RESCALE - 1:
                        alpha[t, :k] /= alpha[t, :k].sum(axis=1, keepdims=True)
                beta = np.ones((len(pick), STATES))
                for t in range(size[0] - 1, -1, -1):
                    k = alive[t]
                    now, after = alpha[t, :k], beta[:k]
                    now *= after  # the posterior, up to a factor
                    now /= now.sum(axis=1, keepdims=True)
                    if t:
                        back = emit[c[t, :k]] * after
                        ahead = back @ step.T
                        before = alpha[t - 1, :k]
                        move += step * ((before / np.einsum("ij,ij->i", before, ahead)[:, None]).T @ back)
                        if t % _RESCALE == 0:
                            ahead /= ahead.sum(axis=1, keepdims=True)
                        beta[:k] = ahead
                    else:
                        np.add.at(begin, opening, now)
                flat = c.ravel()
                for s in range(STATES):
                    seen[:, s] += np.bincount(flat, alpha[:, :, s].ravel(), CLASSES + 1)
        if any_:
            used = np.flatnonzero(seen.sum(axis=1))
            kinds = np.repeat([0, 1, 2], [2, STATES, len(used)]).astype(np.int32)
            keys = np.concatenate([np.arange(2), np.arange(STATES), used]).astype(np.int32)
            values = np.concatenate([begin, move, seen[used]])
            yield pa.RecordBatch.from_arrays([pa.array(kinds), pa.array(keys), *[pa.array(values[:, s]) for s in range(STATES)]], ["kind", "key", *[f"s{s}" for s in range(STATES)]])

    return expect


def _gather(texts: DataFrame, model: dict) -> tuple[np.ndarray, ...]:
    """Expected counts of all texts: at most CLASSES + 1 + STATES + 2 rows of result."""
    schema = "kind int, key int, " + ", ".join(f"s{s} double" for s in range(STATES))
    parts = texts.select("classes").mapInArrow(_expect(model), schema)
    # rounded to a grid before they are added: sums are then the same in whatever order partitions arrive
    total = parts.groupBy("kind", "key").agg(*[F.sum(F.round(F.col(f"s{s}") * 65536).cast("long")).alias(f"s{s}") for s in range(STATES)]).toPandas()
    out = np.zeros((2, STATES)), np.zeros((STATES, STATES)), np.zeros((CLASSES + 1, STATES))
    for kind, into in enumerate(out):
        some = total[total.kind == kind]
        into[some.key.to_numpy()] = some[[f"s{s}" for s in range(STATES)]].to_numpy(float) / 65536
    return out


def _maximise(counts: tuple[np.ndarray, ...], base: np.ndarray, new: float) -> dict:
    begin, move, seen = counts
    norm = lambda x, axis: x / x.sum(axis=axis, keepdims=True)
    return {"start": norm(begin + 0.5, 1), "step": norm(move + 0.5 + 4 * np.eye(STATES), 1), "emit": _with_new(norm(seen + 64 * base[:, None], 0), new)}


def _with_new(emit: np.ndarray, new: float) -> np.ndarray:
    """Emissions of seen words' classes and the share of new words, which is even over classes."""
    out = (1 - new) * emit
    out[:-1] += new / CLASSES
    return out


def _first_guess(base: np.ndarray, new: float) -> dict:
    noise = np.exp(1.0 * np.random.default_rng(9).normal(size=(CLASSES + 1, STATES)))
    noise[-1] = 1
    emit = base[:, None] * noise
    return {"start": np.full((2, STATES), 1 / STATES), "step": np.full((STATES, STATES), 0.1 / STATES) + 0.9 * np.eye(STATES), "emit": _with_new(emit / emit.sum(axis=0), new)}


def log10_forward(classes: list[np.ndarray], model: dict) -> np.ndarray:
    """log10 P(class sequence) of each text, by the scaled forward recursion over the whole of it."""
    start, step, emit = model["start"], model["step"], model["emit"]
    out = np.zeros(len(classes))
    size = np.array([len(c) for c in classes])
    short, long_ = np.flatnonzero(size <= 2 * RUN), np.flatnonzero(size > 2 * RUN)
    short = short[np.argsort(-size[short], kind="stable")]
    for i in range(0, len(short), _BATCH):
        pick = short[i : i + _BATCH]
        n = size[pick]
        c = np.zeros((n[0], len(pick)), np.int64)
        for col, j in enumerate(pick):
            c[: n[col], col] = classes[j]
        state, alive = np.repeat(start[:1], len(pick), axis=0), np.searchsorted(-n, -np.arange(n[0]), side="left").tolist()
        for t in range(n[0]):
            k = alive[t]
            state[:k] = (state[:k] if t == 0 else state[:k] @ step) * emit[c[t, :k]]
            if t % _RESCALE == _RESCALE - 1:
                total = state[:k].sum(axis=1)
                out[pick[:k]] += np.log10(total)
                state[:k] /= total[:, None]
        out[pick] += np.log10(state.sum(axis=1))
    if len(long_):  # runs of all long texts side by side, as transfer matrices, then multiplied up text by text
        cuts = [(j, i) for j in long_ for i in range(0, size[j], RUN)]
        matrix, logs = np.empty((len(cuts), STATES, STATES)), np.zeros(len(cuts))
        order = sorted(range(len(cuts)), key=lambda q: -min(RUN, size[cuts[q][0]] - cuts[q][1]))
        for i in range(0, len(order), _BATCH // 4):
            pick = order[i : i + _BATCH // 4]
            n = np.array([min(RUN, size[cuts[q][0]] - cuts[q][1]) for q in pick])
            c = np.zeros((n[0], len(pick)), np.int64)
            for col, q in enumerate(pick):
                j, a = cuts[q]
                c[: n[col], col] = classes[j][a : a + RUN]
            m, alive = np.repeat(np.eye(STATES)[None], len(pick), axis=0), np.searchsorted(-n, -np.arange(n[0]), side="left").tolist()
            for t in range(n[0]):
                k = alive[t]
                m[:k] = (m[:k].reshape(-1, STATES) @ step).reshape(-1, STATES, STATES) * emit[c[t, :k], None, :]
                if t % _RESCALE == _RESCALE - 1:
                    total = m[:k].sum(axis=(1, 2))
                    logs[pick[:k]] += np.log10(total)
                    m[:k] /= total[:, None, None]
            matrix[pick] = m
        lead = start[0] @ np.linalg.inv(step)  # the first run's matrix holds a step before its first emission: undone here
        state, at = None, -1
        for q, (j, _) in enumerate(cuts):
            state = (lead if j != at else state) @ matrix[q]
            at = j
            total = state.sum()
            out[j] += np.log10(total) + logs[q]
            state = state / total
    return out


def _score(model: dict, n: int, v: int, ends: int, inside: tuple[np.ndarray, np.ndarray]):
    known_share, unseen = inside  # log10 of (1 - u) / total of a class, log10 of u

    def score(texts: pa.Table, dictionary: pa.Table) -> pa.Table:
        place = dictionary.column("place").to_numpy()
        c = np.zeros(int(place.max()) + 1 if len(place) else 0, np.int64)
        class_of = np.zeros_like(c)
        c[place], class_of[place] = dictionary.column("c").to_numpy(), dictionary.column("k").to_numpy()
        log_c = np.log10(np.maximum(c, 1))
        base_word = np.log10((c + 1) / (n + v + 1))
        base_end = np.log10((ends + 1) / (n + v + 1))
        widths = texts.column("width").to_pylist()
        classes, base, inner, known = [], [], [], []
        for w, raw in zip(widths, texts.column("codes").to_pylist(), strict=True):
            code = np.frombuffer(raw, np.uint16 if w == 2 else np.uint32)
            k = class_of[code]
            classes.append(np.append(k, CLASSES))
            base.append(base_word[code].sum() + base_end)
            seen = c[code] > 0
            inner.append(np.where(seen, log_c[code] + known_share[k], unseen[k]).sum())
            known.append(int(seen.sum()) + (ends > 0))
        whole = log10_forward(classes, model) + np.array(inner)
        return pa.table({"id": texts.column("id"), "held_out": texts.column("held_out"), "n_tokens": texts.column("n_tokens"), "n_known": pa.array(known, pa.int64()), "base_score": pa.array(np.array(base, float)), "score": pa.array(whole)})

    return score


def language_scores(docs: DataFrame, full: int = FULL, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, held_out, n_tokens, n_known, train_tokens, base_score (add-one unigram), score (log10 P of the text)."""
    ship(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    held = F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), F.lit(7)) == 2
    given = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), held.alias("held_out"), F.pmod(F.xxhash64(id_col), F.lit(64)).cast("int").alias("share"))
    coded = stash(given.mapInArrow(_encode, f"block long, id {kind}, held_out boolean, share int, n_tokens long, width int, codes binary, classes binary, place int, word long, n int"), "coded")
    texts, entries = coded.where("n_tokens is not null"), coded.where("place is not null")
    ends = texts.where("not held_out").count()
    # a row per word and block, with the word's count over all blocks
    word = Window.partitionBy("word")
    known = stash(
        entries.select(F.col("block").alias("of_block"), "place", F.pmod(F.col("word"), F.lit(CLASSES)).cast("short").alias("k"), F.sum("n").over(word).alias("c"), (F.row_number().over(word.orderBy("block")) == 1).alias("once")), "word-counts"
    )
    per_class = known.where("once and c > 0").groupBy("k").agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("v"), F.sum((F.col("c") == 1).cast("long")).alias("one")).toPandas()
    total, distinct, single = (np.zeros(CLASSES) for _ in range(3))
    for into, name in ((total, "n"), (distinct, "v"), (single, "one")):
        into[per_class.k.to_numpy(int)] = per_class[name].to_numpy(float)
    n, v = int(total.sum()) + ends, int(distinct.sum()) + (ends > 0)
    new = (single.sum() + 1) / (n + 2)  # the share of emissions that are new words
    fresh = new / CLASSES / (new / CLASSES + (1 - new) * total / max(n, 1))
    with np.errstate(divide="ignore"):
        inside = np.log10((1 - fresh) / np.maximum(total, 1)), np.log10(fresh)
    base = np.append(total, ends) if n else np.ones(CLASSES + 1)
    base = base / base.sum()

    model, train, kept = _first_guess(base, new), texts.where("not held_out"), {}
    for block in BLOCKS:
        low, high, times = block
        for _ in range(times):
            counts = _gather(train.where((F.col("share") >= low) & (F.col("share") < high)), model)
            if not counts[2].any():
                break
            kept[block] = counts
            model = _maximise(tuple(sum(x) for x in zip(*kept.values(), strict=True)), base, new)
    for _ in range(full if kept else 0):
        model = _maximise(_gather(train, model), base, new)

    scored = texts.select("block", "id", "held_out", "n_tokens", "width", "codes").groupBy("block").cogroup(known.drop("once").groupBy("of_block")).applyInArrow(
        _score(model, n, v, ends, inside), f"id {kind}, held_out boolean, n_tokens long, n_known long, base_score double, score double"
    )
    return scored.select(F.col("id").alias(id_col), "held_out", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", "score")
