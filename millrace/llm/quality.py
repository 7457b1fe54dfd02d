"""Operator 10: document quality by co-training a text view and a page-metadata view.

A document is good when its label says quality 1 and toxic 0. Two logistic classifiers see different views of it:

* text: which words (hashed) and word beginnings of three to five characters it has, which beginnings reach which shares
  of its words, how it is punctuated, and how often it repeats itself;
* metadata: language, source and length, and the pairs of language and source with length.

They are fitted on a bounded sample of labelled rows (`labelled`: those whose ids have the smallest hashes). In each round
both score all other documents, in Spark. Where a view is sure (its odds are calibrated on labelled rows kept out of its
training), the document counts as an example of that label for the other view: per feature of the other view, tasks count
its examples and Spark sums the counts. Features that examples of the two labels have at different rates are the other
view's evidence: a document's mean evidence is one more number that the view's next fit can use, and features with strong
evidence join those that the labelled rows found. So what any of all documents teaches reaches the other view, whether or
not a labelled row has it. At the end each view is calibrated (Platt) and the calibrated log odds are combined by a
logistic regression on the rows kept out. All documents are scored with the combination in one more pass over whole texts.
A bad row is rejected below `threshold`.

Features are made in the tasks that read the texts. The driver gets, of the sample's features, the useful ones, and a count
per feature at most. The model is a few tables of fixed size, at any input.

Null and empty texts have no words and are scored by their shape and metadata; null metadata is a value of its own; a
null id is scored as any row; repeated rows score alike; with no labels, or labels of one kind only, every document gets
that kind's share (0.5 without labels) and is kept; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import ship, stash
from .words import buffers, distinct, hash_words, mix, rows

WORDS, META = 1 << 18, 1 << 14
SHAPES = 12
#: Calibrated log odds from which a view labels rows for the other.
SURE = np.log(0.99 / 0.01)
#: Characters of word beginnings, the least share of a text's words that counts, and steps of half an octave from there.
HEADS, LEAST_SHARE, STEPS = (3, 4, 5), 1 / 256, 8
LABELLED, ROUNDS = 8000, 2
#: Evidence: least documents and log ratio of a feature, least deviations from an even rate, and the bound of one feature's.
EVIDENCE = (8, 1.0, 5.0, 4.0)


def _hash(values: list, seed: int) -> np.ndarray:
    """A hash of each value's text; a null is a value of its own."""
    words, at = hash_words(pa.array(["\x01" if v is None else f"\x02{v}".replace(" ", "_") for v in values], pa.string()))
    head = words[np.minimum(at[:-1], max(len(words) - 1, 0))]
    return mix(head, seed)


def features(part: pa.RecordBatch) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """For rows (id, text, lang, source): distinct word features, shapes, metadata features (a row of keys each)."""
    text = part.column(1)
    raw, offsets = buffers(text)
    words, at, heads = hash_words(text, prefix=HEADS)
    n = len(text)
    owner = np.repeat(np.arange(n), np.diff(at))
    found = [owner * WORDS + (words % np.uint64(WORDS)).astype(np.int64)]
    for head in heads:
        pairs, times = distinct(owner * WORDS + (head % np.uint64(WORDS)).astype(np.int64), counts=True)
        found.append(pairs)
        # a beginning used more than once also has a key for each step that its share of the words reaches
        often = np.flatnonzero((times > 1) & (times >= LEAST_SHARE * np.diff(at)[pairs // WORDS]))
        pairs, times = pairs[often], times[often]
        reached = np.minimum(2 * np.log2(times / (LEAST_SHARE * np.diff(at)[pairs // WORDS])) + 1e-9, STEPS - 1).astype(np.int64) + 1
        step = np.arange(reached.sum()) - np.repeat(np.cumsum(reached) - reached, reached)
        pairs = np.repeat(pairs, reached)
        found.append(pairs // WORDS * WORDS + (mix(((pairs % WORDS) * STEPS + step).astype(np.uint64), 57) % np.uint64(WORDS)).astype(np.int64))
    both = distinct(np.concatenate(found))
    bounds = np.searchsorted(both, np.arange(n + 1) * WORDS)
    sets = [both[a:b] % WORDS for a, b in zip(bounds[:-1], bounds[1:], strict=True)]

    size, count = np.diff(offsets).astype(float), np.diff(at).astype(float)
    share = lambda mask: np.array([mask[a:b].sum() for a, b in zip(offsets[:-1], offsets[1:], strict=True)]) / np.maximum(size, 1)
    kinds = np.zeros(256, np.uint8)
    for k, chars in enumerate(("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "!", "#$%&*@^~", "|<>{}[]=_\\/", "0123456789", ".,;:?'\"()-")):
        kinds[list(chars.encode())] = k + 1
    kind = kinds[raw]
    again = np.zeros(len(words), bool)
    again[1:] = words[1:] == words[:-1]
    again[at[:-1][at[:-1] < len(words)]] = False
    runs = np.bincount(owner, again, n) / np.maximum(count, 1)
    own = distinct(mix(words, 58) >> np.uint64(24) | owner.astype(np.uint64) << np.uint64(40))
    variety = np.bincount((own >> np.uint64(40)).astype(np.int64), minlength=n) / np.maximum(count, 1)
    shapes = [share(kind == k) for k in range(1, 7)] + [runs, np.minimum(variety * np.sqrt(count), 20) / 10, np.log1p(count) / 10, np.minimum(size / np.maximum(count, 1), 20) / 10, (count == 0).astype(float), np.ones(n)]
    shapes = np.stack([np.sqrt(s) if i < 6 else s for i, s in enumerate(shapes)], axis=1)

    lang, source = _hash(part.column(2).to_pylist(), 51), _hash(part.column(3).to_pylist(), 52)
    length = mix(np.floor(np.log2(np.maximum(size, 1))).astype(np.uint64), 53)
    meta = np.stack([lang, source, length, mix(lang ^ length, 54), mix(source ^ length, 55), mix(lang + source, 56)], axis=1)
    return sets, shapes, (meta % np.uint64(META)).astype(np.int64)


def _sample(batches):
    for batch in batches:
        for part in rows(batch):
            sets, shapes, meta = features(part)
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(4), part.column(5), pa.array([s.astype(np.int32).tobytes() for s in sets], pa.binary()), pa.array(list(shapes), pa.list_(pa.float64())), pa.array(list(meta), pa.list_(pa.int64()))],
                ["id", "good", "held", "words", "shapes", "meta"],
            )


class Counts:
    """Documents and bad documents by key, of a view with so many keys."""

    def __init__(self, keys: int):
        self.n, self.bad, self.rows, self.bad_rows = np.zeros(keys, np.int64), np.zeros(keys, np.int64), 0, 0

    def add(self, sets, bad) -> None:
        """sets: a row's distinct keys; bad: whether it is a bad document."""
        for s, v in zip(sets, bad, strict=True):
            self.n[s] += 1
            if v:
                self.bad[s] += 1
        self.rows, self.bad_rows = self.rows + len(bad), self.bad_rows + int(np.sum(bad))

    def table(self, view: int) -> pa.RecordBatch:
        used = np.flatnonzero(self.n)
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(used) + 1, view, np.int32)), pa.array(np.append(used, -1)), pa.array(np.append(self.n[used], self.rows)), pa.array(np.append(self.bad[used], self.bad_rows))], ["view", "key", "n", "bad"])


def _summed(parts: DataFrame) -> tuple[Counts, Counts]:
    """Partitions' counts of both views, summed by Spark: at most WORDS + META + 2 rows of result."""
    total = parts.groupBy("view", "key").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")).toPandas()
    out = Counts(WORDS), Counts(META)
    for view, into in enumerate(out):
        some = total[total["view"] == view]
        key, n, bad = (some[c].to_numpy(np.int64) for c in ("key", "n", "bad"))
        real = key >= 0
        into.n[key[real]], into.bad[key[real]] = n[real], bad[real]
        into.rows, into.bad_rows = int(n[~real].sum()), int(bad[~real].sum())
    return out


_COUNTS = "view int, key long, n long, bad long"


def _count_labelled(batches):
    words = Counts(WORDS)
    for batch in batches:
        words.add([np.frombuffer(w, np.int32) for w in batch.column(0).to_pylist()], np.array(batch.column(1).to_pylist(), float) < 0.5)
    yield words.table(0)


def _deviations(c: Counts) -> np.ndarray:
    """By key: how many standard deviations its bad documents are from the share of all."""
    rate = c.bad_rows / max(c.rows, 1)
    return (c.bad - c.n * rate) / np.sqrt(np.maximum(c.n * rate * (1 - rate), 1e-9))


def _evidence(c: Counts) -> np.ndarray:
    """By key: the log of its rate among good examples over that among bad ones; 0 where that may be chance."""
    least, strong, deviations, most = EVIDENCE
    good, bad = c.n - c.bad, c.bad
    if not c.bad_rows or c.bad_rows == c.rows:
        return np.zeros(len(c.n), np.float32)
    ratio = np.log((good + 0.5) / (c.rows - c.bad_rows + 1)) - np.log((bad + 0.5) / (c.bad_rows + 1))
    sound = (c.n >= least) & (np.abs(ratio) >= strong) & (np.abs(_deviations(c)) >= deviations)
    return np.where(sound, np.clip(ratio, -most, most), 0).astype(np.float32)


def _mean_evidence(table: np.ndarray, sets) -> np.ndarray:
    """Each row's evidence, over the features that have some."""
    out = np.zeros(len(sets))
    for i, s in enumerate(sets):
        x = table[s]
        out[i] = x.sum() / (np.count_nonzero(x) + 3)
    return out


def _chosen_features(useful: np.ndarray, text: np.ndarray, page: np.ndarray):
    """Of the sample's rows: their useful words, and both views' mean evidence."""

    def choose(batches):
        for batch in batches:
            sets = [np.frombuffer(w, np.int32) for w in batch.column(3).to_pylist()]
            meta = [np.array(m) for m in batch.column(5).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(i) for i in (0, 1, 2)], pa.array([s[useful[s]].tobytes() for s in sets], pa.binary()), batch.column(4), batch.column(5), pa.array(_mean_evidence(text, sets)), pa.array(_mean_evidence(page, meta))],
                ["id", "good", "held", "words", "shapes", "meta", "text_evidence", "page_evidence"],
            )

    return choose


class View:
    """A logistic classifier on sparse rows (keys with value 1) and dense ones, fitted on the driver's bounded sample.

    The last dense number is the mean evidence, a log ratio: its coefficient is 1 unless the rows tell otherwise.
    """

    def __init__(self, keys: int, dense: int):
        self.w, self.d = np.zeros(keys), np.append(np.zeros(dense - 1), 1.0)

    def raw(self, sets, dense) -> np.ndarray:
        return np.array([self.w[s].sum() for s in sets]) + dense @ self.d

    def fit(self, sets, dense, y, steps: int = 400, rate: float = 0.1, decay: float = 2e-4):
        """Adam on the whole (bounded) training set; classes are weighted towards balance."""
        seen = np.zeros(len(self.w), bool)
        for s in sets:
            seen[s] = True
        used, place = np.flatnonzero(seen), (np.cumsum(seen) - 1).astype(np.int32)
        # rows are gone through in pieces, so that the driver holds four bytes a key
        pieces = []
        for i in range(0, len(sets), 1024):
            some = sets[i : i + 1024]
            pieces.append((slice(i, i + len(some)), place[np.concatenate(some)], np.repeat(np.arange(len(some), dtype=np.int32), [len(s) for s in some]), len(some)))
        weight = np.sqrt(np.where(y > 0.5, 0.5 / max(y.mean(), 1e-3), 0.5 / max(1 - y.mean(), 1e-3))) / len(y)
        start = np.concatenate([self.w[used], self.d])
        x = start.copy()
        first, second = np.zeros_like(x), np.zeros_like(x)
        for t in range(1, steps + 1):
            g, words = np.zeros(len(sets)), np.zeros(len(used))
            for at, key, row, size in pieces:
                raw = np.bincount(row, x[key], size) + dense[at] @ x[len(used) :]
                g[at] = weight[at] * (1 / (1 + np.exp(-np.clip(raw, -30, 30))) - y[at])
                words += np.bincount(key, g[at][row], len(used))
            grad = np.concatenate([words, dense.T @ g]) + decay * (x - start)
            first, second = 0.9 * first + 0.1 * grad, 0.99 * second + 0.01 * grad * grad
            x -= rate * (1 - t / (steps + 1)) * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.99**t)) + 1e-8)
        self.w[used], self.d[:] = x[: len(used)], x[len(used) :]
        return self


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Coefficients of a small logistic regression (last: constant), by Newton steps."""
    x = np.column_stack([x, np.ones(len(x))])
    b = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(b)), x.T @ (p - y) + ridge * b)
        b -= step
        if np.abs(step).max() < 1e-9:
            break
    return b


def fit_views(sample, useful: np.ndarray, text_evidence: np.ndarray, page_evidence: np.ndarray) -> dict:
    """Both views' tables, calibrations and combination, from the sample's rows (good, held, words, shapes, meta, evidence)."""
    y, held = sample.good.to_numpy(float), sample.held.to_numpy(bool)
    if held.all() or not held.any() or len(set(y[~held])) < 2:
        held = np.arange(len(y)) % 2 == 0
    sets = [np.frombuffer(w, np.int32) for w in sample.words]
    meta = list(np.array(sample.meta.tolist(), np.int64).reshape(-1, 6))
    dense = np.column_stack([np.array(sample.shapes.tolist(), float).reshape(-1, SHAPES), sample.text_evidence.to_numpy(float)])
    flat = np.column_stack([np.ones(len(y)), sample.page_evidence.to_numpy(float)])
    train, kept_out = np.flatnonzero(~held), np.flatnonzero(held)
    pick = lambda many, at: [many[i] for i in at]
    text = View(WORDS, SHAPES + 1).fit(pick(sets, train), dense[train], y[train])
    page = View(META, 2).fit(pick(meta, train), flat[train], y[train])
    raw = np.stack([text.raw(pick(sets, kept_out), dense[kept_out]), page.raw(pick(meta, kept_out), flat[kept_out])], axis=1)
    platt = [_logistic(raw[:, [k]], y[kept_out]) for k in range(2)]
    odds = np.stack([raw[:, k] * platt[k][0] + platt[k][1] for k in range(2)], axis=1)
    w = np.where(useful, text.w, 0).astype(np.float32)
    return {"words": w, "shapes": text.d, "meta": page.w, "constant": page.d, "platt": platt, "joint": _logistic(odds, y[kept_out]), "text_evidence": text_evidence, "page_evidence": page_evidence}


def view_odds(model: dict, sets, shapes: np.ndarray, meta: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both views' calibrated log odds of rows."""
    x = np.array([model["words"][s].sum() for s in sets], float) + shapes @ model["shapes"][:-1] + model["shapes"][-1] * _mean_evidence(model["text_evidence"], sets)
    u = model["meta"][meta].sum(axis=1) + model["constant"][0] + model["constant"][1] * _mean_evidence(model["page_evidence"], meta)
    return model["platt"][0][0] * x + model["platt"][0][1], model["platt"][1][0] * u + model["platt"][1][1]


def _exchange(model: dict):
    """A partition's pseudo-labels: what each view's sure documents are examples of for the other."""

    def exchange(batches):
        words, metas = Counts(WORDS), Counts(META)
        for batch in batches:
            for part in rows(batch):
                sets, shapes, meta = features(part)
                free = ~np.array(part.column(4).to_pylist(), bool)
                text, page = view_odds(model, sets, shapes, meta)
                by_page, by_text = np.flatnonzero(free & (np.abs(page) >= SURE)), np.flatnonzero(free & (np.abs(text) >= SURE))
                words.add([sets[i] for i in by_page], page[by_page] < 0)
                metas.add([np.unique(meta[i]) for i in by_text], text[by_text] < 0)
        yield words.table(0)
        yield metas.table(1)

    return exchange


def _scorer(model: dict, threshold: float, columns: int):
    def score(batches):
        for batch in batches:
            for part in rows(batch, "_text"):
                view = pa.RecordBatch.from_arrays([part.column(columns - 4 + i) for i in range(4)], ["id", "text", "lang", "source"])
                if "prior" in model:
                    p = t = m = np.full(len(part), model["prior"])
                    keep = np.ones(len(part), bool)
                else:
                    t, m = view_odds(model, *features(view))
                    j = model["joint"]
                    p, t, m = (1 / (1 + np.exp(-np.clip(v, -50, 50))) for v in (j[0] * t + j[1] * m + j[2], t, m))
                    keep = p >= threshold
                yield pa.RecordBatch.from_arrays([*[part.column(i) for i in range(columns - 4)], pa.array(p), pa.array(t), pa.array(m), pa.array(keep)], [*part.schema.names[: columns - 4], "_quality", "_text_view", "_page_view", "_keep"])

    return score


def fit_quality(docs: DataFrame, labels: DataFrame, labelled: int = LABELLED, rounds: int = ROUNDS, id_col: str = "doc_id") -> dict:
    """The co-trained model. Takes at most `labelled` labelled rows to the driver, as their useful features."""
    ship(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    turn = F.xxhash64(F.lit(10), F.col("id"))
    good = F.when(F.coalesce(F.col("quality") == 1, F.lit(False)) & ~F.coalesce(F.col("toxic") == 1, F.lit(False)), 1.0).otherwise(0.0)
    marks = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("id")).agg(F.min(good).alias("good"))
    given = docs.select(F.col(id_col).alias("id"), *[F.col(c).cast("string").alias(c) for c in ("text", "lang", "source")])
    # ids only are ordered and joined; the texts of the chosen ones, bounded in number, are then looked up
    chosen = stash(marks.join(given.select("id").distinct(), "id").orderBy(turn, "id").limit(labelled).withColumn("held", F.pmod(F.xxhash64(F.lit(11), "id"), F.lit(4)) == 0), "quality-chosen")
    of_kind = {r.good: r.n for r in chosen.groupBy("good").agg(F.count(F.lit(1)).alias("n")).collect()}
    if min(of_kind.get(0.0, 0), of_kind.get(1.0, 0)) < 4:
        return {"prior": of_kind.get(1.0, 0) / sum(of_kind.values()) if of_kind else 0.5}
    mine = given.join(F.broadcast(chosen), "id").groupBy("id", "good", "held").agg(F.min(F.struct("text", "lang", "source")).alias("r"))
    mine = mine.select("id", "r.text", "r.lang", "r.source", "good", "held").mapInArrow(_sample, f"id {kind}, good double, held boolean, words binary, shapes array<double>, meta array<long>")
    sample = stash(mine, "quality-sample")
    labels_of_words = _summed(sample.where("not held").select("words", "good").mapInArrow(_count_labelled, _COUNTS))[0]
    found = (labels_of_words.n >= 4) & (np.abs(_deviations(labels_of_words)) >= 3)
    others = given.join(F.broadcast(chosen.select("id", F.lit(True).alias("mine"))), "id", "left").select("id", "text", "lang", "source", F.coalesce("mine", F.lit(False)).alias("mine"))
    text, page = np.zeros(WORDS, np.float32), np.zeros(META, np.float32)
    for turn_no in range(rounds + 1):
        useful = found | (text != 0)
        schema = f"id {kind}, good double, held boolean, words binary, shapes array<double>, meta array<long>, text_evidence double, page_evidence double"
        model = fit_views(sample.mapInArrow(_chosen_features(useful, text, page), schema).toPandas().sort_values("id", ignore_index=True), useful, text, page)
        if turn_no < rounds:
            text, page = (_evidence(c) for c in _summed(others.mapInArrow(_exchange(model), _COUNTS)))
    return model


def score_quality(docs: DataFrame, model: dict, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """docs with _quality (probability of good), _text_view, _page_view (calibrated) and _keep; one pass, no shuffle."""
    ship(docs.sparkSession)
    names = [f"_c{i}" for i in range(len(docs.columns))]
    inner = docs.toDF(*names)
    by = dict(zip(docs.columns, names, strict=True))
    inner = inner.select(*names, F.col(by[id_col]).cast("string").alias("_id"), F.col(by[text_col]).alias("_text"), F.col(by[lang_col]).cast("string").alias("_lang"), F.col(by[source_col]).cast("string").alias("_source"))
    schema = ", ".join([f"{n} {f.dataType.simpleString()}" for n, f in zip(names, docs.schema.fields, strict=True)] + ["_quality double, _text_view double, _page_view double, _keep boolean"])
    scored = inner.mapInArrow(_scorer(model, threshold, len(names) + 4), schema)
    return scored.toDF(*docs.columns, "_quality", "_text_view", "_page_view", "_keep")


def quality_scores(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """doc_id, quality (probability), text_view, page_view, kept; docs has doc_id, text, lang, source."""
    narrow = docs.select("doc_id", "text", "lang", "source")
    scored = score_quality(narrow, fit_quality(narrow, labels), threshold)
    return scored.select("doc_id", F.col("_quality").alias("quality"), F.col("_text_view").alias("text_view"), F.col("_page_view").alias("page_view"), F.col("_keep").alias("kept"))
