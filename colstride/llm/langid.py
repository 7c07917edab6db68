"""Language identification with string kernels: presence of blended character n-grams, Nystroem
landmarks and one-versus-rest kernel ridge regression, scored by batched matrix products.

The kernel of two windows of text is, for n-grams of one, two and three characters, the number of
distinct ones in common over the root of the product of both numbers of distinct ones, blended. Only
n-grams of a landmark can be common to it, so those of the landmarks are all the vocabulary there is. The
regression needs sums over all windows, which the executors add up; the prediction is linear in presence,
so weights of landmarks fold into weights of n-grams.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from . import _shared as S
from ._text import batches, mix

#: The model is fitted on at most so many labelled documents of each language, drawn by a hash of id and
#: text, by all windows of each; so many windows become landmarks, however many languages there are.
SAMPLE, LANDMARKS = 200, 160
#: Places of a window; characters of a block: longer texts are taken block by block.
WINDOW, BLOCK = 1024, 1 << 18
#: Weights of the 1-, 2- and 3-gram kernels in the blend, and the ridge.
BLEND, RIDGE = (0.2, 0.4, 0.4), 1e-2
#: The label of texts without a letter.
UNDETERMINED = "und"
#: Windows in one matrix; entries of a table that finds n-grams by their number instead of by search.
ROWS, MOST_TABLE = 256, 1 << 24
#: Tasks that add up the sums of the regression.
TASKS = 16

_letters: list[np.ndarray] = []


def is_letter() -> np.ndarray:
    """For each code point whether it is a letter."""
    if not _letters:
        _letters.append(np.array([chr(c).isalpha() for c in range(0x110000)]))
    return _letters[0]


@dataclass
class Windows:
    """Windows of some texts: ``text_of`` each window, ``window`` of each place, ``marks`` (a letter's
    code point or 0 for a boundary) and ``ends`` (whether a 2-gram, a 3-gram ends at a place)."""

    text_of: np.ndarray
    window: np.ndarray
    marks: np.ndarray
    ends: tuple[np.ndarray, np.ndarray]

    @property
    def letters(self) -> np.ndarray:
        return np.bincount(self.window[self.marks > 0], minlength=len(self.text_of))


def windows(texts: list[str | None]) -> Iterator[Windows]:
    """The windows of all texts, in parts.

    A text is lower-cased, every run of non-letters becomes one boundary, and boundaries stand at both
    ends. Windows of ``WINDOW`` places cover it whole, so that a text in several languages goes to the one
    it has most of. Texts are cut after every ``BLOCK`` characters.
    """
    blocks, owner = [], []
    for i, t in enumerate(texts):
        low = (t or "").lower()
        for k in range(0, max(1, len(low)), BLOCK):
            blocks.append(low[k : k + BLOCK])
            owner.append(i)
    for k, end in batches(blocks, 400_000):  # type: ignore[arg-type]
        some = blocks[k:end]
        # A non-letter between texts keeps their n-grams apart.
        codes = np.frombuffer("".join("\n" + t + "\n" for t in some).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        block = np.repeat(np.arange(len(some)), [len(t) + 2 for t in some])
        marks = np.where(is_letter()[codes], codes, 0)
        keep = np.ones(len(marks), dtype=bool)
        keep[1:] = (marks[1:] != 0) | (marks[:-1] != 0) | (block[1:] != block[:-1])
        marks, block = marks[keep].astype(np.int64), block[keep]
        fresh = np.ones(len(marks), dtype=bool)
        fresh[1:] = block[1:] != block[:-1]
        two = ~fresh
        three = two.copy()
        # None with a boundary inside, and none over the start of a text.
        three[1:] &= two[:-1] & (marks[:-1] != 0)
        sizes = np.bincount(block, minlength=len(some))
        counts = -(-sizes // WINDOW)
        first = np.cumsum(counts) - counts
        inside = np.arange(len(marks)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        yield Windows(np.repeat(np.array(owner[k:end]), counts), first[block] + inside // WINDOW, marks, (two, three))


def grams(w: Windows, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(window, code) of every n+1-gram; a code packs three code points."""
    m = w.marks
    if n == 0:
        at = np.flatnonzero(m)
        return w.window[at], m[at]
    at = np.flatnonzero(w.ends[n - 1])
    code = m[at - 1] << 21 | m[at]
    return w.window[at], code | m[at - 2] << 42 if n == 2 else code


class Index:
    """Numbers of known keys below ``size``; others get the number of keys."""

    def __init__(self, keys: np.ndarray, size: int):
        self.keys, self.table = keys, None
        if size <= MOST_TABLE:
            self.table = np.full(size, len(keys), dtype=np.int32)
            self.table[keys] = np.arange(len(keys))

    def __call__(self, wanted: np.ndarray) -> np.ndarray:
        if self.table is not None:
            return self.table[wanted]
        if not len(self.keys):
            return np.zeros(len(wanted), dtype=np.int64)
        at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        return np.where(self.keys[at] == wanted, at, len(self.keys))


class Vocabulary:
    """The n-grams of the landmarks; finds them at all places of texts."""

    def __init__(self, codes: list[np.ndarray]):
        self.codes = [np.unique(c) for c in codes]
        mask = (1 << 21) - 1
        # Prefixes of 3-grams count as 2-grams that can be found, though no landmark need hold them.
        pairs = np.unique(np.concatenate([self.codes[1], self.codes[2] >> 21]))
        letters = np.unique(np.concatenate([self.codes[0], pairs >> 21, pairs & mask, self.codes[2] & mask]))
        self.symbol = np.full(0x110000, len(letters), dtype=np.int32)
        self.symbol[letters] = np.arange(len(letters))
        width = self.width = len(letters) + 1
        symbol = lambda c: self.symbol[c].astype(np.int64)
        self.one = np.append(np.searchsorted(self.codes[0], letters), len(self.codes[0]))
        self.one[:-1][~np.isin(letters, self.codes[0])] = len(self.codes[0])
        self.pair = Index(np.sort(symbol(pairs >> 21) * width + symbol(pairs & mask)), width * width)
        number = lambda c: self.pair(symbol(c >> 21) * width + symbol(c & mask)).astype(np.int64)
        self.two = np.full(len(pairs) + 1, len(self.codes[1]))
        self.two[number(self.codes[1])] = np.arange(len(self.codes[1]))
        keys = number(self.codes[2] >> 21) * width + symbol(self.codes[2] & mask)
        order = np.argsort(keys)
        self.triple = Index(keys[order], (len(pairs) + 1) * width)
        self.three = np.append(order, len(self.codes[2]))

    def find(self, w: Windows) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(window, number of each n+1-gram, distinct ones of each window that aren't known) by order."""
        s = self.symbol[w.marks].astype(np.int64)
        at1, at2, at3 = np.flatnonzero(w.marks), np.flatnonzero(w.ends[0]), np.flatnonzero(w.ends[1])
        pair = np.full(len(s), len(self.two) - 1, dtype=np.int64)
        pair[at2] = self.pair(s[at2 - 1] * self.width + s[at2])
        numbers = self.one[s[at1]], self.two[pair[at2]], self.three[self.triple(pair[at3 - 1] * self.width + s[at3])]
        out = []
        for n, (at, found) in enumerate(zip((at1, at2, at3), numbers, strict=True)):
            new = np.flatnonzero(found == len(self.codes[n]))
            code = np.zeros(len(new), dtype=np.uint64)
            for j in range(n + 1):
                code = mix(code + w.marks[at[new] - j].astype(np.uint64) + np.uint64(j + 1))
            pairs = np.unique(np.stack([w.window[at[new]].astype(np.uint64), code]), axis=1) if len(new) < 1000 else None
            if pairs is None:
                order = np.lexsort((code, w.window[at[new]]))
                a, b = w.window[at[new]][order], code[order]
                keep = np.ones(len(a), dtype=bool)
                keep[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
                others = a[keep]
            else:
                others = pairs[0].astype(np.int64)
            out.append((w.window[at], found, np.bincount(others, minlength=len(w.text_of))))
        return out

    def products(self, w: Windows, factors: list[np.ndarray]) -> np.ndarray:
        """The blend of presence times ``factors`` (a row for each known n-gram, by order) over the root of
        the number of distinct n-grams, for each window."""
        found = self.find(w)
        total = np.zeros((len(w.text_of), factors[0].shape[1]))
        for a in range(0, len(total), ROWS):
            rows = min(ROWS, len(total) - a)
            for n, (window, number, others) in enumerate(found):
                lo, hi = np.searchsorted(window, [a, a + rows])
                width = len(self.codes[n]) + 1
                present = np.zeros(rows * width, dtype=np.float32)
                present[(window[lo:hi] - a) * width + number[lo:hi]] = 1
                present = present.reshape(rows, width)[:, :-1]
                size = present.sum(1) + others[a : a + rows]
                total[a : a + rows] += BLEND[n] * (present @ factors[n]) / np.sqrt(np.maximum(size, 1))[:, None]
        return total


@dataclass
class Kernel:
    """Everything that scoring needs: ``LANDMARKS`` windows' n-grams, times the number of languages.

    ``weights`` has a row for each landmark and one for the constant; ``folded`` one for each n-gram by
    order. ``typical`` tells for each known 3-gram in which languages' landmarks it stands, ``usual`` how
    many of the 3-grams in a window of a language are typical of it.
    """

    labels: list[str]
    codes: list[np.ndarray]
    weights: np.ndarray
    folded: list[np.ndarray]
    typical: np.ndarray
    usual: np.ndarray
    vocabulary: Vocabulary | None = field(default=None, repr=False)

    def __getstate__(self):
        return self.__dict__ | {"vocabulary": None}

    def score(self, texts: list[str | None], familiar: np.ndarray | None = None) -> tuple[list[str], np.ndarray]:
        """(label, score) of each text.

        ``familiar`` is filled with the share of each text's 3-grams that are typical of its label, over
        the usual share. Unlike the score, it has no lower bound that depends on the number of labels.
        """
        if self.vocabulary is None:
            self.vocabulary = Vocabulary(self.codes)
        total, share = np.zeros((len(texts), len(self.labels))), np.zeros(len(texts))
        for w in windows(texts):
            values = self.vocabulary.products(w, self.folded) + self.weights[-1]
            letters = w.letters
            np.add.at(total, w.text_of, values * letters[:, None])
            np.add.at(share, w.text_of, letters)
        total /= np.maximum(share, 1)[:, None]
        best = total.argmax(1)
        has = share > 0
        scores = np.where(has, np.clip((total[np.arange(len(texts)), best] + 1) / 2, 0, 1), 0.0)
        if familiar is not None:
            known, every = np.zeros(len(texts)), np.zeros(len(texts))
            for w in windows(texts):
                window, number, _ = self.vocabulary.find(w)[2]
                text = w.text_of[window]
                known += np.bincount(text, weights=self.typical[number, best[text]], minlength=len(texts))
                every += np.bincount(text, minlength=len(texts))
            familiar[:] = np.where(has, known / np.maximum(every, 1) / np.maximum(self.usual[best], 1e-9), 0.0)
        return [self.labels[k] if h else UNDETERMINED for k, h in zip(best, has)], scores


def _landmarks(sample: DataFrame) -> list[tuple[str, list[np.ndarray]]]:
    """(label, codes by order) of one window each of the first documents of the draw, in turns by label."""

    def run(batches_: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        S.only("langid")
        for batch in S.slices(batches_, 16):
            rows, codes, orders = [], [], []
            draws = batch.column(2).to_numpy()
            for i, text in enumerate(batch.column(1).to_pylist()):
                parts = list(windows([text]))
                letters = np.concatenate([w.letters for w in parts])
                # Any of the windows with letters in at least half of the places of its fullest one.
                full = np.flatnonzero(2 * letters >= letters.max())
                at = int(full[int(draws[i] * 1e9) % len(full)])
                for w in parts:
                    if at < len(w.text_of):
                        break
                    at -= len(w.text_of)
                for n in range(3):
                    window, code = grams(w, n)
                    rows.append(i)
                    orders.append(n)
                    codes.append(np.unique(code[window == at]))
            took = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(took), batch.column(3).take(took), pa.array(orders, pa.int32()), pa.array(codes, pa.list_(pa.int64()))], ["label", "rank", "nth", "codes"])

    # The order is total: ranks are distinct within a label.
    chosen = sample.orderBy("rank", "label").limit(LANDMARKS).select("label", "text", "draw", "rank")
    rows = chosen.mapInArrow(run, "label string, rank int, nth int, codes array<long>").collect()
    found: dict[tuple, list] = {}
    for r in sorted(rows, key=lambda r: (r["rank"], r.label, r.nth)):
        found.setdefault((r["rank"], r.label), []).append(np.array(r.codes, dtype=np.int64))
    return [(label, codes) for (_, label), codes in found.items()]


def _sums(sample: DataFrame, vocabulary: Vocabulary, factors: list[np.ndarray], labels: list[str], sizes: dict[str, int], typical: np.ndarray):
    """(sum of feature products, sum of features by label, weighted share of typical 3-grams by label) over all windows
    of the sample. A document's weight is one over its language's documents, shared out to its windows by
    their letters. Tasks hold whatever documents their hash deals them, so reruns add up alike."""
    size, place = factors[0].shape[1] + 1, {label: k for k, label in enumerate(labels)}
    known = sample.sparkSession.sparkContext.broadcast((vocabulary.codes, factors, place, sizes, typical))

    def run(batches_: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        S.only("langid")
        codes, factors, place, sizes, typical = known.value
        vocabulary = Vocabulary(codes)
        products, features, shares = np.zeros((size, size)), np.zeros((len(place), size)), np.zeros(len(place))
        task = -1
        for batch in S.slices(batches_, 64):
            texts, label = batch.column(1).to_pylist(), batch.column(0).to_pylist()
            task = batch.column(2)[0].as_py() if batch.num_rows else task
            k = np.array([place[x] for x in label], dtype=np.int64)
            letters = np.zeros(len(texts))
            for w in windows(texts):
                np.add.at(letters, w.text_of, w.letters)
            one = 1 / (np.array([sizes[x] for x in label]) * np.maximum(letters, 1))
            for w in windows(texts):
                x = np.hstack([vocabulary.products(w, factors), np.ones((len(w.text_of), 1))])
                weight = one[w.text_of] * w.letters
                products += x.T @ (weight[:, None] * x)
                np.add.at(features, k[w.text_of], weight[:, None] * x)
                window, number, _ = vocabulary.find(w)[2]
                good = np.bincount(window, weights=typical[number, k[w.text_of[window]]], minlength=len(weight))
                np.add.at(shares, k[w.text_of], weight * good / np.maximum(1, np.bincount(window, minlength=len(weight))))
        if task >= 0:
            yield pa.RecordBatch.from_arrays([pa.array([task], pa.int32()), *[pa.array([x.tobytes()], pa.binary()) for x in (products, features, shares)]], ["task", "products", "features", "shares"])

    def add(batches_: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches_:
            for row in zip(*[c.to_pylist() for c in batch.columns[1:]]):
                part = [np.frombuffer(x) for x in row]
                total = part if total is None else [a + b for a, b in zip(total, part)]
        if total:
            yield pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), *[pa.array([x.tobytes()], pa.binary()) for x in total]], ["task", "products", "features", "shares"])

    schema = "task int, products binary, features binary, shares binary"
    dealt = sample.withColumn("task", F.pmod(F.xxhash64("label", "rank"), F.lit(TASKS)).cast("int")).repartition(TASKS, "task").sortWithinPartitions("task", "rank", "label")
    # One row for each task at most, however large the sample is.
    rows = dealt.select("label", "text", "task").mapInArrow(run, schema).repartition(1).sortWithinPartitions("task").mapInArrow(add, schema).collect()
    parts = [np.frombuffer(rows[0][name]) for name in ("products", "features", "shares")]
    return parts[0].reshape(size, size), parts[1].reshape(len(labels), size), parts[2]


def _sample(docs: DataFrame) -> DataFrame:
    """(label, text, draw, rank) of at most ``SAMPLE`` labelled documents of each language."""
    labelled = docs.where(F.col("label").isNotNull() & F.col("text").rlike(r"\p{L}") & (S.crc_fold(F.col("doc_id")) != 2))
    counts = labelled.groupBy("label").count()
    # The draw thins each language by its count first, so that only small groups are ranked.
    draw = S.unit_hash(F.lit(99), "doc_id", F.col("text"))
    thin = labelled.withColumn("draw", draw).join(F.broadcast(counts) if _few(counts) else counts, "label").where(F.col("draw") * F.col("count") < 2 * SAMPLE + 50)
    ranked = thin.withColumn("rank", F.row_number().over(W.partitionBy("label").orderBy("draw", "doc_id", "text"))).where(F.col("rank") <= SAMPLE)
    return ranked.select("label", "text", "draw", "rank")


def _few(counts: DataFrame, most: int = 10_000) -> bool:
    return counts.limit(most + 1).count() <= most


def solve(products: np.ndarray, features: np.ndarray, between: np.ndarray) -> np.ndarray:
    """Weights of landmarks and constant, by language: ridge regression in the space that the landmarks span."""
    # Nystroem: K_nm K_mm^(-1/2) as features; the weights are folded back to the landmarks.
    values, vectors = np.linalg.eigh(between)
    root = vectors / np.sqrt(np.maximum(values, 1e-6)) @ vectors.T
    turn = np.eye(len(products))
    turn[:-1, :-1] = root
    total = float(products[-1, -1])
    penalty = RIDGE * total * np.diag([1.0] * len(root) + [1e-6])
    targets = 2 * features.T - features.sum(0)[:, None]  # +1 for a language's own windows, -1 for the others
    return turn @ np.linalg.solve(turn.T @ products @ turn + penalty, turn.T @ targets)


def train(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> Kernel | None:
    """Fit on documents with a label whose fold isn't the held-out one; None without any.

    Every language weighs the same however many of its documents were drawn, and every document the same
    within it, by all of its windows. Repeated rows are documents of their own. The driver holds the
    landmarks and, for each language, a row of their number.
    """
    named = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"), F.col(f"`{lang}`").cast("string").alias("label"))
    sample = S.stored(_sample(S.small_batches(named)), "sample")
    sizes = {r.label: r["count"] for r in sample.groupBy("label").count().collect()}
    labels = sorted(sizes)
    if not labels:
        return None
    marks = _landmarks(sample)
    vocabulary = Vocabulary([np.concatenate([codes[n] for _, codes in marks]) for n in range(3)])
    factors, typical = [], np.zeros((len(vocabulary.codes[2]) + 1, len(labels)), dtype=bool)
    for n in range(3):
        present = np.zeros((len(vocabulary.codes[n]), len(marks)), dtype=np.float32)
        for j, (label, codes) in enumerate(marks):
            at = np.searchsorted(vocabulary.codes[n], codes[n])
            present[at, j] = 1
            if n == 2:
                typical[at, labels.index(label)] = True
        factors.append(present / np.sqrt(np.maximum(present.sum(0), 1)))
    between = sum(b * (f.T.astype(float) @ f) for b, f in zip(BLEND, factors, strict=True))
    products, features, shares = _sums(sample, vocabulary, factors, labels, sizes, typical)
    weights = solve(products, features, between)
    folded = [(f @ weights[:-1]).astype(np.float32) for f in factors]
    return Kernel(labels, vocabulary.codes, weights, folded, typical, shares / features[:, -1])


def identify(docs: DataFrame, kernel: Kernel | None, text: str = "text", familiar: str | None = None) -> DataFrame:
    """Add ``lang_pred`` and ``score`` to every row of ``docs`` from its whole text.

    Texts without a letter, null and empty ones included, are ``und`` with score 0, as is everything
    when there was nothing to learn from. Equal texts get equal results, whatever rows repeat. ``familiar``
    names a further column: how familiar the text's 3-grams are (``Kernel.score``; 0 for ``und``).
    Columns of these names are replaced.
    """
    docs = S.small_batches(docs)
    keep = [c for c in docs.columns if c not in ("lang_pred", "score", familiar)]
    at = keep.index(text)
    shared = docs.sparkSession.sparkContext.broadcast(kernel)  # bounded: see Kernel

    def run(batches_: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        S.only("langid")
        model = shared.value
        for batch in S.slices(batches_):
            texts = batch.column(at).to_pylist()
            shares = np.zeros(len(texts)) if familiar else None
            found, scores = model.score(texts, shares) if model else ([UNDETERMINED] * len(texts), np.zeros(len(texts)))
            more = {"lang_pred": pa.array(found, pa.string()), "score": pa.array(scores)} | ({familiar: pa.array(shares)} if familiar else {})
            yield pa.RecordBatch.from_arrays([*batch.columns, *more.values()], [*batch.schema.names, *more])

    base = docs.select(*[F.col(f"`{c}`") for c in keep])
    schema = T.StructType([*base.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), *([T.StructField(familiar, T.DoubleType())] if familiar else [])])
    return base.mapInArrow(run, schema)
