"""Language identification by string kernels.

Two texts' kernel is the number of character n-grams (1 to 3, over letters and gaps) that both hold, over the root of the
product of their own numbers: a blended-spectrum presence kernel. A few landmark texts span a Nyström map of it,
and one ridge regression per language (one against the rest) is solved in that map, over all labelled texts: each task sums the products of its texts' kernel
rows, so what is summed up has the landmarks' size. Scoring is two products per batch:
presence rows with the landmarks' rows, then the kernel rows with the coefficients. N-grams are numbers of 21 bits a code point, so
every letter of every script is itself.

Scores only rank the languages: the targets of a row sum to 2 - L, so the best of L scores is never below 1/L, whatever the
text. Whether a text is in any learned language at all is said by its evidence: the part of its n-grams of length 3 (all
occurrences with a letter) that the labelled texts of one language hold often enough, against a cut found on all labelled rows (calibrate).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from .common import ship, tidy

#: Landmarks, the texts that span the map; dealt evenly to the languages, two to each at least.
LANDMARKS = 128
#: Longest n-grams; bits of a code point in them; the ridge; texts scored together.
ORDER, BITS, RIDGE, BATCH = 3, 21, 1e-2, 128
#: A language knows the n-grams that this part of its labelled texts holds, and two of them at least.
SPOKEN = 1 / 32
#: Steps of the evidence in which its median is found; occurrences of n-grams counted together; groups in which tasks' products are summed.
STEPS, COUNTED, GROUPS = 10_000, 250_000, 16
#: Where the cut lies on the way from the evidence of shuffled texts to that of the texts themselves.
REACH = 0.1
UNKNOWN = "und"
_letters: list[np.ndarray] = []


def letters() -> np.ndarray:
    """1 for each code point that is a letter."""
    if not _letters:
        _letters.append(np.array([chr(i).isalpha() for i in range(0x110000)], np.uint8))
    return _letters[0]


def points(text: str | None) -> np.ndarray:
    """Code points of a text in lower case; 0, a gap, for all that aren't letters."""
    p = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.where(letters()[p] > 0, p, 0).astype(np.uint64)


def grams(p: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """The distinct n-grams of each length in ascending order, and how often each of the longest stands in the text."""
    g = p
    for n in range(1, ORDER):
        g = g[:-1] << np.uint64(BITS) | p[n:]
    last, times = np.unique(g, return_counts=True)
    out = [last]
    for n in range(ORDER - 1, 0, -1):  # all shorter ones begin a longer one, but for that at the end of the text
        end = p[-n:] if len(p) >= n else p[:0]
        tail = np.zeros(min(1, len(end)), np.uint64)
        for x in end:
            tail = tail << np.uint64(BITS) | x
        out.append(np.unique(np.concatenate([out[-1] >> np.uint64(BITS), tail])))
    return out[::-1], times


def places(known: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Where the values of x stand in a sorted array; -1 where they don't."""
    if not len(known):
        return np.full(len(x), -1, np.int64)
    at = np.minimum(np.searchsorted(known, x), len(known) - 1)
    return np.where(known[at] == x, at, -1)


@dataclass
class Model:
    langs: list[str]
    vocab: list[np.ndarray]  # by length: the landmarks' n-grams, sorted
    holders: np.ndarray  # for each n-gram of all lengths a row of bits: the landmarks that hold it
    norms: np.ndarray  # root of each landmark's own number of n-grams
    known: np.ndarray  # the longest n-grams that any language knows, sorted; none before calibrate
    coef: np.ndarray | None = None
    bias: np.ndarray | None = None
    knows: np.ndarray | None = None  # for each of those a row: which languages do
    cut: float | None = None  # least evidence, see calibrate

    def kernel(self, sets: list[list[np.ndarray]]) -> np.ndarray:
        """Kernels of texts, given by their n-grams, with the landmarks: one product of presence rows over the n-grams that any of the texts shares with a landmark."""
        base = np.cumsum([0, *[len(v) for v in self.vocab]])
        found = [np.concatenate([base[n] + (at := places(v, g))[at >= 0] for n, (v, g) in enumerate(zip(self.vocab, s, strict=True))]) for s in sets]
        columns, index = np.unique(np.concatenate(found), return_inverse=True)
        x = np.zeros((len(sets), len(columns)), np.float32)
        x[np.repeat(np.arange(len(sets)), [len(f) for f in found]), index] = 1
        z = np.unpackbits(self.holders[columns], axis=1, count=len(self.norms)).astype(np.float32)
        own = np.sqrt([max(1, sum(len(g) for g in s)) for s in sets])
        return (x @ z).astype(np.float64) / own[:, None] / self.norms

    def evidence(self, last: np.ndarray, times: np.ndarray) -> float:
        """Of a text's longest n-grams, the part of the occurrences that the language knows that knows most of them."""
        times = np.where(last > 0, times, 0)
        at = places(self.known, last)
        return float((times[at >= 0] @ self.knows[at[at >= 0]]).max() / max(1, times.sum()))

    def judged(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Best language (its number), its score, and whether the text is in a learned language as far as can be said: it has letters and, in a calibrated model, evidence enough."""
        best, score, sure = np.zeros(len(texts), int), np.zeros(len(texts)), np.zeros(len(texts), bool)
        p = [points(t) for t in texts]
        with_letters = [i for i, x in enumerate(p) if x.any()]
        if not with_letters:
            return best, score, sure
        got = [grams(p[i]) for i in with_letters]
        f = self.kernel([g for g, _ in got]) @ self.coef + self.bias
        best[with_letters], score[with_letters], sure[with_letters] = f.argmax(1), np.clip((1 + f.max(1)) / 2, 0, 1), True
        if self.cut is not None:
            for i, (g, times) in zip(with_letters, got, strict=True):
                sure[i] = self.evidence(*padded(g[-1], times, p[i])) >= self.cut
        return best, score, sure


def padded(last: np.ndarray, times: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The longest n-grams of a text with a gap put before and after it."""
    gap = np.zeros(1, np.uint64)
    ends = [grams(np.concatenate([gap, p[: ORDER - 1]])), grams(np.concatenate([p[1 - ORDER :], gap]))] if len(p) >= ORDER - 1 else [grams(np.concatenate([gap, p, gap]))]
    return np.concatenate([last, *[g[-1] for g, _ in ends]]), np.concatenate([times, *[t for _, t in ends]])


def whole(p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What evidence() asks for, of a text's code points."""
    g, times = grams(p)
    return padded(g[-1], times, p)


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches in parts of BATCH rows."""
    for b in batches:
        for lo in range(0, b.num_rows, BATCH):
            yield b.slice(lo, BATCH)


def labelled(docs: DataFrame, use: Column, id_col: str, lang_col: str, text_col: str) -> tuple[DataFrame, dict[str, int]]:
    """Rows (id, lang, text) where use holds, the language is known and the text has letters, and their number by language."""
    rows = docs.where(use & F.col(lang_col).isNotNull() & F.col(text_col).rlike(r"\p{L}")).select(F.col(id_col).alias("id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"))
    return rows, {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}


def marks_of(rows: DataFrame, langs: dict[str, int], landmarks: int, seed: int) -> list[tuple[str, list[np.ndarray]]]:
    """lang and distinct n-grams of the landmarks: the first of each language by a hash of the id."""
    each = max(2, landmarks // len(langs))
    share = F.coalesce(*[F.when(F.col("lang") == k, F.lit(min(1.0, 3.0 * each / n + 64 / n))) for k, n in sorted(langs.items())])
    picked = rows.withColumn("h", F.xxhash64("id", F.lit(seed))).where(F.pmod("h", F.lit(1 << 30)) < share * (1 << 30))
    best = picked.select("lang", "id", "h").withColumn("nth", F.row_number().over(Window.partitionBy("lang").orderBy("h", "id"))).where(F.col("nth") <= each)
    want = {(r["lang"], r["h"]): r["nth"] for r in best.select("lang", "h", "nth").collect()}
    chosen = picked.where(F.col("h").isin([h for _, h in want])).select("lang", "h", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [grams(points(t))[0] for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("lang"), b.column("h"), *(pa.array([g[n].tobytes() for g in got], pa.binary()) for n in range(ORDER))], names=["lang", "h", *(f"g{n}" for n in range(ORDER))])

    got = chosen.mapInArrow(tidy(run), "lang string, h bigint, " + ", ".join(f"g{n} binary" for n in range(ORDER))).collect()
    found, seen = [], set()
    for r in sorted(got, key=lambda r: (r["lang"], want.get((r["lang"], r["h"]), 0))):
        key = (r["lang"], r["h"])
        if key in want and key not in seen:
            seen.add(key)
            found.append((r["lang"], [np.frombuffer(bytes(r[f"g{n}"]), np.uint64) for n in range(ORDER)]))
    return found


def products(rows: DataFrame, model: Model, weight: dict[str, float]) -> np.ndarray:
    """The sum of w z z' over all rows (lang, text), where z is a text's kernel row, its targets and 1, and w its language's weight. A matrix for each task, summed in groups."""
    shared = rows.sparkSession.sparkContext.broadcast((model, weight))
    width = len(model.norms) + len(model.langs) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, weights = shared.value
        total, nth = np.zeros((width, width)), TaskContext.get().partitionId()
        for x in slices(batches):
            langs = x.column("lang").to_pylist()
            k = m.kernel([grams(points(t))[0] for t in x.column("text").to_pylist()])
            z = np.concatenate([k, np.array([[1.0 if v == lang else -1.0 for lang in m.langs] for v in langs]), np.ones((len(k), 1))], axis=1)
            total += (z * np.array([weights[v] for v in langs])[:, None]).T @ z
        yield pa.RecordBatch.from_arrays([pa.array([nth % GROUPS]), pa.array([nth]), pa.array([total.tobytes()], pa.binary())], names=["g", "nth", "z"])

    def add(key: tuple, parts: pa.Table) -> pa.Table:
        total = np.zeros(width * width)
        for z in parts.sort_by("nth").column("z").to_pylist():  # in one order, so that reruns agree
            total += np.frombuffer(z)
        return pa.table({"g": pa.array([key[0].as_py()], pa.int64()), "z": pa.array([total.tobytes()], pa.binary())})

    got = rows.select("lang", "text").mapInArrow(tidy(run), "g bigint, nth bigint, z binary").groupBy("g").applyInArrow(add, "g bigint, z binary").collect()
    shared.destroy()
    return sum((np.frombuffer(bytes(r["z"])) for r in sorted(got, key=lambda r: r["g"])), np.zeros(width * width)).reshape(width, width)


def fit(docs: DataFrame, use: Column, id_col: str = "doc_id", lang_col: str = "lang", text_col: str = "text", landmarks: int = LANDMARKS, ridge: float = RIDGE, seed: int = 5) -> Model | None:
    """Learns from all rows where use holds, the language is known and the text has letters; None if there are none. Languages weigh alike, whatever their number of rows.

    Only the landmarks' n-grams and sums of the landmarks' size come to the driver.
    """
    ship(docs.sparkSession)
    rows, counts = labelled(docs, use, id_col, lang_col, text_col)
    if not counts:
        return None
    langs = sorted(counts)
    marks = marks_of(rows, counts, landmarks, seed)
    vocab = [np.unique(np.concatenate([g[n] for _, g in marks])) for n in range(ORDER)]

    def bits(n: int) -> np.ndarray:
        """For each n-gram of a length, a row of bits: the landmarks that hold it."""
        out = np.zeros((len(vocab[n]), len(marks)), bool)
        for j, (_, g) in enumerate(marks):
            out[places(vocab[n], g[n]), j] = True
        return np.packbits(out, axis=1)

    norms = np.sqrt([sum(len(x) for x in g) for _, g in marks])
    model = Model(langs, vocab, np.concatenate([bits(n) for n in range(ORDER)]), norms, np.zeros(0, np.uint64))
    k_mm = model.kernel([g for _, g in marks])
    values, vectors = np.linalg.eigh((k_mm + k_mm.T) / 2)
    keep = values > 1e-6 * values.max()
    nystrom = vectors[:, keep] / np.sqrt(values[keep])
    total = products(rows, model, {k: 1.0 / n for k, n in counts.items()})
    total = total / total[-1, -1]
    n, mean = len(marks), total[-1, :-1]
    around = total[:-1, :-1] - np.outer(mean, mean)
    a, b = nystrom.T @ around[:n, :n] @ nystrom, nystrom.T @ around[:n, n:]
    coef = nystrom @ np.linalg.solve(a + ridge / n * np.eye(len(a)), b)
    return replace(model, coef=coef, bias=mean[n:] - mean[:n] @ coef)


def spoken(rows: DataFrame, counts: dict[str, int], langs: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The longest n-grams that a language knows, and for each which languages do: those held by the part SPOKEN of its rows (lang, text), by two at least (or all). So it knows 1 / SPOKEN times as many as a text has on average, at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[np.ndarray]] = {}
        size = 0

        def counted() -> Iterator[pa.RecordBatch]:
            for lang, g in held.items():
                found, times = np.unique(np.concatenate(g), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(found), pa.string()), pa.array(found.astype(np.int64)), pa.array(times.astype(np.int64))], names=["lang", "gram", "n"])
            held.clear()

        for b in slices(batches):
            for lang, t in zip(b.column("lang").to_pylist(), b.column("text").to_pylist(), strict=True):
                held.setdefault(lang, []).append(g := grams(points(t))[0][-1])
                size += len(g)
                if size > COUNTED:
                    yield from counted()
                    size = 0
        yield from counted()

    least = F.coalesce(*[F.when(F.col("lang") == k, F.lit(max(min(2, n), SPOKEN * n))) for k, n in sorted(counts.items())])
    found = rows.select("lang", "text").mapInArrow(tidy(run), "lang string, gram bigint, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    got = found.select("lang", "gram").collect()
    known, at = np.unique(np.array([r["gram"] for r in got], np.uint64), return_inverse=True)
    knows = np.zeros((len(known), len(langs)), np.int64)
    knows[at, [langs.index(r["lang"]) for r in got]] = 1
    return known, knows


def middle(cells: list[tuple[int, float]]) -> float:
    """The weighted median of numbers of steps, as evidence."""
    cells = sorted(cells)
    upto = np.cumsum([w for _, w in cells])
    lo, hi = (np.searchsorted(upto, upto[-1] / 2 * f) for f in (1 - 1e-12, 1 + 1e-12))
    return (cells[lo][0] + cells[min(hi, len(cells) - 1)][0]) / 2 / STEPS


def calibrate(docs: DataFrame, model: Model | None, use: Column, id_col: str = "doc_id", lang_col: str = "lang", text_col: str = "text", seed: int = 6) -> Model | None:
    """The model with what its languages know, counted over all labelled rows where use doesn't hold, and the least evidence, found on all where it does. Languages weigh alike.

    The cut lies a little above the median evidence of the texts with their letters shuffled, which keeps letters and lengths but is in no
    language: a tenth of the way to the median of the texts themselves. Either part being empty, the other serves for both. Only what is known and counts of evidence in steps come to the driver.
    """
    if model is None:
        return None
    ship(docs.sparkSession)
    use = use & F.col(lang_col).cast("string").isin(model.langs)
    others, known = labelled(docs, ~use & F.col(lang_col).cast("string").isin(model.langs), id_col, lang_col, text_col)
    rows, counts = labelled(docs, use, id_col, lang_col, text_col)
    others, known = (others, known) if known else (rows, counts)
    rows, counts = (rows, counts) if counts else (others, known)
    grams_known, knows = spoken(others, known, model.langs)
    model = replace(model, known=grams_known, knows=knows)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in slices(batches):
            own, junk = [], []
            for h, t in zip(b.column("h").to_pylist(), b.column("text").to_pylist(), strict=True):
                p = points(t)
                own.append(round(m.evidence(*whole(p)) * STEPS) if p.any() else None)
                p[p > 0] = np.random.default_rng(h % (1 << 63)).permutation(p[p > 0])
                junk.append(round(m.evidence(*whole(p)) * STEPS) if p.any() else None)
            yield pa.RecordBatch.from_arrays([b.column("lang"), pa.array(own, pa.int64()), pa.array(junk, pa.int64())], names=["lang", "own", "junk"])

    judged = rows.select("lang", F.xxhash64("id", F.lit(seed)).alias("h"), "text").mapInArrow(tidy(run), "lang string, own bigint, junk bigint").where("own IS NOT NULL")
    each = judged.select("lang", F.explode(F.array(F.struct(F.lit(True).alias("own"), F.col("own").alias("cell")), F.struct(F.lit(False).alias("own"), F.col("junk").alias("cell")))).alias("e"))
    got = each.select("lang", "e.*").groupBy("lang", "own", "cell").count().collect()
    shared.destroy()
    if not got:
        return model
    own, junk = (middle([(r["cell"], r["count"] / counts[r["lang"]]) for r in got if r["own"] == what]) for what in (True, False))
    return replace(model, cut=float(junk + REACH * (own - junk)))


def judged(docs: DataFrame, model: Model | None, keep: list[str], text_col: str) -> DataFrame:
    """row: the columns keep of docs as a struct, so that their names meet no others; lang_pred, score."""
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"), F.col(f"`{text_col}`").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            for lo in range(0, b.num_rows, BATCH):
                x = b.slice(lo, BATCH)
                names, score = [UNKNOWN] * x.num_rows, np.zeros(x.num_rows)
                if m is not None:
                    best, score, sure = m.judged(x.column("text").to_pylist())
                    names = [m.langs[i] if ok else UNKNOWN for i, ok in zip(best.tolist(), sure.tolist(), strict=True)]
                    score = np.where(sure, score, 0)
                yield pa.RecordBatch.from_arrays([x.column("row"), pa.array(names, pa.string()), pa.array(score)], names=["row", "lang_pred", "score"])

    return rows.mapInArrow(tidy(run), StructType([rows.schema["row"], StructField("lang_pred", StringType()), StructField("score", DoubleType())]))


def predict(docs: DataFrame, model: Model | None, keep: list[str], text_col: str = "text") -> DataFrame:
    """Columns keep of docs, with lang_pred and score. Map-only; whole texts, however long.

    A text that is null, empty or without letters, or any text if nothing could be learned: und, with score 0. With a
    calibrated model so is a text with less evidence than the model asks for. Ties go to
    the language that comes first by name. Repeated rows are judged each; no rows: no rows. keep must not hold lang_pred or score.
    """
    return judged(docs, model, keep, text_col).select("row.*", "lang_pred", "score")


def recognised(docs: DataFrame, model: Model | None, text_col: str = "text") -> DataFrame:
    """The rows of docs whose text is in a learned language, with all their columns, whatever their names. What predict() says und of goes; no rows: no rows."""
    return judged(docs, model, docs.columns, text_col).where(F.col("lang_pred") != UNKNOWN).select("row.*")


def held_out(id_col: str = "doc_id") -> Column:
    """A fifth of the ids, for measuring; a null id isn't among them."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5 == 0, F.lit(False))


def identify(docs: DataFrame, id_col: str = "doc_id", **how) -> DataFrame:
    """doc_id, held_out, lang_pred, score, with a model learned from the rows that aren't held out.

    Rows without an id or a language are judged but not learned from; null, empty or letterless texts, ties, repeated rows and empty tables as in predict().
    Texts of any length are judged whole. Other columns don't matter, whatever their names.
    """
    model = fit(docs, ~held_out(id_col) & F.col(id_col).isNotNull(), id_col, **how)
    out = predict(docs, model, [id_col], how.get("text_col", "text"))
    return out.select(F.col(id_col).alias("doc_id"), held_out(id_col).alias("held_out"), "lang_pred", "score")
