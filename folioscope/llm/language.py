"""Language identification with string kernels.

**Kernel.**  A text's features are which byte n-grams of 1 to 3 lower-cased bytes it
holds, presence only (the blended spectrum); capitals of ASCII and Latin-1 are lower-cased; white space, digits and ASCII punctuation
count as one blank.  K(x, y) is the number of shared n-grams over the root of the product of the
sets' sizes.  The features are the n-grams of the landmarks, so K needs nothing else.

**Model.**  Nyström: texts map to ``K(x, landmarks) @ K(landmarks, landmarks)**-1/2``;
one-versus-rest ridge regression on that map gives a score for each language.  Scoring
is two matrix products a batch.

**Training rows** are a bounded sample of every language: at most ``SAMPLE`` documents for
each (fewer where there are over 200 languages, so that there are about ``SAMPLED`` in
all), those with the smallest hash in each hash class, the same whatever the
partitioning; of them the first ``LANDMARKS`` for each language are landmarks.  Executors
turn their texts into n-gram codes; those alone come to the driver, which sums the
normal equations by chunks.  Only text and lang are learned from, never source or doc_id.

``told`` is false for texts without letters, for those to which every one-versus-rest
answer is a clear no, and for those whose 3-grams are strange: more of them, counted
as often as they stand, are outside the landmarks than twice the share in all but ``STRANGE``
of the training texts that are no landmarks, by more than ``SIGMAS`` deviations of a draw of that many (so
short texts are seldom strange), and for those with fewer than ``LETTERS`` letters to a byte.  Without ``CALIBRATED`` such texts nothing is strange.

Defined cases: null text, or text without a letter, is ``und`` with score 0.  Training
rows need a non-null lang and a letter; without any, every text is ``und``.  Rows are
independent.  Equal hashes are settled by ``doc_id``; repeated rows count once.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StringType, StructField, StructType

from .common import LOWER, released, row_chunks, table, text_bytes, written

#: Training rows: at most SAMPLE a language and SAMPLED in all; landmarks likewise; at least one of each for each language.
SAMPLE, SAMPLED, LANDMARKS, ALL_LANDMARKS, RIDGE = 192, 38_400, 48, 768, 1e-2
#: The best one-versus-rest answer (1 yes, -1 no) that a text needs to be told.
MARGIN = -0.35
#: The share of training texts below the least share of known 3-grams, the deviations allowed, and the fewest texts and 3-grams to learn it from.
STRANGE, SIGMAS, CALIBRATED, LONG = 0.005, 3.0, 40, 50
#: The least share of letters (ASCII ones, and all bytes beyond ASCII) among bytes that are no white space.
LETTERS = 0.25
#: A letter in the sense of Unicode.
LETTER = r"\p{L}"

_BLANK = LOWER.copy()
_BLANK[[b for b in range(128) if not chr(b).isalpha()]] = 32
_INK = np.array([b > 32 for b in range(256)])
_TRIGRAMS = 256 + (1 << 16)
_GRAMS = _TRIGRAMS + (1 << 24)
_BLANKS = _TRIGRAMS + 0x202020


def _codes(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the 1-, 2- and 3-grams and their rows; n-grams do not cross rows."""
    low = _BLANK[buf].astype(np.int32)
    # capitals of Latin-1 in UTF-8
    low[1:] += 32 * ((low[:-1] == 0xC3) & (low[1:] >= 0x80) & (low[1:] <= 0x9E) & (low[1:] != 0x97))
    row = np.repeat(np.arange(len(off) - 1, dtype=np.int32), np.diff(off))
    codes, rows, code = [low], [row], low
    for n, base in ((1, 256), (2, 256 + (1 << 16))):
        code = (code[:-1] << 8) | low[n:]
        inside = row[: len(code)] == row[n:]
        codes.append(code[inside] + base)
        rows.append(row[: len(code)][inside])
    return np.concatenate(codes), np.concatenate(rows)


def presence(buf: np.ndarray, off: np.ndarray, column: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows x features, 1.0 where a text holds the n-gram, and its known and all 3-grams; column: feature by code, or ``width``."""
    out = np.zeros((len(off) - 1, width + 1), np.float32)
    codes, rows = _codes(buf, off)
    feature = column[codes]
    out[rows, feature] = 1.0
    three = (codes >= _TRIGRAMS) & (codes != _BLANKS)
    known, total = (np.bincount(rows[of], minlength=len(out)) for of in (three & (feature < width), three))
    return out[:, :width], known, total


def strange(known, total, least: float):
    """Whether so few of a text's 3-grams are known that no sharing of luck explains it."""
    return known < least * total - SIGMAS * np.sqrt(least * (1 - least) * np.maximum(total, 1))


def _sums(what: np.ndarray, off: np.ndarray) -> np.ndarray:
    """How many bytes of each row are so."""
    return np.diff(np.concatenate([[0], np.cumsum(what)])[off - off[0]])


def _kernel(x: np.ndarray, landmarks: np.ndarray) -> np.ndarray:
    size = np.sqrt(np.maximum(x.sum(axis=1), 1.0))
    return (x @ landmarks.T) / size[:, None] / np.sqrt(np.maximum(landmarks.sum(axis=1), 1.0))


class Model:
    """Landmark features, and the matrix from kernel values to language scores."""

    def __init__(self, codes: list[np.ndarray], langs: list[str], counts: list[np.ndarray]):
        """codes: the distinct n-gram codes of each training text, and how often each stands there."""
        self.names = sorted(set(langs))
        self.least = 0.0
        self.grams = np.zeros(0, np.int32)
        if not self.names:
            return
        chosen, seen = [], {}
        most = max(1, min(LANDMARKS, ALL_LANDMARKS // len(self.names)))
        for i, lang in enumerate(langs):
            seen[lang] = seen.get(lang, 0) + 1
            if seen[lang] <= most:
                chosen.append(i)
        self.grams = np.unique(np.concatenate([codes[i] for i in chosen])).astype(np.int32)

        def held(some: list[np.ndarray]) -> np.ndarray:
            out = np.zeros((len(some), len(self.grams)), np.float32)
            for row, c in zip(out, some, strict=True):
                at = np.searchsorted(self.grams, c)
                at[at == len(self.grams)] = 0
                row[at[self.grams[at] == c]] = 1.0
            return out

        self.landmarks = held([codes[i] for i in chosen])
        value, vector = np.linalg.eigh(_kernel(self.landmarks, self.landmarks).astype(np.float64))
        keep = value > 1e-6 * value[-1]
        whiten = vector[:, keep] / np.sqrt(value[keep])
        shares = []
        for i in set(range(len(codes))) - set(chosen):
            count = np.where((codes[i] >= _TRIGRAMS) & (codes[i] != _BLANKS), counts[i], 0)
            if count.sum() >= LONG:
                shares.append(count[np.isin(codes[i], self.grams, assume_unique=True)].sum() / count.sum())
        if len(shares) >= CALIBRATED:
            self.least = max(0.0, 1.0 - 2.0 * (1.0 - float(np.quantile(shares, STRANGE))))
        # each language weighs the same; the normal equations are summed over chunks of rows
        names, number = np.array(self.names), {x: k for k, x in enumerate(self.names)}
        label = np.array([number[x] for x in langs])
        share = (1.0 / np.bincount(label))[label]
        left, right = 0.0, 0.0
        for i in range(0, len(codes), 256):
            phi = _kernel(held(codes[i : i + 256]), self.landmarks) @ whiten
            phi = np.hstack([phi, np.ones((len(phi), 1))])
            weighted = (phi * share[i : i + 256, None]).T
            left = left + weighted @ phi
            right = right + weighted @ np.where(label[i : i + 256, None] == np.arange(len(names)), 1.0, -1.0)
        solved = np.linalg.solve(left + RIDGE * np.eye(len(left)) * share.sum() / len(share), right)
        self.weights, self.bias = (whiten @ solved[:-1]).astype(np.float32), solved[-1].astype(np.float32)

    def columns(self) -> np.ndarray:
        kind = np.uint16 if len(self.grams) < 1 << 16 else np.int32
        column = np.full(_GRAMS, len(self.grams), kind)
        column[self.grams] = np.arange(len(self.grams))
        return column

    def scores(self, buf: np.ndarray, off: np.ndarray, column: np.ndarray) -> np.ndarray:
        """Rows x languages, each row a distribution, and whether any one-versus-rest answer is a yes, by MARGIN, and the text not strange."""
        held, known, total = presence(buf, off, column, len(self.grams))
        raw = _kernel(held, self.landmarks) @ self.weights + self.bias
        told = (raw.max(axis=1) > MARGIN) & ~strange(known, total, self.least)
        told &= _sums(_BLANK[buf] != 32, off) >= LETTERS * _sums(_INK[buf], off)
        raw = np.exp(4.0 * (raw - raw.max(axis=1, keepdims=True)))
        return raw / raw.sum(axis=1, keepdims=True), told


def training_rows(docs: DataFrame, training) -> DataFrame:
    """text, lang, h and doc_id of the bounded sample; training: which rows may be learned from, as a Column of doc_id."""
    rows = docs.filter(F.col("lang").isNotNull() & training)
    letters = rows.filter(F.col("text").rlike(LETTER))
    langs = rows.agg(F.count_distinct("lang").alias("n")).first()["n"]
    most = max(1, min(SAMPLE, SAMPLED // max(1, langs)))
    bucket = F.pmod(F.xxhash64(F.lit("sample"), "doc_id"), F.lit(most)).alias("bucket")
    chosen = letters.groupBy("lang", bucket).agg(F.min(F.struct(F.xxhash64("doc_id").alias("h"), "doc_id")).alias("m"))
    # at most SAMPLED rows, or one a language, of three short columns
    chosen = written(chosen.select("lang", F.col("m.h").alias("h"), F.col("m.doc_id").alias("doc_id")), "language-sample")
    text = letters.select("doc_id", "lang", "text").join(F.broadcast(chosen), ["doc_id", "lang"])
    return text.groupBy("lang", "h", "doc_id").agg(F.min("text").alias("text"))


def fit(docs: DataFrame, training) -> Model:
    def coded(batches):
        for batch in batches:
            buf, off = text_bytes(batch.column(3))
            for i in range(batch.num_rows):
                codes, counts = np.unique(_codes(buf[off[i] : off[i + 1]], np.array([0, off[i + 1] - off[i]]))[0], return_counts=True)
                yield pa.record_batch([*batch.slice(i, 1).columns[:3], *(pa.array([x], pa.list_(pa.int32())) for x in (codes, counts.astype(np.int32)))], ["lang", "h", "doc_id", "codes", "counts"])

    rows = training_rows(docs, training).select("lang", "h", "doc_id", "text").mapInArrow(released(coded), "lang string, h long, doc_id long, codes array<int>, counts array<int>")
    rows = sorted(rows.collect(), key=lambda r: (r["lang"], r["h"], r["doc_id"]))
    return Model([np.array(r["codes"], np.int32) for r in rows], [r["lang"] for r in rows], [np.array(r["counts"], np.int64) for r in rows])


def predicted(docs: DataFrame, model: Model, columns: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The named columns of ``docs`` with told, lang_pred and score; without a language to learn all texts with letters are told."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    letter = F.coalesce(F.col("text").rlike(LETTER), F.lit(False)).alias("has_letter")
    given = docs.select(*columns, *([] if "text" in columns else [F.col("text").alias("_text")]), letter)
    passed = len(columns)
    at = columns.index("text") if "text" in columns else passed
    names = [*columns, "told", "lang_pred", "score"]

    def run(batches):
        model, column = shared.value, None
        for batch in batches:
            buf, off = text_bytes(batch.column(at))
            letter = batch.column(batch.num_columns - 1).to_numpy(zero_copy_only=False).astype(bool)
            best, score, told = np.zeros(len(letter), np.int64), np.zeros(len(letter)), letter.copy()
            if model.names:
                if column is None:
                    column = model.columns()
                for i, j in row_chunks(off, 1 << 20):
                    for k in range(i, j, 256):
                        m = min(j, k + 256)
                        s, yes = model.scores(buf[off[k] : off[m]], off[k : m + 1] - off[k], column)
                        told[k:m] &= yes
                        best[k:m], score[k:m] = s.argmax(axis=1), s.max(axis=1)
            letter &= bool(model.names)
            lang = np.array([*model.names, "und"], object)[np.where(letter, best, len(model.names))]
            new = [pa.array(told), pa.array(lang, pa.string()), pa.array(np.where(letter, np.clip(score, 0, 1), 0.0))]
            yield pa.record_batch([*batch.columns[:passed], *new], names)

    schema = StructType([*given.schema.fields[:passed], StructField("told", BooleanType()), StructField("lang_pred", StringType()), StructField("score", DoubleType())])
    return given.mapInArrow(released(run), schema)


def held_out(divisor: int, remainder: int):
    """Whether crc32 of doc_id as text leaves the remainder; of a null doc_id, as of the empty text."""
    return (F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % divisor) == remainder


def op6_language(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    apart = held_out(4, 2)
    model = fit(docs, ~apart)
    return predicted(docs, model).select("doc_id", apart.alias("held_out"), "lang_pred", "score")
