"""Language identification: multinomial naive Bayes over hashed character n-grams.

Texts are lower-cased, runs of other than letters become one space, and every
run of 1 to 3 characters is hashed to one of 2^16 features. The matrix of log
probabilities (features x languages) is broadcast: 256 KB a language, for the
`most_labels` most frequent labels at most. Texts are scored in sparse batches: the
features of many texts, or of parts of long ones, stand one after another with their
bounds, the matrix's rows are gathered for all and summed from bound to bound.

Fitting uses at most about `fit_rows` labelled documents, chosen by a hash of
doc_id; scoring reads every whole text. A text that is null or has no letter is
`und` with score 0. The score is the posterior probability of the language; gain is
how much better than even odds for all features the language explains an n-gram, in
nats. Clean texts of a learned language gain 3.6 and more on the documents at hand,
random letters and other scripts less than 0, random words less than 1.

Defined results: rows without a language, or whose language is `und`, are never
learned from; labels of equal frequency go by name; of equal scores the first
language by name is taken; a null doc_id hashes as the empty text; repeated rows get
equal answers; a text of any length is read whole, in chunks; other columns are
ignored; with nothing to learn from, every answer is `und`, and the stage keeps all
documents; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_batch, prepare, slices, wrapped

FEATURES = 1 << 16
LONGEST = 3
FIT_ROWS = 20_000
SMOOTHING = 0.5
MOST_LABELS = 256
LEAST_SCORE = 0.5
LEAST_GAIN = 1.0
CHUNK = 1 << 18  # numbers that are gathered at a time, or those of one part of a text
SPAN = 1 << 15  # characters in a part of a text
UNKNOWN = "und"

_UNSEEN = 0xFFFFFFFF
_LETTERS = np.full(0x110000, _UNSEEN, np.uint32)


def letters(codes: np.ndarray) -> np.ndarray:
    """For each code point its lower-case letter, or 0 for what is no letter; the table fills as code points come."""
    found = _LETTERS[codes]
    if (found == _UNSEEN).any():
        for c in np.unique(codes[found == _UNSEEN]).tolist():
            _LETTERS[c] = ord(chr(c).lower()[0]) if chr(c).isalpha() else 0
        found = _LETTERS[codes]
    return found


def _hashed(codes: np.ndarray, skip: int) -> np.ndarray:
    """Features of the n-grams of codes that don't lie in the first `skip` alone."""
    found, gram = [], np.zeros(len(codes), np.uint64)
    for n in range(1, LONGEST + 1):
        gram = gram[: max(0, len(codes) - n + 1)] * np.uint64(0x110000) + codes[n - 1 :]
        found.append((gram[max(0, skip - n + 1) :] + np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(48))
    return np.concatenate(found).astype(np.int32)


def features(text: str | None, span: int = SPAN) -> Iterator[np.ndarray]:
    """The hashed n-grams of a text, in parts for `span` characters each; nothing if it has no letter."""
    text, carry, last = text or "", np.zeros(0, np.uint64), 0
    for at in range(0, len(text), span):
        codes = letters(np.frombuffer(text[at : at + span].encode("utf-32-le", "surrogatepass"), "<u4"))
        kept = codes != 0
        kept[1:] |= codes[:-1] != 0
        kept[0] |= last != 0
        codes = codes[kept].astype(np.uint64)
        if len(codes):
            last = codes[-1]
            ends = [np.zeros(1, np.uint64)] if at + span >= len(text) and last else []
            begins = carry if len(carry) else np.zeros(1, np.uint64)
            whole = np.concatenate([begins, codes, *ends])
            yield _hashed(whole, len(carry))
            carry = whole[1 - LONGEST :]


@dataclass
class Model:
    """languages in order, log probabilities of features (features x languages), log priors."""

    languages: list[str]
    weights: np.ndarray
    priors: np.ndarray

    def score(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, posterior and gain of each text."""
        if not self.languages:
            return [UNKNOWN] * len(texts), np.zeros(len(texts)), np.zeros(len(texts))
        total, grams = np.tile(self.priors, (len(texts), 1)), np.zeros(len(texts), np.int64)
        step = max(1024, CHUNK // len(self.languages))
        parts, owners, held = [], [], 0

        def add():
            sizes = np.fromiter(map(len, parts), np.int64, len(parts))
            sums = np.add.reduceat(self.weights[np.concatenate(parts)], np.cumsum(sizes) - sizes, axis=0, dtype=np.float64)
            np.add.at(total, owners, sums)
            np.add.at(grams, owners, sizes)

        for i, text in enumerate(texts):
            for part in features(text, min(SPAN, step)):
                parts.append(part)
                owners.append(i)
                held += len(part)
                if held >= step:
                    add()
                    parts, owners, held = [], [], 0
        if parts:
            add()
        best = total.argmax(axis=1)
        top = total[np.arange(len(texts)), best]
        told = grams > 0
        score = np.where(told, 1 / np.exp(total - top[:, None]).sum(axis=1), 0.0)
        gain = np.where(told, (top - self.priors[best]) / np.maximum(grams, 1) + np.log(FEATURES), 0.0)
        return [self.languages[k] if t else UNKNOWN for k, t in zip(best.tolist(), told.tolist(), strict=True)], score, gain


def fit(labelled: DataFrame, fit_rows: int = FIT_ROWS, most_labels: int = MOST_LABELS) -> Model:
    """labelled: doc_id, text, lang. Counts are summed by Spark; most_labels x features numbers at most reach the driver."""
    prepare(labelled.sparkSession)
    labelled = labelled.where("lang IS NOT NULL AND text IS NOT NULL").where(F.col("lang") != UNKNOWN)
    counts = labelled.groupBy("lang").agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n")).first()[0] or 0
    labels = [r.lang for r in counts.orderBy(F.desc("n"), "lang").limit(most_labels).collect()]
    labelled = labelled.where(F.col("lang").isin(labels)) if labels else labelled.where("false")
    if total > fit_rows:
        labelled = labelled.where(F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(1 << 30)) < int(fit_rows / total * (1 << 30)))

    def count(batches):
        sums: dict[str, np.ndarray] = {}
        docs: dict[str, int] = {}
        for batch in slices(batches):
            for lang, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                read = False
                for part in features(text):
                    counts, read = np.bincount(part, minlength=FEATURES), True
                    sums[lang] = sums[lang] + counts if lang in sums else counts
                if read:
                    docs[lang] = docs.get(lang, 0) + 1
        for lang, counts in sums.items():
            at = np.nonzero(counts)[0]
            yield arrow_batch({"lang": [lang] * (len(at) + 1), "feature": [-1, *at.tolist()], "n": [docs[lang], *counts[at].tolist()]}, pa.schema([("lang", pa.string()), ("feature", pa.int64()), ("n", pa.int64())]))

    counted = labelled.select(F.col("lang").cast("string"), F.col("text").cast("string")).mapInArrow(count, "lang string, feature long, n long").groupBy("lang", "feature").agg(F.sum("n").alias("n")).toArrow()
    langs, feature, n = (counted.column(c).to_numpy(zero_copy_only=False) for c in ("lang", "feature", "n"))
    names = sorted(set(langs.tolist()))
    at = {name: i for i, name in enumerate(names)}
    place = np.array([at[x] for x in langs.tolist()], np.int64)
    counts, docs = np.zeros((FEATURES, len(names))), np.ones(len(names))
    own = feature >= 0
    counts[feature[own], place[own]] = n[own]
    docs[place[~own]] += n[~own]
    weights = np.log((counts + SMOOTHING) / (counts.sum(axis=0) + SMOOTHING * FEATURES)).astype(np.float32)
    return Model(names, weights, np.log(docs / docs.sum()) if names else docs)


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))


def predicted(spark: SparkSession, text: Column, model: Model) -> Column:
    """lang_pred, score and gain of a text, as a struct; a function from Arrow to Arrow."""
    prepare(spark)
    sent = spark.sparkContext.broadcast(model)

    def run(texts: pa.Array) -> pa.Array:
        answers = [sent.value.score(part.column(0).to_pylist()) for part in slices([pa.record_batch([texts], ["text"])])]
        said = [lang for langs, _, _ in answers for lang in langs]
        score, gain = (np.concatenate([a[k] for a in answers]) if answers else np.zeros(0) for k in (1, 2))
        return pa.StructArray.from_arrays([pa.array(said, pa.string()), pa.array(score, pa.float64()), pa.array(gain, pa.float64())], ["lang_pred", "score", "gain"])

    return F.arrow_udf(run, "lang_pred string, score double, gain double")(text)


def identify(docs: DataFrame, fit_rows: int = FIT_ROWS, most_labels: int = MOST_LABELS) -> DataFrame:
    """doc_id, held_out, lang_pred, score; learns from the documents that aren't held out."""
    model = fit(docs.where(~held_out()).select("doc_id", "text", "lang"), fit_rows, most_labels)
    found = docs.select(F.col("doc_id").cast("long"), held_out().alias("held_out"), predicted(docs.sparkSession, F.col("text").cast("string"), model).alias("p"))
    return found.select("doc_id", "held_out", "p.lang_pred", "p.score")


def known_documents(docs: DataFrame, wanted: Sequence[str] | None = None, least_score: float = LEAST_SCORE, least_gain: float = LEAST_GAIN, fit_rows: int = FIT_ROWS, most_labels: int = MOST_LABELS) -> DataFrame:
    """The documents in one of the wanted languages (None: any learned one), told with least_score and least_gain or more, with the columns they came with."""
    model = fit(docs.where(~held_out()).select("doc_id", "text", "lang"), fit_rows, most_labels)
    if not model.languages:
        return docs
    rows = wrapped(docs).withColumn("p", predicted(docs.sparkSession, F.col("row.text").cast("string"), model))
    lang = F.col("p.lang_pred")
    known = (lang != UNKNOWN) & (F.col("p.score") >= least_score) & (F.col("p.gain") >= least_gain)
    return rows.where(known if wanted is None else known & lang.isin(list(wanted))).select("row.*")
