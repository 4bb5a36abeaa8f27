"""Language identification by hierarchical discrimination: family first, then the language within it.

A text is the set of its byte n-grams (1 to GRAMS bytes of its lower-cased letters, other characters as one space),
hashed to 2**BITS slots and weighed by their shares of the text. Linear support vector machines, one for every pair
of families and one for every pair of languages of one family, are trained apart from one another, a group of Spark
each, by dual coordinate ascent over some SAMPLE texts a language. A text goes to the family that wins most of
its pairs, then to that family's language that wins most of its own; equal wins go by the margins' sum, then by name.
Its score is the product of the logistic of its least margin among families and among languages.

Learning is bounded: per language some SAMPLE texts of least hash, counted without copies, so a worker that trains a
pair holds some SAMPLE texts' slots for each language of two families. Prediction reads every text whole.

Defined results: rows with null text or lang teach nothing, nor do texts without a letter; a null text or one without
a letter is predicted ``und`` with score 0, as is every text when nothing was learned; with one language only, all others
are that language, with score 1. lang, source and doc_id are never read by a prediction. Repeated rows are predicted
alike, one row each. Languages outside FAMILIES are a family of their own each. Further columns are not read.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storyloom.llm.common import passes, raw, ship, strings
from storyloom.storage import cut

BITS, GRAMS = 15, 4
#: Texts that each language is learned from, those of least hash: about so many, as a sketch counts a language's texts.
SAMPLE = 1_000
EPOCHS, COST = 12, 4.0
#: Bytes of text whose n-grams are held at a time.
HELD = 1 << 18
#: The scale from a margin to a log odds.
SLOPE = 4.0
UNKNOWN = "und"
# Language families.
FAMILIES = {
    "da": "germanic", "de": "germanic", "en": "germanic", "nl": "germanic", "no": "germanic", "sv": "germanic",
    "ca": "romance", "es": "romance", "fr": "romance", "it": "romance", "pt": "romance", "ro": "romance",
    "bg": "slavic", "cs": "slavic", "pl": "slavic", "ru": "slavic", "sk": "slavic", "uk": "slavic",
    "et": "uralic", "fi": "uralic", "hu": "uralic",
}


def family(lang: str) -> str:
    return FAMILIES.get(lang, f"own:{lang}")


@dataclass
class Model:
    """languages; pairs (left, right) of families or languages; weights[pair] has a slot's weight, then the constant."""

    languages: list[str]
    pairs: list[tuple[str, str]]
    weights: np.ndarray


def _letters() -> np.ndarray:
    table = np.full(256, 0x20, np.uint8)
    table[0x61:0x7B] = np.arange(0x61, 0x7B)
    table[0x80:] = np.arange(0x80, 0x100)
    return table


_LETTERS = _letters()
_SALTS = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F], np.uint32)


def slots(body: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Slots of the n-grams of lower-cased texts, text by text, and where each text's begin and the last end."""
    low = _LETTERS[body]
    first = np.zeros(len(low) + 1, bool)
    first[offsets[:-1]] = True
    first = first[:-1]
    space = low == 0x20
    stay = ~space
    stay[1:] |= ~space[:-1]
    stay |= first  # of a run of others one space stays, and one at a text's start
    at = np.concatenate([[0], np.cumsum(stay)])[offsets]
    low = low[stay].astype(np.uint32)
    n = len(low)
    text = np.repeat(np.arange(len(at) - 1), np.diff(at))
    padded = np.concatenate([low, np.full(GRAMS, 0x20, np.uint32)])
    owner = np.concatenate([text, np.full(GRAMS, -1)])
    out = np.empty((n, GRAMS), np.int64)
    code = np.zeros(n, np.uint32)
    for k in range(GRAMS):  # beyond its end a text is spaces
        code |= np.where(owner[k : n + k] == text, padded[k : n + k], np.uint32(0x20)) << np.uint32(8 * k)
        out[:, k] = ((code ^ (code >> np.uint32(15))) * _SALTS[k] + _SALTS[k]) >> np.uint32(32 - BITS)
    return out.ravel(), at * GRAMS


def _lowered(column: pa.Array) -> pa.Array:
    return pc.utf8_lower(strings(column))


def has_letter(c: Column) -> Column:
    return F.coalesce(F.rlike(c, F.lit(r"\p{L}")), F.lit(False))


def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, lang, slots, shares) of (key, lang, text): a text's distinct slots and their shares."""
    for batch in batches:
        body, offsets = raw(_lowered(batch.column(2)))
        for x, y in passes(offsets, HELD):
            flat, at = slots(body[offsets[x] : offsets[y]], offsets[x : y + 1] - offsets[x])
            where, share = [], []
            for a, b in zip(at, at[1:], strict=False):
                n = np.bincount(flat[a:b], minlength=1)
                own = np.flatnonzero(n)
                where.append(own.astype(np.int32).tobytes())
                share.append((n[own] / max(b - a, 1)).astype(np.float32).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(x, y - x), batch.column(1).slice(x, y - x), pa.array(where, pa.binary()), pa.array(share, pa.binary())], names=["key", "lang", "slots", "shares"])


def separate(where: list[np.ndarray], share: list[np.ndarray], signs: np.ndarray) -> np.ndarray:
    """Weights and constant of a linear support vector machine, by dual coordinate ascent with squared hinge loss.

    Slots are first scaled by the root of their mean share, texts to length 1; the weights returned fit plain shares
    of a text whose scaled length is taken as the training texts' mean."""
    size = 1 << BITS
    mean = np.zeros(size)
    for w, s in zip(where, share, strict=True):
        mean[w] += s
    mean /= max(len(where), 1)
    scale = np.where(mean > 0, 1 / np.sqrt(np.maximum(mean, 1e-7)), 0)
    x = [s * scale[w] for w, s in zip(where, share, strict=True)]
    length = float(np.mean([np.sqrt(v @ v) for v in x]))
    x = [np.append(v / length, 0.3) for v in x]
    where = [np.append(w, size) for w in where]
    # Both sides weigh alike however many texts they have.
    cost = np.where(signs > 0, COST * len(signs) / (2 * max((signs > 0).sum(), 1)), COST * len(signs) / (2 * max((signs < 0).sum(), 1)))
    norms = np.array([v @ v for v in x]) + 1 / (2 * cost)
    weights, alpha = np.zeros(size + 1), np.zeros(len(x))
    order = np.random.default_rng(11)
    for _ in range(EPOCHS):
        for i in order.permutation(len(x)):
            w, v, y = where[i], x[i], signs[i]
            slope = y * (weights[w] @ v) - 1 + alpha[i] / (2 * cost[i])
            new = max(alpha[i] - slope / norms[i], 0.0)
            if new != alpha[i]:
                weights[w] += (new - alpha[i]) * y * v
                alpha[i] = new
    return np.append(weights[:size] * scale / length, weights[size] * 0.3).astype(np.float32)


def _trained(table: pa.Table) -> pa.Table:
    table = table.sort_by([("key", "ascending"), ("lang", "ascending")])
    where = [np.frombuffer(b, np.int32) for b in table["slots"].to_pylist()]
    share = [np.frombuffer(b, np.float32) for b in table["shares"].to_pylist()]
    weights = separate(where, share, table["sign"].to_numpy())
    return pa.table({"pair": table["pair"].slice(0, 1), "weights": pa.array([weights.tobytes()], pa.binary())})


def training(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(key, lang, text) of the texts that are learned from, copies once: those whose hash lies in the share of all
    hashes that about sample of a language's texts have, or all of a language with fewer."""
    sound = docs.filter(F.col("lang").isNotNull() & has_letter(F.col("text"))).select(F.xxhash64("lang", "text").alias("key"), "lang", "text")
    found = sound.groupBy("lang").agg(F.approx_count_distinct("key", 0.02).alias("n")).collect()  # one row a language
    if not found:
        return sound.limit(0)
    limit = {r["lang"]: min((1 << 63) - 1, int((1 << 64) * sample / r["n"]) - (1 << 63)) for r in found}
    below = F.element_at(F.create_map(*[F.lit(v) for item in limit.items() for v in item]), F.col("lang"))
    return sound.filter(F.col("key") <= below).groupBy("key", "lang").agg(F.first("text").alias("text"))


def fit(docs: DataFrame, sample: int = SAMPLE) -> Model:
    """A model of the languages of docs (text, lang)."""
    spark = docs.sparkSession
    ship(spark)
    learned = cut(training(docs, sample).mapInArrow(counted, "key long, lang string, slots binary, shares binary"), "langid-sample")
    languages = sorted(r["lang"] for r in learned.select("lang").distinct().collect())
    families = sorted({family(x) for x in languages})
    sides = [(a, b, [x for x in languages if family(x) == a], [x for x in languages if family(x) == b]) for a, b in itertools.combinations(families, 2)]
    sides += [(a, b, [a], [b]) for a, b in itertools.combinations(languages, 2) if family(a) == family(b)]
    if not sides:
        return Model(languages, [], np.zeros((0, (1 << BITS) + 1), np.float32))
    tasks = [(k, x, y) for k, (_, _, left, right) in enumerate(sides) for y, side in ((1.0, left), (-1.0, right)) for x in side]
    rows = learned.join(F.broadcast(spark.createDataFrame(tasks, "pair int, lang string, sign double")), "lang")
    got = rows.groupBy("pair").applyInArrow(_trained, "pair int, weights binary").collect()
    weights = {r["pair"]: np.frombuffer(bytes(r["weights"]), np.float32) for r in got}
    return Model(languages, [(a, b) for a, b, _, _ in sides], np.stack([weights[k] for k in range(len(sides))]))


def margins(model: Model, column: pa.Array) -> np.ndarray:
    """margins[pair, text]: positive where a pair's left side wins."""
    body, offsets = raw(_lowered(column))
    out = np.zeros((len(model.pairs), len(column)))
    for x, y in passes(offsets, HELD):
        flat, at = slots(body[offsets[x] : offsets[y]], offsets[x : y + 1] - offsets[x])
        n = np.diff(at)
        full = np.flatnonzero(n)
        for k, w in enumerate(model.weights):
            if len(full):
                out[k, x + full] = np.add.reduceat(w[flat], at[:-1][full], dtype=float) / n[full] + w[-1]
    return out


def _winner(names: list[str], pairs: list[tuple[str, str]], m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which name wins most of its pairs, by text, and its least margin (infinite for a name alone)."""
    place = {x: k for k, x in enumerate(names)}
    n = m.shape[1]
    wins, sums, least = np.zeros((len(names), n)), np.zeros((len(names), n)), np.full((len(names), n), np.inf)
    for (a, b), row in zip(pairs, m, strict=True):
        for x, v in ((a, row), (b, -row)):
            k = place[x]
            wins[k] += v > 0
            sums[k] += v
            least[k] = np.minimum(least[k], v)
    best = np.lexsort((np.broadcast_to(np.arange(len(names))[:, None], wins.shape), -sums, -wins), axis=0)[0]
    return best, least[best, np.arange(n)]


def decide(model: Model, m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Language and score of texts by their margins."""
    families = sorted({family(x) for x in model.languages})
    chosen = lambda names: [k for k, p in enumerate(model.pairs) if p[0] in names and p[1] in names]
    logistic = lambda v: 1 / (1 + np.exp(-SLOPE * np.clip(v, -300, 300)))
    top, margin = _winner(families, [model.pairs[k] for k in chosen(families)], m[chosen(families)])
    lang, score = np.empty(m.shape[1], object), logistic(margin)
    for f, name in enumerate(families):
        own = np.flatnonzero(top == f)
        names = [x for x in model.languages if family(x) == name]
        picked = chosen(names)
        best, margin = _winner(names, [model.pairs[k] for k in picked], m[picked][:, own])
        lang[own] = np.array(names, object)[best]
        score[own] *= logistic(margin)
    return lang, score


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """docs (doc_id, text) as (doc_id, lang_pred, score)."""
    spark = docs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            lettered = batch.column(2).to_numpy(zero_copy_only=False).astype(bool)
            if model.languages:
                lang, score = decide(model, margins(model, batch.column(1)))
            else:
                lang, score, lettered = np.full(batch.num_rows, UNKNOWN, object), np.zeros(batch.num_rows), np.zeros(batch.num_rows, bool)
            lang, score = np.where(lettered, lang, UNKNOWN), np.where(lettered, score, 0.0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lang.tolist(), pa.string()), pa.array(score)], names=["doc_id", "lang_pred", "score"])

    rows = docs.select("doc_id", "text", has_letter(F.col("text")).alias("lettered"))
    return rows.mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, lang_pred string, score double")


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept from learning: crc32 of its id as text leaves 2 by 4."""
    return F.coalesce(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4 == 2, F.lit(False))


def identify(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every row of docs, learned from those that are not held out."""
    model = fit(docs.filter(~held_out(F.col("doc_id"))).select("text", "lang"))
    found = predict(docs.select("doc_id", "text"), model)
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
