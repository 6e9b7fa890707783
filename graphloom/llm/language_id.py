"""Language identification with hyperdimensional profiles.

Each letter has a random bipolar vector, made from its code point. A trigram's vector binds its letters'
vectors, each moved by its place; a text bundles the vectors of its trigrams; a language bundles those of
its training texts. A text gets the language whose prototype, seen from the mean of all prototypes, has
the largest cosine with it.
"""

from __future__ import annotations

import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_texts, saved
from .textkit import U, mix

#: Dimensions, and 64-bit words of a vector; a place in a trigram moves a vector by whole words.
DIMENSIONS = 4096
_LANES = DIMENSIONS // 64
#: Languages that a model may have; their prototypes are what the driver holds (32 KB each).
MAX_LANGUAGES = 2_000
#: Texts and distinct trigrams that one product of matrices takes, and dimensions at once.
TEXTS, GRAMS, SLICE = 256, 4_096, 1_024
UNKNOWN = "und"
_tables: dict[str, np.ndarray] = {}


def _letters() -> np.ndarray:
    """For every code point of the Basic Multilingual Plane its lower-case letter or mark; 0 for all else."""
    if "letters" not in _tables:
        table = np.zeros(1 << 16, np.int64)
        for c in range(1 << 16):
            if unicodedata.category(chr(c))[0] in "LM":
                table[c] = ord(chr(c).lower()[0])
        _tables["letters"] = table
    return _tables["letters"]


def _points(chunk) -> tuple[np.ndarray, np.ndarray]:
    """Lower-case letters and marks (0: others) of a chunk's code points, and each text's first code point."""
    points = np.frombuffer(chunk.data.tobytes().decode().encode("utf-32-le"), np.uint32).astype(np.int64)
    lead = np.concatenate([[0], np.cumsum((chunk.data & 0xC0) != 0x80)])
    out = _letters()[np.minimum(points, 0xFFFF)]
    high = np.flatnonzero(points > 0xFFFF)
    if len(high):
        one, inverse = np.unique(points[high], return_inverse=True)
        out[high] = np.array([ord(chr(c).lower()[0]) if unicodedata.category(chr(c))[0] in "LM" else 0 for c in one])[inverse]
    return out, lead[chunk.offsets]


def trigrams(chunk) -> tuple[np.ndarray, np.ndarray]:
    """Text number and trigram (21 bits a letter, 0: the gap between words) of every letter of a chunk with its neighbours."""
    letters, first = _points(chunk)
    sizes = np.diff(first)
    text = np.repeat(np.arange(len(chunk)), sizes + 2)  # a gap before and behind each text
    x = np.zeros(len(text), np.int64)
    x[np.arange(len(letters)) + np.repeat(1 + 2 * np.arange(len(chunk)), sizes)] = letters
    one_gap = np.append(True, (x[1:] != 0) | (x[:-1] != 0) | (text[1:] != text[:-1])) if len(x) else np.zeros(0, bool)
    x, text = x[one_gap], text[one_gap]
    middle = np.flatnonzero(x[1:-1]) + 1  # its neighbours are of the same text: letters or the text's gaps
    return text[middle], x[middle - 1] << 42 | x[middle] << 21 | x[middle + 1]


def _letter_bits(letters: np.ndarray) -> np.ndarray:
    """The random vectors of letters, a bit for each dimension."""
    lanes = np.arange(_LANES, dtype=U)
    return mix(mix(letters.astype(U)[:, None] * U(0x9E3779B97F4A7C15) + U(4096)) + (lanes + U(1)) * U(0xD6E8FEB86659FD93))


def trigram_bits(grams: np.ndarray, lanes: slice = slice(None)) -> np.ndarray:
    """Bound vectors of trigrams: the product of bipolar vectors is the exclusive or of their bits (1: minus)."""
    mask = (1 << 21) - 1
    parts = []
    for j, shift in enumerate((42, 21, 0)):
        one, inverse = np.unique(grams >> shift & mask, return_inverse=True)
        parts.append(np.roll(_letter_bits(one), 2 - j, axis=1)[:, lanes][inverse])
    return parts[0] ^ parts[1] ^ parts[2]


def _bipolar(bits: np.ndarray) -> np.ndarray:
    return 1.0 - 2.0 * np.unpackbits(bits.view(np.uint8), axis=1, bitorder="little").astype(np.float32)


def bundled(text: np.ndarray, grams: np.ndarray, weights: np.ndarray, n_texts: int, project: np.ndarray | None = None):
    """Sums of weighted trigram vectors by text: (their squared lengths, their products with the columns of project).

    Without project the sums themselves (n_texts x DIMENSIONS). Memory is bounded by TEXTS, GRAMS and SLICE.
    """
    whole = np.zeros((n_texts, DIMENSIONS)) if project is None else None
    squares = np.zeros(n_texts)
    products = np.zeros((n_texts, 0 if project is None else project.shape[1]))
    order = np.lexsort((grams, text))
    text, grams, weights = text[order], grams[order], weights[order].astype(np.float32)
    for lo in range(0, n_texts, TEXTS):
        a, b = np.searchsorted(text, [lo, lo + TEXTS])
        if a == b:
            continue
        rows = min(TEXTS, n_texts - lo)
        one, inverse = np.unique(grams[a:b], return_inverse=True)
        by_gram = np.argsort(inverse, kind="stable")
        row, column, weight = (text[a:b] - lo)[by_gram], inverse[by_gram], weights[a:b][by_gram]
        for lane in range(0, DIMENSIONS, SLICE):
            sums = np.zeros((rows, SLICE), np.float64)
            for g in range(0, len(one), GRAMS):
                c, d = np.searchsorted(column, [g, g + GRAMS])
                counts = np.zeros((rows, min(GRAMS, len(one) - g)), np.float32)
                counts[row[c:d], column[c:d] - g] = weight[c:d]
                sums += counts @ _bipolar(np.ascontiguousarray(trigram_bits(one[g : g + GRAMS], slice(lane // 64, (lane + SLICE) // 64))))
            if project is None:
                whole[lo : lo + rows, lane : lane + SLICE] = sums
            else:
                squares[lo : lo + rows] += (sums * sums).sum(1)
                products[lo : lo + rows] += sums @ project[lane : lane + SLICE]
    return whole if project is None else (squares, products)


def _counts(text: np.ndarray, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (text, trigram) with their number."""
    if not len(grams):
        return text, grams, np.zeros(0)
    order = np.lexsort((grams, text))
    text, grams = text[order], grams[order]
    first = np.flatnonzero(np.append(True, (grams[1:] != grams[:-1]) | (text[1:] != text[:-1])))
    return text[first], grams[first], np.diff(np.append(first, len(grams)))


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", max_languages: int = MAX_LANGUAGES) -> tuple[list[str], np.ndarray]:
    """Languages in order and their prototypes; rows without text or language are passed over.

    Trigrams are counted by language, each text with the weight 1 / sqrt(its trigrams), so that long texts
    count more, but less than by length; the counts are summed by Spark, their vectors bundled in tasks and
    the bundles summed by dimension. What reaches the driver is one vector for each language; more than
    max_languages labels are an error. A language without any letter, and an empty table, give none.
    """
    rows = docs.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text")).where("lang IS NOT NULL AND text IS NOT NULL")

    def count(chunk, batch):
        text, grams = trigrams(chunk)
        names = batch.column(0).to_pylist()
        languages = {name: i for i, name in enumerate(dict.fromkeys(names))}
        number = np.array([languages[n] for n in names], np.int64)
        weight = 1 / np.sqrt(np.maximum(np.bincount(text, minlength=len(names)), 1))
        order = np.lexsort((grams, number[text]))
        lang, grams, weight = number[text][order], grams[order], weight[text][order]
        first = np.flatnonzero(np.append(True, (grams[1:] != grams[:-1]) | (lang[1:] != lang[:-1]))) if len(grams) else np.zeros(0, np.int64)
        sums = np.add.reduceat(weight, first) if len(first) else np.zeros(0)
        borders = np.searchsorted(lang[first], np.arange(len(languages) + 1))
        owner = [names.index(name) for name in languages]  # the chunk's sums of a language go with its first row
        at = np.zeros(len(names) + 1, np.int32)
        at[np.array(owner, np.int64) + 1] = np.diff(borders)
        return {c: pa.ListArray.from_arrays(pa.array(np.cumsum(at, dtype=np.int32)), pa.array(v)) for c, v in (("grams", grams[first]), ("weights", sums))}

    lists = T.StructType([T.StructField("grams", T.ArrayType(T.LongType())), T.StructField("weights", T.ArrayType(T.DoubleType()))])
    counted = map_texts(rows, "text", lambda: count, lists, ["lang"]).where("size(grams) > 0")
    counted = counted.select("lang", F.explode(F.arrays_zip("grams", "weights")).alias("x")).select("lang", F.col("x.grams").alias("gram"), F.col("x.weights").alias("weight"))
    counted = saved(counted.groupBy("lang", "gram").agg(F.sum("weight").alias("weight")))
    labels = counted.select("lang").distinct().count()
    if labels > max_languages:
        raise ValueError(f"{labels} languages are labelled, at most {max_languages} may be")
    schema = T.StructType([T.StructField("lang", T.StringType()), T.StructField("d", T.IntegerType()), T.StructField("x", T.DoubleType())])

    def bundle(batches):
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            names = batch.column(0).dictionary_encode()
            number = names.indices.to_numpy(zero_copy_only=False)
            vectors = bundled(number, batch.column(1).to_numpy(), batch.column(2).to_numpy(), len(names.dictionary))
            for i, name in enumerate(names.dictionary.to_pylist()):
                sums[name] = sums.get(name, 0) + vectors[i]
        for name, vector in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([name] * DIMENSIONS), pa.array(np.arange(DIMENSIONS, dtype=np.int32)), pa.array(vector)], names=schema.names)

    sums = counted.mapInArrow(bundle, schema).groupBy("lang", "d").agg(F.sum("x").alias("x"))
    found = sums.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("d", "x"))).alias("v")).orderBy("lang").collect()  # DIMENSIONS numbers a language
    return [r[0] for r in found], np.array([[x.x for x in r.v] for r in found], np.float64).reshape(len(found), DIMENSIONS)


def directions(prototypes: np.ndarray) -> np.ndarray:
    """Unit vectors of the prototypes, seen from their mean where there are several."""
    unit = lambda x: x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    return unit(unit(prototypes) - unit(prototypes).mean(axis=0)) if len(prototypes) > 1 else unit(prototypes)


def identify(docs: DataFrame, model: tuple[list[str], np.ndarray], text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """docs' columns ``keep`` (all by default) with lang_pred and score (cosine, moved from -1..1 to 0..1).

    Null, empty and letterless texts, and all texts of an empty model, are 'und' with score 0. Equal
    cosines go to the language that comes first; repeated rows get equal results; empty docs give no rows;
    columns of these names are replaced.
    """
    languages, prototypes = model
    shared = docs.sparkSession.sparkContext.broadcast(np.ascontiguousarray(directions(prototypes).T))  # DIMENSIONS numbers a language

    def make():
        project = shared.value

        def step(chunk, batch):
            text, grams = trigrams(chunk)
            has_letter = np.zeros(len(chunk), bool)
            has_letter[text[_is_letter(grams >> 21 & ((1 << 21) - 1))]] = True
            text, grams, n = _counts(text, grams)
            if not languages:
                return {"lang_pred": [UNKNOWN] * len(chunk), "score": np.zeros(len(chunk))}
            squares, products = bundled(text, grams, n, len(chunk), project)
            known = has_letter & (squares > 0)
            cosines = products / np.sqrt(np.where(known, squares, 1.0))[:, None]
            best = cosines.argmax(1)
            score = np.where(known, np.clip((1 + cosines[np.arange(len(best)), best]) / 2, 0, 1), 0.0)
            return {"lang_pred": [languages[b] if k else UNKNOWN for b, k in zip(best.tolist(), known.tolist())], "score": score}

        return step

    return map_texts(docs, text_col, make, T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]), keep)


def _is_letter(points: np.ndarray) -> np.ndarray:
    one, inverse = np.unique(points, return_inverse=True)
    return np.array([chr(c).isalpha() for c in one.tolist()], bool)[inverse]


#: One in so many labelled texts may score below the least score; SCALE: its steps.
ONE_IN, SCALE = 1000, 10_000


def least_score(docs: DataFrame, model: tuple[list[str], np.ndarray], text_col: str = "text", lang_col: str = "lang") -> float:
    """The score that all but one in ONE_IN of the labelled texts reach, cut to SCALE steps; 0 for an empty model.

    All labelled rows with letters are scored and counted by step; at most SCALE + 1 counts reach the driver.
    """
    if not model[0]:
        return 0.0
    rows = docs.where(F.col(lang_col).isNotNull()).select(F.col(text_col).cast("string").alias("text"))
    return least_of(identify(rows, model, "text", []))


def least_of(scored: DataFrame) -> float:
    """The same of rows that are scored already."""
    steps = scored.where(F.col("lang_pred") != UNKNOWN).groupBy(F.floor(F.col("score") * SCALE).alias("step")).agg(F.count("*").alias("n")).orderBy("step").collect()
    below, total = 0, sum(r.n for r in steps)
    for r in steps:
        below += r.n
        if below * ONE_IN > total:
            return r.step / SCALE
    return 0.0


def held_out(id_col: str = "doc_id", parts: int = 4) -> Column:
    """crc32 of the id as text leaves 2 modulo ``parts``; false where the id is null."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(parts)) == 2, F.lit(False))
