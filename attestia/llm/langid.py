"""Language identification of mixed-language text: script ranges, per-word scores and a Viterbi labelling.

Words are letters (Unicode category L) with the letters and marks that follow. Each language scores a word by hashed character n-grams of 1 to ORDERS characters
(with word ends), learned from labelled rows; a language is a candidate for a word only if its training text
used the word's script. Viterbi over the words of a text, with a penalty for each switch, labels every word; the
runs are the spans, and the language of most letters is the text's, its share of all letters the score.

Training uses a bounded sample: about SAMPLE rows for each label, chosen by a hash of doc_id and text, so that neither rows without
an id nor rows that share one are drawn together; all rows of a label that has fewer. Rows that repeat both count once.
Everything else covers all rows and whole texts.

Defined results: a text that is null, or has no letters (digits, fractions and letter-like numerals are none), is `und` with score 0, as is every text if nothing could
be learned; ties go to the language first in code point order; repeated rows give repeated rows; an empty table
gives an empty result; kept columns pass through.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestia.llm.common import durable, lookup, ready, resident, small_batches
from attestia.llm.hashing import slices

SAMPLE = 1500
ORDERS, BUCKETS = 3, 1 << 15
SWITCH, FLOOR, SMOOTH = 8.0, -12.0, 0.5
#: Share of a language's training letters below which a script does not make it a candidate.
SCRIPT_SHARE = 0.01
MEMO_WORDS = 100_000
#: Bytes of text that a worker labels, and counts, at once.
LABEL_BYTES, COUNT_BYTES = 1 << 20, 256 << 10
#: Texts of these characters alone (two Latin blocks, general punctuation) are cut by the standard library's engine.
NOT_PLAIN = re.compile("[^\x00-\u024f\u2000-\u206f]").search
PLAIN_WORDS = re.compile("[A-Za-z\u00aa\u00b5\u00ba\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]+")
WORDS = regex.compile(r"\p{L}[\p{L}\p{M}]*")
# First code points of script blocks, each with the script that reaches to the next entry.
SCRIPTS = [
    (0x0000, "Latin"),
    (0x0370, "Greek"),
    (0x0400, "Cyrillic"),
    (0x0530, "Armenian"),
    (0x0590, "Hebrew"),
    (0x0600, "Arabic"),
    (0x0900, "Devanagari"),
    (0x0980, "Indic"),
    (0x0E00, "Thai"),
    (0x0E80, "SouthEastAsian"),
    (0x10A0, "Georgian"),
    (0x1100, "Hangul"),
    (0x1200, "Ethiopic"),
    (0x1E00, "Latin"),
    (0x1F00, "Greek"),
    (0x2000, "Other"),
    (0x3040, "Kana"),
    (0x3100, "Han"),
    (0xA000, "Other"),
    (0xAC00, "Hangul"),
    (0xD800, "Other"),
    (0xF900, "Han"),
    (0xFB00, "Other"),
    (0x20000, "Han"),
    (0x32000, "Other"),
]
_STARTS = np.array([a for a, _ in SCRIPTS], np.int64)
_NAMES = sorted({n for _, n in SCRIPTS})
_SCRIPT_OF = np.array([_NAMES.index(n) for _, n in SCRIPTS], np.int64)


def pattern_of(lowered: str):
    """The pattern that cuts this text into words."""
    return WORDS if NOT_PLAIN(lowered) else PLAIN_WORDS


def words_of(text: str) -> list[str]:
    lowered = text.lower()
    return pattern_of(lowered).findall(lowered)


def held_out(doc_id: Column) -> Column:
    """Rows that take no part in learning: crc32 of the id's text leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(F.encode(doc_id.cast("string"), "utf-8")) % 3 == 1, F.lit(False))


def features(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashed n-grams of all words, where each word's begin, and each word's script."""
    points = np.frombuffer(("\x02" + "\x03\x02".join(words) + "\x03").encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 2
    starts = np.cumsum(lengths) - lengths
    place = np.arange(len(points)) - np.repeat(starts, lengths)
    room = np.repeat(lengths, lengths) - place
    grams, owner = [], []
    each = np.repeat(np.arange(len(words)), lengths)
    for n in range(1, ORDERS + 1):
        h = np.full(len(points), np.uint64(n * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
        for k in range(n):
            h[: len(h) - k] = (h[: len(h) - k] ^ points[k:]) * np.uint64(0xD6E8FEB86659FD93)
            h[: len(h) - k] ^= h[: len(h) - k] >> np.uint64(29)
        whole = room >= n
        grams.append((h[whole] >> np.uint64(40)) % np.uint64(BUCKETS))
        owner.append(each[whole])
    order = np.argsort(np.concatenate(owner), kind="stable")
    owner = np.concatenate(owner)[order]
    script = _SCRIPT_OF[np.searchsorted(_STARTS, points[starts + 1].astype(np.int64), "right") - 1]
    return np.concatenate(grams)[order].astype(np.int64), np.searchsorted(owner, np.arange(len(words))), script


def learn(labelled: DataFrame, text: str = "text", lang: str = "lang", doc_id: str = "doc_id", sample: int = SAMPLE) -> dict:
    """Model from a bounded, hashed sample of labelled rows: languages, n-gram log-probabilities and scripts."""
    spark = labelled.sparkSession
    ready(spark)
    known = labelled.filter(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(
        F.col(lang).cast("string").alias("_lang"),
        F.xxhash64(F.col(doc_id).cast("string"), F.col(text).cast("string")).alias("_h"),
        F.col(text).cast("string").alias("_text"),
    )
    different = known.select("_lang", "_h").distinct()
    sizes = durable(different.groupBy("_lang").agg(F.count(F.lit(1)).alias("_n")), "labels")  # a row for each language
    place = (F.col("_h").cast("double") + 2.0**63) / 2.0**64  # evenly from 0 to 1
    chosen = (
        lookup(known, sizes, "_lang", F.col("_h"))
        .filter((F.col("_n") <= sample) | (place < F.lit(float(sample)) / F.col("_n")))
        .dropDuplicates(["_lang", "_h"])
        .select("_lang", "_text")
    )

    def count(batches):
        from attestia.llm import langid

        for batch in batches:
            yield from langid.count_batch(batch)

    rows = (
        chosen.mapInArrow(count, "lang string, bucket int, n long")
        .groupBy("lang", "bucket")
        .agg(F.sum("n").alias("n"))
        .toArrow()  # numbers: at most BUCKETS and the scripts for each language, as in the model itself
    )
    told = rows.column("lang").combine_chunks().dictionary_encode() if len(rows) else None
    if told is None:
        return {"langs": []}
    found = told.dictionary.to_pylist()
    langs = sorted(found)
    at = np.array([langs.index(x) for x in found])[told.indices.to_numpy()]
    counts = np.zeros((len(langs), BUCKETS + len(_NAMES)))
    counts[at, rows.column("bucket").to_numpy()] = rows.column("n").to_numpy()
    grams, scripts = counts[:, :BUCKETS], counts[:, BUCKETS:]
    logs = np.log((grams + SMOOTH) / (grams.sum(1, keepdims=True) + SMOOTH * BUCKETS))
    share = scripts / np.maximum(1, scripts.sum(1, keepdims=True))
    return {"langs": langs, "logs": np.ascontiguousarray(logs.T.astype(np.float32)), "allowed": (share >= SCRIPT_SHARE).T.copy()}


def count_batch(batch: pa.RecordBatch):
    for part in small_batches([batch], COUNT_BYTES):
        yield from _counted(*(c.to_pylist() for c in part.columns))


def _counted(langs: list[str], texts: list[str]):
    for name in sorted(set(langs)):
        words = [w for x, t in zip(langs, texts, strict=True) if x == name for w in words_of(t)]
        if words:
            grams, _, script = features(words)
            letters = np.bincount(script, np.fromiter(map(len, words), np.float64, len(words)), len(_NAMES))
            n = np.concatenate([np.bincount(grams, minlength=BUCKETS), letters.astype(np.int64)])
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays(
                [pa.array([name] * len(at)), pa.array(at, pa.int32()), pa.array(n[at], pa.int64())], ["lang", "bucket", "n"]
            )


class Scorer:
    """Emission scores of words, each distinct word scored once; at most MEMO_WORDS are kept.

    The last column tells whether any language uses the word's script.
    """

    def __init__(self, model: dict):
        self.model, self.index, self.rows = model, {}, [np.zeros((0, len(model["langs"]) + 1), np.float32)]

    def score(self, words: list[str]) -> np.ndarray:
        grams, starts, script = features(words)
        s = np.add.reduceat(self.model["logs"][grams], starts, axis=0)
        s -= s.max(1, keepdims=True)
        allowed = self.model["allowed"][script]
        known = allowed.any(1, keepdims=True)
        s[~allowed & known] += FLOOR
        return np.concatenate([np.maximum(s, 2 * FLOOR), known], axis=1).astype(np.float32)

    def __call__(self, words: list[str]) -> np.ndarray:
        if len(self.index) > MEMO_WORDS:
            self.index, self.rows = {}, self.rows[:0]
        fresh = [w for w in dict.fromkeys(words) if w not in self.index]
        if fresh:
            base = len(self.index)
            self.index.update(zip(fresh, range(base, base + len(fresh)), strict=True))
            for k in range(0, len(fresh), 50_000):
                self.rows.append(self.score(fresh[k : k + 50_000]))
            self.rows = [np.concatenate(self.rows)]
        return self.rows[0][np.fromiter(map(self.index.__getitem__, words), np.int64, len(words))]


def viterbi(scores: np.ndarray, lengths: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """The best label of each word; scores lists the words of text after text. All texts advance together."""
    total, langs = scores.shape
    labels = np.zeros(total, np.int16)
    if langs < 2 or not total:
        return labels
    starts = np.cumsum(lengths) - lengths
    order = np.argsort(-lengths, kind="stable")
    order = order[lengths[order] > 0]
    first, length = starts[order], lengths[order]
    active = np.searchsorted(-length, -np.arange(1, length[0] + 1), "right")  # texts longer than t words
    best = scores[first].copy()
    stay = np.ones((total, langs), bool)
    origin = np.zeros(total, np.int16)
    for t in range(1, length[0]):
        k = active[t]
        now = best[:k]
        top = now.argmax(1)
        jump = now[np.arange(k), top] - switch
        keep = now >= jump[:, None]
        at = first[:k] + t
        stay[at], origin[at] = keep, top
        best[:k] = np.where(keep, now, jump[:, None]) + scores[at]
        best[:k] -= best[:k].max(1, keepdims=True)
    state = best.argmax(1)  # best of each text stays as it was at its last word
    for t in range(length[0] - 1, -1, -1):
        k = active[t]
        at = first[:k] + t
        labels[at] = state[:k]
        if t:
            state[:k] = np.where(stay[at, state[:k]], state[:k], origin[at])
    return labels


def label_batch(batch: pa.RecordBatch, shared, spans: bool):
    """Predictions for slices of a batch whose last column is the text, longest texts first.

    All texts of a slice advance together, so a slice takes as many steps as its longest text has words.
    """
    scorer = resident(shared.value, lambda: Scorer(shared.value))
    langs = np.array(scorer.model["langs"], object)
    sizes = pc.fill_null(pc.binary_length(batch.column(batch.num_columns - 1)), 0).to_numpy(zero_copy_only=False)
    order = np.argsort(-sizes, kind="stable")
    for a, b in slices(sizes[order].tolist(), lambda n: n, LABEL_BYTES):
        part = batch.take(pa.array(order[a:b]))
        texts = part.column(part.num_columns - 1).to_pylist()
        n = len(texts)
        if len(langs):
            found = [words_of(t) if t else [] for t in texts]
            words = [w for f in found for w in f]
            lengths = np.fromiter(map(len, found), np.int64, n)
            scored = scorer(words) if words else np.zeros((0, len(langs) + 1), np.float32)
            labels = viterbi(np.ascontiguousarray(scored[:, :-1]), lengths)
            owner = np.repeat(np.arange(n), lengths)
            letters = np.fromiter(map(len, words), np.float64, len(words))
            share = np.bincount(owner * len(langs) + labels, letters, n * len(langs)).reshape(n, -1)
            top, of = share.argmax(1), share.sum(1)
            score = np.where(of > 0, share.max(1) / np.maximum(of, 1), 0.0)
            names = np.where(of > 0, langs[top], "und")
            known = np.bincount(owner, letters * scored[:, -1], n) / np.maximum(of, 1)
        else:
            names, score, known = np.full(n, "und", object), np.zeros(n), np.zeros(n)
        made = [pa.array(names.tolist(), pa.string()), pa.array(score, pa.float64()), pa.array(known, pa.float64())]
        columns = ["lang_pred", "score", "known"]
        if spans:
            kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string())]))
            at = np.cumsum(lengths) - lengths if len(langs) else None
            made.append(pa.array([_spans(t, labels[a : a + m], langs) if len(langs) else [] for t, a, m in zip(texts, at, lengths, strict=True)] if len(langs) else [[]] * n, kind))
            columns.append("spans")
        yield pa.RecordBatch.from_arrays([*part.columns[:-1], *made], [*part.schema.names[:-1], *columns])


def _spans(text: str | None, labels: np.ndarray, langs: np.ndarray) -> list[dict]:
    """Runs of words of one label as character ranges of the text."""
    found: list[dict] = []
    lowered = (text or "").lower()
    for m, label in zip(pattern_of(lowered).finditer(lowered), labels, strict=True):
        if found and found[-1]["lang"] == langs[label]:
            found[-1]["end"] = m.end()
        else:
            found.append({"start": m.start(), "end": m.end(), "lang": langs[label]})
    return found


def predict(docs: DataFrame, model: dict, text: str = "text", keep: tuple[str, ...] = ("doc_id",), spans: bool = False) -> DataFrame:
    """The kept columns with lang_pred, score, known (the share of letters in words of a script that was learned), and
    with spans (character ranges of the lower-cased text)."""
    spark = docs.sparkSession
    ready(spark)
    shared = spark.sparkContext.broadcast(model)
    more = "lang_pred string, score double, known double" + ", spans array<struct<start:int,end:int,lang:string>>" * spans
    fields = spark.createDataFrame([], more).schema
    fields = type(fields)(docs.select(*keep).schema.fields + fields.fields)

    def run(batches):
        from attestia.llm import langid

        for batch in batches:
            yield from langid.label_batch(batch, shared, spans)

    return docs.select(*keep, F.col(text).cast("string").alias("_text")).mapInArrow(run, fields)


def model_of(docs: DataFrame) -> dict:
    """The model learned from the rows of a document table that are not held out."""
    return learn(docs.filter(~held_out(F.col("doc_id"))))


def accept(docs: DataFrame, model: dict, least: float = 0.3) -> DataFrame:
    """Documents whose language is known with at least this share of their letters, with their own columns.

    Letters in scripts that no language of the training rows uses count as unknown.
    """
    told = predict(docs.select(F.struct("*").alias("row"), F.col("text").alias("body")), model, text="body", keep=("row",))
    return told.filter((F.col("lang_pred") != "und") & (F.col("score") * F.col("known") >= least)).select("row.*")
