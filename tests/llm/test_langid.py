import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from attestia.llm import langid

SYLLABLES = {
    "en": ["th", "ing", "er", "and", "st", "wh", "ou", "ly"],
    "fr": ["eau", "que", "é", "ment", "oi", "eux", "tre", "la"],
    "de": ["sch", "ung", "ü", "ein", "ß", "ge", "keit", "ich"],
    "ru": ["ра", "на", "ст", "ов", "ие", "при", "ъ", "мы"],
}


def text(lang, n, r):
    return " ".join("".join(r.choices(SYLLABLES[lang], k=r.randint(1, 4))) for _ in range(n))


def corpus(spark, n=400):
    r = random.Random(3)
    rows = [(i, lang := r.choice(list(SYLLABLES)), text(lang, r.randint(3, 60), r)) for i in range(n)]
    return spark.createDataFrame([(i, t, x, "s", 0.0) for i, x, t in rows], "doc_id long, text string, lang string, lang_pred string, score double")


def test_held_out_accuracy_and_scripts(spark):
    docs = corpus(spark)
    model = langid.model_of(docs)
    told = langid.predict(docs.drop("lang_pred", "score"), model, keep=("doc_id", "lang")).collect()
    assert {r.doc_id for r in docs.filter(langid.held_out(F.col("doc_id"))).collect()} == {i for i in range(400) if zlib.crc32(str(i).encode()) % 3 == 1}
    unseen = [r for r in told if zlib.crc32(str(r.doc_id).encode()) % 3 == 1]
    assert len(unseen) > 100 and np.mean([r.lang == r.lang_pred for r in unseen]) > 0.98
    assert all(0 < r.score <= 1 for r in told)


def test_spans_of_mixed_text(spark):
    model = langid.model_of(corpus(spark))
    r = random.Random(1)
    a, b = text("en", 20, r), text("fr", 30, r)
    row = langid.predict(spark.createDataFrame([(1, a + ". " + b)], "doc_id long, text string"), model, spans=True).first()
    assert row.lang_pred == "fr" and [s.lang for s in row.spans] == ["en", "fr"]
    assert abs(row.spans[1].start - len(a) - 2) < 12 and row.spans[1].end == len(a + ". " + b)


def brute_viterbi(scores, switch):
    n, k = scores.shape
    best, back = [scores[0]], []
    for t in range(1, n):
        step = best[-1][:, None] - switch * (1 - np.eye(k)) + scores[t][None]
        back.append(step.argmax(0))
        best.append(step.max(0))
    path = [int(best[-1].argmax())]
    for b in reversed(back):
        path.append(int(b[path[-1]]))
    value = max(best[-1])
    return path[::-1], value


def test_viterbi_finds_the_best_path():
    rng = np.random.default_rng(0)
    lengths = np.array([5, 0, 1, 9, 3])
    scores = rng.normal(0, 4, (lengths.sum(), 3)).astype(np.float32)
    labels = langid.viterbi(scores, lengths, 5.0)
    at = 0
    for n in lengths.tolist():
        if n:
            part, got = scores[at : at + n].astype(float), labels[at : at + n]
            value = part[np.arange(n), got].sum() - 5.0 * (np.diff(got) != 0).sum()
            assert abs(value - brute_viterbi(part, 5.0)[1]) < 1e-3
        at += n


def test_letters_and_marks():
    assert langid.words_of("½ ² ① Ⅳ _ 12") == []
    assert langid.words_of("हिन्दी भाषा") == ["हिन्दी", "भाषा"]
    assert langid.words_of("Don’t STOP – à l’été") == ["don", "t", "stop", "à", "l", "été"]
    assert langid.words_of("ªbº×÷ĂȘ") == ["ªbº", "ăș"] and langid.words_of("Привет, мир ½") == ["привет", "мир"]
    every = "".join(map(chr, [*range(0x250), *range(0x2000, 0x2070)]))
    assert langid.PLAIN_WORDS.findall(every) == langid.WORDS.findall(every)


def test_texts_without_letters_and_of_other_scripts(spark):
    docs = corpus(spark, 200).filter("lang <> 'ru'")
    model = langid.model_of(docs)
    odd = spark.createDataFrame([(1, "½ ² Ⅳ"), (2, "Καλημέρα κόσμε"), (3, text("ru", 20, random.Random(1))), (4, "thing ing ther")], "doc_id long, text string")
    got = {r.doc_id: r for r in langid.predict(odd, model).collect()}
    assert (got[1].lang_pred, got[1].score) == ("und", 0.0)
    assert got[2].known == got[3].known == 0.0 and got[4].known == 1.0
    assert [r.doc_id for r in langid.accept(odd, model).collect()] == [4]


def test_a_large_label_is_still_learned(spark, monkeypatch):
    docs = corpus(spark, 300)
    kept = langid.durable
    monkeypatch.setattr(langid, "durable", lambda df, label: kept(df.withColumn("_n", F.when(F.col("_lang") == "fr", F.lit(2_000_000_000)).otherwise(F.col("_n"))), label))
    model = langid.learn(docs, sample=2_000_000_000)  # every row of fr is drawn with a share of exactly 1
    assert model["langs"] == ["de", "en", "fr", "ru"]
    monkeypatch.setattr(langid, "durable", lambda df, label: kept(df.withColumn("_n", F.lit(2_000_000_000)), label))
    model = langid.learn(docs, sample=1_000_000_000)  # each with a share of a half
    assert model["langs"] == ["de", "en", "fr", "ru"]


def test_nulls_and_nothing_learned(spark):
    docs = corpus(spark, 60)
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "12 !? 34"), (None, "thing"), (5, "thing " * 30000), (5, "thing")], "doc_id long, text string")
    got = [(r.doc_id, r.lang_pred, r.score) for r in langid.predict(odd, langid.model_of(docs)).collect()]
    assert [x[1:] for x in got if x[0] in (1, 2, 3)] == [("und", 0.0)] * 3
    assert {x[1] for x in got if x[0] in (None, 5)} == {"en"} and len(got) == 6
    bare = langid.learn(docs.limit(0))
    assert {r.lang_pred for r in langid.predict(odd, bare, spans=True).collect()} == {"und"}
    assert langid.accept(docs, langid.model_of(docs)).columns == docs.columns
    assert langid.predict(odd.limit(0), bare).count() == 0


def test_rows_without_or_with_one_id_are_drawn_each_for_itself(spark):
    own = [(None, f"le chat numéro {k} dort dans la maison", "fr") for k in range(300)] + [(7, f"der hund nummer {k} schläft im haus", "de") for k in range(300)]
    copies = [(None, "the cat sleeps in the house", "en")] * 300
    model = langid.learn(spark.createDataFrame(own + copies, "doc_id long, text string, lang string"), sample=60)
    assert model["langs"] == ["de", "en", "fr"]
    drawn = spark.createDataFrame(own, "doc_id long, text string, lang string")
    told = langid.predict(drawn.filter("lang = 'fr'"), model).filter("lang_pred = 'fr'").count()
    assert told > 290
