"""Language identification: word first, backing off to shorter and shorter character n-grams.

The model holds, for each language, the log frequency of its known words and of
the character n-grams (5 to 1, with word ends marked) of its words. A known word
scores by its log frequency; a word not seen in training scores by the mean log
frequency of its known 5-grams, or, if none of them is known, of its 4-grams,
and so on down to single letters. A text's score for a language is the sum over
its words; the answer is the largest, its score a softmax of the sums per word,
sharpened by the square root of the number of words.

Training uses at most ``sample`` documents and of them at most ``max_chars``
characters; languages take turns (each in the order of hashed ids), so that a
rare one is learned too. Of the words and n-grams seen at least ``least`` times
(n-grams of one and two letters always) the ``max_words`` and ``max_grams`` most
frequent are kept. All are parameters. Prediction reads every whole text; within
an Arrow batch each distinct word is scored once.

Defined cases: null texts and texts without a letter are ``und`` with score 0;
null languages are not learned; with nothing to learn from every answer is
``und``; documents that would exceed ``max_chars`` are passed over, and if all
would, the shortest is learned whole; rows that share id, language and text are
learned once; ties go to the language that sorts first; an empty table gives no
rows; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import crc_mod, ship

ship(__name__)
WORD = re.compile(r"[^\W\d_]+")
ORDERS = (5, 4, 3, 2, 1)


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


def has_letter(words: list[str]) -> bool:
    return any(c.isalpha() for w in words for c in w)


class Model:
    def __init__(self, langs: list[str], words: dict[str, int], word_logs: np.ndarray, grams: dict[str, int], gram_logs: np.ndarray):
        self.langs, self.words, self.word_logs, self.grams, self.gram_logs = langs, words, word_logs, grams, gram_logs

    def back_off(self, words: list[str]) -> np.ndarray:
        """A row for each unseen word: the mean over its known n-grams of the highest order that has any; zeros if none has."""
        at, flat, counts = self.grams.get, [], []
        for word in words:
            padded = f"^{word}$"
            known = ()
            for n in ORDERS:
                known = [i for j in range(len(padded) - n + 1) if (i := at(padded[j : j + n])) is not None]
                if known:
                    break
            flat += known
            counts.append(len(known))
        out = np.zeros((len(words), len(self.langs)))
        n = np.array(counts)
        if flat:
            some = n > 0
            starts = (np.cumsum(n) - n)[some]
            out[some] = np.add.reduceat(self.gram_logs[flat], starts) / n[some, None]
        return out

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        lists = [words_of(t) if t else [] for t in texts]
        n = np.array([len(x) for x in lists])
        lang, score = ["und"] * len(texts), [0.0] * len(texts)
        if not n.sum() or not self.langs:
            return lang, score
        codes, uniques = pd.factorize(np.array([w for x in lists for w in x], object))
        at = np.array([self.words.get(w, -1) for w in uniques])
        logs = np.empty((len(uniques), len(self.langs)))
        logs[at >= 0] = self.word_logs[at[at >= 0]]
        unseen = np.flatnonzero(at < 0)
        if len(unseen):
            logs[unseen] = self.back_off([uniques[i] for i in unseen])
        logs -= logs.max(1, keepdims=True)
        doc = np.repeat(np.arange(len(texts)), n)
        total = np.stack([np.bincount(doc, logs[codes, j], len(texts)) for j in range(len(self.langs))], 1)
        for i in np.flatnonzero(n):
            if not has_letter(lists[i][:50]) and not has_letter(lists[i]):
                continue
            z = total[i] / np.sqrt(n[i])
            p = np.exp(z - z.max())
            best = int(z.argmax())
            lang[i], score[i] = self.langs[best], float(p[best] / p.sum())
        return lang, score


def train(texts: list[str], langs: list[str], max_words: int = 60_000, max_grams: int = 120_000, least: int = 3) -> Model:
    names = sorted(set(langs))
    per = {name: Counter() for name in names}
    for t, name in zip(texts, langs):
        per[name].update(words_of(t))
    total = Counter()
    for c in per.values():
        total.update(c)
    k = len(names)

    def logs(keys, counts, floor):
        sums = np.array([[counts[name].get(x, 0) for name in names] for x in keys], float).reshape(-1, k)
        size = np.array([max(1, sum(counts[name].values())) for name in names], float)
        return np.log((sums + floor) / (size + floor * max(1, len(keys))))

    known = [w for w, c in sorted(total.items(), key=lambda x: (-x[1], x[0]))[:max_words] if c >= least]
    grams = {name: Counter() for name in names}
    for name in names:
        for w, c in per[name].items():
            padded = f"^{w}$"
            for n in ORDERS:
                for j in range(len(padded) - n + 1):
                    grams[name][padded[j : j + n]] += c
    every = Counter()
    for c in grams.values():
        every.update(c)
    kept = [g for g, c in sorted(every.items(), key=lambda x: (-x[1], x[0]))[:max_grams] if c >= least or len(g) <= 2]
    return Model(names, {w: i for i, w in enumerate(known)}, logs(known, per, 0.5), {g: i for i, g in enumerate(kept)}, logs(kept, grams, 0.5))


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = 3000, max_chars: int = 6_000_000, **kwargs) -> Model:
    """Fit on documents whose crc32(id) mod 5 is not 0, by the bounds in the module's docstring."""
    base = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{lang_col}`").cast("string").alias("lang"), F.col(f"`{text_col}`").alias("text"))
    able = base.filter("lang is not null and text is not null").filter(crc_mod(F.col("id"), 5) != 0).withColumn("th", F.xxhash64("text")).withColumn("key", F.xxhash64("id", F.lit(13)))
    # the first ``sample`` of each share of a language's rows meet, never all rows of a language
    shares = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["key", F.col("id").asc_nulls_last(), "th"]
    narrow = able.select("lang", "key", "id", "th", F.length("text").alias("n"), F.pmod(F.xxhash64("key"), F.lit(shares)).alias("share"))
    some = narrow.withColumn("turn", F.dense_rank().over(Window.partitionBy("lang", "share").orderBy(*order))).filter(F.col("turn") <= sample).dropDuplicates(["lang", "share", "turn"])
    first = some.withColumn("turn", F.dense_rank().over(Window.partitionBy("lang").orderBy(*order))).filter(F.col("turn") <= sample)
    chosen = first.orderBy("turn", "lang").limit(sample).collect()
    held, picked = 0, []
    for r in chosen:
        if held + r["n"] <= max_chars:
            held += r["n"]
            picked.append((r["lang"], r["key"], r["th"]))
    if chosen and not picked:
        r = min(chosen, key=lambda r: r["n"])
        picked = [(r["lang"], r["key"], r["th"])]
    if not picked:
        return Model([], {}, np.zeros((0, 0)), {}, np.zeros((0, 0)))
    # at most ``sample`` keys, and one text for each
    keys = docs.sparkSession.createDataFrame(picked, "lang string, key long, th long")
    rows = able.join(F.broadcast(keys), ["lang", "key", "th"]).groupBy("lang", "key", "th").agg(F.min("text").alias("text")).orderBy("key", "lang", "th").select("lang", "text").toArrow()
    return train(rows.column("text").to_pylist(), rows.column("lang").to_pylist(), **kwargs)


def _predict(model: Model):
    def run(batches):
        for batch in batches:
            texts, lang, score = batch.column(batch.num_columns - 1).to_pylist(), [], []
            for i in range(0, len(texts), 500):
                a, b = model.predict(texts[i : i + 500])
                lang += a
                score += b
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=[*batch.schema.names[:-1], "lang_pred", "score"])

    return run


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score) of every row."""
    return docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text")).mapInArrow(_predict(model), "id long, lang_pred string, score double")
