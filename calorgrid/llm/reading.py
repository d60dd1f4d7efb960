"""Reading level by a familiar-word formula.

The score of a text is a weighted sum of the share of its words outside a list of familiar words and the
logarithm of its average sentence length. Familiar are the words of high document frequency among the texts
for general readers: first those rated so, then all prose documents of the corpus that the formula grades
so. A word's share of documents is the only condition, so the list has a bound (words per document over the
share) whatever the size of the corpus. English prose is told by marker words, drawn from the document
frequencies of texts labelled English and texts labelled otherwise; the labels may be wrong for many texts.
Weights and the cut come from mergeable sums over all ratings.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from calorgrid.runtime import drop_scratch, scratch, spread

WORD = r"[a-z]+(?:['’-][a-z]+)*"
SENTENCE_END = r"[.!?]+(?:\s|$)|\n\s*\n"
CJK = r"[぀-ヿ㐀-鿿]"
#: Texts with fewer words are too short to judge.
FEWEST_WORDS = 8
#: A familiar word is in this share of the general readers' documents.
FAMILIAR = 0.05
#: A marker is in this share of the documents labelled so; of those it is in, the share labelled English (English), the ratio of shares (other).
MARKER, PURE, TIMES = 0.1, 0.8, 3.0
#: English prose consists of English markers to this share.
ENGLISH = 0.2
#: From this level on a text is demanding.
DEMANDING = 3.5
#: Weights (per share, per logarithm of 1 + words of a sentence, constant) where nothing is rated (fixed values).
DEFAULT = (4.0, 0.2, 1.5)


def features(docs: DataFrame, doc_id: str, text: str, lang: str | None = None) -> DataFrame:
    """``doc_id, words, sentence_words, latin, cjk, english`` of each text; the whole text is read.

    A null text has no words. Words are runs of Latin letters. ``english`` says whether the text is labelled
    English, null where the label names no language; without labels every text counts as labelled English.
    """
    label = F.lower(F.trim(F.col(lang))) if lang else F.lit("en")
    english = F.when(label.rlike("^[a-z]{2}([-_].*)?$"), label.startswith("en"))
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.lower(text), F.lit("")).alias("t"), english.alias("english"))
    rows = spread(rows, "doc_id").withColumn("words", F.expr(f'regexp_extract_all(t, r"{WORD}", 0)'))
    latin = F.length(F.regexp_replace("t", "[^a-z]", ""))
    cjk = F.length("t") - F.length(F.regexp_replace("t", CJK, ""))
    sentences = F.greatest(F.lit(1), F.size(F.filter(F.split("t", SENTENCE_END), lambda s: s.rlike("[a-z]"))))
    return rows.select("doc_id", "words", (F.size("words") / sentences).alias("sentence_words"), latin.alias("latin"), cjk.alias("cjk"), "english")


def _among(words: list[str]) -> Column:
    """How many of a row's ``words`` are in the list."""
    quoted = ", ".join(f'"{w}"' for w in words) or '""'
    return F.expr(f"size(filter(words, w -> w in ({quoted})))")


def markers(feats: DataFrame) -> tuple[list[str], list[str]]:
    """Words that mark English and other languages, by document frequency over all labelled texts; each list has at most words per document / MARKER entries."""
    told = feats.where(F.col("english").isNotNull() & (F.size("words") >= FEWEST_WORDS))
    n = told.agg(F.count_if("english").alias("en"), F.count_if(~F.col("english")).alias("other")).first()
    en, other = (n["en"] or 0), (n["other"] or 0)
    df = told.select(F.explode(F.array_distinct("words")).alias("word"), F.col("english").cast("long").alias("e")).groupBy("word").agg(F.sum("e").alias("en"), F.sum(1 - F.col("e")).alias("other"))
    is_en = (F.col("en") >= max(2.0, MARKER * en)) & (F.col("en") >= PURE * (F.col("en") + F.col("other")))
    is_other = (F.col("other") >= max(2.0, MARKER / 2 * other)) & (F.col("other") * max(1, en) >= TIMES * max(1, other) * F.col("en"))
    got = df.where(is_en | is_other).select("word", is_en.alias("en")).collect()
    return sorted(r["word"] for r in got if r["en"]), sorted(r["word"] for r in got if not r["en"])


def with_prose(feats: DataFrame, english: list[str], other: list[str]) -> DataFrame:
    """``doc_id, words, sentence_words, prose``; ``prose`` means mostly English running text: enough words, enough English markers, more than other ones, hardly any CJK."""
    n = F.size("words")
    prose = (n >= FEWEST_WORDS) & (_among(english) >= ENGLISH * n) & (_among(english) > _among(other)) & (F.col("latin") > 2.5 * F.col("cjk"))
    return feats.select("doc_id", "words", "sentence_words", prose.alias("prose"))


def familiar_words(texts: DataFrame, share: float = FAMILIAR) -> list[str]:
    """Words that are in at least ``share`` of the texts (``words``): at most words per text / share of them, so they may be collected."""
    n = texts.count()
    df = texts.select(F.explode(F.array_distinct("words")).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    return sorted(r["word"] for r in df.where(F.col("n") >= share * n).select("word").collect())


@dataclass(frozen=True)
class Formula:
    """The fitted formula: ``level = weights . (share, ln(1 + sentence_words), 1)``, demanding from ``cut``."""

    familiar: list[str]
    weights: tuple[float, float, float]
    cut: float

    def share(self) -> Column:
        return 1 - _among(self.familiar) / F.greatest(F.lit(1), F.size("words"))

    def score(self) -> Column:
        a, b, c = self.weights
        return F.lit(a) * self.share() + F.lit(b) * F.log1p("sentence_words") + F.lit(c)


def _regress(rated: DataFrame, familiar: list[str]) -> Formula:
    """Least squares and best cut from sums over all rated documents; the cut is the middle of the best stretch."""
    plain = Formula(familiar, DEFAULT, DEMANDING)
    f = rated.select(plain.share().alias("x"), F.log1p("sentence_words").alias("z"), F.col("level").alias("y"))
    terms = {"xx": "x*x", "xz": "x*z", "x1": "x", "zz": "z*z", "z1": "z", "n": "1", "xy": "x*y", "zy": "z*y", "y1": "y"}
    s = f.agg(*[F.sum(F.expr(e)).alias(k) for k, e in terms.items()]).first()
    if not s["n"]:
        return plain
    m = np.array([[s["xx"], s["xz"], s["x1"]], [s["xz"], s["zz"], s["z1"]], [s["x1"], s["z1"], s["n"]]], dtype=float)
    weights = tuple(float(w) for w in np.linalg.solve(m + 1e-9 * np.eye(3) * max(1.0, np.trace(m)), np.array([s["xy"], s["zy"], s["y1"]], dtype=float)))
    fitted = Formula(familiar, weights, DEMANDING)
    cells = rated.groupBy(F.floor(fitted.score() * 50).cast("int").alias("cell")).agg(F.count_if(F.col("level") >= DEMANDING).alias("h"), F.count_if(F.col("level") < DEMANDING).alias("e"))
    got = {r["cell"]: (r["h"], r["e"]) for r in cells.collect()}  # shares and logarithms span some hundred cells
    at = sorted({k + d for k in got for d in (0, 1)})
    hard, easy, right = sum(h for h, _ in got.values()), 0, []
    for k in at:  # demanding from cell k on
        right.append(hard + easy)
        h, e = got.get(k, (0, 0))
        hard, easy = hard - h, easy + e
    best = [k for k, r in zip(at, right) if r >= max(right) - 0.0015 * s["n"]]
    return Formula(familiar, weights, (best[0] + best[-1]) / 2 / 50)


def fit(prose: DataFrame, ratings: DataFrame, doc_id: str, level: str, share: float = FAMILIAR) -> Formula:
    """The formula of a corpus: list from the documents rated for general readers, then from all prose documents that it grades so.

    Levels outside 1..5 and nulls are left out, several ratings of a document are averaged. Without any
    rating the list is drawn from all prose and the default weights are used.
    """
    r = ratings.where(F.col(level).between(1, 5)).groupBy(F.col(doc_id).cast("long").alias("__d")).agg(F.avg(level).alias("level"))
    rated = scratch(prose.join(r, F.col("doc_id") == F.col("__d")).select("words", "sentence_words", "level"))
    general = rated.where(F.col("level") < DEMANDING)
    if general.isEmpty():
        general = prose
    formula = _regress(rated, familiar_words(general, share))
    formula = _regress(rated, familiar_words(prose.where(formula.score() < formula.cut), share))
    drop_scratch(rated)
    return formula


def reading_levels(docs: DataFrame, ratings: DataFrame, *, doc_id: str = "doc_id", text: str = "text", lang: str | None = "lang", level: str = "reading_level") -> DataFrame:
    """``doc_id, prose, unfamiliar_share, sentence_words, level, demanding`` of every document.

    ``level`` is the estimate within 1..5, null where the text is no English prose (null, blank and very
    short texts, tables, logs, other languages), where ``demanding`` is false. ``lang`` labels need not be
    right; without them (``None``) markers of the corpus's main language decide. Repeated rows come out
    repeatedly; an empty corpus gives no rows. One pass over the texts; markers and lists cost a shuffle of
    document frequencies each.
    """
    feats = scratch(features(docs, doc_id, text, lang))
    told = scratch(with_prose(feats, *markers(feats)))
    drop_scratch(feats)
    formula = fit(told.where("prose"), ratings, doc_id, level)
    score = formula.score()
    return told.select(
        F.col("doc_id").alias(doc_id), "prose", formula.share().alias("unfamiliar_share"), "sentence_words",
        F.when(F.col("prose"), F.greatest(F.lit(1.0), F.least(F.lit(5.0), score))).alias("level"), (F.col("prose") & (score >= formula.cut)).alias("demanding"),
    )
