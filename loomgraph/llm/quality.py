"""Quality rules with adaptive thresholds from mergeable quantile sketches.

Base counts are taken per document inside the JVM. Four rates follow from them,
as whole numbers: symbols per 1000 word characters, repeated lines per 1000
lines with a word, words in repeated windows per 1000 words, word characters
per 100 words. For each language and source every rate has a quantile sketch: a
histogram whose bucket is the value's leading 7 binary digits (exact below 128,
error under 1/64 above), at most some 4,000 buckets whatever the rows. Sketches
merge by adding up counts, which is what the shuffle does; a source with fewer
than `min_group` documents uses its language's merged sketch, a language with
fewer the whole corpus's. Whole-number buckets make thresholds repeatable.

Thresholds are far fences, q3 + spread * max(q3 - q1, slack) (for word length
also q1 - ...), so a homogeneous group loses nothing and junk stands out against
its own source. The fences, a row a group, are joined to the documents.

Defined results: a null text has no words, so base_failed; a null language or
source is a group of its own; repeated rows are counted as they are; empty
tables give empty results; other columns are not read by `quality`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import ASCII_SPACE, documents, frozen, positional

#: rate: (slack, two-sided)
RATES = {"symbols": (20, False), "dup_lines": (150, False), "repeats": (150, False), "word_length": (100, True)}
SPREAD = 3
MIN_GROUP = 200


def let(value: Column, body) -> Column:
    """body(value) with value computed once, although lambdas in body use it for each element."""
    return F.transform(F.array(value), body)[0]


def repeat_words(words: Column) -> Column:
    """Words in 3-word windows that occur twice or more in the document."""

    def windows(w):
        return F.transform(
            F.sequence(F.lit(0), F.size(w) - 3),
            lambda i: F.xxhash64(w[i], w[i + 1], w[i + 2]),
        )

    def same(w, a, b):
        return (a["h"] == b["h"]) & (w[a["p"]] == w[b["p"]]) & (w[a["p"] + 1] == w[b["p"] + 1]) & (w[a["p"] + 2] == w[b["p"] + 2])

    def repeated(w, h):
        order = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("p"))))
        twice = let(order, lambda s: F.filter(s, lambda x, k: (
            F.when(k > 0, same(w, s[F.greatest(k - 1, F.lit(0))], x)).otherwise(F.lit(False))
            | F.when(k < F.size(s) - 1, same(w, s[F.least(k + 1, F.size(s) - 1)], x)).otherwise(F.lit(False))
        )))
        places = F.array_sort(F.transform(twice, lambda x: x["p"]))
        return let(places, lambda p: F.aggregate(
            F.transform(p, lambda x, k: F.when(k == F.size(p) - 1, F.lit(3)).otherwise(F.least(F.lit(3), p[F.least(k + 1, F.size(p) - 1)] - x))),
            F.lit(0), lambda a, b: a + b,
        ))

    count = let(words, lambda w: let(windows(w), lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(repeated(w, h))))
    return F.when(F.size(words) < 4, F.lit(0)).otherwise(count)


def base_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", group_cols=("lang", "source")) -> DataFrame:
    """id, lang, source, the base counts and n_lines (lines with a word)."""
    docs, ident, text, *group = positional(docs, id_col, text_col, *group_cols)
    text = F.coalesce(F.col(text), F.lit(""))
    bare = F.trim("t", F.lit(ASCII_SPACE))
    without = F.octet_length("t")
    for c in "#*$%&|<>":
        without = without - (F.octet_length("t") - F.octet_length(F.replace("t", F.lit(c))))
    rows = docs.select(F.col(ident).alias("id"), *[F.col(c).cast("string").alias(k) for k, c in zip(("lang", "source"), group, strict=True)], text.alias("t"))
    rows = rows.select("id", "lang", "source",
        F.when(F.length(bare) == 0, F.array().cast("array<string>")).otherwise(F.split(bare, r"[\x20\x09-\x0D]+")).alias("w"),
        F.filter(F.split("t", "\n"), lambda x: F.length(F.trim(x, F.lit(ASCII_SPACE))) > 0).alias("lines"),
        (F.octet_length("t") - without).cast("long").alias("n_symbols"),
        F.length(F.translate("t", ASCII_SPACE, "")).cast("long").alias("word_chars"),
    )
    return rows.select("id", "lang", "source",
        F.size("w").cast("long").alias("n_words"), "word_chars", "n_symbols",
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        repeat_words(F.col("w")).cast("long").alias("n_repeat_words"),
    )


def rates(rows: DataFrame) -> DataFrame:
    per = lambda a, b, n: F.when(F.col(b) == 0, F.lit(0)).otherwise(F.expr(f"({n} * {a}) div {b}")).cast("long")
    return rows.withColumns({
        "symbols": per("n_symbols", "word_chars", 1000), "dup_lines": per("n_dup_lines", "n_lines", 1000),
        "repeats": per("n_repeat_words", "n_words", 1000), "word_length": per("word_chars", "n_words", 100),
    })


def bucket(v: Column) -> Column:
    shift = F.greatest(F.length(F.bin(v)) - 7, F.lit(0))
    return F.call_function("shiftleft", F.call_function("shiftright", v, shift), shift)


def sketches(rows: DataFrame) -> DataFrame:
    """Mergeable sketches: a row a language, source, rate and bucket."""
    long = rows.select("lang", "source", F.explode(F.array(*[F.struct(F.lit(k).alias("rate"), bucket(F.col(k)).alias("b")) for k in RATES])).alias("x"))
    return long.groupBy("lang", "source", "x.rate", "x.b").agg(F.count(F.lit(1)).alias("n"))


def quantiles(sketch: DataFrame, keys: list[str]) -> DataFrame:
    """keys, rate, total, q1, q3 of sketches merged to keys."""
    merged = sketch.groupBy(*keys, "rate", "b").agg(F.sum("n").alias("n"))
    upto = merged.withColumns({
        "seen": F.sum("n").over(Window.partitionBy(*keys, "rate").orderBy("b")),
        "total": F.sum("n").over(Window.partitionBy(*keys, "rate")),
    })
    at = lambda q: F.min(F.when(F.col("seen") * 4 >= F.col("total") * q, F.col("b")))
    return upto.groupBy(*keys, "rate").agg(F.max("total").alias("total"), at(1).alias("q1"), at(3).alias("q3"))


def fences(sketch: DataFrame, spread: int = SPREAD, min_group: int = MIN_GROUP) -> DataFrame:
    """lang, source and the bounds lo_/hi_ of each rate: a row a language and source."""
    own = quantiles(sketch, ["lang", "source"])
    by_lang = quantiles(sketch, ["lang"]).select(F.col("lang").alias("l"), F.col("rate").alias("r"), F.struct("total", "q1", "q3").alias("by_lang"))
    whole = quantiles(sketch, []).select(F.col("rate").alias("a"), F.struct("total", "q1", "q3").alias("whole"))
    j = own.join(by_lang, own["lang"].eqNullSafe(F.col("l")) & (own["rate"] == F.col("r"))).join(whole, own["rate"] == F.col("a"))
    pick = F.when(F.col("total") >= min_group, F.struct("total", "q1", "q3")).when(F.col("by_lang.total") >= min_group, F.col("by_lang")).otherwise(F.col("whole"))
    slack = F.coalesce(*[F.when(F.col("rate") == k, F.lit(v[0])) for k, v in RATES.items()])
    two = F.col("rate").isin([k for k, v in RATES.items() if v[1]])
    j = j.select("lang", "source", "rate", pick.alias("q"), slack.alias("slack"), two.alias("two"))
    far = F.lit(spread) * F.greatest(F.col("q.q3") - F.col("q.q1"), F.col("slack"))
    j = j.select("lang", "source", "rate", F.when(F.col("two"), F.col("q.q1") - far).alias("lo"), (F.col("q.q3") + far).alias("hi"))
    return j.groupBy("lang", "source").agg(
        *[F.max(F.when(F.col("rate") == k, F.col("hi"))).alias(f"hi_{k}") for k in RATES],
        *[F.max(F.when(F.col("rate") == k, F.col("lo"))).alias(f"lo_{k}") for k, v in RATES.items() if v[1]],
    )


def quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", spread: int = SPREAD, min_group: int = MIN_GROUP) -> DataFrame:
    rows = frozen(rates(base_counts(docs, id_col, text_col, (lang_col, source_col))), "quality")
    key = lambda d: F.to_json(F.struct(F.col("lang"), F.col("source")), {"ignoreNullFields": "false"})
    bounds = fences(sketches(rows), spread, min_group).withColumn("k", key(None)).drop("lang", "source")
    j = rows.withColumn("k", key(None)).join(bounds, "k")
    failed = (F.col("n_words") < 50) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50)
    inside = F.lit(True)
    for k, v in RATES.items():
        inside = inside & (F.col(k) <= F.col(f"hi_{k}"))
        if v[1]:
            inside = inside & (F.col(k) >= F.col(f"lo_{k}"))
    return j.select(F.col("id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & inside).alias("kept"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(documents(spark, sf_dir))


_WS = r"[\x20\x09-\x0D]"
_RATES_SQL = ", ".join(f"('{k}', {k}, {v[0]}, {str(v[1]).lower()})" for k, v in RATES.items())
ORACLE = rf"""
WITH d AS (SELECT doc_id, lang, source, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
b AS (SELECT doc_id, lang, source, t, w, len(w)::BIGINT AS n_words, length(regexp_replace(t, '{_WS}+', '', 'g'))::BIGINT AS word_chars,
        length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols,
        list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
g AS (SELECT doc_id, i, (w[i], w[i + 1], w[i + 2]) AS g FROM (SELECT doc_id, w, unnest(range(1, n_words - 1)) AS i FROM b)),
p AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM g) WHERE n > 1),
r AS (SELECT doc_id, count(DISTINCT i + o)::BIGINT AS n_repeat_words FROM p, (VALUES (0), (1), (2)) AS v(o) GROUP BY doc_id),
c AS (SELECT doc_id, lang, source, n_words, word_chars, n_symbols, len(lines)::BIGINT AS n_lines,
        (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words FROM b LEFT JOIN r USING (doc_id)),
m AS (SELECT *, CASE WHEN word_chars = 0 THEN 0 ELSE 1000 * n_symbols // word_chars END AS symbols,
        CASE WHEN n_lines = 0 THEN 0 ELSE 1000 * n_dup_lines // n_lines END AS dup_lines,
        CASE WHEN n_words = 0 THEN 0 ELSE 1000 * n_repeat_words // n_words END AS repeats,
        CASE WHEN n_words = 0 THEN 0 ELSE 100 * word_chars // n_words END AS word_length FROM c),
l AS (SELECT doc_id, lang, source, rate, v, slack, two, CASE WHEN v < 128 THEN v ELSE (v >> (length(bin(v)) - 7)) << (length(bin(v)) - 7) END AS x
      FROM m, LATERAL (VALUES {_RATES_SQL}) AS k(rate, v, slack, two)),
q AS (SELECT lang, source, rate, any_value(slack) AS slack, bool_or(two) AS two, count(*) AS n, quantile_disc(x, 0.25) AS q1, quantile_disc(x, 0.75) AS q3 FROM l GROUP BY lang, source, rate),
ql AS (SELECT lang, rate, count(*) AS n, quantile_disc(x, 0.25) AS q1, quantile_disc(x, 0.75) AS q3 FROM l GROUP BY lang, rate),
qa AS (SELECT rate, quantile_disc(x, 0.25) AS q1, quantile_disc(x, 0.75) AS q3 FROM l GROUP BY rate),
f AS (SELECT q.lang, q.source, q.rate, slack, two,
        CASE WHEN q.n >= {MIN_GROUP} THEN q.q1 WHEN ql.n >= {MIN_GROUP} THEN ql.q1 ELSE qa.q1 END AS q1,
        CASE WHEN q.n >= {MIN_GROUP} THEN q.q3 WHEN ql.n >= {MIN_GROUP} THEN ql.q3 ELSE qa.q3 END AS q3
      FROM q JOIN ql ON q.lang IS NOT DISTINCT FROM ql.lang AND q.rate = ql.rate JOIN qa ON q.rate = qa.rate),
o AS (SELECT l.doc_id, bool_or(v > q3 + {SPREAD} * greatest(q3 - q1, f.slack) OR (f.two AND v < q1 - {SPREAD} * greatest(q3 - q1, f.slack))) AS out
      FROM l JOIN f ON l.lang IS NOT DISTINCT FROM f.lang AND l.source IS NOT DISTINCT FROM f.source AND l.rate = f.rate GROUP BY l.doc_id)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND NOT out AS kept
FROM m JOIN o USING (doc_id)
"""
