"""Quality rules whose cutoffs come from the corpus itself; DataFrame functions only.

Each document is measured in one row expression (no explode, no shuffle of words). Quantile
sketches merge from all tasks, for each language and source, each language, and the whole corpus, and give the
median and an outer quantile of each measure over the documents that pass the base rules. A cutoff lies `reach`
times as far from the median as the outer quantile does, on its own side; a document is dropped where a
measure lies beyond. No constant is added, so a cutoff follows its group alone. A group of under LEAST_ROWS
documents takes the cutoffs of its language, and such a language those of the corpus.

Counted measures leave one event out (a symbol, a repeated line, a repeated window), as a share cannot be told from
zero by one. Sketches are percentile_approx buffers: partial ones meet before and after one shuffle
of three rows for each group and task, so a hot source is no hot task.

Defined results: null or blank text: no words, so base_failed; null language or source: a group
like any other; equal rows: each measured; null doc_id: kept as it is; an empty table: no rows.
keep_good returns the columns of its input as they came, whatever their names; measured and judged replace columns
that bear the names of the added ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import stash, table

NAME = "op9_quality"
SPACE = " \t\n\x0b\x0c\r"
WINDOW, LEAST_WORDS = 8, 20
#: Rank error of a sketch is at most 1 / ACCURACY of its rows.
ACCURACY = 10_000
#: Documents that a group's own sketch needs; smaller ones take those of the language, then of the corpus.
LEAST_ROWS = 100
#: measure: outer quantile below (None: no rule), outer quantile above, reach, words that one event covers.
RULES = {
    "mean_word": (0.1, 0.9, 5.0, 0),
    "symbols_per_word": (None, 0.9, 2.0, 1),
    "dup_line_share": (None, 0.99, 2.0, 8),
    "repeat_share": (None, 0.99, 2.0, 2 * WINDOW),
}


def let(value: Column, body) -> Column:
    """body(value), with value computed once however often body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _hashes(words: Column) -> Column:
    """A 64-bit hash of each window, from hashes of its words; two windows of one text that differ share one with a
    probability near 2^-64."""
    starts = F.sequence(F.lit(0), F.size(words) - WINDOW)
    return let(F.transform(words, lambda w: F.xxhash64(w)), lambda h: F.transform(starts, lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(WINDOW)])))


def _covered(hashes: Column) -> Column:
    """Words inside windows whose hash is there twice: sorted neighbours agree, then the union of their extents."""

    def repeated(s: Column) -> Column:
        def same(e: Column, k: Column) -> Column:
            before = F.when(k > 0, F.get(s, k - 1)["h"] == e["h"]).otherwise(F.lit(False))
            return before | F.coalesce(F.get(s, k + 1)["h"] == e["h"], F.lit(False))

        return F.sort_array(F.transform(F.filter(s, same), lambda e: e["i"]))

    places = let(F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i")))), repeated)
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("end"))
    step = lambda a, i: F.struct((a["n"] + i + WINDOW - F.greatest(a["end"], i)).cast("long").alias("n"), (i + WINDOW).alias("end"))
    return F.aggregate(places, start, step, lambda a: a["n"])


def _repeat_words(words: Column) -> Column:
    none = F.lit(0).cast("long")
    covered = let(_hashes(words), lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), none).otherwise(_covered(h)))
    return F.when(F.size(words) <= WINDOW, none).otherwise(covered)


def measured(docs: DataFrame) -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed."""
    text = F.coalesce(F.col("text"), F.lit(""))
    bare = F.translate(text, SPACE, "")
    lines = F.filter(F.split(text, "\n"), lambda x: F.translate(x, SPACE, "") != "")
    words = let(F.trim(text, F.lit(SPACE)), lambda t: F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, r"[\x20\x09-\x0D]+")))
    held = let(words, lambda w: F.struct(F.size(w).cast("long").alias("n"), _repeat_words(w).alias("r")))
    free = next(n for n in (f"_words{k}" for k in range(len(docs.columns) + 1)) if n not in docs.columns)
    out = docs.withColumn(free, held).withColumns({
        "n_words": F.col(free)["n"],
        "word_chars": F.length(bare).cast("long"),
        "n_symbols": (F.length(text) - F.length(F.translate(text, "#*$%&|<>", ""))).cast("long"),
        "n_dup_lines": let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
        "n_repeat_words": F.col(free)["r"],
    }).drop(free)
    return out.withColumn("base_failed", (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words")))


def _measures(events: bool) -> dict[str, Column]:
    """The measures; with events, less one event each."""
    n = F.nullif(F.col("n_words"), F.lit(0))
    share = {"symbols_per_word": F.col("n_symbols"), "dup_line_share": F.col("n_dup_lines") * 8, "repeat_share": F.col("n_repeat_words")}
    return {"mean_word": F.col("word_chars") / n} | {m: (c - (RULES[m][3] if events else 0)) / n for m, c in share.items()}


def _bounds(rules: dict) -> list[Column]:
    """low and high of each measure from its quantiles."""
    out = []
    for m, (below, above, reach, _) in rules.items():
        outer, middle = F.get(m, F.lit(0)), F.get(m, F.lit(1))
        if below is not None:
            out.append((middle - reach * (middle - outer)).alias(f"_{m}_low"))
        out.append((middle + reach * (F.get(m, F.lit(2)) - middle)).alias(f"_{m}_high"))
    return out


def thresholds(rows: DataFrame, rules: dict = RULES, least: int = LEAST_ROWS) -> DataFrame:
    """_lang, _source and the bounds of each measure; one row for each language and source."""
    sketches = [F.percentile_approx(c, [rules[m][0] or 0.5, 0.5, rules[m][1]], ACCURACY).alias(m) for m, c in _measures(False).items()]
    by = rows.where(~F.col("base_failed")).rollup("lang", "source").agg(F.count("*").alias("n"), F.grouping_id().alias("level"), *sketches)
    by = by.select("lang", "source", "level", F.struct("n", F.struct(*_bounds(rules)).alias("b")).alias("own"))
    # windows over sketches: a row for each group, language, and the corpus
    above = {k: F.max(F.when(F.col("level") == k, F.col("own"))).over(w) for k, w in ((1, Window.partitionBy("lang")), (3, Window.partitionBy(F.lit(1))))}
    by = by.withColumns({"of_lang": above[1], "of_all": above[3]}).where("level = 0")
    used = F.when(F.col("own.n") >= least, F.col("own.b")).when(F.col("of_lang.n") >= least, F.col("of_lang.b")).otherwise(F.col("of_all.b"))
    return by.select(F.col("lang").alias("_lang"), F.col("source").alias("_source"), used.alias("_bounds")).select("_lang", "_source", "_bounds.*")


def judged(rows: DataFrame, rules: dict = RULES, least: int = LEAST_ROWS) -> DataFrame:
    """measured() rows with kept. The join side has a row for each group; its size decides how it is joined."""
    rows = rows.drop("kept")
    bounds = thresholds(rows, rules, least).alias("_b")
    met = rows.alias("_r").join(bounds, F.col("_r.lang").eqNullSafe(F.col("_b._lang")) & F.col("_r.source").eqNullSafe(F.col("_b._source")), "left")
    n = F.nullif(F.col("_r.n_words"), F.lit(0))
    fits = F.lit(True)
    for m, c in _measures(True).items():
        if rules[m][0] is not None:
            fits = fits & (c >= F.col(f"_b._{m}_low"))
        fits = fits & (c <= F.col(f"_b._{m}_high"))
    return met.select("_r.*", (~F.col("base_failed") & n.isNotNull() & F.coalesce(fits, F.lit(False))).alias("kept"))


def keep_good(docs: DataFrame, rules: dict = RULES, least: int = LEAST_ROWS) -> DataFrame:
    """The rows of docs that the rules keep, with their columns as they came."""
    whole = docs.select(F.struct(*docs.columns).alias("whole"), "lang", "source", "text")
    return judged(measured(whole), rules, least).where("kept").select("whole.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op9: the measures of every document are written once, narrow; sketches and join read them."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "text")
    rows = stash(measured(docs).drop("text"), "quality")
    return judged(rows).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


#: Nearest-rank quantiles, which the sketches give exactly for groups as small as those of the oracle's tables.
SQL = r"""
WITH docs AS (SELECT *, row_number() OVER () AS rid, coalesce(text, '') AS t FROM documents),
worded AS (SELECT rid, doc_id, lang, source, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w FROM docs),
windows AS (SELECT rid, i, array_to_string(w[i:i + 7], ' ') AS x FROM (SELECT rid, w, unnest(range(1, len(w) - 6)) AS i FROM worded WHERE len(w) >= 8)),
twice AS (SELECT rid, x FROM windows GROUP BY rid, x HAVING count(*) > 1),
covered AS (SELECT rid, count(DISTINCT i + k) AS r FROM windows JOIN twice USING (rid, x), range(8) o(k) GROUP BY rid),
lines AS (SELECT rid, unnest(string_split(t, chr(10))) AS line FROM docs),
dups AS (SELECT rid, count(*) - count(DISTINCT line) AS d FROM lines WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY rid),
m AS (
  SELECT doc_id, lang, source, len(w)::BIGINT AS n_words,
    length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
    coalesce(d, 0)::BIGINT AS n_dup_lines, coalesce(r, 0)::BIGINT AS n_repeat_words
  FROM worded LEFT JOIN covered USING (rid) LEFT JOIN dups USING (rid)),
b AS (
  SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
    word_chars / nullif(n_words, 0)::DOUBLE AS m1, n_symbols / nullif(n_words, 0)::DOUBLE AS m2,
    n_dup_lines * 8.0::DOUBLE / nullif(n_words, 0) AS m3, n_repeat_words / nullif(n_words, 0)::DOUBLE AS m4
  FROM m),
q AS (
  SELECT lang, source, grouping(lang, source) AS level, count(*) AS n, ceil(0.1::DOUBLE * count(*))::INT AS p10, ceil(0.5::DOUBLE * count(*))::INT AS p50,
    ceil(0.9::DOUBLE * count(*))::INT AS p90, ceil(0.99::DOUBLE * count(*))::INT AS p99,
    list_sort(list(m1)) AS l1, list_sort(list(m2)) AS l2, list_sort(list(m3)) AS l3, list_sort(list(m4)) AS l4
  FROM b WHERE NOT base_failed GROUP BY ROLLUP (lang, source)),
t AS (
  SELECT lang, source, level, n, l1[p50] - 5.0::DOUBLE * (l1[p50] - l1[p10]) AS lo1, l1[p50] + 5.0::DOUBLE * (l1[p90] - l1[p50]) AS hi1,
    l2[p50] + 2.0::DOUBLE * (l2[p90] - l2[p50]) AS hi2, l3[p50] + 2.0::DOUBLE * (l3[p99] - l3[p50]) AS hi3, l4[p50] + 2.0::DOUBLE * (l4[p99] - l4[p50]) AS hi4
  FROM q),
u AS (
  SELECT g.lang, g.source, CASE WHEN g.n >= 100 THEN g.lo1 WHEN l.n >= 100 THEN l.lo1 ELSE a.lo1 END AS lo1, CASE WHEN g.n >= 100 THEN g.hi1 WHEN l.n >= 100 THEN l.hi1 ELSE a.hi1 END AS hi1, CASE WHEN g.n >= 100 THEN g.hi2 WHEN l.n >= 100 THEN l.hi2 ELSE a.hi2 END AS hi2, CASE WHEN g.n >= 100 THEN g.hi3 WHEN l.n >= 100 THEN l.hi3 ELSE a.hi3 END AS hi3, CASE WHEN g.n >= 100 THEN g.hi4 WHEN l.n >= 100 THEN l.hi4 ELSE a.hi4 END AS hi4
  FROM (FROM t WHERE level = 0) g JOIN (FROM t WHERE level = 1) l ON g.lang IS NOT DISTINCT FROM l.lang CROSS JOIN (FROM t WHERE level = 3) a)
SELECT b.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND coalesce(m1 >= lo1 AND m1 <= hi1 AND (n_symbols - 1) / n_words::DOUBLE <= hi2
    AND (n_dup_lines * 8 - 8) / n_words::DOUBLE <= hi3 AND (n_repeat_words - 16) / n_words::DOUBLE <= hi4, false) AS kept
FROM b LEFT JOIN u t ON b.lang IS NOT DISTINCT FROM t.lang AND b.source IS NOT DISTINCT FROM t.source
"""
