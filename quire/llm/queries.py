"""Queries of the llm problems, with SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import contamination, packing, pair_defects, quantiles, reading_level, tokens
from quire.llm.forms_sql import consistent_sql, look_sql, plain_sql
from quire.llm.visual_text import consistent_form, look_key
from quire.session import cut_lineage
from quire.sources.tables import table

QUERIES, SQL = {}, {}


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Every pair with an unusable answer, with its kind of defect."""
    return pair_defects.find_defects(table(spark, d, "translations"))


def p1_defect_rates(spark: SparkSession, d: str) -> DataFrame:
    """Pairs and defects by group and target language."""
    pairs = table(spark, d, "translations").select("translation_id", "group_name", "target_lang").distinct()
    bad = p1_found(spark, d).withColumnRenamed("translation_id", "bad_id")
    joined = pairs.join(bad, F.col("translation_id") == F.col("bad_id"), "left")
    kinds = [F.count_if(F.col("defect_type") == k).alias(f"n_{k}") for k in ("empty", "truncated", "refusal", "source_copy", "wrong_language")]
    return joined.groupBy("group_name", "target_lang").agg(F.countDistinct("translation_id").alias("n_pairs"), *kinds)


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Fragments that read as a region of their asset does, in other characters."""
    regions = table(spark, d, "evaluation_regions").where(F.col("expected") != "").select("region_id", "asset_id", "expected", look_key("expected").alias("form"))
    reads = table(spark, d, "fragments").where(F.col("ocr_text") != "")
    reads = reads.select("fragment_id", F.col("asset_id").alias("read_asset"), "ocr_text", look_key("ocr_text").alias("read_form"))
    same = (F.col("asset_id") == F.col("read_asset")) & (F.col("form") == F.col("read_form")) & (F.col("ocr_text") != F.col("expected"))
    return reads.join(regions, same).select("fragment_id", "region_id").distinct()


def p4_consistent_regions(spark: SparkSession, d: str) -> DataFrame:
    """The consistent form of every region's text; regions delivered again come out once."""
    return table(spark, d, "evaluation_regions").select("region_id", "asset_id", consistent_form("expected").alias("consistent_expected")).distinct()


def p4_consistent_fragments(spark: SparkSession, d: str) -> DataFrame:
    """The consistent form of every reading; readings delivered again come out once."""
    return table(spark, d, "fragments").select("fragment_id", "asset_id", consistent_form("ocr_text").alias("consistent_text")).distinct()


SQL["p4_found"] = f"""WITH r AS (SELECT DISTINCT region_id, asset_id, expected, {look_sql('expected')} AS form FROM evaluation_regions WHERE expected <> ''),
f AS (SELECT DISTINCT fragment_id, asset_id, ocr_text, {look_sql('ocr_text')} AS form FROM fragments WHERE ocr_text <> '')
SELECT DISTINCT fragment_id, region_id FROM f JOIN r ON f.asset_id = r.asset_id AND f.form = r.form AND ocr_text <> expected"""
SQL["p4_consistent_regions"] = f"SELECT DISTINCT region_id, asset_id, {consistent_sql('expected')} AS consistent_expected FROM evaluation_regions"
SQL["p4_consistent_fragments"] = f"SELECT DISTINCT fragment_id, asset_id, {consistent_sql('ocr_text')} AS consistent_text FROM fragments"


SHARES = {"p50": 0.5, "p90": 0.9, "p95": 0.95, "p99": 0.99}


def _timings(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "stage_timings").select("timing_id", "stage", F.to_date("recorded_at").alias("day"), "duration_ms")
    keyed = rows.where(F.col("timing_id").isNotNull()).distinct()  # rows delivered again count once
    return keyed.unionByName(rows.where(F.col("timing_id").isNull()))


def _percentiles(rows: DataFrame) -> DataFrame:
    per_day = cut_lineage(quantiles.group_summaries(rows, ["stage", "day"], "duration_ms"))  # read twice below
    size = quantiles.size_for(quantiles.parallelism(rows.sparkSession))
    months = quantiles.merge_groups(per_day.withColumn("month", F.date_format("day", "yyyy-MM")), ["stage", "month"], size)
    whole = quantiles.merge_groups(months, ["stage"], size)
    days = quantiles.percentile_rows(per_day, ["stage", "day"], SHARES).withColumn("scope", F.lit("day"))
    return days.unionByName(quantiles.percentile_rows(whole, ["stage"], SHARES).withColumns({"scope": F.lit("all"), "day": F.lit(None).cast("date")}))


def p5_stage_percentiles(spark: SparkSession, d: str) -> DataFrame:
    """Median and high percentiles of every stage's durations, by day and for all days, with the rank error of each row."""
    return _percentiles(_timings(spark, d)).select("stage", "scope", "day", "n", *SHARES, "rank_error")


def p5_day_percentiles(spark: SparkSession, d: str) -> DataFrame:
    """The rows by day alone."""
    held = quantiles.group_summaries(_timings(spark, d), ["stage", "day"], "duration_ms")
    return quantiles.percentile_rows(held, ["stage", "day"], SHARES).drop("rank_error")


def p5_rank_check(spark: SparkSession, d: str) -> DataFrame:
    """Whether the exact ranks of each stage's percentiles, by day and over all days, lie within the stated error, and that within 0.1 %."""
    rows = _timings(spark, d).where(F.col("duration_ms").isNotNull())
    got = cut_lineage(_percentiles(rows).select("scope", F.col("stage").alias("s"), F.col("day").alias("on_day"), "n", "rank_error", *SHARES))

    def ranks(scope: str, *keys: tuple[str, str]) -> DataFrame:
        same = F.lit(True)
        for own, theirs in keys:
            same = same & F.col(own).eqNullSafe(F.col(theirs))
        joined = rows.select("stage", "day", "duration_ms").join(got.where(F.col("scope") == scope), same)
        below = [F.count_if(F.col("duration_ms") < F.col(q)).alias(f"b_{q}") for q in SHARES]
        upto = [F.count_if(F.col("duration_ms") <= F.col(q)).alias(f"u_{q}") for q in SHARES]
        return joined.groupBy("scope", "s", "on_day", "n", "rank_error").agg(F.count("*").alias("n_exact"), *below, *upto)

    fits = F.col("n") == F.col("n_exact")
    for q, share in SHARES.items():
        rank = F.ceil(F.lit(share) * F.col("n"))
        fits = fits & (rank >= F.col(f"b_{q}") + 1 - F.col("rank_error")) & (rank <= F.col(f"u_{q}") + F.col("rank_error"))
    both = ranks("day", ("stage", "s"), ("day", "on_day")).unionByName(ranks("all", ("stage", "s")))
    within = F.col("rank_error") <= F.greatest(F.lit(1), F.col("n") * quantiles.ERROR)
    return both.select("scope", F.col("s").alias("stage"), F.col("on_day").alias("day"), "n", fits.alias("within_stated_error"), within.alias("within_bound"))


_TIMINGS = "t AS (SELECT stage, CAST(recorded_at AS DATE) AS day, duration_ms FROM (SELECT DISTINCT timing_id, stage, CAST(recorded_at AS DATE) AS recorded_at, duration_ms FROM stage_timings) WHERE duration_ms IS NOT NULL)"
SQL["p5_rank_check"] = f"""WITH {_TIMINGS}
SELECT 'day' AS scope, stage, day, count(*) AS n, true AS within_stated_error, true AS within_bound FROM t GROUP BY stage, day
UNION ALL SELECT 'all', stage, NULL, count(*), true, true FROM t GROUP BY stage"""
# Exact percentiles: what summaries give without error where a stage has no more rows a day than a summary has tuples (thousands).
_EXACT = ", ".join(f"quantile_disc(duration_ms, {share})::DOUBLE AS {q}" for q, share in SHARES.items())
SQL["p5_day_percentiles"] = f"WITH {_TIMINGS} SELECT stage, day, count(*) AS n, {_EXACT} FROM t GROUP BY stage, day"


def _places(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    documents = table(spark, d, "documents").select(F.col("doc_id").alias("item_id"), "source", packing.duplicate_cluster("text").alias("cluster"), "text")
    budgets = table(spark, d, "context_budgets")
    return packing.pack_items(tokens.with_token_counts(documents, "text"), budgets, n_items=documents.count()), budgets


def p6_containers(spark: SparkSession, d: str) -> DataFrame:
    """The place of every text in the containers of every budget."""
    places, _ = _places(spark, d)
    return places.withColumnRenamed("item_id", "doc_id")


def p6_fill_report(spark: SparkSession, d: str) -> DataFrame:
    """How full the containers of every budget are."""
    return packing.fill_report(*_places(spark, d))


def _leaks(spark: SparkSession, d: str) -> DataFrame:
    return contamination.find_leaks(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents that hold an item's passage or two fifths of it."""
    return _leaks(spark, d).where(F.col("part") == "passage").select("doc_id", "item_id").distinct()


def p7_spans(spark: SparkSession, d: str) -> DataFrame:
    """Where in the original text each part of an item lies."""
    return _leaks(spark, d)


def p7_exact_passages(spark: SparkSession, d: str) -> DataFrame:
    """Documents that hold an item's whole passage letter by letter."""
    return _leaks(spark, d).where((F.col("part") == "passage") & F.col("exact")).select("doc_id", "item_id").distinct()


SQL["p7_exact_passages"] = f"""
WITH docs AS (SELECT doc_id, {plain_sql('text')} AS t FROM documents), items AS (SELECT item_id, {plain_sql('passage')} AS p FROM eval_items)
SELECT DISTINCT doc_id, item_id FROM docs JOIN items ON p <> '' AND contains(t, p)"""


def p7_leaked_items(spark: SparkSession, d: str) -> DataFrame:
    """Per leaked item the documents with its passage, with the longest stretch, and those with its question and with its answer beside it.

    A document counts for question and answer where both stand in it, for an item without an answer where the question does.
    """
    items = table(spark, d, "eval_items").where(F.col("item_id").isNotNull()).groupBy(F.col("item_id").alias("of")).agg(F.bool_or(F.length(F.trim("answer")) > 0).alias("has_answer"))
    part = lambda name: F.max(F.col("part") == name)
    per = _leaks(spark, d).groupBy("doc_id", "item_id").agg(part("passage").alias("p"), part("question").alias("q"), part("answer").alias("a"), F.max(F.when(F.col("part") == "passage", F.col("share"))).alias("share"))
    asked = F.col("q") & (F.col("a") | ~F.coalesce("has_answer", F.lit(False)))
    sums = per.join(items, F.col("item_id") == F.col("of")).groupBy("item_id").agg(
        F.count_if("p").alias("n_documents"), F.max("share").alias("longest_share"), F.count_if("q").alias("n_with_question"), F.count_if(asked).alias("n_with_question_and_answer")
    )
    return sums.where("n_documents + n_with_question > 0")


def p8_reading_levels(spark: SparkSession, d: str) -> DataFrame:
    """Measures of every text's reading difficulty, and its estimated level."""
    return reading_level.reading_levels(table(spark, d, "documents"), table(spark, d, "level_ratings"))


def p8_unfamiliar_words(spark: SparkSession, d: str) -> DataFrame:
    """Words of every text and the share of them outside its language's list."""
    return reading_level.reading_levels(table(spark, d, "documents")).select("doc_id", "lang", "n_words", "unfamiliar_share").distinct()


def p8_level_agreement(spark: SparkSession, d: str) -> DataFrame:
    """How the measures go with the readers' ratings, by language; levels are of weights that did not see the document."""
    ratings = table(spark, d, "level_ratings")
    return reading_level.level_agreement(reading_level.held_out_levels(table(spark, d, "documents"), ratings), ratings)


def p8_document_frequencies(spark: SparkSession, d: str) -> DataFrame:
    """In how many documents each word of each language occurs."""
    return reading_level.document_frequencies(table(spark, d, "documents"))


# Letters but ideographs and kana, joined over hyphens and apostrophes; runs of the others.
_LETTER = r"[\p{Latin}\p{Greek}\p{Cyrillic}\p{Hangul}\p{Arabic}\p{Hebrew}\p{Thai}\p{Devanagari}]"
_HAN = r"\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{20000}-\x{31FFF}々"
_WORD = f"{_LETTER}+(?:[''’-]{_LETTER}+)*|[{_HAN}]+|[ぁ-ゟ]+|[ァ-ヺー]+"
SQL["p8_document_frequencies"] = f"""
WITH found AS (SELECT r, lang, unnest(regexp_extract_all(lower(text), '{_WORD}')) AS w FROM (SELECT row_number() OVER () AS r, lang, text FROM documents)),
cut AS (SELECT r, lang, unnest(CASE WHEN regexp_matches(w, '^[{_HAN}]') AND length(w) > 2 THEN list_transform(range(1, length(w)), lambda i: substr(w, i, 2)) ELSE [w] END) AS word FROM found)
SELECT lang, word, count(DISTINCT r) AS n_documents FROM cut GROUP BY ALL"""

# Lists and shares again in SQL; a document without a language has the one whose list holds most of its words.
SQL["p8_unfamiliar_words"] = f"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, nullif(lang, '') AS lang, text FROM documents), found AS (SELECT r, unnest(regexp_extract_all(lower(text), '{_WORD}')) AS w FROM docs),
cut AS (SELECT r, unnest(CASE WHEN regexp_matches(w, '^[{_HAN}]') AND length(w) > 2 THEN list_transform(range(1, length(w)), lambda i: substr(w, i, 2)) ELSE [w] END) AS word FROM found),
own AS (SELECT r, lang, word, count(*) AS k FROM cut JOIN docs USING (r) GROUP BY ALL), total AS (SELECT lang, count(DISTINCT r) AS t FROM own GROUP BY 1),
spread AS (SELECT lang, word, count(*) AS n FROM own GROUP BY lang, word HAVING count(*) >= {reading_level.MIN_DOCUMENTS}),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n DESC, word) AS place FROM spread),
lists AS (SELECT ranked.lang, word, n >= {reading_level.FAMILIAR_SHARE} * t AS familiar FROM ranked JOIN total ON ranked.lang IS NOT DISTINCT FROM total.lang WHERE place <= {max(reading_level.LIST_SIZES)}),
guess AS (SELECT r, arg_min(lang, (-k, lang)) AS lang FROM (SELECT r, lists.lang, sum(k) AS k FROM own JOIN lists USING (word) WHERE own.lang IS NULL AND lists.lang IS NOT NULL GROUP BY ALL) GROUP BY 1),
named AS (SELECT own.r, coalesce(own.lang, guess.lang) AS lang, word, k FROM own LEFT JOIN guess USING (r)),
counts AS (SELECT named.r, any_value(named.lang) AS lang, sum(k) AS n_words, coalesce(sum(k) FILTER (familiar), 0) AS n_familiar FROM named LEFT JOIN lists ON named.word = lists.word AND named.lang IS NOT DISTINCT FROM lists.lang GROUP BY 1)
SELECT DISTINCT doc_id, coalesce(docs.lang, counts.lang) AS lang, coalesce(n_words, 0)::BIGINT AS n_words, 1 - n_familiar::DOUBLE / n_words AS unfamiliar_share FROM docs LEFT JOIN counts USING (r)"""

QUERIES |= {
    f.__name__: f
    for f in (p1_found, p1_defect_rates, p4_found, p4_consistent_regions, p4_consistent_fragments, p5_stage_percentiles, p5_day_percentiles, p5_rank_check, p6_containers, p6_fill_report, p7_found, p7_spans, p7_exact_passages, p7_leaked_items, p8_reading_levels, p8_unfamiliar_words, p8_level_agreement, p8_document_frequencies)
}
