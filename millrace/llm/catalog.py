"""Queries p3_ and p6_ to p8_ over the supplied tables. What SQL can't give has a query beside it that says how far the result holds, and that has SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.language import document_languages, identify
from millrace.llm.leakage import find_leaks
from millrace.llm.packing import assign
from millrace.llm.quantiles import combine, read_quantiles, summarize
from millrace.operators.durable import durable
from millrace.operators.joins import small_side
from millrace.sources.tables import table

PROBS = [0.05, 0.25, 0.5, 0.75, 0.95, 0.99]
RANK_ERROR = 0.01


def _payments(spark: SparkSession, d: str) -> DataFrame:
    """Each payment_id once, with the region of its invoice and its day."""
    paid = table(spark, d, "payment").where("payment_id is not null and gross_amount is not null and invoice_id is not null")
    once = paid.groupBy("payment_id").agg(F.min(F.struct("invoice_id", F.col("gross_amount").alias("amount"), "paid_at")).alias("p")).select("p.*")
    regions = table(spark, d, "invoice").where("id is not null and region is not null").groupBy(F.col("id").alias("invoice_id")).agg(F.min("region").alias("region"))
    return once.join(regions, "invoice_id").select(F.lit("gross_amount").alias("field"), F.col("region").alias("group_value"), F.col("amount").cast("double").alias("v"), F.date_trunc("day", "paid_at").cast("string").alias("day"))


def _throughput(spark: SparkSession, d: str) -> DataFrame:
    # what doesn't count goes before an id's rows become one, so that an id keeps its finite row
    runs = table(spark, d, "benchmark_result").where("result_id is not null and library is not null and abs(throughput_per_sec) < double('infinity')")
    once = runs.groupBy("result_id").agg(F.min(F.struct("library", "throughput_per_sec", "run_at")).alias("r")).select("r.*")
    return once.select(F.lit("throughput_per_sec").alias("field"), F.col("library").alias("group_value"), F.col("throughput_per_sec").alias("v"), F.date_trunc("day", "run_at").cast("string").alias("day"))


def _values(spark: SparkSession, d: str) -> DataFrame:
    return _payments(spark, d).unionByName(_throughput(spark, d))


def p3_daily(spark: SparkSession, d: str) -> DataFrame:
    """The summaries of each day, group and field, as a pipeline stores them to combine them later. A row without a day goes to a day of its own."""
    return summarize(_values(spark, d).fillna({"day": ""}), ["field", "group_value", "day"], "v", RANK_ERROR)


def p3_percentiles(spark: SparkSession, d: str) -> DataFrame:
    """Percentiles of gross_amount per region and of throughput_per_sec per library, with their proven rank error."""
    return read_quantiles(summarize(_values(spark, d), ["field", "group_value"], "v", RANK_ERROR), ["field", "group_value"], PROBS)


def p3_combined_days(spark: SparkSession, d: str) -> DataFrame:
    """The same from the summaries of each day, combined."""
    return read_quantiles(combine(p3_daily(spark, d), ["field", "group_value"], RANK_ERROR), ["field", "group_value"], PROBS)


def p3_outside(spark: SparkSession, d: str) -> DataFrame:
    """Per group the values that count, and the percentiles of ``p3_combined_days`` whose true rank lies outside the bound given with them: none may."""
    told = small_side(p3_combined_days(spark, d).select("field", "group_value", "prob", F.col("value").alias("told"), "n_values", "off_ranks", "rank_error"))
    values = _values(spark, d).where("v is not null and not isnan(v) and abs(v) < double('infinity') and group_value is not null")
    ranks = values.join(told, ["field", "group_value"]).groupBy("field", "group_value", "prob").agg(
        F.count_if(F.col("v") < F.col("told")).alias("below"), F.count_if(F.col("v") <= F.col("told")).alias("upto"), F.count(F.lit(1)).alias("n"), *(F.first(c).alias(c) for c in ("n_values", "off_ranks", "rank_error"))
    )
    sought = F.greatest(F.lit(1), F.ceil(F.col("prob") * F.col("n")))
    off = F.greatest(F.lit(0), F.col("below") + 1 - sought, sought - F.col("upto"))
    bad = (off > F.col("off_ranks")) | (F.col("rank_error") > RANK_ERROR) | (F.col("off_ranks") > RANK_ERROR * F.col("n") + 1) | (F.col("n") != F.col("n_values"))
    return ranks.groupBy("field", "group_value").agg(F.max("n").alias("n_values"), F.count(F.lit(1)).alias("n_percentiles"), F.count_if(bad).alias("n_outside"))


def p6_assignment(spark: SparkSession, d: str) -> DataFrame:
    """Every document's containers for each capacity."""
    return assign(table(spark, d, "documents").select("doc_id", "text"), table(spark, d, "pack_spec"))


def p6_waste(spark: SparkSession, d: str) -> DataFrame:
    """Per capacity: containers, tokens, the containers that the sum of tokens needs at least, and the share of unused space."""
    placed = p6_assignment(spark, d)
    totals = placed.groupBy("spec_id", "container_id").agg(F.sum("n_tokens").alias("n")).groupBy("spec_id").agg(F.count(F.lit(1)).alias("n_containers"), F.sum("n").alias("n_tokens"))
    return totals.join(table(spark, d, "pack_spec"), "spec_id").select(
        "spec_id", "capacity", "n_containers", "n_tokens", F.ceil(F.col("n_tokens") / F.col("capacity")).alias("n_least"), (1 - F.col("n_tokens") / (F.col("n_containers") * F.col("capacity"))).alias("unused")
    )


def p6_broken(spark: SparkSession, d: str) -> DataFrame:
    """Per capacity the documents assigned, containers over the capacity, texts split though they fit or into more pieces than they need, and texts of another length than for another capacity: none must be."""
    placed = durable(p6_assignment(spark, d).join(F.broadcast(table(spark, d, "pack_spec")), "spec_id"))
    over = placed.groupBy("spec_id", "container_id", "capacity").agg(F.sum("n_tokens").alias("n")).groupBy("spec_id").agg(F.count_if(F.col("n") > F.col("capacity")).alias("n_overfull"))
    texts = placed.groupBy("spec_id", "capacity", "doc_id").agg(F.sum("n_tokens").alias("n"), F.count(F.lit(1)).alias("pieces"))
    lengths = texts.groupBy("doc_id").agg((F.min("n") != F.max("n")).alias("differs"))
    needed = F.greatest(F.lit(1), F.ceil(F.col("n") / F.col("capacity")))
    split = texts.join(lengths, "doc_id").groupBy("spec_id").agg(F.count(F.lit(1)).alias("n_documents"), F.count_if(F.col("pieces") != needed).alias("n_wrongly_split"), F.count_if("differs").alias("n_differing"))
    return split.join(over, "spec_id").select("spec_id", "n_documents", "n_overfull", "n_wrongly_split", "n_differing")


def _leaks(spark: SparkSession, d: str) -> DataFrame:
    return find_leaks(table(spark, d, "documents").select("doc_id", "text"), table(spark, d, "eval_item").select("item_id", "text"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents and the test items that leaked into them."""
    return _leaks(spark, d).select("doc_id", "item_id")


def _spoken(text):
    """A text in lower case with its words one space apart, without the lines of numbers and times of subtitle files."""
    flat = F.regexp_replace(F.translate(F.lower(text), "\r\u2028\u2029\u0085", "\n\n\n\n"), r"(?m)^[0-9:.,> \t-]*$", " ")
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(flat, r"[^a-zà-ÿа-яёąćęłńóśźżœ0-9]+", " ")), F.lit(" "))


def p7_verbatim(spark: SparkSession, d: str) -> DataFrame:
    """The documents and items found of which the document holds the item's text whole and word by word. SQL finds them by looking for each item in each document."""
    docs = table(spark, d, "documents").select("doc_id", _spoken(F.col("text")).alias("doc_text"))
    items = table(spark, d, "eval_item").select("item_id", _spoken(F.col("text")).alias("item_text"))
    return p7_found(spark, d).join(docs, "doc_id").join(small_side(items), "item_id").where(F.contains("doc_text", "item_text")).select("doc_id", "item_id")


def p7_items(spark: SparkSession, d: str) -> DataFrame:
    """Per leaked test item: the documents that hold it and the widest share of it found."""
    return _leaks(spark, d).groupBy("item_id").agg(F.count(F.lit(1)).alias("n_documents"), F.max(F.col("stretch") / F.col("item_words")).alias("widest_share"))


def _segments(spark: SparkSession, d: str) -> DataFrame:
    return identify(table(spark, d, "documents").select("doc_id", "text", "lang", "source"), table(spark, d, "lang_sample"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    """All segments of documents whose label is missing or wrong, and of those with several segments."""
    return _segments(spark, d).where("seg_no > 0 and (not label_fits or n_segments > 1)").select("doc_id", "seg_no", "lang")


def p8_segments(spark: SparkSession, d: str) -> DataFrame:
    """Every segment with its language and confidence; segment 0 stands for a document without one."""
    return _segments(spark, d)


def p8_documents(spark: SparkSession, d: str) -> DataFrame:
    """Every document with text: the language of most of its cues, its confidence, and its number of segments."""
    return document_languages(_segments(spark, d))


def p8_untold(spark: SparkSession, d: str) -> DataFrame:
    """The documents with text, those of them that have no language, and those whose confidence is no probability: none must be."""
    told = document_languages(_segments(spark, d)).withColumn("told", F.lit(1))
    texts = table(spark, d, "documents").where("doc_id is not null and text is not null and text != ''").select("doc_id").distinct()
    bad = F.col("told").isNotNull() & ~F.coalesce(F.col("confidence").between(0, 1.000001), F.lit(False))
    return texts.join(told, "doc_id", "left").agg(F.count(F.lit(1)).alias("n_documents"), F.count_if(F.col("lang").isNull()).alias("n_untold"), F.count_if(bad).alias("n_bad"))


QUERIES = {f.__name__: f for f in (p3_daily, p3_percentiles, p3_combined_days, p3_outside, p6_assignment, p6_waste, p6_broken, p7_found, p7_items, p7_verbatim, p8_found, p8_segments, p8_documents, p8_untold)}
ORACLE: dict[str, str] = {
    "p3_outside": """WITH p AS (SELECT payment_id, min(invoice_id) AS invoice_id FROM payment WHERE payment_id IS NOT NULL AND gross_amount IS NOT NULL AND invoice_id IS NOT NULL GROUP BY payment_id),
i AS (SELECT id, min(region) AS region FROM invoice WHERE id IS NOT NULL AND region IS NOT NULL GROUP BY id),
b AS (SELECT result_id, min(library) AS library FROM benchmark_result WHERE result_id IS NOT NULL AND library IS NOT NULL AND throughput_per_sec IS NOT NULL AND isfinite(throughput_per_sec) GROUP BY result_id)
SELECT 'gross_amount' AS field, region AS group_value, count(*) AS n_values, 6::BIGINT AS n_percentiles, 0::BIGINT AS n_outside FROM p JOIN i ON invoice_id = id GROUP BY region
UNION ALL SELECT 'throughput_per_sec', library, count(*), 6, 0 FROM b GROUP BY library""",
    "p6_broken": """SELECT spec_id, count(DISTINCT doc_id) AS n_documents, 0::BIGINT AS n_overfull, 0::BIGINT AS n_wrongly_split, 0::BIGINT AS n_differing
FROM pack_spec, documents WHERE doc_id IS NOT NULL AND capacity > 0 GROUP BY spec_id""",
    "p7_verbatim": r"""WITH d AS (SELECT doc_id, regexp_replace(translate(lower(text), chr(13) || chr(8232) || chr(8233) || chr(133), chr(10) || chr(10) || chr(10) || chr(10)), '(?m)^[0-9:.,> \t-]*$', ' ', 'g') AS t FROM documents),
i AS (SELECT item_id, regexp_replace(translate(lower(text), chr(13) || chr(8232) || chr(8233) || chr(133), chr(10) || chr(10) || chr(10) || chr(10)), '(?m)^[0-9:.,> \t-]*$', ' ', 'g') AS t FROM eval_item),
dd AS (SELECT doc_id, ' ' || trim(regexp_replace(t, '[^a-zà-ÿа-яёąćęłńóśźżœ0-9]+', ' ', 'g')) || ' ' AS t FROM d),
ii AS (SELECT item_id, ' ' || trim(regexp_replace(t, '[^a-zà-ÿа-яёąćęłńóśźżœ0-9]+', ' ', 'g')) || ' ' AS t FROM i)
SELECT DISTINCT doc_id, item_id FROM dd, ii WHERE contains(dd.t, ii.t)""",
    "p8_untold": "SELECT count(DISTINCT doc_id) AS n_documents, 0::BIGINT AS n_untold, 0::BIGINT AS n_bad FROM documents WHERE doc_id IS NOT NULL AND text <> ''",
}
