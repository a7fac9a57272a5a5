"""The shared test tables seen as the inputs of the operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from utterscope.sources.intermediate import spread

# Plain SQL that Spark and DuckDB both run on the tables of the same names. The SQL checks prefix
# their statements with these views, so both sides start from the same rows.
BATCH_SQL = """
  select report, row_id, expected, matched,
    case when lower(expected) = 'none'
              then case when coalesce(lower(matched), 'none') = 'none' then 'TN' else 'FP' end
         when coalesce(lower(matched), 'none') = 'none' then 'FN'
         when lower(expected) = lower(matched) then 'TP'
         else 'FP' end as result_type
  from (
    select concat('status-', o_orderstatus) as report, o_orderkey as row_id,
      case when o_orderkey % 97 = 0 then null
           when o_orderpriority like '4-%' then 'none'
           when o_orderkey % 2 = 0 then upper(o_orderpriority)
           else lower(o_orderpriority) end as expected,
      case when o_custkey % 10 = 8 then null
           when o_custkey % 10 = 7 or (o_custkey % 10 < 7 and o_orderpriority like '4-%') then 'none'
           when o_custkey % 10 < 7 then o_orderpriority
           else '1-URGENT' end as matched
    from orders) as batch0
"""

ENT_SQL = """
  select case when (event_id - event_id % 3) % 2 = 0 then 'even' else 'odd' end as report,
    concat('u', cast(event_id - event_id % 3 as varchar(20))) as utterance,
    case when event_id % 7 = 0 then null else event_type end as entity,
    case when event_id % 11 = 0 then null else value > 20 end as correct,
    case when event_id % 5 = 0 then null when event_id % 5 < 3 then 'ML Engine' else 'FM Engine' end as engine,
    case when event_id % 5 < 3 then 'NER'
         when user_id % 4 = 0 then 'Full Match - synonym'
         when user_id % 4 = 1 then 'Partial Match: x'
         when user_id % 4 = 2 then 'systemEntity'
         else null end as method
  from events
"""

CORPUS_SQL = """
  select doc_id, case when doc_id % 3 = 0 then 'test' else 'train' end as split,
    lang as label, text
  from documents
"""

EMB_SQL = """
  select vec_id as id, case when vec_id % 3 = 0 then 'test' else 'train' end as split,
    label, embedding as vec
  from embeddings
"""


# Columns of the tables in use; naming them saves a job that would read the file footers.
SCHEMAS = {
    "orders": "o_orderkey long, o_custkey long, o_orderstatus string, o_orderpriority string",
    "lineitem": "l_orderkey long, l_linenumber int, l_quantity double, l_discount double, l_tax double",
    "events": "event_id long, user_id long, event_type string, value double",
    "documents": "doc_id long, text string, lang string, source string",
    "embeddings": "vec_id long, embedding array<float>, label int",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")


def _view(spark: SparkSession, sf_dir: str, name: str, sql: str) -> DataFrame:
    return spark.sql(sql.replace(f"from {name}", f"from {{{name}}}"), **{name: table(spark, sf_dir, name)})


def batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intent results, one report per order status."""
    return _view(spark, sf_dir, "orders", BATCH_SQL)


def ent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entity results, two reports."""
    return _view(spark, sf_dir, "events", ENT_SQL)


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled corpus: the language is the label, the document number gives the split."""
    return spread(_view(spark, sf_dir, "documents", CORPUS_SQL))


def emb(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled embeddings in two splits."""
    return _view(spark, sf_dir, "embeddings", EMB_SQL)


REPORT_PATHS_SQL = """
  select concat('/reports/', replace(source, ' ', '-'), '-', lang, '_', cast(doc_id % 7 as varchar(20)),
    '_results.csv') as path
  from documents
"""


def report_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths of report files named after source and language of a document."""
    return _view(spark, sf_dir, "documents", REPORT_PATHS_SQL)
