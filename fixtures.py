"""Input states derived from the given tables, as SQL that Spark and DuckDB both run.

``{name}`` is a given table, ``{e1}`` .. ``{e4}`` the first components of its embedding.
"""

from __future__ import annotations

import sys

import numpy as np
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecatlas.functions.text import basic_tokens
from vecatlas.operators.ranking import row_index
from vecatlas.session import materialize, spread

cloudpickle.register_pickle_by_value(sys.modules[__name__])

TABLES = ("documents", "embeddings", "pages", "benchmark", "conversations", "events")

# A gallery of images: one slot per vector; slots with a low fourth component are tombstones.
GALLERY = """
select vec_id as slot,
       case when {e4} >= -0.15 then
         concat('/gallery/d', cast(label as string), '/img_', cast(vec_id as string), '.png') end as path,
       cast(floor(abs(cast({e1} as double)) * 10000000) as bigint) as size,
       {e4} >= -0.15 as live, embedding
from {embeddings}
"""
# What a scan of the gallery finds now: some files are gone.
GALLERY_LISTING = """
select concat('/gallery/d', cast(label as string), '/img_', cast(vec_id as string), '.png') as path,
       cast(floor(abs(cast({e1} as double)) * 10000000) as bigint) as size,
       cast('2024-01-01 00:00:00' as timestamp) + interval '1' second * vec_id as modified
from {embeddings} where {e3} > -0.1
"""
GALLERY_REMOVED = """
select concat('/gallery/d', cast(label as string)) as root
from {embeddings} group by label having avg(cast({e1} as double)) < 0
"""
# A change feed over image files, its state in the middle of the month (the catalog) and at the end
# (what a listing finds).
FEED = """
select event_id as seq,
       concat('/lib/u', cast(user_id as string), '/', regexp_extract(props, '[0-9]+', 0), '.png') as path,
       case when event_type = 'error' then 'delete' else 'put' end as op,
       cast(floor(value * 100) as bigint) as size, ts
from {events}
"""
OLD_STATE = f"""
select path, max_by(op, seq) = 'put' as live, max_by(size, seq) as size
from ({FEED}) feed where ts < cast('2024-01-16 00:00:00' as timestamp) group by path
"""
LISTING = f"""
select path, size from (
  select path, max_by(op, seq) as op, max_by(size, seq) as size from ({FEED}) feed group by path
) latest where op = 'put'
"""
# Users whose last event is an error lose their directory.
REMOVED_ROOTS = """
select concat('/lib/u', cast(user_id as string)) as root
from {events} group by user_id having max_by(event_type, event_id) = 'error'
"""
USER_ROOTS = "select distinct concat('/lib/u', cast(user_id as string)) as root from {events}"
# Directories of the page tree: hosts are registered, each page asks for its section.
HOST_ROOTS = """
select distinct concat('/', replace(regexp_extract(url, '^[a-z]+://[^/]+', 0), '://', '/')) as root
from {pages} where url like 'https:%'
"""
PAGE_ROOTS = """
select page_id * 3 as ordinal, concat('/', replace(regexp_extract(url, '^[a-z]+://[^/]+/[a-z]+', 0), '://', '/')) as root
from {pages}
union all
select page_id * 3 + 1 as ordinal, concat('/', replace(regexp_extract(url, '^[a-z]+://[^/]+', 0), '://', '/')) as root
from {pages}
union all
select page_id * 3 + 2 as ordinal, concat('/', regexp_extract(url, '^[a-z]+', 0)) as root from {pages}
"""
LOG_LINES = """
select event_id, case when event_type = 'signup' then concat('bad line ', props)
  else concat(substr(cast(ts as string), 1, 10), ' 00:00:00,000 -  ', event_type) end as line
from {events}
"""
# Keyword queries out of whole benchmark passages, with each kind of separator.
KEYWORDS = """
select item_id as query_id,
       case when length(text) > 200 then replace(text, ' ', ',')
            when length(text) > 120 then replace(text, ' ', '|') else text end as text
from {benchmark}
"""
EXPORTED = """
select doc_id as ordinal,
       concat('/', lang, '/', cast(doc_id as string), '/', source, '.txt') as src_path
from {documents}
"""
# Names that the export directory holds already.
EXPORT_TAKEN = "select distinct concat(source, '.txt') as name from {documents} where lang = 'fr'"
# Files of every kind, some of them images.
MIXED_FILES = """
select doc_id, concat('/', source, '/', cast(doc_id as string),
         case lang when 'en' then '.PNG' when 'fr' then '.txt' when 'de' then '.jpeg' else '/png' end) as path
from {documents}
"""
# An inventory of the files: two versions of some, of which the later may be a delete.
INVENTORY = f"""
select m.path, cast(length(d.text) as bigint) as size, cast('2024-01-01 00:00:00' as timestamp) as modified
from ({MIXED_FILES.strip()}) m join {{documents}} d on m.doc_id = d.doc_id
union all
select m.path, case when d.doc_id % 6 = 0 then null else cast(d.n_chars + 1 as bigint) end as size,
       cast('2024-01-02 00:00:00' as timestamp) as modified
from ({MIXED_FILES.strip()}) m join {{documents}} d on m.doc_id = d.doc_id where d.doc_id % 3 = 0
"""
INVENTORY_ROOTS = "select concat('/', source) as root from {documents} group by source having count(*) % 2 = 0"


def duckdb_sql(sql: str) -> str:
    names = {t: t for t in TABLES}
    return "(" + sql.format(**names, **{f"e{i}": f"embedding[{i}]" for i in range(1, 5)}).strip() + ")"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def derived(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    tables = {t: table(spark, sf_dir, t) for t in TABLES if f"{{{t}}}" in sql}
    for i in range(1, 5):
        sql = sql.replace(f"{{e{i}}}", f"element_at(embedding, {i})")
    return spark.sql(sql, **tables)


def gallery(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived(spark, sf_dir, GALLERY)


def gallery_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gallery(spark, sf_dir).filter("live").select("slot", "path", "size", "embedding")


def vector_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("query_id"), "embedding")


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    state, _ = row_index(derived(spark, sf_dir, OLD_STATE), ["path"], "slot")
    return state.select("slot", F.when(F.col("live"), F.col("path")).alias("path"), "size", "live")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text"))


def vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Special tokens, then every character, its continuation form and every word of the benchmark."""
    words = materialize(
        table(spark, sf_dir, "benchmark").select(F.explode(basic_tokens(F.col("text"))).alias("token")).distinct(),
        "words",
    )
    chars = words.select(F.explode(F.split("token", "")).alias("token")).filter("token <> ''").distinct()
    tokens = words.unionByName(chars).distinct().unionByName(
        chars.select(F.concat(F.lit("##"), "token").alias("token"))
    )
    numbered, _ = row_index(tokens, ["token"], "id")
    special = spark.createDataFrame(
        [("[PAD]", 0), ("[UNK]", 1), ("[CLS]", 2), ("[SEP]", 3)], "token string, id long"
    )
    return materialize(special.unionByName(numbered.select("token", (F.col("id") + 4).alias("id"))), "vocabulary")


# A picture of 4 x 4 BGRA pixels out of each 64-component embedding.
PIXEL = "cast(floor(abs(cast(x as double)) * 100000) as bigint) % 256"


def pictures(spark: SparkSession, sf_dir: str) -> DataFrame:
    data = (
        f"unhex(array_join(transform(embedding, x -> lpad(hex({PIXEL}), 2, '0')), ''))"
    )
    valid = "element_at(embedding, 4) >= -0.15"
    return table(spark, sf_dir, "embeddings").select(
        "vec_id",
        F.expr(
            "named_struct('origin', concat('/gallery/', vec_id, '.png'), "
            f"'height', if({valid}, 4, -1), 'width', if({valid}, 4, -1), "
            f"'nChannels', if({valid}, 4, -1), 'mode', if({valid}, 24, -1), "
            f"'data', if({valid}, {data}, cast('' as binary)))"
        ).alias("image"),
    )


class PlaneMeans:
    """A stand-in for an image model: mean and deviation of each colour plane."""

    def __call__(self):
        def run(batch):
            planes = batch.reshape(len(batch), 3, -1)
            return np.concatenate([planes.mean(axis=2), planes.std(axis=2)], axis=1).astype(np.float32)

        return run
