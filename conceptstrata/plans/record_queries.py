"""Queries over records, keys, tables and samples."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from conceptstrata.functions.keys import hash60, md5_shard
from conceptstrata.operators import encode, records, sampling
from conceptstrata.operators.lookup import rows_with_keys
from conceptstrata.operators.ranking import latest_by_key
from conceptstrata.plans import adapters
from conceptstrata.plans.registry import ENCODED, HASH, PAPERS, VECTORS, WORDS, hashed, query
from conceptstrata.session import new_path
from conceptstrata.sources import csv_files, json_lines, tables
from conceptstrata.streaming import feeds

_EXPECTED_CLEAN = f"""
WITH {PAPERS}
SELECT arxiv_id,
  CASE WHEN doc_id % 11 = 5 THEN '' ELSE trim(title, chr(32)||chr(9)||chr(10)||chr(13)) END AS title,
  md5(CASE WHEN doc_id % 13 = 6 THEN '' ELSE trim(abstract, chr(32)||chr(9)||chr(10)||chr(13)) END) AS abstract_md5,
  CASE WHEN doc_id % 17 = 8 THEN '' ELSE primary_category END AS primary_category,
  CASE WHEN doc_id % 19 = 4 OR doc_id % 7 = 3 THEN NULL ELSE published_date END AS published_date,
  CASE WHEN doc_id % 5 IN (2, 3) THEN NULL ELSE published_date END AS last_updated_date,
  lang AS license, 'pending' AS processed_status
FROM papers
"""


def _clean_view(cleaned: DataFrame) -> DataFrame:
    return cleaned.select(
        "arxiv_id",
        "title",
        F.md5("abstract").alias("abstract_md5"),
        "primary_category",
        "published_date",
        "last_updated_date",
        "license",
        "processed_status",
    )


@query("clean_records", _EXPECTED_CLEAN)
def clean_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _clean_view(records.clean_records(adapters.records(spark, sf_dir)))


def _written_records(spark: SparkSession, sf_dir: str) -> str:
    path = new_path(spark, "records")
    adapters.records(spark, sf_dir).write.json(path)
    return path


@query("ingest_json_lines", _EXPECTED_CLEAN)
def ingest_json_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _written_records(spark, sf_dir)
    return _clean_view(records.clean_records(json_lines.read_records(spark, path)))


@query("json_row_count", "SELECT count(*) AS n FROM documents")
def json_row_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return json_lines.read_records(spark, _written_records(spark, sf_dir)).agg(F.count("*").alias("n"))


@query("json_mixed_records", """
SELECT CAST(doc_id AS VARCHAR) AS id, CASE WHEN doc_id % 3 = 0 THEN lang END AS title, 'record' AS kind
FROM documents WHERE doc_id % 3 < 2
UNION ALL
SELECT NULL, 'junk ' || doc_id, 'malformed' FROM documents WHERE doc_id % 3 = 2
""")
def json_mixed_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Good lines, lines whose title is an object and lines that are no JSON, read back."""
    docs = adapters.table(spark, sf_dir, "documents")
    key = F.to_json(F.struct(F.col("doc_id").cast("string").alias("id"), F.col("lang").alias("title")))
    odd = F.to_json(F.struct(F.col("doc_id").cast("string").alias("id"), F.struct("lang").alias("versions")))
    line = F.when(F.col("doc_id") % 3 == 0, key).when(F.col("doc_id") % 3 == 1, odd)
    path = new_path(spark, "mixed")
    docs.select(F.coalesce(line, F.concat(F.lit("junk "), F.col("doc_id").cast("string"))).alias("value")).write.text(path)
    read = json_lines.read_records(spark, path).select("id", "title", F.lit("record").alias("kind"))
    junk = json_lines.malformed_lines(spark, path).where(~F.col("value").startswith("{"))
    return read.unionByName(junk.select(F.lit(None).cast("string").alias("id"), F.col("value").alias("title"), F.lit("malformed").alias("kind")))


@query("json_lines_left_out", """
SELECT CAST(doc_id AS VARCHAR) AS value, 'record' AS kind FROM documents WHERE doc_id % 3 = 0
UNION ALL
SELECT '{"title":"' || lang || '"}', 'left out' FROM documents WHERE doc_id % 3 = 1
UNION ALL
SELECT 'junk ' || doc_id, 'left out' FROM documents WHERE doc_id % 3 = 2
""")
def json_lines_left_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records, records without an id and lines that are no JSON: each is read or handed on as text."""
    docs = adapters.table(spark, sf_dir, "documents")
    key = F.col("doc_id").cast("string")
    whole = F.to_json(F.struct(key.alias("id"), F.col("lang").alias("title")))
    line = F.when(F.col("doc_id") % 3 == 0, whole).when(F.col("doc_id") % 3 == 1, F.to_json(F.struct(F.col("lang").alias("title"))))
    path = new_path(spark, "lines")
    docs.select(F.coalesce(line, F.concat(F.lit("junk "), key)).alias("value")).write.text(path)
    read = json_lines.read_records(spark, path).select(F.col("id").alias("value"), F.lit("record").alias("kind"))
    return read.unionByName(json_lines.malformed_lines(spark, path).select("value", F.lit("left out").alias("kind")))


@query("strict_records", f"""
WITH {PAPERS}
SELECT arxiv_id, md5(trim(regexp_replace(abstract, '\\s+', ' ', 'g'))) AS abstract_md5, published_date
FROM papers
WHERE doc_id % 13 <> 6 AND doc_id % 19 <> 4 AND doc_id % 7 <> 3
  AND trim(regexp_replace(abstract, '\\s+', ' ', 'g')) <> ''
""")
def strict_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = records.clean_records(adapters.records(spark, sf_dir), strict=True)
    return cleaned.select("arxiv_id", F.md5("abstract").alias("abstract_md5"), "published_date")


@query("rejected_rows", """
SELECT 'no publication date' AS reason, count(*) AS n FROM documents
WHERE doc_id % 19 = 4 OR doc_id % 7 = 3 GROUP BY 1
""")
def rejected_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = records.clean_records(adapters.records(spark, sf_dir))
    return records.rejected(cleaned).groupBy("reason").agg(F.count("*").alias("n"))


@query("systematic_sample", """
SELECT doc_id, pos AS line_no
FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS pos FROM documents)
WHERE pos % (SELECT greatest(1, (count(*) + 89) // 90) FROM documents) = 0
  AND pos < 90 * (SELECT greatest(1, (count(*) + 89) // 90) FROM documents)
""")
def systematic_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = json_lines.numbered_rows(spark, f"{sf_dir}/documents.parquet")
    return json_lines.systematic(rows, limit=90).select("doc_id", "line_no")


@query("systematic_lines", """
SELECT CAST(doc_id AS VARCHAR) AS id, pos AS line_no
FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS pos FROM documents)
WHERE pos % (SELECT greatest(1, (count(*) + 89) // 90) FROM documents) = 0
  AND pos < 90 * (SELECT greatest(1, (count(*) + 89) // 90) FROM documents)
""")
def systematic_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "lines")
    adapters.records(spark, sf_dir).repartitionByRange(F.col("id").cast("bigint")).sortWithinPartitions(
        F.col("id").cast("bigint")
    ).write.json(path)
    return json_lines.sampled_records(spark, path, limit=90).select("id", "line_no")


@query("hash_ids", f"""
WITH {PAPERS}
SELECT arxiv_id, {HASH.format(text='arxiv_id')} AS paper_id, CAST(year(published_date) AS INTEGER) AS publication_year,
  {HASH.format(text="CAST(year(published_date) AS VARCHAR) || '_' || primary_category")} AS partition_key
FROM papers
""")
def hash_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    keyed = records.with_vector_keys(records.storable(adapters.papers(spark, sf_dir)))
    return keyed.select("arxiv_id", "paper_id", "publication_year", "partition_key")


@query("author_links", f"""
WITH links AS (
  SELECT CAST(doc_id AS VARCHAR) AS paper_id, lang || ' ' || source AS name FROM documents
  UNION ALL SELECT CAST(doc_id AS VARCHAR), source FROM documents)
SELECT paper_id, name, {HASH.format(text='name')} AS author_id FROM links
""")
def author_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.author_links(adapters.records(spark, sf_dir)).select("paper_id", "name", "author_id")


@query("authors", f"""
WITH links AS (
  SELECT lang || ' ' || source AS name, source || ', ' || lang AS original_string FROM documents
  UNION ALL SELECT source, source FROM documents)
SELECT DISTINCT {HASH.format(text='name')} AS author_id, name, original_string FROM links
""")
def authors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.authors(adapters.records(spark, sf_dir))


@query("shard_counts", f"""
SELECT CAST({HASH.format(text='CAST(doc_id AS VARCHAR)')} % 5 AS INTEGER) AS shard, count(*) AS n
FROM documents GROUP BY 1
""")
def shard_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    waiting = records.pending(adapters.papers(spark, sf_dir))
    return waiting.groupBy(md5_shard(F.col("arxiv_id"), 5).alias("shard")).agg(F.count("*").alias("n"))


@query("pending_shards", "SELECT count(*) AS n, count(*) AS n_distinct FROM documents")
def pending_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shards together hold every pending paper exactly once."""
    papers = adapters.papers(spark, sf_dir).select("arxiv_id", "processed_status")
    shards = [records.pending(papers, 5, shard) for shard in range(5)]
    together = shards[0]
    for shard in shards[1:]:
        together = together.unionByName(shard)
    return together.agg(F.count("*").alias("n"), F.countDistinct("arxiv_id").alias("n_distinct"))


@query("pending_count", """
SELECT count(*) AS n FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)
""")
def pending_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Papers still to encode once the labelled ones are embedded."""
    done = adapters.table(spark, sf_dir, "labels").select(
        F.col("doc_id").cast("string").alias("arxiv_id"), F.lit("embedded").alias("status")
    )
    papers = adapters.papers(spark, sf_dir).select("arxiv_id", "processed_status").join(done, "arxiv_id", "left")
    current = papers.withColumn("processed_status", F.coalesce("status", "processed_status"))
    return records.pending(current).agg(F.count("*").alias("n"))


@query("latest_by_key", """
SELECT user_id, event_id, event_type, round(value, 6) AS value
FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events)
WHERE r = 1
""")
def latest_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = adapters.table(spark, sf_dir, "events")
    latest = latest_by_key(events, "user_id", [F.desc("ts"), F.desc("event_id")])
    return latest.select("user_id", "event_id", "event_type", F.round("value", 6).alias("value"))


# Rows of a bucket, which one task writes and reads: some 80 MB of papers
BUCKET_ROWS = 20_000


def _buckets(rows: DataFrame, least: int) -> int:
    """Buckets for a table of so many rows, so that a bucket stays as large as it is whatever the table."""
    return max(least, -(-rows.count() // BUCKET_ROWS))


def _new_table(name: str) -> str:
    return f"{name}_{uuid.uuid4().hex}"


@query("upsert_papers", f"""
WITH {PAPERS}
SELECT p.arxiv_id, CASE WHEN l.doc_id IS NULL THEN p.title ELSE 'revised' END AS title, p.primary_category,
  CASE WHEN l.doc_id IS NULL THEN 'pending' ELSE 'embedded' END AS processed_status
FROM papers p LEFT JOIN labels l USING (doc_id)
""")
def upsert_papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Load all papers, then replace the labelled ones."""
    name = _new_table("papers")
    tables.create_papers(spark, name, new_path(spark, "papers"), buckets=8)
    papers = adapters.papers(spark, sf_dir)
    tables.upsert(name, tables.with_bucket(papers, name), "arxiv_id")
    labelled = adapters.table(spark, sf_dir, "labels").select(F.col("doc_id").cast("string").alias("arxiv_id"))
    revised = records.with_ids(papers, labelled).withColumns(
        {"title": F.lit("revised"), "processed_status": F.lit("embedded")}
    )
    tables.upsert(name, tables.with_bucket(revised, name), "arxiv_id")
    return tables.read(spark, name).select("arxiv_id", "title", "primary_category", "processed_status")


@query("upsert_moved_vectors", f"""
WITH {VECTORS}
SELECT {HASH.format(text='v.arxiv_id')} AS paper_id, v.arxiv_id,
  CAST(CASE WHEN l.doc_id IS NULL THEN v.year ELSE 2030 END AS INTEGER) AS publication_year, len(v.v) AS dims
FROM vectors v LEFT JOIN labels l ON l.doc_id = v.vec_id
""")
def upsert_moved_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Load all vectors by year, then move the labelled ones to another year."""
    name = _new_table("vectors")
    tables.create_vectors(spark, name, new_path(spark, "vectors"))
    empty = F.map_from_arrays(F.array().cast("array<bigint>"), F.array().cast("array<float>"))
    rows = records.with_vector_keys(
        adapters.table(spark, sf_dir, "embeddings").select(
            F.col("vec_id").cast("string").alias("arxiv_id"),
            F.col("embedding").alias("dense_vector"),
            empty.alias("sparse_vector"),
            F.lit("none").alias("primary_category"),
            adapters.paper_date(F.col("vec_id")).alias("published_date"),
        )
    )
    tables.upsert(name, rows, "paper_id", rows_move=True)
    labelled = adapters.table(spark, sf_dir, "labels").select(F.col("doc_id").cast("string").alias("arxiv_id"))
    moved = records.with_ids(rows, labelled).withColumn("publication_year", F.lit(2030))
    tables.upsert(name, moved, "paper_id", rows_move=True)
    return tables.read(spark, name).select(
        "paper_id", "arxiv_id", "publication_year", F.size("dense_vector").cast("bigint").alias("dims")
    )


_VECTOR_VALUES = "round(list_sum(v.v), 6) AS total, round(v.v[1], 6) AS first_value"


def _vector_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    empty = F.map_from_arrays(F.array().cast("array<bigint>"), F.array().cast("array<float>"))
    return records.with_vector_keys(
        adapters.table(spark, sf_dir, "embeddings").select(
            F.col("vec_id").cast("string").alias("arxiv_id"),
            F.col("embedding").alias("dense_vector"),
            empty.alias("sparse_vector"),
            F.lit("none").alias("primary_category"),
            adapters.paper_date(F.col("vec_id")).alias("published_date"),
        )
    )


def _vector_values(vectors: DataFrame) -> DataFrame:
    total = F.aggregate("dense_vector", F.lit(0.0), lambda acc, x: acc + x.cast("double"))
    first = F.col("dense_vector")[0].cast("double")
    return vectors.select(
        "paper_id", "arxiv_id", F.col("publication_year").cast("int").alias("publication_year"),
        F.round(total, 6).alias("total"), F.round(first, 6).alias("first_value"),
    )


@query("versioned_upsert_papers", f"""
WITH {PAPERS}
SELECT p.arxiv_id, CASE WHEN l.doc_id IS NULL THEN p.title ELSE 'second' END AS title, md5(p.abstract) AS abstract_md5,
  CASE WHEN l.doc_id IS NULL THEN 'pending' ELSE 'embedded' END AS processed_status
FROM papers p LEFT JOIN labels l USING (doc_id)
""")
def versioned_upsert_papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Load all papers, then replace the labelled ones; the batch names each of them twice, the later one counts."""
    documents = adapters.table(spark, sf_dir, "documents")
    stored = tables.versioned_papers(spark, new_path(spark, "papers"), _buckets(documents, 8))
    papers = adapters.papers(spark, sf_dir).withColumn("line_no", F.lit(0))
    stored.upsert(papers, latest="line_no")
    labelled = adapters.table(spark, sf_dir, "labels").select(F.col("doc_id").cast("string").alias("arxiv_id"))
    revised = records.with_ids(papers, labelled).withColumn("processed_status", F.lit("embedded"))
    lines = F.explode(F.array(F.struct(F.lit("second").alias("title"), F.lit(2).alias("line_no")), F.struct(F.lit("first").alias("title"), F.lit(1).alias("line_no"))))
    stored.upsert(revised.drop("title", "line_no").select("*", lines.alias("line")).select("*", "line.*"), latest="line_no")
    return stored.read().select("arxiv_id", "title", F.md5("abstract").alias("abstract_md5"), "processed_status")


@query("versioned_moved_vectors", f"""
WITH {VECTORS}
SELECT {HASH.format(text='v.arxiv_id')} AS paper_id, v.arxiv_id,
  CAST(CASE WHEN l.doc_id IS NULL THEN v.year ELSE 2030 END AS INTEGER) AS publication_year, {_VECTOR_VALUES}
FROM vectors v LEFT JOIN labels l ON l.doc_id = v.vec_id
""")
def versioned_moved_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Load all vectors, then move the labelled ones to another year in three batches."""
    rows = _vector_rows(spark, sf_dir)
    stored = tables.versioned_vectors(spark, new_path(spark, "vectors"), _buckets(rows, 8))
    stored.upsert(rows, latest="publication_year")
    labels = adapters.table(spark, sf_dir, "labels")
    for batch in range(3):
        ids = labels.where(F.col("doc_id") % 3 == batch).select(F.col("doc_id").cast("string").alias("arxiv_id"))
        stored.upsert(records.with_ids(rows, ids).withColumn("publication_year", F.lit(2030)), latest="publication_year")
    return _vector_values(stored.read())


@query("versioned_lookup", f"""
WITH {VECTORS}
SELECT {HASH.format(text='v.arxiv_id')} AS paper_id, v.arxiv_id, CAST(v.year AS INTEGER) AS publication_year, {_VECTOR_VALUES}
FROM vectors v WHERE vec_id IN (SELECT doc_id FROM labels)
""")
def versioned_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of the labelled papers, from a base and a delta that replaces every second row by itself."""
    rows = _vector_rows(spark, sf_dir)
    stored = tables.versioned_vectors(spark, new_path(spark, "vectors"), _buckets(rows, 8))
    stored.upsert(rows, latest="publication_year")
    stored.upsert(rows.where(F.col("paper_id") % 2 == 0), latest="publication_year")
    ids = adapters.table(spark, sf_dir, "labels").select(hash60(F.col("doc_id").cast("string")).alias("paper_id"))
    return _vector_values(stored.lookup(ids))


@query("collection_count", "SELECT count(*) AS n, count(*) AS n_versioned FROM embeddings")
def collection_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the vector tables after the same rows were written twice."""
    rows = _vector_rows(spark, sf_dir)
    stored = tables.versioned_vectors(spark, new_path(spark, "vectors"), _buckets(rows, 4))
    name = _new_table("counted")
    tables.create_vectors(spark, name, new_path(spark, "vectors"))
    for _ in range(2):
        stored.upsert(rows, latest="publication_year")
        tables.upsert(name, rows, "paper_id", rows_move=True)
    counts = [t.agg(F.count("*").alias("n")).scalar() for t in (tables.read(spark, name), stored.read())]
    return spark.range(1).select(counts[0].alias("n"), counts[1].alias("n_versioned"))


@query("bitmap_lookup", f"""
WITH {PAPERS}
SELECT arxiv_id, title, md5(abstract) AS abstract_md5 FROM papers WHERE doc_id IN (SELECT doc_id FROM labels)
""")
def bitmap_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Papers of a list that is treated as too long to broadcast."""
    ids = adapters.table(spark, sf_dir, "labels").select(F.col("doc_id").cast("string").alias("arxiv_id"))
    papers = adapters.papers(spark, sf_dir).select("arxiv_id", "title", "abstract")
    return rows_with_keys(papers, ids, "arxiv_id", max_rows=0).select("arxiv_id", "title", F.md5("abstract").alias("abstract_md5"))


@query("missing_ids", """
SELECT CAST(doc_id AS VARCHAR) AS arxiv_id FROM documents d
WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)
""")
def missing_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = adapters.table(spark, sf_dir, "labels").select(F.col("doc_id").cast("string").alias("arxiv_id"))
    return records.missing_ids(adapters.papers(spark, sf_dir).select("arxiv_id"), stored)


@query("lookup_ids", f"""
WITH {PAPERS}
SELECT arxiv_id, title, primary_category, published_date FROM papers WHERE doc_id IN (SELECT doc_id FROM labels)
""")
def lookup_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = adapters.table(spark, sf_dir, "labels").select(F.col("doc_id").cast("string").alias("arxiv_id"))
    return records.with_ids(adapters.papers(spark, sf_dir), ids).select(
        "arxiv_id", "title", "primary_category", "published_date"
    )


@query("fetch_vectors", f"""
WITH {VECTORS}
SELECT arxiv_id, CAST(year AS INTEGER) AS publication_year, round(list_sum(v), 6) AS total
FROM vectors WHERE vec_id IN (SELECT doc_id FROM labels)
""")
def fetch_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = adapters.table(spark, sf_dir, "labels").select(F.col("doc_id").cast("string").alias("arxiv_id"))
    stored = adapters.vectors(spark, sf_dir).withColumn("paper_id", F.conv(F.substring(F.md5("arxiv_id"), 1, 15), 16, 10).cast("bigint"))
    found = tables.fetch_vectors(stored, ids, "publication_year", "dense_vector")
    total = F.aggregate("dense_vector", F.lit(0.0), lambda acc, x: acc + x.cast("double"))
    return found.select("arxiv_id", "publication_year", F.round(total, 6).alias("total"))


@query("csv_round_trip", f"""
WITH {PAPERS}, tokens AS (SELECT arxiv_id, unnest({WORDS.format(text="title || ' ' || abstract")}) AS token FROM papers)
SELECT p.arxiv_id, md5(p.title) AS title_md5, 64::BIGINT AS dims,
  (SELECT count(DISTINCT token) FROM tokens t WHERE t.arxiv_id = p.arxiv_id) AS n_tokens
FROM papers p
""")
def csv_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encoded papers written as CSV and read back."""
    path = new_path(spark, "csv")
    encoded = adapters.encoded_papers(spark, sf_dir, 64).select("arxiv_id", "title", "dense_vector", "sparse_vector")
    csv_files.write_embedded_csv(encoded, path)
    columns = T.StructType([T.StructField(c, T.StringType()) for c in encoded.columns])
    return csv_files.read_embedded_csv(spark, path, columns).select(
        "arxiv_id",
        F.md5(F.coalesce("title", F.lit(""))).alias("title_md5"),
        F.size("dense_vector").cast("bigint").alias("dims"),
        F.size("sparse_vector").cast("bigint").alias("n_tokens"),
    )


# Samples and statistics over dated, categorised rows ----------------------------------------


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adapters.table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").cast("string").alias("arxiv_id"),
        F.col("o_orderpriority").alias("primary_category"),
        F.to_date("o_orderdate").alias("published_date"),
    )


_ORDERS = """orders_dated AS (
  SELECT CAST(o_orderkey AS VARCHAR) AS arxiv_id, o_orderpriority AS primary_category,
         CAST(o_orderdate AS DATE) AS published_date FROM orders)"""

# Days are dealt to 50 spans of equal length; the last day begins a span of its own.
_BUCKETS = f"""{_ORDERS},
share AS (
  SELECT primary_category, global_ratio FROM (
    SELECT DISTINCT primary_category, count(*) OVER (PARTITION BY primary_category) / count(*) OVER () AS global_ratio FROM orders_dated)),
days AS (SELECT *, published_date - min(published_date) OVER () AS passed, max(published_date) OVER () - min(published_date) OVER () AS span
         FROM orders_dated),
binned AS (
  SELECT arxiv_id, primary_category, published_date, 1 + (50 * passed) // span AS bucket_id, global_ratio
  FROM days NATURAL JOIN share)"""


@query("category_list", "SELECT DISTINCT o_orderpriority AS primary_category FROM orders ORDER BY 1")
def category_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.categories(_orders(spark, sf_dir))


@query("date_range", f"WITH {_ORDERS} SELECT min(published_date) AS min_date, max(published_date) AS max_date FROM orders_dated")
def date_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.date_range(_orders(spark, sf_dir))


@query("category_share", f"WITH {_BUCKETS} SELECT primary_category, round(global_ratio, 6) AS global_ratio FROM share")
def category_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.category_share(_orders(spark, sf_dir)).withColumn("global_ratio", F.round("global_ratio", 6))


@query("time_buckets", f"""
WITH {_BUCKETS}
SELECT bucket_id::INTEGER AS bucket_id, primary_category, count(*) AS n, min(published_date) AS first_date, max(published_date) AS last_date
FROM binned GROUP BY ALL
""")
def time_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.time_buckets(_orders(spark, sf_dir), 50).groupBy("bucket_id", "primary_category").agg(
        F.count("*").alias("n"), F.min("published_date").alias("first_date"), F.max("published_date").alias("last_date")
    )


# A cell may take the whole part of its target, and one row more with the odds of the fraction.
@query("stratified_sample", f"""
WITH {_BUCKETS},
cells AS (
  SELECT arxiv_id, primary_category, published_date, bucket_id, 5000 / 50 * global_ratio AS exact_target,
         {HASH.format(text="'order-42:' || arxiv_id")} AS place, {HASH.format(text="'round-42:' || arxiv_id")} / pow(2, 60) AS draw
  FROM binned),
placed AS (
  SELECT *, count(*) OVER (PARTITION BY bucket_id, primary_category ORDER BY arxiv_id <> '7', place, arxiv_id ROWS UNBOUNDED PRECEDING) AS rnk
  FROM cells)
SELECT arxiv_id, primary_category, published_date, bucket_id::INTEGER AS bucket_id, rnk, round(exact_target, 6) AS exact_target
FROM placed WHERE rnk <= trunc(exact_target) OR (rnk = trunc(exact_target) + 1 AND draw < exact_target - trunc(exact_target))
""")
def stratified_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    sample = sampling.stratified_sample(_orders(spark, sf_dir), 5000, 50, pinned=["7"], seed=42)
    return sample.select(
        "arxiv_id",
        "primary_category",
        "published_date",
        "bucket_id",
        F.col("rnk").cast("bigint").alias("rnk"),
        F.round("exact_target", 6).alias("exact_target"),
    )


@query("sample_view", f"""
WITH {PAPERS}
SELECT arxiv_id, title, md5(abstract) AS abstract_md5, primary_category, published_date
FROM (SELECT *, row_number() OVER (ORDER BY {HASH.format(text="'sample-42:' || arxiv_id")}, arxiv_id) AS r FROM papers)
WHERE r <= 100
""")
def sample_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sample of exactly 100 papers, stored once and listed by date."""
    drawn = sampling.exact_sample(adapters.papers(spark, sf_dir), 100, "arxiv_id", seed=42)
    stored = tables.materialise_once(drawn, _new_table("sample"), new_path(spark, "sample"))
    return sampling.sample_listing(stored).select(
        "arxiv_id", "title", F.md5("abstract").alias("abstract_md5"), "primary_category", "published_date"
    )


# Streams -------------------------------------------------------------------------------------


@query("stream_ingest", _EXPECTED_CLEAN)
def stream_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = _new_table("streamed_papers")
    tables.create_papers(spark, name, new_path(spark, "streamed"), buckets=4)
    source = _written_records(spark, sf_dir)
    feeds.ingest_feed(spark, source, name, new_path(spark, "progress")).awaitTermination()
    return _clean_view(tables.read(spark, name))


@query("stream_encode", f"""
WITH {PAPERS}, tokens AS (SELECT arxiv_id, unnest({WORDS.format(text="title || ' ' || abstract")}) AS token FROM papers)
SELECT {HASH.format(text='p.arxiv_id')} AS paper_id, p.arxiv_id,
  CAST(year(published_date) AS INTEGER) AS publication_year, 64::BIGINT AS dims,
  (SELECT count(DISTINCT token) FROM tokens t WHERE t.arxiv_id = p.arxiv_id) AS n_tokens
FROM papers p
""")
def stream_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = _new_table("streamed_vectors")
    tables.create_vectors(spark, name, new_path(spark, "streamed"))
    source = new_path(spark, "papers")
    adapters.papers(spark, sf_dir).write.parquet(source)
    feeds.encode_feed(
        spark, source, name, new_path(spark, "progress"), lambda papers: encode.hash_encode_papers(papers, 64)
    ).awaitTermination()
    return tables.read(spark, name).select(
        "paper_id",
        "arxiv_id",
        "publication_year",
        F.size("dense_vector").cast("bigint").alias("dims"),
        F.size("sparse_vector").cast("bigint").alias("n_tokens"),
    )


@query("stream_ingest_versioned", _EXPECTED_CLEAN)
def stream_ingest_versioned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All records twice, the second time as they should be, in two runs of the feed into a versioned table."""
    buckets = _buckets(adapters.table(spark, sf_dir, "documents"), 4)
    stored = tables.versioned_papers(spark, new_path(spark, "streamed"), buckets)
    source, progress = new_path(spark, "records"), new_path(spark, "progress")
    for title in (F.lit("draft"), F.col("title")):
        adapters.records(spark, sf_dir).withColumn("title", title).write.mode("append").json(source)
        feeds.ingest_feed(spark, source, stored, progress).awaitTermination()
    return _clean_view(stored.read())


@query("stream_encode_versioned", f"""
WITH {ENCODED}, dense AS ({hashed('tf', 'arxiv_id', 64)})
SELECT arxiv_id, CAST(year(published_date) AS INTEGER) AS publication_year, dim, round(x, 6) AS x
FROM dense JOIN papers USING (arxiv_id) WHERE round(x, 6) <> 0
""")
def stream_encode_versioned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half of the papers, then all of them: the feed encodes those that are not stored. The values are compared."""
    buckets = _buckets(adapters.table(spark, sf_dir, "documents"), 4)
    stored = tables.versioned_vectors(spark, new_path(spark, "streamed"), buckets)
    source, progress = new_path(spark, "papers"), new_path(spark, "progress")
    papers = adapters.papers(spark, sf_dir)
    for batch in (papers.where(F.col("arxiv_id").cast("bigint") % 2 == 0), papers):
        batch.write.mode("append").parquet(source)
        feeds.encode_feed(spark, source, stored, progress, lambda rows: encode.hash_encode_papers(rows, 64)).awaitTermination()
    values = stored.read().select("arxiv_id", "publication_year", F.posexplode("dense_vector").alias("dim", "x"))
    return values.select(
        "arxiv_id", F.col("publication_year").cast("int").alias("publication_year"), F.col("dim").cast("bigint").alias("dim"),
        F.round(F.col("x").cast("double"), 6).alias("x"),
    ).where(F.col("x") != 0)
