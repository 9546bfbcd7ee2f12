"""Cleaning, tables, samples, CSV and streams."""

import datetime
import hashlib
import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from conceptstrata import schemas
from conceptstrata.functions import keys, text
from conceptstrata.operators import encode, records, sampling
from conceptstrata.plans import adapters, record_queries
from conceptstrata.sources import csv_files, json_lines, tables
from conceptstrata.streaming import feeds

STAMP = "Mon, 2 Apr 2007 19:18:42 GMT"
DAY = datetime.date(2007, 4, 2)


def record(**changes):
    base = {
        "id": "1", "title": " A title\n", "abstract": "\t text \r\n", "categories": "cs.LG stat.ML",
        "update_date": "2007-01-05", "versions": [{"version": "v1", "created": STAMP}],
        "authors_parsed": [["Noether", "Emmy", ""]],
    }
    return {**base, **changes}


def write_lines(folder, *lines, name="a.json"):
    folder.mkdir(exist_ok=True)
    body = "\n".join(line if isinstance(line, str) else json.dumps(line) for line in lines)
    (folder / name).write_text(body + "\n")
    return str(folder)


def test_edge_records(spark, tmp_path):
    path = write_lines(
        tmp_path / "in",
        record(),
        {k: v for k, v in record(id="2").items() if k != "title"},
        record(id="3", abstract=None, categories=""),
        record(id="4", update_date="2007-02-30"),
        record(id="5", update_date="2007-1-5", versions=[{"version": "v2", "created": STAMP}]),
        record(id="6", versions=[{"version": "v2", "created": "x"}, {"version": "v1", "created": STAMP}]),
        record(id="7", versions=[{"version": "v1", "created": "yesterday"}], categories=None),
        record(id="8", versions=[{"version": "v1", "created": "Sun, 30 Feb 2007 19:18:42 GMT"}], update_date="07-01-05"),
        record(id="9", versions=[], update_date=None),
        '{"id": "10", "title": ',
    )
    rows = {r.arxiv_id: r for r in records.clean_records(json_lines.read_records(spark, path)).collect()}
    assert sorted(rows) == [str(i) for i in range(1, 10)]
    assert (rows["1"].title, rows["1"].abstract, rows["1"].primary_category) == ("A title", "text", "cs.LG")
    assert (rows["2"].title, rows["3"].abstract, rows["3"].primary_category) == ("", "", "")
    assert rows["7"].primary_category == ""
    published = {i: r.published_date for i, r in rows.items()}
    assert published == {str(i): (None if i in (5, 7, 8, 9) else DAY) for i in range(1, 10)}
    updated = {i: r.last_updated_date for i, r in rows.items()}
    assert updated == {
        str(i): (None if i in (4, 8, 9) else datetime.date(2007, 1, 5)) for i in range(1, 10)
    }
    assert {r.processed_status for r in rows.values()} == {"pending"}
    bad = json_lines.malformed_lines(spark, path).collect()
    assert [r.value for r in bad] == ['{"id": "10", "title": ']
    strict = records.clean_records(json_lines.read_records(spark, path), strict=True)
    assert {r.arxiv_id for r in strict.collect()} == {"1", "2", "4", "6"}


def test_date_does_not_follow_the_session_zone(spark):
    stamp = spark.createDataFrame([("Mon, 2 Apr 2007 23:59:59 GMT",), ("mon, 02 apr 2007 0:0:0 gmt",)], "s string")
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "Pacific/Auckland")
        assert [r.d for r in stamp.select(text.rfc822_date(F.col("s")).alias("d")).collect()] == [DAY, DAY]
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_authors(spark):
    rows = spark.createDataFrame(
        [("1", [["Noether", "Emmy", ""], ["", "Plato", ""], ["", ""], []]), ("2", [["Noether", "Emmy", "Jr"]])],
        "id string, authors_parsed array<array<string>>",
    )
    links = {(r.paper_id, r.name) for r in records.author_links(rows).collect()}
    assert links == {("1", "Emmy Noether"), ("1", "Plato"), ("2", "Emmy Noether")}
    assert records.authors(rows).count() == 2 and records.paper_authors(rows).count() == 3


def test_hash_is_the_md5_prefix(spark):
    row = spark.createDataFrame([("1706.03762", 2017, "cs.CL")], "i string, y int, c string").select(
        keys.hash60(F.col("i")).alias("h"), keys.partition_key(F.col("y"), F.col("c")).alias("p")
    ).first()
    assert row.h == int(hashlib.md5(b"1706.03762").hexdigest()[:15], 16)
    assert row.p == int(hashlib.md5(b"2017_cs.CL").hexdigest()[:15], 16)


def test_shards_are_disjoint_and_complete(spark, sf_small):
    papers = adapters.papers(spark, sf_small)
    shards = [{r.arxiv_id for r in records.pending(papers, 4, s).select("arxiv_id").collect()} for s in range(4)]
    assert sum(map(len, shards)) == len(set().union(*shards)) == papers.count()


def test_status_check(spark):
    rows = spark.createDataFrame([("a", "pending"), ("b", "lost"), ("c", None)], "arxiv_id string, processed_status string")
    assert {r.arxiv_id for r in records.invalid_status(rows).collect()} == {"b", "c"}


def test_line_numbers_over_many_splits(spark, tmp_path):
    for part in range(3):
        write_lines(tmp_path / "n", *[record(id=f"{part}-{i}", abstract="x" * 3000) for i in range(200)], name=f"{part}.json")
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    cost = spark.conf.get("spark.sql.files.openCostInBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "100000")
        spark.conf.set("spark.sql.files.openCostInBytes", "1000")
        rows = json_lines.numbered_records(spark, str(tmp_path / "n"))
        got = {r.id: r.line_no for r in rows.select("id", "line_no").collect()}
        sample = json_lines.systematic(rows, limit=10, estimated_lines=500).select("line_no").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.conf.set("spark.sql.files.openCostInBytes", cost)
    assert got == {f"{p}-{i}": p * 200 + i for p in range(3) for i in range(200)}
    assert sorted(r.line_no for r in sample) == list(range(0, 500, 50))


def paper_rows(spark, *rows):
    data = [(i, t, "a", "cs", d, d, None, None, s) for i, t, d, s in rows]
    return spark.createDataFrame(data, schemas.PAPERS)


def test_upsert_replaces_inserts_and_repeats(spark, tmp_path):
    tables.create_papers(spark, "up_papers", str(tmp_path / "papers"), buckets=3)
    tables.create_papers(spark, "up_papers", str(tmp_path / "papers"), buckets=3)  # exists already
    first = paper_rows(spark, *[(str(i), "old", DAY, "pending") for i in range(20)])
    tables.upsert("up_papers", tables.with_bucket(first, "up_papers"), "arxiv_id")
    second = paper_rows(spark, ("3", "new", None, "pending"), ("99", "new", DAY, "pending"))
    for _ in range(2):
        tables.upsert("up_papers", tables.with_bucket(second, "up_papers"), "arxiv_id")
        got = {r.arxiv_id: r.title for r in spark.table("up_papers").collect()}
        assert len(got) == spark.table("up_papers").count() == 21
        assert {i for i, t in got.items() if t == "new"} == {"3", "99"}
    tables.upsert("up_papers", tables.with_bucket(second.where("false"), "up_papers"), "arxiv_id")
    assert spark.table("up_papers").count() == 21
    # A catalog that has lost the table finds the data again.
    spark.sql("DROP TABLE up_papers")
    tables.create_papers(spark, "up_papers", str(tmp_path / "papers"), buckets=3)
    tables.attach(spark, "up_papers")
    assert spark.table("up_papers").count() == 21


def vector_rows(spark, *rows):
    data = [(i, str(i), [1.0], {1: 1.0}, year, i) for i, year in rows]
    return spark.createDataFrame(data, schemas.VECTORS)


def test_upsert_moves_rows_between_years(spark, tmp_path):
    tables.create_vectors(spark, "up_vectors", str(tmp_path / "vectors"))
    tables.upsert("up_vectors", vector_rows(spark, (1, 2000), (2, 2000), (3, 2001)), "paper_id", rows_move=True)
    moved = vector_rows(spark, (3, 2002), (1, 2001))
    for _ in range(2):
        tables.upsert("up_vectors", moved, "paper_id", rows_move=True)
        got = {(r.paper_id, r.publication_year) for r in spark.table("up_vectors").collect()}
        assert got == {(1, 2001), (2, 2000), (3, 2002)}
    # 2001 lost its only row to 2002 and gained another; emptying a year drops its partition.
    tables.upsert("up_vectors", vector_rows(spark, (1, 2005)), "paper_id", rows_move=True)
    assert {r[0] for r in spark.sql("SHOW PARTITIONS up_vectors").collect()} == {
        "publication_year=2000", "publication_year=2002", "publication_year=2005",
    }
    assert spark.table("up_vectors").count() == 3


def test_year_range_prunes_partitions(spark, tmp_path):
    tables.create_vectors(spark, "pruned", str(tmp_path / "pruned"))
    tables.upsert("pruned", vector_rows(spark, *[(i, 1990 + i) for i in range(10)]), "paper_id", rows_move=True)
    plan = spark.table("pruned").where("publication_year between 1993 and 1995")
    assert plan.count() == 3
    assert "PartitionFilters: [isnotnull(publication_year" in plan._jdf.queryExecution().executedPlan().toString()


def test_plain_tables(spark, tmp_path):
    for name, schema in (("t_authors", schemas.AUTHORS), ("t_links", schemas.PAPER_AUTHORS), ("t_citations", schemas.CITATIONS)):
        tables.create_plain(spark, name, schema, str(tmp_path / name))
        assert spark.table(name).columns == schema.fieldNames()


def test_materialise_once(spark, tmp_path):
    tables.materialise_once(spark.range(3), "once", str(tmp_path / "once"))
    assert tables.materialise_once(spark.range(9), "once", str(tmp_path / "once")).count() == 3


def test_csv_files_are_bounded(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(csv_files, "FILE_ROWS", 10)
    csv_files.write_csv(spark.range(35).coalesce(1).selectExpr("id", "'a\nb' AS note"), str(tmp_path / "csv"))
    assert len(list((tmp_path / "csv").glob("part-*.csv"))) == 4
    back = spark.read.option("header", True).option("multiLine", True).csv(str(tmp_path / "csv"))
    assert sorted((int(r.id), r.note) for r in back.collect()) == [(i, "a\nb") for i in range(35)]


def test_buckets_follow_the_rows(spark, monkeypatch):
    monkeypatch.setattr(record_queries, "BUCKET_ROWS", 10)
    assert [record_queries._buckets(spark.range(n), 4) for n in (0, 40, 41, 95)] == [4, 4, 5, 10]


def test_line_files_are_as_many_as_partitions(spark, sf_small, monkeypatch):
    paths, sampled = [], json_lines.sampled_records
    monkeypatch.setattr(json_lines, "sampled_records", lambda spark, path, limit: paths.append(path) or sampled(spark, path, limit))
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # which merges small partitions
    try:
        record_queries.systematic_lines(spark, sf_small)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    assert len(spark.read.text(paths[0]).inputFiles()) == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_csv_round_trip(spark, tmp_path):
    rows = spark.createDataFrame(
        [("1", 'a "quoted", title\nof two lines', [0.5, -1.25], {7: 0.5, 9: 2.0}), ("2", "x", [0.0, 1e-5], {})],
        "arxiv_id string, title string, dense_vector array<float>, sparse_vector map<bigint,float>",
    )
    csv_files.write_embedded_csv(rows, str(tmp_path / "csv"))
    columns = T.StructType([T.StructField(c, T.StringType()) for c in rows.columns])
    back = csv_files.read_embedded_csv(spark, str(tmp_path / "csv"), columns)
    assert sorted(map(str, back.collect())) == sorted(map(str, rows.collect()))


def test_vector_text_with_line_breaks(spark):
    row = spark.createDataFrame([("[ 0.1  0.2\n 3.]", "{1: 0.5, 22: 1.5}")], "v string, m string").select(
        text.parse_vector(F.col("v")).alias("v"), text.parse_weights(F.col("m")).alias("m")
    ).first()
    assert row.v == pytest.approx([0.1, 0.2, 3.0]) and row.m == {1: 0.5, 22: 1.5}


def test_bucket_of_the_last_date(spark):
    days = [(str(i), "c", datetime.date(2000, 1, 1) + datetime.timedelta(i)) for i in range(101)] + [("n", "c", None)]
    rows = spark.createDataFrame(days, "arxiv_id string, primary_category string, published_date date")
    got = {r.arxiv_id: r.bucket_id for r in sampling.time_buckets(rows, 50).collect()}
    assert (got["0"], got["1"], got["2"], got["99"], got["100"]) == (1, 1, 2, 50, 51) and "n" not in got


def test_stratified_sample_is_repeatable_and_pins(spark):
    rows = spark.range(6000).select(
        F.col("id").cast("string").alias("arxiv_id"),
        F.when(F.col("id") % 3 == 0, "big").otherwise(F.concat(F.lit("c"), F.col("id") % 5)).alias("primary_category"),
        F.date_add(F.lit("2000-01-01").cast("date"), (F.col("id") % 1000).cast("int")).alias("published_date"),
    )
    draw = lambda seed: {
        r.arxiv_id for r in sampling.stratified_sample(rows, 500, 10, ["5000"], seed).select("arxiv_id").collect()
    }
    assert draw(1) == draw(1) != draw(2)
    assert "5000" in draw(1) and "5000" in draw(2) and 440 < len(draw(1)) < 560


def test_exact_sample(spark):
    rows = spark.range(1000)
    a, b = (sampling.exact_sample(rows.repartition(n), 37, "id").collect() for n in (3, 11))
    assert sorted(a) == sorted(b) and len(a) == 37

    def rank(i):
        return hashlib.md5(f"sample-42:{i}".encode()).hexdigest()[:15]

    assert {r.id for r in a} == set(sorted(range(1000), key=rank)[:37])
    assert sampling.exact_sample(rows, 2000, "id").count() == sampling.exact_sample(rows, 1000, "id").count() == 1000
    assert sampling.exact_sample(rows, 999, "id").count() == 999 and sampling.exact_sample(rows.limit(0), 3, "id").count() == 0


def test_exact_sample_narrows_the_interval(spark, monkeypatch):
    monkeypatch.setattr(sampling, "FEW_ROWS", 3)
    monkeypatch.setattr(sampling, "ROUND_BITS", 4)
    rows = spark.range(700).unionByName(spark.range(5).select(F.lit(3).cast("bigint").alias("id")))  # six rows of one key
    for n in (1, 50, 701):
        got = sorted(r.id for r in sampling.exact_sample(rows, n, "id").collect())
        ranked = sorted([*range(700), *[3] * 5], key=lambda i: (hashlib.md5(f"sample-42:{i}".encode()).hexdigest()[:15], i))
        assert got == sorted(ranked[:n])


def test_every_line_is_read_or_handed_on(spark, tmp_path):
    path = write_lines(tmp_path / "all", record(), {"title": "no id"}, "", '{"id": null, "title": "x"}', "[1, 2]", record(id="2", versions="odd"), "  ")
    assert {r.id for r in json_lines.read_records(spark, path).collect()} == {"1", "2"}
    left = {r.value for r in json_lines.malformed_lines(spark, path).collect()}
    assert left == {'{"title": "no id"}', '{"id": null, "title": "x"}', "[1, 2]"}


def test_sample_reaches_the_last_lines(spark):
    rows = spark.range(199).select(F.col("id").alias("line_no"))
    assert [r.line_no for r in json_lines.systematic(rows, 100).orderBy("line_no").collect()] == list(range(0, 199, 2))
    assert [r.line_no for r in json_lines.systematic(rows, 60).orderBy("line_no").collect()] == list(range(0, 199, 4))


def test_ingest_feed_takes_new_files_once(spark, tmp_path):
    tables.create_papers(spark, "fed", str(tmp_path / "fed"), buckets=2)
    source, progress = tmp_path / "source", str(tmp_path / "progress")
    write_lines(source, record(title="first"), record(id="2"), record(title="last"), name="0.json")
    feeds.ingest_feed(spark, str(source), "fed", progress).awaitTermination()
    assert {r.arxiv_id: r.title for r in tables.read(spark, "fed").collect()} == {"1": "last", "2": "A title"}
    write_lines(source, record(id="2", title="changed"), record(id="3"), name="1.json")
    for _ in range(2):
        feeds.ingest_feed(spark, str(source), "fed", progress).awaitTermination()
        assert {r.arxiv_id: r.title for r in tables.read(spark, "fed").collect()} == {
            "1": "last", "2": "changed", "3": "A title",
        }


def test_encode_feed_and_status(spark, tmp_path, sf_small):
    papers = adapters.papers(spark, sf_small)
    tables.create_papers(spark, "enc_papers", str(tmp_path / "p"), buckets=2)
    tables.create_vectors(spark, "enc_vectors", str(tmp_path / "v"))
    tables.upsert("enc_papers", tables.with_bucket(papers, "enc_papers"), "arxiv_id")
    encoder = lambda batch: encode.hash_encode_papers(batch, 16)
    source, progress = str(tmp_path / "source"), str(tmp_path / "progress")
    papers.where("arxiv_id < '5'").write.parquet(source)
    feeds.encode_feed(spark, source, "enc_vectors", progress, encoder).awaitTermination()
    feeds.mark_embedded(spark, "enc_papers", "enc_vectors")
    n = papers.where("arxiv_id < '5'").count()
    assert tables.read(spark, "enc_vectors").count() == n
    assert tables.read(spark, "enc_papers").where("processed_status = 'embedded'").count() == n
    papers.where("arxiv_id >= '5'").write.mode("append").parquet(source)
    feeds.encode_feed(spark, source, "enc_vectors", progress, encoder).awaitTermination()
    feeds.mark_embedded(spark, "enc_papers", "enc_vectors")
    assert records.pending(tables.read(spark, "enc_papers")).count() == 0
    assert tables.read(spark, "enc_vectors").count() == papers.count()
    found = tables.fetch_vectors(tables.read(spark, "enc_vectors"), papers.where("arxiv_id = '7'"), "dense_vector").collect()
    assert [(r.arxiv_id, len(r.dense_vector)) for r in found] == [("7", 16)]
