"""Versioned tables: upserts as deltas, one version at a time, compaction, lookups without a shuffle of the table."""

import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from conceptstrata.operators import encode, lookup, records
from conceptstrata.plans import adapters
from conceptstrata.sources import tables, versioned
from conceptstrata.streaming import feeds

SCHEMA = T.StructType().add("id", "string").add("value", "integer").add("note", "string").add("weights", T.MapType(T.IntegerType(), T.FloatType()))


def rows_of(spark, pairs):
    return spark.createDataFrame([(i, v, f"note {v}", {v: 1.0}) for i, v in pairs], SCHEMA)


def found(frame):
    rows = [(r.id, r.value) for r in frame.collect()]
    assert len(rows) == len(dict(rows))
    return dict(rows)


def exchanges(frame):
    """Number of shuffles of a plan that have a file scan below them, and the plan."""
    plan = frame._jdf.queryExecution().executedPlan().toString()
    lines, moved = plan.split("\n"), 0
    depth = [len(line) - len(line.lstrip(" :+-|")) for line in lines]
    for i, line in enumerate(lines):
        if "Exchange hashpartitioning" in line:
            below = next((j for j in range(i + 1, len(lines)) if depth[j] <= depth[i]), len(lines))
            moved += any("FileScan" in x for x in lines[i + 1 : below])
    return moved, plan


def test_random_upserts_against_a_dict(spark, tmp_path):
    rng = random.Random(1)
    table = versioned.create_table(spark, str(tmp_path / "t"), SCHEMA, "id", buckets=3, max_deltas=2, compact_at=0.9)
    want, history = {}, []
    assert table.read().collect() == [] and table.version().number == 0
    for step in range(7):
        batch = [(f"k{rng.randrange(30)}", step * 100 + i) for i in range(rng.choice([1, 12, 4]))]
        table.upsert(rows_of(spark, batch).repartition(3), latest="value")
        want.update(dict(sorted(batch, key=lambda p: p[1])))
        history.append((table.version().number, dict(want)))
        assert found(table.read()) == want
        assert len(table.version().parts) <= 3
    # a version stays as it was
    for number, rows in history:
        assert found(table.read(number)) == rows
    # another session's view of the folder
    for part in table.version().parts:
        spark.sql(f"DROP TABLE part_{part.name}")
    assert found(versioned.open_table(spark, str(tmp_path / "t")).read()) == want


def test_small_batch_writes_few_bytes(spark, tmp_path):
    schema = T.StructType.fromDDL("id bigint, body string, line int")
    table = versioned.create_table(spark, str(tmp_path / "big"), schema, "id", buckets=2)

    def rows(frame, n):
        return frame.select("id", F.concat_ws(" ", *[F.md5(F.concat(F.col("id"), F.lit(f"-{n}-{i}"))) for i in range(30)]).alias("body"), F.lit(n).alias("line"))

    table.upsert(rows(spark.range(20_000), 0), latest="line")
    before = table.read()
    table.upsert(rows(spark.range(0, 20_000, 100), 1), latest="line")
    base, delta = table.part_bytes()
    assert delta < 0.02 * base
    # the frame of the earlier version still reads that version
    assert before.where("line = 1").count() == 0 and table.read().where("line = 1").count() == 200
    assert table.read().count() == 20_000
    again = table.upsert(rows(spark.range(0, 20_000, 100), 1), latest="line")
    assert again.number == 3 and table.read().where("line = 1").count() == 200


def test_latest_wins_and_keys_are_needed(spark, tmp_path):
    table = versioned.create_table(spark, str(tmp_path / "l"), SCHEMA, "id", buckets=2)
    batch = rows_of(spark, [("a", 3), ("a", 9), ("a", 5), (None, 1), ("b", 1)]).withColumn("line_no", -F.col("value"))
    table.upsert(batch, latest="line_no")
    assert found(table.read()) == {"a": 3, "b": 1}
    assert table.upsert(batch.where("id IS NULL"), latest="value").number == 1
    with pytest.raises(TypeError):
        table.upsert(batch)


def test_compaction_and_vacuum(spark, tmp_path):
    table = versioned.create_table(spark, str(tmp_path / "c"), SCHEMA, "id", buckets=2, max_deltas=2, compact_at=0.5)
    table.upsert(rows_of(spark, [(str(i), 0) for i in range(100)]), latest="value")
    for step in range(1, 4):
        table.upsert(rows_of(spark, [(str(step), step)]), latest="value")
    assert [p.rows for p in table.version().parts] == [100, 3]  # three deltas became one
    table.upsert(rows_of(spark, [(str(i), 7) for i in range(60)]), latest="value")
    assert [p.rows for p in table.version().parts] == [100]
    table.upsert(rows_of(spark, [("x", 8)]), latest="value")
    assert len(table.compact().parts) == 1 and table.compact().number == table.version().number
    table.vacuum()
    assert len(table.folder.names(versioned.PARTS)) == len(table.versions()) == 1
    assert found(table.read()) == {**{str(i): 7 if i < 60 else 0 for i in range(100)}, "x": 8}


def test_a_second_writer_of_a_version_fails(spark, tmp_path):
    table = versioned.create_table(spark, str(tmp_path / "w"), SCHEMA, "id", buckets=2)
    before = table.version()
    table.upsert(rows_of(spark, [("a", 1)]), latest="value")
    with pytest.raises(RuntimeError, match="another job"):
        table._commit(before, [])
    assert found(table.read()) == {"a": 1}


def test_the_table_is_not_shuffled(spark, tmp_path):
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    table = versioned.create_table(spark, str(tmp_path / "s"), SCHEMA, "id", buckets=4, compact_at=9.0)
    for step in range(3):
        table.upsert(rows_of(spark, [(str(i), step) for i in range(step * 10, step * 10 + 50)]), latest="value")
    ids = spark.range(0, 100, 7).select(F.col("id").cast("string").alias("id"))
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as if nothing were small
        merged = table.read()
        assert found(merged) == {str(i): min(i // 10, 2) for i in range(70)}
        assert exchanges(merged)[0] == 0, exchanges(merged)[1]
        looked = table.lookup(ids)
        assert set(found(looked)) == {str(i) for i in range(0, 70, 7)}
        assert exchanges(looked)[0] == 0, exchanges(looked)[1]
        assert "Exchange hashpartitioning" in exchanges(looked)[1]  # of the ids
        new = table.missing(ids)
        assert sorted(int(r.id) for r in new.collect()) == list(range(70, 100, 7))
        assert exchanges(new)[0] == 0, exchanges(new)[1]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)


def test_order_prunes_by_year(spark, tmp_path):
    schema = T.StructType.fromDDL("id bigint, year int")
    table = versioned.create_table(spark, str(tmp_path / "o"), schema, "id", buckets=2, order=["year", "id"])
    table.upsert(spark.range(1000).select("id", (1990 + F.col("id") % 30).cast("int").alias("year")), latest="year")
    table.upsert(spark.createDataFrame([(3, 2050)], schema), latest="year")
    wanted = table.read().where("year = 1993")
    assert wanted.count() == 33 and "PushedFilters: [IsNotNull(year), EqualTo(year,1993)]" in exchanges(wanted)[1]
    assert [r.id for r in table.read().where("year = 2050").collect()] == [3]


def test_feeds_into_versioned_tables(spark, tmp_path, sf_small):
    """An id that comes again is not encoded again: its vector keeps the size of the first encoder."""
    papers = adapters.papers(spark, sf_small)
    stored = tables.versioned_papers(spark, str(tmp_path / "papers"), buckets=2)
    vectors = tables.versioned_vectors(spark, str(tmp_path / "vectors"), buckets=2)
    stored.upsert(papers, latest="last_updated_date")
    source, progress = str(tmp_path / "source"), str(tmp_path / "progress")
    first = papers.where("arxiv_id < '5'")
    first.unionByName(first).write.parquet(source)
    feeds.encode_feed(spark, source, vectors, progress, lambda rows: encode.hash_encode_papers(rows, 16)).awaitTermination()
    feeds.mark_embedded(spark, stored, vectors)
    assert stored.read().where("processed_status = 'embedded'").count() == vectors.count() == first.count()
    papers.write.mode("append").parquet(source)
    feeds.encode_feed(spark, source, vectors, progress, lambda rows: encode.hash_encode_papers(rows, 8)).awaitTermination()
    sizes = {r.arxiv_id: r.n for r in vectors.read().select("arxiv_id", F.size("dense_vector").alias("n")).collect()}
    assert sizes == {r.arxiv_id: 16 if r.arxiv_id < "5" else 8 for r in papers.collect()}
    feeds.mark_embedded(spark, stored, vectors)
    assert records.pending(stored.read()).count() == 0 and stored.count() == papers.count()


@pytest.mark.parametrize("bits", [1 << 15, 1 << 18])
def test_bitmap_lookup(spark, bits, monkeypatch):
    monkeypatch.setattr(lookup, "MAX_BITS", bits)
    wide = spark.range(50_000).select(F.concat(F.lit("p"), "id").alias("id"), F.col("id").alias("n")).unionByName(spark.createDataFrame([(None, -1)], "id string, n bigint"))
    ids = spark.range(0, 60_000, 9).select(F.concat(F.lit("p"), "id").alias("id"))
    listed = ids.unionByName(ids.limit(5)).unionByName(spark.createDataFrame([(None,)], "id string"))
    want = set(range(0, 50_000, 9))
    assert {r.n for r in lookup.rows_with_keys(wide, listed, "id", max_rows=10).collect()} == want
    assert lookup.joined_by_key(wide, ids.unionByName(ids).withColumn("k", F.lit(1)), "id", max_rows=10).count() == 2 * len(want)
    passed = lookup.narrowed(wide, ids, "id", ids.count())
    assert {r.n for r in passed.collect()} >= want
    if bits > 1 << 15:  # enough of them: about one row in sixteen passes by chance
        assert passed.count() < len(want) + 50_000 / 8
    assert lookup.rows_with_keys(wide, ids.limit(0), "id").count() == 0
    assert [lookup.bits_for(n) for n in (1, 5_000, 10**12)] == [1 << 15, min(bits, 1 << 17), bits]


def test_long_lists_leave_the_table_where_it_lies(spark, tmp_path):
    """Above the bound only rows that pass the bitmap reach a shuffle; partitions not named are not read."""
    spark.range(3000).select("id", (F.col("id") % 10).cast("int").alias("publication_year"), F.md5(F.col("id").cast("string")).alias("body")).write.partitionBy(
        "publication_year"
    ).parquet(str(tmp_path / "wide"))
    wide = spark.read.parquet(str(tmp_path / "wide"))
    ids = spark.range(0, 3000, 20).select("id", (F.col("id") % 10).cast("int").alias("publication_year"))
    found = lookup.rows_with_keys(lookup.in_partitions(wide, ids, "publication_year"), ids, "id", max_rows=10)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert found.count() == 150 and "publication_year#" in plan and "PartitionFilters: [isnotnull(publication_year" in plan
    below = plan[: plan.index("FileScan parquet")]
    assert "BroadcastHashJoin [_word" in below.replace("#", " ").replace("  ", " ") or "_word" in below
