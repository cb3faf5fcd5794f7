from __future__ import annotations

import hashlib

import duckdb
import pytest
from compare import connect, duck_rows, spark_rows
from pyspark.sql import functions as F

from starward.llm import warc
from starward.llm.warc import archives, audit, fixity, merkle_tree, split_archives, warc_records

PAGES = "page_id long, url string, html string, place string, record int"


def pages(spark, rows):
    return spark.createDataFrame([(*row, "clash", 0) for row in rows], PAGES).repartition(3)


@pytest.fixture
def many(spark):
    rows = [(k, f"http://a.b/{k}", f"<p>é {k}\r\n\r\nContent-Length: 3</p>" * (k % 7)) for k in range(300)]
    return warc_records(pages(spark, rows), records=40)


def listed(frame):
    return sorted(map(tuple, frame.collect()), key=str)


def test_records_follow_each_other(many):
    rows = sorted((r.archive, r.place, r.offset, len(r.record)) for r in many.collect())
    assert len(rows) == 300
    for (archive, place, offset, length), after in zip(rows, rows[1:], strict=False):
        if after[0] == archive:
            assert after[1:3] == (place + 1, offset + length)
        else:
            assert after[1:3] == (0, 0)
    assert max(r[1] for r in rows) < 40


def test_archives_split_again(many):
    placed = many.select("archive", "place", "offset", "record")
    assert listed(split_archives(archives(many))) == listed(placed)


def test_broken_bytes_are_kept(spark):
    rows = [(1, b"no record at all"), (2, b""), (3, None), (4, b"A: b\r\n\r\n"), (5, b"WARC/1.1\r\nContent-Length: 99\r\n\r\nshort\r\n\r\n")]
    got = split_archives(spark.createDataFrame(rows, "archive long, data binary")).collect()
    assert {r.archive: bytes(r.record) for r in got} == {k: data for k, data in rows if data}


def damage(records, changed, lost):
    broken = F.when(F.col("page_id").isin(changed), F.concat("record", F.lit(b"x"))).otherwise(F.col("record"))
    return records.where(~F.col("page_id").isin(lost)).withColumn("record", broken)


@pytest.mark.parametrize(("changed", "lost"), [([], []), ([7], []), ([1, 2, 150], [3, 299]), (list(range(300)), []), ([], list(range(300)))])
def test_the_audit_finds_exactly_the_damage(many, changed, lost):
    whole, copy = merkle_tree(fixity(many)), merkle_tree(fixity(damage(many, changed, lost or [-1])))
    ids = {(r.archive, r.place): r.page_id for r in many.collect()}
    found = {(ids[r.archive, r.place], r.status) for r in audit(whole, copy).collect()}
    assert found == {(k, "changed") for k in changed} | {(k, "missing") for k in lost}
    found = {(ids[r.archive, r.place], r.status) for r in audit(copy, whole).collect()}
    assert found == {(k, "changed") for k in changed} | {(k, "added") for k in lost}


def test_only_differing_branches_change(many):
    left, right = (merkle_tree(fixity(r)) for r in (many, damage(many, [5], [-1])))
    for one, other in zip(left, right, strict=True):
        apart = one.join(other, ["archive", "place"]).where(one["digest"] != other["digest"])
        assert apart.count() == 1


def test_nodes_are_digests_of_their_children(many):
    leaves, *above = merkle_tree(fixity(many))
    below = sorted((r.archive, r.place, r.offset, r.length, r.digest) for r in leaves.collect())
    for level in above:
        groups = {}
        for archive, place, *rest in below:
            groups.setdefault((archive, place // 16), []).append((place, *rest))
        below = []
        for (archive, place), own in sorted(groups.items()):
            digest = hashlib.sha256("|".join(":".join(map(str, c)) for c in own).encode()).hexdigest()
            below.append((archive, place, own[0][1], own[-1][1] + own[-1][2] - own[0][1], digest))
        assert sorted((r.archive, r.place, r.offset, r.length, r.digest) for r in level.collect()) == below
    assert len(below) == len({row[0] for row in below})


def test_large_archives_have_several_roots(spark):
    rows = spark.range(10_000).select(F.lit(1).cast("long").alias("archive"), F.col("id").alias("place"), F.col("id").alias("offset"), F.lit(b"x").alias("record"))
    tree = merkle_tree(fixity(rows))
    assert [level.count() for level in tree] == [10_000, 625, 40, 3]
    changed = rows.withColumn("record", F.when(F.col("place").isin(0, 9999), F.lit(b"y")).otherwise(F.col("record")))
    assert sorted(r.place for r in audit(tree, merkle_tree(fixity(changed))).collect()) == [0, 9999]


def test_one_shuffle_builds_a_tree(many, conf):
    conf("spark.sql.adaptive.enabled", "false")
    leaves = fixity(many)
    grouped = leaves.groupBy("archive", F.floor(F.col("place") / 4096).alias("top")).applyInArrow(warc._branches(3), warc.NODES)
    plan = grouped._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1


def test_query_with_null_and_repeated_ids(spark, tiny):
    from starward.llm.queries import ORACLE, QUERIES

    name = "op5_warc_audit"
    rows = [(k, f"u{k}", "b" * (k or 3), "", 1) for k in (7, 101, 101, 218, 5, 5, None, None, 202)] + [(None, None, None, "", 2)]
    folder = tiny(pages=spark.createDataFrame(rows, PAGES))
    expected = sorted([(7, "missing"), (101, "changed"), (101, "changed"), (218, "missing"), (202, "changed")])
    assert sorted((r.page_id, r.status) for r in QUERIES[name](spark, folder).collect()) == expected
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{folder}/pages.parquet/*.parquet'")
    assert spark_rows(QUERIES[name](spark, folder)) == duck_rows(con, ORACLE[name])


def test_edges(spark):
    rows = [(1, None, None), (1, None, None), (None, "u", ""), (2, "a\nb", "x" * 100_000)]
    records = warc_records(pages(spark, rows))
    assert records.count() == 4
    assert audit(merkle_tree(fixity(records)), merkle_tree(fixity(records))).collect() == []
    assert b"WARC-Target-URI: a b\r\n" in bytes(records.where("page_id = 2").first().record)
    empty = warc_records(pages(spark, []))
    assert empty.collect() == [] and archives(empty).collect() == []
    assert audit(merkle_tree(fixity(empty)), merkle_tree(fixity(empty))).collect() == []


def test_query_agrees_with_sql(spark):
    from starward.llm.queries import ORACLE, QUERIES

    folder, name = "/root/testdata/sf0.01", "op5_warc_audit"
    assert spark_rows(QUERIES[name](spark, folder)) == duck_rows(connect(folder), ORACLE[name])
