"""Physical plans: what is read, what moves, and how often the kernels run."""

import re

import pytest
from pyspark.sql import functions as F

from pagespark.operators import code as C
from pagespark.operators import dom as D
from pagespark.operators import expand as E
from pagespark.operators import page as P
from pagespark.plans import spec as G


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def count(pattern, df):
    return len(re.findall(pattern, plan(df)))


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("plans"))
    pages = spark.range(20).select(F.col("id").alias("page_id"), F.lit("https://h/x").alias("url"), F.lit("<p>a").alias("html"))
    pages.withColumn("extra", F.lit(1)).write.parquet(f"{folder}/pages")
    versions = spark.range(20).select(
        F.lit("o/r").alias("repo"), F.lit("a").alias("ref"), F.concat(F.lit("f"), "id", F.lit(".py")).alias("path"),
        F.lit("def f(): pass").alias("content"), F.md5(F.col("id").cast("string")).alias("blob_sha"),
    )
    versions.write.parquet(f"{folder}/versions")
    return spark.read.parquet(f"{folder}/pages").drop("extra"), spark.read.parquet(f"{folder}/versions")


PAGE_OPERATORS = [
    P.page_titles, P.interactive_elements, P.dynamic_elements, P.meta_tags, P.link_tags, P.page_meta, P.content_areas,
    P.navigation_blocks, P.headings, P.forms, P.raw_page_info, P.content_metrics, P.static_nodes, P.detect_challenge,
    P.quick_profile, E.expandable_elements, E.element_content, G.static_elements, G.dynamic_element_specs,
    G.layout_analysis, G.content_selectors, G.metadata_selectors, G.navigation_patterns, G.form_patterns, G.page_specs,
]


@pytest.mark.parametrize("operator", PAGE_OPERATORS, ids=lambda f: f.__name__)
def test_page_operators_parse_once_and_never_shuffle(tables, operator):
    df = operator(tables[0])
    assert count("MapInArrow", df) == 1
    assert count("Exchange", df) == 0


def test_inputs_are_spread_once_where_asked(spark, tables):
    spark.conf.set(D.PARTITIONS, "4")
    try:
        assert count(r"Exchange hashpartitioning", P.content_metrics(tables[0])) == 1
    finally:
        spark.conf.unset(D.PARTITIONS)


def test_only_read_columns_reach_the_kernel(tables):
    text = plan(P.content_metrics(tables[0].drop("url")))
    assert "ReadSchema: struct<page_id:bigint,html:string>" in text


def test_nested_expandables_do_not_move(tables):
    df = E.nested_expandables(tables[0])
    assert count("MapInArrow", df) == 1 and count("Exchange", df) == 0


def test_python_filter_and_ref_reach_the_scan(tables):
    text = plan(C.changed_files(tables[1], "a", "b"))
    assert text.count("StringEndsWith(path,.py)") >= 2 and "In(ref, [a,b])" in text


def test_definition_changes_parse_once(tables):
    df = C.definition_changes(C.changed_files(tables[1], "a", "b"))
    assert count("MapInArrow", df) == 1
    assert count("MapInArrow", C.repo_totals_of(C.changed_files(tables[1], "a", "b"))) == 1


def test_texts_are_looked_up_after_the_comparison(tables):
    differ = C._between(C.python_files(tables[1]), "a", "b")
    assert "content" not in differ.columns and count("FileScan", differ) == 1 and count("Exchange", differ) == 1
    moved = [x for x in plan(differ).split("\n") if "Aggregate" in x]
    assert moved and not any(re.search(r"content#\d+(,|\])", x) for x in moved)


def test_definitions_pair_inside_the_row(tables):
    files = C.changed_files(tables[1], "a", "b")
    moved = count("Exchange", files)
    assert count("Exchange", C.definition_changes(files)) == moved
    assert count("Exchange", C.repo_totals_of(files)) == moved + 1


def test_no_cross_joins(tables):
    files = C.changed_files(tables[1], "a", "b")
    report = C.change_report(C.file_definition_changes(files))
    assert count("NestedLoop|Cartesian", report) == 0


# -- history --------------------------------------------------------------------------------------
@pytest.fixture(scope="module")
def many(spark, tmp_path_factory):
    """3,000 files at two refs, of which 30 differ, in one table without broadcasts."""
    folder = str(tmp_path_factory.mktemp("many"))
    refs = F.explode(F.array(F.lit("a"), F.lit("b"))).alias("ref")
    rows = spark.range(3000).select("id", refs).select(
        F.lit("o/r").alias("repo"), "ref", F.concat(F.lit("f"), "id", F.lit(".py")).alias("path"),
        F.concat(F.lit("def f(): return "), F.when((F.col("ref") == "b") & (F.col("id") % 100 == 0), -1).otherwise(F.col("id")).cast("string")).alias("content"),
    ).withColumn("blob_sha", F.md5("content"))
    rows.write.parquet(f"{folder}/t")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield spark.read.parquet(f"{folder}/t")
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_texts_of_unchanged_files_stay_at_the_scan(spark, many):
    """Every exchange that carries content stands above the bit map of changed keys."""
    df = C.changed_files(many, "a", "b")
    nodes = [x for x in plan(df).split("\n") if x.strip()]
    depth = [len(re.match(r"[ :+\-]*", x)[0]) for x in nodes]
    scans = [k for k, x in enumerate(nodes) if "FileScan" in x and re.search(r"ReadSchema: struct<[^>]*content", x)]
    wide = 0
    for k in scans:
        above, level = [], depth[k]
        for j in range(k - 1, -1, -1):
            if depth[j] < level:
                above.append(nodes[j])
                level = depth[j]
        first = next(i for i, x in enumerate(above) if "Exchange hashpartitioning" in x)
        carried = any(re.search(r"content#\d+(,|\])", x) for x in above[: first + 1] if "Project" in x and "sha2" not in x)
        if carried:
            wide += 1
            assert any("BroadcastHashJoin" in x and "_bucket" in x for x in above[:first])
    assert wide == 1 and df.count() == 30


def test_bit_map_keeps_all_keys_and_few_others(spark, many):
    from pagespark.functions.keyfilter import key_filter, might_hold

    keys = many.filter("ref = 'b' and cast(substring(path, 2, length(path) - 4) as int) % 100 = 0").select("repo", "path")
    marked = key_filter(keys, ["repo", "path"])
    held = {r.path for r in might_hold(many, marked, ["repo", "path"]).select("path").collect()}
    assert {r.path for r in keys.collect()} <= held and len(held) < 40
    assert marked.agg(F.max(F.length("_bits"))).first()[0] == 4096
    # a map that is too small lets more rows pass, and never fewer
    tiny = might_hold(many, key_filter(many.select("repo", "path"), ["repo", "path"], 1), ["repo", "path"], 1)
    assert tiny.count() == many.count()


def test_commit_pairs_read_once_and_exchange_thrice(spark, tmp_path):
    spark.range(50).select(F.lit("r").alias("repo"), F.col("id").cast("string").alias("sha"), F.timestamp_seconds("id").alias("committed_at")).write.parquet(f"{tmp_path}/c")
    df = C.commit_pairs(spark.read.parquet(f"{tmp_path}/c"))
    assert count("FileScan", df) == 1 and count("Exchange", df) == 3 and df.count() == 49


def test_intervals_read_versions_once_and_move_no_text(many, spark):
    commits = spark.createDataFrame([("o/r", "a", "2024-01-01"), ("o/r", "b", "2024-01-02")], "repo string, sha string, d string").withColumn("committed_at", F.to_timestamp("d"))
    df = C.version_intervals(many, commits)
    assert count("FileScan", df) == 1 and count("Cartesian|NestedLoop", df) == 0
    assert df.count() == 3030 and C.interval_changes(df).count() == 30


def test_commits_meet_their_pair_only(spark, many):
    commits = spark.range(2000).select(F.lit("r").alias("repo"), F.col("id").cast("string").alias("sha"), F.timestamp_seconds(F.col("id") * 7).alias("committed_at"))
    pairs = C.commit_pairs(commits)
    df = C.commits_of_pairs(commits, pairs)
    assert count("Cartesian|NestedLoop", df) == 0
    rows = df.collect()
    assert len(rows) == 1999 and all(r.sha == r.head_ref for r in rows)
