"""The facts over the shared lines against their own definitions."""

from pyspark.sql import functions as F

from kenmap.plans import catalog
from kenmap.sources import adapter


def test_facts_over_shared_lines_are_those_of_their_definitions(spark, sf):
    shared, own = catalog.engine(spark, sf), catalog.engine(spark, sf, pinned=False)
    rows = lambda df: sorted(map(str, df.select(*[F.round(c, 6).alias(c) if k == "double" else F.col(c) for c, k in df.dtypes]).collect()))
    for name in adapter.SHARED:
        got, want = shared.table(name), own.table(name)
        assert got.columns == want.columns and rows(got) == rows(want), name


def test_facts_by_person_join_no_supplier_and_no_customer_again(spark, sf):
    own = catalog.engine(spark, sf)
    for name in adapter.SHARED:
        plan = own.table(name)._jdf.queryExecution().optimizedPlan().toString()
        assert not [key for key in ("l_suppkey", "s_suppkey", "o_custkey", "c_custkey") if key in plan], name


def test_facts_over_shared_lines_hold_where_keys_are_missing_or_stand_twice(spark, sf, tmp_path):
    for name in adapter.TABLES:
        table = spark.read.parquet(f"{sf}/{name}.parquet")
        if name in ("supplier", "customer"):
            key, nation = table.columns[0], f"{name[0]}_nationkey"
            moved = table.where(F.col(key) % 3 == 0).withColumn(nation, (F.col(nation) + 1) % 25)
            table = table.where(F.col(key) % 5 != 0).union(moved).union(table.where(F.col(key) % 4 == 1)).union(table.where(F.col(key) % 7 == 1).withColumn(nation, F.lit(None).cast("int")))
        if name in ("lineitem", "orders"):
            key = "l_suppkey" if name == "lineitem" else "o_custkey"
            table = table.withColumn(key, F.when(F.xxhash64("*") % 6 != 0, F.col(key)))
        table.write.parquet(f"{tmp_path}/{name}.parquet")
    test_facts_over_shared_lines_are_those_of_their_definitions(spark, str(tmp_path))


def test_lines_meet_their_orders_and_paths_once(spark, sf):
    own = catalog.engine(spark, sf)
    plan = own.table("signals")._jdf.queryExecution().optimizedPlan().toString()
    assert "round-" in own.table("line_items").inputFiles()[0] and "l_partkey" not in plan


def test_shuffles_have_partitions_by_the_history(spark):
    key = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
    before = spark.conf.get(key, None)
    try:
        catalog.sized(spark, 36_000_000)
        assert spark.conf.get(key) == "360"
        catalog.sized(spark, 10)
        assert spark.conf.get(key) == "360"
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def test_scores_read_the_history_in_buckets_by_path_and_never_gather_a_person(spark, sf):
    own = catalog.engine(spark, sf)
    own.pinned = own.pinned - {"scored"}
    key, plans = "spark.sql.requireAllClusterKeysForCoPartition", []
    usual = spark.conf.get(key)
    for name in ("kept_contributions", "blame_share"):
        plans.append(own.table(name)._jdf.queryExecution().executedPlan().toString())
    large = [line for plan in plans for line in plan.splitlines() if "Join [author" in line]
    assert large and all("BroadcastHashJoin" in line for line in large)
    assert "Exchange hashpartitioning(path" not in plans[1] and "Bucketed: true" in plans[1]
    catalog.engine(spark, sf).table("scored")
    assert spark.conf.get(key) == usual
