"""A lineage catalog and a batch of incidents derived from the star-schema tables.

Assets are the rows of part, supplier, orders, customer, nation, region and the
distinct brands; edges follow the keys. All of it is plain joins over whole
tables, so the catalog grows with the data.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from salvor.functions.scope import Scope
from salvor.operators import graph as G
from salvor.plans import compile as C
from salvor.plans import identity
from salvor.runtime import cut

SCOPE = Scope(prefix="estate.", domain="Retail / Estate", tag="estate-managed")
REGISTRY = ["snapshot_restore", "sql_transform", "report_refresh"]
SOURCE = "retail-estate"
AS_OF = "1995-06-30"

KINDS = {
    # kind: (artifact type, adapter, validations as (kind, parameters JSON, required))
    "brand": ("dataset", None, []),
    "part": ("dataset", "snapshot_restore", [("exists", "{}", True), ("row_count", '{"minimum":1}', True)]),
    "supplier": ("dataset", "snapshot_restore", [("exists", "{}", True), ("row_count", '{"minimum":1}', True)]),
    "order": ("dataset", "sql_transform", [("exists", "{}", True), ("schema", "{}", True)]),
    "customer": ("feature", "sql_transform", [("business_rule", '{"rule":"revenue_nonnegative"}', True)]),
    "nation": ("model", "report_refresh", [("exists", "{}", True), ("freshness", '{"maximum_age_seconds":300}', False)]),
    "region": ("dashboard", "report_refresh", [("input_fingerprint", "{}", True)]),
}


_SCHEMAS: dict[str, tuple[tuple, T.StructType]] = {}


def _files_state(spark: SparkSession, path: str) -> tuple[int, int, int]:
    """Time of change, bytes and number of files of a table; other data under a path has another one."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = place.getFileSystem(spark._jsc.hadoopConfiguration())
    summary = store.getContentSummary(place)
    return store.getFileStatus(place).getModificationTime(), summary.getLength(), summary.getFileCount()


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A test table; its schema is read once as long as its files stay the same."""
    path = f"{folder}/{name}.parquet"
    state = _files_state(spark, path)
    if path not in _SCHEMAS or _SCHEMAS[path][0] != state:
        _SCHEMAS[path] = state, spark.read.parquet(path).schema
    return spark.read.schema(_SCHEMAS[path][1]).parquet(path)


def asset_urn(kind: str, key: Column, space: Column | None = None) -> Column:
    return F.concat(
        F.lit(f"urn:li:dataset:(urn:li:dataPlatform:{kind},"),
        space if space is not None else F.lit("estate"),
        F.lit(f".{kind}."),
        key.cast("string"),
        F.lit(",PROD)"),
    )


def _validations(kind: str) -> Column:
    specs = KINDS[kind][2]
    if not specs:
        return F.array().cast(
            "array<struct<kind:string,parameters:map<string,string>,parameters_json:string,required:boolean>>"
        )
    return F.array(
        *[
            F.struct(
                F.lit(name).alias("kind"),
                F.from_json(F.lit(params), "map<string,string>").alias("parameters"),
                F.lit(params).alias("parameters_json"),
                F.lit(required).alias("required"),
            )
            for name, params, required in specs
        ]
    )


def _rows(
    kind: str, df: DataFrame, key: Column, availability: Column, *, owner: Column | None = None,
    risk: Column | None = None, approval: Column | None = None, mixed: dict | None = None,
) -> DataFrame:
    artifact, adapter, _ = KINDS[kind]
    mixed = mixed or {}
    name = F.concat(F.lit(f"{kind}."), key.cast("string"))
    params = F.concat(F.lit(f'{{"table":"{kind}","key":"'), key.cast("string"), F.lit('"}'))
    params = F.lit("{}") if adapter is None else params
    return df.select(
        asset_urn(kind, key, mixed.get("space")).alias("urn"),
        name.alias("display_name"),
        F.lit(artifact).alias("artifact_type"),
        F.lit(kind).alias("platform"),
        mixed.get("domain", F.lit(SCOPE.domain)).alias("domain"),
        mixed.get("tags", F.array(F.lit(SCOPE.tag))).alias("tags"),
        availability.alias("availability"),
        (owner if owner is not None else F.lit(None).cast("string")).alias("owner"),
        F.lit(adapter).cast("string").alias("adapter"),
        F.from_json(params, "map<string,string>").alias("adapter_parameters"),
        params.alias("parameters_json"),
        _validations(kind).alias("validations"),
        (risk if risk is not None else F.lit("low")).alias("risk"),
        (approval if approval is not None else F.lit(False)).alias("requires_approval"),
    )


def _orders(spark: SparkSession, folder: str, where: Column | None) -> DataFrame:
    orders = table(spark, folder, "orders")
    return orders if where is None else orders.filter(where)


def assets(
    spark: SparkSession, folder: str, mixed: bool = False, orders_where: Column | None = None
) -> DataFrame:
    """All assets; ``mixed`` puts some of them outside the scope in three ways.

    ``orders_where`` gives the catalog as it was for a span of order dates.
    """
    part, supplier = table(spark, folder, "part"), table(spark, folder, "supplier")
    orders, customer = _orders(spark, folder, orders_where), table(spark, folder, "customer")
    nation, region = table(spark, folder, "nation"), table(spark, folder, "region")
    lost = lambda cond: F.when(cond, "unavailable").otherwise("healthy")
    team = lambda name: F.lit(f"urn:li:corpuser:{name}")
    foreign = {"space": F.when(F.col("p_size") == 1, "foreign").otherwise("estate")}
    untagged = {
        "tags": F.when(F.col("s_suppkey") % 9 == 4, F.array().cast("array<string>")).otherwise(
            F.array(F.lit(SCOPE.tag))
        )
    }
    elsewhere = {
        "domain": F.when(F.col("c_mktsegment") == "MACHINERY", "Elsewhere").otherwise(SCOPE.domain)
    }
    frames = [
        _rows("brand", part.select("p_brand").distinct(), F.col("p_brand"),
              lost(F.col("p_brand").isin("Brand#2", "Brand#4"))),
        _rows("part", part, F.col("p_partkey"), lost(F.col("p_size") % 10 == 0),
              owner=team("parts"), mixed=foreign if mixed else None),
        _rows("supplier", supplier, F.col("s_suppkey"), lost(F.col("s_suppkey") % 7 == 0),
              owner=team("supply"), approval=F.col("s_acctbal") < 0, mixed=untagged if mixed else None),
        _rows("order", orders, F.col("o_orderkey"),
              F.when(F.col("o_orderstatus") == "F", "healthy")
              .when(F.col("o_orderstatus") == "O", "unavailable").otherwise("unknown"),
              owner=team("orders"),
              risk=F.when(F.col("o_orderpriority") == "1-URGENT", "high").otherwise("low")),
        _rows("customer", customer, F.col("c_custkey"), F.lit("healthy"),
              owner=team("customers"), mixed=elsewhere if mixed else None),
        _rows("nation", nation, F.col("n_nationkey"), F.lit("healthy")),
        _rows("region", region, F.col("r_regionkey"), F.lit("healthy"), risk=F.lit("medium")),
    ]
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame)
    return out


def edges(spark: SparkSession, folder: str, orders_where: Column | None = None) -> DataFrame:
    part, supplier = table(spark, folder, "part"), table(spark, folder, "supplier")
    orders, customer = _orders(spark, folder, orders_where), table(spark, folder, "customer")
    nation, lines = table(spark, folder, "nation"), table(spark, folder, "lineitem")
    if orders_where is not None:
        lines = lines.join(orders, lines["l_orderkey"] == orders["o_orderkey"], "left_semi")

    def pairs(df: DataFrame, up: str, up_key: str, down: str, down_key: str) -> DataFrame:
        return df.select(
            asset_urn(up, F.col(up_key)).alias("upstream_urn"),
            asset_urn(down, F.col(down_key)).alias("downstream_urn"),
        )

    frames = [
        pairs(part, "brand", "p_brand", "part", "p_partkey"),
        pairs(lines.select("l_partkey", "l_orderkey").distinct(), "part", "l_partkey", "order", "l_orderkey"),
        pairs(lines.select("l_suppkey", "l_orderkey").distinct(), "supplier", "l_suppkey", "order", "l_orderkey"),
        pairs(orders, "order", "o_orderkey", "customer", "o_custkey"),
        pairs(customer, "customer", "c_custkey", "nation", "c_nationkey"),
        pairs(supplier, "supplier", "s_suppkey", "nation", "s_nationkey"),
        pairs(nation, "nation", "n_nationkey", "region", "n_regionkey"),
    ]
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame)
    return with_evidence(out)


def with_evidence(ends: DataFrame) -> DataFrame:
    return ends.withColumn(
        "evidence",
        F.struct(
            F.lit("datahub_mcp").alias("source"), F.lit("get_lineage").alias("tool"),
            "upstream_urn", "downstream_urn",
        ),
    )


def requests(spark: SparkSession, folder: str) -> DataFrame:
    """One incident per nation's poorest supplier and customer, per brand's dearest
    part, per nation and per region, and one per region with an unknown seed."""
    part, supplier = table(spark, folder, "part"), table(spark, folder, "supplier")
    customer, nation = table(spark, folder, "customer"), table(spark, folder, "nation")
    region = table(spark, folder, "region")

    def rows(df: DataFrame, name: Column, kind: str, seeds: Column, depth: Column) -> DataFrame:
        return df.select(
            name.alias("request_id"),
            F.lit(f"{kind}_outage").alias("incident_type"),
            seeds.alias("unavailable_asset_urns"),
            F.lit(None).cast("timestamp").alias("target_recovery_point"),
            depth.cast("int").alias("max_blast_radius_depth"),
            F.lit("conservative").alias("risk_mode"),
            F.lit("duty-officer").alias("requester"),
        )

    poorest_supplier = (
        supplier.groupBy("s_nationkey")
        .agg(F.min(F.struct("s_acctbal", "s_suppkey")).alias("s"))
        .join(F.broadcast(nation), F.col("s_nationkey") == F.col("n_nationkey"))
    )
    poorest_customer = customer.groupBy("c_nationkey").agg(
        F.min(F.struct("c_acctbal", "c_custkey")).alias("c")
    )
    dearest_part = part.groupBy("p_brand").agg(
        F.max(F.struct("p_retailprice", "p_partkey")).alias("p")
    )
    # At most the 25 rows of the nation table.
    nations_of = nation.groupBy("n_regionkey").agg(
        F.collect_list(asset_urn("nation", F.col("n_nationkey"))).alias("seeds")
    )
    label = lambda text, col: F.concat(F.lit(f"{text}-"), F.col(col).cast("string"))
    one = lambda kind, col: F.array(asset_urn(kind, F.col(col)))
    return (
        rows(poorest_supplier, label("supplier", "s_nationkey"), "supplier",
             one("supplier", "s.s_suppkey"), F.col("n_regionkey"))
        .unionByName(rows(poorest_customer, label("customer", "c_nationkey"), "customer",
                          one("customer", "c.c_custkey"), F.lit(10)))
        .unionByName(rows(dearest_part, label("part", "p_brand"), "part", one("part", "p.p_partkey"), F.lit(1)))
        .unionByName(rows(nation, label("nation", "n_nationkey"), "nation", one("nation", "n_nationkey"), F.lit(1)))
        .unionByName(rows(nations_of, label("region", "n_regionkey"), "region", F.col("seeds"), F.lit(2)))
        .unionByName(rows(region, label("ghost", "r_regionkey"), "ghost",
                          F.array(asset_urn("ghost", F.col("r_regionkey"))), F.lit(10)))
    )


class Catalog:
    """The clean catalog of one data folder; what is asked for is written once and shared by the queries."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder
        self._graph: G.LineageGraph | None = None
        self._fingerprint: str | None = None
        self._book: C.PlanBook | None = None

    @cached_property
    def assets(self) -> DataFrame:
        return cut(assets(self.spark, self.folder), "assets")

    @cached_property
    def edges(self) -> DataFrame:
        """Only the ends are stored: the evidence of an edge names them once more."""
        return with_evidence(cut(edges(self.spark, self.folder).select("upstream_urn", "downstream_urn"), "lineage"))

    @property
    def graph(self) -> G.LineageGraph:
        if self._graph is None:
            self._graph = G.build_graph(self.assets, self.edges, stored=True)
        return self._graph

    @property
    def fingerprint(self) -> str:
        if self._fingerprint is None:
            self._fingerprint = identity.graph_digest(self.assets, self.edges, SOURCE).first()[0]
        return self._fingerprint

    @property
    def requests(self) -> DataFrame:
        return requests(self.spark, self.folder)

    @property
    def book(self) -> C.PlanBook:
        if self._book is None:
            self._book = C.compile_plans(
                self.requests, self.assets, self.edges, REGISTRY, SCOPE, self.fingerprint, self.graph
            )
        return self._book


_CATALOGS: dict[tuple[str, str], tuple[tuple, Catalog]] = {}
_SOURCES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")


def catalog(spark: SparkSession, folder: str) -> Catalog:
    """The catalog of a folder, made anew when one of its tables has changed."""
    key = (spark.sparkContext.applicationId, folder)
    state = tuple(_files_state(spark, f"{folder}/{name}.parquet") for name in _SOURCES)
    if key not in _CATALOGS or _CATALOGS[key][0] != state:
        _CATALOGS[key] = state, Catalog(spark, folder)
    return _CATALOGS[key][1]


def forget_catalogs() -> None:
    _CATALOGS.clear()
