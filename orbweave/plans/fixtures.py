"""Stand-ins for the engine's inputs over the star-schema tables: one SQL text for Spark and DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.materialize import materialize
from ..session import table

#: Name, SQL and the tables it reads.
VIEWS = {
    "fx_follow": ("SELECT DISTINCT a.l_partkey AS src, b.l_partkey AS dst FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber < b.l_linenumber WHERE a.l_quantity >= 35 AND b.l_quantity >= 35", ["lineitem"]),
    "fx_sparse": ("SELECT DISTINCT a.l_partkey AS src, b.l_partkey AS dst FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber < b.l_linenumber WHERE a.l_quantity >= 45 AND b.l_quantity >= 45", ["lineitem"]),
    "fx_profile": ("SELECT p_partkey AS handle, CAST(p_size AS BIGINT) AS followers_count FROM part WHERE p_partkey % 10 <> 0", ["part"]),
    "fx_core": ("SELECT dst AS core FROM fx_follow GROUP BY dst ORDER BY count(*) DESC, dst LIMIT 1", ["fx_follow"]),
    "fx_bip": ("SELECT DISTINCT o_custkey * 2 AS src, l_suppkey * 2 + 1 AS dst FROM lineitem JOIN orders ON l_orderkey = o_orderkey", ["lineitem", "orders"]),
    "fx_part": ("SELECT c_custkey * 2 AS node, c_nationkey AS cid FROM customer UNION ALL SELECT s_suppkey * 2 + 1 AS node, s_nationkey AS cid FROM supplier", ["customer", "supplier"]),
    "fx_posts": ("SELECT event_id AS post_id, user_id AS user_key, ts AS created_at, text FROM events JOIN documents ON event_id = doc_id", ["events", "documents"]),
}
MAX_FOLLOWERS = 40
#: Events (of more, those with a document) that are broadcast to the texts; of more, both sides are shuffled.
BROADCAST_EVENTS = 1_000_000


class Fixtures:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir, self.made = spark, sf_dir, {}

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("fx_"):
            if name not in self.made:
                sql, needs = VIEWS[name]
                tables = {n: getattr(self, n) if n.startswith("fx_") else table(self.spark, self.sf_dir, n) for n in needs}
                if name == "fx_posts":  # so that texts stay where they are read
                    events = tables["events"].select("event_id", "user_id", "ts")
                    if (n := events.count()) > BROADCAST_EVENTS:
                        events = materialize(events.join(tables["documents"].select(F.col("doc_id").alias("event_id")), "event_id", "left_semi"))
                        n = events.count()
                    tables["events"] = F.broadcast(events) if n <= BROADCAST_EVENTS else events
                for n in tables:
                    sql = " ".join("{" + n + "}" if w == n else w for w in sql.split(" "))
                self.made[name] = self.spark.sql(sql, **tables)
            return self.made[name]
        raise AttributeError(name)

    @property
    def posts(self) -> DataFrame:
        return self.fx_posts.select("post_id", F.col("user_key").alias("user"), F.col("created_at").cast("timestamp").alias("created_at"), "text")

    @property
    def follows(self) -> DataFrame:
        """Read several times by one query, so it is made once."""
        if "kept" not in self.made:
            self.made["kept"] = materialize(self.fx_follow)
            self.made["fx_follow"] = self.made["kept"]
        return self.made["kept"]


def oracle(body: str, *views: str) -> str:
    """A query in DuckDB SQL with the named views before it."""
    wanted: list[str] = []

    def add(name: str) -> None:
        for need in VIEWS[name][1]:
            if need.startswith("fx_"):
                add(need)
        if name not in wanted:
            wanted.append(name)

    for v in views:
        add(v)
    if not wanted:
        return body.strip()
    parts = [f"{v} AS ({VIEWS[v][0]})" for v in wanted]
    body = body.strip()
    recursive = ""
    if body.startswith("WITH RECURSIVE "):
        recursive, parts, body = "RECURSIVE ", [*parts, body[len("WITH RECURSIVE "):]], ""
    elif body.startswith("WITH "):
        parts, body = [*parts, body[len("WITH "):]], ""
    return f"WITH {recursive}{', '.join(parts)} {body}".strip()
