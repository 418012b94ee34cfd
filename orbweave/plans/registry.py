"""Every query of the engine and the DuckDB SQL that must give the same rows.

Queries read whole tables. Doubles are rounded to six places here (not in the operators), on both sides. Queries without SQL run seeded kernels; tests hold them
against exact enumeration, invariants or brute force.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.materialize import materialize, shared_folder
from ..functions.text import age_days, distinct_words, parse_timestamp
from ..operators import community, graph, ising, network, report, spins, words
from ..sources import files
from ..session import table
from .fixtures import MAX_FOLLOWERS, Fixtures, oracle

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
EPS = 6


def query(sql: str | None = None, *views: str):
    """Registers function(fixtures) under its name, with its SQL."""

    def add(function):
        QUERIES[function.__name__] = lambda spark, sf_dir: function(Fixtures(spark, sf_dir))
        if sql:
            ORACLE_SQL[function.__name__] = oracle(sql, *views)
        return function

    return add


def r(column):
    """Rounded, and without a negative zero."""
    return F.round(column, EPS) + 0.0


# ---- sources ----------------------------------------------------------------------------------------------------------------------------------------

@query("SELECT src, dst FROM (SELECT *, row_number() OVER (PARTITION BY dst ORDER BY src) AS n FROM fx_follow) WHERE n <= 3000", "fx_follow")
def src_followers_cap(x):
    return network.capped(x.fx_follow, "dst", 3000, F.asc("src"))


@query("SELECT src, dst FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY dst) AS n FROM fx_follow) WHERE n <= 500", "fx_follow")
def src_follows_cap(x):
    return network.capped(x.fx_follow, "src", 500, F.asc("dst"))


@query("SELECT count(*) AS n_users, CAST(ceil(count(*) / 25.0) AS BIGINT) AS n_batches FROM fx_profile", "fx_profile")
def src_profile_batches(x):
    return network.batches(x.fx_profile, 25)


def _gexf(x) -> str:
    edges = materialize(graph.without_loops(graph.undirected(x.fx_sparse)))
    nodes = graph.apply_partition(graph.nodes_of(edges), x.fx_profile.select(F.col("handle").alias("node"), F.col("followers_count").alias("cid")))
    return files.write_gexf(f"{_folder(x, 'gexf')}.gexf", nodes, edges)


@query("""WITH v AS (SELECT src AS id FROM fx_sparse WHERE src <> dst UNION SELECT dst FROM fx_sparse WHERE src <> dst)
SELECT CAST(id AS VARCHAR) AS id, CAST(coalesce(followers_count, -1) AS INTEGER) AS community_id FROM v LEFT JOIN fx_profile ON id = handle""", "fx_sparse", "fx_profile")
def gexf_roundtrip_nodes(x):
    return files.read_gexf_nodes(x.spark, _gexf(x))


@query("SELECT DISTINCT CAST(least(src, dst) AS VARCHAR) AS src, CAST(greatest(src, dst) AS VARCHAR) AS dst FROM fx_sparse WHERE src <> dst", "fx_sparse")
def gexf_roundtrip_edges(x):
    return files.read_gexf_edges(x.spark, _gexf(x))


# ---- network expansion ------------------------------------------------------------------------------------------------------------------------------

NET = f"""WITH h1 AS (SELECT f.src, f.dst FROM fx_follow f JOIN fx_core c ON f.dst = c.core LEFT JOIN fx_profile p ON f.src = p.handle WHERE coalesce(p.followers_count, 0) <= {MAX_FOLLOWERS}),
h2a AS (SELECT f.src, f.dst, coalesce(p.followers_count, 0) AS n FROM fx_follow f LEFT JOIN fx_profile p ON f.src = p.handle WHERE f.dst IN (SELECT src FROM h1)),
h2 AS (SELECT src, dst FROM h2a WHERE n <= {MAX_FOLLOWERS}),
known AS (SELECT core AS v FROM fx_core UNION SELECT src FROM h1 UNION SELECT src FROM h2),
x3 AS (SELECT f.src, f.dst FROM fx_follow f WHERE f.src IN (SELECT src FROM h2) AND f.dst IN (SELECT v FROM known) AND f.src <> f.dst) """
NET_VIEWS = ("fx_follow", "fx_core", "fx_profile")


def _hops(x):
    follows, core = x.follows, x.fx_core
    first = network.first_hop(follows, core, x.fx_profile, MAX_FOLLOWERS)
    return follows, core, first, network.second_hop(follows, first, x.fx_profile, MAX_FOLLOWERS)


@query(f"SELECT src, dst FROM fx_follow LEFT JOIN fx_profile ON src = handle WHERE coalesce(followers_count, 0) <= {MAX_FOLLOWERS}", "fx_follow", "fx_profile")
def celebrity_filter(x):
    return network.within_limit(x.fx_follow, x.fx_profile, MAX_FOLLOWERS).where("keep").select("src", "dst")


@query(NET + f"SELECT count(DISTINCT src) FILTER (WHERE n > {MAX_FOLLOWERS}) AS removed_users, count(*) FILTER (WHERE n > {MAX_FOLLOWERS}) AS removed_edges FROM h2a", *NET_VIEWS)
def celebrity_removed(x):
    follows, _, first, _ = _hops(x)
    gone = network.second_hop_judged(follows, first, x.fx_profile, MAX_FOLLOWERS).where("NOT keep")
    return gone.agg(F.countDistinct("src").alias("removed_users"), F.count("*").alias("removed_edges"))


@query(NET + "SELECT src, dst FROM h1", *NET_VIEWS)
def bfs_hop1(x):
    return _hops(x)[2]


@query(NET + "SELECT src, dst FROM h2", *NET_VIEWS)
def bfs_hop2(x):
    return _hops(x)[3]


@query(NET + "SELECT DISTINCT src FROM h2a", *NET_VIEWS)
def bfs_hop2_distinct(x):
    follows, _, first, _ = _hops(x)
    return network.second_hop_judged(follows, first, x.fx_profile, MAX_FOLLOWERS).select("src").distinct()


@query(NET + "SELECT DISTINCT src FROM h2", *NET_VIEWS)
def bfs_hop2_kept(x):
    return _hops(x)[3].select("src").distinct()


@query(NET + "SELECT v FROM known", *NET_VIEWS)
def known_nodes(x):
    _, core, first, second = _hops(x)
    return network.known_users(core, first, second)


@query(NET + "SELECT src, dst FROM x3", *NET_VIEWS)
def cross_edges(x):
    follows, core, first, second = _hops(x)
    return network.cross_links(follows, second, network.known_users(core, first, second))


@query(NET + ", c AS (SELECT src, dst, row_number() OVER (PARTITION BY src ORDER BY dst) AS n FROM fx_follow) SELECT src, dst FROM c WHERE n <= 500 AND src IN (SELECT src FROM h2) AND dst IN (SELECT v FROM known) AND src <> dst", *NET_VIEWS)
def cross_edges_capped(x):
    follows, core, first, second = _hops(x)
    return network.cross_links(follows, second, network.known_users(core, first, second), 500)


ALL = NET + ", a AS (SELECT src, dst, 1 AS hop FROM h1 UNION ALL SELECT src, dst, 2 FROM h2 UNION ALL SELECT src, dst, 3 FROM x3) "


def _collected(x):
    return network.collect_network(x.follows, x.fx_core, x.fx_profile, MAX_FOLLOWERS)


@query(ALL + "SELECT src, dst FROM a", *NET_VIEWS)
def edges_union_all(x):
    return _collected(x).select("src", "dst")


@query(ALL + "SELECT hop, count(*) AS n FROM a GROUP BY hop", *NET_VIEWS)
def edges_by_pass(x):
    return _collected(x).groupBy("hop").agg(F.count("*").alias("n"))


@query(ALL + "SELECT src, dst, hop FROM a", *NET_VIEWS)
def collect_network(x):
    return _collected(x)


# ---- graph ------------------------------------------------------------------------------------------------------------------------------------------

UND = "WITH und AS (SELECT DISTINCT least(src, dst) AS src, greatest(src, dst) AS dst FROM fx_sparse), g AS (SELECT * FROM und WHERE src <> dst), deg AS (SELECT id, count(*) AS degree FROM (SELECT src AS id FROM g UNION ALL SELECT dst FROM g) GROUP BY id) "
PEELS = 24


def _peeling(edges: str) -> str:
    """k-core of 2 as unrolled rounds; tests check that the last rounds agree."""
    parts, last = [], edges
    for i in range(PEELS):
        parts.append(f"k{i} AS MATERIALIZED (SELECT id FROM (SELECT src AS id FROM {last} UNION ALL SELECT dst FROM {last}) GROUP BY id HAVING count(*) >= 2), e{i} AS MATERIALIZED (SELECT src, dst FROM {last} WHERE src IN (SELECT id FROM k{i}) AND dst IN (SELECT id FROM k{i}))")
        last = f"e{i}"
    return ", ".join(parts)


def _simple(x):
    return graph.without_loops(graph.undirected(x.fx_sparse))


@query(UND + "SELECT src, dst FROM und", "fx_sparse")
def graph_undirected(x):
    return graph.undirected(x.fx_sparse)


@query(UND + "SELECT src, dst FROM g", "fx_sparse")
def graph_no_loops(x):
    return _simple(x)


@query(UND + f", {_peeling('g')} SELECT src AS id FROM e{PEELS - 1} UNION SELECT dst FROM e{PEELS - 1}", "fx_sparse")
def kcore2_nodes(x):
    return graph.nodes_of(graph.k_core(_simple(x)))


@query(UND + f", {_peeling('g')} SELECT src, dst FROM e{PEELS - 1}", "fx_sparse")
def kcore2_edges(x):
    return graph.k_core(_simple(x))


METRICS = ", n AS (SELECT count(*) AS n FROM deg), m AS (SELECT count(*) AS m FROM g) SELECT n AS num_nodes, m AS num_edges, round(2.0 * m / (n * (n - 1)), 6) AS density, round(2.0 * m / n, 6) AS avg_degree"


@query(UND + METRICS + " FROM n, m", "fx_sparse")
def graph_metrics(x):
    edges = _simple(x)
    return graph.metrics(graph.nodes_of(edges), edges).withColumns({c: r(c) for c in ("density", "avg_degree")})


@query(UND + "SELECT id, degree FROM deg", "fx_sparse")
def degrees(x):
    return graph.degrees(_simple(x))


@query(UND + "SELECT id, degree FROM deg ORDER BY degree DESC, id LIMIT 5", "fx_sparse")
def top5_degree(x):
    return graph.top_by_degree(_simple(x), 5)


@query(UND + "SELECT src, dst FROM g WHERE src % 2 = 0 AND dst % 2 = 0", "fx_sparse")
def induced_subgraph(x):
    edges = _simple(x)
    return graph.induced(edges, graph.nodes_of(edges).where("id % 2 = 0"))


@query("WITH v AS (SELECT src AS id FROM fx_sparse UNION SELECT dst FROM fx_sparse) SELECT id, CAST(coalesce(followers_count, -1) AS INTEGER) AS community_id FROM v LEFT JOIN fx_profile ON id = handle", "fx_sparse", "fx_profile")
def apply_partition(x):
    return graph.apply_partition(graph.nodes_of(x.fx_sparse), x.fx_profile.select(F.col("handle").alias("node"), F.col("followers_count").alias("cid")))


@query("SELECT src, dst FROM fx_bip JOIN fx_part a ON src = a.node JOIN fx_part b ON dst = b.node WHERE a.cid = 3 AND b.cid = 3", "fx_bip", "fx_part")
def extract_community(x):
    return graph.induced(x.fx_bip, community.members(x.fx_part, 3))


@query(UND + ", t AS (SELECT id FROM deg ORDER BY degree DESC, id LIMIT 1000) SELECT src, dst FROM g WHERE src IN (SELECT id FROM t) AND dst IN (SELECT id FROM t)", "fx_sparse")
def viz_top_hubs(x):
    return graph.hubs(_simple(x), 1000)


@query()
def viz_layout(x):
    edges = [tuple(e) for e in graph.hubs(_simple(x), 1000).collect()]  # a drawing's edges: at most 1000 nodes
    names = sorted({v for e in edges for v in e})
    place = {v: i for i, v in enumerate(names)}
    at = graph.layout([(place[a], place[b]) for a, b in edges], len(names))
    return x.spark.createDataFrame([(v, float(at[i, 0]), float(at[i, 1])) for i, v in enumerate(names)], "id long, x double, y double")


@query(UND + ", n AS (SELECT count(*) AS n FROM deg) SELECT round(greatest(6.0, least(10.0, n / 5.0)), 6) AS fig_size, CAST(greatest(20, least(120, 2000 // n)) AS DOUBLE) AS node_size, CAST(CASE WHEN n < 200 THEN 0.5 ELSE 0.3 END AS DOUBLE) AS edge_alpha FROM n", "fx_sparse")
def viz_style(x):
    style = graph.drawing_style(graph.nodes_of(_simple(x)).count())
    return x.spark.createDataFrame([tuple(style.values())], ", ".join(f"{k} double" for k in style))


# ---- communities ------------------------------------------------------------------------------------------------------------------------------------

def _modularity_sql(edges: str, part: str, tag: str) -> str:
    return f"""m{tag} AS (SELECT count(*) AS m FROM {edges}), d{tag} AS (SELECT v, count(*) AS k FROM (SELECT src AS v FROM {edges} UNION ALL SELECT dst FROM {edges}) GROUP BY v),
kc{tag} AS (SELECT p.cid, sum(k) AS kc FROM d{tag} JOIN {part} p ON v = p.node GROUP BY p.cid),
lc{tag} AS (SELECT a.cid, count(*) AS lc FROM {edges} JOIN {part} a ON src = a.node JOIN {part} b ON dst = b.node WHERE a.cid = b.cid GROUP BY a.cid),
q{tag} AS (SELECT sum(coalesce(CAST(lc AS DOUBLE), 0) / m - power(CAST(kc AS DOUBLE) / (2.0 * m), 2)) AS q FROM kc{tag} k LEFT JOIN lc{tag} l ON k.cid = l.cid CROSS JOIN m{tag})"""


BIP = "WITH inner_e AS (SELECT src, dst FROM fx_bip JOIN fx_part a ON src = a.node JOIN fx_part b ON dst = b.node WHERE a.cid = b.cid), " + _peeling("inner_e") + f", left_v AS (SELECT src AS id FROM e{PEELS - 1} UNION SELECT dst FROM e{PEELS - 1}), core AS (SELECT node, cid FROM fx_part WHERE node IN (SELECT id FROM left_v)), core_e AS (SELECT src, dst FROM fx_bip WHERE src IN (SELECT id FROM left_v) AND dst IN (SELECT id FROM left_v)), " + _modularity_sql("fx_bip", "fx_part", "1") + ", " + _modularity_sql("core_e", "core", "2")
BIP_VIEWS = ("fx_bip", "fx_part")


@query("WITH " + _modularity_sql("fx_bip", "fx_part", "") + " SELECT round(q, 6) AS modularity FROM q", *BIP_VIEWS)
def modularity(x):
    return community.modularity(x.fx_bip, x.fx_part).select(r("modularity").alias("modularity"))


@query(BIP + " SELECT node, cid FROM core", *BIP_VIEWS)
def local_kcore(x):
    return community.local_core(x.fx_bip, x.fx_part)


@query(BIP + " SELECT round(q, 6) AS modularity FROM q2", *BIP_VIEWS)
def modularity_refined(x):
    return community.refined_modularity(x.fx_bip, community.local_core(x.fx_bip, x.fx_part)).select(r("modularity").alias("modularity"))


@query("WITH s AS (SELECT cid, row_number() OVER (ORDER BY count(*) DESC, min(node)) - 1 AS new FROM fx_part GROUP BY cid) SELECT node, CAST(new AS INTEGER) AS cid FROM fx_part p JOIN s ON p.cid = s.cid", "fx_part")
def community_renumber(x):
    return community.renumber(x.fx_part)


@query("SELECT cid, count(*) AS size FROM fx_part GROUP BY cid", "fx_part")
def community_sizes(x):
    return community.sizes(x.fx_part)


@query(BIP + ", z AS (SELECT cid, count(*) AS n FROM core GROUP BY cid) SELECT (SELECT count(*) FROM z) AS num_communities, round((SELECT q FROM q1), 6) AS initial_mod, round(coalesce((SELECT q FROM q2), 0), 6) AS modularity, coalesce((SELECT max(n) FROM z), 0) AS max_size, coalesce((SELECT min(n) FROM z), 0) AS min_size", *BIP_VIEWS)
def resolution_summary(x):
    edges = materialize(x.fx_bip)
    out = community.summary(edges, x.fx_part, materialize(community.local_core(edges, x.fx_part)))
    return out.withColumns({c: r(c) for c in ("initial_mod", "modularity")})


@query()
def leiden_communities(x):
    return community.detect(graph.k_core(_simple(x)))


@query()
def leiden_summary(x):
    edges = graph.k_core(_simple(x))
    found = materialize(community.detect(edges))
    return community.summaries(edges, found)


@query(UND + METRICS + ", 7 AS communities, CAST(0.5 AS DOUBLE) AS modularity, 'seed' AS core FROM n, m", "fx_sparse")
def report_global(x):
    return report.network_row(_simple(x), 7, 0.5, "seed").withColumns({c: r(c) for c in ("density", "avg_degree")})


@query("WITH g AS (SELECT src, dst FROM fx_bip JOIN fx_part a ON src = a.node JOIN fx_part b ON dst = b.node WHERE a.cid = 3 AND b.cid = 3), deg AS (SELECT id, count(*) AS degree FROM (SELECT src AS id FROM g UNION ALL SELECT dst FROM g) GROUP BY id)" + METRICS + " FROM n, m", *BIP_VIEWS)
def report_community(x):
    edges = graph.induced(x.fx_bip, community.members(x.fx_part, 3))
    return graph.metrics(graph.nodes_of(edges), edges).withColumns({c: r(c) for c in ("density", "avg_degree")})


# ---- words ------------------------------------------------------------------------------------------------------------------------------------------

AGE = "(epoch_us(created_at) - 1676592000000000) / 1e6 / 86400"
PW = rf"WITH pw AS (SELECT post_id, user_key, {AGE} AS age, unnest(list_distinct(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]{{2,}}'))) AS word FROM fx_posts WHERE length(text) > 0 AND created_at IS NOT NULL) "


@query("SELECT event_id, epoch_us(ts) AS micros FROM events")
def parse_ts(x):
    text = F.concat(F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("789Z"))
    return table(x.spark, x.sf_dir, "events").select("event_id", F.unix_micros(parse_timestamp(text)).alias("micros"))


@query(f"SELECT post_id, round({AGE}, 6) AS age FROM fx_posts", "fx_posts")
def post_age(x):
    return x.posts.select("post_id", r(age_days(F.col("created_at"))).alias("age"))


@query("SELECT post_id FROM fx_posts WHERE length(text) > 0 AND created_at IS NOT NULL", "fx_posts")
def posts_valid(x):
    return words.valid_posts(x.posts).select("post_id")


@query("SELECT post_id, user_key AS user FROM (SELECT *, row_number() OVER (PARTITION BY user_key ORDER BY created_at DESC, post_id DESC) AS n FROM fx_posts) WHERE n <= 3000", "fx_posts")
def posts_per_user_cap(x):
    return words.newest_posts(x.posts, 3000).select("post_id", "user")


@query(PW + "SELECT p.post_id, count(word) AS n_tokens FROM fx_posts p LEFT JOIN pw ON p.post_id = pw.post_id GROUP BY p.post_id", "fx_posts")
def tokens_per_post(x):
    return x.posts.select("post_id", F.size(distinct_words(F.col("text"))).cast("long").alias("n_tokens"))


@query(PW + 'SELECT post_id, user_key AS "user", word, round(age, 6) AS age FROM pw', "fx_posts")
def word_times(x):
    return words.post_words(x.posts).withColumn("age", r("age"))


@query(PW + ', u AS (SELECT DISTINCT user_id FROM events) SELECT user_id AS "user", count(DISTINCT word) AS n_words FROM u LEFT JOIN pw ON user_id = user_key GROUP BY user_id', "fx_posts")
def user_vocab_size(x):
    users = table(x.spark, x.sf_dir, "events").select(F.col("user_id").alias("user")).distinct()
    return words.vocabulary_sizes(users, words.post_words(x.posts))


@query(PW + "SELECT word, count(*) AS occurrences, round(min(age), 6) AS first_age, round(max(age), 6) AS last_age FROM pw GROUP BY word", "fx_posts")
def global_word_counts(x):
    return words.word_counts(words.post_words(x.posts)).withColumns({c: r(c) for c in ("first_age", "last_age")})


@query(PW + "SELECT count(DISTINCT user_key) AS n_users, count(DISTINCT post_id) AS n_posts, count(DISTINCT word) AS n_words FROM pw", "fx_posts")
def posts_summary(x):
    # One distinct set at a time, each combined map-side.
    w = words.post_words(x.posts)
    n = lambda column, name: w.groupBy(column).agg(F.lit(1)).agg(F.count("*").alias(name))
    return n("user", "n_users").join(F.broadcast(n("post_id", "n_posts"))).join(F.broadcast(n("word", "n_words")))  # one row each


STATS = PW + ", gaps AS (SELECT word, age - lag(age) OVER (PARTITION BY word ORDER BY age) AS gap FROM pw), st AS (SELECT word, count(*) AS occurrences, stddev_pop(gap) AS sd FROM gaps GROUP BY word HAVING count(*) >= 3) "


def _spread(x):
    return words.interval_spread(words.post_words(x.posts))


@query(STATS + "SELECT word, occurrences, round(sd, 6) AS desvio_padrao FROM st", "fx_posts")
def word_interval_std(x):
    return _spread(x).withColumn("desvio_padrao", r("desvio_padrao"))


@query(STATS + "SELECT word, occurrences, round(sd, 6) AS desvio_padrao FROM st WHERE sd BETWEEN 0.2 AND 2 AND occurrences >= 4", "fx_posts")
def keyword_filter(x):
    return words.filter_keywords(_spread(x), 0.2, 2, 4).withColumn("desvio_padrao", r("desvio_padrao"))


@query(STATS + "SELECT word, occurrences, round(sd, 6) AS desvio_padrao, 'comunidade_1' AS source_gexf FROM st WHERE sd BETWEEN 0.2 AND 2 AND occurrences >= 4", "fx_posts")
def keyword_provenance(x):
    return words.with_source(words.filter_keywords(_spread(x), 0.2, 2, 4), "comunidade_1").withColumn("desvio_padrao", r("desvio_padrao"))


def _folder(x, name: str) -> str:
    return f"{shared_folder(x.spark)}/{name}/{uuid.uuid4().hex}"


@query(STATS + "SELECT word, occurrences, round(sd, 6) AS desvio_padrao, 'comunidade_1' AS source_gexf FROM st", "fx_posts")
def keywords_roundtrip(x):
    return files.read_keywords(x.spark, files.write_keywords(_folder(x, "keywords"), words.with_source(_spread(x), "comunidade_1"))).withColumn("desvio_padrao", r("desvio_padrao"))


@query(STATS + ", b AS (SELECT CAST(least(floor((log10(sd) + 1) / (5 / 499.0)), 498) AS INTEGER) AS bin FROM st WHERE sd >= 0.1 AND sd <= 10000) SELECT bin, round(power(10.0, -1 + (bin + 0.5) * (5 / 499.0)), 6) AS center, count(*) AS n, round(count(*) / CAST(sum(count(*)) OVER () AS DOUBLE), 6) AS p FROM b GROUP BY bin", "fx_posts")
def hist_b1(x):
    return words.spread_histogram(_spread(x)).withColumns({c: r(c) for c in ("center", "p")})


# ---- spins ------------------------------------------------------------------------------------------------------------------------------------------

SP = STATS + """, kw AS (SELECT word FROM st WHERE sd BETWEEN 0 AND 10000 AND occurrences >= 1),
us AS (SELECT DISTINCT user_key FROM pw), act AS (SELECT DISTINCT pw.user_key, pw.word FROM pw JOIN kw ON pw.word = kw.word),
sp AS (SELECT us.user_key, kw.word, CASE WHEN act.word IS NULL THEN -1 ELSE 1 END AS spin FROM us CROSS JOIN kw LEFT JOIN act ON act.user_key = us.user_key AND act.word = kw.word) """
COV = "pr AS (SELECT a.user_key AS i, b.user_key AS j, covar_samp(CAST(a.spin AS DOUBLE), CAST(b.spin AS DOUBLE)) AS cov, avg(CAST(a.spin * b.spin AS DOUBLE)) AS m2 FROM sp a JOIN sp b ON a.word = b.word AND a.user_key <= b.user_key GROUP BY a.user_key, b.user_key)"
MASK = "lk AS (SELECT DISTINCT least(src, dst) AS i, greatest(src, dst) AS j FROM fx_follow), mk AS (SELECT pr.i, pr.j, pr.cov, (lk.i IS NOT NULL OR pr.i = pr.j) AS linked FROM pr LEFT JOIN lk ON pr.i = lk.i AND pr.j = lk.j)"


def _users(x):
    return materialize(words.writers(x.posts))


def _spin_words(x):
    """Users, and the keywords (every word whose spread is known: the reference's bounds if none are given) with the users of each."""
    found = words.keyword_users(x.posts)
    return _users(x), materialize(words.filter_keywords(found, 0, 10000, 1).select("word", "users"))


def _spin_parts(x):
    """Users, keywords, and the +1 spins."""
    users, listed = _spin_words(x)
    return users, listed.select("word"), listed.select(F.explode("users").alias("user"), "word")


@query("SELECT min(p_partkey) AS pos, lower(p_type) AS word FROM part GROUP BY lower(p_type)")
def keywords_clean(x):
    return spins.clean_keywords(table(x.spark, x.sf_dir, "part").select(F.col("p_partkey").alias("pos"), F.upper("p_type").alias("word")))


@query(SP + 'SELECT user_key AS "user", word FROM act', "fx_posts")
def spin_active(x):
    return _spin_parts(x)[2]


@query(SP + 'SELECT user_key AS "user", word, CAST(spin AS TINYINT) AS spin FROM sp', "fx_posts")
def spin_long(x):
    users, listed = _spin_words(x)
    return spins.dense(users, listed, listed)


@query(SP + """SELECT user_key AS "user", count(*) AS n, string_agg(CAST(spin AS VARCHAR), ',' ORDER BY word) AS states FROM sp GROUP BY user_key""", "fx_posts")
def spin_wide(x):
    return spins.state_lines(*_spin_words(x)).withColumnRenamed("line", "states")


@query(SP + 'SELECT CAST(user_key AS VARCHAR) AS "user", word, CAST(spin AS TINYINT) AS spin FROM sp', "fx_posts")
def spin_csv_roundtrip(x):
    users, listed = _spin_words(x)
    return files.read_spin_lines(x.spark, files.write_spin_lines(_folder(x, "spins"), listed, spins.state_lines(users, listed)))


@query(PW + ', u AS (SELECT DISTINCT user_id FROM events) SELECT user_id AS "user", count(DISTINCT word) AS n_words FROM u LEFT JOIN pw ON user_id = user_key GROUP BY user_id', "fx_posts")
def cache_roundtrip(x):
    users = table(x.spark, x.sf_dir, "events").select(F.col("user_id").alias("user")).distinct()
    folder = files.write_vocabularies(_folder(x, "vocabularies"), users, words.user_words(words.post_words(x.posts)))
    return words.vocabulary_sizes(*files.read_vocabularies(x.spark, folder))


@query(SP + "SELECT count(DISTINCT word) AS r, count(DISTINCT user_key) AS n FROM sp", "fx_posts")
def spin_shape(x):
    users, keywords, _ = _spin_parts(x)
    return users.agg(F.lit(keywords.count()).cast("long").alias("r"), F.count("*").alias("n"))


@query(SP + 'SELECT user_key AS "user", round(avg(CAST(spin AS DOUBLE)), 6) AS m FROM sp GROUP BY user_key', "fx_posts")
def spin_means(x):
    users, keywords, plus = _spin_parts(x)
    return spins.means(users, plus, keywords.count()).withColumn("m", r("m"))


@query(SP + f", {COV} SELECT i, j, CASE WHEN round(cov, 6) = 0 THEN 0 ELSE round(cov, 6) END AS cov FROM pr", "fx_posts")
def spin_cov(x):
    users, listed = _spin_words(x)
    return spins.covariance(users, listed, listed.count()).withColumn("cov", r("cov"))


@query(SP + f", {COV} SELECT i, j, round(m2, 6) AS m2 FROM pr", "fx_posts")
def spin_pair_moments(x):
    users, listed = _spin_words(x)
    return spins.pair_moments(users, listed, listed.count()).withColumn("m2", r("m2"))


@query(SP + ", v AS (SELECT src AS id FROM fx_follow UNION SELECT dst FROM fx_follow) SELECT count(v.id) AS found, count(*) AS n, count(v.id) * 2 >= count(*) AS enabled FROM us LEFT JOIN v ON us.user_key = v.id", "fx_posts", "fx_follow")
def mask_enabled(x):
    return spins.mask_enabled(_users(x), x.follows)


@query(SP + f", {COV}, {MASK} SELECT i, j, linked FROM mk", "fx_posts", "fx_follow")
def adjacency_mask(x):
    return spins.adjacency(_users(x), x.follows)


def _masked(x):
    users, listed = _spin_words(x)
    return spins.masked_covariance(users, listed, listed.count(), x.follows)


@query(SP + f", {COV}, {MASK} SELECT i, j, CASE WHEN round(CASE WHEN linked THEN cov END, 6) = 0 THEN 0 ELSE round(CASE WHEN linked THEN cov END, 6) END AS cov FROM mk", "fx_posts", "fx_follow")
def cov_masked(x):
    return _masked(x).withColumn("cov", r("cov"))


@query(SP + f', {COV}, {MASK}, l AS (SELECT max(abs(CASE WHEN linked THEN cov END)) AS a FROM mk) SELECT round(CASE WHEN coalesce(a, 0) > 0 THEN a ELSE 1 END, 6) AS "limit", coalesce(a, 0) = 0 AS blank FROM l', "fx_posts", "fx_follow")
def fig2_limits(x):
    users, listed = _spin_words(x)
    return spins.colour_limit(spins.linked_covariance(users, listed, listed.count(), x.follows), "cov").withColumn("limit", r("limit"))


# ---- models -----------------------------------------------------------------------------------------------------------------------------------------

@query("WITH p AS (SELECT i, j, row_number() OVER (ORDER BY i, j) - 1 AS pos FROM range(6) a(i), range(6) b(j) WHERE i < j), u AS (SELECT i, j, (pos - 7) / 4.0 AS v FROM p) SELECT CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j, CAST(v AS DOUBLE) AS value FROM (SELECT i, j, v FROM u UNION ALL SELECT j, i, v FROM u UNION ALL SELECT i, i, 0 FROM range(6) c(i))")
def unpack_j(x):
    flat = x.spark.range(15).select(F.col("id").alias("pos"), ((F.col("id") - 7) / 4.0).alias("value"))
    return ising.unpack_couplings(flat, 6)


@query(SP + ", m AS (SELECT user_key, avg(CAST(spin AS DOUBLE)) AS m FROM sp GROUP BY user_key) SELECT round(sqrt(avg(power(m - tanh((user_key % 7) / 10.0 - 0.9), 2))), 6) AS rmse FROM m", "fx_posts")
def rmse_means(x):
    users, keywords, plus = _spin_parts(x)
    return ising.mean_rmse(spins.means(users, plus, keywords.count()), users.select("user", (F.col("user") % 7 / 10.0 - 0.9).alias("h"))).withColumn("rmse", r("rmse"))


@query(SP + ", c AS (SELECT count(DISTINCT word) AS n FROM sp) SELECT n AS r, round(1 / sqrt(n), 6) AS error, round(3 / sqrt(n), 6) AS \"limit\" FROM c", "fx_posts")
def schneidman(x):
    error, limit = ising.sampling_limit(F.col("r"))
    return spin_shape(x).select("r", r(error).alias("error"), r(limit).alias("limit"))


@query("WITH s AS (SELECT CAST(s_suppkey AS INTEGER) AS ord, abs(s_acctbal) / 10000 AS rmse FROM supplier) SELECT ord, round(rmse, 6) AS rmse FROM s ORDER BY rmse <= 0.2 DESC, CASE WHEN rmse <= 0.2 THEN 0 ELSE rmse END, ord LIMIT 1")
def model_select(x):
    scores = table(x.spark, x.sf_dir, "supplier").select(F.col("s_suppkey").cast("int").alias("ord"), (F.abs("s_acctbal") / 10000).alias("rmse"))
    return ising.select_model(scores, 0.2).withColumn("rmse", r("rmse"))


@query("SELECT i, round(exp(-i / 200.0) * 0.05, 6) AS step FROM range(800) t(i)")
def mch_schedule(x):
    iterations, step, decay, _ = ising.GRID[0]
    return ising.learning_steps(x.spark, iterations, step, decay).withColumn("step", r("step"))


@query("""WITH s AS (SELECT k, CASE WHEN k % 2 = 1 THEN 1 ELSE -1 END AS a, CASE WHEN (k // 2) % 2 = 1 THEN 1 ELSE -1 END AS b, CASE WHEN k // 4 = 1 THEN 1 ELSE -1 END AS c FROM range(8) t(k)),
w AS (SELECT a, b, c, exp(0.2 * a - 0.4 * b + 0.1 * c + 0.3 * a * b - 0.2 * a * c + 0.5 * b * c) AS w FROM s)
SELECT round(sum(w * a) / sum(w), 6) AS m0, round(sum(w * b) / sum(w), 6) AS m1, round(sum(w * c) / sum(w), 6) AS m2 FROM w""")
def exact_ising(x):
    means, _ = ising.exact_moments(np.array([0.2, -0.4, 0.1]), ising.matrix(np.array([0.3, -0.2, 0.5]), 3))
    return x.spark.createDataFrame([tuple(round(float(m), EPS) for m in means)], "m0 double, m1 double, m2 double")


@query()
def ising_pseudo(x):
    return ising.fit_pseudo(spins.state_bits(*_spin_words(x)))


@query()
def ising_mch(x):
    return ising.compare_fits(spins.state_bits(*_spin_words(x))).select("ord", "rmse", "model_rmse", "parameters", "error")


@query()
def ising_comparison(x):
    users, listed = _spin_words(x)
    fits = materialize(ising.compare_fits(spins.state_bits(users, listed)))
    return ising.comparison_table(fits, users.count(), listed.count())


@query()
def metropolis(x):
    return ising.validate(x.spark, [0.2, -0.4, 0.1, 0.3, -0.2, 0.5], 3)
