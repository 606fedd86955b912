"""URL rules and link-graph propagation over host edges, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored, table

#: (verdict, host, path)
RULES = (
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
)
DAMPING = 0.85
#: Rounds between two stored states.
STRIDE = 8
#: Propagation stops when STRIDE rounds change all values by less than this in sum; what is still to come is at most 0.4 times as much.
TOLERANCE = 1e-6
#: Damping bounds the rounds until then at about 100; more than this many means that something is wrong.
MOST_ROUNDS = 200
#: A round runs in one task per so many edges, so that a small graph doesn't leave hundreds of small files behind.
EDGES_A_TASK = 200_000
#: A host is blocked when its distrust exceeds this times its trust and this times its share of all pages.
DISTRUST_RATIO = 1.0
_HREF = r"(?i)<a\s[^>]*?href\s*=\s*[\"']?(?:https?:)?//([^/?#\"'\s>]+)"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"://([^/?#]*)([^?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"://([^/?#]*)([^?#]*)", 2), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule that fits, as struct(rule, verdict), or null. `rules` is a list in code; a longer one is matched the same way."""
    listed = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2]))
    first = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, h, p in reversed(listed):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        first = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(first)
    return first


def host_edges(pages: DataFrame) -> DataFrame:
    """src, dst, weight of the links between hosts that `pages` (host, html) show.

    An absolute link leads from the page's host to the host of its href; a relative one stays on the host and is no edge.
    Every host also has an edge of weight 1 to and from the hosts that it is a subdomain of, down to two labels: www.a.b
    and a.b, for instance. Links are counted before they are shuffled.
    """
    links = pages.filter(F.col("html").isNotNull()).select(
        F.col("host").alias("src"),
        F.explode(F.array_distinct(F.transform(F.regexp_extract_all("html", F.lit(_HREF), 1), lambda x: F.translate(x, _UPPER, _LOWER)))).alias("dst"),
    )
    counted = links.filter("src <> '' AND dst <> '' AND src <> dst").groupBy("src", "dst").agg(F.count(F.lit(1)).cast("double").alias("weight"))
    hosts = pages.filter("host <> ''").select("host").distinct()
    above = hosts.select("host", F.split("host", r"\.").alias("l")).select(
        "host", F.explode(F.expr("transform(slice(l, 2, greatest(size(l) - 2, 0)), (x, i) -> array_join(slice(l, i + 2, size(l)), '.'))")).alias("up")
    )
    one = F.lit(1.0).alias("weight")
    return counted.union(above.select(F.col("host").alias("src"), F.col("up").alias("dst"), one)).union(
        above.select(F.col("up").alias("src"), F.col("host").alias("dst"), one)
    ).groupBy("src", "dst").agg(F.sum("weight").alias("weight"))


def propagate(edges: DataFrame, seeds: DataFrame, damping: float = DAMPING, rounds: int = MOST_ROUNDS, tolerance: float = TOLERANCE) -> DataFrame:
    """host, trust, distrust: personalised PageRank, iterated until STRIDE rounds change less than `tolerance` in sum.

    edges: src, dst, weight. seeds: host, trust, distrust, each at least 0. Trust flows along the edges from the trusted
    seeds; distrust flows against them, from the blocked seeds to the hosts that link to them. A host without out-edges
    passes on to the seeds: as this only scales a kind, the loop leaves it out and either kind is scaled to sum to 1 at the
    end. Without seeds of a kind it is 0 everywhere. Both kinds run in one loop, as rows (host, kind, value); each round is one join on (host, kind), in which Spark
    splits a hot host, and one sum per host that is combined before the shuffle. Every eighth round is stored and
    compared with the one stored before. Raises if `rounds` rounds, rounded up to a multiple of eight, are not enough.
    """
    both = edges.select(F.col("src").alias("host"), F.col("dst").alias("to"), "weight", F.lit("trust").alias("kind")).union(
        edges.select(F.col("dst").alias("host"), F.col("src").alias("to"), "weight", F.lit("distrust").alias("kind"))
    )
    out = both.groupBy("host", "kind").agg(F.sum("weight").alias("out"))
    both = stored(both.join(out, ["host", "kind"]).select("host", "kind", "to", (F.col("weight") / F.col("out")).alias("share")))
    tasks = 1 + both.count() // EDGES_A_TASK
    both = stored(both.coalesce(tasks))
    start = seeds.select("host", F.expr("stack(2, 'trust', cast(trust as double), 'distrust', cast(distrust as double)) as (kind, seed)"))
    start = start.filter("seed > 0").groupBy("host", "kind").agg(F.sum("seed").alias("seed"))
    sums = start.groupBy("kind").agg(F.sum("seed").alias("total"))
    start = start.join(F.broadcast(sums), "kind").select("host", "kind", (F.col("seed") / F.col("total")).alias("seed"))
    start = stored(start.coalesce(tasks))
    state = before = start.select("host", "kind", F.col("seed").alias("value"))
    for _ in range(0, rounds, STRIDE):
        for _ in range(STRIDE):
            moved = state.join(both, ["host", "kind"]).select(F.col("to").alias("host"), "kind", (damping * F.col("value") * F.col("share")).alias("value"))
            state = (
                moved.coalesce(tasks).union(start.select("host", "kind", ((1 - damping) * F.col("seed")).alias("value")))
                .groupBy("host", "kind")
                .agg(F.sum("value").alias("value"))
            )
        state = stored(state.coalesce(tasks))
        change = state.union(before.select("host", "kind", -F.col("value"))).groupBy("host", "kind").agg(F.abs(F.sum("value")).alias("d"))
        if (change.agg(F.sum("d")).first()[0] or 0.0) < tolerance:
            break
        before = state
    else:
        raise RuntimeError(f"trust and distrust have not settled after {rounds} rounds")
    whole = state.groupBy("kind").agg(F.sum("value").alias("whole"))
    state = state.join(F.broadcast(whole), "kind").select("host", "kind", (F.col("value") / F.col("whole")).alias("value"))
    return state.groupBy("host").agg(
        F.sum(F.when(F.col("kind") == "trust", F.col("value")).otherwise(0.0)).alias("trust"),
        F.sum(F.when(F.col("kind") == "distrust", F.col("value")).otherwise(0.0)).alias("distrust"),
    )


def url_filter(pages: DataFrame, rules=RULES, id_col: str = "page_id", ratio: float = DISTRUST_RATIO, rounds: int = MOST_ROUNDS) -> DataFrame:
    """One row per input row: page_id, host, path, rule, trust, distrust, verdict.

    A rule that fits decides; the longest wins. Every other page gets its host's verdict: the seeds are the hosts of the
    pages that rules allow (trusted, by their number) and block (distrusted), and a host is blocked when
    distrust > ratio * trust and distrust > ratio * (its share of all pages). Hosts that nothing reaches are allowed. A null url, or one without ://, has an empty host
    and path, fits no rule and is allowed. Null html has no links. Repeated rows count and are returned like any other.
    """
    url = F.col("url").cast("string")
    rows = pages.select(F.col(id_col).alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path"), F.col("html").cast("string").alias("html"))
    rows = rows.withColumn("_rule", rule_of(F.col("host"), F.col("path"), rules))
    counts = rows.filter("host <> ''").groupBy("host").agg(
        F.count_if(F.col("_rule.verdict") == "allow").alias("trust"),
        F.count_if(F.col("_rule.verdict") == "block").alias("distrust"),
        F.count(F.lit(1)).alias("n_pages"),
    )
    counts = stored(counts)
    every = counts.agg(F.sum("n_pages").alias("n")).select("n").scalar()
    flow = propagate(host_edges(rows), counts, rounds=rounds)
    hosts = counts.select("host", (F.col("n_pages") / every).alias("share")).join(flow, "host", "left").na.fill(0.0)
    hosts = hosts.withColumn("bad", (F.col("distrust") > ratio * F.col("trust")) & (F.col("distrust") > ratio * F.col("share")))
    return (
        rows.drop("html")
        .join(hosts, "host", "left")
        .select(
            "page_id",
            "host",
            "path",
            F.col("_rule.rule").alias("rule"),
            F.coalesce("trust", F.lit(0.0)).alias("trust"),
            F.coalesce("distrust", F.lit(0.0)).alias("distrust"),
            F.coalesce(F.col("_rule.verdict"), F.when(F.col("bad"), F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"),
        )
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


#: The same rows by 160 rounds over all hosts.
SQL = r"""
WITH RECURSIVE p AS (
  SELECT page_id, html, translate(regexp_extract(coalesce(url, ''), '://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '://([^/?#]*)([^?#]*)', 2) AS path FROM pages),
r AS (
  SELECT *, CASE WHEN ('.' || host) LIKE '%.example.com' AND starts_with(path, '/en/7') THEN 'example.com/en/7'
                 WHEN ('.' || host) LIKE '%.example.net' AND starts_with(path, '/de/8') THEN 'example.net/de/8'
                 WHEN ('.' || host) LIKE '%.com' AND starts_with(path, '/en/') THEN 'com/en/'
                 WHEN ('.' || host) LIKE '%.net' AND starts_with(path, '/de/') THEN 'net/de/'
                 WHEN ('.' || host) LIKE '%.org' AND starts_with(path, '/es/') THEN 'org/es/' END AS rule FROM p),
hosts AS (SELECT host, count(*) AS n, count(*) FILTER (rule IN ('example.com/en/7', 'net/de/')) AS trust,
                 count(*) FILTER (rule IN ('example.net/de/8', 'com/en/', 'org/es/')) AS distrust FROM r WHERE host <> '' GROUP BY 1),
up AS (SELECT host, array_to_string(list_slice(l, i::INT, len(l)), '.') AS above FROM (SELECT host, string_split(host, '.') AS l FROM hosts), range(2, 50) AS t(i) WHERE i < len(l)),
link AS (SELECT DISTINCT page_id, host AS src, translate(unnest(regexp_extract_all(html, '(?i)<a\s[^>]*?href\s*=\s*["'']?(?:https?:)?//([^/?#"''\s>]+)', 1)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS dst FROM p),
edge AS (SELECT src, dst, sum(w) AS w FROM (SELECT src, dst, 1.0 AS w FROM link WHERE src <> '' AND dst <> '' AND src <> dst
         UNION ALL SELECT host, above, 1.0 FROM up UNION ALL SELECT above, host, 1.0 FROM up) GROUP BY ALL),
both_ways AS (SELECT 'trust' AS kind, src AS host, dst AS dst, w FROM edge UNION ALL SELECT 'distrust', dst, src, w FROM edge),
flow AS (SELECT kind, host, dst, w / sum(w) OVER (PARTITION BY kind, host) AS share FROM both_ways),
seed AS (SELECT kind, host, s / sum(s) OVER (PARTITION BY kind) AS seed FROM (SELECT 'trust' AS kind, host, trust::DOUBLE AS s FROM hosts UNION ALL SELECT 'distrust', host, distrust::DOUBLE FROM hosts) WHERE s > 0),
state AS (
  SELECT 0 AS round, kind, host, seed AS value FROM seed
  UNION ALL
  SELECT any_value(round) + 1, kind, host, sum(value) FROM (
    SELECT s.round, s.kind, f.dst AS host, 0.85 * s.value * f.share AS value FROM state s JOIN flow f ON f.kind = s.kind AND f.host = s.host
    UNION ALL SELECT t.round, seed.kind, seed.host, 0.15 * seed.seed FROM seed, (SELECT DISTINCT round FROM state) t) WHERE round < 160 GROUP BY kind, host),
last AS (SELECT kind, host, value / sum(value) OVER (PARTITION BY kind) AS value FROM state WHERE round = 160),
judged AS (SELECT h.host, coalesce(d.value, 0) > coalesce(t.value, 0) AND coalesce(d.value, 0) > n / (SELECT count(*) FROM p WHERE host <> '') AS bad
           FROM hosts h LEFT JOIN last t ON t.kind = 'trust' AND t.host = h.host LEFT JOIN last d ON d.kind = 'distrust' AND d.host = h.host)
SELECT page_id, r.host, path, rule, CASE WHEN rule IN ('example.com/en/7', 'net/de/') THEN 'allow' WHEN rule IS NOT NULL OR bad THEN 'block' ELSE 'allow' END AS verdict
FROM r LEFT JOIN judged USING (host)
"""
