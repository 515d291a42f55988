"""The bulk import as queries: every customer sends what they bought as two chunks, one for each of two services."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import imports as I
from ..operators import matching as M
from ..sources import store
from ..sources.derived import run_sql
from .relational import UNLOCKED, ansi

NOW = "2000-01-01 00:00:00"

# Names that exist, names that do not, one that is not folded; links of 700 numbers that names share, some not well formed.
THINGS = """
    SELECT cast(2 * o.o_custkey + l.l_suppkey % 2 AS bigint) AS call, concat('c', cast(o.o_custkey AS {str})) AS user_id,
           CASE WHEN o.o_custkey % 17 = 3 THEN 'nowhere' WHEN l.l_suppkey % 2 = 0 THEN 'imdb' ELSE 'goodreads' END AS service,
           cast(row_number() OVER (PARTITION BY o.o_custkey, l.l_suppkey % 2 ORDER BY l.l_orderkey, l.l_linenumber, l.l_partkey, l.l_suppkey, l.l_extendedprice) AS bigint) AS ord,
           concat(CASE WHEN l.l_linenumber = 6 THEN ' ' ELSE '' END, p.p_name, ' ', lower(p.p_type), CASE WHEN l.l_partkey % 4 = 1 THEN ' again' ELSE '' END) AS id,
           concat(p.p_name, ' ', lower(p.p_type)) AS search_id, CASE l.l_partkey % 2 WHEN 0 THEN 'imdb' ELSE 'wikidata' END AS source,
           concat(CASE WHEN l.l_partkey % 13 = 0 THEN 'x' WHEN l.l_partkey % 2 = 0 THEN 'tt' ELSE 'Q' END, cast(1 + l.l_partkey % 700 AS {str})) AS ref,
           CASE l.l_returnflag WHEN 'A' THEN '1' WHEN 'R' THEN '-1' ELSE CASE WHEN l.l_linenumber < 3 THEN '1' ELSE 'true' END END AS value
    FROM {lineitem} l JOIN {orders} o ON l.l_orderkey = o.o_orderkey JOIN {part} p ON l.l_partkey = p.p_partkey"""
HELD = """
    SELECT id AS item_id, CASE k % 2 WHEN 0 THEN 'imdb' ELSE 'wikidata' END AS source, concat(CASE k % 2 WHEN 0 THEN 'tt' ELSE 'Q' END, cast(1 + (k * 37) % 700 AS {str})) AS ref
    FROM (SELECT id, row_number() OVER (ORDER BY id) AS k FROM {items}) i WHERE k % 3 = 0"""
IMPORTS = """
    SELECT concat('c', cast(c_custkey AS {str})) AS user_id, 'imdb' AS service,
           CASE c_custkey % 5 WHEN 0 THEN TIMESTAMP '1999-12-31 23:00:00' WHEN 1 THEN TIMESTAMP '1999-12-30 12:00:00' ELSE TIMESTAMP '1999-11-01 00:00:00' END AS started_at,
           CASE c_custkey % 5 WHEN 0 THEN 9998 ELSE 40 END AS thumbs
    FROM {customer} WHERE c_custkey % 5 < 3"""
GONE = "SELECT source, ref FROM (VALUES ('imdb', 'tt51'), ('imdb', 'tt101'), ('wikidata', 'Q152')) AS t(source, ref)"
PATTERN = "SELECT source, pattern FROM (VALUES ('imdb', '^tt[0-9]+$'), ('wikidata', '^Q[1-9][0-9]*$')) AS t(source, pattern)"


def imported(spark, sf_dir) -> I.Imported:
    get = lambda text: run_sql(spark, sf_dir, text)
    known = I.Store(
        items=get("SELECT id FROM {items}"), links=get(HELD), thumbs=get("SELECT user_id, item_id, tag, value FROM {thumbs}"), imports=get(IMPORTS),
        removed=get("SELECT id FROM {removed}"), removed_refs=get(GONE), patterns=get(PATTERN),
        services=get("SELECT service FROM (VALUES ('imdb'), ('goodreads')) AS t(service)"), unlocked=get(f"SELECT id AS user_id FROM ({UNLOCKED}) u"),
    )
    return I.import_thumbs(get(THINGS), known, NOW)


def d05_import_counts(spark, sf_dir):
    """What came of every chunk."""
    return imported(spark, sf_dir).counts


def d05_import_links(spark, sf_dir):
    """The links that the batch makes, and whether for a new name."""
    found = imported(spark, sf_dir)
    names = found.names.selectExpr("id AS item_id", "true AS new_name")
    return found.links.join(names, "item_id", "left").selectExpr("item_id", "source", "ref", "created_by", "coalesce(new_name, false) AS new_name")


def d05_import_thumbs(spark, sf_dir):
    return imported(spark, sf_dir).thumbs


def d05_import_state(spark, sf_dir):
    """How far the imports that still count are."""
    return imported(spark, sf_dir).imports.selectExpr("user_id", "service", "date_format(started_at, 'yyyy-MM-dd HH:mm') AS started", "thumbs")


def d14_resolved(spark, sf_dir):
    """What of each customer's film export there is to import, by what the catalog and their own thumbs hold."""
    rows = run_sql(spark, sf_dir, f"SELECT user_id, ord, id, source, ref, cast(value AS int) AS value FROM ({THINGS}) t WHERE service = 'imdb' AND value <> 'true'")
    row = F.struct("source", "ref", "value").alias("row")
    candidates = rows.select(F.col("user_id").alias("search"), F.col("ord").alias("pos"), "source", "ref", F.array("id").alias("names"), row)
    found = M.classify(store.save(candidates, "candidates"), run_sql(spark, sf_dir, "SELECT id FROM {items}"), run_sql(spark, sf_dir, HELD), ("row",))
    told = found.select(F.col("search").alias("user_id"), F.col("pos").alias("ord"), "row.*", "item_id", "kind")
    return I.resolved(told, run_sql(spark, sf_dir, "SELECT user_id, item_id, tag FROM {thumbs}"))


# The check deals with the pairs one by one, in their order, as a recursion that carries what is taken.
_STEPS = """
    calls AS (
        SELECT t.*, i.started_at IS NOT NULL AND i.started_at + INTERVAL 720 HOUR > TIMESTAMP '2000-01-01' AS going, i.started_at, i.thumbs AS before
        FROM (SELECT call, user_id, service, count(*) AS asked FROM things GROUP BY ALL) t
        LEFT JOIN imports i ON i.user_id = t.user_id AND i.service = t.service
    ), standing AS (
        SELECT call, user_id, service, asked, CASE WHEN going THEN before ELSE 0 END AS used, CASE WHEN going THEN started_at ELSE TIMESTAMP '2000-01-01' END AS started_at,
               CASE WHEN user_id NOT IN (SELECT id FROM unlocked) THEN 'locked' WHEN service NOT IN ('imdb', 'goodreads') THEN 'not a service'
                    WHEN asked > 500 THEN 'too many' WHEN going AND started_at + INTERVAL 24 HOUR <= TIMESTAMP '2000-01-01' THEN 'closed' ELSE 'done' END AS status
        FROM calls
    ), firsts AS (
        SELECT t.*, s.used FROM things t JOIN standing s ON s.call = t.call AND s.status = 'done'
        WHERE regexp_matches(ref, CASE source WHEN 'imdb' THEN '^tt[0-9]+$' ELSE '^Q[1-9][0-9]*$' END) AND value IN ('1', '-1') AND id = trim(id)
          AND id NOT IN (SELECT id FROM {removed}) AND (source, ref) NOT IN (SELECT (source, ref) FROM gone)
        QUALIFY row_number() OVER (PARTITION BY t.call, source, ref ORDER BY ord) = 1
    ), valid AS (SELECT *, row_number() OVER (PARTITION BY call ORDER BY ord) > 10000 - used AS over_ FROM firsts),
    free AS (
        SELECT *, row_number() OVER (ORDER BY call, ord) AS k FROM (
            SELECT id, concat(source, ' ', ref) AS link, source, ref, call, ord, user_id FROM valid v WHERE NOT over_
            AND NOT EXISTS (SELECT 1 FROM links h WHERE h.source = v.source AND h.ref = v.ref) AND NOT EXISTS (SELECT 1 FROM links h WHERE h.item_id = v.id)
            QUALIFY row_number() OVER (PARTITION BY id, source, ref ORDER BY call, ord) = 1) f
    ), dealt AS (
        SELECT CAST(0 AS BIGINT) AS k, CAST([] AS VARCHAR[]) AS ids, CAST([] AS VARCHAR[]) AS links, false AS won
        UNION ALL
        SELECT f.k, CASE WHEN f.wins THEN list_append(d_ids, f.id) ELSE d_ids END, CASE WHEN f.wins THEN list_append(d_links, f.link) ELSE d_links END, f.wins
        FROM (SELECT f.*, d.ids AS d_ids, d.links AS d_links, NOT list_contains(d.ids, f.id) AND NOT list_contains(d.links, f.link) AS wins
              FROM dealt d JOIN free f ON f.k = d.k + 1) f
    ), made AS MATERIALIZED (SELECT f.* FROM free f JOIN dealt d ON d.k = f.k AND d.won),
    found AS (
        SELECT v.*, h.item_id, row_number() OVER (PARTITION BY v.user_id, h.item_id ORDER BY v.call, v.ord) = 1
               AND NOT EXISTS (SELECT 1 FROM {thumbs} t WHERE t.user_id = v.user_id AND t.item_id = h.item_id AND t.tag = '') AS saved
        FROM valid v JOIN (SELECT item_id, source, ref, -1 AS since FROM links UNION ALL SELECT id, source, ref, call FROM made) h
        ON h.source = v.source AND h.ref = v.ref AND h.since <= v.call WHERE NOT over_
    )"""


def _check(select: str) -> str:
    told = ", ".join(f"{name} AS MATERIALIZED ({text})" for name, text in (("things", THINGS), ("links", HELD), ("imports", IMPORTS), ("gone", GONE), ("unlocked", UNLOCKED)))
    return ansi(f"SELECT * FROM (WITH RECURSIVE {told}, {_STEPS} {select}) checked")


QUERIES = {f.__name__: f for f in (d05_import_counts, d05_import_links, d05_import_thumbs, d05_import_state, d14_resolved)}
ORACLES = {
    "d05_import_counts": """
        SELECT s.call, s.user_id, s.service, s.status, CASE WHEN done THEN coalesce(saved, 0) END AS saved, CASE WHEN done THEN coalesce(n - saved, 0) END AS kept,
               CASE WHEN done THEN asked - coalesce(n, 0) - coalesce(past, 0) END AS refused, CASE WHEN done THEN coalesce(past, 0) END AS over,
               CASE WHEN done THEN 10000 - used - coalesce(saved, 0) END AS left
        FROM (SELECT *, status = 'done' AS done FROM standing) s
        LEFT JOIN (SELECT call, count(*) AS n, CAST(sum(saved::INT) AS BIGINT) AS saved FROM found GROUP BY call) f ON f.call = s.call
        LEFT JOIN (SELECT call, CAST(sum(over_::INT) AS BIGINT) AS past FROM valid GROUP BY call) v ON v.call = s.call""",
    "d05_import_links": "SELECT id AS item_id, source, ref, user_id AS created_by, id NOT IN (SELECT id FROM {items}) AS new_name FROM made",
    "d05_import_thumbs": "SELECT user_id, item_id, '' AS tag, CAST(value AS INTEGER) AS value FROM found WHERE saved",
    "d05_import_state": """
        SELECT s.user_id, s.service, strftime(started_at, '%Y-%m-%d %H:%M') AS started, used + coalesce(saved, 0) AS thumbs FROM standing s
        LEFT JOIN (SELECT call, CAST(sum(saved::INT) AS BIGINT) AS saved FROM found GROUP BY call) f ON f.call = s.call
        WHERE status = 'done' AND used + coalesce(saved, 0) > 0""",
}
D14 = f"""
    SELECT user_id, ord, item_id, source, ref, value, known FROM (
        SELECT *, row_number() OVER (PARTITION BY user_id, item_id ORDER BY ord) AS k FROM (
            SELECT t.user_id, t.ord, t.source, t.ref, cast(t.value AS int) AS value, coalesce(h.item_id, t.id) AS item_id,
                   h.item_id IS NOT NULL OR i.id IS NOT NULL AS known, h.item_id IS NULL AND i.id IS NOT NULL AND n.item_id IS NOT NULL AS elsewhere
            FROM ({THINGS}) t LEFT JOIN ({HELD}) h ON h.source = t.source AND h.ref = t.ref LEFT JOIN {{items}} i ON i.id = t.id LEFT JOIN ({HELD}) n ON n.item_id = t.id
            WHERE t.service = 'imdb' AND t.value <> 'true') told
        WHERE NOT elsewhere AND NOT EXISTS (SELECT 1 FROM {{thumbs}} o WHERE o.user_id = told.user_id AND o.item_id = told.item_id AND o.tag = '')) r
    WHERE k = 1"""


def queries():
    return QUERIES


def oracle_sql():
    return {name: _check(text) for name, text in ORACLES.items()} | {"d14_resolved": ansi(D14)}
