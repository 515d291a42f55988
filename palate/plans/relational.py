"""Operators that are plain relational algebra, as SQL over the model's tables.

One text per operator; Catalyst plans it in Spark, and the same text is the check against another engine.
"""

from __future__ import annotations

import re
from functools import partial

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import opinions
from ..sources.derived import as_ctes, run_sql, table

SQL: dict[str, str] = {}
WORD_SHARES = 16  # of the accounts that a word may find

# -- what the followed accounts say -------------------------------------------------------------------------
SQL["a01_laplace_mean"] = "SELECT viewer, item_id, tag, n, s, round(m, 9) AS m FROM {said}"
SQL["j01_statements_heard"] = """
    SELECT viewer, count(DISTINCT who) AS accounts, count(*) AS statements, cast(sum(value) AS bigint) AS balance
    FROM {heard} GROUP BY viewer"""
SQL["u03_who_counts"] = """
    SELECT viewer, count(*) AS who FROM (
        SELECT DISTINCT follower_id AS viewer, follower_id AS who FROM {follows}
        UNION SELECT follower_id, followed_id FROM {follows}) w GROUP BY viewer"""
CELLS = """
    SELECT w.viewer, w.who, w.item_id, w.tag, w.value - coalesce(s.m, 0) AS d FROM (
        SELECT viewer, who, item_id, tag, value FROM {heard}
        UNION ALL SELECT v.viewer, t.user_id, t.item_id, t.tag, t.value
        FROM (SELECT DISTINCT follower_id AS viewer FROM {follows}) v JOIN {thumbs} t ON v.viewer = t.user_id
    ) w LEFT JOIN {said} s ON w.viewer = s.viewer AND w.item_id = s.item_id AND w.tag = s.tag"""
SQL["j02_departures"] = f"""
    SELECT viewer, who, count(*) AS cells, round(sum(d), 6) + 0.0 AS departure FROM ({CELLS}) c GROUP BY viewer, who"""
SQL["a02_squared_size"] = f"""
    SELECT viewer, count(*) AS cells, round(sum(d * d), 6) AS size FROM ({CELLS}) c GROUP BY viewer"""
SQL["f15_scores"] = """
    SELECT viewer, item_id, tag, conf, round(score, 9) AS score, round(applies, 9) AS applies FROM {scores}"""
SQL["a16_fold_scores"] = """
    SELECT t.viewer, t.item_id, t.conf, round(t.score, 9) AS score, coalesce(g.tags, 0) AS tags,
           coalesce(round(g.applies, 6), 0.0) AS applies
    FROM (SELECT * FROM {scores} WHERE tag = '') t LEFT JOIN (
        SELECT viewer, item_id, count(*) AS tags, sum(applies) AS applies FROM {scores} WHERE tag <> '' GROUP BY viewer, item_id
    ) g ON t.viewer = g.viewer AND t.item_id = g.item_id"""

# -- nearness of attributes ---------------------------------------------------------------------------------
NEARNESS = """
    WITH v AS (
        SELECT a.item_id, a.tag, (1 + a.m) / 2 AS v, cast(t.n AS double) AS w
        FROM {everyone} a JOIN {everyone} t ON a.item_id = t.item_id AND t.tag = '' AND t.n > 0 WHERE a.tag <> ''
    ), sq AS (SELECT tag, sum(w * v * v) AS q FROM v GROUP BY tag),
    crossed AS (
        SELECT x.tag AS a, y.tag AS b, sum(x.w * x.v * y.v) AS c
        FROM v x JOIN v y ON x.item_id = y.item_id AND x.tag < y.tag GROUP BY x.tag, y.tag
    )
    SELECT c.a, c.b, c.c / (1 + sqrt(p.q * q.q)) AS rho
    FROM crossed c JOIN sq p ON c.a = p.tag JOIN sq q ON c.b = q.tag WHERE c.c <> 0"""
SQL["n07_attribute_nearness"] = f"SELECT a, b, round(rho, 6) AS rho FROM ({NEARNESS}) n"
SQL["w06_related_attributes"] = f"""
    SELECT tag, other, rho, place FROM (
        SELECT tag, other, rho, cast(row_number() OVER (PARTITION BY tag ORDER BY abs(rho) DESC, other) AS bigint) AS place FROM (
            SELECT a AS tag, b AS other, round(rho, 6) AS rho FROM ({NEARNESS}) n
            UNION ALL SELECT b, a, round(rho, 6) FROM ({NEARNESS}) n) both_ways) r
    WHERE place <= 8"""
SQL["j17_tag_pairs"] = """
    SELECT a.tag AS a, b.tag AS b, count(*) AS things FROM (SELECT DISTINCT item_id, tag FROM {thumbs} WHERE tag <> '') a
    JOIN (SELECT DISTINCT item_id, tag FROM {thumbs} WHERE tag <> '') b ON a.item_id = b.item_id AND a.tag < b.tag GROUP BY a.tag, b.tag"""

# -- who may read what --------------------------------------------------------------------------------------
SQL["p04_visible_thumbs"] = """
    SELECT viewer, count(*) AS thumbs FROM (
        SELECT viewer, who, item_id, tag FROM {heard}
        UNION SELECT user_id, user_id, item_id, tag FROM {thumbs}) v GROUP BY viewer"""
SQL["p05_visible_profiles"] = """
    SELECT p.id AS viewer, (SELECT count(*) FROM {profiles} WHERE prefilled) + count(v.seen) AS profiles FROM {profiles} p LEFT JOIN (
        SELECT e.viewer, e.seen FROM (
            SELECT id AS viewer, id AS seen FROM {profiles}
            UNION SELECT follower_id, followed_id FROM {follows}
            UNION SELECT followed_id, follower_id FROM {follows}) e JOIN {profiles} q ON q.id = e.seen AND NOT q.prefilled) v
    ON v.viewer = p.id GROUP BY p.id"""
SQL["p06_visible_edges"] = """
    SELECT viewer, count(*) AS edges FROM (
        SELECT follower_id AS viewer, follower_id, followed_id FROM {follows}
        UNION SELECT followed_id, follower_id, followed_id FROM {follows}) e GROUP BY viewer"""
SQL["p07_without_removed_names"] = """
    SELECT t.user_id, t.item_id, t.tag, t.value FROM {thumbs} t
    WHERE NOT EXISTS (SELECT 1 FROM {removed} r WHERE r.id = t.item_id)
      AND NOT EXISTS (SELECT 1 FROM {removed} r WHERE r.id = t.tag)"""
SQL["p08_refused_writes"] = """
    SELECT t.item_id, count(*) AS refused FROM {thumbs} t JOIN {removed} r ON t.item_id = r.id GROUP BY t.item_id"""
SQL["p10_unlocked"] = """
    SELECT p.id, EXISTS (
        SELECT 1 FROM {follows} f JOIN {profiles} q ON f.followed_id = q.id
        WHERE f.follower_id = p.id AND NOT q.prefilled) AS unlocked FROM {profiles} p"""
SQL["j03_accounts_with_readable_thumbs"] = """
    SELECT f.follower_id, f.followed_id FROM {follows} f WHERE EXISTS (
        SELECT 1 FROM {thumbs} t WHERE t.user_id = f.followed_id AND NOT EXISTS (SELECT 1 FROM {removed} r WHERE r.id = t.item_id))"""
SQL["j04_new_names"] = """
    SELECT DISTINCT t.tag AS name FROM {thumbs} t WHERE t.tag <> '' AND NOT EXISTS (SELECT 1 FROM {items} i WHERE i.id = t.tag)"""
SQL["j08_one_row_modes"] = """
    SELECT a.users, b.things, a.users * b.things AS cells FROM (SELECT count(DISTINCT user_id) AS users FROM {thumbs}) a
    CROSS JOIN (SELECT count(*) AS things FROM {items}) b"""
SQL["j09_edges_with_profiles"] = """
    SELECT f.follower_id, a.display_name AS follower, f.followed_id, b.display_name AS followed, b.handle
    FROM {follows} f JOIN {profiles} a ON f.follower_id = a.id JOIN {profiles} b ON f.followed_id = b.id"""
SQL["j10_link_owner"] = """
    SELECT token, id FROM (SELECT md5(id) AS token, id, row_number() OVER (PARTITION BY md5(id) ORDER BY id) AS k
    FROM {profiles} WHERE NOT prefilled) t WHERE k = 1"""
SQL["j19_agreement"] = """
    SELECT f.follower_id AS a, f.followed_id AS b, count(*) AS shared,
           round(avg(CASE WHEN x.value = y.value THEN 1.0D ELSE 0.0D END), 6) AS agreement
    FROM {follows} f JOIN {thumbs} x ON x.user_id = f.follower_id AND x.tag = ''
    JOIN {thumbs} y ON y.user_id = f.followed_id AND y.item_id = x.item_id AND y.tag = ''
    GROUP BY f.follower_id, f.followed_id"""

# -- lists --------------------------------------------------------------------------------------------------
SQL["p11_hide_rated"] = """
    SELECT s.viewer, s.item_id FROM {scores} s WHERE s.tag = '' AND NOT EXISTS (
        SELECT 1 FROM {thumbs} t WHERE t.user_id = s.viewer AND t.item_id = s.item_id AND t.tag = '')"""
SQL["p12_carried_attributes"] = """
    SELECT viewer, item_id, count(*) AS carried FROM {scores} WHERE tag <> '' AND applies > 0.5 GROUP BY viewer, item_id"""
SQL["p22_rated_things"] = "SELECT user_id, item_id FROM {thumbs} WHERE tag = ''"
SQL["p24_hidden_by_eye"] = """
    SELECT viewer, count(*) AS listed, count(CASE WHEN rated = 0 THEN 1 END) = 0 AS hidden_by_eye FROM (
        SELECT s.viewer, s.item_id, max(CASE WHEN t.user_id IS NULL THEN 0 ELSE 1 END) AS rated
        FROM {scores} s LEFT JOIN {thumbs} t ON t.user_id = s.viewer AND t.item_id = s.item_id AND t.tag = ''
        WHERE s.tag = '' GROUP BY s.viewer, s.item_id) l GROUP BY viewer"""
SQL["o01_empty_query_list"] = """
    SELECT viewer, item_id, cast(row_number() OVER (PARTITION BY viewer
           ORDER BY coalesce(round(score, 9), 0) DESC, coalesce(conf, 0) DESC, item_id) AS bigint) AS place
    FROM {scores} WHERE tag = ''"""
SQL["o03_uncertain_attributes_first"] = """
    SELECT item_id, tag, cast(row_number() OVER (PARTITION BY item_id ORDER BY abs(round(m, 9)) ASC NULLS FIRST, tag) AS bigint) AS place
    FROM {everyone} WHERE tag <> ''"""
SQL["o05_plot_trim"] = """
    SELECT vec_id, own, place FROM (
        SELECT vec_id, own, cast(row_number() OVER (PARTITION BY own ORDER BY len DESC, vec_id) AS bigint) AS place FROM (
            SELECT vec_id, label < 5 AS own, round(sqrt(x * x + y * y + z * z), 9) AS len FROM {points}) p WHERE len > 0) r
    WHERE place <= 600"""
SQL["o06_map_choice"] = """
    SELECT vec_id, own FROM (
        SELECT vec_id, own, row_number() OVER (ORDER BY own DESC, len DESC, vec_id) AS k FROM (
            SELECT * FROM (SELECT vec_id, true AS own, round(sqrt(x * x + y * y + z * z), 9) AS len FROM {points} WHERE label < 5
                           ORDER BY len DESC, vec_id LIMIT 600) a
            UNION ALL SELECT * FROM (SELECT vec_id, false AS own, round(sqrt(x * x + y * y + z * z), 9) AS len FROM {points} WHERE label >= 5
                           ORDER BY len DESC, vec_id LIMIT 600) b) p) r
    WHERE k <= 600"""
SQL["o07_accounts_by_name"] = """
    SELECT id, display_name, cast(row_number() OVER (PARTITION BY nation ORDER BY display_name, id) AS bigint) AS place FROM {profiles}"""
SQL["o11_prefilled_by_handle"] = """
    SELECT handle, item_id, tag, value, cast(row_number() OVER (PARTITION BY handle ORDER BY item_id, tag) AS bigint) AS place
    FROM {profiles} p JOIN {thumbs} t ON p.id = t.user_id WHERE p.prefilled"""
SQL["o04_send_order"] = """
    SELECT t.user_id, t.item_id, cast(row_number() OVER (PARTITION BY t.user_id ORDER BY
        CASE WHEN s.item_id IS NOT NULL THEN 0 WHEN i.id IS NOT NULL THEN 2 ELSE 4 END + CASE WHEN t.value > 0 THEN 1 ELSE 0 END,
        t.item_id) AS bigint) AS place
    FROM {thumbs} t LEFT JOIN {scores} s ON s.viewer = t.user_id AND s.item_id = t.item_id AND s.tag = ''
    LEFT JOIN {items} i ON i.id = t.item_id WHERE t.tag = ''"""
SQL["o10_interleave"] = """
    SELECT nation, id, cast(row_number() OVER (PARTITION BY nation ORDER BY min(k), id) AS bigint) AS place FROM (
        SELECT nation, id, 2 * row_number() OVER (PARTITION BY nation ORDER BY id) AS k FROM {profiles}
        UNION ALL SELECT nation, id, 2 * row_number() OVER (PARTITION BY nation ORDER BY display_name DESC) + 1 FROM {profiles}
    ) l GROUP BY nation, id"""
SQL["o12_bar_attribute"] = """
    SELECT viewer, item_id, tag FROM (
        SELECT viewer, item_id, tag, row_number() OVER (PARTITION BY viewer, item_id ORDER BY round(applies, 9), tag) AS k
        FROM {scores} WHERE tag <> '') t WHERE k = 1"""
SQL["u01_candidates"] = """
    SELECT item_id, count(*) AS viewers FROM (
        SELECT viewer, item_id FROM {said} UNION SELECT user_id, item_id FROM {thumbs}) c GROUP BY item_id"""
SQL["u02_attributes"] = """
    SELECT viewer, count(*) AS attributes FROM (
        SELECT viewer, item_id, tag FROM {said} WHERE tag <> ''
        UNION SELECT user_id, item_id, tag FROM {thumbs} WHERE tag <> '') a GROUP BY viewer"""
SQL["u04_no_longer_followed"] = """
    SELECT f.follower_id AS viewer, f.followed_id AS account FROM {follows} f WHERE NOT EXISTS (
        SELECT 1 FROM {still} k WHERE k.follower_id = f.follower_id AND k.followed_id = f.followed_id)"""
SQL["j11_candidate_rows"] = """
    SELECT coalesce(s.viewer, t.user_id) AS viewer, coalesce(s.item_id, t.item_id) AS item_id,
           round(s.score, 9) AS score, t.value AS own, i.id IS NOT NULL AS in_catalog
    FROM (SELECT * FROM {scores} WHERE tag = '') s
    FULL OUTER JOIN (SELECT * FROM {thumbs} WHERE tag = '') t ON s.viewer = t.user_id AND s.item_id = t.item_id
    LEFT JOIN {items} i ON i.id = coalesce(s.item_id, t.item_id)"""
SQL["j12_attributes_of_a_thing"] = """
    SELECT item_id, count(*) AS attributes, count(CASE WHEN own IS NULL THEN 1 END) AS only_heard FROM (
        SELECT coalesce(s.viewer, t.user_id) AS viewer, coalesce(s.item_id, t.item_id) AS item_id, t.value AS own
        FROM (SELECT * FROM {scores} WHERE tag <> '') s
        FULL OUTER JOIN (SELECT * FROM {thumbs} WHERE tag <> '') t
        ON s.viewer = t.user_id AND s.item_id = t.item_id AND s.tag = t.tag) a GROUP BY item_id"""
SQL["f13_goodness"] = """
    SELECT s.viewer, s.item_id, CASE WHEN t.value = 1 THEN 1.0D WHEN t.value = -1 THEN 0.0D ELSE round((1 + s.score) / 2, 9) END AS goodness
    FROM {scores} s LEFT JOIN {thumbs} t ON t.user_id = s.viewer AND t.item_id = s.item_id AND t.tag = '' WHERE s.tag = ''"""
SQL["f12_bars"] = """
    SELECT item_id, tag, round(fill, 9) AS fill, fill > 0.5 AS accent,
           round(greatest(0.0D, least(1.0D, fill * 4)), 9) AS first_segment, round(greatest(0.0D, least(1.0D, fill * 4 - 3)), 9) AS last_segment
    FROM (SELECT item_id, tag, (greatest(-1.0D, least(1.0D, m)) + 1) / 2 AS fill FROM {everyone}) e"""
SQL["f14_discount"] = "SELECT item_id, tag, round(0.5D + 0.75D * ((1 + m) / 2 - 0.5D), 9) AS contribution FROM {everyone} WHERE tag <> ''"
SQL["f11_typo_budget"] = """
    SELECT id, cast(CASE WHEN length(split_part(id, ' ', 1)) <= 3 THEN 0 WHEN length(split_part(id, ' ', 1)) <= 6 THEN 1 ELSE 2 END AS int) AS budget FROM {items}"""
SQL["p13_catalog_prefix"] = """
    SELECT DISTINCT p.prefix, i.id FROM (SELECT DISTINCT substr(id, 1, 3) AS prefix FROM {items}) p
    JOIN (SELECT id, substr(id, 1, 3) AS start, k FROM (
              SELECT id, row_number() OVER (PARTITION BY substr(id, 1, 3) ORDER BY id) AS k FROM {items}) a
          UNION ALL SELECT id, substr(search_id, 1, 3), k FROM (
              SELECT id, search_id, row_number() OVER (PARTITION BY substr(search_id, 1, 3) ORDER BY id) AS k FROM {items}) b) i
    ON i.start = p.prefix WHERE i.k <= 20"""
SQL["p23_account_fields"] = """
    SELECT id, length(display_name) BETWEEN 1 AND 50 AND trim(display_name) <> '' AS name_ok,
           handle IS NOT NULL AND regexp_like(handle, '^[a-z][a-z0-9]{{0,29}}$') AS handle_ok,
           (handle IS NOT NULL) = prefilled AS handle_iff_prefilled FROM {profiles}"""
SQL["n11_account_search"] = """
    SELECT DISTINCT q.word, p.id FROM (SELECT DISTINCT lower(substr(display_name, 1, 8)) AS word FROM {profiles} UNION SELECT 'h1') q
    JOIN (SELECT id, substr(lower(display_name), 1, step) AS start FROM {profiles} JOIN {steps} ON step <= length(display_name)
          UNION SELECT id, substr(handle, 1, step) FROM {profiles} JOIN {steps} ON step <= length(handle)) p ON p.start = q.word"""
SQL["p02_structural_names"] = """
    SELECT user_id, count(*) AS kept FROM {thumbs} WHERE length(item_id) BETWEEN 1 AND 128 AND length(tag) <= 128
      AND NOT regexp_like(item_id, '[\x01-\x1f]') AND value IN (1, -1) GROUP BY user_id"""

# -- aggregates ---------------------------------------------------------------------------------------------
SQL["a05_nested_thumbs"] = """
    SELECT user_id, count(DISTINCT item_id) AS things, count(*) AS thumbs, min(item_id) AS first_thing, max(item_id) AS last_thing
    FROM {thumbs} GROUP BY user_id"""
SQL["a07_prefilled_tags"] = """
    SELECT handle, tag, uses, cast(row_number() OVER (PARTITION BY handle ORDER BY uses DESC, tag) AS bigint) AS place FROM (
        SELECT p.handle, t.tag, count(*) AS uses FROM {thumbs} t JOIN {profiles} p ON p.id = t.user_id AND p.prefilled
        WHERE t.tag <> '' AND NOT EXISTS (SELECT 1 FROM {removed} r WHERE r.id = t.tag)
          AND NOT EXISTS (SELECT 1 FROM {removed} r WHERE r.id = t.item_id)
        GROUP BY p.handle, t.tag) c"""
SQL["a08_reported_names"] = """
    SELECT item_id, count(*) AS reports, max(ts) AS latest FROM {log} WHERE value = -1 AND tag = '' GROUP BY item_id"""
SQL["a09_duplicates"] = """
    SELECT l_orderkey, l_linenumber, count(*) AS copies FROM {lineitem} GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1"""
SQL["a10_latest_revision"] = """
    SELECT u.user_id, coalesce(max(r.revision), 0) AS revision FROM (SELECT DISTINCT user_id FROM {log}) u
    LEFT JOIN (SELECT * FROM {revisions} WHERE changed = 1) r ON u.user_id = r.user_id GROUP BY u.user_id"""
SQL["a11_tombstone_floor"] = """
    SELECT user_id, greatest(0, max(revision)) AS floor FROM {revisions} WHERE changed = 1 AND value = 0 GROUP BY user_id"""
SQL["a13_stamps"] = """
    SELECT user_id, md5(concat(user_id, ':', cast(max(revision) AS {str}), ':', cast(count(*) AS {str}))) AS stamp FROM {revisions} GROUP BY user_id"""
SQL["a18_import_counts"] = """
    SELECT user_id, count(CASE WHEN known AND k <= 20 THEN 1 END) AS kept, count(CASE WHEN NOT known AND k <= 20 THEN 1 END) AS saved,
           count(CASE WHEN k > 20 THEN 1 END) AS over FROM (
        SELECT t.user_id, r.id IS NOT NULL AS known, row_number() OVER (PARTITION BY t.user_id ORDER BY t.item_id) AS k
        FROM {thumbs} t LEFT JOIN {removed} r ON t.item_id = r.id WHERE t.tag = '') c GROUP BY user_id"""
SQL["a19_plot_spread"] = """
    SELECT label, round(sqrt(avg(x * x)), 6) AS x, round(sqrt(avg(y * y)), 6) AS y, round(sqrt(avg(z * z)), 6) AS z FROM {points} GROUP BY label"""
SQL["a20_reach"] = """
    SELECT label, len FROM (
        SELECT label, round(sqrt(x * x + y * y + z * z), 6) AS len,
               row_number() OVER (PARTITION BY label ORDER BY sqrt(x * x + y * y + z * z)) - 1 AS k, count(*) OVER (PARTITION BY label) AS n
        FROM {points}) p WHERE k = cast(floor(0.99D * n) AS bigint)"""
SQL["a21_fit_to_square"] = """
    SELECT p.label, round(max(abs(p.x - c.x)), 6) AS reach_x, round(max(abs(p.y - c.y)), 6) AS reach_y
    FROM {points} p JOIN (SELECT label, avg(x) AS x, avg(y) AS y FROM {points} GROUP BY label) c ON p.label = c.label GROUP BY p.label"""
FINITE = "forall(embedding, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('infinity'))"
SQL["p18_plot_points"] = f"SELECT vec_id, label FROM {{embeddings}} WHERE size(embedding) >= 1 AND {FINITE}"
SQL["f36_shade"] = """
    SELECT vec_id, round(greatest(0.0D, least(1.0D, (x * 1 + y * 0.5D + z * 0.25D) / 0.45D)), 6) AS shade FROM {points}"""
SQL["n03_gram"] = """
    SELECT label, round(sum(x * x), 6) AS xx, round(sum(x * y), 6) AS xy, round(sum(x * z), 6) AS xz, round(sum(y * y), 6) AS yy,
           round(sum(y * z), 6) AS yz, round(sum(z * z), 6) AS zz FROM {points} GROUP BY label"""

# -- links of names ------------------------------------------------------------------------------------------
LINKS = """
    SELECT p_partkey AS part, concat(p_name, ' ', lower(p_type)) AS item_id,
           CASE p_partkey % 3 WHEN 0 THEN 'imdb' WHEN 1 THEN 'wikidata' ELSE 'osm' END AS source,
           CASE p_partkey % 7 WHEN 0 THEN concat('x', cast(p_partkey AS {str})) ELSE concat(
               CASE p_partkey % 3 WHEN 0 THEN 'tt' WHEN 1 THEN 'Q' ELSE 'N' END, cast(p_partkey AS {str})) END AS ref FROM {part}"""
PATTERNS = """
    SELECT * FROM (VALUES ('imdb', '^tt[0-9]+$', 'https://www.imdb.com/title/'), ('wikidata', '^Q[1-9][0-9]*$', 'https://www.wikidata.org/wiki/'),
        ('osm', '^[NWR][0-9]+$', 'https://www.openstreetmap.org/')) AS t(source, pattern, base)"""

# -- windows, the change log and writes ---------------------------------------------------------------------
SQL["w01_first_per_key"] = """
    SELECT user_id, item_id, event_id FROM (SELECT user_id, item_id, event_id, row_number() OVER (PARTITION BY user_id, item_id ORDER BY event_id) AS k
    FROM {log}) f WHERE k = 1"""
SQL["w02_last_write_wins"] = "SELECT user_id, item_id, tag, value, event_id FROM {held}"
SQL["w04_allowance"] = """
    SELECT event_id, user_id, k > 10 AS over FROM (SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM {log}) a"""
SQL["w05_revisions"] = "SELECT event_id, user_id, revision FROM {revisions} WHERE changed = 1"
SQL["w08_first_row_per_thing"] = """
    SELECT conv_id, role, turn FROM (SELECT conv_id, role, turn, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) AS k
    FROM {conversations}) c WHERE k = 1"""
SQL["t02_changes_since"] = """
    SELECT user_id, item_id, tag, value, revision, CASE WHEN value = 0 THEN 'cleared' ELSE 'thumb' END AS kind FROM (
        SELECT r.user_id, r.item_id, r.tag, r.value, r.revision, half.revision AS since,
               row_number() OVER (PARTITION BY r.user_id, r.item_id, r.tag ORDER BY r.event_id DESC) AS back
        FROM {revisions} r JOIN (SELECT user_id, max(revision) / 2 AS revision FROM {revisions} GROUP BY user_id) half ON r.user_id = half.user_id
        WHERE r.changed = 1) d WHERE back = 1 AND revision > since"""
SQL["t03_full_reads"] = """
    SELECT user_id, asked IS NULL OR asked <= 0 OR asked > latest OR asked < floor AS full_read FROM (
        SELECT l.user_id, l.latest, coalesce(f.floor, 0) AS floor, o.asked
        FROM (SELECT user_id, max(revision) AS latest FROM {revisions} GROUP BY user_id) l
        LEFT JOIN (SELECT user_id, max(revision) AS asked FROM {revisions}
                   WHERE ts < (SELECT max(ts) FROM {events}) - INTERVAL 480 HOUR GROUP BY user_id) o ON o.user_id = l.user_id
        LEFT JOIN (SELECT user_id, max(revision) AS floor FROM {revisions}
                   WHERE changed = 1 AND value = 0 AND ts < (SELECT max(ts) FROM {events}) - INTERVAL 240 HOUR GROUP BY user_id) f
        ON l.user_id = f.user_id) s"""
SQL["t04_apply_changes"] = """
    SELECT user_id, item_id, tag, value FROM (
        SELECT user_id, item_id, tag, value, row_number() OVER (PARTITION BY user_id, item_id, tag ORDER BY event_id DESC) AS back
        FROM {revisions} WHERE changed = 1) r WHERE back = 1 AND value <> 0"""
SQL["t05_followed_stamps"] = """
    SELECT f.follower_id AS viewer, f.followed_id AS account,
           md5(concat(f.follower_id, ':', cast(l.revision AS {str}), ':', cast(coalesce(g.removals, 0) AS {str}))) AS stamp
    FROM {follows} f JOIN (SELECT user_id, max(revision) AS revision FROM {revisions} GROUP BY user_id) l
    ON l.user_id = concat('u', substr(f.followed_id, 2))
    LEFT JOIN (SELECT t.user_id, count(*) AS removals FROM {thumbs} t JOIN {removed} r ON r.id = t.item_id GROUP BY t.user_id) g
    ON g.user_id = f.followed_id"""
SQL["p21_stale_accounts"] = """
    SELECT n.user_id FROM (SELECT user_id, max(revision) AS stamp FROM {revisions} GROUP BY user_id) n
    LEFT JOIN (SELECT user_id, max(revision) AS stamp FROM {revisions}
               WHERE ts < (SELECT max(ts) FROM {events}) - INTERVAL 120 HOUR GROUP BY user_id) o
    ON n.user_id = o.user_id WHERE o.stamp IS NULL OR o.stamp <> n.stamp"""
SQL["t06_affected_viewers"] = """
    SELECT DISTINCT f.follower_id AS viewer FROM {follows} f JOIN {profiles} p ON f.followed_id = p.id AND p.prefilled
    UNION SELECT id FROM {profiles} WHERE prefilled"""
SQL["t07_tombstones"] = """
    SELECT user_id, item_id, tag, event_id FROM (
        SELECT user_id, item_id, tag, value, event_id, changed, row_number() OVER (PARTITION BY user_id, item_id, tag ORDER BY event_id DESC) AS back
        FROM {revisions} WHERE changed = 1) r WHERE back = 1 AND value = 0"""
SQL["t08_expired_tombstones"] = """
    SELECT user_id, count(*) AS expired, max(revision) AS floor FROM (
        SELECT user_id, value, revision, ts, row_number() OVER (PARTITION BY user_id, item_id, tag ORDER BY event_id DESC) AS back
        FROM {revisions} WHERE changed = 1) r
    WHERE back = 1 AND value = 0 AND ts < (SELECT max(ts) FROM {events}) - INTERVAL 240 HOUR GROUP BY user_id"""
SQL["d01_set_thumbs"] = """
    SELECT coalesce(h.user_id, n.user_id) AS user_id, coalesce(h.item_id, n.item_id) AS item_id, coalesce(h.tag, n.tag) AS tag,
           coalesce(n.value, h.value) AS value, CASE WHEN h.user_id IS NULL THEN 'insert' WHEN n.user_id IS NULL THEN 'keep'
           WHEN h.value = n.value THEN 'same' ELSE 'update' END AS action
    FROM (SELECT * FROM {thumbs} WHERE tag = '') h FULL OUTER JOIN (
        SELECT user_id, item_id, '' AS tag, -value AS value FROM {thumbs} WHERE tag <> '' GROUP BY user_id, item_id, value HAVING count(*) >= 4) n
    ON h.user_id = n.user_id AND h.item_id = n.item_id AND h.tag = n.tag"""
SQL["d03_create_items"] = """
    SELECT DISTINCT t.tag AS id, t.tag AS search_id FROM {thumbs} t LEFT JOIN {items} i ON i.id = t.tag WHERE i.id IS NULL AND t.tag <> ''"""
SQL["d06_load_prefilled"] = """
    SELECT coalesce(o.user_id, n.user_id) AS user_id, coalesce(o.item_id, n.item_id) AS item_id,
           CASE WHEN o.user_id IS NULL THEN 'insert' WHEN n.user_id IS NULL THEN 'delete' WHEN o.value <> n.value THEN 'update' ELSE 'keep' END AS action
    FROM (SELECT t.* FROM {thumbs} t JOIN {profiles} p ON p.id = t.user_id AND p.prefilled WHERE t.tag = '') o
    FULL OUTER JOIN (SELECT t.user_id, t.item_id, max(t.value) AS value FROM {thumbs} t JOIN {profiles} p ON p.id = t.user_id AND p.prefilled
        WHERE t.tag <> '' AND NOT EXISTS (SELECT 1 FROM {removed} r WHERE r.id = t.item_id) GROUP BY t.user_id, t.item_id) n
    ON o.user_id = n.user_id AND o.item_id = n.item_id"""
SQL["d07_remove_name"] = """
    SELECT i.id FROM {items} i WHERE NOT EXISTS (SELECT 1 FROM {removed} r WHERE r.id = i.id)"""
SQL["d08_purge"] = """
    SELECT t.user_id, count(*) AS purged FROM {thumbs} t LEFT JOIN {removed} i ON i.id = t.item_id LEFT JOIN {removed} g ON g.id = t.tag
    WHERE i.id IS NOT NULL OR g.id IS NOT NULL GROUP BY t.user_id"""
SQL["d10_write_budget"] = """
    SELECT user_id, cast(day AS {str}) AS day, count(*) AS writes, count(CASE WHEN k > 1024 THEN 1 END) AS refused FROM (
        SELECT user_id, cast(ts AS date) AS day, row_number() OVER (PARTITION BY user_id, cast(ts AS date) ORDER BY event_id) AS k
        FROM {log}) b GROUP BY user_id, b.day"""
SQL["d11_account_deletion"] = """
    SELECT t.user_id, t.item_id, t.tag, t.value FROM {thumbs} t WHERE NOT EXISTS (
        SELECT 1 FROM {profiles} p WHERE p.id = t.user_id AND p.prefilled)"""
SQL["d12_retention"] = """
    SELECT event_type, count(*) AS kept FROM {events} WHERE ts >= (SELECT max(ts) FROM {events}) - INTERVAL 168 HOUR GROUP BY event_type"""
SQL["d15_import_standing"] = """
    SELECT user_id, max(ts) >= (SELECT max(ts) FROM {events}) - INTERVAL 24 HOUR AS open, greatest(0, 10000 - count(*)) AS left_over
    FROM {log} GROUP BY user_id"""
SQL["d16_revoked_links"] = """
    SELECT p.id FROM {profiles} p WHERE NOT p.prefilled AND NOT EXISTS (
        SELECT 1 FROM {still} f JOIN {profiles} q ON q.id = f.followed_id WHERE f.follower_id = p.id AND NOT q.prefilled)"""
UNLOCKED = """
    SELECT p.id FROM {profiles} p WHERE EXISTS (
        SELECT 1 FROM {still} f JOIN {profiles} q ON f.followed_id = q.id WHERE f.follower_id = p.id AND NOT q.prefilled)"""
REQUESTS = """
    SELECT concat('c', cast(c_custkey AS {str})) AS user_id, CASE c_custkey % 3 WHEN 0 THEN 'link' WHEN 1 THEN 'back' ELSE 'prefilled' END AS kind,
           concat('c', cast(CASE c_custkey % 3 WHEN 2 THEN 25 * (c_custkey % 4 + 1) ELSE c_custkey + c_custkey % 5 - 1 END AS {str})) AS target FROM {customer}"""
SQL["d04_follow_requests"] = f"""
    SELECT DISTINCT user_id AS follower_id, target AS followed_id FROM (
        SELECT r.user_id, l.id AS target FROM ({REQUESTS}) r JOIN {{profiles}} l ON md5(l.id) = md5(r.target) AND NOT l.prefilled
        JOIN ({UNLOCKED}) u ON u.id = l.id WHERE r.kind = 'link' AND l.id <> r.user_id
        UNION ALL SELECT r.user_id, r.target FROM ({REQUESTS}) r JOIN {{follows}} f ON f.follower_id = r.target AND f.followed_id = r.user_id
        JOIN ({UNLOCKED}) u ON u.id = r.user_id WHERE r.kind = 'back'
        UNION ALL SELECT r.user_id, r.target FROM ({REQUESTS}) r JOIN {{profiles}} p ON p.id = r.target AND p.prefilled
        JOIN ({UNLOCKED}) u ON u.id = r.user_id WHERE r.kind = 'prefilled') e
    WHERE NOT EXISTS (SELECT 1 FROM {{follows}} g WHERE g.follower_id = e.user_id AND g.followed_id = e.target)"""
SQL["d09_removed_reports"] = f"""
    SELECT r.item_id, r.reports, l.source, l.ref FROM (
        SELECT item_id, count(DISTINCT user_id) AS reports FROM {{thumbs}} WHERE value = -1 AND tag = '' GROUP BY item_id HAVING count(DISTINCT user_id) >= 3) r
    LEFT JOIN (SELECT item_id, source, min(ref) AS ref FROM ({LINKS}) k GROUP BY item_id, source) l ON l.item_id = r.item_id"""
SQL["d13_profile_edits"] = """
    SELECT p.id, coalesce(nullif(trim(e.display_name), ''), p.display_name) AS display_name, e.id IS NOT NULL AS edited FROM {profiles} p
    LEFT JOIN (SELECT concat('c', cast(c_custkey AS {str})) AS id, CASE WHEN c_custkey % 8 = 0 THEN ' ' ELSE concat(c_name, '!') END AS display_name
               FROM {customer} WHERE c_custkey % 4 = 0) e ON e.id = p.id AND NOT p.prefilled"""
SQL["d17_kept_diagnostics"] = """
    SELECT event_id, user_id, event_type FROM {events} WHERE ts > (SELECT max(ts) FROM {events}) - INTERVAL 168 HOUR"""
SQL["d18_held_links"] = f"""
    SELECT h.item_id, min(h.source) AS source FROM ({LINKS}) h JOIN ({PATTERNS}) p ON p.source = h.source AND regexp_like(h.ref, p.pattern)
    WHERE EXISTS (SELECT 1 FROM {{thumbs}} t WHERE t.item_id = h.item_id) AND NOT EXISTS (SELECT 1 FROM {{removed}} r WHERE r.id = h.item_id)
    GROUP BY h.item_id"""
SQL["t10_follow_events"] = "SELECT followed_id AS subscriber, count(*) AS events FROM {follows} GROUP BY followed_id"

# -- imports ------------------------------------------------------------------------------------------------
SQL["f20_f23_thumb_rules"] = """
    SELECT l_orderkey, l_linenumber, stars, CASE WHEN stars >= 7 THEN 1 WHEN stars <= 4 THEN -1 END AS imdb,
           CASE WHEN stars / 2.0D >= 4 THEN 1 WHEN stars / 2.0D <= 2 THEN -1 END AS five_star,
           CASE WHEN stars = 1 THEN -1 WHEN stars IN (2, 3) THEN 1 END AS netflix, count(*) AS n_rows
    FROM (SELECT l_orderkey, l_linenumber, cast(round(l_discount * 100) AS int) AS stars FROM {lineitem}) s
    GROUP BY l_orderkey, l_linenumber, stars"""
SQL["s11_one_cut_per_title"] = """
    SELECT item_id, min(value) AS cut FROM {log} WHERE value <> 0 AND tag = '' GROUP BY item_id, user_id HAVING count(DISTINCT value) = 1"""
SQL["f18_j16_places_near"] = """
    SELECT a.vec_id AS review, b.vec_id AS place,
           round(2 * 6371000.0D * asin(sqrt(pow(sin(radians(b.y - a.y) / 2), 2) + cos(radians(a.y)) * cos(radians(b.y)) * pow(sin(radians(b.x - a.x) / 2), 2))), 3) AS metres
    FROM (SELECT vec_id, x, y, cast(floor(x * 100) AS bigint) AS cx, cast(floor(y * 100) AS bigint) AS cy FROM {points}) a
    JOIN (SELECT p.vec_id, p.x, p.y, cast(floor(p.x * 100) AS bigint) + d.dx AS cx, cast(floor(p.y * 100) AS bigint) + d.dy AS cy FROM {points} p
          CROSS JOIN (SELECT u.r_regionkey - 1 AS dx, w.r_regionkey - 1 AS dy FROM {region} u CROSS JOIN {region} w WHERE u.r_regionkey < 3 AND w.r_regionkey < 3) d) b
    ON a.cx = b.cx AND a.cy = b.cy AND a.vec_id <> b.vec_id
    WHERE 2 * 6371000.0D * asin(sqrt(pow(sin(radians(b.y - a.y) / 2), 2) + cos(radians(a.y)) * cos(radians(b.y)) * pow(sin(radians(b.x - a.x) / 2), 2))) <= 200"""
SQL["f19_round_position"] = "SELECT vec_id, floor(x * 100 + 0.5D) / 100 AS lon, floor(y * 100 + 0.5D) / 100 AS lat FROM {points}"
SQL["p09_j06_link_patterns"] = f"""
    SELECT l.part, l.item_id, l.source, l.ref FROM ({LINKS}) l JOIN ({PATTERNS}) p ON l.source = p.source AND regexp_like(l.ref, p.pattern)"""
SQL["f31_reference_urls"] = f"""
    SELECT l.part, l.ref, CASE WHEN p.base IS NULL THEN NULL WHEN l.source = 'osm' THEN concat(p.base, CASE substr(l.ref, 1, 1) WHEN 'N' THEN 'node/' WHEN 'W' THEN 'way/' ELSE 'relation/' END, substr(l.ref, 2))
           ELSE concat(p.base, l.ref) END AS url
    FROM ({LINKS}) l LEFT JOIN ({PATTERNS}) p ON l.source = p.source AND regexp_like(l.ref, p.pattern)"""
SQL["s21_export_rows"] = """
    SELECT user_id, CASE WHEN substr(item_id, 1, 1) IN ('=', '+', '-', '@') THEN concat('''', item_id) ELSE item_id END AS name, tag AS attribute,
           CASE WHEN value > 0 THEN 'yes' ELSE 'no' END AS rating FROM {thumbs}"""

# -- candidates ---------------------------------------------------------------------------------------------
CLAIMS = """
    SELECT p_partkey AS ref, CASE p_partkey % 2 WHEN 0 THEN 'instance' ELSE 'class' END AS prop, p_size % 6 AS kind,
           CASE p_partkey % 5 WHEN 0 THEN 'deprecated' ELSE 'normal' END AS rank FROM {part}
    UNION ALL SELECT p_partkey, 'occupation', p_size % 9, 'normal' FROM {part} WHERE p_partkey % 3 = 0"""
SQL["p14_p15_rateable_kinds"] = f"""
    SELECT DISTINCT c.ref FROM ({CLAIMS}) c JOIN (
        SELECT * FROM (VALUES ('instance', 1), ('instance', 4), ('class', 2), ('occupation', 7)) AS t(prop, kind)) k
    ON c.prop = k.prop AND c.kind = k.kind WHERE c.rank <> 'deprecated'"""
SQL["p16_rateable_places"] = """
    SELECT vec_id, key, value FROM (SELECT vec_id, CASE vec_id % 4 WHEN 0 THEN 'amenity' WHEN 1 THEN 'shop' WHEN 2 THEN 'highway' ELSE 'tourism' END AS key,
           CASE label WHEN 1 THEN 'bar' WHEN 2 THEN 'bench' WHEN 3 THEN 'museum' ELSE 'other' END AS value FROM {points}) p
    WHERE EXISTS (SELECT 1 FROM (VALUES ('amenity', 'bar'), ('shop', '*'), ('tourism', 'museum')) AS t(k, v) WHERE t.k = p.key AND (t.v = '*' OR t.v = p.value))"""
SQL["p17_good_matches"] = """
    SELECT q.word, i.id FROM (SELECT DISTINCT split_part(id, ' ', 1) AS word, split_part(id, ' ', 2) AS other FROM {items}) q
    JOIN (SELECT id, split_part(id, ' ', n.k) AS part FROM {items} JOIN (SELECT * FROM (VALUES (1), (2), (3), (4), (5)) AS t(k)) n ON true) i
    ON i.part = q.word WHERE q.other <> '' AND concat(' ', i.id, ' ') LIKE concat('% ', q.other, ' %') GROUP BY q.word, i.id"""
SQL["p19_all_finite"] = f"SELECT label, bool_and({FINITE}) AS finite FROM {{embeddings}} GROUP BY label"
SQL["p20_letters_in_order"] = """
    SELECT q.word, i.id FROM (VALUES ('wdgt', '%w%d%g%t%'), ('cdan', '%c%d%a%n%'), ('zzzz', '%z%z%z%z%')) AS q(word, pattern) JOIN {items} i ON lower(i.id) LIKE q.pattern"""
SQL["o08_account_chips"] = """
    SELECT viewer, account, k FROM (
        SELECT f.follower_id AS viewer, f.followed_id AS account, cast(row_number() OVER (PARTITION BY f.follower_id ORDER BY
               CASE WHEN p.display_name LIKE '%7%' THEN 0 ELSE 1 END, p.display_name, p.id) AS bigint) AS k,
               count(CASE WHEN p.display_name LIKE '%7%' THEN 1 END) OVER (PARTITION BY f.follower_id) AS matched
        FROM {follows} f JOIN {profiles} p ON p.id = f.followed_id) c WHERE k <= greatest(3, matched)"""
SQL["o09_shown_candidates"] = """
    SELECT search, source, ref, place FROM (
        SELECT search, source, ref, cast(row_number() OVER (PARTITION BY search ORDER BY CASE WHEN k > share THEN 1 ELSE 0 END, source DESC, k) AS bigint) AS place FROM (
            SELECT p_size AS search, CASE WHEN p_partkey % 3 = 0 THEN 'places' ELSE 'wiki' END AS source, p_partkey AS ref,
                   CASE WHEN p_partkey % 3 = 0 THEN 2 ELSE 3 END AS share,
                   row_number() OVER (PARTITION BY p_size, p_partkey % 3 = 0 ORDER BY p_partkey) AS k FROM {part}) r) s WHERE place <= 5"""
SQL["f34_nearest_rank"] = """
    SELECT vec_id, cast(CASE WHEN x <> x THEN 3 ELSE greatest(1, least(6, floor(x * 10 + 0.5D))) END AS int) AS rank FROM {points}"""
STAMPS = """
    SELECT f.follower_id AS viewer, concat(f.followed_id, ':', cast(l.revision AS {str})) AS stamp FROM {follows} f
    JOIN (SELECT user_id, max(revision) AS revision FROM {revisions} GROUP BY user_id) l ON l.user_id = concat('u', substr(f.followed_id, 2))"""
SQL["a14_stamp_signature"] = f"SELECT viewer, string_agg(stamp, ' ' ORDER BY stamp) AS signature FROM ({STAMPS}) s GROUP BY viewer"

# -- how strong each said attribute is where one word spells it exactly: no search, that is n08_search_feed ------
SQL["attribute_strength"] = """
    SELECT viewer, item_id, tag, round(sqrt((0.5D + 1.0D * (applies - 0.5D)) * ((1 + score) / 2)), 6) AS strength FROM {scores} WHERE tag <> ''"""
SQL["attribute_strength_places"] = """
    SELECT tag, viewer, item_id, place FROM (
        SELECT tag, viewer, item_id, cast(row_number() OVER (PARTITION BY tag, viewer ORDER BY
            round(sqrt((0.5D + 1.0D * (applies - 0.5D)) * ((1 + score) / 2)), 6) DESC, conf DESC NULLS LAST, item_id) AS bigint) AS place
        FROM {scores} WHERE tag <> '') r"""


OF_THINGS = lambda tag: tag == ""


def _on_thumbs(run):
    """A query of thumbs and follows."""
    return lambda spark, sf_dir: run(*(table(spark, sf_dir, n) for n in ("thumbs", "follows")))


def _scored(thumbs: DataFrame, follows: DataFrame, own: opinions.Own | None = None) -> DataFrame:
    return opinions.scored(opinions.opinions(thumbs, follows, own, near=True))


def _scores(thumbs: DataFrame, follows: DataFrame) -> DataFrame:
    return _scored(thumbs, follows).select("viewer", "item_id", "tag", "conf", F.round("score", 9).alias("score"), F.round("applies", 9).alias("applies"))


def _fold_scores(thumbs: DataFrame, follows: DataFrame) -> DataFrame:
    mine, tagged = F.col("tag") == "", F.col("tag") != ""
    found = _scored(thumbs, follows).groupBy("share", "piece", "viewer", "item_id").agg(
        F.max(F.when(mine, F.struct("conf", "score"))).alias("t"),
        F.count(F.when(tagged, 1)).alias("tags"),
        F.coalesce(F.round(F.sum(F.when(tagged, F.col("applies"))), 6), F.lit(0.0)).alias("applies"),
    )
    return found.select("viewer", "item_id", "t.conf", F.round("t.score", 9).alias("score"), "tags", "applies")


def _bar_attribute(thumbs: DataFrame, follows: DataFrame) -> DataFrame:
    least = F.min(F.struct(F.round("applies", 9).alias("applies"), "tag")).alias("x")
    return _scored(thumbs, follows).where("tag <> ''").groupBy("share", "piece", "viewer", "item_id").agg(least).select("viewer", "item_id", "x.tag")


def _carried_attributes(thumbs: DataFrame, follows: DataFrame) -> DataFrame:
    found = _scored(thumbs, follows).where("tag <> '' AND applies > 0.5").groupBy("share", "piece", "viewer", "item_id").agg(F.count("*").alias("carried"))
    return found.select("viewer", "item_id", "carried")


def _hide_rated(thumbs: DataFrame, follows: DataFrame) -> DataFrame:
    return opinions.opinions(thumbs, follows, opinions.Own(OF_THINGS), near=True).where("tag = '' AND heard > 0 AND up + down = 0").select("viewer", "item_id")


def _with_own(found: DataFrame) -> DataFrame:
    """A row for each of a key's own statements, one with null where there is none."""
    return found.select("*", F.explode_outer(opinions.own_values()).alias("own"))


def _goodness(thumbs: DataFrame, follows: DataFrame) -> DataFrame:
    found = _with_own(_scored(thumbs, follows, opinions.Own(OF_THINGS)).where("tag = '' AND heard > 0"))
    goodness = F.when(F.col("own") == 1, 1.0).when(F.col("own") == -1, 0.0).otherwise(F.round((1 + F.col("score")) / 2, 9))
    return found.select("viewer", "item_id", goodness.alias("goodness"))


def _attributes_of_a_thing(thumbs: DataFrame, follows: DataFrame) -> DataFrame:
    found = opinions.opinions(thumbs, follows, opinions.Own(lambda tag: tag != "", everybody=True), near=True).where("tag <> ''")
    found = found.select("item_id", (F.col("up") + F.col("down")).alias("own"))
    return found.groupBy("item_id").agg(F.sum(F.greatest("own", F.lit(1))).alias("attributes"), F.count(F.when(F.col("own") == 0, 1)).alias("only_heard"))


def _candidate_rows(thumbs: DataFrame, follows: DataFrame, items: DataFrame) -> DataFrame:
    found = _with_own(_scored(thumbs, follows, opinions.Own(OF_THINGS, everybody=True)).where("tag = ''"))
    found = found.join(items, found.item_id == items.id, "left")
    return found.select("viewer", "item_id", F.round("score", 9).alias("score"), "own", items.id.isNotNull().alias("in_catalog"))


def _send_order(thumbs: DataFrame, follows: DataFrame, items: DataFrame) -> DataFrame:
    found = _with_own(opinions.opinions(thumbs, follows, opinions.Own(OF_THINGS, everybody=True), near=True).where("tag = '' AND up + down > 0"))
    found = found.join(items, found.item_id == items.id, "left")
    group = F.when(F.col("heard") > 0, 0).when(items.id.isNotNull(), 2).otherwise(4) + F.when(F.col("own") > 0, 1).otherwise(0)
    place = F.row_number().over(Window.partitionBy("viewer").orderBy(group, "item_id")).cast("long").alias("place")
    return found.select(F.col("viewer").alias("user_id"), "item_id", place)


def _strength_places(thumbs: DataFrame, follows: DataFrame) -> DataFrame:
    found = _scored(thumbs, follows).where("tag <> ''")
    strength = F.round(F.sqrt((0.5 + 1.0 * (F.col("applies") - 0.5)) * ((1 + F.col("score")) / 2)), 6)
    order = [strength.desc(), F.col("conf").desc_nulls_last(), F.col("item_id").asc()]

    def placed(some: DataFrame, *keys: str) -> DataFrame:
        return some.select("tag", "viewer", "item_id", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("long").alias("place"))

    # what lies in one piece is ranked where it lies
    return placed(found.where("pieces = 1"), "share", "piece", "tag", "viewer").unionByName(placed(found.where("pieces > 1"), "tag", "viewer"))


def _strength(thumbs: DataFrame, follows: DataFrame) -> DataFrame:
    strength = F.round(F.sqrt((0.5 + 1.0 * (F.col("applies") - 0.5)) * ((1 + F.col("score")) / 2)), 6)
    return _scored(thumbs, follows).where("tag <> ''").select("viewer", "item_id", "tag", strength.alias("strength"))


def _attributes(thumbs: DataFrame, follows: DataFrame) -> DataFrame:
    """Attributes that a viewer hears or gives, each counted where it lies."""
    found = opinions.opinions(thumbs, follows, opinions.Own(lambda tag: tag != "", everybody=True), near=True).where("tag <> ''")
    # a key without a name may come heard and own apart
    keys = found.groupBy("share", "piece", "viewer", "item_id", "tag").agg(F.lit(1).alias("one"))
    # what accounts without a name hear and give may lie in two shares
    nameless = F.count_distinct(F.when(F.col("viewer").isNull(), F.struct("item_id", "tag")))
    return keys.groupBy("viewer").agg(F.when(F.col("viewer").isNull(), nameless).otherwise(F.count("*")).alias("attributes"))


def _candidates(thumbs: DataFrame, follows: DataFrame) -> DataFrame:
    """Who hears or says anything of a thing, each pair counted where it lies: what is said of it does not travel."""
    things = thumbs.select("user_id", "item_id", F.lit("").alias("tag"), F.lit(1).alias("value")).distinct()
    found = opinions.opinions(things, follows, opinions.Own(everybody=True), near=True)
    pairs = found.groupBy("share", "piece", "viewer", "item_id").agg(F.lit(1).alias("one"))
    # accounts without a name are one, in whatever shares they lie
    nameless = F.max(F.when(F.col("viewer").isNull(), 1).otherwise(0))
    return pairs.groupBy("item_id").agg((F.count("viewer") + nameless).alias("viewers"))


def _hidden_by_eye(thumbs: DataFrame, follows: DataFrame) -> DataFrame:
    found = opinions.opinions(thumbs, follows, opinions.Own(OF_THINGS), near=True).where("tag = '' AND heard > 0")
    return found.groupBy("viewer").agg(F.count("*").alias("listed"), (F.count(F.when(F.col("up") + F.col("down") == 0, 1)) == 0).alias("hidden_by_eye"))


def _with_items(run):
    return lambda spark, sf_dir: run(*(table(spark, sf_dir, n) for n in ("thumbs", "follows", "items")))


def _account_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Starts that no word equals stay where they are; a word that finds very many accounts is dealt over shares of them."""
    profiles = table(spark, sf_dir, "profiles")
    words = profiles.select(F.lower(F.substring("display_name", 1, 8)).alias("word")).distinct().unionByName(spark.range(1).select(F.lit("h1").alias("word"))).distinct()
    lengths = words.select(F.length("word").alias("step")).distinct()
    steps = table(spark, sf_dir, "steps").select("step").distinct().join(lengths, "step", "left_semi")
    texts = profiles.select("id", F.explode(F.array(F.lower("display_name"), "handle")).alias("text")).where("text IS NOT NULL")
    starts = texts.join(F.broadcast(steps), F.col("step") <= F.length("text")).select("id", F.expr("substr(text, 1, step)").alias("start"))
    share = F.pmod(F.xxhash64("id"), F.lit(WORD_SHARES)).alias("share")
    dealt = words.select("word", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(WORD_SHARES - 1).cast("long"))).alias("share"))
    starts = starts.select("id", "start", share)
    return starts.join(dealt, (starts.start == dealt.word) & (starts.share == dealt.share)).select("word", "id").distinct()


def _stamp_signature(spark: SparkSession, sf_dir: str) -> DataFrame:
    signature = F.array_join(F.array_sort(F.collect_list("stamp")), " ")  # one stamp for each account followed
    return run_sql(spark, sf_dir, STAMPS).groupBy("viewer").agg(signature.alias("signature"))


#: Spark's own way to some of the results; their SQL is the check alone.
BUILT = {
    "attribute_strength": _on_thumbs(_strength),
    "attribute_strength_places": _on_thumbs(_strength_places),
    "a02_squared_size": _on_thumbs(opinions.squared_size),
    "a14_stamp_signature": _stamp_signature,
    "a16_fold_scores": _on_thumbs(_fold_scores),
    "f15_scores": _on_thumbs(_scores),
    "f13_goodness": _on_thumbs(_goodness),
    "n11_account_search": _account_search,
    "j02_departures": _on_thumbs(opinions.departures),
    "j19_agreement": _on_thumbs(opinions.agreement),
    "j11_candidate_rows": _with_items(_candidate_rows),
    "j12_attributes_of_a_thing": _on_thumbs(_attributes_of_a_thing),
    "o04_send_order": _with_items(_send_order),
    "o12_bar_attribute": _on_thumbs(_bar_attribute),
    "p04_visible_thumbs": _on_thumbs(opinions.visible),
    "p11_hide_rated": _on_thumbs(_hide_rated),
    "p12_carried_attributes": _on_thumbs(_carried_attributes),
    "p24_hidden_by_eye": _on_thumbs(_hidden_by_eye),
    "u01_candidates": _on_thumbs(_candidates),
    "u02_attributes": _on_thumbs(_attributes),
}


def _run(name: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    return BUILT[name](spark, sf_dir) if name in BUILT else run_sql(spark, sf_dir, SQL[name])


def queries():
    return {name: partial(_run, name) for name in SQL}


def ansi(text: str) -> str:
    """Spark's spellings as the other engine spells them."""
    out = as_ctes(text).replace("regexp_like(", "regexp_matches(").replace("{{", "{").replace("}}", "}").replace("\\\\", "\\")
    return re.sub(r"\b(\d+(?:\.\d+)?)D\b", r"cast(\1 AS double)", out)


#: What checks some results in other words than Spark's own.
CHECKS = {
    # one look at the thumbs of prefilled accounts instead of two
    "d06_load_prefilled": """
        SELECT user_id, item_id, CASE WHEN old IS NULL THEN 'insert' WHEN new IS NULL THEN 'delete' WHEN old <> new THEN 'update' ELSE 'keep' END AS action
        FROM (SELECT t.user_id, t.item_id, max(CASE WHEN t.tag = '' THEN t.value END) AS old,
                     max(CASE WHEN t.tag <> '' AND length(t.item_id) % 7 <> 0 THEN t.value END) AS new
              FROM {thumbs} t JOIN {profiles} p ON p.id = t.user_id WHERE p.prefilled GROUP BY t.user_id, t.item_id) told
        WHERE old IS NOT NULL OR new IS NOT NULL""",
    "d08_purge": """
        SELECT user_id, count(*) AS purged FROM {thumbs} WHERE item_id IN (SELECT id FROM {removed}) OR tag IN (SELECT id FROM {removed}) GROUP BY user_id""",
    "p18_plot_points": """
        SELECT vec_id, label FROM {embeddings} WHERE len(embedding) >= 1 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)""",
    "p19_all_finite": """
        SELECT label, bool_and(len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)) AS finite FROM {embeddings} GROUP BY label""",
}


def oracle_sql():
    return {name: ansi(CHECKS.get(name, text)) for name, text in SQL.items()}
