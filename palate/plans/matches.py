"""Import matching over pages, facts, places and a catalog that are derived from the raw tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import ledger
from ..operators import matching as M
from ..sources import store
from ..sources.derived import run_sql

#: Films looked for: a title and, mostly, a year. Pages have titles of four forms; many titles are shared.
FILMS = """
    SELECT concat(p_name, '/', cast(1950 + p_partkey % 12 AS {str})) AS row, p_name AS title,
           CASE WHEN p_partkey % 7 <> 0 THEN 1950 + p_partkey % 12 END AS year FROM {part} GROUP BY p_name, p_partkey % 12, p_partkey % 7
"""
FILM_PAGES = """
    SELECT title, min(ref) AS ref FROM (
        SELECT CASE p_partkey % 4 WHEN 0 THEN concat(p_name, ' (', cast(1950 + p_partkey % 12 AS {str}), ' film)') WHEN 1 THEN concat(p_name, ' (film)')
                    WHEN 2 THEN p_name ELSE concat(p_name, ' (TV series)') END AS title, p_partkey AS ref FROM {part}) p GROUP BY title
"""
FILM_FACTS = """
    SELECT p_partkey AS ref, CASE p_partkey % 4 WHEN 3 THEN 'series' ELSE CASE WHEN p_partkey % 9 = 0 THEN 'album' ELSE 'film' END END AS role,
           CASE WHEN p_partkey % 5 <> 0 THEN 1950 + p_partkey % 13 END AS first_year FROM {part}
"""


def w07_nearest_film(spark, sf_dir):
    """The page of each film looked for (J-14, F-27, N-14, W-07)."""
    rows, pages, facts = (run_sql(spark, sf_dir, x) for x in (FILMS, FILM_PAGES, FILM_FACTS))
    return M.pick_films(rows.distinct(), pages, facts)


W07 = f"""
    WITH looked AS (SELECT DISTINCT row, title, year FROM ({FILMS}) f), pages AS ({FILM_PAGES}), facts AS ({FILM_FACTS}),
    guesses AS (
        SELECT row, year, 0 AS pos, concat(title, ' (', cast(year AS varchar), ' film)') AS guess FROM looked WHERE year IS NOT NULL
        UNION ALL SELECT row, year, 1, concat(title, ' (film)') FROM looked UNION ALL SELECT row, year, 2, concat(title, ' (miniseries)') FROM looked
        UNION ALL SELECT row, year, 3, concat(title, ' (TV series)') FROM looked UNION ALL SELECT row, year, 4, title FROM looked),
    scored AS (
        SELECT g.row, g.pos, p.ref, CASE WHEN g.year IS NOT NULL AND f.first_year IS NOT NULL THEN abs(f.first_year - g.year) ELSE 1 END AS apart
        FROM guesses g JOIN pages p ON p.title = g.guess JOIN facts f ON f.ref = p.ref
        WHERE f.role = 'film' OR (f.role = 'series' AND g.year IS NOT NULL AND f.first_year IS NOT NULL)),
    best AS (SELECT * FROM (SELECT *, rank() OVER (PARTITION BY row ORDER BY apart) AS k FROM scored WHERE apart <= 1) s WHERE k = 1)
    SELECT row, coalesce(max(CASE WHEN pos = 0 THEN ref END), min(ref)) AS ref FROM best GROUP BY row
    HAVING count(DISTINCT ref) = 1 OR count(CASE WHEN pos = 0 THEN 1 END) > 0"""

BOOKS = """
    SELECT concat(p_name, '|', cast(p_partkey % 40 AS {str})) AS row, CASE p_partkey % 3 WHEN 0 THEN p_name WHEN 1 THEN concat(p_name, ': a tale') ELSE concat(p_name, ', or, the end') END AS title,
           concat('Ann B. Writer', cast(p_partkey % 40 AS {str})) AS author FROM {part}
"""
BOOK_PAGES = """
    SELECT title, min(ref) AS ref FROM (
        SELECT CASE p_partkey % 3 WHEN 0 THEN concat(p_name, ' (novel)') WHEN 1 THEN concat(p_name, ' (Writer', cast(p_partkey % 40 AS {str}), ' novel)') ELSE p_name END AS title,
               p_partkey AS ref FROM {part}) p GROUP BY title
"""
BOOK_FACTS = """
    SELECT p_partkey AS ref, CASE p_partkey % 5 WHEN 0 THEN 'book series' WHEN 1 THEN 'film' WHEN 2 THEN 'essay' ELSE 'book' END AS role,
           CASE WHEN p_partkey % 2 = 0 THEN concat('ann writer', cast(p_partkey % 40 AS {str}), ' jr') ELSE concat('ANN B WRITER', cast(p_partkey % 40 AS {str})) END AS author FROM {part}
"""


def n14_books(spark, sf_dir):
    """The page of each book looked for (J-14, F-27, F-28, F-30, N-14)."""
    rows, pages, facts = (run_sql(spark, sf_dir, x) for x in (BOOKS, BOOK_PAGES, BOOK_FACTS))
    return M.pick_books(rows.distinct(), pages, facts.withColumn("authors", F.array("author")))


N14 = f"""
    WITH looked AS (SELECT DISTINCT row, title, author FROM ({BOOKS}) b), pages AS ({BOOK_PAGES}), facts AS ({BOOK_FACTS}),
    titles AS (
        SELECT row, author, title AS t FROM looked UNION SELECT row, author, split_part(title, ':', 1) FROM looked
        UNION SELECT row, author, split_part(title, ', or,', 1) FROM looked),
    guesses AS (
        SELECT row, author, concat(t, ' (', split_part(author, ' ', 3), ' novel)') AS guess FROM titles UNION SELECT row, author, concat(t, ' (novel)') FROM titles
        UNION SELECT row, author, concat(t, ' (book)') FROM titles UNION SELECT row, author, t FROM titles),
    scored AS (
        SELECT DISTINCT g.row, p.ref, CASE f.role WHEN 'book' THEN 0 WHEN 'book series' THEN 2 ELSE 1 END AS rank
        FROM guesses g JOIN pages p ON p.title = g.guess JOIN facts f ON f.ref = p.ref
        WHERE f.role <> 'film' AND split_part(lower(g.author), 'writer', 2) = replace(split_part(lower(f.author), 'writer', 2), ' jr', '')),
    best AS (SELECT *, min(rank) OVER (PARTITION BY row) AS least FROM scored)
    SELECT row, min(ref) AS ref FROM best WHERE rank = least GROUP BY row HAVING count(DISTINCT ref) = 1"""

#: Places: vectors scattered over a town of about 11 km, names of three words from a short list.
PLACES = """
    SELECT vec_id AS ref, concat(CASE WHEN vec_id % 5 = 0 THEN 'The ' ELSE '' END, 'Inn ', cast(vec_id % 4 AS {str})) AS name,
           60 + x / 20 AS lat, 179.99D + y / 20 - CASE WHEN 179.99D + y / 20 >= 180 THEN 360 ELSE 0 END AS lon FROM {points}
"""


def j16_places(spark, sf_dir):
    """The place of each review: near, and of the same words or the only one that leads (U-08, F-29, N-14)."""
    places = run_sql(spark, sf_dir, PLACES)
    tail = F.when(F.col("ref") % 3 == 0, " Bar and Grill").otherwise("")
    rows = places.select(F.col("ref").alias("row"), F.concat(F.upper("name"), tail).alias("name"), (F.col("lat") + 0.0003).alias("lat"), "lon")
    return M.pick_places(rows, places)


J16 = f"""
    WITH places AS (SELECT *, lower(replace(name, 'The ', '')) AS words FROM ({PLACES}) p),
    near AS (
        SELECT a.ref AS row, a.ref % 3 = 0 AS tailed, b.ref, b.words = a.words AS same,
               2 * 6371000.0D * asin(sqrt(pow(sin(radians(b.lat - a.lat - 0.0003D) / 2), 2)
               + cos(radians(a.lat + 0.0003D)) * cos(radians(b.lat)) * pow(sin(radians(b.lon - a.lon) / 2), 2))) AS apart
        FROM places a JOIN places b ON b.words = a.words AND abs(b.lat - a.lat) < 0.01D)
    SELECT row, coalesce(min(CASE WHEN NOT tailed AND nearest = 1 THEN ref END), min(CASE WHEN tailed AND n = 1 THEN ref END)) AS ref FROM (
        SELECT *, row_number() OVER (PARTITION BY row ORDER BY apart, ref) AS nearest, count(*) OVER (PARTITION BY row) AS n FROM near WHERE apart <= 200) r
    GROUP BY row HAVING max(CASE WHEN NOT tailed OR n = 1 THEN 1 ELSE 0 END) = 1"""

CANDIDATES = """
    SELECT c_nationkey AS search, c_custkey AS pos, 'wiki' AS source, concat('q', cast(c_custkey % 90 AS {str})) AS ref,
           concat('name ', cast(c_custkey % 30 AS {str})) AS first_name, concat('name ', cast(c_custkey % 70 + 30 AS {str})) AS second_name FROM {customer}
"""
NAMES = "SELECT DISTINCT concat('name ', cast(c_custkey % 80 AS {str})) AS id FROM {customer}"
LINKS = """
    SELECT DISTINCT concat('name ', cast(c_custkey % 50 AS {str})) AS item_id, 'wiki' AS source, concat('q', cast(c_custkey % 50 AS {str})) AS ref
    FROM {customer} WHERE c_custkey % 50 < 40
"""


def j13_classified(spark, sf_dir):
    """Candidates of each search as existing, free or plain names of the catalog (W-03)."""
    candidates, names, links = (run_sql(spark, sf_dir, x) for x in (CANDIDATES, NAMES, LINKS))
    return M.classify(candidates.withColumn("names", F.array("first_name", "second_name")), names, links)


J13 = f"""
    WITH c AS ({CANDIDATES}), items AS ({NAMES}), links AS ({LINKS}),
    told AS (
        SELECT c.search, c.pos, l.item_id AS held, c.first_name, c.second_name,
               (SELECT count(*) FROM items i WHERE i.id = c.first_name) AS a, (SELECT count(*) FROM links k WHERE k.item_id = c.first_name) AS al,
               (SELECT count(*) FROM items i WHERE i.id = c.second_name) AS b, (SELECT count(*) FROM links k WHERE k.item_id = c.second_name) AS bl
        FROM c LEFT JOIN links l ON l.source = c.source AND l.ref = c.ref),
    rows AS (
        SELECT search, pos, CASE WHEN held IS NOT NULL THEN held WHEN a = 0 OR al = 0 THEN first_name WHEN b = 0 OR bl = 0 THEN second_name END AS item_id,
               CASE WHEN held IS NOT NULL THEN 'existing' WHEN a = 0 THEN 'free' WHEN al = 0 THEN 'plain' WHEN b = 0 THEN 'free' WHEN bl = 0 THEN 'plain' END AS kind FROM told)
    SELECT search, pos, item_id, kind FROM (SELECT *, row_number() OVER (PARTITION BY search, item_id ORDER BY pos) AS k FROM rows WHERE kind IS NOT NULL) r WHERE k = 1"""


def n13_lookalikes(spark, sf_dir):
    """Names of the catalog that look like others, one letter of another script apart."""
    items = run_sql(spark, sf_dir, "SELECT id FROM {items}")
    typed = items.select(F.translate("id", "aeo", "аео").alias("name"))
    return M.lookalikes(typed, items)


N13 = "SELECT translate(id, 'aeo', 'аео') AS name, min(id) AS id FROM {items} WHERE translate(id, 'aeo', 'аео') <> id GROUP BY translate(id, 'aeo', 'аео')"

N15_ROWS = "SELECT cast(l_orderkey AS bigint) AS row, concat(p_name, ' ', cast(l_quantity AS int)) AS title, concat(lower(p_type), ' ', cast(l_linenumber AS int)) AS label FROM {lineitem} JOIN {part} ON l_partkey = p_partkey"
N15_TITLES = "SELECT concat(p_name, ' ', cast(p_size AS int)) AS question, max(concat('Q', cast(p_partkey AS {str}))) AS answer FROM {part} GROUP BY p_name, p_size"
N15_LABELS = "SELECT concat(lower(p_type), ' ', cast(p_size AS int)) AS question, max(concat('L', cast(p_partkey AS {str}))) AS answer FROM {part} WHERE p_size < 5 GROUP BY lower(p_type), p_size"


def n15_matched(spark, sf_dir):
    """Titles asked of one index, labels of what was missed of another, through a ledger of its own."""
    index = lambda sql: run_sql(spark, sf_dir, sql).select("question", F.array("answer").alias("answers"))
    titles, labels = index(N15_TITLES), index(N15_LABELS)
    book = ledger.Ledger(spark, f"{store.saved_dir(spark)}/ledger-{uuid.uuid4().hex}")
    rows = run_sql(spark, sf_dir, N15_ROWS).distinct()
    found = ledger.match_titles(rows, lambda asked: asked.join(titles, "question"), lambda asked: asked.join(labels, "question"), book, wave=10_000)
    return found.groupBy("row", "stage").agg(F.count("*").alias("n"), F.max(F.col("answers")[0]).alias("answer"))


N15 = f"""
    SELECT r.row, CASE WHEN t.answer IS NULL THEN 'labels' ELSE 'titles' END AS stage, count(*) AS n, max(coalesce(t.answer, l.answer)) AS answer
    FROM (SELECT DISTINCT * FROM ({N15_ROWS}) x) r LEFT JOIN ({N15_TITLES}) t ON t.question = r.title LEFT JOIN ({N15_LABELS}) l ON l.question = r.label
    WHERE coalesce(t.answer, l.answer) IS NOT NULL GROUP BY r.row, CASE WHEN t.answer IS NULL THEN 'labels' ELSE 'titles' END"""

MOVES = """
    SELECT 1 AS step, p_name AS title, concat(upper(substr(p_name, 1, 1)), substr(p_name, 2)) AS target FROM {part} WHERE p_partkey % 2 = 0
    UNION SELECT 2, concat(upper(substr(p_name, 1, 1)), substr(p_name, 2)), concat(p_name, ' (moved)') FROM {part} WHERE p_partkey % 3 = 0
"""


def j20_resolved_titles(spark, sf_dir):
    """Titles as they are spelled on pages, redirects followed."""
    asked, moves = run_sql(spark, sf_dir, "SELECT DISTINCT p_name AS title FROM {part}"), run_sql(spark, sf_dir, MOVES)
    pages = asked.select("title", F.length("title").cast("long").alias("ref")).unionByName(asked.select(F.concat("title", F.lit(" (moved)")).alias("title"), F.lit(0).cast("long").alias("ref")))
    return M.resolved(asked, moves, pages)


J20 = f"""
    WITH asked AS (SELECT DISTINCT p_name AS title FROM {{part}}), moves AS ({MOVES}),
    pages AS (SELECT title, cast(length(title) AS bigint) AS ref FROM asked UNION ALL SELECT concat(title, ' (moved)'), 0 FROM asked)
    SELECT a.title, p.ref FROM asked a LEFT JOIN moves s ON s.step = 1 AND s.title = a.title
    LEFT JOIN moves r ON r.step = 2 AND r.title = coalesce(s.target, a.title) JOIN pages p ON p.title = coalesce(r.target, s.target, a.title)"""

QUERIES = {f.__name__: f for f in (w07_nearest_film, n14_books, j16_places, j13_classified, n13_lookalikes, j20_resolved_titles, n15_matched)}
ORACLES = {
    "w07_nearest_film": W07, "n14_books": N14, "j16_places": J16, "j13_classified": J13, "n13_lookalikes": N13, "j20_resolved_titles": J20,
    "n15_matched": N15,
}


def queries():
    return QUERIES


def oracle_sql():
    from .relational import ansi

    return {name: ansi(sql) for name, sql in ORACLES.items()}
