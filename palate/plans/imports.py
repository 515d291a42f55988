"""Import readers over export files that are written from the raw tables: one file of each service a customer.

The files are written by Spark and read back by the readers; the SQL of each query never sees a file, it states the
ratings that the rows behind it stand for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import opinions
from ..sources import exports as X
from ..sources import snapshots as Z
from ..sources.derived import run_sql, table

BASE = """
    SELECT concat('c', cast(o.o_custkey AS {str})) AS export, o.o_custkey AS cust, l.l_orderkey AS k, l.l_linenumber AS n,
           p.p_partkey AS part, p.p_name AS name, p.p_brand AS brand, cast(l.l_quantity AS int) AS q,
           cast(round(l.l_discount * 100) AS int) AS d
    FROM {lineitem} l JOIN {orders} o ON l.l_orderkey = o.o_orderkey JOIN {part} p ON l.l_partkey = p.p_partkey
"""
#: What the files hold, as expressions that both engines read.
TITLE = "concat(name, ', \"', brand, '\"')"
YEAR = "CASE WHEN part % 11 <> 0 THEN 1950 + part % 70 END"
TEN = "CASE WHEN q % 12 >= 7 THEN 1 WHEN q % 12 <= 4 THEN -1 ELSE 0 END"
KEY, ORDER = ["export", "cust"], ["k", "n"]


def base(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_sql(spark, sf_dir, BASE)


def csv_files(rows: DataFrame, path: str, columns: dict[str, Column | str], header: Column | None = None) -> DataFrame:
    """(export, path, text): a CSV file for each export, rows in the order of ``ORDER``."""
    cells = [F.coalesce((F.expr(c) if isinstance(c, str) else c).cast("string"), F.lit("")) for c in columns.values()]
    quoted = F.transform(F.array(*cells), lambda c: F.when(c.rlike(r'[",\r\n]'), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(c))
    line = F.struct(*ORDER, F.array_join(quoted, ",").alias("line"))
    lines = F.transform(F.sort_array(F.collect_list(line)), lambda r: r["line"])
    first = F.lit(",".join(columns)) if header is None else header
    text = F.concat(F.lit("﻿"), first, F.lit("\r\n"), F.array_join(lines, "\r\n"))
    return rows.groupBy(*KEY).agg(lines.alias("lines"), text.alias("text")).select("export", F.lit(path).alias("path"), "text")


def read(files: DataFrame) -> DataFrame:
    return X.cells(files).where("line > 0")


def imdb_files(rows: DataFrame) -> DataFrame:
    header = F.concat(F.lit("Const,"), F.when(F.col("cust") % 2 == 0, "You rated").otherwise("Your Rating"), F.lit(",Title,Title Type,Year"))
    columns = {
        "const": "concat(CASE WHEN part % 13 = 0 THEN 'nm' ELSE 'tt' END, part)",
        "rating": "q % 12",
        "title": TITLE,
        "type": "CASE k % 9 WHEN 0 THEN 'TV Episode' WHEN 1 THEN 'tvEpisode' ELSE 'Movie' END",
        "year": YEAR,
    }
    return csv_files(rows, "ratings.csv", columns, header)


def s06_imdb(spark, sf_dir):
    found = X.read_imdb(read(imdb_files(base(spark, sf_dir))))
    return found.select("export", "kind", "ref", "title", "year", "value")


S06 = f"""
    SELECT export, 'imdb' AS kind, concat('tt', part) AS ref, {TITLE} AS title, cast({YEAR} AS bigint) AS year,
           CASE WHEN k % 9 < 2 THEN 0 ELSE {TEN} END AS value
    FROM ({BASE}) b WHERE part % 13 <> 0 AND q % 12 >= 1"""


def film_files(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    film = {"Date": "'2024-01-01'", "Name": TITLE, "Year": YEAR, "Letterboxd URI": "concat('u', part)"}
    likes = csv_files(rows.where("d % 4 = 0"), "likes/films.csv", film)
    return csv_files(rows.where("d % 3 <> 0"), "ratings.csv", film | {"Rating": "(q % 12) / 2"}), likes


def s07_letterboxd(spark, sf_dir):
    found = X.read_letterboxd(*map(read, film_files(base(spark, sf_dir))))
    return found.groupBy("export", "title", "year", "value").agg(F.count("*").alias("n_rows"))


S07 = f"""
    WITH b AS ({BASE}),
    rated AS (SELECT export, part, {TITLE} AS title, {YEAR} AS year, q % 12 AS half FROM b WHERE d % 3 <> 0 AND q % 12 BETWEEN 1 AND 10),
    liked AS (SELECT export, part, {TITLE} AS title, {YEAR} AS year FROM b WHERE d % 4 = 0),
    every AS (
        SELECT r.export, r.title, r.year, CASE WHEN half >= 8 THEN 1 WHEN half <= 4 THEN -1
               WHEN EXISTS (SELECT 1 FROM liked l WHERE l.export = r.export AND l.part = r.part) THEN 1 ELSE 0 END AS value FROM rated r
        UNION ALL SELECT l.export, l.title, l.year, 1 FROM liked l
        WHERE NOT EXISTS (SELECT 1 FROM rated r WHERE r.export = l.export AND r.part = l.part))
    SELECT export, title, cast(year AS bigint) AS year, value, count(*) AS n_rows FROM every GROUP BY export, title, year, value"""


def s08_goodreads(spark, sf_dir):
    """Titles with the series in the last bracket, in an inner one, or none (F-24)."""
    title = f"CASE k % 3 WHEN 0 THEN concat({TITLE}, ' (Saga, #', n, '-', q, ')') WHEN 1 THEN concat({TITLE}, ' (Saga #', n, ') again') ELSE {TITLE} END"
    columns = {"Book Id": "part", "Title": title, "Author": "concat('A.   ', brand)", "My Rating": "q % 6", "Exclusive Shelf": "'read'"}
    found = X.read_goodreads(read(csv_files(base(spark, sf_dir), "goodreads.csv", columns)))
    return found.select("export", "title", "author", "value")


FIVE = "CASE WHEN q % 6 >= 4 THEN 1 WHEN q % 6 <= 2 THEN -1 ELSE 0 END"
S08 = f"""
    SELECT export, CASE WHEN k % 3 = 1 THEN concat({TITLE}, ' (Saga #', n, ') again') ELSE {TITLE} END AS title,
           concat('A. ', brand) AS author, {FIVE} AS value FROM ({BASE}) b WHERE q % 6 >= 1"""


def s09_storygraph(spark, sf_dir):
    columns = {"Title": TITLE, "Authors": "concat(brand, ', Some Body')", "ISBN/UID": "part", "Star Rating": "CASE WHEN q % 5 > 0 THEN cast(q / 8.0 AS decimal(6, 3)) END"}
    found = X.read_storygraph(read(csv_files(base(spark, sf_dir), "storygraph.csv", columns)))
    return found.select("export", "title", "author", "value")


S09 = f"""
    SELECT export, {TITLE} AS title, brand AS author, CASE WHEN q >= 32 THEN 1 WHEN q <= 16 THEN -1 ELSE 0 END AS value
    FROM ({BASE}) b WHERE q % 5 > 0 AND q BETWEEN 1 AND 40"""


def netflix_files(rows: DataFrame) -> DataFrame:
    columns = {
        "Profile Name": "concat('p', (k + n) % 3)",
        "Title Name": "concat(name, '  ', brand)",
        "Rating Type": "CASE WHEN n % 2 = 0 THEN 'thumb' ELSE 'star' END",
        "Thumbs Value": "q % 4",
        "Star Value": "q % 7 - 1",
    }
    return csv_files(rows, "CONTENT_INTERACTION/Ratings.csv", columns)


NETFLIX = f"""
    SELECT export, concat('p', (k + n) % 3) AS profile, concat(name, ' ', brand) AS title, k, n,
           CASE WHEN n % 2 = 0 THEN CASE q % 4 WHEN 1 THEN -1 ELSE 1 END
                ELSE CASE WHEN q % 7 - 1 >= 4 THEN 1 WHEN q % 7 - 1 <= 2 THEN -1 ELSE 0 END END AS cut
    FROM ({BASE}) b WHERE CASE WHEN n % 2 = 0 THEN q % 4 > 0 ELSE q % 7 - 1 BETWEEN 1 AND 5 END"""


def s10_netflix_profiles(spark, sf_dir):
    found = X.netflix_profiles(X.netflix_log(read(netflix_files(base(spark, sf_dir)))))
    return found.select("export", "profile", F.col("place").cast("long").alias("place"))


S10 = f"""
    SELECT export, profile, cast(row_number() OVER (PARTITION BY export ORDER BY k, n) AS bigint) AS place FROM (
        SELECT export, profile, k, n, row_number() OVER (PARTITION BY export, profile ORDER BY k, n) AS nth FROM ({NETFLIX}) l) f WHERE nth = 1"""


def s11_netflix_chosen(spark, sf_dir):
    log = X.netflix_log(read(netflix_files(base(spark, sf_dir))))
    chosen = log.where("profile in ('p0', 'p1')").select("export", "profile")
    return X.read_netflix(log, chosen).select("export", "title", "value")


S11 = f"""
    SELECT export, title, coalesce(CASE WHEN min(nullif(cut, 0)) = max(nullif(cut, 0)) THEN min(nullif(cut, 0)) END, 0) AS value
    FROM ({NETFLIX}) l WHERE profile IN ('p0', 'p1') GROUP BY export, title"""


def json_files(rows: DataFrame, path: str, entry: str, around: tuple[str, str]) -> DataFrame:
    """(export, path, text): a JSON file for each export, whose entries are the SQL text ``entry``."""
    line = F.struct(*ORDER, F.expr(entry).alias("line"))
    body = F.array_join(F.transform(F.sort_array(F.collect_list(line)), lambda r: r["line"]), ",\n")
    return rows.groupBy(*KEY).agg(F.concat(F.lit(around[0]), body, F.lit(around[1])).alias("text")).select("export", F.lit(path).alias("path"), "text")


LON, LAT = "(part % 340 - 170 + 0.5D)", "(part % 160 - 80 + 0.25D)"
REVIEW = f"""CASE WHEN n % 2 = 0
    THEN to_json(named_struct('geometry', named_struct('coordinates', array(CASE WHEN part % 17 = 0 THEN 0D ELSE {LON} END, CASE WHEN part % 17 = 0 THEN 0D ELSE {LAT} END)),
         'properties', named_struct('date', concat('2024-01-', 10 + d), 'five_star_rating_published', q % 7, 'location', named_struct('name', concat(' ', name)))))
    ELSE to_json(named_struct('properties', map_from_arrays(array('Published', 'Star Rating', 'Location'), array(parse_json(concat('"2024-01-', 10 + d, '"')),
         parse_json(concat('"', q % 7, '"')), parse_json(concat('{{"Business Name": "', name, '", "Geo Coordinates": {{"Latitude": ', {LAT}, ', "Longitude": "', {LON}, '"}}}}')))))) END"""


def maps_files(rows: DataFrame) -> DataFrame:
    return json_files(rows, "Takeout/Maps (your places)/Reviews.json", REVIEW, ('{"type": "FeatureCollection", "features": [', "]}"))


def s12_maps(spark, sf_dir):
    found = X.read_maps(X.recognised(maps_files(base(spark, sf_dir))).where("is = 'google-maps'"))
    return found.select("export", "title", "lat", "lon", "value")


S12 = f"""
    SELECT export, name AS title, {LAT} AS lat, {LON} AS lon, CASE WHEN q % 7 >= 4 THEN 1 WHEN q % 7 <= 2 THEN -1 ELSE 0 END AS value
    FROM ({BASE}) b WHERE q % 7 BETWEEN 1 AND 5 AND NOT (n % 2 = 0 AND part % 17 = 0)"""



def s13_spotify(spark, sf_dir):
    """Entries whose address names another kind than their list are not read; nor are those without one."""
    rows = base(spark, sf_dir)
    uri = "CASE WHEN q % 9 = 0 THEN '' ELSE concat('spotify:', elt(1 + (d + q % 2) % 5, 'track', 'album', 'artist', 'track', 'artist'), ':', lpad(part, 22, '0')) END"
    one = F.struct(*ORDER, F.expr(f"named_struct('uri', {uri})").alias("e"), "d")
    every = F.sort_array(F.collect_list(one))
    listed = lambda k: F.transform(F.filter(every, lambda r: r["d"] % 5 == k), lambda r: r["e"])
    lists = [listed(k).alias(name) for k, (name, _, _) in enumerate(X.MUSIC_LISTS)]
    files = rows.groupBy(*KEY).agg(*lists).select("export", F.lit("YourLibrary.json").alias("path"), F.to_json(F.struct(*(n for n, _, _ in X.MUSIC_LISTS))).alias("text"))
    found = X.read_spotify(X.recognised(files).where("is = 'spotify'"))
    return found.groupBy("export", "kind", "ref", "value").agg(F.count("*").alias("n_rows"))


_KINDS = "CASE {} WHEN 0 THEN 'track' WHEN 1 THEN 'album' WHEN 2 THEN 'artist' WHEN 3 THEN 'track' ELSE 'artist' END"
S13 = f"""
    SELECT export, {_KINDS.format('d % 5')} AS kind, lpad(cast(part AS {{str}}), 22, '0') AS ref, CASE WHEN d % 5 >= 3 THEN -1 ELSE 1 END AS value, count(*) AS n_rows
    FROM ({BASE}) b WHERE q % 9 <> 0 AND {_KINDS.format('d % 5')} = {_KINDS.format('(d + q % 2) % 5')} GROUP BY export, kind, ref, value"""

TRAKT = f"""CASE q % 4
    WHEN 0 THEN to_json(named_struct('rating', d + 1, 'type', 'movie', 'movie', named_struct('title', {TITLE}, 'year', {YEAR}, 'ids', named_struct('imdb', concat('tt', part)))))
    WHEN 1 THEN to_json(named_struct('rating', d, 'type', 'show', 'show', named_struct('title', {TITLE}, 'year', {YEAR}, 'ids', named_struct('imdb', concat('x', part)))))
    WHEN 2 THEN to_json(named_struct('rating', d + 1, 'type', 'episode', 'episode', named_struct('title', 'x'), 'show', named_struct('title', name)))
    ELSE to_json(named_struct('rating', d + 0.5D, 'type', 'movie', 'movie', named_struct('title', name))) END"""


def s14_trakt(spark, sf_dir):
    """Two pages, ratings on odd and even lines."""
    rows = base(spark, sf_dir)
    pages = [json_files(rows.where(f"n % 2 = {k}"), f"ratings-movies-{k}.json", TRAKT, ("[", "]")) for k in (0, 1)]
    found = X.read_trakt(X.recognised(pages[0].union(pages[1])).where("is = 'trakt'"))
    return found.where("value <> 0").select("export", "kind", "title", "ref", "year", "value")


S14 = f"""
    SELECT export, kind, title, ref, cast(year AS bigint) AS year, CASE WHEN stars >= 7 THEN 1 ELSE -1 END AS value FROM (
        SELECT export, CASE q % 4 WHEN 0 THEN 'imdb' ELSE 'film' END AS kind, {TITLE} AS title, CASE WHEN q % 4 = 0 THEN concat('tt', part) END AS ref,
               {YEAR} AS year, CASE q % 4 WHEN 0 THEN d + 1 ELSE d END AS stars FROM ({BASE}) b WHERE q % 4 IN (0, 1)) t
    WHERE stars BETWEEN 1 AND 4 OR stars BETWEEN 7 AND 10"""


def s04_read_exports(spark, sf_dir):
    """Every customer's export is one of nine things, by the remainder of its number."""
    rows = base(spark, sf_dir)
    of = lambda k: rows.where(F.col("cust") % 9 == k)
    ratings, likes = film_files(of(3))
    unrated = csv_files(of(4), "watchlist.csv", {"Position": "n", "Const": "concat('tt', part)", "Your Rating": "''", "Title": TITLE})
    name_only = lambda k, path: of(k).select("export", F.lit(path).alias("path"), F.lit(None).cast("string").alias("text")).distinct()
    parts = [
        imdb_files(of(0)), netflix_files(of(1)), maps_files(of(2)), ratings, likes, imdb_files(of(3)), unrated,
        csv_files(of(5), "watched.csv", {"Date": "k", "Name": TITLE, "Year": YEAR, "Letterboxd URI": "part"}),
        name_only(6, "Takeout/Mail/x.mbox"), name_only(7, "user/ratings-shows-2.json"), csv_files(of(8), "notes.csv", {"a": "k", "b": "n"}),
    ]
    entries = parts[0]
    for p in parts[1:]:
        entries = entries.unionByName(p)
    return X.read_exports(entries)[0]


S04 = """
    SELECT export, CASE cust % 9 WHEN 0 THEN 'imdb' WHEN 1 THEN 'netflix' WHEN 2 THEN CASE WHEN stars > 0 THEN 'google-maps' END
                   WHEN 3 THEN CASE WHEN films > 0 THEN 'letterboxd' ELSE 'imdb' END END AS source,
           CASE cust % 9 WHEN 4 THEN 'imdb-list' WHEN 5 THEN 'letterboxd-list' WHEN 6 THEN 'takeout-without-reviews' WHEN 7 THEN 'trakt-without-ratings'
                WHEN 8 THEN 'unreadable' WHEN 2 THEN CASE WHEN stars = 0 THEN 'takeout-without-reviews' END END AS refusal
    FROM (SELECT export, cust, count(*) AS stars, count(CASE WHEN d % 3 <> 0 OR d % 4 = 0 THEN 1 END) AS films FROM (""" + BASE + """) b GROUP BY export, cust) e"""


def s17_prefilled(spark, sf_dir):
    """Files of prefilled accounts, written with a guard before every name, and read back."""
    thumbs, profiles = table(spark, sf_dir, "thumbs"), table(spark, sf_dir, "profiles").where("prefilled")
    mine = thumbs.join(profiles, thumbs.user_id == profiles.id).withColumn("cust", F.lit(0)).withColumn("export", F.col("handle"))
    mine = mine.withColumn("k", F.col("item_id")).withColumn("n", F.col("tag"))
    columns = {"name": "concat('''', item_id)", "attribute": "tag", "rating": "CASE WHEN value > 0 THEN 'Yes' ELSE 'no' END", "source": "''", "id": "''"}
    files = csv_files(mine, "", columns).withColumn("path", F.concat("export", F.lit(".csv")))
    people = profiles.withColumns({"export": F.lit("accounts"), "cust": F.lit(0), "k": F.col("handle"), "n": F.lit(0)})
    rows, _ = X.prefilled(csv_files(people, "accounts.csv", {"handle": "handle", "name": "display_name"}), files)
    return rows.select("handle", "display_name", "item_id", "tag", "value")


S17 = """
    SELECT p.handle, p.display_name, t.item_id, t.tag, t.value FROM {thumbs} t JOIN {profiles} p ON p.id = t.user_id AND p.prefilled"""


def s21_export_files(spark, sf_dir):
    """Every account's own ratings as a CSV file, with the links that names have."""
    rows = run_sql(spark, sf_dir, OWN).withColumn("value", F.col("value").cast("int"))
    return X.export_files(rows, ["user_id"])


OWN = """
    SELECT t.user_id, CASE WHEN length(t.item_id) % 5 = 0 THEN concat('=', t.item_id, ', "x"') ELSE t.item_id END AS name, t.tag AS attribute, t.value,
           CASE WHEN length(t.item_id) % 2 = 0 THEN 'parts' END AS source, CASE WHEN length(t.item_id) % 2 = 0 THEN t.item_id END AS id,
           CASE WHEN length(t.item_id) % 2 = 0 THEN concat('https://example.org/', length(t.item_id)) END AS link
    FROM {thumbs} t"""
S21 = """
    SELECT user_id, concat(chr(65279), 'name,attribute,rating,source,id,link', chr(13), chr(10),
           string_agg(line, concat(chr(13), chr(10)) ORDER BY name, attribute), chr(13), chr(10)) AS text FROM (
        SELECT user_id, name, attribute, concat(CASE WHEN substr(name, 1, 1) = '=' THEN concat('"''', replace(name, '"', '""'), '"') ELSE name END, ',', attribute, ',',
               CASE WHEN value > 0 THEN 'yes' ELSE 'no' END, ',', coalesce(source, ''), ',', coalesce(id, ''), ',', coalesce(link, '')) AS line
        FROM (""" + OWN + """) o) l GROUP BY user_id"""

def s18_snapshots(spark, sf_dir):
    """Every viewer's snapshot written as JSON and read back."""
    texts = Z.write_snapshots(table(spark, sf_dir, "thumbs"), table(spark, sf_dir, "follows"))
    return Z.read_snapshots(texts)[1].groupBy("viewer", "user_id").agg(F.count("*").alias("n_rows"), F.sum("value").alias("balance"), F.min("item_id").alias("first_item"), F.max("tag").alias("last_tag"))


S18 = """
    SELECT w.viewer, w.user_id, count(*) AS n_rows, cast(sum(t.value) AS bigint) AS balance, min(t.item_id) AS first_item, max(t.tag) AS last_tag FROM (
        SELECT follower_id AS viewer, followed_id AS user_id FROM {follows} UNION SELECT follower_id, follower_id FROM {follows}) w
    JOIN {thumbs} t ON t.user_id = w.user_id GROUP BY w.viewer, w.user_id"""


def s19_results(spark, sf_dir):
    """What is said to every viewer as a result text, without a plot."""
    found = opinions.scored(opinions.opinions(*(table(spark, sf_dir, n) for n in ("thumbs", "follows")), near=True))
    scores = found.withColumns({"kind": F.lit("score"), "point": F.lit(None).cast("array<double>")})
    # what lies in one piece is written where it lies
    texts = Z.write_results(scores.where("pieces = 1"), "share", "piece").unionByName(Z.write_results(scores.where("pieces > 1")))
    return texts.select("viewer", F.expr("size(map_keys(from_json(text, 'scores map<string, struct<score: double>>').scores))").cast("long").alias("n_scores"), F.get_json_object("text", "$.viewer").alias("named"))


S19 = "SELECT viewer, count(*) AS n_scores, viewer AS named FROM {scores} GROUP BY viewer"

QUERIES = {
    f.__name__: f
    for f in (
        s04_read_exports, s06_imdb, s07_letterboxd, s08_goodreads, s09_storygraph, s10_netflix_profiles, s11_netflix_chosen, s12_maps, s13_spotify,
        s14_trakt, s17_prefilled, s18_snapshots, s19_results, s21_export_files,
    )
}
ORACLES = {
    "s04_read_exports": S04, "s06_imdb": S06, "s07_letterboxd": S07, "s08_goodreads": S08, "s09_storygraph": S09, "s10_netflix_profiles": S10,
    "s11_netflix_chosen": S11, "s12_maps": S12, "s13_spotify": S13, "s14_trakt": S14, "s17_prefilled": S17, "s18_snapshots": S18, "s19_results": S19, "s21_export_files": S21,
}


def queries():
    return QUERIES


def oracle_sql():
    from .relational import ansi

    return {name: ansi(sql) for name, sql in ORACLES.items()}
