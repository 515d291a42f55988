"""Export files of other services as ratings: files to cells in Arrow batches, everything after that in DataFrames.

files       (export, path, text): one row per file of an export; zips are opened, gzip is refused
cells       (export, path, line, header, cells): the rows of CSV texts
recognised  (export, path, text, header, is): what each file is, by its content
readings    (export, source, refusal): which source an export is read as, or why it is not
ratings     (export, source, kind, title, author, ref, year, lat, lon, value, ord): one row per thumb;
            value 0 is a rating that is left out

A file is one cell of a row, so it has to fit a task (``MOST_BYTES``, counted while inflating); exports are spread
over tasks and may be any number.
"""

from __future__ import annotations

import csv
import io
import zipfile
import zlib
from collections.abc import Iterator
from functools import reduce
from itertools import accumulate, chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text

MOST_BYTES = 50_000_000
WHITE = r"[\s\u000B   -     　﻿]"
SPACES = text.SPACES.replace("\u2000-\u200a", "".join(map(chr, range(0x2000, 0x200B))))  # one by one, not as a range
#: Names inside a zip that are worth reading (fixed values).
TRAKT_NAME = r"(?i)(^|/)ratings-(movies|shows|seasons|episodes)(-\d+)?\.json$"
WANTED = (
    r"(?i)(^|/)ratings\.csv$",
    r"(?i)(^|/)likes/films\.csv$",
    r"(?i)(^|/)maps[^/]*/[^/]+\.json$",
    TRAKT_NAME,
    r"(?i)(^|/)yourlibrary\.json$",
)
#: Header columns that tell a CSV's kind, in the order in which they are asked (fixed values).
HEADERS = (
    ("imdb", ("const", "your rating")),
    ("imdb", ("const", "you rated")),
    ("imdb-list", ("const", "title")),
    ("goodreads", ("book id", "my rating", "exclusive shelf")),
    ("netflix", ("profile name", "title name", "thumbs value")),
    ("storygraph", ("title", "authors", "isbn/uid", "star rating")),
)
FILM_LIST = ("date", "name", "year", "letterboxd uri")
#: Header columns that readers look at.
READ = (
    "const", "your rating", "you rated", "title", "title type", "year", "letterboxd uri", "name", "rating", "my rating", "author", "authors", "star rating",
    "profile name", "title name", "rating type", "thumbs value", "star value", "handle", "attribute", "source", "id",
)
#: Lists of a music library: name, what it lists, what being on it says (fixed values).
MUSIC_LISTS = (("tracks", "track", 1), ("albums", "album", 1), ("artists", "artist", 1), ("bannedTracks", "track", -1), ("bannedArtists", "artist", -1))
RATING_COLUMNS = "export string, source string, kind string, title string, author string, ref string, year long, lat double, lon double, value int, ord long"
_NAMES = [c.split(" ")[0] for c in RATING_COLUMNS.split(", ")]
_TYPES = dict(c.split(" ") for c in RATING_COLUMNS.split(", "))


# -- files ---------------------------------------------------------------------------------------------------
def wanted(path: Column) -> Column:
    return reduce(lambda a, b: a | b, (path.rlike(p) for p in WANTED))


def _inflate(raw: bytes) -> Iterator[tuple[str, str | None]]:
    """(name, text) of every file of a zip: text is null where the name alone counts, or the file is too long."""
    import re

    patterns = [re.compile(p) for p in WANTED]
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        for info in z.infolist():
            if info.is_dir():
                continue
            if not any(p.search(info.filename) for p in patterns):
                yield info.filename, None
                continue
            with z.open(info) as f:
                data = f.read(MOST_BYTES + 1)  # counted while inflating, whatever the directory claims
            yield info.filename, None if len(data) > MOST_BYTES else data.decode("utf-8", "replace")


def opened(name: str, raw: bytes) -> Iterator[tuple[str, str | None, str | None]]:
    """(path, text, refusal) of one chosen file: gzip is refused, PK is a zip, all else is text."""
    if raw[:2] == b"\x1f\x8b":
        yield name, None, "unreadable"
    elif raw[:2] == b"PK":
        try:
            for path, text in _inflate(raw):
                yield path, text, None
        except (zipfile.BadZipFile, zlib.error, NotImplementedError, RuntimeError, EOFError):
            yield name, None, "unreadable"
    elif len(raw) > MOST_BYTES:
        yield name, None, "unreadable"
    else:
        yield name, raw.decode("utf-8", "replace"), None


def unpacked(chosen: DataFrame) -> DataFrame:
    """(export, path, text, refusal) from chosen files (path, content), an export each."""

    def run(batches):
        for batch in batches:
            for path, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                rows = [(path, *x) for x in opened(path.rsplit("/", 1)[-1], raw.as_py() or b"")]
                columns = zip(*rows, strict=True) if rows else [[]] * 4
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in columns], names=["export", "path", "text", "refusal"])

    return chosen.select("path", "content").mapInArrow(run, "export string, path string, text string, refusal string")


def files(spark: SparkSession, paths: str) -> DataFrame:
    """``unpacked`` for the files that ``paths`` names, through Spark's reader."""
    return unpacked(spark.read.format("binaryFile").load(paths))


# -- CSV -----------------------------------------------------------------------------------------------------
def csv_rows(text: str) -> list[list[str]]:
    """The rows of a CSV text: quoted cells with doubled quotes and line ends inside, a quote inside a bare cell as it
    stands, line ends of all three kinds, no rows for blank lines, a byte-order mark ignored."""
    return list(_csv_rows(text))


def _csv_rows(text: str) -> Iterator[list[str]]:
    csv.field_size_limit(2**31 - 1)
    found = csv.reader(io.StringIO(text.removeprefix("﻿"), newline=""), strict=False)
    return (row for row in found if row not in ([], [""]))


def cells(texts: DataFrame) -> DataFrame:
    """(export, path, is, line, header, cells, at) of the CSV texts in ``texts`` (export, path, text and, if known, is);
    line 0 is the header, lower case and trimmed. ``at`` holds the row's trimmed cells below the names of ``READ``."""

    def run(batches):
        for batch in batches:
            for export, path, kind, file in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                rows = csv_rows(file or "")
                header = [h.strip().lower() for h in rows[0]] if rows else []
                first = {name: k for k, name in reversed(list(enumerate(header)))}
                for a in range(0, len(rows), 10_000):
                    part = rows[a : a + 10_000]
                    n = len(part)
                    ends = pa.array([0, *accumulate(map(len, part))], pa.int32())
                    same = lambda value: pa.array([value], pa.string()).take(pa.array(np.zeros(n, "int64")))
                    names = pa.array(header, pa.string()).take(pa.array(np.tile(np.arange(len(header)), n)))
                    below = [
                        pa.array([row[k].strip(SPACES) if k < len(row) else None for row in part], pa.string()) if (k := first.get(name, -1)) >= 0 else pa.nulls(n, pa.string())
                        for name in READ
                    ]
                    yield pa.RecordBatch.from_arrays(
                        [
                            same(export),
                            same(path),
                            same(kind),
                            pa.array(np.arange(a, a + n)),
                            pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype="int32") * len(header)), names),
                            pa.ListArray.from_arrays(ends, pa.array(chain.from_iterable(part), pa.string())),
                            pa.StructArray.from_arrays(below, names=list(READ)),
                        ],
                        names=["export", "path", "is", "line", "header", "cells", "at"],
                    )

    at = ", ".join(f"`{name}`: string" for name in READ)
    kinds = f"export string, path string, is string, line long, header array<string>, cells array<string>, at struct<{at}>"
    known = F.col("is") if "is" in texts.columns else F.lit(None).cast("string").alias("is")
    return texts.select("export", "path", known, "text").mapInArrow(run, kinds)


def trimmed(column: Column) -> Column:
    return F.regexp_replace(column, f"^{WHITE}+|{WHITE}+$", "")


def squeezed(column: Column) -> Column:
    return F.regexp_replace(column, f"{WHITE}+", " ")


def cell(name: str) -> Column:
    """The row's cell below the header ``name`` (of ``READ``), trimmed; '' where there is none.

    It is looked up where the file is parsed: looked up here, in every expression that asks, a reader would be code too
    long to be compiled, and run some ten times slower."""
    return F.coalesce(F.col("at").getField(name), F.lit(""))


def whole_number(text: Column) -> Column:
    return F.when(text.rlike("^[0-9]+$"), text.try_cast("double"))


def number(text: Column) -> Column:
    return F.when(text.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"), text.try_cast("double"))


# -- what a rating says: +1, -1 or 0 for one in the middle ---------------------------------------------------------
def ten_stars(stars: Column) -> Column:
    return F.when(stars >= 7, 1).when(stars <= 4, -1).otherwise(0)


def five_stars(stars: Column) -> Column:
    return F.when(stars >= 4, 1).when(stars <= 2, -1).otherwise(0)


def film_stars(stars: Column, liked: Column) -> Column:
    """Half stars with a heart: the heart decides unless the stars are outside the middle."""
    cut = five_stars(stars)
    return F.when(stars.isNull(), F.when(liked, 1).otherwise(0)).when((cut == 0) & liked, 1).otherwise(cut)


def without_series(title: Column) -> Column:
    """A book's title without the series that stands, with its number, in the last bracket."""
    series = rf"{WHITE}*\([^()]*#{WHITE}*(?:[0-9.,–-]|{WHITE})+[^()]*\){WHITE}*$"
    return trimmed(F.regexp_replace(title, series, ""))


# -- recognition ---------------------------------------------------------------------------------------------
def recognised(texts: DataFrame) -> DataFrame:
    """(export, path, text, header, is) for ``texts`` (export, path, text): ``is`` is null for what nothing reads."""

    def run(batches):
        for batch in batches:
            headers = []
            for text in batch.column(2).to_pylist():
                first = next(_csv_rows((text or "")[: 1 << 16]), [])
                headers.append([h.strip().lower() for h in first])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(headers, pa.list_(pa.string()))], names=[*batch.schema.names, "header"])

    rows = texts.select("export", "path", "text").mapInArrow(run, "export string, path string, text string, header array<string>")
    bare = F.regexp_replace("text", "^﻿", "")
    rows = rows.withColumn("json", F.when(F.substring(bare, 1, 64).rlike(r"^\s*[\[{]"), F.try_parse_json(bare)))
    is_json = F.substring(bare, 1, 64).rlike(r"^\s*[\[{]")
    has = lambda *names: F.size(F.array_except(F.array(*map(F.lit, names)), "header")) == 0
    films = has(*FILM_LIST)
    kind = F.when(is_json, _json_kind())
    for name, columns in HEADERS:
        kind = kind.when(has(*columns), name)
    kind = kind.when(films & has("rating") & (F.size("header") == 5), "letterboxd-ratings")
    kind = kind.when(films & (F.size("header") == 4), F.when(F.col("path").rlike(r"(?i)(^|/)likes/films\.csv$"), "letterboxd-likes").otherwise("letterboxd-list"))
    return rows.withColumn("is", kind)


def _list(path: str) -> Column:
    return F.expr(f"try_variant_get(json, '{path}', 'array<variant>')")


def _json_kind() -> Column:
    stars = "exists(try_variant_get(json, '$.features', 'array<variant>'), f -> variant_get(f, '$.properties.five_star_rating_published', 'variant') is not null or variant_get(f, '$.properties[\"Star Rating\"]', 'variant') is not null)"
    maps = F.expr(f"try_variant_get(json, '$.type', 'string') = 'FeatureCollection' and {stars}")
    kinds = "try_variant_get(e, '$.type', 'string')"
    named = " or ".join(f"({kinds} = '{k}' and schema_of_variant(try_variant_get(e, '$.{k}', 'variant')) like 'OBJECT%')" for k in ("movie", "show", "season", "episode"))
    number_ = "schema_of_variant(try_variant_get(e, '$.rating', 'variant')) rlike '^(BIGINT|DECIMAL|DOUBLE|FLOAT)'"
    trakt = F.expr(f"exists(try_variant_get(json, '$', 'array<variant>'), e -> {number_} and ({named}))")
    lists = " and ".join(f"try_variant_get(json, '$.{x}', 'array<variant>') is not null" for x in ("tracks", "albums", "artists"))
    uris = " or ".join(
        f"exists(coalesce(try_variant_get(json, '$.{x}', 'array<variant>'), array()), e -> try_variant_get(e, '$.uri', 'string') rlike '^spotify:(track|album|artist):[0-9A-Za-z]{{22}}$')"
        for x, _, _ in MUSIC_LISTS
    )
    return F.when(maps, "google-maps").when(trakt, "trakt").when(F.expr(f"({lists}) and ({uris})"), "spotify")


# -- readers: rows of RATING_COLUMNS -------------------------------------------------------------------------------
def _rated(rows: DataFrame, source: str, **given: Column) -> DataFrame:
    told = {"export": F.col("export"), "source": F.lit(source), **given}
    return rows.select(*(told.get(n, F.lit(None)).cast(_TYPES[n]).alias(n) for n in _NAMES))


def read_imdb(rows: DataFrame) -> DataFrame:
    """Single episodes are left out. The rating's column was named otherwise in old files."""
    rating = F.when(F.array_contains("header", "your rating"), cell("your rating")).otherwise(cell("you rated"))
    rows = rows.withColumn("stars", whole_number(rating)).where(cell("const").rlike(r"^tt[0-9]+$") & (F.col("stars") >= 1))
    episode = F.lower(F.regexp_replace(cell("title type"), WHITE, "")) == "tvepisode"
    value = F.when(episode, 0).otherwise(ten_stars(F.col("stars")))
    return _rated(rows, "imdb", kind=F.lit("imdb"), title=cell("title"), ref=cell("const"), year=whole_number(cell("year")), value=value, ord=F.col("line"))


def read_letterboxd(ratings: DataFrame, likes: DataFrame) -> DataFrame:
    """Ratings and likes of a film meet at its address: rated and liked is one row, and only a like is one too."""
    film = lambda rows: rows.select("export", cell("letterboxd uri").alias("uri"), cell("name").alias("title"), whole_number(cell("year")).alias("year"), "line", number(cell("rating")).alias("stars"))
    rated = film(ratings).where((F.col("title") != "") & F.col("stars").between(0.5, 5))
    liked = film(likes)
    hearts = liked.select("export", "uri").distinct().withColumn("heart", F.lit(True))
    one = rated.join(hearts, ["export", "uri"], "left").withColumn("place", F.col("line"))
    two = liked.where(F.col("title") != "").join(rated.select("export", "uri").distinct(), ["export", "uri"], "left_anti")
    two = two.drop("stars").withColumn("stars", F.lit(None).cast("double")).withColumn("heart", F.lit(True))
    two = two.withColumn("place", F.col("line") + (1 << 40))
    rows = one.unionByName(two)
    value = film_stars(F.col("stars"), F.coalesce("heart", F.lit(False)))
    return _rated(rows, "letterboxd", kind=F.lit("film"), title=F.col("title"), year=F.col("year"), value=value, ord=F.col("place"))


def read_goodreads(rows: DataFrame) -> DataFrame:
    rows = rows.withColumn("stars", whole_number(cell("my rating"))).where((F.col("stars") >= 1) & (cell("title") != ""))
    return _rated(rows, "goodreads", kind=F.lit("book"), title=without_series(cell("title")), author=squeezed(cell("author")), value=five_stars(F.col("stars")), ord=F.col("line"))


def read_storygraph(rows: DataFrame) -> DataFrame:
    stars = F.when(cell("star rating").rlike(r"^[0-9]+(\.[0-9]+)?$"), number(cell("star rating"))).otherwise(0)
    rows = rows.withColumn("stars", stars).where((F.col("stars") > 0) & (F.col("stars") <= 5) & (cell("title") != ""))
    author = trimmed(squeezed(F.split_part(cell("authors"), F.lit(", "), F.lit(1))))
    return _rated(rows, "storygraph", kind=F.lit("book"), title=without_series(cell("title")), author=author, value=five_stars(F.col("stars")), ord=F.col("line"))


def netflix_log(rows: DataFrame) -> DataFrame:
    """(export, profile, title, cut, line) of every rating in the log, new thumbs and old stars."""
    stars, thumb = cell("star value"), whole_number(cell("thumbs value"))
    cut = F.when(cell("rating type") == "thumb", F.when(thumb == 1, -1).when(thumb.isin(2, 3), 1)).when(
        (cell("rating type") == "star") & stars.rlike("^[1-5]$"), five_stars(number(stars))
    )
    found = rows.select("export", cell("profile name").alias("profile"), squeezed(cell("title name")).alias("title"), cut.alias("cut"), "line")
    return found.where((F.col("title") != "") & F.col("cut").isNotNull())


def netflix_profiles(log: DataFrame) -> DataFrame:
    """(export, profile, place) in the order in which the file first names them."""
    first = log.groupBy("export", "profile").agg(F.min("line").alias("line"))
    return first.select("export", "profile", F.row_number().over(Window.partitionBy("export").orderBy("line")).alias("place"))


def read_netflix(log: DataFrame, chosen: DataFrame | None = None) -> DataFrame:
    """One thumb a title over the ``chosen`` (export, profile), all without it: taken where every thumb agrees."""
    if chosen is not None:
        log = log.join(chosen.select("export", "profile").distinct(), ["export", "profile"], "left_semi")
    cuts = F.collect_set(F.when(F.col("cut") != 0, F.col("cut")))
    rows = log.groupBy("export", "title").agg(cuts.alias("cuts"), F.min("line").alias("line"))
    value = F.when(F.size("cuts") == 1, F.element_at("cuts", 1)).otherwise(0)
    return _rated(rows, "netflix", kind=F.lit("title"), title=F.col("title"), value=value, ord=F.col("line"))


def _each(rows: DataFrame, path: str) -> DataFrame:
    return rows.select("export", "path", F.posexplode(_list(path)).alias("place", "e"))


def _get(path: str, kind: str = "string") -> str:
    return f"try_variant_get(e, '{path}', '{kind}')"


def _first(kind: str, *paths: str) -> Column:
    return F.expr(f"coalesce({', '.join(_get(p, kind) for p in paths)})")


def read_maps(rows: DataFrame) -> DataFrame:
    """Reviewed places, newest first by the text of the date. Drafts, nameless places and (0, 0) are no ratings."""
    # what stands first, whatever its type, counts; only a text is a name
    pick = lambda *paths: f"coalesce({', '.join(_get(p, 'variant') for p in paths)})"
    as_number = lambda v: F.expr(f"try_variant_get({v}, '$', 'double')")
    stars = as_number(pick("$.properties.five_star_rating_published", '$.properties["Star Rating"]'))
    place = pick("$.properties.location", "$.properties.Location")
    of = lambda *names: "coalesce(" + ", ".join(f"try_variant_get({place}, '{n}', 'variant')" for n in names) + ")"
    name = F.expr(f"case when schema_of_variant({of('$.name', '$[\"Business Name\"]')}) = 'STRING' then try_variant_get({of('$.name', '$[\"Business Name\"]')}, '$', 'string') end")
    geo = lambda k, axis: as_number(f"coalesce({_get(f'$.geometry.coordinates[{k}]', 'variant')}, try_variant_get({place}, '$[\"Geo Coordinates\"].{axis}', 'variant'))")
    found = _each(rows, "$.features").select(
        "export", "path", "place", stars.alias("stars"), trimmed(name).alias("title"), geo(0, "Longitude").alias("lon"), geo(1, "Latitude").alias("lat"),
        F.coalesce(_first("string", "$.properties.date", "$.properties.Published"), F.lit("")).alias("date"),
    )
    finite = (F.abs("lon") < float("inf")) & (F.abs("lat") < float("inf"))
    found = found.where(F.col("stars").between(1, 5) & (F.col("title") != "") & finite & ~((F.col("lat") == 0) & (F.col("lon") == 0)))
    newest = F.row_number().over(Window.partitionBy("export").orderBy(F.desc("date"), "path", "place"))
    found = found.withColumn("newest", newest)
    return _rated(found, "google-maps", kind=F.lit("place"), title=F.col("title"), lat=F.col("lat"), lon=F.col("lon"), value=five_stars(F.col("stars")), ord=F.col("newest"))


def read_spotify(rows: DataFrame) -> DataFrame:
    """The lists of a library, each with what it says; an address has to name what its list lists."""
    parts = []
    for k, (name, of, value) in enumerate(MUSIC_LISTS):
        uri = F.expr(_get("$.uri"))
        found = _each(rows, f"$.{name}").where(uri.rlike(f"^spotify:{of}:[0-9A-Za-z]{{22}}$"))
        parts.append(_rated(found, "spotify", kind=F.lit(of), ref=F.substring(uri, len(f"spotify:{of}:") + 1, 22), value=F.lit(value), ord=F.col("place") + k * (1 << 40)))
    return reduce(DataFrame.unionByName, parts)


def read_trakt(rows: DataFrame) -> DataFrame:
    """Films and shows of every page; seasons and episodes are left out."""
    is_number = f"schema_of_variant({_get('$.rating', 'variant')}) rlike '^(BIGINT|DECIMAL|DOUBLE|FLOAT)'"
    found = _each(rows, "$").select(
        "export", "path", "place", F.expr(f"case when {is_number} then {_get('$.rating', 'double')} end").alias("stars"), F.expr(_get("$.type")).alias("type"), "e"
    )
    found = found.where((F.col("stars") == F.floor("stars")) & F.col("stars").between(1, 10))
    skipped = F.coalesce(F.col("type").isin("season", "episode"), F.lit(False))
    at = lambda what, kind="variant": f"case when type = 'movie' then {_get('$.movie.' + what, kind)} else {_get('$.show.' + what, kind)} end"
    words = lambda what: f"case when schema_of_variant({at(what)}) = 'STRING' then {at(what, 'string')} end"
    year = F.expr(f"case when schema_of_variant({at('year')}) rlike '^(BIGINT|DECIMAL|DOUBLE|FLOAT)' then {at('year', 'double')} end")
    found = found.select(
        "export", "stars", skipped.alias("skipped"), trimmed(F.expr(words("title"))).alias("title"), F.when(year == F.floor(year), year).alias("year"),
        F.expr(words("ids.imdb")).alias("imdb"), F.row_number().over(Window.partitionBy("export").orderBy("path", "place")).alias("ord"),
    )
    found = found.where(F.col("skipped") | (F.col("title") != ""))
    known = F.coalesce(F.col("imdb").rlike(r"^tt[0-9]+$"), F.lit(False))
    value = F.when(F.col("skipped"), 0).otherwise(ten_stars(F.col("stars")))
    return _rated(found, "trakt", kind=F.when(known, "imdb").otherwise("film"), title=F.col("title"), ref=F.when(known, F.col("imdb")), year=F.col("year"), value=value, ord=F.col("ord"))


# -- whole exports ---------------------------------------------------------------------------------------------
def readings(known: DataFrame, paths: DataFrame, rated: DataFrame) -> DataFrame:
    """(export, source, refusal) from recognised files (export, path, is, header), every name in the export
    (export, path) and what ``read_imdb`` found (export): its lists have the ratings' header too. Of files of several sources two come before
    all others, then the first file that is any of the rest."""
    has = lambda *kinds: F.max(F.col("is").isin(*kinds).cast("int")) == 1
    single = ("imdb", "goodreads", "storygraph", "netflix", "google-maps", "spotify")
    first = F.min(F.when(F.col("is").isin(*single), F.struct("path", "is", F.array_contains("header", "position").alias("listed"))))
    by_kind = known.groupBy("export").agg(
        has("letterboxd-ratings", "letterboxd-likes").alias("films"), has("trakt").alias("trakt"), has("imdb-list").alias("wrong_list"),
        has("letterboxd-list").alias("film_list"), first.alias("first"),
    )
    named = lambda p: F.max(F.col("path").rlike(p).cast("int")) == 1
    by_path = paths.groupBy("export").agg(named("(?i)^takeout/").alias("takeout"), named(TRAKT_NAME).alias("pages"), named("(?i)(^|/)content_interaction/").alias("streamed"))
    counts = rated.groupBy("export").agg(F.count("*").alias("n"))
    told = by_path.join(by_kind, "export", "left")
    source = F.when(F.col("films"), "letterboxd").when(F.col("trakt"), "trakt").otherwise(F.col("first.is"))
    told = told.withColumn("source", source).join(counts, "export", "left")
    empty_list = (F.col("source") == "imdb") & F.col("first.listed") & F.col("n").isNull()
    refusal = (
        F.when(empty_list, "imdb-list")
        .when(F.col("source").isNotNull(), None)
        .when(F.col("wrong_list"), "imdb-list")
        .when(F.col("film_list"), "letterboxd-list")
        .when(F.col("takeout"), "takeout-without-reviews")
        .when(F.col("pages"), "trakt-without-ratings")
        .when(F.col("streamed"), "netflix-without-ratings")
        .otherwise("unreadable")
    )
    return told.select("export", F.when(refusal.isNull(), F.col("source")).alias("source"), refusal.alias("refusal"))


def read_exports(entries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(readings, ratings) of the files of any number of exports (export, path, text); a null text is a name only.
    Recognised files and their cells are kept (``persist``), since each of eight readers takes its own."""
    known = recognised(entries.where("text is not null")).persist()
    of = lambda *kinds: known.where(F.col("is").isin(*kinds))
    tables = cells(of("imdb", "letterboxd-ratings", "letterboxd-likes", "goodreads", "storygraph", "netflix")).where("line > 0").persist()
    table = lambda kind: tables.where(F.col("is") == kind)
    every = [
        read_imdb(table("imdb")),
        read_letterboxd(table("letterboxd-ratings"), table("letterboxd-likes")),
        read_goodreads(table("goodreads")),
        read_storygraph(table("storygraph")),
        read_netflix(netflix_log(table("netflix"))),
        read_maps(of("google-maps")),
        read_spotify(of("spotify")),
        read_trakt(of("trakt")),
    ]
    rated = reduce(DataFrame.unionByName, every)
    found = readings(known.select("export", "path", "is", "header"), entries.select("export", "path"), every[0])
    return found, rated.join(found.where("refusal is null").select("export", "source"), ["export", "source"], "left_semi").select(*_NAMES)


# -- files of prefilled accounts ---------------------------------------------------------------------------------
HANDLE = "^[a-z][a-z0-9]{0,29}$"


def prefilled(accounts: DataFrame, files_: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows, faults) from ``accounts`` (export, path, text: handle,name) and ``files_`` (the same, one file
    ``<handle>.csv`` each). Rows: (handle, display_name, item_id, tag, value, source, id, line). Faults: (path, line,
    fault), the first of each file; a file with a fault is not to be loaded. A ' before a name, the guard of an export,
    is taken off."""
    name_of = text.column(text.normalize_id)
    listed = cells(accounts).where("line > 0").select("path", (F.col("line") + 1).alias("line"), cell("handle").alias("handle"), cell("name").alias("display_name"))
    listed = listed.where("handle <> '' OR display_name <> ''")
    twice = F.row_number().over(Window.partitionBy("handle").orderBy("path", "line")) > 1
    listed = listed.withColumn(
        "fault", F.when(~F.col("handle").rlike(HANDLE), "handle").when(F.col("display_name") == "", "name").when(twice, "repeated")
    )
    every = cells(files_)
    typed, typed_tag = cell("name"), F.regexp_replace(cell("attribute"), "^'", "")
    blank = (typed == "") & F.forall("cells", lambda c: trimmed(c) == "")
    rows = every.where("line > 0").where(~blank).select(
        "path", F.regexp_extract("path", r"([^/]+)\.csv$", 1).alias("handle"), (F.col("line") + 1).alias("line"),
        name_of(F.regexp_replace(typed, "^'", "")).alias("item_id"),
        F.when(typed_tag == "", "").otherwise(name_of(typed_tag)).alias("tag"),
        F.lower(cell("rating")).alias("rating"), cell("source").alias("source"), cell("id").alias("id"),
    )
    again = F.row_number().over(Window.partitionBy("path", "item_id", "tag").orderBy("line")) > 1
    fault = (
        F.when(F.col("item_id").isNull(), "name")
        .when(F.col("tag").isNull(), "attribute")
        .when(~F.col("rating").isin("yes", "no"), "rating")
        .when(again, "repeated")
        .when((F.col("source") == "") != (F.col("id") == ""), "link")
    )
    rows = rows.withColumn("fault", fault)
    lacking = every.where((F.col("line") == 0) & (F.size(F.array_except(F.array(F.lit("name"), F.lit("rating")), "header")) > 0))
    faults = reduce(
        DataFrame.unionByName,
        (x.where("fault is not null").select("path", "line", "fault") for x in (rows, listed, lacking.withColumn("fault", F.lit("header")))),
    )
    faults = faults.groupBy("path").agg(F.min(F.struct("line", "fault")).alias("f")).select("path", "f.line", "f.fault")
    good = rows.where("fault is null").join(listed.where("fault is null").select("handle", "display_name"), "handle")
    value = F.when(F.col("rating") == "yes", 1).otherwise(-1).alias("value")
    link = [F.nullif(F.col(c), F.lit("")).alias(c) for c in ("source", "id")]
    return good.select("handle", "display_name", "item_id", "tag", value, *link, "line"), faults


# -- a person's own ratings as CSV -------------------------------------------------------------------------------
EXPORT_HEADER = ["name", "attribute", "rating", "source", "id", "link"]


def csv_cell(text: Column) -> Column:
    """A cell as it stands in a file: one that a spreadsheet would run is guarded by ', quotes where needed."""
    guarded = F.when(text.rlike(r"^[=+\-@\t\r]"), F.concat(F.lit("'"), text)).otherwise(text)
    return F.when(guarded.rlike(r'[",\r\n]'), F.concat(F.lit('"'), F.replace(guarded, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(guarded)


def export_files(ratings: DataFrame, keys: list[str]) -> DataFrame:
    """(*keys, text): the CSV file of each of ``keys``, from (*keys, name, attribute, value, source, id, link), rows by
    name and attribute. One file is what one account has rated."""
    rating = F.when(F.col("value") == 1, "yes").otherwise("no")
    line = F.concat_ws(",", *(csv_cell(F.coalesce(c, F.lit(""))) for c in (F.col("name"), F.col("attribute"), rating, F.col("source"), F.col("id"), F.col("link"))))
    rows = ratings.select(*keys, F.struct("name", "attribute", line.alias("text")).alias("row"))
    lines = F.transform(F.array_sort(F.collect_list("row")), lambda r: r["text"])
    body = F.array_join(F.concat(F.array(F.lit(",".join(EXPORT_HEADER))), lines), "\r\n")
    return rows.groupBy(*keys).agg(F.concat(F.lit("﻿"), body, F.lit("\r\n")).alias("text"))
