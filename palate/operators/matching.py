"""Imported things matched with pages, books, places and the catalog: one answer or none.

Every way of writing a thing becomes a row (a guess), guesses meet pages on equal titles, and aggregates decide. No
group is collected: what decides is a least rank, how many different pages hold it, and one of them.

Inputs, where not said otherwise:
rows    (row, title, ...): what is looked for
pages   (title, ref): titles asked and the page each leads to, redirects followed (``resolved``)
facts   (ref, role, first_year, authors): what the page is about; role is one of 'film', 'series', 'screen', 'book',
        'book series', or anything else for other writing
"""

from __future__ import annotations

import re
import unicodedata
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..sources import store
from ..sources.exports import WHITE, squeezed, trimmed

YEAR_SLACK, REACH_METRES, CELL = 1, 200.0, 0.0025
EARTH = 6_371_000.0
CROWD, FINEST = 4, 8  # places of the same words in a cell before rows ask finer ones, each a quarter as high; how many at most
#: Words that titles write small between others (fixed values).
SHORT_WORDS = "A An And As At But By For From In Nor Of On Or Than The To Vs Vs. With".split()


# -- spellings -----------------------------------------------------------------------------------------------
def spellings(title: Column) -> Column:
    """A title as it stands, without shouting, and with short words small."""
    whole = squeezed(trimmed(title))
    cased = F.when(whole.rlike(r"\p{Lu}{4}") & (whole == F.upper(whole)), F.initcap(F.lower(whole))).otherwise(whole)
    words = F.split(cased, " ")
    short = F.array(*map(F.lit, SHORT_WORDS))
    inner = lambda k: (k > 0) & (k < F.size(words) - 1)
    small = F.array_join(F.transform(words, lambda w, k: F.when(inner(k) & F.array_contains(short, w), F.lower(w)).otherwise(w)), " ")
    return F.array_distinct(F.array(whole, cased, small))


def film_guesses(title: Column, year: Column) -> Column:
    """Page titles a film may have, the likeliest first: array of (title, dated)."""
    guess = lambda t, dated: F.struct(t.alias("title"), F.lit(dated).alias("dated"))

    def of(t: Column) -> Column:
        plain = [guess(F.concat(t, F.lit(f" ({kind})")), False) for kind in ("film", "miniseries", "TV series")]
        dated = guess(F.concat(t, F.lit(" ("), year.cast("string"), F.lit(" film)")), True)
        return F.when(year.isNull(), F.array(*plain, guess(t, False))).otherwise(F.array(dated, *plain, guess(t, False)))

    return F.flatten(F.transform(spellings(title), of))


def book_titles(title: Column) -> Column:
    """A book's title whole, without a subtitle, and without an alternative."""
    whole = trimmed(title)
    cut = F.array(whole, trimmed(F.split(whole, ":", 2)[0]), trimmed(F.split(whole, ",? or,", 2)[0]))
    return F.filter(F.array_distinct(cut), lambda t: t != "")


def book_guesses(title: Column, author: Column) -> Column:
    surname = F.element_at(F.split(trimmed(author), f"{WHITE}+"), -1)
    of = lambda t: F.array(F.concat(t, F.lit(" ("), surname, F.lit(" novel)")), F.concat(t, F.lit(" (novel)")), F.concat(t, F.lit(" (book)")), t)
    return F.flatten(F.transform(book_titles(title), of))


def title_to_name(title: Column) -> Column:
    """The name a page's title gives: without trade marks and the # before a word, then as any name."""
    bare = F.regexp_replace(F.regexp_replace(title, "[®™©℠]", ""), rf"(^|{WHITE})#", "$1")
    return text.column(text.normalize_id)(bare)


# -- deciding -----------------------------------------------------------------------------------------------
def one_or_nothing(scored: DataFrame, by: str = "rank") -> DataFrame:
    """(row, ref) where the entries (row, rank, ref) of least rank all lead to one page."""
    least = scored.groupBy("row", by).agg(F.min("ref").alias("low"), F.max("ref").alias("high"))
    best = least.groupBy("row").agg(F.min(F.struct(by, "low", "high")).alias("best"))
    return best.where("best.low = best.high").select("row", F.col("best.low").alias("ref"))


def resolved(asked: DataFrame, moves: DataFrame, pages: DataFrame) -> DataFrame:
    """(title, ref) of asked titles: each may be written otherwise and then moved; ``moves`` (step, title, target) has
    the spelling (step 1) before the redirect (step 2)."""
    out = asked.select("title", F.col("title").alias("at"))
    for step in (1, 2):
        to = moves.where(F.col("step") == step).select(F.col("title").alias("at"), "target")
        out = out.join(to, "at", "left").select("title", F.coalesce("target", "at").alias("at"))
    return out.join(pages.select(F.col("title").alias("at"), "ref"), "at").select("title", "ref")


def pick_films(rows: DataFrame, pages: DataFrame, facts: DataFrame) -> DataFrame:
    """(row, ref) of films (row, title, year). The nearest year decides; of several pages with it, one that a guess
    with the year in its title led to; a series counts only where both years are known."""
    guesses = rows.select("row", "year", F.posexplode(film_guesses(F.col("title"), F.col("year"))).alias("pos", "guess"))
    guesses = guesses.select("row", "year", "pos", "guess.title", "guess.dated")
    found = guesses.join(pages, "title").join(facts.where("role in ('film', 'series')").select("ref", "role", "first_year"), "ref")
    both = F.col("year").isNotNull() & F.col("first_year").isNotNull()
    apart = F.when(both, F.abs(F.col("first_year") - F.col("year"))).otherwise(YEAR_SLACK)
    found = found.where((F.col("role") == "film") | both).withColumn("apart", apart).where(F.col("apart") <= YEAR_SLACK)
    named = F.min(F.when(F.col("dated"), F.struct("pos", "ref"))).alias("named")
    each = found.groupBy("row", "apart").agg(named, F.min("ref").alias("low"), F.max("ref").alias("high"))
    best = each.groupBy("row").agg(F.min(F.struct("apart", "named", "low", "high")).alias("b"))
    ref = F.coalesce("b.named.ref", F.when(F.col("b.low") == F.col("b.high"), F.col("b.low")))
    return best.select("row", ref.alias("ref")).where("ref is not null")


_END = re.compile(r"^(jr|sr|ii|iii|iv)$")


def author_keys(name: str) -> list[str]:
    """What two spellings of an author share: all letters, or the first and the last word."""
    plain = "".join(c for c in unicodedata.normalize("NFKD", name) if unicodedata.category(c)[0] != "M").lower()
    words, word = [], ""
    for c in plain + " ":
        if unicodedata.category(c)[0] in "LN":
            word += c
        elif word:
            words.append(word)
            word = ""
    whole = "".join(words)
    long = [w for w in words if len(w) > 1 and not _END.match(w)]
    ends = f"{long[0]} {long[-1]}" if len(long) > 1 else "".join(long)
    return [*([f"whole:{whole}"] if whole else []), *([f"ends:{ends}"] if ends else [])]


def _author_keys(name: str) -> Column:
    return F.pandas_udf(lambda names: names.map(lambda n: author_keys(n or "")), "array<string>")(name)


def book_rank(role: Column) -> Column:
    """A book before other writing before a series; what is on a screen is no book."""
    return F.when(role == "book", 0).when(role == "book series", 2).when(role.isin("screen", "film", "series"), None).otherwise(1)


def pick_books(rows: DataFrame, pages: DataFrame, facts: DataFrame) -> DataFrame:
    """(row, ref) of books (row, title, author): a guess's page whose author is the same by all letters or by the ends."""
    authors = rows.select("author").distinct().withColumn("keys", _author_keys("author"))
    names = facts.select(F.explode("authors").alias("name")).distinct().withColumn("keys", _author_keys("name"))
    written = facts.select("ref", "role", F.explode("authors").alias("name")).join(names, "name").select("ref", "role", F.explode("keys").alias("key"))
    guesses = rows.join(authors, "author").select("row", "keys", F.explode(book_guesses(F.col("title"), F.col("author"))).alias("title"))
    guesses = guesses.join(pages, "title").select("row", "ref", F.explode("keys").alias("key"))
    scored = guesses.join(written, ["ref", "key"]).select("row", "ref", book_rank(F.col("role")).alias("rank")).distinct()
    return one_or_nothing(scored.where("rank is not null"))


def pick_titles(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """(row, ref) of bare titles (row, title): the only entity of that label (title, ref, listed, rateable), or the only
    one that the service lists; it must be rateable."""
    found = rows.join(labels, "title").groupBy("row", "ref").agg(F.max("listed").alias("listed"), F.max("rateable").alias("rateable"))
    pick = F.struct("ref", "rateable")
    told = found.groupBy("row").agg(
        F.count("*").alias("n"), F.count(F.when(F.col("listed"), 1)).alias("held"), F.min(pick).alias("any"), F.min(F.when(F.col("listed"), pick)).alias("own")
    )
    told = told.withColumn("only", F.when(F.col("n") == 1, F.col("any")).when(F.col("held") == 1, F.col("own")))
    return told.where("only.rateable").select("row", "only.ref")


# -- places --------------------------------------------------------------------------------------------------
def _words(name: Column) -> Column:
    """The folded words of a name, with its punctuation and without, less a leading 'the'."""
    parts = lambda n: F.filter(F.split(trimmed(squeezed(F.lower(n))), " "), lambda w: w != "")
    every = F.array_distinct(F.concat(parts(name), parts(F.regexp_replace(name, r"\p{P}", " "))))
    return F.when(F.get(every, 0) == "the", F.slice(every, 2, 1 << 20)).otherwise(every)


def _spoken(name: Column) -> Column:
    words = F.filter(F.split(trimmed(squeezed(F.lower(F.regexp_replace(name, r"\p{P}", " ")))), " "), lambda w: w != "")
    return F.when(F.get(words, 0) == "the", F.slice(words, 2, 1 << 20)).otherwise(words)


def metres(lat: Column, lon: Column, lat2: Column, lon2: Column) -> Column:
    half = F.sin(F.radians(lat2 - lat) / 2) ** 2 + F.cos(F.radians(lat)) * F.cos(F.radians(lat2)) * F.sin(F.radians(lon2 - lon) / 2) ** 2
    return 2 * EARTH * F.asin(F.sqrt(half))


def _cells(height: float):
    """The row and column of the cells ``height`` degrees high; cells are at least as wide. By the parallel nearest to a pole
    in it or its neighbours, cells of one row are equally wide; within about 60 km of a pole a row is one cell."""
    row_of = lambda lat: F.floor(lat / height).cast("long")
    short = lambda k: F.cos(F.radians(F.least(F.greatest(F.abs(k), F.abs(k + 1)) * height + height, F.lit(90.0))))
    around = lambda k: F.when(short(k) < 0.01, 1).otherwise(F.floor(360.0 / height * short(k))).cast("long")
    column = lambda lon, k: F.least(F.floor((lon + 180) / 360 * around(k)).cast("long"), around(k) - 1)
    return row_of, around, column


def _within(rows: DataFrame, places: DataFrame, height: float, reach: float) -> DataFrame:
    """``rows`` (row, kind, words, lat1, lon1) with each of ``places`` (kind, words, lat, lon, ...) of the same kind and words
    that lies in the nine cells around and within ``reach``, and how far ``apart``."""
    row_of, around, column = _cells(height)
    here = rows.withColumn("ky", F.explode(F.sequence(row_of(F.col("lat1")) - 1, row_of(F.col("lat1")) + 1)))
    here = here.withColumn("kx", F.explode(F.array_distinct(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda d: F.pmod(column(F.col("lon1"), F.col("ky")) + d, around(F.col("ky")))))))
    there = places.withColumn("ky", row_of(F.col("lat"))).withColumn("kx", column(F.col("lon"), F.col("ky")))
    near = here.join(there, ["kx", "ky", "kind", "words"]).withColumn("apart", metres(F.col("lat1"), F.col("lon1"), F.col("lat"), F.col("lon")))
    return near.where(F.col("apart") <= reach)


def pick_places(rows: DataFrame, places: DataFrame, reach: float = REACH_METRES) -> DataFrame:
    """(row, ref) of places (row, name, lat, lon) among ``places`` (ref, name, lat, lon) within ``reach``: the nearest of
    those with the same set of words, or else the only one whose words begin the row's.

    Both meet by words in cells, so high that the nine around a row hold all within ``reach``. Where places stand dense, rows
    ask a finer grid first: one that finds its own words nearer than a cell is high, or two places that begin it, is answered
    and not asked again, so that no row meets many more places than there are in a cell. Longitudes close round at
    180 degrees."""
    height = max(CELL, reach / 111_000 * 1.01)
    same, leads = F.lit("same"), F.lit("leads")
    whole = lambda name: F.array_sort(_words(F.col(name)))
    # places of the same words on one spot are one: the first, and how many
    there = places.select("ref", "lat", "lon", F.explode(F.array(F.struct(same.alias("kind"), whole("name").alias("words")), F.struct(leads.alias("kind"), _spoken(F.col("name")).alias("words")))).alias("w"))
    there = there.select("ref", "lat", "lon", "w.*").where("size(words) > 0").groupBy("kind", "words", "lat", "lon").agg(F.min("ref").alias("ref"), F.count("*").alias("n"))
    there = store.save(there, "places")
    spoken = _spoken(F.col("name"))
    begun = F.transform(F.sequence(F.lit(1), F.greatest(F.size(spoken) - 1, F.lit(1))), lambda k: F.struct(leads.alias("kind"), F.slice(spoken, 1, k).alias("words")))
    asked = F.concat(F.array(F.struct(same.alias("kind"), whole("name").alias("words"))), F.when(F.size(spoken) > 1, begun).otherwise(F.slice(begun, 1, 0)))
    left = rows.select("row", F.col("lat").alias("lat1"), F.col("lon").alias("lon1"), F.explode(asked).alias("w")).select("row", "lat1", "lon1", "w.*").where("size(words) > 0")
    row_of, _, column = _cells(height)
    ky = row_of(F.col("lat"))
    most = there.groupBy("kind", "words", ky.alias("ky"), column(F.col("lon"), ky).alias("kx")).count().agg(F.max("count")).first()[0] or 0
    finer = 0
    while finer < FINEST and most > CROWD * 16**finer:
        finer += 1
    answers = []
    for k in range(finer, -1, -1):
        near = _within(left, there, height / 4**k, reach)
        told = near.groupBy("row", "kind").agg(F.min(F.struct("apart", "ref")).alias("nearest"), F.sum("n").alias("n"), F.min("ref").alias("only"))
        if k:
            # a cell is a little higher than what its neighbours hold for certain
            done = F.when(F.col("kind") == "same", F.col("nearest.apart") <= height / 4**k * 111_000 / 1.01).otherwise(F.col("n") > 1)
            told = store.save(told.where(done), f"places-{k}")
            over = told.select(F.col("row").alias("r"), F.col("kind").alias("k"))
            left = store.save(left.join(over, F.col("row").eqNullSafe(F.col("r")) & (F.col("kind") == F.col("k")), "left_anti"), f"places-left-{k}")
        answers.append(told.select("row", "kind", "nearest", "n", "only"))
    told = reduce(DataFrame.unionByName, answers).groupBy("row").agg(
        F.max(F.when(F.col("kind") == "same", F.col("nearest.ref"))).alias("nearest"), F.max(F.when((F.col("kind") == "leads") & (F.col("n") == 1), F.col("only"))).alias("only")
    )
    return told.select("row", F.coalesce("nearest", "only").alias("ref")).where("ref is not null")


# -- the catalog -----------------------------------------------------------------------------------------------
def classify(candidates: DataFrame, items: DataFrame, links: DataFrame, beside: tuple[str, ...] = ()) -> DataFrame:
    """(search, pos, item_id, kind) of candidates (search, pos, source, ref, names) against names (id) and links
    (item_id, source, ref): the name that holds the link ('existing'), else the first name not yet there ('free') or
    there without a link ('plain'), else nothing. Of a search's candidates for one name the first stays, with its
    columns ``beside``.

    What names are is worked out once for each list of names, and written: a catalog is often small beside the candidates,
    which then stay where they are."""
    held = store.save(links.select("source", "ref", F.col("item_id").alias("held")), "classify-held")
    lists = candidates.select("names").distinct().select("names", F.posexplode("names").alias("k", "name"))
    known = items.select(F.col("id").alias("name"), F.lit(True).alias("there")).distinct()
    linked = links.select(F.col("item_id").alias("name"), F.lit(True).alias("linked")).distinct()
    kind = F.when(F.col("there").isNull(), "free").when(F.col("linked").isNull(), "plain")
    lists = lists.join(known, "name", "left").join(linked, "name", "left").withColumn("kind", kind).where("kind is not null")
    first = store.save(lists.groupBy("names").agg(F.min(F.struct("k", "name", "kind")).alias("f")), "classify-names")
    rows = candidates.join(held, ["source", "ref"], "left").join(first, "names", "left").where("held is not null or f is not null")
    item, kind = F.coalesce("held", "f.name"), F.when(F.col("held").isNotNull(), "existing").otherwise(F.col("f.kind"))
    found = rows.select("search", "pos", item.alias("item_id"), kind.alias("kind"), *beside)
    found = found.groupBy("search", "item_id").agg(F.min(F.struct("pos", "kind", *beside)).alias("f"))
    return found.select("search", "f.pos", "item_id", "f.kind", *(F.col(f"f.{c}") for c in beside))


def lookalikes(typed: DataFrame, items: DataFrame) -> DataFrame:
    """(name, id): for each typed name the first id, in byte order, that looks like it. A name is folded first; one that is
    itself an id, or nothing, looks like none. Each name is folded once."""
    look = text.column(text.skeleton)
    left = typed.select("name").distinct().withColumn("folded", text.column(text.fold_id)("name")).where("folded <> ''")
    left = left.join(items.select(F.col("id").alias("folded")).distinct(), "folded", "left_anti").withColumn("look", look("folded"))
    right = items.select("id").distinct().withColumn("look", look("id")).groupBy("look").agg(F.min("id").alias("id"))
    return left.join(right, "look").select("name", "id")
