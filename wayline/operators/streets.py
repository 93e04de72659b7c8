"""Streets of houses: keys that two spellings of a street share, and streets that grow with the houses that name them.

A house belongs to the nearest street of its very name, else to one nearby of another spelling, else of a translated name,
else to a new street. New streets are there for later houses of the name, and reach as far as their houses do. That order is
kept without going house by house: which houses become points of new streets follows from those that surely do, in rounds; then
each takes the nearest before it, and chains of these lead to the house that a street began with.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wayline.functions import geo, text
from wayline.operators.distance import within
from wayline.operators.stages import dropped, tabled

#: Short forms, numerals, words for the kind of street, others that name nothing, and kinds that may be left out.
SHORT = {
    "ქ": "ქუჩა", "ქუჩ": "ქუჩა", "გამზ": "გამზირი", "შეს": "შესახვევი", "ჩას": "შესახვევი", "ჩასახვევი": "შესახვევი", "წმ": "წმინდა", "გენ": "გენერალ", "გენერალი": "გენერალ", "აკად": "აკადემიკოს",
}
ROMAN = {"i": 1, "ii": 2, "iii": 3, "iv": 4, "v": 5, "vi": 6, "vii": 7, "viii": 8, "ix": 9, "x": 10}
KINDS = ("ქუჩა", "გამზირი", "ჩიხი", "შესახვევი", "მოედანი", "გზატკეცილი", "ხეივანი", "აღმართი", "სანაპირო")
FILLER = ("ქუჩის", "გამზირის", "და")
USUAL = ("ქუჩა", "გამზირი")
NUMBER = r"^(?:მე-?)?(\d+)(?:-?(?:ლი|ე|ს))?$"
#: Metres within which a street of the very name, and one of another spelling, is meant.
REACH, SPELLING_REACH = 1500.0, 400.0
#: Radii in which the nearest earlier house is looked for, so that few pairs are made where houses are dense.
RADII = (100.0, 400.0, REACH)
#: A little more than a radius on the globe, as distances here are in the plane.
MARGIN = 1.01


def stem(word: Column) -> Column:
    n = F.length(word)
    cut = lambda k: F.substring(word, F.lit(1), n - k)
    return F.when((n > 4) & word.rlike("(ის|ას|ეს)$"), cut(2)).when((n > 3) & word.rlike("[იესა]$"), cut(1)).otherwise(word)


def street_key(name: Column) -> Column:
    """A struct of the kind of street (the last word for one, or null), its numbers in order, and the stems of its other words, sorted."""
    known = lambda values: F.create_map(*(F.lit(x) for pair in values.items() for x in pair))
    raw = F.filter(F.split(F.regexp_replace(F.lower(name), r"""[.,()«»"']""", " "), r"\s+"), lambda w: w != "")
    words = F.transform(raw, lambda w: F.coalesce(F.try_element_at(known(SHORT), w), w))
    number = lambda w: F.coalesce(F.try_element_at(known(ROMAN), w).cast("decimal(38,0)"), F.nullif(F.regexp_extract(w, NUMBER, 1), F.lit("")).try_cast("decimal(38,0)"))
    numbers = F.array_sort(F.filter(F.transform(words, number), lambda x: x.isNotNull()))
    rest = F.filter(words, lambda w: number(w).isNull())
    kinds = F.filter(rest, lambda w: w.isin(*KINDS))
    stems = F.transform(F.filter(rest, lambda w: ~w.isin(*KINDS, *FILLER)), stem)
    return F.struct(F.get(kinds, F.size(kinds) - 1).alias("kind"), F.array_join(F.transform(numbers, lambda x: x.cast("string")), ",").alias("numbers"), F.array_sort(stems).alias("stems"))


def covers(a: Column, b: Column) -> Column:
    """Two arrays of words: each of the shorter is one of the longer's, or of five letters and more and two edits from it."""
    close = lambda x, y: (x == y) | ((F.least(F.length(x), F.length(y)) >= 5) & (F.levenshtein(x, y, 2) >= 0))
    all_in = lambda short, long: F.forall(short, lambda x: F.exists(long, lambda y: close(x, y)))
    return F.when(F.least(F.size(a), F.size(b)) == 0, False).when(F.size(a) <= F.size(b), all_in(a, b)).otherwise(all_in(b, a))


def same_street(a: Column, b: Column) -> Column:
    """Two keys: one kind, which a street or an avenue may leave out, the same numbers, and words that cover the other's."""
    kinds = a["kind"].eqNullSafe(b["kind"]) | ((a["kind"].isNull() | b["kind"].isNull()) & F.coalesce(a["kind"], b["kind"]).isin(*USUAL))
    return kinds & (a["numbers"] == b["numbers"]) & covers(a["stems"], b["stems"])


def same_words(a: Column, b: Column) -> Column:
    """Two translated names: the same numbers, and words that cover the other's."""
    own, other = text.translated_words(a), text.translated_words(b)
    is_number = lambda w: w.rlike(r"^\d")
    numbers = lambda words: F.array_join(F.filter(words, is_number), ",")
    rest = lambda words: F.filter(words, lambda w: ~is_number(w))
    return (numbers(own) == numbers(other)) & covers(rest(own), rest(other))


def apart() -> Column:
    return F.round(geo.flat_metres(F.col("lat"), F.col("lon"), F.col("r_lat"), F.col("r_lon")), 3)


def drawn(houses: DataFrame, vertices: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The nearest drawn street of each house's very name; and for the other houses the nearest of another spelling, else of a translated name.

    Both: house_id, street_id, metres, how. Of equally near streets the least id.
    """
    best = lambda df: df.groupBy("house_id").agg(F.min(F.struct("how", "metres", "street_id")).alias("b")).select("house_id", "b.street_id", "b.metres", "b.how")  # noqa: E731  respelled comes before translated
    own = within(houses, vertices.select("street_id", F.col("s_name").alias("name"), "r_lat", "r_lon"), REACH * MARGIN, ["name"])
    exact = best(own.withColumns({"metres": apart(), "how": F.lit("exact")}).where(F.col("metres") < REACH))
    rest = houses.join(exact.select("house_id"), "house_id", "left_anti").withColumn("key", street_key(F.col("name")))
    near = within(rest, vertices.select("street_id", "r_lat", "r_lon"), SPELLING_REACH * MARGIN).withColumn("metres", apart()).where(F.col("metres") < SPELLING_REACH)
    streets = vertices.groupBy("street_id").agg(*(F.first(c).alias(c) for c in ("s_name", "s_ru", "s_en"))).withColumn("s_key", street_key(F.col("s_name")))
    both = near.groupBy("house_id", "name", "key", "street_id").agg(F.min("metres").alias("metres")).join(streets, "street_id")
    translated = F.when(F.col("name").rlike("[ა-ჰ]"), False).otherwise(same_words(F.col("name"), F.when(F.col("name").rlike("(?i)[а-яё]"), F.col("s_ru")).otherwise(F.col("s_en"))))
    how = F.when(same_street(F.col("key"), F.col("s_key")), "respelled").when(translated, "translated")
    like = best(both.withColumn("how", how).where("how is not null"))
    return exact, like


def points_of_new(rest: DataFrame, limited: DataFrame) -> DataFrame:
    """house_id, name, lat, lon, limit of all houses that become points of new streets.

    rest: those that have no drawn street, which all do; limited: the others, which do if one before them is nearer than ``limit``.
    """
    found = tabled(rest)
    tables, frontier = [found], found
    pending = tabled(limited.join(rest.select("name").distinct(), "name", "left_semi"))
    while True:
        later = pending.select(F.col("house_id").alias("r_id"), "name", F.col("lat").alias("r_lat"), F.col("lon").alias("r_lon"), F.col("limit").alias("r_limit"))
        joined = within(frontier, later, REACH * MARGIN, ["name"]).where((F.col("house_id") < F.col("r_id")) & (apart() < F.col("r_limit"))).select(F.col("r_id").alias("house_id")).distinct()
        frontier = tabled(pending.join(joined, "house_id", "left_semi").select(*found.columns))
        if frontier.isEmpty():
            dropped(frontier, pending)
            break
        tables.append(frontier)
        left = tabled(pending.join(frontier.select("house_id"), "house_id", "left_anti"))
        dropped(pending)
        pending = left
    every = tables[0]
    for more in tables[1:]:
        every = every.unionByName(more)
    result = tabled(every)
    dropped(*tables)
    return result


def nearest_before(points: DataFrame) -> DataFrame:
    """house_id, at: the nearest earlier point of the name, nearer than ``limit``; all of equally near ones. Looked for in growing radii."""
    parts, left = [], points
    for radius in RADII:
        earlier = points.select(F.col("house_id").alias("at"), "name", F.col("lat").alias("r_lat"), F.col("lon").alias("r_lon"))
        pairs = within(left, earlier, radius * MARGIN, ["name"]).where("at < house_id").withColumn("metres", apart()).where(F.col("metres") < F.least(F.lit(radius), F.col("limit")))
        least = F.min("metres").over(Window.partitionBy("house_id"))
        found = tabled(pairs.withColumn("least", least).where("metres = least").select("house_id", "at"))
        parts.append(found)
        left = left.join(found.select("house_id"), "house_id", "left_anti")
    every = tabled(parts[0].unionByName(parts[1]).unionByName(parts[2]))
    dropped(*parts)
    return every


def roots(links: DataFrame) -> DataFrame:
    """house_id, root: the least of the ends that chains of links lead to, halved every round."""
    now = links
    while True:
        ahead = now.select(F.col("house_id").alias("at"), F.col("at").alias("next"))
        after = tabled(now.join(ahead, "at", "left").select("house_id", F.coalesce("next", "at").alias("at"), F.col("next").isNotNull().alias("moved")).distinct())
        dropped(now)
        if after.where("moved").isEmpty():
            return after.groupBy("house_id").agg(F.min("at").alias("root"))
        now = after.drop("moved").distinct()


def streets_of(houses: DataFrame, vertices: DataFrame) -> DataFrame:
    """``house_id``, ``name``, ``street_id`` and ``how``: exact, respelled, translated, new (the house that a new street begins with) or joined.

    houses: house_id (whole numbers of one row each; the order in which streets grow), name, lat, lon. vertices: street_id (from 0), s_name,
    s_ru, s_en (nullable), r_lat, r_lon. A new street's id is -1 less the id of the house that it begins with. Of equally near streets the
    drawn one is meant, then that which began first.
    """
    houses = houses.select("house_id", "name", "lat", "lon")
    exact, like = (tabled(x) for x in drawn(houses, vertices))
    told = exact.withColumn("limit", F.col("metres")).unionByName(like.withColumn("limit", F.lit(REACH)))
    rest = houses.join(told.select("house_id"), "house_id", "left_anti").withColumn("limit", F.lit(REACH))
    points = points_of_new(rest, houses.join(told.select("house_id", "limit"), "house_id"))
    root = roots(nearest_before(points))
    grown = points.select("house_id").join(root, "house_id", "left")
    grown = grown.select("house_id", (-1 - F.coalesce("root", "house_id")).alias("n_id"), F.when(F.col("root").isNull(), "new").otherwise("joined").alias("n_how"))
    both = houses.join(told.select("house_id", "street_id", "how"), "house_id", "left").join(grown, "house_id", "left")
    return both.select("house_id", "name", F.coalesce("n_id", "street_id").cast("bigint").alias("street_id"), F.coalesce("n_how", "how").alias("how"))
