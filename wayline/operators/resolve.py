"""Entity resolution: names to a table of names, houses to streets, ways to streets, and points to localities."""

from __future__ import annotations

from functools import reduce
from math import cos, floor, hypot, radians

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayline.functions import geo, text
from wayline.operators import areas
from wayline.operators.carried import scan
from wayline.operators.distance import first_by, within
from wayline.operators.stages import dropped, tabled

#: Short forms and numerals of the names' words, words for the kind of street, and others that name nothing.
SHORT = {"წმ": "წმინდა", "გენ": "გენერალ", "ქ": "ქუჩა", "ქუჩ": "ქუჩა", "აკად": "აკადემიკოს", "გამზ": "გამზირი", "შეს": "შესახვევი"}
ROMAN = {"i": "1", "ii": "2", "iii": "3", "iv": "4", "v": "5", "vi": "6", "vii": "7", "viii": "8", "ix": "9", "x": "10"}
TYPES = ("ქუჩა", "გამზირი", "გამზირ", "ჩიხი", "ჩიხ", "შესახვევი", "შესახვევ", "მოედანი", "მოედან", "გზატკეცილი", "გზატკეცილ", "street", "ave", "st")
TYPE_ALIAS = {"ქ": "ქუჩა", "ქუჩ": "ქუჩა", "street": "ქუჩა", "st": "ქუჩა", "ave": "გამზირი"}
EMPTY = ("და",)
MOST_EDITS = 3


def tokens(name: Column) -> Column:
    """Words of a name without its house number, short forms written out, numerals as digits."""
    base = text.house_number(text.table_key(name))[0]
    flat = F.lower(F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(base, r"[^\p{L}\p{N}\s-]", " "), r"[‐-―]", "-"), r"\s+", " ")))
    flat = F.regexp_replace(flat, r"\s+\d+[Ⴀ-ჿa-z]*$", "")
    known = F.create_map(*(F.lit(x) for pair in (SHORT | ROMAN).items() for x in pair))
    ordinal = lambda t: F.regexp_replace(t, r"^მე-?(\d+)$", "$1")
    return F.transform(F.filter(F.split(flat, " "), lambda t: t != ""), lambda t: F.coalesce(F.try_element_at(known, t), ordinal(t)))


def stem(word: Column) -> Column:
    n = F.length(word)
    cut = lambda k: F.substring(word, F.lit(1), n - k)
    return F.when((n > 4) & word.rlike("ის$"), cut(2)).when((n > 3) & word.rlike("[იეს]$"), cut(1)).otherwise(word)


def with_keys(df: DataFrame, name: str, prefix: str = "") -> DataFrame:
    """Adds the keys a name is compared by: near, sorted, stems, stem, digits and type."""
    t = F.col(f"{prefix}tokens")
    df = df.withColumn(f"{prefix}tokens", tokens(F.col(name)))
    content = F.filter(t, lambda x: ~x.isin(*TYPES, *EMPTY) & (F.length(x) > 2))
    kind = F.get(F.filter(t, lambda x: x.isin(*TYPES)), F.lit(0))
    alias = F.create_map(*(F.lit(x) for pair in TYPE_ALIAS.items() for x in pair))
    df = df.withColumn(f"{prefix}stems", F.array_sort(F.filter(F.transform(content, stem), lambda x: F.length(x) > 2)))
    return df.withColumns({
        f"{prefix}near": F.array_join(t, " "), f"{prefix}sorted": F.array_join(F.array_sort(t), " "), f"{prefix}stem": F.array_join(f"{prefix}stems", ""),
        f"{prefix}digits": F.array_join(F.array_sort(F.flatten(F.transform(t, lambda x: F.regexp_extract_all(x, F.lit(r"(\d+)"))))), ","),
        f"{prefix}type": F.coalesce(F.try_element_at(alias, kind), kind),
    }).drop(f"{prefix}tokens")


def loose(names: DataFrame, known: DataFrame) -> DataFrame:
    """The best known name that shares words, where one side holds all of the other's: name, k_id, score."""
    pairs = names.select("name", "digits", F.explode(F.array_distinct("stems")).alias("_s")).join(known.select("k_id", F.col("k_digits").alias("digits"), F.explode(F.array_distinct("k_stems")).alias("_s")), ["digits", "_s"])
    pairs = pairs.select("name", "k_id").distinct().join(names.select("name", "stems", "type"), "name").join(known.select("k_id", "k_stems", "k_type", "ru", "n"), "k_id")
    own, other = F.size("stems"), F.size("k_stems")
    shared = F.size(F.filter("stems", lambda s: F.array_contains("k_stems", s)))
    typed = F.when(F.col("type").isNull() | F.col("k_type").isNull(), 0).when(F.col("type") == F.col("k_type"), 50).otherwise(-40)
    score = shared * 100 - (own - shared) * 40 - (other - shared) * 40 + typed + F.when(F.col("ru").isNotNull(), 5).otherwise(0)
    pairs = pairs.withColumn("score", score.cast("bigint")).where((shared == own) | (shared == other)).where("score >= 60")
    return first_by(pairs, ["name"], F.col("score").desc(), "k_id").select("name", "k_id", "score")


def pieces(key: Column, length: Column, at: int) -> tuple[Column, Column]:
    """Start (from 1) and size of one of the four pieces that a key of a length is cut into."""
    begin = F.floor(length * at / (MOST_EDITS + 1)).cast("int")
    return begin + 1, F.floor(length * (at + 1) / (MOST_EDITS + 1)).cast("int") - begin


def fuzzy(names: DataFrame, known: DataFrame) -> DataFrame:
    """The known name nearest in letters, within 1, 2 or 3 edits by length: name, k_id, score.

    Of four pieces of a key one is untouched by three edits, and moved by three places at most: an equi-join of pieces.
    """
    n = F.length("k_stem")
    shifts = range(-MOST_EDITS, MOST_EDITS + 1)
    cut = [F.struct(n.alias("n"), F.lit(i).alias("i"), F.substring(F.col("k_stem"), *pieces(F.col("k_stem"), n, i)).alias("p")) for i in range(MOST_EDITS + 1)]
    indexed = known.where(n > 0).select("k_id", "k_stem", F.col("k_digits").alias("digits"), "ru", F.explode(F.array(*cut)).alias("key"))
    m = F.length("stem")

    def asked(length: Column) -> Column:
        found = []
        for i in range(MOST_EDITS + 1):
            begin, size = pieces(F.col("stem"), length, i)
            found += [F.struct(length.alias("n"), F.lit(i).alias("i"), F.when(begin + s >= 1, F.substring(F.col("stem"), begin + s, size)).alias("p")) for s in shifts]
        return F.array(*found)

    keys = F.explode(F.array_distinct(F.flatten(F.transform(F.sequence(F.greatest(m - MOST_EDITS, F.lit(1)), m + MOST_EDITS), asked))))
    pairs = names.where(m >= 6).select("name", "stem", "digits", keys.alias("key")).join(indexed, ["digits", "key"]).select("name", "k_id", "stem", "k_stem", "ru").distinct()
    edits = F.levenshtein("stem", "k_stem", MOST_EDITS)
    budget = F.when(m <= 10, 1).when(m <= 18, 2).otherwise(3)
    pairs = pairs.withColumn("edits", edits).where((F.col("edits") >= 0) & (F.col("edits") <= budget))
    pairs = pairs.withColumn("score", (-10 * F.col("edits") + F.when(F.col("ru").isNotNull(), 1).otherwise(0)).cast("bigint"))
    return first_by(pairs, ["name"], F.col("score").desc(), "k_id").select("name", "k_id", "score")


def match_names(names: DataFrame, known: DataFrame) -> DataFrame:
    """The known name of each name and the tier that found it, closest first: name, k_id, tier.

    names: name; known: k_id, k_name, ru (nullable), n. Of known names with one key that with ru, then the more frequent,
    is meant. A hit without ru gives way to a looser one with it.
    """
    asked = with_keys(names.select("name").distinct(), "name")
    have = with_keys(known, "k_name", "k_")
    tiers = []
    for rank, (tier, own, other) in enumerate((("exact", "name", "k_name"), ("near", "near", "k_near"), ("reorder", "sorted", "k_sorted"), ("stem", "stem", "k_stem"))):
        one = first_by(have.where(F.col(other) != ""), [other], F.col("ru").isNull(), F.col("n").desc(), "k_id").select("k_id", F.col(other).alias("_k"), F.col("k_digits"))
        hit = asked.join(one, F.col(own) == F.col("_k"))
        hit = hit.where(F.col("digits") == F.col("k_digits")) if tier == "stem" else hit
        tiers.append(hit.select("name", "k_id", F.lit(tier).alias("tier"), F.lit(rank).alias("rank")))
    looser = lambda which: [loose(asked, which).select("name", "k_id", F.lit("loose").alias("tier"), F.lit(4).alias("rank")), fuzzy(asked, which).select("name", "k_id", F.lit("fuzzy").alias("tier"), F.lit(5).alias("rank"))]
    first = lambda parts: first_by(reduce(DataFrame.unionByName, parts), ["name"], "rank")
    hit = first([*tiers, *looser(have)]).join(have.select("k_id", "ru"), "k_id")
    other = first(looser(have.where("ru is not null"))).select("name", F.col("k_id").alias("o_id"))
    both = hit.join(other, "name", "left")
    swap = F.col("ru").isNull() & F.col("o_id").isNotNull()
    return both.select("name", F.when(swap, F.col("o_id")).otherwise(F.col("k_id")).alias("k_id"), F.when(swap, F.concat("tier", F.lit("/loose"))).otherwise(F.col("tier")).alias("tier"))


def overridden(rows: DataFrame, key: str, column: str, by_hand: DataFrame) -> DataFrame:
    """The rows with ``column`` as someone wrote it by hand where they did. by_hand: key (each once), column; null ones change nothing."""
    own = by_hand.select(F.col(key), F.col(column).alias("_by_hand"))
    return rows.join(own, key, "left").select(*(F.coalesce("_by_hand", column).alias(column) if c == column else c for c in rows.columns))


def coverage(matches: DataFrame, tier: str, named: Column) -> DataFrame:
    """Of each tier of matches how many there are (``n``) and how many have a name (``named``)."""
    return matches.groupBy(tier).agg(F.count("*").alias("n"), F.count_if(named).alias("named"))


def script_gate(rows: DataFrame, group: str, name: Column, letters: str, share: float) -> DataFrame:
    """Of each group the number of names, of those with such letters (``marked``), and whether these are share enough (``passes``)."""
    counted = rows.groupBy(group).agg(F.count("*").alias("n"), F.count_if(name.rlike(letters)).alias("marked"))
    return counted.withColumn("passes", F.col("marked") >= share * F.col("n"))


def clusters(points: DataFrame, metres: float) -> DataFrame:
    """Points of one name that chains of short hops connect: point_id, name, cluster (its smallest point).

    points: point_id (one row each), name, lat, lon. Every cluster takes the smallest label of those that links lead to,
    and then that label's own, until no link stands between two; a chain of n points takes some log n rounds.
    """
    other = points.select(F.col("point_id").alias("r_id"), "name", F.col("lat").alias("r_lat"), F.col("lon").alias("r_lon"))
    links = tabled(within(points, other, metres, ["name"]).where("point_id < r_id").select("point_id", "r_id"))
    now = tabled(points.select("point_id", "name", F.col("point_id").alias("cluster")))
    while True:
        label = now.select("point_id", "cluster")
        ends = links.join(label, "point_id").join(label.select(F.col("point_id").alias("r_id"), F.col("cluster").alias("other")), "r_id")
        hooks = ends.where("cluster <> other").groupBy(F.greatest("cluster", "other").alias("cluster")).agg(F.min(F.least("cluster", "other")).alias("_less"))
        hooks = tabled(hooks)
        if hooks.isEmpty():
            dropped(hooks, links)
            return now
        after = now.join(hooks, "cluster", "left").select("point_id", "name", F.coalesce("_less", "cluster").alias("cluster"))
        # a label's own label is a shorter way to its smallest point
        own = after.select(F.col("point_id").alias("cluster"), F.col("cluster").alias("_own"))
        done = tabled(after.join(own, "cluster").select("point_id", "name", F.col("_own").alias("cluster")))
        dropped(hooks, now)
        now = done


def localities(points: DataFrame, boxes: DataFrame, villages: DataFrame, reach: float = 2500) -> DataFrame:
    """The locality of each point: the box that holds it (districts before towns), else the nearest village within reach, else a municipality's box, else -1.

    points: point_id, lat, lon; boxes: area_id, level (10, 8 or 6), south, north, west, east; villages: area_id, r_lat, r_lon.
    """
    return localities_in(points, areas.in_boxes(points, boxes), villages, reach)


def localities_of_areas(points: DataFrame, edges: DataFrame, levels: DataFrame, villages: DataFrame, reach: float = 2500) -> DataFrame:
    """The same by borders: edges as in ``areas``; levels: area_id, level."""
    return localities_in(points, areas.holding(points, edges).join(levels, "area_id"), villages, reach)


def localities_in(points: DataFrame, inside: DataFrame, villages: DataFrame, reach: float) -> DataFrame:
    """Of the districts and towns that hold a point that of the highest level, then of the least id; else the nearest village within reach,
    else a municipality, else -1. inside: point_id, area_id, level."""
    held = first_by(inside, ["point_id"], F.col("level").desc(), "area_id").select("point_id", F.col("area_id").alias("held"), "level")
    near = first_by(within(points.select("point_id", "lat", "lon"), villages.withColumnRenamed("area_id", "v_id"), reach), ["point_id"], F.round("metres", 3), "v_id").select("point_id", F.col("v_id").alias("village"))
    all_ = points.select("point_id").join(held, "point_id", "left").join(near, "point_id", "left")
    return all_.select("point_id", F.coalesce(F.when(F.col("level") >= 8, F.col("held")), "village", "held", F.lit(-1)).alias("area_id"))


def spread(rows: DataFrame, keys: list[str], order: str, metres: float) -> DataFrame:
    """Rows of each key that no kept row before them is nearer to than that, in order; with keys, order, lat and lon.

    A scan that carries a key's kept rows, in cells at least that wide, so that a row is compared with those around it only.
    """
    size = metres / geo.METRES_PER_DEGREE

    def band_width(y: int) -> float:
        poleward = min(89.9, (abs(y + 0.5) + 1.5) * size)
        return size / cos(radians(poleward))

    def near(a: tuple[float, float], b: tuple[float, float]) -> bool:
        east = (b[1] - a[1]) * geo.METRES_PER_DEGREE * cos(radians((a[0] + b[0]) / 2))
        return hypot(east, (b[0] - a[0]) * geo.METRES_PER_DEGREE) < metres

    def put(cells: dict, at: tuple[float, float]) -> None:
        y = floor(at[0] / size)
        cells.setdefault((y, floor(at[1] / band_width(y))), []).append(at)

    def step(cells: dict | None, row: tuple) -> tuple[dict, tuple]:
        cells, at = {} if cells is None else cells, (row[1], row[2])
        y = floor(at[0] / size)
        for band in (y - 1, y, y + 1):
            x = floor(at[1] / band_width(band))
            if any(near(k, at) for c in (x - 1, x, x + 1) for k in cells.get((band, c), ())):
                return cells, (*at, False)
        put(cells, at)
        return cells, (*at, True)

    def thaw(state: tuple) -> dict:
        cells: dict = {}
        for lat, lon in state[0]:
            put(cells, (lat, lon))
        return cells

    freeze = lambda cells: ([list(k) for kept in cells.values() for k in kept],)
    keyed = rows.select(F.struct(*keys).alias("_key"), order, "lat", "lon")
    found = scan(keyed, "_key", [order], ["lat", "lon"], step, "kept array<array<double>>", "lat double, lon double, is_kept boolean", thaw, freeze)
    return found.where("is_kept").select("_key.*", order, "lat", "lon")
