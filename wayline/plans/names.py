"""Queries on names: folding, transliteration, search, and entity resolution."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wayline.functions import text
from wayline.operators import resolve, search
from wayline.operators.streets import same_words, streets_of
from wayline.operators.stages import shared_folder
from wayline.plans.base import query
from wayline.sources.names import first_filled, latin_only, looked_up, read_names
from wayline.sources.tables import stop_legs, table


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size", "p_brand", "p_type")


def key() -> Column:
    return F.col("p_partkey")


#: Names in three scripts: Georgian and Cyrillic words stand where the tables have none.
TRILINGUAL = ("რუსთაველის ქუჩა #14", "მე-18 საჯარო სკოლა", "ჯავახიშვილის გამზირი", "ძველი ბაზარი და პარკი", "Hotel Adjara", "26 მაისის მოედანი", "")


@query("t20_clean", "select p_partkey, trim(regexp_replace(trim(regexp_replace('  ' || replace(p_name, ' ', '   ') || case when p_partkey % 3 = 0 then ' #' when p_partkey % 3 = 1 then '№ ' else ' №4' end, '\\s+', ' ', 'g')), '[№#]\\s*$', '')) as name from part")
def t20(spark: SparkSession, sf_dir: str) -> DataFrame:
    end = F.when(key() % 3 == 0, " #").when(key() % 3 == 1, "№ ").otherwise(" №4")
    return parts(spark, sf_dir).select("p_partkey", text.clean(F.concat(F.lit("  "), F.replace("p_name", F.lit(" "), F.lit("   ")), end)).alias("name"))


@query("t21_strip_code", "select p_partkey, case when p_partkey % 2 = 0 then p_name else (p_partkey + 1) || ' ' || p_name end as name from part")
def t21(spark: SparkSession, sf_dir: str) -> DataFrame:
    full = F.concat_ws(" ", F.when(key() % 2 == 0, key()).otherwise(key() + 1), "p_name")
    return parts(spark, sf_dir).select("p_partkey", text.strip_code(full, key()).alias("name"))


@query("t22_localised", "select p_partkey, case when p_partkey % 3 = 0 then 'known' when p_partkey % 3 = 1 then p_name else 'x' || p_partkey end as en, case when p_partkey % 3 = 0 then 'known' else 'x' || p_partkey end as other from part")
def t22(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table's name, else a Latin one from the feed, else the name as it is."""
    known = F.when(key() % 3 == 0, "known")
    latin = F.when(key() % 3 == 1, F.col("p_name")).otherwise("რუსთაველი")
    own = F.concat(F.lit("x"), key().cast("string"))
    return parts(spark, sf_dir).select("p_partkey", first_filled(known, latin_only(latin), own).alias("en"), first_filled(known, own).alias("other"))


@query("t23_table_key", "select p_partkey, replace(p_name, ' ', '№ ') as k from part")
def t23(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parts(spark, sf_dir).select("p_partkey", text.table_key(F.concat(F.lit(" "), F.replace("p_name", F.lit(" "), F.lit("#  ")), F.lit(" "))).alias("k"))


@query("t24_lookup_name", "select p_partkey, case when p_size % 4 = 0 then null when p_partkey % 2 = 0 then 'ru-' || p_name || ' №' || p_size else 'ru-' || p_name end as ru from part")
def t24(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A name's translation by the whole name, or without its house number, which is put back."""
    full = F.concat("p_name", F.when(key() % 2 == 0, F.concat(F.lit(" №"), F.col("p_size").cast("string"))).otherwise(""))
    names = parts(spark, sf_dir).select(F.col("p_name").alias("key"), F.concat(F.lit("ru-"), "p_name").alias("ru"), F.lit(None).cast("string").alias("en")).distinct()
    found = looked_up(parts(spark, sf_dir).withColumn("full", full), "full", names)
    return found.select("p_partkey", F.when(F.col("p_size") % 4 != 0, F.col("ru")).alias("ru"))


@query("s12_names_table", """with known as (select p_name as k, min(p_partkey) as n from part group by p_name),
asked as (select p_partkey, p_name, p_size, case p_partkey % 4 when 0 then null when 3 then p_size || 'ა' else cast(p_size as varchar) end as num, p_partkey % 5 = 0 as other from part)
select p_partkey,
  case when other or n % 3 = 0 then null when num is null then 'ru-' || p_name when p_partkey % 4 = 3 then 'ru-' || p_name || ' №' || p_size || 'а' else 'ru-' || p_name || ' №' || num end as ru,
  case when other or n % 4 = 0 then null when num is null then 'en-' || p_name when p_partkey % 4 = 3 then 'en-' || p_name || ' №' || p_size || 'a' else 'en-' || p_name || ' №' || num end as en
from asked join known on k = p_name""")
def s12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Translations from a table of names that was written as a document and read back; numbers of poles are put back in the reader's letters."""
    known = parts(spark, sf_dir).groupBy("p_name").agg(F.min("p_partkey").alias("n"))
    entry = F.struct(F.when(F.col("n") % 3 > 0, F.concat(F.lit("ru-"), "p_name")).otherwise("").alias("ru"), F.when(F.col("n") % 4 > 0, F.concat(F.lit("en-"), "p_name")).alias("en"), F.lit("map").alias("src"), F.lit("exact").alias("tier"))
    at = f"{shared_folder(spark)}/names-{uuid.uuid4().hex}"
    known.groupBy((F.col("n") % 3).alias("part")).agg(F.map_from_entries(F.collect_list(F.struct("p_name", entry))).alias("names")).select("names").write.json(at)  # tens of names
    number = F.when(key() % 4 == 3, F.concat(F.col("p_size").cast("string"), F.lit("ა"))).when(key() % 4 > 0, F.col("p_size").cast("string"))
    sign = F.when(key() % 2 == 0, " #").otherwise("  №  ")
    spelled = F.concat(F.when(key() % 5 == 0, "no such ").otherwise(" "), "p_name", F.coalesce(F.concat(sign, number), F.lit(" ")))
    return looked_up(parts(spark, sf_dir).withColumn("spelled", spelled), "spelled", read_names(spark, at, whole_files=False)).select("p_partkey", "ru", "en")


@query("t25_suffix_letters", "select p_partkey, p_size || ['a', 'b', 'c', 'd', 'z'][p_partkey % 5 + 1] as number from part")
def t25(spark: SparkSession, sf_dir: str) -> DataFrame:
    letter = F.element_at(F.array(*map(F.lit, "აბგდz")), (key() % 5 + 1).cast("int"))
    return parts(spark, sf_dir).select("p_partkey", F.translate(F.concat(F.col("p_size").cast("string"), letter), text.POLE_GEORGIAN, text.POLE_LATIN).alias("number"))


def trilingual() -> Column:
    return F.element_at(F.array(*map(F.lit, TRILINGUAL)), (key() % len(TRILINGUAL) + 1).cast("int"))


@query("t26_to_cyrillic", "select p_partkey, ['Улица Руставели №14', '18-я публичная школа', 'Проспект Джавахишвили', 'Дзвели рынок и парк', 'Hotel Adjara', 'Площадь 26 Маиси', ''][p_partkey % 7 + 1] as ru from part")
def t26(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parts(spark, sf_dir).select("p_partkey", text.to_cyrillic(trilingual()).alias("ru"))


#: Georgian names, in Latin letters, and in Cyrillic after respelling.
SIGNS = (
    ("რუსთაველის ქუჩა", "Rustaveli Street", "Улица Руставели"), ("მე-2 ჩიხი", "2nd Lane", "Переулок 2-я"), ("1-ლი შესახვევი", "1st Lane", "Переулок 1-я"),
    ("მე–13 ქუჩა", "13th Street", "Улица 13-я"), ("ციხისძირი", "Tsikhisdziri", "Цихисдзири"), ("Hotel Adjara", "Hotel Adjara", "Hotel Adjara"),
    ("ღვინის ბაზარი", "Ghvinis Bazari", "Гвинис рынок"), ("მე-103 გამზირი", "103rd Avenue", "Проспект 103-я"), ("აღმაშენებლის შეს.", "Aghmasheneblis Shes.", "Переулок Агмашенебли"),
)


def signs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parts(spark, sf_dir).select("p_partkey", F.element_at(F.array(*(F.lit(x) for x, _, _ in SIGNS)), (key() % len(SIGNS) + 1).cast("int")).alias("name"))


def expected(which: int) -> str:
    return "[" + ", ".join(f"'{x[which]}'" for x in SIGNS) + f"][p_partkey % {len(SIGNS)} + 1]"


@query("t27_to_latin", f"select p_partkey, {expected(1)} as latin from part")
def t27(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signs(spark, sf_dir).select("p_partkey", text.to_latin(F.col("name")).alias("latin"))


@query("t28_respelled", f"select p_partkey, {expected(2)} as ru from part")
def t28(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signs(spark, sf_dir).select("p_partkey", text.to_cyrillic(text.respelled(F.col("name"))).alias("ru"))


@query("t36_same_words", """with p as (select p_partkey, p_partkey % 5 as v, string_split(p_name, ' ') as w from part)
select p_partkey, case v when 0 then true when 1 then true when 2 then false when 3 then length(w[2]) >= 5 else false end as same from p""")
def t36(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A translated name beside: itself with a kind of street; its words turned round; another number; one letter more in the last word; no words."""
    v, name = key() % 5, F.col("p_name")
    turned = F.concat_ws(" ", F.reverse(F.split(name, " ")))
    other = F.when(v == 0, F.concat(F.lit("ул. "), F.upper(name), F.lit(", 7"))).when(v == 1, F.concat(F.lit("7 "), turned)).when(v == 2, F.concat(name, F.lit(" 8"))).when(v == 3, F.concat(name, F.lit("s 7 st"))).otherwise(F.lit("Street 7"))
    return parts(spark, sf_dir).select("p_partkey", same_words(F.concat(name, F.lit(" Street 7")), other).alias("same"))


@query("t29_fold", "select doc_id, trim(regexp_replace(strip_accents(lower(text)), '[^\\p{L}\\p{N}/]+', ' ', 'g')) as folded from documents")
def t29(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", text.fold(F.col("text")).alias("folded"))


@query("t30_every_word_known", "select p_partkey, case when len(list_filter(w, lambda x: x not in ('red', 'hot', 'gear', 'bolt', 'blue'))) = 0 then array_to_string(list_transform(w, lambda x: upper(x)), ' ') end as said from (select p_partkey, string_split(p_name, ' ') as w from part)")
def t30(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A translation word by word, only where every word is known."""
    known = F.create_map(*(F.lit(x) for w in ("red", "hot", "gear", "bolt", "blue") for x in (w, w.upper())))
    said = F.transform(F.split("p_name", " "), lambda w: F.try_element_at(known, w))
    return parts(spark, sf_dir).select("p_partkey", F.when(F.forall(said, lambda w: w.isNotNull()), F.array_join(said, " ")).alias("said"))


@query("t31_name_keys", "select p_partkey, array_to_string(list_sort(string_split(lower(p_name), ' ') || [cast(p_size as varchar)]), ' ') as sorted, cast(p_size as varchar) as digits from part")
def t31(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = parts(spark, sf_dir).withColumn("name", F.concat(F.col("p_size").cast("string"), F.lit(" «"), F.upper("p_name"), F.lit("»")))
    return resolve.with_keys(rows, "name").select("p_partkey", "sorted", "digits")


@query("t32_bounded_edits", "select a.p_name as a, b.p_name as b, case when levenshtein(a.p_name, b.p_name) > 3 then -1 else levenshtein(a.p_name, b.p_name) end as edits from (select distinct p_name from part) a join (select distinct p_name from part) b on a.p_name[1] = b.p_name[1]")
def t32(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = parts(spark, sf_dir).select(F.col("p_name").alias("a")).distinct().withColumn("first", F.substring("a", 1, 1))
    both = names.join(names.withColumnRenamed("a", "b"), "first")
    return both.select("a", "b", F.levenshtein("a", "b", 3).cast("bigint").alias("edits"))


@query("t37_house_numbers", "select p_partkey, lower(case when p_partkey % 4 = 0 then p_size || 'a' when p_partkey % 4 = 1 then p_size || '/2' when p_partkey % 4 = 2 then cast(p_size as varchar) end) as number from part")
def t37(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.col("p_size").cast("string")
    raw = F.when(key() % 4 == 0, F.concat(size, F.lit(" A"))).when(key() % 4 == 1, F.concat(size, F.lit(" / 2"))).when(key() % 4 == 2, size).otherwise(F.concat(F.lit("no "), size))
    return parts(spark, sf_dir).select("p_partkey", text.valid_number(raw).alias("number"))


@query("t40_style", "select p_partkey, case when p_name like 'red %' then 'Rd ' || p_name[5:] when p_name like '% gear' then upper(p_name[1]) || p_name[2:-6] || ' gr.' else upper(p_name[1]) || p_name[2:] end as name from part")
def t40(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first rule that fits rewrites a name, and its first letter is a capital."""
    return parts(spark, sf_dir).select("p_partkey", text.styled(F.col("p_name"), [("^red ", "rd "), (" gear$", " gr.")]).alias("name"))


@query("t41_split_house_number", "select p_partkey, p_name as base, case when p_partkey % 3 > 0 then p_size || case when p_partkey % 3 = 2 then 'ა' else '' end end as number from part")
def t41(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.concat(F.lit(" № "), F.col("p_size").cast("string"))
    full = F.concat("p_name", F.when(key() % 3 == 1, size).when(key() % 3 == 2, F.concat(size, F.lit("ა"))).otherwise(""))
    base, number = text.house_number(full)
    return parts(spark, sf_dir).select("p_partkey", base.alias("base"), number.alias("number"))


@query("t42_overrides", "select p_partkey, coalesce(case when p_partkey % 10 = 0 then 'by hand' end, p_name) as name from part")
def t42(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = parts(spark, sf_dir).select("p_partkey", F.col("p_name").alias("name"))
    return resolve.overridden(rows, "p_partkey", "name", rows.where(key() % 10 == 0).select("p_partkey", F.lit("by hand").alias("name")))


@query("t43_recalled", "select p_partkey from part where contains(strip_accents(lower(p_name)), 'l b')")
def t43(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parts(spark, sf_dir).where(text.recalls(F.col("p_name"), F.lit(" L-B "))).select("p_partkey")


@query("k03_number_key", "select p_partkey, p_size || ['а', 'б', 'г', 'г', 'а'][p_partkey % 5 + 1] as k from part")
def k03(spark: SparkSession, sf_dir: str) -> DataFrame:
    letter = F.element_at(F.array(*map(F.lit, ("ა", "b", "გ", "c", "A"))), (key() % 5 + 1).cast("int"))
    return parts(spark, sf_dir).select("p_partkey", text.number_key(F.concat(F.lit("№ "), F.col("p_size").cast("string"), F.lit(" "), letter)).alias("k"))


@query("k04_sounds", r"""select p_name, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(w, 'oo+', 'o', 'g'), 'll+', 'l', 'g'), 'ee+', 'e', 'g'), 'tt+', 't', 'g'),
  'dd+', 'd', 'g'), 'hh+', 'h', 'g'), 'mm+', 'm', 'g'), 'ss+', 's', 'g'), 'kk+', 'k', 'g') as sound from (select p_name, replace(replace(replace(replace(replace(replace(replace(replace(replace(p_name, 'ph', 'f'), 'ch', '#'), 'c', 'k'), '#', 'ch'), 'q', 'k'), 'w', 'v'), 'y', 'i'), 'j', 'dzh'), 'g', 'h') as w from (select distinct p_name from part))""")
def k04(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parts(spark, sf_dir).select("p_name").distinct().select("p_name", text.sounds(F.col("p_name")).alias("sound"))


@query("k01_typed_terms", "select c_custkey, list_filter(t, lambda x: x in ('st', 'street') or (length(x) = 1 and not regexp_matches(x, '^[0-9]'))) as soft, list_filter(t, lambda x: regexp_matches(x, '^[0-9]')) as numbers from (select c_custkey, string_split('machinery st ' || (c_custkey % 90) || ' b', ' ') as t from customer)")
def k01(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = table(spark, sf_dir, "customer").select("c_custkey", F.concat(F.lit("MACHINERY, St. #"), (F.col("c_custkey") % 90).cast("string"), F.lit(" B")).alias("text"))
    return search.typed(asked).select("c_custkey", "soft", "numbers")


@query("k08_nearly", """select w, t, length(t) >= 5 and w[1] = t[1] and coalesce(list_max(list_transform([length(t)-1, length(t), length(t)+1], lambda n: length(w) >= n and levenshtein(w[1:n], t) <= 1)), false) as slip
  from (select distinct regexp_extract(p_name, '[a-z]+$') as w from part) join (select distinct unnest([x, x[1:3] || x[5:], x || 's', x[1:2] || 'z' || x[4:]]) as t from (select regexp_extract(p_name, '[a-z]+$') as x from part)) on true where w[1] = t[1]""")
def k08(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = parts(spark, sf_dir).select(F.regexp_extract("p_name", "[a-z]+$", 0).alias("w")).distinct()
    w = F.col("w")
    typed = F.array(w, F.concat(F.substring(w, 1, 3), F.substring(w, F.lit(5), F.length(w))), F.concat(w, F.lit("s")), F.concat(F.substring(w, 1, 2), F.lit("z"), F.substring(w, F.lit(4), F.length(w))))
    terms = last.select(F.explode(typed).alias("t")).distinct().withColumn("first", F.substring("t", 1, 1))
    return last.withColumn("first", F.substring("w", 1, 1)).join(terms, "first").select("w", "t", text.nearly(F.col("w"), F.col("t")).alias("slip"))


#: Queries typed by customers: words of parts' names, cut, slipped or with a number.
TYPED = "select c_custkey as query_id, p_name, p_size, c_custkey % 4 as v from customer join part on p_partkey = c_custkey"


def asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What customers typed: a part's name, cut, misspelt, or with a house number."""
    own = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("query_id")).join(parts(spark, sf_dir).withColumnRenamed("p_partkey", "query_id"), "query_id")
    n, name = F.col("query_id") % 4, F.col("p_name")
    typed = F.when(n == 0, name).when(n == 1, F.expr("left(p_name, length(p_name) - 2)")).when(n == 2, F.concat(name, F.lit(" st "), F.col("p_size").cast("string"))).otherwise(F.concat(F.substring(name, 1, 2), F.substring(name, F.lit(4), F.length(name))))
    return own.select("query_id", typed.alias("text"), F.lit(None).cast("double").alias("lat"), F.lit(None).cast("double").alias("lon"))


def streets(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = parts(spark, sf_dir).groupBy(F.col("p_name").alias("name")).agg(F.min("p_partkey").alias("id"))
    return named.select("id", "name", text.searchable(text.words(F.col("name"))).alias("words"), F.lit(41.6).alias("lat"), F.lit(41.6).alias("lon"), (F.col("id") % 2 == 1).alias("lane"))


@query("k10_street_branch", f"""with q as ({TYPED}), t as (select query_id, case v when 0 then p_name when 1 then p_name[1:length(p_name)-2] when 2 then p_name else p_name[1:2] || p_name[4:] end as text, case when v = 2 then cast(p_size as varchar) end as house from q),
s as (select p_name as name, min(p_partkey) as id from part group by p_name), h as (select p_name as name, cast(p_size as varchar) as number from part group by p_name, p_size),
w as (select query_id, house, id, name, string_split(name, ' ') as own, unnest(string_split(text, ' ')) as term from t, s),
c as (select query_id, house, id, name, case when length(term) = 1 then case when len(list_filter(own, lambda x: starts_with(x, term))) > 0 then 0e0 else 0.5e0 end when list_contains(own, term) then 0e0 when len(list_filter(own, lambda x: starts_with(x, term))) > 0 then 1e0
  when length(term) >= 5 and len(list_filter(own, lambda x: x[1] = term[1] and ((length(x) >= length(term)-1 and levenshtein(x[1:length(term)-1], term) <= 1) or (length(x) >= length(term) and levenshtein(x[1:length(term)], term) <= 1) or (length(x) >= length(term)+1 and levenshtein(x[1:length(term)+1], term) <= 1)))) > 0 then 1.5e0 end as cost from w),
m as (select query_id, house, id, name, 4*(sum(cost) + case when house is not null then 0.5e0 else 0 end) as base from c group by query_id, house, id, name having count(*) = count(cost))
select query_id, id, case when house is null then base + case when id % 2 = 1 then 1.25e0 else 1 end when exists (select 1 from h where h.name = m.name and h.number = house) then base else base + 4 end as score
from m where house is null or exists (select 1 from h where h.name = m.name and h.number = house) or not exists (select 1 from h where h.name = m.name and starts_with(h.number, house))""")
def k10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Streets, and houses of just the number typed."""
    rows = streets(spark, sf_dir)
    houses = parts(spark, sf_dir).groupBy("p_name", "p_size").agg(F.min("p_partkey").alias("ord")).join(rows.select("name", F.col("id").alias("street_id")), F.col("p_name") == F.col("name"))
    houses = houses.select("street_id", "ord", F.col("p_size").cast("string").alias("number"), F.lit(41.6).alias("lat"), F.lit(41.6).alias("lon"))
    none = rows.limit(0)
    found = search.search(asked(spark, sf_dir), none.withColumn("settlement", F.col("lane")), rows, houses, none.withColumns({"types": F.col("words"), "prominent": F.col("lane")}), limit=1 << 30)
    exact = found.where(F.col("kind") == "address").where(F.abs(F.pmod("score", F.lit(2.0))) < 1e-9)
    exact = exact.where((F.col("score") % 4 == 2) | (F.col("score") % 4 == 0)).select("query_id", F.split("id", "/")[0].cast("bigint").alias("id"), "score")
    return found.where(F.col("kind") == "street").select("query_id", F.col("id").cast("bigint").alias("id"), "score").unionByName(exact)


@query("k13_search")
def k13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The eight best answers of all kinds to each query."""
    rows = streets(spark, sf_dir)
    legs = stop_legs(spark, sf_dir).select(F.col("stop_id").alias("p_partkey"), "lat", "lon")
    houses = parts(spark, sf_dir).join(legs, "p_partkey").join(rows.select(F.col("name").alias("p_name"), F.col("id").alias("street_id")), "p_name")
    houses = houses.select("street_id", F.col("p_partkey").alias("ord"), F.col("p_size").cast("string").alias("number"), "lat", "lon")
    areas = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("bigint").alias("id"), F.concat(F.lit("Small "), F.col("n_name")).alias("name"), F.lit(41.6).alias("lat"), F.lit(41.6).alias("lon"), (F.col("n_nationkey") % 2 == 0).alias("settlement"))
    areas = areas.withColumn("words", text.searchable(text.words(F.col("name"))))
    places = parts(spark, sf_dir).join(legs, "p_partkey").select(key().alias("id"), F.concat("p_name", F.lit(" hotel")).alias("name"), F.split(F.lower("p_type"), " ").alias("types"), "lat", "lon", (F.col("p_size") > 25).alias("prominent"))
    places = places.withColumn("words", text.searchable(text.words(F.col("name"))))
    return search.search(asked(spark, sf_dir), areas, rows, houses, places)


#: Kinds of places, dealt to parts.
KINDS = (*sorted(search.TYPE_WORDS), "unknown")
KINDS_SQL = "[" + ", ".join(f"'{k}'" for k in KINDS) + f"][p_partkey % {len(KINDS)} + 1]"
KIND_WORDS = ", ".join(f"('{k}', '{w}')" for k, w in search.TYPE_WORDS.items())


@query("k14_type_words", f"""with words(kind, w) as (values {KIND_WORDS}), place as (select p_partkey, {KINDS_SQL} as kind from part)
select p_partkey, array_to_string(list_sort(list_distinct(string_split(replace(coalesce(w, ''), 'й', 'и'), ' '))), ',') as words from place left join words using (kind)""")
def k14(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words that each kind of place is asked for by."""
    kind = F.element_at(F.array(*map(F.lit, KINDS)), (key() % len(KINDS) + 1).cast("int"))
    found = search.with_type_words(parts(spark, sf_dir).withColumn("kind", kind), "kind")
    return found.select("p_partkey", F.array_join(F.array_sort("types"), ",").alias("words"))


@query("k14_own_dictionary", """with kind as (select p_brand, count(*) as n, min(p_type) as t from part group by p_brand having p_brand <> 'Brand#3')
select p_partkey, case when n is null then '' else array_to_string(list_sort(list_distinct([lower(t), 'brand', p_brand[7:], 'of', cast(n as varchar)])), ',') end as words from part left join kind using (p_brand)""")
def k14_own(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words of places' kinds from a dictionary that the caller brings: of each brand but one, in capitals and with marks."""
    each = table(spark, sf_dir, "part").where("p_brand <> 'Brand#3'").groupBy("p_brand").agg(F.count("*").alias("n"), F.min("p_type").alias("t"))
    dictionary = each.select(F.col("p_brand").alias("kind"), F.concat_ws(" ", "t", F.upper("p_brand"), F.lit("of"), F.concat(F.lit("("), "n", F.lit(")"))).alias("words"))
    found = search.with_type_words(parts(spark, sf_dir), "p_brand", dictionary)
    return found.select("p_partkey", F.array_join(F.array_sort("types"), ",").alias("words"))


@query("k14_places_by_kind", f"""with place as (select p_partkey as id, {KINDS_SQL} as kind from part),
q(query_id, kind) as (values (0, 'pharmacy'), (1, 'cafe'), (2, 'hotel'), (3, 'hospital'))
select q.query_id, place.id from q join place using (kind)""")
def k14_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places found by a word for their kind alone, in three languages."""
    kind = F.element_at(F.array(*map(F.lit, KINDS)), (key() % len(KINDS) + 1).cast("int"))
    named = parts(spark, sf_dir).select(key().alias("record_id"), F.array(F.concat(F.lit("n"), key().cast("string"))).alias("words"), kind.alias("kind"))
    typed = spark.createDataFrame([(0, "аптека"), (1, "coffee"), (2, "отель"), (3, "госпиталь")], "query_id int, text string")
    found = search.matched(search.typed(typed), search.with_type_words(named, "kind"))
    return found.select("query_id", F.col("record_id").alias("id"))


#: Feed names made from parts' names, each spoilt in one of six ways.
SPOILT = """feed as (select distinct case p_partkey % 6 when 0 then p_name when 1 then upper(p_name) || '!' when 2 then regexp_extract(p_name, '[a-z]+$') || ' ' || regexp_extract(p_name, '^[a-z]+')
  when 3 then p_name || ' street' when 4 then p_name[1:2] || p_name[4:] else 'zzqq ' || p_name end as name from part)"""


def feed_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    name, n = F.col("p_name"), key() % 6
    last, first = F.regexp_extract(name, "[a-z]+$", 0), F.regexp_extract(name, "^[a-z]+", 0)
    spoilt = F.when(n == 0, name).when(n == 1, F.concat(F.upper(name), F.lit("!"))).when(n == 2, F.concat_ws(" ", last, first)).when(n == 3, F.concat(name, F.lit(" street")))
    spoilt = spoilt.when(n == 4, F.concat(F.substring(name, 1, 2), F.substring(name, F.lit(4), F.length(name)))).otherwise(F.concat(F.lit("zzqq "), name))
    return parts(spark, sf_dir).select(spoilt.alias("name")).distinct()


def known_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names with a translation, but for some."""
    each = parts(spark, sf_dir).groupBy(F.col("p_name").alias("k_name")).agg(F.min("p_partkey").alias("k_id"), F.count("*").alias("n"))
    return each.withColumn("ru", F.when(F.col("k_id") % 3 > 0, F.concat(F.lit("ru-"), "k_name")))


STEMS = "list_sort(list_filter(list_transform(list_filter(string_split(n, ' '), lambda x: length(x) > 2 and x not in ('street', 'st', 'ave')), lambda x: x), lambda x: length(x) > 2))"


@query("t38_loose_score", f"""with {SPOILT}, f as (select name, {STEMS.replace("n,", "regexp_replace(lower(name), '[^a-z ]', '', 'g'),")} as s, name like '% street' as typed from feed), k as (select k_id, ru, {STEMS.replace("n,", "k_name,")} as ks from (select p_name as k_name, min(p_partkey) as k_id, min(p_partkey) % 3 > 0 as ru from part group by p_name)),
p as (select name, k_id, len(list_filter(s, lambda x: list_contains(ks, x))) as shared, len(s) as own, len(ks) as other, ru from f, k),
g as (select name, k_id, shared*100 - (own-shared)*40 - (other-shared)*40 + case when ru then 5 else 0 end as score from p where shared > 0 and (shared = own or shared = other))
select name, k_id, cast(score as bigint) as score from (select *, row_number() over (partition by name order by score desc, k_id) as r from g where score >= 60) where r = 1""")
def t38(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve.loose(resolve.with_keys(feed_names(spark, sf_dir), "name"), resolve.with_keys(known_names(spark, sf_dir), "k_name", "k_"))


@query("j17_fuzzy", f"""with {SPOILT}, f as (select name, array_to_string({STEMS.replace("n,", "regexp_replace(lower(name), '[^a-z ]', '', 'g'),")}, '') as s from feed), k as (select k_id, ru, array_to_string({STEMS.replace("n,", "k_name,")}, '') as ks from (select p_name as k_name, min(p_partkey) as k_id, min(p_partkey) % 3 > 0 as ru from part group by p_name)),
p as (select name, k_id, ru, levenshtein(s, ks) as d, case when length(s) <= 10 then 1 when length(s) <= 18 then 2 else 3 end as budget from f, k where length(s) >= 6)
select name, k_id, cast(-10*d + case when ru then 1 else 0 end as bigint) as score from (select *, row_number() over (partition by name order by -10*d + case when ru then 1 else 0 end desc, k_id) as r from p where d <= budget) where r = 1""")
def j17_fuzzy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve.fuzzy(resolve.with_keys(feed_names(spark, sf_dir), "name"), resolve.with_keys(known_names(spark, sf_dir), "k_name", "k_"))


@query("j17_name_cascade")
def j17(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every feed name with the known name that it means, and how that was found."""
    return resolve.match_names(feed_names(spark, sf_dir), known_names(spark, sf_dir))


@query("j18_street_clusters", "select stop_id as point_id, min(stop_id) over (partition by route_id, direction) as cluster from stop_leg where route_id % 2 = 0 union all select stop_id, stop_id from stop_leg where route_id % 2 = 1")
def j18(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ways of one name that hops of under 260 m connect: every even line is one street a direction, odd ones' stops are named one by one."""
    stops = stop_legs(spark, sf_dir)
    name = F.when(F.col("route_id") % 2 == 0, F.concat_ws("-", F.lit("line"), "route_id", "direction")).otherwise(F.concat(F.lit("stop-"), F.col("stop_id").cast("string")))
    found = resolve.clusters(stops.select(F.col("stop_id").alias("point_id"), name.alias("name"), "lat", "lon"), 260)
    return found.select("point_id", "cluster")


@query("j19_spread_houses", """with recursive house as (select p_brand, p_partkey, 41.5e0 + (p_partkey % 40)*0.0007e0 as lat from part), o as (select *, row_number() over (partition by p_brand order by p_partkey) as n from house),
fold as (select p_brand, n, p_partkey, [lat] as kept, true as keep from o where n = 1
 union all select o.p_brand, o.n, o.p_partkey, case when len(list_filter(f.kept, lambda k: abs(k - o.lat)*111320e0 < 120)) = 0 then list_append(f.kept, o.lat) else f.kept end, len(list_filter(f.kept, lambda k: abs(k - o.lat)*111320e0 < 120)) = 0 from fold f join o on o.p_brand = f.p_brand and o.n = f.n + 1)
select p_brand, p_partkey from fold where keep""")
def j19(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One house of each lot: none within 120 m of one kept before."""
    rows = parts(spark, sf_dir).select("p_brand", "p_partkey", (F.lit(41.5) + key() % 40 * F.lit(0.0007)).alias("lat"), F.lit(41.6).alias("lon"))
    return resolve.spread(rows, ["p_brand"], "p_partkey", 120).select("p_brand", "p_partkey")


BOXES = ((1, 10, 41.5, 41.52, 41.5, 41.51), (2, 8, 41.51, 41.54, 41.5, 41.53), (3, 6, 41.5, 41.6, 41.5, 41.505))


@query("j15_localities", """with b(area_id, level, south, north, west, east) as (values (1, 10, 41.5e0, 41.52e0, 41.5e0, 41.51e0), (2, 8, 41.51e0, 41.54e0, 41.5e0, 41.53e0), (3, 6, 41.5e0, 41.6e0, 41.5e0, 41.505e0)),
held as (select stop_id, area_id, level, row_number() over (partition by stop_id order by level desc, area_id) as r from stop_leg join b on lat between south and north and lon between west and east),
near as (select s.stop_id, v.stop_id as village, row_number() over (partition by s.stop_id order by """ + "round((2*6371000e0*asin(sqrt(pow(sin(radians(v.lat-s.lat)/2),2)+cos(radians(s.lat))*cos(radians(v.lat))*pow(sin(radians(v.lon-s.lon)/2),2)))), 3)" + """, v.stop_id) as r from stop_leg s join stop_leg v on v.stop_id % 40 = 0 and
 (2*6371000e0*asin(sqrt(pow(sin(radians(v.lat-s.lat)/2),2)+cos(radians(s.lat))*cos(radians(v.lat))*pow(sin(radians(v.lon-s.lon)/2),2)))) <= 2500)
select s.stop_id, cast(coalesce(case when h.level >= 8 then h.area_id end, n.village, h.area_id, -1) as bigint) as area_id from stop_leg s left join held h on h.stop_id = s.stop_id and h.r = 1 left join near n on n.stop_id = s.stop_id and n.r = 1""")
def j15(spark: SparkSession, sf_dir: str) -> DataFrame:
    stops = stop_legs(spark, sf_dir)
    boxes = spark.createDataFrame(BOXES, "area_id bigint, level int, south double, north double, west double, east double")
    villages = stops.where("stop_id % 40 = 0").select(F.col("stop_id").alias("area_id"), F.col("lat").alias("r_lat"), F.col("lon").alias("r_lon"))
    found = resolve.localities(stops.select(F.col("stop_id").alias("point_id"), "lat", "lon"), boxes, villages)
    return found.select(F.col("point_id").alias("stop_id"), "area_id")


CLOSE = "len(list_filter({0}, lambda x: len(list_filter({1}, lambda y: x = y or (least(length(x), length(y)) >= 5 and levenshtein(x, y) <= 2))) = 0)) = 0"
COVERS = "case when len({0}) <= len({1}) then " + CLOSE + " else " + CLOSE.replace("{0}", "{2}").replace("{1}", "{0}").replace("{2}", "{1}") + " end"
FLAT = "round(sqrt(pow(({3} - {1})*111320e0*cos(radians(({0} + {2})/2)), 2) + pow(({2} - {0})*111320e0, 2)), 3)"


@query("j16_street_cascade", f"""with recursive owner as (select stop_id, route_id, lat, lon, p_name, stop_id % 7 as v, string_split(p_name, ' ') as own from stop_leg join part on p_partkey = stop_id),
house as (select stop_id as house_id, lat, lon, v, own, case when v < 3 then p_name when v = 3 then own[2] || ' ' || own[1] || ' ქუჩა' when v = 4 then p_name || ' Street' when v = 5 then 'Улица ' || p_name else p_name || ' 3' end as name,
  own || case v when 4 then ['street'] when 5 then ['улица'] else [] end as stems from owner),
road as (select min(stop_id) over (partition by route_id, p_name) as street_id, * from owner where stop_id % 5 < 2 and route_id % 3 = 0),
vertex as (select street_id, lat as r_lat, lon as r_lon, own as r_own, case when street_id % 2 = 0 then p_name else 'გზა' || route_id end as s_name, case when street_id % 2 = 0 then own else ['გზა' || route_id] end as s_stems from road),
pair as (select house_id, name, v, own, stems, street_id, s_name, r_own, s_stems, {FLAT.format("lat", "lon", "r_lat", "r_lon")} as metres from house join vertex on abs(lat - r_lat) < 0.014 and abs(lon - r_lon) < 0.02),
exact as (select house_id, arg_min(street_id, {{'m': metres, 's': street_id}}) as street_id, min(metres) as d from pair where name = s_name and metres < 1500 group by house_id),
likely as (select *, case when v <> 6 and {COVERS.format("stems", "s_stems")} then 0 when v not in (3, 6) and {COVERS.format("own", "r_own")} then 1 end as tier from pair where metres < 400 and house_id not in (select house_id from exact)),
best as (select house_id, arg_min(street_id, {{'t': tier, 'm': metres, 's': street_id}}) as street_id, min(tier) as tier from likely where tier is not null group by house_id),
turn as (select h.house_id, h.name, h.lat, h.lon, coalesce(e.street_id, b.street_id) as told, coalesce(e.d, 1500) as reach, case when e.d is not null then 'exact' when b.tier = 0 then 'respelled' when b.tier = 1 then 'translated' end as told_how,
  row_number() over (partition by h.name order by h.house_id) as n from house h left join exact e using (house_id) left join best b using (house_id)),
fold as (
  select name, 0::bigint as n, null::bigint as house_id, null::bigint as street_id, null::varchar as how, []::struct(lat double, lon double, first bigint)[] as points from turn group by name
  union all
  select name, n, house_id, coalesce(-1 - joined, told, -1 - house_id), case when joined is not null then 'joined' when told is not null then told_how else 'new' end,
    case when joined is not null or told is null then list_append(points, {{'lat': lat, 'lon': lon, 'first': coalesce(joined, house_id)}}) else points end
  from (select t.*, points, list_min(list_filter(list_transform(points, lambda q: {{'m': {FLAT.format("t.lat", "t.lon", "q.lat", "q.lon")}, 'first': q.first}}), lambda q: q.m < t.reach))['first'] as joined
    from fold join turn t on t.name = fold.name and t.n = fold.n + 1) step)
select house_id, name, street_id, how from fold where n > 0""")
def j16(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The street of each house: of its very name nearby, of another spelling closer by, of a translated name, or a new one that grows."""
    stops = stop_legs(spark, sf_dir).select("stop_id", "route_id", "lat", "lon")
    rows = stops.join(parts(spark, sf_dir).select(key().alias("stop_id"), "p_name"), "stop_id").withColumn("v", F.col("stop_id") % 7)
    turned = F.concat(F.regexp_extract("p_name", r"\S+$", 0), F.lit(" "), F.regexp_extract("p_name", r"^\S+", 0), F.lit(" ქუჩა"))
    spelled = F.when(F.col("v") < 3, F.col("p_name")).when(F.col("v") == 3, turned).when(F.col("v") == 4, F.concat("p_name", F.lit(" Street"))).when(F.col("v") == 5, F.concat(F.lit("Улица "), "p_name")).otherwise(F.concat("p_name", F.lit(" 3")))
    houses = rows.select(F.col("stop_id").alias("house_id"), spelled.alias("name"), "lat", "lon")
    roads = rows.where("stop_id % 5 < 2 and route_id % 3 = 0").withColumn("street_id", F.min("stop_id").over(Window.partitionBy("route_id", "p_name")))
    own = F.when(F.col("street_id") % 2 == 0, F.col("p_name")).otherwise(F.concat(F.lit("გზა"), "route_id"))
    drawn = roads.select("street_id", own.alias("s_name"), F.concat(F.lit("улица "), "p_name").alias("s_ru"), F.concat("p_name", F.lit(" Street")).alias("s_en"), F.col("lat").alias("r_lat"), F.col("lon").alias("r_lon"))
    return streets_of(houses, drawn)


@query("s11_feed_names", "select trim(p_name) as name, count(*) as poles from part group by p_name")
def s11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parts(spark, sf_dir).groupBy(text.clean(F.col("p_name")).alias("name")).agg(F.count("*").alias("poles"))


@query("p18_stable_ids", "select stop_id, 'stop:' || stop_id || '@' || printf('%.5f', lat) || ',' || printf('%.5f', lon) as id from stop_leg")
def p18(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stop_legs(spark, sf_dir).select("stop_id", F.format_string("stop:%d@%.5f,%.5f", "stop_id", "lat", "lon").alias("id"))


@query("p20_place_names", "select p_partkey, case p_partkey % 4 when 0 then 'Me' when 1 then p_name when 2 then case when p_size > 25 then p_name else 'A point' end else p_name || ' · ' || p_partkey end as name from part")
def p20(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = key() % 4
    name = F.when(n == 0, "Me").when(n == 1, F.col("p_name")).when(n == 2, F.coalesce(F.when(F.col("p_size") > 25, F.col("p_name")), F.lit("A point"))).otherwise(F.concat_ws(" · ", "p_name", key()))
    return parts(spark, sf_dir).select("p_partkey", name.alias("name"))
