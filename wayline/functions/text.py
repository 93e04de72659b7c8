"""Names and typed words as column expressions: folding, transliteration, sound, and keys for matching."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from wayline.functions import clock

#: Georgian letters, their sounds in Cyrillic, and the two that take two letters.
GEORGIAN, CYRILLIC = "აბგდევზთიკლმნოპჟრსტუფქღყშჩცწჭხჰ", "абгдевзтиклмнопжрстуфкгкшчццчхх"
CYRILLIC_PAIRS = {"ძ": "дз", "ჯ": "дж"}
#: Nouns that are translated; the first six lead the name.
NOUNS = {
    "ქუჩა": "улица", "გამზირი": "проспект", "გზატკეცილი": "шоссе", "მოედანი": "площадь", "ჩიხი": "переулок", "ხიდი": "мост",
    "სკოლა": "школа", "საჯარო": "публичная", "ბაღი": "сад", "პარკი": "парк", "ბაზარი": "рынок", "საავადმყოფო": "больница",
    "უნივერსიტეტი": "университет", "სასაფლაო": "кладбище", "აეროპორტი": "аэропорт", "სადგური": "станция", "ცენტრი": "центр",
    "არენა": "арена", "სტადიონი": "стадион", "და": "и",
}
LEADING = ("ქუჩა", "გამზირი", "გზატკეცილი", "მოედანი", "ჩიხი", "ხიდი")
#: Georgian letters in Latin ones, and street types in English.
GEORGIAN_LATIN, LATIN = "აბგდევზთიკლმნოპრსტუფქყჯჰ", "abgdevztiklmnoprstupkqjh"
LATIN_PAIRS = {"ჟ": "zh", "ღ": "gh", "შ": "sh", "ჩ": "ch", "ც": "ts", "ძ": "dz", "წ": "ts", "ჭ": "ch", "ხ": "kh"}
LATIN_NOUNS = {"ქუჩა": "Street", "გამზირი": "Avenue", "გზატკეცილი": "Highway", "მოედანი": "Square", "ჩიხი": "Lane", "შესახვევი": "Lane", "ხეივანი": "Alley"}
#: Words for the kind of street that translated names are compared without.
TRANSLATED_TYPES = (
    "street", "st", "str", "avenue", "ave", "av", "lane", "ln", "road", "rd", "highway", "hwy", "square", "sq", "alley",
    "улица", "ул", "проспект", "пр", "просп", "переулок", "пер", "тупик", "туп", "шоссе", "площадь", "пл", "проезд",
)
#: How Cyrillic letters sound in Latin ones.
HEARD, HEARD_AS = "абвгдезийклмнопрстуфхыэ", "abvgdeziiklmnoprstufhie"
HEARD_PAIRS = {"ж": "zh", "ц": "ts", "ч": "ch", "ш": "sh", "щ": "sh", "ъ": "", "ь": "", "ю": "yu", "я": "ya"}
#: The letter after a house number, in Georgian and as the key has it, and Latin ones read as that.
HOUSE_GEORGIAN, HOUSE_KEY = "აბგდევზთიკლმნოპრსტუფქ", "абгдевзтиклмнопрстуфк"
HOUSE_LATIN, HOUSE_LATIN_KEY = "abcdevztiklmnoprsug", "абгдевзтиклмнопрсуг"
#: Suffix letters of pole numbers in Latin.
POLE_GEORGIAN, POLE_LATIN = "აბგდ", "abcd"
#: Words for the kind of street, in any script, forgiven when they don't match.
SOFT = (
    "ул", "улица", "пр", "просп", "проспект", "пер", "переулок", "ш", "шоссе", "бул", "бульвар", "пл", "площадь", "туп", "тупик", "наб", "набережная",
    "д", "дом", "корп", "г", "город", "st", "str", "street", "ave", "av", "avenue", "rd", "road", "ln", "lane", "hwy", "highway", "sq", "square",
    "blvd", "boulevard", "no", "house", "ქ", "ქუჩა", "გამზ", "გამზირი", "ჩიხი", "შეს", "შესახვევი", "მოედანი", "გზატკეცილი", "სახლი",
)

GEORGIAN_SCRIPT = "[Ⴀ-ჿ]"


def _bases() -> tuple[str, str]:
    """Letters of European scripts with marks, and these letters without."""
    pairs = [(c, unicodedata.normalize("NFD", c)) for c in map(chr, [*range(0xC0, 0x250), *range(0x370, 0x530), *range(0x1E00, 0x2000)])]
    bare = [(c, "".join(x for x in d if not 0x300 <= ord(x) < 0x370)) for c, d in pairs if c != d]
    bare = [(c, b) for c, b in bare if len(b) == 1]
    return "".join(c for c, _ in bare), "".join(b for _, b in bare)


MARKED, BARE = _bases()


def clean(text: Column) -> Column:
    """One space between words, none around, no number sign left without its number."""
    one = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))
    return F.trim(F.regexp_replace(one, r"[№#]\s*$", ""))


def strip_code(name: Column, code: Column) -> Column:
    prefix = F.concat(code.cast("string"), F.lit(" "))
    return F.when(F.startswith(name, prefix), F.trim(F.substring(name, F.length(prefix) + 1, F.length(name)))).otherwise(name)


def table_key(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.translate(text, "#", "№"), r"\s+", " "))


def fold(text: Column) -> Column:
    """Lower case without marks; all but letters, digits and slashes is one space."""
    bare = F.regexp_replace(F.translate(F.lower(text), MARKED, BARE), r"[̀-ͯ]", "")
    return F.trim(F.regexp_replace(bare, r"[^\p{L}\p{N}/]+", " "))


def words(text: Column) -> Column:
    return F.array_distinct(F.filter(F.split(fold(text), " "), lambda w: w != ""))


def replaced(text: Column, pairs: dict[str, str]) -> Column:
    for old, new in pairs.items():
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


def sounds(word: Column) -> Column:
    """A folded word as it roughly sounds, in Latin letters."""
    x = replaced(F.translate(word, HEARD, HEARD_AS), HEARD_PAIRS)
    x = replaced(x, {"kh": "h", "ph": "f"})
    x = F.regexp_replace(x, "c(?!h)", "k")
    x = replaced(x, {"q": "k", "w": "v", "x": "ks", "y": "i", "j": "dzh", "g": "h"})
    return F.regexp_replace(x, r"(.)\1+", "$1")


def forms(word: Column) -> Column:
    return F.array_distinct(F.array(word, sounds(word)))


def searchable(own: Column) -> Column:
    """Words, and the sounds of those in Latin script."""
    return F.array_union(own, F.transform(F.filter(own, lambda w: w.rlike("^[a-z]")), sounds))


def number_key(number: Column) -> Column:
    """The same for a house number whose letter was typed in any of three scripts."""
    key = F.regexp_replace(fold(F.translate(number, HOUSE_GEORGIAN, HOUSE_KEY)), r"\s+", "")
    return F.translate(key, HOUSE_LATIN, HOUSE_LATIN_KEY)


def to_cyrillic(name: Column) -> Column:
    """A Georgian name as it sounds in Russian: the kind of street first and translated, its owner no longer in the genitive."""
    tokens = F.filter(F.split(F.translate(name, "#", "№"), r"\s+"), lambda t: t != "")
    nouns = F.create_map(*(F.lit(x) for pair in NOUNS.items() for x in pair))
    leads = F.filter(tokens, lambda t: t.isin(*LEADING))
    lead = F.get(leads, F.lit(0))
    at = F.coalesce(F.array_position(tokens, lead), F.lit(0))  # from 1; 0: none

    def rendered(token: Column, i: Column) -> Column:
        stem = F.when((at > 0) & (i == at - 2) & F.endswith(token, F.lit("ის")), F.substring(token, F.lit(1), F.length(token) - 1)).otherwise(token)
        number = F.regexp_extract(token, r"^მე[-–—]\s*(\d+)$", 1)
        return F.when(number != "", F.concat(number, F.lit("-я"))).otherwise(F.coalesce(F.try_element_at(nouns, token), capital(sounded(stem))))

    every = F.transform(tokens, lambda t, i: F.when(i == at - 1, F.lit("")).otherwise(rendered(t, i)))
    body = F.filter(every, lambda t: t != "")
    first = F.when(at > 0, F.array(capital(F.try_element_at(nouns, lead)))).otherwise(F.array().cast("array<string>"))
    return F.when(name.rlike(GEORGIAN_SCRIPT), F.array_join(F.concat(first, body), " ")).otherwise(name)


def respelled(name: Column) -> Column:
    """A Georgian name with its first ordinal and its words for a lane as ``to_cyrillic`` knows them."""
    first = F.regexp_replace(name, r"(^|\s)1[-–—]ლი(?=\s|$)", "$1მე-1")
    return F.regexp_replace(first, r"(^|\s)(?:შესახვევი|ჩასახვევი|შეს\.?)(?=\s|$)", "$1ჩიხი")


def to_latin(name: Column) -> Column:
    """A Georgian name in Latin letters: street types and ordinals in English, a street's owner no longer in the genitive."""
    tokens = F.split(name, " ")
    nouns = F.create_map(*(F.lit(x) for pair in LATIN_NOUNS.items() for x in pair))

    def rendered(token: Column, i: Column) -> Column:
        number = F.coalesce(F.nullif(F.regexp_extract(token, r"^მე[-–—]\s*(\d+)$", 1), F.lit("")), F.nullif(F.regexp_extract(token, r"^(1)[-–—]ლი$", 1), F.lit("")))
        owner = F.try_element_at(nouns, F.get(tokens, i + 1)).isNotNull() & F.endswith(token, F.lit("ის"))
        stem = F.when(owner, F.substring(token, F.lit(1), F.length(token) - 1)).otherwise(token)
        spelled = capital(replaced(F.translate(stem, GEORGIAN_LATIN, LATIN), LATIN_PAIRS))
        return F.coalesce(F.try_element_at(nouns, token), clock.ordinal(number.cast("int")), spelled)

    return F.when(name.rlike(GEORGIAN_SCRIPT), F.array_join(F.transform(tokens, rendered), " ")).otherwise(name)


def translated_words(name: Column) -> Column:
    """The words of an English or Russian street name without those for the kind of street."""
    return F.filter(F.split(F.lower(F.coalesce(name, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: (w != "") & ~w.isin(*TRANSLATED_TYPES))


def sounded(word: Column) -> Column:
    return replaced(F.translate(word, GEORGIAN, CYRILLIC), CYRILLIC_PAIRS)


def capital(word: Column) -> Column:
    return F.concat(F.upper(F.substring(word, 1, 1)), F.substring(word, F.lit(2), F.length(word)))


def styled(name: Column, rules: list[tuple[str, str]]) -> Column:
    """A name rewritten by the first rule (pattern, replacement) that fits, if any, with a capital first letter."""
    out = name
    for pattern, new in reversed(rules):
        out = F.when(name.rlike(pattern), F.regexp_replace(name, pattern, new)).otherwise(out)
    return capital(out)


def says(tag: Column, nothing: str = "yes") -> Column:
    """A tag's value unless it only says that the tag is there."""
    return F.nullif(tag, F.lit(nothing))


def specific(tags: list[Column], nothing: str = "yes") -> Column:
    """The first of several tags that says more than that it is there; else that, if one is there."""
    return F.coalesce(*(says(t, nothing) for t in tags), *tags)


def recalls(name: Column, asked: Column) -> Column:
    """Whether a folded name holds what was asked for, folded."""
    return F.contains(fold(name), fold(asked))


def house_number(text: Column) -> tuple[Column, Column]:
    """A name without its trailing number, and the number (null if it has none)."""
    number = F.nullif(F.regexp_extract(text, r"\s*№\s*(\d[^\s№]*)$", 1), F.lit(""))
    return F.when(number.isNotNull(), F.trim(F.regexp_replace(text, r"\s*№\s*\d[^\s№]*$", ""))).otherwise(text), number


def valid_number(text: Column) -> Column:
    """A house number in one spelling, null if it is none."""
    one = F.regexp_replace(F.lower(F.trim(text)), r"\s+", "")
    return F.when(one.rlike(r"^\d{1,3}\p{L}?([/-]\d{1,3}\p{L}?)?$"), one)


def nearly(word: Column, term: Column) -> Column:
    """The term of five letters or more is one slip from a beginning of the word; the first letter is trusted."""
    n = F.length(term)
    slip = F.lit(False)
    for k in (-1, 0, 1):
        begin = F.substring(word, F.lit(1), n + k)
        slip = slip | ((F.length(word) >= n + k) & F.levenshtein(begin, term, 1).between(0, 1))
    return (n >= 5) & (F.substring(word, 1, 1) == F.substring(term, 1, 1)) & slip


def quality(own: Column, required: Column, soft: Column, types: Column) -> Column:
    """Null if a required word (an array of its forms) is missing; else 1 for each that begins a word, 1.5 for each slip, and 0.5 for each soft word that is not there."""

    def cost(one: Column) -> Column:
        begins = lambda those: F.exists(those, lambda w: F.exists(one, lambda f: F.startswith(w, f)))
        slips = F.exists(own, lambda w: F.exists(one, lambda f: nearly(w, f)))
        return F.when(F.arrays_overlap(own, one), 0.0).when(begins(own) | begins(types), 1.0).when(slips, 1.5)

    missing = F.filter(soft, lambda s: ~F.exists(own, lambda w: F.startswith(w, s)))
    return F.aggregate(F.transform(required, cost), F.lit(0.0), lambda total, x: total + x) + 0.5 * F.size(missing)


def stems(name: Column) -> Column:
    """Sorted words without their last letters, and numbers as they are."""
    return F.array_sort(F.transform(words(name), lambda w: F.when(w.rlike(r"^\d") | (F.length(w) <= 4), w).otherwise(F.substring(w, F.lit(1), F.length(w) - 2))))


def digits(name: Column) -> Column:
    return F.array_sort(F.regexp_extract_all(name, F.lit(r"(\d+)")))
