"""Surrogates for personal data (operator 8, DataFrame operations only).

E-mail addresses, telephone, card, account and social-security numbers, network addresses and titled names are found by
pattern.  Each entity, in a normal form (digits of a number, lower-case address or name), gets a surrogate of its type
made from ``key``: a number keeps its format and first digit, an address keeps its letters-and-digits shape and top
domain, a name keeps gender and script.  The map from entity to surrogate is one row an entity: surrogates that two
entities share, or that are themselves entities of the corpus, are drawn again until none is left, so different entities
stay different and mentions of one entity stay the same everywhere, whatever their format.  Each new draw of a family name has
a syllable more, and a short format is widened when drawing in its own shape does not end (letters before the @, another first
digit, then digits at the end, octets of any length), so the spaces grow with the entities; only IPv4 is as large as it is.

Only texts with entities are taken apart; mentions are joined to the map, put in the form of the mention, and the text is
put together again.  A hot entity is a hot row of the small map only; skewed joins split.

Defined results: null and empty texts come back as they are with 0 entities; repeated rows change alike; null doc_id is
kept; other columns are not returned; an empty table gives an empty result; one key gives one result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factorframe.llm.common import BROADCAST_ROWS, stored

# Patterns, titles and common given and family names by gender and script.
_EMAIL = r"(?<![A-Za-z0-9._%+\-])[A-Za-z0-9._%+\-]++@(?:[A-Za-z0-9\-]++\.)+[A-Za-z]{2,}"
_PHONE = r"(?<![\w+])\+\d{1,3}[ .\-]?\(?\d{2,4}\)?(?:[ .\-]?\d{2,4}){2,3}(?!\d)|(?<!\w)\(\d{3}\) ?\d{3}[.\-]\d{4}(?!\d)|(?<![\w.\-])\d{3}[.\-]\d{3}[.\-]\d{4}(?![\w\-])"
_IP = r"(?<![\w.])(?:\d{1,3}\.){3}\d{1,3}(?!\w|\.\d)"
_SSN = r"(?<![\w\-])\d{3}-\d{2}-\d{4}(?![\w\-])"
_CARD = r"(?<!\w)\d{4}(?:[ \-]?\d{4}){2}[ \-]?\d{1,7}(?!\w)"
_IBAN = r"(?<!\w)[A-Z]{2}\d{2}[A-Z0-9]{11,30}(?!\w)"
_TITLES = {"m": ["Mr", "Herr", "Sr", "Señor", "Monsieur", "Господин"], "f": ["Mrs", "Ms", "Miss", "Frau", "Sra", "Señora", "Madame", "Mme", "Госпожа"],
           "n": ["Dr", "Prof"]}
_NAME = r"(?<!\w)(?:" + "|".join(t for ts in _TITLES.values() for t in ts) + r")\.? \p{Lu}\p{Ll}+(?: \p{Lu}\p{Ll}+)?"
PATTERN = "|".join(f"(?:{p})" for p in (_EMAIL, _IP, _PHONE, _SSN, _CARD, _IBAN, _NAME))
_GIVEN = {
    ("latin", "m"): ["James", "Robert", "Thomas", "Daniel", "Martin", "Peter", "Paul", "Simon", "Victor", "Oscar"],
    ("latin", "f"): ["Mary", "Linda", "Susan", "Karen", "Anna", "Laura", "Julia", "Helen", "Clara", "Emma"],
    ("latin", "n"): ["Alex", "Robin", "Kim", "Sam", "Chris", "Jordan", "Taylor", "Jamie", "Morgan", "Casey"],
    ("cyrillic", "m"): ["Иван", "Пётр", "Алексей", "Сергей", "Николай", "Андрей"],
    ("cyrillic", "f"): ["Анна", "Мария", "Ольга", "Елена", "Татьяна", "Ирина"],
    ("cyrillic", "n"): ["Саша", "Женя", "Валя", "Слава"],
}
_SYLLABLES = {"latin": ["ber", "lan", "mor", "ten", "wil", "dar", "han", "kel", "nor", "ris", "sal", "ver", "cor", "fen", "gar", "lin"],
              "cyrillic": ["бор", "вол", "гор", "дар", "зим", "кор", "лес", "мир", "нов", "рож", "сол", "тем", "фед", "чер", "шар", "яр"]}
#: Attempts of a format's own shape before its space is widened, and syllables of a family name at most (16 ** 18 names).
WIDER = 8
MOST_SYLLABLES = 18


def _possible(text: Column) -> Column:
    """A quick look: every pattern needs a digit, an ``@`` or a title."""
    look = text.rlike("[0-9@]")
    for title in (t for ts in _TITLES.values() for t in ts):
        look = look | text.contains(title + " ") | text.contains(title + ".")
    return look


def _kind(value: Column) -> Column:
    return (F.when(value.contains("@"), "email").when(value.rlike(r"^(?:\d{1,3}\.){3}\d{1,3}$"), "ip").when(value.rlike(f"^(?:{_SSN})$"), "ssn")
            .when(value.rlike(f"^(?:{_PHONE})$"), "phone").when(value.rlike(f"^(?:{_IBAN})$"), "iban").when(value.rlike(r"^[\d \-]+$"), "card").otherwise("name"))


def _title(value: Column) -> Column:
    return F.substring_index(value, " ", 1)


def _normal(value: Column, kind: Column) -> Column:
    """The form in which mentions of one entity agree: digits of numbers, octets, lower case; names with gender and script."""
    bare = F.regexp_replace(_title(value), r"\.$", "")
    gender = F.when(bare.isin(_TITLES["m"]), "m").when(bare.isin(_TITLES["f"]), "f").otherwise("n")
    name = F.substr(value, F.instr(value, " ") + 1)
    script = F.when(name.rlike(r"\p{IsCyrillic}"), "cyrillic").otherwise("latin")
    return (F.when(kind.isin("phone", "card", "ssn"), F.regexp_replace(value, r"\D", "")).when(kind == "name", F.concat_ws("|", gender, script, F.lower(name)))
            .otherwise(F.lower(value)))


def _number(digest: Column, at: Column, below: int) -> Column:
    """A number under ``below`` from the digest at a place (the digest wraps)."""
    place = F.pmod(at * 3, F.lit(120)) + 1
    return F.pmod(F.conv(F.substr(digest, place, F.lit(6)), 16, 10).cast("long"), F.lit(below))


def _surrogate(normal: Column, kind: Column, attempt: Column, key: str) -> Column:
    """The surrogate's normal form."""
    digest = F.sha2(F.concat_ws("\x1f", F.lit(key), kind, attempt.cast("string"), normal), 512)
    chars = F.transform(F.split(normal, ""), lambda c, i: F.struct(c.alias("c"), i.alias("i")))
    digit = lambda x: _number(digest, x["i"], 10).cast("string")
    letter = lambda x: F.char(97 + _number(digest, x["i"], 26))
    shaped = lambda a, fixed: F.array_join(F.transform(a, lambda x: F.when(fixed(x), x["c"]).when(x["c"].rlike("[0-9]"), digit(x))
                                                       .when(x["c"].rlike("[a-z]"), letter(x)).otherwise(x["c"])), "")
    top = F.length(normal) - F.length(F.substring_index(normal, ".", -1))
    octets = F.transform(F.split(normal, r"\."), lambda o, i: (F.when(attempt >= WIDER, _number(digest, i, 256)).when(F.length(o) == 1, 1 + _number(digest, i, 9)).when(
        F.length(o) == 2, 10 + _number(digest, i, 90)).otherwise(100 + _number(digest, i, 150))).cast("string"))
    parts = [F.get(F.split(normal, r"\|"), F.lit(i)) for i in range(3)]
    given = F.lit(None).cast("string")
    for (script, gender), names in _GIVEN.items():
        pick = F.element_at(F.array(*[F.lit(n) for n in names]), (_number(digest, F.lit(0), len(names)) + 1).cast("int"))
        given = F.when((parts[0] == gender) & (parts[1] == script), pick).otherwise(given)
    family = F.lit("")
    for script, syllables in _SYLLABLES.items():
        bank = F.array(*[F.lit(x) for x in syllables])
        places = F.sequence(F.lit(0), 2 + F.least(attempt, F.lit(MOST_SYLLABLES - 3)))
        made = F.array_join(F.transform(places, lambda i: F.element_at(bank, (_number(digest, 3 + 2 * i, len(syllables)) + 1).cast("int"))), "")
        family = F.when(parts[1] == script, made).otherwise(family)
    name = F.when(parts[2].contains(" "), F.concat_ws(" ", given, F.initcap(family))).otherwise(F.initcap(family))
    # the space of a short format is widened: letters before the @, another first digit, digits at the end
    more = lambda from_, one: F.array_join(F.when(attempt >= from_, F.transform(F.sequence(F.lit(from_), attempt), one)).otherwise(F.array().cast("array<string>")), "")
    email = F.replace(shaped(chars, lambda x: x["i"] >= top), F.lit("@"), F.concat(more(WIDER, lambda i: F.char(97 + _number(digest, 7 * i + 1, 26))), F.lit("@")))
    number = F.concat(shaped(chars, lambda x: (x["i"] == 0) & (attempt < WIDER)), more(2 * WIDER, lambda i: _number(digest, 7 * i + 1, 10).cast("string")))
    return (F.when(kind == "email", email).when(kind == "ip", F.array_join(octets, "."))
            .when(kind == "name", name).when(kind == "iban", shaped(chars, lambda x: x["i"] < 2)).otherwise(number))


def _rendered(value: Column, kind: Column, surrogate: Column) -> Column:
    """The surrogate in the format of the mention."""
    poured = F.aggregate(F.split(value, ""), F.struct(F.lit(0).alias("i"), F.lit("").alias("out")), lambda s, c: F.when(
        c.rlike("[0-9]"), F.struct((s["i"] + 1).alias("i"), F.concat(s["out"], F.substr(surrogate, s["i"] + 1, F.lit(1))).alias("out"))).otherwise(
        F.struct(s["i"].alias("i"), F.concat(s["out"], c).alias("out"))), lambda s: F.concat(s["out"], F.substr(surrogate, s["i"] + 1)))
    return (F.when(kind.isin("phone", "card", "ssn"), poured).when(kind == "name", F.concat_ws(" ", _title(value), surrogate))
            .when(value == F.upper(value), F.upper(surrogate)).otherwise(surrogate))


def surrogates(entities: DataFrame, key: str, attempts: int = 100) -> DataFrame:
    """(kind, normal, surrogate), one row an entity, from distinct (kind, normal): no two alike and none an entity itself.
    Drawing again ends when no clash is left; ``attempts`` without an end is an error, not a clash."""
    state = stored(entities.withColumn("attempt", F.lit(0)))
    for _ in range(attempts):
        drawn = state.withColumn("surrogate", _surrogate(F.col("normal"), F.col("kind"), F.col("attempt"), key))
        # names clash with given and family name alike, whatever their gender
        real = entities.select(F.col("kind").alias("rk"), F.when(F.col("kind") == "name", F.element_at(F.split("normal", r"\|"), -1)).otherwise(F.col("normal")).alias("rn")).distinct()
        turn = F.row_number().over(Window.partitionBy("kind", "surrogate").orderBy("attempt", "normal"))
        marked = drawn.withColumn("turn", turn).join(real, (F.col("kind") == F.col("rk")) & (F.lower("surrogate") == F.col("rn")), "left")
        marked = stored(marked.withColumn("clash", (F.col("turn") > 1) | F.col("rn").isNotNull()).select("kind", "normal", "attempt", "surrogate", "clash"))
        if marked.where("clash").isEmpty():
            return marked.select("kind", "normal", "surrogate")
        state = marked.select("kind", "normal", (F.col("attempt") + F.col("clash").cast("int")).alias("attempt"))
    raise ValueError("surrogates of some format are used up")


def pseudonymised(docs: DataFrame, key: str = "surrogates-1") -> DataFrame:
    """doc_id, text, n_entities for each row of ``docs`` (doc_id, text)."""
    thin = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = thin.withColumn("values", F.when(_possible(F.col("text")), F.regexp_extract_all("text", F.lit(PATTERN), F.lit(0))))
    with_any = F.coalesce(F.size("values"), F.lit(0)) > 0
    # one key for rows with the same text: their result is the same
    mentions = stored(found.where(with_any).select(F.md5(F.col("text").cast("binary")).alias("t"), F.explode(F.array_distinct("values")).alias("value")).distinct()
                      .withColumn("kind", _kind(F.col("value"))).withColumn("normal", _normal(F.col("value"), F.col("kind"))))
    entities = stored(mentions.select("kind", "normal").distinct())
    named = surrogates(entities, key)
    named = F.broadcast(named) if entities.count() <= BROADCAST_ROWS // 10 else named
    spoken = mentions.join(named, ["kind", "normal"]).withColumn("to", _rendered(F.col("value"), F.col("kind"), F.col("surrogate")))
    maps = stored(spoken.groupBy("t").agg(F.map_from_entries(F.collect_list(F.struct("value", "to"))).alias("map")))  # of one text
    maps = F.broadcast(maps) if maps.count() <= BROADCAST_ROWS // 10 else maps

    pieces = F.split("text", PATTERN, -1)
    changed = found.where(with_any).withColumn("t", F.md5(F.col("text").cast("binary"))).join(maps, "t")
    joined = F.array_join(F.transform(pieces, lambda p, i: F.concat(p, F.coalesce(F.element_at("map", F.try_element_at("values", (i + 1).cast("int"))), F.lit("")))), "")
    changed = changed.select("doc_id", joined.alias("text"), F.size("values").cast("long").alias("n_entities"))
    same = found.where(~with_any).select("doc_id", "text", F.lit(0).cast("long").alias("n_entities"))
    return changed.unionByName(same)
