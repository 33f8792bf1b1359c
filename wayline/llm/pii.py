"""Surrogates for personal data: keyed, type-consistent replacements, with DataFrame functions only.

Entities are found by one regular expression per type; a person's name is found behind a title, and its given names,
initials and surname are entities of their own, so that all mentions of a person corefer: of "Mr. John Smith", "Mr. Smith"
and "Dr. Smith" the surname gets one surrogate. Distinct entities of the whole table get surrogates from a keyed hash of
type, value and attempt. They keep type and format: digits become digits, letters letters of the same case and script; given
names keep script and gender (which the table's titles before a name tell, most of them), surnames script, and in Cyrillic
and Greek the ending's gender; addresses their class (private, loopback, link-local, multicast, public); cards their first
digit and, as accounts, check digits that are right if they were; mail users of one domain stay together. Surrogates that
two entities share, or that are themselves an entity of the table, are drawn again until none is left, so distinct entities
stay distinct; one entity has one surrogate everywhere.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayline.llm import common

# Titles by gender.
_TITLES = {
    "m": ["Mr", "Herr", "Monsieur", "Señor", "Sr", "Sir", "Г-н", "Господин", "Κύριος"],
    "f": ["Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Señora", "Sra", "Г-жа", "Госпожа", "Κυρία"],
    "n": ["Dr", "Prof", "Mx"],
}
# Beginnings, middles by script, and endings that given names are put together from, by gender and script.
_GIVEN_MIDDLES = {
    "latin": ["ra", "le", "ni", "do", "ma", "re", "li", "no", "sa", "ve", "ti", "lo"],
    "cyrillic": ["ра", "ле", "ни", "до", "ма", "ре", "ли", "но", "са", "ве", "ти", "ло"],
    "greek": ["ρα", "λε", "νι", "δο", "μα", "ρε", "λι", "νο", "σα", "βε", "τι", "λο"],
}
_GIVEN = {
    ("m", "latin"): (["Al", "Ber", "Cor", "Dar", "Ed", "Far", "Gal", "Hel", "Is", "Jor", "Kel", "Lor", "Mar", "Nor", "Os", "Per"], ["n", "s", "rd", "k", "l", "us"]),
    ("f", "latin"): (["Al", "Ber", "Cor", "Dar", "El", "Fer", "Gal", "Hel", "Is", "Jor", "Kel", "Lor", "Mar", "Nor", "Ol", "Per"], ["na", "lia", "ra", "ssa", "tta", "ya"]),
    ("n", "latin"): (["Al", "Ber", "Cor", "Dar", "Ed", "Far", "Gal", "Hel", "Is", "Jor", "Kel", "Lor", "Mar", "Nor", "Os", "Per"], ["ly", "ni", "rey", "sy", "ttie", "bie"]),
    ("m", "cyrillic"): (["Ал", "Бер", "Вал", "Гер", "Дар", "Ел", "Зах", "Иг", "Кор", "Лав", "Мар", "Ник", "Ол", "Пет", "Род", "Сер"], ["н", "р", "й", "слав", "мир", "к"]),
    ("f", "cyrillic"): (["Ал", "Бер", "Вал", "Гер", "Дар", "Ел", "Зар", "Ир", "Кор", "Лар", "Мар", "Ник", "Ол", "Пол", "Род", "Сер"], ["на", "ра", "слава", "мира", "лья", "ка"]),
    ("m", "greek"): (["Αλ", "Βασ", "Γερ", "Δαρ", "Ευ", "Ζαχ", "Ηλ", "Θεο", "Ιο", "Κορ", "Λευ", "Μαρ", "Νικ", "Ορ", "Πετ", "Σερ"], ["νος", "ρης", "λος", "κης", "τος", "ας"]),
    ("f", "greek"): (["Αλ", "Βασ", "Γερ", "Δαρ", "Ευ", "Ζαχ", "Ηλ", "Θεο", "Ιο", "Κορ", "Λευ", "Μαρ", "Νικ", "Ορ", "Πετ", "Σερ"], ["να", "ρα", "λια", "κη", "τη", "σα"]),
}
# Beginnings, middles and endings that surnames are put together from, by script; of the last two endings by gender.
_SURNAMES = {
    "latin": (["Al", "Bar", "Cor", "Dal", "El", "Far", "Gar", "Hal", "Ing", "Jan", "Kel", "Lan", "Mar", "Nor", "Os", "Pal", "Quin", "Ros", "San", "Tal", "Ul", "Ver", "Wes", "Yar"], ["ber", "din", "fel", "ga", "lo", "man", "ner", "vi"], ["son", "ton", "er", "mann", "ley", "field", "well", "ford", "by", "wood", "ling", "stein", "ski", "dale", "ham", "ring"]),
    "cyrillic": (["Ан", "Бар", "Вер", "Гор", "Дан", "Ер", "Жар", "Зим", "Ил", "Кар", "Лап", "Мак", "Ник", "Ор", "Пав", "Род"], ["а", "е", "и", "ом", "ул", "ер", "ин", "ан"], ["ков", "нов", "лин", "сеев", "тов", "шин", "дов", "ров"]),
    "greek": (["Αλ", "Βασ", "Γεωρ", "Δημ", "Ευ", "Ζαχ", "Ηλι", "Θεο", "Ιω", "Καρ", "Λαμ", "Μαν", "Νικ", "Ορ", "Παπ", "Ραφ"], ["α", "ε", "ι", "ο", "αν", "ερ", "ιδ", "ολ"], ["πουλος", "ιδης", "ακης", "ιος", "αρης", "ελης", "ανος", "ουλης"]),
}
_TITLE = "|".join(sorted((t for ts in _TITLES.values() for t in ts), key=len, reverse=True))
#: Java regular expressions; where two types match at one place, the first here wins.
PATTERNS = {
    "secret": r"(?<![A-Za-z0-9_])(?:(?:AKIA|ASIA)[A-Z0-9]{16}|gh[pousr]_[A-Za-z0-9]{36}|sk-[A-Za-z0-9_-]{20,}|eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}|[0-9a-f]{32,128}|(?<=(?:token|secret|api_key|apikey|password) = \")[^\"\s]{6,200})(?![A-Za-z0-9_])",
    "email": r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]{1,64}@(?:[\p{L}\p{N}-]{1,63}\.){1,8}\p{L}{2,24}(?![\p{L}\p{N}])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "ipv4": r"(?<![0-9.])(?:(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?![0-9]|\.[0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "phone": r"(?<![0-9+])\+[0-9]{1,3}[ .-]?\(?[0-9]{1,4}\)?(?:[ .-]?[0-9]{2,4}){2,4}(?![0-9])|(?<![0-9+(])\(?[0-9]{3}\)?[ .-][0-9]{3}[.-][0-9]{4}(?![0-9])",
    "card": r"(?<![0-9])[0-9]{4}(?:[ -]?[0-9]{4}){2}[ -]?[0-9]{1,7}(?![0-9])",
    "name": rf"(?<=(?<![\p{{L}}])(?:{_TITLE})\.? )(?:\p{{Lu}}\. ?){{0,2}}\p{{Lu}}[\p{{L}}'’-]+(?: (?:\p{{Lu}}\. ?){{0,2}}\p{{Lu}}[\p{{L}}'’-]+){{0,2}}",
}
_ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
_TITLED = {g: rf"(?<![\p{{L}}])(?:{'|'.join(ts)})\.?$" for g, ts in _TITLES.items()}
#: First parts of addresses that lie in no special range.
_PUBLIC = [a for a in range(1, 224) if a not in (10, 100, 127, 169, 172, 192, 198, 203)]
#: Draws after which a surrogate may grow beyond its format, as there may be more entities than the format has values.
DRAWS = 30
#: Letters that stand for each other, by case and script (fixed values).
_ALPHABETS = ["0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "абвгдежзиклмнопрстуфхцчшщэюя", "АБВГДЕЖЗИКЛМНОПРСТУФХЦЧШЩЭЮЯ", "αβγδεζηθικλμνξοπρστυφχψω", "ΑΒΓΔΕΖΗΘΙΚΛΜΝΞΟΠΡΣΤΥΦΧΨΩ"]


def _byte(hexed: Column, i: Column) -> Column:
    """Byte i % 31 of a hex digest, as an int; two places apart per use, so that neighbours differ."""
    return F.conv(F.substring(hexed, i % 31 * 2 + 1, F.lit(2)), 16, 10).cast("int")


def _letterwise(value: Column, digest: Column, alphabets: list[str]) -> Column:
    """Each sign replaced by one of its alphabet, others kept. Further digests serve values of over 31 signs."""

    def one(c: Column, i: Column) -> Column:
        place = F.when(i < 31, _byte(digest, i)).otherwise(_byte(F.sha2(F.concat(digest, F.floor(i / 31).cast("string")), 256), i))
        out = F.when(F.lit(False), c)
        for a in alphabets:
            out = out.when(F.instr(F.lit(a), c) > 0, F.substring(F.lit(a), place % len(a) + 1, F.lit(1)))
        return out.otherwise(F.when(c.rlike(r"\p{Lu}"), F.substring(F.lit(_ALPHABETS[2]), place % 26 + 1, F.lit(1))).when(c.rlike(r"\p{L}"), F.substring(F.lit(_ALPHABETS[1]), place % 26 + 1, F.lit(1))).otherwise(c) if len(alphabets) > 3 else c)

    return F.array_join(F.transform(F.split(value, ""), one), "")


def _luhn(value: Column) -> Column:
    """The Luhn sum modulo 10 of the digits of a value."""
    digits = F.transform(F.split(F.reverse(F.regexp_replace(value, "[^0-9]", "")), ""), lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(d.cast("int") * 2 - F.when(d.cast("int") > 4, 9).otherwise(0)))
    return F.aggregate(digits, F.lit(0), lambda a, d: a + F.coalesce(d, F.lit(0))) % 10


def _mod97(value: Column) -> Column:
    """An account number, its first four signs moved to the end and its letters read as 10 to 35, modulo 97."""
    bare = F.regexp_replace(value, " ", "")
    signs = F.split(F.concat(F.substring(bare, F.lit(5), F.length(bare)), F.substring(bare, 1, 4)), "")
    step = lambda acc, c: F.when(c.rlike("[0-9]"), acc * 10 + F.ascii(c) - 48).when(c.rlike("[A-Z]"), acc * 100 + F.ascii(c) - 55).otherwise(acc) % 97
    return F.aggregate(signs, F.lit(0), step)


def _pick(digest: Column, use: int, options: list[str]) -> Column:
    return F.element_at(F.array(*map(F.lit, options)), _byte(digest, F.lit(use)) % len(options) + 1)


def _by_script(value: Column, make: dict[str, Column]) -> Column:
    return F.when(value.rlike(r"\p{IsCyrillic}"), make["cyrillic"]).when(value.rlike(r"\p{IsGreek}"), make["greek"]).otherwise(make["latin"])


def _given(value: Column, gender: Column, digest: Column, attempt: int) -> Column:
    """A given name of the same gender and script, one middle part more for each draw."""

    def names(g: str, script: str) -> Column:
        first, last = _GIVEN[g, script]
        return F.concat(_pick(digest, 4, first), *(_pick(digest, 7 + 3 * j, _GIVEN_MIDDLES[script]) for j in range(2 + attempt)), _pick(digest, 29, last))

    female = (gender == "f") | ((gender == "n") & value.rlike("[аяαηωάή]$"))
    latin = F.when(gender == "m", names("m", "latin")).when(gender == "f", names("f", "latin")).otherwise(names("n", "latin"))
    return _by_script(value, {"latin": latin, **{s: F.when(female, names("f", s)).otherwise(names("m", s)) for s in ("cyrillic", "greek")}})


def _surname(value: Column, digest: Column, attempt: int) -> Column:
    """A surname of the same script, one middle part more for each draw."""
    made = {s: F.concat(_pick(digest, 5, first), *(_pick(digest, 11 + 3 * j, middle) for j in range(attempt)), _pick(digest, 23, last)) for s, (first, middle, last) in _SURNAMES.items()}
    made["cyrillic"] = F.when(value.rlike("[ая]$"), F.concat(made["cyrillic"], F.lit("а"))).otherwise(made["cyrillic"])
    made["greek"] = F.when(value.rlike("(ου|α|η)$"), F.regexp_replace(made["greek"], "(ος|ης)$", "ου")).otherwise(made["greek"])
    return _by_script(value, made)


def _address(value: Column, digest: Column) -> Column:
    """An address of the same class; the last part is neither 0 nor 255."""
    part = lambda j, n, least=0: (least + _byte(digest, F.lit(3 * j)) % n).cast("string")
    head, second = F.substring_index(value, ".", 1).cast("int"), F.split(value, r"\.")[1].cast("int")
    tail = [part(2, 256), part(3, 254, 1)]
    fixed = lambda *x: F.concat_ws(".", *map(F.lit, x), *tail)
    own = F.concat_ws(".", head.cast("string"), part(1, 256), *tail)
    special = F.when(head.isin(0, 10, 127) | (head >= 240), own).when((head == 192) & (second == 168), fixed("192", "168")).when((head == 169) & (second == 254), fixed("169", "254"))
    special = special.when((head == 172) & second.between(16, 31), F.concat_ws(".", F.lit("172"), part(1, 16, 16), *tail)).when(head >= 224, F.concat_ws(".", part(0, 16, 224), part(1, 256), *tail))
    return special.otherwise(F.concat_ws(".", _pick(digest, 0, list(map(str, _PUBLIC))), part(1, 256), *tail))


def surrogate(kind: Column, gender: Column, value: Column, attempt: int, key: str) -> Column:
    """The keyed surrogate of a value; attempt counts draws. From DRAWS on it ends with more and more further digits, which no format has."""
    digest = F.sha2(F.concat_ws("\u0001", F.lit(key), kind, value, F.lit(str(attempt))), 256)
    domain_digest = lambda d: F.sha2(F.concat_ws("\u0001", F.lit(key), F.lit("domain"), d), 256)
    user, domain = F.substring_index(value, "@", 1), F.substring_index(value, "@", -1)
    tail = F.regexp_extract(domain, r"(\.(?:example\.)?\p{L}+)$", 1)
    host = F.substring(domain, F.lit(1), F.length(domain) - F.length(tail))
    email = F.concat(_letterwise(user, digest, _ALPHABETS), F.lit("@"), _letterwise(host, domain_digest(host), _ALPHABETS), tail)
    hexed = value.rlike("^[0-9a-f]+$")
    secret = F.when(hexed, _letterwise(value, digest, ["0123456789abcdef"])).otherwise(_letterwise(value, digest, _ALPHABETS[:3]))
    prefix = F.regexp_extract(value, r"^(AKIA|ASIA|gh[pousr]_|sk-|eyJ)", 1)
    secret = F.concat(prefix, F.substring(secret, F.length(prefix) + 1, F.length(value)))
    digits = _letterwise(value, digest, _ALPHABETS[:1])
    numbered = F.concat(F.substring(value, 1, 1), F.substring(digits, F.lit(2), F.length(digits)))
    # the check digit passes in the surrogate if it does in the value
    off = (_luhn(value) == 0) & (_luhn(numbered) != 0)
    body = F.substring(numbered, F.lit(1), F.length(numbered) - 1)
    card = F.when(off, F.concat(body, F.pmod(F.substring(numbered, -1, 1).cast("int") - _luhn(numbered), F.lit(10)).cast("string"))).otherwise(numbered)
    country = F.regexp_extract(value, r"^(\+[0-9]{1,3}(?=[ .-])|)", 1)
    phone = F.concat(country, F.substring(digits, F.length(country) + 1, F.length(value)))
    lettered = _letterwise(value, digest, _ALPHABETS[:3])
    account = lambda check: F.concat(F.substring(value, 1, 2), check, F.substring(lettered, F.lit(5), F.length(value)))
    iban = F.when(_mod97(value) == 1, account(F.lpad((98 - _mod97(account(F.lit("00")))).cast("string"), 2, "0"))).otherwise(account(F.substring(lettered, 3, 2)))
    shout = lambda name: F.when((F.length(value) > 1) & (F.upper(value) == value), F.upper(name)).otherwise(name)
    made = {"email": email, "ipv4": _address(value, digest), "secret": secret, "card": card, "phone": phone, "iban": iban, "given": shout(_given(value, gender, digest, min(attempt, 4))), "surname": shout(_surname(value, digest, min(attempt, 4))), "initial": _letterwise(value, digest, _ALPHABETS)}
    out = reduce(lambda c, k: c.when(kind == k, made[k]), made, F.when(F.lit(False), value)).otherwise(digits)
    return F.concat(out, F.lit("-"), F.conv(F.substring(digest, 1, min(15, attempt - DRAWS + 4)), 16, 10)) if attempt >= DRAWS else out


def _kind(value: Column) -> Column:
    """The type of a found string that is no name: the first pattern that matches all of it."""
    out = F.when(F.lit(False), F.lit(""))
    for k, p in PATTERNS.items():
        if k not in ("name", "secret"):
            out = out.when(value.rlike(f"^(?:{p})$"), F.lit(k))
    return out.otherwise(F.lit("secret"))


def _may_have(text: Column) -> Column:
    """True where an entity can be at all: a digit, an @, a title, or the beginning of a secret. Cheap, and never false for a text with an entity."""
    marks = [f"{t}{end}" for ts in _TITLES.values() for t in ts for end in (" ", ". ")] + ["AKIA", "ASIA", "ghp_", "gho_", "ghu_", "ghs_", "ghr_", "sk-", "eyJ", 'token = "', 'secret = "', 'api_key = "', 'apikey = "', 'password = "']
    return reduce(lambda c, m: c | text.contains(m), marks, text.rlike("[0-9@]|[a-f]{32}"))


def _found(text: Column) -> Column:
    """Of each entity of a text in order its parts (kind, value, gender); only names have several, divided by spaces, and a gender."""
    pairs = F.arrays_zip(F.regexp_extract_all(text, F.lit(_ANY), F.lit(0)).alias("value"), F.transform(F.split(text, _ANY, -1), lambda g: F.substring(g, -12, 12)).alias("gap"))
    part = lambda kind, value, gender: F.struct(kind.alias("kind"), value.alias("value"), gender.alias("gender"))

    def one(p: Column) -> Column:
        lead, value = F.rtrim(p["gap"]), p["value"]
        gender = reduce(lambda c, x: c.when(value.rlike(r"^\p{Lu}[^0-9@]*$") & lead.rlike(x[1]), F.lit(x[0])), _TITLED.items(), F.when(F.lit(False), F.lit("")))
        words = F.split(value, " ")
        # the last word is the surname, but behind a title that goes with given names
        kind = lambda w, i: F.when(w.endswith("."), "initial").when((i < F.size(words) - 1) | ((F.size(words) == 1) & lead.rlike(r"(?<![\p{L}])Sir$")), "given").otherwise("surname")
        return F.when(gender.isNull(), F.array(part(_kind(value), value, F.lit("")))).otherwise(F.transform(words, lambda w, i: part(kind(w, i), w, gender)))

    return F.transform(F.filter(pairs, lambda p: p["value"].isNotNull()), one)


def _distinct_surrogates(entities: DataFrame, key: str) -> DataFrame:
    """entities (kind, value, gender), distinct by kind and value, with surrogate: no two of a kind alike, none that is an entity itself."""
    real = entities.select("kind", F.col("value").alias("surrogate"))
    open_, fixed, attempt = entities, None, 0
    while True:
        drawn = open_.withColumn("surrogate", surrogate(F.col("kind"), F.col("gender"), F.col("value"), attempt, key))
        drawn = drawn.join(real.withColumn("real", F.lit(True)), ["kind", "surrogate"], "left")
        if fixed is not None:
            drawn = drawn.join(fixed.select("kind", "surrogate", F.lit(True).alias("taken")), ["kind", "surrogate"], "left")
        else:
            drawn = drawn.withColumn("taken", F.lit(None).cast("boolean"))
        # many values of a narrow type may draw one surrogate: the smallest keeps it
        best = drawn.groupBy("kind", "surrogate").agg(F.min("value").alias("best"), F.count("*").alias("size"))
        drawn = common.join_groups(drawn, best, ["kind", "surrogate"], open_.count(), "value")
        good = F.col("real").isNull() & F.col("taken").isNull() & (F.col("value") == F.col("best"))
        drawn = common.stored(drawn.select("kind", "value", "gender", "surrogate", good.alias("good")), "surrogates")
        done = drawn.where("good").drop("good", "gender")
        fixed = done if fixed is None else fixed.unionByName(done)
        open_ = drawn.where("not good").select("kind", "value", "gender")
        if open_.isEmpty():
            return fixed
        attempt += 1


def replace_pii(df: DataFrame, key: str, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """df with surrogates in text_col, and n_entities (how many were replaced) and entity_kinds (sorted, distinct).

    Null texts stay null with 0 entities, empty ones empty. Replacement goes by the text's content, so repeated ids and
    rows, null ids and ties need no care. Columns of df named n_entities or entity_kinds are replaced, all others pass
    through. Only rows with an entity are shuffled: by their text's hash, each with its own entities. Where a format has fewer
    values than the table has entities, the last ones get longer surrogates (DRAWS). Empty tables give no rows.
    """
    names = [c for c in df.columns if c not in ("n_entities", "entity_kinds")]
    text = df[text_col]
    packed = df.select(F.struct(*[df[c] for c in names]).alias("row"), text.alias("text"))
    marked = packed.withColumn("hot", F.coalesce(_may_have(F.col("text")) & F.col("text").rlike(_ANY), F.lit(False)))
    hot = marked.where("hot")
    found = hot.select(F.sha2("text", 256).alias("h"), _found(F.col("text")).alias("f"))
    found = common.stored(found.groupBy("h").agg(F.any_value("f").alias("f")), "found")
    spread = found.select("h", F.explode(F.array_distinct(F.flatten("f"))).alias("e")).select("h", "e.*")
    votes = spread.groupBy("kind", "value").agg(*(F.count(F.when(F.col("gender") == g, True)).alias(g) for g in "mf"))
    gender = F.when(F.col("m") > F.col("f"), "m").when(F.col("f") > F.col("m"), "f").otherwise("n")
    entities = common.stored(votes.select("kind", "value", gender.alias("gender")), "entities")
    pairs = _distinct_surrogates(entities, key)
    mentions = spread.select("h", "kind", "value").distinct()
    sizes = mentions.groupBy("kind", "value").agg(F.count("*").alias("size")).join(pairs, ["kind", "value"])
    each = common.join_groups(mentions, sizes, ["kind", "value"], mentions.count(), "h")
    name = lambda k, v: F.concat_ws("\u0001", k, v)
    shown = F.when(F.col("kind").isin("given", "surname", "initial"), "name").otherwise(F.col("kind"))
    maps = each.groupBy("h").agg(F.map_from_entries(F.collect_list(F.struct(name("kind", "value"), "surrogate"))).alias("m"), F.sort_array(F.collect_set(shown)).alias("kinds"))
    replaced = F.transform("f", lambda ps: F.array_join(F.transform(ps, lambda p: F.element_at(F.col("m"), name(p["kind"], p["value"]))), " "))
    maps = maps.join(found, "h").select("h", "kinds", replaced.alias("s"))
    joined = hot.withColumn("h", F.sha2("text", 256)).join(maps, "h")
    gaps = F.split("text", _ANY, -1)
    new = F.array_join(F.transform(gaps, lambda g, i: F.concat(g, F.coalesce(F.get("s", i), F.lit("")))), "")
    keep = lambda t: [t.alias(c) if c == text_col else F.col(f"row.`{c}`").alias(c) for c in names]
    changed = joined.select(*keep(new), F.size("s").cast("long").alias("n_entities"), F.col("kinds").alias("entity_kinds"))
    same = marked.where("not hot").select(*keep(F.col("text")), F.lit(0).cast("long").alias("n_entities"), F.array().cast("array<string>").alias("entity_kinds"))
    return changed.unionByName(same)
