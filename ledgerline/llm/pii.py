r"""Personal data: keyed surrogates that keep type, gender, script and format.

Mentions are found by one pattern.  Each holds one or two entities, of a kind and a
canonical form (an address in lower case, a number's digits, a phone number with its
country code, a name in lower case), and equal canonical forms get equal surrogates
in every text, each written in the format of its place: separators, spacing and
letter case stay.

A name stands behind a title and has one or two words.  The last is the family name,
an entity of its own, so ``Mrs Weber`` and ``Frau Maria Weber`` keep one family; the
first is the person's given name, an entity of (given, family, gender of the title).
A title without a gender (``Dr``) means the person of that name who is named with a
gender elsewhere, the female one if there are both.  Names without a title, and words
of a name after the second, are left as they are.

A phone number is international (a plus sign and 8 to 15 digits, grouped in any way)
or has the form NNN NNN NNNN; without a plus sign its country code is 1.

A surrogate comes from HMAC-SHA256 under the key, of kind, canonical form and attempt,
stretched by counted hashes.  Attempt 0 is computed in place.  Collisions are checked
over all distinct entities: one whose surrogate is also that of a smaller canonical
form, or is a real value, moves to its next attempt, until all surrogates are distinct
and none is real.  Only entities that moved are looked up by a join.

Kinds: e-mail addresses, IBANs (with right check digits), IPv4 addresses, payment
cards (runs of 13 to 19 digits whose last is the right check digit, and so is the surrogate's), US social security
numbers, phone numbers, and names behind a title, in Latin, Greek or Cyrillic.
Everything is DataFrame functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.crypto import hmac_sha256
from .common import discard, stored

# Titles by gender, and parts of names by script and gender.
TITLES = {"f": "Mrs|Ms|Miss|Frau|Mme|Madame|Señora|Sra|Госпожа|Κυρία", "m": "Mr|Mister|Herr|Monsieur|Señor|Sr|Господин|Κύριος", "n": "Dr|Prof"}
GIVEN = {
    "latin": {"f": "Alma Berta Clara Dora Elena Flora Greta Helena Irma Julia Klara Laura Marta Nora Olga Paula", "m": "Adam Bruno Carlo David Emil Felix Georg Hugo Ivan Jonas Karl Leon Marco Noah Oskar Paul"},
    "cyrillic": {"f": "Анна Вера Дарья Елена Ирина Мария Нина Ольга", "m": "Антон Борис Виктор Денис Иван Кирилл Михаил Павел"},
    "greek": {"f": "Άννα Δήμητρα Ελένη Ζωή Ιωάννα Κατερίνα Μαρία Σοφία", "m": "Αλέξης Γιώργος Δημήτρης Ηλίας Κώστας Νίκος Πέτρος Στέλιος"},
}
STEMS = {
    "latin": "ber dal fer gar hal kel lor mar nor pel ros sal tor val wal zel",
    "cyrillic": "бел вол гор дем зим кар лан мор нов пет ром сем тар фед чер шар",
    "greek": "αλεξ βασιλ γεωργ δημη ηλιο θεοδ ιωαν καρα λαμπ μαυρ νικο οικο παπα ραπτ στεφ τσακ",
}
#: Endings that both genders have; a Greek one drops its last letter in a woman's name.
ENDS = {"latin": "man sen ini ez ard well stein berg", "cyrillic": "енко ских ых ук юк ян ец ко", "greek": "άκης ίδης έλης ούσης ώνης ίτης άρης ύλης"}

_NAME = r"\p{Lu}[\p{L}'’-]+"
_TITLE = rf"(?:{'|'.join(TITLES.values())})\.? "
#: What every text with an entity has: a digit or an at sign, or a title before a capital.  Most texts have none and are passed by.
_HINTS = (r"[@\d]", rf"(?=[{''.join(sorted({t[0] for g in TITLES.values() for t in g.split('|')}))}])\b{_TITLE}\p{{Lu}}")
PATTERN = "|".join(
    [
        r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@(?:[A-Za-z0-9-]++\.)+[A-Za-z]{2,}",
        rf"(?=[{''.join(sorted({t[0] for g in TITLES.values() for t in g.split('|')}))}])\b{_TITLE}{_NAME}(?: {_NAME})?",
        r"\b[A-Z]{2}\d{2} ?[A-Z0-9]{4}(?: ?\d{4}){1,6}(?: ?\d{1,3})?\b",
        r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){3}(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)(?!\d|\.\d)",
        r"(?<![\d-])(?:\d{4}[ -]){3}\d{4}(?![\d-])|(?<!\d)3[47]\d\d[ -]\d{6}[ -]\d{5}(?!\d)|(?<![\d+])\d{13,19}(?!\d)",
        r"(?<![\d-])\d{3}-\d\d-\d{4}(?![\d-])",
        r"(?<![\d+])\+\d(?:(?:[ .-]?\(|\)[ .-]?|[ .-])?\d){7,14}(?!\d)|(?<![\d+])(?:\(\d{2,4}\) ?|\d{3}[ .-])\d{3}[ .-]\d{4}(?!\d)",
    ]
)


def _number(hexes: Column, at: Column | int) -> Column:
    """The number of four hex digits, place ``at`` of 48."""
    return F.conv(F.substring(hexes, (F.lit(at) % 48 * 4 + 1).cast("int"), F.lit(4)), 16, 10).cast("int")


def _digits(found: Column) -> Column:
    return F.regexp_replace(found, "[^0-9]", "")


def _chars(text: Column) -> Column:
    return F.filter(F.split(text, ""), lambda c: c != "")


def _luhn(digits: Column) -> Column:
    """The sum that a payment card's last digit makes a multiple of ten."""

    def worth(c, i):
        twice = c.cast("int") * 2
        return F.when(i % 2 == 1, F.when(twice > 9, twice - 9).otherwise(twice)).otherwise(c.cast("int"))

    return F.aggregate(F.transform(F.reverse(_chars(digits)), worth), F.lit(0), lambda total, x: total + x)


def _mod97(text: Column) -> Column:
    def more(rest, c):
        value = F.when(c.between("0", "9"), c.cast("int")).otherwise(F.ascii(c) - 55)
        return (F.when(value > 9, rest * 100).otherwise(rest * 10) + value) % 97

    return F.aggregate(_chars(text), F.lit(0), more)


def kind_of(found: Column) -> Column:
    """The kind of a found string; null for a long number that is no card, which is left alone."""
    return (
        F.when(found.contains("@"), "email")
        .when(found.rlike("^" + _TITLE), "name")
        .when(found.rlike(r"^[A-Z]{2}\d"), "iban")
        .when(found.rlike(r"^\d{1,3}(\.\d{1,3}){3}$"), "ipv4")
        .when(found.rlike(r"^\d{3}-\d\d-\d{4}$"), "ssn")
        .when(found.rlike(r"^\d") & (F.length(_digits(found)) > 12), F.when(_luhn(_digits(found)) % 10 == 0, "card"))
        .otherwise("phone")
    )


def gender(found: Column) -> Column:
    """f, m or n, as the title of a name says."""
    return F.when(found.rlike(rf"^(?:{TITLES['f']})\.? "), "f").when(found.rlike(rf"^(?:{TITLES['m']})\.? "), "m").otherwise("n")


def canonical(kind: Column, found: Column) -> Column:
    """Equal for all mentions of an entity; of a name, its family."""
    digits = _digits(found)
    return (
        F.when(kind == "email", F.lower(found))
        .when(kind == "name", F.lower(F.substring_index(found, " ", -1)))
        .when(kind == "iban", F.replace(found, F.lit(" "), F.lit("")))
        .when(kind == "phone", F.when(~found.startswith("+") & (F.length(digits) == 10), F.concat(F.lit("1"), digits)).otherwise(digits))
        .when(kind.isin("card", "ssn"), digits)
        .otherwise(found)
    )


def person(kind: Column, found: Column) -> Column:
    """The canonical form of a name's given part: given and family name and the title's gender; null without one."""
    bare = F.regexp_replace(found, "^" + _TITLE, "")
    return F.when((kind == "name") & bare.contains(" "), F.concat(F.lower(bare), F.lit("/"), gender(found)))


def _recode(text: Column, hexes: Column, shift: int = 0) -> Column:
    """Each digit and small letter replaced by one of its sort; all else stays."""

    def one(c, i):
        n = _number(hexes, i + shift)
        return F.when(c.between("0", "9"), (n % 10).cast("string")).when(c.between("a", "z"), F.chr(n % 26 + 97)).otherwise(c)

    return F.array_join(F.transform(_chars(text), one), "")


def _of(script: Column, table: dict[str, str], hexes: Column, at: int) -> Column:
    out = F.lit(None).cast("string")
    for name, options in table.items():
        options = options.split()
        out = F.when(script == name, F.element_at(F.array(*map(F.lit, options)), _number(hexes, at) % len(options) + 1)).otherwise(out)
    return out


def hex_stream(kind: Column, canon: Column, key: str, attempt: Column) -> Column:
    own = hmac_sha256(key.encode(), F.concat_ws("\x1f", kind, canon, attempt.cast("string")))
    return F.concat(own, *(F.sha2(F.concat(own, F.lit(f"\x1f{k}")).cast("binary"), 256) for k in (1, 2)))


def surrogate(kind: Column, canon: Column, h: Column, recoded: Column, attempt: Column) -> Column:
    """The canonical form of an entity's surrogate, from its hash stream ``h`` and its canonical form recoded by it."""
    # an address keeps its last label; after some attempts it also grows, so that short ones can't run out
    local, domain, last = F.substring_index(canon, "@", 1), F.regexp_extract(canon, r"@(.*)\.[^.]*$", 1), F.regexp_extract(canon, r"(\.[^.]*)$", 1)
    grown = F.when(attempt > 3, F.left(F.right(h, F.lit(16)), F.least(attempt, F.lit(16)))).otherwise("")
    email = F.concat(F.left(recoded, F.length(local)), grown, F.lit("@"), F.substring(recoded, F.length(local) + 2, F.length(domain)), last)
    body = F.concat(F.left(canon, F.lit(1)), F.substring(recoded, F.lit(2), F.length(canon) - 2))
    card = F.transform(F.array(body), lambda b: F.concat(b, ((10 - _luhn(F.concat(b, F.lit("0"))) % 10) % 10).cast("string")))[0]
    country, bank = F.left(canon, F.lit(2)), F.upper(F.substring(recoded, F.lit(5), F.length(canon)))
    iban = F.concat(country, F.lpad((98 - _mod97(F.concat(bank, country, F.lit("00")))).cast("string"), 2, "0"), bank)
    ipv4 = F.concat_ws(".", *((_number(h, k) % 254 + 1).cast("string") for k in range(4)))
    # the country code stays: one digit of North America's, else two, as most have
    american = F.concat(F.lit("1"), (_number(h, 40) % 8 + 2).cast("string"), F.substring(recoded, 3, 2), (_number(h, 41) % 8 + 2).cast("string"), F.substring(recoded, 6, 6))
    phone = F.when(canon.startswith("1") & (F.length(canon) == 11), american).otherwise(F.concat(F.left(canon, F.lit(2)), F.substring(recoded, F.lit(3), F.length(canon))))
    script = F.when(canon.rlike(r"^\p{IsGreek}"), "greek").when(canon.rlike(r"^\p{IsCyrillic}"), "cyrillic").otherwise("latin")
    sex = F.right(canon, F.lit(1))
    female = F.when(sex == "f", F.lit(True)).when(sex == "m", F.lit(False)).otherwise(_number(h, 0) % 2 == 0)
    first = lambda at: F.when(female, _of(script, {x: g["f"] for x, g in GIVEN.items()}, h, at)).otherwise(_of(script, {x: g["m"] for x, g in GIVEN.items()}, h, at))
    # one given name of few; after some attempts several, with hyphens
    given = F.concat(first(1), *(F.when(attempt > k, F.concat(F.lit("-"), first(5 + k))).otherwise("") for k in (2, 5, 8, 11)))
    given = F.concat(given, F.lit(" "), F.regexp_replace(F.substring_index(canon, " ", -1), "/.$", ""))
    more = [F.when(attempt > k, _of(script, STEMS, h, 5 + k)).otherwise("") for k in (1, 3, 5, 7)]
    family = F.initcap(F.concat(_of(script, STEMS, h, 2), _of(script, STEMS, h, 3), *more, _of(script, ENDS, h, 4)))
    return F.when(kind == "email", email).when(kind == "card", card).when(kind == "iban", iban).when(kind == "ipv4", ipv4).when(kind == "phone", phone).when(kind == "name", family).when(kind == "person", given).otherwise(recoded)


def _recodable(kind: Column, canon: Column) -> Column:
    return F.when(kind == "iban", F.lower(canon)).otherwise(canon)


def in_format(kind: Column, found: Column, new: Column, given: Column) -> Column:
    """A mention's surrogate in the format of the mention that it replaces; ``given`` is that of a name's person."""
    poured = F.aggregate(
        F.reverse(_chars(found)),
        F.struct(F.lit("").alias("out"), F.length(new).alias("left")),
        lambda acc, c: F.when(c.rlike("[0-9A-Za-z]") & (acc["left"] > 0), F.struct(F.concat(F.substring(new, acc["left"], F.lit(1)), acc["out"]).alias("out"), (acc["left"] - 1).alias("left"))).otherwise(
            F.struct(F.concat(c, acc["out"]).alias("out"), acc["left"].alias("left"))
        ),
    )["out"]
    title = F.regexp_extract(found, "^" + _TITLE, 0)
    bare = F.substring(found, F.length(title) + 1, F.length(found))
    cased = lambda old, x: F.when((F.length(old) > 1) & (old == F.upper(old)), F.upper(x)).otherwise(x)
    family = F.when(gender(found) == "f", F.regexp_replace(new, "ης$", "η")).otherwise(new)
    family = cased(F.substring_index(bare, " ", -1), family)
    name = F.concat(title, F.when(given.isNotNull(), F.concat(cased(F.substring_index(bare, " ", 1), F.substring_index(given, " ", 1)), F.lit(" "))).otherwise(""), family)
    return F.when(kind == "email", F.when((found == F.upper(found)) & (found != F.lower(found)), F.upper(new)).otherwise(new)).when(kind == "name", name).when(kind == "ipv4", new).otherwise(poured)


def _hinted(text: Column) -> Column:
    return F.coalesce(text.rlike(_HINTS[0]) | text.rlike(_HINTS[1]), F.lit(False))


def _entities(found: DataFrame) -> DataFrame:
    """The columns of ``found`` but found, and (kind, canon) of each entity of its mention."""
    kind, at = F.col("kind"), F.col("found")
    both = F.array(F.struct(kind.alias("kind"), canonical(kind, at).alias("canon")), F.struct(F.lit("person").alias("kind"), person(kind, at).alias("canon")))
    rows = found.withColumn("kind", kind_of(at)).where("kind IS NOT NULL")
    return rows.select(*(c for c in found.columns if c != "found"), F.inline(both)).where("canon IS NOT NULL")


def _mentions(docs: DataFrame) -> DataFrame:
    """(kind, canon) of each entity of each mention."""
    return _entities(docs.where(_hinted(F.col("text"))).select(F.explode(F.regexp_extract_all("text", F.lit(PATTERN), F.lit(0))).alias("found")))


def moved_entities(entities: DataFrame, key: str, rounds: int = 24, make=surrogate) -> DataFrame:
    """(kind, canon, new) of the distinct ``entities`` (kind, canon) whose first surrogate collides.

    New surrogates are distinct from each other, from the surrogates that stay, and
    from every real canonical form of the kind.  A person whose titles have no gender
    moves to the surrogate of the one who has.
    """
    is_person = F.col("kind") == "person"
    stem = F.regexp_replace("canon", "/.$", "")
    real = entities.select("kind", F.when(is_person, stem).otherwise(F.col("canon")).alias("real")).distinct()
    shown = F.when(F.col("kind").isin("person", "name"), F.lower("new")).otherwise(F.col("new"))
    known = entities.where(is_person & ~F.col("canon").endswith("/n")).groupBy("kind", stem.alias("stem")).agg(F.min("canon").alias("same"))
    alias = stored(entities.where(is_person & F.col("canon").endswith("/n")).withColumn("stem", stem).join(known, ["kind", "stem"]).select("kind", "canon", "same"), "aliases")
    waiting, settled, moved = entities.join(alias, ["kind", "canon"], "left_anti"), None, None
    for attempt in range(rounds):
        kind, canon = F.col("kind"), F.col("canon")
        tried = waiting.withColumn("h", hex_stream(kind, canon, key, F.lit(attempt))).withColumn("recoded", _recode(_recodable(kind, canon), F.col("h")))
        tried = tried.withColumn("new", make(kind, canon, F.col("h"), F.col("recoded"), F.lit(attempt))).select("kind", "canon", "new")
        first = tried.groupBy("kind", "new").agg(F.min("canon").alias("canon")).withColumn("real", shown).join(real, ["kind", "real"], "left_anti").drop("real")
        if settled is not None:
            first = first.join(settled, ["kind", "new"], "left_anti")
        first = stored(first, "surrogates")
        waiting = stored(waiting.join(first, ["kind", "canon"], "left_anti"), "waiting")
        if attempt:
            moved = first if moved is None else moved.unionByName(first)
        if waiting.isEmpty():
            if moved is None:
                moved = first.limit(0)
            if not alias.isEmpty():
                settled_as = F.coalesce("new", make(F.col("kind"), F.col("same"), F.col("h"), F.col("recoded"), F.lit(0)))
                named = alias.join(moved.select("kind", F.col("canon").alias("same"), "new"), ["kind", "same"], "left").withColumn("h", hex_stream(F.col("kind"), F.col("same"), key, F.lit(0))).withColumn("recoded", F.col("same"))
                moved = moved.unionByName(named.select("kind", "canon", settled_as.alias("new")))
            return moved
        settled = first.select("kind", "new") if settled is None else settled.union(first.select("kind", "new"))
    raise RuntimeError("there are more entities of a kind than surrogates")


def replace(docs: DataFrame, key: str, make=surrogate) -> DataFrame:
    """``docs`` with text replaced, and n_entities and kinds (of what was replaced, sorted).

    Whole texts are searched.  A null text stays null, with 0 entities; a text
    without an entity stays as it is.  Rows that repeat are replaced alike.  Existing
    columns n_entities and kinds are replaced; all others stay.
    """
    moved = stored(moved_entities(stored(_mentions(docs).distinct(), "entities"), key, make=make), "moved")
    kept = [F.col(f"`{c}`") for c in docs.columns if c not in ("text", "n_entities", "kinds")]
    first = F.lit(0)
    if moved.isEmpty():
        rows, lookup = docs.withColumn("__moved", F.lit(None).cast("map<string,string>")), None
    else:
        of = docs.where(_hinted(F.col("text"))).select(F.sha2("text", 256).alias("__text"), F.explode(F.regexp_extract_all("text", F.lit(PATTERN), F.lit(0))).alias("found")).distinct()
        # the moved entities of one text
        lookup = _entities(of).join(moved, ["kind", "canon"]).groupBy("__text").agg(F.map_from_entries(F.collect_set(F.struct(F.concat_ws("\x1f", "kind", "canon"), "new"))).alias("__moved"))
        rows = docs.withColumn("__text", F.sha2("text", 256)).join(lookup, "__text", "left").drop("__text")

    # each step of an array of structs is reckoned once
    rows = rows.withColumn("__gaps", F.when(_hinted(F.col("text")), F.split("text", F.lit(PATTERN), -1))).withColumn("__found", F.when(F.size("__gaps") > 1, F.regexp_extract_all("text", F.lit(PATTERN), F.lit(0))))
    rows = rows.withColumn("__m", F.transform("__found", lambda x: F.struct(x.alias("found"), kind_of(x).alias("kind"))))
    rows = rows.withColumn("__m", F.transform("__m", lambda m: F.struct(m["found"], m["kind"], canonical(m["kind"], m["found"]).alias("canon"), person(m["kind"], m["found"]).alias("person"))))
    who = F.lit("person")
    rows = rows.withColumn("__m", F.transform("__m", lambda m: F.struct(m["found"], m["kind"], m["canon"], m["person"], hex_stream(m["kind"], m["canon"], key, first).alias("h"), F.when(m["person"].isNotNull(), hex_stream(who, m["person"], key, first)).alias("p"))))
    rows = rows.withColumn("__m", F.transform("__m", lambda m: F.struct(m["found"], m["kind"], m["canon"], m["person"], m["h"], m["p"], _recode(_recodable(m["kind"], m["canon"]), m["h"]).alias("recoded"))))

    def named(kind, canon, h, recoded):
        own = make(kind, canon, h, recoded, first)
        return own if lookup is None else F.coalesce(F.element_at(F.col("__moved"), F.concat_ws("\x1f", kind, canon)), own)

    rows = rows.withColumn(
        "__m",
        F.transform("__m", lambda m: F.struct(m["found"], m["kind"], named(m["kind"], m["canon"], m["h"], m["recoded"]).alias("new"), F.when(m["person"].isNotNull(), named(who, m["person"], m["p"], m["person"])).alias("given"))),
    )
    rows = rows.withColumn("__new", F.transform("__m", lambda m: F.when(m["kind"].isNull(), m["found"]).otherwise(in_format(m["kind"], m["found"], m["new"], m["given"]))))
    rows = rows.withColumn("__kinds", F.filter(F.transform("__m", lambda m: m["kind"]), lambda k: k.isNotNull()))
    joined = F.array_join(F.zip_with("__gaps", "__new", lambda gap, new: F.concat(gap, F.coalesce(new, F.lit("")))), "")
    return rows.select(
        *kept,
        F.when(F.col("__new").isNull(), F.col("text")).otherwise(joined).alias("text"),
        F.coalesce(F.when(F.col("__kinds").isNotNull(), F.size("__kinds")), F.lit(0)).alias("n_entities"),
        F.coalesce(F.array_sort(F.array_distinct("__kinds")), F.array().cast("array<string>")).alias("kinds"),
    )
