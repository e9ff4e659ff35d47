"""Surrogates for personal data: each detected entity gets a keyed replacement of its own kind and shape.

Kinds: e-mail addresses, IPv4 addresses, card numbers, telephone numbers, and persons named after
a title. Entities are compared in canonical form (lower case, digits only; of persons the name and the
title's gender), so all mentions of one entity, in any document, get one surrogate (coreference). A
surrogate comes from a keyed digest of the canonical form: digits become digits, letters letters of
the same script and case, octets stay below 256, a card number that passes the check digit test
passes it again, a name is drawn for the title's gender and the script of the name. What separates
the parts stays as it was.

A name is whole: inner capitals, hyphens, apostrophes, initials, any number of parts. Within a document,
a person's whole name or last name without a title is a mention, too, and so is the last name
after a title of the same gender; it gets the last parts of the surrogate. Of several persons that a
mention without a title may mean, the first one is meant; one with a title then stands for itself.

Collisions: the distinct entities are checked as a table. Of those with one surrogate the least
keeps it, and one that equals another entity draws again, round by round, until surrogates are as
many as entities and none is a real entity. Where a shape has too few values, it grows: names by a
part with every fourth attempt, telephone numbers by a digit with every 32nd, addresses by a prefix.

Texts move only where a document holds an entity. The join on entities has one narrow row per
mention and one row per entity; Spark splits an entity that is mentioned everywhere.

Defined results: null texts stay null, empty ones empty. Documents are matched by id and text, so
repeated rows each come back, changed alike; a null id is an id of its own. Columns with any other
name pass through ``replace`` unchanged.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagetrove.functions.bind import bind
from pagetrove.session import write_scratch

# Titles by gender, and name parts that surrogates are made of by gender and script.
TITLES = {"f": ("Mrs", "Ms", "Miss", "Frau", "Mme", "Madame", "Señora", "Sra", "Signora", "Госпожа", "Κυρία"),
          "m": ("Mr", "Herr", "Monsieur", "Señor", "Sr", "Signor", "Господин", "Κύριος")}
PARTS = {"latin": ("ba", "co", "da", "fe", "ga", "ho", "ju", "ka", "li", "mo", "ne", "pa", "ro", "sa", "te", "vi"),
         "cyrillic": ("ба", "во", "га", "де", "жу", "за", "ка", "ли", "мо", "не", "па", "ро", "са", "те", "фи", "ша"),
         "greek": ("βα", "γο", "δε", "ζα", "θε", "κα", "λι", "μο", "νε", "πα", "ρο", "σα", "τε", "φι", "χα", "ψο")}
ENDS = {"latin": {"f": "a", "m": "n"}, "cyrillic": {"f": "ва", "m": "в"}, "greek": {"f": "α", "m": "ς"}}

KINDS = ("email", "ip", "card", "phone", "person")
_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
_TITLE = "|".join(t for g in TITLES.values() for t in g)
_NAME = r"(?:\p{Lu}['’]\p{L}+|\p{Lu}\p{L}+|\p{Lu}\.)(?:['’-]\p{L}+)*+"
PATTERNS = {
    "email": r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
    "ip": rf"(?<![\w.]){_OCTET}(?:\.{_OCTET}){{3}}(?![\w]|\.\d)",
    "card": r"(?<![\w.+-])\d(?:[ -]?\d){12,18}(?![\w]|-\d)",
    "phone": r"(?<![\w.])(?:\+\d{1,3}[ .-]?)?\(\d{2,4}\)[ .-]?\d{2,4}(?:[ .-]?\d{2,4}){1,3}(?!\w)|(?<![\w.])\+\d{1,3}(?:[ .-]?\d{2,4}){2,5}(?!\w)|(?<![\w.+-])\d{3}[ .-]\d{3}[ .-]\d{4}(?![\w]|[.-]\d)",
    "person": rf"(?<!\p{{L}})(?:{_TITLE})\.?\x20{_NAME}(?:\x20{_NAME})*+(?!\p{{L}})",
}
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
HINT = rf"[@\d]|(?:{_TITLE})"


def kind_of(value: Column) -> Column:
    """The kind of a match of ``ANY``."""
    out = F.when(F.contains(value, F.lit("@")), "email")
    for kind in ("ip", "card", "phone"):
        out = out.when(F.rlike(value, F.lit(f"^(?:{PATTERNS[kind]})$")), kind)
    return out.otherwise("person")


def canonical(kind: Column, value: Column) -> Column:
    return F.when(kind.isin("card", "phone"), F.regexp_replace(value, r"\D", "")).when(
        kind == "person", F.lower(F.regexp_replace(value, rf"^(?:{_TITLE})\.?\x20", ""))).otherwise(F.lower(value))


def gender(value: Column) -> Column:
    """Of a person's title; null without one."""
    def after(sex: str) -> Column:
        return F.rlike(value, F.lit(rf"^(?:{'|'.join(TITLES[sex])})\.?\x20"))

    return F.when(after("f"), "f").when(after("m"), "m")


def pattern_with_names(found: Column) -> Column:
    """``ANY``, and the names of the persons found, in whole and their last parts, wherever they stand alone."""
    titled = F.filter(found, lambda v: F.rlike(v, F.lit(rf"^(?:{_TITLE})\.?\x20")) & ~F.contains(v, F.lit("@")))
    names = F.transform(titled, lambda v: F.regexp_replace(v, rf"^(?:{_TITLE})\.?\x20", ""))
    last = F.filter(F.transform(names, lambda n: F.regexp_extract(n, r"(\S+)$", 1)), lambda n: ~F.endswith(n, F.lit(".")))
    longest = F.reverse(F.array_sort(F.transform(F.array_distinct(F.concat(names, last)), lambda n: F.struct(F.char_length(n), n.alias("n")))))
    either = F.array_join(F.transform(longest, lambda n: F.replace(n["n"], F.lit("."), F.lit("\\."))), "|")
    alone = F.concat(F.lit(ANY + r"|(?<![\p{L}\p{N}'’-])(?:"), either, F.lit(r")(?![\p{L}\p{N}]|-\p{L}|['’](?!s\b)\p{L})"))
    return F.when(F.size(titled) > 0, alone).otherwise(F.lit(ANY))


def mentions(text: Column) -> Column:
    return F.when(F.rlike(text, F.lit(HINT)), F.regexp_extract_all(text, F.lit(ANY), F.lit(0))).otherwise(
        F.array().cast("array<string>"))


def numbers(seed: Column) -> Column:
    """64 numbers of 0 to 65535 from keyed digests of the seed."""
    digest = F.concat(*[F.sha2(F.concat(seed, F.lit(f"|{i}")), 256) for i in range(4)])
    return F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.conv(F.substring(digest, i * 4 + 1, F.lit(4)), 16, 10).cast("int"))


def _digits(value: Column, draw: Column) -> Column:
    """The same characters with digits and small letters drawn anew; a number's first digit isn't made 0."""
    def one(c, i):
        n = F.get(draw, i % 64)
        return F.when(F.rlike(c, F.lit(r"^\d$")), F.when((i == 0) & (c != "0"), (n % 9 + 1).cast("string")).otherwise((n % 10).cast("string"))).when(
            F.rlike(c, F.lit("^[a-z]$")), F.char(n % 26 + 97)).when(
            F.rlike(c, F.lit(r"^\p{IsCyrillic}$")), F.get(F.split(F.lit("а,б,в,г,д,е,ж,з,и,к,л,м,н,о,п,р"), ","), n % 16)).when(
            F.rlike(c, F.lit(r"^\p{IsGreek}$")), F.get(F.split(F.lit("α,β,γ,δ,ε,ζ,η,θ,ι,κ,λ,μ,ν,ο,π,ρ"), ","), n % 16)).when(
            F.rlike(c, F.lit(r"^\p{L}$")), F.get(F.split(F.lit("é,è,ä,ö,ü,ñ,ó,í"), ","), n % 8)).otherwise(c)

    return F.array_join(F.transform(F.split(value, ""), one), "")


def _luhn(digits: Column) -> Column:
    """The check sum of a string of digits, modulo 10."""
    back = F.reverse(F.transform(F.split(digits, ""), lambda c: c.cast("int")))
    return F.aggregate(F.transform(back, lambda d, i: F.when(i % 2 == 1, F.when(d > 4, d * 2 - 9).otherwise(d * 2)).otherwise(d)),
                       F.lit(0), lambda a, d: a + d) % 10


def _card(value: Column, draw: Column) -> Column:
    fresh = _digits(value, draw)
    zeroed = F.concat(F.substring(fresh, F.lit(1), F.char_length(fresh) - 1), F.lit("0"))
    return F.when(_luhn(value) == 0, bind(zeroed, lambda z: F.concat(
        F.substring(z, F.lit(1), F.char_length(z) - 1), ((F.lit(10) - _luhn(z)) % 10).cast("string")))).otherwise(fresh)


def _ip(draw: Column) -> Column:
    return F.concat_ws(".", *[((F.get(draw, F.lit(i)) % (223 if i == 0 else 254)) + 1).cast("string") for i in range(4)])


def _email(value: Column, draw: Column) -> Column:
    """Local part and host labels change; the last label stays."""
    last = F.regexp_extract(value, r"(\.[^.@]+)$", 1)
    return F.concat(_digits(F.substring(value, F.lit(1), F.char_length(value) - F.char_length(last)), draw), last)


def _person(value: Column, sex: Column, draw: Column, attempt: Column) -> Column:
    """As many names as before; names grow by a part for every fourth attempt."""
    def name(script):
        parts = F.array(*map(F.lit, PARTS[script]))
        end = F.when(sex == "f", ENDS[script]["f"]).otherwise(ENDS[script]["m"])
        def word(w, k):
            whole = F.initcap(F.concat(F.array_join(F.transform(
                F.sequence(F.lit(0), F.floor(attempt / 4).cast("int") + 2), lambda j: F.get(parts, F.get(draw, (k * 16 + j) % 64) % 16)), ""), end))
            return F.when(F.endswith(w, F.lit(".")), F.concat(F.substring(whole, 1, 1), F.lit("."))).otherwise(whole)

        return F.array_join(F.transform(F.split(value, " "), word), " ")

    return F.when(F.rlike(value, F.lit(r"\p{IsCyrillic}")), name("cyrillic")).when(
        F.rlike(value, F.lit(r"\p{IsGreek}")), name("greek")).otherwise(name("latin"))


def drawn(entities: DataFrame, key: str) -> DataFrame:
    """``surrogate`` for (kind, entity, sex, attempt): the canonical form of the replacement."""
    value, person = F.col("entity"), F.col("kind") == "person"
    seed = F.concat_ws("|", F.lit(key), F.col("kind"), F.when(person, F.concat(F.col("sex"), F.lit("|"), value)).otherwise(value),
                       F.col("attempt").cast("string"))
    grown = F.floor(F.col("attempt") / 32).cast("int")
    made = bind(numbers(seed), lambda n: F.when(F.col("kind") == "email", _email(value, n)).when(
        F.col("kind") == "ip", _ip(n)).when(F.col("kind") == "card", _card(value, n)).when(
        F.col("kind") == "phone", F.concat(_digits(value, n), F.array_join(
            F.transform(F.slice(n, 17, grown), lambda x: (x % 10).cast("string")), ""))).otherwise(_person(value, F.col("sex"), n, F.col("attempt"))))
    return entities.withColumn("surrogate", F.when((F.col("kind") == "email") & (F.col("attempt") > 7), F.concat(
        F.lit("x"), F.col("attempt").cast("string"), made)).otherwise(made))


def assign(entities: DataFrame, key: str, rounds: int = 500) -> DataFrame:
    """(kind, entity, sex, surrogate): one to one within a kind, and no surrogate is an entity."""
    own = ["kind", "entity", "sex"]
    entities = entities.select("kind", "entity", F.coalesce("sex", F.lit("")).alias("sex"))
    real = entities.select("kind", F.lower("entity").alias("folded"), F.lit(True).alias("real")).distinct()
    done, left = None, entities.withColumn("attempt", F.lit(0))
    for _ in range(rounds):
        tried = drawn(left, key).withColumn("folded", F.lower("surrogate")).join(real, ["kind", "folded"], "left")
        if done is not None:
            tried = tried.join(done.select("kind", F.lower("surrogate").alias("folded"), F.lit(True).alias("used")), ["kind", "folded"], "left")
        else:
            tried = tried.withColumn("used", F.lit(None).cast("boolean"))
        tried = write_scratch(tried, "surrogates-tried")
        free = tried.filter("real is null and used is null")
        first = free.groupBy("kind", "folded").agg(F.min(F.struct("entity", "sex")).alias("first")).select("kind", "folded", "first.*")
        won = free.join(first, ["folded", *own]).select(*own, "surrogate")
        done = write_scratch(won if done is None else done.unionByName(won), "surrogates")
        left = tried.join(won.select(*own), own, "left_anti").select(*own, (F.col("attempt") + 1).alias("attempt"))
        left = write_scratch(left, "surrogates-left")
        if left.isEmpty():
            return done
    raise ValueError("no free surrogates are left in the shape of some entities")


def linked(said: DataFrame) -> DataFrame:
    """Mentions with the entity that they mean: a person's shorter mention means the longer name."""
    last = F.regexp_extract("entity", r"(\S+)$", 1)
    named = said.filter("kind = 'person'").withColumn("last", last)
    persons = named.filter("sex is not null").groupBy("id", "hash", "last", F.col("entity").alias("of"), F.col("sex").alias("of_sex")).agg(F.min("at").alias("first"))
    same = (F.col("of") == F.col("entity")) | F.endswith(F.col("of"), F.concat(F.lit(" "), F.col("entity")))
    meant = named.join(persons, ["id", "hash", "last"]).filter(same & (F.col("sex").isNull() | (F.col("sex") == F.col("of_sex"))))
    person = F.struct("first", F.col("of").alias("entity"), F.col("of_sex").alias("sex"))
    longer = F.when(F.col("of") != F.col("entity"), person)
    meant = meant.groupBy("id", "hash", "at", "value", "sex").agg(
        F.min(longer).alias("longer"), F.count_if(F.col("of") != F.col("entity")).alias("n"),
        F.min(F.when(F.col("of") == F.col("entity"), person)).alias("itself"))
    choice = F.when((F.col("n") == 1) | F.col("sex").isNull(), F.coalesce("longer", "itself")).otherwise(F.coalesce("itself", "longer"))
    people = meant.select("id", "hash", "at", "value", F.lit("person").alias("kind"), choice["entity"].alias("entity"), choice["sex"].alias("sex"))
    return said.filter("kind <> 'person'").select("id", "hash", "at", "value", "kind", "entity", F.lit("").alias("sex")).unionByName(people)


def shaped(kind: Column, value: Column, surrogate: Column) -> Column:
    """The surrogate in the mention's own shape: its separators, its case, its title."""
    def fill(v, s):
        given = F.split(s, "")
        ahead = F.transform(F.split(v, ""), lambda c, i: F.char_length(F.regexp_replace(F.substring(v, F.lit(1), i), r"\D", "")))
        more = F.substring(s, F.char_length(F.regexp_replace(v, r"\D", "")) + 1, F.lit(1 << 20))
        return F.concat(bind(given, lambda g: bind(ahead, lambda a: F.array_join(F.transform(F.split(v, ""), lambda c, i: F.when(
            F.rlike(c, F.lit(r"^\d$")), F.get(g, F.get(a, i))).otherwise(c)), ""))), more)

    def cased(v, s):
        same = F.char_length(v) == F.char_length(s)
        return F.when(F.upper(v) == v, F.when(F.lower(v) == v, s).otherwise(F.upper(s))).when(
            (F.lower(v) != v) & same, F.array_join(F.zip_with(F.split(v, ""), F.split(s, ""), lambda a, b: F.when(
                (F.upper(a) == a) & (F.lower(a) != a), F.upper(b)).otherwise(b)), "")).otherwise(s)

    title = F.regexp_extract(value, rf"^((?:{_TITLE})\.?\x20)", 1)
    parts = F.size(F.split(value, " ")) - F.when(title == "", 0).otherwise(1)
    name = bind(F.split(surrogate, " "), lambda p: F.array_join(F.slice(p, F.size(p) - parts + 1, parts), " "))
    return F.when(kind.isin("card", "phone"), fill(value, surrogate)).when(
        kind == "person", F.concat(title, name)).when(kind == "email", cased(value, surrogate)).otherwise(surrogate)


def replace(docs: DataFrame, key: str = "surrogates") -> DataFrame:
    """The documents with surrogates in their texts, all columns, and ``surrogates``:
    array<struct<kind, start, end, surrogate>> with offsets in code points of the new text."""
    if "surrogates" in docs.columns:
        raise ValueError("a column named surrogates is in the way")
    row = F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row")
    id_, text = docs["doc_id"].cast("string"), docs["text"]
    all_ = docs.select(row, F.coalesce(id_, F.lit("")).alias("id"), F.xxhash64(text, id_).alias("hash"), mentions(F.coalesce(text, F.lit(""))).alias("found"))
    pattern = pattern_with_names(F.col("found"))
    some = all_.filter(F.size("found") > 0).withColumn("pattern", pattern)
    some = some.withColumn("found", F.regexp_extract_all("row.text", F.col("pattern"), F.lit(0)))
    said = some.select("id", "hash", "found").distinct().select("id", "hash", F.posexplode("found").alias("at", "value"))
    said = said.withColumn("kind", kind_of(F.col("value"))).withColumn("entity", canonical(F.col("kind"), F.col("value")))
    said = write_scratch(said.withColumn("sex", F.when(F.col("kind") == "person", gender(F.col("value")))), "mentions")
    said = write_scratch(linked(said), "linked")
    known = assign(write_scratch(said.select("kind", "entity", "sex").distinct(), "entities"), key)
    new = said.join(known, ["kind", "entity", "sex"]).select(
        "id", "hash", F.struct("at", "kind", shaped(F.col("kind"), F.col("value"), F.col("surrogate")).alias("text")).alias("new"))
    new = new.groupBy("id", "hash").agg(F.sort_array(F.collect_list("new")).alias("new"))
    changed = some.select("row", "id", "hash", "pattern").join(new, ["id", "hash"])
    gaps = F.split(F.col("row.text"), F.col("pattern"), F.lit(-1))
    pieces = bind(gaps, lambda g: F.concat(F.transform(F.col("new"), lambda n, i: F.concat(F.get(g, i), n["text"])), F.array(F.element_at(g, -1))))
    ends = lambda p: F.aggregate(F.slice(p, 1, F.size("new")), F.array(F.lit(0)), lambda a, x: F.concat(a, F.array(F.element_at(a, -1) + F.char_length(x))))
    spans = bind(ends(F.col("pieces")), lambda e: F.transform(F.col("new"), lambda n, i: F.struct(
        n["kind"].alias("kind"), (F.get(e, i + 1) - F.char_length(n["text"])).alias("start"), F.get(e, i + 1).alias("end"), n["text"].alias("surrogate"))))
    changed = changed.withColumn("pieces", pieces).select("row", F.array_join("pieces", "").alias("new_text"), spans.alias("surrogates"))
    none = F.array().cast("array<struct<kind: string, start: int, end: int, surrogate: string>>")
    same = all_.filter(F.size("found") == 0).select("row", F.col("row.text").alias("new_text"), none.alias("surrogates"))
    out = changed.unionByName(same)
    return out.select(*[F.col("new_text").alias(c) if c == "text" else F.col(f"row.`{c}`").alias(c) for c in docs.columns], "surrogates")
