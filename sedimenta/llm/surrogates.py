"""Personal data replaced by keyed surrogates, native: DataFrame expressions only.

Entities: e-mail addresses, telephone numbers (with a country code, or with an area code in brackets), IPv4 and IPv6
addresses, card numbers (16 digits, plain or in fours, with up to three more in groups; 15 digits in groups of 4, 6 and 5
or beginning with 34 or 37), identity numbers (3-2-4 digits), IBANs, secrets (32 to 64 hexadecimal digits, or a known
prefix and 16 characters and more) and persons (a title and one to three capitalised names, which may hold hyphens and
apostrophes). A surname of four letters and more that stands after a title is replaced in the rest of its text too,
where it stands as a word of its own.

Each becomes another of its kind: digits stay digits, letters become letters of the same script and case, separators and
top-level domains stay; an IBAN keeps its country, a secret its prefix, names the title, its gender and their script.

Surrogates are functions of a key and of the entity's normal form (case and separators dropped), so an entity has one
surrogate everywhere, in whatever format it is written; an address's domain and a person's names are replaced on their
own, so that what is shared stays shared. Distinctness is checked over the whole corpus: the distinct normal forms are
given their surrogates, and where two meet, or one is itself a normal form, all but one are tried again with the next
attempt number, until none clash. What is compared and tried again is the unit drawn: a surname whatever the gender, a
domain, then a whole address under its settled domain (from the eighth attempt a domain grows by letters). Those few attempts go back to their documents by a join on doc_id; without any, texts
are rewritten where they are read, and no text is moved.

Defined results: a null text stays null and has no entities; empty texts stay; rows that repeat are replaced alike; a
null doc_id is handled like any other id; an empty table gives no row. Columns other than doc_id and text are kept;
n_entities and kinds are added, and take the place of columns of these names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sedimenta.llm.common import persisted

# Titles by gender.
MALE = ("Mr", "Herr", "Monsieur", "Señor", "Г-н")
FEMALE = ("Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Señora", "Г-жа")
#: Titles of either gender; a Cyrillic name's own ending tells it, other names are drawn as men's.
EITHER = ("Dr", "Prof")
SYLLABLES = {"latin": "ba be bo da de do fa fe ga go ka ke la le lo ma mi mo na ne no pa pe ra re ri ro sa se so ta te to va ve vi".split(), "cyrillic": "ба бе бо ва ве да де до га го ка ке ла ле ло ма ми мо на не но па пе ра ре ри ро са се со та те то".split()}
ENDINGS = {("given_m", "latin"): ["rd", "n", "s", "l"], ("given_f", "latin"): ["na", "lia", "ra", "ssa"], ("surname_m", "latin"): ["son", "man", "rt", "ll"], ("given_m", "cyrillic"): ["н", "р", "л", "с"], ("given_f", "cyrillic"): ["на", "ра", "ла", "са"], ("surname_m", "cyrillic"): ["нов", "ров", "лин", "нин"], ("surname_f", "cyrillic"): ["нова", "рова", "лина", "нина"]}
ENDINGS[("surname_f", "latin")] = ENDINGS[("surname_m", "latin")]

TITLES = "|".join(sorted((*MALE, *FEMALE, *EITHER), key=len, reverse=True))
NAME = r"\p{Lu}\p{L}*(?:['’\-]\p{Lu}?\p{Ll}+)*"
#: What begins a secret that is no hexadecimal number.
PREFIXES = r"(?:sk|pk|rk|ghp|gho|github_pat|xox[abp]|AKIA|AIza)"
#: First letter and number of letters of scripts with or without case.
SCRIPTS = (("IsCyrillic", "а", 32, "А"), ("IsGreek", "α", 17, "Α"), ("IsHebrew", "א", 27, None), ("IsArabic", "ف", 8, None), ("IsHan", "一", 4096, None), ("IsHangul", "가", 4096, None), ("IsHiragana", "あ", 40, None), ("IsKatakana", "ア", 40, None), ("IsDevanagari", "क", 36, None), ("IsThai", "ก", 46, None))
KINDS = {
    "email": r"(?<![\p{L}\p{N}._%+\-])[\p{L}\p{N}._%+\-]++@[\p{L}\p{N}\-]+(?:\.[\p{L}\p{N}\-]+)*\.\p{L}{2,}",
    "phone": r"(?<![\p{L}\p{N}+])\+\d{1,3}[ .\-]?\(?\d{2,4}\)?(?:[ .\-]?\d{2,4}){2,4}(?!\d)|(?<![\p{L}\p{N}])\(\d{2,4}\)[ \-]\d{3,4}[ \-]\d{4}(?!\d)",
    "ip6": r"(?<![\p{L}\p{N}:.])(?=[0-9a-fA-F:]*\d)(?:(?:[0-9a-fA-F]{1,4}:){7}[0-9a-fA-F]{1,4}|(?:[0-9a-fA-F]{1,4}:){1,6}(?::[0-9a-fA-F]{1,4}){1,6})(?![\p{L}\p{N}:])",
    "ip": r"(?<![\p{L}\p{N}.])(?:\d{1,3}\.){3}\d{1,3}(?![\p{L}\p{N}]|\.\d)",
    "card": r"(?<![\p{L}\p{N}])\d{4}(?:\d{12}|(?: \d{4}){3}|(?:-\d{4}){3})(?:[ \-]\d{1,3})?(?![\p{L}\p{N}])|(?<![\p{L}\p{N}])(?:\d{4}([ \-])\d{6}\1\d{5}|3[47]\d{13})(?![\p{L}\p{N}])",
    "identity": r"(?<![\p{L}\p{N}\-])\d{3}-\d{2}-\d{4}(?![\p{L}\p{N}\-])",
    "iban": r"(?<![\p{L}\p{N}])[A-Z]{2}\d{2}(?:(?: [A-Z0-9]{4}){3,7}(?: [A-Z0-9]{1,4})?|[A-Z0-9]{11,30})(?![\p{L}\p{N}])",
    "secret": rf"(?<![\p{{L}}\p{{N}}])(?:[0-9a-fA-F]{{32,64}}|{PREFIXES}[_\-]?[A-Za-z0-9_\-]{{16,200}})(?![\p{{L}}\p{{N}}])",
    "person": rf"(?<!\p{{L}})(?:{TITLES})\.? {NAME}(?: {NAME}){{0,2}}",
}
ENTITY = "|".join(f"(?:{p})" for p in KINDS.values())
#: What every entity holds; texts without it are not searched.
HINT = rf"[0-9@]|{PREFIXES}[_\-]?[A-Za-z]{{16}}|(?:{TITLES})\.? "
DIGITS = ("phone", "card", "identity")


def kind_of(value: Column) -> Column:
    out = F.lit("person")
    for name, test in (("ip6", r"^[0-9a-fA-F:]+:[0-9a-fA-F]*$"), ("iban", r"^[A-Z]{2}\d{2}[A-Z0-9 ]+$"), ("secret", rf"^(?:[0-9a-fA-F]{{32,64}}|{PREFIXES}[_\-]?[A-Za-z0-9_\-]{{16,200}})$"), ("ip", r"^(?:\d{1,3}\.){3}\d{1,3}$"), ("identity", r"^\d{3}-\d{2}-\d{4}$"), ("card", r"^\d{4}[\d \-]+$"), ("phone", r"^[+(]"), ("email", "@")):
        out = F.when(value.rlike(test), F.lit(name)).otherwise(out)
    return F.when(value.rlike(rf"^(?:{TITLES})\.? "), F.lit("person")).otherwise(out)


def normal(kind: Column, value: Column) -> Column:
    bare = F.when(kind.isin(*DIGITS), F.regexp_replace(value, r"\D", "")).when(kind == "iban", F.replace(value, F.lit(" "), F.lit("")))
    return bare.when(kind == "secret", value).otherwise(F.lower(value))


def stream(key: str, kind: Column, form: Column, attempt: Column) -> Column:
    """128 hexadecimal digits, a keyed function of the entity."""
    seed = F.sha2(F.concat_ws("\x1f", F.lit(key), kind, form, attempt.cast("string")).cast("binary"), 256)
    return F.concat(seed, F.sha2(F.concat(F.lit(key), seed).cast("binary"), 256))


def byte_at(digits: Column, i: Column) -> Column:
    return F.conv(F.substr(digits, F.pmod(i, F.lit(64)).cast("int") * 2 + 1, F.lit(2)), 16, 10).cast("int")


def letter(first: str, x: Column, n: int = 26) -> Column:
    code = F.lit(ord(first)) + x % n
    return F.chr(code) if ord(first) < 128 else F.decode(F.unhex(F.lpad(F.hex(code), 4, "0")), "UTF-16BE")  # chr knows one byte only


def other_letter(c: Column, x: Column, n: int = 26) -> Column:
    """A letter of c's script and case; letters of scripts that are not named, and marks, stay."""
    upper = c.rlike(r"^\p{Lu}$")
    out = F.when(c.rlike(r"^\p{IsLatin}$"), F.when(upper, letter("A", x, n)).otherwise(letter("a", x, n)))
    for script, first, count, capital in SCRIPTS:
        own = letter(first, x, count)
        out = out.when(c.rlike(rf"^(?=\p{{L}})\p{{{script}}}$"), F.when(upper, letter(capital, x, count)).otherwise(own) if capital else own)
    return out.otherwise(c)


def like(value: Column, digits: Column, hexadecimal: bool = False) -> Column:
    """Each digit another digit, each letter another letter of its script and case, all else as it is."""

    def one(c: Column, i: Column) -> Column:
        x = byte_at(digits, i) + byte_at(digits, i + 17) * 256  # large scripts need more than a byte
        return F.when(c.rlike(r"^\d$"), (x % 10).cast("string")).when(c.rlike(r"^\p{L}$"), other_letter(c, x, 6 if hexadecimal else 26)).otherwise(c)

    return F.array_join(F.transform(F.regexp_extract_all(value, F.lit("(?s)."), F.lit(0)), one), "")


def like_bare(value: Column, digits: Column, keep: int) -> Column:
    """As like, but the k-th character follows from the stream's k-th byte whatever spaces stand between; the first `keep` stay."""
    def one(c: Column, i: Column) -> Column:
        k = F.char_length(F.replace(F.substr(value, F.lit(1), i + 1), F.lit(" "), F.lit(""))) - 1
        x = byte_at(digits, k)
        return F.when((i < keep) | (c == " "), c).when(c.rlike(r"^\d$"), (x % 10).cast("string")).otherwise(letter("A", x))

    return F.array_join(F.transform(F.regexp_extract_all(value, F.lit("(?s)."), F.lit(0)), one), "")


def other_digits(value: Column, digits: Column) -> Column:
    """The k-th digit follows from the stream's k-th byte, so the format around it does not matter."""
    chars = F.regexp_extract_all(value, F.lit("(?s)."), F.lit(0))

    def one(c: Column, i: Column) -> Column:
        k = F.char_length(F.regexp_replace(F.substr(value, F.lit(1), i + 1), r"\D", "")) - 1
        x = byte_at(digits, k)
        return F.when(~c.rlike(r"^\d$"), c).when(k == 0, (x % 9 + 1).cast("string")).otherwise((x % 10).cast("string"))

    return F.array_join(F.transform(chars, one), "")


def other_name(part: str, female: bool, form: Column, digits: Column, attempt: Column) -> Column:
    """part: given or surname; syllables and an ending of the name's script and gender. Later attempts are a syllable longer."""
    kind = f"{part}_{'f' if female else 'm'}"

    def written(script: str) -> Column:
        parts, ends = F.array(*map(F.lit, SYLLABLES[script])), F.array(*map(F.lit, ENDINGS[(kind, script)]))
        count = F.lit(2 if part == "given" else 3) + F.least(attempt, F.lit(8))
        stem = F.array_join(F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.element_at(parts, byte_at(digits, i) % len(SYLLABLES[script]) + 1)), "")
        return F.initcap(F.concat(stem, F.element_at(ends, byte_at(digits, F.lit(40)) % len(ENDINGS[(kind, script)]) + 1)))

    return F.when(form.rlike(r"\p{IsCyrillic}"), written("cyrillic")).otherwise(written("latin"))


def other_domain(key: str, domain: Column, attempt: Column) -> Column:
    """The top level stays; every eight attempts, the rest gets a letter more."""
    top = F.substring_index(domain, ".", -1)
    below = F.substr(domain, F.lit(1), F.char_length(domain) - F.char_length(top))
    below = F.concat(F.repeat(F.lit("x"), F.floor(F.least(attempt, F.lit(128)) / 8).cast("int")), below)
    return F.concat(like(below, stream(key, F.lit("domain"), F.lower(domain), attempt)), top)


def surrogate_of(key: str, kind: Column, value: Column, attempt: Column, domain_attempt: Column) -> Column:
    """The surrogate of one unit: kind is one of KINDS but person, or domain, given_m, given_f, surname_m, surname_f."""
    form = normal(kind, value)
    digits = stream(key, F.regexp_replace(kind, "_[mf]$", ""), form, attempt)
    domain, local = F.substring_index(value, "@", -1), F.substring_index(value, "@", 1)
    out = F.when(kind == "email", F.concat(like(local, digits), F.lit("@"), other_domain(key, domain, domain_attempt)))
    out = out.when(kind == "domain", other_domain(key, value, attempt))
    out = out.when(kind.isin(*DIGITS), other_digits(value, digits))
    out = out.when(kind == "ip", F.array_join(F.transform(F.split(value, r"\."), lambda o, i: (byte_at(digits, i) % 254 + 1).cast("string")), "."))
    prefix = F.regexp_extract(value, rf"^{PREFIXES}[_\-]?(?=[A-Za-z0-9_\-]{{16}})", 0)
    hexadecimal = value.rlike("^[0-9a-fA-F]{32,64}$")
    out = out.when((kind == "secret") & hexadecimal, like(value, digits, hexadecimal=True)).when(kind == "secret", F.concat(prefix, like(F.substr(value, F.char_length(prefix) + 1), digits)))
    out = out.when(kind == "ip6", F.array_join(F.transform(F.split(value, ":"), lambda o, i: F.when(o == "", o).otherwise(F.lower(F.hex(byte_at(digits, i * 2) * 256 + byte_at(digits, i * 2 + 1) + 1)))), ":"))
    out = out.when(kind == "iban", like_bare(value, digits, 2))
    for part in ("given", "surname"):
        for female in (False, True):
            out = out.when(kind == f"{part}_{'f' if female else 'm'}", other_name(part, female, form, digits, attempt))
    return out


def units(value: Column) -> Column:
    """An entity as an array of structs (kind, value): itself, or a person's names after the title."""
    kind = kind_of(value)
    title = F.regexp_extract(value, rf"^(?:{TITLES})", 0)
    female = title.isin(*FEMALE) | (title.isin(*EITHER) & value.rlike(r"\p{IsCyrillic}$") & value.rlike("[ая]$"))
    sex = F.when(female, "f").otherwise("m")
    names = F.split(F.regexp_replace(value, rf"^(?:{TITLES})\.? ", ""), " ")
    of_person = F.transform(names, lambda n, i: F.struct(F.concat(F.when(i == F.size(names) - 1, "surname_").otherwise("given_"), sex).alias("kind"), n.alias("value")))
    return F.when(kind == "person", of_person).otherwise(F.array(F.struct(kind.alias("kind"), value.alias("value"))))


def found(text: Column) -> Column:
    return F.when(text.rlike(HINT), F.regexp_extract_all(text, F.lit(ENTITY), F.lit(0))).otherwise(F.array().cast("array<string>"))


def surnames(value: Column) -> Column:
    """The surname after a title, if it has four letters and more: (title's entity) as an array of at most one struct."""
    return F.filter(units(value), lambda u: F.startswith(u["kind"], F.lit("surname")) & (F.char_length(u["value"]) >= 4) & u["value"].rlike(r"^[\p{L}'’\-]+$"))


def domain_of(value: Column) -> Column:
    return F.lower(F.substring_index(value, "@", -1))


def mentioned(documents: DataFrame, *columns: str) -> DataFrame:
    """The named columns with unit, kind and form of each thing drawn: the units, and the domains of addresses."""
    own = documents.select(*columns, F.explode(found(F.col("text"))).alias("value")).select(*columns, F.explode(drawn_units(F.col("value"))).alias("u"))
    return own.select(*columns, unit_of(F.col("u.kind")).alias("unit"), F.col("u.kind").alias("kind"), normal(F.col("u.kind"), F.col("u.value")).alias("form"))


def drawn_units(value: Column) -> Column:
    domain = F.array(F.struct(F.lit("domain").alias("kind"), domain_of(value).alias("value")))
    return F.when(kind_of(value) == "email", F.concat(units(value), domain)).otherwise(units(value))


def unit_of(kind: Column) -> Column:
    """Surnames of both genders are one unit: they share their stream, their names and their attempt."""
    return F.regexp_replace(kind, "^surname_[mf]$", "surname")


def settled(forms: DataFrame, key: str) -> DataFrame:
    """forms: unit, kind, form, domain_attempt. Adds attempt, so that no two forms of a unit meet and none is drawn itself."""
    forms = forms.withColumn("attempt", F.lit(0))
    while True:
        drawn = persisted(forms.withColumn("drawn", normal(F.col("kind"), surrogate_of(key, F.col("kind"), F.col("form"), F.col("attempt"), F.col("domain_attempt")))), "drawn")
        meeting = drawn.groupBy("unit", "drawn").agg(F.min(F.struct("attempt", "form")).alias("stays"), F.min("form").alias("least"), F.max("form").alias("most"))
        known = drawn.select("unit", F.col("form").alias("drawn"), F.lit(True).alias("known")).distinct()
        clashing = meeting.join(known, ["unit", "drawn"], "left").filter("least <> most OR known")
        again = drawn.join(clashing, ["unit", "drawn"]).filter(F.col("known") | (F.col("form") != F.col("stays.form"))).select("unit", "form")
        again = persisted(again.distinct().withColumn("again", F.lit(1)), "again")
        if again.isEmpty():
            return forms
        forms = persisted(forms.join(again, ["unit", "form"], "left").withColumn("attempt", F.col("attempt") + F.coalesce("again", F.lit(0))).drop("again"), "forms")


def attempts(documents: DataFrame, key: str) -> DataFrame:
    """(unit, form, attempt) of what clashes at first; usually nothing. Addresses are drawn under their settled domains."""
    forms = persisted(mentioned(documents).distinct(), "forms")
    others = settled(forms.filter("kind <> 'email'").withColumn("domain_attempt", F.lit(0)), key)
    domains = others.filter("kind = 'domain' AND attempt > 0").select(F.col("form").alias("__domain"), F.col("attempt").alias("domain_attempt"))
    emails = forms.filter("kind = 'email'").join(domains, domain_of(F.col("form")) == F.col("__domain"), "left").drop("__domain")
    emails = settled(persisted(emails.withColumn("domain_attempt", F.coalesce("domain_attempt", F.lit(0))), "emails"), key)
    return persisted(others.unionByName(emails).filter("attempt > 0").select("unit", "form", "attempt").distinct(), "retried")


def with_surrogates(documents: DataFrame, key: str) -> DataFrame:
    """All columns of documents, `text` with surrogates; adds n_entities and kinds (how often each kind stood in it)."""
    retried = attempts(documents.select("text"), key)
    rows, of = documents, lambda kind, value: F.lit(0)
    if not retried.isEmpty():
        own = mentioned(documents, "doc_id").select("doc_id", "unit", "form").distinct().join(retried, ["unit", "form"])
        by_id = own.groupBy(F.col("doc_id").alias("__id")).agg(F.map_from_entries(F.collect_set(F.struct(F.concat_ws("\x1f", "unit", "form"), F.col("attempt")))).alias("__attempts"))
        rows = documents.join(by_id, F.col("doc_id").eqNullSafe(F.col("__id")), "left").drop("__id")
        of = lambda kind, value: F.coalesce(F.try_element_at(F.col("__attempts"), F.concat_ws("\x1f", unit_of(kind), normal(kind, value))), F.lit(0))

    def replaced(value: Column) -> Column:
        own = F.transform(units(value), lambda u: surrogate_of(key, u["kind"], u["value"], of(u["kind"], u["value"]), of(F.lit("domain"), domain_of(u["value"]))))
        return F.concat(F.regexp_extract(value, rf"^(?:(?:{TITLES})\.? )?", 0), F.array_join(own, " "))

    rows = rows.withColumn("__found", F.coalesce(found(F.col("text")), F.array().cast("array<string>")))
    between = F.split("text", ENTITY, -1)
    own_names = F.array_distinct(F.flatten(F.transform(F.filter("__found", lambda v: kind_of(v) == "person"), surnames)))
    named = F.transform(own_names, lambda u: F.struct(u["value"].alias("old"), surrogate_of(key, u["kind"], u["value"], of(u["kind"], u["value"]), F.lit(0)).alias("new")))
    rows = rows.withColumn("__names", named)
    # a text without titles has no names; elsewhere each name is one pass over what stands between the entities
    mention = lambda text: F.when(F.size("__names") == 0, text).otherwise(F.aggregate("__names", text, lambda t, n: F.regexp_replace(t, F.concat(F.lit(r"(?<![\p{L}'’\-])"), n["old"], F.lit(r"(?![\p{L}\-])")), n["new"])))
    pieces = F.arrays_zip(between.alias("between"), F.col("__found").alias("value"))
    written = F.array_join(F.transform(pieces, lambda z: F.concat(mention(z["between"]), F.when(z["value"].isNull(), "").otherwise(replaced(z["value"])))), "")
    kinds = F.transform("__found", kind_of)
    counts = F.map_from_arrays(F.array_distinct(kinds), F.transform(F.array_distinct(kinds), lambda k: F.size(F.filter(kinds, lambda j: j == k))))
    out = rows.withColumn("n_entities", F.size("__found").cast("bigint")).withColumn("kinds", F.to_json(counts)).withColumn("text", F.when(F.size("__found") == 0, F.col("text")).otherwise(written))
    return out.drop("__found", "__attempts", "__names")
