"""Surrogates for personal data, with DataFrame functions only.

Entities are found by patterns, one pass over the texts. Every distinct entity (a type and a canonical form, so that one number
written in two ways is one entity) gets a keyed replacement of its type and format: digits for digits, letters for letters of
their script and case, a name for a name of its gender and script, a card number that keeps its Luhn validity. Replacements are
then checked against each other and against all entities found; those that collide draw again. From the fifth draw on each draw
is one character longer (an IPv4 address becomes an IPv6 one), so a format whose space is used up ends too. So two entities never
share a replacement, one entity always has the same, and none turns into a real one.

The key is the secret of the replacements: with it, one entity has the same replacement in every table and run. It comes from the
setting ``spark.lectern.pii.secret``; a session without the setting draws a random one, which no other session knows.

Rows and nulls: a null or empty text stays as it is, with 0 entities; repeated rows get equal texts; doc_id is not used at all.
All columns of the input stay; ``entities`` is added, and replaced if it is there. Names that start with ``__pii`` are reserved. An
empty table gives an empty table. A very long text is one string of its task and no more.
"""

from __future__ import annotations

import secrets
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern.llm.common import materialize, scratch, table

SECRET = "spark.lectern.pii.secret"
SAME_LENGTH = 4  # draws before replacements get longer
DRAWS = 64  # no format needs as many: each draw beyond SAME_LENGTH has ten times the room of the one before
# Honorifics by gender, and given names by script and gender.
MALE = ["Mr", "Herr", "Señor", "Sr", "Monsieur", "Sir", "господин"]
FEMALE = ["Mrs", "Ms", "Miss", "Frau", "Señora", "Sra", "Madame", "Mme", "госпожа"]
GIVEN = {
    ("latin", "m"): ["Adam", "Bruno", "Carl", "David", "Emil", "Felix", "Georg", "Hugo", "Ivan", "Jonas", "Karl", "Leon", "Martin", "Noah", "Oscar", "Paul"],
    ("latin", "f"): ["Anna", "Berta", "Clara", "Diana", "Elena", "Flora", "Greta", "Helena", "Irene", "Julia", "Karla", "Laura", "Maria", "Nina", "Olga", "Paula"],
    ("cyrillic", "m"): ["Антон", "Борис", "Виктор", "Глеб", "Денис", "Егор", "Иван", "Максим"],
    ("cyrillic", "f"): ["Анна", "Вера", "Галина", "Дарья", "Елена", "Ирина", "Мария", "Ольга"],
}
SYLLABLES = {
    "latin": ["ba", "be", "bo", "da", "de", "do", "ga", "ge", "ka", "ke", "ko", "la", "le", "lo", "ma", "me", "mo", "na", "ne", "no", "ra", "re", "ro", "sa", "se", "so", "ta", "te", "to", "va", "ve", "vo"],
    "cyrillic": ["ба", "бо", "ва", "во", "га", "го", "да", "до", "за", "ка", "ко", "ла", "ло", "ма", "мо", "на", "но", "па", "по", "ра", "ро", "са", "со", "та", "то", "фа"],
}
#: Scripts, and a range of small letters of each that has no gap: the first code point and how many there are.
SCRIPTS = {
    "Cyrillic": (0x430, 32), "Greek": (0x3B1, 17), "Armenian": (0x561, 38), "Hebrew": (0x5D0, 27), "Arabic": (0x62A, 17), "Devanagari": (0x915, 37), "Bengali": (0x995, 20), "Thai": (0xE01, 46),
    "Georgian": (0x10D0, 33), "Hiragana": (0x3041, 86), "Katakana": (0x30A1, 90), "Han": (0x4E00, 20902), "Hangul": (0xAC00, 11172),
}
#: One name word: an initial, or letters with hyphens and apostrophes; small particles may stand before it.
NAME = r"(?:(?:van|von|der|den|de|del|di|da|dos|la|le|el|al|bin) ){0,3}\p{Lu}(?:\.|[\p{L}\p{M}]*+(?:['’-]\p{L}[\p{L}\p{M}]*+)*+)"
HEX4 = "[0-9A-Fa-f]{1,4}"
#: What tokens of common services start with, and what follows.
TOKENS = {
    "(?:AKIA|ASIA)": "[0-9A-Z]{16}", "gh[pousr]_": "[A-Za-z0-9]{36,}+", "github_pat_": "[A-Za-z0-9_]{22,}+", "glpat-": "[A-Za-z0-9_-]{20,}+", "xox[abeprs]-": "[A-Za-z0-9-]{10,}+",
    "(?:sk|pk|rk)_(?:live|test)_": "[A-Za-z0-9]{16,}+", "sk-": "[A-Za-z0-9_-]{20,}+", "AIza": "[0-9A-Za-z_-]{35}", "eyJ": r"[A-Za-z0-9_-]{8,}+\.eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+",
}
TOKEN_STARTS = ["AKIA", "ASIA", "ghp_", "gho_", "ghu_", "ghs_", "ghr_", "github_pat_", "glpat-", "xox", "_live_", "_test_", "sk-", "AIza", "eyJ"]
OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
#: Order matters: the first pattern that fits a place takes it. Repeats are possessive or bounded, so no text makes them backtrack far.
PATTERNS = {
    "email": r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@(?:[\p{L}\p{N}-]{1,63}\.){1,8}\p{L}{2,24}+",
    "secret": r"(?<![\p{L}\p{N}])(?:(?=[a-f]*+\d)[0-9a-f]{32,}+|(?=[A-F]*+\d)[0-9A-F]{32,}+)(?![\p{L}\p{N}])",
    "token": rf"(?<![\p{{L}}\p{{N}}_-])(?:{'|'.join(a + b for a, b in TOKENS.items())})(?![\p{{L}}\p{{N}}_-])",
    "ipv6": rf"(?<![\p{{L}}\p{{N}}:.])(?=[A-Fa-f:]*+\d)(?:(?:{HEX4}:){{7}}{HEX4}|(?:{HEX4}:){{1,6}}(?::{HEX4}){{1,6}}|(?:{HEX4}:){{1,7}}:|:(?::{HEX4}){{1,7}})(?![\p{{L}}\p{{N}}:])",
    "ip": rf"(?<![\d.]){OCTET}(?:\.{OCTET}){{3}}(?!\.?\d)",
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "card": r"(?<!\d)(?:\d{4}(?:[ -]?\d{4}){3}|3[47]\d\d[ -]?\d{6}[ -]?\d{5}|3(?:0[0-5]|[689]\d)\d[ -]?\d{6}[ -]?\d{4}|4\d{12}|[4-6]\d{3}(?:[ -]?\d{4}){3}[ -]?\d{1,3})(?!\d)",
    "phone": r"(?<![\d+])(?:(?:\+\d{1,3}[ .-]?)?(?:\(\d{3}\) ?|\d{3}[ .-])\d{3}[ .-]\d{4}(?!\d)|\+(?=[1-9](?:[ .()-]{0,2}\d){6,14}(?!\d))\d{1,3}(?:[ .-]?(?:\(\d{1,4}\) ?)?\d{1,12}){1,6}(?!\d))",
    "person": rf"(?<!\p{{L}})(?:{'|'.join(MALE + FEMALE)})\.? {NAME}(?: {NAME})*+",
}
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())


def may_hold(text: Column) -> Column:
    """A cheap test that every text with an entity passes: all patterns need a digit, an @, an honorific or the start of a token."""
    literals = TOKEN_STARTS + [w for w in MALE + FEMALE if not any(o != w and o in w for o in MALE + FEMALE)]
    return reduce(lambda a, w: a | text.contains(w), literals, text.rlike(r"[\d@]"))


def kind_of(value: Column) -> Column:
    return reduce(lambda rest, t: F.when(value.rlike(f"^(?:{PATTERNS[t]})$"), t).otherwise(rest), reversed(PATTERNS), F.lit(None).cast("string"))


def canonical(kind: Column, value: Column) -> Column:
    names = F.regexp_replace(value, r"^\S+ ", "")
    woman = value.rlike(rf"^(?:{'|'.join(FEMALE)})\.? ")
    halves = F.split(F.lower(value), "::")
    groups = [F.filter(F.split(h, ":"), lambda g: g != "") for h in (halves[0], F.coalesce(F.get(halves, F.lit(1)), F.lit("")))]
    zeros = F.array_repeat(F.lit("0"), 8 - F.size(groups[0]) - F.size(groups[1]))
    full = F.array_join(F.transform(F.concat(groups[0], zeros, groups[1]), lambda g: F.lpad(g, 4, "0")), ":")
    lowered = F.transform(chars(value), lambda c: F.when(F.length(F.lower(c)) == 1, F.lower(c)).otherwise(c))  # never another length
    return (
        F.when(kind.isin("card", "phone", "ssn"), F.regexp_replace(value, r"\D", ""))
        .when(kind == "ipv6", full).when(kind == "token", value)
        .when(kind == "person", F.concat(F.when(woman, "f ").otherwise("m "), names))
        .otherwise(F.array_join(lowered, ""))
    )


def chars(text: Column) -> Column:
    return F.filter(F.split(text, ""), lambda c: c != "")


def luhn(digits: Column) -> Column:
    """Luhn sum of an array of digits, the last one counting once."""
    n = F.size(digits)
    doubled = F.transform(digits, lambda d, i: F.when((n - i) % 2 == 0, F.when(d > 4, 2 * d - 9).otherwise(2 * d)).otherwise(d))
    return F.aggregate(doubled, F.lit(0), lambda a, d: a + d)


def hashed(kind: Column, attempt: Column, key: str, part: Column, of: Column) -> Column:
    return F.sha2(F.concat_ws("|", F.lit(key), kind, attempt.cast("string"), part.cast("string"), of), 512)


def stream(kind: Column, canon: Column, attempt: Column, key: str) -> Column:
    """Keyed hex digits, two and more for each character of the replacement."""
    blocks = F.sequence(F.lit(0), ((F.length(canon) + DRAWS) / 64).cast("int"))
    return F.array_join(F.transform(blocks, lambda k: hashed(kind, attempt, key, k, F.sha2(canon, 256))), "")


def surrogate(kind: Column, canon: Column, attempt: Column, drawn: Column, key: str) -> Column:
    """Keyed replacement of a canonical form, of its type and format; other attempts give other ones. ``drawn`` is its stream."""
    more = F.greatest(F.lit(0), attempt - (SAME_LENGTH - 1))
    fill = lambda c: F.repeat(c, more)
    byte = lambda i: F.conv(F.substring(drawn, (2 * i + 1).cast("int"), F.lit(2)), 16, 10).cast("int")
    wide = lambda i: F.conv(F.substring(drawn, (2 * i + 1).cast("int"), F.lit(6)), 16, 10).cast("int")
    below = lambda hexed, at, size: F.pmod(F.conv(F.substring(hexed, at, 8), 16, 10).cast("long"), F.lit(size)).cast("int")
    digit = lambda i: (byte(i) % 10).cast("string")
    point = lambda first, n, i: F.decode(F.unhex(F.lpad(F.hex((F.lit(first) + wide(i) % n).cast("long")), 4, "0")), "UTF-16BE")
    letter = lambda c, i: reduce(lambda rest, s: F.when(c.rlike(rf"\p{{Is{s}}}"), point(*SCRIPTS[s], i)).otherwise(rest), reversed(SCRIPTS), point(0x61, 26, i))
    other = lambda c, i: F.when(c.rlike(r"\p{N}"), digit(i)).when(c.rlike(r"\p{L}"), letter(c, i)).otherwise(c)
    joined = lambda a: F.array_join(a, "")
    mail = F.concat(fill(F.lit("a")), canon)
    tail = F.length(mail) - F.length(F.substring_index(mail, ".", -1))
    email = F.transform(chars(mail), lambda c, i: F.when(i >= tail, c).otherwise(other(c, i)))
    secret = F.substring(drawn, F.lit(1), F.length(canon) + more)
    ipv6 = F.transform(chars(canon), lambda c, i: F.when(c == ":", c).otherwise(F.substring(drawn, (i + 1).cast("int"), F.lit(1))))
    start = F.length(F.regexp_extract(canon, f"^(?:{'|'.join(TOKENS)})", 0))
    upper = lambda c, i: F.when(c.rlike("[A-Z]"), point(0x41, 26, i)).when(c.rlike("[a-z]"), point(0x61, 26, i)).when(c.rlike("[0-9]"), digit(i)).otherwise(c)
    token = F.transform(chars(F.concat(canon, fill(F.lit("a")))), lambda c, i: F.when(i < start, c).otherwise(upper(c, i)))
    octets = F.transform(F.split(canon, r"\."), lambda o, i: F.when(i == 0, 1 + byte(i) % 223).otherwise(byte(i)).cast("string"))
    groups = F.transform(F.sequence(F.lit(0), F.lit(5)), lambda i: F.substring(drawn, (4 * i + 1).cast("int"), F.lit(4)))
    ip = F.when(more > 0, F.concat(F.lit("2001:db8:"), F.array_join(groups, ":"))).otherwise(F.array_join(octets, "."))
    number = chars(F.concat(canon, fill(F.lit("0"))))
    area = F.greatest(F.lit(0), F.length(canon) - 10)
    phone = F.transform(number, lambda c, i: F.when(i < area, c).otherwise(digit(i)))
    ssn = F.transform(number, lambda c, i: digit(i))
    ints = lambda a: F.transform(a, lambda c: c.cast("int"))
    card = F.transform(number, lambda c, i: F.when(i == 0, c).otherwise(digit(i)))
    short = F.slice(ints(card), 1, F.size(card) - 1)
    last = F.pmod(10 - F.pmod(luhn(F.concat(short, F.array(F.lit(0)))), F.lit(10)), F.lit(10))
    sound = F.concat(F.transform(short, lambda d: d.cast("string")), F.array(last.cast("string")))
    card = F.when(luhn(ints(chars(canon))) % 10 == 0, sound).otherwise(card)

    parts = F.split(F.substring(canon, 3, 1 << 30), " ")
    sex, first, family = F.substring(canon, 1, 1), parts[0], F.element_at(parts, -1)
    block = lambda what, of: hashed(kind, attempt, key, F.lit(what), of)
    # of the first draw one family name always has one replacement; later ones are of the whole name, for names shared by very many
    h = block("family", F.when(attempt == 0, family).otherwise(canon))

    def pick(script: str, sex: str) -> Column:
        pool = GIVEN[script, sex]
        names = F.array(*map(F.lit, pool))
        each = F.transform(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), lambda w: F.element_at(names, below(block("given", w), 1, len(pool)) + 1))
        return F.array_join(each, " ")

    def surname(script: str) -> Column:
        pool = F.array(*map(F.lit, SYLLABLES[script]))
        places = F.sequence(F.lit(0), 3 + F.least(more, F.lit(11)))
        return F.initcap(joined(F.transform(places, lambda k: F.element_at(pool, below(h, (1 + 8 * k).cast("int"), len(SYLLABLES[script])) + 1))))

    def named(script: str) -> Column:
        given = F.when(sex == "f", pick(script, "f")).otherwise(pick(script, "m"))
        return F.when(F.size(parts) > 1, F.concat_ws(" ", given, surname(script))).otherwise(surname(script))

    spelt = F.concat(F.array_join(parts, " "), fill(F.substring(family, 1, 1)))
    name = F.initcap(joined(F.transform(chars(spelt), other)))  # scripts without lists of names
    name = F.when(first.rlike(r"^\p{IsLatin}"), named("latin")).when(first.rlike(r"^\p{IsCyrillic}"), named("cyrillic")).otherwise(name)
    person = F.concat(sex, F.lit(" "), name)
    return (
        F.when(kind == "email", joined(email)).when(kind == "secret", secret).when(kind == "token", joined(token)).when(kind == "ipv6", joined(ipv6)).when(kind == "ip", ip)
        .when(kind == "card", joined(card)).when(kind == "phone", joined(phone)).when(kind == "ssn", joined(ssn)).otherwise(person)
    )


def render(kind: Column, value: Column, found: Column) -> Column:
    """The replacement in the way that ``value`` is written: its separators, its case, its honorific. What it is longer by stands
    before an e-mail's name and after a number."""
    digits_before = lambda i: F.length(F.regexp_replace(F.substring(value, F.lit(1), i.cast("int")), r"\D", ""))
    digits = F.transform(chars(value), lambda c, i: F.when(c.rlike(r"\d"), F.substring(found, (digits_before(i) + 1).cast("int"), F.lit(1))).otherwise(c))
    rest = F.substring(found, F.length(F.regexp_replace(value, r"\D", "")) + 1, F.length(found))
    more = F.length(found) - F.length(value)
    at = lambda i: F.substring(found, (i + more + 1).cast("int"), F.lit(1))
    cased = F.transform(chars(value), lambda c, i: F.when(c != F.lower(c), F.upper(at(i))).otherwise(at(i)))
    honorific = F.substring_index(value, " ", 1)
    upper_hex = (kind == "secret") & (value == F.upper(value))
    return (
        F.when(kind.isin("card", "phone", "ssn"), F.concat(F.array_join(digits, ""), rest))
        .when(kind.isin("ip", "ipv6", "token"), found)
        .when(kind == "person", F.concat(honorific, F.lit(" "), F.substring(found, 3, 1 << 30)))
        .when(upper_hex, F.upper(found))
        .when(kind == "secret", found)
        .otherwise(F.concat(F.substring(found, F.lit(1), more), F.array_join(cased, "")))
    )


def resolve(entities: DataFrame, key: str) -> DataFrame:
    """``kind, canon`` to ``kind, canon, found``: no replacement is shared, and none is one of the entities.

    Each round settles those whose draw is new; only the others draw again, so a round is about as large as what collides.
    """
    spark = entities.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    real = materialize(entities.select("kind", "canon").repartition(n, "canon"), "real")
    taken, todo, settled = real.select("kind", F.col("canon").alias("found")), real, []
    for attempt in range(DRAWS):
        k = F.lit(attempt)
        made = todo.withColumn("__pii_stream", stream(F.col("kind"), F.col("canon"), k, key))
        made = made.select("kind", "canon", surrogate(F.col("kind"), F.col("canon"), k, F.col("__pii_stream"), key).alias("found"))
        made = materialize(made, "drawn")
        gone = taken.join(made.select("kind", "found"), ["kind", "found"], "left_semi").distinct().withColumn("gone", F.lit(True))
        turn = Window.partitionBy("kind", "found").orderBy("canon")
        judged = made.join(gone, ["kind", "found"], "left").withColumn("new", F.col("gone").isNull() & (F.row_number().over(turn) == 1))
        judged = materialize(judged.select("kind", "canon", "found", "new"), "judged")
        done = judged.filter("new").select("kind", "canon", "found")
        settled.append(done)
        todo = judged.filter("not new").select("kind", "canon")
        if todo.isEmpty():
            return reduce(DataFrame.unionByName, settled)
        taken = taken.unionByName(done.select("kind", "found"))
        todo = todo.repartition(n, "canon")
    raise RuntimeError(f"entities without a replacement after {DRAWS} draws")


def secret_of(spark: SparkSession) -> str:
    """The setting, or this session's own random key."""
    if not spark.conf.get(SECRET, None):
        spark.conf.set(SECRET, secrets.token_hex(32))
    return spark.conf.get(SECRET)


def replace_pii(docs: DataFrame, key: str | None = None) -> DataFrame:
    """``docs`` with rewritten text and ``entities`` (how many were replaced). ``key`` is by default the session's.

    The patterns are run once: rows are written with what was found in them, and rows without a hit go on from there untouched.
    """
    spark = docs.sparkSession
    key = key or secret_of(spark)
    names = [c for c in docs.columns if c != "entities"]
    with scratch(spark) as keep:
        own = [F.col(f"`{c}`") for c in names]
        hits = F.when(may_hold(F.col("text")), F.regexp_extract_all("text", F.lit(ANY), F.lit(0)))
        found = docs.select(*own, hits.alias("__pii_values"))  # by itself, so that nothing evaluates it twice
        # one list, however many copies of a text hold it; no entity holds a line end
        found = found.withColumn("__pii_list", F.when(F.size("__pii_values") > 0, F.md5(F.array_join("__pii_values", "\n"))))
        found = keep(materialize(found, "found"))
        lists = found.filter("__pii_list is not null").groupBy("__pii_list").agg(F.first("__pii_values").alias("values"))
        places = materialize(lists.select("__pii_list", F.posexplode("values").alias("at", "value")), "places")
        n = int(spark.conf.get("spark.sql.shuffle.partitions"))
        values = places.select("value").distinct().repartition(n, "value").withColumn("kind", kind_of(F.col("value")))
        values = materialize(values.withColumn("canon", canonical(F.col("kind"), F.col("value"))), "values")
        settled = resolve(values.select("kind", "canon").distinct(), key)
        new = values.join(settled, ["kind", "canon"]).select("value", render(F.col("kind"), F.col("value"), F.col("found")).alias("new"))
        each = places.join(materialize(new, "new"), "value").groupBy("__pii_list").agg(F.array_sort(F.collect_list(F.struct("at", "new"))).alias("news"))
        news = keep(materialize(each.select("__pii_list", F.col("news.new").alias("__pii_new")), "news"))
    changed = found.filter("__pii_list is not null").join(news, "__pii_list").withColumn("__pii_gaps", F.split("text", ANY, -1))
    gaps = F.col("__pii_gaps")
    text = F.concat(gaps[0], F.array_join(F.zip_with(F.slice(gaps, 2, 1 << 30), F.col("__pii_new"), lambda gap, new: F.concat(new, gap)), ""))
    changed = changed.select(*[text.alias(c) if c == "text" else F.col(f"`{c}`") for c in names], F.size("__pii_new").cast("long").alias("entities"))
    return found.filter("__pii_list is null").select(*own, F.lit(0).cast("long").alias("entities")).unionByName(changed)


def op8_pii(spark, sf_dir) -> DataFrame:
    return replace_pii(table(spark, sf_dir, "documents")).select("doc_id", "text", "entities")
