"""Personal data replaced by keyed surrogates of the same type, gender, script and format. DataFrame functions only."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stage, text_or_empty
from .spans import find_spans, splice

#: Spark setting of the secret key, and the key of sessions without one: set your own where texts are given away.
KEY_SETTING, KEY = "spark.graphloom.pii.key", "graphloom"
#: Draws at which a colliding surrogate grows, and after which the draws stop (never reached: each growth multiplies the space).
GROW, ROUNDS = 2, 60

# Titles by gender, given names by gender, and name parts for surrogates.
MALE_TITLES = ("Mr", "Herr", "Monsieur", "Señor", "Don", "Sir", "господин", "κύριος")
FEMALE_TITLES = ("Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Mlle", "Señora", "Doña", "Lady", "госпожа", "κυρία")
ANY_TITLES = ("Dr", "Prof")
MALE_NAMES = (
    "James John Robert Michael William David Richard Joseph Thomas Charles Daniel Matthew Anthony Paul Peter Hans Karl Jürgen Wolfgang "
    "Stefan Klaus Pierre Jean François Louis Philippe Antoine José Juan Carlos Miguel Luis Javier Иван Сергей Дмитрий Γιώργος Νίκος"
).split()
FEMALE_NAMES = (
    "Mary Patricia Jennifer Linda Elizabeth Barbara Susan Jessica Sarah Karen Nancy Lisa Anna Emma Julia Ursula Monika Sabine Petra "
    "Marie Sophie Camille Claire Hélène Isabelle María Carmen Ana Lucía Pilar Elena Анна Елена Ольга Μαρία Ελένη"
).split()
MALE_GIVEN = "Adrian Albin Anselm Bruno Casper Edgar Felix Gustav Hugo Ivo Konrad Lambert Magnus Oskar Quentin Valentin".split()
FEMALE_GIVEN = "Adela Beatrix Celia Dorothea Edith Flora Greta Helena Irma Josefa Leonora Matilda Ottilie Regina Sylvia Viola".split()
MALE_CYRILLIC, FEMALE_CYRILLIC = "Антон Борис Виктор Глеб Егор Захар Игорь Кирилл".split(), "Алла Вера Галина Дарья Жанна Зоя Инна Кира".split()
MALE_GREEK, FEMALE_GREEK = "Άγγελος Βασίλης Δημήτρης Ηλίας Θωμάς Ιάσων Λουκάς Μάρκος".split(), "Αγγελική Βάσω Δήμητρα Ζωή Θάλεια Ιωάννα Κλειώ Λυδία".split()
ABC = {"latin": "abcdefghijklmnopqrstuvwxyz", "cyrillic": "абвгдежзийклмнопрстуфхцчшщэюя", "greek": "αβγδεζηθικλμνξοπρστυφχψω"}

_OCTET = "(?:25[0-5]|2[0-4]\\d|1\\d\\d|[1-9]?\\d)"
_WORD = "\\p{Lu}[\\p{L}'’-]{1,40}+(?!\\p{L})"
_TITLES = "|".join((*FEMALE_TITLES, *MALE_TITLES, *ANY_TITLES))
#: kind -> pattern, in order of preference where they start together. Each tests its first character before all else.
PATTERNS = {
    # at most 64 characters before the @ and 253 after it, as mail addresses have; no repeated group, which a long run would nest
    "email": "(?=[\\p{L}\\p{N}_%+-])(?<![\\p{L}\\p{N}._%+-])[\\p{L}\\p{N}_%+-][\\p{L}\\p{N}._%+-]{0,63}+@[A-Za-z0-9-][A-Za-z0-9.-]{1,251}(?<=\\.[A-Za-z]{2,24})(?![A-Za-z])",
    "ip": f"(?=\\d)(?<![\\p{{L}}\\p{{N}}.]){_OCTET}(?:\\.{_OCTET}){{3}}(?!\\.?[\\p{{L}}\\p{{N}}])",
    "ssn": "(?=\\d)(?<![\\p{N}-])\\d{3}-\\d{2}-\\d{4}(?![\\p{N}-])",
    "phone": "(?=[+(\\d])(?<![\\p{L}\\p{N}+])(?:\\+\\d{1,3}[ .-]?)?(?:\\(\\d{2,4}\\) ?|\\d{3}[.-])\\d{3,4}[ .-]\\d{3,4}(?!\\p{N})|(?=\\+)(?<![\\p{L}\\p{N}+])\\+\\d{1,3}(?:[ .-]?\\d{2,4}){3,5}(?!\\p{N})",
    "iban": "(?=[A-Z])(?<![\\p{L}\\p{N}])[A-Z]{2}\\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![\\p{L}\\p{N}])",
    "card": "(?=\\d)(?<![\\p{L}\\p{N}.-])\\d(?:[ -]?\\d){12,18}(?![\\p{L}\\p{N}])",
    "name": f"(?=[\\p{{Lu}}гκ])(?<![\\p{{L}}\\p{{N}}])(?:(?:{_TITLES})\\.?\\x20{_WORD}(?:\\x20{_WORD})?|(?:{'|'.join((*MALE_NAMES, *FEMALE_NAMES))})\\x20{_WORD})",
}
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())


def _kind(value: Column) -> Column:
    """The first kind whose whole pattern the value is; look-around is dropped as the value stands alone here."""
    return F.coalesce(*[F.when(value.rlike(f"^(?:{p})$"), F.lit(k)) for k, p in PATTERNS.items()], F.lit("name"))


def _title(value: Column) -> Column:
    return F.regexp_extract(value, f"^(?:{_TITLES})\\.?\\x20", 0)


def _norm(kind: Column, value: Column) -> Column:
    """What mentions of one entity share: letters' case and separators do not tell entities apart."""
    plain = F.lower(F.regexp_replace(value, "[^\\p{L}\\p{N}]", ""))
    return F.when(kind.isin("email", "ip", "given", "surname"), F.lower(value)).otherwise(plain)


def hmac(key: str, message: Column) -> Column:
    """HMAC-SHA512 of a text, in hex."""
    raw = key.encode("utf-8")
    raw = (hashlib.sha512(raw).digest() if len(raw) > 128 else raw).ljust(128, b"\0")
    inner, outer = (F.lit(bytes(x ^ pad for x in raw)) for pad in (0x36, 0x5C))
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, message.cast("binary")), 512))), 512)


def _byte(digest: Column, i: Column) -> Column:
    return F.conv(F.substr(digest, (F.pmod(i, F.lit(64)) * 2 + 1).cast("int"), F.lit(2)), 16, 10).cast("int")


def _letter(ch: Column, v: Column) -> Column:
    def one(abc: str) -> Column:
        return F.substr(F.lit(abc), (v % len(abc) + 1).cast("int"), F.lit(1))

    new = F.when(ch.rlike("\\p{IsCyrillic}"), one(ABC["cyrillic"])).when(ch.rlike("\\p{IsGreek}"), one(ABC["greek"])).otherwise(one(ABC["latin"]))
    return F.when(ch.rlike("\\d"), (v % 10).cast("string")).when(ch.rlike("\\p{L}"), new).otherwise(ch)


def _digit(text: Column, i: Column) -> Column:
    return F.substr(text, i, F.lit(1)).cast("int")


def luhn_digit(number: Column) -> Column:
    """The check digit that belongs at the end of a number, whose own last digit is ignored."""
    n = F.length(number)
    value = lambda i: F.when((n - i) % 2 == 1, 2 * _digit(number, i) - F.when(_digit(number, i) > 4, 9).otherwise(0)).otherwise(_digit(number, i))
    total = F.aggregate(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), F.lit(0), lambda a, i: a + value(i))
    return ((10 - total % 10) % 10).cast("string")


def iban_digits(iban: Column) -> Column:
    """The two check digits, ISO 7064 MOD 97-10, of a lower-case IBAN without separators; its own ones are ignored."""
    moved = F.split(F.concat(F.substr(iban, F.lit(5)), F.substr(iban, F.lit(1), F.lit(2)), F.lit("00")), "")
    one = lambda a, c: F.when(c.rlike("[0-9]"), (a * 10 + c.cast("int")) % 97).otherwise((a * 100 + F.ascii(c) - 87) % 97)
    return F.lpad((98 - F.aggregate(F.filter(moved, lambda c: c != ""), F.lit(0), one)).cast("string"), 2, "0")


def _spelled(kind: Column, norm: Column, digest: Column, grow: int) -> Column:
    """Letters for letters and digits for digits; a mail's top-level domain, a country and a phone's prefix stay."""
    n = F.length(norm)
    keep = F.when(kind == "email", n - F.length(F.regexp_extract(norm, "\\.[a-z]+$", 0))).otherwise(n)
    head = F.when(kind.isin("card", "iban"), 1 + (kind == "iban").cast("int")).when(kind == "phone", F.when(n > 10, n - 10).otherwise(0)).otherwise(0)
    chars = F.transform(
        F.sequence(F.lit(1), F.greatest(n, F.lit(1))),
        lambda i: F.when((i > keep) | (i <= head), F.substr(norm, i, F.lit(1))).otherwise(_letter(F.substr(norm, i, F.lit(1)), _byte(digest, i))),
    )
    more = F.concat(*[_letter(F.lit("a"), _byte(digest, F.lit(40 + j))) for j in range(3 * grow)]) if grow else F.lit("")
    return F.concat(F.when(kind == "email", more).otherwise(""), F.array_join(chars, ""))


def _checked(kind: Column, norm: Column, new: Column) -> Column:
    """Check digits that were right in the original are right in the surrogate."""
    n = F.length(norm)
    card = F.concat(F.substr(new, F.lit(1), n - 1), luhn_digit(new))
    iban = F.concat(F.substr(new, F.lit(1), F.lit(2)), iban_digits(new), F.substr(new, F.lit(5)))
    return (
        F.when((kind == "card") & (luhn_digit(norm) == F.substr(norm, n, F.lit(1))), card)
        .when((kind == "iban") & (iban_digits(norm) == F.substr(norm, F.lit(3), F.lit(2))), iban)
        .otherwise(new)
    )


def _given(norm: Column, gender: Column, digest: Column, grow: int) -> Column:
    """A given name of the gender and script; double names where single ones are used up."""

    def one(names: list[str], at: int) -> Column:
        return F.lower(F.element_at(F.array(*[F.lit(x) for x in names]), _byte(digest, F.lit(at)) % len(names) + 1))

    def named(male: list[str], female: list[str], at: int) -> Column:
        return F.when(gender == "f", one(female, at)).when(gender == "m", one(male, at)).otherwise(one([*male, *female], at))

    def some(*names: list[str]) -> Column:
        return F.concat_ws("-", *[named(*names, 9 + j) for j in range(1 + grow)])

    return (
        F.when(norm.rlike("\\p{IsCyrillic}"), some(MALE_CYRILLIC, FEMALE_CYRILLIC)).when(norm.rlike("\\p{IsGreek}"), some(MALE_GREEK, FEMALE_GREEK))
        .otherwise(some(MALE_GIVEN, FEMALE_GIVEN))
    )


def _surname(norm: Column, digest: Column, grow: int) -> Column:
    """Syllables of the name's script, as long as the name or longer."""

    def of(abc: str, i: Column) -> Column:
        return F.substr(F.lit(abc), _byte(digest, i + 11) % len(abc) + 1, F.lit(1))

    def made(consonants: str, vowels: str) -> Column:
        length = F.least(F.greatest(F.length(norm), F.lit(5)), F.lit(20)) + 2 * grow
        return F.array_join(F.transform(F.sequence(F.lit(1), length), lambda i: F.when(i % 2 == 0, of(vowels, i)).otherwise(of(consonants, i))), "")

    return (
        F.when(norm.rlike("\\p{IsCyrillic}"), made("бвгдклмнрст", "аеиоу")).when(norm.rlike("\\p{IsGreek}"), made("βγδκλμνρστ", "αειου"))
        .otherwise(made("bdfgklmnrst", "aeiou"))
    )


def surrogate(kind: Column, norm: Column, gender: Column, digest: Column, grow: int = 0) -> Column:
    """The replacement of a normalised entity, as lower-case text of the same format; `grow` widens the space of names and mails."""
    octet = lambda i: F.when(F.lit(i) == 0, 1 + _byte(digest, F.lit(i)) % 223).otherwise(_byte(digest, F.lit(i))).cast("string")
    quad = F.concat_ws(".", *[octet(i) for i in range(4)])
    return (
        F.when(kind == "ip", quad).when(kind == "given", _given(norm, gender, digest, grow)).when(kind == "surname", _surname(norm, digest, grow))
        .otherwise(_checked(kind, norm, _spelled(kind, norm, digest, grow)))
    )


def _shown(kind: Column, value: Column, norm: Column, new: Column) -> Column:
    """The surrogate in the mention's format: its separators and letter case."""
    caps = F.array_join(F.transform(F.split(new, "-"), lambda w: F.concat(F.upper(F.substr(w, F.lit(1), F.lit(1))), F.substr(w, F.lit(2)))), "-")
    whole = F.when(kind.isin("given", "surname"), caps).when(kind == "ip", new)
    extra = F.greatest(F.length(new) - F.length(norm), F.lit(0))
    laid = F.aggregate(
        F.split(value, ""), F.struct((extra + 1).alias("i"), F.substr(new, F.lit(1), extra).alias("t")),
        lambda a, c: F.when(
            c.rlike("[\\p{L}\\p{N}]") | (kind == "email"),
            F.struct((a["i"] + 1).alias("i"), F.concat(a["t"], F.when(c != F.lower(c), F.upper(F.substr(new, a["i"], F.lit(1)))).otherwise(F.substr(new, a["i"], F.lit(1)))).alias("t")),
        ).otherwise(F.struct(a["i"].alias("i"), F.concat(a["t"], c).alias("t"))),
    )["t"]
    return F.coalesce(whole, laid)


def replacements(entities: DataFrame, key: str = KEY, rounds: int = ROUNDS) -> DataFrame:
    """(kind, norm, new) of distinct entities(kind, norm, gender): no two share a surrogate, none is another entity.

    All entities draw at once; those whose surrogate is another's or an original draw again with the next nonce, names
    and mails from a larger space every GROW draws. Each kind's numbers have 10**9 forms or more.
    """
    todo, done = entities, None
    used = entities.select("kind", F.col("norm").alias("new"))
    for t in range(rounds):
        digest = hmac(key, F.concat_ws("\x1f", "kind", "norm", F.lit(str(t))))
        drawn = todo.withColumn("digest", digest).withColumn("new", surrogate(F.col("kind"), F.col("norm"), F.col("gender"), F.col("digest"), t // GROW))
        first = drawn.groupBy("kind", "new").agg(F.min("norm").alias("norm"))
        good = stage(first.join(used, ["kind", "new"], "left_anti").select("kind", "norm", "new"), "surrogates")
        done = good if done is None else done.unionByName(good)
        used = used.unionByName(good.select("kind", "new"))
        todo = stage(todo.join(good, ["kind", "norm"], "left_anti"), "again")
        if todo.isEmpty():
            return done
    raise RuntimeError("surrogates still collide: a kind's numbers are used up")


def mentions(texts: DataFrame, key: str) -> DataFrame:
    """key, s, e, value, kind, gender, first of each entity in texts(key, text): a name's parts are entities of their own.

    So "Mr. John Doe" and "Mr. Doe" share the surname's surrogate. `first` tells the first part of a match.
    """
    found = texts.select(key, F.explode(find_spans(F.col("text"), ANY)).alias("x")).select(key, "x.s", "x.e", F.col("x.g0").alias("value"))
    found = found.withColumn("kind", _kind(F.col("value"))).withColumn("title", F.when(F.col("kind") == "name", _title(F.col("value"))).otherwise(""))
    t = F.length("title")
    words = F.split(F.expr("substring(value, length(title) + 1)"), " ")
    bare = F.regexp_replace("title", "[. ]", "")
    gender = (
        F.when(bare.isin(*MALE_TITLES), "m").when(bare.isin(*FEMALE_TITLES), "f")
        .when(words[0].isin(*MALE_NAMES), "m").when(words[0].isin(*FEMALE_NAMES), "f").otherwise("")
    )

    def part(s, e, value, kind, gender, first):
        return F.struct(s.alias("s"), e.alias("e"), value.alias("value"), kind.alias("kind"), gender.alias("gender"), F.lit(first).alias("first"))

    s, e, no = F.col("s"), F.col("e"), F.lit("")
    parts = (
        F.when((F.col("kind") == "name") & (F.size(words) > 1), F.array(
            part(s + t, s + t + F.length(words[0]), words[0], F.lit("given"), gender, True), part(e - F.length(F.get(words, F.lit(1))), e, F.get(words, F.lit(1)), F.lit("surname"), no, False),
        ))
        .when(F.col("kind") == "name", F.array(part(s + t, e, words[0], F.lit("surname"), no, True)))
        .otherwise(F.array(part(s, e, F.col("value"), F.col("kind"), no, True)))
    )
    found = found.select(key, F.explode(parts).alias("p")).select(key, "p.*")
    return found.withColumn("norm", _norm(F.col("kind"), F.col("value")))


def anonymise(docs: DataFrame, key: str | None = None) -> DataFrame:
    """docs with personal data in `text` replaced, and n_entities, the number of matches (a column of that name is replaced).

    key: the secret under which surrogates are drawn; else the session's spark.graphloom.pii.key, else a public constant.
    Only texts with a match take part in joins, by their hash, so copies of a text are resolved once. An entity has one
    surrogate in the whole corpus. Null and clean texts, all other columns, row counts and repeats stay as they are; an
    empty table stays empty. Mail names above 64 characters and words of names above 41 are no mails and names.
    """
    key = key or docs.sparkSession.conf.get(KEY_SETTING, KEY)
    own = "_" * max(map(len, docs.columns))
    hash_, parts = f"{own}_hash", f"{own}_parts"
    base = docs.drop("n_entities")
    hit = text_or_empty().rlike(ANY)
    clean = base.where(~hit).withColumn("n_entities", F.lit(0).cast("long"))
    dirty = base.where(hit).withColumn(hash_, F.sha2("text", 256))
    texts = dirty.groupBy(hash_).agg(F.first("text").alias("text"))
    found = stage(mentions(texts, hash_), "mentions")
    entities = stage(found.groupBy("kind", "norm").agg(F.max("gender").alias("gender")), "entities")
    named = found.join(replacements(entities, key), ["kind", "norm"])
    shown = named.withColumn("new", _shown(F.col("kind"), F.col("value"), F.col("norm"), F.col("new")))
    per_text = shown.groupBy(hash_).agg(F.sort_array(F.collect_list(F.struct("s", "e", "new", "first"))).alias(parts))
    mended = dirty.join(per_text, hash_, "left")
    text = splice(F.col("text"), F.col(parts))
    n = F.coalesce(F.size(F.filter(parts, lambda x: x["first"])), F.lit(0)).cast("long")
    mended = mended.withColumn("text", F.coalesce(text, "text")).withColumn("n_entities", n)
    return clean.unionByName(mended.drop(hash_, parts))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All whole documents with personal data replaced, and how many entities each held."""
    done = anonymise(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return done.select(F.col("doc_id").cast("long").alias("doc_id"), "n_entities", "text")
