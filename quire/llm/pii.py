"""Personal data replaced by surrogates, with DataFrame functions only.

Entities are found by one pattern. Each has parts: an address, number or secret is one, whatever its separators, case or label;
a person's given names and surname are one each. Every distinct part of the corpus gets one surrogate from a keyed digest, of its
own type and format (digits for digits, letters for letters, valid addresses, card and bank account numbers that pass or fail
their checksum as the original does, given names of the title's gender, names in the original's script). Then collisions are looked
for: two parts with one surrogate, or a surrogate that is itself in the corpus; the later ones take the digest with the
next salt, until there are none. A secret keeps its signs and the scripts of its letters; one with too few letters and digits
becomes letters and digits. What still collides after ROUNDS salts takes a longer value than its format has, so that no
corpus is without a result. So different entities stay different, and mentions of one stay one: `Mr. John Smith`, `Mr John Smith`
and `Mr Smith` get one surname, `+1 (386) 555-3733` and `+13865553733` one number, each written as the mention is.

Scale: texts are scanned once and written with the entities found and a row number; distinct parts are aggregated before
they are joined, over as many tasks as a shuffle has; only texts that hold entities are joined, by their row number, with their
replacements. All joins are merge joins, whose hot keys Spark splits; nothing that grows with the corpus is broadcast.

Defined cases: a null text stays null, an empty one empty, both with no replacements; rows may repeat or have null ids (rows
are told apart by a number of their own); an empty table gives no rows; all columns of docs are kept as they are, whatever
their names; a text's other characters are untouched; initials change by a keyed shift of the alphabet.
"""

from __future__ import annotations

import hashlib
import secrets

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.llm import scratch

# What the entities look like.
EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63}){1,8}"
SECRET = r"(?i:\b(?:api[_-]?key|access[_-]?key|token|secret|passw(?:or)?d|pwd))\s{0,3}[:=]\s{0,3}[\"']?[^\s\"']{6,}"
KEY = r"(?<![A-Za-z0-9])(?:(?:AKIA[A-Z0-9]{16}|akia[a-z0-9]{16})|gh[pousr]_[A-Za-z0-9]{36}|sk-[A-Za-z0-9]{20,64})(?![A-Za-z0-9])"
CARD = r"(?<![\d+])(?:\d{13,19}|\d{4}(?:[ -]\d{4}){3})(?!\d)"
PHONE = r"\+\d{1,3}[ .-]?\(?\d{2,4}\)?[ .-]?\d{3,4}[ .-]?\d{3,4}(?!\d)|(?:\+\d{1,3} ?|(?<![\d.-])0)\d(?:[ .-]\d{2}){4}(?!\d)|(?<![\d.-])(?:\(\d{3}\) ?|\d{3}[ .-])\d{3}[ .-]\d{4}(?!\d)"
SSN = r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])"
OCTET = r"(?:25[0-5]|2[0-4]\d|1?\d?\d)"
IP = rf"(?<![\d.]){OCTET}(?:\.{OCTET}){{3}}(?!\d|\.\d)"
IBAN = r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?\b"
MALE = r"Mr|Sir|Herr|Monsieur|Señor|Господин|господин"
FEMALE = r"Mrs|Ms|Miss|Frau|Madame|Señora|Госпожа|госпожа"
NEUTRAL = r"Dr|Prof"
NAME = r"(?:\p{Lu}\.|\p{Lu}['’]\p{Lu}\p{Ll}+|\p{Lu}\p{Ll}+(?:\p{Lu}\p{Ll}+)?)(?:-\p{Lu}\p{Ll}+)*"
PERSON = rf"(?<!\p{{L}})(?:{MALE}|{FEMALE}|{NEUTRAL})\.? (?:\p{{Lu}}\. ?){{0,3}}{NAME}(?: {NAME}){{0,3}}"
KINDS = (("email", EMAIL), ("secret", SECRET), ("key", KEY), ("ssn", SSN), ("ip", IP), ("phone", PHONE), ("card", CARD), ("iban", IBAN), ("person", PERSON))
PATTERN = "|".join(p for _, p in KINDS)
# Country codes of one and of two digits; all others have three.
COUNTRY = r"^(\+(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|\d{3}))"
# Given names by script and gender, and syllables of surnames by script.
NAMES = {
    ("latin", "male"): "Adam Bruno Carl David Emil Felix Georg Hugo Ivan Jonas Karl Leo Marco Nils Oscar Paul Rolf Simon Theo Victor",
    ("latin", "female"): "Alma Berta Clara Diana Elena Flora Greta Helga Irene Julia Karin Laura Maria Nora Olga Paula Rosa Sonia Thea Vera",
    ("cyrillic", "male"): "Андрей Борис Виктор Григорий Денис Егор Иван Кирилл Леонид Максим Никита Олег Павел Роман Сергей Тимур",
    ("cyrillic", "female"): "Алла Белла Вера Галина Дарья Елена Инна Кира Лариса Мария Нина Ольга Полина Раиса Софья Тамара",
}
SYLLABLES = {
    "latin": "ba be bo da de do fa fe fo ga ge go ka ke ko la le lo ma me mo na ne no ra re ro sa se so ta te to va ve vo wa we",
    "cyrillic": "ба бе бо да де до га ге го ка ке ко ла ле ло ма ме мо на не но ра ре ро са се со та те то ва ве во",
}
ENDINGS = {("latin", "male"): "rd", ("latin", "female"): "lia", ("cyrillic", "male"): "мир", ("cyrillic", "female"): "лия"}
ALPHABETS = (("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "^[A-Z]$"), ("".join(map(chr, range(0x410, 0x430))), "^[А-Я]$"))
# Letters that stand for a script's letters; those of scripts not named become Latin ones.
LETTERS = tuple((p, "".join(map(chr, range(first, first + n)))) for p, first, n in (
    (r"[\p{IsCyrillic}&&\p{Lu}]", 0x410, 32), (r"[\p{IsCyrillic}&&\p{L}]", 0x430, 32), (r"[\p{IsGreek}&&\p{Lu}]", 0x3A3, 7), (r"[\p{IsGreek}&&\p{L}]", 0x3B1, 25), (r"\p{IsHan}", 0x4E00, 256),
    (r"[\p{IsHiragana}&&\p{L}]", 0x3042, 80), (r"[\p{IsKatakana}&&\p{L}]", 0x30A2, 80), (r"[\p{IsHangul}&&\p{L}]", 0xAC00, 256), (r"[\p{IsArabic}&&\p{L}]", 0x628, 19), (r"[\p{IsHebrew}&&\p{L}]", 0x5D0, 27),
    (r"\p{Lu}", 0x41, 26), (r"\p{L}", 0x61, 26), (r"\p{Nd}", 0x30, 10),
))
ALPHANUMERIC = "abcdefghijklmnopqrstuvwxyz0123456789"
LEAST_VARIED = 6
KEY_SETTING = "spark.quire.pii.key"
BLOCK = 32
ROUNDS = 40
POOL_ROUNDS = 3
# Every entity has a digit, one of these signs, or begins with one of these titles.
SIGNS = ("@", "=", ":", "AKIA", "akia", "sk-", "ghp_", "gho_", "ghu_", "ghs_", "ghr_")
TITLES = tuple(f"{t}{end}" for t in (*MALE.split("|"), *FEMALE.split("|"), *NEUTRAL.split("|")) for end in (" ", "."))


def session_key(spark: SparkSession) -> str:
    """The key the session names; else a new one, so that nobody can compute these surrogates again."""
    return spark.conf.get(KEY_SETTING, None) or secrets.token_hex(32)


def may_hold(t: Column) -> Column:
    """False only for texts that the pattern cannot match; far cheaper than the pattern."""
    out = t.rlike("[0-9]")
    for s in (*SIGNS, *TITLES):
        out = out | F.contains(t, F.lit(s))
    return out


def kind_of(e: Column) -> Column:
    """The first kind whose pattern is the whole entity; what no pattern alone spans is a secret."""
    out = None
    for name, p in KINDS:
        hit = e.rlike(f"^(?:{p})$")
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise("secret")


# mentions and their parts


def _title(e: Column) -> Column:
    return F.regexp_extract(e, r"^(\p{L}+\.? )", 1)


def _names(e: Column) -> Column:
    """The names after the title, in order; an initial is one as well."""
    spaced = F.regexp_replace(F.substring(e, F.length(_title(e)) + 1, F.length(e)), r"(?<=(?:^|[ .])\p{Lu}\.)(?=\p{Lu})", " ")
    return F.split(spaced, " ")


def _label(e: Column) -> Column:
    return F.regexp_extract(e, r"^([A-Za-z_-]+\s*[:=]\s*[\"']?)", 1)


def _value(e: Column) -> Column:
    """A secret without its label and without marks of the sentence around it."""
    return F.regexp_replace(F.substring(e, F.length(_label(e)) + 1, F.length(e)), r"(?<=[^.,;]{6})[.,;]+$", "")


def _gender(title: Column) -> Column:
    bare = F.regexp_replace(title, r"[. ]+$", "")
    return F.when(bare.isin(*MALE.split("|")), "male").when(bare.isin(*FEMALE.split("|")), "female").otherwise("any")


def parts(kind: Column, e: Column) -> Column:
    """Structs (kind, value) of what a mention is made of; mentions of one thing have equal parts."""
    one = lambda value: F.array(F.struct(kind.alias("kind"), value.alias("value")))
    digits = F.regexp_replace(e, "[^0-9]", "")
    names = _names(e)
    last = F.size(names) - 1
    given = F.concat(F.lit("given "), _gender(_title(e)))
    of_person = F.transform(names, lambda n, i: F.struct(F.when(n.rlike(r"^\p{Lu}\.$"), F.lit("initial")).when(i == last, F.lit("surname")).otherwise(given).alias("kind"), F.lower(n).alias("value")))
    plain = F.when(kind == "email", F.lower(e)).when(kind == "secret", _value(e)).when(kind == "phone", F.concat(F.when(F.startswith(e, F.lit("+")), "+").otherwise(""), digits)).when(kind.isin("card", "ssn"), digits).when(kind == "iban", F.replace(e, F.lit(" "), F.lit(""))).otherwise(e)
    return F.when(kind == "person", of_person).otherwise(one(plain))


def _filled(e: Column, new: Column) -> Column:
    """The mention e with its letters and digits replaced in turn by those of new; new itself where it is longer."""
    nth = lambda i: F.length(F.regexp_replace(F.substring(e, F.lit(1), i + 1), "[^0-9A-Za-z]", ""))
    bare = F.regexp_replace(new, "[^0-9A-Za-z]", "")
    shaped = F.array_join(F.transform(F.split(e, ""), lambda c, i: F.when(c.rlike("^[0-9A-Za-z]$"), F.substring(bare, nth(i), F.lit(1))).otherwise(c)), "")
    return F.when(F.length(bare) == F.length(F.regexp_replace(e, "[^0-9A-Za-z]", "")), shaped).otherwise(new)


def _cased(e: Column, new: Column) -> Column:
    """new with capitals where e has them, if both are as long."""
    at = lambda c, i: F.when(c.rlike("^[A-Z]$"), F.upper(F.substring(new, i + 1, F.lit(1)))).otherwise(F.substring(new, i + 1, F.lit(1)))
    return F.when((F.length(e) == F.length(new)) & e.rlike("[A-Z]"), F.array_join(F.transform(F.split(e, ""), at), "")).otherwise(new)


def _initial(n: Column, key: str) -> Column:
    """An initial moved on in its alphabet, by a step of the key's."""
    out = F.when(F.lit(False), n)
    for letters, p in ALPHABETS:
        step = int(hashlib.sha256(f"{key} {p}".encode()).hexdigest(), 16) % (len(letters) - 1) + 1
        out = out.when(F.substring(n, 1, 1).rlike(p), F.translate(n, letters, letters[step:] + letters[:step]))
    return out.otherwise(n)


def assembled(kind: Column, e: Column, new: Column, key: str) -> Column:
    """The mention's surrogate from those of its parts (new, in order; null for an initial)."""
    first = new[0]
    # each name is written with a capital; a surname of two keeps its hyphen
    people = F.concat(_title(e), F.array_join(F.zip_with(_names(e), new, lambda n, s: F.coalesce(s, _initial(n, key))), " "))
    value = _value(e)
    tail = F.substring(e, F.length(_label(e)) + F.length(value) + 1, F.length(e))
    secret = F.concat(_label(e), first, tail)
    return F.when(kind == "person", people).when(kind == "secret", secret).when(kind == "email", _cased(e, first)).when(kind.isin("phone", "card", "ssn", "iban"), _filled(e, first)).otherwise(first)


# surrogates of parts


def _words(text: str) -> Column:
    return F.split(F.lit(text), " ")


def _byte(digest: Column, i: Column) -> Column:
    return F.conv(F.substring(digest, i * 2 + 1, F.lit(2)), 16, 10).cast("int")


def _shaped(s: Column, digest: Column) -> Column:
    """s with digits for digits and letters for letters (hex letters in a hex text); digest has a byte for each character."""
    hexed = ~s.rlike("[g-zG-Z]")

    def one(c: Column, i: Column) -> Column:
        b = _byte(digest, i)
        letter = lambda first, n: F.char(F.lit(first) + b % n)
        return F.when(c.rlike("^[0-9]$"), (b % 10).cast("string")).when(c.rlike("^[a-z]$"), letter(97, F.when(hexed, 6).otherwise(26))).when(c.rlike("^[A-Z]$"), letter(65, F.when(hexed, 6).otherwise(26))).otherwise(c)

    return F.array_join(F.transform(F.split(s, ""), one), "")


def _pick(letters: str, b: Column) -> Column:
    return F.substring(F.lit(letters), b % len(letters) + 1, F.lit(1))


def _secret(s: Column, digest: Column) -> Column:
    """As _shaped, with letters of other scripts replaced as well; letters and digits alone where few characters can vary."""

    def other(c: Column, i: Column) -> Column:
        out = F.when(c.rlike(r"^\p{ASCII}$"), c)
        for p, letters in LETTERS:
            out = out.when(c.rlike(f"^{p}$"), _pick(letters, _byte(digest, i)))
        return out.otherwise(c)

    chars = F.split(s, "")
    few = F.length(F.regexp_replace(s, r"[^\p{L}\p{Nd}]", "")) < LEAST_VARIED
    plain = F.array_join(F.transform(chars, lambda c, i: _pick(ALPHANUMERIC, _byte(digest, i))), "")
    shaped = _shaped(s, digest)
    wide = F.array_join(F.transform(F.split(shaped, ""), other), "")
    return F.when(few, plain).when(s.rlike(r"^\p{ASCII}*$"), shaped).otherwise(wide)


def _luhn(digits: Column) -> Column:
    """The sum of the card checksum, from the last digit on."""
    n = F.length(digits)
    d = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substring(digits, n - i, F.lit(1)).cast("int") * F.when(i % 2 == 1, 2).otherwise(1))
    return F.aggregate(d, F.lit(0), lambda a, x: a + F.when(x > 9, x - 9).otherwise(x))


def _mod97(account: Column) -> Column:
    """The remainder of a bank account number: letters count as 10 to 35, country and check digits come last."""
    turned = F.concat(F.substring(account, F.lit(5), F.length(account)), F.substring(account, 1, 4))
    step = lambda r, c: F.when(c.rlike("^[0-9]$"), (r * 10 + F.ascii(c) - 48) % 97).otherwise((r * 100 + F.ascii(c) - 55) % 97)
    return F.aggregate(F.split(turned, ""), F.lit(0), step)


def surrogates(entities: DataFrame, key: str) -> DataFrame:
    """entities (kind, value, salt) with the surrogate of that salt."""
    e, salt, kind = F.col("value"), F.col("salt"), F.col("kind")
    blocks = F.transform(F.sequence(F.lit(0), F.floor(F.length(e) / BLOCK).cast("int")), lambda i: F.sha2(F.concat_ws("\u0001", F.lit(key), kind, e, salt.cast("string"), i.cast("string")), 256))
    df = entities.withColumn("digest", F.array_join(blocks, ""))
    g = F.col("digest")
    name, domain = F.substring_index(e, "@", 1), F.substring_index(e, "@", -1)
    reserved = F.regexp_extract(domain, r"(example\.(?:com|org|net))$", 1)
    sub = F.when(reserved != "", F.substring(domain, F.lit(1), F.length(domain) - F.length(reserved))).otherwise(F.regexp_extract(domain, r"^(.*\.)[^.]*$", 1))
    end = F.when(reserved != "", reserved).otherwise(F.substring_index(domain, ".", -1))
    email = F.concat(_shaped(F.concat(name, F.lit("@"), sub), g), end)
    prefix = F.regexp_extract(e, "^(AKIA|akia|gh[pousr]_|sk-)", 1)
    own = F.concat(prefix, _shaped(F.substring(e, F.length(prefix) + 1, F.length(e)), g))
    ip = F.concat_ws(".", *[(_byte(g, F.lit(k)) % n + 1).cast("string") for k, n in enumerate((126, 254, 254, 254))])
    country = F.regexp_extract(e, COUNTRY, 1)
    shaped = F.concat(country, (_byte(g, F.lit(BLOCK - 1)) % 8 + 2).cast("string"), _shaped(F.substring(e, F.length(country) + 2, F.length(e)), g))
    phone = F.when(e.rlike(r"^\+1\d{3}555\d{4}$"), F.regexp_replace(shaped, r"^(\+1\d{3})\d{3}(\d{4})$", "$1555$2")).otherwise(shaped)
    body = F.concat(F.substring(e, 1, 1), _shaped(F.substring(e, F.lit(2), F.length(e) - 2), g))
    passes = _luhn(e) % 10 == 0
    check = (F.lit(10) - _luhn(F.concat(body, F.lit("0"))) % 10) % 10
    wrong = (check + 1 + _byte(g, F.lit(BLOCK - 2)) % 9) % 10
    card = F.concat(body, F.when(passes, check).otherwise(wrong).cast("string"))
    land, account = F.substring(e, 1, 2), _shaped(F.substring(e, F.lit(5), F.length(e)), g)
    valid = F.lpad((F.lit(98) - _mod97(F.concat(land, F.lit("00"), account))).cast("string"), 2, "0")
    iban = F.concat(land, F.when(_mod97(e) == 1, valid).otherwise(_shaped(F.substring(e, 3, 2), F.substring(g, 61, 4))), account)
    cyrillic = e.rlike(r"^\p{IsCyrillic}")
    male = (kind == "given male") | ((kind == "given any") & (_byte(g, F.lit(30)) % 2 == 0))
    by_script = lambda of: F.when(cyrillic, of("cyrillic")).otherwise(of("latin"))
    by_name = lambda of: by_script(lambda s: F.when(male, of(s, "male")).otherwise(of(s, "female")))
    pick = lambda words, k: F.element_at(words, _byte(g, k) % F.size(words) + 1)
    syllables = by_script(lambda s: _words(SYLLABLES[s]))
    built = lambda a, n: F.array_join(F.transform(F.sequence(F.lit(a), F.lit(a + n - 1)), lambda k: pick(syllables, k)), "")
    pool, ending = by_name(lambda s, x: _words(NAMES[s, x])), by_name(lambda s, x: F.lit(ENDINGS[s, x]))

    def surname(n: int) -> Column:
        first = F.initcap(built(1, n))
        return F.when(F.contains(e, F.lit("-")), F.concat(first, F.lit("-"), F.initcap(built(1 + n, 2)))).otherwise(first)

    def given(n: int) -> Column:
        """From the list, then longer ones of its own with an ending of the gender; `any` takes the digest's."""
        return F.when(salt < POOL_ROUNDS, pick(pool, F.lit(0))).otherwise(F.initcap(F.concat(built(1, n), ending)))

    is_given = F.startswith(kind, F.lit("given"))
    made = F.when(kind == "email", email).when(kind == "secret", _secret(e, g)).when(kind == "key", own).when(kind == "ip", ip).when(kind == "phone", phone).when(kind == "card", card)
    own_format = made.when(kind == "iban", iban).when(kind == "surname", surname(4)).when(is_given, given(3)).otherwise(_shaped(e, g))
    long, number = F.substring(g, 1, 32), F.array_join(F.transform(F.sequence(F.lit(0), F.lit(23)), lambda i: _pick("0123456789", _byte(g, i))), "")
    spare = F.when(kind == "email", F.concat(long, F.lit("@"), _shaped(sub, g), end)).when(kind == "secret", long).when(kind == "key", F.concat(prefix, long))
    spare = spare.when(kind == "surname", surname(20)).when(is_given, given(20)).when(kind == "iban", F.concat(land, number)).otherwise(number)
    return df.withColumn("surrogate", F.when(salt < ROUNDS, own_format).otherwise(spare)).drop("digest")


def distinct_surrogates(found: DataFrame, key: str) -> DataFrame:
    """kind, value, surrogate of the distinct parts (kind, value): of one kind no two alike, and none a value itself.

    A given name may be one of the corpus; with a surname that is not, no person of the corpus has it.
    """
    n = int(found.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    table = scratch.write(found.distinct().select("kind", "value", F.lit(0).alias("salt")), "parts")
    real = table.where(~F.startswith("kind", F.lit("given"))).select(F.col("kind").alias("_kind"), F.lower("value").alias("_real")).distinct()
    while True:
        # dealt over all tasks, however few files the table has
        made = scratch.write(surrogates(table.repartition(n, "kind", "value"), key), "made")
        order = Window.partitionBy("kind", "_low").orderBy("salt", "value")
        ranked = made.withColumn("_low", F.lower("surrogate")).withColumn("rank", F.row_number().over(order))
        checked = ranked.join(real.hint("merge"), (F.col("kind") == F.col("_kind")) & (F.col("_low") == F.col("_real")), "left")
        checked = scratch.write(checked.select("kind", "value", "salt", "surrogate", ((F.col("rank") > 1) | F.col("_real").isNotNull()).alias("collides")), "surrogates")
        scratch.drop(made)
        if not checked.where("collides").limit(1).count():
            return checked.select("kind", "value", "surrogate")
        table = checked.select("kind", "value", (F.col("salt") + F.col("collides").cast("int")).alias("salt"))


def replacements(mentions: DataFrame, key: str) -> DataFrame:
    """entity, kind, surrogate of the distinct mentions."""
    n = int(mentions.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    kinds = mentions.distinct().repartition(n, "entity").withColumn("kind", kind_of(F.col("entity")))
    table = scratch.write(kinds.withColumn("parts", parts(F.col("kind"), F.col("entity"))), "entities")
    each = table.select("entity", F.col("kind").alias("of"), F.posexplode("parts").alias("i", "part")).select("entity", "of", "i", "part.kind", "part.value")
    made = distinct_surrogates(each.where("kind <> 'initial'").select("kind", "value"), key)
    new = each.join(made.hint("merge"), ["kind", "value"], "left").groupBy("entity", F.col("of").alias("kind")).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "surrogate"))), lambda x: x["surrogate"]).alias("new"))
    return scratch.write(new.select("entity", "kind", assembled(F.col("kind"), F.col("entity"), F.col("new"), key).alias("surrogate")), "replacements")


def replace(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """All columns of docs, with the text's entities replaced, and then n_replaced and kinds (counts by kind, sorted).

    key: a secret of the deployment; with the same key the same entities get the same surrogates again.
    """
    own = docs.columns
    rest = [c for c in own if c != text]
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in rest], F.lit(0).alias("_none")).alias("rest"), F.col(text).alias("body"), F.monotonically_increasing_id().alias("row"))
    rows = scratch.write(packed.withColumn("found", F.when(may_hold(F.col("body")), F.regexp_extract_all("body", F.lit(PATTERN), F.lit(0)))), "scanned")
    here = rows.where(F.size("found") > 0)
    at = here.select("row", F.posexplode("found").alias("pos", "entity"))
    table = replacements(at.select("entity"), key)
    each = at.join(table.hint("merge"), "entity").groupBy("row").agg(F.array_sort(F.collect_list(F.struct("pos", "surrogate", "kind"))).alias("new"))
    gaps = F.split("body", PATTERN, -1)
    subs = F.concat(F.transform("new", lambda x: x["surrogate"]), F.array(F.lit("")))
    body = F.array_join(F.zip_with(gaps, subs, lambda a, b: F.concat(a, b)), "")
    names = F.transform("new", lambda x: x["kind"])
    counts = F.array_join(F.transform(F.array_sort(F.array_distinct(names)), lambda k: F.concat(k, F.lit("="), F.size(F.filter(names, lambda x: x == k)).cast("string"))), ",")
    changed = here.join(each.hint("merge"), "row").select("rest", body.alias("body"), F.size("new").cast("long").alias("n_replaced"), counts.alias("kinds"))
    plain = rows.where(F.col("found").isNull() | (F.size("found") <= 0)).select("rest", "body", F.lit(0).cast("long").alias("n_replaced"), F.lit("").alias("kinds"))
    out = changed.union(plain)
    return out.select(*[F.col("body").alias(c) if c == text else F.col(f"rest.`{c}`").alias(c) for c in own], "n_replaced", "kinds")
