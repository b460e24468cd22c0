r"""Personal data replaced by keyed surrogates, by DataFrame functions only.

Found are e-mail addresses, secrets (long hexadecimal strings and keys with known
beginnings), IP addresses, telephone and social security numbers, IBANs, runs of 9 to 19
digits such as card numbers, and names: a given name of the lists below and the
capitalised word behind it.

A surrogate depends on a key and the entity's canonical form, so one entity has one
surrogate everywhere, however it is written: digits are poured into the original's
separators, letters into its cases. It is of the same type: digits for digits, letters
of the same script for letters, a given name of the same gender and script, octets for
octets, a card number that passes the Luhn check if the original does, the same
top-level domain. Surrogates of a type are checked against each other and against all
entities of the corpus; of two that meet, and where one is an entity itself, a further
attempt is made until none do.

Cases: null and empty texts stay, as do texts without an entity; equal rows are changed
alike. Other columns stay as they are, whatever their names, but for ``n_entities``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sheaf.llm.common import fresh, kept, without

KEY = "corpus"
# Given names by gender and script.
GIVEN = {
    "female": "Alice Anna Barbara Carmen Clara Elena Emma Helen Ingrid Julia Laura Maria Marie Monica Sarah Sofia".split(),
    "male": "Adam Carlos David Frank George Hans James John Jürgen Luis Mark Michael Paul Peter Robert Thomas".split(),
    "female_cyrillic": "Анна Дарья Елена Ирина Мария Наталья Ольга Светлана".split(),
    "male_cyrillic": "Алексей Андрей Борис Дмитрий Иван Николай Олег Сергей".split(),
}
_NAMES = "|".join(n for names in GIVEN.values() for n in names)
_OCTET = r"(?:25[0-5]|2[0-4]\d|1?\d?\d)"
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+\-])[A-Za-z0-9._%+\-]++@(?:[A-Za-z0-9\-]+\.)+[A-Za-z]{2,}",
    "secret": r"(?<![A-Za-z0-9])(?:[A-Fa-f0-9]{32,128}|AKIA[A-Z0-9]{16}|(?:sk-|ghp_|xox[bp]-)[A-Za-z0-9\-]{16,})(?![A-Za-z0-9])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "ip": rf"(?<![\d.])(?:{_OCTET}\.){{3}}{_OCTET}(?!\.?\d)",
    "ssn": r"(?<![\d\-])\d{3}-\d{2}-\d{4}(?![\d\-])",
    "phone": r"(?:\+\d{1,3}[ .\-]?(?:\(\d{1,4}\)[ .\-]?)?\d{2,4}(?:[ .\-]?\d{2,4}){1,4}|(?<!\d)\(\d{3}\) ?\d{3}[ .\-]\d{4}|(?<![\d\-])\d{3}[.\-]\d{3}[.\-]\d{4})(?!\d)",
    "number": r"(?<!\d)\d(?:[ \-]?\d){8,18}(?!\d)",
    "name": rf"(?<!\p{{L}})(?:{_NAMES}) \p{{Lu}}\p{{Ll}}+(?!\p{{L}})",
}
# Characters that a match can begin with, asked for before all else. Behind a letter of
# A to Z only numbers begin.
_BEGINS = {
    "iban": "[A-Z]", "ip": r"\d", "ssn": r"\d", "phone": r"[\d+(]", "number": r"\d",
    "name": f"[{''.join(sorted({n[0] for names in GIVEN.values() for n in names}))}]",
}
ANY = r"(?:(?<![A-Za-z])|(?=[\d+(]))(?:" + "|".join(f"(?={_BEGINS[k]})(?:{p})" if k in _BEGINS else f"(?:{p})" for k, p in PATTERNS.items()) + ")"
# Between any two characters.
EACH = r"(?!^)(?!$)"
_DIGITS = ("phone", "number", "ssn")
_LETTERS = {
    "abcdefghijklmnopqrstuvwxyz": ("aeiouy", "bcdfghjklmnpqrstvwxz"),
    "абвгдежзийклмнопрстуфхцчшщыэюя": ("аеиоуыэюя", "бвгджзклмнпрстфхцчшщ"),
}


def kind(value: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, pattern in reversed(PATTERNS.items()):
        out = F.when(value.rlike(f"^(?:{pattern})$"), name).otherwise(out)
    return out


def canonical(kind: Column, value: Column) -> Column:
    digits = F.regexp_replace(value, r"\D", "")
    return F.when(kind.isin(*_DIGITS), digits).when(kind.isin("email", "secret"), F.lower(value)).otherwise(value)


def _pick(seed: Column, at: Column, choices: str) -> Column:
    return F.substr(F.lit(choices), (F.pmod(F.xxhash64(seed, at), F.lit(len(choices))) + 1).cast("int"), F.lit(1))


def _like(seed: Column, c: Column, at: Column, letters: str = "") -> Column:
    """A character of the same sort: digit, vowel or consonant of its script and case."""
    out = F.when(c.rlike("[0-9]"), _pick(seed, at, "0123456789"))
    for every, sorts in _LETTERS.items():
        for sort in (letters,) if letters else sorts:
            out = out.when(F.contains(F.lit(sort), c), _pick(seed, at, sort))
            out = out.when(F.contains(F.lit(sort.upper()), c), _pick(seed, at, sort.upper()))
        if letters:
            break
    return out.otherwise(c)


def _chars(value: Column, change) -> Column:
    return F.array_join(F.transform(F.split(value, EACH), change), "")


def luhn(digits: Column) -> Column:
    """The Luhn sum modulo 10; 0 for valid numbers."""

    def add(total, x):
        twice = x * 2
        return F.struct((total["sum"] + F.when(total["odd"], twice - F.when(twice > 9, 9).otherwise(0)).otherwise(x)).cast("int").alias("sum"), (~total["odd"]).alias("odd"))

    values = F.transform(F.split(F.reverse(digits), EACH), lambda c: c.try_cast("int"))
    return F.aggregate(values, F.struct(F.lit(0).alias("sum"), F.lit(False).alias("odd")), add)["sum"] % 10


def surrogate(kind: Column, canon: Column, attempt: Column, key: str) -> Column:
    seed = F.sha2(F.concat_ws("|", F.lit(key), kind, canon, attempt.cast("string")), 256)
    top = F.length(canon) - F.length(F.substring_index(canon, ".", -1))
    email = _chars(canon, lambda c, i: F.when(i >= top, c).otherwise(_like(seed, c, i, "abcdefghijklmnopqrstuvwxyz")))
    head = F.length(F.regexp_extract(canon, "^(akia|sk-|ghp_|xox[bp]-)", 1))
    hexadecimal = ~canon.rlike("[^0-9a-f]")
    secret = _chars(
        canon,
        lambda c, i: F.when(i < head, c)
        .when(hexadecimal, _like(seed, c, i, "abcdef"))
        .otherwise(_like(seed, c, i, "abcdefghijklmnopqrstuvwxyz")),
    )
    iban = _chars(canon, lambda c, i: F.when(i < 2, c).otherwise(_like(seed, c, i, "abcdefghijklmnopqrstuvwxyz")))
    ip = F.array_join(F.transform(F.split(canon, r"\."), lambda o, i: (F.pmod(F.xxhash64(seed, i), F.lit(254)) + 1).cast("string")), ".")
    phone = _chars(canon, lambda c, i: F.when(i == 0, c).otherwise(_like(seed, c, i)))
    number = _chars(canon, lambda c, i: F.when((i == 0) & (c != "0"), _pick(seed, i, "123456789")).otherwise(_like(seed, c, i)))
    body = F.substr(number, F.lit(1), F.length(number) - 1)
    check = F.pmod(F.lit(10) - luhn(F.concat(body, F.lit("0"))), F.lit(10)).cast("string")
    number = F.when((kind == "number") & (luhn(canon) == 0), F.concat(body, check)).otherwise(number)
    given, surname = F.substring_index(canon, " ", 1), F.substring_index(canon, " ", -1)
    new = given
    for names in GIVEN.values():
        known = F.array(*[F.lit(n) for n in names])
        at = F.pmod(F.array_position(known, given) + F.pmod(F.xxhash64(seed, F.lit("given")), F.lit(len(names) - 1)), F.lit(len(names)))
        new = F.when(F.array_contains(known, given), F.get(known, at.cast("int"))).otherwise(new)
    name = F.concat(new, F.lit(" "), _chars(surname, lambda c, i: _like(seed, c, i)))
    return (
        F.when(kind == "email", email).when(kind == "secret", secret).when(kind == "iban", iban).when(kind == "ip", ip)
        .when(kind == "phone", phone).when(kind.isin("number", "ssn"), number).when(kind == "name", name).otherwise(canon)
    )


def poured(kind: Column, value: Column, sur: Column) -> Column:
    """A surrogate in the shape of one of the entity's writings."""

    def digit(state, c):
        new = F.when(c.rlike("[0-9]"), F.substr(sur, state["k"] + 1, F.lit(1))).otherwise(c)
        return F.struct(F.concat(state["out"], new).alias("out"), (state["k"] + c.rlike("[0-9]").cast("int")).alias("k"))

    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("k"))
    digits = F.aggregate(F.split(value, EACH), start, digit)["out"]
    cased = F.zip_with(F.split(value, EACH), F.split(sur, EACH), lambda o, s: F.when(o == F.lower(o), s).otherwise(F.upper(s)))
    return F.when(kind.isin(*_DIGITS), digits).when(kind.isin("email", "secret"), F.array_join(cased, "")).otherwise(sur)


def surrogates(entities: DataFrame, key: str = KEY) -> DataFrame:
    """(kind, canon, sur) of distinct entities (kind, canon); surrogates are distinct, and
    none is an entity."""
    tried = entities.select("kind", "canon", F.lit(0).alias("attempt"))
    same = W.partitionBy("kind", "sur").orderBy("canon")
    while True:
        made = tried.withColumn("sur", surrogate(F.col("kind"), F.col("canon"), F.col("attempt"), key))
        real = entities.select("kind", F.col("canon").alias("sur"), F.lit(True).alias("real"))
        checked = made.withColumn("nth", F.row_number().over(same)).join(real, ["kind", "sur"], "left")
        bad = F.coalesce("real", F.lit(False)) | (F.col("nth") > 1)
        checked = kept(checked.select("kind", "canon", "attempt", "sur", bad.alias("bad")), "surrogates")
        if checked.where("bad").isEmpty():
            return checked.select("kind", "canon", "sur")
        # What met is tried again; what did not keeps its surrogate, as its attempt stays.
        tried = checked.select("kind", "canon", (F.col("attempt") + F.col("bad").cast("int")).alias("attempt"))


def replace(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", key: str = KEY) -> DataFrame:
    """``docs`` with surrogates in their texts, and ``n_entities``, in place of a column of
    that name."""
    docs = without(docs, "n_entities", (id_col, text_col))
    of, of_hash, made = fresh(docs, "id", "h", "new")
    found = F.coalesce(F.col(text_col).rlike(ANY), F.lit(False))
    values = F.regexp_extract_all(F.col(text_col), F.lit(ANY), F.lit(0))
    hits = docs.where(found).select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("h"), F.posexplode(values).alias("at", "value"))
    hits = hits.distinct().withColumn("kind", kind(F.col("value")))
    hits = kept(hits.withColumn("canon", canonical(F.col("kind"), F.col("value"))), "entities")
    known = surrogates(hits.select("kind", "canon").where("kind IS NOT NULL").distinct(), key)
    new = F.coalesce(poured(F.col("kind"), F.col("value"), F.col("sur")), F.col("value"))
    written = hits.join(known, ["kind", "canon"], "left").select("id", "h", F.struct("at", new.alias("new")).alias("n"))
    per = written.groupBy(F.col("id").alias(of), F.col("h").alias(of_hash))
    per = per.agg(F.transform(F.array_sort(F.collect_list("n")), lambda n: n["new"]).alias(made))
    same = F.col(id_col).eqNullSafe(F.col(of)) & (F.xxhash64(text_col) == F.col(of_hash))
    joined = docs.where(found).join(per, same)
    glued = F.zip_with(F.split(F.col(text_col), ANY, -1), made, lambda piece, n: F.concat(piece, F.coalesce(n, F.lit(""))))
    columns = [F.array_join(glued, "").alias(c) if c == text_col else F.col(c) for c in docs.columns]
    changed = joined.select(*columns, F.size(made).alias("n_entities"))
    return changed.unionByName(docs.where(~found).select(*docs.columns, F.lit(0).alias("n_entities")))
