"""PII: surrogate generation with built-in functions only.

Entities are found by patterns, of which a text is only asked those that its characters allow. Each gets a replacement from a keyed hash of its type and its normal form, so the
same entity gets the same surrogate wherever it occurs and however it is written (coreference), and nobody without the
key can tell. The replacement is of the same kind: an address stays an address with letters for letters and digits for
digits, numbers keep length, separators and country code, card and account numbers have right check digits, network addresses
have octets in range, hex keys stay hex in their case, names follow the gender of their title and their script.

Collision checks keep it distinct: over the table of all distinct entities, two entities with one surrogate, and a
surrogate that is itself a real entity, are found by aggregation and a join; the losers are drawn again with the next
attempt, until none is left; names grow by a syllable with each attempt, so they don't run out. Where a fixed form has
too few values (after MAX_ATTEMPTS) that is an error. The few that needed more than one draw are read by a scalar
subquery, as a map, if they are at most MAX_REDRAWN; beyond that each document joins its own.

Texts are split by the pattern and put together again in a projection, so they are not shuffled.

Edge cases: null texts stay null, empty ones empty; a text without entities is unchanged; repeated rows are replaced
alike; an empty table gives an empty result. Extra columns are not carried.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkweave.llm.common import row_hash, shuffle_partitions, stage_table

MAX_REDRAWN = 2_000
MAX_ATTEMPTS = 50

#: Titles by gender, and given and family names by script and gender.
FEMALE = "Mrs|Ms|Miss|Frau|Señora|Señorita|Madame|Mademoiselle|Госпожа"
MALE = "Mr|Herr|Señor|Monsieur|Господин"
NAMES = {
    ("latin", "f"): "Ada Alma Anna Berta Carla Clara Dora Edith Elena Elsa Emma Erika Eva Flora Frida Greta Hanna Helga Ida Ines Irene Iris Jana Julia Karla Laura Lea Lina Lotte Lucia Maria Marta".split(),
    ("latin", "m"): "Adam Albert Anton Bruno Carl David Edgar Emil Erik Felix Franz Fritz Georg Gustav Hans Hugo Ivan Jakob Jan Jonas Karl Leo Louis Marco Max Nico Oscar Otto Paul Peter Simon Victor".split(),
    ("latin", "last"): "Abel Adler Arnold Bach Bauer Becker Berg Brandt Braun Busch Conrad Engel Ernst Falk Fischer Frank Graf Haas Hahn Hermann Horn Huber Jung Kaiser Keller Koch Kraus Kuhn Lang Lorenz Ludwig Maier".split(),
    ("cyrillic", "f"): "Анна Вера Галина Дарья Елена Ирина Лидия Мария Нина Ольга Полина Раиса Софья Тамара Ульяна Юлия".split(),
    ("cyrillic", "m"): "Антон Борис Вадим Глеб Денис Егор Иван Кирилл Лев Максим Никита Олег Павел Роман Семён Юрий".split(),
    ("cyrillic", "last"): "Абрамов Белов Волков Гусев Данилов Ершов Жуков Зайцев Исаев Ковалёв Лебедев Морозов Новиков Орлов Павлов Соколов".split(),
}

#: A syllable for each hex digit, that a name takes on with each further draw.
SYLLABLES = {"latin": "ba de fi go hu ka le mi no pu ra se ti vo wa ze".split(), "cyrillic": "ба де фи го ху ка ле ми но пу ра се ти во ва зе".split()}

#: One alternative for each type, the more special first.
PATTERNS = {
    "email": r"(?<![\w.%+\-])[A-Za-z0-9._%+\-]++@[A-Za-z0-9\-]+(?:\.[A-Za-z0-9\-]+)*\.[A-Za-z]{2,}",
    "secret": r"(?<![A-Za-z0-9])(?:[0-9a-f]{32,}|[0-9A-F]{32,}|AKIA[0-9A-Z]{16}|(?:sk|pk|ghp|gho|xox[abp])[\-_][A-Za-z0-9_\-]{16,})(?![A-Za-z0-9])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,4})?(?![A-Za-z0-9])",
    "ip": r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?!\.?\d)",
    "ssn": r"(?<![\d\-])\d{3}-\d{2}-\d{4}(?![\d\-])",
    "phone": r"(?<![\d+])(?:\+\d{1,3}[ .\-]?(?:\(\d{1,4}\)[ .\-]?)?\d{2,4}(?:[ .\-]?\d{2,4}){1,4}|\(\d{3}\) ?\d{3}[ .\-]\d{4}|\d{3}[.\-]\d{3}[.\-]\d{4})(?!\d)",
    "card": r"(?<![\d.\-])\d(?:[ \-]?\d){12,18}(?![\d\-])",
    "name": rf"(?<!\p{{L}})(?:{FEMALE}|{MALE})\.? \p{{Lu}}\p{{Ll}}+(?: \p{{Lu}}\p{{Ll}}+)?",
}
_TITLED = rf"(?=[{''.join(sorted({t[0] for t in f'{FEMALE}|{MALE}'.split('|')}))}])(?:{PATTERNS['name']})"
_NUMBERS = "|".join(f"(?:{PATTERNS[k]})" for k in ("ip", "ssn", "phone", "card"))
#: For texts without "@", and for those without digits too. What can't begin at a character isn't tried there.
NO_EMAIL = rf"(?<![A-Za-z0-9])(?=[A-Za-z0-9])(?:(?:{PATTERNS['secret']})|(?=[A-Z]{{2}})(?:{PATTERNS['iban']}))|(?=[\d(+])(?:{_NUMBERS})|{_TITLED}"
NO_DIGIT = rf"(?<![A-Za-z0-9])(?:{PATTERNS['secret']})|{_TITLED}"
PATTERN = rf"(?:{PATTERNS['email']})|{NO_EMAIL}"


def found_in(text: Column) -> Column:
    """The mentions of entities in a text, in order."""
    of = lambda p: F.regexp_extract_all(text, F.lit(p), F.lit(0))
    return F.when(text.contains("@"), of(PATTERN)).when(text.rlike("[0-9]"), of(NO_EMAIL)).otherwise(of(NO_DIGIT))


def kind_of(m: Column) -> Column:
    out = F.lit("name")
    for kind, p in reversed([x for x in PATTERNS.items() if x[0] != "name"]):
        out = F.when(m.rlike(f"^(?:{p})$"), kind).otherwise(out)
    return out


def normal(kind: Column, m: Column) -> Column:
    """What is equal for mentions of one entity: digits of numbers, lower case of the rest, names without title dots."""
    digits = F.regexp_replace(m, r"[^0-9]", "")
    return F.when(kind.isin("phone", "card", "ssn"), digits).when(kind == "iban", F.regexp_replace(m, " ", "")).when(kind == "name", F.concat_ws(" ", gender(m), F.regexp_replace(m, r"^\S+\s", ""))).when(kind == "secret", m).otherwise(F.lower(m))


def gender(m: Column) -> Column:
    return F.when(m.rlike(rf"^(?:{FEMALE})\b"), "f").otherwise("m")


def _nibble(h: Column, i: Column) -> Column:
    """The i-th hex digit, as a number; i from 0, around the hash's 64."""
    a = F.ascii(F.substr(h, i % 64 + 1, F.lit(1)))
    return F.when(a >= 97, a - 87).otherwise(a - 48)


def _alike(m: Column, h: Column, skip: Column | None = None) -> Column:
    """Letters for letters, digits for digits, by place; the first ``skip`` characters stay."""

    def one(c: Column, i: Column) -> Column:
        v = _nibble(h, i * 2) * 16 + _nibble(h, i * 2 + 1)
        new = F.when(c.rlike("[0-9]"), (v % 10).cast("string")).when(c.rlike("[a-z]"), F.char(v % 26 + 97)).when(c.rlike("[A-Z]"), F.char(v % 26 + 65)).otherwise(c)
        return F.when(i < skip, c).otherwise(new) if skip is not None else new

    return F.array_join(F.transform(F.split(m, ""), one), "")


def _digits(m: Column, h: Column, keep: Column) -> Column:
    """New digits by their number among the digits, so that separators don't matter; the first ``keep`` stay."""

    def one(c: Column, i: Column) -> Column:
        n = F.length(F.regexp_replace(F.substr(m, F.lit(1), i), r"[^0-9]", ""))
        v = _nibble(h, n * 2) * 16 + _nibble(h, n * 2 + 1)
        return F.when(c.rlike("[0-9]") & (n >= keep), (v % 10).cast("string")).otherwise(c)

    return F.array_join(F.transform(F.split(m, ""), one), "")


def _checked(m: Column) -> Column:
    """m with its last digit set to the Luhn check digit."""
    d = F.regexp_replace(m, r"[^0-9]", "")
    each = F.transform(F.split(F.substr(d, F.lit(1), F.length(d) - 1), ""), lambda c, i: F.when((F.length(d) - i) % 2 == 0, F.when(c.cast("int") * 2 > 9, c.cast("int") * 2 - 9).otherwise(c.cast("int") * 2)).otherwise(c.cast("int")))
    total = F.aggregate(each, F.lit(0), lambda a, x: a + x)
    last = ((F.lit(10) - total % 10) % 10).cast("string")
    return F.concat(F.regexp_extract(m, r"^(.*)\d(\D*)$", 1), last, F.regexp_extract(m, r"^(.*)\d(\D*)$", 2))


def _account(m: Column) -> Column:
    """m, of blanks, digits and capitals, with the check digits of an IBAN: the number modulo 97 is 1."""
    bare = F.regexp_replace(m, " ", "")
    turned = F.split(F.concat(F.substr(bare, F.lit(5)), F.substr(bare, F.lit(1), F.lit(2)), F.lit("00")), "")
    rest = F.aggregate(turned, F.lit(0), lambda r, c: F.when(c.rlike("[0-9]"), (r * 10 + F.ascii(c) - 48) % 97).otherwise((r * 100 + F.ascii(c) - 55) % 97))
    return F.concat(F.substr(m, F.lit(1), F.lit(2)), F.lpad((F.lit(98) - rest).cast("string"), 2, "0"), F.substr(m, F.lit(5)))


def _pick(h: Column, at: int, names: list[str]) -> Column:
    v = F.conv(F.substr(h, F.lit(at), F.lit(8)), 16, 10).cast("long")
    return F.get(F.split(F.lit(" ".join(names)), " "), (v % len(names)).cast("int"))


def _more(h: Column, attempt: Column, syllables: list[str]) -> Column:
    each = F.transform(F.sequence(F.lit(0), attempt), lambda i: F.when(i < attempt, F.get(F.split(F.lit(" ".join(syllables)), " "), _nibble(h, i + 16))).otherwise(""))
    return F.array_join(each, "")


def _name(m: Column, h: Column, attempt: Column) -> Column:
    title = F.regexp_extract(m, r"^(\S+ )", 1)
    cyrillic = m.rlike(r"[Ѐ-ӿ]+(?: [Ѐ-ӿ]+)?$")
    woman = gender(m) == "f"
    first = F.when(cyrillic & woman, _pick(h, 1, NAMES["cyrillic", "f"])).when(cyrillic, _pick(h, 1, NAMES["cyrillic", "m"])).when(woman, _pick(h, 1, NAMES["latin", "f"])).otherwise(_pick(h, 1, NAMES["latin", "m"]))
    last = F.when(cyrillic, F.concat(_pick(h, 9, NAMES["cyrillic", "last"]), _more(h, attempt, SYLLABLES["cyrillic"]), F.when(woman, "а").otherwise(""))).otherwise(F.concat(_pick(h, 9, NAMES["latin", "last"]), _more(h, attempt, SYLLABLES["latin"])))
    two = F.size(F.split(m, " ")) > 2
    return F.concat(title, F.when(two, F.concat_ws(" ", first, last)).otherwise(last))


def surrogates(mentions: Column, attempt_of: Callable[[Column, Column], Column], key: str) -> Column:
    """An array of mentions to an array of surrogates. Step by step, so that each step is evaluated once a mention."""
    kinds = F.transform(mentions, lambda m: F.struct(m.alias("m"), kind_of(m).alias("kind")))
    norms = F.transform(kinds, lambda x: F.struct(x["m"].alias("m"), x["kind"].alias("kind"), normal(x["kind"], x["m"]).alias("norm")))
    drawn = F.transform(norms, lambda x: F.struct(x["m"].alias("m"), x["kind"].alias("kind"), x["norm"].alias("norm"), attempt_of(x["kind"], x["norm"]).alias("attempt")))
    hashed = F.transform(drawn, lambda x: F.struct(x["m"].alias("m"), x["kind"].alias("kind"), x["attempt"].alias("attempt"), F.sha2(F.concat_ws("\x1f", F.lit(key), x["kind"], x["norm"], x["attempt"].cast("string")), 256).alias("h")))
    return F.transform(hashed, lambda x: surrogate(x["kind"], x["m"], x["h"], x["attempt"], key))


def surrogate(kind: Column, m: Column, h: Column, attempt: Column, key: str) -> Column:
    """The replacement of one mention; h: the keyed hash of its entity and attempt."""
    at = F.instr(m, "@")
    host = F.sha2(F.concat_ws("\x1f", F.lit(key), F.lit("host"), F.lower(F.substr(m, at + 1))), 256)
    email = F.concat(_alike(F.substr(m, F.lit(1), at - 1), h), F.lit("@h"), F.substr(host, F.lit(1), F.lit(12)), F.lit(".example.org"))
    octet = lambda i: F.conv(F.substr(h, F.lit(2 * i + 1), F.lit(2)), 16, 10)
    country = F.length(F.regexp_extract(m, r"^\+(\d{1,3})[ .\-(]", 1))
    upper = m.rlike("^[0-9A-F]+$")
    hex_ = F.substr(F.repeat(h, F.lit(8)), F.lit(1), F.length(m))
    secret = F.when(m.rlike("^[0-9a-fA-F]+$") & (F.length(m) <= 512), F.when(upper, F.upper(hex_)).otherwise(hex_)).otherwise(_alike(m, h, F.lit(4)))
    return (
        F.when(kind == "email", email)
        .when(kind == "secret", secret)
        .when(kind == "iban", _account(_alike(m, h, F.lit(4))))
        .when(kind == "ip", F.concat_ws(".", *map(octet, range(4))))
        .when(kind == "phone", _digits(m, h, country))
        .when(kind == "ssn", _digits(m, h, F.lit(0)))
        .when(kind == "card", _checked(_digits(m, h, F.lit(1))))
        .otherwise(_name(m, h, attempt))
    )


def _redrawn(entities: DataFrame, key: str) -> DataFrame | None:
    """(kind, norm, attempt) of the entities that keep another attempt than the first. entities: (kind, norm, mention)."""
    real = entities.select("kind", F.col("norm").alias("made"))
    draw = lambda df: df.withColumn("made", normal(F.col("kind"), F.get(surrogates(F.array("mention"), lambda kind, norm: F.col("attempt"), key), F.lit(0))))
    now = stage_table(draw(entities.withColumn("attempt", F.lit(0))), "pii-drawn")
    settled = None
    for attempt in range(MAX_ATTEMPTS):
        first = now.groupBy("kind", "made").agg(F.min(F.struct("attempt", "norm")).alias("first"))
        taken = now.join(first, ["kind", "made"]).withColumn("lost", F.col("first.norm") != F.col("norm"))
        hits = taken.join(real.withColumn("is_real", F.lit(True)), ["kind", "made"], "left")
        lost = hits.filter(F.col("lost") | F.coalesce("is_real", F.lit(False))).select("kind", "norm", "mention")
        lost = stage_table(lost.withColumn("attempt", F.lit(attempt + 1)), "pii-lost")
        if lost.isEmpty():
            break
        kept = now.join(lost, ["kind", "norm"], "left_anti")
        now = stage_table(kept.unionByName(draw(lost)), "pii-drawn")
        settled = now
    else:
        raise RuntimeError(f"surrogates still collide after {MAX_ATTEMPTS} draws")
    return None if settled is None else settled.filter("attempt > 0").select("kind", "norm", "attempt")


def replace(docs: DataFrame, secret: str, key: str = "doc_id", text: str = "text", max_redrawn: int = MAX_REDRAWN) -> DataFrame:
    """(key, text, n_entities): texts with every entity replaced by its surrogate, drawn by the key ``secret``."""
    rows = docs.select(F.col(f"`{key}`").alias(key), F.col(f"`{text}`").alias("text"))
    found = found_in(F.col("text"))
    mentions = rows.select(F.explode(found).alias("mention"))
    mentions = mentions.groupBy("mention").count().withColumn("kind", kind_of(F.col("mention"))).withColumn("norm", normal(F.col("kind"), F.col("mention")))
    entities = mentions.groupBy("kind", "norm").agg(F.min("mention").alias("mention"))
    entities = entities.repartition(shuffle_partitions(docs.sparkSession), "norm")  # small, but each takes long to draw for
    entities = stage_table(entities, "pii-entities")
    again = _redrawn(entities, secret)
    name = lambda k, n: F.concat_ws("\x1f", k, n)
    if again is None:
        pass
    elif again.count() <= max_redrawn:
        pairs = again.select(F.struct(name(F.col("kind"), F.col("norm")), F.col("attempt").cast("string")).alias("x"))
        rows = rows.withColumn("attempts", pairs.agg(F.map_from_entries(F.collect_list("x"))).scalar())
    else:
        named = rows.withColumn("tie", row_hash(rows))
        of = named.select(key, "tie", F.explode(found).alias("mention")).withColumn("kind", kind_of(F.col("mention")))
        of = of.withColumn("norm", normal(F.col("kind"), F.col("mention"))).join(again, ["kind", "norm"])
        maps = of.groupBy(key, "tie").agg(F.map_from_entries(F.collect_set(F.struct(name(F.col("kind"), F.col("norm")), F.col("attempt").cast("string")))).alias("attempts"))
        maps = maps.select(F.col(key).alias("of_key"), F.col("tie").alias("of_tie"), "attempts")
        rows = named.join(maps, F.col(key).eqNullSafe(F.col("of_key")) & (F.col("tie") == F.col("of_tie")), "left").select(key, "text", "attempts")

    def attempt(kind: Column, norm: Column) -> Column:
        return F.lit(0) if again is None else F.coalesce(F.try_element_at(F.col("attempts"), name(kind, norm)).cast("int"), F.lit(0))

    parts = F.split(F.col("text"), PATTERN, -1)
    made = surrogates(F.col("found"), attempt, secret)
    woven = F.array_join(F.flatten(F.zip_with("parts", F.concat(made, F.array(F.lit(""))), lambda a, b: F.array(a, b))), "")
    got = rows.withColumn("found", found).withColumn("n_entities", F.coalesce(F.size("found"), F.lit(0)).cast("long"))
    got = got.withColumn("parts", F.when(F.col("n_entities") > 0, parts))
    return got.select(key, F.when(F.col("n_entities") > 0, woven).otherwise(F.col("text")).alias("text"), F.greatest("n_entities", F.lit(0)).cast("long").alias("n_entities"))
