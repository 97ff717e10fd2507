"""Surrogates for personal data, in DataFrame functions only.

Entities are e-mail addresses, IPv4 addresses, phone, card and social-security numbers, IBANs, long hexadecimal
secrets, and names of up to four words after a form of address, which may have hyphens, apostrophes and initials; the
words of such a name but for initials are found again anywhere in its text, as they stand or in capitals, unless a pronoun
stands before them. Each gets a replacement drawn from a keyed digest (HMAC) of its kind and its canonical form (case, spacing and punctuation aside), so
the same entity has the same surrogate in every document and in every spelling, and the spelling's own format is kept:
punctuation, grouping, capitals, length; the country code of a phone; the first digit of a card, whose check digit is
right; the country, the letters and digits by place and right check digits of an IBAN; the form of address of a name.
Given names and surnames are drawn word by word, so "Mrs. Jane Doe", "Jane Doe" and "Mrs. Doe" stay one person; given
names have the gender of the form of address, where it has one, and all names the script. Surrogates of addresses are from the reserved
range 240.0.0.0/4 and those of phones have an exchange that begins with 0 or 1, so neither is in use anywhere.

Distinct entities must get distinct surrogates, and none that is itself an entity of the corpus. `collisions` counts
surrogates over the table of all distinct entities; those that clash, all but the lowest, and those that equal a real
entity draw again under the next attempt, until none is left; names get longer with each attempt. A kind of which there
are too many entities for its surrogates ends with an error after `ATTEMPTS`. Only entities past their first attempt are
joined back to their texts; the others' surrogates follow from their text, so texts are not shuffled.

Defined cases: a null text stays null and has no entities, an empty one stays empty; a null doc_id is kept; repeated
rows are treated alike; a word that is a given name and a surname in one text counts as what it is first; an empty table
gives an empty result; `protect` keeps other columns, whatever their names, but for `n_entities`, which it replaces.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscan.session import bounded, materialize, table

#: The setting that holds the key, and the key of tests and benchmarks.
KEY_SETTING, KEY = "spark.folioscan.surrogates.key", "public test key"
ATTEMPTS = 64
BROADCAST_BYTES = 32 << 20

# Forms of address by gender and without one, given names by gender and script, syllables by script. In
# capitals the shortest ones need a full stop, as they stand for other things too.
WOMEN = r"Mrs|MRS|Ms|MS(?=\.)|Miss|MISS|Frau|FRAU|Señora|SEÑORA|Madame|MADAME|Mme|Госпожа|ГОСПОЖА|Κυρία|ΚΥΡΙΑ"
MEN = r"Mr|MR(?=\.)|Herr|HERR|Señor|SEÑOR|Monsieur|MONSIEUR|Господин|ГОСПОДИН|Κύριος|ΚΥΡΙΟΣ"
OTHER = r"Dr|DR(?=\.)|Prof|PROF(?=\.)"
TITLES = f"{WOMEN}|{MEN}|{OTHER}"
GIVEN = {
    ("woman", "latin"): "Ada Berta Clara Dora Elena Frida Greta Hanna Irma Julia Klara Lena Marta Nora Olga Paula".split(),
    ("man", "latin"): "Adam Bruno Carl David Emil Felix Georg Hugo Ivan Jonas Karl Lukas Martin Nico Oskar Paul".split(),
    ("woman", "cyrillic"): "Анна Вера Галина Дарья Елена Зоя Ирина Лидия".split(),
    ("man", "cyrillic"): "Антон Борис Виктор Глеб Денис Егор Иван Лев".split(),
    ("woman", "greek"): "Άννα Δήμητρα Ελένη Ζωή Ηρώ Ιωάννα Μαρία Σοφία".split(),
    ("man", "greek"): "Άγγελος Βασίλης Γιώργος Δημήτρης Ηλίας Κώστας Νίκος Πέτρος".split(),
}
GIVEN |= {("given", script): GIVEN["woman", script] + GIVEN["man", script] for script in ("latin", "cyrillic", "greek")}
SYLLABLES = {
    "latin": "ba be bi bo bu da de di do du ga ge go ka ke ki ko la le li lo lu ma me mi mo mu na ne ni no ra re ri ro sa se si so ta te ti to va ve vi".split(),
    "cyrillic": "ба бо ва ви го да де ди жа за ка ко ла ле ли ло ма ми мо на но па по ра ри ро са со та ти".split(),
    "greek": "βα γε δα δι ζα θα κα κο λα λε λι μα με μι να νι πα πε ρα ρο σα σι τα τι".split(),
}

EMAIL = r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@[A-Za-z0-9](?:[A-Za-z0-9-]*+\.){1,127}[A-Za-z]{2,}"
OCTET = r"(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
IP = rf"(?<![0-9.])(?:{OCTET}\.){{3}}{OCTET}(?![0-9]|\.[0-9])"
CARD = r"(?<![0-9])[0-9]{4}([ -]?)[0-9]{4}\1[0-9]{4}\1[0-9]{4}(?![0-9])"
SSN = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
PHONE = r"(?<![0-9+])(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{3}\)[ .-]?|[0-9]{3}[.-])[0-9]{3}[ .-][0-9]{4}(?![0-9])|(?<![0-9+])\+[0-9]{1,3}(?:[ .-][0-9]{2,4}){2,4}(?![0-9])"
IBAN = r"(?<![\p{L}\p{N}])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![\p{L}\p{N}])"
SECRET = r"(?<![\p{L}\p{N}])(?=[0-9]*[a-fA-F])[0-9a-fA-F]{32,64}(?![\p{L}\p{N}])"
#: A word of a name: letters, with hyphens and apostrophes between them, or an initial.
NAME = r"(?:\p{Lu}\p{L}+(?:['’-]\p{L}+){0,3}|\p{Lu}['’]\p{L}+(?:-\p{L}+){0,2}|\p{Lu}\.)"
PERSON = rf"(?<![\p{{L}}\p{{N}}])(?:{TITLES})\.? {NAME}(?: {NAME}){{0,3}}"
#: What a name does not follow: after these a word like one is a verb.
BEFORE = r"(?<!(?<![\p{L}\p{N}])(?:I|[Yy]ou|[Ww]e|[Tt]hey|[Hh]e|[Ss]he|[Ii]t|[Ww]ho) )"
ENTITY = f"{EMAIL}|{IP}|{CARD}|{SSN}|{PHONE}|{IBAN}|{SECRET}|{PERSON}"
#: What any entity has somewhere, IPs of single digits and secrets included: most texts without one are passed over at the cost of this search.
HINT = rf"[0-9]{{2}}|@|[0-9]\.[0-9]|[0-9a-fA-F]{{32}}|(?:{TITLES})\.? \p{{Lu}}"


def _sql(pattern: str) -> str:
    return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _words(values: list[str]) -> str:
    return "array(" + ", ".join(f"'{v}'" for v in values) + ")"


TITLE = rf"^(?:{TITLES})\.? "


def _role(e: str) -> str:
    """What word i of a person is: the last one a surname, those before it given names of the gender of the form of address."""
    last = f"size(split(regexp_replace({e}, {_sql(TITLE)}, ''), ' ')) - 1"
    return f"CASE WHEN i = {last} THEN 'surname' WHEN {e} RLIKE {_sql(f'^(?:{WOMEN})')} THEN 'woman' WHEN {e} RLIKE {_sql(f'^(?:{MEN})')} THEN 'man' ELSE 'given' END"


KIND = f"""CASE WHEN contains(e, '@') THEN 'email' WHEN e RLIKE {_sql(f"^{IP}$")} THEN 'ip' WHEN e RLIKE {_sql(f"^{CARD}$")} THEN 'card'
  WHEN e RLIKE {_sql(f"^{SSN}$")} THEN 'ssn' WHEN e RLIKE {_sql(f"^{SECRET}$")} THEN 'secret' WHEN e RLIKE {_sql(f"^{IBAN}$")} THEN 'iban'
  WHEN e RLIKE {_sql(TITLE)} THEN 'person' WHEN e RLIKE {_sql(r"^\p{L}[\p{L}'’-]*$")} THEN 'name' ELSE 'phone' END"""
CANON = r"""CASE WHEN e.kind IN ('card', 'ssn', 'phone') THEN regexp_replace(e.e, '[^0-9]', '') WHEN e.kind = 'iban' THEN replace(e.e, ' ', '') ELSE lower(e.e) END"""
#: The words of the names in a text's entities, with what each is.
ROLES = f"""flatten(transform(filter(found, e -> e RLIKE {_sql(TITLE)}), e -> transform(split(regexp_replace(e, {_sql(TITLE)}, ''), ' '),
  (w, i) -> named_struct('word', w, 'kind', {_role('e')}))))"""
#: Of each entity what stands before its units, as it stands, and the units: as it stands, kind, canonical form.
UNITS = f"""transform(transform(found, e -> named_struct('e', e, 'kind', {KIND})), e -> named_struct(
  'before', CASE WHEN e.kind = 'person' THEN regexp_extract(e.e, {_sql(TITLE)}, 0) ELSE '' END,
  'units', CASE WHEN e.kind = 'person' THEN transform(split(regexp_replace(e.e, {_sql(TITLE)}, ''), ' '), (w, i) -> named_struct('e', w, 'kind', {_role('e.e')}, 'canon', lower(w)))
    WHEN e.kind = 'name' THEN array(named_struct('e', e.e, 'kind', filter(roles, r -> lower(r.word) = lower(e.e))[0].kind, 'canon', lower(e.e)))
    ELSE array(named_struct('e', e.e, 'kind', e.kind, 'canon', {CANON})) END))"""
SCRIPT = r"CASE WHEN x.canon RLIKE '\\p{IsCyrillic}' THEN 'cyrillic' WHEN x.canon RLIKE '\\p{IsGreek}' THEN 'greek' ELSE 'latin' END"


def _at(i: str) -> str:
    """The number from 0 to 255 at place i (from 1 to 64) of the digest."""
    return f"CAST(conv(substring(x.d, 2 * ({i}) - 1, 2), 16, 10) AS int)"


def _digits(first: str, last: str) -> str:
    return f"array_join(transform(sequence({first}, {last}), i -> CAST({_at('i')} % 10 AS string)), '')"


def _syllables(script: str, first: int, last: str) -> str:
    """Syllables by two places of the digest each, from place `first` on."""
    n = len(SYLLABLES[script])
    return f"array_join(transform(sequence(1, {last}), i -> {_words(SYLLABLES[script])}[(256 * {_at(f'{first} + 2 * i')} + {_at(f'{first + 1} + 2 * i')}) % {n}]), '')"


def _name(script: str) -> str:
    """A surname of four syllables of the script, or a given name of the gender; each further attempt adds a syllable."""
    given = [f"{_words(GIVEN[g, script])}[{_at('1')} % {len(GIVEN[g, script])}]" for g in ("woman", "man", "given")]
    more = f"CASE WHEN x.attempt = 0 THEN '' ELSE {_syllables(script, 1, 'least(x.attempt, 8)')} END"
    return f"CASE x.kind WHEN 'surname' THEN {_syllables(script, 1, 'least(x.attempt, 8) + 4')} WHEN 'woman' THEN concat(lower({given[0]}), {more}) WHEN 'man' THEN concat(lower({given[1]}), {more}) ELSE concat(lower({given[2]}), {more}) END"


CARD_BODY = f"concat(substring(x.canon, 1, 1), {_digits('1', '14')})"
LUHN = f"CAST((10 - aggregate(transform(split({CARD_BODY}, ''), (c, i) -> CASE WHEN i % 2 = 1 THEN CAST(c AS int) WHEN c > '4' THEN 2 * CAST(c AS int) - 9 ELSE 2 * CAST(c AS int) END), 0, (s, n) -> s + n) % 10) % 10 AS string)"
ACCOUNT = f"array_join(transform(split(substring(x.canon, 5), ''), (c, i) -> CASE WHEN c RLIKE '[0-9]' THEN CAST({_at('i + 1')} % 10 AS string) ELSE chr(65 + {_at('i + 1')} % 26) END), '')"
CHECK = f"lpad(CAST(98 - aggregate(split(concat({ACCOUNT}, substring(x.canon, 1, 2), '00'), ''), 0, (s, c) -> CASE WHEN c RLIKE '[0-9]' THEN (10 * s + CAST(c AS int)) % 97 ELSE (100 * s + ascii(c) - 55) % 97 END) AS string), 2, '0')"
LAST_TEN = f"concat({_digits('1', '3')}, CAST({_at('4')} % 2 AS string), {_digits('5', '10')})"
#: The canonical form of the surrogate of x (kind, canon, attempt, and the digest d).
CORE = f"""CASE x.kind
  WHEN 'email' THEN concat('user.', substring(x.d, 1, 12), '@example.net')
  WHEN 'ip' THEN concat_ws('.', CAST(240 + {_at('1')} % 15 AS string), CAST({_at('2')} AS string), CAST({_at('3')} AS string), CAST({_at('4')} AS string))
  WHEN 'card' THEN concat({CARD_BODY}, {LUHN})
  WHEN 'ssn' THEN concat('9', {_digits('1', '8')})
  WHEN 'phone' THEN CASE WHEN length(x.canon) < 10 THEN {_digits('1', 'length(x.canon)')} ELSE concat(substring(x.canon, 1, length(x.canon) - 10), {LAST_TEN}) END
  WHEN 'secret' THEN substring(x.d, 1, length(x.canon))
  WHEN 'iban' THEN concat(substring(x.canon, 1, 2), {CHECK}, {ACCOUNT})
  ELSE CASE {SCRIPT} WHEN 'cyrillic' THEN {_name('cyrillic')} WHEN 'greek' THEN {_name('greek')} ELSE {_name('latin')} END END"""
#: The surrogate in the format of the entity as it stands.
AS_IT_STANDS = r"""CASE WHEN x.kind IN ('card', 'ssn', 'phone', 'iban') THEN
    aggregate(split(x.e, ''), named_struct('out', '', 'k', 1), (a, c) -> CASE WHEN c RLIKE '[\\p{L}\\p{N}]' THEN named_struct('out', concat(a.out, substring(x.core, a.k, 1)), 'k', a.k + 1) ELSE named_struct('out', concat(a.out, c), 'k', a.k) END, a -> a.out)
  WHEN x.kind IN ('woman', 'man', 'given', 'surname') THEN CASE WHEN x.e = upper(x.e) AND length(x.e) > 2 THEN upper(x.core) ELSE initcap(x.core) END
  WHEN x.e = upper(x.e) THEN upper(x.core) ELSE x.core END"""


def _digest(key: str, kind: str, attempt: str, canon: str) -> str:
    """128 hexadecimal digits: HMAC-SHA-256 of kind, attempt and canonical form, and a further digest of it. The key goes in as two binary literals."""
    own = key.encode()
    own = (hashlib.sha256(own).digest() if len(own) > 64 else own).ljust(64, b"\0")
    inner, outer = (bytes(c ^ x for c in own).hex() for x in (0x36, 0x5C))
    mac = f"sha2(concat(X'{outer}', unhex(sha2(concat(X'{inner}', encode(concat_ws('|', {kind}, CAST({attempt} AS string), {canon}), 'UTF-8')), 256))), 256)"
    return f"aggregate(array(1), {mac}, (d, i) -> d, d -> concat(d, sha2(d, 256)))"


def _with_entities(rows: DataFrame) -> DataFrame:
    """rows, which have `text`, with `pattern`, `roles` and `found`, the entities of each text in order."""
    text, none = F.col("text"), F.array().cast("array<string>")
    titled = rows.withColumn("found", F.when(text.rlike(HINT), F.regexp_extract_all(text, F.lit(ENTITY), F.lit(0))).otherwise(none))
    roles = titled.withColumn("roles", F.expr(ROLES))
    whole = F.filter("roles", lambda r: ~r["word"].endswith("."))  # initials are not looked for elsewhere
    words = F.array_join(F.array_distinct(F.flatten(F.transform(whole, lambda r: F.array(r["word"], F.upper(r["word"]))))), "|")
    pattern = F.concat(F.lit(ENTITY + r"|(?<![\p{L}\p{N}])" + BEFORE + "(?:"), words, F.lit(r")(?![\p{L}\p{N}])"))
    named = F.size(whole) > 0
    again = roles.withColumn("pattern", F.when(named, pattern).otherwise(F.lit(ENTITY)))
    return again.withColumn("found", F.when(named, F.regexp_extract_all("text", F.col("pattern"), F.lit(0))).otherwise(F.col("found")))


def _units(rows: DataFrame) -> DataFrame:
    units = _with_entities(rows).withColumn("units", F.flatten(F.expr(f"transform({UNITS}, e -> e.units)")))
    # filtered afterwards: a filter on `found` or `units` would be pushed below them and find everything twice
    return units.select(*rows.columns, F.explode_outer("units").alias("x")).where("x IS NOT NULL")


def entities(docs: DataFrame, text: str = "text") -> DataFrame:
    """(kind, canon, n) for each distinct entity of docs; names word by word."""
    return _units(docs.select(F.col(f"`{text}`").alias("text"))).groupBy("x.kind", "x.canon").agg(F.count("*").alias("n"))


def collisions(known: DataFrame, key: str = KEY) -> DataFrame | None:
    """(kind, canon, attempt) for the entities whose surrogates aren't those of their first attempt; None if there are none."""
    real = known.select("kind", "canon")
    drawn = materialize(_drawn(real.withColumn("attempt", F.lit(0)), key), "surrogates")
    for _ in range(ATTEMPTS):
        taken = drawn.groupBy("kind", "core").agg(F.min("canon").alias("owner"), F.count("*").alias("n")).where("n > 1").drop("n")
        twice = drawn.join(taken, ["kind", "core"]).where("canon <> owner").select("kind", "canon")
        held = drawn.join(real.withColumnRenamed("canon", "core"), ["kind", "core"], "left_semi").select("kind", "canon")
        again = materialize(twice.unionByName(held).distinct(), "clashes")
        if again.isEmpty():
            late = drawn.where("attempt > 0").select("kind", "canon", "attempt")
            return None if late.isEmpty() else late
        marked = drawn.join(again.withColumn("_again", F.lit(1)), ["kind", "canon"], "left")
        drawn = materialize(_drawn(marked.select("kind", "canon", (F.col("attempt") + F.coalesce("_again", F.lit(0))).alias("attempt")), key), "surrogates")
    raise ValueError("too many entities of one kind for distinct surrogates")


def _drawn(known: DataFrame, key: str) -> DataFrame:
    """known (kind, canon, attempt) with `core`, the canonical form of the surrogate."""
    x = F.struct("kind", "canon", "attempt", F.expr(_digest(key, "kind", "attempt", "canon")).alias("d"))
    return known.withColumn("x", x).withColumn("core", F.expr(CORE)).drop("x")


def protect(docs: DataFrame, key: str = KEY, text: str = "text") -> DataFrame:
    """docs with surrogates in `text`, and n_entities, the number of entities replaced."""
    known = materialize(entities(docs, text), "entities")
    late = collisions(known, key)
    columns = [c for c in docs.columns if c != "n_entities"]
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row")).withColumn("text", F.col("row").getField(text))
    found, attempt = _with_entities(rows), "0"
    if late is not None:
        own = _units(rows.select("text").withColumn("digest", F.xxhash64("text"))).select("digest", "x.kind", "x.canon").distinct()
        late = bounded(late, late.count() * 64, BROADCAST_BYTES)
        marked = own.join(late, ["kind", "canon"]).groupBy("digest").agg(F.map_from_entries(F.collect_list(F.struct(F.concat_ws("|", "kind", "canon"), "attempt"))).alias("late"))
        marked = materialize(marked, "late")
        found = found.withColumn("digest", F.xxhash64("text")).join(bounded(marked, marked.count() * 128, BROADCAST_BYTES), "digest", "left")
        attempt = "coalesce(try_element_at(late, concat_ws('|', x.kind, x.canon)), 0)"
    numbered = f"transform(e.units, x -> named_struct('e', x.e, 'kind', x.kind, 'canon', x.canon, 'attempt', {attempt}))"
    digested = f"transform({numbered}, x -> named_struct('e', x.e, 'kind', x.kind, 'canon', x.canon, 'attempt', x.attempt, 'd', {_digest(key, 'x.kind', 'x.attempt', 'x.canon')}))"
    cored = f"transform({digested}, x -> named_struct('e', x.e, 'kind', x.kind, 'core', {CORE}))"
    replaced = F.expr(f"transform({UNITS}, e -> concat(e.before, array_join(transform({cored}, x -> {AS_IT_STANDS}), ' ')))")
    some = F.size("found") > 0
    spliced = found.withColumn("new", F.when(some, replaced)).withColumn("gaps", F.when(some, F.split("text", F.col("pattern"), -1)))
    out: Column = F.when(F.col("new").isNull(), F.col("text")).otherwise(F.expr("concat(gaps[0], array_join(transform(new, (r, i) -> concat(r, gaps[i + 1])), ''))"))
    return spliced.select(F.struct(*[(out if c == text else F.col("row").getField(c)).alias(c) for c in columns], F.size("found").alias("n_entities")).alias("row")).select("row.*")


def op6_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return protect(table(spark, sf_dir, "documents").select("doc_id", "text"), spark.conf.get(KEY_SETTING, KEY))
