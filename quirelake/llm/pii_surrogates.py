"""Personal data replaced by surrogates, in DataFrame functions only.

Detected: e-mail addresses, account numbers (IBAN), IPv4 addresses, social
security numbers, telephone and card numbers, and personal names: after a title,
a given name of the lists below before a surname, or two words of a name's shape
after a phrase that introduces one.  Initials, particles, hyphens and apostrophes
are parts of names.  A surname of three letters or more that was found in a text
is replaced wherever it stands alone in that text; ``n_entities`` doesn't count
these mentions.

An entity's canonical form (lower case, or digits only) and a secret key give its
surrogate, so that all mentions of an entity get the same one, in each mention's
own format: case, signs and spaces stay.  Characters keep their class and script
(vowel, consonant, digit; Latin, accented Latin, Greek, Cyrillic, Hebrew, Arabic,
Han, kana, Hangul; letters of other scripts become Latin ones); octets keep their
range, card numbers their first digit and a valid check digit, telephone numbers
their whole country code (or first digit), e-mail addresses share a surrogate
domain where they shared one.
Given names of the lists are exchanged within the list of their gender and
script by a keyed rotation.

Surrogates are checked over the whole corpus: one that equals a real entity or
another entity's surrogate is drawn anew until all are distinct.  After
``SAME_FORM`` turns the forms left are widened, so that a full space of short forms
doesn't end the search: octets take any value, other forms grow by a character
each turn.

Null texts stay null; rows without entities pass unchanged; repeated rows get the
same result each, rows that share an id only are texts of their own.  Whole texts
are read, however long; an empty table gives an empty result.  Other columns pass
unchanged, whatever their names, but an ``n_entities`` of the input is replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import written

KEY = "change-me"
#: Turns in which surrogates keep their form.
SAME_FORM = 4

#: Given names by gender and script, titles by gender.
GIVEN = {
    ("female", "latin"): ("Anna", "Maria", "Emma", "Laura", "Julia", "Sophie", "Claire", "Elena", "Carmen", "Ingrid", "Alice", "Nina", "Petra", "Lucia", "Monica", "Helen"),
    ("male", "latin"): ("John", "Peter", "Thomas", "Michael", "David", "Robert", "Paul", "Carlos", "Miguel", "Pierre", "Hans", "Walter", "Martin", "Simon", "Victor", "Daniel"),
    ("female", "cyrillic"): ("Анна", "Мария", "Елена", "Ольга", "Ирина", "Наталья", "Татьяна", "Светлана"),
    ("male", "cyrillic"): ("Иван", "Петр", "Сергей", "Дмитрий", "Андрей", "Михаил", "Николай", "Алексей"),
    ("female", "hebrew"): ("שרה", "רבקה", "רחל", "לאה", "מרים", "חנה"),
    ("male", "hebrew"): ("אברהם", "יצחק", "יעקב", "משה", "דוד", "שלמה"),
}
TITLES = {"male": ("Mr", "Herr", "Monsieur", "Señor", "Г-н"), "female": ("Mrs", "Ms", "Frau", "Madame", "Señora", "Г-жа"), "any": ("Dr", "Prof")}
#: Phrases that introduce a name, words inside names.
CUES = ("name is", "Name is", "name:", "Name:", "Signed,", "signed by", "Signed by", "Sincerely,", "regards,", "Regards,", "Attn:", "m'appelle", "me llamo", "Me llamo", "nombre es", "ich heiße", "Ich heiße", "Name ist", "меня зовут", "Меня зовут")
PARTICLES = ("van", "von", "der", "den", "de", "da", "del", "di", "bin", "al", "la", "le")

_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
_CAPITAL = r"[\p{Lu}\p{Lo}](?:['’]\p{Lu})?[\p{L}\p{M}]+(?:['’-]\p{Lu}[\p{L}\p{M}]+)*+"
_MIDDLE = rf"(?:\p{{Lu}}\. |(?:{'|'.join(PARTICLES)}) ){{0,3}}"
_ALL_TITLES, _ALL_GIVEN = (tuple(w for ws in table.values() for w in ws) for table in (TITLES, GIVEN))
_SOLO = "(?<![0-9A-Za-z])", "(?![0-9A-Za-z])"
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,}(?![A-Za-z0-9-])",
    "iban": _SOLO[0] + r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?" + _SOLO[1],
    "ip": rf"(?<![0-9.])(?:{_OCTET}\.){{3}}{_OCTET}(?![0-9]|\.[0-9])",
    "ssn": r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])",
    # Compact numbers, the national form of North America, any grouping of 7 to 15 digits, short groups, national numbers with a trunk zero.
    "phone": "(?<![0-9A-Za-z+])" + r"(?:\+[1-9][0-9]{9,14}|(?:\+1[ .-]?)?(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}|\+[0-9](?:[ .-]?\(?[0-9]\)?){6,14}|0[1-9](?: [0-9]{2}){4}|0[1-9][0-9]{1,3} [0-9]{5,8}|\+[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)[ .-]?)?[0-9]{2,4}(?:[ .-][0-9]{2,4}){1,4})" + _SOLO[1],
    "card": _SOLO[0] + r"[0-9]{4}(?:[0-9]{9,15}| [0-9]{6} [0-9]{5}|-[0-9]{6}-[0-9]{5}|([ -])[0-9]{4}\2[0-9]{4}\2[0-9]{1,7})" + _SOLO[1],
    "name": r"(?<!\p{L})(?=[\p{Lu}\p{Lo}])(?:"
    + rf"(?:{'|'.join(_ALL_TITLES)})\.? {_MIDDLE}{_CAPITAL}(?: {_MIDDLE}{_CAPITAL})?|(?:{'|'.join(_ALL_GIVEN)}) {_MIDDLE}{_CAPITAL}|(?<=(?:^|[^\p{{L}}])(?:{'|'.join(CUES)})[ \n]){_CAPITAL} {_MIDDLE}{_CAPITAL})",
}
#: One expression for all kinds; group 2 is the card number's separator.
PATTERN = "(" + "|".join(PATTERNS.values()) + ")"


#: Characters that a widened form gains at most.
EXTRA = 32


def _in(values) -> str:
    return "^(?:" + "|".join(values) + r")\.?$"


def _stream(key: str, kind: Column, canonical: Column, turn: Column) -> Column:
    """Keyed hexadecimal digits, two for each character."""
    blocks = F.sequence(F.lit(0), F.floor((F.length(canonical) + EXTRA) / 64).cast("int"))
    return F.array_join(F.transform(blocks, lambda b: F.sha2(F.concat_ws("|", F.lit(key), kind, canonical, turn.cast("string"), b.cast("string")), 512)), "")


def _draw(stream: Column, i: Column) -> Column:
    return F.conv(F.substring(stream, i * 2 + 1, F.lit(2)), 16, 10).cast("int")


#: Alphabets; a character is replaced by one of the same.
ALPHABETS = (
    "0123456789", "aeiou", "bcdfghjklmnpqrstvwxyz", "AEIOU", "BCDFGHJKLMNPQRSTVWXYZ", "аеиоуыэюя", "бвгджзйклмнпрстфхцчшщ", "אבגדהוזחטיכלמנסעפצקרשת",
    "áéíóúàèìòùâêîôûäëïöüåøæ", "çñšžčćřłńśźżğşđ", "ÁÉÍÓÚÀÈÌÒÙÂÊÎÔÛÄËÏÖÜÅØÆ", "ÇÑŠŽČĆŘŁŃŚŹŻĞŞĐ", "αεηιουωάέήίόύώ", "βγδζθκλμνξπρστφχψ", "ابتثجحخدذرزسشصضطظعغفقكلمنهوي",
)
#: Letters outside the alphabets, and what is drawn for them; the first that fits counts.
OTHERS = (
    (r"\p{IsLatin}", "áéíóúàèìòùâêîôûäëïöüåøæ"), (r"\p{IsGreek}", "βγδζθκλμνξπρστφχψ"), (r"\p{IsCyrillic}", "бвгджзйклмнпрстфхцчшщ"), (r"\p{IsHebrew}", "אבגדהוזחטיכלמנסעפצקרשת"), (r"\p{IsArabic}", "ابتثجحخدذرزسشصضطظعغفقكلمنهوي"),
    (r"\p{IsHan}", "王李张刘陈杨赵黄周吴徐孙胡朱高林何郭马罗梁宋郑谢韩唐冯于董萧程曹袁邓许傅沈曾彭吕苏卢蒋蔡贾丁魏薛叶"), (r"\p{IsHiragana}", "あいうえおかきくけこさしすせそたちつてとなにぬねのはひふへほまみむめもやゆよらりるれろわ"),
    (r"\p{IsKatakana}", "アイウエオカキクケコサシスセソタチツテトナニヌネノハヒフヘホマミムメモヤユヨラリルレロワ"), (r"\p{IsHangul}", "김이박최정강조윤장임한오서신권황안송전홍유고문양손배백허남심노하곽성차주우구민진지"), (r"\p{L}", "bcdfghjklmnpqrstvwxyz"),
)
#: Country codes of one, two or three digits.
CODE = r"^\+(?:[17]|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[0-9]{3})"


def _redrawn(text: Column, stream: Column) -> Column:
    """Each character replaced by a drawn one of the same alphabet."""

    def one(c: Column, i: Column) -> Column:
        drawn = lambda letters: F.substring(F.lit(letters), _draw(stream, i) % len(letters) + 1, F.lit(1))
        out = c
        for script, letters in reversed(OTHERS):
            out = F.when(c.rlike(f"^{script}$") & c.rlike(r"^\p{L}$"), drawn(letters)).otherwise(out)
        out = F.when(c.rlike("^[^\\x00-\\x7F]$"), out).otherwise(c)
        for letters in ALPHABETS:
            out = F.when(F.instr(F.lit(letters), c) > 0, drawn(letters)).otherwise(out)
        return out

    return F.array_join(F.transform(F.split(text, ""), one), "")


def _luhn(digits: Column) -> Column:
    """The sum that card numbers make divisible by ten."""
    n = F.length(digits)

    def value(c: Column, i: Column) -> Column:
        d = c.cast("int") * F.when((n - i) % 2 == 0, F.lit(2)).otherwise(F.lit(1))
        return F.when(d > 9, d - 9).otherwise(d)

    return F.aggregate(F.transform(F.split(digits, ""), value), F.lit(0), lambda a, x: a + x)


def _domain(address: Column) -> Column:
    return F.substring_index(address, "@", -1)


def _mod97(text: Column) -> Column:
    """The remainder by 97 of digits and letters (A is 10) read as one number."""
    def add(a: Column, c: Column) -> Column:
        return F.when(c.rlike("[0-9]"), (a * 10 + c.try_cast("int")) % 97).when(c.rlike("[A-Z]"), (a * 100 + F.ascii(c) - 55) % 97).otherwise(a)

    return F.aggregate(F.split(text, ""), F.lit(0), add)


def surrogate(key: str, kind: Column, canonical: Column, own: Column, domain: Column, extra: int = 0) -> Column:
    """The surrogate of a canonical form from its drawn digits: longer by ``extra``, and of its kind.

    ``domain`` is the surrogate of an address's domain.  Card and account numbers
    with a right check digit get a right one.
    """
    given, valid = canonical, _luhn(canonical) % 10 == 0
    turned = lambda s: F.concat(F.substring(s, F.lit(5), F.length(s)), F.substring(s, 1, 2))
    valid_iban = _mod97(F.concat(turned(canonical), F.substring(canonical, 3, 2))) == 1
    local = F.concat(F.substring_index(canonical, "@", 1), F.lit("k" * extra))
    own_host, top = F.concat(F.regexp_extract(canonical, r"^(.*)\.[^.]*$", 1), F.lit("k" * extra)), F.substring_index(canonical, ".", -1)
    if extra:
        # More of the last character's alphabet; quads don't grow.
        canonical = F.when(kind == "ip", canonical).otherwise(F.concat(canonical, F.repeat(F.substring(canonical, F.lit(-1), F.lit(1)), F.lit(extra))))
    redrawn = _redrawn(canonical, own)
    email = F.concat(_redrawn(local, own), F.lit("@"), domain)
    wide = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: _draw(own, i).cast("string"))
    octets = wide if extra else F.transform(F.split(canonical, r"\."), lambda o, i: F.when(F.length(o) == 1, _draw(own, i) % 10).when(F.length(o) == 2, _draw(own, i) % 90 + 10).otherwise(_draw(own, i) % 156 + 100).cast("string"))
    body = F.concat(F.substring(canonical, 1, 1), F.substring(redrawn, F.lit(2), F.length(canonical) - 2))
    check = F.pmod(10 - _luhn(F.concat(body, F.lit("0"))) % 10, F.lit(10)).cast("string")
    card = F.concat(body, F.when(valid, check).otherwise(F.substring(redrawn, F.length(canonical), F.lit(1))))
    # The country code (or the first digit) stays.
    code = F.greatest(F.length(F.regexp_extract(canonical, CODE, 0)), F.lit(1))
    phone = F.concat(F.substring(canonical, F.lit(1), code), F.substring(redrawn, code + 1, F.length(canonical)))
    body_iban = F.substring(redrawn, F.lit(5), F.length(canonical))
    digits = F.lpad((98 - _mod97(F.concat(body_iban, F.substring(canonical, 1, 2), F.lit("00")))).cast("string"), 2, "0")
    iban = F.concat(F.substring(canonical, 1, 2), F.when(valid_iban, digits).otherwise(F.substring(redrawn, 3, 2)), body_iban)
    out = F.when(kind == "email", email).when(kind == "ip", F.array_join(octets, ".")).when(kind == "card", card).when(kind == "phone", phone).when(kind == "iban", iban).when(kind == "domain", F.concat(_redrawn(own_host, own), F.lit("."), top))
    for (gender, script), names in GIVEN.items():
        turned = F.array(*map(F.lit, names))
        by = F.conv(F.substring(F.sha2(F.lit(f"{key}|{gender}|{script}"), 256), 1, 6), 16, 10).cast("int") % (len(names) - 1) + 1
        at = F.array_position(F.transform(turned, F.lower), given)
        out = out.when(kind == f"given-{gender}-{script}", F.lower(F.element_at(turned, ((at - 1 + by) % len(names) + 1).cast("int"))))
    return out.otherwise(redrawn)


def _kind(entity: Column) -> Column:
    out = F.when(entity.rlike("^" + PATTERNS["email"] + "$"), "email")
    for kind in ("iban", "ip", "ssn", "phone"):
        out = out.when(entity.rlike("^" + PATTERNS[kind] + "$"), kind)
    return out.when(entity.rlike("^[0-9 -]+$"), "card").otherwise("name")


def _parts(entity: Column, kind: Column) -> Column:
    """What of an entity is looked up: ``kind, canonical, form``; a name's words one by one."""
    # A leading plus tells that a country code follows.
    canonical = F.when(kind.isin("ssn", "phone", "card"), F.regexp_replace(entity, r"(?<!^)\+|[^0-9+]", "")).when(kind == "iban", F.replace(entity, F.lit(" "), F.lit(""))).otherwise(F.lower(entity))
    words = F.split(entity, " ")
    titled = words[0].rlike(_in(_ALL_TITLES))

    def word(w: Column, i: Column) -> Column:
        # Initials have few forms: they are drawn like given names, without a check that they are distinct.
        of = F.when((titled & (i == 0)) | w.isin(*PARTICLES), F.lit("keep")).when(w.rlike(r"^\p{Lu}\.$"), F.lit("given-initial"))
        for (gender, script), names in GIVEN.items():
            of = of.when(w.isin(*names) & (i < F.size(words) - 1), F.lit(f"given-{gender}-{script}"))
        return F.struct(of.otherwise("surname").alias("kind"), F.lower(w).alias("canonical"), w.alias("form"))

    return F.when(kind == "name", F.transform(words, word)).otherwise(F.array(F.struct(kind.alias("kind"), canonical.alias("canonical"), entity.alias("form"))))


def _formatted(form: Column, kind: Column, found: Column) -> Column:
    """A surrogate in a mention's own format: its signs and its case."""
    packed = kind.isin("ssn", "phone", "card", "iban")
    # Signs take no character of a packed form; the number of those before each place gives its own.
    chars = F.split(form, "")
    def at(c: Column, i: Column) -> Column:
        before = F.length(F.regexp_replace(F.substring(form, F.lit(1), i), "[^0-9A-Z]", ""))
        filled = F.substring(F.replace(found, F.lit("+"), F.lit("")), before + 1, F.lit(1))
        return F.when(~c.rlike("[0-9A-Z]"), c).otherwise(filled)
    plain = F.replace(found, F.lit("+"), F.lit(""))
    rest = F.substring(plain, F.length(F.regexp_replace(form, "[^0-9A-Z]", "")) + 1, F.length(plain))
    spaced = F.concat(F.array_join(F.transform(chars, at), ""), rest)
    # What a widened form gained takes the last character's case.
    cap = lambda i: F.substring(form, F.least(i + 1, F.length(form)), F.lit(1))
    cased = F.array_join(F.transform(F.split(found, ""), lambda c, i: F.when(cap(i) != F.lower(cap(i)), F.upper(c)).otherwise(c)), "")
    return F.when(packed, spaced).otherwise(cased)


def draw_surrogates(entities: DataFrame, key: str) -> DataFrame:
    """``kind, canonical, surrogate`` for distinct ``kind, canonical``: all distinct, none a real entity.

    Domains are entities of their own: they are drawn first, and an address takes
    its domain's surrogate.
    """
    emails = entities.where("kind = 'email'").select("canonical", _domain(F.col("canonical")).alias("own_domain"))
    domains = written(emails.select(F.lit("domain").alias("kind"), F.col("own_domain").alias("canonical")).distinct(), "domains")
    drawn = _drawn_distinct(domains.withColumn("domain", F.lit(None).cast("string")), key)
    of_domain = drawn.select(F.col("canonical").alias("own_domain"), F.col("surrogate").alias("domain"))
    with_domain = emails.join(of_domain.hint("merge"), "own_domain").select(F.lit("email").alias("kind"), "canonical", "domain")
    return _drawn_distinct(written(entities.where("kind != 'email'").select("kind", "canonical", F.lit(None).cast("string").alias("domain")).unionAll(with_domain), "with-domains"), key)


def _drawn_distinct(entities: DataFrame, key: str) -> DataFrame:
    real = entities.select(F.col("canonical").alias("surrogate"), F.lit(True).alias("real")).distinct()
    left, done, turn = entities, None, 0
    while True:
        # The drawn digits are written first: inside the lambdas they would be drawn anew for each character.
        streams = written(left.select("kind", "canonical", "domain", _stream(key, F.col("kind"), F.col("canonical"), F.lit(turn)).alias("own")), "streams")
        drawn = written(streams.select("kind", "canonical", "domain", surrogate(key, F.col("kind"), F.col("canonical"), F.col("own"), F.col("domain"), min(max(0, turn + 1 - SAME_FORM), EXTRA)).alias("surrogate")), "drawn")
        lists = F.col("kind").startswith("given-")
        first = drawn.where(~lists).groupBy("surrogate").agg(F.min(F.struct("kind", "canonical")).alias("first"))
        checked = drawn.join(first.hint("merge"), "surrogate", "left").join(real.hint("merge"), "surrogate", "left")
        if done is not None:
            checked = checked.join(done.select("surrogate", F.lit(True).alias("taken")).distinct().hint("merge"), "surrogate", "left")
        fine = lists | (F.col("real").isNull() & (F.col("first") == F.struct("kind", "canonical")))
        if done is not None:
            fine = lists | (fine & F.col("taken").isNull())
        checked = written(checked.select("kind", "canonical", "domain", "surrogate", fine.alias("fine")), "checked")
        good = checked.where("fine").select("kind", "canonical", "surrogate")
        done = good if done is None else done.unionAll(good)
        left = checked.where("not fine").select("kind", "canonical", "domain")
        turn += 1
        if left.isEmpty():
            return done


def replace_entities(documents: DataFrame, *, key: str = KEY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``documents`` with surrogates in place of personal data, plus ``n_entities``."""
    rows = documents.drop("n_entities")
    text = F.col(text_col)
    # Most texts have neither a sign nor a digit, and a name needs a word of the lists: cheap tests come first.
    maybe = text.rlike("[@0-9]") | text.rlike(r"(?<!\p{L})(?:(?=[\p{Lu}א-ת])(?:" + "|".join((*_ALL_TITLES, *_ALL_GIVEN)) + ")|(?:" + "|".join(CUES) + r")[ \n])")
    some = F.coalesce(maybe & text.rlike(PATTERN), F.lit(False))
    plain = rows.where(~some).withColumn("n_entities", F.lit(0).cast("long"))
    # Equal texts of one id share a place: what is found there is the same.
    place = F.sha2(F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit("\n"), text), 256)
    held = rows.where(some).select(F.struct(*(F.col(f"`{c}`") for c in rows.columns)).alias("row"), place.alias("place"), F.regexp_extract_all(text, F.lit(PATTERN), F.lit(1)).alias("found"))
    mentions = held.select("place", F.explode(F.array_distinct("found")).alias("entity")).distinct()
    parts = mentions.select("place", "entity", F.posexplode(_parts(F.col("entity"), _kind(F.col("entity")))).alias("nth", "part")).select("place", "entity", "nth", "part.*")
    parts = written(parts, "mentions")
    looked = parts.where("kind != 'keep'").select("kind", "canonical").distinct()
    table = written(draw_surrogates(written(looked, "entities"), key), "surrogates")
    formatted = _formatted(F.col("form"), F.col("kind"), F.col("surrogate"))
    # Surnames that may stand alone in the same text.
    alone = (F.col("kind") == "surname") & (F.length("form") > 2)
    named = parts.join(table.hint("merge"), ["kind", "canonical"], "left").select("place", "entity", "nth", F.coalesce(formatted, "form").alias("new"), F.when(alone, F.col("form")).alias("old"))
    whole = named.groupBy("place", "entity").agg(F.array_sort(F.collect_list(F.struct("nth", "new", "old"))).alias("parts"))
    new = F.array_join(F.transform("parts", lambda x: x["new"]), " ")
    maps = whole.groupBy("place").agg(F.map_from_entries(F.collect_list(F.struct(F.col("entity"), new.alias("new")))).alias("forms"), F.array_distinct(F.flatten(F.collect_list(F.transform(F.filter("parts", lambda x: x["old"].isNotNull()), lambda x: F.struct(x["old"].alias("old"), x["new"].alias("new")))))).alias("surnames"))
    joined = held.join(written(maps, "forms").hint("merge"), "place")
    whole_text = F.col("row").getField(text_col)
    swapped = lambda gap: F.aggregate("surnames", gap, lambda t, x: F.regexp_replace(t, F.concat(F.lit(r"(?<!\p{L})"), x["old"], F.lit(r"(?!\p{L})")), x["new"]))
    gaps = F.transform(F.split(whole_text, PATTERN, -1), swapped)
    filled = F.concat(F.transform("found", lambda e: F.element_at("forms", e)), F.array(F.lit("")))
    out = F.array_join(F.flatten(F.zip_with(gaps, filled, lambda a, b: F.array(a, b))), "")
    replaced = joined.select(*((out if c == text_col else F.col("row").getField(c)).alias(c) for c in rows.columns), F.size("found").cast("long").alias("n_entities"))
    return plain.unionAll(replaced)
