"""Personal data and secrets, replaced by keyed surrogates of the same type and format.

DataFrame functions only. A surrogate is a function of the key, the entity's type, its
canonical form and an attempt, so all mentions of an entity, however spelled, get the same
one. Entities of the whole table are then checked: where two surrogates of a type are equal,
or one equals an entity that occurs, all but one take the next attempt. Later attempts draw
from a wider format, so a free form always exists and the attempts come to an end.

Persons are found by shape and context: capitalised words behind a title, behind words that
introduce a name, in front of a mail address or a phone number, or behind a common given
name. A surname found so is also replaced where it stands alone in the same text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .workspace import fresh, materialize

# Given names by script and gender; a surrogate is the next name of its list in keyed order.
GIVEN = {
    ("latin", "f"): ["Alice", "Anna", "Barbara", "Carmen", "Charlotte", "Claire", "Elena", "Elizabeth", "Emily", "Emma", "Helga", "Isabel", "Jennifer", "Julia", "Laura", "Linda", "Lucía", "Maria", "María", "Marie", "Mary", "Patricia", "Sarah", "Sofia", "Sophie", "Susan", "Ursula"],
    ("latin", "m"): ["Antonio", "Carlos", "Charles", "Daniel", "David", "Friedrich", "Hans", "James", "Javier", "Jean", "John", "José", "Juan", "Klaus", "Louis", "Luis", "Michael", "Miguel", "Paul", "Peter", "Pierre", "Richard", "Robert", "Stefan", "Thomas", "William", "Wolfgang"],
    ("cyrillic", "f"): ["Анна", "Екатерина", "Елена", "Ирина", "Мария", "Наталья", "Ольга", "Светлана", "Татьяна", "Юлия"],
    ("cyrillic", "m"): ["Александр", "Алексей", "Андрей", "Владимир", "Дмитрий", "Иван", "Михаил", "Николай", "Сергей", "Юрий"],
}
FEMALE, MALE, OTHER = "Mrs|Ms|Miss|Mme|Mlle|Madame|Frau|Señora|Señorita|Sra|Doña|Госпожа", "Mr|Monsieur|Herr|Señor|Sr|Don|Господин", "Dr|Prof"
TITLES = f"{FEMALE}|{MALE}|{OTHER}"
# Words behind which a person is named.
CUES = r"my name is|i am called|written by|signed by|je m['’]appelle|mon nom est|signé par|ich heiße|mein name ist|gezeichnet von|me llamo|mi nombre es|firmado por|меня зовут|моё имя"
PARTICLES = "de|del|de la|de los|van|van der|von|da|di|bin|ibn|al|el|le|du"
SYLLABLES = {
    "latin": ["ba", "den", "fel", "gar", "hol", "jen", "kar", "lin", "mor", "nev", "pel", "ros", "sten", "tol", "ver", "wil"],
    "cyrillic": ["ба", "вен", "гор", "дел", "жар", "зол", "кар", "лит", "мор", "нев", "пол", "рос", "сим", "тал", "фед", "хол"],
    "greek": ["βα", "γορ", "δεν", "ζαν", "θεο", "καρ", "λιν", "μορ", "νεφ", "παλ", "ροδ", "σιμ", "ταλ", "φιλ", "χαρ", "ψηλ"],
}
_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
_WORD = r"\p{Lu}(?:['’]\p{Lu})?\p{Ll}+(?:\p{Lu}\p{Ll}+)?(?:-\p{Lu}\p{Ll}+)?"
_NEXT = rf" (?:(?:{PARTICLES}) )?(?!(?:{TITLES})\b){_WORD}"
_FULL = rf"(?!(?:{TITLES})\b){_WORD}(?:{_NEXT}){{1,2}}"
LONE = rf"(?<![\p{{L}}\d]){_WORD}(?![\p{{L}}\d])"
_ALL_GIVEN = "|".join(n for names in GIVEN.values() for n in names)
_VALUE = r"[A-Za-z0-9+/_-]"
_SECRET = rf"""(?:token|secret|api[_-]?key|password|passwd|pwd)["']? ?[=:] ?["']?{_VALUE}{{8,}}"""
EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@(?:[A-Za-z0-9-]+\.){1,126}[A-Za-z]{2,}"  # a domain name has at most 127 labels
ACCESS_KEY = r"(?<![A-Za-z0-9])(?:AKIA|ASIA)[0-9A-Z]{16}(?![A-Za-z0-9])"
SECRET = rf"(?<![A-Za-z])(?i:{_SECRET})"
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"
_TITLED = rf"(?:{TITLES})\.? {_WORD}(?: (?!(?:{TITLES})\b){_WORD})?"
_NEAR_CONTACT = r",? ?[<(]?(?:[A-Za-z0-9._%+-]+@[A-Za-z0-9-]|\+\d{1,3}[ .(-])"
NAME = rf"(?<!\p{{L}})(?=\p{{Lu}})(?:{_TITLED}|(?:{_ALL_GIVEN}) {_WORD}|(?<=(?i:{CUES})[ \n]){_WORD}(?:{_NEXT}){{0,2}}|{_FULL}(?={_NEAR_CONTACT}))(?!\p{{L}})"
IPV4 = rf"(?<![\d.])(?:{_OCTET}\.){{3}}{_OCTET}(?!\.?\d)"
CARD = r"(?<![\d+-])(?:(?:\d{4}[ -]?){3}\d{4}|\d{13,19})(?![\d-])"
SSN = r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])"
PHONE = r"(?<![\w+])(?:\+\d{1,3}(?:[ .-]?(?:\(\d{1,4}\)|\d{2,4})){2,5}|\(\d{3}\) ?\d{3}[ .-]\d{4}|\d{3}[.-]\d{3}[.-]\d{4})(?!\d)"
# Country calling codes of one and of two digits; all others have three.
COUNTRY = r"^\+(1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|\d{3})"
PATTERN = "|".join(f"(?:{p})" for p in (EMAIL, ACCESS_KEY, SECRET, IBAN, NAME, IPV4, CARD, SSN, PHONE))
KEY_HEX = 256


def kind_of(e: Column) -> Column:
    """The type of a found string."""
    return (
        F.when(e.rlike(rf"^(?:{EMAIL})$"), "email")
        .when(e.rlike(rf"^(?:{ACCESS_KEY})$"), "access_key")
        .when(e.rlike(rf"^(?:{SECRET})$"), "secret")
        .when(e.rlike(rf"^(?:{IBAN})$"), "iban")
        .when(~e.rlike(r"[\d@]"), "name")  # all other types hold digits
        .when(e.rlike(rf"^(?:{IPV4})$"), "ipv4")
        .when(e.rlike(rf"^(?:{CARD})$"), "card")
        .when(e.rlike(rf"^(?:{SSN})$"), "ssn")
        .otherwise("phone")
    )


def _surname(e: Column) -> Column:
    return F.regexp_extract(e, rf"({_WORD})$", 1)


def _given(e: Column) -> Column:
    """The words of a person's name before the surname, without title and particles."""
    before = F.regexp_replace(F.regexp_replace(e, rf"^(?:{TITLES})\.? ", ""), rf" ?{_WORD}$", "")
    return F.filter(F.split(before, " "), lambda w: w.rlike(rf"^{_WORD}$"))


def canonical(e: Column, kind: Column) -> Column:
    """What all spellings of an entity share: digits of numbers with the plus sign of an
    international one, lower-case e-mail
    addresses, the value of a secret, the surname of a person."""
    return (
        F.when(kind == "email", F.lower(e))
        .when(kind == "secret", F.regexp_extract(e, rf"""({_VALUE}+)$""", 1))
        .when(kind == "name", _surname(e))
        .when(kind == "card", F.regexp_replace(e, r"\D", ""))
        .when(kind == "phone", F.regexp_replace(e, r"[^\d+]", ""))
        .when(kind == "iban", F.replace(e, F.lit(" "), F.lit("")))
        .otherwise(e)
    )


def _stream(key: str, *parts: Column) -> Column:
    """KEY_HEX hex digits drawn from the key and the parts."""
    seed = F.concat_ws("\x1f", F.lit(key), *[p.cast("string") for p in parts])
    return F.concat(*[F.sha2(F.concat(seed, F.lit(f"\x1f{i}")), 256) for i in range(KEY_HEX // 64)])


def _byte(h: Column, i: Column | int) -> Column:
    at = (i % (KEY_HEX // 2)) * 2 + 1 if isinstance(i, Column) else F.lit((i % (KEY_HEX // 2)) * 2 + 1)
    return F.conv(h.substr(at.cast("int"), F.lit(2)), 16, 10).cast("int")


def _pick(alphabet: str, n: Column) -> Column:
    return F.lit(alphabet).substr((n % len(alphabet) + 1).cast("int"), F.lit(1))


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is worked out once, however often it occurs there."""
    return F.element_at(F.transform(F.array(value), use), 1)


def same_classes(s: Column, h: Column, keep: int = 0) -> Column:
    """``s`` with digits and letters after the first ``keep`` drawn anew within their class;
    a long lower-case hexadecimal string stays one."""
    lower, upper, hexes = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789abcdef"

    def drawn(s: Column, h: Column, in_hex: Column) -> Column:
        def one(c: Column, i: Column) -> Column:
            b = _byte(h, i)
            return F.when(i < keep, c).when(in_hex, _pick(hexes, b)).when(c.rlike(r"^\d$"), _pick("0123456789", b)).when(c.rlike("^[a-z]$"), _pick(lower, b)).when(c.rlike("^[A-Z]$"), _pick(upper, b)).otherwise(c)

        return F.array_join(F.transform(F.split(s, ""), one), "")

    is_hex = lambda s: s.rlike(r"^[0-9a-f]{16,}$") & s.rlike("[a-f]")
    return _let(s, lambda s: _let(h, lambda h: _let(is_hex(s), lambda x: drawn(s, h, x))))


def luhn_digit(body: Column) -> Column:
    """The check digit that completes ``body`` under the Luhn rule."""

    def of(body: Column) -> Column:
        n = F.length(body)

        def value(c: Column, i: Column) -> Column:
            d = c.try_cast("int")
            return F.when((n - i) % 2 == 1, d * 2 - F.when(d > 4, 9).otherwise(0)).otherwise(d)

        return ((10 - F.aggregate(F.transform(F.split(body, ""), value), F.lit(0), lambda a, x: a + x) % 10) % 10).cast("string")

    return _let(body, of)


def _is_luhn(s: Column) -> Column:
    return luhn_digit(s.substr(F.lit(1), (F.length(s) - 1).cast("int"))) == F.right(s, F.lit(1))


def _mod97(s: Column) -> Column:
    """A number of up to 80 digits modulo 97."""
    return F.aggregate(F.split(s, ""), F.lit(0), lambda a, c: (a * 10 + c.try_cast("int")) % 97)


def _iban_digits(s: Column) -> Column:
    return F.array_join(F.transform(F.split(s, ""), lambda c: F.when(c.rlike("^[A-Z]$"), (F.ascii(c) - 55).cast("string")).otherwise(c)), "")


def _card(canon: Column, h: Column) -> Column:
    def checked(card: Column) -> Column:
        body = card.substr(F.lit(1), (F.length(card) - 1).cast("int"))
        return F.when(_is_luhn(canon), F.concat(body, luhn_digit(body))).otherwise(card)

    return _let(same_classes(canon, h, 1), checked)


def _iban(canon: Column, h: Column) -> Column:
    country = canon.substr(F.lit(1), F.lit(2))

    def checked(bban: Column) -> Column:
        check = 98 - _mod97(_iban_digits(F.concat(bban, country, F.lit("00"))))
        return F.concat(country, F.lpad(check.cast("string"), 2, "0"), bban)

    return _let(same_classes(canon.substr(F.lit(5), F.lit(40)), h), checked)


def _letters(h: Column, n: int, alphabet: str = "abcdefghijklmnopqrstuvwxyz") -> Column:
    """``n`` characters from the end of the drawn bytes."""
    return F.concat(F.lit(""), *[_pick(alphabet, _byte(h, KEY_HEX // 2 - 1 - i)) for i in range(n)])


def _email(canon: Column, h: Column, key: str, more: int) -> Column:
    local, domain = F.substring_index(canon, "@", 1), F.substring_index(canon, "@", -1)
    tld = F.substring_index(domain, ".", -1)
    stem = domain.substr(F.lit(1), (F.length(domain) - F.length(tld)).cast("int"))
    return F.concat(same_classes(local, h), _letters(h, more), F.lit("@"), same_classes(stem, _stream(key, F.lit("domain"), domain)), tld)


def _ipv4(canon: Column, h: Column, more: int) -> Column:
    """An address of the same private network, or else a public one; later any of 10.0.0.0/8,
    and last any at all."""
    inside = canon.rlike(r"^(?:10|127)\.|^192\.168\.|^172\.(?:1[6-9]|2\d|3[01])\.|^169\.254\.")
    drawn = lambda i: _byte(h, i * 2).cast("string")
    first = (_byte(h, 0) % 223 + 1).cast("string")
    head = F.when(inside, F.substring_index(canon, ".", 2) if not more else F.concat(F.lit("10."), drawn(1)) if more < 12 else F.concat_ws(".", first, drawn(1))).otherwise(F.concat_ws(".", first, drawn(1)))
    return F.concat_ws(".", head, drawn(2), drawn(3))


def _phone(canon: Column, h: Column, more: int) -> Column:
    """The country code of an international number stays, of others the first digit."""
    keep = F.greatest(F.lit(1), F.length(F.regexp_extract(canon, COUNTRY, 0))).cast("int")
    return F.concat(canon.substr(F.lit(1), keep), same_classes(canon.substr(keep + 1, F.lit(32)), h), _letters(h, more, "0123456789"))


def _syllables(script: str, h: Column, n: int = 4) -> Column:
    table = F.array(*[F.lit(x) for x in SYLLABLES[script]])
    numbers = F.transform(F.array(*[F.lit(i) for i in range(n)]), lambda i: F.element_at(table, (_byte(h, i) % len(SYLLABLES[script]) + 1).cast("int")))
    return F.initcap(F.array_join(numbers, ""))


def _in_script(canon: Column, h: Column, n: int) -> Column:
    return F.when(canon.rlike(r"^\p{IsCyrillic}"), _syllables("cyrillic", h, n)).when(canon.rlike(r"^\p{IsGreek}"), _syllables("greek", h, n)).otherwise(_syllables("latin", h, n))


def _person(canon: Column, h: Column, kind: Column, attempt: int, more: int, key: str) -> Column:
    """A surname of the same script; a Cyrillic one keeps its gendered ending, and both
    genders of one name share the rest."""
    tail = F.when(canon.rlike("(?:ова|ева|ина)$"), F.lit("ова")).when(canon.rlike("(?:ов|ев|ин)$"), F.lit("ов")).otherwise(F.lit(""))
    stem = F.regexp_replace(canon, "(ов|ев|ин)а$", "$1")
    russian = F.concat(_let(_stream(key, kind, stem, F.lit(attempt)), lambda h: _syllables("cyrillic", h, 4 + more)), tail)
    plain = _in_script(canon, h, 4 + more)
    double = F.concat(plain, F.lit("-"), _let(_stream(key, F.lit("second"), canon, F.lit(attempt)), lambda h: _syllables("latin", h)))
    return F.when(canon.rlike(r"^\p{IsCyrillic}"), russian).when(canon.contains("-"), double).otherwise(plain)


def _first_name(canon: Column, h: Column, more: int) -> Column:
    """A given name of no list: invented, of the same script, with an ending of its gender
    where the name shows one."""
    ending = F.when(canon.rlike("[aά]$"), "a").when(canon.rlike("[ая]$"), "а").otherwise("")
    return F.concat(_in_script(canon, h, 3 + more), ending)


PATIENCE = {"name": 2, "given": 2, "email": 2, "ipv4": 1, "phone": 2}


def _new_canonical(kind: Column, canon: Column, key: str, attempt: int) -> Column:
    """The surrogate's canonical form. After a few attempts names, addresses and phone numbers
    grow by a syllable, letter or digit with each attempt (private IPv4 addresses leave their
    network); types of at least 10^8 forms keep theirs until attempt 15."""
    more = {k: max(0, attempt - v) for k, v in PATIENCE.items()}
    late = max(0, attempt - 15)

    def by_kind(h: Column) -> Column:
        return (
            F.when(kind == "email", _email(canon, h, key, more["email"]))
            .when(kind == "ipv4", _ipv4(canon, h, more["ipv4"]))
            .when(kind == "card", F.concat(_card(canon, h), _letters(h, late, "0123456789")))
            .when(kind == "phone", _phone(canon, h, more["phone"]))
            .when(kind == "iban", F.concat(_iban(canon, h), _letters(h, late, "0123456789")))
            .when(kind == "access_key", F.concat(canon.substr(F.lit(1), F.lit(4)), same_classes(canon.substr(F.lit(5), F.lit(16)), h), _letters(h, late)))
            .when(kind == "name", _person(canon, h, kind, attempt, more["name"], key))
            .when(kind == "given", _first_name(canon, h, more["given"]))
            .otherwise(F.concat(same_classes(canon, h), _letters(h, late, "0123456789")))
        )

    return _let(_stream(key, kind, canon, F.lit(attempt)), by_kind)


def _new_given(name: Column, key: str) -> Column:
    """The next given name of the same gender and script in keyed order; never the same one."""
    moved = {}
    for names in GIVEN.values():
        order = sorted(names, key=lambda n: hashlib.sha256(f"{key}\x1f{n}".encode()).hexdigest())
        moved |= dict(zip(order, order[1:] + order[:1], strict=True))
    table = F.create_map(*[F.lit(x) for pair in moved.items() for x in pair])
    return table[name]


def _fill(surface: Column, new: Column, of: str) -> Column:
    """``surface`` with its characters of class ``of`` replaced in turn by those of ``new``;
    what is left of ``new`` follows."""
    chars = F.split(surface, "")
    step = F.aggregate(
        chars,
        F.struct(F.lit(0).alias("n"), F.lit("").alias("s")),
        lambda a, c: F.struct((a["n"] + c.rlike(of).cast("int")).alias("n"), F.concat(a["s"], F.when(c.rlike(of), new.substr(a["n"] + 1, F.lit(1))).otherwise(c)).alias("s")),
    )
    return _let(step, lambda a: F.concat(a["s"], new.substr(a["n"] + 1, F.length(new))))


def dress(surface: Column, kind: Column, new: Column, key: str, given: Callable[[Column], Column] | None = None) -> Column:
    """The surrogate in the format of the mention it replaces. ``given`` maps given names
    that are in no list."""

    def secret(new: Column) -> Column:
        head = F.regexp_extract(surface, rf"^(.*?){_VALUE}+$", 1)
        return F.concat(head, new)

    def first(word: Column) -> Column:
        other = given(word) if given else _new_canonical(F.lit("given"), word, key, 0)
        return F.when(word.rlike(rf"^{_WORD}$"), F.coalesce(_new_given(word, key), other)).otherwise(word)

    def name(new: Column) -> Column:
        title = F.regexp_extract(surface, rf"^((?:{TITLES})\.? )", 1)
        before = F.regexp_extract(F.regexp_replace(surface, rf"^(?:{TITLES})\.? ", ""), rf"^((?:.* )?){_WORD}$", 1)
        return F.concat(title, F.array_join(F.transform(F.split(before, " "), first), " "), new)

    def by_kind(new: Column) -> Column:
        return (
            F.when(kind == "secret", secret(new))
            .when(kind == "name", name(new))
            .when(kind == "card", _fill(surface, new, r"^\d$"))
            .when(kind == "phone", _fill(surface, new, r"^[\d+]$"))
            .when(kind == "iban", _fill(surface, new, r"^\S$"))
            .when((kind == "email") & (surface == F.upper(surface)), F.upper(new))
            .otherwise(new)
        )

    return _let(new, by_kind)


def _entities(found: Column) -> Column:
    def one(e: Column) -> Column:
        return F.struct(e.alias("surface"), kind_of(e).alias("kind"))

    return F.transform(F.transform(found, one), lambda x: F.struct(x["surface"].alias("surface"), x["kind"].alias("kind"), canonical(x["surface"], x["kind"]).alias("canon")))


def _distinct_entities(rows: DataFrame, hits: str, *keep: str) -> DataFrame:
    """(kind, canon) of all found strings and of the given names in them that no list holds."""
    listed = F.array(*[F.lit(n) for names in GIVEN.values() for n in names])

    def both(found: Column) -> Column:
        own = F.transform(found, lambda e: F.struct(e["kind"].alias("kind"), e["canon"].alias("canon")))
        given = F.flatten(F.transform(F.filter(found, lambda e: e["kind"] == "name"), lambda e: _given(e["surface"])))
        return F.concat(own, F.transform(F.array_except(given, listed), lambda w: F.struct(F.lit("given").alias("kind"), w.alias("canon"))))

    each = rows.select(*keep, F.explode(_let(_entities(F.array_distinct(F.col(hits))), both)).alias("e"))
    return each.select(*keep, "e.kind", "e.canon").distinct()


def settle(entities: DataFrame, key: str) -> DataFrame | None:
    """(kind, canon, new) of the entities that needed a later attempt, or None.

    ``entities`` has distinct (kind, canon). Of those that share a surrogate in one attempt
    the least canonical form keeps it; forms that occur in the table, or that an earlier
    attempt gave out, are never used. Each attempt is worked out for those alone that still
    have none, and the wider formats of later ones leave fewer each time.
    """
    taken = entities.select("kind", F.col("canon").alias("new"))
    placed: list[DataFrame] = []
    todo, attempt = entities.select("kind", "canon"), 0
    while True:
        tried = materialize(todo.withColumn("new", _new_canonical(F.col("kind"), F.col("canon"), key, attempt)), "surrogates")
        bad = tried.join(taken, ["kind", "new"], "left_semi").select("kind", "canon")
        for earlier in placed:
            bad = bad.unionByName(tried.join(earlier, ["kind", "new"], "left_semi").select("kind", "canon"))
        twice = tried.groupBy("kind", "new").agg(F.count("*").alias("n"), F.min("canon").alias("first")).where("n > 1")
        clash = tried.join(twice, ["kind", "new"]).where("canon <> first").select("kind", "canon")
        bad = materialize(bad.unionByName(clash).distinct(), "clashes")
        if attempt:
            placed.append(tried.join(bad, ["kind", "canon"], "left_anti").select("kind", "canon", "new"))
        else:
            start = tried.join(bad, ["kind", "canon"], "left_anti").select("kind", "canon", "new")
            placed.append(start)
        if bad.limit(1).count() == 0:
            break
        todo, attempt = bad, attempt + 1
    later = placed[1:]
    if not later:
        return None
    out = later[0]
    for part in later[1:]:
        out = out.unionByName(part)
    return materialize(out, "later")


def replace_private(docs: DataFrame, key: str, *, text_col: str = "text", length_col: str | None = None, kinds_col: str | None = None) -> DataFrame:
    """``docs`` with every entity of its texts replaced; other columns stay as they are.

    ``length_col`` names a column that holds the text's length in characters and follows the
    change; ``kinds_col`` adds the types found, in order. Null texts stay null, texts without
    entities are unchanged, rows may repeat, ids play no part, and an empty table gives no
    rows. Text is read twice and never shuffled unless surrogates collide: then the rows that
    hold such an entity alone are joined to them. Names of people are found by the cues that
    this module's head lists, and no others.
    """
    text = F.col(text_col)
    hits, key_col, repl = (fresh(docs, c) for c in ("hits", "text_key", "exceptions"))
    likely = text.rlike(r"[@\d]|AKIA|ASIA|(?i:token|secret|key|passw|pwd)|" + rf"(?<!\p{{L}})(?=\p{{Lu}})(?:{TITLES}|{_ALL_GIVEN})\.? \p{{Lu}}|(?i:{CUES})[ \n]")
    found = F.when(likely, F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0))).otherwise(F.array().cast("array<string>"))
    marked = docs.withColumn(hits, found)
    entities = materialize(_distinct_entities(marked.where(F.size(hits) > 0), hits), "entities")
    later = settle(entities, key)
    out = marked
    if later is not None and later.limit(1).count():
        out = out.withColumn(key_col, F.md5(text))
        each = _distinct_entities(out.where(F.size(hits) > 0), hits, key_col).join(later, ["kind", "canon"])
        maps = each.groupBy(key_col).agg(F.map_from_entries(F.collect_set(F.struct(F.concat_ws("\x1f", "kind", "canon"), F.col("new")))).alias(repl))
        out = out.join(maps, key_col, "left").drop(key_col)
        special = lambda kind, canon: F.col(repl)[F.concat_ws("\x1f", kind, canon)]
    else:
        special = None

    def renewed(kind: Column, canon: Column) -> Column:
        new = _new_canonical(kind, canon, key, 0)
        return new if special is None else F.coalesce(special(kind, canon), new)

    def swap(e: Column) -> Column:
        return dress(e["surface"], e["kind"], renewed(e["kind"], e["canon"]), key, lambda word: renewed(F.lit("given"), word))

    def alone(piece: Column, news: Column) -> Column:
        """``piece`` with the surnames that are keys of ``news`` replaced where they stand alone."""
        words = F.regexp_extract_all(piece, F.lit(LONE), F.lit(0))
        return F.array_join(F.zip_with(F.split(piece, LONE, -1), words, lambda p, w: F.concat(p, F.coalesce(news[w], w, F.lit("")))), "")

    persons = F.filter(_entities(F.array_distinct(F.col(hits))), lambda e: e["kind"] == "name")
    surnames = F.array_distinct(F.transform(persons, lambda e: F.struct(e["canon"].alias("canon"), renewed(e["kind"], e["canon"]).alias("new"))))
    swapped = F.transform(_entities(F.col(hits)), swap)
    pieces = F.split(text, PATTERN, -1)
    pieces = F.when(F.size(persons) > 0, _let(F.map_from_entries(surnames), lambda news: F.transform(pieces, lambda p: alone(p, news)))).otherwise(pieces)
    joined = F.array_join(F.zip_with(pieces, swapped, lambda p, s: F.concat(p, F.coalesce(s, F.lit("")))), "")
    changed = F.size(hits) > 0
    columns = {text_col: F.when(changed, joined).otherwise(text)}
    if kinds_col:
        columns[kinds_col] = F.transform(_entities(F.col(hits)), lambda e: e["kind"])
    done = out.withColumns(columns)
    if length_col:
        done = done.withColumn(length_col, F.when(changed, F.char_length(F.col(text_col)).cast(docs.schema[length_col].dataType)).otherwise(F.col(length_col)))
    return done.drop(hits, repl)
