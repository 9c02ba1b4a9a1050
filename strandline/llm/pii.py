"""Personal data and secrets replaced by keyed surrogates.

An entity (e-mail address, phone, IP address, payment card, account number,
social security number, secret, person's name) gets a surrogate of its own type and shape, derived from a
keyed hash of its type and normal form: the same entity gets the same surrogate
in every document. Digits give way to digits and letters to letters of their
script and case, separators stay; cards keep their first digit and a right
check digit; names keep title, gender and script.

A person is known by given and family name, each with a surrogate of its own:
"Mr John Smith", "Mr. John Smith", "Dr Smith" and, once a title has named the
person in a document, a bare "John Smith", "Smith" or "John" in it all agree. A
title without gender takes that of another mention of the person in the document.

Distinctness is checked over the whole corpus. Surrogates of attempt 0 that
meet one another, or an entity that really occurs, go to attempt 1 for all but
the smallest entity, and so on; every other attempt is longer by one character,
so there is always room. Only those exceptions, few by nature, are joined
back to the documents; everything else is computed where the text is. The main
path consists of DataFrame operations only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.llm._store import join_groups, materialize, row_key, text_or_empty

#: Bytes of exceptions that are joined by broadcast; more go through a shuffle join.
BROADCAST_BYTES = 8 << 20

# Titles by gender, and the syllables that given and family names are made of, by script.
MALE_TITLES = ["Mr", "Mister", "Sir", "Herr", "Monsieur", "Señor", "Don", "Signor", "Господин", "Κύριος"]
FEMALE_TITLES = ["Mrs", "Ms", "Miss", "Madam", "Frau", "Madame", "Mme", "Señora", "Doña", "Signora", "Госпожа", "Κυρία"]
OTHER_TITLES = ["Dr", "Doctor", "Doktor", "Prof", "Professor", "Доктор", "Профессор"]
STARTS = {
    "latin": "Al Ba Be Bor Ca Cor Da Del Do Ed El Fa Fer Ga Gar Ha Hel Is Ja Jor Ka Kel La Lor Ma Mer Na Nor Ol Pa Per Ra Ro Sa Sel Ta Tor Va Ver Wil".split(),
    "cyrillic": "Ар Ба Бе Бор Ва Вер Га Гор Да Дем Ел Жа Зо Иг Ка Кор Ла Лев Ма Мир На Ник Ол Па Пет Ра Ро Са Сер Та Тим Фе".split(),
    "greek": "Αλ Αν Βα Γα Δη Ελ Ζη Θε Κα Κων Λα Λε Μα Μι Να Νι Πα Πε Ρο Σα Στε Τα Φι Χα".split(),
}
MIDDLES = {
    "latin": "ba be bi da de di do ga ge ka ke ki la le li lo ma me mi mo na ne ni no pa ra re ri ro sa se si ta te ti to va ve vi".split(),
    "cyrillic": "ба бе ва ве ви га да де до жи за зи ка ко ла ле ли ло ма ми мо на ни но ра ре ри ро са се си та ти то".split(),
    "greek": "βα γα γε δα δο κα κο λα λε λι μα με μι να νι νο πα πο ρα ρι ρο σα σι τα τι το".split(),
}
ENDS = {
    ("family", "latin"): "bert by den der field ford ham ker land ler ley man mer ner ney ridge ris sen son stead ston ter ton vey well wick win worth".split(),
    ("m", "latin"): "bert den fred lan lef lin mon nard nold rick ron sten ton vin win".split(),
    ("f", "latin"): "bella della dine lena lia lina mara nia nora rica rina sia tina trice vina".split(),
    ("n", "latin"): "bin dry ley lyn mie nis rey ry sky ty vy".split(),
    ("family", "cyrillic"): "бов вин дов жов зин ков лев лин лов мин мов нин нов пов рин ров сов тин тов хов".split(),
    ("m", "cyrillic"): "бор вид дан лад лей мир нат ний рат рий сан сей тан тин фан".split(),
    ("f", "cyrillic"): "бина вара дина лана лия мила ния рина рия сана сия тина фина".split(),
    ("n", "cyrillic"): "ли ня ри ша жи си ти".split(),
    ("family", "greek"): "δης κης λης νης ρας σης τος πουλος κος λος νος ρης".split(),
    ("m", "greek"): "νος ρος κης λος μος σης τος".split(),
    ("f", "greek"): "να ρα λια νη τα κη σα".split(),
    ("n", "greek"): "λι ρι νι τι".split(),
}
# Alphabets that letters are replaced within.
ALPHABETS = [
    "abcdefghijklmnopqrstuvwxyz",
    "ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "àáâãäåæçèéêëìíîïñòóôõöøùúûüýß",
    "ÀÁÂÃÄÅÆÇÈÉÊËÌÍÎÏÑÒÓÔÕÖØÙÚÛÜÝ",
    "абвгдежзийклмнопрстуфхцчшщъыьэюя",
    "АБВГДЕЖЗИЙКЛМНОПРСТУФХЦЧШЩЪЫЬЭЮЯ",
    "αβγδεζηθικλμνξοπρστυφχψω",
    "ΑΒΓΔΕΖΗΘΙΚΛΜΝΞΟΠΡΣΤΥΦΧΨΩ",
    "āăąćĉċčďđēĕėęěĝğġģĥħĩīĭįĵķĺļľłńņňōŏőŕŗřśŝşšţťũūŭůűųŵŷźżž",
    "ĀĂĄĆĈĊČĎĐĒĔĖĘĚĜĞĠĢĤĦĨĪĬĮĴĶĹĻĽŁŃŅŇŌŎŐŔŖŘŚŜŞŠŢŤŨŪŬŮŰŲŴŶŹŻŽ",
    "ёђѓєѕіїјљњћќўџ",
    "ЁЂЃЄЅІЇЈЉЊЋЌЎЏ",
    "άέήίόύώϊϋΐΰς",
    "ΆΈΉΊΌΎΏΪΫ",
]
# First and last code point of the letters of further scripts, replaced within these ranges.
RANGES = [
    (0x531, 0x556), (0x561, 0x586),  # Armenian
    (0x5D0, 0x5EA),  # Hebrew
    (0x621, 0x63A), (0x641, 0x64A),  # Arabic
    (0x660, 0x669), (0x6F0, 0x6F9), (0x966, 0x96F),  # Arabic and Devanagari digits
    (0x905, 0x939),  # Devanagari
    (0xE01, 0xE2E),  # Thai
    (0x10D0, 0x10F0),  # Georgian
    (0x3041, 0x3096), (0x30A1, 0x30FA),  # kana
    (0x3400, 0x4DBF), (0x4E00, 0x9FFF),  # Han
    (0xAC00, 0xD7A3),  # Hangul
]

_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
_TITLES = "|".join(MALE_TITLES + FEMALE_TITLES + OTHER_TITLES)
EMAIL = r"[\p{L}\p{N}][\p{L}\p{N}._%+\-]*+@[A-Za-z0-9\-]{1,63}(?:\.[A-Za-z0-9\-]{1,63})+"
_ASSIGNED = r"(?i:pass(?:word|wd|phrase)|secret|token|api[_\-]?key)[\"']?\s{0,3}[=:]\s{0,3}[\"']?"
SECRET = rf"{_ASSIGNED}[A-Za-z0-9+/_\-]{{6,}}|AKIA[A-Z0-9]{{12,20}}(?![A-Za-z0-9])"
IPV4 = rf"(?:{_OCTET}\.){{3}}{_OCTET}(?!\d|\.\d)"
_HEX = "[0-9A-Fa-f]{1,4}"
IPV6 = rf"(?=[A-Fa-f:]*\d)(?:(?:{_HEX}:){{7}}{_HEX}|(?:{_HEX}:){{1,6}}(?::{_HEX}){{1,6}})(?![\p{{L}}\p{{N}}:])"
PHONE = "|".join(
    [
        r"\+?(?:\d{1,3}[ .\-]?)?\(\d{3}\)[ .\-]?\d{3}[ .\-]?\d{4}(?!\d)",
        r"\+\d{1,3}[ .\-]\d{2,4}(?:[ .\-]\d{2,4}){2,3}(?!\d)",
        r"\+\d{1,3}[ .\-]\d{2,4}[ .\-/]\d{5,8}(?!\d)",
        r"\+\d{8,15}(?!\d)",
        r"\d{3}(?:-\d{3}-|\.\d{3}\.| \d{3} )\d{4}(?!\d)",
        r"0\d{2,4}[ /\-]\d{5,8}(?!\d)",
    ]
)
SSN = r"\d{3}-\d{2}-\d{4}(?![\d\-])"
CARD = r"\d{4}(?:[ \-]\d{4}){3}(?!\d)|\d{13,19}(?!\d)"
IBAN = r"[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"
_WORD = r"\p{Lu}(?:['’]\p{Lu})?\p{L}+(?:-\p{Lu}\p{L}+)*"
NAME = rf"(?:{_TITLES})\.? (?:\p{{Lu}}\. )?{_WORD}(?: (?:\p{{Lu}}\. )?{_WORD})?"
#: What an entity may not directly follow: it would be the tail of a longer word or number.
_BEFORE = r"(?<![\p{L}\p{N}._%+\-])"
DETECT = rf"{_BEFORE}(?:{EMAIL}|{SECRET}|{IBAN}|{IPV6}|{IPV4}|{PHONE}|{SSN}|{CARD}|{NAME})|(?<!\+)\+\d{{1,3}} \(\d{{3}}\) \d{{3}}-\d{{4}}(?!\d)|(?<=[._%\-])(?:{IPV4}|{CARD})"


def _let(value: Column, use) -> Column:
    """use(value) with the value computed once: lambdas hold no common subexpressions."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, r"\D", "")


def _luhn_sum(digits: Column, skip: int) -> Column:
    """The check sum of a digit string whose last digit counts single (skip 0) or which lacks its check digit (skip 1)."""
    chars = F.split(F.reverse(digits), "")

    def add(total: Column, pair: Column) -> Column:
        d = pair["d"].cast("int")
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return total + F.coalesce(F.when((pair["i"] + skip) % 2 == 1, twice).otherwise(d), F.lit(0))

    pairs = F.transform(chars, lambda c, i: F.struct(c.alias("d"), i.alias("i")))
    return F.aggregate(pairs, F.lit(0), add)


def kind_of(found: Column) -> Column:
    """The type of a match, null if it is none: a card or account number must satisfy its check sum."""
    digits = _digits(found)
    return (
        F.when(found.contains("@"), "email")
        .when(found.rlike(rf"^(?:{SECRET})"), "secret")
        .when(found.rlike(rf"^(?:{IBAN})$"), "iban")
        .when(found.rlike(rf"^(?:{IPV4})$"), "ip")
        .when(found.rlike(rf"^(?:{IPV6})$"), "ipv6")
        .when(found.rlike(rf"^(?:{PHONE})$"), "phone")
        .when(found.rlike(rf"^(?:{SSN})$"), "ssn")
        .when(found.rlike(r"^[\d \-]+$"), F.when(F.length(digits).between(13, 19) & (_luhn_sum(digits, 0) % 10 == 0), F.lit("card")))
        .when(found.rlike(r"^\p{Lu}[\p{L}.'’\- ]+$"), "name")
    )


def normal_form(found: Column, kind: Column) -> Column:
    """What makes two matches the same entity: case of e-mail addresses and separators in numbers don't count; secrets are their values.

    Numbers of the plan with country code 1 are the same with and without it. Names have parts of their own, see named."""
    digits = _digits(found)
    return (
        F.when(kind.isin("email", "ipv6"), F.lower(found))
        .when((kind == "phone") & (F.length(digits) == 11) & digits.startswith("1"), F.substring(digits, 2, 10))
        .when(kind.isin("phone", "card", "ssn"), digits)
        .when(kind == "iban", F.regexp_replace(found, " ", ""))
        .when(kind == "secret", _secret_value(found))
        .otherwise(found)
    )


def _secret_value(found: Column) -> Column:
    return F.regexp_replace(found, rf"^{_ASSIGNED}", "")


def _number(digest: Column, at: Column) -> Column:
    """0 to 65535 from four hex digits of a digest of 128, at a place that wraps round."""
    return F.conv(F.substring(digest, (at * 4) % 124 + 1, F.lit(4)), 16, 10).cast("int")


def _char(code: Column) -> Column:
    return F.decode(F.unhex(F.lpad(F.hex(code.cast("long")), 8, "0")), "UTF-32")


def _mapped(value: Column, digest: Column) -> Column:
    """The value with every digit and letter replaced within its own kind.

    A letter or digit outside all alphabets and ranges becomes a Latin letter, so that none stays."""

    alphabets = F.split(F.lit(" ".join(ALPHABETS)), " ")
    ranges = F.expr("array(" + ", ".join(f"struct({low} AS low, {high} AS high)" for low, high in RANGES) + ")")

    def in_range(c: Column, n: Column) -> Column:
        fits = F.filter(ranges, lambda r: F.ascii(c).between(r["low"], r["high"]))
        return F.get(F.transform(fits, lambda r: _char(n % (r["high"] - r["low"] + 1) + r["low"])), F.lit(0))

    def one(c: Column, i: Column) -> Column:
        def pick(n: Column) -> Column:
            fits = F.filter(alphabets, lambda a: a.contains(c))
            own = F.get(F.transform(fits, lambda a: F.substring(a, n % F.length(a) + 1, F.lit(1))), F.lit(0))
            letter = F.when(c.rlike(r"[\p{L}\p{N}]"), F.coalesce(own, in_range(c, n), F.substring(F.lit(ALPHABETS[0]), n % 26 + 1, F.lit(1))))
            return F.when(c == "", c).when(c.between("0", "9"), (n % 10).cast("string")).otherwise(F.coalesce(letter, c))

        return _let(_number(digest, i), pick)

    return F.array_join(F.transform(F.split(value, ""), one), "")


def _laid_over(digits: Column, shape: Column) -> Column:
    """The shape with its digits replaced, in order, by those of a digit string; digits left over follow."""
    step = F.aggregate(
        F.split(shape, ""),
        F.struct(F.lit("").alias("out"), F.lit(1).alias("at")),
        lambda s, c: F.when(c.between("0", "9"), F.struct(F.concat(s["out"], F.substring(digits, s["at"], F.lit(1))).alias("out"), (s["at"] + 1).alias("at"))).otherwise(
            F.struct(F.concat(s["out"], c).alias("out"), s["at"].alias("at"))
        ),
    )
    return _let(step, lambda e: F.concat(e["out"], F.substring(digits, e["at"], F.length(digits))))


def surrogate(normal: Column, kind: Column, key: str, attempt: Column, kinds: tuple[str, ...] = ("given", "family", "")) -> Column:
    """The surrogate of a normal form, itself in normal form. Every two attempts it is longer by one character or syllable.

    kinds: what kind can be, given and family names apart ("" for all others); fewer make a smaller expression."""
    digest = F.sha2(F.concat_ws("|", F.lit(key), kind, normal, attempt.cast("string")).cast("binary"), 512)
    grown = F.floor(attempt / 2).cast("int")
    out = F.when(F.lit(False), F.lit(""))
    if "family" in kinds:
        out = out.when(kind == "family", _let(digest, lambda d: _name(normal, F.lit("family"), ("family",), d, grown)))
    if "given" in kinds:
        given, gender = F.substring(normal, F.lit(3), F.length(normal)), F.substring(normal, 1, 1)
        out = out.when(kind == "given", F.concat(F.substring(normal, 1, 2), _let(digest, lambda d: _name(given, gender, ("m", "f", "n"), d, grown))))
    if "" in kinds:
        out = out.otherwise(_let(digest, lambda d: _let(_mapped(normal, d), lambda mapped: _surrogate(normal, mapped, kind, key, attempt, d))))
    return out


def _surrogate(normal: Column, mapped: Column, kind: Column, key: str, attempt: Column, digest: Column) -> Column:
    grown = F.floor(attempt / 2).cast("int")
    tail = F.sha2(digest.cast("binary"), 512)
    letters = F.substring(F.translate(tail, "0123456789", "ghijklmnop"), F.lit(1), grown)
    more = F.substring(F.translate(tail, "abcdef", "012345"), F.lit(1), grown)
    rest = F.substring(mapped, F.lit(2), F.length(normal))
    domain = F.substring_index(normal, "@", -1)
    domain_digest = F.sha2(F.concat_ws("|", F.lit(key), F.lit("domain"), domain).cast("binary"), 512)
    kept = F.regexp_extract(domain, r"(\.?example\.(?:com|org|net)|\.[^.]+)$", 1)  # reserved names and the top level stay
    name = F.substring(domain, F.lit(1), F.length(domain) - F.length(kept))
    email = F.concat(F.substring(mapped, F.lit(1), F.instr(normal, "@") - 1), letters, F.lit("@"), _let(domain_digest, lambda d: _mapped(name, d)), kept)
    octets = [F.when(attempt < 4, F.lit("10")).otherwise((_number(digest, F.lit(9)) % 223 + 1).cast("string"))]
    octets += [(_number(digest, F.lit(i)) % 256).cast("string") for i in range(3)]
    wide = F.regexp_replace(F.concat(F.lit("fd"), F.substring(tail, 1, 30)), r"(.{4})(?=.)", "$1:")  # of IPv6's local range
    card_body = F.concat(F.substring(normal, 1, 1), F.substring(mapped, F.lit(2), F.length(normal) - 2), more)
    card = _let(card_body, lambda c: F.concat(c, ((10 - _luhn_sum(c, 1) % 10) % 10).cast("string")))
    lead = F.when(normal.startswith("0"), F.lit("0")).otherwise((_number(digest, F.lit(20)) % 8 + 2).cast("string"))
    phone = F.concat(F.substring(normal, F.lit(1), F.length(normal) - 10), lead, F.substring(mapped, F.length(normal) - 8, F.lit(9)), more)
    return (
        F.when(kind == "email", email)
        .when(kind == "ip", F.when(attempt < 32, F.concat_ws(".", *octets)).otherwise(wide))
        .when(kind == "ipv6", F.when(attempt < 2, _hex_mapped(normal, digest)).otherwise(wide))
        .when(kind == "card", card)
        .when((kind == "phone") & (F.length(normal) >= 10), phone)
        .when((kind == "secret") & normal.startswith("AKIA"), F.concat(F.lit("AKIA"), F.substring(rest, F.lit(4), F.length(normal)), F.upper(letters)))
        .when(kind == "iban", F.concat(F.substring(normal, 1, 2), F.substring(rest, F.lit(2), F.length(normal)), more))
        .when(kind.isin("phone", "ssn"), F.concat(mapped, more))
        .otherwise(F.concat(mapped, letters))
    )


def _hex_mapped(value: Column, digest: Column) -> Column:
    hexes = "0123456789abcdef"
    return F.array_join(F.transform(F.split(value, ""), lambda c, i: F.when(F.lit(hexes).contains(c) & (c != ""), F.substring(F.lit(hexes), _number(digest, i) % 16 + 1, F.lit(1))).otherwise(c)), "")


def _name(part: Column, role: Column, roles: tuple[str, ...], digest: Column, grown: Column) -> Column:
    """A name in lower case, of the part's script and the role (family, or the gender m, f or n), longer by so many syllables."""

    def pick(values: list[str], at: Column) -> Column:
        return F.element_at(F.split(F.lit(" ".join(values)), " "), _number(digest, at) % len(values) + 1)

    out = None
    for script in STARTS:
        inner = F.array_join(F.transform(F.sequence(F.lit(0), grown), lambda i: pick(MIDDLES[script], i + 2)), "")
        end = None
        for r in roles:
            picked = pick(ENDS[r, script], F.lit(1))
            end = F.when(role == r, picked) if end is None else end.when(role == r, picked)
        if script == "cyrillic":  # family names have a female form
            end = F.concat(end, F.when((role == "family") & part.rlike("[ая]$"), F.lit("а")).otherwise(F.lit("")))
        name = F.lower(F.concat(pick(STARTS[script], F.lit(0)), inner, end))
        fits = part.rlike(rf"^\p{{Is{script.capitalize()}}}")
        out = F.when(fits, name) if out is None else out.when(fits, name)
    return out.otherwise(F.concat(_mapped(part, digest), F.repeat(F.substring(part, -1, 1), grown)))


def shaped(found: Column, kind: Column, normal: Column, new: Column) -> Column:
    """A surrogate in normal form, written as the match was written."""
    value, digits = _secret_value(found), _digits(found)
    return (
        F.when(kind.isin("phone", "card", "ssn"), _laid_over(F.concat(F.substring(digits, F.lit(1), F.length(digits) - F.length(normal)), new), found))
        .when(kind == "iban", F.when(found.contains(" "), F.regexp_replace(new, r"(.{4})(?=.)", "$1 ")).otherwise(new))
        .when(kind == "secret", F.concat(F.substring(found, F.lit(1), F.length(found) - F.length(value)), new))
        .when(kind.isin("email", "ipv6") & (found == F.upper(found)), F.upper(new))
        .otherwise(new)
    )


def _tokens(name: Column) -> Column:
    return F.split(name, " ")


def persons_of(matches: Column) -> Column:
    """given (null if only the family is named), family and gender (null if the title tells none) of the titled names among matches."""

    def person(m: Column) -> Column:
        title = F.regexp_replace(F.regexp_extract(m, rf"^((?:{_TITLES})\.?) ", 1), r"\.$", "")
        words = _tokens(F.regexp_replace(m, rf"^(?:{_TITLES})\.? ", ""))
        return F.struct(
            F.when((F.size(words) > 1) & ~F.get(words, F.lit(0)).endswith("."), F.get(words, F.lit(0))).alias("given"),
            F.element_at(words, -1).alias("family"),
            F.when(title.isin(MALE_TITLES), "m").when(title.isin(FEMALE_TITLES), "f").alias("gender"),
        )

    return F.array_distinct(F.transform(F.filter(matches, lambda m: m.rlike(rf"^(?:{NAME})$")), person))


def _aliases(persons: Column) -> Column:
    """A pattern of the bare mentions of a document's persons, full names first."""
    given = F.filter(persons, lambda p: p["given"].isNotNull())
    full = F.transform(given, lambda p: F.concat(p["given"], F.lit(r" (?:\p{Lu}\. )?"), p["family"]))
    either = F.array_union(F.transform(persons, lambda p: p["family"]), F.transform(given, lambda p: p["given"]))
    return F.array_join(F.concat(F.array_distinct(full), F.reverse(F.array_sort(either))), "|")  # longer before its own beginning


def _pattern(persons: Column) -> Column:
    """What to look for in a document: entities and, where titles name persons, their bare mentions."""
    bare = F.concat(F.lit(rf"{DETECT}|{_BEFORE}(?=\p{{Lu}})(?:"), _aliases(persons), F.lit(r")(?![\p{L}\p{N}])"))
    return F.when(F.size(persons) > 0, bare).otherwise(F.lit(DETECT))


def _named(m: Column, persons: Column) -> Column:
    """A name's title (with its dot and space), given and middle name (an initial) and family (any null where absent), and gender."""
    title = F.regexp_extract(m, rf"^((?:{_TITLES})\.? )", 1)
    words = _tokens(F.substring(m, F.length(title) + 1, F.length(m)))

    def parts(w: Column) -> Column:
        first, last = F.get(w, F.lit(0)), F.element_at(w, -1)
        only_given = (title == "") & (F.size(w) == 1) & ~F.exists(persons, lambda p: p["family"] == first)
        initial = first.endswith(".")
        given = F.when((only_given | (F.size(w) > 1)) & ~initial, first)
        middle = F.when(initial, first).when(F.size(w) > 2, F.get(w, F.lit(1)))
        family = F.when(~only_given, last)
        own = F.when(F.regexp_replace(title, r"\.? $", "").isin(MALE_TITLES), "m").when(F.regexp_replace(title, r"\.? $", "").isin(FEMALE_TITLES), "f")
        fits = F.filter(
            persons,
            lambda p: p["gender"].isNotNull() & (family.isNull() | (p["family"] == family)) & (p["given"].isNull() | (p["given"] == given)) & (family.isNotNull() | p["given"].isNotNull()),
        )
        gender = F.coalesce(own, F.get(fits, F.lit(0))["gender"], F.lit("n"))
        return F.struct(title.alias("title"), given.alias("given"), middle.alias("middle"), family.alias("family"), gender.alias("gender"))

    return _let(words, parts)


def _name_entities(n: Column) -> Column:
    both = F.array(
        F.struct(F.lit("given").alias("kind"), F.concat(n["gender"], F.lit(":"), F.lower(n["given"])).alias("normal")),
        F.struct(F.lit("family").alias("kind"), F.lower(n["family"]).alias("normal")),
    )
    return F.filter(both, lambda e: e["normal"].isNotNull())


def _entities(matches: Column, persons: Column) -> Column:
    """(kind, normal) of every entity among matches; names count by their parts."""
    typed = F.filter(F.transform(matches, lambda m: F.struct(m.alias("found"), kind_of(m).alias("kind"))), lambda t: t["kind"].isNotNull())
    return F.flatten(
        F.transform(
            typed,
            lambda t: F.when(t["kind"] == "name", _name_entities(_named(t["found"], persons))).otherwise(
                F.array(F.struct(t["kind"].alias("kind"), normal_form(t["found"], t["kind"]).alias("normal")))
            ),
        )
    )


def assignments(entities: DataFrame, key: str) -> DataFrame:
    """kind, normal, new, attempt of every distinct (kind, normal): new is no other's, nor an entity that occurs.

    Rounds go on until none is left; surrogates grow with the attempt, so that there is always room."""
    real = materialize(entities.select("kind", "normal").where("kind is not null and normal is not null").distinct(), "entities")
    done, pending, attempt = None, real, 0
    while True:
        tried = pending.withColumns({"new": surrogate(F.col("normal"), F.col("kind"), key, F.lit(attempt)), "attempt": F.lit(attempt)})
        taken = real.select("kind", F.col("normal").alias("new"))
        if done is not None:
            taken = taken.unionByName(done.select("kind", "new"))
        free = tried.join(taken, ["kind", "new"], "left_anti")
        won = materialize(free.groupBy("kind", "new").agg(F.min("normal").alias("normal"), F.min("attempt").alias("attempt")).select("kind", "normal", "new", "attempt"), "surrogates")
        pending = materialize(pending.join(won, ["kind", "normal"], "left_anti"), "pending")
        done = won if done is None else done.unionByName(won)
        if pending.isEmpty():
            return done
        attempt += 1


def replace_entities(df: DataFrame, key: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of df: the id, text with all entities replaced, n_entities, kinds (sorted, distinct).

    A null text counts as empty; a text without entities comes out as it is. Repeated rows come out each; an empty table
    gives an empty one; other columns of df are left out. Rows find their exceptions by hashes of id and text, so it
    doesn't matter in which order df comes."""
    one, two = row_key(id_col, text_col)
    matches = F.regexp_extract_all("text", F.lit(DETECT), F.lit(0))
    rows = df.select(F.col(id_col).alias("id"), one.alias("k1"), two.alias("k2"), text_or_empty(text_col).alias("text"))
    rows = rows.withColumn("titled", matches).withColumn("persons", persons_of(F.col("titled"))).withColumn("pattern", _pattern(F.col("persons")))
    rows = rows.withColumn("matches", F.when(F.size("persons") > 0, F.regexp_extract_all("text", F.col("pattern"), F.lit(0))).otherwise(F.col("titled")))
    found = rows.where(F.size("titled") > 0).select("k1", "k2", F.explode(_entities(F.col("matches"), F.col("persons"))).alias("e"))
    held = materialize(found.select("k1", "k2", "e.kind", "e.normal").distinct(), "found")
    odd = assignments(held, key).where("attempt > 0").select("kind", "normal", "new")
    sizes = materialize(held.groupBy("kind", "normal").agg(F.count("*").alias("size")).join(odd, ["kind", "normal"]), "odd")
    entity = F.concat_ws("|", "kind", "normal")
    groups = sizes.select(entity.alias("entity"), "new", "size")
    total = held.count()
    exceptions = join_groups(held.select("k1", "k2", entity.alias("entity")), groups, "entity", "size", total)
    per_row = exceptions.groupBy(F.col("k1").alias("_k1"), F.col("k2").alias("_k2")).agg(F.map_from_entries(F.collect_list(F.struct("entity", "new"))).alias("odd"))
    per_row = materialize(per_row, "exceptions")
    text_bytes = F.aggregate(F.map_entries("odd"), F.lit(32), lambda n, e: n + F.length(e["key"]) + F.length(e["value"]))
    if (per_row.agg(F.sum(4 * text_bytes)).first()[0] or 0) <= BROADCAST_BYTES:
        per_row = F.broadcast(per_row)
    joined = rows.join(per_row, (rows["k1"] == per_row["_k1"]) & (rows["k2"] == per_row["_k2"]), "left")

    def new_of(kind: Column, normal: Column, which: str = "") -> Column:
        return F.coalesce(F.element_at(F.col("odd"), F.concat_ws("|", kind, normal)), surrogate(normal, kind, key, F.lit(0), (which,)))

    def cased(value: Column, old: Column) -> Column:
        return _let(value, lambda new: F.when((F.length(old) > 1) & (old == F.upper(old)), F.upper(new)).otherwise(F.concat(F.upper(F.substring(new, 1, 1)), F.substring(new, F.lit(2), F.length(new)))))

    def new_name(m: Column) -> Column:
        def written(n: Column) -> Column:
            given = cased(F.substring(new_of(F.lit("given"), F.concat(n["gender"], F.lit(":"), F.lower(n["given"])), "given"), 3, 1_000_000), n["given"])
            middle = _mapped(n["middle"], F.sha2(F.concat_ws("|", F.lit(key), F.lit("middle"), n["given"], n["middle"], n["family"]).cast("binary"), 512))
            family = cased(new_of(F.lit("family"), F.lower(n["family"]), "family"), n["family"])
            return F.concat(n["title"], F.concat_ws(" ", F.when(n["given"].isNotNull(), given), middle, F.when(n["family"].isNotNull(), family)))

        return _let(_named(m, F.col("persons")), written)

    def new_text(m: Column) -> Column:
        def other(kind: Column) -> Column:
            return _let(normal_form(m, kind), lambda normal: _let(new_of(kind, normal), lambda new: shaped(m, kind, normal, new)))

        return _let(kind_of(m), lambda kind: F.when(kind.isNull(), m).when(kind == "name", new_name(m)).otherwise(other(kind)))

    parts = F.split("text", F.col("pattern"), -1)
    rebuilt = F.array_join(F.zip_with(parts, F.transform("matches", new_text), lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")
    kinds = F.filter(F.transform("matches", kind_of), lambda k: k.isNotNull())
    return joined.select(
        F.col("id").alias(id_col),
        F.when(F.size("matches") > 0, rebuilt).otherwise(F.col("text")).alias("text"),
        F.size(kinds).cast("long").alias("n_entities"),
        F.array_sort(F.array_distinct(kinds)).alias("kinds"),
    )
