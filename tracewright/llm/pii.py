"""Surrogates for personal data and secrets, with built-in functions only.

Entities are cut out of the text by one regular expression and put back as
keyed surrogates: the text is split at the matches, every match is mapped, and
the pieces are joined again inside the row. A surrogate is a function of the
key, the type and the canonical form alone, so the same person, number or
address is replaced alike everywhere without a dictionary or a join.

Numbers (cards, phones, social security numbers, IP addresses) go through a
keyed Feistel network over their digits: a bijection of each format, distinct
by construction, with Luhn check digits made valid again. Secrets, AWS keys and
IBANs go through one over their characters, a bijection of the values with the
same kinds of characters in the same places. Hex keys, emails and names take
60 bits or more of a keyed hash, shaped like the original (case, digits,
script, gender of a titled name). A check over all distinct entities confirms
distinctness and coreference; of entities that share a surrogate all but one
get another by a counter, and the rest of the run stays as it is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, UPPER, let, read_table, scratch, stored

_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
#: Titles by the gender that they tell, and words that stand between the parts of a name.
_MALE, _FEMALE, _OPEN = "Mr|Herr|Señor|Monsieur|господин|Κύριος", "Mrs|Ms|Miss|Frau|Señora|Madame|Mme|госпожа|Κυρία", "Dr|Prof|Doktor|Doctor|Docteur|Professor|доктор|профессор"
_TITLE = rf"(?:{_MALE}|{_FEMALE}|{_OPEN})\.? (?:(?:Dr|Prof)\.? )*+"
_PARTICLES = "de|del|della|der|den|des|la|le|las|los|van|von|vom|zu|zum|zur|bin|ibn|al|el|da|das|do|dos|du|di|ten|ter|af|av"
_SECRET_WORD = r"(?i:(?<![\p{L}\p{N}])[a-z_]{0,24}(?:password|passwd|pwd|secret|token|api[_\-]?key|secret[_\-]key)\s{0,3}[=:]\s{0,3}[\"']?)"
#: A capitalised word, with apostrophes inside but no possessive one.
_PART = r"\p{Lu}(?:\p{L}|'(?!s?(?!\p{L})))+"
#: What may come before such a word: small words, and an initial.
_LEAD = rf"(?:(?:{_PARTICLES}) ){{0,3}}+"
_INITIAL = r"\p{Lu}\.(?= ?\p{Lu})"
#: Types in order of precedence; look-behinds and possessive runs keep every pattern linear in the text.
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+\-])[A-Za-z0-9._%+\-]++@[A-Za-z0-9\-]+(?:\.[A-Za-z0-9\-]+)*\.[A-Za-z]{2,24}",
    "secret": _SECRET_WORD + r"[^\s\"',;<>]{6,}",
    "aws_key": r"(?<![A-Za-z0-9])A(?:KIA|SIA)[A-Z0-9]{16}(?![A-Za-z0-9])",
    "hex_key": r"(?<![A-Za-z0-9])(?:[0-9a-f]{64}|[0-9a-f]{40}|[0-9a-f]{32})(?![A-Za-z0-9])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "phone": r"(?<![\w+])\+\d{1,3}[ .\-]?(?:\(\d{1,4}\)|\d{1,4})(?:[ .\-]?\d{2,4}){1,4}(?!\d)|(?<![\w(])\(\d{3}\)[ .\-]?\d{3}[.\-]\d{4}(?!\d)|(?<![\w.\-])\d{3}[.\-]\d{3}[.\-]\d{4}(?![\w\-])"
    # within a country: a trunk 0, an area and a number, or five pairs
    r"|(?<![\w.,:/+\-])0\d{1,4}[ /\-]\d{5,10}(?![\w\-]|[.,:/]\d)|(?<![\w.,:/+\-])0\d(?:[ .\-]\d{2}){4}(?![\w\-]|[.,:/]\d)",
    "ssn": r"(?<![\w\-])\d{3}-\d{2}-\d{4}(?![\w\-])",
    "card": r"(?<![\w\-])(?:[3-6]\d{12,18}|[3-6]\d{3} \d{4} \d{4} \d{4}|[3-6]\d{3}-\d{4}-\d{4}-\d{4})(?![\w\-])",
    "ip": rf"(?<![\w.])(?:{_OCTET}\.){{3}}{_OCTET}(?!\w|\.\d)",
    "ip6": r"(?<![\w:.])(?=[0-9A-Fa-f]{0,4}+:)(?=[A-Fa-f:]*\d)(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,5})?::(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,5})?)(?![\w:])",
    "name": rf"(?<![\p{{L}}]){_TITLE}{_LEAD}(?:{_INITIAL} ?){{0,3}}{_PART}(?:(?:[ \-]| {_LEAD})(?:{_INITIAL}|{_PART})){{0,3}}",
}
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
_HEX = "0123456789abcdef"


def _stream(key: Column, length: Column) -> Column:
    """Keyed hex digits, at least two for each character; bind it before use in a lambda."""
    blocks = F.transform(F.sequence(F.lit(0), F.floor(length / 64).cast("int")), lambda b: F.sha2(F.concat_ws("|", key, b.cast("string")).cast("binary"), 512))
    return F.array_join(blocks, "")


def _byte(stream: Column, i: Column) -> Column:
    return F.conv(F.substring(stream, i * 2 + 1, F.lit(2)), 16, 10).cast("int")


def _pick(chars: str, n: Column) -> Column:
    return F.substring(F.lit(chars), n % len(chars) + 1, F.lit(1))


def _reshape(value: Column, key: Column, hex_only: bool = False) -> Column:
    """value with each ASCII letter and digit replaced by another of its kind."""

    def chars(s: Column) -> Column:
        def one(c: Column, i: Column) -> Column:
            n = _byte(s, i)
            if hex_only:
                return _pick(_HEX, n)
            return F.when(c.rlike("[0-9]"), _pick("0123456789", n)).when(c.rlike("[a-z]"), _pick(LOWER, n)).when(c.rlike("[A-Z]"), _pick(UPPER, n)).otherwise(c)

        return F.array_join(F.transform(F.split(value, ""), one), "")

    return let(_stream(key, F.length(value)), chars)


def _turned(half: Column, key: Column) -> Column:
    """half with each ASCII letter and digit moved on inside its kind."""

    def one(s: Column):
        on = lambda c, i, chars: _pick(chars, F.ascii(c) - ord(chars[0]) + _byte(s, i))
        return lambda c, i: F.when(c.between("0", "9"), on(c, i, "0123456789")).when(c.between("a", "z"), on(c, i, LOWER)).when(c.between("A", "Z"), on(c, i, UPPER)).otherwise(c)

    return let(_stream(key, F.length(half)), lambda s: F.array_join(F.transform(F.split(half, ""), one(s)), ""))


def _permute(value: Column, key: Column) -> Column:
    """A keyed bijection of the strings with the same kinds of characters in the same places: a Feistel network over the two halves."""
    cut = F.floor(F.length(value) / 2).cast("int")
    state = F.struct(F.substring(value, F.lit(1), cut).alias("a"), F.substring(value, cut + 1, F.length(value)).alias("b"))
    for r in range(0, 6, 2):
        state = let(state, _turn_a(key, r))
        state = let(state, _turn_b(key, r + 1))
    return let(state, lambda s: F.concat(s["a"], s["b"]))


def _turn_a(key: Column, r: int):
    return lambda s: F.struct(_turned(s["a"], F.concat_ws("|", key, F.lit(str(r)), s["b"])).alias("a"), s["b"].alias("b"))


def _turn_b(key: Column, r: int):
    return lambda s: F.struct(s["a"].alias("a"), _turned(s["b"], F.concat_ws("|", key, F.lit(str(r)), s["a"])).alias("b"))


def _power(n: Column) -> Column:
    return F.rpad(F.lit("1"), (n + 1).cast("int"), F.lit("0")).cast("bigint")


def _feistel(digits: Column, key: Column) -> Column:
    """A keyed bijection of the digit strings of each length from 2 to 36."""
    left = lambda d: F.floor(F.length(d) / 2).cast("int")

    def mixed(x: Column, n: Column, other: Column, r: int) -> Column:
        f = F.conv(F.substring(F.sha2(F.concat_ws("|", key, F.lit(str(r)), other.cast("string")).cast("binary"), 256), 1, 15), 16, 10).cast("bigint")
        return (x + f % _power(n)) % _power(n)

    def run(d: Column) -> Column:
        la, lb = left(d), F.length(d) - left(d)
        state = F.struct(F.substring(d, F.lit(1), la).cast("bigint").alias("a"), F.substring(d, la + 1, lb).cast("bigint").alias("b"))
        for r in range(0, 6, 2):
            state = let(state, _round_a(mixed, la, r))
            state = let(state, _round_b(mixed, lb, r + 1))
        return let(state, lambda s: F.concat(F.lpad(s["a"].cast("string"), la, F.lit("0")), F.lpad(s["b"].cast("string"), lb, F.lit("0"))))

    return let(digits, run)


def _round_a(mixed, n: Column, r: int):
    return lambda s: F.struct(mixed(s["a"], n, s["b"], r).alias("a"), s["b"].alias("b"))


def _round_b(mixed, n: Column, r: int):
    return lambda s: F.struct(s["a"].alias("a"), mixed(s["b"], n, s["a"], r).alias("b"))


def _luhn_sum(digits: Column, doubled_from: int) -> Column:
    """Luhn sum of a digit string read from the right; doubled_from 0 doubles the last digit, 1 the one before."""
    each = F.transform(F.split(F.reverse(digits), ""), lambda c, i: let(c.cast("int") * (1 + (i + doubled_from + 1) % 2), lambda v: F.when(v > 9, v - 9).otherwise(v)))
    return F.aggregate(each, F.lit(0), lambda a, x: a + x)


def _card(digits: Column, key: Column) -> Column:
    """A bijection that keeps the first digit and how far the last one is from the valid check digit."""
    n = F.length(digits)
    check = lambda b: (10 - _luhn_sum(b, 0) % 10) % 10
    off = F.substring(digits, n, F.lit(1)).cast("int") - check(F.substring(digits, F.lit(1), n - 1)) + 10
    body = F.concat(F.substring(digits, 1, 1), _feistel(F.substring(digits, F.lit(2), n - 2), key))
    return let(body, lambda b: F.concat(b, ((check(b) + off) % 10).cast("string")))


def _ip(value: Column, key: Column) -> Column:
    octets = lambda o: F.struct((F.get(o, 0).cast("int") * 256 + F.get(o, 1).cast("int")).alias("a"), (F.get(o, 2).cast("int") * 256 + F.get(o, 3).cast("int")).alias("b"))
    f = lambda x, r: F.conv(F.substring(F.sha2(F.concat_ws("|", key, F.lit(str(r)), x.cast("string")).cast("binary"), 256), 1, 8), 16, 10).cast("bigint")
    state = let(F.split(value, r"\."), octets)
    for r in range(0, 6, 2):
        state = let(state, _ip_a(f, r))
        state = let(state, _ip_b(f, r + 1))
    part = lambda x: F.concat_ws(".", F.floor(x / 256).cast("string"), (x % 256).cast("string"))
    return let(state, lambda s: F.concat_ws(".", part(s["a"]), part(s["b"])))


def _ip_a(f, r: int):
    return lambda s: F.struct(((s["a"] + f(s["b"], r)) % 65536).alias("a"), s["b"].cast("bigint").alias("b"))


def _ip_b(f, r: int):
    return lambda s: F.struct(s["a"].alias("a"), ((s["b"] + f(s["a"], r)) % 65536).alias("b"))


def _refill(value: Column, given: Column, kind: str = r"\d") -> Column:
    """value with its characters of a kind (digits) replaced in turn, the others as they were."""
    at = lambda i: F.length(F.regexp_replace(F.substring(value, F.lit(1), i + 1), f"(?!{kind}).", ""))
    return let(given, lambda d: F.array_join(F.transform(F.split(value, ""), lambda c, i: F.when(c.rlike(kind), F.substring(d, at(i), F.lit(1))).otherwise(c)), ""))


def _email(value: Column, key: Column) -> Column:
    def parts(p: Column) -> Column:
        local, domain = F.get(p, 0), F.get(p, 1)
        # 13 letters have 61 bits
        padded = F.concat(local, F.substring(F.lit("mnopqrstuvwxy"), F.lit(1), F.greatest(F.lit(0), 13 - F.length(F.regexp_replace(local, "[^a-z]", "")))))
        label = _reshape(F.lit("abcdefgh"), F.concat_ws("|", key, F.lit("domain"), domain))
        top = F.element_at(F.array(F.lit("com"), F.lit("net"), F.lit("org")), F.pmod(F.xxhash64(key, domain), F.lit(3)).cast("int") + 1)
        return F.concat(_reshape(padded, F.concat_ws("|", key, local, domain)), F.lit("@"), label, F.lit(".example."), top)

    return let(F.split(F.lower(value), "@"), parts)


#: Consonants and vowels of the scripts that have capital letters, Latin where none fits, and the endings of given names (a woman's, a man's) and of others.
SCRIPTS = {
    "Cyrillic": ("бвгдзклмнпрстф", "аеиоу", ("на", "н", "р")),
    "Greek": ("βγδζκλμνπρστφχ", "αειοω", ("να", "ν", "ρ")),
    "Armenian": ("բգդզկլմնպրստվ", "աեիոէ", ("նա", "ն", "ր")),
    "Latin": ("bdfgklmnprstvz", "aeiou", ("na", "n", "r")),
}
_BETWEEN = r"(?<=[ \-])|(?=[ \-])|(?<=\.)(?=\p{Lu})"


def _by_script(p: Column, made: dict[str, Column]) -> Column:
    pick = made["Latin"]
    for script, c in made.items():
        pick = F.when(p.rlike(rf"\p{{Is{script}}}"), c).otherwise(pick) if script != "Latin" else pick
    return pick


def _name(value: Column, key: Column) -> Column:
    """Titled names: title and small words stay; each part gets ten syllables (61 bits) in its script, a given name with the title's gender in its ending, an initial another one."""
    title = F.regexp_extract(value, rf"^{_TITLE}", 0)
    female, male = value.rlike(rf"^(?:{_FEMALE})\.? "), value.rlike(rf"^(?:{_MALE})\.? ")

    def part(p: Column, i: Column, n: Column) -> Column:
        def word(s: Column) -> Column:
            syll = lambda j, c, v: F.concat(_pick(c, _byte(s, F.lit(2 * j))), _pick(v, _byte(s, F.lit(2 * j + 1))))
            given = (i == 0) & (n > 1)
            body = lambda c, v: F.initcap(F.concat(*[syll(j, c, v) for j in range(10)]))
            whole = {k: F.concat(body(c, v), F.when(given & female, e[0]).when(given & male, e[1]).otherwise(e[2])) for k, (c, v, e) in SCRIPTS.items()}
            first = {k: F.concat(F.upper(_pick(c, _byte(s, F.lit(0)))), F.lit(".")) for k, (c, _, _) in SCRIPTS.items()}
            return F.when(p.endswith("."), _by_script(p, first)).otherwise(_by_script(p, whole))

        return let(F.sha2(F.concat_ws("|", key, F.lower(p)).cast("binary"), 256), word)

    rest = F.substring(value, F.length(title) + 1, F.length(value))
    kept = lambda p: p.rlike(rf"^(?:[ \-]?|{_PARTICLES})$")
    return F.concat(title, let(F.split(rest, _BETWEEN), lambda w: F.array_join(F.transform(w, lambda p, i: F.when(kept(p), p).otherwise(part(p, i, F.size(w)))), "")))


def _called(name: Column) -> Column:
    """A titled name without its format: lower case, no dots, a space for a hyphen."""
    return F.replace(F.replace(F.lower(name), F.lit("."), F.lit("")), F.lit("-"), F.lit(" "))


def _name_parts(match: Column, surrogate: Column) -> Column:
    """(old, new) of each part of a titled name that is a word of its own, neither small nor an initial."""
    bare = lambda n: F.split(F.regexp_replace(n, rf"^{_TITLE}", ""), r"[ \-]|(?<=\.)(?=\p{Lu})")
    both = F.zip_with(bare(match), bare(surrogate), lambda a, b: F.struct(a.alias("old"), b.alias("new")))
    return F.filter(both, lambda p: p["old"].rlike(rf"^{_PART}$"))


def _ip6(canon: Column, key: Column) -> Column:
    """96 bits of a keyed hash under the prefix that is kept for examples."""
    h = F.sha2(F.concat_ws("|", key, canon).cast("binary"), 256)
    return let(h, lambda s: F.concat(F.lit("2001:db8"), *[F.concat(F.lit(":"), F.substring(s, 1 + 4 * i, 4)) for i in range(6)]))


def _ip6_groups(e: Column) -> Column:
    """The 32 hex digits of an address, whatever is left out in it."""
    groups = lambda p: F.filter(F.split(F.coalesce(p, F.lit("")), ":"), lambda g: g != "")
    halves = F.split(F.lower(e), "::")

    def joined(h: Column) -> Column:
        left, right = groups(F.get(h, F.lit(0))), groups(F.get(h, F.lit(1)))
        zeros = F.array_repeat(F.lit("0"), F.greatest(F.lit(0), 8 - F.size(left) - F.size(right)))
        return F.array_join(F.transform(F.concat(left, zeros, right), lambda g: F.lpad(g, 4, "0")), "")

    return let(halves, joined)


def _untitled(piece: Column, parts: Column) -> Column:
    """piece with the parts of the document's titled names replaced where they stand as words of their own; they are letters and apostrophes only."""
    swap = lambda t, p: F.regexp_replace(t, F.concat(F.lit(r"(?<![\p{L}\p{N}'])"), p["old"], F.lit(r"(?![\p{L}\p{N}])")), p["new"])
    return F.aggregate(parts, piece, swap)


def _id(kind: Column, canon: Column) -> Column:
    return F.xxhash64(kind, canon)


def entity(e: Column, key: str, turns: dict[int, int] | None = None) -> Column:
    """(type, canon, surrogate) of one match; canon is what coreference goes by. turns counts further surrogates by ``_id`` of an entity."""
    digits = F.regexp_replace(e, r"\D", "")
    further = F.create_map(*[F.lit(x) for pair in (turns or {}).items() for x in pair])

    def k(name: str, canon: Column) -> Column:
        own = F.lit(f"{key}|{name}")
        return F.concat_ws("|", own, F.try_element_at(further, _id(F.lit(name), canon)).cast("string")) if turns else own

    tail = lambda d: F.substring(d, F.greatest(F.lit(1), F.length(d) - 9), F.lit(10))
    head = lambda d: F.substring(d, F.lit(1), F.greatest(F.lit(0), F.length(d) - 10))
    lead = F.regexp_extract(e, "^" + _SECRET_WORD, 0)
    value = F.substring(e, F.length(lead) + 1, F.length(e))
    bare = F.regexp_replace(e, " ", "")
    called = _called(e)
    made = {
        "email": (F.lower(e), lambda k: _email(e, k)),
        "secret": (value, lambda k: F.concat(lead, _permute(value, k))),
        "aws_key": (e, lambda k: F.concat(F.substring(e, 1, 4), _permute(F.substring(e, 5, 16), F.concat_ws("|", k, F.substring(e, 1, 4))))),
        "hex_key": (e, lambda k: _reshape(e, F.concat_ws("|", k, e), hex_only=True)),
        "iban": (bare, lambda k: _refill(e, F.concat(F.substring(e, 1, 2), _permute(F.substring(bare, F.lit(3), F.length(bare)), F.concat_ws("|", k, F.substring(e, 1, 2)))), "[A-Z0-9]")),
        "phone": (tail(digits), lambda k: _refill(e, F.when(e.startswith("0"), F.concat(F.lit("0"), _feistel(F.substring(digits, F.lit(2), F.length(digits)), k))).otherwise(F.concat(head(digits), _feistel(tail(digits), k))))),
        "ssn": (digits, lambda k: _refill(e, _feistel(digits, k))),
        "card": (digits, lambda k: _refill(e, _card(digits, k))),
        "ip": (e, lambda k: _ip(e, k)),
        "ip6": (_ip6_groups(e), lambda k: _ip6(_ip6_groups(e), k)),
        "name": (called, lambda k: _name(e, k)),
    }
    pick = None
    for name, (canon, sur) in made.items():
        s = F.struct(F.lit(name).alias("type"), canon.alias("canon"), sur(k(name, canon)).alias("surrogate"))
        test = e.rlike(f"^(?:{PATTERNS[name]})$")
        pick = F.when(test, s) if pick is None else pick.when(test, s)
    return pick


def redact(docs: DataFrame, key: str, text_col: str = "text", turns: dict[int, int] | None = None) -> DataFrame:
    """docs with the text replaced, and a column ``entities`` of (type, canon, surrogate) in text order. One narrow projection.

    Null texts stay null and, like empty ones, have no entities. An existing
    column ``entities`` is replaced; ties and repeated rows are treated alike.
    Where a document has a titled name, its parts are replaced in the rest of
    that document too, with or without the title; entities lists titled ones.
    Who has the key can undo the bijections, so it comes from the caller. A very
    long text is one row of one task, in time in proportion to its length.
    """
    t = F.col(text_col)
    none = F.array().cast("array<struct<type:string,canon:string,surrogate:string>>")

    def rebuilt(x: Column, m: Column) -> Column:
        def joined(e: Column) -> Column:
            named = F.filter(F.zip_with(m, e, lambda a, y: F.when(y["type"] == "name", _name_parts(a, y["surrogate"]))), lambda p: p.isNotNull())

            def text(parts: Column) -> Column:
                # the first of a name's surrogates counts: a given name has another ending than a family name
                known = F.filter(parts, lambda p, i: F.array_position(parts["old"], p["old"]) == i + 1)
                plain = F.when(F.size(parts) > 0, let(known, lambda k: F.transform(F.split(x, ANY, -1), lambda s: _untitled(s, k)))).otherwise(F.split(x, ANY, -1))
                return F.array_join(F.zip_with(plain, e, lambda s, y: F.concat(s, F.coalesce(y["surrogate"], F.lit("")))), "")

            return F.struct(e.alias("e"), let(F.flatten(named), text).alias("t"))

        return let(F.transform(m, lambda v: entity(v, key, turns)), joined)

    def found(x: Column) -> Column:
        # most texts have no match and need no second pass
        return let(F.regexp_extract_all(x, F.lit(ANY), F.lit(0)), lambda m: F.when(F.size(m) > 0, rebuilt(x, m)).otherwise(F.struct(none.alias("e"), x.alias("t"))))

    may = t.rlike(r"[0-9@=:]") | t.contains("AKIA") | t.contains("ASIA") | t.rlike(rf"{_TITLE}{_LEAD}\p{{Lu}}")
    return docs.withColumn("__r", F.when(may, let(t, found)).otherwise(F.struct(none.alias("e"), t.alias("t")))).withColumns({text_col: F.col("__r.t"), "entities": F.coalesce(F.col("__r.e"), none)}).drop("__r")


def _pairs(redacted: DataFrame) -> DataFrame:
    """Distinct (type, canon, s) as hashes; s is the surrogate without its format, which must not make two of them equal."""
    bare = lambda c: F.regexp_replace(c, r"[^\p{L}\p{N}@]", "")
    kind, sur = F.col("e.type"), F.col("e.surrogate")
    s = F.when(kind == "phone", F.substring(bare(sur), -10, 10)).when(kind == "secret", F.regexp_replace(sur, "^" + _SECRET_WORD, "")).when(kind.isin("ip", "ip6", "email"), sur).when(kind == "name", _called(sur)).otherwise(bare(sur))
    return redacted.select(F.explode("entities").alias("e")).select("e.type", _id(kind, F.col("e.canon")).alias("canon"), F.xxhash64(s).alias("s")).distinct()


def collisions(redacted: DataFrame) -> DataFrame:
    """Surrogates given to two entities of a type, or entities with two surrogates; both sides compared without their format. Empty if all is well."""
    pairs = _pairs(redacted)
    merged = pairs.groupBy("type", "s").agg(F.count("*").alias("n")).where("n > 1").select("type", F.lit("merged").alias("what"))
    torn = pairs.groupBy("type", "canon").agg(F.count("*").alias("n")).where("n > 1").select("type", F.lit("torn").alias("what"))
    return merged.union(torn)


def _losers(redacted: DataFrame) -> DataFrame:
    """``_id`` of the entities that share a surrogate, without the least of each such group."""
    pairs = _pairs(redacted)
    shared = pairs.groupBy("type", "s").agg(F.min("canon").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    return pairs.join(shared, ["type", "s"]).where("canon <> first").select("canon").distinct()


def surrogates(docs: DataFrame, key: str, text_col: str = "text") -> DataFrame:
    """``redact`` stored once in the shared folder and checked for collisions; an entity that shares its surrogate gets another by a counter.

    Hashes of 60 bits share one about once in 10^9 entities, so the counters are
    few; only the texts with such an entity are redacted again, found by their
    hash, and stored beside the rest.
    """
    base, turns, step = scratch(docs.sparkSession), {}, 0
    mark = F.struct(F.xxhash64(text_col).alias("h"), F.length(text_col).alias("n"))
    marked = docs.withColumn("__mark", mark)
    out = stored(redact(marked, key, text_col), f"{base}/redacted")
    while True:
        bad = collisions(out).distinct().collect()
        if any(r["what"] == "torn" for r in bad):
            raise ValueError(f"entities of one canonical form got two surrogates: {sorted(r['type'] for r in bad if r['what'] == 'torn')}")
        if not bad:
            return out.drop("__mark")
        lost = [r["canon"] for r in _losers(out).collect()]
        for c in lost:
            turns[c] = turns.get(c, 0) + 1
        step += 1
        held = F.exists("entities", lambda e: _id(e["type"], e["canon"]).isin(lost))
        again = stored(out.where(held).select("__mark").distinct(), f"{base}/again{step}")
        redone = stored(redact(marked.join(again, "__mark", "left_semi").select(marked.columns), key, text_col, turns), f"{base}/redacted{step}")
        out = out.join(again, "__mark", "left_anti").select(redone.columns).union(redone)


#: The query's key, no secret.
TEST_KEY = "test-key"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = surrogates(read_table(spark, sf_dir, "documents").select("doc_id", "text"), TEST_KEY)
    return out.select("doc_id", "text", F.size("entities").cast("long").alias("n_entities"), F.array_join(F.transform("entities", lambda e: e["type"]), ",").alias("types"))
