"""Format-preserving pseudonyms for personal numbers, dates and mail addresses.

A value that passes its check (Luhn, mod 97, calendar, number plan, octets) is
replaced by another valid value of the same format: its parts are permuted by a
keyed Feistel network over mixed moduli, so the map is one to one and the same
value gets the same pseudonym in every document.  Punctuation, case and lengths
stay; check digits are computed anew.

Everything is one projection of SQL expressions: texts without a hit are passed
on after one regular-expression test, nothing is shuffled.

Defined results: a NULL text stays NULL.  Values that fail their check stay as
they are.  An IBAN has the length of its country, whatever follows it.  Slashed and dotted dates are read day first, and month first only if
that gives no date.  Dates outside 1800-2199 stay.  A text of any length is
searched whole.  Repeated rows get the same text; other columns pass through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditrank.llm.frames import unused

#: Stands for a secret of the user.
DEMO_KEY = "demo key, replace"
ROUNDS = 8

_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
#: Length of an IBAN by country: the registry, and countries that use one without it.
IBAN_LENGTHS = {
    15: "NO",
    16: "BE",
    18: "DK FI FK FO GL NL SD",
    19: "MK SI",
    20: "AT BA EE KZ LT LU MN XK",
    21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA",
    23: "AE GI IL IQ OM SO TL",
    24: "AD CZ ES MD PK RO SA SE SK TN VG",
    25: "AO CV GW LY MZ PT ST",
    26: "DZ IR IS TR",
    27: "BI CF CG CM DJ FR GA GQ GR IT KM MC MG SM TD",
    28: "AL AZ BF BJ BY CI CY DO GT HN HU LB MA ML NE NI PL SN SV TG",
    29: "BR EG PS QA UA",
    30: "JO KW MU YE",
    31: "MT SC",
    32: "LC",
    33: "RU",
}
_IBAN_OF = "|".join(
    rf"(?:{countries.replace(' ', '|')})[0-9]{{2}}(?: ?[A-Z0-9]){{{length - 4}}}" for length, countries in IBAN_LENGTHS.items()
)
_ASSIGNED = "|".join(IBAN_LENGTHS.values()).replace(" ", "|")
#: Formats in the order in which they are tried at a place of the text.
FORMATS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}@(?:[A-Za-z0-9-]{1,63}\.){1,8}[A-Za-z]{2,24}(?![A-Za-z0-9-])",
    "ip": rf"(?<![0-9.A-Za-z])(?:{_OCTET}\.){{3}}{_OCTET}(?![0-9A-Za-z]|\.[0-9])",
    "iso_date": r"(?<![0-9A-Za-z-])[0-9]{4}-[0-9]{2}-[0-9]{2}(?![0-9A-Za-z]|-[0-9])",
    "date": r"(?<![0-9A-Za-z/.])[0-9]{2}(?<mark>[/.])[0-9]{2}\k<mark>[0-9]{4}(?![0-9A-Za-z]|[/.][0-9])",
    "ssn": r"(?<![0-9A-Za-z-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9A-Za-z]|-[0-9])",
    "phone": r"(?<![0-9A-Za-z+(-])(?:\+?1[ .-]?)?(?:\([0-9]{3}\)[ ]?|[0-9]{3}[ .-])[0-9]{3}[ .-]?[0-9]{4}(?![0-9A-Za-z]|-[0-9])",
    "card": r"(?<![0-9A-Za-z.+-])(?:[0-9]{13,19}|[0-9]{4}(?<gap>[ -])(?:[0-9]{4}\k<gap>[0-9]{4}\k<gap>[0-9]{4}|[0-9]{6}\k<gap>[0-9]{5}))(?![0-9A-Za-z]|[-.][0-9])",
    # Other countries take all that may belong to the number, up to the next IBAN.
    "iban": rf"(?<![0-9A-Za-z])(?:{_IBAN_OF}|(?!{_ASSIGNED})[A-Z]{{2}}[0-9]{{2}}(?:(?! (?:{_IBAN_OF})(?![0-9A-Za-z])) ?[A-Z0-9]){{11,30}})(?![0-9A-Za-z])",
}


def _let(value: str, name: str, body: str) -> str:
    """``body`` with ``name`` standing for ``value``, evaluated once."""
    return f"transform(array({value}), {name} -> {body})[0]"


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _feistel(parts: str, moduli: str, kind: str, key: str) -> str:
    """Parts of a value, one half in turn moved by a keyed hash of the other."""
    other = "array_join(transform(filter(a, (y, j) -> (2 * j < size(a)) != (2 * i < size(a))), y -> cast(y AS string)), ',')"
    hashed = (
        f"sha2(concat({_quoted(f'{key}|{kind}|')}, cast(r AS string), '|', cast(i AS string), '|', {other}), 256)"
    )
    moved = f"pmod(x + cast(conv(substring({hashed}, 1, 15), 16, 10) AS bigint), {moduli})"
    return (
        f"aggregate(sequence(0, {ROUNDS - 1}), {parts}, (a, r) -> "
        f"transform(a, (x, i) -> if((2 * i < size(a)) = (r % 2 = 0), {moved}, x)))"
    )


def _chars(text: str, kind: str) -> str:
    return f"filter(split({text}, ''), c -> c rlike '^{kind}$')"


def _refilled(text: str, chars: str, kind: str) -> str:
    """``text`` with its characters of a kind replaced in order, case kept."""
    put = "if(c rlike '^[A-Z]$', upper(n[a.i]), n[a.i])"
    walk = (
        f"aggregate(split({text}, ''), named_struct('o', '', 'i', 0), (a, c) -> if(c rlike '^{kind}$', "
        f"named_struct('o', concat(a.o, {put}), 'i', a.i + 1), named_struct('o', concat(a.o, c), 'i', a.i)), a -> a.o)"
    )
    return _let(chars, "n", walk)


_STRINGS = "transform({0}, v -> cast(v AS string))"


def _luhn(digits: str, doubled: int) -> str:
    """Luhn sum; ``doubled`` is 1 with the check digit in place, 0 without."""
    weigh = f"if(k % 2 = {doubled}, if(d > 4, 2 * d - 9, 2 * d), d)"
    return f"aggregate(transform(reverse({digits}), (d, k) -> {weigh}), 0L, (s, d) -> s + d)"


def _card(h: str, key: str) -> str:
    inner = _feistel("slice(d, 2, size(d) - 2)", "10", "card", key)
    head = f"concat(array(d[0]), {inner})"
    whole = _let(head, "p", f"concat(p, array(pmod(10 - {_luhn('p', 0)}, 10)))")
    new = _refilled(h, _STRINGS.format(whole), "[0-9]")
    digits = f"transform({_chars(h, '[0-9]')}, c -> cast(c AS bigint))"
    return _let(digits, "d", f"if({_luhn('d', 1)} % 10 = 0 AND exists(d, z -> z != 0), {new}, {h})")


def _ip(h: str, key: str) -> str:
    parts = f"transform(split({h}, '[.]'), c -> cast(c AS bigint))"
    return f"array_join({_STRINGS.format(_feistel(parts, '256', 'ip', key))}, '.')"


def _ssn(h: str, key: str) -> str:
    # Areas 001-899 without 666, groups 01-99, serials 0001-9999, each from 0.
    s = f"transform(split({h}, '-'), c -> cast(c AS bigint))"
    parts = _let(s, "s", "array(s[0] - if(s[0] > 666, 2, 1), s[1] - 1, s[2] - 1)")
    moved = _feistel(parts, "array(898L, 99L, 9999L)[i]", "ssn", key)
    area = "p[0] + if(p[0] + 1 >= 666, 2, 1)"
    shown = f"concat(lpad(cast({area} AS string), 3, '0'), '-', lpad(cast(p[1] + 1 AS string), 2, '0'), '-', lpad(cast(p[2] + 1 AS string), 4, '0'))"
    return _let(moved, "p", shown)


def _phone(h: str, key: str) -> str:
    digits = f"array_join({_chars(h, '[0-9]')}, '')"
    parts = (
        "array(cast(substring(d, -10, 3) AS bigint), cast(substring(d, -7, 3) AS bigint), "
        "cast(substring(d, -4, 4) AS bigint))"
    )
    moved = _feistel(parts, "array(1000L, 1000L, 10000L)[i]", "phone", key)
    shown = (
        "concat(substring(d, 1, length(d) - 10), lpad(cast(p[0] AS string), 3, '0'), lpad(cast(p[1] AS string), 3, '0'), "
        "lpad(cast(p[2] AS string), 4, '0'))"
    )
    return _let(digits, "d", _let(moved, "p", _refilled(h, f"split({shown}, '')", "[0-9]")))


def _date(h: str, key: str, shapes: list[str]) -> str:
    """400 years of the calendar are 146,097 days, 27 times 5,411."""
    days = "datediff(t, date'1800-01-01')"
    moved = _feistel(f"array(cast({days} AS bigint) div 5411, cast({days} AS bigint) % 5411)", "array(27L, 5411L)[i]", "date", key)
    out = h
    for shape in reversed(shapes):
        new = f"date_format(date_add(date'1800-01-01', cast({_let(moved, 'p', 'p[0] * 5411 + p[1]')} AS int)), '{shape}')"
        read = f"try_to_date({h}, '{shape}')"
        out = _let(read, "t", f"CASE WHEN {days} BETWEEN 0 AND 146096 THEN {new} ELSE {out} END")
    return out


def _mod97(text: str) -> str:
    step = "if(c rlike '^[0-9]$', (s * 10 + ascii(c) - 48) % 97, (s * 100 + ascii(c) - 55) % 97)"
    return f"aggregate({_chars(text, '[A-Z0-9]')}, 0L, (s, c) -> {step})"


def _letters_and_digits(chars: str, kind: str, key: str) -> str:
    """Lower-case characters permuted, letters among letters and digits among digits."""
    parts = "transform(l, c -> cast(if(c rlike '^[0-9]$', ascii(c) - 48, ascii(c) - 97) AS bigint))"
    moved = _feistel(parts, "if(l[i] rlike '^[0-9]$', 10L, 26L)", kind, key)
    shown = "transform(p, (v, k) -> if(l[k] rlike '^[0-9]$', cast(v AS string), char(97 + v)))"
    return _let(chars, "l", _let(moved, "p", shown))


def _iban(h: str, key: str) -> str:
    own = f"substring(array_join({_chars(h, '[A-Z0-9]')}, ''), 5)"
    country = f"substring({h}, 1, 2)"
    moved = _letters_and_digits(f"{_chars(f'lower({own})', '[a-z0-9]')}", "iban", key)
    check = f"lpad(cast(98 - {_mod97(f'concat(b, {country}, {_quoted("00")})')} AS string), 2, '0')"
    compact = _let(f"upper(array_join({moved}, ''))", "b", f"concat({country}, {check}, b)")
    new = _refilled(h, f"split({compact}, '')", "[A-Z0-9]")
    return f"if({_mod97(f'concat({own}, substring({h}, 1, 4))')} = 1, {new}, {h})"


def _email(h: str, key: str) -> str:
    local = f"substring_index({h}, '@', 1)"
    moved = _letters_and_digits(_chars(f"lower({local})", "[a-z0-9]"), "email", key)
    return f"concat({_refilled(local, moved, '[A-Za-z0-9]')}, '@', substring_index({h}, '@', -1))"


def _pseudonym(h: str, key: str) -> str:
    makers = {
        "email": _email(h, key),
        "ip": _ip(h, key),
        "iso_date": _date(h, key, ["yyyy-MM-dd"]),
        "date": f"if({h} rlike '/', {_date(h, key, ['dd/MM/yyyy', 'MM/dd/yyyy'])}, {_date(h, key, ['dd.MM.yyyy', 'MM.dd.yyyy'])})",
        "ssn": _ssn(h, key),
        "phone": _phone(h, key),
        "card": _card(h, key),
        "iban": _iban(h, key),
    }
    cases = " ".join(f"WHEN {h} rlike {_quoted(f'^(?:{FORMATS[kind]})$')} THEN {makers[kind]}" for kind in FORMATS)
    return f"CASE {cases} ELSE {h} END"


def pseudonymised(docs: DataFrame, key: str = DEMO_KEY, count: str = "n_replaced") -> DataFrame:
    """``docs`` with pseudonyms in ``text``, plus ``count`` long, the values
    replaced.  A column of that name is replaced."""
    docs = docs.drop(count)
    hits, new = unused(docs, "_hits", "_new")
    pattern = _quoted("|".join(FORMATS.values()))
    found = f"CASE WHEN text rlike {pattern} THEN regexp_extract_all(text, {pattern}, 0) END"
    changed = f"size(filter(zip_with(`{hits}`, `{new}`, (a, b) -> a != b), x -> x))"
    joined = f"array_join(zip_with(split(text, {pattern}, -1), `{new}`, (s, h) -> concat(s, coalesce(h, ''))), '')"
    return (
        docs.withColumn(hits, F.expr(found))
        .withColumn(new, F.expr(f"transform(`{hits}`, h -> {_pseudonym('h', key)})"))
        .select(
            *[
                F.expr(f"CASE WHEN `{hits}` IS NULL THEN text ELSE {joined} END").alias("text") if c == "text" else F.col(f"`{c}`")
                for c in docs.columns
            ],
            F.expr(f"cast(CASE WHEN `{hits}` IS NULL THEN 0 ELSE {changed} END AS bigint)").alias(count),
        )
    )


def report(docs: DataFrame, key: str = DEMO_KEY) -> DataFrame:
    """(doc_id, text, n_replaced) of every document."""
    return pseudonymised(docs.select("doc_id", "text"), key)
