"""Keys, roots and grammars of printed ids, numbers and names, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words left out of a name's root, for the catalogue and for the closed set of names.
CATALOG_SUFFIXES = ["mega", "ex", "v", "vmax", "star", "gx", "stage1", "stage2", "basic"]
CLOSED_SUFFIXES = ["ex", "gx", "v", "vmax", "vstar", "mega", "tera", "stage1", "stage2", "basic", "star"]

# Layout words, and suffixes that are part of names.
LAYOUT_WORDS = [
    "basic", "stage", "stage1", "stage2", "vmax", "vstar", "tera", "evolves", "from", "pokemon", "pokémon", "hp", "len", "duc", "duc9",
    "restored", "ability", "attack", "weakness", "resistance", "retreat", "rule", "when", "your", "the", "form", "evolved", "prize",
]
NAME_SUFFIXES = ["ex", "gx", "vmax", "vstar", "v", "mega"]

# Characters that stand for digits in numeric slots (from, to).
SLOT_FROM, SLOT_TO = "OoQDIl|i!jJ[]Zz+SsB", "0000111111111224558"

# Misread promo prefixes and what they mean.
PREFIX_MEANS = {
    "X0": "XY", "XO": "XY", "XQ": "XY", "XYEN": "XY", "XYE": "XY", "5V": "SV", "S5": "SV", "S50": "SWSH", "550": "SWSH", "5WSH": "SWSH",
    "SW5H": "SWSH", "SWSHEN": "SWSH", "SWSHE": "SWSH", "5VP": "SVP", "SVPE": "SVP", "SVPEM": "SVP", "SVPW": "SVP", "SVPEN": "SVP", "SVPEX": "SVP",
    "SVPI": "SVP", "SVPIH": "SVP", "SVRE": "SVP", "EVPI": "SVP", "EVPE": "SVP", "GVPE": "SVP", "EVPW": "SVP", "SVPR": "SVP", "5VPE": "SVP",
    "5VPEN": "SVP", "SV-P": "SVP", "S-P": "SVP", "EVW": "SVP", "SVW": "SVP", "EVN": "SVP", "SVN": "SVP", "EVP": "SVP", "EV": "SVP", "5M": "SM",
    "SMEN": "SM", "SME": "SM", "8W": "BW", "BWEN": "BW", "BWE": "BW", "HG55": "HGSS", "HGS5": "HGSS", "HSP": "HGSS", "HGSSEN": "HGSS", "DPP": "DP",
    "DPEN": "DP", "PR0M0": "PROMO", "PR": "PROMO",
}

# The grammars of printed ids.
PROMO = r"(?i)(?:^|[^a-zA-Z0-9])(?:[A-Z]\s+)?(SVP|5VP|SVPE|SVPEN|SVPEM|SVPW|SVPI|SVPIH|SVRE|EVPI|EVPE|GVPE|EVPW|EVW|SVW|EVN|SVN|EVP|SWSH|5WSH|SW5H|S50|550|SM|5M|XY|X[0OQ]|BW|8W|HGSS|HG55|DP|DPP|S-P|SV-P|PROMO|PR0M0)(?:[-_\s]*(?:EN|ENG|US|JP|JPN|E|EM|W|EX|e|ex))?[\s\]\)\}:]*([0-9OISBols|!+]{1,4})(?:$|[^a-zA-Z0-9])"
SUBSET = r"(?i)(?:^|[^a-zA-Z0-9/])(TG|GG|SV|RC|CRZ|H|SH|SL|CL)\s*([0-9OISBols|!+]{1,4})\s*(?:[/\\|]|\bof\b)\s*([A-Z]{0,3})\s*([0-9OISBols|!+]{1,4})(?:$|[^a-zA-Z0-9/])"
FRACTION = r"(?i)(?:^|[^a-zA-Z0-9/])([0-9OISBols|!+]{1,4}[a-z]?)\s*(?:[/\\|]|\bof\b|\bOF\b)\s*([0-9OISBols|!+]{1,4}[a-z]?)(?:$|[^a-zA-Z0-9/])"
SUFFIX = r"(?i)\b([A-Z]{1,3}[0-9]{1,4}[a-z])\b"
FALLBACK_SUBSET = r"(?i)\b(TG|GG|SV|RC|CRZ|H|SH|SL|CL)(\d{1,4})\s*/\s*([A-Za-z]{0,3}\d{1,4})\b"
FALLBACK_PROMO = r"(?i)\b(SWSH|SVP|SM|XY|BW|HGSS|DP|S-P|SV-P|PROMO)\s*(\d{2,4})\b"
FALLBACK_FRACTION = r"(\d{1,4})[a-zA-Z]{0,2}\s*/\s*([0-9sSBOIl|]{1,4})"
MISSING_SLASH = r"\b([A-Za-z0-9]{2,5})[7l1I|](\d{2,4})\b"

# Set totals known from the start, misread totals, and totals that one digit may be corrected to.
KNOWN_TOTALS = ["165", "198", "197", "182", "086", "088", "091", "078", "207", "159", "084", "236", "162", "106", "180", "186", "068", "108", "070", "30", "70", "25", "94", "122"]
MISREAD_TOTALS = {
    "056": "086", "066": "086", "56": "086", "66": "086", "090": "086", "055": "086", "085": "086", "065": "086", "058": "086", "059": "086",
    "089": "086", "O86": "086", "0B6": "086", "0S6": "086", "190": "198", "195": "198", "196": "198", "185": "165", "155": "165",
}
TOTAL_TARGETS = ["086", "088", "198", "168", "180", "186", "108", "078", "068"]

# Restricted alphabets, and the characters read as digits there (from, to).
ALPHABETS = {"hp": "0123456789HP hp", "collector_id": "0123456789/ -HPSWVPTGRCMXYBDhpswvptgrcmxybd"}
DIGIT_FROM, DIGIT_TO = "OoQIl|iSsBZzTt", "00011115582277"

ID = "struct<id:string,confidence:double,pattern:string>"


def zfill(s: Column, n: int) -> Column:
    """Zeros in front up to n characters; longer strings stay."""
    return F.when(F.length(s) >= n, s).otherwise(F.lpad(s, n, "0"))


def no_zeros(s: Column) -> Column:
    """Without leading zeros, but "0" for zeros alone."""
    short = F.regexp_replace(s, "^0+", "")
    return F.when(short == "", "0").otherwise(short)


def digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def number_keys(value: Column) -> Column:
    """All keys under which a printed number is found, sorted; none for a missing one."""
    raw = F.upper(F.trim(F.coalesce(value, F.lit(""))))
    d = digits(raw)
    prefix, num = F.regexp_extract(raw, "^([A-Z]+)[-_ ]*([0-9]+)$", 1), F.regexp_extract(raw, "^([A-Z]+)[-_ ]*([0-9]+)$", 2)
    plain = F.array(raw, no_zeros(raw))
    of_digits = F.when(d != "", F.array(d, no_zeros(d), zfill(d, 2), zfill(d, 3))).otherwise(F.array().cast("array<string>"))
    of_prefix = F.when(prefix != "", F.array(*[F.concat(prefix, x) for x in (num, no_zeros(num), zfill(num, 2), zfill(num, 3))])).otherwise(F.array().cast("array<string>"))
    return F.when(raw == "", F.array().cast("array<string>")).otherwise(F.array_sort(F.array_distinct(F.concat(plain, of_digits, of_prefix))))


def number_key(value: Column) -> Column:
    """One key for all of ``number_keys``: two numbers share one of those, or an alias, if and only if this is equal.

    All keys of a number have its digits, and those alone are one of them; a number without digits has
    its text only.
    """
    raw = F.upper(F.trim(F.coalesce(value, F.lit(""))))
    return F.when(digits(raw) != "", no_zeros(digits(raw))).otherwise(F.nullif(raw, F.lit("")))


def alias_keys(set_id: Column, number: Column) -> Column:
    """Further keys of cards in promo and special sets, sorted."""
    s, d = F.lower(set_id), digits(number)
    made = lambda prefixes, *forms: F.array(*[F.concat(F.lit(p), f) for p in prefixes for f in forms])
    keys = (
        F.when(d == "", None)
        .when(s == "svp", made(["SVP", "SV-P", "SV"], d, zfill(d, 3), no_zeros(d)))
        .when(s == "swshp", made(["SWSH", "SWSH-"], d, zfill(d, 3)))
        .when(s == "smp", made(["SM", "SM-"], d, zfill(d, 2), zfill(d, 3)))
        .when(s == "xyp", made(["XY", "XY-"], d, zfill(d, 2), zfill(d, 3)))
        .when(s.endswith("tg"), made(["TG"], zfill(d, 2)))
        .when(s.endswith("gg"), made(["GG"], zfill(d, 2)))
        .when(s.endswith("sv") | (s == "sma"), made(["SV"], zfill(d, 3)))
    )
    return F.array_sort(F.array_distinct(F.coalesce(keys, F.array().cast("array<string>"))))


def _root(name: Column, words: list[str]) -> Column:
    kept = F.filter(F.split(F.trim(name), "\\s+"), lambda w: (w != "") & ~F.lower(w).isin(words))
    return F.when(F.size(kept) > 0, F.array_join(kept, " ")).otherwise(name)


def catalog_root(name: Column) -> Column:
    """A name without suffix words and without anything but letters and white space."""
    return F.trim(F.regexp_replace(_root(name, CATALOG_SUFFIXES), "[^a-zA-Z\\s]", ""))


def clean_key(name: Column) -> Column:
    """A name's comparison key: lower-case letters, digits and white space."""
    return F.trim(F.lower(F.regexp_replace(name, "[^a-zA-Z0-9\\s]", "")))


def closed_root(name: Column) -> Column:
    """The comparison key of a name without the closed set's suffix words."""
    return clean_key(_root(name, CLOSED_SUFFIXES))


def _map(values: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])


def numeric_slot(s: Column) -> Column:
    return F.translate(s, SLOT_FROM, SLOT_TO)


def known_prefix(prefix: Column) -> Column:
    """What a prefix, perhaps misread, means."""
    return F.coalesce(F.try_element_at(_map(PREFIX_MEANS), prefix), prefix)


def _found(chunk: Column, pattern: str, *groups: int) -> Column:
    """Each match's groups, as arrays."""
    lists = [F.regexp_extract_all(chunk, F.lit(pattern), F.lit(g)) for g in groups]
    return F.transform(F.arrays_zip(*[x.alias(f"g{g}") for x, g in zip(lists, groups)]), lambda m: F.array(*[m[f"g{g}"] for g in groups]))


def _id(value: Column, confidence: float, pattern: str) -> Column:
    return F.struct(value.alias("id"), F.lit(confidence).alias("confidence"), F.lit(pattern).alias("pattern"))


def _whole(s: Column) -> Column:
    return s.rlike("^[0-9]+$")


def _between(n: Column, low: int, high: int) -> Column:
    return n.between(low, high)


def _chunk_ids(chunk: Column) -> Column:
    """The ids that the four grammars find in a chunk, in the order of the grammars."""

    def promo(m):
        prefix, num = known_prefix(F.upper(F.get(m, 0))), numeric_slot(F.get(m, 1))
        wide = prefix.isin("SWSH", "SVP") & (F.length(num) <= 2)
        two = prefix.isin("XY", "SM", "BW", "DP", "HGSS") & (F.length(num) == 1)
        padded = F.when(wide, F.lpad(num, 3, "0")).when(two, F.lpad(num, 2, "0")).otherwise(num)
        return F.when(_whole(num) & (num != "0"), _id(F.concat(prefix, padded), 0.98, "promo_prefix"))

    def subset(m):
        one, two = numeric_slot(F.get(m, 1)), numeric_slot(F.get(m, 3))
        ok = _whole(one) & _whole(two) & _between(F.try_to_number(one, F.lit("9999")), 1, 999) & _between(F.try_to_number(two, F.lit("9999")), 10, 999)
        return F.when(ok, _id(F.concat(known_prefix(F.upper(F.get(m, 0))), one, F.lit("/"), known_prefix(F.upper(F.get(m, 2))), two), 0.96, "subset_fraction"))

    def fraction(m):
        one, two = numeric_slot(F.get(m, 0)), numeric_slot(F.get(m, 1))
        two = F.when(two.isin("055", "056"), "086").otherwise(two)
        form = "(?i)^[0-9]{1,4}[a-z]?$"
        ok = one.rlike(form) & two.rlike(form) & _between(digits(one).try_cast("int"), 1, 999) & _between(digits(two).try_cast("int"), 10, 999)
        return F.when(ok, _id(F.concat(F.upper(one), F.lit("/"), F.upper(two)), 0.95, "standard_fraction"))

    lists = [
        F.transform(_found(chunk, PROMO, 1, 2), promo),
        F.transform(_found(chunk, SUBSET, 1, 2, 3, 4), subset),
        F.transform(_found(chunk, FRACTION, 1, 2), fraction),
        F.transform(_found(chunk, SUFFIX, 1), lambda m: _id(F.upper(F.get(m, 0)), 0.88, "suffix_id")),
    ]
    return F.concat(*[F.filter(x.cast(f"array<{ID}>"), lambda i: i.isNotNull()) for x in lists])


def _best(ids: Column, by: str) -> Column:
    """The first of the entries with the largest field ``by``."""
    return F.aggregate(ids, F.get(ids, 0), lambda best, x: F.when(x[by] > best[by], x).otherwise(best))


def chunks(text: Column) -> Column:
    """Lines that aren't blank, neighbouring lines joined, and all of them joined."""
    lines = F.filter(F.transform(F.split(text, "\n"), lambda s: F.trim(s)), lambda s: s != "")
    pairs = F.when(F.size(lines) > 1, F.transform(F.sequence(F.lit(0), F.size(lines) - 2), lambda i: F.concat(F.get(lines, i), F.lit(" "), F.get(lines, i + 1))))
    whole = F.when(F.size(lines) > 1, F.array(F.array_join(lines, " ")))
    none = F.array().cast("array<string>")
    return F.concat(lines, F.coalesce(pairs, none), F.coalesce(whole, none))


def printed_id(text: Column) -> Column:
    """Struct (id, confidence, pattern) of the most trusted id in a text; the first of equals."""
    found = F.flatten(F.transform(chunks(text), _chunk_ids))
    none = lambda why: F.struct(F.lit(None).cast("string").alias("id"), F.lit(0.0).alias("confidence"), F.lit(why).alias("pattern"))
    return F.when(F.coalesce(text, F.lit("")) == "", none("empty_text")).otherwise(F.coalesce(_best(found, "confidence"), none("no_match")))


def hp(text: Column) -> Column:
    """Hit points in a text: a multiple of ten next to HP, else within digits, else a whole number."""
    good = lambda low: lambda v: v.between(low, 400) & (v % 10 == 0)
    ints = lambda pattern: F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), lambda s: s.try_cast("int"))
    numbers = F.regexp_extract_all(text, F.lit("([0-9]+)"), F.lit(1))
    windows = F.flatten(F.transform(F.filter(numbers, lambda s: F.length(s) >= 3), lambda s: F.transform(F.sequence(F.lit(1), F.length(s) - 2), lambda i: F.substring(s, i, F.lit(3)).try_cast("int"))))
    choices = [F.filter(ints(r"(?i)([0-9]{2,3})\s*HP\b"), good(30)), F.filter(ints(r"(?i)\bHP\s*([0-9]{2,3})"), good(30)), F.filter(windows, good(100)), F.filter(ints("([0-9]+)"), good(30))]
    return F.coalesce(*[F.get(c, 0) for c in choices])


def _known(total: Column, catalogue: Column | None) -> Column:
    """Whether a total is known from the start, or one of the catalogue's (an array of strings)."""
    known = total.isin(KNOWN_TOTALS)
    return known if catalogue is None else known | F.coalesce(F.array_contains(catalogue, total), F.lit(False))


def set_total(total: Column, catalogue: Column | None = None) -> Column:
    """A set total with misread digits corrected; totals that are known, from the start or from the catalogue, stay."""
    tries = F.transform(
        F.sequence(F.lit(1), F.greatest(F.length(total), F.lit(1))),
        lambda i: F.when(F.substring(total, i, F.lit(1)).isin("0", "5", "6", "9"), F.concat(F.substring(total, F.lit(1), i - 1), F.lit("8"), F.substring(total, i + 1, F.length(total)))),
    )
    return F.when(_known(total, catalogue), total).otherwise(F.coalesce(F.try_element_at(_map(MISREAD_TOTALS), total), F.get(F.filter(tries, lambda t: t.isin(TOTAL_TARGETS)), 0), total))


def with_slash(text: Column) -> Column:
    """Restores a slash that was read as a character like it."""
    return F.when(text.contains("/"), text).otherwise(F.regexp_replace(text, MISSING_SLASH, "$1/$2"))


def restricted(text: Column, field: str) -> Column:
    """Characters of the field's alphabet, misread digits corrected; what is outside it is dropped."""
    letters = F.filter(F.transform(F.sequence(F.lit(1), F.length(text)), lambda i: F.substring(text, i, F.lit(1))), lambda c: c != "")
    alphabet = F.lit(ALPHABETS[field])
    fixed = lambda c: F.translate(c, DIGIT_FROM, DIGIT_TO)
    kept = F.filter(letters, lambda c: F.contains(alphabet, fixed(c)) | F.contains(alphabet, c))
    return F.when(F.length(text) == 0, "").otherwise(F.array_join(F.transform(kept, fixed), ""))


def _fraction_number(s: Column) -> Column:
    """Misread digits of a fraction's half, unless its prefix explains them."""
    starts = lambda *p: F.lit(False) if not p else F.array_contains(F.array(*[s.startswith(x) for x in p]), True)
    s5 = F.when(starts("SWSH", "SV", "SM"), s).otherwise(F.translate(s, "sS", "55"))
    b8 = F.when(s.startswith("BW"), s5).otherwise(F.translate(s5, "B", "8"))
    o0 = F.when(starts("PROMO", "TG", "GG"), b8).otherwise(F.translate(b8, "Oo", "00"))
    return F.when(starts("TG", "GG", "RC", "SV", "SWSH", "SVP"), o0).otherwise(F.translate(o0, "Il|", "111"))


def fraction_score(number: Column, total: Column, catalogue: Column | None = None) -> Column:
    """How plausible a fraction is as a printed id, up to 105."""
    n, t = F.coalesce(digits(number).try_cast("int"), F.lit(0)), F.coalesce(digits(total).try_cast("int"), F.lit(0))
    points = [(t.between(20, 800), 40.0), (n.between(1, 999), 20.0), ((n > t) & (t >= 30), 25.0), (_known(total, catalogue), 20.0)]
    return sum((F.when(ok, p).otherwise(0.0) for ok, p in points), F.lit(0.0))


def collector_id(text: Column, catalogue: Column | None = None) -> Column:
    """The id by the grammars, else by looser fallback rules; null if none fits. ``catalogue`` is an array of its set totals."""
    fixed = with_slash(text)
    scored = lambda i, s: F.struct(i.alias("id"), s.cast("double").alias("score"))

    def fraction(m):
        one, two = _fraction_number(F.get(m, 0)), _fraction_number(F.get(m, 1))
        ok = _whole(one) & _whole(two) & one.try_cast("int").between(1, 999) & two.try_cast("int").between(10, 999)
        total = set_total(two, catalogue)
        number = F.when(one.rlike("^4[0-9]{2}$"), F.concat(F.lit("1"), F.substring(one, 2, 2))).otherwise(one)
        return F.when(ok, scored(F.concat(number, F.lit("/"), total), fraction_score(number, total, catalogue)))

    lists = [
        F.transform(_found(fixed, FALLBACK_SUBSET, 1, 2, 3), lambda m: scored(F.concat(F.upper(F.get(m, 0)), F.get(m, 1), F.lit("/"), F.upper(F.get(m, 2))), F.lit(90.0))),
        F.transform(_found(fixed, FALLBACK_PROMO, 1, 2), lambda m: scored(F.concat(F.upper(F.get(m, 0)), F.get(m, 1)), F.lit(95.0))),
        F.transform(_found(fixed, FALLBACK_FRACTION, 1, 2), fraction),
    ]
    found = F.concat(*[F.filter(x.cast("array<struct<id:string,score:double>>"), lambda i: i.isNotNull()) for x in lists])
    return F.coalesce(printed_id(text)["id"], _best(found, "score")["id"])


def name_token(text: Column) -> Column:
    """A token of a name: no trailing signs, a misread "ex" set apart, no stray capital at the end."""
    s = F.regexp_replace(F.trim(text), "[^a-zA-Z0-9]+$", "")
    s = F.when(s.rlike("[eE3@][xX]$"), F.regexp_replace(s, r"^(.*?)(?:[@\*\s]?[eE3@][xX])$", "$1 ex")).otherwise(s)
    s = F.regexp_replace(s, "([a-z])[A-Z]$", "$1")
    return F.trim(F.regexp_replace(s, r"[^a-zA-Z\s'-]", ""))


def plausible(token: Column) -> Column:
    """Whether a token can be part of a name: two characters, not one repeated, with a vowel."""
    return (F.length(token) >= 2) & ~token.rlike(r"(?i)^(.)\1+$") & token.rlike("(?i)[aeiouy]")


def names_something(token: Column) -> Column:
    """Whether a token is plausible and no layout word, suffixes of names excepted."""
    low = F.lower(F.trim(token))
    return plausible(token) & (~low.isin(LAYOUT_WORDS) | low.isin(NAME_SUFFIXES))
