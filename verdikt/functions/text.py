"""Text and identifier expressions (names, schools, divisions, rounds).

Each function takes and returns a Column, so everything stays inside
whole-stage codegen or the built-in higher-order functions.
"""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, functions as F

# Pairing-method names of preliminary and elimination rounds.
PRELIM_TYPES = ["prelim", "highlow", "high-low", "highhigh", "high-high"]
ELIM_TYPES = ["elim", "final", "finals", "runoff"]

# Division and format patterns, tried in this order.
NOVICE = r"(?i)\bnovice\b|\brookie\b"
JV = r"(?i)\bjv\b|\bj\.?v\.?\b|junior\s*varsity"
MIDDLE = r"(?i)\bmiddle\s*school\b|\bms\b|\bmspf\b"
OPEN = r"(?i)\bopen\b|\bvarsity\b|\bvar\b|\btoc\b|\bchampionship\b"
PARLI = r"(?i)\bparli\w*|\bnpda\b|\bpar\b"
PUBLIC_FORUM = r"(?i)\bpf\b|public\s*forum"

# Words that carry no identity in a school's name.
SCHOOL_NOISE = r"\b(high school|high|school|academy|hs|the)\b"

_NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"


def _decomposable() -> tuple[str, str]:
    """Latin letters whose canonical decomposition starts with a plain letter."""
    accented, plain = [], []
    for code in [*range(0x00C0, 0x0250), *range(0x1E00, 0x1F00)]:
        parts = unicodedata.normalize("NFD", chr(code))
        if len(parts) > 1 and parts[0].isascii():
            accented.append(chr(code))
            plain.append(parts[0])
    return "".join(accented), "".join(plain)


_ACCENTED, _PLAIN = _decomposable()


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def fold_accents(c: Column | str) -> Column:
    return F.regexp_replace(F.translate(col(c), _ACCENTED, _PLAIN), "[̀-ͯ]", "")


def norm_id(c: Column | str) -> Column:
    """Ids arrive as numbers or text; empty means absent."""
    return F.nullif(col(c).cast("string"), F.lit(""))


def norm_num(c: Column | str) -> Column:
    text = F.trim(col(c).cast("string"))
    return F.when(text.rlike(_NUMBER), text.try_cast("double"))


def round_kind(c: Column | str) -> Column:
    kind = F.lower(F.coalesce(col(c), F.lit("")))
    return (F.when(kind.isin(PRELIM_TYPES), "prelim")
            .when(kind.isin(ELIM_TYPES), "elim").otherwise("other"))


def _haystack(name: Column | str, abbr: Column | str) -> Column:
    return F.concat_ws(" ", F.coalesce(col(name), F.lit("")), F.coalesce(col(abbr), F.lit("")))


def is_parli(name: Column | str, abbr: Column | str) -> Column:
    hay = _haystack(name, abbr)
    forum_only = hay.rlike(PUBLIC_FORUM) & ~hay.rlike("(?i)parli")
    return hay.rlike(PARLI) & ~forum_only


def classify_division(name: Column | str, abbr: Column | str,
                      override: Column | None = None) -> Column:
    """``override`` is the division joined from an override table, null where there is none."""
    hay = _haystack(name, abbr)
    derived = (F.when(hay.rlike(NOVICE), "novice").when(hay.rlike(JV), "jv")
               .when(hay.rlike(MIDDLE), "middle").when(hay.rlike(OPEN), "open")
               .when(is_parli(name, abbr), "open").otherwise("unknown"))
    return derived if override is None else F.coalesce(override, derived)


def claimed_division(claimed: Column, parli: Column, division: Column) -> Column:
    """An event claimed by an override without being the format is its tournament's open division."""
    known = F.when(division.isin("open", "novice", "jv", "middle"), division).otherwise("unknown")
    return F.when(claimed & ~parli, "open").otherwise(known)


def school_key(c: Column | str) -> Column:
    head = F.element_at(F.split(F.lower(fold_accents(c)), "/"), 1)
    return F.regexp_replace(F.regexp_replace(head, SCHOOL_NOISE, " "), "[^a-z0-9]", "")


def school_id(c: Column | str) -> Column:
    return F.concat(F.lit("sch_"), F.coalesce(F.nullif(school_key(c), F.lit("")), F.lit("unknown")))


def letters(c: Column | str) -> Column:
    return F.regexp_replace(F.lower(fold_accents(F.coalesce(col(c), F.lit("")))), "[^a-z]", "")


surname_key = letters


def norm_name(c: Column | str) -> Column:
    lowered = F.lower(fold_accents(F.coalesce(col(c), F.lit(""))))
    return F.regexp_replace(F.regexp_replace(lowered, r"^[a-z]\.\s*", ""), "[^a-z]", "")


def pair_key(a: Column | str, b: Column | str) -> Column:
    return F.array_join(F.array_sort(F.array(norm_name(a), norm_name(b))), "|")


def team_key(school: Column | str, a: Column | str, b: Column | str) -> Column:
    return F.concat(norm_name(school), F.lit("::"), pair_key(a, b))


def parse_sheet_name(c: Column | str) -> Column:
    """``"C. Vale"`` to struct(initial, surname, raw); the initial is one to three letters."""
    raw = F.trim(col(c))
    pattern = r"^([A-Za-z]{1,3})\.\s*(.+)$"
    has_initial = raw.rlike(pattern)
    return F.struct(
        F.when(has_initial, F.lower(F.regexp_extract(raw, pattern, 1))).alias("initial"),
        F.when(has_initial, letters(F.regexp_extract(raw, pattern, 2)))
        .otherwise(letters(raw)).alias("surname"),
        raw.alias("raw"))


def people_from_label(name: Column | str, code: Column | str) -> Column:
    """People named by an entry label such as ``"School Cara Vale & Rory Hu"``."""
    source = F.when(F.contains(col(name), F.lit("&")), col(name)).otherwise(col(code))
    parts = F.filter(F.transform(F.split(source, "&"), lambda p: F.trim(p)), lambda p: p != "")

    def person(part: Column) -> Column:
        words = F.filter(F.split(part, r"\s+"), lambda w: w != "")
        first = F.when(F.size(words) > 1, F.element_at(words, -2)).otherwise("")
        return F.struct(first.alias("first"), F.element_at(words, -1).alias("last"))

    people = F.transform(parts, person)
    nobody = F.filter(people, lambda p: F.lit(False))
    return F.when(F.contains(source, F.lit("&")), people).otherwise(
        F.when(source.isNull() | ~F.contains(source, F.lit("&")),
               F.coalesce(nobody, F.array().cast("array<struct<first:string,last:string>>"))))


def within_one_edit(a: Column | str, b: Column | str) -> Column:
    """Edit distance of at most one, where an adjacent swap is a single edit."""
    a, b = col(a), col(b)
    swapped = F.exists(
        F.when(F.length(a) > 1, F.sequence(F.lit(1), F.length(a) - 1))
        .otherwise(F.array().cast("array<int>")),
        lambda i: F.concat(F.substr(a, F.lit(1), i - 1), F.substr(a, i + 1, F.lit(1)),
                           F.substr(a, i, F.lit(1)), F.substr(a, i + 2)) == b)
    return (a == b) | (F.levenshtein(a, b) <= 1) | ((F.length(a) == F.length(b)) & swapped)


def edit_distance_within(a: str, b: str, limit: int) -> Column:
    """Optimal-string-alignment distance of two named columns, ``limit + 1`` when beyond it.

    Spark's bounded Levenshtein rejects most pairs first: a swap costs it two,
    so nothing within ``limit`` here is beyond ``2 * limit`` there.
    """
    row = f"""
      aggregate(sequence(1, length({b})), array(i), (cur, j) -> concat(cur, array(least(
        element_at(acc.prev, j + 1) + 1,
        element_at(cur, j) + 1,
        element_at(acc.prev, j) + if(substr({a}, i, 1) = substr({b}, j, 1), 0, 1),
        if(i > 1 and j > 1 and substr({a}, i, 1) = substr({b}, j - 1, 1)
             and substr({a}, i - 1, 1) = substr({b}, j, 1),
           element_at(acc.two, greatest(j - 1, 1)) + 1, 2147483000)))))"""
    table = f"""
      aggregate(sequence(1, length({a})),
        named_struct('prev', sequence(0, length({b})), 'two', sequence(0, length({b}))),
        (acc, i) -> named_struct('prev', {row}, 'two', acc.prev),
        acc -> element_at(acc.prev, length({b}) + 1))"""
    return F.expr(f"""
      case when {a} = {b} then 0
           when levenshtein({a}, {b}, {2 * limit}) < 0 then {limit + 1}
           when length({a}) = 0 or length({b}) = 0
             then least(length({a}) + length({b}), {limit + 1})
           else least({table}, {limit + 1}) end""")


def masked_name(first: Column | str, last: Column | str, suppressed: Column | str) -> Column:
    """First and last name, or null when the person asked not to be named."""
    return F.when(~F.coalesce(col(suppressed), F.lit(False)),
                  F.concat(F.coalesce(F.concat(col(first), F.lit(" ")), F.lit("")), col(last)))


def sender_hash(forwarded: Column | str, real: Column | str, salt: Column | str) -> Column:
    """One-way handle of the first forwarded address; every unknown sender shares one."""
    first = F.nullif(F.trim(F.element_at(F.split(col(forwarded), ","), 1)), F.lit(""))
    address = F.coalesce(first, F.nullif(col(real), F.lit("")), F.lit("unknown"))
    return F.substr(F.sha2(F.concat_ws(":", col(salt), address), 256), F.lit(1), F.lit(32))


def parse_record(c: Column | str, part: int) -> Column:
    """Wins (part 1) or losses (part 2) of a strict ``"w-l"``, null otherwise."""
    pattern = r"^(\d+)\s*-\s*(\d+)$"
    return F.when(col(c).rlike(pattern), F.regexp_extract(col(c), pattern, part).cast("int"))
