"""Text predicates."""

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters that count as blank when a field is trimmed.
BLANK_CHARS = (
    r"\t\n\x0B\f\r \u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF"
)


def is_blank(col: Column) -> Column:
    return ~col.rlike(f"[^{BLANK_CHARS}]")


def substring_pattern(text: str) -> str:
    """The LIKE pattern for "contains text", where % and _ inside the text stay wildcards.

    Spark refuses a backslash in front of an ordinary character; such a pair means the
    character itself, so the backslash goes. A backslash at the end escapes the closing %.
    """
    out, i = [], 0
    while i < len(text):
        ch = text[i]
        if ch == "\\" and i + 1 < len(text):
            following = text[i + 1]
            out.append(ch + following if following in "%_\\" else following)
            i += 2
        else:
            out.append(ch)
            i += 1
    return "%" + "".join(out) + "%"


def matches_text(col: Column, text: str) -> Column:
    return col.ilike(substring_pattern(text))


#: Numbers of trigrams, and the fixed size of a bitmap of Spark's, of which a signature has as many as are not empty.
GRAM_NUMBERS, BITMAP_BITS = 1 << 20, 1 << 15
#: Characters of a text that are cut into trigrams at once.
GRAM_CHUNK = 1 << 16


def literal_runs(pattern: str) -> list[str]:
    """What a LIKE pattern asks for as it stands: the stretches between its wildcards."""
    runs, run, i = [], [], 0
    while i < len(pattern):
        ch = pattern[i]
        if ch == "\\" and i + 1 < len(pattern):
            run.append(pattern[i + 1])
            i += 1
        elif ch in "%_":
            runs.append("".join(run))
            run = []
        else:
            run.append(ch)
        i += 1
    return [text for text in [*runs, "".join(run)] if text]


def chunks(text: Column) -> Column:
    """The pieces of a text whose trigrams are those of the text; long texts give several."""
    starts = F.sequence(F.lit(0), F.floor(F.greatest(F.length(text) - 1, F.lit(0)) / GRAM_CHUNK).cast("int"))
    return F.transform(starts, lambda i: F.substring(text, i * GRAM_CHUNK + 1, F.lit(GRAM_CHUNK + 2)))


def gram_numbers(text: Column) -> Column:
    """The numbers (from 1 to GRAM_NUMBERS) of all runs of three characters of a text; every start is looked at."""
    grams = F.regexp_extract_all(text, F.lit("(?s)(?=(.{3}))"), F.lit(1))
    return F.array_distinct(F.transform(grams, lambda gram: F.pmod(F.xxhash64(gram), F.lit(GRAM_NUMBERS)) + 1))


def has_number(bits: Column, number: int) -> Column:
    """Whether the bitmap that a number belongs to holds it, as 1 or 0."""
    byte, bit = divmod((number - 1) % BITMAP_BITS, 8)
    return F.getbit(F.conv(F.hex(F.substring(bits, byte + 1, 1)), 16, 10).cast("int"), F.lit(bit)).cast("int")


def mask_digits(col: Column) -> Column:
    return F.regexp_replace(col, "[0-9]+", "#")


# Spark's text of a floating point number outside 0.001 to 10 million: one digit before the point.
EXPONENT_FORM = r"^-?[0-9]\.[0-9]+E-?[0-9]+$"


# Plain decimals below a millionth.
SMALL_FORM = r"^-?0\.0{6,}[1-9][0-9]*$"


def small_number(text: Column) -> Column:
    """A plain decimal below a millionth the way scripts write it: with an exponent."""
    zeros = F.length(F.regexp_extract(text, r"\.(0*)", 1))
    digits = F.regexp_replace(F.regexp_extract(text, r"\.0*([1-9][0-9]*)$", 1), "0+$", "")
    tail = F.when(F.length(digits) > 1, F.concat(F.lit("."), F.substring(digits, F.lit(2), F.length(digits)))).otherwise("")
    sign = F.when(text.startswith("-"), "-").otherwise("")
    return F.concat(sign, F.substring(digits, 1, 1), tail, F.lit("e-"), (zeros + 1).cast("string"))


def script_number(text: Column) -> Column:
    """Spark's text of a floating point number as scripts write it: without a needless point, in
    plain digits for exponents from -6 to 20, otherwise with a signed exponent."""
    sign = F.when(text.startswith("-"), "-").otherwise("")
    fraction = F.regexp_replace(F.regexp_extract(text, r"\.([0-9]+)E", 1), "0+$", "")
    digits = F.concat(F.regexp_extract(text, r"^-?([0-9])\.", 1), fraction)
    exponent = F.regexp_extract(text, "E(-?[0-9]+)$", 1).try_cast("int")
    whole = exponent + 1
    large = F.when(F.length(digits) <= whole, F.rpad(digits, whole, F.lit("0"))).otherwise(
        F.concat(F.substring(digits, F.lit(1), whole), F.lit("."), F.substring(digits, whole + 1, F.length(digits)))
    )
    small = F.concat(F.lit("0."), F.repeat(F.lit("0"), -exponent - 1), digits)
    mantissa = F.when(fraction == "", digits).otherwise(
        F.concat(F.substring(digits, 1, 1), F.lit("."), fraction)
    )
    power = F.concat(F.when(exponent > 0, "e+").otherwise("e"), exponent.cast("string"))
    number = (
        F.when((exponent >= 0) & (exponent < 21), large)
        .when((exponent < 0) & (exponent >= -6), small)
        .otherwise(F.concat(mantissa, power))
    )
    return F.when(text.rlike(EXPONENT_FORM), F.concat(sign, number)).otherwise(F.regexp_replace(text, r"\.0$", ""))
