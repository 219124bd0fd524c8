"""Money, dates and labels as Column expressions; nothing here needs Python workers."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space of statement text, wider than \s of Java: no-break and typographic blanks and the byte order mark too.
#: The wide ones stand behind one range, so that a common character costs two looks and not one for each of them.
WS = r"[\t-\r [\u00a0-\ufeff&&[\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff]]]"
#: The same without the line end.
BLANK = WS.replace(r"\t-\r", r"\t\x0b-\r")
_BLANKS = "\t\n\x0b\f\r \u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000\ufeff"
#: A sign of a number with blanks inside.
DIGIT = rf"[\d,{WS[1:]}"
MONEY = "decimal(18,2)"
CURRENCY = "ZAR"

_NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
#: Month names in order; a bank date is known by the first three letters.
MONTHS = ["january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december"]


def let(x: Column, use: Callable[[Column], Column]) -> Column:
    """use(x) with x computed once, however often use names it. A fold over nothing: it binds x and copies neither x nor the result."""
    return F.aggregate(F.array(), x, lambda v, _: v, lambda v: use(v))


def trim(x: Column) -> Column:
    return F.btrim(x, F.lit(_BLANKS))


def collapse(x: Column) -> Column:
    """Runs of white space as single blanks, none at the ends."""
    return trim(F.regexp_replace(x, f"{WS}+", " "))


#: Blanks that aren't a single plain one.
_RUN = f" {BLANK}++|{BLANK.replace(chr(92) + 'r ', chr(92) + 'r')}{BLANK}*+"


def collapse_lines(x: Column) -> Column:
    """Runs of white space within lines as single blanks. Most texts have no blanks but plain ones."""
    odd = lambda t: reduce(or_, [F.contains(t, F.lit(c)) for c in "\t\x0b\f\r"], F.octet_length(t) != F.char_length(t))
    return let(x, lambda t: F.when(odd(t), F.regexp_replace(t, _RUN, " ")).otherwise(F.regexp_replace(t, "  +", " ")))


def present(x: Column) -> Column:
    """Null instead of the empty string."""
    return let(x, lambda v: F.when(v != "", v))


def group(x: Column, pattern: str, k: int = 1) -> Column:
    """Group k of the first match; null where nothing matches or the group took no part or is empty."""
    return present(F.regexp_extract(x, pattern, k))


def round_money(x: Column) -> Column:
    """Double to cents, halves upwards."""
    return F.floor((x + F.lit(2.220446049250313e-16)) * 100 + 0.5) / F.lit(100.0)


def _value(n: Column) -> Column:
    return F.when(n == "", F.lit(0.0)).when(n.rlike(_NUMBER), n.try_cast("double"))


def _amount(x: Column, read: Callable[[Column], Column]) -> Column:
    """read of the text without R or ZAR, blanks and commas; in brackets negative."""
    signed = lambda b: F.when(b.rlike(r"^\(.+\)$"), -let(F.substring(b, F.lit(2), F.length(b) - 2), read)).otherwise(let(b, read))
    return let(F.regexp_replace(x, rf"(?i)[R,{WS[1:-1]}]|ZAR", ""), signed)


def parse_money(x: Column) -> Column:
    """Amount of text with R or ZAR, blanks and commas; in brackets negative; empty is 0; null where it isn't a number, or one
    of more than 16 digits before the point, which money has no room for."""
    return _amount(x, lambda n: round_money(_value(n)).try_cast(MONEY)).cast(MONEY)


def parse_number(x: Column) -> Column:
    """As parse_money, as a double of any size that isn't rounded."""
    return _amount(x, _value)


def money_fault(x: Column) -> Column:
    """What is wrong with a text that isn't an amount."""
    return F.concat(F.lit("Invalid money amount: "), x)


def money_error(x: Column) -> Column:
    return let(x, lambda v: F.when(v.isNotNull() & parse_money(v).isNull(), money_fault(v)))


_SIGNED = f"(?is)^(.+?){WS}*(Cr|Dr)$"


def unsigned(x: Column) -> Column:
    """Without Cr or Dr at the end."""
    return let(x, lambda v: F.coalesce(group(trim(v), _SIGNED), v))


def sign_of(x: Column) -> Column:
    """cr or dr at the end, else null."""
    return F.lower(group(trim(x), _SIGNED, 2))


def by_sign(amount: Column, sign: Column) -> Column:
    """cr is positive, dr negative, neither as written."""
    return F.when(sign == "dr", -F.abs(amount)).when(sign == "cr", F.abs(amount)).otherwise(amount).cast(MONEY)


def paid_out(amount: Column, sign: Column) -> Column:
    """cr is positive; all else is money out."""
    return F.when(sign == "cr", F.abs(amount)).otherwise(-F.abs(amount)).cast(MONEY)


def _signed(x: Column, rule: Callable[[Column, Column], Column]) -> Column:
    return let(x, lambda v: let(parse_money(unsigned(v)), lambda amount: let(sign_of(v), lambda s: rule(amount, s))))


def parse_signed_money(x: Column) -> Column:
    """Cr is positive, Dr negative, neither as written."""
    return _signed(x, by_sign)


def signed_money_error(x: Column) -> Column:
    return money_error(unsigned(x))


def parse_transaction_amount(x: Column) -> Column:
    """Cr is positive; all else is money out."""
    return _signed(x, paid_out)


def amounts_equal(a: Column, b: Column) -> Column:
    """Less than a cent apart as doubles. Two amounts one cent apart can count as equal: 1000.01 - 1000.00 is less than 0.01
    in binary, and results have to agree with that."""
    return F.abs(a.cast("double") - b.cast("double")) < 0.01


def plain_number(x: Column) -> Column:
    """Money as text without needless zeros: 300, -4.5, 0."""
    text = F.regexp_replace(F.regexp_replace(x.cast(MONEY).cast("string"), r"(\.\d*?)0+$", "$1"), r"\.$", "")
    return let(text, lambda t: F.when(t == "-0", F.lit("0")).otherwise(t))


def short_month(name: Column) -> Column:
    at = F.array_position(F.array(*[F.lit(m[:3]) for m in MONTHS]), F.left(F.lower(name), F.lit(3)))
    return let(at, lambda k: F.when(k > 0, F.lpad(k.cast("string"), 2, "0")))


def parse_date(x: Column) -> Column:
    """yyyy-mm-dd or dd/mm/yyyy as yyyy-mm-dd; only the shape is checked; else null."""
    turned = lambda t: F.concat_ws("-", F.substring(t, 7, 4), F.substring(t, 4, 2), F.substring(t, 1, 2))
    return let(trim(x), lambda t: F.when(t.rlike(r"^\d{4}-\d{2}-\d{2}$"), t).when(t.rlike(r"^\d{2}/\d{2}/\d{4}$"), turned(t)))


def date_error(x: Column) -> Column:
    return let(x, lambda v: F.when(v.isNotNull() & parse_date(v).isNull(), F.concat(F.lit("Invalid date: "), v)))


_NAMED_DAY = rf"^(\d{{1,2}}){WS}+([A-Za-z]+){WS}+(\d{{4}})$"


def parse_bank_date(x: Column) -> Column:
    """As parse_date, and d Month yyyy with any month name that starts with the three letters."""
    named = lambda t: F.concat(group(t, _NAMED_DAY, 3), F.lit("-"), short_month(group(t, _NAMED_DAY, 2)), F.lit("-"), F.lpad(group(t, _NAMED_DAY, 1), 2, "0"))
    return let(trim(x), lambda t: F.coalesce(parse_date(t), F.when(t.rlike(_NAMED_DAY), named(t))))


def bank_date_fault(x: Column) -> Column:
    """What is wrong with a text that isn't a date."""
    return F.coalesce(F.concat(F.lit("Invalid month: "), group(trim(x), _NAMED_DAY, 2)), F.concat(F.lit("Invalid date: "), x))


def bank_date_error(x: Column) -> Column:
    return let(x, lambda v: F.when(v.isNotNull() & parse_bank_date(v).isNull(), bank_date_fault(v)))


def date_in_period(x: Column, first: Column, last: Column) -> Column:
    """dd Mon in the year of the period that puts it inside, else in the last year."""
    of = lambda end, tail: F.concat(F.left(end, F.lit(4)), F.lit("-"), tail)
    tail = F.concat(short_month(F.regexp_extract(x, r"([A-Za-z]+)$", 1)), F.lit("-"), F.lpad(F.regexp_extract(x, r"^(\d{1,2})", 1), 2, "0"))
    return let(tail, lambda t: F.when(of(first, t).between(first, last), of(first, t)).otherwise(of(last, t)))


_RANGE = f"(?i)^(.+?){WS}+(?:to|-){WS}+(.+)$"


def range_parts(x: Column) -> tuple[Column, Column]:
    """The two sides of 'a to b' or 'a - b'."""
    return group(x, _RANGE, 1), group(x, _RANGE, 2)


_YEAR_MONTH, _MONTH_YEAR = r"^(\d{4})/(\d{2})(?:/\d{2})?$", rf"^([A-Za-z]+){WS}+(\d{{4}})$"


#: Month names in slots of equal width.
_SLOTS, _WIDE = "".join(f"|{m:.<10}" for m in MONTHS), 11


def parse_month(x: Column) -> Column:
    """First day of yyyy/mm, yyyy/mm/dd or Month yyyy with the full name, as a date; else null."""
    at = lambda t: F.instr(F.lit(_SLOTS), F.concat(F.lit("|"), F.lower(group(t, _MONTH_YEAR, 1)), F.lit(".")))
    numeric = lambda t: F.regexp_replace(t, _YEAR_MONTH, "$1-$2-01")
    named = lambda t: let(at(t), lambda k: F.when(k > 0, F.concat(group(t, _MONTH_YEAR, 2), F.lit("-"), F.lpad(((k + _WIDE - 1) / _WIDE).cast("int").cast("string"), 2, "0"), F.lit("-01"))))
    return let(trim(x), lambda t: F.when(t.rlike(_YEAR_MONTH), numeric(t)).otherwise(named(t)).try_cast("date"))


def month_fault(x: Column) -> Column:
    """What is wrong with a text that isn't a month."""
    return let(x, lambda v: F.coalesce(F.concat(F.lit("Invalid month: "), group(trim(v), _MONTH_YEAR, 1)), F.concat(F.lit("Invalid statement month: "), v)))


def month_error(x: Column) -> Column:
    return let(x, lambda v: F.when(v.isNotNull() & parse_month(v).isNull(), month_fault(v)))


def first_day(month: Column) -> Column:
    return F.date_format(month, "yyyy-MM-dd")


def last_day(month: Column) -> Column:
    return F.date_format(F.last_day(month), "yyyy-MM-dd")


def inline_date(x: Column) -> Column:
    """yyyy/mm/dd, yyyy-mm-dd or dd/mm/yyyy."""
    return parse_date(let(x, lambda v: F.when(v.rlike(r"^\d{4}/"), F.replace(v, F.lit("/"), F.lit("-"))).otherwise(v)))


_MONEY_IN = rf"(?i)((?:R|ZAR)?{WS}*(?:\({WS}*{DIGIT}+\.\d{{2}}{WS}*\)|-{WS}*{DIGIT}+\.\d{{2}}|{DIGIT}+\.\d{{2}}))"
_MONEY_END = rf"(?i)((?:R|ZAR)?{WS}*(?:\({WS}*[\d,]+\.\d{{2}}{WS}*\)|-{WS}*[\d,]+\.\d{{2}}|[\d,]+\.\d{{2}}){WS}*)$"


def first_money_text(x: Column) -> Column:
    return let(x, lambda v: F.when(F.contains(v, F.lit(".")), group(trim(v), _MONEY_IN)))  # most lines have no amount


def first_money(x: Column) -> Column:
    """The first amount in a line; blanks may stand inside it."""
    return parse_money(first_money_text(x))


def trailing_money(x: Column) -> Column:
    """The amount at the end of a line; no blanks inside."""
    return parse_money(let(x, lambda v: F.when(F.contains(v, F.lit(".")), group(trim(v), _MONEY_END))))


def canonical_line(date: Column, description: Column, amount: Column) -> Column:
    return F.concat_ws("|", date, collapse(F.lower(description)), amount.cast(MONEY).cast("string"), F.lit(CURRENCY))
