"""Check-digit rules as Column expressions over a matched span."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def at(s: Column, i: int) -> Column:
    """The digit at place i."""
    return F.ascii(F.substring(s, i + 1, 1)) - 48


def dot(s: Column, weights) -> Column:
    return reduce(lambda a, b: a + b, (at(s, i) * w for i, w in enumerate(weights) if w))


def _sized(m: Column, n: int, rule) -> Column:
    d = digits(m)
    return F.when(F.length(d) == n, rule(d)).otherwise(False)


def _mixed(d: Column) -> Column:
    """Not one digit throughout."""
    return ~d.rlike(r"^(\d)\1*$")


def _mod11(s: Column) -> Column:
    return F.when(s % 11 >= 2, 11 - s % 11).otherwise(0)


def _letter(table: str, i: Column) -> Column:
    return F.substring(F.lit(table), i.cast("int") + 1, F.lit(1))


def luhn(m: Column) -> Column:
    d = F.reverse(F.regexp_replace(m, "[- ]", ""))
    each = F.transform(F.split(d, ""), lambda x, i: F.when(i % 2 == 1, F.when(x.cast("int") > 4, x.cast("int") * 2 - 9).otherwise(x.cast("int") * 2)).otherwise(x.cast("int")))
    return (F.length(d) > 0) & (F.aggregate(F.filter(each, lambda x: x.isNotNull()), F.lit(0), lambda a, x: a + x) % 10 == 0)


def iban(m: Column) -> Column:
    s = F.replace(m, F.lit(" "), F.lit(""))
    turned = F.concat(F.substring(s, 5, 40), F.substring(s, 1, 4))
    rest = F.aggregate(F.split(turned, ""), F.lit(0), lambda a, c: F.when(c == "", a).when(F.ascii(c) < 58, (a * 10 + F.ascii(c) - 48) % 97).otherwise((a * 100 + F.ascii(c) - 55) % 97))
    return s.rlike("^[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}$") & (rest == 1)


def ssn(m: Column) -> Column:
    d = F.replace(m, F.lit("-"), F.lit(""))
    return d.rlike(r"^(?!000|666|9)\d{3}(?!00)\d{2}(?!0000)\d{4}$") & ~d.isin("012345678", "123456789") & _mixed(d)


def itin(m: Column) -> Column:
    d = F.replace(m, F.lit("-"), F.lit(""))
    return d.rlike(r"^9(5\d|6[0-5]|7\d|8[0-8]|9[0-24-9])(?!00)\d{2}(?!0000)\d{4}$")


def nhs(d: Column) -> Column:
    c = 11 - dot(d, range(10, 1, -1)) % 11
    return F.when(c == 11, 0).otherwise(c) == at(d, 9)


def nino(m: Column) -> Column:
    return F.regexp_replace(m, r"[\s\p{Zs}]", "").rlike(r"^(?!BG|GB|NK|KN|TN|NT|ZZ)..\d{6}[A-D]$")


def abn(d: Column) -> Column:
    first = F.when(at(d, 0) > 0, at(d, 0) - 1).otherwise(0)
    return (first * 10 + dot(d, [0, 1, 3, 5, 7, 9, 11, 13, 15, 17, 19])) % 89 == 0


def verhoeff(d: Column) -> Column:
    """The dihedral group's product of the permuted digits from the right is 0."""
    power, tables = list(range(10)), []
    for _ in range(8):
        tables.append(power)
        power = [[1, 5, 7, 6, 2, 8, 3, 0, 9, 4][x] for x in power]
    group = "".join(str(((j + k) % 5 if k < 5 else 5 + (j + k) % 5) if j < 5 else (5 + (j - k) % 5 if k < 5 else (j - k) % 5)) for j in range(10) for k in range(10))
    turn = "".join(map(str, sum(tables, [])))
    c = F.lit(0)
    for i in range(12):
        p = F.substring(F.lit(turn), (F.lit(i % 8 * 10) + at(d, 11 - i) + 1).cast("int"), F.lit(1)).cast("int")
        c = F.substring(F.lit(group), (c * 10 + p + 1).cast("int"), F.lit(1)).cast("int")
    return c == 0


#: The letters whose place is the worth of an odd-placed letter, and pairs whose digit sums are the worths of odd-placed digits.
IT_ODD_LETTERS, IT_ODD_DIGITS = "BAKPLCQDREVOSFTGUHMINJWZYX", "1021222423252627282924"
#: Check letters of ES NIF/NIE, SG FIN (F/G and M) and FI codes.
ES_LETTERS, SG_LETTERS, SG_M_LETTERS, FI_LETTERS = "TRWAGMYFPDXBNJZSQVHLCKE", "XWUTRQPNMLK", "KLJNPQRTUWX", "0123456789ABCDEFHJKLMNPRSTUVWXY"


def it_fiscal(m: Column) -> Column:
    odd_digits = [int(IT_ODD_DIGITS[2 * d]) + int(IT_ODD_DIGITS[2 * d + 1]) for d in range(10)]
    total = F.lit(0)
    for i in range(15):
        c = F.substring(m, i + 1, 1)
        digit = F.array(*map(F.lit, odd_digits))[(F.ascii(c) - 48).cast("int")] if i % 2 == 0 else F.ascii(c) - 48
        letter = F.instr(F.lit(IT_ODD_LETTERS), c) - 1 if i % 2 == 0 else F.ascii(c) - 65
        total = total + F.when(c.rlike("^[0-9]$"), digit).otherwise(letter)
    return F.when(F.length(m) == 16, F.char(total % 26 + 65) == F.substring(m, 16, 1)).otherwise(False)


def it_vat(d: Column) -> Column:
    total = dot(d, [1, 0] * 5)
    for i in range(1, 10, 2):
        total = total + F.when(at(d, i) > 4, at(d, i) * 2 - 9).otherwise(at(d, i) * 2)
    return (10 - total % 10) % 10 == at(d, 10)


def es_nif(m: Column) -> Column:
    return m.rlike(r"^\d{8}[A-Z]$") & (_letter(ES_LETTERS, F.substring(m, 1, 8).try_cast("int") % 23) == F.substring(m, 9, 1))


def es_nie(m: Column) -> Column:
    return m.rlike(r"^[XYZ]\d{7}[A-Z]$") & (_letter(ES_LETTERS, F.translate(F.substring(m, 1, 8), "XYZ", "012").try_cast("int") % 23) == F.substring(m, 9, 1))


def sg_fin(m: Column) -> Column:
    s = dot(F.substring(m, 2, 7), [2, 7, 6, 5, 4, 3, 2])
    is_m = F.substring(m, 1, 1) == "M"
    return m.rlike(r"^[FGM]\d{7}[A-Z]$") & (F.when(is_m, _letter(SG_M_LETTERS, (s + 3) % 11)).otherwise(_letter(SG_LETTERS, s % 11)) == F.substring(m, 9, 1))


def cpf(d: Column) -> Column:
    return _mixed(d) & (_mod11(dot(d, range(10, 1, -1))) == at(d, 9)) & (_mod11(dot(d, range(11, 1, -1))) == at(d, 10))


def cnpj(d: Column) -> Column:
    w = [5, 4, 3, 2, 9, 8, 7, 6, 5, 4, 3, 2]
    return _mixed(d) & (_mod11(dot(d, w)) == at(d, 12)) & (_mod11(dot(d, [6, *w])) == at(d, 13))


def cnh(d: Column) -> Column:
    a, b = dot(d, range(9, 0, -1)) % 11, dot(d, range(1, 10)) % 11
    less = F.when(a >= 10, 2).otherwise(0)
    second = F.when(b >= 10, 0).when(b - less < 0, b - less + 11).otherwise(b - less)
    return _mixed(d) & (F.when(a >= 10, 0).otherwise(a) == at(d, 9)) & (second == at(d, 10))


def pis(d: Column) -> Column:
    return _mixed(d) & (_mod11(dot(d, [3, 2, 9, 8, 7, 6, 5, 4, 3, 2])) == at(d, 10))


def cns(d: Column) -> Column:
    s = dot(d, range(15, 4, -1))
    plain = 11 - s % 11
    ten = plain == 10
    check = F.when(plain == 11, 0).when(ten, 11 - (s + 2) % 11).otherwise(plain)
    definitive = (at(d, 11) == 0) & (at(d, 12) == 0) & (at(d, 13) == F.when(ten, 1).otherwise(0)) & (at(d, 14) == check)
    return F.when(at(d, 0).isin(1, 2), definitive).when(at(d, 0).isin(7, 8, 9), dot(d, range(15, 0, -1)) % 11 == 0).otherwise(False)


def titulo(d: Column) -> Column:
    ten = lambda x: F.when(x % 11 == 10, 0).otherwise(x % 11)
    first = ten(dot(d, range(2, 10)))
    return F.substring(d, 9, 2).try_cast("int").between(1, 28) & (first == at(d, 10)) & (ten(at(d, 8) * 7 + at(d, 9) * 8 + first * 9) == at(d, 11))


def renavam(d: Column) -> Column:
    c = 11 - dot(d, [3, 2, 9, 8, 7, 6, 5, 4, 3, 2]) % 11
    return _mixed(d) & (F.when(c >= 10, 0).otherwise(c) == at(d, 10))


def fi_code(m: Column) -> Column:
    n = F.concat(F.substring(m, 1, 6), F.substring(m, 8, 3)).try_cast("long")
    return m.rlike(r"^\d{6}[-+A]\d{3}.$") & (_letter(FI_LETTERS, n % 31) == F.substring(m, 11, 1))


#: By name: whether a matched span is valid.
VALIDATORS = {
    "luhn": luhn, "iban": iban, "ssn": ssn, "itin": itin, "nino": nino, "it_fiscal": it_fiscal, "es_nif": es_nif, "es_nie": es_nie, "sg_fin": sg_fin, "fi_code": fi_code,
    "aba": lambda m: _sized(m, 9, lambda d: dot(d, [3, 7, 1] * 3) % 10 == 0),
    "nhs": lambda m: _sized(m, 10, nhs),
    "tfn": lambda m: _sized(m, 9, lambda d: dot(d, [1, 4, 3, 7, 5, 8, 6, 9, 10]) % 11 == 0),
    "abn": lambda m: _sized(m, 11, abn),
    "acn": lambda m: _sized(m, 9, lambda d: (10 - dot(d, range(8, 0, -1)) % 10) % 10 == at(d, 8)),
    "medicare": lambda m: _sized(m, 10, lambda d: at(d, 0).between(2, 6) & (dot(d, [1, 3, 7, 9, 1, 3, 7, 9]) % 10 == at(d, 8))),
    "aadhaar": lambda m: _sized(m, 12, verhoeff),
    "it_vat": lambda m: _sized(m, 11, it_vat),
    "cpf": lambda m: _sized(m, 11, cpf),
    "cnpj": lambda m: _sized(m, 14, cnpj),
    "cnh": lambda m: _sized(m, 11, cnh),
    "pis": lambda m: _sized(m, 11, pis),
    "cns": lambda m: _sized(m, 15, cns),
    "titulo": lambda m: _sized(m, 12, titulo),
    "renavam": lambda m: _sized(m, 11, renavam),
    "pesel": lambda m: _sized(m, 11, lambda d: (10 - dot(d, [1, 3, 7, 9, 1, 3, 7, 9, 1, 3]) % 10) % 10 == at(d, 10)),
    "kr_rrn": lambda m: _sized(m, 13, lambda d: (11 - dot(d, [2, 3, 4, 5, 6, 7, 8, 9, 2, 3, 4, 5]) % 11) % 10 == at(d, 12)),
    "th_tnin": lambda m: _sized(m, 13, lambda d: (11 - dot(d, range(13, 1, -1)) % 11) % 10 == at(d, 12)),
}
