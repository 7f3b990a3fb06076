"""Format-preserving Feistel pseudonyms for personal data. DataFrame operations only.

Candidates are found by one pattern, validated by kind, and replaced by a keyed permutation of the values of their
format: an unbalanced Feistel network of eight rounds on Z_a x Z_b with SHA-256 of key, kind, round and other half as the
round function, so the image of a value has its format and is valid again, no two values of a kind meet, and equal
values get equal pseudonyms in every document.

kind      validated by                          permuted within
card      13 to 19 digits, Luhn sum             the digits but the last, which is computed again
phone     ten digits, with +1 or (area) or      area x exchange x line; those from 200 and those below stay so
          area and exchange from 200;
          abroad + and 8 to 15 digits           the digits behind the first two
ssn       area, group and serial that exist     the numbers that exist
ip        four octets up to 255                 256**4
date      a day of 1800-01-01 to 2199-12-31     the 146,097 days of these 400 years (189 x 773)
iban      the country's length, remainder 97    the digits of the account; check digits are computed again
email     shape                                 letters and digits of the local part; case, marks and domain stay
key       AKIA and 16 of A-Z0-9                 36**16, in halves
secret    password, token ... and 16 hex        the hex digits, in blocks of 20; or the letters and the digits, in
          digits, or 8 letters and digits       blocks of 60; case and marks stay

A candidate of several kinds is replaced by the first whose check it passes. What passes none stays as it is, as does
all other text. Slashed dates are read month first, or day first where only that is a day; the latter are permuted among
themselves (the permutation is walked until the day is over 12), so that no two dates get one pseudonym. Addresses are
linked whatever their case. A null text stays null and has no finds; an empty or very long one is treated whole. Rows may
repeat. Columns named n_pii or pii_kinds are replaced. Equal values of different formats (a date as 2020-01-31 and
31.01.2020) get the same day. A value can be its own image, as in any permutation; by chance, one in the number of values
of its format. The key is an argument; it is part of the plan, so who may read plans and event logs can invert the names.
"""

from __future__ import annotations

import secrets

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DIGITS, HEX, LETTERS, ALNUM = "0123456789", "0123456789abcdef", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
ROUNDS, BLOCK = 8, 20

#: Characters of an account number by country.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FO GL NL", 19: "MK SI", 20: "AT BA EE KZ LT LU XK", 21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR",
    27: "FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HU LB PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU", 31: "MT SC", 32: "LC",
}


def _account(size: int, countries: str) -> str:
    groups, rest = divmod(size - 4, 4)
    return f"(?:{countries.replace(' ', '|')})[0-9]{{2}}(?: ?[A-Z0-9]{{4}}){{{groups}}}" + (f" ?[A-Z0-9]{{{rest}}}" if rest else "")


PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}@(?:[A-Za-z0-9-]{1,63}\.){1,8}[A-Za-z]{2,24}(?![A-Za-z0-9_-])",
    "secret": r"(?<![A-Za-z0-9])(?:password|passwd|pwd|secret|token|api_key|apikey)\s{0,2}[=:]\s{0,2}[\"']?[A-Za-z0-9_+/-]{8,}+",
    "key": r"(?<![A-Za-z0-9_])AKIA[0-9A-Z]{16}(?![A-Za-z0-9_])",
    "iban": rf"(?<![A-Za-z0-9_])(?:{'|'.join(_account(*x) for x in IBAN_LENGTHS.items())})(?![A-Za-z0-9_])",
    "phone": r"(?<![A-Za-z0-9_+])(?:(?:\+1[ .-]?)?(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}|\+[2-9][0-9]{0,2}(?:[ .-]?\(?[0-9]{1,4}\)?){2,5})(?![A-Za-z0-9_])",
    "card": r"(?<![A-Za-z0-9_])(?:[0-9]{13,19}|[0-9]{4}[ -][0-9]{4}[ -][0-9]{4}[ -][0-9]{1,7}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5})(?![A-Za-z0-9_])",
    "ip": r"(?<![A-Za-z0-9_.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![A-Za-z0-9_]|\.[0-9])",
    "ssn": r"(?<![A-Za-z0-9_-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![A-Za-z0-9_-])",
    "date": r"(?<![A-Za-z0-9_])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{4}/[0-9]{2}/[0-9]{2}|[0-9]{2}[./][0-9]{2}[./][0-9]{4})(?![A-Za-z0-9_])",
}
ANY = "|".join(PATTERNS.values())
#: Found in every text in which a pattern is: each holds a digit or @, or a key's prefix, or a name and mark before a secret.
GUARD = r"[0-9@]|AKIA|(?:password|passwd|pwd|secret|token|api_key|apikey)\s{0,2}[=:]"
#: Steps of the permutation at most to find a day over 12; one in 10**26 walks is longer.
WALK, MASKED = 64, 60


def _quoted(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _let(name: str, value: str, body: str) -> str:
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


class Sql:
    """SQL text of the permutations under one key."""

    def __init__(self, key: str):
        self.key = _quoted(key)

    def feistel(self, left: str, right: str, a: str, b: str, tweak: str) -> str:
        """The struct (l, r) that (left, right) of Z_a x Z_b is mapped to. Halves below 2**55."""
        turn = lambda half, n: f"cast(conv(substring(sha2(concat_ws('|', {self.key}, {tweak}, i, {half}), 256), 1, 14), 16, 10) as bigint) % ({n})"
        start = f"named_struct('l', cast({left} as bigint), 'r', cast({right} as bigint))"
        return f"aggregate(sequence(0, {ROUNDS - 1}), {start}, (s, i) -> if(i % 2 = 0, named_struct('l', (s.l + {turn('s.r', a)}) % ({a}), 'r', s.r), named_struct('l', s.l, 'r', (s.r + {turn('s.l', b)}) % ({b}))))"

    def number(self, s: str, alphabet: str) -> str:
        return f"if(length({s}) = 0, 0L, aggregate(sequence(1, length({s})), 0L, (n, j) -> n * {len(alphabet)} + instr('{alphabet}', substring({s}, j, 1)) - 1))"

    def spelled(self, n: str, size: str, alphabet: str) -> str:
        r = len(alphabet)
        return f"if({size} = 0, '', array_join(transform(sequence(1, {size}), j -> substring('{alphabet}', cast(({n} div cast(power({r}, {size} - j) as bigint)) % {r} as int) + 1, 1)), ''))"

    def block(self, s: str, alphabet: str, tweak: str) -> str:
        """Up to BLOCK characters of an alphabet, permuted."""
        r, u = len(alphabet), f"cast(length({s}) div 2 as int)"
        v = f"(length({s}) - {u})"
        space = lambda n: f"cast(power({r}, {n}) as bigint)"
        pair = self.feistel(self.number(f"substring({s}, 1, {u})", alphabet), self.number(f"substring({s}, {u} + 1)", alphabet), space(u), space(v), f"concat_ws('/', {tweak}, length({s}))")
        return _let("f", pair, f"concat({self.spelled('f.l', u, alphabet)}, {self.spelled('f.r', v, alphabet)})")

    def string(self, s: str, alphabet: str, tweak: str) -> str:
        inner = _let("c", f"substring(w, k * {BLOCK} + 1, {BLOCK})", self.block("c", alphabet, f"concat_ws('/', {tweak}, k)"))
        return _let("w", s, f"if(length(w) = 0, '', array_join(transform(sequence(0, (length(w) - 1) div {BLOCK}), k -> {inner}), ''))")

    def refill(self, x: str, by: str, kind: str) -> str:
        """x with its characters of the class `kind` replaced, in order, by those of `by`."""
        return _let("d", by, f"array_join(transform(sequence(1, length({x})), j -> if(substring({x}, j, 1) rlike '[{kind}]', substring(d, length(regexp_replace(substring({x}, 1, j), '[^{kind}]', '')), 1), substring({x}, j, 1))), '')")

    @staticmethod
    def only(x: str, kind: str) -> str:
        return f"regexp_replace({x}, '[^{kind}]', '')"

    @staticmethod
    def luhn(d: str) -> str:
        """The Luhn sum of a string of digits, the last of weight one."""
        digit = f"cast(substring({d}, length({d}) - j, 1) as int)"
        return f"aggregate(sequence(0, length({d}) - 1), 0, (n, j) -> n + if(j % 2 = 0, {digit}, if({digit} > 4, 2 * {digit} - 9, 2 * {digit})))"

    @staticmethod
    def mod97(s: str) -> str:
        """The remainder of an account in digits and capitals, letters as 10 to 35."""
        place = f"instr('{DIGITS}{ALNUM[:26]}', substring({s}, j, 1)) - 1"
        return f"aggregate(sequence(1, length({s})), 0, (n, j) -> cast(if({place} < 10, n * 10 + {place}, n * 100 + {place}) % 97 as int))"

    def card(self) -> str:
        payload = self.string("substring(q, 1, length(q) - 1)", DIGITS, "'card'")
        whole = _let("p", payload, f"concat(p, cast((10 - {self.luhn("concat(p, '0')")} % 10) % 10 as string))")
        return _let("q", self.only("x", "0-9"), f"if({self.luhn('q')} % 10 = 0, {self.refill('x', whole, '0-9')}, null)")

    def phone(self) -> str:
        ten = "right(q, 10)"
        area, exchange, line = (f"cast(substring({ten}, {i}, {n}) as bigint)" for i, n in ((1, 3), (4, 3), (7, 4)))
        # Areas and exchanges from 200 on are permuted among themselves, and so are those below.
        low, size = (lambda v: f"if({v} >= 200, 200L, 0L)"), (lambda v: f"if({v} >= 200, 800L, 200L)")
        tweak = f"concat('phone', {area} >= 200, {exchange} >= 200)"
        image = self.feistel(f"({area} - {low(area)}) * {size(exchange)} + {exchange} - {low(exchange)}", line, f"{size(area)} * {size(exchange)}", "10000L", tweak)
        parts = [f"lpad(cast({low(area)} + f.l div {size(exchange)} as string), 3, '0')", f"lpad(cast({low(exchange)} + f.l % {size(exchange)} as string), 3, '0')", "lpad(cast(f.r as string), 4, '0')"]
        near = _let("f", image, f"concat(left(q, length(q) - 10), {', '.join(parts)})")
        far = f"concat(left(q, 2), {self.string('substring(q, 3)', DIGITS, "concat('phone', left(q, 2))")})"
        near = f"if(x rlike '^[+(]' or {area} >= 200 and {exchange} >= 200, {self.refill('x', near, '0-9')}, null)"
        far = f"if(length(q) between 8 and 15, {self.refill('x', far, '0-9')}, null)"
        return _let("q", self.only("x", "0-9"), f"if(x rlike '^[+][2-9]', {far}, {near})")

    def ssn(self) -> str:
        area, group, serial = (f"cast(substring(x, {i}, {n}) as bigint)" for i, n in ((1, 3), (5, 2), (8, 4)))
        index = f"(if({area} > 666, {area} - 2, {area} - 1) * 99 + {group} - 1)"
        image = _let("f", self.feistel(index, f"{serial} - 1", f"{898 * 99}L", "9999L", "'ssn'"), "concat(lpad(cast(if(f.l div 99 >= 665, f.l div 99 + 2, f.l div 99 + 1) as string), 3, '0'), '-', lpad(cast(f.l % 99 + 1 as string), 2, '0'), '-', lpad(cast(f.r + 1 as string), 4, '0'))")
        return f"if({area} between 1 and 899 and {area} <> 666 and {group} > 0 and {serial} > 0, {image}, null)"

    def ip(self) -> str:
        at = lambda i: f"cast(o[{i}] as bigint)"
        image = _let("f", self.feistel(f"{at(0)} * 256 + {at(1)}", f"{at(2)} * 256 + {at(3)}", "65536L", "65536L", "'ip'"), "concat_ws('.', f.l div 256, f.l % 256, f.r div 256, f.r % 256)")
        return _let("o", r"split(x, '[.]')", f"if({' and '.join(f'{at(i)} < 256' for i in range(4))}, {image}, null)")

    def date(self) -> str:
        turned = "(x rlike '^[0-9]{2}/' and left(x, 2) > '12')"
        iso = f"case when x rlike '^[0-9]{{4}}' then translate(x, '/', '-') when x like '%.%' or {turned} then concat_ws('-', right(x, 4), substring(x, 4, 2), left(x, 2)) else concat_ws('-', right(x, 4), left(x, 2), substring(x, 4, 2)) end"
        same = "(x rlike '^[0-9]{4}-.*-|^[0-9]{4}/.*/|[.].*[.]|^[0-9]{2}/.*/')"
        day = lambda n: f"date_add(date'1800-01-01', cast({n} as int))"
        step = _let("f", self.feistel("w.n div 773", "w.n % 773", "189L", "773L", "'date'"), f"named_struct('n', f.l * 773 + f.r, 'go', {turned} and day({day('f.l * 773 + f.r')}) <= 12)")
        image = f"aggregate(sequence(1, if({turned}, {WALK}, 1)), named_struct('n', d, 'go', true), (w, k) -> if(w.go, {step}, w)).n"
        kinds = {"x like '____-%'": "yyyy-MM-dd", "x like '____/%'": "yyyy/MM/dd", "x like '%.%'": "dd.MM.yyyy", turned: "dd/MM/yyyy", "true": "MM/dd/yyyy"}
        made = _let("y", day(image), f"case {' '.join(f"when {when} then date_format(y, '{shape}')" for when, shape in kinds.items())} end")
        return _let("d", f"cast(datediff(try_cast({iso} as date), date'1800-01-01') as bigint)", f"if({same} and d between 0 and 146096, {made}, null)")

    def iban(self) -> str:
        bban = self.refill("substring(q, 5)", self.string(self.only("substring(q, 5)", "0-9"), DIGITS, "concat('iban', left(q, 2))"), "0-9")
        check = f"lpad(cast(98 - {self.mod97("concat(p, left(q, 2), '00')")} as string), 2, '0')"
        whole = _let("p", bban, f"concat(left(q, 2), {check}, p)")
        valid = f"{self.mod97('concat(substring(q, 5), left(q, 4))')} = 1"
        return _let("q", "translate(x, ' ', '')", f"if({valid}, {self.refill('x', whole, 'A-Z0-9')}, null)")

    def masked(self, m: str, tweak: str) -> str:
        """The letters and the digits of a short string, permuted; the digits' permutation depends on the letters, case aside."""
        low = f"lower({self.only(m, 'A-Za-z')})"
        cased = f"if(substring({m}, j, 1) rlike '[A-Z]', upper(t), t)"
        place = f"substring(e, length(regexp_replace(substring({m}, 1, j), '[^A-Za-z]', '')), 1)"
        lettered = _let("e", self.string(low, LETTERS, tweak), f"array_join(transform(sequence(1, length({m})), j -> if(substring({m}, j, 1) rlike '[A-Za-z]', {_let('t', place, cased)}, substring({m}, j, 1))), '')")
        return _let("z", lettered, self.refill("z", self.string(self.only(m, "0-9"), DIGITS, f"concat({tweak}, {low})"), "0-9"))

    def email(self) -> str:
        return _let("m", "split_part(x, '@', 1)", f"concat({self.masked('m', "'email'")}, '@', split_part(x, '@', 2))")

    def secret(self) -> str:
        part = _let("m", f"substring(v, b * {MASKED} + 1, {MASKED})", self.masked("m", "concat('secret', b)"))
        mixed = f"array_join(transform(sequence(0, (length(v) - 1) div {MASKED}), b -> {part}), '')"
        hexed = self.string("v", HEX, "'secret'")
        new = f"case when v rlike '^[0-9a-f]{{16,}}$' then {hexed} when v rlike '[0-9]' and v rlike '[A-Za-z]' then {mixed} end"
        return _let("v", "regexp_extract(x, '[A-Za-z0-9_+/-]+$', 0)", f"concat(left(x, length(x) - length(v)), {new})")

    def aws(self) -> str:
        return f"concat('AKIA', {self.string('substring(x, 5)', ALNUM, "'key'")})"

    def replaced(self) -> str:
        """Of a candidate x, the struct (kind, value); null where no kind accepts it."""
        makers = {"email": self.email, "secret": self.secret, "key": self.aws, "iban": self.iban, "phone": self.phone, "card": self.card, "ip": self.ip, "ssn": self.ssn, "date": self.date}
        named = lambda k, f: _let("made", f(), f"if(made is null, null, named_struct('kind', '{k}', 'value', made))")
        return f"coalesce({', '.join(f'if(x rlike {_quoted("^(?:" + PATTERNS[k] + ")$")}, {named(k, f)}, null)' for k, f in makers.items())})"


def pseudonymize(docs: DataFrame, *, key: str, text_col: str = "text") -> DataFrame:
    """docs with the personal data in text_col replaced, n_pii (finds) and pii_kinds (their kinds, sorted, joined by commas).

    key: the secret that the pseudonyms depend on; without one nothing is replaced."""
    if not key:
        raise ValueError("pseudonyms need a key")
    kept = docs.select(*[c for c in docs.columns if c not in ("n_pii", "pii_kinds") or c == text_col])
    text = F.col(text_col)
    found = F.when(text.rlike(GUARD), F.regexp_extract_all(text, F.lit(ANY), F.lit(0)))
    staged = kept.withColumn("__found", F.coalesce(found, F.array().cast("array<string>")))
    staged = staged.withColumn("__new", F.when(F.size("__found") > 0, F.expr(f"transform(__found, x -> {Sql(key).replaced()})")))
    pieces = F.split(text, ANY, -1)
    values = F.zip_with("__found", "__new", lambda x, y: F.coalesce(y["value"], x))
    whole = F.array_join(F.zip_with(pieces, values, lambda p, v: F.concat(p, F.coalesce(v, F.lit("")))), "")
    real = F.filter("__new", lambda y: y["value"].isNotNull())
    return staged.withColumn(text_col, F.when(F.size("__found") > 0, whole).otherwise(text)).withColumn("n_pii", F.when(F.size("__found") > 0, F.size(real)).otherwise(0).cast("long")).withColumn("pii_kinds", F.when(F.size("__found") > 0, F.array_join(F.array_sort(F.array_distinct(F.transform(real, lambda y: y["kind"]))), ",")).otherwise("")).drop("__found", "__new")


#: The setting that holds the key; settings so named are left out of what Spark shows.
KEY_SETTING = "spark.quern.pii.secret"


def session_key(spark) -> str:
    """The session's key: its setting, or else a random one that is set now and lasts as long as the session."""
    if not spark.conf.get(KEY_SETTING, None):
        spark.conf.set(KEY_SETTING, secrets.token_hex(32))
    return spark.conf.get(KEY_SETTING)


def op8_pii_pseudonyms(spark, sf_dir: str) -> DataFrame:
    return pseudonymize(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), key=session_key(spark))
